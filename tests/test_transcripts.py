from __future__ import annotations

from voxtally.functions import transcripts as tr


def test_tagged(value):
    cases = {
        "<b>10:00:01 Support Bot:</b> Hello <br/><b>10:00:05 Dana:</b> App is slow <br/>": "App is slow",
        "<b>10:00:01 System:</b> joined <br/>": "",
        "<b>10:00:01 Lee:</b> one <br/><b>10:00:02 Dana:</b> two <br/>": "one",
        "<b>10:00:01 Lee:</b> a <br/><b>10:00:02 Dana:</b> b <br/><b>10:00:03 Lee:</b> c <br/>": "b",
        "<b>10:00:01 Care Bot:</b> a <br/><b>10:00:02 Care Bot:</b> b <br/><b>10:00:03 Agent:</b> c <br/>": "c",
        "<B>10:00:01 Dana :</B> two\n  lines<BR><b>10:00:02 DANA:</b> more": "two lines more",
        "": "",
        None: "",
        "no turns at all": "",
    }
    assert dict(zip(cases, value(tr.extract_tagged, *cases))) == cases


def test_blank_tagged_messages_count(value):
    said = "<b>10:00:01 Lee:</b>  <br/><b>10:00:02 Lee:</b> x <br/><b>10:00:03 Dana:</b> y <br/>"
    assert value(tr.extract_tagged, said) == "y"


def test_sms(value):
    cases = {
        "10:00:01 Care Team: Hello 10:00:05 5550001: App is slow": "App is slow",
        "10:00:01 5550002: first 10:00:02 5550001: x 10:00:03 5550002: second": "first second",
        "10:00:01 Ann: hi 10:00:02 Agent: SSN rule for Chat 10:00:03 Agent: ok": "hi",
        "10:00:01 Ann: Looks up Phone Number 1 digits-12 yes 2024-01-01T10:00:00ZUTC": "yes",
    }
    assert dict(zip(cases, value(tr.extract_tagged, *cases))) == cases


def test_bracket(value):
    cases = {
        "[10:00:01 AGENT]: Hello [10:00:05 CUSTOMER]: App is slow": "App is slow",
        "[10:00:01 customer]: a\n b [10:00:05 AGENT]: no [10:00:09 CUSTOMER]: c": "a b c",
        None: "",
        "nothing": "",
    }
    assert dict(zip(cases, value(tr.extract_bracket, *cases))) == cases


def test_pipe(value):
    cases = {
        "2024-01-01 Agent: Hello | 2024-01-01 Consumer: App is slow": "App is slow",
        "Consumer: a Consumer: b | Consumer:  c ": "a c",
        "plain": "",
        None: "",
    }
    assert dict(zip(cases, value(tr.extract_pipe, *cases))) == cases


def test_pipe_or_plain(value):
    cases = {
        "x Agent: Hello | x Consumer: a | x Customer: b": "a b",
        "Customer: c Consumer: d | z": "d",
        "  App is slow ": "App is slow",
        "Consumer: without a pipe": "Consumer: without a pipe",
        "a | b": "a | b",
        None: "",
    }
    assert dict(zip(cases, value(tr.extract_pipe_or_plain, *cases))) == cases
