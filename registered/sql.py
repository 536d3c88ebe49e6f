"""Parts of the oracle SQL (DuckDB).

The SQL states the rules anew: plain alternations, window functions over exploded
words and turns, one CASE per cascade.  It shares only parameters with the
library, never logic.
"""

from __future__ import annotations

from registered import fixtures as fx
from voxtally.functions.common import WHITE_SPACE
from voxtally.functions.lexicon import PUNCTUATION


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words_list(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def in_list(values) -> str:
    return "(" + ", ".join(quoted(v) for v in values) + ")"


WS = quoted(WHITE_SPACE)
WS_RUN = quoted(f"[{WHITE_SPACE}]+")


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, {WS_RUN}, ' ', 'g'), {WS})"


def alternation(phrases) -> str:
    """Longest first; none of the fixture phrases holds a special character."""
    return quoted("(?i)" + "|".join(sorted(phrases, key=lambda p: (-len(p), p))))


def rounded(x: str, digits: int) -> str:
    """Half up on the printed decimals of a double, as Spark rounds."""
    return f"round((({x})::DOUBLE)::VARCHAR::DECIMAL(38, 24), {digits})::DOUBLE"


def pct(part: str, whole: str) -> str:
    share = rounded(f"{part} / ({whole})::DOUBLE * 100.0::DOUBLE", 1)
    return f"CASE WHEN {whole} > 0 THEN {share} ELSE 0.0::DOUBLE END"


VERY_NEGATIVE, VERY_POSITIVE = "'(?i)schst'", "'(?i)ononst'"
POSITIVE = "'(?i)with that|was the|die die'"
NEGATIVE = "'(?i)for the|three|ción'"
STRONG, RESOLUTION = "'(?i)hehely|three'", "'(?i)from|this'"
NEUTRAL = "'(?i)and the|entre|iere'"


def has(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {pattern})"


def positives(column: str) -> str:
    return f"len(regexp_extract_all({column}, {POSITIVE}))"


def five_tier_rule(t: str) -> str:
    return f"""CASE WHEN {has(t, VERY_NEGATIVE)} THEN 'rule:very_negative'
      WHEN {has(t, VERY_POSITIVE)} THEN 'rule:very_positive'
      WHEN {has(t, POSITIVE)} AND {positives(t)} >= 2 THEN 'rule:positive_strong'
      WHEN {has(t, POSITIVE)} THEN 'rule:positive'
      WHEN {has(t, NEGATIVE)} AND {has(t, STRONG)} THEN 'rule:strong_negative'
      WHEN {has(t, NEGATIVE)} AND {has(t, RESOLUTION)} THEN 'rule:neutral_resolved'
      WHEN {has(t, NEGATIVE)} THEN 'rule:negative'
      WHEN {has(t, NEUTRAL)} THEN 'rule:neutral'
      ELSE 'vader' END"""


def four_tier_rule(t: str) -> str:
    return f"""CASE WHEN {has(t, VERY_POSITIVE)} THEN 'rule:very_positive'
      WHEN {has(t, POSITIVE)} AND {positives(t)} >= 2 THEN 'rule:very_positive'
      WHEN {has(t, POSITIVE)} THEN 'rule:positive'
      WHEN {has(t, NEGATIVE)} AND {has(t, STRONG)} THEN 'rule:strong_negative'
      WHEN {has(t, NEGATIVE)} AND {has(t, RESOLUTION)} THEN 'rule:neutral_resolved'
      WHEN {has(t, NEGATIVE)} THEN 'rule:negative'
      WHEN {has(t, NEUTRAL)} THEN 'rule:neutral'
      ELSE 'vader' END"""


def no_positive_rule(t: str) -> str:
    return f"""CASE WHEN {has(t, NEGATIVE)} AND {has(t, STRONG)} THEN 'rule:strong_negative'
      WHEN {has(t, NEGATIVE)} AND {has(t, RESOLUTION)} THEN 'rule:neutral_resolved'
      WHEN {has(t, NEGATIVE)} THEN 'rule:negative'
      WHEN {has(t, NEUTRAL)} THEN 'rule:neutral'
      ELSE 'vader' END"""


FIVE_TIER_VALUES = """(VALUES ('rule:very_negative', -0.85::DOUBLE, 0.95::DOUBLE), ('rule:very_positive', 0.85, 0.95),
  ('rule:positive_strong', 0.75, 0.90), ('rule:positive', 0.35, 0.80), ('rule:strong_negative', -0.70, 0.95),
  ('rule:neutral_resolved', 0.0, 0.75), ('rule:negative', -0.55, 0.80), ('rule:neutral', 0.0, 0.80),
  ('blank', 0.0, 0.0), ('vader', NULL, 0.5)) AS v(rule, score, confidence)"""
FOUR_TIER_VALUES = """(VALUES ('rule:very_positive', 0.85::DOUBLE, 0.90::DOUBLE), ('rule:positive', 0.40, 0.80),
  ('rule:strong_negative', -0.65, 0.95), ('rule:neutral_resolved', 0.0, 0.75), ('rule:negative', -0.60, 0.80),
  ('rule:neutral', 0.0, 0.80), ('blank', 0.0, 0.0), ('vader', NULL, 0.5)) AS v(rule, score, confidence)"""
NO_POSITIVE_VALUES = """(VALUES ('rule:strong_negative', -0.70::DOUBLE, 0.95::DOUBLE),
  ('rule:neutral_resolved', 0.0, 0.75), ('rule:negative', -0.55, 0.80), ('rule:neutral', 0.0, 0.80),
  ('blank', 0.0, 0.0), ('vader', NULL, 0.5)) AS v(rule, score, confidence)"""


def label(score: str) -> str:
    return f"""CASE WHEN {score} IS NULL THEN 'Neutral' WHEN {score} >= 0.6::DOUBLE THEN 'Very Positive'
      WHEN {score} >= 0.2::DOUBLE THEN 'Positive' WHEN {score} >= -0.2::DOUBLE THEN 'Neutral'
      WHEN {score} >= -0.6::DOUBLE THEN 'Negative' ELSE 'Very Negative' END"""


def wide_label(score: str) -> str:
    return f"""CASE WHEN {score} IS NULL THEN 'Neutral' WHEN {score} >= 5 THEN 'Very Positive'
      WHEN {score} >= 1 THEN 'Positive' WHEN {score} >= -2 THEN 'Neutral'
      WHEN {score} >= -3 THEN 'Negative' ELSE 'Very Negative' END"""


def label_score(name: str) -> str:
    return f"""CASE {name} WHEN 'Very Positive' THEN 0.85::DOUBLE WHEN 'Positive' THEN 0.35::DOUBLE
      WHEN 'Negative' THEN -0.55::DOUBLE WHEN 'Very Negative' THEN -0.85::DOUBLE ELSE 0.0::DOUBLE END"""


# ---------------------------------------------------------------------------
# Lexicon scoring over exploded words
# ---------------------------------------------------------------------------
LEXICON_VALUES = "(VALUES " + ", ".join(f"({quoted(w)}, {v})" for w, v in fx.LEXICON.items()) + ") AS lex(token, tenths)"


def emphasis(c: str) -> str:
    marks = f"(length({c}) - length(replace({c}, '!', '')))"
    asks = f"(length({c}) - length(replace({c}, '?', '')))"
    return (
        f"(least({marks}, 4) * 0.292::DOUBLE + CASE WHEN {asks} <= 1 THEN 0.0::DOUBLE "
        f"WHEN {asks} <= 3 THEN {asks} * 0.18::DOUBLE ELSE 0.96::DOUBLE END)"
    )


def chunks(source: str, key: str, text: str) -> str:
    """CTE ``chunked(key, chunk_no, chunk)``: sentences packed to about 300 characters."""
    return f"""sentences AS (
      SELECT {key}, string_split(regexp_replace({text}, '([.!?]) +', '\\1' || chr(1), 'g'), chr(1)) AS s FROM {source}),
    packed AS (
      SELECT {key}, list_reduce(
        list_prepend({{'done': []::VARCHAR[], 'open': ''}},
          list_transform(s, lambda x: {{'done': []::VARCHAR[], 'open': x}})),
        lambda a, x: CASE
          WHEN length(a.open) + length(x.open) <= 300
            THEN {{'done': a.done, 'open': a.open || ' ' || x.open}}
          ELSE {{'done': CASE WHEN a.open = '' THEN a.done ELSE list_append(a.done, trim(a.open, {WS})) END,
                'open': x.open}} END) AS p
      FROM sentences),
    chunked AS (
      SELECT {key}, unnest(cs) AS chunk, unnest(range(1, len(cs) + 1)) AS chunk_no
      FROM (SELECT {key}, CASE WHEN p.open = '' THEN p.done
                               ELSE list_append(p.done, trim(p.open, {WS})) END AS cs FROM packed))"""


def compounds(source: str, key: str, part: str, text: str) -> str:
    """CTEs ending in ``compounds(key, part, compound, strongest)`` for texts ``(key, part, text)``."""
    low = "lower(word)"
    pos, neg = "(p + CASE WHEN p > n THEN e ELSE 0 END)", "(n + CASE WHEN p < n THEN e ELSE 0 END)"
    strongest = f"greatest({pos}, {neg}, z) / ({pos} + {neg} + z)"
    return f"""split_words AS (
      SELECT {key}, {part}, unnest(ws) AS raw, unnest(range(1, len(ws) + 1)) AS pos
      FROM (SELECT {key}, {part}, list_filter(string_split_regex({text}, {WS_RUN}), lambda w: w <> '') AS ws
            FROM {source})),
    bare AS (
      SELECT {key}, {part}, pos,
        CASE WHEN length(trim(raw, {quoted(PUNCTUATION)})) <= 2 THEN raw
             ELSE trim(raw, {quoted(PUNCTUATION)}) END AS word
      FROM split_words),
    facts AS (
      SELECT {key}, {part}, pos, tenths,
        CASE WHEN {low} IN {in_list(fx.SCORER.boosters)} THEN 0.293::DOUBLE
             WHEN {low} IN {in_list(fx.SCORER.dampeners)} THEN -0.293::DOUBLE END AS boost,
        ({low} IN {in_list(fx.SCORER.negations)} OR contains({low}, 'n''t')) AS negates,
        (upper(word) = word AND {low} <> word) AS capital,
        ({low} = {quoted(fx.SCORER.contrast)}) AS turns
      FROM bare LEFT JOIN {LEXICON_VALUES} ON {low} = token),
    setting AS (
      SELECT *, (count(*) FILTER (capital) OVER w > 0 AND count(*) FILTER (NOT capital) OVER w > 0) AS mixed,
        min(CASE WHEN turns THEN pos END) OVER w AS turn_at
      FROM facts WINDOW w AS (PARTITION BY {key}, {part})),
    looks AS (
      SELECT *,
        {", ".join(f"lag({c}, {k}) OVER o AS {c}{k}" for k in (1, 2, 3)
                   for c in ("tenths", "boost", "negates", "capital", "pos"))}
      FROM setting WINDOW o AS (PARTITION BY {key}, {part} ORDER BY pos)),
    v0 AS (
      SELECT *, CASE WHEN capital AND mixed
          THEN (CASE WHEN tenths > 0 THEN tenths / 10.0::DOUBLE + 0.733::DOUBLE
                     ELSE tenths / 10.0::DOUBLE - 0.733::DOUBLE END)
          ELSE tenths / 10.0::DOUBLE END AS s0
      FROM looks),
    {_step(1, "1.0")}, {_step(2, "0.95")}, {_step(3, "0.9")},
    valences AS (
      SELECT {key}, {part}, pos,
        (CASE WHEN tenths IS NULL OR boost IS NOT NULL THEN 0.0::DOUBLE ELSE s3 END)
        * (CASE WHEN turn_at IS NULL OR pos = turn_at THEN 1.0::DOUBLE
                WHEN pos < turn_at THEN 0.5::DOUBLE ELSE 1.5::DOUBLE END) AS v
      FROM v3),
    sums AS (
      SELECT {key}, {part}, sum(v ORDER BY pos) AS total,
        coalesce(sum(v + 1 ORDER BY pos) FILTER (v > 0), 0.0) AS p,
        coalesce(sum(1 - v ORDER BY pos) FILTER (v < 0), 0.0) AS n,
        count(*) FILTER (v = 0) AS z
      FROM valences GROUP BY ALL),
    emphasised AS (
      SELECT src.{key}, src.{part}, coalesce(total, 0.0::DOUBLE) AS t0, p, n, z, {emphasis("src." + text)} AS e
      FROM {source} src LEFT JOIN sums USING ({key}, {part})),
    marked AS (SELECT *, t0 + sign(t0) * e AS t FROM emphasised),
    compounds AS (
      SELECT {key}, {part}, {rounded("t / sqrt(t * t + 15.0::DOUBLE)", 4)} AS compound,
        CASE WHEN p IS NULL THEN 0.0::DOUBLE ELSE {rounded(strongest, 3)} END AS strongest
      FROM marked)"""


def _step(k: int, damping: str) -> str:
    s = f"s{k - 1}"
    return f"""v{k} AS (
      SELECT *, CASE WHEN pos{k} IS NULL OR tenths{k} IS NOT NULL THEN {s}
        ELSE ({s} + coalesce((boost{k} * (CASE WHEN {s} < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END)
              + CASE WHEN capital{k} AND mixed THEN (CASE WHEN {s} > 0 THEN 0.733::DOUBLE ELSE -0.733::DOUBLE END)
                     ELSE 0.0::DOUBLE END) * {damping}::DOUBLE, 0.0))
             * (CASE WHEN negates{k} THEN -0.74::DOUBLE ELSE 1.0::DOUBLE END) END AS s{k}
      FROM v{k - 1})"""


def polarity(source: str, key: str, text: str) -> str:
    """CTEs ending in ``polarity(key, polarity)``; blank texts have no row."""
    kept = f"scorable AS (SELECT {key}, {text} FROM {source} WHERE trim({text}, {WS}) <> '')"
    return f"""{kept},
    {chunks("scorable", key, text)},
    {compounds("chunked", key, "chunk_no", "chunk")},
    polarity AS (SELECT {key}, sum(compound ORDER BY chunk_no) / count(*) AS polarity FROM compounds GROUP BY {key})"""


# ---------------------------------------------------------------------------
# The analysis of all documents
# ---------------------------------------------------------------------------
OVERRIDES = """overrides AS (
  SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'Positive'
                      WHEN quality = 0 AND toxic = 1 THEN 'Very Negative'
                      WHEN quality = 0 AND toxic = 0 THEN 'mixed' END AS override_label
  FROM labels WHERE NOT (quality = 1 AND toxic = 1))"""

BODY = f"""CASE WHEN length({squeeze("text")}) < 5 OR NOT contains({squeeze("text")}, ' ') THEN ''
      ELSE {squeeze("text")} END"""


def keywords(t: str, dictionary=None) -> str:
    """Distinct phrases in order, each in its first spelling, as a list."""
    found = f"regexp_extract_all({t}, {alternation((dictionary or fx.DICTIONARY).phrases)})"
    lowered = f"list_transform({found}, lambda k: lower(k))"
    return f"list_filter({found}, lambda k, i: list_position({lowered}, lower(k)) = i)"


def result(threshold: float = 0.7, bodies: str | None = None, rule: str | None = None, values: str = FIVE_TIER_VALUES) -> str:
    """CTEs ending in ``result``: one row per document as ``analyze`` gives it.

    ``bodies`` are CTEs ending in ``bodies(doc_id, text, body)``, if the documents are not analysed as they are.
    """
    bodies = bodies or f"bodies AS (SELECT documents.*, {BODY} AS body FROM documents)"
    blended = f"""CASE WHEN override_label IS NOT NULL THEN {label_score("override_label")}
          WHEN text_rule = 'blank' THEN 0.0::DOUBLE
          WHEN rule_score IS NOT NULL AND rule_confidence > {threshold}::DOUBLE THEN rule_score
          WHEN rule_score IS NOT NULL THEN rule_score * rule_confidence + lex * (1.0::DOUBLE - rule_confidence)
          ELSE lex END"""
    return f"""{OVERRIDES},
    {bodies},
    judged AS (
      SELECT bodies.*, override_label,
        CASE WHEN body = '' THEN 'blank' ELSE {rule or five_tier_rule("body")} END AS text_rule
      FROM bodies LEFT JOIN overrides USING (doc_id)),
    ruled AS (SELECT judged.*, score AS rule_score, confidence AS rule_confidence
              FROM judged JOIN {values} ON text_rule = v.rule),
    open_rows AS (SELECT doc_id, body FROM ruled WHERE override_label IS NULL AND text_rule <> 'blank'
                  AND (rule_score IS NULL OR rule_confidence <= {threshold}::DOUBLE)),
    {polarity("open_rows", "doc_id", "body")},
    mixed_in AS (
      SELECT ruled.*, polarity AS raw, CASE WHEN abs(polarity) < 0.05::DOUBLE THEN 0.0::DOUBLE ELSE polarity END AS lex
      FROM ruled LEFT JOIN polarity USING (doc_id)),
    scored AS (
      SELECT *, {rounded(blended, 3)} AS consumer_score,
        CASE WHEN override_label IS NOT NULL THEN 1.0::DOUBLE WHEN text_rule = 'blank' THEN 0.0::DOUBLE
          WHEN rule_score IS NOT NULL AND rule_confidence > {threshold}::DOUBLE THEN rule_confidence
          ELSE 0.5::DOUBLE END AS confidence
      FROM mixed_in),
    result AS (
      SELECT doc_id, text, body, consumer_score, confidence, {label("consumer_score")} AS consumer_sentiment,
        CASE WHEN override_label IS NULL THEN 'Model' ELSE 'Validation' END AS source,
        CASE WHEN override_label IS NULL THEN text_rule ELSE 'validation' END AS rule,
        raw, {keywords("body")} AS keywords
      FROM scored)"""


def category_rows(source: str, text: str, dictionary=None, keep: str = "") -> str:
    """One row per record and matched category."""
    parts = [
        f"SELECT {i} AS ordinal, {quoted(c)} AS category{keep} FROM {source} "
        f"WHERE regexp_matches({text}, {alternation(p)})"
        for i, (c, p) in enumerate((dictionary or fx.DICTIONARY).categories.items())
    ]
    return " UNION ALL ".join(parts)
