"""Registered queries of the operators and the DuckDB statements of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import op1_toxicity, op2_token_counts, op3_warc, op4_quality_rules, op5_sentence_spans
from llm import op6_byte_bpe, op7_token_files, op8_jaccard_join, op9_packing, op10_metric_search
from llm import op11_whitening, op12_quality_classifier, op13_hard_negatives
from llm.common import shared_folder
from llm.pretokens import default_tokenizer

#: Tokenizer files of the queries.
BPE_50K, BPE_MULTI, PIECES = "byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = op1_toxicity.fit(docs, _table(spark, folder, "labels"))
    rows = op1_toxicity.score(docs, model)
    return rows.select("doc_id", op1_toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return op2_token_counts.token_counts(_table(spark, folder, "documents"), default_tokenizer(PIECES))


def warc(spark: SparkSession, folder: str) -> DataFrame:
    chunks = op3_warc.round_trip(spark, _table(spark, folder, "pages"))
    return chunks.where("last").select(
        F.col("page_id").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
        "intact",
    )


def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    rows = op4_quality_rules.ledger(_table(spark, folder, "documents"))
    base, standard = (op4_quality_rules.passes(p) for p in (op4_quality_rules.BASE, op4_quality_rules.STANDARD))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~base).alias("base_failed"), (base & standard).alias("kept"), "failures"
    )


def sentence_spans(spark: SparkSession, folder: str) -> DataFrame:
    rows = op5_sentence_spans.without_repeats(_table(spark, folder, "documents"))
    return rows.select("doc_id", "text", "n_units_removed")


def byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    rows = op6_byte_bpe.encode(_table(spark, folder, "documents"), default_tokenizer(BPE_MULTI), decoded=True)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def token_files(spark: SparkSession, folder: str) -> DataFrame:
    place = shared_folder(spark, "tokens")
    index = op7_token_files.write_token_files(_table(spark, folder, "documents"), place, default_tokenizer(BPE_50K), end_id=2)
    return op7_token_files.read_token_files(index, place, with_ids=False)


def jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return op8_jaccard_join.similar_documents(_table(spark, folder, "documents"))


def packing(spark: SparkSession, folder: str) -> DataFrame:
    return op9_packing.pack(_table(spark, folder, "documents"), default_tokenizer(BPE_50K), end_id=1)


def metric_search(spark: SparkSession, folder: str) -> DataFrame:
    return op10_metric_search.top_k(_table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


def whitening(spark: SparkSession, folder: str) -> DataFrame:
    rows = op11_whitening.whiten(_table(spark, folder, "embeddings"))
    return rows.withColumn("deviation", F.col("deviation").cast("long"))


def quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    rows = op12_quality_classifier.score(docs, op12_quality_classifier.fit(docs, _table(spark, folder, "labels")))
    return rows.select("doc_id", op12_quality_classifier.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "margin")


def hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return op13_hard_negatives.hard_negatives(_table(spark, folder, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


QUERIES = {
    "op1_toxicity": toxicity,
    "op2_token_counts": token_counts,
    "op3_warc": warc,
    "op4_quality_rules": quality_rules,
    "op5_sentence_spans": sentence_spans,
    "op6_byte_bpe": byte_bpe,
    "op7_token_files": token_files,
    "op8_jaccard_join": jaccard_join,
    "op9_packing": packing,
    "op10_metric_search": metric_search,
    "op11_whitening": whitening,
    "op12_quality_classifier": quality_classifier,
    "op13_hard_negatives": hard_negatives,
}

#: Words of a text, and 5-word windows that occur twice or more in it.
_QUALITY = r"""
WITH words AS (
  SELECT doc_id, text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, i, list_slice(words, i, i + 4) AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM words)),
twice AS (SELECT doc_id, w FROM windows GROUP BY doc_id, w HAVING count(*) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(range(i, i + 5)) AS p FROM windows JOIN twice USING (doc_id, w)) GROUP BY doc_id),
measures AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
    length(regexp_replace(coalesce(text, ''), '[^A-Z]', '', 'g')) AS n_capitals
  FROM words w LEFT JOIN covered c USING (doc_id)),
bits AS (
  SELECT *, CAST(
    CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 8 ELSE 0 END
    + CASE WHEN 2 * n_capitals > word_chars AND word_chars > 0 THEN 16 ELSE 0 END
    + CASE WHEN 2 * n_dup_lines > n_lines THEN 32 ELSE 0 END AS BIGINT) AS failures
  FROM measures)
"""

_SEARCH = """
WITH valid AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND vec_id IS NOT NULL),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM valid q JOIN valid c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""

_NEGATIVES = """
WITH valid AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND label IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike,
    CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i])) AS BIGINT) AS score
  FROM valid a JOIN valid c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.v) = len(c.v)),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
ranked AS (
  SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM positives p JOIN scores s ON p.anchor_id = s.anchor_id AND NOT s.alike
    AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
"""

ORACLES = {
    "op4_quality_rules": _QUALITY
    + "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & 3 <> 0 AS base_failed, failures = 0 AS kept, failures FROM bits",
    "op10_metric_search": _SEARCH,
    "op13_hard_negatives": _NEGATIVES,
}
