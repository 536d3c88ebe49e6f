"""A pipeline over ``documents``: quality rules, toxicity, near duplicates, repeated passages, packing.

Counts as a part of the subpackage ``llm``.  Each stage takes what its predecessor kept and
returns the columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import op1_toxicity, op4_quality_rules, op5_sentence_spans, op8_jaccard_join, op9_packing
from llm.common import shared_folder, stored
from llm.pretokens import default_tokenizer
from llm.queries import BPE_50K


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the standard policy of the rule ledger."""
    return op4_quality_rules.passing(docs, op4_quality_rules.STANDARD)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic."""
    model = op1_toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return op1_toxicity.without_toxic(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of similar ones: the smallest by id (null ids first), then by a hash of the row.

    Texts without words all stay.  Of rows equal in every column one stays.
    """
    names = docs.columns
    # columns as c0, c1, ...: names may clash with those used here
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])
    who, what = f"c{names.index('doc_id')}", f"c{names.index('text')}"
    rows = rows.withColumn("row", F.struct(F.col(who).alias("id"), F.xxhash64(*rows.columns).alias("tie")))
    folder = shared_folder(spark, "near-duplicates")
    groups = op8_jaccard_join.similar_documents(rows.select("row", F.col(what).alias("text")), "row").where("n_shingles > 0")
    groups = stored(groups.groupBy("row", "component_id").agg(F.count(F.lit(1)).alias("copies")), folder, "groups")
    # rows that go, and rows of which one of several equal ones stays
    marks = groups.where("row <> component_id OR copies > 1").select(F.col("row").alias("marked"), (F.col("row") != F.col("component_id")).alias("goes"))
    same = F.col("row.id").eqNullSafe(F.col("marked.id")) & (F.col("row.tie") == F.col("marked.tie"))
    joined = rows.join(marks, same, "left")
    kept = joined.where("marked IS NULL").select(*rows.columns)
    one = joined.where("NOT goes").select(*rows.columns).dropDuplicates(["row"])
    return kept.union(one).drop("row").toDF(*names)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated sentence spans; those of which nothing is left go."""
    rows = op5_sentence_spans.without_repeats(docs)
    rows = rows.where("n_units_removed = 0 OR text <> ''")
    changed = F.when(F.col("n_units_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return rows.withColumn("n_chars", changed).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences that follow the mixture of sources."""
    return op9_packing.pack(docs, default_tokenizer(BPE_50K), end_id=1)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", packing),
]

#: Toxicity is a trained model, which SQL cannot express; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored in the shared folder before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stored(docs, folder, name)
    return docs
