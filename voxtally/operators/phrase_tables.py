"""Phrase tables of any size: which phrases does a text contain?

A rule set of some hundred phrases is a pattern inside the plan.  A table of many is an inverted
index: each phrase is filed under the rarest of its runs of ``GRAM`` characters (``SHORT_GRAM`` in shorter
phrases), rarest among the phrases of the table.  Texts send their distinct runs, one join on the run finds
the candidates, and each text tests only its own candidates with ``contains``.  No text
meets a phrase with which it does not share a run, and nothing is compared pair by pair.

Of a large table only those phrases are kept of which all runs lie in some text.  Beyond the size of a broadcast they are filed
under the hash of the whole phrase, and texts send only pieces that are filed: maps tell both where rows are read (see ``run_maps``).

Runs of a text are sent without the text; candidates come back as one array per text, which holds no
more than what its own runs are filed under.  The index is broadcast where its measured
size allows, and a table of few phrases becomes part of the plan.  A frequent run is a hot key of the join, which adaptive execution splits.

Phrases are searched as substrings, ignoring case, as everywhere else.  Null and empty phrases match
nothing, of phrases that differ in case only one remains (in lower case), and a null text contains nothing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtally.fixed_values import POSITIVE_OVERRIDES, REVIEW_GROUP_WEIGHTS
from voxtally.functions.common import and_all, let, string_array, strip, text_or_empty
from voxtally.functions.hybrid import group_mean
from voxtally.functions.keywords import any_of, distinct_spellings
from voxtally.operators import run_maps
from voxtally.operators.lookups import BROADCAST_BYTES, measured_bytes
from voxtally.operators.polarity import LITERAL_BYTES
from voxtally.session import cut_lineage, shared_path

#: Characters of a run, and of one in phrases that are shorter; still shorter ones are filed under themselves.
GRAM, SHORT_GRAM = 8, 4
#: Bytes that a row of a broadcast index takes beside its text: its fields, its place in the hash table and the table's spare places.
ROW_BYTES = 96
#: Phrases of a table that go into the plan as literals; a text is then searched where it is.
FEW_PHRASES = 256
#: Characters of a long text that are cut into runs at a time, as finding a place in a text takes time in proportion to the place.
SLAB = 4096


def _runs(text: Column, size: int) -> Column:
    """All runs of ``size`` characters, overlapping."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))


def _known(phrases: DataFrame, phrase: str = "phrase") -> DataFrame:
    """Each distinct phrase in lower case."""
    return phrases.select(F.lower(F.col(phrase).cast("string")).alias("phrase")).where(F.octet_length("phrase") > 0).distinct()


def phrase_index(phrases: DataFrame, phrase: str = "phrase") -> DataFrame:
    """``(gram, phrase)``: each distinct phrase in lower case, under the run that fewest phrases share."""
    known = _known(phrases, phrase)
    own = F.when(F.length("phrase") < SHORT_GRAM, F.array("phrase"))
    own = own.when(F.length("phrase") < GRAM, F.array_distinct(_runs(F.col("phrase"), SHORT_GRAM)))
    own = own.otherwise(F.array_distinct(_runs(F.col("phrase"), GRAM)))
    filed = known.select("phrase", F.explode(own).alias("gram"))
    shared = filed.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = F.min(F.struct("n", "gram"))
    return filed.join(shared, "gram").groupBy("phrase").agg(rarest.alias("least")).select(F.col("least.gram").alias("gram"), "phrase")


def _text_runs(df: DataFrame, row_key: Sequence[str], text: str, sizes: Sequence[int]) -> DataFrame:
    """``(row_key, gram)``: the runs of each text that an index with runs of these sizes can hold."""

    def slabs(low: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.length(low) - 1, F.lit(0)), F.lit(SLAB))
        return F.transform(starts, lambda start: F.substring(low, start + 1, F.lit(SLAB + GRAM - 1)))

    cut = df.select(*row_key, F.explode(let(F.lower(text_or_empty(F.col(text))), slabs)).alias("_slab"))
    runs = F.array_distinct(F.flatten(F.array(*[_runs(F.col("_slab"), size) for size in sizes])))
    return cut.select(*row_key, F.explode(runs).alias("gram"))


def _is_large(phrases: DataFrame, limit: int) -> bool:
    """Whether a table seems to take more than ``limit`` bytes, by the plan's estimate, else by a look at its first rows."""
    size = int(phrases._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size < 1 << 60:
        return size > limit
    # the estimate of a table that Spark knows nothing about is the largest number
    rows = limit // ROW_BYTES
    return phrases.select(F.lit(1)).limit(rows + 1).count() > rows


def _filed(df: DataFrame, phrases: DataFrame, text: str) -> DataFrame:
    """``(head, size, phrase)``: the distinct phrases, in lower case, that may lie in some text of ``df``, stored."""
    spark = df.sparkSession
    texts = df.select(F.lower(text_or_empty(F.col(text))).alias("text"))
    bits = run_maps.bits_for(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    marks = spark.sparkContext.broadcast(run_maps.runs_of_texts(texts, "text", bits))
    lowered = phrases.select(F.lower(F.col("phrase").cast("string")).alias("phrase")).where(F.octet_length("phrase") > 0)
    path = shared_path(spark, "phrases")
    known = run_maps.filed(lowered, "phrase", marks, bits).select("phrase").distinct()  # hashes are as long as phrases and do not compress
    run_maps.filed(known, "phrase", marks, bits).write.option("compression", "zstd").parquet(path)
    marks.destroy()
    return spark.read.schema("head bigint, size int, phrase string").parquet(path)


def _pieces_met(df: DataFrame, keys: list[str], text: str, known: DataFrame, n: int, sizes: list[int]) -> DataFrame:
    """``(keys, phrase)``: phrases of ``known``, ``n`` in number and filed under pieces of these sizes, that a text seems to contain."""
    bits = run_maps.bits_for(4 * n)
    marks = df.sparkSession.sparkContext.broadcast(run_maps.heads_of(known, bits))
    lowered = df.select(*keys, F.lower(text_or_empty(F.col(text))).alias("_text"))
    found = run_maps.marked_pieces(lowered, keys, "_text", sizes, marks, bits).join(known.select("head", "phrase"), "head")
    # dealt by key before sets are made: a set of one takes several times the row
    return found.select(*keys, "phrase").repartition(*keys)


def with_phrases(
    df: DataFrame, row_key: str | Sequence[str], text: str, phrases: DataFrame, name: str = "phrases", max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """``df`` with the array of all phrases (lower case, ascending) that its text contains.

    ``row_key`` names the columns that identify a row; ``phrases`` has a column ``phrase``.
    """
    keys = [row_key] if isinstance(row_key, str) else list(row_key)
    empty = F.array().cast("array<string>")
    size = F.octet_length("phrase") + ROW_BYTES
    if _is_large(phrases, min(max_bytes, LITERAL_BYTES)):
        known = _filed(df, phrases, text)
        facts = known.agg(F.collect_set("size").alias("sizes"), F.count(F.lit(1)).alias("n"), F.sum((size + GRAM).cast("long")).alias("bytes")).first()
        if facts["n"] and facts["bytes"] > max_bytes:
            return _with_found(df, keys, text, _pieces_met(df, keys, text, known, facts["n"], sorted(facts["sizes"])), name)
        phrases = known
    index = cut_lineage(phrase_index(phrases))  # measured, then joined
    # sizes of the runs (GRAM at most), number of phrases and bytes of the index, in one job
    size = F.octet_length("gram") + size
    facts = index.agg(F.collect_set(F.length("gram")).alias("sizes"), F.count(F.lit(1)).alias("n"), F.sum(size.cast("long")).alias("bytes")).first()
    sizes = sorted(facts["sizes"])
    if not sizes:
        return df.withColumn(name, empty)
    if facts["n"] <= FEW_PHRASES and facts["bytes"] <= min(max_bytes, LITERAL_BYTES):
        few = [row.phrase for row in index.select("phrase").sort("phrase").collect()]
        own = let(F.lower(text_or_empty(F.col(text))), lambda low: F.filter(string_array(few), lambda phrase: F.contains(low, phrase)))
        # as in a join, a row without a key finds nothing
        return df.withColumn(name, F.when(and_all([F.col(key).isNotNull() for key in keys]), own).otherwise(empty))
    if facts["bytes"] <= max_bytes:
        index = F.broadcast(index)
    return _with_found(df, keys, text, _text_runs(df, keys, text, sizes).join(index, "gram"), name)


def _with_found(df: DataFrame, keys: list[str], text: str, found: DataFrame, name: str) -> DataFrame:
    """``df`` with those of the candidates ``(keys, phrase)`` of each text that it contains."""
    candidates = found.groupBy(*keys).agg(F.collect_set("phrase").alias("_candidates"))
    contained = let(
        F.lower(text_or_empty(F.col(text))),
        lambda low: F.array_sort(F.filter("_candidates", lambda phrase: F.contains(low, phrase))),
    )
    joined = df.join(candidates, keys, "left")
    empty = F.array().cast("array<string>")
    return joined.withColumn(name, F.coalesce(F.when(F.col("_candidates").isNotNull(), contained), empty)).drop("_candidates")


def keywords_by_table(
    df: DataFrame, row_key: str | Sequence[str], text: str, phrases: DataFrame, name: str = "keywords", max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """``df`` with the keywords of each text, as ``keywords_in`` finds them, from a table of phrases.

    The pattern of a row holds the phrases that its own text contains, longest first.
    """

    matched = with_phrases(df, row_key, text, phrases, "_phrases", max_bytes)
    hits = F.regexp_extract_all(text_or_empty(F.col(text)), any_of(F.col("_phrases")), F.lit(0))
    found = F.when(F.size("_phrases") > 0, let(hits, distinct_spellings))
    return matched.withColumn(name, F.coalesce(found, F.array().cast("array<string>"))).drop("_phrases")


def phrase_group_counts(
    df: DataFrame, row_key: str | Sequence[str], text: str, groups: DataFrame, name: str = "group_counts", max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """``df`` with a map from group to the number of its phrases in the text, each counted once.

    ``groups`` is ``(grp, phrase)``, e.g. the tiers of a rule set; groups without a phrase in the text are absent.
    """
    keys = [row_key] if isinstance(row_key, str) else list(row_key)
    known = groups.select("grp", F.lower(F.col("phrase").cast("string")).alias("_phrase")).distinct()
    if measured_bytes(known) <= max_bytes:
        known = F.broadcast(known)
    hits = with_phrases(df.select(*keys, text), keys, text, groups, "_phrases", max_bytes).select(*keys, F.explode("_phrases").alias("_phrase"))
    counts = hits.join(known, "_phrase").groupBy(*keys, "grp").agg(F.count(F.lit(1)).cast("int").alias("n"))
    maps = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("grp", "n"))).alias(name))  # a row a group
    return df.join(maps, keys, "left").withColumn(name, F.coalesce(name, F.create_map().cast("map<string,int>")))


def group_score_by_table(
    df: DataFrame,
    row_key: str | Sequence[str],
    text: str,
    groups: DataFrame,
    weights: Mapping[str, float] = REVIEW_GROUP_WEIGHTS,
    overrides: Sequence[Sequence[Sequence[str]]] = POSITIVE_OVERRIDES,
    name: str = "keyword",
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``df`` with ``keyword_group_score`` where the groups are a table ``(grp, phrase)``."""
    stripped = df.withColumn("_stripped", strip(text_or_empty(F.col(text))))
    counted = phrase_group_counts(stripped, row_key, "_stripped", groups, "_counts", max_bytes)
    counts = [F.coalesce(F.try_element_at("_counts", F.lit(group)), F.lit(0)) for group in weights]
    score = let(F.lower("_stripped"), lambda lowered: group_mean(lowered, counts, weights, overrides))
    return counted.withColumn(name, score).drop("_counts", "_stripped")
