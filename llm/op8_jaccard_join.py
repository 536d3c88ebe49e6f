"""N-gram Jaccard join by grouped prefixes.

A text is its set of distinct word shingles.  Two sets with a Jaccard similarity of at
least 3/4 share a token within the first ``size // 4 + 1`` tokens of either, under any order
of tokens that is the same for all.  The order here: tokens that occur once in the corpus
first, then repeated ones, then very frequent ones, each by hash.  So a text that shares
little with others has a prefix of tokens that nobody else has, and meets nobody.

Texts with equal sets are one node.  Nodes with identical prefixes and size are one group;
groups that share a prefix token are filtered by size, then expanded and verified.  Of a
group or token with many members not every pair is needed: each is tested with a leader
first, for a few rounds of leaders; only pairs that these links have not yet joined into one
component go on, each of them verified.  No pair is dropped: a pair that is not tested
has both ends in one component already.

How often tokens occur is counted over the whole corpus in slots of their hashes (see
``llm.slots``) and broadcast as two bit maps of at most 32 MB each; of larger corpora the maps have more slots and lie in
the shared folder.  Tokens that share a slot make the order coarser, never a result wrong.

Contract: null text and text without words is empty, has size 0 and is linked with nothing.
Ids may be null or repeat: rows stand for themselves, the smallest id names the component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import arrow_strings, blocks, discard, released, shared_folder, stored
from llm.components import components
from llm.pretokens import mixed
from llm.slots import AT_ONCE, FILED_BITS, MOST_BITS, FiledMaps, filed_maps, has, slot_bits, slot_maps, slots_of
from llm.words import shingle_sets

#: Rounds of leaders before all pairs that are still apart are tested.
ROUNDS = 1
#: Nodes of a chunk where what is still apart is compared.
CHUNK = 1024
#: Buckets of the upper bound on an overlap, at least and at most: as many as a quarter of the set, as with
#: many tokens in each bucket the bound tells nothing.
SKETCH, LONG_SKETCH = 256, 1 << 15
#: Bytes of text handled at once.
BLOCK = 1 << 20


def needed(a: int, b: int) -> int:
    """The least overlap of sets of these sizes: 100 * overlap >= 75 * union."""
    return -(-3 * (a + b) // 7)


def sketch(tokens: np.ndarray) -> bytes:
    """How many tokens fall in each bucket, the last value standing for that many or more.

    The number of buckets is a power of two that follows the size of the set.
    """
    buckets = SKETCH
    while buckets < LONG_SKETCH and 4 * buckets < len(tokens):
        buckets *= 2
    return np.minimum(np.bincount((tokens & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets), 255).astype(np.uint8).tobytes()


def folded(sketches: np.ndarray, buckets: int) -> np.ndarray:
    """The same sketches, one in a row, with this smaller number of buckets."""
    if sketches.shape[1] == buckets:
        return sketches
    parts = sketches.reshape(len(sketches), -1, buckets)
    return np.where((parts == 255).any(1), 255, np.minimum(parts.sum(1, dtype=np.int64), 255)).astype(np.uint8)


def may_overlap(one: np.ndarray, two: np.ndarray, n_one, n_two) -> np.ndarray:
    """Whether sets of these sketches, one in a row, and sizes can be similar enough; never False where they are."""
    buckets = min(one.shape[1], two.shape[1])
    both = np.minimum(folded(one, buckets), folded(two, buckets))
    return (both.sum(1, dtype=np.int64) >= -(-3 * (n_one + n_two) // 7)) | (both == 255).any(1)


def by_buckets(sketches: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The places of the sketches with equal numbers of buckets, and these sketches, one in a row."""
    lengths = np.array([len(x) for x in sketches], np.int64)
    out = []
    for length in np.unique(lengths).tolist():
        places = np.flatnonzero(lengths == length)
        out.append((places, np.frombuffer(b"".join(sketches[i] for i in places.tolist()), np.uint8).reshape(-1, length)))
    return out


def prefixes(texts: DataFrame, maps: Broadcast | FiledMaps, bits: int, size: int) -> DataFrame:
    """``row_id, n, node, grp, tokens, held, sketch, rare`` of each text, in one pass.

    ``node`` stands for the set, ``grp`` for prefix and size.  ``tokens`` are the repeated tokens of the
    prefix under the slot ``maps``; the set itself (``held``) and its sketch are kept only where there are any, and ``rare``,
    the share of its tokens that occur once.
    """
    def kinds_of(tokens):
        if isinstance(maps, FiledMaps):
            return maps.kinds(tokens)
        slots = slots_of(tokens, bits)
        return has(maps.value[0], slots) + has(maps.value[1], slots)

    def gathered(batches):
        """Blocks with their sets and the kinds of their tokens; maps in pieces are read once for many blocks."""
        waiting, least = [], AT_ONCE if isinstance(maps, FiledMaps) else 0
        for table in blocks(batches, BLOCK):
            waiting.append((table.column("row_id"), *shingle_sets(*arrow_strings(table.column("text")), size)))
            if sum(len(tokens) for _, tokens, _ in waiting) >= least:
                yield waiting
                waiting = []
        if waiting:
            yield waiting

    def with_kinds(batches):
        for some in gathered(batches):
            kinds = np.split(kinds_of(np.concatenate([tokens for _, tokens, _ in some])), np.cumsum([len(tokens) for _, tokens, _ in some])[:-1])
            yield from ((*one, kind) for one, kind in zip(some, kinds, strict=True))

    def run(batches):
        for ids, tokens, bounds, kind in with_kinds(batches):
            rows = []
            for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                count = end - start
                if not count:
                    rows.append((0, None, None, [], None, None, None))
                    continue
                own, kinds = tokens[start:end], kind[start:end]
                order = np.argsort(kinds, kind="stable")[: count // 4 + 1]
                prefix = own[order]
                sent = prefix[kinds[order] > 0]
                with np.errstate(over="ignore"):
                    node = np.array([own.sum(), mixed(own ^ np.uint64(0x5BD1E995)).sum()], ">u8").tobytes()
                    group = np.array([prefix.sum(), mixed(prefix ^ np.uint64(0x5BD1E995)).sum() + np.uint64(count)], ">u8").tobytes()
                any_ = len(sent) > 0
                rows.append((count, node, group, sent.view(np.int64), own.tobytes() if any_ else None, sketch(own) if any_ else None, float((kinds == 0).mean())))
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.float64())
            columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([ids.combine_chunks(), *columns], ["row_id", "n", "node", "grp", "tokens", "held", "sketch", "rare"])

    kind = texts.schema["row_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"row_id {kind}, n bigint, node binary, grp binary, tokens array<bigint>, held binary, sketch binary, rare double")


def verified(pairs: DataFrame, sets: DataFrame, folder: str, name: str) -> DataFrame:
    """The pairs ``a, b`` of nodes whose sets are similar enough, by the sketches first, then by the sets."""

    def likely(batches):
        for batch in batches:
            n_a, n_b = (batch.column(x).to_numpy() for x in ("n_a", "n_b"))
            if not len(n_a):
                continue
            keep = np.zeros(len(n_a), bool)
            first, second = (batch.column(x).to_pylist() for x in ("sketch_a", "sketch_b"))
            for places, one in by_buckets(first):
                for own, two in by_buckets([second[i] for i in places.tolist()]):
                    at = places[own]
                    keep[at] = may_overlap(one[own], two, n_a[at], n_b[at])
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], ["a", "b"])

    def similar(batches):
        for batch in batches:
            keep = []
            for one, two in zip(batch.column("held_a"), batch.column("held_b"), strict=True):
                one, two = (np.frombuffer(x.as_buffer(), np.uint64) for x in (one, two))
                overlap = len(one) + len(two) - len(np.union1d(one, two))
                keep.append(overlap >= needed(len(one), len(two)))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    def of(end: str, *columns: str) -> DataFrame:
        return sets.select(F.col("node").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns])

    sized = pairs.join(of("a", "n", "sketch"), "a").join(of("b", "n", "sketch"), "b").where("4 * least(n_a, n_b) >= 3 * greatest(n_a, n_b)")
    left = sized.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(likely, "a binary, b binary")
    full = stored(left, folder, f"{name}-likely").join(of("a", "held"), "a").join(of("b", "held"), "b")
    return stored(full.select("a", "b", "held_a", "held_b").mapInArrow(similar, "a binary, b binary"), folder, name)


def _ordered(one: str, two: str) -> list:
    return [F.least(one, two).alias("a"), F.greatest(one, two).alias("b")]


def _links_apart(posted: DataFrame, sets: DataFrame, named: DataFrame, apart: DataFrame, within: DataFrame, folder: str) -> DataFrame:
    """Candidate pairs ``a, b`` of different components among nodes that meet in tokens or groups still apart.

    Nodes that such tokens and groups tie together form an area; nodes of different areas share no
    prefix token.  An area is dealt in chunks, and every two chunks of it meet in one row group, where
    sizes and sketches rule out pairs before any row is made of them.
    """
    met = posted.join(apart.select("token", F.col("lead.node").alias("a")), "token").select("grp", "a").union(within.select("grp", F.col("lead.node").alias("a"))).distinct()
    ties = met.join(named, "grp").where("a <> node").select(*_ordered("a", "node"))
    ties = stored(ties.distinct(), folder, "ties")
    areas = stored(components(ties, folder, "areas"), folder, "area-labels")
    areas = areas.union(areas.select(F.col("label").alias("node"), "label").distinct()).withColumnRenamed("label", "area")
    rows = areas.join(named.select("node", "label"), "node").join(sets.select("node", "n", "sketch"), "node")
    counts = areas.groupBy("area").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    rows = rows.join(counts, "area").withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    # chunk i meets chunk j >= i in the row group (area, i, j); its row goes to each of them
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    rows = rows.withColumn("other", other).select("area", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("own"), "node", "label", "n", "sketch")

    def compare(key, table):
        own = table.column("own").to_numpy()
        nodes, sizes = table.column("node").to_pylist(), table.column("n").to_numpy()
        _, labels = np.unique(np.array(table.column("label").to_pylist(), object), return_inverse=True)
        held = table.column("sketch").to_pylist()
        kinds = by_buckets(held)
        kind, row = np.zeros(len(held), np.int64), np.zeros(len(held), np.int64)
        for number, (places, _) in enumerate(kinds):
            kind[places], row[places] = number, np.arange(len(places))
        first = np.flatnonzero(own == key[1].as_py())
        second = np.flatnonzero(own == key[2].as_py())
        alone = key[1].as_py() == key[2].as_py()
        out: list[tuple[bytes, bytes]] = []
        for place, i in enumerate(first.tolist()):
            rest = second[place + 1 :] if alone else second
            small, large = np.minimum(sizes[rest], sizes[i]), np.maximum(sizes[rest], sizes[i])
            rest = rest[(labels[rest] != labels[i]) & (4 * small >= 3 * large)]
            mine = kinds[kind[i]][1][row[i] : row[i] + 1]
            for number in np.unique(kind[rest]).tolist():
                near = rest[kind[rest] == number]
                near = near[may_overlap(kinds[number][1][row[near]], mine, sizes[near], sizes[i])]
                out += [(min(nodes[i], nodes[j]), max(nodes[i], nodes[j])) for j in near.tolist()]
        return pa.table({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([x for _, x in out], pa.binary())})

    return rows.groupBy("area", "i", "j").applyInArrow(compare, "a binary, b binary")


def similar_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 5, held_bits: int = MOST_BITS) -> DataFrame:
    """``id_column, n_shingles, component_id`` of each row: its set's size and the smallest id reachable by links.

    Maps of more than ``2**held_bits`` slots are not broadcast.
    """
    spark = docs.sparkSession
    shared = shared_folder(spark, "jaccard")
    folder = f"{shared}/work"  # gone when the labels are known
    texts = docs.select(F.col(f"`{id_column}`").alias("row_id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    bits = slot_bits(texts, FILED_BITS)

    def tokens_of(data, offsets):
        return shingle_sets(data, offsets, size)[0]

    if bits > held_bits:
        maps = filed_maps(texts, bits, tokens_of, f"{folder}/maps")
    else:
        maps = spark.sparkContext.broadcast(slot_maps(texts, bits, tokens_of))
    released(spark)
    rows = stored(prefixes(texts, maps, bits, size), folder, "rows")
    if isinstance(maps, FiledMaps):
        discard(spark, maps.folder)
    else:
        maps.destroy()
    # one row for each set that may meet another
    sets = rows.where("held IS NOT NULL").select("node", "n", "grp", "tokens", "held", "sketch", "rare").dropDuplicates(["node"])
    sets = stored(sets, folder, "sets")
    ids = stored(rows.select("row_id", "n", "node"), shared, "ids")
    discard(spark, f"{folder}/rows.parquet")  # the sets a second time
    released(spark)
    nodes = sets.select("node", "grp", "n", "rare")
    groups = sets.dropDuplicates(["grp"]).select("grp", F.explode("tokens").alias("token"))
    several = groups.groupBy("token").agg(F.min("grp").alias("least"), F.max("grp").alias("most")).where("least < most").select("token")
    posted = stored(groups.join(several, "token").select("token", "grp"), folder, "tokens")
    links = None
    labels = nodes.select("node", F.col("node").alias("label")).limit(0)
    for turn in range(ROUNDS + 1):
        # the first leaders are the sets with the smallest share of tokens of their own: they have most links
        rank = F.struct("rare", "node") if not turn else F.struct(F.xxhash64("node", F.lit(turn)), "node")
        named = nodes.join(labels, "node", "left").select("node", "grp", "n", F.coalesce("label", "node").alias("label"), rank.alias("rank"))
        named = stored(named, folder, f"named-{turn}")
        # tokens whose texts are not all in one component yet, and groups alike
        spread = named.groupBy("grp").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min(F.struct("rank", "node", "label", "n")).alias("lead"))
        spread = stored(spread, folder, f"spread-{turn}")
        by_token = posted.join(spread, "grp")
        apart = by_token.groupBy("token").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("lead").alias("lead")).where("low < high").drop("low", "high")
        apart = stored(apart, folder, f"apart-{turn}")
        within = spread.where("low < high").select("grp", "lead")
        if turn < ROUNDS:
            near = "lead.label <> label AND 4 * least(lead.n, n) >= 3 * greatest(lead.n, n)"
            met = posted.join(apart, "token").select("grp", "lead").union(within).distinct()
            pairs = met.join(named, "grp").where(near).select(*_ordered("lead.node", "node")).distinct()
        else:
            pairs = _links_apart(posted, sets, named, apart, within, folder)
        found = verified(stored(pairs, folder, f"pairs-{turn}"), sets, folder, f"links-{turn}")
        links = found if links is None else links.union(found)
        labels = stored(components(links, folder, f"stars-{turn}"), folder, f"labels-{turn}")
        released(spark)
    labels = stored(labels, shared, "labels")
    discard(spark, folder)
    known = ids.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = known.where("label IS NOT NULL").groupBy("label").agg(F.min("row_id").alias("least"))
    out = known.join(least, "label", "left")
    return out.select(F.col("row_id").alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("least", "row_id").alias("component_id"))
