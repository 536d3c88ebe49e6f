"""Hard negatives by cover trees over norm-augmented vectors.

Vectors become integers.  Within a tree each gets one more component that brings all of
them to the same length, so that an inner product with an anchor falls as the Euclidean distance
grows, and a ball around a vector bounds it from both sides.  A tree is a cover tree: the
centres of a level are chosen farthest first, their parent's centre being the first, so they
are nested, lie at least the level's covering radius apart and cover all vectors of their
parent within it.  Rows of a node lie together; leaves are pages of rows.

An anchor asks for the best scores within windows ``low <= score <= high``.  One best-first
descent serves all windows of an anchor: a node is skipped when for each window its scores lie
outside it or below what is already known to be enough; leaves compute exact integer scores.
The same descent finds the positives, whose window is open.

Rows are dealt to trees by their nearest pivot, ranges of pivots and ids, so that trees hold
neighbours and a hot pivot is many trees.  Each tree is stored once with its nodes.  Anchors first
ask the tree they lie in, which gives a floor; then they are sent to those trees whose root ball
can beat it.  Only the best of each anchor, window and tree are sent on.

Contract: rows whose label or vector is null or empty, or whose vector holds null or non-finite
components, take no part; nor do rows without an id.  Vectors are compared with those of
their own number of components.  An anchor never meets rows with its own id.  Other rows with
repeated ids count each; ties go to the smaller id.  Anchors equal in id, label and vector ask
once, those that share no more than the id each for themselves.  Scores must fit a long.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.common import shared_folder, stored
from llm.op10_metric_search import scaled

#: Centres of a level at most, and rows of a leaf page; a level has no more centres than give half-filled pages.
FAN, LEAF = 16, 1024
#: Bytes of the vectors of one tree.
TREE_BYTES = 8 << 20
#: Rows by which others are dealt to trees: those with the smallest hashes of their ids.
PIVOTS = 64
#: Bytes of root balls that anchors are tested against before they are sent; above it all trees are asked.
ROOT_BYTES = 32 << 20
LEAST, MOST = -(1 << 62), 1 << 62
#: Integers that products of doubles hold exactly.
EXACT = float(1 << 53)


def built(vectors: np.ndarray) -> dict[str, np.ndarray]:
    """The cover tree of these rows: their ``order``, and for each node its rows ``low:high`` in it, its centre (a place
    in it), covering ``radius`` and children ``first:last``."""
    points = vectors.astype(np.float64)
    norms = (points * points).sum(1)
    top = float(norms.max())
    points = np.column_stack((points, np.sqrt(np.maximum(0, top - norms))))
    # distinct integer vectors are at least 1 apart
    same = max(0.5, 1e-13 * top)

    def apart(rows: np.ndarray, center: int) -> np.ndarray:
        """Squared distances; the augmented vectors all have the length ``top``."""
        return np.maximum(0, 2 * top - 2 * (points[rows] @ points[center]))

    order = np.arange(len(points))
    start = int((points @ points.mean(0)).argmax())
    nodes = [(0, len(points), start, float(apart(order, start).max()))]
    children = []
    number = 0
    while number < len(nodes):
        low, high, center, radius = nodes[number]
        number += 1
        children.append((len(nodes), len(nodes)))
        if high - low <= LEAF or radius < same:
            continue
        rows = order[low:high]
        near, owner = apart(rows, center), np.zeros(high - low, np.int64)
        centers = [center]
        # the level below covers with half the radius (squared: a quarter), or has as many centres as a level may
        while len(centers) < min(FAN, max(2, 2 * (high - low) // LEAF)) and near.max() > max(same, radius / 4):
            center = int(rows[near.argmax()])
            own = apart(rows, center)
            own[rows == center] = 0
            closer = own < near
            owner[closer], near = len(centers), np.minimum(own, near)
            centers.append(center)
        if len(centers) == 1:
            continue
        moved = np.argsort(owner, kind="stable")
        order[low:high] = rows[moved]
        bounds = low + np.searchsorted(owner[moved], np.arange(len(centers) + 1))
        for i, center in enumerate(centers):
            if bounds[i] < bounds[i + 1]:
                nodes.append((int(bounds[i]), int(bounds[i + 1]), center, float(near[owner == i].max())))
        children[-1] = (children[-1][0], len(nodes))
    place = np.empty(len(points), np.int64)
    place[order] = np.arange(len(points))
    low, high, center, radius = (np.array(x) for x in zip(*nodes, strict=True))
    return {"order": order, "low": low, "high": high, "center": place[center], "radius": np.sqrt(radius), "children": np.array(children)}


class CoverTree:
    """A stored tree, for searches."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, spans: np.ndarray, radius: np.ndarray):
        self.ids, self.labels, self.vectors, self.spans, self.radius = ids, labels, vectors, spans, radius
        self.points = vectors.astype(np.float64)
        self.top = float((self.points * self.points).sum(1).max())
        self.centers = self.points[spans[:, 2]]

    def search(self, own_id: int, query: np.ndarray, wanted: np.ndarray, low: np.ndarray, high: np.ndarray, floor: np.ndarray, k: int):
        """For each window the best ``(scores, ids)``, at most ``k``, of the ``wanted`` rows with other ids."""
        point = query.astype(np.float64)
        square = float(point @ point)
        base = square + self.top
        slack = 1e-6 * (1 + np.sqrt(base))
        exact = np.sqrt(square * self.top) < EXACT
        best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in low]
        need = np.maximum(low, floor)
        least, most = ball(base, slack, self.centers[:1] @ point, self.radius[:1])
        heap = [(-float(np.minimum(most[0], high).max()), 0, float(least[0]), float(most[0]))]
        while heap:
            key, number, least, most = heapq.heappop(heap)
            if -key < need.min():
                break
            if not ((most >= need) & (least <= high)).any():
                continue
            first, last, _, begin, end = self.spans[number]
            if begin < end:
                leasts, mosts = ball(base, slack, self.centers[begin:end] @ point, self.radius[begin:end])
                keys = np.minimum(mosts[:, None], high)
                useful = ((mosts[:, None] >= need) & (leasts[:, None] <= high)).any(1)
                for i in np.flatnonzero(useful).tolist():
                    heapq.heappush(heap, (-float(keys[i].max()), int(begin) + i, float(leasts[i]), float(mosts[i])))
                continue
            scores = (self.points[first:last] @ point).astype(np.int64) if exact else self.vectors[first:last] @ query
            keep = wanted[first:last] & (self.ids[first:last] != own_id)
            inside = (scores >= need[:, None]) & (scores <= high[:, None]) & keep
            for w in np.flatnonzero(inside.any(1)).tolist():
                found = np.concatenate((best[w][0], scores[inside[w]]))
                ids = np.concatenate((best[w][1], self.ids[first:last][inside[w]]))
                if len(found) > k:
                    chosen = np.lexsort((ids, -found))[:k]
                    found, ids = found[chosen], ids[chosen]
                best[w] = found, ids
                if len(found) == k:
                    need[w] = max(need[w], int(found.min()))
        return best


def ball(base: float, slack: float, scores: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest score within balls whose centres have these scores; ``base`` is the sum of both squared lengths."""
    away = np.sqrt(np.maximum(0, base - 2 * scores))
    reach = radius + slack
    return (base - (away + reach) ** 2) / 2, (base - np.maximum(0, away - reach) ** 2) / 2


def _lists(column) -> list[np.ndarray]:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.split(flat, np.cumsum(np.array(column.value_lengths()))[:-1]) if len(column) else []


def _dealt(rows: DataFrame) -> DataFrame:
    """The stored rows with ``pivot``, the nearest of a bounded number of pivots."""
    found = rows.select("id", "x").orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect()
    pivots = {}
    for row in found:
        pivots.setdefault(len(row.x), []).append(row.x)
    held = {dim: np.array(x, np.float64) for dim, x in pivots.items()}

    def nearest(batches):
        for batch in batches:
            vectors = _lists(batch.column("x"))
            out = np.zeros(len(vectors), np.int32)
            for dim, own in held.items():
                at = [i for i, v in enumerate(vectors) if len(v) == dim]
                if at:
                    points = np.stack([vectors[i] for i in at]).astype(np.float64)
                    out[at] = ((own * own).sum(1) - 2 * points @ own.T).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "pivot"])

    return rows.mapInArrow(nearest, "id bigint, label bigint, asks boolean, x array<bigint>, pivot int")


def _trees(rows: DataFrame) -> DataFrame:
    """``tree, dim, ids, labels, asks, vectors, spans, radius``, arrays as bytes; ``spans`` are low, high, centre and children."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        waiting: dict[int, list] = {}

        def tree(dim: int, parts: list) -> pa.RecordBatch:
            nonlocal number
            ids, labels, asks, vectors = (np.concatenate(x) for x in zip(*parts, strict=True))
            own = built(vectors)
            spans = np.column_stack((own["low"], own["high"], own["center"], own["children"])).astype(np.int64)
            order = own["order"]
            packed = [ids[order], labels[order], asks[order], vectors[order], spans, own["radius"]]
            number += 1
            columns = [pa.array([number - 1]), pa.array([dim], pa.int32()), *[pa.array([np.ascontiguousarray(x).tobytes()]) for x in packed]]
            return pa.RecordBatch.from_arrays(columns, ["tree", "dim", "ids", "labels", "asks", "vectors", "spans", "radius"])

        for batch in batches:
            ids, labels, asks = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            sizes = np.array(batch.column("x").value_lengths())
            vectors = _lists(batch.column("x"))
            for dim in np.unique(sizes).tolist():
                size = max(LEAF, TREE_BYTES // (8 * dim))
                at = np.flatnonzero(sizes == dim)
                matrix = np.stack([vectors[i] for i in at.tolist()])
                for i in range(0, len(at), size):
                    part = at[i : i + size]
                    parts = waiting.setdefault(dim, [])
                    parts.append((ids[part], labels[part], asks[part], matrix[i : i + size]))
                    if sum(len(x[0]) for x in parts) >= size:
                        yield tree(dim, waiting.pop(dim))
        for dim, parts in waiting.items():
            yield tree(dim, parts)

    return rows.mapInArrow(run, "tree bigint, dim int, ids binary, labels binary, asks binary, vectors binary, spans binary, radius binary")


def _opened(dim, ids, labels, vectors, spans, radius) -> CoverTree:
    whole = [np.frombuffer(x.as_buffer(), np.int64) for x in (ids, labels, vectors, spans)]
    return CoverTree(whole[0], whole[1], whole[2].reshape(-1, dim.as_py()), whole[3].reshape(-1, 5), np.frombuffer(radius.as_buffer(), np.float64))


ANCHOR = "anchor_id bigint, label bigint, x array<bigint>"
ASKED = f"{ANCHOR}, tree bigint, low array<bigint>, high array<bigint>, floor array<bigint>"


def _anchors(trees: DataFrame, positives: int) -> DataFrame:
    """Every anchor with the tree it lies in and its ``positives``-th best score there, which is a floor of its positives."""

    def run(batches):
        for batch in batches:
            for number, dim, ids, labels, asks, vectors, spans, radius in zip(*(batch.column(c) for c in ("tree", "dim", "ids", "labels", "asks", "vectors", "spans", "radius")), strict=True):
                tree = _opened(dim, ids, labels, vectors, spans, radius)
                at = np.flatnonzero(np.frombuffer(asks.as_buffer(), bool))
                floors = []
                for i in at.tolist():
                    least, most = np.array([LEAST]), np.array([MOST])
                    (scores, _), = tree.search(int(tree.ids[i]), tree.vectors[i], tree.labels == tree.labels[i], least, most, least, positives)
                    floors.append([int(scores.min()) if len(scores) == positives else LEAST])
                columns = [pa.array(tree.ids[at]), pa.array(tree.labels[at]), pa.array(list(tree.vectors[at]), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(at), number.as_py())), pa.array(floors, pa.list_(pa.int64()))], ["anchor_id", "label", "x", "tree", "floor"])

    found = trees.mapInArrow(run, f"{ANCHOR}, tree bigint, floor array<bigint>")
    alike = found.groupBy("anchor_id", "label", "x").agg(F.min("tree").alias("tree"), F.max("floor").alias("floor"))
    ends = {name: F.array(F.lit(value).cast("long")).alias(name) for name, value in (("low", LEAST), ("high", MOST))}
    return alike.select("anchor_id", "label", "x", "tree", ends["low"], ends["high"], "floor")


def _roots(trees: DataFrame) -> dict[int, tuple] | None:
    """Root balls by number of components: trees, centres, radii and top lengths; None where they are too many to hold."""
    size = trees.agg(F.sum(F.col("dim") * 8 + 32)).first()[0] or 0
    if size > ROOT_BYTES:
        return None

    def run(batches):
        for batch in batches:
            for number, dim, vectors, spans, radius in zip(*(batch.column(c) for c in ("tree", "dim", "vectors", "spans", "radius")), strict=True):
                points = np.frombuffer(vectors.as_buffer(), np.int64).reshape(-1, dim.as_py()).astype(np.float64)
                center = int(np.frombuffer(spans.as_buffer(), np.int64)[2])
                row = [number.as_py(), float(np.frombuffer(radius.as_buffer(), np.float64)[0]), float((points * points).sum(1).max()), points[center].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["tree", "radius", "top", "center"])

    held: dict[int, list] = {}
    for row in trees.mapInArrow(run, "tree bigint, radius double, top double, center array<double>").collect():  # ROOT_BYTES
        held.setdefault(len(row.center), []).append(row)
    return {dim: tuple(np.array([r[c] for r in rows]) for c in ("tree", "center", "radius", "top")) for dim, rows in held.items()}


def _everywhere(asked: DataFrame, trees: DataFrame, roots: dict[int, tuple] | None) -> DataFrame:
    """A row of each anchor for each tree that can hold what it asks for."""
    if roots is None:
        of = trees.select("dim", F.col("tree").alias("other"))
        return asked.withColumn("dim", F.size("x")).join(of, "dim").withColumn("tree", F.col("other")).drop("dim", "other")
    held = asked.sparkSession.sparkContext.broadcast(roots)

    def run(batches):
        for batch in batches:
            out = []
            for vector, low, high, floor in zip(*(_lists(batch.column(c)) for c in ("x", "low", "high", "floor")), strict=True):
                numbers, centers, radius, top = held.value[len(vector)]
                point = vector.astype(np.float64)
                base = point @ point + top
                least, most = ball(base, 1e-6 * (1 + np.sqrt(base)), centers @ point, radius)
                useful = ((most[:, None] >= np.maximum(low, floor)) & (least[:, None] <= high)).any(1)
                out.append(numbers[useful])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int64()))], [*batch.schema.names, "others"])

    sent = asked.mapInArrow(run, f"{ASKED}, others array<bigint>")
    return sent.withColumn("tree", F.explode("others")).drop("others")


def _searched(asked: DataFrame, trees: DataFrame, k: int, same_label: bool) -> DataFrame:
    """The ``k`` best of each anchor and window over the trees it is sent to; ``place`` is the window's."""
    empty = [F.lit(None).cast(kind).alias(name) for name, kind in (("anchor_id", "bigint"), ("label", "bigint"), ("x", "array<bigint>"), ("low", "array<bigint>"), ("high", "array<bigint>"), ("floor", "array<bigint>"))]
    parts = ("dim", "ids", "labels", "vectors", "spans", "radius")
    none = [F.lit(None).cast("int" if name == "dim" else "binary").alias(name) for name in parts]
    held = trees.select("tree", F.lit(0).alias("kind"), *parts, *empty)
    sent = asked.select("tree", F.lit(1).alias("kind"), *none, "anchor_id", "label", "x", "low", "high", "floor")
    number = trees.agg(F.count(F.lit(1))).first()[0]
    both = held.unionByName(sent).repartition(max(1, number), "tree").sortWithinPartitions("tree", "kind")

    def run(batches):
        tree = None
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            at = {name: batch.column(name) for name in (*parts, "anchor_id", "label", "x", "low", "high", "floor")}
            rows: list[list[np.ndarray]] = []
            for i, kind in enumerate(kinds.tolist()):
                if not kind:
                    tree = _opened(*(at[name][i] for name in parts))
                    masks: dict[int, np.ndarray] = {}
                    continue
                label, own = at["label"][i].as_py(), at["anchor_id"][i].as_py()
                vector, low, high, floor = (at[name][i].values.to_numpy(zero_copy_only=False) for name in ("x", "low", "high", "floor"))
                if label not in masks:
                    masks = {label: tree.labels == label if same_label else tree.labels != label}
                for place, (scores, ids) in enumerate(tree.search(own, vector, masks[label], low, high, floor, k)):
                    if len(ids):
                        rows.append([np.full(len(ids), own), np.full(len(ids), label), np.full(len(ids), i), np.full(len(ids), place), scores, ids])
            if rows:
                own, label, row, place, scores, ids = (np.concatenate(x) for x in zip(*rows, strict=True))
                vectors = at["x"].take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own), pa.array(label), vectors, pa.array(place.astype(np.int32)), pa.array(scores), pa.array(ids)], ["anchor_id", "label", "x", "place", "score", "vec_id"]
                )

    found = both.mapInArrow(run, f"{ANCHOR}, place int, score bigint, vec_id bigint")
    # anchors of one id are told apart by label and vector
    found = found.select("anchor_id", "label", F.xxhash64("x").alias("tie"), "place", "score", "vec_id")
    order = Window.partitionBy("anchor_id", "label", "tie", "place").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    window: tuple[int, int] = (30, 90),
    scale: int = 256,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    For each row with ``is_anchor`` and each of its best rows of the same label, the best rows of other labels
    whose score lies within these percentages of the positive's.
    """
    folder = shared_folder(vectors.sparkSession, "negatives")
    named = F.col(f"`{id_column}`").isNotNull() & F.col(f"`{label_column}`").isNotNull()
    rows = vectors.where(named).select(
        F.col(f"`{id_column}`").cast("long").alias("id"),
        F.col(f"`{label_column}`").cast("long").alias("label"),
        F.coalesce(is_anchor, F.lit(False)).alias("asks"),
        scaled(F.col(f"`{vector_column}`"), scale).alias("x"),
    )
    rows = stored(rows.where("x IS NOT NULL"), folder, "rows")
    count, width = rows.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    size = max(LEAF, TREE_BYTES // (8 * (width or 1)))
    parts = max(1, -(-count // size), min(rows.sparkSession.sparkContext.defaultParallelism, -(-count // LEAF)))
    # equal pivots are cut by the hash of the id, so a hot pivot fills as many trees as it needs
    dealt = stored(_dealt(rows), folder, "dealt").repartitionByRange(parts, "pivot", F.xxhash64("id")).sortWithinPartitions("pivot")
    trees = stored(_trees(dealt.drop("pivot")), folder, "trees")
    roots = _roots(trees)

    anchors = stored(_anchors(trees, positives), folder, "anchors")
    best = stored(_searched(_everywhere(anchors, trees, roots), trees, positives, same_label=True), folder, "positives")
    tie = F.xxhash64("x").alias("tie")
    # at most ``positives`` windows an anchor
    of = best.groupBy("anchor_id", "label", "tie").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "vec_id"))).alias("held"))
    ends = F.transform("held", lambda p: p["score"])
    low = F.transform(ends, lambda s: F.ceil(s.cast("decimal(28,0)") * window[0] / 100).cast("long"))
    high = F.transform(ends, lambda s: F.floor(s.cast("decimal(28,0)") * window[1] / 100).cast("long"))
    asked = anchors.select("anchor_id", "label", "x", "tree", tie).join(of, ["anchor_id", "label", "tie"])
    none = F.transform("held", lambda _: F.lit(LEAST).cast("long"))
    asked = stored(asked.select("anchor_id", "label", "x", "tree", low.alias("low"), high.alias("high"), none.alias("floor")), folder, "asked")
    near = _searched(asked, trees, negatives, same_label=False)
    floors = near.where(F.col("rank") == negatives).groupBy("anchor_id", "label", "tie").agg(F.map_from_entries(F.collect_list(F.struct("place", "score"))).alias("known"))
    floor = F.transform("floor", lambda f, i: F.coalesce(F.try_element_at("known", i), f))
    known = asked.withColumn("tie", F.xxhash64("x")).join(floors, ["anchor_id", "label", "tie"], "left").withColumn("floor", F.when(F.col("known").isNull(), F.col("floor")).otherwise(floor))
    known = stored(known.select("anchor_id", "label", "x", "tree", "low", "high", "floor"), folder, "known")
    found = _searched(_everywhere(known, trees, roots), trees, negatives, same_label=False)
    positive = best.select("anchor_id", "label", "tie", (F.col("rank") - 1).alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(positive, ["anchor_id", "label", "tie", "place"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
