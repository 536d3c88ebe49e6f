"""Exact top-k inner products by best-first search in paged M-trees.

Vectors become integers.  Each gets one more component that brings all of them to the
same length, so that the largest inner products with a query are its nearest neighbours
in Euclidean distance, which is a metric.  Every block of rows is one M-tree: leaf pages
hold vectors with their distance to the page's routing vector, inner pages hold routing
vectors with covering radius and distance to their parent.  A query walks pages by the
least distance they can hold; a stored distance to a parent rules out pages and vectors by
the triangle inequality before any new distance is computed.  Queries and trees are dealt
in blocks.  Scores are exact 64-bit integers; bounds are widened for rounding, so that
they never rule out a tie.

Contract: vectors that are null, empty or hold null or non-finite components take no part.
Vectors are compared with those of their own number of components.  A query never meets
rows with its own id.  Candidates with repeated ids count each; ties go to the smaller id.
"""

from __future__ import annotations

import heapq
from math import inf

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.common import shared_folder, stored

#: Vectors of a leaf page, and pages of an inner page.
PAGE = 64
#: Vectors of one tree, and queries of one block.
TREE = 16_384
QUERIES = 256


class Tree:
    """An M-tree over integer vectors, built by splitting rows around far-apart routing vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        points = vectors.astype(np.float64)
        norms = (points * points).sum(1)
        self.top = float(norms.max()) if len(ids) else 0.0
        #: the component that brings every vector to the same length
        self.points = np.column_stack((points, np.sqrt(np.maximum(0, self.top - norms))))
        self.pages: list[dict] = []
        self.slack = 1e-9 * (1 + np.sqrt(self.top))
        self.root = self._build(np.arange(len(ids)), None) if len(ids) else None

    def _distances(self, rows: np.ndarray, center: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.points[rows] - center) ** 2).sum(1))

    def _build(self, rows: np.ndarray, parent: np.ndarray | None) -> int:
        center = self.points[rows[0]]
        if len(rows) > PAGE:
            mean = self.points[rows].mean(0)
            center = self.points[rows[int(self._distances(rows, mean).argmin())]]
        away = self._distances(rows, center)
        page = {"center": center, "radius": float(away.max()), "to_parent": 0.0 if parent is None else float(np.sqrt(((center - parent) ** 2).sum()))}
        if len(rows) <= PAGE or not page["radius"]:
            page["leaf"] = True
            page["rows"], page["away"] = rows, away
        else:
            page["leaf"] = False
            page["children"] = [self._build(part, center) for part in self._split(rows)]
            page["centers"] = np.array([self.pages[c]["center"] for c in page["children"]])
            page["radii"] = np.array([self.pages[c]["radius"] for c in page["children"]])
            page["to_parents"] = np.array([self.pages[c]["to_parent"] for c in page["children"]])
        self.pages.append(page)
        return len(self.pages) - 1

    def _split(self, rows: np.ndarray) -> list[np.ndarray]:
        """Parts around evenly spaced routing vectors; around far-apart ones where those are all equal."""
        points = self.points[rows]
        parts = min(PAGE, -(-len(rows) // PAGE) + 1)
        chosen = points[np.linspace(0, len(rows) - 1, parts).astype(np.int64)]
        gaps = (chosen * chosen).sum(1) - 2 * points @ chosen.T
        owner = gaps.argmin(1)
        if len(np.unique(owner)) == 1:
            far = points[int(self._distances(rows, points[0]).argmax())]
            owner = (((points - far) ** 2).sum(1) < ((points - points[0]) ** 2).sum(1)).astype(np.int64)
        return [rows[owner == i] for i in range(parts) if (owner == i).any()]

    def search(self, query_id: int, query: np.ndarray, k: int, floor: float) -> list[tuple[int, int]]:
        """The best ``(score, id)`` of the tree, at most ``k``; scores below ``floor`` may be left out."""
        if self.root is None:
            return []
        point = np.append(query.astype(np.float64), 0.0)
        base = float((point * point).sum()) + self.top
        slack = self.slack + 1e-9 * np.sqrt(base)

        def limit(score: float) -> float:
            """No vector further away than this has that score."""
            return np.sqrt(max(0.0, base - 2 * score)) + slack

        best: list[tuple[int, int]] = []  # a heap of (score, -id), worst first
        reach = limit(floor) if floor > -inf else inf
        root = self.pages[self.root]
        away = float(np.sqrt(((root["center"] - point) ** 2).sum()))
        heap = [(max(0.0, away - root["radius"]), self.root, away)]
        while heap:
            bound, number, away = heapq.heappop(heap)
            if bound > reach:
                break
            page = self.pages[number]
            if page["leaf"]:
                rows = page["rows"][np.abs(away - page["away"]) <= reach]
                scores = self.vectors[rows] @ query
                ids = self.ids[rows]
                if len(best) == k:
                    better = scores >= best[0][0]
                    scores, ids = scores[better], ids[better]
                for score, row in zip(scores.tolist(), ids.tolist(), strict=True):
                    if row == query_id:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, (score, -row))
                    elif (score, -row) > best[0]:
                        heapq.heapreplace(best, (score, -row))
                if len(best) == k:
                    reach = min(reach, limit(best[0][0]))
            else:
                # stored distances to the parent first, then distances to the routing vectors left
                near = np.flatnonzero(np.abs(away - page["to_parents"]) - page["radii"] <= reach)
                found = np.sqrt(((page["centers"][near] - point) ** 2).sum(1))
                bounds = np.maximum(bound, found - page["radii"][near])
                for i in np.flatnonzero(bounds <= reach).tolist():
                    heapq.heappush(heap, (float(bounds[i]), page["children"][near[i]], float(found[i])))
        return [(score, -row) for score, row in best]


def scaled(embedding: Column, scale: int = 1024) -> Column:
    """Components as ``floor(scale * x)``, or null where the vector takes no part."""
    valid = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(embedding, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    return F.when(embedding.isNotNull() & (F.size(embedding) > 0) & ~valid, whole)


def _matrix(lists: pa.Array) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1).astype(np.int64)


def _packed(source: DataFrame, size: int) -> DataFrame:
    """Blocks of at most ``size`` vectors of one number of components: ``block, dim, ids, vectors`` as bytes."""

    def run(batches):
        waiting: dict[int, list] = {}
        number = TaskContext.get().partitionId() << 32

        def block(dim: int, parts: list) -> pa.RecordBatch:
            nonlocal number
            number += 1
            ids, vectors = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
            columns = [pa.array([number - 1]), pa.array([dim], pa.int32()), pa.array([ids.tobytes()]), pa.array([vectors.tobytes()])]
            return pa.RecordBatch.from_arrays(columns, ["block", "dim", "ids", "vectors"])

        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            sizes = np.array(lists.value_lengths())
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                vectors = _matrix(lists.take(pa.array(rows)))
                for i in range(0, len(rows), size):
                    parts = waiting.setdefault(dim, [])
                    parts.append((ids[rows[i : i + size]], vectors[i : i + size]))
                    if sum(len(x) for x, _ in parts) >= size:
                        yield block(dim, waiting.pop(dim))
        for dim, parts in waiting.items():
            yield block(dim, parts)

    return source.mapInArrow(run, "block bigint, dim int, ids binary, vectors binary")


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """``query_id, rank, <id_column>, score``: the ``k`` best of all rows for each row with ``is_query``.

    Trees and query blocks are tables in the shared folder.  A query block meets every tree; what
    is sent between tasks is a copy of each query block for each tree and ``k`` results for each query
    and tree.
    """
    spark = vectors.sparkSession
    folder = shared_folder(spark, "trees")
    rows = vectors.where(F.col(f"`{id_column}`").isNotNull()).withColumn("is_query", F.coalesce(is_query, F.lit(False)))
    rows = rows.select(F.col(f"`{id_column}`").cast("long").alias("id"), scaled(F.col(f"`{vector_column}`"), scale).alias("vector"), "is_query")
    rows = rows.where(F.col("vector").isNotNull())
    trees = stored(_packed(rows.select("id", "vector"), TREE), folder, "trees")
    queries = stored(_packed(rows.where("is_query").select("id", "vector"), QUERIES), folder, "queries")
    names = trees.select("dim", F.col("block").alias("tree"))
    # a partition streams each tree, then the query blocks that meet it
    asked = queries.join(names, "dim").select("tree", F.lit(1).alias("kind"), "dim", "ids", "vectors")
    held = trees.select(F.col("block").alias("tree"), F.lit(0).alias("kind"), "dim", "ids", "vectors")
    both = held.unionByName(asked).repartition(max(1, trees.count()), "tree").sortWithinPartitions("tree", "kind")

    def run(batches):
        tree = None
        for batch in batches:
            for kind, dim, ids, packed in zip(*(batch.column(i) for i in range(1, 5)), strict=True):
                rows = np.frombuffer(ids.as_buffer(), np.int64)
                matrix = np.frombuffer(packed.as_buffer(), np.int64).reshape(-1, dim.as_py())
                if not kind.as_py():
                    tree = Tree(rows.copy(), matrix.copy())
                    continue
                out = [(number, score, row) for number, query in zip(rows.tolist(), matrix, strict=True) for score, row in tree.search(number, query, k, -inf)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["query_id", "score", "vec_id"])

    found = both.mapInArrow(run, "query_id bigint, score bigint, vec_id bigint")
    # the k best of a query from the k best of each tree: the window keeps k rows a task before the shuffle
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("vec_id").alias(id_column), "score")
