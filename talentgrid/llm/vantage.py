"""Nearest neighbours by inner product, with a vantage-point tree in each shard.

Vectors are dealt into shards of about ``shard_size`` by a hash. A shard gives every vector one more coordinate that brings
all to the same length; the nearest by distance is then the largest inner product, and the triangle inequality holds. A tree
node takes a vantage point and parts its vectors at the median distance; each half keeps the least and the greatest distance.
A half is passed over if, for a query at distance d from the vantage point and with its k-th best at distance r so far,

    max(d - greatest, least - d, 0) > factor * r

Factor one is the triangle inequality itself, so the search is exact; less prunes more. Squared lengths are off by rounding,
so every distance in the test is widened by that much of its square. A node of equal vectors is not parted: all have the same
score, and the smallest rows are taken. Scores are inner products in double
precision of the vectors as given. Queries are dealt into blocks; each block meets each shard once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentgrid.llm.common import stored

SHARD, QUERIES, LEAF, FACTOR = 8192, 1024, 64, 1.0


class VantageTree:
    """``vectors``: (n, d) doubles. Nodes are in one array each; a leaf's rows are order[begin:end]."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF, seed: int = 3):
        self.vectors = vectors
        size = np.einsum("ij,ij->i", vectors, vectors)
        self.longest = size.max()
        self.rounding = 8 * (vectors.shape[1] + 8) * np.finfo(float).eps * self.longest  # of squared lengths
        self.lifted = np.hstack([vectors, np.sqrt(self.longest - size)[:, None]])
        self.order = np.arange(len(vectors))
        self.nodes: list[tuple] = []  # (begin, end, vantage, near child, far child, bounds of both)
        self.equal: set[int] = set()  # leaves of more than ``leaf`` equal vectors
        self.rng = np.random.default_rng(seed)
        self._build(0, len(vectors), leaf)

    def _build(self, begin: int, end: int, leaf: int) -> int:
        at = len(self.nodes)
        self.nodes.append((begin, end, -1, -1, -1, None))
        if end - begin > leaf:
            rows = self.order[begin:end]
            if (self.vectors[rows[-1]] == self.vectors[rows[0]]).all() and (self.vectors[rows] == self.vectors[rows[0]]).all():
                self.equal.add(at)
                self.order[begin:end] = np.sort(rows)
                return at
            vantage = int(rows[self.rng.integers(len(rows))])
            d = np.linalg.norm(self.lifted[rows] - self.lifted[vantage], axis=1)
            half = len(rows) // 2
            by = np.argpartition(d, half)
            self.order[begin:end], d = rows[by], d[by]
            bounds = (d[:half].min(), d[:half].max(), d[half:].min(), d[half:].max())
            near = self._build(begin, begin + half, leaf)
            far = self._build(begin + half, end, leaf)
            self.nodes[at] = (begin, end, vantage, near, far, bounds)
        return at

    def search(self, queries: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the ``k`` best for each query; -1 and -inf where there are fewer."""
        n = len(queries)
        length = np.linalg.norm(queries, axis=1, keepdims=True)
        placed = np.hstack([queries * (np.sqrt(self.longest) / length), np.zeros((n, 1))])
        best = np.full((n, k), -np.inf)
        row = np.full((n, k), -1)
        reach = np.full(n, np.inf)
        scale = np.sqrt(self.longest) / length[:, 0]

        def visit(at: int, who: np.ndarray) -> None:
            begin, end = self.nodes[at][:2]
            rows = self.order[begin : begin + k] if at in self.equal and end - begin > k else np.sort(self.order[begin:end])
            score = np.einsum("qd,nd->qn", queries[who], self.vectors[rows])  # the same for equal vectors, wherever they lie
            score = np.hstack([best[who], score])
            names = np.hstack([row[who], np.broadcast_to(rows, (len(who), len(rows)))])
            top = np.lexsort((names, -score), axis=1)[:, :k]  # of equal scores the smaller row
            best[who], row[who] = np.take_along_axis(score, top, 1), np.take_along_axis(names, top, 1)
            with np.errstate(invalid="ignore"):
                reach[who] = np.sqrt(np.maximum(0, 2 * self.longest - 2 * best[who, -1] * scale[who]) + self.rounding)

        def away(node: tuple, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            d = np.linalg.norm(placed[who] - self.lifted[node[2]], axis=1)
            a, b, c, e = node[5]
            more = lambda x: np.sqrt(x * x + self.rounding)
            less = lambda x: np.sqrt(np.maximum(0, x * x - self.rounding))
            return (np.maximum(0, np.maximum(less(d) - more(b), less(a) - more(d))),
                    np.maximum(0, np.maximum(less(d) - more(e), less(c) - more(d))))

        first = np.zeros(n, int)  # each query's own leaf first: the bound is tight from then on
        todo = [(0, np.arange(n))]
        while todo:
            at, who = todo.pop()
            node = self.nodes[at]
            if node[2] < 0:
                first[who] = at
                visit(at, who)
                continue
            near, far = away(node, who)
            inside = near <= far
            todo += [(child, w) for child, w in ((node[3], who[inside]), (node[4], who[~inside])) if len(w)]
        todo = [(0, np.arange(n), np.zeros(n))]
        while todo:
            at, who, bound = todo.pop()
            who = who[bound <= factor * reach[who] * (1 + 1e-12) + 1e-12]
            node = self.nodes[at]
            if node[2] < 0:
                who = who[first[who] != at]
                if len(who):
                    visit(at, who)
            elif len(who):
                near, far = away(node, who)
                todo += [(node[3], who, near), (node[4], who, far)]
        return row, best


def usable(vector: Column) -> Column:
    """Neither null nor zero, and all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _pack(key: tuple, rows: pa.Table) -> pa.Table:
    return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "group": pa.array([key[1].as_py()], pa.int64()), "ids": [rows["id"].to_numpy().astype("<i8").tobytes()],
                     "keys": [rows["key"].to_numpy().astype("<i8").tobytes()],
                     "vectors": [np.stack(rows["vector"].to_numpy()).astype("<f8").tobytes()]})


def _search(batches: Iterator[pa.RecordBatch], k: int, factor: float, leaf: int) -> Iterator[pa.RecordBatch]:
    last, tree = None, None
    for batch in batches:
        for r in batch.to_pylist():
            ids = np.frombuffer(r["ids"], "<i8")
            if last != (r["dim"], r["shard"]):
                by_id = np.argsort(ids, kind="stable")
                ids = ids[by_id]
                tree, names = VantageTree(np.frombuffer(r["vectors"], "<f8").reshape(len(ids), -1)[by_id], leaf), ids
                last = (r["dim"], r["shard"])
            asked, keys = np.frombuffer(r["query_ids"], "<i8"), np.frombuffer(r["query_keys"], "<i8")
            queries = np.frombuffer(r["query_vectors"], "<f8").reshape(len(asked), -1)
            extra = 1
            while True:  # a query's own rows don't count; there may be several
                row, score = tree.search(queries, min(k + extra, len(names)), factor)
                own = (row >= 0) & (names[row] == asked[:, None])
                if row.shape[1] == len(names) or own.sum(1).max(initial=0) <= extra:
                    break
                extra *= 4
            kept = (row >= 0) & ~own
            kept &= np.cumsum(kept, 1) <= k
            q, at = np.nonzero(kept)
            yield pa.RecordBatch.from_arrays([pa.array(asked[q]), pa.array(keys[q]), pa.array(names[row[q, at]]), pa.array(score[q, at])],
                                             ["query_id", "key", "vec_id", "score"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
            factor: float = FACTOR, shard_size: int = SHARD, leaf: int = LEAF) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of ``vectors`` with the largest inner products with each query's vector.

    ``queries`` has the same columns. Nearest first, ties to the smaller id; a query's own id is no candidate. Ids that are
    null and vectors that are null, zero or not finite take no part; vectors of another length than the query's are no
    candidates. Rows that repeat an id are candidates each. A query row that is there again is one query; different vectors
    under one id are queries of their own, ranked each for itself. Fewer candidates give fewer rows, empty tables none.
    """
    def dealt(df: DataFrame, group_size: int, once: bool = False) -> DataFrame:
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
        rows = rows.filter(F.col("id").isNotNull() & usable(F.col("vector")))
        rows = (rows.distinct() if once else rows).withColumns({"dim": F.size("vector"), "key": F.xxhash64("id", "vector")})
        groups = max(1, -(-rows.count() // group_size))
        return rows.withColumn("group", F.pmod("key", F.lit(groups))).groupBy("dim", "group").applyInArrow(
            _pack, "dim int, group long, ids binary, keys binary, vectors binary")

    shards = stored(dealt(vectors, shard_size).withColumnRenamed("group", "shard").drop("keys"), "shards")
    blocks = stored(dealt(queries, QUERIES, once=True), "query-blocks").withColumnsRenamed(
        {"ids": "query_ids", "keys": "query_keys", "vectors": "query_vectors"})
    here = blocks.select("dim", "group").distinct().groupBy("dim").agg(F.collect_list("group").alias("groups"))
    cells = shards.join(here, "dim").withColumn("group", F.explode("groups")).drop("groups").join(blocks, ["dim", "group"])
    cells = cells.repartition(max(1, shards.count()), "dim", "shard").sortWithinPartitions("dim", "shard")
    found = cells.mapInArrow(partial(_search, k=k, factor=factor, leaf=leaf), "query_id long, key long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
