"""Ranked lexical search with norm buckets: the best documents of each query item by an integer BM25 score.

A score is an inner product. Both sides hold the square root of a term's weight: the item its count, the document its
saturated frequency. Documents' vectors keep only the terms of the items and are ordered by length within each task's share
of them, then cut into buckets. With the item's best scores so far,

* a bucket goes if its longest vector cannot reach the score (Cauchy-Schwarz);
* inside, the item's largest coordinates are taken until the rest of it, times the longest vector, is below the score: a
  document is kept if its product over these coordinates and the lengths of both rests can still reach the score;
* those kept are scored in integers.

The longest documents of all are searched first; what an item has found there is where every task begins. Nothing is
dropped: a bound is widened by more than its rounding, and equal scores pass it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talentgrid.llm.common import small_enough, stored

K, BLOCK_BYTES, HEAD = 20, 8 << 20, 0.99
# Terms are runs of digits, letters (A-Z lower-cased) and bytes of characters beyond ASCII.
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TERM).split()


def _lists(values: list, kind) -> pa.ListArray:
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0), *values]).astype(kind)))


def _frequencies(batches: Iterator[pa.RecordBatch], known: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, terms, times = [], [], []
        for text in batch.column(1).cast(pa.large_binary()):
            words = terms_of(text.as_py())
            n.append(len(words))
            found = [(i, c) for w, c in Counter(words).items() if (i := known.get(w)) is not None]
            terms.append([i for i, _ in found])
            times.append([c for _, c in found])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), _lists(terms, np.int32), _lists(times, np.int64)],
                                         ["doc_id", "n", "terms", "times"])


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.asarray(column.offsets)
    return np.asarray(column.values)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _vectors(batches: Iterator[pa.RecordBatch], weight: np.ndarray, docs: int, words: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, norm, terms, values): saturated frequencies, and the length of the vector with weights."""
    for batch in batches:
        terms, first = _flat(batch.column(2))
        times, _ = _flat(batch.column(3))
        m = np.array([100 - 25 + 25 * n * docs // words for n in batch.column(1).to_pylist()], np.int64)
        values = 1000000000 * times // (1000 * times + 12 * np.repeat(m, np.diff(first)))
        total = np.zeros(len(terms) + 1)
        np.cumsum(weight[terms] * values.astype(float) ** 2, out=total[1:])
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array(np.sqrt(total[first[1:]] - total[first[:-1]]) * (1 + 1e-9)),
            pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(terms)),
            pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values))], ["doc_id", "norm", "terms", "values"])


class Bucket:
    """Vectors of similar length: by row for scores, by term for bounds."""

    def __init__(self, norm: np.ndarray, terms: np.ndarray, values: np.ndarray, first: np.ndarray, weight: np.ndarray):
        self.norm, self.terms, self.values, self.first = norm, terms, values, first
        self.square, self.longest = norm**2, float(norm.max())
        order = np.argsort(terms, kind="stable")
        self.by_term, self.row = terms[order], np.repeat(np.arange(len(norm)), np.diff(first))[order]
        self.scaled = np.sqrt(weight[self.by_term]) * values[order]

    def may_reach(self, item: Item, least: float) -> np.ndarray:
        """Rows that bounds leave with a score of ``least`` or more."""
        if item.rest[0] * self.longest * (1 + 1e-9) < least:
            return np.zeros(0, np.int64)
        focus = int(np.searchsorted(-item.rest, -least / (self.longest * (1 + 1e-9)), "right")) if least > 0 else len(item.terms)
        focus = min(focus, len(item.terms))
        low = np.searchsorted(self.by_term, item.terms[:focus], "left")
        size = np.searchsorted(self.by_term, item.terms[:focus], "right") - low
        at = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
        row, x = self.row[at], self.scaled[at]
        product = np.bincount(row, np.repeat(item.scaled[:focus], size) * x, len(self.norm))
        inside = np.bincount(row, x * x, len(self.norm))
        bound = product + item.rest[focus] * np.sqrt(np.maximum(self.square - inside, 0) + 1e-12 * self.square)
        return np.flatnonzero((bound * (1 + 1e-9) >= least) & (bound > 0))

    def scores(self, rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
        size = self.first[rows + 1] - self.first[rows]
        begin = np.cumsum(size) - size
        at = np.repeat(self.first[rows] - begin, size) + np.arange(size.sum())
        return np.add.reduceat(factor[self.terms[at]] * self.values[at], begin)


class Item:
    """One query: its terms by falling coordinate, and the length of what is left after each of them."""

    def __init__(self, terms: list[int], counts: list[int], weight: np.ndarray, least: int):
        terms, counts = np.array(terms, np.int64), np.array(counts, np.int64)
        scaled = counts * np.sqrt(weight[terms])
        order = np.argsort(-scaled, kind="stable")
        self.terms, self.scaled, self.factor = terms[order], scaled[order], (counts * weight[terms])[order]
        self.rest = np.sqrt(np.append(np.cumsum(self.scaled[::-1] ** 2)[::-1], 0.0)) * (1 + 1e-12)
        self.least = least
        self.ids, self.found = [], np.zeros(0, np.int64)

    def take(self, ids: list, scores: np.ndarray, k: int) -> None:
        ids, scores = self.ids + ids, np.append(self.found, scores)
        order = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i] is None, ids[i] or 0))[:k]
        self.ids, self.found = [ids[i] for i in order], scores[order]
        if len(order) == k:
            self.least = max(self.least, int(self.found[-1]))


def _search(batches: Iterator[pa.RecordBatch], items: list, weight: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    queries = [(q, Item(terms, counts, weight, least)) for q, terms, counts, least in items]
    factor = np.zeros(len(weight), np.int64)
    for batch in batches:
        if not len(batch):
            continue
        terms, first = _flat(batch.column(2))
        bucket = Bucket(np.asarray(batch.column(1)), terms, _flat(batch.column(3))[0], first, weight)
        for _, item in queries:
            rows = bucket.may_reach(item, item.least)
            if len(rows):
                factor[item.terms] = item.factor
                scores = bucket.scores(rows, factor)
                factor[item.terms] = 0
                good = (scores >= max(item.least, 1))
                if good.any():
                    item.take(batch.column(0).take(pa.array(rows[good])).to_pylist(), scores[good], k)
    q = [q for q, item in queries for _ in item.ids]
    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array([x for _, item in queries for x in item.ids], pa.int64()),
                                      pa.array(np.concatenate([np.zeros(0, np.int64), *[item.found for _, item in queries]]))],
                                     ["q", "doc_id", "score"])


def _best(vectors: DataFrame, items: list, weight: np.ndarray, k: int) -> DataFrame:
    found = vectors.mapInArrow(partial(_search, items=items, weight=weight, k=k), "q long, doc_id long, score long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search_block(docs: DataFrame, items: DataFrame, k: int, head: float) -> DataFrame:
    """The best documents of (q, text) items that are few enough for every task to hold."""
    queries = [(r.q, Counter(terms_of(bytes(r.text or b"")))) for r in items.select("q", F.col("text").cast("binary")).collect()]
    known = {t: i for i, t in enumerate(sorted({t for _, c in queries for t in c}))}
    made = stored(docs.mapInArrow(partial(_frequencies, known=known), "doc_id long, n long, terms array<int>, times array<long>"), "frequencies")
    total = made.filter("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("words")).first()
    seen = np.zeros(len(known), np.int64)
    for r in made.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # no more rows than the items have terms
        seen[r["term"]] = r["count"]
    weight = np.array([math.floor(1000 * math.log((2 * total.docs + 2) / (2 * int(d) + 1))) for d in seen], np.int64)
    vectors = made.filter(F.size("terms") > 0).mapInArrow(
        partial(_vectors, weight=weight, docs=total.docs, words=total.words or 1), "doc_id long, norm double, terms array<int>, values array<long>")
    vectors = stored(vectors.filter("norm > 0").sortWithinPartitions(F.desc("norm")), "vectors")
    listed = [(q, [known[t] for t in c], list(c.values()), 0) for q, c in queries if c]
    long = vectors.agg(F.percentile_approx("norm", head)).first()[0]
    least = {}
    if long is not None:
        first = _best(vectors.filter(F.col("norm") >= long), listed, weight, k)
        least = {r.q: r.score for r in first.filter(F.col("rank") == k).collect()}
    return _best(vectors, [(q, terms, counts, least.get(q, 0)) for q, terms, counts, _ in listed], weight, k)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", block_bytes: int = BLOCK_BYTES, head: float = HEAD) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of the highest score above 0 for each item, ranks from 1.

    Equal scores go by ascending id, a null id last. Every row of ``docs`` is a document of its own, repeated ones too. A null
    or empty text has no terms: such a document has no score and counts in no statistic, such an item has no rows. Repeated
    items count once; items with one id and different texts are ranked each for itself, under that id. Either table may be
    empty. Other columns are not read.

    Items are held by every task, by blocks of about ``block_bytes`` of their texts: more of them take more passes over ``docs``.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_text).cast("string").alias("text"))
    items = items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text")).distinct()
    items = stored(items.withColumn("q", F.monotonically_increasing_id()), "items")
    size = items.agg(F.sum(F.octet_length("text") + 32)).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    found = [_search_block(docs, items.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b), k, head) for b in range(blocks)]
    names = items.select("q", "item_id")
    names = F.broadcast(names) if small_enough(items, F.coalesce(F.octet_length(F.col("item_id").cast("string")), F.lit(0)) + 16) else names
    return reduce(DataFrame.union, found).join(names, "q").select("item_id", "rank", "doc_id", "score")
