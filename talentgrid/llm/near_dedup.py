"""Near-duplicate documents by Order MinHash.

A document is the sequence of its five-word k-mers, each labelled with its occurrence number (the second "of the and of
the" of a text is another k-mer than the first). A sketch hashes all labelled k-mers, takes the ``picks`` smallest and
keeps them in text order; two documents share it only if they share those k-mers in the same order. Documents that share
one of ``sketches`` sketches are candidates, and a banded alignment of the two k-mer sequences decides:

    similarity = L / (n_a + n_b - L),  L: longest common subsequence of the labelled k-mers

Pairs of ``threshold`` or more are links; a class is a connected component. At similarity 0.8 a sketch of 4 is shared with
probability about 0.41, so one pair in 3 * 10^5 of those just at the threshold shares none of 24 sketches; more similar
ones miss less.

No bucket is expanded into its pairs. Texts of the same words collapse first. Up to ``small`` members are paired with each
other; in a larger bucket each member is paired with its hub, the member whose sketches are the most shared (for a text and
its many copies that is the text). Members that their hub is no partner of, such as texts that hold one common passage, stay
open. What is left of the large buckets is cut by length, and a cut in which all are of one component, or none is open, goes.
The other texts go on to an exact prefix filter. K-mers are ordered by rarity among those texts (by counts in a table of fixed
size), and two similar enough texts must share one of their n - ceil(t n) + 1 rarest. Where such a k-mer stands in that order
bounds what two texts can still share, so a text leaves a bucket whose shortest text is too long for it; what stays is
compared with hubs, the shortest texts first and ever more of them, but not with texts that links found so far have brought
into the same component, until all that is left of a bucket is in one component or was open nowhere.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import partial, reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentgrid.llm.common import Words, mix, small_enough, stored, text_steps
from talentgrid.llm.components import components

K, PICKS, SKETCHES, THRESHOLD, SMALL = 5, 4, 24, 0.8, 16
#: Slots of the table that orders k-mers by rarity.
RARITY_BITS = 20


def labelled(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled k-mer hashes of all texts in order, and how many each text has."""
    h, whole = words.shingles(k)
    n = np.maximum(np.diff(words.first) - k + 1, 0)
    h, doc = h[whole], np.repeat(np.arange(len(n), dtype=np.uint64), n)
    own = mix(h + mix(doc))
    order = np.argsort(own, kind="stable")
    run = np.ones(len(h), bool)
    run[1:] = own[order][1:] != own[order][:-1]
    begin = np.flatnonzero(run)
    nth = np.empty(len(h), np.uint64)
    nth[order] = np.arange(len(h)) - np.repeat(begin, np.diff(np.append(begin, len(h))))
    return np.where(nth > 0, mix(h + nth), h), n


def order_sketches(h: np.ndarray, n: np.ndarray, picks: int, sketches: int) -> np.ndarray:
    """A row of sketch hashes for each text that has k-mers."""
    n = n[n > 0]
    doc = np.repeat(np.arange(len(n)), n)
    wanted = np.minimum(n, picks)
    # the smallest few lie below this bound nearly always; where they don't, the whole text is taken
    bound = np.repeat(np.minimum(4.0 * picks / np.maximum(n, 1), 1.0) * (2.0**64 - 2.0**12), n).astype(np.uint64)
    out = np.empty((len(n), sketches), np.uint64)
    for j in range(sketches):
        v = mix(h, j + 1)
        kept = v <= bound
        lacking = np.bincount(doc[kept], minlength=len(n)) < wanted
        if lacking.any():
            kept |= lacking[doc]
        kept = np.flatnonzero(kept)
        by_value = kept[np.lexsort((v[kept], doc[kept]))]
        begin = np.searchsorted(doc[by_value], np.arange(len(n)))
        rank = np.arange(len(by_value)) - begin[doc[by_value]]
        chosen = np.sort(by_value[rank < picks])
        begin = np.cumsum(wanted) - wanted
        nth = np.arange(len(chosen)) - np.repeat(begin, wanted)
        out[:, j] = mix(np.add.reduceat(mix(h[chosen] + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 77), begin), j)
    return out


def _sketch(batches: Iterator[pa.RecordBatch], k: int, picks: int, sketches: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in text_steps(batch.column(1)):
            words = Words(data, offsets)
            h, n = labelled(words, k)
            keys = order_sketches(h, n, picks, sketches).view(np.int64) if len(h) else np.zeros((0, sketches), np.int64)
            size = np.where(n > 0, sketches, 0)
            norm = [blake2b(words.hashes[a:b].tobytes(), digest_size=16).digest() if b > a else None
                    for a, b in zip(words.first[:-1], words.first[1:])]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(i, j - i), pa.array(norm, pa.binary()), pa.array(n, pa.int64()),
                pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(keys.ravel()))],
                ["id", "norm", "n", "keys"])


def _rarity(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(slot, n): how many k-mers of a task's texts fall into each slot of the rarity table."""
    counts = np.zeros(1 << RARITY_BITS, np.int64)
    for batch in batches:
        for _, _, data, offsets in text_steps(batch.column(1)):
            h, _ = labelled(Words(data, offsets), k)
            counts += np.bincount((h & np.uint64(len(counts) - 1)).astype(np.int64), minlength=len(counts))
    slot = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(counts[slot])], ["slot", "n"])


def _prefixes(batches: Iterator[pa.RecordBatch], k: int, threshold: float, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(key, id, n, r, open): the rarest k-mers of each text (id, text, open), r the number of its k-mers from this one on."""
    for batch in batches:
        for i, j, data, offsets in text_steps(batch.column(1)):
            h, n = labelled(Words(data, offsets), k)
            text = np.repeat(np.arange(j - i), n)
            order = np.lexsort((h, counts[h & np.uint64(len(counts) - 1)], text))
            rank = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
            taken = rank < (n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1)[text]
            rank, text = rank[taken], text[taken]
            own, is_open = (batch.column(c).slice(i, j - i).take(pa.array(text)) for c in (0, 2))
            yield pa.RecordBatch.from_arrays([
                pa.array(h[order[taken]].view(np.int64)), own, pa.array(n[text]), pa.array(n[text] - rank), is_open],
                ["key", "id", "n", "r", "open"])


def common_in_order(x: np.ndarray, y: np.ndarray, threshold: float) -> int:
    """L of the alignment of two sequences without repeats; 0 if their similarity is below the threshold.

    The band: a pair that is similar enough leaves at most (1-t)/(1+t) * (n_a + n_b) k-mers unaligned, so no aligned
    positions lie further apart.
    """
    total = len(x) + len(y)
    enough = threshold * total / (1 + threshold) - 1e-9
    if min(len(x), len(y)) < enough:
        return 0
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    near = np.abs(i - j) <= total - 2 * enough
    i, j = i[near], j[near]
    if len(i) < enough:
        return 0
    j = j[np.argsort(i)]
    if (j[1:] > j[:-1]).all():
        return len(j)
    tails: list[int] = []
    for v in j.tolist():
        at = bisect_left(tails, v)
        tails[at : at + 1] = [v]
    return len(tails) if len(tails) >= enough else 0


def _align(batches: Iterator[pa.RecordBatch], k: int, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, similarity = [], [], []
        for at in range(0, len(batch), 32):
            rows = batch.slice(at, 32)
            sides = []
            for c in (2, 3):
                column = rows.column(c).cast(pa.large_binary())
                off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
                data = np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]]
                h, n = labelled(Words(data, off - off[0]), k)
                sides.append(np.split(h, np.cumsum(n)[:-1]))
            for x, y, u, v in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), *sides):
                if len(u) and len(v) and (both := common_in_order(u, v, threshold)):
                    a.append(x)
                    b.append(y)
                    similarity.append(both / (len(u) + len(v) - both))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                                          pa.array(similarity, pa.float64())], ["a", "b", "similarity"])


def _texts_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of stored, distinct ``ids`` with their further columns; few enough ids go to the texts, so that other texts are
    not shuffled."""
    return texts.join(F.broadcast(ids) if small_enough(ids, F.lit(8 * len(ids.columns))) else ids, "id")


def aligned_pairs(pairs: DataFrame, texts: DataFrame, k: int = K, threshold: float = THRESHOLD) -> DataFrame:
    """The links (a, b, similarity) among candidate ``pairs`` (a, b); ``texts``: (id, text)."""
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "paired")
    texts = _texts_of(texts, ids)
    sides = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    sides = sides.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return sides.select("a", "b", "text_a", "text_b").mapInArrow(
        partial(_align, k=k, threshold=threshold), "a long, b long, similarity double")


def _able(threshold: float, n: Column, m: Column, r: Column, q: Column) -> Column:
    """Whether texts of n and m k-mers, r and q of them from a shared one on, may be similar enough."""
    return (F.least(n, m) >= threshold * F.greatest(n, m)) & (F.least(r, q) * (1 + threshold) >= threshold * (n + m) - 1e-6)


def _paired(rows: DataFrame, small: int, hubs: int, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of buckets (key, id, weight, n, r, open, part, size) of two texts or more (``size`` is not asked for once there are more
    hubs than ``small``): candidate pairs (a, b) of two parts, one of them open; the members of
    the large buckets without their hubs; and (key, id, hub) of the members and hubs paired."""
    large = rows.filter(F.col("size") > small).drop("size") if hubs < small else rows
    named = lambda df, x: df.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "r", "open", "part")])
    able = lambda x, y: (F.col(f"open_{x}") | F.col(f"open_{y}")) & (F.col(f"part_{x}") != F.col(f"part_{y}")) & _able(
        threshold, F.col(f"n_{x}"), F.col(f"n_{y}"), F.col(f"r_{x}"), F.col(f"r_{y}"))
    nth = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("weight"), "id"))
    top = named(large.withColumn("nth", nth).filter(F.col("nth") <= hubs), "h")
    members = large.join(top.select("key", F.col("id_h").alias("id")), ["key", "id"], "left_anti")
    far = named(large, "m").join(top, "key").filter("id_m <> id_h").filter(able("m", "h"))
    far = stored(far.select("key", F.col("id_m").alias("id"), F.col("id_h").alias("hub")), "hubs")
    pairs = far.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
    if hubs < small:  # else hubs are all that a small bucket has
        few = rows.filter(F.col("size") <= small)
        near = named(few, "a").join(named(few, "b"), "key").filter("id_a < id_b").filter(able("a", "b"))
        pairs = pairs.union(near.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")))
    return pairs.distinct(), members, far


def _labelled(label: DataFrame | None, links: DataFrame) -> DataFrame:
    """``label`` (node, component) after further stored ``links`` (a, b): only the components they touch are joined anew."""
    if label is None:
        return components(links)
    if links.isEmpty():
        return label
    of = lambda x: label.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}"))
    edges = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(
        F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    merged = components(edges).select(F.col("node").alias("old"), F.col("component").alias("new"))
    moved = label.join(merged, F.col("component") == F.col("old"), "left").select("node", F.coalesce("new", "component").alias("component"))
    fresh = merged.join(label, F.col("old") == F.col("node"), "left_anti").select("old", "new")
    return stored(moved.union(fresh), "labels")


def _rare(texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """(key, id, weight, n, r, open): the rarest k-mers of each text (id, text, open), enough for any two similar ones to share
    one; those that two texts have. Any order of k-mers will do, if it is the same for all texts; k-mers of one slot are ordered
    by their hash."""
    texts = stored(texts.dropDuplicates(["id", "text"]), "left-over-texts")
    counts = np.zeros(1 << RARITY_BITS, np.int64)
    seen = texts.mapInArrow(partial(_rarity, k=k), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts[seen["slot"].to_numpy()] = seen["n"].to_numpy()
    rows = texts.mapInArrow(partial(_prefixes, k=k, threshold=threshold, counts=counts),
                            "key long, id long, n long, r long, open boolean")
    rows = stored(rows, "rare-kmers")
    common = rows.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1").select("key")
    return rows.join(common, "key", "left_semi").select("key", "id", (-F.col("n")).alias("weight"), "n", "r", "open")


def _undecided(members: DataFrame, threshold: float) -> DataFrame:
    """Of buckets with rows for (key, id, weight, n, r, open, part), each cut by length so that similar enough texts share a
    cut: the rows of cuts with several parts and an open text, without those for which the shortest of their cut is too long."""
    cut = F.floor(F.log("n") / (float(np.log(1 / threshold)) * (1 + 1e-9)) + 1e-9)
    rows = members.withColumn("cut", F.explode(F.array(cut, cut + 1))).withColumn("cut", F.xxhash64("key", "cut")).drop("key")
    cuts = rows.groupBy("cut").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.max("open").alias("any"), F.min("n").alias("least"))
    cuts = cuts.filter("p < q AND any").select(F.col("cut").alias("mixed"), "least")
    able = F.col("r") * (1 + threshold) >= threshold * (F.col("n") + F.col("least")) - 1e-6
    return rows.join(cuts, (F.col("cut") == F.col("mixed")) & able, "left_semi").withColumnRenamed("cut", "key")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, picks: int = PICKS,
                    sketches: int = SKETCHES, threshold: float = THRESHOLD, small: int = SMALL) -> DataFrame:
    """(id_col, class_id) for every row of ``docs``; the class is the least id of its component.

    Only words count (case and punctuation do not). A null or wordless text, or one of fewer than k words, is like no
    other text but one of the same words; wordless ones are each a class of their own. Rows of one id are one document.
    A null id joins no class: its class_id is null. An empty table gives an empty result; other columns are not read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    made = stored(texts.mapInArrow(partial(_sketch, k=k, picks=picks, sketches=sketches),
                                   "id long, norm binary, n long, keys array<long>"), "sketches")
    known = made.filter("id IS NOT NULL AND norm IS NOT NULL")
    first = known.groupBy("norm").agg(F.min("id").alias("rep"))
    owners = known.join(first, "norm").filter("id = rep").select("id", "n", "keys").distinct()
    keys = owners.select("id", "n", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    rows = stored(keys.join(shared, "key"), "shared-sketches")
    rows = rows.withColumns({"weight": F.sum("size").over(Window.partitionBy("id")),  # of one text's sketches
                             "r": F.col("n"), "open": F.lit(True), "part": F.col("id")})
    tried, hubs, exact, label = [], 1, False, None
    while True:
        pairs, members, far = _paired(rows, small, hubs, threshold)
        if tried:
            pairs = pairs.join(reduce(DataFrame.union, tried), ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        if label is None or not pairs.isEmpty():
            links = stored(aligned_pairs(pairs, texts, k, threshold), "links")
            label = _labelled(label, links)
            tried.append(pairs)
        if not exact:
            known_links = links.select(F.col("a").alias("id"), F.col("b").alias("hub"))
            known_links = known_links.union(known_links.select("hub", "id"))
            taken = far.join(known_links, ["id", "hub"]).select("key", "id", F.lit(True).alias("taken")).distinct()
            members = members.join(taken, ["key", "id"], "left").withColumn("open", F.col("taken").isNull()).drop("taken")
        parts = lambda df: df.drop("part").join(label, F.col("id") == F.col("node"), "left").withColumn(
            "part", F.coalesce("component", "id")).drop("node", "component")
        rows = stored(_undecided(parts(members), threshold), "left-over")
        if not exact:
            some = stored(rows.groupBy("id").agg(F.max("open").alias("open")), "left-over-ids")
            if some.isEmpty():
                break
            rows = stored(_undecided(parts(_rare(_texts_of(texts, some), k, threshold)), threshold), "left-over")
        if rows.isEmpty():
            break
        hubs, exact = max(64, small) if not exact else hubs * 16, True
    classes = first.join(label, F.col("rep") == F.col("node"), "left").select(
        "norm", F.coalesce("component", "rep").alias("least"))
    return (made.select("id", "norm").join(classes, "norm", "left")
            .select(F.col("id").alias(id_col), F.when(F.col("id").isNotNull(), F.coalesce("least", "id")).alias("class_id")))
