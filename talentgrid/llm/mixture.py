"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame functions only.

Each source is a stream: its documents, shuffled by a hash, laid end to end and cut into blocks of equal numbers of words. The
mix is a schedule of slots, a block each. Sources stand side by side on the unit interval, each as wide as the slots that fill
its target; the van der Corput point of slot i (its binary digits reversed behind the point) falls into one of them and so
names the source. Any run of slots thereby holds every source close to its weight. The k-th slot of a source takes block k of
its stream, beginning anew when the stream has been read; the last slot takes only what the target lacks.

Running numbers (words before a document, slots before a slot) come from sums of chunks, so one source may hold any share of
the documents: no task orders more than one chunk of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentgrid.llm.common import small_enough, stored

BLOCK_WORDS, MOST_REPEATS, WEIGHTS = 1024, 3, (5, 2, 1)
#: A source's documents are dealt to 16 ** 3 chunks of equal hashes' beginnings, its slots to as many spans of time.
CHUNK_DIGITS = 3
# Fixed value: what lies between words.
BLANK = r"[\x20\x09-\x0D]+"


def size_in_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), BLANK), "")).cast("long")


def _before(rows: DataFrame, chunk: Column, order: list, value: Column) -> DataFrame:
    """``rows`` of sources ``s`` with ``before``: the values of the source's rows that come earlier by chunk, then order."""
    rows = rows.withColumn("chunk", chunk)
    sums = rows.groupBy("s", "chunk").agg(F.sum(value).alias("sum"))
    earlier = Window.partitionBy("s").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("s", "chunk", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("chunks_before"))
    own = Window.partitionBy("s", "chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (rows.withColumn("before", F.coalesce(F.sum(value).over(own), F.lit(0))).join(sums, ["s", "chunk"])
            .withColumn("before", F.col("before") + F.col("chunks_before")).drop("chunk", "chunks_before"))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """Of (source, n), n its words: (s, source, n, target), s numbering the sources by code point, null last.

    Weights repeat along that order and share the words of all sources; a target stops at ``most`` times its source, and what
    is over is shared by weight until none is above: every target is least(most * n, level * weight), and the level is found
    in order of the ratio at which sources stop. The windows hold one narrow row for each source.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("s") % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("s", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    rows = rows.withColumn("w", weight).withColumn("cap", most * F.col("n"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "s")
    to_here, from_here = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    rows = rows.withColumn("level", (F.sum("n").over(every) - F.coalesce(F.sum("cap").over(to_here), F.lit(0))).cast("double")
                           / F.sum("w").over(from_here))
    first = F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct(F.col("cap") / F.col("w"), "s", "level"))).over(every)
    return rows.select("s", "source", "n", F.least(F.col("cap").cast("double"), first["level"] * F.col("w")).alias("target"))


def schedule(sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The slots of the mix: (position, s, epoch, block, until). Positions order the slots, with gaps; a slot takes the words of
    its block that lie before word ``until`` of the source's stream."""
    whole = F.floor("target")
    rows = sources.filter("n > 0 AND floor(target) > 0").withColumns({
        "blocks": F.ceil(F.col("n") / block_words), "epochs": F.floor(whole / F.col("n")).cast("long")})
    rows = rows.withColumn("rest", whole - F.col("epochs") * F.col("n"))
    rows = rows.withColumn("slots", F.col("epochs") * F.col("blocks") + F.ceil(F.col("rest") / block_words))
    before = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    rows = stored(rows.withColumn("first", F.coalesce(F.sum("slots").over(before), F.lit(0))), "sources-slots")
    digits = max(((rows.agg(F.sum("slots")).first()[0] or 1) - 1).bit_length(), 1)
    parts = rows.select("s", "n", "blocks", "epochs", "rest", "first", "slots",
                        F.explode(F.sequence(F.lit(0), F.floor((F.col("slots") - 1) / 4096))).alias("part")).repartition("s", "part")
    at = F.explode(F.sequence(F.col("first") + F.col("part") * 4096,
                              F.col("first") + F.least(F.col("slots"), (F.col("part") + 1) * 4096) - 1))
    reversed_ = F.conv(F.reverse(F.lpad(F.bin("point"), digits, "0")), 2, 10).cast("long")
    slots = parts.select("s", "n", "blocks", "epochs", "rest", at.alias("point")).withColumn("position", reversed_).drop("point")
    slots = _before(slots, F.floor(F.col("position") / (1 << max(digits - 12, 0))), ["position"], F.lit(1))
    epoch = F.floor(F.col("before") / F.col("blocks"))
    return slots.select("position", "s", epoch.alias("epoch"), (F.col("before") % F.col("blocks")).alias("block"),
                        F.when(epoch < F.col("epochs"), F.col("n")).otherwise(F.col("rest")).alias("until"))


def _streams(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple, most: int) -> tuple[DataFrame, DataFrame]:
    """(documents with s, source, size, begin, source_size, target; sources)."""
    text = F.col(text_col).cast("string")
    order = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("\n"), F.coalesce(F.md5(text.cast("binary")), F.lit(""))).cast("binary"))
    sized = stored(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                               size_in_words(text).alias("size"), order.alias("order")), "sizes")
    sources = stored(source_targets(sized.groupBy("source").agg(F.sum("size").alias("n")), weights, most), "sources")
    of = sources.select("s", F.col("source").alias("source_"), F.col("n").alias("source_size"), "target")
    of = F.broadcast(of) if small_enough(sources, F.coalesce(F.octet_length("source"), F.lit(0)) + 32) else of
    rows = sized.join(of, F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    rows = _before(rows, F.substring("order", 1, CHUNK_DIGITS), ["order"], F.col("size"))
    return stored(rows.withColumnRenamed("before", "begin"), "streams"), sources


def _pieces(rows: DataFrame, slots: DataFrame, block_words: int) -> DataFrame:
    """Each row of a document with each slot that takes words of it: those from word ``first_word`` on, ``words`` of them."""
    end = F.col("begin") + F.col("size")
    cut = rows.filter("size > 0").withColumn("block", F.explode(F.sequence(
        F.floor(F.col("begin") / block_words), F.floor((end - 1) / block_words))))
    low = F.greatest("begin", F.col("block") * block_words)
    words = F.least(end, (F.col("block") + 1) * block_words, F.col("until")) - low
    return (cut.join(slots, ["s", "block"]).withColumns({"first_word": low - F.col("begin"), "words": words})
            .filter("words > 0"))


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS,
            most: int = MOST_REPEATS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix: (position, nth, source, epoch, doc_id, first_word, words), the words of each slot in order of position, nth.

    Words are runs of characters other than blank, tab and line ends; a null text has none, and neither it nor an empty one is
    in the mix. A null source is a source, the last. Repeated rows are documents of their own. Rows are ordered within their
    source by a hash of id and text, so reruns agree. An empty table gives an empty mix. Other columns are not read.
    """
    rows, sources = _streams(docs, id_col, text_col, source_col, weights, most)
    found = _pieces(rows, schedule(sources, block_words), block_words)
    nth = F.row_number().over(Window.partitionBy("position").orderBy("begin"))
    return found.select("position", nth.alias("nth"), "source", "epoch", "doc_id", "first_word", "words")


def mixture_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                   weights: tuple = WEIGHTS, most: int = MOST_REPEATS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each row of ``docs``: (doc_id, source, size, source_size, target, taken), taken the words that the slots of
    ``mixture`` take of it, repeats counted. Each source's taken words are its target without the fraction."""
    rows, sources = _streams(docs, id_col, text_col, source_col, weights, most)
    found = _pieces(rows, schedule(sources, block_words), block_words)
    # no two rows of a source that have words begin at the same word
    taken = found.groupBy("s", "begin").agg(F.sum("words").alias("taken")).select("s", "begin", F.lit(True).alias("some"), "taken")
    rows = rows.withColumn("some", F.col("size") > 0)
    return rows.join(taken, ["s", "begin", "some"], "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
