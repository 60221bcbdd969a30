"""Benchmark passages in documents: a prefix-filtered join, verified word by word. DataFrame functions only.

An item is cut into windows of ``width`` consecutive words. A document holds a window only if it holds all of its words, so
the window's rarest word (rarity is counted over all documents) is a necessary prefix: the one join key. A document word
that equals it fixes where the window would begin and end; positions outside the document go, then the second rarest word
must be at its place, then all words are compared. The words of a document stay in its row, and only true hits leave the
scan, so nothing of the texts is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentgrid.llm.common import small_enough, stored

WIDTH = 10
PREFIX_BYTES = 32 << 20
# What lies between words once A-Z are lower-cased, and the letters to lower.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; none for null."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(lowered, BETWEEN), "")


def item_windows(items: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(window, item_ids): each distinct window of ``width`` words, or of a shorter item's words, and the items that have it."""
    n = F.size("w")
    starts = F.when(n > width, F.sequence(F.lit(1), n - width + 1)).when(n > 0, F.array(F.lit(1)))
    cut = items.select(F.col(id_col).cast("string").alias("item_id"), words(F.col(text_col)).alias("w")).select(
        "item_id", "w", F.explode(starts).alias("at")).select("item_id", F.slice("w", F.col("at"), width).alias("window"))
    return cut.groupBy("window").agg(F.collect_set("item_id").alias("item_ids"))


def _found(docs: DataFrame, windows: DataFrame, part: int, parts: int) -> DataFrame:
    """(doc_id, own, start, size, item_ids) of every occurrence of the windows of one part."""
    own = windows if parts == 1 else windows.filter(F.pmod("token", F.lit(parts)) == part)
    begin = F.col("at") - F.col("place")
    fits = ((begin >= 0) & (begin + F.size("window") <= F.size("w"))
            & (F.element_at("w", begin + F.col("place2") + 1) == F.col("word2"))
            & (F.slice("w", begin + 1, F.size("window")) == F.col("window")))
    words_of = docs.select("doc_id", "own", "w", F.posexplode("w").alias("at", "word"))
    return (words_of.join(F.broadcast(own), F.xxhash64("word") == F.col("token")).filter(fits)
            .select("doc_id", "own", begin.alias("start"), F.size("window").alias("size"), "item_ids"))


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, doc_id: str = "doc_id", doc_text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", prefix_bytes: int = PREFIX_BYTES) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text_hash (xxhash64), n_words, n_hit, n_items, item_ids (sorted as strings), contaminated.

    A document word inside any occurrence of a window is hit. A null or wordless text has no words and no hits; so has an
    item. An item with a null id marks words but is not counted. Repeated items count once; repeated documents each get
    their row, a null id included. Either table may be empty. Other columns are not read, whatever their names.

    The windows are broadcast: ``prefix_bytes`` bounds what one pass over the documents carries, counted beforehand, and a
    larger set of windows takes several passes.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(doc_text).cast("string")).alias("own"),
                       words(F.col(doc_text)).alias("w"))
    windows = stored(item_windows(items, item_id, item_text, width), "windows")
    terms = windows.select(F.explode("window").alias("word")).distinct().select("word", F.xxhash64("word").alias("token"))
    terms = stored(terms, "window-words")
    tokens = terms.select("token").distinct()
    tokens = F.broadcast(tokens) if small_enough(terms, F.lit(32), prefix_bytes) else tokens
    counts = stored(docs.select(F.explode("w").alias("word")).select(F.xxhash64("word").alias("token"))
                    .join(tokens, "token").groupBy("token").agg(F.count("*").alias("seen")), "word-counts")
    rarity = terms.join(counts, "token", "left").select("word", "token", F.coalesce("seen", F.lit(0)).alias("seen"))
    rank = Window.partitionBy("window").orderBy("seen", "word", "place")
    ranked = (windows.select("window", F.posexplode("window").alias("place", "word")).join(rarity, "word")
              .withColumn("nth", F.row_number().over(rank)).filter("nth <= 2").groupBy("window")
              .agg(F.max(F.when(F.col("nth") == 1, F.col("token"))).alias("token"),
                   F.max(F.when(F.col("nth") == 1, F.col("place"))).alias("place"),
                   F.max(F.when(F.col("nth") == 1, F.col("seen"))).alias("seen"),
                   F.max(F.struct("nth", F.col("place").alias("place2"), F.col("word").alias("word2"))).alias("second")))
    prefixes = stored(ranked.filter("seen > 0").join(windows, "window").select(
        "token", "place", "second.place2", "second.word2", "window", "item_ids"), "prefixes")
    text_bytes = F.octet_length(F.concat_ws(" ", "window")) + F.octet_length(F.concat_ws(" ", "item_ids"))
    size = prefixes.agg(F.sum(text_bytes + 16 * (F.size("window") + F.size("item_ids")) + 64)).first()[0] or 0
    parts = -(-size // prefix_bytes) or 1
    hits = stored(reduce(DataFrame.union, [_found(docs, prefixes, i, parts) for i in range(parts)]), "hits")
    key = ["doc_id", "own"]
    places = hits.select(*key, "start", "size").distinct().select(
        *key, F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("at")).distinct()
    n_hit = places.groupBy(*key).agg(F.count("*").alias("n_hit"))
    ids = hits.select(*key, F.explode("item_ids").alias("item_id")).distinct().groupBy(*key).agg(
        F.array_sort(F.collect_list("item_id")).alias("item_ids"))
    found = n_hit.join(ids.withColumnsRenamed({"doc_id": "doc_id2", "own": "own2"}),
                       F.col("doc_id").eqNullSafe(F.col("doc_id2")) & (F.col("own") == F.col("own2")), "left")
    found = found.select(F.col("doc_id").alias("doc_id2"), F.col("own").alias("own2"), "n_hit", "item_ids")
    none = F.array().cast("array<string>")
    return (docs.select("doc_id", "own", F.size("w").cast("long").alias("n_words"))
            .join(found, F.col("doc_id").eqNullSafe(F.col("doc_id2")) & (F.col("own") == F.col("own2")), "left")
            .select("doc_id", F.col("own").alias("text_hash"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce(F.size(F.coalesce("item_ids", none)), F.lit(0)).cast("long").alias("n_items"),
                    F.coalesce("item_ids", none).alias("item_ids"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated")))
