"""Repeated lines, exact or one edit apart, over all documents; the earliest stays. DataFrame functions only.

Lines are told apart by a 128-bit hash of their trimmed text, so the texts themselves are not shuffled to find equal ones.
For lines one edit apart each emits its deletion neighbourhood, the line without its i-th character, as hashes:

* two lines with the same variant at the same i differ in character i only;
* a line that equals another's variant lacks one of its characters.

A variant is emitted only where a partner may be. One edit leaves the first or the second half of a line as it is, so a line
whose four half-line hashes occur nowhere else has none. The others are cut in segments of about the square root of their
length; a partner agrees with all but one of them, so only a segment whose surroundings another line shares gives variants,
and these are hashes of the surroundings and of the segment without a character. That way a line of any length costs little.
A group of equal variants is reduced to its earliest line, so no group is expanded into pairs, and a line's earliest partner
is verified by edit distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentgrid.llm.common import small_enough, stored

MIN_NEAR = 24
FIRST = ["doc_id", "own", "line_no"]
LINE = ["a", "b"]


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, own, line_no, a, b, line) of every line that is not blank."""
    return (docs.select("doc_id", "own", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
            .withColumn("line", F.trim("line")).filter("line <> ''")
            .withColumns({"a": F.xxhash64("line"), "b": F.xxhash64(F.lit(1), "line")}))


def _halves() -> list:
    """Hashes of the line's halves, as the longer or the shorter of two lines one edit apart: (shorter's length, side, half)."""
    n, out = F.length("line"), []
    for base in (n, n - 1):
        half = F.floor(base / 2).cast("int")
        out.append(F.xxhash64(F.lit(0), base, F.substring(F.col("line"), F.lit(1), half)))
        out.append(F.xxhash64(F.lit(1), base, F.substring(F.col("line"), n - base + half + 1, base)))
    return out


def _segments(n: Column) -> tuple[Column, Column]:
    """Segments of a line, as the shorter or equal and as the longer of two lines: (role, base, at, size), base the shorter's
    length; ``at`` characters stand before a segment, and in the longer line it is one longer."""
    def of(role: int, base: Column) -> Column:
        width = F.ceil(F.sqrt(base)).cast("int")
        cut = lambda j: F.struct(F.lit(role).alias("role"), base.alias("base"), (j * width).alias("at"),
                                 (F.least(width, base - j * width) + role).alias("size"))
        return F.when(base > 0, F.transform(F.sequence(F.lit(0), F.floor((base - 1) / width).cast("int")), cut)).otherwise(F.array())
    return of(0, n), of(1, n - 1)


def _near(docs: DataFrame, distinct: DataFrame, min_near: int) -> DataFrame:
    """(a, b) of the distinct lines that an earlier one is within one edit of."""
    halves = distinct.filter(F.col("n") >= min_near - 1).select(*LINE, F.explode(F.array("k0", "k1", "k2", "k3")).alias("half"))
    busy = stored(halves.groupBy("half").agg(F.count("*").alias("lines")).filter("lines > 1").select("half"), "shared-halves")
    able = halves.join(busy, "half").select(*LINE).distinct()
    able = stored(distinct.join(able, LINE).select(*LINE, *[F.col(f"first.{c}").alias(c) for c in FIRST]), "able-lines")
    where = F.broadcast(able) if small_enough(able, F.lit(64)) else able
    at = where.select(*[F.col(c).alias(f"{c}_") for c in [*FIRST, *LINE]])
    same = (F.col("doc_id").eqNullSafe(F.col("doc_id_")) & (F.col("own") == F.col("own_"))
            & (F.col("line_no") == F.col("line_no_")) & (F.col("a") == F.col("a_")))
    texts = stored(_lines(docs).join(at, same, "left_semi").dropDuplicates(LINE)
                   .withColumns({"n": F.length("line"), "first": F.struct(*FIRST)}), "able-texts").select(*LINE, "line", "n", "first")
    cut = texts.select(*LINE, "line", "n", F.explode(F.concat(*_segments(F.col("n")))).alias("cut"))
    cut = cut.select(*LINE, "n", "cut", F.xxhash64(
        "cut.base", "cut.at", F.substring(F.col("line"), F.lit(1), F.col("cut.at")),
        F.substring(F.col("line"), F.col("cut.at") + F.col("cut.size") + 1, F.col("n"))).alias("around"))
    # a line is near another of its length from min_near characters on, a shorter one if the longer has as many
    cut = stored(cut.filter(F.col("n") - F.col("cut.role") >= min_near - 1), "segments")
    equal, longer = F.sum(F.when(F.col("cut.role") == 0, 1).otherwise(0)), F.sum("cut.role")
    shared = cut.groupBy("around").agg(equal.alias("equal"), longer.alias("longer")).filter("equal > 0 AND equal + longer > 1")
    shared = stored(cut.join(shared, "around").select(*LINE, "n", "cut", "around", "equal", "longer"), "shared-segments")
    shared = shared.join(texts.select(*LINE, "line", "first"), LINE).withColumn(
        "segment", F.substring(F.col("line"), F.col("cut.at") + 1, F.col("cut.size")))
    row = lambda side, *parts: F.struct(F.lit(side).alias("side"), F.xxhash64("around", F.lit(min(side, 1)), *parts).alias("variant"))
    without = lambda side, *place: F.transform(F.sequence(F.lit(1), F.col("cut.size")), lambda i: row(
        side, *[i for _ in place], F.concat(F.substring(F.col("segment"), F.lit(1), i - 1), F.substring(F.col("segment"), i + 1, F.col("cut.size")))))
    none = F.array().cast("array<struct<side:int,variant:bigint>>")
    changed = F.when((F.col("cut.role") == 0) & (F.col("equal") > 1) & (F.col("n") >= min_near), without(0, "place")).otherwise(none)
    lacking = F.when((F.col("cut.role") == 0) & (F.col("longer") > 0), F.array(row(1, "segment"))).otherwise(none)
    having = F.when(F.col("cut.role") == 1, without(2)).otherwise(none)
    rows = stored(shared.select(*LINE, "first", F.explode(F.concat(changed, lacking, having)).alias("v")).select(*LINE, "first", "v.*"), "variants")
    groups = rows.groupBy("variant").agg(F.count("*").alias("lines"), F.min(F.when(F.col("side") < 2, F.col("first"))).alias("short_or_equal"),
                                         F.min(F.when(F.col("side") == 2, F.col("first"))).alias("longer")).filter("lines > 1")
    other = F.when(F.col("side") == 1, F.col("longer")).otherwise(F.col("short_or_equal"))
    earliest = rows.join(groups, "variant").withColumn("other", other).filter("other < first").groupBy(*LINE).agg(F.min("other").alias("other"))
    check = earliest.join(texts.select(*LINE, "line"), LINE).join(
        texts.select(F.col("first").alias("other"), F.col("line").alias("line2")), "other")
    return check.filter(F.levenshtein("line", "line2", 1).between(0, 1)).select(*LINE).distinct()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = 1,
                min_near: int = MIN_NEAR) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text_col``, and n_lines, n_removed (long) added.

    Lines end at line feeds and are compared without blanks at their ends; blank lines stay. A line goes if an equal line
    comes earlier, in order of id, then line number, or if an earlier line, kept or not, is within ``max_edits`` (0 or 1)
    insertions, deletions or changes of a character and one of the two has ``min_near`` characters or more: in short lines
    one edit is another word (``min_near`` 0 takes lines of any length). A null text stays null (0 lines); an empty one has one blank line. A null id comes first. Rows
    with the same id and text are one document and get the same result; rows with the same id only are ordered by a hash of
    their text. Columns of ``docs`` pass through; none may be called n_lines or n_removed, or they are replaced.
    """
    if max_edits not in (0, 1):
        raise ValueError("max_edits is 0 or 1")
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    narrow = narrow.withColumn("own", F.xxhash64("text"))
    lines = _lines(narrow)
    keys = dict(zip(("k0", "k1", "k2", "k3"), _halves()))
    distinct = stored(lines.withColumns(keys | {"n": F.length("line")}).groupBy(*LINE).agg(
        F.min(F.struct(*FIRST)).alias("first"), F.count("*").alias("times"), F.first("n").alias("n"),
        *[F.first(k).alias(k) for k in keys]), "distinct-lines")
    gone = distinct.filter("times > 1").select(*LINE, "first", F.lit(False).alias("near"))
    if max_edits:
        near = stored(_near(narrow, distinct, min_near), "near-lines").withColumn("near", F.lit(True))
        gone = distinct.join(near, LINE, "left").filter("times > 1 OR near").select(
            *LINE, "first", F.coalesce("near", F.lit(False)).alias("near"))
    gone = stored(gone, "repeated-lines")
    marked = F.broadcast(gone) if small_enough(gone, F.lit(64)) else gone
    removed = stored(lines.select(*FIRST, *LINE).join(marked, LINE).filter(F.col("near") | (F.struct(*FIRST) != F.col("first")))
                     .groupBy("doc_id", "own").agg(F.collect_set("line_no").alias("removed")), "removed-lines")
    cut = F.broadcast(removed) if small_enough(removed, 8 * F.size("removed") + 64) else removed
    cut = cut.select(F.col("doc_id").alias("__id"), F.col("own").alias("__own"), F.col("removed").alias("__removed"))
    text, every = F.col(text_col).cast("string"), F.split(F.col(text_col).cast("string"), "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__removed"))
    out = docs.drop("n_lines", "n_removed").join(cut, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__own")), "left")
    out = out.withColumn("__lines", F.when(text.isNotNull(), every))
    return out.withColumns({
        text_col: F.when(F.col("__removed").isNull(), text).otherwise(
            F.array_join(F.transform(kept, lambda i: F.col("__lines")[i]), "\n")),
        "n_lines": F.coalesce(F.size("__lines"), F.lit(0)).cast("long"),
        "n_removed": F.coalesce(F.size("__removed"), F.lit(0)).cast("long"),
    }).withColumn("n_lines", F.greatest("n_lines", F.lit(0))).withColumn("n_removed", F.greatest("n_removed", F.lit(0))).drop(
        "__id", "__own", "__removed", "__lines")
