"""Search, filters, sorting, paging and distinct values."""

from __future__ import annotations

import datetime as dt
from functools import reduce
from typing import Any, Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from talentgrid.functions.basics import any_of, non_empty
from talentgrid.functions.candidate import range_label
from talentgrid.session import cut_lineage

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def like_ascii_ci(c: Column, pattern: str) -> Column:
    """LIKE that ignores case for ASCII letters only; no escape character."""
    folded = pattern.translate(str.maketrans(_UPPER, _LOWER)).replace("\\", "\\\\")
    return F.translate(c, _UPPER, _LOWER).like(folded)


def search(df: DataFrame, cols: Iterable[str], term: str | None) -> DataFrame:
    """Rows where any column contains ``term``; ``%`` and ``_`` stay wildcards."""
    if not term:
        return df
    return df.filter(any_of(like_ascii_ci(F.col(c), f"%{term}%") for c in cols))


def filter_eq(df: DataFrame, **values: Any) -> DataFrame:
    """Equality per given column; a blank value filters nothing."""
    for column, value in values.items():
        if value is not None and value != "":
            df = df.filter(F.col(column) == value)
    return df


def list_filtered(df: DataFrame, filters: Mapping[str, Any] | None,
                  exact: Iterable[str], like: Iterable[str], order: str,
                  limit: int | None = None, offset: int = 0) -> DataFrame:
    """Optional AND filters: every matching row, unordered, or one page, newest first.

    An ``exact`` key applies whenever it is present, so a NULL value matches no
    row; a ``like`` key applies only when it has text.
    """
    filters = filters or {}
    for k in exact:
        if k in filters:
            df = df.filter(F.col(k) == F.lit(filters[k]))
    for k in like:
        if filters.get(k):
            df = df.filter(like_ascii_ci(F.col(k), f"%{filters[k]}%"))
    if limit is None and not offset:
        return df
    df = df.orderBy(F.col(order).desc(), F.col("id").desc()).offset(offset)
    return df if limit is None else df.limit(limit)


def list_resumes(resumes: DataFrame, filters: Mapping[str, Any] | None = None,
                 limit: int | None = None, offset: int = 0) -> DataFrame:
    return list_filtered(resumes, filters, ["parse_status"],
                         ["name", "applied_position"], "upload_time", limit, offset)


def list_interviews(interviews: DataFrame, filters: Mapping[str, Any] | None = None,
                    limit: int | None = None, offset: int = 0) -> DataFrame:
    return list_filtered(interviews, filters, ["resume_id", "status"], [],
                         "create_time", limit, offset)


def by_ids(df: DataFrame, ids: DataFrame | Iterable[int], key: str = "id") -> DataFrame:
    """Rows whose key is listed: IN for a typed list, semi join for a table."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(F.col(ids.columns[0]).alias(key)), key, "left_semi")
    return df.filter(F.col(key).isin(list(ids)))


def first_by(df: DataFrame, key: str, value: Any) -> DataFrame:
    """The matching row with the lowest id."""
    return df.filter(F.col(key) == value).orderBy("id").limit(1)


def between_ts(df: DataFrame, column: str, start: str | None, end: str | None) -> DataFrame:
    """Day range on a timestamp; the last instant counted is 23:59:59."""
    return df.filter(ts_in_range(F.col(column), start, end))


def ts_in_range(c: Column, start: str | None, end: str | None) -> Column:
    conds = [F.lit(True)]
    if start:
        conds.append(c >= F.lit(_day(start)))
    if end:
        conds.append(c <= F.lit(_day(end).replace(hour=23, minute=59, second=59)))
    return reduce(lambda a, b: a & b, conds)


def _day(text: str) -> dt.datetime:
    return dt.datetime.strptime(text, "%Y-%m-%d")


def bounds(c: Column, start: str | None, end: str | None) -> Column:
    """The plain comparisons of a text range, which a scan can use; unknown for NULL."""
    conds = ([c >= start] if start else []) + ([c <= end] if end else [])
    return reduce(lambda a, b: a & b, conds)


def str_in_range(c: Column, start: str | None, end: str | None) -> Column:
    """Lexicographic range on a date kept as text."""
    conds = [F.lit(True)]
    if start:
        conds.append(c.isNotNull() & (c >= start))
    if end:
        conds.append(c <= end)
    return F.coalesce(reduce(lambda a, b: a & b, conds), F.lit(False))


def between_str(df: DataFrame, column: str, start: str | None, end: str | None) -> DataFrame:
    return df.filter(str_in_range(F.col(column), start, end))


def visible_users(users: DataFrame, me: str) -> DataFrame:
    """Administrators see every account, others their own."""
    mine = users.filter(F.col("username") == me)
    admin = mine.filter(F.col("role") == "admin").select(F.lit(1).alias("is_admin")).limit(1)
    # the admin flag is one row at most: a scalar subquery, not a join of tables
    return users.filter((F.col("username") == me) | admin.scalar().isNotNull())


def sort_by(df: DataFrame, column: str = "upload_time", order: str = "desc") -> DataFrame:
    """Order by a user-chosen column; an unknown one leaves the rows unordered."""
    if column not in df.columns:
        return df
    c = F.col(column)
    return df.orderBy(c.desc() if order == "desc" else c.asc(), F.col("id").asc())


def page(df: DataFrame, number: int = 1, per_page: int = 10) -> DataFrame:
    """Page ``number`` (from 1) of an already ordered table."""
    return df.offset((max(number, 1) - 1) * per_page).limit(per_page)


def page_after(df: DataFrame, column: str, after: tuple[Any, Any] | None = None, per_page: int = 10,
               order: str = "desc") -> DataFrame:
    """The page that follows the row with the value and id ``after`` (None: the first page).

    The bound is a filter, so a page costs the same wherever it is: each task keeps ``per_page`` rows.  Nulls stand
    where Spark sorts them: last when descending, first when ascending; ids break ties upwards.
    """
    c, i = F.col(column), F.col("id")
    if after is not None:
        value, last = after
        if value is None:
            later = (c.isNull() & (i > last)) if order == "desc" else (c.isNotNull() | (i > last))
        else:
            beyond = c < F.lit(value) if order == "desc" else c > F.lit(value)
            later = beyond | ((c == F.lit(value)) & (i > last))
            later = (later | c.isNull()) if order == "desc" else later
        df = df.filter(later)
    return df.orderBy(c.desc() if order == "desc" else c.asc(), i.asc()).limit(per_page)


def page_at(df: DataFrame, column: str, number: int = 1, per_page: int = 10, order: str = "desc",
            ranges: int = 200) -> tuple[DataFrame, int]:
    """Page ``number`` (from 1) and the total number of rows, from one pass over sort key and id.

    The keys are dealt to ``ranges`` ranges of the order, stored, and counted; only the ranges that the page lies in are
    sorted, so no task holds all the rows before it.  ``id`` is unique.
    """
    sort = [F.col(column).desc() if order == "desc" else F.col(column).asc(), F.col("id").asc()]
    keys = cut_lineage(df.select(column, "id").repartitionByRange(ranges, *sort).withColumn("_range", F.spark_partition_id()))
    sizes = sorted((r["_range"], r["count"]) for r in keys.groupBy("_range").count().collect())
    begin = (max(number, 1) - 1) * per_page
    before, chosen, seen = 0, [], 0
    for part, size in sizes:
        if seen + size <= begin:
            before = seen + size
        elif seen < begin + per_page:
            chosen.append(part)
        seen += size
    near = keys.filter(F.col("_range").isin(chosen)).orderBy(*sort)
    wanted = (near.offset(begin - before) if begin > before else near).limit(per_page).select("id")
    return df.join(wanted, "id", "left_semi").orderBy(*sort), seen


def total_count(df: DataFrame) -> DataFrame:
    """Number of rows after the filters, beside which a page is shown."""
    return df.agg(F.count(F.lit(1)).alias("total"))


def latest_first(df: DataFrame, ts: str = "update_time") -> DataFrame:
    return df.orderBy(F.col(ts).desc(), F.col("id").asc())


def max_rows(df: DataFrame, n: int | None = None) -> DataFrame:
    """Optional cap; exports are whole unless a caller asks for fewer."""
    return df if n is None else df.limit(n)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-empty values of a column."""
    return df.select(column).filter(non_empty(F.col(column).cast("string"))).distinct()


def top_experiences(experience: DataFrame, n: int = 2, key: str = "resume_id", order: str = "seq") -> DataFrame:
    """``key, company1, time1, ..., company<n>, time<n>``: the first ``n`` experiences side by side.

    ``row_number() <= n`` is cut per task before the shuffle (window group limit).
    """
    rn = F.row_number().over(Window.partitionBy(key).orderBy(order))
    top = experience.withColumn("rn", rn).filter(F.col("rn") <= n).withColumn(
        "time", range_label(F.col("start_year"), F.col("end_year")))
    return top.groupBy(key).agg(*[
        F.coalesce(F.max(F.when(F.col("rn") == k, F.col(c))), F.lit("")).alias(f"{c}{k}")
        for k in range(1, n + 1) for c in ("company", "time")])


def keep_selected(selected: DataFrame, page_rows: DataFrame, key: str = "id") -> DataFrame:
    """Selected ids that are on the page."""
    return selected.select(key).join(page_rows.select(key), key, "left_semi").distinct()
