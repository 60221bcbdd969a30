"""Hiring funnel: totals, per position, rates.

Both tables are reduced to one narrow row layout (position plus five 0/1
flags) and united, so a funnel is a single aggregation with map-side partial
sums: no join, no cross join, one shuffle of one row per position and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from talentgrid import vocab
from talentgrid.functions.basics import any_of, non_empty
from talentgrid.operators.listing import bounds, str_in_range, ts_in_range

COUNTS = ["resume_count", "interview_count", "pass_count", "offer_count", "onboard_count"]


def _flags(resumes: DataFrame, interviews: DataFrame, start: str | None,
           end: str | None) -> DataFrame:
    def num(c: Column) -> Column:
        return F.coalesce(c, F.lit(False)).cast("long")

    if start or end:  # rows outside every range count for nothing; the bounds reach the scans
        resumes = resumes.filter(ts_in_range(F.col("upload_time"), start, end))
        within = [bounds(F.col(c), start, end) for c in ("round1_time", "offer_date", "onboard_date")]
        interviews = interviews.filter(any_of([*within, ts_in_range(F.col("create_time"), start, end)]))
    zero = F.lit(0).cast("long")
    position = F.col("applied_position").alias("position")
    a = resumes.select(
        position, num(ts_in_range(F.col("upload_time"), start, end)).alias(COUNTS[0]),
        *[zero.alias(c) for c in COUNTS[1:]])
    issued = (F.col("offer_issued") == 1) & non_empty(F.col("offer_date"))
    joined = (F.col("onboard") == 1) & non_empty(F.col("onboard_date"))
    b = interviews.select(
        position, zero.alias(COUNTS[0]),
        # a NULL first-round date is out once a bound is given; '' passes an upper bound
        num(str_in_range(F.col("round1_time"), start, end)).alias(COUNTS[1]),
        num(F.col("status").isin(vocab.PASS_STATUSES)
            & ts_in_range(F.col("create_time"), start, end)).alias(COUNTS[2]),
        num(issued & str_in_range(F.col("offer_date"), start, end)).alias(COUNTS[3]),
        num(joined & str_in_range(F.col("onboard_date"), start, end)).alias(COUNTS[4]))
    return a.unionByName(b)


def funnel_total(resumes: DataFrame, interviews: DataFrame, start: str | None = None,
                 end: str | None = None, position: str | None = None) -> DataFrame:
    """Five counts, each on its own time column; blank positions included."""
    flags = _flags(resumes, interviews, start, end)
    if position:
        flags = flags.filter(F.col("position") == position)
    return flags.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS])


def funnel_by_position(resumes: DataFrame, interviews: DataFrame, start: str | None = None,
                       end: str | None = None) -> DataFrame:
    """The counts per position that has a résumé or a first round in range."""
    flags = _flags(resumes, interviews, start, end).filter(non_empty(F.col("position")))
    grouped = flags.groupBy("position").agg(*[F.sum(c).alias(c) for c in COUNTS])
    active = (F.col("resume_count") > 0) | (F.col("interview_count") > 0)
    return grouped.filter(active).orderBy("position")


def active_positions(resumes: DataFrame, interviews: DataFrame, start: str | None = None,
                     end: str | None = None) -> DataFrame:
    """Distinct non-empty positions of résumés and interviews in range."""
    r = resumes.filter(ts_in_range(F.col("upload_time"), start, end))
    i = interviews.filter(str_in_range(F.col("round1_time"), start, end))
    both = r.select("applied_position").union(i.select("applied_position"))
    return both.filter(non_empty(F.col("applied_position"))).distinct()


def funnel_rates(funnel: DataFrame) -> DataFrame:
    """Each stage as a percentage of the résumés, one decimal, ``0.0`` without any."""
    base = F.col("resume_count")
    for c in COUNTS[1:]:
        rate = F.when(base > 0, F.format_string("%.1f", F.col(c) / base * 100)).otherwise("0.0")
        funnel = funnel.withColumn(c.replace("_count", "_rate"), rate)
    return funnel
