"""Interview status derived from round results, offer and onboarding."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from talentgrid.functions.basics import non_empty, truthy


def interview_status(previous: Column | None = None) -> Column:
    """One CASE over the interview columns of the current row.

    Onboarding wins over an offer, an offer over the rounds.  A first round
    that is neither passed nor failed (a pending one) is decided by the second
    round, and a second round like that by the third; the third round counts
    even when it is not enabled.
    """
    r1, r2, r3 = (F.col(f"round{k}_result") for k in (1, 2, 3))
    onboarded = (truthy(F.col("onboard")) & non_empty(F.col("onboard_date"))
                 & non_empty(F.col("onboard_department")))
    offered = (truthy(F.col("offer_issued")) & non_empty(F.col("offer_date"))
               & non_empty(F.col("offer_department"))
               & non_empty(F.col("offer_onboard_plan_date")))
    third = truthy(F.col("round3_enabled"))
    kept = F.when(non_empty(previous), previous) if previous is not None else F.lit(None)
    return (F.when(onboarded, "已入职")
            .when(offered, "已发offer")
            .when(~non_empty(r1), "待面试")
            .when(r1 == "未通过", "一面面试未通过")
            .when(~non_empty(r2), "一面面试通过")
            .when(r2 == "未通过", "二面面试未通过")
            .when((r2 == "通过") & ~third, "面试通过")
            .when((r2 == "通过") & ~non_empty(r3), "二面面试通过")
            .when(r3 == "未通过", "三面面试未通过")
            .when(r3 == "通过", "面试通过")
            .otherwise(F.coalesce(kept.cast("string"), F.lit("待面试"))))
