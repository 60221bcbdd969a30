"""Interview operators: joins with résumés, creation, tokens, updates.

Joins carry no broadcast hint: résumés and interviews grow with the data, so
AQE decides from measured sizes, and splits a résumé id that is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from talentgrid.functions.basics import blank_to_null, non_empty, strip_ws, truthy
from talentgrid.functions.candidate import identity_code
from talentgrid.functions.status import interview_status
from talentgrid.operators.listing import like_ascii_ci

ROUND_FIELDS = ["interviewer", "time", "result", "comment"]


def _owners(resumes: DataFrame) -> DataFrame:
    """The three résumé columns interviews look up."""
    return resumes.select(F.col("id").alias("resume_id"), F.col("name").alias("_r_name"),
                          F.col("phone").alias("_r_phone"),
                          F.lit(True).alias("_r_found"))


def interview_list(interviews: DataFrame, resumes: DataFrame,
                   search: str | None = None, newest_first: bool = False) -> DataFrame:
    """Interviews with refreshed name and identity code, on request newest update first.

    The search looks at the interview's own name.  A stored code wins; else it
    is built from the résumé, else it is the interview's name.
    """
    df = interviews
    if search and search.strip():
        term = f"%{search.strip()}%"
        df = df.filter(like_ascii_ci(F.col("name"), term)
                       | like_ascii_ci(F.col("applied_position"), term))
    owned = non_empty(F.col("_r_name"))
    code = (F.when(non_empty(F.col("identity_code")), F.col("identity_code"))
            .when(owned, identity_code(F.col("_r_name"), F.col("_r_phone")))
            .when(non_empty(F.col("name")), F.col("name")))
    # the code looks at the name before it is refreshed: both are set at once
    joined = df.join(_owners(resumes), "resume_id", "left")
    out = joined.withColumns({
        "identity_code": code,
        "name": F.when(owned, F.col("_r_name")).otherwise(F.col("name"))})
    out = out.select(*interviews.columns)
    return out.orderBy(F.col("update_time").desc(), F.col("id")) if newest_first else out


def interview_detail(interviews: DataFrame, resumes: DataFrame, interview_id: int) -> DataFrame:
    """One interview as the list shows it."""
    return interview_list(interviews.filter(F.col("id") == interview_id), resumes)


def by_identity(interviews: DataFrame, resumes: DataFrame, code: str) -> DataFrame:
    """Interview with the lowest id whose stored code equals ``code``; name refreshed."""
    hit = (interviews.filter(F.col("identity_code") == code.strip())
           .orderBy("id").limit(1))
    out = hit.join(_owners(resumes), "resume_id", "left").withColumn(
        "name", F.coalesce(blank_to_null(F.col("_r_name")), F.col("name")))
    return out.select(*interviews.columns)


def resolve_tokens(interviews: DataFrame, tokens: DataFrame | None = None,
                   columns: tuple[str, ...] = ("round1_comment_token", "round2_comment_token",
                                               "round3_comment_token")) -> DataFrame:
    """``token, id, round`` with the earliest round, then the lowest id, per token."""
    rounds = F.explode(F.array(*[
        F.struct(F.lit(k).alias("round"), F.col(c).alias("token"))
        for k, c in enumerate(columns, 1)])).alias("r")
    long = interviews.select("id", rounds).select("id", "r.round", "r.token").filter(
        non_empty(F.col("token")))
    if tokens is not None:
        long = long.join(tokens.select("token").distinct(), "token", "left_semi")
    best = long.groupBy("token").agg(F.min(F.struct("round", "id")).alias("m"))
    return best.select("token", F.col("m.id").alias("id"), F.col("m.round").alias("round"))


def resolve_token(interviews: DataFrame, token: str, **kw) -> DataFrame:
    cols = kw.get("columns", ("round1_comment_token", "round2_comment_token",
                              "round3_comment_token"))
    hits = interviews.filter(F.lit(token.strip()).isin(*[F.col(c) for c in cols]))
    return resolve_tokens(hits, **kw).filter(F.col("token") == token.strip()).select("id", "round")


def first_position_texts(positions: DataFrame) -> DataFrame:
    """One row per position name: the one with the lowest id."""
    texts = [c for c in ("work_content", "job_requirements", "core_requirements")
             if c in positions.columns]
    best = positions.groupBy("position_name").agg(
        F.min_by(F.struct("id", *texts), F.col("id")).alias("p"))
    return best.select(F.col("position_name"), F.col("p.id").alias("position_id"),
                       *[F.col(f"p.{t}").alias(t) for t in texts])


def with_position(resumes: DataFrame, positions: DataFrame) -> DataFrame:
    """Résumés with the texts of the position they apply for; missing → ``未填写``."""
    p = first_position_texts(positions)
    out = resumes.join(p, resumes["applied_position"] == p["position_name"], "left")
    texts = [c for c in p.columns if c not in ("position_name", "position_id")]
    return out.withColumns({t: F.coalesce(blank_to_null(F.col(t)), F.lit("未填写")) for t in texts})


def with_invited(resumes: DataFrame, interviews: DataFrame) -> DataFrame:
    """Résumés with ``invited``: is there any interview for them?"""
    ids = interviews.select(F.col("resume_id").alias("id")).distinct().withColumn(
        "_hit", F.lit(True))
    return resumes.join(ids, "id", "left").withColumn(
        "invited", F.col("_hit").isNotNull()).drop("_hit")


def dependants(resumes: DataFrame, interviews: DataFrame) -> DataFrame:
    """Number of interviews that point at each résumé."""
    counts = interviews.groupBy(F.col("resume_id").alias("id")).agg(
        F.count(F.lit(1)).alias("interview_count"))
    return resumes.select("id").join(counts, "id", "left").fillna(0, ["interview_count"])


def orphans(interviews: DataFrame, resumes: DataFrame) -> DataFrame:
    """Interviews whose résumé is gone."""
    return interviews.join(resumes.select(F.col("id").alias("resume_id")), "resume_id", "left_anti")


def create_interviews(requests: DataFrame, resumes: DataFrame,
                      user: str = "system") -> tuple[DataFrame, DataFrame]:
    """New interviews for ``requests(resume_id, match_score, match_level)`` and the rejects.

    The résumé's own score is carried over only when none is given and it was
    computed for the position still applied for.
    """
    r = resumes.select(
        F.col("id").alias("resume_id"), "name", "phone", "applied_position",
        F.col("match_score").alias("_ms"), F.col("match_level").alias("_ml"),
        F.col("match_position").alias("_mp"))
    joined = requests.join(r, "resume_id")
    carry = (~truthy(F.col("match_score")) & truthy(F.col("_ms")) & non_empty(F.col("_mp"))
             & (F.col("_mp") == F.coalesce(F.col("applied_position"), F.lit(""))))
    carry = F.coalesce(carry, F.lit(False))
    made = joined.select(
        "resume_id", F.coalesce("name", F.lit("")).alias("name"),
        F.coalesce("applied_position", F.lit("")).alias("applied_position"),
        identity_code(F.col("name"), F.col("phone")).alias("identity_code"),
        F.when(carry, F.col("_ms")).otherwise(F.col("match_score")).alias("match_score"),
        F.when(carry, F.col("_ml")).otherwise(F.col("match_level")).alias("match_level"),
        F.lit("待面试").alias("status"),
        F.lit(user).alias("created_by"), F.lit(user).alias("updated_by"))
    rejected = requests.join(r.select("resume_id"), "resume_id", "left_anti")
    return made, rejected


def propagate_match(interviews: DataFrame, analyses: DataFrame, user: str = "system") -> DataFrame:
    """Write ``analyses(resume_id, applied_position, match_score, match_level)`` to the
    interviews of the same résumé and position."""
    a = analyses.groupBy("resume_id", "applied_position").agg(
        F.max(F.struct("match_score", "match_level")).alias("_new"))
    hit = F.col("_new").isNotNull()
    out = interviews.join(a, ["resume_id", "applied_position"], "left")
    new = {"match_score": F.when(hit, F.col("_new.match_score")),
           "match_level": F.when(hit, F.col("_new.match_level")),
           "analyzed_by": F.when(hit, F.lit(user)), "updated_by": F.when(hit, F.lit(user))}
    for c, v in new.items():
        old = F.col(c) if c in interviews.columns else F.lit(None).cast("string")
        out = out.withColumn(c, F.when(hit, v).otherwise(old))
    return out.select(*dict.fromkeys(interviews.columns + list(new)))


def propagate_position(resumes: DataFrame, updates: DataFrame) -> DataFrame:
    """Write back ``updates(resume_id, applied_position, position_given)``.

    A given but empty position becomes NULL, one not given changes nothing.
    """
    u = updates.filter("position_given").groupBy(F.col("resume_id").alias("id")).agg(
        F.max(F.struct(blank_to_null(F.col("applied_position")).alias("p"))).alias("_u"))
    return resumes.join(u, "id", "left").withColumn(
        "applied_position", F.when(F.col("_u").isNotNull(), F.col("_u.p"))
        .otherwise(F.col("applied_position"))).select(*resumes.columns)


# fields a full update writes; one that is absent from the request becomes NULL
FULL_UPDATE_FIELDS = (
    [f"round{k}_{f}" for k in (1, 2, 3) for f in ("interviewer", "time", "result", "comment",
                                                 "ai_result")]
    + ["offer_date", "offer_department", "offer_onboard_plan_date",
       "onboard_date", "onboard_department"])
FLAG_FIELDS = ["round3_enabled", "offer_issued", "onboard"]


def update_interviews(interviews: DataFrame, updates: DataFrame, resumes: DataFrame,
                      user: str = "system") -> DataFrame:
    """Full update of the interviews named in ``updates`` (one row per id).

    Missing columns of ``updates`` are read as absent keys.  Flags become 0/1,
    the position changes only when given, name, code and status are derived.
    """
    given = [c for c in updates.columns if c != "id"]
    u = updates.select("id", F.struct(*[F.col(c) for c in given]).alias("_u"))
    out = (interviews.join(u, "id", "left").join(_owners(resumes), "resume_id", "left"))
    hit = F.col("_u").isNotNull()

    def new(field: str) -> Column:
        return F.col(f"_u.{field}") if field in given else F.lit(None)

    sets: dict[str, Column] = {}
    for f in FULL_UPDATE_FIELDS:
        if f in interviews.columns:
            sets[f] = F.when(hit, new(f).cast(interviews.schema[f].dataType)).otherwise(F.col(f))
    for f in FLAG_FIELDS:
        flag = truthy(new(f).cast("int")).cast("int")
        sets[f] = F.when(hit, flag).otherwise(F.col(f))
    if "applied_position" in given:
        p = F.col("_u.applied_position")
        sets["applied_position"] = F.when(hit & p.isNotNull(), blank_to_null(p)).otherwise(
            F.col("applied_position"))
    owned = non_empty(F.col("_r_name"))
    code = F.when(owned, identity_code(F.col("_r_name"), F.col("_r_phone"))).otherwise(
        F.coalesce(blank_to_null(F.col("identity_code")), blank_to_null(F.col("name"))))
    sets["identity_code"] = F.when(hit, code).otherwise(F.col("identity_code"))
    sets["name"] = F.when(hit & owned, F.col("_r_name")).otherwise(F.col("name"))
    if "updated_by" in interviews.columns:
        sets["updated_by"] = F.when(hit, F.lit(user)).otherwise(F.col("updated_by"))
    out = out.withColumns(sets)
    return out.withColumn(
        "status", F.when(hit, interview_status(F.col("status"))).otherwise(F.col("status"))
    ).select(*interviews.columns)


def update_positions(positions: DataFrame, updates: DataFrame, now: Column | None = None,
                     user: str = "system") -> DataFrame:
    """Full update of positions: a name is required, other texts are trimmed or NULL."""
    texts = ["work_content", "job_requirements", "core_requirements"]
    name = strip_ws(F.col("position_name"))
    u = updates.filter(non_empty(name)).select("id", F.struct(
        name.alias("position_name"),
        *[(blank_to_null(strip_ws(F.col(t))) if t in updates.columns
           else F.lit(None).cast("string")).alias(t) for t in texts]).alias("_u"))
    out = positions.join(u, "id", "left")
    hit = F.col("_u").isNotNull()
    sets = {f: F.when(hit, F.col(f"_u.{f}")).otherwise(F.col(f))
            for f in ["position_name", *texts] if f in positions.columns}
    if "update_time" in positions.columns:
        sets["update_time"] = F.when(hit, now if now is not None else F.current_timestamp()
                                     ).otherwise(F.col("update_time"))
    if "updated_by" in positions.columns:
        sets["updated_by"] = F.when(hit, F.lit(user)).otherwise(F.col("updated_by"))
    return out.withColumns(sets).select(*positions.columns)


def submit_rounds(interviews: DataFrame, submissions: DataFrame) -> DataFrame:
    """Apply ``submissions(token, interviewer, time, result, comment)`` and rederive status.

    A token resolves to one round of one interview.  With several submissions
    for a round the largest (time, result, ...) is kept, so the result does not
    depend on task order.
    """
    where = resolve_tokens(interviews, submissions)
    per_round = (submissions.join(where, "token")
                 .groupBy("id", "round")
                 .agg(F.max(F.struct(*[strip_ws(F.coalesce(F.col(f), F.lit(""))).alias(f)
                                       for f in ("time", "result", "interviewer", "comment")]))
                      .alias("s")))
    wide = per_round.groupBy("id").agg(*[
        F.max(F.when(F.col("round") == k, F.col("s"))).alias(f"_s{k}") for k in (1, 2, 3)])
    out = interviews.join(wide, "id", "left")
    sets = {}
    for k in (1, 2, 3):
        for f in ROUND_FIELDS:
            c = f"round{k}_{f}"
            if c in interviews.columns:
                sets[c] = F.when(F.col(f"_s{k}").isNotNull(), F.col(f"_s{k}.{f}")).otherwise(F.col(c))
    touched = F.coalesce(*[F.col(f"_s{k}") for k in (1, 2, 3)]).isNotNull()
    out = out.withColumns(sets)
    return out.withColumn("status", F.when(touched, interview_status(F.col("status")))
                          .otherwise(F.col("status"))).select(*interviews.columns)
