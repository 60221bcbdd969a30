"""Registered queries over the recruiting tables: lists, joins, funnel, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from talentgrid.functions.candidate import (
    earliest_year, experience_block, file_extension, file_kind, identity_code, json_list,
    match_level, newest_experiences, rescale_score, resolve_age,
    score_bucket, sort_experiences, union_experiences, unwrap_form_value, years_of_service)
from talentgrid.functions.basics import non_empty, strip_or_null
from talentgrid.functions.status import interview_status
from talentgrid.operators import funnel as fn, interviews as iv, listing as ls, maintain as mt
from talentgrid.plans.fixtures import Fixtures
from talentgrid.plans.registry import AS_OF_YEAR, ORACLES, query
from talentgrid.session import cut_lineage, shared_folder
from talentgrid.sources import exports as ex
from talentgrid.sources.documents import eligible
from talentgrid.sources.keyed import KeyedTable, create

START, END = "1996-01-01", "1998-06-30"

STATUS = """CASE
 WHEN coalesce(onboard,0) <> 0 AND coalesce(onboard_date,'') <> '' AND coalesce(onboard_department,'') <> '' THEN '已入职'
 WHEN coalesce(offer_issued,0) <> 0 AND coalesce(offer_date,'') <> '' AND coalesce(offer_department,'') <> '' AND coalesce(offer_onboard_plan_date,'') <> '' THEN '已发offer'
 WHEN coalesce(round1_result,'') = '' THEN '待面试'
 WHEN round1_result = '未通过' THEN '一面面试未通过'
 WHEN coalesce(round2_result,'') = '' THEN '一面面试通过'
 WHEN round2_result = '未通过' THEN '二面面试未通过'
 WHEN round2_result = '通过' AND coalesce(round3_enabled,0) = 0 THEN '面试通过'
 WHEN round2_result = '通过' AND coalesce(round3_result,'') = '' THEN '二面面试通过'
 WHEN round3_result = '未通过' THEN '三面面试未通过'
 WHEN round3_result = '通过' THEN '面试通过'
 ELSE '待面试' END"""


def idcode(name: str, phone: str) -> str:
    return (f"CASE WHEN coalesce({name},'') = '' THEN '' WHEN length({phone}) >= 4 "
            f"THEN {name} || right({phone},4) ELSE {name} END")


def with_status(f: Fixtures) -> DataFrame:
    return f.interviews.withColumn("status", interview_status())


def ts(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


# --------------------------------------------------------------- status, funnel
@query("interview_status", f"SELECT id, {STATUS} AS status FROM interviews_fx", ("interviews_fx",))
def _(f):
    return with_status(f).select("id", "status")


def _rng(c: str, start: str | None, end: str | None) -> str:
    parts = ([f"{c} IS NOT NULL AND {c} >= '{start}'"] if start else []) + (
        [f"{c} <= '{end}'"] if end else [])
    return " AND ".join(parts) or "true"


def _tsr(c: str, start: str | None, end: str | None) -> str:
    parts = ([f"{c} >= timestamp '{start} 00:00:00'"] if start else []) + (
        [f"{c} <= timestamp '{end} 23:59:59'"] if end else [])
    return " AND ".join(parts) or "true"


def funnel_sql(start, end, position=None, group=False) -> str:
    """Five separate counts, as the counting rule states them."""
    key = "applied_position" if group else "'all'"
    pos = f" AND applied_position = '{position}'" if position else ""
    if group:
        pos = " AND coalesce(applied_position,'') <> ''"
    tests = {
        "resume_count": ("resumes_fx", _tsr("upload_time", start, end)),
        "interview_count": ("ivs", _rng("round1_time", start, end)),
        "pass_count": ("ivs", "status IN ('面试通过','已发offer','已入职') AND "
                       + _tsr("create_time", start, end)),
        "offer_count": ("ivs", "offer_issued = 1 AND offer_date <> '' AND "
                        + _rng("offer_date", start, end)),
        "onboard_count": ("ivs", "onboard = 1 AND onboard_date <> '' AND "
                          + _rng("onboard_date", start, end)),
    }
    ctes = ",\n".join(
        f"c_{n} AS (SELECT {key} AS k, count(*) AS n FROM {t} WHERE {w}{pos} GROUP BY 1)"
        for n, (t, w) in tests.items())
    keys = ("SELECT k FROM c_resume_count UNION SELECT k FROM c_interview_count" if group
            else "SELECT 'all' AS k")
    cols = ", ".join(f"coalesce({n}_.n, 0) AS {n}" for n in tests)
    joins = " ".join(f"LEFT JOIN c_{n} {n}_ ON {n}_.k = ks.k" for n in tests)
    lead = "ks.k AS position, " if group else ""
    return (f"WITH ivs AS (SELECT *, {STATUS} AS status FROM interviews_fx),\n{ctes},\n"
            f"ks AS ({keys})\nSELECT {lead}{cols} FROM ks {joins}")


BOTH = ("resumes_fx", "interviews_fx")


@query("funnel_total", funnel_sql(START, END), BOTH)
def _(f):
    return fn.funnel_total(f.resumes, with_status(f), START, END)


@query("funnel_total_end_only", funnel_sql(None, END), BOTH)
def _(f):
    return fn.funnel_total(f.resumes, with_status(f), None, END)


@query("funnel_total_all_time", funnel_sql(None, None), BOTH)
def _(f):
    return fn.funnel_total(f.resumes, with_status(f))


@query("funnel_total_position", funnel_sql(START, None, "BUILDING"), BOTH)
def _(f):
    return fn.funnel_total(f.resumes, with_status(f), START, None, "BUILDING")


@query("funnel_by_position", funnel_sql(START, END, group=True), BOTH)
def _(f):
    return fn.funnel_by_position(f.resumes, with_status(f), START, END)


_RATES = funnel_sql(START, END, group=True)
_RATES = _RATES.replace("\nSELECT ks.k", ",\nfb AS (SELECT ks.k") + ") SELECT *, " + ", ".join(
    f"CASE WHEN resume_count > 0 THEN printf('%.1f', {c}_count / resume_count * 100) ELSE '0.0' END"
    f" AS {c}_rate" for c in ("interview", "pass", "offer", "onboard")) + " FROM fb"


@query("funnel_rates", _RATES, BOTH)
def _(f):
    return fn.funnel_rates(fn.funnel_by_position(f.resumes, with_status(f), START, END))


@query("active_positions", f"""
SELECT applied_position FROM resumes_fx WHERE coalesce(applied_position,'') <> '' AND {_tsr('upload_time', START, END)}
UNION SELECT applied_position FROM interviews_fx WHERE coalesce(applied_position,'') <> '' AND {_rng('round1_time', START, END)}
""", BOTH)
def _(f):
    return fn.active_positions(f.resumes, f.interviews, START, END)


# --------------------------------------------------------------- lists and filters
@query("resume_search", """
SELECT id, name, school, major FROM resumes_fx
WHERE lower(name) LIKE '%n_1%' OR lower(school) LIKE '%n_1%' OR lower(major) LIKE '%n_1%'
""", ("resumes_fx",))
def _(f):
    return ls.search(f.resumes, ["name", "school", "major"], "N_1").select(
        "id", "name", "school", "major")


@query("resume_filter", """
SELECT id, gender, highest_education, parse_status FROM resumes_fx
WHERE gender = '女' AND highest_education = '本科' AND parse_status = 'success'
""", ("resumes_fx",))
def _(f):
    return ls.filter_eq(f.resumes, gender="女", highest_education="本科", parse_status="success",
                        school="").select("id", "gender", "highest_education", "parse_status")


@query("resume_page", f"""
SELECT id, name, {ts('upload_time')} AS upload_time FROM resumes_fx WHERE parse_status = 'success'
ORDER BY upload_time DESC NULLS LAST, id LIMIT 10 OFFSET 20
""", ("resumes_fx",))
def _(f):
    df = ls.sort_by(ls.filter_eq(f.resumes, parse_status="success"), "upload_time", "desc")
    return ls.page(df, 3, 10).select(
        "id", "name", F.date_format("upload_time", ex.TIME).alias("upload_time"))


@query("resume_page_total", "SELECT count(*) AS total FROM resumes_fx WHERE parse_status = 'success'",
       ("resumes_fx",))
def _(f):
    return ls.total_count(ls.filter_eq(f.resumes, parse_status="success"))


@query("resume_list_like", f"""
SELECT id, name, applied_position FROM resumes_fx
WHERE parse_status = 'success' AND lower(applied_position) LIKE '%mach%'
""", ("resumes_fx",))
def _(f):
    return ls.list_resumes(f.resumes, {"parse_status": "success", "name": "",
                                       "applied_position": "mach"}).select(
        "id", "name", "applied_position")


@query("interview_list_filter", f"""
SELECT id, resume_id, status FROM (SELECT *, {STATUS} AS status FROM interviews_fx) x
WHERE status = '面试通过'
""", ("interviews_fx",))
def _(f):
    return ls.list_interviews(with_status(f), {"status": "面试通过"}).select(
        "id", "resume_id", "status")


@query("resume_sort_unknown", "SELECT id FROM resumes_fx", ("resumes_fx",))
def _(f):
    return ls.sort_by(f.resumes, "no_such_column").select("id")


@query("upload_range", f"""
SELECT id FROM resumes_fx WHERE {_tsr('upload_time', START, END)}""", ("resumes_fx",))
def _(f):
    return ls.between_ts(f.resumes, "upload_time", START, END).select("id")


@query("round1_range", f"""
SELECT id FROM interviews_fx WHERE {_rng('round1_time', None, END)}""", ("interviews_fx",))
def _(f):
    return ls.between_str(f.interviews, "round1_time", None, END).select("id")


@query("distinct_groups", """
SELECT DISTINCT group_name FROM users_fx WHERE coalesce(group_name,'') <> ''""", ("users_fx",))
def _(f):
    return ls.distinct_values(f.users, "group_name")


@query("distinct_departments", """
SELECT DISTINCT department FROM users_fx WHERE coalesce(department,'') <> ''""", ("users_fx",))
def _(f):
    return ls.distinct_values(f.users, "department")


@query("visible_users_admin", "SELECT id, username, role FROM users_fx", ("users_fx",))
def _(f):
    return ls.visible_users(f.users, "user5").select("id", "username", "role")


@query("visible_users_employee", "SELECT id, username, role FROM users_fx WHERE username = 'user7'",
       ("users_fx",))
def _(f):
    return ls.visible_users(f.users, "user7").select("id", "username", "role")


@query("first_by", """
SELECT id, name FROM resumes_fx WHERE name = 'Customer#000000042' ORDER BY id LIMIT 1""",
       ("resumes_fx",))
def _(f):
    return ls.first_by(f.resumes, "name", "Customer#000000042").select("id", "name")


@query("by_ids", """
SELECT id, file_name FROM resumes_fx WHERE id IN (SELECT resume_id FROM interviews_fx WHERE onboard = 1)
""", BOTH)
def _(f):
    ids = f.interviews.filter("onboard = 1").select("resume_id")
    return ls.by_ids(f.resumes, ids).select("id", "file_name")


@query("keep_selected", """
SELECT DISTINCT i.resume_id AS id FROM interviews_fx i
WHERE i.resume_id IN (SELECT id FROM resumes_fx ORDER BY upload_time DESC, id LIMIT 1000)
""", BOTH)
def _(f):
    shown = ls.page(ls.sort_by(f.resumes), 1, 1000)
    return ls.keep_selected(f.interviews.select(F.col("resume_id").alias("id")), shown)


# --------------------------------------------------------------- joins
@query("interview_list", f"""
SELECT i.id, i.resume_id, CASE WHEN coalesce(r.name,'') <> '' THEN r.name ELSE i.name END AS name,
  CASE WHEN coalesce(i.identity_code,'') <> '' THEN i.identity_code
       WHEN coalesce(r.name,'') <> '' THEN {idcode('r.name', 'r.phone')}
       WHEN coalesce(i.name,'') <> '' THEN i.name END AS identity_code,
  i.applied_position, {ts('i.update_time')} AS update_time
FROM interviews_fx i LEFT JOIN resumes_fx r ON i.resume_id = r.id
WHERE lower(i.name) LIKE '%customer#00000%' OR lower(i.applied_position) LIKE '%customer#00000%'
""", BOTH)
def _(f):
    return iv.interview_list(f.interviews, f.resumes, "customer#00000").select(
        "id", "resume_id", "name", "identity_code", "applied_position",
        F.date_format("update_time", ex.TIME).alias("update_time"))


@query("interview_by_identity", """
SELECT i.id, coalesce(nullif(r.name,''), i.name) AS name FROM
 (SELECT * FROM interviews_fx WHERE applied_position = 'BUILDING' ORDER BY id LIMIT 1) i
 LEFT JOIN resumes_fx r ON i.resume_id = r.id
""", BOTH)
def _(f):
    coded = f.interviews.withColumn("identity_code", F.col("applied_position"))
    return iv.by_identity(coded, f.resumes, " BUILDING ").select("id", "name")


@query("resolve_token", """
SELECT token, r AS round, id FROM (
 SELECT *, row_number() OVER (PARTITION BY token ORDER BY r, id) AS rn FROM (
  SELECT id, 1 AS r, round1_time AS token FROM interviews_fx
  UNION ALL SELECT id, 2, offer_date FROM interviews_fx
  UNION ALL SELECT id, 3, onboard_date FROM interviews_fx) a WHERE coalesce(token,'') <> '') b WHERE rn = 1
""", ("interviews_fx",))
def _(f):
    return iv.resolve_tokens(f.interviews, columns=("round1_time", "offer_date", "onboard_date")
                             ).select("token", "round", "id")


@query("with_position", """
SELECT r.id, r.applied_position, p.position_id, coalesce(nullif(p.work_content,''),'未填写') AS work_content
FROM resumes_fx r LEFT JOIN (SELECT position_name, min(id) AS position_id, arg_min(work_content, id) AS work_content
  FROM positions_fx GROUP BY 1) p ON r.applied_position = p.position_name
""", ("resumes_fx", "positions_fx"))
def _(f):
    return iv.with_position(f.resumes, f.positions).select(
        "id", "applied_position", "position_id", "work_content")


@query("invited_flag", """
SELECT id, id IN (SELECT resume_id FROM interviews_fx) AS invited FROM resumes_fx""", BOTH)
def _(f):
    return iv.with_invited(f.resumes, f.interviews).select("id", "invited")


@query("dependants", """
SELECT r.id, count(i.id) AS interview_count FROM resumes_fx r LEFT JOIN interviews_fx i ON i.resume_id = r.id
GROUP BY r.id""", BOTH)
def _(f):
    return iv.dependants(f.resumes, f.interviews)


@query("orphans", """
SELECT id, resume_id, name FROM interviews_fx WHERE resume_id NOT IN (SELECT id FROM resumes_fx)
""", BOTH)
def _(f):
    return iv.orphans(f.interviews, f.resumes).select("id", "resume_id", "name")


def _scored(f: Fixtures) -> DataFrame:
    score = rescale_score(F.col("raw_match_score"))
    return f.resumes.withColumns({
        "match_score": score, "match_level": match_level(score),
        "match_position": F.when(F.col("id") % 3 == 0, "OTHER").otherwise(F.col("applied_position"))})


_SCORED = """scored AS (SELECT *, CASE WHEN id % 3 = 0 THEN 'OTHER' ELSE applied_position END AS match_position,
  cast(floor(greatest(50, least(100, coalesce(cast(raw_match_score AS double),60)*cast(0.7 AS double)+30))) AS int) AS match_score
  FROM resumes_fx), leveled AS (SELECT *, CASE WHEN match_score >= 80 THEN '高度匹配'
  WHEN match_score >= 60 THEN '中等匹配' ELSE '低度匹配' END AS match_level FROM scored)"""


@query("create_interviews", f"""
WITH {_SCORED}, req AS (SELECT DISTINCT resume_id, cast(NULL AS int) AS match_score, cast(NULL AS string) AS match_level FROM interviews_fx)
SELECT r.id AS resume_id, coalesce(r.name,'') AS name, coalesce(r.applied_position,'') AS applied_position,
  {idcode('r.name', 'r.phone')} AS identity_code,
  CASE WHEN r.match_score <> 0 AND coalesce(r.match_position,'') <> '' AND r.match_position = coalesce(r.applied_position,'')
       THEN r.match_score END AS match_score,
  CASE WHEN r.match_score <> 0 AND coalesce(r.match_position,'') <> '' AND r.match_position = coalesce(r.applied_position,'')
       THEN r.match_level END AS match_level
FROM req JOIN leveled r ON req.resume_id = r.id
""", BOTH)
def _(f):
    req = f.interviews.select("resume_id").distinct().select(
        "resume_id", F.lit(None).cast("int").alias("match_score"),
        F.lit(None).cast("string").alias("match_level"))
    return iv.create_interviews(req, _scored(f))[0].select(
        "resume_id", "name", "applied_position", "identity_code", "match_score", "match_level")


@query("create_interviews_rejected", """
SELECT DISTINCT resume_id FROM interviews_fx WHERE resume_id NOT IN (SELECT id FROM resumes_fx)
""", BOTH)
def _(f):
    req = f.interviews.select("resume_id").distinct().withColumns({
        "match_score": F.lit(None).cast("int"), "match_level": F.lit(None).cast("string")})
    return iv.create_interviews(req, _scored(f))[1].select("resume_id")


@query("propagate_match", f"""
WITH {_SCORED}
SELECT i.id, CASE WHEN r.id IS NOT NULL THEN r.match_score ELSE 7 END AS match_score,
  r.match_level, CASE WHEN r.id IS NOT NULL THEN 'ann' END AS analyzed_by
FROM interviews_fx i LEFT JOIN leveled r ON i.resume_id = r.id AND i.applied_position = r.match_position
""", BOTH)
def _(f):
    a = _scored(f).select(F.col("id").alias("resume_id"),
                          F.col("match_position").alias("applied_position"),
                          "match_score", "match_level")
    base = f.interviews.withColumns({"match_score": F.lit(7),
                                     "match_level": F.lit(None).cast("string")})
    return iv.propagate_match(base, a, "ann").select("id", "match_score", "match_level",
                                                     "analyzed_by")


@query("propagate_position", """
SELECT r.id, CASE WHEN u.id IS NOT NULL THEN u.p ELSE r.applied_position END AS applied_position
FROM resumes_fx r LEFT JOIN (SELECT resume_id AS id, max(nullif(round1_result,'')) AS p FROM interviews_fx
  WHERE onboard = 1 GROUP BY 1) u ON r.id = u.id
""", BOTH)
def _(f):
    u = f.interviews.select("resume_id", F.col("round1_result").alias("applied_position"),
                            (F.col("onboard") == 1).alias("position_given"))
    return iv.propagate_position(f.resumes, u).select("id", "applied_position")


@query("interview_full_update", f"""
WITH upd AS (SELECT id, 'NEW' AS applied_position, '通过' AS round1_result, '通过' AS round2_result
             FROM interviews_fx WHERE offer_issued = 1)
SELECT i.id, CASE WHEN u.id IS NOT NULL THEN 'NEW' ELSE i.applied_position END AS applied_position,
  CASE WHEN u.id IS NOT NULL AND coalesce(r.name,'') <> '' THEN {idcode('r.name', 'r.phone')}
       WHEN u.id IS NOT NULL THEN coalesce(nullif(i.identity_code,''), nullif(i.name,'')) ELSE i.identity_code END AS identity_code,
  CASE WHEN u.id IS NOT NULL AND coalesce(r.name,'') <> '' THEN r.name ELSE i.name END AS name,
  CASE WHEN u.id IS NOT NULL THEN NULL ELSE i.offer_date END AS offer_date,
  CASE WHEN u.id IS NOT NULL THEN '面试通过' ELSE i.status END AS status
FROM (SELECT *, {STATUS} AS status FROM interviews_fx) i LEFT JOIN upd u ON i.id = u.id
LEFT JOIN resumes_fx r ON i.resume_id = r.id
""", BOTH)
def _(f):
    u = f.interviews.filter("offer_issued = 1").select(
        "id", F.lit("NEW").alias("applied_position"), F.lit("通过").alias("round1_result"),
        F.lit("通过").alias("round2_result"))
    return iv.update_interviews(with_status(f), u, f.resumes).select(
        "id", "applied_position", "identity_code", "name", "offer_date", "status")


@query("submit_rounds", f"""
WITH base AS (SELECT *, {STATUS} AS status0 FROM interviews_fx),
 tok AS (SELECT token, min(id) AS id FROM (SELECT id, round1_time AS token FROM base WHERE coalesce(round1_time,'') <> '') x GROUP BY 1),
 upd AS (SELECT id, max(token) AS token FROM tok GROUP BY 1),
 applied AS (SELECT b.* EXCLUDE (round1_result, round2_result, round3_result),
   CASE WHEN u.id IS NOT NULL THEN '未通过' ELSE round1_result END AS round1_result,
   CASE WHEN b.id % 3 = 0 THEN '通过' ELSE round2_result END AS round2_result,
   CASE WHEN b.id % 5 = 0 THEN '未通过' ELSE round3_result END AS round3_result,
   u.id IS NOT NULL OR b.id % 3 = 0 OR b.id % 5 = 0 AS hit FROM base b LEFT JOIN upd u ON b.id = u.id)
SELECT id, round1_result, round2_result, round3_result, CASE WHEN hit THEN {STATUS} ELSE status0 END AS status FROM applied
""", ("interviews_fx",))
def _(f):
    token = lambda k, m: F.when(F.col("id") % m == 0, F.concat(F.lit(f"r{k}-"), F.col("id").cast("string")))
    base = with_status(f).withColumns({
        "round1_comment_token": F.col("round1_time"), "round2_comment_token": token(2, 3), "round3_comment_token": token(3, 5)})
    answers = {"round1_comment_token": " 未通过 ", "round2_comment_token": "通过", "round3_comment_token": "未通过"}
    tokens = base.select(F.explode(F.array(*[F.struct(F.col(c).alias("token"), F.lit(a).alias("result")) for c, a in answers.items()])).alias("s"))
    subs = tokens.select("s.*").filter(non_empty(F.col("token"))).distinct().select(
        "token", F.lit("lee").alias("interviewer"), F.col("token").alias("time"), "result", F.lit("").alias("comment"))
    return iv.submit_rounds(base, subs).select("id", "round1_result", "round2_result", "round3_result", "status")


# --------------------------------------------------------------- scalars
@query("identity_codes", f"SELECT id, {idcode('name', 'phone')} AS identity_code FROM resumes_fx",
       ("resumes_fx",))
def _(f):
    return f.resumes.select("id", identity_code(F.col("name"), F.col("phone")).alias("identity_code"))


@query("ages", f"""
SELECT id, CASE WHEN coalesce(age_from_resume,0) <> 0 THEN age_from_resume
  WHEN coalesce(birth_year,0) <> 0 THEN {AS_OF_YEAR} - birth_year END AS age FROM resumes_fx""",
       ("resumes_fx",))
def _(f):
    return f.resumes.select("id", resolve_age(F.col("age_from_resume"), F.col("birth_year"),
                                              AS_OF_YEAR).alias("age"))


@query("match_rescale", f"""
WITH {_SCORED} SELECT id, match_score, match_level FROM leveled""", ("resumes_fx",))
def _(f):
    return _scored(f).select("id", "match_score", "match_level")


@query("match_bucket", """
SELECT id, CASE WHEN raw_match_score IS NULL THEN 'gray' WHEN raw_match_score >= 80 THEN 'green'
  WHEN raw_match_score >= 60 THEN 'orange' ELSE 'red' END AS bucket FROM resumes_fx""", ("resumes_fx",))
def _(f):
    return f.resumes.select("id", score_bucket(F.col("raw_match_score")).alias("bucket"))


@query("file_eligibility", """
SELECT id, lower(regexp_extract(file_name, '\\.([^.]*)$', 1)) IN ('pdf','doc','docx') AS accepted,
 CASE lower(regexp_extract(file_name, '\\.([^.]*)$', 1)) WHEN 'pdf' THEN 'pdf' WHEN 'doc' THEN 'word' WHEN 'docx' THEN 'word' ELSE 'other' END AS kind,
 lower(regexp_extract(file_name, '\\.([^.]*)$', 1)) AS extension
FROM resumes_fx""", ("resumes_fx",))
def _(f):
    c = F.col("file_name")
    return f.resumes.select("id", eligible(c).alias("accepted"), file_kind(c).alias("kind"),
                            file_extension(c).alias("extension"))


@query("strip_or_null", """
SELECT id, nullif(trim(applied_position), '') AS applied_position FROM resumes_fx""", ("resumes_fx",))
def _(f):
    return f.resumes.select("id", strip_or_null(F.col("applied_position")).alias("applied_position"))


@query("json_decode", """
SELECT event_id, cast(json_extract_string(props, '$.k') AS int) AS k,
  coalesce(json_extract_string(props, '$.k'), '') AS k_text FROM events""")
def _(f):
    e = f.table("events")
    obj = F.from_json("props", "k int")
    return e.select("event_id", obj.k.alias("k"),
                    F.coalesce(F.get_json_object("props", "$.k"), F.lit("")).alias("k_text"))


@query("form_values", """
SELECT event_id, CASE WHEN event_type = 'view' THEN 'v' || cast(user_id AS string)
  WHEN event_type = 'click' THEN 'l' || cast(user_id AS string) WHEN event_type = 'signup' THEN '' ELSE event_type END AS v
FROM events""")
def _(f):
    u = F.col("user_id").cast("string")
    raw = (F.when(F.col("event_type") == "view", F.concat(F.lit('{"value":"v'), u, F.lit('"}')))
           .when(F.col("event_type") == "click",
                 F.concat(F.lit('{"value":"","label":"l'), u, F.lit('"}')))
           .when(F.col("event_type") == "signup", F.col("props"))
           .otherwise(F.col("event_type")))
    return f.table("events").select("event_id", unwrap_form_value(raw).alias("v"))


@query("json_list_default", """
SELECT event_id, CASE WHEN event_type = 'view' THEN 2 ELSE 0 END AS n FROM events""")
def _(f):
    u = F.col("user_id").cast("string")
    raw = (F.when(F.col("event_type") == "view", F.concat(F.lit('["'), u, F.lit('","x"]')))
           .when(F.col("event_type") == "click", F.lit('["broken')))
    return f.table("events").select("event_id", F.size(json_list(raw)).alias("n"))


# --------------------------------------------------------------- experiences
@query("experience_top2", """
SELECT resume_id, max(CASE WHEN rn = 1 THEN company END) AS company1, max(CASE WHEN rn = 1 THEN t END) AS time1,
  coalesce(max(CASE WHEN rn = 2 THEN company END),'') AS company2, coalesce(max(CASE WHEN rn = 2 THEN t END),'') AS time2
FROM (SELECT *, row_number() OVER (PARTITION BY resume_id ORDER BY seq) AS rn,
  CASE WHEN end_year IS NULL THEN cast(start_year AS string) || '-至今' ELSE cast(start_year AS string) || '-' || cast(end_year AS string) END AS t
  FROM experience_fx) x WHERE rn <= 2 GROUP BY 1
""", ("experience_fx",))
def _(f):
    return ls.top_experiences(f.experience, 2)


@query("earliest_year", f"""
SELECT r.id, min(e.start_year) AS earliest, CASE WHEN {AS_OF_YEAR} - min(e.start_year) >= 0 THEN {AS_OF_YEAR} - min(e.start_year) END AS years
FROM resumes_fx r LEFT JOIN experience_fx e ON r.id = e.resume_id AND e.start_year <> 0 GROUP BY r.id
""", ("resumes_fx", "experience_fx"))
def _(f):
    w = F.col("work_experience")
    return f.resumes_with_experience().select(
        "id", earliest_year(w).alias("earliest"),
        years_of_service(F.lit(None).cast("int"), w, AS_OF_YEAR).alias("years"))


@query("experience_blocks", """
SELECT r.id, coalesce(string_agg(company || ' | ' || position || ' | ' ||
  CASE WHEN end_year IS NULL THEN cast(start_year AS string) || '-至今' ELSE cast(start_year AS string) || '-' || cast(end_year AS string) END,
  chr(10) ORDER BY seq), '') AS block
FROM resumes_fx r LEFT JOIN experience_fx e ON r.id = e.resume_id GROUP BY r.id
""", ("resumes_fx", "experience_fx"))
def _(f):
    return f.resumes_with_experience().select(
        "id", experience_block(F.col("work_experience")).alias("block"))


@query("experience_order", """
SELECT resume_id AS id, string_agg(company, '>' ORDER BY start_year DESC, coalesce(end_year, start_year) DESC, seq) AS newest_first,
  string_agg(company, '>' ORDER BY start_year DESC, seq) FILTER (WHERE rn <= 2) AS shown
FROM (SELECT *, row_number() OVER (PARTITION BY resume_id ORDER BY start_year DESC, seq) AS rn FROM experience_fx) x GROUP BY 1
""", ("experience_fx",))
def _(f):
    w = F.col("work_experience")
    names = lambda a: F.array_join(F.transform(a, lambda e: e.company), ">")
    return f.resumes_with_experience().filter(w.isNotNull()).select(
        "id", names(sort_experiences(w)).alias("newest_first"),
        names(newest_experiences(w)).alias("shown"))


@query("union_experiences", """
SELECT resume_id AS id, count(*) + sum(CASE WHEN dup = 0 THEN 1 ELSE 0 END) AS n FROM (
 SELECT resume_id, 0 AS dup FROM (SELECT DISTINCT resume_id, company, start_year + 1 AS s, end_year FROM experience_fx) a
 WHERE NOT EXISTS (SELECT 1 FROM experience_fx b WHERE b.resume_id = a.resume_id AND b.company = a.company
   AND b.start_year = a.s AND b.end_year IS NOT DISTINCT FROM a.end_year)
 UNION ALL SELECT resume_id, 1 FROM experience_fx) u GROUP BY 1
""".replace("count(*) + sum(CASE WHEN dup = 0 THEN 1 ELSE 0 END)", "count(*)"), ("experience_fx",))
def _(f):
    w = F.col("work_experience")
    later = F.transform(w, lambda e: F.struct(
        e.company.alias("company"), e.position.alias("position"),
        (e.start_year + 1).alias("start_year"), e.end_year.alias("end_year")))
    return f.resumes_with_experience().filter(w.isNotNull()).select(
        "id", F.size(union_experiences(w, later)).cast("long").alias("n"))


# --------------------------------------------------------------- exports
_EXP = """exps AS (SELECT resume_id, seq, company, position,
  CASE WHEN end_year IS NULL THEN cast(start_year AS string) || '-至今' ELSE cast(start_year AS string) || '-' || cast(end_year AS string) END AS t,
  row_number() OVER (PARTITION BY resume_id ORDER BY seq) AS rn, min(start_year) OVER (PARTITION BY resume_id) AS y0 FROM experience_fx)"""


@query("resume_export", f"""
WITH {_EXP}
SELECT r.id AS "ID", coalesce(r.applied_position,'') AS "应聘岗位", {idcode('r.name','r.phone')} AS "身份验证码", '' AS "查重",
 coalesce(r.name,'') AS "姓名", coalesce(gender,'') AS "性别", coalesce(cast(age_from_resume AS string),'') AS "年龄",
 coalesce(cast({AS_OF_YEAR} - a.y0 AS string),'') AS "工龄", coalesce(phone,'') AS "手机号",
 coalesce(a.company,'') AS "工作经历一（公司）", coalesce(a.position,'') AS "工作经历一（岗位）", coalesce(a.t,'') AS "工作经历一（时间）",
 coalesce(b.company,'') AS "工作经历二（公司）", coalesce(b.position,'') AS "工作经历二（岗位）", coalesce(b.t,'') AS "工作经历二（时间）",
 coalesce(email,'') AS "邮箱", coalesce(highest_education,'') AS "最高学历", '' AS "学校（原始）", coalesce(school,'') AS "学校（标准化）", '' AS "学校状态",
 '' AS "专业（原始）", coalesce(major,'') AS "专业（标准化）", '' AS "专业状态", {ts('upload_time')} AS "上传时间", '' AS "解析时间"
FROM resumes_fx r LEFT JOIN exps a ON a.resume_id = r.id AND a.rn = 1 LEFT JOIN exps b ON b.resume_id = r.id AND b.rn = 2
""", ("resumes_fx", "experience_fx"))
def _(f):
    return ex.export_resumes(f.resumes_with_experience().withColumn(
        "age", F.col("age_from_resume")), AS_OF_YEAR)


@query("resume_export_csv", """
SELECT cast(id AS string) AS "ID", coalesce(name,'') AS "姓名", coalesce(gender,'') AS "性别", coalesce(cast(birth_year AS string),'') AS "出生年份",
 '' AS "年龄", coalesce(phone,'') AS "手机号", coalesce(email,'') AS "邮箱", coalesce(highest_education,'') AS "最高学历",
 coalesce(school,'') AS "毕业院校", coalesce(major,'') AS "专业", coalesce(applied_position,'') AS "应聘岗位", '' AS "匹配度", '' AS "匹配等级",
 strftime(upload_time, '%Y-%m-%dT%H:%M:%S') AS "上传时间", parse_status AS "解析状态" FROM resumes_fx
""", ("resumes_fx",))
def _(f):
    return ex.export_resumes_csv(f.resumes)


def _rounds_sql(cols: tuple[str, ...]) -> str:
    have = {"round1_time", "round1_result", "round2_result", "round3_result"}
    out = []
    for n, k in (("一面", 1), ("二面", 2), ("三面", 3)):
        for label, c in (("面试官", "interviewer"), ("时间", "time"), ("结果", "result"), ("评价", "comment")):
            if c in cols:
                col = f"round{k}_{c}"
                out.append((f"coalesce({col},'')" if col in have else "''") + f' AS "{n}{label}"')
    return ", ".join(out)


@query("interview_export", f"""
SELECT {idcode('r.name','r.phone')} AS "身份验证码", coalesce(i.name,'') AS "姓名", coalesce(i.applied_position,'') AS "应聘岗位",
 {STATUS} AS "当前状态", {_rounds_sql(('interviewer', 'time', 'result', 'comment'))},
 CASE WHEN offer_issued <> 0 THEN '是' ELSE '否' END AS "是否发放Offer", coalesce(offer_date,'') AS "Offer发放日期",
 coalesce(offer_department,'') AS "拟入职架构", coalesce(offer_onboard_plan_date,'') AS "拟入职日期",
 CASE WHEN onboard <> 0 THEN '是' ELSE '否' END AS "是否已入职", coalesce(onboard_date,'') AS "实际入职日期",
 coalesce(onboard_department,'') AS "入职架构", {ts('update_time')} AS "最后修改时间"
FROM interviews_fx i LEFT JOIN resumes_fx r ON i.resume_id = r.id
""", BOTH)
def _(f):
    return ex.export_interviews(with_status(f), f.resumes)


@query("interview_export_csv", f"""
SELECT id AS "ID", coalesce(name,'') AS "姓名", coalesce(applied_position,'') AS "应聘岗位", coalesce(identity_code,'') AS "身份验证码",
 '' AS "匹配度", '' AS "匹配等级", {STATUS} AS "状态", {_rounds_sql(('interviewer', 'time', 'result'))},
 CASE WHEN offer_issued = 1 THEN '是' ELSE '否' END AS "是否发offer", coalesce(offer_date,'') AS "offer日期",
 CASE WHEN onboard = 1 THEN '是' ELSE '否' END AS "是否入职", coalesce(onboard_date,'') AS "入职日期",
 strftime(create_time, '%Y-%m-%dT%H:%M:%S') AS "创建时间", strftime(update_time, '%Y-%m-%dT%H:%M:%S') AS "更新时间"
FROM interviews_fx
""", ("interviews_fx",))
def _(f):
    return ex.export_interviews_csv(with_status(f))


def _report_sql() -> str:
    fixed = [(1, 1, "应聘岗位", "nullif(applied_position,'')")] + [
        (2, i, n, c) for i, (n, c) in enumerate(
            (("姓名", "name"), ("性别", "gender"), ("出生年份", "cast(birth_year AS string)"),
             ("年龄", "NULL"), ("手机号", "phone"), ("邮箱", "email")), 1)] + [
        (3, 1, "最高学历", "highest_education"), (3, 2, "毕业学校", "school"), (3, 3, "专业", "major"),
        (5, 1, "匹配度分数", "NULL"), (5, 2, "匹配等级", "NULL")]
    parts = [f"SELECT id, {s} AS section, {n} AS line_no, '{label}' AS label, coalesce({c},'-') AS value FROM resumes_fx"
             for s, n, label, c in fixed]
    parts.append("""SELECT resume_id, 4, cast(row_number() OVER (PARTITION BY resume_id ORDER BY seq) AS int), '工作经历',
  company || ' | ' || position || ' | ' || CASE WHEN end_year IS NULL THEN cast(start_year AS string) || ' - 至今'
  ELSE cast(start_year AS string) || ' - ' || cast(end_year AS string) END FROM experience_fx WHERE resume_id IN (SELECT id FROM resumes_fx)""")
    parts.append("SELECT id, 4, 1, '工作经历', '暂无工作经历' FROM resumes_fx WHERE id NOT IN (SELECT resume_id FROM experience_fx)")
    return "\nUNION ALL ".join(parts)


@query("report_rows", _report_sql(), ("resumes_fx", "experience_fx"))
def _(f):
    return ex.report_rows(f.resumes_with_experience())


@query("round_report_rows", f"""
WITH b AS (SELECT *, {STATUS} AS status FROM interviews_fx),
r AS (SELECT *, 1 AS round, '一面' AS rn, round1_time AS t, round1_result AS res FROM b UNION ALL
 SELECT *, 2, '二面', NULL, round2_result FROM b UNION ALL SELECT *, 3, '三面', NULL, round3_result FROM b)
SELECT id, round, 1 AS section, 1 AS line_no, '姓名' AS label, coalesce(nullif(name,''),'-') AS value FROM r UNION ALL
SELECT id, round, 1, 2, '应聘岗位', coalesce(nullif(applied_position,''),'-') FROM r UNION ALL
SELECT id, round, 1, 3, '当前流程状态', status FROM r UNION ALL SELECT id, round, 1, 4, '简历匹配度', '-' FROM r UNION ALL
SELECT id, round, 2, 1, '面试轮次', rn FROM r UNION ALL SELECT id, round, 2, 2, '面试官', '-' FROM r UNION ALL
SELECT id, round, 2, 3, '面试时间', coalesce(substr(nullif(t,''),1,10),'-') FROM r UNION ALL
SELECT id, round, 2, 4, '面试结果', coalesce(nullif(res,''),'未填写') FROM r UNION ALL
SELECT id, round, 2, 5, '面试评价', '暂无填写' FROM r UNION ALL SELECT id, round, 3, 1, 'AI 分析结果', '暂无AI分析结果' FROM r
""", ("interviews_fx",))
def _(f):
    return ex.round_report_rows(with_status(f))


@query("registration_rows", """
SELECT id, coalesce(name,'') AS name, coalesce(applied_position,'') AS applied_position, coalesce(round1_result,'') AS ethnicity,
 coalesce(offer_department,'') || ' ' || coalesce(onboard_department,'') || ' ' AS address, 1 AS n_factors,
 CASE id % 4 WHEN 0 THEN '' WHEN 1 THEN 'c' || id WHEN 2 THEN 'c' || id || '|d' ELSE 'c' || id || '|d|e' || id END AS companies
FROM interviews_fx
""", ("interviews_fx",))
def _(f):
    rf = f.interviews.withColumns({
        "registration_form_ethnicity": F.col("round1_result"),
        "registration_form_address_province": F.col("offer_department"),
        "registration_form_address_city": F.col("onboard_department"),
        "registration_form_consideration_factors":
            F.concat(F.lit('["'), F.col("id").cast("string"), F.lit('"]')),
        "registration_form_recent_work_experience": F.when(F.col("id") % 4 > 0, F.concat(
            F.lit('[{"company":"c'), F.col("id").cast("string"), F.lit('"}'),
            F.when(F.col("id") % 4 > 1, F.lit(',{"company":"d"}')).otherwise(""),
            F.when(F.col("id") % 4 > 2, F.concat(F.lit(',{"company":"e'), F.col("id").cast("string"), F.lit('"}'))).otherwise(""),
            F.lit("]")))})
    return ex.registration_rows(rf).select(
        "id", "name", "applied_position", "ethnicity", "address",
        F.size("factors").alias("n_factors"),
        F.array_join("work_experience.company", "|").alias("companies"))


# --------------------------------------------------------------- maintenance
@query("changed_since", """
SELECT (SELECT max(updated_at) > timestamp '1998-12-31 00:00:00' FROM resumes_fx) AS resumes,
 (SELECT max(update_time) > timestamp '2030-01-01 00:00:00' FROM interviews_fx) AS interviews,
 (SELECT max(ts) > timestamp '2024-01-15 00:00:00' FROM events) AS events
""".replace("timestamp '2030-01-01 00:00:00'", "timestamp '1998-12-31 00:00:00'").replace(
    "timestamp '2024-01-15 00:00:00'", "timestamp '1998-12-31 00:00:00'"), BOTH)
def _(f):
    return mt.changed_since({
        "resumes": f.resumes,
        "interviews": f.interviews.withColumnRenamed("update_time", "updated_at"),
        "events": f.table("events").withColumnRenamed("ts", "updated_at")}, "1998-12-31T00:00:00Z")


@query("changed_since_blank", """
SELECT false AS resumes, false AS interviews FROM (SELECT count(*) FROM resumes_fx) a""", ("resumes_fx",))
def _(f):
    return mt.changed_since({
        "resumes": f.resumes,
        "interviews": f.interviews.withColumnRenamed("update_time", "updated_at")}, "")


@query("latest_version", """
SELECT user_id, event_id, event_type, value FROM (
 SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) x WHERE rn = 1
""")
def _(f):
    return mt.latest_version(f.table("events"), "user_id", "ts", "event_id").select(
        "user_id", "event_id", "event_type", "value")


def _event_updates(f: Fixtures) -> DataFrame:
    """Updates of résumés made from events: a view sets the school, a click the major."""
    e = f.table("events")
    return e.select(
        F.col("user_id").alias("id"), "event_id",
        F.when(F.col("event_type") == "view", F.col("props")).alias("school"),
        F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("major"),
        F.when(F.col("event_type") == "view", F.array(F.lit("school")))
        .when(F.col("event_type") == "click", F.array(F.lit("major"), F.lit("school")))
        .otherwise(F.array().cast("array<string>")).alias("present"))


@query("partial_update", """
WITH s AS (SELECT user_id AS id, arg_max(CASE WHEN event_type = 'view' THEN props ELSE '<null>' END, event_id) AS v FROM events
   WHERE event_type IN ('view','click') GROUP BY 1),
 m AS (SELECT user_id AS id, arg_max('m' || cast(event_id AS string), event_id) AS v FROM events WHERE event_type = 'click' GROUP BY 1),
 h AS (SELECT DISTINCT user_id AS id FROM events)
SELECT r.id, CASE WHEN s.id IS NULL THEN r.school ELSE nullif(s.v, '<null>') END AS school,
 CASE WHEN m.id IS NULL THEN r.major ELSE m.v END AS major,
 CASE WHEN h.id IS NULL THEN strftime(r.updated_at, '%Y-%m-%d') ELSE '2026-01-01' END AS updated
FROM resumes_fx r LEFT JOIN s ON r.id = s.id LEFT JOIN m ON r.id = m.id LEFT JOIN h ON r.id = h.id
""", ("resumes_fx",))
def _(f):
    out = mt.drop_marks(mt.partial_update(
        f.resumes, _event_updates(f), order="event_id",
        touched_at=F.lit("2026-01-01").cast("timestamp")))
    return out.select("id", "school", "major",
                      F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))


def _stored(f: Fixtures, name: str, rows: DataFrame) -> KeyedTable:
    return create(rows, shared_folder(f.spark, name), "id", buckets=16)


@query("stored_update", ORACLES["partial_update"])
def _(f):
    table = _stored(f, "stored-update", f.resumes)
    mt.update_stored(table, _event_updates(f), order="event_id", touched_at=F.lit("2026-01-01").cast("timestamp"))
    return table.read().select("id", "school", "major", F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))


@query("stored_delete", """
SELECT id, file_name FROM resumes_fx WHERE id NOT IN (SELECT user_id FROM events)
UNION ALL SELECT event_id + 5000000000, NULL FROM events""", ("resumes_fx",))
def _(f):
    table = _stored(f, "stored-delete", f.resumes)
    mt.delete_stored(table, f.table("events").select("user_id"))
    mt.insert_stored(table, f.table("events").select((F.col("event_id") + 5000000000).alias("id")), mt.new_resume_defaults())
    return table.read().select("id", "file_name")


_CHANGED = f"""h AS (SELECT user_id AS id, max(event_id) AS e FROM events GROUP BY 1),
 b AS (SELECT r.id, CASE WHEN h.id IS NULL THEN birth_year WHEN e % 3 = 0 THEN NULL ELSE cast(1960 + e % 40 AS int) END AS birth_year,
  h.id IS NOT NULL AS hit, age_from_resume FROM resumes_fx r LEFT JOIN h ON r.id = h.id)"""


# a named birth year, also an emptied one, rederives the age; the age found in the résumé wins
@query("update_resumes", f"""
WITH {_CHANGED}
SELECT id, birth_year, cast(CASE WHEN hit AND coalesce(age_from_resume, 0) <> 0 THEN age_from_resume
  WHEN hit AND coalesce(birth_year, 0) <> 0 THEN {AS_OF_YEAR} - birth_year ELSE -1 END AS int) AS age FROM b""", ("resumes_fx",))
def _(f):
    table = _stored(f, "update-resumes", f.resumes.withColumn("age", F.lit(-1)))
    e = F.col("event_id")
    new = f.table("events").select(F.col("user_id").alias("id"), e, F.when(e % 3 != 0, (1960 + e % 40).cast("int")).alias("birth_year"),
                                   F.array(F.lit("birth_year")).alias("present"))
    mt.update_resumes_stored(table, new, AS_OF_YEAR, order="event_id")
    return table.read().select("id", "birth_year", "age")


# the hundredth page and the one after its last row, with the number of all rows
_DEEP = """SELECT id, birth_year, total FROM (SELECT id, birth_year, count(*) OVER () AS total,
 row_number() OVER (ORDER BY birth_year DESC NULLS LAST, id) AS rn FROM resumes_fx) x WHERE rn BETWEEN {0} AND {1}"""


@query("deep_page", _DEEP.format("(SELECT count(*) FROM resumes_fx) // 20 * 10 + 1", "(SELECT count(*) FROM resumes_fx) // 20 * 10 + 20"), ("resumes_fx",))
def _(f):
    rows = f.resumes.select("id", "birth_year")
    middle = rows.count() // 20 + 1
    found, total = ls.page_at(rows, "birth_year", middle, 10)
    found = cut_lineage(found)
    last = found.orderBy(F.desc("birth_year"), "id").collect()[-1]
    following = ls.page_after(rows, "birth_year", (last.birth_year, last.id), 10)
    return found.unionByName(following).withColumn("total", F.lit(total).cast("long"))


@query("delete_ids", """
SELECT id, file_name FROM resumes_fx WHERE id NOT IN (SELECT user_id FROM events)""", ("resumes_fx",))
def _(f):
    return mt.delete_ids(f.resumes, f.table("events").select("user_id"))[0].select("id", "file_name")


@query("delete_ids_count", """
SELECT count(*) AS deleted FROM resumes_fx WHERE id IN (SELECT user_id FROM events)""", ("resumes_fx",))
def _(f):
    return mt.delete_ids(f.resumes, f.table("events").select("user_id"))[1]


@query("insert_rows", """
SELECT id, name, parse_status, created_by FROM resumes_fx UNION ALL
SELECT event_id + 5000000000, NULL, 'pending', 'system' FROM events
""", ("resumes_fx",))
def _(f):
    new = f.table("events").select((F.col("event_id") + 5000000000).alias("id"))
    return mt.insert_rows(f.resumes, new, mt.new_resume_defaults()).select(
        "id", "name", "parse_status", "created_by")


@query("conform", """
SELECT id, name, cast(NULL AS string) AS match_level, age_from_resume FROM resumes_fx""", ("resumes_fx",))
def _(f):
    from talentgrid import schemas
    return mt.conform(f.resumes, schemas.RESUMES).select("id", "name", "match_level",
                                                          "age_from_resume")


@query("position_update", """
SELECT id, 'P ' || position_name AS position_name, cast(NULL AS string) AS work_content FROM positions_fx
""", ("positions_fx",))
def _(f):
    u = f.positions.select("id", F.concat(F.lit(" P "), "position_name", F.lit(" ")).alias(
        "position_name"))
    return iv.update_positions(f.positions, u)
