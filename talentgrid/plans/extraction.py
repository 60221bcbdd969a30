"""Registered queries for extraction, model answers and re-extraction."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from talentgrid import schemas
from talentgrid.functions import contact, model_json as mj
from talentgrid.functions.candidate import resolve_age
from talentgrid.functions.education import clean_major, clean_school
from talentgrid.functions.text import clean_resume_text, parse_key_values
from talentgrid.operators import extraction as x
from talentgrid.operators.maintain import conform, upsert_extracted
from talentgrid.plans.fixtures import Fixtures
from talentgrid.plans.recruiting import STATUS, with_status
from talentgrid.plans.registry import AS_OF_YEAR, query
from talentgrid.session import dealt
from talentgrid.sources.documents import outcome_counts, reextract_inputs
from talentgrid.sources.tables import to_json_rows


def resume_texts(f: Fixtures) -> DataFrame:
    """``id, text``: a labelled résumé text written from the columns of each résumé."""
    c = lambda n: F.coalesce(F.col(n).cast("string"), F.lit(""))
    columns = ["id", "gender", "birth_year", "phone", "email", "highest_education"]
    return dealt(f.resumes.select(columns)).select("id", F.concat(
        F.lit("性别："), c("gender"), F.lit("\n出生年份："), c("birth_year"),
        F.lit("\n手机："), F.translate(c("phone"), "-", " "), F.lit("\n邮箱："), c("email"),
        F.lit("\n最高学历："), c("highest_education"), F.lit("\n毕业院校：甲乙大学 \n"),
        F.lit("工作经历\n2015.03-2018.06 "), F.lit("天地科技有限公司 销售经理\n")).alias("text"))


# what the labelled texts above must give back
@query("extract_labelled", f"""
SELECT id, gender, birth_year, phone, CASE WHEN email LIKE '%@%' THEN email END AS email, highest_education AS level,
 cast(CASE WHEN {AS_OF_YEAR} - birth_year BETWEEN 16 AND 70 THEN {AS_OF_YEAR} - birth_year END AS int) AS age,
 '天地科技有限公司' AS company, '销售经理' AS position, cast(2015 AS int) AS start_year, cast(2018 AS int) AS end_year
FROM (SELECT id, gender, birth_year, regexp_replace(phone, '-', '', 'g') AS phone, email, highest_education FROM resumes_fx) x
""", ("resumes_fx",))
def _(f):
    e = F.get(F.col("work_experience"), F.lit(0))
    return x.extract_all(resume_texts(f), AS_OF_YEAR, deal=False).select(
        "id", "gender", "birth_year", "phone", "email", F.col("highest_education").alias("level"),
        "age", e.company.alias("company"), e.position.alias("position"),
        e.start_year.alias("start_year"), e.end_year.alias("end_year"))


@query("extract_documents")
def _(f):
    return x.extract_all(f.documents, AS_OF_YEAR, "doc_id").select(
        "doc_id", "name", "gender", "birth_year", "age", "phone", "email", "earliest_work_year",
        F.size("work_experience").alias("n_experiences"), "highest_education", "school", "major",
        F.length("raw_text").alias("chars"))


@query("experience_from_text")
def _(f):
    docs = dealt(f.documents.select("doc_id", "text")).select("doc_id", clean_resume_text(F.col("text")).alias("text"))
    return x.work_experience(docs, AS_OF_YEAR).select("doc_id", F.inline_outer("work_experience"))


@query("clean_resume_text")
def _(f):
    return dealt(f.documents.select("doc_id", "text")).select("doc_id", clean_resume_text(F.col("text")).alias("text"))


@query("key_values", """
SELECT id, coalesce(gender, '') AS gender, cast(birth_year AS string) AS birth, highest_education AS level FROM resumes_fx
WHERE birth_year IS NOT NULL AND gender IS NOT NULL""", ("resumes_fx",))
def _(f):
    src = f.resumes.filter("birth_year IS NOT NULL AND gender IS NOT NULL").select("id")
    kv = resume_texts(f).join(src, "id", "left_semi").select(
        "id", parse_key_values("text").alias("kv"))
    v = lambda k: F.try_element_at("kv", F.lit(k))
    return kv.select("id", F.regexp_extract(v("性别"), "^[男女]", 0).alias("gender"),
                     F.regexp_extract(v("出生年份"), "^[0-9]{4}", 0).alias("birth"),
                     F.regexp_extract(v("最高学历"), "^[一-龥]{2}", 0).alias("level"))


@query("clean_names", """
SELECT id, n_name || '大学' AS school, CASE WHEN m = 1 THEN NULL ELSE '市场营销' END AS major
FROM (SELECT c_custkey AS id, n_name, c_custkey % 3 AS m FROM customer JOIN nation ON c_nationkey = n_nationkey) x""")
def _(f):
    c = f.table("customer").join(f.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    m = F.col("c_custkey") % 3
    major = (F.when(m == 0, "专业：市场营销专业").when(m == 1, "负责客户需求分析")
             .otherwise("市场营销（专升本）方向"))
    return c.select(F.col("c_custkey").alias("id"),
                    clean_school(F.concat(F.lit("毕业院校： 2012年9月"), "n_name", F.lit("大学，"))).alias("school"),
                    clean_major(major).alias("major"))


# --------------------------------------------------------------- model answers
def _quoted(c: str) -> Column:
    return F.when(F.col(c).isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), F.col(c), F.lit('"')))


def model_answers(f: Fixtures) -> DataFrame:
    """``id, answer``: fenced JSON per résumé; every 11th answer is cut off."""
    body = F.concat(
        F.lit('```json\n{"name":'), _quoted("name"), F.lit(',"gender":'), _quoted("gender"),
        F.lit(',"birth_year":'), F.coalesce((F.col("birth_year") + 30).cast("string"), F.lit("null")),
        F.lit(',"phone":'), _quoted("phone"), F.lit(',"email":'), _quoted("email"),
        F.lit(',"highest_education":"全日制'), F.col("highest_education"),
        F.lit('","school":'), _quoted("school"), F.lit(',"major":'), _quoted("major"),
        F.lit(',"work_experience":[{"company":" '), F.col("school"),
        F.lit('","position":"","start_year":2010,"end_year":null},{"company":"","position":""}]}\n```'))
    return f.resumes.select("id", F.when(F.col("id") % 11 == 0, F.lit("```json\n{\"name\":"))
                            .otherwise(body).alias("answer"))


_MODEL = f"""model AS (SELECT id, name, gender, CASE WHEN birth_year + 30 BETWEEN 1950 AND {AS_OF_YEAR} THEN birth_year + 30 END AS birth_year,
 CASE WHEN length(regexp_replace(phone,'[^0-9]','','g')) = 11 THEN regexp_replace(phone,'[^0-9]','','g') END AS phone, email,
 highest_education, school, major, 1 AS n_exp, 2010 AS y0 FROM resumes_fx WHERE id % 11 <> 0)"""


@query("model_fields", f"""
WITH {_MODEL}
SELECT r.id, m.name, m.gender, cast(m.birth_year AS int) AS birth_year, m.phone, m.email, m.highest_education, m.school, m.major,
 cast(m.n_exp AS int) AS n_exp, cast(m.y0 AS int) AS start_year FROM resumes_fx r LEFT JOIN model m ON r.id = m.id
""", ("resumes_fx",))
def _(f):
    m = mj.normalize_model(mj.parse_model_json(F.col("answer"), schemas.MODEL_ANSWER, fenced=True), AS_OF_YEAR)
    df = model_answers(f).select("id", m.alias("m"))
    return df.select("id", "m.name", "m.gender", "m.birth_year", "m.phone", "m.email",
                     "m.highest_education", "m.school", "m.major",
                     F.nullif(F.size("m.work_experience"), F.lit(-1)).alias("n_exp"),
                     F.get("m.work_experience", F.lit(0)).start_year.alias("start_year"))


@query("merge_extractions", f"""
WITH {_MODEL}
SELECT r.id, coalesce(m.name, r.name) AS name, coalesce(m.phone, r.phone) AS phone,
 cast(coalesce(m.birth_year, r.birth_year) AS int) AS birth_year,
 cast(CASE WHEN r.age_from_resume IS NOT NULL THEN r.age_from_resume WHEN m.id IS NOT NULL THEN {AS_OF_YEAR} - coalesce(m.birth_year, r.birth_year) END AS int) AS age,
 coalesce(m.highest_education, r.highest_education) AS highest_education, cast(CASE WHEN m.id IS NOT NULL THEN 2010 ELSE e.y END AS int) AS earliest_work_year
FROM resumes_fx r LEFT JOIN model m ON r.id = m.id LEFT JOIN (SELECT resume_id, min(start_year) AS y FROM experience_fx GROUP BY 1) e ON e.resume_id = r.id
""", ("resumes_fx", "experience_fx"))
def _(f):
    from talentgrid.functions.candidate import earliest_year
    m = mj.normalize_model(mj.parse_model_json(F.col("answer"), schemas.MODEL_ANSWER, fenced=True), AS_OF_YEAR)
    rule = f.resumes_with_experience().select(
        "id", "name", "gender", "birth_year", F.col("age_from_resume").alias("age"), "phone", "email",
        "highest_education", "school", "major", "work_experience",
        earliest_year(F.col("work_experience")).alias("earliest_work_year"))
    return mj.merge_extractions(rule, model_answers(f).select("id", m.alias("m")), AS_OF_YEAR).select(
        "id", "name", "phone", "birth_year", "age", "highest_education", "earliest_work_year")


@query("match_analysis", """
SELECT id, CASE WHEN raw_match_score IS NULL THEN 65 WHEN id % 5 = 1 THEN NULL WHEN id % 5 = 2 THEN 72
   ELSE cast(floor(greatest(50, least(100, raw_match_score * cast(0.7 AS double) + 30))) AS int) END AS match_score,
 CASE WHEN raw_match_score IS NULL THEN '中等匹配' WHEN id % 5 = 1 THEN '自评' WHEN id % 5 = 2 THEN '中等匹配'
   WHEN raw_match_score * cast(0.7 AS double) + 30 >= 80 THEN '高度匹配' WHEN raw_match_score * cast(0.7 AS double) + 30 >= 60 THEN '中等匹配' ELSE '低度匹配' END AS match_level,
 CASE WHEN raw_match_score IS NULL THEN 0 ELSE 1 END AS n_suggestions, CASE WHEN raw_match_score IS NULL THEN 'no answer' ELSE 'fits' END AS analysis
FROM resumes_fx""", ("resumes_fx",))
def _(f):
    raw = F.col("raw_match_score").cast("string")
    score = (F.when(F.col("id") % 5 == 0, F.concat(F.lit('"'), raw, F.lit('"'))).when(raw.isNull(), raw)
             .when(F.col("id") % 5 == 1, F.lit('"很高"')).when(F.col("id") % 5 == 2, F.lit("null")).otherwise(raw))
    answer = F.coalesce(F.concat(
        F.lit('Here you are: {"match_score":'), score, F.lit(',"match_level":"自评"'),
        F.lit(',"detailed_analysis":"fits","suggestions":["【考核重点】沟通 - 【面试问题】如何?","建议您多练习"]} bye')),
        F.lit("no answer"))
    a = mj.match_analysis(answer)
    return f.resumes.select("id", a.alias("a")).select(
        "id", "a.match_score", "a.match_level", F.size("a.suggestions").alias("n_suggestions"),
        F.col("a.detailed_analysis").alias("analysis"))


@query("round_analysis", """
SELECT id, CASE WHEN round1_result IS NULL THEN 'bad {' ELSE round1_result END AS summary, coalesce(round2_result, '') AS conclusion
FROM (SELECT id, round1_result, CASE WHEN round1_result IS NOT NULL THEN round2_result END AS round2_result FROM interviews_fx) x""", ("interviews_fx",))
def _(f):
    text = F.coalesce(F.concat(F.lit('{"summary":"'), F.col("round1_result"), F.lit('","conclusion":"'),
                               F.coalesce("round2_result", F.lit("")), F.lit('"}')), F.lit("bad {"))
    a = mj.round_analysis(text)
    return f.interviews.select("id", a.alias("a")).select("id", "a.summary", "a.conclusion")


# --------------------------------------------------------------- re-extraction
_RE = """src AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'failed' ELSE 'success' END AS parse_status,
 CASE WHEN id % 8 = 0 THEN '文件不存在' WHEN id % 4 = 0 THEN '无法从文件中提取文本' END AS error_message FROM resumes_fx)"""


def _reextract(f: Fixtures) -> DataFrame:
    """Stored text for odd ids, file text for 2 mod 4, an empty file or none for the rest."""
    r = f.resumes.select("id", F.col("file_name").alias("file_path"),
                         F.when(F.col("id") % 2 == 1, "stored").alias("raw_text"))
    files = f.resumes.filter("id % 8 <> 0").select(
        F.col("file_name").alias("path"), F.when(F.col("id") % 4 == 2, "from file").alias("text"),
        F.lit(None).cast("string").alias("error"))
    return reextract_inputs(r, files)


@query("reextract_status", f"WITH {_RE} SELECT id, parse_status, error_message FROM src", ("resumes_fx",))
def _(f):
    return _reextract(f).select("id", "parse_status", "error_message")


@query("reextract_outcome", f"WITH {_RE} SELECT parse_status, count(*) AS n FROM src GROUP BY 1", ("resumes_fx",))
def _(f):
    return outcome_counts(_reextract(f))


@query("upsert_extracted", f"""
SELECT id, name, CASE WHEN id % 2 = 0 AND id % 4 <> 0 THEN '新大学' ELSE school END AS school,
 cast(CASE WHEN id % 2 = 1 THEN NULL WHEN coalesce(age_from_resume,0) <> 0 THEN age_from_resume
   WHEN birth_year IS NOT NULL THEN {AS_OF_YEAR} - birth_year END AS int) AS age,
 CASE WHEN id % 2 = 0 THEN 'success' ELSE parse_status END AS parse_status FROM resumes_fx
""", ("resumes_fx",))
def _(f):
    base = conform(f.resumes, schemas.RESUMES).withColumn("age", F.lit(None).cast("int"))
    new = f.resumes.filter("id % 2 = 0").select(
        "id", "name", "gender", "birth_year", F.col("age_from_resume").alias("age"), "phone", "email",
        "highest_education", F.when(F.col("id") % 4 != 0, "新大学").alias("school"),
        F.lit("").alias("major"), F.lit(None).cast(schemas.EXPERIENCES).alias("work_experience"),
        F.lit("t").alias("raw_text"))
    return upsert_extracted(base, new, AS_OF_YEAR).select("id", "name", "school", "age", "parse_status")


# ------------------------------------------- Chinese texts with known values
def _cv(f: Fixtures) -> DataFrame:
    return x.cleaned(f.cv_texts, "id", deal=False)


@query("extract_names", "SELECT id, name FROM cv_fx", ("cv_fx",))
def _(f):
    return _cv(f).select("id", x.name_expr(F.col("t"), F.col("kv")).alias("name"))


@query("extract_gender", "SELECT id, gender FROM cv_fx", ("cv_fx",))
def _(f):
    return _cv(f).select("id", x.gender_expr(F.col("t"), F.col("kv")).alias("gender"))


@query("extract_contacts", """
SELECT id, CASE WHEN id % 6 IN (0, 1) THEN phone END AS phone, CASE WHEN id % 6 IN (1, 5) THEN email END AS email FROM cv_fx
""", ("cv_fx",))
def _(f):
    return _cv(f).select("id", contact.phone_expr(F.col("t"), F.col("kv")).alias("phone"),
                         contact.email_expr(F.col("t"), F.col("kv")).alias("email"))


@query("extract_birth", f"""
SELECT id, CASE WHEN id % 6 IN (0, 3, 4) THEN birth_year END AS birth_year,
 CASE WHEN id % 6 IN (0, 3, 4) THEN {AS_OF_YEAR} - birth_year ELSE cast(age AS int) END AS age FROM cv_fx
""", ("cv_fx",))
def _(f):
    t, kv = F.col("t"), F.col("kv")
    df = _cv(f).select("id", "t", "kv", x.birth_year_expr(t, kv, AS_OF_YEAR).alias("birth_year"))
    return df.select("id", "birth_year", x.age_expr(t, kv, F.col("birth_year"), AS_OF_YEAR).alias("age"))


@query("extract_education", "SELECT id, level AS highest_education, school, major FROM cv_fx", ("cv_fx",))
def _(f):
    e = x.education_expr(F.col("t"), F.col("kv"), AS_OF_YEAR)
    return _cv(f).select("id", e.alias("e")).select("id", "e.highest_education", "e.school", "e.major")


@query("extract_experience", """
SELECT id, CASE WHEN id % 6 = 4 OR n_jobs = 0 THEN '' ELSE
   CASE WHEN n_jobs = 3 THEN c3 || '/' || position || '/2018/now;' ELSE '' END ||
   CASE WHEN n_jobs >= 2 THEN c2 || '/' || position || '/2013/2017;' ELSE '' END ||
   c1 || '/' || position || '/2010/2013;' END AS jobs FROM cv_fx
""", ("cv_fx",))
def _(f):
    jobs = F.transform(F.col("e"), lambda e: F.concat(F.concat_ws(
        "/", e.company, e.position, e.start_year.cast("string"), F.coalesce(e.end_year.cast("string"), F.lit("now"))), F.lit(";")))
    return _cv(f).select("id", x.work_experience_expr(F.col("t"), AS_OF_YEAR).alias("e")).select(
        "id", F.array_join(jobs, "").alias("jobs"))


@query("extract_cv", f"""
SELECT id, name, gender, CASE WHEN id % 6 IN (0, 3, 4) THEN birth_year END AS birth_year,
 CASE WHEN id % 6 IN (0, 3, 4) THEN {AS_OF_YEAR} - birth_year ELSE cast(age AS int) END AS age,
 CASE WHEN id % 6 IN (0, 1) THEN phone END AS phone, CASE WHEN id % 6 IN (1, 5) THEN email END AS email,
 level AS highest_education, school, major, CASE WHEN id % 6 = 4 THEN 0 ELSE n_jobs END AS n_jobs FROM cv_fx
""", ("cv_fx",))
def _(f):
    return x.extract_all(f.cv_texts, AS_OF_YEAR, deal=False).select(
        "id", "name", "gender", "birth_year", "age", "phone", "email", "highest_education", "school", "major",
        F.size("work_experience").alias("n_jobs"))


# ------------------------- long texts: what counts stands behind 60 lines, in each form a birth year is written in
_BIRTH_FORMS = ["出生：{y}", "生日：{y}", "出生日期：{y}-05-06", "{y}年5月6日出生", "{y}年出生", "出生年月：{y}年", "出生 {y}-05-06",
                "{y}/5月出生", "{y}-5出生", "出生地：武汉 2012年入职", "籍贯武汉 {y}年5月"]


def long_texts(f: Fixtures) -> DataFrame:
    """``id, text``: long résumés; the forms of the birth year take turns."""
    y = (1965 + F.col("id") % 30).cast("string")
    n = len(_BIRTH_FORMS)
    forms = [F.concat(*[y if part == "{y}" else F.lit(part) for part in re.split(r"(\{y\})", form) if part]) for form in _BIRTH_FORMS]
    birth = F.element_at(F.array(*forms), (F.col("id") % n + 1).cast("int"))
    gender = F.when(F.col("id") % 2 == 0, "男").otherwise("女")
    return dealt(f.resumes.select("id")).select("id", F.concat(
        F.lit("求职材料\n"), F.repeat(F.lit("性格开朗，善于沟通，愿意学习，能够适应新的环境\n"), 60),
        birth, F.lit("\n爱好阅读\n本人 "), gender, F.lit(" |\n")).alias("text"))


@query("extract_long_texts", f"""
SELECT id, CASE WHEN id % 2 = 0 THEN '男' ELSE '女' END AS gender,
 CASE WHEN id % {len(_BIRTH_FORMS)} <> 9 THEN cast(1965 + id % 30 AS int) END AS birth_year FROM resumes_fx""", ("resumes_fx",))
def _(f):
    t, kv = F.col("t"), F.col("kv")
    return x.cleaned(long_texts(f), "id", deal=False).select("id", x.gender_expr(t, kv).alias("gender"),
                                                 x.birth_year_expr(t, kv, AS_OF_YEAR).alias("birth_year"))


# a project line names the company and start of a work line before it: the work line's position counts, the latest end too
@query("extract_sections", """
SELECT id, '天成科技有限公司/会计/' || cast(2001 + id % 10 AS string) || '/' || cast(2015 + id % 5 AS string) ||
 CASE WHEN id % 3 = 0 THEN '' ELSE ';海川贸易有限公司/销售经理/1999/2000' END AS jobs FROM resumes_fx""", ("resumes_fx",))
def _(f):
    start, end = (2001 + F.col("id") % 10).cast("string"), (2015 + F.col("id") % 5).cast("string")
    text = F.concat(F.lit("项目经历\n"), start, F.lit(".03-2012.06 天成科技有限公司 工程师\n工作经历\n"), start, F.lit(".03-"), end,
                    F.lit(".08 天成科技有限公司 会计\n"), F.when(F.col("id") % 3 == 0, "").otherwise("1999.01-2000.05 海川贸易有限公司 销售经理\n"),
                    F.lit("教育背景\n1995-1999 武汉大学 本科 会计学"))
    e = x.work_experience_expr(F.col("t"), AS_OF_YEAR)
    jobs = F.transform(F.col("e"), lambda e: F.concat_ws("/", e.company, e.position, e.start_year.cast("string"), e.end_year.cast("string")))
    texts = dealt(f.resumes.select("id")).select("id", text.alias("text"))
    return x.cleaned(texts, "id", deal=False).select("id", e.alias("e")).select("id", F.array_join(jobs, ";").alias("jobs"))


@query("ages_derived", f"""
SELECT id, cast(CASE WHEN birth_year IS NOT NULL THEN {AS_OF_YEAR} - birth_year END AS int) AS age FROM resumes_fx""",
       ("resumes_fx",))
def _(f):
    return f.resumes.select("id", resolve_age(F.lit(None).cast("int"), F.col("birth_year"), AS_OF_YEAR).alias("age"))


def _json_fields(rows: DataFrame, fields: list[str]) -> DataFrame:
    return rows.select("id", F.json_tuple("json", *fields).alias(*fields))  # one pass over the text, however many fields


_RESUME_FIELDS = ["name", "gender", "birth_year", "phone", "email", "highest_education", "school", "major",
                  "applied_position", "parse_status"]
_INTERVIEW_FIELDS = ["resume_id", "name", "applied_position", "status", "round1_time", "round1_result", "round2_result",
                     "round3_result", "offer_issued", "offer_date", "offer_department", "onboard", "onboard_date"]


def _as_text(fields: list[str], table: str) -> str:
    return f"SELECT id, {', '.join(f'cast({f} AS string) AS {f}' for f in fields)} FROM {table}"


@query("resume_json", _as_text(_RESUME_FIELDS, "resumes_fx"), ("resumes_fx",))
def _(f):
    return _json_fields(to_json_rows(conform(f.resumes, schemas.RESUMES), "resumes"), _RESUME_FIELDS)


@query("interview_json", _as_text(_INTERVIEW_FIELDS, f"(SELECT *, {STATUS} AS status FROM interviews_fx) x"), ("interviews_fx",))
def _(f):
    return _json_fields(to_json_rows(with_status(f), "interviews"), _INTERVIEW_FIELDS)
