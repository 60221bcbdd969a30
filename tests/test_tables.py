"""Properties of the table operators on the derived tables."""

import datetime as dt

from pyspark.sql import functions as F

from talentgrid import schemas
from talentgrid.functions.status import interview_status
from talentgrid.operators import funnel, interviews as iv, listing as ls, maintain as mt
from talentgrid.sources import exports as ex, tables


def ivs(fx):
    return fx.interviews.withColumn("status", interview_status())


def test_totals_cover_positions(fx):
    total = funnel.funnel_total(fx.resumes, ivs(fx)).first()
    by = funnel.funnel_by_position(fx.resumes, ivs(fx)).collect()
    for c in funnel.COUNTS:
        assert total[c] >= sum(r[c] for r in by)
    assert all(r.pass_count <= r.interview_count for r in by)
    assert [r.position for r in by] == sorted(r.position for r in by)


def test_end_only_keeps_blank_first_round(spark):
    r = spark.createDataFrame([("p", dt.datetime(2020, 1, 1))], "applied_position string, upload_time timestamp")
    rows = [("p", None, "s"), ("p", "", "s"), ("p", "2024-05-01", "s"), ("p", "2025-05-01", "s")]
    i = spark.createDataFrame(rows, "applied_position string, round1_time string, status string").withColumns({
        "create_time": F.lit("2020-01-01").cast("timestamp"), "offer_issued": F.lit(0), "offer_date": F.lit(""),
        "onboard": F.lit(0), "onboard_date": F.lit("")})
    n = lambda *a: funnel.funnel_total(r, i, *a).first().interview_count
    assert (n(), n(None, "2024-12-31"), n("2024-01-01"), n("2024-01-01", "2024-12-31")) == (4, 2, 2, 1)


def test_last_instant_of_a_day(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 23, 59, 59)), (2, dt.datetime(2024, 1, 1, 23, 59, 59, 500000))],
                               "id int, t timestamp")
    assert [r.id for r in ls.between_ts(df, "t", None, "2024-01-01").collect()] == [1]


def test_pages_concatenate(fx):
    df = ls.sort_by(fx.resumes.filter("id < 100").select("id", "upload_time"))
    whole = [r.id for r in df.collect()]
    pages = [r.id for p in range(1, 20) for r in ls.page(df, p, 7).collect()]
    assert pages == whole


def test_search_wildcards_and_case(spark):
    df = spark.createDataFrame([(1, "Anna"), (2, "a_b"), (3, "É"), (4, "a\\b")], "id int, name string")
    find = lambda t: [r.id for r in ls.search(df, ["name"], t).orderBy("id").collect()]
    assert find("AN") == [1] and find("a_b") == [2, 4] and find("é") == [] and find("\\") == [4]
    assert find("") == [1, 2, 3, 4]


def test_filters_present_but_null(fx):
    assert ls.list_resumes(fx.resumes, {"parse_status": None}).count() == 0
    assert ls.list_resumes(fx.resumes, {"name": None}, limit=5).count() == 5


def test_partial_update_without_keys_only_touches(fx):
    u = fx.resumes.select("id", "school", F.array().cast("array<string>").alias("present"))
    out = mt.drop_marks(mt.partial_update(fx.resumes, u, touched_at=F.lit("2030-01-01").cast("timestamp")))
    same = out.drop("updated_at").exceptAll(fx.resumes.drop("updated_at")).count()
    assert same == 0 and out.filter("updated_at = '2030-01-01'").count() == out.count()


def test_update_resumes_derives(spark):
    base = mt.conform(spark.createDataFrame([(1, 1980, None, 44), (2, 1980, 50, 50)], "id long, birth_year int, age_from_resume int, age int"),
                      schemas.RESUMES)
    u = spark.createDataFrame([(1, 1990, ["birth_year", "work_experience"]), (2, 1990, ["birth_year"])],
                              "id long, birth_year int, present array<string>").withColumn(
        "work_experience", F.array(F.struct(F.lit("c").alias("company"), F.lit("p").alias("position"),
                                            F.lit(2011).alias("start_year"), F.lit(None).cast("int").alias("end_year"))))
    got = {r.id: r for r in mt.update_resumes(base, u, 2026).collect()}
    assert (got[1].age, got[1].earliest_work_year, got[2].age, got[2].earliest_work_year) == (36, 2011, 50, None)


def test_json_rows(fx):
    import json
    row = json.loads(tables.to_json_rows(mt.conform(fx.resumes, schemas.RESUMES), "resumes").filter("id = 1").first().json)
    assert "file_path" not in row and row["match_level"] is None and row["upload_time"].startswith("1")


def test_registration_rows(spark):
    df = spark.createDataFrame([(1, "n", "汉", "省", None, "区", "[1", '[{"company":"a"},{"company":"b"},{"company":"c"}]')], (
        "id long, name string, registration_form_ethnicity string, registration_form_address_province string, "
        "registration_form_address_city string, registration_form_address_district string, "
        "registration_form_consideration_factors string, registration_form_recent_work_experience string")
    ).withColumn("applied_position", F.lit(None).cast("string"))
    r = ex.registration_rows(df).first()
    assert (r.ethnicity, r.address, r.factors) == ("汉", "省  区", [])
    assert [e.company for e in r.work_experience] == ["a", "b", "c"]
    assert [e.company for e in ex.registration_rows(df, 2).first().work_experience] == ["a", "b"]


def test_report_suggestions(spark):
    df = spark.createDataFrame([(1,)], "id long").withColumns({
        "applied_position": F.lit(""), "work_experience": F.lit(None).cast(schemas.EXPERIENCES),
        "match_analysis": F.struct(F.lit(80.0).alias("match_score"), F.lit("高度匹配").alias("match_level"), F.lit("").alias("detailed_analysis"),
                                   F.array(F.lit("s1")).alias("strengths"), F.array().cast("array<string>").alias("weaknesses"),
                                   F.array(F.lit("【考核重点】a - 【面试问题】b"), F.lit("x")).alias("suggestions"))})
    rows = [(r.section, r.label, r.value) for r in ex.report_rows(df).collect()]
    assert (1, "应聘岗位", "-") in rows and (4, "工作经历", "暂无工作经历") in rows
    assert [r for r in rows if r[0] == 5] == [(5, "匹配度分数", "80"), (5, "匹配等级", "高度匹配"), (5, "优势", "s1"),
                                             (5, "考核重点", "a"), (5, "面试问题", "b"), (5, "建议", "x")]


def test_csv_sink_with_one_mark(spark, tmp_path, fx):
    ex.write_csv(ex.export_resumes_csv(fx.resumes.limit(3)).coalesce(1), str(tmp_path / "o"), bom=True)
    data = next((tmp_path / "o").glob("*.csv")).read_bytes()
    assert data.startswith(b"\xef\xbb\xbfID,") and data.count(b"\xef\xbb\xbf") == 1


def test_typed_scan(spark, tmp_path, fx):
    fx.users.withColumn("password_hash", F.lit("x")).write.parquet(str(tmp_path / "u"))
    df = tables.load_table(spark, "users", str(tmp_path / "u"))
    assert df.columns == [f.name for f in schemas.USERS] and df.count() == fx.users.count()


def test_visible_users(fx):
    assert ls.visible_users(fx.users, "user5").count() == fx.users.count()
    assert [r.username for r in ls.visible_users(fx.users, "user7").collect()] == ["user7"]


def test_token_prefers_the_earliest_round(spark):
    df = spark.createDataFrame([(1, "x", "t", None), (2, "t", None, None), (3, None, None, "t")],
                               "id long, round1_comment_token string, round2_comment_token string, round3_comment_token string")
    assert tuple(iv.resolve_token(df, " t ").first()) == (2, 1)


def test_changed_since(spark, fx):
    t = {"resumes": fx.resumes}
    assert mt.changed_since(t, "nonsense").first().resumes is False
    assert mt.changed_since(t, "1990-01-01T00:00:00Z").first().resumes is True
    newest = fx.resumes.agg(F.max("updated_at")).first()[0]
    assert mt.changed_since(t, newest.isoformat()).first().resumes is False


def test_pushdown_and_pruning(spark, tmp_path, fx):
    path = str(tmp_path / "r")
    mt.conform(fx.resumes, schemas.RESUMES).write.parquet(path)
    df = ls.filter_eq(tables.load_table(spark, "resumes", path), gender="女").select("id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint,gender:string>" in plan and "EqualTo(gender,女)" in plan


def test_json_fields_are_read_in_one_pass(spark):
    from talentgrid.plans.extraction import _json_fields
    rows = spark.createDataFrame([(1, '{"a":"x\\"y","b":7,"c":null}'), (2, '{"b":"","a":"姓名"}'), (3, None)], "id int, json string")
    out = _json_fields(rows, ["a", "b", "c"])
    assert [tuple(r) for r in out.orderBy("id").collect()] == [(1, 'x"y', "7", None), (2, "姓名", "", None), (3, None, None, None)]
    assert "get_json_object" not in out._jdf.queryExecution().optimizedPlan().toString()
