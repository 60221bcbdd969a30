"""Hand-derived cases for scalar functions."""

from pyspark.sql import functions as F

from talentgrid.functions import candidate as cd, contact, education as edu, model_json as mj, text as tx
from talentgrid.functions.status import interview_status
from talentgrid import schemas


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column.alias("v")).first().v


def many(spark, build, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r.v for r in df.select("i", build(F.col("c")).alias("v")).orderBy("i").collect()]


def test_rescale_and_level(spark):
    got = many(spark, lambda c: F.concat_ws(" ", cd.rescale_score(c), cd.match_level(cd.rescale_score(c))),
               [None, 0, 42, 43, 71, 72, 100], "int")
    assert got == ["72 中等匹配", "50 低度匹配", "59 低度匹配", "60 中等匹配", "79 中等匹配",
                   "80 高度匹配", "100 高度匹配"]


def test_identity_code(spark):
    df = spark.createDataFrame([("张三", "13812345678"), ("张三", "123"), ("张三", None), (None, "138")],
                               "n string, p string")
    got = [r.v for r in df.select(cd.identity_code(F.col("n"), F.col("p")).alias("v")).collect()]
    assert got == ["张三5678", "张三", "张三", ""]


def test_range_label_and_years(spark):
    df = spark.createDataFrame([(2019, 2020), (2019, None), (None, 2020), (None, None), (0, 0)], "a int, b int")
    got = [r.v for r in df.select(cd.range_label(F.col("a"), F.col("b")).alias("v")).collect()]
    assert got == ["2019-2020", "2019-至今", "至2020", "", ""]
    exp = [("甲公司", "岗", 2015, None), ("乙公司", "岗", 2012, 2014)]
    df = spark.createDataFrame([(2010, exp), (2030, exp), (None, exp)],
                               "e int, w array<struct<company:string,position:string,start_year:int,end_year:int>>")
    got = [r.v for r in df.select(cd.years_of_service(F.col("e"), F.col("w"), 2024).alias("v")).collect()]
    assert got == [14, None, 12]
    assert df.select(cd.experience_block(F.col("w")).alias("v")).first().v == \
        "甲公司 | 岗 | 2015-至今\n乙公司 | 岗 | 2012-2014"


def test_ocr_repair(spark):
    assert many(spark, tx.ocr_repair, ["2O25", "2O025", "2025.O3", "a@4q.com", "a@12Q.COM"]) == [
        "2O25", "20025", "2025.03", "a@qq.com", "a@qq.com"]
    assert many(spark, lambda c: tx.ocr_repair(c, fix_years=True), ["2O25"]) == ["2025"]


def test_line_repair(spark):
    got = many(spark, lambda c: tx.repair_line_breaks("c"),
               ["北京\n公司", "abc\n123", "工作内容。\n下一行", "第一行,\n第二行", "ab\n\ncd", "", "尾-\n接"])
    assert got == ["北京公司", "abc123", "工作内容。\n下一行", "第一行,\n第二行", "ab\ncd", "", "尾-\n接"]


def test_phone_year_education(spark):
    assert many(spark, contact.phone, ["138-4946-2558", "138 4946 2558", "x138494625589"]) == [
        "13849462558", "13849462558", None]
    assert many(spark, lambda c: contact.year_in(c, 2026), ["2019.03", "1979", "2099", ""]) == [
        2019, None, None, None]
    words = ["PhD", "information systems", "高职", "职高", None]
    assert many(spark, edu.detect_education, words) == ["博士", "硕士", "中专", None, None]
    assert many(spark, lambda c: edu.detect_education(c, strict=True), words)[1] is None
    assert many(spark, edu.normalize_education, ["研究生/硕士", "统招本科", "junior college", "x"]) == [
        "硕士", "本科", "专科", None]
    levels = spark.createDataFrame([(["大专", "硕士", "研究生"],)], "c array<string>")
    assert levels.select(edu.highest_level(F.col("c")).alias("v")).first().v == "硕士"


def test_company_school_major(spark):
    assert many(spark, edu.is_company, ["恒源艺术馆", "负责公司", "ABC", "公司", None]) == [
        True, False, False, False, False]
    assert many(spark, edu.clean_school, ["毕业院校：北京大学，", "2008年9月清华大学", "学校"]) == [
        "北京大学", "清华大学", "学校"]
    assert many(spark, edu.clean_major, ["专业：计算机科学专业", "负责客户", "管理客户", "英语（师范）", "软件2班", "工商管理"]) == [
        "计算机科学", None, None, "英语", None, "工商管理"]


def test_key_values(spark):
    kv = one(spark, tx.parse_key_values("c"), "姓名：张三 性别: 男\n手机号：13812345678\n姓名：李四\n学历：\n专业：会计学与审计")
    assert kv["姓名"] == "张三" and kv["手机号"] == "13812345678" and kv["专业"] == "会计学与审计"
    assert one(spark, tx.parse_key_values("c"), "姓名：张\n三丰")["姓名"] == "张 三丰"
    assert one(spark, tx.parse_key_values("c"), "姓名：张\n负责销售")["姓名"] == "张"


def test_clean_document_text(spark):
    got = one(spark, tx.clean_document_text(F.col("c")), "\n\n\na \t b  \n　\n\n\nc□\n--- 第1页 ---\n\n")
    assert got == "\na b\n\nc\n--- 第1页 ---\n"


def test_clean_resume_text(spark):
    got = one(spark, tx.clean_resume_text(F.col("c")),
              "姓⺠名：张 三\r\n２０１９\n-\n２０２０ 北京\n公司 工作经历 abcdefghijklmnopqrstu x｜y")
    assert got == "姓名:张三\n2019-2020 北京公司\n工作经历 x y"


def test_chunks_cover_the_text(spark):
    df = spark.createDataFrame([(1, "ab" * 12001), (2, ""), (3, "x" * 12000)], "id int, t string")
    parts = tx.chunk_text(df, "id", "t").collect()
    assert {(r.id, r.chunk_no): len(r.chunk) for r in parts} == {
        (1, 0): 12000, (1, 1): 12000, (1, 2): 2, (2, 0): 0, (3, 0): 12000}


def test_best_extraction_first_when_none_qualifies(spark):
    df = spark.createDataFrame([(1, 1, "a", "x" * 40), (1, 2, "b", "y" * 40),
                                (2, 1, "a", "短" * 10), (2, 2, "b", "中文" * 40)],
                               "doc_id int, method_no int, method string, text string")
    assert {r.doc_id: r.method for r in tx.best_extraction(df).collect()} == {1: "a", 2: "b"}


STATUS = [
    (dict(), "待面试"), (dict(r1="未通过"), "一面面试未通过"), (dict(r1="通过"), "一面面试通过"),
    (dict(r1="待定"), "一面面试通过"), (dict(r1="待定", r2="未通过"), "二面面试未通过"),
    (dict(r1="通过", r2="通过"), "面试通过"), (dict(r1="通过", r2="通过", e=1), "二面面试通过"),
    (dict(r1="通过", r2="待定", r3="通过"), "面试通过"), (dict(r1="通过", r2="待定"), "待面试"),
    (dict(r1="通过", r2="通过", e=1, r3="未通过"), "三面面试未通过"),
    (dict(o=1, od="2024", odep="d", r1="未通过"), "一面面试未通过"),
    (dict(o=1, od="2024", odep="d", plan="2024", r1="未通过"), "已发offer"),
    (dict(b=1, bd="2024", bdep="d"), "已入职"),
]


def test_interview_status(spark):
    keys = ["r1", "r2", "e", "r3", "o", "od", "odep", "plan", "b", "bd", "bdep"]
    rows = [(i, *[case.get(k) for k in keys]) for i, (case, _) in enumerate(STATUS)]
    df = spark.createDataFrame(rows, (
        "i int, round1_result string, round2_result string, round3_enabled int, round3_result string, "
        "offer_issued int, offer_date string, offer_department string, offer_onboard_plan_date string, "
        "onboard int, onboard_date string, onboard_department string"))
    got = [r.v for r in df.select("i", interview_status().alias("v")).orderBy("i").collect()]
    assert got == [want for _, want in STATUS]


def test_model_answers(spark):
    answer = ('```json\n{"name":"姓名：高峰","gender":"male","birth_year":2025,"phone":"138 1234 5678",'
              '"email":"x","highest_education":"MBA研修","work_experience":[{"company":"甲","start_year":1970},'
              '{"company":"","position":null}]}\n```')
    m = mj.normalize_model(mj.parse_model_json(F.col("c"), schemas.MODEL_ANSWER, fenced=True), 2026)
    r = one(spark, m, answer)
    assert (r["name"], r.gender, r.birth_year, r.phone, r.email, r.highest_education) == (
        "高峰", None, 2025, "13812345678", None, "硕士")
    assert [e.company for e in r.work_experience] == ["甲"] and r.work_experience[0].start_year is None
    assert one(spark, m, '{"highest_education":"函授"}').highest_education == "函授"
    assert one(spark, m, "not json") is None
    a = one(spark, mj.match_analysis(F.col("c")), 'so: {"match_score": 72, "suggestions": '
            '["【考核重点】a - 【面试问题】b", "建议您"]}')
    assert (a.match_score, a.match_level, a.suggestions) == (80, "高度匹配", ["【考核重点】a - 【面试问题】b"])
    bad = one(spark, mj.match_analysis(F.col("c")), "oops")
    assert (bad.match_score, bad.detailed_analysis, bad.suggestions) == (65, "oops", [])
    long = "x" * 900
    assert one(spark, mj.match_analysis(F.col("c")), long).detailed_analysis == long
    assert [one(spark, mj.match_analysis(F.col("c")), f'{{"match_score": {v}, "match_level": "m"}}')[:2] for v in
            ('"85"', "null", '"?"')] == [(89, "高度匹配"), (72, "中等匹配"), (None, "m")]


def test_form_values_and_lists(spark):
    assert many(spark, cd.unwrap_form_value, ['{"value":"v"}', '{"value":"","label":"l"}', '{"x":1}', "plain", None]) == [
        "v", "l", "", "plain", None]
    assert many(spark, cd.json_list, ['["a"]', "bad", "", None]) == [["a"], [], [], []]


def test_union_and_order_of_experiences(spark):
    e = schemas.EXPERIENCES
    df = spark.createDataFrame([([("甲", "a", 2010, None)], [("甲", "b", 2010, None), ("乙", "c", None, 2012),
                                                              ("丙", "d", None, None)])], "a array<struct<company:string,position:string,start_year:int,end_year:int>>, b array<struct<company:string,position:string,start_year:int,end_year:int>>")
    u = df.select(cd.union_experiences(F.col("a").cast(e), F.col("b").cast(e)).alias("u"))
    assert [x.position for x in u.first().u] == ["a", "c", "d"]
    assert [x.position for x in u.select(cd.sort_experiences(F.col("u")).alias("s")).first().s] == ["c", "a", "d"]


def test_kept_characters_and_texts_that_need_no_normal_form(spark):
    old = r"[^一-龥A-Za-z0-9\s.,;:：，。；、！？()（）【】\[\]《》\-+*/=@#%&·•~]"
    chars = spark.range(0x1f700).filter("id NOT BETWEEN 55296 AND 57343").select(
        F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    keeps = [F.regexp_replace("c", p, "<>") for p in (tx.KEPT_CHARS, old)]
    assert chars.filter(keeps[0] != keeps[1]).count() == 0 and chars.filter(keeps[0] == "<>").count() > 50000
    texts = spark.createDataFrame([("plain ASCII",), ("Ｗｉｄｅ ①",), ("",), (None,)], "c string")
    cleaned = texts.select(tx.clean_resume_text(F.col("c")).alias("c"))
    assert [r.c for r in cleaned.collect()] == ["plain ASCII", "Wide 1", "", None]
    plan = cleaned._jdf.queryExecution().optimizedPlan().toString()
    assert "nfkc(CASE WHEN RLIKE(c#" in plan  # before, every text went to Python
