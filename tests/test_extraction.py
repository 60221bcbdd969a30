"""Extraction rules on hand-written résumés, DOCX decoding and the ingest job."""

import io
import zipfile

from pyspark.sql import functions as F

from talentgrid.operators import extraction as x
from talentgrid.sources.documents import docx_text, scan_documents
from talentgrid.streaming import feeds

RESUME = """姓名：张三丰　性别：男
出生年月：1990年5月 手机：138-4946-2558
邮箱：zhangsan@4q.com
最高学历：本科 毕业院校：西安交通大学 专业：人力资源管理
工作经历
2019.02-2020.05 陕西康华医药分公司 储备干部、质量管理
2016.9-2019.2 恒源艺术馆·销售主管
教育经历
2008-2012 西安交通大学 本科 人力资源管理
"""


def experiences(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return [tuple(e) for e in x.work_experience(df, 2026).first().work_experience]


def test_work_lines(spark):
    cases = {
        "2018.07—2019.01 陕西华森特保健公司 保健品广告策划": ("陕西华森特保健公司", "保健品广告策划", 2018, 2019),
        "2016.9-2019.2 恒源艺术馆·销售主管": ("恒源艺术馆", "销售主管", 2016, 2019),
        "2019 翔海集团房产开发有限公司 销售顾问": ("翔海集团房产开发有限公司", "销售顾问", 2019, None),
        "2019.02-2020.05 陕西康华医药分公司 储备干部、质量管理": ("陕西康华医药分公司", "储备干部", 2019, 2020),
        "2020年9月--2021年2月 在斯维教育进行课程教学工作": ("斯维教育", "课程教学", 2020, 2021),
        "北京云途科技有限公司 产品经理 2021.03-至今": ("北京云途科技有限公司", "产品经理", 2021, None),
    }
    for line, want in cases.items():
        assert experiences(spark, line) == [want], line


def test_work_context(spark):
    text = "天地集团\n2019-2020 销售主管\n2017-2018\n中华有限公司\n工程师\n教育经历\n2010-2014 北京大学"
    assert experiences(spark, text) == [("天地集团", "销售主管", 2019, 2020), ("中华有限公司", "工程师", 2017, 2018)]


def test_work_merge(spark):
    text = "2019-2020 甲乙公司\n2019-2021 甲乙公司 会计主管\n2019-至今 甲乙公司"
    assert experiences(spark, text) == [("甲乙公司", "会计主管", 2019, 2021)]


def test_extract_all(spark):
    df = spark.createDataFrame([(1, RESUME), (2, None), (3, "个人简历\n李宜隆\n女 | 28岁\n13912345678")], "id long, text string")
    r = {row.id: row for row in x.extract_all(df, 2026).collect()}
    a = r[1]
    assert (a["name"], a.gender, a.birth_year, a.age, a.phone, a.email) == (
        "张三丰", "男", 1990, 36, "13849462558", "zhangsan@qq.com")
    assert (a.highest_education, a.school, a.major, a.earliest_work_year) == (
        "本科", "西安交通大学", "人力资源管理", 2016)
    assert [e.company for e in a.work_experience] == ["陕西康华医药分公司", "恒源艺术馆"]
    assert r[2]["name"] is None and r[2].work_experience == []
    assert (r[3].age, r[3].phone, r[3].gender) == (28, "13912345678", "女")


def test_name_rules_one_by_one(spark):
    def rules(text):
        df = spark.createDataFrame([(text,)], "t string").select("t", x.parse_key_values("t").alias("kv"))
        cols = [c.alias(n) for n, c in x.name_rules(F.col("t"), F.col("kv")).items()]
        return df.select(*cols).first().asDict()
    assert rules("姓名:欧阳小明性别:男")["key_value"] == "欧阳小明"
    assert rules("王小二 先生")["title"] == "王小二"
    assert rules("赵六一 a@b.com")["before_email"] == "赵六一"
    assert rules("a@b.com 钱七")["after_email"] == "钱七"
    assert rules("孙八 13912345678")["before_phone"] == "孙八"
    assert rules("期望城市 13912345678")["before_phone"] is None
    assert rules("个人简历\n周九\nx")["short_line"] is not None
    assert rules("性别 年龄 出生 ABCDEFGHIJKLMNOP 李雷 和别人")["opening"] == "李雷"
    assert rules("x" * 20 + " 13812345678 赵六")["around_contact"] == "赵六"


def test_education_levels_clear_major(spark):
    df = spark.createDataFrame([(1, "学历：高中\n专业：会计"), (2, "2010-2013 西北大学 硕士 软件工程\n教育经历\n2006-2010 长安大学 本科 电子信息\n2010-2013 西北大学 硕士 软件工程")],
                               "id long, text string")
    r = {row.id: row for row in x.extract_all(df, 2026).collect()}
    assert (r[1].highest_education, r[1].major) == ("高中", None)
    assert (r[2].highest_education, r[2].school, r[2].major) == ("硕士", "西北大学", "软件工程")


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(body, header="", footer=""):
    par = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        if header:
            z.writestr("word/header1.xml", f"<w:hdr {W}>{par(header)}</w:hdr>")
        if footer:
            z.writestr("word/footer1.xml", f"<w:ftr {W}>{par(footer)}</w:ftr>")
    return buf.getvalue()


PAR = "<w:p><w:r><w:t>{}</w:t></w:r></w:p>"
CELL = "<w:tc>" + PAR + "</w:tc>"


def test_docx_and_ingest(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    body = PAR.format("姓名：张三") + PAR.format(" ") + "<w:tbl><w:tr>" + CELL.format("手机：") + CELL.format("13912345678") + "</w:tr></w:tbl>"
    (src / "a.docx").write_bytes(docx(body, "页眉", "页脚"))
    (src / "b.docx").write_bytes(b"not a zip")
    (src / "c.doc").write_bytes(b"old")
    (src / "d.txt").write_bytes(b"text")
    (src / "e.docx").write_bytes(docx(""))
    files = scan_documents(spark, str(src))
    assert {r.path[-5:]: r.accepted for r in files.select("path", "accepted").collect()}["d.txt"] is False
    got = {r.path.rsplit("/", 1)[1]: r for r in docx_text(files).collect()}
    assert got["a.docx"].text == "页眉\n姓名：张三\n手机： 13912345678\n页脚"
    assert all(got[n].text is None and got[n].error for n in ("b.docx", "c.doc", "e.docx"))
    for _ in range(2):  # the second run finds nothing new and changes nothing
        feeds.ingest_stream(spark, str(src), str(tmp_path / "out"), str(tmp_path / "ckpt"), 2026).awaitTermination()
        rows = {r.path.rsplit("/", 1)[1]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
        assert {n: r.parse_status for n, r in rows.items()} == {
            "a.docx": "success", "b.docx": "failed", "c.doc": "failed", "d.txt": "failed", "e.docx": "failed"}
        assert rows["a.docx"]["name"] == "张三" and rows["a.docx"].phone == "13912345678"


def test_reextract(spark):
    from talentgrid import schemas
    from talentgrid.operators.maintain import conform
    from talentgrid.operators.reextract import reextract
    base = conform(spark.createDataFrame(
        [(1, "a.docx", "旧", "姓名：新名 手机：13912345678", "西北大学"), (2, "b.docx", "乙", None, None),
         (3, "c.docx", "丙", None, None), (4, "d.docx", "丁", None, None)],
        "id long, file_path string, name string, raw_text string, school string"), schemas.RESUMES)
    texts = spark.createDataFrame([("b.docx", "姓名：文件名 性别：女", None), ("c.docx", None, "坏")],
                                  "path string, text string, error string")
    r = {x.id: x for x in reextract(base, texts, 2026).collect()}
    assert (r[1]["name"], r[1].phone, r[1].school, r[1].parse_status) == ("新名", "13912345678", "西北大学", "success")
    assert (r[2]["name"], r[2].gender, r[2].parse_status) == ("文件名", "女", "success")
    assert [(r[i]["name"], r[i].parse_status, r[i].error_message) for i in (3, 4)] == [
        ("丙", "failed", "坏"), ("丁", "failed", "文件不存在")]


def test_line_work_is_linear(spark):
    """Twenty thousand lines, each tenth dated: the company seen last and equal entries are not searched for again and again."""
    import time
    lines = []
    for n in range(20000):
        lines.append(f"{1980 + n % 40}.03-{1981 + n % 40}.06" if n % 10 == 5 else f"甲乙{n // 10 % 50}科技有限公司" if n % 10 == 0 else "日常沟通记录")
    begin = time.time()
    got = experiences(spark, "\n".join(lines))
    assert time.time() - begin < 60
    # the range stands alone on its line: the company is that of the last company line
    assert {(g[0], g[2]) for g in got} == {(f"甲乙{n // 10 % 50}科技有限公司", 1980 + n % 40) for n in range(5, 20000, 10)}


def test_texts_of_one_small_file_are_dealt(spark, fx):
    from talentgrid.plans import load_all
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    one = spark.createDataFrame([(i, RESUME) for i in range(40)], "id long, text string").coalesce(1)
    assert x.extract_all(one, 2026).rdd.getNumPartitions() == tasks > 1
    for name in ("extract_labelled", "extract_cv", "extract_education", "extract_long_texts"):
        counts = load_all().QUERIES[name](spark, fx.sf_dir).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
        assert len(counts) == tasks and max(counts) < 1.2 * sum(counts) / tasks, (name, counts)
