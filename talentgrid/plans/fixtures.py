"""Recruiting tables derived from the TPC-H-like test tables.

The SQL text runs unchanged on Spark and on DuckDB: ``{orders}`` and friends
are filled with a DataFrame for one and with the view name for the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from talentgrid.session import dealt

SOURCES = ["region", "nation", "customer", "supplier", "part", "orders",
           "lineitem", "events", "documents", "conversations"]

# (l_orderkey, l_linenumber) repeats in lineitem, so it is made unique first
LI_FX = """
SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey, min(l_partkey) AS l_partkey,
  min(l_quantity) AS l_quantity, min(l_discount) AS l_discount, min(l_tax) AS l_tax,
  min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus, min(l_shipdate) AS l_shipdate
FROM {lineitem} GROUP BY l_orderkey, l_linenumber
"""

RESUMES_FX = """
SELECT o_orderkey AS id,
  'cv' || cast(o_orderkey AS string) || CASE o_orderkey % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.docx' WHEN 2 THEN '.doc' ELSE '.txt' END AS file_name,
  cast(o_orderdate AS timestamp) AS upload_time,
  CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE c_name END AS name,
  CASE o_orderstatus WHEN 'F' THEN '男' WHEN 'O' THEN '女' END AS gender,
  cast(CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 1960 + o_custkey % 45 END AS int) AS birth_year,
  cast(CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 22 + o_custkey % 40 END AS int) AS age_from_resume,
  CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN ph ELSE substr(ph,1,3) || '-' || substr(ph,4,4) || '-' || substr(ph,8,4) END AS phone,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderkey % 6 = 1 THEN upper(em) ELSE em END AS email,
  CASE o_orderpriority WHEN '1-URGENT' THEN '博士' WHEN '2-HIGH' THEN '硕士' WHEN '3-MEDIUM' THEN '本科' WHEN '4-NOT SPECIFIED' THEN '专科' ELSE '高中' END AS highest_education,
  n_name || CASE WHEN o_orderkey % 2 = 0 THEN '大学' ELSE '大学商学院' END AS school,
  CASE o_custkey % 4 WHEN 0 THEN '人力资源管理' WHEN 1 THEN '计算机' WHEN 2 THEN '市场营销' END AS major,
  CASE WHEN o_orderkey % 31 = 0 THEN NULL WHEN o_orderkey % 37 = 0 THEN '' ELSE c_mktsegment END AS applied_position,
  CASE o_orderkey % 10 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' ELSE 'success' END AS parse_status,
  cast(CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE cast(floor(o_totalprice) AS bigint) % 101 END AS int) AS raw_match_score,
  'user' || cast(o_custkey % 25 AS string) AS created_by,
  cast(o_orderdate AS timestamp) AS updated_at
FROM (SELECT o.*, c.c_name, c.c_mktsegment, n.n_name,
        cast(13000000000 + (o_custkey * 104729) % 1000000000 AS string) AS ph,
        'c' || cast(o_custkey AS string) || '@mail' || cast(o_custkey % 9 AS string) || '.example.com' AS em
      FROM {orders} o JOIN {customer} c ON o_custkey = c_custkey JOIN {nation} n ON c_nationkey = n_nationkey) b
"""

EXPERIENCE_FX = """
SELECT l_orderkey AS resume_id, cast(l_linenumber AS int) AS seq, s_name || '公司' AS company, p_type AS position,
  cast(year(l_shipdate) AS int) AS start_year,
  cast(CASE WHEN l_linestatus = 'O' THEN NULL ELSE year(l_shipdate) + l_linenumber % 4 END AS int) AS end_year
FROM {li_fx} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {part} ON l_partkey = p_partkey
"""

INTERVIEWS_FX = """
SELECT l_orderkey * 8 + l_linenumber AS id,
  CASE WHEN (l_orderkey + l_linenumber) % 23 = 0 THEN l_orderkey + 1000000000 ELSE l_orderkey END AS resume_id,
  r.name AS name, r.applied_position AS applied_position, cast(NULL AS string) AS identity_code,
  CASE l_linenumber WHEN 4 THEN NULL WHEN 3 THEN '' ELSE d END AS round1_time,
  CASE l_returnflag WHEN 'A' THEN '通过' WHEN 'R' THEN '未通过' END AS round1_result,
  CASE WHEN l_quantity < 10 THEN NULL WHEN l_quantity < 20 THEN '未通过' WHEN l_quantity < 45 THEN '通过' ELSE '待定' END AS round2_result,
  cast(l_linenumber % 2 AS int) AS round3_enabled,
  CASE WHEN l_tax < 0.02 THEN NULL WHEN l_tax < 0.04 THEN '未通过' ELSE '通过' END AS round3_result,
  cast(CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END AS int) AS offer_issued,
  CASE WHEN l_discount >= 0.06 THEN d WHEN l_discount >= 0.05 THEN '' END AS offer_date,
  'dept' || cast(l_suppkey % 7 AS string) AS offer_department,
  CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE d END AS offer_onboard_plan_date,
  cast(CASE WHEN l_discount >= 0.08 THEN 1 ELSE 0 END AS int) AS onboard,
  CASE WHEN l_discount >= 0.09 THEN d END AS onboard_date,
  CASE WHEN l_suppkey % 2 = 0 THEN 'dept' || cast(l_suppkey % 7 AS string) END AS onboard_department,
  cast(l_shipdate AS timestamp) AS create_time, cast(l_shipdate AS timestamp) AS update_time
FROM (SELECT *, substr(cast(l_shipdate AS string),1,10) AS d FROM {li_fx}) l JOIN {resumes_fx} r ON l_orderkey = r.id
"""

USERS_FX = """
SELECT cast(c_custkey AS bigint) AS id, 'user' || cast(c_custkey AS string) AS username,
  CASE c_custkey % 5 WHEN 0 THEN 'admin' WHEN 1 THEN 'manager' ELSE 'employee' END AS role,
  CASE WHEN c_custkey % 6 = 0 THEN '' ELSE r_name END AS department,
  CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE n_name END AS group_name, cast(1 AS int) AS is_active
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
"""

# ids follow name order; the distinct names are ranked, never the rows
POSITIONS_FX = """
SELECT cast(row_number() OVER (ORDER BY c_mktsegment) AS bigint) AS id, c_mktsegment AS position_name,
  'work ' || lower(c_mktsegment) AS work_content
FROM (SELECT DISTINCT c_mktsegment FROM {customer}) x
"""

# Chinese résumé texts in six layouts, with the values that are in them
CV_FX = """
SELECT *, CASE id % 6
    WHEN 0 THEN '姓名：' || name || nl || '性别：' || gender || nl || '出生年月：' || by4 || '年5月' || nl || '电话：' || phone || nl || '学历：' || level || nl || '毕业院校：' || school || nl || '专业：' || major || nl || '工作经历' || nl || jobs
    WHEN 1 THEN phone || ' ' || email || nl || name || ' ' || gender || ' | ' || age || '岁' || nl || '教育经历' || nl || school || '，' || level || '，' || major || nl || '工作经历' || nl || jobs
    WHEN 2 THEN name || nl || gender || '|' || age || '岁' || nl || '教育背景' || nl || '2006-2010 ' || school || ' ' || level || ' ' || major || nl || '工作经验' || nl || jobs
    WHEN 3 THEN '个人简历' || nl || '姓名：' || name || nl || '性别：' || gender || nl || '出生日期：' || by4 || '-05-06' || nl || '学历：' || level || nl || '工作经历' || nl || jobs || nl || '教育背景' || nl || '毕业院校：' || school || nl || '专业：' || major
    WHEN 4 THEN '基本信息' || nl || '姓名 ' || name || nl || '性别 ' || gender || nl || '生日：' || by4 || '年5月6日' || nl || '最高学历：' || level || nl || '毕业院校：' || school || nl || '专业：' || major
    ELSE '邮箱：' || email || nl || '姓名：' || name || nl || '性别：' || gender || nl || '年龄：' || age || '岁' || nl || '学历：' || level || nl || '毕业院校：' || school || nl || '专业：' || major || nl || '工作经历' || nl || jobs END AS text
FROM (SELECT *,
    CASE n_jobs WHEN 0 THEN '' WHEN 1 THEN j1 WHEN 2 THEN j2 || nl || j1 ELSE j3 || nl || j2 || nl || j1 END AS jobs
  FROM (SELECT *,
      '2010.03-2013.06 ' || c1 || ' ' || position AS j1, '2013.07-2017.08 ' || c2 || ' ' || position AS j2,
      '2018年1月-至今 ' || c3 || ' ' || position AS j3
    FROM (SELECT id, chr(10) AS nl,
        substr('王李张刘陈杨赵黄周吴', cast(1 + id % 10 AS int), 1) || substr('伟芳娜敏静丽强磊军洋', cast(1 + cast(floor(id / 10) AS bigint) % 10 AS int), 1)
          || CASE WHEN id % 3 = 0 THEN '' ELSE substr('明红华建国平秀兰志', cast(1 + cast(floor(id / 7) AS bigint) % 9 AS int), 1) END AS name,
        CASE WHEN id % 2 = 0 THEN '男' ELSE '女' END AS gender,
        cast(1965 + id % 35 AS int) AS birth_year, cast(1965 + id % 35 AS string) AS by4, cast(22 + id % 30 AS string) AS age,
        cast(13000000000 + (id * 104729) % 1000000000 AS string) AS phone, 'u' || cast(id AS string) || '@mail.example.com' AS email,
        replace(highest_education, '高中', '专科') AS level,
        CASE id % 5 WHEN 0 THEN '武汉大学' WHEN 1 THEN '浙江工业大学' WHEN 2 THEN '四川美术学院' WHEN 3 THEN '东北财经大学' ELSE '厦门理工学院' END AS school,
        CASE id % 4 WHEN 0 THEN '会计学' WHEN 1 THEN '工商管理' WHEN 2 THEN '土木工程' ELSE '法学' END AS major,
        CASE id % 3 WHEN 0 THEN '会计' WHEN 1 THEN '销售经理' ELSE '工程师' END AS position,
        cast(cast(floor(id / 6) AS bigint) % 4 AS int) AS n_jobs,
        CASE id % 4 WHEN 0 THEN '宏远' WHEN 1 THEN '天成' WHEN 2 THEN '博雅' ELSE '金桥' END || '科技有限公司' AS c1,
        CASE id % 3 WHEN 0 THEN '永安' WHEN 1 THEN '新都' ELSE '长江' END || '贸易有限公司' AS c2,
        CASE id % 5 WHEN 0 THEN '联创' WHEN 1 THEN '海川' ELSE '恒信' END || '集团' AS c3
      FROM {resumes_fx}) a) b) c
"""

FIXTURES = {
    "li_fx": LI_FX, "resumes_fx": RESUMES_FX, "experience_fx": EXPERIENCE_FX,
    "interviews_fx": INTERVIEWS_FX, "users_fx": USERS_FX,
    "positions_fx": POSITIONS_FX, "cv_fx": CV_FX,
}


class Fixtures:
    """The derived tables of one data folder, built on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def table(self, name: str) -> DataFrame:
        if name in SOURCES:
            return self.source(name)
        text = FIXTURES[name]
        needs = [n for n in SOURCES + list(FIXTURES) if "{" + n + "}" in text]
        return self.spark.sql(text, **{n: self.table(n) for n in needs})

    @property
    def documents(self) -> DataFrame:
        return self.source("documents")

    @property
    def resumes(self) -> DataFrame:
        return self.table("resumes_fx")

    @property
    def cv_texts(self) -> DataFrame:
        """``id, text`` of ``cv_fx``; the narrow rows are dealt over the tasks before the texts are written."""
        rows = dealt(self.resumes.select("id", "highest_education"))
        return self.spark.sql(CV_FX, resumes_fx=rows).select("id", "text")

    @property
    def interviews(self) -> DataFrame:
        return self.table("interviews_fx")

    @property
    def experience(self) -> DataFrame:
        return self.table("experience_fx")

    @property
    def users(self) -> DataFrame:
        return self.table("users_fx")

    @property
    def positions(self) -> DataFrame:
        return self.table("positions_fx")

    def resumes_with_experience(self) -> DataFrame:
        """Résumés with the nested list column the data model keeps in the row."""
        lists = self.experience.groupBy("resume_id").agg(
            F.array_sort(F.collect_list(F.struct(
                "seq", "company", "position", "start_year", "end_year"))).alias("w"))
        lists = lists.select(
            F.col("resume_id").alias("id"),
            F.transform("w", lambda e: F.struct(
                e.company.alias("company"), e.position.alias("position"),
                e.start_year.alias("start_year"),
                e.end_year.alias("end_year"))).alias("work_experience"))
        return self.resumes.join(lists, "id", "left")


def duckdb_ctes(*names: str) -> str:
    """``WITH`` clause with the fixtures ``names`` need, in dependency order."""
    wanted: set[str] = set()

    def visit(n: str) -> None:
        for dep in FIXTURES:
            if "{" + dep + "}" in FIXTURES[n]:
                visit(dep)
        wanted.add(n)

    for n in names:
        visit(n)
    plain = {n: n for n in SOURCES + list(FIXTURES)}
    parts = [f"{n} AS ({FIXTURES[n].format(**plain).strip()})" for n in FIXTURES if n in wanted]
    return "WITH " + ",\n".join(parts)
