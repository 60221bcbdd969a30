"""Registered queries over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentgrid.functions import contact, education, text as tx
from talentgrid.operators.lines import document_lines, with_neighbours
from talentgrid.plans.fixtures import duckdb_ctes
from talentgrid.plans.registry import AS_OF_YEAR, query

WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
HWS = WS.replace(r"\s", r"\t\f\r ")


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '\\A{WS}+|{WS}+\\z', '', 'g')"


def cjk_sql(c: str) -> str:
    return f"(length({c}) - length(regexp_replace({c}, '[一-龥]', '', 'g')))"


def uniq_sql(c: str) -> str:
    return f"len(list_distinct(regexp_extract_all({c}, '(?s).')))"


def ocr_sql(c: str) -> str:
    return ("regexp_replace(regexp_replace(regexp_replace(" + c + r", '([12])O([0-9]{3})', '\1\x{30}\2', 'g')"
            r", '([0-9]{4})\.O([0-9])', '\1.\x{30}\2', 'g'), '(?i)@(?:4|[0-9]+)q\.com', '@qq.com', 'g')"
            ).replace(r"\x{30}", "0")


@query("text_stats", f"""
SELECT doc_id, length(text) AS chars, {cjk_sql('text')} AS cjk_chars, {uniq_sql('text')} AS unique_chars,
 CASE WHEN length(text) > 0 THEN {cjk_sql('text')} / length(text) ELSE 0 END AS cjk_ratio FROM documents""")
def _(f):
    stats = tx.text_stats(F.col("text"))
    return f.documents.select("doc_id", *[
        c.cast("double" if n == "cjk_ratio" else "long").alias(n) for n, c in stats.items()])


@query("text_accept", f"""
SELECT doc_id, length(t) >= 200 AND {cjk_sql('t')} >= 50 AND {cjk_sql('t')} >= length(t) * 0.1 AND {uniq_sql('t')} >= 50 AS accepted
FROM (SELECT doc_id, {strip_sql('text')} AS t FROM documents) x""")
def _(f):
    return f.documents.select("doc_id", tx.accept_text(F.col("text")).alias("accepted"))


@query("ocr_repair", f"SELECT doc_id, {ocr_sql('text')} AS text FROM documents")
def _(f):
    return f.documents.select("doc_id", tx.ocr_repair(F.col("text")).alias("text"))


def clean_sql(c: str) -> str:
    """Lines trimmed one by one, runs of blank lines made one by looking at the line before."""
    base = rf"regexp_replace(regexp_replace({ocr_sql(c)}, '[□¡¿\x{{200b}}\x{{200c}}\x{{200d}}\x{{feff}}]', '', 'g'), '[ \t]+', ' ', 'g')"
    ls = f"list_transform(string_split({base}, chr(10)), lambda l: {strip_sql('l')})"
    return (f"(SELECT array_to_string(list_filter(s.ls, lambda l, i: l <> '' OR i = 1 OR s.ls[i - 1] <> ''), chr(10)) "
            f"FROM (SELECT {ls} AS ls) s)")


@query("clean_document_text", f"SELECT doc_id, {clean_sql('text')} AS text FROM documents")
def _(f):
    return f.documents.select("doc_id", tx.clean_document_text(F.col("text")).alias("text"))


@query("clean_conversation_text", f"SELECT conv_id, turn, {clean_sql('text')} AS text FROM conversations")
def _(f):
    return f.table("conversations").select(
        "conv_id", "turn", tx.clean_document_text(F.col("text")).alias("text"))


# fold written over the same states; list elements carry the shape of the accumulator
_REPAIR = f"""
WITH RECURSIVE l AS (SELECT doc_id, n, l, length(l) AS len, {cjk_sql('l')} AS cjk FROM (
   SELECT doc_id, unnest(range(1, len(ls) + 1)) AS n, {strip_sql('unnest(ls)')} AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) a) b),
s AS (SELECT doc_id, cast(0 AS bigint) AS n, '' AS buf, cast(NULL AS string) AS out1, cast(NULL AS string) AS out2 FROM documents
 UNION ALL
 SELECT doc_id, n, CASE WHEN full_ THEN '' ELSE nb END, CASE WHEN buf <> '' AND NOT joined THEN buf END, CASE WHEN full_ THEN nb END FROM (
  SELECT *, l <> '' AND (regexp_matches(nb, '[。！？；.!?;]$') OR (length(nb) > 50 AND {cjk_sql('nb')} > 10)) AS full_ FROM (
   SELECT *, CASE WHEN l = '' THEN '' WHEN joined THEN buf || l ELSE l END AS nb FROM (
    SELECT s.doc_id, l.n, s.buf, l.l, s.buf <> '' AND l.l <> '' AND (
      (regexp_matches(s.buf, '[0-9a-zA-Z]$') AND regexp_matches(l.l, '^[0-9a-zA-Z]')) OR
      (regexp_matches(s.buf, '[一-龥]$') AND regexp_matches(l.l, '^[一-龥]') AND length(s.buf) < 20)) AS joined
    FROM s JOIN l ON l.doc_id = s.doc_id AND l.n = s.n + 1) a) b) c),
pieces AS (SELECT doc_id, n, 1 AS k, out1 AS piece FROM s UNION ALL SELECT doc_id, n, 2, out2 FROM s
 UNION ALL SELECT doc_id, n, 3, CASE WHEN buf <> '' THEN buf END FROM s WHERE (doc_id, n) IN (SELECT doc_id, max(n) FROM s GROUP BY 1))
SELECT doc_id, coalesce(string_agg(piece, chr(10) ORDER BY n, k), '') AS text FROM pieces GROUP BY 1
"""


@query("line_repair", _REPAIR)
def _(f):
    return f.documents.select("doc_id", tx.repair_line_breaks("text").alias("text"))


@query("chunk_text", """
SELECT doc_id, cast(i AS int) AS chunk_no, substr(text, i * 12000 + 1, 12000) AS chunk FROM (
 SELECT doc_id, text, unnest(range(0, greatest(1, cast(ceil(length(text) / 12000.0) AS bigint)))) AS i FROM documents) x""")
def _(f):
    return tx.chunk_text(f.documents, "doc_id", "text")


@query("join_chunks", """
SELECT doc_id, string_agg(substr(text, i * 500 + 1, 500), chr(10) ORDER BY i) AS text FROM (
 SELECT doc_id, text, unnest(range(0, greatest(1, cast(ceil(length(text) / 500.0) AS bigint)))) AS i FROM documents) x GROUP BY 1""")
def _(f):
    return tx.join_chunks(tx.chunk_text(f.documents, "doc_id", "text", 500), "doc_id")


def score_sql(c: str) -> str:
    s = f"cast(length({c}) + 2 * {cjk_sql(c)} + {uniq_sql(c)} AS double)"
    return f"CASE WHEN {cjk_sql(c)} < length({c}) * 0.05 THEN {s} * 0.5 ELSE {s} END"


@query("best_extraction", f"""
WITH c AS (SELECT doc_id, 1 AS method_no, 'squeezed' AS method, regexp_replace(text, '\\s+', ' ', 'g') AS text FROM documents
 UNION ALL SELECT doc_id, 2, 'plain', text FROM documents
 UNION ALL SELECT doc_id, 3, 'lower', lower(text) FROM documents)
SELECT doc_id, method, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ok DESC, CASE WHEN ok THEN sc ELSE 0 END DESC, method_no) AS rn
 FROM (SELECT *, {strip_sql('text')} <> '' AND length(text) >= 50 AS ok, {score_sql('text')} AS sc FROM c) a) b WHERE rn = 1
""")
def _(f):
    d = f.documents
    forms = F.array(
        F.struct(F.lit(1).alias("method_no"), F.lit("squeezed").alias("method"),
                 F.regexp_replace("text", r"\s+", " ").alias("text")),
        F.struct(F.lit(2).alias("method_no"), F.lit("plain").alias("method"), F.col("text")),
        F.struct(F.lit(3).alias("method_no"), F.lit("lower").alias("method"),
                 F.lower("text").alias("text")))
    return d.select("doc_id", tx.best_form(forms).alias("b")).select("doc_id", "b.method", "b.text")


@query("best_extraction_long", f"""
WITH c AS (SELECT doc_id, 1 AS method_no, 'marked' AS method, replace(text, 'e', 'E') AS text FROM documents WHERE doc_id % 3 <> 0
 UNION ALL SELECT doc_id, 2, 'plain', text FROM documents)
SELECT doc_id, method, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ok DESC, CASE WHEN ok THEN sc ELSE 0 END DESC, method_no) AS rn
 FROM (SELECT *, {strip_sql('text')} <> '' AND length(text) >= 50 AS ok, {score_sql('text')} AS sc FROM c) a) b WHERE rn = 1
""")
def _(f):
    d = f.documents
    marked = d.filter("doc_id % 3 <> 0").select("doc_id", F.lit(1).alias("method_no"), F.lit("marked").alias("method"), F.replace(F.col("text"), F.lit("e"), F.lit("E")).alias("text"))
    return tx.best_extraction(marked.union(d.select("doc_id", F.lit(2), F.lit("plain"), "text")))


@query("emails", f"""
SELECT doc_id, nullif(regexp_extract(text, '{contact.EMAIL}'), '') AS email FROM documents""")
def _(f):
    return f.documents.select("doc_id", contact.email(F.col("text")).alias("email"))


@query("phones", rf"""
SELECT doc_id, regexp_replace(nullif(regexp_extract(text, '(^|[^0-9])(1[3-9][0-9]{WS}?-?[0-9]{{4}}(?:{WS}|-)?[0-9]{{4}})([^0-9]|$)', 2), ''), '{WS}|-', '', 'g') AS phone FROM documents
""".replace(f"{WS}?-?", f"(?:{WS}|-)?"))
def _(f):
    return f.documents.select("doc_id", contact.phone(F.col("text")).alias("phone"))


# written out, high to low, so that the twin does not share the operator's list
_EDU_WORDS = [
    ("博士", ["博士", "phd", "doctor"]),
    ("硕士", ["硕士", "研究生", "master", "mba", "mpa", "mpp", "ms"]),
    ("本科", ["本科", "学士", "bachelor", "专升本"]),
    ("专科", ["专科", "大专", "college", "associate", "diploma", "职业学院", "职业技术学院"]),
    ("高中", ["高中", "普高", "中学", "附中", "一中", "二中", "三中", "四中"]),
    ("中专", ["中专", "技校", "技工", "职校", "高职", "technical secondary", "technical school"]),
]


def _edu_sql(strict: bool) -> str:
    arms = []
    for level, words in _EDU_WORDS:
        conds = [f"contains(t, '{w}')" for w in words if not strict or not w.isascii()]
        if strict:
            latin = [w for w in words if w.isascii()]
            if latin:
                conds.append(f"regexp_matches(t, '(^|[^a-z])(?:{'|'.join(latin)})([^a-z]|$)')")
        arms.append(f"WHEN {' OR '.join(conds)} THEN '{level}'")
    return f"SELECT doc_id, CASE {' '.join(arms)} END AS level FROM (SELECT doc_id, lower(text) AS t FROM documents) x"


@query("education_level", _edu_sql(False))
def _(f):
    return f.documents.select(
        "doc_id", education.detect_education(F.col("text")).alias("level"))


@query("education_level_strict", _edu_sql(True))
def _(f):
    return f.documents.select(
        "doc_id", education.detect_education(F.col("text"), strict=True).alias("level"))


@query("highest_level", """
SELECT c_custkey AS id, arg_max(lvl, CASE lvl WHEN '博士' THEN 7 WHEN '硕士' THEN 6 WHEN '本科' THEN 5 WHEN '专科' THEN 4 ELSE 3 END) AS level
FROM (SELECT o_custkey AS c_custkey, CASE o_orderpriority WHEN '1-URGENT' THEN '博士' WHEN '2-HIGH' THEN '硕士' WHEN '3-MEDIUM' THEN '本科'
 WHEN '4-NOT SPECIFIED' THEN '专科' ELSE '高中' END AS lvl FROM orders) x GROUP BY 1""")
def _(f):
    # a set of levels has at most as many members as there are levels
    r = f.table("orders").select(F.col("o_custkey").alias("id"), F.create_map(
        F.lit("1-URGENT"), F.lit("博士"), F.lit("2-HIGH"), F.lit("硕士"), F.lit("3-MEDIUM"),
        F.lit("本科"), F.lit("4-NOT SPECIFIED"), F.lit("专科"), F.lit("5-LOW"), F.lit("高中")
    )[F.col("o_orderpriority")].alias("lvl"))
    sets = r.groupBy("id").agg(F.collect_set("lvl").alias("levels"))
    return sets.select("id", education.highest_level(F.col("levels")).alias("level"))


@query("years_in_text", f"""
SELECT doc_id, cast(CASE WHEN y BETWEEN 1980 AND {AS_OF_YEAR} THEN y END AS int) AS first_year, m AS earliest, n FROM (
 SELECT doc_id, try_cast(nullif(regexp_extract(text, '(?:19|20)[0-9]{{2}}'), '') AS int) AS y,
  list_min(ys) AS m, len(ys) AS n FROM (SELECT doc_id, text, list_filter(list_transform(regexp_extract_all(text, '(?:19|20)[0-9]{{2}}'),
   lambda v: cast(v AS int)), lambda v: v BETWEEN 1980 AND {AS_OF_YEAR}) AS ys FROM documents) a) b""")
def _(f):
    t = F.col("text")
    ys = contact.years_in(t, AS_OF_YEAR)
    return f.documents.select(
        "doc_id", contact.year_in(t, AS_OF_YEAR).alias("first_year"),
        F.array_min(ys).alias("earliest"), F.size(ys).cast("long").alias("n"))


@query("conversation_years", f"""
SELECT conv_id, turn, list_min(list_filter(list_transform(regexp_extract_all(text, '(?:19|20)[0-9]{{2}}'),
   lambda v: cast(v AS int)), lambda v: v BETWEEN 1980 AND {AS_OF_YEAR})) AS earliest FROM conversations""")
def _(f):
    return f.table("conversations").select(
        "conv_id", "turn", F.array_min(contact.years_in(F.col("text"), AS_OF_YEAR)).alias("earliest"))


@query("normalize_education", """
SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN '博士' WHEN '2-HIGH' THEN '硕士' WHEN '3-MEDIUM' THEN '本科'
 WHEN '4-NOT SPECIFIED' THEN '专科' END AS level FROM orders""")
def _(f):
    label = F.create_map(*[F.lit(x) for x in (
        "1-URGENT", "PhD （在读）", "2-HIGH", "MBA研修", "3-MEDIUM", "统招 本科/学士",
        "4-NOT SPECIFIED", "junior college", "5-LOW", "函授")])[F.col("o_orderpriority")]
    return f.table("orders").select(F.col("o_orderkey").alias("id"),
                                    education.normalize_education(label).alias("level"))


@query("company_validity", """
SELECT s_suppkey AS id, s_suppkey % 4 = 0 AS by_suffix FROM supplier""")
def _(f):
    k, n = F.col("s_suppkey") % 4, F.col("s_name")
    name = (F.when(k == 0, F.concat(n, F.lit("公司"))).when(k == 1, F.concat(F.lit("负责"), n, F.lit("公司")))
            .when(k == 2, n).otherwise(F.concat(n, F.lit("公司的"))))
    return f.table("supplier").select(F.col("s_suppkey").alias("id"),
                                      education.is_company(name).alias("by_suffix"))


# ------------------------------------------------ the same on Chinese texts
_CV = "documents AS (SELECT id AS doc_id, CASE WHEN id % 2 = 0 THEN text || chr(10) || text ELSE text END AS text FROM cv_fx)"


def _cv(f):
    t = F.col("text")
    twice = F.when(F.col("id") % 2 == 0, F.concat(t, F.lit("\n"), t)).otherwise(t)
    return f.table("cv_fx").select(F.col("id").alias("doc_id"), twice.alias("text"))


@query("text_stats_cjk", f"""WITH {_CV} SELECT doc_id, length(text) AS chars, {cjk_sql('text')} AS cjk_chars, {uniq_sql('text')} AS unique_chars,
 {cjk_sql('text')} / length(text) AS cjk_ratio FROM documents""", ("cv_fx",))
def _(f):
    stats = tx.text_stats(F.col("text"))
    return _cv(f).select("doc_id", *[c.cast("double" if n == "cjk_ratio" else "long").alias(n) for n, c in stats.items()])


@query("accept_text_cjk", f"""WITH {_CV}
SELECT doc_id, length(t) >= 200 AND {cjk_sql('t')} >= 50 AND {cjk_sql('t')} >= length(t) * 0.1 AND {uniq_sql('t')} >= 50 AS accepted
FROM (SELECT doc_id, {strip_sql('text')} AS t FROM documents) x""", ("cv_fx",))
def _(f):
    return _cv(f).select("doc_id", tx.accept_text(F.col("text")).alias("accepted"))


@query("line_repair_cjk", duckdb_ctes("cv_fx").replace("WITH ", "WITH RECURSIVE ", 1) + f", {_CV}, " + _REPAIR.strip().removeprefix("WITH RECURSIVE "))
def _(f):
    return _cv(f).select("doc_id", tx.repair_line_breaks("text").alias("text"))


@query("clean_document_text_cjk", f"WITH {_CV} SELECT doc_id, {clean_sql('text')} AS text FROM documents", ("cv_fx",))
def _(f):
    return _cv(f).select("doc_id", tx.clean_document_text(F.col("text")).alias("text"))


# the lines of each document as rows, each with two lines on either side
@query("line_neighbours", """
WITH l AS (SELECT doc_id, generate_subscripts(lines, 1) - 1 AS line_no, unnest(lines) AS line
 FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM documents) x)
SELECT doc_id, cast(line_no AS int) AS line_no, md5(line) AS line,
 md5(lag(line, 1) OVER w) AS prev1, md5(lag(line, 2) OVER w) AS prev2, md5(lead(line, 1) OVER w) AS next1, md5(lead(line, 2) OVER w) AS next2
FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)""")
def _(f):
    found = with_neighbours(document_lines(f.documents), 2)
    return found.select("doc_id", "line_no", *[F.md5(F.col(c).cast("binary")).alias(c) for c in ("line", "prev1", "prev2", "next1", "next2")])
