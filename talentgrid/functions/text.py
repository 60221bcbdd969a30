"""Text functions: statistics, repairs, cleaning, line repair, key/values, chunks.

All of it is built-in expressions over the whole text of a row, so a document
never leaves its task.  The one exception is Unicode NFKC, which Spark lacks:
an Arrow UDF of one line.
"""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from talentgrid import vocab
from talentgrid.functions.basics import CJK, alternation, let, strip_ws

# --- fixed values: characters ------------------------------------------------
UNREADABLE = r"[□¡¿\u200b\u200c\u200d\ufeff]"
_MAPPED = "\u2ec4"
_BLANKS = "\u00a0\u1680\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200b)))
_BREAKS = "\r\u2028\u2029"
_DROPPED = "□¡¿\u200b\u200c\u200d\ufeff" + "".join(
    chr(i) for i in range(0xa0) if i < 0x20 and chr(i) not in "\t\n\r" or i >= 0x7f)
# [^一-龥A-Za-z0-9\s.,;:：，。；、！？()（）【】\[\]《》\-+*/=@#%&·•~]: a mixed class asks for each part in turn at every character,
# single ASCII characters are one look into a table, and they and the Chinese ones go first
KEPT_CHARS = (r"(?![0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz \t\n\x0b\f\r.,;:()\[\]\-+*/=@#%&~])"
              r"(?![一-龥])[^：，。；、！？（）【】《》·•]")


def cjk_chars(c: Column) -> Column:
    return F.length(c) - F.length(F.regexp_replace(c, CJK, ""))


def unique_chars(c: Column) -> Column:
    return F.size(F.array_distinct(F.filter(F.split(c, ""), lambda x: x != "")))


def text_stats(c: Column) -> dict[str, Column]:
    """``chars, cjk_chars, unique_chars, cjk_ratio`` of a text."""
    n = F.length(c)
    return {"chars": n, "cjk_chars": cjk_chars(c), "unique_chars": unique_chars(c),
            "cjk_ratio": F.when(n > 0, cjk_chars(c) / n).otherwise(0.0)}


def accept_text(c: Column) -> Column:
    """Is the text good enough to stand as a decoded page text?"""
    t = strip_ws(c)
    n, cjk = F.length(t), cjk_chars(t)
    ok = (n >= 200) & (cjk >= 50) & (cjk >= n * F.lit(0.1)) & (unique_chars(t) >= 50)
    return F.coalesce(ok, F.lit(False))


def ocr_repair(c: Column, fix_years: bool = False) -> Column:
    """Letter O read for zero in years and months, misread mail domains.

    The year pattern wants three digits after the O; ``fix_years`` also repairs
    the four-character form, which is what the rule was meant for.
    """
    if fix_years:
        c = F.regexp_replace(c, r"([12])O([0-9]{2})(?![0-9])", r"$1\0$2")
    c = F.regexp_replace(c, r"([12])O([0-9]{3})", r"$1\0$2")
    c = F.regexp_replace(c, r"([0-9]{4})\.O([0-9])", r"$1.\0$2")
    return F.regexp_replace(c, r"(?i)@(?:4|[0-9]+)q\.com", "@qq.com")


def clean_document_text(c: Column) -> Column:
    """Repaired text with trimmed lines and single blank lines between paragraphs."""
    c = F.regexp_replace(ocr_repair(c), UNREADABLE, "")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, r"(?U)[\s&&[^\n]]*\n[\s&&[^\n]]*", "\n")
    c = F.regexp_replace(c, r"(?U)\A[\s&&[^\n]]+|[\s&&[^\n]]+\z", "")
    c = F.regexp_replace(c, r"\A\n+\z", "")
    c = F.regexp_replace(c, r"\A\n{2,}|\n{2,}\z", "\n")
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode NFKC form."""
    return s.str.normalize("NFKC")


def clean_resume_text(c: Column, normalized: bool = False) -> Column:
    """Text as the extraction rules want it; ``normalized`` skips NFKC."""
    if not normalized:
        c = F.coalesce(nfkc(F.when(c.rlike(r"[^\x00-\x7f]"), c)), c)  # ASCII texts are normal: they stay in the JVM
    # one pass maps every Unicode blank to a space or newline and drops unreadable
    # characters, so the patterns after it get by with the cheap ASCII classes
    c = F.translate(c, _MAPPED + _BLANKS + _BREAKS + _DROPPED,
                    "西" + " " * len(_BLANKS) + "\n" * len(_BREAKS))
    for pattern, to in [("姓[⺠民氏]名", "姓名"), (KEPT_CHARS, " "),
                        (f"({CJK})\\s+({CJK})", "$1$2")]:
        c = F.regexp_replace(c, pattern, to)
    c = ocr_repair(c)
    gap = r"\s*\n\s*"
    rejoin = [
        (rf"([0-9]{{4}}){gap}[-~至到]{gap}((?:19|20)[0-9]{{2}}|至今|现在)", "$1-$2"),
        (rf"([0-9]{{4}})[/\\]{gap}([0-9]{{1,2}})", "$1/$2"),
        # a run of one to four characters is found through its last one
        (rf"({CJK}{{2}}){gap}(公司|集团|企业|有限公司)", "$1$2"),
        (rf"({CJK}){gap}(主管|经理|总监|工程师|教师|管理员|专员|助理|顾问|销售|大学|学院|学校)", "$1$2"),
        (r"\b[a-zA-Z0-9]{18,}+\b", " "),
    ]
    for pattern, to in rejoin:
        c = F.regexp_replace(c, pattern, to)
    heads = "".join(dict.fromkeys(h[0] for h in vocab.SECTION_HEADINGS))  # a look at one character spares most places the list
    c = F.regexp_replace(c, rf"\s*+(?=[{heads}])({alternation(vocab.SECTION_HEADINGS)})", "\n$1")
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n+", "\n")
    return strip_ws(c)


def repair_line_breaks(column: str) -> Column:
    """Joins lines that a page layout broke: a fold over the lines, then one pass that builds the text.

    Whether a line joins the buffer depends on the buffer's last character, its
    length and its number of CJK characters, so the fold carries just those and
    one letter per line: N begins a line, J joins the one before, - is blank.
    """
    last = ("CASE WHEN l RLIKE '[。！？；.!?;]$' THEN 'S' WHEN l RLIKE '[：，、:,-]$' THEN 'P' "
            "WHEN l RLIKE '[0-9a-zA-Z]$' THEN 'A' WHEN l RLIKE '[一-龥]$' THEN 'C' ELSE 'O' END")
    first = ("CASE WHEN l RLIKE '^[0-9a-zA-Z]' THEN 'A' WHEN l RLIKE '^[一-龥]' THEN 'C' ELSE 'O' END")
    cjk = "length(l) - length(regexp_replace(l, '[一-龥]', ''))"
    lines = (f"transform(split({column}, '\\n'), r -> transform(array(regexp_replace(r, "
             "r'(?U)\\A\\s+|\\s+\\z', '')), l -> "
             f"named_struct('l', l, 'first', {first}, 'last', {last}, 'n', length(l), "
             f"'cjk', {cjk}))[0])")
    joins = "((a.last = 'A' AND x.first = 'A') OR (a.last = 'C' AND x.first = 'C' AND a.n < 20))"
    complete = "(x.last = 'S' OR (t.n > 50 AND t.cjk > 10))"
    empty = "'n', 0, 'cjk', 0, 'last', ''"
    taken = (f"if(a.n > 0 AND {joins}, "
             "named_struct('marks', a.marks || 'J', 'n', a.n + x.n, 'cjk', a.cjk + x.cjk), "
             "named_struct('marks', a.marks || 'N', 'n', x.n, 'cjk', x.cjk))")
    step = (f"if(x.n = 0, named_struct('marks', a.marks || '-', {empty}), "
            f"transform(array({taken}), t -> if({complete}, named_struct('marks', t.marks, {empty}), "
            "named_struct('marks', t.marks, 'n', t.n, 'cjk', t.cjk, 'last', x.last)))[0])")
    marks = f"split(aggregate(ls, named_struct('marks', '', {empty}), (a, x) -> {step}, a -> a.marks), '')"
    pieces = (f"zip_with(ls, {marks}, (x, m) -> CASE m WHEN 'J' THEN x.l WHEN 'N' THEN '\\n' || x.l ELSE '' END)")
    return F.expr(f"transform(array({lines}), ls -> substring(array_join({pieces}, ''), 2))[0]")


def chunk_text(df: DataFrame, key: str, text: str, size: int = 12000) -> DataFrame:
    """``key, chunk_no, chunk``: windows of ``size`` characters that cover the whole text."""
    chunks = F.expr(f"posexplode(transform(sequence(0, greatest(0, ceil(length({text}) / {size}) - 1)), "
                    f"i -> substring({text}, int(i * {size} + 1), {size})))")
    return df.select(key, chunks.alias("chunk_no", "chunk"))


def join_chunks(chunks: DataFrame, key: str) -> DataFrame:
    """Chunks back to one text per key, a newline between them."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_no", "chunk")))
    return chunks.groupBy(key).agg(
        F.array_join(F.transform(parts, lambda p: p.chunk), "\n").alias("text"))


def parse_key_values(column: str) -> Column:
    """Map of ``label: value`` pairs in the text; the first value of a label wins.

    A value shorter than five characters takes in the next line unless that
    starts with a label or reads like a job description.
    """
    keys = alternation(vocab.KEY_TOKENS)
    pattern = rf"({keys})\s*[:：]\s*([^\n]+?)\s*(?=(?:{keys})\s*[:：]|$)"
    starts = "^(?:" + alternation(k for k in vocab.KEY_TOKENS if k != "专业") + r"|专业\s*[:：])"
    duties = "|".join(vocab.KEY_VALUE_DUTY_WORDS)
    lines = f"transform(split({column}, '\\n'), r -> regexp_replace(r, r'(?U)\\A\\s+|\\s+\\z', ''))"
    more = (f"length(v) < 5 AND coalesce(get(ls, i + 1), '') <> '' "
            f"AND NOT get(ls, i + 1) RLIKE r'{starts}' AND NOT get(ls, i + 1) RLIKE '{duties}'")
    value = f"CASE WHEN {more} THEN v || ' ' || get(ls, i + 1) ELSE v END"
    pairs = (f"flatten(transform(ls, (l, i) -> if(l RLIKE '[:：]', zip_with("
             f"regexp_extract_all(l, r'{pattern}', 1), "
             f"transform(regexp_extract_all(l, r'{pattern}', 2), v -> trim({value})), "
             "(k, v) -> named_struct('key', k, 'value', v)), "
             "cast(array() AS array<struct<key:string,value:string>>))))")
    first = ("map_from_entries(filter(ps, (p, i) -> array_position("
             "transform(ps, q -> q.key), p.key) = i + 1))")
    return F.expr(f"transform(array({lines}), ls -> transform(array(filter({pairs}, p -> p.value <> '')), "
                  f"ps -> {first})[0])[0]")


def extraction_score(c: Column, diagnostic: bool = False) -> Column:
    """Worth of an extracted text: its length, CJK characters twice, distinct characters."""
    n, cjk = F.length(c), cjk_chars(c)
    if diagnostic:
        return (n + cjk * 2).cast("double")
    score = (n + cjk * 2 + unique_chars(c)).cast("double")
    return F.when(cjk < n * F.lit(0.05), score * 0.5).otherwise(score)


def _extraction_rank(text: Column, method_no: Column, diagnostic: bool) -> Column:
    ok = (strip_ws(text) != "") & (F.length(text) >= 50)
    return F.struct(F.coalesce(ok, F.lit(False)).alias("ok"),
                    F.when(ok, extraction_score(text, diagnostic)).otherwise(0.0).alias("s"), (-method_no).alias("m"))


def best_form(forms: Column, diagnostic: bool = False) -> Column:
    """Struct ``method, text``: the best of an array of ``method_no, method, text``, in its row."""
    ranked = F.transform(forms, lambda f: F.struct(
        _extraction_rank(f.text, f.method_no, diagnostic).alias("rank"), f.method.alias("method"), f.text.alias("text")))
    return let(F.array_max(ranked), lambda b: F.struct(b.method.alias("method"), b.text.alias("text")))


def best_extraction(candidates: DataFrame, key: str = "doc_id",
                    diagnostic: bool = False) -> DataFrame:
    """``key, method, text``: the best of ``candidates(key, method_no, method, text)``.

    Blank texts and those under 50 characters do not qualify; on equal scores
    the earlier method wins; if nothing qualifies the first result is returned.
    The aggregate carries numbers only; the winner's text is joined to them.  Forms
    that stand in one row need neither: see ``best_form``.
    """
    rank = _extraction_rank(F.col("text"), F.col("method_no"), diagnostic)
    best = candidates.groupBy(key).agg(F.max(rank).alias("r")).select(key, (-F.col("r.m")).alias("method_no"))
    return candidates.join(best, [key, "method_no"]).select(key, "method", "text")
