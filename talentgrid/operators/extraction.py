"""Documents to candidate columns: ordered rules as column expressions.

The texts are those ``clean_resume_text`` returns: their only blanks are the
space and the newline.

Every field is a ``coalesce`` of named rules over the text of the row, so each
rule can be tested alone and no field needs a shuffle: neighbouring lines are
array neighbours, not window rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from talentgrid import vocab
from talentgrid.functions import contact, education as edu
from talentgrid.functions.basics import (
    alternation, blank_to_null, contains_any, ends_with_any, first_match, let)
from talentgrid.functions.candidate import earliest_year, sort_experiences
from talentgrid.functions.text import clean_resume_text, parse_key_values
from talentgrid.session import dealt

NAME = "[一-龥·•]{2,8}"
SHORT_NAME = "[一-龥·•]{2,6}"


def _trim(l: Column) -> Column:
    return F.trim(l)


def _key(kv: Column, name: str) -> Column:
    return F.try_element_at(kv, F.lit(name))


def _first(rules: list[Column]) -> Column:
    return F.coalesce(*rules)


# --------------------------------------------------------------- name
def _real_name(c: Column) -> Column:
    return F.when((c != "") & ~c.isin(vocab.NOT_A_NAME), c)


def _cut_name(c: Column) -> Column:
    """Cut at the first stop character from the third position on."""
    return F.regexp_replace(c, f"(?s)\\A(..[^{vocab.NAME_STOP_CHARS}]*)[{vocab.NAME_STOP_CHARS}].*\\z", "$1")


def _near(text: Column, anchor: str, before: int, checked: bool) -> Column:
    """Last name-like run within ``before`` characters ahead of the first anchor match."""
    ahead = F.regexp_extract(text, rf"(?s)\A(.*?)(?:{anchor})", 1)
    window = F.when(text.rlike("[一-龥]"), F.right(ahead, F.lit(before)))

    def pick(w: Column) -> Column:
        runs = F.regexp_extract_all(w, F.lit(f"({SHORT_NAME})"), F.lit(1))
        ok = lambda r: ~r.isin(vocab.NOT_A_NAME)
        if checked:
            stops = "|".join(vocab.NAME_CONTEXT_STOPS)
            ok = lambda r: ~r.isin(vocab.NOT_A_NAME) & ~r.rlike(stops) & ~F.regexp_like(
                w, F.concat(F.lit(rf"(?s)(?:{stops}).{{0,10}}\Q"), r, F.lit(r"\E|\Q"), r,
                            F.lit(rf"\E.{{0,10}}(?:{stops})")))
        return F.try_element_at(F.filter(runs, ok), F.lit(-1))
    return let(window, pick)


def _around(text: Column, anchor: str, before: int, after: int) -> Column:
    """Last name-like run from ``before`` characters ahead of the first anchor match to ``after`` from its start on."""
    start = F.length(F.regexp_extract(text, rf"(?s)\A(.*?)(?:{anchor})", 1))
    begin = F.greatest(start - before, F.lit(0))
    window = F.when(text.rlike(anchor), F.substr(text, begin + 1, start + after - begin))
    runs = F.filter(F.regexp_extract_all(window, F.lit(f"({SHORT_NAME})"), F.lit(1)), lambda r: ~r.isin(vocab.NOT_A_NAME))
    return F.try_element_at(runs, F.lit(-1))


def _opening_name(text: Column) -> Column:
    """First line of 2 to 6 Chinese characters without a label word, else the first clean stretch between labels."""
    stops = "|".join(vocab.NAME_LABEL_STOPS)
    chinese = lambda l: F.regexp_replace(l, "[^一-龥]", "")
    fits = lambda n: F.length(n).between(2, 6) & ~n.isin(vocab.NOT_A_NAME)
    alone = F.filter(F.transform(F.filter(F.split(text, "\n"), lambda l: ~l.rlike(f"{stops}|城市|薪资")), chinese), fits)
    # a run of characters that no label stands within ten characters of, on either side
    clear = F.when(text.rlike(stops), F.regexp_replace(text, rf"(?s).{{0,10}}(?:{stops}).{{0,10}}", "\n")).otherwise(text)
    runs = F.filter(F.regexp_extract_all(clear, F.lit("([一-龥]{2,})"), F.lit(1)), lambda r: ~r.isin(vocab.NOT_A_NAME))
    return F.coalesce(F.get(alone, F.lit(0)), F.substring(F.get(runs, F.lit(0)), 1, 2))


def name_rules(text: Column, kv: Column, near_start: int | None = None) -> dict[str, Column]:
    """``near_start`` may bound how far into the text a short line counts as a name; a line with a contact word always does."""
    mail, mobile = contact.EMAIL_SCAN, r"(?<![0-9])1[3-9][0-9]{9}(?![0-9])"
    labelled = F.regexp_replace(_key(kv, "姓名"), "[^一-龥A-Za-z·• ]", "")
    alias = first_match(text, rf"(?:姓名|中文名|中文姓名|英文姓名|英文)\s*[:：]?\s*({NAME})", 1)
    # a name ends right before a title, so the costly pattern begins a few characters ahead of the first one
    before = F.length(F.regexp_extract(text, r"(?sU)\A(.*?)(?:先生|女士|男|女)\b", 1))
    titled = F.when(text.rlike(r"(?U)(?:先生|女士|男|女)\b"), first_match(
        F.substr(text, F.greatest(before - 40, F.lit(1))), rf"(?U)({NAME})\s*(?:先生|女士|男|女)\b", 1))
    mailed = text.contains("@")
    after_mail = F.when(mailed, first_match(text, rf"(?s)(?:{mail})(.{{0,30}})", 1))
    squeezed = F.filter(F.transform(F.split(text, "\n"), lambda l: F.struct(
        F.regexp_replace(l, r"\s", "").alias("l"), F.trim(l).alias("own"))), lambda l: F.length(l.l).between(2, 10))
    if near_start is not None:
        squeezed = F.filter(squeezed, lambda l: contains_any(F.lower(l.own), vocab.CONTACT_WORDS)
                            | (F.instr(text, l.own) <= near_start))
    short = F.filter(F.transform(squeezed, lambda l: F.regexp_replace(l.l, "[^一-龥]", "")),
                     lambda n: F.length(n).between(2, 6) & ~n.isin(vocab.NOT_A_NAME))
    return {
        "key_value": _real_name(_cut_name(first_match(F.trim(labelled), f"\\A{NAME}"))),
        "label": _real_name(_cut_name(alias)),
        "title": _real_name(titled),
        "after_email": _real_name(first_match(after_mail, NAME)),
        "before_email": F.when(mailed, _near(text, mail, 50, True)),
        "before_phone": _near(text, mobile, 50, True),
        "around_contact": _around(text, f"{mail}|{mobile}", 60, 40),
        "short_line": F.get(short, F.lit(0)),
        "opening": _opening_name(text),
    }


def name_expr(text: Column, kv: Column) -> Column:
    return _first(list(name_rules(text, kv).values()))


# --------------------------------------------------------------- gender, birth, age
def gender_rules(text: Column, kv: Column, head_chars: int | None = None) -> dict[str, Column]:
    """``head_chars`` may bound how far into the text the last rule looks."""
    v, head = _key(kv, "性别"), text if head_chars is None else F.substring(text, 1, head_chars)
    man, woman = head.contains("男"), head.contains("女")
    context = head.rlike(vocab.GENDER_CONTEXT)
    return {
        "key_value": F.when(v.contains("女"), "女").when(v.contains("男"), "男"),
        "label": first_match(text, vocab.GENDER_LABEL, 1),
        "after_name": first_match(text, rf"{NAME}\s*(男|女)(?:\s*[|｜]\s*|\s+|\s*$)", 1),
        "before_age": first_match(text, vocab.GENDER_BEFORE_AGE, 1),
        "head": F.when(context & man & ~woman, "男").when(context & woman & ~man, "女"),
    }


def gender_expr(text: Column, kv: Column, head_chars: int | None = None) -> Column:
    # most texts name neither: they skip the patterns
    return F.when(text.rlike("[男女]") | _key(kv, "性别").isNotNull(), _first(list(gender_rules(text, kv, head_chars).values())))


def birth_year_rules(text: Column, kv: Column, as_of_year: int, head_lines: int | None = None,
                     head_chars: int | None = None) -> dict[str, Column]:
    """``head_lines`` may bound the lines in which a birth word is looked for, ``head_chars`` the text in which a year without
    one counts; inside that bound a birth word near a year outweighs a work word.  Elsewhere a year of 2000 or later
    beside both counts only right after the birth word: it may be the year of a job."""
    def ok(y: Column, low: int = 1950) -> Column:
        y = y.try_cast("int")
        return F.when(y.between(low, as_of_year), y)

    year = "(?:19|20)[0-9]{2}"
    keyed = [ok(first_match(_key(kv, k), year)) for k in vocab.BIRTH_KEYS]
    lines = F.split(text, "\n")
    head = lines if head_lines is None else F.slice(lines, 1, head_lines)

    def by_line(ls: Column) -> Column:
        hit = lambda l: contains_any(l, vocab.BIRTH_WORDS)

        def year_of(l: Column, i: Column) -> Column:
            here = ok(first_match(l, vocab.BIRTH_LINE_YEAR, 1))
            below = F.coalesce(F.get(ls, i + 1), F.lit(""))
            calm = ~contains_any(below, vocab.BIRTH_WORK_WORDS + ["岗位", "职位"])
            fits = calm & (below.contains("年") | (F.length(below) <= 10))
            return F.when(hit(l), F.coalesce(here, F.when(fits, ok(first_match(below, year)))))
        return F.get(F.filter(F.transform(ls, year_of), lambda y: y.isNotNull()), F.lit(0))

    def by_pattern(t: Column, whole: bool) -> Column:
        def one(p: str) -> Column:
            def judge(m: Column) -> Column:
                at = F.instr(t, m)
                start = F.greatest(F.lit(1), at - 50)
                around = F.substr(t, start, at - start + 50)
                y = ok(F.regexp_extract(m, p, 1))
                born = around.rlike("出生|生日")
                named = F.concat(F.substr(t, start, at - start), F.regexp_extract(m, r"\A[^0-9]*", 0)).rlike(
                    r"(?:出生(?:年份|日期|[年月日]*)|生日)\s*[：:]?\s*\z")
                late = (y >= 2000) & contains_any(around, vocab.BIRTH_LATE_WORK_WORDS) & ~named
                near = born if head_chars is not None and not whole else born & ~late
                if whole:
                    return F.when(near, y)
                return F.when(near | (~born & ~contains_any(around, vocab.BIRTH_WORK_WORDS)), y)
            return let(first_match(t, p), judge)
        # patterns that name the birth are not tried on other texts
        rules = [F.when(t.rlike("出生|生日"), one(p)) if p[0] in "出生" else one(p) for p in vocab.BIRTH_PATTERNS]
        return F.when(t.rlike(r"[0-9]{4}[年/\-]|(?:出生|生日)"), _first(rules))

    no_work = F.regexp_replace(text, f"{vocab.WORK_DATE_RANGE}|{vocab.WORK_YEAR_COMPANY}", "")
    return {
        "key_value": _first(keyed),
        "birth_line": F.when(text.rlike("出生|生日"), let(F.transform(head, _trim), by_line)),
        "head": let(text if head_chars is None else F.substring(text, 1, head_chars), lambda t: by_pattern(t, False)),
        "whole_text": F.when(text.rlike("出生|生日"), let(no_work, lambda t: by_pattern(t, True))),
    }


def birth_year_expr(text: Column, kv: Column, as_of_year: int, head_lines: int | None = None,
                    head_chars: int | None = None) -> Column:
    return _first(list(birth_year_rules(text, kv, as_of_year, head_lines, head_chars).values()))


def age_expr(text: Column, kv: Column, birth_year: Column, as_of_year: int) -> Column:
    """Stated age of 16..70, else the age the birth year gives, in the same range."""
    def ok(c: Column) -> Column:
        c = c.try_cast("int")
        return F.when(c.between(16, 70), c)
    return F.coalesce(
        ok(first_match(_key(kv, "年龄"), "[0-9]{1,2}")),
        ok(first_match(text, r"年龄\s*[:：]?\s*([0-9]{1,2})", 1)),
        ok(first_match(text, r"([0-9]{1,2})\s*岁", 1)),
        ok(F.lit(as_of_year) - birth_year))


# --------------------------------------------------------------- sections
def section(text: Column, headings: list[str], stops: list[str]) -> Column:
    """Text from the first heading to the next stop heading or the end."""
    return first_match(text, rf"(?s)(?:{alternation(headings)})[：:]?\s*(.*?)(?={alternation(stops)}|\z)", 1)


# --------------------------------------------------------------- work experience
_Y = "(?:19|20)[0-9]{2}"
_DATE = rf"{_Y}(?:[./年-][0-9]{{1,2}})?(?:[./-][0-9]{{1,2}})?[年月]?"
_END = rf"(?:{_DATE}|至今|现在|present)"
_RANGE = rf"{_DATE}\s*[-~至到—～–]+\s*{_END}"
RANGE_PARTS = rf"({_DATE})\s*[-~至到—～–]+\s*({_END})((?:(?!{_RANGE}).)*)"
SINGLE_YEAR = rf"\A({_Y})[年\s]+(?!至今|现在|present)([一-龥A-Za-z（(].{{1,}})\z"
COMPANY = ("[一-龥A-Za-z（）()&][一-龥A-Za-z0-9（）()&]{0,39}(?:"
           + alternation(vocab.COMPANY_SCAN_ENDINGS) + ")")
COMPANY_END = alternation(vocab.COMPANY_SCAN_ENDINGS)
_BRACKETS = "[（(][^）)]+[）)]"


def tidy_company(c: Column) -> Column:
    c = F.regexp_replace(c, r"\A[0-9./\-年月日\s]+", "")
    c = F.regexp_replace(c, _BRACKETS, "")
    c = blank_to_null(F.regexp_replace(F.trim(c), "[·•]+\\z", ""))
    return F.when(~c.isin(vocab.COMPANY_PLACEHOLDERS), c)


def tidy_position(c: Column) -> Column:
    """First position of the text up to a duty word; NULL when it is none."""
    duty = alternation(vocab.POSITION_DUTY_WORDS)
    out = F.regexp_replace(c, _BRACKETS, "")
    out = F.regexp_replace(out, r"\A[·•，,、|/:：\-—\s]+", "")
    out = F.regexp_replace(out, rf"(?s)\A(?:{alternation(vocab.POSITION_LABELS)}|进行|从事)[：:，,\s]*", "")
    out = F.regexp_replace(out, rf"(?s)(?<=.)(?:{duty}).*\z", "")
    out = F.regexp_replace(out, "(?s)[、/。；;].*\\z", "")
    out = F.regexp_replace(out, r"\s*工作(?:内容|职责)?\z", "")
    out = F.regexp_replace(out, r"[，,;；.。|\s]+\z", "")
    bad = f"{duty}|公司|集团|企业|:\\z"
    return let(out, lambda p: F.when(
        F.length(p).between(2, 30) & ~p.isin(vocab.NOT_A_POSITION) & ~p.rlike(bad)
        & p.rlike("[一-龥A-Za-z]"), p))


def _skipped(l: Column) -> Column:
    """Lines of the education section, headers and duty descriptions."""
    schooling = (l.contains("教育") | contains_any(l, vocab.SCHOOL_LINE_WORDS)) & ~l.contains(
        "公司") & ~l.contains("工作")
    duty = (l.rlike(r"\A[0-9]+[、.。]") & ~l.rlike(rf"\A{_Y}")
            & contains_any(l, vocab.DUTY_LINE_WORDS))
    header = l.rlike(r"\A(?:时间|单位|职位|岗位|名称)[\s一-龥]*\z") | l.rlike(
        r"\A(?:内容|负责|职责|业绩|获得|担任角色|负责工作|获得业绩)[：:]?\s*\z")
    return contains_any(l, vocab.EXPERIENCE_SKIP_WORDS) | schooling | duty | header


_DOING = r"在([^在，,。]{2,40}?)进行(.{2,40})工作"
_DOTTED = r"\A([^·•]+)[·•](.*)\z"


def _entry(s: Column) -> Column:
    """One experience from ``start, end, after, before, next, seen``.

    Company: "在…进行…工作", then around a dot, after the range, before it, on
    the next line when the range stands alone, else the company seen last.
    """
    def companies(t: Column) -> Column:
        # the cheap test spares long lines without any company the costly pattern
        return F.when(t.rlike(COMPANY_END), F.regexp_extract_all(t, F.lit(f"({COMPANY})"), F.lit(1)))

    def build(f: Column) -> Column:
        alone = (s.after == "") & (s.before == "")
        full = F.when(ends_with_any(f.doing, vocab.COMPANY_ENDINGS) | f.doing.rlike("教育|学校|学院"),
                      f.doing).otherwise(F.concat(f.doing, F.lit("公司")))
        dotted = F.when(edu.is_company(f.left), f.left)
        following = F.when(alone & ~s.next.rlike(rf"\A{_Y}"), F.get(companies(s.next), F.lit(0)))
        company = F.coalesce(full, dotted, f.after, f.before, following, s.seen)
        rest = lambda t, head="": F.when(t.rlike(COMPANY_END), first_match(
            t, f"{head}{COMPANY}(.*)\\z", 1))
        names_position = lambda t: F.when(contains_any(t, vocab.POSITION_WORDS), t)
        # below the range, or below the company that stands below the range
        below = F.when(following.isNotNull(), s.after_next).otherwise(s.next)
        fits = ((F.length(below) <= 30) & contains_any(below, vocab.POSITION_WORDS)
                & ~below.rlike(f"{_Y}|公司|集团|企业"))
        positions = F.transform(F.array(
            first_match(s.after, _DOING, 2),
            F.when(dotted.isNotNull(), first_match(s.after, _DOTTED, 2)),
            rest(s.after), F.when(f.after.isNull(), names_position(s.after)),
            rest(s.before, "\\A.*"), F.when(f.before.isNull(), names_position(s.before)),
            F.when(alone, rest(s.next, "\\A")), F.when(fits, below)), tidy_position)
        position = F.get(F.filter(positions, lambda p: p.isNotNull()), F.lit(0))
        # what stands behind a blank in a company is the position, if there is no other
        return let(F.struct(tidy_company(company).alias("c"), position.alias("p")), lambda b: F.struct(
            F.split(b.c, " ")[0].alias("company"), F.coalesce(b.p, first_match(b.c, r"\A[^ ]+ +(.*)\z", 1)).alias("position"),
            s.start.alias("start_year"), s.end.alias("end_year")))

    return let(F.struct(
        first_match(s.after, _DOING, 1).alias("doing"),
        F.trim(first_match(s.after, _DOTTED, 1)).alias("left"),
        F.get(companies(s.after), F.lit(0)).alias("after"),
        F.try_element_at(companies(s.before), F.lit(-1)).alias("before")), build)


def merge_experiences(exps: Column) -> Column:
    """One entry per (company, start): first one wins, gaps filled, latest end kept.

    Equal keys are brought together by a sort, so the work does not grow with the square of the list."""
    def runs_of(rows: Column) -> Column:
        same = lambda x, y: x.company.eqNullSafe(y.company) & x.start_year.eqNullSafe(y.start_year)
        begins = F.filter(F.transform(rows, lambda x, k: F.when((k == 0) | ~same(x, F.get(rows, k - 1)), k)), lambda k: k.isNotNull())
        return let(begins, lambda bs: F.transform(bs, lambda b, n: merged(F.slice(
            rows, b + 1, F.coalesce(F.get(bs, n + 1), F.size(rows)) - b))))

    def merged(run: Column) -> Column:
        return let(run, lambda r: F.struct(
            F.get(r, F.lit(0)).i.alias("i"), F.get(r, F.lit(0)).company.alias("company"),
            F.get(F.filter(F.transform(r, lambda x: x.position), lambda p: p.isNotNull()), F.lit(0)).alias("position"),
            F.get(r, F.lit(0)).start_year.alias("start_year"),
            F.array_max(F.transform(r, lambda x: x.end_year)).alias("end_year")))

    rows = F.array_sort(F.transform(exps, lambda e, i: F.struct(e.company, e.start_year, i.alias("i"), e.position, e.end_year)))
    return F.transform(F.array_sort(let(rows, runs_of)), lambda e: F.struct(e.company, e.position, e.start_year, e.end_year))


EXPERIENCES = "array<struct<company:string,position:string,start_year:int,end_year:int>>"


def work_experience_expr(text: Column, as_of_year: int) -> Column:
    """Experience list from lines with a time range or a leading year, newest first.

    Lines under a work heading come before the others, so of two entries for one company and start theirs counts.
    Each line is visited a fixed number of times."""
    year = lambda c: contact.year_in(c, as_of_year)

    def lines_of(ls: Column) -> Column:
        # the nearest earlier line with a company or of schooling, and whether the last heading is of work
        company = lambda c: F.when(~c.skip, first_match(c.l, f"({COMPANY})", 1))
        spots = between(ls, lambda c: c.skip | c.named, lambda mark, c: F.when(
            c.hit & ~c.skip, F.struct(c.i.alias("i"), c.l.alias("l"), company(mark).alias("seen"))))
        work = between(ls, lambda c: c.heading.isNotNull(), lambda mark, c: F.coalesce(
            c.heading == "work", (c.heading.isNull()) & (mark.heading == "work"), F.lit(False)))

        def ordered(b: Column) -> Column:
            rows = F.filter(F.transform(b.spots, lambda h, k: F.struct(h.alias("h"), F.get(b.work, k).alias("work"))), lambda x: x.h.isNotNull())
            return let(rows, lambda r: F.concat(F.filter(r, lambda x: x.work), F.filter(r, lambda x: ~x.work)))
        return F.flatten(F.transform(let(F.struct(spots.alias("spots"), work.alias("work")), ordered), lambda x: at(ls, x.h)))

    def between(ls: Column, is_mark, value) -> Column:
        """``value`` of the last mark before each line (its fields null without one) and the line, in order: every line is
        visited once, in the stretch that ends with the next mark."""
        none = F.get(ls, F.lit(-1))
        marks = F.concat(F.array(F.struct(F.lit(-1).alias("i"), none.alias("c"))),
                         F.transform(F.filter(ls, is_mark), lambda c: F.struct(c.i.alias("i"), c.alias("c"))))
        return let(marks, lambda ms: F.flatten(F.transform(ms, lambda m, k: F.transform(
            F.slice(ls, m.i + 2, F.coalesce(F.get(ms, k + 1).i, F.size(ls) - 1) - m.i), lambda c: value(m.c, c)))))

    def at(ls: Column, h: Column) -> Column:
        below = lambda n: F.coalesce(F.get(ls, h.i + n).l, F.lit(""))

        def pieces(c: Column) -> Column:
            part = lambda g: F.regexp_extract_all(c.l, F.lit(RANGE_PARTS), F.lit(g))
            head = F.regexp_extract(c.l, rf"\A(.*?)(?:{_RANGE})", 1)
            single = F.array(F.struct(
                year(F.regexp_extract(c.l, SINGLE_YEAR, 1)).alias("start"),
                F.lit(None).cast("int").alias("end"),
                F.trim(F.regexp_extract(c.l, SINGLE_YEAR, 2)).alias("after"),
                F.lit("").alias("before"), c.next.alias("next"),
                c.after_next.alias("after_next"), c.seen.alias("seen")))
            ranges = let(F.struct(part(1).alias("s"), part(2).alias("e"), part(3).alias("a"),
                                  head.alias("h")), lambda p: F.transform(p.s, lambda s, k: F.struct(
                year(s).alias("start"), year(F.get(p.e, k)).alias("end"),
                F.trim(F.get(p.a, k)).alias("after"),
                F.trim(F.when(k == 0, p.h).otherwise(F.get(p.a, k - 1))).alias("before"),
                c.next.alias("next"),
                c.after_next.alias("after_next"), c.seen.alias("seen"))))
            return F.when(c.l.rlike(_RANGE), ranges).otherwise(single)

        # a line that opens with a year and has no range stands for itself
        box = F.struct(h.l.alias("l"), below(1).alias("next"), below(2).alias("after_next"),
                       h.seen.alias("seen"))
        alone = F.struct(h.l.alias("l"), F.lit("").alias("next"), F.lit("").alias("after_next"),
                         F.lit(None).cast("string").alias("seen"))
        return let(F.when(h.l.rlike(_RANGE), box).otherwise(alone), lambda c: F.transform(
            pieces(c), lambda p: _entry(p)))

    lines = F.filter(F.transform(F.split(text, "\n"), _trim), lambda l: l != "")
    marked = F.transform(lines, lambda l, i: F.struct(
        i.alias("i"), l.alias("l"), l.rlike(f"{_RANGE}|{SINGLE_YEAR}").alias("hit"),
        _skipped(l).alias("skip"), l.rlike(COMPANY_END).alias("named"),
        F.when(contains_any(l, vocab.WORK_HEADINGS), "work").when(contains_any(l, vocab.WORK_STOPS), "other").alias("heading")))
    found = F.filter(let(marked, lines_of), lambda e: e.company.isNotNull()
                     | e.start_year.isNotNull() | e.end_year.isNotNull())
    # most texts hold no year at all: they skip the line work
    dated = text.rlike(_Y)
    return F.coalesce(F.when(dated, sort_experiences(merge_experiences(found))),
                      F.array().cast(EXPERIENCES))


def earliest_work_year_expr(text: Column, experience: Column, as_of_year: int) -> Column:
    """Earliest start year, else the earliest year of work lines, else of the text."""
    work = F.filter(F.split(text, "\n"), lambda l: contains_any(l, vocab.WORK_YEAR_WORDS)
                    & ~contains_any(l, vocab.WORK_YEAR_SKIP))
    years = lambda t: F.array_min(contact.years_in(t, as_of_year))
    return F.coalesce(earliest_year(experience), years(F.array_join(work, "\n")), years(text))


# --------------------------------------------------------------- education
DATED = r"([0-9]{4})[-~至到]([0-9]{4}|至今)"
SCHOOL_DEGREE_MAJOR = (r"([一-龥]{2,20}?(?:大学|学院|学校))\s*(本科|专科|硕士|博士|研究生)?\s*"
                       r"([一-龥]{2,20})\z")
NOT_A_MAJOR = ["本科", "专科", "硕士", "博士", "研究生", "学士", "学习", "起点", "网络", "教育"]


def _school_in(l: Column) -> Column:
    """School named on a line, less leading dates; not a bare label."""
    s = F.regexp_replace(first_match(l, edu.SCHOOL), r"\A[0-9年月\s]+", "")
    label = (s.contains("毕业") | s.contains("教育")) & (F.length(s) <= 6)
    return F.when(~label, s)


def _major_in(l: Column) -> Column:
    """Major named on a line by a label before or after it."""
    found = F.transform(F.array(
        first_match(l, r"(?:专业|主修|方向)[：:]\s*([一-龥A-Za-z]{2,20})", 1),
        F.when(l.contains("专业"), first_match(l, r"([一-龥]{2,20}?)\s*专业", 1))), edu.clean_major)
    return F.when(l.rlike("专业|主修|方向"), F.get(F.filter(found, lambda m: m.isNotNull()), F.lit(0)))


def _dated_entries(sect: Column, as_of_year: int) -> Column:
    """``end, school, level, major`` of lines "dates school degree major"."""
    def entry(l: Column) -> Column:
        end = F.regexp_extract(l, DATED, 2)
        rest = F.trim(F.regexp_replace(l, DATED, ""))
        m = F.regexp_extract(rest, SCHOOL_DEGREE_MAJOR, 3)
        return F.struct(
            F.when(end == "至今", as_of_year).otherwise(end.try_cast("int")).alias("end"),
            first_match(rest, SCHOOL_DEGREE_MAJOR, 1).alias("school"),
            edu.level_on_line(first_match(rest, SCHOOL_DEGREE_MAJOR, 2)).alias("level"),
            F.when(~m.isin(NOT_A_MAJOR), edu.clean_major(m)).alias("major"))
    lines = F.filter(F.split(sect, "\n"), lambda l: l.rlike(DATED))
    return F.filter(F.transform(lines, lambda l: entry(F.trim(l))),
                    lambda e: e.school.isNotNull() & e.major.isNotNull())


def best_education(entries: Column, by: str) -> Column:
    """Entry with the highest ``by`` (a year, or a level by rank); the first one on ties."""
    def key(e: Column) -> Column:
        return F.coalesce(edu.rank(e[by]) if by == "level" else e[by], F.lit(0))
    keyed = F.transform(entries, lambda e, i: F.struct(
        key(e).alias("k"), (-i).alias("i"), e.alias("e")))
    return F.array_max(keyed).e


def _school_entries(lines: Column) -> Column:
    """``school, level, major`` of every line with a school, looking two lines around."""
    def of(ls: Column) -> Column:
        def entry(l: Column, i: Column) -> Column:
            near = F.array(l, *[F.when(i + d >= 0, F.get(ls, i + d)) for d in (1, -1, 2, -2)])
            own = F.regexp_replace(l, edu.SCHOOL, " ")
            tokens = F.transform(F.split(own, r"[\s,，;；|/]+"), lambda t: F.struct(t.alias("t"), edu.level_on_line(t).alias("level")))
            return let(F.struct(near.alias("near"), tokens.alias("tokens")), lambda b: choose(l, b))

        def choose(l: Column, b: Column) -> Column:
            # levels and majors are looked for only where what goes first has none
            some = lambda a, f: F.get(F.filter(F.transform(a, f), lambda m: m.isNotNull()), F.lit(0))
            major = lambda pattern: some(b.tokens, lambda t: F.when(
                t.t.rlike(pattern) & t.level.isNull(), edu.clean_major(t.t)))
            degree = edu.highest_level(F.transform(b.tokens, lambda t: t.level))
            return F.struct(
                _school_in(l).alias("school"),
                F.coalesce(degree, some(b.near, edu.level_on_line)).alias("level"),
                F.coalesce(major("专业|方向|系\\z"), F.when(degree.isNotNull(), major(r"\A[一-龥]{2,20}\z")),
                           some(b.near, _major_in)).alias("major"))
        ends = alternation(vocab.SCHOOL_ENDINGS)
        rows = F.transform(ls, lambda l, i: F.when(l.rlike(ends) & l.rlike(edu.SCHOOL), entry(l, i)))
        return F.filter(rows, lambda e: e.school.isNotNull())
    return let(lines, of)


def education_expr(text: Column, kv: Column, as_of_year: int) -> Column:
    """Struct ``highest_education, school, major``."""
    labelled = edu.normalize_education(F.coalesce(_key(kv, "最高学历"), _key(kv, "学历")))
    level = edu.higher_level(edu.detect_education(text), labelled)
    level = F.coalesce(level, F.when(text.contains("职高"), "职高"))
    kv_school = blank_to_null(edu.clean_school(F.coalesce(*[_key(kv, k) for k in vocab.SCHOOL_KEYS])))
    kv_major = edu.clean_major(_key(kv, "专业"))
    # only texts that name a school at all are looked at line by line; the cheap test goes first
    schooled = text.rlike(alternation(vocab.SCHOOL_ENDINGS)) & text.rlike(edu.SCHOOL)
    lines = F.filter(F.transform(F.split(text, "\n"), _trim), lambda l: l != "")

    def collect(sect: Column) -> Column:
        return F.struct(
            level.alias("level"), kv_school.alias("kv_school"), kv_major.alias("kv_major"),
            F.when(sect.isNotNull(), best_education(_dated_entries(sect, as_of_year), "end")).alias("dated"),
            F.when(schooled, first_match(sect, edu.SCHOOL)).alias("sect_school"),
            F.when(schooled, first_match(text, edu.SCHOOL)).alias("text_school"),
            _major_in(sect).alias("sect_major"), _major_in(text).alias("text_major"),
            F.when(schooled, best_education(_school_entries(lines), "level")).alias("best"))

    def decide(f: Column) -> Column:
        level = edu.higher_level(edu.higher_level(f.level, f.dated.level), f.best.level)
        school = F.coalesce(f.dated.school, f.kv_school, f.sect_school, f.text_school)
        major = F.coalesce(f.dated.major, f.kv_major, f.sect_major, f.text_major)
        top = f.best.isNotNull() & (edu.rank(f.best.level) >= edu.rank(f.level))
        school = F.when(top, f.best.school).otherwise(F.coalesce(school, f.best.school))
        major = F.when(top, F.coalesce(f.best.major, major)).otherwise(F.coalesce(major, f.best.major))
        return F.struct(
            level.alias("highest_education"), edu.clean_school(school).alias("school"),
            F.when(~F.coalesce(level.isin("高中", "初中"), F.lit(False)), major).alias("major"))
    return let(let(section(text, vocab.EDUCATION_HEADINGS, vocab.EDUCATION_STOPS), collect), decide)


# --------------------------------------------------------------- everything
def cleaned(docs: DataFrame, key: str, text: str = "text", deal: bool = True) -> DataFrame:
    """``key, t, kv``: cleaned text and its key/value map; without ``deal`` rows stay in the tasks they are in."""
    docs = docs.select(key, text)
    df = (dealt(docs) if deal else docs).select(key, clean_resume_text(F.col(text)).alias("t"))
    return df.select(key, "t", parse_key_values("t").alias("kv"))


def extract_all(docs: DataFrame, as_of_year: int, key: str = "id",
                text: str = "text", deal: bool = True) -> DataFrame:
    """Candidate columns of every document; rows without text give NULLs."""
    df = cleaned(docs, key, text, deal)
    t, kv = F.col("t"), F.col("kv")
    df = df.select(
        key, "t", "kv", name_expr(t, kv).alias("name"), gender_expr(t, kv).alias("gender"),
        birth_year_expr(t, kv, as_of_year).alias("birth_year"),
        contact.phone_expr(t, kv).alias("phone"), contact.email_expr(t, kv).alias("email"),
        work_experience_expr(t, as_of_year).alias("work_experience"),
        education_expr(t, kv, as_of_year).alias("edu"))
    return df.select(
        key, "name", "gender", "birth_year",
        age_expr(t, kv, F.col("birth_year"), as_of_year).alias("age"), "phone", "email",
        earliest_work_year_expr(t, F.col("work_experience"), as_of_year).alias("earliest_work_year"),
        "work_experience", "edu.highest_education", "edu.school", "edu.major",
        F.col("t").alias("raw_text"))


def work_experience(docs: DataFrame, as_of_year: int, key: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """``key, work_experience`` of already cleaned texts."""
    return docs.select(key, work_experience_expr(F.col(text), as_of_year).alias("work_experience"))
