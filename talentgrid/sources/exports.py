"""Flattened export tables: résumé lists, interview lists, report rows, forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from talentgrid import vocab
from talentgrid.functions.basics import blank_to_null, first_match, non_empty, truthy
from talentgrid.functions.candidate import (
    experience_at, identity_code, json_list, range_label, years_of_service)
from talentgrid.operators.listing import by_ids

TIME = "yyyy-MM-dd HH:mm:ss"
ISO = "yyyy-MM-dd'T'HH:mm:ss"


def _col(df: DataFrame, name: str) -> Column:
    """The column, or NULL when the table does not carry it."""
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def _text(df: DataFrame, name: str) -> Column:
    """Value as text; NULL and 0 become ``''``."""
    c = _col(df, name)
    if name in df.columns and df.schema[name].dataType.typeName() in ("integer", "long", "double"):
        c = F.when(c != 0, c.cast("string"))
    return F.coalesce(c.cast("string"), F.lit(""))


def _time(df: DataFrame, name: str, fmt: str = TIME) -> Column:
    c = _col(df, name)
    return F.coalesce(F.date_format(c.cast("timestamp"), fmt), F.lit(""))


def export_resumes(resumes: DataFrame, as_of_year: int) -> DataFrame:
    """Wide résumé list, 25 columns."""
    r = resumes
    exp = F.col("work_experience")
    flagged = ((_col(r, "duplicate_status") == vocab.DUPLICATE_FLAG)
               & (_col(r, "duplicate_similarity").cast("double") >= vocab.DUPLICATE_THRESHOLD))
    years = years_of_service(_col(r, "earliest_work_year").cast("int"), exp, as_of_year)
    cols = {
        "ID": F.col("id"), "应聘岗位": _text(r, "applied_position"),
        "身份验证码": identity_code(F.col("name"), F.col("phone")),
        "查重": F.when(flagged, vocab.DUPLICATE_FLAG).otherwise(""),
        "姓名": _text(r, "name"), "性别": _text(r, "gender"), "年龄": _text(r, "age"),
        "工龄": F.coalesce(years.cast("string"), F.lit("")), "手机号": _text(r, "phone"),
    }
    for i, n in enumerate(("一", "二")):
        for label, field in (("公司", "company"), ("岗位", "position"), ("时间", "time")):
            cols[f"工作经历{n}（{label}）"] = experience_at(exp, i, field)
    cols |= {
        "邮箱": _text(r, "email"), "最高学历": _text(r, "highest_education"),
        "学校（原始）": _text(r, "school_original"), "学校（标准化）": _text(r, "school"),
        "学校状态": _text(r, "school_match_status"),
        "专业（原始）": _text(r, "major_original"), "专业（标准化）": _text(r, "major"),
        "专业状态": _text(r, "major_match_status"),
        "上传时间": _time(r, "upload_time"), "解析时间": _time(r, "parse_time"),
    }
    return r.select(*[c.alias(n) for n, c in cols.items()])


def export_resumes_csv(resumes: DataFrame) -> DataFrame:
    """Short résumé list, 15 columns in file order."""
    r = resumes
    names = [("ID", "id"), ("姓名", "name"), ("性别", "gender"), ("出生年份", "birth_year"),
             ("年龄", "age"), ("手机号", "phone"), ("邮箱", "email"),
             ("最高学历", "highest_education"), ("毕业院校", "school"), ("专业", "major"),
             ("应聘岗位", "applied_position"), ("匹配度", "match_score"),
             ("匹配等级", "match_level")]
    return r.select(
        *[F.coalesce(_col(r, c).cast("string"), F.lit("")).alias(n) for n, c in names],
        _time(r, "upload_time", ISO).alias("上传时间"),
        F.coalesce(_col(r, "parse_status"), F.lit("")).alias("解析状态"))


_ROUND_NAMES = (("一面", 1), ("二面", 2), ("三面", 3))


def export_interviews(interviews: DataFrame, resumes: DataFrame,
                      ids: DataFrame | list[int] | None = None, newest_first: bool = False) -> DataFrame:
    """Interview list, 24 columns; the code comes from the résumé only.

    Given ids (a table of them, or a short list) export only those, otherwise all;
    on request newest update first, which sorts the whole result.
    """
    iv = interviews
    if ids is not None:
        iv = by_ids(iv, ids)
    owner = resumes.select(F.col("id").alias("resume_id"), F.col("name").alias("_r_name"),
                           F.col("phone").alias("_r_phone"))
    df = iv.join(owner, "resume_id", "left")
    if newest_first:
        df = df.orderBy(F.col("update_time").desc(), F.col("id"))
    cols = {"身份验证码": identity_code(F.col("_r_name"), F.col("_r_phone")),
            "姓名": _text(iv, "name"), "应聘岗位": _text(iv, "applied_position"),
            "当前状态": _text(iv, "status")}
    for n, k in _ROUND_NAMES:
        for label, f in (("面试官", "interviewer"), ("时间", "time"), ("结果", "result"),
                         ("评价", "comment")):
            cols[f"{n}{label}"] = _text(iv, f"round{k}_{f}")
    cols |= {
        "是否发放Offer": F.when(truthy(F.col("offer_issued")), "是").otherwise("否"),
        "Offer发放日期": _text(iv, "offer_date"), "拟入职架构": _text(iv, "offer_department"),
        "拟入职日期": _text(iv, "offer_onboard_plan_date"),
        "是否已入职": F.when(truthy(F.col("onboard")), "是").otherwise("否"),
        "实际入职日期": _text(iv, "onboard_date"), "入职架构": _text(iv, "onboard_department"),
        "最后修改时间": _time(iv, "update_time"),
    }
    return df.select(*[c.alias(n) for n, c in cols.items()])


def export_interviews_csv(interviews: DataFrame) -> DataFrame:
    """Interview list, 22 columns, with the stored code."""
    iv = interviews
    text = lambda n: F.coalesce(_col(iv, n).cast("string"), F.lit(""))
    cols = {"ID": F.col("id"), "姓名": text("name"), "应聘岗位": text("applied_position"),
            "身份验证码": text("identity_code"), "匹配度": text("match_score"),
            "匹配等级": text("match_level"), "状态": text("status")}
    for n, k in _ROUND_NAMES:
        for label, f in (("面试官", "interviewer"), ("时间", "time"), ("结果", "result")):
            cols[f"{n}{label}"] = text(f"round{k}_{f}")
    yes = lambda c: F.when(F.coalesce(F.col(c) == 1, F.lit(False)), "是").otherwise("否")
    cols |= {"是否发offer": yes("offer_issued"), "offer日期": text("offer_date"),
             "是否入职": yes("onboard"), "入职日期": text("onboard_date"),
             "创建时间": _time(iv, "create_time", ISO), "更新时间": _time(iv, "update_time", ISO)}
    return iv.select(*[c.alias(n) for n, c in cols.items()])


def write_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """CSV folder with a header; ``bom`` puts one mark before the first header."""
    if bom:
        df = df.withColumnRenamed(df.columns[0], "﻿" + df.columns[0])
    df.write.option("header", True).option("quoteAll", False).option("escape", '"').csv(path)


SUGGESTION = r"(?s)\A【考核重点】(.*?)\s*[-—–]\s*【面试问题】(.*)\z"


def report_rows(resumes: DataFrame, missing: str = "-") -> DataFrame:
    """Candidate report as rows ``id, section, line_no, label, value``.

    Sections: 1 position, 2 basics, 3 education, 4 experiences, 5 match
    analysis.  ``missing`` is ``-`` for the printed form and ``''`` for the
    sheet.  Everything is built inside the row and exploded once: no shuffle.
    """
    r = resumes

    def line(section: int, no: int | Column, label: str | Column, value: Column) -> Column:
        return F.struct(
            F.lit(section).alias("section"),
            (F.lit(no) if isinstance(no, int) else no).cast("int").alias("line_no"),
            (F.lit(label) if isinstance(label, str) else label).alias("label"),
            value.alias("value"))

    def value(name: str) -> Column:
        c = _col(r, name)
        if name in r.columns and r.schema[name].dataType.typeName() in ("integer", "long"):
            c = F.when(c != 0, c)
        return F.coalesce(blank_to_null(c.cast("string")), F.lit(missing))

    fixed = [line(1, 1, "应聘岗位", value("applied_position"))]
    for i, (label, c) in enumerate((("姓名", "name"), ("性别", "gender"), ("出生年份", "birth_year"),
                                    ("年龄", "age"), ("手机号", "phone"), ("邮箱", "email")), 1):
        fixed.append(line(2, i, label, value(c)))
    for i, (label, c) in enumerate((("最高学历", "highest_education"), ("毕业学校", "school"),
                                    ("专业", "major")), 1):
        fixed.append(line(3, i, label, value(c)))
    parts = [F.array(*fixed)]

    exp = F.col("work_experience")

    def experience(e: Column, i: Column) -> Column:
        text = F.concat_ws(" | ", F.coalesce(blank_to_null(e.company), F.lit(missing)),
                           F.coalesce(blank_to_null(e.position), F.lit(missing)),
                           range_label(e.start_year, e.end_year, " - ", "至 ", missing))
        return line(4, i + 1, "工作经历", text)

    none = F.array(line(4, 1, "工作经历", F.lit("暂无工作经历")))
    parts.append(F.when(F.size(exp) > 0, F.transform(exp, experience)).otherwise(none))

    if "match_analysis" in r.columns:
        a = F.col("match_analysis")

        def items(no: int, label: str, arr: Column) -> Column:
            return F.coalesce(F.transform(arr, lambda x, i: line(5, no + i, label, x)),
                              F.array().cast(LINES))

        def suggestion(x: Column, i: Column) -> Column:
            focus, question = (F.regexp_extract(x, SUGGESTION, g) for g in (1, 2))
            return F.when(x.rlike(SUGGESTION), F.array(
                line(5, 3000 + 2 * i, "考核重点", F.trim(focus)),
                line(5, 3001 + 2 * i, "面试问题", F.trim(question)))
            ).otherwise(F.array(line(5, 3000 + 2 * i, "建议", x)))

        head = F.filter(F.array(
            line(5, 1, "匹配度分数", a.match_score.cast("int").cast("string")),
            line(5, 2, "匹配等级", blank_to_null(a.match_level)),
            line(5, 3, "详细分析", blank_to_null(a.detailed_analysis))),
            lambda x: x.value.isNotNull())
        tips = F.coalesce(F.flatten(F.transform(a.suggestions, suggestion)), F.array().cast(LINES))
        full = F.concat(head, items(1000, "优势", a.strengths), items(2000, "不足", a.weaknesses), tips)
        empty = F.array(line(5, 1, "匹配度分析", F.lit("暂无匹配度分析结果")))
        parts.append(F.when(a.isNotNull(), full).otherwise(empty))
    else:
        score = F.coalesce(_col(r, "match_score").cast("string"), F.lit(missing))
        parts.append(F.array(line(5, 1, "匹配度分数", score), line(5, 2, "匹配等级", value("match_level"))))
    return r.select("id", F.explode(F.concat(*parts)).alias("l")).select("id", "l.*")


LINES = "array<struct<section:int,line_no:int,label:string,value:string>>"


def round_report_rows(interviews: DataFrame) -> DataFrame:
    """Report rows of every round of every interview: ``id, round, section, label, value``."""
    iv = interviews

    def row(section: int, no: int, label: str, value: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), F.lit(no).alias("line_no"),
                        F.lit(label).alias("label"), value.alias("value"))

    def v(name: str, missing: str = "-") -> Column:
        return F.coalesce(blank_to_null(_col(iv, name).cast("string")), F.lit(missing))

    rounds = []
    for name, k in _ROUND_NAMES:
        rows = F.array(
            row(1, 1, "姓名", v("name")), row(1, 2, "应聘岗位", v("applied_position")),
            row(1, 3, "当前流程状态", v("status")), row(1, 4, "简历匹配度", v("match_score")),
            row(2, 1, "面试轮次", F.lit(name)), row(2, 2, "面试官", v(f"round{k}_interviewer")),
            row(2, 3, "面试时间", F.substring(v(f"round{k}_time"), 1, 10)),
            row(2, 4, "面试结果", v(f"round{k}_result", "未填写")),
            row(2, 5, "面试评价", v(f"round{k}_comment", "暂无填写")),
            row(3, 1, "AI 分析结果", v(f"round{k}_ai_result", "暂无AI分析结果")))
        rounds.append(F.struct(F.lit(k).alias("round"), rows.alias("rows")))
    per_round = iv.select("id", F.explode(F.array(*rounds)).alias("r"))
    return per_round.select("id", "r.round", F.inline("r.rows"))


def registration_rows(interviews: DataFrame, n: int | None = None) -> DataFrame:
    """Registration form, flattened; the ethnicity is labelled as what it is.

    All work experiences of the form, or its first ``n``.
    """
    iv = interviews
    f = lambda n: F.coalesce(_col(iv, f"registration_form_{n}"), F.lit(""))
    plain = ["ethnicity", "birth_date", "marital_status", "has_children", "origin", "id_card",
             "first_work_date", "education_start_date", "education_end_date", "institution",
             "major", "degree", "full_time", "education", "hobbies", "current_salary",
             "expected_salary", "available_date", "address_detail", "can_travel", "contact",
             "email", "fill_date"]
    space = F.lit(" ")
    exp = ("array<struct<company:string,position:string,start_year:string,end_year:string>>")
    experiences = json_list(f("recent_work_experience"), exp)
    return iv.select(
        "id", F.coalesce("name", F.lit("")).alias("name"),
        F.coalesce("applied_position", F.lit("")).alias("applied_position"),
        *[f(n).alias(n) for n in plain],
        F.concat(f("address_province"), space, f("address_city"), space,
                 f("address_district")).alias("address"),
        (experiences if n is None else F.slice(experiences, 1, n)).alias("work_experience"),
        json_list(f("consideration_factors")).alias("factors"))
