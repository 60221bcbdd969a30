"""Model answers: JSON found in text, checked fields, merge with rule results."""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DataType

from talentgrid import schemas, vocab
from talentgrid.functions.basics import blank_to_null, first_match, let, strip_ws, truthy
from talentgrid.functions.candidate import earliest_year, match_level, rescale_score


def json_in_text(text: Column, fenced: bool = False) -> Column:
    """The JSON of an answer: from the first ``{`` to the last ``}``, or without code fences.

    NULL when it is not valid JSON.
    """
    if fenced:
        body = F.regexp_replace(strip_ws(text), r"\A```(?:json)?|```\z", "")
    else:
        body = F.coalesce(first_match(text, r"(?s)\{.*\}"), text)
    return let(body, lambda b: F.when(F.try_parse_json(b).isNotNull(), b))


def parse_model_json(text: Column, schema: DataType | str, default: Column | None = None,
                     fenced: bool = False) -> Column:
    """Answer as a struct; ``default`` (or NULL) when it holds no valid JSON."""
    body = json_in_text(text, fenced)
    parsed = let(body, lambda b: F.when(b.isNotNull(), F.from_json(b, schema)))
    return parsed if default is None else F.coalesce(parsed, default)


def match_analysis(text: Column) -> Column:
    """Match analysis of an answer: suggestions kept by format, score widened, level set.

    An unreadable answer becomes score 50 with its whole text as the analysis.  A score
    may be a number or a numeral in quotes; a missing one counts as 60, one that is no
    number stays unknown (NULL) with the answer's own level.
    """
    none = F.array().cast("array<string>")
    default = F.struct(
        F.lit("50").alias("match_score"), F.lit("中等匹配").alias("match_level"),
        text.alias("detailed_analysis"), none.alias("strengths"),
        none.alias("weaknesses"), none.alias("suggestions")).cast(schemas.MATCH_ANALYSIS)
    def widen(a: Column) -> Column:
        raw = strip_ws(a.match_score).try_cast("double")
        score = F.when(a.match_score.isNull() | raw.isNotNull(), rescale_score(raw))
        return F.struct(
            score.alias("match_score"),
            F.when(score.isNull(), a.match_level).otherwise(match_level(score)).alias("match_level"),
            a.detailed_analysis.alias("detailed_analysis"), a.strengths.alias("strengths"),
            a.weaknesses.alias("weaknesses"), valid_suggestions(a.suggestions).alias("suggestions"))
    return let(parse_model_json(text, schemas.MATCH_ANALYSIS, default), widen)


def round_analysis(text: Column) -> Column:
    """Interview-round analysis of an answer; unreadable text becomes the summary."""
    none = F.array().cast("array<string>")
    default = F.struct(
        text.alias("summary"), none.alias("strengths"), none.alias("weaknesses"),
        F.lit("").alias("conclusion"), none.alias("next_questions")).cast(schemas.ROUND_ANALYSIS)
    return parse_model_json(text, schemas.ROUND_ANALYSIS, default)


def valid_suggestions(suggestions: Column) -> Column:
    """Suggestions in the form ``【考核重点】… - 【面试问题】…``."""
    return F.filter(suggestions, lambda s: s.rlike(r"(?U)\A【考核重点】.*?\s*[-—–]\s*【面试问题】"))


def normalize_model(answer: Column, as_of_year: int, max_chars: Mapping[str, int] | None = None) -> Column:
    """Checked fields of a model answer struct; what fails its check is NULL.

    No year lies after ``as_of_year``.  ``max_chars`` may bound the length of a field.
    """
    def text(c: Column, field: str = "") -> Column:
        n = (max_chars or {}).get(field)
        return let(strip_ws(c), lambda t: F.when((F.length(t) >= 1) & (F.lit(True) if n is None else F.length(t) <= n), t))

    def year(c: Column, low: int) -> Column:
        return let(strip_ws(c).try_cast("int"), lambda y: F.when(y.between(low, as_of_year), y))

    def level(edu: Column) -> Column:
        out = edu
        for key, value in reversed(vocab.MODEL_EDUCATION.items()):
            out = F.when(edu.contains(key), value).otherwise(out)
        return out

    def experience(e: Column) -> Column:
        return F.struct(text(e.company, "company").alias("company"),
                        text(e.position, "position").alias("position"),
                        year(e.start_year, 1980).alias("start_year"),
                        year(e.end_year, 1980).alias("end_year"))

    def check(m: Column) -> Column:
        exps = F.filter(F.transform(m.work_experience, experience), lambda e: F.coalesce(
            e.company, e.position, e.start_year.cast("string"), e.end_year.cast("string")).isNotNull())
        return F.when(m.isNotNull(), F.struct(
            text(F.regexp_replace(m["name"], "姓名[：:]", ""), "name").alias("name"),
            let(strip_ws(m.gender), lambda g: F.when(g.isin("男", "女"), g)).alias("gender"),
            year(m.birth_year, 1950).alias("birth_year"),
            let(F.regexp_replace(m.phone, r"(?U)\D", ""),
                lambda d: F.when(F.length(d) == 11, d)).alias("phone"),
            let(text(m.email, "email"), lambda a: F.when(a.contains("@"), a)).alias("email"),
            let(text(m.highest_education, "highest_education"), level).alias("highest_education"),
            text(m.school, "school").alias("school"), text(m.major, "major").alias("major"),
            exps.alias("work_experience")))
    return let(answer, check)


def merge_extractions(rule: DataFrame, model: DataFrame, as_of_year: int,
                      key: str = "id") -> DataFrame:
    """Rule columns with the model's answer preferred; the rules fill what it lacks.

    ``model`` is ``key, m`` with ``m`` from ``normalize_model``.  The experience
    list is taken whole from the model when it has one, and the earliest work
    year follows the list that was taken.
    """
    df = rule.join(model.select(key, F.col("m").alias("_m")), key, "left")
    sets: dict[str, Column] = {}
    for f in ("name", "gender", "phone", "email", "highest_education", "school", "major"):
        sets[f] = F.coalesce(blank_to_null(F.col(f"_m.{f}")), F.col(f))
    birth = F.when(truthy(F.col("_m.birth_year")), F.col("_m.birth_year"))
    sets["birth_year"] = F.coalesce(birth, F.col("birth_year"))
    computed = F.when(F.col("_m").isNotNull() & truthy(sets["birth_year"]),
                      F.lit(as_of_year) - sets["birth_year"])
    sets["age"] = F.coalesce(F.when(truthy(F.col("age")), F.col("age")), computed, F.col("age"))
    exps = F.when(F.size(F.col("_m.work_experience")) > 0, F.col("_m.work_experience")
                  ).otherwise(F.col("work_experience"))
    sets["work_experience"] = exps
    sets["earliest_work_year"] = F.when(
        F.col("_m").isNotNull(), F.coalesce(earliest_year(exps), F.col("earliest_work_year"))
    ).otherwise(F.col("earliest_work_year"))
    return df.select(key, *[sets.get(c, F.col(c)).alias(c) for c in rule.columns if c != key])


