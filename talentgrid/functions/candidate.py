"""Candidate scalars: codes, ages, years, scores, labels, JSON decoding."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from talentgrid import vocab
from talentgrid.functions.basics import blank_to_null, non_empty, strip_ws, truthy


def identity_code(name: Column, phone: Column) -> Column:
    """Name plus the last four characters of the phone; ``''`` without a name."""
    return (F.when(~non_empty(name) | name.isNull(), F.lit(""))
            .when(F.length(phone) >= 4, F.concat(name, F.right(phone, F.lit(4))))
            .otherwise(name))


def resolve_age(extracted: Column, birth_year: Column, as_of_year: int) -> Column:
    """Age found in the text, else the as-of year minus the birth year."""
    return F.when(truthy(extracted), extracted).when(
        truthy(birth_year), F.lit(as_of_year) - birth_year)


def earliest_year(experience: Column) -> Column:
    """Smallest start year that is neither NULL nor 0."""
    return F.array_min(F.filter(F.transform(experience, lambda e: e.start_year), truthy))


def years_of_service(earliest: Column, experience: Column | None, as_of_year: int) -> Column:
    """As-of year minus the earliest work year; NULL when that is negative."""
    start = F.when(truthy(earliest), earliest)
    if experience is not None:
        start = F.coalesce(start, earliest_year(experience))
    years = F.lit(as_of_year) - start
    return F.when(years >= 0, years)


def range_label(start: Column, end: Column, dash: str = "-", to: str = "至",
                missing: str = "") -> Column:
    """``a-b``, ``a-至今``, ``至b`` or nothing; 0 counts as missing."""
    s, e = truthy(start), truthy(end)
    return (F.when(s & e, F.concat(start.cast("string"), F.lit(dash), end.cast("string")))
            .when(s, F.concat(start.cast("string"), F.lit(dash + "至今")))
            .when(e, F.concat(F.lit(to), end.cast("string")))
            .otherwise(F.lit(missing)))


def experience_block(experience: Column) -> Column:
    """One ``company | position | range`` line per experience, blanks left out."""
    def line(e: Column) -> Column:
        parts = F.array(
            strip_ws(F.coalesce(e.company, F.lit(""))),
            strip_ws(F.coalesce(e.position, F.lit(""))),
            range_label(e.start_year, e.end_year))
        return F.array_join(F.filter(parts, lambda p: p != ""), " | ")
    lines = F.filter(F.transform(experience, line), lambda x: x != "")
    return F.coalesce(F.array_join(lines, "\n"), F.lit(""))


def experience_at(experience: Column, i: int, field: str) -> Column:
    """Field of the ``i``-th experience, ``''`` when there is none."""
    e = F.get(experience, F.lit(i))
    if field == "time":
        return F.coalesce(range_label(e.start_year, e.end_year), F.lit(""))
    return F.coalesce(e.getField(field).cast("string"), F.lit(""))


def sort_experiences(experience: Column) -> Column:
    """Newest first by (start or end, end or start), rows without years last.

    The array index is part of the key, so equal rows keep their order.
    """
    keyed = F.transform(experience, lambda e, i: F.struct(
        (-F.coalesce(e.start_year, e.end_year, F.lit(-1))).alias("a"),
        (-F.coalesce(e.end_year, e.start_year, F.lit(-1))).alias("b"),
        i.alias("i"), e.alias("e")))
    return F.transform(F.array_sort(keyed), lambda k: k.e)


def newest_experiences(experience: Column, n: int = 2) -> Column:
    """The list shown on screen: start year descending with NULL as 0."""
    keyed = F.transform(experience, lambda e, i: F.struct(
        (-F.coalesce(e.start_year, F.lit(0))).alias("a"), i.alias("i"), e.alias("e")))
    return F.slice(F.transform(F.array_sort(keyed), lambda k: k.e), 1, n)


def union_experiences(a: Column, b: Column) -> Column:
    """``a`` then those of ``b`` whose (company, start, end) is new."""
    def key(e: Column) -> Column:
        return F.struct(e.company, e.start_year, e.end_year)
    both = F.concat(F.coalesce(a, F.array().cast("array<struct<company:string,position:string,"
                                                 "start_year:int,end_year:int>>")), b)
    keys = F.transform(both, key)
    n_a = F.coalesce(F.size(a), F.lit(0))
    return F.filter(both, lambda e, i: (i < n_a) | (
        F.array_position(keys, key(e)) == (i + 1)))


def rescale_score(raw: Column) -> Column:
    """Widened match score: NULL reads as 60, then raw*0.7+30 kept in 50..100."""
    score = F.coalesce(raw.cast("double"), F.lit(60.0)) * F.lit(0.7) + F.lit(30.0)
    return F.floor(F.greatest(F.lit(50.0), F.least(F.lit(100.0), score))).cast("int")


def match_level(score: Column) -> Column:
    high, middle, low = vocab.MATCH_LEVELS
    return F.when(score >= 80, high).when(score >= 60, middle).otherwise(low)


def score_bucket(score: Column) -> Column:
    """Colour shown beside a score."""
    return (F.when(score.isNull(), "gray").when(score >= 80, "green")
            .when(score >= 60, "orange").otherwise("red"))


def file_extension(name: Column) -> Column:
    """Lower-cased text after the last dot, NULL without a dot."""
    return F.lower(F.when(name.contains("."), F.substring_index(name, ".", -1)))


def file_kind(name: Column) -> Column:
    ext = file_extension(name)
    return (F.when(ext == "pdf", "pdf").when(ext.isin("doc", "docx"), "word")
            .otherwise("other"))


def mime_type(name: Column) -> Column:
    ext = file_extension(name)
    return (F.when(ext == "pdf", "application/pdf")
            .when(ext == "doc", "application/msword")
            .when(ext == "docx", "application/vnd.openxmlformats-officedocument"
                                 ".wordprocessingml.document")
            .otherwise("application/octet-stream"))


def unwrap_form_value(c: Column) -> Column:
    """A JSON object gives its ``value``, else ``label``, else ``''``."""
    picked = F.coalesce(blank_to_null(F.get_json_object(c, "$.value")),
                        blank_to_null(F.get_json_object(c, "$.label")), F.lit(""))
    return F.when(F.ltrim(c).startswith("{") & F.try_parse_json(c).isNotNull(),
                  picked).otherwise(c)


def json_list(c: Column, schema: str = "array<string>", null_default: bool = False) -> Column:
    """Decoded JSON list; bad or empty text gives ``[]`` (or NULL on request)."""
    parsed = F.from_json(blank_to_null(c), schema)
    return parsed if null_default else F.coalesce(parsed, F.from_json(F.lit("[]"), schema))
