"""Table maintenance as transforms: each returns the new state of the table.

Parquet has no MERGE.  The ``*_stored`` forms apply a transform to a keyed table:
they rewrite the buckets of the changed keys and leave all other files alone, and
readers see the old version until the new one is complete.
"""

from __future__ import annotations

from typing import Any, Mapping

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from talentgrid import vocab
from talentgrid.functions.basics import blank_to_null, truthy
from talentgrid.functions.candidate import earliest_year, resolve_age
from talentgrid.sources.keyed import KeyedTable


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Columns of ``schema`` in its order: missing ones NULL, unknown ones dropped."""
    return df.select(*[
        (F.col(f.name).cast(f.dataType) if f.name in df.columns
         else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


def insert_rows(table: DataFrame, new: DataFrame,
                defaults: Mapping[str, Any] | None = None) -> DataFrame:
    """Append ``new``; NULL or absent columns take their default (a value or Column)."""
    defaults = {k: v if isinstance(v, Column) else F.lit(v) for k, v in (defaults or {}).items()}
    rows = conform(new, table.schema)
    rows = rows.withColumns({k: F.coalesce(F.col(k), v.cast(table.schema[k].dataType))
                             for k, v in defaults.items() if k in rows.columns})
    return table.unionByName(rows)


def new_resume_defaults(now: Column | None = None, user: str = "system") -> dict[str, Any]:
    now = now if now is not None else F.current_timestamp()
    return {"parse_status": "pending", "upload_time": now, "created_by": user,
            "updated_by": user, "created_at": now, "updated_at": now}


def partial_update(table: DataFrame, updates: DataFrame, key: str = "id",
                   order: str | None = None, touch: str | None = "updated_at",
                   touched_at: Column | None = None) -> DataFrame:
    """Overwrite only the fields an update names.

    ``updates`` holds the key, candidate values and ``present array<string>``.
    A named field is written even when NULL.  Several updates of a key apply in
    ``order``: per field the last one that names it wins, found by an aggregate
    with map-side partials, so a hot key does not gather in one task.
    """
    fields = [c for c in updates.columns if c in table.columns and c != key]
    when = F.col(order) if order else F.lit(0)
    aggs = []
    for f in fields:
        named = F.array_contains("present", f)
        box = F.when(named, F.struct(F.col(f).alias("v")))
        aggs.append(F.max_by(box, F.when(named, when)).alias(f"_{f}"))
    last = updates.groupBy(key).agg(F.max(F.lit(True)).alias("_hit"), *aggs)
    out = table.join(last, key, "left")
    sets = {f: F.when(F.col(f"_{f}").isNotNull(), F.col(f"_{f}.v")).otherwise(F.col(f))
            for f in fields}
    if touch and touch in table.columns:
        at = touched_at if touched_at is not None else F.current_timestamp()
        sets[touch] = F.when(F.col("_hit"), at).otherwise(F.col(touch))
    return out.withColumns(sets).select(
        *table.columns, *[F.col(f"_{f}").isNotNull().alias(f"_set_{f}") for f in fields])


def drop_marks(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_set_")])


def update_resumes(resumes: DataFrame, updates: DataFrame, as_of_year: int,
                   **kw: Any) -> DataFrame:
    """Partial update of résumés with the derived columns kept in step.

    A named birth year rederives the age (the age found in the résumé wins); a
    named experience list rederives the earliest work year unless that is named.
    """
    out = partial_update(resumes, updates, **kw)
    sets: dict[str, Column] = {}
    if "_set_birth_year" in out.columns and "age" in out.columns:
        age = resolve_age(F.col("age_from_resume"), F.col("birth_year"), as_of_year)
        sets["age"] = F.when(F.col("_set_birth_year"), F.coalesce(age, F.col("age"))
                             ).otherwise(F.col("age"))
    if "_set_work_experience" in out.columns:
        named = F.col("_set_earliest_work_year") if "_set_earliest_work_year" in out.columns \
            else F.lit(False)
        derived = F.coalesce(earliest_year(F.col("work_experience")), F.col("earliest_work_year"))
        sets["earliest_work_year"] = F.when(F.col("_set_work_experience") & ~named, derived
                                            ).otherwise(F.col("earliest_work_year"))
    return drop_marks(out.withColumns(sets) if sets else out)


def delete_ids(table: DataFrame, ids: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Table without the listed keys, and a one-row count of what went."""
    gone = ids.select(F.col(ids.columns[0]).alias(key)).distinct()
    kept = table.join(gone, key, "left_anti")
    count = table.join(gone, key, "left_semi").agg(F.count(F.lit(1)).alias("deleted"))
    return kept, count


def upsert_extracted(resumes: DataFrame, extracted: DataFrame, as_of_year: int,
                     now: Column | None = None) -> DataFrame:
    """Write extraction results back; school and major only when found."""
    fields = ["name", "gender", "birth_year", "age", "phone", "email", "highest_education",
              "school", "major", "work_experience", "raw_text"]
    e = extracted.select("id", F.struct(*[F.col(f) for f in fields]).alias("_e"))
    out = resumes.join(e, "id", "left")
    hit = F.col("_e").isNotNull()
    sets: dict[str, Column] = {}
    for f in ["name", "gender", "birth_year", "phone", "email", "highest_education",
              "work_experience", "raw_text"]:
        sets[f] = F.when(hit, F.col(f"_e.{f}")).otherwise(F.col(f))
    found_age = F.col("_e.age")
    sets["age_from_resume"] = F.when(hit & truthy(found_age), found_age).otherwise(
        F.col("age_from_resume"))
    sets["age"] = F.when(hit, F.coalesce(
        resolve_age(found_age, F.col("_e.birth_year"), as_of_year), F.col("age"))
    ).otherwise(F.col("age"))
    for f in ("school", "major"):
        found = F.coalesce(blank_to_null(F.col(f"_e.{f}")), F.col(f))
        sets[f] = F.when(hit, found).otherwise(F.col(f))
        sets[f"{f}_original"] = F.when(
            hit, F.coalesce(blank_to_null(F.col(f"_e.{f}")), F.col(f"{f}_original"))
        ).otherwise(F.col(f"{f}_original"))
    sets["earliest_work_year"] = F.when(hit, F.coalesce(
        earliest_year(F.col("_e.work_experience")), F.col("earliest_work_year"))
    ).otherwise(F.col("earliest_work_year"))
    sets["parse_status"] = F.when(hit, F.lit("success")).otherwise(F.col("parse_status"))
    sets["parse_time"] = F.when(hit, now if now is not None else F.current_timestamp()
                                ).otherwise(F.col("parse_time"))
    sets["error_message"] = F.when(hit, F.lit(None).cast("string")).otherwise(
        F.col("error_message"))
    return out.withColumns(sets).select(*resumes.columns)


def insert_stored(table: KeyedTable, new: DataFrame, defaults: Mapping[str, Any] | None = None) -> None:
    """Append ``new`` with its defaults; no file of the table is read or rewritten."""
    table.append(insert_rows(table.read([]), new, defaults))


def update_stored(table: KeyedTable, updates: DataFrame, **kw: Any) -> list[int]:
    """``partial_update`` of a stored table by its key; returns the buckets rewritten."""
    return table.merge(updates, lambda rows, new: drop_marks(partial_update(rows, new, table.key, **kw)))


def update_resumes_stored(table: KeyedTable, updates: DataFrame, as_of_year: int, **kw: Any) -> list[int]:
    """``update_resumes`` of stored résumés."""
    return table.merge(updates, lambda rows, new: update_resumes(rows, new, as_of_year, **kw))


def delete_stored(table: KeyedTable, ids: DataFrame) -> list[int]:
    """Remove the listed keys; a bucket that loses its last row loses its files."""
    gone = ids.select(F.col(ids.columns[0]).alias(table.key))
    return table.merge(gone, lambda rows, new: delete_ids(rows, new, table.key)[0])


def upsert_stored(table: KeyedTable, extracted: DataFrame, as_of_year: int, now: Column | None = None) -> list[int]:
    """``upsert_extracted`` into stored résumés."""
    return table.merge(extracted, lambda rows, new: upsert_extracted(rows, new, as_of_year, now))


def apply_duplicates(resumes: DataFrame, best: DataFrame) -> DataFrame:
    """Set or clear the duplicate columns from ``best(id, duplicate_id, similarity)``."""
    b = best.select("id", F.struct("duplicate_id", "similarity").alias("_b"))
    hit = F.col("_b").isNotNull()
    out = resumes.join(b, "id", "left")
    return out.withColumns({
        "duplicate_status": F.when(hit, F.lit(vocab.DUPLICATE_FLAG)),
        "duplicate_similarity": F.col("_b.similarity"),
        "duplicate_resume_id": F.col("_b.duplicate_id"),
    }).select(*dict.fromkeys(resumes.columns + [
        "duplicate_status", "duplicate_similarity", "duplicate_resume_id"]))


def changed_since(tables: Mapping[str, DataFrame], t: str | None,
                  column: str = "updated_at") -> DataFrame:
    """One boolean per table: is any row newer than ``t``?  Blank or bad ``t`` → all false.

    Only newer rows are read where the scan can tell by its statistics.  Per table
    one partial maximum; the maxima are united and pivoted by a conditional
    aggregate, so nothing is cross joined.
    """
    since = F.try_to_timestamp(F.lit(t if t else None))
    parts = None
    for name, df in tables.items():
        newer = F.col(column).cast("timestamp") > since
        part = df.filter(newer).agg(F.max(F.col(column).cast("timestamp")).alias("newest")).withColumn(
            "table", F.lit(name))
        parts = part if parts is None else parts.unionByName(part)
    return parts.agg(*[
        F.coalesce(F.max(F.when(F.col("table") == name, F.col("newest"))) > since,
                   F.lit(False)).alias(name) for name in tables])


def latest_version(changes: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """Last write per key by (``ts``, ``tie``): an aggregate, not a sort per key,
    so each task keeps one candidate row per key and a hot key stays spread."""
    rest = [c for c in changes.columns if c != key]
    best = changes.groupBy(key).agg(
        F.max_by(F.struct(*rest), F.struct(ts, tie)).alias("_last"))
    return best.select(key, *[F.col(f"_last.{c}").alias(c) for c in rest]).select(*changes.columns)
