"""Typed table scans and the JSON row form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from talentgrid import schemas
from talentgrid.operators.maintain import conform


def load_table(spark: SparkSession, name: str, path: str, fmt: str = "parquet") -> DataFrame:
    """Scan of a declared table; unknown columns are never read, missing ones are NULL."""
    return spark.read.schema(schemas.TABLES[name]).format(fmt).load(path)


def load_any(spark: SparkSession, name: str, path: str, fmt: str = "parquet") -> DataFrame:
    """Same for files whose column types differ: read as stored, then cast."""
    return conform(spark.read.format(fmt).load(path), schemas.TABLES[name])


def save_version(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Write a new version of a table; never onto the path it was read from."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def to_json_rows(df: DataFrame, table: str) -> DataFrame:
    """``id, json``: one JSON object per row, NULLs kept, ISO timestamps."""
    omits = set(schemas.RESUME_JSON_OMITS) if table == "resumes" else {"password_hash"}
    cols = [c for c in df.columns if c not in omits]
    lists = ("registration_form_recent_work_experience", "registration_form_consideration_factors")
    fields = [F.coalesce(F.try_parse_json(F.col(c)), F.parse_json(F.lit("[]"))).alias(c)
              if c in lists else F.col(c) for c in cols]
    options = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", "ignoreNullFields": "false"}
    return df.select("id", F.to_json(F.struct(*fields), options).alias("json"))
