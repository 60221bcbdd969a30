"""Re-extraction of stored résumés as one batch job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from talentgrid.operators.extraction import extract_all
from talentgrid.operators.maintain import upsert_extracted
from talentgrid.sources.documents import reextract_inputs


def reextract(resumes: DataFrame, texts: DataFrame, as_of_year: int,
              names: list[str] | None = None, now: Column | None = None) -> DataFrame:
    """New state of ``resumes`` after extraction from stored text, else file text.

    ``texts`` is ``path, text, error``.  A résumé without any text becomes
    ``failed`` with the reason and keeps its fields; ``names`` limits the job to
    those candidates, the others stay as they are.
    """
    chosen = resumes if names is None else resumes.filter(F.col("name").isin(names))
    inputs = reextract_inputs(chosen, texts)
    good = inputs.filter(F.col("parse_status") == "success")
    state = upsert_extracted(resumes, extract_all(good, as_of_year), as_of_year, now)
    bad = inputs.filter(F.col("parse_status") == "failed").select(
        "id", F.col("error_message").alias("_why"))
    out = state.join(bad, "id", "left")
    hit = F.col("_why").isNotNull()
    return out.withColumns({
        "parse_status": F.when(hit, "failed").otherwise(F.col("parse_status")),
        "error_message": F.when(hit, F.col("_why")).otherwise(F.col("error_message")),
    }).select(*resumes.columns)
