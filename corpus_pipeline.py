"""The corpus pipeline: language ID, line dedup, near-duplicate removal, benchmark decontamination, tokens."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talentgrid.llm import bpe, decontaminate, language, line_dedup, near_dedup
from talentgrid.llm.common import ship_package, small_enough, stored, table

#: The columns that stages read; others pass through under names that no operator uses.
OWN = ("doc_id", "text", "lang", "source", "n_chars")


def apart(stage):
    """A stage for documents with any further columns, which keep their names, order and values."""
    @wraps(stage)
    def run_apart(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {c: c if c in OWN else f"__column_{i}" for i, c in enumerate(docs.columns)}
        out = stage(spark, docs.select(*[F.col(f"`{c}`").alias(x) for c, x in names.items()]), sf_dir)
        return out.select(*[F.col(x).alias(c) for c, x in names.items()])
    return run_apart


@apart
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; those without a letter go: null and empty texts, digits and signs only.

    The network finds a language for every other text, sure or not, and clean documents stay. Where nothing is labelled there
    is none, and every document with a letter stays. Repeated rows and null ids stay or go like others; an empty table stays
    empty. Columns pass through, also those called lang_pred or score.
    """
    ship_package(spark)
    network = language.learn(docs)
    if network is None:
        return docs.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    found = language.predict(docs, network, keep=tuple(docs.columns))
    return found.filter(F.col("lang_pred") != language.UNKNOWN).select(docs.columns)


@apart
def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one has; those that keep no line go.

    A text without repeated lines stays as it is, a null or empty one too. Order is by id, a null id first, then line number;
    rows that repeat id and text keep the same lines. n_chars counts the characters left, 0 for null. An empty table stays
    empty. Columns pass through, also those called n_lines or n_removed.
    """
    out = line_dedup.dedup_lines(docs)
    kept = out.filter(F.coalesce((F.col("n_removed") == 0) | (F.col("text") != ""), F.lit(True)))
    return kept.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(docs.columns)


@apart
def one_of_a_kind(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each class of near duplicates.

    Of rows that share an id the first by text, source and language stays. Documents with a null id stay, all of them; those
    without five words, null and empty texts are like none but those of the same words, wordless ones like none. An empty
    table stays empty. Columns pass through, also those called times or class_id.
    """
    ship_package(spark)
    classes = stored(near_dedup.near_duplicates(docs), "classes")
    kept = stored(classes.filter("doc_id = class_id").groupBy("doc_id").agg(F.count("*").alias("times")), "kept")
    ids = kept.select("doc_id", "times")
    found = docs.join(F.broadcast(ids) if small_enough(kept, F.lit(16)) else ids, "doc_id")
    again = Window.partitionBy("doc_id").orderBy("text", "source", "lang")
    twice = found.filter("times > 1").withColumn("nth", F.row_number().over(again)).filter("nth = 1")
    return (found.filter("times = 1").select(docs.columns).union(twice.select(docs.columns))
            .union(docs.filter("doc_id IS NULL").select(docs.columns)))


@apart
def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item.

    Null and empty texts have none and stay; so does everything beside an empty benchmark. A null id is judged by its text
    like others, repeated rows go together. Columns pass through, also those called text_hash or contaminated.
    """
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).filter("contaminated")
    found = stored(found.select(F.col("doc_id").alias("bad_id"), "text_hash").distinct(), "contaminated")
    bad = F.broadcast(found) if small_enough(found, F.lit(32)) else found
    same = docs["doc_id"].eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs["text"]) == bad["text_hash"])
    return docs.join(bad, same, "left_anti").select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 and decoded_sha256 of its encoding and the text decoded from it.

    A null text is encoded as an empty one, with no tokens. Each row has its row, repeated ones and null ids too; an empty
    table gives none. Other columns are not read.
    """
    ship_package(spark)
    return bpe.round_trip(docs).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("language_id", known_language), ("line_dedup", fresh_lines), ("near_dedup", one_of_a_kind),
          ("decontamination", no_benchmark), ("bpe", tokens)]

#: The network of the first stage can't be put in SQL; tests compare every stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage but the last keeps is stored as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
