"""The corpus operators as named queries over the driver's tables, with their SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentgrid.llm import (bpe, collocations, decontaminate, language, line_dedup, mixture, near_dedup, passages, ranked_search,
                            secret_scan, token_counts, token_files, twins, vantage)
from talentgrid.llm.common import ship_package, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return f(spark, sf_dir)
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run
    return add


@query("op1_order_minhash")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op2_bit_planes")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_digest(table(spark, sf_dir, "documents"))


@query("op3_zstd_novelty")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    kind = lambda k: F.filter("spans", lambda x: x["kind"] == k)
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    counts = [F.size(kind(k)).cast("long").alias(f"n_{k}") for k in secret_scan.KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(F.filter("spans", lambda x: x["kind"] != "novel")), 256).alias("base_sha256"),
                        listed(F.col("spans")).alias("spans"))


@query("op4_vantage_tree")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vantage.nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


@query("op5_backtracking_bpe")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents")).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


@query("op6_prefix_filter", twins.CONTAMINATION)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("items_sha256", F.sha2(F.array_join("item_ids", ","), 256)).drop("item_ids", "text_hash")


@query("op7_paragraph_minhash")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


@query("op8_separator_scan")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.document_token_counts(table(spark, sf_dir, "documents"))


@query("op9_deletion_neighbours", twins.LINES)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_removed", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("op10_byte_cnn")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "text", "lang", language.held_out(F.col("doc_id")).alias("held_out"))
    return language.predict(docs, language.learn(docs), keep=("doc_id", "held_out"))


@query("op11_norm_buckets", twins.RANKED)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_phrase_growth", twins.PHRASES)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query("op13_source_schedule", twins.MIXTURE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mixture_counts(table(spark, sf_dir, "documents")).drop("source")
