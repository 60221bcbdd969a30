"""Structured Streaming forms: ingest, duplicate check, change feed, latest state, live funnel.

Every sink leaves the same result when a batch is replayed after a lost executor or driver: it writes
one folder per micro-batch and overwrites it, or rewrites the buckets of a keyed table, whose last
write per key is the same however often it is applied.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from talentgrid.operators import dedup, extraction
from talentgrid.operators.maintain import latest_version
from talentgrid.session import cut_lineage
from talentgrid.sources.documents import docx_text, eligible
from talentgrid.sources.keyed import KeyedTable

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def start(df: DataFrame, out_path: str, ckpt: str, mode: str = "append",
          transform: Callable[[DataFrame], DataFrame] | None = None,
          every: str | None = None) -> StreamingQuery:
    """Write each micro-batch to ``out_path/batch=<id>``; once over, or every interval."""
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = transform(batch) if transform else batch
        rows.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    writer = (df.writeStream.outputMode(mode).option("checkpointLocation", ckpt)
              .foreachBatch(write))
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()


def final_rows(spark: SparkSession, out_path: str, keys: list[str]) -> DataFrame:
    """Result of an update-mode sink: per key the row of the latest batch."""
    df = spark.read.parquet(out_path)
    if len(keys) > 1:
        df = df.withColumn("_k", F.struct(*keys))
        return latest_version(df, "_k", "batch", "batch").drop("_k", "batch")
    return latest_version(df, keys[0], "batch", "batch").drop("batch")


def process_files(files: DataFrame, as_of_year: int) -> DataFrame:
    """One row per file with status, message and extracted columns.

    Rejected and unreadable files are rows with ``failed``; a bad file never
    stops the others.  Every file is read and decoded once.
    """
    files = files.withColumn("accepted", eligible(F.col("path"), F.col("length")))
    texts = docx_text(files, rejected="不支持的文件格式或文件过大")
    texts = texts.withColumn("key", F.struct("path", "error"))
    found = extraction.extract_all(texts, as_of_year, key="key")
    ok = F.col("key.error").isNull()
    return found.select("key.path", *[F.when(ok, F.col(c)).alias(c) for c in found.columns if c != "key"],
                        F.when(ok, "success").otherwise("failed").alias("parse_status"),
                        F.col("key.error").alias("error_message"))


def ingest_stream(spark: SparkSession, in_path: str, out_path: str, ckpt: str, as_of_year: int,
                  every: str | None = None, max_files: int = 1000) -> StreamingQuery:
    """Files that appear under ``in_path`` become candidate rows under ``out_path``."""
    files = (spark.readStream.format("binaryFile").schema(BINARY_FILE)
             .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files)
             .load(in_path))
    return start(files, out_path, ckpt, "append", lambda b: process_files(b, as_of_year), every)


def dedup_stream(stream: DataFrame, existing: Callable[[], DataFrame], out_path: str, ckpt: str,
                 threshold: float = 80.0, every: str | None = None) -> StreamingQuery:
    """Best earlier résumé of each arriving one: batch × table and batch × batch.

    ``existing`` returns the current table; earlier batches of this stream must
    be part of it, as the ingest writes them there first.
    """
    return start(stream, out_path, ckpt, "append",
                 lambda b: dedup.dedup_batch(b, existing(), threshold), every)


def indexed_dedup_stream(stream: DataFrame, index: dedup.ProfileIndex, out_path: str, ckpt: str,
                         threshold: float = 80.0, every: str | None = None) -> StreamingQuery:
    """As ``dedup_stream``, against an index that each batch is added to; no batch profiles the table."""
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = cut_lineage(dedup.profile(batch))
        index.best_earlier(rows, threshold).write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
        index.add(rows, f"batch-{batch_id}")

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.option("checkpointLocation", ckpt).foreachBatch(write).trigger(**trigger).start()


def change_feed(changes: DataFrame, table: str = "table", ts: str = "updated_at") -> DataFrame:
    """``table, max_updated_at``: newest change per table, of a stream or a batch."""
    return changes.groupBy(table).agg(F.max(F.col(ts).cast("timestamp")).alias("max_updated_at"))


def latest_stream(changes: DataFrame, key: str, ts: str, tie: str,
                  replay_window: str | None = None) -> DataFrame:
    """Latest row per key; the state holds one row per key.

    With ``replay_window`` exact replays of a change inside it are dropped first
    by (key, tie), which keeps their rows out of the aggregate altogether.
    """
    if changes.isStreaming and replay_window:
        changes = (changes.withColumn(ts, F.col(ts).cast("timestamp"))
                   .withWatermark(ts, replay_window).dropDuplicatesWithinWatermark([key, tie]))
    return latest_version(changes, key, ts, tie)


def latest_table(changes: DataFrame, table: KeyedTable, ts: str, tie: str, ckpt: str,
                 every: str | None = None) -> StreamingQuery:
    """Keep the latest row per key of a stream of changes in a keyed table, by (``ts``, ``tie``).

    A batch rewrites the buckets of its keys and no others, so the table holds one row per key and neither
    grows with the history nor needs it; changes may come out of order, and again.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        newest = cut_lineage(latest_version(batch, table.key, ts, tie))
        if not table.exists():
            table.append(newest, f"batch-{batch_id}")
        else:
            table.merge(newest, lambda old, new: latest_version(old.unionByName(new), table.key, ts, tie))

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return changes.writeStream.option("checkpointLocation", ckpt).foreachBatch(write).trigger(**trigger).start()


FUNNEL_EVENTS = ["view", "click", "signup", "purchase"]


def _stage_counts() -> list[Column]:
    return [F.count(F.when(F.col("event_type") == n, 1)).alias(f"{n}_count") for n in FUNNEL_EVENTS]


def daily_funnel_tables(events: DataFrame, out_path: str, ckpt: str, late: str = "1 hour",
                        every: str | None = None) -> StreamingQuery:
    """Counts of each stage per day under ``out_path/counts``, what came too late for them under ``out_path/late``.

    As with a watermark, a batch counts no event of a day that was over ``late`` before the newest event of the
    earlier batches. Such events are kept as rows of ``late``, and ``out_path/batches`` has a row for each batch:
    rows, late_rows, and newest (its newest event). Events without a time are late. Each batch writes its own
    folders, and what is late depends on earlier batches only, so a replay changes nothing.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        e = batch.withColumn("ts", F.col("ts").cast("timestamp"))
        newest = None
        if batch_id > 0:
            earlier = spark.read.schema(_BATCHES).parquet(f"{out_path}/batches")
            newest = earlier.filter(F.col("batch") < batch_id).agg(F.max("newest").alias("t")).first().t
        over = F.timestamp_seconds((F.floor(F.unix_timestamp("ts") / 86400) + 1) * 86400)  # a window would drop rows without a time
        fits = F.col("ts").isNotNull()
        if newest is not None:
            fits &= over > F.lit(newest) - F.expr(f"INTERVAL {late}")
        seen = Observation(f"batch-{batch_id}")
        e = e.withColumn("_fits", F.coalesce(fits, F.lit(False))).observe(
            seen, F.count(F.lit(1)).alias("rows"), F.count(F.when(~F.col("_fits"), 1)).alias("late_rows"), F.max("ts").alias("newest"))
        e.filter(~F.col("_fits")).drop("_fits").write.mode("overwrite").parquet(f"{out_path}/late/batch={batch_id}")
        counts = e.filter("_fits").groupBy(F.window("ts", "1 day").getField("start").alias("day")).agg(*_stage_counts())
        counts.write.mode("overwrite").parquet(f"{out_path}/counts/batch={batch_id}")
        m = seen.get
        spark.createDataFrame([(m["rows"], m["late_rows"], m["newest"])], _BATCHES.removeprefix("batch long, ")).coalesce(
            1).write.mode("overwrite").parquet(f"{out_path}/batches/batch={batch_id}")

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return events.writeStream.option("checkpointLocation", ckpt).foreachBatch(write).trigger(**trigger).start()


_BATCHES = "batch long, rows long, late_rows long, newest timestamp"


def daily_funnel_state(spark: SparkSession, out_path: str) -> DataFrame:
    """``day`` and the counts of each stage so far: the batches' counts, added up."""
    rows = spark.read.parquet(f"{out_path}/counts").groupBy("day").agg(
        *[F.sum(f"{n}_count").alias(f"{n}_count") for n in FUNNEL_EVENTS])
    return rows.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def daily_funnel(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Counts of each stage per day, of a stream or a batch."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        e = e.withWatermark("ts", late)
    day = F.window("ts", "1 day")
    counts = _stage_counts()
    out = e.groupBy(day.alias("w")).agg(*counts)
    return out.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"),
                      *[f"{n}_count" for n in FUNNEL_EVENTS])
