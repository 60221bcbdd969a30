"""Registered queries that run a stream over a table to its end, and their batch twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from talentgrid.plans.fixtures import Fixtures
from talentgrid.plans.registry import query
from talentgrid.session import shared_folder
from talentgrid.sources.keyed import KeyedTable
from talentgrid.streaming import feeds


def event_stream(f: Fixtures) -> DataFrame:
    schema = f.table("events").schema
    return f.spark.readStream.schema(schema).parquet(f"{f.sf_dir}/event[s].parquet")


def to_end(f: Fixtures, name: str, df: DataFrame, keys: list[str]) -> DataFrame:
    """Run the stream through everything available and return its final rows."""
    base = shared_folder(f.spark, name)
    feeds.start(df, f"{base}/out", f"{base}/ckpt", "update").awaitTermination()
    return feeds.final_rows(f.spark, f"{base}/out", keys)


_FEED = "SELECT event_type AS \"table\", strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS newest FROM events GROUP BY 1"


def _shown(df: DataFrame) -> DataFrame:
    return df.select("table", F.date_format("max_updated_at", "yyyy-MM-dd HH:mm:ss").alias("newest"))


@query("change_feed", _FEED)
def _(f):
    return _shown(feeds.change_feed(f.table("events").select(
        F.col("event_type").alias("table"), F.col("ts").alias("updated_at"))))


@query("change_feed_stream", _FEED)
def _(f):
    s = event_stream(f).select(F.col("event_type").alias("table"), F.col("ts").alias("updated_at"))
    return _shown(to_end(f, "change-feed", feeds.change_feed(s), ["table"]))


def in_batches(f: Fixtures, name: str, batch_of: Column, run) -> str:
    """Events arrive in three batches, and the stream stops and goes on between them; returns the folder of its results."""
    base = shared_folder(f.spark, name)
    events = f.table("events")
    for batch in range(3):
        events.filter(batch_of == batch).write.mode("append").parquet(f"{base}/in")
        stream = f.spark.readStream.schema(events.schema).parquet(f"{base}/in")
        run(stream, base).awaitTermination()
    return base


# every batch has earlier and later changes of the same users than the ones before it
@query("latest_stream", """
SELECT user_id, event_id, event_type, value FROM (
 SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) x WHERE rn = 1
""")
def _(f):
    table = lambda base: KeyedTable(f.spark, f"{base}/table", "user_id", buckets=16)
    base = in_batches(f, "latest", F.col("event_id") % 3, lambda s, base: feeds.latest_table(
        s, table(base), "ts", "event_id", f"{base}/ckpt"))
    return table(base).read().select("user_id", "event_id", "event_type", "value")


_DAILY = """SELECT strftime(ts, '%Y-%m-%d') AS day, """ + ", ".join(
    f"count(*) FILTER (WHERE event_type = '{n}') AS {n}_count" for n in feeds.FUNNEL_EVENTS
) + " FROM events GROUP BY 1"


@query("daily_funnel", _DAILY)
def _(f):
    return feeds.daily_funnel(f.table("events"))


_ON_TIME = "(event_id % 10 <> 3 OR date_trunc('day', ts) + INTERVAL 1 DAY > newest - INTERVAL 1 HOUR)"


# a tenth of the events comes last, when most of their days are over
@query("daily_funnel_stream", f"""
SELECT strftime(ts, '%Y-%m-%d') AS day, """ + ", ".join(
    f"count(*) FILTER (WHERE event_type = '{n}' AND {_ON_TIME}) AS {n}_count" for n in feeds.FUNNEL_EVENTS) + f""",
 count(*) FILTER (WHERE NOT {_ON_TIME}) AS late_rows
FROM events, (SELECT max(ts) AS newest FROM events WHERE event_id % 10 <> 3) x GROUP BY 1""")
def _(f):
    span = f.table("events").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    middle = span.a + (span.b - span.a) / 2
    batch_of = F.when(F.col("event_id") % 10 == 3, 2).when(F.col("ts") < F.lit(middle), 0).otherwise(1)
    base = in_batches(f, "daily-funnel", batch_of, lambda s, base: feeds.daily_funnel_tables(s, base, f"{base}/ckpt"))
    late = f.spark.read.parquet(f"{base}/late").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("late_rows"))
    counts = [f"{n}_count" for n in feeds.FUNNEL_EVENTS]
    return feeds.daily_funnel_state(f.spark, base).join(late, "day", "full").select(
        "day", *[F.coalesce(c, F.lit(0)).alias(c) for c in [*counts, "late_rows"]])
