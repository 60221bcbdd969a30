"""Streams run to their end give what the batch operators give."""

import datetime as dt

from talentgrid.operators import dedup
from talentgrid.plans import load_all
from talentgrid.sources.keyed import KeyedTable
from talentgrid.streaming import feeds
from tests.test_dedup import best_of, brute, people, table
from tests.conftest import SF


def same(a, b):
    cols = sorted(a.columns)
    return sorted(map(tuple, a.select(cols).collect())) == sorted(map(tuple, b.select(cols).collect()))


def test_stream_equals_batch(spark):
    q = load_all().QUERIES
    for stream, batch in (("change_feed_stream", "change_feed"), ("latest_stream", "latest_version")):
        assert same(q[stream](spark, SF), q[batch](spark, SF)), stream


def test_replays_are_dropped(spark, tmp_path, fx):
    e = fx.table("events")
    for i in range(2):
        e.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    out = feeds.latest_stream(s, "user_id", "ts", "event_id", replay_window="365 days")
    feeds.start(out, str(tmp_path / "out"), str(tmp_path / "ckpt"), "update").awaitTermination()
    got = feeds.final_rows(spark, str(tmp_path / "out"), ["user_id"])
    assert got.count() == e.select("user_id").distinct().count()


def test_dedup_stream(spark, tmp_path):
    df = table(spark, people(120, 9)).cache()
    known, arriving = df.filter("id <= 80"), df.filter("id > 80")
    arriving.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    feeds.dedup_stream(s, lambda: known, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    got = {r.id: (r.duplicate_id, r.similarity) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == best_of({k: v for k, v in brute(df).items() if k[1] < k[0] and k[0] > 80})
    assert dedup.BLOCK > 0


def run_batches(spark, tmp_path, batches, schema, run):
    """The stream stops and goes on between batches."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).awaitTermination()


def test_latest_table_takes_changes_out_of_order_and_again(spark, tmp_path):
    batches = [[(1, 5, 1, "a"), (2, 1, 1, "b"), (None, 1, 1, "null key")], [(1, 4, 9, "older"), (2, 3, 1, "c"), (3, 1, 1, "d")],
               [(2, 3, 2, "tie"), (1, 5, 1, "a"), (2, 2, 7, "older")]]
    table = KeyedTable(spark, str(tmp_path / "t"), "k", buckets=4)
    ckpt = str(tmp_path / "ckpt")
    run_batches(spark, tmp_path, batches, "k int, ts int, n int, v string", lambda s: feeds.latest_table(s, table, "ts", "n", ckpt))
    want = {(1, 5, 1, "a"), (2, 3, 2, "tie"), (3, 1, 1, "d"), (None, 1, 1, "null key")}
    assert {tuple(r) for r in table.read().collect()} == want and table.read().count() == 4
    # a replay of everything, into the same table
    run_batches(spark, tmp_path / "again", batches, "k int, ts int, n int, v string",
                lambda s: feeds.latest_table(s, table, "ts", "n", ckpt + "2"))
    assert {tuple(r) for r in table.read().collect()} == want and table.read().count() == 4


def test_late_events_are_kept_apart(spark, tmp_path):
    t = lambda day, hour: dt.datetime(2024, 1, day, hour)
    batches = [[(t(1, 10), "view"), (t(2, 1), "click"), (t(1, 11), "view")],
               [(t(1, 12), "view"), (None, "view"), (t(3, 0), "signup"), (t(2, 2), "click")],  # day 1 is over by an hour: late
               [(t(2, 3), "view"), (t(3, 5), "view")]]  # day 2 ended at 3, 0:00, and not an hour before
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    run_batches(spark, tmp_path, batches, "ts timestamp, event_type string", lambda s: feeds.daily_funnel_tables(s, out, ckpt))
    got = {r.day: (r.view_count, r.click_count, r.signup_count, r.purchase_count) for r in feeds.daily_funnel_state(spark, out).collect()}
    assert got == {"2024-01-01": (2, 0, 0, 0), "2024-01-02": (1, 2, 0, 0), "2024-01-03": (1, 0, 1, 0)}
    late = spark.read.parquet(out + "/late").collect()
    assert sorted((str(r.ts), r.batch) for r in late) == [("2024-01-01 12:00:00", 1), ("None", 1)]
    seen = {r.batch: (r["rows"], r.late_rows) for r in spark.read.parquet(out + "/batches").collect()}
    assert seen == {0: (3, 0), 1: (4, 2), 2: (2, 0)}


def test_indexed_dedup_stream_over_batches_and_a_replay(spark, tmp_path):
    df = table(spark, people(120, 9)).cache()
    index = dedup.ProfileIndex(spark, str(tmp_path / "index"), buckets=8)
    parts = [df.filter("id <= 50"), df.filter("id > 50 AND id <= 90"), df.filter("id > 90")]
    for n, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        feeds.indexed_dedup_stream(s, index, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    found = {r.id: (r.duplicate_id, r.similarity) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == best_of({k: v for k, v in brute(df).items() if k[1] < k[0]})
    rows = dedup.profile(parts[2])  # the last batch once more, after it was added
    again = {r.id: (r.duplicate_id, r.similarity) for r in index.best_earlier(rows).collect()}
    assert again == {i: v for i, v in found.items() if i > 90}
    one = dedup.profile(df.filter("id = 120"))
    read = index.keys.read(index.keys.touched(dedup.equality_keys(one, "l")))
    assert len(read.inputFiles()) < len(index.keys.read().inputFiles())
