"""Session defaults and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "talentgrid", cores: str | int = "*",
                shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Local session for tests and benchmarks; on a cluster pass your own.

    AQE stays on: it turns joins into broadcasts from measured sizes, splits
    skewed partitions and merges small ones.
    """
    n = os.cpu_count() if cores == "*" else int(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # test tables are small: keep all local cores busy, also where a table is one small file
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.files.maxPartitionBytes", "4m").config("spark.sql.files.openCostInBytes", "64k")
        .config("spark.sql.files.minPartitionNum", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        # no call-site capture per column expression: building large plans is faster
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    spark = builder.getOrCreate()
    use_scratch_folder(spark)
    return spark


_scratch: dict[str, str] = {}


def use_scratch_folder(spark: SparkSession) -> None:
    """Let a local session without ``spark.checkpoint.dir`` use a scratch folder of this machine; no other session may."""
    if spark.sparkContext.master.startswith("local[") and spark.conf.get("spark.checkpoint.dir", None) is None:
        app = spark.sparkContext.applicationId
        if app not in _scratch:
            _scratch[app] = "file://" + tempfile.mkdtemp(prefix="spark-")


def shared_base(spark: SparkSession) -> str:
    """The folder every executor reaches: ``spark.checkpoint.dir``, or what ``use_scratch_folder`` chose."""
    base = spark.conf.get("spark.checkpoint.dir", None) or _scratch.get(spark.sparkContext.applicationId)
    if base is None:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return base.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Store ``df`` in the shared folder with ``checkpoint()`` and go on from there."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_base(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Like ``cut_lineage``, as compressed Parquet in a new folder whose size the planner knows."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over the configured number of tasks, before work that costs far more than its bytes suggest.

    A small file is one task however long its rows take, and AQE merges by bytes.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for stream state and sinks, in the shared folder."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"
