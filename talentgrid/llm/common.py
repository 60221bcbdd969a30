"""What the corpus operators share: the cluster's shared folder, stored steps, word hashing in numpy, tokenizer files."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one numpy step takes at once; a longer text is a step of its own.
STEP_BYTES = 1 << 21
BATCH_ROWS = 1000
#: Words are runs of digits, ASCII letters (lower-cased) and bytes of non-ASCII characters; 0 separates.
_WORD = np.zeros(256, np.uint8)
_WORD[np.r_[48:58, 97:123, 128:256]] = np.r_[48:58, 97:123, 128:256]
_WORD[65:91] = np.arange(97, 123)
_ODD = 0x9E3779B97F4A7C15
_ODD_INVERSE = pow(_ODD, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


_shipped: set[str] = set()
_scratch: dict[str, str] = {}  # of local sessions, by application


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of every executor, once for each application.

    Rows that hold whole texts go to them by at most BATCH_ROWS: Spark's 10,000 may be hundreds of MB on either side.
    """
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows, "10000")) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    if spark.sparkContext.applicationId not in _shipped:
        import shutil
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        base = os.path.join(tempfile.mkdtemp(prefix="spark-package-"), "talentgrid")
        spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", root, "talentgrid"))
        _shipped.add(spark.sparkContext.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor reaches: ``spark.checkpoint.dir``; a local session without it gets one of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        base = _scratch.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="spark-")
        _scratch[spark.sparkContext.applicationId] = base
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it from there: the plan before it is neither kept nor run again."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly; one for each seed."""
    h = h ^ np.uint64((seed * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, STEP_BYTES + 1)
        for k, base in enumerate((_ODD, _ODD_INVERSE)):
            step = np.full(n, base, np.uint64)
            step[0] = 1
            _powers[k] = np.cumprod(step, dtype=np.uint64)
    return _powers[0], _powers[1]


class Words:
    """The words of a run of texts: 64-bit hashes, and where each text's words begin (``first`` has one entry more)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray = _WORD):
        """``data``: UTF-8 bytes of all texts; text i has those from offsets[i] to offsets[i+1]. ``table``: 0 for bytes between
        words, what counts of the others."""
        low = table[data]
        is_word = low != 0
        before = np.empty(len(low), bool)
        after = np.empty(len(low), bool)
        if len(low):
            before[0], before[1:] = False, is_word[:-1]
            after[-1], after[:-1] = False, is_word[1:]
            inner = offsets[(offsets > 0) & (offsets < len(low))]
            before[inner] = False
            after[inner - 1] = False
        self.starts = np.flatnonzero(is_word & ~before)
        self.ends = np.flatnonzero(is_word & ~after) + 1
        power, inverse = _power_tables(len(low) + 1)
        total = np.zeros(len(low) + 1, np.uint64)
        np.cumsum(low * power[: len(low)], dtype=np.uint64, out=total[1:])
        self.hashes = mix((total[self.ends] - total[self.starts]) * inverse[self.starts])
        self.first = np.searchsorted(self.starts, offsets)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether they all lie in that word's text."""
        n = len(self.hashes)
        h = np.zeros(n, np.uint64)
        for j in range(min(k, n)):
            h[: n - j] = h[: n - j] * np.uint64(0xFF51AFD7ED558CCD) + self.hashes[j:]
        last = np.repeat(self.first[1:], np.diff(self.first))
        return mix(h), np.arange(n) + k <= last


def text_steps(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about STEP_BYTES: from row, to row, their bytes, their offsets (a null has no bytes)."""
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + STEP_BYTES, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def tokenizer_text(path: str | None = None) -> str:
    """The tokenizer file's text, read on the driver and sent to the tasks: its size does not depend on the data."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def byte_file_system(uri: str):
    """pyarrow's file system for a shared folder's URI, and the path in it; works on executors."""
    from pyarrow import fs
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), os.path.abspath(uri))


def small_enough(df: DataFrame, bytes_of_row, bound: int = 32 << 20) -> bool:
    """Whether a stored table's rows have at most ``bound`` bytes in all, by counting them: such a table may be broadcast."""
    from pyspark.sql import functions as F
    return (df.agg(F.sum(bytes_of_row)).first()[0] or 0) <= bound
