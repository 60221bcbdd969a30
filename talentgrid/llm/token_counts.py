"""Tokens of each document in flat token files that have no index.

A flat file is a run of 16- or 32-bit ids, an end-of-document id after each document. Files are cut into blocks of
BLOCK_BYTES; a task finds a block's separators with one vectorised comparison and reports the lengths between them, the
tokens before the first (the head, counted as the first length) and after the last (the tail). A prefix scan over the
blocks of each file, one narrow row each, gives every block the documents before it and the tokens that its first document
had in the blocks before.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talentgrid.llm.common import byte_file_system, new_folder, stored, tokenizer_text
from talentgrid.llm.pieces import worker_encoder

BLOCK_BYTES = 4 << 20
SCAN = "file string, block long, separators long, tail long, lengths array<long>"


def _write(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: Broadcast, end_id: int, width: int) -> Iterator[pa.RecordBatch]:
    encode, kind = worker_encoder(tokenizer.value, True), f"<u{width}"
    files, base = byte_file_system(folder)
    out, n, name = None, 0, f"part-{uuid.uuid4().hex}.ids"
    for batch in batches:
        for at in range(0, len(batch), 256):
            rows = batch.slice(at, 256)
            if not len(rows):
                continue
            if out is None:
                files.create_dir(base, recursive=True)
                out = files.open_output_stream(f"{base}/{name}")
            end = end_id.to_bytes(4, "little")
            encoded = encode([x or "" for x in rows.column(1).to_pylist()])
            own = np.frombuffer(b"".join(encoded), "<u4")
            if int(own.max(initial=end_id)) >= 1 << 8 * width:
                raise ValueError(f"ids of {width} bytes are too narrow for this tokenizer's")
            if (own == end_id).any():
                raise ValueError(f"{end_id} is an id of ordinary text and can't end documents")
            out.write(np.frombuffer(b"".join(x + end for x in encoded), "<u4").astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([name] * len(rows)),
                                              pa.array(np.arange(n, n + len(rows)))], ["doc_id", "file", "nth"])
            n += len(rows)
    if out is not None:
        out.close()


def write_flat_files(docs: DataFrame, folder: str, end_id: int = 50256, width: int = 2, tokenizer_path: str | None = None,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write flat token files under ``folder``, one for each task; returns which document is where (doc_id, file, nth).

    The strings of special tokens are encoded as ordinary text, so ``end_id`` only ends documents; where a text has it all the
    same, or an id that ``width`` bytes (2 or 4) can't hold, the write fails. A null text is empty. Null ids and repeated rows
    are documents of their own. An empty table gives no file and no row. Other columns are not read.
    """
    tokenizer = docs.sparkSession.sparkContext.broadcast(tokenizer_text(tokenizer_path))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return stored(rows.mapInArrow(partial(_write, folder=folder, tokenizer=tokenizer, end_id=end_id, width=width),
                                  "doc_id long, file string, nth long"), "flat-listing")


def _blocks(batches: Iterator[pa.RecordBatch], folder: str, block_bytes: int) -> Iterator[pa.RecordBatch]:
    files, base = byte_file_system(folder)
    for batch in batches:
        for name in batch.column(0).to_pylist():
            n = -(-files.get_file_info(f"{base}/{name}").size // block_bytes)
            yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(np.arange(n))], ["file", "block"])


def scan_block(ids: np.ndarray, end_id: int) -> tuple[int, int, np.ndarray]:
    """Separators, tokens after the last one, and the tokens before each one since the one before."""
    ends = np.flatnonzero(ids == end_id)
    lengths = np.diff(ends, prepend=-1) - 1
    return len(ends), len(ids) - (int(ends[-1]) + 1 if len(ends) else 0), lengths


def _scan(batches: Iterator[pa.RecordBatch], folder: str, block_bytes: int, end_id: int, width: int) -> Iterator[pa.RecordBatch]:
    files, base = byte_file_system(folder)
    for batch in batches:
        for name, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            with files.open_input_file(f"{base}/{name}") as f:
                f.seek(block * block_bytes)
                found = scan_block(np.frombuffer(f.read(block_bytes), f"<u{width}"), end_id)
            yield pa.RecordBatch.from_arrays([
                pa.array([name]), pa.array([block]), pa.array([found[0]]), pa.array([found[1]]),
                pa.array([found[2]], pa.list_(pa.int64()))], ["file", "block", "separators", "tail", "lengths"])


def count_tokens(names: DataFrame, folder: str, end_id: int = 50256, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, nth, n_tokens) of the nth document of each flat file in ``names`` (file); separators are not counted.

    A document may be empty or reach over many blocks. Ids after a file's last separator belong to no document. A file
    without bytes has none. ``block_bytes`` is a multiple of ``width``.
    """
    blocks = stored(names.select("file").distinct().mapInArrow(
        partial(_blocks, folder=folder, block_bytes=block_bytes), "file string, block long"), "blocks")
    found = stored(blocks.repartition(max(1, blocks.count())).mapInArrow(
        partial(_scan, folder=folder, block_bytes=block_bytes, end_id=end_id, width=width), SCAN), "block-scan")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("block")
    scan = (found.select("file", "block", "separators", "tail")
            .withColumn("first", F.coalesce(F.sum("separators").over(before), F.lit(0)))
            .withColumn("run", F.sum((F.col("separators") > 0).cast("long")).over(upto))
            .withColumn("open", F.sum("tail").over(Window.partitionBy("file", "run").orderBy("block")))
            .withColumn("carried", F.coalesce(F.lag("open").over(upto), F.lit(0))))
    return (found.select("file", "block", F.posexplode("lengths").alias("at", "length"))
            .join(scan.select("file", "block", "first", "carried"), ["file", "block"])
            .select("file", (F.col("first") + F.col("at")).alias("nth"),
                    (F.col("length") + F.when(F.col("at") == 0, F.col("carried")).otherwise(0)).alias("n_tokens")))


def document_token_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens) of every row of ``docs``, by way of flat files in the shared folder."""
    folder = new_folder(docs.sparkSession, "flat-tokens")
    listing = write_flat_files(docs, folder)
    return listing.join(count_tokens(listing, folder), ["file", "nth"]).select("doc_id", "n_tokens")
