"""Token files in bit planes.

A file holds the ids of a run of documents, cut into blocks of BLOCK ids. A block is transposed into byte planes (all low
bytes, all second bytes, ...) or bit planes, and each plane is a zstandard frame: high planes of small ids are nearly empty.
A footer has the chunk index (place, ids and plane sizes of each block) and the documents' ids and lengths, so one document
or block is read without the rest:

    MAGIC, planes of block 0, planes of block 1, ..., footer (zstandard), length of the footer (8 bytes), MAGIC

Files are written by tasks under names of their own; only files that a finished task has named in the manifest count, so a
task that is lost or run twice leaves no trace in the result.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talentgrid.llm.common import byte_file_system, new_folder, stored, tokenizer_text
from talentgrid.llm.pieces import worker_encoder

MAGIC, BLOCK, LEVEL = b"TGPLANE1", 1 << 16, 3
MANIFEST = "part int, file string, documents long, tokens long"


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block of 32-bit ids, low ones first."""
    rows = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "bit":
        return [x.tobytes() for x in np.packbits(np.unpackbits(rows, axis=1, bitorder="little").T, axis=1)]
    return [x.tobytes() for x in np.ascontiguousarray(rows.T)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    rows = np.stack([np.frombuffer(x, np.uint8) for x in planes])
    if kind == "bit":
        rows = np.packbits(np.unpackbits(rows, axis=1, count=n).T, axis=1, bitorder="little")
        return np.ascontiguousarray(rows).view("<u4").ravel()
    return np.ascontiguousarray(rows.T).view("<u4").ravel()


class PlaneWriter:
    def __init__(self, out, kind: str, block: int = BLOCK, level: int = LEVEL):
        self.out, self.kind, self.block, self.zip = out, kind, block, zstandard.ZstdCompressor(level=level)
        self.waiting, self.n_waiting, self.at = [], 0, len(MAGIC)
        self.chunks, self.ids, self.lengths = [], [], []
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.waiting.append(ids)
        self.n_waiting += len(ids) // 4
        if self.n_waiting >= self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.waiting), "<u4")
        end = len(ids) if last else len(ids) - len(ids) % self.block
        for i in range(0, end, self.block):
            part = ids[i : min(i + self.block, end)]
            planes = [self.zip.compress(x) for x in to_planes(part, self.kind)]
            self.chunks.append([self.at, len(part), [len(x) for x in planes]])
            for x in planes:
                self.out.write(x)
                self.at += len(x)
        self.waiting, self.n_waiting = [ids[end:].tobytes()], len(ids) - end

    def close(self) -> None:
        self._flush(True)
        footer = self.zip.compress(json.dumps({"kind": self.kind, "chunks": self.chunks, "ids": self.ids,
                                               "lengths": self.lengths}).encode())
        self.out.write(footer + len(footer).to_bytes(8, "little") + MAGIC)


class PlaneReader:
    def __init__(self, source):
        """``source``: a random-access file."""
        self.source, self.unzip = source, zstandard.ZstdDecompressor()
        source.seek(source.size() - 16)
        tail = source.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("not a token file, or an incomplete one")
        n = int.from_bytes(tail[:8], "little")
        source.seek(source.size() - 16 - n)
        self.footer = json.loads(self.unzip.decompress(source.read(n)))

    def chunk(self, i: int) -> np.ndarray:
        at, n, sizes = self.footer["chunks"][i]
        self.source.seek(at)
        data, planes = self.source.read(sum(sizes)), []
        for size in sizes:
            planes.append(self.unzip.decompress(data[:size]))
            data = data[size:]
        return from_planes(planes, n, self.footer["kind"])

    def documents(self) -> Iterator[tuple[int | None, int, int]]:
        """Id, number of ids and crc32 of each document in order; one block is held at a time."""
        i, block = 0, memoryview(b"")
        for doc_id, length in zip(self.footer["ids"], self.footer["lengths"]):
            crc, left = 0, 4 * length
            while left:
                if not block:
                    block, i = memoryview(self.chunk(i).tobytes()), i + 1
                crc = zlib.crc32(block[:left], crc)
                left, block = left - min(left, len(block)), block[left:]
            yield doc_id, length, crc


def _write(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: Broadcast, end_id: int, kind: str) -> Iterator[pa.RecordBatch]:
    encode, end = worker_encoder(tokenizer.value), end_id.to_bytes(4, "little")
    files, base = byte_file_system(folder)
    writer = name = None
    part = TaskContext.get().partitionId()
    for batch in batches:
        for at in range(0, len(batch), 256):
            rows = batch.slice(at, 256)
            if writer is None and len(rows):
                name = f"part-{part:06d}-{uuid.uuid4().hex}.planes"
                files.create_dir(base, recursive=True)
                out = files.open_output_stream(f"{base}/{name}")
                writer = PlaneWriter(out, kind)
            for doc_id, ids in zip(rows.column(0).to_pylist(), encode([x or "" for x in rows.column(1).to_pylist()])):
                writer.add(doc_id, ids + end)
    if writer is not None:
        writer.close()
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]),
                                          pa.array([len(writer.ids)], pa.int64()), pa.array([sum(writer.lengths)], pa.int64())],
                                         ["part", "file", "documents", "tokens"])


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    files, base = byte_file_system(folder)
    for batch in batches:
        for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            with files.open_input_file(f"{base}/{name}") as source:
                rows = list(PlaneReader(source).documents())
            n = np.array([x[1] for x in rows], np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array([x[0] for x in rows], pa.int64()), pa.array(start + np.cumsum(n) - n), pa.array(n),
                pa.array([x[2] for x in rows], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str | None = None, end_id: int = 0,
                      id_col: str = "doc_id", text_col: str = "text", kind: str = "byte") -> DataFrame:
    """Encode ``docs`` in ascending id order into token files under ``folder``; returns the manifest (part, file, documents, tokens).

    A null text is written as an empty one; every document ends with ``end_id``. A null id comes first; rows of one id
    follow each other by text, repeated ones too. An empty table writes no file. Other columns are not read.
    """
    spark = docs.sparkSession
    tokenizer = spark.sparkContext.broadcast(tokenizer_text(tokenizer_path))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "text")
    return stored(rows.mapInArrow(partial(_write, folder=folder, tokenizer=tokenizer, end_id=end_id, kind=kind), MANIFEST),
                  "manifest")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files; start counts the ids of all documents before it."""
    before = F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("file", F.coalesce(before, F.lit(0)).alias("start"))
    return files.repartition(max(1, manifest.count())).mapInArrow(
        partial(_read, folder=folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_digest(docs: DataFrame) -> DataFrame:
    folder = new_folder(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, folder), folder)
