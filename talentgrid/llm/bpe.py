"""Byte-pair encoding without a merge loop, and decoding by an offset table.

A word's tokens are found from left to right. An Aho-Corasick automaton gives the longest token that starts at each byte.
A token may follow another only if the two are compatible: encoding their joined bytes gives just these two. A chain of
compatible neighbours that covers the word is its encoding, and there is only one. Where the longest token does not fit, the
next shorter one is tried; where none fits, the last token goes and the place is marked, so each place is left at most once
and the whole takes linear time.

Two tokens are compatible if no merge ever joins what lies on either side of the seam. Going up both tokens' merge trees
along the seam, in order of rank, each pair of neighbours must be unmergeable, or its merge must come too late.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentgrid.llm.common import tokenizer_text
from talentgrid.llm.pieces import PieceEncoder

# Fixed value: the split pattern of byte-level tokenizers.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NEVER = 1 << 60
#: What a task keeps: pieces of text, words, and pairs found compatible or not; beyond it each starts afresh. Python workers
#: outlive their tasks and sit beside those of other stages, so a task makes its own codec and leaves nothing.
MAX_PIECES, MAX_WORDS, MAX_PAIRS = 500_000, 200_000, 400_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself, or the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def token_bytes(spec: dict) -> tuple[dict[int, str], dict[str, int], int]:
    """Each ordinary token's bytes as latin-1 letters, the special tokens, and the number of ids."""
    vocab, letters = spec["model"]["vocab"], byte_letters()
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    text = {i: bytes(letters[c] for c in t).decode("latin-1") for t, i in vocab.items() if t not in special}
    return text, special, max([*vocab.values(), *special.values()]) + 1


class Decoder:
    """The offset table of a tokenizer file: all tokens' bytes, and where each token's begin."""

    def __init__(self, tokenizer_json: str):
        text, special, top = token_bytes(json.loads(tokenizer_json))
        raw = [text[i].encode("latin-1") if i in text else b"" for i in range(top)]
        for content, i in special.items():
            raw[i] = content.encode()
        self.sizes = np.array([len(x) for x in raw])
        self.offsets = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)

    def decode(self, ids: bytes) -> bytes:
        """The text's UTF-8 bytes: every id's bytes gathered from the table at once."""
        ids = np.frombuffer(ids, "<u4")
        size = self.sizes[ids]
        ends = np.cumsum(size)
        if not len(ends):
            return b""
        at = np.arange(ends[-1]) + np.repeat(self.offsets[ids] - (ends - size), size)
        return self.bytes[at].tobytes()


class Codec:
    """Encoder of a byte-level BPE tokenizer file (the tokenizers library's JSON)."""

    def __init__(self, tokenizer_json: str):
        spec = json.loads(tokenizer_json)
        vocab = spec["model"]["vocab"]
        text, self.special, top = token_bytes(spec)
        self.length = [len(text.get(i, "")) for i in range(top)]
        self.rank, self.parts, self.merge = [-1] * top, [None] * top, {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = (vocab[x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            made = vocab["".join(pair.split(" ") if isinstance(pair, str) else pair)]
            if self.parts[made]:
                raise ValueError("two merges make one token: the pair table would not be exact")
            self.rank[made], self.parts[made], self.merge[a, b] = rank, (a, b), rank
        own = {t: i for i, t in text.items()}
        self.shorter = [-1] * top
        self.tokens = ahocorasick.Automaton()
        for i, t in text.items():
            self.tokens.add_word(t, i)
            self.shorter[i] = next((own[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in own), -1)
        self.tokens.make_automaton()
        self.fits: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.words = regex.compile(WORDS)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.encode = PieceEncoder(lambda strings: map(self._encode_string, strings), self.special, max_pieces=MAX_PIECES)

    def compatible(self, a: int, b: int) -> bool:
        """Whether ``b`` may follow ``a``."""
        parts, rank = self.parts, self.rank
        left, right = [a], [b]  # from the whole tokens down to the bytes beside the seam
        while parts[left[-1]]:
            left.append(parts[left[-1]][1])
        while parts[right[-1]]:
            right.append(parts[right[-1]][0])
        i, j = len(left) - 1, len(right) - 1
        while True:
            left_goes = rank[left[i - 1]] if i else NEVER
            right_goes = rank[right[j - 1]] if j else NEVER
            joins = self.merge.get((left[i], right[j]), NEVER)
            if joins < left_goes and joins <= right_goes:  # of equal merges the one further left comes first
                return False
            if left_goes == right_goes == NEVER:
                return True
            if left_goes <= right_goes:
                i -= 1
            else:
                j -= 1

    def encode_word(self, word: str) -> list[int]:
        """``word``: bytes as latin-1 letters, within which merges apply."""
        n, length, fits = len(word), self.length, self.fits
        longest = [0] * n
        for end, token in self.tokens.iter(word):
            longest[end - length[token] + 1] = token  # later ends are longer
        out: list[int] = []
        dead: set[int] = set()
        at, token = 0, longest[0]
        while True:
            end = at + length[token]
            good = end not in dead
            if good and out:
                pair = out[-1] << 32 | token
                good = fits.get(pair)
                if good is None:
                    good = fits[pair] = self.compatible(out[-1], token)
            if good:
                out.append(token)
                if end == n:
                    return out
                at, token = end, longest[end]
                continue
            token = self.shorter[token]
            while token < 0:  # nothing fits here: take the last token back
                dead.add(at)
                last = out.pop()
                at -= length[last]
                token = self.shorter[last]

    def _encode_string(self, string: str) -> bytes:
        out = []
        for i, text in enumerate(self.cut.split(string) if self.cut and any(x in string for x in self.special) else [string]):
            if i % 2:
                out.append(pack("<I", self.special[text]))
                continue
            for word in self.words.findall(text):
                ids = self.known.get(word)
                if ids is None:
                    tokens = self.encode_word(word.encode().decode("latin-1"))
                    ids = pack(f"<{len(tokens)}I", *tokens)
                    if len(word) <= 64:
                        self.known[word] = ids
                out.append(ids)
        if len(self.known) > MAX_WORDS:
            self.known.clear()
        if len(self.fits) > MAX_PAIRS:
            self.fits.clear()
        return b"".join(out)

def _encode(batches: Iterator[pa.RecordBatch], tokenizer: Broadcast) -> Iterator[pa.RecordBatch]:
    codec = Codec(tokenizer.value)
    for batch in batches:
        for at in range(0, len(batch), 256):
            rows = batch.slice(at, 256)
            ids = codec.encode([x or "" for x in rows.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(ids, pa.binary())], ["id", "ids"])
    codec.encode = None  # else the two keep each other alive until the next garbage collection


def _decode(batches: Iterator[pa.RecordBatch], tokenizer: Broadcast) -> Iterator[pa.RecordBatch]:
    decode = Decoder(tokenizer.value).decode
    for batch in batches:
        for at in range(0, len(batch), 256):
            rows = batch.slice(at, 256)
            text = [decode(x).decode("utf-8", "replace") for x in rows.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(text, pa.string())], ["id", "ids", "text"])


def _round_trip(batches: Iterator[pa.RecordBatch], tokenizer: Broadcast) -> Iterator[pa.RecordBatch]:
    return _decode(_encode(batches, tokenizer), tokenizer)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """(id_col, ids): ids as little-endian unsigned 32-bit integers, one after another, one row for each row of ``docs``.

    The ids are those of the tokenizers library without added special tokens; the string of a special token in a text is
    that token. A null or empty text has no ids. Repeated rows and null ids pass like others; other columns are not read.
    """
    tokenizer = docs.sparkSession.sparkContext.broadcast(tokenizer_text(tokenizer_path))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(partial(_encode, tokenizer=tokenizer), "id long, ids binary").withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, id_col: str = "doc_id", tokenizer_path: str | None = None) -> DataFrame:
    """(id_col, ids, text) of rows (id_col, ids); bytes that are no UTF-8 become U+FFFD. An id outside the vocabulary fails."""
    tokenizer = encoded.sparkSession.sparkContext.broadcast(tokenizer_text(tokenizer_path))
    rows = encoded.select(F.col(id_col).alias("id"), "ids")
    return rows.mapInArrow(partial(_decode, tokenizer=tokenizer), "id long, ids binary, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """``decode_documents(encode_documents(docs))`` in one Python worker a task: the ids are not sent out and in again."""
    tokenizer = docs.sparkSession.sparkContext.broadcast(tokenizer_text(tokenizer_path))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(partial(_round_trip, tokenizer=tokenizer), "id long, ids binary, text string").withColumnRenamed("id", id_col)
