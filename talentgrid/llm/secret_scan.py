"""Secrets in texts: fixed patterns, and strings in a sensitive context that zstandard cannot compress.

A candidate is a run of token characters shortly after a sensitive word. Its novelty is the number of bytes that it adds to
a zstandard frame whose dictionary holds common identifiers, the words that most texts share, and the text around the candidate
(but for its own repeats after it), divided by the bytes that random characters of its alphabet have: an identifier used nearby
or made of known words is cheap, a random key is not.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "novel")
# The base patterns, with the least size of what counts.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST = 6
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
# Words that make what follows them sensitive, and identifiers that code is full of; both are parameters' defaults.
SENSITIVE = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "api-key", "access_key", "private_key",
             "auth", "bearer", "credential", "signature", "session_id", "client_id", "connection_string", "passphrase")
IDENTIFIERS = ("username", "password", "access_token", "refresh_token", "client_secret", "client_id", "authorization", "bearer",
               "example", "default", "placeholder", "changeme", "undefined", "settings", "environment", "configuration", "config",
               "localhost", "development", "production", "staging", "application", "document", "description", "description_text",
               "getElementById", "addEventListener", "toString", "prototype", "function", "return", "import", "export", "public",
               "private", "protected", "static", "string", "integer", "boolean", "double", "vector", "namespace", "package",
               "http://www.", "https://", ".example.com", ".org/", "/usr/local/bin/", "/etc/", "README.md", "index.html",
               "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "xxxxxxxxxxxxxxxx", "0000000000000000")
# Alphabets of keys by size; a candidate is held against the first that has all its characters, or against all 66.
ALPHABETS = tuple((n, re.compile(x, re.ASCII)) for n, x in (
    (10, "[0-9=]+"), (16, "[0-9a-f=]+"), (16, "[0-9A-F=]+"), (26, "[a-z=]+"), (26, "[A-Z=]+"), (32, "[A-Z2-7=]+"), (32, "[a-z2-7=]+"),
    (36, "[A-Z0-9=]+"), (36, "[a-z0-9=]+"), (52, "[A-Za-z=]+"), (62, "[A-Za-z0-9=]+")))
CONTEXT, AROUND, LEAST, NOVELTY = 48, 1024, 16, 0.98
#: zstandard's level (higher ones parse text anew for a few more bytes), bytes of known words in each frame, and how much more
#: than their bits random characters add at 32 or fewer.
LEVEL, FILLER, SHORT = 12, 2048, 0.08
#: The learned dictionary: at most so many words, each of at least so many texts. Longer runs of letters are never words of it,
#: so a key that thousands of copies hold does not become known.
LEARNED, LEARNED_TEXTS = 3000, 5
WORD = r"(?<![A-Za-z])[A-Z]?[a-z]{3,11}(?![a-z])"


class SecretScanner:
    def __init__(self, sensitive=SENSITIVE, identifiers=IDENTIFIERS, context: int = CONTEXT, around: int = AROUND,
                 least: int = LEAST, novelty: float = NOVELTY):
        self.sensitive = sensitive
        self.before = re.compile("(?:" + "|".join(map(re.escape, sensitive)) + ")", re.IGNORECASE | re.ASCII)
        self.run = re.compile(rf"[A-Za-z0-9+/_=-]{{{least},}}")
        self.shared = " ".join(identifiers)
        self.context, self.around, self.least, self.novelty = context, around, least, novelty
        self._squeeze = None  # made in the task

    def base(self, text: str, lowered: str) -> list[tuple[int, int, str]]:
        """Spans (start, end, kind) of the base patterns: leftmost, not overlapping within a kind, in code points."""
        found = []
        if any(w in lowered for w in ASSIGN_WORDS):
            found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
        if "AKIA" in text:
            found += [(*m.span(), "access") for m in ACCESS.finditer(text)]
        return found + [(*m.span(), "hex") for m in HEX.finditer(text)]

    def _squeezed(self, text: bytes) -> int:
        if self._squeeze is None:
            words = zstandard.ZstdCompressionDict(self.shared.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters.from_level(LEVEL, window_log=18, min_match=3, write_content_size=False,
                                                                 write_checksum=False, write_dict_id=False)
            self._squeeze = zstandard.ZstdCompressor(compression_params=how, dict_data=words)
        return len(self._squeeze.compress(text))

    def added_bytes(self, candidate: str, around: str) -> int:
        """Bytes that the candidate adds to a frame of known words and the text around it, primed with all the identifiers.

        In a frame of its own a short candidate would be stored as it is, whatever its words."""
        before = f"{self.shared[-FILLER:]} {around} ".encode()
        return self._squeezed(before + candidate.encode()) - self._squeezed(before)

    def least_added(self, candidate: str) -> float:
        """What random characters add, nearly: text has other characters more often, so short keys cost more than their bits."""
        random = self.random_bytes(candidate)
        return max(self.novelty * self.least * 0.75, random * (self.novelty + SHORT * min(1.0, 32 / len(candidate))))

    def random_bytes(self, candidate: str) -> float:
        """Bytes of entropy that the candidate has if its characters are random ones of its alphabet."""
        return len(candidate) * math.log2(next((n for n, x in ALPHABETS if x.fullmatch(candidate)), 66)) / 8

    def novel(self, text: str, lowered: str, known: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        if not any(w in lowered for w in self.sensitive):
            return []
        taken = sorted(x[:2] for x in known)
        found, done = [], -1
        for word in self.before.finditer(text):
            reach = word.end() + self.context + self.least  # what begins in reach shows its least length there
            while m := self.run.search(text, max(word.end(), done), reach):
                m = self.run.match(text, m.start())
                done, s = m.end(), m[0]
                at = bisect_left(taken, (m.end(),))
                if any(a < m.end() and m.start() < b for a, b in taken[max(0, at - 3) : at]):
                    continue  # reported already
                near = text[max(0, m.start() - self.around) : m.start()] + " " + text[m.end() : m.end() + self.around].replace(s, " ")
                if self.added_bytes(s, near) >= self.least_added(s):  # a repeat costs some bytes, too
                    found.append((*m.span(), "novel"))
        return found

    def scan(self, text: str) -> list[tuple[int, int, str]]:
        """All spans by start, then kind in the order of KINDS."""
        lowered = text.lower()
        base = self.base(text, lowered)
        return sorted(base + self.novel(text, lowered, base), key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def learn_identifiers(docs: DataFrame, text_col: str = "text", most: int = LEARNED, least_texts: int = LEARNED_TEXTS) -> list[str]:
    """The words of 4 to 12 letters, as identifiers are made of, that most texts have (equal numbers: in order of the word),
    counted over all texts and rising, so that zstandard finds the commonest nearest. Null and empty texts have none."""
    words = docs.select(F.explode(F.array_distinct(F.transform(
        F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(WORD), 0), F.lower))).alias("word"))
    texts = words.groupBy("word").agg(F.count("*").alias("texts")).filter(F.col("texts") >= least_texts)
    return [r.word for r in texts.orderBy(F.desc("texts"), "word").limit(most).collect()][::-1]


def _scan(batches: Iterator[pa.RecordBatch], scanner: SecretScanner) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [[{"start": a, "end": b, "kind": k} for a, b, k in scanner.scan(x or "")] for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(pa.struct(
            [("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])))], ["id", "spans"])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scanner: SecretScanner | None = None) -> DataFrame:
    """(id_col, spans) for every row of ``docs``; spans: array of (start, end, kind), by start, then kind in the order of KINDS.

    Positions are code points, the end exclusive. A null or empty text has no spans. Repeated rows and null ids pass like
    others, an empty table gives an empty result; other columns are not read. A text is searched in one pass; a candidate costs
    two small frames. Without a ``scanner`` one is made with the words of ``learn_identifiers``.
    """
    scanner = scanner or SecretScanner(identifiers=(*learn_identifiers(docs, text_col), *IDENTIFIERS))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(partial(_scan, scanner=scanner),
                           "id long, spans array<struct<start: long, end: long, kind: string>>").withColumnRenamed("id", id_col)
