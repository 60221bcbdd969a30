"""Phrases whose words belong together, the best of each language, by best-first growth.

A phrase of a words is scored by its weakest cut: 2 a / (l + r) in millionths, l and r the counts of the two parts. A phrase
grows word by word from its beginning. Every longer phrase that begins with p occurs at most f(p) times and its first cut
leaves at least the first word's count to the left, so its score is at most 2 f(p) / (f(first word) + f(p)): prefix counts
bound what is still to be found. Growth goes by falling bound, in rounds:

* a round's bound, one for each language, is the score of the 2000th best phrase known so far (then the 8000th, ...);
* phrases whose bound reaches it are expanded, and so are those that other counts hang on: the ends of expanded phrases (for
  the right part of a cut), and what may stand before a good phrase (a longer one of nearly its count drops it);
* when nothing is left to expand, all phrases of that score or more are known, and it is settled which of them stay. A
  language with 2000 of them is done; ties are among them.

Expanding is a scan of the texts that counts the phrases one word longer than an expanded one. Tasks hold a bit table of the
frequent words and one of the expanded phrases, of a size that does not grow with the data: a chance hit costs a row, not a
wrong count. Words are 64-bit hashes of language and word; the words of the result are read from the texts again at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentgrid.llm.common import Words, mix, small_enough, stored, text_steps

LEAST, LONGEST, TOP, DROP_PERCENT = 30, 4, 2000, 80
TABLE_BITS, FLUSH_ROWS = 23, 1 << 21
UNKNOWN = "und"
# Blanks between words, and what ends a piece of text; A-Z are lower-cased.
_BLANKS, _ENDS = b" \t", b".,;:!?\n\x0b\x0c\r"
_WORD = np.array([0 if c in _BLANKS + _ENDS else 1 + (c + 32 if 65 <= c <= 90 else c) for c in range(256)], np.uint16)
_END = np.array([c in _ENDS for c in range(256)])


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return x << np.uint64(bits) | x >> np.uint64(64 - bits) if bits else x


def _slot(words: list[np.ndarray]) -> np.ndarray:
    """One number for several words in order; ``_slot_column`` is the same of an array column."""
    return reduce(np.bitwise_xor, [_turned(w, 13 * i % 64) for i, w in enumerate(words)])


def _slot_column(phrase: Column, size: int) -> Column:
    out = phrase[0]
    for i in range(1, size):
        bits = 13 * i % 64
        out = out.bitwiseXOR(F.shiftleft(phrase[i], bits).bitwiseOR(F.shiftrightunsigned(phrase[i], 64 - bits)))
    return out


class BitTable:
    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(len(words) * 64 - 1)

    @classmethod
    def of(cls, slots: DataFrame, bits: int) -> BitTable:
        """From a column ``slot``; what comes to the driver is the table, whatever the number of rows."""
        at = F.col("slot").bitwiseAND(F.lit((1 << bits) - 1))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
        rows = slots.select(F.shiftright(at, 6).alias("at"), bit.alias("bit"))
        rows = rows.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
        words = np.zeros(1 << (bits - 6), np.uint64)
        words[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
        return cls(words)

    def has(self, slot: np.ndarray) -> np.ndarray:
        slot = slot & self.mask
        return (self.words[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def _steps(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, Words, np.ndarray, list]]:
    """Of runs of texts: each word's number, the piece it is in, the words, their language's place in the list, the bytes."""
    langs = batch.column(0).dictionary_encode()
    codes, names = np.asarray(langs.indices), langs.dictionary.to_pylist()
    own = np.array([int.from_bytes(blake2b(x.encode(), digest_size=8).digest(), "little") for x in names], np.uint64)
    for i, j, data, offsets in text_steps(batch.column(1)):
        words = Words(data, offsets, _WORD)
        text = np.repeat(np.arange(j - i), np.diff(words.first))
        code = codes[i:j][text]
        piece = np.cumsum(_END[data])[words.starts] + text
        yield mix(words.hashes ^ own[code]), piece, words, code, [names, data]


def _merged(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows and how often they occur."""
    order = np.argsort(_slot(columns))
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = reduce(np.logical_or, [c[1:] != c[:-1] for c in columns])
    begin = np.flatnonzero(new)
    return [c[begin] for c in columns], np.diff(np.append(begin, len(order)))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, f)."""
    known: dict[str, int] = {}
    kept, rows = [], 0

    def flush():
        (word, lang), times = _merged([np.concatenate(c) for c in zip(*kept)])
        kept.clear()
        names = pa.DictionaryArray.from_arrays(pa.array(lang.astype(np.int32)), pa.array(list(known))).cast(pa.string())
        return pa.RecordBatch.from_arrays([names, pa.array(word.view(np.int64)), pa.array(times)], ["lang", "word", "f"])

    for batch in batches:
        for word, _, _, code, (names, _) in _steps(batch):
            own = np.array([known.setdefault(x, len(known)) for x in names], np.uint64)
            kept.append([word, own[code]])
            rows += len(word)
            if rows >= FLUSH_ROWS:
                yield flush()
                rows = 0
    if kept:
        yield flush()


def _phrases(batches: Iterator[pa.RecordBatch], frequent: BitTable, nodes: dict[int, BitTable]) -> Iterator[pa.RecordBatch]:
    """(phrase, f): counts of the phrases of frequent words that are one word longer than a node; all of two words for no nodes."""
    kept, rows = {}, 0
    sizes = sorted(nodes) or [1]

    def flush():
        for size, parts in kept.items():
            columns, times = _merged([np.concatenate(c) for c in zip(*parts)])
            flat = np.stack(columns, 1).ravel().view(np.int64)
            offsets = np.arange(0, len(flat) + 1, size + 1, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(times)], ["phrase", "f"])
        kept.clear()

    for batch in batches:
        for word, piece, *_ in _steps(batch):
            often = frequent.has(word)
            for size in sizes:
                n = len(word) - size
                if n <= 0:
                    continue
                good = piece[:n] == piece[size:]
                for i in range(size + 1):
                    good &= often[i : n + i]
                at = np.flatnonzero(good)
                if size in nodes and len(at):
                    at = at[nodes[size].has(_slot([word[at + i] for i in range(size)]))]
                if len(at):
                    kept.setdefault(size, []).append([word[at + i] for i in range(size + 1)])
                    rows += len(at)
            if rows >= FLUSH_ROWS:
                yield from flush()
                rows = 0
    yield from flush()


def _spelled(batches: Iterator[pa.RecordBatch], wanted: BitTable) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for word, _, words, _, (_, data) in _steps(batch):
            at = np.flatnonzero(wanted.has(word))
            _, first = np.unique(word[at], return_index=True)
            at = at[first]
            text = [data[a:b].tobytes().lower() for a, b in zip(words.starts[at].tolist(), words.ends[at].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(word[at].view(np.int64)), pa.array(text, pa.binary())], ["word", "spelling"])


def _score(l: str, r: str, a: str) -> Column:  # noqa: E741
    wide = lambda x: f"cast({x} AS decimal(20,0))"
    return F.expr(f"cast(2000000 AS decimal(7,0)) * {wide(a)} div ({wide(l)} + {wide(r)})")


def _scored(phrases: DataFrame, known: DataFrame) -> DataFrame:
    """Phrases with (l, r, score) of their weakest cut; those with a part not counted yet are left out."""
    cuts = phrases.select("phrase", "lang", "f", F.explode(F.sequence(F.lit(1), F.size("phrase") - 1)).alias("k")).withColumns({
        "left": F.slice("phrase", F.lit(1), F.col("k")), "right": F.slice("phrase", F.col("k") + 1, F.size("phrase") - F.col("k"))})
    cuts = cuts.join(known.select(F.col("phrase").alias("left"), F.col("f").alias("l")), "left")
    cuts = cuts.join(known.select(F.col("phrase").alias("right"), F.col("f").alias("r")), "right")
    best = cuts.withColumn("score", _score("l", "r", "f")).groupBy("phrase", "lang", "f").agg(
        F.count("*").alias("cuts"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.filter(F.col("cuts") == F.size("phrase") - 1).select("phrase", "lang", "f", "cut.l", "cut.r", "cut.score")


class _Growth:
    """What is known so far, as stored tables."""

    def __init__(self, docs: DataFrame, least: int, longest: int, drop_percent: int, table_bits: int):
        self.docs, self.least, self.longest, self.drop, self.bits = docs, least, longest, drop_percent, table_bits
        counts = docs.mapInArrow(_count_words, "lang string, word long, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))
        counts = stored(counts, "word-counts")
        self.totals = stored(counts.groupBy("lang").agg(F.sum("f").alias("n")), "languages")
        self.words = stored(counts.filter(F.col("f") >= least).select(F.array("word").alias("phrase"), "lang", "f"), "frequent-words")
        self.frequent = BitTable.of(self.words.select(F.col("phrase")[0].alias("slot")), table_bits)
        self.pairs = stored(self._with_lang(self._counted({})), "pairs")
        self.scored = self._scored_pairs = stored(_scored(self.pairs, self.words), "scored-pairs")
        self.bounds = stored(self._bounded(self.pairs), "bounds")
        self.grown: list[DataFrame] = []
        self.expanded: list[DataFrame] = []

    def _counted(self, nodes: dict[int, BitTable]) -> DataFrame:
        found = self.docs.mapInArrow(partial(_phrases, frequent=self.frequent, nodes=nodes), "phrase array<long>, f long")
        return found.groupBy("phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= self.least)

    def _with_lang(self, phrases: DataFrame) -> DataFrame:
        first = self.words.select(F.col("phrase")[0].alias("first"), "lang")
        return phrases.join(first, F.col("phrase")[0] == F.col("first")).select("phrase", "lang", "f")

    def _bounded(self, phrases: DataFrame) -> DataFrame:
        """Phrases with the highest score that a longer one beginning with them can have."""
        first = self.words.select(F.col("phrase")[0].alias("first"), F.col("f").alias("f1"))
        return phrases.join(first, F.col("phrase")[0] == F.col("first")).withColumn("bound", _score("f1", "f", "f")).drop("first", "f1")

    def needed(self, level: DataFrame) -> DataFrame:
        """Phrases to expand so that all of a score of ``level`` (lang, level) or more, and what drops them, get known."""
        level = F.broadcast(level) if small_enough(level, F.octet_length("lang") + 16) else level
        bounds = self.bounds.filter(F.size("phrase") < self.longest).join(level, "lang")
        open_ = bounds.filter("bound >= level").select("phrase")
        ends = open_.filter(F.size("phrase") > 2).select(F.explode(F.transform(
            F.sequence(F.lit(2), F.size("phrase") - 1), lambda k: F.slice("phrase", k, F.size("phrase") - k + 1))).alias("phrase"))
        good = self.scored.join(level, "lang").filter("score >= level").filter(F.size("phrase") < self.longest)
        begins = good.select("f", F.explode(F.transform(F.sequence(F.lit(1), F.size("phrase") - 1), lambda k: F.slice("phrase", F.lit(1), k))).alias("tail"))
        begins = begins.groupBy("tail").agg(F.min("f").alias("f"))
        before = bounds.select("phrase", F.col("f").alias("f_longer"), F.slice("phrase", F.lit(2), F.size("phrase") - 1).alias("tail"))
        before = before.join(begins, "tail").filter(F.col("f_longer") * 100 >= F.col("f") * self.drop).select("phrase")
        out = open_.union(ends).union(before).distinct()
        return out.join(reduce(DataFrame.union, self.expanded), "phrase", "left_anti") if self.expanded else out

    def expand(self, nodes: DataFrame) -> None:
        """One scan: the phrases that are a word longer than the stored ``nodes``."""
        sizes = [r["n"] for r in nodes.select(F.size("phrase").alias("n")).distinct().collect()]
        tables = {n: BitTable.of(nodes.filter(F.size("phrase") == n).select(_slot_column(F.col("phrase"), n).alias("slot")), self.bits) for n in sizes}
        found = self._counted(tables).withColumn("node", F.slice("phrase", F.lit(1), F.size("phrase") - 1))
        found = found.join(nodes.select(F.col("phrase").alias("node")), "node", "left_semi")
        self.grown.append(stored(self._with_lang(found), "grown"))
        self.expanded.append(nodes)
        self.bounds = self.bounds.union(stored(self._bounded(self.grown[-1].filter(F.size("phrase") < self.longest)), "bounds"))
        longer = reduce(DataFrame.union, self.grown)
        self.scored = self._scored_pairs.union(stored(_scored(longer, self.words.union(self.pairs).union(longer)), "scored"))

    def staying(self, level: DataFrame) -> DataFrame:
        """The scored phrases of ``level`` or more that no longer phrase of nearly their count has inside."""
        good = self.scored.join(level, "lang").filter("score >= level")
        if not self.grown:
            return good.drop("level")
        longer = reduce(DataFrame.union, self.grown)
        inside = longer.select(F.col("f").alias("f_longer"), F.explode(F.array(
            F.slice("phrase", F.lit(1), F.size("phrase") - 1), F.slice("phrase", F.lit(2), F.size("phrase") - 1))).alias("phrase"))
        inside = inside.groupBy("phrase").agg(F.max("f_longer").alias("f_longer"))
        return (good.join(inside, "phrase", "left").filter(F.coalesce(F.col("f_longer") * 100 < F.col("f") * self.drop, F.lit(True)))
                .drop("level", "f_longer"))


def _first_of(rows: DataFrame, number: Column, order: list, count: int) -> DataFrame:
    return rows.withColumn("nth", number.over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("nth") <= count)


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", top: int = TOP, least: int = LEAST, longest: int = LONGEST,
                 drop_percent: int = DROP_PERCENT, table_bits: int = TABLE_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases by score, then a, then phrase.

    Candidates have 2 to ``longest`` words in a row, in one piece of a text, and occur a >= ``least`` times, overlaps included;
    one inside a longer candidate of ``drop_percent`` hundredths of its count or more is dropped, also where that one is dropped.
    The first of equally weak cuts gives l and r; n counts the language's words. A null language is UNKNOWN. A null or empty
    text has no words; repeated rows count again. An empty table gives an empty result. Other columns are not read.
    """
    docs = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).cast("string").alias("text"))
    growth = _Growth(docs, least, longest, drop_percent, table_bits)
    settled, todo, count = [], growth.totals.select("lang"), top
    while True:
        best = _first_of(growth.scored.join(todo, "lang", "left_semi"), F.row_number(), [F.desc("score")], count)
        best = best.groupBy("lang").agg(F.count("*").alias("phrases"), F.min("score").alias("level"))
        level = stored(todo.join(best, "lang", "left").select("lang", F.when(F.col("phrases") == count, F.col("level")).otherwise(0).alias("level")), "levels")
        while True:
            nodes = stored(growth.needed(level), "nodes")
            if nodes.isEmpty():
                break
            growth.expand(nodes)
        staying = stored(growth.staying(level), "staying")
        done = staying.groupBy("lang").agg(F.count("*").alias("phrases"))
        done = level.join(done, "lang", "left").withColumn("done", (F.coalesce("phrases", F.lit(0)) >= top) | (F.col("level") == 0))
        done = stored(done.select("lang", "done"), "done")
        settled.append(staying.join(done.filter("done"), "lang", "left_semi"))
        todo, count = done.filter("NOT done").select("lang"), count * 4
        if todo.isEmpty():
            break
    first = _first_of(reduce(DataFrame.union, settled), F.rank(), [F.desc("score"), F.desc("f")], top).drop("nth")
    first = stored(first.withColumn("id", F.monotonically_increasing_id()), "first")
    words = first.select("id", F.posexplode("phrase").alias("at", "word"))
    wanted = stored(words.select("word").distinct(), "wanted-words")
    spelled = docs.mapInArrow(partial(_spelled, wanted=BitTable.of(wanted.select(F.col("word").alias("slot")), table_bits)), "word long, spelling binary")
    spelled = stored(spelled.join(wanted, "word", "left_semi").distinct().withColumn("spelling", F.col("spelling").cast("string")), "spelled")
    if not spelled.groupBy("word").count().filter("count > 1").isEmpty():
        raise ValueError("two words have the same 64-bit hash")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "spelling"))), lambda x: x["spelling"]), " ")
    phrases = words.join(spelled, "word").groupBy("id").agg(text.alias("text"))
    rows = first.join(phrases, "id").join(growth.totals, "lang")
    rows = _first_of(rows, F.row_number(), [F.desc("score"), F.desc("f"), "text"], top)
    return rows.select("lang", F.col("nth").alias("rank"), F.col("text").alias("phrase"), F.col("f").alias("a"), "l", "r", "n", "score")
