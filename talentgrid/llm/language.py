"""Language of a text by a convolutional network over its bytes.

The network: filters of several widths over one-hot bytes, the greatest response of each filter in a window of WINDOW bytes
(max pooling), a rectifier and a softmax over the languages; trained in numpy with Adam on labelled windows. A text is cut
into windows that overlap by the widest filter less one, so no n-gram is lost, and its languages' probabilities are the
windows' mean, weighted by their bytes. A filter's response to a pair of bytes is a table entry, so a window of responses is
one gather for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentgrid.llm.common import small_enough, stored, text_steps

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 8
#: Bounds of the training sample: documents of each language, windows of each document, and languages.
SAMPLE_DOCS, SAMPLE_WINDOWS, SAMPLE_LANGS = 400, 4, 200
UNKNOWN = "und"


@dataclass
class Network:
    langs: list[str]
    filters: list[np.ndarray]  # for each width: (width, 256, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> list[tuple[np.ndarray, np.ndarray | None]]:
        """For each width its response to a first pair of bytes and to what follows it; filters come first."""
        made = []
        for w in self.filters:
            pair = (w[0][:, None, :] + w[1][None, :, :]).reshape(65536, -1).T
            rest = None if len(w) == 2 else w[2].T if len(w) == 3 else (w[2][:, None, :] + w[3][None, :, :]).reshape(65536, -1).T
            made.append((np.ascontiguousarray(pair), None if rest is None else np.ascontiguousarray(rest)))
        return made

    def probabilities(self, x: np.ndarray, tables) -> np.ndarray:
        """(windows, languages) of windows of bytes."""
        pairs = (x[:, :-1].astype(np.uint16) << 8) | x[:, 1:]
        pooled = []
        for (first, rest), w in zip(tables, self.filters):
            n = x.shape[1] - len(w) + 1
            after = None if rest is None else x[:, 2 : 2 + n] if len(w) == 3 else pairs[:, 2 : 2 + n]
            for f in range(len(first)):
                response = first[f].take(pairs[:, :n])
                if rest is not None:
                    response += rest[f].take(after)
                pooled.append(response.max(1))
        z = np.maximum(np.stack(pooled, 1) + self.bias, 0) @ self.out + self.out_bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def padded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Windows from ``starts`` on; bytes from a window's end on are 0."""
    at = starts[:, None] + np.arange(WINDOW)
    x = np.append(data, np.uint8(0)).take(np.minimum(at, len(data)))
    x[at >= ends[:, None]] = 0
    return x


def train(windows: list[bytes], labels: list[str], epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Network:
    """Fit a network to labelled windows; the order, the start and so the result are fixed by ``seed``."""
    langs = sorted(set(labels))
    rng = np.random.default_rng(seed)
    ends = np.cumsum([len(w) for w in windows])
    x = padded(np.frombuffer(b"".join(windows), np.uint8), ends - [len(w) for w in windows], ends)
    y = np.array([langs.index(v) for v in labels])
    net = Network(langs, [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS],
                  np.zeros(FILTERS * len(WIDTHS), np.float32),
                  rng.normal(0, 0.3, (FILTERS * len(WIDTHS), len(langs))).astype(np.float32), np.zeros(len(langs), np.float32))
    params = [*net.filters, net.bias, net.out, net.out_bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            bx, by, n = x[rows], y[rows], len(rows)
            best, pooled = [], []
            for w in net.filters:
                p = WINDOW - len(w) + 1
                r = sum(w[j][bx[:, j : j + p]] for j in range(len(w)))
                best.append(r.argmax(1))
                pooled.append(np.take_along_axis(r, best[-1][:, None], 1)[:, 0])
            hidden = np.maximum(np.concatenate(pooled, 1) + net.bias, 0)
            z = hidden @ net.out + net.out_bias
            z = np.exp(z - z.max(1, keepdims=True))
            g = z / z.sum(1, keepdims=True)
            g[np.arange(n), by] -= 1
            g /= n
            gh = (g @ net.out.T) * (hidden > 0)
            grads = []
            for k, w in enumerate(net.filters):
                gw = np.zeros_like(w)
                own = gh[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(len(w)):
                    np.add.at(gw[j], (np.take_along_axis(bx, best[k] + j, 1), np.arange(FILTERS)), own)
                grads.append(gw)
            grads += [gh.sum(0), hidden.T @ g, g.sum(0)]
            step += 1
            for p, d, (m, v) in zip(params, grads, moments):
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[bytes], list[str]]:
    """A bounded sample of the labelled documents that are not held out: SAMPLE_WINDOWS stretches, spread evenly over the text,
    of SAMPLE_DOCS documents of each language, in order of a hash of the id. Twice as many at most, as a rule, meet in one task:
    a bound on the hash, from the language's number of documents, leaves no more."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter("doc_id IS NOT NULL AND lang IS NOT NULL").filter(~held_out(F.col("doc_id"))).filter(F.col("text").rlike(r"\p{L}"))
    spare = F.greatest(F.length("text") - WINDOW, F.lit(0))
    cuts = [F.substring(F.col("text"), (F.floor(spare * i / max(1, SAMPLE_WINDOWS - 1)) + 1).cast("int"), F.lit(WINDOW)) for i in range(SAMPLE_WINDOWS)]
    sizes = stored(rows.groupBy("lang").agg(F.count("*").alias("docs")).withColumnRenamed("lang", "own_lang"), "languages")
    sizes = F.broadcast(sizes) if small_enough(sizes, F.octet_length("own_lang") + 16) else sizes
    share = (F.xxhash64("doc_id") / 2.0**64 + 0.5) * F.col("docs")
    rows = rows.join(sizes, F.col("lang") == F.col("own_lang")).filter(share <= SAMPLE_DOCS * 1.5 + 100)
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    rows = rows.select("lang", "doc_id", F.array_distinct(F.array(*cuts)).alias("cuts")).withColumn("nth", nth)
    sample = rows.filter(F.col("nth") <= SAMPLE_DOCS).orderBy("nth", "lang").limit(SAMPLE_DOCS * SAMPLE_LANGS).collect()
    pairs = sorted((r.lang, r.doc_id, cut.encode()[:WINDOW]) for r in sample for cut in r.cuts)
    return [p[2] for p in pairs], [p[0] for p in pairs]


def _predict(batches: Iterator[pa.RecordBatch], network: Broadcast, text_kept: bool) -> Iterator[pa.RecordBatch]:
    """Adds lang_pred and score to the columns, of which the first is the text."""
    net = network.value
    tables = net.tables()
    step = WINDOW - max(WIDTHS) + 1
    for batch in batches:
        for i, j, data, offsets in text_steps(batch.column(0)):
            n = np.diff(offsets)
            windows = np.maximum(1, -(-(n - (WINDOW - step)) // step))
            doc = np.repeat(np.arange(j - i), windows)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows)
            starts = offsets[:-1][doc] + nth * step
            ends = offsets[1:][doc]
            total = np.zeros((j - i, len(net.langs)))
            for at in range(0, len(doc), 128):
                part = slice(at, at + 128)
                p = net.probabilities(padded(data, starts[part], ends[part]), tables)
                weight = np.clip(ends[part] - starts[part], 1, WINDOW)
                np.add.at(total, doc[part], p * weight[:, None])
            total /= total.sum(1, keepdims=True)
            best = total.argmax(1)
            rows = batch.slice(i, j - i)
            kept = [c for c in rows.schema.names if text_kept or c != rows.schema.names[0]]
            yield pa.RecordBatch.from_arrays(
                [*[rows.column(c) for c in kept], pa.array([net.langs[k] for k in best]),
                 pa.array(np.clip(total[np.arange(j - i), best], 0, 1))], [*kept, "lang_pred", "score"])


def predict(docs: DataFrame, network: Network | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs``, lang_pred and score for every row, predicted from its text alone.

    A null text, or one without a letter, is ``und`` with score 0; so is every text if nothing was learned (None). Empty
    and short texts are one padded window. Repeated rows, null ids and an empty table pass like others; ``keep`` may not
    name lang_pred or score.
    """
    text = F.col(text_col).cast("string")
    letters = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    if network is None:
        return docs.select(*keep, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(network)
    names = {c: "x_text" if c == text_col else f"x{i}" for i, c in enumerate(keep)}
    rows = docs.select(text.alias("x_text"), *[F.col(c).alias(x) for c, x in names.items() if x != "x_text"], letters.alias("letters"))
    text_kept = text_col in keep
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if text_kept or f.name != "x_text")
    got = rows.mapInArrow(partial(_predict, network=sent, text_kept=text_kept), f"{shape}, lang_pred string, score double")
    return got.select(*[F.col(x).alias(c) for c, x in names.items()],
                      F.when(F.col("letters"), F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
                      F.when(F.col("letters"), F.col("score")).otherwise(0.0).alias("score"))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """The network fitted to the sample of ``training_windows``; None if no document is labelled."""
    windows, labels = training_windows(docs, id_col, text_col, lang_col)
    return train(windows, labels) if windows else None
