"""Language ID by a convolutional network over bytes.

Filters of several widths run over a window of WINDOW bytes, each keeps its largest response, and a softmax over these gives the
language. A text is cut into windows from its first byte to its last, and the probabilities of its windows are averaged, weighted by their bytes.
Training is plain numpy on the driver, on a bounded sample of labelled rows (at most SAMPLE documents, dealt evenly over the
labels, PIECES windows of each); prediction runs over every window of every text, in Arrow batches.

A filter's response at a place is a sum of table entries, one for each byte under it; for prediction these tables are
folded into tables over pairs of bytes, so a place costs few look-ups whatever the width.

Null texts and texts without a letter are `und` with score 0. With no labelled rows at all, as in an empty table, everything is `und`. Every label
that occurs is learned, one row of each at least, a rare one from all of its rows; so beside SAMPLE documents there is one for each label. A very long text is cut into windows like others. Rows with repeated or null doc_ids are predicted one by one; lang, source and doc_id are no inputs of a prediction, and
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._words import LOWER, scratch, slices, trim

WINDOW = 256
WIDTHS, FILTERS = (2, 3, 4), 8
SAMPLE, PIECES = 2400, 4
BATCH, STEPS, RATE = 64, 900, 0.03


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows padded with zeros, text of each, bytes of each) of texts that lie one after another."""
    size = np.diff(offsets)
    n = -(-size // WINDOW)
    text = np.repeat(np.arange(len(size)), n)
    start = offsets[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * WINDOW
    held = np.minimum(WINDOW, offsets[1:][text] - start)
    padded = np.append(data, np.zeros(WINDOW, np.uint8))
    out = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[start] if len(text) else np.zeros((0, WINDOW), np.uint8)
    short = np.flatnonzero(held < WINDOW)
    out[short] = np.where(np.arange(WINDOW) < held[short, None], out[short], 0)
    return out, text, held


class Network:
    def __init__(self, labels: list[str], seed: int = 3):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.tables = [(rng.standard_normal((w, 256, FILTERS)) * 0.3).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = np.zeros((len(WIDTHS) * FILTERS, len(labels)), np.float32)
        self.out_bias = np.zeros(len(labels), np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 4) -> None:
        """Adam on the cross entropy; only the place where a filter is largest gets a gradient."""
        rng = np.random.default_rng(seed)
        params = [*self.tables, *self.bias, self.out, self.out_bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, STEPS + 1):
            own = rng.integers(0, len(x), BATCH)
            b, rows, f = x[own], np.arange(BATCH)[:, None], np.arange(FILTERS)
            tops, places = [], []
            for t, c, w in zip(self.tables, self.bias, WIDTHS, strict=True):
                z = sum(t[j][b[:, j : WINDOW - w + 1 + j]] for j in range(w))
                at = z.argmax(axis=1)
                tops.append(z[rows, at, f] + c)
                places.append(at)
            h = np.maximum(np.concatenate(tops, axis=1), 0)
            p = softmax(h @ self.out + self.out_bias)
            p[np.arange(BATCH), y[own]] -= 1
            p /= BATCH
            back = (p @ self.out.T) * (h > 0)
            grads = []
            for i, (t, w) in enumerate(zip(self.tables, WIDTHS, strict=True)):
                g = np.zeros_like(t)
                part = back[:, i * FILTERS : (i + 1) * FILTERS]
                for j in range(w):
                    np.add.at(g[j], (b[rows, places[i] + j], f), part)
                grads.append(g)
            grads += [back[:, i * FILTERS : (i + 1) * FILTERS].sum(axis=0) for i in range(len(WIDTHS))] + [h.T @ p, p.sum(axis=0)]
            rate = RATE * (1 - step / (STEPS + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for q, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= rate * m / (np.sqrt(v) + 1e-8)

    def folded(self) -> list[list[np.ndarray]]:
        """For each width, tables over pairs of bytes, and one over single bytes if the width is odd."""
        out = []
        for t, w in zip(self.tables, WIDTHS, strict=True):
            pairs = [(t[j][:, None, :] + t[j + 1][None, :, :]).reshape(65536, FILTERS) for j in range(0, w - 1, 2)]
            out.append(pairs + ([t[-1]] if w % 2 else []))
        return out

    def probabilities(self, x: np.ndarray, folded: list[list[np.ndarray]]) -> np.ndarray:
        out = []
        for a in range(0, len(x), 64):
            b = x[a : a + 64]
            pair = (b[:, :-1].astype(np.int32) << 8) | b[:, 1:]
            tops = []
            for tables, c, w in zip(folded, self.bias, WIDTHS, strict=True):
                n = WINDOW - w + 1
                z = tables[0].take(pair[:, :n], axis=0)
                for j, t in enumerate(tables[1:], 1):
                    z += t.take(pair[:, 2 * j : 2 * j + n] if len(t) == 65536 else b[:, 2 * j : 2 * j + n], axis=0)
                tops.append(z.max(axis=1) + c)
            out.append(softmax(np.maximum(np.concatenate(tops, axis=1), 0) @ self.out + self.out_bias))
        return np.concatenate(out) if out else np.zeros((0, len(self.labels)), np.float32)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[off[0] : off[-1]] if texts.buffers()[2] is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return LOWER[data], off - off[0]


def _samples(batches):
    for batch in batches:
        for at, to in slices(batch.column(1)):
            x, text, held = windows(*_raw(batch.column(1).slice(at, to - at)))
            if not len(x):
                continue
            order = np.arange(len(text)) - np.searchsorted(text, text)
            n = np.bincount(text, minlength=to - at)[text]
            keep = (n <= PIECES) | (order % np.maximum(1, n // PIECES) == 0) & (order // np.maximum(1, n // PIECES) < PIECES)
            keep &= (held >= WINDOW // 4) | (n == 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at + text[keep])), pa.array([r.tobytes() for r in x[keep]], pa.binary())], ["label", "bytes"])


def train(labelled: DataFrame) -> Network:
    """A network for the labels of labelled (text, lang)."""
    named = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(F.col("lang").cast("string").alias("lang"), "text", "doc_id")
    counts = named.groupBy("lang").count()
    counted = counts.collect()  # one row for each language
    labels = sorted(r[0] for r in counted)
    if not labels:
        return Network([])
    each = max(1, SAMPLE // len(labels))
    draw = F.pmod(F.xxhash64(F.lit(9), "text", "doc_id"), F.lit(1 << 30))  # which rows are drawn; the network sees their texts alone
    rates = labelled.sparkSession.createDataFrame([(r[0], int(min(1.0, 1.3 * each / r[1]) * (1 << 30))) for r in counted], "lang string, rate long")
    chosen = named.join(F.broadcast(rates), "lang").where(draw < F.col("rate")).select("lang", "text")
    first = named.groupBy("lang").agg(F.min_by("text", F.struct(draw, "text")).alias("text"))  # each label draws this row at least
    kind = "label string, bytes binary"
    must = first.mapInArrow(_samples, kind).withColumn("late", F.lit(0))
    drawn = must.union(chosen.mapInArrow(_samples, kind).withColumn("late", F.lit(1))).groupBy("label", "bytes").agg(F.min("late").alias("late"))
    # about 1.3 * SAMPLE * PIECES windows, and PIECES at most for each label's first row; those go before the others
    drawn = drawn.orderBy("late", F.xxhash64("label", "bytes"), "label", "bytes").limit((3 * SAMPLE + len(labels)) * PIECES).select("label", "bytes").toArrow()
    pairs = sorted(zip(drawn.column(0).to_pylist(), drawn.column(1).to_pylist(), strict=True))  # the order in which Spark hands them over doesn't matter
    y = np.searchsorted(labels, np.array([p[0] for p in pairs], dtype=object)) if pairs else np.zeros(0, int)
    x = np.frombuffer(b"".join(p[1] for p in pairs), dtype=np.uint8).reshape(-1, WINDOW)
    # the labels alike in weight
    rng = np.random.default_rng(1)
    own = np.concatenate([rng.choice(np.flatnonzero(y == k), each * 2) for k in range(len(labels)) if (y == k).any()])
    net = Network(labels)
    net.fit(x[own], y[own])
    return net


def predictor(net: Network):
    """A column function of text: struct of lang_pred and score."""
    tables: list = []  # of a worker's copy of this function

    def run(texts: pa.Array) -> pa.Array:
        scratch("langid")
        if not tables:
            tables.append(net.folded())
        folded = tables[0]
        letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        names, scores = [], []
        for at, to in slices(texts):
            x, text, held = windows(*_raw(texts.slice(at, to - at)))
            total = np.zeros((to - at, max(1, len(net.labels))))
            if net.labels:
                np.add.at(total, text, net.probabilities(x, folded) * held[:, None])
            sums = total.sum(axis=1)
            best, ok = total.argmax(axis=1), (sums > 0) & letters[at:to]
            scores.append(np.where(ok, np.minimum(1.0, total.max(axis=1) / np.where(sums > 0, sums, 1)), 0.0))
            names += [net.labels[b] if o else "und" for b, o in zip(best.tolist(), ok.tolist(), strict=True)]
        trim()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))], ["lang_pred", "score"])

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "struct<lang_pred: string, score: double>")


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def op9_langid(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = train(docs.where(~F.coalesce(held_out(), F.lit(False))))
    found = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), predictor(net)(F.col("text").cast("string")).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")
