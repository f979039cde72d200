"""Quality: a byte-level convolutional network in numpy.

Every byte of the text, with a mark that says whether its word repeats one of the two words before
it, is one of 512 symbols.  `FILTERS` learnt filters of `TAPS` bytes read the whole text with stride
`STRIDE`, in chunks of `CHUNK` positions that overlap by half.  Each filter is max-pooled within a
chunk; the chunks' pooled features are averaged over the text, and a logistic layer combines the
means into one probability.  A filter is a table of one weight per tap and symbol, so a response is
a sum of table look-ups.

The network (0.3 MB) is fitted on all labelled rows by `labelled.fit_on_all` and broadcast; texts are scored
whole, in slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import held_out, read_table, text_slices, word_hashes, words
from parlance.llm.labelled import Adam, Examples, fit_on_all, sigmoid

SYMBOLS, TAPS, FILTERS, STRIDE, CHUNK = 512, 6, 12, 2, 128
EPOCHS, MIN_STEPS, BATCH, RATE = 3, 150, 48, 0.01
THRESHOLD = 0.3


def symbols_of(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Byte values, plus 256 within words equal to one of the two words before them in the text."""
    out = data.astype(np.int32)
    starts, ends, first = words(data, off)
    if len(starts) > 1:
        h = word_hashes(data, starts, ends)
        text = np.repeat(np.arange(len(off) - 1), np.diff(first))
        again = np.zeros(len(starts), bool)
        for lag in (1, 2):
            again[lag:] |= (h[lag:] == h[:-lag]) & (text[lag:] == text[:-lag])
        mark = np.zeros(len(data) + 1, np.int8)
        mark[starts[again]] += 1
        mark[ends[again]] -= 1
        out += 256 * np.cumsum(mark[:-1], dtype=np.int32)
    return out


class Network:
    def __init__(self, seed: int = 2):
        rng = np.random.default_rng(seed)
        self.p = {"taps": (rng.standard_normal((TAPS, SYMBOLS, FILTERS)) * 0.2).astype(np.float32),
                  "shift": np.zeros(FILTERS, np.float32), "out": (rng.standard_normal(FILTERS) * 0.3).astype(np.float32),
                  "bias": np.zeros(1, np.float32)}

    def forward(self, sym: np.ndarray, off: np.ndarray, learn: bool = False):
        """Logits of the texts [off[i], off[i + 1]); with `learn` what the gradients need.

        Positions are every STRIDE-th byte of a text; taps past its end read nothing.  Half chunks
        are pooled first, and a chunk is two neighbouring halves.
        """
        size = np.diff(off)
        n_pos = -(-size // STRIDE)
        total, half = int(n_pos.sum()), CHUNK // 2
        p0 = np.concatenate(([0], np.cumsum(n_pos)))
        text = np.repeat(np.arange(len(size)), n_pos)
        k = np.arange(total) - p0[text]
        at = off[text] + k * STRIDE
        resp = np.zeros((total, FILTERS), np.float32)
        taps = self.p["taps"]
        left = off[text + 1] - at
        for t in range(TAPS):
            if t == 0 or left.min(initial=TAPS) > t:
                resp += taps[t].take(sym[np.minimum(at + t, len(sym) - 1)], axis=0)
            else:
                ok = left > t
                got = taps[t].take(sym[np.minimum(at + t, len(sym) - 1)], axis=0)
                got[~ok] = 0
                resp += got
        n_half = -(-n_pos // half)
        h0 = np.concatenate(([0], np.cumsum(n_half)))
        htext = np.repeat(np.arange(len(size)), n_half)
        hstart = p0[htext] + (np.arange(h0[-1]) - h0[htext]) * half
        mean = np.zeros((len(size), FILTERS), np.float32)
        if total:
            halves = np.maximum.reduceat(resp, hstart, axis=0)
            nxt = np.minimum(np.arange(len(halves)) + 1, h0[htext + 1] - 1)
            pooled = np.maximum(np.maximum(halves, halves[nxt]) + self.p["shift"], 0)
            full = np.flatnonzero(n_half)
            mean[full] = np.add.reduceat(pooled, h0[full], axis=0) / n_half[full, None]
        z = mean @ self.p["out"] + self.p["bias"]
        if not learn:
            return z
        best = np.empty((len(hstart), FILTERS), np.int64)
        ends = np.append(hstart[1:], total)
        for i, (a, b) in enumerate(zip(hstart.tolist(), ends.tolist())):
            best[i] = a + resp[a:b].argmax(axis=0)
        src = np.where(halves >= halves[nxt], best, best[nxt])
        return z, mean, pooled, at[src], htext, n_half

    def gradients(self, sym, off, y, weight):
        z, mean, pooled, src, htext, n_half = self.forward(sym, off, learn=True)
        dz = ((sigmoid(z) - y) * weight / len(y)).astype(np.float32)
        back = (dz / np.maximum(n_half, 1))[htext][:, None] * self.p["out"] * (pooled > 0)
        g = {"out": mean.T @ dz, "bias": dz.sum(keepdims=True), "shift": back.sum(axis=0)}
        flat = np.zeros(TAPS * SYMBOLS * FILTERS)
        col = np.broadcast_to(np.arange(FILTERS), src.shape)
        end = off[htext + 1][:, None]
        for t in range(TAPS):
            ok = (src + t < end) & (back != 0)
            cell = (t * SYMBOLS + sym[(src + t)[ok]]) * FILTERS + col[ok]
            flat += np.bincount(cell, back[ok], len(flat))
        g["taps"] = flat.reshape(TAPS, SYMBOLS, FILTERS).astype(np.float32) + 1e-5 * self.p["taps"]
        return g

    sparse = ()

    def state(self) -> dict[str, np.ndarray]:
        """What the shards of a fit average."""
        return self.p

    def learn(self, texts: pa.Array, y: np.ndarray, share: float, seed: int = 4) -> None:
        """Descends over the texts in batches, EPOCHS times or more where they are few."""
        rng = np.random.default_rng(seed)
        prepared = [symbols_of(d, o).astype(np.int16) for i in range(len(texts)) for _, d, o in text_slices(texts.slice(i, 1))]
        weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
        order, opt = rng.permutation(len(y)), Adam(self.p, RATE)
        for _ in range(max(EPOCHS, -(-MIN_STEPS * BATCH // len(order)))):
            for a in range(0, len(order), BATCH):
                part = order[a:a + BATCH]
                off = np.concatenate(([0], np.cumsum([len(prepared[i]) for i in part])))
                opt.step(self.gradients(np.concatenate([prepared[i] for i in part]).astype(np.int32), off, y[part], weight[part]))
            rng.shuffle(order)

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        return sigmoid(self.forward(symbols_of(data, off), off).astype(np.float64))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Network | float:
    """A network fitted on all labelled rows; a constant score where they lack a class (1.0 without any labels)."""
    examples = Examples.of(docs, labels, "quality", id_col, text_col)
    if len(examples.counts) < 2:
        return 0.0 if examples.only_label == 0 else 1.0
    return fit_on_all(Network(), examples)


def score_quality(docs: DataFrame, model: Network | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text; a null text scores as the empty one, whose features are 0.  A null id stays
    null, rows that repeat an id are scored one by one, an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            s = np.zeros(b.num_rows)
            if isinstance(m, float):
                s[:] = m
            else:
                for row, data, off in text_slices(b.column(1), 1 << 17):
                    s[row:row + len(off) - 1] = m.scores(data, off)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, "doc_id long, score double")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return score_quality(docs, fit_quality(docs, labels)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
