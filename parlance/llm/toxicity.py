"""Toxicity: a convolutional text classifier in numpy, its thresholds calibrated by language.

Words (letters; lower case) are embedded as the sum of hashed vectors of the whole word and of its
first four and five bytes, so that inflected forms of a stem share most of their vector.  Filters
of widths 1, 2 and 3 slide over the words, each is max-pooled over the whole text, and a logistic
layer gives a logit.  The language is guessed from function words in the text (never from a column);
each language's threshold is calibrated on a fifth of the labelled rows, which the network is not
fitted on, and the score is shifted so that the threshold lies at 0.5.

The model (about 3 MB) is fitted on all other labelled rows by `labelled.fit_on_all`, calibrated on all rows of that
fifth by their counts per language and logit, and broadcast; texts are scored whole, in slices.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from parlance.llm.common import BYTE_CODES, U64, enter, fresh, held_out, read_table, span_hashes, text_slices, word_hashes, words
from parlance.llm.labelled import Adam, Examples, fit_on_all, sigmoid

TABLE = 1 << 14
DIM, FILTERS, WIDTHS = 12, 8, (1, 2, 3)
PREFIXES = (4, 5)
#: Logit of a text in which no filter fires, such as the empty one; it is not learnt.
BIAS = np.float32(-2)
EPOCHS, MIN_STEPS, BATCH, RATE, EMB_RATE, DECAY, DROP = 4, 150, 48, 0.01, 0.05, 1e-3, 0.3
THRESHOLD = 0.5
#: Steps of a logit that the calibration tells apart.
LOGIT_STEPS = 256
# Frequent function words of each language.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was with as by this are be or from an at",
    "de": "der die und den von zu das mit ist ein des dem für auf nicht eine im sich auch als",
    "fr": "le la les de des et un une que est pour qui dans du par sur pas avec au elle",
    "es": "el la los las de que y en un una del por con se su para no al lo es",
}

_LOWER = np.full(256, 32, np.uint8)
_LOWER[97:123] = np.arange(97, 123)
_LOWER[65:91] = np.arange(97, 123)
_LOWER[128:] = np.arange(128, 256)
_LOWER[10] = 10


def letters(data: np.ndarray) -> np.ndarray:
    """Bytes with ASCII letters and Latin-1 capitals in lower case, other ASCII as spaces."""
    out = _LOWER[data]
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    up = after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    out[up] += 0x20
    return out


def word_rows(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(table rows of each word: (1 + prefixes) x words, each text's first word, whole-word hashes)."""
    low = letters(data)
    starts, ends, first = words(low, off)
    if not len(starts):
        return np.zeros((1 + len(PREFIXES), 0), np.int64), first, np.zeros(0, U64)
    codes = BYTE_CODES[0][low]
    h = span_hashes(codes, starts, ends, cuts=[np.minimum(starts + p, ends) for p in PREFIXES])
    rows = [((c + U64(k) >> U64(40)) % U64(TABLE)).astype(np.int64) + k * TABLE for k, c in enumerate(h)]
    return np.stack(rows), first, h[0]


def _hash_of(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(word_hashes(data, np.array([0]), np.array([len(data)]))[0])


LANGUAGES = list(FUNCTION_WORDS)
_known = sorted((_hash_of(w), k) for k, lang in enumerate(LANGUAGES) for w in FUNCTION_WORDS[lang].split())
_KNOWN_HASH = np.array([h for h, _ in _known], U64)
_KNOWN_LANG = np.array([k for _, k in _known])


def languages(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text the language with most function words (each word counts for all its languages);
    len(LANGUAGES) where there is none."""
    n, kinds = len(first) - 1, len(LANGUAGES)
    lo, hi = np.searchsorted(_KNOWN_HASH, h), np.searchsorted(_KNOWN_HASH, h, "right")
    text, votes = np.repeat(np.arange(n), np.diff(first)), np.zeros(n * kinds)
    for k in range(int((hi - lo).max(initial=0))):
        at = np.flatnonzero(lo + k < hi)
        votes += np.bincount(text[at] * kinds + _KNOWN_LANG[lo[at] + k], minlength=n * kinds)
    votes = votes.reshape(n, kinds)
    return np.where(votes.max(axis=1, initial=0) > 0, votes.argmax(axis=1), kinds)


class Network:
    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.p = {"emb": (rng.standard_normal(((1 + len(PREFIXES)) * TABLE, DIM)) * 0.05).astype(np.float32),
                  "conv": (rng.standard_normal((DIM, sum(WIDTHS) * FILTERS)) * 0.3).astype(np.float32),
                  "out": (rng.standard_normal(len(WIDTHS) * FILTERS) * 0.3).astype(np.float32),
                  "shift": np.zeros(len(WIDTHS) * FILTERS, np.float32)}
        self.thresholds = np.zeros(len(LANGUAGES) + 1)      # logits
        self.seen = np.zeros((len(self.p["emb"]), 1), np.float32)

    def forward(self, rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(logits, pooled features, word at which each feature is largest)."""
        n, k = len(first) - 1, len(WIDTHS) * FILTERS
        pooled, at = np.zeros((n, k), np.float32), np.full((n, k), -1)
        full = np.flatnonzero(np.diff(first) > 0)
        if len(full):
            emb = self.p["emb"]
            e = emb[rows[0]]
            for r in rows[1:]:
                e += emb[r]
            taps, ends = 0, first[full + 1]
            for w, width in enumerate(WIDTHS):
                f = e @ self._filters(taps)
                for t in range(1, width):
                    part = (e @ self._filters(taps + t))[t:]
                    past = (ends[:, None] - np.arange(1, t + 1)).ravel()     # words past the end count as zero
                    part[past[(past >= 0) & (past < len(part))]] = 0
                    f[:-t or None] += part
                cols = slice(w * FILTERS, (w + 1) * FILTERS)
                top = np.maximum.reduceat(f, first[full], axis=0)
                pooled[full, cols] = np.maximum(top + self.p["shift"][cols], 0)
                if self.training:
                    for d, a, b in zip(full, first[full], ends):
                        at[d, cols] = a + f[a:b].argmax(axis=0)
                taps += width
        return pooled @ self.p["out"] + BIAS, pooled, at

    def _filters(self, tap: int) -> np.ndarray:
        return np.ascontiguousarray(self.p["conv"][:, tap * FILTERS:(tap + 1) * FILTERS])

    training = False

    def gradients(self, rows, first, y, weight):
        """Dense gradients, and (table rows, gradients) of the embedding rows that were used."""
        z, pooled, at = self.forward(rows, first)
        dz = ((sigmoid(z) - y) * weight / len(y)).astype(np.float32)
        back = dz[:, None] * self.p["out"] * (pooled > 0)
        g = {"out": pooled.T @ dz, "conv": np.zeros_like(self.p["conv"]), "shift": back.sum(axis=0)}
        end, taps, used, used_g = first[1:], 0, [], []
        for w, width in enumerate(WIDTHS):
            for t in range(width):
                for f in range(FILTERS):
                    c, col = w * FILTERS + f, (taps + t) * FILTERS + f
                    use = np.flatnonzero((at[:, c] >= 0) & (at[:, c] + t < end) & (back[:, c] != 0))
                    if len(use):
                        r = rows[:, at[use, c] + t]
                        g["conv"][:, col] += self.p["emb"][r].sum(axis=0).T @ back[use, c]
                        used.append(r.ravel())
                        used_g.append(np.tile(back[use, c][:, None] * self.p["conv"][:, col], (len(r), 1)))
            taps += width
        return g, used, used_g

    sparse = ("emb", "seen")

    def state(self) -> dict[str, np.ndarray]:
        """What the shards of a fit average: the parameters and Adagrad's sums."""
        return {**self.p, "seen": self.seen}

    def learn(self, texts: pa.Array, y: np.ndarray, share: float, seed: int = 3) -> None:
        """Descends over the texts in batches, EPOCHS times or more where they are few."""
        rng = np.random.default_rng(seed)
        prepared = [word_rows(data, off)[0].astype(np.int32) for i in range(len(texts)) for _, data, off in text_slices(texts.slice(i, 1))]
        train, weight = np.arange(len(y)), np.where(y == 1, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6))
        opt, seen = Adam({k: v for k, v in self.p.items() if k != "emb"}, RATE), self.seen[:, 0]
        self.training = True
        for _ in range(max(EPOCHS, -(-MIN_STEPS * BATCH // max(len(train), 1)))):
            for a in range(0, len(train), BATCH):
                part = train[a:a + BATCH]
                kept = [prepared[i][:, rng.random(prepared[i].shape[1]) >= DROP] for i in part]
                first = np.concatenate(([0], np.cumsum([r.shape[1] for r in kept])))
                g, used, used_g = self.gradients(np.concatenate(kept, axis=1), first, y[part], weight[part])
                opt.step(g)
                if used:                        # Adagrad, with decay, on the embedding rows in use
                    rows, inv = np.unique(np.concatenate(used), return_inverse=True)
                    ge = np.zeros((len(rows), DIM), np.float32)
                    np.add.at(ge, inv, np.concatenate(used_g))
                    seen[rows] += (ge * ge).mean(axis=1)
                    emb = self.p["emb"]
                    emb[rows] = emb[rows] * (1 - DECAY) - EMB_RATE * ge / (np.sqrt(seen[rows])[:, None] + 1e-6)
            rng.shuffle(train)
        self.training = False

    def logits(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(logits, guessed languages) of texts."""
        rows, first, h = word_rows(data, off)
        return self.forward(rows, first)[0].astype(np.float64), languages(h, first)

    def calibrate(self, z: np.ndarray, lang: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> "Network":
        """Thresholds by language from logits and labels (of `n` texts each)."""
        n = np.ones(len(z), int) if n is None else n
        general = best_threshold(z, y, 0.0, n=n)
        self.thresholds = np.array([best_threshold(z[lang == k], y[lang == k], general, n=n[lang == k])
                                    for k in range(len(LANGUAGES) + 1)])
        return self

    def fit(self, texts: list[str], y: np.ndarray, seed: int = 3) -> "Network":
        """A fit on texts at hand, a fifth of them for the calibration."""
        order = np.random.default_rng(seed).permutation(len(texts))
        calib, train = order[:len(order) // 5], order[len(order) // 5:]
        self.learn(pa.array([texts[i] for i in train], pa.string()), y[train], y[train].mean(), seed=seed)
        if not len(calib):
            return self
        told = [self.logits(data, off) for _, data, off in text_slices(pa.array([texts[i] for i in calib], pa.string()))]
        return self.calibrate(*(np.concatenate(c) for c in zip(*told)), y[calib])

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        z, lang = self.logits(data, off)
        return sigmoid(z - self.thresholds[lang])


def best_threshold(z: np.ndarray, y: np.ndarray, otherwise: float, least: int = 8, n: np.ndarray | None = None) -> float:
    """The logit with the best F1, in the middle half of its gap and there as near to even odds as can be; `otherwise` with
    few examples of a class.  `n`: how many examples each stands for."""
    n = np.ones(len(z), int) if n is None else n
    if n[y == 1].sum() < least or n[y == 0].sum() < least:
        return otherwise
    values, at = np.unique(z, return_inverse=True)
    if len(values) < 2:
        return otherwise
    gap = np.diff(values)
    cuts = np.clip(0, values[:-1] + gap / 4, values[1:] - gap / 4)
    above = lambda k: np.bincount(at, k, len(values))[::-1].cumsum()[::-1][1:]
    f1 = 2 * above(n * (y == 1)) / (above(n) + n[y == 1].sum())
    best = cuts[f1 == f1.max()]
    return max(float(best[len(best) // 2]), float(BIAS) + 0.5)


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Network | float:
    """A network fitted and calibrated on all labelled rows; a constant score where they lack a class (0.0 without labels)."""
    examples = Examples.of(docs, labels, "toxic", id_col, text_col)
    if len(examples.counts) < 2:
        return 1.0 if examples.only_label == 1 else 0.0
    calib = F.pmod(F.xxhash64("_h", F.lit(13)), F.lit(5)) == 0
    model = fit_on_all(Network(), examples, ~calib)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def told(batches):
        enter("toxicity")
        for b in batches:
            z, lang = [np.zeros(0)], [np.zeros(0, int)]
            for _, data, off in text_slices(b.column(1), 1 << 19):
                got = shared.value.logits(data, off)
                z.append(got[0])
                lang.append(got[1])
            step = np.rint(np.clip(np.concatenate(z), -40, 40) * LOGIT_STEPS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(step), pa.array(np.concatenate(lang).astype(np.int32))],
                                             ["y", "step", "lang"])

    counts = examples.rows.where(calib).select("_y", "_text").mapInArrow(told, "y int, step int, lang int") \
        .groupBy("lang", "step", "y").agg(F.count("*").alias("n")).toPandas()
    return model.calibrate(counts["step"].to_numpy() / LOGIT_STEPS, counts["lang"].to_numpy(), counts["y"].to_numpy(),
                           counts["n"].to_numpy())


def toxicity_score(spark: SparkSession, model: Network | float, text: Column) -> Column:
    """The score of a text column; null texts score as empty ones."""
    shared = spark.sparkContext.broadcast(model)

    @arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        enter("toxicity")
        m, out = shared.value, np.zeros(len(texts))
        if isinstance(m, float):
            out[:] = m
        else:
            for row, data, off in text_slices(texts, 1 << 19):
                out[row:row + len(off) - 1] = m.scores(data, off)
        return pa.array(out)

    return score(text.cast("string"))


def score_toxicity(docs: DataFrame, model: Network | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text; a null text scores as the empty one.  A null id stays null, rows that repeat an id
    are scored one by one, an empty table gives no rows."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       toxicity_score(docs.sparkSession, model, F.col(text_col)).alias("score"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents whose score lies below the threshold, all columns as they were.  A null text scores as the empty
    one; rows with null or repeated ids are judged by their own text."""
    name = fresh(docs.columns, "_score")
    score = toxicity_score(docs.sparkSession, fit_toxicity(docs, labels, text_col=text_col), F.col(text_col))
    return docs.withColumn(name, score).where(F.col(name) < threshold).drop(name)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return score_toxicity(docs, fit_toxicity(docs, labels)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
