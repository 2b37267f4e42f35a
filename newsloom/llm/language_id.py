"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of two and three code points: letters in lower case, everything else as a
space, no n-gram across two spaces. A feature's value is its share of the text's n-grams times its
inverse document frequency, which is counted over all documents learned from. Weights are trained with
FTRL-proximal (per-coordinate rates; elastic net: an L1 penalty that keeps most weights at zero and an
L2 penalty) on a bounded, hash-chosen sample of labelled rows, at most `sample` distinct texts of each language,
dealt by number to SHARDS Spark tasks whose weights are averaged. A second sample, at most `calibration` other texts of
each language, sets one temperature by which scores are divided, so that they are calibrated probabilities.

Defined cases: a null text, or one without a letter, is `und` with score 0, and so is every text if no
row is labelled; a null lang is never learned from; a null doc_id isn't held out; ties go to the first
language by name; rows are judged one by one, so repeated rows agree; an empty table gives an empty
result; extra columns are ignored. Whole texts are read, in blocks.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.bytegrid import blocks, mix
from newsloom.llm.rows import distinct_sample, remainder
from newsloom.session import ship

BITS = 15
SHARDS = 4
GRAMS = (2, 3)
#: Feature values are about one after this.
SCALE = 50.0


@lru_cache(maxsize=1)
def _folding() -> np.ndarray:
    """All code points up to 0xFFFF: letters in lower case, everything else a space. Marks and joiners inside words stay."""
    fold = np.full(1 << 16, 32, np.uint32)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            fold[i] = ord(low) if len(low) == 1 else i
        elif unicodedata.category(c)[0] == "M":
            fold[i] = i
    return fold


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(feature, first feature of each text): hashed n-grams in text order; the second has one more entry."""
    points = [t.decode("utf-8", "replace").encode("utf-32-le") for t in texts]
    size = np.array([len(p) // 4 for p in points], np.int64)
    # Three spaces between texts: no n-gram crosses them.
    c = np.frombuffer(b"".join(x + b" \0\0\0" * 3 for x in points), np.uint32).copy()
    low = c < 1 << 16
    c[low] = _folding()[c[low]]
    end = np.cumsum(size + 3)
    space = c == 32
    double = np.zeros(len(c), bool)
    double[:-1] = space[:-1] & space[1:]
    x = c.astype(np.uint64)
    out, where = [], []
    for n in GRAMS:
        m = len(c) - n + 1
        if m <= 0:
            continue
        h, bad = np.zeros(m, np.uint64), np.zeros(m, bool)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + x[k : k + m]
            if k:
                bad |= double[k - 1 : k - 1 + m]
        at = np.flatnonzero(~bad)
        out.append((mix(h[at], 50 + n) >> np.uint64(64 - BITS)).astype(np.int32))
        where.append(at)
    if not out:
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    at, f = np.concatenate(where), np.concatenate(out)
    order = np.argsort(at, kind="stable")
    at, f = at[order], f[order]
    return f, np.concatenate([[0], np.searchsorted(at, end)])


def _df(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << BITS, np.int64)
    rows = 0
    for _, texts in blocks(batches):
        f, first = grams(texts)
        for i in range(len(texts)):
            total += np.bincount(f[first[i] : first[i + 1]], minlength=1 << BITS) > 0
        rows += len(texts)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], rows))], ["feature", "df"])


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in blocks(batches):
        f, first = grams(texts)
        idx, val = [], []
        for i in range(len(texts)):
            u, n = np.unique(f[first[i] : first[i + 1]], return_counts=True)
            idx.append(u.astype(np.int32))
            val.append((n / max(1, n.sum())).astype(np.float32))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(idx, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.float32()))], ["label", "shard", "idx", "tf"])


@dataclass
class Ftrl:
    """FTRL-proximal for a softmax of `classes` over 2**BITS features and a bias."""

    classes: int
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.01

    def __post_init__(self) -> None:
        self.z = np.zeros(((1 << BITS) + 1, self.classes))
        self.n = np.zeros_like(self.z)

    def weights(self, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def learn(self, idx: np.ndarray, x: np.ndarray, label: int) -> None:
        idx, x = np.append(idx, 1 << BITS), np.append(x, 1.0)
        w = self.weights(idx)
        p = softmax(x @ w)
        p[label] -= 1.0
        g = x[:, None] * p
        n = self.n[idx]
        more = n + g * g
        self.z[idx] += g - (np.sqrt(more) - np.sqrt(n)) / self.alpha * w
        self.n[idx] = more


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Model:
    """`gain` holds idf * weight * SCALE by feature and language; scores are divided by `temperature`."""

    langs: list[str]
    gain: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def scores(self, texts: list[bytes]) -> np.ndarray:
        f, first = grams(texts)
        n = np.diff(first)
        out = np.zeros((len(texts), len(self.langs)))
        for c in range(len(self.langs)):
            sums = np.concatenate([[0.0], np.cumsum(self.gain[c][f], dtype=np.float64)])
            out[:, c] = (sums[first[1:]] - sums[first[:-1]]) / np.maximum(n, 1)
        return out + self.bias


def _train(classes: int, idf: np.ndarray, epochs: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        model = Ftrl(classes)
        rng = np.random.default_rng(int(key[0]))
        data = [(np.asarray(i), np.asarray(t) * idf[np.asarray(i)] * SCALE, int(y)) for i, t, y in zip(rows["idx"], rows["tf"], rows["label"], strict=True) if len(i)]
        data.sort(key=lambda r: (len(r[0]), r[2], float(r[1].sum())))  # the rows' order in the shuffle is left to chance
        for _ in range(epochs):
            for k in rng.permutation(len(data)):
                model.learn(*data[k])
        return pd.DataFrame({"shard": [key[0]], "rows": [len(data)], "weights": [model.weights().astype(np.float32).tobytes()]})

    return run


def _logits(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(model.scores(texts)), pa.list_(pa.float64()))], ["label", "scores"])

    return run


def fitted_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search over its logarithm."""

    def loss(log_t: float) -> float:
        p = softmax(scores / np.exp(log_t))
        return float(-np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean())

    a, b, g = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(40):
        x, y = b - g * (b - a), a + g * (b - a)
        a, b = (a, y) if loss(x) <= loss(y) else (x, b)
    return float(np.exp((a + b) / 2))


def held_out(modulus: int = 4, slot: int = 2):
    return F.coalesce(remainder(modulus) == slot, F.lit(False))


def fit(docs: DataFrame, sample: int = 2000, calibration: int = 500, epochs: int = 2) -> Model | None:
    """Train on the rows of `docs` that have a lang; None if there are none."""
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter("lang is not null")
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row for each language
    if not counts:
        return None
    langs = sorted(counts)
    found = rows.select("text").mapInArrow(_df, "feature long, df long").groupBy("feature").agg(F.sum("df").alias("df")).toArrow()
    feature, df = found["feature"].to_numpy(), found["df"].to_numpy()
    idf = np.ones(1 << BITS)
    n = int(df[feature < 0].sum())
    idf[feature[feature >= 0]] = df[feature >= 0]
    idf = np.log((1 + n) / (1 + idf)) + 1.0

    # Of each language's distinct texts, the first are learned from, and at least a fifth are left to calibrate on.
    picked = distinct_sample(rows, sample + calibration, "lang")
    label = F.create_map(*[F.lit(x) for i, k in enumerate(langs) for x in (k, i)])[F.col("by")].cast("int").alias("label")
    upto = F.least(F.lit(sample), F.ceil(F.col("of") * 0.8))
    taken = picked.filter(F.col("turn") <= upto).select(label, (F.col("turn") % SHARDS).cast("int").alias("shard"), "text")
    trained = taken.mapInArrow(_sparse, "label int, shard int, idx array<int>, tf array<float>").groupBy("shard").applyInPandas(_train(len(langs), idf, epochs), "shard int, rows long, weights binary").collect()
    rows_in = sum(r.rows for r in trained)
    if not rows_in:
        return None
    w = sum(np.frombuffer(r.weights, np.float32).reshape(-1, len(langs)).astype(float) * (r.rows / rows_in) for r in sorted(trained, key=lambda r: r.shard))
    model = Model(langs, np.ascontiguousarray((w[:-1] * idf[:, None] * SCALE).T.astype(np.float32)), w[-1])
    check = picked.filter((F.col("turn") > upto) & (F.col("turn") <= upto + calibration)).select(label, "text")
    held = check.mapInArrow(_logits(model), "label int, scores array<double>").toArrow()
    if held.num_rows:
        model.temperature = fitted_temperature(np.array(held["scores"].to_pylist()), held["label"].to_numpy())
    return model


def _predict(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            letter = np.array(batch.column(2).fill_null(False).to_pylist(), bool)
            lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            if model is not None and letter.any():
                p = softmax(model.scores(texts) / model.temperature)
                best = p.argmax(axis=1)
                lang[letter] = np.array(model.langs, object)[best[letter]]
                score[letter] = np.clip(p[np.arange(len(best)), best][letter], 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def predictions(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row."""
    ship(docs.sparkSession)
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letter"), text.alias("text"))
    return rows.mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double")


def identified(docs: DataFrame, **options: int) -> DataFrame:
    """Learn from the rows that aren't held out, and predict all."""
    ship(docs.sparkSession)
    return predictions(docs, fit(docs.filter(~held_out()), **options))
