"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams (1 to 3 characters) of the lower-cased text, runs
of anything but letters read as one blank.  Document frequencies are counted
over all rows that teach (labelled, not held out), and over no others; a text's
vector is ``(1 + ln tf) * idf``, scaled to length 1.

The weights are learned by follow-the-regularised-leader with elastic-net
penalties (L1 keeps them sparse) from a bounded sample: the `per_language`
labelled documents of each language with the least hashes.  A fifth of the
sample is held back to fit one temperature, which makes the softmax's largest
share an honest score.

Only the table of document frequencies (a number per hash bin) and the model
leave the executors; both have a size fixed by `BITS` and the languages learned.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
equal texts get equal predictions; labels that are null teach nothing; where no
row teaches, all is ``und``; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 14
ORDERS = (1, 2, 3)
UNKNOWN = "und"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def _classes() -> np.ndarray:
    """For each code point of all planes: its lower case if it is a letter, else a blank."""
    out = np.full(sys.maxunicode + 1, 32, np.uint32)
    for c in range(len(out)):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_FOLD: list[np.ndarray] = []


def bins(text: str) -> np.ndarray:
    """The hash bin of every n-gram of `text`; none if it has no letter."""
    if not _FOLD:
        _FOLD.append(_classes())
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    codes = _FOLD[0][codes]
    letter = codes != 32
    if not letter.any():
        return np.zeros(0, np.uint32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one blank after each run of letters
    codes = np.concatenate([[32], codes[keep], [32]]).astype(np.uint32)
    shift = np.uint32(32 - BITS)
    out, key = [], np.zeros(len(codes), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        key = key[: len(codes) - n + 1] * np.uint32(0x9E3779B1) + codes[n - 1 :] * np.uint32(0x85EBCA77) + np.uint32(n)
        if n in ORDERS:
            out.append((key ^ (key >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> shift)
    return np.concatenate(out)


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The bins of a text's n-grams and how often each occurs."""
    found = bins(text) if text else np.zeros(0, np.uint32)
    if not len(found):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = np.bincount(found, minlength=1 << BITS)
    at = np.flatnonzero(n)
    return at, n[at]


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """In how many texts each bin occurs, and the number of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for t in batch.column(0):
                df[counts(t.as_py())[0]] += 1
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, 1 << BITS)), pa.array(np.append(df[at], n))], names=["bin", "n"])

    df = np.zeros((1 << BITS) + 1, np.int64)
    for row in docs.select(F.col(text_col).alias("text")).mapInArrow(count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():  # a row per bin
        df[row.bin] = row.n
    return df[:-1], int(df[-1])


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # languages x bins
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        x = (1 + np.log(n)) * self.idf[at]
        return x / np.sqrt(x @ x) if len(x) else x

    def logits(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return self.weights[:, at] @ x + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        at, n = counts(text)
        if not len(at) or not self.languages:
            return UNKNOWN, 0.0
        p = softmax(self.logits(at, self.vector(at, n)) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, dims: int, alpha=0.5, beta=1.0, l1=0.02, l2=0.001, epochs=4, seed=7) -> tuple[np.ndarray, np.ndarray]:
    """Weights (classes x dims) and biases by FTRL-proximal; the bias is a feature without penalty."""
    z, n = np.zeros((classes, dims + 1)), np.zeros((classes, dims + 1))

    def weights(at: np.ndarray) -> np.ndarray:
        zs, ns = z[:, at], n[:, at]
        penalty = np.where(at == dims, 0.0, l1)
        w = -(zs - np.sign(zs) * penalty) / ((beta + np.sqrt(ns)) / alpha + l2)
        return np.where(np.abs(zs) > penalty, w, 0.0)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            at, x = np.append(at, dims), np.append(x, 1.0)
            w = weights(at)
            p = softmax(w @ x)
            p[labels[i]] -= 1
            g = p[:, None] * x
            sigma = (np.sqrt(n[:, at] + g * g) - np.sqrt(n[:, at])) / alpha
            z[:, at] += g - sigma * w
            n[:, at] += g * g
    w = weights(np.arange(dims + 1))
    return w[:, :dims], w[:, dims]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, by golden section over its logarithm."""

    def loss(log_t: float) -> float:
        z = logits / np.exp(log_t)
        z = z - z.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), labels]))

    low, high, g = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(50):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(docs: DataFrame, teaches: Column, per_language: int = 1500, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from rows that `teaches` holds for; `per_language` bounds the sample."""
    rows = docs.filter(teaches & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    df, total = document_frequencies(rows, text_col)
    idf = np.log((1 + total) / (1 + df)) + 1
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sample = least_hashes(rows, "lang", rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), per_language)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counts(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in found], pa.list_(pa.int64())), pa.array([x[1] for x in found], pa.list_(pa.int64()))], names=["lang", "draw", "at", "n"])

    rows = sample.select("lang", "draw", "text").mapInArrow(featurise, "lang string, draw double, at array<long>, n array<long>").toArrow()
    rows = sorted(zip(*(rows.column(c).to_pylist() for c in ("lang", "draw")), *([x.values.to_numpy() for x in _lists(rows, c)] for c in ("at", "n")), strict=True), key=lambda r: (r[0], r[1], len(r[2])))
    place: dict[str, int] = {}
    rows = [(lang, k, at, n) for lang, _, at, n in rows if len(at) and (k := place.setdefault(lang, 0)) < per_language and not place.update({lang: k + 1})]
    languages = sorted({r[0] for r in rows})
    model = Model(languages, idf, np.zeros((len(languages), 1 << BITS)), np.zeros(len(languages)))
    if not languages:
        return model
    label = np.array([languages.index(r[0]) for r in rows])
    x = [(at, model.vector(at, n)) for _, _, at, n in rows]
    back = np.array([place % 5 == 0 for _, place, _, _ in rows])
    learn = [i for i in range(len(rows)) if not back[i]] or list(range(len(rows)))
    model.weights, model.bias = fit_ftrl([x[i] for i in learn], label[learn], len(languages), 1 << BITS)
    held = np.flatnonzero(back)
    if len(held):
        model.temperature = fit_temperature(np.array([model.logits(*x[i]) for i in held]), label[held])
    return model


def _lists(table: pa.Table, name: str) -> Iterator[pa.Scalar]:
    for chunk in table.column(name).chunks:
        yield from chunk


def least_hashes(rows: DataFrame, group: str, counts: DataFrame, most: int) -> DataFrame:
    """The rows whose hash of `doc_id`, as a `draw` from 0 to 1, lies in the share that leaves about `most` of each group.

    `counts`: (group, n).  No group meets in one task; a few more than `most` may come.
    """
    share = counts.select(F.col(group), (F.lit(1.0) * most + 4 * most**0.5).alias("want"), "n")
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), "doc_id"), 11) / F.lit(float(2**53))
    rows = rows.withColumn("draw", draw).join(F.broadcast(share), group)  # a row per group
    return rows.filter(F.col("draw") <= F.col("want") / F.col("n")).drop("want", "n")


def predict(docs: DataFrame, model: Model, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document; see `SCHEMA`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BITS and the languages bound it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = [m.predict(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def remainder(id_col: str, by: int) -> Column:
    """crc32 of the id's decimal text, modulo `by`; of a null id that of no text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(by))


def keep_known(docs: DataFrame, teaches: Column, least_score: float = 0.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of `docs`, all columns, whose language is told with a score of `least_score` or more; text without letters goes."""
    model = train(docs, teaches, id_col=id_col, text_col=text_col, lang_col=lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def known(text: pd.Series) -> pd.Series:
        found = [shared.value.predict(t if isinstance(t, str) else None) for t in text]
        return pd.Series([x[0] != UNKNOWN and x[1] >= least_score for x in found], dtype=bool)

    return docs.filter(known(F.col(text_col)))
