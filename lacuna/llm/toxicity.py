"""Toxicity by a factorization machine over hashed terms.

The score of a text with the set S of hashed terms is the logistic of
``w0 + sum w[i] + sum over pairs <v[i], v[j]>`` (i < j in S), so two terms that
say little alone, an insult and the mention of a group, may say much together,
which additive weights miss.  Terms are words and their first four to six
bytes, in lower case; the latter carry over to compounds.

Weights are learned on the driver from a bounded sample: the `per_label`
labelled documents of each label with the least hashes.  Only terms take part
that stand in `least_texts` texts of the sample and whose chi-square against
the label is at least `least_chi2`, at most `MOST_TERMS` of them, so chance
terms of long texts stay silent.  The executors count the terms, and send for
each text of the sample only those that take part: at most
2 x `per_label` x `MOST_TERMS` numbers, however long the texts are.
AdaGrad with an L1 penalty on the weights and an L2 penalty on the factors.

Only the model leaves the driver; its size is fixed by `BITS` and `RANK`.

Defined results: a null or empty text scores the logistic of w0; equal texts
get equal scores; labels that are null teach nothing; where no row teaches, or
only one label, the score is the share of label 1 (0 without rows); an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import Words, chunked, text_chunks, written
from lacuna.llm.language_id import least_hashes

BITS, RANK = 18, 8
#: Terms that may take part; of more, those with the largest chi-square.
MOST_TERMS = 4096
PREFIXES = (4, 5, 6)
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct bins of all texts, text by text, and where each text's begin (one more at the end)."""
    words = Words(texts)
    if not len(words.hash):
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    shift = np.uint64(64 - BITS)
    kinds = [words.hash, *(words.part_hash(n) * np.uint64(2 * n + 1) for n in PREFIXES)]
    bins = np.concatenate([k >> shift for k in kinds])
    # One integer sort finds the distinct pairs: the text in the high bits, the bin in the low ones.
    pairs = (np.tile(words.of().astype(np.uint64), len(kinds)) << np.uint64(BITS)) | bins
    pairs = np.unique(pairs)
    at = np.searchsorted(pairs >> np.uint64(BITS), np.arange(len(texts) + 1, dtype=np.uint64))
    return (pairs & np.uint64((1 << BITS) - 1)).astype(np.int64), at


@dataclass
class Machine:
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def scores(self, texts: list[str | None]) -> np.ndarray:
        bins, at = features(texts)
        live = self.weight[bins] != 0
        live |= self.factor[bins].any(axis=1)
        bins, owner = bins[live], np.repeat(np.arange(len(texts)), np.diff(at))[live]
        linear = np.bincount(owner, self.weight[bins], len(texts))
        pair = np.zeros(len(texts))
        for f in range(self.factor.shape[1]):
            v = self.factor[bins, f]
            pair += np.bincount(owner, v, len(texts)) ** 2 - np.bincount(owner, v * v, len(texts))
        return logistic(self.bias + linear + pair / 2)


def logistic(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def telling_terms(ones: np.ndarray, zeros: np.ndarray, n1: float, n0: float, least_texts: int = 4, least_chi2: float = 15.0) -> np.ndarray:
    """The bins that take part, in order, from how many texts of each label they stand in."""
    if not n1 or not n0:
        return np.zeros(0, np.int64)
    rest = np.maximum((ones + zeros) * (n1 + n0 - ones - zeros), 1)
    chi2 = (n1 + n0) * (ones * (n0 - zeros) - zeros * (n1 - ones)) ** 2 / (rest * n1 * n0)
    at = np.flatnonzero((ones + zeros >= least_texts) & (chi2 >= least_chi2))
    return np.sort(at[np.argsort(-chi2[at], kind="stable")[:MOST_TERMS]])


def fit(rows: list[np.ndarray], labels: np.ndarray, epochs: int = 12, rate: float = 0.1, l1: float = 1e-4, l2: float = 1e-3, seed: int = 11) -> Machine:
    """A machine from sets of bins and their 0/1 labels."""
    dims = 1 << BITS
    share = float(labels.mean()) if len(labels) else 0.0
    w, v = np.zeros(dims), np.zeros((dims, RANK), np.float32)
    if share in (0.0, 1.0):
        return Machine(float(np.clip(np.log((share + 1e-9) / (1 - share + 1e-9)), -40, 40)), w.astype(np.float32), v)
    rng = np.random.default_rng(seed)
    used = np.unique(np.concatenate(rows))
    v[used] = rng.normal(0, 0.01, (len(used), RANK))
    bias, gb, gw, gv = np.log(share / (1 - share)), 1e-6, np.full(dims, 1e-6), np.full((dims, RANK), 1e-6, np.float32)
    weight_of = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))  # both labels count alike
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at = rows[i]
            total = v[at].sum(axis=0)
            z = bias + w[at].sum() + ((total @ total) - (v[at] ** 2).sum()) / 2
            g = float((logistic(z) - labels[i]) * weight_of[i])
            gb += g * g
            bias -= rate * g / np.sqrt(gb)
            if not len(at):
                continue
            gw[at] += g * g
            step = rate / np.sqrt(gw[at])
            x = w[at] - step * g
            w[at] = np.sign(x) * np.maximum(np.abs(x) - step * l1, 0)
            grad = g * (total - v[at]) + l2 * v[at]
            gv[at] += grad * grad
            v[at] -= rate * 0.2 * grad / np.sqrt(gv[at])
    return Machine(float(bias), w.astype(np.float32), v)


def train(docs: DataFrame, labels: DataFrame, teaches: Column, per_label: int = 4000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Machine:
    """A machine from the labelled rows that `teaches` (of the id) holds for; `per_label` bounds the sample."""
    marks = labels.filter(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    marks = marks.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))  # an id labelled twice counts once
    marks = marks.filter(teaches)
    chosen = least_hashes(marks, "label", marks.groupBy("label").agg(F.count(F.lit(1)).alias("n")), per_label)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sample = texts.join(F.broadcast(chosen), "doc_id")  # two labels x per_label rows

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_chunks(batch.column(2)):
                bins, at = features(texts)
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(bins, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), lists], names=["label", "draw", "bins"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, dims + 1), np.int64)  # the last place counts texts
        for batch in batches:
            label = batch.column(0).to_numpy()
            lists = batch.column(1)
            of = np.repeat(label, np.diff(lists.offsets.to_numpy()))
            np.add.at(n, (of, lists.values.to_numpy()), 1)
            np.add.at(n, (label, dims), 1)
        at, bin_ = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(bin_), pa.array(n[at, bin_])], names=["label", "bin", "n"])

    dims = 1 << BITS
    held = written(sample.select("label", "draw", "text").mapInArrow(featurise, "label int, draw double, bins array<int>"), "terms")
    counted = held.select("label", "bins").mapInArrow(count, "label int, bin long, n long").groupBy("label", "bin").agg(F.sum("n").alias("n")).toArrow()  # two rows per bin
    n = np.zeros((2, dims + 1))
    n[counted.column("label").to_numpy(), counted.column("bin").to_numpy()] = counted.column("n").to_numpy()
    terms = telling_terms(n[1, :dims], n[0, :dims], n[1, dims], n[0, dims])
    part = held.select("label", "draw", F.array_intersect("bins", F.lit(terms.tolist()).cast("array<int>")).alias("bins"))
    table = part.toArrow()  # per_label texts of each label with at most MOST_TERMS numbers
    rows = sorted(zip(table.column("label").to_pylist(), table.column("draw").to_pylist(), (np.sort(x.values.to_numpy()).astype(np.int64) for c in table.column("bins").chunks for x in c), strict=True), key=lambda r: (r[0], r[1], len(r[2]), r[2].tobytes()))
    rows = [r for label in (0, 1) for r in [x for x in rows if x[0] == label][:per_label]]
    return fit([r[2] for r in rows], np.array([r[0] for r in rows], np.int64))


def score(docs: DataFrame, machine: Machine, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document; see `SCHEMA`."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # BITS and RANK bound it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.concatenate([np.zeros(0), *(shared.value.scores(texts) for _, _, texts in text_chunks(batch.column(2)))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64()), pa.array((found >= 0.5).astype(np.int32))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def keep_civil(docs: DataFrame, labels: DataFrame, teaches: Column, limit: float = 0.5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows of `docs`, all columns, that score below `limit`."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, teaches, id_col=id_col, text_col=text_col, label_col=label_col))

    @F.pandas_udf("boolean")
    def civil(text: pd.Series) -> pd.Series:
        texts = [t if isinstance(t, str) else None for t in text]
        found = np.concatenate([shared.value.scores(texts[a:b]) for a, b in chunked(texts)]) if texts else np.zeros(0)
        return pd.Series(found < limit)

    return docs.filter(civil(F.col(text_col)))
