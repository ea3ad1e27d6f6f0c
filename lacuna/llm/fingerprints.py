"""I-Match: documents as their mid-frequency terms under several randomised lexicons.

The lexicon holds the terms whose share of documents lies within a band, that
is, whose inverse document frequency does.  As a document has a bounded number
of distinct terms on average, at most (that number / the band's lower end) terms
can be that frequent, however large the corpus: the lexicon is of bounded size, 8 bytes
a term where it is sent out, and the same terms are in it at every size.  A
fingerprint is the hash of a text's distinct terms, sorted, under

* the whole lexicon (one place): equal only for equal sets of terms;
* `LARGE` random lexicons that keep each term with probability `KEEP`: any of
  them still agrees where the terms that differ are not in it;
* `SMALL` random lexicons to which the terms are dealt, each to one, so that a
  few changed terms change a few places.

So no term is left out, and a text with a term of the lexicon has a place that
is not empty; one without a term of the text is written as zeros.

Likeness of two fingerprints: the share of places that agree among those where
either is not empty; where all are empty, 1 if the fingerprints are equal.  A
fingerprint also has a hash of the text itself for the case of no term at all.

The next document of each: rows are ranged by descending id, a partition passes
its rows on in order, and only a first and a last row per partition are matched
across partitions.

Defined results: a null text is empty; a text without lexicon terms gets zeros;
equal texts have equal fingerprints; null ids come last and repeated ids stand
in a fixed order of their texts; a single document is followed by itself; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.common import Words, chunked, distinct_in_text, mix64, written

LARGE, KEEP, SMALL = 8, 3 / 4, 119
SUBSETS = 1 + LARGE + SMALL
#: The band: terms in at least one of 2,000 and at most one of 5 documents.
LOW, HIGH = 1 / 2000, 1 / 5
#: Terms up to which a task keeps the random lexicons of each term; of more, it works out those of the terms it meets.
KEPT_TERMS = 4_000_000
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_EDGES = SCHEMA + ", edge string, part int, text string"


def build_lexicon(docs: DataFrame, text_col: str, low: float, high: float) -> np.ndarray:
    """The sorted hashes of all terms within the band, from counts over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            found = []
            for a, b in chunked(texts, 1 << 22):
                words = Words(texts[a:b])
                found.append(distinct_in_text(words.of(), words.hash)[1])
            terms, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n)], names=["term", "n"])

    total = docs.count()
    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    kept = written(counted.filter(F.col("n").between(max(2.0, low * total), max(2.0, high * total))), "lexicon")
    return np.sort(kept.select("term").toArrow().column("term").to_numpy().view(np.uint64))  # at most the mean number of distinct terms / low


class Lexicon:
    """The terms, and for each the random lexicons that it is in."""

    def __init__(self, terms: np.ndarray, large: int = LARGE, small: int = SMALL, seed: int = 5):
        self.terms, self.large, self.small = terms, large, small
        self.subsets = 1 + large + small
        self.keys = mix64(np.arange(seed, seed + large + 1, dtype=np.uint64))
        self.kept = (self.dealt_to(terms), [self.inside(terms, k) for k in range(large)]) if len(terms) <= KEPT_TERMS else None

    def dealt_to(self, terms: np.ndarray) -> np.ndarray:
        """The small lexicon that each term is in."""
        return (mix64(terms + self.keys[0]) % np.uint64(self.small)).astype(np.int64)

    def inside(self, terms: np.ndarray, k: int) -> np.ndarray:
        """Whether each term is in the k-th large one."""
        return mix64(terms + self.keys[1 + k]) < np.uint64(int(KEEP * 2**64))

    def places(self, texts: list[str]) -> np.ndarray:
        """For each text and random lexicon the hash of the sorted distinct terms; 0 where there is none."""
        out = np.zeros((len(texts), self.subsets), np.uint64)
        words = Words(texts)
        if not len(words.hash) or not len(self.terms):
            return out
        at = np.minimum(np.searchsorted(self.terms, words.hash), len(self.terms) - 1)
        hit = self.terms[at] == words.hash
        pairs = np.unique(words.of()[hit] * len(self.terms) + at[hit])  # by text, then term: sorted and distinct
        text, term = pairs // len(self.terms), pairs % len(self.terms)
        value = self.terms[term]
        out[:, 0] = _hashes(text, value, len(texts))
        for k in range(self.large):
            kept = self.kept[1][k][term] if self.kept else self.inside(value, k)
            out[:, 1 + k] = _hashes(text[kept], value[kept], len(texts))
        cell = text * self.small + (self.kept[0][term] if self.kept else self.dealt_to(value))
        order = np.argsort(cell, kind="stable")  # within a place the terms stay sorted
        out[:, 1 + self.large :] = _hashes(cell[order], value[order], len(texts) * self.small).reshape(-1, self.small)
        return out


def _hashes(cell: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """The hash of each cell's values in their order; 0 where there are none.  `cell` ascends."""
    out = np.zeros(n, np.uint64)
    if len(cell):
        new = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        rank = np.arange(len(cell)) - np.repeat(new, np.diff(np.append(new, len(cell))))
        total = np.add.reduceat(mix64(value + mix64(rank.astype(np.uint64) + np.uint64(1))), new)
        out[cell[new]] = mix64(total) | np.uint64(1)
    return out


def _hex(places: np.ndarray, text: str) -> str:
    whole = hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).hexdigest() if not places.any() else ""
    short = np.maximum(places >> np.uint64(32), (places != 0).astype(np.uint64))  # zeros are for empty places
    return short.astype(">u4").tobytes().hex() + whole


def likeness(a: str, b: str, subsets: int = SUBSETS) -> float:
    """Of two fingerprints; 0 to 1."""
    x, y = (np.frombuffer(bytes.fromhex(s[: 8 * subsets]), ">u4") for s in (a, b))
    some = (x != 0) | (y != 0)
    return float((x == y)[some].mean()) if some.any() else float(a == b)


def _finish(rows: list, nexts: list, lexicon: Lexicon) -> list[tuple]:
    """Result rows of (doc_id, text, fingerprint) followed by `nexts`."""
    edited = []
    for (_, text, _), (_, after, _) in zip(rows, nexts, strict=True):
        k = len(text) // 3
        edited.append(text[: len(text) - k] + after[:k])
    marks = []
    for a, b in chunked(edited):
        marks += [_hex(p, t) for p, t in zip(lexicon.places(edited[a:b]), edited[a:b], strict=True)]
    return [
        (r[0], len(r[1]), hashlib.sha256(e.encode("utf-8", "replace")).hexdigest(), r[2], mark, likeness(r[2], mark), likeness(r[2], n[2]))
        for r, n, e, mark in zip(rows, nexts, edited, marks, strict=True)
    ]


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def fingerprint(docs: DataFrame, low: float = LOW, high: float = HIGH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document; see `SCHEMA`."""
    spark = docs.sparkSession
    lexicon = spark.sparkContext.broadcast(Lexicon(build_lexicon(docs, text_col, low, high)))  # at most the mean number of distinct terms / low

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts compressed one by one: they are shuffled whole."""
        press = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([press(t.as_py().encode("utf-8", "replace")) for t in batch.column(1)], pa.binary())], names=["doc_id", "packed"])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All rows but the last of a partition finished; its first and last row as edges."""
        from pyspark import TaskContext

        part, last = TaskContext.get().partitionId(), None
        undo = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [undo(x).decode() for x in batch.column(1).to_pylist()]
            for a, b in chunked(texts):
                marks = [_hex(p, t) for p, t in zip(lexicon.value.places(texts[a:b]), texts[a:b], strict=True)]
                rows = list(zip(ids[a:b], texts[a:b], marks, strict=True))
                if last is None:
                    yield _table([(None, None, None, rows[0][2], None, None, None, "first", part, rows[0][1])], _EDGES)
                else:
                    rows.insert(0, last)
                last = rows[-1]
                if len(rows) > 1:
                    yield _table([(*r, None, None, None) for r in _finish(rows[:-1], rows[1:], lexicon.value)], _EDGES)
        if last is not None:
            yield _table([(last[0], None, None, last[2], None, None, None, "last", part, last[1])], _EDGES)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _table(_finish([(row["doc_id"], row["text"], row["fingerprint"])], [(None, row["next_text"], row["next_fingerprint"])], lexicon.value), SCHEMA)

    ordered = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .mapInArrow(squeeze, "doc_id long, packed binary").repartitionByRange(F.desc("doc_id")).sortWithinPartitions(F.desc("doc_id"), "packed")
    )
    done = written(ordered.mapInArrow(within, _EDGES), "fingerprints")
    edges = done.filter("edge IS NOT NULL")
    # A first and a last row per partition: the order of the partitions is a small table.
    lasts, firsts = edges.filter("edge = 'last'"), edges.filter("edge = 'first'")
    order = firsts.select("part").withColumn("next_part", F.lead("part").over(Window.orderBy("part")))
    order = order.withColumn("next_part", F.coalesce("next_part", F.min("part").over(Window.partitionBy())))
    pairs = (
        lasts.select("part", "doc_id", "text", "fingerprint").join(order, "part")
        .join(firsts.select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint")), "next_part")
        .select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint")
    )
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return done.filter("edge IS NULL").select(*names).unionByName(pairs.mapInArrow(across, SCHEMA))
