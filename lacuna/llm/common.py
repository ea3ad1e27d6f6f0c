"""What the operators of this subpackage share: cut lineage, chunks of texts, hashed words."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lacuna.sources.tables import cut_lineage as written  # noqa: F401  the operators take it from here


def chunked(texts: Iterable[str | None], limit: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `limit` characters each; a longer text is a range of its own."""
    start = size = at = 0
    for at, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > limit:
            yield start, at
            start, size = at, 0
        size += n + 1
    if size:
        yield start, at + 1


def text_chunks(column: pa.Array, limit: int = 1 << 19) -> Iterator[tuple[int, int, list[str | None]]]:
    """As `chunked`, over a column of texts, by their bytes; only one chunk's texts are Python objects at a time."""
    start = size = 0
    for at, n in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        if size and size + n > limit:
            yield start, at, column.slice(start, at - start).to_pylist()
            start, size = at, 0
        size += n + 1
    if size:
        yield start, len(column), column.slice(start).to_pylist()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_PLACES = 64
_BYTE_AT = mix64(np.arange(1, _PLACES * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_NO_TERM = np.ones(256, bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _NO_TERM[_lo:_hi] = False


class Words:
    """The words of some texts as hashes: `hash` in order, and those of text i at `at[i]:at[i + 1]`.

    Words are runs of bytes between separators: ASCII white space, or with
    `terms` any ASCII character that is no letter or digit.  Texts are taken in
    lower case.  A null text has no words.
    """

    def __init__(self, texts: list[str | None], terms: bool = True):
        parts = [t.lower().encode("utf-8", "replace") if t else b"" for t in texts]
        ends = np.cumsum([len(p) + 1 for p in parts], dtype=np.int64) if parts else np.zeros(0, np.int64)
        self.bytes = data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
        sep = (_NO_TERM if terms else _BLANK)[data]
        edge = np.empty(len(data) + 1, bool)
        edge[0], edge[1:] = ~sep[0], True
        np.not_equal(sep[1:], sep[:-1], out=edge[1:-1])
        edge[-1] = False
        marks = np.flatnonzero(edge)
        self.start, self.end = marks[0::2], marks[1::2]
        self.at = np.concatenate([[0], np.searchsorted(self.start, ends)])
        self.hash = self.part_hash(None)

    def part_hash(self, most: int | None) -> np.ndarray:
        """A hash of each word, or of its first `most` bytes."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        n = self.end - self.start
        if most is not None:
            n = np.minimum(n, most)
        first = np.concatenate([[0], np.cumsum(n)[:-1]])
        place = np.arange(int(n.sum())) - np.repeat(first, n)
        index = place + np.repeat(self.start, n)
        value = _BYTE_AT[(place % _PLACES) * 256 + self.bytes[index]]
        if int(n.max()) > _PLACES:
            value = value * (2 * (place // _PLACES) + 1).astype(np.uint64)
        return mix64(np.add.reduceat(value, first) + n.astype(np.uint64))

    def of(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))


def distinct_in_text(text_no: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, key) pairs by text and key, with how often each occurs; `text_no` ascends."""
    if not len(keys):
        return text_no, keys, np.zeros(0, np.int64)
    order = np.lexsort((keys, text_no))
    keys = keys[order]
    new = np.empty(len(keys), bool)
    new[0] = True
    new[1:] = (keys[1:] != keys[:-1]) | (text_no[1:] != text_no[:-1])
    at = np.flatnonzero(new)
    return text_no[at], keys[at], np.diff(np.append(at, len(keys)))


def runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[object, pa.RecordBatch, bool]]:
    """(value, rows, whether a run begins) of each run of equal values in `key`; one that spans batches comes in parts."""
    last: list = []
    for batch in batches:
        ends = pc.run_end_encode(batch.column(key)) if batch.num_rows else None
        start = 0
        for end, value in zip(ends.run_ends.to_pylist(), ends.values.to_pylist(), strict=True) if ends else ():
            yield value, batch.slice(start, end - start), last != [value]
            start, last = end, [value]


def batches_of(make: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]], schema: str, size: int = 4096) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of batches that yields rows, as one that yields batches of at most `size` rows with these columns."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64())}
    fields = pa.schema([(name, kinds[kind]) for name, kind in map(str.split, schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = make(batches)
        while part := list(islice(rows, size)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), fields, strict=True)], schema=fields)

    return run
