"""Cost-balanced packing of token ids into sequences.

A document's ids and its end id are cut into pieces of `capacity` ids and a
shorter rest.  A full piece is a sequence by itself.  The rests are dealt by
hash into groups of bounded size, and each group is packed on its own into as
few sequences as its ids need.  The cost of a piece is estimated as linear plus
quadratic in its length (attention stays within a piece).  In descending order
each piece goes to the sequence of least cost that still has room for it; when
none has, the roomiest takes what fits and the remainder is placed again.  So a
group leaves less than one sequence of padding.

Tokenizing: the tokenizer drops white space and never looks across it, so a
text's ids are those of its words in turn.  The distinct words of a batch of
texts are looked up once, and words met before are kept in a store of bounded
size.

Defined results: a null or empty text has the end id alone; repeated rows are
packed as documents of their own; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import chunked

PIECES = "doc_id long, start long, length long, doc_tokens long, ids_crc32 long, ids binary"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"
STORE = 300_000
#: Rests in a group on average: each is shorter than a sequence, so a group's ids are bounded.
GROUP = 2048
#: Cost of a piece of n ids: n + QUADRATIC * n * n.
QUADRATIC = 1 / 4096

#: Words whose ids are found without the tokenizer's own preparation: lower-case ASCII and Latin-1 letters, which it
#: leaves as they are, digits and signs; its contractions begin with an apostrophe, which is none of them.
_PLAIN = re.compile(r"[!-&(-@\[-`a-z{-~\u00e0-\u00f6\u00f8-\u00ff]+").fullmatch
#: How the tokenizer cuts such words.
_PARTS = re.compile(r"[a-z\u00e0-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z\u00e0-\u00f6\u00f8-\u00ff0-9]+").findall
#: Kinds of bytes: blanks 0, lower-case ASCII letters 2, stops 3, all others 1.
_KIND = np.ones(256, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]], _KIND[97:123], _KIND[[44, 46]] = 0, 2, 3


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves, others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}


class WordTokenizer:
    """Ids of texts by a tokenizer that drops white space, word by word."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.code = "H" if self.kind is np.uint16 else "I"
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}  # the last full store; what is met again moves on

    def _part(self, part: str) -> bytes:
        """The ids of one of `_PARTS`."""
        key = part.encode()
        found = self.known.get(key) or self.before.get(key)
        if found is None:
            letters = part if part.isascii() else key.decode("latin-1").translate(self.letters)
            found = array(self.code, [t.id for t in self.model.tokenize(letters)]).tobytes()
        self.known[key] = found
        return found

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of the distinct `words`."""
        known, before, rest = self.known, self.before, []
        out = [known.get(w) for w in words]
        for k, w in enumerate(words):
            if out[k] is not None:
                continue
            if (found := before.get(w)) is not None:
                known[w] = out[k] = found
            elif b"<|" not in w and _PLAIN(x := w.decode()):
                parts = _PARTS(x)
                known[w] = out[k] = self._part(x) if len(parts) == 1 else b"".join([self._part(p) for p in parts])
            else:
                rest.append(k)
        if rest:
            found = self.tokenizer.encode_batch_fast([words[k].decode() for k in rest], add_special_tokens=False)
            for k, e in zip(rest, found, strict=True):
                known[words[k]] = out[k] = array(self.code, e.ids).tobytes()
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as integers of `kind`."""
        parts = [t.encode("utf-8", "replace") for t in texts]
        # The tokenizer lowers anyway; only a special token's name might arise.
        parts = [p if b"<|" in p else p.lower() for p in parts]
        data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
        ends = np.cumsum([len(p) + 1 for p in parts])
        kind = _KIND[data]
        mark = kind != 0
        first = mark.copy()
        first[1:] &= kind[:-1] == 0
        # The tokenizer parts letters from stops, so a word's last stop is a word of its own.
        first[1:-1] |= (kind[1:-1] == 3) & (kind[:-2] == 2) & (kind[2:] == 0)
        offsets = np.append(np.flatnonzero(first[mark]), np.count_nonzero(mark)).astype(np.int32)
        words = pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data[mark])]).dictionary_encode()
        which = words.indices.to_numpy()
        found = self._ids(words.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(found), self.kind)
        length = np.fromiter(map(len, found), np.int64, len(found)) // np.dtype(self.kind).itemsize
        start, n = (np.cumsum(length) - length)[which], length[which]
        upto = np.append(0, np.cumsum(n))
        ids = flat[np.repeat(start - upto[:-1], n) + np.arange(upto[-1])]
        if len(self.known) > STORE:
            self.before, self.known = self.known, {}
        return np.split(ids, upto[np.searchsorted(np.flatnonzero(first), ends[:-1])])


_HELD: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _HELD:
        _HELD[path] = WordTokenizer(path)
    return _HELD[path]


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def cut_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most `capacity` ids; only those that are not full carry their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        end = np.array([end_id], tokenizer.kind)
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), [x or "" for x in batch.column(1).to_pylist()]
            for low, high in chunked(texts, 2 << 20):
                rows = []
                for doc_id, data in zip(doc_ids[low:high], tokenizer.encode(texts[low:high]), strict=True):
                    ids = np.append(data, end)
                    for start in range(0, len(ids), capacity):
                        part = ids[start : start + capacity]
                        full = len(part) == capacity
                        rows.append((doc_id, start, len(part), len(ids), _crc(part), None if full else part.tobytes()))
                kinds = [pa.int64()] * 5 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def balance(lengths: list[int], capacity: int, quadratic: float = QUADRATIC) -> tuple[list[tuple[int, int, int, int]], np.ndarray]:
    """(piece, first id, ids, sequence) of every part, in the order in which each sequence takes them, and costs.

    `lengths` descend.
    """
    room = np.full(max(1, math.ceil(sum(lengths) / capacity)), capacity)
    cost = np.zeros(len(room))
    placed = []
    for piece, left in enumerate(lengths):
        first = 0
        while left:
            fits = room >= left
            if fits.any():
                to, n = int(np.where(fits, cost, np.inf).argmin()), left
            else:
                to = int(room.argmax())
                n = int(room[to])
            placed.append((piece, first, n, to))
            room[to] -= n
            cost[to] += n + quadratic * n * n
            first, left = first + n, left - n
    return placed, cost


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", per_group: int = GROUP) -> DataFrame:
    """One row per piece; see `SCHEMA`.  A sequence's offsets run from 0 without gaps."""
    groups = max(1, math.ceil(docs.count() / per_group))
    wide = _tokenizer(path).kind

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("length", "doc_id", "start", "ids_crc32", "doc_tokens", "ids")), strict=True), key=lambda r: (-r[0], r[1] is None, r[1] or 0, r[2], r[3]))
        whole, rests = [r for r in rows if r[5] is None], [r for r in rows if r[5] is not None]
        placed, cost = balance([r[0] for r in rests], capacity)
        base = key[0].as_py() << 32
        filled = [0] * len(cost)
        out = []
        for piece, first, n, to in placed:
            _, doc_id, start, crc, doc_tokens, data = rests[piece]
            if n < rests[piece][0]:
                crc = _crc(np.frombuffer(data, wide)[first : first + n])
            out.append((doc_id, start + first, n, crc, doc_tokens, base + to, filled[to], float(cost[to])))
            filled[to] += n
        of_full = capacity + QUADRATIC * capacity * capacity
        out += [(r[1], r[2], r[0], r[3], r[4], base + len(cost) + k, 0, of_full) for k, r in enumerate(whole)]
        kinds = [pa.int64()] * 7 + [pa.float64()]
        return pa.table([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    pieces = cut_pieces(docs, path, capacity, end_id, id_col, text_col)
    group = F.pmod(F.xxhash64(F.lit("pack"), "doc_id", "start", "ids_crc32"), F.lit(groups))
    return pieces.withColumn("group", group).groupBy("group").applyInArrow(run, SCHEMA)
