"""Byte-level BPE by padded numpy matrices, and decoding.

A text is cut by the vocabulary's pattern and each piece is encoded by itself.
The distinct pieces of a batch are dealt into buckets of like length; a bucket
is a matrix with one piece per row, padded at the right.  In each round every
row looks up the ranks of all its neighbouring pairs in a hash table, merges
its leftmost pair of least rank, and closes the gap; rows without a known pair
leave.  As ranks are ids, that gives what the usual encoder gives.

A long piece is first parted where no token of the vocabulary can reach across:
every token that does would hold the two bytes there alone, or with one more at
either side, so a table of the three-byte strings in tokens tells.  A part that
is still long would need a round over its whole width for each merge, so its
pairs wait in a heap by rank and place, and only the neighbours of a merge change.

Pieces met before are kept in a store of bounded size, which only saves work.

Defined results: a null text is empty; an empty text has no ids (the hash of no
bytes); equal texts get equal rows; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import chunked, mix64

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Pieces in store, and the most cells of one matrix.
STORE, CELLS = 300_000, 1 << 20
#: Bytes of a piece from which it is parted, and beyond which it is not kept in store.
LONG = 64
WIDTHS = (2, 4, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64)
_NONE = np.int32(2**31 - 1)


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks in a file of lines with a base64 token and its rank."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


class PairTable:
    """Open addressing over pairs of ids: what a pair merges to, or nothing."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = [(ranks[t[:k]], ranks[t[k:]], rank) for t, rank in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        left, right, merged = np.array(pairs, np.int64).reshape(-1, 3).T
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(left)) * 3))))
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.value = np.full(1 << self.bits, _NONE, np.int32)
        key = (left << 32) | right
        at = self._slot(key)
        todo = np.arange(len(key))
        self.probes = 0
        while len(todo):  # one pair takes each free slot; the others go on to the next
            self.probes += 1
            free = self.key[at[todo]] == -1
            here = todo[free]
            self.key[at[here]] = key[here]
            won = here[self.key[at[here]] == key[here]]
            self.value[at[won]] = merged[won]
            lost = self.key[at[todo]] != key[todo]
            todo = todo[lost]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (mix64(key.view(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; the largest int32 where there is none."""
        key = (left.astype(np.int64) << 32) | right
        at = self._slot(key)
        found = self.key[at]
        out = np.where(found == key, self.value[at], _NONE)
        open_ = np.flatnonzero((found != key) & (found != -1))
        for _ in range(1, self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found = self.key[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.value[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.pairs = PairTable(ranks)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.token = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token
        self.within: np.ndarray | None = None  # for long pieces, made when the first comes
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}  # the last full store; what is met again moves on

    def merge_rows(self, ids: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """`ids`: a row per piece, -1 beyond its `length`.  The merged rows and lengths."""
        ids, length = ids.copy(), length.copy()
        live = np.flatnonzero(length > 1)
        rows, n = ids[live], length[live]
        rank = np.full((len(rows), max(0, ids.shape[1] - 1)), _NONE, np.int32)
        if rank.size:
            real = np.arange(rank.shape[1]) < (n - 1)[:, None]
            rank[real] = self.pairs(rows[:, :-1][real], rows[:, 1:][real])
        while len(live):
            at = rank.argmin(axis=1)  # the leftmost of the least
            least = rank[np.arange(len(at)), at]
            done = least == _NONE
            if done.any():
                ids[live[done]], length[live[done]] = -1, n[done]
                ids[live[done], : rows.shape[1]] = rows[done]
                keep = ~done
                live, rows, n, rank, at, least = live[keep], rows[keep], n[keep], rank[keep], at[keep], least[keep]
                if not len(live):
                    break
                width = int(n.max())
                rows, rank = rows[:, :width], rank[:, : max(1, width - 1)]
            every = np.arange(len(live))
            places = np.arange(rows.shape[1])
            gone = places[None, :] > at[:, None]  # these take their right neighbour's value
            moved = np.concatenate([rows[:, 1:], np.full((len(rows), 1), -1, np.int32)], axis=1)
            rows = np.where(gone, moved, rows)
            rows[every, at] = least
            n = n - 1
            late = np.concatenate([rank[:, 1:], np.full((len(rank), 1), _NONE, np.int32)], axis=1)
            rank = np.where(gone[:, : rank.shape[1]], late, rank)
            rank[every, np.minimum(at, rank.shape[1] - 1)] = _NONE
            for shift in (0, -1):  # only the two pairs beside the merged one are new
                p = at + shift
                ok = (p >= 0) & (p < n - 1)
                rank[every[ok], p[ok]] = self.pairs(rows[every[ok], p[ok]], rows[every[ok], p[ok] + 1])
        return ids, length

    def _prepare_long(self) -> None:
        """`within`: the three-byte strings in tokens; `two`: two-byte tokens; `merged`: what a pair merges to."""
        held = self.pairs.key >= 0
        self.merged = dict(zip(self.pairs.key[held].tolist(), self.pairs.value[held].tolist(), strict=True))
        self.within, self.two = np.zeros(1 << 24, bool), np.zeros(1 << 16, bool)
        data = np.frombuffer(b"".join(self.token), np.uint8).astype(np.int64)
        ends = np.cumsum([len(t) for t in self.token])
        triple = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
        whole = np.ones(len(triple), bool)
        for back in (1, 2):  # those that run over the end of a token are none
            at = ends - back
            whole[at[(at >= 0) & (at < len(whole))]] = False
        self.within[triple[whole]] = True
        pairs = [t[0] << 8 | t[1] for t in self.token if len(t) == 2]
        self.two[pairs] = True

    def part_long(self, piece: bytes) -> list[bytes]:
        """`piece` in parts that no merge joins."""
        if self.within is None:
            self._prepare_long()
        data = np.frombuffer(piece, np.uint8).astype(np.int64)
        crossed = self.two[(data[:-1] << 8) | data[1:]]
        hit = self.within[(data[:-2] << 16) | (data[1:-1] << 8) | data[2:]]
        crossed[:-1] |= hit
        crossed[1:] |= hit
        cuts = [0, *(np.flatnonzero(~crossed) + 1).tolist(), len(piece)]
        return [piece[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def merge_long(self, piece: bytes) -> bytes:
        """The ids of one long part: the leftmost pair of least rank is merged again and again."""
        first = self.of_byte[np.frombuffer(piece, np.uint8)]
        rank = self.pairs(first[:-1], first[1:])
        some = np.flatnonzero(rank != _NONE)
        heap = np.sort((rank[some].astype(np.int64) << 32) | some).tolist()  # sorted, so a heap
        ids, rank = first.tolist(), rank.tolist()
        n, none, merged = len(ids), int(_NONE), self.merged
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank.append(none)
        while heap:
            x = heapq.heappop(heap)
            r, p = x >> 32, x & 0xFFFFFFFF
            if rank[p] != r:
                continue  # its pair has changed since
            gone = after[p]
            ids[p], rank[gone] = r, none
            q = after[p] = after[gone]
            ids[gone] = -1
            if q < n:
                before[q] = p
            for left in (before[p], p):
                right = after[left] if left >= 0 else n
                if right < n:
                    new = rank[left] = merged.get(ids[left] << 32 | ids[right], none)
                    if new != none:
                        heapq.heappush(heap, new << 32 | left)
                elif left >= 0:
                    rank[left] = none
        return np.array([i for i in ids if i >= 0], np.int32).tobytes()

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as 32-bit integers."""
        # A piece that is itself a token is that token, whether or not merges lead to it.
        out = [np.int32(self.ranks[p]).tobytes() if p in self.ranks else b"" for p in pieces]
        long = [i for i, p in enumerate(pieces) if len(p) >= LONG and not out[i]]
        if long:
            parts = [self.part_long(pieces[i]) for i in long]
            short = list({p for x in parts for p in x if len(p) < LONG})
            found = dict(zip(short, self._by_merges(short, [b""] * len(short)), strict=True))
            for i, x in zip(long, parts, strict=True):
                out[i] = b"".join([found.get(p) or self.merge_long(p) for p in x])
        return self._by_merges(pieces, out)

    def _by_merges(self, pieces: list[bytes], out: list[bytes]) -> list[bytes]:
        """Fills what is empty in `out`."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(size, kind="stable")
        order = order[np.fromiter((not x for x in out), bool, len(out))[order]]
        ordered = size[order]
        low = 0
        for width in (*WIDTHS, *(1 << k for k in range(7, 40))):
            if low >= len(order):
                break
            high = int(np.searchsorted(ordered, width, side="right"))
            step = max(1, CELLS // width)
            for first in range(low, high, step):
                part = order[first : min(high, first + step)]
                n = size[part]
                ids = np.full((len(part), int(n.max()) or 1), -1, np.int32)
                data = np.frombuffer(b"".join([pieces[i] for i in part]), np.uint8)
                ids[np.arange(ids.shape[1]) < n[:, None]] = self.of_byte[data]
                ids, n = self.merge_rows(ids, n)
                flat = ids[np.arange(ids.shape[1]) < n[:, None]].tobytes()
                ends = (np.cumsum(n) * 4).tolist()
                begin = 0
                for i, end in zip(part.tolist(), ends, strict=True):
                    out[i] = flat[begin:end]
                    begin = end
            low = high
        return out

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        cut = [self.find(t) for t in texts]
        new = {p for pieces in cut for p in pieces} - self.known.keys()
        known, before = self.known, self.before
        known.update((p, before[p]) for p in new & before.keys())
        fresh = list(new - before.keys())
        if fresh:
            known.update(zip(fresh, self.encode_pieces([p.encode("utf-8", "replace") for p in fresh]), strict=True))
        out = [np.frombuffer(b"".join([known[p] for p in pieces]), np.int32) for pieces in cut]
        for p in fresh:
            if len(p) > LONG:
                del known[p]
        if len(known) > STORE:
            self.before, self.known = known, {}
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        token = self.token
        return b"".join([token[i] for i in ids.tolist()])


_HELD: dict[tuple[str, str], ByteBPE] = {}


def coder(path: str, pattern: str) -> ByteBPE:
    """One coder per Python worker."""
    if (path, pattern) not in _HELD:
        _HELD[path, pattern] = ByteBPE(read_ranks(path), pattern)
    return _HELD[path, pattern]


def encode_and_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Per document the number of ids, the hash of the ids and that of the decoded bytes; with `keep_ids` also `ids`."""
    schema = SCHEMA + (", ids array<int>" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for low, high in chunked(texts):
                ids = bpe.encode_batch(texts[low:high])
                columns = [
                    batch.column(0).slice(low, high - low),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids], pa.string()),
                ]
                if keep_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
