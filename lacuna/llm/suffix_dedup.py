"""Removal of repeated byte strings by prefix-free parsing and suffix arrays.

Every byte covered by a string of `SPAN` bytes that also starts in a document
with a smaller id is removed.

Parsing.  A rolling hash is taken of every `GRAM` bytes; within each span the
least of them is its trigger.  A phrase is what lies between a trigger and the
next, with the rest of its last span: phrases overlap so that every span lies
whole in one, and equal spans have equal triggers, at the same place.

1. Blocks of documents report which triggers they hold; only triggers that two
   documents hold can belong to a repeated span.  Four bytes for a trigger, and
   four for its phrases in the block where these are more than one.
2. For those, each block sends its distinct phrases and the least id of each,
   by trigger.  A document that repeats a phrase of a smaller id in its own
   block is answered on the spot, so a passage that many documents share is
   sent once by each block.  Triggers with more than `HOT` phrases, such as that at
   the edge of a common passage, are not kept together: their spans are sent one by
   one, by a hash of their bytes, so equal ones still meet.
3. A task has all phrases of some triggers.  Their distinct strings, sorted, are the
   dictionary.  Its suffix array, sorted to the depth of a span, puts equal
   spans side by side.  The parse's suffix array is the places where phrases were
   read, by the rank of the phrase, then by id; a span lies whole in one
   phrase, so a depth of one phrase decides.  Together they are the corpus order
   of spans: each suffix of the dictionary stands for a range of the parse's
   array.  The least document of a span is the least of the firsts of its ranges.
4. Each phrase gets back a bit for each of its spans, and the blocks cut.

Documents are shuffled once, by block, and three steps read that shuffle.  All
sizes of blocks and buckets are fixed, so their number grows with the input.

Defined results: a null text is empty; texts shorter than a span lose nothing;
rows that share an id are not smaller than each other; a null id is larger than
any; `drop_repeats` drops the rest of a character that a cut splits; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import mix64

SPAN, GRAM = 50, 20
#: Bytes of text in a block of documents, and for a bucket of triggers.
BLOCK, BUCKET = 4 << 20, 3 << 20
#: Phrases of a trigger beyond which its spans are dealt by their own bytes.
HOT = 1 << 13
#: Positions hashed at a time: few enough for a core's cache.
STEP = 1 << 15
LAST = np.int64(2**63 - 1)
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position on."""
    parts, size, h = {}, 1, _BYTE[data]
    while True:
        parts[size] = h
        if 2 * size > GRAM:
            break
        h = h[:-size] * _ODD[size.bit_length() % 5] + h[size:]
        size *= 2
    at = size
    for other in sorted(parts, reverse=True)[1:]:  # the remaining bytes, largest part first
        if at + other <= GRAM:
            h = h[: len(data) - at - other + 1] * _ODD[(at + other) % 5] + parts[other][at : at + len(data) - at - other + 1]
            at += other
    return mix64(h)


class Parse:
    """The phrases of some documents: where each begins in `data`, its spans, its trigger, its document."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        first, spans, trigger = [], [], []
        for base in range(0, max(0, len(data) - SPAN + 1), STEP):
            self._step(data, ends, base, first, spans, trigger)
        cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.first, self.spans, self.trigger = cat(first, np.int64), cat(spans, np.int64), cat(trigger, np.uint64)
        self.doc = np.searchsorted(ends, self.first, side="right")

    @staticmethod
    def _step(data, ends, base, first, spans, trigger):
        part = data[base : base + STEP + SPAN - 1]
        h = gram_hashes(part)
        low = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)  # of equal ones the first
        wide, size = SPAN - GRAM + 1, 1
        while 2 * size <= wide:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < wide:
            low = np.minimum(low[: -(wide - size)], low[wide - size :])
        at = (low & np.uint64(0xFFFFFF)).astype(np.int64)
        begins = np.arange(base, base + len(at))
        whole = np.ones(len(at), bool)
        # Spans that run over the end of a document are none.
        for e in ends[np.searchsorted(ends, base, side="right") : np.searchsorted(ends, base + len(at) + SPAN, side="right")].tolist():
            whole[max(0, e - base - SPAN + 1) : max(0, e - base)] = False
        begins, at = begins[whole], at[whole]
        if not len(at):
            return
        new = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (begins[1:] != begins[:-1] + 1)))
        first.append(begins[new])
        spans.append(np.diff(np.append(new, len(at))))
        trigger.append(h[at[new]])


def cut_out(data: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of `data` from each `first` on, one after the other."""
    shift = np.repeat(first - (np.cumsum(length) - length), length)
    return data[shift + np.arange(len(shift))]


def _documents(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order of the rows, their ids, all bytes, where each text ends), rows by id and text."""
    ids = table.column("doc_id").fill_null(LAST).to_numpy()
    order = np.argsort(ids, kind="stable")
    same = np.flatnonzero(ids[order][1:] == ids[order][:-1])
    if len(same):  # rows that share an id stand in the order of their texts
        texts = table.column("text")
        for at in np.split(same, np.flatnonzero(np.diff(same) > 1) + 1):
            part = order[at[0] : at[-1] + 2]
            order[at[0] : at[-1] + 2] = sorted(part.tolist(), key=lambda i: texts[i].as_py())
    texts = pc.cast(table.column("text").combine_chunks().take(pa.array(order)), pa.large_binary())
    _, offsets, data = texts.buffers()  # the bytes where Arrow holds them, without a copy as Python objects
    ends = np.frombuffer(offsets, np.int64)[: len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return order, ids[order], np.frombuffer(data, np.uint8)[: ends[-1]] if ends[-1] else np.zeros(0, np.uint8), ends[1:]


def _bucket(trigger: np.ndarray, buckets: int) -> np.ndarray:
    return ((trigger >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _low(trigger: np.ndarray) -> np.ndarray:
    return trigger.astype(np.uint32)


def _by_bucket(bucket: np.ndarray):
    order = np.argsort(bucket, kind="stable")
    at = np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1])) if len(order) else np.zeros(0, np.int64)
    for low, high in zip(at, np.append(at[1:], len(order)), strict=True):
        yield int(bucket[order[low]]), order[low:high]


def _report(buckets: int):
    """Step 1, a block: its triggers by bucket, those of one document and those of more."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        _, _, data, ends = _documents(table)
        parse = Parse(data, ends)
        order = np.argsort(parse.trigger)
        t, d = parse.trigger[order], parse.doc[order]
        new = np.flatnonzero(np.append(True, t[1:] != t[:-1])) if len(t) else np.zeros(0, np.int64)
        several = np.minimum.reduceat(d, new) != np.maximum.reduceat(d, new) if len(new) else np.zeros(0, bool)
        t = t[new]
        phrases = _phrase_counts(data, parse, order, new)
        rows = [(b, _low(t[at][~several[at]]).tobytes(), _low(t[at][several[at]]).tobytes(), phrases[at][several[at]].tobytes()) for b, at in _by_bucket(_bucket(t, buckets))]
        return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([key[0].as_py()] * len(rows), pa.int64()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3))], names=["bucket", "block", "once", "several", "phrases"])

    return run


def _phrase_counts(data: np.ndarray, parse: Parse, order: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How many phrases each trigger has; `order` sorts by trigger, whose runs begin at `new`.  From eight on, equal ones count once."""
    n = np.diff(np.append(new, len(order)))
    many = np.flatnonzero(n >= 8)
    if len(many):
        at = order[np.repeat(n >= 8, n)]
        code, _ = _distinct(cut_out(data, parse.first[at], parse.spans[at] + SPAN - 1), parse.spans[at] + SPAN - 1)
        pairs = np.unique((np.repeat(np.arange(len(many)), n[many]) << 32) | code)
        n[many] = np.bincount(pairs >> 32, minlength=len(many))
    return n.astype(np.uint32)


def _hot(every: np.ndarray, several: np.ndarray, phrases: np.ndarray, hot: int) -> np.ndarray:
    """The triggers with more than `hot` phrases; `every` has each once per block, sorted."""
    some, code = np.unique(several, return_inverse=True)
    more = np.bincount(code, phrases.astype(np.float64) - 1, minlength=len(some))
    total = more + np.searchsorted(every, some, "right") - np.searchsorted(every, some)
    return np.union1d(some[total > hot], every[hot:][every[hot:] == every[: len(every) - hot]] if len(every) > hot else every[:0])


def _shared(key: tuple, table: pa.Table, hot: int = HOT) -> pa.Table:
    """Step 1, a bucket: for each block its triggers that two documents hold, and those of them with many phrases."""
    once, several, phrases = ([np.frombuffer(x, np.uint32) for x in table.column(c).to_pylist()] for c in ("once", "several", "phrases"))
    alone = np.concatenate(once)
    every = np.sort(np.concatenate([alone, *several]))
    many = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], *several]))
    hit = many[np.minimum(np.searchsorted(many, alone), len(many) - 1)] == alone if len(many) else np.zeros(len(alone), bool)
    ends = np.cumsum([len(o) for o in once])
    out = [np.concatenate([o[h], s]) for o, h, s in zip(once, np.split(hit, ends[:-1]), several, strict=True)]
    keep = [i for i, x in enumerate(out) if len(x)]
    crowded = _hot(every, np.concatenate(several), np.concatenate(phrases), hot)
    hots = [x[np.isin(x, crowded)] for x in out]
    blocks = table.column("block").to_pylist()
    return pa.table([pa.array([blocks[i] for i in keep], pa.int64()), pa.array([key[0].as_py()] * len(keep), pa.int64()), *(pa.array([x[i].tobytes() for i in keep], pa.binary()) for x in (out, hots))], names=["block", "bucket", "triggers", "hot"])


_PHRASES = "bucket long, block long, row binary, start binary, spans binary, least binary, bytes binary, own binary"


def _send(buckets: int):
    """Step 2, a block: its distinct phrases with a shared trigger, and what it answers itself."""

    def run(docs: pa.Table, shared: pa.Table) -> pa.Table:
        names = [f.split()[0] for f in _PHRASES.split(", ")]
        kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 6]
        rows: list[tuple] = []
        if docs.num_rows and shared.num_rows:
            _, ids, data, ends = _documents(docs)
            parse = Parse(data, ends)
            bucket = _bucket(parse.trigger, buckets)
            found, hot = (
                np.sort(np.concatenate([(np.uint64(b) << np.uint64(32)) | np.frombuffer(t, np.uint32).astype(np.uint64) for b, t in zip(shared.column("bucket").to_pylist(), shared.column(c).to_pylist(), strict=True)]))
                for c in ("triggers", "hot")
            )
            mine = (bucket.astype(np.uint64) << np.uint64(32)) | _low(parse.trigger).astype(np.uint64)
            hit = found[np.minimum(np.searchsorted(found, mine), len(found) - 1)] == mine
            first, spans, doc, bucket = parse.first[hit], parse.spans[hit], parse.doc[hit], bucket[hit]
            if len(hot):
                first, spans, doc, bucket = _split(data, first, spans, doc, bucket, np.isin(mine[hit], hot), buckets)
            begin = np.append(0, ends[:-1])
            block = docs.column("block")[0].as_py()
            press = zstandard.ZstdCompressor(level=3).compress
            for b, at in _by_bucket(bucket):
                length = spans[at] + SPAN - 1
                text = cut_out(data, first[at], length)
                code, kept = _distinct(text, length)
                least = np.full(len(kept), LAST)
                np.minimum.at(least, code, ids[doc[at]])
                speaks = np.full(len(kept), -1)
                speaks[code[::-1]] = np.arange(len(at))[::-1]  # rows are in the order of ids
                own = np.flatnonzero((ids[doc[at]] > least[code]))
                entry = at[speaks]
                again = np.flatnonzero((ids[doc[at]] == least[code]) & (speaks[code] != np.arange(len(at))))  # in the least document once more, or in a row that shares its id
                entry = np.concatenate([entry, at[again]])
                least = np.concatenate([least, least[code[again]]])
                own = np.concatenate([doc[at[own]], first[at[own]] - begin[doc[at[own]]], spans[at[own]]]).astype(np.int32)
                n = spans[entry] + SPAN - 1
                rows.append((b, block, doc[entry].astype(np.int32).tobytes(), (first[entry] - begin[doc[entry]]).astype(np.int32).tobytes(), spans[entry].astype(np.uint8).tobytes(), press(least.tobytes()), press(cut_out(data, first[entry], n).tobytes()), own.tobytes()))
        return pa.table([pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [[]] * 8, kinds, strict=True)], names=names)

    return run


def _split(data, first, spans, doc, bucket, hot, buckets: int):
    """The same phrases, but the hot ones as single spans, dealt by their bytes; in order of place."""
    n = np.where(hot, spans, 1)
    at = np.repeat(first, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    single, to = np.repeat(hot, n), np.repeat(bucket, n)
    begins = at[single]
    h = np.zeros(len(begins), np.uint64)
    for k in range(SPAN):
        h = h * _ODD[0] + _BYTE[data[begins + k]]
    to[single] = _bucket(mix64(h), buckets)
    return at, np.where(single, 1, np.repeat(spans, n)), np.repeat(doc, n), to


def _distinct(text: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The number of each string among the distinct ones, and these."""
    offsets = np.append(0, np.cumsum(length)).astype(np.int32)
    strings = pa.BinaryArray.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(text))])
    coded = strings.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary


def suffix_order(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans that begin at `at`, in order, and which of them differ from the one before.

    A refinement: sorted by their first bytes, then by some more within those
    that are still equal.  A number holds where a span's group begins, its next
    bytes and its place, so that plain integer sorts do.
    """
    # The eight bytes from each place on, as one number: a big-endian view of the bytes at each of eight shifts.
    padded = np.append(data, np.zeros(16, np.uint8))
    eight = np.empty(len(data) + 8, np.uint64)
    for k in range(8):
        part = padded[k : k + (len(padded) - k) // 8 * 8].view(">u8")
        n = len(eight[k::8])
        eight[k::8] = part[:n]
    bits = max(1, int(len(at)).bit_length())
    low = np.uint64((1 << bits) - 1)
    order, start = np.arange(len(at), dtype=np.int32), np.zeros(len(at), np.uint32)
    changed = np.zeros(len(at), bool)
    changed[:1] = True
    slots, depth = np.arange(len(at), dtype=np.int32), 0
    while depth < SPAN and len(slots):
        n = min((64 - bits - (bits if depth else 0)) // 8, 8, SPAN - depth)
        spans = order[slots]
        key = (start[slots].astype(np.uint64) << np.uint64(64 - bits)) if depth else np.zeros(len(slots), np.uint64)
        key = key | ((eight[at[spans] + depth] >> np.uint64(64 - 8 * n)) << np.uint64(bits)) | np.arange(len(slots), dtype=np.uint64)
        key.sort()
        order[slots] = spans[(key & low).astype(np.int64)]
        key >>= np.uint64(bits)
        changed[slots[1:]] = key[1:] != key[:-1]
        start[slots] = np.maximum.accumulate(np.where(changed[slots], slots, 0)).astype(np.uint32)
        here = changed[slots]
        slots = slots[~(here & np.append(here[1:], True))]  # what is alone in its group is done
        depth += n
    return order, changed


def spans_bytes(strings: pa.Array) -> int:
    """All bytes of an array of strings that begins at its buffer's start."""
    return int(np.frombuffer(strings.buffers()[1], np.int32)[len(strings)]) if len(strings) else 0


def _ranked(code: np.ndarray, dictionary: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The same strings in order, and their numbers as ranks."""
    order = pc.array_sort_indices(dictionary).to_numpy()
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return rank[code], dictionary.take(pa.array(order))


def parse_order(rank: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the parse by the rank of their phrase, then by id, and where those of each of `n` phrases begin (and the last end)."""
    order = np.lexsort((ids, rank)).astype(np.int32)
    return order, np.searchsorted(rank[order], np.arange(n + 1)).astype(np.int32)


def corpus_order(order: np.ndarray, changed: np.ndarray, entry: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All spans of the corpus in order: for each suffix of the dictionary where its places begin in the parse's order and how many they are, and the suffixes with which a new span begins."""
    e = entry[order]
    return begin[e], begin[e + 1] - begin[e], np.flatnonzero(changed)


def _answer(key: tuple, table: pa.Table) -> pa.Table:
    """Step 3, a bucket: for each block (row, start, bits): the spans that a smaller document has."""
    undo = zstandard.ZstdDecompressor().decompress
    numbers = lambda name, kind: [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]
    spans_of = numbers("spans", np.uint8)
    n = [len(s) for s in spans_of]
    spans = np.concatenate(spans_of).astype(np.int32)
    least = np.frombuffer(b"".join(undo(x) for x in table.column("least").to_pylist()), np.int64)
    text = np.frombuffer(b"".join(undo(x) for x in table.column("bytes").to_pylist()), np.uint8)
    code, dictionary = _distinct(text, spans + SPAN - 1)
    del text
    code, dictionary = _ranked(code, dictionary)
    data = np.frombuffer(dictionary.buffers()[2], np.uint8)[: spans_bytes(dictionary)]
    held = np.zeros(len(dictionary), np.int32)  # spans of each entry
    held[code] = spans
    first_byte = (np.cumsum(held + SPAN - 1) - (held + SPAN - 1)).astype(np.int32)
    parse, begin = parse_order(code, least, len(dictionary))
    entry = np.repeat(np.arange(len(dictionary), dtype=np.int32), held)
    first_span = (np.cumsum(held) - held).astype(np.int32)
    at = np.arange(len(entry), dtype=np.int32) + (first_byte - first_span)[entry]
    order, changed = suffix_order(data, at)
    del at, data, dictionary
    first, _, runs = corpus_order(order, changed, entry, begin)
    lowest = np.minimum.reduceat(least[parse[first]], runs)
    of_span = np.empty(len(entry), np.int64)
    of_span[order] = np.repeat(lowest, np.diff(np.append(runs, len(entry))))
    del order, changed, entry, first, lowest
    bits = np.zeros(len(spans), np.uint32)
    for k in range(int(spans.max())):
        has = np.flatnonzero(spans > k)
        bits[has] |= (of_span[first_span[code[has]] + k] < least[has]).astype(np.uint32) << np.uint32(k)
    rows = []
    low = 0
    for block, row, start, own, m in zip(table.column("block").to_pylist(), numbers("row", np.int32), numbers("start", np.int32), numbers("own", np.int32), n, strict=True):
        b = bits[low : low + m]
        low += m
        some = b != 0
        own = own.reshape(3, -1)
        all_bits = ((np.uint64(1) << own[2].astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
        cut = [np.concatenate([x[some], y]) for x, y in ((row, own[0]), (start, own[1]), (b, all_bits))]
        if len(cut[0]):
            rows.append((block, *(x.tobytes() for x in cut)))
    return pa.table([pa.array([r[k] for r in rows], pa.int64() if k == 0 else pa.binary()) for k in range(4)], names=["block", "row", "start", "bits"])


def _covered(docs: pa.Table, answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order of the rows, all bytes, where each text ends, which bytes go)."""
    order, _, data, ends = _documents(docs)
    begins = np.append(0, ends[:-1])
    starts = np.zeros(len(data), bool)
    for row, start, bits in zip(*(answers.column(c).to_pylist() for c in ("row", "start", "bits")), strict=True):
        at = begins[np.frombuffer(row, np.int32)] + np.frombuffer(start, np.int32)
        bits = np.frombuffer(bits, np.uint32)
        for k in range(int(bits.max()).bit_length()):
            starts[at[(bits >> np.uint32(k)) & np.uint32(1) == 1] + k] = True
    gone = np.cumsum(starts, dtype=np.int32)
    gone[SPAN:] -= gone[:-SPAN].copy()
    return order, data, ends, gone > 0


def _measure(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """Step 4, a block: what is removed from each document."""
    if not docs.num_rows:
        return pa.table([pa.array([], pa.int64())] * 4 + [pa.array([], pa.string())], names=[f.split()[0] for f in SCHEMA.split(", ")])
    order, data, ends, gone = _covered(docs, answers)
    begins = np.append(0, ends[:-1])
    rows = []
    for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
        g = gone[a:b]
        rows.append((b - a, int(g.sum()), int(np.count_nonzero(g[1:] & ~g[:-1]) + (g[:1].sum())), hashlib.sha256(data[a:b][~g].tobytes()).hexdigest()))
    kinds = [pa.int64()] * 3 + [pa.string()]
    return pa.table([docs.column("doc_id").take(pa.array(order)), *(pa.array([r[k] for r in rows], kinds[k]) for k in range(4))], names=[f.split()[0] for f in SCHEMA.split(", ")])


def _answers(docs: DataFrame, id_col: str, text_col: str, extra: dict | None = None, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """The documents by block, and what each block has to cut."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0
    blocks, buckets = max(1, math.ceil(total / BLOCK)), max(1, math.ceil(total / BUCKET))
    block = F.pmod(F.xxhash64(F.lit("block"), F.col(id_col)), F.lit(blocks))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), block.alias("block"), *[F.col(c).alias(n) for n, c in (extra or {}).items()])
    reported = plain.groupBy("block").applyInArrow(_report(buckets), "bucket long, block long, once binary, several binary, phrases binary")
    shared = reported.groupBy("bucket").applyInArrow(lambda key, table: _shared(key, table, hot), "block long, bucket long, triggers binary, hot binary")
    sent = plain.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_send(buckets), _PHRASES)
    return plain, sent.groupBy("bucket").applyInArrow(_answer, "block long, row binary, start binary, bits binary")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row per document; see `SCHEMA`."""
    plain, answers = _answers(docs, id_col, text_col, hot=hot)
    return plain.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_measure, SCHEMA)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, without the repeated bytes; characters that a cut splits go."""
    rest = [c for c in docs.columns if c != text_col]
    docs = docs.withColumn("__rest", F.struct(*[F.col(f"`{c}`") for c in rest]))
    plain, answers = _answers(docs, id_col, text_col, {"rest": "__rest"})

    def cut(docs: pa.Table, answers: pa.Table) -> pa.Table:
        kept = []
        if docs.num_rows:
            order, data, ends, gone = _covered(docs, answers)
            kept = [data[a:b][~gone[a:b]].tobytes().decode("utf-8", "ignore") for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True)]
            docs = docs.take(pa.array(order))
        return pa.table([pa.array(kept, pa.string()), docs.column("rest").combine_chunks()], names=["text", "rest"])

    schema = f"text string, rest {docs.schema['__rest'].dataType.simpleString()}"
    done = plain.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(cut, schema)
    return done.select(*[F.col("text").alias(c) if c == text_col else F.col("rest")[c].alias(c) for c in docs.columns if c != "__rest"])
