"""Compression bands: zstandard ratios of whole texts and of fixed chunks.

A ratio is bytes before over bytes after compression.  Repetitive text has a
high one, random text one near 1; both depend on the length, so each length
band has limits of its own, for the whole text and for its chunks.  A text is
kept if its own ratio and those of all its chunks lie within the limits; the last
chunk is the final bytes, overlapping its predecessor, so that none is unmeasured.

Besides, counts that plain rules need: words, symbols, repeated lines and
words in repeated three-word windows.

Defined results: a null or empty text has no words, ratios of 0 and is
rejected by the base rules; equal texts get equal rows; an empty table gives no
rows; other columns are ignored.  One row at a time is held besides its batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
CHUNK = 4096
LEVEL = 3


@dataclass(frozen=True)
class Band:
    """Limits of the whole text's ratio for texts of less than `below` bytes."""

    below: float
    low: float
    high: float


#: Short texts hardly compress, and the longer a text the more of it has been seen before, so bands are half an octave
#: wide.  The limits are the quantiles 0.005, less 0.1, and 0.995 of the ratios of texts labelled as good that pass the
#: base rules, from the training fold (even CRC-32 of the id: 1,652 texts).  Bands with fewer than 50 of them (below 362
#: and from 11,585 bytes on) are 0.14 wider above, the range of a well-filled band.  Below 256 and from 32,768 bytes on
#: there are none, and the limits are loose.
BANDS = (
    Band(256, 0.5, 2.2), Band(362, 1.28, 1.73), Band(512, 1.31, 1.79), Band(724, 1.37, 1.86), Band(1024, 1.55, 1.94),
    Band(1448, 1.65, 2.03), Band(2048, 1.78, 2.09), Band(2896, 1.83, 2.14), Band(4096, 1.94, 2.2), Band(5793, 2.02, 2.27),
    Band(8192, 2.06, 2.34), Band(11585, 2.12, 2.37), Band(16384, 2.16, 2.54), Band(23170, 2.23, 2.56), Band(32768, 2.27, 2.56),
    Band(float("inf"), 1.8, 2.95),
)
CHUNKS = Band(float("inf"), 1.5, 3.3)

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, chunk_low double, chunk_high double"


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """How many words stand in a window of `window` words that occurs twice or more."""
    n = len(words)
    if n <= window:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    key = ids[: n - window + 1]
    for k in range(1, window):
        if len(numbers) > 1 and key.max() > (1 << 62) // len(numbers):
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        key = key * len(numbers) + ids[k : n - window + 1 + k]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    often = np.zeros(len(key), bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    in_one = np.zeros(n, bool)
    for k in range(window):
        in_one[k : k + len(key)] |= often
    return int(in_one.sum())


def measure(text: str | None, compress) -> tuple:
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    n = len(words)
    no_blank = data.translate(None, BLANK)
    chars = len(text or "") - (len(data) - len(no_blank))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip(BLANK)]
    repeats = repeated_words(words)
    failed = n < 50 or 100 * repeats > 50 * n
    if not data:
        return n, chars, symbols, 0, repeats, failed, False, 0.0, 0.0, 0.0
    ratio = len(data) / len(compress(data))
    at = [*range(0, len(data) - CHUNK + 1, CHUNK)]
    if at and len(data) % CHUNK:
        at.append(len(data) - CHUNK)  # the rest, with as much before it as makes it full
    parts = [CHUNK / len(compress(data[i : i + CHUNK])) for i in at]
    low, high = (min(parts), max(parts)) if parts else (ratio, ratio)
    band = next(b for b in BANDS if len(data) < b.below)
    kept = not failed and band.low <= ratio <= band.high and all(CHUNKS.low <= p <= CHUNKS.high for p in parts)
    return n, chars, symbols, len(lines) - len(set(lines)), repeats, failed, kept, ratio, low, high


def compression_bands(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document; see `SCHEMA`."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        for batch in batches:
            rows = list(zip(*(measure(t.as_py(), compress) for t in batch.column(1)), strict=True)) or [[]] * 10
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 3
            columns = [pa.array(x, k) for x, k in zip(rows, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(score, SCHEMA)
