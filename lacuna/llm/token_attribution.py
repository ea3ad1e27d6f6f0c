"""Token counts of a document's sections from one encoding of the whole document.

A document is encoded once and each token gets the span of characters it was
made of (a token with part of a character gets that character whole).  Spans
and sections, both in order, are joined by their intervals with binary search.
A token inside a section counts there.  A token that crosses a boundary is
allocated by a rule:

``majority``  to the section that holds most of its characters, of equal ones the first
``start``     to the section that holds its first character, if any

Besides, the column `share` has every section's sum of the shares of tokens'
characters in it, whatever the rule.  So with sections that cover the document the counts add up to the document's.

Defined results: a null or empty text has one empty section and no tokens; a
section is clipped to the text; where sections overlap each counts the tokens
inside it, and a crossing token still goes to one; equal texts get equal rows;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.byte_bpe import read_ranks

RULES = ("majority", "start")
SCHEMA = "doc_id long, section long, start long, end long, n_tokens long, n_inside long, n_crossing long, share double, doc_tokens long"
_KINDS = [pa.int64()] * 7 + [pa.float64(), pa.int64()]


class Encoder:
    def __init__(self, path: str, pattern: str):
        import tiktoken

        ranks = read_ranks(path)
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.length[rank] = len(token)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Where each token's characters begin and end in `text`."""
        ids = self.encoding.encode_to_numpy(text, disallowed_special=())
        end = np.cumsum(self.length[ids])
        start = end - self.length[ids]
        if len(ids) and not text.isascii():
            data = np.frombuffer(text.encode(), np.uint8)
            char = np.cumsum((data & 0xC0) != 0x80) - 1
            start, end = char[start], char[end - 1] + 1
        return start, end


def lines(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each line, its line break included."""
    ends, at = [], text.find("\n")
    while at >= 0:
        ends.append(at + 1)
        at = text.find("\n", at + 1)
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    end = np.array(ends, np.int64)
    return np.append(0, end[:-1]), end


def allocate(token_start: np.ndarray, token_end: np.ndarray, start: np.ndarray, end: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each section: tokens by the rule, tokens inside, tokens crossing its boundary, sum of shares."""
    first = np.searchsorted(token_end, start, "right")  # tokens first:last touch the section
    last = np.maximum(first, np.searchsorted(token_start, end, "left"))
    last = np.where(end > start, last, first)
    from_, to = np.searchsorted(token_start, start, "left"), np.searchsorted(token_end, end, "right")
    inside = np.where(end > start, np.maximum(0, to - np.maximum(from_, first)), 0)
    crossing = (last - first) - inside
    # Only tokens at either edge of a section cross: those before from_, and those from `to` on.
    left_n = np.clip(from_ - first, 0, last - first)
    right_from = np.maximum(to, first + left_n)
    right_n = np.maximum(0, last - right_from)
    n = np.concatenate([left_n, right_n])
    section = np.repeat(np.tile(np.arange(len(start)), 2), n)
    token = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(np.concatenate([first, right_from]), n)
    overlap = np.minimum(token_end[token], end[section]) - np.maximum(token_start[token], start[section])
    share = inside + np.bincount(section, overlap / np.maximum(1, token_end[token] - token_start[token]), len(start))
    if rule == "majority":
        order = np.lexsort((section, -overlap, token))
        won = order[np.append(True, token[order][1:] != token[order][:-1])] if len(order) else order
    else:
        won = np.flatnonzero((token_start[token] >= start[section]) & (token_start[token] < end[section]))
    return inside + np.bincount(section[won], minlength=len(start)), inside, crossing, share


def count_tokens(docs: DataFrame, path: str, pattern: str, rule: str = "majority", id_col: str = "doc_id", text_col: str = "text", sections_col: str | None = None) -> DataFrame:
    """One row per section; see `SCHEMA`.

    `sections_col`: an array of structs with character offsets `start` and
    `end`; without it the sections are the lines of the text.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, pattern)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            columns: list[list[np.ndarray]] = [[] for _ in range(8)]
            counts, size = [], 0
            begin = 0
            for i in range(len(ids)):
                text = batch.column(1)[i].as_py() or ""
                if sections_col is None:
                    start, end = lines(text)
                else:
                    given = sorted((s["start"] or 0, len(text) if s["end"] is None else s["end"]) for s in batch.column(2)[i].as_py() or [] if s)
                    start, end = (np.clip(np.array([g[k] for g in given or [(0, 0)]], np.int64), 0, len(text)) for k in (0, 1))
                token_start, token_end = encoder.spans(text)
                found = allocate(token_start, token_end, start, end, rule)
                for column, x in zip(columns, (np.arange(len(start)), start, end, *found, np.full(len(start), len(token_start))), strict=True):
                    column.append(x)
                counts.append(len(start))
                size += len(text)
                if size > 1 << 22 or i == len(ids) - 1:  # rows go on before they pile up
                    at = pa.array(np.repeat(np.arange(begin, i + 1), counts))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), *(pa.array(np.concatenate(x), k) for x, k in zip(columns, _KINDS[1:], strict=True))], names=[x.split()[0] for x in SCHEMA.split(", ")])
                    columns, counts, size, begin = [[] for _ in range(8)], [], 0, i + 1

    wanted = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")]
    if sections_col is not None:
        wanted.append(F.transform(F.col(sections_col), lambda s: F.struct(s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end"))).alias("sections"))
    return docs.select(*wanted).mapInArrow(run, SCHEMA)
