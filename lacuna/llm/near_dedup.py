"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A document is the weighted set of its shingles (five words, lower case): a
shingle weighs its count times its inverse document frequency
``1 + ln(n / max(df, floor)) / ln(n / floor)``, which falls from 2 for the rare
ones to 1 for what all documents have.  It is scaled so that a large group of
near copies, whose common shingles are frequent for that very reason, still
outweighs the few words in which they differ.  Document frequencies are counted
over all documents in two tables of 2 ** BITS bins each, by independent hashes;
a shingle's is the lesser of its two bins, less the mean bin (what the bin's
other shingles add).  The floor is what these counts can tell from nothing: one
document, or FLOOR_ERRORS standard errors of a bin where that is more.  It grows
as the root of the number of documents, so the share of documents that it stands
for falls as the corpus grows.

1. Texts with the same words are one, and a node of their own; the least id
   speaks for them.
2. Improved consistent weighted sampling (Ioffe 2010) draws BANDS x ROWS
   samples per set; two sets agree in a sample with the probability of their
   weighted Jaccard similarity.  Sets that agree in a whole band share a bucket.
3. Every member of a bucket is compared with the bucket's least id (pairs are
   made unique over all buckets first; a bucket of m gives m - 1 pairs).
4. What that leaves open is compared exactly.  As 1 - similarity is a metric, a
   member less than 0.6 similar to the least id cannot be 0.8 similar to one
   that is.  So open are pairs among those that failed, and of those above 0.6
   with the ones that passed, unless they are connected already.  They are
   compared inside tasks in blocks of at most BLOCK members, never as rows.
5. Links of `least` or more, and texts of one id, make classes; a class is named
   by its least id.

Defined results: a null text is a class of its own; texts without words are
alike if they are equal; texts of fewer than five words have one shingle; rows
that share an id are one document, whose class joins those of its texts; a row
without an id takes part only through equal words; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import Words, distinct_in_text, mix64, text_chunks, written
from lacuna.llm.components import components

WORDS, LEAST = 5, 0.8
BANDS, ROWS = 15, 3
BITS, FLOOR_ERRORS = 18, 1.0
#: Members that are compared with each other, or with one other document, in one task.
BLOCK = 256
SIGNATURE = "doc_id long, row_hash long, text_key binary, bands array<long>"


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, Words]:
    """(text, shingle, count) of the distinct shingles, by text and shingle, and the words."""
    words = Words(texts)
    h, at = words.hash, words.at
    n = np.diff(at)
    of = words.of()
    most = at[1:][of] - np.arange(len(h)) if len(h) else np.zeros(0, np.int64)  # words left in the text from here on
    key = np.zeros(len(h), np.uint64)
    for k in range(WORDS):
        key = key * np.uint64(0x9E3779B97F4A7C15) + (np.append(h[k:], np.zeros(k, np.uint64)) if k else h) * (most > k).astype(np.uint64)
    whole = (most >= WORDS) | ((n[of] < WORDS) & (most == n[of]))
    text, shingle, count = distinct_in_text(of[whole], mix64(key[whole]))
    return text, shingle, count, words


def bins(shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A shingle's bin in each of the two tables: its first and its last bits, which are independent."""
    return (shingle >> np.uint64(64 - BITS)).astype(np.int64), (shingle & np.uint64((1 << BITS) - 1)).astype(np.int64) + (1 << BITS)


def shared_bins(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """In how many texts each bin of shingles occurs, both tables one after the other, and the number of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(2 << BITS, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, _, texts in text_chunks(batch.column(0)):
                _, shingle, _, _ = shingles(texts)  # distinct in each text
                for at in bins(shingle):
                    np.add.at(df, at, 1)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, 2 << BITS)), pa.array(np.append(df[at], n))], names=["bin", "n"])

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()  # a row per bin
    df = np.zeros((2 << BITS) + 1, np.int64)
    df[counted.column("bin").to_numpy()] = counted.column("n").to_numpy()
    return df[:-1], int(df[-1])


def bin_weights(df: np.ndarray, total: int) -> np.ndarray:
    """The inverse document frequency that a bin's count stands for; a shingle has the greater of its two."""
    mean = df.sum() / len(df)
    floor = min(max(1.0, FLOOR_ERRORS * np.sqrt(mean)), max(1, total) / 2)
    count = np.clip(df - mean, floor, max(1, total))
    return (1 + np.log(max(1, total) / count) / np.log(max(2, total) / floor)).astype(np.float32)


def weights(shingle: np.ndarray, count: np.ndarray, of_bin: np.ndarray) -> np.ndarray:
    first, second = bins(shingle)
    return count * np.maximum(of_bin[first], of_bin[second])


def _gamma2_quantiles(n: int = 1 << 16) -> np.ndarray:
    """Quantiles of the gamma distribution of shape 2, at the middle of n equal shares."""
    u = (np.arange(n) + 0.5) / n
    x = np.maximum(-np.log1p(-u), 1e-3) + 1
    for _ in range(60):  # Newton on 1 - (1 + x) exp(-x) = u
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - u) / np.maximum(x * np.exp(-x), 1e-300), x / 8)
    return x


_TABLES: list[np.ndarray] = []


def samples(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_texts: int, n_samples: int) -> np.ndarray:
    """Consistent weighted samples, texts x samples; texts without shingles get zeros."""
    out = np.zeros((n_texts, n_samples), np.uint64)
    if not len(text):
        return out
    if not _TABLES:
        q = _gamma2_quantiles()
        _TABLES.extend((q, np.log(q)))
    gamma, log_gamma = _TABLES
    log_w = np.log(weight)
    new = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    owner = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(text))))
    low = np.uint64(0xFFFF)
    keys = mix64(np.arange(1, n_samples + 1, dtype=np.uint64))
    for k in range(n_samples):
        h = (shingle ^ keys[k]) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        r = gamma[(h >> np.uint64(48)).astype(np.int64)]
        log_c = log_gamma[((h >> np.uint64(32)) & low).astype(np.int64)]
        beta = ((h >> np.uint64(16)) & low).astype(np.float64) / 65536
        t = np.floor(log_w / r + beta)
        log_a = log_c - r * (t - beta) - r
        least = np.minimum.reduceat(log_a, new)
        hit = np.flatnonzero(log_a == least[owner])
        first = hit[np.append(True, owner[hit][1:] != owner[hit][:-1])]
        out[text[new], k] = mix64(shingle[first] + t[first].astype(np.int64).view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return out


def band_keys(drawn: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key per band from `rows` samples each; it tells bands apart."""
    key = np.zeros((len(drawn), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + drawn[:, r::rows][:, :bands])
    return key.view(np.int64)


def signatures(docs: DataFrame, of_bin, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, part in text_chunks(batch.column(2)):
                text, shingle, count, words = shingles(part)
                keys = band_keys(samples(text, shingle, weights(shingle, count, of_bin.value), b - a, BANDS * ROWS), BANDS, ROWS)
                some = np.diff(words.at) > 0
                name = [hashlib.blake2b(words.hash[i:j].tobytes() if j > i else b"-" + (t or "").encode(), digest_size=16).digest() if t is not None else None for t, i, j in zip(part, words.at[:-1], words.at[1:], strict=True)]
                bands = [row if ok else [] for row, ok in zip(keys, some, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(name, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "row_hash", "text_key", "bands"])

    return _rows(docs, id_col, text_col).mapInArrow(run, SIGNATURE)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, row_hash, text); id and hash name a text, also where an id has several."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("row_hash"), F.col(text_col).alias("text"))


class Sets:
    """Weighted shingle sets of some texts, for comparing them."""

    def __init__(self, texts: list[str], of_bin: np.ndarray):
        text, shingle, count, _ = shingles(texts)
        self.at = np.searchsorted(text, np.arange(len(texts) + 1))
        self.shingle, self.weight = shingle, weights(shingle, count, of_bin)
        self.total = np.bincount(text, self.weight, len(texts))

    def with_one(self, one: int) -> np.ndarray:
        """Weighted Jaccard similarity of each set with set `one`."""
        keys, w = self.shingle[self.at[one] : self.at[one + 1]], self.weight[self.at[one] : self.at[one + 1]]
        if not len(keys):
            return np.zeros(len(self.at) - 1)
        at = np.minimum(np.searchsorted(keys, self.shingle), len(keys) - 1)
        least = np.where(keys[at] == self.shingle, np.minimum(self.weight, w[at]), 0)
        both = np.bincount(np.repeat(np.arange(len(self.at) - 1), np.diff(self.at)), least, len(self.at) - 1)
        return both / np.maximum(self.total + self.total[one] - both, 1e-12)


def _compare_with_one(pairs: DataFrame, texts: DataFrame, of_bin) -> DataFrame:
    """(doc, other, similarity) of unique pairs: those of an `other` are dealt into groups of about BLOCK.

    What is joined has been written, so that a skewed `other` is split at run time.
    """
    n = written(pairs.groupBy("other").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts")), "heads")
    dealt = pairs.join(n, "other").withColumn("part", F.pmod(F.xxhash64("doc"), "parts").cast("int")).drop("parts")
    left = dealt.join(texts.withColumnRenamed("doc_id", "doc"), "doc")
    heads = n.select(F.col("other").alias("head"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("of_part"))
    right = heads.join(texts.select(F.col("doc_id").alias("head"), F.col("text").alias("head_text")), "head")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=["doc", "other", "similarity"])
        others = right.column("head_text").to_pylist()
        ids, out = left.column("doc").to_pylist(), []
        for _, _, texts in text_chunks(left.column("text").combine_chunks()):
            out.append(Sets([others[0], *texts], of_bin.value).with_one(0)[1:])
        similarity = np.concatenate(out) if out else np.zeros(0)
        return pa.table([pa.array(ids, pa.int64()), pa.array(right.column("head").to_pylist()[:1] * len(ids), pa.int64()), pa.array(similarity)], names=["doc", "other", "similarity"])

    return left.groupBy("other", "part").cogroup(right.groupBy("head", "of_part")).applyInArrow(compare, "doc long, other long, similarity double")


def _compare_all(groups: DataFrame, texts: DataFrame, least: float, of_bin) -> DataFrame:
    """Links (a, b) within groups (key, doc, label) between members of different labels, block by block."""
    sums = [F.sum(F.xxhash64(F.lit(k), "doc") % 1_000_000_007).alias(f"sum{k}") for k in (1, 2, 3)]
    n = groups.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("first"), F.max("doc").alias("last"), *sums)
    once = written(n.groupBy("n", "first", "last", "sum1", "sum2", "sum3").agg(F.min("key").alias("key")).select("key", "n"), "once")  # the same members in several bands
    dealt = groups.join(once, "key").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("doc"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("against")
    tasks = dealt.select("key", "doc", "label", "block", other).select("key", "doc", "label", "block", F.least("block", "against").alias("low"), F.greatest("block", "against").alias("high"))

    def compare(table: pa.Table) -> pa.Table:
        ids, label = table.column("doc").to_numpy(), table.column("label").to_numpy().copy()
        block, low, high = table.column("block").to_numpy(), table.column("low")[0].as_py(), table.column("high")[0].as_py()
        order = np.lexsort((ids, block))
        ids, label, block = ids[order], label[order], block[order]
        sets = Sets([table.column("text")[int(i)].as_py() for i in order], of_bin.value)
        links = []
        for i in range(len(ids)):
            apart = label != label[i]  # those connected already need no link
            if not apart.any() or (low != high and block[i] != low):
                continue
            for j in np.flatnonzero(apart & (sets.with_one(i) >= least)):
                if label[i] != label[j]:
                    links.append((ids[i], ids[j]))
                    label[label == label[j]] = label[i]
        return pa.table([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return tasks.join(texts.withColumnRenamed("doc_id", "doc"), "doc").groupBy("key", "low", "high").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id (the least id of its class)."""
    spark = docs.sparkSession
    of_bin = spark.sparkContext.broadcast(bin_weights(*shared_bins(docs, text_col)))  # 2 x 2 ** BITS numbers
    signed = written(signatures(docs, of_bin, id_col, text_col), "signatures")
    named = signed.filter("text_key IS NOT NULL AND doc_id IS NOT NULL")
    nodes = named.groupBy("text_key").agg(F.min(F.struct("doc_id", "row_hash")).alias("speaker"), F.first("bands").alias("bands"))
    nodes = written(nodes.select("text_key", "bands", "speaker.*", F.monotonically_increasing_id().alias("node")), "nodes")
    # Ids that stand for several texts tie these together.
    several = named.groupBy("doc_id").agg(F.min("text_key").alias("low"), F.max("text_key").alias("high")).filter("low <> high").select("doc_id")
    of_several = written(named.join(several, "doc_id", "left_semi").select("doc_id", "text_key").distinct().join(nodes.select("text_key", "node"), "text_key"), "several")
    tied = of_several.join(of_several.groupBy("doc_id").agg(F.min("node").alias("b")), "doc_id").filter("node <> b").select(F.col("node").alias("a"), "b")

    members = nodes.select(F.col("node").alias("doc"), F.explode("bands").alias("key"))
    # Tables are written between an aggregate and a join by the same key, so that no task holds a band's key whole: the
    # aggregate starts in each task, and the join of two plain tables is split at run time where a key is skewed.
    buckets = written(members.groupBy("key").agg(F.min("doc").alias("other"), F.max("doc").alias("most")).filter("other <> most").select("key", "other"), "heads")
    placed = written(members.join(buckets, "key"), "buckets")
    pairs = written(placed.filter("doc <> other").select("doc", "other").distinct(), "pairs")
    wanted = nodes.select("node", "doc_id", "row_hash").join(placed.select(F.col("doc").alias("node")).distinct(), "node", "left_semi")
    # One text for a node.  The same plan at every size: names of texts are never sent out whole.
    texts = _rows(docs, id_col, text_col).filter("text IS NOT NULL AND doc_id IS NOT NULL").join(wanted.hint("merge"), ["doc_id", "row_hash"])
    texts = written(texts.select(F.col("node").alias("doc_id"), "text").dropDuplicates(["doc_id"]), "texts")
    compared = written(_compare_with_one(pairs, texts, of_bin), "compared")
    links = compared.filter(F.col("similarity") >= least).select(F.col("doc").alias("a"), F.col("other").alias("b"))
    labels = components(links)

    # What is open: members that failed, and, beside those near enough, the ones that passed.
    far = least - (1 - least)
    label = F.coalesce("label", "doc")
    state = placed.filter("doc <> other").join(compared, ["doc", "other"]).join(labels.withColumnRenamed("id", "doc"), "doc", "left").select("key", "doc", "other", "similarity", label.alias("label"))
    state = written(state.join(labels.select(F.col("id").alias("other"), F.col("label").alias("of_other")), "other", "left").withColumn("of_other", F.coalesce("of_other", "other")), "state")
    failed = F.col("similarity") < least
    near = failed & (F.col("similarity") >= far) & (F.col("label") != F.col("of_other"))
    per_key = written(state.groupBy("key").agg(F.max(F.when(near, F.col("similarity"))).alias("nearest"), F.count_if(failed).alias("n_failed")).filter("n_failed > 0"), "failed")
    open_ = written(state.join(per_key, "key").filter(failed | (F.col("similarity") <= F.col("nearest") + (1 - least))).select("key", "doc", "label"), "open")
    mixed = written(open_.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key"), "mixed")
    open_ = written(open_.join(mixed, "key"), "open")
    more = written(_compare_all(open_, texts, least, of_bin), "more")
    labels = components(links.unionByName(more).unionByName(tied))

    linked = labels.select(F.col("id").alias("node"), "label").join(nodes.select("node", F.col("doc_id").alias("speaker")), "node")
    least_ids = linked.groupBy("label").agg(F.min("speaker").alias("class_id"))
    classes = written(linked.join(least_ids, "label").select("node", "class_id"), "classes")
    nodes = nodes.select("text_key", "node", F.col("doc_id").alias("speaker")).join(classes, "node", "left").select("text_key", F.coalesce("class_id", "speaker").alias("class_id"))
    return signed.select("doc_id", "text_key").join(nodes, "text_key", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def keep_one(docs: DataFrame, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, one of each class: that of the least id; rows without an id stay."""
    gone = near_duplicates(docs, least, id_col, text_col).filter("doc_id <> class_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col("__gone"), "left_anti")
