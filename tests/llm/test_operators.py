"""Each operator against brute force on small fixtures, with nulls, empty and long texts, ties, repeats and clashing columns."""

import base64
import collections
import dataclasses
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F

from lacuna.llm import byte_bpe, fingerprints, language_id, near_dedup, packing, quality_rules, sharding, suffix_dedup, token_attribution, toxicity
from lacuna.llm.components import components

RNG = random.Random(4)
VOCABULARY = ["".join(RNG.choice("abdeiklmnorstu") for _ in range(RNG.randint(2, 9))) for _ in range(400)]
#: Columns that no operator may trip over.
CLASH = "doc_id long, text string, lang string, source string, n_chars long, bucket string, block string, key string, hash string, label string, place string, part string"


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY) + rng.choice(["", "", "", ",", ".\n"]) for _ in range(n))


def frame(spark, rows, langs=None):
    """A documents table of (doc_id, text) with extra columns."""
    full = [(i, t, langs[k] if langs else "en", "s", len(t or ""), *["x"] * 7) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, CLASH).repartition(3)


LONG = prose(20_000)
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, "ééé ñ 漢字 \U0001f600 ok"), (6, "##$$ %% \n \n||"), (7, LONG), (8, prose(80)), (9, prose(80)), (10, "naïve <|endoftext|> <|ENDOFTEXT|> I'll it'S\x1c\x85x")]
ODD += [(11, ODD[7][1]), (12, "aaaa aaaa aaaa aaaa\n" * 30), (None, "no id"), (13, ODD[8][1][:300] + ODD[7][1][100:400])]


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], CLASH)


def got(df):
    return {r.doc_id: r for r in df.collect()}


# 1. Token counts.


def test_attribution_is_conserved_and_right(spark, odd, empty):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = odd.withColumn("sections", F.transform(F.sequence(F.lit(0), F.greatest(F.length(F.coalesce("text", F.lit(""))) - 1, F.lit(0)), F.lit(7)), lambda x: F.struct(x.alias("start"), (x + 7).alias("end"))))
    docs = docs.filter("doc_id <> 7 OR doc_id IS NULL")
    rows = token_attribution.count_tokens(docs, path, public_tokenizers.PATTERN, sections_col="sections").collect()
    encoder = token_attribution.Encoder(path, public_tokenizers.PATTERN)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for doc_id, text in ODD:
        if doc_id == 7:
            continue
        spans = list(zip(*encoder.spans(text or ""), strict=True))
        found = sorted(by[doc_id], key=lambda r: r.section)
        want, share = [0] * len(found), [0.0] * len(found)
        for a, b in spans:
            over = [max(0, min(b, r.end) - max(a, r.start)) for r in found]
            want[over.index(max(over))] += 1
            for k, o in enumerate(over):
                share[k] += o / (b - a)
        assert [r.n_tokens for r in found] == want
        assert np.allclose([r.share for r in found], share)
        assert {r.doc_tokens for r in found} == {len(spans)}
    assert token_attribution.count_tokens(empty, path, public_tokenizers.PATTERN).count() == 0
    assert sum(r.n_tokens for r in token_attribution.count_tokens(odd, path, public_tokenizers.PATTERN, rule="start").collect()) == sum(len(encoder.spans(t or "")[0]) for _, t in ODD)
    with pytest.raises(ValueError):
        token_attribution.count_tokens(odd, path, public_tokenizers.PATTERN, rule="none")


# 2. Sharding.


def test_shards_slots_and_growth(spark, odd, empty):
    docs = frame(spark, [(i, prose(3)) for i in range(3000)]).unionByName(odd)
    rows = sharding.shard_documents(docs).collect()
    assert len(rows) == 3000 + len(ODD)
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16) and r.law == "key"
    assert set(slots) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) < 1.35 * len(rows) / 16
    texts = collections.Counter((i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t in ODD)
    assert not texts - collections.Counter((r.doc_id, r.text_crc32, r.size) for r in rows)
    assert sharding.shard_documents(empty).count() == 0


def brute_place(key, leaves, salt="shard"):
    """The descent, one row at a time, over the hashes that Spark gives."""
    nodes, out = [x for x in leaves if x.weight > 0], None
    for level in ("region", "rack", "shard"):
        weights = collections.defaultdict(float)
        for x in nodes:
            weights[getattr(x, level)] += x.weight
        out = min((-math.log(((key[level, child] % 2**64 >> 11) + 0.5) / 2**53) / w, child) for child, w in weights.items())[1]
        nodes = [x for x in nodes if getattr(x, level) == out]
    return out


def test_placement_equals_brute_force(spark):
    tree = [sharding.Shard(0, 0, 0, 2.0), sharding.Shard(0, 0, 1, 0.5), sharding.Shard(0, 1, 2), sharding.Shard(1, 2, 3, 3.0), sharding.Shard(1, 3, 4, 0.0)]
    hashes = [F.xxhash64("doc_id", F.lit("shard"), F.lit(level), F.lit(child)).alias(f"{level}_{child}") for level in ("region", "rack", "shard") for child in range(5)]
    for r in sharding.place(spark.range(300).withColumnRenamed("id", "doc_id"), "doc_id", {"to": tree}).select("to", *hashes).collect():
        assert r.to == brute_place({(level, child): r[f"{level}_{child}"] for level in ("region", "rack", "shard") for child in range(5)}, tree)


def moves(spark, before, after):
    rows = sharding.place(spark.range(20_000).withColumnRenamed("id", "doc_id"), "doc_id", {"a": before, "b": after}).groupBy("a", "b").count().collect()
    return {(r.a, r.b): r["count"] for r in rows if r.a != r.b}, collections.Counter({r.b: 0 for r in rows}) + sum((collections.Counter({r.b: r["count"]}) for r in rows), collections.Counter())


def test_only_changed_subtrees_move(spark):
    before = sharding.even_tree(16)
    heavier = [dataclasses.replace(s, weight=3.0 if s.shard == 5 else 1.0) for s in before]
    moved, held = moves(spark, before, heavier)
    of = {s.shard: s for s in before}
    # Into the region, inside the region into the rack, inside the rack into the shard.
    for a, b in moved:
        x, y = of[a], of[b]
        assert y.region == 0 if x.region != y.region else y.rack == 1 if x.rack != y.rack else b == 5
    assert abs(held[5] / 20_000 - 3 / 18) < 0.02 and abs(held[0] / 20_000 - 1 / 18) < 0.01


def test_a_swap_inside_a_region_stays_inside(spark):
    before = sharding.even_tree(16)
    swapped = [dataclasses.replace(s, weight={0: 2.0, 1: 0.5}.get(s.rack, 1.0)) for s in before]
    swapped = [dataclasses.replace(s, weight=s.weight * (8 / 10 if s.region == 0 else 1)) for s in swapped]
    moved, _ = moves(spark, before, swapped)
    of = {s.shard: s for s in before}
    assert moved and all(of[a].region == of[b].region == 0 and of[a].rack == 1 and of[b].rack == 0 for a, b in moved)
    inner = [dataclasses.replace(s, weight={4: 1.5, 5: 0.5}.get(s.shard, 1.0)) for s in before]
    assert all({a, b} <= {4, 5, 6, 7} and (a == 5 or b == 4) for a, b in moves(spark, before, inner)[0])


def test_a_grown_tree_takes_rows_only_into_the_new_shard(spark):
    for n in (1, 5, 11, 16):
        moved, held = moves(spark, sharding.even_tree(n), sharding.grown(sharding.even_tree(n)))
        assert moved and {b for _, b in moved} == {n} and abs(held[n] / 20_000 - 1 / (n + 1)) < 0.02


# 3 and 5. Language and toxicity.


def tongues(n):
    rng = random.Random(1)
    parts = {"aa": ["sch", "ung", "ein", "ich", "tz"], "bb": ["tion", "the", "ing", "and", "er"], "cc": ["ção", "que", "mente", "ado", "ñe"]}
    return [(k, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(30)), lang) for k in range(n) for lang in [("aa", "bb", "cc")[k % 3]]]


def test_language_held_out_and_edges(spark, odd, empty):
    rows = tongues(240)
    docs = frame(spark, [(k, t) for k, t, _ in rows], [lang for *_, lang in rows])
    held = language_id.remainder("doc_id", 3) == 1
    model = language_id.train(docs, ~held)
    out = got(language_id.predict(docs, model, held))
    assert all(out[k].lang_pred == lang and 0 <= out[k].score <= 1 and out[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k, _, lang in rows)
    assert (model.weights == 0).mean() > 0.5  # sparse
    edge = got(language_id.predict(odd, model, held))
    assert all(edge[k].lang_pred == "und" and edge[k].score == 0 for k in (1, 2, 3, 6))
    assert edge[8].lang_pred == edge[11].lang_pred and edge[8].score == edge[11].score
    assert language_id.predict(empty, language_id.train(empty, ~held), held).count() == 0
    untaught = language_id.train(docs, F.lit(False))
    assert {r.lang_pred for r in language_id.predict(docs, untaught, held).collect()} == {"und"}
    assert sorted(r.doc_id for r in language_id.keep_known(docs.unionByName(frame(spark, [(900, "123 ..."), (901, None)])), ~held).collect()) == [k for k, *_ in rows]


def test_letters_of_all_planes(spark):
    rows = tongues(60)
    docs = frame(spark, [(k, t) for k, t, _ in rows], [lang for *_, lang in rows])
    model = language_id.train(docs, F.lit(True))
    odd = frame(spark, [(1, "\U0001f600 \U0001f680 123"), (2, "\U00010400\U00010401"), (3, "\u2014\u00a0\u0301"), (4, "ein ich\U0001f600")])
    out = got(language_id.predict(odd, model, F.lit(False)))
    assert (out[1].lang_pred, out[1].score) == (out[3].lang_pred, out[3].score) == ("und", 0.0) and out[4].lang_pred == "aa"
    assert out[2].lang_pred in ("aa", "bb", "cc")
    assert language_id.bins("\U00010400").tolist() == language_id.bins("\U00010428").tolist()  # an upper and its lower case


def test_only_teaching_rows_teach(spark):
    """Held-out texts and rows without a language change nothing in the model."""
    rows = tongues(90)
    docs = frame(spark, [(k, t) for k, t, _ in rows], [lang for *_, lang in rows])
    held = language_id.remainder("doc_id", 3) == 1
    others = frame(spark, [(k, "zzz qqq " + prose(30)) for k in range(1000, 1060)], [["aa", None][zlib.crc32(str(k).encode()) % 3 != 1] for k in range(1000, 1060)])
    a, b = language_id.train(docs, ~held), language_id.train(docs.unionByName(others), ~held)
    assert np.array_equal(a.idf, b.idf) and np.array_equal(a.weights, b.weights) and a.temperature == b.temperature


def test_temperature_and_sample_bound(spark):
    logits = np.random.default_rng(0).normal(size=(500, 3)) * 9
    labels = np.array([np.random.default_rng(k).choice(3, p=language_id.softmax(z / 4)) for k, z in enumerate(logits)])
    assert 2.5 < language_id.fit_temperature(logits, labels) < 6
    rows = spark.range(5000).select(F.lit("x").alias("g"), F.col("id").alias("doc_id"))
    n = language_id.least_hashes(rows, "g", rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")), 400).count()
    assert 400 <= n <= 600


def insults(n):
    rng = random.Random(2)
    out = []
    for k in range(n):
        words = prose(rng.randint(20, 200), rng).split()
        toxic = k % 4 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["idiotic", "scum", "loweiung", "loweichen"]))
        out.append((k, " ".join(words), int(toxic)))
    return out


def test_toxicity_held_out_and_edges(spark, odd, empty):
    rows = insults(800)
    docs, labels = frame(spark, [r[:2] for r in rows]), spark.createDataFrame([(k, y) for k, _, y in rows] + [(None, 1), (5000, None)], "doc_id long, toxic int")
    held = language_id.remainder("doc_id", 5) == 0
    machine = toxicity.train(docs, labels, ~held)
    out = got(toxicity.score(docs, machine, held))
    wrong = [k for k, _, y in rows if out[k].held_out and out[k].predicted != y]
    assert len(wrong) <= 2
    edge = got(toxicity.score(odd, machine, held))
    assert edge[1].score == edge[2].score and edge[8].score == edge[11].score and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in edge.values())
    assert toxicity.score(empty, machine, held).count() == 0
    assert got(toxicity.score(odd, toxicity.train(docs, labels.limit(0), ~held), held))[8].score < 0.01
    assert toxicity.keep_civil(docs, labels, ~held).filter("doc_id % 4 = 0").count() <= 4


def test_terms_that_take_part_are_bounded(monkeypatch):
    rng = np.random.default_rng(2)
    ones, zeros = rng.integers(0, 50, 300).astype(float), rng.integers(0, 50, 300).astype(float)
    every = toxicity.telling_terms(ones, zeros, 100.0, 100.0)
    chi2 = {k: 200 * (ones[k] * (100 - zeros[k]) - zeros[k] * (100 - ones[k])) ** 2 / ((ones[k] + zeros[k]) * (200 - ones[k] - zeros[k]) * 1e4) for k in range(300) if 0 < ones[k] + zeros[k] < 200}
    assert every.tolist() == sorted(k for k, c in chi2.items() if c >= 15 and ones[k] + zeros[k] >= 4)
    monkeypatch.setattr(toxicity, "MOST_TERMS", 7)
    few = toxicity.telling_terms(ones, zeros, 100.0, 100.0).tolist()
    assert len(few) == 7 and min(chi2[k] for k in few) >= max(chi2[k] for k in every.tolist() if k not in few)
    assert toxicity.telling_terms(ones, zeros, 0.0, 100.0).tolist() == []


def test_machine_learns_a_pair():
    """Two terms that are harmless alone and toxic together."""
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for k in range(1200):
        a, b = rng.random(2) < 0.5
        rows.append(np.unique(np.concatenate([rng.integers(100, 160, 4), [1] * int(a), [2] * int(b)]).astype(np.int64)))
        labels.append(int(a and b))
    m = toxicity.fit(rows, np.array(labels), epochs=25)
    f = lambda s: m.bias + m.weight[s].sum() + ((m.factor[s].sum(0) ** 2).sum() - (m.factor[s] ** 2).sum()) / 2
    assert f([1, 2]) > 0 > max(f([1]), f([2]))
    assert m.factor[1] @ m.factor[2] > 0


# 4. Suffix-array dedup.


def brute_spans(rows):
    """By id: which bytes go."""
    out, seen, span = [], {}, suffix_dedup.SPAN
    for k, (i, t) in enumerate(rows):
        data = (t or "").encode()
        for p in range(len(data) - span + 1):
            w, rank = data[p : p + span], float("inf") if i is None else i
            seen[w] = min(seen.get(w, rank), rank)
    for i, t in rows:
        data, rank = (t or "").encode(), float("inf") if i is None else i
        gone = bytearray(len(data))
        for p in range(len(data) - span + 1):
            if seen[data[p : p + span]] < rank:
                gone[p : p + span] = b"\1" * span
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((i, len(data), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return collections.Counter(out)


def test_spans_equal_brute_force(spark, odd, empty, monkeypatch):
    rng = random.Random(9)
    passages = [prose(30, rng) for _ in range(4)]
    rows = [(k, " ".join(rng.choice([prose(rng.randint(1, 40), rng), *passages]) for _ in range(3))) for k in range(60)]
    rows += [(60, "ab" * 90), (61, "x" + "ab" * 60), (62, "é" * 70), (63, "é" * 40 + prose(9)), (63, "é" * 40), (64, passages[0][:49]), (65, passages[0][:50]), (66, "z" * 50), (67, "z" * 49), (68, None), (None, passages[1]), (None, passages[1])]
    rows += [r for r in ODD if r[0] != 7]
    docs = frame(spark, rows)
    for block, bucket in ((suffix_dedup.BLOCK, suffix_dedup.BUCKET), (3000, 5000)):  # one block, and many
        monkeypatch.setattr(suffix_dedup, "BLOCK", block)
        monkeypatch.setattr(suffix_dedup, "BUCKET", bucket)
        assert collections.Counter(tuple(r) for r in suffix_dedup.repeated_spans(docs).collect()) == brute_spans(rows)
    assert suffix_dedup.repeated_spans(empty).count() == 0
    cut = suffix_dedup.drop_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    assert suffix_dedup.drop_repeats(empty).count() == 0


def test_dictionary_and_parse_give_the_corpus_order():
    """Ranges of the parse's order by the dictionary's suffixes, written out, are all spans of all places, sorted."""
    rng, span = random.Random(3), suffix_dedup.SPAN
    phrases = ["".join(rng.choice("ab") for _ in range(rng.randint(50, 60))).encode() for _ in range(8)]
    phrases += [phrases[0][:52], phrases[0][1:] + b"a", b"a" * 70]  # a prefix, a shifted copy, a phrase that repeats itself
    places = [(rng.randrange(40), rng.choice(phrases)) for _ in range(60)]
    ids, texts = np.array([i for i, _ in places]), [p for _, p in places]
    code, dictionary = suffix_dedup._ranked(*suffix_dedup._distinct(np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])))
    assert dictionary.to_pylist() == sorted(set(texts)) and [dictionary[int(c)].as_py() for c in code] == texts
    held = np.array([len(t) - span + 1 for t in dictionary.to_pylist()])
    entry = np.repeat(np.arange(len(held)), held)
    k = np.arange(len(entry)) - np.repeat(np.cumsum(held) - held, held)
    data = np.frombuffer(b"".join(dictionary.to_pylist()), np.uint8)
    order, changed = suffix_dedup.suffix_order(data, (np.repeat(np.cumsum(held + span - 1) - (held + span - 1), held) + k).astype(np.int32))
    parse, begin = suffix_dedup.parse_order(code, ids, len(held))
    first, count, runs = suffix_dedup.corpus_order(order, changed, entry, begin)
    got = [(texts[p][k[s] : k[s] + span], int(ids[p])) for s, a, n in zip(order, first, count, strict=True) for p in parse[a : a + n]]
    want = [(t[j : j + span], int(i)) for i, t in zip(ids, texts, strict=True) for j in range(len(t) - span + 1)]
    assert [g[0] for g in got] == sorted(w[0] for w in want) and collections.Counter(got) == collections.Counter(want)
    lowest = np.minimum.reduceat(ids[parse[first]], runs)
    assert [int(x) for x in lowest] == [min(i for u, i in want if u == t) for t in sorted({t for t, _ in want})]


def test_steps_do_not_matter(monkeypatch):
    data = np.frombuffer(LONG.encode()[:9000], np.uint8)
    ends = np.array([10, 60, 60, 700, 4000, 9000])
    whole = suffix_dedup.Parse(data, ends)
    spans = {p + k for p, n in zip(whole.first, whole.spans, strict=True) for k in range(n)}
    assert spans == {p for a, b in zip([0, *ends[:-1]], ends, strict=True) for p in range(a, b - 49)}
    monkeypatch.setattr(suffix_dedup, "STEP", 128)
    small = suffix_dedup.Parse(data, ends)
    at = lambda x: {int(p + k): int(t) for p, n, t in zip(x.first, x.spans, x.trigger, strict=True) for k in range(n)}
    assert at(whole) == at(small)


# 6. Near-duplicates.


def test_near_duplicates(spark, odd, empty, monkeypatch):
    rng = random.Random(5)
    base = [prose(150, rng) for _ in range(12)]
    rows = [(k, t) for k, t in enumerate(base)]
    for k, t in enumerate(base):
        words = t.split(" ")
        for j in range(6):
            x = list(words)
            x[rng.randrange(len(x))] = "changed"
            rows.append((100 + 10 * k + j, " ".join(x)))
        rows.append((300 + k, t.upper()))  # the same words
        rows.append((400 + k, " ".join(words[:75]) + " " + prose(75, rng)))  # half of it
    rows += [(900, None), (901, None), (902, ""), (903, ""), (904, "one two"), (905, "One, two!"), (None, base[0])]
    out = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    for k in range(12):
        assert {out[100 + 10 * k + j] for j in range(6)} == {k} and out[300 + k] == k and out[400 + k] == 400 + k
    assert (out[900], out[901], out[902], out[903], out[904], out[905], out[None]) == (900, 901, 902, 902, 904, 904, 0)
    assert near_dedup.near_duplicates(empty).count() == 0
    kept = near_dedup.keep_one(frame(spark, rows))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({c for c in out.values()}) and kept.columns == odd.columns
    assert near_dedup.near_duplicates(odd).count() == len(ODD)


def test_chain_is_one_class(spark, monkeypatch):
    """Neighbours are alike, the ends are not: what the first comparison leaves open is compared too."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    words = [f"w{k}" for k in range(160)]
    rows = [(k, " ".join(words[3 * k : 3 * k + 100])) for k in range(20)]
    out = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert set(out.values()) == {0}


def test_samples_follow_weighted_jaccard():
    rng = np.random.default_rng(6)
    keys = near_dedup.mix64(np.arange(1, 301, dtype=np.uint64))
    a, b = rng.uniform(0.5, 5, 300), rng.uniform(0.5, 5, 300)
    b[:200] = a[:200]
    sample = lambda w: near_dedup.samples(np.zeros(300, np.int64), keys, w, 1, 4000)[0]
    agree = (sample(a) == sample(b)).mean()
    assert abs(agree - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


def test_sets_compare_like_brute_force():
    texts = [prose(60), "", "a b", prose(60)]
    texts.append(" ".join(texts[0].split()[:40]))
    of_bin = np.random.default_rng(1).uniform(1, 5, 2 << near_dedup.BITS)
    sets = near_dedup.Sets(texts, of_bin)

    def bag(t):
        text, shingle, count, _ = near_dedup.shingles([t])
        return dict(zip(shingle.tolist(), near_dedup.weights(shingle, count, of_bin), strict=True))

    x, y = bag(texts[0]), bag(texts[4])
    want = sum(min(x.get(k, 0), y.get(k, 0)) for k in x | y) / sum(max(x.get(k, 0), y.get(k, 0)) for k in x | y)
    assert np.isclose(sets.with_one(0)[4], want) and sets.with_one(0)[1] == 0


def test_weights_fall_with_document_frequency(spark):
    """A passage of many documents weighs less than words of one; what all have weighs 1."""
    shared, common = prose(20), prose(12)
    rows = [(k, f"{common} {prose(30)} {shared if k % 2 else prose(20)}") for k in range(400)]
    of_bin = near_dedup.bin_weights(*near_dedup.shared_bins(frame(spark, rows), "text"))

    def mean_weight(text):
        _, shingle, count, _ = near_dedup.shingles([text])
        return float(near_dedup.weights(shingle, count, of_bin).mean())

    one = " ".join(rows[0][1].split()[14:40])
    assert 0.99 < mean_weight(common) < mean_weight(shared) < mean_weight(one) - 0.3 < 1.71
    assert np.isclose(mean_weight(shared), 1 + np.log(2) / np.log(400), atol=0.03)  # the floor is one document here


def test_recall_against_all_pairs(spark):
    """Every pair of 0.8 or more under the operator's weights is in one class, and classes are nothing else."""
    rng = random.Random(12)
    boiler = prose(25, rng)
    rows = []
    for g in range(25):
        base = (boiler + " " + prose(130, rng)).split()
        for j in range(rng.randint(2, 7)):
            words = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                words[rng.randrange(25, len(words))] = f"edit{rng.random()}"
            rows.append((10 * g + j, " ".join(words)))
    docs = frame(spark, rows)
    of_bin = near_dedup.bin_weights(*near_dedup.shared_bins(docs, "text"))
    bags = {}
    for i, t in rows:
        words = re.findall(r"[0-9a-z]+", t.lower())
        bag = collections.Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        bags[i] = {g: n * float(near_dedup.weights(near_dedup.shingles([" ".join(g)])[1], np.ones(1), of_bin)[0]) for g, n in bag.items()}
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = 0
    for i, a in bags.items():
        for j, b in bags.items():
            if i < j and sum(min(w, b.get(g, 0)) for g, w in a.items()) >= 0.8 * sum(max(a.get(g, 0), b.get(g, 0)) for g in a | b):
                pairs += 1
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    out = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    assert pairs > 40 and out == {i: root(i) for i in parent}


def test_texts_of_one_id_tie_their_classes(spark):
    a, b = prose(120), prose(120)
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, prose(120)), (1, a), (5, a), (6, b)]
    for order in (rows, rows[::-1]):
        out = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(frame(spark, order)).collect()}
        assert out == {1: 1, 2: 1, 3: 1, 4: 4, 5: 1, 6: 1}


def test_the_floor_falls_with_the_corpus():
    """What a bin's count cannot tell from nothing is a smaller share of more documents."""
    size = 2 << near_dedup.BITS
    shares = []
    for n in (10**3, 10**6, 10**8):
        df = np.full(size, 400 * n / (size / 2))
        df[0] += n * 1e-4
        w = near_dedup.bin_weights(df, n)
        shares.append(float(w[0]))
        assert w[1] == 2 and 1 < w[0] <= 2
    assert shares[0] == 2 and shares[0] > shares[1] > shares[2]


def test_recall_of_planted_copies(spark):
    """Copies with a known share of edited words, judged by plain counts of shingles, not by the operator's weights."""
    rng = random.Random(21)
    rows, pairs = [], []
    for g in range(120):
        base = prose(200, rng).split()
        size = 40 if g == 0 else 2
        for j in range(size):
            words = list(base)
            for k in rng.sample(range(len(words)), rng.choice([0, 1, 2, 3]) if j else 0):
                words[k] = f"edit{rng.random()}"
            rows.append((100 * g + j, " ".join(words)))
            if j:
                pairs.append((100 * g, 100 * g + j))
    rows += [(10**6 + k, prose(200, rng)) for k in range(400)]
    out = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    text = dict(rows)

    def grams(t):
        words = re.findall(r"[0-9a-z]+", t.lower())
        return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}

    alike = [(i, j) for i, j in pairs if len(grams(text[i]) & grams(text[j])) >= 0.8 * len(grams(text[i]) | grams(text[j]))]
    assert len(alike) > 100
    assert sum(out[i] == out[j] for i, j in alike) >= 0.95 * len(alike)
    assert all(out[i] == i for i in out if i >= 10**6)


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 120)] + [(5, 5), (200, 201), (201, 200)]
    out = {r.id: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {out[k] for k in range(31)} == {0} and {out[k] for k in range(100, 120)} == {100} and out[201] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 7. Packing.


def test_packing(spark, odd, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    rows = packing.pack(odd, path, capacity=256).collect()
    by, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, t in ODD:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        pieces = sorted(by[i], key=lambda r: r.start)
        assert [p.start for p in pieces] == np.cumsum([0, *[p.length for p in pieces[:-1]]]).tolist() and pieces[-1].start + pieces[-1].length == len(ids)
        assert all(p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) and p.doc_tokens == len(ids) for p in pieces)
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == np.cumsum([0, *[r.length for r in s[:-1]]]).tolist() and sum(r.length for r in s) <= 256
    assert len(sequences) == -(-sum(r.length for r in rows) // 256)
    assert packing.pack(empty, path).count() == 0


def test_costs_are_balanced():
    lengths = sorted(random.Random(1).choices(range(1, 900), k=300), reverse=True)
    placed, cost = packing.balance(lengths, 4096)
    assert sum(n for _, _, n, _ in placed) == sum(lengths) and cost.max() / cost.mean() < 1.2


# 8. Quality rules.


def test_quality_counts(spark, odd, empty):
    out = got(quality_rules.compression_bands(odd))
    for i, t in ODD:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        n = collections.Counter(zip(words, words[1:], words[2:]))
        often = {k + j for k in range(len(words) - 2) if n[tuple(words[k : k + 3])] > 1 for j in range(3)}
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(often))
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)
    assert not out[12].kept  # one word
    assert quality_rules.compression_bands(empty).count() == 0


def test_bands_reject_repeats_and_noise(spark):
    rng = random.Random(7)
    noise = " ".join("".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(5)) for _ in range(3000))
    phrase = [prose(12, rng) for _ in range(3)]
    repeats = " ".join(rng.choice(phrase) for _ in range(400))
    words = ["".join(rng.choices("etaoinshrdlucmfwypvbgk", range(22, 0, -1), k=rng.randint(1, 9))) for _ in range(6000)]
    fine = [" ".join(rng.choices(words, [1 / (k + 3) for k in range(6000)], k=n)) for n in (60, 300, 3000)]  # frequent and rare words
    out = got(quality_rules.compression_bands(frame(spark, [(1, noise), (2, repeats), (3, fine[2]), (4, fine[1]), (5, fine[0])])))
    assert out[3].kept and out[4].kept and out[5].kept
    assert out[1].ratio < out[3].ratio < out[2].ratio
    assert not out[1].kept and not out[2].kept and not out[1].base_failed


def test_bands_reject_poor_wording(spark):
    """Texts over few words compress better than good texts of their length, if by less than repeats do."""
    poor = {}
    for i, (vocabulary, n) in enumerate([(300, 150), (200, 150)]):
        rng = random.Random(9)
        words = ["".join(rng.choices("etaoinshrdlucmfwypvbgk", range(22, 0, -1), k=rng.randint(1, 9))) for _ in range(vocabulary)]
        poor[i] = " ".join(rng.choices(words, [1 / (k + 3) for k in range(vocabulary)], k=n))
    out = got(quality_rules.compression_bands(frame(spark, list(poor.items()))))
    for i in poor:
        assert 512 <= len(poor[i]) < 1024 and 1.95 < out[i].ratio < 2.1
        assert not out[i].base_failed and not out[i].kept


def test_bands_measure_the_last_bytes(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("etaoinshrdlucmfwypvbgk", range(22, 0, -1), k=rng.randint(1, 9))) for _ in range(2000)]
    good = [" ".join(rng.choices(words, [1 / (k + 3) for k in range(2000)], k=n)) for n in (3000, 5000)]
    noise = base64.b64encode(rng.randbytes(3000)).decode()
    rows = [(i, t[: 4096 * k]) for i, t, k in ((1, good[0], 1), (2, good[1], 4))]
    rows += [(i + 2, t + noise) for i, t in rows] + [(5, good[1][:10_000])]
    out = got(quality_rules.compression_bands(frame(spark, rows)))
    assert all(out[i].chunk_low > 1.5 for i in (1, 2, 5))
    for i in (3, 4):
        assert out[i].chunk_low < 1.5 and not out[i].base_failed and not out[i].kept
    press = zstandard.ZstdCompressor(level=quality_rules.LEVEL).compress
    parts = [4096 / len(press(rows[4][1][k : k + 4096].encode())) for k in (0, 4096, 10_000 - 4096)]
    assert (out[5].chunk_low, out[5].chunk_high) == (min(parts), max(parts))


def test_kept_equals_brute_force(spark):
    """The verdict from the limits and the compressor alone."""
    rng = random.Random(15)
    words = ["".join(rng.choices("etaoinshrdlucmfwypvbgk", range(22, 0, -1), k=rng.randint(1, 9))) for _ in range(1500)]
    rows = [(k, " ".join(rng.choices(words[: rng.choice([20, 150, 1500])], k=rng.choice([10, 60, 150, 400, 900, 2500])))) for k in range(120)]
    rows += [(1000 + k, t + base64.b64encode(rng.randbytes(rng.choice([100, 3000]))).decode()) for k, t in rows[:20]] + [(2000, None), (2001, "")]
    out = got(quality_rules.compression_bands(frame(spark, rows)))
    size = lambda b: len(zstandard.ZstdCompressor(level=quality_rules.LEVEL).compress(b))
    for i, t in rows:
        data = (t or "").encode()
        want = bool(data) and not out[i].base_failed
        if want:
            band = [b for b in quality_rules.BANDS if len(data) < b.below][0]
            starts = set(range(0, len(data) - 4095, 4096)) | ({len(data) - 4096} if len(data) >= 4096 else set())
            chunks = [4096 / size(data[k : k + 4096]) for k in starts]
            want = band.low <= len(data) / size(data) <= band.high and all(quality_rules.CHUNKS.low <= c <= quality_rules.CHUNKS.high for c in chunks)
        assert out[i].kept == want, i
    assert {r.kept for r in out.values()} == {True, False}


# 9. Byte-level BPE.


def test_bpe_equals_the_library(spark, odd, empty):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = got(byte_bpe.encode_and_decode(odd, path, public_tokenizers.PATTERN, keep_ids=True))
    for i, t in ODD:
        ids = ref.encode_ordinary(t or "")
        assert out[i].ids == ids and out[i].n_tokens == len(ids)
        assert out[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert out[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    bpe = byte_bpe.coder(path, public_tokenizers.PATTERN)
    rng = random.Random(8)
    texts = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 1500), rng.randrange(0x4E00, 0x9FFF)])) for _ in range(rng.randint(1, 300))) for _ in range(200)] + ["a" * 5000, " " * 999]
    assert [x.tolist() for x in bpe.encode_batch(texts)] == [ref.encode_ordinary(t) for t in texts]
    assert byte_bpe.encode_and_decode(empty, path, public_tokenizers.PATTERN).count() == 0


def test_long_unbroken_pieces_equal_the_library():
    import time

    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = byte_bpe.read_ranks(path)
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    bpe = byte_bpe.ByteBPE(ranks, public_tokenizers.PATTERN)
    rng = random.Random(11)
    letters = lambda n: "".join(rng.choices("etaoinshrdlucmfwypvbgkéü", k=n))
    texts = [letters(n) for n in (63, 64, 65, 100, 1000, 20_000)] + ["".join(VOCABULARY * 10), "ab" * 3001, "a" * 4097, "=" * 777, "-=" * 500, "the" * 900 + letters(50)]
    texts += ["".join(chr(rng.randrange(0x4E00, 0x4F00)) for _ in range(3000)), "".join(rng.choice(["ein", "ung", "tion", "sch", "aaa"]) for _ in range(2000)), "x" + "\u0e01\u0e32\u0e23" * 800, " " * 5000, "\n" * 900]
    assert [x.tolist() for x in bpe.encode_batch(texts)] == [ref.encode_ordinary(t) for t in texts]
    data = "".join(texts[:7]).encode()
    assert b"".join(bpe.part_long(data)) == data
    # The rounds of a long part agree with the matrix that merges one pair at a time.
    for t in (texts[3], texts[7][:200], texts[13][:300]):
        assert bpe.merge_long(t.encode()) == bpe._by_merges([t.encode()], [b""])[0]
    begin = time.time()
    for t in (letters(1 << 20), "ab" * (1 << 19), "".join(rng.choices(VOCABULARY, k=170_000))):
        assert bpe.decode(bpe.encode_batch([t])[0]) == t.encode()
    assert time.time() - begin < 60
    assert max(map(len, bpe.known)) <= byte_bpe.LONG


# 10. Fingerprints.


def test_fingerprints(spark, odd, empty):
    rows = [(k, prose(120)) for k in range(20, 80)] + ODD
    out = fingerprints.fingerprint(frame(spark, rows), low=1 / 100, high=0.9).collect()
    assert len(out) == len(rows)
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    found = {r.doc_id: r for r in out}
    for k, (i, t) in enumerate(ordered):
        t, after = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        n = len(t) // 3
        assert found[i].edited_sha256 == hashlib.sha256((t[: len(t) - n] + after[:n]).encode()).hexdigest() and found[i].n_chars == len(t)
        assert 0 <= found[i].near_edited <= 1 and 0 <= found[i].near_next <= 1
        assert np.isclose(found[i].near_next, fingerprints.likeness(found[i].fingerprint, found[ordered[(k + 1) % len(ordered)][0]].fingerprint))
    assert found[8].fingerprint == found[11].fingerprint and found[8].fingerprint != found[9].fingerprint
    assert np.mean([r.near_edited for r in out if r.n_chars > 300]) > np.mean([r.near_next for r in out if r.n_chars > 300])
    assert fingerprints.fingerprint(empty).count() == 0
    one = fingerprints.fingerprint(frame(spark, [(1, "abc def")])).collect()
    assert len(one) == 1 and one[0].near_next == 1


def test_every_lexicon_term_is_in_a_fingerprint():
    from lacuna.llm.common import Words

    words = [f"term{k}" for k in range(500)]
    lexicon = fingerprints.Lexicon(np.sort(Words(words).hash[: len(words)]))
    small = 1 + lexicon.large
    assert lexicon.places(words)[:, small:].any(axis=1).all()
    text = " ".join(words)
    without = [" ".join(words[:k] + words[k + 1 :]) for k in range(len(words))]
    places = lexicon.places([text, *without])
    assert ((places[1:, small:] != places[0, small:]).sum(axis=1) == 1).all()
    assert (places[1:, 0] != places[0, 0]).all()
    same = (places[1:, 1:small] == places[0, 1:small]).mean()
    assert abs(same - (1 - fingerprints.KEEP)) < 0.05


def test_fingerprints_equal_brute_force():
    """Places from sets of terms, one text and one lexicon at a time."""
    from lacuna.llm.common import Words, mix64

    hash_of = {w: int(Words([w]).hash[0]) for w in VOCABULARY}
    texts = [prose(90) for _ in range(20)] + ["", "unknown words only", VOCABULARY[0], f"{VOCABULARY[3].upper()}! {VOCABULARY[3]}"]
    lexicon = fingerprints.Lexicon(np.sort(np.array(list({hash_of[w] for w in VOCABULARY[:200]}), np.uint64)))
    mix = lambda x: int(mix64(np.array([x % 2**64], np.uint64))[0])

    def place(terms):
        return mix(sum(mix(t + mix(k + 1)) for k, t in enumerate(sorted(terms)))) | 1 if terms else 0

    found = lexicon.places(texts)
    for text, row in zip(texts, found, strict=True):
        terms = {hash_of[w] for w in re.findall(r"[0-9a-z]+", text.lower()) if w in VOCABULARY[:200]}
        want = [place(terms)] + [place({t for t in terms if mix(t + mix(6 + k)) < 0.75 * 2**64}) for k in range(lexicon.large)]
        want += [place({t for t in terms if mix(t + mix(5)) % lexicon.small == k}) for k in range(lexicon.small)]
        assert row.tolist() == want


def test_a_large_lexicon_is_whole(monkeypatch):
    """Where a task does not keep the random lexicons of all terms, it works out the same places."""
    from lacuna.llm.common import Words

    words = [f"term{k}" for k in range(300)]
    terms = np.sort(Words(words).hash[: len(words)])
    texts = [" ".join(words[k : k + 40]) for k in range(0, 250, 7)]
    kept = fingerprints.Lexicon(terms)
    monkeypatch.setattr(fingerprints, "KEPT_TERMS", 10)
    met = fingerprints.Lexicon(terms)
    assert kept.kept and not met.kept and (kept.places(texts) == met.places(texts)).all()


def test_lexicon_is_the_band(spark):
    from lacuna.llm.common import Words

    docs = frame(spark, [(k, "common " + ("half " if k % 2 else "") + f"rare{k}") for k in range(100)])
    terms = fingerprints.build_lexicon(docs, "text", 0.1, 0.6)
    assert terms.tolist() == Words(["half"]).hash.tolist()


def test_a_common_passage_is_dealt_over_buckets(spark):
    import pyarrow as pa
    import pyarrow.compute as pc

    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz "
    passage = "".join(rng.choices(letters, k=70))
    texts = [("".join(rng.choices(letters, k=40)) + passage + "".join(rng.choices(letters, k=40))).encode() for _ in range(12_000)]
    docs = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.binary()), "block": pa.array([0] * len(texts), pa.int64())})
    buckets = 64
    reported = suffix_dedup._report(buckets)((pa.scalar(0),), docs)
    rows = [suffix_dedup._shared((pa.scalar(b),), reported.filter(pc.equal(reported.column("bucket"), b))) for b in set(reported.column("bucket").to_pylist())]
    sent = suffix_dedup._send(buckets)(docs, pa.concat_tables(rows))
    held = [len(x) for x in sent.column("spans").to_pylist()]
    assert len(held) > buckets / 2 and max(held) < sum(held) / 8

    few = frame(spark, [(i % 250, t.decode()) for i, t in enumerate(texts[:300])] + [(900 + i, t[7:130].decode()) for i, t in enumerate(texts[:40])])
    plain, split = (sorted((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix_dedup.repeated_spans(few, hot=h).collect()) for h in (1 << 40, 3))
    assert plain == split and sum(r[2] for r in plain) > 0
