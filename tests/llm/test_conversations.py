"""Conversation operators against brute force, with nulls, empty texts, ties, repeats and clashing columns."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from lacuna.llm import conversation_repair as repair
from lacuna.llm import queries, sql

SCHEMA = "conv_id long, turn long, role string, text string, signature string, kind string, digest string, fault string, rank string, n string"
BLANK = " \t\n\x0b\x0c\r"


def talks(n, rng, longest=7):
    """Conversations that share turns, with faults of every kind."""
    rows = []
    for c in range(n):
        for t in range(rng.randint(0, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            rows.append((c, rng.choice([t, t, t, t + 1, None]), role, rng.choice(["Yes.", "No", "ok!", "", " \t", None, f"{c}?", "Why? ", "ünï. \x1c", "a\nb.\n"])))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "f", "r", "n") for r in rows], SCHEMA).repartition(3)


TALKS = talks(60, random.Random(5)) + [(100, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(300)]
TALKS += [(None, 1, "user", "no id."), (None, 2, "assistant", "none"), (101, 1, "user", "same."), (101, 1, "user", "same."), (102, 1, "user", "w. " * 50_000)]


def table(spark, rows, tmp_path):
    frame(spark, rows).select("conv_id", "turn", "role", "text").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    return con


# 13. Structure repair.


def brute_audit(signs):
    """All edits with up to four insertions, the cheapest whose roles are in order, the least in ASCII."""
    best = None
    for n_inserted in range(5):
        for places in itertools.combinations_with_replacement(range(len(signs) + 1), n_inserted):
            for ops in itertools.product("DKR", repeat=len(signs)):
                if any(o != "D" and s == "x" for o, s in zip(ops, signs, strict=True)):
                    continue
                audit = "".join("I" * places.count(k) + (ops[k] if k < len(signs) else "") for k in range(len(signs) + 1))
                kept = [s for s, o in zip(signs, ops, strict=True) if o != "D"]
                cost = sum({"D": 3, "I": 2, "R": 2, "K": 0}[o] for o in audit) + sum(s.isupper() for s in kept)
                at, slots = iter(zip(signs, ops, strict=True)), []
                for o in audit:
                    if o == "I":
                        slots.append("ua")
                    else:
                        s, o = next(at)
                        slots += [] if o == "D" else ["ua"] if o == "R" else [s.lower()]
                if any(re.fullmatch("(s?(ua)+)?", "".join(x)) for x in itertools.product(*slots)):
                    best = min(best, (cost, audit)) if best else (cost, audit)
    return best


def test_cheapest_edits_equal_brute_force():
    rng = random.Random(2)
    signs = ["", *"suaoSUAOx"] + ["".join(rng.choice("suaoUAx") for _ in range(rng.randint(2, 4))) for _ in range(60)]
    for s in signs:
        assert repair.cheapest(s) == brute_audit(s), s


def test_long_signatures_join_like_a_walk():
    """Halves against a walk over the rows, one at a time."""
    rng = random.Random(3)
    for n in (5, 64, 65, 130, 1000):
        signs = "".join(rng.choice("uauausaoUAx") for _ in range(n))
        row = repair._one(signs[0])
        for s in signs[1:]:
            row = repair._joined(row, repair._one(s))
        want = min((b[0] + more, b[1] + ins) for state, b in enumerate(row[0]) if b for end, more, ins in repair._inserted(state) if end in repair.ENDS)
        assert repair.cheapest(signs) == want


def brute_repair(rows):
    """The contract, read word by word, on what `queries.damaged` leaves; rows of one turn by role and digest."""
    talk = {}
    for c, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        talk.setdefault(c, []).extend([(turn, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1))
    out = {}
    for c, part in talk.items():
        part.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        turns = [r[0] for r in part if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults, seen, signs = [], set(), ""
        for _, role, text in part:
            bare = text.rstrip(BLANK)
            faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "-")
            seen.add((role, text))
            sign = role[0] if role[:1] in ("s", "u", "a") else "o"
            signs += "x" if faults[-1] in "bd" else sign.upper() if faults[-1] == "t" else sign
        initials = [r[1][:1] for r in part]
        illegal = sum(a + b not in ("su", "ua", "au") or not a or not b for a, b in itertools.pairwise(initials))
        cost, audit = repair.cheapest(signs)
        at, lines, state = iter(part), [], ""
        for edit in audit:
            role, text = (None, "") if edit == "I" else next(at)[1:]
            if edit == "D":
                continue
            if edit != "K":
                role = "assistant" if state == "u" else "user"
            state = role[0]
            lines.append(f"{role}:{text}")
        out[c] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def test_repair_equals_brute_force(spark, tmp_path):
    con = table(spark, TALKS, tmp_path)
    rows = queries.op13_conversation_repair(spark, str(tmp_path)).collect()
    assert len(rows) == len({r[0] for r in TALKS})
    got = {r[0]: tuple(r[1:]) for r in rows}
    assert got == brute_repair(TALKS)
    assert got[101][2] >= 1
    assert all(re.fullmatch("[DIKR]*", v[6]) for v in got.values())
    assert con.execute("SELECT count(*) FROM conversations").fetchall() == [(len(TALKS),)]


def test_repair_equals_its_sql(spark, tmp_path):
    rng = random.Random(9)
    rows = [(1000 + c, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "No", "", "Why?"])) for c in range(80) for t in range(rng.randint(1, 7))] + TALKS
    con = table(spark, rows, tmp_path)
    got = queries.op13_conversation_repair(spark, str(tmp_path))
    want = con.execute(sql.CONVERSATION_REPAIR).fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_repair_of_nothing(spark):
    assert repair.repair(frame(spark, [])).collect() == []
    only = repair.repair(frame(spark, [(1, None, "user", None)]), copies=queries.F.lit(0)).collect()
    assert [tuple(r) for r in only] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


@pytest.mark.parametrize(("text", "blank", "cut"), [("", 1, 0), (" \t\r\n\x0b\x0c", 1, 0), ("a", 0, 1), ("a. \n", 0, 0), ("a.\x1c", 0, 1), (".", 0, 0)])
def test_faults_of_a_text(spark, text, blank, cut):
    r = repair.repair(frame(spark, [(1, 0, "user", text)])).first()
    assert (r.blank, r.truncated) == (blank, cut)


# 11. Prefix trie.


def brute_trie(rows, group=20):
    talk = {}
    for c, turn, role, text in rows:
        if c is not None:
            talk.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).digest(), text or ""))
    talk = {c: [(r[2], r[4]) for r in sorted(part)] for c, part in talk.items()}
    whole = {}
    for c, part in talk.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(talk.get(c - c % group, [])[:h] + part[h:])
    members = {}
    for c, part in whole.items():
        for d in range(len(part) + 1):
            members.setdefault(part[:d], []).append(c)
    kids = {}
    for path in members:
        if path:
            kids.setdefault(path[:-1], []).append(path)

    def below(path):
        leaves, saved = int(path not in kids), (len(members[path]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0)
        for kid in kids.get(path, []):
            more = below(kid)
            leaves, saved = leaves + more[0], saved + more[1]
        return leaves, saved

    out = []
    for path, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(whole[c]) == len(path))
        out.append((min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), len(kids.get(path, [])), *below(path), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_trie_equals_brute_force_and_its_sql(spark, tmp_path):
    rng = random.Random(7)
    rows = TALKS + [(200 + c, t, "user", f"shared {t // 2}") for c in range(30) for t in range(4)] + [(400 + c, t, rng.choice("ab"), rng.choice(["x y", "z"])) for c in range(50) for t in range(rng.randint(1, 5))]
    con = table(spark, rows, tmp_path)
    got = sorted((tuple(r) for r in queries.op11_prefix_trie(spark, str(tmp_path)).collect()), key=repr)
    assert got == brute_trie(rows)
    assert got == sorted(con.execute(sql.PREFIX_TRIE).fetchall(), key=repr)


def test_ids_that_end_in_a_node_are_hashed_over_blocks(spark, monkeypatch):
    from lacuna.llm import prefix_trie

    monkeypatch.setattr(prefix_trie, "BLOCK_BITS", 3)
    ids = [*range(-20, 90), 10**12]
    rows = frame(spark, [(c, 0, "user", "same") for c in ids])
    got = {r.depth: r for r in prefix_trie.prefix_trie(prefix_trie.turn_lists(rows)).collect()}
    assert got[1].ends_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert (got[1].conv_id, got[1].n_convs, got[0].n_children, got[1].saved_tokens) == (-20, len(ids), 1, len(ids) - 1)


def test_trie_of_nothing(spark):
    from lacuna.llm import prefix_trie

    assert prefix_trie.prefix_trie(prefix_trie.turn_lists(frame(spark, []))).collect() == []
    assert prefix_trie.prefix_trie(prefix_trie.turn_lists(frame(spark, [(None, 1, "user", "x")]))).collect() == []
