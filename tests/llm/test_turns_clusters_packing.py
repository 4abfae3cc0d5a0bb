"""Conversation repair, clusters and packing against brute force, on planted and odd tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from logscan.llm import centroids, conversation_repair, packing
from logscan.llm.queries import op11_conversation_repair, op12_centroid_clustering, op13_best_fit_packing, vocabulary

CONV = "conv_id long, turn long, role string, text string"
INK = re.compile(r"[^\x20\x09-\x0D]")


# ------------------------------------------------------------------ conversation repair


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        f = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
        out += [(conv, turn, "user" if f == 4 else role, text)] * {0: 0, 3: 2}.get(f, 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2], r[3]))


def plain_faults(turns):
    seen, out = set(), []
    for _, _, role, text in turns:
        ink = INK.findall(text)
        out.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_repair(turns, faults):
    """The least (cost, audit, repaired lines), from the end backwards over turns and what may follow."""
    n, table, after = len(turns), {}, {"-": "su", "s": "u", "u": "a", "a": "u"}
    for i in range(n, -1, -1):
        now = {}
        for state in "-sua":
            follow = after[state]
            ways = [(0, "", ())] if i == n and state in "-a" else []
            if i < n:
                c, a, o = table[i + 1][state]
                ways.append((c + 4, "D" + a, o))
                if faults[i] not in ("blank", "duplicate"):
                    more, (_, _, role, text) = 3 if faults[i] else 0, turns[i]
                    if role[:1] and role[0] in follow:
                        c, a, o = table[i + 1][role[0]]
                        ways.append((c + more, "K" + a, (f"{role}:{text}", *o)))
                    for new in ("user", "assistant"):
                        if new[0] in follow:
                            c, a, o = table[i + 1][new[0]]
                            ways.append((c + more + 3, "R" + a, (f"{new}:{text}", *o)))
            now[state] = min(ways, default=(10**9, "", ()))
        for _ in range(4):  # more inserts in a row lead nowhere new
            for state in "-sua":
                for new in ("user", "assistant"):
                    if new[0] in after[state]:
                        c, a, o = now[new[0]]
                        now[state] = min(now[state], (c + 3, "I" + a, (f"{new}:", *o)))
        table[i] = now
    return table[0]["-"]


def plain_conversations(rows):
    by = defaultdict(list)
    for r in plain_damage(rows):
        by[r[0]].append(r)
    out = {}
    for conv in {r[0] for r in rows}:
        turns = by[conv]
        faults = plain_faults(turns)
        cost, audit, lines = plain_repair(turns, faults)
        n = Counter(faults)
        known = [t for _, t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def repaired(spark, rows, tmp_path):
    spark.createDataFrame(rows, CONV).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    return {r[0]: tuple(r[1:]) for r in op11_conversation_repair(spark, str(tmp_path)).collect()}


def conversation(r, conv, n):
    text = lambda: r.choice(["Fine.", "and so", " ", "", "What?\n", "ok!", "x", f"t{r.randrange(9)}."])
    return [(conv, t, r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "umpire"]), text()) for t in range(n)]


@pytest.mark.parametrize("bits", [1, 12])
def test_repair_against_brute_force(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(conversation_repair, "BLOCK_BITS", bits)
    r = random.Random(bits)
    rows = [x for conv in range(60) for x in conversation(r, conv, r.randrange(1, 14))]
    rows += [(60, t, "user" if t % 2 else "assistant", f"Turn {t}.") for t in range(40)]
    rows += [(None, 1, "user", "Hm."), (None, None, None, None), (61, None, "user", "a."), (61, None, "user", "a."), (61, 3, "assistant", None), (62, 5, None, "b.")]
    rows += [(63, 2, "user", "b."), (63, 2, "assistant", "a."), (63, 2, "assistant", "a."), (63, 9, "system", "."), (64, 0, "system", "Be kind."), (64, 1, "user", "Hi!"), (64, 2, "assistant", "Ho.")]
    assert repaired(spark, rows, tmp_path) == plain_conversations(rows)


def test_repair_of_a_long_conversation(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(conversation_repair, "BLOCK_BITS", 8)
    r = random.Random(3)
    rows = [(1, t, r.choice(["user", "assistant"]), f"{t}." if r.random() < 0.9 else "cut") for t in range(3000)] + conversation(r, 2, 5)
    assert repaired(spark, rows, tmp_path) == plain_conversations(rows)


def test_repair_of_odd_tables(spark):
    none = spark.createDataFrame([], CONV)
    summary, turns = conversation_repair.repair(conversation_repair.damage(none))
    assert summary.count() == turns.count() == 0
    names = "pos block fault initial digest mark _conv _of _told col".split()
    rows = [("c1", 0, "user", "Hi."), ("c1", 1, "assistant", "x" * 300_000 + "."), ("c1", 2, "assistant", "Ho.")]
    wide = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string").withColumns({n: F.lit(n) for n in names})
    summary, turns = conversation_repair.repair(conversation_repair.turns(wide))
    assert [tuple(x) for x in summary.collect()] == [("c1", 0, 0, 0, 0, 1, 3, "KKIK")]
    assert [(x["role"], len(x["text"])) for x in turns.orderBy("pos", "nth").collect()] == [("user", 3), ("assistant", 300_001), ("user", 0), ("assistant", 3)]


def test_longer_paths_compare_as_their_texts():
    r = random.Random(0)
    for _ in range(300):
        root = conversation_repair.Path((0, 0))
        made = [root]
        for i in range(30):
            made.append(conversation_repair.Path((i, 1), 0, r.choice(["D", "I", "K", "DK", "DI"]), "", r.choice(made)))
        text = lambda p: "".join(e.audit for e in p.edges())
        a, b = r.sample(made, 2)
        if text(a) != text(b):
            assert (a < b) == (text(a) < text(b))


# ------------------------------------------------------------------ clusters


def plain_clusters(rows, k=16, rounds=3):
    kept = [(i, [min(max(int(np.floor(64.0 * x)), -(2**63)), 2**63 - 1) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), j) for j, w in enumerate(c))
    for n in range(rounds + 1):
        found = [near(v) for _, v in kept]
        if n < rounds:
            for j in range(len(c)):
                own = [v for (_, v), (_, m) in zip(kept, found, strict=True) if m == j]
                c[j] = [sum(x) // len(own) for x in zip(*own, strict=True)] if own else c[j]
    cap = lambda x: min(x, 2**63 - 1)
    each = Counter()
    for d, j in found:
        each[j] += cap(d)
    return sorted(((i if i is not None else -1, j, cap(d), cap(each[j]), cap(sum(each.values())), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, found, strict=True)))


def clustered(spark, rows, tmp_path, kind="double"):
    spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumns({"v": F.lit(1), "cluster": F.lit(2)}).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
    out = op12_centroid_clustering(spark, str(tmp_path)).collect()
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in out)


@pytest.mark.parametrize("case", ["usual", "ties", "huge", "few", "none"])
def test_clusters_against_brute_force(spark, tmp_path, case):
    r = random.Random(case)
    vector = lambda s: [r.gauss(0, s) for _ in range(64)]
    rows = {
        "usual": lambda: [(i, vector(1 + i % 3)) for i in range(200)],
        "ties": lambda: [(i % 40, [float(r.randrange(2)) / 64 * (j < 3) for j in range(64)]) for i in range(120)],
        "huge": lambda: [(i, vector(10.0 ** r.choice([1, 6, 9, 15, 300]))) for i in range(60)],
        "few": lambda: [(i, vector(1)) for i in range(5)],
        "none": lambda: [],
    }[case]()
    rows += [(900, None), (901, [1.0] * 63), (902, [float("nan")] + [0.0] * 63), (903, [None] + [0.0] * 63), (904, [float("inf")] + [0.0] * 63)]
    rows += [(None, [0.5] * 64), (7, [0.5] * 64), (7, [0.5] * 64)] if case != "none" else []
    assert clustered(spark, rows, tmp_path) == plain_clusters(rows)


def test_a_vector_looks_at_changed_centroids_alone():
    seen = []

    class Counted(list):
        def __iter__(self):
            seen.append(1)
            return super().__iter__()

    v = np.array([[0] * 64, [9] * 64])
    c = [Counted([0] * 64), Counted([8] * 64), Counted([1] * 64)]
    cluster, distance = centroids.nearest(v, c, [1], np.array([0, 2]), np.array([0, 64 * 64]))
    assert cluster.tolist() == [0, 1] and distance.tolist() == [0, 64]
    assert centroids.nearest(v, c, [2], np.array([0, 2]), np.array([0, 5]))[0].tolist() == [0, 1]  # its owner moved: all are looked at


# ------------------------------------------------------------------ packing


def plain_bins(lengths, capacity):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= x]
        if fit:
            rooms.remove(min(fit))
        rooms.append((min(fit) if fit else capacity) - x)
    return sorted(rooms)


def laid_out(places, capacity):
    """The rooms left in sequences of (sequence, offset, length), which must be without gaps."""
    by = defaultdict(list)
    for s, offset, length in places:
        by[s].append((offset, length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return sorted(capacity - sum(n for _, n in own) for own in by.values())


@pytest.mark.parametrize("seed", range(60))
def test_plan_is_best_fit_decreasing(seed):
    r = random.Random(seed)
    capacity = r.choice([1, 2, 7, 10, 64, 100])
    lengths = [min(capacity, 1 + int(r.expovariate(3 / capacity))) if seed % 3 else r.randrange(1, capacity + 1) for _ in range(r.randrange(0, 250))]
    places = []
    for b in packing.plan(Counter(lengths), capacity):
        for n in range(b.rank_to - b.rank_from):
            places.append((b.sequence_from + n // b.each, b.at + n % b.each * b.length, b.length))
    assert Counter(x for _, _, x in places) == Counter(lengths)
    assert laid_out(places, capacity) == plain_bins(lengths, capacity)


def test_plan_does_not_grow_with_the_documents():
    r = random.Random(1)
    assert len(packing.plan({n: r.randrange(1, 10**9) for n in range(1, 1025)}, 1024)) < 5000


@pytest.mark.parametrize("capacity", [16, 1024])
def test_packing_against_the_library(spark, capacity):
    from tokenizers import Tokenizer

    r = random.Random(capacity)
    texts = [None, "", "a", " ", "x" * 50_000, " " * 5000 + "y", "\u0085 \x1c<|endoftext|> it's 12", *(" ".join(r.choice(["the", "of", "zebra", "\n", "été"]) for _ in range(r.randrange(1, 60))) for _ in range(150))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "repeated id"), (None, "no id")] + [(500, "copies of one text")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"length": F.lit(1), "rank": F.lit(2), "task": F.lit(3)}).repartition(5)
    out = packing.pack(docs, vocabulary(), capacity, with_ids=True).collect()
    encoder = Tokenizer.from_file(vocabulary())
    want = Counter()
    for i, t in rows:
        ids = [*encoder.encode(t or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % capacity + 1
        for n, at in enumerate([0, *range(first, len(ids), capacity)]):
            part = ids[at : first + n * capacity]
            want[i, n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), tuple(part)] += 1
    assert Counter((x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"], tuple(x["ids"])) for x in out) == want
    assert laid_out([(x["sequence_id"], x["offset"], x["length"]) for x in out], capacity) == plain_bins([x["length"] for x in out], capacity)


def test_packing_of_empty_tables(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), vocabulary()).count() == 0
    assert packing.pack(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), vocabulary(), end=None).count() == 0


def test_packing_query_on_the_given_documents(spark):
    small = "/root/testdata/sf0.001"
    out = op13_best_fit_packing(spark, small)
    assert [f.dataType.simpleString() for f in out.schema] == ["bigint", "int", "bigint", "bigint", "bigint", "bigint", "bigint"]
    rows = out.collect()
    assert {x["doc_id"] for x in rows} == {x["doc_id"] for x in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert laid_out([(x["sequence_id"], x["offset"], x["length"]) for x in rows], 1024) == plain_bins([x["length"] for x in rows], 1024)
