"""The operators against brute-force versions, on planted and random cases, and on odd tables."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logscan.llm import bpe, decontaminate, language_id, line_dedup, minhash, nearest, personal_data, sharding, substring_dedup, toxicity

DOCS = "doc_id long, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t) for i, t in enumerate(texts)], DOCS).repartition(3)


def words(r, n, vocabulary=2000):
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


# ------------------------------------------------------------------ substring dedup


def plain_substrings(texts, window):
    seen, out = set(), []
    for t in texts:
        w = WORD.findall(t or "")
        cut = [False] * len(w)
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if k in seen:
                cut[s : s + window] = [True] * window
            seen.add(k)
        out.append(" ".join(x for x, c in zip(w, cut, strict=True) if not c))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_substring_dedup(spark, seed):
    r = random.Random(seed)
    vocabulary = [2, 3, 50, 2000][seed]
    passage = words(r, 40, vocabulary)
    texts = [None, "", "one\ttwo", " ".join(passage)]
    for _ in range(60):
        own = words(r, r.randrange(0, 150), vocabulary)
        if r.random() < 0.6:
            a = r.randrange(0, 15)
            own[len(own) // 2 : len(own) // 2] = passage[a : a + r.randrange(5, 40)]
        texts.append(r.choice([" ", "\n"]).join(own))
    texts += texts[10:20] + [" ".join(["the"] * 300), " ".join(passage * 3)]
    for window in (20, 5):
        got = {x["doc_id"]: x for x in substring_dedup.dedup_substrings(docs(spark, texts), window).collect()}
        want = plain_substrings(texts, window)
        assert [got[i]["kept_text"] for i in range(len(texts))] == want
        assert all(got[i]["n_words"] - got[i]["n_removed"] == len(want[i].split()) for i in range(len(texts)))


def test_substring_dedup_of_ids_that_repeat_or_lack(spark):
    text = " ".join(f"a{i}" for i in range(30))
    got = substring_dedup.dedup_substrings(spark.createDataFrame([(1, text), (1, text), (None, text), (2, text)], DOCS)).collect()
    assert sorted((x["doc_id"] or 0, x["n_removed"]) for x in got) == [(0, 0), (1, 0), (1, 0), (2, 30)]


def test_substring_dedup_tells_texts_of_one_id_apart(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (3, f"{c} {b} {c}"), (2, f"{b} tail")]
    got = {x["kept_text"] for x in substring_dedup.dedup_substrings(spark.createDataFrame(rows, DOCS)).collect()}
    first, second = sorted([b, f"{b} tail"], key=lambda t: spark.range(1).select(F.hash(F.lit(t))).first()[0])
    assert got == {a, "", first, "tail" if second.endswith("tail") else "", f"{c} {c}".rsplit(" ", 30)[0]}


def test_spans_are_cut_only_if_the_words_at_both_places_are_equal():
    w = [f"w{i}" for i in range(40)]
    at = lambda digest: [{"start": 5, "edges": 2, "digest": digest}]
    batch = lambda at, kind: pa.RecordBatch.from_pylist([{"doc_id": 7, "tag": 1, "text": " ".join(w), "at": at}], pa.schema([("doc_id", pa.int64()), ("tag", pa.int32()), ("text", pa.string()), ("at", pa.list_(kind))]))
    place = pa.struct([("start", pa.int32()), ("edges", pa.int32())])
    span = pa.struct([*place, ("digest", pa.binary())])
    (read,) = substring_dedup._read_sources(20)([batch([{"start": 5, "edges": 2}], place)])
    assert read.to_pylist() == [{"doc_id": 7, "tag": 1, "start": 5, "edges": 2, "digest": hashlib.blake2b(" ".join(w[5:26]).encode(), digest_size=16).digest()}]
    (cut,) = substring_dedup._cut_out(20)([batch(at(read.to_pylist()[0]["digest"]), span)])
    (left,) = substring_dedup._cut_out(20)([batch(at(b"0" * 16), span)])
    assert cut.to_pylist()[0]["kept_text"].split() == w[:5] + w[26:] and cut.to_pylist()[0]["n_removed"] == 21
    assert left.to_pylist()[0]["kept_text"].split() == w and left.to_pylist()[0]["n_removed"] == 0


# ------------------------------------------------------------------ sharding


def plain_shards(rows, limit):
    """The directory of an extendible hash table: from one bucket on, what is over the limit splits on the next bit."""
    out, todo = {}, [("", rows)]
    while todo:
        bits, held = todo.pop()
        if sum(n for _, n in held) <= limit or len(held) == 1 or len(bits) == 60:
            out |= {bits: held} if held else {}
            continue
        for bit in "01":
            todo.append((bits + bit, [x for x in held if x[0][len(bits)] == bit]))
    return out


@pytest.mark.parametrize(("limit", "texts"), [(20_000, None), (10_000, ["x" * 100] * 50 + ["y" * 1_000_000]), (1_000_000, ["x"] * 20), (1, ["", None, "a", "bb"])])
def test_sharding_splits_only_what_is_over(spark, limit, texts):
    r = random.Random(1)
    texts = texts or ["x" * r.randrange(0, 4000) for _ in range(400)] + ["y" * 30_000, None]
    rows = sharding.shard(docs(spark, texts), limit).collect()
    assert len(rows) == len(texts)
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    hashed = [(f"{int(md5(f'{i}{chr(10)}{md5(t or str())}')[:15], 16):060b}", len(t or "")) for i, t in enumerate(texts)]
    want = plain_shards(hashed, limit)
    for x in rows:
        held = want[x["shard"]]
        assert hashed[x["doc_id"]] in held and len(x["shard"]) == x["depth"]
        assert x["shard_bytes"] == sum(n for _, n in held) and x["oversized"] == (x["shard_bytes"] > limit)
    assert {x["shard"] for x in rows} == set(want)


def test_sharding_goes_past_its_first_sums(spark):
    """A bucket whose rows are all alike but for the last bits of the hash."""
    rows = spark.createDataFrame([(i, 100) for i in range(8)] + [(1 << 59, 100)], "h long, size int")
    leaves = {(x["depth"], x["prefix"]): (x["bytes"], x["rows"]) for x in sharding.directory(rows, 250).collect()}
    assert leaves == {(1, 1): (100, 1), **{(59, i): (200, 2) for i in range(4)}}


def test_sharding_of_equal_rows(spark):
    rows = sharding.shard(docs(spark, ["z" * 100] * 50).withColumn("doc_id", F.lit(7)), 1000).collect()
    assert len({x["shard"] for x in rows}) == 1 and all(x["oversized"] for x in rows)


# ------------------------------------------------------------------ decontamination


def plain_leaks(texts, items, size=5, threshold=0.8):
    token = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    grams = lambda w: [tuple(w[i : i + size]) for i in range(len(w) - size + 1)]
    out = {}
    for d, t in enumerate(texts):
        s = grams(token(t))
        for i, item in enumerate(items):
            c = Counter(grams(token(item)))
            n = sum(c.values())
            for at in range(max(1, len(s) - n + 1)):
                w = Counter(s[at : at + n])
                both = sum((w & c).values())
                if n and both / (n + sum(w.values()) - both) >= threshold:
                    out[d, i] = max(out.get((d, i), 0), both / (n + sum(w.values()) - both))
    return out


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 1000])
def test_decontamination(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block_bytes)  # the second: several blocks
    r = random.Random(3)
    items = [" ".join(words(r, n)) for n in (14, 20, 20, 33, 60)] + ["too short item", None, ""]
    texts = [None, "", " ".join(words(r, 400))]
    for item in items[:5]:
        w = item.split()
        for edits in (0, 1, 3):
            own = list(w)
            for _ in range(edits):
                own[r.randrange(len(own))] = "edited"
            texts.append(" ".join(words(r, 30) + own + words(r, 30)).upper().replace(" ", ",  "))
        texts += [" ".join(w[: len(w) // 2] + words(r, 50)), " ".join(w[:-1]), " ".join(w[:-3]), " ".join(w[: len(w) * 21 // 25]), " ".join(w + w)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): round(x["similarity"], 9) for x in decontaminate.find_leaks(docs(spark, texts), bench).collect()}
    want = {k: round(v, 9) for k, v in plain_leaks(texts, items).items()}
    assert got == want and len(want) >= 10


def test_hamming_blocks_find_all_within_the_radius(spark):
    r = random.Random(5)
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    base = [r.getrandbits(64) for _ in range(20)]
    near = [b ^ sum(1 << k for k in r.sample(range(64), r.randrange(0, 30))) for b in base for _ in range(20)]
    windows = spark.createDataFrame([(5, sign(x)) for x in near], "n int, fp long")
    items = spark.createDataFrame([(i, 5, sign(x)) for i, x in enumerate(base)], "item_id long, n int, item_fp long")
    got = {(x["fp"], x["item_id"]) for x in decontaminate.within_radius(windows, items, 12).collect()}
    assert got == {(sign(x), i) for x in near for i, b in enumerate(base) if (x ^ b).bit_count() <= 12}


def test_a_large_benchmark_reads_the_corpus_once(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 100)
    r = random.Random(8)
    items = [words(r, 30) for _ in range(40)]
    texts = [" ".join(words(r, 40) + items[i] + words(r, 40)) for i in range(0, 40, 4)] + [" ".join(words(r, 90)) for _ in range(30)]
    passed = []
    keep = decontaminate.passing
    monkeypatch.setattr(decontaminate, "passing", lambda *a: passed.append(keep(*a)) or passed[-1])
    found = decontaminate.find_leaks(docs(spark, texts), spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string"))
    assert sorted((x["doc_id"], x["item_id"]) for x in found.collect()) == [(i, 4 * i) for i in range(10)]
    (kept,) = passed
    hits, all_ = 10 * 26, sum(len(t.split()) - 4 for t in texts)
    assert hits <= kept.count() <= hits + 0.06 * all_  # few shingles besides pass the filter


# ------------------------------------------------------------------ nearest neighbours


def test_nearest_with_one_id_on_most_rows(spark):
    r = np.random.default_rng(2)
    rows = [(i, x.tolist()) for i, x in enumerate(r.normal(size=(60, 4)))] + [(7, x.tolist()) for x in r.normal(size=(500, 4))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    kept = nearest.once(nearest.usable(frame, "vec_id", "embedding"))
    assert kept.count() == 60  # before any block is packed
    best = {i: max(v for j, v in rows if j == i) for i in range(60)}
    assert {x["id"]: x["v"] for x in kept.collect()} == best
    got = [(x["query_id"], x["vec_id"]) for x in nearest.nearest(frame, F.col("vec_id") == 7, k=5).orderBy("rank").collect()]
    dot = lambda j: sum(a * b for a, b in zip(best[7], best[j], strict=True))
    assert got == [(7, j) for j in sorted((j for j in range(60) if j != 7), key=lambda j: (-dot(j), j))[:5]]




@pytest.mark.parametrize("dim", [3, 64])
def test_nearest(spark, dim):
    r = np.random.default_rng(dim)
    v = r.normal(size=(500, dim)).astype(np.float32)
    v[100:220] = v[100]  # ties beyond k
    rows = [(i, [float(y) for y in x]) for i, x in enumerate(v)] + [(600, None), (620, [0.0] * dim), (640, [float("nan")] * dim), (660, [None] * dim), (680, [1.0]), (None, [1.0] * dim), (0, [-9.0] * dim)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = {}
    for x in nearest.nearest(frame, F.col("vec_id") % 20 == 0, 20).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    d = v.astype(np.float64)
    assert set(got) == set(range(0, 500, 20))
    for q in got:
        s = np.zeros(500)
        for k in range(dim):
            s += d[q, k] * d[:, k]
        best = sorted((-s[i], i) for i in range(500) if i != q)[:20]
        assert sorted(got[q]) == [(n + 1, i, -x) for n, (x, i) in enumerate(best)]


# ------------------------------------------------------------------ personal data

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    def luhn(x):
        return sum((d - 9 if d > 9 else d) for d in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(x)))) % 10 == 0

    out = []
    for kind, rx in PLAIN.items():
        for m in re.finditer(rx, text or ""):
            n = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(n) <= 19 and luhn(n), "phone": 8 <= len(n) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_personal_data_base_spans(spark):
    r = random.Random(2)
    parts = ["a.b+c@x-y.example.com", "a@b", "@", "a@b.c.d_e@f.g", "1.2.3.4.5.6.7.8", "300.1.1.1", "000255.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111 9", "4111111111111112", "+1 (988) 555-2485", "+1 2", "+49.30.1234567)", "é😀", "word", "\n", "7", " ", " ", "-", "."]
    texts = [None, "", "9" * 30_000, "a" * 30_000 + "@", "1 " * 20_000 + "+1" * 50] + ["".join(r.choice(parts) for _ in range(r.randrange(1, 25))) for _ in range(300)]
    got = {x["doc_id"]: x["s"] for x in personal_data.find(docs(spark, texts)).select("doc_id", personal_data.listed(F.filter("spans", lambda s: s["base"])).alias("s")).collect()}
    assert [got[i] for i in range(len(texts))] == [",".join(plain_spans(t)) for t in texts]


def test_personal_data_finds_more_in_known_contexts(spark):
    texts = [f"please dial +1 (988) 555-{1000 + i} today {i}" for i in range(40)] + ["please dial 0171-5550199 today", "built 0171-5550198 parts", "please dial nobody today"]
    rows = {x["doc_id"]: x["spans"] for x in personal_data.find(docs(spark, texts)).collect()}
    assert [(s["kind"], texts[40][s["start"] : s["end"]], s["base"]) for s in rows[40]] == [(3, "0171-5550199", False)]
    assert rows[41] == rows[42] == []


def test_personal_data_finds_numbers_with_spaces(spark):
    r = random.Random(5)

    def card():
        d = "".join(r.choice("0123456789") for _ in range(15))
        odd = sum(sum(divmod(2 * int(x), 10)) if i % 2 == 0 else int(x) for i, x in enumerate(d))
        return d + str(-odd % 10)

    cards = [card() for _ in range(40)]
    texts = [f"please dial +1 (988) 555-{1000 + i} today {i}" for i in range(40)] + [f"paid with {' '.join(c[j : j + 4] for j in range(0, 16, 4))} visa {i}" for i, c in enumerate(cards)]
    new = [("please dial (988) 555 1234 today", 3, "(988) 555 1234"), ("please dial 0171 555 0199, today", 3, "0171 555 0199"), ("please dial 0171 5550199.", 3, "0171 5550199"), ("paid with 4111 1111 1111 1112 visa", 2, "4111 1111 1111 1112"), ("please dial 0171-5550197.", 3, "0171-5550197"), ("please dial 0171-5550196 2024 1999 today", 3, "0171-5550196")]
    rows = {x["doc_id"]: x["spans"] for x in personal_data.find(docs(spark, [*texts, *(t for t, _, _ in new), "built 0171 555 0198 parts"])).collect()}
    for i, (text, kind, value) in enumerate(new, len(texts)):
        assert [(x["kind"], text[x["start"] : x["end"]], x["base"]) for x in rows[i]] == [(kind, value, False)]
    assert rows[len(texts) + len(new)] == []


def test_personal_data_contexts_of_any_length(spark):
    word, gap = "x" * 5000, " " * 5000
    texts = [f"{word}{gap}+1 (988) 555-{1000 + i}{gap}{word} {i}" for i in range(40)] + [f"{word}{gap}0171-5550199{gap}{word} 7"]
    (spans,) = (x["spans"] for x in personal_data.find(docs(spark, texts)).collect() if x["doc_id"] == 40)
    assert [(s["kind"], s["start"], s["end"]) for s in spans] == [(3, 10_000, 10_012)]


def plain_scores(edges, rounds, seeds):
    """Confidence of (pattern, kind) and score of (instance, kind), over dicts."""
    size, seen = Counter(p for p, _, _ in edges), Counter((p, k) for p, _, k in edges if k < 4)
    patterns = {x for x, n in seen.items() if n >= seeds}
    links = {(p, i) for p, i, k in edges if k == 4}
    confidence, scores = {}, {}
    for _ in range(rounds):
        confidence = {(p, k): (seen[p, k] + sum(scores.get((i, k), 0) for q, i in links if q == p)) / (size[p] + seeds) for p, k in patterns}
        scores = {}
        for i in {i for _, i in links}:
            for k in range(4):
                best = {side: max([c for (p, j), c in confidence.items() if j == k and (p, i) in links and p.startswith(side)], default=0) for side in ("left", "right", "both")}
                found = max(best["both"], 1 - (1 - best["left"]) * (1 - best["right"]))
                if found > 0.01:
                    scores[i, k] = found
    return confidence, scores


@pytest.mark.parametrize("seed", range(3))
def test_personal_data_bootstrapping_against_brute_force(spark, seed):
    r = random.Random(seed)
    edges = list({(f"{r.choice(['left', 'right', 'both'])} {r.randrange(6)}", f"i{r.randrange(40)}" if k == 4 else f"s{k}{r.randrange(25)}", k) for k in (r.choice([0, 3, 3, 3, 4, 4]) for _ in range(300))})
    confidence, scores = personal_data.scored(spark.createDataFrame(edges, "pattern string, instance string, kind int"), 3, 5)
    want = plain_scores(edges, 3, 5)
    rounded = lambda d: {k: round(v, 9) for k, v in d.items()}
    assert rounded({(x["pattern"], x["k"]): x["confidence"] for x in confidence.collect()}) == rounded(want[0])
    assert rounded({(x["instance"], x["k"]): x["score"] for x in scores.collect()}) == rounded(want[1]) and want[1]


# ------------------------------------------------------------------ BPE


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_bpe_equals_the_library_and_round_trips(spark, vocabulary):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    r = random.Random(4)
    signs = [chr(c) for c in [*range(0, 600), 0x1680, *range(0x2000, 0x2030), 0x3000, 0xFEFF, 0x1F600, 0x4E2D, 0x200D]] + ["'s", "'ll", "  ", "<|endoftext|>", " the", "tion" * 4]
    texts = [None, "", "ab" * 20_000, " " * 500] + ["".join(r.choice(signs) for _ in range(r.randrange(0, 30))) for _ in range(800)]
    encoded = bpe.encode(docs(spark, texts), vocabulary)
    got = {x["doc_id"]: (x["ids"], x["decoded"]) for x in bpe.decode(encoded, vocabulary).collect()}
    for i, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert got[i] == (ids, t.decode(ids, skip_special_tokens=False)) and got[i][1] == (x or "")


def test_segment_tree_forms_agree(vocabulary):
    v = bpe.Vocabulary(open(vocabulary, encoding="utf-8").read())
    r = random.Random(6)
    pieces = list({bytes(r.choice(b"abcdehinorst \xc3\xa9") for _ in range(r.randrange(1, 32))) for _ in range(500)})
    assert [np.frombuffer(x, np.int32).tolist() for x in v.merged_together(pieces, 32)] == [v.merged(p) for p in pieces]


# ------------------------------------------------------------------ near duplicates


def plain_components(texts, size, percent):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(lower))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates(spark, size):
    r = random.Random(size)
    texts = [None, "", " \n", "one two", "One  TWO", "one two three"]
    centre = words(r, 120)
    for _ in range(60):  # copies of one text that are near it, and not all near each other
        own = list(centre)
        for _ in range(r.randrange(0, 4)):
            own[r.randrange(len(own))] = f"x{r.random()}"
        texts.append(" ".join(own))
    passage = words(r, 60)
    texts += [" ".join(passage + words(r, r.randrange(5, 60))) for _ in range(40)]
    texts += [" ".join(words(r, 30)) for _ in range(30)]
    texts += r.sample(texts, 20)
    chain = words(r, 60)
    for i in range(0, 40, 2):
        chain[i] = f"c{i}"
        texts.append(" ".join(chain))
    r.shuffle(texts)
    got = {x["doc_id"]: x for x in minhash.near_duplicates(docs(spark, texts), size).collect()}
    want = plain_components(texts, size, 80)
    assert [(got[i]["n_shingles"], got[i]["component_id"]) for i in range(len(texts))] == want
    assert all(x["kept"] == (x["doc_id"] == x["component_id"]) for x in got.values())


def test_tiles_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 4000)
    test_near_duplicates.__wrapped__(spark, 5) if hasattr(test_near_duplicates, "__wrapped__") else test_near_duplicates(spark, 5)


def test_tiles_of_short_texts_have_bounded_members(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", 10, raising=False)
    inner = minhash._tile

    def watched(percent):
        tile = inner(percent)

        def run(table):
            if table.num_rows > 40:
                raise ValueError(f"a tile of {table.num_rows} members")
            return tile(table)

        return run

    monkeypatch.setattr(minhash, "_tile", watched)
    r = random.Random(9)
    texts = ["one two three four five " + " ".join(words(r, 3, 12)) for _ in range(300)]
    got = {x["doc_id"]: x for x in minhash.near_duplicates(docs(spark, texts), 5, 100, 4, 1).collect()}
    assert [(got[i]["n_shingles"], got[i]["component_id"]) for i in range(len(texts))] == plain_components(texts, 5, 100)


def test_signature_estimates_similarity():
    r = np.random.default_rng(0)
    x = r.integers(0, 1 << 63, 1500, dtype=np.int64).astype(np.uint64)
    a, b = x[:1000], x[200:1200]
    sig = minhash.signatures(np.concatenate([a, b]), np.array([0, 1000]), 512)
    assert abs((sig[0] == sig[1]).mean() - 800 / 1200) < 0.1


# ------------------------------------------------------------------ lines


def test_line_dedup(spark):
    r = random.Random(7)
    common = ["License", " license\t", "the same line", "ÄÖ", "\x0bx\x0c"]
    texts = [None, "", "\n\n"] + ["\n".join(r.choice([*common, f"own {r.random()}", ""]) for _ in range(r.randrange(0, 12))) for _ in range(80)]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    n = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    got = {x["doc_id"]: x for x in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        kept = [x for x in lines if n[key(x)] < 10]
        assert (got[i]["text"], got[i]["n_lines"], got[i]["n_dropped"]) == ("\n".join(kept), len(lines), len(lines) - len(kept))


def test_lines_are_counted_by_documents(spark):
    rows = [(7, "the line\nown")] * 12 + [(None, "the line")] * 12 + [(i, f"other\nnumber {i}") for i in range(10)] + [(3, "other\nagain")]
    got = sorted((x["doc_id"] or -1, x["text"], x["n_dropped"]) for x in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect())
    want = [(7, "the line\nown", 0)] * 12 + [(-1, "the line", 0)] * 12 + [(i, f"number {i}", 1) for i in range(10)] + [(3, "again", 1)]
    assert got == sorted((i or -1, t, n) for i, t, n in want)


def test_a_document_of_many_dropped_lines(spark):
    """The time to put it together again is linear in its lines."""
    long = "\n".join(f"common {i}\nown {i}" for i in range(20_000))
    common = "\n".join(f"common {i}" for i in range(20_000))
    got = {x["doc_id"]: x for x in line_dedup.dedup_lines(docs(spark, [long, *[common] * 9])).collect()}
    assert got[0]["text"] == "\n".join(f"own {i}" for i in range(20_000)) and (got[0]["n_lines"], got[0]["n_dropped"]) == (40_000, 20_000)
    assert got[5]["text"] == "" and got[5]["n_dropped"] == 20_000


# ------------------------------------------------------------------ classifiers


def corpus(r, n):
    syllables = {"en": "th er on an in the ing and", "de": "sch ch ei und der ung keit ß", "fr": "eau ou le é la que ent tion", "es": "ción os ar el la ña do mente"}
    rows = []
    for i in range(n):
        lang = r.choice(list(syllables))
        rows.append((i, " ".join("".join(r.choice(syllables[lang].split()) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(3, 60))), lang))
    return rows


def test_language_id(spark):
    r = random.Random(8)
    rows = [*corpus(r, 600), (600, None, "en"), (601, "123 !!", "de"), (602, "", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(frame.filter(language_id.remainder(4) != 2))
    assert {f: c.names for f, c in model.within.items()} == {"germanic": ["de", "en"], "romance": ["es", "fr"]}
    out = language_id.identify(frame, model).withColumn("held_out", language_id.remainder(4) == 2).collect()
    right = [x["lang"] == x["lang_pred"] for x in out if x["held_out"] and x["doc_id"] < 600]
    assert np.mean(right) > 0.97 and all(0 <= x["score"] <= 1 for x in out)
    assert {x["doc_id"]: x["lang_pred"] for x in out if x["doc_id"] >= 600} == dict.fromkeys((600, 601, 602), "und")


def test_language_id_on_the_given_tables(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.train(frame.filter(language_id.remainder(4) != 2))
    out = language_id.identify(frame.drop("lang"), model).join(frame.select("doc_id", "lang"), "doc_id").filter((language_id.remainder(4) == 2) & F.col("lang").isNotNull()).collect()
    assert len(out) > 100 and np.mean([x["lang"] == x["lang_pred"] for x in out if x["lang_pred"] != "und"]) > 0.97


@pytest.mark.parametrize("classes", [2, 3, 5])
def test_language_votes_against_brute_force(classes):
    r = np.random.default_rng(classes)
    names = [f"l{i}" for i in range(classes)]
    centres = r.normal(size=(classes, language_id.DIMS)).astype(np.float32)
    of = np.array([names[i % classes] for i in range(20 * classes)], dtype=object)
    x = (centres[np.arange(20 * classes) % classes] + r.normal(size=(20 * classes, language_id.DIMS)) * 0.3).astype(np.float32)
    choice = language_id.Choice(names, x, of)
    rows = np.concatenate([x, r.normal(size=(200, language_id.DIMS)).astype(np.float32) * 0.2])
    best, sure = choice(rows)
    for n, row in enumerate(rows):
        won, total, weakest = [0] * classes, [0.0] * classes, [float("inf")] * classes
        for (i, j), w in zip(choice.pairs, choice.weights.T, strict=True):
            margin = float(np.float32(row @ w[:-1]) + w[-1])
            for a, m in ((i, margin), (j, -margin)):
                total[a] += m
                weakest[a] = min(weakest[a], m)
            won[i if margin >= 0 else j] += 1
        first = max(range(classes), key=lambda a: (won[a], total[a]))
        assert first == best[n] or won[first] == won[best[n]] and abs(total[first] - total[best[n]]) < 1e-3
        assert abs(sure[n] - 1 / (1 + np.exp(-3 * weakest[best[n]]))) < 1e-3
    assert (np.array(names, dtype=object)[best[: len(of)]] == of).all()


def test_language_id_without_labels(spark):
    frame = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [x["lang_pred"] for x in language_id.identify(frame, language_id.train(frame)).collect()] == ["und"]


def test_toxicity_learns_stems_and_leaves_clean_ones(spark):
    r = random.Random(9)
    rows, labels = [], []
    for i in range(1500):
        w, toxic = words(r, r.randrange(5, 80), 500), int(r.random() < 0.2)
        for _ in range(r.randrange(1, 4) if toxic else 0):
            w[r.randrange(len(w))] = r.choice(["Grobian", "lumpish", "lumpen"]) + r.choice(["", "er", "s"])
        rows.append((i, " ".join(w)))
        labels.append((i, toxic if i % 3 else None))
    rows += [(5000, None), (5001, "")]
    frame = spark.createDataFrame(rows, DOCS)
    grammar = toxicity.train(frame, spark.createDataFrame(labels, "doc_id long, toxic int").filter(language_id.remainder(5) != 0))
    assert set(grammar.stems) <= {"grob", "grobi", "grobia", "grobian", "lump", "lumpe", "lumpis", "lumpi", "lumpen", "lumpish", "gro", "lum"} and grammar.stems
    scores = {x["doc_id"]: x["score"] for x in toxicity.score(frame, grammar).collect()}
    truth = {i: bool(re.search("Grobian|lump", t or "")) for i, t in rows}
    assert np.mean([(scores[i] >= 0.5) == truth[i] for i in truth]) > 0.99 and scores[5000] == scores[5001] < 0.5


def test_toxicity_transducers():
    g = toxicity.Grammar({"fool": 4.0})
    assert g.emitted("what a fool") == [4.0, 0.0, 0.0]
    assert g.emitted("You foolish people") == [5.0, 0.0, 0.0]
    assert g.emitted("this is not a fool. Fools") == [4.0, 4.0, 0.0]
    assert g.emitted("one said fool") == [0.0, 0.0, 4.0]
    assert g.emitted("unfool befool") == [0.0, 0.0, 0.0]
    assert g.emitted("i kill you") == [1.25, 0.0, 0.0] and g.emitted("i kill time") == [0.0, 0.0, 0.0]
    assert g.emitted("fool " * 1000)[0] == 4000.0


def all_paths(machines, word, states):
    """Every way in which a chain of transducers reads a word: the states after it, and what is emitted."""
    found = [((), word, [])]
    for machine, state in zip(machines, states, strict=True):
        after = []
        for then, symbol, emitted in found:
            if (state, symbol) in machine.arcs:
                to, out, emits = machine.arcs[state, symbol]
                after.append(((*then, to), out, emitted + ([emits] if emits else [])))
        found = after
    return [(states, emitted) for states, _, emitted in found]


def plain_clause(machines, tokens):
    """The sum of weights on each path of a clause that ends in final states everywhere."""
    paths = [(starts, [0.0] * 3) for starts in product(*(m.starts for m in machines))]
    for kind, weight in tokens:
        longer = []
        for states, total in paths:
            for after, emitted in all_paths(machines, (kind, None, "plain"), states):
                new = list(total)
                for mode, factor in emitted:
                    new[toxicity.MODES.index(mode)] += factor * weight
                longer.append((after, new))
        paths = longer
    return [total for states, total in paths if all(s in m.final for s, m in zip(states, machines, strict=True))]


@pytest.mark.parametrize("seed", range(4))
def test_toxicity_machine_against_all_paths(seed):
    r, g, machines = random.Random(seed), toxicity.Grammar({"fool": 4.0}), toxicity.transducers()
    for _ in range(300):
        tokens = [(r.choice(toxicity.CLASSES), r.choice([1.0, 2.5])) for _ in range(r.randrange(0, 9))]
        accepted = plain_clause(machines, tokens)
        assert len(accepted) == 1 and g.clause(tokens) == accepted[0]


def test_toxicity_learns_classes_beside_stems(spark):
    r, rows = random.Random(12), []
    for i in range(900):
        w = words(r, 20, 300)
        kind = i % 3
        if kind == 1:
            w[8:10] = ["lumpen", "zonk"]
        elif kind == 2 and r.random() < 0.3:
            w[7:10] = ["quothed", "a", "lumpen"]
        rows.append((int(kind == 1), " ".join(w)))
    sample = spark.createDataFrame(rows, "toxic int, text string")
    reports, targets = toxicity.learn_context(sample, {"lump": 4.0})
    assert reports == ["a", "quothed"] and targets == ["zonk"]
    assert toxicity.Grammar({"lump": 4.0}, reports=reports).emitted("one quothed lumpen") == [0.0, 0.0, 4.0]


def test_toxicity_of_endless_clauses():
    g, la = toxicity.Grammar({"fool": 4.0}), "la " * 400
    assert g.emitted(f"one said {la} fool") == [0.0, 0.0, 4.0]
    assert g.emitted(f"i kill {la} you") == [1.25, 0.0, 0.0]
    assert g.emitted(f"fool {la} fool {la} people. fool") == [14.0, 0.0, 0.0]
    assert g.emitted(f"one said. {la} fool {'x' * 1000}! you") == [4.0, 0.0, 0.0]
    for n in range(380, 420):  # a negation just before what was cut
        assert g.emitted(f"fool {'y' * n} not a fool") == [4.0, 4.0, 0.0]


# ------------------------------------------------------------------ odd tables


def odd(spark, rows):
    """Documents with columns whose names the operators use inside."""
    extra = "n long, a long, tag string, at string, _doc long, _h long, pos int, hash string, score string, ids string, shard string, prefix long, depth string, rep long"
    names = [c.split()[0] for c in extra.split(", ")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return frame.selectExpr("*", *[f"cast(null as {c.split()[1]}) as {n}" for n, c in zip(names, extra.split(", "), strict=True)])


LONG = " ".join(f"long{i} the" for i in range(30_000))
ODD = {
    "empty table": [],
    "nulls and repeats": [(None, None, None, None, None), (None, "some words here", None, None, 3), (1, None, "en", None, None), (1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, "", "fr", "s", 0), (3, LONG, "en", "s", 9), (4, LONG, "en", "s", 9), (5, "5551 +1 (988) 555-2485 a@b.cd\n\n", "de", "s", 1)],
}


@pytest.mark.parametrize("case", ODD)
def test_odd_tables(spark, vocabulary, case):
    rows = ODD[case]
    d, n = odd(spark, rows), len(rows)
    bench = spark.createDataFrame([(1, "long5 the long6 the long7 the long8"), (None, "x"), (2, None)], "item_id long, text string")
    labels = spark.createDataFrame([(3, 1), (5, 0), (None, 1), (2, None)] if rows else [], "doc_id long, toxic int")
    rows_of = lambda df, *cols: sorted(([x[c] for c in cols] for x in df.collect()), key=repr)
    want = [[i, len(t.split()) if t else 0, len(LONG.split()) if i == 4 else 0] for i, t, *_ in rows]
    assert rows_of(substring_dedup.dedup_substrings(d), "doc_id", "n_words", "n_removed") == sorted(want, key=repr)
    assert {x["oversized"] for x in sharding.shard(d, 1000).filter("doc_id in (3, 4)").collect()} == ({True} if rows else set()) and sharding.shard(d, 1000).count() == n
    leaks = decontaminate.find_leaks(d, bench)
    assert rows_of(leaks, "doc_id", "item_id", "similarity", "start", "n_windows") == ([[3, 1, 1.0, 10, 1], [4, 1, 1.0, 10, 1]] if rows else [])
    assert decontaminate.find_leaks(d, bench.limit(0)).count() == 0
    assert nearest.nearest(d.selectExpr("doc_id as vec_id", "cast(null as array<float>) as embedding"), F.col("vec_id") % 20 == 0).count() == 0
    spans = personal_data.find(d).select("doc_id", personal_data.listed(F.col("spans")).alias("s"))
    assert rows_of(spans, "doc_id", "s") == sorted(([i, ",".join(plain_spans(t))] for i, t, *_ in rows), key=repr)
    decoded = bpe.decode(bpe.encode(d, vocabulary), vocabulary)
    assert rows_of(decoded, "doc_id", "decoded") == sorted(([i, t or ""] for i, t, *_ in rows), key=repr)
    near = minhash.near_duplicates(d)
    words_of = {i: (t or "").lower().split() for i, t, *_ in rows if i}
    grams = {i: len({tuple(w[k : k + 5]) for k in range(len(w) - 4)}) for i, w in words_of.items()}
    want = [[i, (0 if not t else 1 if len(t.split()) < 5 else 2 if i == 1 else grams[i]), None if i is None else 3 if i == 4 else i, i != 4] for i, t, *_ in rows]
    assert rows_of(near, "doc_id", "n_shingles", "component_id", "kept") == sorted(want, key=repr)
    lines = line_dedup.dedup_lines(d, 2)
    assert rows_of(lines, "doc_id", "text", "n_lines", "n_dropped") == sorted(([i, "" if i in (3, 4) else t or "", (t or "").count(chr(10)) + 1, int(i in (3, 4))] for i, t, *_ in rows), key=repr)
    assert set(lines.columns) == {*d.columns, "n_lines", "n_dropped"}
    langs = language_id.identify(d, language_id.train(d))
    assert langs.count() == n and all((x["lang_pred"] == "und") == (not re.search("[a-z]", x["text"] or "")) and 0 <= x["score"] <= 1 for x in langs.collect())
    scores = toxicity.score(d, toxicity.train(d, labels)).collect()
    assert len(scores) == n and len({x["score"] for x in scores if not x["text"]}) == (1 if rows else 0) and all(0 <= x["score"] <= 1 for x in scores)

def test_written_tables_are_in_the_shared_folder(spark):
    from logscan.llm.common import shared_dir

    assert shared_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


def test_digests(spark):
    """The queries' digests are those of the operators' texts."""
    from logscan.llm.queries import op1_substring_dedup

    rows = op1_substring_dedup(spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    want = dict(zip(sorted(texts), plain_substrings([texts[i] for i in sorted(texts)], 20), strict=True))
    assert all(r["kept_sha256"] == hashlib.sha256(want[r["doc_id"]].encode()).hexdigest() for r in rows)
