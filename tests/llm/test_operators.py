"""Operators against brute force on small tables, edge cases included."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from arborix.llm import decontaminate, language_model, mixing, pii, quality_rules, simhash, site_quality, text, token_ids, toxicity, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, words string"


def texts():
    r = random.Random(7)
    vocab = ["the", "of", "Straße", "ñandú", "a.b", "x;", "İ", "end."] + [f"w{i}" for i in range(60)]
    out = [" ".join(r.choice(vocab) for _ in range(r.choice([3, 30, 80, 200]))) for _ in range(40)]
    out += [out[0], out[0], out[1] + " tail", "", " \n\t ", None, "one", "same line\nsame line\n\nsame line\nother", "a b c a b c a b c", "# * $ % & | < > !", "  no break \u0085 x\x1cy"]
    out += ["lorem " * 3000, "abc\u0000def \U0001f600 \U0001f600 \U0001f600 \U0001f600"]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 5 else None, t, "en", f"s{i % 4}" if i % 9 else None, 0, 1, "w") for i, t in enumerate(texts())]
    rows.append(rows[3])
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return WORD.findall(t or "")


def test_quality_counts(docs, empty):
    got = collections.Counter(tuple(r)[:7] for r in quality_rules.quality(docs).collect())
    want = collections.Counter()
    for r in docs.collect():
        t, w = r["text"] or "", words(r["text"])
        wins = list(zip(w, w[1:], w[2:], strict=False))
        n = collections.Counter(wins)
        cover = {k + d for k, x in enumerate(wins) if n[x] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        want[(r["doc_id"], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), failed)] += 1
    assert got == want
    assert quality_rules.quality(empty).count() == 0


def naive_em(texts_votes, rounds=500):
    """EM text by text: the posterior of each."""
    good, chance = 0.9, np.array([quality_rules.PRIOR_VOTES] * len(quality_rules.RULES))
    v = np.array(texts_votes)
    for _ in range(rounds):
        like = [np.prod([chance[j, side, v[:, j]] for j in range(v.shape[1])], axis=0) for side in (0, 1)]
        p = good * like[0] / (good * like[0] + (1 - good) * like[1])
        mass = np.array([[[20 * quality_rules.PRIOR_VOTES[side][x] + ((p, 1 - p)[side] * (v[:, j] == x)).sum() for x in range(3)] for side in (0, 1)] for j in range(v.shape[1])])
        old, chance = chance, mass / mass.sum(axis=2, keepdims=True)
        good = (20 * 0.9 + p.sum()) / (20 + len(p))
        if abs(chance - old).max() < 1e-12:
            break
    return p


def junk_corpus():
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9)))
    prose = lambda k: "\n".join(" ".join(word() for _ in range(12)) + "." for _ in range(k // 12))
    out = [(i, prose(144)) for i in range(180)] + [(i, prose(60)) for i in range(180, 200)]  # short texts get a bad vote
    out += [(i, prose(120) + "\n" + "\n".join(["one line again and again here."] * 4)) for i in range(200, 206)]
    junk = [(1000 + i, " ".join(word() + "$$$" for _ in range(144))) for i in range(15)]
    junk += [(2000 + i, " | ".join(word() for _ in range(100))) for i in range(15)]
    return out, junk


def test_quality_rejects_junk_and_keeps_columns(spark):
    good, junk = junk_corpus()
    names = "doc_id long, text string, pattern int, n_words string, words string, lines int"
    docs = spark.createDataFrame([(i, t, 1, "x", "y", 2) for i, t in good + junk], names).withColumn("a.b", F.lit(1))
    kept = quality_rules.filter_good(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in good}
    counted = quality_rules.with_counts(docs.select("doc_id", "text")).withColumn("pattern", quality_rules.pattern()).collect()
    votes = {r["doc_id"]: quality_rules.decoded(r["pattern"]) for r in counted}
    # rules don't all have to pass: good texts with bad votes stay
    assert sum(0 in votes[i] for i, _ in good) >= 20
    got = {r["doc_id"]: r["posterior"] for r in quality_rules.quality(docs).collect()}
    want = dict(zip(votes, naive_em(list(votes.values())), strict=True))
    assert all(abs(got[i] - want[i]) <= 1.5e-6 for i in got)


def test_quality_weighs_votes():
    """Accuracies come from the votes: abstaining can tell, and a bad vote need not."""
    code = lambda vote: sum(v * 3 ** (len(vote) - 1 - j) for j, v in enumerate(vote))
    k = len(quality_rules.RULES)
    fine, short, junk, mute = [2] * k, [2] * (k - 1) + [0], [0] * 4 + [2] * (k - 4), [1] * 4 + [2] * (k - 4)
    model = quality_rules.estimate([(code(fine), 900), (code(short), 90), (code(junk), 80), (code(mute), 30)])
    p = [quality_rules.probability(model, v) for v in (fine, short, junk, mute)]
    assert p[0] > 0.99 and p[1] > 0.9 and p[2] < 0.01 and p[3] < 0.5
    assert quality_rules.probability(quality_rules.estimate([]), fine) > 0.9


def test_mixing_against_loops(docs, empty):
    rows = [(r["doc_id"], r["source"], len(words(r["text"]))) for r in docs.collect()]
    size = collections.Counter()
    for _, s, n in rows:
        size[s] += n
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, open_, target = 1.5 * sum(size.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > 2 * size[s]]
        for s in full or open_:
            target[s] = 2.0 * size[s] if full else level * weight[s]
        if not full:
            break
        left -= sum(target[s] for s in full)
        open_ -= set(full)
    sized = mixing.sizes(docs)
    got = mixing.plan(sized).collect()
    taken = collections.Counter()
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(taken[s] == math.floor(target[s] + 1e-9) for s in names)
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, mixing.plan(sized.repartition(5)).collect()))
    assert mixing.plan(mixing.sizes(empty)).count() == 0
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    left = collections.Counter(r["source"] for r in mixed.collect())
    assert set(left) <= set(names)


def test_mixing_slices(spark, monkeypatch):
    rows = [(i if i % 5 else None, "a" if i % 3 else "b", 1 + i % 7, f"t{i % 9}") for i in range(300)] + [(1, "a", 3, "same")] * 50
    sized = spark.createDataFrame(rows, "doc_id long, source string, size long, text_hash string")
    want = sorted(map(str, mixing.plan(sized).collect()))
    monkeypatch.setattr(mixing, "SLICE", 8)
    monkeypatch.setattr(mixing, "BLOCK", 4)
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert sorted(map(str, mixing.plan(sized.repartition(5)).collect())) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_meets_its_targets(spark, monkeypatch, seed):
    """Repeated rows, null keys and sources, clashing names: each source within a document of its target."""
    r = random.Random(seed)
    names = "doc_id long, text string, source string, size long, copies int, mix_size string, number int, extra int"
    rows = [(r.choice([None, 1, 2, 3, k]), " ".join(["w"] * r.choice([0, 1, 4, 9, 9, 9])) or None, r.choice(["a", "a", "a", "b", None]), 5, 6, "x", k, 7) for k in range(150)]
    rows += [(None, "four words are here", "c", 1, 2, "y", 3, 4)] * 37
    docs = spark.createDataFrame(rows, names).repartition(4)
    wanted = {x["source"]: x["target"] for x in mixing.plan(mixing.sizes(docs), cut="document").select("source", "target").distinct().collect()}
    if seed == 2:
        monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(mixing, "BLOCK", 5)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    got, taken, size = mixed.collect(), collections.Counter(), collections.Counter()
    for x in got:
        taken[x["source"]] += len(words(x["text"]))
    for x in rows:
        size[x[2]] += len(words(x[1]))
    assert set(map(tuple, got)) <= set(rows)
    assert all(abs(taken[s] - t) <= 9 / 2 + 1 for s, t in wanted.items()), (taken, wanted)
    copies, there = collections.Counter(map(tuple, got)), collections.Counter(rows)
    assert all(n <= 2 * there[x] for x, n in copies.items())


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    s = 0
    for k, c in enumerate(reversed(d)):
        x = int(c) * (1 + k % 2)
        s += x - 9 * (x > 9)
    return s % 10 == 0


def base_spans(t):
    out = []
    for kind, p in PII.items():
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}
            if good[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii_spans(spark):
    r = random.Random(3)
    parts = ["a@b.c", "x.y@mail.example.com", "_d@e.f", "@", "@b", "a@b", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "0255.01.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111", "41111111111111112", "4" * 25, "+1 (555) 010-2030", "+49 30 1234567", "+1", "++12 345 678 90", "ñ", "\U0001f600", "\n", " ", ".", "-", "%"]
    cases = ["".join(r.choice(parts) for _ in range(r.randint(1, 12))) for _ in range(400)]
    cases += ["", None, "a" * 50_000, "1" * 50_000, "a@" + ".b" * 20_000, "+1" + " " * 30_000, "1 " * 30_000, "a@b.co " * 3000, "x 1.2.3.4 " * 4097, "1.2.3.4 " * 64, "1.2.3.4 " * 4096]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "doc_id long, text string")
    for row in pii.digest(pii.find(df)).collect():
        want = base_spans(cases[row["doc_id"]] or "")
        assert row["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), cases[row["doc_id"]]
        assert set(want) <= set(row["spans"].split(","))


def test_pii_method_spans(spark):
    assert pii.digest(pii.find(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
    cases = [("IBAN DE89370400440532013000 ok", "iban:5:27"), ("DE89370400440532013001", ""), ("my ssn is 123-45-6789.", "ssn:10:21"), ("code 123-45-6789.", ""), ("GB82 WEST 1234 5698 7654 32", "iban:0:27")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find(df)).collect()}
    assert [got[i] for i in range(len(cases))] == [s for _, s in cases]


def test_pii_iban_ends_at_its_length(spark):
    iban, spaced = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00"
    behind = ["", " Kontoinhaber", " Please pay", " BIC COBADEFF", " IBAN", " 12345", " 7", ".", f" {iban}"]
    cases = [(x + b, [f"iban:0:{len(x)}"]) for x in (iban, spaced, "NO93 8601 1117 947", "GB82 WEST 1234 5698 7654 32") for b in behind[:-1]]
    cases += [(f"{iban} {spaced}", ["iban:0:22", "iban:23:50"]), (f"ZZ12 3456 7890 123 {spaced}", ["iban:19:46"]), (iban + "X", []), (iban + "0 Please", []), ("DE89370400440532013001 Please", [])]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find(df)).collect()}
    for i, (text, want) in enumerate(cases):
        assert [s for s in got[i].split(",") if s.startswith("iban")] == want, text


def test_codes_round_trip():
    r = random.Random(5)
    for n in (0, 1, 7, 511, 512, 513, 5000):
        ids = np.array([r.choice([1, 200, 256, 49407, 70_000, 2**32 - 1]) for _ in range(n)], dtype="<u4")
        codes = token_ids.Codes(token_ids.encode(ids))
        assert len(codes) == n and (codes.all() == ids).all()
        assert all(codes[i] == ids[i] for i in range(n))
    with pytest.raises(IndexError):
        codes[5000]


def test_token_ids_equal_the_library(spark, docs, empty, monkeypatch):
    from tokenizers import Tokenizer

    odd = ["<|endoftext|> x", "it's don't THE. the.. a». b́. 1.5! ǅİΣ. ẞ", "<|STARTOFTEXT|>", "?!", ".", "a b", "café, Café,"]
    more = spark.createDataFrame([(900 + i, t) for i, t in enumerate(odd)] + [(77_777, "x y")] * 3, "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(more)
    monkeypatch.setattr(token_ids, "SHARD_IDS", 700)
    monkeypatch.setattr(token_ids, "PART_BYTES", 4000)
    monkeypatch.setattr(token_ids, "FILE_SHARDS", 2)
    tok = Tokenizer.from_file(token_ids.default_vocabulary())
    want, at = [], 0
    crc = lambda t: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
    rows = [(r["doc_id"], crc(r["text"])) for r in both.collect()]
    got = token_ids.round_trip(both).orderBy("start").collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((d is not None, d or 0, len(a), zlib.crc32(a.tobytes())) for d, a in rows)
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    keys = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got]
    assert keys == sorted(keys) and want == []
    assert token_ids.round_trip(empty).count() == 0


def fingerprint(t):
    w = (t or "").encode().lower().split()
    sh = [b" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closest(fps, limit=4):
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a, b in itertools.combinations(sorted(fps), 2):
        if (a ^ b).bit_count() <= limit:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {f: root(f) for f in fps}


def test_simhash_fingerprints(docs, empty):
    rows = docs.collect()
    fps = [fingerprint(r["text"]) for r in rows]
    group = closest(set(fps))
    least = {}
    for r, f in zip(rows, fps, strict=True):
        if r["doc_id"] is not None:
            least[group[f]] = min(least.get(group[f], 10**9), r["doc_id"])
    got = collections.Counter(map(tuple, simhash.near_duplicates(docs).collect()))
    assert got == collections.Counter((r["doc_id"], f"{f:016x}", least.get(group[f])) for r, f in zip(rows, fps, strict=True))
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(least.values()) and len(ids) == len(set(group.values()))


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_keep_one_is_by_row(spark, monkeypatch, broadcast):
    """Repeated and null keys: one row for each component, whatever the keys are."""
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", broadcast)
    r = random.Random(3)
    prose = [" ".join(f"w{r.randint(0, 10**6)}" for _ in range(30)) for _ in range(12)] + ["", None]
    rows = [(5, prose[0], 1), (5, prose[1], 2), (6, prose[2], 3), (3, prose[1], 4), (6, prose[1], 5)]
    rows += [(None, prose[3], 6), (None, prose[3], 7), (None, prose[4], 8), (9, prose[4], 9), (7, prose[5], 10), (7, prose[5], 10)]
    rows += [(r.choice([None, 1, 2, 8]), r.choice(prose), k) for k in range(20, 80)] + [(11, None, 90), (12, "", 91)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int").withColumn("a.b", F.lit("x")).repartition(3)
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    left, group = got.collect(), closest({fingerprint(t) for t in prose})
    assert len(left) == len(set(group.values())) and {tuple(x)[:3] for x in left} <= set(rows)
    for x in left:
        own = [k for k, t, _ in rows if group[fingerprint(t)] == group[fingerprint(x["text"])]]
        assert x["doc_id"] == min((k for k in own if k is not None), default=None)


def test_simhash_groups_grow():
    assert [simhash.groups_for(n) for n in (0, 10**5, 10**7, 10**10)] == sorted(simhash.groups_for(n) for n in (0, 10**5, 10**7, 10**10))
    assert simhash.groups_for(0) == 5 and simhash.groups_for(10**10) >= 9


@pytest.mark.parametrize("cell,groups", [(8192, 5), (16, 6), (64, 9)])
def test_simhash_links(spark, monkeypatch, cell, groups):
    monkeypatch.setattr(simhash, "CELL", cell)
    monkeypatch.setattr(simhash, "groups_for", lambda n: groups)
    r = random.Random(11)
    fps = {0, 2**64 - 1, 2**63}
    for _ in range(12):
        f = r.getrandbits(64)
        for _ in range(r.choice([1, 5, 40])):
            fps.add(f)
            for b in r.sample(range(64), r.randint(1, 5)):
                f ^= 1 << b
    signed = {f - (1 << 64 if f >> 63 else 0): f for f in fps}
    df = spark.createDataFrame([(s,) for s in signed], "fp long").repartition(4)
    labels = {r["node"]: r["label"] for r in simhash.components(simhash.links(df)).collect()}
    got, want = collections.defaultdict(set), collections.defaultdict(set)
    roots = closest(fps)
    for s, f in signed.items():
        got[labels.get(s, s)].add(f)
        want[roots[f]].add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def naive_tiling(p, t, least):
    mp, mt, out = [False] * len(p), [False] * len(t), []
    while True:
        best = 0
        for i in range(len(p)):
            for j in range(len(t)):
                k = 0
                while i + k < len(p) and j + k < len(t) and p[i + k] == t[j + k] != 0 and not mp[i + k] and not mt[j + k]:
                    k += 1
                if k > best:
                    best, at = k, (i, j)
        if best < least:
            return out
        i, j = at
        for k in range(best):
            mp[i + k] = mt[j + k] = True
        out.append((i, j, best))


def test_tiling_equals_naive_tiling():
    r = random.Random(2)
    for _ in range(60):
        p = np.array([r.randint(1, 5) for _ in range(r.randint(0, 18))])
        t = np.array([r.randint(0, 5) for _ in range(r.randint(0, 40))])
        got, want = decontaminate.tiling(p, t), naive_tiling(p.tolist(), t.tolist(), 3)
        assert [x[2] for x in got] == [x[2] for x in want]
        assert sum(x[2] for x in got) == sum(x[2] for x in want)


def covered_naively(item, doc):
    """(covered, tiles) over all tokens of both."""
    numbers = {w: k + 1 for k, w in enumerate(dict.fromkeys(item))}
    tiles = naive_tiling([numbers[w] for w in item], [numbers.get(w, 0) for w in doc], min(3, len(item)))
    return sum(x[2] for x in tiles), len(tiles)


def bench_case(seed):
    """Documents with reordered, cut and word-swapped items, short items, repeated and null keys."""
    r = random.Random(seed)
    vocab = [f"word{i}" for i in range(60)]
    prose = lambda k: [r.choice(vocab) for _ in range(k)]
    items = [prose(r.choice([1, 2, 3, 4, 5, 7, 12, 20, 36])) for _ in range(14)]
    items += [["common", "words", "here", *x] for x in items[-4:]] + [items[0], []]
    docs = []
    for _ in range(60):
        w = list(r.choice(items))
        step = r.choice([2, 3, 4, 5, 40])
        pieces = [w[k : k + step] for k in range(0, len(w), step)]
        r.shuffle(pieces)
        w = sum((p + (prose(1) if r.random() < 0.3 else []) for p in pieces), [])
        for k in range(len(w)):
            if r.random() < 0.08:
                w[k] = r.choice(vocab)
        docs.append(["common", "words", "here", *prose(r.choice([0, 3, 30])), *w, *prose(r.choice([0, 4]))])
    return items, [*docs, docs[0], []]


@pytest.mark.parametrize("seed", [1])
def test_decontamination_equals_all_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(decontaminate, "HOT", 4)
    items, texts = bench_case(seed)
    want = collections.Counter()
    for i, d in enumerate(texts):
        for k, x in enumerate(items):
            n, tiles = covered_naively(x, d) if x else (0, 0)
            if x and n >= 0.8 * len(x) - 1e-9:
                want[(i if i % 10 else None, k if k != 3 else None, n, tiles)] += 1
    docs = spark.createDataFrame([(i if i % 10 else None, " ".join(d)) for i, d in enumerate(texts)] + [(900, None)], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(k if k != 3 else None, " ".join(x)) for k, x in enumerate(items)] + [(91, None), (92, " ?! ")], "item_id long, text string")
    for chars, rows in ((4_000_000, 100_000), (0, 0)):  # small and large benchmarks
        monkeypatch.setattr(decontaminate, "BROADCAST_CHARS", chars)
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows)
        got = collections.Counter((x["doc_id"], x["item_id"], x["covered_tokens"], x["n_tiles"]) for x in decontaminate.leaks(docs, bench).collect())
        assert got == want
        leaking = {d for d, _, _, _ in want if d is not None}
        kept = decontaminate.remove_leaks(docs, bench).collect()
        assert {x["doc_id"] for x in kept if x["doc_id"] is not None} == {i for i in range(len(texts)) if i % 10} - leaking | {900}


@pytest.mark.parametrize("chars", [4_000_000, 0])
def test_decontamination_of_one_text_with_many_items(spark, monkeypatch, chars):
    """A text that thousands of items are candidates of gives them all, its tokens sent once for many."""
    monkeypatch.setattr(decontaminate, "BROADCAST_CHARS", chars)
    r = random.Random(9)
    vocab = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(6))) for i in range(3000)]
    docs = [(1, " ".join(t for _, t in items)), (2, "nothing of that"), (None, items[5][1])]
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {x["item_id"] for x in got if x["doc_id"] == 1} == set(range(3000))
    assert 5 in {x["item_id"] for x in got if x["doc_id"] is None} and not any(x["doc_id"] == 2 for x in got)


def test_decontamination_finds_shuffled_phrases(spark):
    """Five pieces of four tokens in another order: no run of five is shared."""
    words = [f"w{i}" for i in range(20)]
    pieces = [words[k : k + 4] for k in (8, 0, 16, 4, 12)]
    docs = spark.createDataFrame([(1, " x ".join(" ".join(p) for p in pieces)), (2, " ".join(words[:15]))], "doc_id long, text string")
    got = decontaminate.leaks(docs, spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["covered_tokens"], r["n_tiles"]) for r in got] == [(1, 7, 20, 5)]


def test_decontamination(spark, empty):
    r = random.Random(4)
    vocab = [f"word{i}" for i in range(400)]
    prose = lambda k: [r.choice(vocab) for _ in range(k)]
    items = [prose(36) for _ in range(6)]
    sentence = [items[2][24:], items[2][:12], items[2][12:24]]
    rows = {
        1: prose(200) + items[0] + prose(100),
        2: [w.upper() + "," for w in prose(50) + items[1]],
        3: sum(([*s, *prose(3)] for s in sentence), prose(20)),
        4: prose(300) + items[3][:7] + prose(50),
        5: prose(300),
        6: items[4][:32] + prose(10),
        7: [],
    }
    docs = spark.createDataFrame([(k, " ".join(w), "en", "s", 0, 1, "w") for k, w in rows.items()] + [(8, None, "en", "s", 0, 1, "w")], SCHEMA)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(90, "not there"), (91, None), (92, "")], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.leaks(docs, bench).collect()}
    assert got == {(1, 0), (2, 1), (3, 2), (6, 4)}
    clean = decontaminate.remove_leaks(docs.withColumns({"digest": F.lit("d"), "a.b": F.lit(1)}), bench)
    assert clean.columns == [*docs.columns, "digest", "a.b"] and {x["doc_id"] for x in clean.collect()} == {4, 5, 7, 8}
    assert decontaminate.leaks(empty, bench).count() == 0 and decontaminate.leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.remove_leaks(empty, bench).count() == 0 and decontaminate.remove_leaks(docs, bench.limit(0)).count() == len(rows) + 1


def brute_model(trained, order, kappa):
    counts = collections.Counter()
    for w in trained:
        for n in range(1, order + 1):
            counts.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    n_all = sum(c for g, c in counts.items() if len(g) == 1)
    v = sum(len(g) == 1 for g in counts)

    def p(context, w):
        if not context:
            return (counts[(w,)] + 1) / (n_all + v + 1)
        return (counts[(*context, w)] + kappa * p(context[1:], w)) / (counts[context] + kappa)

    return counts, n_all, v, lambda ws: sum(math.log10(p(tuple(ws[max(0, i - order + 1) : i]), w)) for i, w in enumerate(ws))


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_language_model(docs, empty, monkeypatch, order):
    monkeypatch.setattr(language_model, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(language_model, "RANGE_BYTES", 5000)
    rows = [(r["doc_id"], (r["text"] or "").encode().lower().split() + ["</s>"]) for r in docs.collect()]
    held = {d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows}
    counts, n, v, score = brute_model([w for d, w in rows if not held[d]], order, language_model.KAPPA)
    got = sorted(map(tuple, language_model.scores(docs, order=order).collect()), key=str)
    want = sorted(((d, held[d], len(w), sum(counts[(x,)] > 0 for x in w), n, sum(math.log10((counts[(x,)] + 1) / (n + v + 1)) for x in w), score(w)) for d, w in rows), key=str)
    for a, b in zip(sorted(got, key=lambda x: (str(x[0]), x[2])), sorted(want, key=lambda x: (str(x[0]), x[2])), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5]) and a[6] == pytest.approx(b[6])
    assert language_model.scores(empty).count() == 0


def test_language_model_with_mixed_counts(docs, monkeypatch):
    """Keys of few bits mix counts: probabilities stay such, and full keys are exact."""
    exact = {tuple(r)[:6]: r["score"] for r in language_model.scores(docs, spare_bits=None).collect()}
    monkeypatch.setattr(language_model, "max", lambda *x: min(x) if x[0] == 40 else max(*x), raising=False)
    mixed = {tuple(r)[:6]: r["score"] for r in language_model.scores(docs.withColumn("a.b", F.col("doc_id")), key="a.b", spare_bits=18).collect()}
    assert exact.keys() == mixed.keys()
    assert all(s <= 1e-9 for s in mixed.values())
    assert sum(abs(exact[k] - mixed[k]) > 1e-9 for k in exact) < len(exact)


def test_language_model_registered_order(spark):
    """The registered query tells texts apart that only a context of two words can."""
    rows = [(i, t, "en", "s", 0, 0, "") for i, t in enumerate(["a b c", "d b e"] * 400 + ["a b e"])]
    got = {r["doc_id"]: r["score"] for r in language_model.scores(spark.createDataFrame(rows, SCHEMA)).collect()}
    trained = [t.split() + ["</s>"] for i, t, *_ in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    score = brute_model(trained, 3, language_model.KAPPA)[3]
    for i in (0, 1, 800):
        assert got[i] == pytest.approx(score(rows[i][1].split() + ["</s>"]))


def test_toxicity_learns(spark, empty):
    r = random.Random(9)
    vocab, bad = [f"w{i}" for i in range(300)], ["idiot", "scum", "moron"]
    rows = []
    for i in range(600):
        w = [r.choice(vocab) for _ in range(r.randint(5, 60))]
        toxic = i % 6 == 0
        if toxic:
            w.insert(r.randrange(len(w)), r.choice(bad).title() + "!")
        rows.append((i, " ".join(w), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9999, None), (9998, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 400] + [(1, None), (None, 1), (2, 7)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    test = [(got[i] >= 0.5, bool(y)) for i, _, y in rows if i >= 400]
    assert sum(a == b for a, b in test) / len(test) >= 0.97
    assert got[9999] == got[9998] < 0.5
    again = toxicity.train(docs.repartition(7), labels)
    assert model[0] == again[0] and (model[1] == again[1]).all() and (model[2] == again[2]).all()
    assert toxicity.train(docs, labels.limit(0))[0] == toxicity.BIAS
    assert toxicity.score(empty, model).count() == 0


def test_toxicity_equals_plain_ftrl(spark):
    """Weights from one loop over features in dictionaries, and repeated and differing labels."""
    r = random.Random(21)
    rows = [(i, " ".join(r.choice(["a", "B!", "c", "dd", "é", "f"]) for _ in range(r.randint(0, 9)))) for i in range(80)]
    marks = {i: int("dd" in t.split()) for i, t in rows if i < 60}
    labels = spark.createDataFrame([*marks.items(), (3, 0), (4, 1), (70, None), (None, 1)], "doc_id long, toxic int")
    marks[4] = 1
    docs = spark.createDataFrame(rows + rows[:5], "doc_id long, text string").repartition(3)
    bias, at, w = toxicity.train(docs, labels)
    features = toxicity.Features()
    order = [x["doc_id"] for x in spark.createDataFrame([(i,) for i in marks], "doc_id long").orderBy(F.xxhash64(F.col("doc_id").cast("string"))).collect()]
    z, n, b, bn = collections.Counter(), collections.Counter(), toxicity.BIAS, 0.0
    weight = lambda k: 0.0 if abs(z[k]) <= toxicity.L1 else -(z[k] - math.copysign(toxicity.L1, z[k])) / ((toxicity.BETA + math.sqrt(n[k])) / toxicity.ALPHA + toxicity.L2)
    text = dict(rows)
    for _ in range(toxicity.EPOCHS):
        for i in order:
            for _ in range(toxicity.POSITIVE if marks[i] else 1):
                own = features(text[i].encode()).tolist()
                old = {k: weight(k) for k in own}
                g = 1 / (1 + math.exp(-(b + sum(old.values())))) - marks[i]
                for k in own:
                    z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / toxicity.ALPHA * old[k]
                    n[k] += g * g
                bn += g * g
                b -= toxicity.ALPHA * g / (toxicity.BETA + math.sqrt(bn))
    want = {k: weight(k) for k in z if weight(k)}
    assert want and bias == pytest.approx(b) and dict(zip(at.tolist(), w.tolist(), strict=True)) == pytest.approx(want, rel=1e-5)
    few = toxicity.train(docs, labels, most=10)
    assert len(few[1]) <= 30


def test_url_parts_and_explicit_rules(spark):
    cases = [
        ("http://Foo.ORG/a?b", "foo.org", "/a", "org/", "allow"),
        ("https://example.org/es/x", "example.org", "/es/x", "example.org/es/", "block"),
        ("https://www.example.org/en/17#t", "www.example.org", "/en/17", "example.org/en/1", "block"),
        ("https://badexample.org/es/x", "badexample.org", "/es/x", "org/", "allow"),
        ("ftp://x.com/de/1", "x.com", "/de/1", "com/de/", "block"),
        ("http://x.com?p=/de/", "x.com", "", None, "allow"),
        ("http://org", "org", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)] + [(0, cases[0][0])], "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = url_filter.judge(pages, labels).collect()
    assert len(got) == len(cases) + 1
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == cases[r["page_id"]][1:]
    assert url_filter.judge(pages.limit(0), labels).count() == 0


def test_url_rules_are_learned(spark):
    rows = [(i, f"http://{'spam' if i % 4 == 0 else 'news'}.net/{i}?{'ref' if i % 2 else 'id'}=1") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r for r in url_filter.judge(pages, labels).collect()}
    assert all((got[i]["verdict"] == "block") == (i % 4 == 0) for i in range(400))
    assert got[0]["learned_rule"] == "host=spam.net"


def test_url_rules_equal_all_subsets(spark):
    """Every rule that holds, from all subsets of tokens; the best one for each url."""
    r = random.Random(12)
    urls = [f"http://{r.choice('abc')}.{r.choice(['net', 'io'])}/{r.choice('pq')}/{r.choice('xyz')}?{r.choice('kl')}=1" for _ in range(500)]
    rows = [(i, u, int(r.random() < (0.9 if "a.net/p" in u or "/x?k" in u else 0.1))) for i, u in enumerate(urls)]
    pages = spark.createDataFrame([(i, u) for i, u, _ in rows], "page_id long, url string")
    at = F.col("url")
    sets = {x["page_id"]: frozenset(x["t"]) for x in pages.select("page_id", url_filter.tokens(at, url_filter.host(at), url_filter.path(at)).alias("t")).collect()}
    known = [(sets[i], b) for i, _, b in rows if i < 400]
    share = sum(b for _, b in known) / len(known)
    counts = collections.defaultdict(lambda: [0, 0])
    for t, b in known:
        for k in range(1, len(t) + 1):
            for c in itertools.combinations(sorted(t), k):
                counts[c][b] += 1
    found = {}
    for c, n in counts.items():
        for label, name, base in ((1, "block", share), (0, "allow", 1 - share)):
            if n[label] >= 20 and n[label] / sum(n) >= 0.6 and n[label] / sum(n) >= 1.2 * base:
                found[c, name] = n[label] / sum(n)
    want = {x: v for x, v in found.items() if not any(y[1] == x[1] and set(y[0]) < set(x[0]) and w >= v for y, w in found.items())}
    labelled = spark.createDataFrame([(sorted(t), bool(b)) for t, b in known], "tokens array<string>, blocked boolean")
    rules = url_filter.learn(labelled).collect()
    assert {(tuple(x["tokens"]), x["verdict"]): pytest.approx(x["confidence"]) for x in rules} == want
    labels = spark.createDataFrame([(i, 1 - b, None) for i, _, b in rows if i < 400] + [(0, None, None)], "doc_id long, quality int, toxic int")
    for x in url_filter.judge(pages, labels).collect():
        own = max(((v, len(c), c, name) for (c, name), v in want.items() if set(c) <= sets[x["page_id"]]), default=None)
        assert x["verdict"] == (own[3] if own else "allow") and x["learned_rule"] == (" ".join(own[2]) if own else None)


def test_url_rules_on_a_late_token(spark):
    """A rule on tokens behind the bound on mined ones is found where mining may look at all."""
    rows = []
    for i in range(400):
        bad = i % 4 == 0
        # two tokens that tell the label well, and a pair that tells it for sure
        own = [t for t, k in (("near1", 16), ("near2", 24)) if bad == (i % k != 0)] + (["u", "v"] if bad else ["u"] if i % 3 else ["v"])
        rows.append((sorted(own), bad))
    labelled = spark.createDataFrame(rows, "tokens array<string>, blocked boolean")
    rules = lambda most: {tuple(r["tokens"]) for r in url_filter.learn(labelled, 20, 0.99, 1.2, most).collect()}
    assert ("u", "v") in rules(None) and ("u", "v") not in rules(2)


def test_url_rules_behind_many_tokens(spark):
    """By itself, mining looks at every token: 17 that tell the label well hide no pair that tells it for sure."""
    rows = []
    for i in range(400):
        bad = i % 4 == 0
        own = ([f"near{k:02d}" for k in range(17)] if bad and i % 24 else []) + (["u", "v"] if bad else ["u"] if i % 3 else ["v"])
        rows.append((sorted([*own, "scheme"]), bad))
    labelled = spark.createDataFrame(rows, "tokens array<string>, blocked boolean")
    rules = lambda *most: {tuple(r["tokens"]) for r in url_filter.learn(labelled, 20, 0.99, 1.2, *most).collect()}
    assert ("u", "v") in rules() and ("u", "v") not in rules(16)


def test_url_rules_are_the_same_however_dealt(spark, monkeypatch):
    """Rules of urls that are dealt to tokens, and dealt again, are those of all subsets."""
    r = random.Random(4)
    known = []
    for _ in range(300):
        t = {x for x in "abcdefg" if r.random() < 0.5} | {"all"} | ({"a", "h"} if r.random() < 0.3 else set())
        known.append((frozenset(t), r.random() < (1 if {"b", "c", "h"} <= t else 0.8 if {"a", "d"} <= t else 0.2)))
    share = sum(b for _, b in known) / len(known)
    labelled = spark.createDataFrame([(sorted(t), b) for t, b in known], "tokens array<string>, blocked boolean")
    for lift in (1.2, 0.5):
        found = {}
        for k in range(1, 10):
            for c in itertools.combinations(["a", "all", *"bcdefgh"], k):
                labels = [b for t, b in known if t.issuperset(c)]
                for name, hits, base in (("block", sum(labels), share), ("allow", len(labels) - sum(labels), 1 - share)):
                    if hits >= 20 and hits / len(labels) >= 0.6 and hits / len(labels) >= lift * base:
                        found[c, name] = hits / len(labels)
        want = {x: v for x, v in found.items() if not any(y[1] == x[1] and set(y[0]) < set(x[0]) and w >= v for y, w in found.items())}
        for most in (16, 4, 1):
            monkeypatch.setattr(url_filter, "GROWN_TOKENS", most)
            got = url_filter.learn(labelled, min_lift=lift).collect()
            assert len(got) == len(want) and {(tuple(x["tokens"]), x["verdict"]): pytest.approx(x["confidence"]) for x in got} == want


def test_url_tokens_do_not_run_together(spark):
    """Urls whose tokens look alike once joined by blanks are told apart."""
    rows = [(i, "http://x.net/a/b" if i % 2 else "http://x.net/a path=b") for i in range(100)]
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(100)], "doc_id long, quality int, toxic int")
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), labels).collect()
    assert all(x["verdict"] == ("block" if x["page_id"] % 2 else "allow") for x in got)


def test_site_quality(spark, empty):
    r = random.Random(6)
    prose = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(90))
    rows = []
    for i in range(400):
        junk = i % 8 == 0
        t = " | ".join(prose().split()) if junk else prose()
        rows.append((i, t, f"site{i % 5}" if i % 7 else None, int(not junk)))
    docs = spark.createDataFrame([(i, t, s) for i, t, s, _ in rows] + [(777, None, "x")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, q) for i, _, _, q in rows if i < 300], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in site_quality.classify(docs, labels, F.col("source"), F.lit("p")).collect()}
    assert len(got) == 401
    assert sum(got[i]["kept"] == bool(q) for i, _, _, q in rows) >= 395
    assert all(0 < r["path_share"] < 1 and 0 < r["host_share"] < 1 for r in got.values())
    none = site_quality.classify(docs, labels.limit(0), F.col("source"), F.lit("p"))
    assert none.where("kept").count() == 401
    assert site_quality.classify(empty, labels, F.col("source"), F.col("lang")).count() == 0


def test_sites_are_of_one_page(spark):
    from arborix.llm.queries import sites_of

    pages = spark.createDataFrame([(1, "http://b.org/a/x"), (1, "http://a.org/z/x"), (2, None), (None, "http://c.org/")], "page_id long, url string")
    assert sorted(map(tuple, sites_of(pages).collect())) == [(1, "a.org", "z"), (2, "", "")]


@pytest.mark.parametrize("broadcast", [True, False])
def test_site_quality_equals_loops(spark, monkeypatch, broadcast):
    """Evidence, strengths, shares without the document, all from plain loops."""
    if not broadcast:
        monkeypatch.setattr(site_quality, "BROADCAST_SITES", 0)
        monkeypatch.setattr(site_quality, "HOT", 6)
    r = random.Random(8)
    rows = []
    for i in range(160):
        w = ["ab" * r.randint(1, 4) for _ in range(r.choice([10, 40, 90]))]
        rows.append((i if i % 20 else None, " | ".join(w) if r.random() < (0.6 if i % 4 == 1 else 0.1) else " ".join(w), r.choice([None, "h1", "h2", f"h{i % 30}"]), r.choice([None, "p", "q"])))
    rows.append(rows[5])
    labels = [(i, int("|" not in t)) for i, t, _, _ in rows[:100] if i is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string").repartition(3)
    got = site_quality.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int"), F.col("host"), F.col("path")).collect()

    where = docs.select("doc_id", "host", "path").where("doc_id IS NOT NULL").distinct()
    moved = site_quality.classify(docs, docs.limit(0).select("doc_id", F.lit(1).alias("quality")), F.col("host"), F.col("path"), sites=where.select("doc_id", F.lit("h").alias("host"), "path"))
    assert moved.count() == len(rows) and moved.where("doc_id IS NOT NULL").select("host_share").distinct().count() == 1

    def bins(t):
        w = t.split()
        n, chars = max(len(w), 1), sum(map(len, w))
        x = {"words": len(w), "word_length": chars / n, "distinct": len(set(w)) / n, "symbols": t.count("|") / n, "bangs": 0, "capitals": 0, "repeated_lines": 0, "same_next": sum(a == b for a, b in zip(w, w[1:], strict=False)) / n}
        return {k: sum(v > e for e in site_quality.BINS[k]) for k, v in x.items()}

    known, own = dict(labels), [(d, bins(t), h, p) for d, t, h, p in rows]
    marked = [(b, known[d]) for d, b, _, _ in own if d in known]
    n = {g: sum(q == g for _, q in marked) for g in (0, 1)}
    share = (n[1] + 10 * 0.9) / (len(marked) + 10)
    part = lambda k, v, g: (sum(b[k] == v and q == g for b, q in marked) + 1) / (n[g] + len(site_quality.BINS[k]) + 1)
    evidence = [sum(math.log(part(k, v, 1) / part(k, v, 0)) for k, v in b.items()) for _, b, _, _ in own]
    soft = [1 / (1 + math.exp(-(e + math.log(share / (1 - share))))) for e in evidence]

    def level(key):
        count, good = collections.Counter(map(key, own)), collections.Counter()
        for x, p in zip(own, soft, strict=True):
            good[key(x)] += p
        total = sum(count.values())
        m = sum(good.values()) / total
        s = sum(c * (good[k] / c - m) ** 2 for k, c in count.items())
        between = (s - (len(count) - 1) * m * (1 - m)) / (total - sum(c * c for c in count.values()) / total)
        return count, good, m, min(1000.0, max(5.0, m * (1 - m) / between - 1)) if between > 0 else 1000.0

    hn, hg, m, hk = level(lambda x: x[2])
    pn, pg, _, pk = level(lambda x: x[2:])
    want = []
    for x, e, p in zip(own, evidence, soft, strict=True):
        host = (hg[x[2]] + m * hk) / (hn[x[2]] + hk)
        others = (hg[x[2]] - p + m * hk) / (hn[x[2]] - 1 + hk)
        site = min(0.999, max(0.001, (pg[x[2:]] - p + others * pk) / (pn[x[2:]] - 1 + pk)))
        post = 1 / (1 + math.exp(-(e + math.log(site / (1 - site)))))
        want.append((x[0] or 0, e, host, (pg[x[2:]] + host * pk) / (pn[x[2:]] + pk), post))
    found = sorted((x["doc_id"] or 0, x["evidence"], x["host_share"], x["path_share"], x["posterior"]) for x in got)
    assert all(a == pytest.approx(b, abs=2e-6) for a, b in zip(found, sorted(want), strict=True))


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns == columns
        seen.append(docs.count())
    assert seen[0] > seen[1] > seen[3] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == seen[-1] and corpus_pipeline.run(spark, sf).count() == seen[-1]


def test_memo_is_bounded_and_right():
    calls, limit = [], 40 * (text.Memo.ENTRY + 10)
    memo = text.Memo(lambda w: calls.append(w) or w[::-1] * 2, limit)
    r = random.Random(2)
    for _ in range(3000):
        w = f"w{r.randrange(100):04d}".encode()
        assert memo[w] == w[::-1] * 2
        assert memo.held <= limit / 2 + 200
    assert 100 < len(calls) < 3000
    assert memo[b"x" * limit] == b"x" * limit * 2 and b"x" * limit not in memo
