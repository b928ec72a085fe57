"""Importance resampling, token counts and the prefix trie against plain Python."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arborix.llm import importance, prefix_trie, queries, token_counts
from tests.llm.test_operators import WORD, texts
from tests.oracle import assert_same, connect

RUN = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["op11_importance", "op13_prefix_trie"])
def test_query_equals_its_sql(spark, name):
    assert_same(spark, connect(SF), queries.QUERIES[name], queries.ORACLES[name], SF)


def runs(text, most):
    w = RUN.findall((text or "").encode().lower())
    return len(w), [zlib.crc32(b" ".join(w[i : i + n])) for n in range(1, most + 1) for i in range(len(w) - n + 1)]


def noisy_texts():
    r = random.Random(3)
    marks = [0, 32, 10, 47, 48, 57, 58, 64, 65, 90, 91, 96, 97, 122, 123, 127, 0x80, 0xE9, 0x4E00, 0x1F600]
    out = ["".join(chr(r.choice(marks)) for _ in range(r.randint(0, 40))) for _ in range(300)]
    return out + ["", None, "Zz", "Zz ", "a" * 70_000 + " b", "x", "", "last"]


@pytest.mark.parametrize("most", [1, 2, 3])
def test_automaton_equals_a_pattern_and_crc32(most, monkeypatch):
    monkeypatch.setattr(importance, "AT_ONCE", 500)
    said, got = noisy_texts(), []
    column = pa.array([None if t is None else t.encode() for t in ["cut off", *said]], pa.binary()).slice(1)
    for rows, data, offsets in importance._parts(column):
        words, found = importance.features(data, offsets, most, 1 << 32)
        own = [[] for _ in range(rows)]
        for text, bucket in found:
            for i, b in zip(text.tolist(), bucket.tolist(), strict=True):
                own[i].append(b)
        got += zip(words.tolist(), own, strict=True)
    assert got == [runs(t, most) for t in said]


@pytest.mark.parametrize("most", [1, 2])
def test_resampling_equals_loops(spark, monkeypatch, most):
    monkeypatch.setattr(importance, "SLICE", 7)
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(30)] + ["Straße", "ñandú"]
    rows = [(i if i % 11 else None, " ".join(r.choice(vocab) for _ in range(r.choice([3, 19, 20, 40, 90])))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, " \n"), rows[3], rows[3], (503, "w1 " * 500)] + [(None, "w2 " * 25)] * 40 + [(7, "w3 " * 25)] * 10
    target = [(" ".join(vocab[:9]),), (None,), ("w1 w2 w1",)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, score int, rank string").withColumn("a.b", F.lit(1)).repartition(3)
    bench = spark.createDataFrame(target, "text string")
    own, want = [runs(t, most) for _, t in rows], []
    s = collections.Counter(f % 50 for _, fs in own for f in fs)
    t = collections.Counter(f % 50 for (x,) in target for f in runs(x, most)[1])
    ns, nt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ns + 50) / ((s[b] + 1) * (nt + 50)))) for b in range(50)]
    for (i, _), (n, fs) in zip(rows, own, strict=True):
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[f % 50] for f in fs)
        want.append([i, n, len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    pool = sorted((x for x in want if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    size = 30 * len(pool) // 100
    want = [(*x[:1], *x[2:], None) for x in want if x[1] < 20] + [(*x[:1], *x[2:], k + 1 if k < size else None) for k, x in enumerate(pool)]
    got = importance.resample(docs, bench, percent=30, most_words=most, buckets=50)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert len(set(collections.Counter(x[-1] for x in want if x[-1]).values())) == 1


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b " * 20)], "doc_id long, text string")
    assert importance.resample(none, some).count() == 0
    # two buckets with 20 of 40 features each, none in the target
    gain = math.floor(1000 * math.log(1 * (40 + 10_000) / (21 * 10_000)))
    assert [tuple(r)[:3] for r in importance.resample(some, none).collect()] == [(1, 40, 40 * gain)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_counts.default_vocabulary())


def test_token_counts_equal_the_library(spark, library):
    r = random.Random(5)
    said = [*texts(), *noisy_texts(), "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>  ", "<|endoftext|", "don't we'll I'd 'S", "\n\n  x", " " * 5000, "ab" * 9000]
    said += ["".join(chr(r.choice([32, 10, 39, 97, 115, 116, 65, 49, 0xE9, 0x4E00, 0x1F600, 0xA0, 0x2003])) for _ in range(60)) for _ in range(300)]
    said += ["".join(r.choice("abcdefghij") for _ in range(30_000)), "word " * 2000]
    docs = spark.createDataFrame([(i if i != 4 else None, t, 3, "x") for i, t in enumerate(said)] * 2, "doc_id long, text string, n_tokens int, n_bytes string").withColumn("a.b", F.lit(1))
    got = token_counts.counts(docs.repartition(3))
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    n = [len(e.ids) for e in library.encode_batch([t or "" for t in said], add_special_tokens=False)]
    want = [(i if i != 4 else None, len((t or "").encode()), k, k > 1024) for i, (t, k) in enumerate(zip(said, n, strict=True))]
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(want * 2)
    assert {True, False} == {w[3] for w in want}
    assert token_counts.counts(docs.where("false")).count() == 0


def test_token_counts_of_every_character(library, monkeypatch):
    monkeypatch.setattr(token_counts, "STRIDE", 5000)
    monkeypatch.setattr(token_counts, "KEPT", 20_000)
    counter = token_counts.Counter(token_counts.default_vocabulary())
    said = [f"a{chr(c)}b {chr(c)}1{chr(c)}{chr(c)}  {chr(c)}" for c in range(1, 0x1F000) if not 0xD800 <= c < 0xE000]
    want = [len(e.ids) for e in library.encode_batch(said, add_special_tokens=False)]
    assert counter.counts([t.encode() for t in said]) == want
    assert counter.counts([" ".join(said).encode()]) == [len(library.encode(" ".join(said), add_special_tokens=False).ids)]
    assert len(counter.kept) <= 30_000


@pytest.mark.parametrize("in_order", [True, False])
def test_merges_equal_one_by_one(in_order):
    """Vocabularies whose ranks follow their symbols' making, and others."""
    r = random.Random(6)
    for _ in range(20):
        letters = token_counts.byte_letters()
        made, merges = ["a", "b", "c"], []
        for _ in range(40):
            a, b = r.choice(made), r.choice(made)
            if a + b not in made and len(a + b) < 9:
                made.append(a + b)
                merges.append((a, b))
        if not in_order:
            r.shuffle(merges)
        vocabulary = {t: i for i, t in enumerate([*letters, *[a + b for a, b in merges]])}
        own = token_counts.Merges(vocabulary, merges)
        assert own.in_order or not in_order
        words = ["".join(r.choice("abc") for _ in range(r.randint(1, 30))) for _ in range(60)]
        ranks = {}
        for n, (a, b) in enumerate(merges):
            ranks[(a, b)] = n
        want = []
        for w in words:
            w = list(w)
            while found := [(ranks[p], i) for i, p in enumerate(zip(w, w[1:], strict=False)) if p in ranks]:
                i = min(found)[1]
                w[i : i + 2] = [w[i] + w[i + 1]]
            want.append(len(w))
        assert own.counts([w.encode() for w in words]).tolist() == want


def plain_trie(rows, borrow):
    """Nodes by walking every prefix of every conversation."""
    talks = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            talks[c].append((turn is not None, turn or 0, role or "", text or ""))
    key = lambda t: (t[0], t[1], t[2], hashlib.sha256(f"{len(t[2])}:{t[2]}{t[3]}".encode()).digest())
    talks = {c: [t[2:] for t in sorted(own, key=key)] for c, own in talks.items()}
    if borrow:
        h = {c: zlib.crc32(str(c).encode()) % 4 for c in talks}
        talks = {c: talks.get(c - c % 20, [])[: h[c]] + own[h[c] :] for c, own in talks.items()}
    members = collections.defaultdict(list)
    for c in sorted(talks):
        for d in range(len(talks[c]) + 1):
            members[tuple(talks[c][:d])].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * len(WORD.findall(p[-1][1])) if p else 0
    ends = lambda p, m: hashlib.sha256(",".join(str(c) for c in m if len(talks[c]) == len(p)).encode()).hexdigest()
    return sorted((m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], ends(p, m)) for p, m in members.items())


def conversations():
    r = random.Random(8)
    said = ["hello there", "yes", "no way at all", "", None, "tell me more"]
    rows = [(c, t, r.choice(["user", "assistant", None, ""]), r.choice(said[: 2 + c % 5])) for c in range(130) if c not in (40, 60) for t in range(r.choice([1, 2, 3, 5, 8, 9]))]
    rows += [(200 + c, t, "user", f"turn {t}") for c in range(30) for t in range(37)]  # copies
    rows += [(300 + c, t, "user", f"turn {t}" if t < 11 * c else f"own {c}") for c in range(5) for t in range(50)]
    rows += [(c, 0, "user", "hi") for c in (60, 66)] + [(None, 1, "user", "lost"), (500, None, "user", "first"), (500, 1, "user", "b"), (500, 1, "user", "a"), (500, 1, "user", "a"), (500, 1, "assistant", "c")]
    return rows


@pytest.mark.parametrize("borrow", [False, True])
@pytest.mark.parametrize("slice_", [25, 100_000])
def test_trie_equals_walking(spark, monkeypatch, borrow, slice_):
    monkeypatch.setattr(prefix_trie, "SLICE", slice_)
    monkeypatch.setattr(prefix_trie, "PIECE", 4)
    rows = conversations()
    table = spark.createDataFrame([(*x, 1, "y") for x in rows], "conv_id long, turn long, role string, text string, name int, up string").withColumn("a.b", F.lit(1))
    made = prefix_trie.placed(table.repartition(5))
    got = prefix_trie.trie(*(prefix_trie.with_borrowed_heads if borrow else prefix_trie.whole)(*made))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=lambda x: (x[0], x[1])) == sorted(plain_trie(rows, borrow), key=lambda x: (x[0], x[1]))


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.of_conversations(none).count() == 0
    one = spark.createDataFrame([(19, 0, "user", "gone")], none.schema)
    got = prefix_trie.trie(*prefix_trie.with_borrowed_heads(*prefix_trie.placed(one)))
    assert sorted(map(tuple, got.collect())) == plain_trie([(19, 0, "user", "gone")], True)
