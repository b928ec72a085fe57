"""Each stage of the pipeline on its own input, and the whole of it, against plain Python."""

import collections
import hashlib
import math
import zlib

import numpy as np

import corpus_pipeline
from arborix.llm import decontaminate, token_ids
from arborix.llm.text import bare_words
from tests.llm.test_contracts import quality_counts, vote
from tests.llm.test_operators import closest, covered_naively, fingerprint, naive_em, words

SF = "/root/testdata/sf0.001"


def good(rows):
    counts = [quality_counts(r["text"]) for r in rows]
    base = [not (c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]) for c in counts]
    p = iter(naive_em([vote(c) for c, b in zip(counts, base, strict=True) if b]))
    return [r for r, b in zip(rows, base, strict=True) if b and next(p) >= 0.5]


def one_of_each(rows):
    fps = {r["doc_id"]: fingerprint(r["text"]) for r in rows}
    group = closest(set(fps.values()))
    least = {}
    for r in rows:
        g = group[fps[r["doc_id"]]]
        least[g] = min(least.get(g, r["doc_id"]), r["doc_id"])
    return [r for r in rows if r["doc_id"] in set(least.values())]


def clean(rows, items):
    def leaks(text):
        doc = bare_words((text or "").encode())
        for item in items:
            size, least = min(3, len(item)), decontaminate.need(len(item))
            have = {tuple(doc[i : i + size]) for i in range(len(doc) - size + 1)}
            touched = {k + d for k in range(len(item) - size + 1) if tuple(item[k : k + size]) in have for d in range(size)}
            # tiles lie under shared runs, so only such items need tiling
            if len(touched) >= least and covered_naively(item, doc)[0] >= least:
                return True
        return False

    return [r for r in rows if not leaks(r["text"])]


def mixed(rows):
    size = {r["doc_id"]: len(words(r["text"])) for r in rows}
    total = collections.Counter()
    for r in rows:
        total[r["source"]] += size[r["doc_id"]]
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, open_, target = 1.5 * sum(total.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > 2 * total[s]]
        for s in full or open_:
            target[s] = 2.0 * total[s] if full else level * weight[s]
        if not full:
            break
        left -= sum(target[s] for s in full)
        open_ -= set(full)
    out = []
    for s in names:
        key = lambda r: hashlib.md5(f"mix-1:{r['doc_id']}:{hashlib.md5(r['text'].encode()).hexdigest()}:0".encode()).hexdigest()
        own, before = sorted((r for r in rows if r["source"] == s), key=key), 0
        full = int(target[s] // total[s])
        rest = math.floor(target[s] + 1e-9) - full * total[s]
        for r in own:
            n = size[r["doc_id"]]
            out += [r] * (full + (n > 0 and before + n / 2 <= rest))
            before += n
    return out


def encoded(rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_ids.default_vocabulary())
    out, start = [], 0
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        ids = np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_every_stage_and_the_whole(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [w for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if (w := bare_words((r["text"] or "").encode()))]
    brute = [good, one_of_each, lambda rows: clean(rows, items), mixed]
    rows = docs.collect()
    ids = lambda found: collections.Counter(r["doc_id"] for r in found)
    for (name, stage), expect in zip(corpus_pipeline.STAGES, brute, strict=False):
        before, rows = rows, expect(rows)
        got = stage(spark, spark.createDataFrame(before, docs.schema), SF)
        assert got.columns == docs.columns
        assert collections.Counter(map(tuple, got.collect())) == collections.Counter(map(tuple, rows)), name
        assert 0 < sum(ids(rows).values()) and (name == "mixing_sources" or len(rows) < len(before)), name
    want = encoded(rows)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == want
