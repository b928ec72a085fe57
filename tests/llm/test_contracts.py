"""Whole rows of a query's contract, against plain Python."""

import re

import numpy as np
import pyarrow as pa
import pytest

from arborix.llm import quality_rules, token_ids
from tests.llm.test_operators import WORD, junk_corpus, naive_em, texts


def quality_counts(text):
    """The counts that the rules read, by the contract's words."""
    t = text or ""
    w = WORD.findall(t)
    wins = list(zip(w, w[1:], w[2:], strict=False))
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", t)),
        "n_marks": sum(33 <= ord(c) < 127 and not c.isalpha() for c in t),
        "n_capitals": sum("A" <= c <= "Z" for c in t),
        "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_open_lines": sum(not re.search("[.!?:;。\")”…][ \t-\r]*$", x) for x in lines),
        "n_repeat_words": len({k + d for k, x in enumerate(wins) if wins.count(x) > 1 for d in range(3)}),
    }


def vote(counts):
    out = []
    for _, top, below, good, bad in quality_rules.RULES:
        x = counts[top] / max(counts[below], 1) if below else counts[top]
        yes, no = (x <= good, x >= bad) if good < bad else (x >= good, x < bad)
        out.append(0 if no else 2 if yes else 1)
    return out


def test_quality_rows(spark):
    """Nulls, empty texts, short ones and repeats: the whole row, the verdict included."""
    good, junk = junk_corpus()
    rows = good[:40] + good[180:190] + junk[:8] + [(5000 + i, t) for i, t in enumerate(texts())] + [(5001, None), (None, ""), (7000, "two words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    counts = [quality_counts(t) for _, t in rows]
    failed = [c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"] for c in counts]
    passed = [vote(c) for c, f in zip(counts, failed, strict=True) if not f]
    p = iter(naive_em(passed))
    shown = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    want = []
    for (i, _), c, f in zip(rows, counts, failed, strict=True):
        own = None if f else next(p)
        want.append((i, *[c[x] for x in shown], f, False if f else bool(own >= 0.5), None if f else round(float(own), 4)))
    got = quality_rules.quality(docs)
    assert got.columns == ["doc_id", *shown, "base_failed", "kept", "posterior"]
    got = [(*r[:8], None if r[8] is None else round(r[8], 4)) for r in got.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(f for f in failed) and {r[7] for r in got} == {True, False}


@pytest.mark.parametrize("form", ["{}", "{}.", "{},;x", "a{}b", "I{}!", "x{}'s.", "{}̀?"])
def test_token_ids_of_every_character(form):
    """All code points of the planes in use, alone, inside a word and before a tail."""
    encoder = token_ids.Encoder(token_ids.default_vocabulary())
    said = [form.format(chr(c)) for c in range(1, 0x1F000) if not 0xD800 <= c < 0xE000]
    said += ["İ.", "AKDENİ!", "İstanbul'da Gİ, x"]
    want = encoder.tokenizer.encode_batch(said, add_special_tokens=False)
    got = encoder.batch(pa.array([t.encode() for t in said], pa.binary()))
    wrong = [t for t, g, w in zip(said, got, want, strict=True) if np.frombuffer(g, "<u4")[:-1].tolist() != w.ids]
    assert wrong == []


def test_words_in_arrays_equal_a_table(monkeypatch):
    """Words that share a hash, long ones, empty ones, and arrays that begin anew."""
    monkeypatch.setattr(token_ids.Words, "_hashes", lambda self, data, starts, sizes: (data[np.minimum(starts, len(data) - 1)] % np.uint8(7)).astype(np.uint64) << np.uint64(50))
    words = token_ids.Words(lambda w: np.frombuffer(w * 2 + b"x", np.uint8).astype("<u4").tobytes(), 600)
    rng = np.random.default_rng(3)
    for _ in range(60):
        said = [bytes(rng.integers(97, 100, rng.choice([0, 1, 2, 3, 60])).astype(np.uint8)) for _ in range(20)]
        data, offsets = np.frombuffer(b"".join(said) or b"a", np.uint8), np.cumsum([0, *map(len, said)])
        ids, begins, sizes = words.look_up(data, offsets)
        assert [ids[b : b + n].astype(np.uint8).tobytes() for b, n in zip(begins, sizes, strict=True)] == [w * 2 + b"x" for w in said]
        assert words.held() <= 600
