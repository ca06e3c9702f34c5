"""Collocations and quotient filters against brute force, on awkward rows."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from rankspark.llm import collocations as col
from rankspark.llm import common
from rankspark.llm import quotient_filter as qf

from . import helpers as h

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def brute(rows, least, top):
    f = defaultdict(Counter)
    n = Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(h.LOW)):
            ws = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            lang_ = "und" if lang is None else lang
            n[lang_] += len(ws)
            for k in range(1, 6):
                for i in range(len(ws) - k + 1):
                    f[lang_][tuple(ws[i: i + k])] += 1
    out = []
    for lang, counts in f.items():
        often = {p: c for p, c in counts.items() if c >= least}
        longer = Counter()
        for p, c in often.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i: i + k]] = max(longer[p[i: i + k]], c)
        scored = []
        for p, a in often.items():
            if len(p) > 1 and not (longer[p] and 100 * longer[p] >= 100 * a):
                s, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-s, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return out


def corpus(seed):
    rng = random.Random(seed)
    rows = h.corpus(seed, 40)
    fixed = ["new york city", "New York", "in spite of the", "a a a a a a", "été à la", "x　y z", "one two three four five six"]
    for i in range(60):
        text = " ".join(rng.choice([*fixed, "the", "of", "w1", "w2\tw3", "end.", "stop!now", "line\nbreak", "\x0b", ", "]) for _ in range(30))
        rows.append((20_000 + i, text, rng.choice(["en", "en", "fr", None, "", "l x"])))
    return rows


@pytest.mark.parametrize("least,top,room,size,part,task", [(5, 2000, 2**26, 2**21, 1_500_000, 4_000_000), (3, 7, 2**26, 60, 40, 25), (5, 50, 10, 2**21, 1_500_000, 300), (8, 2000, 10, 90, 64, 4_000_000)])
def test_against_brute_force(spark, monkeypatch, least, top, room, size, part, task):
    """Dictionary and hash numbers, texts cut into small chunks, many parts, filters sent early."""
    monkeypatch.setattr(col, "chunks", lambda solid, offsets: common.chunks(solid, offsets, size))
    monkeypatch.setattr(col, "PART_ENTRIES", part)
    monkeypatch.setattr(col, "TASK_ENTRIES", task)
    rows = corpus(41)
    want = brute(rows, least, top)
    assert len(want) > 30 or top == 7
    h.same(col.collocations(h.table(spark, rows), least, top, room), want, *COLUMNS)


def test_full_bit_maps_only_cost_time(spark, monkeypatch):
    monkeypatch.setattr(col, "MAP_BITS", 64)
    rows = corpus(42)
    for room in (2**26, 10):
        h.same(col.collocations(h.table(spark, rows), 4, 2000, room), brute(rows, 4, 2000), *COLUMNS)


def test_words_with_one_hash(spark, monkeypatch):
    rows = corpus(43)[:30]
    monkeypatch.setattr(common, "word_hashes", lambda data, s, e: np.full(len(s), 5, np.uint64))
    monkeypatch.setattr(col, "word_hashes", common.word_hashes)
    want = Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(h.LOW)):
            want.update(("und" if lang is None else lang, w) for w in re.split(r"[\x20\x09]+", piece) if w)
    h.same(col.count_words(h.table(spark, rows)), [(*k, f) for k, f in want.items()], "lang", "word", "f")
    with pytest.raises(ValueError, match="share a 64-bit hash"):
        col.collocations(h.table(spark, rows), 3, 2000, 10)


def test_empty_tables(spark):
    for rows in ([], [(1, None, None)], [(1, "one two", "en")]):
        out = col.collocations(h.table(spark, rows))
        assert out.collect() == [] and tuple(out.columns) == COLUMNS
    assert [t for c, t in out.dtypes if c not in ("lang", "phrase")] == ["bigint"] * 6


def test_a_piece_of_megabytes(spark):
    """One text without a piece end, far longer than a chunk: nothing is lost at the cuts."""
    rng = random.Random(9)
    text = " ".join(rng.choice(["aa", "bb", "cc", "dd ee", "ff gg hh"]) for _ in range(900_000))
    assert len(text) > 2 * common.SLICE_BYTES // 2
    rows = [(1, text, "en")]
    h.same(col.collocations(h.table(spark, rows, 1), 100, 2000), brute(rows, 100, 2000), *COLUMNS)


def test_scores_beyond_64_bits(spark):
    phrases = spark.createDataFrame([("en", "a", ["a"], 3 * 10**12), ("en", "b", ["b"], 2 * 10**12), ("en", "a b", ["a", "b"], 10**12)], "lang string, phrase string, words array<string>, f long")
    totals = spark.createDataFrame([("en", 10**16)], "lang string, n long")
    was = col.frequent_phrases
    col.frequent_phrases = lambda *_: (phrases, totals)
    try:
        assert col.collocations(phrases).first()["score"] == 1000 * 10**12 * 10**16 // (3 * 10**12 * 2 * 10**12)
    finally:
        col.frequent_phrases = was


@pytest.mark.parametrize("k", [1, 2, 3, 4, 5])
@pytest.mark.parametrize("bits", [1, 3, 15, 17, 26, 40, 64])
def test_filters_are_lossless_and_merge(k, bits):
    rng = np.random.default_rng(k * 100 + bits)
    ids = [rng.integers(0, min(2**bits, 40), 3000).astype(np.uint64) for _ in range(k)]
    if bits == 64:
        ids[0] |= np.uint64(2**63)
    want = Counter(zip(*[x.tolist() for x in ids], strict=True))
    lanes = qf.permute(ids, bits)
    assert all((a == b).all() for a, b in zip(qf.restore(lanes, bits), ids, strict=True))
    for part_bits in (0, 1, 7):
        if part_bits > k * bits:
            continue
        shards, merged = [qf.Counter(k, bits, 300) for _ in range(3)], qf.Counter(k, bits)
        for i in range(0, 3000, 250):
            shards[i % 3].add([x[i: i + 250] for x in ids])
        parts = defaultdict(set)
        for s in shards:
            for part, n, blob in s.filters(part_bits):
                keys, counts = qf.decode(blob)
                assert len(counts) == n and len(set(zip(*[x.tolist() for x in keys], strict=True))) == n
                parts[part] |= set(zip(*[x.tolist() for x in keys], strict=True))
                merged.merge(keys, counts)
        assert sum(map(len, parts.values())) == len(want)  # a key has one part
        lanes, counts = merged.grams(1)
        assert dict(zip(zip(*[x.tolist() for x in lanes], strict=True), counts.tolist(), strict=True)) == want


def test_filters_are_compact():
    """18 bits a word, 100,000 word pairs: far less than the 16 bytes of a key and a counter."""
    rng = np.random.default_rng(1)
    c = qf.Counter(2, 18)
    c.add([rng.integers(0, 2**18, 100_000), rng.integers(0, 2**18, 100_000)])
    (part, n, blob), = c.filters(0)
    assert n > 99_000 and len(blob) < 5 * n
