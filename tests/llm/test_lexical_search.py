"""Ranked lexical search against a brute-force version, on awkward rows."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rankspark.llm import common, lexical_search
from rankspark.llm.lexical_search import bags, classes, search

from . import helpers as h

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(h.LOW))


def brute(rows, items, k):
    docs = [(i, Counter(terms(t))) for i, t, _ in rows if terms(t)]
    if not docs:
        return []
    n_docs, n_terms = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in docs:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return out


def items_of(rows, seed=3):
    rng = random.Random(seed)
    texts = [t for _, t, _ in rows if t and t.strip()]
    items = [(f"it-{i}", " ".join(rng.sample(texts[i % len(texts)].split(), min(6, len(texts[i % len(texts)].split()))))) for i in range(12)]
    return items + [("none", None), ("empty", ""), ("signs", "., !"), ("twice", items[0][1]), ("twice", items[0][1]), ("repeats", "the The THE w1 w1 été Été"), ("unknown", "zzzunknown"), ("x", "x" * 3000)]


@pytest.mark.parametrize("k,room,cells,size", [(20, 2**25, 2_000_000, 2**21), (3, 200, 50, 37), (1, 10**6, 7, 500)])
def test_against_brute_force(spark, monkeypatch, k, room, cells, size):
    monkeypatch.setattr(lexical_search, "CELLS", cells)
    monkeypatch.setattr(lexical_search, "chunks", lambda solid, offsets: common.chunks(solid, offsets, size))
    rows = h.corpus(31) + [(i, "w1 w2 the", "en") for i in range(9000, 9040)]  # a class larger than k
    items = items_of(rows)
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id string, text string, term string, score long")
    got = search(h.table(spark, rows), table, k, room)
    h.same(got, brute(rows, items, k), "item_id", "rank", "doc_id", "score")


def test_a_class_is_scored_once_and_shows_its_smallest_ids(spark):
    rows = [(i, "w1  W1, w2", "en") for i in range(50, 0, -1)] + [(99, "w1 w2", "en")]
    bag = bags(h.table(spark, rows), spark.sparkContext.broadcast(pa.array(["w1", "w2"]))).selectExpr("doc_id", "bag", "75L as m")
    got = {tuple(r.members) for r in classes(bag, 5).collect()}
    assert got == {(1, 2, 3, 4, 5), (99,)}


def test_equal_hashes_of_different_words_are_told_apart(monkeypatch):
    monkeypatch.setattr(common, "word_hashes", lambda data, s, e: np.full(len(s), 7, np.uint64))
    known = common.Lookup(pa.array(["ab", "abc", "xy"]))
    data = np.frombuffer(b"xyabcabzz", np.uint8)
    assert known.find(data, np.array([0, 2, 5, 7]), np.array([2, 5, 7, 9])).tolist() == [2, 1, 0, -1]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_chunks_cut_no_run(size):
    rng = random.Random(size)
    for _ in range(50):
        texts = ["".join(rng.choices("ab .", k=rng.randint(0, 12))) for _ in range(rng.randint(1, 6))]
        data, offsets = common.text_buffers(pa.array(texts))
        solid = ~np.isin(data, np.frombuffer(b" .", np.uint8))
        got = []
        for a, b, inside in common.chunks(solid, offsets, size):
            s, e, first = common.runs(solid[a:b], inside)
            rows = np.repeat(np.arange(len(texts)), np.diff(first))
            got += [(int(r), bytes(data[a + x: a + y]).decode()) for r, x, y in zip(rows, s, e, strict=True)]
        assert got == [(i, w) for i, t in enumerate(texts) for w in re.findall("[ab]+", t)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert search(h.table(spark, h.corpus(32)), none).collect() == []
    assert search(h.table(spark, []), one).collect() == []
    assert search(h.table(spark, [(1, None, "en"), (2, "...", "en")]), one).collect() == []


def test_a_text_of_megabytes(spark):
    rows = [(1, "alpha beta, " * 400_000, "en"), (2, "alpha gamma", "en")]
    items = [("a", "alpha"), ("b", "beta gamma")]
    got = search(h.table(spark, rows, 2), spark.createDataFrame(items, "item_id string, text string"))
    h.same(got, brute(rows, items, 20), "item_id", "rank", "doc_id", "score")
