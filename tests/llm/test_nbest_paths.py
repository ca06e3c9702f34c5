"""Operator 4's N best segmentations, as paths, against the enumeration of all of them."""

from __future__ import annotations

import random

import numpy as np

from rankspark.llm import pieces
from rankspark.llm.queries import QUERIES

from . import helpers as h


def _all_paths(lattice, text):
    into, out = lattice.edges(text), []

    def go(j, score, ids):
        if j == 0:
            out.append((score, tuple(ids)))
        for i, piece, s in into[j]:
            go(i, score + s, ([piece] if piece >= 0 else lattice.fallback(text[i:j])) + ids)

    go(len(text), 0.0, [])
    return out


def _right(lattice, text, got):
    """Different paths, each with its own score, and no better one left out."""
    every = _all_paths(lattice, " " + text)
    score = {ids: s for s, ids in every}
    assert len(score) == len(every)
    assert len({ids for _, ids in got}) == len(got)
    assert [s for s, _ in got] == [score[ids] for _, ids in got] == sorted(score.values(), reverse=True)[: len(got)]
    return len(every)


def test_paths_against_enumeration():
    vocabulary = pieces.Vocabulary.load()
    rng = random.Random(3)
    texts = ["the cat", "a  b", "é\n.x", "the the the", "日本 x", "  ", "\x00", "thethe"] + ["".join(rng.choice("the .é\n1") for _ in range(10)) for _ in range(60)]
    for n in (1, 3, 6):
        encoder = pieces.Encoder(vocabulary, n)
        for text in texts:
            got = [(s, tuple(np.frombuffer(raw, np.int32).tolist())) for s, raw in encoder.encode_n(text)]
            assert len(got) == min(n, _right(encoder.lattice, text, got))
            assert all(pieces.decode_ids(np.array(ids, np.int32), vocabulary.texts) == text for _, ids in got)


def test_paths_of_equal_scores():
    """All pieces score the same: many ties, in which the batch solver and A-star may differ."""
    names = [" ", "a", "b", " a", "ab", "ba", "aa", " ab", "aba"]
    vocabulary = pieces.Vocabulary({x: (i, -1.0) for i, x in enumerate(names)}, [x.encode() for x in names], [], 99)
    rng = random.Random(4)
    encoder = pieces.Encoder(vocabulary, 4)
    for _ in range(200):
        text = "".join(rng.choice("aab ") for _ in range(rng.randint(1, 9)))
        got = [(s, tuple(np.frombuffer(raw, np.int32).tolist())) for s, raw in encoder.encode_n(text)]
        assert len(got) == min(4, _right(encoder.lattice, text, got))


def test_tables_hold_the_paths(spark):
    rows = [(1, "the cat", None), (None, None, None), (2, "", None), (3, "a", None), (3, "hello 日本 there", None)]
    vocabulary = pieces.Vocabulary.load()
    encoder = pieces.Encoder(vocabulary)
    got = h.rows_of(pieces.n_best_ids(pieces.encode(h.table(spark, rows))), "doc_id", "nbest_scores", "nbest_ids")
    expected = []
    for i, text, _ in rows:
        paths = [(s, np.frombuffer(raw, np.int32).tolist()) for s, raw in encoder.encode_n(text or "")]
        expected.append((i, [s for s, _ in paths], [x for _, x in paths]))
    assert got == sorted(expected, key=repr)
    assert max(len(x[2]) for x in got) == pieces.N_BEST
    query = QUERIES["op4_sentencepiece_nbest"](spark, "/root/testdata/sf0.001").limit(50)
    best = {r.doc_id: r.ids for r in query.collect()}
    for r in pieces.n_best_ids(query).collect():
        assert len(r.nbest_ids) == len(r.nbest_scores) == len(set(map(tuple, r.nbest_ids))) and r.nbest_ids[0] == best[r.doc_id]
