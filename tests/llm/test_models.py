"""Operators 1, 3 and 4: against enumeration, exact round trips and held-out documents."""

from __future__ import annotations

import random
from itertools import product

import numpy as np
import pytest

from rankspark.llm import language, pieces, pii

from . import helpers as h


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load()


def _all_scores(lattice, text):
    into, out = lattice.edges(text), []

    def go(j, score):
        if j == 0:
            out.append(score)
        for i, _, s in into[j]:
            go(i, score + s)

    go(len(text), 0.0)
    return sorted(out, reverse=True)


def test_n_best_against_enumeration(vocabulary):
    encoder = pieces.Encoder(vocabulary, 4)
    rng = random.Random(1)
    texts = ["the cat", "a  b", "é\n.x", "hello. ▁ world", "日本 x", "  ", "\x00", "<s>"]
    texts += ["".join(rng.choice("the .é\n1") for _ in range(10)) for _ in range(80)]
    for text in texts:
        raw, scores = encoder.encode(text)
        assert pieces.decode_ids(np.frombuffer(raw, np.int32), vocabulary.texts) == text
        assert scores == _all_scores(encoder.lattice, " " + text)[:4]
    paths = encoder.lattice.n_best(" thethe", 6)
    assert len({tuple(p) for _, p in paths}) == 6 and [s for s, _ in paths] == _all_scores(encoder.lattice, " thethe")[:6]


def test_batch_solver_equals_the_lattice(vocabulary):
    lattice = pieces.Lattice(vocabulary)
    rng = random.Random(2)
    parts = [" " + "".join(rng.choice("etaoinshré.,日") for _ in range(rng.randint(1, 14))) for _ in range(500)] + ["x" * 60, "\n", "▁"]
    for part, got in zip(parts, pieces.BatchSolver(lattice).solve(parts), strict=True):
        ids, score, loss = lattice.solve(part)
        assert got == (np.array(ids, np.int32).tobytes(), score, loss)


def test_forgetting_words_changes_nothing(vocabulary, monkeypatch):
    texts = [t for _, t, _ in h.corpus(12) if t]
    plain = [pieces.Encoder(vocabulary).encode(t) for t in texts]
    monkeypatch.setattr(pieces, "MAX_WORDS", 20)
    encoder = pieces.Encoder(vocabulary)
    got = []
    for t in texts:
        encoder.prepare([t])
        got.append(encoder.encode(t))
    assert got == plain


def test_encode_and_decode_tables(spark):
    rows = h.corpus(13)
    encoded = pieces.encode(h.table(spark, rows))
    got = encoded.collect()
    assert len(got) == len(rows) and all(r.round_trip for r in got)
    assert all(r.nbest_scores == sorted(r.nbest_scores, reverse=True) and r.nbest_scores[0] == r.score and len(r.ids) == r.n_pieces for r in got)
    h.same(pieces.decode(encoded), [(i, t or "") for i, t, _ in rows], "doc_id", "text")
    assert pieces.encode(h.table(spark, [])).collect() == []


def test_trigrams():
    import pyarrow as pa

    from rankspark.llm.common import text_buffers

    texts = ["Ab, c!", "", None, "x", "1234", "été  là", "z" * 50]
    grams, rows = language.trigrams(*text_buffers(pa.array(texts)))
    for i, text in enumerate(texts):
        raw = bytes(language._LETTERS[np.frombuffer((text or "").encode(), np.uint8)])
        import re

        plain = re.sub(rb" +", b" ", b" " + raw)
        alone, alone_rows = language.trigrams(*text_buffers(pa.array([text])))
        assert grams[rows[i]: rows[i + 1]].tolist() == alone.tolist()
        assert alone_rows[-1] == max(0, len(plain) - 2)


def test_mixture_recovers_proportions():
    rng = np.random.default_rng(1)
    tables = rng.dirichlet(np.full(400, 0.2), 4).T + 1e-6
    tables /= tables.sum(0)
    draws = np.concatenate([rng.choice(400, 9000, p=tables[:, 0]), rng.choice(400, 3000, p=tables[:, 2])])
    counts = np.bincount(draws, minlength=400).astype(float)
    theta, gain = language.mixture(counts, tables, 0)
    assert np.allclose(theta, [0.75, 0, 0.25, 0], atol=0.03) and gain > 100
    counts = np.bincount(rng.choice(400, 9000, p=tables[:, 1]), minlength=400).astype(float)
    theta, _ = language.mixture(counts, tables, 1)
    assert theta.tolist() == [0, 1, 0, 0]


def test_language_of_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out]
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_language_reads_text_alone(spark, sf_dir):
    """Labels, sources and ids of held-out rows don't matter; odd rows have a defined result."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(300)
    before = h.rows_of(language.identify(docs), "doc_id", "lang_pred", "score")
    blind = docs.withColumn("lang", F.when(language.held_out(), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    assert h.rows_of(language.identify(blind), "doc_id", "lang_pred", "score") == before
    rows = h.corpus(14)
    got = language.identify(h.table(spark, rows)).collect()
    assert len(got) == len(rows)
    text = {i: t for i, t, _ in rows}
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in text[r.doc_id] or "")) for r in got if r.doc_id is not None)
    none = language.identify(h.table(spark, [(1, "some text", None), (2, None, None)])).collect()
    assert {r.lang_pred for r in none} == {"und"} and language.identify(h.table(spark, [])).collect() == []
    kept = {r.doc_id for r in language.keep_known(h.table(spark, rows)).collect()}
    assert all(any(c.isalpha() for c in text[i] or "") for i in kept if i is not None)


def _rule_spans(text):
    found = [("email", *m.span()) for m in pii.EMAIL.finditer(text)]
    found += [("ip", *m.span()) for m in pii.IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in pii.CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and pii.luhn(digits):
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in pii.PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


def test_base_spans_against_the_rules():
    rng = random.Random(2)
    texts = ["".join(rng.choice("a.@-%+ 19(") for _ in range(rng.randint(0, 30))) for _ in range(20_000)]
    texts += ["a@b.c@d.e x@y", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4", "4111 1111-1111 1111 5", "+1 (988) 555-2485 4111111111111111", "é@b.cc ½.1.1.1", "1" * 5000, "1." * 3000]
    for text in texts:
        assert pii.base_spans(text) == _rule_spans(text)


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112") and pii.luhn("79927398713")


def _segmentations(n, segments):
    if n == 0:
        return [[]]
    out = [x for x in _segmentations(n - 1, segments)]
    for s, (i, j, _) in enumerate(segments):
        if j == n:
            out += [[*x, (s, k)] for x in _segmentations(i, segments) for k in range(len(pii.KINDS))]
    return out


def test_semi_markov_field_against_enumeration():
    rng = np.random.default_rng(5)
    for n, m in product([3, 5], [2, 4]):
        bounds = [(int(i), int(rng.integers(i + 1, n + 1))) for i in rng.integers(0, n, m)]
        segments = [(i, j, rng.normal(size=pii.N_FEATURES)) for i, j in bounds]
        weights = rng.normal(size=(len(pii.KINDS), pii.N_FEATURES)) / 3
        every = _segmentations(n, segments)
        total = np.array([sum(weights[k] @ segments[s][2] for s, k in x) for x in every])
        best = every[int(total.argmax())]
        assert pii.viterbi(n, segments, weights) == [(*bounds[s], k) for s, k in best]
        share = np.exp(total - np.logaddexp.reduce(total))
        scores = np.array([x for _, _, x in segments]) @ weights.T
        around = pii._posterior_logs(n, bounds, np.logaddexp.reduce(scores, axis=1).tolist())
        for s in range(m):
            for k in range(len(pii.KINDS)):
                exact = sum(p for p, x in zip(share, every, strict=True) if (s, k) in x)
                assert abs(np.exp(scores[s, k] + around[s]) - exact) < 1e-9


def _fake_texts(seed):
    rng = random.Random(seed)
    out = []
    for _ in range(120):
        words = [rng.choice(["lorem", "ipsum", "version 3.", "in 2019,", "No. 17", "dolor"]) for _ in range(12)]
        digits = [rng.randrange(10) for _ in range(15)]
        card = next("".join(map(str, digits)) + str(c) for c in range(10) if pii.luhn("".join(map(str, digits)) + str(c)))
        words[3] = rng.choice([f"u{rng.randrange(99)}.x@mail{rng.randrange(9)}.example.com", f"10.{rng.randrange(256)}.3.{rng.randrange(256)}", card, f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}", "none"])
        out.append(" ".join(words))
    return out


def test_field_adds_what_rules_miss_and_nothing_else(spark):
    weights = pii.fit_weights(_fake_texts(1) + _fake_texts(4))
    card = next(x for t in _fake_texts(2) for x in t.split() if len(x) == 16 and x.isdigit())
    text = f"call +1 (988) 555-2485 {card} or joe [at] mail1 [dot] example [dot] com since version 3.1 of 2019"
    base = pii.base_spans(text)
    more = {(k, text[a:b]) for k, a, b in pii.added_spans(text, base, weights)}
    assert ("email", "joe [at] mail1 [dot] example [dot] com") in more
    assert {(k, text[a:b]) for k, a, b in base} | more >= {("card", card)}
    clean = ["lorem version 3.1 ipsum", "in 2019, dolor 17 of 20", "Licensed under CC BY-NC 4.0.", "token = \"0641917ea4e9feb9\"", "password=b7db7aa4a5fcc78305"]
    assert all(not pii.added_spans(t, [], weights) for t in clean)
    # untrained, nothing is added, and base spans always stay
    idle = pii.fit_weights(["no data"])
    assert pii.added_spans(text, base, idle) == []
    rows = [(i, t, None) for i, t in enumerate(_fake_texts(3))] + [(None, None, None), (900, "", None), (0, _fake_texts(3)[0], None)]
    for r in pii.find(h.table(spark, rows)).collect():
        found = _rule_spans(dict((i, t) for i, t, _ in rows)[r.doc_id] or "")
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, _, _ in found) for x in pii.KINDS)
        assert r.base_sha256 == h.sha(pii._written(found)) and set(filter(None, pii._written(found).split(","))) <= set(r.spans.split(","))
    assert pii.find(h.table(spark, [])).collect() == []
