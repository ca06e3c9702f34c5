"""Operators 5, 7, 8 and 9 against brute force, on awkward rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from rankspark.llm import exact_dedup, line_dedup, minhash, substring_dedup
from rankspark.llm.common import bounded, text_buffers, word_hashes, word_spans
from rankspark.llm.components import connected_components
from rankspark.llm.fm_index import FMIndex

from . import helpers as h


@pytest.mark.parametrize("seed", [5, 6])
def test_exact_groups(spark, seed):
    rows = h.corpus(seed)
    h.same(exact_dedup.exact_groups(h.table(spark, rows)), h.exact_groups(rows), "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def test_exact_groups_when_chunk_ids_clash(spark, monkeypatch):
    """With identifiers of one value for all chunks, the verified bytes still tell texts apart."""
    rows = h.corpus(7, 20)
    docs = h.table(spark, rows)

    def clashing(batches):
        for b in exact_dedup._recipes(batches):
            yield pa.record_batch([b.column(0), pa.array([[7] * len(x) for x in b.column(1)], pa.list_(pa.int64())), b.column(2), pa.array([9] * b.num_rows, pa.int64())], names=b.schema.names)

    recipes = docs.select("doc_id", "text").mapInArrow(clashing, "doc_id long, recipe array<long>, text_sha256 string, n_bytes long")
    monkeypatch.setattr(exact_dedup, "chunk_recipes", lambda _: recipes)
    monkeypatch.setattr(exact_dedup, "clashing_chunks", lambda d: d.sparkSession.createDataFrame([(7,)], "chunk long"))
    got = h.rows_of(exact_dedup.exact_groups(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    expected = sorted(h.exact_groups(rows), key=repr)
    empty = h.sha("")
    assert [x for x in got if x[4] != empty] == [x for x in expected if x[4] != empty]


def test_chunks_follow_content():
    """An insertion moves only the chunks around it, and chunks always make up the text."""
    rng = np.random.default_rng(1)
    body = bytes(rng.integers(97, 123, 60_000, dtype=np.uint8)).decode()
    ids = []
    for text in (body, body[:20_000] + "inserted" + body[20_000:]):
        (_, whole, parts), = exact_dedup._chunks(pa.array([text]))
        assert b"".join(p for _, p in parts) == whole == text.encode()
        assert all(len(p) <= exact_dedup.MAX_CHUNK for _, p in parts)
        ids.append({i for i, _ in parts})
    assert len(ids[0] & ids[1]) >= 0.8 * len(ids[0])


@pytest.mark.parametrize("seed", [5, 8])
def test_line_dedup(spark, seed):
    rows = h.corpus(seed)
    got = line_dedup.dedup_lines(h.table(spark, rows), digest_only=True)
    h.same(got, h.dedup_lines(rows), "doc_id", "n_lines", "n_dropped", "kept_sha256")


def test_line_stream_over_any_cut():
    """The stream's drops plus its edge reports give the same result however rows are cut."""
    rng = np.random.default_rng(3)
    rows = sorted({(int(k), 0, -int(d), int(p)) for k, d, p in zip(rng.integers(0, 12, 400), rng.integers(0, 40, 400), rng.integers(0, 5, 400), strict=True)})
    rows += [(99, 0, -d, 0) for d in range(60, 0, -1)][::-1]
    rows = sorted(rows)
    data = np.array([[k, z, -d, 1, p, 9] for k, z, d, p in rows], np.int64)
    docs = {}
    for k, _, d, _ in rows:
        docs.setdefault(k, set()).add(-d)
    expected = {(k, -d, p) for k, _, d, p in rows if len(docs[k]) >= 3 and -d != max(docs[k])}
    keys = [(r[0], r[2]) for r in data.tolist()]
    for trial in range(40):
        cuts = sorted(rng.choice(len(data), 4).tolist()) if trial else []
        cuts = sorted({next((i for i in range(c, len(data)) if i == 0 or keys[i] != keys[i - 1]), len(data)) for c in cuts})
        drops, edges = set(), {}
        for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True):
            step = int(rng.integers(1, 30))
            batches = [pa.record_batch([pa.array(data[i: min(i + step, b), j]) for j in range(6)], names=line_dedup._NAMES) for i in range(a, b, step)]
            for out in line_dedup._stream(3)(iter(batches)):
                for r in out.to_pylist():
                    if r["kind"] == 0:
                        drops.add((r["h1"], r["doc"], r["pos"]))
                    else:
                        n, top = edges.get(r["h1"], (0, -1))
                        edges[r["h1"]] = (n + r["docs"], max(top, r["doc"]))
            assert len(edges) <= 2 * (len(cuts) + 1)
        drops |= {(k, -d, p) for k, _, d, p in rows if k in edges and edges[k][0] >= 3 and -d < edges[k][1]}
        assert drops == expected


@pytest.mark.parametrize("seed", [5, 9])
def test_substring_dedup(spark, seed):
    rows = h.corpus(seed)
    got = substring_dedup.dedup_substrings(h.table(spark, rows), digest_only=True)
    h.same(got, h.dedup_substrings(rows), "doc_id", "n_words", "n_removed", "kept_sha256")


def test_substring_dedup_of_hot_anchors(spark, monkeypatch):
    """Routing every window alone, as for very common anchors, and a saturated filter change nothing."""
    rows = h.corpus(10, 30)
    monkeypatch.setattr(substring_dedup, "HOT_ANCHOR", 1)
    monkeypatch.setattr(substring_dedup, "FILTER_BYTES", 64 * 16)
    got = substring_dedup.dedup_substrings(h.table(spark, rows), digest_only=True)
    h.same(got, h.dedup_substrings(rows), "doc_id", "n_words", "n_removed", "kept_sha256")


def test_fm_index():
    rng = np.random.default_rng(4)
    text = rng.integers(1, 5, 3000)
    text[::97] = 0
    text[-1] = 0
    index = FMIndex(text, 5, 4)
    starts = np.array([i for i in range(len(text) - 4) if 0 not in text[i: i + 4]])
    lo, hi = index.matching_statistics(starts, block=500)
    value = rng.permutation(len(text))
    least = index.interval_minimum(lo[hi > lo], hi[hi > lo], value)
    least = dict(zip(starts[hi > lo].tolist(), least.tolist(), strict=True))
    for s, a, b in zip(starts.tolist(), lo.tolist(), hi.tolist(), strict=True):
        there = [i for i in range(len(text) - 3) if (text[i: i + 4] == text[s: s + 4]).all()]
        if len(there) > 1:
            assert b - a == len(there) and sorted(index.order[a:b]) == there and least[s] == value[there].min()


@pytest.mark.parametrize("seed", [5, 11])
def test_near_groups(spark, seed):
    rows = h.corpus(seed)
    h.same(minhash.near_groups(h.table(spark, rows)), h.near_groups(rows), "doc_id", "n_shingles", "component_id", "kept")


def test_near_groups_of_a_family(spark):
    """Many copies of one text, some beyond the threshold from it but near each other."""
    import random

    rng = random.Random(1)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(70):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 6])):
            words[rng.randrange(150)] = f"x{rng.randrange(8)}"
        rows.append((i, " ".join(words), "en"))
        if rng.random() < 0.4:
            words[rng.randrange(150)] = "again"
            rows.append((1000 + i, " ".join(words), "en"))
    h.same(minhash.near_groups(h.table(spark, rows)), h.near_groups(rows), "doc_id", "n_shingles", "component_id", "kept")


def test_sketch_is_full_and_estimates_similarity():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    for size in (1, 2, 7, 50, 1000):
        sketch = minhash.similarity_sketch(pool[:size], 80)
        assert (sketch != np.iinfo(np.uint64).max).all()
    agree = [(minhash.similarity_sketch(pool[i: i + 900], 400) == minhash.similarity_sketch(pool[i + 100: i + 1000], 400)).mean() for i in range(0, 1000, 100)]
    assert abs(np.mean(agree) - 0.8) < 0.03


def test_components(spark):
    import random

    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        parent[hi] = lo
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("run", [exact_dedup.exact_groups, line_dedup.dedup_lines, substring_dedup.dedup_substrings, minhash.near_groups], ids=str)
def test_no_rows(spark, run):
    assert run(h.table(spark, [])).collect() == []


def test_kept_text_and_rows(spark):
    rows = [(1, "first line that is long enough\nb", None), (2, "First Line That Is Long Enough \nc", None), (3, "first line that is long enough", None)]
    docs = h.table(spark, rows)
    h.same(line_dedup.dedup_lines(docs), [(1, "b"), (2, "c"), (3, rows[2][1])], "doc_id", "text")
    for drop in (exact_dedup.drop_copies, minhash.drop_near_copies):
        assert drop(docs).columns == docs.columns


def test_words_and_slices():
    texts = ["a bb", "", None, " cé\tdd ", "e" * 100 + " " + "e" * 101, "a"]
    data, offsets = text_buffers(pa.array(texts))
    starts, ends, first = word_spans(data, offsets)
    raw = data.tobytes()
    assert [[raw[a:b].decode() for a, b in zip(starts[i:j], ends[i:j], strict=True)] for i, j in zip(first[:-1], first[1:], strict=True)] == [h.words_of(t) for t in texts]
    hashes = word_hashes(data, starts, ends)
    assert hashes[0] == hashes[-1] and len(set(hashes.tolist())) == len(hashes) - 1
    batch = pa.record_batch([pa.array(["x" * 3_000_000, None, "y", "z" * 1_500_000, "q" * 1_500_000])], names=["t"])
    assert [b.num_rows for b in bounded([batch], 0)] == [1, 3, 1] and sum(b.num_rows for b in bounded([batch], 0)) == 5
