"""Operators 2, 6 and 10 on small cases, brute force and round trips."""

from __future__ import annotations

import gzip
import hashlib
import random
from itertools import product

import pytest

from rankspark.llm import decontaminate, html_mincut, warc

from . import helpers as h

PAGE = "page_id long, url string, html string, capture_id string, type string, text string"


def _pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], PAGE) if rows else spark.createDataFrame([], PAGE)


def test_warc_round_trip(spark, scratch):
    big = "<p>ß " + "x" * 1200 + "\r\n\r\nWARC/1.1\r\n</p>"
    rows = [(1, "http://a/x?y=1", big), (5, None, big), (3, "http://a/\r\nHost: b", big), (2, "u", None), (4, "u", ""), (6, "v", "small"), (7, "v", "small"), (8, "w", "y" * 999), (9, "w", "y" * 999), (10, "é", "ü" * 500), (11, "é", "ü" * 500), (5, None, big), (None, "n", big)]
    path = f"{scratch}/w"
    warc.write_archives(_pages(spark, rows), path, records_per_file=7)
    got = warc.round_trip(_pages(spark, rows), f"{scratch}/w2").collect()
    expected = []
    for i, _, html in rows:
        raw = (html or "").encode()
        keeper = max((j for j, _, x in rows if x == html and j is not None))if html else None
        again = len(raw) >= 1000 and i != keeper
        expected.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", keeper if again else None))
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(expected, key=repr)
    # every capture comes with its own request and metadata
    uris = sorted((i, None if u is None else u.replace("\r", "%0A").replace("\n", "%0A")) for i, u, _ in rows if i is not None)
    assert sorted(((r.page_id, r.request_uri) for r in got if r.page_id is not None), key=repr) == sorted(uris, key=repr)
    assert all(r.metadata_fields == f"pageId: {'' if r.page_id is None else r.page_id}\r\n" for r in got)
    # the files are gzip streams of records; every capture has its request and metadata
    records = warc.read_records(spark, path, with_payload=True)
    nested = warc.assemble(records).collect()
    assert len(nested) == len(rows) and all(len(r.request) == 1 and len(r.metadata) == 1 for r in nested)
    assert sorted(bytes(r.capture.payload) for r in nested if r.capture.type == "response") == sorted((x or "").encode() for (i, _, x), e in zip(rows, expected, strict=True) if e[3] == "response")
    assert all(r.capture.declared_digest == r.capture.payload_digest for r in nested)
    import glob

    files = glob.glob(f"{path}/*.gz")
    assert sum(1 for f in files for _ in warc.parse_records(gzip.open(f).read())) == 3 * len(rows)
    assert warc.round_trip(_pages(spark, [])).collect() == []


def test_warc_rejects_broken_records():
    good = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert len(list(warc.parse_records(good * 2))) == 2
    for bad in (good[:-5], b"x" + good, good.replace(b"3", b"4")):
        with pytest.raises(ValueError):
            list(warc.parse_records(bad))


def test_minimum_cut_against_enumeration():
    rng = random.Random(4)
    for _ in range(150):
        n = rng.randint(1, 8)
        scores = [rng.uniform(-2, 2) for _ in range(n)]
        edges = {(i, j): rng.uniform(0, 1.5) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5}

        def cost(labels, scores=scores, edges=edges):
            return sum(max(0, -s) if x else max(0, s) for s, x in zip(scores, labels, strict=True)) + sum(w for (i, j), w in edges.items() if labels[i] != labels[j])

        best = min(map(cost, product([False, True], repeat=n)))
        assert abs(cost(html_mincut.minimum_cut(scores, edges)) - best) < 0.01


ARTICLE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><a href="/">Site</a></header><nav><ul><li><a href="/a">One</a></li><li><a>Two</a></li></ul></nav>
<div class="ad">Buy this great thing now, it is cheap and it is good.</div>
<article><h1>Head &amp; line</h1><p>First <b>paragraph</b>,\n with&nbsp;words &lt;here&gt;.<p>Short.<div class="share-buttons"><a>Share</a></div>
<aside>Related: another story about something else entirely, worth reading.</aside>
<p>Second<br>paragraph goes on for a while, as they do.</p><form><p>Subscribe to our letter today, please.</p></form></article>
<section id="comments"><p>I do not agree with this article at all, sorry about that.</p></section>
<div class="cookie-notice"><p>We use cookies, as everybody does these days, to know you.</p></div>
<footer>&copy; All rights reserved by the people who wrote this.</footer></body></html>"""


def test_main_text():
    assert html_mincut.main_text(ARTICLE) == "Head & line First paragraph, with words <here>. Short. Second paragraph goes on for a while, as they do."
    plain = "<body><div class='sidebar'><p>Popular posts, and things like that, all week.</p></div><div id='content'><p>This page has no article element, only a content block. It is prose.</p><p>So it stays.</p></div><ul class='menu'><li><a>Home</a></li></ul></body>"
    assert html_mincut.main_text(plain) == "This page has no article element, only a content block. It is prose. So it stays."
    for odd in (None, "", " ", "<", "<p", "<!--", "<script>", "</p></div>", "<article>", "&", "<a " * 3000, "<div>" * 5000, '<p class="x>y</p>'):
        assert isinstance(html_mincut.main_text(odd), str)
    assert html_mincut.main_text("<article><p>Cut off in the mid") == "Cut off in the mid"
    assert html_mincut.main_text(ARTICLE.replace("</article>", "").split("<section")[0]).startswith("Head & line First")


def test_extract_table(spark):
    rows = [(1, "u", ARTICLE), (1, "u", ARTICLE), (None, None, None), (2, "v", "")]
    got = html_mincut.extract(_pages(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((i, u, html_mincut.main_text(x), len(html_mincut.main_text(x))) for i, u, x in rows), key=repr)
    assert html_mincut.extract(_pages(spark, [])).collect() == []


def _distance(pattern, text):
    """Smallest edit distance of the pattern to any substring, and the first end that has it."""
    row = list(range(len(pattern) + 1))
    best = (len(pattern), 0)
    for e, c in enumerate(text, 1):
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i - 1] + (p != c), row[i] + 1, new[i - 1] + 1))
        row = new
        best = min(best, (row[-1], e))
    return best


def test_myers_against_the_table():
    rng = random.Random(5)
    for _ in range(400):
        pattern = "".join(rng.choice("abé") for _ in range(rng.randint(1, 90)))
        text = "".join(rng.choice("abé ") for _ in range(rng.randint(0, 120)))
        assert decontaminate.Myers(pattern).best(text) == _distance(pattern, text)


def _edit(rng, text, n):
    text = list(text)
    for _ in range(n):
        at = rng.randrange(len(text))
        kind = rng.random()
        if kind < 0.4:
            text[at] = rng.choice("abcxyz")
        elif kind < 0.7:
            del text[at]
        else:
            text.insert(at, rng.choice("abcxyz"))
    return "".join(text)


@pytest.mark.parametrize("block", [10**6, 150])
def test_contaminated_against_brute_force(spark, block):
    rng = random.Random(6)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta"]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([2, 8, 20])))) for i in range(8)] + [(90, None), (91, ""), (92, "  "), (3, "Repeated ID item")]
    docs = [(i, " ".join(rng.choices(words, k=30)) + "\n" + _edit(rng, rng.choice(items[:8])[1].upper(), rng.randint(0, 9)) + " \t" + " ".join(rng.choices(words, k=5)), None) for i in range(25)]
    docs += [(50, None, None), (51, "", None), (52, items[1][1], None), (52, items[1][1], None), (None, items[2][1], None)]
    bench = spark.createDataFrame([(i, t, 1, "d") for i, t in items], "item_id int, text string, doc_id long, block string")
    got = decontaminate.contaminated(h.table(spark, docs), bench, block_chars=block)
    expected = []
    for i, text, _ in docs:
        text = decontaminate.normal_text(text)
        for k, item in items:
            item = decontaminate.normal_text(item)
            if item and text:
                d, end = _distance(item, text)
                if d <= len(item) // 20:
                    expected.append((i, k, d, end))
    assert len(expected) > 20
    h.same(got, expected, "doc_id", "item_id", "distance", "end_pos")
    left = decontaminate.drop_contaminated(h.table(spark, docs), bench)
    assert {r.doc_id for r in left.collect()} == {i for i, _, _ in docs} - {x[0] for x in expected}
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(h.table(spark, docs), empty).collect() == [] and decontaminate.contaminated(h.table(spark, []), bench).collect() == []
