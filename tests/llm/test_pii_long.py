"""Personal data in long runs of numbers: no border, no quadratic rule."""

from __future__ import annotations

import random
import re
import time

import numpy as np
import pytest

from rankspark.llm import pii


def _plain_ips(text):
    out = []
    for m in pii.IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    return out


def test_ip_rule_equals_the_plain_pattern():
    rng = random.Random(1)
    for _ in range(400):
        text = "".join(rng.choices(["1", "25", "255", "256", "00", ".", ".", ".", " ", "a"], k=rng.randint(1, 40)))
        assert [s for s in pii.base_spans(text) if s[0] == "ip"] == _plain_ips(text), text


@pytest.mark.parametrize("text", ["7" * 2**20, "0" * 2**20 + ".1.1.1", "1." * 2**19])
def test_a_megabyte_of_digits_takes_seconds(text):
    began = time.time()
    pii.base_spans(text)
    assert time.time() - began < 20
    assert ("ip", 0, 2**20 + 6) in pii.base_spans("0" * 2**20 + ".1.1.1")


def test_a_region_is_searched_across_its_blocks():
    rng = np.random.default_rng(2)
    weights = rng.normal(size=(len(pii.KINDS), pii.N_FEATURES))
    text = " ".join(str(x) for x in rng.integers(0, 99999, 160)) + " call (030) 123 4567 now"
    (tokens,) = pii.regions(text)
    whole = pii.viterbi(len(tokens), pii.candidates(text, tokens), weights)
    assert whole
    for block in (1, 7, 50, 400):
        assert pii.decode(text, tokens, weights, block) == whole


def test_an_added_span_behind_token_401():
    numbers = " ".join(str(x % 10) for x in range(397))
    text = f"{numbers} 555 mail bob [at] corp [dot] org now"
    (tokens,) = pii.regions(text)
    assert len(tokens) > 401
    at = next(i for i, (a, _) in enumerate(tokens) if text[a:].startswith("bob"))
    assert at < 401 < at + 9  # the old border lay inside the span
    weights = np.zeros((len(pii.KINDS), pii.N_FEATURES))
    weights[:, -1] = -9.0
    weights[0, 1] = 20.0  # the spelled-out email shape
    spans = pii.added_spans(text, [], weights)
    assert [(k, text[a:b]) for k, a, b in spans] == [("email", "bob [at] corp [dot] org")]
    assert re.search("bob", text)


def test_the_sample_is_the_first_by_hash_however_it_is_cut(spark, monkeypatch):
    from pyspark.sql import functions as F

    seen = []
    monkeypatch.setattr(pii, "fit_weights", lambda texts: seen.append(texts))
    docs = spark.createDataFrame([(f"text {i}",) for i in range(300)] + [("copy 1",)] * 2000 + [("none",), (None,)], "text string").repartition(7)
    want = [r.text for r in docs.where(F.col("text").rlike("[0-9@]")).orderBy(F.xxhash64("text"), "text").limit(40).collect()]
    pii.fit(docs, 40)
    pii.fit(docs.where("text LIKE 'text%'"), 40)
    pii.fit(docs.where("false"), 40)
    assert seen[0] == want and len(seen[1]) == 40 and seen[2] == []
