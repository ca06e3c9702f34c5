"""Brute-force versions of the text operators and an awkward little table."""

from __future__ import annotations

import hashlib
import random
import re

WS = re.compile(r"[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, doc long, node long, n long, version string, kept string, recipe string, h1 long, component string, bucket string, runs string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LOWEST = -(2**63)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def table(spark, rows, parts: int = 3):
    """A documents table with extra columns whose names the operators use inside."""
    full = [(i, t, lang, 1, 2, 3, "v", "k", "r", 4, "c", "b", "x") for i, t, lang in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts) if full else spark.createDataFrame([], SCHEMA)


def corpus(seed: int = 5, n: int = 60) -> list[tuple]:
    """Originals, exact and near copies, shared passages and lines, and odd rows."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["Été", "ñandú", "The", "the"]
    passage = " ".join(rng.choices(vocab, k=30))
    line = "This very common line is shared By Many documents"
    texts: list[str | None] = []
    for _ in range(n):
        kind = rng.random()
        real = [t for t in texts if t]
        if kind < 0.35 or not real:
            words = rng.choices(vocab, k=rng.choice([3, 8, 40, 120]))
        else:
            words = rng.choice(real).split(" ")
            for _ in range(0 if kind < 0.5 else rng.randint(1, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
        text = " ".join(words)
        if rng.random() < 0.3:
            text += " " + passage
        if rng.random() < 0.4:
            text = text + "\n  " + (line.upper() if rng.random() < 0.3 else line) + rng.choice(["", " ", "\t"]) + "\nend"
        texts.append(text)
    texts += [None, "", "", " \t\n ", "one", "x" * 3000, "a b " * 2000, "\n" * 50, "no-break space and 　wide", "😀 " * 40]
    ids = rng.sample(range(1, 10_000), len(texts))
    rows = [(i, t, rng.choice(["en", "fr", None])) for i, t in zip(ids, texts, strict=True)]
    rows += [rows[0], rows[0], rows[3]]  # repeated rows
    rows += [(None, rows[1][1], "en"), (None, None, None)]
    rng.shuffle(rows)
    return rows


def exact_groups(rows):
    norm = [WS.sub(" ", t or "") for _, t, _ in rows]
    out = []
    for (i, _, _), x in zip(rows, norm, strict=True):
        group = [r[0] for r, y in zip(rows, norm, strict=True) if x == y]
        keep = min((g for g in group if g is not None), default=None)
        out.append((i, keep, len(group), i == keep, sha(x)))
    return out


def dedup_lines(rows):
    holders: dict[str, set] = {}
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOW)
    for i, t, _ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(LOWEST if i is None else i)
    out = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        me = LOWEST if i is None else i
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= 3 and me != max(holders[key(x)]))]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def words_of(text):
    return [w for w in WS.split(text or "") if w]


def dedup_substrings(rows, window: int = 13):
    first: dict[tuple, int] = {}
    for i, t, _ in rows:
        w, me = words_of(t), LOWEST if i is None else i
        for p in range(len(w) - window + 1):
            k = tuple(w[p: p + window])
            first[k] = min(first.get(k, me), me)
    out = []
    for i, t, _ in rows:
        w, me = words_of(t), LOWEST if i is None else i
        gone: set[int] = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p: p + window])] < me:
                gone |= set(range(p, p + window))
        out.append((i, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    return out


def near_groups(rows, shingle: int = 5, percent: int = 85):
    def shingles(t):
        w = words_of((t or "").translate(LOW))
        return {tuple(w[p: p + shingle]) for p in range(max(1, len(w) - shingle + 1))} if w else set()

    sets = [shingles(t) for _, t, _ in rows]
    parent = {i: i for i, _, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            i, j = rows[a][0], rows[b][0]
            if None not in (i, j) and sets[a] and sets[b]:
                if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    lo, hi = sorted((find(i), find(j)))
                    parent[hi] = lo
    return [(i, len(s), None if i is None else find(i), i is None or find(i) == i) for (i, _, _), s in zip(rows, sets, strict=True)]


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def same(df, expected, *columns):
    assert rows_of(df, *columns) == sorted(expected, key=repr)
