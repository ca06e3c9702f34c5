"""Personal data by rules and a semi-Markov conditional random field (operator 3).

The rules give the base spans (email, ip, card, phone). A semi-Markov CRF then reads the regions
around digits and at-signs: a candidate segment of up to MAX_SEGMENT tokens is scored as a whole
(shape, digit count, checksum, borders, words before it), and dynamic programming over segment
ends chooses boundaries and types together; everything else is single-token background. Its
segments are added where they touch no base span.

The weights are fitted here by maximum likelihood on a bounded sample: regions of at most
TRAIN_DOCS documents, labelled by the rules, once as they are and once with spans rewritten as
people write them when they evade rules ("name [at] host [dot] org", phones without the plus).
"""

from __future__ import annotations

import math
import re
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.llm.common import bounded

KINDS = ("email", "ip", "card", "phone")
#: Longest entity in tokens, tokens of context beside a trigger, documents to fit on.
MAX_SEGMENT = 17
CONTEXT = 3
#: Tokens whose segments are scored at once; the search goes on over the border of such blocks.
BLOCK_TOKENS = 400
#: Longest region, in tokens, that the field is fitted on.
TRAIN_TOKENS = 400
TRAIN_DOCS = 250
TRAIN_REGIONS = 600
#: Times the sample's rows that the bound on their hashes should let through.
SAMPLE_ROOM = 4

#: The rules of the contract.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# A match can only start where a run of digits starts: what follows a run decides for all its places.
_IP_AT_RUN = re.compile(r"(?<![0-9])" + IP.pattern)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile(r"[0-9]")
_TRIGGER = re.compile(r"[0-9@]|[\[({]\s?(?:at|dot)\s?[\])}]", re.I)
_TOKEN = re.compile(r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]")
_DOT = r"(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?)"
_SHAPES = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    re.compile(rf"[A-Za-z0-9._%+-]+(?:{_DOT}[A-Za-z0-9_%+-]+)*\s?(?:@|[\[({{]\s?at\s?[\])}}])\s?[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,}}", re.I),
    re.compile(r"(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"),
    re.compile(r"[0-9]+(?:\.[0-9]+){3}"),
    re.compile(r"[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}"),
    re.compile(r"[0-9]{13,19}"),
    re.compile(r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,3}"),
    re.compile(r"(?:[0-9]{1,3}[ .-])?\([0-9]{2,4}\) ?[0-9]{3,4}[ .-][0-9]{3,4}"),
    re.compile(r"[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}"),
    re.compile(r"[0-9]+"),
    re.compile(r"[0-9]+(?:\.[0-9]+)+"),
    re.compile(r"[A-Za-z0-9_]*[A-Za-z_][A-Za-z0-9_]*"),
]
_CUE = re.compile(r"(?:tel|phone|call|mobile|fax|cell|handy|e-?mail|mail|card|visa|ip|host|server)\W*$", re.I)
N_FEATURES = len(_SHAPES) + 12
LABELS = ("background", *KINDS)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The rules' spans by kind, then start; matches that fail their test are dropped."""
    found: list[tuple[str, int, int]] = []
    if "@" in text:
        # a match needs an at-sign with a local part right before it, so matching starts there
        done = 0
        at = text.find("@")
        while at >= 0:
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            m = EMAIL.match(text, start) if start < at else None
            if m:
                found.append(("email", start, m.end()))
                done = m.end()
            at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        for m in _IP_AT_RUN.finditer(text):
            if all(len(x) <= 3 and int(x or "0") <= 255 for x in (y.lstrip("0") for y in m[0].split("."))):
                found.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                    found.append(("phone", *m.span()))
    return found


def regions(text: str, most: int | None = None) -> list[list[tuple[int, int]]]:
    """Token spans (start, end) of the stretches around digits, at-signs and spelled-out signs, as
    long as they are, or cut behind ``most`` tokens."""
    out: list[list[tuple[int, int]]] = []
    end = 0
    for m in _TRIGGER.finditer(text):
        if m.start() < end:
            continue
        # a bounded look around the trigger: some tokens before, and on while triggers follow
        left = max(end, m.start() - 80)
        before = [(left + t.start(), left + t.end()) for t in _TOKEN.finditer(text[left: m.start()])][-CONTEXT - 6:]
        if before and before[-1][1] == m.start() and text[m.start()].isalnum():
            start = before.pop()[0]
        else:
            start = m.start()
        tokens, quiet = before, 0
        for t in _TOKEN.finditer(text, start):
            tokens.append(t.span())
            quiet = 0 if _DIGIT.search(t[0]) or t[0] in "@[({" else quiet + 1
            if quiet > CONTEXT + 3 or (most is not None and len(tokens) > most):
                break
        end = tokens[-1][1]
        out.append(tokens)
    return out


def candidates(text: str, tokens: list[tuple[int, int]], lo: int = 0, hi: int | None = None) -> list[tuple[int, int, np.ndarray]]:
    """Segments (first token, end token) that may be entities, with their feature vectors: they
    start at a word or one of + ( and end at a word or ), and hold a digit or an at-sign form.
    ``lo`` and ``hi`` bound the first token."""
    out = []
    n = len(tokens)
    hi = n if hi is None else min(hi, n)
    word = {lo + k: text[a].isalnum() or text[a] == "_" for k, (a, _) in enumerate(tokens[lo: hi + MAX_SEGMENT])}
    for i in range(lo, hi):
        first = text[tokens[i][0]]
        if not (word[i] or first in "+("):
            continue
        if i and tokens[i - 1][1] == tokens[i][0] and text[tokens[i][0] - 1] in "._%+-" and word[i]:
            attached = 1.0
        else:
            attached = 0.0
        for j in range(i + 1, min(n, i + MAX_SEGMENT) + 1):
            a, b = tokens[i][0], tokens[j - 1][1]
            if j - i > 1 and tokens[j - 1][0] - tokens[j - 2][1] > 1:
                break
            if not (word[j - 1] or text[b - 1] == ")"):
                continue
            piece = text[a:b]
            if not _TRIGGER.search(piece):
                continue
            out.append((i, j, _features(text, a, b, piece, j - i, attached)))
    return out


def _features(text: str, a: int, b: int, piece: str, size: int, attached: float) -> np.ndarray:
    x = np.zeros(N_FEATURES)
    for k, shape in enumerate(_SHAPES):
        x[k] = shape.fullmatch(piece) is not None
    digits = "".join(_DIGIT.findall(piece))
    n = len(digits)
    at = len(_SHAPES)
    x[at: at + 12] = (
        13 <= n <= 19 and luhn(digits),
        13 <= n <= 19,
        9 <= n <= 12,
        n < 7,
        piece[0] == "+",
        a == 0 or text[a - 1].isspace(),
        b == len(text) or text[b].isspace() or text[b] in ".,;:!?)",
        attached,
        b < len(text) and text[b] in "._%+-@" and b + 1 < len(text) and text[b + 1].isalnum(),
        _CUE.search(text, max(0, a - 16), a) is not None,
        size / MAX_SEGMENT,
        1.0,
    )
    return x


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(x - top) for x in values))


def _posterior_logs(n: int, bounds: list[tuple[int, int]], potentials: list[float]) -> list[float]:
    """Forward-backward over segment ends: per segment the log of forward * backward / total.
    ``potentials`` are the segments' scores summed over kinds; background tokens score zero."""
    ends: list[list[int]] = [[] for _ in range(n + 1)]
    starts: list[list[int]] = [[] for _ in range(n + 1)]
    for s, (i, j) in enumerate(bounds):
        ends[j].append(s)
        starts[i].append(s)
    forward, backward = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):
        forward[j] = _log_sum([forward[j - 1], *(forward[bounds[s][0]] + potentials[s] for s in ends[j])]) if ends[j] else forward[j - 1]
    for i in range(n - 1, -1, -1):
        backward[i] = _log_sum([backward[i + 1], *(backward[bounds[s][1]] + potentials[s] for s in starts[i])]) if starts[i] else backward[i + 1]
    return [forward[i] + backward[j] - forward[n] for i, j in bounds]


def _scored(segments, weights: np.ndarray):
    """(first token, end token, best kind, its score) of every segment."""
    if not segments:
        return []
    scores = np.array([x for _, _, x in segments]) @ weights.T
    kinds = scores.argmax(1)
    return [(i, j, int(k), float(row[k])) for (i, j, _), k, row in zip(segments, kinds, scores, strict=True)]


def _search(n: int, blocks) -> list[tuple[int, int, int]]:
    """The best segmentation's entities. ``blocks``: (hi, scored segments whose first token lies below
    hi and not in an earlier block), in order; what is kept per token is one number and, where an
    entity ends, its start and kind."""
    best, back = [0.0] * (n + 1), {}
    ends: dict[int, list[tuple[int, int, float]]] = {}
    done = 0
    for hi, scored in blocks:
        for i, j, k, score in scored:
            ends.setdefault(j, []).append((i, k, score))
        for j in range(done + 1, hi + 1):
            best[j] = best[j - 1]
            for i, k, score in ends.pop(j, ()):
                if best[i] + score > best[j]:
                    best[j], back[j] = best[i] + score, (i, k)
        done = hi
    out, j = [], n
    while j:
        if j not in back:
            j -= 1
        else:
            i, k = back[j]
            out.append((i, j, k))
            j = i
    return out[::-1]


def viterbi(n: int, segments, weights: np.ndarray) -> list[tuple[int, int, int]]:
    """The best segmentation's entities (first token, end token, kind index)."""
    return _search(n, [(n, _scored(segments, weights))])


def decode(text: str, tokens: list[tuple[int, int]], weights: np.ndarray, block: int = BLOCK_TOKENS) -> list[tuple[int, int, int]]:
    """``viterbi`` over a region of any length: segments are made and scored block by block, and the
    search carries its state on, so entities lie across block borders like anywhere else."""
    n = len(tokens)
    bounds = [(lo, min(lo + block, n)) for lo in range(0, n, block)]
    return _search(n, ((hi, _scored(candidates(text, tokens, lo, hi), weights)) for lo, hi in bounds))


def evade(text: str, spans: list[tuple[str, int, int]]) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with its emails and phones rewritten, and the spans in the new text."""
    parts, out, at, size = [], [], 0, 0
    for kind, a, b in sorted(spans, key=lambda s: s[1:]):
        if a < at:
            continue
        piece = text[a:b]
        if kind == "email":
            user, _, host = piece.partition("@")
            style = (a + b) % 3
            piece = f"{user} [at] {host.replace('.', ' [dot] ')}" if style == 0 else f"{user}(at){host.replace('.', '(dot)')}" if style == 1 else f"{user} (at) {host}"
        elif kind == "phone":
            piece = piece[piece.find("("):] if "(" in piece else piece[1:]
        parts += [text[at:a], piece]
        size += a - at
        out.append((kind, size, size + len(piece)))
        size += len(piece)
        at = b
    return "".join(parts) + text[at:], out


def training_regions(texts: list[str]):
    """(tokens, candidate segments, gold entities) for the rules' labels and their rewritings."""
    for text in texts:
        spans = base_spans(text)
        for body, gold in ((text, spans), evade(text, spans)):
            for tokens in regions(body, TRAIN_TOKENS):
                starts = {a: i for i, (a, _) in enumerate(tokens)}
                stops = {b: i + 1 for i, (_, b) in enumerate(tokens)}
                inside = [(k, a, b) for k, a, b in gold if a < tokens[-1][1] and b > tokens[0][0]]
                known = [(starts[a], stops[b], KINDS.index(k)) for k, a, b in inside if a in starts and b in stops]
                if len(known) < len(inside) or any(x[1] > y[0] for x, y in pairwise(sorted(known))):
                    continue
                segments = candidates(body, tokens)
                if {x[:2] for x in known} <= {x[:2] for x in segments}:
                    yield tokens, segments, known


def fit_weights(texts: list[str], rounds: int = 150, rate: float = 0.5, decay: float = 2e-4) -> np.ndarray:
    """Maximum-likelihood weights (kinds x features) by gradient ascent with adaptive steps.
    Without any training region the weights are such that nothing is added."""
    weights = np.zeros((len(KINDS), N_FEATURES))
    weights[:, -1] = -4.0
    data = []
    for x in training_regions(texts):
        data.append(x)
        if len(data) >= TRAIN_REGIONS:
            break
    if not any(known for _, _, known in data):
        weights[:, -1] = -50.0
        return weights
    # one matrix of all segments; the gold part of the gradient is fixed
    features = np.concatenate([np.array([x for _, _, x in segments]).reshape(-1, N_FEATURES) for _, segments, _ in data])
    gold = np.zeros_like(weights)
    for _, segments, known in data:
        place = {(i, j): x for i, j, x in segments}
        for i, j, k in known:
            gold[k] += place[i, j]
    seen = np.full_like(weights, 1e-6)
    for _ in range(rounds):
        scores = features @ weights.T
        potentials = np.logaddexp.reduce(scores, axis=1).tolist()
        around: list[float] = []
        for tokens, segments, _ in data:
            at = len(around)
            around += _posterior_logs(len(tokens), [x[:2] for x in segments], potentials[at: at + len(segments)])
        posterior = np.exp(scores + np.array(around)[:, None])
        slope = gold - posterior.T @ features - decay * weights * len(data)
        seen += slope**2
        weights += rate * slope / np.sqrt(seen)
    return weights


def added_spans(text: str, base: list[tuple[str, int, int]], weights: np.ndarray) -> list[tuple[str, int, int]]:
    """Entities of the random field that touch no base span."""
    if not _TRIGGER.search(text):
        return []
    taken = sorted((a, b) for _, a, b in base)
    out = []
    for tokens in regions(text):
        lo, hi = tokens[0][0], tokens[-1][1]
        near = [(a, b) for a, b in taken if a < hi and b > lo]
        for i, j, k in decode(text, tokens, weights):
            a, b = tokens[i][0], tokens[j - 1][1]
            if all(b <= x or a >= y for x, y in near):
                out.append((KINDS[k], a, b))
    return out


def _written(spans: list[tuple[str, int, int]]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(set(spans), key=lambda s: (order[s[0]], s[1], s[2])))


_SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> np.ndarray:
    """Fit on the first ``train_docs`` documents, in the order of a hash of their text, that hold
    a digit or an at-sign: a bounded sample, the same for any partitioning.

    The documents are counted first, and only hashes below a bound that some times as many rows
    should meet are ordered, so a task sends the driver its few rows of the sample and not a full
    sample each. If copies leave too few below the bound, all are ordered; the sample is the same."""
    fits = docs.select("text").where(F.col("text").rlike("[0-9@]")).withColumn("h", F.xxhash64("text"))
    rows = fits.count()
    below = -(2**63) + min(2**64 - 1, 2**64 * SAMPLE_ROOM * train_docs // max(1, rows))

    def first(some: DataFrame) -> list[str]:
        return [r.text for r in some.orderBy("h", "text").limit(train_docs).collect()]

    sample = first(fits.where(F.col("h") <= F.lit(below)))
    if len(sample) < min(train_docs, rows):
        sample = first(fits)
    return fit_weights(sample)


def find(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """Personal data of every row of ``docs`` (doc_id, text; other columns are ignored).

    Returns doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256 (of kind:start:end,
    comma-joined), spans (base and added ones, written alike) and n_added. Null counts as empty
    and has no spans. Rows are worked on alone, so null ids and repeated rows pass through; no
    rows give no rows.
    """
    weights = fit(docs, train_docs)

    def run(batches):
        import hashlib

        for b in bounded(batches, 1):
            rows: list[list] = [[] for _ in range(7)]
            for text in b.column(1).to_pylist():
                base = base_spans(text) if text else []
                more = added_spans(text, base, weights) if text else []
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                values = [*counts, hashlib.sha256(_written(base).encode()).hexdigest(), _written(base + more), len(set(more))]
                for column, value in zip(rows, values, strict=True):
                    column.append(value)
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.record_batch([b.column(0), *(pa.array(x, t) for x, t in zip(rows, types, strict=True))], names=[x.split()[0] for x in _SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, _SCHEMA)
