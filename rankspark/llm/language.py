"""Language identification by multilingual mixture inference (operator 1).

Each language is a distribution over hashed byte trigrams, learned from labelled documents. A
document is a mixture of languages plus a uniform background; expectation-maximisation estimates
the proportions, and the set of languages grows one by one while the penalised log-likelihood
(a BIC charge for each further proportion) improves.

The log-likelihood is concave in the proportions, so N * (max_k mean(p_k / p_l) - 1) bounds what
any mixture can gain over language l alone. Where that bound is below the charge for one further
language the single language is already the answer, and no iteration is needed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.llm.common import bounded, text_buffers

#: Trigram buckets, and labelled documents a language that the models are fitted on (expected).
BUCKETS = 1 << 16
SAMPLE_DOCS = 3000
MAX_LANGUAGES = 200
SMOOTHING = 0.5
#: Neighbouring trigrams share two bytes each, so they count as a third of a draw.
DRAWS_PER_GRAM = 1 / 3
ITERATIONS = 40
UNDETERMINED = "und"

_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of every row, and row offsets into them. ASCII other than
    letters counts as a space, runs of spaces as one, and each text as set in spaces."""
    n_rows = len(offsets) - 1
    plain = np.full(len(data) + n_rows, 32, np.uint8)  # a space before every row
    shift = np.repeat(np.arange(1, n_rows + 1), np.diff(offsets))
    plain[np.arange(len(data)) + shift] = _LETTERS[data]
    begins = offsets[:-1] + np.arange(n_rows)
    keep = np.ones(len(plain), bool)
    keep[1:] = (plain[1:] != 32) | (plain[:-1] != 32)
    keep[begins] = True
    count = np.zeros(len(plain) + 1, np.int64)
    np.cumsum(keep, out=count[1:])
    bounds = count[np.append(begins, len(plain))]
    text = plain[keep].astype(np.uint32)
    if len(text) < 3:
        return np.zeros(0, np.int32), np.zeros(n_rows + 1, np.int64)
    code = text[:-2] | text[1:-1] << 8 | text[2:] << 16
    with np.errstate(over="ignore"):
        buckets = ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int32)
    sizes = np.maximum(np.diff(bounds) - 2, 0)
    inside = np.ones(len(buckets), bool)
    for back in (1, 2):  # trigrams that would run into the next row
        at = bounds[1:] - back
        inside[at[(at >= 0) & (at < len(buckets))]] = False
    rows = np.zeros(n_rows + 1, np.int64)
    np.cumsum(sizes, out=rows[1:])
    return buckets[inside], rows


@dataclass
class LanguageModel:
    """languages, prior (share of documents), table (buckets x languages + background)."""

    languages: list[str]
    prior: np.ndarray
    table: np.ndarray

    def prepare(self):
        self.log = np.log(self.table).astype(np.float32)


def _counts(buckets_column: int = 1):
    def run(batches):
        held: dict[str, np.ndarray] = {}
        for b in bounded(batches, 1):
            grams, rows = trigrams(*text_buffers(b.column(1)))
            for i, lang in enumerate(b.column(0).to_pylist()):
                held.setdefault(lang, np.zeros(BUCKETS, np.int64))
                held[lang] += np.bincount(grams[rows[i]: rows[i + 1]], minlength=BUCKETS) if rows[i + 1] - rows[i] > 5000 else 0
                if rows[i + 1] - rows[i] <= 5000:
                    np.add.at(held[lang], grams[rows[i]: rows[i + 1]], 1)
        for lang, c in held.items():
            at = np.flatnonzero(c)
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], names=["lang", "bucket", "n"])

    return run


def held_out() -> F.Column:
    """Documents that are never learned from: crc32 of the doc_id as text, mod 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> LanguageModel:
    """Fit on an expected ``sample_docs`` documents of each language, chosen by a hash of their
    doc_id, out of those not held out. What comes to the driver is a row per language and bucket."""
    labelled = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(sizes)
    total = sum(sizes.values())
    table = np.full((BUCKETS, len(languages) + 1), SMOOTHING)
    if languages:
        million = 1_000_000
        share = F.lit(0)
        for lang in languages:
            share = F.when(F.col("lang") == lang, F.lit(min(million, int(np.ceil(million * sample_docs / sizes[lang]))))).otherwise(share)
        sample = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(million)) < share)
        counted = sample.select("lang", "text").mapInArrow(_counts(), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
        place = {x: i for i, x in enumerate(languages)}
        for r in counted.collect():
            table[r["bucket"], place[r["lang"]]] += r["n"]
    table /= table.sum(0)
    table[:, -1] = 1 / BUCKETS
    prior = np.array([sizes[x] / total for x in languages]) if languages else np.zeros(0)
    return LanguageModel(languages, prior, table)


def mixture(counts: np.ndarray, likelihood: np.ndarray, start: int) -> tuple[np.ndarray, float]:
    """Proportions over the columns of ``likelihood`` (distinct grams x components) that fit the
    counts, the set grown from column ``start`` by penalised likelihood; and the gain over
    ``start`` alone, in draws."""
    n = counts.sum()
    charge = 0.5 * np.log(max(2.0, n * DRAWS_PER_GRAM))
    chosen, theta = [start], np.array([1.0])
    total = likelihood[:, start]
    value = first = counts @ np.log(total)
    while len(chosen) < likelihood.shape[1]:
        slope = (counts / total) @ likelihood / n
        slope[chosen] = -np.inf
        best = int(slope.argmax())
        if n * (slope[best] - 1) * DRAWS_PER_GRAM <= charge:
            break
        wider = [*chosen, best]
        part = likelihood[:, wider]
        weight = np.append(theta * 0.9, 0.1)
        for _ in range(ITERATIONS):
            joint = part * weight
            mix = joint.sum(1)
            new = (counts / mix) @ joint / n
            moved = np.abs(new - weight).max()
            weight = new
            if moved < 1e-4:
                break
        mix = part @ weight
        reached = counts @ np.log(mix)
        if (reached - value) * DRAWS_PER_GRAM <= charge:
            break
        chosen, theta, total, value = wider, weight, mix, reached
    out = np.zeros(likelihood.shape[1])
    out[chosen] = theta
    return out, float((value - first) * DRAWS_PER_GRAM)


def _has_letter(text: str | None) -> bool:
    return text is not None and (any(map(str.isalpha, text[:200])) or any(map(str.isalpha, text[200:])))


def infer(column: pa.Array, model: LanguageModel) -> tuple[list[str], np.ndarray, np.ndarray, list[list]]:
    """Language, score, background share and the (language, proportion) list of every text."""
    k = len(model.languages)
    texts = column.to_pylist()
    langs, scores, background, mixes = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), [[] for _ in texts]
    if not k:
        return langs, scores, background, mixes
    grams, rows = trigrams(*text_buffers(column))
    sizes = np.diff(rows)
    full = np.flatnonzero(sizes > 0)
    singles = np.zeros((len(texts), k + 1))
    gains = np.full((len(texts), k + 1), np.inf)
    if len(full):
        singles[full] = np.add.reduceat(model.log[grams], rows[full], axis=0, dtype=np.float64)
        best = singles.argmax(1)
        chosen = np.repeat(best[full], sizes[full])
        ratio = np.exp(model.log[grams] - model.log[grams, chosen][:, None])
        gains[full] = np.add.reduceat(ratio, rows[full], axis=0, dtype=np.float64) - sizes[full, None]
    for i, text in enumerate(texts):
        if not _has_letter(text):
            continue
        n = int(sizes[i])
        start = int(singles[i].argmax()) if n else 0
        theta = np.zeros(k + 1)
        if n and gains[i].max() * DRAWS_PER_GRAM > 0.5 * np.log(max(2.0, n * DRAWS_PER_GRAM)):
            distinct, counts = np.unique(grams[rows[i]: rows[i + 1]], return_counts=True)
            theta, _ = mixture(counts.astype(np.float64), model.table[distinct], start)
        else:
            theta[start] = 1.0
        # a short text says little: its posterior under single languages tempers the score
        said = singles[i, :k] * DRAWS_PER_GRAM + np.log(model.prior)
        posterior = np.exp(said - said.max())
        posterior /= posterior.sum()
        lead = theta[:k] if theta[:k].sum() > 0 else posterior
        pick = int(posterior.argmax()) if (lead > 0).sum() <= 1 else int(lead.argmax())
        langs[i] = model.languages[pick]
        scores[i] = min(1.0, float(max(lead[pick], 1e-9) * (posterior[pick] if (lead > 0).sum() <= 1 else 1.0)))
        background[i] = theta[k]
        mixes[i] = [(model.languages[j], float(theta[j])) for j in np.argsort(-theta[:k]) if theta[j] > 0]
    return langs, scores, background, mixes


_MIX = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))


def identify(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Language of every row of ``docs`` (doc_id, text, lang; other columns are ignored).

    Returns doc_id, held_out, lang_pred (``und`` for null texts and texts without a letter),
    score, background (share of the text that fits no language better than chance) and mixture.
    Only text and non-null lang of documents that are not held out are learned from; without any
    every text is ``und``. Rows are judged alone, so null ids and repeated rows pass through; a
    null doc_id is not held out; no rows give no rows.
    """
    model = fit(docs, sample_docs)
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.prior, model.table))

    def run(batches):
        known = LanguageModel(*shared.value)
        known.prepare()
        for b in bounded(batches, 2):
            langs, scores, background, mixes = infer(b.column(2), known)
            mixes = [[{"lang": a, "share": s} for a, s in x] for x in mixes]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(scores), pa.array(background), pa.array(mixes, _MIX)], names=["doc_id", "held_out", "lang_pred", "score", "background", "mixture"])

    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, background double, mixture array<struct<lang:string,share:double>>")


def keep_known(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """The rows of ``docs`` with a language: not ``und``, and no more than half background. All
    columns are kept. Rows are judged alone and carried along, so neither null nor repeated ids
    matter."""
    model = fit(docs, sample_docs)
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.prior, model.table))
    text = docs.columns.index("text")

    def run(batches):
        known = LanguageModel(*shared.value)
        known.prepare()
        for b in bounded(batches, text):
            langs, _, background, _ = infer(b.column(text), known)
            yield b.filter(pa.array([x != UNDETERMINED and y <= 0.5 for x, y in zip(langs, background.tolist(), strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
