"""Phrase collocation mining with counting quotient filters.

1. Words are counted per language; the frequent ones get numbers (a phrase is no more frequent than
   any of its words).
2. The text is written once as runs of word numbers, broken where a piece ends or a word is rare.
3. Every task counts its n-grams in quotient filters (``quotient_filter``), one per part of the
   permuted key; the sorted filters of a part are merged, and frequent n-grams are read back out of
   the merged filter. Longer n-grams are counted only where all their word pairs are frequent, as a
   bit map of bounded size tells; its false hits cost time, not exactness.
4. Scores, cuts and the containment rule are joins over the frequent phrases.

A dictionary of more than ``DICTIONARY_BYTES`` is not sent to the tasks: then a word's number is its
64-bit hash, proven free of collisions over all counted words, and the filters' keys are wider.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankspark.llm import quotient_filter as qf
from rankspark.llm.common import Lookup, chunks, equal_spans, gather, lower_ascii, materialize, mix64, runs, shuffle_width, text_buffers, word_hashes

#: Bytes of frequent words that are broadcast at most.
DICTIONARY_BYTES = 64 * 2**20
#: Bits of a bit map of frequent words or word pairs: 16 a key, at most this many (32 MB).
MAP_BITS = 2**28
#: n-grams of one length that a part of the permuted keys holds, about: what one merge works on.
PART_ENTRIES = 1_500_000
#: Distinct n-grams that a task keeps before it sends its filters.
TASK_ENTRIES = 4_000_000

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[list(b".,;:!?\x0a\x0b\x0c\x0d")] = True
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t")] = True


def _words(column, langs):
    """In bounded chunks: lower-cased bytes, separators before each byte, word starts and ends, the
    row of each word, its language code and a hash of language and word."""
    data, offsets = text_buffers(column)
    solid = ~(_SEPARATOR[data] | _BLANK[data])
    salt = mix64(np.asarray(langs, np.uint64) + np.uint64(1))
    for a, b, inside in chunks(solid, offsets):
        starts, ends, first = runs(solid[a:b], inside)
        rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
        low = lower_ascii(data[a:b])
        yield a, low, np.cumsum(_SEPARATOR[low]), starts, ends, rows, word_hashes(low, starts, ends), salt


def _lang(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))


def _lang_hash(names: list[str]) -> np.ndarray:
    """A code per language name that every task computes alike."""
    data, offsets = text_buffers(pa.array(["l" + x for x in names], pa.string()))
    return word_hashes(data, offsets[:-1], offsets[1:])


def count_words(docs: DataFrame) -> DataFrame:
    """lang, word, hash (of both), f: how often each word stands in the texts of each language."""

    def count(batches):
        for batch in batches:
            lang = batch.column(1).dictionary_encode()
            names = lang.dictionary.to_pylist()
            code = lang.indices.to_numpy().astype(np.int64)
            for _, low, _, starts, ends, rows, hashes, salt in _words(batch.column(0), _lang_hash(names)):
                if not len(starts):
                    continue
                of = code[rows]
                keys = mix64(hashes ^ salt[of])
                key, first, back, total = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
                lead, size = first[back], ends - starts
                alike = (size == size[lead]) & (of == of[lead])
                if not (alike.all() and equal_spans(low, starts, low, starts[lead], size).all()):
                    exact: dict = {}
                    raw = low.tobytes()
                    for i, (o, s, e) in enumerate(zip(of.tolist(), starts.tolist(), ends.tolist(), strict=True)):
                        exact.setdefault((o, raw[s:e]), [i, 0])[1] += 1
                    first, total = (np.array(x, np.int64) for x in zip(*exact.values(), strict=True))
                    key = keys[first]
                at = np.concatenate([[0], np.cumsum(size[first])]).astype(np.int64)
                word = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(at), pa.py_buffer(gather(low, starts[first], size[first]).tobytes())])
                yield pa.record_batch(
                    [lang.dictionary.take(pa.array(of[first])), word.cast(pa.string()), pa.array(key.view(np.int64)), pa.array(total.astype(np.int64))],
                    names=["lang", "word", "hash", "f"])

    got = _lang(docs).mapInArrow(count, "lang string, word string, hash long, f long")
    return got.groupBy("lang", "word", "hash").agg(F.sum("f").alias("f"))


class _Dense:
    """Numbers 1, 2, ... of a dictionary's (language, word) pairs; 0 for all other words."""

    def __init__(self, lang: list[str], word: pa.Array):
        coded = word.dictionary_encode()
        self.words, self.langs = coded.dictionary, {x: i for i, x in enumerate(dict.fromkeys(lang))}
        pair = np.array([self.langs[x] for x in lang], np.int64) * len(self.words) + coded.indices.to_numpy()
        self.order = np.argsort(pair)
        self.pair = pair[self.order]
        self.bits, self.kind = max(1, int(len(lang)).bit_length()), "<u4"

    def open(self):
        known, size = Lookup(self.words), len(self.words)

        def number(names, code, low, starts, ends, rows, hashes, salt):
            of = np.array([self.langs.get(x, -1) for x in names], np.int64)[code[rows]]
            word = known.find(low, starts, ends, hashes)
            pair = np.where((of >= 0) & (word >= 0), of * size + word, -1)
            at = np.minimum(np.searchsorted(self.pair, pair), len(self.pair) - 1)
            return np.where(self.pair[at] == pair, self.order[at] + 1, 0)

        return number


class _Wide:
    """The 64-bit hash of (language, word) as its number; rare words, by a bit map, count as 0."""

    def __init__(self, often):
        self.often, self.bits, self.kind = often, 64, "<u8"

    def open(self):
        def number(names, code, low, starts, ends, rows, hashes, salt):
            keys = mix64(hashes ^ salt[code[rows]])
            return np.where(_marked(self.often, [keys]), keys, np.uint64(0))

        return number


def _spot(lanes: list[np.ndarray], bits: int) -> np.ndarray:
    """Place of a tuple of numbers in a bit map of 2 ** bits bits."""
    with np.errstate(over="ignore"):
        acc = np.zeros(len(lanes[0]), np.uint64)
        for lane in lanes:
            acc = mix64(acc * np.uint64(3) + lane.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))
    return (acc >> np.uint64(64 - bits)).astype(np.int64)


def _marked(bit_map: np.ndarray, lanes: list[np.ndarray]) -> np.ndarray:
    spot = _spot(lanes, (len(bit_map) * 64).bit_length() - 1)
    return (bit_map[spot >> 6] >> (spot & 63).astype(np.uint64)) & np.uint64(1) == 1


def bit_map(grams: DataFrame, rows: int, most: int = MAP_BITS) -> np.ndarray:
    """A bit map over column ``ids`` (array<long>). Words of 64 bits are put together by Spark; the
    driver gets the bit map, never the keys."""
    bits = min(max(64, 16 * rows), most).bit_length() - 1

    def spots(batches):
        for batch in batches:
            ids = batch.column(0)
            lanes = ids.flatten().to_numpy().view(np.uint64).reshape(len(ids), -1) if len(ids) else np.zeros((0, 1), np.uint64)
            spot = _spot(list(lanes.T), bits)
            yield pa.record_batch([pa.array(spot >> 6), pa.array((np.uint64(1) << (spot & 63).astype(np.uint64)).view(np.int64))], names=["at", "bit"])

    got = grams.select("ids").mapInArrow(spots, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[got.column("at").to_numpy()] = got.column("bit").to_numpy().view(np.uint64)
    return out


def encode_runs(docs: DataFrame, numbers) -> DataFrame:
    """ids (binary), n, lead: the texts as word numbers, 0 where a piece ends or a word is unknown.
    A row that goes on inside a piece of the row before it starts with the last ``lead`` numbers of
    that row."""

    def encode(batches):
        coder = numbers.value
        number = coder.open()
        for batch in batches:
            lang = batch.column(1).dictionary_encode()
            names, code = lang.dictionary.to_pylist(), lang.indices.to_numpy().astype(np.int64)
            data, _ = text_buffers(batch.column(0))
            tail, last_row, last_end = np.zeros(0, coder.kind), -1, 0
            for base, low, before, starts, ends, rows, hashes, salt in _words(batch.column(0), _lang_hash(names)):
                if not len(starts):
                    continue
                got = number(names, code, low, starts, ends, rows, hashes, salt)
                new = np.ones(len(starts), bool)
                new[1:] = (rows[1:] != rows[:-1]) | (before[starts[1:]] != before[starts[:-1]])
                goes_on = rows[0] == last_row and not _SEPARATOR[data[last_end: base + starts[0]]].any()
                new[0] = not goes_on
                place = np.arange(len(got)) + np.cumsum(new)
                out = np.zeros(place[-1] + 1, coder.kind)
                out[place] = got
                out = out[(out != 0) | np.append(True, out[:-1] != 0)]
                lead = tail if goes_on else tail[:0]
                full = np.concatenate([lead, out])
                gaps = np.flatnonzero(full == 0)
                tail = full[max(len(full) - LONGEST + 1, gaps[-1] + 1 if len(gaps) else 0):]
                last_row, last_end = rows[-1], base + ends[-1]
                yield pa.record_batch([pa.array([full.tobytes()], pa.binary()), pa.array([len(full)], pa.int64()), pa.array([len(lead)], pa.int32())], names=["ids", "n", "lead"])

    return _lang(docs).mapInArrow(encode, "ids binary, n long, lead int")


#: Words of the longest phrase; rows of word numbers overlap by one less.
LONGEST = 5


def count_grams(coded: DataFrame, lengths: list[int], bits: int, kind: str, part_bits: int, least: int, pairs=None) -> DataFrame:
    """k, ids (array<long>), f of the n-grams of these lengths that occur ``least`` times or more.
    ``pairs``: a broadcast bit map; n-grams with an unmarked pair of neighbours are passed over."""

    def count(batches):
        counters = {k: qf.Counter(k, bits) for k in lengths}

        def send():
            sent = [(k, *f) for k, c in counters.items() for f in c.filters(part_bits)]
            for k in lengths:
                counters[k] = qf.Counter(k, bits)
            for group in itertools.batched(sent, 64):
                k, part, _, blob = zip(*group, strict=True)
                yield pa.record_batch([pa.array(k, pa.int32()), pa.array(part, pa.int64()), pa.array(blob, pa.binary())], names=["k", "part", "filter"])

        for batch in batches:
            for raw, lead in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(raw.as_buffer(), kind)
                linked = (ids[:-1] != 0) & (ids[1:] != 0)
                if pairs is not None:
                    some = np.flatnonzero(linked)
                    linked[some] = _marked(pairs.value, [ids[some], ids[some + 1]])
                fits = linked.copy()
                for k in range(2, LONGEST + 1):
                    if k > 2:
                        fits = fits[:-1] & linked[k - 2:]
                    if k in counters:
                        at = np.flatnonzero(fits)
                        at = at[at + k > lead]  # those that end before were counted with the row before
                        counters[k].add([ids[at + j] for j in range(k)])
                if sum(map(len, counters.values())) > TASK_ENTRIES:
                    yield from send()
        yield from send()

    def merge(key, batches):
        merged = qf.Counter(key[0].as_py(), bits)
        for batch in batches:
            for blob in batch.column(2):
                merged.merge(*qf.decode(blob.as_buffer()))
        lanes, f = merged.grams(least)
        flat = np.stack(lanes, 1).reshape(-1).view(np.int64)
        ids = pa.ListArray.from_arrays(pa.array(np.arange(len(f) + 1, dtype=np.int32) * merged.k), pa.array(flat))
        yield pa.record_batch([pa.array(np.full(len(f), merged.k, np.int32)), ids, pa.array(f)], names=["k", "ids", "f"])

    filters = coded.select("ids", "lead").mapInArrow(count, "k int, part long, filter binary")
    return filters.groupBy("k", "part").applyInArrow(_by_key(merge), "k int, ids array<long>, f long")


def _by_key(fn):
    """With the annotations by which Spark knows the iterator form."""
    from collections.abc import Iterator

    fn.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return fn


def frequent_phrases(docs: DataFrame, least: int = 100, dictionary_bytes: int = DICTIONARY_BYTES) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases of 1 to 5 words with f >= ``least``, and (lang, n)
    of all languages with words."""
    spark = docs.sparkSession
    words = materialize(count_words(docs), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    often = words.where(F.col("f") >= least)
    rows, size = often.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("word") + F.octet_length("lang") + 32), F.lit(0))).first()
    if size <= dictionary_bytes:
        local = often.select("lang", "word").toArrow().combine_chunks()
        coder = _Dense(local.column("lang").to_pylist(), local.column("word").combine_chunks()) if rows else None
        names = spark.createDataFrame(local.append_column("id", pa.array(np.arange(1, rows + 1)))) if rows else None
    else:
        if not words.groupBy("hash").count().where("count > 1 OR hash = 0").isEmpty():
            raise ValueError("two words share a 64-bit hash: raise dictionary_bytes")
        names = often.select("lang", "word", F.col("hash").alias("id"))
        coder = _Wide(bit_map(names.select(F.array("id").alias("ids")), rows))
    single = often.select("lang", F.col("word").alias("phrase"), F.array("word").alias("words"), "f")
    if coder is None:
        return single, totals
    coded = materialize(encode_runs(docs, spark.sparkContext.broadcast(coder)), "runs")
    total = coded.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    part_bits = min(max(0, -(-total // PART_ENTRIES) - 1).bit_length(), 2 * coder.bits, 30)
    pairs = materialize(count_grams(coded, [2], coder.bits, coder.kind, part_bits, least), "pairs")
    marked = spark.sparkContext.broadcast(bit_map(pairs, pairs.count()))
    longer = count_grams(coded, [3, 4, 5], coder.bits, coder.kind, part_bits, least, marked)
    grams = materialize(pairs.unionByName(longer), "grams")
    # the words of an n-gram come back by its numbers; at most five rows each
    spread = grams.select("ids", "f", F.posexplode("ids").alias("at", "id")).join(names, "id")
    back = spread.groupBy("ids").agg(F.first("f").alias("f"), F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("ws"))
    back = back.select("lang", F.transform("ws", lambda x: x["word"]).alias("words"), "f")
    return materialize(single.unionByName(back.select("lang", F.array_join("words", " ").alias("phrase"), "words", "f")), "phrases"), totals


def _big(c: Column | str) -> Column:
    return F.col(c).cast("decimal(19,0)") if isinstance(c, str) else c


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, dictionary_bytes: int = DICTIONARY_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of 2 to 5 words.

    Texts (null: empty) are lower-cased in A-Z, cut into pieces at ``.,;:!?`` and line ends and into
    words at blanks and tabs; lang null counts as ``und``. a, l and r are the frequencies of a phrase
    and of the two sides of its lowest-scoring cut, n all words of the language; the score is
    floor(1000 * a * n / (l * r)) in exact decimals. A phrase goes if a longer one that holds its
    words is as frequent. Repeated rows count again; an empty table, or one without frequent phrases,
    gives no rows. Other columns are not looked at."""
    phrases, totals = frequent_phrases(docs, least, dictionary_bytes)
    many = phrases.where(F.size("words") > 1)
    side = phrases.select("lang", "phrase", "f")
    cut = F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")
    cuts = many.select("lang", "phrase", F.col("f").alias("a"), "words", cut)
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")), " ").alias("right"))
    cuts = cuts.join(side.toDF("lang", "left", "l"), ["lang", "left"]).join(side.toDF("lang", "right", "r"), ["lang", "right"]).join(totals, "lang")
    score = F.expr("CAST((CAST(1000 AS DECIMAL(4,0)) * (CAST(a AS DECIMAL(17,0)) * CAST(n AS DECIMAL(17,0)))) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0))) AS BIGINT)")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("b"))
    # every proper run of two or more words of a phrase, with the phrase's frequency
    inner = F.expr(
        "explode(flatten(transform(sequence(2, size(words) - 1), k -> transform(sequence(1, size(words) - k + 1), i -> array_join(slice(words, i, k), ' ')))))")
    inside = many.where(F.size("words") > 2).select("lang", inner.alias("phrase"), F.col("f").alias("longer"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = best.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("b.a")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = kept.select("lang", "phrase", "b.a", "b.l", "b.r", "b.n", "b.score")
    # first within slices of a language, so that no language is sorted in one task
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(shuffle_width(docs.sparkSession))))
    for keys in (["lang", "slice"], ["lang"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").withColumn("rank", F.col("rank").cast("long"))
