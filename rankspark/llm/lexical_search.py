"""Ranked lexical search of all documents for a set of items, by bags of item words.

1. Every document becomes a bag: its counts of the words that some item holds, and its length.
2. Documents with the same bag and the same length normaliser m cannot differ in any score. They
   form a class: a hash of (m, bag) routes them, the comparison of m and the bag's bytes decides.
   A class carries its k smallest doc_ids, which are all that a list of k can show.
3. Each class is scored once against all items, in 64-bit integers. A task keeps the k best
   documents of every item, expanding a class by ascending doc_id; a last ranking joins the tasks.

The items' words travel to the tasks. They are measured first; more than ``VOCABULARY_BYTES`` are
dealt into blocks of items, one pass over the documents each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankspark.llm.common import Lookup, chunks, lower_ascii, materialize, runs, text_buffers

#: Bytes of item words (and of their places in items) that one pass broadcasts at most.
VOCABULARY_BYTES = 32 * 2**20
#: Cells of the score table and of expanded word places that a task holds at once.
CELLS = 2_000_000

# Fixed values of the score.
WEIGHT_SCALE, TF_SCALE, M_BASE, M_LENGTH, M_SHARE = 1000, 1_000_000_000, 75, 25, 12

_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _tokens(column):
    """Lower-cased bytes, term starts and ends, and the row of each term, in bounded chunks."""
    data, offsets = text_buffers(column)
    solid = _TERM[data]
    for a, b, inside in chunks(solid, offsets):
        starts, ends, first = runs(solid[a:b], inside)
        yield lower_ascii(data[a:b]), starts, ends, np.repeat(np.arange(len(first) - 1), np.diff(first))


def item_terms(items: DataFrame, text: str = "text") -> DataFrame:
    """query (SHA-256 of the text), term, qtf: the counted terms of every distinct item text."""

    def count(batches):
        for batch in batches:
            keys = batch.column(0)
            counts: dict[tuple[int, bytes], int] = {}
            for data, starts, ends, rows in _tokens(batch.column(1)):
                raw = data.tobytes()
                for r, s, e in zip(rows.tolist(), starts.tolist(), ends.tolist(), strict=True):
                    counts[r, raw[s:e]] = counts.get((r, raw[s:e]), 0) + 1
            yield pa.record_batch(
                [keys.take(pa.array([r for r, _ in counts], pa.int64())), pa.array([t.decode() for _, t in counts], pa.string()), pa.array(counts.values(), pa.int64())],
                names=["query", "term", "qtf"])

    texts = items.select(F.sha2(text, 256).alias("query"), F.col(text).alias("text")).where("text IS NOT NULL").distinct()
    return texts.mapInArrow(count, "query string, term string, qtf long")


def _in_blocks(terms: DataFrame, most: int) -> tuple[DataFrame, int]:
    """Terms with a block number: blocks of items whose terms take ``most`` bytes at most, or that
    hold a single item."""
    blocks = 1
    while True:
        dealt = terms.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int"))
        sizes = dealt.groupBy("block").agg(F.sum(F.octet_length("term") + 32).alias("bytes"), F.countDistinct("query").alias("items"))
        over = sizes.where((F.col("bytes") > most) & (F.col("items") > 1)).agg(F.max("bytes")).first()[0]
        if over is None:
            return dealt, blocks
        blocks *= max(2, -(-over // most))


def bags(docs: DataFrame, vocabulary, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n (all terms, with repeats), bag (pairs of term number and count, uint32, by number)
    of every row. ``vocabulary``: a broadcast array of distinct terms."""

    def restrict(batches):
        known = Lookup(vocabulary.value)
        size = max(1, len(vocabulary.value))
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for data, starts, ends, rows in _tokens(batch.column(1)):
                n += np.bincount(rows, minlength=len(n))
                found = known.find(data, starts, ends)
                hit = found >= 0
                parts.append(np.unique(rows[hit] * size + found[hit], return_counts=True))
            keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            tf = np.zeros(len(keys), np.int64)
            np.add.at(tf, back, np.concatenate([c for _, c in parts]))
            pairs = np.empty((len(keys), 2), "<u4")
            pairs[:, 0], pairs[:, 1] = keys % size, tf
            ends = (np.searchsorted(keys, np.arange(len(n) + 1) * size) * 8).astype(np.int64)
            bag = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(pairs.tobytes())])
            yield pa.record_batch([batch.column(0), pa.array(n), bag.cast(pa.binary())], names=["doc_id", "n", "bag"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(restrict, f"doc_id {kind}, n long, bag binary")


def document_frequencies(bag_rows: DataFrame) -> DataFrame:
    """term (number), df: documents that hold each term. Tasks send one row per term they met."""

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            ids, _, _ = _pairs(batch.column(0))
            got = np.bincount(ids, minlength=len(total))
            got[: len(total)] += total
            total = got
        met = np.flatnonzero(total)
        yield pa.record_batch([pa.array(met, pa.int64()), pa.array(total[met], pa.int64())], names=["term", "df"])

    return bag_rows.select("bag").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def _pairs(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term numbers, counts, and per row its number of pairs, of a column of bags."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0]: off[-1]] if data is not None else np.zeros(0, np.uint8)
    pairs = raw.view("<u4").reshape(-1, 2).astype(np.int64)
    return pairs[:, 0], pairs[:, 1], np.diff(off) // 8


def classes(bag_rows: DataFrame, k: int) -> DataFrame:
    """m, bag, members (the k smallest doc_ids, ascending, null last) of every class of documents
    with equal (m, bag). Map tasks cut a class to its k smallest before the shuffle."""
    keyed = bag_rows.where(F.octet_length("bag") > 0).withColumn("hash", F.xxhash64("m", "bag"))
    first = Window.partitionBy("hash", "m", "bag").orderBy(F.asc_nulls_last("doc_id"))
    few = keyed.withColumn("at", F.row_number().over(first)).where(F.col("at") <= k)
    members = F.array_sort(F.collect_list(F.struct("at", "doc_id")))
    return few.groupBy("hash", "m", "bag").agg(members.alias("members")).select("m", "bag", members_ids("members").alias("members"))


def members_ids(column: str):
    return F.transform(column, lambda x: x["doc_id"])


class Best:
    """The k best documents of every item so far, by score descending and doc_id ascending."""

    def __init__(self, items: int, k: int):
        self.items, self.k = items, k
        self.item = np.zeros(0, np.int64)
        self.score, self.doc = self.item, self.item
        self.none = np.zeros(0, bool)  # a null doc_id: behind all others
        self.least = np.ones(items, np.int64)  # what a score must reach to matter

    def add(self, scores: np.ndarray, docs: np.ndarray, none: np.ndarray, first: np.ndarray) -> None:
        """``scores``: classes x items; members of class c: docs[first[c]: first[c + 1]]."""
        c, item = np.nonzero(scores >= self.least)
        score, lead = scores[c, item], first[c]
        order = np.lexsort((docs[lead], none[lead], -score, item))
        order = order[_place(item[order]) < self.k]  # k documents stand in k classes at most
        c, item, score = c[order], item[order], score[order]
        size = np.diff(first)[c]
        at = np.arange(int(size.sum())) + np.repeat(first[c] - (np.cumsum(size) - size), size)
        self.item = np.concatenate([self.item, np.repeat(item, size)])
        self.score = np.concatenate([self.score, np.repeat(score, size)])
        self.doc, self.none = np.concatenate([self.doc, docs[at]]), np.concatenate([self.none, none[at]])
        order = np.lexsort((self.doc, self.none, -self.score, self.item))
        place = _place(self.item[order])
        order, place = order[place < self.k], place[place < self.k]
        self.item, self.score, self.doc, self.none = self.item[order], self.score[order], self.doc[order], self.none[order]
        full = place == self.k - 1
        self.least[self.item[full]] = self.score[full]


def _place(groups: np.ndarray) -> np.ndarray:
    """Position of every element within its run of equal values."""
    at = np.arange(len(groups))
    new = np.ones(len(groups), bool)
    new[1:] = groups[1:] != groups[:-1]
    return at - np.maximum.accumulate(np.where(new, at, 0)) if len(groups) else at


def _score(class_rows: DataFrame, block, k: int) -> DataFrame:
    """query, doc_id, score: the k best documents per item of each task."""

    def best_of(batches):
        queries, weight, start, place, repeats = block.value
        best = Best(len(queries), k)
        for batch in batches:
            m = batch.column(0).to_numpy()
            ids, tf, size = _pairs(batch.column(1))
            members = batch.column(2)
            first = members.offsets.to_numpy().astype(np.int64)
            docs = members.values.fill_null(0).to_numpy(zero_copy_only=False)
            none = members.values.is_null().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(m)), size)
            value = weight[ids] * ((TF_SCALE * tf) // (1000 * tf + M_SHARE * m[row]))
            places = start[ids + 1] - start[ids]
            work = np.concatenate([[0], np.cumsum(np.bincount(row, places, len(m)).astype(np.int64) + len(queries))])
            ends = np.concatenate([[0], np.cumsum(size)])
            a = 0
            while a < len(m):
                b = max(a + 1, int(np.searchsorted(work, work[a] + CELLS, "right")) - 1)
                x = slice(ends[a], ends[b])
                count = places[x]
                at = np.arange(int(count.sum())) + np.repeat(start[ids[x]] - (np.cumsum(count) - count), count)
                scores = np.zeros((b - a) * len(queries), np.int64)
                np.add.at(scores, np.repeat((row[x] - a) * len(queries), count) + place[at], np.repeat(value[x], count) * repeats[at])
                best.add(scores.reshape(b - a, len(queries)), docs, none, first[a: b + 1])
                a = b
        yield pa.record_batch(
            [pa.array(queries, pa.string()).take(pa.array(best.item)), pa.array(best.doc, pa.int64(), mask=best.none), pa.array(best.score)],
            names=["query", "doc_id", "score"])

    return class_rows.mapInArrow(best_of, "query string, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 20, vocabulary_bytes: int = VOCABULARY_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k documents of the highest score above 0.

    ``docs``: doc_id (long), text; ``items``: item_id (any type), text; other columns are not looked
    at. Every row is a document of its own, also repeated ones; equal scores go by ascending doc_id,
    null last. Items without text or terms, and those whose every score is 0 or less, get no rows;
    repeated item rows get their list each. Null and empty texts have no terms; without any document
    that has a term the result is empty."""
    spark = docs.sparkSession
    terms, blocks = _in_blocks(materialize(item_terms(items), "item-terms"), vocabulary_bytes)
    found = None
    for number in range(blocks):
        part = terms.where(F.col("block") == number).select("query", "term", "qtf").toArrow().combine_chunks()
        words = part.column("term").combine_chunks().dictionary_encode() if part.num_rows else None
        if words is None:
            continue
        vocabulary = spark.sparkContext.broadcast(words.dictionary)
        rows = materialize(bags(docs, vocabulary), "bags")
        n_docs, n_terms = rows.where("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n_docs:
            break
        df = np.zeros(len(words.dictionary), np.int64)
        got = document_frequencies(rows).toArrow()
        df[got.column("term").to_numpy()] = got.column("df").to_numpy()
        weight = np.floor(WEIGHT_SCALE * np.log((2.0 * n_docs + 2) / (2.0 * df + 1))).astype(np.int64)
        keys = part.column("query").combine_chunks().dictionary_encode()
        term = words.indices.to_numpy().astype(np.int64)
        order = np.argsort(term, kind="stable")
        start = np.searchsorted(term[order], np.arange(len(df) + 1))
        block = spark.sparkContext.broadcast(
            (keys.dictionary.to_pylist(), weight, start, keys.indices.to_numpy().astype(np.int64)[order], part.column("qtf").to_numpy()[order]))
        m = F.expr(f"{M_BASE}L + ({M_LENGTH}L * n * {n_docs}L) div {n_terms}L")
        scored = _score(classes(rows.select("doc_id", "bag", m.alias("m")), k), block, k)
        found = scored if found is None else found.unionByName(scored)
    if found is None:
        found = spark.createDataFrame([], "query string, doc_id long, score long")
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    names = items.where(F.col("text").isNotNull()).select("item_id", F.sha2("text", 256).alias("query"))
    return names.join(top, "query").select("item_id", "rank", "doc_id", "score")
