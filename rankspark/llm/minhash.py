"""Near-duplicate detection by fast similarity sketching (operator 7).

A document's set is its distinct five-word shingles. The sketch has SKETCH coordinates, filled in
rounds: in round i every shingle is hashed to a bin and a value in [i, i + 1), and a bin keeps its
smallest value; after SKETCH rounds the bin is fixed, so every coordinate is sure to be filled.
Two sketches agree in a coordinate with the sets' Jaccard similarity, with concentration as for
independent min-hashes, at the cost of about one pass over the shingles.

Coordinates are grouped into BANDS of ROWS, and documents with an equal band share a bucket. At
similarity 0.85 a pair shares no band with a probability of about 4e-7. Candidates are never all
pairs of a bucket. First every member is compared, on the full sets, with its bucket's hub: the
member whose buckets are the largest. Then buckets whose members are still in more than one
component are settled exactly by prefix filtering: with shingles ordered from rare to common, two
similar sets must share one so early that enough shingles can follow it in both. Only pairs in
different components are taken, and the largest component of a shingle's holders is not paired
with itself, so a large group of copies costs no more than its strays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankspark.llm.common import bounded, lower_ascii, materialize, mix64, text_buffers, window_hashes, word_hashes, word_spans
from rankspark.llm.components import connected_components

SHINGLE = 5
PERCENT = 85
BANDS = 20
ROWS = 4
SKETCH = BANDS * ROWS


def shingle_sets(column: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text of a batch (null: empty)."""
    data, offsets = text_buffers(column)
    data = lower_ascii(data)
    starts, ends, first = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    windows = window_hashes(words, shingle)
    out = []
    for i in range(len(offsets) - 1):
        lo, hi = int(first[i]), int(first[i + 1])
        if hi - lo >= shingle:
            hashes = np.sort(windows[lo: hi - shingle + 1])
            fresh = np.empty(len(hashes), bool)
            fresh[0] = True
            np.not_equal(hashes[1:], hashes[:-1], out=fresh[1:])
            out.append(hashes[fresh])
        elif hi > lo:
            out.append(mix64(window_hashes(words[lo:hi], hi - lo) + np.uint64(hi - lo)))
        else:
            out.append(words[:0])
    return out


_SALTS = mix64(np.arange(1, 2 * 4096 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def similarity_sketch(hashes: np.ndarray, size: int = SKETCH) -> np.ndarray:
    """The sketch of a non-empty set: ``size`` values, the round in the top 16 bits."""
    sketch = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    empty = np.ones(size, bool)
    at = 0
    while empty.any():
        if at < size:
            rounds = min(max(1, 2 * size // len(hashes)), size - at)
            h = mix64(hashes[None, :] ^ _SALTS[at: at + rounds, None])
            bins = ((h >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
            value = (h & np.uint64(0xFFFFFFFF)) | (np.arange(at, at + rounds, dtype=np.uint64) << np.uint64(48))[:, None]
            bins, value = bins.ravel(), value.ravel()
            open_ = empty[bins]
            bins, value = bins[open_], value[open_]
            order = np.argsort(value)[::-1]  # of equal bins the smallest value is written last
            sketch[bins[order]] = value[order]
            empty[bins] = False
            at += rounds
        else:
            for b in np.flatnonzero(empty):
                h = mix64(hashes ^ _SALTS[size + b])
                sketch[b] = (h & np.uint64(0xFFFFFFFF)).min() | np.uint64((size + int(b)) << 48)
            empty[:] = False
    return sketch


def _describe(bands: int, rows: int, shingle: int):
    def run(batches):
        import xxhash

        label = mix64(np.arange(1, bands + 1, dtype=np.uint64))
        for b in bounded(batches, 1):
            sets = shingle_sets(b.column(1), shingle)
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            full = [s for s in sets if len(s)]
            with np.errstate(over="ignore"):
                sketches = np.array([similarity_sketch(s, bands * rows) for s in full], np.uint64).reshape(len(full), bands, rows)
                acc = np.tile(label, (len(full), 1))
                for r in range(rows):
                    acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + sketches[:, :, r])
            sizes = np.array([len(s) for s in sets], np.int64)
            offsets = np.zeros(len(sets) + 1, np.int32)
            np.cumsum(np.where(sizes > 0, bands, 0), out=offsets[1:])
            pair = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.record_batch(
                [b.column(0), pa.array(sizes), pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(acc.ravel().view(np.int64)))],
                names=["doc_id", "n_shingles", "s1", "s2", "bands"],
            )

    return run


def _sets(shingle: int):
    def run(batches):
        for b in bounded(batches, 1):
            sets = shingle_sets(b.column(1), shingle)
            offsets = np.zeros(len(sets) + 1, np.int32)
            np.cumsum([len(s) for s in sets], out=offsets[1:])
            values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))], names=["doc_id", "shingles"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. Pairs often share b (a hub), so b's set
    is joined first, while the rows are narrow."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(right, "b").join(left, "a").where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def _prefix_pairs(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (node, n, component) in different components that may be similar.

    The overlap of similar sets of x and y shingles is at least percent (x + y) / (100 + percent).
    The first shared shingle, in the order from rare to common, stands at a place in either set
    from which that many can still follow; any pair without such a shingle is not similar.
    """
    token = nodes.join(sets, F.col("node") == F.col("doc_id")).select("node", "n", "component", F.explode("shingles").alias("token"))
    token = materialize(token, "open-shingles")
    counted = token.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    by_rarity = Window.partitionBy("node").orderBy("df", "token")
    place = token.join(counted, "token").withColumn("left", F.col("n") - F.row_number().over(by_rarity) + 1)
    early = materialize(place.where((100 * F.col("left") >= percent * F.col("n")) & (F.col("df") > 1)).select("token", "node", "n", "component", "left"), "prefixes")
    held = early.groupBy("token", "component").agg(F.count(F.lit(1)).alias("k"))
    major = held.groupBy("token").agg(F.max_by("component", F.struct("k", "component")).alias("major"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("token", "major")
    live = early.join(major, "token")
    x = live.where("component != major").select("token", *[F.col(c).alias(f"x_{c}") for c in ("node", "n", "component", "left")])
    y = live.select("token", *[F.col(c).alias(f"y_{c}") for c in ("node", "n", "component", "left")])
    enough = (100 + percent) * F.least("x_left", "y_left") >= percent * (F.col("x_n") + F.col("y_n"))
    met = x.join(y, (x.token == y.token) & (F.col("x_component") != F.col("y_component")) & enough)
    return met.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()


def near_groups(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Components of near-duplicate documents of ``docs`` (doc_id, text; others are ignored).

    Returns a row per input row: doc_id, n_shingles, component_id (smallest doc_id reachable over
    links of at least ``percent`` per cent Jaccard similarity), kept. Documents with equal sets
    are collapsed first. Null, empty and wordless texts have an empty set and no links. Rows that
    share a doc_id are one document. A row with a null doc_id is linked with nothing: its
    component_id is null and it is kept. No rows give no rows.
    """
    described = materialize(docs.select("doc_id", "text").mapInArrow(_describe(bands, rows, shingle), "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>"), "sketches")
    named = described.where("doc_id IS NOT NULL AND n_shingles > 0")
    # equal sets: one representative; F.first is safe as equal sets have equal bands
    reps = named.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    reps = materialize(reps, "representatives")
    member = reps.select(F.explode("bands").alias("bucket"), F.col("rep").alias("node"), F.col("n_shingles").alias("n"))
    crowded = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo != hi").select("bucket", "size")
    open_ = materialize(member.join(crowded, "bucket"), "buckets")
    weights = materialize(open_.groupBy("node").agg(F.sum("size").alias("weight")), "weights")
    texts = docs.select("doc_id", "text").join(weights, F.col("doc_id") == F.col("node"), "left_semi")
    sets = materialize(texts.mapInArrow(_sets(shingle), "doc_id long, shingles array<long>"), "shingle-sets")

    hubs = open_.join(weights, "node").groupBy("bucket").agg(F.max_by(F.struct("node", "n"), F.struct("weight", -F.col("node"))).alias("hub"))
    pairs = open_.join(hubs, "bucket").where("node != hub.node").select("node", "n", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"))
    pairs = pairs.where(100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")).select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    groups = connected_components(_verified(pairs, sets, percent))
    # members of buckets that are still in several components
    named_open = open_.select("bucket", "node", "n").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = named_open.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("bucket")
    rest = named_open.join(mixed, "bucket").select("node", "n", "component").distinct()
    found = materialize(_verified(_prefix_pairs(rest, sets, percent), sets, percent), "verified")
    if not found.isEmpty():  # the components so far are stars that take in the new links
        groups = connected_components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found))

    groups = groups.withColumnRenamed("node", "rep")
    of_set = reps.select("s1", "s2", "n_shingles", "rep").join(groups, "rep", "left").select("s1", "s2", "n_shingles", F.coalesce("component", "rep").alias("component"))
    rows_ = described.join(of_set, ["s1", "s2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component", "doc_id"))
    return rows_.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: one document (the smallest doc_id) of each component."""
    gone = near_groups(docs).where(~F.col("kept")).select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
