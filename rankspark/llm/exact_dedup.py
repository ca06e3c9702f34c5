"""Exact deduplication by content-defined chunk recipes (operator 9).

A document's normalised text is cut into chunks at content-defined places (a rolling hash over
the last 16 bytes), each chunk gets a 64-bit identifier, and a document becomes its recipe: the
ordered identifiers of its chunks. Documents are compared by recipe, so long texts are moved at
most once, chunk by chunk, and copies of a chunk collapse before the shuffle.

Identifiers are verified: all bytes that share an identifier are compared (smallest against
largest). Documents that hold an identifier shared by different bytes carry the SHA-256 of the
whole text in their comparison key as well, so a hash collision cannot join two texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankspark.llm.common import _IS_WS, bounded, materialize, text_buffers

#: Chunk sizes in bytes. A cut needs CUT_BITS zero bits in the rolling hash.
MIN_CHUNK = 512
MAX_CHUNK = 16384
CUT_BITS = 11

_GEAR = np.random.default_rng(7).integers(0, 2**32, 256, dtype=np.uint32)


def normalise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every run of white space becomes one space, in all rows of a batch at once."""
    if len(data) == 0:
        return data, offsets
    space = _IS_WS[data]
    repeated = np.zeros(len(data), bool)
    repeated[1:] = space[1:] & space[:-1]
    repeated[offsets[:-1][offsets[:-1] < offsets[1:]]] = False
    keep = ~repeated
    kept = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    return np.where(space, np.uint8(32), data)[keep], kept[offsets]


def cut_places(data: np.ndarray) -> np.ndarray:
    """Positions after which the rolling hash of the last 16 bytes asks for a cut."""
    h = _GEAR[data]
    with np.errstate(over="ignore"):
        for width in (1, 2, 4, 8):
            h[width:] = h[width:] + (h[:-width] << np.uint32(width))
    return np.flatnonzero((h >> np.uint32(16 - CUT_BITS)) & np.uint32(2**CUT_BITS - 1) == 0) + 1


def chunk_bounds(start: int, end: int, cuts: np.ndarray) -> list[int]:
    """Chunk ends of one text: the first cut at least MIN_CHUNK bytes on, at most MAX_CHUNK."""
    bounds, at = [], start
    i = np.searchsorted(cuts, start + MIN_CHUNK)
    while end - at > MAX_CHUNK or (i < len(cuts) and cuts[i] < end):
        while i < len(cuts) and cuts[i] < at + MIN_CHUNK:
            i += 1
        stop = int(cuts[i]) if i < len(cuts) else end
        stop = min(stop, at + MAX_CHUNK)
        if stop >= end:
            break
        bounds.append(stop)
        at = stop
    if end > at:
        bounds.append(end)
    return bounds


def _chunks(batch_text) -> Iterator[tuple[int, bytes, list[tuple[int, bytes]]]]:
    import xxhash

    data, offsets = normalise(*text_buffers(batch_text))
    cuts = cut_places(data)
    raw = data.tobytes()
    digest = xxhash.xxh3_64_intdigest
    for row in range(len(offsets) - 1):
        start, end = int(offsets[row]), int(offsets[row + 1])
        parts, at = [], start
        for stop in chunk_bounds(start, end, cuts[np.searchsorted(cuts, start, "right"): np.searchsorted(cuts, end)]):
            piece = raw[at:stop]
            parts.append((digest(piece) - 2**63, piece))
            at = stop
        yield row, raw[start:end], parts


def _recipes(batches):
    import hashlib

    for b in bounded(batches, 1):
        ids, shas, sizes = [], [], []
        for _, whole, parts in _chunks(b.column(1)):
            ids.append([h for h, _ in parts])
            shas.append(hashlib.sha256(whole).hexdigest())
            sizes.append(len(whole))
        yield pa.record_batch([b.column(0), pa.array(ids, pa.list_(pa.int64())), pa.array(shas, pa.string()), pa.array(sizes, pa.int64()), *b.columns[2:]], names=["doc_id", "recipe", "text_sha256", "n_bytes", *b.schema.names[2:]])


def _pieces(batches):
    for b in bounded(batches, 0):
        seen: dict[tuple[int, bytes], None] = {}
        for _, _, parts in _chunks(b.column(0)):
            seen.update(dict.fromkeys(parts))
        yield pa.record_batch([pa.array([h for h, _ in seen], pa.int64()), pa.array([p for _, p in seen], pa.binary())], names=["chunk", "bytes"])


def chunk_recipes(docs: DataFrame, *carried: Column) -> DataFrame:
    """doc_id, recipe (ordered chunk identifiers), text_sha256, n_bytes of the normalised text, and
    the ``carried`` string columns."""
    rows = docs.select("doc_id", "text", *carried)
    return rows.mapInArrow(_recipes, ", ".join(["doc_id long, recipe array<long>, text_sha256 string, n_bytes long", *(f"{c} string" for c in rows.columns[2:])]))


def clashing_chunks(docs: DataFrame) -> DataFrame:
    """Identifiers that stand for different bytes; copies collapse before the shuffle."""
    pieces = docs.select("text").mapInArrow(_pieces, "chunk long, bytes binary")
    return pieces.groupBy("chunk").agg(F.min("bytes").alias("lo"), F.max("bytes").alias("hi")).where("lo != hi").select("chunk")


def exact_groups(docs: DataFrame) -> DataFrame:
    """Group equal normalised texts of ``docs`` (doc_id, text; other columns are ignored).

    Returns a row per input row: doc_id, keep_id (smallest doc_id of the group), group_size
    (rows of the group), kept, text_sha256. Null text counts as empty, all empty texts are one
    group. A null doc_id counts as larger than any other. Rows that repeat a doc_id with the
    same text are all kept if that doc_id is; an empty table gives an empty result.
    """
    return _grouped(docs, materialize(chunk_recipes(docs), "recipes"))


def _grouped(docs: DataFrame, recipes: DataFrame, *carried: str) -> DataFrame:
    """``exact_groups`` of the rows of ``recipes``, with their ``carried`` columns."""
    clash = clashing_chunks(docs)
    marked = (
        recipes.select("doc_id", "text_sha256", F.explode("recipe").alias("chunk"))
        .join(clash, "chunk", "left_semi")
        .select(F.col("text_sha256").alias("clash_sha")).distinct()
    )
    keyed = recipes.join(marked, recipes.text_sha256 == marked.clash_sha, "left")
    key = ["recipe", "n_bytes", "clash_sha"]
    groups = keyed.groupBy(*key).agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.select(F.xxhash64(*key).alias("g_key"), *[F.col(c).alias(f"g_{c}") for c in key], "keep_id", "group_size")
    rows = keyed.withColumn("key", F.xxhash64(*key))
    on = (rows.key == groups.g_key)
    for c in key:
        on = on & rows[c].eqNullSafe(groups[f"g_{c}"])
    return rows.join(groups, on).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", *carried
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each group of equal texts.

    All columns are kept. The decision is joined back by doc_id and a digest of the text, so it
    reaches only rows with both; equal texts with the same doc_id stay or go together.
    """
    version = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    groups = _grouped(docs, materialize(chunk_recipes(docs, version.alias("version")), "recipes"), "version")
    gone = groups.where(~F.col("kept")).select(F.col("doc_id").alias("gone_id"), F.col("version").alias("gone_version")).distinct()
    there = F.sha2(F.coalesce(docs["text"], F.lit("")), 256)
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]) & (there == gone["gone_version"]), "left_anti")
