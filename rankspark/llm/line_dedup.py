"""Line deduplication by range-partitioned key hashes (operator 5).

Every line's key is hashed; (hash, document, position) rows are range-partitioned on hash and
document and sorted by hash, document (largest first) and position. A partition is then streamed
once: the first document of a hash keeps its lines, later ones lose theirs as soon as a third
document is seen. A hash held by very many documents runs over several partitions, because the
ranges also cut inside a hash; each partition therefore reports its first and last hash, at most
two rows, and those few hashes are settled from the summed reports. What is returned is a
compressed keep bitmap per document, not text.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankspark.llm.common import WS_BYTES, bounded, materialize, shuffle_width

MIN_CODE_POINTS = 20
MIN_DOCUMENTS = 3
#: Stands for a null doc_id, which counts as the smallest.
NULL_ID = -(2**63)

_ROW = "h1 long, h2 long, doc long, version long, pos int, n_lines int"
_NAMES = ["h1", "h2", "doc", "version", "pos", "n_lines"]


def _doc() -> Column:
    return F.coalesce(F.col("doc_id"), F.lit(NULL_ID))


def _version() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _line_rows(min_code_points: int):
    def rows(batches):
        import xxhash

        digest = xxhash.xxh3_128_digest
        for b in bounded(batches, 2):
            keys, owner, pos, sizes = [], [], [], []
            for i, text in enumerate(b.column(2)):
                lines = (text.as_buffer().to_pybytes() if text.is_valid else b"").split(b"\n")
                for at, line in enumerate(lines):
                    key = line.strip(WS_BYTES)
                    if len(key) < min_code_points or (len(key) < 4 * min_code_points and len(key.decode()) < min_code_points):
                        continue
                    keys.append(digest(key.lower()))
                    owner.append(i)
                    pos.append(at)
                    sizes.append(len(lines))
            h = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            owner = pa.array(owner, pa.int64())
            yield pa.record_batch([pa.array(h[:, 0]), pa.array(h[:, 1]), b.column(0).take(owner), b.column(1).take(owner), pa.array(pos, pa.int32()), pa.array(sizes, pa.int32())], names=_NAMES)

    return rows


def _stream(min_documents: int):
    """One pass over a sorted partition. Kind 0: a line to drop. Kind 1: the first or last hash
    of the partition, with its number of documents and largest document."""

    def run(batches):
        key = None  # hash of the open group
        seen = 0  # its documents so far
        top = last = None  # its largest and its latest document
        leading = True  # the open group is the partition's first
        held: list[np.ndarray] = []  # its rows while fewer than min_documents were seen

        def out(kind, rows, docs=0):
            cols = [rows[:, j] for j in range(6)]
            n = len(rows)
            return pa.record_batch([pa.array(np.full(n, kind, np.int8)), *[pa.array(c) for c in cols[:4]], pa.array(cols[4].astype(np.int32)), pa.array(cols[5].astype(np.int32)), pa.array(np.full(n, docs, np.int64))], names=["kind", *_NAMES, "docs"])

        def edge():
            return out(1, np.array([[key[0], key[1], top, 0, 0, 0]], np.int64), seen)

        for b in batches:
            if not b.num_rows:
                continue
            rows = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns])
            change = np.empty(len(rows), bool)
            change[0] = key is None or tuple(rows[0, :2]) != key
            change[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
            new_doc = change.copy()
            new_doc[1:] |= rows[1:, 2] != rows[:-1, 2]
            if not change[0]:
                new_doc[0] = rows[0, 2] != last
            starts = np.flatnonzero(change)
            # the part that continues the open group
            end = int(starts[0]) if len(starts) else len(rows)
            if end:
                index = seen - 1 + np.cumsum(new_doc[:end])
                seen, last = int(index[-1]) + 1, int(rows[end - 1, 2])
                if not leading:
                    part = rows[:end][index > 0]
                    if seen >= min_documents:
                        for x in (*held, part):
                            if len(x):
                                yield out(0, x)
                        held = []
                    else:
                        held.append(part)
            if not len(starts):
                continue
            if key is not None and leading:
                yield edge()
                leading = False
            elif key is None:
                leading = True
            held = []
            # groups that begin in this batch
            group = np.cumsum(change) - 1
            order = np.cumsum(new_doc)
            base = order[starts]
            index = order[end:] - base[group[end:]]
            docs = np.append(order[starts[1:] - 1], order[-1]) - base + 1
            closed = group[end:] < len(starts) - 1
            first = (group[end:] == 0) & leading
            drop = closed & ~first & (index > 0) & (docs[group[end:]] >= min_documents)
            if drop.any():
                yield out(0, rows[end:][drop])
            if leading and len(starts) > 1:
                s = starts[0]
                key, seen, top = (int(rows[s, 0]), int(rows[s, 1])), int(docs[0]), int(rows[s, 2])
                yield edge()
                leading = False
            s = int(starts[-1])
            key, top, seen, last = (int(rows[s, 0]), int(rows[s, 1])), int(rows[s, 2]), int(docs[-1]), int(rows[-1, 2])
            tail = rows[s:][order[s:] - base[-1] > 0]
            if not leading:
                if seen >= min_documents:
                    if len(tail):
                        yield out(0, tail)
                else:
                    held = [tail]
        if key is not None:
            yield edge()

    return run


def _bitmaps(batches):
    for b in batches:
        maps = []
        for lost, n in zip(b.column(2), b.column(3).to_numpy(zero_copy_only=False), strict=True):
            keep = np.ones(int(n), bool)
            keep[lost.values.to_numpy(zero_copy_only=False)] = False
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.record_batch([b.column(0), b.column(1), pa.array(maps, pa.binary())], names=["doc", "version", "keep_bitmap"])


def keep_bitmaps(docs: DataFrame, min_code_points: int = MIN_CODE_POINTS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """Compressed keep bitmaps (zlib over packed bits, one bit a line) of the documents that
    lose a line: doc (doc_id, null as NULL_ID), version (hash of the text), keep_bitmap.

    Documents without a row keep every line. Rows that share a doc_id count as one document.
    """
    lines = materialize(
        docs.select(_doc().alias("doc"), _version().alias("version"), "text").mapInArrow(_line_rows(min_code_points), _ROW),
        "line-keys",
    )
    order = ["h1", "h2", F.desc("doc")]
    dealt = lines.repartitionByRange(shuffle_width(docs.sparkSession), *order).sortWithinPartitions(*order, "pos")
    streamed = materialize(dealt.mapInArrow(_stream(min_documents), f"kind byte, {_ROW}, docs long"), "line-drops")
    # at most two rows a partition, so the broadcast is bounded by twice the shuffle width
    edges = (
        streamed.where("kind = 1").groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("doc").alias("keeper"))
        .where(F.col("docs") >= min_documents).select("h1", "h2", "keeper")
    )
    lost = ["doc", "version", "pos", "n_lines"]
    spread = lines.join(F.broadcast(edges), ["h1", "h2"]).where("doc < keeper").select(*lost)
    drops = streamed.where("kind = 0").select(*lost).unionByName(spread)
    grouped = drops.groupBy("doc", "version").agg(F.collect_list("pos").alias("lost"), F.max("n_lines").alias("n_lines"))
    return grouped.mapInArrow(_bitmaps, "doc long, version long, keep_bitmap binary")


def kept_lines(text: bytes, bitmap: bytes | None) -> tuple[list[bytes], int]:
    """The lines a bitmap keeps, and the number of lines before."""
    lines = text.split(b"\n")
    if bitmap is None:
        return lines, len(lines)
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[: len(lines)]
    return [x for x, k in zip(lines, keep, strict=True) if k], len(lines)


def _apply(digest_only: bool):
    def run(batches):
        import hashlib

        for b in bounded(batches, 1):
            n_lines, n_dropped, result = [], [], []
            for text, bitmap in zip(b.column(1), b.column(2), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                kept, n = kept_lines(raw, bitmap.as_py())
                joined = b"\n".join(kept)
                n_lines.append(n)
                n_dropped.append(n - len(kept))
                result.append(hashlib.sha256(joined).hexdigest() if digest_only else joined.decode())
            yield pa.record_batch([b.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(result, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256" if digest_only else "text"])

    return run


def dedup_lines(docs: DataFrame, min_code_points: int = MIN_CODE_POINTS, min_documents: int = MIN_DOCUMENTS, digest_only: bool = False) -> DataFrame:
    """Drop repeated lines of ``docs`` (doc_id, text; other columns are ignored).

    Returns a row per input row: doc_id, n_lines (before), n_dropped, and the kept text, or its
    SHA-256 with ``digest_only``. Null or empty text is one empty line. A key found in at least
    ``min_documents`` documents keeps its lines in the largest doc_id only. A null doc_id counts
    as the smallest; rows that share a doc_id are one document; no rows give no rows.
    """
    bitmaps = keep_bitmaps(docs, min_code_points, min_documents)
    rows = docs.select("doc_id", "text", _doc().alias("d"), _version().alias("v"))
    joined = rows.join(bitmaps, (rows.d == bitmaps.doc) & (rows.v == bitmaps.version), "left").select("doc_id", "text", "keep_bitmap")
    last = "kept_sha256 string" if digest_only else "text string"
    return joined.mapInArrow(_apply(digest_only), f"doc_id long, n_lines long, n_dropped long, {last}")
