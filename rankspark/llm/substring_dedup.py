"""Substring deduplication with FM-indexes (operator 8).

Windows of WINDOW words are routed to shards by content, so that equal windows always meet: every
window has an anchor, the run of ANCHOR words in it with the smallest hash, and consecutive
windows with one anchor travel together as a segment (at most WINDOW - ANCHOR + 1 windows). A
first pass finds the anchors that occur in different texts; segments of all other anchors cannot
repeat and stay at home. A bounded Bloom filter carries that verdict to the second pass: it only
saves work, a false positive costs a segment's trip and changes no result.

Equal segments of a task collapse before the shuffle (smallest and largest document stay). Each shard
builds an FM-index of its distinct segments and streams them through it: backward search over the wavelet
matrix gives, for every window, the interval of its occurrences, and so the smallest document that
holds it. Anchors with very many rows are split further: each of their windows is a segment of its
own, routed by the whole window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.llm.common import bounded, materialize, mix64, shuffle_width, text_buffers, window_hashes, word_hashes, word_spans
from rankspark.llm.exact_dedup import normalise
from rankspark.llm.fm_index import FMIndex
from rankspark.llm.line_dedup import NULL_ID, _doc, _version

WINDOW = 13
ANCHOR = 7
#: Rows of an anchor from which its windows are routed one by one.
HOT_ANCHOR = 50_000
#: The Bloom filter's bits per anchor, probes and greatest size; beyond it more segments travel.
FILTER_BITS = 12
FILTER_PROBES = 5
FILTER_BYTES = 64 * 2**20
FILTER_BLOCKS = 64
#: Anchors, and bytes of distinct segments (their bookkeeping included), that a task gathers before
#: it hands them on.
BLOCK_ANCHORS = 500_000
BLOCK_BYTES = 48 * 2**20
SEGMENT_BYTES = 450
#: Anchors, and segments, that a range holds, about. A task works on one range at a time, so its
#: memory follows these numbers and not the rows that reach it; there are as many ranges as the
#: counted rows ask for, and at least several per task.
RANGE_ANCHORS = 250_000
RANGE_SEGMENTS = 60_000


def anchored_segments(data: np.ndarray, offsets: np.ndarray, window: int, anchor: int):
    """The batch's words and segments: starts, ends, first word of each row; per segment its row,
    first word, number of windows and anchor hash."""
    starts, ends, first = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    grams = window_hashes(words, anchor)
    n = len(words) - window + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return starts, ends, first, words, empty, empty, empty, np.zeros(0, np.uint64)
    best, where = grams[:n].copy(), np.zeros(n, np.int8)
    for j in range(1, window - anchor + 1):
        smaller = grams[j: j + n] < best
        best[smaller] = grams[j: j + n][smaller]
        where[smaller] = j
    valid = np.zeros(n + 1, np.int8)
    rows = np.flatnonzero(np.diff(first) >= window)
    np.add.at(valid, first[rows], 1)
    np.add.at(valid, first[rows + 1] - window + 1, -1)
    valid = np.cumsum(valid[:-1]).astype(bool)
    place = np.arange(n) + where
    begins = valid.copy()
    begins[1:] &= (place[1:] != place[:-1]) | ~valid[:-1]
    begins[first[rows]] = True
    at = np.flatnonzero(begins)
    stops = np.append(at[1:], n)
    row = np.searchsorted(first, at, "right") - 1
    count = np.minimum(stops, first[row + 1] - window + 1) - at
    return starts, ends, first, words, row, at, count, best[at]


def _text_key(words: np.ndarray) -> tuple[int, int]:
    import xxhash

    return tuple(np.frombuffer(xxhash.xxh3_128_digest(words.tobytes()), np.int64))


def _describe(batches):
    for b in bounded(batches, 2):
        data, offsets = text_buffers(b.column(2))
        starts, ends, first = word_spans(data, offsets)
        words = word_hashes(data, starts, ends)
        keys = np.array([_text_key(words[lo:hi]) for lo, hi in zip(first[:-1], first[1:], strict=True)], np.int64).reshape(-1, 2)
        yield pa.record_batch([b.column(0), b.column(1), pa.array(np.diff(first)), pa.array(keys[:, 0]), pa.array(keys[:, 1])], names=["doc", "version", "n_words", "k1", "k2"])


def _anchor_blocks(window: int, anchor: int, ranges: int):
    """Anchors with the key of their text, in blocks by hash range. Within a block of at most
    BLOCK_ANCHORS an anchor keeps two different texts at most (all that is asked is whether there
    are two) and its number of rows, so a very common anchor costs a few entries a block."""

    def blocks(hashes: np.ndarray, keys: np.ndarray):
        order = np.lexsort((keys, hashes))
        hashes, keys = hashes[order], keys[order]
        fresh = np.ones(len(hashes), bool)
        fresh[1:] = hashes[1:] != hashes[:-1]
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(hashes)) - 1
        rows = last - first + 1
        two = keys[first] != keys[last]
        at = np.concatenate([first, last[two]])
        count = np.concatenate([np.minimum(rows, 65535), np.zeros(int(two.sum()), np.int64)]).astype(np.uint16)
        place = _range(hashes[at], ranges)
        by = np.argsort(place, kind="stable")
        at, count, place = at[by], count[by], place[by]
        bounds = np.searchsorted(place, np.arange(ranges + 1))
        full = np.flatnonzero(np.diff(bounds))
        cut = lambda x: pa.array([x[bounds[r]: bounds[r + 1]].tobytes() for r in full], pa.binary())
        return pa.record_batch([pa.array(full.astype(np.int32)), cut(hashes[at]), cut(keys[at]), cut(count)], names=["range", "anchors", "keys", "counts"])

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for b in bounded(batches, 0):
            _, _, first, words, row, _, _, hashes = anchored_segments(*text_buffers(b.column(0)), window, anchor)
            if not len(row):
                continue
            keys = np.array([_text_key(words[lo:hi])[0] for lo, hi in zip(first[:-1], first[1:], strict=True)], np.int64)
            held.append((hashes, keys[row]))
            size += len(row)
            if size >= BLOCK_ANCHORS:
                yield blocks(*map(np.concatenate, zip(*held, strict=True)))
                held, size = [], 0
        if size:
            yield blocks(*map(np.concatenate, zip(*held, strict=True)))

    return run


def _range(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each hash, of ``ranges`` equal ones (up to 2**31)."""
    return ((hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _by_range(batches):
    """The rows of one range after the other, each as its columns but the first; rows come sorted."""
    held: list[tuple] = []
    now = None
    for b in batches:
        for i, place in enumerate(b.column(0).to_pylist()):
            if place != now and held:
                yield held
                held = []
            now = place
            held.append(tuple(b.column(j)[i].as_buffer() for j in range(1, b.num_columns)))
    if held:
        yield held


def _shared(batches):
    """The anchors that occur in different texts, with their number of rows, range by range."""
    for rows in _by_range(batches):
        yield _shared_in(rows)


def _shared_in(rows):
    hashes, keys, counts = (np.concatenate([np.frombuffer(r[j], t) for r in rows]) for j, t in enumerate((np.uint64, np.int64, np.uint16)))
    order = np.argsort(hashes, kind="stable")
    hashes, keys, counts = hashes[order], keys[order], counts[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = hashes[1:] != hashes[:-1]
    first = np.flatnonzero(fresh)
    several = np.minimum.reduceat(keys, first) != np.maximum.reduceat(keys, first)
    rows = np.add.reduceat(counts.astype(np.int64), first)
    return pa.record_batch([pa.array(hashes[first][several].view(np.int64)), pa.array(rows[several])], names=["anchor", "n"])


def _probes(hashes: np.ndarray, block_bits: int) -> np.ndarray:
    """Bit positions (inside the key's block) of every probe: probes x keys."""
    h = mix64(hashes)
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    steps = np.arange(FILTER_PROBES, dtype=np.uint64)[:, None]
    return ((low + steps * high) % np.uint64(block_bits)).astype(np.int64)


class BloomFilter:
    """Blocks of bits; a key's block is given by its top bits, so a task owns whole blocks."""

    def __init__(self, blocks: dict[int, bytes], block_bits: int):
        self.block_bits = block_bits
        self.bits = np.zeros((FILTER_BLOCKS, block_bits // 8), np.uint8)
        for i, raw in blocks.items():
            self.bits[i] = np.frombuffer(raw, np.uint8)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        block = (hashes >> np.uint64(58)).astype(np.int64)
        probes = _probes(hashes, self.block_bits)
        return ((self.bits[block, probes >> 3] >> (probes & 7).astype(np.uint8)) & 1).all(0)


def _filter(keys: DataFrame, column: str) -> BloomFilter:
    """A filter of a long column; its size follows the row count, up to FILTER_BYTES, which also
    bounds what comes to the driver."""
    rows = keys.count()
    bits = min(max(1024, 2 ** int(np.ceil(np.log2(max(1, rows * FILTER_BITS / FILTER_BLOCKS))))), FILTER_BYTES * 8 // FILTER_BLOCKS)

    def build(batches):
        made: dict[int, np.ndarray] = {}
        for b in batches:
            hashes = b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            blocks = b.column(0).to_numpy(zero_copy_only=False)
            probes = _probes(hashes, bits)
            for i in np.unique(blocks):
                held = made.setdefault(int(i), np.zeros(bits, bool))
                held[probes[:, blocks == i].ravel()] = True
        if made:
            yield pa.record_batch([pa.array(list(made), pa.int32()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in made.values()], pa.binary())], names=["block", "bits"])

    block = F.shiftrightunsigned(F.col(column), 58).cast("int")
    dealt = keys.select(block.alias("block"), column).repartition(FILTER_BLOCKS, "block")
    return BloomFilter({r.block: bytes(r.bits) for r in dealt.mapInArrow(build, "block int, bits binary").collect()}, bits)


def _chosen(batch_text, window: int, anchor: int, common, crowded):
    """Segments of a batch whose anchor may be shared: row, first word in the row, route, id, words."""
    import xxhash

    data, offsets = normalise(*text_buffers(batch_text))
    starts, ends, first, words, row, at, count, hashes = anchored_segments(data, offsets, window, anchor)
    if len(row):
        chosen = common.holds(hashes)
        row, at, count, hashes = row[chosen], at[chosen], count[chosen], hashes[chosen]
    if not len(row):
        return None
    split = crowded.holds(hashes)
    if split.any():  # every window on its own
        times = np.where(split, count, 1)
        index = np.repeat(np.arange(len(row)), times)
        at = at[index] + np.arange(len(index)) - np.repeat(np.cumsum(times) - times, times)
        whole = window_hashes(words, window)[at]
        row, count, hashes, split = row[index], count[index], hashes[index], split[index]
        count, hashes = np.where(split, 1, count), np.where(split, whole, hashes)
    raw = data.tobytes()
    pieces = [raw[s:e] for s, e in zip(starts[at].tolist(), ends[at + count + window - 2].tolist(), strict=True)]
    ids = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, pieces)), np.int64).reshape(-1, 2)
    return row, at - first[row], hashes.view(np.int64), ids, pieces


def _occurrences(window: int, anchor: int, shared, hot):
    def run(batches):
        for b in bounded(batches, 2):
            found = _chosen(b.column(2), window, anchor, shared.value, hot.value)
            if found:
                row, pos, _, ids, _ = found
                owner = pa.array(row)
                yield pa.record_batch([pa.array(ids[:, 0]), pa.array(ids[:, 1]), b.column(0).take(owner), b.column(1).take(owner), pa.array(pos.astype(np.int32))], names=["s1", "s2", "doc", "version", "pos"])

    return run


def _segment_blocks(window: int, anchor: int, shared, hot, ranges: int):
    """Distinct segments with the smallest and largest document that hold them, in compressed
    blocks by range of their route. Equal ones of a task collapse here, so a segment of very many
    documents reaches its shard a few times a task."""

    def out(held):
        import zstandard

        pieces = list(held)
        values = np.array(list(held.values()), np.int64)
        place = _range(mix64(values[:, 0].view(np.uint64)), ranges)
        order = np.argsort(place, kind="stable")
        bounds = np.searchsorted(place[order], np.arange(ranges + 1))
        full = np.flatnonzero(np.diff(bounds))
        pack = zstandard.ZstdCompressor(level=3).compress
        rows = [order[bounds[r]: bounds[r + 1]] for r in full]
        words = [pack(b"\n".join([pieces[i] for i in x.tolist()])) for x in rows]
        cut = lambda j: pa.array([values[x, j].tobytes() for x in rows], pa.binary())
        return pa.record_batch([pa.array(full.astype(np.int32)), cut(1), cut(2), pa.array(words, pa.binary())], names=["range", "lo", "hi", "words"])

    def run(batches):
        held: dict[bytes, list[int]] = {}
        size = 0
        for b in bounded(batches, 1):
            found = _chosen(b.column(1), window, anchor, shared.value, hot.value)
            if not found:
                continue
            row, _, routes, _, pieces = found
            docs = b.column(0).to_numpy(zero_copy_only=False)[row].tolist()
            for piece, doc, route in zip(pieces, docs, routes.tolist(), strict=True):
                seen = held.get(piece)
                if seen is None:
                    held[piece] = [route, doc, doc]
                    size += len(piece) + SEGMENT_BYTES
                elif doc < seen[1]:
                    seen[1] = doc
                elif doc > seen[2]:
                    seen[2] = doc
                if size >= BLOCK_BYTES:
                    yield out(held)
                    held, size = {}, 0
        if held:
            yield out(held)

    return run


def _shard(window: int):
    """Index each range's distinct segments and stream them through the index: per segment the
    smallest document that holds each of its windows, where some document of the segment is
    larger."""

    def run(batches):
        for rows in _by_range(batches):
            yield index(rows)

    def index(rows):
        import xxhash
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        lows, highs = [np.frombuffer(r[0], np.int64) for r in rows], [np.frombuffer(r[1], np.int64) for r in rows]
        texts = [unpack(r[2]) for r in rows]
        pieces = b"\n".join(texts).split(b"\n")
        ids = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, pieces)), np.int64).reshape(-1, 2)
        order = np.lexsort((ids[:, 1], ids[:, 0]))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (ids[order[1:]] != ids[order[:-1]]).any(1)
        begin = np.flatnonzero(fresh)
        low = np.minimum.reduceat(np.concatenate(lows)[order], begin)
        high = np.maximum.reduceat(np.concatenate(highs)[order], begin)
        one = order[begin]  # one row of every distinct segment
        s1, s2 = ids[one, 0], ids[one, 1]
        data, offsets = text_buffers(pa.array([pieces[i] for i in one.tolist()], pa.large_binary()).view(pa.large_string()))
        starts, ends, first = word_spans(data, offsets)
        symbols, inverse = np.unique(word_hashes(data, starts, ends), return_inverse=True)
        n = len(first) - 1
        sizes = np.diff(first)
        segment = np.repeat(np.arange(n), sizes)
        text = np.zeros(len(inverse) + n, np.int64)
        place = np.arange(len(inverse)) + segment  # a separator follows every segment
        text[place] = inverse + 1
        value = np.full(len(text), np.iinfo(np.int64).max)
        value[place] = low[segment]
        fm = FMIndex(text, len(symbols) + 1, window)
        windows = sizes - window + 1
        owner = np.repeat(np.arange(n), windows)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        begin = first[:-1][owner] + owner + inside
        lo, hi = fm.matching_statistics(begin)
        smallest = low[owner].copy()
        several = hi > lo
        smallest[several] = fm.interval_minimum(lo[several], hi[several], value)
        useful = np.zeros(n, bool)
        useful[owner[smallest < high[owner]]] = True
        keep = np.flatnonzero(useful)
        bounds = np.zeros(len(keep) + 1, np.int32)
        np.cumsum(windows[keep], out=bounds[1:])
        return pa.record_batch(
            [pa.array(s1[keep]), pa.array(s2[keep]), pa.ListArray.from_arrays(pa.array(bounds), pa.array(smallest[useful[owner]]))],
            names=["s1", "s2", "holders"],
        )

    return run


def repeated_windows(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc, version, runs: the windows of every document that a smaller document also holds, as
    (first word position, bit mask of window starts from there). A run with position -1 says that
    the whole text is repeated. Documents without such windows have no row."""
    spark = docs.sparkSession
    texts = docs.select(_doc().alias("doc"), _version().alias("version"), "text")
    described = materialize(texts.mapInArrow(_describe, "doc long, version long, n_words long, k1 long, k2 long"), "word-sequences").where(F.col("n_words") >= window)
    owners = described.groupBy("k1", "k2", "n_words").agg(F.min("doc").alias("owner"))
    copies = described.join(owners, ["k1", "k2", "n_words"]).where("doc > owner").select("doc", "version", F.lit(-1).alias("pos"), F.lit(0).alias("mask"))

    width = shuffle_width(spark)
    words = described.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    ranges = max(min(8 * width, 4096), 2 * words // (window - anchor + 2) // RANGE_ANCHORS + 1)
    blocks = docs.select("text").mapInArrow(_anchor_blocks(window, anchor, ranges), "range int, anchors binary, keys binary, counts binary")
    shared = materialize(blocks.repartition(width, "range").sortWithinPartitions("range").mapInArrow(_shared, "anchor long, n long"), "shared-anchors")
    common = spark.sparkContext.broadcast(_filter(shared, "anchor"))
    crowded = spark.sparkContext.broadcast(_filter(shared.where(F.col("n") >= HOT_ANCHOR), "anchor"))

    rows = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ranges = max(min(8 * width, 4096), rows // RANGE_SEGMENTS + 1)
    distinct = texts.select("doc", "text").mapInArrow(_segment_blocks(window, anchor, common, crowded, ranges), "range int, lo binary, hi binary, words binary")
    held = distinct.repartition(width, "range").sortWithinPartitions("range").mapInArrow(_shard(window), "s1 long, s2 long, holders array<long>")
    segments = texts.mapInArrow(_occurrences(window, anchor, common, crowded), "s1 long, s2 long, doc long, version long, pos int")
    spread = segments.join(held, ["s1", "s2"])
    mask = sum((F.when(F.get("holders", F.lit(i)) < F.col("doc"), F.lit(1 << i)).otherwise(F.lit(0)) for i in range(1, window - anchor + 1)), F.when(F.get("holders", F.lit(0)) < F.col("doc"), F.lit(1)).otherwise(F.lit(0)))
    found = spread.select("doc", "version", "pos", mask.alias("mask")).where("mask != 0")
    return found.unionByName(copies).groupBy("doc", "version").agg(F.collect_set(F.struct("pos", "mask")).alias("runs"))


def _remove(window: int, digest_only: bool):
    def run(batches):
        import hashlib
        from itertools import compress

        for b in bounded(batches, 1):
            totals, removed, result = [], [], []
            for text, runs in zip(b.column(1), b.column(2), strict=True):
                words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
                n = len(words)
                if runs.is_valid:
                    pos = runs.values.field("pos").to_numpy(zero_copy_only=False).astype(np.int64)
                    mask = runs.values.field("mask").to_numpy(zero_copy_only=False).astype(np.int64)
                    step = np.zeros(n + 1, np.int64)
                    for i in range(int(mask.max(initial=0)).bit_length()):
                        at = pos[(mask >> i) & 1 == 1] + i
                        np.add.at(step, at, 1)
                        np.add.at(step, at + window, -1)
                    if (pos < 0).any():
                        step[0] += len(pos) * window + 1
                    keep = np.cumsum(step[:-1]) <= 0
                    words = list(compress(words, keep.tolist()))
                joined = b" ".join(words)
                totals.append(n)
                removed.append(n - len(words))
                result.append(hashlib.sha256(joined).hexdigest() if digest_only else joined.decode())
            yield pa.record_batch([b.column(0), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(result, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256" if digest_only else "text"])

    return run


def dedup_substrings(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, digest_only: bool = False) -> DataFrame:
    """Remove the words of every window that also starts in a document with a smaller doc_id.

    ``docs`` needs doc_id and text; other columns are ignored. Returns a row per input row:
    doc_id, n_words, n_removed, and the kept words joined by one space, or their SHA-256 with
    ``digest_only``. Null text has no words; texts with fewer words than a window lose none. A
    null doc_id counts as the smallest; rows that share a doc_id are one document; no rows give
    no rows.
    """
    runs = repeated_windows(docs, window, anchor)
    rows = docs.select("doc_id", "text", _doc().alias("d"), _version().alias("v"))
    joined = rows.join(runs, (rows.d == runs.doc) & (rows.v == runs.version), "left").select("doc_id", "text", "runs")
    last = "kept_sha256 string" if digest_only else "text string"
    return joined.mapInArrow(_remove(window, digest_only), f"doc_id long, n_words long, n_removed long, {last}")


__all__ = ["NULL_ID", "dedup_substrings", "repeated_windows"]
