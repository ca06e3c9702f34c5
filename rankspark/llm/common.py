"""Shared helpers of the llm operators: shared folder tables, shuffle width, Arrow buffers."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the text contracts, as a regular-expression class and as bytes.
WS_CLASS = r"[\x20\x09-\x0D]"
WS_BYTES = b" \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only when the setting is unset, as in local tests, a scratch folder is made and set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, survives lost
    executors, and lets several consumers read one result."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    """Partitions for an explicit repartition: the session's shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def same(a: Column, b: Column) -> Column:
    """Null-safe equality for join conditions."""
    return a.eqNullSafe(b)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (n + 1, from 0) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset: column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]: off[-1]], off - off[0]


#: Text bytes that a task function works on at once; a longer text makes a slice of its own.
SLICE_BYTES = 2 * 2**20


def bounded(batches, column: int):
    """Record batches cut into slices of about SLICE_BYTES of text, so that the work arrays of a
    task don't grow with the rows of an Arrow batch."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        at = 0
        while at < b.num_rows:
            before = int(ends[at - 1]) if at else 0
            stop = max(int(np.searchsorted(ends, before + SLICE_BYTES, "right")), at + 1)
            yield b.slice(at, stop - at)
            at = stop


_IS_WS = np.zeros(256, bool)
_IS_WS[list(WS_BYTES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (byte positions) of all words, and per row the index of its first word
    (n + 1 entries). A word is a maximal run without the contract's white space."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    solid = ~_IS_WS[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    row_starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[row_starts] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    row_ends = row_starts[row_starts > 0] - 1
    after[row_ends] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_RNG = np.random.default_rng(20240613)
_BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MAX_POW = 64
_STEP = np.uint64(0x9E3779B97F4A7C15)
with np.errstate(over="ignore"):
    _POWERS = np.cumprod(np.full(_MAX_POW, _STEP, np.uint64), dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64 constants)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word's bytes: byte codes weighted by powers of the position in
    the word, summed and mixed. Words longer than 64 bytes are hashed one by one."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    total = int(lengths.sum())
    first = np.zeros(len(starts), np.int64)
    np.cumsum(lengths[:-1], out=first[1:])
    where = np.arange(total, dtype=np.int64)
    place = where - np.repeat(first, lengths)
    solid = data[where + np.repeat(starts - first, lengths)]
    with np.errstate(over="ignore"):
        codes = _BYTE_CODE[solid] * _POWERS[np.minimum(place, _MAX_POW - 1)]
        sums = np.add.reduceat(codes, first) + lengths.astype(np.uint64) * _STEP
    out = mix64(sums)
    long_words = np.flatnonzero(lengths > _MAX_POW)
    if len(long_words):
        import xxhash

        raw = data.tobytes()
        for i in long_words:
            out[i] = xxhash.xxh3_64_intdigest(raw[starts[i]: ends[i]])
    return out


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive word hashes (len - k + 1 entries), order sensitive."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        acc = words[:n].copy()
        for j in range(1, k):
            acc *= _STEP
            acc += words[j: j + n]
    return mix64(acc)


def run_key(*columns: str) -> Column:
    """A 64-bit row key of columns, nulls included (used to keep equal rows together)."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])


def runs(solid: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all maximal runs of True that stay within a row, and per row the index
    of its first run (n + 1 entries)."""
    n = len(solid)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.zeros(n, bool)
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def chunks(solid: np.ndarray, offsets: np.ndarray, size: int = SLICE_BYTES):
    """Byte ranges of about ``size`` bytes that cut no run, and the rows' offsets within each: so
    work arrays grow neither with the rows of a batch nor with a text (a run stays whole)."""
    at, n = 0, len(solid)
    while at < n:
        stop = min(at + size, n)
        if stop < n:
            gaps = np.flatnonzero(~solid[at + 1: stop + 1])
            rows = np.searchsorted(offsets, [at + 1, stop], "right")
            cut = max(at + 1 + int(gaps[-1]) if len(gaps) else 0, int(offsets[rows[1] - 1]) if rows[1] > rows[0] else 0)
            if cut <= at:  # one run fills the range: go on to its end
                later = np.flatnonzero(~solid[stop:])
                row = int(offsets[np.searchsorted(offsets, stop, "left")])
                cut = min(stop + int(later[0]) if len(later) else n, row)
            stop = cut
        yield at, stop, np.clip(offsets, at, stop) - at
        at = stop


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of many spans, one behind the other."""
    first = np.zeros(len(starts), np.int64)
    np.cumsum(lengths[:-1], out=first[1:])
    return data[np.arange(int(lengths.sum()), dtype=np.int64) + np.repeat(starts - first, lengths)]


def equal_spans(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether span i of ``a`` and span i of ``b``, both of lengths[i] >= 1 bytes, are equal."""
    if len(lengths) == 0:
        return np.zeros(0, bool)
    first = np.zeros(len(lengths), np.int64)
    np.cumsum(lengths[:-1], out=first[1:])
    return np.logical_and.reduceat(gather(a, a_starts, lengths) == gather(b, b_starts, lengths), first)


class Lookup:
    """Numbers of known byte strings: by hash, then every hit is compared byte by byte."""

    def __init__(self, words: pa.Array):
        """``words``: distinct, none empty; number = position."""
        self.data, offsets = text_buffers(words)
        hashes = word_hashes(self.data, offsets[:-1], offsets[1:])
        self.order = np.argsort(hashes, kind="stable")
        self.hashes, self.starts = hashes[self.order], offsets[:-1][self.order]
        self.lengths = np.diff(offsets)[self.order]

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray | None = None) -> np.ndarray:
        """Number of every span, -1 for unknown ones. ``hashes``: those of the spans, if known."""
        out = np.full(len(starts), -1, np.int64)
        if not len(self.hashes) or not len(starts):
            return out
        hashes = word_hashes(data, starts, ends) if hashes is None else hashes
        at = np.searchsorted(self.hashes, hashes)
        todo = np.flatnonzero(at < len(self.hashes))
        todo = todo[self.hashes[at[todo]] == hashes[todo]]
        while len(todo):  # words with one hash stand together: try the next until the bytes agree
            k = at[todo]
            fits = self.lengths[k] == (ends - starts)[todo]
            some = todo[fits]
            fits[fits] = equal_spans(data, starts[some], self.data, self.starts[k[fits]], self.lengths[k[fits]])
            out[todo[fits]] = self.order[k[fits]]
            todo = todo[~fits]
            at[todo] += 1
            todo = todo[at[todo] < len(self.hashes)]
            todo = todo[self.hashes[at[todo]] == hashes[todo]]
        return out
