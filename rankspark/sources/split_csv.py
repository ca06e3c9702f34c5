"""IO-1, PF-10: quoted multi-line CSV read by many tasks per file, with keys in file order.

A line break inside quotes does not end a record, so a reader that starts in the middle of a file
must know whether it starts inside quotes. That is a prefix scan:

1. Every block of a file (a Spark file split, whole lines) works out in which state it ends, and how
   many records it starts, for both states it may begin in. One row per block leaves the task.
2. A block maps the two states to one state, keeps them or swaps them. The state at its start is the
   result of the last fixing block before it, swapped as often as blocks after that one swap: two
   running windows over one row per block. Running sums of the record counts give every block the
   number of its first record.
3. The lines are read again, each block with its state, and cut into records. Only a record that
   crosses the end of its block is put together across tasks.
4. ``from_csv`` parses each record with Spark's own CSV parser.

The key of a record is its place in its file, counted over all files in the order of their paths. It
depends neither on block sizes nor on the cluster.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankspark.operators.joins import small_copy
from rankspark.session import stored

_BLOCK = ["file", "start", "length"]
_LINES = "file string, start long, length long, line string"
_SUMMARY = "file string, start long, length long, open_after_outside boolean, open_after_inside boolean, records_outside long, records_inside long"
_PIECES = "file string, start long, place long, number long, head boolean, open boolean, record string"


class _Quoting:
    """Whether a line ends inside quotes, given whether it starts inside.

    A field is quoted if it starts with a quote; two quotes inside stand for one. What follows a
    closing quote belongs to the field up to the next separator. Quotes elsewhere are plain text."""

    def __init__(self, sep: str):
        s = re.escape(sep)
        inner = r'[^"]*+(?:""[^"]*+)*+'
        fields = rf'(?:(?:"{inner}"(?:(?!{s}).)*+|(?!")(?:(?!{s}).)*+){s})*+'
        if len(sep) == 1:
            fields = rf'(?:(?:"{inner}"[^{s}]*+|(?!")[^{s}]*+){s})*+'
        past = rf"[^{s}]*+" if len(sep) == 1 else rf"(?:(?!{s}).)*+"
        self.outside = re.compile(rf'{fields}"{inner}\Z', re.S)
        self.inside = re.compile(rf'{inner}(?:\Z|"{past}{s}{fields}"{inner}\Z)', re.S)

    def after(self, line: str, inside: bool) -> bool:
        return bool((self.inside if inside else self.outside).match(line))


def _of_blocks(batches):
    """(block, lines, which lines hold a quote) for consecutive rows of one block."""
    for batch in batches:
        starts, files = batch.column(1).to_pylist(), batch.column(0).to_pylist()
        lengths = batch.column(2).to_pylist()
        at = 0
        while at < len(starts):
            end = at + 1
            while end < len(starts) and starts[end] == starts[at] and files[end] == files[at]:
                end += 1
            lines = batch.column(3).slice(at, end - at)
            yield (files[at], starts[at], lengths[at]), lines.to_pylist(), pc.match_substring(lines, '"').to_pylist(), at
            at = end


def _lines(spark: SparkSession, path, line_sep: str) -> DataFrame:
    """The files' lines with the block each starts in; a carriage return before the break goes."""
    text = spark.read.option("lineSep", line_sep).text(path)
    line = F.when(F.col("value").endswith("\r"), F.expr("left(value, length(value) - 1)")).otherwise(F.col("value")) if line_sep == "\n" else F.col("value")
    meta = F.col("_metadata")
    return text.select(
        meta["file_path"].alias("file"), meta["file_block_start"].alias("start"), meta["file_block_length"].alias("length"), line.alias("line"))


def block_table(lines: DataFrame, sep: str = ",") -> DataFrame:
    """One row per block: file, start, length, ``inside`` (does it start inside quotes), ``first``
    (records of its file before it) and ``earlier`` (rows of earlier files, headers left out)."""

    def summarise(batches):
        rule, rows, block = _Quoting(sep), [], None
        for of, texts, quoted, _ in _of_blocks(batches):
            if of != block:
                block = of
                rows.append([*of, False, True, 0, 0])
            row = rows[-1]
            for text, q in zip(texts, quoted, strict=True):
                if text:  # an empty line outside quotes is no record
                    row[5] += not row[3]
                    row[6] += not row[4]
                if q:
                    row[3], row[4] = rule.after(text, row[3]), rule.after(text, row[4])
        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=arrow)

    names = [x.split()[0] for x in _SUMMARY.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    arrow = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in _SUMMARY.split(", ")])
    blocks = stored(lines.mapInArrow(summarise, _SUMMARY), "csv-blocks")
    order = Window.partitionBy("file").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    fixes = F.col("open_after_outside") == F.col("open_after_inside")
    swaps = F.col("open_after_outside") & ~F.col("open_after_inside")
    # swaps so far, this block included; and, at a fixing block, the state it fixes and that number
    seen = blocks.withColumn("swaps", F.sum(swaps.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    fixed = F.last(F.when(fixes, F.struct("open_after_outside", "swaps")), ignorenulls=True).over(before)
    seen = seen.withColumn("fixed", fixed).withColumn("so_far", F.coalesce(F.sum(swaps.cast("long")).over(before), F.lit(0)))
    odd = (F.col("so_far") - F.coalesce("fixed.swaps", F.lit(0))) % 2 == 1
    seen = seen.withColumn("inside", F.coalesce("fixed.open_after_outside", F.lit(False)) != odd)
    records = F.when(F.col("inside"), F.col("records_inside")).otherwise(F.col("records_outside"))
    blocks = seen.select(*_BLOCK, "inside", F.coalesce(F.sum(records).over(before), F.lit(0)).alias("first"), records.alias("records"))
    # rows of earlier files, each less its header: one row per file
    files = blocks.groupBy("file").agg(F.greatest(F.sum("records") - 1, F.lit(0)).alias("rows"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.join(files.select("file", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("earlier")), "file").select(*_BLOCK, "inside", "first", "earlier")


def _cut(lines: DataFrame, sep: str) -> DataFrame:
    """Pieces of records per block: whole records, a head that goes on a record of an earlier block,
    and an open end that goes on in a later one; ``place`` and ``number`` are those of the record a
    block started last."""

    def cut(batches):
        rule, block, state = _Quoting(sep), None, None
        out: list[tuple] = []
        held: list[str] = []
        head, seq, inside, earlier = False, -1, False, 0

        def close(still_open: bool):
            if held:
                out.append((*block[:2], seq, seq + earlier - 1, head, still_open, "\n".join(held)))
                held.clear()

        def ready():
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            out.clear()
            return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        for batch in batches:
            for of, texts, quoted, at in _of_blocks([batch]):
                if of != block:
                    close(inside)
                    state = batch.column(4)[at].as_py()
                    if state is None:
                        raise ValueError(f"the blocks of {of[0]} changed between two reads; keep spark.sql.files.maxPartitionBytes and the cluster's size while a table is read")
                    block, inside, head = of, state, state
                    seq, earlier = batch.column(5)[at].as_py() - 1, batch.column(6)[at].as_py()
                for text, q in zip(texts, quoted, strict=True):
                    if not inside:
                        close(False)
                        if not text:
                            continue
                        seq, head = seq + 1, False
                    held.append(text)
                    if q:
                        inside = rule.after(text, inside)
            yield ready()
        close(inside)
        yield ready()

    names = [x.split()[0] for x in _PIECES.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()]
    return lines.mapInArrow(cut, _PIECES)


def read_records(spark: SparkSession, path: str | Sequence[str], sep: str = ",", line_sep: str = "\n") -> DataFrame:
    """file, place (of the record in its file, from 0), number (of the row over all files, each less
    its header, from 0), record: the text of every CSV record.

    Empty lines outside quotes are no records. A file that ends inside quotes ends with that record.
    Blocks are Spark's file splits
    (``spark.sql.files.maxPartitionBytes``); a compressed file is one block. The block table, one row
    per block, is broadcast if its measured size is small; beyond that the lines are shuffled to
    their blocks and sorted back into their order."""
    lines = _lines(spark, path, line_sep)
    blocks = stored(block_table(lines, sep), "csv-states")
    local = small_copy(blocks)
    if local is not None:
        known = lines.join(F.broadcast(local), _BLOCK, "left")
    else:
        known = lines.withColumn("at", F.monotonically_increasing_id()).join(blocks, _BLOCK, "left").sortWithinPartitions("file", "start", "at")
    pieces = _cut(known.select(*_BLOCK, "line", "inside", "first", "earlier"), sep)
    # a record over several blocks: an open end, heads that stay open, and the head that closes it
    edges = pieces.where("head OR open")
    order = Window.partitionBy("file").orderBy("start", F.desc("head")).rowsBetween(Window.unboundedPreceding, 0)
    edges = edges.withColumn("of", F.sum((~F.col("head")).cast("long")).over(order))
    parts = F.array_sort(F.collect_list(F.struct("start", "record")))
    glued = edges.groupBy("file", "of").agg(
        F.min(F.when(~F.col("head"), F.struct("place", "number"))).alias("at"), F.array_join(F.transform(parts, lambda x: x["record"]), "\n").alias("record"))
    whole = pieces.where("NOT head AND NOT open").select("file", "place", "number", "record")
    return whole.unionByName(glued.select("file", "at.place", "at.number", "record"))


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str | None = None, sep: str = ",",
             key: str | None = None, options: Mapping[str, str] | None = None, line_sep: str = "\n") -> DataFrame:
    """A CSV table with a header in every file, read by many tasks per file.

    Without a schema the columns are those of the first file's header, as text. ``key`` adds a column
    with the row's number in file order, from 0 over all files by path; two reads give the same keys.
    Quotes are doubled inside quoted fields. Rows and values are those of Spark's multi-line reader,
    with two differences on broken quoting: text behind a closing quote that itself ends a record
    with two quotes keeps one of them only in Spark's reader, and a file that ends inside quotes
    loses its last line break here."""
    asked = {"quote": '"', "escape": '"', "sep": sep, "mode": "PERMISSIVE", **(options or {})}
    if schema is None:
        schema = spark.read.options(**asked, header="true", multiLine="true").csv(path).schema
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    rows = read_records(spark, path, sep, line_sep).where("place > 0")
    rows = rows.withColumn("__row", F.from_csv("record", _ddl(schema), asked))
    columns = [F.col("__row")[f.name].alias(f.name) for f in schema.fields]
    return rows.select(*([F.col("number").alias(key)] if key is not None else []), *columns)


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)
