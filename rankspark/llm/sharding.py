"""Shards by a hierarchical weighted hash tree: region, rack, shard.

Every level draws one hash per child, divides its negative logarithm by the child's weight and goes
on with the smallest draw, so a child is chosen in proportion to its weight. A draw depends on the
key and on the child alone:

* when a weight changes, rows move only into a subtree that grew or out of one that shrank, at each
  level of the changed path; siblings exchange nothing;
* shards that join later stand in a subtree of their own beside the first regions, so no old weight
  changes and rows move into them only.

Everything here is DataFrame expressions. The tree is a literal of the plan; its size is that of the
cluster, not of the data.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankspark.llm.common import materialize, same

#: Bits of a hash draw: exact in a double.
BITS = 52
#: Shards that the default tree is first built with; later ones join one at a time.
FIRST = 8
RACKS_PER_REGION = 2
SHARDS_PER_RACK = 2
#: Distinct rows that one numbering task sorts, about.
ROWS_PER_BUCKET = 200_000
#: Equal rows that one task writes out at most.
COPIES_PER_CHUNK = 100_000
CHILDREN = "array<array<struct<id:int,path:string,weight:double>>>"


@dataclass(frozen=True)
class Leaf:
    """A shard, where it stands, its weight, and the growth step it joined in (0: first build)."""

    region: str
    rack: str
    shard: int
    weight: float = 1.0
    joined: int = 0


def tree_of(shards: int, first: int = FIRST) -> list[Leaf]:
    """The default tree of so many equal shards: ``first`` in the first build, then one by one."""
    per_region = RACKS_PER_REGION * SHARDS_PER_RACK
    return [
        Leaf(f"r{s // per_region}", f"k{s // SHARDS_PER_RACK % RACKS_PER_REGION}", s, 1.0, 0 if s < first else s - first + 1)
        for s in range(shards)
    ]


def _nodes(tree: Sequence[Leaf]) -> tuple[list[list[dict]], list[int | None]]:
    """Children of every node (root first) and the shard of every node that is a leaf.

    A region of a later growth step is another child of the root than the same region of an earlier
    one. Weights add up from the leaves; leaves without weight get no row."""
    children: list[list[dict]] = [[]]
    shards: list[int | None] = [None]
    ids = {"": 0}
    for leaf in sorted(tree, key=lambda x: (x.joined, x.region, x.rack, x.shard)):
        if leaf.weight < 0:
            raise ValueError(f"shard {leaf.shard} has a negative weight")
        if not leaf.weight:
            continue
        region = f"{leaf.joined}:{leaf.region}"
        paths = ["", region, f"{region}/{leaf.rack}", f"{region}/{leaf.rack}/{leaf.shard}"]
        for up, path in zip(paths, paths[1:], strict=False):
            if path not in ids:
                ids[path] = len(children)
                children.append([])
                shards.append(leaf.shard if path == paths[-1] else None)
                children[ids[up]].append({"id": ids[path], "path": path, "weight": 0.0})
            next(c for c in children[ids[up]] if c["path"] == path)["weight"] += leaf.weight
    if len(children) == 1:
        raise ValueError("a tree needs a shard with a weight above 0")
    return children, shards


def hash_bits(text: Column) -> Column:
    """The first 52 bits of the MD5 of a string, as a long."""
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")


def place(df: DataFrame, key: Column, tree: Sequence[Leaf], out: str = "shard") -> DataFrame:
    """Add column ``out``: the shard of every row. Row by row, without a shuffle; a null key counts
    as the empty string. Any key will do: a digest of the text keeps equal texts together."""
    children, shards = _nodes(tree)
    kids = F.from_json(F.lit(json.dumps(children)), CHILDREN)
    text = F.coalesce(key.cast("string"), F.lit(""))

    def draw(child: Column) -> Column:
        u = (hash_bits(F.concat(text, F.lit("|"), child["path"])) + F.lit(0.5)) / F.lit(float(2**BITS))
        return F.struct((-F.log(u) / child["weight"]).alias("draw"), child["id"].alias("id"))

    # one projection a level: the node drawn above is a column, so no draw is computed twice
    steps = [f"__{out}_{level}" for level in ("region", "rack", "shard")]
    node: Column = F.lit(0)
    for step in steps:
        df = df.withColumn(step, F.array_min(F.transform(F.element_at(kids, node + 1), draw))["id"])
        node = F.col(step)
    numbers = F.from_json(F.lit(json.dumps([-1 if s is None else s for s in shards])), "array<int>")
    return df.withColumn(out, F.element_at(numbers, node + 1)).drop(*steps)


def numbered(rows: DataFrame, shard: str, order: str, out: str = "slot") -> DataFrame:
    """Add ``out``: gapless numbers from 0 within each shard, in the order of ``order`` (a hash of
    ``BITS`` bits of all other columns) and then of the columns.

    Equal rows are counted first, so a row repeated any number of times is one row until the end.
    Buckets are ranges of the hash; each is numbered by itself and shifted by the rows of earlier
    buckets, so no shard passes through one task. The number of buckets never changes a slot."""
    columns = rows.columns
    distinct = materialize(rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n")), "distinct-rows")
    bits = max(0, -(-distinct.count() // ROWS_PER_BUCKET) - 1).bit_length()
    distinct = distinct.withColumn("__bucket", F.shiftright(order, BITS - bits).cast("int"))
    run = (Window.unboundedPreceding, Window.currentRow)
    counts = distinct.groupBy(shard, "__bucket").agg(F.sum("__n").alias("__in"))
    before = Window.partitionBy(shard).orderBy("__bucket").rowsBetween(*run)
    offsets = counts.select(F.col(shard).alias("__s"), F.col("__bucket").alias("__b"), (F.sum("__in").over(before) - F.col("__in")).alias("__off"))
    inside = Window.partitionBy(shard, "__bucket").orderBy(order, *[c for c in columns if c not in (shard, order)]).rowsBetween(*run)
    starts = distinct.withColumn("__at", F.sum("__n").over(inside) - F.col("__n"))
    starts = starts.join(offsets, same(F.col(shard), F.col("__s")) & (F.col("__bucket") == F.col("__b")))
    starts = starts.withColumn("__at", F.col("__at") + F.col("__off")).select(*columns, "__n", "__at")
    single = starts.where("__n = 1").select(*columns, F.col("__at").alias(out))
    end = F.col("__at") + F.col("__n") - 1
    chunks = starts.where("__n > 1").select(*columns, end.alias("__end"), F.explode(F.sequence("__at", end, F.lit(COPIES_PER_CHUNK).cast("long"))).alias("__at"))
    last = F.least(F.col("__at") + COPIES_PER_CHUNK - 1, F.col("__end"))
    copies = chunks.repartition("__at", "__end").select(*columns, F.explode(F.sequence("__at", last)).alias(out))
    return single.unionByName(copies)


def shard_rows(docs: DataFrame, shards: int = FIRST) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of ``docs``.

    ``law`` is ``key``: doc_id and the number of shards alone decide the shard, whatever the texts;
    equal texts under different ids are spread like any others. ``grown_shard`` is the shard in the
    tree with one shard more. ``size`` is the text's bytes plus 1; a null text has no bytes and the
    CRC of no bytes, 0. Rows without doc_id share one key. Repeated rows each get a slot of their own;
    slots follow a hash of (doc_id, size, crc), a fixed shuffled order of the shard. An empty table
    gives no rows; other columns are not looked at.

    The text is read once and only its size and checksum go on."""
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(F.encode(body, "utf-8")).alias("text_crc32"))
    rows = place(rows, F.col("doc_id"), tree_of(shards), "shard")
    rows = place(rows, F.col("doc_id"), tree_of(shards + 1), "grown_shard")
    order = hash_bits(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size", "text_crc32"))
    out = numbered(rows.withColumn("__order", order), "shard", "__order")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, tree: Sequence[Leaf], key: Column | None = None, max_records: int = 1_000_000) -> None:
    """Write whole rows into one folder a shard (``shard=N``). Rows are not moved between tasks
    first, so no shard meets in one task; files hold at most ``max_records`` rows."""
    placed = place(docs, F.col("doc_id") if key is None else key, tree)
    placed.write.partitionBy("shard").option("maxRecordsPerFile", max_records).parquet(path)
