"""ST-1, IO-2: item files to rankings, with rejected lines kept and every batch written once.

A micro-batch is written by its number into folders of its own, rankings first, rejects second, each
replaced as a whole. Spark's checkpoint fixes which files a batch number holds, so a batch that is run
again after a failure writes the same folders again: nothing is doubled, and no bad line is lost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rankspark.operators.prompts import with_prefix
from rankspark.session import stored
from rankspark.sources.io import ITEM_SCHEMA, canonical_items
from rankspark.streaming.rankings import rank_stream

REJECT_COLUMNS = ["file", "line", "reason"]


def sort_out(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, rejects) of raw item lines (``ITEM_SCHEMA`` and ``file``): rejects are lines that are no
    JSON of the schema, have no row_id, or no candidates, with the reason and what was read."""
    reason = (
        F.when(F.col("_corrupt_record").isNotNull(), F.lit("not an item"))
        .when(F.col("row_id").isNull(), F.lit("no row_id"))
        .when(F.col("suffixes").isNull() | (F.size("suffixes") == 0), F.lit("no candidates")))
    sorted_out = raw.withColumn("reason", reason)
    line = F.coalesce("_corrupt_record", F.to_json(F.struct("row_id", "bundle", "suffixes", "label")))
    rejects = sorted_out.where("reason IS NOT NULL").select("file", line.alias("line"), "reason")
    return sorted_out.where("reason IS NULL").drop("reason", "file"), rejects


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """One batch's rows into its own folder, replacing what an earlier attempt left there."""
    rows.write.mode("overwrite").json(f"{path.rstrip('/')}/batch={batch_id}")


def stream_items_once(spark: SparkSession, in_dir: str, out_dir: str, reject_dir: str, checkpoint: str,
                      score: Callable[[DataFrame], DataFrame], available_now: bool = True,
                      max_files_per_trigger: int | None = None) -> StreamingQuery:
    """JSON lines of items -> prefix -> ``score(items) -> items with logits`` -> rankings in
    ``out_dir/batch=N``; what cannot be scored in ``reject_dir/batch=N`` (``sort_out``).

    ``checkpoint`` must be a shared folder on a cluster. The parsed lines of a batch are stored once and
    feed both sinks. Restart the stream with the same folders after a failure."""
    reader = spark.readStream.schema(ITEM_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.json(in_dir).withColumn("file", F.col("_metadata.file_path"))

    def write(batch: DataFrame, batch_id: int) -> None:
        items, rejects = sort_out(stored(batch, "item-batch"))
        write_batch(rank_stream(score(with_prefix(canonical_items(items)))), out_dir, batch_id)
        write_batch(rejects, reject_dir, batch_id)

    writer = raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
