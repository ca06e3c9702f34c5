"""ST-1: score and rank each arriving item file, appending rankings.

Ranking is row-local (array form of WN-5), so the streaming plan has no shuffle, no state
and no window; the checkpoint makes the file source and the file sink exactly-once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from rankspark.functions.arrays import rank_desc
from rankspark.operators.prompts import with_prefix
from rankspark.sources.io import ITEM_SCHEMA, canonical_items

SCORED_ITEM_SCHEMA = "row_id long, logits array<double>"


def rank_stream(items: DataFrame, logits_col: str = "logits", key: str = "row_id") -> DataFrame:
    """Rankings of a (streaming or batch) frame of scored items: ``row_id, ranks``."""
    return items.select(key, rank_desc(logits_col, ties="low").alias("ranks"))


def stream_rankings(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str,
                    schema: str = SCORED_ITEM_SCHEMA, available_now: bool = True,
                    max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start the stream: JSON lines in ``in_dir`` -> rankings as JSON lines in ``out_dir``.

    ``checkpoint`` must be a shared folder on a cluster (e.g. under spark.checkpoint.dir).
    """
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    ranked = rank_stream(reader.json(in_dir))
    writer = ranked.writeStream.format("json").option("checkpointLocation", checkpoint).outputMode("append")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start(out_dir)


def stream_items(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, score,
                 available_now: bool = True, max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Item files to rankings: JSON lines of items -> prompts' prefix -> ``score(items) -> items
    with logits`` (row-local, one score per entry of ``suffixes``) -> rankings."""
    reader = spark.readStream.schema(ITEM_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    items = with_prefix(canonical_items(reader.json(in_dir)).where("_corrupt_record IS NULL"))
    writer = rank_stream(score(items)).writeStream.format("json").option("checkpointLocation", checkpoint).outputMode("append")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start(out_dir)


def stream_scores(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, score,
                  schema: str, available_now: bool = True) -> StreamingQuery:
    """Variant for rows of any schema, scored by a row-local ``score(df) -> df with logits``."""
    scored = score(spark.readStream.schema(schema).json(in_dir))
    writer = rank_stream(scored).writeStream.format("json").option("checkpointLocation", checkpoint).outputMode("append")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start(out_dir)
