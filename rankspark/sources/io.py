"""IO-1..12: readers and writers for response tables, items, rankings and reports.

Every table carries an explicit key (``row_id`` / ``item_id``): files have no usable line
order on a cluster, so nothing is aligned by position (D-1).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankspark.operators.prepare import normalise_missing
from rankspark.sources import split_csv

# --- fixed values: names of the exchange files and the canonical columns they map to --------
RESPONSE_COLUMNS = {
    "row_id": "row_id",
    "QuestionId": "question_id",
    "QuestionText": "question_text",
    "MC_Choices": "choices",
    "Answer": "correct_answer",
    "MisconceptionCandidates": "misconception_candidates",
    "MC_Answer": "mc_answer",
    "StudentExplanation": "explanation",
    "SuffixCandidates": "suffix_candidates",
    "Category": "category",
    "Misconception": "misconception",
    "LabelIndex": "label_idx",
}
# bundle field in an item file -> bundle field of ``prompts.to_items``
BUNDLE_FIELDS = {
    "QuestionText": "question",
    "MC_Choices": "choices",
    "Answer": "answer",
    "MisconceptionCandidates": "misconceptions",
    "MC_Answer": "student_answer",
    "StudentExplanation": "explanation",
}
# --------------------------------------------------------------------------------------------

# Columns that are not text; everything else is read as text, without an inference pass.
COLUMN_TYPES = {"row_id": "bigint", "label_idx": "bigint"}

BUNDLE = T.StructType([T.StructField(name, T.StringType()) for name in BUNDLE_FIELDS])
ITEM_SCHEMA = T.StructType([
    T.StructField("row_id", T.LongType()),
    T.StructField("bundle", BUNDLE),
    T.StructField("suffixes", T.ArrayType(T.StringType())),
    T.StructField("label", T.LongType()),
    T.StructField("_corrupt_record", T.StringType()),
])
RANKING_SCHEMA = T.StructType([
    T.StructField("row_id", T.LongType()),
    T.StructField("y_true", T.LongType()),
    T.StructField("ranks", T.ArrayType(T.LongType())),
])


def map_columns(df: DataFrame, mapping: Mapping[str, str] | None = None) -> DataFrame:
    """PF-1: rename source columns (file name -> canonical name); others pass. Entries of
    ``mapping`` go before the file format's own names."""
    names = {**RESPONSE_COLUMNS, **(mapping or {})}
    return df.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns])


def read_responses(spark: SparkSession, path: str | Sequence[str], mapping: Mapping[str, str] | None = None,
                   schema: T.StructType | str | None = None, missing_tokens: bool = True, key: str | None = "row_id") -> DataFrame:
    """IO-1 + PF-1 + PF-2 + PF-10: header CSV with quoted multi-line text, read by many tasks per
    file (``split_csv``); canonical column names, pandas-style missing tokens turned into nulls, and
    keys and indices as numbers (``COLUMN_TYPES``). Without a schema nothing is inferred from the
    data; a key that is no number raises when read. Files without column ``key`` get it: the row's
    place in file order, the same at every read."""
    df = map_columns(split_csv.read_csv(spark, path, schema, key="__place"), mapping)
    if missing_tokens:
        df = normalise_missing(df)
    df = df.withColumnRenamed("__place", key) if key is not None and key not in df.columns else df.drop("__place")
    return df.select(*[F.col(f"`{c}`").cast(COLUMN_TYPES[c]).alias(c) if c in COLUMN_TYPES else F.col(f"`{c}`") for c in df.columns])


def write_responses(df: DataFrame, path: str, key: str = "row_id", header: Mapping[str, str] | None = None) -> None:
    """IO-1, the other way: a response table as header CSV in the order of ``key`` (files by ranges
    of the key, sorted inside), with the file format's column names. Nulls become empty fields,
    empty texts quoted ones; Spark reads both back as null."""
    names = {v: k for k, v in RESPONSE_COLUMNS.items()} | dict(header or {})
    ordered = df.repartitionByRange(key).sortWithinPartitions(key)
    out = ordered.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns])
    out.write.options(header="true", quote='"', escape='"', ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)


def with_row_id(df: DataFrame, col: str = "row_id") -> DataFrame:
    """PF-10 for tables that do not come from ``read_responses``: a unique key in partition order,
    not repeatable (persist the result before relying on it)."""
    return df if col in df.columns else df.withColumn(col, F.monotonically_increasing_id())


def canonical_items(raw: DataFrame) -> DataFrame:
    """Items of a file as ``prompts.with_prefix`` and ``prompts.explode_prompts`` read them."""
    fields = [F.col(f"bundle.{name}").alias(field) for name, field in BUNDLE_FIELDS.items()]
    return raw.withColumn("bundle", F.when(F.col("bundle").isNotNull(), F.struct(*fields)))


def read_items(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """IO-2: item JSONL (bundle + suffixes [+ label]); malformed lines kept in ``_corrupt_record``."""
    return canonical_items(spark.read.schema(ITEM_SCHEMA).option("mode", "PERMISSIVE").json(path))


def write_items(items: DataFrame, path: str) -> None:
    """IO-2: items as JSON lines with the file format's bundle names."""
    fields = [F.col(f"bundle.{field}").alias(name) for name, field in BUNDLE_FIELDS.items()]
    items.withColumn("bundle", F.when(F.col("bundle").isNotNull(), F.struct(*fields))).write.mode("overwrite").json(path)


def read_runs(spark: SparkSession, paths: Sequence[str], schema: T.StructType = RANKING_SCHEMA) -> DataFrame:
    """IO-3 + SO-1: many ranking files (paths or globs); ``run`` = the source file, or the
    output folder for Spark-written ``part-*`` files."""
    df = spark.read.schema(schema).json(list(paths))
    return df.withColumn("run", F.regexp_replace(F.col("_metadata.file_path"), "/part-[^/]*$", ""))


def read_rankings(spark: SparkSession, path: str, schema: T.StructType = RANKING_SCHEMA) -> DataFrame:
    """IO-4: one ranking file, optional ``y_true`` per record."""
    return spark.read.schema(schema).json(path)


def write_labels(vocab: DataFrame, path: str) -> None:
    """IO-5: label vocabulary as a small Parquet table ``(label, label_idx)``."""
    vocab.coalesce(1).write.mode("overwrite").parquet(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_labels_json(spark: SparkSession, path: str) -> DataFrame:
    """IO-5, the list-shaped file ``{"labels": [...]}``: position = index."""
    raw = spark.read.option("multiLine", True).schema("labels array<string>").json(path)
    return raw.select(F.posexplode("labels").alias("label_idx", "label")).select(
        "label", F.col("label_idx").cast("long").alias("label_idx")
    )


def write_folds(folds: DataFrame, path: str, key: str = "row_id") -> None:
    """IO-6: fold assignment ``(key, fold)``."""
    folds.select(key, "fold").write.mode("overwrite").parquet(path)


def write_clean(df: DataFrame, path: str) -> None:
    """IO-7: cleaned table partitioned by fold, so fold filters prune directories."""
    df.write.mode("overwrite").partitionBy("fold").parquet(path)


def write_bucketed(df: DataFrame, name: str, path: str, key: str = "row_id", buckets: int = 64) -> DataFrame:
    """IO-7, co-located: a table in ``buckets`` files by the hash of ``key``, sorted by it. Two tables
    bucketed alike join on the key without moving a row, so clean rows, folds, truth and predictions
    (JN-5, JN-8) are shuffled once, when they are written. ``name``: a catalog table over ``path``."""
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)


def write_rankings(df: DataFrame, path: str) -> None:
    """IO-8: rankings as JSON lines, key included."""
    df.write.mode("overwrite").json(path)


def write_metrics(map_df: DataFrame, confusion: DataFrame, path: str) -> None:
    """IO-9: MAP (formatted to 6 decimals, SC-7) and the long confusion table."""
    map_df.select("*", F.format_number("map", 6).alias("map_text")).coalesce(1).write.mode("overwrite") \
        .option("header", True).csv(f"{path}/map")
    confusion.write.mode("overwrite").option("header", True).csv(f"{path}/confusion")


def write_table_csv(df: DataFrame, path: str) -> None:
    """IO-10 / IO-11: profile tables and the submission as header CSV."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_best(best: DataFrame, path: str) -> None:
    """IO-12: the best trial (value and parameters) as one JSON record."""
    best.coalesce(1).write.mode("overwrite").json(path)
