"""AG-9 to AG-11 on sketches: descriptions of a length that new data can be merged into.

A KLL sketch per key answers quantile and rank questions with a stated error; count, mean, spread,
minimum and maximum are exact sums beside it. Sketches of batches are small rows: they are stored, and
the description of everything comes from merging them, without reading old text. The exact functions
(``profile.describe_by``, ``profile.boxplot_by``) stay for data that is read anyway.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Size parameter of a sketch; see ``rank_error``.
SKETCH_K = 400


def rank_error(k: int = SKETCH_K) -> float:
    """Normalised rank error of a quantile at 99 % confidence, the published fit for KLL sketches:
    the value given for quantile q has a true rank within q plus or minus this."""
    return 2.296 / k ** 0.9723


def sketch_by(df: DataFrame, key: str, value: str, k: int = SKETCH_K) -> DataFrame:
    """One mergeable row per key (null keys left out, D-3): n, total, squares, lo, hi, sketch. Rows
    without a value are not counted; a key without values keeps a row without a sketch."""
    v = F.col(value).cast("double")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(v).alias("n"), F.sum(v).alias("total"), F.sum(v * v).alias("squares"), F.min(v).alias("lo"), F.max(v).alias("hi"),
        F.when(F.count(v) > 0, F.kll_sketch_agg_double(v, F.lit(k))).alias("sketch"))


def merge_sketches(*tables: DataFrame, key: str, k: int = SKETCH_K) -> DataFrame:
    """One table of sketches from many (batches, partitions, days), key by key."""
    rows = reduce(lambda a, b: a.unionByName(b), tables)
    return rows.groupBy(key).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.when(F.sum("n") > 0, F.kll_merge_agg_double("sketch", F.lit(k))).alias("sketch"))


def write_sketches(sketches: DataFrame, path: str, batch: str) -> None:
    """Store a batch's sketches; writing the same batch again replaces it."""
    sketches.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")


def read_sketches(spark: SparkSession, path: str, key: str, k: int = SKETCH_K) -> DataFrame:
    """The merged sketches of all stored batches."""
    return merge_sketches(spark.read.parquet(path).drop("batch"), key=key, k=k)


def _quantile(q: float | list[float]) -> Column:
    asked = F.array(*[F.lit(x) for x in q]) if isinstance(q, list) else F.lit(q)
    return F.kll_sketch_get_quantile_double("sketch", asked)


def describe(sketches: DataFrame, key: str) -> DataFrame:
    """The columns of ``profile.describe_by``; quartiles within ``rank_error``, the rest exact up to
    rounding. The quartiles are values of the data, not interpolated."""
    mean = F.when(F.col("n") > 0, F.col("total") / F.col("n"))
    spread = F.when(F.col("n") > 1, F.sqrt(F.greatest((F.col("squares") - F.col("n") * mean * mean) / (F.col("n") - 1), F.lit(0.0))))
    return sketches.select(
        key, F.col("n").alias("count"), mean.alias("mean"), spread.alias("std"), F.col("lo").alias("min"),
        *[_quantile(q).alias(f"q{int(100 * q)}") for q in (0.25, 0.5, 0.75)], F.col("hi").alias("max"))


#: Ranks at which a sketch is read to find the ends of the whiskers.
WHISKER_STEPS = 400


def boxplot(sketches: DataFrame, key: str, whis: float = 1.5) -> DataFrame:
    """The columns of ``profile.boxplot_by`` from sketches: quartiles within ``rank_error``; a whisker
    ends at the outermost of ``WHISKER_STEPS`` evenly ranked values inside its fence."""
    grid = _quantile([i / WHISKER_STEPS for i in range(WHISKER_STEPS + 1)])
    d = describe(sketches, key).join(sketches.select(key, grid.alias("grid")), key).where("count > 0")
    reach = whis * (F.col("q75") - F.col("q25"))
    low = F.array_min(F.filter("grid", lambda v: v >= F.col("q25") - reach))
    high = F.array_max(F.filter("grid", lambda v: v <= F.col("q75") + reach))
    return d.select(
        key, F.col("count").alias("n"), "mean", F.col("q25").alias("q1"), F.col("q50").alias("med"), F.col("q75").alias("q3"),
        F.least(low, F.col("q25")).alias("whislo"), F.greatest(high, F.col("q75")).alias("whishi"))


def measured_rank_error(df: DataFrame, described: DataFrame, key: str, value: str) -> DataFrame:
    """Per key the largest distance in rank between a described quartile and the data: 0 where the
    asked rank lies between the shares of rows below and up to the value."""
    quartiles = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    rows = df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("__v"))
    counted = rows.groupBy(key, "__v").agg(F.count(F.lit(1)).alias("__c")).join(described.select(key, *quartiles), key)
    sums = counted.groupBy(key).agg(
        F.sum("__c").alias("n"),
        *[F.sum(F.when(F.col("__v") < F.col(c), F.col("__c")).otherwise(0)).alias(f"{c}_below") for c in quartiles],
        *[F.sum(F.when(F.col("__v") <= F.col(c), F.col("__c")).otherwise(0)).alias(f"{c}_upto") for c in quartiles])
    off = [F.greatest(F.col(f"{c}_below") / F.col("n") - q, q - F.col(f"{c}_upto") / F.col("n"), F.lit(0.0)) for c, q in quartiles.items()]
    return sums.select(key, F.greatest(*off).alias("rank_error"))
