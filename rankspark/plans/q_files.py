"""Queries over files that Spark writes from the driver tables and reads back: CSV, buckets, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.operators import folds, prepare, profile, sketches
from rankspark.plans import oracle as O
from rankspark.plans.catalog import register
from rankspark.session import checkpoint_dir, stored
from rankspark.sources import fixtures as fx
from rankspark.sources import io

R = O.with_ctes(O.RESPONSES)


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _from_csv(spark: SparkSession, sf: str, key: str) -> DataFrame:
    """The response table written as CSV in the order of its rows, and read back by blocks."""
    path = _folder(spark, "responses-csv")
    io.write_responses(fx.responses(spark, sf), path, header={"row_id": "id"})
    return io.read_responses(spark, path, {"id": "id"}, missing_tokens=False, key=key)


@register(
    "csv_file_order",
    R + """SELECT CAST(row_id AS VARCHAR) AS id, row_number() OVER (ORDER BY row_id) - 1 AS row_id, question_id, mc_answer,
        sha256(nullif(explanation, '')) AS explanation_sha, category, misconception FROM responses""",
    ("IO-1", "PF-10"),
)
def q_csv_file_order(spark, sf):
    """Quoted multi-line CSV by blocks; the key is the place in file order."""
    r = _from_csv(spark, sf, "row_id")
    return r.select("id", "row_id", "question_id", "mc_answer", F.sha2("explanation", 256).alias("explanation_sha"), "category", "misconception")


@register(
    "dedup_file_order",
    O.with_ctes(O.RESPONSES, O.DEDUP) + "SELECT CAST(row_id AS VARCHAR) AS id FROM dedup",
    ("AG-1", "IO-1", "PF-10"),
)
def q_dedup_file_order(spark, sf):
    """The first of equal rows in file order, by a key the file does not hold."""
    r = _from_csv(spark, sf, "place")
    return prepare.first_rows(r, ("mc_answer", "explanation"), "place", ["id"]).select("id")


@register(
    "bucketed_join",
    R + """SELECT row_id, label, fold, question_id, mc_answer FROM (
      SELECT *, CAST((row_number() OVER (ORDER BY label, md5('42:' || CAST(row_id AS VARCHAR)), row_id) - 1) % 5 AS INTEGER) AS fold
      FROM (SELECT *, concat(coalesce(category, 'NA'), ':', coalesce(misconception, 'NA')) AS label FROM responses) t) t""",
    ("IO-7", "JN-8"),
)
def q_bucketed_join(spark, sf):
    """Rows and folds in tables bucketed alike: their join needs no exchange."""
    rows = prepare.with_label(fx.responses(spark, sf)).select("row_id", "question_id", "mc_answer", "label")
    names = [f"rankspark_{n}_{uuid.uuid4().hex}" for n in ("rows", "folds")]
    clean = io.write_bucketed(rows, names[0], _folder(spark, "rows"), buckets=16)
    assigned = folds.stratified_folds(clean.select("row_id", "label"), "row_id", "label", 5, 42)
    kept = io.write_bucketed(assigned.select("row_id", "fold"), names[1], _folder(spark, "folds"), buckets=16)
    return folds.attach_folds(clean, kept, "row_id")


@register(
    "length_sketches",
    O.with_ctes(O.RESPONSES, O.DERIVED) + """SELECT expl_assess, count(n_words) AS count, round(avg(n_words), 6) AS mean, round(stddev_samp(n_words), 6) AS std,
        CAST(min(n_words) AS DOUBLE) AS min, CAST(max(n_words) AS DOUBLE) AS max, true AS within_error
        FROM derived WHERE expl_assess IS NOT NULL GROUP BY expl_assess""",
    ("AG-9", "AG-11"),
)
def q_length_sketches(spark, sf):
    """Lengths of three batches, sketched one by one, stored and merged; the quartiles' rank error is
    measured against all rows."""
    d = stored(profile.derive(fx.responses(spark, sf)).select("row_id", "expl_assess", "n_words"), "lengths")
    path = _folder(spark, "sketches")
    for batch in range(3):
        sketches.write_sketches(sketches.sketch_by(d.where(F.col("row_id") % 3 == batch), "expl_assess", "n_words"), path, str(batch))
    said = sketches.describe(sketches.read_sketches(spark, path, "expl_assess"), "expl_assess")
    error = sketches.measured_rank_error(d, said, "expl_assess", "n_words")
    return said.join(error, "expl_assess").select(
        "expl_assess", "count", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "min", "max",
        (F.col("rank_error") <= 2 * sketches.rank_error()).alias("within_error"))
