"""E1 prepare: dedup, labels, vocabulary, encoding, candidate lists, per-question tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankspark.functions.text import (
    ANSWER_PREFIX_TRUE,
    MISSING_LABEL_PART,
    label_string,
    null_tokens,
)
from rankspark.operators.joins import lookup_join
from rankspark.operators.windows import global_row_number
from rankspark.session import stored


def normalise_missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """PF-2: missing tokens become null in the given (default: all string) columns."""
    if columns is None:
        columns = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    return df.select(*[null_tokens(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def key_digest(keys: Sequence[str]) -> Column:
    """SHA-256 of key columns, each with its length or a null mark, so that equal digests mean
    equal keys and null equals null."""
    parts = []
    for k in keys:
        text = F.col(k).cast("string")
        parts += [F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))]
    return F.sha2(F.concat_ws("|", *parts), 256)


def first_rows(df: DataFrame, keys: Sequence[str] = ("question_id", "mc_answer", "explanation"),
               order_col: str = "row_id", carry: Sequence[str] = ()) -> DataFrame:
    """AG-1, narrow: ``order_col`` and the ``carry`` columns of the first row (smallest
    ``order_col``) of every key. The keys are reduced to a digest before anything moves, and
    copies collapse in the map-side partial aggregate, so no text is sorted or shuffled."""
    narrow = df.select(key_digest(keys).alias("__key"), F.struct(order_col, *carry).alias("__row"))
    first = narrow.groupBy("__key").agg(F.min_by("__row", F.col(f"__row.{order_col}")).alias("__row"))
    return first.select("__row.*")


def dedup_responses(
    df: DataFrame,
    keys: Sequence[str] = ("question_id", "mc_answer", "explanation"),
    order_col: str = "row_id",
) -> DataFrame:
    """AG-1: keep the first row (smallest ``order_col``, a unique row key) of every key; null
    equals null. Only kept rows' keys are joined back, so text moves once."""
    kept = df.select(key_digest(keys).alias("__key"), order_col).groupBy("__key").agg(F.min(order_col).alias(order_col))
    return df.join(kept.select(order_col), order_col, "left_semi").select(*df.columns)


def with_label(df: DataFrame, category: str = "category", misconception: str = "misconception",
               out: str = "label") -> DataFrame:
    """PF-4: canonical label column."""
    return df.withColumn(out, label_string(category, misconception))


def label_vocab(df: DataFrame, label_col: str = "label") -> DataFrame:
    """AG-2 + WN-1: sorted distinct labels with a dense 0-based index, by a sample sort of the
    distinct labels (stored), however many there are."""
    distinct = df.select(F.col(label_col).alias("label")).where(F.col("label").isNotNull()).distinct()
    numbered, _ = global_row_number(distinct, ["label"], "label_idx")
    return numbered.select("label", (F.col("label_idx") - 1).alias("label_idx"))


def encode_labels(df: DataFrame, vocab: DataFrame, label_col: str = "label", out: str = "label_idx",
                  how: str = "left") -> DataFrame:
    """JN-1: label -> index by an equi join with the (size-checked) vocabulary."""
    v = vocab.select(F.col("label").alias(label_col), F.col("label_idx").alias(out))
    return lookup_join(df, v, label_col, how)


def decode_labels(df: DataFrame, vocab: DataFrame, idx_col: str, out: str) -> DataFrame:
    """JN-2: index -> label name by an equi join with the vocabulary."""
    v = vocab.select(F.col("label_idx").alias(idx_col), F.col("label").alias(out))
    return lookup_join(df, v, idx_col, "left")


def label_list(vocab: DataFrame) -> Column:
    """The vocabulary as one array in index order: a scalar subquery of the plan that uses it."""
    pairs = F.array_sort(F.collect_list(F.struct("label_idx", "label")))
    return vocab.agg(F.transform(pairs, lambda s: s["label"]).alias("labels")).scalar()


def attach_all_candidates(df: DataFrame, vocab: DataFrame, out: str = "candidates") -> DataFrame:
    """JN-3: every row gets the full sorted label list (no join; any number of labels)."""
    return df.withColumn(out, label_list(vocab))


def question_misconceptions(df: DataFrame, question: str = "question_id",
                            misconception: str = "misconception") -> DataFrame:
    """AG-3: sorted distinct misconceptions per question (partial aggregation per key). Pairs are
    made distinct first, so a task gathers a question's distinct values, not its rows."""
    return df.select(question, misconception).distinct().groupBy(question).agg(
        F.array_sort(F.collect_list(misconception)).alias("misconceptions")
    )


def candidate_list(misconceptions: str = "misconceptions"):
    """JN-4 rule as a column: {True,False} x {Correct:NA, Neither:NA} plus
    {True,False}_Misconception:m for every misconception m of the question, sorted."""
    base = [
        f"{ans}_{kind}:{MISSING_LABEL_PART}"
        for ans in ("True", "False")
        for kind in ("Correct", "Neither")
    ]
    ms = F.col(misconceptions)
    mis = F.concat(
        F.transform(ms, lambda m: F.concat(F.lit("True_Misconception:"), m)),
        F.transform(ms, lambda m: F.concat(F.lit("False_Misconception:"), m)),
    )
    return F.array_sort(F.concat(F.array(*[F.lit(b) for b in base]), mis))


def question_candidates(per_question: DataFrame, question: str = "question_id",
                        misconceptions: str = "misconceptions", out: str = "candidates") -> DataFrame:
    """JN-4: the candidate list per question."""
    return per_question.select(question, candidate_list(misconceptions).alias(out))


def attach_question_candidates(df: DataFrame, question: str = "question_id",
                               misconception: str = "misconception", out: str = "candidates") -> DataFrame:
    """JN-4: per-question candidate list joined back on the question key."""
    cands = question_candidates(question_misconceptions(df, question, misconception), question, out=out)
    return lookup_join(df, cands, question, "left", null_safe=True)


def attach_candidates(df: DataFrame, vocab: DataFrame, scope: str = "all", question: str = "question_id",
                      misconception: str = "misconception", out: str = "candidates") -> DataFrame:
    """JN-3 / JN-4: candidate list per row, the full vocabulary (``scope="all"``) or the
    question-specific list (``scope="question"``)."""
    if scope == "all":
        return attach_all_candidates(df, vocab, out)
    if scope == "question":
        return attach_question_candidates(df, question, misconception, out)
    raise ValueError(f"unknown scope {scope!r}")


def answer_key(df: DataFrame, question: str = "question_id", answer: str = "mc_answer",
               category: str = "category") -> DataFrame:
    """AG-19: most frequent answer among rows whose category says the answer was right.

    Ties go to the smaller answer text; two partial aggregations, no window.
    """
    counted = (
        df.where(F.col(category).startswith(ANSWER_PREFIX_TRUE) & F.col(answer).isNotNull())
        .groupBy(question, answer)
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    return counted.groupBy(question).agg(
        F.min_by(F.col(answer), F.struct((-F.col("__n")).alias("n"), F.col(answer).alias("a"))).alias("answer")
    )


def question_choices(df: DataFrame, question: str = "question_id", answer: str = "mc_answer") -> DataFrame:
    """Choices shown for a question: its distinct answers, sorted, joined by ``, ``."""
    return df.groupBy(question).agg(
        F.array_join(F.array_sort(F.collect_set(answer)), ", ").alias("choices")
    )


@dataclass
class Prepared:
    clean: DataFrame   # rows + label, label_idx, candidates, fold
    labels: DataFrame  # label, label_idx


def prepare(df: DataFrame, k: int = 5, seed: int = 42,
            dedup_keys: Sequence[str] = ("question_id", "mc_answer", "explanation"),
            candidates: str = "all", stratum: str = "label", key: str = "row_id") -> Prepared:
    """E1: missing tokens -> dedup -> label -> vocabulary -> encode -> candidates -> folds.

    ``candidates="all"`` attaches the whole label list (JN-3), ``"question"`` the
    question-specific list (JN-4). Folds are stratified on ``stratum`` (D-14). Everything is
    worked out on the narrow columns of the first rows, stored once; the other columns, long text
    among them, are joined last by the row key.
    """
    from rankspark.operators.folds import stratified_folds

    src = normalise_missing(df)
    narrow = ["question_id", "category", "misconception"]
    if stratum not in (*narrow, "label", key):
        narrow.append(stratum)
    first = stored(with_label(first_rows(src, dedup_keys, key, narrow)), "first-rows")
    vocab = label_vocab(first)
    folded = stratified_folds(encode_labels(first, vocab), key, stratum, k, seed)
    folded = attach_candidates(folded, vocab, candidates)
    wide = [c for c in src.columns if c not in narrow]
    return Prepared(src.select(*wide).join(folded, key).select(*src.columns, "label", "label_idx", "fold", "candidates"), vocab)
