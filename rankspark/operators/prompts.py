"""PF-8, SC-3, SC-4, ML-7: items, prompt prefixes, per-candidate prompts, packing.

Long text is never shuffled per candidate: per-question tables are aggregated first and
joined to the rows, the prefix is rendered once per row, and candidates are exploded last
(a narrow step).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.functions.text import PREFIX_FIELDS, parse_candidates, render_prefix, word_count, word_count_arrow
from rankspark.operators.joins import lookup_join
from rankspark.operators.prepare import answer_key, candidate_list

DEFAULT_MAX_LENGTH = 2048  # token budget of the packed sequence (training config)


def per_question(responses: DataFrame, question: str = "question_id") -> DataFrame:
    """Prompt fields shared by a question: choices, answer key, misconceptions, candidates, and
    the candidates' words.

    Answers and misconceptions are made distinct before they are gathered, so a task holds a
    question's distinct values; the result has one row per question.
    """
    def distinct_list(column: str, out: str) -> DataFrame:
        values = responses.where(F.col(column).isNotNull()).select(question, column).distinct()
        return values.groupBy(question).agg(F.array_sort(F.collect_list(column)).alias(out))

    sets = responses.select(question).distinct().join(distinct_list("mc_answer", "__answers"), question, "left")
    sets = sets.join(distinct_list("misconception", "misconceptions"), question, "left")
    empty = F.array().cast("array<string>")
    pq = sets.withColumns({"__answers": F.coalesce("__answers", empty), "misconceptions": F.coalesce("misconceptions", empty)}).select(
        question,
        F.array_join("__answers", ", ").alias("choices"),
        F.array_join("misconceptions", ", ").alias("misconception_text"),
        candidate_list("misconceptions").alias("candidates"),
    )
    words = F.aggregate(F.transform("candidates", word_count), F.lit(0).cast("long"), lambda a, b: a + b)
    return pq.withColumn("suffix_words", words).join(answer_key(responses, question), question, "left")


# Bundle fields that a response table may bring along: field -> its canonical column.
SUPPLIED_FIELDS = {
    "question": "question_text",
    "choices": "choices",
    "answer": "correct_answer",
    "misconceptions": "misconception_candidates",
}


def to_items(responses: DataFrame, question: str = "question_id") -> DataFrame:
    """PF-8 + PF-9: one item per row: ``row_id``, ``bundle`` struct, ``suffixes`` list and
    ``suffix_words``.

    Question text, choices, answer and misconception list are taken from the response table where
    it has their columns (``SUPPLIED_FIELDS``) and a value there; otherwise they are derived per
    question, and the question's id stands for its text. ``suffix_candidates``, if present, is the
    candidate list (an array, or text that ``parse_candidates`` reads).
    """
    pq = per_question(responses, question).select(
        question, F.col("choices").alias("__choices"), F.col("answer").alias("__answer"),
        F.col("misconception_text").alias("__misconceptions"), F.col("candidates").alias("__candidates"), F.col("suffix_words").alias("__words"),
    )
    j = lookup_join(responses, pq, question, "left", null_safe=True)
    derived = {"question": F.col(question).cast("string"), "choices": F.col("__choices"), "answer": F.col("__answer"), "misconceptions": F.col("__misconceptions")}
    fields = [
        (F.coalesce(F.col(SUPPLIED_FIELDS[name]).cast("string"), value) if SUPPLIED_FIELDS[name] in responses.columns else value).alias(name)
        for name, value in derived.items()
    ]
    bundle = F.struct(*fields, F.col("mc_answer").alias("student_answer"), F.col("explanation"))
    suffixes, words = F.col("__candidates"), F.col("__words")
    if "suffix_candidates" in responses.columns:
        own = F.col("suffix_candidates")
        own = own if responses.schema["suffix_candidates"].dataType.typeName() == "array" else parse_candidates(own)
        counted = F.aggregate(F.transform(own, word_count), F.lit(0).cast("long"), lambda a, b: a + b)
        suffixes, words = F.coalesce(own, suffixes), F.when(own.isNotNull(), counted).otherwise(words)
    return j.select("row_id", bundle.alias("bundle"), suffixes.alias("suffixes"), words.alias("suffix_words"))


def with_prefix(items: DataFrame, bundle: str = "bundle", out: str = "prefix") -> DataFrame:
    """SC-3: render the shared prefix once per item."""
    b = F.col(bundle)
    return items.withColumn(out, render_prefix({name: b[name] for name in PREFIX_FIELDS}))


def explode_prompts(items: DataFrame, prefix: str = "prefix", suffixes: str = "suffixes",
                    key: str = "row_id") -> DataFrame:
    """SC-4: one prompt per candidate = prefix + candidate (narrow explode, no shuffle)."""
    e = items.select(key, prefix, F.posexplode(suffixes).alias("cand_pos", "candidate"))
    return e.select(key, F.col("cand_pos").cast("long").alias("cand_pos"), "candidate",
                    F.concat(F.col(prefix), F.col("candidate")).alias("prompt"))


def packing_budget(items: DataFrame, max_length: int = DEFAULT_MAX_LENGTH, prefix: str = "prefix",
                   suffixes: str = "suffixes", key: str = "row_id") -> DataFrame:
    """ML-7: packed vs separate sequence length per item, in words.

    Packed = prefix once + all candidates; separate = the prefix repeated per candidate.
    ``over_budget`` marks items whose packed length exceeds ``max_length``. The candidates' words
    come from the items' ``suffix_words`` (counted once per question) where there is one.
    """
    if "suffix_words" in items.columns:
        sw = F.col("suffix_words")
    else:
        sw = F.aggregate(F.transform(F.col(suffixes), word_count), F.lit(0).cast("long"), lambda a, b: a + b)
    k = F.size(suffixes).cast("long")
    p = items.select(key, k.alias("n_candidates"), word_count_arrow(prefix).alias("prefix_words"),
                     sw.alias("suffix_words"))
    return p.select(
        "*",
        (F.col("prefix_words") + F.col("suffix_words")).alias("packed_len"),
        (F.col("prefix_words") * F.col("n_candidates") + F.col("suffix_words")).alias("separate_len"),
    ).withColumn("over_budget", F.col("packed_len") > max_length)

