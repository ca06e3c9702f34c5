"""Prompt and packing queries (SC-3, SC-4, PF-8, ML-7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankspark.functions.text import PREFIX_FIELDS, PREFIX_TEMPLATE
from rankspark.operators import prompts
from rankspark.plans import oracle as O
from rankspark.plans.catalog import register
from rankspark.sources import fixtures as fx

MAX_LENGTH = prompts.DEFAULT_MAX_LENGTH
WORDS_RE = r"[^\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

_FIELD_SQL = {
    "question": "r.question_id",
    "choices": "pq.choices",
    "answer": "ak.answer",
    "misconceptions": "pq.misconception_text",
    "student_answer": "r.mc_answer",
    "explanation": "r.explanation",
}


def _prefix_sql(fields: dict[str, str] = _FIELD_SQL) -> str:
    parts, rest = [], PREFIX_TEMPLATE
    for name in PREFIX_FIELDS:
        head, rest = rest.split("{" + name + "}", 1)
        parts.append("'" + head + "'")
        parts.append(f"coalesce(CAST({fields[name]} AS VARCHAR), '')")
    parts.append("'" + rest + "'")
    return " || ".join(parts)


ITEMS = O.with_ctes(O.RESPONSES) + """, pq AS (
  SELECT question_id,
    coalesce(array_to_string(list_sort(list(DISTINCT mc_answer) FILTER (WHERE mc_answer IS NOT NULL)), ', '), '') AS choices,
    coalesce(list_sort(list(DISTINCT misconception) FILTER (WHERE misconception IS NOT NULL)), []::VARCHAR[]) AS ms,
    coalesce(array_to_string(list_sort(list(DISTINCT misconception) FILTER (WHERE misconception IS NOT NULL)), ', '), '') AS misconception_text
  FROM responses GROUP BY question_id),
qc AS (SELECT question_id, list_sort(list_concat(list_concat(
    ['True_Correct:NA', 'True_Neither:NA', 'False_Correct:NA', 'False_Neither:NA'],
    list_transform(ms, lambda m: 'True_Misconception:' || m)),
    list_transform(ms, lambda m: 'False_Misconception:' || m))) AS c FROM pq),
akc AS (SELECT question_id, mc_answer, count(*) AS n FROM responses
        WHERE starts_with(category, 'True') AND mc_answer IS NOT NULL GROUP BY question_id, mc_answer),
ak AS (SELECT question_id, mc_answer AS answer FROM (
        SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY n DESC, mc_answer) AS rn FROM akc) t WHERE rn = 1),
items AS (
  SELECT r.row_id, """ + _prefix_sql() + """ AS prefix, qc.c AS suffixes
  FROM responses r LEFT JOIN pq USING (question_id) LEFT JOIN qc USING (question_id) LEFT JOIN ak USING (question_id))
"""


def _items(spark, sf):
    return prompts.with_prefix(prompts.to_items(fx.responses(spark, sf)))


@register("render_prefix", ITEMS + "SELECT row_id, prefix FROM items", ("SC-3", "PF-8", "PF-1"))
def q_render_prefix(spark, sf):
    return _items(spark, sf).select("row_id", "prefix")


@register(
    "render_prompts",
    ITEMS + """SELECT row_id, CAST(cand_pos AS BIGINT) AS cand_pos, candidate, prefix || candidate AS prompt FROM (
        SELECT row_id, prefix, generate_subscripts(suffixes, 1) - 1 AS cand_pos, unnest(suffixes) AS candidate FROM items) t""",
    ("SC-4",),
)
def q_render_prompts(spark, sf):
    return prompts.explode_prompts(_items(spark, sf))


PACK = ITEMS + f""", pack AS (
  SELECT row_id, CAST(len(suffixes) AS BIGINT) AS n_candidates,
    CAST(len(regexp_extract_all(prefix, '{WORDS_RE}')) AS BIGINT) AS prefix_words,
    CAST(list_sum(list_transform(suffixes, lambda s: len(regexp_extract_all(s, '{WORDS_RE}')))) AS BIGINT) AS suffix_words
  FROM items)
"""


@register(
    "packing_budget",
    PACK + f"""SELECT *, prefix_words + suffix_words AS packed_len,
        prefix_words * n_candidates + suffix_words AS separate_len,
        prefix_words + suffix_words > {MAX_LENGTH} AS over_budget FROM pack""",
    ("ML-7",),
)
def q_packing_budget(spark, sf):
    return prompts.packing_budget(_items(spark, sf), MAX_LENGTH)


@register(
    "packing_summary",
    PACK + f"""SELECT count(*) AS n_items,
        count(*) FILTER (WHERE prefix_words + suffix_words > {MAX_LENGTH}) AS n_over_budget,
        CAST(sum(prefix_words + suffix_words) AS BIGINT) AS packed_words,
        CAST(sum(prefix_words * n_candidates + suffix_words) AS BIGINT) AS separate_words FROM pack""",
    ("ML-7",),
)
def q_packing_summary(spark, sf):
    p = prompts.packing_budget(_items(spark, sf), MAX_LENGTH)
    return p.agg(
        F.count(F.lit(1)).alias("n_items"),
        F.count(F.when(F.col("over_budget"), 1)).alias("n_over_budget"),
        F.sum("packed_len").cast("long").alias("packed_words"),
        F.sum("separate_len").cast("long").alias("separate_words"),
    )


# question text, choices and misconception list supplied by the table where it has them
_SUPPLIED_SQL = _FIELD_SQL | {
    "question": "CASE WHEN r.row_id % 2 = 0 THEN 'What is said in ' || r.mc_answer || '?' ELSE r.question_id END",
    "choices": "CASE WHEN r.row_id % 3 = 0 THEN 'en, other' ELSE pq.choices END",
}


@register(
    "render_supplied",
    ITEMS.replace(_prefix_sql(), _prefix_sql(_SUPPLIED_SQL)) + "SELECT row_id, prefix FROM items",
    ("SC-3", "PF-8"),
)
def q_render_supplied(spark, sf):
    r = fx.responses(spark, sf)
    r = r.withColumn("question_text", F.when(F.col("row_id") % 2 == 0, F.concat(F.lit("What is said in "), "mc_answer", F.lit("?"))))
    r = r.withColumn("choices", F.when(F.col("row_id") % 3 == 0, F.lit("en, other")))
    return prompts.with_prefix(prompts.to_items(r)).select("row_id", "prefix")
