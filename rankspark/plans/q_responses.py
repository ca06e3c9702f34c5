"""E1 prepare and E3 profile queries over the response table."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankspark.functions.text import ASSESSMENTS, NA_TOKENS, label_string, parse_candidates
from rankspark.operators import prepare, profile
from rankspark.operators.windows import global_row_number
from rankspark.plans import oracle as O
from rankspark.plans.catalog import register
from rankspark.sources import fixtures as fx
from rankspark.session import stored

R = O.with_ctes(O.RESPONSES)
RD = O.with_ctes(O.RESPONSES, O.DERIVED)
RL = O.with_ctes(O.RESPONSES, O.DEDUP, O.LABELLED, O.VOCAB)
TOKENS_SQL = ", ".join("'" + t + "'" for t in NA_TOKENS)
DEDUP_KEYS = ("mc_answer", "explanation")


def _derived(spark, sf):
    return profile.derive(fx.responses(spark, sf))


def _nt(c: str) -> str:
    return f"CASE WHEN {c} IN ({TOKENS_SQL}) THEN NULL ELSE {c} END AS {c}"


@register(
    "null_tokens",
    R + f"""SELECT row_id, {_nt('question_id')}, {_nt('mc_answer')}, {_nt('category')}, {_nt('misconception')},
        (explanation IS NULL OR explanation IN ({TOKENS_SQL})) AS explanation_missing FROM responses""",
    ("PF-2",),
)
def q_null_tokens(spark, sf):
    r = prepare.normalise_missing(fx.responses(spark, sf))
    return r.select("row_id", "question_id", "mc_answer", "category", "misconception",
                    F.col("explanation").isNull().alias("explanation_missing"))


@register(
    "category_decode",
    RD + "SELECT row_id, ans_correct, expl_assess, has_misconception FROM derived",
    ("PF-3", "SC-2"),
)
def q_category_decode(spark, sf):
    return _derived(spark, sf).select("row_id", "ans_correct", "expl_assess", "has_misconception")


@register(
    "label_string",
    R + "SELECT row_id, concat(coalesce(category, 'NA'), ':', coalesce(misconception, 'NA')) AS label FROM responses",
    ("PF-4",),
)
def q_label_string(spark, sf):
    r = fx.responses(spark, sf)
    return r.select("row_id", label_string("category", "misconception").alias("label"))


@register("word_count", RD + "SELECT row_id, n_words FROM derived", ("SC-1", "UF-1"))
def q_word_count(spark, sf):
    return _derived(spark, sf).select("row_id", "n_words")


@register(
    "dedup_responses",
    O.with_ctes(O.RESPONSES, O.DEDUP) + "SELECT row_id, question_id, mc_answer, category, misconception FROM dedup",
    ("AG-1",),
)
def q_dedup(spark, sf):
    d = prepare.dedup_responses(fx.responses(spark, sf), DEDUP_KEYS)
    return d.select("row_id", "question_id", "mc_answer", "category", "misconception")


def _first_labelled(spark, sf):
    """Row key and label of the first rows only: the text is reduced to a digest where it is read."""
    return prepare.with_label(prepare.first_rows(fx.responses(spark, sf), DEDUP_KEYS, "row_id", ["category", "misconception"]))


@register(
    "dedup_full_key",
    R + """SELECT row_id, question_id, mc_answer FROM (
        SELECT *, row_number() OVER (PARTITION BY question_id, mc_answer, explanation ORDER BY row_id) AS rn FROM responses) t WHERE rn = 1""",
    ("AG-1",),
)
def q_dedup_full_key(spark, sf):
    return prepare.dedup_responses(fx.responses(spark, sf)).select("row_id", "question_id", "mc_answer")


@register("label_vocab", RL + "SELECT label, label_idx FROM vocab", ("AG-2", "WN-1", "SO-2"))
def q_label_vocab(spark, sf):
    return prepare.label_vocab(_first_labelled(spark, sf))


@register(
    "label_encode",
    RL + "SELECT l.row_id, l.label, v.label_idx FROM labelled l JOIN vocab v USING (label)",
    ("JN-1",),
)
def q_label_encode(spark, sf):
    lab = stored(_first_labelled(spark, sf), "labelled")
    return prepare.encode_labels(lab, prepare.label_vocab(lab)).select("row_id", "label", "label_idx")


@register(
    "candidates_full",
    RL + """SELECT l.row_id, v.n AS n_candidates, v.c AS candidates FROM labelled l
        CROSS JOIN (SELECT count(*) AS n, string_agg(label, ' ' ORDER BY label_idx) AS c FROM vocab) v""",
    ("JN-3",),
)
def q_candidates_full(spark, sf):
    lab = stored(_first_labelled(spark, sf), "labelled")
    c = prepare.attach_all_candidates(lab, prepare.label_vocab(lab))
    return c.select("row_id", F.size("candidates").cast("long").alias("n_candidates"),
                    F.array_join("candidates", " ").alias("candidates"))


QM = """qm AS (SELECT question_id,
    coalesce(list_sort(list(DISTINCT misconception) FILTER (WHERE misconception IS NOT NULL)), []::VARCHAR[]) AS ms
  FROM responses GROUP BY question_id)"""
QC = """qc AS (SELECT question_id, list_sort(list_concat(list_concat(
    ['True_Correct:NA', 'True_Neither:NA', 'False_Correct:NA', 'False_Neither:NA'],
    list_transform(ms, lambda m: 'True_Misconception:' || m)),
    list_transform(ms, lambda m: 'False_Misconception:' || m))) AS c FROM qm)"""


@register(
    "question_misconceptions",
    O.with_ctes(O.RESPONSES, QM) + """SELECT question_id, CAST(len(ms) AS BIGINT) AS n_misconceptions,
        array_to_string(ms, ', ') AS misconceptions FROM qm""",
    ("AG-3",),
)
def q_question_misconceptions(spark, sf):
    qm = prepare.question_misconceptions(fx.responses(spark, sf))
    return qm.select("question_id", F.size("misconceptions").cast("long").alias("n_misconceptions"),
                     F.array_join("misconceptions", ", ").alias("misconceptions"))


@register(
    "candidates_by_question",
    O.with_ctes(O.RESPONSES, QM, QC) + """SELECT r.row_id, r.question_id, CAST(len(qc.c) AS BIGINT) AS n_candidates,
        array_to_string(qc.c, ' ') AS candidates FROM responses r LEFT JOIN qc USING (question_id)""",
    ("JN-4",),
)
def q_candidates_by_question(spark, sf):
    c = prepare.attach_question_candidates(fx.responses(spark, sf))
    return c.select("row_id", "question_id", F.size("candidates").cast("long").alias("n_candidates"),
                    F.array_join("candidates", " ").alias("candidates"))


@register(
    "answer_key",
    R + """, c AS (SELECT question_id, mc_answer, count(*) AS n FROM responses
              WHERE starts_with(category, 'True') AND mc_answer IS NOT NULL GROUP BY question_id, mc_answer)
        SELECT question_id, mc_answer AS answer FROM (
          SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY n DESC, mc_answer) AS rn FROM c) t WHERE rn = 1""",
    ("AG-19",),
)
def q_answer_key(spark, sf):
    return prepare.answer_key(fx.responses(spark, sf))


@register(
    "parse_candidates",
    O.with_ctes(O.RESPONSES, QM, QC) + """, src AS (
          SELECT 'text' AS source, CAST(row_id AS VARCHAR) AS key, explanation AS raw FROM responses WHERE explanation IS NOT NULL
          UNION ALL SELECT 'json', question_id, to_json(c)::VARCHAR FROM qc),
        parsed AS (SELECT source, key, CASE WHEN json_valid(raw)
            THEN CASE WHEN json_type(raw::JSON) = 'ARRAY' THEN from_json(raw, '["VARCHAR"]') ELSE string_split(raw, ' ') END
            ELSE string_split(raw, ' ') END AS cands FROM src)
        SELECT source, key, CAST(len(cands) AS BIGINT) AS n_candidates, cands[1] AS first_candidate,
               cands[len(cands)] AS last_candidate FROM parsed""",
    ("PF-9", "SC-6"),
)
def q_parse_candidates(spark, sf):
    r = fx.responses(spark, sf)
    cands = prepare.question_candidates(prepare.question_misconceptions(r))
    src = r.where(F.col("explanation").isNotNull()).select(
        F.lit("text").alias("source"), F.col("row_id").cast("string").alias("key"), F.col("explanation").alias("raw")
    ).unionByName(
        cands.select(F.lit("json").alias("source"), F.col("question_id").alias("key"),
                     F.to_json("candidates").alias("raw"))
    )
    p = src.select("source", "key", parse_candidates("raw").alias("c"))
    return p.select("source", "key", F.size("c").cast("long").alias("n_candidates"),
                    F.get("c", 0).alias("first_candidate"), F.get("c", F.size("c") - 1).alias("last_candidate"))


# --- E3 profile ---------------------------------------------------------------------------


@register(
    "category_counts",
    R + "SELECT category, count(*) AS n FROM responses WHERE category IS NOT NULL GROUP BY category",
    ("AG-4", "SL-1", "PF-7"),
)
def q_category_counts(spark, sf):
    return profile.value_counts(fx.responses(spark, sf), "category").orderBy("category")


@register(
    "responses_per_question",
    R + "SELECT question_id, count(*) AS n FROM responses WHERE question_id IS NOT NULL GROUP BY question_id",
    ("AG-5",),
)
def q_responses_per_question(spark, sf):
    return profile.value_counts(fx.responses(spark, sf), "question_id").orderBy(F.col("n").desc(), "question_id")


@register(
    "top_misconceptions",
    RD + """SELECT misconception, count(*) AS n FROM derived WHERE has_misconception AND misconception IS NOT NULL
        GROUP BY misconception ORDER BY n DESC, misconception LIMIT 20""",
    ("AG-6", "PF-6", "SL-2"),
)
def q_top_misconceptions(spark, sf):
    return profile.top_values(_derived(spark, sf), "misconception", 20, where=F.col("has_misconception"))


CT = """ct AS (SELECT ans_correct,
    count(*) FILTER (WHERE expl_assess = 'Correct') AS "Correct",
    count(*) FILTER (WHERE expl_assess = 'Misconception') AS "Misconception",
    count(*) FILTER (WHERE expl_assess = 'Neither') AS "Neither"
  FROM derived WHERE ans_correct IS NOT NULL AND expl_assess IS NOT NULL GROUP BY ans_correct)"""


@register("crosstab", O.with_ctes(O.RESPONSES, O.DERIVED, CT) + "SELECT * FROM ct", ("AG-7",))
def q_crosstab(spark, sf):
    return profile.crosstab(_derived(spark, sf), "ans_correct", "expl_assess")


@register(
    "crosstab_normalized",
    O.with_ctes(O.RESPONSES, O.DERIVED, CT) + """SELECT ans_correct,
        round("Correct" / ("Correct" + "Misconception" + "Neither"), 6) AS "Correct",
        round("Misconception" / ("Correct" + "Misconception" + "Neither"), 6) AS "Misconception",
        round("Neither" / ("Correct" + "Misconception" + "Neither"), 6) AS "Neither" FROM ct""",
    ("AG-8",),
)
def q_crosstab_normalized(spark, sf):
    ct = profile.crosstab(_derived(spark, sf), "ans_correct", "expl_assess")
    n = profile.crosstab_normalized(ct, "ans_correct")
    return n.select("ans_correct", *[F.round(v, 6).alias(v) for v in ASSESSMENTS])


@register(
    "length_describe",
    RD + """SELECT expl_assess, count(n_words) AS count, round(avg(n_words), 6) AS mean,
        round(stddev_samp(n_words), 6) AS std, CAST(min(n_words) AS DOUBLE) AS min,
        round(quantile_cont(n_words, 0.25), 6) AS q25, round(quantile_cont(n_words, 0.5), 6) AS q50,
        round(quantile_cont(n_words, 0.75), 6) AS q75, CAST(max(n_words) AS DOUBLE) AS max
      FROM derived WHERE expl_assess IS NOT NULL GROUP BY expl_assess""",
    ("AG-9",),
)
def q_length_describe(spark, sf):
    d = profile.describe_by(_derived(spark, sf), "expl_assess", "n_words")
    return d.select("expl_assess", "count", *[F.round(c, 6).alias(c) for c in ("mean", "std")], "min",
                    *[F.round(c, 6).alias(c) for c in ("q25", "q50", "q75")], "max")


def _box_sql(key: str) -> str:
    return RD + f""", q AS (
          SELECT {key}, count(*) AS n, avg(n_words) AS mean, quantile_cont(n_words, 0.25) AS q1,
            quantile_cont(n_words, 0.5) AS med, quantile_cont(n_words, 0.75) AS q3
          FROM derived WHERE {key} IS NOT NULL GROUP BY {key}),
        w AS (SELECT d.{key},
            min(CASE WHEN d.n_words >= q.q1 - 1.5 * (q.q3 - q.q1) THEN CAST(d.n_words AS DOUBLE) END) AS wlo,
            max(CASE WHEN d.n_words <= q.q3 + 1.5 * (q.q3 - q.q1) THEN CAST(d.n_words AS DOUBLE) END) AS whi
          FROM derived d JOIN q USING ({key}) GROUP BY d.{key})
        SELECT q.{key}, q.n, round(q.mean, 6) AS mean, round(q.q1, 6) AS q1, round(q.med, 6) AS med,
          round(q.q3, 6) AS q3, round(least(coalesce(w.wlo, q.q1), q.q1), 6) AS whislo,
          round(greatest(coalesce(w.whi, q.q3), q.q3), 6) AS whishi
        FROM q JOIN w USING ({key})"""


def _box(spark, sf, key):
    b = profile.boxplot_by(_derived(spark, sf), key, "n_words")
    return b.select(key, "n", *[F.round(c, 6).alias(c) for c in ("mean", "q1", "med", "q3", "whislo", "whishi")])


@register("boxplot_category", _box_sql("category"), ("AG-10",))
def q_boxplot_category(spark, sf):
    return _box(spark, sf, "category")


@register("boxplot_assessment", _box_sql("expl_assess"), ("AG-11",))
def q_boxplot_assessment(spark, sf):
    return _box(spark, sf, "expl_assess")


def _hist_sql(source_cte: str, col: str, bins: int) -> str:
    return source_cte + f""", mm AS (SELECT CAST(min({col}) AS DOUBLE) AS lo0, CAST(max({col}) AS DOUBLE) AS hi0 FROM src),
        m AS (SELECT CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo,
                     CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM mm),
        c AS (SELECT CAST(least(floor((CAST({col} AS DOUBLE) - m.lo) * {bins} / (m.hi - m.lo)), {bins - 1}) AS BIGINT) AS bin,
                     count(*) AS n FROM src CROSS JOIN m WHERE {col} IS NOT NULL GROUP BY 1),
        axis AS (SELECT CAST(i AS BIGINT) AS bin FROM range({bins}) t(i))
        SELECT axis.bin, round(m.lo + axis.bin * (m.hi - m.lo) / {bins}, 6) AS lo,
          round(m.lo + (axis.bin + 1) * (m.hi - m.lo) / {bins}, 6) AS hi, coalesce(c.n, 0) AS n
        FROM axis CROSS JOIN m LEFT JOIN c USING (bin)"""


def _round_hist(h):
    return h.select("bin", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "n")


@register(
    "hist_length",
    _hist_sql(O.with_ctes(O.RESPONSES, O.DERIVED, "src AS (SELECT n_words FROM derived)"), "n_words", 40),
    ("AG-12",),
)
def q_hist_length(spark, sf):
    return _round_hist(profile.histogram(_derived(spark, sf), "n_words", 40))


@register(
    "hist_responses",
    _hist_sql(O.with_ctes(O.RESPONSES, "src AS (SELECT question_id, count(*) AS n FROM responses WHERE question_id IS NOT NULL GROUP BY question_id)"), "n", 30),
    ("AG-13",),
)
def q_hist_responses(spark, sf):
    per_question = profile.value_counts(fx.responses(spark, sf), "question_id")
    return _round_hist(profile.histogram(per_question, "n", 30))


@register(
    "rank_with_missing",
    R + """SELECT row_id, m, CAST(row_number() OVER (ORDER BY m NULLS LAST, row_id) AS BIGINT) AS rnk
        FROM (SELECT row_id, CAST(substr(misconception, 2) AS BIGINT) AS m FROM responses) t""",
    ("WN-2",),
)
def q_rank_with_missing(spark, sf):
    """A value that most rows lack and few values share: null rows are ranked last."""
    r = fx.responses(spark, sf).select("row_id", F.expr("substr(misconception, 2)").cast("long").alias("m"))
    return profile.rank_first(r, "m", rows_per_range=500).select("row_id", "m", "rnk")


@register(
    "rank_text_key",
    R + """SELECT row_id, mc_answer, CAST(row_number() OVER (ORDER BY mc_answer NULLS LAST, question_id NULLS LAST, row_id) AS BIGINT) AS rnk FROM responses""",
    ("WN-2",),
)
def q_rank_text_key(spark, sf):
    """Text keys, one of them held by more than half of the rows, over ranges of 150 rows."""
    r = fx.responses(spark, sf).select("row_id", "mc_answer", "question_id")
    return global_row_number(r, ["mc_answer", "question_id", "row_id"], "rnk", rows_per_range=150)[0].select("row_id", "mc_answer", "rnk")


@register(
    "text_vocabulary",
    R + """SELECT label, row_number() OVER (ORDER BY label) - 1 AS label_idx FROM (SELECT DISTINCT md5(explanation) AS label FROM responses WHERE explanation IS NOT NULL) t""",
    ("AG-2", "WN-1"),
)
def q_text_vocabulary(spark, sf):
    """A vocabulary with an entry per distinct answer: as large as the data, numbered by ranges."""
    distinct = fx.responses(spark, sf).select(F.md5("explanation").alias("label")).where("label IS NOT NULL").distinct()
    return global_row_number(distinct, ["label"], "n", rows_per_range=200)[0].select("label", (F.col("n") - 1).alias("label_idx"))


@register(
    "rank_first",
    RD + "SELECT row_id, CAST(row_number() OVER (ORDER BY n_words, row_id) AS BIGINT) AS rnk FROM derived",
    ("WN-2",),
)
def q_rank_first(spark, sf):
    return profile.rank_first(_derived(spark, sf).select("row_id", "n_words"), "n_words").select("row_id", "rnk")


DECILES = """, rk AS (SELECT row_id, has_misconception, CAST(row_number() OVER (ORDER BY n_words, row_id) AS BIGINT) AS rnk,
                 count(*) OVER () AS n FROM derived),
        dec AS (SELECT *, CASE WHEN n <= 1 THEN 0 ELSE greatest((10 * (rnk - 1) + n - 2) // (n - 1) - 1, 0) END AS decile FROM rk)"""


@register(
    "length_deciles",
    RD + DECILES + " SELECT row_id, rnk, CAST(decile AS BIGINT) AS decile FROM dec",
    ("WN-3",),
)
def q_length_deciles(spark, sf):
    d = _derived(spark, sf).select("row_id", "n_words")
    return profile.length_deciles(d).select("row_id", "rnk", "decile")


@register(
    "rate_by_decile",
    RD + DECILES + """ SELECT CAST(decile AS BIGINT) AS decile, count(*) AS n,
        round(avg(CAST(has_misconception AS DOUBLE)), 6) AS rate FROM dec GROUP BY decile""",
    ("AG-14",),
)
def q_rate_by_decile(spark, sf):
    r = profile.rate_by_decile(_derived(spark, sf))
    return r.select("decile", "n", F.round("rate", 6).alias("rate"))


# --- E1 end to end ---------------------------------------------------------------------------


def _nt_all(cols) -> str:
    return ", ".join(_nt(c) for c in cols)


PREPARE_SQL = O.with_ctes(O.RESPONSES) + f""", norm AS (
      SELECT row_id, {_nt_all(['question_id', 'mc_answer', 'explanation', 'category', 'misconception'])} FROM responses),
    dd AS (SELECT * FROM (
      SELECT *, row_number() OVER (PARTITION BY mc_answer, explanation ORDER BY row_id) AS __rn FROM norm) t WHERE __rn = 1),
    lab AS (SELECT *, concat(coalesce(category, 'NA'), ':', coalesce(misconception, 'NA')) AS label FROM dd),
    voc AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS BIGINT) AS label_idx
            FROM (SELECT DISTINCT label FROM lab) t),
    qm AS (SELECT question_id,
      coalesce(list(DISTINCT misconception) FILTER (WHERE misconception IS NOT NULL), []::VARCHAR[]) AS ms
      FROM lab GROUP BY question_id)
    SELECT l.row_id, l.label, v.label_idx,
      CAST((row_number() OVER (ORDER BY l.label, md5('42:' || CAST(l.row_id AS VARCHAR)), l.row_id) - 1) % 5 AS INTEGER) AS fold,
      CAST(4 + 2 * len(qm.ms) AS BIGINT) AS n_candidates
    FROM lab l JOIN voc v USING (label) LEFT JOIN qm USING (question_id)"""


@register("prepare_clean", PREPARE_SQL, ("PF-2", "AG-1", "PF-4", "AG-2", "WN-1", "JN-1", "JN-4", "WN-4"))
def q_prepare_clean(spark, sf):
    """E1 end to end: missing tokens, dedup, labels, vocabulary, candidates, folds."""
    p = prepare.prepare(fx.responses(spark, sf), k=5, seed=42, dedup_keys=DEDUP_KEYS, candidates="question")
    return p.clean.select("row_id", "label", "label_idx", "fold",
                          F.size("candidates").cast("long").alias("n_candidates"))
