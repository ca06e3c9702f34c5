"""DuckDB SQL for the fixture views (CTE bodies), shared by the oracle queries.

Each constant is a ``name AS (...)`` fragment; ``with_ctes`` assembles a WITH clause.
They mirror ``rankspark.sources.fixtures`` and FIXTURES.md section 4.
"""

from __future__ import annotations

RESPONSES = """responses AS (
  SELECT d.doc_id AS row_id, d.source AS question_id, d.lang AS mc_answer, d.text AS explanation,
    CASE WHEN l.doc_id IS NULL THEN NULL ELSE concat(
      CASE WHEN l.quality = 1 THEN 'True' ELSE 'False' END, '_',
      CASE WHEN l.toxic = 1 THEN 'Misconception' WHEN d.n_chars % 2 = 0 THEN 'Correct' ELSE 'Neither' END) END AS category,
    CASE WHEN l.toxic = 1 THEN concat('M', CAST(d.doc_id % 7 AS VARCHAR)) END AS misconception
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

# responses with derived profile columns (PF-3, SC-1)
DERIVED = r"""derived AS (
  SELECT *,
    CAST(coalesce(len(regexp_extract_all(explanation, '[^\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+')), 0) AS BIGINT) AS n_words,
    starts_with(category, 'True') AS ans_correct,
    CASE WHEN strpos(category, '_') > 0 THEN substr(category, strpos(category, '_') + 1) END AS expl_assess,
    coalesce(CASE WHEN strpos(category, '_') > 0 THEN substr(category, strpos(category, '_') + 1) END = 'Misconception', false) AS has_misconception
  FROM responses)"""

# AG-1 on (mc_answer, explanation): first row_id per key, null = null
DEDUP = """dedup AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY mc_answer, explanation ORDER BY row_id) AS __rn FROM responses) t
  WHERE __rn = 1)"""

LABELLED = """labelled AS (
  SELECT row_id, question_id, mc_answer, explanation, category, misconception,
    concat(coalesce(category, 'NA'), ':', coalesce(misconception, 'NA')) AS label
  FROM dedup)"""

VOCAB = """vocab AS (
  SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS BIGINT) AS label_idx
  FROM (SELECT DISTINCT label FROM labelled) t)"""

EVENT_LABELS = """event_labels AS (
  SELECT event_type AS label, CAST(row_number() OVER (ORDER BY event_type) - 1 AS BIGINT) AS label_idx
  FROM (SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL) t)"""

RUN_IDS = """run_ids AS (SELECT CAST(r AS BIGINT) AS run_id FROM range(3) t(r))"""

EVENT_SCORES = """event_scores AS (
  SELECT r.run_id, e.event_id AS item_id, y.label_idx AS y_true, k.label_idx AS cand_idx,
    (e.event_id*7919 + k.label_idx*104729 + r.run_id*15485863) % 10007
      + CASE WHEN k.label_idx = y.label_idx THEN 3000 ELSE 0 END AS logit
  FROM events e JOIN event_labels y ON e.event_type = y.label CROSS JOIN event_labels k CROSS JOIN run_ids r)"""

RANKED = """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY run_id, item_id ORDER BY logit DESC, cand_idx) AS rnk
  FROM event_scores)"""

RUN_RANKS = """run_ranks AS (
  SELECT run_id, item_id, any_value(y_true) AS y_true,
    string_agg(CAST(cand_idx AS VARCHAR), ' ' ORDER BY rnk) AS ranks
  FROM ranked GROUP BY run_id, item_id)"""

K_EVENTS = """k_events AS (SELECT count(*) AS k FROM event_labels)"""

BORDA = """borda_pts AS (
  SELECT item_id, cand_idx, sum(k.k - (rnk - 1)) AS pts FROM ranked CROSS JOIN k_events k GROUP BY item_id, cand_idx),
borda_ranked AS (
  SELECT item_id, cand_idx, row_number() OVER (PARTITION BY item_id ORDER BY pts DESC, cand_idx DESC) AS rnk
  FROM borda_pts)"""

# JN-4: candidate list per question
QUESTION_CANDIDATES = """qms AS (SELECT question_id,
    coalesce(list_sort(list(DISTINCT misconception) FILTER (WHERE misconception IS NOT NULL)), []::VARCHAR[]) AS ms
  FROM responses GROUP BY question_id),
qcs AS (SELECT question_id, list_sort(list_concat(list_concat(
    ['True_Correct:NA', 'True_Neither:NA', 'False_Correct:NA', 'False_Neither:NA'],
    list_transform(ms, lambda m: 'True_Misconception:' || m)),
    list_transform(ms, lambda m: 'False_Misconception:' || m))) AS c FROM qms)"""

# scores over those lists, and their ranking
RESPONSE_SCORES = """rpl AS (
  SELECT r.row_id AS item_id, c, list_position(c, concat(coalesce(category, 'NA'), ':', coalesce(misconception, 'NA'))) - 1 AS y_true
  FROM responses r JOIN qcs USING (question_id)),
rex AS (SELECT item_id, y_true, unnest(range(len(c))) AS cand_idx FROM rpl),
rranked AS (SELECT *, row_number() OVER (PARTITION BY run_id, item_id ORDER BY logit DESC, cand_idx) AS rnk FROM (
  SELECT run_id, item_id, y_true, cand_idx,
    (item_id*7919 + cand_idx*104729 + run_id*15485863) % 10007 + CASE WHEN cand_idx = y_true THEN 3000 ELSE 0 END AS logit
  FROM rex CROSS JOIN run_ids) t)"""

VOCAB_ALL = """vocab_all AS (
  SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS BIGINT) AS label_idx
  FROM (SELECT DISTINCT concat(coalesce(category, 'NA'), ':', coalesce(misconception, 'NA')) AS label FROM responses) t)"""

EVENT_ALL = (EVENT_LABELS, RUN_IDS, EVENT_SCORES, RANKED)


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
