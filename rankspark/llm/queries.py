"""The registered queries of the llm operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rankspark.llm import collocations, decontaminate, exact_dedup, html_mincut, language, lexical_search, line_dedup, minhash, pieces, pii, sharding, substring_dedup, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


SQL["op9_exact_dedup"] = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm)
"""


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents"), digest_only=True)


SQL["op5_line_dedup"] = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, lines[p] AS line, p AS pos
      FROM (SELECT doc_id, lines, unnest(generate_series(1, len(lines))) AS p FROM d)),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20
      GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
f AS (SELECT k.*, r.keeper IS NULL OR k.doc_id = r.keeper AS keep FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT keep) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (keep), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""


@query
def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(_table(spark, sf_dir, "documents"))


SQL["op7_minhash_near_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[p:p+4], ' ')) AS sh
      FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS p FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept
FROM c LEFT JOIN n USING (doc_id)
"""


@query
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(_table(spark, sf_dir, "documents"), digest_only=True)


SQL["op8_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, p, md5(array_to_string(ws[p:p+12], ' ')) AS h
      FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 12)) AS p FROM w WHERE len(ws) >= 13)),
m AS (SELECT h, min(doc_id) AS lo FROM p GROUP BY h),
g AS (SELECT DISTINCT doc_id, unnest(generate_series(p, p + 12)) AS q FROM p JOIN m USING (h) WHERE lo < doc_id),
a AS (SELECT doc_id, ws[q] AS word, q FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws))) AS q FROM w)),
k AS (SELECT a.doc_id, string_agg(word, ' ' ORDER BY a.q) AS kept, count(*) AS n FROM a ANTI JOIN g ON a.doc_id = g.doc_id AND a.q = g.q GROUP BY a.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query
def op2_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


SQL["op2_warc_transactions"] = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS body FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS keeper FROM p)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS payload_digest,
       CASE WHEN strlen(body) >= 1000 AND page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(body) >= 1000 AND page_id < keeper THEN keeper END AS refers_to,
       regexp_replace(url, '[\r\n]', '%0A', 'g') AS request_uri, 'pageId: ' || page_id || chr(13) || chr(10) AS metadata_fields
FROM k
"""


@query
def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


@query
def op6_html_mincut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_mincut.extract(_table(spark, sf_dir, "pages"))


@query
def op4_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_table(spark, sf_dir, "documents"))


@query
def op3_pii_semicrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


@query
def op11_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(_table(spark, sf_dir, "documents"))


SQL["op11_hash_tree_sharding"] = r"""
WITH crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(256) r(i))),
d AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 1 AS size,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\1 ', 'g'), ' ')[:-2], lambda x: ('0x' || x)::BIGINT)),
                         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM documents, crc_table),
tree(shards, up, path, weight, shard) AS (VALUES
  (8, '', '0:r0', 4, NULL), (8, '', '0:r1', 4, NULL),
  (9, '', '0:r0', 4, NULL), (9, '', '0:r1', 4, NULL), (9, '', '1:r2', 1, NULL),
  (0, '0:r0', '0:r0/k0', 2, NULL), (0, '0:r0', '0:r0/k1', 2, NULL), (0, '0:r1', '0:r1/k0', 2, NULL), (0, '0:r1', '0:r1/k1', 2, NULL), (0, '1:r2', '1:r2/k0', 1, NULL),
  (0, '0:r0/k0', '0:r0/k0/0', 1, 0), (0, '0:r0/k0', '0:r0/k0/1', 1, 1), (0, '0:r0/k1', '0:r0/k1/2', 1, 2), (0, '0:r0/k1', '0:r0/k1/3', 1, 3),
  (0, '0:r1/k0', '0:r1/k0/4', 1, 4), (0, '0:r1/k0', '0:r1/k0/5', 1, 5), (0, '0:r1/k1', '0:r1/k1/6', 1, 6), (0, '0:r1/k1', '0:r1/k1/7', 1, 7),
  (0, '1:r2/k0', '1:r2/k0/8', 1, 8)),
draws AS (
  SELECT doc_id, t.*, -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || path), 1, 13))::BIGINT + 0.5) / 4503599627370496) / weight AS draw
  FROM d CROSS JOIN tree t),
region AS (SELECT doc_id, shards, arg_min(path, draw) AS path FROM draws WHERE up = '' GROUP BY ALL),
rack AS (SELECT r.doc_id, r.shards, arg_min(w.path, w.draw) AS path FROM region r JOIN draws w ON w.doc_id = r.doc_id AND w.up = r.path GROUP BY ALL),
leaf AS (SELECT r.doc_id, r.shards, arg_min(w.shard, w.draw) AS shard FROM rack r JOIN draws w ON w.doc_id = r.doc_id AND w.up = r.path GROUP BY ALL)
SELECT d.doc_id, size, text_crc32, 'key' AS law, a.shard::INTEGER AS shard,
       row_number() OVER (PARTITION BY a.shard ORDER BY ('0x' || substr(md5(d.doc_id || '|' || size || '|' || text_crc32), 1, 13))::BIGINT, d.doc_id, size, text_crc32) - 1 AS slot,
       b.shard::INTEGER AS grown_shard
FROM d JOIN leaf a ON a.doc_id = d.doc_id AND a.shards = 8 JOIN leaf b ON b.doc_id = d.doc_id AND b.shards = 9
"""


@query
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


SQL["op13_lexical_search"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
q AS (
  SELECT item_id, term, count(*) AS qtf FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT count(*) AS nn, sum(len(terms))::BIGINT AS ll FROM d WHERE len(terms) > 0),
t AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * max(nn) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM t, s GROUP BY term),
p AS (SELECT item_id, doc_id, sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll))))::BIGINT AS score
      FROM q JOIN t USING (term) JOIN w USING (term), s GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM p WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 20
"""


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


SQL["op12_collocations"] = r"""
WITH p AS (
  SELECT row_number() OVER () AS id, lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM p GROUP BY lang),
w AS (SELECT id, lang, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM p),
g AS (SELECT lang, word AS w1, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3, lead(word, 3) OVER o AS w4, lead(word, 4) OVER o AS w5
      FROM w WINDOW o AS (PARTITION BY id ORDER BY i)),
f AS (SELECT lang, 1 AS k, w1 AS phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100
      UNION ALL SELECT lang, 2, w1 || ' ' || w2 AS phrase, count(*) FROM g WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
      UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 AS phrase, count(*) FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
      UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 AS phrase, count(*) FROM g WHERE w4 IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
      UNION ALL SELECT lang, 5, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5 AS phrase, count(*) FROM g WHERE w5 IS NOT NULL GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2),
u AS (SELECT c.lang, c.phrase, c.a, u.k AS cut, x.f AS l, y.f AS r
      FROM (SELECT *, unnest(generate_series(1, k - 1)) AS at FROM c) c JOIN (VALUES (1), (2), (3), (4)) u(k) ON u.k = c.at
      JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:u.k], ' ')
      JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[u.k + 1:], ' ')),
s AS (SELECT u.*, n, ((1000::HUGEINT * a * n) // (l::HUGEINT * r))::BIGINT AS score FROM u JOIN n USING (lang)),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, array_to_string(ws[j:j + m - 1], ' ') AS phrase, max(a) AS longer
      FROM (SELECT *, unnest(generate_series(1, k - m + 1)) AS j FROM (SELECT *, unnest(generate_series(2, k - 1)) AS m FROM c WHERE k > 2)) GROUP BY ALL),
r AS (SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
      FROM b LEFT JOIN i USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM r WHERE rank <= 2000
"""
