"""One query an operator, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, embedding_dedup, langid, media, mixing, ngram_join, packing, quality, row_patterns, secrets, token_output, tree_bpe, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_media_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(table(spark, sf_dir, "documents"))


def op7_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


def op8_token_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.training_order(table(spark, sf_dir, "documents"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op10_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), evenness=0.95)


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.linked(table(spark, sf_dir, "documents"))


def op12_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_bpe.digest(table(spark, sf_dir, "documents"))


def op13_row_pattern_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = row_patterns.find(table(spark, sf_dir, "clicks"))
    return found.withColumn("labels_sha256", F.sha2("labels", 256)).drop("labels")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_ngram_jaccard_join, op2_best_fit_packing, op3_language_id, op4_embedding_near_dedup, op5_quality_classifier)
    ops += (op6_media_lossless_webp, op7_warc_normaliser, op8_token_training_order, op9_secret_scans, op10_temperature_mixing, op11_tokenizer_alignment, op12_bpe_tree, op13_row_pattern_matching)
    return {f.__name__: f for f in ops}


_OP1 = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\s\\x{85}\\x{A0}\\x{1C}-\\x{1F}]+'), lambda x: x <> '') AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) <= 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS gram
  FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM both_ JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE k >= 0.8 * (x.n + y.n - k) - 1e-9),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a)
SELECT c.doc_id, c.class_id, (SELECT count(*) FROM link WHERE a = c.doc_id) AS n_links, c.doc_id = c.class_id AS kept FROM c"""

_OP4 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
link AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.x) = len(q.x)
  WHERE list_cosine_similarity(p.x, q.x) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT c.vec_id, (SELECT count(*) FROM link WHERE a = c.vec_id) AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c"""


_OP7 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
q AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
r AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS last FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to FROM r"""

_OP10 = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS tokens, md5(concat_ws('|', coalesce(doc_id::VARCHAR, ''), coalesce(text, ''))) AS doc FROM documents),
per AS (SELECT source, count(*) AS docs, sum(tokens)::BIGINT AS total FROM d GROUP BY source),
one AS (SELECT sum(total)::DOUBLE AS t, list(total::DOUBLE ORDER BY total) AS v FROM per WHERE total > 0),
sh AS (SELECT t, list_transform(v, lambda x: x / t) AS p FROM one),
h(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN e.entropy >= e.least THEN (lo + hi) / 2 ELSE lo END, CASE WHEN e.entropy >= e.least THEN hi ELSE (lo + hi) / 2 END
  FROM h, LATERAL (SELECT ln(list_sum(list_transform(p, lambda x: pow(x, (lo + hi) / 2)))) - (lo + hi) / 2 * list_sum(list_transform(p, lambda x: pow(x, (lo + hi) / 2) * ln(x))) / list_sum(list_transform(p, lambda x: pow(x, (lo + hi) / 2))) AS entropy, 0.95 * ln(len(p)) - 1e-12 AS least FROM sh) e
  WHERE i < 50),
ex AS (SELECT t, p, CASE WHEN -list_sum(list_transform(p, lambda x: x * ln(x))) >= 0.95 * ln(len(p)) - 1e-12 THEN 1.0::DOUBLE ELSE round((SELECT lo FROM h WHERE i = 50), 9) END AS a FROM sh),
z AS (SELECT t, a, list_sum(list_transform(p, lambda x: pow(x, a))) AS z FROM ex),
plan AS (
  SELECT source, total, floor(CASE WHEN total > 0 THEN round(pow(total / t, a) / z * t, 3) ELSE 0 END)::BIGINT AS budget, ceil(docs / 4096)::BIGINT AS blocks FROM per, z),
plan2 AS (SELECT *, CASE WHEN total > 0 THEN budget // total ELSE 0 END AS passes FROM plan),
e AS (SELECT d.*, passes, budget - passes * total AS rest, (('0x' || doc[1:8])::BIGINT % blocks)::INTEGER AS block FROM d JOIN plan2 p ON d.source IS NOT DISTINCT FROM p.source),
b AS (
  SELECT source, block, sum(n) OVER (PARTITION BY source ORDER BY md5(concat_ws('|', '1', coalesce(source, ''), passes, block)), block ROWS UNBOUNDED PRECEDING) - n AS before
  FROM (SELECT source, block, passes, sum(tokens) AS n FROM e GROUP BY ALL)),
c AS (SELECT e.*, before, unnest(range(0, passes + 1)) AS epoch FROM e JOIN b ON e.block = b.block AND e.source IS NOT DISTINCT FROM b.source),
w AS (
  SELECT *, row_number() OVER o AS place, sum(tokens) OVER (o ROWS UNBOUNDED PRECEDING) AS run FROM c
  WINDOW o AS (PARTITION BY source, block, epoch ORDER BY md5(concat_ws('|', '1', epoch, doc)), doc_id))
SELECT doc_id, source, tokens::BIGINT AS tokens, epoch::INTEGER AS epoch, block, place::INTEGER AS place FROM w
WHERE epoch < passes OR before + run <= rest"""


#: Segments as in the operator; the last goal high enough in a start's stretch of D and U; then the chain of matches.
_OP13 = """
WITH RECURSIVE r AS (
  SELECT client_id, ts, click_id, CASE WHEN isfinite(value) THEN floor(100 * value + 0.5)::BIGINT END AS c, coalesce(kind = 'view', false) AS view, coalesce(kind <> 'error', false) AS good
  FROM (SELECT DISTINCT * FROM clicks) WHERE client_id IS NOT NULL AND ts IS NOT NULL),
o AS (
  SELECT *, row_number() OVER w AS i, lag(ts) OVER w AS before, lag(c) OVER w AS last
  FROM r WINDOW w AS (PARTITION BY client_id ORDER BY ts, click_id NULLS FIRST, c NULLS FIRST, good, view)),
k AS (
  SELECT *, coalesce(near AND good AND c < last, false) AS d, coalesce(near AND good AND c > last, false) AS u, coalesce(near AND view AND last IS NOT NULL, false) AS p
  FROM (SELECT *, c IS NOT NULL AND ts - before <= INTERVAL 15 MINUTE AS near FROM o)),
s AS (SELECT *, sum((NOT (d OR u))::INT) OVER (PARTITION BY client_id ORDER BY i) AS run FROM k),
-- a row that is P only ends the run before it; as a start it begins its own
g AS (SELECT client_id, i, c, CASE WHEN d OR u THEN run ELSE run - 1 END AS run FROM s WHERE p),
f AS (SELECT client_id, i, sum((NOT d)::INT) OVER (PARTITION BY client_id ORDER BY i) AS falls FROM s),
fe AS (SELECT client_id, falls, max(i) AS upto FROM f GROUP BY ALL),
m AS (
  SELECT s.client_id, s.i, max(g.i) AS p FROM s JOIN g ON s.client_id = g.client_id AND s.run = g.run AND g.i > s.i AND g.c >= s.c GROUP BY ALL),
e AS (
  SELECT m.client_id, m.i, m.p, CASE WHEN n.d THEN fe.upto ELSE m.p END AS e
  FROM m LEFT JOIN s n ON n.client_id = m.client_id AND n.i = m.p + 1 LEFT JOIN f ON f.client_id = m.client_id AND f.i = m.p + 1 LEFT JOIN fe ON fe.client_id = f.client_id AND fe.falls = f.falls),
-- the next match begins at the first start that matches from this one's last row on
nxt AS MATERIALIZED (SELECT a.client_id, a.i, min(b.i) AS to_ FROM e a JOIN e b ON a.client_id = b.client_id AND a.e <= b.i GROUP BY ALL),
v AS (
  SELECT client_id, min(i) AS i, 1 AS no FROM e GROUP BY client_id
  UNION ALL SELECT v.client_id, nxt.to_, v.no + 1 FROM v JOIN nxt ON v.client_id = nxt.client_id AND v.i = nxt.i)
SELECT v.client_id, v.no::BIGINT AS match_no, min(s.click_id) FILTER (s.i = e.i) AS first_id, min(s.click_id) FILTER (s.i = e.e) AS last_id, count(*) AS n_rows, sum(s.c)::BIGINT AS sum_cents,
  sha256(string_agg(CASE WHEN s.i = e.i THEN 'A' WHEN s.i = e.p THEN 'P' WHEN s.d THEN 'D' ELSE 'U' END, '' ORDER BY s.i)) AS labels_sha256
FROM v JOIN e ON v.client_id = e.client_id AND v.i = e.i JOIN s ON s.client_id = v.client_id AND s.i BETWEEN e.i AND e.e GROUP BY v.client_id, v.no"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": _OP1, "op4_embedding_near_dedup": _OP4, "op7_warc_normaliser": _OP7, "op10_temperature_mixing": _OP10, "op13_row_pattern_matching": _OP13}
