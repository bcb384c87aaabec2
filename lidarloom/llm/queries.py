"""The registered queries of the corpus operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lidarloom.llm import bpe, fingerprint, hnsw, html_text, packing, periodic, pii, simhash, substring, token_count, toxicity, url_filter, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_prefix_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(table(spark, sf_dir, "documents"))


def op2_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op3_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"))


def op4_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"))


def op6_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.deduplicate(docs).select("doc_id", "text", "n_removed", "removed")


def op7_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_prefix_fingerprints, op2_skip_chain_pii, op3_tree_bpe, op4_noisy_channel_toxicity, op5_token_counts, op6_sentence_spans, op7_hnsw, op8_url_rules, op9_best_fit_packing, op10_simhash, op11_whitening, op12_main_text, op13_periodic_runs)
    return {f.__name__: f for f in own}


SQL_LINKS = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS node, vec_id AS seen FROM v UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node), n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept FROM v JOIN c ON c.node = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""


def sql_urls() -> str:
    """The listed rules, and every combination of tokens tried outright."""
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in url_filter.RULES)
    u = url_filter
    return rf"""
WITH RECURSIVE u AS (SELECT page_id, url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{u.UPPER}', '{u.LOWER}'), '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(h, p, v) AS (VALUES {rules}),
m AS (SELECT u.page_id, h || p AS rule, v, row_number() OVER (PARTITION BY u.page_id ORDER BY length(h || p) DESC) AS k FROM u JOIN rules ON (host = h OR suffix(host, '.' || h)) AND prefix(path, p)),
j AS (SELECT u.*, m.rule, m.v FROM u LEFT JOIN m ON m.page_id = u.page_id AND m.k = 1),
a AS (SELECT page_id, list_filter(string_split(host, '.'), lambda x: x <> '') AS hp, list_filter(string_split(path, '/'), lambda x: x <> '' AND NOT regexp_full_match(x, '[0-9]+(\.[a-z]+)?')) AS pw,
  list_filter(list_transform(string_split(regexp_extract(url, '(?s)^[^?#]*\?([^#]*)', 1), '&'), lambda x: string_split(x, '=')[1]), lambda x: x <> '') AS qk FROM j WHERE host <> ''),
t AS (SELECT DISTINCT page_id, unnest(list_concat(list_transform(hp, lambda x: 'h:' || x), CASE WHEN len(hp) >= 2 THEN ['d:' || hp[-2] || '.' || hp[-1]] ELSE [] END, list_transform(pw, lambda x: 'p:' || x), list_transform(qk, lambda x: 'q:' || x))) AS t FROM a),
n AS (SELECT count(*) FILTER (v = 'block') AS b, count(*) FILTER (v = 'allow') AS a, count(*) FILTER (v IS NULL) AS o FROM j),
c AS (SELECT page_id, t AS c, t AS last FROM t UNION ALL SELECT c.page_id, c.c || ' ' || t.t, t.t FROM c JOIN t ON c.page_id = t.page_id AND c.last < t.t),
s AS (SELECT c.c, count(*) FILTER (j.v = 'block') AS b, count(*) FILTER (j.v = 'allow') AS a, count(*) FILTER (j.v IS NULL) AS o FROM c JOIN j USING (page_id) GROUP BY c.c),
p AS (SELECT c, s.b, s.a, s.b / greatest(1, n.b) AS pb, s.a / greatest(1, n.a) AS pa, {u.OPEN} * s.o / greatest(1, n.o) AS po, greatest({u.LEAST}, {u.SUPPORT} * (n.b + n.a)) AS least FROM s, n),
g AS (SELECT c, 'block' AS says FROM p WHERE b >= least AND pb / (pb + pa + po) >= {u.CONFIDENCE} UNION ALL SELECT c, 'allow' FROM p WHERE a >= least AND pa / (pb + pa + po) >= {u.CONFIDENCE}),
hit AS (SELECT c.page_id, CASE WHEN count(*) FILTER (says = 'allow') = 0 THEN 'block' ELSE 'allow' END AS says FROM c JOIN g USING (c) GROUP BY c.page_id)
SELECT j.page_id, host, path, rule, coalesce(v, hit.says, 'allow') AS verdict, v IS NULL AND hit.says IS NOT NULL AS mined FROM j LEFT JOIN hit ON hit.page_id = j.page_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_hnsw": SQL_LINKS, "op8_url_rules": sql_urls()}
