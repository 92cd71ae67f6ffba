"""Registered queries of the numbered operators, and expected results as SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from payrecon.llm.common import tuned

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(tuned(spark), sf_dir)
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_spaced_seed_decontamination(spark, sf_dir):
    from payrecon.llm.decontaminate import overlaps
    return overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query
def op2_pii_sanitisation(spark, sf_dir):
    from payrecon.llm.sanitise import report
    return report(_table(spark, sf_dir, "documents"))


@query
def op3_exact_top_k(spark, sf_dir):
    from payrecon.llm.topk import top_k
    vectors = _table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 20 = 0"), k=20)


@query
def op4_ngram_jaccard_join(spark, sf_dir):
    from payrecon.llm.jaccard import links
    return links(_table(spark, sf_dir, "documents"))


@query
def op5_sparse_suffix_array(spark, sf_dir):
    from payrecon.llm.suffixes import passages
    return passages(_table(spark, sf_dir, "documents"))


@query
def op6_content_defined_chunks(spark, sf_dir):
    from payrecon.llm.chunks import repeats
    return repeats(_table(spark, sf_dir, "documents"))


@query
def op7_secret_scan(spark, sf_dir):
    from payrecon.llm.secrets import report
    return report(_table(spark, sf_dir, "documents"))


@query
def op8_mixture_packing(spark, sf_dir):
    from payrecon.llm.packing import pack
    return pack(_table(spark, sf_dir, "documents"))


@query
def op9_stupid_backoff(spark, sf_dir):
    from payrecon.llm.backoff_lm import scores
    return scores(_table(spark, sf_dir, "documents"))


@query
def op10_word_first_language(spark, sf_dir):
    from payrecon.llm.langid import report
    return report(_table(spark, sf_dir, "documents"))


@query
def op11_bloom_cascade(spark, sf_dir):
    from payrecon.llm.urlfilter import report
    return report(_table(spark, sf_dir, "pages"))


@query
def op12_fim_piece_table(spark, sf_dir):
    from payrecon.llm.fim import report
    return report(_table(spark, sf_dir, "documents"))


@query
def op13_hat_trie_collocations(spark, sf_dir):
    from payrecon.llm.collocations import collocations
    return collocations(_table(spark, sf_dir, "documents"))


ORACLE_SQL = {
    "op11_bloom_cascade": """
WITH r(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u AS (
  SELECT row_number() OVER () AS rn, page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
    coalesce(nullif(regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1), ''), html) AS content
  FROM pages),
f AS (SELECT content, min(page_id) AS first_id FROM u GROUP BY content),
c AS (
  SELECT host, path FROM u LEFT JOIN f USING (content)
  GROUP BY host, path HAVING bool_and(coalesce(page_id > first_id, false))),
m AS (
  SELECT rn, r.host || r.path AS rule, verdict,
    row_number() OVER (PARTITION BY rn ORDER BY length(r.host || r.path) DESC, length(r.host) DESC, verdict DESC) AS k
  FROM u JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
SELECT page_id, u.host, u.path, rule, coalesce(verdict, CASE WHEN c.host IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM u LEFT JOIN m ON m.rn = u.rn AND m.k = 1 LEFT JOIN c ON c.host = u.host AND c.path = u.path""",
    "op3_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op12_fim_piece_table": """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
h AS (
  SELECT doc_id, text, units, CAST(len(units) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM d),
c AS (
  SELECT doc_id, text, n, units[1:least(h1 % (n + 1), h2 % (n + 1))] AS p,
    units[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))] AS m,
    units[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:n] AS s,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
         WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h),
t AS (
  SELECT doc_id, text, n, form, array_to_string(p, '') AS p, array_to_string(m, '') AS m, array_to_string(s, '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE p || m || s END) AS restored_sha256
FROM t""",
    "op13_hat_trie_collocations": r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
u AS (SELECT lang, unnest(w) AS w1 FROM w),
one AS (SELECT lang, w1, count(*) AS n FROM u GROUP BY ALL),
b AS (SELECT lang, unnest(w[:-2]) AS w1, unnest(w[2:]) AS w2 FROM w WHERE len(w) > 1),
two AS (SELECT lang, w1, w2, count(*) AS n FROM b GROUP BY ALL HAVING count(*) >= 10),
t AS (SELECT lang, unnest(w[:-3]) AS w1, unnest(w[2:-2]) AS w2, unnest(w[3:]) AS w3 FROM w WHERE len(w) > 2),
three AS (SELECT lang, w1, w2, w3, count(*) AS n FROM t GROUP BY ALL HAVING count(*) >= 10),
total AS (SELECT lang, sum(n) AS n FROM one GROUP BY lang),
longer AS (
  SELECT lang, w1, w2, max(n) AS n FROM (SELECT lang, w1, w2, n FROM three UNION ALL SELECT lang, w2, w3, n FROM three) GROUP BY ALL),
cuts AS (
  SELECT two.lang, two.w1 || ' ' || two.w2 AS phrase, two.n AS a, 1 AS k, x.n AS l, y.n AS r
  FROM two JOIN one x ON x.lang = two.lang AND x.w1 = two.w1 JOIN one y ON y.lang = two.lang AND y.w1 = two.w2
  LEFT JOIN longer g ON g.lang = two.lang AND g.w1 = two.w1 AND g.w2 = two.w2
  WHERE g.n IS NULL OR 100 * g.n < 50 * two.n
  UNION ALL
  SELECT s.lang, s.w1 || ' ' || s.w2 || ' ' || s.w3, s.n, 1, x.n, y.n
  FROM three s JOIN one x ON x.lang = s.lang AND x.w1 = s.w1 JOIN two y ON y.lang = s.lang AND y.w1 = s.w2 AND y.w2 = s.w3
  UNION ALL
  SELECT s.lang, s.w1 || ' ' || s.w2 || ' ' || s.w3, s.n, 2, x.n, y.n
  FROM three s JOIN two x ON x.lang = s.lang AND x.w1 = s.w1 AND x.w2 = s.w2 JOIN one y ON y.lang = s.lang AND y.w1 = s.w3),
scored AS (SELECT *, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cuts),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM scored),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest WHERE nth = 1)
SELECT ranked.lang, rank, phrase, a, l, r, CAST(total.n AS BIGINT) AS n, score
FROM ranked JOIN total ON total.lang = ranked.lang WHERE rank <= 2000""",
}
