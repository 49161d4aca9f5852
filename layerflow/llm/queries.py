"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from layerflow.llm import buckets, language, mixture, negatives, repetition, rules, sketches, spelling, suffixes, tokens, toxicity, vectors, warc
from layerflow.llm.common import materialize


def _table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def op1_toxicity(spark: SparkSession, directory: str) -> DataFrame:
    return toxicity.predictions(_table(spark, directory, "documents"), _table(spark, directory, "labels"))


def op2_repetition_rules(spark: SparkSession, directory: str) -> DataFrame:
    judged = repetition.judged(_table(spark, directory, "documents"))
    return judged.drop("longest_repeat")  # which has no SQL form; the verdict has


def op3_embedding_near_dedup(spark: SparkSession, directory: str) -> DataFrame:
    return vectors.near_vectors(_table(spark, directory, "embeddings"))


def op4_language_id(spark: SparkSession, directory: str) -> DataFrame:
    return language.predictions(_table(spark, directory, "documents"))


def op5_warc_salvage(spark: SparkSession, directory: str) -> DataFrame:
    return warc.round_trip(_table(spark, directory, "pages"))


def op6_suffix_array_dedup(spark: SparkSession, directory: str) -> DataFrame:
    cut = suffixes.without_repeats(_table(spark, directory, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_packing(spark: SparkSession, directory: str) -> DataFrame:
    return buckets.pack(_table(spark, directory, "documents"))


def op8_source_mixing(spark: SparkSession, directory: str) -> DataFrame:
    docs = mixture.with_domain(_table(spark, directory, "documents"))
    # Texts are read once, for their lengths.
    sized = materialize(docs.select("doc_id", "domain", "lang", "source", mixture.words().alias("size")), "sized")
    mixed = mixture.select(sized, mixture.WEIGHTS, share=0.6, epochs=2, tokens=F.col("size"))
    return mixed.select("doc_id", "domain", "lang", "source", "n_tokens", "copies", "tokens_taken")


def op9_token_packing(spark: SparkSession, directory: str) -> DataFrame:
    return tokens.round_trip(_table(spark, directory, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, directory: str) -> DataFrame:
    return sketches.near_duplicates(_table(spark, directory, "documents"))


def op11_hard_negatives(spark: SparkSession, directory: str) -> DataFrame:
    return negatives.mine(_table(spark, directory, "embeddings"), label=negatives.shifted_label())


def op12_spelling_variants(spark: SparkSession, directory: str) -> DataFrame:
    return spelling.variants(_table(spark, directory, "documents"))


def op13_quality_rules(spark: SparkSession, directory: str) -> DataFrame:
    return rules.predictions(_table(spark, directory, "documents"), _table(spark, directory, "labels"))


def pipeline(spark: SparkSession, directory: str) -> DataFrame:
    return corpus_pipeline.run(spark, directory)


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_repetition_rules, op3_embedding_near_dedup, op4_language_id, op5_warc_salvage, op6_suffix_array_dedup, op7_packing, op8_source_mixing, op9_token_packing, op10_minhash_near_dedup,
        op11_hard_negatives, op12_spelling_variants, op13_quality_rules, pipeline,
    )
}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_REACH = """
  {links},
  reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
  top AS (SELECT a, least(a, min(b)) AS component_id FROM reach GROUP BY a)
"""

SQL: dict[str, str] = {
    "op2_repetition_rules": f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
  lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t),
  dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
  place AS (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM t WHERE len(w) >= 8),
  win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 7], ' ')) AS n FROM place),
  rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM win WHERE n > 1) GROUP BY doc_id),
  far AS (SELECT doc_id, w, unnest(range(1, len(w) - 99)) AS i FROM t WHERE len(w) > 100),
  long AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, md5(array_to_string(w[i:i + 100], ' ')) AS h FROM far) GROUP BY doc_id, h HAVING count(*) > 1),
  base AS (
    SELECT t.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
      length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
      coalesce(rep.n, 0)::BIGINT AS n_repeat_words, long.doc_id IS NOT NULL AS is_long
    FROM t LEFT JOIN dup ON dup.doc_id = t.doc_id LEFT JOIN rep ON rep.doc_id = t.doc_id LEFT JOIN long ON long.doc_id = t.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  CASE WHEN n_words > 0 THEN n_repeat_words::DOUBLE / n_words ELSE 0.0::DOUBLE END AS covered_share,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_repeat_words::DOUBLE / n_words <= 0.25 AND NOT is_long AS kept
FROM base""",
    "op3_embedding_near_dedup": f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
  ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: x * x)) > 0),
  {_REACH.format(links="link AS (SELECT p.vec_id AS a, q.vec_id AS b FROM ok p JOIN ok q ON p.vec_id <> q.vec_id AND len(p.e) = len(q.e) WHERE list_cosine_similarity(p.e, q.e) >= 0.95)")}
SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component_id, v.vec_id) AS component_id, coalesce(component_id, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN (SELECT a, count(*) AS n FROM link GROUP BY a) d ON d.a = v.vec_id LEFT JOIN top ON top.a = v.vec_id""",
    "op5_warc_salvage": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, '')))::BIGINT AS n FROM pages),
  f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n AS payload_bytes, sha256(h) AS payload_digest,
  CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to
FROM f""",
    "op10_minhash_near_dedup": f"""
WITH RECURSIVE t AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
  s AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS sh
    FROM t),
  n AS (SELECT doc_id, len(sh)::BIGINT AS n_shingles FROM s),
  e AS (SELECT doc_id, unnest(sh) AS g FROM s),
  both_ AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM e p JOIN e q ON p.g = q.g AND p.doc_id <> q.doc_id GROUP BY 1, 2),
  {_REACH.format(links="link AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n_shingles + y.n_shingles - c))")}
SELECT n.doc_id, n_shingles, coalesce(component_id, n.doc_id) AS component_id, coalesce(component_id, n.doc_id) = n.doc_id AS kept
FROM n LEFT JOIN top ON top.a = n.doc_id""",
    "op11_hard_negatives": """
WITH r AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (
    SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, list_inner_product(a.v, b.v)::BIGINT AS score
    FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
  p AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank,
  s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.own AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
QUALIFY rank <= 3""",
    "op12_spelling_variants": """
WITH RECURSIVE tab AS (
    SELECT list(c ORDER BY i) AS t
    FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) r(i))),
  run AS (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents),
  times AS (SELECT doc_id, r, count(*) AS n FROM run WHERE length(r) >= 7 GROUP BY doc_id, r),
  byte_ AS (
    SELECT doc_id, r, n, flatten(list_transform(string_split(doc_id || ':' || r, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [195, 128 + unicode(x) % 64] END)) AS b FROM times),
  crc AS (
    SELECT r, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(b, lambda x: x::BIGINT)), lambda c, x: xor(c // 256, t[xor(c, x) % 256 + 1])), 4294967295) AS h FROM byte_, tab),
  cut AS (SELECT CASE WHEN h % 31 = 0 THEN left(r, (h % length(r))::INT) || substring(r, (h % length(r))::INT + 2) ELSE r END AS word, n FROM crc),
  w AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
  gap AS (SELECT word, n, i, left(word, i - 1) || substring(word, i + 1) AS g FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
  one AS (
    SELECT DISTINCT a.word, b.word AS other, b.n FROM gap a JOIN gap b ON a.g = b.g AND a.i = b.i AND a.word <> b.word
    UNION SELECT DISTINCT g.word, w.word, w.n FROM gap g JOIN w ON w.word = g.g
    UNION SELECT DISTINCT w.word, g.word, g.n FROM gap g JOIN w ON w.word = g.g),
  best AS (SELECT word, count(*) AS n_near, max(n) AS top, arg_min(other, (-n, other)) AS other FROM one GROUP BY word),
  f AS (
    SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top >= 10 * w.n THEN other END AS form, CASE WHEN top >= 10 * w.n THEN top END::BIGINT AS form_n
    FROM w LEFT JOIN best ON best.word = w.word),
  chain(word, root, step) AS (
    SELECT word, form, 1 FROM f WHERE form IS NOT NULL UNION ALL SELECT c.word, f.form, step + 1 FROM chain c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL),
  top AS (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word)
SELECT f.word, form, coalesce(root, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN top ON top.word = f.word""",
}
