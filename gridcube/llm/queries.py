"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcube.llm import (decontaminate, embeddings, identifiers, language, lines, mixing, pages, phrases, quality, simhash,
                          spelling, tokens, url_filters)
from gridcube.llm.common import stage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    c = decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"))
    return c.select(
        "doc_id", "contamination.n_words", "contamination.n_hit", F.size("contamination.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("contamination.items", ","), 256).alias("items_sha256"), "contamination.contaminated")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    text_hash = F.when(F.col("doc_id").isNull(), F.md5(F.coalesce("text", F.lit("")))).alias("text_hash")
    sized = stage(docs.select("doc_id", "source", mixing.words(F.col("text")).alias("size"), text_hash), "sizes")
    return mixing.mix(sized, content="text_hash").select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op3_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = tokens.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    return counted.select("doc_id", size.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(_table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return found.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


def op5_identify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", language.held_out())
    trees = language.learn(docs.where("not held_out"))
    return language.identify(docs.select("doc_id", "held_out", "text"), trees).select(
        "doc_id", "held_out", "language.lang_pred", "language.score")


def op6_find_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identifiers.find_identifiers(_table(spark, sf_dir, "documents"))
    kind = [F.size(F.filter("seeds", identifiers.of_kind(name))).cast("bigint").alias(f"n_{name}") for name in identifiers.KINDS]
    return found.select("doc_id", *kind, F.sha2(identifiers.written(F.col("seeds")), 256).alias("base_sha256"),
                        identifiers.written(F.array_sort(F.concat("seeds", "added"))).alias("spans"))


def op7_score_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    views = quality.learn(docs, _table(spark, sf_dir, "labels"))
    return quality.score(docs, views).select("doc_id", "quality.p_text", "quality.p_meta", "quality.score", "quality.keep")


def op8_extract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.extract_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op9_dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs, wide=True).select("doc_id", "text", "removed_lines")


def op10_near_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_embeddings(_table(spark, sf_dir, "embeddings"))


def dropped_letter(doc_id: Column, run: Column) -> Column:
    """``run`` without one code point where 97 divides the crc32 of id and run."""
    h = F.crc32(F.concat(doc_id, F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    shorter = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % 97 == 0, shorter).otherwise(run)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.count_words(_table(spark, sf_dir, "documents"), rewrite=dropped_letter)
    return spelling.spelling_variants(words).select("word", "form", "root", "n", "n_near", "form_n")


#: (host, path, verdict): fixed by the query.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op12_filter_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filters.judge_urls(_table(spark, sf_dir, "pages"), rules).select("page_id", "url_filter.*")


def op13_mine_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.top_phrases(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_decontaminate, op2_mix_sources, op3_count_tokens, op4_simhash, op5_identify_language, op6_find_identifiers,
    op7_score_quality, op8_extract_pages, op9_dedup_lines, op10_near_embeddings, op11_spelling_variants, op12_filter_urls, op13_mine_phrases)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE = {
    "op1_decontaminate": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(13, len(w)) AS k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s
       FROM (SELECT *, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS s
       FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i
             FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
m AS (SELECT r, i, k, item FROM dw JOIN bw USING (k, s)),
h AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS j FROM m) GROUP BY r),
t AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)""",
    "op2_mix_sources": r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS drawn_by
           FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
-- one candidate level for each number of sources at their ceiling, lowest ceilings first
c AS (SELECT *, row_number() OVER (ORDER BY 3 * source_size / weight, source NULLS LAST) AS k FROM w),
l AS (SELECT a.k, a.source_size, a.weight,
             ((SELECT sum(source_size) FROM w) - coalesce(sum(3 * b.source_size) FILTER (b.k < a.k), 0))
             / sum(b.weight) FILTER (b.k >= a.k) AS level
      FROM c a, c b GROUP BY a.k, a.source_size, a.weight),
g AS (SELECT max(level) AS level FROM l WHERE 3 * source_size >= level * weight),
t AS (SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), level * weight) AS target FROM w, g),
r AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN least(3.0, target / source_size) ELSE 0 END AS rate,
             CAST(CAST('0x' || substr(md5('42:' || drawn_by), 1, 13) AS BIGINT) AS DOUBLE)
             / 4503599627370496 AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       size * CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken FROM r""",
    # links of the main kinds only: canonical links and refreshes with full URLs (pages hold no relative ones)
    "op12_filter_urls": r"""
WITH RECURSIVE r(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
     ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u AS (SELECT page_id, url, html,
             translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
             regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^#]*)', 1) AS rest
      FROM pages),
t AS (SELECT host || rest AS a, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\s[^>]*>')) AS tag
      FROM u WHERE host != '' AND regexp_matches(html, '(?i)canonical|http-equiv')),
d AS (SELECT a, CASE WHEN regexp_matches(tag, '(?i)\srel\s*=\s*["'']?canonical') THEN regexp_extract(tag, '(?i)\shref\s*=\s*["'']?([^"''\s>]*)', 1)
                     WHEN regexp_matches(tag, '(?i)http-equiv\s*=\s*["'']?refresh') THEN regexp_extract(tag, '(?i)url\s*=\s*["'']?([^"''\s>]*)', 1) END AS url
      FROM t),
e AS (SELECT a, lower(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)) || regexp_extract(url, '(?s)^.*?://[^/?#]*([^#]*)', 1) AS b
      FROM d WHERE url LIKE '%://%'),
k AS (SELECT DISTINCT host, path, host || rest AS node FROM u
      UNION SELECT regexp_extract(b, '^[^/?#]*'), regexp_extract(b, '^[^/?#]*([^?#]*)', 1), b FROM e),
m AS (SELECT node, max_by(rh || rp, length(rh || rp)) AS rule, max_by(v, length(rh || rp)) AS v
      FROM k JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY node),
l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
x(node) AS (SELECT node FROM m WHERE v = 'block' UNION SELECT l.b FROM x JOIN l ON l.a = x.node)
SELECT page_id, host, path, rule,
       coalesce(v, CASE WHEN host != '' AND host || rest IN (SELECT node FROM x) THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN m ON m.node = host || rest""",
    "op13_mine_phrases": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
                  unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS g
      FROM w, (VALUES (1), (2), (3)) AS s(k) WHERE len(w) >= k),
f AS (SELECT lang, k, g, count(*) AS a FROM g GROUP BY lang, k, g),
t AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, g, k, a, unnest(range(1, k)) AS cut FROM f WHERE k > 1 AND a >= 10),
s AS (SELECT c.lang, c.g, c.k, c.a, c.cut, l.a AS l, r.a AS r,
             CAST((CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
      FROM c JOIN f l ON l.lang = c.lang AND l.g = c.g[1:c.cut] JOIN f r ON r.lang = c.lang AND r.g = c.g[c.cut + 1:c.k]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
i AS (SELECT lang, g[1:2] AS g, a FROM f WHERE k = 3 AND a >= 10 UNION ALL SELECT lang, g[2:3], a FROM f WHERE k = 3 AND a >= 10),
o AS (SELECT lang, g, max(a) AS most FROM i GROUP BY lang, g),
q AS (SELECT b.lang, array_to_string(b.g, ' ') AS phrase, b.a, l, r, score
      FROM b LEFT JOIN o ON o.lang = b.lang AND o.g = b.g WHERE most IS NULL OR 100 * most < 50 * b.a)
SELECT q.lang, row_number() OVER (PARTITION BY q.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM q JOIN t ON t.lang = q.lang
QUALIFY rank <= 2000""",
}
