"""Queries of the corpus operators over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ann, byte_bpe, language, lexical, mixing, near_dup, ngram_lm, quality, repeats, secret_scan, token_store, url_filter
from .common import documents

#: Rules of the URL query: (action, host and path).
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op1_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score(documents(spark, sf_dir))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(documents(spark, sf_dir))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir))


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.groups(documents(spark, sf_dir), words=2)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ", ".join(f"('{action}', '{rule}')" for action, rule in URL_RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS rules(action, rule)")
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


OP5_SQL = """
WITH rules(action, host, path) AS (VALUES
  ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS r FROM pages),
parts AS (SELECT page_id, row_number() OVER () AS k,
  coalesce(translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path FROM rest),
fits AS (SELECT k, arg_min({'rule': u.host || u.path, 'action': action}, (-length(u.host || u.path), action <> 'block', u.host || u.path)) AS best
  FROM parts p JOIN rules u ON (p.host = u.host OR ends_with(p.host, '.' || u.host)) AND starts_with(p.path, u.path) GROUP BY k)
SELECT page_id, p.host, p.path, best.rule AS rule, coalesce(best.action, 'allow') AS verdict FROM parts p LEFT JOIN fits USING (k)
"""


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(documents(spark, sf_dir))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = r"""
WITH kept AS (SELECT row_number() OVER () AS k, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
tokens AS (SELECT k, unnest(regexp_extract_all(body, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM kept),
tf AS (SELECT k, term, count(*) AS tf FROM tokens GROUP BY ALL),
sizes AS (SELECT k, sum(tf)::BIGINT AS n FROM tf GROUP BY k),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS len FROM sizes),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
weighed AS (SELECT item_id, term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM asked JOIN df USING (term), whole),
scored AS (SELECT item_id, k, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // len))))::BIGINT AS score
  FROM weighed JOIN tf USING (term) JOIN sizes USING (k), whole GROUP BY item_id, k)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM scored JOIN kept USING (k) WHERE score > 0 QUALIFY rank <= 10
"""


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(documents(spark, sf_dir))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT k, doc_id, i, array_to_string(w[i:i+12], ' ') AS phrase FROM d, unnest(range(1, len(w) - 11)) AS t(i)),
earliest AS (SELECT phrase, min(doc_id) AS low FROM windows GROUP BY phrase),
gone AS (SELECT DISTINCT k, i + o AS i FROM windows JOIN earliest USING (phrase), range(13) AS r(o) WHERE low < doc_id),
words AS (SELECT k, i, w[i] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(i)),
kept AS (SELECT k, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (k, i) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (k)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_lm, op2_source_mixing, op3_quality, op4_near_dup, op5_url_filter, op6_byte_bpe, op7_token_store, op8_secret_scan, op9_nearest, op10_language, op11_alignment, op12_lexical, op13_repeats)}


def oracle_sql() -> dict[str, str]:
    return {"op5_url_filter": OP5_SQL, "op12_lexical": OP12_SQL, "op13_repeats": OP13_SQL}
