"""The queries of the corpus operators: thin wrappers with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import lower_ascii

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query("op10_quality_rules")
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base quality counts and the n-gram ratio verdict of every document."""
    from . import quality as Q
    docs = table(spark, sf_dir, "documents")
    weights, threshold = Q.fit(docs, table(spark, sf_dir, "labels"))
    return Q.judge(docs, weights, threshold=threshold).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", F.round("score", 9).alias("score"))


@query("op1_packing")
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens, one row per piece."""
    from . import packing
    return packing.pack(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset", "context", "step_id")


#: Host, path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@query("op2_url_filters", """
WITH p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
r(rhost, rpath, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
j AS (
  SELECT p.*, rhost || rpath AS rule, verdict,
         row_number() OVER (PARTITION BY rid ORDER BY length(rhost || rpath) DESC NULLS LAST) AS k
  FROM (SELECT *, row_number() OVER () AS rid FROM p) p
  LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN regexp_matches(host, '(^|[.])spam') THEN 'block' ELSE 'allow' END) AS verdict
FROM j WHERE k = 1
""")
def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page URL; the block list is the corpus's hosts with a label that starts with spam."""
    from . import url_filter as U
    pages = table(spark, sf_dir, "pages")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    host = lower_ascii(F.regexp_extract("url", U.URL, 1))
    listed = pages.select(host.alias("key")).where(F.col("key").rlike("(^|[.])spam")).distinct()
    return U.judge_urls(pages, rules, listed)


@query("op8_sentencepiece")
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded; digests of the ids and of the decoded text."""
    from . import sentencepiece_codec as S
    out = S.encode(table(spark, sf_dir, "documents"))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
                      F.coalesce(F.array_max("ends"), F.lit(0)).cast("long").alias("covered_bytes"))


@query("op4_secret_scan")
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    from . import secret_scan as S
    out = S.scan(table(spark, sf_dir, "documents"))
    shown = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda x: x["kind"].isin(*S.BASE_KINDS))
    return out.select("doc_id", *[count(k) for k in S.BASE_KINDS],
                      F.sha2(F.array_join(F.transform(base, shown), ","), 256).alias("base_sha256"),
                      F.array_join(F.transform("spans", shown), ",").alias("spans"))


@query("op5_bit_sliced_topk")
def op5_bit_sliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best rows by integer inner product for every hundredth vector, against all others."""
    from . import topk
    vectors = table(spark, sf_dir, "embeddings")
    queries = topk.quantised_queries(vectors.where(F.col("vec_id") % 100 == 0))
    return topk.top_k(topk.build_index(vectors), queries)


@query("op3_minhash_near_dedup")
def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near-duplicates of every document."""
    from . import near_dup
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op9_line_dedup")
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without later copies of repeated runs of lines."""
    from . import line_dedup
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


@query("op6_sentence_span_dedup")
def op6_sentence_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without sentences of repeated passages."""
    from . import substring_dedup as S
    return S.dedup_spans(table(spark, sf_dir, "documents"))


#: The key of the registered query; real runs pass their own secret.
PII_KEY = "kestrel-demonstration-key"


@query("op7_pii_pseudonyms")
def op7_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with personal data replaced by pseudonyms."""
    from . import pii
    out = pii.pseudonymise(table(spark, sf_dir, "documents"), PII_KEY)
    return out.select("doc_id", "text", *[f"n_{k}" for k in pii.PATTERNS])


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document, tails repeated in every tenth one, and what is left without them."""
    from . import period_runs as R
    out = R.find_runs(R.repeated_tails(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    out = out.withColumn("longest", longest)
    length, period = F.col("longest.length"), -F.col("longest.period")
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.start")).alias("start"),
                      length.alias("length"), period.alias("period"),
                      F.floor(1000 * length / period).alias("exponent_milli"),
                      F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
                      F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op13_ranked_search", """
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                        '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
len AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM len),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                  '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
weight AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w
           FROM tf, total GROUP BY term),
s AS (
  SELECT item_id, doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // words)))))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN weight USING (term) JOIN len USING (doc_id), total
  GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
      FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 10
""")
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    from . import ranked_search
    return ranked_search.search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


@query("op11_suffix_dedup")
def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 50-byte strings that begin in an earlier one."""
    from . import suffix_dedup
    out = suffix_dedup.dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))
