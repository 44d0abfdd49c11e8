"""Quality rules: base rules and a hashed n-gram log-likelihood ratio.

Every document gets the score

    mean over its hashed 1- and 2-grams of  log p_target(bucket) - log p_raw(bucket)

where ``p_raw`` is the multinomial of hashed n-grams over ALL documents and
``p_target`` that of the trusted documents, smoothed towards ``p_raw``. The
counts come from one distributed aggregation onto a fixed number of buckets,
so the only thing that travels through the driver is a table whose size does
not depend on the data. Scoring is a projection: no shuffle, no Python.

The verdict's threshold is a low quantile of the trusted documents' own scores.
A document scores higher under weights that it helped to fit, so each is scored
with weights from the other folds: the quantile is one of unseen documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import SPACES, WORD, double_table, sealed, take, words

BUCKETS = 4096            # per n-gram order
TARGET_ROWS = 20_000      # bound of the labelled sample that names trusted documents
SMOOTHING = 0.05          # weight of the raw multinomial inside the target multinomial
THRESHOLD = -0.3          # nats per n-gram; used where no trusted document gives a threshold
FOLDS = 5                 # folds of trusted documents, each scored by the weights of the others
LOSS = 0.001              # share of trusted documents that may fall below the fitted threshold
MIN_WORDS = 10            # words; the base rules reject shorter documents
SYMBOLS = "#*$%&|<>"      # fixed value


def _hashed(df: DataFrame) -> DataFrame:
    """Add ``w`` (words) and ``h`` (their 64-bit hashes)."""
    df = df.withColumn("w", words(F.coalesce(F.col("text"), F.lit(""))))
    return df.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))


def _bucket(first: Column, second: Column) -> Column:
    """Bucket of a 2-gram; 1-grams take the buckets below BUCKETS."""
    return F.pmod(F.xxhash64(first, second), F.lit(BUCKETS)) + BUCKETS


def trusted_ids(labels: DataFrame, limit: int = TARGET_ROWS) -> DataFrame:
    """At most ``limit`` ids of documents labelled good and not toxic.

    The choice is the rows of smallest id hash: the same on every run and
    independent of how the labels are stored.
    """
    good = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0))
    good = good.select("doc_id").where(F.col("doc_id").isNotNull()).distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def _fold(id_col: Column) -> Column:
    return F.pmod(F.xxhash64(id_col, F.lit(1)), F.lit(FOLDS)).cast("int")


def _counts(docs: DataFrame, good: DataFrame) -> tuple[list[int], list[list[int]]]:
    """n-gram counts per bucket: of all documents, and of the trusted ones by fold."""
    # At most `limit` ids of 8 bytes: a broadcast of proven size, so texts are not shuffled.
    d = docs.join(F.broadcast(good.withColumn("t", _fold(F.col("doc_id")))), "doc_id", "left")
    d = _hashed(d).select("h", F.coalesce("t", F.lit(-1)).alias("t"))
    nxt = F.slice("h", F.lit(2), F.greatest(F.size("h") - 1, F.lit(0)))
    pairs = d.select("t", F.explode(F.arrays_zip(F.col("h").alias("a"), nxt.alias("b"))).alias("p"))
    grams = pairs.select("t", F.explode(F.array(
        F.pmod(F.col("p.a"), F.lit(BUCKETS)), _bucket(F.col("p.a"), F.col("p.b")))).alias("bucket"),
        F.col("p.b").isNull().alias("last"))
    grams = grams.where(~(F.col("last") & (F.col("bucket") >= BUCKETS)))
    raw, target = [0] * (2 * BUCKETS), [[0] * (2 * BUCKETS) for _ in range(FOLDS)]
    found = grams.groupBy("bucket", "t").count().toArrow()  # at most 2 * BUCKETS * (FOLDS + 1) rows
    for bucket, t, n in zip(*(found.column(c).to_pylist() for c in ("bucket", "t", "count"))):
        raw[bucket] += n
        if t >= 0:
            target[t][bucket] = n
    return raw, target


def fit_weights(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                text_col: str = "text", limit: int = TARGET_ROWS) -> list[float]:
    """Log ratio per bucket. Raw counts cover all documents and whole texts.

    Without labelled documents or without any n-gram all weights are 0.
    """
    raw, target = _counts(take(docs, doc_id=id_col, text=text_col), trusted_ids(labels, limit))
    return log_ratios(raw, [sum(x) for x in zip(*target)])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        limit: int = TARGET_ROWS) -> tuple[list[float], float]:
    """``fit_weights`` and the threshold: the LOSS quantile of held-out scores of the trusted documents.

    Documents of fewer than MIN_WORDS words fail anyway and don't count. Without any
    other trusted document, or where one fold holds all of them, it is THRESHOLD.
    """
    d, good = take(docs, doc_id=id_col, text=text_col), trusted_ids(labels, limit)
    raw, target = _counts(d, good)
    total = [sum(x) for x in zip(*target)]
    weights = log_ratios(raw, total)
    if sum(any(x) for x in target) < 2:
        return weights, THRESHOLD
    held_out = [(k, log_ratios(raw, [a - b for a, b in zip(total, x)])) for k, x in enumerate(target)]
    # One row a fold, joined by the fold: as rows the tables stay out of the plan's text.
    tables = docs.sparkSession.createDataFrame(held_out, "fold int, weights array<double>")
    seen = _hashed(d.join(F.broadcast(good), "doc_id", "left_semi")).where(F.size("w") >= MIN_WORDS)
    seen = seen.withColumn("fold", _fold(F.col("doc_id"))).join(F.broadcast(tables), "fold")
    low = seen.select(_score(F.col("weights")).alias("score")).agg(F.percentile("score", LOSS)).first()[0]
    return weights, THRESHOLD if low is None else low


def log_ratios(raw: list[int], target: list[int]) -> list[float]:
    """Weights of both orders; each order is a multinomial of its own."""
    out: list[float] = []
    for lo in (0, BUCKETS):
        r, t = raw[lo:lo + BUCKETS], target[lo:lo + BUCKETS]
        n, m = sum(r), sum(t)
        for x, y in zip(r, t):
            if x == 0 or m == 0:
                out.append(0.0)
            else:
                p = x / n
                out.append(math.log(((1 - SMOOTHING) * y / m + SMOOTHING * p) / p))
    return out


def _score(table: Column) -> Column:
    """Mean weight of a document's n-grams."""
    n = F.size("w")
    weight = lambda bucket: F.get(table, bucket.cast("int"))
    uni = F.aggregate("h", F.lit(0.0), lambda a, x: a + weight(F.pmod(x, F.lit(BUCKETS))))
    bi = F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(0.0), lambda a, i: a + weight(
        _bucket(F.get("h", i - 1), F.get("h", i))))
    return F.when(n >= 2, (uni + bi) / (2 * n - 1)).when(n == 1, uni).otherwise(F.lit(0.0))


def judge(docs: DataFrame, weights: list[float], id_col: str = "doc_id",
          text_col: str = "text", threshold: float = THRESHOLD, keep: tuple = ()) -> DataFrame:
    """One row per document: the base counts, ``base_failed``, ``score`` and ``kept``.

    ``keep`` names input columns to carry along (as a struct ``row``). NULL and
    empty texts have no words: counts 0, score 0, ``base_failed`` true. A NULL id
    is an ordinary value. Repeated rows are judged one by one, alike.
    """
    ids = [F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")]
    carry = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")] if keep else []
    d = _hashed(docs.select(*ids, *carry))
    n = F.size("w")
    starts = F.sequence(F.lit(0), n - 5)
    d = d.select(
        "*", n.alias("n_words"),
        F.when(n >= 5, F.transform(starts, lambda i: F.xxhash64(
            *[F.get("h", i + k) for k in range(5)]))).alias("g"),
        F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD)).alias("lines"))
    # Equal windows have equal hashes, so only documents with an equal pair of
    # hashes are compared by the words themselves.
    suspect = F.size(F.array_distinct("g")) < F.size("g")
    d = d.withColumn("s", F.when(suspect, F.sort_array(F.transform(
        starts, lambda i: F.struct(F.array_join(F.slice("w", i + 1, 5), " ").alias("g"), i.alias("p"))))))
    same = lambda x, k: x["g"] == F.get("s", k)["g"]
    d = d.withColumn("p", F.sort_array(F.transform(
        F.filter("s", lambda x, k: F.coalesce(same(x, k - 1), F.lit(False)) | F.coalesce(same(x, k + 1), F.lit(False))),
        lambda x: x["p"])))
    covered = F.aggregate(
        F.transform("p", lambda p, k: F.least(F.lit(5), F.coalesce(F.get("p", k + 1) - p, F.lit(5)))),
        F.lit(0).cast("bigint"), lambda a, x: a + x)
    out = d.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("bigint")).alias("n_repeat_words"),
        _score(double_table(weights)).alias("score"), *(["row"] if keep else []))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = sealed(out).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
