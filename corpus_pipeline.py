"""The corpus pipeline: quality rules, line dedup, near-dedup, secret scan, packing.

Each stage reads what its predecessor kept. All but the last return the columns
of ``documents``; where a stage changes a text, ``n_chars`` follows. The stages'
results are written as Parquet and read again, so a lost executor costs at most
the tasks of one stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm import line_dedup, near_dup, packing, quality, secret_scan
from kestrel.llm.queries import table
from kestrel.llm.text import WORD
from kestrel.session import cut_lineage, ensure_checkpoint_dir, prepare

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    prepare(spark)
    weights, threshold = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, weights, threshold=threshold, keep=COLUMNS).where("kept").select("row.*")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go; documents with no word left go too."""
    prepare(spark)
    out = line_dedup.dedup_lines(docs, keep=("lang", "source", "n_chars"))
    changed = F.col("n_removed") > 0
    out = out.where(~changed | F.col("clean").rlike(WORD))
    size = F.when(changed, F.length("clean").cast("long")).otherwise(F.col("row.n_chars"))
    return out.select("doc_id", F.col("clean").alias("text"), "row.lang", "row.source", size.alias("n_chars"))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id.

    Rows equal in id and text are one document. Rows that share an id, or have none,
    but differ in text are documents of their own: the one with the smallest digest
    keeps the id, and the others are linked under numbers above all ids.
    """
    prepare(spark)
    rows = docs.select(*COLUMNS)
    shared = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL")
    shared = cut_lineage(shared.select(F.col("doc_id").alias("id")))
    if shared.isEmpty():
        kept = near_dup.near_duplicates(rows).where("kept").select("doc_id")
        return rows.join(kept, "doc_id", "left_semi").select(*COLUMNS)
    rows = rows.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    texts = rows.join(shared, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").select("doc_id", "digest").distinct()
    own = texts.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("digest").alias("digest"))
    more = texts.join(own, ["doc_id", "digest"], "left_anti")
    last = rows.agg(F.max("doc_id")).first()[0] or 0
    more = more.repartitionByRange("doc_id", "digest").sortWithinPartitions("doc_id", "digest")
    more = cut_lineage(more.select(F.col("doc_id").alias("id"), F.col("digest").alias("d"),
                                   (F.monotonically_increasing_id() + (last + 1)).alias("number")))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("d"))
    rows = rows.join(more, same, "left").select(*COLUMNS, F.coalesce("number", "doc_id").alias("key"))
    kept = near_dup.near_duplicates(rows, "key").where("kept").select(F.col("doc_id").alias("key"))
    one = rows.join(kept.distinct(), "key", "left_semi").groupBy("key").agg(F.min(F.struct(*COLUMNS)).alias("row"))
    return one.select("row.*")


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a marker of their kind; every document stays."""
    prepare(spark)
    return secret_scan.redact(docs, keep=COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences for training, in balanced step groups."""
    prepare(spark)
    return packing.pack(docs)


STAGES = [("quality rules", quality_stage), ("line dedup", line_dedup_stage),
          ("near-dedup", near_dup_stage), ("secret scan", secret_stage), ("packing", packing_stage)]

#: Tokenising and sketching have no SQL form; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    prepare(spark)
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{k}")
            docs = spark.read.parquet(f"{base}/{k}")
    return docs
