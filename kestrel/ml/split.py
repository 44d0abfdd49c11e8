"""Repeatable train/test splits and fold assignment.

Rows are ordered by a seeded hash of a key (uniform on [0, 1)), so a split does
not depend on partitioning or row order, unlike ``randomSplit``. Every row is
marked once as train or test, so repeated rows and NULL keys stay in exactly one.
The test part has exactly ceil(test_size * n) rows (the scikit-learn rule);
stratified splits give every class its share by the largest-remainder rule.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.features import class_counts, hash_uniform, mark_k_smallest

DEFAULT_SEED = 42          # the reference seeds its split with 42
DEFAULT_TEST_SIZE = 0.2    # the reference's default test share


def _check(test_size):
    if not 0.0 < test_size < 1.0:
        raise ValueError("test_size must be in (0, 1)")


def train_test_split(df: DataFrame, test_size: float = DEFAULT_TEST_SIZE, seed: int = DEFAULT_SEED,
                     key_cols=None) -> tuple[DataFrame, DataFrame]:
    """(train, test) with |test| = ceil(test_size * n)."""
    _check(test_size)
    key_cols = list(key_cols or df.columns)
    n = df.count()
    d = df.withColumn("_u", hash_uniform(seed, key_cols))
    return _parts(mark_k_smallest(d, None, "_u", {0: math.ceil(test_size * n)}, key_cols, {0: n}))


def _parts(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(train, test) of the marked rows."""
    return marked.where("NOT _in").drop("_u", "_in"), marked.where("_in").drop("_u", "_in")


def stratified_allocation(counts: dict, test_size: float) -> dict:
    """Per-class test sizes summing to ceil(test_size * n), largest remainders first."""
    n = sum(counts.values())
    total = math.ceil(test_size * n)
    exact = {c: test_size * m for c, m in counts.items()}
    alloc = {c: math.floor(v) for c, v in exact.items()}
    rest = total - sum(alloc.values())
    for c in sorted(counts, key=lambda c: (-(exact[c] - alloc[c]), str(c)))[:max(0, rest)]:
        alloc[c] += 1
    return alloc


def stratified_split(df: DataFrame, target: str, test_size: float = DEFAULT_TEST_SIZE,
                     seed: int = DEFAULT_SEED, key_cols=None) -> tuple[DataFrame, DataFrame]:
    """(train, test) with the same share of every class in test."""
    _check(test_size)
    key_cols = list(key_cols or df.columns)
    counts = class_counts(df, target)
    alloc = stratified_allocation(counts, test_size)
    d = df.withColumn("_u", hash_uniform(seed, key_cols))
    return _parts(mark_k_smallest(d, target, "_u", alloc, key_cols, counts))


def fold_ids(df: DataFrame, k: int = 5, target: str | None = None, seed: int = DEFAULT_SEED,
             key_cols=None, out: str = "fold") -> DataFrame:
    """Assign folds 0..k-1. With ``target``, folds are stratified: inside each
    class, rows ordered by hash are dealt round-robin over folds (via a
    distributed position, so class sizes do not matter)."""
    from ..operators.position import global_position
    key_cols = list(key_cols or df.columns)
    d = df.withColumn("_u", hash_uniform(seed, key_cols))
    keys = [target] if target else []
    p = global_position(d, keys, ["_u"] + key_cols)
    return p.withColumn(out, (F.col("_pos") % k).cast("int")).drop("_pos", "_u")
