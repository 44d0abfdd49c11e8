"""Exact k-nearest neighbours in any number of numeric features.

Points lie in cells around pivots; a query looks only at cells that can hold an
answer by the triangle inequality (``pivots``). Equal points ask once, and of equal
reference points only as many are looked at as an answer can hold, so neither dense
regions nor repeated points make more pairs than a few cells hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import pivots

MAX_DIM = 4     # up to here small cells are best; above, a query meets most cells and few large ones are


def knn(query: DataFrame, ref: DataFrame, q_id: str, cols, k: int, ref_keep=(), exclude_self: bool = False,
        r_id: str | None = None, by=()) -> DataFrame:
    """(q_id, neighbour columns..., _dist, _rank) for the k nearest ``ref`` rows.

    ``ref_keep`` columns of the reference are carried (e.g. a label).
    Ties at the k-th distance are broken by the reference key.
    With ``exclude_self`` a reference row with the same id as the query is skipped.
    ``by`` columns restrict neighbours to rows with equal values (e.g. a class).
    Rows with a NULL or NaN feature take no part.
    """
    if len(list(cols)) <= MAX_DIM:
        return _search(query, ref, q_id, cols, k, ref_keep, exclude_self, r_id, by, pivots.CELL_ROWS, "_row")
    cell_rows = max(pivots.CELL_ROWS, -(-ref.count() // pivots.WIDE_CELLS))
    return knn_wide(query, ref, q_id, cols, k, ref_keep, exclude_self, r_id, by, cell_rows)


def knn_wide(query: DataFrame, ref: DataFrame, q_id: str, cols, k: int, ref_keep=(), exclude_self: bool = False,
             r_id: str | None = None, by=(), cell_rows: int = pivots.CELL_ROWS) -> DataFrame:
    """``knn`` on cells that hold about ``cell_rows`` points. A neighbour found brings all reference rows of its id."""
    return _search(query, ref, q_id, cols, k, ref_keep, exclude_self, r_id, by, cell_rows, "_rid", rounds=True)


def _search(query, ref, q_id, cols, k, ref_keep, exclude_self, r_id, by, cell_rows, brings, rounds=False):
    by, cols, r_id = list(by), list(cols), r_id or q_id
    kept = [x for x in ref_keep if x not in by]
    asked = pivots.nulls_out(query, cols).select(F.col(q_id).alias("_qid"), "_v", *by)
    rows = pivots.nulls_out(ref, cols).select(F.col(r_id).alias("_rid"), "_v", *kept, *by)
    rows = cut_lineage(rows.withColumn("_row", F.monotonically_increasing_id()))
    found = pivots.nearest(asked, rows.select("_row", "_rid", "_v", *by), k, by, exclude_self, cell_rows, rounds=rounds)
    found = found.drop(*{"_row", "_rid"} - {brings})
    return found.join(rows, brings).select(F.col("_qid").alias(q_id), F.col("_rid").alias(f"nn_{r_id}"),
                                           *[F.col("_v")[i].alias(c) for i, c in enumerate(cols)], *kept, *by, "_dist", "_rank")


def knn_classify(train: DataFrame, test: DataFrame, id_col: str, cols, label: str, k: int = 5,
                 exclude_self: bool = False) -> DataFrame:
    """Majority vote of the k nearest training rows (ties -> smallest label).

    ``exclude_self`` gives leave-one-out scoring when ``test`` is ``train``.
    """
    nb = knn(test, train, id_col, cols, k, ref_keep=[label], exclude_self=exclude_self)
    votes = nb.groupBy(id_col, label).agg(F.count(F.lit(1)).alias("_v"))
    w = Window.partitionBy(id_col).orderBy(F.col("_v").desc(), F.col(label).cast("string"))
    best = votes.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(id_col, F.col(label).alias("pred"))
    return test.join(best, id_col, "left")
