"""Column and literal helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the white space that ends a word, U+0020 and U+0009 to U+000D.
SPACES = " \t\n\x0b\f\r"
# Fixed value: a word.
WORD = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Array of the words of a text without NULL, in order."""
    one_space = F.translate(text, SPACES[1:], " " * (len(SPACES) - 1))
    return F.array_remove(F.split(one_space, " ", -1), "")


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(c, UPPER, LOWER)


def long_table(values: list[int]) -> Column:
    """A bounded lookup table as one constant array (folded once, not built per row)."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def double_table(values: list[float]) -> Column:
    """Like ``long_table`` for doubles; ``repr`` keeps every bit."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def take(df: DataFrame, **cols: str) -> DataFrame:
    """Only the named input columns under fixed names, so that no other column can clash."""
    return df.select(*[F.col(f"`{c}`").alias(k) for k, c in cols.items()])


def sealed(df: DataFrame) -> DataFrame:
    """The same rows, as a barrier for filters put on top.

    Without it the optimiser would write a filter in terms of the columns below,
    and with it every expression that those are made of, many times over.
    """
    return df.withColumn("_seal", F.spark_partition_id()).where("_seal >= 0").drop("_seal")
