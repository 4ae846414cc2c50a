"""Relational operators whose rows cross the exchange; Spark supplies them, these add what it lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.durable import row_salt


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", salts: int = 16) -> DataFrame:
    """An equi-join whose hot keys on the left are dealt over ``salts`` tasks.

    The right side is repeated ``salts`` times; ``how`` is inner, left, left_semi or left_anti.
    """
    a = left.withColumn("__weir_salt", row_salt(left, salts))
    b = right.withColumn("__weir_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, [key, "__weir_salt"], how).drop("__weir_salt")


def range_join(points: DataFrame, ranges: DataFrame, at: str, start: str, end: str, width: int) -> DataFrame:
    """Rows with start <= at < end (whole numbers): an equi-join on cells of ``width`` instead of a cross join."""
    cell = lambda c: F.floor(c / F.lit(width)).cast("long")
    a = points.withColumn("__cell", cell(F.col(at)))
    b = ranges.filter(F.col(start) < F.col(end)).withColumn("__cell", F.explode(F.sequence(cell(F.col(start)), cell(F.col(end) - 1))))
    return a.join(b, "__cell").filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__cell")


def cents(column: str | Column) -> Column:
    """Money as whole cents: sums do not depend on the order of rows."""
    return F.round((F.col(column) if isinstance(column, str) else column) * 100).cast("long")
