"""Counts of what passes an exchange, without another pass over the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def observed(df: DataFrame, name: str, **more) -> tuple[DataFrame, Observation]:
    """``df``, and an observation that holds ``records`` and any further aggregates after an action."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("records"), *[c.alias(n) for n, c in more.items()]), seen
