"""Numbering rows in an order without bringing them, or one key's rows, together.

The rows are sorted by ranges over all partitions and written; what is counted then is one number for each key and partition. A row's place is the
number of its key's rows in earlier partitions plus its place in its own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[Column], keep: Callable[[DataFrame], DataFrame], place: str = "place", total: str = "total") -> DataFrame:
    """The rows with their place (from 0) among the rows of their key, in the given order, and how many those are.

    ``keep`` writes a table and reads it back, so that sorting is done once and a task that runs again finds the same order. Nulls in ``by`` are a key of
    their own. Rows that ``order`` doesn't tell apart are numbered in any order; a key with most rows is spread like the others, if ``order`` tells its rows apart.
    """
    keys = [F.col(c).asc_nulls_first() for c in by]
    columns = rows.columns
    sorted_ = keep(rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33).alias("__part")
    spans = sorted_.groupBy(*by, part).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    of_key = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    earlier = F.coalesce(F.sum("__n").over(of_key.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("__part").alias("__p"), (earlier - F.col("__first")).alias("__shift"), F.sum("__n").over(of_key).alias(total))
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by), F.shiftright("__at", 33) == F.col("__p"))
    return sorted_.join(spans, same).select(*columns, (F.col("__at") + F.col("__shift")).alias(place), total)
