"""Sinks: append one period as a partition, audit rows with lineage, values as JSON. Written data is never changed in place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_label
from .numbering import numbered


class Refused(RuntimeError):
    """A gate refused to write."""


def append_period(spark: SparkSession, values: DataFrame, path: str, period_end: str) -> None:
    """values(company, row, value) as partition period_end=...: refused if any of its companies has that period already."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        there = spark.read.parquet(path).where(F.col("period_end") == F.lit(period_end).cast("date"))
        if not there.join(values.select("company").distinct(), "company", "left_semi").isEmpty():
            raise Refused(f"{period_end} is there already")
    values.withColumn("period_end", F.lit(period_end).cast("date")).write.mode("append").partitionBy("period_end").parquet(path)


def append_rows(old: DataFrame, new: DataFrame, keys: list[str], label: str, order: list[Column], keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """old(keys, ord, ..) with the rows of new(keys, ..) whose label their document lacks behind its own, in ``order``; old rows keep their place.

    Of several new rows with one label the first counts. Places are counted over partitions (``numbering``), so one document may have most rows.
    """
    norm = normalize_label(F.col(label))
    known = old.select(*keys, norm.alias("__norm"))
    # What is new under one label is one row before it meets the old ones.
    only = new.withColumn("__norm", norm).groupBy(*keys, "__norm").agg(F.min_by(F.struct(*new.columns), F.struct(*order)).alias("r"))
    first = only.join(known, [*keys, "__norm"], "left_anti").select("r.*")
    last = old.groupBy(*keys).agg((F.max("ord") + 1).alias("__after"))
    placed = numbered(first, keys, order, keep, "__place", "__total").join(last, keys, "left")
    placed = placed.withColumn("ord", F.col("__place") + F.coalesce("__after", F.lit(0)))
    return old.unionByName(placed.select(*[F.col(c) if c in placed.columns else F.lit(None).alias(c) for c in old.columns]))


def lineage(caption: Column, page: Column, header: Column, adjustments: Column) -> Column:
    """The note beside a value: where it was read, and what was done to it, a line each."""
    return F.concat_ws("\n", F.concat(F.lit("from '"), caption, F.lit("' on page "), page.cast("string")), F.concat(F.lit("column "), header), F.array_join(adjustments, "\n"))


def audit_rows(results: DataFrame, run_id: str) -> DataFrame:
    """One audit row for each result: what was written, or why not."""
    status = F.when(F.col("reason").isNotNull(), "refused").when(F.col("value").isNull(), "blank").otherwise("written")
    return results.withColumn("run_id", F.lit(run_id)).withColumn("status", status)


def values_json(results: DataFrame, keys: list[str]) -> DataFrame:
    """One JSON document for each company: {"values": [{row, value, reason}]}, rows in order."""
    item = F.struct("row", "value", "reason")
    return results.groupBy(*keys).agg(F.to_json(F.struct(F.array_sort(F.collect_list(item)).alias("values"))).alias("json"))


def shift_formula(formula: Column, from_col: int, to_col: int) -> Column:
    """A formula copied to another column: relative single-letter references move along, absolute ones stay."""
    step = to_col - from_col
    parts = F.regexp_extract_all(formula, F.lit(r"(\$?[A-Z]+\$?[0-9]+|[^A-Z$]+|[A-Z$]+)"), 1)
    moved = lambda p: F.concat(F.char(F.ascii(F.substring(p, 1, 1)) + F.lit(step)), F.substring(p, F.lit(2), F.length(p)))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^[A-Z]\$?[0-9]+$"), moved(p)).otherwise(p)), "")
