"""Turning cumulative figures into standalone periods, trailing sums, contiguity and cadence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.periods import periods_to_subtract


def year_to_date(facts: DataFrame, keys: list[str], fiscal_start: int = 1) -> DataFrame:
    """Adds fy, months and ytd: the running sum inside a fiscal year."""
    shift = F.add_months("period_end", -(fiscal_start - 1))
    w = Window.partitionBy(*keys, "fy").orderBy("period_end").rowsBetween(Window.unboundedPreceding, 0)
    return facts.withColumn("fy", F.year(shift)).withColumn("months", F.month(shift)).withColumn("ytd", F.sum("value").over(w))


def decumulate(figures: DataFrame, history: DataFrame, keys: list[str], cadence: int) -> DataFrame:
    """figures(keys, period_end, months, printed) less the sums of the prior periods in history(keys, period_end, value).

    A figure of n cadences needs n - 1 prior periods inside its span; if any is missing the value is null with a reason.
    """
    need = figures.withColumn("n_prior", periods_to_subtract(F.col("months"), F.lit(cadence)))
    h = history.select(*[F.col(k).alias(f"h_{k}") for k in keys], F.col("period_end").alias("h_end"), F.col("value").alias("h_value"))
    same = [F.col(k) == F.col(f"h_{k}") for k in keys]
    inside = (F.col("h_end") < F.col("period_end")) & (F.col("h_end") > F.last_day(F.add_months("period_end", -F.col("months"))))
    joined = need.join(h, [*same, inside], "left")
    group = [*keys, "period_end", "months", "printed", "n_prior"]
    out = joined.groupBy(*group).agg(F.count("h_value").alias("n_found"), F.sum("h_value").alias("prior"))
    value = F.when(F.col("n_prior") == 0, F.col("printed")).when(F.col("n_found") == F.col("n_prior"), F.col("printed") - F.col("prior"))
    reason = F.when(F.col("n_prior").isNull(), "span_not_a_multiple").when(F.col("n_found") < F.col("n_prior"), "decumulation_missing_prior")
    return out.withColumn("value", value).withColumn("reason", reason)


def months_apart(later: Column, earlier: Column) -> Column:
    return F.rint(F.datediff(later, earlier) / 30.44).cast("int")


def cadence(periods: DataFrame, keys: list[str]) -> DataFrame:
    """The usual gap between periods: the upper median in months, snapped to 3, 6 or 12."""
    w = Window.partitionBy(*keys).orderBy("period_end")
    gaps = periods.withColumn("gap", months_apart(F.col("period_end"), F.lag("period_end").over(w))).where("gap is not null")
    sorted_ = gaps.groupBy(*keys).agg(F.sort_array(F.collect_list("gap")).alias("gaps"))
    middle = F.element_at("gaps", F.floor(F.size("gaps") / 2).cast("int") + 1)
    return sorted_.select(*keys, F.element_at(F.transform(F.array_sort(F.transform(F.array(F.lit(3), F.lit(6), F.lit(12)), lambda c: F.struct(F.abs(c - middle).alias("d"), c.alias("c")))), lambda x: x["c"]), 1).alias("cadence"))


def islands(periods: DataFrame, keys: list[str], step: int) -> DataFrame:
    """Adds island: a number for each run of periods that follow one another at ``step`` months."""
    w = Window.partitionBy(*keys).orderBy("period_end")
    apart = months_apart(F.col("period_end"), F.lag("period_end").over(w))
    return periods.withColumn("new", F.when(F.abs(apart - step) <= 1, 0).otherwise(1)).withColumn("island", F.sum("new").over(w)).drop("new")
