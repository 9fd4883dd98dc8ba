"""Filing-like facts from the driver's tables: companies (nations), captions (part types), quarters and their figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import load

#: The last quarter of the order dates is partial and is left out as no filing would report it.
FIRST_PARTIAL = "2001-07-01"


def quarter_end(day):
    return F.last_day(F.add_months(F.trunc(day, "quarter"), 2))


def quarterly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """company, caption, period_end, value: one figure for each company, line and quarter, in ten-thousandths.

    Whole numbers keep sums exact, whatever the order in which tasks add them. Lines meet orders by key; suppliers and parts are joined before
    the only aggregation, because there are nearly as many quarters, suppliers and parts together as lines: summing by them
    first would send all rows once more. Each task then sends its partial sums by company, caption and quarter.
    """
    orders = load(spark, sf_dir, "orders").where(F.col("o_orderdate") < FIRST_PARTIAL).select("o_orderkey", quarter_end(F.col("o_orderdate")).alias("period_end"))
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", (F.round(F.col("l_extendedprice") * 100).cast("long") * F.round((1 - F.col("l_discount")) * 100).cast("long")).alias("amount"))
    supplier = load(spark, sf_dir, "supplier").join(load(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("company"))
    part = load(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("caption"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy("company", "caption", "period_end").agg(F.sum("amount").cast("double").alias("value"))


#: The same facts for the oracle, as the body of a CTE.
QUARTERLY = f"""
    SELECT n_name AS company, p_type AS caption, last_day(CAST(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH AS DATE)) AS period_end,
           CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round((1 - l_discount) * 100) AS BIGINT)) AS DOUBLE) AS value
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey
    WHERE o_orderdate < DATE '{FIRST_PARTIAL}' GROUP BY ALL"""
