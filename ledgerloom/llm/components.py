"""Connected components of a link table, by alternating large-star and small-star steps; nothing goes to the driver.

Both steps keep the components and hang nodes on smaller ones; when nothing changes, each node hangs on its component's smallest.
A node may have a third of all links, so no step brings a node's links together by the node alone: they are dealt by
(node, salt), a minimum is taken of each salt and then of the node's minima, of which there are at most as many as salts, and goes back
to the links by a join on both. Small and large graphs take the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import core


def salts(spark: SparkSession) -> int:
    """A hot key is spread over as many salts as there are shuffle partitions."""
    return max(32, core.partitions(spark))


def with_least(rows: DataFrame, key: str, value: Column, spread: Column, n: int, name: str) -> DataFrame:
    """The rows and the smallest ``value`` of their key, in a column ``name``. ``spread``: what rows of one key differ in."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(n)).cast("int"))
    part = salted.groupBy(F.col(key).alias("part_key"), F.col("salt").alias("part_salt")).agg(F.min(value).alias("least"))
    back = part.select("part_key", "part_salt", F.min("least").over(Window.partitionBy("part_key")).alias(name))  # at most n rows of a key
    return salted.join(back, (F.col(key) == F.col("part_key")) & (F.col("salt") == F.col("part_salt"))).drop("salt", "part_key", "part_salt")


def _lowest(directed: DataFrame, n: int) -> DataFrame:
    """directed(u, v) with m: the smallest of u and its neighbours."""
    return with_least(directed, "u", F.least("u", "v"), F.col("v"), n, "m")


def _large(links: DataFrame, n: int) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _lowest(both, n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(links: DataFrame, n: int) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    hung = _lowest(down, n)
    return hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(hung.select("u", F.col("m").alias("v")))


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """node, component for each node of links(u, v): the smallest node that it reaches."""
    scratch, n, state = core.Scratch(spark), salts(spark), None
    now = scratch.keep(links.where("u <> v").select("u", "v").distinct(), "links")
    while True:
        # What changes is the set of links: its size and two sums that are the same only for equal sets (but for chance).
        now = scratch.keep(_small(_large(now, n), n).where("u <> v").distinct(), "links")
        found = tuple(now.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if found == state:
            break
        state = found
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    return scratch.finish(out, "components")
