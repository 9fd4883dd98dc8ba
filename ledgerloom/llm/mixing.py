"""Mixing sources to target weights by hash-threshold histograms.

Every document has a uniform 60-bit hash of its id and text. Documents of a source are taken in hash order up to the
source's budget, without sorting them: the words of each source are summed by hash bucket, the bucket in which the
budget is reached is refined into sub-buckets, and so on until the bucket on the boundary can't be split further.
The thresholds nest: a larger budget takes a superset. A target above the source's size takes all its documents one
or two times and a hash prefix of them once more; so no document is taken more than three times.

Defined cases: null or empty texts have size 0 and are carried along; a null source is a source of its own and ranks
last; rows with one id and one text have one hash and fall on the same side; an empty table gives an empty result; a source or
corpus without words gets target 0. Extra columns are kept by ``mix_rows`` and ignored by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import core

#: One refinement splits a bucket in 2**12; five of them use up the 60 bits.
BITS, LEVELS = 12, 5
MAX_COPIES = 3
#: The table of sources (not of documents) is held on the driver and broadcast up to this many rows.
MAX_SOURCES = 100_000


def targets(sizes: dict, weights: dict, total: float | None = None, ceiling: float = MAX_COPIES) -> dict:
    """Water-filling: shares by weight, each held at ``ceiling`` times its size, the excess reshared by weight."""
    goal = float(sum(sizes.values()) if total is None else total)
    goal = min(goal, ceiling * float(sum(sizes.values())))
    free, out, left = {s for s in sizes if weights.get(s, 0) > 0}, {s: 0.0 for s in sizes}, goal
    while free:
        by = sum(weights[s] for s in free)
        full = {s for s in free if left * weights[s] > ceiling * sizes[s] * by}
        if not full:
            out.update({s: left * weights[s] / by for s in free})
            break
        out.update({s: float(ceiling * sizes[s]) for s in full})
        left -= sum(ceiling * sizes[s] for s in full)
        free -= full
    return out


def _order(source):
    return (source is None, (source or "").encode("utf-32-be"))


def default_weights(sources) -> dict:
    """1, 2, 3 repeating over the sources by code point, null last."""
    return {s: i % 3 + 1 for i, s in enumerate(sorted(sources, key=_order))}


def _hash():
    """A uniform hash of 60 bits of id and text, so that rows of one id (or of none) spread; a null counts as an empty string."""
    text = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text)), 1, 15), 16, 10).cast("long")


def thresholds(spark: SparkSession, base: DataFrame, weights=default_weights) -> DataFrame:
    """One row per source: its size, target, whole copies, and the hash below which documents come once more.

    base: source, size, h.
    """
    found = base.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: mixing holds one row per source on the driver")
    sizes = {r["source"]: r["size"] for r in found}
    goal = targets(sizes, weights(sizes))
    whole = {s: min(MAX_COPIES, int(goal[s] // n)) if n else 0 for s, n in sizes.items()}
    rest = {s: goal[s] - whole[s] * n for s, n in sizes.items()}
    limit = dict.fromkeys(sizes, 0)  # documents with a smaller hash are taken once more
    open_ = {s: (0, 0) for s in sizes if rest[s] > 0}  # source: boundary bucket, words before it
    for level in range(LEVELS):
        if not open_:
            break
        shift = BITS * (LEVELS - 1 - level)
        edge = spark.createDataFrame([(s, b, n, float(rest[s])) for s, (b, n) in open_.items()], "s string, bucket long, before long, rest double")
        inside = base.join(F.broadcast(edge), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", shift + BITS) == F.col("bucket")))
        sums = inside.groupBy("s", "before", "rest", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        run = sums.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("s").orderBy("b")))
        at = {r["s"]: r for r in run.where("upto > rest and upto - n <= rest").collect()}
        for s in list(open_):
            r = at.get(s)
            if r is None:  # all that is left fits
                limit[s] = (open_.pop(s)[0] + 1) << (shift + BITS)
            elif r["lo"] == r["hi"]:  # one hash value: taken if that comes nearer to the budget
                before = r["upto"] - r["n"]
                limit[s] = r["lo"] + (r["upto"] - rest[s] < rest[s] - before)
                open_.pop(s)
            else:
                open_[s] = (r["b"], r["upto"] - r["n"])
    return spark.createDataFrame([(s, n, float(goal[s]), whole[s], limit[s]) for s, n in sizes.items()], "s string, source_size long, target double, whole int, below long")


def _copies():
    return F.expr(f"cast(least({MAX_COPIES}, whole + if(h < below, 1, 0)) as int)")


def mix(spark: SparkSession, docs: DataFrame, weights=default_weights) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for each row of docs(doc_id, text, source)."""
    base = core.keep(spark, docs.select("doc_id", "source", core.n_words(F.col("text")).alias("size"), _hash().alias("h")), "mix_base")
    edge = thresholds(spark, base, weights)
    out = base.join(F.broadcast(edge), F.col("source").eqNullSafe(F.col("s"))).withColumn("copies", _copies())
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def mix_rows(spark: SparkSession, docs: DataFrame, weights=default_weights) -> DataFrame:
    """The mixed documents themselves: each row of ``docs`` as often as the mix takes it, with its own columns."""
    sized = docs.select("source", core.n_words(F.col("text")).alias("size"), _hash().alias("h"))
    edge = thresholds(spark, core.keep(spark, sized, "mix_base"), weights)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("source").alias("source"), _hash().alias("h"))
    rows = rows.join(F.broadcast(edge), F.col("source").eqNullSafe(F.col("s"))).withColumn("copies", _copies())
    return rows.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).select("row.*")
