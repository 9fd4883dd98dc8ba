"""Figures against witnesses: a second reading, subtotals, chains.

``keys`` name the page or statement that figures and witnesses belong to; none is compared with another one's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import figures

TOLERANCE = 0.5


def witness(rows: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """rows(keys, row, caption, values) against witness lines(keys, ln, line): keys, row, col, value, confirmed.

    Candidate lines share a figure or a caption word with the row, found by joining tokens inside a page, not rows with all lines.
    The best has most figures in common, then most words; a figure is confirmed if it prints it.
    """
    word = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"([a-z]{3,})"), 1))
    key = lambda v: F.round(v).cast("long").cast("string")
    row = [*keys, "row"]
    r = rows.select(*row, F.concat(word(F.col("caption")), F.transform(F.filter("values", lambda v: v.isNotNull()), key)).alias("tokens"))
    w = lines.withColumn("f", figures(F.col("line"))).select(*keys, "ln", "f", F.concat(word(F.col("line")), F.transform(F.filter("f", lambda v: v.isNotNull()), key)).alias("tokens"))
    pairs = r.select(*row, F.explode(F.array_distinct("tokens")).alias("token")).join(w.select(*keys, "ln", F.explode(F.array_distinct("tokens")).alias("token")), [*keys, "token"])
    numeric = F.col("token").rlike(r"^-?\d")
    scored = pairs.groupBy(*row, "ln").agg(F.count(F.when(numeric, 1)).alias("figs"), F.count(F.when(~numeric, 1)).alias("words"))
    best = scored.groupBy(*row).agg(F.max_by("ln", F.struct("figs", "words", (-F.col("ln")).alias("o"))).alias("ln")).join(w.select(*keys, "ln", "f"), [*keys, "ln"])
    cells = rows.select(*row, F.posexplode("values").alias("col", "value")).join(best.select(*row, "f"), row, "left")
    seen = F.exists("f", lambda v: F.abs(v - F.col("value")) <= TOLERANCE)
    return cells.select(*row, "col", "value", (F.col("value").isNull() | F.coalesce(seen, F.lit(False))).alias("confirmed"))


def subtotals(lines: DataFrame, keys: list[str]) -> DataFrame:
    """lines(keys, ord, caption, v, best): blocks end at lines without a caption, their sums. One mend by the witness is accepted."""
    w = Window.partitionBy(*keys).orderBy("ord")
    total = F.col("caption") == ""
    blocks = lines.withColumn("block", F.coalesce(F.sum(total.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = Window.partitionBy(*keys, "block")
    parts = F.sum(F.when(~total, F.col("v"))).over(own)
    goal = F.max(F.when(total, F.col("v"))).over(own)
    tagged = blocks.withColumn("gap", goal - parts).withColumn("fixes", F.abs(F.col("gap")) > TOLERANCE)
    mends = F.col("fixes") & ~total & (F.abs(F.col("v") + F.col("gap") - F.col("best")) <= TOLERANCE)
    tagged = tagged.withColumn("mends", F.coalesce(mends, F.lit(False))).withColumn("n_mends", F.sum(F.col("mends").cast("int")).over(own))
    mended = F.col("mends") & (F.col("n_mends") == 1)
    status = F.when(mended, "corrected").when(F.col("gap").isNull(), "open").when(~F.col("fixes") | (F.col("n_mends") == 1), "confirmed").otherwise("unverified")
    return tagged.where(~total).select(*keys, "ord", "caption", F.when(mended, F.col("v") + F.col("gap")).otherwise(F.col("v")).alias("v"), status.alias("status"))


def income_less_expense(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ord, confirmed for the lines after two subtotals: whether they are their difference."""
    w = Window.partitionBy(*keys).orderBy("ord")
    before = lambda c, n: F.lag(c, n).over(w)
    after = lines.withColumns({"a": before("v", 2), "b": before("v", 1), "two": (before("kind", 1) == "subtotal") & (before("kind", 2) == "subtotal")})
    return after.where("kind = 'line' and two").select(*keys, "ord", (F.abs(F.col("a") - F.col("b") - F.col("v")) <= TOLERANCE).alias("confirmed"))


def profit_chain(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, p, q, holds for each two profit lines that follow one another: the first less what lies between is the second."""
    is_profit = F.lower("caption").contains("profit")
    chained = lines.withColumn("island", F.sum(is_profit.cast("int")).over(Window.partitionBy(*keys).orderBy("ord"))).where("island > 0")
    blocks = chained.groupBy(*keys, "island").agg(F.min("ord").alias("p"), F.sum(F.when(is_profit, F.col("v"))).alias("start"), F.sum(F.when(~is_profit, F.col("v")).otherwise(0.0)).alias("between"))
    w = Window.partitionBy(*keys).orderBy("island")
    following = blocks.withColumn("q", F.lead("p").over(w)).withColumn("end", F.lead("start").over(w)).where("q is not null")
    return following.select(*keys, "p", "q", (F.abs(F.col("start") - F.col("between") - F.col("end")) <= TOLERANCE).alias("holds"))


def printed_line(rows: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """rows(keys, row, caption, values) with the figures of the only printed line(keys, line, v) that begins with the caption's first five words."""
    words = F.array_join(F.slice(F.split(F.lower("caption"), " "), 1, 5), " ")
    asked = rows.withColumn("lead", words).withColumn("k", F.substring("lead", 1, 5))
    hits = asked.join(lines.withColumn("k", F.substring(F.lower("line"), 1, 5)), [*keys, "k"]).where(F.startswith(F.lower("line"), F.col("lead")))
    one = hits.groupBy(*keys, "row").agg(F.count("*").alias("n_hits"), F.first("v").alias("printed"))
    return rows.join(one, [*keys, "row"], "left").withColumn("values", F.when(F.col("n_hits") == 1, F.array("printed")).otherwise(F.col("values"))).drop("n_hits", "printed")


def restore_signs(values: Column, printed: Column) -> Column:
    """The printed line's signs, if all magnitudes agree with it."""
    agree = (F.size(values) == F.size(printed)) & F.forall(F.zip_with(values, printed, lambda a, b: F.coalesce(F.abs(a) == F.abs(b), F.lit(False))), lambda x: x)
    return F.when(agree, printed).otherwise(values)
