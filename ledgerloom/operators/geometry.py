"""Tables from word boxes: lines, fragments, cells, columns and headers, as ordered windows inside a page.

``keys`` name the page: of one document ``page`` alone, of several also the document (company, filing). A page holds a bounded number of words, so windows
partition well at any size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE, GAP = 3.0, 4.0
PAGE = ("page",)
#: What a table's cell prints: a number with groups and decimals, or decimals alone; before it a sign (also a true minus) and a currency's sign, around it brackets, after it a
#: percent sign; or a dash.
_NUMBER = r"(?:\d+(?:[.,]\d+)*|\.\d+)"
CELL = rf"^\(?[-+−]?[$€£]?{_NUMBER}\)?%?$|^[-–—]$"
AMOUNT = r"^\(?-?(\d{1,3}(,\d{3})+(\.\d+)?|\d+\.\d+|\d{5,})\)?$"
SUFFIX = r"(?i)^(%|bps?|pp|pts?|x)$"


def lines(words: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """words(page, text, x0, x1, top) -> with line: a new line begins where the top leaves the line's first by the tolerance."""
    w = Window.partitionBy(*keys).orderBy("top", "x0")
    # Tops are sorted, so a step above the tolerance from the word before opens a line.
    new = F.when(F.col("top") - F.coalesce(F.lag("top").over(w), F.lit(-1e9)) > TOLERANCE, 1).otherwise(0)
    return words.withColumn("new", new).withColumn("line", (F.sum("new").over(w) - 1).cast("int")).drop("new")


def fragments(lined: DataFrame, gap: float = GAP, keys: Sequence[str] = PAGE) -> DataFrame:
    """Adjacent words of a line joined into fragments with one box: page, line, frag, text, x0, x1."""
    w = Window.partitionBy(*keys, "line").orderBy("x0")
    reach = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("x0") - F.coalesce(reach, F.lit(-1e9)) > gap, 1).otherwise(0)
    tagged = lined.withColumn("new", new).withColumn("frag", (F.sum("new").over(w) - 1).cast("int"))
    parts = F.array_sort(F.collect_list(F.struct("x0", "text")))
    return tagged.groupBy(*keys, "line", "frag").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))


def cells(lined: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """The figures after a line's caption, a unit word folded into the figure before it: page, line, caption, text, x0, x1."""
    w = Window.partitionBy(*keys, "line").orderBy("x0")
    sign = (F.row_number().over(w) == 1) & F.col("text").isin("+", "-") & F.lead("text").over(w).rlike(r"^[A-Za-z(]")
    is_cell = F.col("text").rlike(CELL) & ~F.coalesce(sign, F.lit(False))
    tagged = lined.withColumn("is_cell", is_cell).withColumn("started", F.max("is_cell").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy(*keys, "line")
    caption = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("started"), F.struct("x0", "text"))).over(whole)), lambda p: p["text"]), " ")
    suffix = F.lead("text").over(w).rlike(SUFFIX) & (F.lead("x0").over(w) - F.col("x1") <= GAP)
    text = F.when(suffix, F.concat_ws(" ", "text", F.lead("text").over(w))).otherwise(F.col("text"))
    x1 = F.when(suffix, F.lead("x1").over(w)).otherwise(F.col("x1"))
    return tagged.select(*keys, "line", caption.alias("caption"), text.alias("text"), "x0", x1.alias("x1"), "is_cell").where("is_cell").drop("is_cell")


def columns(found: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Interval merge: cells whose boxes overlap in a chain are one column. Adds col, left, right and collides."""
    w = Window.partitionBy(*keys).orderBy("x0", "x1")
    reach = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    tagged = found.withColumn("new", F.when(F.col("x0") > F.coalesce(reach, F.lit(-1e9)), 1).otherwise(0)).withColumn("col", (F.sum("new").over(w) - 1).cast("int")).drop("new")
    c = Window.partitionBy(*keys, "col")
    twice = F.count("*").over(c) > F.size(F.collect_set("line").over(c))
    return tagged.withColumn("left", F.min("x0").over(c)).withColumn("right", F.max("x1").over(c)).withColumn("collides", twice)


def body(lined: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """page, start, stop: from the first line with two amounts to the first later line with two words over the figures."""
    # A page's words are summed by lines, and its lines folded: the page is sent once and meets nothing by a join.
    cell = F.col("text").rlike(CELL)
    words = F.collect_list(F.when(~cell & ~F.col("text").rlike(SUFFIX), F.col("x0")))
    by_line = lined.groupBy(*keys, "line").agg(F.count(F.when(F.col("text").rlike(AMOUNT), 1)).alias("n"), F.min(F.when(cell, F.col("x0"))).alias("zone"), words.alias("words"))
    pages = by_line.groupBy(*keys).agg(F.min(F.when(F.col("n") >= 2, F.struct("line", "zone"))).alias("first"), F.collect_list(F.struct("line", "words")).alias("lines"), (F.max("line") + 1).alias("last"))
    over = lambda x: (x["line"] > F.col("first.line")) & (F.size(F.filter(x["words"], lambda x0: x0 >= F.col("first.zone") - 5)) >= 2)
    stop = F.array_min(F.transform(F.filter("lines", over), lambda x: x["line"]))
    return pages.where("first is not null").select(*keys, F.col("first.line").alias("start"), F.coalesce(stop, "last").alias("stop"))


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def layout(found: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """keys, line, caption, cells: the lines of ``columns`` by their page's columns; a blank cell keeps its column."""
    # Lines of a page are put together where its columns were found, so the page's width is at hand without a join.
    rows = found.groupBy(*keys, "line", "caption").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("m"), F.max("col").alias("most"))
    rows = rows.withColumn("most", F.max("most").over(Window.partitionBy(*keys)))
    return rows.select(*keys, "line", "caption", F.transform(F.sequence(F.lit(0), F.col("most")), lambda c: F.try_element_at("m", c)).alias("cells"))


def assign(frags: DataFrame, ranges: DataFrame, reach: float, keys: Sequence[str] = PAGE, also: Sequence[str] = ()) -> DataFrame:
    """frags(page, frag, x0, x1) to ranges(page, col, left, right): every column overlapped by half of the narrower, else the nearest centre within reach. ``also`` names columns of frags to keep."""
    pairs = frags.join(ranges, [*keys])
    hit = overlap(F.col("x0"), F.col("x1"), F.col("left"), F.col("right")) >= 0.5 * F.greatest(F.lit(1e-6), F.least(F.col("x1") - F.col("x0"), F.col("right") - F.col("left")))
    distance = F.abs((F.col("x0") + F.col("x1")) / 2 - (F.col("left") + F.col("right")) / 2)
    own = Window.partitionBy(*keys, "frag")
    tagged = pairs.withColumn("hit", hit).withColumn("any", F.max("hit").over(own)).withColumn("d", distance).withColumn("near", F.min("d").over(own))
    return tagged.where("hit or (not any and d = near and d <= %r)" % reach).select(*keys, "frag", "col", *also)
