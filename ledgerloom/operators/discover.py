"""Layout of a target sheet: cell roles, sections, captions by reference, periods, and where to write.

``keys`` name the sheet (company, path, sheet): each is read by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import colour_role, detect_section, references_cells


def role() -> Column:
    """A cell's role: formulas that refer to cells, inputs by colour; typed arithmetic is an input."""
    return F.when(F.coalesce(references_cells(F.col("formula")), F.lit(False)), "formula").when(F.col("value").isNull(), None).otherwise(F.when(colour_role(F.col("rgb")) == "input", "input").otherwise("formula"))


def sections(captions: DataFrame, keys: list[str]) -> DataFrame:
    """captions(keys, row, text) with the section of the last heading above; a sheet opens with the income statement."""
    w = Window.partitionBy(*keys).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    return captions.withColumn("section", F.coalesce(F.last(detect_section(F.col("text")), ignorenulls=True).over(w), F.lit("income_statement")))


def follow(cells: DataFrame, keys: list[str], hops: int) -> DataFrame:
    """cells(keys, row, text, ref): texts behind references, found in at most ``hops`` self-joins; a circle ends as null."""
    out = cells.select(*keys, "row", "text", "ref")
    target = cells.select(*keys, F.col("row").alias("ref"), F.col("text").alias("t"), F.col("ref").alias("n"))
    for _ in range(hops):
        # A row that has its text asks for nothing.
        asked = out.withColumn("ref", F.when(F.col("text").isNull(), F.col("ref")))
        out = asked.join(target, [*keys, "ref"], "left").select(*keys, "row", F.coalesce("text", "t").alias("text"), F.when(F.coalesce("text", "t").isNull(), F.col("n")).alias("ref"))
    return out.select(*keys, "row", "text")


def label_column(cells: DataFrame, keys: list[str], among: int = 8) -> DataFrame:
    """keys, label_col, n: of the first columns the one with most captions of three letters; the first of equals."""
    words = cells.where((F.col("col") <= among) & F.col("text").rlike("[A-Za-z]{3}")).groupBy(*keys, "col").agg(F.count("*").alias("n"))
    best = words.groupBy(*keys).agg(F.max_by(F.struct("col", "n"), F.struct("n", -F.col("col"))).alias("b"))
    return best.select(*keys, F.col("b.col").alias("label_col"), "b.n")


def first_rows(cells: DataFrame, keys: list[str], label_col: int) -> DataFrame:
    """keys, first_data_row, header_row: data begin at the first row with two figures; the header is the fullest row above, the later of equals."""
    per = cells.where(F.col("col") > label_col).groupBy(*keys, "row").agg(F.count("value").alias("figures"), F.count("text").alias("texts"))
    first = F.min(F.when(F.col("figures") >= 2, F.col("row"))).over(Window.partitionBy(*keys))
    above = per.withColumn("first_data_row", first).where("row < first_data_row")
    return above.groupBy(*keys, "first_data_row").agg(F.max_by("row", F.struct("texts", "row")).alias("header_row"))


def census(cells: DataFrame, keys: list[str], label_col: int) -> DataFrame:
    """keys, col, inputs, formulas, values of the columns right of the captions."""
    r = role()
    return cells.where((F.col("col") > label_col) & F.col("text").isNull()).groupBy(*keys, "col").agg(F.count_if(r == "input").alias("inputs"), F.count_if(r == "formula").alias("formulas"), F.count("value").alias("values"))


def period_row(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, col, end: the row with most dates names the columns' periods; the first of equals."""
    dated = cells.withColumn("end", F.col("text").try_cast("date")).where("end is not null")
    n = dated.withColumn("n", F.count("*").over(Window.partitionBy(*keys, "row")))
    best = F.first("row").over(Window.partitionBy(*keys).orderBy(F.desc("n"), "row"))
    return n.withColumn("best", best).where("row = best").select(*keys, "col", "end")


def write_column(cells: DataFrame, keys: list[str], label_col: int) -> DataFrame:
    """keys, write_col, mode: the first dated column without figures right of the last figures, else a new one."""
    t = cells.where(F.col("col") > label_col).groupBy(*keys, "col").agg(F.count("value").alias("n"), F.max(F.col("text").try_cast("date").isNotNull()).alias("dated"))
    t = t.withColumn("last", F.max(F.when(F.col("n") > 0, F.col("col"))).over(Window.partitionBy(*keys)))
    free = t.groupBy(*keys, "last").agg(F.min(F.when((F.col("col") > F.col("last")) & (F.col("n") == 0) & F.col("dated"), F.col("col"))).alias("free"))
    return free.select(*keys, F.coalesce("free", F.col("last") + 1).alias("write_col"), F.when(F.col("free").isNotNull(), "reserved").otherwise("append").alias("mode"))


def reference_column(cells: DataFrame, keys: list[str], label_col: int) -> DataFrame:
    """keys, reference_col: of the columns with at least half of the densest column's inputs, and three, the most recent."""
    n = census(cells, keys, label_col)
    dense = n.withColumn("most", F.max("inputs").over(Window.partitionBy(*keys))).where(F.col("inputs") >= F.greatest(F.lit(3), F.col("most") / 2))
    return dense.groupBy(*keys).agg(F.max("col").alias("reference_col"))


def row_roles(cells: DataFrame, keys: list[str], label_col: int) -> DataFrame:
    """keys, row, role: a row is what its latest cell is; literal formulas are inputs."""
    return cells.where((F.col("col") > label_col) & (F.col("value").isNotNull() | F.col("formula").isNotNull())).groupBy(*keys, "row").agg(F.max_by(role(), "col").alias("role"))


def match_sheets(wants: DataFrame, sheets: DataFrame, keys: list[str]) -> DataFrame:
    """keys, want, sheet: an exact name, else the only one that agrees without case and blanks."""
    fold = lambda c: F.lower(F.trim(c))
    pairs = wants.withColumn("k", fold("want")).join(sheets.withColumn("k", fold("sheet")), [*keys, "k"])
    found = pairs.groupBy(*keys, "want").agg(F.max(F.when(F.col("sheet") == F.col("want"), F.col("sheet"))).alias("exact"), F.count("*").alias("n"), F.max("sheet").alias("only"))
    return found.select(*keys, "want", F.coalesce("exact", F.when(F.col("n") == 1, F.col("only"))).alias("sheet"))


def fingerprints(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, fingerprint of rows(keys, caption, section): a digest of a sheet's distinct captions and their sections."""
    key = F.transform(F.array_sort(F.collect_set(F.concat(F.lower("caption"), F.lit("~"), "section"))), lambda c: c)
    return rows.groupBy(*keys).agg(F.substring(F.sha2(F.array_join(key, "|"), 256), 1, 16).alias("fingerprint"))


def drift(saved: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """keys, code, severity: sheets whose fingerprint is not the saved one, or that are gone; sheets never saved are new and no issue."""
    both = saved.withColumnRenamed("fingerprint", "was").join(now.withColumnRenamed("fingerprint", "is"), keys, "left")
    code = F.when(F.col("is").isNull(), "sheet_missing").when(F.col("is") != F.col("was"), "sheet_drift")
    return both.withColumn("code", code).where("code is not null").select(*keys, "code", F.lit("error").alias("severity"))


def legacy_rows(instruction: Column, sign: Column, inferred: Column) -> tuple[Column, Column]:
    """Captions and sign of a mapping row from an instruction of the older plan; signs that were only inferred are dropped."""
    terms = F.transform(F.split(F.regexp_replace(instruction, "^sum:", ""), r"\|"), lambda x: F.replace(x, F.lit("pdf:")))
    return F.when(instruction != "absent:", terms), F.when(~inferred, sign)
