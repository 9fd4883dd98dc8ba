"""Statements from pages: titles, header blocks, rows, notes, continuation islands.

``keys`` name the document (company, filing, path): nothing is carried from one document into another, and documents are what is
spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.periods import parse_header
from ..functions.text import is_data_row, parse_row

# How titles, headings and contents lines are printed: fixed patterns.
TITLE = r"(?i)\b(?:statement|statements|schedule)\s+of\b|\bperformance\s+at\s+a\s+glance\b|\b(?:income\s+statements?|balance\s+sheets?)\b|\[\d{6}\]"
HEADING = r"(?i)\b(?:for\s+the|as\s+at|as\s+of|period|periods|year|quarter)\b"
CONTENTS = r"\.{4,}|…"


NOTE_HEADING = r"^(\d{1,2})\.\s+[A-Z ]{4,}$"
DATE_LINE = r"^\d{1,2} [A-Z][a-z]+ \d{4}$"


def title_and_heading(pages: DataFrame, keys: list[str]) -> DataFrame:
    """pages(keys, page, ln, line) -> keys, page, title, heading: among the first twelve lines, before the first row of figures."""
    page = [*keys, "page"]
    whole = Window.partitionBy(*page)
    first_row = F.coalesce(F.min(F.when(is_data_row(F.col("line")), F.col("ln"))).over(whole), F.lit(12))
    top = pages.withColumn("stop", F.least(first_row, F.lit(12)))
    title = F.col("line").rlike(TITLE) & ~F.col("line").rlike(CONTENTS) & (F.col("ln") < F.col("stop"))
    top = top.withColumn("t", F.min(F.when(title, F.col("ln"))).over(whole))
    heading = F.when((F.col("ln") > F.col("t")) & (F.col("ln") < F.col("stop")) & F.col("line").rlike(HEADING), F.col("ln"))
    return top.groupBy(*page).agg(F.min_by("line", F.when(F.col("ln") == F.col("t"), F.col("ln"))).alias("title"), F.min_by("line", heading).alias("heading"))


def header_blocks(pages: DataFrame, keys: list[str]) -> DataFrame:
    """keys, page, block: at most sixteen lines up to the first row of figures, else ten."""
    page = [*keys, "page"]
    first = F.min(F.when(is_data_row(F.col("line")), F.col("ln"))).over(Window.partitionBy(*page))
    cut = pages.withColumn("stop", F.coalesce(F.least(first, F.lit(16)), F.lit(10))).where("ln < stop")
    return cut.groupBy(*page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ln", "line"))), lambda x: x["line"]), "\n").alias("block"))


def body_rows(pages: DataFrame, keys: list[str]) -> DataFrame:
    """keys, page, ln, caption, values: rows of figures; a caption that begins in lower case goes on from the line before it."""
    w = Window.partitionBy(*keys, "page").orderBy("ln")
    rows = pages.withColumn("before", F.lag("line").over(w)).where(is_data_row(F.col("line"))).withColumn("r", parse_row(F.col("line")))
    wrapped = F.col("r.caption").rlike("^[a-z]") & ~is_data_row(F.col("before"))
    return rows.where("r is not null").select(*keys, "page", "ln", F.when(wrapped, F.concat_ws(" ", "before", "r.caption")).otherwise(F.col("r.caption")).alias("caption"), "r.values")


def statement_pages(pages: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """keys, page, n_rows, kept: a page is a statement from three captioned rows of figures on."""
    rows = F.count(F.when(is_data_row(F.col("line")), parse_row(F.col("line"))))
    return pages.groupBy(*keys, "page").agg(rows.alias("n_rows"), (rows >= least).alias("kept"))


def embedded_tables(pages: DataFrame, keys: list[str]) -> DataFrame:
    """keys, page, ln, kind: lines that head a table inside running text."""
    return pages.where(F.col("line").rlike(r"(?i)\breconciliation\s+of\b")).select(*keys, "page", "ln", F.lit("summary").alias("kind"))


def continuations(statements: DataFrame, keys: list[str], untitled_only: bool) -> DataFrame:
    """statements(keys, stmt, page, kind, title, sig, untitled) -> keys, head, n, pages: runs of pages that are one statement.

    A page goes on if it is the next page with the same period signature, and has no title; or, for the continued view,
    also if its title begins or ends like the one before.
    """
    w = Window.partitionBy(*keys).orderBy("page")
    prev = lambda c: F.lag(c).over(w)
    fold = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\(?continued\)?", ""))
    next_page = (F.col("page") == prev("page") + 1) & (F.col("sig") == prev("sig"))
    goes_on = next_page & F.col("untitled")
    if not untitled_only:
        same = (F.col("kind") == prev("kind")) & (F.startswith(fold(F.col("title")), fold(prev("title"))) | F.endswith(fold(prev("title")), fold(F.col("title"))))
        goes_on = goes_on | (next_page & F.coalesce(same, F.lit(False)))
    runs = statements.withColumn("new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    return runs.groupBy(*keys, "run").agg(F.min_by("stmt", "page").alias("head"), F.count("*").alias("n"), F.array_sort(F.collect_list("page")).alias("pages")).drop("run")


def _carried(value: Column, keys: list[str]) -> Column:
    """The last value above, inside a document."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy("ln").rowsBetween(Window.unboundedPreceding, 0))


def noted(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Adds note and end: numbered headings in capitals delimit notes, a date alone on its line is the period of the rows below it in its note."""
    note = F.nullif(F.regexp_extract("line", NOTE_HEADING, 1), F.lit("")).cast("int")
    dated = F.when(F.col("line").rlike(DATE_LINE), parse_header(F.col("line"))["end"])
    return lines.withColumn("note", _carried(note, keys)).withColumn("end", _carried(dated, [*keys, "note"]))


def note_tables(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, note, end, ln, caption, values: one table for each note and period heading above its rows."""
    rows = noted(lines, keys).withColumn("r", parse_row(F.col("line"))).where("r is not null and note is not null and end is not null")
    return rows.where(~F.col("line").rlike(DATE_LINE) & ~F.col("line").rlike(NOTE_HEADING)).select(*keys, "note", "end", "ln", "r.caption", "r.values")


def total_agrees(values: Column, share: float = 0.02) -> Column:
    """Whether the last value is the sum of those before it, but for a share of it."""
    parts = F.aggregate(F.slice(values, F.lit(1), F.greatest(F.size(values) - 1, F.lit(0))), F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))
    total = F.element_at(values, -1)
    return F.abs(total - parts) <= share * F.abs(total)


def right_align(values: Column, width: Column) -> Column:
    """A row short of columns is aligned right if its total agrees; else null."""
    padded = F.concat(F.array_repeat(F.lit(None).cast("double"), width - F.size(values)), values)
    return F.when(F.size(values) == width, values).when(total_agrees(values), padded)


def note_columns(width: Column) -> Column:
    """Headers of a note's table that prints none: segments, and the total last."""
    return F.transform(F.sequence(F.lit(1), width), lambda i: F.when(i == width, F.lit("Total")).otherwise(F.concat(F.lit("segment "), i)))


def document_units(statements: DataFrame, keys: list[str]) -> DataFrame:
    """keys, units, disagree: the first statement that names a scale, primary ones before notes; a disagreement is a warning."""
    return statements.groupBy(*keys).agg(F.min_by("units", F.when(F.col("units").isNotNull(), F.struct("is_note", "page"))).alias("units"), (F.countDistinct("units") > 1).alias("disagree"))


def merge_filings(documents: DataFrame, statements: DataFrame, keys: list[str]) -> DataFrame:
    """keys, doc, stmt, units, lead: statements of all filings, each with its own scale or its document's; the fullest filing leads, later paths first."""
    lead = documents.groupBy(*keys).agg(F.max_by("doc", F.struct("readable", "doc")).alias("lead_doc"))
    t = statements.withColumnRenamed("units", "own").join(documents, [*keys, "doc"]).join(lead, keys)
    return t.select(*keys, "doc", "stmt", F.coalesce("own", "units").alias("units"), (F.col("doc") == F.col("lead_doc")).alias("lead"))
