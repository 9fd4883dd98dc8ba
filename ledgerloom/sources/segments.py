"""Whole documents of page texts, cut in one ordered pass into statements, notes and tables inside running text, with what could not be read.

A page begins a piece, and so do a statement's title, a note's heading and the heading of an embedded table below it. A piece is decided by what stands before it:

* under a title, with three rows of figures: a statement;
* under a note's heading: a note, which goes on over pages until another heading;
* under the heading of an embedded table: an embedded table;
* at the top of a page, without a heading: it goes on with a note that was open on the page before, or with a statement there that has the same columns; else it is a
  statement without a title if it has three rows and columns, and running text if not.

Inside a note, a date alone on its line is the period of the rows below it; the span is the longest that a statement of the document prints for that end.

Documents are spread over tasks by ``keys``; a document's pieces are decided in order on their headings and columns, not on their rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.periods import clamp_date, header_texts, month_number, parse_header
from ..functions.text import classify_title, is_data_row, parse_row, sniff_currency, sniff_units
from ..operators.assembly import CONTENTS, DATE_LINE, NOTE_HEADING, TITLE

EMBEDDED = r"(?i)\breconciliation\s+of\b"
LEAST_ROWS = 3


def _date(line: Column) -> Column:
    """The date that a line prints alone: day, month's name, year."""
    part = lambda k: F.regexp_extract(line, r"^(\d{1,2}) ([A-Z][a-z]+) (\d{4})$", k)
    return F.when(line.rlike(DATE_LINE), clamp_date(part(3).try_cast("int"), month_number(part(2)), part(1).try_cast("int")))


def marked_lines(pages: DataFrame, keys: list[str]) -> DataFrame:
    """keys, page, ln, line, row (caption, values; null if it is no row), marks (what begins here, if anything), note, piece: lines in order, with the piece that each belongs to."""
    lines = pages.select(*keys, "page", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("ln", "raw")).withColumn("line", F.trim("raw")).drop("raw")
    note = F.nullif(F.regexp_extract("line", NOTE_HEADING, 1), F.lit("")).try_cast("int")
    dated = F.col("line").rlike(DATE_LINE)
    other = F.when(F.col("line").rlike(EMBEDDED), "embedded").when(F.col("line").rlike(TITLE) & ~F.col("line").rlike(CONTENTS), "statement")
    row = F.when(F.col("note").isNull() & ~dated & is_data_row(F.col("line")), parse_row(F.col("line")))
    marks = F.when(F.col("note").isNotNull(), "note").when(F.col("row").isNull(), other)
    # A step each, so that no step works out again what the one before it found.
    lines = lines.withColumn("note", note).withColumn("row", row).withColumn("marks", marks)
    order = Window.partitionBy(*keys).orderBy("page", "ln")
    # A heading over several lines is one: only the first line of those that follow each other begins a piece.
    first = F.col("marks").isNotNull() & ~F.coalesce((F.lag("marks").over(order) == F.col("marks")) & (F.lag("page").over(order) == F.col("page")) & (F.col("marks") != "note"), F.lit(False))
    starts = (F.col("ln") == 0) | first
    return lines.withColumn("starts", starts).withColumn("piece", F.sum(F.col("starts").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("starts")


def pieces(marked: DataFrame, keys: list[str]) -> DataFrame:
    """keys, piece, page, marks, note, title, head (the lines above its first row), n_rows, top (whether it begins its page)."""
    of = [*keys, "piece"]
    first_row = F.min(F.when(F.col("row").isNotNull(), F.col("ln"))).over(Window.partitionBy(*of))
    above = marked.withColumn("stop", first_row)
    header = F.when(F.col("stop").isNull() | (F.col("ln") < F.col("stop")), F.struct("ln", "line"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["line"]), "\n")
    start = F.min_by(F.struct("marks", "note", "line"), "ln")
    return above.groupBy(*of).agg(F.min("page").alias("page"), start.alias("s"), joined(header).alias("head"), F.count("row").alias("n_rows"), (F.min("ln") == 0).alias("top")).select(*of, "page", "s.marks", "s.note", F.when(F.col("s.marks") == "statement", F.col("s.line")).alias("title"), "head", "n_rows", "top")


def with_columns(found: DataFrame, keys: list[str]) -> DataFrame:
    """Adds what the lines above a piece's rows say: columns (header, months, end), periods, their signature, units, currency and statement_kind. Equal headers are read once."""
    heads = found.where("n_rows > 0 or marks = 'note'").select("head", "title").distinct()
    said = heads.select("head", "title", sniff_units(F.col("head")).alias("units"), sniff_currency(F.col("head")).alias("currency"), F.coalesce(classify_title(F.col("title")), F.lit("other")).alias("statement_kind"))
    texts = said.select("*", F.posexplode_outer(header_texts(F.col("head"))).alias("col", "header")).withColumn("p", F.when(F.col("header").isNotNull(), parse_header(F.col("header"))))
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("header").isNotNull(), F.struct("col", "header", "p.months", "p.end")))), lambda c: F.struct(c["header"].alias("header"), c["months"].alias("months"), c["end"].alias("end")))
    read = texts.groupBy(F.col("head").alias("of_head"), F.col("title").alias("of_title"), "units", "currency", "statement_kind").agg(listed.alias("read"))
    with_ = found.join(read, (F.col("head") == F.col("of_head")) & F.col("title").eqNullSafe(F.col("of_title")), "left").drop("of_head", "of_title")
    with_ = with_.withColumn("columns", F.when((F.col("n_rows") > 0) & (F.size("read") > 0), F.col("read"))).drop("read")
    return with_.withColumn("periods", F.to_json(F.transform("columns", lambda c: F.struct(c["months"].alias("months"), c["end"].alias("end")))))


def decide(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, piece, kind (statement, note, embedded, text), block: the first piece of the one that it goes on with, or itself."""
    return decided(found, keys).select(*keys, F.explode("decided").alias("x")).select(*keys, "x.*")


def decided(found: DataFrame, keys: list[str], also: tuple[str, ...] = ()) -> DataFrame:
    """One row for each document: its pieces in order, with the columns ``also``, and what is decided on each of them. A piece's number is its place, from 1."""

    def follow(state: Column, p: Column) -> Column:
        next_page = p["top"] & p["marks"].isNull() & (p["page"] == state["page"] + 1)
        on_note = next_page & (state["kind"] == "note")
        on_statement = next_page & (state["kind"] == "statement") & (p["n_rows"] > 0) & (p["periods"] == state["periods"])
        goes_on = F.coalesce(on_note | on_statement, F.lit(False))
        titled = F.coalesce(p["marks"] == "statement", F.lit(False))
        own = F.when(p["marks"] == "note", "note").when((p["marks"] == "embedded") & (p["n_rows"] > 0), "embedded").when((titled | (p["marks"].isNull() & p["periods"].isNotNull())) & (p["n_rows"] >= LEAST_ROWS), "statement").otherwise("text")
        kind = F.when(goes_on, state["kind"]).otherwise(own)
        block = F.when(goes_on, state["block"]).otherwise(p["piece"])
        # Running text between a block and the next page doesn't end it; the top of a page that doesn't go on does.
        passes = ~goes_on & (own == "text") & ~p["top"]
        seen = lambda now, name: F.when(passes, state[name]).otherwise(now)
        periods = F.when(goes_on, state["periods"]).otherwise(p["periods"])
        out = F.concat(state["out"], F.array(F.struct(p["piece"].alias("piece"), kind.alias("kind"), block.alias("block"))))
        return F.struct(seen(kind, "kind").alias("kind"), seen(block, "block").alias("block"), seen(periods, "periods").alias("periods"), p["page"].alias("page"), out.alias("out"))

    start = F.expr("named_struct('kind', cast('text' as string), 'block', cast(null as bigint), 'periods', cast(null as string), 'page', cast(null as int), 'out', cast(array() as array<struct<piece: bigint, kind: string, block: bigint>>))")
    listed = found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("piece", "page", "marks", "n_rows", "periods", "top", *also))).alias("pieces"))
    return listed.withColumn("decided", F.aggregate("pieces", start, follow)["out"])


def read(pages: DataFrame, keys: list[str], keep=lambda df: df) -> DataFrame:
    """pages(keys, page, text) -> keys, block, kind, note, end, title, statement_kind, units, currency, page, pages, columns, rows.

    One row for each statement and embedded table, and for each period of each note. ``keep`` writes a table and reads it back: lines are used twice.
    """
    pages = pages.select(*keys, F.col("page").cast("int").alias("page"), "text")
    marked = keep(marked_lines(pages, keys))
    found = keep(with_columns(pieces(marked, keys), keys))
    own = [*keys, "block"]
    heads = ["note", "title", "statement_kind", "units", "currency", "columns"]
    # A note says "the period then ended": only statements print how long that is.
    printed = F.flatten(F.transform(F.filter("decided", lambda d: (d["kind"] == "statement") & (d["piece"] == d["block"])), lambda d: F.coalesce(F.element_at("pieces", d["block"].cast("int"))["columns"], F.array().cast("array<struct<header: string, months: int, end: date>>"))))
    by_doc = decided(found, keys, tuple(heads)).withColumn("printed", F.filter(printed, lambda c: c["months"].isNotNull() & c["end"].isNotNull()))
    # As many rows as documents, however small their file: sorted and merged, never sent to the driver. All that follows stays where its document is.
    lines = marked.drop("note").join(by_doc.hint("merge"), keys).withColumn("d", F.element_at("decided", F.col("piece").cast("int"))).where("d.kind <> 'text'")
    head = F.element_at("pieces", F.col("d.block").cast("int"))
    lines = lines.select(*keys, "page", "ln", "row", F.when(F.col("d.kind") == "note", _date(F.col("line"))).alias("dated"), "d.kind", "d.block", head.alias("head"), "printed")
    lines = lines.select(*keys, "page", "ln", "row", "dated", "kind", "block", "printed", *(F.col(f"head.{c}").alias(c) for c in heads))
    lines = lines.withColumn("end", F.last("dated", ignorenulls=True).over(Window.partitionBy(*own).orderBy("page", "ln").rowsBetween(Window.unboundedPreceding, 0)))
    one = [F.first(c).alias(c) for c in (*heads, "printed")]
    out = lines.where("row is not null").groupBy(*own, "kind", "end").agg(F.array_sort(F.collect_list(F.struct("page", "ln", "row.caption", "row.values"))).alias("rows"), *one)
    span = F.array_max(F.transform(F.filter("printed", lambda c: c["end"] == F.col("end")), lambda c: c["months"]))
    width = F.array_max(F.transform("rows", lambda r: F.size(r["values"])))
    out = out.withColumns({"page": F.get("rows", F.lit(0))["page"], "pages": F.array_distinct(F.transform("rows", lambda r: r["page"])), "span": span, "width": width})
    segments = F.transform(F.sequence(F.lit(1), "width"), lambda i: F.struct(F.when(i == F.col("width"), F.lit("Total")).otherwise(F.concat(F.lit("segment "), i)).alias("header"), F.col("span").alias("months"), F.col("end").alias("end")))
    columns = F.when(F.col("kind") == "note", segments).otherwise(F.coalesce("columns", F.expr("cast(array() as array<struct<header: string, months: int, end: date>>)")))
    kind = F.when(F.col("kind") == "statement", F.col("statement_kind")).when(F.col("kind") == "embedded", "summary").otherwise("note")
    return out.select(*own, "kind", "note", "end", "title", kind.alias("statement_kind"), "units", "currency", "page", "pages", columns.alias("columns"), "rows")


def issues(found: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """keys, page (null for the document), code: pages_not_read, columns_unreadable, columns_misaligned, units_unknown, no_statements."""
    n = F.size("columns")
    aligned = F.size(F.filter("rows", lambda r: F.size(r["values"]) == n))
    code = F.when(n == 0, "columns_unreadable").when(2 * aligned < F.size("rows"), "columns_misaligned")
    statements = found.where("kind = 'statement'").select(*keys, "page", code.alias("code"), F.lit(1).alias("n"), F.col("units").isNotNull().cast("int").alias("with_units"))
    blank = F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "pages_not_read")
    none = F.lit(0)
    both = statements.unionByName(pages.select(*keys, F.col("page").cast("int").alias("page"), blank.alias("code"), none.alias("n"), none.alias("with_units")))
    # Both tables are read once and meet by their document, without a join.
    by_doc = both.groupBy(*keys).agg(F.collect_list(F.when(F.col("code").isNotNull(), F.struct("page", "code"))).alias("codes"), F.sum("n").alias("n"), F.sum("with_units").alias("with_units"), F.count(F.when(F.col("n") == 0, 1)).alias("pages"))
    whole = F.when(F.col("n") == 0, F.lit("no_statements")).when(F.col("with_units") == 0, F.lit("units_unknown"))
    every = F.array_append("codes", F.struct(F.lit(None).cast("int").alias("page"), F.when(F.col("pages") > 0, whole).alias("code")))
    return by_doc.select(*keys, F.inline(every)).where("code is not null")
