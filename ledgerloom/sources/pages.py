"""Page texts to statements by rules, and images to texts by whatever reader is plugged in.

``keys`` name the document (company, filing, path). Everything is keyed by document and page: one plan reads all filings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.periods import header_texts, parse_header
from ..functions.text import classify_title, sniff_currency, sniff_units
from ..operators import assembly


def transcribe(images: DataFrame, reader: Callable[[bytes], str], image: str = "image") -> DataFrame:
    """images with text and failed in place of the image column: what the reader makes of each; an error is an empty text, not a failed job."""
    kept = [f for f in images.schema.fields if f.name != image]

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            texts, failed = [], []
            for data in pdf[image]:
                try:
                    texts.append(reader(bytes(data)) if data is not None else "")
                    failed.append(False)
                except Exception:
                    texts.append("")
                    failed.append(True)
            yield pdf.drop(columns=[image]).assign(text=texts, failed=failed)

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "text string", "failed boolean"])
    return images.select(*[f.name for f in kept], image).mapInPandas(run, ddl)


def lines(pages: DataFrame, keys: list[str]) -> DataFrame:
    """keys, page, ln, line of pages(keys, page, text)."""
    return pages.select(*keys, "page", F.posexplode(F.split("text", "\n")).alias("ln", "line"))


def statements(pages: DataFrame, keys: list[str]) -> DataFrame:
    """keys, head, pages, title, kind, units, currency, columns, rows: the statements of each document, over the pages that they go on.

    A page is a statement if it has three captioned rows of figures. Its header block names title, scale, currency and columns; a page
    without a title and with the same columns as the one before goes on with it.
    """
    page = [*keys, "page"]
    printed = lines(pages, keys)
    kept = assembly.statement_pages(printed, keys).where("kept").select(*page)
    heads = assembly.header_blocks(printed, keys).join(assembly.title_and_heading(printed, keys), page).join(kept, page)
    heads = heads.withColumns({"kind": F.when(F.col("title").isNotNull(), classify_title(F.col("title"))), "units": sniff_units(F.col("block")), "currency": sniff_currency(F.col("block"))})
    heads = heads.withColumn("columns", F.coalesce(F.transform(header_texts(F.col("block")), lambda h: F.struct(parse_header(h)["months"].alias("months"), parse_header(h)["end"].alias("end"))), F.array().cast("array<struct<months: int, end: date>>")))
    sig = F.to_json("columns")
    runs = assembly.continuations(heads.select(*page, F.col("page").alias("stmt"), "kind", "title", sig.alias("sig"), F.col("title").isNull().alias("untitled")), keys, untitled_only=True)
    member = runs.select(*keys, "head", F.explode("pages").alias("page"))
    rows = assembly.body_rows(printed, keys).join(member, page).groupBy(*keys, "head").agg(F.array_sort(F.collect_list(F.struct("page", "ln", "caption", "values"))).alias("rows"))
    first = heads.withColumnRenamed("page", "head").select(*keys, "head", "title", "kind", "units", "currency", "columns")
    return runs.join(first, [*keys, "head"]).join(rows, [*keys, "head"]).select(*keys, "head", "pages", "title", "kind", "units", "currency", "columns", "rows")


def issues(found: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """keys, code: documents without a statement, without a scale, or with a statement that has fewer columns than figures."""
    wide = F.exists("rows", lambda r: F.size(r["values"]) > F.size("columns"))
    of_statements = found.select(*keys, F.explode(F.array_compact(F.array(F.when(F.col("units").isNull(), F.lit("units_unknown")), F.when(wide, F.lit("columns_unreadable"))))).alias("code"))
    without = pages.select(*keys).distinct().join(found.select(*keys).distinct(), keys, "left_anti").withColumn("code", F.lit("no_statements"))
    return of_statements.unionByName(without).distinct()
