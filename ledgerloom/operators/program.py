"""The mapping language: rows to terms, and terms to values over all companies in one job.

caption_expr := caption ["?"] [" ## " column] [" @ " statement]; a list is a signed sum; a leading '-' subtracts.
Parsing and evaluation are expressions and keyed joins: nothing is looped over on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_label


def parse_term(term: Column) -> Column:
    """struct(sign, caption, nth, block, alternatives, column, statement, optional, const): '@' first, then '##', then '?'."""
    negative = F.startswith(F.trim(term), F.lit("-"))
    body = F.trim(F.when(negative, F.substring(F.trim(term), F.lit(2), F.length(term))).otherwise(term))
    at = F.split(body, r"\s+@\s+", 2)
    hashes = F.split(F.get(at, F.lit(0)), r"\s+##\s+", 2)
    rest = F.trim(F.get(hashes, F.lit(0)))
    optional = F.endswith(rest, F.lit("?"))
    rest = F.trim(F.regexp_replace(rest, r"\?$", ""))
    const = F.regexp_extract(rest, r"^const:\s*(\S+)$", 1).try_cast("double")
    alternatives = F.transform(F.split(rest, r"\s*\|\|\s*"), lambda a: F.trim(a))
    block = F.nullif(F.trim(F.regexp_extract(rest, r"^(.+?)\s+>\s+.+$", 1)), F.lit(""))
    caption = F.trim(F.regexp_replace(rest, r"^.+?\s+>\s+", ""))
    nth = F.nullif(F.regexp_extract(caption, r"#(\d+)$", 1), F.lit("")).cast("int")
    return F.struct(
        F.when(negative, -1).otherwise(1).alias("sign"),
        F.trim(F.regexp_replace(caption, r"\s*#\d+$", "")).alias("caption"),
        nth.alias("nth"),
        block.alias("block"),
        alternatives.alias("alternatives"),
        F.trim(F.get(hashes, F.lit(1))).alias("column"),
        F.trim(F.get(at, F.lit(1))).alias("statement"),
        optional.alias("optional"),
        const.alias("const"),
    )


def desugar(pdf: Column, value: Column, carry: Column) -> Column:
    """The compiled instruction of a mapping row: const:, carry:, absent:, pdf: or sum:."""
    single = F.get(pdf, F.lit(0))
    many = (F.size(pdf) > 1) | F.endswith(single, F.lit("?"))
    return (
        F.when(value.isNotNull(), F.concat(F.lit("const:"), value.cast("string")))
        .when(carry, F.lit("carry:"))
        .when(pdf.isNull() | (F.size(pdf) == 0), F.lit("absent:"))
        .when(many, F.concat(F.lit("sum:"), F.array_join(F.transform(pdf, lambda t: F.when(F.startswith(t, F.lit("-")), F.concat(F.lit("-pdf:"), F.trim(F.substring(t, F.lit(2), F.length(t))))).otherwise(F.concat(F.lit("pdf:"), t))), "|")))
        .otherwise(F.concat(F.lit("pdf:"), single))
    )


def resolve(terms: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Signed sums of terms(row, term, sign, caption, optional, factor) over cells(keys, caption, found value or null).

    A found line with a dash counts as 0; a line that is not there fails the row, unless the term is optional.
    Returns keys, row, value, n_terms, n_optional_missing, reason (of the first term that failed).
    """
    t = terms.withColumn("norm", normalize_label(F.col("caption"))).drop("caption")
    # Each (keys) group asks for every term; the program is a bounded table, so it is expanded beside the keys. Cells may be costly to make: they are read
    # once, summed by the captions that the program names (all others are one), and a group's sums are as many as those at most.
    program = t.agg(F.collect_list(F.struct(*t.columns)).alias("program"))
    named = F.array_contains(F.col("program.norm"), F.col("norm"))
    for key in keys:
        named = named & F.col(key).isNotNull()
    c = cells.select(*keys, normalize_label(F.col("caption")).alias("norm"), "value").crossJoin(F.broadcast(program)).select(*keys, F.when(named, F.col("norm")).alias("norm"), "value")
    sums = c.groupBy(*keys, "norm").agg(F.sum(F.coalesce("value", F.lit(0.0))).alias("value"), F.count("*").alias("n"))
    lines = sums.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.when(F.col("norm").isNotNull(), F.struct("norm", F.struct("value", "n"))))).alias("lines"))
    joined = lines.crossJoin(F.broadcast(program)).select(*keys, "lines", F.inline("program")).withColumn("line", F.try_element_at("lines", "norm")).withColumn("found", F.when(F.col("line").isNotNull(), True))
    ok = F.col("found") | F.col("optional")
    figure = F.coalesce("line.value", F.lit(0.0)) * F.col("sign") * F.col("factor")
    out = joined.groupBy(*keys, "row").agg(
        F.sum(figure).alias("total"),
        F.bool_and(F.coalesce(ok, F.lit(False))).alias("ok"),
        F.sum(F.coalesce("line.n", F.lit(1).cast("long"))).alias("n_terms"),
        F.count(F.when(F.col("found").isNull() & F.col("optional"), 1)).alias("n_optional_missing"),
        F.min_by(F.concat(F.lit("no row captioned "), "norm"), F.when(F.coalesce(ok, F.lit(False)), None).otherwise(F.col("term"))).alias("first_missing"),
    )
    return out.select(*keys, "row", F.when(F.col("ok"), F.col("total")).alias("value"), "n_terms", "n_optional_missing", F.when(~F.col("ok"), F.col("first_missing")).alias("reason"))


def exit_code(refused: Column, errors: Column) -> Column:
    """1 for a run that was refused, 2 for one with errors, 0 otherwise."""
    return F.when(refused, 1).when(errors > 0, 2).otherwise(0)


def write_back(mapping: DataFrame, matched: DataFrame, keys: list[str]) -> DataFrame:
    """mapping(keys, label, caption) with the wording that matched (keys, label, found) recorded for the next period; others stay."""
    return mapping.join(matched, [*keys, "label"], "left").withColumn("caption", F.coalesce("found", "caption")).drop("found")


def column_letters(col: Column) -> Column:
    """The letters of a column counted from 0: A to Z, then AA on."""
    return F.concat(F.when(col >= 26, F.char((F.floor(col / 26) - 1 + 65).cast("int"))).otherwise(F.lit("")), F.char((col % 26 + 65).cast("int")))


def trailing_year_plug(write_col: Column, margin: Column, revenue_row: Column, row: Column) -> Column:
    """The formula of a trailing-year plug for the column that is written: the margin of four columns' revenue less the three before."""
    at = lambda back, r: F.concat(column_letters(write_col - back), r)
    return F.concat(F.lit("="), margin, F.lit("*SUM("), at(3, revenue_row), F.lit(":"), at(0, revenue_row), F.lit(")-"), at(1, row), F.lit("-"), at(2, row), F.lit("-"), at(3, row))
