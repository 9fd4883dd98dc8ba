"""A mapping program over filings, from rows of the language to values with their lineage, in one plan for all companies.

Order of evaluation of a row, which must not change: absent, constant, carried, or a signed sum of terms; a term that is not found fails
the row unless it is optional; a dash of a found line is 0; scale (own scale, row unit, statement unit); prior periods are
subtracted from cumulative spans; sign. A row that fails has a null value and a reason, never a guess.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.periods import periods_to_subtract
from ..functions.text import multiplier, row_units
from . import program
from .select import find_block_row, find_row, pick_column


def statement_choices(terms: DataFrame, statements: DataFrame) -> DataFrame:
    """The statement that each term reads: by note number, by title, or by kind; the first readable one in print order."""
    s = statements.select("company", F.col("stmt").alias("s_stmt"), F.col("kind").alias("s_kind"), F.lower("title").alias("s_title"), F.col("note").alias("s_note"), F.col("ord").alias("s_ord"), "readable")
    joined = terms.join(s, "company")
    where = F.col("statement")
    title = F.lower(F.regexp_extract(where, r"(?i)^title:\s*(.*)$", 1))
    by_title = F.startswith(where, F.lit("title:")) & F.exists(F.split(title, r"\s*\|\|\s*"), lambda t: F.contains(F.col("s_title"), t))
    by_note = F.startswith(where, F.lit("note:")) & (F.col("s_note") == F.regexp_extract(where, r"^note:\s*(\d+)$", 1).try_cast("int"))
    by_kind = (F.col("s_kind") == where) | ((where == "income_statement") & (F.col("s_kind") == "comprehensive_income"))
    hits = joined.where(by_title | by_note | by_kind)
    best = hits.groupBy("req").agg(F.min_by("s_stmt", F.struct((F.coalesce(F.col("s_kind") != where, F.lit(False)) & by_kind).alias("other"), (~F.col("readable")).alias("u"), "s_ord")).alias("stmt"))
    return terms.join(best, "req", "left")


def run(mapping: DataFrame, statements: DataFrame, columns: DataFrame, rows: DataFrame, history: DataFrame, target: str, cadence: int, units: str) -> DataFrame:
    """mapping(company, ord, label, section, pdf, value, carry_forward, statement, basis, sign, column, scale);
    statements(company, stmt, kind, title, note, ord, readable, units); columns(stmt, col, header, kind, months, end);
    rows(stmt, row, caption, heading, values); history(company, label, end, value)
    -> company, ord, label, value, reason, source(stmt, captions, header), adjustments.
    """
    m = mapping.withColumn("mode", F.when(F.col("value").isNotNull(), "const").when(F.coalesce("carry_forward", F.lit(False)), "carry").when(F.col("pdf").isNull(), "absent").otherwise("sum"))
    flow = F.col("section").isin("income_statement", "cash_flow")
    m = m.withColumn("balance", F.when(F.col("basis") == "point_in_time", True).when(F.col("basis") == "quarter", False).otherwise(~flow))

    # Terms, with the row's own statement and column where they name none.
    t = m.where("mode = 'sum'").select("company", "ord", "balance", F.col("column").alias("row_column"), F.coalesce("statement", F.when(F.col("section") != "other", F.col("section"))).alias("row_statement"), F.posexplode("pdf").alias("term", "text"))
    t = t.withColumn("t", program.parse_term(F.col("text"))).select("company", "ord", "term", "balance", "row_column", "row_statement", "t.*").withColumn("req", F.xxhash64("company", "ord", "term"))
    t = t.withColumn("own_statement", F.col("statement").isNull()).withColumn("statement", F.coalesce("statement", "row_statement"))
    t = statement_choices(t, statements)

    cells = rows.select("stmt", "row", F.posexplode("values").alias("col", "value"))
    wanted = t.where("stmt is not null and const is null").select("req", "stmt", F.lit(target).cast("date").alias("target"), F.lit(cadence).alias("cadence"), "balance", F.coalesce("column", "row_column").alias("header"))
    picked = pick_column(wanted, columns, cells).withColumnRenamed("reason", "column_reason")

    plain = t.where("stmt is not null and const is null and block is null and nth is null").select("req", "stmt", F.col("alternatives").alias("captions"))
    nth = t.where("nth is not null and block is null").select("req", "stmt", "caption", "nth")
    blocks = t.where("block is not null").select("req", "stmt", "block", "caption")
    from pyspark.sql import Window

    from ..functions.text import normalize_label

    numbered = rows.withColumn("k", normalize_label(F.col("caption"))).withColumn("i", F.row_number().over(Window.partitionBy("stmt", "k").orderBy("row"))).select(F.col("stmt").alias("n_stmt"), "k", "i", "row")
    by_nth = nth.join(numbered, (F.col("stmt") == F.col("n_stmt")) & (F.col("k") == normalize_label(F.col("caption"))) & (F.col("i") == F.col("nth")), "left").select("req", "row", F.when(F.col("row").isNull(), "no_such_occurrence").alias("reason"))
    found = find_row(plain, rows).select("req", "row", "tier", "reason").unionByName(by_nth.withColumn("tier", F.lit("exact"))).unionByName(find_block_row(blocks, rows).withColumn("tier", F.lit("block")))

    line = rows.select(F.col("stmt").alias("l_stmt"), F.col("row").alias("l_row"), F.col("caption").alias("printed"), "values", *([F.col("unverified")] if "unverified" in rows.columns else [F.array().cast("array<int>").alias("unverified")]))
    full = t.join(found, "req", "left").join(picked, "req", "left").join(line, (F.col("stmt") == F.col("l_stmt")) & (F.col("row") == F.col("l_row")), "left")
    full = full.join(statements.select(F.col("stmt").alias("u_stmt"), F.col("units").alias("stmt_units")), F.col("stmt") == F.col("u_stmt"), "left")
    absent = F.col("optional") & F.col("row").isNull() & F.col("tier").isNull()
    near = F.col("optional") & F.col("tier").isNotNull() & (F.col("tier") != "exact")
    why = (
        F.when(F.col("const").isNotNull() | absent, None)
        .when(F.col("stmt").isNull(), "no_statement")
        .when(near, "near_match")
        .when(F.col("reason").isNotNull(), F.col("reason"))
        .when(F.col("row").isNull(), "not_found")
        .when(F.col("col").isNull(), F.coalesce("column_reason", F.lit("no_period")))
        .when(F.col("col") >= F.size("values"), "row_too_short")
        .when(F.array_contains("unverified", F.col("col")), "unverified")
    )
    full = full.withColumn("why", why).withColumn("figure", F.coalesce("const", F.when(absent, F.lit(0.0)).otherwise(F.coalesce(F.get("values", "col"), F.lit(0.0)))))
    # Terms are added in the units of the row's own statement; a row unit on the caption overrides the table's.
    first_units = F.first("stmt_units", ignorenulls=True).over(Window.partitionBy("company", "ord").orderBy((~F.col("own_statement")).cast("int"), "term").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    full = full.withColumn("base_units", F.coalesce(first_units, F.lit(units))).withColumn("term_units", F.coalesce(row_units(F.col("printed")), "stmt_units", F.lit(units)))
    factor = F.when(F.col("const").isNotNull(), F.lit(1.0)).otherwise(multiplier(F.col("term_units")) / multiplier(F.col("base_units")))
    sums = full.groupBy("company", "ord").agg(
        F.sum(F.col("sign") * F.col("figure") * factor).alias("total"),
        F.min_by("why", F.when(F.col("why").isNotNull(), F.col("term"))).alias("why"),
        F.countDistinct("months").alias("n_spans"),
        F.max("months").alias("months"),
        F.first("base_units").alias("base_units"),
        F.min("stmt").alias("stmt"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("printed").isNotNull(), F.struct("term", "printed")))), lambda x: x["printed"]), " + ").alias("captions"),
    )

    out = m.join(sums, ["company", "ord"], "left")
    previous = history.groupBy("company", "label").agg(F.max_by("value", "end").alias("previous"))
    n_prior = F.when(F.col("balance") | F.col("months").isNull(), 0).otherwise(periods_to_subtract(F.col("months"), F.lit(cadence)))
    out = out.join(previous, ["company", "label"], "left").withColumn("n_prior", n_prior)
    prior = history.select(F.col("company").alias("h_company"), F.col("label").alias("h_label"), F.col("end").alias("h_end"), F.col("value").alias("h_value"))
    inside = (F.col("h_end") < F.lit(target).cast("date")) & (F.col("h_end") > F.last_day(F.add_months(F.lit(target).cast("date"), -F.col("months"))))
    priors = out.where("n_prior > 0").select("company", "ord", "label", "months").join(prior, (F.col("company") == F.col("h_company")) & (F.col("label") == F.col("h_label")) & inside).groupBy("company", "ord").agg(F.count("h_value").alias("n_found"), F.sum("h_value").alias("prior"))
    out = out.join(priors, ["company", "ord"], "left")

    scaled = F.col("total") * F.coalesce("scale", multiplier(F.col("base_units")) / multiplier(F.lit(units)))
    missing = (F.col("n_prior") > 0) & (F.coalesce("n_found", F.lit(0)) < F.col("n_prior"))
    standalone = scaled - F.coalesce("prior", F.lit(0.0))
    signed = F.when(F.col("sign") == "flip", -standalone).otherwise(standalone)
    reason = (
        F.when(F.col("mode") == "carry", F.when(F.col("previous").isNull(), "nothing_to_carry"))
        .when(F.col("mode").isin("const", "absent"), None)
        .when(F.col("why").isNotNull(), F.col("why"))
        .when(F.col("n_spans") > 1, "spans_differ")
        .when(F.col("n_prior").isNull(), "span_not_a_multiple")
        .when(missing, "decumulation_missing_prior")
    )
    value = F.when(F.col("mode") == "const", F.col("value")).when(F.col("mode") == "carry", F.col("previous")).when((F.col("mode") == "sum") & reason.isNull(), signed)
    notes = F.array_compact(F.array(
        F.when((F.col("mode") == "sum") & F.col("scale").isNull() & (F.col("base_units") != units), F.concat(F.lit("scaled "), "base_units", F.lit(f" to {units}"))),
        F.when(F.col("scale").isNotNull(), F.lit("own scale")),
        F.when(F.col("n_prior") > 0, F.concat(F.lit("less "), F.col("n_prior").cast("string"), F.lit(" prior periods"))),
        F.when(F.col("sign") == "flip", F.lit("sign flipped")),
    ))
    return out.select("company", "ord", "label", value.alias("value"), reason.alias("reason"), F.struct("stmt", "captions", "months").alias("source"), F.when(value.isNotNull(), notes).alias("adjustments"))
