"""Queries on the mapping language (§O), aggregations and arithmetic (group H) and gates (group N)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import normalize_label, rescale
from ..operators import lookup as L
from ..operators import program
from .facts import QUARTERLY, quarterly
from .registry import Table, expected, load, query

_TERMS = Table("term string", [("Revenue",), ("-Cost of sales",), ("Zakat?",), ("EBITDA#2",), ("GIMSA > EBITDA",), ("Sales || Revenue",), ("Cash ## Current @ title:Balance sheet",), ("Tax? ## Total",), ("const:12.5",)])


@query("o1_parse_terms", expected("term string, sign int, caption string, nth int, block string, column string, statement string, optional boolean, const double", [
    ("Revenue", 1, "Revenue", None, None, None, None, False, None), ("-Cost of sales", -1, "Cost of sales", None, None, None, None, False, None), ("Zakat?", 1, "Zakat", None, None, None, None, True, None),
    ("EBITDA#2", 1, "EBITDA", 2, None, None, None, False, None), ("GIMSA > EBITDA", 1, "EBITDA", None, "GIMSA", None, None, False, None), ("Sales || Revenue", 1, "Sales || Revenue", None, None, None, None, False, None),
    ("Cash ## Current @ title:Balance sheet", 1, "Cash", None, None, "Current", "title:Balance sheet", False, None), ("Tax? ## Total", 1, "Tax", None, None, "Total", None, True, None), ("const:12.5", 1, "const:12.5", None, None, None, None, False, 12.5),
]))
def o1(spark, sf_dir):
    return _TERMS.df(spark).withColumn("t", program.parse_term(F.col("term"))).select("term", "t.sign", "t.caption", "t.nth", "t.block", "t.column", "t.statement", "t.optional", "t.const")


_MAPPING = Table("label string, pdf array<string>, value double, carry boolean", [("a", ["A", "-B @ title:X"], None, False), ("b", None, None, False), ("c", None, 2.5, False), ("d", None, None, True), ("e", ["Zakat?"], None, False), ("f", ["Revenue"], None, False)])


@query("o2_desugar", expected("label string, instruction string", [("a", "sum:pdf:A|-pdf:B @ title:X"), ("b", "absent:"), ("c", "const:2.5"), ("d", "carry:"), ("e", "sum:pdf:Zakat?"), ("f", "pdf:Revenue")]))
def o2(spark, sf_dir):
    return _MAPPING.df(spark).select("label", program.desugar(F.col("pdf"), F.col("value"), F.col("carry")).alias("instruction"))


#: A program over the facts' captions: signed sums, an optional line that no filing prints, and one that is missing.
_PROGRAM = Table("row string, term int, sign int, caption string, optional boolean, factor double", [
    ("Net", 0, 1, "PROMO", False, 1.0), ("Net", 1, -1, "small", False, 1.0), ("Net", 2, 1, "Zakat", True, 1.0),
    ("Scaled", 0, 1, "Standard", False, 1000.0), ("Scaled", 1, 1, "ECONOMY", False, 1.0), ("Broken", 0, 1, "LARGE", False, 1.0), ("Broken", 1, 1, "Goodwill", False, 1.0),
])


@query("h0_mapping_program", f"""
    WITH q AS ({QUARTERLY}), e AS (SELECT DISTINCT company, period_end FROM q), p AS (SELECT * FROM {_PROGRAM.sql}),
    j AS (SELECT e.company, e.period_end, p.*, q.value, q.caption IS NOT NULL AS found FROM e CROSS JOIN p LEFT JOIN q ON q.company = e.company AND q.period_end = e.period_end AND lower(q.caption) = lower(p.caption))
    SELECT company, period_end, "row", CASE WHEN bool_and(found OR optional) THEN sum(CASE WHEN found THEN coalesce(value, 0) ELSE 0 END * sign * factor) END AS value, count(*) AS n_terms,
           CAST(count(CASE WHEN NOT found AND optional THEN 1 END) AS BIGINT) AS n_optional_missing, CASE WHEN NOT bool_and(found OR optional) THEN 'no row captioned ' || lower(arg_min(caption, CASE WHEN NOT (found OR optional) THEN term END)) END AS reason
    FROM j GROUP BY company, period_end, "row" """)  # fmt: skip
def h0(spark, sf_dir):
    """The whole program over all companies and quarters in one job."""
    return program.resolve(_PROGRAM.df(spark), quarterly(spark, sf_dir), ["company", "period_end"])


@query("h1_signed_sum", f"""
    SELECT company, period_end, sum(CASE WHEN caption = 'PROMO' THEN value WHEN caption = 'SMALL' THEN -value ELSE 0 END) AS value FROM ({QUARTERLY}) GROUP BY ALL""")
def h1(spark, sf_dir):
    signed = F.when(F.col("caption") == "PROMO", F.col("value")).when(F.col("caption") == "SMALL", -F.col("value")).otherwise(0.0)
    return quarterly(spark, sf_dir).groupBy("company", "period_end").agg(F.sum(signed).alias("value"))


_STACKED = Table("term string", [("--A",), ("-+B",), ("- - -C",), ("D",), ("+-  -E f",)])


@query("h2_stacked_signs", f"""
    SELECT company, term, CASE WHEN len(regexp_extract_all(regexp_extract(term, '^[-+ ]*'), '-')) % 2 = 1 THEN -1 ELSE 1 END AS sign, trim(ltrim(term, '+- ')) AS body FROM {_STACKED.sql_across()}""")
def h2(spark, sf_dir):
    sign, body = L.signed_body(F.col("term"))
    return _STACKED.across(spark, sf_dir).select("company", "term", sign.alias("sign"), body.alias("body"))


@query("h3_cross_statement_terms", expected("row int, value double, reason string", [(1, 1005.0, None), (2, None, "span")]))
def h3(spark, sf_dir):
    """A term of another statement must have the row's span, and is brought to its units."""
    t = Table("row int, term int, value double, units string, months int", [(1, 0, 5.0, "thousands", 3), (1, 1, 1.0, "millions", 3), (2, 0, 5.0, "thousands", 3), (2, 1, 1.0, "millions", 6)]).df(spark)
    own = F.first(F.struct("units", "months")).over(Window.partitionBy("row").orderBy("term"))
    return t.withColumn("own", own).groupBy("row").agg(F.bool_and(F.col("months").eqNullSafe(F.col("own.months"))).alias("ok"), F.sum(rescale(F.col("value"), F.col("units"), F.col("own.units"))).alias("v")).select("row", F.when(F.col("ok"), F.col("v")).alias("value"), F.when(~F.col("ok"), "span").alias("reason"))


_BY_HEADER = Table("caption string, header string, value double", [("Cash", "Current", 3.0), ("Cash", "Non-current", 9.0), ("Debt", "Non-current", 4.0)])
_HEADER_TERMS = Table("row int, caption string, header string", [(1, "Cash", "Current"), (1, "Debt", "Non-current"), (2, "Cash", "Non-current")])


@query("h4_cross_column_terms", f"""
    SELECT t.company, "row", sum(value) AS value FROM {_HEADER_TERMS.sql_across()} t JOIN {_BY_HEADER.sql_across(["value"])} c ON t.company = c.company AND t.caption = c.caption AND t.header = c.header GROUP BY t.company, "row" """)
def h4(spark, sf_dir):
    return L.column_terms(_HEADER_TERMS.across(spark, sf_dir), _BY_HEADER.across(spark, sf_dir, ["value"]), ["company"])


@query("h5_constant_terms", expected("row int, value double", [(1, 12.5), (2, 4.0)]))
def h5(spark, sf_dir):
    terms = Table("row int, term string, found double", [(1, "const:12.5", None), (2, "Revenue", 10.0), (2, "-const:6", None)]).df(spark).withColumn("t", program.parse_term(F.col("term")))
    return terms.groupBy("row").agg(F.sum(F.col("t.sign") * F.coalesce("t.const", "found")).alias("value"))


_SCALE = Table("id int, printed double, found boolean, scale double, units string, prior double, flip boolean", [(1, 4.3, True, 0.01, "thousands", None, False), (2, None, True, 0.01, None, None, False), (3, 10.0, True, 0.01, None, 0.04, False), (4, 5.0, True, None, "thousands", None, True), (5, None, False, None, None, None, False)])


@query("h8_scale_then_decumulate", expected("id int, value double", [(1, 0.043), (2, 0.0), (3, 0.06), (4, -0.005), (5, None)]))
def h8(spark, sf_dir):
    """In this order: a dash of a found row is 0 (H10), scale or units (H8), prior periods, sign (H9)."""
    v = F.when(F.col("found"), F.coalesce("printed", F.lit(0.0)))
    scaled = v * F.coalesce("scale", rescale(F.lit(1.0), F.coalesce("units", F.lit("millions")), F.lit("millions")))
    out = scaled - F.coalesce("prior", F.lit(0.0))
    return _SCALE.df(spark).select("id", F.round(F.when(F.col("flip"), -out).otherwise(out), 9).alias("value"))


@query("h9_sign_convention", expected("caption string, value double", [("Cost of sales", -5.0), ("Gain or (loss) on disposal", 5.0)]))
def h9(spark, sf_dir):
    t = Table("caption string, printed double", [("Cost of sales", 5.0), ("Gain or (loss) on disposal", 5.0)]).df(spark)
    norm = normalize_label(F.col("caption"))
    both = norm.rlike(r"\bgains?\b") & norm.rlike(r"\bloss(es)?\b")
    return t.select("caption", F.when(both, F.col("printed")).otherwise(-F.col("printed")).alias("value"))


_DASHES = Table("caption string, value double", [("A", None), ("B", 5.0)])
_ASKED = Table("caption string", [("A",), ("B",), ("C",)])


@query("h10_dash_is_zero", f"""
    SELECT w.company, w.caption, c.caption IS NOT NULL AS found, CASE WHEN c.caption IS NOT NULL THEN coalesce(value, 0) END AS value FROM {_ASKED.sql_across()} w LEFT JOIN {_DASHES.sql_across(["value"])} c ON w.company = c.company AND w.caption = c.caption""")
def h10(spark, sf_dir):
    return L.found_or_null(_ASKED.across(spark, sf_dir), _DASHES.across(spark, sf_dir, ["value"]), ["company"]).select("company", "caption", "found", "value")


@query("h11_constant_carry_absent", expected("row int, value double, stale boolean", [(1, 2.5, False), (2, 7.0, False), (3, None, True), (4, None, False)]))
def h11(spark, sf_dir):
    """Literals, last period's value, and declared blanks: stale if the line is printed now."""
    rows = Table("row int, kind string, const double, caption string", [(1, "const", 2.5, None), (2, "carry", None, None), (3, "absent", None, "Goodwill"), (4, "absent", None, "Nothing")]).df(spark)
    last = Table("row int, previous double", [(2, 7.0)]).df(spark)
    printed = Table("caption string", [("goodwill",)]).df(spark).withColumn("hit", F.lit(True))
    out = rows.join(last, "row", "left").join(printed.withColumnRenamed("caption", "c"), normalize_label(F.col("caption")) == F.col("c"), "left")
    return out.select("row", F.when(F.col("kind") == "const", F.col("const")).when(F.col("kind") == "carry", F.col("previous")).alias("value"), (F.coalesce("hit", F.lit(False)) & (F.col("kind") == "absent")).alias("stale"))


_TOTALS = Table("id int, values array<double>", [(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 4.0]), (3, [50.0, 50.0, 101.0]), (4, [1.0, None, 1.0])])


@query("h12_totals_agree", f"""SELECT company, id, abs("values"[-1] - list_sum("values"[:-2])) <= 0.02 * abs("values"[-1]) AS agrees FROM {_TOTALS.sql_across(["values"])}""")
def h12(spark, sf_dir):
    from ..operators.assembly import total_agrees

    return _TOTALS.across(spark, sf_dir, ["values"]).select("company", "id", total_agrees(F.col("values")).alias("agrees"))


@query("h14_coverage", f"""
    WITH q AS ({QUARTERLY}) SELECT company, period_end, count(*) AS n, count(*) / 6.0 < 0.5 AS low FROM q GROUP BY ALL""")
def h14(spark, sf_dir):
    """Less than half of the mapped rows resolved is a configuration failure."""
    return quarterly(spark, sf_dir).groupBy("company", "period_end").agg(F.count("*").alias("n"), (F.count("*") / 6.0 < 0.5).alias("low"))


_IDENTITY = Table("company string, label string, value double", [("A", "Profit before tax", 100.0), ("A", "Tax", -10.0), ("A", "Profit", 75.0), ("B", "Profit before tax", 100.0), ("B", "Tax", -10.0), ("B", "Profit", 90.0), ("C", "Profit", 90.0), ("D", "Profit before tax", 100.0), ("D", "Tax", 10.0), ("D", "Profit", 90.0)])


@query("h15_identities", expected("company string, gap double, holds boolean", [("A", 15.0, False), ("B", 0.0, True), ("D", 0.0, True)]))
def h15(spark, sf_dir):
    """Total = sum of parts, or first part less the others: checked only where all rows are there."""
    one = lambda c: F.max(F.when(F.col("label") == c, F.col("value")))
    t = _IDENTITY.df(spark).groupBy("company").agg(one("Profit").alias("t"), one("Profit before tax").alias("a"), one("Tax").alias("b")).where("t is not null and a is not null and b is not null")
    gap = F.least(F.abs(F.col("t") - (F.col("a") + F.col("b"))), F.abs(F.col("t") - (F.col("a") - F.col("b"))))
    return t.select("company", gap.alias("gap"), (gap / F.greatest(F.abs("t"), F.lit(1.0)) <= 0.005).alias("holds"))


@query("h15_identity_facts", f"""
    WITH t AS (SELECT company, period_end, sum(value) AS total, sum(CASE WHEN caption IN ('PROMO', 'SMALL', 'LARGE') THEN value ELSE 0 END) AS a, sum(CASE WHEN caption NOT IN ('PROMO', 'SMALL', 'LARGE') THEN value ELSE 0 END) AS b FROM ({QUARTERLY}) GROUP BY ALL)
    SELECT company, count(*) AS n, CAST(count(CASE WHEN abs(total - a - b) / greatest(abs(total), 1) <= 0.005 THEN 1 END) AS BIGINT) AS n_holds FROM t GROUP BY company""")  # fmt: skip
def h15_facts(spark, sf_dir):
    some = F.col("caption").isin("PROMO", "SMALL", "LARGE")
    t = quarterly(spark, sf_dir).groupBy("company", "period_end").agg(F.sum("value").alias("total"), F.sum(F.when(some, F.col("value")).otherwise(0.0)).alias("a"), F.sum(F.when(~some, F.col("value")).otherwise(0.0)).alias("b"))
    holds = F.abs(F.col("total") - F.col("a") - F.col("b")) / F.greatest(F.abs("total"), F.lit(1.0)) <= 0.005
    return t.groupBy("company").agg(F.count("*").alias("n"), F.count(F.when(holds, 1)).alias("n_holds"))


@query("h16_counts", "SELECT l_returnflag, count(*) AS n, CAST(count(CASE WHEN l_linestatus = 'O' THEN 1 END) AS BIGINT) AS n_open, CAST(count(CASE WHEN l_quantity > 40 THEN 1 END) AS BIGINT) AS n_large FROM lineitem GROUP BY l_returnflag")
def h16(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(F.col("l_linestatus") == "O").alias("n_open"), F.count_if(F.col("l_quantity") > 40).alias("n_large"))


@query("h17_duplicate_claims", "SELECT l_orderkey, l_suppkey, count(*) AS claims FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def h17(spark, sf_dir):
    """One filing line that more than one row claims."""
    return load(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("claims")).where("claims > 1")


@query("h18_mode_unit", "SELECT o_custkey, arg_min(p, (-n, p)) AS unit FROM (SELECT o_custkey, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY ALL) GROUP BY o_custkey")
def h18(spark, sf_dir):
    """The most frequent unit; of equals the first by name, so reruns agree."""
    n = load(spark, sf_dir, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("p")).agg(F.count("*").alias("n"))
    return n.groupBy("o_custkey").agg(F.min_by("p", F.struct(-F.col("n"), "p")).alias("unit"))


# --- gates ------------------------------------------------------------------------------------------------

_PERIODS = Table("company string, end date", [("A", "2025-12-31"), ("A", "2026-03-31"), ("B", "2025-12-31"), ("B", "2026-06-30"), ("C", "2025-12-31"), ("E", "2026-03-31"), ("E", "2026-03-31")])


@query("n1_period_gates", expected("company string, gate string", [("A", None), ("B", "occupied"), ("C", "not_contiguous"), ("D", "no_dates"), ("E", "duplicate")]))
def n1(spark, sf_dir):
    """May 2026-06-30 be appended? Refused if there, if a quarter is missing before it, if a period is twice, or without dates."""
    target = F.lit("2026-06-30").cast("date")
    p = _PERIODS.df(spark).groupBy("company").agg(F.max("end").alias("last"), F.bool_or(F.col("end") == target).alias("there"), (F.count("end") > F.countDistinct("end")).alias("twice"))
    all_ = Table("company string", [("A",), ("B",), ("C",), ("D",), ("E",)]).df(spark).join(p, "company", "left")
    gate = F.when(F.col("last").isNull(), "no_dates").when(F.col("there"), "occupied").when(F.col("twice"), "duplicate").when(F.rint(F.datediff(target, "last") / 30.44) != 3, "not_contiguous")
    return all_.select("company", gate.alias("gate"))


@query("n1_contiguity_facts", f"""
    WITH q AS (SELECT DISTINCT company, period_end FROM ({QUARTERLY})), g AS (SELECT *, round((period_end - lag(period_end) OVER (PARTITION BY company ORDER BY period_end)) / 30.44) AS gap FROM q)
    SELECT company, count(*) AS n, coalesce(bool_and(gap = 3), true) AS contiguous FROM g GROUP BY company""")  # fmt: skip
def n1_facts(spark, sf_dir):
    from ..operators.basis import months_apart

    w = Window.partitionBy("company").orderBy("period_end")
    g = quarterly(spark, sf_dir).select("company", "period_end").distinct().withColumn("gap", months_apart(F.col("period_end"), F.lag("period_end").over(w)))
    return g.groupBy("company").agg(F.count("*").alias("n"), F.coalesce(F.bool_and(F.col("gap") == 3), F.lit(True)).alias("contiguous"))


@query("n2_unbound_gate", expected("refused boolean, n long", [(True, 1)]))
def n2(spark, sf_dir):
    a, b = Table("label string", [("Revenue",), ("Ghost",)]).df(spark), Table("label string", [("revenue",)]).df(spark)
    lost = a.join(b.withColumnRenamed("label", "l"), normalize_label(F.col("label")) == F.col("l"), "left_anti")
    return lost.agg((F.count("*") > 0).alias("refused"), F.count("*").alias("n"))


@query("n3_filing_gates", f"SELECT company, count(DISTINCT period_end) AS ends, max(period_end) < DATE '2001-06-30' AS missing FROM ({QUARTERLY}) GROUP BY company")
def n3(spark, sf_dir):
    """Filings must agree on their latest period and hold the one asked for."""
    return quarterly(spark, sf_dir).groupBy("company").agg(F.countDistinct("period_end").alias("ends"), (F.max("period_end") < F.lit("2001-06-30").cast("date")).alias("missing"))


@query("n4_exit_codes", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 1 WHEN count(CASE WHEN l_returnflag = 'R' THEN 1 END) > 0 THEN 2 ELSE 0 END AS code FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderstatus")
def n4(spark, sf_dir):
    """A refused run, one with errors, and one without: orders as runs, returned lines as errors."""
    lines = load(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("errors"))
    runs = load(spark, sf_dir, "orders").join(lines, "o_orderkey", "left")
    return runs.select("o_orderkey", program.exit_code(F.col("o_orderstatus") == "P", F.coalesce("errors", F.lit(0))).alias("code"))


@query("n6_quality_issues", "SELECT doc_id, CASE WHEN n_chars < 100 THEN 'unreadable' WHEN lang IS NULL THEN 'units_unknown' END AS code FROM documents WHERE n_chars < 100 OR lang IS NULL")
def n6(spark, sf_dir):
    return load(spark, sf_dir, "documents").where("n_chars < 100 or lang is null").select("doc_id", F.when(F.col("n_chars") < 100, "unreadable").otherwise("units_unknown").alias("code"))
