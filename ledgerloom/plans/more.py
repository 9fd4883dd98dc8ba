"""Operators that share an expression with another one, each with its own query and cases."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import periods as P
from ..functions.text import normalize_label
from ..operators import assembly as A
from ..operators import lookup as L
from ..sources import packages
from .assembly import _NOTES
from .facts import QUARTERLY, quarterly
from .registry import Table, each, expected, load, query

_DEAL = Table("id int, phrases array<int>, dates array<string>", [(1, [3], ["a", "b"]), (2, [3, 9], ["a", "b", "c", "d"]), (3, [3, 9], ["a", "b", "c"])])


@query("b3_phrases_over_dates", expected("id int, pos int, months int, d string", [(1, 0, 3, "a"), (1, 1, 3, "b"), (2, 0, 3, "a"), (2, 1, 3, "b"), (2, 2, 9, "c"), (2, 3, 9, "d")]))
def b3(spark, sf_dir):
    """k phrases over n dates, if k divides n: n / k dates each, in printed order."""
    t = _DEAL.df(spark)
    return t.select("id", F.posexplode(P.deal(F.col("phrases"), F.col("dates"))).alias("pos", "x")).select("id", "pos", F.col("x.phrase").alias("months"), F.col("x.date").alias("d"))


@query("b11_numeric_ranges", """
    SELECT o_orderkey, CAST(date_diff('month', date_trunc('month', o_orderdate), o_orderdate + INTERVAL 5 MONTH) + 1 AS INTEGER) AS months, last_day(CAST(date_trunc('month', o_orderdate) + INTERVAL 5 MONTH AS DATE)) AS "end" FROM orders""")
def b11(spark, sf_dir):
    """'01.03.2026 - 31.08.2026' from every order's month to five months on, printed with and without a dash, and read back."""
    a, b = F.trunc("o_orderdate", "month"), F.last_day(F.add_months(F.trunc("o_orderdate", "month"), 5))
    text = F.concat(F.date_format(a, "dd.MM.yyyy"), F.when(F.col("o_orderkey") % 2 == 0, " - ").otherwise(" "), F.date_format(b, "dd.MM.yyyy"))
    return load(spark, sf_dir, "orders").withColumn("p", P.parse_header(text)).select("o_orderkey", "p.months", "p.end")


@query("b12_iso_ranges", "SELECT o_orderkey, 3 AS months, last_day(CAST(date_trunc('month', o_orderdate) + INTERVAL 2 MONTH AS DATE)) AS \"end\" FROM orders")
def b12(spark, sf_dir):
    a, b = F.trunc("o_orderdate", "month"), F.last_day(F.add_months(F.trunc("o_orderdate", "month"), 2))
    return load(spark, sf_dir, "orders").withColumn("p", P.parse_header(F.concat(F.date_format(a, "yyyy-MM-dd"), F.lit(" - "), F.date_format(b, "yyyy-MM-dd")))).select("o_orderkey", "p.months", "p.end")


@query("b12_iso_header_lines", expected("pos int, months int, end date", [(0, 3, "2026-06-30"), (1, 6, "2026-06-30"), (2, 3, "2025-06-30")]))
def b12_lines(spark, sf_dir):
    """Several ranges of one header line, newest first."""
    t = Table("line string", [("2026-04-01 - 2026-06-30 | 2025-04-01 - 2025-06-30 | 2026-01-01 - 2026-06-30",)]).df(spark)
    ranges = t.select(F.explode(F.regexp_extract_all("line", F.lit(P.ISO_SPAN), 0)).alias("h")).withColumn("p", P.parse_header(F.col("h"))).select("p.months", "p.end")
    return ranges.select((F.row_number().over(Window.orderBy(F.desc("end"), "months")) - 1).alias("pos"), "months", "end")


@query("b13_spelled_dates", "SELECT o_orderkey, CASE WHEN day(o_orderdate) >= 28 THEN last_day(CAST(o_orderdate AS DATE)) ELSE CAST(o_orderdate AS DATE) END AS \"end\" FROM orders")
def b13(spark, sf_dir):
    """Dates printed in words, day first and month first, and read back; from the 28th on they mean the month's end."""
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "d MMMM yyyy")).otherwise(F.date_format("o_orderdate", "MMMM d, yyyy"))
    return load(spark, sf_dir, "orders").select("o_orderkey", P.parse_header(text)["end"].alias("end"))


@query("a12_column_order", expected("col int, end date, months int", [(0, "2026-06-30", 6), (1, "2026-06-30", 3), (2, "2025-06-30", 6)]))
def a12(spark, sf_dir):
    cells = Table("path string, role string, end date, months int, value double", [("p", "r", "2025-06-30", 6, 1.0), ("p", "r", "2026-06-30", 3, 1.0), ("p", "r", "2026-06-30", 6, 1.0)]).df(spark)
    return packages.period_columns(cells).select("col", "end", "months")


@query("a19_two_passes", expected("row int, formula string, cached double, figure double", [(1, "=1+2", None, 3.0), (2, "=A1", 3.0, 3.0), (3, None, 5.0, 5.0)]))
def a19(spark, sf_dir):
    """A cell's formula and its cached value side by side; typed arithmetic without one is worked out."""
    from ..sources.workbook import shown

    return Table("row int, formula string, cached double", [(1, "=1+2", None), (2, "=A1", 3.0), (3, None, 5.0)]).df(spark).select("row", "formula", "cached", shown(F.col("cached"), F.col("formula")).alias("figure"))


@query("e8_vision_continuation", each("head int, n long, pages array<int>", [(1, 3, [1, 2, 3]), (4, 1, [4])]))
def e8(spark, sf_dir):
    """The next page goes on with the same columns under the same title, or under none."""
    t = Table("stmt int, page int, kind string, title string, sig string, untitled boolean", [(1, 1, "equity", "Changes in equity", "x", False), (2, 2, "equity", "Changes in equity (continued)", "x", False), (3, 3, None, None, "x", True), (4, 4, "equity", "Changes in equity", "y", False)])
    return A.continuations(t.across(spark, sf_dir), ["company"], untitled_only=False)


@query("e17_note_period_headings", each("ln int, end date", [(3, "2026-06-30"), (5, "2025-06-30")]))
def e17(spark, sf_dir):
    """A date alone on its line is the period of the rows below it."""
    return A.noted(_NOTES.across(spark, sf_dir), ["company"]).where("line like 'Retail%'").select("company", "ln", "end")


_BASES = Table("section string, basis string", [(s, b) for s in ("income_statement", "cash_flow", "balance_sheet", "other") for b in (None, "quarter", "point_in_time")])


@query("f21_balance_or_flow", f"SELECT company, section, basis, coalesce(basis = 'point_in_time', section NOT IN ('income_statement', 'cash_flow')) AS balance FROM {_BASES.sql_across()}")
def f21(spark, sf_dir):
    return _BASES.across(spark, sf_dir).select("company", "section", "basis", L.is_balance(F.col("section"), F.col("basis")).alias("balance"))


_ALIASES = Table("field string, forms array<string>", [("revenue", ["revenue", "net sales"])])
_WANTS = Table("want string", [("field:revenue",), ("Cost of sales",), ("field:none",)])


@query("f22_search_forms", f"""
    SELECT company, want, '[' || array_to_string(coalesce(forms, [want]), '|') || ']' AS forms FROM {_WANTS.sql_across()} w LEFT JOIN {_ALIASES.sql} a ON want = 'field:' || field""")
def f22(spark, sf_dir):
    return L.search_forms(_WANTS.across(spark, sf_dir), _ALIASES.df(spark)).select("company", "want", "forms")


@query("j8_islands_facts", f"""
    WITH q AS (SELECT DISTINCT company, caption, period_end FROM ({QUARTERLY}) WHERE value > 2e9), f AS (SELECT *, CASE WHEN abs(round((period_end - lag(period_end) OVER w) / 30.44) - 3) <= 1 THEN 0 ELSE 1 END AS nw FROM q WINDOW w AS (PARTITION BY company, caption ORDER BY period_end)),
    i AS (SELECT *, sum(nw) OVER (PARTITION BY company, caption ORDER BY period_end) AS island FROM f)
    SELECT company, caption, min(period_end) AS first_end, max(period_end) AS last_end, count(*) AS n FROM i GROUP BY company, caption, island""")  # fmt: skip
def j8(spark, sf_dir):
    """Runs of quarters in which a line was large: gaps and islands."""
    from ..operators.basis import islands

    keys = ["company", "caption"]
    large = quarterly(spark, sf_dir).where("value > 2e9").select(*keys, "period_end").distinct()
    return islands(large, keys, 3).groupBy(*keys, "island").agg(F.min("period_end").alias("first_end"), F.max("period_end").alias("last_end"), F.count("*").alias("n")).drop("island")


@query("l8_plan_save", expected("row int, instruction string", [(1, "pdf:Revenue"), (2, "sum:pdf:A|-pdf:B")]))
def l8(spark, sf_dir):
    """The compiled plan as one JSON document, read back by its schema."""
    from ..operators.program import desugar

    t = Table("row int, pdf array<string>", [(1, ["Revenue"]), (2, ["A", "-B"])]).df(spark)
    plan = t.select("row", desugar(F.col("pdf"), F.lit(None).cast("double"), F.lit(False)).alias("instruction"))
    doc = plan.agg(F.to_json(F.struct(F.collect_list(F.struct("row", "instruction")).alias("rows"))).alias("j"))
    return doc.select(F.explode(F.from_json("j", "rows array<struct<row: int, instruction: string>>")["rows"]).alias("r")).select("r.row", "r.instruction")


@query("l9_mapping_append", expected("ord long, label string", [(0, "Revenue"), (1, "Costs"), (2, "Capex")]))
def l9(spark, sf_dir):
    """New rows go behind the old ones, whose order and unknown keys stay."""
    old = Table("ord long, label string", [(0, "Revenue"), (1, "Costs")]).df(spark)
    new = Table("label string", [("costs",), ("Capex",)]).df(spark)
    fresh = new.join(old.select(normalize_label(F.col("label")).alias("k")), normalize_label(F.col("label")) == F.col("k"), "left_anti")
    n = old.agg(F.max("ord").alias("last")).withColumn("one", F.lit(1))
    placed = fresh.withColumn("one", F.lit(1)).join(F.broadcast(n), "one").select((F.col("last") + F.row_number().over(Window.partitionBy("one").orderBy("label"))).alias("ord"), "label")
    return old.unionByName(placed)


@query("n5_stale_absence", expected("label string, stale boolean", [("Goodwill", True), ("Net gain", False), ("Nothing", False)]))
def n5(spark, sf_dir):
    """A line declared absent that is printed now is an error; a printed piece of its label alone is none."""
    absent = Table("label string", [("Goodwill",), ("Net gain",), ("Nothing",)]).df(spark).withColumn("k", normalize_label(F.col("label")))
    lines = Table("caption string", [("Goodwill, net",), ("gain",)]).df(spark).select(normalize_label(F.col("caption")).alias("c"))
    hit = absent.join(F.broadcast(lines), F.contains(F.col("c"), F.col("k")), "left_semi").select("label").withColumn("stale", F.lit(True))
    return absent.select("label").join(hit, "label", "left").select("label", F.coalesce("stale", F.lit(False)).alias("stale"))


@query("g13_join_strategies", "SELECT n_name, count(*) AS orders, CAST(round(sum(o_totalprice)) AS BIGINT) // 1000 AS thousands FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def g13(spark, sf_dir):
    """Physical strategies are left to the optimiser: small sides are broadcast by their size, large ones are merged."""
    joined = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count("*").alias("orders"), F.floor(F.round(F.sum("o_totalprice")).cast("long") / 1000).alias("thousands"))
