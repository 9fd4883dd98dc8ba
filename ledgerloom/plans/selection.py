"""Queries on selection (group F) and joins (group G)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import normalize_label
from ..operators import lookup as L
from ..operators import select as S
from .facts import QUARTERLY, quarterly
from .registry import Table, expected, load, query

_STATEMENTS = Table("stmt int, kind string, ord int, readable boolean, title string", [(1, "comprehensive_income", 0, True, "Statement of comprehensive income"), (2, "balance_sheet", 1, False, "Balance sheet"), (3, "balance_sheet", 2, True, "Balance sheet – continued"), (4, "cash_flow", 3, True, "Cash flows: operating"), (5, "cash_flow", 4, True, "Cash flows: investing")])


@query("f1_statement_by_kind", expected("req int, stmt int, reason string", [(1, 1, None), (2, 3, None), (3, 4, None), (4, None, "no equity")]))
def f1(spark, sf_dir):
    requests = Table("req int, kind string", [(1, "income_statement"), (2, "balance_sheet"), (3, "cash_flow"), (4, "equity")]).df(spark)
    return S.pick_statement(requests, _STATEMENTS.df(spark))


_CO = ["company"]
_TITLES = Table("req int, title string", [(1, "cash flows"), (2, "nothing || balance sheet"), (3, "CASH FLOWS: INVESTING"), (4, "segments")])


@query("f2_statement_by_title", f"""
    WITH w AS (SELECT company, req, unnest(string_split(title, ' || ')) AS want, generate_subscripts(string_split(title, ' || '), 1) AS turn FROM {_TITLES.sql_across()}),
    h AS (SELECT w.company, req, turn, stmt, readable, ord, min(turn) OVER (PARTITION BY w.company, req) AS best FROM w JOIN {_STATEMENTS.sql_across()} s ON w.company = s.company AND contains(lower(s.title), lower(want))),
    f AS (SELECT company, req, arg_min(stmt, ord + CASE WHEN readable THEN 0 ELSE 100 END) AS stmt, count(*) AS n FROM h WHERE turn = best GROUP BY company, req)
    SELECT t.company, t.req, f.stmt, coalesce(n, 0) AS n FROM {_TITLES.sql_across()} t LEFT JOIN f ON t.company = f.company AND t.req = f.req""")  # fmt: skip
def f2(spark, sf_dir):
    return L.by_title(_TITLES.across(spark, sf_dir), _STATEMENTS.across(spark, sf_dir), _CO)


_NOTES_BY_NUMBER = Table("stmt int, note int, end date", [(11, 5, "2026-06-30"), (12, 5, "2025-06-30"), (13, 7, "2025-12-31")])
_NOTES_ASKED = Table("req int, note int, target date", [(1, 5, "2026-06-30"), (2, 5, "2024-06-30"), (3, 7, "2026-06-30")])


@query("f3_note_by_number", f"""
    WITH n AS (SELECT company, note, stmt, "end", (SELECT count(DISTINCT "end") FROM {_NOTES_BY_NUMBER.sql} x WHERE x.note = y.note) AS periods FROM {_NOTES_BY_NUMBER.sql_across()} y)
    SELECT r.company, r.req, min(stmt) AS stmt FROM {_NOTES_ASKED.sql_across()} r LEFT JOIN n ON r.company = n.company AND r.note = n.note AND ("end" = target OR periods = 1) GROUP BY r.company, r.req""")  # fmt: skip
def f3(spark, sf_dir):
    return L.by_note(_NOTES_ASKED.across(spark, sf_dir), _NOTES_BY_NUMBER.across(spark, sf_dir), _CO)


_COLUMNS = Table("stmt int, col int, header string, kind string, months int, end date", [
    (1, 0, "Apr-Jun 2026", "period", 3, "2026-06-30"), (1, 1, "Apr-Jun 2025", "period", 3, "2025-06-30"), (1, 2, "Jan-Jun 2026", "period", 6, "2026-06-30"), (1, 3, "Jan-Jun 2025", "period", 6, "2025-06-30"),
    (2, 0, "6m 2026", "period", 6, "2026-06-30"), (2, 1, "Q2 2026", "period", 3, "2026-06-30"), (2, 2, "Q1 2026", "period", 3, "2026-03-31"),
    (3, 0, "6m 2026", "period", 6, "2026-06-30"), (3, 1, "9m 2026", "period", 9, "2026-06-30"), (3, 2, "6m 2025", "period", 6, "2025-06-30"),
    (4, 0, "Current 30 June 2026", "point_in_time", None, "2026-06-30"), (4, 1, "Non-current 30 June 2026", "point_in_time", None, "2026-06-30"), (4, 2, "Current 2025", "point_in_time", None, "2025-12-31"), (4, 3, "Non-current 2025", "point_in_time", None, "2025-12-31"),
    (5, 0, "Reported", "period", 3, "2026-06-30"), (5, 1, "Comparable", "period", 3, "2026-06-30"), (5, 2, "Reported", "period", 3, "2026-06-30"), (5, 3, "Comparable", "period", 3, "2026-06-30"),
    (6, 0, "Retail", "period", 3, "2026-06-30"), (6, 1, "Wholesale", "period", 3, "2026-06-30"), (6, 2, "Total", "period", 3, "2026-06-30"),
    (7, 0, "2Q26", "period", 3, "2026-06-30"), (7, 1, "2Q26", "period", 3, "2026-06-30"),
])
_CELLS = Table("stmt int, col int, row int, value double", [(5, 0, 0, 1.0), (5, 1, 0, 2.0), (5, 2, 0, 3.0), (5, 3, 0, 4.0), (7, 0, 0, 5.0), (7, 1, 0, 5.0), (7, 0, 1, None), (7, 1, 1, None), (6, 0, 0, 1.0), (6, 1, 0, 2.0), (6, 2, 0, 3.0)])


def _pick(spark, rows):
    requests = Table("req int, stmt int, target date, cadence int, balance boolean, header string", rows).df(spark)
    return S.pick_column(requests, _COLUMNS.df(spark), _CELLS.df(spark))


@query("f4_period_column", expected("req int, col int, months int, reason string", [(1, 0, 3, None), (2, 1, 3, None), (3, 0, 6, "cumulative"), (4, None, None, "no_period"), (5, None, None, "no_columns")]))
def f4(spark, sf_dir):
    return _pick(spark, [(1, 1, "2026-06-30", 3, False, None), (2, 2, "2026-06-30", 3, False, None), (3, 3, "2026-06-30", 3, False, None), (4, 1, "2026-09-30", 3, False, None), (5, 99, "2026-06-30", 3, False, None)])


@query("f5_header_narrowing", expected("req int, col int, months int, reason string", [(1, None, None, "ambiguous"), (2, 0, None, None), (3, 1, None, None), (4, 2, 3, None), (5, 3, 3, None), (6, None, None, "ambiguous"), (7, None, None, "no_header")]))
def f5(spark, sf_dir):
    d = "2026-06-30"
    return _pick(spark, [(1, 4, d, 3, True, None), (2, 4, d, 3, True, "Current"), (3, 4, d, 3, True, "Non-current"), (4, 5, d, 3, False, "Reported #2"), (5, 5, d, 3, False, "Comparable#2"), (6, 5, d, 3, False, "Reported"), (7, 5, d, 3, False, "Reported#3")])


@query("f6_tie_break", expected("req int, col int, months int, reason string", [(1, 2, 3, None), (2, 0, 3, None), (3, None, None, "ambiguous")]))
def f6(spark, sf_dir):
    return _pick(spark, [(1, 6, "2026-06-30", 3, False, None), (2, 7, "2026-06-30", 3, False, None), (3, 5, "2026-06-30", 3, False, None)])


@query("f4_period_column_facts", f"""
    WITH q AS ({QUARTERLY}), e AS (SELECT DISTINCT company, period_end FROM q) SELECT company, period_end, CAST(0 AS INTEGER) AS col, CAST(3 AS INTEGER) AS months FROM e""")  # fmt: skip
def f4_facts(spark, sf_dir):
    """Each company's filing of each quarter prints the quarter and the year to date; the quarter is selected."""
    ends = quarterly(spark, sf_dir).select("company", "period_end").distinct().withColumn("stmt", F.xxhash64("company", "period_end"))
    both = F.array(F.struct(F.lit(0).alias("col"), F.lit("Q").alias("header"), F.lit(3).alias("months")), F.struct(F.lit(1).alias("col"), F.lit("YTD").alias("header"), F.month("period_end").alias("months")))
    columns = ends.select("stmt", F.inline(both)).join(ends, "stmt").select("stmt", "col", "header", F.lit("period").alias("kind"), "months", F.col("period_end").alias("end")).where("col = 0 or months > 3")
    requests = ends.select(F.col("stmt").alias("req"), "stmt", F.col("period_end").alias("target"), F.lit(3).alias("cadence"), F.lit(False).alias("balance"), F.lit(None).cast("string").alias("header"))
    cells = columns.select("stmt", "col", F.lit(0).alias("row"), F.lit(1.0).alias("value"))
    return S.pick_column(requests, columns, cells).join(ends, F.col("req") == F.col("stmt")).select("company", "period_end", "col", "months")


_ROWS = Table("stmt int, row int, caption string, heading string, values array<double>", [
    (1, 0, "Revenue", None, [10.0]), (1, 1, "Cost of sales", None, [-6.0]), (1, 2, "Other (Expenses) / Income, net", None, [1.0]), (1, 3, "Finance income", None, [2.0]), (1, 4, "Finance costs", None, [-3.0]), (1, 5, "Profit before zakat and income tax", None, [5.0]),
    (1, 6, "Revenue", None, [11.0]), (2, 0, "Other expenses, net", None, [1.0]), (2, 1, "Other income, net", None, [2.0]), (3, 0, "Net cash used in operating activities", None, [7.0]), (3, 1, "Net cash used in operating activities", None, [7.0]), (3, 2, "Net cash from financing", None, [8.0]),
])


def _find(spark, rows):
    return S.find_row(Table("req int, stmt int, captions array<string>", rows).df(spark), _ROWS.df(spark))


@query("f7_find_exact", expected('req int, row int, tier string, reason string', [(1, 0, "exact", None), (2, 1, "exact", None), (3, None, None, "not_found")]))
def f7(spark, sf_dir):
    return _find(spark, [(1, 1, ["REVENUE"]), (2, 1, ["Turnover costs", "Cost of  sales"]), (3, 1, ["Goodwill"])])


@query("f8_find_direction", expected('req int, row int, tier string, reason string', [(1, 2, "direction", None), (2, None, "direction", "needs_a_sum")]))
def f8(spark, sf_dir):
    return _find(spark, [(1, 1, ["Other Expenses, net"]), (2, 2, ["Other (Expenses) / Income, net"])])


@query("f9_find_containment", expected('req int, row int, tier string, reason string', [(1, 5, "containment", None), (2, None, "containment", "ambiguous")]))
def f9(spark, sf_dir):
    return _find(spark, [(1, 1, ["Profit before zakat"]), (2, 1, ["Finance"])])


@query("f10_find_words", expected('req int, row int, tier string, reason string', [(1, 5, "words", None), (2, None, None, "not_found")]))
def f10(spark, sf_dir):
    return _find(spark, [(1, 1, ["zakat profit tax"]), (2, 1, ["xyz sales"])])


@query("f11_duplicate_lines", expected('req int, row int, tier string, reason string', [(1, 0, "containment", None), (2, None, "containment", "ambiguous")]))
def f11(spark, sf_dir):
    """A line printed twice with the same figures is one line."""
    return _find(spark, [(1, 3, ["operating activities"]), (2, 3, ["Net cash"])])


@query("f12_nth_exact", expected("req int, row int", [(1, 0), (2, 6), (3, None)]))
def f12(spark, sf_dir):
    nth = _ROWS.df(spark).withColumn("norm", normalize_label(F.col("caption"))).withColumn("nth", F.row_number().over(Window.partitionBy("stmt", "norm").orderBy("row")))
    wants = Table("req int, stmt int, norm string, nth int", [(1, 1, "revenue", 1), (2, 1, "revenue", 2), (3, 1, "revenue", 3)]).df(spark)
    return wants.join(nth, ["stmt", "norm", "nth"], "left").select("req", "row")


_BLOCKS = Table("stmt int, row int, caption string, heading string", [(1, 0, "GIMSA", None), (1, 1, "Net Sales", None), (1, 2, "EBITDA", None), (1, 3, "Estados Unidos (USA)", None), (1, 4, "Net Sales", None), (1, 5, "EBITDA", None), (1, 6, "Centroamérica", None), (1, 7, "EBITDA", None), (1, 8, "Other EBITDA", "Otros")])


@query("f13_block_rows", expected("req int, row int, reason string", [(1, 2, None), (2, 4, None), (3, 7, None), (4, 8, None), (5, None, "ambiguous_heading"), (6, None, "no_heading")]))
def f13(spark, sf_dir):
    requests = Table("req int, stmt int, block string, caption string", [(1, 1, "GIMSA", "EBITDA"), (2, 1, "USA", "Net Sales"), (3, 1, "Centroamerica", "EBITDA"), (4, 1, "otros", "EBITDA"), (5, 1, "Net Sales", "EBITDA"), (6, 1, "Asia", "EBITDA")]).df(spark)
    return S.find_block_row(requests, _BLOCKS.df(spark))


@query("f14_alternatives", expected('req int, row int, reason string', [(1, 0, None), (2, 1, None), (3, None, "not_found")]))
def f14(spark, sf_dir):
    """Of 'A || B' the first that is found; each is looked up on its own."""
    asked = Table("req int, stmt int, text string", [(1, 1, "Turnover || Revenue"), (2, 1, "Cost of sales || Revenue"), (3, 1, "A1 || B2")]).df(spark)
    each = asked.select("req", "stmt", F.posexplode(F.split("text", r"\s*\|\|\s*")).alias("turn", "c"))
    found = S.find_row(each.select(F.struct("req", "turn").alias("req"), "stmt", F.array("c").alias("captions")), _ROWS.df(spark))
    best = found.groupBy("req.req").agg(F.min_by("row", F.when(F.col("row").isNotNull(), F.col("req.turn"))).alias("row"))
    return best.select("req", "row", F.when(F.col("row").isNull(), "not_found").alias("reason"))


@query("f15_optional_terms", expected("req int, value double, reason string", [(1, 5.0, None), (2, 0.0, None), (3, None, "near_match")]))
def f15(spark, sf_dir):
    """An optional caption is found exactly, or it is 0; something near it is an error."""
    asked = Table("req int, stmt int, caption string", [(1, 1, "Profit before zakat and income tax"), (2, 1, "Zakat charge"), (3, 1, "Profit before zakat")]).df(spark)
    found = S.find_row(asked.select("req", "stmt", F.array("caption").alias("captions")), _ROWS.df(spark)).join(asked.select("req", "stmt"), "req")
    value = found.join(_ROWS.df(spark).select("stmt", "row", F.get("values", F.lit(0)).alias("v")), ["stmt", "row"], "left")
    return value.select("req", F.when(F.col("tier") == "exact", F.col("v")).when(F.col("tier").isNull(), F.lit(0.0)).alias("value"), F.when(F.col("tier") != "exact", "near_match").alias("reason"))


_ALIASES = Table("field string, caption string", [("revenue", "Revenue"), ("revenue", "Net sales"), ("cogs", "Cost of sales"), ("cogs", "Cost of revenue")])


@query("f17_field_aliases", expected("field string, row int, tier string", [("revenue", 0, "exact"), ("cogs", 1, "exact")]))
def f17(spark, sf_dir):
    """Canonical fields are looked up by their spellings, in order; never by the field's own name."""
    wants = _ALIASES.df(spark).groupBy("field").agg(F.collect_list("caption").alias("captions"))
    return S.find_row(wants.select(F.col("field").alias("req"), F.lit(1).alias("stmt"), "captions"), _ROWS.df(spark)).select(F.col("req").alias("field"), "row", "tier")


@query("f16_lookup_dispatch", expected("req int, by string", [(1, "caption"), (2, "alias"), (3, "absent")]))
def f16(spark, sf_dir):
    """A recorded caption first, then the field's aliases, else the row is absent."""
    asked = Table("req int, hint string, field string", [(1, "Finance costs", "cogs"), (2, None, "cogs"), (3, None, None)]).df(spark)
    aliases = _ALIASES.df(spark).groupBy("field").agg(F.collect_list("caption").alias("aliases"))
    tries = asked.join(aliases, "field", "left").select("req", F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.lit("caption").alias("by"), F.when(F.col("hint").isNotNull(), F.array("hint")).alias("captions")), F.struct(F.lit(1).alias("turn"), F.lit("alias").alias("by"), F.col("aliases").alias("captions")))).alias("t")).select("req", "t.*")
    found = S.find_row(tries.where("captions is not null").select(F.struct("req", "turn", "by").alias("req"), F.lit(1).alias("stmt"), "captions"), _ROWS.df(spark)).where("row is not null")
    best = found.groupBy("req.req").agg(F.min_by("req.by", "req.turn").alias("by"))
    return asked.select("req").join(best, "req", "left").select("req", F.coalesce("by", F.lit("absent")).alias("by"))


_WITHHELD = Table("row int, values array<double>, unverified array<int>, col int", [(0, [1.0, 2.0], [1], 0), (1, [1.0, 2.0], [1], 1), (2, [None], [], 0)])


@query("f18_unverified", f"""
    SELECT company, "row", CASE WHEN NOT list_contains(unverified, col) THEN "values"[col + 1] END AS value, CASE WHEN list_contains(unverified, col) THEN 'unverified' END AS reason FROM {_WITHHELD.sql_across(["values"])}""")
def f18(spark, sf_dir):
    value, reason = L.withhold(F.col("values"), F.col("unverified"), F.col("col"))
    return _WITHHELD.across(spark, sf_dir, ["values"]).select("company", "row", value.alias("value"), reason.alias("reason"))


_ELSEWHERE = Table("caption string, kind string", [("Depreciation", "cash_flow"), ("Goodwill", "note"), ("Tax", "cash_flow"), ("Tax", "balance_sheet"), ("Depreciation", "note"), ("Land", "note"), ("Land", "note")])


@query("f19_elsewhere", f"""
    SELECT company, caption, CASE WHEN count(DISTINCT kind) FILTER (kind <> 'note') = 1 THEN max(kind) FILTER (kind <> 'note') WHEN count(*) FILTER (kind <> 'note') = 0 AND count(*) = 1 THEN 'note' END AS kind FROM {_ELSEWHERE.sql_across()} GROUP BY company, caption""")
def f19(spark, sf_dir):
    return L.elsewhere(_ELSEWHERE.across(spark, sf_dir), _CO)


_DEFAULTS = Table("section string, basis string", [("income_statement", None), ("balance_sheet", None), ("other", None), ("other", "quarter"), ("cash_flow", "point_in_time")])


@query("f20_derived_defaults", f"""
    SELECT company, section, basis, nullif(section, 'other') AS statement, CASE basis WHEN 'point_in_time' THEN true WHEN 'quarter' THEN false ELSE section NOT IN ('income_statement', 'cash_flow') END AS point_in_time FROM {_DEFAULTS.sql_across()}""")
def f20(spark, sf_dir):
    section, basis = F.col("section"), F.col("basis")
    return _DEFAULTS.across(spark, sf_dir).select("company", "section", "basis", L.default_statement(section).alias("statement"), L.is_balance(section, basis).alias("point_in_time"))


# --- joins ------------------------------------------------------------------------------------------------


@query("g1_bind_rows", f"""
    WITH q AS (SELECT DISTINCT caption FROM ({QUARTERLY})), m AS (SELECT * FROM (VALUES ('PROMO', 1), ('SMALL', 2), ('GIANT', 3)) v(label, ord)) SELECT label, ord, caption FROM m JOIN q ON m.label = q.caption""")  # fmt: skip
def g1(spark, sf_dir):
    """Mapping rows bound to sheet rows by their key; the program is the small side."""
    sheet = quarterly(spark, sf_dir).select("caption").distinct()
    m = Table("label string, ord int", [("PROMO", 1), ("SMALL", 2), ("GIANT", 3)]).df(spark)
    return sheet.join(F.broadcast(m), normalize_label(F.col("label")) == normalize_label(F.col("caption"))).select("label", "ord", "caption")


@query("g2_unbound_rows", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def g2(spark, sf_dir):
    """Left anti: keys of one side that the other lacks."""
    return load(spark, sf_dir, "customer").join(load(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("g3_unmapped_rows", "SELECT s_suppkey FROM supplier WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 45 AND l_returnflag = 'R')")
def g3(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").where("l_quantity > 45 and l_returnflag = 'R'")
    return load(spark, sf_dir, "supplier").join(lines, F.col("s_suppkey") == F.col("l_suppkey"), "left_anti").select("s_suppkey")


_MAP = Table("norm string, occurrence int, row int", [("revenue", 1, 3), ("costs", 1, 4), ("tax", 1, 9)])
_LAYOUT = Table("norm string, occurrence int, row int", [("revenue", 1, 3), ("costs", 1, 5), ("ebitda", 1, 6)])


@query("g4_bind_diagnostics", f"""
    SELECT coalesce(m.company, l.company) AS company, coalesce(m.norm, l.norm) AS norm, CASE WHEN l.norm IS NULL THEN 'missing' WHEN m.norm IS NULL THEN 'new' WHEN m."row" <> l."row" THEN 'moved' ELSE 'same' END AS verdict
    FROM {_MAP.sql_across()} m FULL JOIN {_LAYOUT.sql_across()} l ON m.company = l.company AND m.norm = l.norm AND m.occurrence = l.occurrence""")  # fmt: skip
def g4(spark, sf_dir):
    return L.bind(_MAP.across(spark, sf_dir), _LAYOUT.across(spark, sf_dir), _CO).drop("occurrence")


@query("g5_unmapped_inputs", f"SELECT company, norm FROM {_LAYOUT.sql_across()} l WHERE NOT EXISTS (SELECT 1 FROM {_MAP.sql_across()} m WHERE m.company = l.company AND m.norm = l.norm)")
def g5(spark, sf_dir):
    return L.unmapped(_LAYOUT.across(spark, sf_dir), _MAP.across(spark, sf_dir), _CO).select("company", "norm")


@query("g6_nearest_captions", """
    WITH c AS (SELECT DISTINCT p_brand || ' ' || p_type AS norm, p_size AS size FROM part WHERE p_partkey % 3 = 0), w AS (SELECT DISTINCT p_brand || ' ' || lower(p_type) AS want, p_size AS size FROM part WHERE p_partkey % 7 = 0),
    j AS (SELECT w.size, want, norm, round(1 - levenshtein(want, norm) / greatest(length(want), length(norm)), 6) AS ratio FROM w JOIN c ON w.size = c.size), r AS (SELECT *, row_number() OVER (PARTITION BY size, want ORDER BY ratio DESC, norm) AS place FROM j WHERE ratio >= 0.5)
    SELECT size, want, CAST(place AS INTEGER) AS place, norm AS caption, ratio FROM r WHERE place <= 3""")  # fmt: skip
def g6(spark, sf_dir):
    """Suggestions for a message: the three nearest captions, if near enough."""
    part = load(spark, sf_dir, "part").withColumnRenamed("p_size", "size")
    captions = part.where("p_partkey % 3 = 0").select("size", F.concat_ws(" ", "p_brand", "p_type").alias("norm"))
    wants = part.where("p_partkey % 7 = 0").select("size", F.concat_ws(" ", "p_brand", F.lower("p_type")).alias("want")).distinct()
    return L.nearest(wants, captions, ["size"], 3, 0.5)


@query("g7_substring_join", "SELECT p_partkey, r_name FROM part JOIN region ON contains(lower(p_name), substr(lower(r_name), 1, 2)) OR contains(lower(p_type), substr(lower(r_name), 1, 3))")
def g7(spark, sf_dir):
    """A bounded list of titles against all lines: each line tries the list as an array, so no pair is built that does not match."""
    names = load(spark, sf_dir, "region").agg(F.collect_list("r_name").alias("names")).withColumn("one", F.lit(1))
    parts = load(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("n"), F.lower("p_type").alias("t"), F.lit(1).alias("one"))
    hits = F.filter("names", lambda r: F.contains(F.col("n"), F.substring(F.lower(r), 1, 2)) | F.contains(F.col("t"), F.substring(F.lower(r), 1, 3)))
    return parts.join(F.broadcast(names), "one").select("p_partkey", F.explode(hits).alias("r_name"))


_FRAGMENTS = Table("page int, frag string, x0 double, x1 double", [(1, "Q2 2026", 100.0, 160.0), (1, "Six months", 205.0, 345.0), (1, "far", 500.0, 520.0)])
_RANGES = Table("page int, col int, l double, r double", [(1, 0, 110.0, 150.0), (1, 1, 210.0, 260.0), (1, 2, 290.0, 340.0)])


@query("g8_range_overlap", f"""
    SELECT f.company, frag, col FROM {_FRAGMENTS.sql_across()} f JOIN {_RANGES.sql_across()} r ON f.company = r.company AND f.page = r.page AND least(x1, r) - greatest(x0, l) >= least(x1 - x0, r - l) / 2""")
def g8(spark, sf_dir):
    return L.overlaps(_FRAGMENTS.across(spark, sf_dir), _RANGES.across(spark, sf_dir), ["company", "page"]).drop("page")


@query("g9_asof_backward", f"""
    WITH q AS (SELECT DISTINCT company, period_end FROM ({QUARTERLY})), e AS (SELECT DISTINCT n_name AS company, CAST(o_orderdate AS DATE) AS d FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
    SELECT e.company, e.d, q.period_end FROM e ASOF JOIN q ON e.company = q.company AND e.d >= q.period_end""")  # fmt: skip
def g9(spark, sf_dir):
    """The latest period end at or before each day: both sides in one ordered window, no pair of rows is built."""
    ends = quarterly(spark, sf_dir).select("company", F.col("period_end").alias("d"), F.col("period_end").alias("period_end"), F.lit(False).alias("ask")).distinct()
    days = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    days = days.select(F.col("n_name").alias("company"), F.to_date("o_orderdate").alias("d")).distinct().select("company", "d", F.lit(None).cast("date").alias("period_end"), F.lit(True).alias("ask"))
    w = Window.partitionBy("company").orderBy("d", "ask").rowsBetween(Window.unboundedPreceding, 0)
    both = ends.unionByName(days).withColumn("last", F.last("period_end", ignorenulls=True).over(w))
    return both.where("ask and last is not null").select("company", "d", F.col("last").alias("period_end"))


@query("g10_asof_forward", f"""
    WITH q AS (SELECT DISTINCT company, period_end FROM ({QUARTERLY})) SELECT a.company, a.period_end, min(b.period_end) AS next_end FROM q a JOIN q b ON a.company = b.company AND b.period_end > a.period_end GROUP BY ALL""")  # fmt: skip
def g10(spark, sf_dir):
    ends = quarterly(spark, sf_dir).select("company", "period_end").distinct()
    return ends.withColumn("next_end", F.lead("period_end").over(Window.partitionBy("company").orderBy("period_end"))).where("next_end is not null")


@query("g11_printed_on_page", "SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '\\d{3,}')) > 0 AND list_has_any(regexp_extract_all(text, '\\d{3,}'), (SELECT list(CAST(p_partkey AS VARCHAR)) FROM part))")
def g11(spark, sf_dir):
    """Figures that a page prints, semi-joined with the figures asked for."""
    figures = load(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(\d{3,})"), 1)).alias("f"))
    return figures.join(load(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("f")), "f", "left_semi").select("doc_id").distinct()


@query("g12_total_and_parts", f"""
    SELECT company, period_end, sum(CASE WHEN caption = 'PROMO' THEN value END) AS promo, sum(CASE WHEN caption = 'SMALL' THEN value END) AS small, sum(value) AS total FROM ({QUARTERLY}) GROUP BY ALL""")  # fmt: skip
def g12(spark, sf_dir):
    """The lines of an identity side by side: one aggregation instead of a self-join for each part."""
    one = lambda c: F.sum(F.when(F.col("caption") == c, F.col("value")))
    return quarterly(spark, sf_dir).groupBy("company", "period_end").agg(one("PROMO").alias("promo"), one("SMALL").alias("small"), F.sum("value").alias("total"))
