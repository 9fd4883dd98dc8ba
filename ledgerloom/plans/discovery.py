"""Queries on layout discovery over the target sheet (groups M and J)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import detect_section, normalize_label
from ..operators import discover as D
from .facts import QUARTERLY, quarterly
from .registry import Table, expected, load, query

#: A sheet of cells: captions in column 2, dates in row 2, formulas and values to the right.
_SHEET = Table("row int, col int, text string, value double, formula string, rgb string", [
    (1, 2, "Company model", None, None, None), (2, 2, "SAR m", None, None, None), (2, 3, "2025-12-31", None, None, None), (2, 4, "2026-03-31", None, None, None), (2, 5, "2026-06-30", None, None, None), (2, 6, "2026-09-30", None, None, None),
    (3, 2, "Income statement", None, None, None), (4, 2, "Revenue", None, None, None), (4, 3, None, 10.0, None, "0000FF"), (4, 4, None, 11.0, None, "0000FF"), (4, 5, None, 12.0, None, "0000FF"),
    (5, 2, "Cost of sales", None, None, None), (5, 3, None, -6.0, None, "0000FF"), (5, 4, None, -7.0, None, "0000FF"), (5, 5, None, -7.5, None, "0000FF"),
    (6, 2, "Gross profit", None, None, None), (6, 3, None, 4.0, "=C4+C5", "000000"), (6, 4, None, 4.0, "=D4+D5", "000000"), (6, 5, None, 4.5, "=E4+E5", "000000"), (6, 6, None, None, "=F4+F5", "000000"),
    (7, 2, "Cash flow", None, None, None), (8, 2, "Revenue", None, None, None), (8, 3, None, 1.0, "=1+0", "0000FF"), (8, 4, None, 2.0, None, "0000FF"), (9, 2, "Revenue", None, None, None), (9, 4, None, 3.0, None, "0000FF"), (9, 1, "x", None, None, None),
])


_CO = ["company"]


@query("m1_label_column", f"""
    WITH w AS (SELECT company, col, count(*) AS n FROM {_SHEET.sql_across()} WHERE col <= 8 AND regexp_matches(text, '[A-Za-z]{{3}}') GROUP BY company, col) SELECT company, arg_max(col, n * 100 - col) AS label_col, max(n) AS n FROM w GROUP BY company""")
def m1(spark, sf_dir):
    return D.label_column(_SHEET.across(spark, sf_dir), _CO)


_REFS = Table("row int, text string, ref int", [(1, "Revenue", None), (2, None, 1), (3, None, 2), (4, None, 4), (5, None, 99)])


@query("m2_caption_indirection", f"""
    WITH RECURSIVE c AS (SELECT * FROM {_REFS.sql_across()}), f AS (SELECT company, "row", text, ref, 0 AS hop FROM c UNION ALL SELECT f.company, f."row", c.text, c.ref, hop + 1 FROM f JOIN c ON f.company = c.company AND f.ref = c."row" WHERE f.text IS NULL AND hop < 5)
    SELECT company, "row", max(text) AS text FROM f GROUP BY company, "row" """)  # fmt: skip
def m2(spark, sf_dir):
    """Captions that are references are followed up to five times."""
    return D.follow(_REFS.across(spark, sf_dir), _CO, 5)


@query("m3_header_and_data_rows", f"""
    WITH p AS (SELECT company, "row", count("value") AS figures, count(text) AS texts FROM {_SHEET.sql_across()} WHERE col > 2 GROUP BY company, "row"), f AS (SELECT company, min("row") AS first_data_row FROM p WHERE figures >= 2 GROUP BY company)
    SELECT p.company, first_data_row, arg_max("row", texts * 1000 + "row") AS header_row FROM p JOIN f ON p.company = f.company WHERE "row" < first_data_row GROUP BY p.company, first_data_row""")  # fmt: skip
def m3(spark, sf_dir):
    return D.first_rows(_SHEET.across(spark, sf_dir), _CO, 2)


_ROLE = """CASE WHEN formula IS NOT NULL AND regexp_matches(regexp_replace(formula, '"[^"]*"', '', 'g'), '[A-Z]{1,3}[0-9]') THEN 'formula' WHEN "value" IS NULL THEN NULL WHEN rgb = '0000FF' THEN 'input' ELSE 'formula' END"""


@query("m4_column_census", f"""
    SELECT company, col, count(CASE WHEN {_ROLE} = 'input' THEN 1 END) AS inputs, count(CASE WHEN {_ROLE} = 'formula' THEN 1 END) AS formulas, count("value") AS "values" FROM {_SHEET.sql_across()} WHERE col > 2 AND text IS NULL GROUP BY company, col""")
def m4(spark, sf_dir):
    return D.census(_SHEET.across(spark, sf_dir), _CO, 2)


@query("m5_period_dates", f"""
    WITH d AS (SELECT company, "row", col, TRY_CAST(text AS DATE) AS "end" FROM {_SHEET.sql_across()}), n AS (SELECT *, count(*) OVER (PARTITION BY company, "row") AS n FROM d WHERE "end" IS NOT NULL), b AS (SELECT *, first_value("row") OVER (PARTITION BY company ORDER BY n DESC, "row") AS best FROM n)
    SELECT company, col, "end" FROM b WHERE "row" = best""")  # fmt: skip
def m5(spark, sf_dir):
    return D.period_row(_SHEET.across(spark, sf_dir), _CO)


@query("m6_write_column", f"""
    WITH t AS (SELECT company, col, count("value") AS n, bool_or(TRY_CAST(text AS DATE) IS NOT NULL) AS dated FROM {_SHEET.sql_across()} WHERE col > 2 AND (company % 2 = 0 OR col < 6) GROUP BY company, col), l AS (SELECT *, max(col) FILTER (n > 0) OVER (PARTITION BY company) AS last FROM t),
    f AS (SELECT company, last, min(col) FILTER (col > last AND n = 0 AND dated) AS free FROM l GROUP BY company, last) SELECT company, coalesce(free, last + 1) AS write_col, CASE WHEN free IS NULL THEN 'append' ELSE 'reserved' END AS mode FROM f""")  # fmt: skip
def m6(spark, sf_dir):
    """Sheets of odd companies have no column ready."""
    return D.write_column(_SHEET.across(spark, sf_dir).where("company % 2 = 0 or col < 6"), _CO, 2)


@query("m7_reference_column", f"""
    WITH n AS (SELECT company, col, count(CASE WHEN {_ROLE} = 'input' THEN 1 END) AS n FROM {_SHEET.sql_across()} WHERE col > 2 AND text IS NULL GROUP BY company, col), d AS (SELECT *, max(n) OVER (PARTITION BY company) AS most FROM n)
    SELECT company, max(col) AS reference_col FROM d WHERE n >= greatest(3, most / 2.0) GROUP BY company""")  # fmt: skip
def m7(spark, sf_dir):
    return D.reference_column(_SHEET.across(spark, sf_dir), _CO, 2)


@query("m8_row_roles", f"""SELECT company, "row", arg_max({_ROLE}, col) AS role FROM {_SHEET.sql_across()} WHERE col > 2 AND ("value" IS NOT NULL OR formula IS NOT NULL) AND {_ROLE} IS NOT NULL GROUP BY company, "row" """)
def m8(spark, sf_dir):
    return D.row_roles(_SHEET.across(spark, sf_dir), _CO, 2)


_SHEETS = Table("sheet string", [("Model",), ("MODEL",), (" data",)])
_SHEETS_ASKED = Table("want string", [("Model",), ("model ",), ("DATA",)])


@query("m9_sheet_name", f"""
    SELECT w.company, want, coalesce(max(sheet) FILTER (sheet = want), CASE WHEN count(*) = 1 THEN max(sheet) END) AS sheet FROM {_SHEETS_ASKED.sql_across()} w JOIN {_SHEETS.sql_across()} s ON w.company = s.company AND lower(trim(want)) = lower(trim(sheet)) GROUP BY w.company, want""")
def m9(spark, sf_dir):
    return D.match_sheets(_SHEETS_ASKED.across(spark, sf_dir), _SHEETS.across(spark, sf_dir), _CO)


@query("m10_fingerprint", f"""
    SELECT company, substr(sha256(string_agg(lower(caption) || '~' || 'income_statement', '|' ORDER BY caption)), 1, 16) AS fingerprint FROM (SELECT DISTINCT company, caption FROM ({QUARTERLY})) GROUP BY company""")  # fmt: skip
def m10(spark, sf_dir):
    """A digest of a sheet's captions and sections."""
    return D.fingerprints(quarterly(spark, sf_dir).select("company", "caption", F.lit("income_statement").alias("section")), _CO)


@query("m16_sheet_drift", f"""
    WITH q AS (SELECT DISTINCT company, caption, period_end FROM ({QUARTERLY})), a AS (SELECT company, string_agg(DISTINCT lower(caption), '|' ORDER BY lower(caption)) AS f FROM q WHERE period_end < DATE '1996-01-01' GROUP BY company),
    b AS (SELECT company, string_agg(DISTINCT lower(caption), '|' ORDER BY lower(caption)) AS f FROM q WHERE period_end >= DATE '1996-01-01' AND company <> 'CHINA' AND (caption <> 'PROMO' OR company < 'J') GROUP BY company)
    SELECT a.company, CASE WHEN b.f IS NULL THEN 'sheet_missing' ELSE 'sheet_drift' END AS code, 'error' AS severity FROM a LEFT JOIN b ON a.company = b.company WHERE b.f IS DISTINCT FROM a.f""")  # fmt: skip
def m16(spark, sf_dir):
    """Sheets as they were saved (lines of the first year) against what they hold now: one sheet is gone, some have lost a line."""
    q = quarterly(spark, sf_dir).withColumn("section", F.lit("income_statement"))
    now = q.where("period_end >= date'1996-01-01' and company <> 'CHINA' and (caption <> 'PROMO' or company < 'J')")
    return D.drift(D.fingerprints(q.where("period_end < date'1996-01-01'"), _CO), D.fingerprints(now, _CO), _CO)


_EFFECTIVE = Table("row int, value double, formula string, result double", [(1, 3.0, "=A1", 3.0), (2, None, "=1+2*3", 7.0), (3, None, "=A1+1", None), (4, 5.0, None, 5.0), (5, None, None, None)])


@query("m17_effective_value", f"""SELECT company, "row", coalesce("value", result) AS effective FROM {_EFFECTIVE.sql_across(["value"])}""")
def m17(spark, sf_dir):
    """A cell's cached value; without one, typed arithmetic is worked out, and references to cells stay empty."""
    from ..sources.workbook import shown

    return _EFFECTIVE.across(spark, sf_dir, ["value"]).select("company", "row", shown(F.col("value"), F.col("formula")).alias("effective"))


@query("m11_draft_plan", expected("row int, label string, kind string, basis string, field string", [(4, "Revenue", "input", "quarter", "revenue"), (5, "Cost of sales", "input", "quarter", "cogs"), (6, "Gross profit", "formula", "quarter", None), (8, "Revenue", "input", "quarter", "revenue"), (9, "Revenue", "input", "quarter", "revenue")]))
def m11(spark, sf_dir):
    """Row kinds, the basis of their sections, and canonical fields by spelling."""
    sheet = _SHEET.df(spark).withColumn("sheet", F.lit("model"))
    rows = D.row_roles(sheet, ["sheet"], 2).withColumnRenamed("role", "kind").join(sheet.where("col = 2").select("row", F.col("text").alias("label")), "row")
    rows = rows.join(D.sections(sheet.where("col = 2"), ["sheet"]).select("row", "section"), "row")
    alias = Table("field string, spelling string", [("revenue", "revenue"), ("cogs", "cost of sales")]).df(spark)
    out = rows.join(F.broadcast(alias), normalize_label(F.col("label")) == F.col("spelling"), "left")
    return out.select("row", "label", "kind", F.when(F.col("section") == "balance_sheet", "point_in_time").otherwise("quarter").alias("basis"), "field")


@query("m12_caption_proposals", expected("label string, caption string, method string", [("Revenue", "Revenue", "exact"), ("EBITDA margin", None, "derived"), ("Cost of sales total", "Cost of sales", "containment"), ("Goodwill", None, "unmatched")]))
def m12(spark, sf_dir):
    """Each sheet row's proposal with the method that found it."""
    from ..functions.text import is_derived
    from ..operators.select import find_row

    sheet = Table("label string", [("Revenue",), ("EBITDA margin",), ("Cost of sales total",), ("Goodwill",)]).df(spark)
    lines = Table("stmt int, row int, caption string, values array<double>", [(1, 0, "Revenue", [1.0]), (1, 1, "Cost of sales", [2.0])]).df(spark)
    found = find_row(sheet.where(~is_derived(F.col("label"))).select(F.col("label").alias("req"), F.lit(1).alias("stmt"), F.array("label").alias("captions")), lines)
    out = sheet.join(found, F.col("label") == F.col("req"), "left").join(lines.select("row", "caption"), "row", "left")
    return out.select("label", "caption", F.when(is_derived(F.col("label")), "derived").otherwise(F.coalesce("tier", F.lit("unmatched"))).alias("method"))


@query("m13_apply_proposals", expected("method string, n long", [("exact", 1), ("unmatched", 1), ("derived", 1), ("containment", 1)]))
def m13(spark, sf_dir):
    return m12(spark, sf_dir).groupBy("method").agg(F.count("*").alias("n"))


@query("m14_mapping_sync", expected("label string, origin string", [("Revenue", "kept"), ("Capex", "added"), ("Old", "kept")]))
def m14(spark, sf_dir):
    """Rows that the mapping lacks are appended; what it has stays as it is (K4)."""
    mapping = Table("label string", [("Revenue",), ("Old",)]).df(spark)
    sheet = Table("label string", [("revenue",), ("Capex",)]).df(spark)
    new = sheet.join(mapping.select(normalize_label(F.col("label")).alias("k")), normalize_label(F.col("label")) == F.col("k"), "left_anti")
    return mapping.withColumn("origin", F.lit("kept")).unionByName(new.withColumn("origin", F.lit("added")))


_LEGACY = Table("label string, instruction string, sign string, inferred boolean", [("a", "sum:pdf:A|-pdf:B", "flip", True), ("b", "pdf:A", "flip", False), ("c", "absent:", None, False)])


@query("m15_legacy_conversion", f"""
    SELECT company, label, CASE WHEN instruction <> 'absent:' THEN '[' || replace(replace(instruction, 'sum:', ''), 'pdf:', '') || ']' END AS pdf, CASE WHEN NOT inferred THEN sign END AS sign FROM {_LEGACY.sql_across()}""")
def m15(spark, sf_dir):
    pdf, sign = D.legacy_rows(F.col("instruction"), F.col("sign"), F.col("inferred"))
    return _LEGACY.across(spark, sf_dir).select("company", "label", pdf.alias("pdf"), sign.alias("sign"))


@query("j1_occurrences", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) AS occurrence FROM lineitem")
def j1(spark, sf_dir):
    """The how-manieth row of its label and section, in sheet order."""
    w = Window.partitionBy("l_orderkey", "l_returnflag").orderBy("l_linenumber")
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(w).cast("long").alias("occurrence"))


@query("j2_section_inheritance", f"""
    SELECT company, "row", CASE WHEN max(CASE WHEN text = 'Cash flow' THEN 1 ELSE 0 END) OVER (PARTITION BY company ORDER BY "row") = 1 THEN 'cash_flow' ELSE 'income_statement' END AS section FROM {_SHEET.sql_across()} WHERE col = 2""")
def j2(spark, sf_dir):
    return D.sections(_SHEET.across(spark, sf_dir).where("col = 2"), _CO).select("company", "row", "section")


@query("j2_forward_fill_events", "SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), -1) AS last_purchase FROM events")
def j2_events(spark, sf_dir):
    """The last marker above, carried forward: the same window on the event table."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    marker = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return load(spark, sf_dir, "events").select("event_id", F.coalesce(F.last(marker, ignorenulls=True).over(w), F.lit(-1)).alias("last_purchase"))


@query("j6_latest_formula", expected("row int, formula string", [(6, "=F4+F5")]))
def j6(spark, sf_dir):
    """The nearest formula to the left that refers to cells; typed arithmetic is none."""
    from ..functions.text import references_cells

    return _SHEET.df(spark).where(references_cells(F.col("formula"))).groupBy("row").agg(F.max_by("formula", "col").alias("formula"))


@query("j9_dense_columns", f"""
    WITH n AS (SELECT company, period_end, count(*) AS n FROM ({QUARTERLY}) GROUP BY ALL), d AS (SELECT *, max(n) OVER (PARTITION BY company) AS most FROM n)
    SELECT company, max(period_end) AS reference FROM d WHERE n >= greatest(3, most / 2.0) GROUP BY company""")  # fmt: skip
def j9(spark, sf_dir):
    n = quarterly(spark, sf_dir).groupBy("company", "period_end").agg(F.count("*").alias("n"))
    dense = n.withColumn("most", F.max("n").over(Window.partitionBy("company"))).where(F.col("n") >= F.greatest(F.lit(3.0), F.col("most") / 2))
    return dense.groupBy("company").agg(F.max("period_end").alias("reference"))


@query("k2_top_periods", f"SELECT company, period_end, value FROM (SELECT company, period_end, sum(value) AS value, row_number() OVER (PARTITION BY company ORDER BY period_end DESC) AS k FROM ({QUARTERLY}) GROUP BY company, period_end) WHERE k <= 4")
def k2(spark, sf_dir):
    t = quarterly(spark, sf_dir).groupBy("company", "period_end").agg(F.sum("value").alias("value"))
    return t.withColumn("k", F.row_number().over(Window.partitionBy("company").orderBy(F.desc("period_end")))).where("k <= 4").select("company", "period_end", "value")


@query("k3_union_all", "SELECT c_nationkey AS nation, c_acctbal AS balance, 'customer' AS source FROM customer UNION ALL SELECT s_nationkey, s_acctbal, 'supplier' FROM supplier")
def k3(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.lit("customer").alias("source"))
    s = load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"), F.lit("supplier").alias("source"))
    return c.unionByName(s)


@query("k4_except", "SELECT c_nationkey AS nation FROM customer EXCEPT SELECT s_nationkey FROM supplier")
def k4(spark, sf_dir):
    return load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).subtract(load(spark, sf_dir, "supplier").select("s_nationkey"))


@query("k5_except_all", "SELECT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'R' EXCEPT ALL SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'A'")
def k5(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem")
    return lines.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("k")).exceptAll(lines.where("l_returnflag = 'A'").select("l_suppkey"))


@query("k6_symmetric_difference", "SELECT coalesce(c.k, s.k) AS nation, c.n AS customers, s.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) c FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) s ON c.k = s.k WHERE c.n IS DISTINCT FROM s.n")
def k6(spark, sf_dir):
    c = load(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    s = load(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return c.join(s, "nation", "full_outer").where(~F.col("customers").eqNullSafe(F.col("suppliers")))


@query("k7_distinct_parts", "SELECT l_orderkey, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_orderkey")
def k7(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_suppkey").alias("suppliers"))


@query("k8_word_overlap", "SELECT b.item_id, len(list_intersect(list_distinct(string_split(lower(b.text), ' ')), ['the', 'of', 'and', 'to'])) AS shared FROM benchmark b")
def k8(spark, sf_dir):
    words = F.array_distinct(F.split(F.lower("text"), " "))
    return load(spark, sf_dir, "benchmark").select("item_id", F.size(F.array_intersect(words, F.array(*map(F.lit, ("the", "of", "and", "to"))))).cast("long").alias("shared"))
