"""Queries on statement assembly (group E) and verification (group I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import assembly as A
from ..operators import verify as V
from .registry import Table, each, expected, load, query

_PAGE = Table("page int, ln int, line string", [
    (1, 0, "Income statement ........ 5"), (1, 1, "Consolidated statement of income"), (1, 2, "For the three months ended 30 June 2026"), (1, 3, "SAR '000"), (1, 4, "Revenue 10,000 9,000"), (1, 5, "Cost of sales and"), (1, 6, "services rendered (5,000) (4,000)"), (1, 7, "Statement of nothing"),
    (2, 0, "Notes to the accounts"), (2, 1, "Some prose about the business"),
])


_DOC = ["company"]


@query("e1_title_and_heading", each("page int, title string, heading string", [(1, "Consolidated statement of income", "For the three months ended 30 June 2026"), (2, None, None)]))
def e1(spark, sf_dir):
    """Contents lines are no titles."""
    return A.title_and_heading(_PAGE.across(spark, sf_dir), _DOC)


@query("e2_header_block", f"""
    SELECT company, page, string_agg(line, chr(10) ORDER BY ln) AS block FROM {_PAGE.sql_across()} WHERE ln < CASE page WHEN 1 THEN 4 ELSE 10 END GROUP BY company, page""")
def e2(spark, sf_dir):
    return A.header_blocks(_PAGE.across(spark, sf_dir), _DOC)


@query("e3_body_rows", each("caption string, values array<double>", [("Revenue", [10000.0, 9000.0]), ("Cost of sales and services rendered", [-5000.0, -4000.0])]))
def e3(spark, sf_dir):
    return A.body_rows(_PAGE.across(spark, sf_dir), _DOC).select("company", "caption", "values")


_TEXT_ROWS = Table("caption string, v double", [("Revenue", 1.0), ("Revenue", 1.0), ("Costs", 2.0), ("Tax", 3.0)])
_PIPE_ROWS = Table("caption string, v double", [("Revenue", 1.0), ("Costs", 2.0)])


@query("e3_multiset_difference", expected("caption string, v double", [("Revenue", 1.0), ("Tax", 3.0)]))
def e3_multiset(spark, sf_dir):
    """Lines that a second rendering repeats go once for each repeat, not altogether (K5)."""
    return _TEXT_ROWS.df(spark).exceptAll(_PIPE_ROWS.df(spark))


_MORE = Table("page int, ln int, line string", [(3, 0, "Revenue 10,000 9,000"), (3, 1, "Costs (5,000) (4,000)"), (3, 2, "Profit 5,000 5,000"), (3, 3, "end")])


@query("e4_extract_statement", f"""
    SELECT company, page, count(CASE WHEN regexp_matches(line, '[0-9],[0-9]{{3}}.* ') THEN 1 END) AS n_rows, count(CASE WHEN regexp_matches(line, '[0-9],[0-9]{{3}}.* ') THEN 1 END) >= 3 AS kept
    FROM (SELECT * FROM {_PAGE.sql_across()} UNION ALL SELECT * FROM {_MORE.sql_across()}) GROUP BY company, page""")  # fmt: skip
def e4(spark, sf_dir):
    return A.statement_pages(_PAGE.across(spark, sf_dir).unionByName(_MORE.across(spark, sf_dir)), _DOC)


_TEXT = Table("page int, ln int, line string", [(1, 0, "text"), (1, 1, "Reconciliation of EBITDA"), (1, 2, "Profit 1,000 900"), (2, 0, "reconciliation  of cash"), (2, 1, "irreconciliation of")])


@query("e5_embedded_tables", f"SELECT company, page, ln, 'summary' AS kind FROM {_TEXT.sql_across()} WHERE regexp_matches(lower(line), '(^| )reconciliation +of ')")
def e5(spark, sf_dir):
    return A.embedded_tables(_TEXT.across(spark, sf_dir), _DOC)


_PAGES = Table("stmt int, page int, kind string, title string, sig string, untitled boolean", [
    (1, 4, "balance_sheet", "Balance sheet", "a", False), (2, 5, "balance_sheet", "Balance sheet (continued)", "a", False), (3, 6, "balance_sheet", "Balance sheet", "b", False), (4, 8, "balance_sheet", "Balance sheet", "b", False),
    (5, 9, "cash_flow", "Cash flows", "c", False), (6, 10, None, None, "c", True), (7, 11, None, None, "d", True),
])


_RUNS = f"""
    WITH p AS (SELECT *, lag(page) OVER w AS pp, lag(sig) OVER w AS ps, lag(kind) OVER w AS pk, trim(replace(lower(title), '(continued)', '')) AS f, lag(trim(replace(lower(title), '(continued)', ''))) OVER w AS pf FROM {_PAGES.sql_across()} WINDOW w AS (PARTITION BY company ORDER BY page)),
    n AS (SELECT *, CASE WHEN page = pp + 1 AND sig = ps AND (untitled OR %s) THEN 0 ELSE 1 END AS new FROM p), r AS (SELECT *, sum(new) OVER (PARTITION BY company ORDER BY page) AS run FROM n)
    SELECT company, arg_min(stmt, page) AS head, count(*) AS n, '[' || string_agg(page, '|' ORDER BY page) || ']' AS pages FROM r GROUP BY company, run"""  # fmt: skip


@query("e6_continuation_append", _RUNS % "false")
def e6(spark, sf_dir):
    """An untitled next page with the same periods belongs to the statement before it: gaps and islands."""
    return A.continuations(_PAGES.across(spark, sf_dir), _DOC, untitled_only=True)


@query("e7_continued_view", _RUNS % "(kind = pk AND coalesce(starts_with(f, pf) OR ends_with(pf, f), false))")
def e7(spark, sf_dir):
    """Consecutive pages with the same kind, title (one may be the other's beginning) and periods are read as one."""
    return A.continuations(_PAGES.across(spark, sf_dir), _DOC, untitled_only=False)


@query("e9_running_headers", "WITH l AS (SELECT doc_id, string_split(text, chr(10))[1] AS line FROM documents) SELECT line, count(DISTINCT doc_id) AS pages FROM l WHERE trim(line) <> '' GROUP BY line HAVING count(DISTINCT doc_id) >= 3")
def e9(spark, sf_dir):
    """First lines that at least three pages share."""
    lines = load(spark, sf_dir, "documents").select("doc_id", F.get(F.split("text", "\n"), F.lit(0)).alias("line")).where(F.trim("line") != "")
    return lines.groupBy("line").agg(F.countDistinct("doc_id").alias("pages")).where("pages >= 3")


_NOTES = Table("ln int, line string", [(0, "intro"), (1, "10. SEGMENT REPORTING"), (2, "30 June 2026"), (3, "Retail 1,000 2,000 3,000"), (4, "30 June 2025"), (5, "Retail 900 - 900"), (6, "11. PROPERTY"), (7, "Land 5,000 5,000")])


_NOTED = f"""
    WITH l AS (SELECT *, last_value(TRY_CAST(nullif(regexp_extract(line, '^([0-9]{{1,2}})\\. +[A-Z ]{{4,}}$', 1), '') AS INTEGER) IGNORE NULLS) OVER (PARTITION BY company ORDER BY ln ROWS UNBOUNDED PRECEDING) AS note FROM {_NOTES.sql_across()})"""  # fmt: skip


@query("e10_note_blocks", _NOTED + " SELECT company, note, count(*) AS n_lines FROM l WHERE note IS NOT NULL GROUP BY company, note")
def e10(spark, sf_dir):
    """The last heading above is carried forward."""
    return A.noted(_NOTES.across(spark, sf_dir), _DOC).where("note is not null").groupBy("company", "note").agg(F.count("*").alias("n_lines"))


@query("e11_note_tables", each("note int, end date, caption string, values array<double>", [(10, "2026-06-30", "Retail", [1000.0, 2000.0, 3000.0]), (10, "2025-06-30", "Retail", [900.0, None, 900.0])]))
def e11(spark, sf_dir):
    return A.note_tables(_NOTES.across(spark, sf_dir), _DOC).select("company", "note", "end", "caption", "values")


_SHORT = Table("id int, values array<double>, width int", [(1, [-1222.0, -1222.0], 5), (2, [5.0, 9.0], 5), (3, [1.0, 2.0, 3.0, 4.0, 10.0], 5)])


@query("e11_right_align", f"""
    WITH t AS (SELECT *, abs("values"[-1] - list_sum("values"[:-2])) <= 0.02 * abs("values"[-1]) AS agrees FROM {_SHORT.sql_across(["values"])}),
    a AS (SELECT company, id, CASE WHEN len("values") = width THEN "values" WHEN agrees THEN list_concat(list_transform(range(width - len("values")), lambda i: CAST(NULL AS DOUBLE)), "values") END AS v FROM t)
    SELECT company, id, CASE WHEN v IS NOT NULL THEN '[' || array_to_string(list_transform(v, lambda x: CASE WHEN x IS NULL THEN 'null' ELSE printf('%.4f', x) END), '|') || ']' END AS "values" FROM a""")  # fmt: skip
def e11_align(spark, sf_dir):
    return _SHORT.across(spark, sf_dir, ["values"]).select("company", "id", A.right_align(F.col("values"), F.col("width")).alias("values"))


@query("e12_note_columns", "SELECT w, '[' || array_to_string(list_concat(list_transform(range(1, w), lambda i: 'segment ' || i), ['Total']), '|') || ']' AS headers FROM (SELECT DISTINCT CAST(p_size AS INTEGER) AS w FROM part)")
def e12(spark, sf_dir):
    """For as many columns as the parts have sizes."""
    return load(spark, sf_dir, "part").select(F.col("p_size").cast("int").alias("w")).distinct().select("w", A.note_columns(F.col("w")).alias("headers"))


_UNITS = Table("doc int, stmt int, page int, is_note boolean, units string", [(1, 1, 3, False, None), (1, 2, 5, False, "thousands"), (1, 3, 9, True, "millions"), (2, 1, 2, True, "units"), (3, 1, 2, False, None)])


@query("e13_document_units", f"""
    SELECT company, doc, arg_min(units, page + CASE WHEN is_note THEN 1000 ELSE 0 END) FILTER (units IS NOT NULL) AS units, count(DISTINCT units) > 1 AS disagree FROM {_UNITS.sql_across()} GROUP BY company, doc""")  # fmt: skip
def e13(spark, sf_dir):
    return A.document_units(_UNITS.across(spark, sf_dir), ["company", "doc"])


@query("e14_rounding_proof", "SELECT l_suppkey, count(*) >= 20 AND avg(CASE WHEN CAST(l_quantity AS BIGINT) % 5 = 0 THEN 1.0 ELSE 0.0 END) >= 0.25 AS rounded FROM lineitem GROUP BY l_suppkey")
def e14(spark, sf_dir):
    """Twenty figures or more, of which a share are multiples of the declared step: the figures are printed in full."""
    share = F.avg((F.pmod(F.col("l_quantity").cast("long"), F.lit(5)) == 0).cast("int"))
    return load(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(((F.count("*") >= 20) & (share >= 0.25)).alias("rounded"))


_DOCS = Table("doc string, readable int, units string", [("b.pdf", 3, "thousands"), ("a.pdf", 3, None), ("c.pdf", 4, "units")])
_STMTS = Table("doc string, stmt int, units string", [("a.pdf", 1, None), ("b.pdf", 1, None), ("c.pdf", 1, "millions")])


@query("e15_filing_merge", f"""
    WITH d AS (SELECT * FROM {_DOCS.sql_across()}), l AS (SELECT company, doc, row_number() OVER (PARTITION BY company ORDER BY readable DESC, doc DESC) = 1 AS lead FROM d)
    SELECT s.company, s.doc, s.stmt, coalesce(s.units, d.units) AS units, lead FROM {_STMTS.sql_across()} s JOIN d ON s.company = d.company AND s.doc = d.doc JOIN l ON s.company = l.company AND s.doc = l.doc""")  # fmt: skip
def e15(spark, sf_dir):
    return A.merge_filings(_DOCS.across(spark, sf_dir), _STMTS.across(spark, sf_dir), _DOC)


@query("e16_same_period", "SELECT o_custkey, count(DISTINCT year(o_orderdate)) = 1 AS same FROM orders GROUP BY o_custkey")
def e16(spark, sf_dir):
    return load(spark, sf_dir, "orders").groupBy("o_custkey").agg((F.countDistinct(F.year("o_orderdate")) == 1).alias("same"))


# --- verification -----------------------------------------------------------------------------------------

_READ = Table("row int, caption string, values array<double>", [(0, "Trade receivables", [35929.0, 100.0]), (1, "Inventories", [465.0, 200.0]), (2, "Cash", [1000.0, 300.0])])
_WITNESS = Table("ln int, line string", [(0, "Trade receivabies 36,929 100"), (1, "Inventories 466 200"), (2, "Cash 1,000 300")])


@query("i1_witness_match", each("row int, col int, confirmed boolean", [(0, 0, False), (0, 1, True), (1, 0, False), (1, 1, True), (2, 0, True), (2, 1, True)]))
def i1(spark, sf_dir):
    return V.witness(_READ.across(spark, sf_dir), _WITNESS.across(spark, sf_dir), _DOC).select("company", "row", "col", "confirmed")


_SUBTOTALS = Table("ord int, caption string, v double, best double", [(0, "Receivables", 35929.0, 36929.0), (1, "Inventories", 465.0, 466.0), (2, "Cash", 1000.0, 1000.0), (3, "", 38394.0, None), (4, "Land", 10.0, None), (5, "Plant", 20.0, None), (6, "", 30.0, None), (7, "Open", 1.0, None)])


@query("i2_subtotal_repair", f"""
    WITH b AS (SELECT *, coalesce(sum(CASE WHEN caption = '' THEN 1 ELSE 0 END) OVER (PARTITION BY company ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS block FROM {_SUBTOTALS.sql_across(["v", "best"])}),
    g AS (SELECT *, max(v) FILTER (caption = '') OVER o - sum(v) FILTER (caption <> '') OVER o AS gap FROM b WINDOW o AS (PARTITION BY company, block)),
    m AS (SELECT *, coalesce(abs(gap) > 0.5 AND caption <> '' AND abs(v + gap - best) <= 0.5, false) AS mends FROM g), n AS (SELECT *, count(*) FILTER (mends) OVER (PARTITION BY company, block) AS k FROM m)
    SELECT company, caption, CASE WHEN mends AND k = 1 THEN v + gap ELSE v END AS v, CASE WHEN mends AND k = 1 THEN 'corrected' WHEN gap IS NULL THEN 'open' WHEN abs(gap) <= 0.5 OR k = 1 THEN 'confirmed' ELSE 'unverified' END AS status FROM n WHERE caption <> ''""")  # fmt: skip
def i2(spark, sf_dir):
    """A block's uncaptioned subtotal confirms its lines; if it does not, the only single witness figure that mends the sum is taken."""
    return V.subtotals(_SUBTOTALS.across(spark, sf_dir, ["v", "best"]), _DOC).select("company", "caption", "v", "status")


_INCOME = Table("ord int, kind string, v double", [(0, "line", 7.0), (1, "subtotal", 100.0), (2, "subtotal", 60.0), (3, "line", 40.0), (4, "subtotal", 10.0), (5, "subtotal", 3.0), (6, "line", 8.0)])


@query("i3_income_less_expense", f"""
    WITH w AS (SELECT *, lag(v, 2) OVER o AS a, lag(v) OVER o AS b, lag(kind) OVER o = 'subtotal' AND lag(kind, 2) OVER o = 'subtotal' AS two FROM {_INCOME.sql_across(["v"])} WINDOW o AS (PARTITION BY company ORDER BY ord))
    SELECT company, ord, abs(a - b - v) <= 0.5 AS confirmed FROM w WHERE kind = 'line' AND two""")  # fmt: skip
def i3(spark, sf_dir):
    return V.income_less_expense(_INCOME.across(spark, sf_dir, ["v"]), _DOC)


_PROFITS = Table("ord int, caption string, v double", [(0, "Gross profit", 100.0), (1, "Selling", 20.0), (2, "Admin", 30.0), (3, "Operating profit", 50.0), (4, "Tax", 10.0), (5, "Profit for the year", 45.0), (6, "Other", 1.0)])


@query("i4_profit_chain", f"""
    WITH t AS (SELECT *, lower(caption) LIKE '%profit%' AS is_profit FROM {_PROFITS.sql_across(["v"])}), p AS (SELECT company, ord, v, lead(ord) OVER w AS q, lead(v) OVER w AS w FROM t WHERE is_profit WINDOW w AS (PARTITION BY company ORDER BY ord))
    SELECT p.company, p.ord AS p, p.q, abs(p.v - coalesce(sum(t.v), 0) - p.w) <= 0.5 AS holds FROM p LEFT JOIN t ON t.company = p.company AND t.ord > p.ord AND t.ord < p.q WHERE p.q IS NOT NULL GROUP BY p.company, p.ord, p.q, p.v, p.w""")  # fmt: skip
def i4(spark, sf_dir):
    return V.profit_chain(_PROFITS.across(spark, sf_dir, ["v"]), _DOC)


_ROWS_READ = Table("row int, caption string, values array<double>, digits int", [(0, "Costo de ventas y servicios", [-99333931.0], 9), (1, "Otros ingresos", [5.0], 1)])
_PRINTED = Table("line string, v double, n int", [("Costo de ventas y servicios (909.333.911)", -909333911.0, 9), ("Otros ingresos a", 6.0, 1), ("Otros ingresos b", 7.0, 1)])


@query("i5_printed_line_repair", f"""
    WITH h AS (SELECT r.company, r."row", count(p.line) AS k, max(p.v) AS v FROM {_ROWS_READ.sql_across(["values"])} r LEFT JOIN {_PRINTED.sql_across(["v"])} p ON r.company = p.company AND starts_with(lower(p.line), lower(r.caption)) GROUP BY r.company, r."row")
    SELECT r.company, r."row", '[' || printf('%.4f', CASE WHEN k = 1 THEN v ELSE r."values"[1] END) || ']' AS "values" FROM {_ROWS_READ.sql_across(["values"])} r JOIN h ON r.company = h.company AND r."row" = h."row" """)  # fmt: skip
def i5(spark, sf_dir):
    return V.printed_line(_ROWS_READ.across(spark, sf_dir, ["values"]), _PRINTED.across(spark, sf_dir, ["v"]).drop("n"), _DOC).select("company", "row", "values")


_SIGNS = Table("id int, values array<double>, printed array<double>", [(1, [5.0, 6.0], [-5.0, 6.0]), (2, [5.0, 6.0], [-5.0, 7.0])])


@query("i6_sign_restoration", f"""
    SELECT company, id, '[' || array_to_string(list_transform(CASE WHEN list_transform("values", lambda x: abs(x)) = list_transform(printed, lambda x: abs(x)) THEN printed ELSE "values" END, lambda x: printf('%.4f', x)), '|') || ']' AS "values" FROM {_SIGNS.sql_across(["values"])}""")  # fmt: skip
def i6(spark, sf_dir):
    """Only companies whose figures aren't scaled agree with what is printed."""
    return _SIGNS.across(spark, sf_dir, ["values"]).select("company", "id", V.restore_signs(F.col("values"), F.col("printed")).alias("values"))


@query("i7_repair_acceptance", expected("line string, used string", [("Land 9 15,780 2 31,694 1,147,474", "Land 915,780 231,694 1,147,474"), ("Land 1 2,000 3 4,000 99,999", "Land 1 2,000 3 4,000 99,999")]))
def i7(spark, sf_dir):
    """A rejoined line is used only if its parts then add up to its total."""
    t = Table("line string", [("Land 9 15,780 2 31,694 1,147,474",), ("Land 1 2,000 3 4,000 99,999",)]).df(spark)
    fixed = T.rejoin_severed(F.col("line"))
    v = T.figures(fixed)
    parts = F.aggregate(F.slice(v, F.lit(1), F.size(v) - 1), F.lit(0.0), lambda a, x: a + x)
    return t.select("line", F.when((F.size(v) >= 3) & (F.abs(F.element_at(v, -1) - parts) <= 0.02 * F.abs(F.element_at(v, -1))), fixed).otherwise(F.col("line")).alias("used"))


@query("i8_scanned_tables", "SELECT doc_id FROM documents WHERE n_chars > 9000 AND len(regexp_extract_all(text, '[#*$%&]')) >= 100")
def i8(spark, sf_dir):
    """Pages with a large picture and a hundred figures (here: long texts with a hundred symbols) are tables that were scanned."""
    return load(spark, sf_dir, "documents").where((F.col("n_chars") > 9000) & (F.regexp_count("text", F.lit("[#*$%&]")) >= 100)).select("doc_id")
