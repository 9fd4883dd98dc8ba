"""Queries on sources (group A)."""

from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import files, packages, pages, tables, workbook
from .registry import Table, each, expected, load, query

_PATHS = Table("path string, reader string", [("a/x.ZIP", None), ("a/y.xlsx", None), ("a/z.pdf", None), ("a/z.pdf", "rules"), ("a/t.json", None)])


@query("a1_dispatch", expected("path string, reader string, kind string", [("a/x.ZIP", None, "package"), ("a/y.xlsx", None, "workbook"), ("a/z.pdf", None, "vision"), ("a/z.pdf", "rules", "text"), ("a/t.json", None, "tables")]))
def a1(spark, sf_dir):
    return _PATHS.df(spark).select("path", "reader", files.kind_of(F.col("path"), F.col("reader")).alias("kind"))


@query("a2_page_lines", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ln FROM documents) SELECT doc_id, count(*) AS n_lines, CAST(count(CASE WHEN trim(line) = '' THEN 1 END) AS BIGINT) AS n_blank, max(ln) AS last_ln FROM l GROUP BY doc_id")
def a2(spark, sf_dir):
    """Page texts to numbered lines, which the statement operators read."""
    lines = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(F.trim("line") == "").alias("n_blank"), F.max("ln").cast("long").alias("last_ln"))


_FILED = Table("page int, text string", [
    (1, "Annual report\nA few words about the year"),
    (2, "Consolidated statement of income\nSAR '000\nThree months ended\n30 June 2026 30 June 2025\nRevenue 10,000 9,000\nCost of sales and\nservices rendered (5,000) (4,000)\nOther 1,200 1,100"),
    (3, "Three months ended\n30 June 2026 30 June 2025\nTax (1,000) (900)\nZakat (1,500) (1,400)\nProfit 3,700 3,800"),
    (4, "Balance sheet\n30 June 2026 31 December 2025\nCash 1,000 2,000\nLand 5,000 5,000\nTotal 6,000 7,000"),
])


@query("a2_rule_reader", each("head int, pages array<int>, title string, kind string, units string, currency string, months array<int>, ends array<string>, captions array<string>", [
    (2, [2, 3], "Consolidated statement of income", "income_statement", "thousands", "SAR", [3, 3], ["2026-06-30", "2025-06-30"], ["Revenue", "Cost of sales and services rendered", "Other", "Tax", "Zakat", "Profit"]),
    (4, [4], "Balance sheet", "balance_sheet", None, None, [None, None], ["2026-06-30", "2025-12-31"], ["Cash", "Land", "Total"]),
]))
def a2_reader(spark, sf_dir):
    """Page texts to statements over their pages, with columns and rows, for all filings in one plan."""
    found = pages.statements(_FILED.across(spark, sf_dir), ["company"])
    of = lambda c, f: F.transform("columns", lambda x: x[f].cast(c))
    return found.select("company", "head", "pages", "title", "kind", "units", "currency", of("int", "months").alias("months"), of("string", "end").alias("ends"), F.transform("rows", lambda r: r["caption"]).alias("captions"))


@query("a2_reader_issues", "SELECT s_suppkey AS company, 'units_unknown' AS code FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT s_suppkey, 'no_statements' FROM supplier WHERE s_suppkey % 3 = 0")
def a2_issues(spark, sf_dir):
    """Filings of every third company have their first page only."""
    filed = _FILED.across(spark, sf_dir).where("company % 3 <> 0 or page = 1")
    return pages.issues(pages.statements(filed, ["company"]), filed, ["company"])


@query("a6_transcription_hook", "SELECT doc_id, CASE WHEN starts_with(text, 'A') THEN 0 ELSE coalesce(length(text), 0) END AS n, coalesce(starts_with(text, 'A'), false) AS failed FROM documents")
def a6(spark, sf_dir):
    """Images (here: the bytes of texts) through a plugged-in reader, which fails on some: those have an empty text."""

    def reader(image: bytes) -> str:
        if image.startswith(b"A"):
            raise ValueError("not legible")
        return image.decode("utf-8")

    images = load(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("image"))
    return pages.transcribe(images, reader).select("doc_id", F.length("text").cast("long").alias("n"), "failed")


_JSON = json.dumps({"pages": {"3": {"tables": [{"title": "Income statement", "units": "SAR '000", "columns": ["Three months ended 30 June 2026", "30 June 2025"], "rows": [{"caption": "Revenue", "values": ["1,250", "999,999"]}, {"caption": "Costs", "values": ["(900)", None]}]}]}, "4": {"tables": [{"title": "Balance", "units": None, "columns": ["30 June 2026"], "rows": [{"caption": "Caja", "values": ["1.512.033.764"]}, {"caption": "Otros", "values": ["748.160"]}]}]}}})
_READS = Table("path string, json string", [("f.pdf", _JSON)])


@query("a7_vision_tables", expected("page int, ord int, title string, kind string, units string", [(3, 0, "Income statement", "income_statement", "thousands"), (4, 0, "Balance", "other", None)]))
def a7(spark, sf_dir):
    return tables.tables(_READS.df(spark)).select("page", "ord", "title", "kind", "units")


@query("a8_table_statements", expected("page int, row int, col int, caption string, value double, printed boolean", [(3, 0, 0, "Revenue", 1250.0, True), (3, 0, 1, "Revenue", 999999.0, False), (3, 1, 0, "Costs", -900.0, True), (3, 1, 1, "Costs", None, True), (4, 0, 0, "Caja", 1512033764.0, True), (4, 1, 0, "Otros", 748160.0, True)]))
def a8(spark, sf_dir):
    """Cells, each checked against the figures that the page's text prints."""
    printed = Table("path string, page int, figure double", [("f.pdf", 3, 1250.0), ("f.pdf", 3, 900.0), ("f.pdf", 4, 1512033764.0), ("f.pdf", 4, 748160.0)]).df(spark)
    return tables.unverified(tables.cells(tables.tables(_READS.df(spark))), printed).select("page", "row", "col", "caption", "value", "printed")


@query("a8_table_columns", expected("page int, col int, months int, end date", [(3, 0, 3, "2026-06-30"), (3, 1, None, "2025-06-30"), (4, 0, None, "2026-06-30")]))
def a8_columns(spark, sf_dir):
    return tables.period_columns(tables.tables(_READS.df(spark))).select("page", "col", "months", "end")


def _zip(members: dict[str, str]) -> bytearray:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(name, body)
    return bytearray(out.getvalue())


def _package(spark):
    label = lambda es, en=None: {"Etiquetas": ({"es": {"r": {"Valor": es}}} if es else {}) | ({"en": {"r": {"Valor": en}}} if en else {}), "Nombre": "n"}
    names = [f"L{i}" for i in range(8)]
    span = lambda a, b: {"Periodo": {"FechaInicio": f"{a}T00:00:00Z", "FechaFin": f"{b}T00:00:00Z"}}
    fact = lambda c, k, v, u="money": {"IdConcepto": c, "IdContexto": k, "ValorNumerico": v, "IdUnidad": u}
    data = {
        "Taxonomia": {
            "ConceptosPorId": {"Inv": label("Inventarios"), "Cust": label(None, "Customers"), "Cash": label("Efectivo"), "Eps": label("Utilidad")} | {n: label(n) for n in names},
            "RolesPresentacion": [
                {"Nombre": "Comentarios", "Estructuras": [{"IdConcepto": "Inv"}]},
                {"Nombre": "[520000] Flujos", "Estructuras": [{"IdConcepto": "Top", "SubEstructuras": [{"IdConcepto": "Inv"}, {"IdConcepto": "Cust"}, {"IdConcepto": "Eps"}]}]},
                {"Nombre": "[210000] Posición", "Estructuras": [{"IdConcepto": "Cash"}]},
                {"Nombre": "[310000] Resultado", "Estructuras": [{"IdConcepto": n} for n in names]},
            ],
        },
        "UnidadesPorId": {"money": {"Medidas": [{"EspacioNombres": "http://www.xbrl.org/2003/iso4217"}]}, "shares": {"Medidas": [{"EspacioNombres": "x"}]}},
        "ContextosPorId": {"ytd": span("2026-01-01", "2026-06-30"), "prior": span("2025-01-01", "2025-06-30"), "q": span("2026-04-01", "2026-06-30"), "end": {"Periodo": {"FechaInstante": "2026-06-30T00:00:00Z"}}, "dim": span("2026-01-01", "2026-06-30") | {"ContieneInformacionDimensional": True}},
        "HechosPorId": {str(i): f for i, f in enumerate([fact("Inv", "ytd", -19432000.0), fact("Inv", "prior", 280596000.0), fact("Cust", "ytd", -380505000.0), fact("Cust", "dim", 999.0), fact("Eps", "ytd", 0.39, "shares"), fact("Cash", "end", 29651600000.0), fact("Inv", "ytd", 1.0), *[fact(n, "ytd", float(i)) for i, n in enumerate(names)], fact("L0", "q", 99.0)])},
    }
    return spark.createDataFrame([("p.zip", _zip({"report.json": json.dumps(data)}))], "path string, content binary")


@query("a9_package_statements", expected("role string, row int, caption string, values array<double>", [("[520000] Flujos", 0, "Inventarios", [-19432000.0, 280596000.0]), ("[520000] Flujos", 1, "Customers", [-380505000.0, None]), ("[210000] Posición", 0, "Efectivo", [29651600000.0]), *[("[310000] Resultado", i, f"L{i}", [float(i)]) for i in range(8)]]))
def a9(spark, sf_dir):
    return packages.statements(_package(spark)).select("role", "row", "caption", "values")


@query("a10_package_facts", expected("concept string, end date, months int, value double", [("Inv", "2026-06-30", 6, -19432000.0), ("Inv", "2025-06-30", 6, 280596000.0), ("Cust", "2026-06-30", 6, -380505000.0), ("Cash", "2026-06-30", None, 29651600000.0), *[(f"L{i}", "2026-06-30", 6, float(i)) for i in range(8)], ("L0", "2026-06-30", 3, 99.0)]))
def a10(spark, sf_dir):
    """Monetary facts without dimensions; the first of equal ones."""
    return packages.facts(_package(spark)).select("concept", "end", "months", "value")


@query("a11_sparse_periods", expected("role string, col int, end date, months int", [("[520000] Flujos", 0, "2026-06-30", 6), ("[520000] Flujos", 1, "2025-06-30", 6), ("[210000] Posición", 0, "2026-06-30", None), ("[310000] Resultado", 0, "2026-06-30", 6)]))
def a11(spark, sf_dir):
    """A period that less than half of the fullest one's lines report is no column (A12: newest first, then longest)."""
    f = _package(spark)
    return packages.period_columns(packages.presentation(f).join(packages.facts(f), ["path", "concept"])).select("role", "col", "end", "months")


@query("a11_sparse_periods_orders", """
    WITH n AS (SELECT o_custkey, last_day(CAST(o_orderdate AS DATE)) AS "end", count(*) AS n FROM orders GROUP BY ALL), m AS (SELECT *, max(n) OVER (PARTITION BY o_custkey) AS most FROM n)
    SELECT o_custkey, "end", row_number() OVER (PARTITION BY o_custkey ORDER BY "end" DESC) - 1 AS col FROM m WHERE n * 2 >= most""")  # fmt: skip
def a11_orders(spark, sf_dir):
    cells = load(spark, sf_dir, "orders").select(F.lit("o").alias("path"), F.col("o_custkey").alias("role"), F.last_day("o_orderdate").alias("end"), F.lit(1).alias("months"))
    return packages.period_columns(cells).select(F.col("role").alias("o_custkey"), "end", F.col("col").cast("long").alias("col"))


def _book(spark):
    c = lambda r, v, t="": f'<c r="{r}"{t}>{v}</c>'
    text = lambda r, s: c(r, f"<is><t>{s}</t></is>", ' t="inlineStr"')
    num = lambda r, v: c(r, f"<v>{v}</v>")
    rows = [
        text("A1", "Consolidated Statement of Income"), text("C2", "US Dollar"), text("B3", "Note"), text("C3", "2026"), text("D3", "2025"), text("A4", "Rights to receive"), text("A5", "reimbursement"), num("B5", 4), num("C5", 100), num("D5", 90),
        text("A6", "Revenue"), num("B6", 5), num("C6", 7), c("D6", "<f>C6-1</f><v>6</v>", ' s="1"'), text("A7", "Typed"), c("C7", "<f>1+2</f>"),
    ]
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    by_row: dict[str, list[str]] = {}
    import re

    for x in rows:
        by_row.setdefault(re.search(r'r="[A-Z]+(\d+)"', x)[1], []).append(x)
    sheet = f'<worksheet {ns}><sheetData>{"".join(f"<row r=\"{r}\">{"".join(cs)}</row>" for r, cs in by_row.items())}</sheetData><mergeCells><mergeCell ref="C2:D2"/></mergeCells></worksheet>'
    members = {
        "xl/workbook.xml": f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="IS" sheetId="1" r:id="rId1"/><sheet name="Old" sheetId="2" state="hidden" r:id="rId2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="worksheets/sheet2.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet {ns}><fonts><font/><font><color rgb="FF0000FF"/></font></fonts><cellXfs><xf fontId="0"/><xf fontId="1"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": sheet,
        "xl/worksheets/sheet2.xml": f"<worksheet {ns}><sheetData/></worksheet>",
    }
    return spark.createDataFrame([("b.xlsx", _zip(members))], "path string, content binary")


@query("a13_workbook_cells", expected("row int, col int, text string, value double, formula string, rgb string", [(1, 1, "Consolidated Statement of Income", None, None, None), (2, 3, "US Dollar", None, None, None), (3, 2, "Note", None, None, None), (3, 3, "2026", None, None, None), (3, 4, "2025", None, None, None), (4, 1, "Rights to receive", None, None, None), (5, 1, "reimbursement", None, None, None), (5, 2, None, 4.0, None, None), (5, 3, None, 100.0, None, None), (5, 4, None, 90.0, None, None), (6, 1, "Revenue", None, None, None), (6, 2, None, 5.0, None, None), (6, 3, None, 7.0, None, None), (6, 4, None, 6.0, "=C6-1", "0000FF"), (7, 1, "Typed", None, None, None), (7, 3, None, None, "=1+2", None)]))
def a13(spark, sf_dir):
    """Visible sheets as cells, with formulas beside their cached values."""
    return workbook.cells(_book(spark)).select("row", "col", "text", "value", "formula", "rgb")


@query("a14_merged_headers", expected("row int, col int, text string", [(2, 3, "US Dollar"), (2, 4, "US Dollar")]))
def a14(spark, sf_dir):
    b = _book(spark)
    return workbook.expand_merged(workbook.cells(b), workbook.merged(b)).where("row = 2").select("row", "col", "text")


@query("a15_workbook_columns", expected("col int, header string, end date, months int", [(3, "US Dollar 2026", "2026-06-30", 3), (4, "US Dollar 2025", "2025-06-30", 3)]))
def a15(spark, sf_dir):
    """A column's stacked header; a bare year takes its month and span from the title."""
    from ..functions.periods import month_end, parse_header

    b = _book(spark)
    all_ = workbook.expand_merged(workbook.cells(b), workbook.merged(b))
    heads = workbook.header_parts(all_, 4).join(workbook.value_columns(all_), ["path", "sheet", "col"])
    title = parse_header(F.lit("For the three months ended 30 June 2026"))
    year = F.regexp_extract("header", r"\b((?:19|20)\d{2})\b", 1).try_cast("int")
    return heads.select("col", "header", month_end(year, F.month(title["end"])).alias("end"), title["months"].alias("months"))


@query("a16_workbook_statement", expected("row int, caption string, c3 double, c4 double", [(5, "Rights to receive reimbursement", 100.0, 90.0), (6, "Revenue", 7.0, 6.0), (7, "Typed", 3.0, None)]))
def a16(spark, sf_dir):
    """Figures of the value columns by row; wrapped captions joined; typed arithmetic evaluated."""
    c = workbook.cells(_book(spark)).withColumn("shown", workbook.shown(F.col("value"), F.col("formula")))
    per = c.where("row >= 4").groupBy("path", "sheet", "row").agg(F.max(F.when(F.col("col") == 1, F.col("text"))).alias("caption"), F.max(F.when(F.col("col") == 3, F.col("shown"))).alias("c3"), F.max(F.when(F.col("col") == 4, F.col("shown"))).alias("c4"))
    return workbook.wrapped_captions(per.withColumn("has_values", F.col("c3").isNotNull() | F.col("c4").isNotNull()), ["path", "sheet"]).select("row", "caption", "c3", "c4")


@query("a17_filing_or_model", expected("path string, filing boolean", [("b.xlsx", True)]))
def a17(spark, sf_dir):
    return workbook.is_filing(workbook.cells(_book(spark)))


@query("a18_supplements", expected("source string, caption string", [("read", "Revenue"), ("read", "Costs"), ("supplement", "Capex")]))
def a18(spark, sf_dir):
    """Tables that a person transcribed, read by the same builder and marked as such."""
    extra = Table("path string, json string", [("f.json", json.dumps({"pages": {"1": {"tables": [{"title": "T", "columns": ["2026"], "rows": [{"caption": "Capex", "values": ["5"]}]}]}}}))]).df(spark)
    read = tables.cells(tables.tables(_READS.df(spark))).where("page = 3 and col = 0").withColumn("source", F.lit("read"))
    return read.unionByName(tables.cells(tables.tables(extra)).withColumn("source", F.lit("supplement"))).select("source", "caption")


@query("a20_point_reads", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT o_orderkey, 1 FROM orders WHERE o_orderpriority = '1-URGENT')")
def a20(spark, sf_dir):
    """All points that a run needs, in one semi-join."""
    wanted = load(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"))
    return load(spark, sf_dir, "lineitem").join(wanted, ["l_orderkey", "l_linenumber"], "left_semi").select("l_orderkey", "l_linenumber", "l_quantity")


_MAPPING_JSON = json.dumps({"mapping_version": "2.0", "company": "x", "sheet": "M", "future": 1, "rows": [{"label": "Revenue", "section": "income_statement", "pdf": "Revenue", "statement": "title:[310000]"}, {"label": "SGA", "section": "income_statement", "pdf": ["-Selling", "-Admin"], "scale": "percent"}, {"label": "None", "section": "cash_flow", "pdf": None, "occurrence": 2, "scale": 0.001}]})


@query("a21_mapping_load", expected("ord int, label string, pdf array<string>, pdf_kind string, scale double, occurrence int", [(0, "Revenue", ["Revenue"], "caption", None, 1), (1, "SGA", ["-Selling", "-Admin"], "list", 0.01, 1), (2, "None", None, "none", 0.001, 2)]))
def a21(spark, sf_dir):
    """The union-typed caption field as an array; unknown keys are ignored."""
    return tables.mapping_rows(Table("json string", [(_MAPPING_JSON,)]).df(spark)).select("ord", "label", "pdf", "pdf_kind", "scale", "occurrence")


@query("a22_cache_read", "SELECT doc_id, CASE WHEN count(*) OVER (PARTITION BY sha256(text)) > 1 THEN CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY sha256(text)) THEN 'read' ELSE 'reuse' END ELSE 'read' END AS action FROM documents")
def a22(spark, sf_dir):
    """Content that was read before is not read again: later copies reuse what the first one gave."""
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("sha"))
    first = docs.groupBy("sha").agg(F.min("path").alias("first"))
    cached = docs.join(first, "sha").where("path > first").select("sha", F.lit(files.PARSER_VERSION).alias("version"), "path")
    todo = files.work_list(docs.join(cached.select("path"), "path", "left_semi"), cached.select("sha", "version"))
    new = docs.join(cached.select("path"), "path", "left_anti").select("path", "sha", F.lit("read").alias("action"))
    return todo.unionByName(new).select(F.col("path").alias("doc_id"), "action")


@query("a23_company_files", expected("company string, model string, error string", [("acme", "in/acme/Model v2.xlsx", None), ("beta", None, "no model"), ("gama", None, "models: in/gama/a model.xlsx, in/gama/model.xlsx")]))
def a23(spark, sf_dir):
    return files.company_models(Table("path string", [("in/acme/Model v2.xlsx",), ("in/acme/q2.pdf",), ("in/beta/q2.pdf",), ("in/gama/model.xlsx",), ("in/gama/a model.xlsx",)]).df(spark))


@query("a24_json_round_trip", "SELECT event_id, user_id, value FROM events")
def a24(spark, sf_dir):
    """Typed rows to JSON and back by an explicit schema; fields that are missing come back as null."""
    raw = load(spark, sf_dir, "events").select(F.to_json(F.struct("event_id", "user_id", "value", F.lit(1).alias("unknown"))).alias("j"))
    return raw.select(F.from_json("j", "event_id long, user_id long, value double, missing string").alias("e")).select("e.event_id", "e.user_id", "e.value")


@query("a25_period_kinds", expected("concept string, kind string, months int", [("Inv", "period", 6), ("Cash", "point_in_time", None)]))
def a25(spark, sf_dir):
    f = packages.facts(_package(spark)).where("concept in ('Inv', 'Cash')").select("concept", F.when(F.col("months").isNull(), "point_in_time").otherwise("period").alias("kind"), "months")
    return f.distinct()


@query("a28_archived_uploads", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 AS current FROM orders")
def a28(spark, sf_dir):
    """The newest upload of a company is current; the ones before it are the past."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.row_number().over(w) == 1).alias("current"))
