"""Queries on word boxes (group D)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import geometry as G
from ..operators.lookup import nearest_band, slots
from .registry import Table, expected, load, query

#: A page: a band line over a label line, then three body lines and prose.
_WORDS = Table("page int, text string, x0 double, x1 double, top double", [
    (1, "YTD", 150.0, 260.0, 10.0), (1, "2Q26", 155.0, 180.0, 22.0), (1, "2Q25", 225.0, 250.0, 22.4),
    (1, "Net", 10.0, 25.0, 40.0), (1, "sales", 27.0, 50.0, 40.5), (1, "1,250", 150.0, 180.0, 40.0), (1, "1,100", 220.0, 250.0, 40.0), (1, "14", 285.0, 295.0, 40.0), (1, "bp", 297.0, 305.0, 40.0),
    (1, "-", 10.0, 12.0, 55.0), (1, "Costs", 14.0, 40.0, 55.0), (1, "(900)", 152.0, 182.0, 55.0), (1, "-", 240.0, 244.0, 55.0),
    (1, "EBITDA", 10.0, 50.0, 70.0), (1, "350", 160.0, 180.0, 70.0), (1, "300", 230.0, 250.0, 70.0), (1, "(3)", 288.0, 303.0, 70.0),
    (1, "see", 155.0, 175.0, 85.0), (1, "the", 178.0, 190.0, 85.0), (1, "notes", 200.0, 240.0, 85.0),
])


def _lined(spark):
    return G.lines(_WORDS.df(spark))


@query("d1_lines", expected("line int, n long", [(0, 1), (1, 2), (2, 6), (3, 4), (4, 4), (5, 3)]))
def d1(spark, sf_dir):
    return _lined(spark).groupBy("line").agg(F.count("*").alias("n"))


@query("d2_fragments", expected("line int, frag int, text string", [(2, 0, "Net sales"), (2, 1, "1,250"), (2, 2, "1,100"), (2, 3, "14 bp"), (5, 0, "see the"), (5, 1, "notes")]))
def d2(spark, sf_dir):
    return G.fragments(_lined(spark)).where("line in (2, 5)").select("line", "frag", "text")


@query("d3_cells", expected("line int, caption string, text string", [(2, "Net sales", "1,250"), (2, "Net sales", "1,100"), (2, "Net sales", "14 bp"), (3, "- Costs", "(900)"), (3, "- Costs", "-"), (4, "EBITDA", "350"), (4, "EBITDA", "300"), (4, "EBITDA", "(3)")]))
def d3(spark, sf_dir):
    return G.cells(_lined(spark)).select("line", "caption", "text")


@query("d4_columns", expected("col int, left double, right double, n long, collides boolean", [(0, 150.0, 182.0, 3, False), (1, 220.0, 250.0, 3, False), (2, 285.0, 305.0, 2, False)]))
def d4(spark, sf_dir):
    return G.columns(G.cells(_lined(spark))).groupBy("col", "left", "right", "collides").agg(F.count("*").alias("n"))


@query("d4_interval_merge_lineitem", """
    WITH s AS (SELECT l_suppkey, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS x0, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS INTEGER) AS x1 FROM lineitem),
    o AS (SELECT *, max(x1) OVER (PARTITION BY l_suppkey ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
    i AS (SELECT *, sum(CASE WHEN reach IS NULL OR x0 > reach THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS island FROM o)
    SELECT l_suppkey, count(DISTINCT island) AS islands, max(x1) AS last FROM i GROUP BY l_suppkey""")  # fmt: skip
def d4_lines(spark, sf_dir):
    """The interval merge at scale: shipments as day ranges, merged for each supplier."""
    x0 = F.datediff("l_shipdate", F.lit("1992-01-01").cast("date"))
    spans = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), F.lit(0).alias("line"), x0.alias("x0"), (x0 + F.col("l_quantity").cast("int")).alias("x1"))
    merged = G.columns(spans)
    return merged.groupBy(F.col("page").alias("l_suppkey")).agg((F.max("col") + 1).cast("long").alias("islands"), F.max("x1").cast("long").alias("last"))


@query("d5_body", expected("page int, start int, stop int", [(1, 2, 5)]))
def d5(spark, sf_dir):
    return G.body(_lined(spark))


@query("d6_headers", expected("text string, col int", [("YTD", 0), ("YTD", 1), ("2Q26", 0), ("2Q25", 1)]))
def d6(spark, sf_dir):
    frags = G.fragments(_lined(spark)).where("line < 2").select("page", "text", "x0", "x1", F.struct("line", "frag").alias("frag"))
    ranges = G.columns(G.cells(_lined(spark))).select("page", "col", "left", "right").distinct()
    return G.assign(frags, ranges, 30.0).join(frags.select("frag", "text"), "frag").select("text", "col")


_BANDS = Table("page int, band string, x double", [(1, "QoQ", 120.0), (1, "YTD", 300.0), (2, "Other", 100.0)])
_LABELS = Table("page int, label string, c double", [(1, "2Q26", 90.0), (1, "2Q25", 150.0), (1, "6M26", 270.0), (1, "6M25", 330.0), (2, "2Q26", 300.0)])


@query("d7_bands", f"""
    SELECT l.company, l.page, label, arg_min(band, abs(x - c)) AS band FROM {_LABELS.sql_across()} l JOIN {_BANDS.sql_across()} b ON l.company = b.company AND l.page = b.page GROUP BY l.company, l.page, label""")
def d7(spark, sf_dir):
    """Band labels over a tier of labels: each column takes the nearest band's centre."""
    return nearest_band(_LABELS.across(spark, sf_dir), _BANDS.across(spark, sf_dir), ["company", "page"])


@query("d8_table_layout", expected("caption string, cells array<string>", [("Net sales", ["1,250", "1,100", "14 bp"]), ("- Costs", ["(900)", "-", None]), ("EBITDA", ["350", "300", "(3)"])]))
def d8(spark, sf_dir):
    """Lines by columns: a blank cell keeps its column."""
    return G.layout(G.columns(G.cells(_lined(spark)))).select("caption", "cells")


_LAYOUT_ROWS = Table("line int, cells array<double>", [(1, [5.0, None, 7.0]), (2, [1.0, 2.0, 3.0]), (3, [8.0, None, 9.0]), (4, [None, 8.0, 9.0])])
_SHORT_ROWS = Table("id int, values array<double>", [(1, [5.0, 7.0]), (2, [8.0, 9.0]), (3, [4.0])])


@query("d9_slot_by_position", f"""
    WITH h AS (SELECT s.company, s.id, count(l.line) AS n, any_value(cells) AS cells FROM {_SHORT_ROWS.sql_across(["values"])} s LEFT JOIN {_LAYOUT_ROWS.sql_across(["cells"])} l ON s.company = l.company AND list_filter(cells, lambda x: x IS NOT NULL) = "values" GROUP BY s.company, s.id)
    SELECT company, id, CASE WHEN n = 1 THEN '[' || array_to_string(list_transform(cells, lambda x: CASE WHEN x IS NULL THEN 'null' ELSE printf('%.4f', x) END), '|') || ']' END AS slots FROM h""")  # fmt: skip
def d9(spark, sf_dir):
    return slots(_SHORT_ROWS.across(spark, sf_dir, ["values"]), _LAYOUT_ROWS.across(spark, sf_dir, ["cells"]), ["company"])


@query("d10_alignment", "SELECT conv_id, CAST(count(CASE WHEN len(string_split(text, ' ')) >= 8 THEN 1 END) AS DOUBLE) / count(*) < 0.5 AS misaligned FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def d10(spark, sf_dir):
    """The share of rows that have all columns; less than half is an error."""
    t = load(spark, sf_dir, "conversations").where("text is not null")
    return t.groupBy("conv_id").agg((F.count_if(F.size(F.split("text", " ")) >= 8) / F.count("*") < 0.5).alias("misaligned"))


# --- pages of many filings ---------------------------------------------------------------------------------

# A customer is a filing and each order a page: a line of headers, then a line for each item with two amounts and, but for every fourth, a figure in one of four forms, some with a unit after it.
_PAPERS = """
    p AS (SELECT o_orderkey, o_custkey AS doc, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS page FROM orders),
    l AS (SELECT doc, page, CAST(row_number() OVER (PARTITION BY doc, page ORDER BY l_linenumber, l_partkey, l_extendedprice) AS INTEGER) AS line, CAST(round(l_extendedprice * 100) AS BIGINT) AS a, CAST(l_quantity AS BIGINT) + 1000 AS b, CAST(l_quantity AS BIGINT) AS q FROM lineitem JOIN p ON l_orderkey = o_orderkey),
    t AS (SELECT doc, page, line, 'Item ' || chr(CAST(96 + line AS INTEGER)) AS caption, format('{:,}', a) AS a, '(' || format('{:,}', b) || ')' AS b,
        CASE line % 4 WHEN 1 THEN '$' || q || ',000' WHEN 2 THEN '($' || q || '.2)' WHEN 3 THEN '.' || q END AS c, line % 4 = 3 AS unit FROM l)"""


def papers(spark, sf_dir):
    """words(doc, page, text, x0, x1, top) of all pages."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("doc"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("page"))
    i = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.col("l_quantity").cast("long").alias("q"))
    line = F.row_number().over(Window.partitionBy("doc", "page").orderBy("l_linenumber", "l_partkey", "l_extendedprice"))
    i = i.join(o, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("line", line)
    q, top = F.col("q").cast("string"), 22.0 + 15.0 * F.col("line")
    c = F.when(F.col("line") % 4 == 1, F.concat(F.lit("$"), q, F.lit(",000"))).when(F.col("line") % 4 == 2, F.concat(F.lit("($"), q, F.lit(".2)"))).when(F.col("line") % 4 == 3, F.concat(F.lit("."), q))
    word = lambda text, x0, x1, y: F.struct(text.alias("text"), x0.cast("double").alias("x0"), x1.cast("double").alias("x1"), y.cast("double").alias("top"))
    right = lambda text, x, y: word(text, x - 4.0 * F.length(text), F.lit(x), y)
    left = lambda text, x0, x1, y: word(text, F.lit(x0), F.lit(x1), y)
    unit, first = F.col("line") % 4 == 3, F.col("line") == 1
    words = F.array(
        # The headers come with their page's first line: lines were sent to their page to be numbered, and words stay there.
        F.when(first, left(F.lit("2Q26"), 160, 180, F.lit(22.0))), F.when(first, left(F.lit("2Q25"), 230, 250, F.lit(22.4))),
        left(F.lit("Item"), 10, 30, top), left(F.char(96 + F.col("line")), 32, 38, top + 0.5), right(F.col("a"), 180, top), right(F.col("b"), 250, top + 0.5), F.when(F.col("c").isNotNull(), right(F.col("c"), 320, top)), F.when(unit, left(F.lit("x"), 322, 327, top)),
    )
    a, b = F.format_number(F.round(F.col("l_extendedprice") * 100).cast("long"), 0), F.concat(F.lit("("), F.format_number(F.col("q") + 1000, 0), F.lit(")"))
    i = i.select("doc", "page", "line", a.alias("a"), b.alias("b"), c.alias("c"))
    return i.select("doc", "page", F.inline(words)).where("text is not null")


_KEYS = ["doc", "page"]


@query("d1_lines_facts", f"WITH {_PAPERS} SELECT doc, page, line, CAST(4 + CASE WHEN c IS NULL THEN 0 WHEN unit THEN 2 ELSE 1 END AS BIGINT) AS n FROM t UNION ALL SELECT DISTINCT doc, page, 0, 2 FROM t")
def d1_facts(spark, sf_dir):
    return G.lines(papers(spark, sf_dir), _KEYS).groupBy("doc", "page", "line").agg(F.count("*").alias("n"))


@query("d2_fragments_facts", f"WITH {_PAPERS} SELECT doc, page, line, CAST(i AS INTEGER) AS frag, CASE i WHEN 0 THEN caption WHEN 1 THEN a WHEN 2 THEN b ELSE c || CASE WHEN unit THEN ' x' ELSE '' END END AS text FROM t, (SELECT unnest([0, 1, 2, 3]) AS i) WHERE i < 3 OR c IS NOT NULL")
def d2_facts(spark, sf_dir):
    return G.fragments(G.lines(papers(spark, sf_dir), _KEYS), keys=_KEYS).where("line > 0").select("doc", "page", "line", "frag", "text")


@query("d3_cells_facts", f"WITH {_PAPERS} SELECT doc, page, line, caption, unnest(list_filter([a, b, c || CASE WHEN unit THEN ' x' ELSE '' END], lambda x: x IS NOT NULL)) AS text FROM t")
def d3_facts(spark, sf_dir):
    """Figures with a currency's sign, in brackets, of decimals alone, and with a unit after them."""
    return G.cells(G.lines(papers(spark, sf_dir), _KEYS), _KEYS).where("line > 0").select("doc", "page", "line", "caption", "text")


@query("d5_body_facts", f"WITH {_PAPERS} SELECT doc, page, CAST(1 AS INTEGER) AS start, CAST(max(line) + 1 AS INTEGER) AS stop FROM t GROUP BY doc, page")
def d5_facts(spark, sf_dir):
    return G.body(G.lines(papers(spark, sf_dir), _KEYS), _KEYS)


@query("d6_headers_facts", f"WITH {_PAPERS} SELECT DISTINCT doc, page, text, CAST(CASE text WHEN '2Q26' THEN 0 ELSE 1 END AS INTEGER) AS col FROM t, (VALUES ('2Q26'), ('2Q25')) AS h(text)")
def d6_facts(spark, sf_dir):
    lined = G.lines(papers(spark, sf_dir), _KEYS)
    frags = G.fragments(lined, keys=_KEYS).where("line = 0").select(*_KEYS, "text", "x0", "x1", "frag")
    ranges = G.columns(G.cells(lined.where("line > 0"), _KEYS), _KEYS).select(*_KEYS, "col", "left", "right").distinct()
    return G.assign(frags, ranges, 30.0, _KEYS, ["text"]).select(*_KEYS, "text", "col")


@query("d8_table_layout_facts", f"WITH {_PAPERS}, w AS (SELECT *, c || CASE WHEN unit THEN ' x' ELSE '' END AS d FROM t) SELECT doc, page, line, caption, '[' || a || '|' || b || CASE WHEN max(d) OVER (PARTITION BY doc, page) IS NULL THEN '' ELSE '|' || coalesce(d, 'null') END || ']' AS cells FROM w")
def d8_facts(spark, sf_dir):
    """Whole pages as tables: every fourth line lacks its third cell."""
    lined = G.lines(papers(spark, sf_dir), _KEYS).where("line > 0")
    return G.layout(G.columns(G.cells(lined, _KEYS), _KEYS), _KEYS)
