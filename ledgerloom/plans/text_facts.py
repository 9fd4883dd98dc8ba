"""Headers, captions, figures and units read back from texts that are made of the driver's tables; the oracles know the parts that each text was made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import periods as P
from ..functions import text as T
from ..functions.formula import literal_value
from .registry import load, query

MONTHS_EN = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
MONTHS_ES = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, d (the order's date), e (its month's end), priority."""
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("d"), F.last_day("o_orderdate").alias("e"), F.col("o_orderpriority").alias("priority"))


_ORDERS = "o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, last_day(o_orderdate) AS e, o_orderpriority AS priority FROM orders)"


def _by(n: int, choices: list[str]) -> Column:
    """The choice that k modulo n names."""
    return F.element_at(F.array(*map(F.lit, choices)), (F.col("k") % n + 1).cast("int"))


def _sql_by(n: int, choices: list[str | None]) -> str:
    quoted = ["NULL" if c is None else "'" + c.replace("'", "''") + "'" for c in choices]
    return f"([{', '.join(quoted)}])[CAST(k % {n} AS INTEGER) + 1]"


# --- headers -----------------------------------------------------------------------------------------------


@query("b1_flatten_facts", f"WITH {_ORDERS} SELECT k, 'Order ' || k || ' ' || priority AS flat FROM o")
def b1(spark, sf_dir):
    return orders(spark, sf_dir).select("k", T.flatten(F.concat(F.lit("  Order | \n"), "k", F.lit("\t|"), "priority", F.lit(" \n "))).alias("flat"))


@query("b4_month_span_facts", "SELECT l_orderkey, l_linenumber, l_partkey, CAST((month(l_shipdate) - month(o_orderdate) + 12) % 12 + 1 AS INTEGER) AS months FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def b4(spark, sf_dir):
    """The months from an order to its shipping, both included."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.month("o_orderdate").alias("a"))
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.month("l_shipdate").alias("b"))
    return lines.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "l_partkey", P.month_span(F.col("a"), F.col("b")).cast("int").alias("months"))


@query("b6_month_lexicon_facts", f"WITH {_ORDERS} SELECT k, CAST(month(d) AS INTEGER) AS month FROM o")
def b6(spark, sf_dir):
    """Names in English and Spanish, whole and cut to three letters, in small and capital letters."""
    named = lambda names: F.element_at(F.array(*map(F.lit, names)), F.month("d"))
    word = F.when(F.col("k") % 2 == 0, named(MONTHS_EN)).otherwise(named(MONTHS_ES))
    word = F.when(F.col("k") % 3 == 0, F.upper(word)).when(F.col("k") % 3 == 1, F.substring(named(MONTHS_EN), 1, 3)).otherwise(word)
    return orders(spark, sf_dir).select("k", P.month_number(word).cast("int").alias("month"))


_HEADERS = """
    h AS (SELECT k, k % 6 AS form, e, CASE WHEN k % 6 = 2 THEN last_day(make_date(year(d) % 100 + 2000, CAST((month(d) + 2) // 3 * 3 AS BIGINT), 1)) WHEN k % 6 = 4 THEN last_day(make_date(year(d) % 100 + 2000, CASE WHEN month(d) <= 6 THEN 6 ELSE 12 END, 1)) ELSE e END AS "end", ([3, 6, 3, NULL, 6, 9])[CAST(k % 6 AS INTEGER) + 1] AS months FROM o)"""


def _header(df: DataFrame) -> DataFrame:
    """k, header: the order's month or its quarter or half, in six ways; a year of two digits is one of this century."""
    spelled, long_ = F.date_format("e", "d MMMM yyyy"), F.date_format("e", "MMMM d, yyyy")
    forms = [
        F.concat(F.lit("Three months ended "), spelled), F.concat(F.lit("Six months ended "), long_), F.concat(F.quarter("d"), F.lit("Q"), F.date_format("d", "yy")),
        spelled, F.concat(F.when(F.month("d") <= 6, "1H").otherwise("2H"), F.date_format("d", "yy")), F.concat(F.lit("For the nine months ended "), spelled),
    ]
    return df.withColumn("header", F.element_at(F.array(*forms), (F.col("k") % 6 + 1).cast("int")))


@query("b7_single_header_facts", f'WITH {_ORDERS}, {_HEADERS} SELECT k, CAST(months AS INTEGER) AS months, "end" FROM h')
def b7(spark, sf_dir):
    found = _header(orders(spark, sf_dir)).withColumn("p", P.parse_header(F.col("header")))
    return found.select("k", F.col("p.months").cast("int").alias("months"), F.col("p.end").alias("end"))


@query("b3_phrases_and_dates_facts", f"""WITH {_ORDERS} SELECT k, CAST(i AS INTEGER) AS col, CAST(CASE WHEN i < 2 THEN 3 ELSE 6 END AS INTEGER) AS months, CASE WHEN i % 2 = 0 THEN e ELSE last_day(e - INTERVAL 12 MONTH) END AS "end" FROM o, (SELECT unnest([0, 1, 2, 3]) AS i) WHERE month(e) <> 2""")
def b3(spark, sf_dir):
    """Two phrases over four dates, dealt in printed order (B2); the year before beside each date."""
    o = orders(spark, sf_dir).where(F.month("e") != 2)
    both = F.concat_ws(" ", F.date_format("e", "d MMMM yyyy"), F.date_format(F.add_months("e", -12), "d MMMM yyyy"))
    block = F.concat_ws("\n", F.lit("Statement of income"), F.lit("Three months ended Six months ended"), F.concat_ws(" ", both, both))
    # Blocks of one date are one: each is read once.
    texts = o.select("e", block.alias("block")).distinct().select("e", F.posexplode(P.header_texts(F.col("block"))).alias("col", "header")).withColumn("p", P.parse_header(F.col("header")))
    return o.select("k", "e").join(texts, "e").select("k", "col", F.col("p.months").cast("int").alias("months"), F.col("p.end").alias("end"))


@query("c25_as_iso_facts", f"WITH {_ORDERS} SELECT k, CASE k % 5 WHEN 0 THEN d WHEN 1 THEN d WHEN 4 THEN NULL ELSE e END AS iso FROM o")
def c25(spark, sf_dir):
    forms = F.array(F.col("d").cast("string"), F.concat("d", F.lit(" 00:00:00")), F.date_format("d", "MMM yyyy"), F.date_format("d", "MMMM yyyy"), F.col("priority"))
    v = F.element_at(forms, (F.col("k") % 5 + 1).cast("int"))
    return orders(spark, sf_dir).withColumn("v", v).select("k", F.coalesce(F.col("v").try_cast("date"), P.month_and_year(F.col("v"))).alias("iso"))


# --- figures -----------------------------------------------------------------------------------------------


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, n, part, a (a price in cents), b (a quantity)."""
    return load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("a"), F.col("l_quantity").cast("long").alias("b"))


_ITEMS = "i AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS part, CAST(round(l_extendedprice * 100) AS BIGINT) AS a, CAST(l_quantity AS BIGINT) AS b FROM lineitem)"


@query("c4_parse_row_facts", f"WITH {_ITEMS} SELECT k, n, part, CASE WHEN n % 3 = 0 THEN 'Cost of goods, net' ELSE 'Sales, domestic' END AS caption, '[' || printf('%.4f', CAST(a AS DOUBLE)) || '|' || printf('%.4f', CAST(-a - b AS DOUBLE)) || CASE WHEN n % 2 = 0 THEN '|null]' ELSE ']' END AS \"values\" FROM i")
def c4(spark, sf_dir):
    """Captions with marks, a note's number before the figures of every third line, a dash for none."""
    caption = F.when(F.col("n") % 3 == 0, "+ Cost of goods, net ..... ").otherwise("Sales, domestic ")
    note = F.when(F.col("n") % 3 == 1, F.concat((F.col("n") + 10).cast("string"), F.lit(" "))).otherwise(F.lit(""))
    line = F.concat(caption, note, F.format_number("a", 0), F.lit(" ("), F.format_number(F.col("a") + F.col("b"), 0), F.lit(")"), F.when(F.col("n") % 2 == 0, F.lit(" -")).otherwise(F.lit("")))
    return items(spark, sf_dir).withColumn("r", T.parse_row(line)).select("k", "n", "part", "r.caption", "r.values")


@query("c6_european_number_facts", f"WITH {_ITEMS} SELECT k, n, part, CASE WHEN k % 3 = 0 THEN -1 ELSE 1 END * CASE WHEN n % 2 = 0 THEN CAST(a * 100 AS DOUBLE) ELSE CAST(a AS DOUBLE) / 100 END AS value, n % 2 = 0 OR a >= 100000 AS dotted FROM i")
def c6(spark, sf_dir):
    """1.234.500 and 12.345,67, negative in brackets; and whether the figure alone shows that dots group."""
    whole = F.replace(F.format_number(F.col("a") * 100, 0), F.lit(","), F.lit("."))
    cents = F.translate(F.format_number(F.col("a") / 100, 2), ",.", ".,")
    token = F.when(F.col("n") % 2 == 0, whole).otherwise(cents)
    token = F.when(F.col("k") % 3 == 0, F.concat(F.lit("("), token, F.lit(")"))).otherwise(token)
    return items(spark, sf_dir).withColumn("t", token).select("k", "n", "part", T.european_number(F.col("t")).alias("value"), T.is_european(F.col("t")).alias("dotted"))


@query("c8_severed_digits_facts", f"WITH {_ITEMS} SELECT k, n, part, 'Land ' || format('{{:,}}', a) || ' ' || format('{{:,}}', a + b) AS line FROM i")
def c8(spark, sf_dir):
    """A renderer cut the first comma of every figure off what stands before it."""
    cut = lambda v: F.regexp_replace(F.format_number(v, 0), r"^(\d+),", "$1 ,")
    return items(spark, sf_dir).select("k", "n", "part", T.rejoin_severed(F.concat_ws(" ", F.lit("Land"), cut(F.col("a")), cut(F.col("a") + F.col("b")))).alias("line"))


@query("c16_literal_formulas_facts", f"WITH {_ITEMS} SELECT k, n, part, round(CASE n % 4 WHEN 0 THEN a + b * 2 WHEN 1 THEN (a - b) / 4.0 WHEN 2 THEN -(CAST(b AS DOUBLE) ** 2) + a END, 4) AS value, n % 4 = 3 AS refs FROM i")
def c16(spark, sf_dir):
    """Formulas of numbers are worked out; one that reads a cell is not (C17)."""
    a, b = F.col("a").cast("string"), F.col("b").cast("string")
    forms = F.array(F.concat(F.lit("="), a, F.lit("+"), b, F.lit("*2")), F.concat(F.lit("=("), a, F.lit("-"), b, F.lit(")/4")), F.concat(F.lit("=-"), b, F.lit("^2+"), a), F.concat(F.lit("=$B"), b, F.lit("+"), a))
    f = F.element_at(forms, (F.col("n") % 4 + 1).cast("int"))
    return items(spark, sf_dir).withColumn("f", f).select("k", "n", "part", F.round(literal_value(F.col("f")), 4).alias("value"), T.references_cells(F.col("f")).alias("refs"))


@query("c17_references_cells_facts", "SELECT p_partkey, p_partkey % 4 IN (0, 3) AS refs FROM part")
def c17(spark, sf_dir):
    """Cells of a formula, not what stands in quotes or is part of a name."""
    key = F.col("p_partkey").cast("string")
    forms = F.array(F.concat(F.lit("=SUM(A"), key, F.lit(":B7)")), F.concat(F.lit('="A'), key, F.lit('"&"x"')), F.concat(F.lit("=LOG10("), key, F.lit(")")), F.concat(F.lit("=$C$"), F.col("p_size").cast("string"), F.lit("*2")))
    return load(spark, sf_dir, "part").select("p_partkey", T.references_cells(F.element_at(forms, (F.col("p_partkey") % 4 + 1).cast("int"))).alias("refs"))


# --- titles, sections, units -------------------------------------------------------------------------------

_TITLES = [("Consolidated statement of comprehensive income", "comprehensive_income"), ("STATEMENTS OF CASH FLOWS", "cash_flow"), ("Statement of changes in equity", "equity"), ("Interim balance sheet", "balance_sheet"), ("Income statement", "income_statement"), ("Directors' report", "other"), ("[610000] whatever it says", "equity")]


@query("c9_classify_title_facts", f"WITH {_ORDERS} SELECT k, {_sql_by(len(_TITLES), [k for _, k in _TITLES])} AS kind FROM o")
def c9(spark, sf_dir):
    title = F.concat(_by(len(_TITLES), [t for t, _ in _TITLES]), F.lit(" for "), F.date_format("d", "MMMM yyyy"))
    return orders(spark, sf_dir).select("k", T.classify_title(title).alias("kind"))


_SECTIONS = [("Cash Flow", "cash_flow"), ("Consolidated cash flow statement", "cash_flow"), ("Balance sheet items", "balance_sheet"), ("Valuation", "other"), ("Valuation gains", None), ("Notes on the P L", "income_statement"), ("Revenue", None), ("LTM figures", "other"), ("Segment", "other"), ("Segment sales", None)]


@query("c10_detect_section_facts", f"WITH {_ORDERS} SELECT k, {_sql_by(len(_SECTIONS), [s for _, s in _SECTIONS])} AS section FROM o")
def c10(spark, sf_dir):
    """Headings in small and capital letters, with marks around them."""
    label = _by(len(_SECTIONS), [t for t, _ in _SECTIONS])
    label = F.when(F.col("k") % 3 == 0, F.upper(label)).when(F.col("k") % 3 == 1, F.concat(F.lit("* "), label, F.lit(":"))).otherwise(label)
    return orders(spark, sf_dir).select("k", T.detect_section(label).alias("section"))


_SCALES = [("in Rs. crores", "crores", "INR"), ("SAR '000", "thousands", "SAR"), ("US$ million", "millions", "USD"), ("HK$ bn", "billions", "HKD"), ("(In US dollars)", "units", None), ("Rs in lakhs", "lakhs", "INR"), ("in thousands of CLP", "thousands", "CLP"), ("audited", None, None), ("€ million", "millions", "EUR"), ("(Expressed in Mexican pesos)", "units", None), ("AED thousands", "thousands", "AED")]


def _scaled(spark, sf_dir) -> DataFrame:
    text = F.concat_ws("\n", F.concat(F.lit("Report of "), F.date_format("d", "MMMM yyyy")), _by(len(_SCALES), [s[0] for s in _SCALES]), F.lit("unaudited figures"))
    return orders(spark, sf_dir).withColumn("text", text)


@query("c11_units_facts", f"WITH {_ORDERS} SELECT k, {_sql_by(len(_SCALES), [s[1] for s in _SCALES])} AS units FROM o")
def c11(spark, sf_dir):
    return _scaled(spark, sf_dir).select("k", T.sniff_units(F.col("text")).alias("units"))


@query("c12_whole_units_facts", f"WITH {_ORDERS} SELECT k, {_sql_by(len(_SCALES), ['x' if s[1] == 'units' else None for s in _SCALES])} IS NOT NULL AS whole FROM o")
def c12(spark, sf_dir):
    return _scaled(spark, sf_dir).select("k", T.states_whole_units(F.col("text")).alias("whole"))


@query("c13_currency_facts", f"WITH {_ORDERS} SELECT k, {_sql_by(len(_SCALES), [s[2] for s in _SCALES])} AS currency FROM o")
def c13(spark, sf_dir):
    return _scaled(spark, sf_dir).select("k", T.sniff_currency(F.col("text")).alias("currency"))


_ENDS = [("Rs Bn", "billions"), ("INR crores", "crores"), ("US$ Mn", "millions"), ("Mn", None), ("", None), ("Rs", None)]


@query("c14_row_units_facts", f"WITH p AS (SELECT p_partkey AS k FROM part) SELECT k, {_sql_by(len(_ENDS), [u for _, u in _ENDS])} AS units FROM p")
def c14(spark, sf_dir):
    caption = F.concat_ws(" ", "p_name", _by(len(_ENDS), [e for e, _ in _ENDS]))
    return load(spark, sf_dir, "part").withColumn("k", F.col("p_partkey")).select("k", T.row_units(caption).alias("units"))


@query("c18_direction_variants_facts", """
    WITH p AS (SELECT p_partkey, 'on ' || p_name AS tail FROM part) SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '[impairment loss ' || tail || '|impairment reversal ' || tail || ']' WHEN 1 THEN '[gain ' || tail || '|losses ' || tail || ']' WHEN 2 THEN '[net inflows ' || tail || '|net outflows ' || tail || ']' ELSE '[]' END AS forms FROM p""")
def c18(spark, sf_dir):
    """Captions of two directions, with a stroke, with 'or', and side by side; and of one."""
    starts = F.array(*map(F.lit, ("Impairment loss / reversal", "Gain or (losses)", "Net inflows/(outflows)", "Impairment loss")))
    caption = F.concat_ws(" ", F.element_at(starts, (F.col("p_partkey") % 4 + 1).cast("int")), F.lit("on"), "p_name")
    return load(spark, sf_dir, "part").select("p_partkey", T.direction_variants(T.normalize_label(caption)).alias("forms"))


_KINDS = [("margin", True), ("growth %", True), ("5% notes due", False), ("sales", False), ("net debt ratio", True), ("tax %", True), ("marginal costs", False)]


@query("c20_derived_captions_facts", f"WITH p AS (SELECT p_partkey AS k FROM part) SELECT k, {_sql_by(len(_KINDS), ['x' if d else None for _, d in _KINDS])} IS NOT NULL AS derived FROM p")
def c20(spark, sf_dir):
    caption = F.concat_ws(" ", F.initcap("p_name"), _by(len(_KINDS), [c for c, _ in _KINDS]))
    return load(spark, sf_dir, "part").withColumn("k", F.col("p_partkey")).select("k", T.is_derived(caption).alias("derived"))


@query("c22_colour_role_facts", """
    WITH c AS (SELECT c_custkey, (c_custkey * 37) % 256 AS r, (c_custkey * 101) % 256 AS g, (c_custkey * 59) % 256 AS b FROM customer), m AS (SELECT *, greatest(r, g, b) AS top, (greatest(r, g, b) - least(r, g, b)) AS d FROM c),
    h AS (SELECT *, CASE WHEN d = 0 THEN 0.0 WHEN top = r THEN ((g - b) / d + 6) % 6 WHEN top = g THEN (b - r) / d + 2 ELSE (r - g) / d + 4 END * 60 AS hue FROM m)
    SELECT c_custkey, printf('%02X%02X%02X', r, g, b) AS rgb, CASE WHEN d < 0.12 * 255 THEN 'formula' WHEN hue BETWEEN 190 AND 260 THEN 'input' WHEN hue BETWEEN 80 AND 170 THEN 'link' WHEN hue <= 20 OR hue >= 340 THEN 'external' ELSE 'formula' END AS role FROM h""")  # fmt: skip
def c22(spark, sf_dir):
    """Colours all over the wheel, one for each customer."""
    part = lambda m: (F.col("c_custkey") * m % 256)
    rgb = F.format_string("%02X%02X%02X", part(37), part(101), part(59))
    return load(spark, sf_dir, "customer").select("c_custkey", rgb.alias("rgb")).select("c_custkey", "rgb", T.colour_role(F.col("rgb")).alias("role"))
