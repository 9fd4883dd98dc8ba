"""Queries on scalar functions: captions, figures, units, classification (groups A and C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.workbook import row_predicates
from .registry import Table, expected, load, query

_ACCENTS = "À-ÖØ-öø-ÿ"


@query("c1_normalize_label", r"""
    SELECT doc_id, lower(trim(regexp_replace(regexp_replace(strip_accents(regexp_replace(replace(text, '&', ' and '), '([ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ])', '\1 ', 'g')), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS label
    FROM documents""")  # fmt: skip
def c1(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", T.normalize_label(F.col("text")).alias("label"))


@query("c2_accent_free_label", r"""
    SELECT doc_id, lower(trim(regexp_replace(regexp_replace(replace(strip_accents(text), '&', ' and '), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS label FROM documents""")  # fmt: skip
def c2(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", T.accent_free_label(F.col("text")).alias("label"))


_TOKENS = Table("token string", [("1,234.5",), ("(1,234)",), ("-7",), ("7-",), ("−8",), ("( 12 )",), ("abc",), ("",), ("-",), ("1.2.3",), ("(5)-",), (None,), ("(3",)])


@query("c3_parse_number", expected("token string, value double", [("1,234.5", 1234.5), ("(1,234)", -1234.0), ("-7", -7.0), ("7-", -7.0), ("−8", -8.0), ("( 12 )", -12.0), ("abc", None), ("", None), ("-", None), ("1.2.3", None), ("(5)-", None), (None, None), ("(3", 3.0)]))
def c3(spark, sf_dir):
    return _TOKENS.df(spark).select("token", T.parse_number(F.col("token")).alias("value"))


@query("c3_parse_number_words", r"""
    WITH w AS (SELECT doc_id, unnest(string_split_regex(text, '[\s]+')) AS token FROM documents)
    SELECT doc_id, count(*) AS n_tokens, CAST(count(CASE WHEN regexp_full_match(replace(token, ',', ''), '-?\d+(\.\d+)?') THEN 1 END) AS BIGINT) AS n_plain FROM w GROUP BY doc_id""")  # fmt: skip
def c3_words(spark, sf_dir):
    words = load(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", r"[\s]+")).alias("token"))
    plain = T.parse_number(F.col("token")).isNotNull() & F.replace(F.col("token"), F.lit(",")).rlike(r"^-?\d+(\.\d+)?$")
    return words.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.count(F.when(plain, 1)).alias("n_plain"))


_LINES = Table("line string", [
    ("Revenue 10 5,868,205 4,000,100",), ("Revenue 5, 6 5,868,205 4,000,100",), ("- Purchase of plant (1,222) -",), ("+ (-) Adjustments 12 - (5)",),
    ("Concept | 2026-04-01 - 2026-06-30 | 1",), ("Total assets | 1,000 | 900.5",), ("Note 12 3,000 4,000",), ("Just words",), ("1,000 2,000",), ("Units sold 25 30",), ("Dash only - -",),
])


@query("c4_parse_row", expected("line string, caption string, values array<double>", [
    ("Revenue 10 5,868,205 4,000,100", "Revenue", [5868205.0, 4000100.0]), ("Revenue 5, 6 5,868,205 4,000,100", "Revenue", [5868205.0, 4000100.0]), ("- Purchase of plant (1,222) -", "Purchase of plant", [-1222.0, None]),
    ("+ (-) Adjustments 12 - (5)", "Adjustments", [None, -5.0]), ("Concept | 2026-04-01 - 2026-06-30 | 1", None, None), ("Total assets | 1,000 | 900.5", "Total assets", [1000.0, 900.5]), ("Note 12 3,000 4,000", None, None),
    ("Just words", None, None), ("1,000 2,000", None, None), ("Units sold 25 30", "Units sold", [30.0]), ("Dash only - -", None, None),
]))
def c4(spark, sf_dir):
    return _LINES.df(spark).withColumn("r", T.parse_row(F.col("line"))).select("line", "r.caption", "r.values")


@query("c5_data_rows", r"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
    SELECT doc_id, count(*) AS n_lines, CAST(count(CASE WHEN len(regexp_extract_all(line, '\(\s*-?[\d][\d,]*(?:\.\d+)?\s*\)|-?\d[\d,]*(?:\.\d+)?')) >= 2 AND regexp_matches(line, '\d[\d,]*\.\d+|\d{1,3}(?:,\d{3})+|\b\d{5,}\b') AND regexp_matches(line, '[A-Za-z]{3}') THEN 1 END) AS BIGINT) AS n_data FROM l GROUP BY doc_id""")  # fmt: skip
def c5(spark, sf_dir):
    lines = load(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count(F.when(T.is_data_row(F.col("line")), 1)).alias("n_data"))


_EURO = Table("table_id int, token string", [(1, "1.512.033.764"), (1, "(176.866.381)"), (1, "177,67"), (1, "748.160"), (1, "-"), (2, "748.160"), (2, "1,250"), (3, "56,51")])


@query("c6_european_numbers", expected("table_id int, token string, value double", [(1, "1.512.033.764", 1512033764.0), (1, "(176.866.381)", -176866381.0), (1, "177,67", 177.67), (1, "748.160", 748160.0), (1, "-", None), (2, "748.160", 748.16), (2, "1,250", 1250.0), (3, "56,51", 5651.0)]))
def c6(spark, sf_dir):
    """The dotted reading is licensed by the table: one figure that only it can print."""
    from pyspark.sql import Window

    licensed = F.max(T.is_european(F.col("token"))).over(Window.partitionBy("table_id"))
    return _EURO.df(spark).withColumn("european", licensed).select("table_id", "token", F.when(F.col("european"), T.european_number(F.col("token"))).otherwise(T.parse_number(F.col("token"))).alias("value"))


@query("c7_printed_figures", r"""
    WITH f AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\d[\d,]*(?:\.\d+)?')) AS token FROM documents)
    SELECT doc_id, count(DISTINCT CAST(replace(token, ',', '') AS DOUBLE)) AS n_figures FROM f GROUP BY doc_id""")  # fmt: skip
def c7(spark, sf_dir):
    """The set of magnitudes that a page prints; figures are looked up in it by either sign."""
    found = load(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(\d[\d,]*(?:\.\d+)?)"), 1)).alias("token"))
    return found.groupBy("doc_id").agg(F.countDistinct(F.abs(T.parse_number(F.col("token")))).alias("n_figures"))


_SEVERED = Table("line string", [("1 ,368,618",), ("9 15,780 2 31,694 2 41,400",), ("Revenue 12 345",), ("12 3,456",)])


@query("c8_severed_digits", expected("line string, fixed string", [("1 ,368,618", "1,368,618"), ("9 15,780 2 31,694 2 41,400", "915,780 231,694 241,400"), ("Revenue 12 345", "Revenue 12 345"), ("12 3,456", "123,456")]))
def c8(spark, sf_dir):
    return _SEVERED.df(spark).select("line", T.rejoin_severed(F.col("line")).alias("fixed"))


_TITLES = Table("title string", [("Statement of Comprehensive Income",), ("CASH FLOW",), ("Changes in Trustors' Capital",), ("Consolidated balance sheet",), ("Schedule of Net Debt",), ("[310000] Resultado",), ("[999999] x",), ("Results of operations",), ("Performance at a glance",), ("Segments",), (None,)])


@query("c9_classify_title", expected("title string, kind string", [("Statement of Comprehensive Income", "comprehensive_income"), ("CASH FLOW", "cash_flow"), ("Changes in Trustors' Capital", "equity"), ("Consolidated balance sheet", "balance_sheet"), ("Schedule of Net Debt", "balance_sheet"), ("[310000] Resultado", "income_statement"), ("[999999] x", "other"), ("Results of operations", "income_statement"), ("Performance at a glance", "summary"), ("Segments", "other"), (None, "other")]))
def c9(spark, sf_dir):
    return _TITLES.df(spark).select("title", T.classify_title(F.col("title")).alias("kind"))


_HEADINGS = Table("label string", [("Cash Flow",), ("Consolidated Cash Flow Statement",), ("P&L",), ("Balance sheet items",), ("Valuation",), ("Valuation gains",), ("Revenue",), ("LTM figures",)])


@query("c10_detect_section", expected("label string, section string", [("Cash Flow", "cash_flow"), ("Consolidated Cash Flow Statement", "cash_flow"), ("P&L", None), ("Balance sheet items", "balance_sheet"), ("Valuation", "other"), ("Valuation gains", None), ("Revenue", None), ("LTM figures", "other")]))
def c10(spark, sf_dir):
    return _HEADINGS.df(spark).select("label", T.detect_section(F.col("label")).alias("section"))


_UNITS = Table("text string", [("in Rs. crores",), ("Rs in lakhs",), ("SAR '000",), ("US$ million",), ("(In US dollars)",), ("(Expressed in Mexican pesos)",), ("in thousands of CLP",), ("HK$ bn",), ("miles de millones",), ("nothing",), ("EUR m",), ("€ million",), ("£'000",), ("MX$",), ("TL",), ("₩ bn",), ("in KRW",), ("⃂ 1",), ("AED",), ("QAR",), ("RMB",)])


@query("c11_units", expected("text string, units string", [("in Rs. crores", "crores"), ("Rs in lakhs", "lakhs"), ("SAR '000", "thousands"), ("US$ million", "millions"), ("(In US dollars)", "units"), ("(Expressed in Mexican pesos)", "units"), ("in thousands of CLP", "thousands"), ("HK$ bn", "billions"), ("miles de millones", "billions"), ("nothing", None), ("EUR m", None), ("€ million", "millions"), ("£'000", "thousands"), ("MX$", None), ("TL", None), ("₩ bn", "billions"), ("in KRW", None), ("⃂ 1", None), ("AED", None), ("QAR", None), ("RMB", None)]))
def c11(spark, sf_dir):
    return _UNITS.df(spark).select("text", T.sniff_units(F.col("text")).alias("units"))


@query("c12_whole_units", expected("text string, whole boolean", [(r[0], r[0] in ("(In US dollars)", "(Expressed in Mexican pesos)")) for r in _UNITS.rows]))
def c12(spark, sf_dir):
    return _UNITS.df(spark).select("text", T.states_whole_units(F.col("text")).alias("whole"))


@query("c13_currency", expected("text string, currency string", [("in Rs. crores", "INR"), ("Rs in lakhs", "INR"), ("SAR '000", "SAR"), ("US$ million", "USD"), ("(In US dollars)", None), ("(Expressed in Mexican pesos)", None), ("in thousands of CLP", "CLP"), ("HK$ bn", "HKD"), ("miles de millones", None), ("nothing", None), ("EUR m", "EUR"), ("€ million", "EUR"), ("£'000", "GBP"), ("MX$", "MXN"), ("TL", "TRY"), ("₩ bn", "KRW"), ("in KRW", "KRW"), ("⃂ 1", "SAR"), ("AED", "AED"), ("QAR", "QAR"), ("RMB", "CNY")]))
def c13(spark, sf_dir):
    return _UNITS.df(spark).select("text", T.sniff_currency(F.col("text")).alias("currency"))


_ROW_UNITS = Table("caption string", [("Market Capitalization Rs Bn",), ("Revenue Rs Mn",), ("Debt US$ Bn",), ("EBITDA",), ("Capex INR crores",)])


@query("c14_row_units", expected("caption string, units string", [("Market Capitalization Rs Bn", "billions"), ("Revenue Rs Mn", "millions"), ("Debt US$ Bn", "billions"), ("EBITDA", None), ("Capex INR crores", "crores")]))
def c14(spark, sf_dir):
    return _ROW_UNITS.df(spark).select("caption", T.row_units(F.col("caption")).alias("units"))


@query("c15_unit_scaling", """
    WITH s AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS v, CASE l_linenumber % 4 WHEN 0 THEN 'units' WHEN 1 THEN 'thousands' WHEN 2 THEN 'lakhs' ELSE 'other' END AS u FROM lineitem)
    SELECT l_orderkey, l_linenumber, round(v * CASE u WHEN 'units' THEN 1.0 WHEN 'thousands' THEN 1e3 WHEN 'lakhs' THEN 1e5 ELSE 1.0 END / 1e6, 9) AS value FROM s""")  # fmt: skip
def c15(spark, sf_dir):
    u = F.when(F.col("l_linenumber") % 4 == 0, "units").when(F.col("l_linenumber") % 4 == 1, "thousands").when(F.col("l_linenumber") % 4 == 2, "lakhs").otherwise("other")
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(T.rescale(F.col("l_extendedprice"), u, F.lit("millions")), 9).alias("value"))


_FORMULAS = Table("formula string", [("=1+2*3",), ("=2^3^2",), ("=-(4-1)/2",), ("=A1+1",), ('="A1"',), ("=10%",), ("=SUM(B2:B4)",), ("=$C$5*2",)])


@query("c16_literal_formulas", expected("formula string, value double", [("=1+2*3", 7.0), ("=2^3^2", 512.0), ("=-(4-1)/2", -1.5), ("=A1+1", None), ('="A1"', None), ("=10%", None), ("=SUM(B2:B4)", None), ("=$C$5*2", None)]))
def c16(spark, sf_dir):
    from ..functions.formula import literal_value

    return _FORMULAS.df(spark).select("formula", literal_value(F.col("formula")).alias("value"))


@query("c17_references_cells", expected("formula string, refs boolean", [("=1+2*3", False), ("=2^3^2", False), ("=-(4-1)/2", False), ("=A1+1", True), ('="A1"', False), ("=10%", False), ("=SUM(B2:B4)", True), ("=$C$5*2", True)]))
def c17(spark, sf_dir):
    return _FORMULAS.df(spark).select("formula", T.references_cells(F.col("formula")).alias("refs"))


_DIRECTIONS = Table("caption string", [("Impairment loss / reversal on financial assets",), ("Gain or (loss) on disposal",), ("Income tax expense",), ("Other (Expenses) / Income, net",), ("Revenue",)])


@query("c18_direction_variants", expected("caption string, forms array<string>", [("Impairment loss / reversal on financial assets", ["impairment loss on financial assets", "impairment reversal on financial assets"]), ("Gain or (loss) on disposal", ["gain on disposal", "loss on disposal"]), ("Income tax expense", []), ("Other (Expenses) / Income, net", ["other expenses net", "other income net"]), ("Revenue", [])]))
def c18(spark, sf_dir):
    return _DIRECTIONS.df(spark).select("caption", T.direction_variants(T.normalize_label(F.col("caption"))).alias("forms"))


@query("c19_bidirectional", expected("caption string, both boolean", [("Impairment loss / reversal on financial assets", True), ("Gain or (loss) on disposal", True), ("Income tax expense", True), ("Other (Expenses) / Income, net", True), ("Revenue", False)]))
def c19(spark, sf_dir):
    """Both words of a pair, or foreign-exchange and hedge vocabulary: such rows keep the printed sign."""
    norm = T.normalize_label(F.col("caption"))
    words = F.split(norm, " ")
    has = lambda *ws: F.arrays_overlap(words, F.array(*map(F.lit, ws)))
    pair = (has("gain", "gains", "income", "profit", "reversal", "credit") & has("loss", "losses", "expense", "expenses", "charge", "deficit")) | (has("loss", "losses") & has("reversal", "reversals"))
    return _DIRECTIONS.df(spark).select("caption", (pair | norm.rlike("foreign exchange|translation|hedg|fair value")).alias("both"))


_DERIVED = Table("caption string", [("EBITDA margin",), ("Net debt ratio",), ("Revenue growth %",), ("7.5% notes due 2031",), ("Revenue",), ("Effective tax %",)])


@query("c20_derived_captions", expected("caption string, derived boolean", [("EBITDA margin", True), ("Net debt ratio", True), ("Revenue growth %", True), ("7.5% notes due 2031", False), ("Revenue", False), ("Effective tax %", True)]))
def c20(spark, sf_dir):
    return _DERIVED.df(spark).select("caption", T.is_derived(F.col("caption")).alias("derived"))


@query("c21_content_hash", "SELECT doc_id, sha256(text) AS sha FROM documents")
def c21(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))


_COLOURS = Table("rgb string", [("0000FF",), ("008000",), ("FF0000",), ("000000",), ("808080",), ("0070C0",), (None,)])


@query("c22_colour_role", expected("rgb string, role string", [("0000FF", "input"), ("008000", "link"), ("FF0000", "external"), ("000000", "formula"), ("808080", "formula"), ("0070C0", "input"), (None, "formula")]))
def c22(spark, sf_dir):
    return _COLOURS.df(spark).select("rgb", T.colour_role(F.col("rgb")).alias("role"))


_THEME = Table("idx int, rgb string", [(0, "FFFFFF"), (1, "000000"), (4, "4472C4")])
_TINTS = Table("idx int, tint double", [(0, -0.5), (1, 0.5), (4, 0.0)])


@query("c23_theme_tint", f"""
    WITH t AS (SELECT company, idx, tint, rgb, CAST('0x' || rgb[1:2] AS INTEGER) AS r, CAST('0x' || rgb[3:4] AS INTEGER) AS g, CAST('0x' || rgb[5:6] AS INTEGER) AS b FROM {_TINTS.sql_across()} JOIN {_THEME.sql} h USING (idx)),
    l AS (SELECT *, (greatest(r, g, b) + least(r, g, b)) / 510.0 AS l FROM t) SELECT company, idx, round(CASE WHEN tint < 0 THEN l * (1 + tint) ELSE l * (1 - tint) + tint END, 6) AS lightness FROM l""")  # fmt: skip
def c23(spark, sf_dir):
    """A theme colour's lightness, moved towards white or black by the tint."""
    return _TINTS.across(spark, sf_dir).join(F.broadcast(_THEME.df(spark)), "idx").select("company", "idx", F.round(T.tinted_lightness(F.col("rgb"), F.col("tint")), 6).alias("lightness"))


_CELLS = Table("style string, rgb string, formula string", [("Input", "000000", None), (None, "0000FF", None), (None, "0000FF", "=A1"), ("Output", "0000FF", None), (None, "000000", None)])


@query("c24_cell_verdict", expected("style string, rgb string, formula string, verdict string", [("Input", "000000", None, "input"), (None, "0000FF", None, "input"), (None, "0000FF", "=A1", "formula"), ("Output", "0000FF", None, "formula"), (None, "000000", None, "formula")]))
def c24(spark, sf_dir):
    named = F.when(F.lower("style").contains("input"), "input").when(F.lower("style").contains("output"), "formula")
    return _CELLS.df(spark).select("style", "rgb", "formula", F.when(F.col("formula").isNotNull(), "formula").otherwise(F.coalesce(named, T.colour_role(F.col("rgb")))).alias("verdict"))


_AS_ISO = Table("v string", [("2026-06-30",), ("2026-06-15 00:00:00",), ("Jun 2026",), ("March 2025",), ("x",), (None,)])


@query("c25_as_iso", expected("v string, iso date", [("2026-06-30", "2026-06-30"), ("2026-06-15 00:00:00", "2026-06-15"), ("Jun 2026", "2026-06-30"), ("March 2025", "2025-03-31"), ("x", None), (None, None)]))
def c25(spark, sf_dir):
    from ..functions import periods as P

    return _AS_ISO.df(spark).select("v", F.coalesce(F.col("v").try_cast("date"), P.month_and_year(F.col("v"))).alias("iso"))


_PAGE = Table("page int, text string", [(1, "Intro words here\nConsolidated income statement\nSAR '000\nRevenue 10,000 9,000\nCosts (5,000) (4,000)\nProfit 5,000 5,000\nclosing words")])


@query("c26_table_section", expected("page int, section string", [(1, "Consolidated income statement\nSAR '000\nRevenue 10,000 9,000")]))
def c26(spark, sf_dir):
    """From the title line to the first row of figures."""
    lines = _PAGE.df(spark).select("page", F.split("text", "\n").alias("lines"))
    title = F.array_position(F.transform("lines", lambda x: x.rlike(r"(?i)income\s+statement|balance\s+sheet|\bstatements?\s+of\b")), F.lit(True))
    first = F.array_position(F.transform("lines", lambda x: T.is_data_row(x)), F.lit(True))
    return lines.select("page", F.array_join(F.slice("lines", title.cast("int"), (first - title + 1).cast("int")), "\n").alias("section"))


@query("a4_shatter_metric", r"""
    WITH t AS (SELECT doc_id, list_filter(string_split_regex(trim(text), '\s+'), lambda x: x <> '') AS w FROM documents)
    SELECT doc_id, round(CASE WHEN len(w) > 0 THEN CAST(len(list_filter(w, lambda x: length(x) = 1)) AS DOUBLE) / len(w) ELSE 0 END, 9) AS shatter FROM t""")  # fmt: skip
def a4(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.round(T.shatter(F.col("text")), 9).alias("shatter"))


_VARIANTS = Table("page int, variant int, text string", [(1, 1, "T o t a l a s s e t s"), (1, 2, "Total assets 5"), (1, 3, "Total a ssets"), (2, 1, "Plain text page"), (2, 2, "P l a i n")])


@query("a3_page_text", expected("page int, variant int, text string", [(1, 2, "Total assets 5"), (2, 1, "Plain text page")]))
def a3(spark, sf_dir):
    """The reading whose letters are least spaced apart; the earlier one of equals."""
    shattered = _VARIANTS.df(spark).withColumn("s", T.shatter(F.col("text")))
    best = shattered.groupBy("page").agg(F.min_by(F.struct("variant", "text"), F.struct("s", "variant")).alias("b"))
    return best.select("page", "b.variant", "b.text")


_RENDER = Table("t int, a string, b string", [(1, "Revenue\nnet", "10"), (1, "", None), (1, "Costs", "(5)")])


@query("a5_render_table", expected("t int, text string", [(1, "Revenue net | 10\nCosts | (5)")]))
def a5(spark, sf_dir):
    rows = _RENDER.df(spark).withColumn("i", F.monotonically_increasing_id()).groupBy("t").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.array("a", "b").alias("r")))), lambda x: x["r"]).alias("rows"))
    return rows.select("t", T.render_cells(F.col("rows")).alias("text"))


@query("a26_dual_text", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS witness FROM conversations GROUP BY conv_id")
def a26(spark, sf_dir):
    """All readings of a page joined as one witness text, in order."""
    t = load(spark, sf_dir, "conversations").where("text is not null")
    return t.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("witness"))


_SHEET_ROWS = Table("row int, label string, v double", [(1, "Consolidated results", 2025.0), (2, "Standalone results", 1989.0), (3, "Separate", 2101.0), (4, "Revenue", 12.5)])


@query("a27_row_predicates", f"""
    SELECT company, "row", v BETWEEN 1990 AND 2100 AND v = floor(v) AS is_year, CASE WHEN lower(label) LIKE '%consolidated%' THEN 'consolidated' WHEN lower(label) LIKE '%standalone%' OR lower(label) LIKE '%separate%' THEN 'separate' END AS scope FROM {_SHEET_ROWS.sql_across()}""")
def a27(spark, sf_dir):
    is_year, scope = row_predicates(F.col("label"), F.col("v"))
    return _SHEET_ROWS.across(spark, sf_dir).select("company", "row", is_year.alias("is_year"), scope.alias("scope"))
