"""Steps whose work grew faster than their input: what they do now is counted, and is the same as before."""

from pyspark.sql import functions as F

from ledgerloom.functions import text as T


def planned(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_directions_read_their_caption_once(spark):
    """the caption's form was worked out again for every word of every lambda."""
    df = spark.createDataFrame([("Gain or (losses) on sale",), ("Impairment loss / reversal",), ("Loss on sale",), (None,)], "t string")
    out = df.select(T.direction_variants(T.normalize_label(F.col("t"))).alias("f"))
    assert [r.f for r in out.collect()] == [["gain on sale", "losses on sale"], ["impairment loss", "impairment reversal"], [], []]
    assert planned(out).count("regexp_replace(") == planned(df.select(T.normalize_label(F.col("t")).alias("f"))).count("regexp_replace(")


def test_equal_lines_are_searched_once(spark):
    """F8: each run of characters of each line carried the whole line with it."""
    from ledgerloom.operators.lookup import containing

    title = "large polished ring of the northern works, " * 2
    lines = spark.createDataFrame([(i, f"brand {i % 3} {title}", "x" * 50) for i in range(60)], "i int, text string, ballast string")
    names = spark.createDataFrame([(0, "2"), (1, title), (2, title + "?"), (3, "northern"), (3, "northern")], "j int, name string")
    out = containing(lines, names)
    assert "struct(i, " not in planned(out)
    assert sorted((r.i, r.j) for r in out.collect()) == sorted((i, j) for i in range(60) for j in ((0, 1, 3, 3) if i % 3 == 2 else (1, 3, 3)))


def test_spellings_meet_captions_not_requests(spark):
    """every request was joined with every spelling of its field and every line of its statement."""
    import random

    from ledgerloom.operators import select as S

    rng = random.Random(5)
    some = lambda n: " ".join(rng.choices(["gain", "or", "loss", "net", "sales", "cost", "of", "tax"], k=rng.randint(1, n)))
    fields = [(f, [some(4) for _ in range(6)] + ["", None]) for f in "abc"] + [("d", None)]
    aliases = spark.createDataFrame(fields, "field string, captions array<string>")
    rows = spark.createDataFrame([(s, r, some(4), [float(rng.randint(0, 1))]) for s in range(60) for r in range(4)], "stmt int, row int, caption string, values array<double>")
    wants = spark.createDataFrame([(i, i % 60, rng.choice(["a", "b", "c"])) for i in range(180)], "req int, stmt int, field string")
    out = S.find_listed(wants, aliases, rows)
    want = S.find_row(wants.join(aliases, "field").select("req", "stmt", "captions"), rows)
    got = sorted(map(tuple, out.collect()), key=repr)
    assert got == sorted(map(tuple, want.collect()), key=repr)
    assert {r[2] for r in got} >= {"exact", "direction", "containment", "words"}


def test_lines_are_read_once(spark):
    """a line's figures were worked out again for each mark that it might carry."""
    from ledgerloom.sources import segments

    pages = spark.createDataFrame([(1, 1, "INCOME STATEMENT\nSales 1,000 2,000\n10. SEGMENT REPORTING")], "doc int, page int, text string")
    out = segments.marked_lines(pages, ["doc"])
    # One for the question whether the line is a row, one for its figures.
    assert planned(out).count("regexp_extract_all(") == 2
    assert [(r.marks, r.note, r.row and r.row["values"]) for r in out.orderBy("ln").collect()] == [("statement", None, None), (None, None, [1000.0, 2000.0]), ("note", 10, None)]


def test_issues_meet_without_a_join(spark):
    """tables with a row for each document were joined, and what was small on disk was sent to the driver."""
    from ledgerloom.sources import segments

    pages = spark.createDataFrame([(1, 1, " "), (1, 2, "x"), (2, 1, None), (3, 1, "x"), (4, 1, "x")], "doc int, page int, text string")
    columns = "array<struct<header: string, months: int, end: date>>"
    rows = [(1, "statement", 2, None, [], [([1.0],)]), (3, "statement", 1, "units", [("a", 3, None)], [([1.0, 2.0],)]), (4, "note", 1, None, [], [([1.0],)])]
    found = spark.createDataFrame(rows, f"doc int, kind string, page int, units string, columns {columns}, rows array<struct<values: array<double>>>")
    out = segments.issues(found, pages, ["doc"])
    assert "Join" not in planned(out)
    got = sorted(map(tuple, out.collect()), key=repr)
    assert got == sorted([(1, 1, "pages_not_read"), (1, 2, "columns_unreadable"), (1, None, "units_unknown"), (2, 1, "pages_not_read"), (2, None, "no_statements"), (3, 1, "columns_misaligned"), (4, None, "no_statements")], key=repr)
    assert "Join" in planned(segments.read(pages, ["doc"])) and "BroadcastHashJoin [doc" not in segments.read(pages, ["doc"])._jdf.queryExecution().executedPlan().toString()


def test_sections_read_their_caption_once(spark):
    """F16: a label's form was worked out again for every keyword and place."""
    df = spark.createDataFrame([("Cash Flow",), ("Sales",), (None,)], "t string")
    assert [r.s for r in df.select(T.detect_section(F.col("t")).alias("s")).collect()] == ["cash_flow", None, None]
    t = spark.range(1).select(F.col("id").cast("string").alias("t"))
    assert planned(t.select(T.detect_section(F.col("t")))).count("regexp_replace(") == planned(t.select(T.normalize_label(F.col("t")))).count("regexp_replace(") > 0


def test_pages_are_folded_without_a_join(spark):
    """words were made and sent again for every step and met each other by joins."""
    from ledgerloom.operators import geometry as G
    from ledgerloom.plans import geometry

    words = [("a", 1, t, x0, x0 + 9.0, y * 20.0) for y, line in enumerate((("2Q26", "x"), ("Net", "1,250", "1,100"), ("Tax", "(900)", "-"), ("see", "the", "notes"))) for x0, t in zip((10.0, 150.0, 220.0), line)]
    lined = G.lines(spark.createDataFrame([*words, ("b", 1, "x", 1.0, 2.0, 0.0)], "doc string, page int, text string, x0 double, x1 double, top double"), ["doc", "page"])
    body = G.body(lined, ["doc", "page"])
    table = G.layout(G.columns(G.cells(lined, ["doc", "page"]), ["doc", "page"]), ["doc", "page"])
    assert [tuple(r) for r in body.collect()] == [("a", 1, 1, 3)]
    assert [(r.line, r.caption, r.cells) for r in table.orderBy("line").collect()] == [(1, "Net", ["1,250", "1,100"]), (2, "Tax", ["(900)", "-"])]
    assert "Join" not in planned(body) and "Join" not in planned(table)
    made = planned(geometry.papers(spark, "/root/testdata/sf0.001"))
    assert made.count("Join") == 1 and "Union" not in made


def test_spans_read_their_groups_once(spark):
    """a span's groups were searched again for each part of each date."""
    from ledgerloom.functions import periods as P

    df = spark.range(1).select(F.col("id").cast("string").alias("t"))
    assert 0 < planned(df.select(P.parse_header(F.col("t")).alias("p"))).count(P.NUMERIC_SPAN) <= 8
    texts = spark.createDataFrame([("01.03.2026 31.08.2026",), ("02.03.2026 31.08.2026",), ("01.99.2026 - 31.08.2026",)], "t string")
    assert [r.m for r in texts.select(P.parse_header(F.col("t"))["months"].alias("m")).collect()] == [6, None, 8]


def _small_statements(spark):
    rows = [(1, 0, "Gain (loss) on sale", [1.0]), (1, 1, "Loss on sale", [2.0]), (1, 2, "Trade payables", [3.0]), (1, 3, "Other payables", [3.0]), (1, 4, "", [4.0]), (2, 0, "Net sales, goods", [5.0]), (2, 1, "Goods", [6.0])]
    return spark.createDataFrame(rows, "stmt int, row int, caption string, values array<double>")


def test_rows_meet_requests_once(spark):
    """a pair's directions were worked out again for each question, and requests were made again to bring back those that find nothing."""
    from ledgerloom.operators import select as S

    wants = [(1, 1, ["Gain on sale"]), (2, 1, ["Gain / loss on sale"]), (3, 1, ["payables"]), (4, 2, ["goods sales"]), (5, 2, ["sales goods", None, ""]), (6, 9, ["Goods"]), (7, None, ["Goods"]), (8, 1, []), (9, 1, None), (10, 1, ["", "Trade Payables"])]
    found = S.find_row(spark.createDataFrame(wants, "req int, stmt int, captions array<string>"), _small_statements(spark))
    assert planned(found).count("Join ") == 1 and "Window" not in planned(found)
    got = {r.req: (r.row, r.tier, r.reason) for r in found.collect()}
    none = (None, None, "not_found")
    assert got == {1: (0, "direction", None), 2: (0, "exact", None), 3: (None, "containment", "ambiguous"), 4: (1, "containment", None), 5: (None, "containment", "ambiguous"), 6: none, 7: none, 8: none, 9: none, 10: (2, "exact", None)}


def test_plain_captions_need_one_replacement(spark):
    """plain captions went through the replacements for accents and for all scripts."""
    said = ["  Net sales, goods & 2nd_hand (Q1)\t-- ", "Beneficio básico / acción", "利益 (損失)", "Été & co", "a b", "&", "", None]
    df = spark.createDataFrame([(t,) for t in said], "t string")
    assert [r.n for r in df.select(T.normalize_label(F.col("t")).alias("n")).collect()] == ["net sales goods and 2nd_hand q1", "beneficio ba sico accio n", "利益 損失", "e te and co", "a b", "and", "", ""]
    assert [r.n for r in df.select(T.accent_free_label(F.col("t")).alias("n")).collect()][1:4] == ["beneficio basico accion", "利益 損失", "ete and co"]
    assert "octet_length" in planned(df.select(T.normalize_label(F.col("t"))))


def test_alternatives_stay_with_their_statement(spark):
    """the answers of all alternatives were sent and joined again."""
    from ledgerloom.operators import select as S

    wants = spark.createDataFrame([(1, 1, "Revenue || Loss on sale || Trade payables"), (2, 1, "payables || Revenue"), (3, 9, "Goods || Sales")], "req int, stmt int, caption string")
    found = S.find_alternatives(wants, _small_statements(spark))
    assert planned(found).count("Join ") == 1
    assert sorted(map(tuple, found.collect())) == [(1, 1, 1, None), (2, None, None, "not_found"), (3, None, None, "not_found")]


def test_optional_values_come_with_their_line(spark):
    """requests and lines were made and joined again for the value of a line that was at hand."""
    from ledgerloom.operators import select as S

    wants = spark.createDataFrame([(1, 1, "Loss on sale"), (2, 1, "payables"), (3, 1, "Zakat"), (4, 9, "Goods"), (5, 2, "Goods")], "req int, stmt int, caption string")
    found = S.optional_value(wants, _small_statements(spark).withColumn("value", F.get("values", F.lit(0))))
    assert planned(found).count("Join ") == 1
    assert sorted(map(tuple, found.collect())) == [(1, 2.0, None), (2, None, "near_match"), (3, 0.0, None), (4, 0.0, None), (5, 6.0, None)]


def test_blocks_meet_requests_once(spark):
    """lines were made and joined twice, once for the heading and once for the line below it."""
    from ledgerloom.operators import select as S

    rows = [(1, 0, "Assets", None), (1, 1, "Net Cash", "Assets"), (1, 2, "Cash", None), (2, 0, "Debt", None), (2, 1, "Debt, net", None)]
    wants = [(1, 1, "assets", "cash"), (2, 1, "Cash", "assets"), (3, 2, "debt", "net"), (4, 2, "equity", "net"), (5, 9, "debt", "net"), (6, 1, "assets cash", "cash"), (7, 9, "", "net")]
    found = S.find_block_row(spark.createDataFrame(wants, "req int, stmt int, block string, caption string"), spark.createDataFrame(rows, "stmt int, row int, caption string, heading string"))
    assert planned(found).count("Join ") == 1
    assert {r.req: (r.row, r.reason) for r in found.collect()} == {1: (None, "ambiguous_heading"), 2: (None, "ambiguous_heading"), 3: (None, "ambiguous_heading"), 4: (None, "no_heading"), 5: (None, "no_heading"), 6: (None, "no_heading"), 7: (None, "no_heading")}
    one = S.find_block_row(spark.createDataFrame([(1, 3, "assets", "cash")], "req int, stmt int, block string, caption string"), spark.createDataFrame([(3, 0, "Cash", None), (3, 1, "Assets", None), (3, 2, "Net Cash", None), (3, 3, "Cash", None)], "stmt int, row int, caption string, heading string"))
    assert [tuple(r) for r in one.collect()] == [(1, 2, None)]


def test_columns_meet_requests_once(spark):
    """columns were made and joined four times, and requests twice."""
    import datetime

    from ledgerloom.operators import select as S

    q, y = datetime.date(2026, 6, 30), datetime.date(2025, 12, 31)
    columns = [(1, 0, "Retail", "period", 3, q), (1, 1, "Retail", "period", 3, q), (1, 2, "Total", "period", 3, q), (1, 3, "Retail", "period", 6, q), (2, 0, "Retail", "period", 6, q), (2, 1, "Retail", "period", 9, q), (3, 0, "x", "point_in_time", None, q), (3, 1, "y", "period", 3, q), (3, 2, "z", "point_in_time", None, y)]
    cells = [(1, 0, 0, 5.0), (1, 1, 0, 5.0), (1, 2, 0, 10.0), (1, 3, 0, 9.0), (2, 0, 0, 1.0)]
    wants = [(1, 1, q, 3, False, "retail"), (2, 1, q, 3, False, "retail #2"), (3, 1, q, 3, False, None), (4, 1, y, 3, False, "retail"), (5, 1, q, 3, False, "wholesale"), (6, 9, q, 3, False, "retail"), (7, 2, q, 3, False, None), (8, 3, q, 3, True, None), (9, 3, q, 3, True, "z"), (10, 3, q, 3, True, "#5"), (11, 1, q, 3, False, "retail #4")]
    found = S.pick_column(
        spark.createDataFrame(wants, "req int, stmt int, target date, cadence int, balance boolean, header string"),
        spark.createDataFrame(columns, "stmt int, col int, header string, kind string, months int, end date"),
        spark.createDataFrame(cells, "stmt int, col int, row int, value double"),
    )
    assert planned(found).count("Join ") == 2
    got = {r.req: (r.col, r.months, r.reason) for r in found.collect()}
    assert got == {1: (0, 3, None), 2: (1, 3, None), 3: (2, 3, None), 4: (None, None, "no_period"), 5: (None, None, "no_header"), 6: (None, None, "no_columns"), 7: (0, 6, "cumulative"), 8: (0, None, None), 9: (2, None, None), 10: (None, None, "no_header"), 11: (None, None, "no_header")}


def test_new_labels_are_one_row_before_they_meet_old_ones(spark, tmp_path):
    """all rows of a new label were sent to meet the old ones, whose labels were told apart first."""
    from ledgerloom.operators.sinks import append_rows

    plans = []

    def keep(t):
        plans.append(planned(t))
        t.write.parquet(str(tmp_path / f"k{len(plans)}"))
        return spark.read.parquet(str(tmp_path / f"k{len(plans)}"))

    old = spark.createDataFrame([("a", 0, "Revenue"), ("a", 1, "Costs"), ("a", 2, "costs")], "doc string, ord long, label string")
    new = spark.createDataFrame([("a", "Capex", 4), ("a", "CAPEX", 3), ("a", "revenue", 1), ("a", "Tax", 9), ("b", "Costs", 5)], "doc string, label string, at int")
    out = append_rows(old, new, ["doc"], "label", [F.col("at")], keep)
    assert plans[0].index("LeftAnti") < plans[0].index("min_by") and plans[0].count("Aggregate") == 1
    assert sorted(map(tuple, out.collect())) == [("a", 0, "Revenue"), ("a", 1, "Costs"), ("a", 2, "costs"), ("a", 3, "CAPEX"), ("a", 4, "Tax"), ("b", 0, "Costs")]


def test_arrivals_read_orders_once(spark, tmp_path):
    """orders were joined and summed for each kind of arrival, and a few companies' states were spread over all of the session's partitions."""
    import datetime

    from ledgerloom.plans import readings
    from ledgerloom.streaming import gate

    assert "Join" not in planned(readings.arrivals(spark, "/root/testdata/sf0.001"))
    days = [datetime.date(2026, 3, 31), datetime.date(2026, 6, 30), datetime.date(2026, 12, 31)]
    spark.createDataFrame([(c, d, f"{c}{d}") for c in "abc" for d in days], "company string, period_end date, sha string").write.parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    out = gate.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), partitions=2)
    assert sorted((r.company, r.period_end, r.decision) for r in out.collect()) == [(c, d, x) for c in "abc" for d, x in zip(days, ("accepted", "accepted", "not_contiguous"))]
    assert sorted(p.name for p in (tmp_path / "state" / "state" / "0").iterdir() if p.name.isdigit()) == ["0", "1"]
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_cells_are_read_once(spark):
    """cells were made twice, once for their keys and once for their values."""
    from ledgerloom.operators import program

    terms = spark.createDataFrame([("Net", 0, 1, "Sales", False, 1.0), ("Net", 1, -1, "costs", False, 10.0), ("Net", 2, 1, "Zakat", True, 1.0), ("Bad", 0, 1, "Goodwill", False, 1.0), ("Bad", 1, 1, "Sales", False, 1.0)], "row string, term int, sign int, caption string, optional boolean, factor double")
    made = F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(c).alias("caption"), F.lit(v).cast("double").alias("value")) for k, c, v in (("a", "SALES", 5), ("a", "Costs", None), ("a", "costs ", 2), ("a", "Other", 9), ("b", "Rent", 1), (None, "Sales", 1))]))
    out = program.resolve(terms, spark.range(1).select(made), ["k"])
    assert planned(out).count("Range (") == 1
    got = {(r.k, r.row): (r.value, r.n_terms, r.n_optional_missing, r.reason) for r in out.collect()}
    no = "no row captioned "
    assert got == {("a", "Net"): (-15.0, 4, 1, None), ("a", "Bad"): (None, 2, 0, no + "goodwill"), ("b", "Net"): (None, 3, 1, no + "sales"), ("b", "Bad"): (None, 2, 0, no + "goodwill"), (None, "Net"): (None, 3, 1, no + "sales"), (None, "Bad"): (None, 2, 0, no + "goodwill")}


def test_tables_are_mended_in_their_row(spark):
    """tables, periods, texts, headers and heads met in five joins, and all lines of all pages were worked out for tables that were read right."""
    import json

    from ledgerloom.operators import verified

    table = lambda title, rows: {"title": title, "units": None, "columns": ["30 June 2026"], "rows": [{"caption": c, "values": [v]} for c, v in rows]}
    one = {"pages": {"10": {"tables": [table("", [("Cash", "1,250"), ("-", None)])]}, "9": {"tables": [table("Balance sheet", [("Cash", "1,200"), ("Debt", "7")]), table("Notes", [("x", "n/a")])]}}}
    documents = spark.createDataFrame([("a", json.dumps(one)), ("b", json.dumps({"pages": {"1": {"tables": [table("Other", [("Tax", "5.5")])]}}})), ("c", None)], "path string, json string")
    pages = spark.createDataFrame([("a", 9, "(\n1,200\nDebt 7"), ("a", 10, "Cash 1,350 "), ("b", 1, " "), ("z", 1, "Cash 1")], "path string, page int, text string")
    out = verified.read(documents, pages)
    assert "Join" not in planned(out) and planned(out).count("Aggregate [") == 1
    got = sorted((r.path, r.page, r.ord, r.head_page, r.line, r.caption, r["values"], r.how, r.passes, r.periods) for r in out.collect())
    june = '[{"end":"2026-06-30"}]'
    want = [("a", 9, 0, 9, 0, "Cash", [1200.0], ["printed"], 1, june), ("a", 9, 0, 9, 1, "Debt", [7.0], ["printed"], 1, june), ("a", 10, 0, 9, 0, "Cash", [1350.0], ["taken from the line"], 2, june), ("b", 1, 0, 1, 0, "Tax", [5.5], ["unchecked"], 1, june)]
    assert got == want


def test_units_need_no_mending(spark):
    """the scale of statements was read off lines whose figures were mended first."""
    from ledgerloom.plans import readings

    text = planned(readings.a8_units(spark, "/root/testdata/sf0.001"))
    assert "taken from the line" not in text and "Join" not in text


def test_read_issues_are_counted_once(spark):
    """statements were read once for their figures and once for their units, and met the documents by joins."""
    from ledgerloom.operators import verified

    rows = [("a", 1, "units", ["not printed", None]), ("a", 2, "units", ["sign of the line", "taken from the line"]), ("b", 1, None, ["taken from the total", "printed"]), ("b", 1, None, ["unchecked", "witnessed"]), ("d", 1, None, ["printed"])]
    statements = spark.createDataFrame(rows, "path string, page int, units string, how array<string>")
    out = verified.issues(statements, spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "path string"))
    assert "Join" not in planned(out) and planned(out).count("LogicalRDD") == 2
    got = sorted(map(tuple, out.collect()), key=repr)
    want = [("a", 1, "llm_figure_not_printed", 1), ("a", 2, "llm_figure_corrected_from_text", 2), ("b", 1, "llm_figure_corrected_from_total", 1), ("b", 1, "llm_unchecked", 1), ("b", None, "units_unknown", 1), ("c", None, "no_statements", 1)]
    assert got == sorted(want, key=repr)
