"""Operators against plain Python, at edges and on random input."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import formula, periods, text
from ledgerloom.operators import basis, geometry, select, sinks
from ledgerloom.streaming import periods as streams


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r[0] for r in df.select("i", expression(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def plain_label(s):
    """Letters and digits of the decomposed text; every other character, marks too, parts words."""
    kept = [" and " if c == "&" else c if c == "_" or unicodedata.category(c)[0] in "LN" else " " for c in unicodedata.normalize("NFKD", s or "")]
    return " ".join("".join(kept).split()).lower()


def test_normalize_label(spark):
    rng = random.Random(1)
    values = ["Año & más", "  A--b__c ", None, "", "Ünïcödé", "Cash (restricted)", "ñandú É"] + ["".join(rng.choices("aB é&,.-ñ1_ü(", k=12)) for _ in range(200)]
    assert column(spark, values, text.normalize_label) == [plain_label(v) for v in values]


@pytest.mark.parametrize("figure", [0.0, 7.0, 12.5, 1234.0, 1234567.25])
def test_parse_number_reads_what_is_printed(spark, figure):
    """A magnitude printed in every form, with and without its sign."""
    plain, grouped = f"{figure:.2f}", f"{figure:,.2f}"
    positive = [plain, grouped, f" {grouped} ", f"({plain}"]
    negative = [f"-{plain}", f"({grouped})", f"( {plain} )", f"{grouped}-", f"{plain} -", f"−{grouped}", f"(-{plain})"]
    assert column(spark, positive, text.parse_number) == [figure] * len(positive)
    assert column(spark, negative, text.parse_number) == [-figure] * len(negative)


def test_parse_number_refuses_the_rest(spark):
    values = [None, "", " ", "()", "-", "--5", "1.", ".5", "1.2.3", "5 6", "abc", "5%", "1e5", "(5)-"]
    assert column(spark, values, text.parse_number) == [None] * len(values)


def test_literal_formulas():
    cases = {"=1+2*3": 7, "=-2^2": -4, "=2^-1": 0.5, "=(1+2)*(3-4)/2": -1.5, "=+5": 5, "=1/0": None, "=1+": None, "=A1": None, "5": None, "=": None, "=1 2": None, "=1e5": None, "=2**3": None}
    assert {k: formula.evaluate(k) for k in cases} == {k: None if v is None else float(v) for k, v in cases.items()}


@pytest.mark.parametrize("day_first", [True, False])
def test_numeric_dates(spark, day_first):
    got = column(spark, ["03/04/2026", "31.12.25", "12-31-2025", "2026-02-31", "99/99/2026", None, "x"], lambda c: periods.numeric_date(c, F.lit(day_first)))
    first = "2026-04-03" if day_first else "2026-03-04"
    assert [str(d) if d else None for d in got] == [first, "2025-12-31", "2025-12-31", "2026-02-28", None, None, None]


def test_lines_of_words_are_stable_under_order(spark):
    words = [(1, f"w{i}", float(i % 4) * 50, float(i % 4) * 50 + 20, 10.0 * (i // 4) + (i % 3)) for i in range(40)]
    a = geometry.lines(spark.createDataFrame(words, "page int, text string, x0 double, x1 double, top double")).collect()
    random.Random(0).shuffle(words)
    b = geometry.lines(spark.createDataFrame(words, "page int, text string, x0 double, x1 double, top double").repartition(3)).collect()
    assert {(r["text"], r["line"]) for r in a} == {(r["text"], r["line"]) for r in b} and max(r["line"] for r in a) == 9


def test_ambiguity_is_refused_not_picked(spark):
    rows = spark.createDataFrame([(1, 0, "Trade payables", [1.0]), (1, 1, "Other payables", [2.0]), (1, 2, None, [3.0])], "stmt int, row int, caption string, values array<double>")
    asked = spark.createDataFrame([(1, 1, ["payables"]), (2, 1, [""]), (3, 1, None), (4, 9, ["Trade payables"])], "req int, stmt int, captions array<string>")
    got = {r["req"]: (r["row"], r["reason"]) for r in select.find_row(asked, rows).collect()}
    assert got == {1: (None, "ambiguous"), 2: (None, "not_found"), 3: (None, "not_found"), 4: (None, "not_found")}


def test_decumulation_round_trip(spark):
    rng = random.Random(3)
    quarters = [(c, f"{y}-{m:02d}-{30 if m in (6, 9) else 31}", float(rng.randint(-99, 99))) for c in "ab" for y in (2024, 2025) for m in (3, 6, 9, 12)]
    facts = spark.createDataFrame(quarters, "company string, period_end string, value double").withColumn("period_end", F.col("period_end").cast("date"))
    ytd = basis.year_to_date(facts, ["company"]).select("company", "period_end", "months", F.col("ytd").alias("printed"))
    got = {(r["company"], str(r["period_end"])): r["value"] for r in basis.decumulate(ytd, facts, ["company"], 3).collect()}
    assert got == {(c, d): v for c, d, v in quarters}


def test_an_occupied_period_is_refused(spark, tmp_path):
    df = spark.createDataFrame([("a", "r", 1.0)], "company string, row string, value double")
    path = str(tmp_path / "out")
    sinks.append_period(spark, df, path, "2026-06-30")
    sinks.append_period(spark, df.withColumn("company", F.lit("b")), path, "2026-06-30")
    with pytest.raises(sinks.Refused):
        sinks.append_period(spark, df, path, "2026-06-30")
    assert spark.read.parquet(path).count() == 2


def test_stream_drops_content_that_came_before(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.sql("SELECT timestamp'2026-01-01' + make_interval(0, 0, 0, 0, id % 5) AS ts, concat('c', id % 7) AS sha, double(id) AS value FROM range(50)").repartition(3).write.parquet(path)
    stream = streams.distinct_content(streams.read_events(spark, path, spark.read.parquet(path).schema), "sha", "ts")
    out = stream.writeStream.format("memory").queryName("distinct_content").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    out.awaitTermination()
    assert sorted(r[0] for r in spark.table("distinct_content").select("sha").collect()) == [f"c{i}" for i in range(7)]
