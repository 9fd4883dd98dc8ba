"""Verified statements, the package source, the stream's gate and ordered numbering, at their edges."""

import datetime
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import verified
from ledgerloom.operators.numbering import numbered
from ledgerloom.sources import packages_source
from ledgerloom.streaming import gate


# --- verified statements -----------------------------------------------------------------------------------


def table(rows, title="Statement of cash flows", columns=("June 30, 2026", "June 30, 2025"), units="TRY thousands"):
    return {"title": title, "units": units, "columns": list(columns), "rows": [{"caption": c, "values": list(v)} for c, v in rows]}


def read(spark, pages, texts, transcripts=None):
    """[(page, head_page, units, caption, values, how)] of one document."""
    documents = spark.createDataFrame([("x", json.dumps({"pages": {str(p): {"tables": t} for p, t in pages.items()}}))], "path string, json string")
    text = lambda d: spark.createDataFrame([("x", p, t) for p, t in d.items()], "path string, page int, text string")
    found = verified.read(documents, text(texts), text(transcripts) if transcripts else None)
    return [(r["page"], r["head_page"], r["units"], r["caption"], r["values"], r["how"]) for r in found.orderBy("page", "ord", "line").collect()]


def one(spark, caption, values, text, **of):
    return read(spark, {1: [table([(caption, values)], **of)]}, {1: text})[0][4:]


LINE = "Interest received 3,923,612 1,634,030"


def test_a_misread_digit_is_taken_from_the_line(spark):
    assert one(spark, "Interest received", ["3,929,512", "1,634,030"], LINE) == ([3923612.0, 1634030.0], ["taken from the line", "printed"])
    more = LINE + "\nCash outflows from the disposal of equity or debt instruments 5 (4,405) (8,698)"
    assert one(spark, "Cash outflows from the disposal of equity or debt instruments", ["(4,605)", "(8,098)"], more)[0] == [-4405.0, -8698.0]


@pytest.mark.parametrize("values, text", [(["39,512", "1,634,030"], LINE), (["3,929,512", "1,634,030"], "Interest received 3,923,612 1,700,000\nOther 1,634,030"), (["3,929,512", "1,634,030"], LINE + "\n" + LINE.replace("612", "613")), (["3,929,512", "1,634,030"], "1,634,030")])
def test_a_misread_digit_stays_where_the_line_is_not_sure(spark, values, text):
    assert one(spark, "Interest received", values, text)[1] == ["not printed", "printed"]


def test_dotted_tables(spark):
    text = "Costo de ventas (909.333.911) 1.234\nCaja 1.512.033.764 (5.000)"
    rows = [("Costo de ventas", ["(99.333.931)", None]), ("Caja", ["1.512.033.764", "5.000"])]
    got = read(spark, {1: [table(rows, units=None)]}, {1: text})
    # The first row has one figure, and the line's last figure is not it; the second has its sign from the line.
    assert [(r[4], r[5]) for r in got] == [([-99333931.0, None], ["not printed", None]), ([1512033764.0, -5000.0], ["printed", "sign of the line"])]
    assert one(spark, "Costo de ventas", ["(99.333.931)", "1.234"], text, units=None) == ([-909333911.0, 1234.0], ["taken from the line", "printed"])


def test_a_mended_figure_mends_the_next(spark):
    """The total proves the first figure; with it the line is known to be in its place and gives the second, whose digits differ."""
    text = "Alfa 1.000.500 2.345\nBeta 2.000.000 88 1.000\nTotal 3.000.500 88"
    rows = [("Alfa", ["100.050", None, "234"]), ("Beta", ["2.000.000", "88", "1.000"]), ("Total", ["3.000.500", "88", None])]
    got = read(spark, {1: [table(rows, columns=("a", "b", "c"))]}, {1: text})
    assert got[0][4:] == ([1000500.0, None, 2345.0], ["taken from the total", None, "taken from the line"])


def test_two_open_figures_of_a_block_stay_open(spark):
    rows = [("One", ["1,00", "5"]), ("Two", ["2,00", "6"]), ("Total", ["3,000", "11"])]
    got = read(spark, {1: [table(rows)]}, {1: "One 1,000 5\nTwo 2,000 6\nTotal 3,000 11"})
    assert [r[5][0] for r in got] == ["not printed", "not printed", "printed"]
    got = read(spark, {1: [table([("One", ["1,000", "5"]), *rows[1:]])]}, {1: "One 1,000 5\nTwo 2,000 6\nTotal 3,000 11"})
    assert (got[1][4], got[1][5]) == ([2000.0, 6.0], ["taken from the total", "printed"])


def test_pages_without_a_text(spark):
    rows = {1: [table([("Revenue", ["1", "2"])])]}
    assert read(spark, rows, {1: " "})[0][5] == ["unchecked", "unchecked"]
    assert read(spark, rows, {1: None}, {1: "Revenue 1 33"})[0][5] == ["witnessed", "not printed"]
    assert read(spark, rows, {1: "Revenue 1 2"}, {1: "Revenue 7 7"})[0][5] == ["printed", "printed"]


def test_tables_that_go_on(spark):
    same = ("30 June 2026", "31 December 2025")
    row = lambda c: [(c, ["1", "2"])]
    first = table(row("a"), "[210000] Statement of financial position", same, "Currency: MXN")
    heads = lambda pages, texts=None: [(r[0], r[1], r[2]) for r in read(spark, pages, texts or {1: "x"})]
    assert heads({1: [first], 2: [table(row("b"), "", same)], 3: [table(row("c"), "", same)]}) == [(1, 1, "units"), (2, 1, "units"), (3, 1, "units")]
    assert heads({1: [first], 3: [table(row("b"), "", same)]})[1][1] == 3  # a page lies between
    assert heads({1: [first], 2: [table(row("b"), "", ("30 June 2026", "30 June 2025"))]})[1][1] == 2  # other periods
    assert heads({1: [table(row("a"), "Debt", same)], 2: [table(row("b"), "", same)]})[1][1] == 2  # a kind that doesn't go on
    long_, short = "Estado de Flujo\nCorrespondiente a los periodos", "Estado de Flujo"
    assert heads({1: [table(row("a"), long_, same)], 2: [table(row("b"), short, same)]})[1][1] == 1
    assert heads({1: [table(row("a"), long_, same)], 3: [table(row("b"), short, same)]})[1][1] == 3
    texts = {n: f"KOF Consolidado\nClave: KOF\nbody {n}" for n in range(1, 7)}
    assert heads({1: [first], 2: [table(row("b"), "KOF Consolidado", same)]}, texts)[1][1] == 1


def test_issues(spark):
    documents = spark.createDataFrame([("x", json.dumps({"pages": {"1": {"tables": [table([("Revenue", ["1", "9"])], units=None)]}}})), ("y", json.dumps({"pages": {}})), ("z", None)], "path string, json string")
    pages = spark.createDataFrame([("x", 1, "Revenue 1 2 and 3 more")], "path string, page int, text string")
    got = {tuple(r) for r in verified.issues(verified.read(documents, pages), documents).collect()}
    assert got == {("x", 1, "llm_figure_corrected_from_text", 1), ("x", None, "units_unknown", 1), ("y", None, "no_statements", 1), ("z", None, "no_statements", 1)} or ("x", 1, "llm_figure_not_printed", 1) in got


# --- the package source ------------------------------------------------------------------------------------


@pytest.fixture
def folder(tmp_path):
    for k in range(6):
        with zipfile.ZipFile(tmp_path / f"p{k}.zip", "w") as z:
            for m in range(3):
                z.writestr(f"m{m}.{'json' if m else 'txt'}", f"{k}-{m}" * (1000 if k == 5 else 1))
            z.writestr("empty/", "")
    return tmp_path


def test_schema_and_members(spark, folder):
    packages_source.register(spark)
    df = spark.read.format("packages").load(str(folder))
    assert [f"{n} {t.replace('bigint', 'long')}" for n, t in df.dtypes] == packages_source.SCHEMA.split(", ")
    got = {(r["path"].rsplit("/", 1)[1], r["member"]): bytes(r["content"]) for r in df.collect()}
    assert len(got) == 18 and got["p3.zip", "m1.json"] == b"3-1" and len(got["p5.zip", "m0.txt"]) == 3000
    assert df.where("size = 3").count() == 15


def test_partitions_follow_bytes(folder):
    sizes = sorted(p.stat().st_size for p in folder.iterdir())
    parts = lambda most: packages_source.Reader({"path": str(folder), "partitionbytes": str(most)}).partitions()
    assert len(parts(1 << 30)) == 1 and len(parts(1 << 30)[0].files) == 6
    two = parts(2 * sizes[0])
    assert all(sum(s for _, s in p.files) <= 2 * sizes[0] or p.shares > 1 for p in two) and sum(len(p.files) for p in two if p.shares == 1) + len({f for p in two if p.shares > 1 for f in p.files}) == 6
    cut = [p for p in parts(sizes[0] - 1) if p.files[0][0].endswith("p5.zip")]
    assert [p.share for p in cut] == list(range(cut[0].shares)) and cut[0].shares >= 2
    reader = packages_source.Reader({"path": str(folder), "partitionbytes": str(sizes[0] - 1)})
    assert sorted(r[1] for p in cut for r in reader.read(p)) == ["m0.txt", "m1.json", "m2.json"]


def test_filters_are_taken_over(spark, folder):
    packages_source.register(spark)
    df = spark.read.format("packages").load(str(folder))
    wanted = df.where(F.endswith("member", F.lit(".json")) & F.contains("path", F.lit("p3")) & (F.col("size") > 1))
    assert sorted(r["member"] for r in wanted.collect()) == ["m1.json", "m2.json"]
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringContains

    reader = packages_source.Reader({"path": str(folder)})
    left = [*reader.pushFilters([StringContains(("path",), "p3"), EqualTo(("member",), "m1.json"), GreaterThan(("size",), 1)])]
    assert left == [GreaterThan(("size",), 1)]
    (only,) = reader.partitions()
    assert [f[0].rsplit("/", 1)[1] for f in only.files] == ["p3.zip"] and [r[1] for r in reader.read(only)] == ["m1.json"]
    assert df.where("member is null").count() == 0 and df.where("member in ('m0.txt')").count() == 6


def test_bad_packages_and_empty_folders(spark, folder, tmp_path_factory):
    packages_source.register(spark)
    (folder / "bad.zip").write_bytes(b"PK not")
    load = lambda bad: spark.read.format("packages").option("badPackages", bad).option("content", "false").load(str(folder))
    assert load("skip").count() == 18
    assert [r["path"].rsplit("/", 1)[1] for r in load("keep").where("member is null").collect()] == ["bad.zip"]
    assert load("keep").where("content is not null").count() == 0
    with pytest.raises(Exception, match="no zip file"):
        load("fail").collect()
    assert spark.read.format("packages").load(str(tmp_path_factory.mktemp("none"))).count() == 0


# --- the stream's gate -------------------------------------------------------------------------------------


class Cell:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class Map(dict):
    containsKey = dict.__contains__
    updateValue = dict.__setitem__


def decide(*batches, step=3):
    import pandas as pd

    g = gate.Gate(step)
    g.last, g.periods, g.contents = Cell(), Map(), Map()
    day = lambda s: datetime.date.fromisoformat(s) if s else None
    return [d for b in batches for part in g.handleInputRows(("A",), iter([pd.DataFrame([(day(e), s) for e, s in b], columns=["period_end", "sha"])]), None) for d in part["decision"]]


def test_gate_decisions():
    assert decide([("2025-12-31", "a"), ("2026-06-30", "c"), ("2026-03-31", "b")]) == ["accepted"] * 3
    assert decide([("2026-03-31", "b")], [("2026-03-31", "b"), ("2026-03-31", "x")], [("2025-12-31", "a")], [("2026-09-30", "d")], [("2026-06-30", "c")], [("2026-09-30", "d")]) == ["accepted", "repeated", "occupied", "late", "not_contiguous", "accepted", "accepted"]
    assert decide([(None, "a"), ("2026-03-31", "a")], [("2027-03-31", "y")], step=12) == ["no_dates", "accepted", "accepted"]
    assert decide([("2026-03-31", "a"), ("2026-03-31", "b")]) == ["accepted", "occupied"]


# --- numbering ---------------------------------------------------------------------------------------------


def test_numbering_is_in_order_over_many_partitions(spark, tmp_path):
    rows = [(k % 3 if k % 7 else None, (k * 7919) % 1000, k) for k in range(1000)] + [(9, 5, -1)]
    df = spark.createDataFrame(rows, "g int, x int, k int").repartition(7)
    n = iter(range(100))

    def keep(t):
        path = str(tmp_path / f"t{next(n)}")
        t.write.parquet(path)
        return spark.read.parquet(path)

    got = numbered(df, ["g"], [F.col("x"), F.col("k")], keep).collect()
    for g in {r[0] for r in rows}:
        own = sorted((r["x"], r["k"]) for r in got if r["g"] == g)
        assert [(r["x"], r["k"]) for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["place"])] == own
        assert sorted(r["place"] for r in got if r["g"] == g) == list(range(len(own))) and {r["total"] for r in got if r["g"] == g} == {len(own)}
    assert sorted(r["place"] for r in numbered(df, [], [F.col("k")], keep).collect()) == list(range(1001))
    assert numbered(df.limit(0), ["g"], [F.col("x")], keep).collect() == []


# --- versions, contained titles, damaged workbooks ---------------------------------------------------------


def test_versions(spark, tmp_path):
    from ledgerloom.operators.sinks import Refused
    from ledgerloom.operators.versions import Versions

    store = Versions(spark, str(tmp_path / "t"), ["k"])
    assert store.latest() == 0
    rows = lambda *r: spark.createDataFrame(list(r), "k string, label string, v string")
    all_ = lambda n=None: sorted(map(tuple, store.read(n).select("k", "label", "v").collect()))
    assert store.replace(rows(("a", "x", "1"), ("a", "y", "2"), ("b", "x", "3")), 0) == 1
    assert store.replace(rows(("a", "x", "9")), 1) == 2
    assert all_() == [("a", "x", "9"), ("b", "x", "3")] and all_(1) == [("a", "x", "1"), ("a", "y", "2"), ("b", "x", "3")]
    with pytest.raises(Refused):
        store.replace(rows(("b", "x", "0")), 1)
    (tmp_path / "t" / "data" / "written_in=3").mkdir()  # a writer died before its commit
    assert all_() == [("a", "x", "9"), ("b", "x", "3")]
    changes = rows(("a", "x", "8"), ("a", "x", "8"), ("b", "x", "5"), ("b", "x", "6"), ("c", "x", "7"))
    version, conflicts = store.upsert(changes, ["label"], "v", 2)
    assert version == 3 and all_() == [("a", "x", "8"), ("b", "x", "3")]
    assert [(r["k"], r["proposals"]) for r in conflicts.collect()] == [("b", ["5", "6"])]
    assert {(r["k"], r["since"]) for r in store.parts().collect()} == {("a", 3), ("b", 1)}  # b's files were not written again
    assert store.replace(rows().limit(0), 3, rows(("b", "", ""))) == 4 and all_() == [("a", "x", "8")]
    assert sorted((r["k"], r["version"], r["current"]) for r in store.past().where("k = 'b' or version = 3").collect()) == [("a", 3, True), ("b", 1, False)]


def test_two_writers_on_one_version(spark, tmp_path):
    from ledgerloom.operators.sinks import Refused
    from ledgerloom.operators.versions import Versions

    a, b = (Versions(spark, str(tmp_path / "t"), ["k"]) for _ in range(2))
    b.latest = lambda: 0  # it looked before the other one had written
    a.replace(spark.createDataFrame([("a", 1)], "k string, v int"), 0)
    (tmp_path / "t" / "data" / "written_in=1" / "_SUCCESS").unlink(missing_ok=True)
    with pytest.raises(Refused):
        b._commit(1)


def test_containing(spark):
    import random

    from ledgerloom.operators.lookup import containing

    rng = random.Random(3)
    texts = ["".join(rng.choices("ab é", k=rng.randint(0, 12))) for _ in range(120)] + [None, "", "aaa aaa", "日本語のテキスト"]
    names = ["".join(rng.choices("ab é", k=rng.randint(1, 5))) for _ in range(40)] + ["", "日本", "zzz", "aaa aaa and more", "a", "a"]
    lines = spark.createDataFrame([*enumerate(texts)], "i int, text string")
    asked = spark.createDataFrame([*enumerate(names)], "j int, name string")
    got = sorted((r["i"], r["j"]) for r in containing(lines, asked).collect())
    assert got == sorted((i, j) for i, t in enumerate(texts) for j, n in enumerate(names) if t is not None and n and n in t)


def test_ordered_append(spark, tmp_path):
    from ledgerloom.operators.sinks import append_rows

    n = iter(range(10))

    def keep(t):
        path = str(tmp_path / f"k{next(n)}")
        t.write.parquet(path)
        return spark.read.parquet(path)

    old = spark.createDataFrame([("a", 0, "Revenue", "x"), ("a", 1, "Costs", "y")], "doc string, ord long, label string, note string")
    new = spark.createDataFrame([("a", "COSTS", 1), ("a", "Capex", 3), ("a", "Tax", 2), ("a", "capex", 9), ("b", "Sales", 5)], "doc string, label string, place_ int")
    out = append_rows(old, new, ["doc"], "label", [F.col("place_")], keep)
    assert sorted(map(tuple, out.collect()), key=repr) == [("a", 0, "Revenue", "x"), ("a", 1, "Costs", "y"), ("a", 2, "Tax", None), ("a", 3, "Capex", None), ("b", 0, "Sales", None)]


def test_run_once_without_input(spark, tmp_path):
    from ledgerloom.streaming import periods as streams

    (tmp_path / "in").mkdir()
    stream = streams.windowed(streams.read_events(spark, str(tmp_path / "in"), "ts timestamp, kind string, value double"), "ts", ["kind"], "value")
    assert streams.run_once(stream, str(tmp_path / "out"), str(tmp_path / "state")).collect() == []


def test_columns_to_date(spark):
    from ledgerloom.functions.periods import says_to_date

    said = ["YTD 2026", "Acum. 2025", "Acumulado 2025", "acumulada", "Ene-Jun Acum 26", "2026", "acumen 2026", None]
    df = spark.createDataFrame([*enumerate(said)], "i int, h string").select("i", says_to_date(F.col("h")).alias("x")).orderBy("i")
    assert [bool(r["x"]) for r in df.collect()] == [True, True, True, True, True, False, False, False]
