"""Queries on whole mapping programs: the language executed over statements, columns, rows and history."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import engine
from ..sources.tables import mapping_rows
from .registry import Table, expected, load, query

_PROGRAM = json.dumps({"company": "acme", "rows": [
    {"label": "Revenue", "section": "income_statement", "pdf": "Revenue"},
    {"label": "SGA", "section": "income_statement", "pdf": ["-Selling costs", "-Admin costs"]},
    {"label": "Tax", "section": "income_statement", "pdf": ["Zakat?", "Income tax"]},
    {"label": "Capex", "section": "cash_flow", "pdf": "Purchase of plant", "sign": "flip"},
    {"label": "Margin", "section": "income_statement", "pdf": "Gross margin", "scale": "percent"},
    {"label": "Cash", "section": "balance_sheet", "pdf": "Cash", "column": "Current"},
    {"label": "Net debt", "section": "balance_sheet", "pdf": ["Loans ## Non-current", "-Cash ## Current", "const:2"]},
    {"label": "GIMSA EBITDA", "section": "income_statement", "pdf": "GIMSA > EBITDA", "statement": "title:Selected items || nothing"},
    {"label": "Second", "section": "cash_flow", "pdf": "Interest paid #2"},
    {"label": "Shares", "section": "other", "value": 12.5},
    {"label": "Rating", "section": "other", "carry_forward": True},
    {"label": "Goodwill", "section": "balance_sheet", "pdf": None},
    {"label": "Lost", "section": "income_statement", "pdf": "No such line"},
    {"label": "Vague", "section": "income_statement", "pdf": "costs"},
    {"label": "No prior", "section": "cash_flow", "pdf": "Dividends paid"},
    {"label": "Mixed", "section": "income_statement", "pdf": ["Revenue", "Purchase of plant @ cash_flow"]},
]})

_STATEMENTS = Table("company string, stmt int, kind string, title string, note int, ord int, readable boolean, units string", [("acme", 1, "income_statement", "Income statement", None, 0, True, "thousands"), ("acme", 2, "balance_sheet", "Balance sheet", None, 1, True, "thousands"), ("acme", 3, "cash_flow", "Cash flows", None, 2, True, "thousands"), ("acme", 4, "other", "Selected items", None, 3, True, "millions")])
_COLUMNS = Table("stmt int, col int, header string, kind string, months int, end date", [(1, 0, "Q2 2026", "period", 3, "2026-06-30"), (1, 1, "Q2 2025", "period", 3, "2025-06-30"), (2, 0, "Current 30 June 2026", "point_in_time", None, "2026-06-30"), (2, 1, "Non-current 30 June 2026", "point_in_time", None, "2026-06-30"), (3, 0, "6M 2026", "period", 6, "2026-06-30"), (4, 0, "2Q26", "period", 3, "2026-06-30")])
_ROWS = Table("stmt int, row int, caption string, heading string, values array<double>", [
    (1, 0, "Revenue", None, [5000.0, 4000.0]), (1, 1, "Selling costs", None, [-700.0, -600.0]), (1, 2, "Admin costs", None, [None, -5.0]), (1, 3, "Income tax", None, [-90.0, -80.0]), (1, 4, "Gross margin", None, [42.5, 40.0]),
    (2, 0, "Cash", None, [800.0, None]), (2, 1, "Loans", None, [100.0, 3000.0]), (3, 0, "Purchase of plant", None, [-1000.0]), (3, 1, "Interest paid", None, [-1.0]), (3, 2, "Interest paid", None, [-6.0]), (3, 3, "Dividends paid", None, [-9.0]),
    (4, 0, "GRUMA", None, [None]), (4, 1, "EBITDA", None, [90.0]), (4, 2, "GIMSA", None, [None]), (4, 3, "EBITDA", None, [50.3]),
])
_HISTORY = Table("company string, label string, end date, value double", [("acme", "Capex", "2026-03-31", 0.4), ("acme", "Second", "2026-03-31", -0.002), ("acme", "Rating", "2025-12-31", 3.0), ("acme", "Rating", "2026-03-31", 4.0)])


def _run(spark):
    mapping = mapping_rows(Table("json string", [(_PROGRAM,)]).df(spark))
    return engine.run(mapping, _STATEMENTS.df(spark), _COLUMNS.df(spark), _ROWS.df(spark), _HISTORY.df(spark), "2026-06-30", 3, "millions")


_RESULTS = [
    ("Revenue", 5.0, None), ("SGA", 0.7, None), ("Tax", -0.09, None), ("Capex", 1.4, None), ("Margin", 0.425, None), ("Cash", 0.8, None), ("Net debt", 2.202, None), ("GIMSA EBITDA", 50.3, None), ("Second", -0.004, None),
    ("Shares", 12.5, None), ("Rating", 4.0, None), ("Goodwill", None, None), ("Lost", None, "not_found"), ("Vague", None, "ambiguous"), ("No prior", None, "decumulation_missing_prior"), ("Mixed", None, "spans_differ"),
]


@query("o3_run_program", expected("label string, value double, reason string", _RESULTS))
def o3(spark, sf_dir):
    """A program in the mapping language, row by row: sums, dashes, options, columns, blocks, occurrences, scale, prior periods and signs."""
    return _run(spark).select("label", F.round("value", 6).alias("value"), "reason")


@query("o4_lineage", expected("label string, captions string, adjustments array<string>", [("SGA", "Selling costs + Admin costs", ["scaled thousands to millions"]), ("Capex", "Purchase of plant", ["scaled thousands to millions", "less 1 prior periods", "sign flipped"]), ("Margin", "Gross margin", ["own scale"]), ("GIMSA EBITDA", "EBITDA", [])]))
def o4(spark, sf_dir):
    """Every value says which lines it was read from and what was done to it."""
    return _run(spark).where("label in ('SGA', 'Capex', 'Margin', 'GIMSA EBITDA')").select("label", "source.captions", "adjustments")


@query("m18_stages_from_files", "SELECT n_name AS company, label, value, reason FROM nation, (VALUES ('Revenue', 1250000.0, NULL), ('Margin', 350000.0, NULL), ('Land', NULL, 'not_found'), ('Tax', 7.5, NULL)) v(label, value, reason)")
def m18(spark, sf_dir):
    """Mappings, tables and history of every nation written as files, and a run that starts from them."""
    from ..operators import stages
    from .writing import _shared

    base = _shared(spark)
    names = [r[0] for r in load(spark, sf_dir, "nation").select("n_name").collect()]  # 25 file names
    table = {"pages": {"3": {"tables": [{"title": "Income statement", "units": "SAR '000", "columns": ["Three months ended 30 June 2026"], "rows": [{"caption": "Revenue", "values": ["1,250"]}, {"caption": "Costs", "values": ["(900)"]}]}]}}}
    rows = [{"label": "Revenue", "section": "income_statement", "pdf": "Revenue"}, {"label": "Margin", "section": "income_statement", "pdf": ["Revenue", "Costs"]}, {"label": "Land", "section": "income_statement", "pdf": "Land"}, {"label": "Tax", "section": "income_statement", "value": 7.5}]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in names:
        for kind, doc in (("tables", table), ("mappings", {"mapping_version": "1", "company": name, "sheet": "model", "rows": rows})):
            where = jvm.org.apache.hadoop.fs.Path(f"{base}/{kind}/{name}.json")
            out = where.getFileSystem(conf).create(where)
            out.write(bytearray(json.dumps(doc).encode()))
            out.close()
    spark.createDataFrame([], "company string, label string, end date, value double").write.json(f"{base}/history")
    found = stages.resolve(spark, f"{base}/mappings", f"{base}/tables", f"{base}/history", "2026-06-30", 3, "units")
    return found.select(F.regexp_replace("company", "%20", " ").alias("company"), "label", "value", "reason")
