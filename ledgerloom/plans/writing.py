"""Queries on sinks and streams (group L)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..operators import program, sinks
from ..streaming import periods as streams
from .facts import QUARTERLY, quarterly
from .language import _PROGRAM
from .registry import ORACLES, Table, expected, load, query


def _shared(spark) -> str:
    """A fresh folder below the one that the cluster shares."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/ledgerloom-sinks/{uuid.uuid4().hex}"


@query("l1_append_period", f"WITH q AS ({QUARTERLY}) SELECT company, caption, period_end, value FROM q WHERE period_end IN (DATE '2000-12-31', DATE '2001-03-31')")
def l1(spark, sf_dir):
    """Two periods appended as partitions; a period that is there already is refused."""
    path, facts = _shared(spark), quarterly(spark, sf_dir).where("period_end in (date'2000-12-31', date'2001-03-31')").cache()
    for end in ("2000-12-31", "2001-03-31"):
        sinks.append_period(spark, facts.where(F.col("period_end") == F.lit(end).cast("date")).drop("period_end"), path, end)
    try:
        sinks.append_period(spark, facts.where("period_end = date'2001-03-31'").drop("period_end"), path, "2001-03-31")
    except sinks.Refused:
        pass
    else:
        raise AssertionError("an occupied period was written again")
    facts.unpersist()
    return spark.read.parquet(path).select("company", "caption", "period_end", "value")


@query("l2_copy_formulas", expected("formula string, copied string", [("=C4+C5", "=D4+D5"), ("=$C$4*C5", "=$C$4*D5"), ("=SUM(B2:C2)", "=SUM(C2:D2)"), ("=C$1", "=D$1")]))
def l2(spark, sf_dir):
    return Table("formula string", [("=C4+C5",), ("=$C$4*C5",), ("=SUM(B2:C2)",), ("=C$1",)]).df(spark).select("formula", sinks.shift_formula(F.col("formula"), 3, 4).alias("copied"))


@query("l4_audit_rows", f"""
    SELECT company, period_end, "row", CASE WHEN reason IS NOT NULL THEN 'refused' WHEN value IS NULL THEN 'blank' ELSE 'written' END AS status FROM ({ORACLES['h0_mapping_program']})""")
def l4(spark, sf_dir):
    results = program.resolve(_PROGRAM.df(spark), quarterly(spark, sf_dir), ["company", "period_end"])
    return sinks.audit_rows(results, "run").select("company", "period_end", "row", "status")


@query("l5_values_json", f"""
    SELECT company, period_end, count(*) AS n_rows, CAST(count(value) AS BIGINT) AS n_values FROM ({ORACLES['h0_mapping_program']}) GROUP BY ALL""")
def l5(spark, sf_dir):
    """The result as one document for each company and period, read back and counted."""
    results = program.resolve(_PROGRAM.df(spark), quarterly(spark, sf_dir), ["company", "period_end"])
    back = sinks.values_json(results, ["company", "period_end"]).withColumn("d", F.from_json("json", "values array<struct<row: string, value: double, reason: string>>"))
    return back.select("company", "period_end", F.size("d.values").cast("long").alias("n_rows"), F.size(F.filter("d.values", lambda v: v["value"].isNotNull())).cast("long").alias("n_values"))


@query("l6_lineage_text", expected("caption string, note string", [("Revenue", "from 'Revenue' on page 4\ncolumn 2Q26\nscaled thousands to millions\nsign flipped"), ("Cash", "from 'Cash' on page 5\ncolumn 30 June\n")]))
def l6(spark, sf_dir):
    t = Table("caption string, page int, header string, adjustments array<string>", [("Revenue", 4, "2Q26", ["scaled thousands to millions", "sign flipped"]), ("Cash", 5, "30 June", [])]).df(spark)
    return t.select("caption", sinks.lineage(F.col("caption"), F.col("page"), F.col("header"), F.col("adjustments")).alias("note"))


@query("l7_nested_json", "SELECT o_custkey, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY o_custkey")
def l7(spark, sf_dir):
    """A company's nested document written as JSON lines and read back by its schema."""
    path = _shared(spark)
    load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey")).alias("orders")).write.json(path)
    back = spark.read.schema("o_custkey long, orders array<struct<o_orderkey: long>>").json(path)
    return back.select("o_custkey", F.size("orders").cast("long").alias("n"), F.aggregate("orders", F.lit(0).cast("long"), lambda a, o: a + o["o_orderkey"]).alias("keys"))


_CAPTIONS = Table("label string, caption string", [("Revenue", "Revenue"), ("Tax", "Income tax")])
_MATCHED = Table("label string, found string", [("Revenue", "Revenues, net")])


@query("l10_caption_write_back", f"SELECT company, label, CASE WHEN label = 'Revenue' AND company % 2 = 0 THEN 'Revenues, net' ELSE caption END AS caption FROM {_CAPTIONS.sql_across()}")
def l10(spark, sf_dir):
    """Even companies matched another wording."""
    return program.write_back(_CAPTIONS.across(spark, sf_dir), _MATCHED.across(spark, sf_dir).where("company % 2 = 0"), ["company"])


@query("l11_formula_recipe", """
    WITH c AS (SELECT s_suppkey, CAST(3 + s_suppkey % 40 AS INTEGER) AS c FROM supplier), l AS (SELECT *, list_transform(range(0, 50), lambda i: CASE WHEN i >= 26 THEN chr(CAST(64 + i // 26 AS INTEGER)) ELSE '' END || chr(CAST(65 + i % 26 AS INTEGER))) AS x FROM c)
    SELECT s_suppkey, '=22%*SUM(' || x[c - 2] || '5:' || x[c + 1] || '5)-' || x[c] || '10-' || x[c - 1] || '10-' || x[c - 2] || '10' AS formula FROM l""")  # fmt: skip
def l11(spark, sf_dir):
    """The trailing-year plug as a formula for the column that is written."""
    col = (3 + F.col("s_suppkey") % 40).cast("int")
    return load(spark, sf_dir, "supplier").select("s_suppkey", program.trailing_year_plug(col, F.lit("22%"), F.lit("5"), F.lit("10")).alias("formula"))


@query("s1_stream_windows", "SELECT CAST(ts AS DATE) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def s1(spark, sf_dir):
    """Event-time sums over the event table, read as a stream, under a watermark: finished windows are appended to Parquet."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    out = streams.windowed(streams.read_events(spark, f"{sf_dir}/events*.parquet", schema).withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], "value")
    base = _shared(spark)
    return streams.run_once(out, f"{base}/windows", f"{base}/checkpoint").select(F.to_date("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
