"""The stages of a run, each from files to a table: what one stage leaves, the next can read in another session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables
from . import engine, sinks

_HISTORY = "company string, label string, end date, value double"


def load_mapping(spark: SparkSession, path: str) -> DataFrame:
    """Mapping rows of all mapping documents below a path, one JSON document a file."""
    return tables.mapping_rows(spark.read.text(path, wholetext=True).select(F.col("value").alias("json")))


def load_statements(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """statements, columns and rows of all table documents below a path; a file's name is its company."""
    found = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("path"), F.col("value").alias("json"))
    read = tables.tables(found)
    stmt = F.xxhash64("path", "page", "ord").alias("stmt")
    cells = tables.cells(read).groupBy("path", "page", "ord", "row", "caption").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "value"))), lambda x: x["value"]).alias("values"))
    statements = read.select(F.col("path").alias("company"), stmt, "kind", "title", F.lit(None).cast("int").alias("note"), (F.col("page") * 1000 + F.col("ord")).alias("ord"), F.lit(True).alias("readable"), "units")
    columns = tables.period_columns(read).select(stmt, "col", "header", "kind", "months", "end")
    return statements, columns, cells.select(stmt, "row", "caption", F.lit(None).cast("string").alias("heading"), "values")


def load_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_HISTORY).json(path)


def resolve(spark: SparkSession, mapping: str, statements: str, history: str, target: str, cadence: int, units: str) -> DataFrame:
    """Values with their reasons and sources, from the files of the stages before."""
    return engine.run(load_mapping(spark, mapping), *load_statements(spark, statements), load_history(spark, history), target, cadence, units)


def write(spark: SparkSession, results: DataFrame, path: str, period_end: str) -> None:
    """The values as one appended period; a period that is there is refused."""
    sinks.append_period(spark, results.where("value is not null").select("company", "label", "value"), path, period_end)
