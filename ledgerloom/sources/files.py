"""Where rows come from: a router over file kinds, content-addressed caches, one model for each company."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARSER_VERSION = 1


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content, sha of every file below a path: Spark's own reader, so any store that it can read will do."""
    return with_hash(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content"))


def with_hash(files: DataFrame) -> DataFrame:
    return files.withColumn("sha", F.sha2("content", 256))


def kind_of(path: Column, reader: Column | None = None) -> Column:
    """package, workbook, vision or text, by extension; the reader asked for decides between the last two."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    asked = F.coalesce(reader, F.lit("llm")) if reader is not None else F.lit("llm")
    return F.when(ext == "zip", "package").when(ext.isin("xlsx", "xlsm"), "workbook").when(ext.isin("json"), "tables").when(asked == "llm", "vision").otherwise("text")


def work_list(files: DataFrame, cache: DataFrame, version: int = PARSER_VERSION) -> DataFrame:
    """path, sha, action: reuse what the same content gave under this parser; an older parser's page texts only; read the rest."""
    c = cache.groupBy(F.col("sha").alias("s")).agg(F.max("version").alias("v"))
    joined = files.select("path", "sha").join(c, F.col("sha") == F.col("s"), "left")
    return joined.select("path", "sha", F.when(F.col("v") == version, "reuse").when(F.col("v").isNotNull(), "reuse_text").otherwise("read").alias("action"))


def company_models(files: DataFrame) -> DataFrame:
    """company, model, error: exactly one workbook named model in each company's folder."""
    company = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    models = files.withColumn("company", company).withColumn("is_model", F.lower("path").rlike(r"model[^/]*\.xlsx$"))
    found = models.groupBy("company").agg(F.count_if("is_model").alias("n"), F.min(F.when(F.col("is_model"), F.col("path"))).alias("model"), F.array_sort(F.collect_list(F.when(F.col("is_model"), F.col("path")))).alias("all"))
    return found.select("company", F.when(F.col("n") == 1, F.col("model")).alias("model"), F.when(F.col("n") == 0, F.lit("no model")).when(F.col("n") > 1, F.concat(F.lit("models: "), F.array_join("all", ", "))).alias("error"))
