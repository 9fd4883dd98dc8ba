"""Named queries with their oracle SQL, and small inline tables that both sides read."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its operator's id and name."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = lambda spark, sf_dir: ship(spark) or flat(f(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return add


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_DUCK = {"string": "VARCHAR", "double": "DOUBLE", "int": "INTEGER", "long": "BIGINT", "boolean": "BOOLEAN", "date": "DATE", "array<string>": "VARCHAR[]", "array<double>": "DOUBLE[]", "array<int>": "INTEGER[]"}


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(_literal, value)) + "]"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


def _decimals(v):
    return F.when(v.isNull(), F.lit("null")).otherwise(F.format_string("%.4f", v))


def _text(v):
    return F.coalesce(v.cast("string"), F.lit("null"))


def flat(df: DataFrame) -> DataFrame:
    """Array columns as text ('[a|b|null]', four decimals), which any two engines compare alike."""
    for name, kind in df.dtypes:
        if kind.startswith("array<"):
            items = F.transform(F.col(name), _decimals if kind == "array<double>" else _text)
            df = df.withColumn(name, F.when(F.col(name).isNotNull(), F.concat(F.lit("["), F.array_join(items, "|"), F.lit("]"))))
    return df


def _flat_value(value, kind: str):
    if value is None or not kind.startswith("array<"):
        return value
    return "[" + "|".join("null" if v is None else f"{v:.4f}" if kind == "array<double>" else str(v) for v in value) + "]"


class Table:
    """A small inline table: a DataFrame for Spark, VALUES for the oracle. Dates are given as ISO strings."""

    def __init__(self, ddl: str, rows: Sequence[tuple]):
        self.columns = [tuple(c.strip().split(" ", 1)) for c in ddl.split(", ")]
        self.rows = list(rows)

    def df(self, spark: SparkSession) -> DataFrame:
        raw = ", ".join(f"`{n}` {'string' if t == 'date' else t}" for n, t in self.columns)
        df = spark.createDataFrame(self.rows, raw)
        return df.select(*[df[n].cast(t).alias(n) for n, t in self.columns])

    def across(self, spark: SparkSession, sf_dir: str, scale: Sequence[str] = ()) -> DataFrame:
        """The rows once for each supplier, as if each had filed them; the columns ``scale`` are multiplied by its own number."""
        rows = json.dumps([dict(zip((n for n, _ in self.columns), r, strict=True)) for r in self.rows])
        fields = ", ".join(f"`{n}`: {t}" for n, t in self.columns)
        df = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("company"), F.explode(F.from_json(F.lit(rows), f"array<struct<{fields}>>")).alias("x")).select("company", "x.*")
        times = F.col("company") % 7 + 1
        return df.withColumns({c: F.transform(c, lambda v: v * times) if dict(self.columns)[c].startswith("array") else F.col(c) * times for c in scale})

    def sql_across(self, scale: Sequence[str] = ()) -> str:
        kinds = dict(self.columns)
        shown = ", ".join(f'list_transform(f."{n}", lambda v: v * (s_suppkey % 7 + 1)) AS "{n}"' if n in scale and kinds[n].startswith("array") else f'f."{n}" * (s_suppkey % 7 + 1) AS "{n}"' if n in scale else f'f."{n}"' for n, _ in self.columns)
        return f"(SELECT s_suppkey AS company, {shown} FROM supplier, {self.sql} f)"

    @property
    def sql(self) -> str:
        names = ", ".join(f'"{n}"' for n, _ in self.columns)
        rows = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in self.rows)
        casts = ", ".join(f'CAST("{n}" AS {_DUCK[t]}) AS "{n}"' for n, t in self.columns)
        return f"(SELECT {casts} FROM (VALUES {rows}) AS v({names}))"


def each(ddl: str, rows: Sequence[tuple]) -> str:
    """Oracle SQL that states the results of one filing, for each supplier's."""
    return f"SELECT s_suppkey AS company, e.* FROM supplier, ({expected(ddl, rows)}) e"


def expected(ddl: str, rows: Sequence[tuple]) -> str:
    """Oracle SQL that states the results; arrays as flat() shows them."""
    kinds = [c.strip().split(" ", 1)[1] for c in ddl.split(", ")]
    shown = ", ".join(f"{c.strip().split(' ', 1)[0]} {'string' if k.startswith('array<') else k}" for c, k in zip(ddl.split(", "), kinds, strict=True))
    return f"SELECT * FROM {Table(shown, [tuple(_flat_value(v, k) for v, k in zip(r, kinds, strict=True)) for r in rows]).sql}"
