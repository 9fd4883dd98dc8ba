"""Tables kept in versions: partitions are replaced, never changed, and what they replace stays as the past.

    root/data/written_in=<n>/...   what version n wrote, partitioned by the table's key
    root/parts/<n>                 which version each key's rows are of, from version n on
    root/commits/<n>               that version n is complete

A writer names the version that it read. It writes its data and the table of parts, and then makes the commit file, which must not be there: of two writers on one
version the second is refused, and what it wrote is never read. A version is visible only when its commit is there, so readers see all of it or nothing.
A table has no column ``written_in`` of its own.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import Refused


class Versions:
    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str]):
        self.spark, self.root, self.keys = spark, root.rstrip("/"), [*keys]
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def latest(self) -> int:
        """The newest complete version; 0 if nothing was written."""
        folder = self._path(f"{self.root}/commits")
        if not self._fs.exists(folder):
            return 0
        return max((int(f.getPath().getName()) for f in self._fs.listStatus(folder) if f.getPath().getName().isdigit()), default=0)

    def _commit(self, version: int) -> None:
        """Make the commit file; the file system lets one writer only make it."""
        try:
            self._fs.create(self._path(f"{self.root}/commits/{version}"), False).close()
        except Exception as e:
            raise Refused(f"version {version} was written meanwhile") from e

    def _same(self, a: DataFrame, b: DataFrame) -> Column:
        return reduce(Column.__and__, (a[k].eqNullSafe(b[k]) for k in self.keys))

    def parts(self, version: int | None = None) -> DataFrame:
        """keys, since: of which version each key's rows are, as of a version (the latest)."""
        n = self.latest() if version is None else version
        return self.spark.read.parquet(f"{self.root}/parts/{n}")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows as of a version (the latest). Partitions of other versions aren't read."""
        n = self.latest() if version is None else version
        data = self.spark.read.option("basePath", f"{self.root}/data").parquet(*[f"{self.root}/data/written_in={k}" for k in self._written(n)])
        parts = self.parts(n)
        return data.join(parts, self._same(data, parts) & (data["written_in"] == parts["since"]), "left_semi").drop("written_in")

    def _written(self, upto: int) -> list[int]:
        return [k for k in range(1, upto + 1) if self._fs.exists(self._path(f"{self.root}/data/written_in={k}"))]

    def past(self) -> DataFrame:
        """All rows that were ever written by a complete version, with version and whether they are current."""
        n = self.latest()
        data = self.spark.read.option("basePath", f"{self.root}/data").parquet(*[f"{self.root}/data/written_in={k}" for k in self._written(n)])
        parts = self.parts(n).withColumn("is_current", F.lit(True))
        found = data.join(parts, self._same(data, parts) & (data["written_in"] == parts["since"]), "left")
        return found.select(*[data[c] for c in data.columns if c != "written_in"], data["written_in"].alias("version"), F.coalesce("is_current", F.lit(False)).alias("current"))

    def replace(self, rows: DataFrame, base: int, touched: DataFrame | None = None) -> int:
        """Make ``rows`` the rows of their keys, in place of those of version ``base``; the new version's number. Other keys stay.

        ``touched``: the keys that are replaced, if some of them shall have no rows any more. Refused if ``base`` isn't the latest version any more.
        """
        if base != self.latest():
            raise Refused(f"version {base} was replaced by {self.latest()}")
        new = base + 1
        for folder in (f"data/written_in={new}", f"parts/{new}"):  # what a writer left that was refused or died before its commit
            self._fs.delete(self._path(f"{self.root}/{folder}"), True)
        rows.repartition(*self.keys).write.partitionBy(*self.keys).parquet(f"{self.root}/data/written_in={new}")
        own = rows.select(*self.keys) if touched is None else touched.select(*self.keys)
        own = own.distinct().withColumn("since", F.lit(new))
        if base:
            before = self.parts(base)
            own = before.join(own, self._same(before, own), "left_anti").unionByName(own)
        own.write.parquet(f"{self.root}/parts/{new}")
        self._commit(new)
        return new

    def upsert(self, changes: DataFrame, columns: Sequence[str], value: str, base: int) -> tuple[int, DataFrame]:
        """Set ``value`` of the rows that ``changes`` (keys, columns, value) names; the new version, and the conflicts.

        Several writers may name one row: if they agree it is set, if not it stays and is a conflict (keys, columns, proposals). Only partitions in which a row
        changes are written again.
        """
        one = [*self.keys, *columns]
        asked = changes.groupBy(*one).agg(F.array_sort(F.collect_set(value)).alias("proposals"))
        conflicts = asked.where(F.size("proposals") > 1)
        agreed = asked.where(F.size("proposals") == 1).select(*[F.col(c).alias(f"__{c}") for c in one], F.get("proposals", F.lit(0)).alias("__value"))
        now = self.read(base)
        same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in one))
        changed = now.join(agreed, same).where(~F.col(value).eqNullSafe(F.col("__value")))
        touched = changed.select(*self.keys).distinct()
        theirs = now.join(touched.select(*[F.col(k).alias(f"__t_{k}") for k in self.keys]), reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"__t_{k}")) for k in self.keys)), "left_semi")
        rows = theirs.join(agreed, same, "left").withColumn(value, F.coalesce("__value", value)).select(*now.columns)
        return self.replace(rows, base, touched), conflicts
