"""A data source for folders of packages: ``spark.read.format("packages").load(folder)`` gives one row for each member of each zip file.

    path string, member string, size long, modified timestamp, content binary

A partition is a run of packages of about ``partitionBytes`` (64 MB); a larger package is dealt by its members over several. Filters on path and member are taken over from
the query: packages that don't fit are not planned, members that don't fit are not unpacked, and ``content`` is only read where the query's options ask for it
(``content=false`` gives null). Any file system that Arrow can open will do. A file that is no zip gives one row without a member if ``badPackages`` is ``keep``, none if it is
``skip``, and an error (the default) if it is ``fail``.
"""

from __future__ import annotations

import datetime
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

SCHEMA = "path string, member string, size long, modified timestamp, content binary"
PARTITION_BYTES = 64 << 20
#: Filters on one text column that are taken over.
_TESTS = {
    EqualTo: lambda value, text: text == value,
    In: lambda value, text: text in value,
    StringStartsWith: lambda value, text: text.startswith(value),
    StringEndsWith: lambda value, text: text.endswith(value),
    StringContains: lambda value, text: value in text,
}


@dataclass
class Packages(InputPartition):
    """Packages, and which share (of how many) of their members belongs to this partition."""

    files: list[tuple[str, int]]
    share: int = 0
    shares: int = 1


def _open(uri: str):
    """The file system and the path of a folder or file."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:/") else (fs.LocalFileSystem(), uri)


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.most = int(options.get("partitionbytes", PARTITION_BYTES))
        self.content = options.get("content", "true").lower() == "true"
        self.bad = options.get("badpackages", "fail")
        if self.bad not in ("fail", "skip", "keep") or self.most <= 0:
            raise ValueError("badPackages is fail, skip or keep; partitionBytes is positive")
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = ".".join(getattr(f, "attribute", ()))
            if type(f) in _TESTS and name in ("path", "member") and f.value is not None:
                self.tests.append((name, type(f), f.value))
            else:
                yield f  # Spark applies it

    def _fits(self, column: str, text: str | None) -> bool:
        return all(text is not None and _TESTS[kind](value, text) for name, kind, value in self.tests if name == column)

    def partitions(self) -> list[Packages]:
        from pyarrow import fs

        system, folder = _open(self.folder)
        found = system.get_file_info(fs.FileSelector(folder, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")) and self._fits("path", f.path))
        out: list[Packages] = []
        room = 0
        for path, size in files:
            if size > self.most:
                shares = -(-size // self.most)
                out += [Packages([(path, size)], k, shares) for k in range(shares)]
                room = 0
            elif size <= room:
                out[-1].files.append((path, size))
                room -= size
            else:
                out.append(Packages([(path, size)]))
                room = self.most - size
        return out or [Packages([])]

    def read(self, partition: Packages) -> Iterator[tuple]:
        system, _ = _open(self.folder)
        for path, _ in partition.files:
            with system.open_input_file(path) as file:
                try:
                    archive = zipfile.ZipFile(file)
                except (zipfile.BadZipFile, ValueError):  # too short for Arrow's file to be searched
                    if self.bad == "fail":
                        raise ValueError(f"{path} is no zip file") from None
                    if self.bad == "keep" and partition.share == 0 and self._fits("member", None):
                        yield path, None, None, None, None
                    continue
                with archive:
                    members = [m for m in archive.infolist() if not m.is_dir()]
                    for k, m in enumerate(members):
                        if k % partition.shares == partition.share and self._fits("member", m.filename):
                            yield path, m.filename, m.file_size, datetime.datetime(*m.date_time), archive.read(m) if self.content else None


class PackageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "packages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let queries hand their filters over."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PackageSource)
