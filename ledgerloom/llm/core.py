"""Shared pieces of the training-data operators.

* vectorised word scanning over Arrow string buffers (no per-word Python);
* stable 64-bit hashing of words and word windows;
* tables written to the folder that all executors share.

Words are maximal runs of bytes outside ``\\x20 \\x09-\\x0D``, so the byte view of UTF-8 text is exact.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship

#: Bytes of text that one vectorised step looks at; one longer document is a step of its own.
CHUNK_BYTES = 2 << 20
WORD = r"[^\x20\x09-\x0D]+"

_U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_P = 0x9E3779B97F4A7C15 | 1
_Q = 0xD6E8FEB86659FD93 | 1
_pows: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i in [0, n]."""
    have = _pows.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _pows[base] = have = (out[0], out[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


class Words:
    """The words of consecutive documents: byte bounds, word offsets of each document, and the bytes."""

    def __init__(self, buf: np.ndarray, bounds: np.ndarray):
        self.buf, self.bounds = buf, bounds
        solid = ~_SPACE[buf]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        last = solid.copy()
        last[:-1] &= ~solid[1:]
        inner = bounds[(bounds > 0) & (bounds < len(buf))]
        first[inner] = solid[inner]
        last[inner - 1] = solid[inner - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.offset = np.searchsorted(self.start, bounds)
        self.counts = np.diff(self.offset)

    def __len__(self) -> int:
        return len(self.start)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, lower: bool = True) -> np.ndarray:
        n = len(self.buf)
        power, inverse = _powers(_P, n)
        total = np.empty(n + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum((_BYTE_LOWER if lower else _BYTE)[self.buf] * power[:n], out=total[1:])
        value = (total[self.end] - total[self.start]) * inverse[self.start]
        return mix(value ^ (self.end - self.start).astype(np.uint64))


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word windows of a run of word hashes (document ends are the caller's matter)."""
    n = len(words)
    if n < k:
        return np.empty(0, dtype=np.uint64)
    power, inverse = _powers(_Q, n)
    total = np.empty(n + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(words * power[:n], out=total[1:])
    return mix((total[k:] - total[: n - k + 1]) * inverse[: n - k + 1] + _U(k))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the bounds of its rows; nulls count as empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.empty(0, dtype=np.uint8)
    return buf, bounds - bounds[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each batch cut into runs of rows of about CHUNK_BYTES of text: (rows, bytes, bounds)."""
    for batch in batches:
        buf, bounds = utf8(batch.column(text))
        at, n = 0, batch.num_rows
        while at < n:
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + CHUNK_BYTES, side="right")) - 1)
            yield batch.slice(at, to - at), buf[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
            at = to


def text_of(buf: np.ndarray, start: int, end: int) -> str:
    return buf[start:end].tobytes().decode("utf-8", "replace")


@contextlib.contextmanager
def without_cycle_search() -> Iterator[None]:
    """Python doesn't search for cycles meanwhile: code that makes none, but very many small objects, would be searched again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def n_words(text: Column) -> Column:
    """The number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# --- tables in the shared folder -------------------------------------------------------------------------

_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of this machine only where it is unset and all executors are here."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"{tempfile.gettempdir()}/ledgerloom-checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found


def keep(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: its lineage ends here, and a lost executor costs a reread.

    It stays until the session ends; what only one operator reads is kept by its ``Scratch``.
    """
    path = f"{shared_dir(spark).rstrip('/')}/ledgerloom/{uuid.uuid4().hex}/{name}"
    _written[path] = spark
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """The tables that one call of an operator writes for itself. ``finish`` writes the result and removes them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_dir(self.spark).rstrip('/')}/ledgerloom/{uuid.uuid4().hex}/{name}"
        _written[path] = self.spark
        self.paths.append(path)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def finish(self, df: DataFrame, name: str) -> DataFrame:
        """The result as a table of its own; nothing else reads this scratch's tables any more."""
        out = keep(self.spark, df, name)
        while self.paths:
            _drop(self.paths.pop())
        return out


def _drop(path: str) -> None:
    spark = _written.pop(path, None)
    if spark is None:
        return
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended
        return


def drop_tables() -> None:
    """Remove the tables that keep() wrote; call it when no result that reads them is needed any more."""
    for path in [*_written]:
        _drop(path)


atexit.register(drop_tables)


def tune(spark: SparkSession) -> None:
    """The package on every executor, and Arrow batches of bounded bytes, so that very long texts don't add up in a Python worker."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """The bytes of all texts: what the number of groups that Python workers hold one at a time follows."""
    return int(docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0)


def group_count(least: int, nbytes: int, held: int = 32 << 20) -> int:
    """Groups of at most about ``held`` bytes each: what a worker holds doesn't grow with the corpus, whatever the session's number of partitions."""
    return max(1, least, -(-nbytes // held))


def dealt(spark: SparkSession, df: DataFrame, key: str, nbytes: int, task: int = 256 << 20) -> DataFrame:
    """df by a group's key in as many partitions as keep a task's share at ``task`` bytes, where the session's own number is too small for that."""
    n = -(-nbytes // task)
    return df.repartition(n, key) if n > partitions(spark) else df
