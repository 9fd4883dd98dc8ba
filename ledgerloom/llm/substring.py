"""Removal of repeated word windows, found by level-wise doubling.

A window is ``length`` consecutive words. Each level looks at shorter windows of w words, w doubling from ``base`` to
``length``. Of every ``length``-window that is still a candidate one w-window speaks for it: the one with the smallest
hash (equal windows choose equally). A ``length``-window survives the level if its speaker occurs more than once in the
corpus; only survivors are extended to 2 w words. At the last level the speaker is the window itself: of equal windows
all but the earliest (smallest doc_id, then start) are removed. Nothing is sampled: a repeated window has repeated
speakers at every level, and a level only drops windows that cannot be repeated.

Shuffles: a task sends each distinct hash once, however often it has met it, in packed arrays; so a passage that a third
of all documents share costs one entry a task. Answers come back packed by the documents' group. A worker holds one group of
documents or one bucket of hashes at a time; their number follows the bytes of all texts.

Defined cases: null, empty and shorter texts have no window and lose nothing; rows equal in doc_id and text are one
document, different texts under one doc_id (or under none) are documents of their own, in the order of their checksums; a null doc_id
comes before all others; an empty table gives an empty result; extra columns are ignored by ``digests`` and kept by ``rows``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import core

LENGTH = 20
_NULL_ID = -(2**63)
_U = np.uint64
_SENT = "bucket long, home long, data binary"
_BACK = "home long, data binary"
#: Groups of documents for each bucket of hashes.
HOMES = 8
#: Entries that a task holds before it sends them.
_HELD = 4_000_000


def _home_of(doc_id: Column, crc: Column, n: int) -> Column:
    """The group of a document; those without a doc_id are dealt by their text."""
    return F.pmod(F.xxhash64(F.coalesce(F.nullif(doc_id.cast("long"), F.lit(_NULL_ID)), crc)), F.lit(n))


def _home(ids: np.ndarray, crc: np.ndarray, n: int) -> np.ndarray:
    """The same as ``_home_of``: pmod(xxhash64(id), n) as Spark has it for a bigint."""
    ids = np.where(ids == _NULL_ID, crc.astype(np.int64), ids)
    p1, p2, p3, p4, p5 = (_U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turn(x, k):
        return (x << _U(k)) | (x >> _U(64 - k))

    with np.errstate(over="ignore"):
        h = _U(42) + p5 + _U(8)
        h = turn(h ^ (turn(ids.astype(np.int64).view(np.uint64) * p2, 31) * p1), 27) * p1 + p4
        h = (h ^ (h >> _U(33))) * p2
        h = (h ^ (h >> _U(29))) * p3
        h = h ^ (h >> _U(32))
    return h.view(np.int64) % n


#: A document is its doc_id and its text's CRC-32.
_PLACE = (("doc", np.int64), ("crc", np.uint32), ("pos", np.uint32))
_ENTRY = (("h", np.uint64), ("g", np.uint32), *_PLACE)


def _pack(fields, arrays: list[np.ndarray]) -> bytes:
    """Arrays by byte planes, so that the high bytes, mostly equal, compress."""
    n = len(arrays[0])
    return b"".join(np.ascontiguousarray(a.astype(t, copy=False).view(np.uint8).reshape(n, -1).T).tobytes() for (_, t), a in zip(fields, arrays, strict=True))


def _unpack(fields, blobs: list[bytes]) -> list[np.ndarray]:
    width = sum(np.dtype(t).itemsize for _, t in fields)
    out: list[list[np.ndarray]] = [[] for _ in fields]
    for blob in blobs:
        n, at = len(blob) // width, 0
        for k, (_, t) in enumerate(fields):
            size = np.dtype(t).itemsize
            out[k].append(np.ascontiguousarray(np.frombuffer(blob, np.uint8, n * size, at).reshape(size, n).T).view(t).ravel())
            at += n * size
    return [np.concatenate(x) if x else np.empty(0, dtype=t) for x, (_, t) in zip(out, fields, strict=True)]


def _split(keys: np.ndarray, arrays: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    if not len(keys):
        return
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    arrays = [a[order] for a in arrays]
    cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    for a, b in zip(cut, [*cut[1:], len(keys)], strict=True):
        yield int(keys[a]), [x[a:b] for x in arrays]


def _speakers(hashes: np.ndarray, inner: int) -> np.ndarray:
    """For each run of ``inner`` hashes the index of its smallest, the leftmost of equals."""
    n = len(hashes) - inner + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    low, span = hashes, 1
    while 2 * span <= inner:
        low, span = np.minimum(low[: len(low) - span], low[span:]), 2 * span
    low = np.minimum(low[:n], low[inner - span : inner - span + n])
    at = np.empty(n, dtype=np.int64)
    for k in range(inner - 1, -1, -1):
        np.copyto(at, np.arange(k, k + n), where=hashes[k : k + n] == low)
    return at


def _document(ids: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """One number for a document."""
    return core.mix(ids.astype(np.int64).view(np.uint64) ^ core.mix(crc.astype(np.uint64) + _U(1)))


class _Text:
    """The words of some documents, and which ``length``-windows lie inside one of them."""

    def __init__(self, buf: np.ndarray, bounds: np.ndarray, ids: np.ndarray, crc: np.ndarray, length: int):
        self.words, self.ids, self.crc, self.length = core.Words(buf, bounds), ids, crc, length
        self.hash = self.words.hashes(lower=False)
        n = len(self.words)
        self.doc = self.words.doc_of_word()
        self.pos = np.arange(n) - self.words.offset[:-1][self.doc] if n else np.empty(0, dtype=np.int64)
        count = max(0, n - length + 1)
        self.whole = self.doc[:count] == self.doc[length - 1 :] if count else np.empty(0, dtype=bool)
        self._key = _document(ids, crc)
        self._by_key = np.argsort(self._key, kind="stable")

    def marks(self, docs: np.ndarray, crc: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """The places as flags over all words; equal rows all get them."""
        out = np.zeros(len(self.words) + 1, dtype=bool)
        keys, asked = self._key[self._by_key], _document(docs, crc)
        lo, hi = np.searchsorted(keys, asked, "left"), np.searchsorted(keys, asked, "right")
        for k in range(int((hi - lo).max(initial=0))):
            ok = lo + k < hi
            row = self._by_key[(lo + k)[ok]]
            inside = pos[ok] < self.words.counts[row]
            out[self.words.offset[row[inside]] + pos[ok][inside]] = True
        return out[:-1]

    def level(self, w: int, alive: np.ndarray) -> np.ndarray:
        """The start of the w-window that speaks for each living window."""
        return _speakers(core.windows(self.hash, w), self.length - w + 1)[alive]

    def entries(self, w: int, at: np.ndarray) -> list[np.ndarray]:
        """Hash, second hash, document (two numbers) and place of the w-windows that start at ``at``."""
        if not len(at):
            return [np.empty(0, dtype=t) for _, t in _ENTRY]
        second = core.windows(core.mix(self.hash ^ _U(0x5DEECE66D1234567)), w)
        return [core.windows(self.hash, w)[at], (second[at] >> _U(32)).astype(np.uint32), self.ids[self.doc[at]], self.crc[self.doc[at]], self.pos[at].astype(np.uint32)]


def _groups(h, g, doc, crc, pos):
    """Sorted by hash, then place: the order, and for each sorted entry whether it is its hash's first, and the first's index."""
    order = np.lexsort((pos, crc, doc, g, h))
    h, g = h[order], g[order]
    first = np.ones(len(h), dtype=bool)
    first[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    return order, first, np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))


def _found(entries: list[np.ndarray], last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of one entry of each hash, and of the entries known to be repeated (at the last level: later ones)."""
    order, first, head = _groups(*entries)
    doc, crc, pos = (x[order] for x in entries[2:])
    later = (doc != doc[head]) | (crc != crc[head]) | (pos != pos[head])
    if not last:
        has = np.zeros(len(order), dtype=bool)
        has[head[later]] = True
        later |= has[head]
    return order[first], order[later]


def _send(entries: list[np.ndarray], last: bool, buckets: int, homes: int) -> Iterator[tuple]:
    if not len(entries[0]):
        return
    heads, known = _found(entries, last)
    sent = [a[heads] for a in entries]
    for bucket, part in _split((sent[0] % _U(buckets)).astype(np.int64), sent):
        yield bucket, -1, _pack(_ENTRY, part)
    place = [x[known] for x in entries[2:]]
    for home, part in _split(_home(place[0], place[1], homes), place):
        yield home % buckets, home, _pack(_PLACE, part)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = [pa.binary() if n == "data" else pa.int64() for n in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[] for _ in names], types, strict=True)], names)


def _ids(column) -> np.ndarray:
    return column.fill_null(_NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def _crcs(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.uint32)


def _first_level(length: int, w: int, buckets: int, homes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for rows, buf, bounds in core.chunks(batches):
            text = _Text(buf, bounds, _ids(rows.column("doc_id")), _crcs(rows.column("crc")), length)
            at = np.zeros(len(text.words), dtype=bool)
            at[text.level(w, text.whole)] = True
            held.append(text.entries(w, np.flatnonzero(at)))
            size += len(held[-1][0])
            if size >= _HELD:
                yield _batch([*_send([np.concatenate(x) for x in zip(*held, strict=True)], w == length, buckets, homes)], ["bucket", "home", "data"])
                held, size = [], 0
        if held:
            yield _batch([*_send([np.concatenate(x) for x in zip(*held, strict=True)], w == length, buckets, homes)], ["bucket", "home", "data"])

    return run


def _places(table: pa.Table) -> list[np.ndarray]:
    return _unpack(_PLACE, table.column("data").to_pylist())


def _slices(table: pa.Table) -> Iterator[tuple[int, pa.Table]]:
    """Runs of rows of about CHUNK_BYTES of text, with the number of rows before them: what one vectorised step holds."""
    ends = np.cumsum(pa.compute.binary_length(table.column("text").cast(pa.binary())).fill_null(0).to_numpy())
    at = 0
    while at < table.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + core.CHUNK_BYTES, side="right")))
        yield at, table.slice(at, to - at)
        at = to


def _table_text(table: pa.Table, length: int, crc: str) -> _Text:
    """Of a table with rows."""
    text, ids, crcs = (table.column(c).combine_chunks() for c in ("text", "doc_id", crc))
    return _Text(*core.utf8(text), _ids(ids), _crcs(crcs), length)


def _next_level(length: int, before: int, w: int, buckets: int, homes: int):
    def run(docs: pa.Table, places: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if docs.num_rows and places.num_rows:
            where, found = _places(places), []
            for _, part in _slices(docs):
                text = _table_text(part, length, "crc")
                alive = text.whole.copy()
                marked = text.marks(*where)
                alive[alive] = marked[text.level(before, alive)]
                at = np.zeros(len(text.words), dtype=bool)
                at[text.level(w, alive)] = True
                found.append(text.entries(w, np.flatnonzero(at)))
            rows = [*_send([np.concatenate(x) for x in zip(*found, strict=True)], w == length, buckets, homes)]
        return pa.Table.from_batches([_batch(rows, ["bucket", "home", "data"])])

    return run


def _resolve(last: bool, homes: int):
    """One bucket of hashes: one message to each group of documents, of the entries that meet an equal one and what tasks found themselves."""

    def run(table: pa.Table) -> pa.Table:
        homed, data = table.column("home").to_pylist(), table.column("data").to_pylist()
        entries = _unpack(_ENTRY, [blob for home, blob in zip(homed, data, strict=True) if home < 0])
        place = _unpack(_PLACE, [blob for home, blob in zip(homed, data, strict=True) if home >= 0])
        if len(entries[0]):
            _, known = _found(entries, last)
            place = [np.concatenate([a, b[known]]) for a, b in zip(place, entries[2:], strict=True)]
        rows = [(home, _pack(_PLACE, part)) for home, part in _split(_home(place[0], place[1], homes), place)]
        return pa.Table.from_batches([_batch(rows, ["home", "data"])])

    return run


def _removal(table: pa.Table, places: pa.Table, length: int, crc: str = "crc") -> Iterator[tuple[int, list[bytes], np.ndarray | None]]:
    """For each row its words and, if any goes, the flags of those that stay."""
    where = _places(places)
    for first, part in _slices(table):
        text = _table_text(part, length, crc)
        starts = np.flatnonzero(text.marks(*where))
        cover = np.zeros(len(text.words) + length + 1, dtype=np.int32)
        cover[starts] += 1
        cover[starts + length] -= 1
        gone = np.cumsum(cover)[: len(text.words)] > 0
        bounds, offset, buf = text.words.bounds, text.words.offset, text.words.buf
        for i in range(part.num_rows):
            own = gone[offset[i] : offset[i + 1]]
            yield first + i, buf[bounds[i] : bounds[i + 1]].tobytes().split(), ~own if own.any() else None


DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _digest(length: int):
    def run(docs: pa.Table, places: pa.Table) -> pa.Table:
        ids, rows = docs.column("doc_id").to_pylist() if docs.num_rows else [], []
        for i, words, stay in _removal(docs, places, length) if ids else ():
            kept = words if stay is None else list(compress(words, stay))
            rows.append((ids[i], len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, types, strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def _rewrite(length: int, schema: pa.Schema, crc: str):
    def run(docs: pa.Table, places: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        texts, chars = docs.column("text").to_pylist(), docs.column("n_chars").to_pylist() if "n_chars" in docs.column_names else None
        for i, words, stay in _removal(docs, places, length, crc):
            if stay is not None:
                texts[i] = b" ".join(compress(words, stay)).decode("utf-8", "replace")
                if chars is not None:
                    chars[i] = len(texts[i])
        out = docs.set_column(docs.column_names.index("text"), "text", pa.array(texts, pa.string()))
        if chars is not None:
            out = out.set_column(out.column_names.index("n_chars"), "n_chars", pa.array(chars, pa.int64()))
        return out.select(schema.names).cast(schema)

    return run


def _free(name: str, columns: list[str]) -> str:
    while name in columns:
        name += "_"
    return name


def _answers(spark: SparkSession, docs: DataFrame, length: int, base: int, buckets: int | None) -> tuple[DataFrame, DataFrame, str, str]:
    """The documents by home group, the starts of the windows to remove, and the documents' columns of group and checksum."""
    if length % base or (length // base) & (length // base - 1):
        raise ValueError("length must be base times a power of two")
    core.tune(spark)
    nbytes = core.text_bytes(docs)
    # Every bucket of hashes may have a message for every group of documents: hashes are compact, so there are fewer buckets than groups.
    buckets = buckets or core.group_count(core.partitions(spark) // 2, nbytes)
    homes, home, crc = HOMES * buckets, _free("home", docs.columns), _free("crc", docs.columns)
    homed = docs.withColumn(crc, F.coalesce(F.crc32(F.col("text").cast("string")), F.lit(0)))
    slim = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(crc).alias("crc")]
    sent, w = homed.select(*slim).mapInArrow(_first_level(length, base, buckets, homes), _SENT), base
    homed = core.dealt(spark, homed.withColumn(home, _home_of(F.col("doc_id"), F.col(crc), homes)), home, nbytes)
    slim = homed.select(F.col(home).alias("home"), *slim)
    while True:
        back = core.dealt(spark, sent, "bucket", nbytes).groupBy("bucket").applyInArrow(_resolve(w == length, homes), _BACK)
        back = core.dealt(spark, back, "home", nbytes)
        if w == length:
            return homed, back, home, crc
        # Survivors are few and small; the next level looks only at them.
        sent = slim.groupBy("home").cogroup(back.groupBy("home")).applyInArrow(_next_level(length, w, 2 * w, buckets, homes), _SENT)
        w *= 2


def digests(spark: SparkSession, docs: DataFrame, length: int = LENGTH, base: int | None = None, buckets: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the words that stay, for each row of docs(doc_id, text)."""
    homed, places, _, _ = _answers(spark, docs.select("doc_id", "text"), length, base or length // 2, buckets)
    slim = homed.select("home", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "crc")
    return slim.groupBy("home").cogroup(places.groupBy("home")).applyInArrow(_digest(length), DIGEST)


def rows(spark: SparkSession, docs: DataFrame, length: int = LENGTH, base: int | None = None, buckets: int | None = None) -> DataFrame:
    """The documents with repeated windows removed: untouched texts stay as they are, others are their words joined by spaces."""
    from pyspark.sql.pandas.types import to_arrow_schema

    homed, places, home, crc = _answers(spark, docs, length, base or length // 2, buckets)
    return homed.groupBy(home).cogroup(places.groupBy("home")).applyInArrow(_rewrite(length, to_arrow_schema(docs.schema), crc), docs.schema)
