"""Best-fit decreasing packing of token sequences, exact over the whole corpus.

Best-fit decreasing only looks at lengths, and there are at most ``width`` of them: so the plan is made from the number
of pieces of each length. Lengths are taken in falling order; a segment tree over the remaining capacities finds
the tightest open bin in logarithmic time, and all open bins of that capacity are filled in one step. The plan is a
table of runs (length, ranks, first bin, offset); a piece finds its place by its rank among the pieces of its length.
So neither the driver nor a task ever holds the documents: the driver holds ``width`` counts and the runs.

Defined cases: a null or empty text is its end token alone; rows with one doc_id are documents of their own; an empty table
gives an empty result; texts of any length are cut into pieces of ``width`` tokens, the first being the shorter one; runs of
white space of any length take time by their length.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import core

WIDTH = 1024
END = 2
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, nth long"
_TYPES = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
#: White space as the vocabulary's pattern takes it (Unicode's White_Space; Python's \\s has four control characters more).
_WHITE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: From so many on end, a run is cut out before the pattern sees it: the pattern's lookahead takes time by the run's square.
LONG_SPACE = 32
_BLANK = re.compile(f"{_WHITE}{{{LONG_SPACE},}}")
_encoders: dict[tuple[str, bool], Callable[[str], list[int]]] = {}


def encoder(path: str, added: bool = False) -> Callable[[str], list[int]]:
    """text -> ids, as the ``tokenizers`` library gives with that file, where nothing is put around the text.

    With ``added``, the file's added tokens are found in the text, which is the library's default; without, they are plain text.
    Byte-level BPE is a function of the vocabulary's ranks, so the merge loop runs in ``tiktoken``, which is four times
    as fast on one core; the ranks come from the same file's vocabulary (tests hold the ids against ``tokenizers``).
    """
    if (path, added) not in _encoders:
        _encoders[path, added] = _make_encoder(path, added)
    return _encoders[path, added]


def token_bytes(path: str) -> list[bytes | None]:
    """What each id of a byte-level vocabulary stands for; None for added tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    # Byte-level vocabularies print each byte as one character: the printable ones as themselves, the rest from U+0100 on.
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    out: list[bytes | None] = [None] * (max([*spec["model"]["vocab"].values(), *added.values()]) + 1)
    for token, i in spec["model"]["vocab"].items():
        if token not in added:
            out[i] = bytes(byte[c] for c in token)
    return out


def _make_encoder(path: str, added: bool) -> Callable[[str], list[int]]:
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    if any(t.get(flag) for t in spec.get("added_tokens", []) for flag in ("lstrip", "rstrip", "single_word")):
        raise ValueError(f"{path}: added tokens that take in spaces or stand alone")
    ranks = {b: i for i, b in enumerate(token_bytes(path)) if b is not None}
    make = partial(tiktoken.Encoding, mergeable_ranks=ranks, special_tokens=special)
    quick, one = make("byte_bpe", pat_str=public_tokenizers.PATTERN), make("one_piece", pat_str=r"(?s).+")
    stops = tuple(special) if added else ()

    def plain_ids(text: str) -> list[int]:
        return quick.encode(text, allowed_special="all") if added else quick.encode_ordinary(text)

    def encode(text: str) -> list[int]:
        if len(text) < LONG_SPACE:
            return plain_ids(text)
        ids, at = [], 0
        for m in _BLANK.finditer(text):
            # The pattern takes a run up to its last character, which goes with what follows; at the end it takes all of it.
            end = m.end() if m.end() == len(text) or text.startswith(stops, m.end()) else m.end() - 1
            ids += plain_ids(text[at : m.start()]) + one.encode_ordinary(text[m.start() : end])
            at = end
        return ids + plain_ids(text[at:]) if at else plain_ids(text)

    return encode


def pieces(docs: DataFrame, path: str, width: int = WIDTH, end: int = END) -> DataFrame:
    """Each piece of docs(doc_id, text), and nth: how many pieces of its length its task made before it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, made = encoder(path, added=True), [0] * (width + 1)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: list[tuple] = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = np.array(encode(text or "") + [end], dtype="<u4")
                    first = len(ids) % width or width
                    bounds = [0, *range(first, len(ids) + 1, width)]
                    for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                        rows.append((doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), made[b - a]))
                        made[b - a] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "nth"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, _PIECES)


class SegmentTree:
    """The open bins by remaining capacity: counts per capacity, and the smallest capacity of at least some length."""

    def __init__(self, width: int):
        self.size = 1 << width.bit_length()
        self.tree = [0] * (2 * self.size)

    def add(self, capacity: int, n: int) -> None:
        i = capacity + self.size
        while i:
            self.tree[i] += n
            i >>= 1

    def tightest(self, length: int) -> int | None:
        """The smallest capacity >= length that has an open bin."""
        i = length + self.size
        if self.tree[i]:
            return length
        while i > 1:  # up until a right sibling has bins, then down its left side
            if not i & 1 and self.tree[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def plan(counts: dict[int, int], width: int = WIDTH) -> np.ndarray:
    """Best-fit decreasing on counts of lengths: runs (length, first rank, first bin, pieces a bin, first offset), sorted."""
    tree, free, bins, runs = SegmentTree(width), {}, 0, []
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, per = width, width // length
                want = -(-left // per)
                first, have = bins, want
                bins += want
            else:
                first, have = free[capacity].pop()
                per = capacity // length
                tree.add(capacity, -have)
                want = min(have, -(-left // per))
                if have > want:
                    free[capacity].append((first + want, have - want))
                    tree.add(capacity, have - want)
            placed = min(left, want * per)
            runs.append((length, rank, first, per, width - capacity))
            full, odd = divmod(placed, per)
            for at, n, used in ((first, full, per), (first + full, 1 if odd else 0, odd)):
                if n and (rest := capacity - used * length):
                    free.setdefault(rest, []).append((at, n))
                    tree.add(rest, n)
            rank += placed
            left -= placed
    return np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)


def pack(spark: SparkSession, docs: DataFrame, path: str, width: int = WIDTH, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece."""
    core.tune(spark)
    # Written once, so that a piece's number within its part stays what it was when a task is run again.
    cut = core.keep(spark, pieces(docs, path, width, end).withColumn("part", F.spark_partition_id()), "pieces")
    by_part = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_part = by_part.select(F.col("length").alias("l"), F.col("part").alias("p"), earlier.alias("before"))
    runs = plan({r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}, width)
    ranked = cut.join(by_part, (F.col("length") == F.col("l")) & (F.col("part") == F.col("p"))).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One sorted key for (length, rank): the length's runs begin where its key begins.
        step = int(runs[:, 1].max(initial=0)) + 1
        keys = runs[:, 0] * step + runs[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            run = runs[np.searchsorted(keys, length * step + np.minimum(rank, step - 1), side="right") - 1]
            bin_, nth = np.divmod(rank - run[:, 1], run[:, 3])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(run[:, 2] + bin_), pa.array(run[:, 4] + nth * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
