"""Aligning the tokens of two tokenizers by the bytes at which both end.

Each byte of a text has a label: no token ends with it, one of A, one of B, or one of both. A regular expression runs over the string of labels and gives
the spans up to each label for both; how many labels of A and of B a span holds is how many tokens its group has.

Both tokenizers cut where one space stands between two characters that aren't white space, so texts are cut there and each different chunk is labelled once; a
worker keeps the chunks that it has met, up to a fixed number of characters. A is a byte-level merge vocabulary, B a model of ``pieces``.

How often two ids are linked in the whole corpus is a sum over blocks of texts: a block sends each of its pairs once with its number, gets the corpus-wide counts of
just these back, and its rows are completed beside them. So a pair that is in every text costs a row for each block, and no table of all pairs goes to a task.

Defined cases: null and empty texts, and texts whose tokens don't stand for the text's own bytes (a literal U+2581, which B takes for a space), have no tokens; rows
with one doc_id are rows of their own, each of which counts; texts of any length are aligned whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import core, packing, pieces

#: A label for each byte: no end, the end of a token of A, of B, of both.
NONE, A_END, B_END, BOTH = b"n", b"a", b"b", b"x"
_LABELS = np.frombuffer(NONE + A_END + B_END + BOTH, dtype=np.uint8)
_SPAN = re.compile(b"[^" + BOTH + b"]*" + BOTH)
#: Python's white space is all that the patterns of byte-level vocabularies take for it, and more.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: What a worker remembers of chunks, in characters and 16 for each; the text that a block holds, in bytes.
HELD, BLOCK = 8 << 20, 8 << 20
_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


def labels(a_ends: np.ndarray, b_ends: np.ndarray, n: int) -> bytes:
    """The label string of n bytes, given the places of the tokens' last bytes."""
    kinds = np.zeros(n, dtype=np.uint8)
    kinds[a_ends] |= 1
    kinds[b_ends] |= 2
    return _LABELS[kinds].tobytes()


class _Counts(dict):
    """span of labels for an end -> (tokens of A, tokens of B)"""

    def __missing__(self, span: bytes) -> tuple[int, int]:
        found = self[span] = span.count(A_END) + 1, span.count(B_END) + 1
        return found


def spans(labelled: bytes) -> list[tuple[int, int]]:
    """(tokens of A, tokens of B) of each group: the labels in the spans up to a label for both; bytes that end nothing are passed over."""
    if len(_counts) > 1 << 16:
        _counts.clear()
    return [*map(_counts.__getitem__, _SPAN.findall(labelled.translate(None, NONE)))]


_counts = _Counts()


class Aligner(dict):
    """chunk -> (tokens of A, tokens of B, its groups as text, its links as a_id << 32 | b_id), or None if the tokens' bytes aren't its own."""

    def __init__(self, a_path: str, b_path: str):
        super().__init__()
        self.a, self.b, self.held = packing.encoder(a_path), pieces.model(b_path), 0
        self.a_bytes = packing.token_bytes(a_path)
        self.decimal = [*map(str, range(max(len(self.a_bytes), len(self.b.bytes_of))))]

    def learn(self, chunks: Iterable[str]) -> None:
        """Add chunks; those that were known before may go, if they are more than HELD characters."""
        if self.held > HELD:
            self.clear()
            self.held = 0
        new = [*set(chunks).difference(self)]
        self.held += sum(map(len, new)) + 16 * len(new)
        cut = [*map(self.b.split, new)]
        words = dict(self.b.many([*set(itertools.chain.from_iterable(cut))]))
        a_ids = [self.a(" " + chunk) for chunk in new]
        b_ids = [words[parts[0]] if len(parts) == 1 else [i for w in parts for i in words[w]] for parts in cut]
        if not self._own_bytes(new, a_ids, b_ids):  # some chunk's tokens don't stand for its own bytes
            fine = [self._own_bytes([chunk], [a], [b]) for chunk, a, b in zip(new, a_ids, b_ids, strict=True)]
            self.update((chunk, None) for chunk, ok in zip(new, fine, strict=True) if not ok)
            new, a_ids, b_ids = ([x for x, ok in zip(xs, fine, strict=True) if ok] for xs in (new, a_ids, b_ids))
        if new:
            self._label(new, a_ids, b_ids)

    def _own_bytes(self, chunks: list[str], a_ids: list[list[int]], b_ids: list[list[int]]) -> bool:
        """Whether the tokens of each chunk stand for its bytes: their lengths chunk by chunk, and all bytes in a row."""
        a, b = ([[table[i] for i in ids] for ids in side] for side, table in ((a_ids, self.a_bytes), (b_ids, self.b.bytes_of)))
        joined = [[*map(b"".join, side)] for side in (a, b)]
        return [*map(len, joined[0])] == [*map(len, joined[1])] and b"".join(joined[0]) == b"".join(joined[1]) == " ".join(["", *chunks]).encode()

    def _label(self, chunks: list[str], a_ids: list[list[int]], b_ids: list[list[int]]) -> None:
        """One string of labels for all chunks; each ends with a label for both, so no span holds bytes of two."""
        all_a, all_b = [*itertools.chain.from_iterable(a_ids)], [*itertools.chain.from_iterable(b_ids)]
        a_ends, b_ends = (np.cumsum([len(table[i]) for i in ids]) - 1 for table, ids in ((self.a_bytes, all_a), (self.b.bytes_of, all_b)))
        found = spans(labels(a_ends, b_ends, int(a_ends[-1]) + 1))
        a_text, b_text = [*map(self.decimal.__getitem__, all_a)], [*map(self.decimal.__getitem__, all_b)]
        groups, i, j = [], 0, 0
        for m, n in found:
            groups.append(f"{a_text[i]}|{b_text[j]}" if m == n == 1 else f"{','.join(a_text[i : i + m])}|{','.join(b_text[j : j + n])}")
            i, j = i + m, j + n
        # The link of a group is between its last tokens; a chunk's last group is the one that its last token of A ends.
        a_last, b_last = (np.cumsum(side) - 1 for side in zip(*found, strict=True))
        links = (np.array(all_a)[a_last] << 32 | np.array(all_b)[b_last]).tolist()
        sizes = [*map(len, a_ids)]
        stops = (np.searchsorted(a_last, np.cumsum(sizes) - 1) + 1).tolist()
        for chunk, m, b, start, stop in zip(chunks, sizes, b_ids, [0, *stops], stops, strict=False):
            self[chunk] = m, len(b), ";".join(groups[start:stop]), tuple(links[start:stop])

    def chunks(self, text: str | None) -> list[str]:
        """The chunks of space + text, without the space that each begins with; none if the text has no tokens."""
        return _CUT.split(text) if text and pieces.MARK not in text else []

    def found(self, texts: list[str]) -> Iterator[list]:
        """What is known of the chunks of each text."""
        cut = [*map(self.chunks, texts)]
        self.learn(itertools.chain.from_iterable(cut))
        for chunks in cut:
            yield [*map(self.__getitem__, chunks)]

    def __call__(self, text: str | None) -> list[tuple[list[int], list[int]]]:
        """The groups of one text: the ids of A and of B."""
        (found,) = self.found([text])
        if None in found or not found:
            return []
        sides = [g.split("|") for f in found for g in f[2].split(";")]
        return [([*map(int, a.split(","))], [*map(int, b.split(","))]) for a, b in sides]


_BLOCKS = "block long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, at binary, times binary, pair long, n long"
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
_NAMES = [c.split()[0] for c in _BLOCKS.split(", ")]
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _batch(columns: dict, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, t) for c, t in zip(_NAMES, _TYPES, strict=True)], _NAMES)


def _blocks(a_path: str, b_path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of two kinds: the documents of a block with their links, by the places of the pairs among the block's; and the block's pairs."""
    known, task = aligner(a_path, b_path), TaskContext.get().partitionId() << 32
    docs: list[tuple] = []
    links: list[np.ndarray] = []
    held = number = 0

    def made() -> Iterator[pa.RecordBatch]:
        pair, at = np.unique(np.concatenate([x[0] for x in links]), return_inverse=True)
        times = np.concatenate([x[1] for x in links])
        n = np.bincount(at, weights=times, minlength=len(pair)).astype(np.int64)
        ends = np.cumsum([len(x[0]) for x in links])
        at, times = at.astype("<u4"), times.astype("<u4")
        parts = [(at[a:b].tobytes(), times[a:b].tobytes()) for a, b in zip(np.append(0, ends[:-1]), ends, strict=True)]
        block = task | number
        columns = {c: pa.array(v, t) for c, v, t in zip(_NAMES[1:8], [*zip(*docs, strict=True), *zip(*parts, strict=True)], _TYPES[1:8], strict=True)}
        yield _batch(columns | {"block": pa.array(np.full(len(docs), block))}, len(docs))
        yield _batch({"block": pa.array(np.full(len(pair), block)), "pair": pa.array(pair), "n": pa.array(n)}, len(pair))

    for batch in batches:
        for part, buf, bounds in core.chunks([batch]):
            with core.without_cycle_search():
                for doc_id, found in zip(part.column("doc_id").to_pylist(), known.found([core.text_of(buf, a, b) for a, b in zip(bounds, bounds[1:], strict=False)]), strict=True):
                    if found and None not in found:
                        joined = hashlib.sha256(";".join([x[2] for x in found]).encode()).hexdigest()
                        pairs = np.fromiter(itertools.chain.from_iterable([x[3] for x in found]), dtype=np.int64)
                        docs.append((doc_id, sum([x[0] for x in found]), sum([x[1] for x in found]), len(pairs), joined))
                        links.append(np.unique(pairs, return_counts=True))
                    else:
                        docs.append((doc_id, 0, 0, 0, ""))
                        links.append((np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)))
            held += len(buf)
            if held > BLOCK:
                yield from made()
                docs, links, held, number = [], [], 0, number + 1
    if docs:
        yield from made()


def _complete(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """A block's documents with what the corpus says of their links."""
    pair = answers.column("pair").to_numpy()
    order = np.argsort(pair)
    count, best = answers.column("count").to_numpy()[order], answers.column("best").to_numpy()[order]
    n_best, sums, n_links = [], [], []
    for at, times in zip(docs.column("at").to_pylist(), docs.column("times").to_pylist(), strict=True):
        at, times = np.frombuffer(at, dtype="<u4"), np.frombuffer(times, dtype="<u4").astype(np.int64)
        n_links.append(int(times.sum()))
        n_best.append(int(times[best[at]].sum()))
        sums.append(int((times * count[at]).sum()))
    found = {"n_links": pa.array(n_links, pa.int64()), "n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(sums, pa.int64())}
    names = [c.split()[0] for c in RESULT.split(", ")]
    return pa.table([found[c] if c in found else docs.column(c) for c in names], names)


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def align(spark: SparkSession, docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of docs(doc_id, text)."""
    core.tune(spark)
    scratch = core.Scratch(spark)
    blocks = scratch.keep(_read(docs).mapInArrow(lambda batches: _blocks(a_path, b_path, batches), _BLOCKS), "blocks")
    asked = blocks.where("pair is not null").select("block", "pair", "n")
    counts = scratch.keep(asked.groupBy("pair").agg(F.sum("n").alias("count")), "counts")
    b_id = F.col("pair").bitwiseAND(0xFFFFFFFF)
    # As many rows as B has ids.
    highest = F.broadcast(counts.groupBy(b_id.alias("b_id")).agg(F.max("count").alias("most")))
    counts = counts.withColumn("b_id", b_id).join(highest, "b_id").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    answers = asked.select(F.col("block").alias("of"), "pair").join(counts, "pair")
    rows = blocks.where("pair is null").drop("pair", "n")
    out = rows.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(_complete, RESULT)
    return scratch.finish(out, "alignment")


def groups(spark: SparkSession, docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row for each group of each text: doc_id, nth (from 0), start and stop in the bytes of space + text, a_ids, b_ids."""
    core.tune(spark)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
    names = ["doc_id", "nth", "start", "stop", "a_ids", "b_ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = aligner(a_path, b_path)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                rows, at = [], 0
                for k, (a, b) in enumerate(known(text.as_py())):
                    size = sum(len(known.a_bytes[i]) for i in a)
                    rows.append((doc_id, k, at, at + size, a, b))
                    at += size
                for k in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 10_000], strict=True), kinds, strict=True)], names)

    return _read(docs).mapInArrow(run, "doc_id long, nth long, start long, stop long, a_ids array<int>, b_ids array<int>")
