"""SentencePiece encoding and decoding of merge-type (BPE) models, exact, by backtracking.

A merge-type encoding joins neighbours by score, which reads a text many times. The same ids come from left to right: at each place the
longest piece is tried that an Aho-Corasick automaton finds to start there, then its shorter prefixes. A piece may follow another only
if merging the two pieces' own text gives just these two back; a sequence in which all neighbours may stand together is the merge-type
encoding. Where no piece fits, the last one is taken back and its place marked in a bitfield as failed, so no place fails twice.

Nothing of a model of this kind spans a border between a character and a space mark (checked when the model is read), so a text is encoded
word by word, and a worker keeps the ids of the words that it has met, up to a fixed number of characters; short words
go through the same steps many at a time. Characters that no piece holds are bytes.

The model's file is read by the ``sentencepiece`` library; encoding and decoding are done here, and tests hold both against the library.

Defined cases: a null or empty text has no ids and decodes to the empty string; equal rows have equal values; an empty table gives an empty
result; texts and words of any length are encoded whole; a literal U+2581 is a space mark, as in the library; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import core

MARK = "▁"
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
#: Pairs of pieces of which a worker remembers whether they may stand together.
PAIRS = 1 << 19
#: What a worker remembers of words, in characters (and 8 for each); words up to LONG characters are encoded many at a time.
HELD, LONG = 6 << 20, 64
#: A worker remembers 2**SLOTS pairs of pieces in columns.
SLOTS = 20
_models: dict[str, Pieces] = {}
_known: dict[str, Words] = {}


def model(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


class Pieces:
    """A merge-type model: ``ids`` encodes, ``text`` decodes."""

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        _check_normalizer(library.serialized_model_proto())
        n = library.get_piece_size()
        self.pieces = [library.id_to_piece(i) for i in range(n)]
        self.byte_ids = [0] * 256
        self.bytes_of: list[bytes | None] = [None] * n  # what an id stands for; control ids for nothing
        self.rank: dict[str, tuple[float, int]] = {}  # a merge's place in line: higher scores first
        for i, piece in enumerate(self.pieces):
            if library.is_byte(i):
                value = int(_BYTE.fullmatch(piece)[1], 16)
                self.byte_ids[value], self.bytes_of[i] = i, bytes([value])
            elif library.is_control(i) or library.is_unknown(i):
                self.bytes_of[i] = b""
            elif library.is_unused(i):
                raise ValueError(f"{path}: unused pieces")
            else:
                self.rank[piece] = (-library.get_score(i), i)
                self.bytes_of[i] = piece.replace(MARK, " ").encode()
        if not all(self.byte_ids):
            raise ValueError(f"{path}: no byte fallback")
        self.id_of = {piece: i for piece, (_, i) in self.rank.items()}
        self.characters = {c for piece in self.rank for c in piece}
        if not self.characters <= self.rank.keys() or any(re.search(f"[^{MARK}]{MARK}", p) for p in self.rank):
            raise ValueError(f"{path}: pieces that span words, or characters without a piece")
        self.halves: dict[str, tuple[str, str]] = {}  # what the last merge of a piece joins
        whole = [p for p in self.rank if self.merge(p, self.halves) == [p]]  # a piece that merging never makes is never an id
        self.after: dict[str, dict[str, bool]] = {}
        self.pairs = 0
        self.ends: dict[str, tuple | None] = {}
        self.begins: dict[str, tuple | None] = {}
        self.shorter = dict(zip(whole, _prefixes(whole), strict=True))
        # Read from its end, a word's longest match that ends at a place is the longest piece that starts there; single characters need no search.
        self.automaton = ahocorasick.Automaton()
        for i, piece in enumerate(whole):
            if len(piece) > 1:
                self.automaton.add_word(piece[::-1], i + 1)
        self.automaton.make_automaton()
        # The same as columns, by a piece's place among those that merging makes; 0 is none.
        number = {piece: i + 1 for i, piece in enumerate(whole)}
        self.names = ["", *whole]
        self.length = np.array([len(p) for p in self.names])
        self.next = np.array([0, *(number.get(self.shorter[p], 0) for p in whole)])
        self.ids_by_number = [-1, *(self.id_of[p] for p in whole)]
        self.decimal_of = [*map(str, range(n))]
        self.seen = np.full(1 << SLOTS, -1)  # pairs that were tried, by a hash of theirs: 2 * pair + whether they fit
        self.single = np.zeros(0x110000, dtype=np.int32)
        for piece in whole:
            if len(piece) == 1:
                self.single[ord(piece)] = number[piece]
        known = "".join(map(re.escape, sorted(self.characters - {MARK})))
        self.cut = re.compile(f"{MARK}*[{known}]+|{MARK}+|[^{known}{MARK}]+")
        self.between = next(c for c in map(chr, range(0x110000)) if c not in self.characters)

    def merge(self, text: str, halves: dict | None = None) -> list[str]:
        """The merge-type encoding of a short text by its definition: the best-scored neighbours are joined, the leftmost first."""
        parts = list(text)
        while True:
            best = min(((self.rank[j][0], i) for i, j in enumerate(map(str.__add__, parts, parts[1:])) if j in self.rank), default=None)
            if best is None:
                return parts
            i = best[1]
            if halves is not None and len(parts) == 2:
                halves[text] = parts[0], parts[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _lives(self, piece: str, side: int) -> tuple[tuple[str, float, float], ...] | None:
        """What stands at the piece's border (side 0: its begin, 1: its end) while it is merged, last first: (part, when it is made, when it is used up).

        None if its merges don't come in the order of their scores, as between spaces, which all score alike.
        """
        out, until = [], math.inf
        while len(piece) > 1:
            halves = self.halves[piece]
            made = self.rank[piece][0]
            if any(len(h) > 1 and self.rank[h][0] >= made for h in halves):
                return None
            out.append((piece, made, until))
            piece, until = halves[side], made
        return *out, (piece, -math.inf, until)

    def compatible(self, left: str, right: str) -> bool:
        """Whether the two pieces stay as they are when their text is merged again.

        Merges inside of either piece are as they were unless one joins across the border. So only these are tried again: a part that stands at the
        end of the left piece for some time, and one that stands at the begin of the right piece at that time too.
        """
        if left not in self.ends:
            self.ends[left] = self._lives(left, 1)
        if right not in self.begins:
            self.begins[right] = self._lives(right, 0)
        ends, begins = self.ends[left], self.begins[right]
        if ends is None or begins is None:
            return self.merge(left + right) == [left, right]
        i = j = 0
        while True:
            (a, a_made, a_until), (b, b_made, b_until) = ends[i], begins[j]
            if (joined := self.rank.get(a + b)) is not None:
                when = max(joined[0], a_made, b_made)
                if when < a_until and when <= b_until:  # of equal scores the leftmost merge comes first
                    return False
            if a_made > b_made:
                i += 1
            elif j + 1 < len(begins):
                j += 1
            elif i + 1 < len(ends):
                i += 1
            else:
                return True

    def _run(self, text: str) -> list[str]:
        """The pieces of a text all of whose characters the model knows."""
        n, shorter = len(text), self.shorter
        # Of the pieces that end at a place the automaton gives the longest first.
        longest = {at: self.names[i] for at, i in reversed([*self.automaton.iter(text[::-1])])}
        longest = [longest.get(n - 1 - at, c) for at, c in enumerate(text)]
        failed, some_failed, out, at, last = bytearray(n // 8 + 1), False, [], 0, ""
        piece: str | None = longest[0]
        while at < n:
            after = self.after.get(last) or self._row(last)
            while piece is not None:
                end = at + len(piece)
                if not (some_failed and failed[end >> 3] >> (end & 7) & 1):
                    fits = after.get(piece)
                    if fits is None:
                        fits = after[piece] = not out or self.compatible(last, piece)
                        self.pairs += 1
                    if fits:
                        break
                piece = shorter[piece]
            if piece is not None:
                out.append(piece)
                at, last = end, piece
                piece = longest[at] if at < n else None
            else:  # nothing fits here after the last piece: no encoding has a border at this place
                failed[at >> 3] |= 1 << (at & 7)
                some_failed = True
                piece = out.pop()
                at -= len(piece)
                last = out[-1] if out else ""
        return out

    def _row(self, last: str) -> dict[str, bool]:
        """Which pieces may follow this one, as far as it is known."""
        if self.pairs >= PAIRS:
            self.after.clear()
            self.pairs = 0
        return self.after.setdefault(last, {"": False})

    def _word(self, word: str) -> list[int]:
        """The ids of one part that ``split`` gives."""
        if word[-1] in self.characters:
            return [*map(self.id_of.__getitem__, self._run(word))]
        return [*map(self.byte_ids.__getitem__, word.encode())]

    def _fit(self, last: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """``compatible`` for many pairs; each different pair that isn't remembered is tried once."""
        pair = last << 20 | piece
        slot = (pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOTS)).astype(np.int64)
        found = self.seen[slot]
        missing = np.flatnonzero(found >> 1 != pair)
        if len(missing):
            new, back = np.unique(pair[missing], return_inverse=True)
            fits = np.fromiter((not k >> 20 or self.compatible(self.names[k >> 20], self.names[k & 0xFFFFF]) for k in new.tolist()), dtype=np.int64, count=len(new))
            found[missing] = self.seen[slot[missing]] = (new << 1 | fits)[back]
        return (found & 1).astype(bool)

    def side_by_side(self, words: list[str]) -> tuple[list[int], list[int]]:
        """The pieces' numbers of many words of known characters, one after the other, and each word's bounds: ``_run`` on all of them at a time."""
        text = self.between.join(words) + self.between
        n = len(text)
        made, before, failed = np.zeros(n + 1, dtype=np.int64), np.zeros(n + 1, dtype=np.int64), np.zeros(n + 1, dtype=bool)
        longest = self.single[np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)].astype(np.int64)
        found = np.fromiter(itertools.chain.from_iterable(self.automaton.iter(text[::-1])), dtype=np.int64).reshape(-1, 2)[::-1]
        longest[n - 1 - found[:, 0]] = found[:, 1]
        stop = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        at = np.concatenate([[0], stop[:-1] + 1])
        bounds, piece, last = np.append(at, n), longest[at], np.zeros(len(at), dtype=np.int64)
        while len(at):
            end = at + self.length[piece]
            fits = (piece > 0) & ~failed[end] & self._fit(last, piece)
            here, there = at[fits], piece[fits]
            made[here], before[here] = there, last[fits]
            at = np.where(fits, end, at)
            last, tried = np.where(fits, piece, last), piece
            piece = np.where(fits, longest[at], self.next[piece])
            stuck = np.flatnonzero(~fits & (tried == 0))
            if len(stuck):  # nothing fits after the last piece
                failed[at[stuck]] = True
                piece[stuck] = last[stuck]
                at[stuck] -= self.length[last[stuck]]
                last[stuck] = before[at[stuck]]
                made[at[stuck]] = 0
            going = at < stop
            at, stop, piece, last = at[going], stop[going], piece[going], last[going]
        places = np.flatnonzero(made)
        return made[places].tolist(), np.searchsorted(places, bounds).tolist()

    def many(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """Each word, as ``split`` gives it, and its ids; the short ones side by side."""
        short = [w for w in words if len(w) <= LONG and w[-1] in self.characters]
        if short:
            numbers, bounds = self.side_by_side(short)
            ids = [*map(self.ids_by_number.__getitem__, numbers)]
            for word, a, b in zip(short, bounds, bounds[1:], strict=False):
                yield word, ids[a:b]
        if len(short) < len(words):
            for word in words:
                if len(word) > LONG or word[-1] not in self.characters:
                    yield word, self._word(word)

    def split(self, text: str) -> list[str]:
        """The words of a text, each with the space marks before it, and runs of characters without a piece; the library puts a mark in front."""
        return self.cut.findall(MARK + text.replace(" ", MARK)) if text else []

    def ids(self, text: str) -> list[int]:
        """What the library's ``encode`` gives, without begin and end ids."""
        return [i for word in self.split(text) for i in self._word(word)]

    def text(self, ids) -> str:
        """What the library's ``decode`` gives: the pieces' bytes; the mark in front goes."""
        return _without_mark(b"".join(map(self.bytes_of.__getitem__, ids))).decode("utf-8", "replace")


def _without_mark(data: bytes) -> bytes:
    return data[1:] if data[:1] == b" " else data


def _prefixes(pieces: list[str]) -> Iterator[str | None]:
    """For each piece the longest other piece that it starts with."""
    known = set(pieces)
    for piece in pieces:
        yield next((piece[:k] for k in range(len(piece) - 1, 0, -1) if piece[:k] in known), None)


def _check_normalizer(proto: bytes) -> None:
    """The model must leave texts as they are but for the mark in front: fields of NormalizerSpec (field 3 of the model's message)."""

    def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
        at = 0

        def number() -> int:
            nonlocal at
            value = shift = 0
            while True:
                value |= (data[at] & 127) << shift
                shift, at = shift + 7, at + 1
                if data[at - 1] < 128:
                    return value

        while at < len(data):
            field, kind = divmod(number(), 8)
            if kind == 0:
                yield field, number()
            else:
                size = {1: 8, 5: 4}[kind] if kind != 2 else number()
                yield field, data[at : at + size]
                at += size

    spec = dict(fields(dict(fields(proto)).get(3, b"")))
    # Defaults of the format: 2 the character map, 3 a mark in front, 4 extra spaces go, 5 spaces become marks.
    if spec.get(2, b"") or not spec.get(3, 1) or spec.get(4, 1) or not spec.get(5, 1):
        raise ValueError("only models that put a mark in front and change nothing else")


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Words(dict):
    """word -> (the number of its ids, the ids in decimal, what they decode to), for the words of the texts that a worker has at hand and many before."""

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces, self.held = pieces, 0

    def learn(self, words: Iterable[str]) -> None:
        """Add words; those that were known before may go, if they are more than HELD characters, and then ``words`` are known alone."""
        if self.held > HELD:
            self.clear()
            self.held = 0
        new = [*set(words).difference(self)]
        self.held += sum(map(len, new)) + 8 * len(new)
        bytes_of, decimal = self.pieces.bytes_of, self.pieces.decimal_of
        for word, ids in self.pieces.many(new):
            self[word] = len(ids), ",".join([*map(decimal.__getitem__, ids)]), b"".join([*map(bytes_of.__getitem__, ids)])


def digests(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of docs(doc_id, text): one pass, no shuffle."""
    core.tune(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        known = _known.setdefault(path, Words(pieces))
        for batch in batches:
            for part, buf, bounds in core.chunks([batch]):
                texts = [pieces.split(core.text_of(buf, a, b)) for a, b in zip(bounds, bounds[1:], strict=False)]
                with core.without_cycle_search():
                    known.learn(itertools.chain.from_iterable(texts))
                rows = []
                for doc_id, words in zip(part.column("doc_id").to_pylist(), texts, strict=True):
                    found = [*map(known.__getitem__, words)]
                    ids = hashlib.sha256(",".join([x[1] for x in found]).encode())
                    decoded = hashlib.sha256(_without_mark(b"".join([x[2] for x in found])))
                    rows.append((doc_id, sum([x[0] for x in found]), ids.hexdigest(), decoded.hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def encoded(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """The rows of ``docs`` with a column ``ids`` (replaced if it is there), all others kept."""
    core.tune(spark)

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        pieces = model(path)
        known = _known.setdefault(path, Words(pieces))

        def one(text) -> list[int]:
            words = pieces.split(text or "")
            known.learn(words)
            return [int(i) for w in words for i in known[w][1].split(",")]

        return texts.map(one)

    return docs.withColumn("ids", ids(F.col("text").cast("string")))


def decoded(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """The rows of ``docs`` with the text of their column ``ids``; null ids decode to the empty string."""
    core.tune(spark)

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        pieces = model(path)
        return ids.map(lambda x: pieces.text([] if x is None else x))

    return docs.withColumn("text", text(F.col("ids")))
