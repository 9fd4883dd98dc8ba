"""LM scoring with Brown class-based bigrams.

log10 P(text) = sum over tokens of log10 P(class | class before) + log10 P(token | class). Tokens are lower-cased words and one
end, which is also the context of the first word.

Learning. All training words are counted (by 64-bit hash, summed in each task before they are sent). Units are the ``UNITS``
most frequent words, one unit for each of ``FORMS`` word endings (all other words, by their last three bytes), and the end. Exchange
clustering moves units between classes, ``CLASSES`` and more in larger corpora, while the class bigram likelihood of the corpus grows.
Then every other word that occurs ``LEAST`` times gets a class by its own neighbours: their classes are counted for each word,
and it goes where the corpus is most likely with the other words' classes as they are. Only rarer words keep their ending's
class. Class bigrams are counted again after that. Emissions discount every count by D (Kneser and Ney's estimate from the words seen once and twice); what a class's words
lose goes to its unseen words, one unknown type for each ending. Transitions are smoothed towards class frequencies. So the probabilities of
the next token, all known words and unknown types together, add up to one.

Scoring. Counts of the ``HEAD`` most frequent words are held in every task (16 bytes each); for the other words of a
text the task sends (hash, row, times) to the bucket that holds the word's count, which sends sums by row back. Classes of words
outside the head that occur ``LEAST`` times are held in every task too (10 bytes each).

Defined cases: null and empty texts are the end alone; nothing learned: both scores are 0; rows with one doc_id are scored
one by one; a null doc_id counts as a training row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import core
from .language_id import held_out

UNITS, FORMS, CLASSES, SWEEPS = 1000, 256, 64, 12
#: Words that occur so often have classes of their own; classes grow with the fourth root of the tokens, from CLASSES at so many.
LEAST, BASE_TOKENS = 5, 10_000_000
HEAD = 1 << 17
SMOOTH = 4.0
#: Rows whose answers are added up together, for each bucket of words.
HOMES = 2
_U = np.uint64
_HELD = 4_000_000


# --- packed messages --------------------------------------------------------------------------------------


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length by byte planes: high bytes are mostly equal and compress."""
    n = len(arrays[0])
    return b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(n, -1).T).tobytes() for a in arrays)


def _unpack(types, blobs: list[bytes]) -> list[np.ndarray]:
    sizes = [np.dtype(t).itemsize for t in types]
    out: list[list] = [[np.empty(0, dtype=t)] for t in types]
    for blob in blobs:
        n, at = len(blob) // sum(sizes), 0
        for k, (t, size) in enumerate(zip(types, sizes, strict=True)):
            out[k].append(np.ascontiguousarray(np.frombuffer(blob, np.uint8, n * size, at).reshape(size, n).T).view(t).ravel())
            at += n * size
    return [np.concatenate(x) for x in out]


def _split(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else []
    for a, b in zip(cut, [*cut[1:], len(keys)], strict=True) if len(keys) else ():
        yield int(keys[a]), order[a:b]


def _rows(names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary() if n == "data" else pa.int64()) for k, n in enumerate(names)], names)


def _sums(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys and the sums of their values; the last value is the first of its key."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, dtype=np.int64)
    return (key[first], *(np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values[:-1]), values[-1][order][first])


# --- words and counts -------------------------------------------------------------------------------------


def _forms(words: core.Words) -> np.ndarray:
    """The ending of each word: a number made of its last three bytes, lower-cased."""
    buf = words.buf
    low = np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint64)
    key = np.zeros(len(words), dtype=np.uint64)
    for k in (1, 2, 3):
        at = words.end - k
        key = (key << _U(8)) | np.where(at >= words.start, low[np.maximum(at, 0)], _U(0))
    return (core.mix(key) % _U(FORMS)).astype(np.uint16)


_COUNT = (np.uint64, np.int64, np.uint16)


def _count_words(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def send():
            h, c, f = _sums(*(np.concatenate(x) for x in zip(*held, strict=True)))
            return _rows(["bucket", "data"], [(b, _pack(h[at], c[at], f[at])) for b, at in _split((h % _U(buckets)).astype(np.int64))])

        for _, buf, bounds in core.chunks(batches):
            words = core.Words(buf, bounds)
            h = words.hashes()
            held.append(_sums(h, np.ones(len(h), dtype=np.int64), _forms(words)))
            size += len(held[-1][0])
            if size > _HELD:
                yield send()
                held, size = [], 0
        if held:
            yield send()

    return run


def _level(count: np.ndarray) -> np.ndarray:
    """Counts on a scale that is exact up to 256 and then has 32 steps an octave."""
    wide = np.maximum(count, 256)
    octave = np.floor(np.log2(wide)).astype(np.int64)
    return np.where(count <= 256, count, 256 + (octave - 8) * 32 + ((wide - (1 << octave)) * 32 >> octave)).astype(np.int64)


def _add_counts(table: pa.Table) -> pa.Table:
    """A bucket's distinct words with counts; and its statistics: for each ending tokens, types, and those seen once and twice; words by level."""
    h, c, f = _sums(*_unpack(_COUNT, table.column("data").to_pylist()))
    stats = np.stack([np.bincount(f, weights=w, minlength=FORMS) for w in (c, np.ones(len(c)), c == 1, c == 2)]).astype(np.int64)
    levels = np.bincount(_level(c), minlength=1)
    data = [(table.column("bucket")[0].as_py(), 0, _pack(h, c, f)), (-1, 1, stats.tobytes()), (-1, 2, levels.astype(np.int64).tobytes())]
    return pa.Table.from_batches([_rows(["bucket", "kind", "data"], data)])


def _padded_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = max(len(a), len(b))
    return np.pad(a, (0, n - len(a))) + np.pad(b, (0, n - len(b)))


def _add_statistics(table: pa.Table) -> pa.Table:
    """The sum of some buckets' statistics of one kind."""
    total = np.zeros(0, dtype=np.int64)
    for blob in table.column("data").to_pylist():
        total = _padded_sum(total, np.frombuffer(blob, dtype=np.int64))
    return pa.Table.from_batches([_rows(["kind", "data"], [(table.column("kind")[0].as_py(), total.tobytes())])])


# --- clustering -------------------------------------------------------------------------------------------


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Classes of units by the exchange algorithm. The last unit (the end) keeps a class of its own, the last one."""
    a = bigrams.astype(np.float64)
    n = len(a)
    total = a.sum(axis=1) + a.sum(axis=0)
    order = np.argsort(-total[:-1], kind="stable")
    where = np.empty(n, dtype=np.int64)
    where[order] = np.arange(n - 1) % (classes - 1)
    where[-1] = classes - 1
    member = np.zeros((n, classes))
    member[np.arange(n), where] = 1
    table = member.T @ a @ member
    left, right = a @ member, a.T @ member  # unit before class, class before unit
    out, into = a.sum(axis=1), a.sum(axis=0)
    n_out, n_in = table.sum(axis=1), table.sum(axis=0)
    for _ in range(sweeps):
        moved = 0
        for u in order:
            if not total[u]:
                continue
            k, r, s, self_ = where[u], left[u], right[u], a[u, u]
            # Without u: its own counts leave row and column k.
            r0, s0 = r.copy(), s.copy()
            r0[k] -= self_
            s0[k] -= self_
            table[k] -= r0
            table[:, k] -= s0
            table[k, k] -= self_
            n_out[k] -= out[u]
            n_in[k] -= into[u]
            gain = (_f(table + r0) - _f(table)).sum(axis=1) + (_f(table.T + s0) - _f(table.T)).sum(axis=1)
            d = np.diagonal(table)
            gain += _f(d + r0 + s0 + self_) - _f(d) - (_f(d + r0) - _f(d)) - (_f(d + s0) - _f(d))
            gain -= _f(n_out + out[u]) - _f(n_out) + _f(n_in + into[u]) - _f(n_in)
            gain[-1] = -np.inf
            best = int(np.argmax(gain))
            if gain[best] <= gain[k] + 1e-9:
                best = k
            table[best] += r0
            table[:, best] += s0
            table[best, best] += self_
            n_out[best] += out[u]
            n_in[best] += into[u]
            if best != k:
                moved += 1
                where[u] = best
                # Other units see u in another class.
                left[:, k] -= a[:, u]
                left[:, best] += a[:, u]
                right[:, k] -= a[u]
                right[:, best] += a[u]
        if not moved:
            break
    return where


@dataclass
class Model:
    head: np.ndarray  # hashes, sorted
    head_count: np.ndarray
    head_unit: np.ndarray
    classes: np.ndarray  # by unit
    transition: np.ndarray  # log10, by class before and class
    known: np.ndarray  # log10 of 1 / tokens, by class
    unknown: np.ndarray  # log10 probability of one unknown type, by class
    discount: float
    n: int
    v: int
    ends: int
    n_units: int
    rare: np.ndarray  # hashes of words outside the head that have a class of their own, sorted
    rare_unit: np.ndarray  # a unit of that class

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the head and whether it is there."""
        if not len(self.head):
            return np.zeros(len(h), dtype=np.int64), np.zeros(len(h), dtype=bool)
        at = np.minimum(np.searchsorted(self.head, h), len(self.head) - 1)
        return at, self.head[at] == h

    def units(self, h: np.ndarray, forms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, there = self.look_up(h)
        unit = np.where(there, self.head_unit[at], -1) if len(self.head) else np.full(len(h), -1)
        out = np.flatnonzero(~there)
        if len(self.rare) and len(out):
            place = np.minimum(np.searchsorted(self.rare, h[out]), len(self.rare) - 1)
            unit[out] = np.where(self.rare[place] == h[out], self.rare_unit[place], -1)
        return np.where(unit < 0, self.n_units + forms, unit), at, there

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10(count + 1.0) - np.log10(self.n + self.v + 1.0)

    def emission(self, count: np.ndarray, cls: np.ndarray) -> np.ndarray:
        return np.where(count > 0, np.log10(np.maximum(count - self.discount, 1e-300)) + self.known[cls], self.unknown[cls])


def _sequence(words: core.Words, units: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Units before and units, over all tokens of all documents: a document of n words has n + 1 tokens."""
    after = np.insert(units, words.offset[1:], end)
    before = np.r_[end, after[:-1]] if len(after) else after
    return before, after


def _bigrams(model: Model, blocks: int, of: np.ndarray, size: int):
    """Counts of pairs, of what ``of`` gives for each unit."""
    per = -(-size // blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, dtype=np.int64)
        for _, buf, bounds in core.chunks(batches):
            words = core.Words(buf, bounds)
            units, _, _ = model.units(words.hashes(), _forms(words).astype(np.int64))
            before, after = _sequence(words, units, model.n_units + FORMS)
            total += np.bincount(of[before] * size + of[after], minlength=size * size)
        rows = []
        for b in range(blocks):
            part = total[b * per * size : (b + 1) * per * size]
            at = np.flatnonzero(part)
            if len(at):
                rows.append((b, _pack(at.astype(np.uint32), part[at])))
        yield _rows(["block", "data"], rows)

    return run


def _add_bigrams(table: pa.Table) -> pa.Table:
    at, n = _unpack((np.uint32, np.int64), table.column("data").to_pylist())
    order = np.argsort(at, kind="stable")
    at, n = at[order], n[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return pa.Table.from_batches([_rows(["block", "data"], [(table.column("block")[0].as_py(), _pack(at[first], np.add.reduceat(n, first)))])])


def _count_pairs(texts: DataFrame, model: Model, of: np.ndarray, size: int, blocks: int = 16) -> np.ndarray:
    per = -(-size // blocks)
    pairs = np.zeros(size * size, dtype=np.int64)
    added = texts.mapInArrow(_bigrams(model, blocks, of, size), "block long, data binary").groupBy("block").applyInArrow(_add_bigrams, "block long, data binary")
    for r in added.toLocalIterator():  # at most size**2 counts in all
        at, n = _unpack((np.uint32, np.int64), [r["data"]])
        pairs[at + r["block"] * per * size] = n
    return pairs.reshape(size, size)


_NEAR = (np.uint64, np.uint16, np.uint32)  # hash, class before or classes + class after, times
_OWN = (np.uint64, np.int64, np.uint16, np.uint16)  # hash, count, ending, unit


def _neighbours(model: Model, buckets: int):
    """Classes before and after each word that is no unit, and may occur LEAST times."""
    end, classes = model.n_units + FORMS, len(model.transition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def send():
            h, k = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((k, h))
            h, k = h[order], k[order]
            first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (k[1:] != k[:-1])])
            h, k, n = h[first], k[first], np.diff(np.r_[first, len(h)]).astype(np.uint32)
            return _rows(["bucket", "data"], [(b, _pack(h[at], k[at], n[at])) for b, at in _split((h % _U(buckets)).astype(np.int64))])

        for _, buf, bounds in core.chunks(batches):
            words = core.Words(buf, bounds)
            h = words.hashes()
            unit, at, there = model.units(h, _forms(words).astype(np.int64))
            before, after = _sequence(words, unit, end)
            asked = unit >= model.n_units
            if len(model.head):
                asked &= ~there | (model.head_count[at] >= LEAST)
            asked = np.flatnonzero(asked)
            place = asked + words.doc_of_word()[asked]  # each document before adds an end
            held.append((np.tile(h[asked], 2), np.r_[model.classes[before[place]], classes + model.classes[after[place + 1]]].astype(np.uint16)))
            size += 2 * len(asked)
            if size > _HELD:
                yield send()
                held, size = [], 0
        if size:
            yield send()

    return run


def _best_classes(classes: int, transition: np.ndarray, tokens: np.ndarray, unit_of: np.ndarray):
    """The class under which the tokens of a word and those after it are most likely, for each word of a bucket that occurs LEAST times."""
    worth = np.where(unit_of >= 0, -np.log10(np.maximum(tokens, 1)), -np.inf)

    def run(near: pa.Table, words: pa.Table) -> pa.Table:
        h, k, n = _unpack(_NEAR, near.column("data").to_pylist())
        known, count, form = _unpack(_COUNT, words.column("data").to_pylist())  # sorted by hash
        rows = []
        if len(h) and len(known):
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            ok = (known[at] == h) & (count[at] >= LEAST)
            order = np.flatnonzero(ok)[np.argsort(at[ok], kind="stable")]
            at, k, n = at[order], k[order].astype(np.int64), n[order]
            ids, first = np.unique(at, return_index=True)
            first = np.r_[first, len(at)]
            unit = np.empty(len(ids), dtype=np.uint16)
            for a in range(0, len(ids), 4096):
                b = min(a + 4096, len(ids))
                part = slice(first[a], first[b])
                row = np.searchsorted(ids[a:b], at[part])
                seen = np.bincount(row * 2 * classes + k[part], weights=n[part], minlength=(b - a) * 2 * classes).reshape(b - a, 2 * classes)
                score = seen[:, :classes] @ transition + seen[:, classes:] @ transition.T + count[ids[a:b], None] * worth
                unit[a:b] = unit_of[np.argmax(score, axis=1)]
            rows = [(_pack(known[ids], count[ids], form[ids], unit),)]
        return pa.Table.from_batches([_rows(["data"], rows)])

    return run


def _estimate(model: Model, by_unit: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Transitions and emissions from statistics of units and class bigrams; gives the tokens of each class."""
    classes, size = model.classes, len(table)
    n_c, v_c, one, two = (np.bincount(classes, weights=x, minlength=size) for x in by_unit)
    unseen = np.bincount(classes[model.n_units : model.n_units + FORMS], minlength=size)  # unknown types
    once, twice = one.sum(), two.sum()
    model.discount = d = float(once / (once + 2 * twice)) if once and twice else 0.5
    # A class without unknown types has nothing to give its discounts to; it keeps them by a smaller total.
    tokens = np.where(unseen > 0, n_c, n_c - d * v_c)
    model.known = -np.log10(np.maximum(tokens, 1e-9))
    mass = np.where(n_c > 0, d * v_c / np.maximum(n_c, 1), 1.0)
    model.unknown = np.log10(np.maximum(mass / np.maximum(unseen, 1), 1e-300))
    prior = (n_c + 0.5) / (n_c + 0.5).sum()
    model.transition = np.log10((table + SMOOTH * prior) / (table.sum(axis=1, keepdims=True) + SMOOTH))
    return n_c


def fit(spark: SparkSession, train: DataFrame, buckets: int, head_size: int = HEAD, n_units: int = UNITS) -> tuple[Model, DataFrame]:
    """The model, and the table of all words' counts: bucket, data."""
    texts = train.select(F.col("text").cast("string").alias("text"))
    ends = train.count()
    found = core.keep(spark, texts.mapInArrow(_count_words(buckets), "bucket long, data binary").groupBy("bucket").applyInArrow(_add_counts, "bucket long, kind long, data binary"), "word_counts")
    stats, levels = np.zeros((4, FORMS), dtype=np.int64), np.zeros(1, dtype=np.int64)
    small = found.where("kind > 0").withColumn("part", F.pmod(F.xxhash64("data"), F.lit(32))).groupBy("kind", "part").applyInArrow(_add_statistics, "kind long, data binary")
    for r in small.collect():  # 64 rows of at most 8 KB
        part = np.frombuffer(r["data"], dtype=np.int64)
        if r["kind"] == 1:
            stats += part.reshape(4, FORMS)
        else:
            levels = _padded_sum(levels, part)
    above = np.cumsum(levels[::-1])[::-1]
    cut = int(np.argmax(above <= head_size)) if (above <= head_size).any() else len(levels)
    counts = found.where("kind = 0").select("bucket", "data")

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for blob in batch.column("data").to_pylist():
                h, c, f = _unpack(_COUNT, [blob])
                at = np.flatnonzero(_level(c) >= cut)
                rows.append((_pack(h[at], c[at], f[at]),))
            yield _rows(["data"], rows)

    head, count, form = _unpack(_COUNT, [r["data"] for r in counts.mapInArrow(top, "data binary").collect()])  # head_size words at most
    order = np.argsort(head)
    head, count, form = head[order], count[order], form[order]
    best = np.lexsort((head, -count))[:n_units]
    unit = np.full(len(head), -1, dtype=np.int64)
    unit[best] = np.arange(len(best))
    end, size = n_units + FORMS, n_units + FORMS + 1
    model = Model(head, count, unit, np.zeros(size, dtype=np.int64), np.zeros((1, 1)), np.zeros(1), np.zeros(1), 0.5, int(stats[0].sum()) + ends, int(stats[1].sum()) + (ends > 0), ends, n_units, np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64))
    n_classes = max(CLASSES, int(CLASSES * (model.n / BASE_TOKENS) ** 0.25))
    pairs = _count_pairs(texts, model, np.arange(size), size)
    model.classes = classes = exchange(pairs, n_classes)
    # Tokens, types, types seen once and twice of each unit, then of each class.
    by_unit = np.zeros((4, size), dtype=np.int64)
    by_unit[:, n_units:end] = stats
    for u, i in enumerate(best.tolist()):
        own = np.array([count[i], 1, count[i] == 1, count[i] == 2])
        by_unit[:, u] += own
        by_unit[:, n_units + form[i]] -= own
    by_unit[:, end] = (ends, ends > 0, 0, 0)
    member = np.zeros((size, n_classes))
    member[np.arange(size), classes] = 1
    n_c = _estimate(model, by_unit, member.T @ pairs @ member)
    # Other words by their own neighbours. A unit of its class stands for each.
    unit_of = np.full(n_classes, -1, dtype=np.int64)
    unit_of[classes[:end][::-1]] = np.arange(end)[::-1]
    unit_of[n_c == 0] = -1
    near = texts.mapInArrow(_neighbours(model, buckets), "bucket long, data binary")
    own = near.groupBy("bucket").cogroup(counts.groupBy("bucket")).applyInArrow(_best_classes(n_classes, model.transition, n_c, unit_of), "data binary")
    h, c, f, u = _unpack(_OWN, [r["data"] for r in own.toLocalIterator()])  # the words that occur LEAST times
    if len(h):
        for k, x in ((0, c), (1, np.ones(len(c), dtype=np.int64))):
            np.subtract.at(by_unit[k], n_units + f.astype(np.int64), x)
            np.add.at(by_unit[k], u.astype(np.int64), x)
        at, there = model.look_up(h)
        model.head_unit[at[there]] = u[there]
        order = np.flatnonzero(~there)[np.argsort(h[~there])]
        model.rare, model.rare_unit = h[order], u[order].astype(np.int64)
        _estimate(model, by_unit, _count_pairs(texts, model, classes, n_classes))
    return model, counts


# --- scoring ----------------------------------------------------------------------------------------------

_ASK = (np.uint64, np.int64, np.int32, np.uint16)  # hash, row, times, ending
_SUM = (np.int64, np.int64, np.float64, np.float64)  # row, known, base, score
_OUT = "home long, data binary, row long, doc_id long, n_tokens long"


def _ask(model: Model, buckets: int, homes: int):
    """Own sums of each row (with its doc_id), and questions about words outside the head."""
    end = model.n_units + FORMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def send():
            h, row, times, form = (np.concatenate(x) for x in zip(*held, strict=True))
            return [(b, -1, _pack(h[at], row[at], times[at], form[at]), None, None, None) for b, at in _split((h % _U(buckets)).astype(np.int64))]

        names = ["bucket", "home", "data", "row", "doc_id", "n_tokens"]
        for part, buf, bounds in core.chunks(batches):
            words = core.Words(buf, bounds)
            h, form = words.hashes(), _forms(words)
            unit, at, there = model.units(h, form.astype(np.int64))
            before, after = _sequence(words, unit, end)
            move = model.transition[model.classes[before], model.classes[after]]
            count = np.where(there, model.head_count[at], 0) if len(model.head) else np.zeros(len(h), dtype=np.int64)
            doc = words.doc_of_word()
            n = len(words.counts)
            ends = np.full(n, model.ends)
            base = np.bincount(doc[there], weights=model.base(count[there]), minlength=n) + model.base(ends)
            score = np.bincount(doc[there], weights=model.emission(count[there], model.classes[unit[there]]), minlength=n).astype(float)
            score += np.bincount(np.repeat(np.arange(n), words.counts + 1), weights=move, minlength=n) + model.emission(ends, np.full(n, model.classes[end]))
            known = np.bincount(doc[there], minlength=n) + (model.ends > 0)
            row = part.column("row").to_numpy(zero_copy_only=False).astype(np.int64)
            rest = np.flatnonzero(~there)
            if len(rest):
                order = rest[np.lexsort((h[rest], doc[rest]))]
                first = np.flatnonzero(np.r_[True, (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])])
                times = np.diff(np.r_[first, len(order)]).astype(np.int32)
                held.append((h[order][first], row[doc[order][first]], times, form[order][first]))
                size += len(first)
            rows = [(b % buckets, b, _pack(r, k, x, y), i, d, t) for b, r, k, x, y, i, d, t in zip((row % homes).tolist(), row.reshape(-1, 1), known.astype(np.int64).reshape(-1, 1), base.reshape(-1, 1), score.reshape(-1, 1), row.tolist(), part.column("doc_id").to_pylist(), (words.counts + 1).tolist(), strict=True)]
            if size > _HELD:
                rows, held, size = rows + send(), [], 0
            yield _rows(names, rows)
        if held:
            yield _rows(names, send())

    return run


def _answer(model: Model, homes: int):
    def run(asked: pa.Table, words: pa.Table) -> pa.Table:
        own = asked.filter(pa.compute.greater_equal(asked.column("home"), 0))
        rows = list(zip(*(own.column(c).to_pylist() for c in ("home", "data", "row", "doc_id", "n_tokens")), strict=True))
        h, row, times, form = _unpack(_ASK, asked.filter(pa.compute.less(asked.column("home"), 0)).column("data").to_pylist())
        if len(h):
            known, count, _ = _unpack(_COUNT, words.column("data").to_pylist())  # sorted by hash
            at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
            c = np.where(known[at] == h, count[at], 0) if len(known) else np.zeros(len(h), dtype=np.int64)
            cls = model.classes[model.units(h, form.astype(np.int64))[0]]
            order = np.argsort(row, kind="stable")
            row, times, c, cls = row[order], times[order].astype(np.int64), c[order], cls[order]
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            sums = (row[first], np.add.reduceat(times * (c > 0), first), np.add.reduceat(times * model.base(c), first), np.add.reduceat(times * model.emission(c, cls), first))
            rows += [(home, _pack(*(x[i] for x in sums)), None, None, None) for home, i in _split(sums[0] % homes)]
        return pa.Table.from_batches([_rows(["home", "data", "row", "doc_id", "n_tokens"], rows)])

    return run


def _total(model: Model):
    def run(table: pa.Table) -> pa.Table:
        own = table.filter(pa.compute.is_valid(table.column("row")))
        row, known, base, score = _unpack(_SUM, table.column("data").to_pylist())
        order = np.lexsort((base, score, row))  # added up in one order, whatever order the parts came in
        row = row[order]
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        at = np.searchsorted(row[first], own.column("row").to_numpy())
        known, base, score = (np.add.reduceat(x[order], first)[at] for x in (known, base, score))
        if not model.n:
            base, score = np.zeros(len(at)), np.zeros(len(at))
        return pa.table([own.column("doc_id"), own.column("n_tokens"), pa.array(known), pa.array(np.full(len(at), model.n)), pa.array(base), pa.array(score)], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score(spark: SparkSession, docs: DataFrame, model: Model, counts: DataFrame, buckets: int) -> DataFrame:
    homes = HOMES * buckets
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    asked = rows.mapInArrow(_ask(model, buckets, homes), "bucket long, home long, data binary, row long, doc_id long, n_tokens long")
    said = asked.groupBy("bucket").cogroup(counts.groupBy("bucket")).applyInArrow(_answer(model, homes), _OUT)
    return said.groupBy("home").applyInArrow(_total(model), "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def evaluate(spark: SparkSession, docs: DataFrame, buckets: int | None = None, head_size: int = HEAD, n_units: int = UNITS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learned from the rows that are not held out."""
    core.tune(spark)
    buckets = buckets or core.group_count(core.partitions(spark), core.text_bytes(docs))
    model, counts = fit(spark, docs.where(~held_out(mod=7)), buckets, head_size, n_units)
    found = score(spark, docs, model, counts, buckets)
    return found.select("doc_id", held_out(mod=7).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
