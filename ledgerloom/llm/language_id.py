"""Language ID with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. The vector of three consecutive letters binds the permuted
letter vectors: rotate(a, 2) * rotate(b, 1) * c. A text bundles (adds) the vectors of its trigrams; a language's
prototype bundles those of all its training texts. A text gets the language of the nearest prototype by cosine.
Tasks send one vector for each language they have met, so training shuffles languages x tasks x DIMENSIONS numbers.

Defined cases: null texts and texts without a letter are ``und`` with score 0, and so is every text if nothing was
learned; equal cosines go to the first language by code point; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import core

DIMENSIONS = 1024
UNKNOWN = "und"
#: Languages whose prototypes are held in each task, at most (4 KB each).
MAX_LANGUAGES = 10_000
_SEED = 17
_CELLS = 4_000_000  # counts held at once
_state: dict = {}


def _letters() -> np.ndarray:
    """For each code point its lower-case letter's code point, 0 if it is no letter."""
    if "letters" not in _state:
        table = np.zeros(0x110000, dtype=np.uint32)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                low = c.lower()
                table[cp] = ord(low) if len(low) == 1 else cp
        _state["letters"] = table
    return _state["letters"]


def _vector(cp: int) -> np.ndarray:
    return np.random.default_rng([_SEED, cp]).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1


def _symbols(cps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Small numbers for letters, and the letters' vectors by number (grown as letters are met)."""
    if "number" not in _state:
        _state["number"], _state["vectors"], _state["n"] = np.full(0x110000, -1, dtype=np.int32), np.zeros((64, DIMENSIONS), dtype=np.int8), 0
    number = _state["number"]
    new = np.unique(cps[number[cps] < 0]) if len(cps) else cps
    for cp in new.tolist():
        n = _state["n"]
        if n == len(_state["vectors"]):
            _state["vectors"] = np.concatenate([_state["vectors"], np.zeros_like(_state["vectors"])])
        _state["vectors"][n], number[cp], _state["n"] = _vector(cp), n, n + 1
    return number[cps], _state["vectors"]


def trigrams(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document and code of each trigram, and how many letters each document has; runs of other characters are one gap."""
    cps = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    at = np.r_[0, np.cumsum((buf & 0xC0) != 0x80)][bounds]
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(at))
    low = _letters()[cps]
    is_letter = low != 0
    has = np.bincount(doc[is_letter], minlength=len(bounds) - 1)
    # A gap before and after each document's letters, and none twice.
    stay = is_letter.copy()
    stay[1:] |= is_letter[:-1]
    low, doc = low[stay], doc[stay]
    n = len(low)
    if not n:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), has
    first = np.r_[True, doc[1:] != doc[:-1]]
    low = np.insert(low, np.flatnonzero(first), 0)
    doc = np.insert(doc, np.flatnonzero(first), doc[first])
    number, _ = _symbols(low)
    base = np.int64(1 << 20)
    number = number.astype(np.int64)
    code = (number[:-2] * base + number[1:-1]) * base + number[2:]
    ok = doc[:-2] == doc[2:]
    return doc[:-2][ok], code[ok], has


def _profiles(doc: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
    """The bundled vector of each of n documents (or languages)."""
    out = np.zeros((n, DIMENSIONS), dtype=np.float32)
    if not len(code):
        return out
    a, b, c = code >> 40, (code >> 20) & 0xFFFFF, code & 0xFFFFF
    size = _state["n"]
    if size <= 200:  # a dense table of codes instead of a sort
        small = (a * size + b) * size + c
        seen = np.zeros(size**3, dtype=bool)
        seen[small] = True
        unique = np.flatnonzero(seen)
        rank = np.zeros(size**3, dtype=np.int32)
        rank[unique] = np.arange(len(unique))
        where = rank[small]
        a, b, c = unique // size**2, unique // size % size, unique % size
    else:
        unique, where = np.unique(code, return_inverse=True)
        a, b, c = unique >> 40, (unique >> 20) & 0xFFFFF, unique & 0xFFFFF
    vectors = _state["vectors"]
    twice, once = np.roll(vectors[: _state["n"]], 2, axis=1), np.roll(vectors[: _state["n"]], 1, axis=1)
    step = max(1, _CELLS // DIMENSIONS)
    docs_at = max(1, _CELLS // len(unique))
    edges = np.searchsorted(doc, np.arange(0, n + docs_at, docs_at))
    for g in range(0, len(unique), step):
        bound = (twice[a[g : g + step]] * once[b[g : g + step]] * vectors[c[g : g + step]]).astype(np.float32)
        for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
            if lo == hi:
                continue
            rows = min(docs_at, n - k * docs_at)
            inside = where[lo:hi] - g
            if len(unique) > step:
                pick = (inside >= 0) & (inside < step)
                inside, owner = inside[pick], doc[lo:hi][pick]
            else:
                owner = doc[lo:hi]
            table = np.bincount((owner - k * docs_at) * len(bound) + inside, minlength=rows * len(bound)).astype(np.float32)
            out[k * docs_at : k * docs_at + rows] += table.reshape(rows, -1) @ bound
    return out


def prototypes(spark: SparkSession, docs: DataFrame) -> dict[str, np.ndarray]:
    """The prototype of each language of docs(text, lang)."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for rows, buf, bounds in core.chunks(batches):
            names = rows.column("lang").to_pylist()
            known = {name: i for i, name in enumerate(sorted(set(names)))}
            doc, code, _ = trigrams(buf, bounds)
            owner = np.array([known[x] for x in names])[doc] if len(doc) else doc
            order = np.argsort(owner, kind="stable")
            for name, v in zip(known, _profiles(owner[order], code[order], len(known)), strict=True):
                total[name] = total.get(name, 0) + v.astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([*total], pa.string()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["lang", "v"])

    def add(table: pa.Table) -> pa.Table:
        v = sum(np.frombuffer(x, dtype=np.float64) for x in table.column("v").to_pylist())
        return pa.table({"lang": table.column("lang").slice(0, 1), "v": pa.array([v.tobytes()], pa.binary())})

    parts = docs.where("lang is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).mapInArrow(bundle, "lang string, v binary")
    # Two steps of adding, so that no task adds up the vectors of all tasks.
    some = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64))).groupBy("lang", "salt").applyInArrow(lambda t: add(t), "lang string, v binary")
    found = some.groupBy("lang").applyInArrow(add, "lang string, v binary").limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return {r["lang"]: np.frombuffer(r["v"], dtype=np.float64) for r in sorted(found, key=lambda r: r["lang"]) if np.any(np.frombuffer(r["v"], dtype=np.float64))}


def classify(docs: DataFrame, learned: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score for each row of docs(doc_id, text): nothing else of it is looked at."""
    names = [*learned]
    unit = np.array([v / np.linalg.norm(v) for v in learned.values()], dtype=np.float32).reshape(len(names), DIMENSIONS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, bounds in core.chunks(batches):
            doc, code, has = trigrams(buf, bounds)
            n = rows.num_rows
            pred, score = [UNKNOWN] * n, np.zeros(n)
            if names:
                h = _profiles(doc, code, n)
                cosine = (h @ unit.T) / np.maximum(np.linalg.norm(h, axis=1, keepdims=True), 1e-9)
                best = cosine.argmax(axis=1)
                pred = [names[b] if k else UNKNOWN for b, k in zip(best.tolist(), has.tolist(), strict=True)]
                score = np.where(has > 0, np.clip(cosine[np.arange(n), best], 0, 1), 0).astype(float)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id: str = "doc_id", mod: int = 4):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % mod == 2, F.lit(False))


def identify(spark: SparkSession, docs: DataFrame) -> DataFrame:
    core.tune(spark)
    learned = prototypes(spark, docs.where(~held_out()))
    return classify(docs, learned).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
