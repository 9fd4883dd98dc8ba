"""Quality rules: learned decision lists over text statistics.

Sequential covering: a rule is grown, one threshold at a time, by information gain on two thirds of the labelled rows
until it covers no good document, pruned from its end on the other third, and kept if its precision there is high; then the
documents that it covers are set aside and the next rule is grown. The rules become one ordered Spark conditional
expression over statistics that are computed for every whole text. Only the labelled sample, of at most
``MAX_LABELLED`` rows by a hash of their id, reaches the driver.

Defined cases: null and empty texts have no words and fail the base rule; without labels the list is empty and keeps what
passes the base rule; labels that are null are ignored, of several labels of one id the lowest counts; extra columns
are ignored by ``verdicts`` and kept by ``rows``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import core

#: Labelled rows that a list is learned from, at most.
MAX_LABELLED = 20_000
MIN_WORDS = 50
#: A rule must be this precise on rows it was not grown on, and cover this many of them.
PRECISION, COVERS = 0.9, 3
MAX_RULES, MAX_CONDITIONS, CUTS = 24, 4, 96

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_distinct_words", "n_digits")
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CAPITAL = np.zeros(256, dtype=bool)
_CAPITAL[65:91] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True


def _per_doc(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0, np.cumsum(flags, dtype=np.int64)][bounds])


def _repeats(words: core.Words, k: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """For each document: words inside k-word windows found twice or more in it, and distinct words."""
    h, doc = words.hashes(lower=False), words.doc_of_word()
    n = len(h)
    order = np.lexsort((h, doc))
    a, d = h[order], doc[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (d[1:] != d[:-1])] if n else np.empty(0, dtype=bool)
    distinct = np.bincount(d[new], minlength=len(words.counts))
    cover = np.zeros(n + k + 1, dtype=np.int64)
    g = core.windows(h, k)
    if len(g):
        at = np.flatnonzero(doc[: len(g)] == doc[k - 1 :])
        at = at[np.lexsort((g[at], doc[at]))]
        same = (g[at][1:] == g[at][:-1]) & (doc[at][1:] == doc[at][:-1])
        twice = np.zeros(len(at), dtype=bool)
        twice[1:] |= same
        twice[:-1] |= same
        starts = at[twice]
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + k, -1)
    inside = np.cumsum(cover)[:n] > 0
    return _per_doc(inside, words.offset), distinct


def counts(buf: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """The statistics of whole texts, one array each."""
    words = core.Words(buf, bounds)
    solid = _per_doc(~core._SPACE[buf] & ((buf & 0xC0) != 0x80), bounds)
    repeat, distinct = _repeats(words)
    dup, lines = [], []
    for a, b in zip(bounds, bounds[1:], strict=False):
        found = [x for x in buf[a:b].tobytes().split(b"\n") if x.strip()]
        dup.append(len(found) - len(set(found)))
        lines.append(len(found))
    return {"n_words": words.counts, "word_chars": solid, "n_symbols": _per_doc(_SYMBOL[buf], bounds), "n_dup_lines": np.array(dup), "n_repeat_words": repeat, "n_lines": np.array(lines), "n_capitals": _per_doc(_CAPITAL[buf], bounds), "n_distinct_words": distinct, "n_digits": _per_doc(_DIGIT[buf], bounds)}


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, buf, bounds in core.chunks(batches):
        found = counts(buf, bounds)
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array(found[c], pa.int64()) for c in _COUNTS)], ["doc_id", *_COUNTS])


def statistics(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_statistics, "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS))


#: What rules look at: a name, and a numerator over a denominator.
FEATURES = (
    ("symbols_per_word", "n_symbols", "n_words"),
    ("repeat_share", "n_repeat_words", "n_words"),
    ("dup_line_share", "n_dup_lines", "n_lines"),
    ("chars_per_word", "word_chars", "n_words"),
    ("capital_share", "n_capitals", "word_chars"),
    ("distinct_share", "n_distinct_words", "n_words"),
    ("digit_share", "n_digits", "word_chars"),
    ("words", "n_words", None),
)


def _feature(top: str, bottom: str | None) -> Column:
    return F.col(top).cast("double") if bottom is None else F.col(top) / F.greatest(F.col(bottom), F.lit(1))


@dataclass(frozen=True)
class Condition:
    feature: int
    above: bool
    cut: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x[:, self.feature] > self.cut if self.above else x[:, self.feature] <= self.cut

    def column(self) -> Column:
        value = _feature(*FEATURES[self.feature][1:])
        return value > F.lit(self.cut) if self.above else value <= F.lit(self.cut)

    def __str__(self) -> str:
        return f"{FEATURES[self.feature][0]} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: np.ndarray, bad: np.ndarray) -> Rule:
    """Conditions by FOIL's gain until no good row is covered."""
    rule: list[Condition] = []
    here = np.ones(len(x), dtype=bool)
    while len(rule) < MAX_CONDITIONS and (here & ~bad).any():
        p, n = (here & bad).sum(), (here & ~bad).sum()
        best, gain = None, 1e-9
        for f in range(x.shape[1]):
            values = np.unique(x[here, f])
            if len(values) > CUTS:
                values = values[np.linspace(0, len(values) - 1, CUTS).astype(int)]
            for cut in ((values[1:] + values[:-1]) / 2).tolist():
                for above in (True, False):
                    c = Condition(f, above, cut)
                    now = here & c.holds(x)
                    p1, n1 = (now & bad).sum(), (now & ~bad).sum()
                    if p1:
                        g = p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p / (p + n)))
                        if g > gain:
                            best, gain = c, g
        if best is None:
            break
        rule.append(best)
        here &= best.holds(x)
    return tuple(rule)


def _prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """The beginning of the rule that does best on rows it was not grown on; the shorter one of equals."""

    def worth(r: Rule) -> float:
        now = _covers(r, x)
        p, n = (now & bad).sum(), (now & ~bad).sum()
        return (p - 2 * n) / (p + n) if p + n else -2.0

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)), default=())


def learn(x: np.ndarray, bad: np.ndarray, fold: np.ndarray) -> list[Rule]:
    """An ordered list of rules for bad rows. fold: 0 to 2; the rows of 2 prune and judge."""
    rules: list[Rule] = []
    left = np.ones(len(x), dtype=bool)
    while len(rules) < MAX_RULES:
        grow, judge = left & (fold != 2), left & (fold == 2)
        if not (grow & bad).any():
            break
        rule = _prune(_grow(x[grow], bad[grow]), x[judge], bad[judge])
        now = _covers(rule, x) if rule else np.zeros(len(x), dtype=bool)
        p, n = (now & judge & bad).sum(), (now & judge & ~bad).sum()
        if p < COVERS or p < PRECISION * (p + n):
            break
        rules.append(rule)
        left &= ~now
    return rules


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> list[Rule]:
    """The decision list of docs(doc_id, text) and labels(doc_id, quality)."""
    core.tune(spark)
    good = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("d")).agg(F.min("quality").alias("quality"))
    sample = good.orderBy(F.xxhash64("d"), "d").limit(limit)
    texts = docs.join(F.broadcast(sample), F.col("doc_id") == F.col("d"), "left_semi")
    rows = statistics(texts).join(F.broadcast(sample), F.col("doc_id") == F.col("d")).where(~base_failed())
    found = rows.select("doc_id", "quality", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)).alias("fold"), *[_feature(top, bottom).alias(name) for name, top, bottom in FEATURES]).collect()
    if not found:
        return []
    found.sort(key=lambda r: tuple(r))
    x = np.array([[r[name] for name, *_ in FEATURES] for r in found], dtype=float)
    return learn(x, np.array([r["quality"] <= 0 for r in found]), np.array([r["fold"] for r in found]))


def verdict(rules: list[Rule]) -> Column:
    """The ordered conditional expression: false for what the first fitting rule rejects, else true."""
    out = F.when(base_failed(), F.lit(False))
    for rule in rules:
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        out = out.when(test, F.lit(False))
    return out.otherwise(F.lit(True))


def verdicts(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    core.tune(spark)
    rules = fit(spark, docs, labels)
    return statistics(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), verdict(rules).alias("kept"))


def rows(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with their own columns: judged where they lie, without a join."""
    from pyspark.sql.pandas.types import to_arrow_schema

    core.tune(spark)
    rules = fit(spark, docs, labels)
    schema = to_arrow_schema(docs.schema)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, bounds in core.chunks(batches):
            found = counts(buf, bounds)
            n, repeat = found["n_words"], found["n_repeat_words"]
            x = np.stack([found[top].astype(float) if bottom is None else found[top] / np.maximum(found[bottom], 1) for _, top, bottom in FEATURES], axis=1)
            stay = ~((n < MIN_WORDS) | (100 * repeat > 50 * n))
            for rule in rules:
                stay &= ~_covers(rule, x)
            yield part.filter(pa.array(stay)).cast(schema) if hasattr(part, "cast") else pa.RecordBatch.from_arrays(part.filter(pa.array(stay)).columns, schema=schema)

    return docs.mapInArrow(judge, docs.schema)
