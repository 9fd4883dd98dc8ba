"""MinHash near-dedup with fast similarity sketches, banding and exact verification.

Sketch: in round i each shingle is thrown into one of T bins with a value that grows with the round; a bin keeps its
smallest value. The first T rounds throw at random, round T + i throws everything into bin i; so every bin fills after at most 2 T
rounds, and mostly after two or three. Equal coordinates estimate similarity with concentration bounds.

Documents with equal shingle sets form classes first; only one document stands for each. Bands of ROWS coordinates put
classes into buckets: a pair of similarity 0.8 shares none of the 32 bands with probability (1 - 0.8**4)**32 < 1e-7. A bucket does
not list its pairs: its members are linked to a leader, task by task and then over tasks, and each link is confirmed on the
full shingle sets. What stays open is settled in two ways. Members and leaders of rough similarity form dense groups, of which
each document has one; there the members outside the main component are compared with all others on full sets, block
by block, and one link to each component is given back. Pairs that share a bucket but not a dense group are compared
by sketch (only pairs more than six deviations below the threshold are dropped) and then confirmed on full sets.
So components are those of all pairs that share a band.

Defined cases: null texts and texts without words have an empty set, link with nothing and are kept; shorter texts are
one shingle; rows equal in doc_id and text are one document, different texts under one doc_id (or under none) are documents of
their own, and of near copies under one doc_id the text with the smallest digest stays; a null doc_id is below all others and is given
back as null; an empty table gives an empty result; extra columns are ignored by ``groups`` and kept by ``rows``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import core
from .components import components, salts, with_least

BINS, ROWS = 128, 4
BANDS = BINS // ROWS
#: Members that a leader is this similar to form a dense group with it.
DENSE = 0.5
#: Shingles and members in a block, on average.
BLOCK, MEMBERS = 250_000, 512
SALTS = 32
#: Classes whose band keys a task holds at once (0.8 KB each).
HELD = 60_000
_NULL_ID = -(2**63)
_U = np.uint64
_SEED = [int(x) for x in np.random.default_rng(97).integers(1, 2**63, 2 * BINS + 1, dtype=np.int64)]


# --- sets and sketches ------------------------------------------------------------------------------------


def shingle_sets(buf: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, in order, and the bounds of the documents in them."""
    words = core.Words(buf, bounds)
    h, counts, offset = words.hashes(), words.counts, words.offset
    n = len(h)
    doc = words.doc_of_word()
    grams = core.windows(h, k)
    inside = doc[: len(grams)] == doc[k - 1 :] if len(grams) else np.empty(0, dtype=bool)
    values, owner = [grams[inside]], [doc[: len(grams)][inside]]
    for short in range(1, k):  # fewer words: the whole sequence is one shingle
        rows = np.flatnonzero(counts == short)
        if len(rows):
            values.append(core.windows(h, short)[offset[rows]] if n >= short else np.empty(0, dtype=np.uint64))
            owner.append(rows)
    value, owner_ = np.concatenate(values), np.concatenate(owner)
    order = np.lexsort((value, owner_))
    value, owner_ = value[order], owner_[order]
    if len(value):
        new = np.r_[True, (value[1:] != value[:-1]) | (owner_[1:] != owner_[:-1])]
        value, owner_ = value[new], owner_[new]
    return value, np.searchsorted(owner_, np.arange(len(counts) + 1))


def sketches(sets: np.ndarray, bounds: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Fast similarity sketches, one row for each non-empty set (empty sets keep the largest value)."""
    n = len(bounds) - 1
    top = np.iinfo(np.uint64).max
    out = np.full((n, bins), top, dtype=np.uint64)
    size = np.diff(bounds)
    todo = np.flatnonzero(size > 0)
    for i in range(2 * bins):
        if not len(todo):
            break
        at = np.concatenate([np.arange(bounds[d], bounds[d + 1]) for d in todo]) if len(todo) < n else np.arange(bounds[0], bounds[-1])
        h = core.mix(sets[at] ^ _U(_SEED[i]))
        bin_ = (h & _U(bins - 1)).astype(np.int64) if i < bins else np.full(len(at), i - bins)
        value = (_U(i) << _U(48)) | (h >> _U(16))
        np.minimum.at(out.reshape(-1), np.repeat(todo, size[todo]) * bins + bin_, value)
        todo = todo[(out[todo] == top).any(axis=1)]
    return out


def bands(sketch: np.ndarray) -> np.ndarray:
    """One key for each band: a hash of its coordinates and its number."""
    rows = sketch.reshape(len(sketch), -1, ROWS)
    key = np.broadcast_to(np.arange(rows.shape[1], dtype=np.uint64), rows.shape[:2])
    for k in range(ROWS):
        key = core.mix((key << _U(7)) ^ (key >> _U(3)) ^ rows[:, :, k])
    return key


_SKETCHED = "doc_id long, text_key binary, n_shingles long, set_key binary, bands binary, sig binary"


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, bounds in core.chunks(batches):
            sets, at = shingle_sets(buf, bounds, k)
            sketch = sketches(sets, at)
            key, sig, size = bands(sketch), (core.mix(sketch) & _U(255)).astype(np.uint8), np.diff(at)
            full = [None if not n else i for i, n in enumerate(size.tolist())]
            set_keys = [None if i is None else xxhash.xxh3_128_digest(sets[at[i] : at[i + 1]].tobytes()) for i in full]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("text_key"), pa.array(size, pa.int64()), pa.array(set_keys, pa.binary()), pa.array([None if i is None else key[i].tobytes() for i in full], pa.binary()), pa.array([None if i is None else sig[i].tobytes() for i in full], pa.binary())],
                ["doc_id", "text_key", "n_shingles", "set_key", "bands", "sig"],
            )

    return run


# --- bucket leaders ---------------------------------------------------------------------------------------


def _lead(key: np.ndarray, node: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by key and priority: the order, flags of each key's leader, and the leader's place for each."""
    order = np.lexsort((node, core.mix(node.view(np.uint64)), key))
    k = key[order]
    first = np.r_[True, k[1:] != k[:-1]] if len(k) else np.empty(0, dtype=bool)
    return order, first, np.maximum.accumulate(np.where(first, np.arange(len(k)), 0))


def _pairs(node: np.ndarray, size: np.ndarray, head: np.ndarray) -> np.ndarray:
    """(leader, member, close enough in size to be linked) without repeats."""
    a, b, na, nb = node[head], node, size[head], size
    ok = 100 * np.minimum(na, nb) >= 80 * np.maximum(na, nb)
    rows = np.stack([a, b, ok.astype(np.int64)], axis=1)[a != b]
    return np.unique(rows, axis=0) if len(rows) else rows


def _pair_rows(found: list[np.ndarray]) -> list[tuple]:
    return [(-1, a, b, ok, None) for part in found for a, b, ok in part.tolist()]


_LED = "bucket long, a long, b long, ok long, data binary"


def _led(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["bucket", "a", "b", "ok", "data"])


def _local_leaders(buckets: int):
    """A task links members to its own leaders, and sends one leader of each bucket on; it does so every HELD rows."""

    def lead(parts: list[tuple]) -> pa.RecordBatch:
        key, node, size = (np.concatenate(x) for x in zip(*parts, strict=True))
        order, first, head = _lead(key, node, size)
        key, node, size = key[order], node[order], size[order]
        rows = _pair_rows([_pairs(node, size, head)])
        key, node, size = key[first], node[first], size[first]
        bucket = (key % _U(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        cut = np.flatnonzero(np.r_[True, bucket[by][1:] != bucket[by][:-1]])
        for a, b in zip(cut, [*cut[1:], len(by)], strict=True):
            at = by[a:b]
            rows.append((int(bucket[at[0]]), None, None, None, key[at].tobytes() + node[at].tobytes() + size[at].tobytes()))
        return _led(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            if batch.num_rows:
                keys = np.frombuffer(b"".join(batch.column("bands").to_pylist()), dtype=np.uint64)
                nodes = np.repeat(batch.column("node").to_numpy(zero_copy_only=False).astype(np.int64), BANDS)
                sizes = np.repeat(batch.column("n_shingles").to_numpy(zero_copy_only=False).astype(np.int64), BANDS)
                parts.append((keys, nodes, sizes))
                held += batch.num_rows
            if held >= HELD:
                yield lead(parts)
                parts, held = [], 0
        if parts:
            yield lead(parts)

    return run


def _bucket_leaders(table: pa.Table) -> pa.Table:
    parts = []
    for blob in table.column("data").to_pylist():
        n = len(blob) // 24
        parts.append((np.frombuffer(blob, np.uint64, n), np.frombuffer(blob, np.int64, n, 8 * n), np.frombuffer(blob, np.int64, n, 16 * n)))
    key, node, size = (np.concatenate(x) for x in zip(*parts, strict=True))
    order, _, head = _lead(key, node, size)
    return pa.Table.from_batches([_led(_pair_rows([_pairs(node[order], size[order], head)]))])


# --- confirmation -----------------------------------------------------------------------------------------


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirm(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for side in ("text_a", "text_b"):
                found: list = []
                for _, buf, bounds in core.chunks(iter([batch.select([side])]), side):
                    sets, at = shingle_sets(buf, bounds, k)
                    found += [sets[at[i] : at[i + 1]] for i in range(len(at) - 1)]
                sides.append(found)
            linked = [_similar(a, b, percent) for a, b in zip(*sides, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return run


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(_confirm(k, percent), "a long, b long, linked boolean")


# --- what leaders leave open ------------------------------------------------------------------------------


def _near(percent: int) -> float:
    """Six standard deviations below the threshold, for shares of equal coordinates."""
    return percent / 100 - 6 * (percent / 100 * (1 - percent / 100) / BINS) ** 0.5


def _estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, BINS) for c in ("sig_a", "sig_b"))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array((a == b).mean(axis=1))], ["a", "b", "near"])


def _node_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, bounds in core.chunks(batches):
            sets, at = shingle_sets(buf, bounds, k)
            yield pa.RecordBatch.from_arrays([rows.column("node"), pa.array([sets[at[i] : at[i + 1]].tobytes() for i in range(rows.num_rows)], pa.binary())], ["node", "shingles"])

    return run


def _compare_sets(percent: int):
    """Members outside the main component against a block: an exact link, the closest, to each other component that has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i in range(batch.num_rows):
                left, right = batch.column("minor")[i].as_py(), batch.column("members")[i].as_py()
                rows += _block_links(left, right, percent)
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in (0, 1)], ["a", "b"])

    return run


def _block_links(left: list[dict], right: list[dict], percent: int) -> list[tuple]:
    mine = [np.frombuffer(m["shingles"], dtype=np.uint64) for m in left]
    theirs = [np.frombuffer(m["shingles"], dtype=np.uint64) for m in right]
    size = np.array([len(x) for x in theirs])
    start = np.r_[0, np.cumsum(size)[:-1]]
    node, component = (np.array([m[c] for m in right], dtype=np.int64) for c in ("node", "component"))
    universe, number = np.unique(np.concatenate([*theirs, *mine]), return_inverse=True)
    other, number = number[: size.sum()], np.split(number[size.sum() :], np.cumsum([len(x) for x in mine])[:-1])
    has, rows = np.zeros(len(universe), dtype=np.int32), []
    for m, own in zip(left, number, strict=True):
        has[own] = 1
        both = np.add.reduceat(has[other], start)
        has[own] = 0
        links = np.flatnonzero((100 * both >= percent * (size + len(own) - both)) & (component != m["component"]))
        links = links[np.lexsort((node[links], -both[links], component[links]))]
        c = component[links]
        for j in links[np.r_[True, c[1:] != c[:-1]] if len(c) else slice(0)].tolist():
            rows.append((min(m["node"], int(node[j])), max(m["node"], int(node[j]))))
    return rows


def _inside(scratch: core.Scratch, dense: DataFrame, labels: DataFrame, texts: DataFrame, sizes: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between the components of each dense group (node, component: its group), on full sets."""
    member = dense.select("node", F.col("component").alias("group")).join(labels.withColumnRenamed("node", "x"), F.col("node") == F.col("x"), "left").select("node", "group", F.coalesce("component", "node").alias("component"))
    member = scratch.keep(member.join(sizes.withColumnRenamed("node", "x"), F.col("node") == F.col("x")).select("node", "group", "component", "n_shingles"), "dense_members")
    parts = member.groupBy("group", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("words"))
    main = parts.groupBy(F.col("group").alias("g")).agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max(F.struct("n", "component", "words"))["words"].alias("main_words"), F.sum("words").alias("words"), F.count("*").alias("parts")).where("parts > 1")
    main = main.select("g", "main", F.ceil(F.col("words") / BLOCK).cast("int").alias("blocks"), F.ceil((F.col("words") - F.col("main_words")) / BLOCK).cast("int").alias("minor_blocks"))
    # A group may hold a large share of all documents: its one row of facts is dealt out beside its members.
    main = main.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = member.withColumn("s", F.pmod(F.xxhash64("node", F.lit(2)), F.lit(SALTS)).cast("int"))
    open_ = scratch.keep(salted.join(main, (F.col("group") == F.col("g")) & (F.col("s") == F.col("salt"))).select("node", "group", "component", "main", "blocks", "minor_blocks"), "open_members")
    sets = texts.join(open_.select("node"), "node", "left_semi").mapInArrow(_node_sets(k), "node long, shingles binary")
    full = scratch.keep(open_.join(sets, "node"), "open_sets")
    row = F.collect_list(F.struct("node", "component", "shingles"))
    blocks = full.groupBy("group", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block")).agg(row.alias("members"))
    minor = full.where("component <> main").groupBy("group", "blocks", F.pmod(F.xxhash64("node"), F.col("minor_blocks")).alias("part")).agg(row.alias("minor"))
    minor = minor.select("group", "minor", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("block"))
    return minor.join(blocks, ["group", "block"]).select("minor", "members").mapInArrow(_compare_sets(percent), "a long, b long")


def _compare_sketches(percent: int):
    """Pairs of a bucket whose groups differ and whose sketches don't rule them out."""
    margin = _near(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for left, right in zip(batch.column("minor").to_pylist(), batch.column("members").to_pylist(), strict=True):
                (na, ga, sa, xa), (nb, gb, sb, xb) = _columns(left), _columns(right)
                for i in range(len(na)):
                    ok = (gb != ga[i]) & (100 * np.minimum(sb, sa[i]) >= percent * np.maximum(sb, sa[i]))
                    at = np.flatnonzero(ok)
                    at = at[(xb[at] == xa[i]).mean(axis=1) >= margin] if len(at) else at
                    found.update((min(int(na[i]), j), max(int(na[i]), j)) for j in nb[at].tolist())
            rows = sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in (0, 1)], ["a", "b"])

    return run


def _columns(members: list[dict]):
    return (
        np.array([m["node"] for m in members], dtype=np.int64),
        np.array([m["group"] for m in members], dtype=np.int64),
        np.array([m["n_shingles"] for m in members], dtype=np.int64),
        np.frombuffer(b"".join(m["sig"] for m in members), dtype=np.uint8).reshape(len(members), -1),
    )


def _between(scratch: core.Scratch, members: DataFrame, dense: DataFrame, percent: int) -> DataFrame:
    """a, b: candidate pairs that share a bucket but not a dense group. members: node, n_shingles, sig, keys."""
    now = members.join(dense.select(F.col("node").alias("x"), F.col("component").alias("group")), F.col("node") == F.col("x"), "left").withColumn("group", F.coalesce("group", "node"))
    in_bucket = now.select("node", "group", "n_shingles", "sig", F.explode("keys").alias("key"))
    parts = in_bucket.groupBy("key", "group").agg(F.count("*").alias("n"))
    # Buckets with more than one group; members of the largest are compared with the others only.
    open_ = parts.groupBy(F.col("key").alias("k")).agg(F.max_by("group", F.struct("n", "group")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("n"), F.count("*").alias("parts")).where("parts > 1")
    open_ = open_.select("k", "main", F.ceil(F.col("n") / MEMBERS).cast("int").alias("blocks"), F.ceil((F.col("n") - F.col("most")) / MEMBERS).cast("int").alias("minor_blocks"))
    dealt = scratch.keep(in_bucket.join(open_, F.col("key") == F.col("k")).drop("k"), "open_buckets")
    row = F.collect_list(F.struct("node", "group", "n_shingles", "sig"))
    blocks = dealt.groupBy("key", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).alias("block")).agg(row.alias("members"))
    minor = dealt.where("group <> main").groupBy("key", "blocks", F.pmod(F.xxhash64("node", F.lit(1)), F.col("minor_blocks")).alias("part")).agg(row.alias("minor"))
    minor = minor.select("key", "minor", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("block"))
    return minor.join(blocks, ["key", "block"]).select("minor", "members").mapInArrow(_compare_sketches(percent), "a long, b long").distinct()


# --- the operator -----------------------------------------------------------------------------------------


def _document(docs: DataFrame) -> list[Column]:
    """What tells documents apart: doc_id and a digest of the text (of no bytes where it is null)."""
    return [F.coalesce(docs["doc_id"].cast("long"), F.lit(_NULL_ID)).alias("doc_id"), F.coalesce(F.unhex(F.md5(docs["text"].cast("string"))), F.lit(b"")).alias("text_key")]


def _groups(scratch: core.Scratch, docs: DataFrame, k: int, percent: int, buckets: int | None) -> DataFrame:
    """doc_id (null as _NULL_ID), text_key, n_shingles, component_id (likewise), kept for each row of docs(doc_id, text)."""
    spark = scratch.spark
    core.tune(spark)
    slim = docs.select(*_document(docs), F.col("text").cast("string").alias("text"))
    sketched = scratch.keep(slim.mapInArrow(_sketch(k), _SKETCHED), "sketches")
    # A class has a number of its own as node, whatever its doc_ids are; its first document stands for it.
    first = F.min(F.struct("doc_id", "text_key"))
    classes = sketched.where("n_shingles > 0").groupBy("set_key").agg(first.alias("first")).withColumn("node", F.monotonically_increasing_id())
    classes = scratch.keep(classes, "classes")
    speaker = classes.select("node", F.col("first.doc_id").alias("d"), F.col("first.text_key").alias("t"))
    is_speaker = (F.col("doc_id") == F.col("d")) & (F.col("text_key") == F.col("t"))
    one = sketched.where("n_shingles > 0").join(speaker, is_speaker)
    one = scratch.keep(one.select("node", "n_shingles", "bands", "sig").dropDuplicates(["node"]), "representatives")
    held = one.count() * BANDS * 24  # bytes of all band keys
    buckets = buckets or core.group_count(4 * core.partitions(spark), held)
    led = scratch.keep(one.select("node", "n_shingles", "bands").mapInArrow(_local_leaders(buckets), _LED), "local_leaders")
    over = core.dealt(spark, led.where("bucket >= 0"), "bucket", held).groupBy("bucket").applyInArrow(_bucket_leaders, _LED)
    pairs = led.where("bucket < 0").select("a", "b", "ok").unionByName(over.select("a", "b", "ok"))
    pairs = scratch.keep(pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("ok").alias("ok")), "pairs")
    nodes = scratch.keep(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "candidates")
    texts = scratch.keep(slim.join(speaker.join(nodes, "node", "left_semi"), is_speaker).select("node", "text").dropDuplicates(["node"]), "candidate_texts")
    tested = scratch.keep(_confirmed(pairs.where("ok = 1"), texts, k, percent), "confirmed")
    members = one.join(nodes, "node", "left_semi").select("node", "n_shingles", "sig", F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.substring(F.col("bands"), i * 8 + 1, F.lit(8))).alias("keys"))
    members = scratch.keep(members, "members")

    def closed(links: DataFrame) -> DataFrame:
        return scratch.keep(components(spark, links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "labels")

    labels = closed(tested.where("linked"))
    sig = members.select("node", "sig")
    near = pairs.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b").select("a", "b", "sig_a", "sig_b").mapInArrow(_estimate, "a long, b long, near double")
    dense = closed(near.where(F.col("near") >= DENSE))
    inside = scratch.keep(_inside(scratch, dense, labels, texts, members.select("node", "n_shingles"), k, percent), "inside")
    between = scratch.keep(_between(scratch, members, dense, percent).join(tested, ["a", "b"], "left_anti"), "between")
    more = scratch.keep(_confirmed(between, texts, k, percent).where("linked").select("a", "b").unionByName(inside), "more_links")
    if not more.isEmpty():
        labels = closed(tested.where("linked").select("a", "b").unionByName(more))
    final = scratch.keep(classes.join(labels.withColumnRenamed("node", "x"), F.col("node") == F.col("x"), "left").select(F.col("set_key").alias("s"), "first", "component"), "labelled")
    # A group may hold a third of all classes: its first document is found over salts, as the components are.
    grouped = with_least(final.where("component is not null"), "component", F.col("first"), F.col("s"), salts(spark), "least")
    final = grouped.select("s", F.col("least").alias("first")).unionByName(final.where("component is null").select("s", "first"))
    out = sketched.join(final, F.col("set_key") == F.col("s"), "left").withColumn("component_id", F.coalesce("first.doc_id", "doc_id"))
    kept = (F.col("doc_id") == F.col("component_id")) & (F.col("text_key") == F.coalesce("first.text_key", "text_key"))
    return out.select("doc_id", "text_key", "n_shingles", "component_id", kept.alias("kept"))


def groups(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80, buckets: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs(doc_id, text)."""
    scratch = core.Scratch(spark)
    real = lambda c: F.when(F.col(c) != _NULL_ID, F.col(c)).alias(c)
    out = _groups(scratch, docs, k, percent, buckets).select(real("doc_id"), "n_shingles", real("component_id"), "kept")
    return scratch.finish(out, "groups")


def rows(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents of which one of each group stays, with their own columns; rows equal in doc_id and text stay once."""
    scratch = core.Scratch(spark)
    stay = _groups(scratch, docs, k, percent, None).where("kept").select("doc_id", "text_key").distinct()
    stay = scratch.finish(stay, "stay")
    doc_id, text_key = _document(docs)
    packed = docs.select(F.struct(*docs.columns).alias("row"), doc_id.alias("d"), text_key.alias("t"))
    return packed.join(stay, (F.col("d") == F.col("doc_id")) & (F.col("t") == F.col("text_key")), "left_semi").dropDuplicates(["d", "t"]).select("row.*")
