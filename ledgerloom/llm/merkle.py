"""A Merkle manifest of a dataset: 16-way hash trees by source, one tree over their roots, and a proof for each row.

Spark hashes the rows where they lie, so texts are read once and never shuffled, and numbers the leaves of each source in order by ranges.
256 leaves that follow each other make a bucket, which is a whole subtree wherever it lies; buckets are dealt over blocks, whatever their source. On a block,
DuckDB runs a query for each level: ordered string_agg over runs of 16, then sha256. Spark combines the buckets' roots level by level up to the root, goes
down again with each node's siblings, and joins the outer proofs with the blocks, where DuckDB completes each row's proof and folds it.

A block holds a few buckets, so tasks hold little, and a source with a third of all rows is spread like the others. The driver learns two numbers: the
size of the largest source and the number of rows.

A proof's step is the text of a run with ``_`` where the node itself stands, so folding puts the node there and hashes.

Defined cases: nulls hash as ``-``; a null doc_id comes first in its source and is never tampered with; rows with one doc_id are leaves of their own, in the order of
their hashes; a null source is a source, the first one; one leaf alone is its source's root, and one source's root the root; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from . import core

#: Children of a node, 2**BITS; levels inside of a bucket; leaves of a bucket; rows that a block holds on average at most.
BITS, LEVELS = 4, 2
FAN, BUCKET = 1 << BITS, 1 << BITS * LEVELS
BLOCK = 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def field(value: Column) -> Column:
    """One input of a leaf: the number of UTF-8 bytes, a colon and the value; - for null."""
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(values: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*(field(values[c]) for c in FIELDS)), 256)


def tampered() -> Column:
    """Whether the row's text is changed: by its id alone."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def lower_text() -> Column:
    """What is done to a text: A-Z become a-z."""
    return F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, and bent: the leaf of the changed row, where it is one."""
    docs = docs.select(*(F.col(c).cast("long" if c in ("doc_id", "n_chars") else "string").alias(c) for c in FIELDS))
    values = {c: F.col(c).cast("string") for c in FIELDS}
    bent = F.when(tampered(), leaf(values | {"text": lower_text()}))
    return docs.select("doc_id", "source", leaf(values).alias("leaf"), bent.alias("bent"))


# --- queries on a block ------------------------------------------------------------------------------------


def _connect(**tables: pa.Table):
    import duckdb

    db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "256MB"})
    for name, table in tables.items():
        db.register(name, table)
    return db


def _runs(level: int) -> str:
    """The runs of a level and their hashes; nodes of a tree that has come down to one stay."""
    was = f"level{level - 1}" if level > 1 else "(SELECT source, bucket, n, i, leaf AS digest FROM rows)"
    return f"""run{level} AS (SELECT source, bucket, (n + {FAN - 1}) // {FAN} AS n, i // {FAN} AS i, list(digest ORDER BY i) AS members, sha256(string_agg(digest, '' ORDER BY i)) AS digest
        FROM {was} WHERE n > 1 GROUP BY ALL),
    level{level} AS (SELECT source, bucket, n, i, digest FROM run{level} UNION ALL SELECT source, bucket, n, i, digest FROM {was} WHERE n = 1)"""


_TREE = "WITH " + ",\n".join(_runs(k) for k in range(1, LEVELS + 1))
#: n is the number of nodes of the whole source at that level.
ROOTS = f"{_TREE}\nSELECT source, bucket, n, digest FROM level{LEVELS}"
_STEPS = ", ".join(
    f"CASE WHEN p{k}.members IS NULL THEN NULL ELSE array_to_string(p{k}.members[: j{k}], '') || '_' || array_to_string(p{k}.members[j{k} + 2 :], '') END" for k in range(1, LEVELS + 1)
)
_JOINS = "\n".join(f"LEFT JOIN run{k} p{k} ON p{k}.source IS NOT DISTINCT FROM x.source AND p{k}.bucket = x.bucket AND p{k}.i = x.i // {FAN**k}" for k in range(1, LEVELS + 1))
#: The steps inside of the bucket, then those above it; the proof, and what the row as it is now folds to.
PROOFS = f"""{_TREE},
placed AS (SELECT *, {", ".join(f"CAST(i // {FAN ** (k - 1)} % {FAN} AS INTEGER) AS j{k}" for k in range(1, LEVELS + 1))} FROM rows),
steps AS (SELECT x.doc_id, x.leaf, coalesce(x.bent, x.leaf) AS now, o.subroot, o.root, list_concat(list_filter([{_STEPS}], lambda s: s IS NOT NULL), o.path) AS path
    FROM placed x JOIN above o ON o.source IS NOT DISTINCT FROM x.source AND o.bucket = x.bucket
    {_JOINS}),
done AS (SELECT *, sha256(replace(array_to_string(path, ''), '_', '')) AS proof_sha256, list_reduce(list_prepend(now, path), lambda node, step: sha256(replace(step, '_', node))) AS folded_root FROM steps)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM done"""


def _bucket_roots(rows: pa.Table) -> pa.Table:
    with _connect(rows=rows) as db:
        return db.sql(ROOTS).to_arrow_table()


def _proofs(rows: pa.Table, above: pa.Table) -> pa.Table:
    with _connect(rows=rows, above=above) as db:
        return db.sql(PROOFS).to_arrow_table()


# --- the levels above the buckets --------------------------------------------------------------------------


def climb(scratch: core.Scratch, nodes: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """From nodes(tree, i, n, digest) up to each tree's root: the runs of every level, and tree, n, digest of the roots. ``most``: the nodes of the largest tree."""
    levels, now, width = [], nodes.select("tree", "i", "n", F.col("n").alias("left"), "digest"), most
    while width > 1:
        member = F.struct((F.col("i") % FAN).alias("j"), "digest")
        up = [F.shiftright("i", BITS).alias("i"), F.shiftright(F.col("left") + (FAN - 1), BITS).alias("left")]
        runs = now.where("left > 1").groupBy("tree", "n", *up).agg(F.transform(F.array_sort(F.collect_list(member)), lambda m: m["digest"]).alias("members"))
        runs = scratch.keep(runs, "runs")  # read on the way up and on the way down; a run has 16 members at most
        levels.append(runs)
        now = now.where("left = 1").unionByName(runs.select("tree", "i", "n", "left", F.sha2(F.array_join("members", ""), 256).alias("digest")))
        width = -(-width // FAN)
    return levels, now.select("tree", "n", "digest")


def descend(levels: list[DataFrame], top: DataFrame) -> DataFrame:
    """From top(tree, n, path, ...) of each root down to the nodes: tree, i, n, path and the other columns of top."""
    others = [c for c in top.columns if c not in ("tree", "n", "path")]
    down = top.select("tree", F.lit(0).cast("long").alias("i"), "n", "path", *others)
    for k, runs in reversed([*enumerate(levels)]):
        run = runs.select(F.col("tree").alias("of"), F.col("i").alias("at"), "members")
        inner = down.where(F.col("n") > FAN**k).join(run, F.col("tree").eqNullSafe(F.col("of")) & (F.col("i") == F.col("at")))
        child = inner.select("tree", "i", "n", "path", *others, "members", F.posexplode("members").alias("j", "digest"))
        step = F.concat(F.array_join(F.slice("members", F.lit(1), F.col("j")), ""), F.lit("_"), F.array_join(F.slice("members", F.col("j") + 2, F.lit(FAN)), ""))
        child = child.select("tree", (F.col("i") * FAN + F.col("j")).alias("i"), "n", F.concat(F.array(step), "path").alias("path"), *others)
        down = down.where(F.col("n") <= FAN**k).unionByName(child)
    return down


def manifest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each row of docs(doc_id, source, lang, n_chars, text)."""
    core.tune(spark)
    scratch = core.Scratch(spark)
    order = [F.col("doc_id").asc_nulls_first(), F.col("leaf")]
    rows = numbered(leaves(docs), ["source"], order, lambda df: scratch.keep(df, "sorted"), "i", "n")
    rows = scratch.keep(rows.withColumn("bucket", F.shiftright("i", BITS * LEVELS)).withColumn("i", F.col("i") % BUCKET), "leaves")
    largest, count = rows.agg(F.max("n"), F.count("*")).first()
    if not count:
        return scratch.finish(spark.createDataFrame([], RESULT), "manifest")
    blocks = max(1, count // BLOCK, min(core.partitions(spark), count // BUCKET))
    block = F.pmod(F.xxhash64("source", "bucket"), F.lit(blocks)).alias("block")
    rows = rows.select(block, "*")

    roots = rows.select("block", "source", "bucket", "n", "i", "leaf").groupBy("block").applyInArrow(_bucket_roots, "source string, bucket long, n long, digest string")
    roots = scratch.keep(roots, "roots").select(F.col("source").alias("tree"), F.col("bucket").alias("i"), "n", "digest")
    levels, subroots = climb(scratch, roots, -(-largest // BUCKET))

    # The tree over the sources: its leaves are their roots, null first.
    sources = numbered(subroots.select("tree", F.col("n").alias("nodes"), "digest"), [], [F.col("tree").asc_nulls_first()], lambda df: scratch.keep(df, "sources"), "i", "n")
    sources = scratch.keep(sources, "numbered")
    outer = sources.select(F.lit("").alias("tree"), "i", "n", "digest")
    outer_levels, root = climb(scratch, outer, sources.count())
    placed = descend(outer_levels, root.select("tree", "n", F.array().cast("array<string>").alias("path"), F.col("digest").alias("root"))).select("i", "path", "root")
    top = sources.select("tree", F.col("nodes").alias("n"), F.col("digest").alias("subroot"), "i").join(placed, "i").drop("i")

    above = descend(levels, top).select(F.col("tree").alias("source"), F.col("i").alias("bucket"), "path", "subroot", "root")
    above = above.select(F.pmod(F.xxhash64("source", "bucket"), F.lit(blocks)).alias("block"), "*")
    return scratch.finish(rows.groupBy("block").cogroup(above.groupBy("block")).applyInArrow(_proofs, RESULT), "manifest")
