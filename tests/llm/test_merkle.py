"""The Merkle manifest against plain Python."""

import hashlib
import zlib
from itertools import groupby

from pyspark.sql import functions as F

from ledgerloom.llm import merkle
from ledgerloom.operators.numbering import numbered

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """The root, and for each leaf its steps up: (members of the run, place in it)."""
    steps, at, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for k, i in enumerate(at):
            steps[k].append((runs[i // 16], i % 16))
        at, nodes = [i // 16 for i in at], [digest(*r) for r in runs]
    return nodes[0], steps


def brute(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row."""
    def leaf(row, text):
        doc_id, _, lang, source, n_chars = row
        return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda r: (r[3] is not None, (r[3] or "").encode())
    found = []
    for _, part in groupby(sorted(rows, key=key), key=key):
        part = sorted(part, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        found.append((part, *tree([leaf(r, r[1]) for r in part])))
    root, outer = tree([f[1] for f in found])
    out = []
    for (part, subroot, inner), above in zip(found, outer, strict=True):
        for row, below in zip(part, inner, strict=True):
            steps = below + above
            own = leaf(row, row[1])
            now = own
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[1] is not None:
                now = leaf(row, row[1].translate(lower))
            for run, j in steps:
                now = digest(*run[:j], now, *run[j + 1 :])
            out.append((row[0], own, subroot, root, digest(*(x for run, j in steps for x in run[:j] + run[j + 1 :])), now, now == root))
    return out


def check(spark, rows, n=3):
    got = merkle.manifest(spark, spark.createDataFrame(rows, SCHEMA).repartition(n))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute(rows)))


def test_documents_of_all_kinds(spark, rows):
    check(spark, rows + [(None, None, None, None, None), (None, "A", "en", None, 1), (5, "A", "en", "hot", 1), (5, "B", "en", "hot", 1), (5, "B", "en", "hot", 1), (9, "x_y\x00é", "_", "_", -1)])


def test_deep_trees_and_lone_leaves(spark):
    """257 and 4,100 leaves of a source are three and four levels, with runs of one node; 40 sources are two levels."""
    rows = [(i, f"Text {i}", "en", "hot", i) for i in range(4100)] + [(i, "B", "de", "next", 1) for i in range(5000, 5257)]
    rows += [(10_000 + i, "One", None, f"s{i}" if i else None, 3) for i in range(38)]
    check(spark, rows, 4)


def test_one_leaf_one_source_and_nothing(spark):
    check(spark, [(1, "ABC", "en", "a", 3)])
    check(spark, [(i, "ABC", "en", None, 3) for i in range(17)])
    empty = merkle.manifest(spark, spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and [c.split()[0] for c in merkle.RESULT.split(", ")] == empty.columns


def test_other_columns_don_t_matter(spark, rows, docs):
    extra = docs.withColumns({"leaf": F.lit("x"), "root": F.lit(1), "n": F.lit(2), "i": F.lit(3), "bucket": F.lit(4)})
    assert sorted(map(repr, map(tuple, merkle.manifest(spark, extra).collect()))) == sorted(map(repr, brute(rows)))


def test_a_change_of_any_field_shows(spark):
    rows = [(i, f"t{i}", "en", "a", 2) for i in range(20)]
    root = brute(rows)[0][3]
    for row in [(3, "t3", "en", "a", 3), (3, "t4", "en", "a", 2), (3, "t3", None, "a", 2), (3, "t3", "en", "b", 2), (30, "t3", "en", "a", 2)]:
        got = merkle.manifest(spark, spark.createDataFrame([*rows[:3], row, *rows[4:]], SCHEMA)).first()
        assert got["root"] != root
