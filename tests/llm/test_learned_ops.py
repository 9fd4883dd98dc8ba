"""Near-dedup, quality rules and language ID against brute force and held-out accuracy."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import components, language_id, near_dedup, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def table(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


# --- near-dedup ------------------------------------------------------------------------------------------


def shingles(text, k):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def brute_groups(rows, k, percent):
    sets = {r[0]: shingles(r[1], k) for r in rows}
    up = {d: d for d in sets}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {d: (len(sets[d]), root(d), root(d) == d) for d in ids}


def check_groups(df, rows, k=4, percent=80):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}
    assert got == brute_groups(rows, k, percent)


def test_near_dedup(spark, docs, rows):
    check_groups(near_dedup.groups(spark, docs, k=4), rows)


def test_near_dedup_chains_and_borders(spark):
    """Copies that drift: neighbours are similar, ends are not; so leaders alone can't find every link."""
    rng = random.Random(3)
    rows, base = [], [f"v{rng.randrange(400)}" for _ in range(120)]
    for i in range(150):
        if i % 30 == 0:
            base = [f"v{rng.randrange(400)}" for _ in range(rng.choice([12, 60, 120]))]
        else:
            base = list(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                base[rng.randrange(len(base))] = f"x{rng.randrange(400)}"
        rows.append((rng.randrange(10**9), " ".join(base)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    check_groups(near_dedup.groups(spark, df, k=4), rows)


def test_near_dedup_rows_and_empty(spark, docs, rows):
    odd = docs.withColumn("node", F.lit("n")).withColumn("row", F.lit(1)).withColumn("d", F.lit(2))
    got = near_dedup.rows(spark, odd, k=4)
    assert got.columns == odd.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(d for d, v in brute_groups(rows, 4, 80).items() if v[2])
    assert near_dedup.groups(spark, docs.limit(0)).collect() == []
    null = spark.createDataFrame([(None, "a b c d e"), (4, "A b c d e"), (4, "A b c d e"), (5, None)], "doc_id long, text string")
    found = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in near_dedup.groups(spark, null, k=4).collect())
    assert found == [("4", "None", False), ("4", "None", False), ("5", "5", True), ("None", "None", True)]


def test_near_dedup_keeps_different_texts_of_one_id(spark):
    rng = random.Random(8)
    fresh = lambda n=60: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    near = lambda w: [*w[:-1], "changed"]
    a, b, c, d, e, f = (fresh() for _ in range(6))
    rows = [(None, a), (None, b), (None, b), (None, near(b)), (7, c), (7, d), (7, [*d]), (8, near(c)), (9, near(d)), (9, e), (3, near(e)), (3, f), (5, [w.upper() for w in a])]
    rows = [(i, " ".join(t)) for i, t in rows] + [(None, None), (None, ""), (None, ""), (7, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [(r["doc_id"], r["text"]) for r in near_dedup.rows(spark, df, k=4).collect()]
    links = [{rows[i] for i in group} for group in ([0, 12], [1, 3], [4, 7], [5, 8], [9, 10], [11], [13], [14], [16])]
    assert len(got) == len(links) and all(sum(x in group for x in got) == 1 for group in links)
    assert rows[0] in got and rows[4] in got and rows[5] in got and rows[10] in got
    found = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.groups(spark, df, k=4).collect()}
    assert found == {(None, None, True), (None, None, False), (7, 7, True), (8, 7, False), (9, 7, False), (9, 3, False), (3, 3, True), (5, None, False)}


def test_sketch_is_filled_and_estimates():
    rng = np.random.default_rng(5)
    for n, same in ((3, 3), (40, 30), (2000, 1500)):
        a = rng.integers(1, 2**63, n, dtype=np.uint64)
        b = np.r_[a[:same], rng.integers(1, 2**63, n - same, dtype=np.uint64)]
        s = near_dedup.sketches(np.r_[np.sort(a), np.sort(b)], np.array([0, n, 2 * n]))
        assert (s != np.iinfo(np.uint64).max).all()
        assert (s[0] == s[1]).mean() == pytest.approx(same / (2 * n - same), abs=0.16)


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(5001, 5200)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    got = {r[0]: r[1] for r in components.components(spark, spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: root(x) for x in up}


# --- quality rules ---------------------------------------------------------------------------------------


def brute_counts(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams, cover = {}, set()
    for i in range(len(w) - 2):
        grams.setdefault(tuple(w[i : i + 3]), []).append(i)
    for at in grams.values():
        if len(at) > 1:
            cover |= {j for i in at for j in range(i, i + 3)}
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(cover)}


def test_statistics(spark, docs, rows):
    extra = [(900, "x\ny\nx\n \n \nx z\nx", None, None, 0), (901, "a b c a b c", None, None, 0), (902, "a a a a", None, None, 0)]
    df = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    got = table(quality.statistics(df))
    for doc_id, text, *_ in [*rows, *extra]:
        want = brute_counts(text)
        assert {k: got[doc_id][k] for k in want} == want


def test_rules_find_planted_junk():
    rng = np.random.default_rng(2)
    n = 3000
    x = rng.random((n, len(quality.FEATURES)))
    bad = ((x[:, 0] > 0.8) & (x[:, 1] > 0.5)) | (x[:, 5] < 0.1)
    noisy = bad ^ (rng.random(n) < 0.01)
    rules = quality.learn(x, noisy, rng.integers(0, 3, n))
    test = rng.random((5000, x.shape[1]))
    truth = ((test[:, 0] > 0.8) & (test[:, 1] > 0.5)) | (test[:, 5] < 0.1)
    said = np.zeros(len(test), dtype=bool)
    for r in rules:
        said |= quality._covers(r, test)
    assert (said == truth).mean() > 0.97 and all(len(r) <= quality.MAX_CONDITIONS for r in rules)
    assert quality.learn(x, np.zeros(n, dtype=bool), np.zeros(n)) == [] and quality.learn(x[:0], bad[:0], bad[:0]) == []


def test_verdicts(spark, docs, rows):
    rng = random.Random(4)
    junk = [(1000 + i, " ".join(f"w{rng.randrange(90)}{rng.choice('#$%&')}" for _ in range(60)), "en", "s", 0) for i in range(60)]
    fine = [(2000 + i, " ".join(f"w{rng.randrange(900)}" for _ in range(60)), "en", "s", 0) for i in range(60)]
    df = docs.unionByName(spark.createDataFrame(junk + fine, docs.schema))
    labels = spark.createDataFrame([(d, int(d >= 2000), None) for d, *_ in junk + fine if d % 2] + [(None, 1, 0), (1001, 1, 0), (1003, None, 0)], "doc_id long, quality int, toxic int")
    got = table(quality.verdicts(spark, df, labels))
    assert not any(got[d]["kept"] for d, *_ in junk) and all(got[d]["kept"] for d, *_ in fine)
    for doc_id, text, *_ in rows:
        c = brute_counts(text)
        failed = c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]
        assert got[doc_id]["base_failed"] == failed and not (failed and got[doc_id]["kept"])
    odd = df.withColumn("n_words", F.lit("x"))
    kept = quality.rows(spark, odd, labels)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, r in got.items() if r["kept"])
    assert quality.verdicts(spark, df.limit(0), labels.limit(0)).collect() == []
    assert all(r["kept"] != r["base_failed"] for r in quality.verdicts(spark, df, labels.limit(0)).collect())


# --- language ID -----------------------------------------------------------------------------------------


def test_profiles_are_bundles_of_bound_vectors():
    import pyarrow as pa

    from ledgerloom.llm import core

    texts = ["Ab, c!", "", "…", "été AB"]
    buf, bounds = core.utf8(pa.array(texts))
    doc, code, has = language_id.trigrams(buf, bounds)
    got = language_id._profiles(doc, code, len(texts))
    v = lambda c: language_id._vector(ord(c) if c != " " else 0).astype(int)
    for i, s in enumerate([" ab c ", "", "", " été ab"]):
        want = sum((np.roll(v(s[j]), 2) * np.roll(v(s[j + 1]), 1) * v(s[j + 2]) for j in range(len(s) - 2)), np.zeros(language_id.DIMENSIONS))
        assert (got[i] == want).all()
    assert has.tolist() == [3, 0, 0, 5]


def test_language_id(spark):
    rng = random.Random(8)
    syllables = {"aa": ["the", "ing", "on"], "bb": ["ñe", "que", "os"], "cc": ["ж", "до", "ра"]}
    rows = [(i, " ".join("".join(rng.choices(syllables[lang], k=3)) for _ in range(rng.choice([3, 40, 400]))), lang) for i in range(240) for lang in [["aa", "bb", "cc"][i % 3]]]
    rows += [(900, None, "aa"), (901, "123 …", "bb"), (902, rows[0][1], None), (None, rows[1][1], "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = table(language_id.identify(spark, df))
    right = [got[d]["lang_pred"] == lang for d, _, lang in rows[:240] if got[d]["held_out"]]
    assert len(right) > 30 and sum(right) >= 0.98 * len(right)
    assert all(got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) for d, *_ in rows[:240])
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[902]["lang_pred"] == "aa" and got[None]["held_out"] is False
    assert all(0 <= r["score"] <= 1 for r in got.values())
    # lang and ids are no inputs: the same texts get the same answers, and nothing learned gives und.
    assert {r["lang_pred"] for r in language_id.identify(spark, df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.identify(spark, df.limit(0)).collect() == []
