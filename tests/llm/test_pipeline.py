"""The pipeline's stages against brute force, stage by stage."""

import random

import corpus_pipeline
import pytest
from test_learned_ops import brute_counts, brute_groups
from test_text_ops import brute_removal, words

from ledgerloom.llm import packing


@pytest.fixture(scope="module")
def sf_dir(spark, docs, tmp_path_factory):
    rng = random.Random(21)
    path = str(tmp_path_factory.mktemp("sf"))
    junk = [(5000 + i, " ".join(f"w{rng.randrange(90)}{rng.choice('#$%&')}" for _ in range(60)), "en", "s", 0) for i in range(60)]
    fine = [(6000 + i, " ".join(f"w{rng.randrange(900)}" for _ in range(60)), "en", "s", 0) for i in range(60)]
    docs.unionByName(spark.createDataFrame(junk + fine, docs.schema)).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(d, int(d >= 6000), 0) for d, *_ in junk + fine], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, rows = docs.columns, [tuple(r) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == columns
        before, rows = rows, [tuple(r) for r in docs.collect()]
        if name == "quality rules":
            good = []
            for r in before:
                c = brute_counts(r[1])
                if c["n_words"] >= 50 and 100 * c["n_repeat_words"] <= 50 * c["n_words"] and not 5000 <= r[0] < 6000:
                    good.append(r)
            assert sorted(rows) == sorted(good)
        elif name == "minhash near-dedup":
            assert sorted(r[0] for r in rows) == sorted(d for d, v in brute_groups(before, 5, 80).items() if v[2])
        elif name == "substring dedup":
            want = {d: v for d, v in brute_removal(before, 20).items() if v[2]}
            assert {r[0]: words(r[1]) for r in rows} == {d: v[2] for d, v in want.items()}
            assert all(r[4] == len(r[1]) for r in rows if want[r[0]][1])
        else:
            assert {r[0] for r in rows} <= {r[0] for r in before} and len(rows) >= len({r[0] for r in rows})
            assert set(rows) <= set(before)
    got = corpus_pipeline.STAGES[4][1](spark, docs, sf_dir).collect()
    encode = packing.encoder(corpus_pipeline.tokenizer_path())
    assert sum(r["length"] for r in got) == sum(len(encode(r[1])) + 1 for r in rows)
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for items in places.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= packing.WIDTH
    assert corpus_pipeline.run(spark, sf_dir).count() == len(got)
