"""SentencePiece encoding and decoding against the library itself."""

import hashlib
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import pieces
from ledgerloom.llm.queries import piece_path

ODD = [" ", "  ", "\n", "\t", "the", "é", "é", "中", "国", "🙂", "▁", "x1", "\x00", "aaa", "<s>", "<0x0A>", "</s>", " ", "ﷺ", "\x7f", "İ"]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_path())


@pytest.fixture(scope="module")
def model():
    return pieces.model(piece_path())


def same(model, library, text):
    want = library.encode(text)
    assert model.ids(text) == want, repr(text)
    known = pieces.Words(model)
    words = model.split(text)
    known.learn(words)
    assert ",".join(known[w][1] for w in words) == ",".join(map(str, want))
    assert model.text(want) == library.decode(want)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(model, library, text):
    same(model, library, text.encode("utf-8", "replace").decode())


def test_made_texts(model, library):
    rng, names = random.Random(5), [*model.rank]
    for k in range(3000):
        kind = k % 4
        if kind == 0:
            text = "".join(rng.choices(names, k=rng.randint(1, 12))).replace("▁", " ")
        elif kind == 1:
            text = "".join(rng.choices("abcdeé ", k=rng.randint(1, 60)))
        elif kind == 2:
            text = "".join(rng.choices(ODD, k=rng.randint(0, 40)))
        else:
            text = " " * rng.randint(0, 70) + rng.choice(["the", "a", "", ".", "\n"]) + " " * rng.randint(0, 40)
        same(model, library, text)


def test_compatible_is_merging_again(model):
    rng, whole = random.Random(6), [*model.shorter]
    spaces = [p for p in whole if not p.strip("▁")]
    pairs = [(rng.choice(whole), rng.choice(whole)) for _ in range(3000)] + [(a, b) for a in spaces for b in spaces + ["▁the", "the", "a"]]
    for a in rng.choices(whole, k=400):  # pairs that merging may take apart
        pairs += [(a[:k], a[k:]) for k in range(1, len(a)) if a[:k] in model.shorter and a[k:] in model.shorter]
    for a, b in pairs:
        assert model.compatible(a, b) == (model.merge(a + b) == [a, b])


@pytest.mark.parametrize("unit", ["a", " ", "中国人", "ab1_", "\n", "🙂", "é ", "aé🙂", "  x"])
def test_long_words_take_time_by_their_length(model, library, unit):
    text = unit * (100_000 // len(unit))
    start = time.perf_counter()
    ids = model.ids(text)
    assert time.perf_counter() - start < 10
    assert ids == library.encode(text) and model.text(ids) == library.decode(ids)


def test_digests(spark, docs, rows, library):
    twice = docs.withColumn("n_tokens", docs["n_chars"]).unionByName(docs.limit(3).selectExpr("*", "0L as n_tokens"))
    got = pieces.digests(spark, twice, piece_path()).collect()
    assert len(got) == len(rows) + 3
    by_id = {r["doc_id"]: r for r in got}
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "")
        want = (doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
        assert tuple(by_id[doc_id]) == want
    nothing = spark.createDataFrame([(None, None), (None, "")], "doc_id long, text string")
    none = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in pieces.digests(spark, nothing, piece_path()).collect()] == [(None, 0, none, none)] * 2
    assert pieces.digests(spark, docs.limit(0), piece_path()).collect() == []


def test_ids_and_back(spark, docs, rows, library):
    there = pieces.encoded(spark, docs.withColumn("ids", docs["lang"]), piece_path())
    back = {r["doc_id"]: r for r in pieces.decoded(spark, there.withColumnRenamed("text", "was").withColumn("text", docs["lang"]), piece_path()).collect()}
    for doc_id, text, *_ in rows:
        assert back[doc_id]["ids"] == library.encode(text or "") and back[doc_id]["text"] == library.decode(library.encode(text or ""))


def test_words_are_forgotten_and_learned_again(model, library, monkeypatch):
    monkeypatch.setattr(pieces, "HELD", 100)
    monkeypatch.setattr(pieces, "PAIRS", 10)
    known, rng = pieces.Words(model), random.Random(8)
    for _ in range(50):
        text = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(20))
        words = model.split(text)
        known.learn(words)
        assert ",".join(known[w][1] for w in words) == ",".join(map(str, library.encode(text)))
        assert model.ids(text) == library.encode(text)
    assert known.held < 1000
