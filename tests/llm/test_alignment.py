"""Cross-tokenizer alignment against the two libraries and plain counting."""

import hashlib
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import alignment, packing
from ledgerloom.llm.queries import piece_path, tokenizer_path

ODD = ["a<|endoftext|>b", "x▁y", " lead", "trail ", "  two  spaces  ", "\n\nnew\n lines \n", "don't can't 's", "中国人 é́ 🙂🙂", "tab\tx y　z", "a\x1c b\x85 c", "\x00", "x" * 300, " ", "▁", "<s> <0x0A>", "1,234.5 ... !!!"]


@pytest.fixture(scope="module")
def both():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=piece_path()), packing.token_bytes(tokenizer_path())


def brute(both, text):
    """The groups of one text: (ids of A, ids of B), from the ends of the libraries' tokens."""
    if not text:
        return []
    a, b, table = both
    a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    a_bytes = [table[i] for i in a_ids]
    b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in b_ids for p in [b.id_to_piece(i)]]
    if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
        return []

    def ends(parts):
        at = 0
        for p in parts:
            at += len(p)
            yield at

    a_ends, b_ends = [*ends(a_bytes)], [*ends(b_bytes)]
    out, was = [], 0
    for end in sorted(set(a_ends) & set(b_ends)):
        out.append(([i for i, e in zip(a_ids, a_ends, strict=True) if was < e <= end], [i for i, e in zip(b_ids, b_ends, strict=True) if was < e <= end]))
        was = end
    return out


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_any_text(both, text):
    text = text.encode("utf-8", "replace").decode()
    assert alignment.aligner(tokenizer_path(), piece_path())(text) == brute(both, text)


def test_made_texts(both):
    rng, parts = random.Random(4), [*ODD, " ", " ", " ", "the", "and", "\n", "ing", "  "]
    known = alignment.aligner(tokenizer_path(), piece_path())
    for text in ODD + ["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(600)]:
        assert known(text) == brute(both, text), repr(text)


def test_labels_and_spans():
    found = alignment.labels([0, 3, 5], [1, 3, 4, 5], 6)
    assert found == b"abnxbx" and alignment.spans(found) == [(2, 2), (1, 2)]


def expect(both, texts):
    """The contract's rows but for doc_id, by plain counting."""
    found = [brute(both, t) for t in texts]
    count = Counter((a[-1], b[-1]) for groups in found for a, b in groups)
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    for groups in found:
        links = [(a[-1], b[-1]) for a, b in groups]
        said = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        best = sum(count[x] == most[x[1]] for x in links)
        yield sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), best, sum(count[x] for x in links), hashlib.sha256(said.encode()).hexdigest() if groups else ""


def test_rows_against_plain_counting(spark, rows, both, monkeypatch):
    """Several blocks in a task, forgotten chunks, repeated ids, null ids and clashing columns."""
    monkeypatch.setattr(alignment, "BLOCK", 3000)
    texts = [r[1] for r in rows] + ODD + ODD[:4]
    docs = spark.createDataFrame([(None if i % 9 == 0 else i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = alignment.align(spark, docs.withColumns({"pair": F.lit(1), "n": F.lit(2), "block": F.lit(3), "count": F.lit(4)}).repartition(3), tokenizer_path(), piece_path())
    want = [(None if i % 9 == 0 else i // 2, *r) for i, r in enumerate(expect(both, texts))]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_empty_table(spark, docs):
    assert alignment.align(spark, docs.limit(0), tokenizer_path(), piece_path()).collect() == []
    none = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [tuple(r)[1:] for r in alignment.align(spark, none, tokenizer_path(), piece_path()).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_groups(spark, docs, rows, both):
    got = {}
    for r in alignment.groups(spark, docs, tokenizer_path(), piece_path()).orderBy("doc_id", "nth").collect():
        got.setdefault(r["doc_id"], []).append(r)
    for doc_id, text, *_ in rows:
        found = got.get(doc_id, [])
        assert [(r["a_ids"], r["b_ids"]) for r in found] == brute(both, text)
        assert [r["start"] for r in found] == [0, *(r["stop"] for r in found)][: len(found)]
        assert not found or found[-1]["stop"] == len(text.encode()) + 1
