"""Documents of all the odd kinds that the operators must take."""

import random

import pytest

WORDS = ["the", "of", "and", "an", "Être", "über", "niño", "x" * 30, "end.", "a,b", "#tag", "A|B", "&&&", "Zz", "one", "two", "three", "four"]


def make_docs(seed: int = 7, n: int = 60) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): copies, near copies, shared passages, junk, nulls, empties and one long text."""
    rng = random.Random(seed)
    vocabulary = WORDS + [f"w{i}" for i in range(300)]
    passage = " ".join(rng.choices(vocabulary, k=30))
    texts: list = []
    for i in range(n):
        text = " ".join(rng.choices(vocabulary, k=rng.choice([3, 12, 40, 90])))
        if i % 7 == 1:
            text = texts[rng.randrange(len(texts))] or text
        elif i % 7 == 2 and texts[-1]:
            words = texts[-1].split(" ")
            words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        elif i % 7 == 3:
            text = f"{text}\n{passage}\t{text[:20]}"
        texts.append(text)
    texts += [None, "", " \n\t ", "one", "   ", "loop " * 90, "a b c d " * 40, "long " + " ".join(rng.choices(vocabulary, k=6000)), "tab\x0bvt\x0cff\rcr", "🙂 é́ z"]
    sources = ["hot", "hot", "b", "ä", None]
    return [(i * 3, t, ["en", "de", None][i % 3], sources[i % 5], len(t or "")) for i, t in enumerate(texts)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def rows():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)
