import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, rank int, t double, fp long, row int"


def make_docs():
    """Nulls, empties, a very long text, copies near and exact, repeated rows, shared lines, and extra columns with clashing names."""
    r = random.Random(3)
    words = ["the", "of", "and", "to", "in", "river", "stone", "Über", "naïve", "don't", "x", "42", "half-way,", "end."]
    texts = [" ".join(r.choice(words) + str(r.randrange(50)) * (r.random() < 0.5) for _ in range(r.randrange(1, 120))) for _ in range(60)]
    texts += [texts[0], texts[0], texts[1] + " tail", None, "", " \n\t ", "one", "one two", "\n\nShared line here\n\n", "UPPER " * 80, "*** $$$ " * 60]
    texts += [" ".join(r.choice(words) for _ in range(30_000)), "日本 語 🎉 <|endoftext|> a  b\r\n c", "a b c a b c a b c", "x" * 5000]
    for n in range(20):
        texts[n] = texts[n] + "\nShared line here \n" + texts[n + 20][:40]
    rows = [(n, t, ["en", "de", None, "xx"][n % 4], ["src0", "src1", None, "é", "src0", "src0"][n % 6], None if t is None else len(t), "s", n, 0.5, n, n) for n, t in enumerate(texts)]
    return [*rows, rows[5], rows[5], (None, "no id here at all", None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def rows():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture
def scratch(spark):
    from lexplane.llm.common import Scratch

    return Scratch(spark, "test")
