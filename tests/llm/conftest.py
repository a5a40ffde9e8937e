import random

import pytest

DOC = ("doc_id long, text string, lang string, source string, n_chars long, row string, key string, size string, "
       "slice string, hash string, body string, ids string, position string, fp string, label string, id string, own_id string, own_body string")
EXTRA = ("row", "key", "size", "slice", "hash", "body", "ids", "position", "fp", "label", "id", "own_id", "own_body")


def make_docs(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    full = [(i, t, "en", s, None if t is None else len(t), *EXTRA) for i, t, s in rows]
    return spark.createDataFrame(full, DOC)


def prose(seed, words, vocabulary=4000):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}x" for _ in range(words))


@pytest.fixture(scope="module")
def edge_rows():
    """Nulls in every column, empty and blank texts, a very long one, ties, repeated rows."""
    same = prose(1, 60).replace(" w1", "\nw1")
    return [
        (1, same, "a"), (2, same, "a"), (2, same, "a"), (3, None, "b"), (4, "", "b"), (5, " \n\t ", None),
        (None, prose(2, 30), "a"), (6, "one", None), (7, prose(3, 40_000), "c"), (8, "x" * 150_000, "c"),
        (9, "Zwölf Boxkämpfer jagen Viktor\nquer über den großen\nSylter Deich", "c"), (10, "\n".join(["again"] * 9), "c"),
        (11, "a😀b 漢字 漢字 かな", "b"),
    ]


@pytest.fixture(scope="module")
def edge_docs(spark, edge_rows):
    return make_docs(spark, edge_rows)


@pytest.fixture(scope="module")
def no_docs(spark):
    return make_docs(spark, [])
