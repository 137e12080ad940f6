import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

ODD = [
    (None, "a row without id that says the same as nobody else does here"),
    (100, None),
    (101, ""),
    (102, " \t\n\x0b\x0c\r "),
    (103, "One"),
    (104, "one"),
    (105, "two words"),
    (106, "Übergröße café \U0001f600 ▁mark▁ end 　x"),
    (107, "a repeated row stands here twice with all its words"),
    (107, "a repeated row stands here twice with all its words"),
    (108, "same same same same same same same same same same " * 8),
]


@pytest.fixture(scope="session")
def rows():
    """Documents with copies, near copies, shared passages, a very long text, and every odd case."""
    made = random.Random(5)
    vocabulary = ["".join(made.choice("abcdefghij") for _ in range(made.randrange(2, 7))) for _ in range(400)]

    def text(n):
        return " ".join(made.choice(vocabulary) for _ in range(n))

    passage, out = text(60), []
    for i in range(40):
        body = text(made.randrange(3, 160))
        if i % 5 == 0:
            body = f"{body} {passage} {text(10)}"
        out.append((i, body))
    out += [(40, out[3][1]), (41, out[3][1].upper()), (42, out[3][1])]
    long = text(120).split()
    for i in range(43, 55):
        copy = list(long)
        for _ in range(made.randrange(0, 5)):
            copy[made.randrange(len(copy))] = made.choice(vocabulary)
        out.append((i, " ".join(copy)))
    out.append((60, text(30_000)))
    return out + ODD


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows, and columns whose names operators use inside."""
    columns = "doc_id long, text string, source string, lang string, n_chars long, block string, key string, n int, id string, row string, size string, target string, slot string, page string"
    full = [(i, t, [None, "", "src1", "src2", "src10"][k % 5], [None, "en"][k % 2], None, "x", "y", 1, "z", "w", "s", "t", "u", "v") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, columns).repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
