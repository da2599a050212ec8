from __future__ import annotations

import random

import pytest

#: Names that operators use inside; tables may have columns of these names.
CLASHING = ("digest", "rep", "bucket", "token", "one", "comp", "__keep", "sampled", "at", "removed")
KIND = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


def corpus(n: int = 60, seed: int = 5) -> list[tuple]:
    """Documents with copies, near copies, shared passages, nulls, empty, short and long texts, repeated rows."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 7))) for _ in range(150)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    base, passage = text(90), text(60)
    rows = []
    for i in range(n):
        kind = i % 10
        t = text(rng.randint(20, 120))
        if kind == 1:
            t = base if i % 3 else base.replace(" ", "  \n")
        elif kind == 2:
            w = base.split(" ")
            for _ in range(rng.randint(1, 4)):
                w[rng.randrange(len(w))] = rng.choice(words)
            t = " ".join(w)
        elif kind == 3:
            t = t + "\n" + passage + "\n" + text(10)
        elif kind == 4:
            t = rng.choice(["", None, " \t\n", "one", "two words here", "THE THE the the the the the"])
        elif kind == 5:
            t = (text(3) + " ") * 40
        rows.append((i, t))
    rows += [(n, text(9000)), (3, rows[3][1]), (3, rows[3][1]), (None, "no id"), (None, None)]
    return [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "a", "b", None]), None, *(["x"] * len(CLASHING))) for i, t in rows]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, KIND).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], KIND)


@pytest.fixture(scope="session")
def plain(rows):
    """(doc_id, text) without nulls in the text."""
    return [(r[0], r[1] or "") for r in rows]
