import random

import pytest


@pytest.fixture(scope="session")
def corpus():
    """Documents with copies, near copies, shared passages, junk, and odd rows."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdeghilmnorstu") for _ in range(rng.randint(2, 7))) for _ in range(900)]

    def text(n):
        return "\n".join(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(4, 14))) for _ in range(max(1, n // 9)))

    passage = text(70)
    rows = [(i, text(rng.randint(5, 250))) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(8)]
    hub = text(160)
    for i in range(25):
        words = hub.split(" ")
        for _ in range(rng.randint(0, 8)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((200 + i, " ".join(words)))
    rows += [(300 + i, f"{text(30)}\n{passage}\n{text(40)}") for i in range(9)]
    rows += [(400, ""), (401, None), (402, "   \n\t "), (403, "one two"), (404, "One TWO"), (405, "a b c"), (406, "wort " * 400), (407, "é ü ß  x " * 30), (408, text(9000)), (409, None), (-5, rows[3][1]), (None, rows[4][1]), (None, None)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The rows with other columns, whose names clash with those that operators make."""
    wide = [(i, t, "en", "src", None if t is None else len(t), 1, "x", True) for i, t in corpus]
    return spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, n_chars long, n int, component string, kept boolean").repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
