import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega und der la le the of".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) * (rng.random() < 0.5) for _ in range(n))


def edge_rows(seed=3):
    """(doc_id, text): nulls, empty, blank, one word, very long, copies, near copies, repeated rows and ids."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(40, 160)) for _ in range(12)]
    long = prose(rng, 6000)
    near = base[0].split()
    near[5] = "changed"
    shared = prose(rng, 50)
    texts = [*base, None, "", " \n\t ", "word", "Zwei Wörter", "naïve ÉTUDE 😀 test", long, base[0], base[0], " ".join(near), base[1] + "\n" + shared, shared + " " + base[2], base[3] * 3, "a " * 400, "a " * 36]
    rows = [(i * 3 - 10, t) for i, t in enumerate(texts)]
    return [*rows, rows[0], rows[1], (rows[2][0], base[5]), (None, base[6]), (None, None)]


@pytest.fixture(scope="session")
def rows():
    return edge_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, "x") for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, row int, words string").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
