import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Small documents with copies, near copies, null, empty and long texts, repeated rows and an extra column."""
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(40, 160)) for _ in range(24)]
    for k in range(6):
        words = texts[k].split()
        words[rng.randrange(len(words))] = "edited"
        texts += [texts[k], " ".join(words), " ".join(words[:-3])]
    texts += [None, "", "   \n\t ", "one two three", "one two three", "é€😀 " * 60, "x" * 5000, prose(rng, 9000), "a\nb\na\n \nb c d b c d"]
    out = [(10 * k + 3, t, "en", f"s{k % 3}" if k % 7 else None, len(t or ""), "e") for k, t in enumerate(texts)]
    return out + [out[0], (None, texts[1], None, None, 1, None)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
