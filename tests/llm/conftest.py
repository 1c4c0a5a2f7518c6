import random

import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names clash with the operators' own."""
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)] + ["Été", "naïve", "日本", "x1,"]
    base = [rng.choice(vocabulary) for _ in range(300)]
    texts = [
        (1, " ".join(base)),
        (2, " ".join(base[:150]) + "\n\tnew tail here " + " ".join(base[200:280])),
        (3, " ".join(base)),
        (4, None),
        (5, ""),
        (6, " \n\t "),
        (7, "one two"),
        (8, " ".join(["again"] * 500)),
        (9, " ".join(["again"] * 120)),
        (10, " ".join(rng.choice(vocabulary) for _ in range(20000))),
        (11, " ".join(base[10:59])),
        (12, " ".join(base[10:60])),
        (12, " ".join(base[10:60])),
        (12, "other text of one id"),
        (None, " ".join(base)),
        (None, None),
        (13, "<|endoftext|> Ends <|startoftext|>x"),
        (14, " ".join(["ONE!!", "TWO!!"] * 40)),
    ]
    rows = [(d, t, "en", "s", 1, 5, 0.5, "row") for d, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row int, score double, start string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
