"""Tables that the operators' tests share."""

import os
import random

import pytest

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ODD_DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, label string, _key string, size long"


@pytest.fixture
def odd_docs(spark):
    """Nulls everywhere, empty and long texts, repeated rows, shared ids, and columns with clashing names."""
    long = " ".join(f"w{i % 977}x{i // 977}" for i in range(4000))
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "A b  c d e\tf g"), (2, "other"), (None, "a b c d e f h"), (None, None), (3, None), (4, ""),
            (5, " \n\t "), (6, long), (7, long + " more"), (8, "x" * 3000), (9, "x" * 3000), (10, "é à   b\0c"), (11, "one")]
    return spark.createDataFrame([(i, t, None, None if n % 3 == 0 else f"s{n % 2}", None, "n", "l", "k", 5) for n, (i, t) in enumerate(rows)], ODD_DOCS)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], ODD_DOCS)


@pytest.fixture(scope="session")
def near_texts():
    """Short texts in groups of near copies, with ties at the threshold."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    out = []
    for i in range(200):
        k = rng.choice([0, 1, 3, 4, 5, 6, 8, 20, 40, 60])
        s = [base[(i % 7) * 3 % 50 + j] if i % 3 else rng.choice(base) for j in range(min(k, 9))] + base[:k]
        for _ in range(rng.choice([0, 0, 1, 2])):
            if s:
                s[rng.randrange(len(s))] = rng.choice(base).upper()
        out.append((i if i % 50 else None, None if i == 13 else " ".join(s)))
    return out
