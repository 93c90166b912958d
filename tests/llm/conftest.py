import random

import pytest
from brute import random_words as words

@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, copies, near copies, repeated rows, extra columns with the names
    that operators add."""
    rng = random.Random(7)
    base = words(rng, 120)
    near = [*base[:60], "different", *base[61:]]
    lines = "\n".join(" ".join(words(rng, 8)) for _ in range(6))
    texts = [
        (1, " ".join(base)), (2, " ".join(base)), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t\n "), (7, "Hi."), (8, "hi."), (9, " ".join(words(rng, 30_000))),
        (10, lines), (11, lines.upper() + "\nown line of words here"), (12, "All rights reserved. cc by CC-BY"), (13, "Licensed under the Apache License,\nVersion 2.0\nLicensed under the apache license version 2.0!"),
        (14, "é" * 49 + "\n" + "é" * 60), (15, "é" * 60), (15, "é" * 60), (16, "x" * 200), (17, "a " * 400), (18, "a " * 500), (None, " ".join(base)),
    ]
    rows = [(i, t, None if k % 5 == 0 else "en", f"s{k}", None, k, "x", [1], 0.5) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words int, n_lines string, items array<int>, quality_score double")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
