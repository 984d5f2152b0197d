import random

import pytest


def words(n, seed, vocabulary=40):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and blank texts, copies, repeated rows, ties, a long text, and columns whose names clash with those made inside."""
    passage = words(60, 1)
    texts = [
        passage, passage, words(50, 2), words(50, 2) + " end", "A " + passage, passage + " tail " + words(30, 3), "", " \t\n", None, None, "x", "Une phrase FRANÇAISE ici", "ä" * 70,
        "aaaa" * 40, "aaaa" * 30, words(3000, 4, 2000), "x " + words(45, 5) + "\n" + words(45, 5), "a b c", "A B C", "...",
    ]
    rows = [(i if i % 7 else None, t, ["en", "fr", None][i % 3], ["s1", "s2", None, "s1"][i % 4], len(t or ""), i, "c", i) for i, t in enumerate(texts)]
    rows += [rows[0], rows[3], rows[8]]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, shard string, fp int").repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
