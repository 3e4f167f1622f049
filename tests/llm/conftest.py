"""Small tables that hold every odd case, for all operators."""

import random

import pytest

EXTRA = "lang string, source string, row bigint, size int, n int, node string, score string, key string, n_lines string, hash string"


def _extra(i):
    return (["en", "de", None][i % 3], ["src0", "src1", None][i % 3], i, i, i, "x", "y", "z", "l", None)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, a very long one, ties, repeated rows, clashing names."""
    draw = random.Random(5)
    word = lambda: draw.choice(["alpha", "beta", "gamma", "delta", "über", "niño", "omega", "Kappa"])
    long_text = "\n".join(" ".join(word() for _ in range(40)) for _ in range(2500))
    texts = [None, "", " \t\n ", "...", "one", "Two words", long_text, "shared line\nown a", "shared line \nown b", "x" * 300_000]
    texts += [" ".join(word() for _ in range(60)) for _ in range(20)]
    rows = [(i, text, *_extra(i)) for i, text in enumerate(texts)]
    rows += [rows[10], rows[10], (None, texts[11], *_extra(1)), (None, None, *_extra(2)), (77, texts[12], *_extra(0))]
    return spark.createDataFrame(rows, f"doc_id bigint, text string, {EXTRA}")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture
def small_docs(spark):
    """The smallest given documents, as (id, text) rows too."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return docs, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
