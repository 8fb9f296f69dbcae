import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType()), T.StructField("Key", T.StringType()),
                     T.StructField("size", T.LongType()), T.StructField("copies", T.LongType())])
LABELS = "doc_id long, quality int, toxic int"


def words(seed, n):
    rng = random.Random(seed)
    syllables = "the on er ing of an re ti or es éa ou ch".split()
    return [rng.choice(syllables) + rng.choice(syllables) for _ in range(n)]


def odd_rows():
    """Nulls in every column, empty, blank and very long texts, ties, repeated
    rows, copies and near copies, a hot source."""
    base = words(1, 200)
    near = base[:100] + ["changed"] + base[101:]
    texts = [(1, " ".join(base)), (2, " ".join(base)), (3, "  ".join(near)), (4, None), (5, ""), (6, " \n\t "),
             (7, " ".join(words(2, 60_000))), (None, "one two three"), (9, "one two three"), (9, "one two three"),
             (10, 'here is token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and ' + " ".join(words(3, 80))),
             (11, "a b c d " * 100), (12, "x퟿́ 中文 <s> \x00   ﬁ"), (13, "BE!! IS!! " * 60)]
    rows = [(i, t, None if k % 5 == 0 else "en", None if k % 4 == 0 else "hot" if k % 4 < 3 else f"s{k}",
             None if k % 3 else k, None, k, None) for k, (i, t) in enumerate(texts)]
    return rows + [(100 + k, " ".join(words(100 + k, 60 + k)), "en", "hot", 1, "x", 1, 1) for k in range(30)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(100 + k, 1, 0) for k in range(30)] + [(11, 0, 0), (13, 0, 1), (13, 1, None), (None, 0, 0), (7, None, 0)]
    return spark.createDataFrame(rows, LABELS)
