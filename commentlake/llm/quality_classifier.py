"""Quality classifier: logistic regression on hashed word n-grams, trained with
follow-the-regularised-leader updates and scored as sparse dot products.

A word is a run of letters, digits and marks or a run of other signs.  Hashed
are words, pairs of words, and triples of word classes (case, length, sign)
with a mark where a word equals the one or two before it, so that a pattern is
known in words never seen.  A feature's value is its share of the n-grams of its
kind, which makes a score the mean weight of a text's n-grams whatever its length.

Defined results: a null, empty or blank text has the intercept's score; without
labels all scores are 0.5; repeated rows score alike; an empty table gives no rows;
other columns pass through ``score``, but one that has the name of the result is
replaced; the query does not read them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, held_out, labelled_docs, mix64, table

#: Labelled documents that the weights are fitted on, at most.
TRAIN_LIMIT = 3_000
BITS = 18
EPOCHS = 4
CUT = 0.3

_words = re.compile(r"[^\W_]+|[^\w\s]+|_+").findall
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _word(w: str) -> int:
    """Hash of a word (low 32 bits) and its class (above)."""
    if w[0].isalnum():
        kind = 1 if w.isdigit() else 2 if w.islower() else 3 if w.isupper() else 4 if w.istitle() else 5
        size = min(len(w), 24) // 3
    else:
        kind, size = 6 + zlib.crc32(w[0].encode("utf-8", "surrogatepass")) % 16, min(len(w), 4)
    return (kind << 4 | size) << 32 | zlib.crc32(w.lower().encode("utf-8", "surrogatepass"))


_known = Memo(_word)


def ngrams(text: str | None, bits: int = BITS) -> list[np.ndarray]:
    """Feature numbers of a text, one array for each kind of n-gram."""
    words = _words(text) if text else []
    if not words:
        return []
    x = np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))
    word, kind = x & np.uint64(0xFFFFFFFF), x >> np.uint64(32)
    out = [mix64(word * _GOLD + np.uint64(1))]
    if len(x) > 1:
        out.append(mix64(mix64(word[:-1] * _GOLD + np.uint64(2)) + word[1:]))
    if len(x) > 2:
        same = (word[2:] == word[1:-1]).astype(np.uint64) * np.uint64(2) + (word[2:] == word[:-2])
        out.append(mix64(((kind[:-2] << np.uint64(24)) + (kind[1:-1] << np.uint64(12)) + kind[2:]) * _GOLD
                         + same + np.uint64(3)))
    return [(h & np.uint64((1 << bits) - 1)).astype(np.int64) for h in out]


def sparse(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, values) without repeats."""
    kinds = ngrams(text, bits)
    if not kinds:
        return np.empty(0, np.int64), np.empty(0)
    at = np.concatenate(kinds)
    value = np.concatenate([np.full(len(k), 1 / len(k)) for k in kinds])
    index, where = np.unique(at, return_inverse=True)
    return index, np.bincount(where, value)


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int = BITS, epochs: int = EPOCHS,
               alpha: float = 1.0, beta: float = 0.02, l1: float = 1e-4, l2: float = 1e-3) -> np.ndarray:
    """Weights by FTRL-proximal, one row at a time in the given order; the last
    weight is the intercept."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for (index, value), y in zip(rows, labels, strict=True):
            i, x = np.append(index, size - 1), np.append(value, 1.0)
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    return weights(np.arange(size)).astype(np.float32)


def score_of(text: str | None, w: np.ndarray, bits: int = BITS) -> float:
    total = float(w[-1]) + sum(float(w[k].mean()) for k in ngrams(text, bits))
    return 1 / (1 + float(np.exp(-np.clip(total, -35, 35))))


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", limit: int = TRAIN_LIMIT) -> np.ndarray:
    """Weights from at most ``limit`` labelled documents that are not held out.
    Their n-grams are hashed by the executors; the driver gets numbers only."""
    def run(batches):
        for b in batches:
            rows = [sparse(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "label": b["label"], "i": [i.astype(np.int32) for i, _ in rows],
                                "x": [x.astype(np.float32) for _, x in rows]})

    sample = labelled_docs(docs, labels, target, limit).withColumn("label", F.col("label").cast("int"))
    schema = T.StructType([sample.schema["doc_id"], T.StructField("label", T.IntegerType()),
                           T.StructField("i", T.ArrayType(T.IntegerType())), T.StructField("x", T.ArrayType(T.FloatType()))])
    got = sample.mapInPandas(run, schema).toPandas()
    got["order"] = [zlib.crc32(f"order {d}".encode()) for d in got["doc_id"]]
    got = got.sort_values(["order", "doc_id"])
    rows = [(np.asarray(i, np.int64), np.asarray(x, float)) for i, x in zip(got["i"], got["x"], strict=True)]
    return train_ftrl(rows, got["label"].to_numpy(float))


def score(docs: DataFrame, weights: np.ndarray, out: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1; the weights are a broadcast of
    2^BITS + 1 floats."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf(T.DoubleType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = shared.value
        for texts in batches:
            yield pd.Series([score_of(t, w) for t in texts], dtype=float)

    return docs.withColumn(out, run("text"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = train(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, weights)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))
