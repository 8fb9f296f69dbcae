"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read back: lineage is
    cut and a lost executor costs a reread, not a recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(key: Column) -> Column:
    """True for the fifth of the rows whose crc32(key as text) is 0 mod 5."""
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def first_by_hash(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """The ``limit`` rows of ``df`` that come first by the hash of ``keys`` (then by
    these).  A bound on the hash, from the number of rows, leaves about twice as many
    for the sort, so tasks do not each send their first ``limit`` rows to one."""
    n, h = df.count(), F.xxhash64(*keys)
    if n > 4 * limit:
        df = df.filter(h < int(-(1 << 63) + (1 << 64) * (2 * limit + 100) / n))
    return df.orderBy(h, *keys).limit(limit)


def training_labels(labels: DataFrame, target: str, limit: int) -> DataFrame:
    """At most ``limit`` (doc_id, label) rows that are not held out, chosen by
    hash order.  A document labelled twice counts once, with the smaller label."""
    known = (labels.filter(F.col("doc_id").isNotNull() & F.col(target).isNotNull()
                           & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.min(target).alias("label")))
    return first_by_hash(known, ["doc_id"], limit)


def labelled_docs(docs: DataFrame, labels: DataFrame, target: str, limit: int) -> DataFrame:
    """(doc_id, text, label) of the bounded training sample.  The broadcast side
    has at most ``limit`` rows of two numbers.  Repeated documents count once."""
    sample = training_labels(labels, target, limit)
    return (docs.select("doc_id", "text")
            .join(F.broadcast(sample), "doc_id")
            .groupBy("doc_id", "label").agg(F.min("text").alias("text")))


class Memo(dict):
    """A dict that fills itself with ``make(key)``.  When its keys and values take
    ``limit`` bytes they become the older generation, of which keys in use come
    back; keys above ``longest`` characters are made anew each time.  So a worker's
    memory stays below twice the limit, however many and however long keys are."""

    #: Of a key and a value: their objects' heads and the place in the dict.
    ENTRY = 200

    def __init__(self, make, limit: int = 32 << 20, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest, self.older, self.held = make, limit, longest, {}, 0

    def __missing__(self, key):
        long_key = len(key) if isinstance(key, (str, bytes)) else 0
        if long_key > self.longest:
            return self.make(key)
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        size = self.ENTRY + 4 * long_key + (len(value) if isinstance(value, (str, bytes)) else 0)
        if self.held + size > self.limit:
            self.older, self.held = dict(self), 0
            self.clear()
        self[key] = value
        self.held += size
        return value

    def drop(self) -> None:
        """Forgets everything."""
        self.clear()
        self.older, self.held = {}, 0


_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), element by element."""
    x = x ^ (x >> _S33)
    x = x * _M1
    x ^= x >> _S33
    x = x * _M2
    x ^= x >> _S33
    return x


def fresh(name: str, taken: Sequence[str]) -> str:
    """A column name that no column of the input has (case-insensitively)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name
