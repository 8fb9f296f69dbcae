"""Near-duplicate vectors: random-hyperplane sign hashing in several tables,
exact cosines within buckets, connected components.

Equal vectors meet in one representative that carries their number.  The bits
of a table follow from the number of representatives, the number of tables from
the probability MISS with which a pair at the threshold may share no bucket.
Buckets are worked off in blocks of bounded size by matrix products; a bucket
of more than BLOCK vectors is parted, and each two of its parts meet in one
block.  A pair that shares several buckets counts in the first table only, so
links are counted without being listed; of a block's links only enough leave
the task to keep its components together.

Defined results: a vector that is null, empty, zero or holds a null or
non-finite component has no links and is its own component; so is a valid one
without vec_id (component null); vectors of different length never link;
repeated rows are vectors of their own, linked with cosine 1; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .graph import connected_components

THRESHOLD = 0.95
MISS = 1e-4
#: Vectors of a bucket that are held against each other at once.
BLOCK = 1024
#: Rows that one group of buckets has, about.
GROUP_ROWS = 8192


def hashing(n: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """(bits, tables) for n vectors: about 16 vectors of no relation a bucket."""
    bits = min(60, max(8, math.ceil(math.log2(max(n, 1))) - 4))
    hit = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-hit))


@cache
def hyperplanes(dim: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([20, dim, bits, tables]).standard_normal((dim, bits * tables))


def sign_keys(vectors: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(rows, tables) of 64-bit bucket keys."""
    signs = (vectors @ hyperplanes(vectors.shape[1], bits, tables) > 0).reshape(len(vectors), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def local_components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest row reachable from each of n rows by links a-b."""
    low = np.arange(n)
    while True:
        m = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def block_links(v: np.ndarray, keys: np.ndarray, t: int, first: np.ndarray, second: np.ndarray,
                threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked rows of ``first`` x ``second`` (each pair once if they are the
    same), without those that an earlier table has."""
    i, j = np.nonzero(v[first] @ v[second].T >= threshold)
    if first is second:
        i, j = i[i < j], j[i < j]
    i, j = first[i], second[j]
    if t and len(i):
        new = ~(keys[i, :t] == keys[j, :t]).any(axis=1)
        i, j = i[new], j[new]
    return i, j


def _norms(v: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", v, v))


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, miss: float = MISS,
                 block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id) of every row of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    e = F.col("e")
    sound = (F.col("vec_id").isNotNull() & F.coalesce(F.size(e) > 0, F.lit(False))
             & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    rows = rows.withColumn("ok", F.coalesce(sound, F.lit(False)))
    digest = [F.xxhash64("e", F.lit(s)).alias(f"d{s}") for s in (1, 2)]
    rows = stored(rows.select("vec_id", F.when(F.col("ok"), e).alias("e"), "ok", *digest), "vectors")
    reps = stored(rows.filter("ok").groupBy("d1", "d2").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")),
                  "vector-copies")
    bits, tables = hashing(reps.count(), threshold, miss)

    distinct = (rows.filter("ok").select("d1", "d2", F.col("vec_id").alias("id"), "e")
                .join(reps, ["d1", "d2", "id"]).dropDuplicates(["d1", "d2"]).select("id", "n", "e"))

    def hashed(batches):
        for b in batches:
            keys = [None] * len(b)
            dims = b["e"].map(len).to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                for p, k in zip(at, sign_keys(np.stack(b["e"].to_numpy()[at]), bits, tables), strict=True):
                    keys[p] = k
            yield b.assign(keys=keys)

    hashed_rows = stored(distinct.mapInPandas(hashed, "id long, n long, e array<double>, keys array<long>"), "vector-keys")
    keyed = hashed_rows.select("id", "n", "e", "keys", F.posexplode("keys").alias("t", "key")).withColumn("dim", F.size("e"))
    sizes = keyed.groupBy("t", "key", "dim").agg(F.count("*").alias("size")).filter("size > 1")
    large = stored(sizes.filter(F.col("size") > block), "vector-large-buckets")
    parts = F.coalesce(F.ceil(F.col("size") / block), F.lit(1)).cast("int")
    parted = (keyed.join(large, ["t", "key", "dim"], "left").withColumn("parts", parts)
              .withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
              .withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")))
    groups = max(1, reps.count() * tables // GROUP_ROWS)
    cells = parted.select(F.pmod(F.xxhash64("t", "key", "dim", "lo", "hi"), F.lit(groups)).alias("cell"),
                          "id", "n", "e", "keys", "t", "key", "dim", "lo", "hi", "own")

    def links(group: pd.DataFrame) -> pd.DataFrame:
        ids, out = [], []
        for (t, _, _, lo, hi), at in group.groupby(["t", "key", "dim", "lo", "hi"], sort=False).indices.items():
            if len(at) < 2:
                continue
            v = np.stack(group["e"].to_numpy()[at])
            v /= np.abs(v).max(axis=1, keepdims=True)
            v /= _norms(v)[:, None]
            keys = np.stack(group["keys"].to_numpy()[at])
            own = group["own"].to_numpy()[at]
            first = np.flatnonzero(own == lo)
            second = first if lo == hi else np.flatnonzero(own == hi)
            i, j = block_links(v, keys, t, first, second, threshold)
            if len(i):
                own_ids, n = group["id"].to_numpy()[at], group["n"].to_numpy()[at]
                count = np.bincount(i, n[j], len(at)) + np.bincount(j, n[i], len(at))
                low = local_components(i, j, len(at))
                hit = np.flatnonzero(count)
                ids.append(own_ids[hit])
                out.append((count[hit].astype(np.int64), own_ids[low[hit]]))
        return pd.DataFrame({"id": np.concatenate(ids) if ids else np.empty(0, np.int64),
                             "links": np.concatenate([c for c, _ in out]) if out else np.empty(0, np.int64),
                             "to": np.concatenate([x for _, x in out]) if out else np.empty(0, np.int64)})

    found = stored(cells.groupBy("cell").applyInPandas(links, "id long, links long, to long"), "vector-links")
    comps = connected_components(found.select(F.col("id").alias("a"), F.col("to").alias("b")))
    per = (reps.join(found.groupBy("id").agg(F.sum("links").alias("links")), "id", "left")
           .join(comps, "id", "left")
           .select("d1", "d2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                   F.coalesce("comp", "id").alias("component_id"), F.lit(True).alias("ok")))
    return (rows.select("vec_id", "d1", "d2", "ok").join(stored(per, "vector-components"), ["d1", "d2", "ok"], "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "vec_id").alias("component_id")))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_vectors(table(spark, sf_dir, "embeddings"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


#: All pairs, for small tables.
OP7_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0),
l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
c AS (
  SELECT vec_id AS x, vec_id AS y FROM embeddings
  UNION SELECT c.x, l.y FROM c JOIN l ON c.y = l.x),
m AS (SELECT x, min(y) AS component_id FROM c GROUP BY x),
n AS (SELECT x, count(*) AS n_links FROM l GROUP BY x)
SELECT e.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, m.component_id, e.vec_id = m.component_id AS kept
FROM embeddings e JOIN m ON m.x = e.vec_id LEFT JOIN n ON n.x = e.vec_id
"""
