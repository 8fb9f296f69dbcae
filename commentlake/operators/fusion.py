"""Tag pre-filter, rank fusion and hydration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.sizing import checked_broadcast
from .postings import TAG, TextIndex, bit_ids, top_k

# --- fixed values that must equal the reference's ---------------------------
RRF_K = 60
FTS_WEIGHT = 0.4
VECTOR_WEIGHT = 0.6
# -----------------------------------------------------------------------------


def candidate_bitmaps(queries: DataFrame, tags: DataFrame, index: TextIndex) -> DataFrame:
    """C3 (batch form): (query_id, shard, block, bits): the documents that carry ANY
    of a query's tags, as bitmaps of their shard's parts; one row for each query and
    part, however many documents it has."""
    qt = (queries.select("query_id", F.explode(F.array_distinct("tags")).alias("name"))
          .join(tags.select(F.col("id").cast("string").alias("term"), "name"), "name"))
    return (index.blocks.filter(F.col("kind") == TAG).select("shard", "term", "block", "bits")
            .join(qt.select("query_id", "term"), "term")
            .groupBy("query_id", "shard", "block").agg(F.bitmap_or_agg("bits").alias("bits")))


def tag_candidates(queries: DataFrame, tags: DataFrame, index: TextIndex) -> DataFrame:
    """C3 as rows: (query_id, id).  Search itself works on the bitmaps."""
    span = index.layout.span

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for query_id, shard, block, bits in zip(*(batch.column(c).to_pylist() for c in
                                                      ("query_id", "shard", "block", "bits")), strict=True):
                ids = bit_ids(shard, [block], [bits], span)
                yield pa.RecordBatch.from_pydict({"query_id": np.full(len(ids), query_id), "id": ids})

    return candidate_bitmaps(queries, tags, index).mapInArrow(unpack, "query_id long, id long")


def rrf(fts: DataFrame, vec: DataFrame, limits: DataFrame, k: int = RRF_K,
        fts_weight: float = FTS_WEIGHT, vec_weight: float = VECTOR_WEIGHT, max_k: int | None = None) -> DataFrame:
    """reciprocal rank fusion of two ranked lists (rank from 1):
    score = fts_weight/(k + rank_fts) + vec_weight/(k + rank_vec), an id in one
    list only still scores.  ``match_source`` tells which lists held the id
    (fts / vector / hybrid, Q13).  Top ``limit`` per query by (score desc,
    id asc); ``limits``: (query_id, lim); ``max_k``: the largest of them, if known."""
    u = (fts.select("query_id", "id", (F.lit(fts_weight) / (F.lit(k) + F.col("rank"))).alias("f"),
                    F.lit(None).cast("double").alias("v"))
         .unionByName(vec.select("query_id", "id", F.lit(None).cast("double").alias("f"),
                                 (F.lit(vec_weight) / (F.lit(k) + F.col("rank"))).alias("v"))))
    g = u.groupBy("query_id", "id").agg(F.max("f").alias("f"), F.max("v").alias("v"))
    scored = g.select(
        "query_id", "id",
        (F.coalesce("f", F.lit(0.0)) + F.coalesce("v", F.lit(0.0))).alias("score"),
        F.when(F.col("f").isNotNull() & F.col("v").isNotNull(), "hybrid")
         .when(F.col("f").isNotNull(), "fts").otherwise("vector").alias("match_source"))
    return top_k(scored, limits.select("query_id", F.col("lim").alias("k")), keep=("match_source",), max_k=max_k)


def hydrate(ranked: DataFrame, comments: DataFrame, bound: int | None = None) -> DataFrame:
    """C4: attach comment rows to ranked ids; ids without a row are dropped.
    The ranked side (queries x limit rows) is broadcast into the scan."""
    r = checked_broadcast(ranked, bound=bound)
    return comments.join(r, "id")


def tags_for(ids: DataFrame, comment_tags: DataFrame, tags: DataFrame,
             bound: int | None = None, n_tags: int | None = None) -> DataFrame:
    """(id, tags array sorted by name) for the given ids; ids without
    tags get an empty array."""
    i = ids.select("id").distinct()
    t = checked_broadcast(tags.select(F.col("id").alias("tag_id"), "name"), bound=n_tags)
    named = (comment_tags.select(F.col("comment_id").alias("id"), "tag_id")
             .join(checked_broadcast(i, bound=bound), "id").join(t, "tag_id"))
    agg = named.groupBy("id").agg(F.array_sort(F.collect_list("name")).alias("tags"))
    return i.join(agg, "id", "left").select(
        "id", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))
