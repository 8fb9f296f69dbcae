"""F8 hybrid search for a DataFrame of queries, all queries in one job.

queries (query_id, title, paths, diff, commits, tags, limit, qvec)
  -> B2 query text; blank text -> no rows; without a column qvec the text is
     embedded by the stored model of the vectors (F9)
  -> F3/F4 BM25 top 3 x limit   and   F5/F6 cosine top 3 x limit, both masked by
     the tag bitmaps (C3; tags null/empty: no filter; tags without candidates:
     no rows)
  -> F7 fusion, top limit -> C4 hydrate (ids without a comment dropped,
     after the limit) -> C5 tags.
Shuffles: the vectors of restricted queries by shard, the two per-query top-k
windows (of at most k rows a query and task), the fusion grouping and the tag
grouping (bounded by queries x limit).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import fusion, postings, vectors


@dataclass
class SearchInputs:
    comments: DataFrame
    index: postings.TextIndex
    vectors: DataFrame          # comment_id, embedding
    tags: DataFrame             # id, name, description
    comment_tags: DataFrame     # comment_id, tag_id, confidence
    model: vectors.TextModel | None = None      # of the vectors; embeds queries that come without qvec


def prepare_queries(queries: DataFrame) -> DataFrame:
    """B2 text, Q8 limit, 3x oversampling, restriction flag; blank dropped."""
    cols = set(queries.columns)
    qt = tx.query_text(*(F.col(c) if c in cols else None
                         for c in ("title", "paths", "diff", "commits")))
    q = queries.withColumn("query_text", qt).where(~tx.is_blank("query_text"))
    lim = tx.effective_limit("limit") if "limit" in cols else F.lit(tx.DEFAULT_LIMIT)
    tags = F.col("tags") if "tags" in cols else F.lit(None).cast("array<string>")
    return q.withColumn("lim", lim).withColumn("k", F.col("lim") * postings.OVERSAMPLE) \
        .withColumn("tags", tags) \
        .withColumn("restricted", F.coalesce(F.size("tags"), F.lit(0)) > 0)


@dataclass(frozen=True)
class Ranked:
    """The two ranked lists of F8 before fusion, and what they were made from."""
    fts: DataFrame
    vec: DataFrame
    queries: DataFrame          # prepared
    stats: postings.QueryStats


def ranked_lists(queries: DataFrame, inp: SearchInputs, stemmer: str | None = None) -> Ranked:
    q = prepare_queries(queries)
    if "qvec" not in q.columns:
        q = (vectors.embed_queries(q, inp.model) if inp.model else
             q.withColumn("qvec", F.lit(None).cast("array<float>")))
    stats = postings.query_stats(q)
    index = inp.index if inp.index.tagged else postings.with_tags(inp.index, inp.comment_tags)
    kq = q.select("query_id", "k")
    fts = postings.bm25_topk(q, index, inp.tags, stats, stemmer)
    vec = vectors.cosine_topk(q.where(~F.col("restricted")), inp.vectors, kq).unionByName(
        vectors.cosine_restricted(q.where(F.col("restricted")), inp.vectors, index, inp.tags, kq))
    return Ranked(fts, vec, q, stats)


def hybrid_search(queries: DataFrame, inp: SearchInputs, stemmer: str | None = None,
                  checkpoint: bool = True) -> DataFrame:
    """F8: one row per (query, hit): query_id, rank, id, score,
    match_source, comment columns, tags."""
    r = ranked_lists(queries, inp, stemmer)
    bound = r.stats.queries * r.stats.max_k
    fused = fusion.rrf(r.fts, r.vec, r.queries.select("query_id", "lim"), max_k=r.stats.max_k)
    if checkpoint:
        # at most queries x limit rows, read twice below (hydration, tags):
        # written once to the shared checkpoint folder instead of ranking twice
        from ..session import ensure_checkpoint_dir
        ensure_checkpoint_dir(fused.sparkSession)
        fused = fused.checkpoint()
        bound = fused.count()
    hits = fusion.hydrate(fused, inp.comments, bound=bound)
    t = fusion.tags_for(fused.select("id"), inp.comment_tags, inp.tags, bound=bound)
    return (hits.join(t, "id", "left")
            .select("query_id", "rank", "id", "score", "match_source", "repo", "pr_number",
                    "user_login", "body", "path", "line", "diff_hunk", "created_at", "tags"))
