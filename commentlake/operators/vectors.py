"""Vector search and embedding jobs.

F5 exact cosine top-k is a product of two matrices by blocks.  Every Arrow batch
of the corpus becomes one row, a block of vectors; every group of QUERY_BLOCK
queries becomes one row too.  Each pair of such rows is multiplied in one task,
which emits the k best of each query; a ``row_number`` window (planned as
WindowGroupLimit) merges the blocks.  Neither side passes through the driver, and
any number of queries is answered: groups of checked size are broadcast to the
corpus blocks, larger lists are dealt to them by a shuffle.  Vectors are unit
length, so the dot product is the cosine.

F6 ranks only documents that carry a query's tags: vectors meet the tag bitmaps of
their shard of ids, and the mask is applied before the product.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.sizing import BROADCAST_MAX_BYTES
from ..session import stored
from .postings import QUERY_BLOCK, SCORE_DECIMALS, TAG, TextIndex, bit_ids, shard_of, top_k

RANKED = "query_id long, id long, score double"
#: Queries multiplied with a block at once.
STRIP = 256


def _list_values(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def vector_blocks(vectors: DataFrame) -> DataFrame:
    """(ids, flat, dim): the vectors of each Arrow batch, one row for each dimension
    that occurs in it; null vectors are left out."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("embedding").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes[sizes > 0]).tolist():
                some = batch.filter(pa.array(sizes == dim))
                yield pa.RecordBatch.from_pydict({
                    "ids": pa.array([some.column("comment_id").to_numpy(zero_copy_only=False)], pa.list_(pa.int64())),
                    "flat": pa.array([_list_values(some.column("embedding"))], pa.list_(pa.float32())),
                    "dim": pa.array([dim], pa.int32())})

    return (vectors.filter(F.col("comment_id").isNotNull())
            .select("comment_id", F.col("embedding").cast("array<float>").alias("embedding"))
            .mapInArrow(pack, "ids array<long>, flat array<float>, dim int"))


def best_of_block(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, score) of the k best columns of each row by (score desc, id asc)."""
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        row, col = np.nonzero(scores >= least[:, None])               # with all ties of the k-th
    else:
        row, col = (x.ravel() for x in np.indices(scores.shape))
    i, s = ids[col], scores[row, col]
    order = np.lexsort((i, -s, row))
    row, i, s = row[order], i[order], s[order]
    first = np.searchsorted(row, np.arange(len(scores)))
    keep = np.arange(len(row)) - first[row] < k
    return row[keep], i[keep], s[keep]


def _query_groups(queries: DataFrame, k_by_query: DataFrame, size: int, *more: str) -> tuple[DataFrame, int, int, int]:
    """(qb, queries: query_id, k, qvec, ...), a row for each group of about ``size``
    queries that have a vector; the number of groups, the largest k and about how
    many bytes they are.  One aggregate is run."""
    q = (queries.where(F.col("qvec").isNotNull())
         .select("query_id", F.col("qvec").cast("array<float>").alias("qvec"), *more)
         .join(k_by_query.select("query_id", "k"), "query_id"))
    n, max_k, values = q.agg(F.count(F.lit(1)), F.max("k"), F.sum(F.size("qvec"))).first()
    groups = max(1, math.ceil(n / size))
    qb = F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int")
    rows = q.groupBy(qb.alias("qb")).agg(F.collect_list(F.struct("query_id", "k", "qvec", *more)).alias("queries"))
    return rows, groups, max_k or 0, 4 * (values or 0) + 64 * n


def cosine_topk(queries: DataFrame, vectors: DataFrame, k_by_query: DataFrame, query_size: int = QUERY_BLOCK,
                broadcast_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """exact top-k by dot product for each query.

    ``queries``: (query_id, qvec); ``vectors``: (comment_id, embedding);
    ``k_by_query``: (query_id, k).  Output (query_id, id, score, rank).
    """
    groups, _, max_k, size = _query_groups(queries, k_by_query, query_size)
    blocks = vector_blocks(vectors)
    deal = 1
    if size > broadcast_bytes:            # every deal of corpus blocks gets all groups of queries by the shuffle
        deal = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = blocks.withColumn("deal", F.pmod(F.xxhash64("ids"), F.lit(deal)))
    dealt = groups.select("queries", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(deal - 1).cast("long"))).alias("deal"))
    pairs = blocks.join(dealt if deal > 1 else F.broadcast(dealt), "deal").select("ids", "flat", "dim", "queries")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                dim = batch.column("dim")[r].as_py()
                ids = batch.column("ids")[r].values.to_numpy()
                matrix = batch.column("flat")[r].values.to_numpy().reshape(-1, dim).astype(np.float64)
                asked = batch.column("queries")[r].values
                asked = asked.filter(pa.array(asked.field("qvec").value_lengths().to_numpy(zero_copy_only=False) == dim))
                qids = asked.field("query_id").to_numpy(zero_copy_only=False)
                for lo in range(0, len(asked), STRIP):
                    part = asked.slice(lo, STRIP)
                    q = _list_values(part.field("qvec")).reshape(-1, dim).astype(np.float64)
                    k = max(part.field("k").to_pylist())
                    row, i, s = best_of_block(ids, np.round(q @ matrix.T, SCORE_DECIMALS), k)
                    yield pa.RecordBatch.from_pydict({"query_id": qids[lo + row], "id": i, "score": s})

    return top_k(pairs.mapInArrow(multiply, RANKED), k_by_query, max_k=max_k)


def cosine_restricted(queries: DataFrame, vectors: DataFrame, index: TextIndex, tags: DataFrame,
                      k_by_query: DataFrame, query_size: int = QUERY_BLOCK) -> DataFrame:
    """cosine top-k among the documents that carry one of each query's tags.

    ``queries``: (query_id, qvec, tags: names of ``tags`` (id, name)); ``index`` holds
    the tag bitmaps.  The vectors of a shard of ids meet its bitmaps and the queries
    in one task (the vectors are exchanged once, by shard); a query's mask is applied
    before its product.
    """
    named = (queries.select("query_id", F.explode(F.array_distinct("tags")).alias("name"))
             .join(tags.select(F.col("id").cast("string").alias("tag"), "name"), "name")
             .groupBy("query_id").agg(F.collect_list("tag").alias("tag_ids")))
    rows, n_groups, max_k, _ = _query_groups(queries.join(named, "query_id"), k_by_query, query_size, "tag_ids")
    wanted = rows.select("qb", F.explode(F.array_distinct(F.flatten(F.col("queries")["tag_ids"]))).alias("term"))
    bits = (index.blocks.filter(F.col("kind") == TAG).select("shard", "term", "block", "bits").join(wanted, "term")
            .groupBy("shard", "qb").agg(F.collect_list(F.struct("term", "block", "bits")).alias("masks"))
            .join(rows, "qb"))
    layout = index.layout
    own = vectors.filter(F.col("comment_id").isNotNull() & F.col("embedding").isNotNull()).select(
        shard_of(F.col("comment_id"), layout).alias("shard"),
        F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))).alias("qb"), F.col("comment_id").alias("id"),
        F.col("embedding").cast("array<float>").alias("embedding"))

    def rank(key: tuple[pa.Scalar, pa.Scalar], vecs: pa.Table, masks: pa.Table) -> pa.Table:
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if vecs.num_rows and masks.num_rows:
            ids = vecs.column("id").to_numpy()
            sizes = vecs.column("embedding").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
            parts: dict[str, tuple[list[int], list[bytes]]] = {}
            for m in masks.column("masks")[0].as_py():
                p = parts.setdefault(m["term"], ([], []))
                p[0].append(m["block"])
                p[1].append(m["bits"])
            has = {t: np.isin(ids, bit_ids(key[0].as_py(), *p, layout.span)) for t, p in parts.items()}
            starts = np.concatenate([[0], np.cumsum(sizes)])
            flat = _list_values(vecs.column("embedding").combine_chunks())
            for q in masks.column("queries")[0].as_py():
                mask = sizes == len(q["qvec"])
                mask &= np.logical_or.reduce([has[t] for t in q["tag_ids"] if t in has] or [np.zeros(len(ids), bool)])
                at = np.flatnonzero(mask)
                matrix = flat[(starts[at][:, None] + np.arange(len(q["qvec"])))].astype(np.float64)
                scores = np.round(matrix @ np.array(q["qvec"], np.float64), SCORE_DECIMALS)
                _, i, s = best_of_block(ids[at], scores[None, :], q["k"])
                out.append((np.full(len(i), q["query_id"]), i, s))
        return pa.table({c: np.concatenate(x) for c, x in zip(("query_id", "id", "score"), zip(*out, strict=True), strict=True)})

    scored = own.groupBy("shard", "qb").cogroup(bits.groupBy("shard", "qb")).applyInArrow(rank, RANKED)
    return top_k(scored, k_by_query, max_k=max_k)


# ---- F9 / F11: embedding jobs ------------------------------------------------
@dataclass(frozen=True)
class TextModel:
    """A fitted embedding: hashed term frequencies weighed by inverse document
    frequencies, unit length.  ``idf`` has one weight for each of ``dim`` buckets."""
    model_name: str
    idf: tuple[float, ...]
    ndocs: int

    def __call__(self, df: DataFrame, text_col: str) -> DataFrame:
        """``df`` with an ``embedding`` in place of the text."""
        return _embedded(df, text_col, len(self.idf), np.array(self.idf))


def _counts(tokens: pa.Array, dim: int) -> np.ndarray:
    """Rows of bucket counts of a list<string> column.  A term's bucket is the first
    32 bits of its MD5 digest modulo ``dim``; each term of a batch is hashed once."""
    sizes = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    terms = tokens.flatten().dictionary_encode()
    bucket = np.array([int.from_bytes(hashlib.md5(t.encode()).digest()[:4], "big") % dim
                       for t in terms.dictionary.to_pylist()] or [0], np.int64)
    at = np.repeat(np.arange(len(tokens)), sizes) * dim + bucket[terms.indices.to_numpy()]
    return np.bincount(at, minlength=len(tokens) * dim).reshape(len(tokens), dim)


def _embedded(df: DataFrame, text_col: str, dim: int, idf: np.ndarray) -> DataFrame:
    from ..functions import text as tx
    rest = [c for c in df.columns if c != text_col]
    schema = T.StructType([*(df.schema[c] for c in rest), T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _counts(batch.column("_tokens"), dim) * idf
            norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
            v = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0).astype(np.float32)
            offsets = pa.array(np.arange(len(v) + 1, dtype=np.int32) * dim)
            out = pa.ListArray.from_arrays(offsets, pa.array(v.ravel(), pa.float32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), out], [*rest, "embedding"])

    return df.select(*rest, tx.fts_tokens(text_col).alias("_tokens")).mapInArrow(run, schema)


def fit_text_model(texts: DataFrame, text_col: str, model_name: str = "hashed-tfidf-1", dim: int = 256) -> TextModel:
    """the inverse document frequencies ln((N + 1) / (df + 1)) + 1 of all texts; a task
    adds up ``dim`` counts, and ``dim`` numbers reach the driver."""
    from ..functions import text as tx

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(dim, np.int64), 0
        for batch in batches:
            df += (_counts(batch.column("t"), dim) > 0).sum(axis=0)
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(dim), -1)), pa.array(np.append(df, n))], ["bucket", "n"])

    parts = texts.select(tx.fts_tokens(text_col).alias("t")).mapInArrow(run, "bucket long, n long")
    n = {r.bucket: r.n for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    return TextModel(model_name, tuple(math.log((n.get(-1, 0) + 1) / (n.get(j, 0) + 1)) + 1 for j in range(dim)), n.get(-1, 0))


def write_text_model(spark: SparkSession, model: TextModel, path: str) -> None:
    """Stores the model beside its vectors; a name is written once."""
    row = spark.createDataFrame([(model.ndocs, list(model.idf))], "ndocs long, idf array<double>")
    row.coalesce(1).write.mode("error").parquet(f"{path}/model={model.model_name}")


def read_text_model(spark: SparkSession, path: str, model_name: str) -> TextModel:
    r = spark.read.parquet(f"{path}/model={model_name}").first()
    return TextModel(model_name, tuple(r.idf), r.ndocs)


def embed_queries(queries: DataFrame, model: TextModel, text_col: str = "query_text") -> DataFrame:
    """F9 at query time: prepared queries with ``qvec`` from their text (B2), by the
    model of the vectors they are compared with.  A text without known terms has none."""
    vecs = model(queries.select("query_id", text_col), text_col)
    known = F.exists("embedding", lambda x: x != 0)
    return queries.drop("qvec").join(vecs.select("query_id", F.when(known, F.col("embedding")).alias("qvec")), "query_id")


def embed_comments(comments: DataFrame, embeddings: DataFrame | None, embedder=None,
                   model: str | None = None, refresh_changed: bool = False) -> DataFrame:
    """vectors for comments that have none (C1), text per B1.  With
    ``refresh_changed`` also comments edited after their vector (Q4).  ``embedder``: a
    ``TextModel`` or any function (df, text column) -> df with ``embedding``; without
    one a model is fitted on all comments.
    Returns new rows (comment_id, embedding, model, created_at)."""
    from ..functions import text as tx
    if embedder is None:
        embedder = fit_text_model(comments.select(tx.embed_text("path", "body", "diff_hunk").alias("text")), "text")
    model = model or getattr(embedder, "model_name", "custom")
    todo = comments
    if embeddings is not None:
        e = embeddings.select(F.col("comment_id").alias("id"), F.col("created_at").alias("_vt"))
        if refresh_changed:
            todo = todo.join(e, "id", "left").where(
                F.col("_vt").isNull() | (F.col("updated_at") > F.col("_vt"))).drop("_vt")
        else:
            todo = todo.join(e.select("id"), "id", "left_anti")
    texts = todo.select("id", tx.embed_text("path", "body", "diff_hunk").alias("text"))
    out = embedder(texts, "text")
    now = datetime.now(timezone.utc).replace(tzinfo=None, microsecond=0)
    return out.select(F.col("id").alias("comment_id"), "embedding", F.lit(model).alias("model"),
                      F.lit(now).cast("timestamp_ntz").alias("created_at"))


def reembed(comments: DataFrame, embedder=None, model: str | None = None) -> DataFrame:
    """regenerate every vector after a model change (all comments)."""
    return embed_comments(comments, None, embedder, model)


def write_embeddings(vectors: DataFrame, path: str) -> None:
    """Store vectors partitioned by model; dynamic partition overwrite
    replaces only the models present in ``vectors`` (F11 re-embedding
    rewrites one model's partition, other models stay)."""
    (vectors.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("model").parquet(path))


def read_embeddings(spark, path: str, model: str) -> DataFrame:
    """Vectors of one model (partition pruned)."""
    return spark.read.parquet(path).where(F.col("model") == model)


# ---- F10: approximate top-k ----------------------------------------------------
#: Vectors that the centroids are fitted on, queries that the probes are tuned by, cells, vectors of a cell in one task.
SAMPLE, TUNING, MAX_CELLS, CELL_ROWS = 20_000, 100, 1024, 50_000


@dataclass(frozen=True)
class CellIndex:
    """Every vector in the cell of its nearest centroid."""
    vectors: DataFrame          # cell, part, id, embedding
    sizes: DataFrame            # cell, n, parts: at most MAX_CELLS rows
    centroids: np.ndarray
    probes: int


def _nearest(matrix: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    return np.argsort(-(matrix @ centroids.T), axis=1, kind="stable")[:, :n]


def _sampled(vectors: DataFrame, size: int) -> np.ndarray:
    """About ``size`` unit vectors at most, chosen by a bound on the hash of their ids."""
    n = vectors.count()
    rows = vectors.where(F.col("embedding").isNotNull())
    if n > size:
        rows = rows.where(F.pmod(F.xxhash64("comment_id", F.lit(1)), F.lit(1 << 30)) < int((1 << 30) * size / n))
    got = [r[0] for r in rows.select("embedding").limit(2 * size).collect()]
    dims = [len(v) for v in got]
    return np.array([v for v in got if len(v) == max(set(dims), key=dims.count)], np.float64)


def probes_for(sample: np.ndarray, centroids: np.ndarray, k: int, target: float) -> int:
    """The fewest cells in which TUNING queries of the sample find ``target`` of the
    k best vectors of the sample."""
    queries = sample[:: max(1, len(sample) // TUNING)][:TUNING]
    cell, order = _nearest(sample, centroids, 1)[:, 0], _nearest(queries, centroids, len(centroids))
    best = np.argsort(-(queries @ sample.T), axis=1, kind="stable")[:, :k]
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(order.shape[1])[None, :], axis=1)
    needed = np.sort(np.take_along_axis(rank, cell[best], axis=1).ravel())         # cells to probe for each of them, less 1
    return int(needed[min(len(needed) - 1, math.ceil(target * len(needed)) - 1)]) + 1


def fit_cells(vectors: DataFrame, n_cells: int | None = None, sample: int = SAMPLE, k: int = 45,
              target: float = 0.97, cell_rows: int = CELL_ROWS) -> CellIndex:
    """F10 index: centroids fitted on a bounded sample, every vector assigned to its
    nearest one (of another dimension than most: to none) and stored by cell; cells of more than ``cell_rows`` vectors have
    several parts.  How many cells a query probes is tuned on the sample, so recall
    reaches about ``target`` whatever the data; how much is saved depends on them."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    spark = vectors.sparkSession
    some = _sampled(vectors, sample)
    n_cells = min(MAX_CELLS, len(some), n_cells or math.ceil(math.sqrt(max(1, vectors.count()))))
    if n_cells < 2:
        centroids = some[:1] if len(some) else np.zeros((1, 1))
    else:
        rows = spark.createDataFrame([(v.tolist(),) for v in some], "v array<double>").select(array_to_vector("v").alias("features"))
        model = KMeans(k=n_cells, seed=5, initMode="k-means||", maxIter=12, distanceMeasure="cosine").fit(rows)
        centroids = np.array(model.clusterCenters())
        norm = np.linalg.norm(centroids, axis=1, keepdims=True)
        centroids = np.divide(centroids, norm, out=np.zeros_like(centroids), where=norm > 0)
    probes = probes_for(some, centroids, k, target) if len(some) else 1
    dim = centroids.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("embedding").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(sizes == dim))
            if batch.num_rows:
                matrix = _list_values(batch.column("embedding")).reshape(-1, dim).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(_nearest(matrix, centroids, 1)[:, 0], pa.int64()),
                                                  batch.column("id"), batch.column("embedding")], ["cell", "id", "embedding"])

    own = vectors.where("comment_id IS NOT NULL").select(F.col("comment_id").alias("id"),
                                                         F.col("embedding").cast("array<float>").alias("embedding"))
    own = stored(own.mapInArrow(assign, "cell long, id long, embedding array<float>"), "ann-cells")
    sizes = stored(own.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / cell_rows)), "ann-sizes")
    part = F.pmod(F.xxhash64("id"), F.col("parts"))
    dealt = own.join(F.broadcast(sizes.select("cell", "parts")), "cell").select("cell", part.alias("part"), "id", "embedding")
    return CellIndex(stored(dealt.repartition("cell", "part").sortWithinPartitions("cell", "part"), "ann-index"), sizes, centroids, probes)


def probed_cells(queries: DataFrame, index: CellIndex, *more: str) -> DataFrame:
    """(query_id, cell, ...): the cells that each query looks into."""
    centroids, probes = index.centroids, index.probes
    dim = centroids.shape[1]
    q = queries.where(F.size("qvec") == dim).select("query_id", F.col("qvec").cast("array<float>").alias("qvec"), *more)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = _nearest(_list_values(batch.column("qvec")).reshape(-1, dim).astype(np.float64), centroids, probes)
                at = np.repeat(np.arange(batch.num_rows), near.shape[1])
                out = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(near.ravel(), pa.int64())], [*out.schema.names, "cell"])

    schema = T.StructType([*q.schema.fields, T.StructField("cell", T.LongType())])
    return q.mapInArrow(choose, schema)


def ann_topk(queries: DataFrame, index: CellIndex, k_by_query: DataFrame, query_size: int = QUERY_BLOCK) -> DataFrame:
    """F10 (opt-in approximation of F5): cosine top-k among the vectors of the probed
    cells.  ``query_size`` queries and one part of a cell meet in one task."""
    q = (queries.where(F.col("qvec").isNotNull()).select("query_id", "qvec")
         .join(k_by_query.select("query_id", "k"), "query_id"))
    n, max_k = q.agg(F.count(F.lit(1)), F.max("k")).first()
    groups = max(1, math.ceil(n / query_size))
    asked = (probed_cells(q, index, "k").join(F.broadcast(index.sizes), "cell")
             .select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"),
                     F.pmod(F.xxhash64("query_id"), F.lit(groups)).alias("qb"), "query_id", "k", "qvec"))
    own = index.vectors.select("cell", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("qb"),
                               "id", "embedding")
    dim = index.centroids.shape[1]

    def rank(key: tuple, vecs: pa.Table, qs: pa.Table) -> pa.Table:
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if vecs.num_rows and qs.num_rows:
            ids = vecs.column("id").to_numpy()
            matrix = _list_values(vecs.column("embedding").combine_chunks()).reshape(-1, dim).astype(np.float64)
            asked_ = _list_values(qs.column("qvec").combine_chunks()).reshape(-1, dim).astype(np.float64)
            qids, k = qs.column("query_id").to_numpy(), qs.column("k").to_numpy()
            for lo in range(0, len(qids), STRIP):
                row, i, s = best_of_block(ids, np.round(asked_[lo:lo + STRIP] @ matrix.T, SCORE_DECIMALS), int(k[lo:lo + STRIP].max()))
                out.append((qids[lo + row], i, s))
        return pa.table({c: np.concatenate(x) for c, x in zip(("query_id", "id", "score"), zip(*out, strict=True), strict=True)})

    found = own.groupBy("cell", "part", "qb").cogroup(asked.groupBy("cell", "part", "qb")).applyInArrow(rank, RANKED)
    return top_k(found, k_by_query, max_k=max_k or 0)
