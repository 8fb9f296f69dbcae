"""Full-text index and BM25 ranking.

Index (F2).  The id range is cut into equal ranges, the shards, and each shard
into blocks.  ``blocks`` has one row for each (shard, term, block): the ids that
hold the term with their term frequencies and lengths, the largest frequency and
the smallest length.  Ids are sorted, so blocks of all terms cover the same
documents.  Stored, the table is bucketed by shard and partitioned by kind:

  text   the posting blocks; written by the task that holds the shard's documents
         (one exchange of the documents, none of the postings)
  shard  one row a shard, to which queries are attached
  docs   one row a shard and segment with the ids of its documents
  tag    one row for each (shard, tag, part of 2^15 ids) with a bitmap of the ids
         that carry the tag (``with_tags``); replaced without touching the postings
  gone   ids whose rows in older segments no longer count

A ``segment`` holds the documents of one batch (``add_segment``); a commit names the
segments that count.

  vocab(term, df)                   document frequency, a row for each segment: to be added
  corpus(ndocs, total_len, avgdl)   one row

Ranking (F3) follows the FTS5 ``bm25()`` definition with equal column weights
(fixed values: k1 = 1.2, b = 0.75, idf floor 1e-6):
  idf(t)  = ln((N - df + 0.5) / (df + 0.5)), 1e-6 when <= 0
  score   = sum over query terms t of idf(t) * tf*(k1+1) / (tf + k1*(1 - b + b*dl/avgdl))
The sum runs over the query's *term positions* (a term listed twice, e.g. two
words with one stem, counts twice: Q18) in exact fixed-point arithmetic
(1e-12 units), so equal documents get equal scores in any summation order;
ties go to the smaller id (Q12).

Queries come to the postings: their terms and the queries themselves, in groups of
QUERY_BLOCK, are joined to the scan, and since the table is bucketed by shard each
task ranks its shards as they stand, without an exchange before the partial top k.
What a block can add at most follows from its largest frequency and smallest
length; blocks that cannot reach the k-th best score so far are skipped.  A query
with tags sees only the documents whose bit is set for one of them (F4), while N,
df and avgdl stay corpus-wide.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..plans.sizing import checked_broadcast
from ..session import dropped, shuffles_freed, stored
from ..sources.commits import Commits

# --- fixed values that must equal the reference's ---------------------------
K1 = 1.2
B = 0.75
IDF_FLOOR = 1e-6
OVERSAMPLE = 3          # each ranked list holds 3 x limit ids before fusion
# -----------------------------------------------------------------------------
SCORE_DECIMALS = 9          # cosine scores are rounded to this many places
SCORE_UNITS = 10 ** 12      # BM25 contributions are summed in 1e-12 units
PER_SCORE = SCORE_UNITS // 10 ** SCORE_DECIMALS

#: Documents of a shard and of a block, about, and bits of a bitmap.
SHARD_DOCS, BLOCK_DOCS, BITS = 1 << 13, 128, 1 << 15
#: Queries that a task ranks at once.
QUERY_BLOCK = 4096
TEXT, SHARD, DOCS, TAG, GONE = "text", "shard", "docs", "tag", "gone"

BLOCKS = {"shard": "long", "term": "string", "block": "int", "ids": "array<long>", "tf": "array<int>",
          "dl": "array<int>", "n": "long", "tokens": "long", "max_tf": "int", "min_dl": "int", "bits": "binary",
          "segment": "int", "kind": "string"}


@dataclass(frozen=True)
class Layout:
    """Ids of a shard and of a block, and how many tasks hold the shards."""
    span: int
    block_span: int
    buckets: int


@dataclass(frozen=True)
class TextIndex:
    blocks: DataFrame     # see BLOCKS
    vocab: DataFrame      # term, df
    corpus: DataFrame     # ndocs, total_len, avgdl (one row)
    layout: Layout
    path: str | None = None
    stems: DataFrame | None = None      # term, stem
    tagged: bool = False                # there are bitmaps
    superseded: bool = False            # a segment has tombstones

    @property
    def postings(self) -> DataFrame:
        """(term, id, tf, dl), a row for each distinct (term, document) that counts."""
        rows = (self.blocks.filter(F.col("kind") == TEXT)
                .select("shard", "segment", "term", F.inline(F.arrays_zip("ids", "tf", "dl")))
                .withColumnRenamed("ids", "id"))
        return (self.counting(rows) if self.superseded else rows).select("term", "id", "tf", "dl")

    def counting(self, rows: DataFrame) -> DataFrame:
        """Of rows (shard, segment, id, ...) those that no later segment replaces."""
        gone = (self.blocks.filter(F.col("kind") == GONE).select("shard", "segment", F.explode("ids").alias("id"))
                .groupBy("shard", "id").agg(F.max("segment").alias("before")))
        return rows.join(gone, ["shard", "id"], "left").filter("before IS NULL OR segment >= before").drop("before")


def layout_of(comments: DataFrame, shard_docs: int = SHARD_DOCS, block_docs: int = BLOCK_DOCS) -> Layout:
    """Shards of about ``shard_docs`` documents; a small corpus has smaller ones, so
    that all cores have work."""
    low, high, n = comments.agg(F.min("id"), F.max("id"), F.count("id")).first()
    n, width = n or 1, (high or 0) - (low or 0) + 1
    cores = comments.sparkSession.sparkContext.defaultParallelism
    shards = max(math.ceil(n / shard_docs), min(2 * cores, math.ceil(n / 512)))
    span = max(1, math.ceil(width / shards))
    return Layout(span, max(1, math.ceil(span * min(1.0, block_docs * shards / n))), min(shards + 1, 10_000))


def shard_of(id_: Column, layout: Layout) -> Column:
    return F.call_function("div", id_ - F.pmod(id_, F.lit(layout.span)), F.lit(layout.span))


def document_tokens(comments: DataFrame, *keep: str) -> DataFrame:
    """F1 over the three indexed columns: (id, tokens)."""
    return comments.select(*keep, "id", F.concat(tx.fts_tokens("body"), tx.fts_tokens("path"),
                                          tx.fts_tokens("diff_hunk")).alias("tokens"))


def flat_postings(comments: DataFrame) -> DataFrame:
    """(term, id, tf, dl): one row per distinct (term, document)."""
    return (document_tokens(comments).select("id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
            .groupBy("id", "dl", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"))
            .select("term", "id", "tf", "dl"))


def _collected(rows: DataFrame, layout: Layout) -> DataFrame:
    """Rows (shard, term, id, tf, dl) as blocks; rows of a shard are in one task."""
    block = F.floor(F.pmod(F.col("id"), F.lit(layout.span)) / layout.block_span).cast("int")
    entries = (rows.groupBy("shard", "term", block.alias("block"))
               .agg(F.sort_array(F.collect_list(F.struct("id", "tf", "dl"))).alias("e"),
                    F.sum("tf").alias("tokens"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl")))
    return entries.select("shard", "term", "block", F.col("e.id").alias("ids"), F.col("e.tf").alias("tf"),
                          F.col("e.dl").alias("dl"), F.size("e").cast("long").alias("n"), "tokens", "max_tf", "min_dl")


def _as_blocks(rows: DataFrame, kind: str, segment: int = 0) -> DataFrame:
    """Rows with some of the columns of BLOCKS, with all of them."""
    full = rows.withColumn("kind", F.lit(kind)).withColumn("segment", F.lit(segment))
    return full.select(*((F.col(c) if c in full.columns else F.lit(None)).cast(t).alias(c) for c, t in BLOCKS.items()))


def _block_rows(key: tuple[pa.Scalar, pa.Scalar], docs: pa.Table) -> pa.Table:
    """The posting blocks of the documents (id, tokens: joined by blanks) of one block."""
    shard, block = (k.as_py() for k in key)                # null, like the ids, for documents without one
    ids = docs.column("id").fill_null(0).to_numpy()
    tokens = pc.split_pattern(docs.column("tokens").combine_chunks(), " ")
    dl = np.where(pc.equal(docs.column("tokens"), "").to_numpy(zero_copy_only=False), 0, tokens.value_lengths().to_numpy(zero_copy_only=False))
    terms = tokens.flatten().dictionary_encode()
    # rows of one id that differ in length count apart
    places, doc = np.unique(np.stack([ids, dl]), axis=1, return_inverse=True)
    at = np.repeat(doc, tokens.value_lengths().to_numpy(zero_copy_only=False))
    entry, tf = np.unique(terms.indices.to_numpy().astype(np.int64) * places.shape[1] + at, return_counts=True)
    term, doc = np.divmod(entry, places.shape[1])
    keep = places[1, doc] > 0
    term, doc, tf = term[keep], doc[keep], tf[keep].astype(np.int32)
    length = places[1, doc].astype(np.int32)
    first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.empty(0, np.int64)
    offsets = pa.array(np.append(first, len(term)).astype(np.int32))
    lists = lambda values, t: pa.ListArray.from_arrays(offsets, pa.array(values, t))
    reduced = lambda f, v, t: pa.array(f.reduceat(v, first) if len(first) else [], t)
    return pa.table({
        "shard": pa.array([shard] * len(first), pa.int64()),
        "term": terms.dictionary.take(pa.array(term[first])).cast(pa.string()),
        "block": pa.array([block] * len(first), pa.int32()),
        "ids": lists(places[0, doc] if shard is not None else [None] * len(doc), pa.int64()), "tf": lists(tf, pa.int32()), "dl": lists(length, pa.int32()),
        "n": pa.array(np.diff(np.append(first, len(term))), pa.int64()), "tokens": reduced(np.add, tf.astype(np.int64), pa.int64()),
        "max_tf": reduced(np.maximum, tf, pa.int32()), "min_dl": reduced(np.minimum, length, pa.int32())})


def text_blocks(comments: DataFrame, layout: Layout, segment: int = 0) -> DataFrame:
    """The posting blocks: documents are exchanged by shard, all else is done where
    they come to lie.  One block's documents at a time are counted, in memory that
    depends on the block alone."""
    docs = (comments.select("id", "body", "path", "diff_hunk").withColumn("shard", shard_of(F.col("id"), layout))
            .repartition(layout.buckets, "shard"))
    block = F.floor(F.pmod(F.col("id"), F.lit(layout.span)) / layout.block_span).cast("int")
    tokens = document_tokens(docs, "shard").select("shard", block.alias("block"), "id", F.array_join("tokens", " ").alias("tokens"))
    columns = ("shard", "term", "block", "ids", "tf", "dl", "n", "tokens", "max_tf", "min_dl")
    rows = tokens.groupBy("shard", "block").applyInArrow(_block_rows, ", ".join(f"{c} {BLOCKS[c]}" for c in columns))
    return _as_blocks(rows, TEXT, segment)


def shard_rows(blocks: DataFrame) -> DataFrame:
    return _as_blocks(blocks.select("shard").distinct().withColumn("term", F.lit("")), SHARD)


def corpus_of(ndocs: Column, total_len: Column) -> list[Column]:
    return [ndocs.cast("long").alias("ndocs"), total_len.cast("long").alias("total_len"),
            F.try_divide(total_len, ndocs).alias("avgdl")]


def _statistics(blocks: DataFrame, ndocs: int) -> tuple[DataFrame, DataFrame]:
    text = blocks.filter(F.col("kind") == TEXT)
    total = text.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_len"))
    return (text.groupBy("term").agg(F.sum("n").alias("df")),
            total.select(*corpus_of(F.lit(ndocs), F.col("total_len"))))


def build_index(comments: DataFrame, layout: Layout | None = None) -> TextIndex:
    """the index of ``comments`` as a plan, without storing it."""
    layout = layout or layout_of(comments)
    text = text_blocks(comments, layout)
    vocab, corpus = _statistics(text, comments.count())
    return TextIndex(text.unionByName(shard_rows(text)), vocab, corpus, layout)


def _table_name(path: str) -> str:
    return "blocks_" + hashlib.md5(path.rstrip("/").encode()).hexdigest()


def _table(spark: SparkSession, path: str, layout: Layout, new: bool = False) -> DataFrame:
    """The stored blocks as a table of this session."""
    name = _table_name(path)
    if new:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    if not spark.catalog.tableExists(name):
        spark.sql(f"""CREATE TABLE {name} ({", ".join(f"{c} {t}" for c, t in BLOCKS.items())}) USING parquet
                      PARTITIONED BY (segment, kind) CLUSTERED BY (shard) SORTED BY (shard, term, block)
                      INTO {layout.buckets} BUCKETS LOCATION '{path}/blocks'""")
        if not new:                                   # another session wrote it
            spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return spark.table(name)


def _put(rows: DataFrame, path: str, layout: Layout, kind: str, segment: int = 0, placed: bool = False) -> None:
    """Writes the rows of one kind and segment, in place of those stored; a task
    writes the shards of one bucket, sorted as the table is declared.  ``placed``: the
    rows lie so already."""
    rows = rows.select(*(c for c in BLOCKS if c not in ("segment", "kind")))
    rows = rows if placed else rows.repartition(layout.buckets, "shard")
    with shuffles_freed(rows.sparkSession):
        rows.sparkSession.sql(f"""INSERT OVERWRITE TABLE {_table_name(path)} PARTITION (segment={segment}, kind='{kind}')
                                  SELECT * FROM {{rows}}""", rows=rows)
    rows.sparkSession.catalog.refreshTable(_table_name(path))


def write_index(comments: DataFrame, path: str, layout: Layout | None = None, stemmer: str | None = None,
                batch: int = -1) -> TextIndex:
    """Stores the index of ``comments`` under ``path``: the corpus is tokenised
    once, vocabulary and statistics are aggregated from the stored blocks' counts.
    ``batch``: see ``add_segment``."""
    layout = layout or layout_of(comments)
    spark = comments.sparkSession
    blocks = _table(spark, path, layout, new=True)
    _put(text_blocks(comments, layout), path, layout, TEXT, placed=True)
    _put(_document_rows(comments, layout), path, layout, DOCS)
    documents = stored(spark.table(_table_name(path)).filter(F.col("kind") == DOCS).select("shard", "n"), "index-shards")
    _put(shard_rows(documents), path, layout, SHARD)
    vocab, corpus = _statistics(blocks.filter(F.col("segment") == 0), 0)
    vocab.write.mode("overwrite").parquet(f"{path}/vocab/segment=0")
    n = documents.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    commits = Commits(spark, f"{path}/commits")
    commits.put(commits.latest()[0] + 1, {
        "layout": [layout.span, layout.block_span, layout.buckets], "segments": [0], "ndocs": n,
        "total_len": corpus.first()["total_len"], "superseded": False, "tagged": False, "done": batch,
        "stemmer": stemmer})
    _put_stems(path, vocab, stemmer, 0)
    return read_index(spark, path, stemmer)


def _put_stems(path: str, terms: DataFrame, stemmer: str | None, segment: int) -> None:
    """The dictionary of the terms that a segment brings."""
    if stemmer:
        from . import stemming
        stemming.stem_map(terms, stemmer).write.mode("overwrite").parquet(f"{path}/stems/segment={segment}")


def _document_rows(comments: DataFrame, layout: Layout, segment: int = 0) -> DataFrame:
    """One row a shard with its documents' ids."""
    rows = (comments.select("id", shard_of(F.col("id"), layout).alias("shard")).distinct()
            .groupBy("shard").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    return _as_blocks(rows.withColumn("n", F.size("ids")).withColumn("term", F.lit("")), DOCS, segment)


def read_index(spark: SparkSession, path: str, stemmer: str | None = None) -> TextIndex:
    """The index as last committed."""
    number, c = Commits(spark, f"{path}/commits").latest()
    if number < 0:
        raise FileNotFoundError(f"no index at {path}")
    layout = Layout(*c["layout"])
    blocks = _table(spark, path, layout).filter(F.col("segment").isin(c["segments"]) | (F.col("kind") == TAG))
    vocab = spark.read.parquet(f"{path}/vocab").filter(F.col("segment").isin(c["segments"])).select("term", "df")
    corpus = spark.range(1).select(*corpus_of(F.lit(c["ndocs"]), F.lit(c["total_len"])))
    stems = spark.read.parquet(f"{path}/stems").select("term", "stem").distinct() if stemmer else None
    return TextIndex(blocks, vocab, corpus, layout, path, stems, c["tagged"], c["superseded"])


# ---- I4: segments --------------------------------------------------------------
def add_segment(index: TextIndex, comments: DataFrame, batch: int | None = None) -> TextIndex:
    """The stored index after new and changed ``comments`` (one row an id).  Only
    their postings are written, as a segment of their own, with tombstones for the
    ids that older segments hold; frequencies and statistics change by differences,
    taken from the postings of the touched shards.  One commit makes the segment
    visible.  ``batch``: its number in a stream; a batch that is in the index already
    changes nothing."""
    spark, path, layout = comments.sparkSession, index.path, index.layout
    commits = Commits(spark, f"{path}/commits")
    number, c = commits.latest()
    if batch is not None and batch <= c["done"]:
        return read_index(spark, path)
    index = read_index(spark, path)
    segment = number + 1
    docs = stored(comments.select("id", "body", "path", "diff_hunk"), "segment-docs")
    _put(text_blocks(docs, layout, segment), path, layout, TEXT, segment, placed=True)
    own = stored(_document_rows(docs, layout, segment), "segment-ids")
    _put(own, path, layout, DOCS, segment)
    shards = F.broadcast(own.select("shard")) if own.count() <= SHARD_DOCS else own.select("shard")
    before = index.blocks.filter(F.col("kind").isin(DOCS, SHARD)).join(shards, "shard", "left_semi")
    had = stored(before.select("kind", "shard", F.explode_outer("ids").alias("id")).distinct(), "segment-known")
    _put(own.join(had.filter(F.col("kind") == SHARD).select("shard").distinct(), "shard", "left_anti")
         .withColumn("ids", F.lit(None).cast("array<long>")), path, layout, SHARD, segment)
    ids = own.select("shard", F.explode("ids").alias("id"))
    known = stored(had.filter(F.col("kind") == DOCS).select("shard", "id").join(ids, ["shard", "id"], "left_semi"), "segment-gone")
    gone = known.groupBy("shard").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("term", F.lit(""))
    _put(_as_blocks(gone, GONE, segment), path, layout, GONE, segment)
    text = index.blocks.filter(F.col("kind") == TEXT).join(shards, "shard", "left_semi")
    old = (replace(index, blocks=text.unionByName(index.blocks.filter(F.col("kind") == GONE))).postings
           .join(known.select("id"), "id", "left_semi"))
    new = (_table(spark, path, layout).filter((F.col("kind") == TEXT) & (F.col("segment") == segment))
           .groupBy("term").agg(F.sum("n").alias("df"), F.sum("tokens").alias("tokens")))
    less = old.groupBy("term").agg((-F.count(F.lit(1))).alias("df"), (-F.sum("tf")).alias("tokens"))
    change = stored(new.unionByName(less).groupBy("term").agg(F.sum("df").alias("df"), F.sum("tokens").alias("tokens")),
                    "segment-change")
    change.filter("df != 0").select("term", "df").write.mode("overwrite").parquet(f"{path}/vocab/segment={segment}")
    _put_stems(path, change.filter("df > 0"), c["stemmer"], segment)
    tokens = change.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    n_new, n_old = own.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], known.count()
    commits.put(number + 1, c | {
        "segments": [*c["segments"], segment], "ndocs": c["ndocs"] + n_new - n_old, "total_len": c["total_len"] + tokens,
        "superseded": c["superseded"] or n_old > 0, "done": c["done"] if batch is None else batch})
    dropped(docs, own, had, known, change)
    return read_index(spark, path)


def merge_segments(index: TextIndex) -> TextIndex:
    """The stored index with all that counts in one segment, to be run now and then
    beside the stream; readers of older versions keep theirs until its folders go."""
    spark, path, layout = index.blocks.sparkSession, index.path, index.layout
    commits = Commits(spark, f"{path}/commits")
    number, c = commits.latest()
    index = read_index(spark, path)
    segment = number + 1
    rows = (index.postings.withColumn("shard", shard_of(F.col("id"), layout)).repartition(layout.buckets, "shard"))
    _put(stored(_as_blocks(_collected(rows, layout), TEXT, segment), "merged-text"), path, layout, TEXT, segment)
    ids = index.blocks.filter(F.col("kind") == DOCS).select(F.explode("ids").alias("id")).distinct()
    docs = stored(_document_rows(ids, layout, segment), "merged-docs")
    _put(docs, path, layout, DOCS, segment)
    _put(shard_rows(docs), path, layout, SHARD, segment)
    vocab = _statistics(_table(spark, path, layout).filter(F.col("segment") == segment), 0)[0]
    vocab.write.mode("overwrite").parquet(f"{path}/vocab/segment={segment}")
    _put_stems(path, vocab, c["stemmer"], segment)
    commits.put(number + 1, c | {"segments": [segment], "superseded": False})
    for old in c["segments"]:
        for kind in (TEXT, DOCS, SHARD, GONE):
            spark.sql(f"ALTER TABLE {_table_name(path)} DROP IF EXISTS PARTITION (segment={old}, kind='{kind}')")
            commits.delete(f"{path}/blocks/segment={old}/kind={kind}")
        for folder in ("vocab", "stems"):
            commits.delete(f"{path}/{folder}/segment={old}")
    return read_index(spark, path)


# ---- tags as bitmaps ----------------------------------------------------------
def tag_bitmaps(comment_tags: DataFrame, layout: Layout) -> DataFrame:
    """One row for each (shard, tag, part): bit p of part b is set when the document
    of id shard * span + b * BITS + p carries the tag."""
    at = F.pmod(F.col("comment_id"), F.lit(layout.span))
    rows = (comment_tags.select(shard_of(F.col("comment_id"), layout).alias("shard"),
                                F.col("tag_id").cast("string").alias("term"),
                                F.floor(at / BITS).cast("int").alias("block"), (at % BITS).alias("bit"))
            .groupBy("shard", "term", "block")
            .agg(F.bitmap_construct_agg("bit").alias("bits"), F.count(F.lit(1)).alias("n")))
    return _as_blocks(rows, TAG)


def with_tags(index: TextIndex, comment_tags: DataFrame) -> TextIndex:
    """The index with the bitmaps of an assignment table; those of a stored index
    are written beside its postings, in place of the old ones."""
    bits = tag_bitmaps(comment_tags, index.layout)
    if index.path is None:
        return replace(index, blocks=index.blocks.filter(F.col("kind") != TAG).unionByName(bits), tagged=True)
    _put(bits, index.path, index.layout, TAG)
    commits = Commits(comment_tags.sparkSession, f"{index.path}/commits")
    number, c = commits.latest()
    commits.put(number + 1, c | {"tagged": True})
    return replace(read_index(comment_tags.sparkSession, index.path), stems=index.stems)


def bit_ids(shard: int, parts: Sequence[int], bits: Sequence[bytes], span: int) -> np.ndarray:
    """The ids whose bits are set, ascending."""
    out = [np.empty(0, np.int64)]
    for b, data in zip(parts, bits, strict=True):
        at = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little"))
        out.append(at + (shard * span + b * BITS))
    return np.unique(np.concatenate(out))


# ---- ranking ------------------------------------------------------------------
def query_terms(queries: DataFrame, text_col: str = "query_text",
                stemmer: str | None = None) -> DataFrame:
    """B4 terms of each query with their position: (query_id, qpos, term)."""
    qt = queries.select("query_id", F.posexplode(tx.search_terms(text_col)).alias("qpos", "term"))
    if stemmer:
        from . import stemming
        qt = stemming.stem_column(qt, "term", stemmer)
    return qt


@dataclass(frozen=True)
class QueryStats:
    """What is known of a query list before plans are made from it."""
    queries: int
    terms: int          # an upper bound
    max_k: int


def query_stats(queries: DataFrame) -> QueryStats:
    """One aggregate over prepared queries (query_text, k)."""
    n, chars, k = queries.agg(F.count(F.lit(1)), F.sum(F.length("query_text")), F.max("k")).first()
    return QueryStats(n, (chars or 0) // 4 + n, k or 0)


def query_block(stats: QueryStats, size: int = QUERY_BLOCK) -> Column:
    """Which of the groups of about ``size`` queries a query belongs to."""
    return F.pmod(F.xxhash64("query_id"), F.lit(max(1, math.ceil(stats.queries / size)))).cast("int")


def bm25_topk(queries: DataFrame, index: TextIndex, tags: DataFrame | None = None, stats: QueryStats | None = None,
              stemmer: str | None = None, query_size: int = QUERY_BLOCK) -> DataFrame:
    """top-k documents per query by BM25.

    ``queries``: (query_id, query_text, k, restricted, tags): a restricted query
    sees the documents that carry one of its tags (names of ``tags`` (id, name);
    the index must hold their bitmaps).  Output: (query_id, id, score, rank).
    """
    stats = stats or query_stats(queries)
    terms = query_terms(queries, stemmer=stemmer)
    variants = None
    if stemmer:
        variants, df = query_stems(index, terms, stats)
        index = replace(index, vocab=df)
    wanted, k_by_query = _query_rows(queries, terms, variants, index, tags, stats, query_size)
    span = index.layout.span

    def rank(key: tuple[pa.Scalar, pa.Scalar], table: pa.Table) -> pa.Table:
        shard = ShardRows(table, key[0].as_py(), span)
        out = [shard.top(q) for q in shard.queries]
        ids, scores = (np.concatenate([r[k] for r in out]) if out else np.empty(0) for k in (0, 1))
        qids = np.repeat([q["query_id"] for q in shard.queries], [len(r[0]) for r in out]) if out else []
        return pa.table({"query_id": pa.array(qids, pa.int64()), "id": pa.array(ids, pa.int64()),
                         "score": pa.array(scores, pa.float64())})

    found = (index.blocks.join(wanted, ["kind", "term"])
             .select("shard", "qb", "kind", "segment", "as", "block", "ids", "tf", "dl", "max_tf", "min_dl", "bits",
                     "queries", "avgdl"))
    scored = found.groupBy("shard", "qb").applyInArrow(rank, "query_id long, id long, score double")
    return top_k(scored, k_by_query, max_k=stats.max_k)


def _query_rows(queries: DataFrame, terms: DataFrame, variants: DataFrame | None, index: TextIndex,
                tags: DataFrame | None, stats: QueryStats, query_size: int) -> tuple[DataFrame, DataFrame]:
    """What is joined to the scan: (kind, term, as, qb, queries, avgdl).  The rows of
    a group of queries are its terms (of ``as``, their stem, if there are
    ``variants``), its tags, a row that fetches tombstones and, for the shard's own
    row, the queries themselves: query_id, k, terms with idf, tags (null: all
    documents).  Also returns (query_id, k)."""
    ndocs, avgdl = (index.corpus.select(c).scalar() for c in ("ndocs", "avgdl"))
    idf = F.log((ndocs - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))
    known = index.vocab.join(checked_broadcast(terms, bound=stats.terms), "term")
    known = known.groupBy("query_id", "qpos", "term").agg(F.sum("df").alias("df"))
    known = known.select("query_id", "qpos", "term", F.when(idf <= 0, F.lit(IDF_FLOOR)).otherwise(idf).alias("idf"))
    per_query = known.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("qpos", "term", "idf"))).alias("terms"))
    kq = queries.select("query_id", "k", "restricted")
    if tags is not None:
        named = (queries.filter("restricted").select("query_id", F.explode(F.array_distinct("tags")).alias("name"))
                 .join(tags.select(F.col("id").cast("string").alias("tag"), "name"), "name"))
        kq = kq.join(named.groupBy("query_id").agg(F.collect_list("tag").alias("tags")), "query_id", "left")
    else:
        kq = kq.withColumn("tags", F.lit(None).cast("array<string>"))
    none = F.array().cast("array<string>")
    full = per_query.join(kq, "query_id").select(
        query_block(stats, query_size).alias("qb"), "query_id", "k", "terms",
        F.when(F.col("restricted"), F.coalesce("tags", none)).alias("tags"))
    group = full.groupBy("qb").agg(F.collect_list(F.struct("query_id", "k", "terms", "tags")).alias("queries"),
                                   F.array_distinct(F.flatten(F.collect_list(F.col("terms")["term"]))).alias("t"),
                                   F.array_distinct(F.flatten(F.collect_list("tags"))).alias("g"))
    row = lambda kind, term, q: F.struct(F.lit(kind).alias("kind"), term.alias("term"), q.alias("queries"))
    absent = F.lit(None).cast(group.schema["queries"].dataType)
    rows = group.select("qb", F.inline(F.concat(
        F.array(row(SHARD, F.lit(""), F.col("queries")), row(GONE, F.lit(""), absent)),
        F.transform("t", lambda t: row(TEXT, t, absent)), F.transform("g", lambda t: row(TAG, t, absent)))))
    if variants is None:
        rows = rows.withColumn("as", F.col("term"))
    else:
        rows = rows.withColumnRenamed("term", "as").withColumn("stem", F.when(F.col("kind") == TEXT, F.col("as")))
        rows = (rows.join(variants, "stem", "left").drop("stem")
                .withColumn("term", F.when(F.col("kind") == TEXT, F.col("term")).otherwise(F.col("as"))))
    rows = rows.withColumn("avgdl", avgdl)
    return checked_broadcast(rows, bound=2 * stats.terms + 2 * stats.queries), kq.select("query_id", "k")


def _flat(column: pa.ChunkedArray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column; null lists are empty."""
    a = column.combine_chunks()
    a = a.chunk(0) if isinstance(a, pa.ChunkedArray) and a.num_chunks else a
    lengths = np.array([], np.int64) if not len(a) else a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return a.flatten().to_numpy(zero_copy_only=False).astype(dtype), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


class ShardRows:
    """One shard's rows of the terms and tags of a group of queries."""

    def __init__(self, table: pa.Table, shard: int, span: int):
        kind = np.array(table.column("kind").to_pylist(), object)
        own = np.flatnonzero(kind == SHARD)
        self.queries = [q for k in own.tolist() for q in table.column("queries")[k].as_py() or []]
        self.skipped = self.scored = 0
        text = table.take(np.flatnonzero(kind == TEXT))
        names, name = np.unique(np.array(text.column("as").to_pylist(), object), return_inverse=True)
        block, segment = (np.array(text.column(c).to_pylist(), np.int64) for c in ("block", "segment"))
        (self.ids, at), (self.tf, _), (self.dl, _) = (
            _flat(text.column(c), t) for c, t in (("ids", np.int64), ("tf", float), ("dl", float)))
        self.n = np.diff(at)
        max_tf, min_dl = (np.array(text.column(c).to_pylist(), float) for c in ("max_tf", "min_dl"))
        one = (name * (segment.max(initial=0) + 1) + segment) * (block.max(initial=0) + 1) + block
        if len(np.unique(one)) < len(one):
            name, segment, block = self._merge(np.stack([name, segment, block]))
            at = np.concatenate([[0], np.cumsum(self.n)])
            max_tf, min_dl = np.maximum.reduceat(self.tf, at[:-1]), np.minimum.reduceat(self.dl, at[:-1])
        self.segment, self.block, self.at = segment, block, at[:-1]
        self.avgdl = next(iter(table.column("avgdl").slice(0, 1).to_pylist()), None) or 1.0
        self.bound = (max_tf * (K1 + 1.0)) / (max_tf + K1 * (1.0 - B + B * min_dl / self.avgdl))
        self.by_term: dict[str, list[int]] = {}
        for k, t in enumerate(name.tolist()):
            self.by_term.setdefault(names[t], []).append(k)
        tag = table.take(np.flatnonzero(kind == TAG))
        parts: dict[str, tuple[list[int], list[bytes]]] = {}
        for t, b, data in zip(*(tag.column(c).to_pylist() for c in ("as", "block", "bits")), strict=True):
            p = parts.setdefault(t, ([], []))
            p[0].append(b)
            p[1].append(data)
        self.tags = {t: bit_ids(shard, *p, span) for t, p in parts.items()}
        gone = table.take(np.flatnonzero(kind == GONE))
        before: dict[int, int] = {}
        for s, ids in zip(gone.column("segment").to_pylist(), gone.column("ids").to_pylist(), strict=True):
            for i in ids:
                before[i] = max(s, before.get(i, 0))
        self.gone = np.array(sorted(before), np.int64)
        self.before = np.array([before[i] for i in self.gone.tolist()], np.int64)

    def _merge(self, keys: np.ndarray) -> np.ndarray:
        """Makes one row of rows of equal keys (the terms of a stem): the frequencies
        of a document are added.  Returns the keys of the rows left."""
        entry = np.repeat(keys, self.n, axis=1)
        order = np.lexsort((self.ids, *entry[::-1]))
        entry, ids = entry[:, order], self.ids[order]
        new_row = np.concatenate([[True], (entry[:, 1:] != entry[:, :-1]).any(axis=0)])
        first = np.flatnonzero(new_row | np.concatenate([[True], ids[1:] != ids[:-1]]))
        self.tf, self.dl, self.ids = np.add.reduceat(self.tf[order], first), self.dl[order][first], ids[first]
        rows = np.flatnonzero(new_row[first])
        self.n = np.diff(np.concatenate([rows, [len(first)]]))
        return entry[:, first][:, rows]

    def _summed(self, rows: np.ndarray, idf: np.ndarray, allowed: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores in units of 10^-SCORE_DECIMALS) of the documents in some rows."""
        n = self.n[rows]
        at = np.repeat(self.at[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        ids, tf, weight = self.ids[at], self.tf[at], np.repeat(idf, n)
        c = (weight * (tf * (K1 + 1.0))) / (tf + K1 * (1.0 - B + B * self.dl[at] / self.avgdl))
        units = np.floor(c * float(SCORE_UNITS)).astype(np.int64)
        keep = np.ones(len(ids), bool)
        if len(self.gone):
            place = np.minimum(np.searchsorted(self.gone, ids), len(self.gone) - 1)
            keep &= (self.gone[place] != ids) | (np.repeat(self.segment[rows], n) >= self.before[place])
        if allowed is not None:
            place = np.minimum(np.searchsorted(allowed, ids), len(allowed) - 1)
            keep &= allowed[place] == ids
        ids, units = ids[keep], units[keep]
        if not len(ids):
            return ids, units
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        return ids[first], (np.add.reduceat(units[order], first) + PER_SCORE // 2) // PER_SCORE

    def top(self, query: dict) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the query's best k documents, the best first."""
        k, none = query["k"], (np.empty(0, np.int64), np.empty(0))
        allowed = None
        if query["tags"] is not None:
            some = [self.tags[t] for t in query["tags"] if t in self.tags]
            allowed = np.unique(np.concatenate(some)) if some else np.empty(0, np.int64)
            if not len(allowed):
                return none
        held = [(self.by_term[t["term"]], t["idf"]) for t in query["terms"] if t["term"] in self.by_term]
        if not held or not k:
            return none
        rows = np.concatenate([np.array(r) for r, _ in held])
        idf = np.repeat([w for _, w in held], [len(r) for r, _ in held])
        block, most = self.block[rows], self.bound[rows] * idf
        blocks = int(block.max()) + 1
        can = np.bincount(block, most, blocks)
        size = np.bincount(block, self.n[rows], blocks)
        # the most promising blocks first, twice as many each time, until the next cannot reach the k-th best
        order = np.argsort(-can, kind="stable")[:np.count_nonzero(size)]
        limit = np.floor((can[order] * (1 + 1e-9) * SCORE_UNITS + PER_SCORE) / PER_SCORE) + 1
        ids, score = np.empty(0, np.int64), np.empty(0, np.int64)
        done, step, reach = 0, 1 + int(np.searchsorted(np.cumsum(size[order]), k)), -1
        while done < len(order) and limit[done] >= reach:
            turn = np.zeros(blocks, bool)
            turn[order[done:done + step]] = True
            now = turn[block]
            more = self._summed(rows[now], idf[now], allowed)
            ids, score = np.concatenate([ids, more[0]]), np.concatenate([score, more[1]])
            if len(score) >= k:
                reach = np.partition(score, len(score) - k)[len(score) - k]
            done, step = done + step, 2 * step
        self.scored += min(done, len(order))
        self.skipped += max(0, len(order) - done)
        best = np.lexsort((ids, -score))[:k]
        return ids[best], score[best] / float(10 ** SCORE_DECIMALS)


def top_k(scored: DataFrame, k_by_query: DataFrame, score: str = "score",
          keep: tuple = (), max_k: int | None = None) -> DataFrame:
    """Per-query top k by (score desc, id asc).  The largest k of the queries
    (``max_k``), as a literal, lets Spark plan a WindowGroupLimit (partial
    top-k before the shuffle); the per-query k is applied after.  ``keep``:
    extra columns carried through."""
    w = Window.partitionBy("query_id").orderBy(F.desc(score), F.asc("id"))
    ranked = scored.withColumn("rank", F.row_number().over(w))
    if max_k is not None:
        ranked = ranked.where(F.col("rank") <= max_k)
    kq = k_by_query.select("query_id", "k")   # one row per query; planner broadcasts it
    return (ranked.join(kq, "query_id").where(F.col("rank") <= F.col("k"))
            .select("query_id", "id", score, "rank", *keep))


# ---- F1: stems -------------------------------------------------------------------
def stem_frequencies(index: TextIndex, rows: DataFrame) -> DataFrame:
    """(term: a stem, df) of posting blocks (shard, segment, stem, ids).  A document
    lies in one shard, so each shard counts its own documents and only the counts are
    exchanged."""
    ids = rows.select("shard", "segment", "stem", F.explode("ids").alias("id"))
    if index.superseded:
        ids = index.counting(ids)
    own = ids.groupBy("shard", "stem", "id").agg(F.lit(1).alias("one")).groupBy("shard", "stem").agg(F.count("*").alias("n"))
    return own.groupBy(F.col("stem").alias("term")).agg(F.sum("n").alias("df"))


def stemmed_vocabulary(index: TextIndex, stemmer: str) -> DataFrame:
    """(term: a stem, df) of the whole index."""
    from . import stemming
    text = index.blocks.filter(F.col("kind") == TEXT).select("shard", "segment", F.col("term").alias("stem"), "ids")
    return stem_frequencies(index, stemming.stem_column(text, "stem", stemmer))


def query_stems(index: TextIndex, terms: DataFrame, stats: QueryStats) -> tuple[DataFrame, DataFrame]:
    """A query's stem stands for all terms of the dictionary that have it.  Returns
    these terms (term, stem) and the stems' frequencies (term, df)."""
    wanted = checked_broadcast(terms.select(F.col("term").alias("stem")).distinct(), bound=stats.terms)
    some = index.stems.join(wanted, "stem")
    text = index.blocks.filter(F.col("kind") == TEXT).join(F.broadcast(some) if stats.terms <= SHARD_DOCS else some, "term")
    return some, stem_frequencies(index, text.select("shard", "segment", "stem", "ids"))
