"""Mixing sources to target weights with nested hash thresholds.

Each document has a 60-bit hash.  Sizes are summed by source and by the leading
12 bits of the hash; the running sum finds the bucket in which a source's
budget ends, and only the documents of that bucket are summed again by the next
12 bits, and so on, until the budget ends between two hashes.  A document below
its source's threshold is taken: no sort of documents, and a larger budget
takes a superset.  A budget of more than the source itself takes whole rounds
of every document first, the rest by threshold.

Words are runs of anything but space and \\t to \\r.  Defined results: a null
or blank text has size 0 and takes 0; a null source is a source, the last;
documents of one doc_id share a hash and stand or fall together; an empty table
gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, stored, table

WORD = r"[^\x20\x09-\x0D]+"
CAP = 3
LEVELS, BITS = 5, 12


def order_hash(doc_id: Column) -> Column:
    """60 bits of md5(doc_id as text)."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def cyclic_weights(names: DataFrame) -> DataFrame:
    """Weights 1, 2, 3, 1, 2, 3, ... by code point of the source, null last.
    Reads one row per source."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    return names.withColumn("weight", ((place - 1) % 3 + 1).cast("long"))


def targets(sources: DataFrame, cap: int = CAP) -> DataFrame:
    """(source, source_size, weight) with target: the total of all sizes shared
    by weight, none above ``cap`` times its source's size; what is cut off goes
    to the others by weight.  A target is pool * weight / weights, one product
    and one quotient, so that any engine gets the same double."""
    sources = stored(sources.withColumn("full", F.lit(False)), "mix-sources")
    while True:
        s = sources.agg(F.sum("source_size").alias("all"),
                        F.sum(F.when(F.col("full"), cap * F.col("source_size")).otherwise(F.lit(0))).alias("fixed"),
                        F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(F.lit(0))).alias("weights")).first()
        pool, weights = (s["all"] or 0) - (s["fixed"] or 0), s["weights"] or 0
        share = (F.lit(pool).cast("double") * F.col("weight") / F.lit(weights).cast("double")) if weights else F.lit(0.0)
        now = sources.withColumn("share", share)
        over = ~F.col("full") & (F.col("share") > cap * F.col("source_size"))
        if not weights or now.filter(over).isEmpty():
            exact = F.when(F.col("full"), (cap * F.col("source_size")).cast("double")).otherwise(F.col("share"))
            return now.select("source", "source_size", "weight", exact.alias("target"))
        sources = stored(now.withColumn("full", F.col("full") | over).drop("share"), "mix-sources")


def thresholds(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """``plan`` with rounds (whole copies of every document) and bound: a
    document is taken once more if its hash is below bound.  The words below
    bound are, of the sums that end between two hashes, the nearest to the
    rest of the target."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = plan.withColumn("rounds", whole.cast("long")).withColumn("s", source_key(F.col("source")))
    plan = stored(plan.withColumn("rest", F.col("target") - F.col("rounds") * F.col("source_size")), "mix-plan")
    # a source is open while its budget ends in a bucket (of prefix ``at``, after
    # ``below`` words of lower hashes) of more than one document
    zero = F.lit(0).cast("long")
    open_ = plan.filter("rest > 0").select("s", "rest", zero.alias("at"), zero.alias("below"))
    rows, closed = sizes.filter("size > 0").select("s", "h", "size"), []
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        if level > 1:
            inside = rows.join(open_.select("s", "at"), "s").filter(F.shiftright("h", shift + BITS) == F.col("at"))
            rows = stored(inside.select("s", "h", "size"), "mix-boundary")
        hist = rows.groupBy("s", F.shiftright("h", shift).alias("at")).agg(F.sum("size").alias("n"), F.count("*").alias("docs"))
        before = F.sum("n").over(Window.partitionBy("s").orderBy("at")) - F.col("n")
        run = (hist.withColumn("before", before).join(open_.select("s", "rest", "below"), "s")
               .withColumn("begin", F.col("below") + F.col("before")))
        edge = stored(run.filter((F.col("begin") < F.col("rest")) & (F.col("begin") + F.col("n") >= F.col("rest")))
                      .select("s", "rest", "at", F.col("begin").alias("below"), "n", "docs"), "mix-edge")
        after = F.col("below") + F.col("n") - F.col("rest") <= F.col("rest") - F.col("below")
        final = F.lit(True) if level == LEVELS else F.col("docs") == 1
        closed.append(edge.filter(final).select(
            "s", F.shiftleft(F.when(after, F.col("at") + 1).otherwise(F.col("at")), shift).alias("bound")))
        open_ = edge.filter(~final).select("s", "rest", "at", "below")
        if level == LEVELS or open_.isEmpty():
            break
    bounds = closed[0]
    for c in closed[1:]:
        bounds = bounds.unionAll(c)
    return stored(plan.join(bounds, "s", "left").withColumn("bound", F.coalesce("bound", zero)), "mix-bounds")


def source_key(source: Column) -> Column:
    """A key that is never null: null and every text differ."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_plan(docs: DataFrame, weights: Callable[[DataFrame], DataFrame] = cyclic_weights,
             cap: int = CAP) -> tuple[DataFrame, DataFrame]:
    """The narrow table of documents (doc_id, source, size, hash h, key s) and
    the plan, one row per source with its target, rounds and bound."""
    sizes = stored(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"),
                               order_hash(F.col("doc_id")).alias("h"), source_key(F.col("source")).alias("s")),
                   "mix-sizes")
    sources = weights(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    return sizes, thresholds(sizes, targets(sources, cap))


def copies(h: Column) -> Column:
    return (F.col("rounds") + F.when(h < F.col("bound"), 1).otherwise(0)).cast("long")


def mix(docs: DataFrame, weights: Callable[[DataFrame], DataFrame] = cyclic_weights, cap: int = CAP) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every row
    of ``docs``.  ``weights`` adds a column weight to (source, source_size)."""
    sizes, plan = mix_plan(docs, weights, cap)
    return (sizes.join(plan.select("s", "source_size", "target", "rounds", "bound"), "s")
            .withColumn("copies", copies(F.col("h")))
            .select("doc_id", "source", "size", "source_size", "target", "copies",
                    (F.col("copies") * F.col("size")).alias("taken")))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: The same mix by sorting each source by hash.
OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source),
r AS (
  SELECT *, sum(source_size) OVER () AS total,
         coalesce(sum(3 * source_size) OVER o, 0) AS fixed, sum(weight) OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST
             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM s WINDOW o AS (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, (total - fixed)::DOUBLE * weight::DOUBLE / weights::DOUBLE > 3 * source_size AS is_full FROM r),
p AS (
  SELECT *, (total - sum(CASE WHEN is_full THEN 3 * source_size ELSE 0 END) OVER ())::DOUBLE AS pool,
         (sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ())::DOUBLE AS open_weight FROM f),
t AS (
  SELECT source, source_size,
         CASE WHEN is_full THEN (3 * source_size)::DOUBLE ELSE pool * weight::DOUBLE / open_weight END AS target FROM p),
u AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS rounds FROM t),
g AS (SELECT source, h, sum(size) AS n FROM d WHERE size > 0 GROUP BY source, h),
c AS (SELECT source, h, n, sum(n) OVER (PARTITION BY source ORDER BY h) - n AS below FROM g),
e AS (
  SELECT c.source, CASE WHEN below + n - (target - rounds * source_size) <= target - rounds * source_size - below
                        THEN h + 1 ELSE h END AS bound
  FROM c JOIN u ON c.source IS NOT DISTINCT FROM u.source
  WHERE below < target - rounds * source_size AND below + n >= target - rounds * source_size)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, u.source_size, u.target,
       CAST((u.rounds + CASE WHEN d.h < coalesce(e.bound, 0) THEN 1 ELSE 0 END) * d.size AS BIGINT) AS taken
FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source
LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as many times as the mix takes it.  Texts
    meet the stored plan (a row per source) only; they are not sorted."""
    columns = docs.columns
    _, plan = mix_plan(docs)
    key, n = fresh("_source", columns), fresh("_copies", columns)
    plan = plan.select(F.col("s").alias(key), F.struct("rounds", "bound").alias(n))
    taken = F.col(n)["rounds"] + F.when(order_hash(F.col("doc_id")) < F.col(n)["bound"], 1).otherwise(0)
    out = docs.withColumn(key, source_key(F.col("source"))).join(plan, key).withColumn(n, taken.cast("int")).filter(F.col(n) > 0)
    return out.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).drop(n, key)
