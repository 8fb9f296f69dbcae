"""Connected components by repeated contraction of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, comp) for every vertex of ``edges`` (columns a, b of type long);
    comp is the smallest id of its component.

    Each round maps every vertex to the first vertex of its closed
    neighbourhood and contracts the edges.  Rounds order vertices by id and by
    a fresh hash in turn: the first is quick on stars around a small id, the
    second shrinks any graph by a constant factor in expectation, so the number
    of rounds is logarithmic.  Loops and repeated edges are harmless; an empty
    edge list has no vertices.
    """
    def undirected(e: DataFrame) -> DataFrame:
        return (e.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                .distinct())

    e = stored(undirected(edges), "cc-edges")
    ids = e.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    labels, turn = ids.withColumn("comp", F.col("id")), 0
    while not e.isEmpty():
        both = e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = (lambda v: v) if turn % 2 == 0 else (lambda v, s=turn: F.xxhash64(v, F.lit(s)))
        place = lambda v: F.struct(rank(F.col(v)).alias("rank"), F.col(v).alias("v"))
        near = both.groupBy("a").agg(F.min(place("b")).alias("n"))
        near = stored(near.select(F.col("a").alias("v"), F.least("n", place("a"))["v"].alias("to")), "cc-near")
        labels = stored(labels.join(near, labels["comp"] == near["v"], "left")
                        .select("id", F.coalesce("to", "comp").alias("comp")), "cc-labels")
        e = stored(undirected(e.join(near.withColumnsRenamed({"v": "a", "to": "ta"}), "a")
                              .join(near.withColumnsRenamed({"v": "b", "to": "tb"}), "b")
                              .select(F.col("ta").alias("a"), F.col("tb").alias("b"))), "cc-edges")
        turn += 1
    low = labels.groupBy("comp").agg(F.min("id").alias("low"))
    return labels.join(low, "comp").select("id", F.col("low").alias("comp"))
