"""Anti-joins and collection statistics.

All are single-pass aggregates with map-side partial aggregation; none
collects rows to the driver or into one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


TOP_REVIEWERS = 10   # fixed value: reviewers listed by the stats report


def unembedded(comments: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Comments with no stored vector (LEFT ANTI JOIN)."""
    return comments.join(embeddings.select(F.col("comment_id").alias("id")), "id", "left_anti")


def untagged(comments: DataFrame, comment_tags: DataFrame) -> DataFrame:
    """Comments with no tag assignment."""
    return comments.join(comment_tags.select(F.col("comment_id").alias("id")), "id", "left_anti")


def tags_with_counts(tags: DataFrame, comment_tags: DataFrame) -> DataFrame:
    """Every tag with its number of assignments (zero included),
    ordered by count desc then name.  Counts are pre-aggregated per tag_id
    before the join, so the join sees one row per tag."""
    counts = comment_tags.groupBy("tag_id").agg(F.count(F.lit(1)).alias("count"))
    t = tags.select(F.col("id").alias("tag_id"), "name", "description")
    return (t.join(counts, "tag_id", "left")
            .select("name", "description", F.coalesce("count", F.lit(0)).cast("long").alias("count"))
            .orderBy(F.desc("count"), "name"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows) for each named table."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def count_by(df: DataFrame, key: str) -> DataFrame:
    """Rows per key."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("count"))


def prs_by_repo(prs: DataFrame) -> DataFrame:
    return count_by(prs, "repo")


def comments_by_repo(comments: DataFrame) -> DataFrame:
    return count_by(comments, "repo")


def top_reviewers(comments: DataFrame, n: int = TOP_REVIEWERS) -> DataFrame:
    """The n most frequent comment authors (TakeOrderedAndProject)."""
    return (count_by(comments, "user_login")
            .orderBy(F.desc("count"), "user_login").limit(n))


def date_range(comments: DataFrame) -> DataFrame:
    """E5: oldest and newest comment creation time."""
    return comments.agg(F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"))


def kb_stats(prs: DataFrame, reviews: DataFrame, comments: DataFrame,
             embeddings: DataFrame, comment_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """Every statistic of E1-E5 as rows (section, key, count, time):
    sections total, date (oldest, newest), prs_by_repo, comments_by_repo and
    top_reviewers.  However many repositories there are, none is gathered.

    All figures of ``comments`` come from one grouped aggregate by (repo,
    user_login), whose exchange the branches share.  ``tagged_assignments`` is
    the reference's "tagged" figure (number of assignments, Q11);
    ``tagged_comments`` counts distinct comments.
    """
    no_time = F.lit(None).cast(comments.schema["created_at"].dataType).alias("time")
    per = (comments.groupBy("repo", "user_login")
           .agg(F.count(F.lit(1)).alias("n"), F.min("created_at").alias("lo"),
                F.max("created_at").alias("hi")))

    def section(name, df, key, n="n"):
        return df.select(F.lit(name).alias("section"), F.col(key).alias("key"),
                         F.col(n).cast("long").alias("count"), no_time)

    def total(name, df, n=None):
        n = F.count(F.lit(1)) if n is None else n
        return section("total", df.agg(n.alias("n")).withColumn("key", F.lit(name)), "key")
    dates = per.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select(F.explode(F.array(
        F.struct(F.lit("oldest").alias("key"), F.col("lo").alias("time")),
        F.struct(F.lit("newest").alias("key"), F.col("hi").alias("time")))).alias("d"))
    top = (per.groupBy("user_login").agg(F.sum("n").alias("n"))
           .orderBy(F.desc("n"), "user_login").limit(TOP_REVIEWERS))
    parts = [total("pull_requests", prs), total("reviews", reviews),
             total("comments", per, F.coalesce(F.sum("n"), F.lit(0))),
             total("comment_embeddings", embeddings), total("tagged_assignments", comment_tags),
             total("tagged_comments", comment_tags, F.count_distinct("comment_id")), total("tags", tags),
             dates.select(F.lit("date").alias("section"), "d.key", F.lit(None).cast("long").alias("count"), "d.time"),
             section("prs_by_repo", count_by(prs, "repo"), "repo", "count"),
             section("comments_by_repo", per.groupBy("repo").agg(F.sum("n").alias("n")), "repo"),
             section("top_reviewers", top, "user_login")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
