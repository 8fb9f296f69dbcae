"""Views of the knowledge-base tables over the driver's test tables
(FIXTURES 3).  The same definitions exist as DuckDB SQL in
``commentlake.plans.oracle`` so both engines see identical inputs.

Everything here is lazy: a ``Tables`` object only builds DataFrames; the
parquet scans get column pruning and filter pushdown from Catalyst.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tagging
from ..plans.sizing import checked_broadcast
from . import fixture_rules

# parameters of the derived fixtures
N_PR_BUCKETS = 50            # pr_number = doc_id % 50
N_REPOS = 20                 # repo = 'src' || custkey % 20
STATE_WATERMARK = "1998-06-30 00:00:00"
STATE_LAST_NUMBER = 100
LITERAL_REPO_LINES = [(-4, ""), (-3, "# note"), (-2, "owner/repo"),
                      (-1, "https://github.com/o/r.git/")]
QUERY_LIMIT = 15
PART_IDS = 250               # ids of a part of the stored comments
WIDE_LIMITS = (5, 15, 40, 150, 400)     # limit of query item_id: the (item_id mod 5)th


def _ntz(s: str):
    return F.to_timestamp_ntz(F.lit(s))


def url_path(url):
    """URL without scheme, query and fragment."""
    no_scheme = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    return F.regexp_replace(no_scheme, r"[?#].*$", "")


class Tables:
    """Lazy DataFrames for one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def stored(self, name: str, build) -> DataFrame:
        """A knowledge-base table written once to the shared checkpoint
        folder and read back (cuts lineage; later jobs scan parquet)."""
        key = f"_stored_{name}"
        if key not in self.__dict__:
            from ..session import scratch_path, shuffles_freed
            path = scratch_path(self.spark, f"kb-{name}")
            with shuffles_freed(self.spark):
                build().write.mode("overwrite").parquet(path)
            self.__dict__[key] = self.spark.read.parquet(path)
        return self.__dict__[key]

    def stored_index(self, stemmer=None):
        """F2 index bucketed by document range, with the tag bitmaps."""
        key = f"_stored_index_{stemmer}"
        if key not in self.__dict__:
            from ..operators import postings
            from ..session import scratch_path
            index = postings.write_index(self.kb_comments, scratch_path(self.spark, "kb-index"), stemmer=stemmer)
            self.__dict__[key] = postings.with_tags(index, self.kb_comment_tags)
        return self.__dict__[key]

    def kb_comments_table(self):
        """The stored comments as a table that batches are merged into."""
        from .store import KeyedTable
        if "_kb_comments_table" not in self.__dict__:
            from ..session import scratch_path
            table = KeyedTable.create(self.spark, scratch_path(self.spark, "kb-comments"), self.comments.schema, ["id"],
                                      span=PART_IDS)
            table.upsert(self.comments)
            self.__dict__["_kb_comments_table"] = table.path
            self.__dict__["_kb_comments"] = table.read()
        return KeyedTable.open(self.spark, self.__dict__["_kb_comments_table"])

    @property
    def kb_comments(self) -> DataFrame:
        """Its first version, which later batches leave as it is."""
        self.kb_comments_table()
        return self.__dict__["_kb_comments"]

    @property
    def kb_tags(self) -> DataFrame:
        return self.stored("tags", lambda: self.tags)

    @property
    def kb_comment_tags(self) -> DataFrame:
        """D5 over the stored comments (same rows as ``comment_tags``)."""
        def build():
            _, ct = tagging.retag_all(self.kb_comments, None, fixture_rules.TEST_RULES)
            return ct
        return self.stored("comment_tags", build)

    # ---- comments / PRs / reviews -------------------------------------------
    @cached_property
    def comments(self) -> DataFrame:
        d = self.raw("documents").select("doc_id", "text", "source")
        e = self.raw("events").select(F.col("event_id").alias("doc_id"), "ts", "user_id")
        p = self.raw("pages").select("page_id", "url")
        n_pages = p.select(F.count(F.lit(1))).scalar()
        # the few URLs go to the texts where their size allows, so texts are shuffled once
        j = (d.join(e, "doc_id")
             .withColumn("page_id", F.col("doc_id") % n_pages)
             .join(checked_broadcast(p), "page_id", "left"))
        stripped = url_path(F.col("url"))
        k7 = F.col("doc_id") % 7
        line = F.nullif(F.col("doc_id") % 11, F.lit(0))
        pr = F.col("doc_id") % N_PR_BUCKETS
        return j.select(
            F.col("doc_id").alias("id"),
            F.col("source").alias("repo"),
            pr.alias("pr_number"),
            F.lit(None).cast("long").alias("review_id"),
            F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("user_login"),
            F.col("text").alias("body"),
            F.when(k7 == 0, F.lit(None).cast("string"))
             .when(k7 == 1, F.regexp_extract(stripped, "[^/]*$", 0))
             .otherwise(stripped).alias("path"),
            line.alias("line"),
            line.alias("original_line"),
            F.lit("RIGHT").alias("side"),
            F.when(F.col("doc_id") % 3 == 0, F.col("text")).alias("diff_hunk"),
            F.lit(None).cast("string").alias("commit_id"),
            F.lit("CONTRIBUTOR").alias("author_association"),
            F.lit(None).cast("long").alias("in_reply_to_id"),
            F.col("ts").alias("created_at"),
            F.col("ts").alias("updated_at"),
            F.concat(F.lit("https://host.test/"), F.col("source"), F.lit("/pull/"),
                     pr.cast("string"), F.lit("#r"), F.col("doc_id").cast("string")).alias("html_url"),
        )

    @cached_property
    def prs(self) -> DataFrame:
        o = self.raw("orders")
        repo = F.concat(F.lit("src"), (F.col("o_custkey") % N_REPOS).cast("string"))
        return o.select(
            F.col("o_orderkey").alias("id"),
            repo.alias("repo"),
            F.col("o_orderkey").alias("number"),
            F.col("o_orderpriority").alias("title"),
            F.concat(F.lit("user"), F.col("o_custkey").cast("string")).alias("user_login"),
            F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("merged_at"),
            F.col("o_orderdate").alias("created_at"),
            F.col("o_orderdate").alias("updated_at"),
            F.concat(F.lit("https://host.test/"), repo, F.lit("/pull/"),
                     F.col("o_orderkey").cast("string")).alias("html_url"),
            F.when(F.col("o_orderstatus") == "O", F.lit("open")).otherwise(F.lit("closed")).alias("state"),
        )

    @cached_property
    def reviews(self) -> DataFrame:
        c = self.raw("conversations")
        t3 = F.col("turn") % 3
        return c.select(
            (F.col("conv_id") * 100 + F.col("turn")).alias("id"),
            F.concat(F.lit("src"), (F.col("conv_id") % N_REPOS).cast("string")).alias("repo"),
            F.col("conv_id").alias("pr_number"),
            F.col("role").alias("user_login"),
            F.when(t3 == 0, "APPROVED").when(t3 == 1, "CHANGES_REQUESTED")
             .otherwise("COMMENTED").alias("state"),
            F.col("text").alias("body"),
            F.make_timestamp_ntz(F.lit(2024), F.lit(1), (F.col("conv_id") % 28 + 1).cast("int"),
                                 (F.col("turn") % 24).cast("int"), F.lit(0), F.lit(0)).alias("submitted_at"),
        )

    @cached_property
    def embeddings(self) -> DataFrame:
        return self.raw("embeddings").select(
            F.col("vec_id").alias("comment_id"), "embedding",
            F.lit("fixture-64d").alias("model"), _ntz("2024-02-01 00:00:00").alias("created_at"))

    # ---- tags ----------------------------------------------------------------
    @cached_property
    def tags(self) -> DataFrame:
        """D1 over an empty tag table: ids 1..n in rule order."""
        return tagging.seed_tags(None, fixture_rules.TEST_RULES, self.spark)

    @cached_property
    def comment_tags(self) -> DataFrame:
        """D5 (retag all) of the comments with the test rule set."""
        _, ct = tagging.retag_all(self.comments, None, fixture_rules.TEST_RULES)
        return ct

    # ---- search inputs -------------------------------------------------------
    @cached_property
    def queries(self) -> DataFrame:
        """benchmark texts as PR titles; every third query carries two tags;
        the query vector is the fixture embedding with vec_id = item_id."""
        names = [n for n, _ in tagging.rule_tags(fixture_rules.TEST_RULES)]
        arr = F.array(*[F.lit(n) for n in names])
        k = F.expr("item_id div 3")
        tags = F.when(F.col("item_id") % 3 == 0, F.array(
            F.element_at(arr, (k % len(names) + 1).cast("int")),
            F.element_at(arr, ((k + 1) % len(names) + 1).cast("int"))))
        b = self.raw("benchmark")
        v = self.raw("embeddings").select(F.col("vec_id").alias("item_id"),
                                          F.col("embedding").alias("qvec"))
        return b.join(v, "item_id", "left").select(
            F.col("item_id").alias("query_id"),
            F.col("text").alias("title"),
            F.lit(None).cast("array<string>").alias("paths"),
            F.lit(None).cast("string").alias("diff"),
            F.lit(None).cast("array<string>").alias("commits"),
            tags.alias("tags"),
            F.lit(QUERY_LIMIT).alias("limit"),
            "qvec",
        )

    @cached_property
    def wide_queries(self) -> DataFrame:
        """The queries with small and large limits."""
        limits = F.array(*map(F.lit, WIDE_LIMITS))
        return self.queries.withColumn("limit", F.get(limits, (F.col("query_id") % len(WIDE_LIMITS)).cast("int")))

    # ---- findings ------------------------------------------------------------
    @cached_property
    def findings(self) -> DataFrame:
        li = self.raw("lineitem")
        sev = (F.when(F.col("l_returnflag") == "A", "P0")
               .when(F.col("l_returnflag") == "N", "P1").otherwise("P2"))
        issue = F.concat(F.lit("check "),
                         F.when(F.col("l_linestatus") == "O", "open handle").otherwise("unused import"),
                         F.lit(" in part "), (F.col("l_partkey") % 5).cast("string"))
        return li.select(_file(F.col("l_orderkey")).alias("file"),
                         F.col("l_linenumber").cast("long").alias("line"),
                         issue.alias("issue"), sev.alias("severity"))

    @cached_property
    def changed_files(self) -> DataFrame:
        return self.raw("orders").select(_file(F.col("o_orderkey")).alias("file"))

    # ---- ingest inputs -------------------------------------------------------
    @cached_property
    def batch(self) -> DataFrame:
        c = self.comments
        return (c.where(F.col("id") % 5 == 0)
                .withColumn("body", F.concat(F.lit("[edited] "), F.col("body")))
                .withColumn("updated_at", F.col("updated_at") + F.expr("INTERVAL 1 DAY")))

    @cached_property
    def fetch_state(self) -> DataFrame:
        repos = self.prs.select("repo").distinct()
        idx = F.regexp_extract("repo", r"(\d+)$", 1).cast("long")
        return repos.where(idx % 2 == 0).select(
            "repo", _ntz(STATE_WATERMARK).alias("last_fetched_at"),
            F.lit(STATE_LAST_NUMBER).cast("long").alias("last_pr_number"))

    @cached_property
    def repo_lines(self) -> DataFrame:
        p = self.raw("pages")
        host = F.regexp_extract("url", r"^[A-Za-z]+://([^/?#]+)", 1)
        seg = F.regexp_extract("url", r"^[A-Za-z]+://[^/?#]+/([^/?#]*)", 1)
        lines = p.select(F.col("page_id").alias("line_no"),
                         F.when(F.col("page_id") % 2 == 0, F.concat(host, F.lit("/"), seg))
                          .otherwise(F.col("url")).alias("line"))
        lit = self.spark.createDataFrame(LITERAL_REPO_LINES, "line_no long, line string")
        return lines.unionByName(lit)


def _file(key):
    return F.concat(F.lit("mod"), (key % 50).cast("string"), F.lit("/file"),
                    key.cast("string"), F.lit(".py"))


_CACHE: dict = {}


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    key = (id(spark), sf_dir.rstrip("/"))
    t = _CACHE.get(key)
    if t is None or t.spark is not spark:
        t = _CACHE[key] = Tables(spark, sf_dir)
    return t
