"""Repository references, discovery, incremental windows, upsert, run
summaries and integrity checks (SURVEY A7-A12, A14).

Upsert (A11) touches only the keys present in the batch: the batch's keys
are broadcast (size checked) into an anti-join that passes every untouched
target row through without a shuffle, and only the contested rows (target
rows with a batch key plus the batch) go through the latest-wins window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..plans.sizing import checked_broadcast

# --- fixed values that must equal the reference's ---------------------------
REPO_URL_RE = r"github\.com/([A-Za-z0-9._-]+)/([A-Za-z0-9._-]+?)(?:\.git)?/?$"
REPO_SHORT_RE = r"^([A-Za-z0-9._-]+)/([A-Za-z0-9._-]+?)(?:\.git)?$"
# -----------------------------------------------------------------------------


# ---- A7 ------------------------------------------------------------------------
def _clean_line(col: str = "line"):
    return F.regexp_replace(tx.py_strip(F.col(col)), "/+$", "")


def parse_repo_refs(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``lines`` (line_no, line) -> (repos(owner, repo, line_no),
    rejects(line_no, line)).  Lines are stripped and trailing '/' removed;
    blank and '#' lines are skipped; a host URL is searched first, then the
    owner/repo shorthand; the first occurrence of each repo is kept."""
    s = lines.select("line_no", "line", _clean_line().alias("s"))
    s = s.where((F.col("s") != "") & ~F.col("s").startswith("#"))
    url_hit = F.col("s").rlike(REPO_URL_RE)
    short_hit = F.col("s").rlike(REPO_SHORT_RE)
    owner = (F.when(url_hit, F.regexp_extract("s", REPO_URL_RE, 1))
             .when(short_hit, F.regexp_extract("s", REPO_SHORT_RE, 1)))
    repo = (F.when(url_hit, F.regexp_extract("s", REPO_URL_RE, 2))
            .when(short_hit, F.regexp_extract("s", REPO_SHORT_RE, 2)))
    m = s.select("line_no", "line", owner.alias("owner"), repo.alias("repo"))
    repos = (m.where(F.col("owner").isNotNull())
             .groupBy("owner", "repo").agg(F.min("line_no").alias("line_no")))
    rejects = m.where(F.col("owner").isNull()).select("line_no", "line")
    return repos, rejects


# ---- A8 / A9 ---------------------------------------------------------------------
def filter_repos(repos: DataFrame, substring: str | None, col: str = "repo") -> DataFrame:
    """Repos whose name contains ``substring`` (None keeps all)."""
    return repos if not substring else repos.where(F.col(col).contains(substring))


def discover_prs(prs: DataFrame, repo: str | None = None, author: str | None = None,
                 state: str = "all", cap: int | None = None) -> DataFrame:
    """PR numbers per repository, optionally by author, state open /
    closed / all; ``cap``: only so many per repository, newest numbers first.
    The cap is a top-k window (WindowGroupLimit, partial per task),
    so a repository holding a third of all PRs never lands whole in one task."""
    p = prs
    if repo:
        p = p.where(F.col("repo") == repo)
    if author:
        p = p.where(F.col("user_login") == author)
    if state in ("open", "closed"):
        p = p.where(F.col("state") == state)
    if cap is None:
        return p.select("repo", "number")
    w = Window.partitionBy("repo").orderBy(F.desc("number"))
    return (p.select("repo", "number", F.row_number().over(w).alias("_rn"))
            .where(F.col("_rn") <= cap).drop("_rn"))


# ---- A10 -----------------------------------------------------------------------
def incremental(rows: DataFrame, state: DataFrame | None, full: bool = False,
                n_repos: int | None = None) -> DataFrame:
    """A10: rows changed at or after their repository's watermark (a row of the
    watermark's own second may have landed later; the upsert is idempotent);
    repositories without state, and ``full`` mode, keep everything (Q23: the
    date filter runs in the job, not on the remote side)."""
    if full or state is None:
        return rows
    st = checked_broadcast(state.select("repo", "last_fetched_at"), bound=n_repos)
    j = rows.join(st, "repo", "left")
    return j.where(F.col("last_fetched_at").isNull() |
                   (F.col("updated_at") >= F.col("last_fetched_at"))).drop("last_fetched_at")


def advance_state(state: DataFrame | None, batch: DataFrame) -> DataFrame:
    """A10: new watermark per repository = greatest(old, max(updated_at)
    actually ingested) (Q6); last number = greatest(old, max number) (Q7).
    Repositories without new rows keep their state."""
    new = batch.groupBy("repo").agg(F.max("updated_at").alias("n_at"), F.max("number").alias("n_num"))
    if state is None:
        return new.select("repo", F.col("n_at").alias("last_fetched_at"),
                          F.col("n_num").alias("last_pr_number"))
    j = state.join(new, "repo", "full")
    return j.select("repo",
                    F.greatest("last_fetched_at", "n_at").alias("last_fetched_at"),
                    F.greatest("last_pr_number", "n_num").alias("last_pr_number"))


# ---- A11 -----------------------------------------------------------------------
def upsert(target: DataFrame, batch: DataFrame, keys: list[str], version: str | None = "updated_at",
           arrival: str | None = None, unique_keys: list[list[str]] | None = None,
           max_broadcast_keys: int = 2_000_000) -> DataFrame:
    """Latest row per key wins.  Order: ``version`` desc (Q22: a newer
    ``updated_at`` wins even if it arrived earlier), then batch over target,
    then ``arrival`` desc inside the batch.  ``version=None`` reproduces
    plain arrival order.  ``unique_keys`` are further unique constraints
    (PRs: (repo, number)) resolved the same way after the primary key.
    Idempotent: upserting the same batch twice gives the same table."""
    out = _upsert_one(target, batch, keys, version, arrival, max_broadcast_keys)
    for uk in unique_keys or []:
        # rows of the result that share a secondary key with a batch row
        touched = batch.select(*uk).distinct()
        contested = out.join(touched, uk, "left_semi")
        rest = out.join(touched, uk, "left_anti")
        b_ids = batch.select(*keys).distinct().withColumn("_src", F.lit(1))
        c = contested.join(b_ids, keys, "left").fillna({"_src": 0})
        order = ([F.col(version)] if version else []) + [F.col("_src")] + [F.col(k) for k in keys]
        out = rest.unionByName(_latest(c, uk, order, out.columns))
    return out.select(*target.columns)


def _latest(df: DataFrame, keys: list[str], order: list, cols: list[str]) -> DataFrame:
    """One row per key: the row with the largest ``order`` tuple (then the
    largest row).  A max over a struct is a grouped aggregate with partial
    aggregation, so a key holding a third of all rows is reduced map-side
    instead of being sorted in one task (as a window would)."""
    best = F.max(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)],
                          F.struct(*cols).alias("_row"))).alias("_best")
    return df.groupBy(*keys).agg(best).select("_best._row.*")


def _upsert_one(target, batch, keys, version, arrival, max_broadcast_keys):
    cols = target.columns
    b = batch.select(*cols, *([arrival] if arrival and arrival not in cols else []))
    bkeys = b.select(*keys).distinct()
    # untouched target rows pass through; the key side is broadcast when its
    # size is bounded (otherwise a shuffle anti-join)
    n_keys = bkeys.count()
    bk = checked_broadcast(bkeys, bound=n_keys)
    untouched = target.join(bk, keys, "left_anti")
    contested_t = target.join(bk, keys, "left_semi").withColumn("_src", F.lit(0))
    contested_b = b.withColumn("_src", F.lit(1))
    if arrival:
        contested_t = contested_t.withColumn(arrival, F.lit(None).cast(b.schema[arrival].dataType))
    both = contested_t.unionByName(contested_b, allowMissingColumns=True)
    # newest version wins (nulls lose), then batch over target, then arrival
    order = ([F.col(version)] if version else []) + [F.col("_src")]
    if arrival:
        order.append(F.col(arrival))
    winners = _latest(both, keys, order, cols)
    return untouched.select(*cols).unionByName(winners.select(*cols))


# ---- A12 -----------------------------------------------------------------------
def run_summary(prs: DataFrame, comments: DataFrame, reviews: DataFrame,
                observation: Observation | None = None) -> DataFrame:
    """Per repository and PR, the comment and review counts of a run;
    run totals (prs, comments, reviews, repos) arrive through
    ``observation`` while the per-PR rows are written."""
    p = prs.select("repo", F.col("number").alias("pr_number"))
    c = comments.groupBy("repo", "pr_number").agg(F.count(F.lit(1)).alias("comments"))
    r = reviews.groupBy("repo", "pr_number").agg(F.count(F.lit(1)).alias("reviews"))
    out = (p.join(c, ["repo", "pr_number"], "left").join(r, ["repo", "pr_number"], "left")
           .select("repo", "pr_number", F.coalesce("comments", F.lit(0)).cast("long").alias("comments"),
                   F.coalesce("reviews", F.lit(0)).cast("long").alias("reviews")))
    if observation is not None:
        out = out.observe(observation, F.count(F.lit(1)).alias("prs"),
                          F.sum("comments").alias("comments"), F.sum("reviews").alias("reviews"),
                          F.count_distinct("repo").alias("repos"))
    return out


# ---- A14 -----------------------------------------------------------------------
# fixed values that must equal the reference's: columns that may not be null
NOT_NULL = {
    "pull_requests": ["id", "repo", "number", "title", "user_login", "created_at", "updated_at", "html_url"],
    "reviews": ["id", "repo", "pr_number", "user_login", "state", "submitted_at"],
    "comments": ["id", "repo", "pr_number", "user_login", "body", "created_at", "updated_at", "html_url"],
    "comment_embeddings": ["comment_id", "embedding", "model", "created_at"],
    "comment_tags": ["comment_id", "tag_id"],
    "tags": ["id", "name"],
}


def _fk_violations(name: str, child: DataFrame, keys: list[str], parent: DataFrame) -> DataFrame:
    """Child rows whose key has no parent row.  The child side is counted
    per key first (partial aggregation), so a key holding a third of all
    rows reaches the anti-join as a single row."""
    per_key = child.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    orphans = per_key.join(parent.select(*keys).distinct(), keys, "left_anti")
    return orphans.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("violations")) \
        .select(F.lit(name).alias("check"), "violations")


def integrity_report(prs: DataFrame, reviews: DataFrame, comments: DataFrame,
                     embeddings: DataFrame, tags: DataFrame, comment_tags: DataFrame) -> DataFrame:
    """(check, violations) for every foreign key, NOT NULL column and
    key uniqueness the reference's DDL would enforce.  Each FK is a
    left_anti join on the key; NOT NULL counts are one aggregate per table."""
    tabs = {"pull_requests": prs, "reviews": reviews, "comments": comments,
            "comment_embeddings": embeddings, "comment_tags": comment_tags, "tags": tags}
    pk = prs.select(F.col("repo"), F.col("number").alias("pr_number"))
    cid = comments.select(F.col("id").alias("comment_id"))
    tid = tags.select(F.col("id").alias("tag_id"))
    checks = [
        ("fk:reviews(repo,pr_number)->pull_requests", reviews, ["repo", "pr_number"], pk),
        ("fk:comments(repo,pr_number)->pull_requests", comments, ["repo", "pr_number"], pk),
        ("fk:comment_embeddings(comment_id)->comments", embeddings, ["comment_id"], cid),
        ("fk:comment_tags(comment_id)->comments", comment_tags, ["comment_id"], cid),
        ("fk:comment_tags(tag_id)->tags", comment_tags, ["tag_id"], tid),
    ]
    out = [_fk_violations(n, child, keys, parent) for n, child, keys, parent in checks]
    for t, cols in NOT_NULL.items():
        df = tabs[t]
        agg = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
        out.append(agg.select(F.explode(F.array(*[
            F.struct(F.lit(f"not_null:{t}.{c}").alias("check"), F.col(c).cast("long").alias("violations"))
            for c in cols]))).select("col.*"))
    uniq = [("unique:pull_requests(id)", prs, ["id"]),
            ("unique:pull_requests(repo,number)", prs, ["repo", "number"]),
            ("unique:reviews(id)", reviews, ["id"]), ("unique:comments(id)", comments, ["id"]),
            ("unique:comment_embeddings(comment_id)", embeddings, ["comment_id"]),
            ("unique:comment_tags(comment_id,tag_id)", comment_tags, ["comment_id", "tag_id"]),
            ("unique:tags(name)", tags, ["name"])]
    for n, df, ks in uniq:
        dup = df.groupBy(*ks).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        out.append(dup.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("violations"))
                   .select(F.lit(n).alias("check"), "violations"))
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res
