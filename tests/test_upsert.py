"""Repo refs, incremental state, upsert properties."""

import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st

from commentlake.operators import upsert as U

SCHEMA = "id long, repo string, number long, body string, updated_at timestamp_ntz"


def _d(day):
    return dt.datetime(2024, 1, day)


def test_repo_refs(spark):
    lines = spark.createDataFrame([(1, "https://github.com/o/r.git/"), (2, "o/r"), (3, "# x"), (4, "bad"),
                                   (5, "  "), (6, "https://github.com/a/b"), (7, "a/b.git")],
                                  "line_no long, line string")
    repos, rejects = U.parse_repo_refs(lines)
    assert sorted(map(tuple, repos.collect())) == [("a", "b", 6), ("o", "r", 1)]
    assert [tuple(r) for r in rejects.collect()] == [(4, "bad")]


def test_incremental_and_state(spark):
    rows = spark.createDataFrame([(1, "x", 5, "", _d(5)), (2, "x", 6, "", _d(12)), (3, "y", 7, "", _d(1)),
                                  (4, "x", 8, "", _d(10))], SCHEMA)
    state = spark.createDataFrame([("x", _d(10), 9)], "repo string, last_fetched_at timestamp_ntz, last_pr_number long")
    inc = U.incremental(rows, state)
    assert sorted(r.id for r in inc.collect()) == [2, 3, 4]      # 4: the second of the watermark
    st2 = {r.repo: (r.last_fetched_at, r.last_pr_number) for r in U.advance_state(state, inc).collect()}
    assert st2 == {"x": (_d(12), 9), "y": (_d(1), 7)}
    empty = rows.where("id < 0")
    st3 = {r.repo: (r.last_fetched_at, r.last_pr_number) for r in U.advance_state(state, empty).collect()}
    assert st3 == {"x": (_d(10), 9)}      # a run without PRs keeps the number (Q7)


def _brute(target, batch):
    cur = {r[0]: (r, 0) for r in target}
    for i, r in enumerate(batch):
        old = cur.get(r[0])
        if old is None or (r[4], 1, i) >= (old[0][4], old[1], -1):
            cur[r[0]] = (r, 1)
    return sorted(v[0] for v in cur.values())


rows_st = st.lists(st.tuples(st.integers(1, 6), st.integers(1, 5)), max_size=8)


@settings(max_examples=15, deadline=None)
@given(rows_st, rows_st)
def test_upsert_matches_brute_force_and_is_idempotent(spark, t, b):
    target = [(i, "r", i, f"t{d}", _d(d)) for i, d in dict(t).items()]
    batch = [(i, "r", i, f"b{d}", _d(d)) for i, d in dict(b).items()]
    tdf = spark.createDataFrame(target, SCHEMA)
    bdf = spark.createDataFrame(batch, SCHEMA)
    once = U.upsert(tdf, bdf, ["id"])
    got = sorted(tuple(r) for r in once.collect())
    assert got == _brute(target, batch)
    twice = sorted(tuple(r) for r in U.upsert(once, bdf, ["id"]).collect())
    assert twice == got


def test_upsert_secondary_unique_key(spark):
    t = spark.createDataFrame([(1, "r", 7, "old", _d(1)), (2, "r", 8, "keep", _d(1))], SCHEMA)
    b = spark.createDataFrame([(3, "r", 7, "new", _d(2))], SCHEMA)
    got = sorted(tuple(r)[:4] for r in U.upsert(t, b, ["id"], unique_keys=[["repo", "number"]]).collect())
    assert got == [(2, "r", 8, "keep"), (3, "r", 7, "new")]


def test_integrity_counts_orphans_per_row(spark):
    prs = spark.createDataFrame([(1, "r", 1, "t", "u", None, _d(1), _d(1), "h")],
                                "id long, repo string, number long, title string, user_login string, "
                                "merged_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz, html_url string")
    comments = spark.createDataFrame([(i, "r", 1 if i < 3 else 9, "u", "b", _d(1), _d(1), "h") for i in range(50)],
                                     "id long, repo string, pr_number long, user_login string, body string, "
                                     "created_at timestamp_ntz, updated_at timestamp_ntz, html_url string")
    reviews = spark.createDataFrame([], "id long, repo string, pr_number long, user_login string, state string, "
                                        "submitted_at timestamp_ntz")
    emb = spark.createDataFrame([(99, [1.0], "m", _d(1))], "comment_id long, embedding array<float>, model string, "
                                                           "created_at timestamp_ntz")
    tags = spark.createDataFrame([(1, "a")], "id long, name string")
    ct = spark.createDataFrame([(1, 1, 1.0), (1, 2, 1.0), (1, 2, 1.0)], "comment_id long, tag_id long, confidence double")
    rep = {r.check: r.violations for r in U.integrity_report(prs, reviews, comments, emb, tags, ct).collect()}
    assert rep["fk:comments(repo,pr_number)->pull_requests"] == 47      # one hot orphan key, counted per row
    assert rep["fk:comment_embeddings(comment_id)->comments"] == 1
    assert rep["fk:comment_tags(tag_id)->tags"] == 2
    assert rep["unique:comment_tags(comment_id,tag_id)"] == 1
    assert rep["not_null:pull_requests.title"] == 0
