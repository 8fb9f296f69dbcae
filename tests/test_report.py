"""G1-G7 against the plain-Python template rules."""

import collections
import datetime as dt
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from commentlake.operators import report as R

HITS = "query_id long, rank int, id long, user_login string, created_at timestamp_ntz, path string, " \
       "line long, body string, diff_hunk string, tags array<string>"


def _hits(spark, rows):
    return spark.createDataFrame(rows, HITS)


def test_report_text(spark):
    t = dt.datetime(2024, 3, 4, 5, 6, 7)
    rows = [(1, i + 1, 100 + i, f"u{i % 3}", t, p, ln, b, None, tg) for i, (p, ln, b, tg) in enumerate([
        ("a/b/x.py", 3, "a b c", ["x"]), ("a/b/y.py", 0, "a b c", []), ("z.py", None, "zz top", ["p", "q"]),
        (None, 5, "no path here", [])])]
    (row,) = R.render_report(_hits(spark, rows)).collect()
    assert row.n_hits == 4
    assert row.report == "\n".join([
        "Found 4 relevant review comments across 3 locations.\n",
        "--- General ---\n", "  [u2 2024-03-04]  z.py", "  zz top", "  tags: p, q", "",
        "--- a/b ---\n", "  [u0 2024-03-04]  a/b/x.py:3", "  a b c", "  tags: x", "",
        "--- general ---\n", "  [u0 2024-03-04]", "  no path here", ""])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c", "d", "e"]), max_size=5), min_size=1, max_size=8))
def test_greedy_dedup_keeps_one_of_each_kind(spark, word_lists):
    bodies = [" ".join(w) for w in word_lists]
    t = dt.datetime(2024, 1, 1)
    rows = [(1, i + 1, i, "u", t, "d/f.py", 1, b, None, []) for i, b in enumerate(bodies)]
    g = R.greedy_dedup(R.group_by_dir(R.cap(_hits(spark, rows)))).collect()
    kept = [m.body for m in g[0].members]

    def alike(a, b):
        x, y = set(a.split()), set(b.split())
        return bool(x and y) and len(x & y) / len(x | y) >= 0.7

    assert not any(alike(a, b) for i, a in enumerate(kept) for b in kept[:i])
    assert all(b in kept or any(alike(a, b) for a in kept) for b in bodies) and kept[0] == bodies[0]


def test_empty_and_context(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, 1, 7, "u", t, "a/x.py", 2, "body text", "h1\nh2", [])]
    q = spark.createDataFrame([(1,), (2,)], "query_id long")
    e = {r.query_id: r.message for r in R.empty_results(q, _hits(spark, rows)).collect()}
    assert e == {1: None, 2: "No conventions found."}
    rep = {r.query_id: r.report for r in R.render_report(_hits(spark, rows), q).collect()}
    assert rep[2] == "No conventions found."
    ctx = R.prompt_context(_hits(spark, rows)).collect()[0].context
    assert ctx == ("Comment #1 by u on 2024-01-01:\n  File: a/x.py\n  Review: body text\n"
                   "  Code context: h1\nh2\n")


def test_conventions_clusters(spark):
    base = "the quick brown fox jumps over the lazy dog near the river bank today"
    rows = [(1, base, "a/x.py"), (2, base + " again", "a/y.py"), (3, base, "b/z.py"),
            (4, "completely different words entirely here", None), (5, "", None)]
    c = spark.createDataFrame(rows, "id long, body string, path string").select(
        "*", F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")).alias("created_at"),
        F.to_timestamp_ntz(F.lit("2024-01-02 00:00:00")).alias("updated_at"))
    conv, src = R.mine_conventions(c)
    members = sorted(r.comment_id for r in src.collect())
    assert members == [1, 2, 3]
    (row,) = conv.collect()
    assert row.source_count == 3 and row.id == 1 and row.file_patterns[0] == "a"


def test_conventions_are_the_exact_components(spark):
    """Pairs alike to each other but not to the smallest id of a bucket, and
    pairs of exactly 0.7, against components of all pairs."""
    rnd, rows = random.Random(4), []
    hot = [f"hot{k}" for k in range(12)]
    for g in range(40):                 # a shared phrase, a topic, and copies that differ by a word or two
        topic = hot + [f"t{g}w{k}" for k in range(9)]
        for c in range(5):
            words = topic + [f"x{g}y{c}z{k}" for k in range(rnd.randint(0, 5))]
            rows.append((len(rows) + 1, " ".join(words)))
    for g in range(300):                # 7 of 10 words: similarity 0.7
        both = [f"p{g}w{k}" for k in range(7)]
        rows.append((len(rows) + 1, " ".join(both)))
        rows.append((len(rows) + 1, " ".join(both + [f"p{g}e{k}" for k in range(3)])))
    rows = [(i, b) for (i, _), (_, b) in zip(rows, rnd.sample(rows, len(rows)), strict=True)]
    sets, comp = {i: set(b.split()) for i, b in rows}, {i: i for i, _ in rows}
    for a in sets:
        for b in sets:
            if a < b and comp[a] != comp[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.7:
                x, y = comp[a], comp[b]
                comp = {i: min(x, y) if v in (x, y) else v for i, v in comp.items()}
    size = collections.Counter(comp.values())
    c = spark.createDataFrame(rows, "id long, body string").select(
        "*", F.lit("a/x.py").alias("path"), F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")).alias("created_at"),
        F.to_timestamp_ntz(F.lit("2024-01-02 00:00:00")).alias("updated_at"))
    _, src = R.mine_conventions(c)
    assert {r.comment_id: r.convention_id for r in src.collect()} == {i: v for i, v in comp.items() if size[v] > 1}


def test_bit_maps_drop_no_similar_pair(spark):
    """The filter keeps every pair at the threshold, and drops unlike ones before their
    words are sent anywhere."""
    rnd, rows, unlike = random.Random(7), [], 0
    for g in range(120):
        n = rnd.choice([1, 2, 10, 40, 300])
        fresh = lambda k: [rnd.randrange(-2**62, 2**62) for _ in range(k)]
        words = fresh(n)
        other = words[:round(n * rnd.choice([0.1, 0.7, 0.83, 0.9, 1]))] + fresh(rnd.randint(0, n // 5))
        rows += [(2 * g, words, len(words)), (2 * g + 1, other or [5], len(other) or 1)]
    maps = R.bit_maps(spark.createDataFrame(rows, "id long, words array<long>, n int"))
    a = maps.where("id % 2 = 0").select("id", F.col("n").alias("n1"), F.col("m").alias("m1"))
    b = maps.where("id % 2 = 1").select((F.col("id") - 1).alias("id"), F.col("n").alias("n2"), F.col("m").alias("m2"))
    kept = {r.id for r in a.join(b, "id").where(R._maps_may_reach(0.7)).collect()}
    for (i, x, _), (_, y, _) in zip(rows[::2], rows[1::2], strict=True):
        similarity = len(set(x) & set(y)) / len(set(x) | set(y))
        assert similarity < 0.7 or i in kept
        unlike += similarity < 0.3 and len(x) >= 40 and i not in kept
    assert unlike > 10
