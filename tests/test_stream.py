"""AvailableNow stream equals the batch backfill; re-delivery is idempotent."""

import datetime as dt
import os
import tempfile

from commentlake.sources import fixture_rules, ingest
from commentlake.streaming import stream

COLS = "id long, repo string, pr_number long, review_id long, user_login string, body string, " \
       "path string, line long, original_line long, side string, diff_hunk string, commit_id string, " \
       "author_association string, in_reply_to_id long, created_at timestamp_ntz, " \
       "updated_at timestamp_ntz, html_url string"


def _rows(n, day, prefix=""):
    t = dt.datetime(2024, 1, day)
    return [(i, "r", 1, None, "u", f"{prefix}body {i} license", "a/b.py", 1, 1, "RIGHT", None, None, None,
             None, t, t, "h") for i in range(n)]


def test_stream_equals_backfill(spark):
    base = tempfile.mkdtemp(prefix="cl-stream-")
    landing = os.path.join(base, "landing")
    first = spark.createDataFrame(_rows(20, 1), COLS)
    second = spark.createDataFrame(_rows(5, 2, "[edited] "), COLS)
    ingest.comments_to_host_json(first).write.json(landing)
    ingest.comments_to_host_json(second).write.mode("append").json(landing)
    ingest.comments_to_host_json(first).write.mode("append").json(landing)      # re-delivery
    q = stream.start_ingest(stream.comment_stream(spark, landing, 1), os.path.join(base, "t"),
                            os.path.join(base, "ck"), rules=fixture_rules.TEST_RULES, index=True)
    q.awaitTermination(600)
    snap = {r.id: r.body for r in stream.snapshot(spark, os.path.join(base, "t")).collect()}
    assert len(snap) == 20 and snap[3].startswith("[edited]") and not snap[10].startswith("[edited]")
    stream.backfill(spark, landing, os.path.join(base, "b"), rules=fixture_rules.TEST_RULES, index=True)
    back = {r.id: r.body for r in stream.snapshot(spark, os.path.join(base, "b")).collect()}
    assert back == snap
    tags = stream.current_tags(spark, os.path.join(base, "t")).collect()
    assert {r.comment_id for r in tags} == set(range(20))
    idx = stream.current_index(spark, os.path.join(base, "t"))
    assert idx.corpus.collect()[0].ndocs == 20


def test_old_rows_that_arrive_late_stay_and_copies_go(spark):
    base = tempfile.mkdtemp(prefix="cl-stream-")
    landing = os.path.join(base, "landing")
    days = [dt.datetime(2024, 6, 1), dt.datetime(2024, 6, 2), dt.datetime(2023, 1, 1), dt.datetime(2024, 6, 1)]
    for i, t in zip([1, 2, 3, 1], days, strict=True):
        row = (i, "r", 1, None, "u", "b", "p", 1, 1, "RIGHT", None, None, None, None, t, t, "h")
        ingest.comments_to_host_json(spark.createDataFrame([row], COLS)).coalesce(1).write.mode("append").json(landing)
    stream.start_ingest(stream.comment_stream(spark, landing, 1), os.path.join(base, "t"), os.path.join(base, "ck"),
                        index=False).awaitTermination()
    log = stream.snapshot(spark, os.path.join(base, "t"))
    assert sorted((r.id, r.updated_at) for r in log.collect()) == sorted(zip([1, 2, 3], days, strict=False))
