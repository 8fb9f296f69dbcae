"""Stored tables: touched parts only, killed commits, conflicts, unique keys; the
streams and the sync flow on top of them; index segments."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from commentlake import schemas
from commentlake.operators import postings, tagging
from commentlake.sources import commits, fixture_rules, ingest
from commentlake.sources.store import KeyedTable
from commentlake.streaming import stream

SCHEMA = "id long, repo string, number long, body string, updated_at timestamp_ntz"
COLS = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.COMMENTS.fields)


def _d(day):
    return dt.datetime(2024, 1, day)


def _rows(ids, day, text="t"):
    return [(i, "r", i, f"{text}{i}", _d(day)) for i in ids]


def _held(table):
    return {r.id: r.body for r in table.read().collect()}


def _table(spark, path, rows, **parts):
    df = spark.createDataFrame(rows, SCHEMA)
    return KeyedTable.create(spark, str(path), df.schema, ["id"], **(parts or {"span": 100})).upsert(df)


def test_only_touched_parts_are_rewritten(spark, tmp_path):
    _table(spark, tmp_path, _rows(range(-50, 2000), 1))
    before = KeyedTable.open(spark, str(tmp_path))
    assert len(before.content["parts"]) == 21
    batch = spark.createDataFrame(_rows(range(230, 260), 2, "new") + _rows([5000, 1999], 2, "new") + _rows([7], 0 + 1, "same day"), SCHEMA)
    after = KeyedTable.open(spark, str(tmp_path)).upsert(batch)
    changed = {int(p) for p, v in after.content["parts"].items() if before.content["parts"].get(p) != v}
    assert changed == {2, 19, 50, 0}
    want = {i: f"t{i}" for i in range(-50, 2000)} | {i: f"new{i}" for i in [*range(230, 260), 5000, 1999]} | {7: "same day7"}
    assert _held(after) == want
    assert _held(before)[230] == "t230"                      # the version that was opened
    assert after.vacuum() == 3 and _held(KeyedTable.open(spark, str(tmp_path))) == want


def test_killed_commit_leaves_the_old_version(spark, tmp_path, monkeypatch):
    table = _table(spark, tmp_path, _rows(range(300), 1))
    with monkeypatch.context() as m:
        m.setattr(commits.Commits, "put", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            table.upsert(spark.createDataFrame(_rows([5], 2, "lost"), SCHEMA))
    again = KeyedTable.open(spark, str(tmp_path))
    assert _held(again) == {i: f"t{i}" for i in range(300)}
    other = KeyedTable.open(spark, str(tmp_path))
    other.upsert(spark.createDataFrame(_rows([6], 2, "first"), SCHEMA))
    with pytest.raises(commits.Conflict):
        again.upsert(spark.createDataFrame(_rows([7], 2, "second"), SCHEMA))
    now = _held(KeyedTable.open(spark, str(tmp_path)))
    assert now[6] == "first6" and now[7] == "t7" and now[5] == "t5"


def test_unique_key_of_another_part_and_hashed_parts(spark, tmp_path):
    table = _table(spark, tmp_path / "a", _rows(range(250), 1))
    moved = spark.createDataFrame([(9000, "r", 3, "rebased", _d(2))], SCHEMA)
    table.upsert(moved, unique_keys=[["repo", "number"]])
    got = _held(table)
    assert 3 not in got and got[9000] == "rebased" and len(got) == 250
    rows = [(i % 40, "r", i, f"v{i}", _d(1 + i % 28)) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    hashed = KeyedTable.create(spark, str(tmp_path / "b"), df.schema, ["id", "number"], buckets=8).upsert(df)
    assert hashed.read().count() == 300
    with pytest.raises(ValueError):                          # parts by (id, number) do not follow from an id
        hashed.replace(spark.createDataFrame([(5,)], "id long"), df)
    one = _table(spark, tmp_path / "c", _rows(range(10), 1))
    one.replace(spark.createDataFrame([(5,), (77,)], "id long"), spark.createDataFrame(_rows([6], 1, "x"), SCHEMA).filter("id < 0"))
    assert set(_held(one)) == set(range(10)) - {5}


def test_empty_table_and_batch(spark, tmp_path):
    table = _table(spark, tmp_path, [])
    assert table.read().count() == 0 and table.read().columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert _held(table.upsert(spark.createDataFrame(_rows([1], 1), SCHEMA))) == {1: "t1"}


def test_import_has_the_fixed_schemas(spark, tmp_path):
    comments = spark.createDataFrame([_comment(1, 3, "a\nb")], COLS)
    vectors = spark.createDataFrame([(1, [0.1, -2.5], "m", _d(1))], "comment_id long, embedding array<float>, model string, created_at timestamp_ntz")
    for form in ("parquet", "json"):
        ingest.export_kb({"comments": comments, "comment_embeddings": vectors}, f"{tmp_path}/{form}", form)
        back = ingest.import_kb(spark, f"{tmp_path}/{form}", ["comments", "comment_embeddings"], form)
        assert [f.dataType for f in back["comments"].schema] == [f.dataType for f in schemas.COMMENTS]
        assert {tuple(r) for r in ingest.differences({"comments": comments, "comment_embeddings": vectors}, back).collect()} == {
            ("comments", 1, 0), ("comment_embeddings", 1, 0)}
    changed = back | {"comments": back["comments"].withColumn("body", F.lit("other"))}
    assert ("comments", 1, 2) in {tuple(r) for r in ingest.differences({"comments": comments}, changed).collect()}


# ---- streams --------------------------------------------------------------------
def _comment(i, day, body, path="a/b.py", us=5):
    t = dt.datetime(2024, 1, day, 0, 0, 0, us)
    return (i, "r", i % 7, None, "u", body, path, 1, 1, "RIGHT", "gamma", None, None, None, t, t, "h")


def _bytes_read(table, batch):
    """Of the files that a batch's changes are told by."""
    parts = table.parts_of(batch)
    files = table.read(parts).inputFiles()
    return len(files)


def test_what_a_batch_reads_does_not_grow_with_the_stream(spark, tmp_path):
    t = str(tmp_path)
    read = []
    for n in range(6):
        batch = spark.createDataFrame([_comment(i, 1 + n, "x") for i in range(n * 50, n * 50 + 60)], COLS)
        write = stream.batch_writer(t, index=False, span=50)
        write(batch, n)
        read.append(_bytes_read(KeyedTable.open(spark, f"{t}/comments"), batch))
    assert stream.snapshot(spark, t).count() == 310 and max(read[2:]) <= read[1]


def test_batches_are_applied_once_and_repeated_after_a_crash(spark, tmp_path, monkeypatch):
    t = str(tmp_path)
    write = stream.batch_writer(t, rules=fixture_rules.TEST_RULES, index=True, span=50)
    first = spark.createDataFrame([_comment(i, 1, "license the") for i in range(60)], COLS)
    second = spark.createDataFrame([_comment(i, 2, "nothing") for i in range(10)] + [_comment(30, 1, "older")], COLS)
    write(first, 0)
    with monkeypatch.context() as m:                         # tags and postings are written, the rows are not
        m.setattr(KeyedTable, "upsert", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            write(second, 1)
    for _ in range(2):                                       # repeated, then delivered once more
        write(second, 1)
    rows = {r.id: r.body for r in stream.snapshot(spark, t).collect()}
    assert rows == {i: "nothing" if i < 10 else "license the" for i in range(60)}
    want = tagging.match_rules(stream.snapshot(spark, t), fixture_rules.TEST_RULES)
    assert sorted(map(tuple, stream.current_tags(spark, t).collect())) == sorted(map(tuple, want.collect()))
    index = stream.current_index(spark, t)
    flat = postings.flat_postings(stream.snapshot(spark, t))
    assert sorted(map(tuple, index.postings.collect())) == sorted(map(tuple, flat.collect()))
    assert index.corpus.first().ndocs == 60


def test_segments_rank_like_one_index(spark, tmp_path):
    from commentlake.plans.search import prepare_queries
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "running", "runs"]
    now = {}
    index = None
    for n in range(4):
        batch = {rng.randrange(-20, 400): " ".join(rng.choices(words, k=rng.choice([0, 3, 8]))) for _ in range(120)}
        now |= batch
        df = spark.createDataFrame([(i, b, None, None) for i, b in batch.items()], "id long, body string, path string, diff_hunk string")
        index = (postings.write_index(df, str(tmp_path), postings.Layout(64, 9, 4), "porter") if index is None
                 else postings.add_segment(index, df, n))
        assert postings.add_segment(index, df, n).corpus.first() == index.corpus.first() or n == 0
    whole = spark.createDataFrame([(i, b, None, None) for i, b in now.items()], "id long, body string, path string, diff_hunk string")
    one = postings.build_index(whole)
    q = prepare_queries(spark.createDataFrame([(k, " ".join(rng.sample(words, 2)), None, 40) for k in range(8)],
                                              "query_id long, title string, tags array<string>, `limit` int"))
    ranked = lambda i, **k: sorted(map(tuple, postings.bm25_topk(q, i, **k).collect()))
    want = ranked(one)
    stems = postings.write_index(whole, str(tmp_path / "one"), stemmer="porter")
    porter = ranked(stems, stemmer="porter")
    index = postings.read_index(spark, str(tmp_path), "porter")
    assert index.superseded
    for i in (index, postings.merge_segments(index)):
        i = postings.read_index(spark, str(tmp_path), "porter")
        assert ranked(i) == want and ranked(i, stemmer="porter") == porter
        assert tuple(i.corpus.first())[:2] == tuple(one.corpus.first())[:2] == (len(now), sum(len(b.split()) for b in now.values()))
        df = {r.term: r.df for r in i.vocab.groupBy("term").agg(F.sum("df").alias("df")).collect()}
        assert {t: n for t, n in df.items() if n} == {r.term: r.df for r in one.vocab.collect()}
    assert not postings.read_index(spark, str(tmp_path)).superseded


def test_sync_flow(spark, tmp_path):
    pulls = [(i, i, f"t{i}", ("u",), f"2024-01-0{1 + i % 5}T00:00:00Z", "2024-01-01T00:00:00Z",
              f"2024-01-0{1 + i % 5}T00:00:00Z", "h", "closed", None, None, "r") for i in range(9)]
    pulls.append((50, 3, "t3 again", ("u",), "2024-01-09T00:00:00Z", "2024-01-01T00:00:00Z", "2024-01-09T00:00:00Z", "h", "closed", None, None, "r"))
    reviews = [(i, ("u",), "APPROVED", "b", f"2024-01-0{1 + i}T00:00:00Z" if i else None, "r", i) for i in range(5)]
    diffs = [("r", 1, "old", "2024-01-01T00:00:00Z"), ("r", 1, "new", "2024-01-02T00:00:00Z")]
    landing = {}
    for kind, rows in (("pull_requests", pulls), ("reviews", reviews), ("pr_diffs", diffs)):
        landing[kind] = f"{tmp_path}/land/{kind}"
        spark.createDataFrame(rows, stream.KINDS[kind].raw).write.json(landing[kind])
    landing["comments"] = f"{tmp_path}/land/comments"
    comments = spark.createDataFrame([_comment(i, 1, "license the body") for i in range(20)], COLS)
    ingest.comments_to_host_json(comments).write.json(landing["comments"])
    t = f"{tmp_path}/kb"
    for _ in range(2):
        stream.sync(spark, landing, t, 0, fixture_rules.TEST_RULES)
    snap = {k: stream.snapshot(spark, t, k) for k in stream.KINDS}
    got = {r.id: r.title for r in snap["pull_requests"].collect()}
    assert 3 not in got and got[50] == "t3 again" and len(got) == 9
    assert snap["reviews"].count() == 4 and [r.diff for r in snap["pr_diffs"].collect()] == ["new"]
    assert snap["comments"].count() == 20 and stream.current_index(spark, t).corpus.first().ndocs == 20
    assert KeyedTable.open(spark, f"{t}/comment_embeddings").read().count() == 20
    assert [tuple(r) for r in stream.current_state(spark, t).collect()] == [("r", _d(9), 8)]
    q = stream.start_ingest(stream.record_stream(spark, landing["reviews"], "reviews"), f"{tmp_path}/s", f"{tmp_path}/ck", kind="reviews")
    q.awaitTermination(300)
    assert stream.snapshot(spark, f"{tmp_path}/s", "reviews").count() == 4


def test_first_batch_of_a_table_is_written_once(spark, tmp_path, monkeypatch):
    """No copy of the batch is stored beside the table; duplicates, ties and rows without a key as ever."""
    from commentlake.sources import store
    rows = [*_rows(range(-5, 300), 1), *_rows([7, 8], 2, "new"), *_rows([9], 1, "u"), *_rows([10], 1, "a")]
    df = spark.createDataFrame([*rows, (None, "r", 1, "lost", _d(1))], SCHEMA)
    calls = []
    monkeypatch.setattr(store, "stored", lambda df, name: calls.append(name) or df)
    table = KeyedTable.create(spark, str(tmp_path), df.schema, ["id"], span=100).upsert(df, done=("s", 3))
    want = {i: f"t{i}" for i in range(-5, 300)} | {7: "new7", 8: "new8", 9: "u9"}
    assert not calls and _held(table) == want and set(table.content["parts"]) == {"-1", "0", "1", "2"}
    assert KeyedTable.open(spark, str(tmp_path)).done("s", 3)


def test_changes_of_a_batch_are_stored_once(spark, tmp_path, monkeypatch):
    calls, real = [], stream.stored
    monkeypatch.setattr(stream, "stored", lambda df, name: calls.append(name) or real(df, name))
    df = spark.createDataFrame([], COLS)
    table = KeyedTable.create(spark, str(tmp_path), df.schema, ["id"], span=100)
    assert stream.changes(df, table, "comments").count() == 0 and calls == ["stream-changes"]
