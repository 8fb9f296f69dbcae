"""Batches whose keys lie anywhere become layers; rows are compared by fingerprints."""

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from commentlake.functions.rows import compared
from commentlake.sources import ingest
from commentlake.sources.store import KeyedTable
from commentlake.streaming import stream

from .test_stream import COLS


def _row(i, day, body):
    t = day and dt.datetime(2024, 1, day)
    return (i, "r", 1, None, "u", body, "a/b.py", 1, 1, "RIGHT", None, None, None, None, t, t, "h")


def test_scattered_batches_rewrite_nothing(spark, tmp_path, monkeypatch):
    """Eight batches over all parts: every file that one batch writes still counts after the
    next, the newest row of each key is read, and nothing that was stored on the way is left."""
    rnd, t, want, kept, at, real = random.Random(2), f"{tmp_path}/t", {}, [], {}, stream.stored
    monkeypatch.setattr(stream, "stored", lambda df, name: kept.append(real(df, name)) or kept[-1])
    for n in range(8):
        rows = {i: (rnd.choice([None, 1, 2, 3, 4]), f"b{n}") for i in rnd.sample(range(-50, 150), 60)}
        for i, (day, body) in rows.items():
            if i not in want or want[i][0] is None or day is not None and day > want[i][0]:
                want[i] = day, body
        df = spark.createDataFrame([_row(i, *x) for i, x in rows.items()], COLS)
        stream.apply_batch(df, t, "comments", n, span=20)
        table = KeyedTable.open(spark, f"{t}/comments")
        assert {i: v for i, v in at.items() if table.content["parts"].get(i) == v} == at
        at = dict(table.content["parts"])
        got = [(r.id, r.body) for r in table.read().collect()]
        assert sorted(got) == sorted((i, body) for i, (_, body) in want.items())
        some = [r.id for r in table.read(["0", "-1"]).collect()]
        assert sorted(some) == sorted(i for i in want if -20 <= i < 20)
    assert len(table.layers()) == 7 and kept and not any(os.path.exists(df._stored_at) for df in kept)
    assert table.merge_layers().layers() == [] and table.vacuum() > 0
    again = KeyedTable.open(spark, f"{t}/comments")
    assert sorted((r.id, r.body) for r in again.read().collect()) == sorted((i, b) for i, (_, b) in want.items())


def test_replaced_keys_of_layers(spark, tmp_path):
    """Rows of several to a key: a later batch replaces them all, by none if it has none."""
    schema = "k long, tag string"
    rows = lambda *x: spark.createDataFrame(list(x), schema)
    keys = lambda *x: spark.createDataFrame([(i,) for i in x], "k long")
    table = KeyedTable.create(spark, str(tmp_path), rows((0, "")).schema, ["k"], span=10)
    table.replace(keys(1, 2), rows((1, "a"), (1, "b"), (2, "a")), ("s", 0), layer=True)
    table.replace(keys(1, 12), rows((1, "c"), (12, "a")), ("s", 1), layer=True)
    table.replace(keys(2, 3), rows(), ("s", 2), layer=True)
    table.replace(keys(2), rows((2, "z"), (2, "y")), ("s", 3), layer=True)
    got = lambda x: sorted(map(tuple, x.read().collect()))
    assert got(KeyedTable.open(spark, str(tmp_path))) == [(1, "c"), (2, "y"), (2, "z"), (12, "a")]
    table.replace(keys(12), rows((12, "b")))                       # without a layer: merged first
    assert not table.layers() and got(table) == [(1, "c"), (2, "y"), (2, "z"), (12, "b")]


def test_fingerprints_tell_nulls_and_repeats(spark):
    schema = "a string, b string, c array<string>"
    rows = [("x", None, ["p", None]), (None, "x", [None, "p"]), (None, None, None), (None, None, []), ("x", None, ["p", None])]
    left = spark.createDataFrame(rows, schema)
    assert compared(left, left.orderBy(F.desc("a")), left.columns).first() == (5, 5, 0)
    for k, row in enumerate([(None, "x", ["p", None]), ("x", None, [None, "p"]), (None, None, []), (None, None, None), (None, "x", ["p", None])]):
        other = spark.createDataFrame([*rows[:k], row, *rows[k + 1:]], schema)
        assert compared(left, other, left.columns).first() == (5, 5, 2)
    assert compared(left, spark.createDataFrame(rows[:4], schema), left.columns).first() == (5, 4, 1)


def test_differences_exchange_no_texts(spark, tmp_path):
    comments = spark.createDataFrame([_row(i, 1, "text " * 5) for i in range(30)], COLS)
    plan = ingest.differences({"comments": comments}, {"comments": comments})
    exchanges = [x for x in plan._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x]
    assert exchanges and not any("body" in x for x in exchanges)
    assert plan.first() == ("comments", 30, 0)
