"""B-row scalar functions against the plain-Python rules (FIXTURES 4)."""

import os

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from commentlake.functions import text as tx


def _one(spark, rows, schema, expr):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(expr).collect()]


def test_dirname(spark):
    paths = ["a/b/c.ts", "c.ts", "/c", "a/b/", "//x", "a//b", None]
    got = _one(spark, [(p,) for p in paths], "p string", tx.dirname("p"))
    assert got == [None if p is None else os.path.dirname(p) for p in paths]
    keys = _one(spark, [(p,) for p in ["a/b/c.ts", "c.ts", "", None]], "p string", tx.group_key("p"))
    assert keys == ["a/b", "", "general", "general"]


def test_search_terms_examples(spark):
    s = "the Validation café node_modules batchService n1foo validation"
    assert _one(spark, [(s,)], "t string", tx.search_terms("t")) == [["validation", "batchservice"]]
    many = ["term" + c * 2 for c in "abcdefghijklmnopqrstuvwxy"]
    assert _one(spark, [(" ".join(many),)], "t string", tx.search_terms("t")) == [many]
    assert _one(spark, [(" ".join(many),)], "t string", tx.search_terms("t", 20)) == [many[:20]]


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcXYZ éü_1-.\n\tthe and")), max_size=60))
def test_search_terms_property(spark, s):
    (got,) = _one(spark, [(s,)], "t string", tx.search_terms("t"))
    assert len(set(got)) == len(got) and not set(got) & set(tx.STOPWORDS)
    assert all(len(w) >= 3 and w.isascii() and w.isalpha() and w in s.lower() for w in got)
    (twice,) = _one(spark, [(s + " " + s,)], "t string", tx.search_terms("t"))
    assert twice == got


def test_query_text(spark):
    rows = [("t", ["a/b.py", "c.py"], "x" * 4001, [f"c{i}" for i in range(6)]), (None, None, None, None), ("", [], "", [])]
    schema = "title string, paths array<string>, diff string, commits array<string>"
    got = _one(spark, rows, schema, tx.query_text("title", "paths", "diff", "commits"))
    assert got == ["t\na/b.py\na\nc.py\n" + "x" * 4001 + "\nc0\nc1\nc2\nc3\nc4\nc5", "", ""]
    got = _one(spark, rows[:1], schema, tx.query_text("title", "paths", "diff", "commits", 3, 2))
    assert got == ["t\na/b.py\na\nc.py\nxxx\nc0\nc1"]


def test_summarize_body(spark):
    cases = {"a" * 200: "a" * 200, "a" * 201: "a" * 200 + "...", "x ![img](http://h/p.png) y": "x [image] y",
             "see https://" + "u" * 79 + " ok": "see https://" + "u" * 79 + " ok",
             "see https://" + "u" * 80 + " ok": "see [long-url] ok",
             "  line one\nline two\n\n": "line one line two", "": "",
             "a" * 150 + "\n" + "b" * 60 + "\nc": "a" * 150 + " " + "b" * 50 + "..."}
    assert _one(spark, [(c,) for c in cases], "b string", tx.summarize_body("b")) == list(cases.values())


def test_truncate_hunk(spark):
    cases = {"l0\nl1\nl2\nl3\nl4\nl5": "l0\nl1\nl2\nl3\nl4\nl5",
             "l0\nl1\nl2\nl3\nl4\nl5\nl6": "l0\nl1\nl2\nl3\nl4\nl5\n  ...", "  x\n": "x"}
    assert _one(spark, [(c,) for c in cases], "h string", tx.truncate_hunk("h")) == list(cases.values())


def test_location_day_tags_clamp(spark):
    got = _one(spark, [("a.py", None), ("a.py", 0), ("a.py", 5), (None, 3), ("", 3)],
               "p string, l long", tx.location("p", "l"))
    assert got == ["a.py", "a.py", "a.py:5", None, None]
    got = _one(spark, [("a, b,,c ",)], "s string", tx.parse_tags("s"))
    assert got == [["a", "b", "", "c"]]
    got = _one(spark, [(0,), (-3,), (7,), (500,), (None,)], "n int", tx.clamp_limit("n"))
    assert got == [1, 1, 7, 100, 15]
    got = _one(spark, [(0,), (None,), (9,)], "n int", tx.effective_limit("n"))
    assert got == [15, 15, 9]


def test_word_set_and_jaccard(spark):
    df = spark.createDataFrame([("a b c", "a b c d"), ("", ""), ("A  b\tC", "c b a")], "x string, y string")
    got = df.select(tx.jaccard(tx.word_set("x"), tx.word_set("y"))).collect()
    assert [r[0] for r in got] == [0.75, None, 1.0]


def test_embed_text_and_fts_tokens(spark):
    got = _one(spark, [("a/b.py", "body", "@@ h"), (None, "", None)], "p string, b string, h string",
               tx.embed_text("p", "b", "h"))
    assert got == ["File: a/b.py\nbody\nCode context:\n@@ h", ""]
    got = _one(spark, [("Élan café_bar x2 ÜBER",)], "t string", tx.fts_tokens("t"))
    assert got == [["elan", "cafe", "bar", "x2", "uber"]]


def test_whitespace_classes_equal_python(spark):
    cps = [chr(i) for i in range(0x3001)] + ["﻿", "​"]
    df = spark.createDataFrame([(ch,) for ch in cps], "s string")
    exp = {ch for ch in cps if ch.isspace()}
    for pat in ("^" + tx.WS + "$", "^" + tx.WS_J + "$"):
        assert {r.s for r in df.where(F.col("s").rlike(pat)).collect()} == exp
    assert {r.s for r in df.where(F.col("s").rlike("^" + tx.NON_WS_J + "$")).collect()} == set(cps) - exp
