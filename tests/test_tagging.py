"""Scores, modes, and a plan without exchanges."""

from pyspark.sql import functions as F

from commentlake.operators import tagging as tg
from commentlake.sources import fixture_rules

RULES = tg.rule_set([
    ("t", "test", {"body": [tg.words("alpha")], "path": [r"\.py$"], "hunk": [tg.words("beta")]}),
    ("phrase", "multi-word", {"body": [tg.words("dead code")]}),
])


def _comments(spark, rows):
    return spark.createDataFrame(rows, "id long, body string, path string, diff_hunk string")


def test_score_combinations(spark):
    rows = [(1, "alpha", None, None), (2, "x", "a.py", None), (3, "x", None, "beta"),
            (4, "alpha", "a.py", None), (5, "ALPHA!", None, "beta"), (6, "x", "a.py", "beta"),
            (7, "alpha", "a.py", "beta"), (8, "alphabet", "a.pyc", "betas"), (9, "some dead code", None, None)]
    got = {(r.comment_id, r.tag): r.confidence for r in tg.match_rules(_comments(spark, rows), RULES).collect()}
    assert got == {(1, "t"): 0.5, (2, "t"): 0.3, (4, "t"): 0.8, (5, "t"): 0.7, (6, "t"): 0.5,
                   (7, "t"): 1.0, (9, "phrase"): 0.5}


def test_classes_are_unicode_and_only_newlines_end_lines(spark):
    rules = tg.rule_set([("w", "", {"body": [r"^caf\w$"]}), ("b", "", {"body": [r"\bété\b"]}),
                         ("dot", "", {"body": [r"one.*two"]}), ("s", "", {"body": [r"a\sb"]})])
    rows = [(1, "CAFÉ", None, None), (2, "l'été, déjà", None, None), (3, "étés", None, None),
            (4, "one\r\u2028\u0085two", None, None), (5, "one\ntwo", None, None), (6, "a\u00a0b", None, None)]
    got = sorted((r.comment_id, r.tag) for r in tg.match_rules(_comments(spark, rows), rules).collect())
    assert got == [(1, "w"), (2, "b"), (4, "dot"), (6, "s")]


def test_match_plan_has_no_exchange(spark):
    plan = tg.match_rules(_comments(spark, [(1, "alpha", None, None)]), fixture_rules.TEST_RULES)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text


def test_seed_and_modes(spark):
    old = tg.seed_tags(None, RULES[:1], spark)
    assert [(r.id, r.name) for r in old.orderBy("id").collect()] == [(1, "t")]
    new = tg.seed_tags(old, RULES, spark)
    assert [(r.id, r.name) for r in new.orderBy("id").collect()] == [(1, "t"), (2, "phrase")]
    c = _comments(spark, [(1, "alpha", "a.py", None), (2, "dead code", None, None), (3, "none", None, None)])
    existing = spark.createDataFrame([(1, 1, 1.0)], "comment_id long, tag_id long, confidence double")
    _, ct = tg.tag_comments(c, existing, old, RULES, mode="untagged")
    assert sorted(map(tuple, ct.collect())) == [(1, 1, 1.0), (2, 2, 0.5)]
    _, ct = tg.tag_comments(c, existing, old, RULES, mode="all")
    assert sorted(map(tuple, ct.collect())) == [(1, 1, 0.8), (2, 2, 0.5)]


def test_required_literals():
    for pattern, want in [
        (r"\bfoo(bar)?baz\b", ["foo"]), (r"naming\s+convention", ["convention"]), (r"a|license", None), (r"licen[cs]e", ["licen"]),
        (r"colou?r scheme", ["r scheme"]), (r"x*token *= *\"", ["token"]), (r"\.example\.org/", [".example.org/"]),
        (r"foo{2}bar", ["bar"]), (r"foo+bar", ["foo"]), (r"(?i)foo", None), (r"alpha|[|]beta|gam(m|n)a", ["alpha", "beta", "gam"]),
        (r"\w+", None), (r"^caf\w$", ["caf"]), (r"a\|bc", ["a|bc"]), (r"[]abc]xyz", ["xyz"]), (r"\p{Lu}xyz", ["xyz"]), (r"él.*test", ["test"])]:
        assert tg.required_literals(pattern) == want, pattern


def test_literals_never_hide_a_match(spark):
    """Every rule with and without the look-up; letters that fold to ASCII ones."""
    spec = [r"\blicen[cs]e\w*\b", r"kelvin.*sign", r"issue|stress", r"no +break", r"\bdot\b|(?:x|y)z{2,3}", r"(?:^|/)tests?/", r"\w+ing\b"]
    texts = ["LİCENSE", "lıcense", "licenſe", "LICENCES!", "\u212Aelvin the sign", "kelvin\nsign", "iſſue", "ISSUE", "streß", "no  break",
             "dot", "dots", "xzz", "yzzz", "xz", "tests/a", "/test/", "contests/", "running", "RUNNING.", "ing", None, ""]
    comments = _comments(spark, [(i, t, t, t) for i, t in enumerate(texts)])
    for p in spec:
        rules = tg.rule_set([("t", "", {"body": [p]})])
        got = {r.comment_id for r in tg.match_rules(comments, rules).collect()}
        want = {r.id for r in comments.where(F.col("body").rlike(tg.combined_pattern([p]))).select("id").collect()}
        assert got == want, p


def test_rules_from_a_table(spark):
    table = tg.rules_table(spark, fixture_rules.TEST_RULES)
    back = tg.rules_of(table.orderBy(F.rand()))
    assert back == fixture_rules.TEST_RULES and [tg._token_words(r.pattern) for r in back] == [tg._token_words(r.pattern) for r in fixture_rules.TEST_RULES]
    rows = [(1, "that and with", "m.example.org/en/", "the"), (2, "token = \"", None, "license"), (3, "", "", "")]
    c = _comments(spark, rows)
    assert sorted(map(tuple, tg.match_rules(c, table).collect())) == sorted(map(tuple, tg.match_rules(c, fixture_rules.TEST_RULES).collect()))
    assert tg.match_rules(c, table.limit(0)).count() == 0
