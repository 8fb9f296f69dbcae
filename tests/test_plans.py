"""Plan shape: anti-joins, top-k limits, no cartesian products; entry contract."""

import __spark_entry__ as E
from commentlake.sources import fixture_rules
from commentlake.sources.bindings import tables

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_anti_joins_and_topk(spark):
    q = E.queries()
    assert "LeftAnti" in _plan(q["c01_unembedded"](spark, SF))
    assert "LeftAnti" in _plan(q["c02_untagged"](spark, SF))
    bm = _plan(q["f03_bm25"](spark, SF))
    assert "WindowGroupLimit" in bm and "Cartesian" not in bm
    from commentlake.operators import tagging
    stored = tables(spark, SF).kb_comments          # a plain parquet scan
    assert "Exchange" not in _plan(tagging.match_rules(stored, fixture_rules.TEST_RULES))


def test_hybrid_has_no_cartesian(spark):
    p = _plan(E.queries()["f08_hybrid"](spark, SF))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_entry_contract(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
    t = tables(spark, SF)
    assert t.comments.count() == 200


def test_no_exchange_between_postings_and_partial_top_k(spark):
    """The scan of the postings is ranked where it lies, and no plan of search has a
    row for each pair of query and tagged comment."""
    for name in ("f03_bm25", "f04_bm25_tagged"):
        df = E.queries()[name](spark, SF)
        df.collect()                      # final adaptive plan
        p = _plan(df).split("Initial Plan")[0]
        ranked = p[p.index("FlatMapGroupsInArrow"):p.index("FileScan parquet spark_catalog")]
        assert "Exchange" not in ranked.split("BroadcastHashJoin")[0] and "BroadcastHashJoin" in ranked
        above = p[:p.index("FlatMapGroupsInArrow")]
        assert above.count("Exchange hashpartitioning") == 1 and "WindowGroupLimit" in above
