"""H1-H4."""

import random

from commentlake.operators import findings as H

from . import pyref

SCHEMA = "file string, line long, issue string, severity string"


def test_merge_nearby_example(spark):
    df = spark.createDataFrame([("f", 1, "a", "P2"), ("f", 3, "b", "P0"), ("f", 5, "c", "P1"),
                                ("f", 8, "d", "P2"), ("g", 1, "e", "P1"),
                                ("f", 5, "a", "P2")], SCHEMA)
    got = sorted((r.file, r.line, r.line_end, r.severity, r.issue, r.n_findings)
                 for r in H.merge_nearby(df).collect())
    assert got == [("f", 1, 5, "P0", "a; b; c", 4), ("f", 8, 8, "P2", "d", 1), ("g", 1, 1, "P1", "e", 1)]


def test_islands_match_python(spark):
    rnd = random.Random(3)
    rows = [(f"f{rnd.randint(0, 3)}", rnd.randint(1, 60), "x", "P1") for _ in range(150)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.file, r.line): r.start for r in H.line_islands(df).collect()}
    for f in {r[0] for r in rows}:
        for isl in pyref.islands([r[1] for r in rows if r[0] == f]):
            for x in isl:
                assert got[(f, x)] == isl[0]


def test_dedup_rollup_approved(spark):
    df = spark.createDataFrame([("f", 1, "Bad  Name", "P2"), ("f", 1, "bad name", "P0"), ("f", 1, "other", "P1")],
                               SCHEMA)
    got = sorted((r.issue, r.severity, r.n_merged) for r in H.dedup_findings(df).collect())
    assert got == [("bad name", "P0", 2), ("other", "P1", 1)]
    alike = spark.createDataFrame(
        [("f", 1, "check open handle in part 3", "P1"), ("f", 1, "check open handle in part 4", "P0"),
         ("f", 1, "check unused import in part 3", "P2"), ("f", 2, "check open handle in part 3", "P2"),
         ("f", 1, "", "P2"), ("f", 1, "Check  open handle in part 3", "P2")], SCHEMA)
    got = sorted((r.line, r.issue, r.severity, r.n_merged) for r in H.dedup_findings(alike).collect())
    assert got == [(1, "", "P2", 1), (1, "check open handle in part 4", "P0", 3),
                   (1, "check unused import in part 3", "P2", 1), (2, "check open handle in part 3", "P2", 1)]
    roll = [(r.severity, r.n) for r in H.severity_rollup(df).collect()]
    assert roll == [("P0", 1), ("P1", 1), ("P2", 1)]
    changed = spark.createDataFrame([("f",), ("g",)], "file string")
    assert [r.file for r in H.approved_files(changed, df).collect()] == ["g"]


def test_islands_across_small_blocks(spark, monkeypatch):
    """Blocks of 4 line numbers: islands chain across many blocks."""
    monkeypatch.setattr(H, "LINE_BLOCK", 4)
    rnd = random.Random(11)
    rows = [(f"f{rnd.randint(0, 2)}", rnd.randint(0, 90), "x", "P1") for _ in range(160)]
    rows += [("chain", x, "x", "P2") for x in range(0, 40, 2)] + [("chain", 45, "x", "P2")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.file, r.line): r.start for r in H.line_islands(df).collect()}
    for f in {r[0] for r in rows}:
        for isl in pyref.islands([r[1] for r in rows if r[0] == f]):
            for x in isl:
                assert got[(f, x)] == isl[0], (f, x)


def test_dedup_of_a_line_with_many_texts(spark):
    """More texts than are folded in one row, against the rule in Python."""
    rnd, rows = random.Random(8), []
    for k in range(H.FOLD + 150):
        topic = [f"t{k % 60}w{j}" for j in range(6)] if k % 2 else ["check", "open", "handle", "in", "part"]
        rows.append(("hot", None, " ".join([*topic, f"n{rnd.randint(0, 9) if k % 3 else k}"]), f"P{rnd.randint(0, 2)}"))
    rows += [("hot", None, "", "P1"), ("cold", 1, "a b c", "P0"), ("cold", 1, "A b  c", "P2")]
    want = {}
    for at in {r[:2] for r in rows}:
        best = {}
        for r in rows:
            if r[:2] == at:
                old, n = best.get(norm := " ".join(r[2].lower().split()), ((r[3], r[2]), 0))
                best[norm] = (min(old, (r[3], r[2])), n + 1)
        kept = []
        for norm, (b, n) in sorted(best.items(), key=lambda i: i[1][0]):
            w = set(norm.split())
            for k in kept:
                if w and k[1] and len(w & k[1]) / len(w | k[1]) >= 0.7:
                    k[2] += n
                    break
            else:
                kept.append([b, w, n])
        want |= {(*at, b[1], b[0]): n for b, _, n in kept}
    got = H.dedup_findings(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.file, r.line, r.issue, r.severity): r.n_merged for r in got} == want and len(got) == len(want)


def test_rows_components_and_rounds_agree(spark, monkeypatch):
    """The same lines folded in one row, by components and in rounds."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(14)]
    rows = [(rng.choice(["f", "g"]), 1, " ".join(rng.sample(words, rng.randint(1, 6))), rng.choice(["P0", "P1", "P2"])) for _ in range(120)]
    base = [f"c{k}" for k in range(20)]
    rows += [("f", 1, " ".join(base[k:k + 9]), "P1") for k in range(11)]                       # a chain of similar texts
    rows += [("f", 1, "", "P2"), ("f", 1, " ", "P0"), ("h", 2, "alone", "P0")]
    df = spark.createDataFrame(rows, SCHEMA)
    one = sorted(map(tuple, H.dedup_findings(df).collect()))
    for fold in (40, 6, 1):
        monkeypatch.setattr(H, "FOLD", fold)
        assert sorted(map(tuple, H.dedup_findings(df).collect())) == one
    assert sum(r[4] for r in one) == len(rows)
