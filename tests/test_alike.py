"""Similar sets by blocks (G7) against all pairs."""

import os
import random

import numpy as np
from pyspark.sql import functions as F

from commentlake.operators import alike
from commentlake.operators import report as R


def _sets(rnd, many):
    """Sets of 1 to 400 words, copies that share 0.6 to 0.9 of them, and a common vocabulary."""
    out, common = [], [rnd.randrange(-2**62, 2**62) for _ in range(600)]
    while len(out) < many:
        n = rnd.choice([1, 2, 7, 30, 63, 64, 65, 129, 400])
        base = rnd.sample(common, n // 2) + [rnd.randrange(-2**62, 2**62) for _ in range(n - n // 2)]
        out.append(base)
        for part in (0.6, 0.69, 0.7, 0.75, 0.84, 0.9):
            keep = rnd.sample(base, max(1, round(n * part)))
            out.append(keep + [rnd.randrange(-2**62, 2**62) for _ in range(rnd.choice([0, 0, 1, n // 10]))])
    return out[:many]


def test_maps_drop_no_similar_pair():
    """Pairs of two blocks that the maps leave out are below the threshold."""
    rnd = random.Random(3)
    sets = sorted(_sets(rnd, 500), key=len)
    ns = np.array([len(s) for s in sets])
    maps = alike.parity_maps(ns, np.concatenate([np.array(s) for s in sets]))
    block = lambda at: alike._Block(*(np.array(v).tobytes() for v in (at, ns[at].astype(np.int32), at)), b"".join(maps[i] for i in at))
    at = np.arange(len(sets))
    whole = {(int(a), int(b)) for x, y in alike.near(block(at), block(at), 0.7, True) for a, b in zip(x, y, strict=True)}
    halves = at[::2], at[1::2]
    split = {tuple(sorted((int(halves[0][a]), int(halves[1][b])))) for x, y in alike.near(*map(block, halves), 0.7, False)
             for a, b in zip(x, y, strict=True)}
    similar = {(a, b) for a in at.tolist() for b in range(a + 1, len(sets))
               if len(set(sets[a]) & set(sets[b])) >= 0.7 * len(set(sets[a]) | set(sets[b])) - 1e-9}
    assert len(similar) > 200 and similar <= whole and len(whole) < 4 * len(similar)
    assert {p for p in similar if (p[0] - p[1]) % 2} <= split <= whole


def test_components_over_several_blocks_and_chunks(spark, monkeypatch):
    """Blocks of few sets, broadcast a few at a time, give the components of all pairs."""
    monkeypatch.setattr(alike, "BLOCK_SETS", 40)
    monkeypatch.setattr(alike, "CHUNK_BYTES", 20_000)
    sets = [list(dict.fromkeys(s)) for s in _sets(random.Random(5), 300)]
    comp = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if comp[a] != comp[b] and len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) >= 0.7:
                comp = [min(comp[a], comp[b]) if c in (comp[a], comp[b]) else c for c in comp]
    rows = spark.createDataFrame([(i, s, len(s)) for i, s in enumerate(sets)], "id long, words array<long>, n int")
    keep = lambda df: R.stored(df, "alike-test")
    got = alike.similar_by_blocks(keep(rows), 0.7, keep, R._joined)
    assert {r.id: r.label for r in got.collect()} == dict(enumerate(comp))


def test_conventions_write_no_row_for_a_pair(spark, monkeypatch):
    """300 different texts of one vocabulary share words pair by pair; what is written is
    about as many rows as there are texts, and the word sets are deleted at the end."""
    rnd, rows, written = random.Random(9), [], []
    vocabulary = [f"w{k}" for k in range(120)]
    for i in range(300):
        rows.append((i, " ".join(rnd.sample(vocabulary, 40)), "a/x.py"))
    before = R.stored

    def counting(df, name):
        out = before(df, name)
        written.append((out.count(), out))
        return out
    monkeypatch.setattr(R, "stored", counting)
    c = spark.createDataFrame(rows, "id long, body string, path string").select(
        "*", F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")).alias("created_at"),
        F.to_timestamp_ntz(F.lit("2024-01-02 00:00:00")).alias("updated_at"))
    _, src = R.mine_conventions(c)
    assert src.count() == 0
    assert max(n for n, _ in written) <= 8 * len(rows)
    wide = [df for _, df in written if "words" in df.columns]
    assert wide and sum(os.path.exists(df._stored_at) for df in wide) <= 1
