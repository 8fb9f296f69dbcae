"""Fusion values, edge cases of hybrid search, batch = single, scores and
masks against plain Python."""

import hashlib
import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from commentlake.operators import fusion, postings, tagging
from commentlake.plans.search import SearchInputs, hybrid_search


def test_rrf_values(spark):
    fts = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, id long, rank int")
    vec = spark.createDataFrame([(1, 10, 1), (1, 12, 2)], "query_id long, id long, rank int")
    lim = spark.createDataFrame([(1, 10)], "query_id long, lim int")
    got = {r.id: (r.score, r.match_source, r.rank) for r in fusion.rrf(fts, vec, lim).collect()}
    assert math.isclose(got[10][0], 1 / 61) and math.isclose(got[11][0], 0.4 / 62)
    assert got[12][0] == 0.6 / 62 and got[12][1] == "vector"
    assert got[11][1] == "fts" and got[10][1] == "hybrid"
    assert [got[i][2] for i in (10, 12, 11)] == [1, 2, 3]


def _inputs(spark):
    comments = spark.createDataFrame([
        (1, "validation of request payload", "api/handlers/user.py", None, "u1"),
        (2, "rename this variable please", "api/models/user.py", None, "u2"),
        (3, "payload validation missing here", "web/form.ts", None, "u3"),
        (4, "unrelated remark", None, None, "u4"),
    ], "id long, body string, path string, diff_hunk string, user_login string")
    comments = comments.select("*", F.lit("r").alias("repo"), F.lit(1).cast("long").alias("pr_number"),
                               F.lit(None).cast("long").alias("line"),
                               F.to_timestamp_ntz(F.lit("2024-01-02 03:04:05")).alias("created_at"))
    vecs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.6, 0.8]), (9, [1.0, 0.0])],
                                 "comment_id long, embedding array<float>")
    tags = spark.createDataFrame([(1, "validation", None), (2, "naming", None)], "id long, name string, description string")
    ct = spark.createDataFrame([(1, 1, 0.5), (3, 1, 0.5), (2, 2, 0.5)], "comment_id long, tag_id long, confidence double")
    return SearchInputs(comments, postings.build_index(comments), vecs, tags, ct)


def _queries(spark, rows):
    return spark.createDataFrame(rows, "query_id long, title string, tags array<string>, `limit` int, qvec array<float>")


def test_hybrid_edge_cases(spark):
    inp = _inputs(spark)
    q = _queries(spark, [
        (1, "payload validation", None, 10, [1.0, 0.0]),
        (2, "   ", None, 10, [1.0, 0.0]),                 # blank -> no rows
        (3, "payload validation", ["nope"], 10, [1.0, 0.0]),   # unknown tag -> no rows
        (4, "payload validation", [], 10, [1.0, 0.0]),    # empty tag list -> no filter
        (5, "payload validation", ["naming"], 10, [1.0, 0.0]),  # candidates only
        (6, "the and for", None, 10, [0.0, 1.0]),          # no terms -> vector only
    ])
    out = hybrid_search(q, inp).collect()
    by = {}
    for r in out:
        by.setdefault(r.query_id, []).append(r)
    assert 2 not in by and 3 not in by
    assert sorted(r.id for r in by[1]) == sorted(r.id for r in by[4])
    assert {r.id for r in by[5]} == {2}
    assert {r.match_source for r in by[6]} == {"vector"}
    assert 9 not in {r.id for r in by[1]}        # vector without a comment is dropped
    top = sorted(by[1], key=lambda r: r.rank)[0]
    assert top.id in (1, 3) and top.match_source == "hybrid"


def test_batch_equals_single(spark):
    inp = _inputs(spark)
    rows = [(1, "payload validation", None, 3, [1.0, 0.0]), (2, "rename variable", ["naming"], 5, [0.0, 1.0]),
            (3, "user models", None, 2, [0.6, 0.8])]
    batch = {(r.query_id, r.id, r.rank) for r in hybrid_search(_queries(spark, rows), inp).collect()}
    single = set()
    for row in rows:
        single |= {(r.query_id, r.id, r.rank) for r in hybrid_search(_queries(spark, [row]), inp).collect()}
    assert batch == single and batch


def test_bm25_restricted_uses_corpus_stats(spark):
    inp = _inputs(spark)
    q = _queries(spark, [(1, "payload", None, 10, None), (2, "payload", ["validation"], 10, None)])
    from commentlake.plans.search import prepare_queries
    index = postings.with_tags(inp.index, inp.comment_tags)
    res = postings.bm25_topk(prepare_queries(q), index, inp.tags)
    got = {(r.query_id, r.id): r.score for r in res.collect()}
    assert got[(2, 1)] == got[(1, 1)] and got[(2, 3)] == got[(1, 3)]
    assert set(k for k in got if k[0] == 2) <= {(2, 1), (2, 3)}


# ---- blocks: every score written out in plain Python ---------------------------
WORDS = ["alpha", "beta", "gamma", "delta", "running", "runs", "run", "relational", "relate", "needle"]


def _corpus(n, seed=1):
    """Comments of skewed words, some long, ids with gaps and below 0, one hot word."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        words = [rng.choices(WORDS, weights=[40, 20, 10, 8, 4, 3, 3, 2, 2, 1])[0] for _ in range(rng.choice([3, 5, 9, 60]))]
        rows.append((k * 3 - 30, " ".join(words), rng.choice([None, "src/beta.py", ""]), rng.choice([None, "gamma delta"])))
    return rows


def _bm25(rows, terms, k, stem=lambda t: t, allowed=None):
    docs = {i: [stem(t) for x in (b, p, h) if x for t in re.findall("[a-z]+", x)] for i, b, p, h in rows}
    avg = sum(map(len, docs.values())) / len(docs)
    out = {}
    for term in map(stem, terms):
        df = sum(term in d for d in docs.values())
        idf = math.log((len(docs) - df + 0.5) / (df + 0.5)) if df else 0
        idf = idf if idf > 0 else 1e-6
        for i, d in docs.items():
            tf = float(d.count(term))
            if tf and (allowed is None or i in allowed):
                c = (idf * (tf * 2.2)) / (tf + 1.2 * (1.0 - 0.75 + 0.75 * len(d) / avg))
                out[i] = out.get(i, 0) + math.floor(c * 1e12)
    best = sorted(((i, ((s + 500) // 1000) / 1e9) for i, s in out.items()), key=lambda x: (-x[1], x[0]))[:k]
    return [(i, s, r + 1) for r, (i, s) in enumerate(best)]


COMMENT = "id long, body string, path string, diff_hunk string"
QUERY = "query_id long, title string, tags array<string>, `limit` int"


def _ranked(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.id, r.score, r["rank"]))
    return out


def test_blocks_give_the_scores_of_all_postings(spark, tmp_path):
    from commentlake.plans.search import prepare_queries
    rows = _corpus(700)
    comments = spark.createDataFrame(rows, COMMENT)
    asked = {q: (random.Random(q).sample(WORDS, 1 + q % 4), [2, 5, 40, 150, 400][q % 5]) for q in range(40)}
    queries = prepare_queries(spark.createDataFrame([(q, " ".join(t), None, k) for q, (t, k) in asked.items()], QUERY))
    want = {q: _bm25(rows, t, 3 * k) for q, (t, k) in asked.items()}
    layout = postings.Layout(span=640, block_span=50, buckets=3)
    stored = postings.write_index(comments, f"{tmp_path}/index", layout, stemmer="porter")
    for index in (postings.build_index(comments), postings.build_index(comments, layout), stored):
        assert _ranked(postings.bm25_topk(queries, index)) == want
    assert _ranked(postings.bm25_topk(queries, stored, query_size=7)) == want
    flat = sorted(map(tuple, postings.flat_postings(comments).collect()))
    assert sorted(map(tuple, stored.postings.collect())) == flat
    # a stem stands for all its terms
    from commentlake.operators.stemming import porter_stem
    stem = {q: _bm25(rows, t, 3 * k, porter_stem) for q, (t, k) in asked.items()}
    got = _ranked(postings.bm25_topk(queries, stored, stemmer="porter"))
    assert got == stem and got != want
    vocab = {r.term: r.df for r in postings.stemmed_vocabulary(stored, "porter").collect()}
    assert vocab["run"] == sum(bool({"run", "runs", "running"} & set((b + " " + (h or "")).split())) for _, b, _, h in rows)
    # another session reads what was stored
    spark.sql(f"DROP TABLE {postings._table_name(f'{tmp_path}/index')}")
    assert _ranked(postings.bm25_topk(queries, postings.read_index(spark, f"{tmp_path}/index"))) == want


def test_blocks_below_the_kth_best_are_skipped(spark):
    rows = [(i, "needle " * (9 if i in (5, 450) else 1) + "alpha " * 3, None, None) for i in range(640)]
    index = postings.build_index(spark.createDataFrame(rows, COMMENT), postings.Layout(640, 10, 1))
    table = index.blocks.withColumn("as", F.col("term")).crossJoin(index.corpus.select("avgdl")).withColumn(
        "queries", F.lit(None).cast("array<int>")).toArrow()
    shard = postings.ShardRows(table, 0, 640)
    query = {"query_id": 1, "k": 2, "tags": None, "terms": [{"term": "needle", "idf": 1.5}, {"term": "alpha", "idf": 0.1}]}
    ids, scores = shard.top(query)
    assert ids.tolist() == [5, 450] and shard.skipped >= 60 and shard.skipped + shard.scored == 64
    every = postings.ShardRows(table, 0, 640)
    every.bound = every.bound + 1e9                          # no block can be skipped
    assert [x.tolist() for x in every.top(query)] == [ids.tolist(), scores.tolist()] and every.skipped == 0


def test_tag_bitmaps(spark, tmp_path):
    """Masks of sparse and dense ids, of tags with no documents, replaced in place."""
    from commentlake.plans.search import prepare_queries
    rows = _corpus(300, 3) + [(5_000_000, "alpha needle", None, None)]
    tags = spark.createDataFrame([(1, "odd"), (2, "rare"), (3, "none")], "id long, name string")
    pairs = [(i, 1, 0.5) for i, *_ in rows if i % 2] + [(r[0], 2, 0.5) for r in rows[::50]] + [(5_000_000, 2, 0.5)]
    assigned = spark.createDataFrame(pairs, "comment_id long, tag_id long, confidence double")
    index = postings.write_index(spark.createDataFrame(rows, COMMENT), f"{tmp_path}/index")
    asked = [(1, "alpha beta", ["odd"], 9), (2, "alpha needle", ["odd", "rare", "rare"], 9), (3, "alpha", ["none"], 9),
             (4, "alpha", ["unknown"], 9), (5, "alpha beta", None, 9)]
    queries = prepare_queries(spark.createDataFrame(asked, QUERY))
    by = {"odd": {c for c, t, _ in pairs if t == 1}, "rare": {c for c, t, _ in pairs if t == 2}}
    want = {}
    for q, t, names, k in asked:
        allowed = None if names is None else set().union(*(by.get(n, set()) for n in names))
        if ranked := _bm25(rows, t.split(), 3 * k, allowed=allowed):
            want[q] = ranked
    everything = spark.createDataFrame([(i, t, 0.1) for i, *_ in rows for t in (1, 2, 3)],
                                       "comment_id long, tag_id long, confidence double")
    index = postings.with_tags(postings.with_tags(index, everything), assigned)
    assert _ranked(postings.bm25_topk(queries, index, tags)) == want
    got = {(r.query_id, r.id) for r in fusion.tag_candidates(queries.where("restricted"), tags, index).collect()}
    assert got == {(q, i) for q, _, names, _ in asked for n in names or [] for i in by.get(n, ())}


def test_porter_examples():
    from commentlake.operators.stemming import porter_stem
    for a, b in [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"),
                 ("generalizations", "gener"), ("adjustment", "adjust"), ("sky", "sky")]:
        assert porter_stem(a) == b


def test_reembed_partition_overwrite(spark, tmp_path):
    from commentlake.operators import vectors as V
    c = spark.createDataFrame([(1, "alpha beta", None, None, None), (2, "gamma", "a/b.py", None, None)],
                              "id long, body string, path string, diff_hunk string, updated_at timestamp_ntz")
    path = str(tmp_path / "vec")
    V.write_embeddings(V.reembed(c, model="m1"), path)
    V.write_embeddings(V.reembed(c, model="m2"), path)
    V.write_embeddings(V.reembed(c.where("id = 1"), model="m1"), path)
    got = sorted((r.model, r.comment_id) for r in spark.read.parquet(path).collect())
    assert got == [("m1", 1), ("m2", 1), ("m2", 2)]
    v = V.read_embeddings(spark, path, "m2").collect()
    assert all(abs(sum(x * x for x in r.embedding) - 1.0) < 1e-5 for r in v)


def test_cosine_of_many_query_groups_equals_one(spark):
    """Several groups of queries and corpus blocks, broadcast or shuffled, ties,
    vectors of another dimension, limits above the corpus."""
    from commentlake.operators import vectors as V
    k = lambda i: [1, 5, 90][i % 3]
    q = spark.createDataFrame([(i, [1.0, float(i % 3)]) for i in range(30)] + [(77, None)], "query_id long, qvec array<float>")
    vecs = [(j, [float(j % 5), 1.0]) for j in range(50)] + [(60, [1.0]), (61, None)]
    vec = spark.createDataFrame(vecs, "comment_id long, embedding array<float>").repartition(5)
    kq = spark.createDataFrame([(i, k(i)) for i in range(30)], "query_id long, k int")
    want = []
    for i in range(30):
        scores = sorted((-(j % 5 + 1.0 * (i % 3)), j) for j in range(50))[:k(i)]
        want += [(i, j, -s, r + 1) for r, (s, j) in enumerate(scores)]
    one = sorted(map(tuple, V.cosine_topk(q, vec, kq).collect()))
    assert one == sorted(want)
    assert sorted(map(tuple, V.cosine_topk(q, vec, kq, query_size=4).collect())) == one
    assert sorted(map(tuple, V.cosine_topk(q, vec, kq, query_size=4, broadcast_bytes=0).collect())) == one


def test_cosine_under_tags(spark):
    from commentlake.operators import vectors as V
    vecs = [(j, [float(j % 5), 1.0]) for j in range(-10, 50)] + [(60, [1.0]), (61, None)]
    vec = spark.createDataFrame(vecs, "comment_id long, embedding array<float>")
    tags = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    pairs = [(j, 1, 0.5) for j in range(-10, 50, 3)] + [(j, 2, 0.5) for j in range(40, 70)]
    comments = spark.createDataFrame([(i, "x", None, None) for i in range(-10, 70)], COMMENT)
    index = postings.with_tags(postings.build_index(comments, postings.Layout(32, 8, 3)),
                               spark.createDataFrame(pairs, "comment_id long, tag_id long, confidence double"))
    names = {0: ["a"], 1: ["b", "a"], 2: ["c"]}
    q = spark.createDataFrame([(i, [1.0, 2.0], names[i % 3]) for i in range(9)], "query_id long, qvec array<float>, tags array<string>")
    kq = spark.createDataFrame([(i, 4 + i) for i in range(9)], "query_id long, k int")
    by = {"a": {c for c, t, _ in pairs if t == 1}, "b": {c for c, t, _ in pairs if t == 2}, "c": set()}
    want = []
    for i in range(9):
        ok = set().union(*(by[n] for n in names[i % 3]))
        best = sorted((-(j % 5 + 2.0), j) for j, v in vecs if j in ok and v and len(v) == 2)[:4 + i]
        want += [(i, j, -s, r + 1) for r, (s, j) in enumerate(best)]
    for size in (4096, 2):
        assert sorted(map(tuple, V.cosine_restricted(q, vec, index, tags, kq, size).collect())) == sorted(want)


def _clustered(seed, clusters=12, size=60, dim=16):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(clusters, dim))
    v = np.repeat(centers, size, axis=0) + 0.25 * rng.normal(size=(clusters * size, dim))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_ann_recall_and_share(spark):
    """On vectors with structure nearly all of the best are found in few cells; a cell
    in parts and groups of queries change nothing; all cells give the exact result."""
    from dataclasses import replace

    from commentlake.operators import vectors as V
    v = _clustered(3)
    vec = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(9000, None), (9001, [1.0])],
                                "comment_id long, embedding array<float>")
    q = spark.createDataFrame([(i, v[i * 20].tolist()) for i in range(30)] + [(99, None), (98, [1.0])], "query_id long, qvec array<float>")
    kq = spark.createDataFrame([(i, 10) for i in (*range(30), 98, 99)], "query_id long, k int")
    index = V.fit_cells(vec, n_cells=12, k=10)
    exact = {(r.query_id, r.id) for r in V.cosine_topk(q, vec, kq).collect() if r.query_id < 90}
    rows = V.ann_topk(q, index, kq).collect()
    found = {(r.query_id, r.id) for r in rows}
    total = index.sizes.agg(F.sum("n")).first()[0]
    looked = V.probed_cells(q, index).join(index.sizes, "cell").agg(F.sum("n")).first()[0]
    assert total == 720 and len(found & exact) >= 0.95 * len(exact) and looked <= 0.2 * 30 * total
    small = V.fit_cells(vec, n_cells=12, k=10, cell_rows=7)
    assert small.sizes.agg(F.max("parts")).first()[0] > 1
    assert sorted(map(tuple, V.ann_topk(q, small, kq, query_size=4).collect())) == sorted(map(tuple, rows))
    every = V.ann_topk(q, replace(index, probes=12), kq).collect()
    assert {(r.query_id, r.id) for r in every} == exact


def test_text_model(spark, tmp_path):
    """The stored model gives texts and queries the same vectors, by the written-out rule."""
    from commentlake.operators import vectors as V
    texts = [(1, "alpha beta beta"), (2, "Beta, gamma!"), (3, ""), (4, None), (5, "alpha")]
    df = spark.createDataFrame(texts, "query_id long, query_text string")
    V.write_text_model(spark, V.fit_text_model(df, "query_text", "m1", dim=8), str(tmp_path))
    model = V.read_text_model(spark, str(tmp_path), "m1")
    tokens = {i: re.findall("[a-z]+", (t or "").lower()) for i, t in texts}
    bucket = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 8
    df_ = [sum(any(bucket(t) == j for t in ts) for ts in tokens.values()) for j in range(8)]
    assert model.ndocs == 5 and np.allclose(model.idf, [math.log(6 / (n + 1)) + 1 for n in df_])
    got = {r.query_id: r.qvec for r in V.embed_queries(df, model).collect()}
    assert got[3] is None and got[4] is None
    for i in (1, 2, 5):
        want = np.zeros(8)
        for t in tokens[i]:
            want[bucket(t)] += model.idf[bucket(t)]
        assert np.allclose(got[i], want / np.linalg.norm(want), atol=1e-6)


def test_search_from_titles_alone(spark):
    from dataclasses import replace

    from commentlake.operators import vectors as V
    inp = _inputs(spark)
    comments = inp.comments.withColumn("updated_at", F.col("created_at"))
    model = V.fit_text_model(comments.select("body"), "body", dim=64)
    own = V.reembed(comments, model)
    inp = replace(inp, vectors=own.select("comment_id", "embedding"), model=model)
    q = _queries(spark, [(1, "payload validation", None, 3, None), (2, "   ", None, 3, None)]).drop("qvec")
    out = hybrid_search(q, inp).collect()
    assert {r.query_id for r in out} == {1} and min(out, key=lambda r: r["rank"]).id in (1, 3)
    assert {r.match_source for r in out} >= {"hybrid"}


def test_blocks_are_built_one_at_a_time(spark):
    """No aggregate holds the postings of a shard: each block's documents are counted by
    themselves; ids that come twice, empty and missing texts, rows without an id."""
    rows = [(i, " ".join(f"w{k % (1 + i % 7)}" for k in range(i % 13)), "a/b.py" if i % 2 else None, None) for i in range(-40, 700)]
    rows += [(5, "w0 w0 extra", None, "hunk"), (6, rows[46][1], rows[46][2], None), (None, "lost words", None, None), (900, None, None, None)]
    c = spark.createDataFrame(rows, "id long, body string, path string, diff_hunk string")
    layout = postings.Layout(span=200, block_span=16, buckets=5)
    blocks = postings.text_blocks(c, layout)
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Exchange") == 1
    want = sorted((r.term, r.id, r.tf, r.dl) for r in postings.flat_postings(c.where("id IS NOT NULL")).collect())
    kept = blocks.collect()
    got = sorted((r.term, *x) for r in kept if r.shard is not None for x in zip(r.ids, r.tf, r.dl, strict=True))
    assert got == want
    assert sorted((r.term, *r.ids, *r.tf, r.n) for r in kept if r.shard is None) == [("lost", None, 1, 1), ("words", None, 1, 1)]
    for r in kept:
        assert (r.n, r.tokens, r.max_tf, r.min_dl) == (len(r.tf), sum(r.tf), max(r.tf), min(r.dl))
        assert r.shard is None or (r.ids == sorted(r.ids) and {(i // 200, i % 200 // 16) for i in r.ids} == {(r.shard, r.block)})
