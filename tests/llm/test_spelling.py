"""Spelling variants against plain Python: all pairs, forms followed one by one."""

import random
import re
import zlib
from collections import Counter

import numpy as np

from commentlake.llm import spelling_variants as sv

from .conftest import odd_rows


def distance_is_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + (len(a) == len(b)):] == b[k + 1:]


def counted(rows):
    n = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(sv.UPPER, sv.LOWER))
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 5:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= 3}


def plain(n):
    near = {w: [x for x in n if distance_is_one(w, x)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def found(df):
    rows = df.collect()
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(got) == len(rows)
    return got


def dense(seed, size, letters="abcdé"):
    rng = random.Random(seed)
    return {"".join(rng.choices(letters, k=rng.choice([5, 5, 6, 6, 7, 9]))): rng.choice([3, 3, 4, 7, 20, 100])
            for _ in range(size)}


def test_scan_equals_all_pairs():
    words = sorted({w.encode("latin-1") for w in dense(1, 400, "abé")})
    queries = np.arange(0, len(words), 3)
    got = {(i, int(queries[q])) for i, qs in sv.scan(words, queries) for q in qs}
    want = {(i, q) for i, w in enumerate(words) for q in queries.tolist() if distance_is_one(w, words[q])}
    assert got == want and want


def test_variants_in_one_list_and_in_parted_lists(spark):
    n = dense(2, 600)
    n |= {"chain": 3, "chaint": 6, "chainty": 12, "chaintyx": 24, "chaintyxz": 48}      # a path of forms
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    want = plain(n)
    assert found(sv.variants(df)) == want
    assert found(sv.variants(df, group=12)) == want


def test_whole_query_on_odd_rows_and_the_table(spark, odd, none, tmp_path):
    odd.write.parquet(f"{tmp_path}/odd/documents.parquet")
    assert found(sv.op11_spelling_variants(spark, f"{tmp_path}/odd")) == plain(counted(odd_rows()))
    none.write.parquet(f"{tmp_path}/none/documents.parquet")
    assert sv.op11_spelling_variants(spark, f"{tmp_path}/none").count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    n = counted([tuple(r) for r in docs.collect()])
    assert found(sv.op11_spelling_variants(spark, "/root/testdata/sf0.001")) == plain(n)
