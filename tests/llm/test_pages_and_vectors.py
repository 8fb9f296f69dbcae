"""Operators on pages and vectors."""

import hashlib

import time

import numpy as np
import pytest

from commentlake.llm import embedding_dedup, html_extraction, warc

PAGES = "page_id long, url string, html string, payload string, `Head` int"
LONG = "<article>" + "<p>same page</p>" * 100 + "</article>"
ROWS = [(1, "http://a/1", LONG, "x", 1), (2, None, LONG, None, None), (3, "http://a/3\r\nX: y", LONG, "x", 1),
        (4, "http://b/4", None, "x", 1), (5, "http://b/5", "", "x", 1), (6, "", "short é", "x", 1),
        (7, "http://c", "short é", "x", 1), (None, "http://n", LONG, "x", 1), (3, "http://a/3", LONG, "x", 1),
        (8, "http://d", "\r\n\r\nWARC/1.1\r\n" * 3, "x", 1)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(ROWS, PAGES)


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_warc_round_trip(spark, pages, tmp_path, compression):
    path = f"file://{tmp_path}/w"
    warc.write_warc(warc.page_records(pages), path, compression=compression, maxfilebytes=2000)
    back = warc.read_warc(spark, path, bundlebytes=3000)
    rows = back.collect()
    assert len(rows) == len(ROWS)
    kinds = sorted((r.record_id, r.warc_type, r.refers_to) for r in rows if r.payload_length > 1000 and r.record_id)
    assert kinds == [("urn:page:1", "revisit", "urn:page:3"), ("urn:page:2", "revisit", "urn:page:3"),
                     ("urn:page:3", "response", None), ("urn:page:3", "response", None)]
    for r in rows:
        if r.warc_type == "response":
            assert hashlib.sha1(r.payload).hexdigest() == r.payload_digest and len(r.payload) == r.payload_length
        else:
            assert r.payload is None and r.payload_length == len(LONG)
    assert back.filter("warc_type = 'revisit'").count() == 2
    assert back.filter("target_uri LIKE 'http://a%' AND warc_type IN ('response')").count() == 2
    assert back.filter("content_length > 1000 AND length(payload) > 10").count() == 3


def test_warc_pushdown_skips_payloads(spark, pages, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/w"
    warc.write_warc(warc.page_records(pages), path)
    reader = warc.WarcReader(path, 1 << 20)
    left = list(reader.pushFilters([warc.EqualTo(("warc_type",), "revisit"), warc.EqualTo(("payload",), b"")]))
    assert len(left) == 1
    seen = []
    monkeypatch.setattr(warc, "parsed", lambda head, block, f=warc.parsed: seen.append(head) or f(head, block))
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 2 and len(seen) == 2
    plan = warc.read_warc(spark, path).filter("warc_type = 'revisit'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("PushedFilters", "").replace("pushFilters", "") or "warc_type" in plan


def test_warc_damage_is_an_error(spark, pages, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_warc(warc.page_records(pages.limit(1)), path, compression="none")
    file = next((tmp_path / "w").glob("*.warc"))
    file.write_bytes(file.read_bytes()[:-300])
    with pytest.raises(Exception, match="truncated"):
        warc.read_warc(spark, path).collect()


def test_warc_of_no_pages(spark, pages, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_warc(warc.page_records(pages.limit(0)), path)
    assert warc.read_warc(spark, path).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>No title</title><style>p{}</style></head><body class="home">
<header><a href=/>Site name</a></header><nav><ul><li><a href="/a">Menu one</a><li><a href="/b">Menu two</a></ul></nav>
<div class="cookie-notice">We use cookies. <button>OK</button></div><script>var t="</p>";</script>
<article><h1>Main &amp; only   title</h1><p>First <b>bold</b> paragraph &eacute;&#233; of the story,
with a line break.<br>And more.<p>Second paragraph, <a href="/x">with a link</a> inside of it. A &lt; B.</p>
<div class="ad">Buy now, buy cheap.</div><form><input name=q><label>Search here</label></form>
<ul><li>An item of the story.</li><li>Another item of the story.</li></ul>
<section class="comments"><p>A reader says that this is a nice comment.</p></section></article>
<aside><p>Related: ten other stories that you may like to read.</p></aside>
<footer><p>&copy; Someone</p></footer></body></html>"""
TEXT = ("Main & only title\nFirst bold paragraph éé of the story, with a line break. And more.\n"
        "Second paragraph, with a link inside of it. A < B.\nAn item of the story.\nAnother item of the story.")


def test_html_extraction(spark, pages):
    w = html_extraction.train(spark.createDataFrame([(k, PAGE) for k in range(5)], "page_id long, html string"))
    assert html_extraction.content(PAGE, w) == TEXT
    assert html_extraction.content("<p>open <div class='x", 0 * w) == "open <div class='x"
    got = {r.page_id: r.text for r in html_extraction.extract(pages, html_extraction.train(pages)).collect()}
    assert got[4] == got[5] == "" and got[3] == "\n".join(["same page"] * 100)
    assert html_extraction.extract(pages.limit(0), html_extraction.train(pages.limit(0))).count() == 0


def test_minimum_cut_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(1, 9))
        u = rng.normal(0, 2, n)
        edges = [(a, b, float(rng.random())) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]

        def cost(keep, u=u, edges=edges):
            return sum(max(x, 0) if not k else max(-x, 0) for x, k in zip(u, keep, strict=True)) + \
                sum(c for a, b, c in edges if keep[a] != keep[b])

        best = min(cost([m >> k & 1 for k in range(n)]) for m in range(1 << n))
        assert abs(cost(html_extraction.min_cut(u, edges)) - best) < 1e-9


def test_long_page_is_whole():
    page = "<article>" + "".join(f"<p>Paragraph number {k} of a long page.</p>" for k in range(20_000)) + "</article>"
    w = np.zeros(len(html_extraction.FEATURES))
    assert html_extraction.content(page, w).count("\n") == 19_999


def brute_links(vectors):
    out = []
    for v in vectors:
        ok = v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        out.append(np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok else None)
    return np.array([[a is not None and b is not None and len(a) == len(b) and i != j and a @ b >= 0.95
                      for j, b in enumerate(out)] for i, a in enumerate(out)])


def test_vectors_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 16))
    vectors = [(c + rng.normal(scale=s, size=16)).astype(np.float32).tolist() for c in centres for s in np.linspace(0, 0.4, 60)]
    vectors += [vectors[3]] * 40 + [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [1.0, 2.0], [2.0, 4.0]]
    ids = rng.permutation(len(vectors)).tolist()
    df = spark.createDataFrame(list(zip(ids, vectors, strict=True)), "vec_id long, embedding array<float>")
    links = brute_links(vectors)
    comp = {i: i for i in ids}
    for a, b in np.argwhere(links):
        x, y = comp[ids[a]], comp[ids[b]]
        if x != y:
            comp = {i: min(x, y) if c in (x, y) else c for i, c in comp.items()}
    want = {i: (int(links[k].sum()), comp[i]) for k, i in enumerate(ids)}
    for block in (1024, 16):                        # 16: buckets in several parts
        got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(df, miss=1e-9, block=block).collect()}
        assert got == want
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in embedding_dedup.near_vectors(odd).collect()) == \
        [("1", 1, "1"), ("1", 1, "1"), ("None", 0, "None")]


def test_vector_recall_on_the_table(spark):
    d = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").orderBy("vec_id").collect()
    links = brute_links([r.embedding for r in rows])
    got = {r.vec_id: r.n_links for r in embedding_dedup.op7_embedding_dedup(spark, d).collect()}
    found = sum(min(got[r.vec_id], int(links[k].sum())) for k, r in enumerate(rows))
    assert found >= 0.999 * links.sum()


def test_open_heads_and_layout_wrappers_keep_the_article(spark):
    w = html_extraction.train(spark.createDataFrame([(k, PAGE) for k in range(5)], "page_id long, html string"))
    assert html_extraction.content(PAGE.replace("</head>", ""), w) == TEXT
    assert html_extraction.content(PAGE.replace("</head>", "").replace('<body class="home">', ""), w) == TEXT
    for begin, end in (('<div class="has-sidebar">', "</div>"), ('<div id="no-sidebar">', "</div>"),
                       ('<div class="with-header">', "</div>"), ('<div class="menu">', "</div>"),
                       ('<div class="search"><div class="share">', "</div></div>"), ("<form action=/>", "</form>")):
        page = PAGE.replace('<body class="home">', '<body class="home">' + begin).replace("</body>", end + "</body>")
        assert html_extraction.content(page, w) == TEXT, begin
        page = PAGE.replace("<article>", begin + "<article>").replace("</article>", "</article>" + end)
        assert html_extraction.content(page, w) == TEXT, begin
    assert all(abs(b.prior) < html_extraction.RANGE for b in html_extraction.blocks_of(PAGE))


def test_deep_and_broken_pages_take_time_in_proportion():
    """Elements left open, end tags of none, unending inline elements."""
    w = np.zeros(len(html_extraction.FEATURES))
    for soup in ("<div>x", "<div class='post a'>x", "<b>x</i>", "<div><b>x</span><h1>y", "<ul><li>x<table><td>y"):
        start = time.monotonic()
        text = html_extraction.content(soup * 100_000, w)
        assert time.monotonic() - start < 20 and len(text) >= 100_000


def test_shared_path_of_neighbours():
    """Strength of an edge: block elements that two neighbours share, of the deeper one's."""
    blocks = html_extraction.blocks_of("<div><section><p>a<p>b</section><p>c</div>d")
    assert [b.text for b in blocks] == ["a", "b", "c", "d"] and [b.node.depth for b in blocks] == [3, 3, 2, 0]
    near = {(a, b): c for a, b, c in html_extraction.smoothness(blocks)}
    assert near == {(0, 1): 0.2 + 0.8 * 2 / 3, (1, 2): 0.2 + 0.8 * 1 / 3, (2, 3): 0.2, }
