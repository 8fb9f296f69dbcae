"""Registered queries: one per SURVEY 2 operator id, each reading the driver's
test tables through ``commentlake.sources.bindings``, plus the equivalent
DuckDB SQL used as the correctness oracle.

``REGISTRY[name] = (fn(spark, sf_dir) -> DataFrame, oracle_sql or None)``.
Outputs are projected to scalar columns (arrays joined into strings, scores
rounded or summed as decimals) so both engines hash the same values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.rows import compared
from ..operators import stats, tagging
from ..operators import upsert as upsert_rules
from ..sources import fixture_rules
from ..sources.bindings import PART_IDS, tables
from . import oracle as O

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        text = sql
        if text and not text.lstrip().startswith("WITH"):
            text = O.with_views(text)
        REGISTRY[name] = (fn, text)
        return fn
    return deco


NL = "chr(10)"


# =========================== E: statistics ==================================
# Statistics read the stored knowledge base (comments, tags, assignments
# written once per session under the shared checkpoint folder).
@register("e01_counts", """
SELECT 'pull_requests' AS "table", count(*) AS "rows" FROM prs_v
UNION ALL SELECT 'reviews', count(*) FROM reviews_v
UNION ALL SELECT 'comments', count(*) FROM comments_v
UNION ALL SELECT 'comment_embeddings', count(*) FROM embeddings_v
UNION ALL SELECT 'comment_tags', count(*) FROM comment_tags_v
UNION ALL SELECT 'tags', count(*) FROM tags_v""")
def e01_counts(spark, d):
    t = tables(spark, d)
    return stats.table_counts({"pull_requests": t.prs, "reviews": t.reviews, "comments": t.kb_comments,
                               "comment_embeddings": t.embeddings, "comment_tags": t.kb_comment_tags,
                               "tags": t.kb_tags})


@register("e02_prs_by_repo", "SELECT repo, count(*) AS count FROM prs_v GROUP BY repo")
def e02_prs_by_repo(spark, d):
    return stats.prs_by_repo(tables(spark, d).prs)


@register("e03_comments_by_repo", "SELECT repo, count(*) AS count FROM comments_v GROUP BY repo")
def e03_comments_by_repo(spark, d):
    return stats.comments_by_repo(tables(spark, d).kb_comments)


@register("e04_top_reviewers", """
SELECT user_login, count(*) AS count FROM comments_v GROUP BY user_login
ORDER BY count DESC, user_login LIMIT 10""")
def e04_top_reviewers(spark, d):
    return stats.top_reviewers(tables(spark, d).kb_comments)


@register("e05_date_range",
          "SELECT min(created_at) AS oldest, max(created_at) AS newest FROM comments_v")
def e05_date_range(spark, d):
    return stats.date_range(tables(spark, d).kb_comments)


_TOTALS = [("pull_requests", "count(*)", "prs_v"), ("reviews", "count(*)", "reviews_v"),
           ("comments", "count(*)", "comments_v"), ("comment_embeddings", "count(*)", "embeddings_v"),
           ("tagged_assignments", "count(*)", "comment_tags_v"),
           ("tagged_comments", "count(DISTINCT comment_id)", "comment_tags_v"), ("tags", "count(*)", "tags_v")]


@register("e06_stats", "\nUNION ALL ".join(
    [f"""SELECT 'total' AS "section", '{k}' AS "key", {n} AS "count", CAST(NULL AS TIMESTAMP) AS "time" FROM {v}"""
     for k, n, v in _TOTALS]
    + ["SELECT 'date', 'oldest', NULL, min(created_at) FROM comments_v",
       "SELECT 'date', 'newest', NULL, max(created_at) FROM comments_v",
       "SELECT 'prs_by_repo', repo, count(*), NULL FROM prs_v GROUP BY repo",
       "SELECT 'comments_by_repo', repo, count(*), NULL FROM comments_v GROUP BY repo",
       """SELECT 'top_reviewers', user_login, n, NULL FROM (
  SELECT user_login, count(*) AS n FROM comments_v GROUP BY user_login ORDER BY n DESC, user_login LIMIT 10)"""]))
def e06_stats(spark, d):
    t = tables(spark, d)
    return stats.kb_stats(t.prs, t.reviews, t.kb_comments, t.embeddings, t.kb_comment_tags, t.kb_tags)


# =========================== C: anti-joins, tag dimension ====================
@register("c01_unembedded",
          "SELECT c.id FROM comments_v c ANTI JOIN embeddings_v e ON e.comment_id = c.id")
def c01_unembedded(spark, d):
    t = tables(spark, d)
    return stats.unembedded(t.kb_comments, t.embeddings).select("id")


@register("c02_untagged",
          "SELECT c.id FROM comments_v c ANTI JOIN comment_tags_v t ON t.comment_id = c.id")
def c02_untagged(spark, d):
    t = tables(spark, d)
    return stats.untagged(t.kb_comments, t.kb_comment_tags).select("id")


@register("c06_tag_counts", """
SELECT t.name, t.description, CAST(count(ct.comment_id) AS BIGINT) AS count
FROM tags_v t LEFT JOIN comment_tags_v ct ON ct.tag_id = t.id
GROUP BY t.id, t.name, t.description""")
def c06_tag_counts(spark, d):
    t = tables(spark, d)
    return stats.tags_with_counts(t.kb_tags, t.kb_comment_tags)


@register("a15_ids", "SELECT id FROM comments_v")
def a15_ids(spark, d):
    """All comment ids (column-pruned scan)."""
    return tables(spark, d).comments.select("id")


# =========================== B: scalar functions ============================
@register("b01_embed_text", f"""
SELECT id, concat_ws({NL},
         CASE WHEN path <> '' THEN 'File: ' || path END,
         coalesce(body, ''),
         CASE WHEN diff_hunk <> '' THEN 'Code context:' || {NL} || diff_hunk END) AS embed_text
FROM comments_v""")
def b01_embed_text(spark, d):
    c = tables(spark, d).comments
    return c.select("id", tx.embed_text("path", "body", "diff_hunk").alias("embed_text"))


def _b02_inputs(c: DataFrame) -> DataFrame:
    return c.select(
        "id", F.col("user_login").alias("title"),
        F.when(F.col("path").isNotNull(), F.array(F.col("path"), F.concat(F.col("repo"), F.lit("/"), F.col("path"))))
         .alias("paths"),
        F.col("body").alias("diff"),
        F.split(F.coalesce(F.col("diff_hunk"), F.lit("")), "\n").alias("commits"))


_B02_INPUTS_SQL = """
SELECT id, user_login AS title,
       CASE WHEN path IS NOT NULL THEN [path, repo || '/' || path] END AS paths,
       body AS diff, string_split(coalesce(diff_hunk, ''), chr(10)) AS commits
FROM comments_v"""


@register("b02_query_text", f"""
SELECT id, array_to_string(list_concat(
         [NULLIF(title, '')],
         coalesce(flatten(list_transform(paths, lambda p: [p, NULLIF({O.dirname_sql('p')}, '')])), []),
         [NULLIF(diff, '')],
         coalesce(commits, [])), {NL}) AS query_text
FROM ({_B02_INPUTS_SQL}) q""")
def b02_query_text(spark, d):
    q = _b02_inputs(tables(spark, d).comments)
    return q.select("id", tx.query_text("title", "paths", "diff", "commits").alias("query_text"))


@register("b03_dirname", f"SELECT id, {O.dirname_sql('path')} AS dirname FROM comments_v")
def b03_dirname(spark, d):
    return tables(spark, d).comments.select("id", tx.dirname("path").alias("dirname"))


@register("b04_terms", f"""
SELECT c.id, coalesce(string_agg(t.term, ',' ORDER BY t.pos), '') AS terms
FROM comments_v c LEFT JOIN ({O.terms_sql('comments_v', 'id', 'body')}) t ON t.id = c.id
GROUP BY c.id""")
def b04_terms(spark, d):
    c = tables(spark, d).comments
    return c.select("id", F.array_join(tx.search_terms("body"), ",").alias("terms"))


_B05_CLEAN = ("regexp_replace(regexp_replace(coalesce(body, ''), '!\\[.*?\\]\\(.*?\\)', '[image]', 'g'), "
              f"{O._q('https?://' + tx.NON_WS + '{80,}')}, '[long-url]', 'g')")


_B05_CTES = [
    ("l", f"""
  SELECT id, unnest(string_split({O.strip_sql(_B05_CLEAN)}, chr(10))) AS line,
         generate_subscripts(string_split({O.strip_sql(_B05_CLEAN)}, chr(10)), 1) AS i
  FROM comments_v"""),
    ("c", """
  SELECT id, line, i,
         coalesce(sum(length(line)) OVER (PARTITION BY id ORDER BY i
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM l"""),
    ("k", f"SELECT id, min(i) FILTER (WHERE before + length(line) > {tx.SUMMARY_MAX_CHARS}) AS cut FROM c GROUP BY id"),
]


@register("b05_summary", O.with_views(f"""
SELECT c.id, string_agg(CASE WHEN k.cut IS NULL OR c.i < k.cut THEN c.line
                             ELSE substring(c.line, 1, CAST({tx.SUMMARY_MAX_CHARS} - c.before AS BIGINT)) || '...' END,
                        ' ' ORDER BY c.i) AS summary
FROM c JOIN k ON k.id = c.id
WHERE k.cut IS NULL OR c.i <= k.cut
GROUP BY c.id""", extra=_B05_CTES))
def b05_summary(spark, d):
    """Summaries of every comment body."""
    c = tables(spark, d).comments
    return c.select("id", tx.summarize_body("body").alias("summary"))


@register("b06_truncate_hunk", f"""
SELECT id, CASE WHEN len(string_split({O.strip_sql('diff_hunk')}, {NL})) <= {tx.HUNK_MAX_LINES}
                THEN {O.strip_sql('diff_hunk')}
                ELSE array_to_string(string_split({O.strip_sql('diff_hunk')}, {NL})[1:{tx.HUNK_MAX_LINES}], {NL})
                     || {NL} || '  ...' END AS hunk
FROM comments_v WHERE diff_hunk IS NOT NULL""")
def b06_truncate_hunk(spark, d):
    c = tables(spark, d).comments.where(F.col("diff_hunk").isNotNull())
    return c.select("id", tx.truncate_hunk("diff_hunk").alias("hunk"))


@register("b07_location", """
SELECT id, CASE WHEN path IS NOT NULL AND path <> ''
                THEN CASE WHEN coalesce(line, 0) <> 0 THEN path || ':' || line ELSE path END END AS location,
       strftime(created_at, '%Y-%m-%d') AS day
FROM comments_v""")
def b07_location(spark, d):
    c = tables(spark, d).comments
    return c.select("id", tx.location("path", "line").alias("location"), tx.day("created_at").alias("day"))


@register("b09_parse_tags", f"""
SELECT id, array_to_string(list_transform(string_split(body, ','),
                                          lambda x: {O.strip_sql('x')}), '|') AS tags
FROM comments_v""")
def b09_parse_tags(spark, d):
    c = tables(spark, d).comments
    return c.select("id", F.array_join(tx.parse_tags("body"), "|").alias("tags"))


@register("b10_clamp", """
SELECT id, CASE WHEN n IS NULL THEN 15 ELSE greatest(1, least(n, 100)) END AS clamped,
       coalesce(NULLIF(n, 0), 15) AS effective
FROM (SELECT id, CAST(CASE WHEN line IS NOT NULL THEN (id % 211) - 50 END AS INTEGER) AS n FROM comments_v)""")
def b10_clamp(spark, d):
    c = tables(spark, d).comments
    n = F.when(F.col("line").isNotNull(), (F.col("id") % 211) - 50).cast("int")
    return c.select("id", n.alias("n")).select(
        "id", tx.clamp_limit("n").alias("clamped"), tx.effective_limit("n").alias("effective"))


@register("b12_normalize", """
SELECT comment_id, round(v[1], 6) AS c1, round(v[len(v)], 6) AS c_last,
       round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS norm
FROM (SELECT comment_id, list_transform(embedding::DOUBLE[],
             lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y)))) AS v
      FROM embeddings_v)""")
def b12_normalize(spark, d):
    from ..functions.vectors import l2_normalize
    e = tables(spark, d).embeddings
    v = e.select("comment_id", l2_normalize("embedding").alias("v"))
    return v.select("comment_id", F.round(F.col("v")[0], 6).alias("c1"),
                    F.round(F.element_at("v", -1), 6).alias("c_last"),
                    F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), 6).alias("norm"))


def _wordset_sql(x: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower(coalesce({x}, '')), {O._q(O.WS + '+')}), lambda w: w <> ''))"


@register("b13_word_set", f"""
SELECT id, CAST(len(ws) AS INTEGER) AS n_words, array_to_string(list_sort(ws), ' ') AS words
FROM (SELECT id, {_wordset_sql('body')} AS ws FROM comments_v)""")
def b13_word_set(spark, d):
    c = tables(spark, d).comments.select("id", tx.word_set("body").alias("ws"))
    return c.select("id", F.size("ws").alias("n_words"), F.array_join(F.array_sort("ws"), " ").alias("words"))


@register("b14_jaccard", f"""
SELECT a.id, round(CASE WHEN len(a.ws) > 0 AND len(b.ws) > 0
                        THEN len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws))) END, 9) AS jaccard
FROM (SELECT id, {_wordset_sql('body')} AS ws FROM comments_v) a
JOIN (SELECT id, {_wordset_sql('body')} AS ws FROM comments_v) b ON b.id = a.id + 1""")
def b14_jaccard(spark, d):
    """B14 on each comment and its successor id (a linear equi-join)."""
    c = tables(spark, d).comments.select("id", tx.word_set("body").alias("ws"))
    nxt = c.select((F.col("id") - 1).alias("id"), F.col("ws").alias("ws2"))
    return c.join(nxt, "id").select("id", F.round(tx.jaccard("ws", "ws2"), 9).alias("jaccard"))


@register("b15_json", """
SELECT id, to_json(struct_pack(id := id, repo := repo, pr_number := pr_number, user := user_login)) AS doc
FROM comments_v""")
def b15_json(spark, d):
    c = tables(spark, d).comments
    return c.select("id", tx.to_json_doc("id", "repo", "pr_number", F.col("user_login").alias("user")).alias("doc"))


# =========================== D: tagging =====================================
_OLD_TAGS_SQL = O.tags_values_sql(fixture_rules.TEST_RULES_OLD)


def _rule_tags_values(rules) -> str:
    rows = ", ".join(f"({i}, {O._q(n)}, {O._q(dd)})" for i, (n, dd) in enumerate(tagging.rule_tags(rules)))
    return f"SELECT * FROM (VALUES {rows}) t(ordinal, name, description)"


_SEEDED_SQL = f"""
SELECT id, name, description FROM ({_OLD_TAGS_SQL})
UNION ALL
SELECT CAST((SELECT max(id) FROM ({_OLD_TAGS_SQL})) + row_number() OVER (ORDER BY ordinal) AS BIGINT) AS id,
       name, description
FROM ({_rule_tags_values(fixture_rules.TEST_RULES)}) r
WHERE name NOT IN (SELECT name FROM ({_OLD_TAGS_SQL}))"""

# existing assignments: old rules, confidence 1.0 (confirmed by hand)
_EXISTING_SQL = f"""
SELECT m.comment_id, t.id AS tag_id, CAST(1.0 AS DOUBLE) AS confidence
FROM ({O.tag_scores_sql(fixture_rules.TEST_RULES_OLD)}) m JOIN ({_OLD_TAGS_SQL}) t ON t.name = m.tag"""


def _old_state(spark, d):
    t = tables(spark, d)
    old_tags = tagging.seed_tags(None, fixture_rules.TEST_RULES_OLD, spark)
    m = tagging.match_rules(t.kb_comments, fixture_rules.TEST_RULES_OLD)
    ot = old_tags.select(F.col("id").alias("tag_id"), F.col("name").alias("tag"))
    existing = (m.join(F.broadcast(ot), "tag")
                .select("comment_id", "tag_id", F.lit(1.0).alias("confidence")))
    return old_tags, existing


@register("d01_seed_tags", f"""
WITH old AS (
  SELECT row_number() OVER (ORDER BY name) AS id, name, description FROM (
    SELECT 'lang-' || lang AS name, count(*) || ' documents' AS description
    FROM documents WHERE lang IS NOT NULL GROUP BY lang))
SELECT id, name, description FROM old
UNION ALL
SELECT CAST((SELECT coalesce(max(id), 0) FROM old) + row_number() OVER (ORDER BY ordinal) AS BIGINT), name, description
FROM ({_rule_tags_values(fixture_rules.TEST_RULES)}) r WHERE name NOT IN (SELECT name FROM old)""")
def d01_seed_tags(spark, d):
    """Existing tags are the languages that the documents have."""
    langs = (tables(spark, d).raw("documents").where(F.col("lang").isNotNull())
             .groupBy(F.concat(F.lit("lang-"), "lang").alias("name"))
             .agg(F.concat(F.count(F.lit(1)).cast("string"), F.lit(" documents")).alias("description")))
    old = langs.select(F.row_number().over(Window.orderBy("name")).cast("long").alias("id"), "name", "description")
    return tagging.seed_tags(old, fixture_rules.TEST_RULES, spark)


@register("d02_match", O.tag_scores_sql(fixture_rules.TEST_RULES))
def d02_match(spark, d):
    return tagging.match_rules(tables(spark, d).kb_comments, fixture_rules.TEST_RULES)


_MATCH_IDS_SQL = f"""
SELECT m.comment_id, s.id AS tag_id, m.confidence
FROM ({O.tag_scores_sql(fixture_rules.TEST_RULES)}) m JOIN ({_SEEDED_SQL}) s ON s.name = m.tag"""


# rules of other shapes, each with its DuckDB spelling (RE2 has ASCII-only \\b and \\w)
_NWB, _NWE, _W = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])", r"[\p{L}\p{N}_]"
_TABLE_RULES = [
    ("notice", "body", r"\blicen[cs]ed?\b", rf"{_NWB}licen[cs]ed?{_NWE}"),
    ("notice", "hunk", r"\ball rights\b", rf"{_NWB}all rights{_NWE}"),
    ("prefix", "body", r"\bunder\w+", rf"{_NWB}under{_W}+"),
    ("prefix", "path", r"^\w+\.example", rf"^{_W}+\.example"),
    ("span", "body", r"the .* and .* that", "the .* and .* that"),
    ("span", "hunk", r"version \d+\.\d+", r"version [0-9]+\.[0-9]+"),
    ("choice", "body", r"general public|mit license|\bheit\b", rf"general public|mit license|{_NWB}heit{_NWE}"),
    ("choice", "path", r"/(?:en|fr)/\d{2,}", "/(?:en|fr)/[0-9]{2,}"),
    ("accent", "body", r"\bété\b|ción\b", rf"{_NWB}été{_NWE}|ción{_NWE}"),
]


@register("d02_rules_table", O.tag_scores_sql([tagging.Rule(t, "", f, sql) for t, f, _, sql in _TABLE_RULES]))
def d02_rules_table(spark, d):
    """D2 with the rules of a table: boundaries, classes, spans, alternatives."""
    table = tagging.rules_table(spark, [tagging.Rule(t, "", f, p) for t, f, p, _ in _TABLE_RULES])
    return tagging.match_rules(tables(spark, d).kb_comments, table)


@register("d03_assign", f"""
SELECT * FROM ({_EXISTING_SQL})
UNION ALL
SELECT n.* FROM ({_MATCH_IDS_SQL}) n
ANTI JOIN ({_EXISTING_SQL}) e ON e.comment_id = n.comment_id AND e.tag_id = n.tag_id""")
def d03_assign(spark, d):
    old_tags, existing = _old_state(spark, d)
    tags2 = tagging.seed_tags(old_tags, fixture_rules.TEST_RULES, spark)
    matches = tagging.match_rules(tables(spark, d).kb_comments, fixture_rules.TEST_RULES)
    return tagging.assign_tags(existing, matches, tags2)


@register("d04_tag_untagged", f"""
SELECT * FROM ({_EXISTING_SQL})
UNION ALL
SELECT n.* FROM ({_MATCH_IDS_SQL}) n
WHERE n.comment_id NOT IN (SELECT comment_id FROM ({_EXISTING_SQL}))""")
def d04_tag_untagged(spark, d):
    old_tags, existing = _old_state(spark, d)
    _, ct = tagging.tag_comments(tables(spark, d).kb_comments, existing, old_tags,
                                 fixture_rules.TEST_RULES, mode="untagged")
    return ct


@register("d05_retag", f"SELECT * FROM ({_MATCH_IDS_SQL})")
def d05_retag(spark, d):
    old_tags, _ = _old_state(spark, d)
    _, ct = tagging.retag_all(tables(spark, d).kb_comments, old_tags, fixture_rules.TEST_RULES)
    return ct


# =========================== F / C: search =====================================
def _search(spark, d):
    """Search reads the stored knowledge base (comments, tags, assignments,
    index) the way the reference reads its database; building them is
    measured by their own queries (d05_retag, f02_postings)."""
    from .search import SearchInputs
    t = tables(spark, d)
    key = "_search_inputs"
    if key not in t.__dict__:
        t.__dict__[key] = SearchInputs(
            comments=t.kb_comments, index=t.stored_index(),
            vectors=t.embeddings.select("comment_id", "embedding"),
            tags=t.kb_tags, comment_tags=t.kb_comment_tags)
    return t.__dict__[key]


def _prepared(spark, d):
    from .search import prepare_queries
    return prepare_queries(tables(spark, d).queries)


def _unrestricted(q):
    return q.withColumn("restricted", F.lit(False))


@register("f02_postings", O.search_sql("""
SELECT p.term, p.id, p.tf, d.dl FROM post p JOIN doclen d ON d.id = p.id"""))
def f02_postings(spark, d):
    from ..operators import postings
    return postings.flat_postings(tables(spark, d).kb_comments)


@register("f02_corpus_stats", O.search_sql("SELECT ndocs, CAST(total_len AS BIGINT) AS total_len, avgdl FROM corpus"))
def f02_corpus_stats(spark, d):
    from ..operators import postings
    return postings.build_index(tables(spark, d).kb_comments).corpus


@register("f03_bm25", O.search_sql("""
SELECT s.query_id, s.id, s.score,
       CAST(row_number() OVER (PARTITION BY s.query_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
FROM (SELECT query_id, id,
             CAST((sum(CAST(floor(c * CAST(1000000000000 AS DOUBLE)) AS BIGINT)) + 500) // 1000 AS DOUBLE)
               / CAST(1000000000 AS DOUBLE) AS score
      FROM contrib GROUP BY query_id, id) s
JOIN q ON q.query_id = s.query_id
QUALIFY rank <= q.k"""))
def f03_bm25(spark, d):
    from ..operators import postings
    q = _unrestricted(_prepared(spark, d))
    return postings.bm25_topk(q, tables(spark, d).stored_index())


@register("f04_bm25_tagged", O.search_sql("SELECT query_id, id, score, rank FROM bm25"))
def f04_bm25_tagged(spark, d):
    from .search import ranked_lists
    return ranked_lists(tables(spark, d).queries, _search(spark, d)).fts


@register("f05_cosine", O.search_sql("""
SELECT s.query_id, s.id, s.score,
       CAST(row_number() OVER (PARTITION BY s.query_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
FROM (SELECT q.query_id, e.comment_id AS id, q.k,
             round(list_dot_product(q.qvec::DOUBLE[], e.embedding::DOUBLE[]), 9) AS score
      FROM q JOIN embeddings_v e ON q.qvec IS NOT NULL) s
QUALIFY rank <= s.k"""))
def f05_cosine(spark, d):
    from ..operators import vectors
    q = _prepared(spark, d)
    vecs = tables(spark, d).embeddings.select("comment_id", "embedding")
    return vectors.cosine_topk(q, vecs, q.select("query_id", "k"))


@register("f06_cosine_tagged", O.search_sql("""
SELECT c.query_id, c.id, c.score, c.rank FROM cosine c JOIN q ON q.query_id = c.query_id
WHERE q.restricted"""))
def f06_cosine_tagged(spark, d):
    from ..operators import vectors
    s = _search(spark, d)
    q = _prepared(spark, d).where(F.col("restricted"))
    return vectors.cosine_restricted(q, s.vectors, s.index, s.tags, q.select("query_id", "k"))


@register("f07_rrf", O.search_sql("SELECT query_id, id, score, match_source, rank FROM rrf"))
def f07_rrf(spark, d):
    from ..operators import fusion
    from .search import ranked_lists
    r = ranked_lists(tables(spark, d).queries, _search(spark, d))
    return fusion.rrf(r.fts, r.vec, r.queries.select("query_id", "lim"), max_k=r.stats.max_k)


def _hybrid(spark, d):
    from .search import hybrid_search
    return hybrid_search(tables(spark, d).queries, _search(spark, d))


@register("f08_hybrid", O.search_sql("""
SELECT r.query_id, r.rank, r.id, r.score, r.match_source, c.user_login, coalesce(tn.tags, '') AS tags
FROM rrf r JOIN comments_v c ON c.id = r.id LEFT JOIN tagnames tn ON tn.id = r.id"""))
def f08_hybrid(spark, d):
    h = _hybrid(spark, d)
    return h.select("query_id", "rank", "id", "score", "match_source", "user_login",
                    F.array_join("tags", ",").alias("tags"))


@register("f08_wide_limits", O.wide_search_sql("""
SELECT r.query_id, r.rank, r.id, r.score, r.match_source, c.user_login, coalesce(tn.tags, '') AS tags
FROM rrf r JOIN comments_v c ON c.id = r.id LEFT JOIN tagnames tn ON tn.id = r.id"""))
def f08_wide_limits(spark, d):
    """F8 with limits from 5 to 400."""
    from .search import hybrid_search
    h = hybrid_search(tables(spark, d).wide_queries, _search(spark, d))
    return h.select("query_id", "rank", "id", "score", "match_source", "user_login",
                    F.array_join("tags", ",").alias("tags"))


@register("c03_tag_candidates", O.search_sql("SELECT query_id, id FROM cands"))
def c03_tag_candidates(spark, d):
    from ..operators import fusion
    s = _search(spark, d)
    return fusion.tag_candidates(_prepared(spark, d).where(F.col("restricted")), s.tags, s.index)


@register("c04_hydrate", O.search_sql("""
SELECT s.query_id, s.rank, s.id, c.user_login, c.repo
FROM (SELECT q.query_id, e.comment_id AS id,
             CAST(row_number() OVER (PARTITION BY q.query_id
                  ORDER BY round(list_dot_product(q.qvec::DOUBLE[], e.embedding::DOUBLE[]), 9) DESC, e.comment_id) AS INTEGER) AS rank,
             q.k
      FROM q JOIN embeddings_v e ON q.qvec IS NOT NULL
      QUALIFY rank <= q.k) s
JOIN comments_v c ON c.id = s.id"""))
def c04_hydrate(spark, d):
    from ..operators import fusion
    from ..operators import postings
    stats = postings.query_stats(_prepared(spark, d))
    ranked = fusion.hydrate(f05_cosine(spark, d), tables(spark, d).kb_comments, bound=stats.queries * stats.max_k)
    return ranked.select("query_id", "rank", "id", "user_login", "repo")


@register("c05_tags_for", O.search_sql("""
SELECT c.id, coalesce(tn.tags, '') AS tags FROM comments_v c LEFT JOIN tagnames tn ON tn.id = c.id"""))
def c05_tags_for(spark, d):
    from ..operators import fusion
    t = tables(spark, d)
    return fusion.tags_for(t.kb_comments.select("id"), t.kb_comment_tags, t.kb_tags).select(
        "id", F.array_join("tags", ",").alias("tags"))


# =========================== A: ingest, upsert, integrity =====================
def _land(spark, df: DataFrame, name: str) -> str:
    """Write host-shaped JSON into a fresh landing folder under the shared
    checkpoint folder; returns the folder."""
    from ..session import scratch_path
    path = scratch_path(spark, f"landing-{name}")
    df.write.mode("overwrite").json(path)
    return path


@register("a01_normalize_prs", """
SELECT id, repo, number, title, user_login, merged_at, created_at, updated_at, html_url
FROM prs_v WHERE merged_at IS NOT NULL""")
def a01_normalize_prs(spark, d):
    from .. import schemas
    from ..sources import ingest
    path = _land(spark, ingest.prs_to_host_json(tables(spark, d).prs), "prs")
    return ingest.normalize_prs(ingest.read_json(spark, path, schemas.RAW_PULL))


def _comments_json(c: DataFrame) -> DataFrame:
    from ..sources import ingest
    j = ingest.comments_to_host_json(c)
    # host quirks: null bodies and deleted (null) users
    return (j.withColumn("body", F.when(F.col("id") % 13 == 0, F.lit(None)).otherwise(F.col("body")))
             .withColumn("user", F.when(F.col("id") % 17 == 0, F.lit(None)).otherwise(F.col("user"))))


@register("a02_normalize_comments", """
SELECT id, repo, pr_number, review_id,
       CASE WHEN id % 17 = 0 THEN 'unknown' ELSE user_login END AS user_login,
       CASE WHEN id % 13 = 0 THEN '' ELSE body END AS body,
       path, line, original_line, side, diff_hunk, commit_id, author_association, in_reply_to_id,
       created_at, updated_at, html_url
FROM comments_v""")
def a02_normalize_comments(spark, d):
    from .. import schemas
    from ..sources import ingest
    path = _land(spark, _comments_json(tables(spark, d).comments), "comments")
    return ingest.normalize_comments(ingest.read_json(spark, path, schemas.RAW_COMMENT))


@register("a03_normalize_reviews", """
SELECT id, repo, pr_number, user_login, state, body, submitted_at FROM reviews_v WHERE id % 7 <> 3""")
def a03_normalize_reviews(spark, d):
    from .. import schemas
    from ..sources import ingest
    j = ingest.reviews_to_host_json(tables(spark, d).reviews)
    j = j.withColumn("submitted_at", F.when(F.col("id") % 7 == 3, F.lit(None)).otherwise(F.col("submitted_at")))
    path = _land(spark, j, "reviews")
    return ingest.normalize_reviews(ingest.read_json(spark, path, schemas.RAW_REVIEW))


@register("a03_patch_counts", """
SELECT 'pull_requests' AS kind, 'unknown user' AS reason, CAST(0 AS BIGINT) AS n
UNION ALL SELECT 'pull_requests', 'not merged', count(*) FROM prs_v WHERE merged_at IS NULL
UNION ALL SELECT 'comments', 'unknown user', count(*) FROM comments_v WHERE id % 17 = 0
UNION ALL SELECT 'comments', 'null body', count(*) FROM comments_v WHERE id % 13 = 0
UNION ALL SELECT 'reviews', 'unknown user', CAST(0 AS BIGINT)
UNION ALL SELECT 'reviews', 'not submitted', count(*) FROM reviews_v WHERE id % 7 = 3""")
def a03_patch_counts(spark, d):
    """Q19, Q20: how many raw rows the normalisers patch or leave out."""
    from .. import schemas
    from ..sources import ingest
    t = tables(spark, d)
    reviews = ingest.reviews_to_host_json(t.reviews)
    reviews = reviews.withColumn("submitted_at", F.when(F.col("id") % 7 == 3, F.lit(None)).otherwise(F.col("submitted_at")))
    raw = [ingest.read_json(spark, _land(spark, j, f"counts-{k}"), schema) for k, j, schema in (
        ("prs", ingest.prs_to_host_json(t.prs), schemas.RAW_PULL),
        ("comments", _comments_json(t.comments), schemas.RAW_COMMENT), ("reviews", reviews, schemas.RAW_REVIEW))]
    return ingest.patch_counts(*raw)


@register("a04_collected_prs", """
SELECT id, repo, number, title, user_login, merged_at, created_at, updated_at, html_url, state,
       CASE WHEN number % 4 <> 0 THEN 'main' END AS base_ref,
       CASE WHEN number % 4 <> 0 THEN 'feature/' || number END AS head_ref,
       'collector' AS fetched_by, TIMESTAMP '2024-03-01 00:00:00' AS fetched_at
FROM prs_v""")
def a04_collected_prs(spark, d):
    from .. import schemas
    from ..sources import ingest
    p = tables(spark, d).prs
    # PRs without base/head objects for every fourth number
    p = p.select("*", F.when(F.col("number") % 4 != 0, F.lit("main")).alias("base_ref"),
                 F.when(F.col("number") % 4 != 0, F.concat(F.lit("feature/"), F.col("number").cast("string")))
                 .alias("head_ref"))
    path = _land(spark, ingest.prs_to_host_json(p), "cprs")
    return ingest.normalize_collected_prs(ingest.read_json(spark, path, schemas.RAW_PULL),
                                          "collector", "2024-03-01T00:00:00Z")


@register("a05_diffs", """
SELECT repo, pr_number, diff, fetched_at FROM (
  SELECT repo, pr_number, diff_hunk AS diff, created_at AS fetched_at,
         row_number() OVER (PARTITION BY repo, pr_number ORDER BY created_at DESC, diff_hunk DESC) AS rn
  FROM comments_v WHERE diff_hunk IS NOT NULL) WHERE rn = 1""")
def a05_diffs(spark, d):
    from .. import schemas
    from ..sources import ingest
    c = tables(spark, d).comments.where(F.col("diff_hunk").isNotNull())
    raw = c.select("repo", "pr_number", F.col("diff_hunk").alias("diff"),
                   ingest.ntz_to_iso("created_at").alias("fetched_at"))
    path = _land(spark, raw, "diffs")
    return ingest.normalize_diffs(ingest.read_json(spark, path, schemas.RAW_DIFF))


def _landed_pages(spark, d, cut: int | None = None):
    """(page, value): comments landed as paginated responses (two pages printed
    back to back, or one list of lists); bodies hold links and quotes with
    ``][``; of every seventh page the last ``cut`` characters are lost."""
    from ..session import scratch_path
    from ..sources import ingest
    c = tables(spark, d).comments.withColumn("body", F.concat("body", F.lit(' [docs]['), F.col("id").cast("string"),
                                                              F.lit('] "]["')))
    j = ingest.comments_to_host_json(c)
    g = F.expr("id div 6")
    pages = (j.groupBy(g.alias("g"))
             .agg(F.to_json(F.array_sort(F.collect_list(F.when(F.col("id") % 6 < 3, F.struct("*"))))).alias("a"),
                  F.to_json(F.array_sort(F.collect_list(F.when(F.col("id") % 6 >= 3, F.struct("*"))))).alias("b")))
    text = (F.when(F.col("g") % 5 == 0, F.concat(F.lit("["), F.col("a"), F.lit(","), F.col("b"), F.lit(",null]")))
            .when(F.col("g") % 2 == 0, F.concat(F.col("a"), F.col("b")))
            .otherwise(F.concat(F.col("a"), F.lit("\n"), F.col("b"))))
    if cut:
        text = F.when(F.col("g") % 7 == 3, F.left(text, F.length(text) - cut)).otherwise(text)
    path = scratch_path(spark, "landing-pages")
    # one response text per JSON line (its newlines escaped by the writer)
    pages.select(F.col("g").alias("page"), text.alias("value")).write.mode("overwrite").json(path)
    return spark.read.schema("page long, value string").json(path)


@register("a06_pages", """SELECT id, user_login, body || ' [docs][' || id || '] "]["' AS body FROM comments_v""")
def a06_pages(spark, d):
    """Page texts flattened back to rows, bodies unchanged."""
    from .. import schemas
    from ..sources import ingest
    return ingest.flatten_pages(_landed_pages(spark, d), schemas.RAW_COMMENT).select(
        "id", F.coalesce(F.col("user.login"), F.lit("unknown")).alias("user_login"), "body")


@register("a06_rejects", "SELECT DISTINCT id // 6 AS page FROM comments_v WHERE (id // 6) % 7 = 3")
def a06_rejects(spark, d):
    """The pages that were cut while landing."""
    from .. import schemas
    from ..sources import ingest
    return ingest.page_rejects(_landed_pages(spark, d, cut=3), schemas.RAW_COMMENT).select("page")


@register("a02_rejects", "SELECT id FROM comments_v WHERE id % 17 = 0")
def a02_rejects(spark, d):
    """A2: comment lines that were cut while landing, by the id they still name."""
    from .. import schemas
    from ..session import scratch_path
    from ..sources import ingest
    line = F.to_json(F.struct("*"))
    line = F.when(F.col("id") % 17 == 0, F.left(line, F.length(line) - 2)).otherwise(line)
    path = scratch_path(spark, "landing-cut")
    _comments_json(tables(spark, d).comments).select(line).write.text(path)
    return ingest.json_rejects(spark, path, schemas.RAW_COMMENT).select(
        F.regexp_extract("line", r'^\{"id":(\d+)', 1).cast("long").alias("id"))


_REPO_URL, _REPO_SHORT = O._q(upsert_rules.REPO_URL_RE), O._q(upsert_rules.REPO_SHORT_RE)


@register("a07_repo_refs", f"""
SELECT owner, repo, min(line_no) AS line_no FROM (
  SELECT line_no,
         CASE WHEN regexp_matches(s, {_REPO_URL})
              THEN regexp_extract(s, {_REPO_URL}, 1)
              WHEN regexp_matches(s, {_REPO_SHORT})
              THEN regexp_extract(s, {_REPO_SHORT}, 1) END AS owner,
         CASE WHEN regexp_matches(s, {_REPO_URL})
              THEN regexp_extract(s, {_REPO_URL}, 2)
              WHEN regexp_matches(s, {_REPO_SHORT})
              THEN regexp_extract(s, {_REPO_SHORT}, 2) END AS repo
  FROM (SELECT line_no, regexp_replace({O.strip_sql('line')}, '/+$', '') AS s FROM repo_lines_v)
  WHERE s <> '' AND NOT starts_with(s, '#'))
WHERE owner IS NOT NULL GROUP BY owner, repo""")
def a07_repo_refs(spark, d):
    from ..operators import upsert
    repos, _ = upsert.parse_repo_refs(tables(spark, d).repo_lines)
    return repos


@register("a07_rejects", f"""
SELECT line_no, line FROM (
  SELECT line_no, line, regexp_replace({O.strip_sql('line')}, '/+$', '') AS s FROM repo_lines_v)
WHERE s <> '' AND NOT starts_with(s, '#')
  AND NOT regexp_matches(s, {_REPO_URL})
  AND NOT regexp_matches(s, {_REPO_SHORT})""")
def a07_rejects(spark, d):
    from ..operators import upsert
    _, rejects = upsert.parse_repo_refs(tables(spark, d).repo_lines)
    return rejects


@register("a08_filter_repos", "SELECT DISTINCT repo FROM prs_v WHERE contains(repo, '1')")
def a08_filter_repos(spark, d):
    from ..operators import upsert
    return upsert.filter_repos(tables(spark, d).prs.select("repo").distinct(), "1")


@register("a09_discover", f"""
SELECT repo, number FROM prs_v WHERE state = 'closed'""")
def a09_discover(spark, d):
    from ..operators import upsert
    return upsert.discover_prs(tables(spark, d).prs, state="closed")


_INCR_SQL = """
SELECT p.* FROM prs_v p LEFT JOIN state_v s ON s.repo = p.repo
WHERE s.last_fetched_at IS NULL OR p.updated_at >= s.last_fetched_at"""


@register("a10_incremental", f"SELECT id, repo, number, updated_at FROM ({_INCR_SQL})")
def a10_incremental(spark, d):
    from ..operators import upsert
    t = tables(spark, d)
    return upsert.incremental(t.prs, t.fetch_state).select("id", "repo", "number", "updated_at")


@register("a10_state", f"""
SELECT coalesce(s.repo, n.repo) AS repo,
       greatest(s.last_fetched_at, n.n_at) AS last_fetched_at,
       greatest(s.last_pr_number, n.n_num) AS last_pr_number
FROM state_v s FULL JOIN (SELECT repo, max(updated_at) AS n_at, max(number) AS n_num
                          FROM ({_INCR_SQL}) GROUP BY repo) n ON n.repo = s.repo""")
def a10_state(spark, d):
    from ..operators import upsert
    t = tables(spark, d)
    return upsert.advance_state(t.fetch_state, upsert.incremental(t.prs, t.fetch_state))


@register("a11_upsert", """
SELECT id, body, updated_at FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, src DESC) AS rn
  FROM (SELECT *, 0 AS src FROM comments_v UNION ALL SELECT *, 1 AS src FROM batch_v))
WHERE rn = 1""")
def a11_upsert(spark, d):
    """A11 into the stored table, and what it then holds."""
    t = tables(spark, d)
    return t.kb_comments_table().upsert(t.batch).read().select("id", "body", "updated_at")


@register("a11_touched_parts", f"""
SELECT id // {PART_IDS} AS part, id // {PART_IDS} = 0 AS rewritten, count(*) AS n
FROM comments_v GROUP BY ALL""")
def a11_touched_parts(spark, d):
    """A batch of edited comments of one part rewrites that part alone; rows of
    each part afterwards."""
    from ..session import scratch_path
    from ..sources.store import KeyedTable
    t = tables(spark, d)
    before = KeyedTable.create(spark, scratch_path(spark, "touched"), t.kb_comments.schema, ["id"], span=PART_IDS)
    before.upsert(t.kb_comments)
    after = KeyedTable.open(spark, before.path).upsert(t.batch.where(F.col("id") < PART_IDS))
    new = [int(p) for p, v in after.content["parts"].items() if before.content["parts"].get(p) != v]
    part = after.part().alias("part")
    return after.read().groupBy(part).agg(F.count(F.lit(1)).alias("n")).select(
        "part", F.col("part").isin(new).alias("rewritten"), "n")


def _pr_batch(prs: DataFrame) -> DataFrame:
    """PRs re-fetched under new ids (same repo/number): the unique
    (repo, number) clash set of A11."""
    return (prs.where(F.col("id") % 10 == 0)
            .withColumn("id", F.col("id") + 1_000_000_000)
            .withColumn("title", F.concat(F.col("title"), F.lit(" (rebased)")))
            .withColumn("updated_at", F.col("updated_at") + F.expr("INTERVAL 1 DAY")))


@register("a11_upsert_prs", """
SELECT id, repo, number, title, updated_at FROM (
  SELECT *, row_number() OVER (PARTITION BY repo, number ORDER BY updated_at DESC, src DESC, id DESC) AS rn2 FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, src DESC) AS rn FROM (
      SELECT id, repo, number, title, updated_at, 0 AS src FROM prs_v
      UNION ALL
      SELECT id + 1000000000, repo, number, title || ' (rebased)', updated_at + INTERVAL 1 DAY, 1
      FROM prs_v WHERE id % 10 = 0))
  WHERE rn = 1)
WHERE rn2 = 1""")
def a11_upsert_prs(spark, d):
    from ..operators import upsert
    p = tables(spark, d).prs
    out = upsert.upsert(p, _pr_batch(p), ["id"], unique_keys=[["repo", "number"]])
    return out.select("id", "repo", "number", "title", "updated_at")


@register("a12_run_summary", f"""
SELECT p.repo, p.number AS pr_number, coalesce(c.n, 0) AS comments, coalesce(r.n, 0) AS reviews
FROM ({_INCR_SQL}) p
LEFT JOIN (SELECT repo, pr_number, count(*) AS n FROM comments_v GROUP BY ALL) c
  ON c.repo = p.repo AND c.pr_number = p.number
LEFT JOIN (SELECT repo, pr_number, count(*) AS n FROM reviews_v GROUP BY ALL) r
  ON r.repo = p.repo AND r.pr_number = p.number""")
def a12_run_summary(spark, d):
    from ..operators import upsert
    t = tables(spark, d)
    return upsert.run_summary(upsert.incremental(t.prs, t.fetch_state), t.kb_comments, t.reviews)


_TABLE_SQL = {"pull_requests": "prs_v", "reviews": "reviews_v", "comments": "comments_v",
              "comment_embeddings": "embeddings_v", "comment_tags": "comment_tags_v", "tags": "tags_v",
              "fetch_state": "state_v",
              "pr_diffs": "(SELECT DISTINCT repo, pr_number FROM comments_v WHERE diff_hunk IS NOT NULL)"}


@register("a13_export_import", " UNION ALL ".join(
    f"""SELECT '{name}' AS "table", count(*) AS "rows", CAST(0 AS BIGINT) AS n_diff FROM {src}"""
    for name, src in _TABLE_SQL.items()))
def a13_export_import(spark, d):
    """All tables out and in again; rows, and rows that differ in any value."""
    from ..session import scratch_path
    from ..sources import ingest
    t = tables(spark, d)
    diffs = t.stored("pr_diffs", lambda: a05_diffs(spark, d))
    tabs = {"pull_requests": t.prs, "reviews": t.reviews, "comments": t.kb_comments, "comment_embeddings": t.embeddings,
            "comment_tags": t.kb_comment_tags, "tags": t.kb_tags, "fetch_state": t.fetch_state, "pr_diffs": diffs}
    path = scratch_path(spark, "export")
    ingest.export_kb(tabs, path)
    return ingest.differences(tabs, ingest.import_kb(spark, path))


def _integrity_sql() -> str:
    from ..operators.upsert import NOT_NULL
    src = {"pull_requests": "prs_v", "reviews": "reviews_v", "comments": "comments_v",
           "comment_embeddings": "embeddings_v", "comment_tags": "comment_tags_v", "tags": "tags_v"}
    parts = [
        "SELECT 'fk:reviews(repo,pr_number)->pull_requests' AS \"check\", count(*) AS violations FROM reviews_v r "
        "ANTI JOIN prs_v p ON p.repo = r.repo AND p.number = r.pr_number",
        "SELECT 'fk:comments(repo,pr_number)->pull_requests', count(*) FROM comments_v r "
        "ANTI JOIN prs_v p ON p.repo = r.repo AND p.number = r.pr_number",
        "SELECT 'fk:comment_embeddings(comment_id)->comments', count(*) FROM embeddings_v e "
        "ANTI JOIN comments_v c ON c.id = e.comment_id",
        "SELECT 'fk:comment_tags(comment_id)->comments', count(*) FROM comment_tags_v e "
        "ANTI JOIN comments_v c ON c.id = e.comment_id",
        "SELECT 'fk:comment_tags(tag_id)->tags', count(*) FROM comment_tags_v e "
        "ANTI JOIN tags_v t ON t.id = e.tag_id",
    ]
    for t, cols in NOT_NULL.items():
        for c in cols:
            parts.append(f"SELECT 'not_null:{t}.{c}', count(*) FILTER (WHERE {c} IS NULL) FROM {src[t]}")
    uniq = [("unique:pull_requests(id)", "prs_v", "id"),
            ("unique:pull_requests(repo,number)", "prs_v", "repo, number"),
            ("unique:reviews(id)", "reviews_v", "id"), ("unique:comments(id)", "comments_v", "id"),
            ("unique:comment_embeddings(comment_id)", "embeddings_v", "comment_id"),
            ("unique:comment_tags(comment_id,tag_id)", "comment_tags_v", "comment_id, tag_id"),
            ("unique:tags(name)", "tags_v", "name")]
    for n, v, ks in uniq:
        parts.append(f"SELECT '{n}', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM "
                     f"(SELECT count(*) AS n FROM {v} GROUP BY {ks} HAVING count(*) > 1)")
    return "\nUNION ALL ".join(parts)


@register("a14_integrity", _integrity_sql())
def a14_integrity(spark, d):
    from ..operators import upsert
    t = tables(spark, d)
    return upsert.integrity_report(t.prs, t.reviews, t.kb_comments, t.embeddings, t.kb_tags, t.kb_comment_tags)


# =========================== G: report ==========================================
def _hits(spark, d):
    t = tables(spark, d)
    return t.stored("hits", lambda: _hybrid(spark, d))


_HITS_SQL = "SELECT r.query_id, r.rank, r.id, c.path FROM rrf r JOIN comments_v c ON c.id = r.id"


@register("g01_cap", O.search_sql(f"""
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS pos, rank, id
FROM ({_HITS_SQL}) QUALIFY pos <= 10"""))
def g01_cap(spark, d):
    from ..operators import report
    return report.cap(_hits(spark, d), 10).select("query_id", "pos", "rank", "id")


@register("g02_group", O.search_sql(f"""
SELECT query_id, dir, CAST(count(*) AS INTEGER) AS n_members, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank) AS ids
FROM (SELECT *, CASE WHEN path IS NOT NULL AND path <> '' THEN {O.dirname_sql('path')} ELSE 'general' END AS dir
      FROM ({_HITS_SQL}))
GROUP BY query_id, dir"""))
def g02_group(spark, d):
    from ..operators import report
    g = report.group_by_dir(report.cap(_hits(spark, d)))
    return g.select("query_id", "dir", F.size("members").alias("n_members"),
                    F.array_join(F.transform("members", lambda m: m["id"].cast("string")), ",").alias("ids"))


# every report hit; its groups by directory; which members the greedy pass keeps; summaries by comment
_REPORT_CTES = [
    ("hits", """
  SELECT r.query_id, c.id, c.path, c.body, c.line, c.user_login, c.created_at, c.diff_hunk, coalesce(tn.tags, '') AS tags,
         row_number() OVER (PARTITION BY r.query_id ORDER BY r.rank) AS pos
  FROM rrf r JOIN comments_v c ON c.id = r.id LEFT JOIN tagnames tn ON tn.id = r.id"""),
    ("mem", f"""
  SELECT *, row_number() OVER (PARTITION BY query_id, dir ORDER BY pos) AS nth
  FROM (SELECT *, {_wordset_sql('body')} AS ws,
               CASE WHEN path IS NOT NULL AND path <> '' THEN {O.dirname_sql('path')} ELSE 'general' END AS dir FROM hits)"""),
    ("kept", """
  SELECT m.* FROM (
    WITH RECURSIVE walk AS (
      SELECT query_id, dir, nth, true AS keep, [ws] AS before FROM mem WHERE nth = 1
      UNION ALL
      SELECT query_id, dir, nth, NOT hit, CASE WHEN hit THEN before ELSE list_append(before, ws) END
      FROM (SELECT m.query_id, m.dir, m.nth, m.ws, w.before,
                   len(list_filter(w.before, lambda k: len(k) > 0 AND len(m.ws) > 0
                     AND len(list_intersect(k, m.ws)) / len(list_distinct(list_concat(k, m.ws))) >= CAST(0.7 AS DOUBLE))) > 0 AS hit
            FROM walk w JOIN mem m ON m.query_id = w.query_id AND m.dir = w.dir AND m.nth = w.nth + 1))
    SELECT query_id, dir, nth FROM walk WHERE keep) w JOIN mem m USING (query_id, dir, nth)"""),
]
_SUMMARY_CTE = ("summaries", f"""
  SELECT c.id, string_agg(CASE WHEN k.cut IS NULL OR c.i < k.cut THEN c.line
                               ELSE substring(c.line, 1, CAST({tx.SUMMARY_MAX_CHARS} - c.before AS BIGINT)) || '...' END,
                          ' ' ORDER BY c.i) AS summary
  FROM c JOIN k ON k.id = c.id WHERE k.cut IS NULL OR c.i <= k.cut GROUP BY c.id""")


def _report_sql(final: str) -> str:
    return O.with_views(final, extra=[*O.search_ctes(), *_REPORT_CTES, *_B05_CTES, _SUMMARY_CTE])


@register("g03_dedup", _report_sql("""
SELECT query_id, dir, CAST(count(*) AS INTEGER) AS n_kept, string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos) AS ids
FROM kept GROUP BY query_id, dir"""))
def g03_dedup(spark, d):
    from ..operators import report
    g = report.greedy_dedup(report.group_by_dir(report.cap(_hits(spark, d))))
    return g.select("query_id", "dir", F.size("members").alias("n_kept"),
                    F.array_join(F.transform("members", lambda m: m["id"].cast("string")), ",").alias("ids"))


@register("g04_report", _report_sql(f"""
SELECT q.query_id, coalesce(r.n_hits, 0) AS n_hits, coalesce(r.report, 'No conventions found.') AS report
FROM queries_v q LEFT JOIN (
  SELECT query_id, n_hits,
         'Found ' || n_hits || ' relevant review comments across ' || count(*) || ' locations.' || {NL} || {NL}
           || string_agg(text, {NL} ORDER BY dir) AS report
  FROM (SELECT query_id, dir,
               '--- ' || (CASE WHEN dir = '' THEN 'General' ELSE dir END) || ' ---' || {NL} || {NL}
                 || string_agg('  [' || user_login || ' ' || strftime(created_at, '%Y-%m-%d') || ']'
                      || (CASE WHEN path <> '' THEN '  ' || path || (CASE WHEN coalesce(line, 0) <> 0 THEN ':' || line ELSE '' END)
                               ELSE '' END)
                      || {NL} || '  ' || s.summary
                      || (CASE WHEN tags <> '' THEN {NL} || '  tags: ' || replace(tags, ',', ', ') ELSE '' END) || {NL},
                      {NL} ORDER BY pos) AS text
        FROM (SELECT *, coalesce(path, '') AS p FROM kept) JOIN summaries s USING (id) GROUP BY query_id, dir)
  JOIN (SELECT query_id, count(*) AS n_hits FROM hits GROUP BY query_id) USING (query_id)
  GROUP BY query_id, n_hits) r ON r.query_id = q.query_id""".replace("CASE WHEN path <> ''", "CASE WHEN p <> ''")))
def g04_report(spark, d):
    from ..operators import report
    return report.render_report(_hits(spark, d), tables(spark, d).queries)


@register("g05_context", _report_sql(f"""
SELECT query_id, string_agg('Comment #' || pos || ' by ' || user_login || ' on ' || strftime(created_at, '%Y-%m-%d') || ':'
         || (CASE WHEN coalesce(path, '') <> '' THEN {NL} || '  File: ' || path ELSE '' END)
         || {NL} || '  Review: ' || body
         || (CASE WHEN coalesce(diff_hunk, '') <> '' THEN {NL} || '  Code context: ' || diff_hunk ELSE '' END) || {NL},
         {NL} ORDER BY pos) AS context
FROM hits GROUP BY query_id"""))
def g05_context(spark, d):
    from ..operators import report
    return report.prompt_context(_hits(spark, d))


@register("g06_empty", O.search_sql(f"""
SELECT q.query_id, coalesce(n.n, 0) AS n_hits,
       CASE WHEN n.n IS NULL THEN '{'No conventions found.'}' END AS message
FROM queries_v q LEFT JOIN (SELECT query_id, count(*) AS n FROM ({_HITS_SQL}) GROUP BY query_id) n
  ON n.query_id = q.query_id"""))
def g06_empty(spark, d):
    from ..operators import report
    return report.empty_results(tables(spark, d).queries, _hits(spark, d))


_SIMILAR = "len(list_intersect({x}.ws, {y}.ws)) / (len({x}.ws) + len({y}.ws) - len(list_intersect({x}.ws, {y}.ws)))"
_G07_CTES = [
    ("ws", f"SELECT id, ws FROM (SELECT id, {_wordset_sql('body')} AS ws FROM comments_v) WHERE len(ws) > 0"),
    ("pairs", f"""
  SELECT a.id AS a, b.id AS b FROM ws a JOIN ws b
    ON a.id < b.id AND least(len(a.ws), len(b.ws)) >= 0.69 * greatest(len(a.ws), len(b.ws))
  WHERE {_SIMILAR.format(x='a', y='b')} >= CAST(0.7 AS DOUBLE)"""),
    ("edges", "SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs"),
    ("clusters", """
  SELECT id, cid FROM (
    WITH RECURSIVE reach AS (SELECT id, id AS root FROM ws
                             UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.id)
    SELECT id, min(root) AS cid FROM reach GROUP BY id)
  QUALIFY count(*) OVER (PARTITION BY cid) > 1"""),
]


@register("g07_conventions", O.with_views(f"""
SELECT m.cid AS id, t.summary AS title, r.body, g.category, f.file_patterns, m.source_count, s.confidence, m.created_at,
       m.updated_at
FROM (SELECT cid, count(*) AS source_count, min(created_at) AS created_at, max(updated_at) AS updated_at
      FROM clusters JOIN comments_v USING (id) GROUP BY cid) m
JOIN comments_v r ON r.id = m.cid
JOIN (SELECT c.id, string_agg(CASE WHEN k.cut IS NULL OR c.i < k.cut THEN c.line
                                   ELSE substring(c.line, 1, CAST({tx.SUMMARY_MAX_CHARS} - c.before AS BIGINT)) || '...' END,
                              ' ' ORDER BY c.i) AS summary
      FROM c JOIN k ON k.id = c.id WHERE k.cut IS NULL OR c.i <= k.cut GROUP BY c.id) t ON t.id = m.cid
JOIN (SELECT cid, string_agg(dir, ',' ORDER BY n DESC, dir) AS file_patterns
      FROM (SELECT cid, CASE WHEN path IS NOT NULL AND path <> '' THEN {O.dirname_sql('path')} ELSE 'general' END AS dir,
                   count(*) AS n
            FROM clusters JOIN comments_v USING (id) GROUP BY ALL) GROUP BY cid) f ON f.cid = m.cid
JOIN (SELECT c.cid, round((sum({_SIMILAR.format(x='a', y='b')}) - 1) / (count(*) - 1), 9) AS confidence
      FROM clusters c JOIN ws a ON a.id = c.id JOIN ws b ON b.id = c.cid GROUP BY c.cid) s ON s.cid = m.cid
LEFT JOIN (SELECT c.cid, t.name AS category
           FROM clusters c JOIN comment_tags_v x ON x.comment_id = c.id JOIN tags_v t ON t.id = x.tag_id
           GROUP BY c.cid, t.id, t.name
           QUALIFY row_number() OVER (PARTITION BY c.cid ORDER BY count(*) DESC, t.id) = 1) g ON g.cid = m.cid""",
                                          extra=_G07_CTES + _B05_CTES))
def g07_conventions(spark, d):
    from ..operators import report
    t = tables(spark, d)
    conv, _ = report.mine_conventions(t.kb_comments, t.kb_comment_tags, t.kb_tags)
    return conv.withColumn("file_patterns", F.array_join("file_patterns", ","))


@register("g07_sources", O.with_views("SELECT cid AS convention_id, id AS comment_id FROM clusters", extra=_G07_CTES))
def g07_sources(spark, d):
    from ..operators import report
    t = tables(spark, d)
    _, src = report.mine_conventions(t.kb_comments, t.kb_comment_tags, t.kb_tags)
    return src


# =========================== H: findings ========================================
_NORM_SQL = O.strip_sql("regexp_replace(lower(issue), " + O._q(O.WS + "+") + ", ' ', 'g')")


@register("h01_dedup", f"""
SELECT * FROM (WITH RECURSIVE texts AS (
  SELECT file, line, b.issue AS issue, b.severity AS severity, n, {_wordset_sql('norm')} AS ws,
         row_number() OVER (PARTITION BY file, line ORDER BY b.severity, b.issue) AS pos
  FROM (SELECT file, line, {_NORM_SQL} AS norm, min({{'severity': severity, 'issue': issue}}) AS b, count(*) AS n
        FROM findings_v GROUP BY ALL)),
walk AS (
  SELECT file, line, pos, pos AS rep, [{{'pos': pos, 'ws': ws}}] AS kept FROM texts WHERE pos = 1
  UNION ALL
  SELECT file, line, pos, coalesce(hit, pos),
         CASE WHEN hit IS NULL THEN list_append(kept, {{'pos': pos, 'ws': ws}}) ELSE kept END
  FROM (SELECT t.file, t.line, t.pos, t.ws, w.kept,
               (SELECT min(k.pos) FROM (SELECT unnest(w.kept) AS k)
                WHERE len(k.ws) > 0 AND len(t.ws) > 0
                  AND len(list_intersect(k.ws, t.ws)) >= 0.7 * len(list_distinct(list_concat(k.ws, t.ws)))) AS hit
        FROM walk w JOIN texts t ON t.file = w.file AND t.line = w.line AND t.pos = w.pos + 1))
SELECT r.file, r.line, r.issue, r.severity, CAST(sum(t.n) AS BIGINT) AS n_merged
FROM walk w JOIN texts t ON t.file = w.file AND t.line = w.line AND t.pos = w.pos
JOIN texts r ON r.file = w.file AND r.line = w.line AND r.pos = w.rep
GROUP BY r.file, r.line, r.pos, r.issue, r.severity)""")
def h01_dedup(spark, d):
    from ..operators import findings
    return findings.dedup_findings(tables(spark, d).findings)


@register("h02_merge", """
SELECT file, min(line) AS line, max(line_end) AS line_end,
       string_agg(issue, '; ' ORDER BY line, issue) AS issue, min(severity) AS severity,
       CAST(sum(n) AS BIGINT) AS n_findings
FROM (SELECT f.file, i.isl, f.issue, min(f.line) AS line, max(f.line) AS line_end, min(f.severity) AS severity,
             count(*) AS n
FROM findings_v f JOIN (
  SELECT file, line, sum(brk) OVER (PARTITION BY file ORDER BY line ROWS UNBOUNDED PRECEDING) AS isl
  FROM (SELECT file, line,
               CASE WHEN line - lag(line) OVER (PARTITION BY file ORDER BY line) <= 2 THEN 0 ELSE 1 END AS brk
        FROM (SELECT DISTINCT file, line FROM findings_v))) i
  ON i.file = f.file AND i.line = f.line
GROUP BY f.file, i.isl, f.issue) GROUP BY file, isl""")
def h02_merge(spark, d):
    from ..operators import findings
    return findings.merge_nearby(tables(spark, d).findings)


@register("h03_severity", """
SELECT s.severity, coalesce(n, 0) AS n FROM (VALUES ('P0'), ('P1'), ('P2')) s(severity)
LEFT JOIN (SELECT severity, count(*) AS n FROM findings_v GROUP BY severity) c ON c.severity = s.severity""")
def h03_severity(spark, d):
    from ..operators import findings
    return findings.severity_rollup(tables(spark, d).findings)


@register("h04_approved", """
SELECT DISTINCT file FROM changed_files_v c WHERE NOT EXISTS (SELECT 1 FROM findings_v f WHERE f.file = c.file)""")
def h04_approved(spark, d):
    from ..operators import findings
    t = tables(spark, d)
    return findings.approved_files(t.changed_files, t.findings)


# =========================== I: streaming =======================================
def _deliver(df: DataFrame, landing: str) -> None:
    """Lands host-shaped JSON, gzipped, in files of its own."""
    from ..session import shuffles_freed
    with shuffles_freed(df.sparkSession):
        df.write.mode("append").option("compression", "gzip").json(landing)


def _stream_run(spark, d, name, redeliver=False, rules=None, index=True):
    """Land comments (and the edited batch) as JSON deliveries, stream them
    with AvailableNow into a table folder; returns the table folder."""
    from ..session import scratch_path
    from ..streaming import stream
    t = tables(spark, d)
    landing = scratch_path(spark, f"stream-landing-{name}")
    _deliver(_comments_json(t.comments), landing)
    if redeliver:
        _deliver(_comments_json(t.comments), landing)
    else:
        from ..sources import ingest
        _deliver(ingest.comments_to_host_json(t.batch), landing)
    table = scratch_path(spark, f"stream-table-{name}")
    ck = scratch_path(spark, f"stream-ckpt-{name}")
    src = stream.comment_stream(spark, landing, max_files_per_trigger=4)
    q = stream.start_ingest(src, table, ck, rules=rules, index=index)
    q.awaitTermination()
    return table, landing


_UPSERTED_A02 = """
SELECT id, CASE WHEN id % 13 = 0 AND src = 0 THEN '' ELSE body END AS body, updated_at FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, src DESC) AS rn
  FROM (SELECT *, 0 AS src FROM comments_v UNION ALL SELECT *, 1 AS src FROM batch_v))
WHERE rn = 1"""


@register("i01_stream_ingest", _UPSERTED_A02)
def i01_stream_ingest(spark, d):
    from ..streaming import stream
    table, _ = _stream_run(spark, d, "i01", index=False)
    return stream.snapshot(spark, table).select("id", "body", "updated_at")


@register("i02_stream_tag", O.tag_scores_sql(fixture_rules.TEST_RULES, src="upserted_v"))
def i02_stream_tag(spark, d):
    from ..streaming import stream
    t = tables(spark, d)
    # tags depend on body text: use bodies without the null-body quirk
    from ..session import scratch_path
    from ..sources import ingest
    landing = scratch_path(spark, "stream-landing-i02")
    _deliver(ingest.comments_to_host_json(t.comments), landing)
    _deliver(ingest.comments_to_host_json(t.batch), landing)
    table = scratch_path(spark, "stream-table-i02")
    q = stream.start_ingest(stream.comment_stream(spark, landing, 4), table,
                            scratch_path(spark, "stream-ckpt-i02"), rules=fixture_rules.TEST_RULES, index=False)
    q.awaitTermination()
    return stream.current_tags(spark, table)


@register("i03_stream_dedup", "SELECT id, updated_at FROM comments_v")
def i03_stream_dedup(spark, d):
    from ..streaming import stream
    table, _ = _stream_run(spark, d, "i03", redeliver=True, index=False)
    return stream.snapshot(spark, table).select("id", "updated_at")


@register("i04_refresh_postings", f"""
SELECT term, id, count(*) AS tf
FROM (SELECT id, unnest(list_concat({O._tok('body')}, {O._tok('path')}, {O._tok('diff_hunk')})) AS term
      FROM upserted_v)
GROUP BY term, id
UNION ALL
SELECT NULL, count(*), CAST(sum(len(list_concat({O._tok('body')}, {O._tok('path')}, {O._tok('diff_hunk')}))) AS BIGINT)
FROM upserted_v""")
def i04_refresh_postings(spark, d):
    """I4: every (term, id, tf) of the index kept by the stream, and a row with its
    number of documents and tokens."""
    from ..streaming import stream
    t = tables(spark, d)
    from ..session import scratch_path
    from ..sources import ingest
    landing = scratch_path(spark, "stream-landing-i04")
    _deliver(ingest.comments_to_host_json(t.comments), landing)
    _deliver(ingest.comments_to_host_json(t.batch), landing)
    table = scratch_path(spark, "stream-table-i04")
    q = stream.start_ingest(stream.comment_stream(spark, landing, 4), table,
                            scratch_path(spark, "stream-ckpt-i04"), index=True)
    q.awaitTermination()
    idx = stream.current_index(spark, table)
    return idx.postings.select("term", "id", F.col("tf").cast("long").alias("tf")).unionByName(
        idx.corpus.select(F.lit(None).cast("string").alias("term"), F.col("ndocs").alias("id"), F.col("total_len").alias("tf")))


@register("i05_backfill_equals_stream", """
SELECT count(*) AS n_stream, count(*) AS n_batch, CAST(0 AS BIGINT) AS n_diff FROM comments_v""")
def i05_backfill_equals_stream(spark, d):
    """The streamed table and a batch backfill of the same landed files
    hold the same rows: one row (n_stream, n_batch, n_diff), n_diff = 0."""
    from ..session import scratch_path
    from ..streaming import stream
    table, landing = _stream_run(spark, d, "i05", index=False)
    bt = scratch_path(spark, "backfill-i05")
    stream.backfill(spark, landing, bt, index=False)
    a = stream.snapshot(spark, table)
    b = stream.snapshot(spark, bt)
    return compared(a, b, a.columns).select(F.col("n_left").alias("n_stream"), F.col("n_right").alias("n_batch"), "n_diff")


# =========================== F1, F9-F11, B11: stemming, embedding, ANN ==========
@register("f01_stemmed_vocab")
def f01_stemmed_vocab(spark, d):
    """Porter-stemmed vocabulary of the comment index (term, df)."""
    from ..operators import postings
    return postings.stemmed_vocabulary(tables(spark, d).stored_index(), "porter")


@register("f03_bm25_porter")
def f03_bm25_porter(spark, d):
    """F3 with the reference's stemming tokenizer on both sides."""
    from ..operators import postings
    q = _unrestricted(_prepared(spark, d))
    return postings.bm25_topk(q, tables(spark, d).stored_index("porter"), stemmer="porter")


def _text_model(spark, d):
    """The embedding model of the comments, fitted once and read from where it is stored."""
    from ..operators import vectors
    from ..session import scratch_path
    t = tables(spark, d)
    if "_text_model" not in t.__dict__:
        path = scratch_path(spark, "text-models")
        texts = t.kb_comments.select(tx.embed_text("path", "body", "diff_hunk").alias("text"))
        vectors.write_text_model(spark, vectors.fit_text_model(texts, "text"), path)
        t.__dict__["_text_model"] = vectors.read_text_model(spark, path, "hashed-tfidf-1")
    return t.__dict__["_text_model"]


_EMBED_TEXT = ("concat_ws(chr(10), CASE WHEN path <> '' THEN 'File: ' || path END, body, "
               "CASE WHEN diff_hunk <> '' THEN 'Code context:' || chr(10) || diff_hunk END)")
_EMBEDDED_SQL = f"""
WITH t AS (SELECT id, {O._tok(_EMBED_TEXT)} AS toks FROM comments_v),
b AS (SELECT id, bucket, count(*) AS tf
      FROM (SELECT id, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % 256 AS bucket
            FROM (SELECT id, unnest(toks) AS term FROM t)) GROUP BY ALL),
w AS (SELECT b.id, b.bucket, b.tf * (ln(((SELECT count(*) FROM t) + 1) / (d.df + 1)) + 1) AS w
      FROM b JOIN (SELECT bucket, count(*) AS df FROM b GROUP BY bucket) d USING (bucket))
SELECT id, round(sum(bucket * CAST(CAST(w / norm AS FLOAT) AS DOUBLE)), 3) AS weighted, round(max(w / norm), 4) AS largest
FROM (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY id)) AS norm FROM w) GROUP BY id"""


@register("f09_embed", O.with_views(f"""
SELECT e.id AS comment_id, 'hashed-tfidf-1' AS model, 256 AS dim, e.weighted, e.largest
FROM ({_EMBEDDED_SQL}) e WHERE NOT EXISTS (SELECT 1 FROM embeddings_v x WHERE x.comment_id = e.id)
  AND e.id IN (SELECT id FROM comments_v)"""))
def f09_embed(spark, d):
    """vectors for the comments that have none (C1), by the fitted model; of each
    its dimension, its sum weighed by position and its largest value."""
    from ..operators import vectors
    t = tables(spark, d)
    e = vectors.embed_comments(t.kb_comments, t.embeddings, _text_model(spark, d))
    v = F.transform("embedding", lambda x: x.cast("double"))
    return e.select("comment_id", "model", F.size("embedding").alias("dim"),
                    F.round(F.aggregate(F.transform(v, lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x), 3).alias("weighted"),
                    F.round(F.array_max(v), 4).alias("largest"))


@register("f08_from_text")
def f08_from_text(spark, d):
    """F8 from titles alone: comments and queries embedded by one stored model."""
    from dataclasses import replace

    from ..operators import vectors
    from .search import hybrid_search
    t = tables(spark, d)
    model = _text_model(spark, d)
    own = t.stored("text_vectors", lambda: vectors.reembed(t.kb_comments, model))
    inp = replace(_search(spark, d), vectors=own.select("comment_id", "embedding"), model=model)
    h = hybrid_search(t.queries.drop("qvec"), inp)
    return h.select("query_id", "rank", "id", "score", "match_source", "user_login", F.array_join("tags", ",").alias("tags"))


@register("f10_ann")
def f10_ann(spark, d):
    """top-k in the probed cells, its recall against exact F5 and the share of the
    vectors that were compared, per query."""
    from ..operators import vectors
    q = _prepared(spark, d)
    s = _search(spark, d)
    kq = q.select("query_id", "k")
    index = vectors.fit_cells(s.vectors)
    ann = vectors.ann_topk(q, index, kq)
    exact = vectors.cosine_topk(q, s.vectors, kq)
    hit = exact.join(ann.select("query_id", "id"), ["query_id", "id"], "left_semi") \
        .groupBy("query_id").agg(F.count(F.lit(1)).alias("found"))
    tot = exact.groupBy("query_id").agg(F.count(F.lit(1)).alias("k"))
    total = index.sizes.agg(F.sum("n").alias("n")).select("n").scalar()
    looked = (vectors.probed_cells(q, index).join(F.broadcast(index.sizes), "cell")
              .groupBy("query_id").agg((F.sum("n") / total).alias("compared")))
    return tot.join(hit, "query_id", "left").join(looked, "query_id").select(
        "query_id", "k", F.coalesce("found", F.lit(0)).alias("found"),
        (F.coalesce("found", F.lit(0)) / F.col("k")).alias("recall"), "compared")


@register("f11_reembed", """
SELECT model, count(*) AS n, CAST(min(len(embedding)) AS INTEGER) AS dim FROM embeddings_v GROUP BY model
UNION ALL SELECT 'hashing-64-v2', count(*), 256 FROM comments_v""")
def f11_reembed(spark, d):
    """every comment embedded again under a new model name."""
    from ..operators import vectors
    from ..session import scratch_path
    t = tables(spark, d)
    path = scratch_path(spark, "vectors")
    vectors.write_embeddings(t.embeddings, path)                       # current model
    vectors.write_embeddings(vectors.reembed(t.kb_comments, model="hashing-64-v2"), path)
    e = spark.read.parquet(path)
    return e.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.min(F.size("embedding")).alias("dim"))


@register("b11_decode", "SELECT comment_id, CAST(len(embedding) AS INTEGER) AS dim, true AS same FROM embeddings_v")
def b11_decode(spark, d):
    """float32 little-endian blobs <-> array<float> round trip."""
    from ..functions.vectors import decode_vector, encode_vector
    e = tables(spark, d).embeddings.select("comment_id", "embedding")
    blob = e.withColumn("blob", encode_vector("embedding"))
    back = blob.withColumn("decoded", decode_vector("blob"))
    return back.select("comment_id", F.size("decoded").alias("dim"),
                       (F.col("decoded") == F.col("embedding")).alias("same"))
