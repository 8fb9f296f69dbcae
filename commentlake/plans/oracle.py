"""DuckDB SQL for the fixture views (same definitions as
``commentlake.sources.bindings``) and helpers to compose oracle queries.

The DuckDB side is an independent implementation used only to check results;
regular expressions are written in the subset both java.util.regex and RE2
accept, with word boundaries spelled out.
"""

from __future__ import annotations

from ..functions import text as tx
from ..operators import tagging
from ..sources import bindings as b
from ..sources import fixture_rules


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_URL_PATH = ("regexp_replace(regexp_replace(p.url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''),"
             " '[?#].*$', '')")


def _file(key: str) -> str:
    return f"('mod' || ({key} % 50) || '/file' || {key} || '.py')"


_TAG_NAMES = [n for n, _ in tagging.rule_tags(fixture_rules.TEST_RULES)]
_TAG_LIST = "[" + ", ".join(_q(n) for n in _TAG_NAMES) + "]"

VIEWS: dict[str, str] = {
    "comments_v": f"""
  SELECT d.doc_id AS id, d.source AS repo, d.doc_id % {b.N_PR_BUCKETS} AS pr_number,
         CAST(NULL AS BIGINT) AS review_id, 'user' || e.user_id AS user_login, d.text AS body,
         CASE WHEN d.doc_id % 7 = 0 THEN NULL
              WHEN d.doc_id % 7 = 1 THEN regexp_extract({_URL_PATH}, '[^/]*$', 0)
              ELSE {_URL_PATH} END AS path,
         NULLIF(d.doc_id % 11, 0) AS line, NULLIF(d.doc_id % 11, 0) AS original_line,
         'RIGHT' AS side,
         CASE WHEN d.doc_id % 3 = 0 THEN d.text END AS diff_hunk,
         CAST(NULL AS VARCHAR) AS commit_id, 'CONTRIBUTOR' AS author_association,
         CAST(NULL AS BIGINT) AS in_reply_to_id, e.ts AS created_at, e.ts AS updated_at,
         'https://host.test/' || d.source || '/pull/' || (d.doc_id % {b.N_PR_BUCKETS}) || '#r' || d.doc_id AS html_url
  FROM documents d JOIN events e ON e.event_id = d.doc_id
  LEFT JOIN pages p ON p.page_id = d.doc_id % (SELECT count(*) FROM pages)""",
    "prs_v": f"""
  SELECT o_orderkey AS id, 'src' || (o_custkey % {b.N_REPOS}) AS repo, o_orderkey AS number,
         o_orderpriority AS title, 'user' || o_custkey AS user_login,
         CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS merged_at,
         o_orderdate AS created_at, o_orderdate AS updated_at,
         'https://host.test/src' || (o_custkey % {b.N_REPOS}) || '/pull/' || o_orderkey AS html_url,
         CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'closed' END AS state
  FROM orders""",
    "reviews_v": f"""
  SELECT conv_id * 100 + turn AS id, 'src' || (conv_id % {b.N_REPOS}) AS repo, conv_id AS pr_number,
         role AS user_login,
         CASE turn % 3 WHEN 0 THEN 'APPROVED' WHEN 1 THEN 'CHANGES_REQUESTED' ELSE 'COMMENTED' END AS state,
         text AS body, make_timestamp(2024, 1, CAST(conv_id % 28 + 1 AS BIGINT), CAST(turn % 24 AS BIGINT), 0, 0) AS submitted_at
  FROM conversations""",
    "embeddings_v": """
  SELECT vec_id AS comment_id, embedding, 'fixture-64d' AS model,
         TIMESTAMP '2024-02-01 00:00:00' AS created_at
  FROM embeddings""",
    "queries_v": f"""
  SELECT bm.item_id AS query_id, bm.text AS title,
         CASE WHEN bm.item_id % 3 = 0 THEN
              [({_TAG_LIST})[((bm.item_id // 3) % {len(_TAG_NAMES)}) + 1],
               ({_TAG_LIST})[(((bm.item_id // 3) + 1) % {len(_TAG_NAMES)}) + 1]] END AS tags,
         {b.QUERY_LIMIT} AS "limit", ev.embedding AS qvec
  FROM benchmark bm LEFT JOIN embeddings ev ON ev.vec_id = bm.item_id""",
    "findings_v": f"""
  SELECT {_file('l_orderkey')} AS file, CAST(l_linenumber AS BIGINT) AS line,
         'check ' || CASE WHEN l_linestatus = 'O' THEN 'open handle' ELSE 'unused import' END
           || ' in part ' || (l_partkey % 5) AS issue,
         CASE l_returnflag WHEN 'A' THEN 'P0' WHEN 'N' THEN 'P1' ELSE 'P2' END AS severity
  FROM lineitem""",
    "changed_files_v": f"""
  SELECT {_file('o_orderkey')} AS file FROM orders""",
    "batch_v": """
  SELECT id, repo, pr_number, review_id, user_login, '[edited] ' || body AS body, path, line,
         original_line, side, diff_hunk, commit_id, author_association, in_reply_to_id,
         created_at, updated_at + INTERVAL 1 DAY AS updated_at, html_url
  FROM comments_v WHERE id % 5 = 0""",
    "state_v": f"""
  SELECT DISTINCT repo, TIMESTAMP '{b.STATE_WATERMARK}' AS last_fetched_at,
         CAST({b.STATE_LAST_NUMBER} AS BIGINT) AS last_pr_number
  FROM prs_v WHERE CAST(regexp_extract(repo, '(\\d+)$', 1) AS BIGINT) % 2 = 0""",
    "upserted_v": """
  SELECT * EXCLUDE (src, rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, src DESC) AS rn
    FROM (SELECT *, 0 AS src FROM comments_v UNION ALL SELECT *, 1 AS src FROM batch_v))
  WHERE rn = 1""",
    "repo_lines_v": """
  SELECT page_id AS line_no,
         CASE WHEN page_id % 2 = 0
              THEN regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1) || '/' ||
                   regexp_extract(url, '^[A-Za-z]+://[^/?#]+/([^/?#]*)', 1)
              ELSE url END AS line
  FROM pages
  UNION ALL
  SELECT * FROM (VALUES """ + ", ".join(f"({n}, {_q(s)})" for n, s in b.LITERAL_REPO_LINES)
    + """) t(line_no, line)""",
}


def tag_scores_sql(rules, src: str = "comments_v") -> str:
    """D2 in DuckDB SQL: one row per (comment, tag) with score >= 0.3."""
    parts = []
    for tag, fields in tagging._grouped(rules).items():
        terms = []
        for field, w in tagging.FIELD_WEIGHTS.items():
            if field in fields:
                col = tagging.FIELD_COLUMNS[field]
                pat = tagging.combined_pattern(fields[field], dialect="duckdb")
                terms.append(f"(CASE WHEN regexp_matches(coalesce({col}, ''), {_q(pat)}) "
                             f"THEN CAST({w!r} AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END)")
        score = "(CAST(0.0 AS DOUBLE) + " + " + ".join(terms) + ")"
        parts.append(f"SELECT id AS comment_id, {_q(tag)} AS tag, {score} AS score FROM {src}")
    union = "\n  UNION ALL ".join(parts)
    return (f"SELECT comment_id, tag, least(score, CAST({tagging.MAX_CONFIDENCE!r} AS DOUBLE)) AS confidence "
            f"FROM ({union}) s WHERE score >= CAST({tagging.MIN_SCORE!r} AS DOUBLE)")


def tags_values_sql(rules) -> str:
    rows = ", ".join(f"({i + 1}, {_q(n)}, {_q(d)})" for i, (n, d) in enumerate(tagging.rule_tags(rules)))
    return f"SELECT * FROM (VALUES {rows}) t(id, name, description)"


# derived views: tags and assignments from the full test rule set
VIEWS["tags_v"] = tags_values_sql(fixture_rules.TEST_RULES)
VIEWS["comment_tags_v"] = f"""
  SELECT m.comment_id, t.id AS tag_id, m.confidence
  FROM ({tag_scores_sql(fixture_rules.TEST_RULES)}) m JOIN tags_v t ON t.name = m.tag"""

_ORDER = ["comments_v", "prs_v", "reviews_v", "embeddings_v", "queries_v", "findings_v",
          "changed_files_v", "batch_v", "upserted_v", "state_v", "repo_lines_v", "tags_v",
          "comment_tags_v"]


def with_views(sql: str, extra: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``sql`` with the CTEs of every fixture view it mentions
    (plus views they depend on), followed by ``extra`` CTEs in order."""
    need = set()
    text = sql + " ".join(s for _, s in (extra or []))
    changed = True
    while changed:
        changed = False
        for name in _ORDER:
            if name not in need and (name in text or any(name in VIEWS[n] for n in need)):
                need.add(name)
                changed = True
    ctes = [f"{n} AS ({VIEWS[n]})" for n in _ORDER if n in need]
    ctes += [f"{n} AS ({s})" for n, s in (extra or [])]
    if not ctes:
        return sql
    return "WITH " + ",\n".join(ctes) + "\n" + sql


# SQL spellings of scalar helpers shared by several oracle queries -----------
WS = tx.WS
STOP_LIST = "[" + ", ".join(_q(s) for s in tx.STOPWORDS) + "]"


def dirname_sql(p: str) -> str:
    head = f"regexp_extract({p}, '(?s)^(.*/)', 1)"
    return (f"(CASE WHEN {p} IS NULL THEN NULL WHEN regexp_matches({head}, '^/+$') THEN {head} "
            f"ELSE regexp_replace({head}, '/+$', '') END)")


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, {_q('^' + WS + '+|' + WS + '+$')}, '', 'g')"


def terms_sql(src: str, id_col: str, text_col: str) -> str:
    """B4 in DuckDB SQL: (id_col, pos, term) rows, pos = first-seen order."""
    return f"""
SELECT {id_col}, term, row_number() OVER (PARTITION BY {id_col} ORDER BY first_pos) AS pos
FROM (SELECT {id_col}, lower(w) AS term, min(i) AS first_pos
      FROM (SELECT {id_col}, unnest(regexp_extract_all({text_col}, '[\\p{{L}}\\p{{N}}_]+')) AS w,
                   generate_subscripts(regexp_extract_all({text_col}, '[\\p{{L}}\\p{{N}}_]+'), 1) AS i
            FROM {src})
      WHERE regexp_full_match(w, '[a-zA-Z]{{3,}}') AND NOT list_contains({STOP_LIST}, lower(w))
      GROUP BY {id_col}, lower(w))"""


# ---- search (F1-F8, C3-C5) in DuckDB SQL --------------------------------------
def _tok(x: str) -> str:
    return (f"regexp_extract_all(translate(lower(coalesce({x}, '')), {_q(tx.FOLD_FROM)}, "
            f"{_q(tx.FOLD_TO)}), '[\\p{{L}}\\p{{N}}]+')")


def _d(v: float) -> str:
    return f"CAST({v!r} AS DOUBLE)"


def search_ctes() -> list[tuple[str, str]]:
    from ..operators import fusion, postings as P
    k1, bb = P.K1, P.B
    idf = f"ln((c.ndocs - v.df + {_d(0.5)}) / (v.df + {_d(0.5)}))"
    return [
        ("q", f"""
  SELECT query_id, title AS qtext, coalesce(NULLIF("limit", 0), {tx.DEFAULT_LIMIT}) AS lim,
         {P.OVERSAMPLE} * coalesce(NULLIF("limit", 0), {tx.DEFAULT_LIMIT}) AS k,
         coalesce(len(tags), 0) > 0 AS restricted, tags, qvec
  FROM queries_v WHERE NOT regexp_full_match(coalesce(title, ''), {_q(WS + '*')})"""),
        ("qterms", terms_sql("q", "query_id", "qtext")),
        ("dtok", f"SELECT id, list_concat({_tok('body')}, {_tok('path')}, {_tok('diff_hunk')}) AS toks FROM comments_v"),
        ("doclen", "SELECT id, len(toks) AS dl FROM dtok"),
        ("post", "SELECT term, id, count(*) AS tf FROM (SELECT id, unnest(toks) AS term FROM dtok) GROUP BY term, id"),
        ("vocab", "SELECT term, count(*) AS df FROM post GROUP BY term"),
        ("corpus", "SELECT count(*) AS ndocs, sum(dl) AS total_len, sum(dl) / count(*) AS avgdl FROM doclen"),
        ("cands", """
  SELECT DISTINCT u.query_id, ct.comment_id AS id
  FROM (SELECT query_id, unnest(tags) AS name FROM q WHERE restricted) u
  JOIN tags_v t ON t.name = u.name JOIN comment_tags_v ct ON ct.tag_id = t.id"""),
        ("contrib", f"""
  SELECT qt.query_id, p.id, qt.pos,
         (CASE WHEN {idf} <= 0 THEN {_d(P.IDF_FLOOR)} ELSE {idf} END)
           * (CAST(p.tf AS DOUBLE) * {_d(k1 + 1.0)})
           / (CAST(p.tf AS DOUBLE) + {_d(k1)} * ({_d(1.0)} - {_d(bb)} + {_d(bb)} * CAST(d.dl AS DOUBLE) / c.avgdl)) AS c
  FROM qterms qt JOIN vocab v ON v.term = qt.term JOIN post p ON p.term = qt.term
  JOIN doclen d ON d.id = p.id CROSS JOIN corpus c"""),
        ("bm25", f"""
  SELECT s.query_id, s.id, s.score,
         CAST(row_number() OVER (PARTITION BY s.query_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
  FROM (SELECT query_id, id,
               CAST((sum(CAST(floor(c * CAST({P.SCORE_UNITS} AS DOUBLE)) AS BIGINT)) + 500) // 1000 AS DOUBLE)
                 / CAST(1000000000 AS DOUBLE) AS score
        FROM contrib GROUP BY query_id, id) s
  JOIN q ON q.query_id = s.query_id
  WHERE NOT q.restricted OR EXISTS (SELECT 1 FROM cands x WHERE x.query_id = s.query_id AND x.id = s.id)
  QUALIFY rank <= q.k"""),
        ("cosine", f"""
  SELECT s.query_id, s.id, s.score,
         CAST(row_number() OVER (PARTITION BY s.query_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
  FROM (SELECT q.query_id, e.comment_id AS id, q.k,
               round(list_dot_product(q.qvec::DOUBLE[], e.embedding::DOUBLE[]), {P.SCORE_DECIMALS}) AS score
        FROM q JOIN embeddings_v e ON q.qvec IS NOT NULL
        WHERE NOT q.restricted
           OR EXISTS (SELECT 1 FROM cands x WHERE x.query_id = q.query_id AND x.id = e.comment_id)) s
  QUALIFY rank <= s.k"""),
        ("fused", f"""
  SELECT query_id, id, coalesce(f, {_d(0.0)}) + coalesce(v, {_d(0.0)}) AS score,
         CASE WHEN f IS NOT NULL AND v IS NOT NULL THEN 'hybrid' WHEN f IS NOT NULL THEN 'fts'
              ELSE 'vector' END AS match_source
  FROM (SELECT query_id, id, max(f) AS f, max(v) AS v FROM (
          SELECT query_id, id, {_d(fusion.FTS_WEIGHT)} / ({fusion.RRF_K} + rank) AS f, CAST(NULL AS DOUBLE) AS v FROM bm25
          UNION ALL
          SELECT query_id, id, CAST(NULL AS DOUBLE), {_d(fusion.VECTOR_WEIGHT)} / ({fusion.RRF_K} + rank) FROM cosine)
        GROUP BY query_id, id)"""),
        ("rrf", """
  SELECT f.query_id, f.id, f.score, f.match_source,
         CAST(row_number() OVER (PARTITION BY f.query_id ORDER BY f.score DESC, f.id) AS INTEGER) AS rank
  FROM fused f JOIN q ON q.query_id = f.query_id
  QUALIFY rank <= q.lim"""),
        ("tagnames", """
  SELECT ct.comment_id AS id, string_agg(t.name, ',' ORDER BY t.name) AS tags
  FROM comment_tags_v ct JOIN tags_v t ON t.id = ct.tag_id GROUP BY ct.comment_id"""),
    ]




def search_sql(final: str) -> str:
    return with_views(final, extra=search_ctes())


def wide_search_sql(final: str) -> str:
    """The same over the queries with small and large limits."""
    limits = f"([{', '.join(map(str, b.WIDE_LIMITS))}])[(bm.item_id % {len(b.WIDE_LIMITS)}) + 1]"
    return search_sql(final).replace(f'{b.QUERY_LIMIT} AS "limit"', f'{limits} AS "limit"')
