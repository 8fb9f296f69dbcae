"""Explicit schemas of the knowledge-base tables and of the raw
host JSON (FIXTURES 1).  Nothing is inferred at read time."""

from pyspark.sql import types as T

L, S, D, TS = T.LongType(), T.StringType(), T.DoubleType(), T.TimestampNTZType()


def _st(*fields):
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


USER = _st(("login", S, True))
REF = _st(("ref", S, True))

# ---- raw JSON as landed from the review host --------------------------------
RAW_PULL = _st(
    ("id", L, True), ("number", L, True), ("title", S, True), ("user", USER, True),
    ("merged_at", S, True), ("created_at", S, True), ("updated_at", S, True),
    ("html_url", S, True), ("state", S, True), ("base", REF, True), ("head", REF, True),
    ("repo", S, True),
)
RAW_COMMENT = _st(
    ("id", L, True), ("pull_request_review_id", L, True), ("user", USER, True),
    ("body", S, True), ("path", S, True), ("line", L, True), ("original_line", L, True),
    ("side", S, True), ("diff_hunk", S, True), ("commit_id", S, True),
    ("author_association", S, True), ("in_reply_to_id", L, True),
    ("created_at", S, True), ("updated_at", S, True), ("html_url", S, True),
    ("repo", S, True), ("pr_number", L, True),
)
RAW_REVIEW = _st(
    ("id", L, True), ("user", USER, True), ("state", S, True), ("body", S, True),
    ("submitted_at", S, True), ("repo", S, True), ("pr_number", L, True),
)
RAW_DIFF = _st(("repo", S, True), ("pr_number", L, True), ("diff", S, True),
               ("fetched_at", S, True))

# ---- tables after ingest ----------------------------------------------------
PULL_REQUESTS = _st(
    ("id", L, False), ("repo", S, False), ("number", L, False), ("title", S, False),
    ("user_login", S, False), ("merged_at", TS, True), ("created_at", TS, False),
    ("updated_at", TS, False), ("html_url", S, False),
)
COLLECTED_PULL_REQUESTS = T.StructType(PULL_REQUESTS.fields + [
    T.StructField("state", S, True), T.StructField("base_ref", S, True),
    T.StructField("head_ref", S, True), T.StructField("fetched_by", S, True),
    T.StructField("fetched_at", TS, False),
])
REVIEWS = _st(
    ("id", L, False), ("repo", S, False), ("pr_number", L, False), ("user_login", S, False),
    ("state", S, False), ("body", S, True), ("submitted_at", TS, False),
)
COMMENTS = _st(
    ("id", L, False), ("repo", S, False), ("pr_number", L, False), ("review_id", L, True),
    ("user_login", S, False), ("body", S, False), ("path", S, True), ("line", L, True),
    ("original_line", L, True), ("side", S, True), ("diff_hunk", S, True),
    ("commit_id", S, True), ("author_association", S, True), ("in_reply_to_id", L, True),
    ("created_at", TS, False), ("updated_at", TS, False), ("html_url", S, False),
)
PR_DIFFS = _st(("repo", S, False), ("pr_number", L, False), ("diff", S, False),
               ("fetched_at", TS, False))
COMMENT_EMBEDDINGS = _st(("comment_id", L, False), ("embedding", T.ArrayType(T.FloatType()), False),
                         ("model", S, False), ("created_at", TS, False))
TAGS = _st(("id", L, False), ("name", S, False), ("description", S, True))
COMMENT_TAGS = _st(("comment_id", L, False), ("tag_id", L, False), ("confidence", D, True))
FETCH_STATE = _st(("repo", S, False), ("last_fetched_at", TS, False), ("last_pr_number", L, True))
CONVENTIONS = _st(
    ("id", L, False), ("title", S, False), ("body", S, False), ("category", S, True),
    ("file_patterns", T.ArrayType(S), True), ("source_comment_ids", T.ArrayType(L), False),
    ("confidence", D, True), ("created_at", TS, False), ("updated_at", TS, False),
)
RULES = _st(("tag", S, False), ("description", S, True), ("field", S, False),
            ("pattern", S, False), ("ordinal", L, False))
QUERIES = _st(
    ("query_id", L, False), ("title", S, True), ("paths", T.ArrayType(S), True),
    ("diff", S, True), ("commits", T.ArrayType(S), True), ("tags", T.ArrayType(S), True),
    ("limit", T.IntegerType(), True),
)
FINDINGS = _st(("file", S, False), ("line", L, False), ("issue", S, False), ("severity", S, False))

# key columns per table (merge keys of A11, checked by A14)
PRIMARY_KEYS = {
    "pull_requests": ["id"], "reviews": ["id"], "comments": ["id"],
    "pr_diffs": ["repo", "pr_number"], "comment_embeddings": ["comment_id"],
    "tags": ["id"], "comment_tags": ["comment_id", "tag_id"], "fetch_state": ["repo"],
}
