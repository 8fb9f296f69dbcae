"""Scalar Column -> Column functions.

All of these are built-in Spark expressions (JVM side, no Python workers).
Whitespace and word characters are spelled out as explicit classes so that
Spark (java.util.regex) and the DuckDB oracle (RE2) agree with each other and
with Python's ``str.split`` / ``str.strip`` / ``\\w`` on the same input.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values that must equal the reference's ---------------------------
# Search-term stopwords, in the reference's order.
STOPWORDS = [
    "the", "and", "for", "this", "that", "with", "from", "are", "was", "were",
    "have", "has", "been", "will", "can", "not", "but", "all", "any", "each",
    "src", "dist", "node_modules", "import", "export", "const", "let", "var",
    "function", "return", "class", "new", "null", "undefined", "true", "false",
]
SUMMARY_MAX_CHARS = 200        # report body summary length
HUNK_MAX_LINES = 6             # report hunk clip
LONG_URL_MIN = 80              # chars after :// that make a URL "long"
DEFAULT_LIMIT = 15
FILE_LABEL, HUNK_LABEL = "File: ", "Code context:\n"      # embedded text
# -----------------------------------------------------------------------------

# Python's str.isspace() set, as one regex class (valid in Java and RE2).
_WS_SET = (r"\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
           r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
WS = f"[{_WS_SET}]"              # portable spelling (RE2 / DuckDB oracle)
NON_WS = f"[^{_WS_SET}]"
# The same set for java.util.regex, ~3x faster to match: Unicode White_Space
# plus the four separators U+001C..U+001F (checked equal code point by code
# point in the tests).
WS_J = r"(?U:[\s\x{1C}-\x{1F}])"
NON_WS_J = r"(?U:[^\s\x{1C}-\x{1F}])"
# Python's \w for str patterns: letters, numbers, underscore.
WORD_RUN = r"[\p{L}\p{N}_]+"
# Full-text tokens (unicode61-style): runs of letters and digits.
FTS_TOKEN = r"[\p{L}\p{N}]+"


def _fold_table() -> tuple[str, str]:
    """Diacritic folding table, derived by rule: every Latin letter in
    U+00C0..U+024F whose canonical decomposition is an ASCII letter followed
    only by combining marks maps to that ASCII letter."""
    src, dst = [], []
    for cp in range(0xC0, 0x250):
        ch = chr(cp)
        nfd = unicodedata.normalize("NFD", ch)
        if (len(nfd) > 1 and nfd[0].isascii() and nfd[0].isalpha()
                and all(unicodedata.category(c) == "Mn" for c in nfd[1:])):
            src.append(ch)
            dst.append(nfd[0])
    return "".join(src), "".join(dst)


FOLD_FROM, FOLD_TO = _fold_table()


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nonempty(x) -> Column:
    """True when a string is neither null nor empty (Python truthiness)."""
    x = _c(x)
    return x.isNotNull() & (x != F.lit(""))


def py_strip(x) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(_c(x), f"^{WS_J}+|{WS_J}+$", "")


# B3 ------------------------------------------------------------------------
def dirname(path) -> Column:
    """POSIX ``os.path.dirname``: text up to the last '/', trailing
    slashes removed unless the head is only slashes ('/c' -> '/')."""
    p = _c(path)
    head = F.regexp_extract(p, r"(?s)^(.*/)", 1)
    return (F.when(p.isNull(), F.lit(None).cast("string"))
            .when(head.rlike("^/+$"), head)
            .otherwise(F.regexp_replace(head, "/+$", "")))


def group_key(path) -> Column:
    """G2 key: dirname of a non-empty path, else 'general'."""
    return F.when(nonempty(path), dirname(path)).otherwise(F.lit("general"))


# B1 ------------------------------------------------------------------------
def embed_text(path, body, hunk) -> Column:
    """B1: 'File: <path>' (if path), body, 'Code context:\\n<hunk>' (if hunk),
    joined by newlines."""
    path, body, hunk = _c(path), _c(body), _c(hunk)
    return F.concat_ws(
        "\n",
        F.when(nonempty(path), F.concat(F.lit(FILE_LABEL), path)),
        F.coalesce(body, F.lit("")),
        F.when(nonempty(hunk), F.concat(F.lit(HUNK_LABEL), hunk)),
    )


# B2 ------------------------------------------------------------------------
def query_text(title=None, paths=None, diff=None, commits=None, max_diff: int | None = None,
               max_commits: int | None = None) -> Column:
    """B2: title; each path followed by its dirname (if non-empty); the diff;
    the commit messages — joined by newlines.  ``max_diff`` characters and
    ``max_commits`` messages only if asked for."""
    parts = []
    if title is not None:
        parts.append(F.when(nonempty(title), _c(title)))
    if paths is not None:
        parts.append(F.flatten(F.transform(
            _c(paths),
            lambda p: F.array(p, F.when(nonempty(dirname(p)), dirname(p))))))
    if diff is not None:
        parts.append(F.when(nonempty(diff), F.substring(_c(diff), 1, max_diff) if max_diff else _c(diff)))
    if commits is not None:
        parts.append(F.slice(_c(commits), 1, max_commits) if max_commits else _c(commits))
    if not parts:
        return F.lit("")
    return F.concat_ws("\n", *parts)


def is_blank(x) -> Column:
    """``not s.strip()`` in Python terms."""
    return F.coalesce(_c(x), F.lit("")).rlike(f"^{WS_J}*$")


# B4 ------------------------------------------------------------------------
def search_terms(text, max_terms: int | None = None) -> Column:
    """ASCII words of 3+ letters that form a whole word, lower-cased,
    stopwords removed, de-duplicated in first-seen order (the first ``max_terms``
    only if asked for)."""
    runs = F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(WORD_RUN), 0)
    words = F.transform(F.filter(runs, lambda w: w.rlike("^[a-zA-Z]{3,}$")), F.lower)
    stop = F.array(*[F.lit(s) for s in STOPWORDS])
    kept = F.array_distinct(F.filter(words, lambda w: ~F.array_contains(stop, w)))
    return F.slice(kept, 1, max_terms) if max_terms else kept


# B5 ------------------------------------------------------------------------
def summarize_body(body, max_length: int = SUMMARY_MAX_CHARS) -> Column:
    """Images -> [image], long URLs -> [long-url], strip, then keep lines
    while the running length stays <= max_length, clipping the crossing line
    with '...'; kept lines joined by a space."""
    b = F.coalesce(_c(body), F.lit(""))
    b = F.regexp_replace(b, r"(?d)!\[.*?\]\(.*?\)", "[image]")
    b = F.regexp_replace(b, r"https?://" + NON_WS_J + "{%d,}" % LONG_URL_MIN, "[long-url]")
    lines = F.split(py_strip(b), "\n")
    init = F.struct(F.lit(0).alias("n"), F.lit(False).alias("done"),
                    F.array().cast("array<string>").alias("out"))

    def step(acc, line):
        cut = F.concat(F.substr(line, F.lit(1), F.lit(max_length) - acc["n"]), F.lit("..."))
        return (F.when(acc["done"], acc)
                .when(acc["n"] + F.length(line) > F.lit(max_length),
                      F.struct(acc["n"].alias("n"), F.lit(True).alias("done"),
                               F.array_append(acc["out"], cut).alias("out")))
                .otherwise(F.struct((acc["n"] + F.length(line)).alias("n"),
                                    F.lit(False).alias("done"),
                                    F.array_append(acc["out"], line).alias("out"))))

    return F.aggregate(lines, init, step, lambda acc: F.array_join(acc["out"], " "))


# B6 ------------------------------------------------------------------------
def truncate_hunk(hunk, max_lines: int = HUNK_MAX_LINES) -> Column:
    """Strip; more than 6 lines -> first 6 lines + '\\n  ...'."""
    s = py_strip(_c(hunk))
    lines = F.split(s, "\n")
    return (F.when(_c(hunk).isNull(), F.lit(None).cast("string"))
            .when(F.size(lines) <= max_lines, s)
            .otherwise(F.concat(F.array_join(F.slice(lines, 1, max_lines), "\n"),
                                F.lit("\n  ..."))))


# B7 ------------------------------------------------------------------------
def location(path, line) -> Column:
    """B7: 'path' or 'path:line' (no suffix when line is null or 0);
    null when there is no path."""
    path, line = _c(path), _c(line)
    return F.when(nonempty(path), F.when(F.coalesce(line, F.lit(0)) != 0,
                                         F.concat(path, F.lit(":"), line.cast("string")))
                  .otherwise(path))


def day(ts) -> Column:
    """ISO date part (first 10 chars of the ISO timestamp)."""
    return F.date_format(_c(ts), "yyyy-MM-dd")


# B9 ------------------------------------------------------------------------
def parse_tags(csv) -> Column:
    """Split on ',' and strip each element; empty elements are kept."""
    return F.transform(F.split(_c(csv), ","), py_strip)


# B10 -----------------------------------------------------------------------
def clamp_limit(n, lo: int = 1, hi: int = 100, default: int = DEFAULT_LIMIT) -> Column:
    """Null -> default, else clamp into [lo, hi]."""
    n = _c(n)
    return F.when(n.isNull(), F.lit(default)).otherwise(F.greatest(F.lit(lo), F.least(n, F.lit(hi))))


def effective_limit(n, default: int = DEFAULT_LIMIT) -> Column:
    """Search limit: 0 or null falls back to the default (Q8)."""
    return F.coalesce(F.nullif(_c(n), F.lit(0)), F.lit(default))


# B13 / B14 -------------------------------------------------------------------
def word_set(text) -> Column:
    """Distinct lower-cased whitespace-separated words."""
    return F.array_distinct(F.array_remove(F.split(F.lower(F.coalesce(_c(text), F.lit(""))), f"{WS_J}+"), ""))


def jaccard(a, b) -> Column:
    """|a ∩ b| / |a ∪ b|; null (not comparable) when either is empty."""
    a, b = _c(a), _c(b)
    return F.when((F.size(a) > 0) & (F.size(b) > 0),
                  F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


# B15 -------------------------------------------------------------------------
def to_json_doc(*cols) -> Column:
    """One JSON document per row."""
    return F.to_json(F.struct(*cols))


# F1 --------------------------------------------------------------------------
def fold_diacritics(x) -> Column:
    return F.translate(_c(x), FOLD_FROM, FOLD_TO)


def fts_tokens(x) -> Column:
    """unicode61-style tokens: case-folded, diacritics removed, runs of
    letters/digits (underscore separates)."""
    return F.regexp_extract_all(fold_diacritics(F.lower(F.coalesce(_c(x), F.lit("")))),
                                F.lit(FTS_TOKEN), 0)
