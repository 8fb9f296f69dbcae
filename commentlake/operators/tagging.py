"""Rule-based comment tagging.

Rules are data: ``(tag, description, field, pattern)`` with ``field`` one of
``body`` / ``path`` / ``hunk``, as a list or a table (``schemas.RULES``).  They
become literals of one narrow projection, so Spark compiles every pattern once per
task: no join, no shuffle (plan test checks).  A pattern runs only on rows that hold
one of its required literals: plain substrings that every match contains, looked up
in the field's folded text first.  Whole-word lists are matched against the field's
token set instead.

Scoring (fixed values that must equal the reference's): a body hit adds 0.5,
a path hit 0.3, a hunk hit 0.2 (added in that order, in doubles); a tag is
kept when the score is >= 0.3 and the confidence is min(score, 1.0).  A hunk
hit alone (0.2) therefore never tags a comment.
"""

from __future__ import annotations

import re
from collections import OrderedDict
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.sizing import checked_broadcast

# --- fixed values that must equal the reference's ---------------------------
FIELD_WEIGHTS = OrderedDict([("body", 0.5), ("path", 0.3), ("hunk", 0.2)])
MIN_SCORE = 0.3
MAX_CONFIDENCE = 1.0
# -----------------------------------------------------------------------------

FIELD_COLUMNS = {"body": "body", "path": "path", "hunk": "diff_hunk"}

# Word boundary spelled out (RE2 has only an ASCII \b).
_NW = r"[^\p{L}\p{N}_]"


class WordPattern(str):
    """A whole-word alternation.  It is a plain regex string (any engine can
    run it); the word list is kept so that single-token words can be matched
    against the row's token set instead of scanning the text once per rule."""
    words: tuple = ()


_TOKEN_WORD = re.compile(r"^[^\W]+$")
#: Shortest literal that is worth a look.
MIN_LITERAL = 3


def words(*ws: str) -> str:
    """Regex matching any of the given words as a whole word (case folded by
    the matcher).  The boundary is factored out of the alternation."""
    p = WordPattern(f"(?:^|{_NW})(?:{'|'.join(ws)})(?:$|{_NW})")
    p.words = tuple(ws)
    return p


def _token_words(p) -> tuple | None:
    """Lower-cased words when every alternative is one plain token; a pattern that
    was stored as a plain string is known by the form that ``words`` gives it."""
    ws = getattr(p, "words", ())
    head, tail = f"(?:^|{_NW})(?:", f")(?:$|{_NW})"
    if not ws and p.startswith(head) and p.endswith(tail) and len(p) > len(head) + len(tail):
        ws = tuple(p[len(head):-len(tail)].split("|"))
    if ws and all(_TOKEN_WORD.match(w) for w in ws):
        return tuple(w.lower() for w in ws)
    return None


@dataclass(frozen=True)
class Rule:
    tag: str
    description: str
    field: str
    pattern: str


def rule_set(spec) -> list[Rule]:
    """Build rules from ``(tag, description, {field: [patterns]})`` entries."""
    out = []
    for tag, desc, fields in spec:
        for field, pats in fields.items():
            for p in pats:
                out.append(Rule(tag, desc, field, p))
    return out


def rule_tags(rules: list[Rule]) -> list[tuple[str, str]]:
    """Distinct (tag, description) in first-seen rule order."""
    seen = OrderedDict()
    for r in rules:
        seen.setdefault(r.tag, r.description)
    return list(seen.items())


def _grouped(rules: list[Rule]):
    g = OrderedDict()
    for r in rules:
        g.setdefault(r.tag, OrderedDict()).setdefault(r.field, []).append(r.pattern)
    return g


def combined_pattern(patterns: list[str], dialect: str = "spark") -> str:
    """One case-insensitive search pattern for a (tag, field) group."""
    body = patterns[0] if len(patterns) == 1 else "|".join(f"(?:{p})" for p in patterns)
    # java.util.regex: i = case-insensitive, d = only \n ends a line, U = Unicode
    # classes and case folding.  RE2: (?i) is Unicode aware already.
    return ("(?idU)" if dialect == "spark" else "(?i)") + body


def rules_of(table: DataFrame) -> list[Rule]:
    """The rules of a table (``schemas.RULES``) in the order of ``ordinal``; a
    dimension of some hundreds or thousands of rows that becomes part of the plan."""
    rows = table.select("tag", "description", "field", "pattern", "ordinal").orderBy("ordinal", "tag", "field", "pattern").collect()
    return [Rule(r.tag, r.description, r.field, r.pattern) for r in rows]


def rules_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """The inverse of ``rules_of``."""
    from ..schemas import RULES
    return spark.createDataFrame([(r.tag, r.description, r.field, str(r.pattern), i) for i, r in enumerate(rules)], RULES)


def _alternatives(pattern: str) -> list[str]:
    """The pattern parted at the bars that stand in no group or class."""
    out, depth, at, k, klass = [], 0, 0, 0, False
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            k += 1
        elif klass:
            klass = c != "]"
        elif c == "[":
            klass = True
            k += pattern[k + 1:k + 2] == "]"
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and depth == 0:
            out.append(pattern[at:k])
            at = k + 1
        k += 1
    return [*out, pattern[at:]]


def _longest_literal(pattern: str) -> str:
    """The longest run of ASCII letters, digits and escaped or plain punctuation that
    every match of a pattern without top-level bars contains."""
    best, run, k, depth = "", "", 0, 0

    def end() -> None:
        nonlocal best, run
        best, run = max(best, run, key=len), ""

    while k < len(pattern):
        c = pattern[k]
        size, char = 1, c
        if c == "\\":
            size, char = 2, pattern[k + 1:k + 2]
            if char.isalnum() or not char.isascii() or not char:
                char = None                                # a class, a boundary, a number
                if pattern[k + 1:k + 3] in ("p{", "P{", "x{"):
                    size = pattern.find("}", k) - k + 1
        elif c == "[":
            close = k + 2 if pattern[k + 1:k + 2] == "]" else k + 1
            while close < len(pattern) and pattern[close] != "]":
                close += 2 if pattern[close] == "\\" else 1
            size, char = close - k + 1, None
        elif c == "(":
            depth, close = 1, k + 1
            while close < len(pattern) and depth:
                depth += {"(": 1, ")": -1}.get(pattern[close], 0) if pattern[close - 1] != "\\" else 0
                close += 1
            size, char = close - k, None
        elif c in ".^$" or not c.isascii():
            char = None
        k += size
        after = pattern[k:k + 1]
        if char is None:
            end()
        elif after in ("*", "?", "{"):                      # may be absent
            end()
        else:
            run += char
            if after == "+":
                end()
        if after == "{":
            k = pattern.find("}", k) + 1
        elif after in ("*", "?", "+") and after:
            k += 1
        while pattern[k:k + 1] in ("?", "+") and after in ("*", "?", "+", "{") and after:
            k += 1                                          # lazy or possessive
    end()
    return best.lower()


def required_literals(pattern: str) -> list[str] | None:
    """Lower-case substrings of which every match holds one; None if some match may
    hold none worth looking for.  Patterns with flags or quotes are left alone."""
    if "(?" in pattern.replace("(?:", "") or "\\Q" in pattern or "#" in pattern or "&&" in pattern:
        return None
    found = [_longest_literal(p) for p in _alternatives(pattern)]
    return list(dict.fromkeys(found)) if all(len(x) >= MIN_LITERAL for x in found) else None


def folded(field: str) -> Column:
    """A field's text such that it holds the literal of every match: letters that a
    case-insensitive search takes for ASCII ones (long s, Kelvin sign, dotted and
    dotless i) have become these."""
    text = F.lower(_field(field))
    for letter, plain in (("\u0131", "i"), ("\u017F", "s"), ("\u0307", "")):
        text = F.replace(text, F.lit(letter), F.lit(plain))
    return text


def _field(df_field: str) -> Column:
    return F.coalesce(F.col(FIELD_COLUMNS[df_field]), F.lit(""))


_TOK = {f: f"_tok_{f}" for f in FIELD_COLUMNS}
_FOLD = {f: f"_fold_{f}" for f in FIELD_COLUMNS}


def _hit(field: str, patterns: list[str], used: set) -> Column:
    """Search hit of any pattern in a field: single-token word lists are an
    ``arrays_overlap`` with the field's token set (one tokenisation per field),
    patterns with required literals run where one is held, and the others are one
    combined case-insensitive regex.  ``used`` collects the helper columns."""
    toks, regex, tests = [], [], []
    for p in patterns:
        tw, literals = _token_words(p), required_literals(p)
        if tw is not None:
            toks.extend(tw)
        elif literals:
            used.add(_FOLD[field])
            held = reduce(Column.__or__, (F.contains(F.col(_FOLD[field]), F.lit(x)) for x in literals))
            tests.append(held & _field(field).rlike(combined_pattern([p])))
        else:
            regex.append(p)
    if toks:
        used.add(_TOK[field])
        tests.insert(0, F.arrays_overlap(F.col(_TOK[field]), F.array(*[F.lit(w) for w in dict.fromkeys(toks)])))
    if regex:
        tests.append(_field(field).rlike(combined_pattern(regex)))
    return reduce(Column.__or__, tests)


def rule_scores(rules: list[Rule], used: set | None = None) -> Column:
    """array<struct<tag string, confidence double>> of the tags a row earns."""
    used = set() if used is None else used
    items = []
    for tag, fields in _grouped(rules).items():
        score = F.lit(0.0)
        for field, w in FIELD_WEIGHTS.items():
            if field in fields:
                hit = _hit(field, fields[field], used)
                score = score + F.when(hit, F.lit(w)).otherwise(F.lit(0.0))
        items.append(F.struct(F.lit(tag).alias("tag"), score.alias("score")))
    arr = F.array(*items)
    kept = F.filter(arr, lambda x: x["score"] >= F.lit(MIN_SCORE))
    return F.transform(kept, lambda x: F.struct(
        x["tag"].alias("tag"), F.least(x["score"], F.lit(MAX_CONFIDENCE)).alias("confidence")))


def field_tokens(field: str) -> Column:
    """Lower-cased word-character runs of a field (the whole-word units)."""
    return F.array_distinct(F.regexp_extract_all(F.lower(_field(field)), F.lit(r"[\p{L}\p{N}_]+"), 0))


def match_rules(comments: DataFrame, rules: list[Rule] | DataFrame) -> DataFrame:
    """(comment_id, tag, confidence) for every rule tag a comment earns.
    Narrow projections + a generator: no exchange in the plan.  Each field
    is tokenised and folded once, if a rule needs it.  ``rules``: a list or a table."""
    rules = rules_of(rules) if isinstance(rules, DataFrame) else rules
    none = "comment_id long, tag string, confidence double"
    if not rules:
        return comments.sparkSession.createDataFrame([], none)
    used: set = set()
    scores = rule_scores(rules, used)
    base = comments.select("id", *[F.col(c) for c in FIELD_COLUMNS.values() if c in comments.columns])
    for f in FIELD_COLUMNS:
        if _TOK[f] in used:
            base = base.withColumn(_TOK[f], field_tokens(f))
        if _FOLD[f] in used:
            base = base.withColumn(_FOLD[f], folded(f))
    m = base.select(F.col("id").alias("comment_id"), F.explode(scores).alias("m"))
    return m.select("comment_id", F.col("m.tag").alias("tag"),
                    F.col("m.confidence").alias("confidence"))


def seed_tags(tags: DataFrame | None, rules: list[Rule], spark=None) -> DataFrame:
    """Insert the rule tags that are missing, keep existing ids; new ids
    continue after max(id) in rule order.  The tag dimension is tiny: its
    size is bounded by the number of rules plus the existing tag count."""
    rt = rule_tags(rules)
    spark = spark or (tags.sparkSession if tags is not None else None)
    wanted = spark.createDataFrame(
        [(i, n, d) for i, (n, d) in enumerate(rt)],
        "ordinal long, name string, description string")
    if tags is None:
        tags = spark.createDataFrame([], "id long, name string, description string")
    new = wanted.join(tags.select("name"), "name", "left_anti")
    base = tags.select(F.coalesce(F.max("id"), F.lit(0)).cast("long")).scalar()
    w = Window.orderBy("ordinal")  # bounded: at most len(rules) rows
    added = new.select((base + F.row_number().over(w)).cast("long").alias("id"),
                       "name", "description")
    return tags.select("id", "name", "description").unionByName(added)


def assign_tags(existing: DataFrame, matches: DataFrame, tags: DataFrame,
                replace: bool = False) -> DataFrame:
    """D3: INSERT OR IGNORE of (comment_id, tag_id) pairs.  With
    ``replace=True`` (mode "all", Q3) the new confidence replaces the old."""
    t = checked_broadcast(tags.select(F.col("id").alias("tag_id"), F.col("name").alias("tag")))
    new = matches.join(t, "tag").select("comment_id", "tag_id", "confidence")
    keys = ["comment_id", "tag_id"]
    if replace:
        return existing.join(new.select(*keys), keys, "left_anti").unionByName(new)
    return existing.unionByName(new.join(existing.select(*keys), keys, "left_anti"))


def untagged(comments: DataFrame, comment_tags: DataFrame) -> DataFrame:
    """Comments without any tag assignment (anti-join)."""
    return comments.join(comment_tags.select(F.col("comment_id").alias("id")), "id", "left_anti")


def tag_comments(comments: DataFrame, comment_tags: DataFrame, tags: DataFrame | None,
                 rules: list[Rule], mode: str = "untagged",
                 observation: Observation | None = None):
    """D4 / D5.  ``mode="untagged"`` (reference behaviour, Q2): only comments
    with no assignment are matched, existing confidences are kept (Q3).
    ``mode="all"``: every comment is matched again and assignments replaced.
    Returns ``(tags, comment_tags)``; the number of matches is reported
    through ``observation`` (metric ``matches``) without an extra job."""
    spark = comments.sparkSession
    rules = rules_of(rules) if isinstance(rules, DataFrame) else rules
    tags2 = seed_tags(tags, rules, spark)
    todo = comments if mode == "all" else untagged(comments, comment_tags)
    matches = match_rules(todo, rules)
    if observation is not None:
        matches = matches.observe(observation, F.count(F.lit(1)).alias("matches"))
    if mode == "all":
        t = checked_broadcast(tags2.select(F.col("id").alias("tag_id"), F.col("name").alias("tag")))
        return tags2, matches.join(t, "tag").select("comment_id", "tag_id", "confidence")
    return tags2, assign_tags(comment_tags, matches, tags2)


def retag_all(comments: DataFrame, tags: DataFrame | None, rules: list[Rule]):
    """Drop every assignment and classify all comments again."""
    empty = comments.sparkSession.createDataFrame(
        [], T.StructType([T.StructField("comment_id", T.LongType()),
                          T.StructField("tag_id", T.LongType()),
                          T.StructField("confidence", T.DoubleType())]))
    return tag_comments(comments, empty, tags, rules, mode="all")
