"""Quality rules: decision lists learned by sequential covering.

``text_stats`` computes word, line and repetition statistics of whole texts.
``learn`` grows threshold conjunctions one at a time on labelled statistics
(best information gain per added condition), prunes each on rows set aside,
removes what it covers and goes on until no rule is precise enough.
``verdict`` turns the ordered list into one Spark ``when`` chain.

Defined results: a null or empty text has all statistics 0 and fails the base
rule; without labelled rows the list is empty and only the base rule rejects;
repeated rows are judged alike; an empty table gives no rows; other columns pass
through untouched.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, labelled_docs, table

#: Labelled documents that the rules are learned from, at most.
TRAIN_LIMIT = 20_000
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct",
         "n_upper", "n_marks", "n_lines")
STATS_TYPE = T.StructType([T.StructField(c, T.LongType()) for c in STATS])


def repeat_words(words: list, first: dict) -> int:
    """Positions inside a 3-word window that occurs at least twice; ``first``
    receives each distinct word."""
    n = len(words)
    ids = np.fromiter(map(first.setdefault, words, itertools.count()), np.int64, n)
    if n < 4:
        return 0
    _, pair = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)
    _, win, count = np.unique(pair[:-1] * n + ids[2:], return_inverse=True, return_counts=True)
    again = count[win] > 1
    if not again.any():
        return 0
    cover = np.zeros(n, bool)
    for k in range(3):
        cover[k:n - 2 + k] |= again
    return int(cover.sum())


def stats_of(text: str | None) -> tuple:
    """Statistics of one text, in the order of STATS.  Words are maximal
    runs of anything but space and \\t to \\r (what ``bytes.split`` parts)."""
    if not text:
        return (0,) * 9
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    first: dict = {}
    repeated = repeat_words(words, first)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    blank = sum(map(text.count, " \t\n\x0b\x0c\r"))
    return (len(words), len(text) - blank, sum(map(text.count, SYMBOLS)),
            len(lines) - len(set(lines)), repeated, len(first),
            sum(w.isupper() for w in words), text.count("!") + text.count("?"), len(lines))


@F.pandas_udf(STATS_TYPE)
def text_stats(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([stats_of(t) for t in texts], columns=list(STATS), dtype="int64")


def ratios(s) -> dict[str, Column]:
    """Features of a rule, from the struct of statistics (0 where undefined)."""
    per = lambda a, b: F.when(s[b] > 0, s[a] / s[b]).otherwise(F.lit(0.0))
    return {"n_words": s["n_words"].cast("double"), "mean_word": per("word_chars", "n_words"),
            "symbols": per("n_symbols", "n_words"), "dup_lines": per("n_dup_lines", "n_lines"),
            "repeats": per("n_repeat_words", "n_words"), "distinct": per("n_distinct", "n_words"),
            "upper": per("n_upper", "n_words"), "marks": per("n_marks", "n_words"),
            "line_words": per("n_words", "n_lines")}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] < self.threshold

    def column(self, x: dict[str, Column]) -> Column:
        c, t = x[self.feature], F.lit(self.threshold)
        return c >= t if self.above else c < t


Rule = tuple[Condition, ...]


def covered(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x, bad, conditions, max_conditions: int) -> Rule:
    """Adds the condition of largest information gain until no good row is left."""
    rule: Rule = ()
    inside = np.ones(len(bad), bool)
    while len(rule) < max_conditions:
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        if not p or not n:
            break
        base, best, pick = np.log2(p / (p + n)), 1e-9, None
        for c, mask in conditions:
            p1, n1 = (mask & inside & bad).sum(), (mask & inside & ~bad).sum()
            if p1 and (gain := p1 * (np.log2(p1 / (p1 + n1)) - base)) > best:
                best, pick = gain, (c, mask)
        if pick is None:
            break
        rule, inside = (*rule, pick[0]), inside & pick[1]
    return rule


def _worth(rule: Rule, x, bad) -> tuple[float, int]:
    """Laplace precision of a rule and the bad rows that it covers."""
    hit = covered(rule, x, len(bad))
    p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
    return (p + 1) / (p + n + 2), p


def learn(x: dict[str, np.ndarray], bad: np.ndarray, min_precision: float = 0.9,
          min_cover: int = 3, cuts: int = 48, max_conditions: int = 3, max_rules: int = 24) -> list[Rule]:
    """Ordered rules for rejecting, from labelled statistics.  Every third row
    is set aside for pruning.  Deterministic for the same rows in the same order."""
    aside = np.arange(len(bad)) % 3 == 2
    part = lambda m: ({k: v[m] for k, v in x.items()}, bad[m])
    (gx, gb), (px, pb) = part(~aside), part(aside)
    rules: list[Rule] = []
    while gb.any() and len(rules) < max_rules:
        conditions = []
        for f, v in gx.items():
            points = np.unique(np.concatenate([np.quantile(v, np.linspace(0, 1, cuts)),
                                               np.quantile(v[gb], np.linspace(0, 1, cuts))]))
            for a, b in itertools.pairwise(points):
                for above in (True, False):
                    c = Condition(f, above, float((a + b) / 2))
                    conditions.append((c, c.holds(gx)))
        rule = _grow(gx, gb, conditions, max_conditions)
        while len(rule) > 1 and _worth(rule[:-1], px, pb) >= _worth(rule, px, pb):
            rule = rule[:-1]
        both = {k: np.concatenate([gx[k], px[k]]) for k in gx}
        precision, cover = _worth(rule, both, np.concatenate([gb, pb]))
        if not rule or precision < min_precision or cover < min_cover:
            break
        rules.append(rule)
        gone, pgone = covered(rule, gx, len(gb)), covered(rule, px, len(pb))
        gx, gb = {k: v[~gone] for k, v in gx.items()}, gb[~gone]
        px, pb = {k: v[~pgone] for k, v in px.items()}, pb[~pgone]
    return rules


def verdict(rules: list[Rule], x: dict[str, Column]) -> Column:
    """The decision list as an ordered conditional: the first rule that holds
    rejects; a text that none holds for is kept."""
    out = None
    for rule in rules:
        test = F.lit(True)
        for c in rule:
            test = test & c.column(x)
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def train(docs: DataFrame, labels: DataFrame, target: str = "quality",
          limit: int = TRAIN_LIMIT) -> list[Rule]:
    """Rules from at most ``limit`` labelled documents; only their few
    statistics reach the driver."""
    sample = labelled_docs(docs, labels, target, limit).select("doc_id", "label", text_stats("text").alias("s"))
    rows = sample.select("doc_id", "label", *(c.alias(k) for k, c in ratios(F.col("s")).items())).toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    if rows.empty:
        return []
    x = {k: rows[k].to_numpy(float) for k in rows.columns if k not in ("doc_id", "label")}
    return learn(x, rows["label"].to_numpy() == 0)


def judge(docs: DataFrame, rules: list[Rule], out: str = "quality_stats") -> DataFrame:
    """``docs`` with a struct column: the statistics, base_failed and kept."""
    raw = fresh("_stats", docs.columns)
    s = F.col(raw)
    base = (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > 50 * s["n_words"])
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    result = F.struct(*(s[n].alias(n) for n in names), base.alias("base_failed"),
                      (~base & verdict(rules, ratios(s))).alias("kept"))
    return docs.withColumn(raw, text_stats("text")).withColumn(out, result).drop(raw)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = train(docs, table(spark, sf_dir, "labels"))
    return judge(docs.select("doc_id", "text"), rules).select("doc_id", "quality_stats.*")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the rules keep, with their columns."""
    rules = train(docs, table(spark, sf_dir, "labels"))
    out = fresh("_quality", docs.columns)
    return judge(docs, rules, out).filter(F.col(out)["kept"]).drop(out)
