"""Spelling variants: words one edit apart, grouped under their commonest forms.

A word's near words differ from it by exactly one inserted, deleted or replaced
letter.  They are found by dynamic programming over sorted lists: the words of a
list are scanned in order, the edit matrix is kept in a band of three cells a row
(one edit leaves no other), a word reuses the rows of the prefix that it shares
with the word before it, and as soon as no query is within one edit of a prefix,
all words of the list with that prefix are skipped.  A row holds the band of every
query that is still open, so queries share the scan.

The lists: one edit lies in the left or in the right half of a word, so near words
agree in the other half.  With r the length of the shorter word, every word of
length r or r + 1 joins the list of its first r // 2 letters and that of its last
r - r // 2; only what is left of the words is compared.  A list of more than
``group`` words is parted again by the halves of what is left; when one or two
letters are left, the alphabet bounds it.  Pairs that agree in both halves are
counted in the left one only.  A task holds one list, and emits a row a word of it
(number of near words, best of them), never the pairs.

Words: runs of [A-Za-z\\u00C0-\\u00FF], of which only A-Z are lowered.  Defined
results: a null or empty text has no words; an empty table no rows; repeated rows
count again; documents without doc_id count as having an empty one in ``slips``;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

MIN_LENGTH, MIN_COUNT = 5, 3
#: Words of a list in one task.
GROUP = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "a-zÀ-ÿ"


def slips(doc_id: Column, run: Column) -> Column:
    """The run, or, if 97 divides h, the unsigned crc32 of ``doc_id:run``, the run
    without its code point h % length: spelling slips put in by a rule."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % 97 == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def vocabulary(docs: DataFrame, slipped: bool = False, min_length: int = MIN_LENGTH,
               min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the words of at least ``min_length`` letters and ``min_count``
    occurrences; ``slipped``: after ``slips``."""
    runs = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))
    words = docs.select("doc_id", F.explode(runs).alias("word"))
    if slipped:
        words = words.select(slips(F.col("doc_id"), F.col("word")).alias("word"))
    return (words.filter(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n"))
            .filter(F.col("n") >= min_count))


def _parted(lists: DataFrame) -> DataFrame:
    """Members (key, r, rest, avoid, word, n) of a list in the lists of the left and
    the right half of their rests.  avoid: left halves in which pairs must differ."""
    half, size, rest = F.floor(F.col("r") / 2).cast("int"), F.length("rest"), F.col("rest")
    tail = size - F.col("r") + half                       # of the rest, what is not in the right half
    left = F.struct(F.concat("key", F.lit("<"), F.substr(rest, F.lit(1), half)).alias("key"),
                    (F.col("r") - half).alias("r"), F.substr(rest, half + 1).alias("rest"), F.col("avoid"))
    right = F.struct(F.concat("key", F.lit(">"), F.substr(rest, tail + 1)).alias("key"), half.alias("r"),
                     F.substr(rest, F.lit(1), tail).alias("rest"),
                     F.array_append("avoid", F.substr(rest, F.lit(1), half)).alias("avoid"))
    return lists.select("word", "n", F.inline(F.array(left, right))).select("key", "r", "rest", "avoid", "word", "n")


def lists(words: DataFrame, group: int = GROUP) -> DataFrame:
    """The members of all lists; those of more than ``group`` words parted again."""
    size = F.length("word")
    open_ = _parted(words.select(F.explode(F.array(size, size - 1)).alias("r"), "word", "n")
                    .select(F.col("r").cast("string").alias("key"), "r", F.col("word").alias("rest"),
                            F.array().cast("array<string>").alias("avoid"), "word", "n"))
    done = None
    while True:
        open_ = stored(open_, "spelling-lists")
        large = stored(open_.filter("r > 1").groupBy("key").count().filter(F.col("count") > group).select("key"),
                       "spelling-large")
        if large.isEmpty():
            return open_ if done is None else done.unionByName(open_)
        small = open_.join(large, "key", "left_anti")
        done = small if done is None else done.unionByName(small)
        open_ = _parted(open_.join(large, "key", "left_semi"))


def scan(words: list[bytes], queries: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(i, numbers of the queries at edit distance 1 of words[i]).  ``words`` are
    distinct and ascending, ``queries`` numbers of some of them."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    width = int(size.max()) + 2
    letters = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
    shared = np.concatenate([[0], (letters[1:] != letters[:-1]).argmax(axis=1)])
    asked, asked_size = np.ascontiguousarray(letters[queries].T), size[queries]
    none, zero, one = (np.full(len(queries), v, np.uint8) for v in (2, 0, 1))
    rows = [(np.arange(len(queries)), none, zero, one)]     # by depth: open queries, cells d-1, d, d+1
    rows += [None] * width
    top, dead = 0, width + 1
    for i, word in enumerate(words):
        if shared[i] >= dead:
            continue                                        # its prefix is beyond one edit of all queries
        dead, top = width + 1, min(top, int(shared[i]))
        while top < len(word):
            live, a, b, c = rows[top]
            letter = word[top]
            low = np.minimum(b + 1, a + (asked[max(top - 1, 0)][live] != letter))
            mid = np.minimum(np.minimum(c, low) + 1, b + (asked[top][live] != letter))
            high = np.minimum(mid + 1, c + (asked[top + 1][live] != letter))
            near = np.minimum(np.minimum(low, mid), high) <= 1
            if not near.any():
                dead = top + 1
                break
            top += 1
            rows[top] = (live[near], low[near], mid[near], high[near])
        else:
            live, *cells = rows[top]
            off = asked_size[live] - top + 1
            for k, cell in enumerate(cells):
                live_k = live[(off == k) & (cell == 1)]
                if len(live_k):
                    yield i, live_k


def near_in_list(r: int, rests: list[str], avoid: list[list[str]], words: list[str], n: list[int]) -> list[tuple]:
    """(word, n_near, best_n, best) of the members of one list, sorted by rest,
    that have near words in it: pairs of rests of r letters, and of r and r + 1."""
    if len(rests) < 2:
        return []
    coded = [x.encode("latin-1") for x in rests]
    short = np.fromiter((len(x) == r for x in coded), bool, len(coded))
    queries = np.flatnonzero(short)
    if not len(queries):
        return []
    order = np.empty(len(words), np.int64)
    order[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    count = np.array(n, np.int64)
    place = np.lexsort((order, -count))                     # the best first
    rank = np.empty_like(place)
    rank[place] = np.arange(len(place))
    near, best = np.zeros(len(words), np.int64), np.full(len(words), len(words))
    apart = [np.unique(column, return_inverse=True)[1] for column in zip(*avoid, strict=True)]
    for i, found in scan(coded, queries):
        found = queries[found]
        for a in apart:
            found = found[a[found] != a[i]]
        near[found] += 1
        best[found] = np.minimum(best[found], rank[i])
        if not short[i] and len(found):
            near[i] += len(found)
            best[i] = min(best[i], rank[found].min())
    return [(words[k], int(near[k]), n[place[best[k]]], words[place[best[k]]]) for k in np.flatnonzero(near).tolist()]


NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def near_words(words: DataFrame, group: int = GROUP) -> DataFrame:
    """(word, n_near, best_n, best) of the words (word, n) that have near words:
    their number, and the one of largest n, ties to the smallest in code points."""
    columns = ["key", "r", "rest", "avoid", "word", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, r, members, out = None, 0, [], []
        for batch in batches:
            for k, r_k, *member in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if k != key:
                    out += near_in_list(r, *zip(*members, strict=True)) if members else []
                    key, r, members = k, r_k, []
                members.append(member)
            if out:
                yield _batch(out)
                out = []
        out = near_in_list(r, *zip(*members, strict=True)) if members else []
        if out:
            yield _batch(out)

    found = (lists(words, group).repartition("key").sortWithinPartitions("key", "rest").select(*columns)
             .mapInArrow(run, "word string, n_near long, best_n long, best string"))
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best")))
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
            .select("word", "n_near", (-F.col("b")["less"]).alias("best_n"), F.col("b")["best"].alias("best")))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), NEAR.types, strict=True)],
                                      schema=NEAR)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of a forest (word, form): every round, a word takes the place
    where its place leads, so paths halve."""
    up = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = stored(up.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                        F.col("next").isNotNull().alias("moved")), "spelling-roots")
        up = new.select("word", "root")
        if new.filter("moved").isEmpty():
            return up


def variants(words: DataFrame, group: int = GROUP) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a vocabulary (word, n): a word's
    form is its best near word, if at least twice as frequent; its root is where
    the forms lead."""
    words = stored(words, "spelling-words")
    known = stored(words.join(near_words(words, group), "word", "left")
                   .withColumn("form", F.when(F.col("best_n") >= 2 * F.col("n"), F.col("best")))
                   .select("word", "form", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                           F.when(F.col("form").isNotNull(), F.col("best_n")).alias("form_n")), "spelling-near")
    return (known.join(roots(known.filter("form IS NOT NULL").select("word", "form")), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(vocabulary(table(spark, sf_dir, "documents"), slipped=True))
