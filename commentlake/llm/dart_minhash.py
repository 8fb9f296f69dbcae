"""Near-duplicate documents by DartMinHash signatures, banding and exact checks.

Every weighted element owns the region [0, weight) x [0, infinity) of a weight
and a rank axis.  Both axes are parted into fixed cells; a hash of (element,
cell) says how many darts fall into a cell (Poisson with its area as mean) and
where.  A dart inside the element's weight counts for one of k coordinates,
which keeps its dart of lowest rank.  As cells do not depend on the set, two
sets agree in a coordinate with a probability of their weighted Jaccard
similarity.  Ranks are visited cell by cell until no coordinate is empty, about
k ln k darts whatever the size of the set.

Words are runs of anything but space and \\t to \\r; shingles are five words (a
shorter text is one shingle).  Defined results: a null, empty or blank text has
no shingle and is a class of its own; so is a row without doc_id (its class is
null); rows of one doc_id are one document; texts of equal words are copies; an empty
table has no classes; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, mix64, stored, table
from .graph import connected_components

SHINGLE = 5
THRESHOLD = 0.8
#: 32 bands of 5 coordinates miss a pair of similarity 0.8 with probability 3e-6.
BANDS, ROWS = 32, 5
#: Largest mean of a cell's dart count.
CELL = 64.0
#: Bits of a document's map of shingles, least and most.
MAP_BITS = 512, 8192

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_word_hash = Memo(xxhash.xxh3_64_intdigest, 16 << 20)


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)) * 2.0 ** -53


def _salted(x: np.ndarray, salt: int) -> np.ndarray:
    return mix64(x + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))


@cache
def _poisson(mean: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, 2, ... darts."""
    p, out = np.exp(-mean), []
    while not out or (out[-1] < 1 - 1e-16 and len(out) < mean + 40 + 12 * mean ** 0.5):
        out.append((out[-1] if out else 0.0) + p)
        p *= mean / len(out)
    return np.array(out)


@cache
def _rank_band(s: int) -> tuple[float, float]:
    """[0, 1/32), then bands that double up to a width of CELL and stay there."""
    if s == 0:
        return 0.0, 1 / 32
    lo = 2.0 ** (s - 6)
    if lo < CELL:
        return lo, 2 * lo
    return CELL * (s - 11), CELL * (s - 10)


def _weight_band(j: int) -> tuple[float, float]:
    return (0.0, 1.0) if j == 0 else (2.0 ** (j - 1), 2.0 ** j)


@cache
def _cells(bands: range, j: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """The cells of rank bands and one weight band: salts, dart count
    distributions, and where their ranks begin and how wide they are."""
    wlo, whi = _weight_band(j)
    salts, cdfs, begin, width = [], [], [], []
    for s in bands:
        rlo, rhi = _rank_band(s)
        parts = max(1, math.ceil((whi - wlo) * (rhi - rlo) / CELL))
        step = (rhi - rlo) / parts
        for q in range(parts):
            salts.append(((s << 40) + (j << 32) + q + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            cdfs.append(_poisson((whi - wlo) * step))
            begin.append(rlo + step * q)
            width.append(step)
    return np.array(salts, np.uint64), cdfs, np.array(begin), np.array(width)


def _darts(h: np.ndarray, w: np.ndarray | None, j: int, bands: range) -> tuple[np.ndarray, np.ndarray]:
    """(id, rank) of the darts of the elements in some rank bands of weight band j."""
    wlo, whi = _weight_band(j)
    if w is not None and j:
        h, w = h[w > wlo], w[w > wlo]
    salts, cdfs, begin, width = _cells(bands, j)
    x = mix64(h + salts[:, None])
    u = _unit(x)
    cell, element = np.nonzero(u >= np.array([c[0] for c in cdfs])[:, None])
    u, x = u[cell, element], x[cell, element]
    ends = np.searchsorted(cell, np.arange(len(cdfs) + 1))
    n = np.concatenate([np.searchsorted(c, u[a:b], side="right") for c, a, b in zip(cdfs, ends, ends[1:], strict=False)])
    many = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(many)) - np.repeat(np.cumsum(n) - n, n)
    d = mix64(x[many] + (nth.astype(np.uint64) + np.uint64(1)) * _GOLD)
    if w is not None:
        inside = wlo + (whi - wlo) * _unit(_salted(d, 1)) < w[element[many]]
        d, many = d[inside], many[inside]
    return d, begin[cell[many]] + width[cell[many]] * _unit(_salted(d, 2))


def dart_signature(h: np.ndarray, w: np.ndarray | None, k: int) -> np.ndarray:
    """k dart ids for the distinct element hashes ``h`` with weights ``w`` (None:
    1 each).  Elements without a positive finite weight do not count; h must
    not be empty of others."""
    if w is not None:
        ok = np.isfinite(w) & (w > 0)
        h, w = h[ok], w[ok]
    if not len(h):
        raise ValueError("an empty set has no signature")
    sig, empty = np.zeros(k, np.uint64), np.ones(k, bool)
    weight = len(h) if w is None else w.sum()
    top = 1 if w is None else max(1, math.ceil(math.log2(w.max())) + 1)
    s, to = 0, 0
    while _rank_band(to)[1] * weight < 0.75 * k * math.log(k + 1):     # the first bands at once
        to += 1
    while empty.any():
        parts = [_darts(h, w, j, range(s, to + 1)) for j in range(top)]
        d, r = (np.concatenate(x) for x in zip(*parts, strict=True))
        d = d[np.argsort(-r, kind="stable")]
        found, seen = np.zeros(k, np.uint64), np.zeros(k, bool)
        at = (_salted(d, 3) % np.uint64(k)).astype(np.int64)
        found[at], seen[at] = d, True          # the last write, of lowest rank, stays
        new = empty & seen
        sig[new] = found[new]
        empty &= ~seen
        s = to = to + 1
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of ``rows`` coordinates, its number included."""
    key = _salted(np.arange(1, bands + 1, dtype=np.uint64), 7)
    for column in sig.reshape(bands, rows).T:
        key = mix64(key * _GOLD + column)
    return key.view(np.int64)


def shingles(words: list[bytes], size: int, counted: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Distinct shingle hashes of a text, with their counts if ``counted``."""
    ids = np.fromiter(map(_word_hash.__getitem__, words), np.uint64, len(words))
    span = min(size, len(ids))
    h = _salted(ids[:len(ids) - span + 1], span)
    for k in range(1, span):
        h = mix64(h * _GOLD + ids[k:len(ids) - span + 1 + k])
    if counted:
        h, n = np.unique(h, return_counts=True)
        return h, n.astype(float)
    return np.unique(h), None


def sketch(sig: np.ndarray) -> np.ndarray:
    """Four bits of each coordinate, sixteen coordinates to a 64-bit number."""
    part = np.zeros(-(-len(sig) // 16) * 16, np.uint64)
    part[:len(sig)] = sig & np.uint64(15)
    return (part.reshape(-1, 16) << np.arange(0, 64, 4, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64)


def _words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


SIGNED = T.StructType([T.StructField("copy", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())),
                       T.StructField("sketch", T.ArrayType(T.LongType()))])


def signatures(docs: DataFrame, size: int, bands: int, rows: int, counted: bool) -> DataFrame:
    """(doc_id, copy, bands, sketch): a 128-bit digest of the words, the band
    keys and the sketch of the signature; null for a text without words."""
    @F.pandas_udf(SIGNED)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            out = []
            for words in map(_words, batch):
                if words:
                    sig = dart_signature(*shingles(words, size, counted), bands * rows)
                    out.append((hashlib.blake2b(b" ".join(words), digest_size=16).digest(),
                                band_keys(sig, bands, rows), sketch(sig)))
                else:
                    out.append((None, None, None))
            yield pd.DataFrame(out, columns=SIGNED.fieldNames())
        _word_hash.drop()

    return docs.select("doc_id", run("text").alias("s")).select("doc_id", "s.*")


def shingle_arrays(docs: DataFrame, size: int, counted: bool) -> DataFrame:
    """(doc_id, sh): distinct shingle hashes; a shingle found n times has n
    elements if ``counted``, so that set similarity is the weighted one."""
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            out = []
            for words in map(_words, batch):
                h, n = shingles(words, size, counted)
                if n is not None:
                    n = n.astype(np.int64)
                    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    h = mix64(np.repeat(h, n) + nth.astype(np.uint64) * _GOLD)
                out.append(h.view(np.int64))
            yield pd.Series(out, dtype=object)
        _word_hash.drop()

    return docs.select("doc_id", run("text").alias("sh"))


def _similar(pairs: DataFrame, sh: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose exact similarity is at least ``threshold``."""
    both = (pairs.join(sh.select(F.col("doc_id").alias("a"), F.col("sh").alias("x")), "a")
            .join(sh.select(F.col("doc_id").alias("b"), F.col("sh").alias("y")), "b"))
    common = F.size(F.array_intersect("x", "y"))
    return (both.withColumn("n", common)
            .filter(F.col("n") / (F.size("x") + F.size("y") - F.col("n")) >= threshold).select("a", "b"))


def _agreement(x: str, y: str, k: int) -> Column:
    """Of k coordinates, how many have the same four bits."""
    ones = F.lit(0x1111111111111111)
    total = F.lit(0)
    for i in range(-(-k // 16)):
        d = F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseAND(ones)
        total = total + F.bit_count(d)
    return F.lit(-(-k // 16) * 16) - total - F.lit(-k % 16)


def bit_maps(sh: DataFrame) -> DataFrame:
    """(id, map): of each document a bit map with a bit set for each shingle's hash, of
    eight bits a shingle, in 64-bit numbers; null if rows of one doc_id differ."""
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def run(arrays: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in arrays:
            out = []
            for a in batch:
                bits = np.zeros(min(MAP_BITS[1], max(MAP_BITS[0], 1 << (8 * len(a)).bit_length())), np.uint8)
                bits[a.view(np.uint64) % np.uint64(len(bits))] = 1
                out.append(np.packbits(bits, bitorder="little").view("<i8"))
            yield pd.Series(out, dtype=object)

    one = F.struct(F.size("sh").alias("n"), run("sh").alias("map"))
    return (sh.select(F.col("doc_id").alias("id"), one.alias("one")).groupBy("id")
            .agg(F.min("one").alias("low"), F.max("one").alias("high"))
            .select("id", F.when(F.col("low") == F.col("high"), F.col("low.map")).alias("map")))


def _differences(x: str, y: str) -> Column:
    """How many shingles are in one of two documents only, at least: the bits set in one
    of their maps only.  A map twice as wide as the other is folded; 0 if nothing is known."""
    n = F.least(F.size(x), F.size(y))
    fold = lambda b: F.when(F.size(b) == n, F.col(b)).otherwise(
        F.zip_with(F.slice(b, 1, n), F.slice(b, n + 1, n), lambda u, v: u.bitwiseOR(v)))
    apart = F.zip_with(fold(x), fold(y), lambda u, v: F.bit_count(u.bitwiseXOR(v)))
    return F.when(F.greatest(F.size(x), F.size(y)) <= 2 * n, F.aggregate(apart, F.lit(0), lambda u, v: u + v)).otherwise(0)


def _shared(sh: DataFrame) -> DataFrame:
    """(id, n, shared) of documents: the number of their shingles, and of those
    that another document of ``sh`` has too."""
    alone = (sh.select("doc_id", F.explode("sh").alias("s")).groupBy("s")
             .agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")).filter("n = 1")
             .groupBy("doc_id").agg(F.count("*").alias("alone")))
    return (sh.select("doc_id", F.size("sh").alias("n")).join(alone, "doc_id", "left")
            .select(F.col("doc_id").alias("id"), "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("shared")))


def _linkable(ids: DataFrame, sh: DataFrame, threshold: float) -> DataFrame:
    """(id, n, shared) of those of ``ids`` that may be linked at all: a document
    goes if too few of its shingles are shared.  As what it shared with others
    then counts no more, this is repeated while it removes a twentieth."""
    facts, n = stored(ids, "dart-open"), None
    while True:
        own = sh.join(facts.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
        facts = stored(_shared(own).filter(F.col("shared") >= F.col("n") * threshold - 1e-6), "dart-open")
        before, n = n, facts.count()
        if before is not None and n >= 0.95 * before:
            return facts


def near_duplicates(docs: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD,
                    bands: int = BANDS, rows: int = ROWS, weights: str = "set") -> DataFrame:
    """(doc_id, class_id) of every row of ``docs`` (doc_id, text): class_id is
    the smallest doc_id reachable by links of similarity >= threshold.  weights:
    "set" (each distinct shingle weighs 1) or "count" (its number of times).

    Copies meet in one representative before any band is looked at.  In each
    bucket all members are held against one representative; then, as long as a
    bucket has members of several components, those outside its largest one
    become representatives themselves (1, then 16, 256, ... a round) and are
    held against the members of other components.  So every pair of different
    texts that shares a bucket is in one component already, is checked exactly,
    or is passed over for one of three reasons: shingles that no other document
    has, or bits that only one of both bit maps of shingles has, already bound its
    similarity below the threshold (two proofs), or its signatures agree in five
    standard deviations fewer coordinates than a pair at the threshold would
    (probability below 1e-6).  Up to about 1,000 shingles the maps drop nearly all pairs
    below 0.78; those nearer to 0.8 and those of longer texts are checked one by one.
    """
    counted, k = weights == "count", bands * rows
    docs = docs.select("doc_id", "text")
    sig = stored(signatures(docs, size, bands, rows, counted), "dart-signatures")
    real = sig.filter(F.col("copy").isNotNull() & F.col("doc_id").isNotNull())
    reps = stored(real.groupBy("copy").agg(F.min("doc_id").alias("rep")), "dart-copies")
    real = real.join(reps.select(F.col("rep").alias("doc_id"), F.col("copy")), ["doc_id", "copy"])
    members = real.select(F.col("doc_id").alias("id"), F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high")
    cand = stored(members.join(shared.select("key", "low"), "key"), "dart-buckets")
    sh = stored(shingle_arrays(docs.join(cand.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi"),
                               size, counted), "dart-shingles")

    pairs = stored(cand.filter("low < id").select(F.col("low").alias("a"), F.col("id").alias("b")).distinct(),
                   "dart-pairs")
    checked, done, step = [pairs], [], 1
    links = [stored(_similar(pairs, sh, threshold), "dart-links")]
    union = lambda parts: parts[0] if len(parts) == 1 else union(parts[:-1]).unionAll(parts[-1])
    p = threshold + (1 - threshold) / 16
    agree = math.floor(k * p - 5 * math.sqrt(k * p * (1 - p)))
    most = F.least("sx", "sy")                      # shingles that x and y can have in common
    possible = ((most * (1 + threshold) >= (F.col("nx") + F.col("ny")) * threshold - 1e-6)
                & (_agreement("kx", "ky", k) >= agree)
                & (F.coalesce(_differences("bx", "by"), F.lit(0)) * (1 + threshold)
                   <= (F.col("nx") + F.col("ny")) * (1 - threshold) + 1e-6))
    facts = None
    while True:
        comps = stored(connected_components(union(links)), "dart-components")
        known = (cand.select("key", "id").join(comps, "id", "left")
                 .select("key", "id", F.coalesce("comp", "id").alias("comp")))
        if facts is not None:
            known = known.join(facts.select("id"), "id", "left_semi")
        main = (known.groupBy("key", "comp").count().groupBy("key")
                .agg(F.max_by("comp", F.struct("count", "comp")).alias("main"), F.count("*").alias("n"))
                .filter("n > 1"))
        cand = stored(known.join(main.select("key", "main"), "key"), "dart-buckets")
        if facts is None:
            facts = _linkable(cand.select("id").distinct(), sh, threshold)
            sketches = real.select(F.col("doc_id").alias("id"), "sketch").dropDuplicates(["id"])
            maps = bit_maps(sh.join(facts.select(F.col("id").alias("doc_id")), "doc_id", "left_semi"))
            facts = stored(facts.join(sketches, "id").join(maps, "id"), "dart-facts")
            cand = cand.join(facts.select("id"), "id", "left_semi")
        left = cand.filter("comp != main")
        if done:
            left = left.join(union(done), ["key", "id"], "left_anti")
        turn = (left.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("id")))
                .filter(F.col("nth") <= step).select("key", "id", "comp"))
        turn = stored(turn, "dart-representatives")
        if turn.isEmpty():
            break
        done.append(turn.select("key", "id"))
        side = lambda df, v: (df.join(facts, "id").select("key", F.col("id").alias(v), F.col("comp").alias("c" + v),
                                                          F.col("n").alias("n" + v), F.col("shared").alias("s" + v),
                                                          F.col("sketch").alias("k" + v), F.col("map").alias("b" + v)))
        # only buckets with a representative of a component that a member is not in can give a pair
        mixed = turn.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
        near = cand.join(mixed, "key").filter("low != high OR comp != low").select("key", "id", "comp")
        new = (side(turn, "x").join(side(near, "y"), "key").filter(F.col("cx") != F.col("cy")).filter(possible)
               .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        pairs = stored(new.join(union(checked), ["a", "b"], "left_anti"), "dart-pairs")
        checked.append(pairs)
        links.append(stored(_similar(pairs, sh, threshold), "dart-links"))
        step *= 16
    classes = (reps.join(comps, reps["rep"] == comps["id"], "left")
               .select("copy", F.coalesce("comp", "rep").alias("class_id")))
    return (sig.select("doc_id", "copy").join(classes, "copy", "left")
            .select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id")))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.withColumn("kept", F.col("doc_id") == F.col("class_id"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the document of smallest doc_id of each class.  Rows
    without doc_id stay; of rows that share a doc_id one stays."""
    classes = near_duplicates(docs)
    gone = classes.filter("doc_id != class_id").select("doc_id").distinct()
    many = classes.filter("doc_id = class_id").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    left = docs.join(gone, "doc_id", "left_anti")
    again = left.join(many, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return left.join(many, "doc_id", "left_anti").unionByName(again)
