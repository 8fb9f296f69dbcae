"""Result synthesis.

G1-G6 work on search hits (query_id, rank, comment columns, tags): every
group they build is bounded by the limit of its query, which a report may cut
further, so collecting a group's members into one row is bounded.

G7 mines near-duplicate comment clusters over the whole corpus: exact copies
collapse first (grouped aggregate), an exact set-similarity join by blocks of parity
maps (``operators.alike``) finds the links that components need, and clusters are
connected components by contraction over written tables.  The join by prefix, length
and positional filters serves sets of rare words (H1).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..plans.sizing import checked_broadcast
from ..session import dropped, stored
from .alike import similar_by_blocks

# --- fixed values that must equal the reference's ---------------------------
DUP_THRESHOLD = 0.7            # Jaccard at or above which a body is a duplicate
EMPTY_TEXT = "No conventions found."
GENERAL = "General"            # header for hits whose path has no directory
FOUND, ACROSS, PLACES = "Found ", " relevant review comments across ", " locations.\n"      # report header
GROUP_HEAD, GROUP_TAIL, TAGS_LABEL = "--- ", " ---\n", "  tags: "
COMMENT_LABEL, BY, ON = "Comment #", " by ", " on "                                        # summariser's input
FILE_LABEL, REVIEW_LABEL, HUNK_LABEL = "  File: ", "  Review: ", "  Code context: "
# -----------------------------------------------------------------------------


def cap(hits: DataFrame, n: int | None = None) -> DataFrame:
    """G1: the first ``n`` hits of each query by rank (``pos`` 1..n), or all."""
    w = Window.partitionBy("query_id").orderBy("rank")
    out = hits.withColumn("pos", F.row_number().over(w))
    return out if n is None else out.where(F.col("pos") <= n)


def _member():
    return F.struct("pos", "rank", "id", "user_login", "created_at", "path", "line", "body",
                    "diff_hunk", "tags", tx.word_set("body").alias("words"))


def group_by_dir(capped: DataFrame) -> DataFrame:
    """(query_id, dir, members sorted by rank).  dir = dirname of the
    path; null/empty path -> 'general' (Q15: a file without directory gives
    '' which prints as 'General' — two different groups)."""
    return (capped.withColumn("dir", tx.group_key("path"))
            .groupBy("query_id", "dir")
            .agg(F.array_sort(F.collect_list(_member())).alias("members")))


def greedy_dedup(groups: DataFrame, threshold: float = DUP_THRESHOLD) -> DataFrame:
    """Inside each group, in rank order, drop a member whose word set
    has Jaccard >= threshold with any member kept before it; empty word sets
    are never compared (so never dropped)."""
    def step(kept, m):
        dup = F.exists(kept, lambda k: F.coalesce(tx.jaccard(k["words"], m["words"]) >= threshold,
                                                  F.lit(False)))
        return F.when(dup, kept).otherwise(F.array_append(kept, m))
    empty = F.filter(F.col("members"), lambda m: F.lit(False))
    return groups.withColumn("members", F.aggregate("members", empty, step))


def _member_lines(m):
    loc = F.when(tx.nonempty(m["path"]), F.concat(F.lit("  "), tx.location(m["path"], m["line"]))) \
        .otherwise(F.lit(""))
    head = F.concat(F.lit("  ["), m["user_login"], F.lit(" "), tx.day(m["created_at"]), F.lit("]"), loc)
    summary = F.concat(F.lit("  "), tx.summarize_body(m["body"]))
    tag_line = F.when(F.size(m["tags"]) > 0,
                      F.array(F.concat(F.lit(TAGS_LABEL), F.array_join(m["tags"], ", "))))\
        .otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(head, summary), tag_line, F.array(F.lit("")))


def render_report(hits: DataFrame, queries: DataFrame | None = None, n: int | None = None) -> DataFrame:
    """G4 (+G6): one text report per query.  Header counts all hits (Q16)
    and the groups formed from the first ``n`` (None: all); groups in key order, members
    deduplicated (G3).  With ``queries`` every query gets a row and queries
    without hits get the empty-result text."""
    counts = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_hits"))
    g = greedy_dedup(group_by_dir(cap(hits, n)))
    g = g.select("query_id", "dir", F.concat(
        F.array(F.concat(F.lit(GROUP_HEAD), F.coalesce(F.nullif(F.col("dir"), F.lit("")), F.lit(GENERAL)),
                         F.lit(GROUP_TAIL))),
        F.flatten(F.transform("members", _member_lines))).alias("lines"))
    per_q = (g.groupBy("query_id")
             .agg(F.count(F.lit(1)).alias("n_groups"),
                  F.array_sort(F.collect_list(F.struct("dir", "lines"))).alias("gs"))
             .join(counts, "query_id"))
    text = F.array_join(F.concat(
        F.array(F.concat(F.lit(FOUND), F.col("n_hits").cast("string"),
                         F.lit(ACROSS), F.col("n_groups").cast("string"),
                         F.lit(PLACES))),
        F.flatten(F.transform("gs", lambda x: x["lines"]))), "\n")
    out = per_q.select("query_id", F.col("n_hits"), text.alias("report"))
    if queries is not None:
        out = (queries.select("query_id").join(out, "query_id", "left")
               .select("query_id", F.coalesce("n_hits", F.lit(0)).alias("n_hits"),
                       F.coalesce("report", F.lit(EMPTY_TEXT)).alias("report")))
    return out


def prompt_context(hits: DataFrame, n: int | None = None, hunk_lines: int | None = None) -> DataFrame:
    """The numbered context block handed to an external summariser
    (text only, no model call): per hit 'Comment #i by u on d:', file, full
    review text and the hunk (whole, or clipped to ``hunk_lines`` by B6)."""
    c = cap(hits, n)

    def hunk(h):
        return h if hunk_lines is None else tx.truncate_hunk(h, hunk_lines)

    def block(m):
        return F.concat(
            F.array(F.concat(F.lit(COMMENT_LABEL), m["pos"].cast("string"), F.lit(BY), m["user_login"],
                             F.lit(ON), tx.day(m["created_at"]), F.lit(":"))),
            F.when(tx.nonempty(m["path"]), F.array(F.concat(F.lit(FILE_LABEL), m["path"])))
             .otherwise(F.array().cast("array<string>")),
            F.array(F.concat(F.lit(REVIEW_LABEL), m["body"])),
            F.when(tx.nonempty(m["diff_hunk"]),
                   F.array(F.concat(F.lit(HUNK_LABEL), hunk(m["diff_hunk"]))))
             .otherwise(F.array().cast("array<string>")),
            F.array(F.lit("")))
    g = c.groupBy("query_id").agg(F.array_sort(F.collect_list(
        F.struct("pos", "user_login", "created_at", "path", "body", "diff_hunk"))).alias("ms"))
    return g.select("query_id", F.array_join(F.flatten(F.transform("ms", block)), "\n").alias("context"))


def empty_results(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, n_hits, message) — the empty-result message for
    queries without hits, null otherwise."""
    n = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_hits"))
    j = queries.select("query_id").join(n, "query_id", "left")
    return j.select("query_id", F.coalesce("n_hits", F.lit(0)).alias("n_hits"),
                    F.when(F.col("n_hits").isNull(), F.lit(EMPTY_TEXT)).alias("message"))


# ---- G7 ------------------------------------------------------------------------
#: Words that are ordered by their frequency, at most; the others are rarer than these.
FREQUENT = 100_000
#: 64-bit numbers of a set's bit map: a quarter of a kilobyte, whatever the set.
BITMAP_LONGS = 32


def bit_maps(sets: DataFrame) -> DataFrame:
    """(id, n, m) of sets (id, words: distinct hashes, n): BITMAP_LONGS numbers in which the
    bit of each word's hash is set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("words")
            sizes = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            bits = np.zeros((len(words), 64 * BITMAP_LONGS), bool)
            bits[np.repeat(np.arange(len(words)), sizes), words.flatten().to_numpy() & (64 * BITMAP_LONGS - 1)] = True
            longs = np.packbits(bits, axis=1).view(np.int64).ravel()
            offsets = pa.array(np.arange(len(words) + 1, dtype=np.int32) * BITMAP_LONGS)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n"), pa.ListArray.from_arrays(offsets, pa.array(longs))],
                                             ["id", "n", "m"])

    return sets.select("id", "n", "words").mapInArrow(run, "id long, n int, m array<long>")


def _maps_may_reach(threshold: float) -> Column:
    """Bit map filter for sets of n1 and n2 words with maps m1 and m2: every differing bit
    is owed to a word of one set alone, so they share (n1 + n2 - differing) / 2 words at most."""
    differing = sum((F.bit_count(F.col("m1")[i].bitwiseXOR(F.col("m2")[i])) for i in range(BITMAP_LONGS)), F.lit(0))
    return F.floor((F.col("n1") + F.col("n2") - differing) / 2) >= _needed(F.col("n1") + F.col("n2"), threshold)


def _needed(n: Column, threshold: float) -> Column:
    """Words that two sets of together n words have in common at least, if their
    Jaccard similarity reaches the threshold."""
    return F.ceil(n * (threshold / (1 + threshold)) - 1e-9)


def rare_first(sets: DataFrame, threshold: float) -> DataFrame:
    """(id, n, h, pos): of each set (id, words: distinct hashes, n) the words of its
    prefix, n - ceil(threshold * n) + 1 of them, rarest first.  Sets that reach the
    threshold share a word of their prefixes.  Any order of all words would do; this
    one puts the FREQUENT most frequent behind all others."""
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    words = sets.select("id", "n", F.explode("words").alias("h"))
    frequent = words.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > max(1, total // FREQUENT))
    ordered = (words.join(F.broadcast(frequent), "h", "left")
               .groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "h"))).alias("w")))
    size = (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int")
    return ordered.select("id", "n", F.posexplode(F.slice(F.col("w")["h"], F.lit(1), size)).alias("pos", "h"))


def _may_reach(x: str, y: str, threshold: float) -> Column:
    """Length and positional filter for two prefix entries of one word (columns n and
    pos with these suffixes): both sets' words before it and behind it bound what they
    can share."""
    c = lambda name, side: F.col(name + side)
    behind = F.least(c("n", x) - c("pos", x), c("n", y) - c("pos", y))
    before = F.least(c("pos", x), c("pos", y))
    return ((F.least(c("n", x), c("n", y)) >= F.greatest(c("n", x), c("n", y)) * (threshold - 1e-9))
            & (before + behind >= _needed(c("n", x) + c("n", y), threshold)))


def _joined(labels: DataFrame, links: DataFrame, keep) -> DataFrame:
    """``labels`` (id, label) after ``links`` (a, b) have joined their
    components; a label is the smallest id of its component.  Each round maps
    every label to the first of its closed neighbourhood, by id and by a fresh
    hash in turn, and contracts the links, so rounds are logarithmic."""
    def mapped(e, to, key, val):
        ta = to.select(F.col(key).alias("a"), F.col(val).alias("ta"))
        tb = to.select(F.col(key).alias("b"), F.col(val).alias("tb"))
        return (e.join(ta, "a").join(tb, "b").where("ta != tb")
                .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())

    e, turn = keep(mapped(links.select("a", "b"), labels, "id", "label")), 0
    while not e.isEmpty():
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

        def place(v, turn=turn):
            rank = F.col(v) if turn % 2 == 0 else F.xxhash64(F.col(v), F.lit(turn))
            return F.struct(rank.alias("rank"), F.col(v).alias("v"))
        near = both.groupBy("a").agg(F.min(place("b")).alias("n"))
        near = keep(near.select(F.col("a").alias("label"), F.least("n", place("a"))["v"].alias("to")))
        labels = keep(labels.join(near, "label", "left").select("id", F.coalesce("to", "label").alias("label")))
        e = keep(mapped(e, near, "label", "to"))
        turn += 1
    low = labels.groupBy("label").agg(F.min("id").alias("low"))
    return keep(labels.join(low, "label").select("id", F.col("low").alias("label")))


def similar_components(sets: DataFrame, threshold: float, keep) -> DataFrame:
    """(id, label) of every set (id, words: distinct hashes, n): label is the smallest
    id reachable by links of Jaccard similarity >= threshold.

    An exact set-similarity join, reduced to what components need.  Sets that share a
    prefix word meet in its bucket.  First all members are held against the bucket's
    smallest id.  Then, where a bucket still has several components, the members
    outside its largest one are held against all members of other components; length
    and positional filters and then bit maps drop pairs that cannot reach the threshold, and
    the rest is counted.  Pairs within a component are never formed, so groups of near copies cost
    about their size; a bucket of many texts that are alike but below the threshold
    costs the product of the two sides."""
    entries = keep(rare_first(sets, threshold))
    low = (entries.groupBy("h").agg(F.min(F.struct("id", "n", "pos")).alias("low"), F.max("id").alias("high"))
           .where("low.id < high").select("h", F.col("low.id").alias("ida"), F.col("low.n").alias("na"), F.col("low.pos").alias("posa")))
    entries = keep(entries.join(low, "h"))
    side = lambda df, s, *more: df.select("h", *(F.col(c).alias(c + s) for c in ("id", "n", "pos", *more)))

    maps = keep(bit_maps(sets))

    def checked(pairs: DataFrame) -> DataFrame:
        # the small bit maps first: few pairs are left that the words of both have to travel to
        m1, m2 = (maps.select(F.col("id").alias(v), F.col("n").alias(f"n{k}"), F.col("m").alias(f"m{k}")) for k, v in ((1, "a"), (2, "b")))
        pairs = keep(pairs.join(m1, "a").join(m2, "b").where(_maps_may_reach(threshold)).select("a", "b"))
        w1 = sets.select(F.col("id").alias("a"), F.col("words").alias("w1"))
        w2 = sets.select(F.col("id").alias("b"), F.col("words").alias("w2"))
        return keep(pairs.join(w1, "a").join(w2, "b").where(tx.jaccard("w1", "w2") >= threshold).select("a", "b"))

    stars = entries.select(*(F.col(c).alias(c + "b") for c in ("id", "n", "pos")), "ida", "na", "posa")
    stars = keep(stars.where("ida < idb").where(_may_reach("a", "b", threshold))
                 .select(F.col("ida").alias("a"), F.col("idb").alias("b")).distinct())
    label = _joined(keep(sets.select("id", F.col("id").alias("label"))), checked(stars), keep)
    known = entries.select("h", "id", "n", "pos").join(label, "id")
    main = (known.groupBy("h", "label").agg(F.count(F.lit(1)).alias("size")).groupBy("h")
            .agg(F.max_by("label", F.struct("size", "label")).alias("main"), F.count(F.lit(1)).alias("components"))
            .where("components > 1"))
    known = keep(known.join(main.select("h", "main"), "h"))
    x, y = side(known.where("label != main"), "x", "label", "main"), side(known, "y", "label")
    once = (F.col("labely") == F.col("mainx")) | (F.col("idx") < F.col("idy"))     # both outside: from one side only
    rest = (x.join(y, "h").where((F.col("labelx") != F.col("labely")) & once & _may_reach("x", "y", threshold))
            .select(F.least("idx", "idy").alias("a"), F.greatest("idx", "idy").alias("b")).distinct())
    return _joined(label, checked(keep(rest.join(stars, ["a", "b"], "left_anti"))), keep)


def mine_conventions(comments: DataFrame, comment_tags: DataFrame | None = None,
                     tags: DataFrame | None = None, threshold: float = DUP_THRESHOLD):
    """Near-duplicate clusters -> ``(conventions, sources)``.

    Semantics (ours; the reference only defines the table): two comments are
    linked when the Jaccard similarity of their word sets is >= threshold;
    exact word-set copies are always linked.  Clusters are the connected
    components with at least two comments — a transitive grouping, unlike the
    per-report greedy dedup of G3.

    conventions: id, title, body, category, file_patterns, source_count,
    confidence, created_at, updated_at; id is the smallest id of the cluster, and
    confidence the mean similarity of the other members to that comment.  sources:
    (convention_id, comment_id), the full membership (no row of a cluster is
    dropped or sampled).
    """
    keep = lambda df: stored(df, "conventions")
    # a text without words is blank; asked of the text, so that word sets are made once
    ws = comments.where(F.col("body").rlike(tx.NON_WS_J)).select("id", tx.word_set("body").alias("words"))
    # one representative per distinct word set; words as 64-bit hashes: a third of the bytes that are shuffled
    ws = ws.select("id", F.sort_array(F.transform("words", lambda w: F.xxhash64(w))).alias("words"))
    ws = keep(ws.select("id", F.struct(F.xxhash64("words"), F.xxhash64(F.lit(1), "words")).alias("wkey"), "words"))
    reps = ws.groupBy("wkey").agg(F.min("id").alias("rep"))
    exact = keep(ws.select("id", "wkey").join(reps, "wkey").select("id", "rep", "wkey"))   # every doc -> its exact rep
    copies = checked_broadcast(exact.where("id <> rep").select("id", "wkey"))
    uniq = keep(ws.where("id IS NOT NULL").join(copies, ["id", "wkey"], "left_anti").select("id", "words", F.size("words").alias("n")))
    dropped(ws)
    label = similar_by_blocks(uniq, threshold, keep, _joined)
    # every copy has the label of its representative; single comments are no cluster
    label = exact.join(label.select(F.col("id").alias("rep"), "label"), "rep").select("id", "rep", "label")
    several = label.groupBy("label").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("label")
    label = keep(label.join(several, "label").select("id", "rep", "label"))
    members = label.select(F.col("id").alias("comment_id"), F.col("label").alias("cid"))
    # each distinct text once against the cluster's first comment, weighed with its copies
    alike = label.groupBy("rep", F.col("label").alias("cid")).agg(F.count(F.lit(1)).alias("copies"))
    words = keep(uniq.join(checked_broadcast(keep(label.select(F.col("rep").alias("id")).distinct())), "id", "left_semi"))
    dropped(uniq)
    first = words.select(F.col("id").alias("cid"), F.col("words").alias("w1"))
    alike = (alike.join(words.select(F.col("id").alias("rep"), "words"), "rep")
             .join(first, "cid").select("cid", "copies", (tx.jaccard("w1", "words")).alias("sim")))
    sims = alike.groupBy("cid").agg((F.sum(F.col("sim") * F.col("copies")) - 1).alias("s"), F.sum("copies").alias("k")).select(
        "cid", F.round(F.col("s") / (F.col("k") - 1), 9).alias("confidence"))
    info = comments.select(F.col("id").alias("comment_id"), "body", "path", "updated_at", "created_at")
    m = info.join(checked_broadcast(members), "comment_id")
    m = m.withColumn("body", F.when(F.col("comment_id") == F.col("cid"), F.col("body")))      # that of the first only
    dirs = (m.withColumn("dir", tx.group_key("path")).groupBy("cid", "dir")
            .agg(F.count(F.lit(1)).alias("n")))
    all_dirs = (dirs.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), "dir")))
                                        .alias("d"))
                .select("cid", F.transform("d", lambda x: x["dir"]).alias("file_patterns")))
    base = m.groupBy("cid").agg(
        F.count(F.lit(1)).alias("source_count"),
        F.min(F.struct("comment_id", "body")).alias("rep"),
        F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"))
    conv = base.join(all_dirs, "cid", "left").join(sims, "cid", "left")
    if comment_tags is not None and tags is not None:
        tc = (members.join(comment_tags, "comment_id").groupBy("cid", "tag_id")
              .agg(F.count(F.lit(1)).alias("n")))
        best = tc.groupBy("cid").agg(F.min(F.struct((-F.col("n")).alias("neg"), "tag_id")).alias("t"))
        names = tags.select(F.col("id").alias("tag_id"), F.col("name").alias("category"))
        conv = conv.join(best.select("cid", F.col("t.tag_id").alias("tag_id")), "cid", "left") \
            .join(names, "tag_id", "left").drop("tag_id")
    else:
        conv = conv.withColumn("category", F.lit(None).cast("string"))
    conventions = conv.select(
        F.col("cid").alias("id"),
        tx.summarize_body(F.col("rep.body")).alias("title"), F.col("rep.body").alias("body"), "category",
        "file_patterns", "source_count", "confidence",
        "created_at", "updated_at")
    sources = members.select(F.col("cid").alias("convention_id"), "comment_id")
    return conventions, sources
