"""Review-finding consolidation: deterministic rules only.

findings: (file, line, issue, severity in P0 > P1 > P2).

Every step is skew-safe: H1 collapses equal texts of a hot (file, line) key
map-side before it compares different ones, which stay rows where a line has
many; H2 finds line islands on the
*distinct* (file, line) pairs in fixed-size line blocks (windows bounded by
the block size) and stitches blocks with one window over per-block summary
rows, so a file holding a third of all findings is never sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import scratch_path
from .report import similar_components

# --- fixed values that must equal the reference's ---------------------------
NEARBY_LINES = 2                 # lines within 2 of each other merge
SEVERITIES = ["P0", "P1", "P2"]  # P0 > P1 > P2
DUP_THRESHOLD = 0.7              # Jaccard at or above which two texts are one
# -----------------------------------------------------------------------------


def normalize_issue(issue) -> F.Column:
    """Lower case, whitespace runs collapsed, trimmed."""
    c = F.col(issue) if isinstance(issue, str) else issue
    return tx.py_strip(F.regexp_replace(F.lower(c), f"{tx.WS_J}+", " "))


def _best(*cols):
    """The member with the highest severity (smallest P-string), then the
    smallest line, then the smallest text: min over a struct."""
    return F.min(F.struct(*cols))


FOLD = 256             # texts of one line that are folded in one row


def _kept_table(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read back."""
    df.write.parquet(path := scratch_path(df.sparkSession, "findings"))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _greedy_rows(texts: DataFrame, threshold: float) -> DataFrame:
    """The greedy choice of H1 with a row per text (at, severity, issue, n,
    words, id).  Similar texts share a word of their prefixes (the rarest words
    of the line first; exact, no pair is missed), which makes the buckets.  A
    round looks at the first 1, 16, 256, at most 4096 undecided texts of each
    bucket: one that is among them in all its buckets, and is similar to no
    earlier undecided one, is kept, and the similar later ones join.  The first
    undecided text of a line is always kept, so the rounds end."""
    texts = _kept_table(texts.select("*", F.struct("severity", "issue").alias("ord"), F.size("words").alias("size")))
    word = (texts.select("id", "ord", "at", "size", F.explode("words").alias("w"))
            .withColumn("key", F.xxhash64("at.file", "at.line", "w")))
    often = word.groupBy("key").agg(F.count(F.lit(1)).alias("f"))
    prefix = F.col("size") - F.ceil(F.col("size") * threshold - 1e-9).cast("int") + 1
    buckets = (word.join(often, "key").groupBy("id", "ord", "size")
               .agg(F.array_sort(F.collect_list(F.struct("f", "key"))).alias("ws"))
               .select("id", "ord", F.explode(F.slice("ws", F.lit(1), prefix)["key"]).alias("key")))
    buckets = _kept_table(buckets.distinct())
    n_buckets = buckets.groupBy("id").agg(F.count(F.lit(1)).alias("all"))

    def alike(pairs):          # of pairs (a, b), those of one line and similar
        x = texts.select(F.col("id").alias("a"), F.col("at").alias("xat"), F.col("words").alias("x"))
        y = texts.select(F.col("id").alias("b"), F.col("at").alias("yat"), F.col("words").alias("y"))
        return _kept_table(pairs.distinct().join(x, "a").join(y, "b").where("xat <=> yat")
                           .where(tx.jaccard("x", "y") >= threshold).select("a", "b"))

    def pairs(earlier, later):
        x = earlier.select("key", F.col("id").alias("a"), F.col("ord").alias("oa"))
        y = later.select("key", F.col("id").alias("b"), F.col("ord").alias("ob"))
        return x.join(y, "key").where("oa < ob").select("a", "b")

    def every(parts):
        return parts[0] if len(parts) == 1 else every(parts[:-1]).unionByName(parts[-1])

    kept, joins, step = [texts.where("size = 0").select("id")], [], 1
    left = buckets                                      # of undecided texts
    while not left.isEmpty():
        w = Window.partitionBy("key").orderBy("ord")
        front = _kept_table(left.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= step).drop("nth"))
        ready = (front.groupBy("id").agg(F.count(F.lit(1)).alias("here")).join(n_buckets, "id")
                 .where(F.col("here") == F.col("all")).select("id"))
        ready = _kept_table(ready)
        blocked = alike(pairs(front, front.join(ready, "id", "left_semi")))
        new = _kept_table(ready.join(blocked.select(F.col("b").alias("id")), "id", "left_anti"))
        kept.append(new)
        others = buckets.join(every(kept), "id", "left_anti")
        joins.append(alike(pairs(front.join(new, "id", "left_semi"), others)))
        gone = new.unionByName(joins[-1].select(F.col("b").alias("id")))
        left = _kept_table(left.join(gone, "id", "left_anti"))
        step = min(step * 16, 4096)
    first = every(kept).select("id", F.col("id").alias("to"))
    if joins:
        order = texts.select(F.col("id").alias("a"), "ord")
        first = first.unionByName(every(joins).join(order, "a").groupBy("b").agg(F.min_by("a", "ord").alias("to"))
                                  .select(F.col("b").alias("id"), "to"))
    total = first.join(texts.select("id", "n"), "id").groupBy("to").agg(F.sum("n").alias("n_merged"))
    return (total.join(texts.select(F.col("id").alias("to"), "at", "issue", "severity"), "to")
            .select("at.file", "at.line", "issue", "severity", "n_merged"))


def dedup_findings(findings: DataFrame, threshold: float = DUP_THRESHOLD) -> DataFrame:
    """H1: findings of one file and line with similar issue texts are one, of
    the highest severity.  Texts equal after case/whitespace normalisation are
    one row first (partial aggregation); then, by severity and text, each text
    joins the first kept one whose word set has Jaccard >= threshold with its
    own, or is kept itself; texts without words join none.

    At most FOLD texts of a line are gathered and folded in one row.  Longer lines
    are parted first: a text can only join one that similar texts lead to, so each
    connected component of similarity links is folded by itself.  Only a component
    of more than FOLD texts takes rounds, with a row a text (``_greedy_rows``).
    Output: file, line, issue, severity, n_merged."""
    texts = (findings.groupBy("file", "line", normalize_issue("issue").alias("_norm"))
             .agg(_best("severity", "issue").alias("b"), F.count(F.lit(1)).alias("n")))
    texts = _kept_table(texts.select(
        F.struct("file", "line").alias("at"), "b.severity", "b.issue", "n", tx.word_set("_norm").alias("words"),
        F.monotonically_increasing_id().alias("id")))
    long = texts.groupBy("at").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FOLD).select("at")
    long = _kept_table(long)
    if long.isEmpty():
        return _folded(texts, threshold)
    few, many = texts.join(long, "at", "left_anti"), _kept_table(texts.join(long, "at", "left_semi"))
    own = F.transform("words", lambda w: F.xxhash64("at.file", "at.line", w))      # lines share no words
    sets = _kept_table(many.where(F.size("words") > 0).select("id", own.alias("words"), F.size("words").alias("n")))
    part = similar_components(sets, threshold, _kept_table)
    many = _kept_table(many.join(part, "id", "left").withColumn("part", F.coalesce("label", "id")).drop("label"))
    large = _kept_table(many.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FOLD).select("part"))
    out = _folded(few.withColumn("part", F.lit(None).cast("long")).unionByName(many.join(large, "part", "left_anti")), threshold)
    if large.isEmpty():
        return out
    return out.unionByName(_greedy_rows(many.join(large, "part", "left_semi").drop("part"), threshold))


def _folded(texts: DataFrame, threshold: float) -> DataFrame:
    """The greedy choice of H1 within the texts of a line (or of a ``part`` of one),
    gathered in one row."""
    keys = ["at", *(["part"] if "part" in texts.columns else [])]
    member = F.struct("severity", "issue", "n", "words")
    groups = texts.groupBy(*keys).agg(F.array_sort(F.collect_list(member)).alias("ms"))

    def step(kept, m):
        at = F.array_position(F.transform(kept, lambda k: F.coalesce(
            tx.jaccard(k["words"], m["words"]) >= threshold, F.lit(False))), True)
        joined = F.transform(kept, lambda k, i: F.struct(
            k["severity"].alias("severity"), k["issue"].alias("issue"),
            (k["n"] + F.when(i + 1 == at, m["n"]).otherwise(0)).alias("n"), k["words"].alias("words")))
        return F.when(at > 0, joined).otherwise(F.array_append(kept, m))
    none = F.filter("ms", lambda m: F.lit(False))
    kept = F.when(F.size("ms") == 1, F.col("ms")).otherwise(F.aggregate("ms", none, step))
    return groups.select("at", F.explode(kept).alias("k")).select(
        "at.file", "at.line", "k.issue", "k.severity", F.col("k.n").alias("n_merged"))


LINE_BLOCK = 4096      # lines per block: bounds every window below


def line_islands(findings: DataFrame, gap: int = NEARBY_LINES) -> DataFrame:
    """(file, line, start): ``start`` is the first line of the island of
    lines no more than ``gap`` apart that ``line`` belongs to.

    Two-level gaps-and-islands that never sorts a whole file in one task:
    1. distinct (file, line) pairs are cut into blocks of LINE_BLOCK line
       numbers; islands inside a block come from a window over (file, block)
       — at most LINE_BLOCK rows, however many findings a file holds;
    2. one summary row per (file, block) (first line, last line, start of its
       last island, single-island flag) is resolved across blocks with a
       window over the file's blocks — at most (line range / LINE_BLOCK)
       rows per file;
    3. lines of a block's first island take the resolved start of the
       block's first island.  No iteration, no driver round trip.
    """
    lines = findings.select("file", "line").distinct() \
        .withColumn("block", F.floor(F.col("line") / F.lit(LINE_BLOCK)))
    wb = Window.partitionBy("file", "block").orderBy("line")
    local = (lines.withColumn("brk", F.coalesce(
                (F.col("line") - F.lag("line").over(wb) > gap).cast("int"), F.lit(1)))
             .withColumn("isl", F.sum("brk").over(wb.rowsBetween(Window.unboundedPreceding, 0))))
    local = local.withColumn("lstart", F.min("line").over(Window.partitionBy("file", "block", "isl")))
    summ = local.groupBy("file", "block").agg(
        F.min("line").alias("first"), F.max("line").alias("last"),
        F.max(F.struct("isl", "lstart")).alias("li"), F.max("isl").alias("n_isl"))
    wf = Window.partitionBy("file").orderBy("block")
    summ = (summ.withColumn("conn", F.coalesce(F.col("first") - F.lag("last").over(wf) <= gap, F.lit(False)))
            .withColumn("single", F.col("n_isl") == 1)
            # R_k (start of the block's last island, resolved): inherited while
            # the block is one island joined to the previous block
            .withColumn("brk", (~(F.col("conn") & F.col("single"))).cast("int"))
            .withColumn("g", F.sum("brk").over(wf.rowsBetween(Window.unboundedPreceding, 0))))
    wg = Window.partitionBy("file", "g").orderBy("block")
    summ = summ.withColumn("R", F.first(F.col("li.lstart")).over(wg))
    # F_k (start of the block's first island, resolved)
    summ = summ.withColumn("Fst", F.when(F.col("conn"), F.lag("R").over(wf)).otherwise(F.col("first")))
    res = summ.select("file", "block", "Fst")
    out = (local.join(res, ["file", "block"])
           .select("file", "line", F.when(F.col("isl") == 1, F.col("Fst")).otherwise(F.col("lstart"))
                   .alias("start")))
    return out


def merge_nearby(findings: DataFrame, gap: int = NEARBY_LINES) -> DataFrame:
    """H2: findings of one file whose lines are within ``gap`` of each other
    (transitively: chains merge) become one finding with the highest
    severity; its line is the island's first line, ``line_end`` the last,
    ``issue`` all distinct texts joined with ``; `` in the order of their first
    lines (then by text).  Equal texts are one row before they are joined."""
    isl = line_islands(findings, gap)
    j = findings.join(isl, ["file", "line"])
    texts = (j.groupBy("file", "start", "issue")
             .agg(F.min("line").alias("line"), F.max("line").alias("line_end"),
                  F.min("severity").alias("severity"), F.count(F.lit(1)).alias("n")))
    return (texts.groupBy("file", "start")
            .agg(F.min("line").alias("line"), F.max("line_end").alias("line_end"),
                 F.array_sort(F.collect_list(F.struct("line", "issue"))).alias("texts"),
                 F.min("severity").alias("severity"), F.sum("n").alias("n_findings"))
            .select("file", "line", "line_end",
                    F.array_join(F.transform("texts", lambda t: t["issue"]), "; ").alias("issue"),
                    "severity", "n_findings"))


def severity_rollup(findings: DataFrame) -> DataFrame:
    """H3: number of findings per severity, P0, P1, P2 in that order (zero
    rows included)."""
    spark = findings.sparkSession
    sev = spark.createDataFrame([(i, s) for i, s in enumerate(SEVERITIES)], "ord int, severity string")
    counts = findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    return (sev.join(counts, "severity", "left")
            .select("severity", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "ord")
            .orderBy("ord").drop("ord"))


def approved_files(changed: DataFrame, findings: DataFrame) -> DataFrame:
    """H4: changed files without any finding."""
    return changed.select("file").distinct().join(findings.select("file"), "file", "left_anti")
