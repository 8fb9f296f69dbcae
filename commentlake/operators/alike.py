"""Connected components of similar sets, by blocks.

Texts of a common vocabulary share words with so many others that buckets of words
hold a part of all pairs, and each such pair is a row to be shuffled.  Here pairs are
no rows.  Every set gets a parity map: the bit of each of its words is flipped, so
words that two sets share cancel out and every differing bit is owed to a word of one
set alone.  Sets ordered by their size are packed into blocks; two blocks whose sizes
are near enough meet in one task, which compares the maps and emits only pairs that
may reach the threshold.  These are checked by their words.

The work is the square of the number of sets of like size, some nanoseconds a pair; what is
written grows with the sets alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.sizing import checked_broadcast
from ..session import dropped

#: Bits of a map for each word of its set, at least (a power of two in all), and of any map.
WORD_BITS, LEAST_BITS = 4, 256
#: Maps are compared folded to this part of their bits, and in full where that does not tell.
FOLD = 4
#: Sets and bytes of maps of a block, at most; bytes of the blocks that are broadcast at once.
BLOCK_SETS, BLOCK_BYTES, CHUNK_BYTES = 8192, 2 << 20, 48 << 20
#: Sets that agree in BAND_ROWS minimal hashes are looked at first.
BANDS, BAND_ROWS = 8, 8
#: Bits of maps made at once; rows and columns of pairs compared at once.
MAP_CHUNK, ROWS, COLUMNS = 1 << 22, 64, 4096


def map_bits(n: np.ndarray) -> np.ndarray:
    """Bits of the map of sets of ``n`` words."""
    return np.maximum(LEAST_BITS, 1 << np.ceil(np.log2(np.maximum(n, 1) * WORD_BITS)).astype(np.int64))


def parity_maps(sizes: np.ndarray, words: np.ndarray) -> list[bytes]:
    """The parity map of each of the sets whose words follow each other."""
    bits = map_bits(sizes)
    ends, stops = np.cumsum(bits), np.cumsum(sizes)
    out, lo = [], 0
    while lo < len(sizes):
        begin = ends[lo] - bits[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, begin + MAP_CHUNK, "right")))
        some, n = words[stops[lo] - sizes[lo]:stops[hi - 1]], sizes[lo:hi]
        at = np.repeat(ends[lo:hi] - bits[lo:hi] - begin, n) + (some & (np.repeat(bits[lo:hi], n) - 1))
        odd = np.bincount(at, minlength=ends[hi - 1] - begin).astype(np.uint8) & 1
        packed = np.packbits(odd, bitorder="little").tobytes()
        cuts = (ends[lo:hi] - begin) // 8
        out += [packed[b - k:b] for b, k in zip(cuts.tolist(), (bits[lo:hi] // 8).tolist(), strict=True)]
        lo = hi
    return out


def bands(sizes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """(sets, BANDS): keys in which sets of many common words are likely to agree."""
    starts = np.cumsum(sizes) - sizes
    seeds = np.random.default_rng(1).integers(0, 2**63, (BANDS, BAND_ROWS, 2), dtype=np.uint64)
    hashes, out = words.view(np.uint64), np.empty((len(sizes), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(sizes), b, np.uint64)
        for flip, factor in seeds[b]:
            mixed = (hashes ^ flip) * (factor | np.uint64(1))
            key = (key ^ np.minimum.reduceat(mixed ^ (mixed >> np.uint64(32)), starts)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        out[:, b] = key
    return out.view(np.int64)


def facts(sets: DataFrame) -> DataFrame:
    """(id, n, m, bands) of sets (id, words: distinct hashes, one or more)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("words")
            sizes, words = column.value_lengths().to_numpy().astype(np.int64), column.flatten().to_numpy()
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * BANDS), pa.array(bands(sizes, words).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int32()), pa.array(parity_maps(sizes, words), pa.binary()), keys],
                                             ["id", "n", "m", "bands"])

    return sets.select("id", "words").mapInArrow(run, "id long, n int, m binary, bands array<long>")


def blocks(sets: DataFrame) -> DataFrame:
    """Sets (id, n, label, m) in rows of many: (lo, hi, size, ids, ns, labels, ms), each from
    the smallest set to the largest.  The sets of a task come ordered by n."""
    def packed(part: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(part)
        ns = t["n"].to_numpy()
        maps = b"".join(t["m"].to_pylist())
        row = {"lo": int(ns[0]), "hi": int(ns[-1]), "size": len(maps) + 20 * len(ns), "ids": t["id"].to_numpy().tobytes(),
               "ns": ns.astype(np.int32).tobytes(), "labels": t["label"].to_numpy().tobytes(), "ms": maps}
        return pa.RecordBatch.from_pylist([row], kind)

    kind = pa.schema([("lo", pa.int32()), ("hi", pa.int32()), ("size", pa.int64()), *((c, pa.binary()) for c in ("ids", "ns", "labels", "ms"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, size = [], 0, 0
        for batch in batches:
            lo = 0
            ends = np.cumsum(map_bits(batch.column("n").to_numpy()) // 8)
            while lo < batch.num_rows:
                room = BLOCK_BYTES - size + (ends[lo - 1] if lo else 0)
                hi = min(batch.num_rows, lo + BLOCK_SETS - n, int(np.searchsorted(ends, room, "right")))
                if hi <= lo and part:
                    yield packed(part)
                    part, n, size = [], 0, 0
                    continue
                hi = max(hi, lo + 1)
                part.append(batch.slice(lo, hi - lo))
                n, size, lo = n + hi - lo, size + int(ends[hi - 1] - (ends[lo - 1] if lo else 0)), hi
        if part:
            yield packed(part)

    return sets.select("id", "n", "label", "m").mapInArrow(run, "lo int, hi int, size long, ids binary, ns binary, labels binary, ms binary")


class _Block:
    """A block's sets, unpacked; ``parts``: of each length of maps, where its sets begin and
    end, and their maps."""

    def __init__(self, ids: bytes, ns: bytes, labels: bytes, ms: bytes):
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.ns = np.frombuffer(ns, np.int32).astype(np.int64)
        bits = map_bits(self.ns)
        words, all_words, begin = bits // 64, np.frombuffer(ms, np.uint64), 0
        self.parts = []
        for k in np.unique(words).tolist():
            lo, hi = np.searchsorted(words, k), np.searchsorted(words, k, "right")
            self.parts.append((int(lo), int(hi), all_words[begin:begin + (hi - lo) * k].reshape(hi - lo, k)))
            begin += (hi - lo) * k


def folded(maps: np.ndarray, words: int) -> np.ndarray:
    """Maps (sets, words) folded to fewer words: a word's bit is then its hash by fewer bits."""
    return np.bitwise_xor.reduce(maps.reshape(len(maps), -1, words), axis=1)


def most_differing(n: np.ndarray | int, threshold: float) -> np.ndarray | int:
    """Words that two sets of together ``n`` words may have in one of them alone, if they
    reach the threshold."""
    return n - 2 * np.ceil(n * (threshold / (1 + threshold)) - 1e-9).astype(np.int64)


def near(x: _Block, y: _Block, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, b): places of sets of two blocks (``same``: of one, each pair once) of different
    labels that may reach the threshold."""
    xor, count = np.empty((ROWS, COLUMNS), np.uint64), np.empty((ROWS, COLUMNS), np.uint8)
    total = np.empty((ROWS, COLUMNS), np.int32)
    for xlo, xhi, xm in x.parts:
        for ylo, yhi, ym in y.parts:
            if min(x.ns[xhi - 1], y.ns[yhi - 1]) < max(x.ns[xlo], y.ns[ylo]) * (threshold - 1e-9):
                continue
            words = min(xm.shape[1], ym.shape[1])
            whole_x, whole_y = folded(xm, words), folded(ym, words)
            small_x, small_y = (np.ascontiguousarray(folded(m, max(1, words // FOLD)).T) for m in (whole_x, whole_y))
            for r in range(xlo, xhi, ROWS):
                rows = min(ROWS, xhi - r)
                least, most = x.ns[r] * (threshold - 1e-9), x.ns[r + rows - 1] / (threshold - 1e-9)
                first = max(ylo, int(np.searchsorted(y.ns, least)), r + 1 if same else 0)
                last = min(yhi, int(np.searchsorted(y.ns, most, "right")))
                for c in range(first, last, COLUMNS):
                    cols = min(COLUMNS, last - c)
                    u, v, w = xor[:rows, :cols], count[:rows, :cols], total[:rows, :cols]
                    w[:] = 0
                    for p, q in zip(small_x[:, r - xlo:r - xlo + rows], small_y[:, c - ylo:c - ylo + cols], strict=True):
                        np.bitwise_xor(p[:, None], q[None, :], out=u)
                        np.bitwise_count(u, out=v)
                        np.add(w, v, out=w)
                    i, j = np.nonzero(w <= most_differing(np.arange(x.ns[r], x.ns[r + rows - 1] + y.ns[c + cols - 1] + 1), threshold).max())
                    for k in range(0, len(i), 1 << 16):
                        a, b = i[k:k + (1 << 16)] + r, j[k:k + (1 << 16)] + c
                        ok = (x.labels[a] != y.labels[b]) & (np.minimum(x.ns[a], y.ns[b]) >= np.maximum(x.ns[a], y.ns[b]) * (threshold - 1e-9))
                        if same:
                            ok &= a < b
                        a, b = a[ok], b[ok]
                        differing = np.bitwise_count(whole_x[a - xlo] ^ whole_y[b - ylo]).sum(axis=1, dtype=np.int64)
                        ok = differing <= most_differing(x.ns[a] + y.ns[b], threshold)
                        if ok.any():
                            yield a[ok], b[ok]


def _compared(pairs: DataFrame, threshold: float) -> DataFrame:
    """(a, b): ids of sets of two blocks (columns with suffixes x and y) that may be similar."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                x, y = (_Block(*(batch.column(c + s)[r].as_py() for c in ("ids", "ns", "labels", "ms"))) for s in "xy")
                for a, b in near(x, y, threshold, batch.column("same")[r].as_py()):
                    a, b = x.ids[a], y.ids[b]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def similar(sets: DataFrame, pairs: DataFrame, threshold: float, keep) -> DataFrame:
    """Of pairs (a, b) of sets (id, words, n) those that reach the threshold.  Only sets that
    occur in a pair are sent anywhere."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    some = keep(sets.join(checked_broadcast(keep(ids)), "id", "left_semi"))
    side = lambda v, k: some.select(F.col("id").alias(v), F.col("words").alias(f"w{k}"), F.col("n").alias(f"n{k}"))
    common = F.size(F.array_intersect("w1", "w2"))
    out = keep(pairs.join(side("a", 1), "a").join(side("b", 2), "b").select("a", "b", common.alias("c"), "n1", "n2")
               .where(F.col("c") / (F.col("n1") + F.col("n2") - F.col("c")) >= threshold).select("a", "b"))
    dropped(some)
    return out


def similar_by_blocks(sets: DataFrame, threshold: float, keep, joined) -> DataFrame:
    """(id, label) of every set (id, words: distinct hashes, n): label is the smallest id
    reachable by links of Jaccard similarity >= threshold.  ``joined(labels, links, keep)``
    joins components.

    Sets that agree in a band of minimal hashes are held against the smallest id of the
    band first, which makes one component of most copies of a text whatever their number;
    then all pairs of different components are compared."""
    known = keep(facts(sets))
    in_bands = known.select("id", F.explode("bands").alias("band"))
    low = in_bands.groupBy("band").agg(F.min("id").alias("a"), F.max("id").alias("high")).where("a < high").select("band", "a")
    stars = keep(in_bands.join(low, "band").where("a < id").select("a", F.col("id").alias("b")).distinct())
    label = joined(keep(sets.select("id", F.col("id").alias("label"))), similar(sets, stars, threshold, keep), keep)

    size = F.greatest(F.lit(LEAST_BITS), F.col("n") * 2 * WORD_BITS) / 8 + 20
    n, total = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    tasks = max(1, math.ceil(n / BLOCK_SETS), math.ceil(total / BLOCK_BYTES))
    packed = keep(blocks(known.join(label, "id").repartitionByRange(tasks, "n", "id").sortWithinPartitions("n"))
                  .withColumn("k", F.monotonically_increasing_id()))
    dropped(known)
    heads = sorted(packed.select("lo", "hi", "k", "size").collect(), key=lambda h: (h.lo, h.k))
    chunks, room = [], 0
    for h in heads:
        room -= h.size
        if room < 0 or not chunks:
            chunks.append([])
            room = CHUNK_BYTES - h.size
        chunks[-1].append(h)
    found = [_chunk_pairs(packed, heads, chunk, threshold, keep) for chunk in chunks]
    if not found:
        return label
    rest = found[0]
    for more in found[1:]:
        rest = rest.unionByName(more)
    label = joined(label, similar(sets, keep(rest), threshold, keep), keep)
    dropped(packed, stars, *found)
    return label


def _chunk_pairs(packed: DataFrame, heads: list, chunk: list, threshold: float, keep) -> DataFrame:
    """Pairs of the sets of some blocks with all others; each pair of blocks is compared in
    the task of one of the two, drawn by a hash."""
    lo, hi = min(h.lo for h in chunk), max(h.hi for h in chunk)
    few = sum(h.hi >= lo * (threshold - 1e-9) and h.lo * (threshold - 1e-9) <= hi for h in heads)
    names = lambda s: [F.col(c).alias(c + s) for c in ("lo", "hi", "ids", "ns", "labels", "ms", "k")]
    x = (packed.where((F.col("hi") >= lo * (threshold - 1e-9)) & (F.col("lo") * (threshold - 1e-9) <= hi))
         .repartition(max(1, few)).select(*names("x")))
    y = packed.where(F.col("k").isin([h.k for h in chunk])).select(*names("y"))
    sizes = lambda p, q: F.col("hi" + p) >= F.col("lo" + q) * (threshold - 1e-9)
    drawn: Column = (F.pmod(F.xxhash64(F.least("kx", "ky"), F.greatest("kx", "ky")), F.lit(2)) == 0) == (F.col("kx") < F.col("ky"))
    both = x.join(F.broadcast(y), sizes("x", "y") & sizes("y", "x") & ((F.col("kx") == F.col("ky")) | drawn))
    return keep(_compared(both.withColumn("same", F.col("kx") == F.col("ky")), threshold))
