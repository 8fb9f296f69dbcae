"""Token ids in compressed files: context mixing and a range coder.

A file holds groups of blocks and, at its end, a table of its documents.  Each
block starts with empty tables and has checksums of its bytes and ids, so any
block can be read (``IdFile.read_block``), and damage found, alone.  Within a block three predictions of
the next id are mixed: the id that last followed the two ids before it (order
2), the one that last followed the id before it (order 1), and the frequencies
of ids in the group, which stand in its head (order 0).  How often the first two were right in the same state
of confidence gives their weights, which change with every id; the mixed
distribution drives one step of a range coder.

The blocks of a group are coded side by side: step t codes the t-th id of all
of them by array operations, as one step of one block would be far too slow in
Python.  A group has at most LANES blocks of BLOCK ids, which bounds the memory, and
FEW blocks if its ids are of more than KINDS kinds.

Defined results: a null text is the empty text; a document without ids is kept
with its length 0; documents of one doc_id stay together in input order of the
sort; a null doc_id sorts first; a wrong checksum raises an error, or, if asked for,
leaves out the documents that the block holds ids of and reads the others; an empty
table has no files; other columns are not read.
"""

from __future__ import annotations

import json
import os
import string
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from .common import Memo, stored, table

MAGIC = b"CMIDS2\r\n"
BLOCK, LANES = 4096, 2048
END_ID = 1
#: Letters whose lower case is one letter and that no normal form changes.
LATIN = string.ascii_letters + "".join(map(chr, {*range(0xC0, 0x100)} - {0xD7, 0xF7}))
#: Bytes of text that are parted into words at once, about, and words that the tokenizer gets at once.
TEXT = 8 << 20
TOGETHER = 128
#: Slots of the order-1 and order-2 tables (powers of two).
SLOTS1, SLOTS2 = 1 << 10, 1 << 11
MIX, FREQ = 14, 18                     # bits of the mixing weights and of order-0 frequencies
#: Kinds of ids that a group with more than FEW blocks may have.
KINDS, FEW = 1 << 17, (1 << 17) // BLOCK
#: The range coder's interval lies in (LOW, TOP] and gives off 16 bits at a time; all
#: its numbers are whole and below 2^53, so floating point computes them exactly.
TOP, LOW, WORD = 2.0 ** 52, 2.0 ** 36, 2.0 ** 16
UNIT, ORDER0 = 2.0 ** -(MIX + FREQ), 2.0 ** FREQ
#: What the two bounds between the three shares tend to, if the id lies before the bound, and how much less if behind it.
BEFORE, GAP = np.array([[2.0 ** MIX - 128], [2.0 ** MIX - 64]]), 2.0 ** MIX - 160


class _Model:
    """The model of all lanes; the coder and the decoder drive it alike: ``predict``,
    then ``shares`` and ``learn``.  Row 0 of its arrays is order 2, row 1 order 1."""

    def __init__(self, lanes: int, frequencies: np.ndarray):
        rows = np.arange(lanes)
        self.table = np.zeros(lanes * (SLOTS1 + SLOTS2), np.int32)      # symbol * 4 + confidence
        self.weights = np.repeat([2.0 ** MIX // 3, 2.0 ** MIX * 2 // 3], lanes * 32)
        self.base = np.stack([rows * SLOTS2, lanes * SLOTS2 + rows * SLOTS1])
        self.base_weights = rows * 32
        self.mask, self.second = np.array([[SLOTS2 - 1], [SLOTS1 - 1]]), np.array([[0], [lanes * 32]])
        #: Order 0, and behind its symbols the whole of it, for ids that another prediction gives.
        self.width0 = np.append(frequencies.astype(float), ORDER0)
        self.begin0 = np.append(np.cumsum(frequencies) - frequencies, 0).astype(float)
        self.whole = np.int32(len(frequencies))
        self.context, self.next2 = np.zeros((2, lanes), np.int64), np.zeros(lanes, np.int64)
        self.take(lanes)

    def take(self, m: int) -> None:
        """From now on only the first m lanes."""
        self.m, self.column = m, np.arange(m)
        self.base, self.base_weights = self.base[:, :m], self.base_weights[:m]
        self.context, self.next2 = np.ascontiguousarray(self.context[:, :m]), self.next2[:m]
        self.bounds = np.zeros((4, m))
        self.bounds[3] = 2.0 ** MIX
        self.inner = self.bounds[1:3]

    def predict(self) -> None:
        """Both predictions ``s``, and the bounds between the three shares of 2^MIX."""
        at = self.context >> 9
        at &= self.mask
        at += self.base
        self.at, self.e = at, self.table.take(at)
        self.c, self.s = self.e & 3, self.e >> 2
        state = self.c[0] << 3
        state += self.c[1] << 1
        state += self.s[0] == self.s[1]
        self.state = state + self.base_weights + self.second
        self.weights.take(self.state, out=self.inner, mode="clip")

    def picked(self, behind: np.ndarray) -> np.ndarray:
        """Which of three rows holds the share of each lane, as a flat place."""
        at = np.add(behind[0], behind[1], dtype=np.int64)
        at *= self.m
        at += self.column
        return at

    def shares(self, x: np.ndarray, behind: np.ndarray, low: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids begin, and their widths, of 2^(MIX + FREQ)."""
        y = np.maximum(x, self.whole * ~behind[1])
        begin = self.begin0.take(y)
        begin *= share
        begin += low * ORDER0
        return begin, self.width0.take(y) * share

    def learn(self, x: np.ndarray, miss: np.ndarray, behind: np.ndarray, rate: float) -> None:
        w = self.inner
        step = BEFORE - w
        step -= behind * GAP
        step *= rate
        np.floor(step, out=step)
        step += w
        self.weights[self.state] = step
        more = (self.c < 3).view(np.int8)
        less = miss.view(np.int8)
        new = self.e + (more - less - (more & less))                 # a hit adds 1, up to 3; a miss takes 1
        step = (x << 2) + 1 - new                                    # or the place
        step *= new < self.s << 2
        new += step
        self.table[self.at] = new
        one = x + np.int64(1)
        np.multiply(one, 0x9E3779B1, out=self.context[1])
        np.add(self.context[1], self.next2, out=self.context[0])
        self.next2 = one * 0x85EBCA6B


def _rate(t: int) -> float:
    """How far the weights move at step t."""
    return 1 / 8 if t < 64 else 1 / 16 if t < 512 else 1 / 32


def _frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts as shares of 2^FREQ, none 0."""
    if len(counts) > KINDS:
        raise ValueError(f"a group may have {KINDS} kinds of ids")
    edges = np.cumsum(counts) * ((1 << FREQ) - len(counts)) // counts.sum() + np.arange(1, len(counts) + 1)
    return np.diff(edges, prepend=0)


def _alphabet(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ids, ascending, and which of them each id is."""
    top = int(ids.max()) + 1
    if top > 1 << 22:
        return np.unique(ids, return_inverse=True)
    there = np.zeros(top, bool)
    there[ids] = True
    return np.flatnonzero(there).astype(np.uint32), (np.cumsum(there, dtype=np.int32) - 1)[ids]


def encode_group(ids: np.ndarray) -> bytes:
    """A group: its different ids and their frequencies, and blocks of up to BLOCK ids."""
    ids = np.asarray(ids, np.uint32)
    alphabet, symbols = _alphabet(ids)
    frequencies = _frequencies(np.bincount(symbols, minlength=len(alphabet)))
    lanes = -(-len(ids) // BLOCK)
    last = len(ids) - BLOCK * (lanes - 1)
    grid = np.zeros(lanes * BLOCK, np.int32)
    grid[:len(ids)] = symbols
    grid = np.ascontiguousarray(grid.reshape(lanes, BLOCK).T)
    model = _Model(lanes, frequencies)
    low, span = np.zeros(lanes), np.full(lanes, TOP)
    words = np.zeros((2 * BLOCK + 64, lanes), np.int32)
    flat, place = words.reshape(-1), np.arange(lanes)

    def put(go: np.ndarray, l: np.ndarray) -> np.ndarray:
        """Gives off 16 bits, or 17 if there is one to carry."""
        word = np.floor(l / LOW)
        at = place[go]
        flat[at] = word.astype(np.int32)
        place[go] = at + lanes
        return (l - word * LOW) * WORD

    m = lanes
    for t in range(BLOCK if lanes > 1 else last):
        if t == last:
            m = lanes - 1
            model.take(m)
        x = grid[t, :m]
        model.predict()
        miss = model.s != x
        behind = miss.copy()
        behind[1] &= miss[0]
        at = model.picked(behind)
        start = model.bounds.take(at)
        begin, width = model.shares(x, behind, start, model.bounds.take(at + m) - start)
        unit = np.floor(span[:m] * UNIT)
        begin *= unit
        low[:m] += begin
        width *= unit
        span[:m] = width
        model.learn(x, miss, behind, _rate(t))
        go = np.flatnonzero(width < LOW)
        while len(go):
            low[go] = put(go, low[go])
            span[go] = s = span[go] * WORD
            go = go[s < LOW]
    every = np.arange(lanes)
    for _ in range(4):
        low = put(every, low)
    count = place // lanes
    words = words[:count.max()]
    while (carry := words >> 16).any():
        words &= 0xFFFF
        words[:-1] += carry[1:]
    words = np.ascontiguousarray(words.T.astype("<u2"))
    bodies = [words[k, :count[k]].tobytes() for k in range(lanes)]
    sums = [(zlib.crc32(b), zlib.crc32(ids[k * BLOCK:(k + 1) * BLOCK].astype("<u4").tobytes())) for k, b in enumerate(bodies)]
    head = struct.pack("<IIII", alphabet[0], len(ids), len(alphabet), lanes)
    head += np.diff(alphabet, prepend=alphabet[:1]).astype("<u4").tobytes() + frequencies.astype("<u4").tobytes()
    table_ = b"".join(struct.pack("<III", len(b), *s) for b, s in zip(bodies, sums, strict=True))
    return head + table_ + b"".join(bodies)


class Damage(ValueError):
    """Blocks that cannot be read; ``blocks`` are their numbers in the group."""

    def __init__(self, blocks: list[int]):
        super().__init__(f"damaged blocks: {blocks[:20]}")
        self.blocks = blocks


@dataclass(frozen=True)
class Head:
    """What stands before the blocks of a group."""
    ids: int
    alphabet: np.ndarray
    frequencies: np.ndarray    # shares of 2^FREQ
    heads: np.ndarray          # bytes, checksum of these and of the ids of each block
    size: int

    @classmethod
    def of(cls, data: memoryview) -> Head:
        first, n, symbols, lanes = struct.unpack_from("<IIII", data)
        alphabet = np.frombuffer(data, "<u4", symbols, 16).astype(np.uint32).cumsum(dtype=np.uint32) + np.uint32(first)
        frequencies = np.frombuffer(data, "<u4", symbols, 16 + 4 * symbols).astype(np.int64)
        heads = np.frombuffer(data, "<u4", 3 * lanes, 16 + 8 * symbols).reshape(lanes, 3)
        if not 0 < symbols or lanes != -(-n // BLOCK) or not frequencies.all() or frequencies.sum() != 1 << FREQ:
            raise ValueError("the head of a group is damaged")
        return cls(n, alphabet, frequencies, heads, 16 + 8 * symbols + 12 * lanes)

    def ids_in(self, k: int) -> int:
        return min(BLOCK, self.ids - BLOCK * k)

    def place(self, k: int) -> tuple[int, int]:
        """Where block k begins in the group, and its length."""
        return self.size + int(self.heads[:k, 0].sum(dtype=np.int64)), int(self.heads[k, 0])


def decode_blocks(head: Head, bodies: dict[int, bytes]) -> tuple[dict[int, np.ndarray], list[int]]:
    """The ids of some blocks of a group, side by side, and the numbers of those that
    are damaged."""
    sound = sorted(k for k, body in bodies.items()
                   if len(body) == head.heads[k, 0] and zlib.crc32(body) == head.heads[k, 1])
    out = dict(zip(sound, _decoded([bodies[k] for k in sound], [head.ids_in(k) for k in sound], head), strict=True))
    wrong = [k for k, ids in out.items() if zlib.crc32(ids.astype("<u4").tobytes()) != head.heads[k, 2]]
    return {k: ids for k, ids in out.items() if k not in wrong}, sorted({*bodies} - {*sound} | {*wrong})


def _decoded(bodies: list[bytes], sizes: list[int], head: Head) -> list[np.ndarray]:
    """The ids of blocks, of which only the last may be shorter than the others."""
    lanes = len(bodies)
    if not lanes:
        return []
    words = np.zeros((lanes, max(map(len, bodies)) // 2 + 8), np.uint16)
    for k, body in enumerate(bodies):
        words[k, :len(body) // 2] = np.frombuffer(body, "<u2", len(body) // 2)
    model = _Model(lanes, head.frequencies)
    code, span = words[:, :4] @ np.array([LOW, LOW / WORD, 16., 0.]) + (words[:, 3] >> 12), np.full(lanes, TOP)
    flat = words.reshape(-1)
    flat[:-1] = (flat[:-1] << 4) | (flat[1:] >> 12)          # the interval's 52 bits end within a word
    count = np.arange(lanes) * words.shape[1] + 3
    grid = np.zeros((sizes[0], lanes), np.int32)
    kinds = np.repeat(np.arange(len(head.alphabet), dtype=np.int32), head.frequencies)
    m = lanes
    for t in range(sizes[0]):
        if t == sizes[-1]:
            m = lanes - 1
            model.take(m)
            code, span, count = code[:m], span[:m], count[:m]
        if not t or t == sizes[-1]:
            three = np.zeros((3, m), np.int32)
        model.predict()
        unit = np.floor(span * UNIT)
        value = np.floor(code / unit)
        behind = value >= model.inner * ORDER0
        at = model.picked(behind)
        start = model.bounds.take(at)
        share = model.bounds.take(at + m) - start
        aim = value - start * ORDER0
        aim /= share
        three[:2] = model.s
        kinds.take(aim.astype(np.int64), out=three[2], mode="clip")
        x = three.take(at)
        begin, span = model.shares(x, behind, start, share)
        begin *= unit
        code -= begin
        span *= unit
        grid[t, :m] = x
        model.learn(x, model.s != x, behind, _rate(t))
        go = np.flatnonzero(span < LOW)
        while len(go):
            place = count[go]
            code[go] = code[go] * WORD + flat.take(place, mode="clip")
            count[go] = place + 1
            span[go] = s = span[go] * WORD
            go = go[s < LOW]
    return [head.alphabet[grid[:n, k]] for k, n in enumerate(sizes)]


def decode_group(data: memoryview) -> tuple[np.ndarray, int]:
    """The ids of the group that ``data`` begins with, and its length in bytes;
    raises Damage if a block is damaged."""
    head = Head.of(data)
    places = [head.place(k) for k in range(len(head.heads))]
    ids, wrong = decode_blocks(head, {k: bytes(data[at:at + n]) for k, (at, n) in enumerate(places)})
    if wrong:
        raise Damage(wrong)
    return np.concatenate([ids[k] for k in range(len(places))]), places[-1][0] + places[-1][1]


def lanes_for(ids: np.ndarray) -> int:
    """Blocks that a group of such ids may have."""
    top = int(ids.max()) + 1
    different = np.count_nonzero(np.bincount(ids, minlength=top)) if top < 1 << 22 else len(np.unique(ids))
    return LANES if different <= KINDS else FEW


def write_ids(stream, documents: Iterator[tuple[int | None, bytes]]) -> tuple[int, int]:
    """Writes (doc_id, ids as little-endian 32-bit integers); the numbers of
    documents and ids.  Keeps one group of ids in memory."""
    stream.write(MAGIC)
    keys, lengths, parts, held, total, at = [], [], [], 0, 0, len(MAGIC)
    groups = []

    def put(final: bool) -> None:
        nonlocal parts, held, at
        data = b"".join(parts)
        cut = 4 * BLOCK * (lanes_for(np.frombuffer(data, "<u4")) if data else 1)
        while len(data) >= cut or final and data:
            group = encode_group(np.frombuffer(data[:cut], "<u4"))
            stream.write(group)
            groups.append((at, len(group), min(len(data), cut) // 4))
            at += len(group)
            data = data[cut:]
        parts, held = [data] if data else [], len(data)

    for key, ids in documents:
        keys.append(key)
        lengths.append(len(ids) // 4)
        parts.append(ids)
        held += len(ids)
        total += len(ids) // 4
        if held >= 4 * BLOCK * LANES:
            put(False)
    put(True)
    null = np.array([k is None for k in keys], np.uint8)
    foot = [np.array([k or 0 for k in keys], "<i8").tobytes(), null.tobytes(), np.array(lengths, "<u8").tobytes(),
            np.array(groups, "<u8").tobytes()]
    packed = zlib.compress(b"".join(foot), 6)
    stream.write(packed + struct.pack("<QQQI", len(keys), len(groups), len(packed), zlib.crc32(packed)) + MAGIC)
    return len(keys), total


class IdFile:
    """A written file; ``stream`` can seek and is ``size`` bytes long."""

    def __init__(self, stream, size: int):
        self.stream = stream
        tail = struct.calcsize("<QQQI") + len(MAGIC)
        last = self._bytes(size - tail, tail)
        docs, groups, length, crc = struct.unpack_from("<QQQI", last)
        packed = self._bytes(size - tail - length, length) if last[-len(MAGIC):] == MAGIC else b""
        if zlib.crc32(packed) != crc or last[-len(MAGIC):] != MAGIC:
            raise ValueError("the table of documents is damaged")
        foot = zlib.decompress(packed)
        self.keys = np.frombuffer(foot, "<i8", docs)
        self.null = np.frombuffer(foot, np.uint8, docs, 8 * docs)
        self.lengths = np.frombuffer(foot, "<u8", docs, 9 * docs).astype(np.int64)
        #: Where each group begins, its bytes and its ids.
        self.groups = np.frombuffer(foot, "<u8", 3 * groups, 17 * docs).reshape(groups, 3).astype(np.int64).tolist()

    def _bytes(self, at: int, n: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(n)

    def read_block(self, group: int, block: int) -> np.ndarray:
        """The ids of one block; only the group's head and the block are read."""
        at, length, _ = self.groups[group]
        symbols, lanes = struct.unpack("<II", self._bytes(at + 8, 8))
        head = Head.of(memoryview(self._bytes(at, min(length, 16 + 8 * symbols + 12 * lanes))))
        start, n = head.place(block)
        ids, wrong = decode_blocks(head, {block: self._bytes(at + start, n)})
        if wrong:
            raise Damage(wrong)
        return ids[block]

    def read_group(self, group: int) -> tuple[np.ndarray, list[int]]:
        """The ids of a group and its damaged blocks, whose ids are 0."""
        at, length, n = self.groups[group]
        data, out = memoryview(self._bytes(at, length)), np.zeros(n, np.uint32)
        every = list(range(-(-n // BLOCK)))
        try:
            head = Head.of(data)
            if head.ids != n or sum(head.place(every[-1])) > length:
                return out, every
            bodies = {k: bytes(data[p:p + m]) for k in every for p, m in [head.place(k)]}
        except (ValueError, struct.error):
            return out, every
        ids, wrong = decode_blocks(head, bodies)
        for k, part in ids.items():
            out[k * BLOCK:k * BLOCK + len(part)] = part
        return out, wrong


def read_ids(stream, size: int, damaged: list[tuple[int, int]] | None = None) -> Iterator[tuple[int | None, np.ndarray | None]]:
    """(doc_id, ids) in file order.  Damage raises; with a list ``damaged`` its blocks
    (group, block) go there, documents that they hold ids of come with None, and all
    others are read."""
    file = IdFile(stream, size)
    held, sound, k, docs = np.empty(0, np.uint32), np.empty(0, bool), 0, len(file.keys)
    for g in range(len(file.groups) + 1):
        if g < len(file.groups):
            ids, wrong = file.read_group(g)
            if wrong and damaged is None:
                raise Damage(wrong)
            ok = np.ones(len(ids), bool)
            for block in wrong:
                damaged.append((g, block))
                ok[block * BLOCK:(block + 1) * BLOCK] = False
            held, sound = np.concatenate([held, ids]), np.concatenate([sound, ok])
        pos = 0
        while k < docs and pos + file.lengths[k] <= len(held):
            end = pos + file.lengths[k]
            yield None if file.null[k] else int(file.keys[k]), held[pos:end] if sound[pos:end].all() else None
            pos = end
            k += 1
        held, sound = held[pos:], sound[pos:]
    if k != docs or len(held):
        raise ValueError("documents and ids do not agree")


# fixed values: the normalizer and pre-tokenizer of which Encoder knows where texts may be parted
WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}


def _letters(word: str) -> bool:
    """Whether it is a word of letters, in lower case too."""
    return word.isalpha() and word.lower().isalpha()            # a letter's lower case may end with a mark


def _laid(ids: np.ndarray, lengths: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Of ids in runs of some lengths, those of the runs in ``order``."""
    n = lengths[order]
    at = np.repeat((np.cumsum(lengths) - lengths)[order] - np.cumsum(n) + n, n)
    at += np.arange(len(at))
    return ids[at]


class Encoder:
    """The tokenizers library, by word.  The rules of such a file (WORDWISE) never
    look across ASCII white space, nor from a word of letters, in lower case too, to
    ASCII punctuation behind it, and ASCII letters are taken in lower case; so
    the different words of some texts and a bounded memo of their stems give the library's ids.  Stems of lower
    ASCII letters stand for themselves, so the library gets them without its
    normalizer and with a mere split at spaces.  With another file, or added tokens
    with white space in them, the library gets whole texts."""

    def __init__(self, file: str, limit: int = 24 << 20, longest: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit
        self.library = Tokenizer.from_file(file)
        with open(file, encoding="utf-8") as f:
            rules = json.load(f)
        self.wordwise = (all(rules.get(k) == v for k, v in WORDWISE.items()) and not rules.get("truncation")
                         and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]
                                     or t["content"].split() != [t["content"]] or t["content"].strip(".,").isalpha()
                                     or t["content"].rstrip(string.punctuation).isalpha()
                                     for t in rules.get("added_tokens", [])))
        self.splitter = Tokenizer(self.library.model)           # the same model, not a copy
        self.splitter.pre_tokenizer = WhitespaceSplit()
        mark = rules["model"].get("end_of_word_suffix") or ""
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.ending = np.zeros(self.library.get_vocab_size(with_added_tokens=True) + 1, bool)
        self.ending[[i for t, i in vocabulary.items() if mark and t.endswith(mark)]] = True
        #: The memo: stems and other parts, their ids one behind another, and how many each has.
        self.memo, self.ids, self.lengths = pa.array([], pa.string()), np.empty(0, "<u4"), np.empty(0, np.int64)
        self.limit, self.longest = limit, longest

    @property
    def known(self) -> list[str]:
        return self.memo.to_pylist()

    def _coded(self, some: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids, one behind another, and how many each has."""
        got = [c.ids for c in self.library.encode_batch_fast(some.to_pylist(), add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(got), "<u4"), np.fromiter(map(len, got), np.int64, len(got))

    def _coded_words(self, library, some: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of letters, TOGETHER to a call: the last token of each
        word, and no other, has the mark of a word's end."""
        texts = pa.ListArray.from_arrays(pa.array([*range(0, len(some), TOGETHER), len(some)], pa.int32()), some)
        got = library.encode_batch_fast(pc.binary_join(texts, " ").to_pylist(), add_special_tokens=False)
        ids, lengths = [np.empty(0, "<u4")], [np.empty(0, np.int64)]
        for k, c in enumerate(got):
            words, coded = min(TOGETHER, len(some) - k * TOGETHER), np.array(c.ids, "<u4")
            ends = np.flatnonzero(self.ending[coded]) + 1
            if len(ends) == words and ends[-1] == len(coded):
                n = np.diff(ends, prepend=0)
            else:
                coded, n = self._coded(some.slice(k * TOGETHER, words))
            ids.append(coded)
            lengths.append(n)
        return np.concatenate(ids), np.concatenate(lengths)

    def _asked(self, some: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        plain = pc.ascii_is_alpha(some).to_numpy(zero_copy_only=False)
        letters = plain.copy()
        rest = np.flatnonzero(~plain)
        letters[rest] = [_letters(x) for x in some.take(pa.array(rest)).to_pylist()]
        kinds = [np.flatnonzero(plain), np.flatnonzero(letters & ~plain), np.flatnonzero(~letters)]
        splitter, library, each = (some.take(pa.array(k)) for k in kinds)
        coded = self._coded_words(self.splitter, splitter), self._coded_words(self.library, library), self._coded(each)
        ids, lengths = (np.concatenate(x) for x in zip(*coded, strict=True))
        order = np.argsort(np.concatenate(kinds))
        return _laid(ids, lengths, order), lengths[order]

    def _found(self, parts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different stems and other parts, one behind another, and how many
        each has; the library is asked once for all that the memo does not know."""
        at = pc.index_in(parts, value_set=self.memo)
        new = pc.is_null(at)
        order, is_new = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64), new.to_numpy(zero_copy_only=False)
        order[is_new] = len(self.memo) + np.arange(np.count_nonzero(is_new))
        ids, lengths = self._asked(parts.filter(new))
        ids, lengths = np.concatenate([self.ids, ids]), np.concatenate([self.lengths, lengths])
        memo, keep = pa.concat_arrays([self.memo, parts.filter(new)]), np.arange(len(lengths))
        if memo.nbytes + ids.nbytes + lengths.nbytes > self.limit:      # parts not met lately are forgotten
            keep = order
        keep = keep[pc.less_equal(pc.binary_length(memo), self.longest).to_numpy(zero_copy_only=False)[keep]]
        self.memo, self.ids, self.lengths = memo.take(pa.array(keep)), _laid(ids, lengths, keep), lengths[keep]
        return _laid(ids, lengths, order), lengths[order]

    def _words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one behind another, and how many each has."""
        stems = pc.ascii_rtrim(words, characters=string.punctuation)
        latin = pc.match_substring_regex(stems, f"^[{LATIN}]+$")
        stems, tails = pc.ascii_lower(stems), pc.utf8_ltrim(words, characters=LATIN)
        others = []
        for word in words.filter(pc.invert(latin)).to_pylist():
            stem = word.rstrip(string.punctuation)
            stem = stem if _letters(stem) else word
            others += stem, word[len(stem):]
        if others:
            stems = pc.replace_with_mask(stems, pc.invert(latin), pa.array(others[::2], pa.string()))
            tails = pc.replace_with_mask(tails, pc.invert(latin), pa.array(others[1::2], pa.string()))
        parts = pa.concat_arrays([stems, tails]).dictionary_encode()
        ids, lengths = self._found(parts.dictionary)
        order = parts.indices.to_numpy(zero_copy_only=False).reshape(2, -1).T.reshape(-1)
        return _laid(ids, lengths, order), lengths[order].reshape(-1, 2).sum(axis=1)

    def encode(self, texts: pa.StringArray | list[str | None], end: int) -> list[bytes]:
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        last = end.to_bytes(4, "little")
        if not self.wordwise:
            coded = self.library.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)
            return [np.array(c.ids, "<u4").tobytes() + last for c in coded]
        parted = pc.ascii_split_whitespace(texts)
        words = parted.flatten().dictionary_encode()
        ids, lengths = self._words(words.dictionary)
        # each text's words, and the end behind them as one more word
        ids, lengths = np.append(ids, np.array([end], "<u4")), np.append(lengths, 1)
        ends = np.cumsum(pc.list_value_length(parted).to_numpy(zero_copy_only=False))
        order = np.insert(words.indices.to_numpy(zero_copy_only=False), ends, len(lengths) - 1)
        data = _laid(ids, lengths, order).tobytes()
        ends = (4 * np.cumsum(lengths[order])[ends + np.arange(len(ends))]).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


@cache
def encoder(file: str) -> Encoder:
    return Encoder(file)


FILE = T.StructType([T.StructField("file", T.StringType()), T.StructField("documents", T.LongType()),
                     T.StructField("ids", T.LongType())])


def write_documents(docs: DataFrame, path: str, tokenizer_file: str, end: int = END_ID) -> DataFrame:
    """Writes the ids of ``docs`` (doc_id, text) under ``path`` in ascending
    doc_id order, a file for each range of doc_id.  Returns the written files
    (file, documents, ids, first, start): smallest doc_id, ids before the file.  A
    repeated task writes a file of its own, and only the listed ones count."""
    ranged = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions("doc_id")
    schema = T.StructType([*FILE, T.StructField("first", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        name, first = f"{uuid.uuid4().hex}.ids", []

        def documents():
            e = encoder(tokenizer_file)
            for b in batches:
                size = np.cumsum(pc.fill_null(pc.binary_length(b["text"]), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
                cuts = [0, *(np.flatnonzero(np.diff(size // TEXT)) + 1).tolist(), b.num_rows]
                for lo, hi in zip(cuts, cuts[1:], strict=False):
                    part = b.slice(lo, hi - lo)
                    for key, ids in zip(part["doc_id"].to_pylist(), e.encode(part["text"], end), strict=True):
                        if not first:
                            first.append(key)
                        yield key, ids

        with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
            n, ids = write_ids(out, documents())
        if n:
            yield pa.RecordBatch.from_pydict({"file": [name], "documents": [n], "ids": [ids], "first": first},
                                             pa.schema([("file", pa.string()), ("documents", pa.int64()),
                                                        ("ids", pa.int64()), ("first", pa.int64())]))

    files = stored(ranged.mapInArrow(run, schema), "id-files")
    before = Window.orderBy(F.col("first").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1)
    return stored(files.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0))), "id-file-starts")


def read_documents(files: DataFrame, path: str) -> DataFrame:
    """(doc_id, start, ids) of all documents of the listed files; ids are
    little-endian 32-bit integers in a binary column."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()),
                           T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pafs.FileSystem.from_uri(path)
        for b in batches:
            for name, start in zip(b["file"], b["start"], strict=True):
                with fs.open_input_file(f"{root}/{name}") as f:
                    keys, starts, out, held, at = [], [], [], 0, int(start)
                    for key, ids in read_ids(f, f.size()):
                        keys.append(key)
                        starts.append(at)
                        out.append(ids.astype("<u4").tobytes())
                        at += len(ids)
                        held += len(out[-1])
                        if held > 1 << 23:
                            yield pd.DataFrame({"doc_id": pd.array(keys, "Int64"), "start": starts, "ids": out})
                            keys, starts, out, held = [], [], [], 0
                    yield pd.DataFrame({"doc_id": pd.array(keys, "Int64"), "start": np.array(starts, np.int64), "ids": out})

    n = max(1, files.count())
    return files.select("file", "start").repartitionByRange(n, "file").mapInPandas(run, schema)


def op2_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "ids")
    files = write_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_documents(files, path).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
