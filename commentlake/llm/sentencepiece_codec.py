"""SentencePiece (merge type) encoding by backtracking, and decoding.

An Aho-Corasick automaton over the pieces finds every piece that starts at each
position.  The encoder takes the longest, if it stands beside the token before
it, which is tested by merging the two again: the merge rules must leave just
these two.  Where no piece fits, the position is marked in a bitfield of failed
positions, the last token is taken back and the next shorter one is tried.  As
a list of tokens is the merge result if and only if all neighbours are
compatible, this gives the library's ids without a merge queue.

No piece has a space mark behind another character, and some characters never
stand side by side in a piece, so merges never cross these points: texts are
parted there and bounded memos keep what each part becomes.

Ids are kept as little-endian unsigned 32-bit integers in a binary column.
Defined results: a null text is the empty text, which has begin and end id
only; repeated rows get equal ids; an empty table gives no rows; other columns pass
through untouched, but one that has the name of the result (``out``) is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pandas as pd
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, fresh, table

SPACE = "▁"
#: Texts whose results a worker gives back at once.
ROWS = 256
#: Numbers of characters that are no piece begin here; NOTHING: no token.
UNKNOWN, NOTHING = 1 << 24, (1 << 32) - 1


class BacktrackingEncoder:
    def __init__(self, model_file: str):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        plain = [i for i in range(sp.get_piece_size())
                 if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.scores = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.begin, self.end = sp.bos_id(), sp.eos_id()
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids):
            raise ValueError("pieces with an inner space mark are not supported")
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        alone = "".join(map(re.escape, (c for c in map(chr, range(128)) if c not in joined)))
        part = rf"{SPACE}+[^{SPACE}{alone}]*|[{alone}]|[^{SPACE}{alone}]+" if alone else rf"{SPACE}+[^{SPACE}]*|[^{SPACE}]+"
        self.parts = re.compile(part).findall
        self.codes = [i.to_bytes(4, "little") for i in range(sp.get_piece_size())]
        self.compatible = Memo(self._compatible, 64 << 20)
        self.inner = {a + b for p in self.ids for a, b in zip(p, p[1:], strict=False)}
        self.coded = Memo(self._coded, 64 << 20)

    def merge(self, s: str) -> list[str]:
        """The merge rules on a short string: best score first, leftmost first."""
        out, scores = list(s), self.scores
        while True:
            best, at = None, -1
            for k in range(len(out) - 1):
                score = scores.get(out[k] + out[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                return out
            out[at:at + 2] = [out[at] + out[at + 1]]

    def _piece(self, i: int) -> str:
        return chr(i - UNKNOWN) if i >= UNKNOWN else self.library.id_to_piece(i)

    def _compatible(self, pair: int) -> bool:
        """Whether the merge rules leave two tokens (of numbers pair >> 32, if
        that is not NOTHING, and pair & 0xFFFFFFFF) beside each other as they are."""
        tokens = [self._piece(i) for i in (pair >> 32, pair & 0xFFFFFFFF) if i != NOTHING]
        return self.merge("".join(tokens)) == tokens

    def tokens(self, s: str) -> list[int]:
        """Numbers of the tokens of a part; UNKNOWN + code point for a character
        that is no piece."""
        n = len(s)
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n)]    # (length, number), ascending
        for end, found in self.automaton.iter(s):
            starts[end - found[0] + 1].append(found)
        for k, here in enumerate(starts):
            if not here or here[0][0] != 1:
                here.insert(0, (1, UNKNOWN + ord(s[k])))        # a character is a symbol, piece or not
        open_ = bytearray(b"\x01") * (n + 1)                    # 0: no tokens lead on from here
        done: list[int] = []
        taken: list[tuple[int, int]] = []                       # where a token begins, which choice it is
        compatible, pos, last, turn = self.compatible, 0, NOTHING << 32, len(starts[0]) - 1
        while pos < n:
            here = starts[pos]
            while turn >= 0:
                length, i = here[turn]
                if open_[pos + length] and compatible[last | i]:
                    break
                turn -= 1
            if turn >= 0:
                done.append(i)
                taken.append((pos, turn))
                pos += length
                last = i << 32
                turn = len(starts[pos]) - 1 if pos < n else 0
            else:
                open_[pos] = 0                                  # the token that ends here must be shorter
                done.pop()
                pos, turn = taken.pop()
                last = done[-1] << 32 if done else NOTHING << 32
        return done

    def _coded(self, part: str) -> bytes:
        """Codes of a part, parted again where no piece has the two characters
        beside each other: no merge crosses such a point either."""
        inner, out, at = self.inner, [], 0
        for k in range(1, len(part)):
            if part[k - 1:k + 1] not in inner:
                out.append(self.coded[part[at:k]])
                at = k
        if not at:
            return self._uncut(part)
        return b"".join(out) + self.coded[part[at:]]

    def _uncut(self, s: str) -> bytes:
        out = []
        for i in self.tokens(s):
            if i < UNKNOWN:
                out.append(self.codes[i])
            else:
                out += [self.codes[self.bytes[b]] for b in chr(i - UNKNOWN).encode()]
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        if not text:
            body = b""
        else:
            body = b"".join(map(self.coded.__getitem__, self.parts(SPACE + text.replace(" ", SPACE))))
        return self.begin.to_bytes(4, "little") + body + self.end.to_bytes(4, "little")

    def decode(self, ids: bytes) -> str:
        return self.library.decode(np.frombuffer(ids, "<u4").tolist())


@cache
def encoder(model_file: str) -> BacktrackingEncoder:
    """One encoder a worker and model file."""
    return BacktrackingEncoder(model_file)


def default_model() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


CODED = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()),
                      T.StructField("decoded", T.StringType())])


def coded(df: DataFrame, model_file: str | None = None, out: str = "coded", text: str = "text") -> DataFrame:
    """``df`` with a struct column: n_tokens, ids (with begin and end) and the
    text that the library decodes from them."""
    file = model_file or default_model()

    @F.pandas_udf(CODED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        e = encoder(file)
        for batch in batches:
            for lo in range(0, len(batch), ROWS):
                ids = [e.encode(t) for t in batch[lo:lo + ROWS]]
                yield pd.DataFrame({"n_tokens": np.fromiter(map(len, ids), np.int64, len(ids)) // 4, "ids": ids,
                                    "decoded": [e.decode(i) for i in ids]})

    return df.withColumn(out, run(F.col(text)))


def _digests(df: DataFrame, keep: list[str]) -> DataFrame:
    c = fresh("_coded", df.columns)
    return coded(df, out=c).select(*keep, F.col(c)["n_tokens"].alias("n_tokens"),
                                   F.sha2(F.col(c)["ids"], 256).alias("ids_sha256"),
                                   F.sha2(F.col(c)["decoded"].cast("binary"), 256).alias("decoded_sha256"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digests(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: ids and decoded texts of each document as digests."""
    return _digests(docs, [c for c in docs.columns if c.lower() not in
                           ("text", "n_tokens", "ids_sha256", "decoded_sha256")])
