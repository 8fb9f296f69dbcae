"""Operators on documents: odd rows, empty tables, brute force."""

import collections
import hashlib
import io
import math
import random
import re
import sys
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from commentlake.llm import (dart_minhash, id_files, mixing, quality_classifier, quality_rules, secret_scan,
                             sentencepiece_codec)
from commentlake.llm.common import Memo, stored
from commentlake.llm.graph import connected_components

from .conftest import odd_rows, words


def brute_classes(rows, size=5, threshold=0.8):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        if i is not None:
            sets[i] = {tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    comp = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b])) >= threshold:
                x, y = comp[a], comp[b]
                comp = {i: min(x, y) if c in (x, y) else c for i, c in comp.items()}
    return comp


def test_near_duplicates_brute_force(spark, odd):
    got = dart_minhash.near_duplicates(odd).collect()
    want = brute_classes(odd_rows())
    assert len(got) == len(odd_rows())
    assert all(r.class_id == (want[r.doc_id] if r.doc_id is not None else None) for r in got)


def test_chain_of_near_copies_is_one_class(spark):
    """Each text is near to the next only; one bucket may hold them all."""
    w, rows = words(5, 150), []
    for k in range(12):
        rows.append((500 - k, " ".join(w)))
        w = w[:k * 12] + [f"new{k}"] + w[k * 12 + 1:]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_classes(rows)
    assert {r.doc_id: r.class_id for r in dart_minhash.near_duplicates(df).collect()} == want


def test_weighted_signature_estimates_weighted_jaccard():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 400).astype(np.uint64)
    a, b = rng.gamma(1.0, 3.0, 400), rng.gamma(1.0, 3.0, 400)
    b[:300] = a[:300]
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    got = np.mean(dart_minhash.dart_signature(h, a, 4096) == dart_minhash.dart_signature(h, b, 4096))
    assert abs(got - want) < 5 * (want * (1 - want) / 4096) ** 0.5
    with pytest.raises(ValueError):
        dart_minhash.dart_signature(h[:1], np.zeros(1), 8)


def test_counted_weights(spark):
    rows = [(1, "a b c d e f " * 10), (2, "a b c d e f " * 30), (3, "a b c d e f " * 29)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in dart_minhash.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 1}
    got = {r.doc_id: r.class_id for r in dart_minhash.near_duplicates(df, weights="count").collect()}
    assert got == {1: 1, 2: 2, 3: 2}


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(60)] + [(1000, k) for k in range(900, 950)] + [(5, 5), (7, 6), (2000, 2001)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.id: r.comp for r in connected_components(df).collect()}
    assert got == {k: 0 for k in range(61)} | {k: 900 for k in [*range(900, 950), 1000]} | {2000: 2000, 2001: 2000}
    assert connected_components(df.limit(0)).count() == 0


def test_quality_rules(spark, odd, labels, none):
    rules = quality_rules.train(odd, labels)
    out = quality_rules.judge(odd, rules)
    assert out.count() == odd.count() and set(odd.columns) < set(out.columns)
    rows = {r.doc_id: r.quality_stats for r in out.collect()}
    assert rows[4].n_words == rows[5].n_words == rows[6].n_words == 0 and rows[4].base_failed and not rows[4].kept
    assert rows[11].n_repeat_words == 400 and not rows[11].kept and rows[100].kept
    assert quality_rules.train(none, labels) == [] and quality_rules.judge(none, []).count() == 0


def test_statistics_brute_force():
    for text in [t for _, t, *_ in odd_rows() if t is not None] + ["a a a a", "a b c\na b c\n\n x", "1 2 3 1 2"]:
        got = dict(zip(quality_rules.STATS, quality_rules.stats_of(text), strict=True))
        w = text.encode().split()
        win = collections.Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
        inside = {k + d for k in range(len(w) - 2) if win[tuple(w[k:k + 3])] > 1 for d in range(3)}
        lines = [x for x in text.split("\n") if x.encode().strip()]
        assert got["n_words"] == len(w) and got["n_repeat_words"] == len(inside)
        assert got["word_chars"] == sum(len(x.decode()) for x in w)
        assert got["n_dup_lines"] == len(lines) - len(set(lines))
        assert got["n_symbols"] == sum(c in "#*$%&|<>" for c in text)


def test_learned_list_is_ordered_and_pruned():
    rng = np.random.default_rng(3)
    x = {"a": rng.random(3000), "b": rng.random(3000)}
    bad = (x["a"] > 0.8) | ((x["b"] < 0.2) & (x["a"] < 0.3))
    rules = quality_rules.learn(x, bad)
    hit = np.zeros(3000, bool)
    for r in rules:
        hit |= quality_rules.covered(r, x, 3000)
    assert (hit == bad).mean() > 0.97 and len(rules) <= 6
    assert quality_rules.learn(x, np.zeros(3000, bool)) == []


def test_classifier(spark, odd, labels, none):
    w = quality_classifier.train(odd, labels)
    got = {r.doc_id: r.score for r in quality_classifier.score(odd, w).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and got[4] == got[5] == got[6]
    assert got[13] < got[100]
    w0 = quality_classifier.train(none, labels)
    assert quality_classifier.score_of("any text", w0) == 0.5
    assert quality_classifier.score(none, w0).count() == 0


def test_classifier_held_out_accuracy(spark):
    out = quality_classifier.op3_quality_classifier(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = out.filter("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_secrets(spark, odd, none):
    scanner, found = secret_scan.fit(odd)
    hits = [r for r in secret_scan.scored(scanner, found).collect() if r.score >= 0.5]
    assert [(r.doc_id, r.secret) for r in hits] == [(10, "24be64439e3e49cf46b2d7c90f3602a3d0b907ff")]
    clean = {(r.doc_id, r.text) for r in secret_scan.redact(odd, scanner).collect()}
    before = {(r.doc_id, r.text) for r in odd.collect()}
    assert len(clean - before) == 1 and '"[SECRET]"' in next(iter(clean - before))[1]
    scanner, found = secret_scan.fit(none)
    assert found.count() == 0 and secret_scan.redact(none, scanner).count() == 0


def test_forest_expression_is_the_forest(spark):
    """The conditional expression votes like the trees that Spark describes."""
    text = ("RandomForestClassificationModel\n  Tree 0 (weight 1.0):\n    If (feature 0 <= 20.5)\n     Predict: 0.0\n"
            "    Else (feature 0 > 20.5)\n     If (feature 1 <= 0.5)\n      Predict: 0.0\n     Else (feature 1 > 0.5)\n"
            "      Predict: 1.0\n  Tree 1 (weight 1.0):\n    Predict: 1.0\n")
    trees = secret_scan.parse_trees(text)
    assert trees == ((0, 20.5, 0.0, (1, 0.5, 0.0, 1.0)), 1.0)
    c = {f: F.lit(40.0 if f == "length" else 0.6) for f in secret_scan.FEATURES} | {"label": F.lit(None)}
    df = spark.range(1).select(secret_scan.Scanner(" ", trees).score(c).alias("s"))
    assert df.first().s == 1.0


def test_mixing(spark, odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r.taken <= 3 * r["size"] for r in rows)
    total = sum(r["size"] for r in rows)
    targets = {r.source: (r.target, r.source_size) for r in rows}
    assert abs(sum(t for t, _ in targets.values()) - min(total, 3 * total)) < 1e-6 * total
    assert all(t <= 3 * s + 1e-6 for t, s in targets.values())
    assert rows and sorted(map(str, mixing.mix(odd).collect())) == sorted(map(str, rows))
    assert mixing.mix(none).count() == 0 and mixing.stage(spark, none, "").count() == 0
    staged = collections.Counter((r.doc_id, r.text) for r in mixing.stage(spark, odd, "").collect())
    texts = {(i, t) for i, t, *_ in odd_rows()}
    assert set(staged) <= texts


def test_mixing_caps_small_sources(spark):
    rows = [(k, "w " * 10, "a" if k < 90 else "b" if k < 95 else None) for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.source: (r.target, r.source_size) for r in mixing.mix(df).collect()}
    assert got == {"a": (700.0, 900), "b": (150.0, 50), None: (150.0, 50)}
    taken = collections.Counter()
    for r in mixing.mix(df).collect():
        taken[r.source] += r.taken
    assert taken == {"a": 700, "b": 150, None: 150}


def test_sentencepiece(spark, odd, none):
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    for r in sentencepiece_codec.coded(odd).collect():
        ids = sp.encode(r.text or "", add_bos=True, add_eos=True)
        assert np.frombuffer(bytes(r.coded.ids), "<u4").tolist() == ids and r.coded.n_tokens == len(ids)
        assert r.coded.decoded == sp.decode(ids)
    assert sentencepiece_codec.coded(none).count() == 0


def test_sentencepiece_random_strings():
    import random
    e = sentencepiece_codec.encoder(sentencepiece_codec.default_model())
    rng, pieces = random.Random(11), None
    pieces = list(e.ids)
    alphabet = "aaabbe ▁ \n\t1290.,()éßñ中文字漢😀́the ing in on\x00　ﬁ"
    for k in range(1500):
        s = "".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) if k % 2 else \
            "".join(rng.choice(pieces) for _ in range(rng.randrange(12))).replace("▁", " ")
        assert np.frombuffer(e.encode(s), "<u4").tolist()[1:-1] == e.library.encode(s), s


def test_id_files(spark, odd, none, tmp_path):
    file = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(file)
    files = id_files.write_documents(odd, f"file://{tmp_path}/ids", file)
    rows = id_files.read_documents(files, f"file://{tmp_path}/ids").collect()
    want = sorted(((i if i is not None else -1), bytes(np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4")))
                  for i, x, *_ in odd_rows())
    assert sorted((r.doc_id if r.doc_id is not None else -1, bytes(r.ids)) for r in rows) == want
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += len(r.ids) // 4
    assert [r.doc_id or -1 for r in sorted(rows, key=lambda r: r.start)] == sorted(r.doc_id or -1 for r in rows)
    files = id_files.write_documents(none, f"file://{tmp_path}/none", file)
    assert id_files.read_documents(files, f"file://{tmp_path}/none").count() == 0


def test_ids_of_random_strings_are_the_librarys():
    """Characters that lower to several, combining marks, joiners, odd white space,
    added tokens, long words; a file of other rules gets whole texts."""
    rng = np.random.default_rng(7)
    parts = ["İ", "ß", "ﬁ", "ǅ", "\u0307", "\u0301", "\u200d", "\u200c", "\u00a0", "\u2003", "\x85", "\x1c", "a", "Z", "é",
             "TÜRKİ", ".", ",", "'s", "'", " ", "  ", "\n", "\t", "3", "²", "中", "한", "\u1100\u1161", "😀", "_", "-", "<|endoftext|>",
             "<|", "Ⅷ", "ⓐ", "ª", "x" * 70, "Σ", "ς"]
    texts = ["TÜRKİ.", "MİLLETLERİ.", "hello İ. x"]
    texts += ["".join(rng.choice(parts, rng.integers(1, 9))) for _ in range(40_000)]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        file = public_tokenizers.path(name)
        e, library = id_files.Encoder(file, limit=1 << 18), Tokenizer.from_file(file)
        assert e.wordwise == (name == "word_bpe_49k.json")
        want = library.encode_batch(texts, add_special_tokens=False)
        for lo in range(0, len(texts), 1000):
            got = [np.frombuffer(b, "<u4").tolist() for b in e.encode(texts[lo:lo + 1000], 1)]
            assert got == [[*w.ids, 1] for w in want[lo:lo + 1000]]
        assert all(len(w) <= e.longest for w in e.known)


def test_id_blocks_round_trip_and_damage():
    rng = np.random.default_rng(1)
    for a in (np.zeros(1, np.uint32), np.arange(5, dtype=np.uint32), np.full(20_000, 7, np.uint32),
              rng.integers(0, 2**32, 9000, dtype=np.uint32), (rng.geometric(0.1, 30_000) % 50).astype(np.uint32)):
        g = id_files.encode_group(a)
        back, n = id_files.decode_group(memoryview(g))
        assert (back == a).all() and n == len(g)
    assert len(g) < 30_000                                   # 32 bits an id become less than 8
    broken = bytearray(g)
    broken[-3] ^= 1
    with pytest.raises(ValueError):
        id_files.decode_group(memoryview(bytes(broken)))


def test_single_blocks_and_damaged_files():
    rng = np.random.default_rng(4)
    docs = [(k if k % 5 else None, (rng.geometric(0.05, rng.integers(0, 9000)) % 900).astype("<u4")) for k in range(40)]
    out = io.BytesIO()
    id_files.write_ids(out, ((k, a.tobytes()) for k, a in docs))
    data = out.getvalue()
    every = np.concatenate([a for _, a in docs])
    file = id_files.IdFile(io.BytesIO(data), len(data))
    blocks = -(-len(every) // id_files.BLOCK)
    for k in (0, 3, blocks - 1):
        assert (file.read_block(0, k) == every[k * id_files.BLOCK:(k + 1) * id_files.BLOCK]).all()
    back = list(id_files.read_ids(io.BytesIO(data), len(data)))
    assert [k for k, _ in back] == [k for k, _ in docs] and all((a == b).all() for (_, a), (_, b) in zip(back, docs, strict=True))
    head = id_files.Head.of(memoryview(data)[file.groups[0][0]:])
    at = file.groups[0][0] + head.place(2)[0] + 5
    broken = data[:at] + bytes([data[at] ^ 1]) + data[at + 1:]
    with pytest.raises(id_files.Damage):
        list(id_files.read_ids(io.BytesIO(broken), len(broken)))
    damaged = []
    back = list(id_files.read_ids(io.BytesIO(broken), len(broken), damaged))
    assert damaged == [(0, 2)]
    ends = np.cumsum([len(a) for _, a in docs])
    for (_, got), (_, a), end in zip(back, docs, ends, strict=True):
        touched = len(a) and end > 2 * id_files.BLOCK and end - len(a) < 3 * id_files.BLOCK
        assert (got is None) == bool(touched) and (touched or (got == a).all())
    with pytest.raises(id_files.Damage):
        id_files.IdFile(io.BytesIO(broken), len(broken)).read_block(0, 2)
    assert (id_files.IdFile(io.BytesIO(broken), len(broken)).read_block(0, 1) == every[id_files.BLOCK:2 * id_files.BLOCK]).all()
    at = file.groups[0][0] + 8                                # the number of symbols: the group is lost, nothing else
    broken = data[:at] + b"\xff\xff\xff\x7f" + data[at + 4:]
    damaged = []
    assert all(a is None or not len(a) for _, a in id_files.read_ids(io.BytesIO(broken), len(broken), damaged)) and len(damaged) == blocks


def test_id_groups_of_wide_alphabets():
    """49,000 kinds of ids do not make a group smaller; above KINDS it is cut and nothing is lost."""
    rng = np.random.default_rng(5)
    assert id_files.lanes_for(np.arange(49_000, dtype=np.uint32)) == id_files.LANES
    wide = (rng.permutation(49_000)[np.minimum(rng.geometric(2e-4, 20 * id_files.BLOCK), 48_999)] + 3).astype(np.uint32)
    g = id_files.encode_group(wide)
    assert (id_files.decode_group(memoryview(g))[0] == wide).all()
    f = id_files.Head.of(memoryview(g)).frequencies
    assert f.sum() == 1 << id_files.FREQ and f.min() >= 1
    with pytest.raises(ValueError):
        id_files.encode_group(np.arange(id_files.KINDS + 1, dtype=np.uint32))
    every = np.arange(id_files.KINDS + 9, dtype="<u4")
    out = io.BytesIO()
    id_files.write_ids(out, iter([(1, every[:50].tobytes()), (2, every[50:].tobytes())]))
    back = list(id_files.read_ids(io.BytesIO(out.getvalue()), out.tell()))
    assert len(id_files.IdFile(io.BytesIO(out.getvalue()), out.tell()).groups) == 2
    assert [k for k, _ in back] == [1, 2] and (np.concatenate([a for _, a in back]) == every).all()
    broken = bytearray(g)                                    # order 0's frequencies are part of the head
    broken[16 + 4 * len(f)] ^= 1
    with pytest.raises(ValueError):
        id_files.decode_group(memoryview(bytes(broken)))


def test_words_of_one_stem_share_its_ids():
    file = public_tokenizers.path("word_bpe_49k.json")
    e, library = id_files.Encoder(file), Tokenizer.from_file(file)
    texts = ["thing Thing! THING??? thing*** (thing) thing's thing'", None, "", "  Éan éan, éan$$$\n\x1céan ñandú|| ÿ× ×y ß÷ ÷",
             "word word.<|endoftext|> <|endoftext|>word <|endoftext|>... word<| |>", "a'll a'll' we'd'ss x" + "y" * 100 + "!!"]
    want = [[*library.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    column = pa.array(["", *texts, "x"], pa.string()).slice(1, len(texts))
    for given in (texts, column, column):
        assert [np.frombuffer(b, "<u4").tolist() for b in e.encode(given, 1)] == want
    assert {"thing", "!", "???", "***"} <= {*e.known} and not {*e.known} & {"Thing", "thing!", "Thing!", "thing***"}
    assert len({*e.known}) == len(e.known) and max(map(len, e.known)) <= e.longest
    assert e.encode([], 1) == []


def test_memo_is_bounded():
    memo = Memo(len, 10 * Memo.ENTRY)
    assert [memo["x" * (k % 17)] for k in range(500)] == [k % 17 for k in range(500)]
    assert len(memo) + len(memo.older) <= 20
    memo = Memo(str.encode, 1 << 20)
    for k in range(10_000):                                  # long keys are never kept
        assert len(memo[f"{k:010000d}"]) == 10_000
        assert len(memo[f"{k:020d}"]) == 20
    kept = [x for d in (memo, memo.older) for kv in d.items() for x in kv]
    assert sum(map(sys.getsizeof, kept)) + sys.getsizeof(memo) + sys.getsizeof(memo.older) < 2 << 20
    memo.drop()
    assert not memo and not memo.older


def test_pipeline_stages(spark, labels, tmp_path):
    import corpus_pipeline
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen, before = [], docs
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, before, d), name)
        seen.append(after)
        if name != "sentencepiece":
            assert after.columns == docs.columns
        before = after
    rules, dedup, secrets, mixed, last = seen
    ids = lambda df: [r.doc_id for r in df.select("doc_id").collect()]
    rows = [(r.doc_id, r.text) for r in rules.collect()]
    assert sorted(ids(dedup)) == sorted({c for c in brute_classes(rows).values()})
    assert sorted(ids(secrets)) == sorted(ids(dedup)) and set(ids(mixed)) <= set(ids(secrets))
    assert not secrets.filter("text rlike 'token = .[0-9a-f]{40}'").count()
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    want = sorted((r.doc_id, hashlib.sha256(np.array(sp.encode(r.text, add_bos=True, add_eos=True), "<u4").tobytes()).hexdigest())
                  for r in mixed.collect())
    assert sorted((r.doc_id, r.ids_sha256) for r in last.collect()) == want


def test_assigned_secrets_are_no_negative_rows(spark):
    """The credential is looked at before the path and address shapes."""
    key = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"
    rows = {"aws_secret_access_key = " + key: 1, f'"secret":"{key}"': 1, "postgres://app:Zx81kQ0pLm44TtRw9@db.host/x": 1,
            "https://a.example/x?token=Zx81kQ0pLm44TtRw9": 1, "api_key = 123e4567-e89b-12d3-a456-426614174000": None,
            "secret = abcdefGHIJKLMNOPqr": None, "token_path = /usr/local/lib9/tokens/x1": None,
            "see /usr/local/lib9/thing/x1 there": 0, "http://host:8080/abc/def0123456789": 0,
            "id 123e4567-e89b-12d3-a456-426614174000": 0, "https://a.example/Zx81kQ0pLm44TtRw9": 0}
    df = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "doc_id long, text string")
    got = secret_scan.described(secret_scan.findings(df), " ").collect()
    assert {(r.doc_id, r.label) for r in got} == {(k, v) for k, v in enumerate(rows.values())}
    assert all(r.f["format"] == 0 for r in got) and [r.doc_id for r in got if r.f.password] == [2]


def test_masks_cover_whole_candidates_only(spark):
    """A key, the same with a suffix, and a clean word that holds it."""
    key = "Zx81kQ0pLm44TtRw9"
    text = f"token = {key} secret = {key}Tail77 and x-{key}-y password={key}=="
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = secret_scan.redact(df, secret_scan.Scanner(" ", ())).first().text
    assert got == f"token = [SECRET] secret = [SECRET] and x-{key}-y password=[SECRET]"


def test_dictionary_counts_all_documents(spark):
    df = spark.createDataFrame([(9000 + k, "sanat harvinaiset") for k in range(3)], "doc_id long, text string")
    assert secret_scan.fit(df)[0].dictionary == " harvinaiset sanat "


def test_dictionary_keeps_whole_classes_of_counts(spark, monkeypatch):
    monkeypatch.setattr(secret_scan, "DICTIONARY_WORDS", 3)
    texts = ["alpha beta gamma"] * 6 + ["delta gamma"] * 5 + ["epsilon zeta"] * 2 + ["once"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert secret_scan.dictionary_of(df) == " alpha beta gamma "
    monkeypatch.setattr(secret_scan, "DICTIONARY_WORDS", 2)
    assert secret_scan.dictionary_of(df) == " gamma "


def labelled_findings():
    """Random keys and what looks like them: identifiers, versions, paths, digests of files."""
    rng = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    nouns = "request handler client server stream buffer config token parser session worker thread".split()
    rows = []
    for k in range(900):
        if k % 2:
            value, label = "".join(rng.choices(letters, k=rng.randint(20, 40))), 1
        else:
            value = "".join(w.title() for w in rng.choices(nouns, k=4)) + str(rng.randint(0, 99))
            value, label = rng.choice([value, "/".join(["lib", *rng.choices(nouns, k=3)]) + str(rng.randint(1, 9))]), 0
        rows.append((k, f"see the {rng.choice(nouns)} {rng.choice(['key', 'in', 'at'])} {value} now", label))
    return rows


def test_forest_of_labelled_findings_on_held_out_ones(spark):
    rows = labelled_findings()
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    truth = df.select("doc_id", F.lit(0).alias("nth"), "label")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    scanner, found = secret_scan.fit(df, truth.filter(~fold))
    assert not scanner.shapes and len(scanner.trees) == secret_scan.TREES
    q = secret_scan.quality(scanner, found, truth.filter(fold)).first()
    assert q.n > 100 and q.precision >= 0.95 and q.recall >= 0.95
    alone, _ = secret_scan.fit(df)                             # without labels, shapes and the rest of the features
    assert not set(alone.features) & set(secret_scan.SHAPED)


def test_candidates_and_features_by_plain_python(spark):
    rows = labelled_findings()[:120] + [(5000, None, 0), (5001, "", 0), (5002, "a+b/C0_-" * 5 + "==", 0), (5003, "é" * 30 + "A1" * 20, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    got = [(r.doc_id, r.nth, r.secret, r.f) for r in secret_scan.described(secret_scan.findings(df), " request handler see ").collect()]
    want = []
    for doc_id, text, _ in rows:
        chars = "A-Za-z0-9_+/\\-"
        cores = []
        for run in re.findall(f"(?<![{chars}])[{chars}]{{16,}}={{0,2}}", " ".join(re.split(r"[\x20\x09-\x0D]+", text or ""))):
            body = run.rstrip("=")
            if re.search("[0-9]", body) or re.search("[A-Z]", body[1:]):
                cores.append(run)
        want += [(doc_id, k, c) for k, c in enumerate(cores)]
    assert sorted((d, n, c) for d, n, c, _ in got) == sorted(want)
    for _, _, c, f in got:
        n = len(c)
        kind = re.sub("[0-9]", "0", re.sub("[A-Z]", "A", re.sub("[a-z]", "a", c)))
        runs = re.findall("[A-Z]?[a-z]{3,}|[A-Z]{4,}", c)
        expect = {"length": n, "digits": sum(x in "0123456789" for x in c) / n, "uppers": len(re.findall("[A-Z]", c)) / n,
                  "lowers": len(re.findall("[a-z]", c)) / n, "others": len(re.findall("[^A-Za-z0-9]", c)) / n,
                  "transitions": sum(a != b and a in "aA0" for a, b in zip(kind, kind[1:], strict=False)) / n,
                  "repeats": sum(a == b for a, b in zip(c, c[1:], strict=False)) / n, "distinct": len(set(c)) / n,
                  "hex": float(bool(re.fullmatch("[0-9a-f]+|[0-9A-F]+", c))), "vowels": len(re.findall("[aeiouAEIOU]", c)) / n,
                  "dictionary": sum(len(r) for r in runs if r.lower() in ("request", "handler", "see")) / n, "slashes": c.count("/")}
        assert all(abs(f[k] - v) < 1e-12 for k, v in expect.items()), c


def test_first_by_hash_is_the_head_of_the_whole_order(spark):
    from commentlake.llm.common import first_by_hash
    df = spark.range(5000).select(F.col("id").alias("k"))
    want = [r.k for r in df.orderBy(F.xxhash64("k"), "k").limit(40).collect()]
    assert [r.k for r in first_by_hash(df, ["k"], 40).collect()] == want
    assert first_by_hash(df.limit(0), ["k"], 40).count() == 0


def test_ftrl_by_plain_python():
    """The vectorised trainer against follow-the-regularised-leader written out."""
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 16, 5)) for _ in range(60)]
    rows = [(i, rng.random(len(i)) + 0.1) for i in rows]
    y = np.array([float((i < 8).sum() > (i >= 8).sum()) for i, _ in rows])
    alpha, beta, l1, l2 = 0.7, 0.05, 1.0, 0.02
    z, n, w = [0.0] * 17, [0.0] * 17, [0.0] * 17

    def weight(k):
        if abs(z[k]) <= l1:
            return 0.0
        return -(z[k] - math.copysign(l1, z[k])) / ((beta + math.sqrt(n[k])) / alpha + l2)

    for _ in range(3):
        for (index, value), label in zip(rows, y, strict=True):
            x = {**dict(zip(index.tolist(), value.tolist(), strict=True)), 16: 1.0}
            w = {k: weight(k) for k in x}
            p = 1 / (1 + math.exp(-sum(w[k] * x[k] for k in x)))
            for k, v in x.items():
                g = (p - label) * v
                sigma = (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / alpha
                z[k] += g - sigma * w[k]
                n[k] += g * g
    got = quality_classifier.train_ftrl(rows, y, 4, 3, alpha, beta, l1, l2)
    assert np.allclose(got, [weight(k) for k in range(17)], atol=1e-6) and (got == 0).any() and (got != 0).any()


def test_stages_on_odd_and_empty_rows(spark, odd, none):
    """Nulls, repeated ids, extra columns: filters keep columns and rows they do not judge."""
    d = "/root/testdata/sf0.001"
    before = sorted(map(repr, odd.collect()))
    for module in (quality_rules, dart_minhash, secret_scan, mixing):
        out = module.stage(spark, odd, d)
        assert out.columns == odd.columns
        assert module.stage(spark, none, d).count() == 0
        kept = sorted(map(repr, out.collect()))
        if module not in (secret_scan, mixing):                # these change texts and numbers of copies
            assert not collections.Counter(kept) - collections.Counter(before)
        if module is dart_minhash:                             # one of each class, one of each repeated id, all without id
            ids = [r.doc_id for r in out.collect()]
            assert None in ids and ids.count(9) == 1 and {1, 4, 5, 6, 7} <= set(ids) and not {2, 3} & set(ids)
    last = sentencepiece_codec.stage(spark, odd, d)
    assert last.count() == odd.count() and {"n_tokens", "ids_sha256", "decoded_sha256", "Key", "size"} <= set(last.columns)
    assert sentencepiece_codec.stage(spark, none, d).count() == 0


def test_near_duplicates_of_no_rows_and_below_the_threshold(spark, none):
    assert dart_minhash.near_duplicates(none).count() == 0
    base, rows = words(40, 120), []
    for k in range(24):                                        # half of them below 0.8 to all others
        own = list(base)
        for j in range(1 if k % 2 else 4):
            own[(k * 5 + j * 25) % 120] = f"new{k}x{j}"
        rows.append((k, " ".join(own)))
    got = {r.doc_id: r.class_id for r in dart_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows) and 1 < len(set(got.values())) < 24


def test_bit_maps_bound_the_differences(spark):
    rng = np.random.default_rng(3)
    sets = [rng.choice(1 << 62, n, replace=False) for n in (1, 60, 65, 900, 1100, 5000)]
    rows = [(k, s.tolist()) for k, s in enumerate(sets)] + [(9, sets[3][:850].tolist() + sets[4][:250].tolist())]
    rows += [(7, [1, 2]), (7, [1, 3])]                             # a doc_id of two texts
    maps = dart_minhash.bit_maps(spark.createDataFrame(rows, "doc_id long, sh array<long>"))
    both = maps.toDF("x", "bx").crossJoin(maps.toDF("y", "by"))
    got = {(r.x, r.y): r.d for r in both.select("x", "y", dart_minhash._differences("bx", "by").alias("d")).collect()}
    sets = {k: set(s) for k, s in rows}
    assert got[7, 1] is None or got[7, 1] == 0
    for (x, y), d in got.items():
        assert 7 in (x, y) or d <= len(sets[x] ^ sets[y])
    assert got[3, 9] > 250 and got[1, 2] > 100 and got[9, 9] == 0


def test_texts_alike_below_the_threshold_make_few_pairs(spark, monkeypatch):
    """Copies of one text with three other words each: alike to 0.67, in the same buckets."""
    rng, base, made = np.random.default_rng(11), words(77, 150), []
    rows = []
    for k in range(160):
        own = list(base)
        for j, at in enumerate(rng.choice(30, 1 if k % 40 == 0 else 3, replace=False)):
            own[int(at) * 5 + 2] = f"new{k}x{j}"
        rows.append((k, " ".join(own)))
    similar = dart_minhash._similar
    monkeypatch.setattr(dart_minhash, "_similar", lambda pairs, *a: made.append(pairs.count()) or similar(pairs, *a))
    got = {r.doc_id: r.class_id for r in dart_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows) and sum(made[1:]) < 4 * len(rows)
