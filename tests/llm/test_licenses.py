"""License scan against plain Python: every block, every template."""

import math
import random
import re

from commentlake.llm import license_scan as ls

from .conftest import odd_rows, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall((text or "").translate(str.maketrans(ls.UPPER, ls.LOWER)))


def plain(text, templates=ls.TEMPLATES, threshold=ls.THRESHOLD):
    w = split(text)
    at = [(i, label) for p, label in ls.PHRASES for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    met = []
    for b in range(math.ceil(len(w) / ls.STRIDE)):
        block = set(w[b * ls.STRIDE:b * ls.STRIDE + ls.BLOCK])
        for label, t in templates:
            t = set(t.split())
            if len(block & t) >= math.ceil(len(t) * threshold - 1e-9):
                met.append((b, label, len(block & t) / len(t)))
    base = {label for _, label in at}
    return (len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None),
            ",".join(sorted(base)), ",".join(sorted(base | {m[1] for m in met})),
            1.0 if at else max((m[2] for m in met), default=0.0), len({m[0] for m in met}))


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def texts():
    rng = random.Random(3)
    out = ["Released under the MIT\nLicense.", "CC BY, cc-by; CC  BY-SA", "All rights\n reserved. ALL RIGHTS RESERVED",
           "general public license " * 3, "this wor\u212A is İ GENERAL PUBLIC license \u212A", "Ünter GNU — licensed under the GNU General Public License, version 3. 中文 😀"]
    for k in range(60):
        _, t = rng.choice(ls.TEMPLATES)
        t = t.split()
        for _ in range(rng.randint(0, 3)):                   # a few words lost, in any order, or parted
            t.pop(rng.randrange(len(t)))
        if k % 3 == 0:
            rng.shuffle(t)
        gap = words(k, rng.choice([0, 1, 30, 60]))
        cut = rng.randrange(len(t) + 1)
        out.append(" ".join(words(k + 100, rng.randint(0, 90)) + t[:cut] + gap + t[cut:] + words(k, 50)))
    return out


def test_join_finds_every_block(spark):
    rows = [(k, t) for k, t in enumerate(texts())]
    got = found(ls.license_labels(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == sorted(((k, *plain(t)) for k, t in rows), key=repr)
    assert sum(r[8] > 0 for r in got) > 20


def test_threshold_and_templates_are_arguments(spark):
    rows = [(k, t) for k, t in enumerate(texts())]
    some = (("one", "licensed"), ("two", "public license of the gnu foundation"))
    got = found(ls.license_labels(spark.createDataFrame(rows, "doc_id long, text string"), templates=some, threshold=0.5))
    assert got == sorted(((k, *plain(t, some, 0.5)) for k, t in rows), key=repr)


def test_odd_rows_and_empty_table(odd, none):
    assert found(ls.license_labels(odd)) == sorted(((r[0], *plain(r[1])) for r in odd_rows()), key=repr)
    assert ls.license_labels(none).count() == 0


def test_no_python_in_the_plan(spark, odd):
    facts, blocks = ls.scan(odd)
    for df in (ls.license_labels(odd), facts, blocks):
        plan = df._jdf.queryExecution().toString()
        assert not re.search("EvalPython|Pandas|MapInArrow|CartesianProduct", plan)
