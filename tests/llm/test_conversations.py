"""Conversation repair: every edit sequence tried, odd rows, whole query by plain Python."""

import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

from commentlake.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string, digest string, Cost long"


@lru_cache
def ways(codes):
    """Every (cost, audit, roles) with at most two turns inserted in a place."""
    inserts = [p for n in range(3) for p in itertools.product("ua", repeat=n)]
    if not codes:
        return [(2 * len(p), "I" * len(p), "".join(p)) for p in inserts]
    code, out = codes[0], []
    edits = [(3, "D", "")]
    if code != "-":
        more = code.isupper()
        edits += [(more, "K", code.lower()), (2 + more, "R", "u"), (2 + more, "R", "a")]
    for p in inserts:
        for c, e, r in edits:
            for c2, e2, r2 in ways(codes[1:]):
                out.append((2 * len(p) + c + c2, "I" * len(p) + e + e2, "".join(p) + r + r2))
    return out


def test_cheapest_is_the_least_of_all_edit_sequences():
    cases = [c for n in range(3) for c in itertools.product("-suaxSUAX", repeat=n)]
    cases += [random.Random(k).choices("-suaxSUAX", k=3) for k in range(25)]
    for codes in map("".join, cases):
        want = min((c, a) for c, a, roles in ways(codes) if re.fullmatch("(s?(ua)+)?", roles))
        assert cr.cheapest(codes) == want, codes


def plain(codes):
    """(cost, audit, roles) by a table of tuples, for longer conversations."""
    after = {"": "", "s": "s", "u": "u", "a": "a"}
    ok = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}

    @lru_cache(None)
    def best(at, last, open_):
        out = []
        if at == len(codes) and last in ("", "a"):
            out.append((0, "", ""))
        if open_:
            out += [(c + 2, "I" + a, r + rest) for r in "ua" if (last, r) in ok
                    for c, a, rest in [best(at, after[r], open_ - 1)]]
        if at < len(codes):
            code = codes[at]
            out += [(c + 3, "D" + a, rest) for c, a, rest in [best(at + 1, last, 2)]]
            if code != "-":
                for r, cost, letter in ((code.lower(), 0, "K"), ("u", 2, "R"), ("a", 2, "R")):
                    if (last, r) in ok:
                        c, a, rest = best(at + 1, after[r], 2)
                        out.append((c + cost + code.isupper(), letter + a, r + rest))
        return min(out, default=(10 ** 9, "", ""))

    return best(0, "", 2)


def whole(rows, damage):
    """The contract for a list of (conv_id, turn, role, text), in plain Python."""
    text = lambda x: " " if x is None else str(x)
    convs = {}
    for conv, turn, role, body in rows:
        mine, role, body = convs.setdefault(conv, []), text(role), text(body)
        kind = zlib.crc32(f"{text(conv)}:{text(turn)}".encode()) % 20 if damage else 9
        if kind == 0:
            continue
        body = "" if kind == 1 else re.sub("[.!?]", "", body) if kind == 2 else body
        role = "user" if kind == 4 else role
        mine += [(turn, role, body)] * (2 if kind == 3 else 1)
    out = {}
    for conv, mine in convs.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0], r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        codes, n, seen = "", {"b": 0, "d": 0, "t": 0}, set()
        for _, role, body in mine:
            seen_text = re.sub(r"[\x20\x09-\x0D]", "", body)
            fault = "b" if not seen_text else "d" if (role, body) in seen else "t" if seen_text[-1] not in ".!?" else ""
            seen.add((role, body))
            if fault:
                n[fault] += 1
            code = role[:1] if role[:1] in ("s", "u", "a") else "x"
            codes += "-" if fault in ("b", "d") and fault else code.upper() if fault else code
        pairs = zip(mine, mine[1:], strict=False)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs)
        turns = [t for t, *_ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, roles = plain(codes)
        queue, lines, roles = iter(mine), [], iter(roles)
        for letter in audit:
            if letter == "I":
                lines.append({"u": "user", "a": "assistant"}[next(roles)] + ":")
                continue
            _, role, body = next(queue)
            if letter != "D":
                r = next(roles)
                lines.append((role if letter == "K" else {"u": "user", "a": "assistant"}[r]) + ":" + body)
        out[conv] = (gaps, n["b"], n["d"], n["t"], illegal, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def as_found(df):
    rows = df.collect()
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)
           for r in rows}
    assert len(got) == len(rows)
    return got


def odd_rows():
    rng = random.Random(5)
    bodies = ["Yes.", "No!", "and then", "", " \n", None, "Why? ", "x" * 300_000 + ".", "Ünï?"]
    roles = ["user", "assistant", "system", "tool", None, "", "User"]
    rows = [(c, t, rng.choice(roles[:3] if c % 2 else roles), rng.choice(bodies))
            for c in range(40) for t in rng.sample([None, *range(9)], k=rng.randint(1, 9))]
    rows += [(None, 0, "user", "Hello."), (None, None, "assistant", "Hello."), (900, 1, "user", "One.")]
    rows += [(901, 2, "user", "Same."), (901, 2, "user", "Same."), (901, 2, "assistant", "Same.")]
    rows += [(902, t, "user" if t % 2 else "assistant", f"Long {t}.") for t in range(200)]
    return rows


def test_whole_query_on_odd_rows(spark, tmp_path):
    rows = odd_rows()
    df = spark.createDataFrame([r + ("x", 1) for r in rows], SCHEMA)
    assert as_found(cr.digests(df)) == whole(rows, damage=False)
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = as_found(cr.op13_conversation_repair(spark, str(tmp_path)))
    assert got == whole(rows, damage=True)
    assert set(got) == {r[0] for r in rows}


def test_whole_query_on_the_table(spark):
    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    assert as_found(cr.op13_conversation_repair(spark, path)) == whole(rows, damage=True)


def test_dropped_conversations_and_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    empty.write.parquet(f"{tmp_path}/conversations.parquet")
    assert cr.op13_conversation_repair(spark, str(tmp_path)).count() == 0
    also = spark.createDataFrame([(5,)], "conv_id long")
    assert as_found(cr.digests(empty, also)) == {5: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "Hello."), (1, 3, "tool", "Fine.")]
    got = [(r.edit, r.role, r.text) for r in
           cr.repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("nth").collect()]
    assert got == [("K", "system", "Be kind."), ("K", "user", "Hi."), ("I", "assistant", ""), ("K", "user", "Hello."),
                   ("R", "assistant", "Fine.")]
