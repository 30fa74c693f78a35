"""The audit DP against an exhaustive search of all edits."""

import hashlib
import itertools
import random
import re
import zlib

from llm_fixtures import SF_SMALL  # noqa: F401

from netsieve.llm import op13_conversation_repair as C

SEEN = re.compile(r"[^\x20\x09-\x0D]")
GOOD = re.compile(r"(s?(ua)+)?\Z")


def damage(rows):
    """Rows (conv_id, turn, role, text) of one conversation, after the stated damage, in order."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def faults_of(rows):
    faults, seen = [], set()
    for _, role, text in rows:
        shown = SEEN.findall(text)
        faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    return faults


def search(rows):
    """(cost, audit, lines) by dynamic programming over whole strings."""
    def offer(layer, roles, cost, audit, lines):
        k = roles if len(roles) < 2 else roles[-1]
        if k not in layer or (cost, audit) < layer[k][1:3]:
            layer[k] = (roles, cost, audit, lines)

    layer = {"": ("", 0, "", [])}
    for (_, role, text), fault in zip(rows, faults_of(rows)):
        nxt = {}
        for roles, cost, audit, lines in layer.values():
            for n in range(4):
                for inserted in itertools.product(("user", "assistant"), repeat=n):
                    r, c, a, out = roles, cost, audit, lines
                    for name in inserted:
                        r, c, a, out = r + name[0], c + 5, a + "I", [*out, name + ":"]
                    if legal(r):
                        offer(nxt, r, c + 2, a + "D", out)
                    if fault in ("blank", "duplicate"):
                        continue
                    c += 5 if fault == "truncated" else 0
                    for name, more, e in ((role, 0, "K"), ("user", 1, "R"), ("assistant", 1, "R")):
                        if legal(r + name[:1]) and name[:1] in ("s", "u", "a"):
                            offer(nxt, r + name[:1], c + more, a + e, [*out, f"{name}:{text}"])
        layer = nxt
    ends = []
    for roles, cost, audit, lines in layer.values():
        for n in range(4):
            for inserted in itertools.product(("user", "assistant"), repeat=n):
                if GOOD.match(roles + "".join(x[0] for x in inserted)):
                    ends.append((cost + 5 * n, audit + "I" * n, lines + [x + ":" for x in inserted]))
    return min(ends, key=lambda e: e[:2])


def legal(roles):
    return re.fullmatch(r"s?(ua)*u?", roles) is not None


def exhaustive(rows):
    """Every string of edits of a short conversation."""
    best = None
    faults = faults_of(rows)
    gaps = [g for n in range(3) for g in itertools.product(("user", "assistant"), repeat=n)]
    for edits in itertools.product(*[("D", "K", "Ru", "Ra") if f not in ("blank", "duplicate") else ("D",) for f in faults]):
        for inserts in itertools.product(gaps, repeat=len(rows) + 1):
            cost, audit, lines = 0, "", []
            for k, ins in enumerate(inserts):
                cost, audit, lines = cost + 5 * len(ins), audit + "I" * len(ins), lines + [x + ":" for x in ins]
                if k < len(rows):
                    e, (_, role, text) = edits[k], rows[k]
                    audit += e[0]
                    cost += {"D": 2, "K": 0, "R": 1}[e[0]] + (5 if faults[k] == "truncated" and e != "D" else 0)
                    if e != "D":
                        lines.append(f"{ {'K': role, 'Ru': 'user', 'Ra': 'assistant'}[e]}:{text}")
            if GOOD.match("".join(x[:1] for x in lines)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, lines)
    return best


def brute(conv, rows):
    rows = damage(rows)
    faults = faults_of(rows)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, lines = search(rows)
    return (conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def some_rows(r, n, names=("system", "user", "assistant", "tool", "")):
    return [(k, r.choice(names), r.choice(["a.", "b?", "c", "", " ", "long text!", f"t{k}."])) for k in range(n)]


def solved(rows, blocks):
    whole = C.Conversation()
    code = {"": 0, "blank": 1, "duplicate": 2, "truncated": 3}
    marked = list(zip(rows, faults_of(rows)))
    for lo, hi in zip((0, *blocks), (*blocks, len(rows))):
        block = C.Block()
        for (turn, role, text), fault in marked[lo:hi]:
            block.add(turn, role, text, code[fault])
        whole.add(block.facts(not blocks))
    return whole.result()


def test_search_and_dp_equal_every_edit_string():
    r = random.Random(1)
    for n in (0, 1, 2, 3, 3):
        for _ in range(25 if n < 3 else 6):
            rows = some_rows(r, n)
            want = exhaustive(rows)
            assert search(rows) == want
            got = solved(rows, ())
            assert got[5:] == (want[0], want[1], hashlib.sha256("\n".join(want[2]).encode()).hexdigest())


def test_blocks_strung_together_equal_one_block_and_search(monkeypatch):
    r = random.Random(2)
    for k in range(150):
        monkeypatch.setattr(C, "_PRIME", 3 if k % 2 else (1 << 61) - 1)   # hashes collide all the time
        rows = some_rows(r, r.randint(1, 40))
        cuts = tuple(sorted(r.randint(0, len(rows)) for _ in range(r.randint(1, 5))))
        whole, want = solved(rows, ()), search(rows)
        assert whole[5:7] == want[:2]
        assert whole == solved(rows, cuts)


def test_query_equals_search(spark):
    from netsieve.llm.queries import QUERIES
    rows = [tuple(x) for x in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    groups = {}
    for x in rows:
        groups.setdefault(x[0], []).append(x)
    assert sorted(map(tuple, QUERIES["op13_conversation_repair"](spark, SF_SMALL).collect())) == sorted(brute(c, g) for c, g in groups.items())


def test_odd_rows_and_a_conversation_over_many_tasks(spark):
    r = random.Random(5)
    rows = [(None, 1, "user", "a."), (None, 2, "assistant", "b."), (1, None, "user", "x."), (1, None, None, None), (1, 3, "assistant", "y"),
            (2, None, None, None), (3, 0, "user", None), (4, 0, "user", "q?"), (4, 0, "user", "q?"), (4, 0, "user", "q?"), (5, 9, "Ü", "é."),
            (6, 2**62, "system", "\x0b\x0c x."), (6, -5, "user", "\x85"), (7, 1, "user", "z" * 100_000 + ".")]
    rows += [(50 + k, 0, "user", "hi.") for k in range(60)]
    rows += [(8, k // 2, *x[1:]) for k, x in enumerate(some_rows(r, 7000, ("user", "assistant")))]
    rows += [(9, 7, "user", "again and again.")] * 3000
    schema = "conv_id long, turn long, role string, text string"
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, schema).withColumns({c: F.lit("clash") for c in ("number", "same", "gone", "fault", "kind", "conv", "first", "n")})
    groups = {}
    for x in rows:
        groups.setdefault(x[0], []).append(x)
    got = {x[0]: tuple(x) for x in C.audits(C.damaged(df)).collect()}
    assert got == {c: brute(c, g) for c, g in groups.items()}
    assert any(v[7] == "" and v[6] == 0 for v in got.values())
    assert C.audits(C.damaged(df.limit(0))).count() == 0
    assert {x.conv_id: x.audit for x in C.audits(C.as_given(df.where("conv_id = 50"))).collect()} == {50: "D"}
