import hashlib
import itertools
import random
import re
import tracemalloc
import zlib

import pytest

from driftmon.llm.conversation_repair import Costs, Decoder, damage, repair_conversations, repair_damaged

SCHEMA = "conv_id long, turn long, role string, text string, mark string, step int, of long, edit string"
LEGAL = re.compile(r"(s?(ua)+)?")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(" \t\n\x0b\f\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else None if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, bad, c=Costs()):
    """All edits of the rows with up to two inserts at each place, tried one by one; fine for a few rows."""
    best = None
    fills = ["", "u", "a", "ua", "au"]
    choices = []
    for (role, _), f in zip(rows, bad):
        more = c.truncated if f == "truncated" else 0
        ways = [("D", "", c.delete)]
        if f not in ("blank", "duplicate"):
            ways += [("K", role[:1], c.keep + more), ("R", "u", c.rerole + more), ("R", "a", c.rerole + more)]
        choices.append(ways)
    for edits in itertools.product(*choices):
        base = sum(e[2] for e in edits)
        for ins in itertools.product(fills, repeat=len(rows) + 1):
            cost = base + c.insert * sum(map(len, ins))
            if best is not None and cost > best[0]:
                continue
            roles, audit = ins[0], "I" * len(ins[0])
            for e, more in zip(edits, ins[1:]):
                roles += e[1] + more
                audit += e[0] + "I" * len(more)
            if LEGAL.fullmatch(roles) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def decode(rows, bad, c=Costs()):
    d, nodes = Decoder(c), []
    for (role, text), f in zip(rows, bad):
        nodes += [(n.edit, n.price) for n in d.row(role, f, (role, text))]
    nodes += [(n.edit, n.price) for n in d.finish()]
    return sum(p for _, p in nodes), "".join(e for e, _ in nodes)


@pytest.mark.parametrize("costs", [Costs(), Costs(insert=1), Costs(rerole=3, insert=2, delete=4), Costs(0, 2, 1, 1, 1)])
def test_decoder_finds_the_cheapest_edits(costs):
    rng = random.Random(5)
    for _ in range(60):
        rows = [(rng.choice(["system", "user", "assistant", "tool", " "]), rng.choice(["a.", "b.", "c", "", f"{rng.random()}."])) for _ in range(rng.randrange(0, 5))]
        bad = faults(rows)
        assert decode(rows, bad, costs) == cheapest(rows, bad, costs), rows


def dynamic(rows, bad, c=Costs()):
    """The same by whole strings: every state's cheapest edits, no tree."""
    def fill(s):
        for _ in range(2):
            for a, b in ((0, 2), (1, 2), (3, 2), (2, 3)):
                if a in s:
                    s[b] = min(s.get(b, (10**9, "")), (s[a][0] + c.insert, s[a][1] + "I"))
        return s

    s = fill({0: (0, "")})
    to = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    for (role, _), f in zip(rows, bad):
        more, n = (c.truncated if f == "truncated" else 0), {}

        def put(k, v):
            n[k] = min(n.get(k, v), v)

        for k, (cost, a) in s.items():
            put(k, (cost + c.delete, a + "D"))
            if f not in ("blank", "duplicate"):
                if k in to.get(role[:1], {}):
                    put(to[role[:1]][k], (cost + c.keep + more, a + "K"))
                put(3 if k == 2 else 2, (cost + c.rerole + more, a + "R"))
        s = fill(n)
    return min(s[k] for k in (0, 3) if k in s)


def test_long_conversations_equal_the_plain_program():
    rng = random.Random(8)
    for n in (50, 300, 900):
        for sure in (0.5, 0.9):
            rows = [((("user", "assistant")[i % 2]) if rng.random() < sure else rng.choice(["system", "user", "tool"]),
                     f"{i}." if rng.random() < 0.7 else rng.choice([f"{i}", "", "same."])) for i in range(n)]
            bad = faults(rows)
            assert decode(rows, bad) == dynamic(rows, bad)


def test_memory_does_not_grow_with_a_conversation():
    d, most = Decoder(), 0
    tracemalloc.start()
    for i in range(30_000):
        if i == 2_000:
            tracemalloc.reset_peak()
            before = tracemalloc.get_traced_memory()[0]
        role = ("user", "assistant")[i % 2] if i % 7 else "system"
        for _ in d.row(role, None, (i, "x" * 1000 + str(i))):
            pass
        most = max(most, d.unresolved)
    grown = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert most <= 64 and grown < 1_000_000


ROWS = [
    (1, 0, "user", "Hi."), (1, 1, "assistant", "Hello."), (1, 1, "assistant", "Hello."), (1, 3, "user", "  "), (1, 4, "assistant", "cut"),
    (2, 0, "assistant", "b."), (2, None, "user", None), (2, 0, "assistant", "a."), (2, 9, None, "x!"),
    (3, None, "tool", "z."), (None, 0, "user", "q?"), (None, 1, "assistant", "w. \n"), (5, 2, "user", "é." * 3000), (5, 3, "assistant", "ok."),
    (6, None, None, None), (7, 1, "", "."), (7, 2, "system", "."), (7, 2, "system", "."),
] + [(8, i, ("user", "assistant")[i % 2], f"{i % 5}.") for i in range(40)]


def make(spark, rows):
    return spark.createDataFrame([(*r, "m", 1, 2, "e") for r in rows], SCHEMA).repartition(4)


def expected(rows, damaged=True):
    by = {}
    for conv, turn, role, text in rows:
        own = by.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damaged else 9
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        pairs = [(r, t) for _, r, t in own]
        bad = faults(pairs)
        cost, audit = dynamic(pairs, bad)
        turns = [t for t, *_ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:]))
        lines, last, rest = [], "", iter(pairs)
        for e in audit:
            role, text = next(rest) if e != "I" else ("", "")
            if e in "RI":
                role = "assistant" if last == "u" else "user"
            if e != "D":
                lines.append(f"{role}:{text}")
                last = role[:1]
        out.append((conv, gaps, bad.count("blank"), bad.count("duplicate"), bad.count("truncated"), illegal, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_report_of_damaged_rows(spark):
    rng = random.Random(2)
    rows = ROWS + [(100 + i % 23, i // 23, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "No!", "and", f"t{i}."])) for i in range(400)]
    got = sorted(map(tuple, repair_damaged(make(spark, rows)).collect()), key=repr)
    assert got == expected(rows)


def test_edits_are_real_rows(spark):
    edits = repair_conversations(make(spark, ROWS)).collect()
    one = [r for r in edits if r.conv_id == 1]
    assert [r.step for r in one] == list(range(len(one))) and "".join(r.edit for r in one) == "KKDDD"
    assert [(r.role, r.text) for r in one if r.edit != "D"] == [("user", "Hi."), ("assistant", "Hello.")]
    assert [r.fault for r in one] == [None, None, "duplicate", "blank", "truncated"]
    for conv in {r.conv_id for r in edits}:
        assert LEGAL.fullmatch("".join(r.role[:1] for r in edits if r.conv_id == conv and r.edit != "D"))


def test_empty_table_and_lost_conversations(spark):
    assert repair_damaged(make(spark, ROWS).limit(0)).count() == 0
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    only = make(spark, [(lost, 0, "user", "gone.")])
    assert damage(only).count() == 0
    assert [tuple(r) for r in repair_damaged(only).collect()] == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
