import hashlib
import itertools
import random

import pytest

from omics_spark.llm import structure_repair as S

from .helpers import CLASHES

SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(codes, start=0, goal=None, last=True):
    """Least (cost, letters) by rows, over all states: no bounds, no estimate."""
    best = {start: (0, "")}
    for code in [*codes, None] if last else codes:
        for _ in range(2):
            for q, (cost, letters) in list(best.items()):
                after = S.NEXT[q, S.WANTED[q]]
                best[after] = min(best.get(after, (S.NEVER, "")), (cost + 5, letters + "I"))
        if code is None:
            break
        then = {}
        for q, (cost, letters) in best.items():
            moves = [("D", 2, q)]
            if code != "x":
                more = 5 if code.isupper() else 0
                moves.append(("R", 1 + more, S.NEXT[q, S.WANTED[q]]))
                if (q, code.lower()) in S.NEXT:
                    moves.append(("K", more, S.NEXT[q, code.lower()]))
            for letter, price, to in moves:
                then[to] = min(then.get(to, (S.NEVER, "")), (cost + price, letters + letter))
        best = then
    if goal is not None:
        return best.get(goal)
    return min(best[q] for q in S.ENDS if q in best)


def test_every_short_conversation():
    for n in range(5):
        for codes in itertools.product("suaoUAx", repeat=n):
            codes = "".join(codes)
            assert S.Search(codes, True).cheapest(0) == cheapest(codes)


@pytest.mark.parametrize("seed", range(30))
def test_blocks_chain_to_the_whole(seed):
    rng = random.Random(seed)
    codes = "".join(rng.choice("suauauaoSUAOxx" if seed % 2 else "ua") for _ in range(rng.randint(1, 60)))
    size = rng.choice([1, 2, 5, 9])
    parts = [codes[i:i + size] for i in range(0, len(codes), size)]
    found = [S.ways(p, i == 0, i == len(parts) - 1) for i, p in enumerate(parts)]
    for part, ways in zip(parts[:-1], found):
        for w in ways:
            assert (w["cost"], w["letters"]) == cheapest(part, w["start"], w["goal"], last=False)
    steps = S.chain([[(w["start"], w["goal"], w["cost"], w["rank"]) for w in ways] for ways in found])
    picked = [next(w for w in ways if (w["start"], w["goal"]) == s) for s, ways in zip(steps, found)]
    assert (sum(w["cost"] for w in picked), "".join(w["letters"] for w in picked)) == cheapest(codes) == S.Search(codes, True).cheapest(0)


def plain(rows):
    """The row of one conversation, from its rows in order."""
    blank = duplicate = truncated = 0
    codes, seen = "", set()
    for _, role, text in rows:
        shown = text.rstrip(" \t\n\x0b\x0c\r")
        code = role[:1] if role[:1] and role[:1] in "sua" else "o"
        if not shown:
            blank, code = blank + 1, "x"
        elif (role, text) in seen:
            duplicate, code = duplicate + 1, "x"
        elif shown[-1] not in ".!?":
            truncated, code = truncated + 1, code.upper()
        seen.add((role, text))
        codes += code
    cost, audit = cheapest(codes)
    state, at, lines = 0, 0, []
    for letter in audit:
        role, text = S.ROLES[S.WANTED[state]], ""
        if letter != "I":
            kept, text = rows[at][1:]
            at += 1
            if letter == "D":
                continue
            role = kept if letter == "K" else role
        state = S.NEXT[state, role[0]]
        lines.append(f"{role}:{text}")
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, blank, duplicate, truncated, sum(p not in ("su", "ua", "au") for p in pairs),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def check(spark, rows, extra=()):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", *extra)
    got = {r["conv_id"]: tuple(r)[1:] for r in S.repair(df, df).collect()}
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((turn, " " if role is None else role, " " if text is None else text))
    tie = {c: sorted(mine, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest())) for c, mine in by.items()}
    assert got == {c: plain(mine) for c, mine in tie.items()}


def test_conversations_long_and_short(spark):
    rng = random.Random(7)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", ""]
    rows = [(c, t, rng.choice(roles), rng.choice(["Yes.", "No!", "cut", " \t", "", "Why? ", f"{t}."])) for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(100, t, roles[1 + t % 2], f"line {t}" + ("." if rng.random() < 0.8 else "")) for t in range(500) if t % 17]
    rows += [(101, t, rng.choice(roles), rng.choice(["Same.", f"{t}?"])) for t in range(200)]
    check(spark, rows)


def test_awkward_rows(spark):
    rows = [(1, None, None, None), (1, None, "user", "A."), (1, 3, "user", "A."), (1, 3, "user", "A."), (None, 0, "user", "B."), (None, 1, "assistant", "C."),
            (2, None, "assistant", "x" * 200_000 + "." + " " * 200_000), (3, 0, "", "a "), (4, 0, "user", None)]
    check(spark, rows, [f"'clash' as `{c}`" for c in [*CLASHES, "conv", "pos", "block", "letters"] if c != "text"])


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert S.repair(empty, empty).count() == 0
    some = spark.createDataFrame([(7, 0, "user", "a")], SCHEMA)
    (row,) = S.repair(empty, some).collect()
    assert tuple(row) == (7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_damage(spark):
    import zlib

    rows = [(c, t if t else None, "assistant", "Hi? No.") for c in range(40) for t in range(4)]
    got = sorted((r["conv_id"], -1 if r["turn"] is None else r["turn"], r["role"], r["text"]) for r in S.damaged(spark.createDataFrame(rows, SCHEMA)).collect())
    want = []
    for c, t, role, text in rows:
        harm = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        row = (c, -1 if t is None else t, "user" if harm == 4 else role, "" if harm == 1 else "Hi No" if harm == 2 else text)
        want += [row] * (0 if harm == 0 else 2 if harm == 3 else 1)
    assert got == sorted(want)
