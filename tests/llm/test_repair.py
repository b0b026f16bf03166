import hashlib
import random
import zlib

import pytest

from lexquarry.llm import repair

KIND = "conv_id long, turn long, role string, text string"
BLANK = " \t\n\x0b\x0c\r"
NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damaged(rows):
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        if kind:
            yield from [(conv, turn, role, text)] * (2 if kind == 3 else 1)


def best(rows, faults):
    """All ways by plain search over (place, state), the cheapest and then least; and the repaired rows."""
    initials = {0: "su", 1: "u", 2: "a", 3: "u"}
    after = {"s": 1, "u": 2, "a": 3}
    ways = {(0, 0): (0, "", ())}

    def relax(key, way):
        if key not in ways or (way[0], way[1]) < (ways[key][0], ways[key][1]):
            ways[key] = way

    for i in range(len(rows) + 1):
        for _ in range(4):
            for state in range(4):
                if (i, state) in ways:
                    cost, audit, out = ways[i, state]
                    for role in ("user", "assistant"):
                        if role[0] in initials[state]:
                            relax((i, after[role[0]]), (cost + 3, audit + "I", (*out, (role, ""))))
        if i == len(rows):
            break
        role, text = rows[i][2:]
        for state in range(4):
            if (i, state) not in ways:
                continue
            cost, audit, out = ways[i, state]
            relax((i + 1, state), (cost + 4, audit + "D", out))
            if faults[i] in ("b", "d"):
                continue
            more = 3 if faults[i] == "t" else 0
            if role[:1] and role[:1] in initials[state]:
                relax((i + 1, after[role[0]]), (cost + more, audit + "K", (*out, (role, text))))
            for other in ("user", "assistant"):
                if other[0] in initials[state]:
                    relax((i + 1, after[other[0]]), (cost + 3 + more, audit + "R", (*out, (other, text))))
    return min((ways[len(rows), s] for s in (0, 3) if (len(rows), s) in ways), key=lambda w: w[:2])


def brute_force(rows, damage=True):
    by = {conv: [] for conv, *_ in rows}
    for row in damaged(rows) if damage else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]:
        by[row[0]].append(row)
    out = []
    for conv, own in by.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
        faults, seen = [], set()
        for _, _, role, text in own:
            bare = text.rstrip(BLANK)
            faults.append("b" if not bare else "d" if (role, text) in seen else "." if bare[-1] in ".!?" else "t")
            seen.add((role, text))
        turns = {t for _, t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, left = best(own, faults)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()
        out.append((conv, gaps, *(faults.count(k) for k in "bdt"), illegal, cost, audit, digest))
    return sorted(out, key=str)


def conversations(n=60, longest=12, seed=5):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((conv, turn + rng.randint(0, 1), role, rng.choice(["Hello.", "Yes!", "cut off", " \t", "", None, "Who?  ", f"text {turn}.", "é中😀."])))
    return rows + [(None, 0, "user", "no id."), (None, None, "system", "first."), (None, None, "user", "a."), (7, 3, "user", "again."), (7, 3, "user", "again."), (7, 3, "user", "again.")]


def collected(df):
    return sorted((tuple(r[c] for c in NAMES) for r in df.collect()), key=str)


@pytest.mark.parametrize("bits, parts", [(9, 1), (1, 5)])
def test_equals_brute_force(spark, monkeypatch, bits, parts):
    monkeypatch.setattr(repair, "PIECE_BITS", bits)
    rows = conversations()
    df = spark.createDataFrame(rows, KIND).repartition(parts).selectExpr("*", "'x' AS pos", "1 AS kind", "2 AS block", "'y' AS audit")
    assert collected(repair.repair_digest(df)) == brute_force(rows)
    assert collected(repair.repair_digest(df, damage=False)) == brute_force(rows, False)


def test_one_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(repair, "PIECE_BITS", 4)
    rng = random.Random(2)
    for roles in (["user"], ["user", "assistant"], ["user", "assistant", "system"]):
        rows = [(1, t, rng.choice(roles), f"said {rng.randint(0, 300)}" + rng.choice(["", ".", "?"])) for t in range(400)]
        assert collected(repair.repair_digest(spark.createDataFrame(rows, KIND).repartition(3))) == brute_force(rows)


def test_repaired_rows(spark, monkeypatch):
    monkeypatch.setattr(repair, "PIECE_BITS", 2)
    rows = conversations(20)
    got = repair.repaired(spark.createDataFrame(rows, KIND).selectExpr("conv_id", "turn", "coalesce(role, ' ') AS role", "coalesce(text, ' ') AS text")).collect()
    digests = {r[0]: r[-1] for r in brute_force(rows, False)}
    by = {c: [] for c in digests}
    for r in sorted(got, key=lambda r: (r["pos"], r["nth"])):
        by[r["conv_id"]].append(f"{r['role']}:{r['text']}")
        assert r["edit"] in "KRI"
    assert {c: hashlib.sha256("\n".join(x).encode()).hexdigest() for c, x in by.items()} == digests


def test_all_rows_dropped_and_empty(spark):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = collected(repair.repair_digest(spark.createDataFrame([(dropped, 0, "user", "x.")], KIND)))
    assert got == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair.repair_digest(spark.createDataFrame([], KIND)).collect() == []


def test_very_long_text(spark):
    rows = [(1, 0, "user", "word " * 400_000 + "."), (1, 1, "assistant", "é" * 500_000)]
    assert collected(repair.repair_digest(spark.createDataFrame(rows, KIND), damage=False)) == brute_force(rows, False)
