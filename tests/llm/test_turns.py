import hashlib
import itertools
import random
import re

import pytest

from tessaro.llm import turns
from tessaro.llm.turns import audit_conversations, filled, repair, repair_conversations, repair_report

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_repair(signature):
    """The least (cost, audit) of all edits with at most two insertions at a place."""
    sounds = {"D": 2, "K": 0, "R": 1}
    best = None
    inserted = ["", "I", "II"]
    for edits in itertools.product(*["D" if s == "d" else "DKR" for s in signature]):
        for gaps in itertools.product(inserted, repeat=len(signature) + 1):
            audit = gaps[0] + "".join(e + g for e, g in zip(edits, gaps[1:]))
            cost = 5 * audit.count("I") + sum(sounds[e] + (5 if s.isupper() and e != "D" else 0) for e, s in zip(edits, signature))
            if best and (cost, audit) >= best:
                continue
            signs = iter(signature)
            kinds = ["ua" if x == "I" else ("ua" if x == "R" else s.lower()) for x in audit for s in ([""] if x == "I" else [next(signs)]) if x != "D"]
            if any(re.fullmatch("(s?(ua)+)?", "".join(c)) for c in itertools.product(*kinds)):
                best = (cost, audit)
    return best


def test_repairs_against_all_edits():
    rng = random.Random(1)
    some = ["".join(c) for n in (0, 1, 2) for c in itertools.product("suaoSUAOd", repeat=n)]
    some += ["".join(rng.choices("suaoSUAOd", k=rng.choice([3, 3, 4]))) for _ in range(150)]
    for s in some:
        assert repair(s) == plain_repair(s), s


def test_very_long_signatures():
    assert repair("ua" * 20_000) == (0, "K" * 40_000)
    cost, audit = repair("u" * 9_999 + "a")
    assert cost == 4_999 and audit.count("R") == 4_999 and len(audit) == 10_000


def conversations(seed=0):
    rng = random.Random(seed)
    rows = []
    for c in [*range(60), None]:
        for t in range(rng.randint(1, 12)):
            text = rng.choice(["Yes.", "Who is it?", "so on", " \n", "", None, f"no {t}!", "end. \t"])
            turn = None if rng.random() < 0.05 else t + rng.choice([0, 0, 1])
            rows.append((c, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), text))
    return [*rows, rows[0], rows[3], rows[3]]


def expected(rows):
    """Per conversation, from the rows that are left of it: faults, edits and repaired lines, by plain Python."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = [(t, r or ("" if r == "" else " "), " " if x is None else x) for c, t, r, x in rows if c == conv]
        mine.sort(key=lambda m: (m[0] is not None, m[0] or 0, m[1], hashlib.md5(m[2].encode()).hexdigest()))
        seen, signs, counts = set(), "", dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in mine:
            body = text.strip(" \t\n\x0b\f\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            sign = role[:1] if role[:1] in ("s", "u", "a") else "o"
            signs += "d" if fault in ("blank", "duplicate") else sign.upper() if fault else sign
        initials = [m[1][:1] or " " for m in mine]
        known = [m[0] for m in mine if m[0] is not None]
        cost, audit = repair(signs)
        left, lines, role = iter(mine), [], ""
        for letter in audit:
            _, own, text = next(left) if letter != "I" else (None, None, "")
            if letter == "D":
                continue
            role = own if letter == "K" else "assistant" if role[:1] == "u" else "user"
            lines.append((letter, role, text))
        out[conv] = {
            **counts, "gaps": max(known) - min(known) + 1 - len(set(known)) if known else 0, "cost": cost, "audit": audit, "lines": lines,
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        }
    return out


@pytest.mark.parametrize("common", [1, 5_000])
def test_report_and_repair(spark, monkeypatch, common):
    monkeypatch.setattr(turns, "COMMON", common)
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as copy", "'y' as audit", "'z' as part")
    want = expected(rows)
    got = {r["conv_id"]: r.asDict() for r in repair_report(df, filled(df)).collect()}
    assert got.keys() == want.keys()
    for c, w in want.items():
        lines = "\n".join(f"{role}:{text}" for _, role, text in w["lines"])
        assert {k: got[c][k] for k in got[c] if k not in ("conv_id", "repaired_sha256")} == {k: v for k, v in w.items() if k != "lines"}, c
        assert got[c]["repaired_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
    mended = {}
    for r in sorted(repair_conversations(df).collect(), key=lambda r: r["place"]):
        mended.setdefault(r["conv_id"], []).append((r["edit"], r["role"], r["text"]))
    assert mended == {c: w["lines"] for c, w in want.items() if w["lines"]}


def test_a_conversation_in_many_ranges(spark):
    rows = [(1, t // 2, ("user", "assistant")[t % 2], f"text {t}.") for t in range(6_000)] + [(2, None, "user", None)]
    got = {r["conv_id"]: r for r in audit_conversations(filled(spark.createDataFrame(rows, SCHEMA))).collect()}
    # Turns of one number go by role: assistant first.
    assert got[1]["initials"] == "au" * 3_000 and (got[1]["gaps"], got[1]["illegal"]) == (0, 0)
    assert (got[2]["blank"], got[2]["gaps"], got[2]["audit"]) == (1, 0, "D")


def test_nothing_left_and_nothing_at_all(spark):
    df = spark.createDataFrame([(7, 1, "user", "Hm.")], SCHEMA)
    row = repair_report(df, filled(df).limit(0)).first()
    assert tuple(row) == (7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert repair_report(df.limit(0), filled(df.limit(0))).count() == 0
    assert repair_conversations(df.limit(0)).count() == 0
