"""Repair of conversations, against audits compared as strings, and on short ones against every sequence of edits."""

import itertools
import random
import re
import zlib
from hashlib import sha256

import pytest

from annalist.llm import repair

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, at long, fault string"


def damaged(rows):
    out = []
    for conv_id, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        if h:
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            out += [(conv_id, turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def sound(initials: str) -> bool:
    return re.fullmatch("(s?(ua)+)?", initials) is not None


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        rest = text.strip(SPACE)
        out.append("blank" if not rest else "duplicate" if (role, text) in seen else "truncated" if rest[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def options(state: str, role: str, fault):
    """(inserted, letter, role that stands or None) from a sequence of initials, of which only the last counts."""
    for k in range(3):
        added = []
        for _ in range(k):
            added.append("assistant" if (added[-1] if added else {"u": "user"}.get(state[-1:])) == "user" else "user")
        yield added, "D", None
        if fault not in ("blank", "duplicate"):
            yield added, "K", role
            yield added, "R", "user"
            yield added, "R", "assistant"


def prefix_of_sound(initials: str) -> bool:
    return re.fullmatch("s?(ua)*u?", initials) is not None


def cheapest(rows, marks):
    """Least (cost, audit, standing turns) by the last state, audits as strings."""
    best = {"": (0, "", [])}
    for (_, _, role, text), fault in zip(rows, marks, strict=True):
        new = {}
        for state, (cost, audit, standing) in best.items():
            for added, letter, stands in options(state, role, fault):
                turns = [(r, "") for r in added] + ([] if stands is None else [(stands, text)])
                initials = state + "".join(r[:1] for r, _ in turns)
                if not prefix_of_sound(initials):
                    continue
                spent = cost + 2 * len(added) + {"D": 3, "K": 0, "R": 2}[letter] + (letter != "D" and fault == "truncated")
                found = (spent, audit + "I" * len(added) + letter, standing + turns)
                end = initials if initials in ("", "s") else "u" if initials[-1] == "u" else "ua"
                if end not in new or found[:2] < new[end][:2]:
                    new[end] = found
        best = new
    ends = []
    for state, (cost, audit, standing) in best.items():
        added = {"": [], "s": ["user", "assistant"], "u": ["assistant"], "ua": []}[state]
        ends.append((cost + 2 * len(added), audit + "I" * len(added), standing + [(r, "") for r in added]))
    return min(ends, key=lambda e: e[:2])


def every_way(rows, marks):
    """The least (cost, audit) of all sequences of edits with up to two inserted turns before each turn and at the end."""
    choices = []
    for (_, _, role, _), fault in zip(rows, marks, strict=True):
        edits = [("D", "", 3)] if fault in ("blank", "duplicate") else [("D", "", 3), *((x, r, c + (fault == "truncated")) for x, r, c in (("K", role[:1], 0), ("R", "u", 2), ("R", "a", 2)))]
        choices.append([("".join(k), *e) for n in range(3) for k in itertools.product("ua", repeat=n) for e in edits])
    tails = ["", "a", "ua"]
    best = None
    for way in itertools.product(*choices):
        initials = "".join(k + r for k, _, r, _ in way)
        for tail in tails:
            if sound(initials + tail):
                cost = sum(2 * len(k) + c for k, _, _, c in way) + 2 * len(tail)
                audit = "".join("I" * len(k) + x for k, x, _, _ in way) + "I" * len(tail)
                best = min(best or (cost, audit), (cost, audit))
    return best


def brute(original, rows):
    out = []
    for conv_id in {r[0] for r in original}:
        own = sorted((r for r in rows if r[0] == conv_id), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        marks = faults(own)
        cost, audit, standing = cheapest(own, marks)
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        digest = sha256("\n".join(f"{r}:{t}" for r, t in standing).encode()).hexdigest()
        out.append((conv_id, gaps, marks.count("blank"), marks.count("duplicate"), marks.count("truncated"), illegal, cost, audit, digest))
    return sorted(out, key=str)


def talks(rng, n, longest):
    rows = []
    for conv_id in [*range(n), None]:
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"])
            text = rng.choice(["Yes.", "No!", "and so on", " \t\n", "", None, "é?\r\n", "what", *[f"{turn}."] * 6])
            rows.append((conv_id, rng.choice([turn, turn, turn, None, turn * 3 - 5]), role, text))
    return rows


def result(spark, rows, original=None):
    make = lambda r: spark.createDataFrame([(*x, 5, "q") for x in r], SCHEMA).repartition(3)
    found = repair.report(make(original or rows), repair.repair(make(rows)))
    return sorted([tuple(r) for r in found.collect()], key=str)


@pytest.mark.parametrize("block", [1, 10])
def test_equals_audits_compared_as_strings(spark, monkeypatch, block):
    """Also in blocks of two turns, so that conversations lie in many blocks and levels."""
    rows = damaged(talks(random.Random(block), 60, 14))
    monkeypatch.setattr(repair, "BLOCK", block)
    assert result(spark, rows) == brute(rows, rows)


def test_strings_equal_every_way():
    rng = random.Random(2)
    for _ in range(60):
        own = [(1, i, rng.choice(["user", "assistant", "system", "tool", "user"]), rng.choice(["a.", "a", "", f"{i}."])) for i in range(rng.randint(0, 3))]
        assert cheapest(own, faults(own))[:2] == every_way(own, faults(own))


def test_damage_and_conversations_without_rows(spark):
    rng = random.Random(8)
    rows = talks(rng, 120, 3)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = repair.damage(df)
    assert sorted([tuple(r) for r in found.collect()], key=str) == sorted(damaged(rows), key=str)
    want = brute(rows, damaged(rows))
    assert any(w[7] == "" for w in want)
    assert sorted([tuple(r) for r in repair.report(df, repair.repair(found)).collect()], key=str) == want
    assert repair.report(df.limit(0), repair.repair(df.limit(0))).collect() == []


def test_query_over_a_table_and_one_long_conversation(spark, tmp_path):
    rng = random.Random(4)
    rows = [(7, i, rng.choice(["user", "assistant"]), f"{i}{rng.choice('.a')}") for i in range(3000)] + [(8, 0, "user", "x." * 100_000)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    found = repair.op12_rank_repair(spark, str(tmp_path))
    assert sorted([tuple(r) for r in found.collect()], key=str) == brute(rows, damaged(rows))
