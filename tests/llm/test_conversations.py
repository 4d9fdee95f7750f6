"""Repair of conversations against plain searches over whole conversations."""

import random
import re
from collections import defaultdict
from functools import cache
from hashlib import sha256
from zlib import crc32

import pytest

from tablesmith.llm.conversations import Survivors, _Waiting, digest, repair, repair_damaged

BLANKS = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """Cost and edits of the best repair of ``rows (initial, forced, truncated)``, over all repairs."""
    follows = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    @cache
    def best(at, last, inserted):
        found = [(0, "")] if at == len(rows) and last in ("", "a") else []
        ways = [(at, r, 5, "I", inserted + 1) for r in "ua" if inserted < 3]
        if at < len(rows):
            initial, forced, truncated = rows[at]
            if rest := best(at + 1, last, 0):
                found.append((rest[0] + 2, "D" + rest[1]))
            if not forced:
                ways.append((at + 1, initial, 5 * truncated, "K", 0))
                ways += [(at + 1, r, 1 + 5 * truncated, "R", 0) for r in "ua"]
        for after, role, cost, edit, n in ways:
            if (last, role) in follows and (rest := best(after, follows[last, role], n)):
                found.append((rest[0] + cost, edit + rest[1]))
        return min(found) if found else None

    return best(0, "", 0)


def test_survivors_give_the_least_edits():
    dice = random.Random(5)
    for round in range(4_000):
        some, forced, truncated = dice.choice(["ua", "suax", "uuua", "x", "saau"]), dice.choice([0, 0.1, 0.5]), dice.choice([0, 0.1, 0.6])
        rows = [(dice.choice(some), dice.random() < forced) for _ in range(dice.randint(0, 12))]
        rows = [(r, f, not f and dice.random() < truncated) for r, f in rows]
        paths, moves = Survivors(), []
        for row in rows:
            moves += paths.step(*row)
        cost, rest = paths.end()
        assert (cost, "".join(e for e, _ in moves + rest)) == cheapest(rows), rows


def test_decisions_follow_closely():
    """Only a short open end is held over a long conversation."""
    dice, paths, decided, most = random.Random(6), Survivors(), 0, 0
    for i in range(50_000):
        decided += len(paths.step(dice.choice("uuaas"), dice.random() < 0.1, dice.random() < 0.1))
        most = max(most, i + 1 - decided)
    assert most < 200


def test_waiting_rows_come_back(monkeypatch):
    monkeypatch.setattr("tablesmith.llm.conversations.WAITING_BYTES", 100)
    held, expected = _Waiting(), []
    for i in range(50):
        held.put((i, "x" * i))
        expected.append((i, "x" * i))
        if i % 7 == 3:
            assert [held.get() for _ in expected] == expected
            expected = []
    assert [held.get() for _ in expected] == expected


def plain(conversation):
    """What repair_damaged gives for the rows ``(turn, role, text)`` of one conversation, damage done."""
    rows = sorted(conversation, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.rstrip(BLANKS)
        kind = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        faults.append(kind)
        seen.add((role, text))
    turns = {t for t, *_ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    initials = [role[:1] for _, role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit = cheapest([(i, f in ("blank", "duplicate"), f == "truncated") for i, f in zip(initials, faults)])
    kept, left = [], iter(rows)
    for edit in audit:
        row = None if edit == "I" else next(left)
        if edit != "D":
            other = "assistant" if kept and kept[-1][0] == "u" else "user"
            kept.append(f"{row[1] if edit == 'K' else other}:{row[2] if row else ''}")
    assert re.fullmatch("(s?(ua)+)?", "".join(k[:1] for k in kept))
    counts = [faults.count(k) for k in ("blank", "duplicate", "truncated")]
    return gaps, *counts, illegal, cost, audit, sha256("\n".join(kept).encode()).hexdigest()


def damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        conv_text, turn_text = (" " if v is None else str(v) for v in (conv, turn))
        role, text = (" " if v is None else v for v in (role, text))
        case = crc32(f"{conv_text}:{turn_text}".encode()) % 20
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        out[conv] += [(turn, "user" if case == 4 else role, text)] * (0 if case == 0 else 2 if case == 3 else 1)
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, fault string, cost int")


def compare(spark, rows):
    got = {r["conv_id"]: tuple(r)[1:] for r in repair_damaged(table(spark, rows)).collect()}
    assert got == {c: plain(own) for c, own in damage([*rows]).items()}


def test_damaged_conversations(spark):
    dice = random.Random(7)
    text = lambda: dice.choice(["Yes.", "No!", "so", "ok?\x0b ", " ", "", "Yes. ", "a\nb."])
    rows = [(c, dice.randint(-3, 12), dice.choice(["user", "assistant", "system", "tool", ""]), text()) for c in range(150) for _ in range(dice.randint(1, 10))]
    compare(spark, rows)


def test_odd_rows(spark):
    rows = [
        (None, 1, "user", "Hi."), (None, None, "assistant", "Ho."), (1, None, None, None), (1, None, "user", "A."),
        (1, 2, "user", "A."), (1, 2, "user", "A."), (2, None, "user", None), (3, 5, "system", "S."), (3, 9, "user", "x " * 50_000 + "."),
        (4, 2**62, "user", "Ä."), (4, 2**62 + 7, "assistant", "\U0001f600."),
    ]
    compare(spark, rows)
    compare(spark, [])


def test_lost_conversation(spark):
    turn = next(t for t in range(1_000) if crc32(f"8:{t}".encode()) % 20 == 0)
    compare(spark, [(8, turn, "user", "Gone.")])
    assert repair_damaged(table(spark, [(8, turn, "user", "Gone.")])).first()["audit"] == ""


def test_turns_in_order(spark):
    """The operator returns each row with its edit, and inserted rows where they belong."""
    rows = [(1, i, r, f"{i}.") for i, r in enumerate(["assistant", "user", "user", "assistant", "assistant"])]
    got = [(r["turn"], r["edit"], r["role"], r["text"], r["cost"]) for r in repair(table(spark, rows)).collect()]
    assert [e for _, e, *_ in got] == list(cheapest([(r[2][0], False, False) for r in rows])[1])
    assert [t for t, *_ in got if t is not None] == [0, 1, 2, 3, 4]
    assert sum(c for *_, c in got) == digest(repair(table(spark, rows))).first()["cost"]
    roles = [r for _, e, r, *_ in got if e != "D"]
    assert roles == ["user", "assistant"] * (len(roles) // 2)


@pytest.mark.parametrize("size", [3_000])
def test_long_conversation(spark, size):
    dice = random.Random(8)
    rows = [(c, t, dice.choice(["user", "assistant", "assistant"]), f"{t} {dice.choice('.,')}") for c in (1, 2) for t in range(size)]
    got = {r["conv_id"]: (r["cost"], r["audit"]) for r in repair_damaged(table(spark, rows)).collect()}
    for conv, own in damage(rows).items():
        seen, kinds = set(), []
        for t, r, x in own:
            kinds.append((r[0], not x.strip() or (r, x) in seen, x.strip()[-1:] not in ".!?"))
            seen.add((r, x))
        paths, moves = Survivors(), []
        for i, forced, late in kinds:
            moves += paths.step(i, forced, late and not forced)
        cost, rest = paths.end()
        assert got[conv] == (cost, "".join(e for e, _ in moves + rest))
