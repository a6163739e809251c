import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from genoloom.llm import repair, scratch

TEXTS = ["Fine.", "Well!", "cut off", "", " \n", "Fine.", "ends so.  \n", "So?"]
GRAMMAR = re.compile(r"(s?(ua)+)?")


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        if bare:
            seen.add((role, text))
    return out


def brute(rows):
    """Cost, audit and roles by a table of the best (cost, letters) from each turn and state, inserting anywhere."""
    faults, memo = faults_of(rows), {}
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    def best(i, state, left=2):
        key = i, state, left
        if key not in memo:
            found = []
            if i == len(rows):
                if state in ("", "a"):
                    found.append((0, "", ()))
            else:
                role, text = rows[i]
                stays = (faults[i] == "truncated") * 1
                found.append(step(3, "D", (), best(i + 1, state)))
                if faults[i] in ("", "truncated"):
                    if role[:1] in after[state]:
                        found.append(step(stays, "K", (f"{role}:{text}",), best(i + 1, after[state][role[:1]])))
                    found += [step(2 + stays, "R", (f"{r}:{text}",), best(i + 1, after[state][r[0]])) for r in ("user", "assistant") if r[0] in after[state]]
            if left:
                found += [step(2, "I", (f"{r}:",), best(i, after[state][r[0]], left - 1)) for r in ("user", "assistant") if r[0] in after[state]]
            memo[key] = min((x for x in found if x), default=None)
        return memo[key]

    def step(cost, letter, line, rest):
        return rest and (rest[0] + cost, letter + rest[1], line + rest[2])

    return best(0, "")


def summary(rows):
    """What the query returns for (turn, role, text) rows in order, by brute force."""
    if not rows:
        return 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()
    turns = {t for t, _, _ in rows if t is not None}
    faults = faults_of([x[1:] for x in rows])
    initials = [r[:1] for _, r, _ in rows]
    cost, audit, lines = brute([x[1:] for x in rows])
    assert GRAMMAR.fullmatch("".join(x[0] for x in lines))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(x) for x in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def damaged(conv, rows):
    out = []
    for turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))


def test_all_short_conversations():
    """Every sequence of up to three turns of every kind, and of five of the commoner ones, by the layers and by brute force."""
    kinds = [(r, t) for r in ("system", "user", "assistant", "tool") for t in ("ok.", "cut", "")]
    cases = [c for n in range(1, 4) for c in product(kinds, repeat=n)] + list(product([("user", "ok."), ("assistant", "ok."), ("assistant", "cut"), ("system", "ok.")], repeat=5))
    for rows in cases:
        rows = [(r, t if t != "ok." else f"{i}.") for i, (r, t) in enumerate(rows)]
        cost, audit, lines = brute(rows)
        turns = [{"number": i, "initial": r[:1], "fault": repair.FAULTS.index(f)} for i, ((r, _), f) in enumerate(zip(rows, faults_of(rows), strict=True))]
        letters, state = repair.block_traces(turns, [repair.ENDS[s][0] for s in repair.STATES])[repair.START]
        assert "".join(letters) + "I" * len(repair.ENDS[state][1]) == audit, rows
        edits = list(repair.edits_of(turns, letters, repair.START, True))
        assert [x for e, (r, t) in zip(edits, rows, strict=True) for x in [*(f"{b}:" for b in e["before"]), *([] if e["edit"][-1] == "D" else [f"{e['new_role'] or r}:{t}"]), *(f"{a}:" for a in e["after"])]] == list(lines)


def test_costs_between_states():
    rng = random.Random(4)
    for _ in range(60):
        turns = [{"number": i, "initial": rng.choice("suat"), "fault": rng.choice([0, 0, 3, 1])} for i in range(rng.randrange(9))]
        cut = rng.randrange(len(turns) + 1)
        ends = [repair.ENDS[s][0] for s in repair.STATES]
        parts = repair.through(repair.block_costs(turns[:cut]), repair.through(repair.block_costs(turns[cut:]), ends))
        assert parts == repair.through(repair.block_costs(turns), ends)


def conversations(seed, n, most):
    rng = random.Random(seed)
    out = {}
    for c in range(n):
        rows = []
        for turn in range(rng.choice([1, 2, 5, most])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            rows.append((rng.choice([turn, turn, turn * 3, None]), role, rng.choice([*TEXTS, None, f"{turn}.", f"{turn}!"])))
        out[None if c == 3 else c * 7] = rows
    return out


@pytest.mark.parametrize("block, fan", [(64, 64), (3, 2)])
def test_query_against_brute_force(spark, monkeypatch, block, fan):
    """With blocks of three turns and two parts a group, dialogues go through several levels."""
    monkeypatch.setattr(repair, "FAN", fan)
    given = conversations(5, 60, 40)
    given[1_000] = []
    given[1_001] = [(t, "user", "same.") for t in range(50)] + [(None, None, None)] * 3
    df = spark.createDataFrame([(c, *x, "c") for c, rows in given.items() for x in rows], "conv_id long, turn long, role string, text string, COST string")
    got = {r[0]: tuple(r[1:]) for r in repair.audited(df, block=block).collect()}
    want = {c: summary(damaged(c, rows)) for c, rows in given.items() if rows}
    assert set(got) == set(want)
    for c in want:
        assert got[c] == want[c], (c, damaged(c, given[c]))


def test_repaired_rows_and_empty_tables(spark):
    df = spark.createDataFrame([("x", 1, "user", "Hi."), ("x", 2, "user", "And?"), ("y", 5, "assistant", "Yes.")], "name string, at long, who string, said string")
    own = scratch.Scratch(spark, "repair-test")
    edits = repair.repair(df, own, "name", "at", "who", "said")
    rows = sorted(repair.repaired(edits).collect(), key=lambda r: (r.conv_id, r.place, r.nth))
    # inserting costs 2 and so does renaming: I comes before R
    assert [(r.conv_id, r.role, r.text) for r in rows] == [("x", "user", "Hi."), ("x", "assistant", "And?"), ("y", "user", ""), ("y", "assistant", "Yes.")]
    empty = df.filter("false")
    assert repair.repair(empty, own, "name", "at", "who", "said").count() == 0
    assert repair.audited(empty, "name", "at", "who", "said").count() == 0
