import hashlib
import itertools
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from frostgrid.llm import conversations as module
from frostgrid.llm.conversations import ENDS, START, cheapest, conversation_digests, joined_ways, repair_conversations
from frostgrid.llm.queries import QUERIES, damaged
from frostgrid.sources import read_table

SCHEMA = "conv_id bigint, turn bigint, role string, text string, part int, copies string"
NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
GOOD = re.compile("(s?(ua)+)?")


def least_edits(rows):
    """(cost, audit, repaired) by dynamic programming over rows (role, text, must go, truncated) and results so far."""
    automaton = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "", ())}

    def offer(table, state, label):
        if state not in table or label[:2] < table[state][:2]:
            table[state] = label

    def inserted(table):
        todo = list(table)
        while todo:
            state = todo.pop()
            cost, audit, turns = table[state]
            for role in automaton[state].replace("s", ""):
                label = cost + 5, audit + "I", (*turns, ({"u": "user", "a": "assistant"}[role], ""))
                if role not in table or label[:2] < table[role][:2]:
                    table[role] = label
                    todo.append(role)
        return table

    best = inserted(best)
    for role, text, gone, cut in rows:
        after = {}
        for state, (cost, audit, turns) in best.items():
            offer(after, state, (cost + 2, audit + "D", turns))
            for r in "" if gone else automaton[state]:
                if role[:1] == r:
                    offer(after, r, (cost + 5 * cut, audit + "K", (*turns, (role, text))))
                elif r != "s":
                    name = {"u": "user", "a": "assistant"}[r]
                    offer(after, r, (cost + 1 + 5 * cut, audit + "R", (*turns, (name, text))))
        best = inserted(after)
    return min((best[s] for s in ("", "a") if s in best), key=lambda x: x[:2])


def judged(turns):
    """The digest row of one conversation from its rows (turn, role, text)."""
    turns = sorted(
        ((t, " " if r is None else r, " " if x is None else x) for t, r, x in turns),
        key=lambda row: (row[0] is not None, row[0] or 0, row[1].encode(), row[2].encode()),
    )
    seen, rows, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in turns:
        words = text.strip(" \t\n\v\f\r")
        fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        rows.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    numbers = [t for t, _, _ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    cost, audit, repaired = least_edits(rows)
    assert GOOD.fullmatch("".join(role[0] for role, _ in repaired))
    sha = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in repaired).encode()).hexdigest()
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, sha


def damage(row):
    conv, turn, role, text = (" " if x is None else x for x in row)
    fault = zlib.crc32(f"{conv}:{turn}".encode()) % 20
    text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
    out = (row[1], "user" if fault == 4 else role, text)
    return [out] * (0 if fault == 0 else 2 if fault == 3 else 1)


def brute(rows, change=lambda row: [row[1:]]):
    groups = {}
    for row in rows:
        groups.setdefault(row[0], []).extend(change(row))
    return sorted(((i, *judged(turns)) for i, turns in groups.items()), key=repr)


def digests(df):
    return sorted((tuple(r) for r in conversation_digests(df).select(*NAMES).collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def some_rows(seed, conversations, longest):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "agent", "s"]
    texts = ["Yes.", "no", "Why?", " \t", "", None, "ends. \n", "x!", "long " * 30, "\x1c", "é?"]
    rows = []
    for i in range(conversations):
        conv = None if i == 0 else i
        for t in range(rng.randint(1, longest)):
            turn = rng.choice([None, t, t, t, t, t // 2, t + 3, -t])
            role = rng.choice(roles) if rng.random() < 0.4 else ("user", "assistant")[t % 2]
            text = rng.choice(texts) if rng.random() < 0.4 else f"turn {rng.random()}."
            rows += [(conv, turn, role, text)] * rng.choice([1, 1, 1, 1, 2, 3])
    return rows


ODD = [
    (None, None, None, None), (None, 1, "user", "a."), (7, None, "user", "a."), (7, None, "user", "b."),
    (7, 3, "assistant", "c"), (8, 0, "", ""), (9, -(2**63), "user", "a."), (9, 2**63 - 1, "assistant", "b."),
    *[(10, 0, "user", "same.")] * 900, *[(10, 1, "assistant", "same.")] * 5, (11, 0, "system", "only."),
    *[(12, i, "tool", f"{i}.") for i in range(60)], *[(13, i, "user", f"{i % 7}.") for i in range(300)],
]


@pytest.mark.parametrize("limit", [module.PART_TURNS, 3, 1])
def test_odd_rows(spark, limit):
    """Also cut into parts so small that nearly all conversations have several."""
    rows = ODD + some_rows(limit, 40, 14)
    expected = brute(rows)
    expected = [(i, min(g, 2**63 - 1), *rest) for i, g, *rest in expected]
    assert digests(repair_conversations(frame(spark, rows), part_turns=limit)) == sorted(expected, key=repr)
    assert repair_conversations(frame(spark, rows).where("false")).count() == 0


def test_long_conversation_in_many_tasks(spark):
    rng = random.Random(3)
    roles = ["user", "assistant", "tool", "system"]
    rows = [(1, t, rng.choice(roles), f"{rng.randint(0, 2000)}{rng.choice(['.', '', '!'])}") for t in range(4000)]
    rows += [(i, t, "user", "x.") for i in range(2, 30) for t in range(3)]
    assert digests(repair_conversations(frame(spark, rows))) == brute(rows)
    parts = repair_conversations(frame(spark, rows)).where("conv_id = 1").count()
    assert parts >= 4000 // module.PART_TURNS


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_the_table(spark, scale):
    sf_dir = f"/root/testdata/{scale}"
    rows = [tuple(r) for r in read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op13_conversation_repair"](spark, sf_dir)
    assert got.columns == NAMES
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, damage)


def test_damage_and_conversations_that_lose_all(spark):
    rows = some_rows(9, 60, 6) + [(i, None, None, None) for i in range(100, 160)]
    got = sorted((tuple(r)[:4] for r in damaged(frame(spark, rows)).select("conv_id", "turn", "role", "text").collect()), key=repr)
    assert got == sorted(((r[0], *d) for r in rows for d in damage(r)), key=repr)


column = st.one_of(st.integers(1, 3), st.tuples(st.sampled_from(["s", "u", "a", "t", ""]), st.booleans()))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(column, max_size=5), min_size=1, max_size=5))
def test_both_ways_and_parts_find_the_least(parts):
    rows = []
    for c in itertools.chain(*parts):
        rows += [("x", "", True, False)] * c if isinstance(c, int) else [(c[0], "", False, c[1])]
    cost, audit, _ = least_edits(rows)
    assert cheapest(tuple(itertools.chain(*parts)), START, ENDS) == (cost, audit)
    ways = [[(w["enter"], w["leave"], w["cost"], w["audit"]) for w in module._ways(tuple(p), range(4))] for p in parts]
    found = joined_ways(ways)
    assert (sum(c for _, c, _ in found), "".join(a for _, _, a in found)) == (cost, audit)
