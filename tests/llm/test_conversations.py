"""Conversation repair against brute force."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from callwatch.llm import conversation_repair

BLANKS = " \t\n\x0b\x0c\r"
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
MADE = {0: "user", 1: "user", 2: "assistant", 3: "user"}
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
SCHEMA = "conv_id long, turn long, role string, text string"


def damage(rows):
    said = lambda v: " " if v is None else str(v)
    out = collections.defaultdict(list)
    for c, turn, role, text in rows:
        h = zlib.crc32(f"{said(c)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        kept = out[c]
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        kept += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def cheapest(rows, kinds):
    """Backward over (place, state): least cost, then least edits."""
    after = {q: min([(0, "")] * (q in (0, 3)) + [(5, "I")] * (q == 2) + [(10, "II")] * (q == 1)) for q in range(4)}
    for (_, role, _), kind in zip(reversed(rows), reversed(kinds)):
        now = {}
        for q in range(4):
            ways = [(2, "D", q)]
            if kind not in ("blank", "duplicate"):
                extra = 5 * (kind == "truncated")
                ways.append((1 + extra, "R", NEXT[q]))
                if (q, role[:1]) in KEPT:
                    ways.append((extra, "K", KEPT[q, role[:1]]))
            now[q] = min((c + after[p][0], x + after[p][1]) for c, x, p in ways)
        for _ in range(4):
            now = {q: min(now[q], (now[NEXT[q]][0] + 5, "I" + now[NEXT[q]][1])) for q in now}
        after = now
    return after[0]


def repaired(convs):
    out = {}
    for c, rows in convs.items():
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = {r[0] for r in rows} - {None}
        seen, kinds = set(), []
        for _, role, text in rows:
            end = text.rstrip(BLANKS)
            kinds.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, audit = cheapest(rows, kinds)
        state, given, lines = 0, iter(rows), []
        for x in audit:
            if x == "I":
                lines.append(MADE[state] + ":")
                state = NEXT[state]
                continue
            _, role, text = next(given)
            if x == "K":
                lines.append(f"{role}:{text}")
                state = KEPT[state, role[:1]]
            elif x == "R":
                lines.append(f"{MADE[state]}:{text}")
                state = NEXT[state]
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        counts = collections.Counter(kinds)
        out[c] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def got(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def invented(seed, convs, most):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "what?", "cut", "", " \n", None, "Yes. ", "a.b", "Ünder."]
    roles = ["system", "user", "assistant", "tool", None, "", "u2"]
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, most)):
            role = rng.choice(roles) if rng.random() < 0.2 else ("user", "assistant")[t % 2]
            rows.append((c if c else None, None if rng.random() < 0.05 else t // rng.choice([1, 1, 1, 2]), role, rng.choice(texts) if rng.random() < 0.5 else f"turn {t}."))
    return rows + rng.sample(rows, len(rows) // 10)


@pytest.mark.parametrize("block", [1, 3, 512])
def test_repairs_are_the_cheapest(spark, block):
    rows = invented(block, 60, 25) + [(1000, t, ("user", "assistant")[t % 2], f"long {t}." if t % 7 else "same") for t in range(150)]
    df = spark.createDataFrame(rows, SCHEMA)
    expected = repaired(damage(rows))
    assert got(conversation_repair.repaired_conversations(df, block)) == expected
    # an insertion costs more than the deletion that does instead; blocks use it
    assert {x for v in expected.values() for x in v[6]} == set("DKR")


def test_many_equal_rows_are_one_unit(spark):
    rows = [(1, 5, "user", "Same.")] * 400 + [(1, 6, "assistant", "Fine.")] * 300 + [(2, 0, "user", " ")] * 200
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert got(conversation_repair.repaired_conversations(df, 2)) == repaired(damage(rows))


def test_conversations_without_rows_and_empty_tables(spark):
    rows = [(c, t, "user", "Hi.") for c in range(40) for t in range(1)]
    expected = repaired(damage(rows))
    found = got(conversation_repair.repaired_conversations(spark.createDataFrame(rows, SCHEMA)))
    assert found == expected and any(v[6] == "" for v in found.values())
    assert conversation_repair.repaired_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_other_columns_and_long_texts(spark):
    rows = invented(9, 8, 6) + [(77, 0, "user", "x" * 300_000 + "."), (77, 1, "assistant", ". " * 100_000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("?") for c in ("n", "part", "block", "pos", "copies", "lot", "audit", "cost", "first", "rows")})
    assert got(conversation_repair.repaired_conversations(df)) == repaired(damage(rows))


def test_search_takes_the_least_of_equal_edits():
    # a lone user turn: deleting it (2) beats adding an answer (5)
    assert conversation_repair.cheapest([("u", False, 0)], 0, conversation_repair.ENDING) == (2, "D")
    # two user turns: either may become the assistant's, or both go at 4
    assert conversation_repair.cheapest([("u", False, 0), ("u", False, 0)], 0, conversation_repair.ENDING) == (1, "KR")
    # an answer alone: deleting costs 2, a question before it 5
    assert conversation_repair.cheapest([("a", False, 0), ("u", False, 0), ("a", False, 0)], 0, conversation_repair.ENDING) == (2, "DKK")
    # but one unit that must go, from nothing to the state after an answer
    assert conversation_repair.cheapest([("", False, 1)], 0, [conversation_repair.NEVER] * 3 + [0]) == (12, "IID")
