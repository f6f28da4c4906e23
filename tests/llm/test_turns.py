"""Conversation repair against a forward search that keeps whole edit strings."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from revsift.llm import turns

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        told = lambda x: " " if x is None else str(x)
        way, role, text = zlib.crc32(f"{told(conv)}:{told(turn)}".encode()) % 20, told(role), told(text)
        if way:
            text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
            out += [(conv, turn, "user" if way == 4 else role, text)] * (2 if way == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "clean")
        seen.add((role, text))
    return out


def least(rows):
    """Of all edits by cost, then by their string: initials so far -> (cost, audit, repaired). Only what the grammar can still complete is kept."""
    def state(initials):
        return initials[-1:] if initials[-1:] != "s" else "s" if initials == "s" else "x"

    def insert(found):
        for _ in range(3):
            for key, (cost, audit, kept) in list(found.items()):
                for role in ("user", "assistant"):
                    add(found, key + role[0], (cost + 2, audit + "I", [*kept, (role, "")]))
        return found

    def add(found, initials, value):
        if re.fullmatch(r"s?(ua)*u?", initials):
            short = initials if len(initials) < 2 else ("s" if initials[0] == "s" else "") + "ua" * (initials[-1] == "a") + "u" * (initials[-1] == "u")
            short = short.lstrip("s") if len(initials) > 1 else short  # what came before the last row does not matter any more
            if short not in found or value[:2] < found[short][:2]:
                found[short] = value

    found = insert({"": (0, "", [])})
    for (_, _, role, text), fault in zip(rows, faults(rows), strict=True):
        after = {}
        for key, (cost, audit, kept) in found.items():
            add(after, key, (cost + 3, audit + "D", kept))
            if fault in ("clean", "truncated"):
                broken = fault == "truncated"
                if role[:1] in ("s", "u", "a"):
                    add(after, key + role[0], (cost + broken, audit + "K", [*kept, (role, text)]))
                for new in ("user", "assistant"):
                    add(after, key + new[0], (cost + 2 + broken, audit + "R", [*kept, (new, text)]))
        found = insert(after)
    return min(v for k, v in found.items() if k == "" or k.endswith("a"))


def expected(rows, ids):
    out = {}
    for conv in ids:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        when, kinds = [r[1] for r in mine if r[1] is not None], faults(mine)
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(mine, mine[1:], strict=False)]
        cost, audit, kept = least(mine)
        assert GRAMMAR.fullmatch("".join(r[0] for r, _ in kept))
        text = "\n".join(f"{a}:{b}" for a, b in kept)
        out[conv] = (max(when) - min(when) + 1 - len(set(when)) if when else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")),
                     sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def conversations(r, count, longest):
    rows = []
    for conv in range(count):
        texts = ["Yes.", "No!", "Why", "  ", "", "Well?\n ", "a. b", "é ß. "]
        for turn in range(r.randint(1, longest)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "Ua", "side"])
            rows.append((conv, r.choice([turn, turn, turn, turn * 2]), role, r.choice([*texts, f"words {turn}.", f"others {conv} {turn}", f"some {turn}!"])))
    return rows


def same_turns_differ(rows):
    seen = set()
    return [x for x in rows if (x[0], x[1]) not in seen and not seen.add((x[0], x[1]))]


def as_dict(df):
    return {x["conv_id"]: tuple(x[c] for c in (*turns.COUNTS, "audit", "repaired_sha256")) for x in df.collect()}


@pytest.mark.parametrize("piece", [1 << 16, 3])
def test_repairs_equal_brute_force(spark, piece):
    r = random.Random(piece)
    rows = same_turns_differ(conversations(r, 60, 9)) + same_turns_differ([(700, k, r.choice(["user", "assistant", "system"]), r.choice(["a.", f"b{k}", f"c{k}."])) for k in range(150)])
    rows += [(None, 1, "user", "No id."), (None, 2, "assistant", "None."), (701, None, "user", "First."), (701, 4, None, "x."), (701, 5, "user", None), (702, None, "user", "Alone.")]
    rows += [(703, 3, "user", "Same.")] * 3 + [(k, 0, "user", "Here.") for k in range(800, 930)]
    r.shuffle(rows)
    frame = spark.createDataFrame(rows, SCHEMA)
    got = as_dict(turns.repair_conversations(turns.damage(frame), frame, piece))
    assert got == expected(damaged(rows), {x[0] for x in rows})
    assert any(v == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for v in got.values())


def test_query_equals_brute_force(spark):
    import __spark_entry__ as E

    rows = [tuple(x) for x in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert as_dict(E.queries()["op11_conversation_repair"](spark, SF)) == expected(damaged(rows), {x[0] for x in rows})


def test_walks_by_pieces_equal_one_walk():
    r = random.Random(3)
    for _ in range(200):
        codes = bytes(r.randrange(16) for _ in range(r.randint(1, 60)))
        costs, audit = turns.solved(codes)
        cut = sorted(r.sample(range(len(codes) + 1), min(3, len(codes))))
        parts = [codes[a:b] for a, b in zip([0, *cut], [*cut, len(codes)], strict=True) if a < b]
        ends = [turns.END]
        for p in reversed(parts[1:]):
            m = turns.matrix(p)
            ends.append(tuple(min(min(m[4 * i + j] + ends[-1][j] for j in range(4)), turns.FAR) for i in range(4)))
        state, told = 0, ""
        for p, end in zip(parts, reversed(ends), strict=True):
            front, (edits,), (after,) = turns.walk(p, end, [state])
            assert told or front[0] == costs
            told, state = told + edits, after
        assert told + "I" * (turns.END[state] // 2) == audit


def test_repaired_rows_and_odd_tables(spark):
    rows = [(1, 0, "system", "Be good."), (1, 1, "assistant", "Hello."), (1, 2, "user", " "), (2, 5, "tool", "x.")]
    frame = spark.createDataFrame([(*x, "extra", "mine") for x in rows], SCHEMA + ", audit string, conv string")
    plan = turns.plan_repairs(frame)
    assert {x["conv"]: x["audit"] for x in plan.collect()} == {":1": "KIKD", ":2": "D"}
    found = sorted(tuple(x) for x in turns.repaired(frame, plan).collect())
    assert found == [(":1", 0, "K", "system", "Be good."), (":1", 1, "I", "user", ""), (":1", 2, "K", "assistant", "Hello.")]
    assert turns.repair_conversations(frame.where("false")).count() == 0
    named = turns.repair_conversations(frame.withColumn("conv_id", F.concat(F.lit("c"), F.col("conv_id"))))
    assert {x["conv_id"] for x in named.collect()} == {"c1", "c2"}
