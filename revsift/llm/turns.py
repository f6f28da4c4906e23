"""Conversation structure repair by square-root checkpointed dynamic programming (operator 11).

A conversation should read as an optional system row and then user and assistant
in turns. Keeping a row costs 0, giving it the role that is due 2, deleting it 3,
inserting an empty row 2; blank and repeated rows must go, and a row whose text
breaks off costs 1 if it stays. ``audit`` holds the initials of the cheapest
edits (Delete, Insert, Keep, Rerole) in order, the ASCII-least of them.

Only one byte for each row enters the program: its fault and its role's initial.
It has four states (nothing yet, after system, after user, after assistant), so
what a stretch of rows costs from each state to each state is a 4 x 4 matrix.
Backward vectors of the four costs are stored at every sqrt(n)-th row only, and a
walk forward computes those between two of them again, block by block.

The bytes are sorted over the cluster by conversation and turn. A conversation
that lies inside one partition, in fewer rows than PIECE, is solved where it is.
Any other is cut into pieces of at most PIECE rows: each piece gives its matrix,
their product from behind the cost vector at the end of each piece, each piece is
then walked from all four states, and the states are chained from the front. So a
conversation that holds a third of all rows is worked on by many tasks; one task
sees its matrices, one row for each piece. Its audit is one value, as is the
digest of its repaired text, which ``repaired`` gives to one task as a sorted
stream that never is in memory as a whole.

Defined cases: null roles and texts count as one space. Rows without a
conversation id are one conversation; rows without a turn come first; rows with
one turn are ordered by role and a digest of the text, so that repeated rows are
neighbours. A role that does not start with s, u or a can only be deleted or
given another role. A conversation of no rows has zeros and an empty audit. Other
columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revsift.llm.common import written

SPACES = " \t\n\x0b\f\r"
PIECE = 1 << 16
# fixed values: the initials of roles, the faults and the edits
INITIALS, FAULTS, ROLE = "sua", ["clean", "blank", "duplicate", "truncated"], {1: "user", 2: "assistant"}
KEEP, REROLE, DELETE, INSERT, BROKEN = 0, 2, 3, 2, 1
FAR = 1 << 60
ORDER = ["conv", "turn", "role", "d1", "d2"]
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

Costs = tuple[int, int, int, int]
END: Costs = (0, 2 * INSERT, INSERT, 0)  # from each state: what still has to be inserted at the end
DUE = (2, 2, 3, 2)  # the state after the user or assistant row that is due


def kept_state(state: int, initial: int) -> int | None:
    """The state after a row with this initial is kept, or None where it may not stand."""
    if initial == 0:
        return 1 if state == 0 else None
    return DUE[state] if initial == (2 if state == 2 else 1) else None


def before(code: int, after: Costs) -> Costs:
    """The costs before a row, from those after it; rows inserted before it are counted in."""
    fault, initial = code >> 2, code & 3
    out = [c + DELETE for c in after]
    if fault in (0, 3):
        stays = BROKEN if fault == 3 else 0
        for state in range(4):
            kept = kept_state(state, initial)
            out[state] = min(out[state], after[DUE[state]] + REROLE + stays, FAR if kept is None else after[kept] + KEEP + stays)
    a, b, c, d = out
    return min(a, c + INSERT, d + 2 * INSERT), min(b, c + INSERT, d + 2 * INSERT), min(c, d + INSERT), min(d, c + INSERT)


def walk(codes: bytes, end: Costs, states: list[int]) -> tuple[Costs, list[str], list[int]]:
    """From each of ``states``: the costs at the front, the edits of all rows, and the state after them."""
    step, costs, stored = isqrt(len(codes)) + 1, end, {}
    for i in range(len(codes) - 1, -1, -1):
        if (i + 1) % step == 0:
            stored[i + 1] = costs
        costs = before(codes[i], costs)
    front, states, edits = costs, list(states), [[] for _ in states]
    for first in range(0, len(codes), step):
        last = min(first + step, len(codes))
        block = [stored.get(last, end) if last < len(codes) else end]
        for i in range(last - 1, first - 1, -1):
            block.append(before(codes[i], block[-1]))
        block.reverse()
        for i in range(first, last):
            for k, state in enumerate(states):
                states[k] = _edit(codes[i], block[i - first], block[i - first + 1], state, edits[k])
    return front, ["".join(e) for e in edits], states


def _edit(code: int, here: Costs, after: Costs, state: int, edits: list[str]) -> int:
    """Appends the ASCII-least tight edits up to and with one row; returns the state after it."""
    fault, initial = code >> 2, code & 3
    while True:
        left = here[state]
        if after[state] + DELETE == left:
            edits.append("D")
            return state
        if here[DUE[state]] + INSERT == left:
            edits.append("I")
            state = DUE[state]
            continue
        stays, kept = BROKEN if fault == 3 else 0, kept_state(state, initial)
        keep = kept is not None and after[kept] + KEEP + stays == left
        edits.append("K" if keep else "R")
        return kept if keep else DUE[state]


def matrix(codes: bytes) -> list[int]:
    """The costs of a stretch of rows from each state to each state, row by row."""
    columns = []
    for j in range(4):
        costs: Costs = tuple(0 if k == j else FAR for k in range(4))
        for code in reversed(codes):
            costs = before(code, costs)
        columns.append(costs)
    return [min(columns[j][i], FAR) for i in range(4) for j in range(4)]


@lru_cache(1 << 16)
def solved(codes: bytes) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    costs, (edits,), (state,) = walk(codes, END, [0])
    return costs[0], edits + "I" * (END[state] // INSERT)


def counts(codes: bytes) -> tuple[int, int, int, int]:
    """Blank, duplicate, truncated rows, and neighbours whose roles do not follow each other."""
    kinds, roles = np.frombuffer(codes, np.uint8) >> 2, np.frombuffer(codes, np.uint8) & 3
    pair = roles[:-1] * 4 + roles[1:]
    return (*(int((kinds == k).sum()) for k in (1, 2, 3)), int((~np.isin(pair, [1, 6, 9])).sum()))


def damage(rows: DataFrame) -> DataFrame:
    """The damage that the query repairs: by crc32(conv_id:turn) % 20, 0 drops a row, 1 empties its text, 2 takes its
    sentence ends out, 3 repeats it, 4 makes its role user. Nulls count as one space."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = F.crc32(F.concat_ws(":", told("conv_id"), told("turn")).cast("binary")) % 20
    text = F.when(way == 1, "").when(way == 2, F.translate(told("text"), ".!?", "")).otherwise(told("text"))
    return (rows.where(way != 0).withColumn("_n", F.explode(F.array_repeat(F.lit(0), F.when(way == 3, 2).otherwise(1))))
            .select("conv_id", "turn", F.when(way == 4, "user").otherwise(told("role")).alias("role"), text.alias("text")))


def _conv() -> Column:
    """A text that names the conversation and is never null."""
    return F.coalesce(F.concat(F.lit(":"), F.col("conv_id").cast("string")), F.lit(""))


def _lines(rows: DataFrame) -> DataFrame:
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return rows.select(_conv().alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
                       F.xxhash64(role, text).alias("d1"), F.xxhash64(F.lit(7), text, role).alias("d2"), text.alias("text"))


def _codes(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row for all equal rows: ORDER and ``n``, how many; and again with ``code`` of the first and ``again`` of the others."""
    ends = F.substring(F.rtrim(F.col("text"), F.lit(SPACES)), -1, 1)
    fault = F.when(ends == "", 1).when(~ends.isin(".", "!", "?"), 3).otherwise(0)
    initial = F.substring("role", 1, 1)
    number = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    own = written(lines.select(*ORDER, fault.alias("fault"), number.alias("initial")).groupBy(*ORDER, "fault", "initial").agg(F.count(F.lit(1)).alias("n")), "turn-codes")
    # rows that come again in a later turn; rows without a turn come first
    same = ["conv", "d1", "d2"]
    seen = written(own.groupBy(*same).agg(F.min("turn").alias("least"), F.max(F.col("turn").isNull()).alias("none"), F.count(F.lit(1)).alias("times"))
                   .where("times > 1").drop("times"), "turn-copies")
    later = F.coalesce(F.when(F.col("none"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("least")), F.lit(False))
    fault = F.when((F.col("fault") != 1) & later, 2).otherwise(F.col("fault"))
    return own, (own.join(seen, same, "left").withColumn("fault", fault)
            .select(*ORDER, (F.col("fault") * 4 + F.col("initial")).alias("code"), (F.when(F.col("fault") == 1, 4).otherwise(8) + F.col("initial")).alias("again"), "n"))


PIECES = ("conv string, part int, seq int, whole boolean, codes binary, audit string, cost bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
          "head int, tail int, matrix array<bigint>")


def _pieces(batches: Iterator[pd.DataFrame], piece: int) -> Iterator[pd.DataFrame]:
    """Sorted codes to conversations, those that lie inside the partition solved, and pieces of others."""
    part, out = TaskContext.get().partitionId(), []
    conv, held, seq, first = None, bytearray(), 0, True

    def emit(whole: bool) -> None:
        nonlocal seq
        codes = bytes(held)
        cost, audit = solved(codes) if whole else (0, None)
        out.append((conv, part, seq, whole, None if whole else codes, audit, cost, *counts(codes), codes[0] & 3, codes[-1] & 3, None if whole else matrix(codes)))
        held.clear()
        seq += 1

    def add(codes: bytes) -> None:
        held.extend(codes)
        while len(held) > piece:
            rest = bytes(held[piece:])
            del held[piece:]
            emit(False)
            held.extend(rest)

    def told() -> pd.DataFrame:
        done = pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")])
        out.clear()
        return done

    for batch in batches:
        names, code, again, n = (batch[c].to_numpy() for c in ("conv", "code", "again", "n"))
        cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1), len(names)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if names[a] != conv:
                if conv is not None:
                    emit(not first and seq == 0)
                    first = False
                conv, seq = names[a], 0
            if (n[a:b] == 1).all():
                add(code[a:b].astype(np.uint8).tobytes())
                continue
            for c, d, k in zip(code[a:b], again[a:b], n[a:b], strict=True):
                add(bytes([c]))
                for left in range(int(k) - 1, 0, -piece):
                    add(bytes([d]) * min(left, piece))
        if len(out) >= 1000:
            yield told()
    if conv is not None:
        emit(False)
    yield told()


def _ends(group: pd.DataFrame) -> pd.DataFrame:
    """The cost vector after each piece of one conversation, the cost of it all, and faults between its pieces."""
    group = group.sort_values(["part", "seq"]).reset_index(drop=True)
    costs, ends = np.array(END), []
    for m in reversed(group["matrix"].tolist()):
        ends.append(costs.tolist())
        costs = np.minimum((np.asarray(m).reshape(4, 4) + costs).min(axis=1), FAR)
    pair = group["tail"].to_numpy()[:-1] * 4 + group["head"].to_numpy()[1:]
    between = np.append(~np.isin(pair, [1, 6, 9]), False).astype(int)
    return group[["conv", "part", "seq"]].assign(ends=ends[::-1], last=group.index == len(group) - 1, cost=[int(costs[0])] + [0] * (len(group) - 1), between=between)


def _walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each piece from all four states; the last also gets what is inserted at the end."""
    for batch in batches:
        audits, outs = [], []
        for codes, ends, last in zip(batch["codes"], batch["ends"], batch["last"], strict=True):
            _, edits, states = walk(codes, tuple(int(x) for x in ends), [0, 1, 2, 3])
            audits.append([e + "I" * (END[s] // INSERT if last else 0) for e, s in zip(edits, states, strict=True)])
            outs.append(states)
        yield batch[["conv", "part", "seq", "cost", "blank", "duplicate", "truncated", "illegal"]].assign(audits=audits, outs=outs)


def _starts(group: pd.DataFrame) -> pd.DataFrame:
    """The state before each piece of one conversation."""
    group, state, starts = group.sort_values(["part", "seq"]), 0, []
    for outs in group["outs"]:
        starts.append(state)
        state = int(outs[state])
    return group[["conv", "part", "seq"]].assign(start=starts)


def plan_repairs(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost and audit for each conversation of ``rows(conv_id, turn, role, text)``."""
    own, codes = _codes(_lines(rows))
    # stored sorted: the lines are counted and cut in the order in which ``repaired`` meets them
    sorted_codes = codes.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).select("conv", "code", "again", "n")
    pieces = written(sorted_codes.mapInPandas(lambda batches: _pieces(batches, piece), PIECES), "turn-pieces")
    key = ["conv", "part", "seq"]
    cut = pieces.where("NOT whole")
    ends = cut.select(*key, "head", "tail", "matrix").groupBy("conv").applyInPandas(
        _ends, "conv string, part int, seq int, ends array<bigint>, last boolean, cost bigint, between bigint")
    linked = (cut.select(*key, "codes", "blank", "duplicate", "truncated", "illegal").join(written(ends, "turn-ends"), key)
              .withColumn("illegal", F.col("illegal") + F.col("between")).drop("between"))
    walked = written(linked.mapInPandas(_walked, "conv string, part int, seq int, cost bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
                                                 "audits array<string>, outs array<int>"), "turn-walks")
    starts = written(walked.select(*key, "outs").groupBy("conv").applyInPandas(_starts, "conv string, part int, seq int, start int"), "turn-starts")
    sums = ["blank", "duplicate", "truncated", "illegal", "cost"]
    whole = (walked.join(starts, key).withColumn("audit", F.get("audits", F.col("start")))
             .groupBy("conv").agg(*[F.sum(c).alias(c) for c in sums], F.sort_array(F.collect_list(F.struct("part", "seq", "audit"))).alias("parts"))
             .select("conv", *sums, F.array_join(F.col("parts")["audit"], "").alias("audit")))
    turns = own.groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    return pieces.where("whole").select("conv", *sums, "audit").unionByName(whole).join(turns, "conv").select("conv", *COUNTS, "audit")


def _edits(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, str, list | None, str | None, str | None, str | None]]:
    """Of the sorted stream of plans and lines: ("plan", conv, counts, audit, ...) and ("row", conv, None, edit, role, text)."""
    conv, audit, at, state = None, "", 0, 0

    def inserted():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            at, state = at + 1, DUE[state]
            yield "row", conv, None, "I", ROLE[state - 1], ""

    for batch in batches:
        for is_line, name, found, role, text in zip(batch["is_line"], batch["conv"], batch["counts"], batch["role"], batch["text"], strict=True):
            if not is_line:
                yield from inserted()
                conv, audit, at, state = name, text, 0, 0
                yield "plan", conv, found, audit, None, None
                continue
            yield from inserted()
            edit, at = audit[at], at + 1
            if edit == "D":
                yield "row", conv, None, edit, None, None
                continue
            state = kept_state(state, INITIALS.find(role[:1]) if role[:1] else 3) if edit == "K" else DUE[state]
            yield "row", conv, None, edit, role if edit == "K" else ROLE[state - 1], text
    yield from inserted()


def _stream(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Each plan and then its lines, in order; a conversation is read by one task, as a stream."""
    lines = _lines(rows).select(*ORDER, F.lit(True).alias("is_line"), F.lit(None).cast("array<bigint>").alias("counts"), "text")
    heads = plan.select("conv", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(0).cast("long").alias("d1"), F.lit(0).cast("long").alias("d2"),
                        F.lit(False).alias("is_line"), F.array(*COUNTS).alias("counts"), F.col("audit").alias("text"))
    return lines.unionByName(heads).repartition("conv").sortWithinPartitions("conv", "is_line", *ORDER[1:]).select("conv", "is_line", "counts", "role", "text")


def _in_frames(found: Iterator[tuple], columns: list[str], size: int = 256) -> Iterator[pd.DataFrame]:
    held: list[tuple] = []
    for row in found:
        held.append(row)
        if len(held) == size:
            yield pd.DataFrame(held, columns=columns)
            held = []
    yield pd.DataFrame(held, columns=columns)


def repaired(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The repaired conversations: conv, position, edit, role and text of each row that stays or is inserted."""

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def numbered() -> Iterator[tuple]:
            place = 0
            for kind, conv, _, edit, role, text in _edits(batches):
                place = 0 if kind == "plan" else place
                if kind == "row" and edit != "D":
                    yield conv, place, edit, role, text
                    place += 1

        return _in_frames(numbered(), ["conv", "position", "edit", "role", "text"])

    return _stream(rows, plan).mapInPandas(tell, "conv string, position bigint, edit string, role string, text string")


def repaired_digests(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The plan, with the sha256 of the repaired ``role:text``, joined by line feeds."""

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def digested() -> Iterator[tuple]:
            head = None
            for kind, conv, found, edit, role, text in _edits(batches):
                if kind == "plan":
                    if head:
                        yield *head, digest.hexdigest()
                    head, digest, some = (conv, found, edit), hashlib.sha256(), False
                elif edit != "D":
                    digest.update(f"{chr(10) if some else ''}{role}:{text}".encode())
                    some = True
            if head:
                yield *head, digest.hexdigest()

        return _in_frames(digested(), ["conv", "counts", "audit", "repaired_sha256"])

    return _stream(rows, plan).mapInPandas(tell, "conv string, counts array<bigint>, audit string, repaired_sha256 string")


def repair_conversations(rows: DataFrame, all_rows: DataFrame | None = None, piece: int = PIECE) -> DataFrame:
    """conv_id, the counts, cost, audit and repaired_sha256 of each conversation of ``all_rows`` (``rows`` where not given)."""
    whole = rows if all_rows is None else all_rows
    kind = whole.schema["conv_id"].dataType
    ids = whole.select(_conv().alias("conv")).distinct()
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS]
    plan = written(ids.join(plan_repairs(rows, piece), "conv", "left").select("conv", *zero, F.coalesce("audit", F.lit("")).alias("audit")), "turn-plans")
    told = repaired_digests(rows, plan)
    return told.select(F.when(F.col("conv") != "", F.expr("substring(conv, 2)")).cast(kind).alias("conv_id"),
                       *[F.col("counts")[i].alias(c) for i, c in enumerate(COUNTS)], "audit", "repaired_sha256")
