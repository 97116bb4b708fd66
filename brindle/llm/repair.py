"""Conversation structure repair by composed finite-state machines.

A conversation should read ``(s?(ua)+)?`` by its roles' initials, without blank,
repeated or broken-off turns. Three machines say what may be done about it:

* the input acceptor: the conversation's turns in order, each with its role's
  initial and its first fault;
* the edit transducer: Keep (0), Rerole to user or assistant (3), Delete (4),
  Insert an empty turn of user or assistant (3). Blank and duplicate turns can
  only be deleted, a truncated one costs 3 more if it stays. Its states count
  the insertions since the last turn: more than two are a cycle of the grammar
  that costs and changes nothing, so the composition has no cycles;
* the grammar acceptor, over initials.

They are composed lazily: for a turn's symbol and a grammar state, only the arcs
that can be reached are made, once for each of the few symbols. The repair is
the shortest path in topological order over weights (cost, label string), the
labels being the edits' initials; of equal costs the string that is least in
code points wins. Paths over the same turns whose last edit is not an insertion
are never prefixes of one another, so comparing strings where paths meet is
exact, as is comparing them by rank and then by the arc's own labels.

Weights multiply associatively, so a conversation need not be in one task. All
turns are sorted by range, each task finds the best path between any two states
of the grammar over its piece of a conversation, and pieces are multiplied, a
row each. Edits go back to the turns by place. A conversation of any length is
so dealt with; one task holds its string of labels, a byte a turn, never its
texts.

Defined cases: a null role or text is one space; a null turn comes first and is
no gap; turns of equal number are in order of role and text; a null identifier
is a conversation of its own; repeated rows are duplicates; a role whose first
character is none of s, u, a (an empty one has none) can't be kept; texts of any
length are taken whole; an empty table gives no rows; other columns of the
input are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.store import materialize

COST = {"K": 0, "R": 3, "D": 4, "I": 3}
TRUNCATED = 3
#: Grammar: state -> {initial: next state}; 0 is the start.
GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
FINAL = (0, 3)
NAMES = {"u": "user", "a": "assistant"}
INSERTIONS = 2

WORD = r"[^\x20\x09-\x0D]"
FAULTS = ("blank", "duplicate", "truncated")


@cache
def insertions(state: int) -> tuple:
    """(next state, cost, labels) of up to two insertions from a state."""
    found, now = [], [(state, 0, "")]
    for _ in range(INSERTIONS + 1):
        found += now
        now = [(then, cost + COST["I"], labels + "I") for at, cost, labels in now for role, then in GRAMMAR[at].items() if role in NAMES]
    return tuple(found)


@cache
def arcs(state: int, initial: str, fault: str | None) -> tuple:
    """The composed arcs that take in one turn: (next state, cost, labels)."""
    best: dict = {}
    more = TRUNCATED if fault == "truncated" else 0
    for at, cost, labels in insertions(state):
        steps = [("D", at, 0)]
        if fault not in ("blank", "duplicate"):
            steps += [("K", then, more) for role, then in GRAMMAR[at].items() if role == initial]
            steps += [("R", then, more) for role, then in GRAMMAR[at].items() if role in NAMES]
        for label, then, extra in steps:
            weight = cost + COST[label] + extra, labels + label
            best[then] = min(best.get(then, weight), weight)
    return tuple((then, *weight) for then, weight in best.items())


def paths(symbols: list, state: int) -> dict:
    """{state after: (cost, labels)} of the best paths over (initial, fault)."""
    now = {state: (0, 0, None)}  # cost, rank of the string, its last part
    for initial, fault in symbols:
        best: dict = {}
        for at, (cost, rank, parts) in now.items():
            for then, more, labels in arcs(at, initial, fault):
                weight = cost + more, rank, labels
                if then not in best or weight < best[then][0]:
                    best[then] = weight, parts
        order = sorted(best, key=lambda s: best[s][0][1:])
        now = {s: (best[s][0][0], k, (best[s][1], best[s][0][2])) for k, s in enumerate(order)}
    out = {}
    for s, (cost, _, parts) in now.items():
        labels = []
        while parts is not None:
            parts, last = parts
            labels.append(last)
        out[s] = cost, "".join(reversed(labels))
    return out


def edited(state: int, labels: str, initials: list) -> list:
    """For each turn: the roles inserted before it and its label, and at last
    the roles inserted at the end. ``initials``: those of the turns."""
    out, before, turns = [], [], iter(initials)
    for label in labels:
        if label == "I":
            role = next(r for r in GRAMMAR[state] if r in NAMES)
            before.append(NAMES[role])
            state = GRAMMAR[state][role]
            continue
        initial = next(turns)
        role = next(r for r in GRAMMAR[state] if r in NAMES) if label == "R" else initial
        state = state if label == "D" else GRAMMAR[state][role]
        out.append((before, label, NAMES[role] if label == "R" else None))
        before = []
    return [*out, (before, None, None)]


def _number(batches: Iterable) -> Iterator:
    """Rows of a sorted partition with its number and their place in it. Of
    equal rows the first is looked at only here: the others are duplicates."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    part, at, last = TaskContext.get().partitionId(), 0, None
    for batch in batches:
        keys = batch.column("key").to_pylist()
        turns = batch.column("turn").to_pylist()
        again = []
        for this in zip(keys, turns, strict=True):
            again.append(this == last)
            last = this
        n = batch.num_rows
        columns = {name: batch.column(name) for name in batch.schema.names if name != "key"}
        columns |= {"part": pa.array(np.full(n, part, "int32")), "at": pa.array(np.arange(at, at + n)), "again": pa.array(again, pa.bool_())}
        yield pa.RecordBatch.from_pydict(columns)
        at += n


def in_order(turns: DataFrame) -> DataFrame:
    """The turns as a table: (conv_id, turn, role, text) with ``part`` and
    ``at``, in whose order conversations follow one another turn by turn, and
    the ``fault``."""
    given = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    conv = F.col("conv_id").cast("string")
    whose = F.coalesce(F.concat(F.octet_length(conv).cast("string"), F.lit(":"), conv), F.lit("-"))
    key = F.sha2(F.concat(whose, F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    keyed = given.withColumn("key", key)
    place = F.struct(F.col("turn").isNotNull().alias("has"), F.coalesce("turn", F.lit(0)).alias("turn"))
    first = keyed.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    marked = keyed.join(first, "key", "left").withColumn("later", F.coalesce(place > F.col("first"), F.lit(False))).drop("first")
    # Only where a turn goes is decided by the beginning of its text.
    dealt = marked.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = T.StructType([f for f in dealt.schema if f.name != "key"]).add("part", T.IntegerType()).add("at", T.LongType()).add("again", T.BooleanType())
    numbered = dealt.mapInArrow(_number, schema)
    last = F.substring(F.rtrim(F.translate("text", "\t\n\x0b\f\r", "     ")), -1, 1)
    fault = F.when(~F.col("text").rlike(WORD), "blank").when(F.col("later") | F.col("again"), "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    return materialize(numbered.select("conv_id", "turn", "role", "text", "part", "at", fault.alias("fault")), "turns")


PIECE = "conv_id {id}, part int, at long, initials string, {counts}, illegal long, first string, last string, paths array<struct<before:int,after:int,cost:bigint,labels:string>>"
COUNTS = ", ".join(f"{f} long" for f in FAULTS)
LEGAL = ("su", "ua", "au")


def _pieces(batches: Iterable) -> Iterator:
    """A row for each stretch of a conversation in a part. All states may come
    before a part's first stretch, which may go on from another part."""
    import pyarrow as pa

    def piece(conv, part: int, at: int, symbols: list) -> dict:
        states = GRAMMAR if at == 0 else (0,)
        best = [{"before": s, "after": a, "cost": c, "labels": x} for s in states for a, (c, x) in paths(symbols, s).items()]
        initials = [i for i, _ in symbols]
        faults = [f for _, f in symbols]
        illegal = sum(x + y not in LEGAL for x, y in zip(initials, initials[1:], strict=False))
        return {"conv_id": conv, "part": part, "at": at, "initials": "".join(i or " " for i in initials), "illegal": illegal, "first": initials[0], "last": initials[-1], "paths": best} | {f: faults.count(f) for f in FAULTS}

    def flush():
        batch = pa.RecordBatch.from_pylist(out, schema=schema)
        out.clear()
        return batch

    key, at, symbols, out, schema = None, 0, [], [], None
    for batch in batches:
        if schema is None:
            weight = pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("labels", pa.string())])
            schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), ("part", pa.int32()), ("at", pa.int64()), ("initials", pa.string()), *[(f, pa.int64()) for f in FAULTS], ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("paths", pa.list_(weight))])
        for conv, part, place, initial, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (part, conv) != key:
                if symbols:
                    out.append(piece(key[1], key[0], at, symbols))
                key, at, symbols = (part, conv), place, []
                if len(out) >= 1000:
                    yield flush()
            symbols.append((initial, fault))
    if symbols:
        out.append(piece(key[1], key[0], at, symbols))
        yield flush()


def _multiplied(batches: Iterable) -> Iterator:
    """Conversations of pieces in order: counts and the best path over all."""
    import pyarrow as pa

    def whole(conv, pieces: list) -> dict:
        now = {0: (0, ())}
        for p in pieces:
            best: dict = {}
            for x in p["paths"]:
                if x["before"] in now:
                    cost, strings = now[x["before"]]
                    weight = cost + x["cost"], (*strings, x["labels"])
                    best[x["after"]] = min(best.get(x["after"], weight), weight)
            now = best
        ends = [(cost + more, "".join(strings) + labels, strings, labels) for s, (cost, strings) in now.items() for then, more, labels in insertions(s) if then in FINAL]
        cost, audit, strings, rest = min(ends, key=lambda e: e[:2])
        edits, state = [], 0
        for k, (p, labels) in enumerate(zip(pieces, strings, strict=True)):
            edits.append({"part": p["part"], "at": p["at"], "state": state, "initials": p["initials"], "labels": labels + rest * (k == len(pieces) - 1)})
            state = next(x["after"] for x in p["paths"] if x["before"] == edits[-1]["state"] and x["labels"] == labels)
        illegal = sum(p["illegal"] for p in pieces) + sum(p["last"] + q["first"] not in LEGAL for p, q in zip(pieces, pieces[1:], strict=False))
        return {"conv_id": conv, "illegal": illegal, "cost": cost, "audit": audit, "edits": edits} | {f: sum(p[f] for p in pieces) for f in FAULTS}

    key, held, out, schema = None, [], [], None
    for batch in batches:
        if schema is None:
            edit = pa.struct([("part", pa.int32()), ("at", pa.int64()), ("state", pa.int32()), ("initials", pa.string()), ("labels", pa.string())])
            schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), *[(f, pa.int64()) for f in FAULTS], ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("edits", pa.list_(edit))])
        for p in batch.to_pylist():
            if held and p["conv_id"] != key:
                out.append(whole(key, held))
                held = []
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out = []
            key = p["conv_id"]
            held.append(p)
    if held:
        out.append(whole(key, held))
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def repairs(ordered: DataFrame) -> DataFrame:
    """A row for each conversation of ``in_order``: the numbers of blank,
    duplicate, truncated turns and illegal neighbours, the least ``cost``, the
    ``audit`` and the ``edits`` of each piece."""
    kind = ordered.schema["conv_id"].dataType.simpleString()
    light = ordered.select("conv_id", "part", "at", F.substring("role", 1, 1).alias("initial"), "fault")
    pieces = light.repartition("part").sortWithinPartitions("part", "at").mapInArrow(_pieces, PIECE.format(id=kind, counts=COUNTS))
    whole = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    edits = "array<struct<part:int,at:bigint,state:int,initials:string,labels:string>>"
    return materialize(whole.mapInArrow(_multiplied, f"conv_id {kind}, {COUNTS}, illegal long, cost long, audit string, edits {edits}"), "repairs")


def _by_turn(batches: Iterable) -> Iterator:
    import pyarrow as pa

    schema = pa.schema([("part", pa.int32()), ("at", pa.int64()), ("before", pa.list_(pa.string())), ("label", pa.string()), ("new_role", pa.string()), ("after", pa.list_(pa.string()))])
    for batch in batches:
        out = []
        for e in batch.to_pylist():
            *turns, end = edited(e["state"], e["labels"], list(e["initials"]))
            out += [{"part": e["part"], "at": e["at"] + k, "before": b, "label": label, "new_role": role, "after": end[0] if k == len(turns) - 1 else []} for k, (b, label, role) in enumerate(turns)]
        for start in range(0, len(out), 10_000):
            yield pa.RecordBatch.from_pylist(out[start : start + 10_000], schema=schema)


def repaired(ordered: DataFrame, found: DataFrame) -> DataFrame:
    """The turns of ``ordered`` with ``turns``, what stands in their place: an
    array of (role, text)."""
    edits = found.select(F.explode("edits").alias("e")).select("e.*")
    by_turn = edits.mapInArrow(_by_turn, "part int, at long, before array<string>, label string, new_role string, after array<string>")
    empty = lambda names: F.transform(names, lambda r: F.struct(r.alias("role"), F.lit("").alias("text")))
    own = F.struct(F.coalesce("new_role", "role").alias("role"), F.col("text").alias("text"))
    kept = F.when(F.col("label") == "D", F.array().cast("array<struct<role:string,text:string>>")).otherwise(F.array(own))
    return ordered.join(by_turn, ["part", "at"]).select("conv_id", "part", "at", "label", F.concat(empty("before"), kept, empty("after")).alias("turns"))


def lines(turns: Column) -> Column:
    """``role:text`` of each of an array of turns, newline-joined."""
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
