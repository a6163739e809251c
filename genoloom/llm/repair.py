"""Cheapest repair of conversation structure by cost layers of reachable grammar states."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoloom.llm.scratch import Scratch
from genoloom.sources.files import numbered

#: Turns of a block, and blocks (or groups of blocks) that one task puts together.
BLOCK, FAN = 64, 64
KEEP, RENAME, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Grammar states: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: The state that a turn whose role has this initial leads to.
AFTER = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The state that a new or renamed turn leads to, and what brings a state to a whole conversation: cost, inserted turns.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ENDS = {START: (0, ()), SYSTEM: (2 * INSERT, (USER, ASSISTANT)), USER: (INSERT, (ASSISTANT,)), ASSISTANT: (0, ())}
#: The bitset of states from which a state may be reached.
WAYS = {START: 0b0001, SYSTEM: 0b0011, USER: 0b1111, ASSISTANT: 0b1111}
FAR = 1 << 60
WHITE, CLOSING = " \t\n\v\f\r", [".", "!", "?"]
FAULTS = ("", "blank", "duplicate", "truncated")


def damage(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) with faults by crc32(``conv_id:turn``) % 20: 0 dropped, 1 emptied, 2 without ``.!?``, 3 twice, 4 a user's.

    A null is one space: in the hashed text, as role and as text. conv_id and turn themselves stay null.
    """

    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(shown(conv), F.lit(":"), shown(turn)).cast("binary")) % 20
    rows = messages.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), shown(role).alias("role"), shown(text).alias("text"), kind.alias("kind")).filter("kind <> 0")
    changed = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), copies.alias("copy")).drop("copy")


def options(initial: str, truncated: bool) -> dict[int, list[tuple[str, int, int]]]:
    """From each state the edits of a turn that may stay: (letters, cost, next state), in the order of their letters.

    Turns are only inserted before one that stays or at the end: what is inserted before a deleted turn can as well wait,
    for the same cost and lesser letters.
    """
    out: dict[int, list[tuple[str, int, int]]] = {}
    for state in STATES:
        own, at = [("D", DELETE, state)], state
        for n in range(3):
            if at in AFTER.get(initial, {}):
                own.append(("I" * n + "K", n * INSERT + KEEP + truncated * TRUNCATED, AFTER[initial][at]))
            own.append(("I" * n + "R", n * INSERT + RENAME + truncated * TRUNCATED, NEXT[at]))
            at = NEXT[at]
        out[state] = sorted(own)
    return out


@cache
def steps(initial: str, truncated: bool) -> tuple[dict[int, list[tuple[str, int, int]]], list[tuple[int, list[int]]]]:
    """The options of a turn, and for each cost a table: from a bitset of states after it to the bitset of states before it."""
    own = options(initial, truncated)
    weights = sorted({w for edits in own.values() for _, w, _ in edits})
    table = [(w, [sum(1 << s for s in STATES if any(v == w and after >> to & 1 for _, v, to in own[s])) for after in range(16)]) for w in weights]
    return own, table


def layers(turns: list[tuple[str, bool]], ends: list[int], wanted: int) -> list[list[int]]:
    """``layers[c][i]``: the bitset of states before turn i that reach the end for a cost of exactly c.

    ``ends`` has the cost still to come in each state at the end. Layers are added until each state of the bitset
    ``wanted`` has been reached before the first turn, or cannot be any more. The first layer that has a state there
    gives its cost.
    """
    tables = [steps(*t)[1] for t in turns]
    # deleting all but two turns leads wherever there is a way, and these cost less than twice 4 more than deleting them
    most = DELETE * len(turns) + 8 + max((x for x in ends if x < FAR), default=-9)
    out: list[list[int]] = []
    while wanted and len(out) <= most:
        c, layer = len(out), [0] * (len(turns) + 1)
        out.append(layer)
        layer[-1] = sum(1 << s for s in STATES if ends[s] == c)
        for i in range(len(turns) - 1, -1, -1):
            reached = 0
            for w, before in tables[i]:
                if w > c:
                    break
                reached |= before[out[c - w][i + 1]]
            layer[i] = reached
        wanted &= ~layer[0]
    return out


def trace(turns: list[tuple[str, bool]], found: list[list[int]], state: int) -> tuple[list[str], int]:
    """The least letters of a cheapest path from the state through the layers, turn by turn, and where it ends."""
    c, letters = next(c for c, layer in enumerate(found) if layer[0] >> state & 1), []
    for i, t in enumerate(turns):
        for edit, w, to in steps(*t)[0][state]:
            if w <= c and found[c - w][i + 1] >> to & 1:
                letters.append(edit)
                c, state = c - w, to
                break
    return letters, state


def walked(letters: str, state: int, initial: str) -> tuple[list[str], str | None, int]:
    """The roles inserted before a turn, its new role (null: as it was, or deleted), and the state after it."""
    before = []
    for letter in letters:
        if letter == "I":
            state = NEXT[state]
            before.append(NAMES[state])
        elif letter == "K":
            state = AFTER[initial][state]
        elif letter == "R":
            state = NEXT[state]
            return before, NAMES[state], state
    return before, None, state


def parse(turns: list[dict]) -> list[tuple[str, bool]]:
    """(initial, truncated) of the turns that may stay."""
    return [(t["initial"], t["fault"] == 3) for t in turns if t["fault"] in (0, 3)]


def block_costs(turns: list[dict]) -> list[int]:
    """The least cost from each state before a block to each state after it, FAR if there is no way, row by row."""
    own, forced = parse(turns), DELETE * sum(t["fault"] in (1, 2) for t in turns)
    out = [FAR] * 16
    for end in STATES:
        found = layers(own, [0 if s == end else FAR for s in STATES], WAYS[end])
        for c, layer in enumerate(found):
            for s in STATES:
                if layer[0] >> s & 1 and out[4 * s + end] == FAR:
                    out[4 * s + end] = c + forced
    return out


def block_traces(turns: list[dict], ends: list[int]) -> list[tuple[list[str], int] | None]:
    """From each state before a block the letters of all its turns and the state after it; None where no way leads on."""
    own, least = parse(turns), min(ends)
    found = layers(own, [min(FAR, x - least) for x in ends], 15)
    out: list[tuple[list[str], int] | None] = []
    for state in STATES:
        if not any(layer[0] >> state & 1 for layer in found):
            out.append(None)
            continue
        letters, after = trace(own, found, state)
        rest = iter(letters)
        out.append(([next(rest) if t["fault"] in (0, 3) else "D" for t in turns], after))
    return out


def through(costs: list[int], ends: list[int]) -> list[int]:
    """The least cost to come in each state before a block, by what is to come after it."""
    return [min(min(FAR, costs[4 * s + t] + ends[t]) for t in STATES) for s in STATES]


def mapped(df: DataFrame, f, schema: str) -> DataFrame:
    """``f`` gives rows for each row of ``df``, as dicts."""
    names = [x.split()[0] for x in schema.split(", ")]
    target = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "int": pa.int32()}
    kinds = [target[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                rows = [x for row in batch.slice(a, 256).to_pylist() for x in f(row)]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

    return df.mapInArrow(run, schema)


def grouped(df: DataFrame, *columns: str) -> DataFrame:
    """Up to FAN neighbours (first, block, ...) as one row (first, parent, parts)."""
    return df.withColumn("parent", F.floor(F.col("block") / FAN)).groupBy("first", "parent").agg(F.sort_array(F.collect_list(F.struct("block", *columns))).alias("parts"))


def costs_to_come(costs: DataFrame, scratch: Scratch, level: int = 0) -> DataFrame:
    """(first, block, ends): what is still to come after each block, from (first, block, costs).

    Costs of FAN neighbours are put together, level by level until a dialogue is one part, and what is to come goes back
    down the levels. So no task sees more than FAN blocks of a dialogue at once, however long it is.
    """
    groups = scratch.keep(grouped(costs, "costs"), f"costs-{level}")
    if (groups.agg(F.max("parent")).first()[0] or 0) == 0:
        above = groups.select("first", "parent", F.array(*(F.lit(ENDS[s][0]).cast("long") for s in STATES)).alias("ends"))
    else:

        def joined(row: dict) -> Iterator[dict]:
            total = [[0 if s == t else FAR for t in STATES] for s in STATES]
            for part in reversed(row["parts"]):
                total = [through(part["costs"], [x[t] for x in total]) for t in STATES]
                total = [[total[t][s] for t in STATES] for s in STATES]
            yield {"first": row["first"], "block": row["parent"], "costs": [x for s in total for x in s]}

        above = costs_to_come(mapped(groups, joined, "first long, block long, costs array<long>"), scratch, level + 1).withColumnRenamed("block", "parent")

    def down(row: dict) -> Iterator[dict]:
        ends = row["ends"]
        for part in reversed(row["parts"]):
            yield {"first": row["first"], "block": part["block"], "ends": ends}
            ends = through(part["costs"], ends)

    return mapped(groups.join(above, ["first", "parent"]), down, "first long, block long, ends array<long>")


def states_before(steps_of: DataFrame, scratch: Scratch, level: int = 0) -> DataFrame:
    """(first, block, state): the state before each block, from (first, block, after): the state after it by the one before. Levels as above."""
    groups = scratch.keep(grouped(steps_of, "after"), f"states-{level}")
    if (groups.agg(F.max("parent")).first()[0] or 0) == 0:
        above = groups.select("first", "parent", F.lit(START).alias("state"))
    else:

        def joined(row: dict) -> Iterator[dict]:
            after = list(STATES)
            for part in row["parts"]:
                after = [part["after"][s] if s >= 0 else s for s in after]
            yield {"first": row["first"], "block": row["parent"], "after": after}

        above = states_before(mapped(groups, joined, "first long, block long, after array<long>"), scratch, level + 1).withColumnRenamed("block", "parent")

    def down(row: dict) -> Iterator[dict]:
        state = row["state"]
        for part in row["parts"]:
            yield {"first": row["first"], "block": part["block"], "state": state}
            state = part["after"][state]

    return mapped(groups.join(above, ["first", "parent"]), down, "first long, block long, state int")


EDITS = "first long, number long, edit string, before array<string>, new_role string, after array<string>"


def edits_of(turns: list[dict], letters: list[str], state: int, last: bool) -> Iterator[dict]:
    """A row of EDITS a turn; those inserted at the end of a conversation come after its last turn."""
    for i, (turn, edit) in enumerate(zip(turns, letters, strict=True)):
        before, new, state = walked(edit, state, turn["initial"])
        after = [NAMES[s] for s in ENDS[state][1]] if last and i == len(turns) - 1 else []
        yield {"number": turn["number"], "edit": edit, "before": before, "new_role": new, "after": after}


def repair(messages: DataFrame, scratch: Scratch, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """Each turn with its fault and its edit: conv_id, first, number, turn, role, text, initial, fault, and EDITS.

    The roles' initials of what is left form ``(s?(ua)+)?`` at the least cost, by edits D (delete, 3), I (insert an empty
    user's or assistant's turn, 2), K (keep, 0), R (rename to user or assistant, 2); a truncated turn that stays costs 1
    more, blank and duplicate ones must go. Of the cheapest the one whose letters are least in ASCII counts. ``number``
    orders the turns of all conversations and ``first`` is a conversation's first number; ``before`` and ``after`` are the
    roles inserted around a turn, ``new_role`` is that of a renamed one.

    Turns go by (turn, role, the first letters of the text, its hash), null turns first; a null role or text is one space, null ids form one conversation,
    equal rows stay rows. Names of columns may be others; other columns are dropped. A conversation is cut into blocks of
    ``block`` turns: layers of bitsets give each block's costs between grammar states, these are put together over
    blocks, and each block is traced by itself, so no task holds a long conversation. No rows, no rows.
    """
    shown = [F.coalesce(F.col(x), F.lit(" ")) for x in (role, text)]
    rows = messages.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), shown[0].alias("role"), shown[1].alias("text"))
    rows = rows.withColumn("digest", F.sha2(F.concat_ws("\0", "role", "text"), 256))
    # equal rows are alike, so any order among them will do
    rows = scratch.keep(numbered(rows, [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.left("text", F.lit(64)), F.col("digest")]), "turns")
    closing = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    light = rows.select("conv_id", "number", "digest", F.left("role", F.lit(1)).alias("initial"), (closing == "").alias("blank"), (~closing.isin(CLOSING)).alias("open"))
    firsts = rows.groupBy("conv_id").agg(F.min("number").alias("first"), F.max("number").alias("last")).withColumnRenamed("conv_id", "id")
    light = light.join(firsts, F.col("conv_id").eqNullSafe(F.col("id"))).drop("id", "conv_id")
    again = light.filter("NOT blank").groupBy(F.col("first").alias("f"), F.col("digest").alias("d")).agg(F.min("number").alias("one"), F.count("*").alias("n")).filter("n > 1")
    light = light.join(again, (F.col("first") == F.col("f")) & (F.col("digest") == F.col("d")) & ~F.col("blank"), "left")
    fault = F.when(F.col("blank"), 1).when(F.col("number") > F.col("one"), 2).when(F.col("open"), 3).otherwise(0)
    light = light.select("first", "last", F.floor((F.col("number") - F.col("first")) / block).alias("block"), "number", "initial", fault.alias("fault"))
    blocks = scratch.keep(light.groupBy("first", "last", "block").agg(F.sort_array(F.collect_list(F.struct("number", "initial", "fault"))).alias("turns")), "blocks")
    whole, parts = blocks.filter(F.col("last") - F.col("first") < block), blocks.filter(F.col("last") - F.col("first") >= block)

    def alone(row: dict) -> Iterator[dict]:
        letters, _ = block_traces(row["turns"], [ENDS[s][0] for s in STATES])[START]
        for x in edits_of(row["turns"], letters, START, True):
            yield x | {"first": row["first"]}

    edits = mapped(whole, alone, EDITS)
    if parts.limit(1).count():

        def costs(row: dict) -> Iterator[dict]:
            yield {"first": row["first"], "block": row["block"], "costs": block_costs(row["turns"])}

        def traces(row: dict) -> Iterator[dict]:
            found = block_traces(row["turns"], row["ends"])
            yield {"first": row["first"], "block": row["block"], "after": [x[1] if x else -1 for x in found], "letters": [" ".join(x[0]) if x else None for x in found]}

        def chosen(row: dict) -> Iterator[dict]:
            letters = row["letters"][row["state"]].split(" ")
            for x in edits_of(row["turns"], letters, row["state"], row["turns"][-1]["number"] == row["last"]):
                yield x | {"first": row["first"]}

        ends = costs_to_come(scratch.keep(mapped(parts, costs, "first long, block long, costs array<long>"), "block-costs"), scratch)
        traced = scratch.keep(mapped(parts.join(ends, ["first", "block"]), traces, "first long, block long, after array<long>, letters array<string>"), "traces")
        begun = states_before(traced.select("first", "block", "after"), scratch)
        edits = edits.union(mapped(parts.join(traced, ["first", "block"]).join(begun, ["first", "block"]), chosen, EDITS))
    faults = light.select("number", "initial", F.element_at(F.array(*map(F.lit, FAULTS)), F.col("fault") + 1).alias("fault"))
    return rows.drop("digest").join(faults, "number").join(edits, "number")


def repaired(edits: DataFrame) -> DataFrame:
    """The conversations as repaired: conv_id, place (of the turn it comes from or beside), nth there, role, text (empty if inserted)."""
    role = F.when(F.col("edit").endswith("D"), None).otherwise(F.coalesce("new_role", "role"))
    def inserted(x: Column) -> Column:
        return F.struct(x.alias("role"), F.lit("").alias("text"))

    stays = F.when(role.isNull(), F.array().cast("array<struct<role:string,text:string>>")).otherwise(F.array(F.struct(role.alias("role"), F.col("text").alias("text"))))
    lines = F.concat(F.transform("before", inserted), stays, F.transform("after", inserted))
    return edits.select("conv_id", "first", (F.col("number") - F.col("first")).alias("place"), F.posexplode(lines).alias("nth", "line")).select("conv_id", "first", "place", "nth", "line.role", "line.text")


SUMMARY = "first long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Summary:
    """What a conversation comes to, turn by turn."""

    def __init__(self, first: int):
        self.first, self.turns, self.faults, self.illegal, self.cost, self.audit, self.lines, self.hash = first, [], dict.fromkeys(FAULTS, 0), 0, 0, [], 0, hashlib.sha256()
        self.low = self.high = self.initial = None
        self.different = 0

    def add(self, row: dict) -> None:
        if row["turn"] is not None:
            self.low = row["turn"] if self.low is None else self.low
            self.different += row["turn"] != self.high
            self.high = row["turn"]
        self.faults[row["fault"]] += 1
        if self.initial is not None:
            self.illegal += self.initial + row["initial"] not in ("su", "ua", "au")
        self.initial = row["initial"]
        letters = row["edit"] + "I" * len(row["after"])
        self.audit.append(letters)
        self.cost += sum({"D": DELETE, "I": INSERT, "K": KEEP, "R": RENAME}[x] for x in letters) + (TRUNCATED if row["fault"] == "truncated" and not row["edit"].endswith("D") else 0)
        for line in row["lines"]:
            self.hash.update((b"\n" if self.lines else b"") + line.encode())
            self.lines += 1

    def row(self) -> dict:
        gaps = self.high - self.low + 1 - self.different if self.different else 0
        return {"first": self.first, "gaps": gaps, "blank": self.faults["blank"], "duplicate": self.faults["duplicate"], "truncated": self.faults["truncated"], "illegal": self.illegal, "cost": self.cost, "audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest()}


def summaries(edits: DataFrame) -> DataFrame:
    """One row a conversation (SUMMARY, conv_id): its faults, cost, audit and the SHA-256 of its repaired ``role:text`` lines.

    A SHA-256 is worked out byte after byte, so a conversation's turns stream through one task here, in order and a turn
    at a time; nothing of them is held but the audit, which is the result.
    """
    role = F.when(F.col("edit").endswith("D"), None).otherwise(F.coalesce("new_role", "role"))
    def inserted(x: Column) -> Column:
        return F.concat(x, F.lit(":"))

    lines = F.concat(F.transform("before", inserted), F.when(role.isNull(), F.array().cast("array<string>")).otherwise(F.array(F.concat(role, F.lit(":"), F.col("text")))), F.transform("after", inserted))
    rows = edits.select("first", "number", "turn", "initial", "fault", "edit", "after", lines.alias("lines"))
    names = [x.split()[0] for x in SUMMARY.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(done: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in done], pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in names], names)

        own, done = None, []
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                for row in batch.slice(a, 256).to_pylist():
                    if own is None or own.first != row["first"]:
                        done += [own.row()] if own else []
                        own = Summary(row["first"])
                    own.add(row)
                yield table(done)
                done = []
        if own:
            yield table([own.row()])

    partitions = int(edits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    streamed = rows.repartition(partitions, "first").sortWithinPartitions("first", "number").mapInArrow(run, SUMMARY)
    ids = edits.filter("number = first").select(F.col("first").alias("at"), "conv_id")
    return streamed.join(ids, F.col("first") == F.col("at")).drop("at")


def audited(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """Every conversation of ``messages``, damaged, repaired and summed up: conv_id and SUMMARY without first.

    A conversation without a turn after the damage has zeros, an empty audit and the hash of the empty string.
    """
    scratch = Scratch(messages.sparkSession, "repair")
    edits = scratch.keep(repair(damage(messages, conv, turn, role, text), scratch, block=block), "edits")
    scratch.drop("turns", "blocks")
    found = summaries(edits).withColumnRenamed("conv_id", "id")
    every = messages.select(F.col(conv).alias("conv_id")).distinct()
    out = every.join(found, F.col("conv_id").eqNullSafe(F.col("id")), "left")
    zeros = [F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
