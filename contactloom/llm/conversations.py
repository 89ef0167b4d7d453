"""Conversations whose roles are put in order by the cheapest edits.

A conversation's rows are the layers of a lattice with four states of the roles so far: none, system, user, assistant.
Keeping, reroling and deleting a row lead to the next layer, inserting a turn stays in one; costs are integers. Prices of
nodes start below the distance to the end and rise by an auction: a path grows from its origin along the cheapest arc
while the price of its last node covers that arc, and else the price goes up and the path shrinks. Origins stand at
every 16th layer, the last first, so that no path is longer than what lies between. Where prices have converged, arcs
whose cost is the difference of their ends' prices are tight; the cheapest edits are the tight arcs that lead to the
end, and of these the first letters are taken all along.

A conversation passes through one task, sorted by Spark: once as a byte a row, from which its edits follow, and once
with its texts, which are streamed beside the edits. Long ones so need memory for a few numbers a row, not for texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactloom.llm.common import on_workers

#: Costs of the edits; a truncated row that stays costs TRUNCATED more.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
FINE, CUT_OFF, BLANK, REPEATED = range(4)
NONE, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
INITIALS = "sua"
#: The state that an inserted or reroled turn leads to, and those that rows kept do, by state and initial.
TURN = {NONE: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEPT = {(NONE, "s"): SYSTEM, (NONE, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
LAWFUL = {("s", "u"), ("u", "a"), ("a", "u")}
#: Layers from one row of origins to the next.
STRIDE = 16
#: What a row of code c is: its initial and its fault.
CODES = [(initial, fault) for initial in [*INITIALS, ""] for fault in range(4)]
END = len(CODES)
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
Arc = tuple[str, int, int]


def arcs_of(code: int, state: int) -> tuple[Arc, ...]:
    """(letter, step to the other node's number, cost) of a node, by letter. Node 4 i + q is state q before row i."""
    out = [("I", TURN[state] - state, INSERT)]
    if code == END:
        return tuple([*out, ("", 4 - state, 0)] if state in (NONE, ASSISTANT) else out)
    initial, fault = CODES[code]
    out.append(("D", 4, DELETE))
    more = TRUNCATED if fault == CUT_OFF else 0
    if fault in (FINE, CUT_OFF):
        out.append(("R", 4 + TURN[state] - state, REROLE + more))
        if (state, initial) in KEPT:
            out.append(("K", 4 + KEPT[state, initial] - state, more))
    return tuple(sorted(out))


ARCS = [[arcs_of(code, state) for state in range(4)] for code in range(END + 1)]


def auction(prices: list[int], codes: bytes, origin: int, settled: int) -> None:
    """Raises prices until the path from the origin reaches a node from `settled` on, whose prices are distances."""
    path = [origin]
    while (node := path[-1]) < settled:
        least, to = min((cost + prices[node + step], node + step) for _, step, cost in ARCS[codes[node >> 2]][node & 3])
        if prices[node] < least:
            prices[node] = least
            if len(path) > 1:
                path.pop()
        else:
            path.append(to)


def cheapest(codes: bytes) -> tuple[int, str]:
    """(cost, letters): the cheapest edits of rows with these codes, of equals the first in ASCII order."""
    n = len(codes)
    codes += bytes([END])
    last = 4 * (n + 1)
    prices = [0] * (last + 1)
    settled = last
    for layer in [n, *range(n - STRIDE, 0, -STRIDE), 0][: 2 + (n - 1) // STRIDE if n else 1]:
        floor = min(prices[settled : settled + 4] if settled < last else [0])
        prices[4 * layer : settled] = [floor] * (settled - 4 * layer)
        for state in range(4):
            auction(prices, codes, 4 * layer + state, settled)
        settled = 4 * layer
    leads = bytearray(last + 1)
    leads[last] = 1
    for node in range(last - 1, -1, -1):
        for at in (node, *range(node + 1, (node | 3) + 1)):  # an insertion may lead to a state of the layer on either side
            if not leads[at]:
                leads[at] = any(prices[at] == cost + prices[at + step] and leads[at + step] for _, step, cost in ARCS[codes[at >> 2]][at & 3])
    out, node = [], 0
    while node != last:
        letter, step = next((letter, step) for letter, step, cost in ARCS[codes[node >> 2]][node & 3] if prices[node] == cost + prices[node + step] and leads[node + step])
        out.append(letter)
        node += step
    return prices[0], "".join(out)


def order(key: str) -> list[Column]:
    """Rows of a conversation by turn, nulls first; those of one turn by role, then by the beginning and the MD5 of text."""
    return [F.col(key).asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("head"), F.col("md5")]


def told(df: DataFrame, key: str, turn: str, role: str, text: str, present: Column | None) -> DataFrame:
    """(key, turn, role, text, head, md5, here), with a space for a null role or text."""
    role_, text_ = F.coalesce(F.col(role), F.lit(" ")), F.coalesce(F.col(text), F.lit(" "))
    here = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    rows = df.select(F.col(key).alias("key"), F.col(turn).alias("turn"), role_.alias("role"), text_.alias("text"), here.alias("here"))
    return rows.withColumn("head", F.substring("text", 1, 64)).withColumn("md5", F.unhex(F.md5("text")))


def numbered(turns: tuple[int | None, int | None, int], codes: bytes) -> tuple:
    """COUNTS and the edits of a conversation, given its least and greatest turn and how many there are."""
    low, high, distinct = turns
    faults = [CODES[c][1] for c in codes]
    initials = [CODES[c][0] for c in codes]
    illegal = sum(pair not in LAWFUL for pair in zip(initials[:-1], initials[1:], strict=True))
    cost, letters = cheapest(codes)
    return (high - low + 1 - distinct if distinct else 0, faults.count(BLANK), faults.count(REPEATED), faults.count(CUT_OFF), illegal, cost, letters)


def in_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 1024) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def rows_in(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def audits(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None) -> DataFrame:
    """(key, gaps, blank, duplicate, truncated, illegal, cost, audit): each conversation's faults and its cheapest edits, as
    letters in order: K keep, R rerole, D delete, I insert. Rows where `present` isn't true count for nothing, but their
    conversation is there. A null role or text is a space; rows with a null key are one conversation; a null turn is no
    turn and comes first. Repeated rows are duplicates. Extra columns are left out; an empty table gives an empty table."""
    on_workers(df.sparkSession)
    rows = told(df, key, turn, role, text, present)
    solid = F.translate("text", " \t\n\x0b\x0c\r", "")
    fault = F.when(solid == "", BLANK).when(~F.substring(solid, -1, 1).isin(".", "!", "?"), CUT_OFF).otherwise(FINE)
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    rows = rows.select("key", "turn", "role", "head", "md5", "here", fault.alias("fault"), initial.alias("initial")).repartition("key")
    seen = F.row_number().over(W.partitionBy("key", "here", "role", "md5").orderBy(F.col("turn").asc_nulls_first()))
    fault = F.when((F.col("fault") != BLANK) & (seen > 1), REPEATED).otherwise(F.col("fault"))
    rows = rows.withColumn("code", F.when(F.col("here"), F.col("initial") * 4 + fault).otherwise(-1)).sortWithinPartitions(*order("key"))
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: Iterator[tuple]) -> Iterator[tuple]:
            now, codes, low, high, distinct = None, None, None, None, 0
            for key, turn, code in rows:
                if codes is None or key != now:
                    if codes is not None:
                        yield (now, *numbered((low, high, distinct), bytes(codes)))
                    now, codes, low, high, distinct = key, bytearray(), None, None, 0
                if code < 0:
                    continue
                codes.append(code)
                if turn is not None and turn != high:
                    low, high, distinct = turn if low is None else low, turn, distinct + 1
            if codes is not None:
                yield (now, *numbered((low, high, distinct), bytes(codes)))

        batches = iter(batches)
        for head in batches:  # the first tells the key's type
            schema = pa.schema([("key", head.schema.field(0).type), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string())])
            yield from in_batches(found(rows_in(b for part in ((head,), batches) for b in part)), schema)

    names = T.StructType([T.StructField("key", kind), *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("audit", T.StringType())])
    return rows.select("key", F.col("turn").cast("long"), "code").mapInArrow(run, names).withColumnRenamed("key", key)


def replayed(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(key, counts, None) where a conversation begins, then (role, text, letter) of each of its repaired turns, for rows
    (key, begins, *COUNTS, audit, role, text) in order, the edits of a conversation before its turns."""
    letters, at, state = "", 0, NONE

    def inserted() -> Iterator[tuple]:
        nonlocal at, state
        while letters[at : at + 1] == "I":
            at, state = at + 1, TURN[state]
            yield ROLES[state], "", "I"

    for key, begins, *counts, audit, role, text in rows:
        if begins:
            yield from inserted()
            letters, at, state = audit, 0, NONE
            yield key, (*counts, audit), None
            continue
        yield from inserted()
        letter = letters[at]
        at += 1
        if letter == "K":
            state = KEPT[state, role[:1]]
            yield role, text, letter
        elif letter == "R":
            state = TURN[state]
            yield ROLES[state], text, letter
    yield from inserted()


def beside_texts(df: DataFrame, key: str, turn: str, role: str, text: str, present: Column | None, run: Callable, names: list[T.StructField]) -> DataFrame:
    """`run`, a function from repaired rows to tuples, over all conversations, each in one task and in order."""
    kind, shown = df.schema[key].dataType, [*COUNTS, "audit"]
    heads = audits(df, key, turn, role, text, present).withColumnRenamed(key, "key").withColumn("begins", F.lit(True))
    turns = told(df, key, turn, role, text, present).where("here").drop("here").withColumn("begins", F.lit(False))
    rows = heads.unionByName(turns, allowMissingColumns=True).repartition("key")
    rows = rows.sortWithinPartitions(F.col("key").asc_nulls_first(), F.col("begins").desc(), *order("key")[1:])
    schema = T.StructType([T.StructField(key, kind), *names])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        for head in batches:
            kinds = pa.schema([(key, head.schema.field(0).type), *((f.name, pa.int64() if isinstance(f.dataType, T.LongType) else pa.string()) for f in names)])
            yield from in_batches(run(replayed(rows_in(b for part in ((head,), batches) for b in part))), kinds)

    return rows.select("key", "begins", *shown, "role", "text").mapInArrow(each, schema)


def repaired(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None) -> DataFrame:
    """(key, at, role, text, edit): the turns of each conversation after the edits of `audits`, numbered from 0. A
    conversation that loses all its rows has none; else as `audits`."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        now, at = None, 0
        for a, b, letter in rows:
            if letter is None:
                now, at = a, 0
            else:
                yield now, at, a, b, letter
                at += 1

    names = [T.StructField("at", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("role", "text", "edit"))]
    return beside_texts(df, key, turn, role, text, present, run, names)


def digests(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None) -> DataFrame:
    """What `audits` gives, with repaired_sha256: of the repaired turns as lines `role:text`."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        now, counts, digest, between = None, None, hashlib.sha256(), b""
        for a, b, letter in rows:
            if letter is None:
                if counts is not None:
                    yield (now, *counts, digest.hexdigest())
                now, counts, digest, between = a, b, hashlib.sha256(), b""
            else:
                digest.update(between + f"{a}:{b}".encode())
                between = b"\n"
        if counts is not None:
            yield (now, *counts, digest.hexdigest())

    names = [*(T.StructField(c, T.LongType()) for c in COUNTS), *(T.StructField(c, T.StringType()) for c in ("audit", "repaired_sha256"))]
    return beside_texts(df, key, turn, role, text, present, run, names)
