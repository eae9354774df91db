"""Chat formatting by minimum-cost role repair.

A legal conversation is one system turn or none, then user and assistant turns
in alternation that begin with the user and end with the assistant.  Dynamic
programming over that automaton finds the cheapest way to make a conversation
legal, out of: merging a turn into the one before it (``MERGE``), giving a turn
another role (``RELABEL``; a missing or unknown role costs ``GUESS``), and
inserting an empty turn (``INSERT``).  No text is dropped.  The repaired
sequence is rendered with a header and an end mark around every turn.

States are the role of the last turn.  What a stretch of turns does to the
costs is a min-plus matrix over the states, and such matrices combine; so a
conversation is cut into segments of ``SEGMENT`` turns, whose matrices are made
in parallel, a conversation's matrices are combined, and each segment then
repairs its own turns between the states it is given.  One conversation with a
third of all turns is thus spread over all tasks.

Output is a row for every original turn: its new role, what was done to it, the
empty roles inserted before it (and after it, for the last), and its rendered
piece.  Pieces in the order of ``place`` make up the rendered conversation.

Defined results: turns are ordered by ``turn``, null first, then by role and
text; null texts are empty; roles are compared in lower case; ties prefer
merging to keeping apart, then user, assistant, system; rows with a null
conversation id form one conversation; an empty table gives no row; extra
columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quill.llm.common import written

ROLES = ("user", "assistant", "system")
# The state of a conversation is the role of its last turn; START is before the first turn.
USER, ASSISTANT, SYSTEM, START = range(4)
MERGE, RELABEL, GUESS, INSERT = 1.0, 2.0, 1.0, 3.0
SEGMENT = 2048
DEAL_ROWS = 8192
#: Legal next roles by state.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}


def _paths(goal: int | None) -> dict[tuple[int, int], tuple[int, ...]]:
    """Shortest runs of inserted roles from a state to one whose next role (or which itself, goal None) fits."""
    found: dict[tuple[int, int], tuple[int, ...]] = {}
    for state in range(4):
        ways = [((), state)]
        for n in range(4):
            for path, at in ways:
                for role in range(3) if goal is None else (goal,):
                    if role in NEXT[at] and (state, role) not in found:
                        found[state, role] = path
            ways = [((*path, r), r) for path, at in ways for r in NEXT[at]]
    return found


#: (state, role) -> roles to insert so that a turn of that role may follow.
FILL = _paths(None)
#: Roles to insert at the end, so that the assistant speaks last.
END = {USER: (ASSISTANT,), ASSISTANT: (), SYSTEM: (USER, ASSISTANT), START: (USER, ASSISTANT)}


def role_cost(given: int | None, role: int) -> float:
    return GUESS if given is None else 0.0 if given == role else RELABEL


def _steps(given: int | None) -> list[tuple[float, int, int, bool, tuple[int, ...]]]:
    """``(cost, state, next state, merged, inserted)`` of everything one turn can do, in order of preference."""
    out = []
    for state, role in itertools.product(range(4), range(3)):
        if state == role:
            out.append((role_cost(given, role) + MERGE, state, role, True, ()))
        if (state, role) in FILL:
            inserted = FILL[state, role]
            out.append((role_cost(given, role) + INSERT * len(inserted), state, role, False, inserted))
    return out


_STEPS = {given: _steps(given) for given in (None, 0, 1, 2)}


def _matrix(given: int | None) -> np.ndarray:
    m = np.full((4, 4), np.inf)
    for cost, state, to, _, _ in _STEPS[given]:
        m[state, to] = min(m[state, to], cost)
    return m


_MATRIX = {given: _matrix(given) for given in _STEPS}


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus product."""
    return (a[:, :, None] + b[None, :, :]).min(1)


def segment_matrix(given: list[int | None]) -> np.ndarray:
    total = np.full((4, 4), np.inf)
    np.fill_diagonal(total, 0.0)
    for g in given:
        total = product(total, _MATRIX[g])
    return total


def repair(given: list[int | None], start: int = START, end: int | None = None
           ) -> tuple[float, list[tuple[int, bool, tuple[int, ...]]]]:
    """Cost and ``(role, merged, inserted before)`` of each turn, from state ``start`` to ``end``.

    ``end`` None: the cheapest end, with the cost of what must still be inserted.
    """
    best = np.full(4, np.inf)
    best[start] = 0.0
    back = []
    for g in given:
        new, how = np.full(4, np.inf), [None] * 4
        for step in _STEPS[g]:
            cost, state, to, _, _ = step
            if best[state] + cost < new[to]:
                new[to], how[to] = best[state] + cost, step
        back.append(how)
        best = new
    if end is None:
        final = [best[s] + INSERT * len(END[s]) for s in range(4)]
        end = int(np.argmin(final))
        cost = float(final[end])
    else:
        cost = float(best[end])
    out, at = [], end
    for how in reversed(back):
        _, state, to, merged, inserted = how[at]
        out.append((to, merged, inserted))
        at = state
    return cost, out[::-1]


def _given(role: str | None) -> int | None:
    name = (role or "").strip().lower()
    return ROLES.index(name) if name in ROLES else None


def _header(role: int) -> str:
    return f"<|{ROLES[role]}|>\n"


CLOSE = "<|end|>\n"


def numbered(turns: DataFrame, conv_col: str = "conv_id", segment: int = SEGMENT) -> DataFrame:
    """``(conv, place, segment, role, text)`` with ``place`` from 0 in each conversation.

    Turns are bucketed by ranges of the turn number, and places come from a
    prefix sum over the buckets, so a long conversation is not sorted by one task.
    """
    rows = turns.select(F.col(conv_col).alias("conv"), F.col("turn").cast("long").alias("turn"),
                        F.col("role").cast("string").alias("role"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = rows.withColumn("range", F.coalesce(F.floor(F.col("turn") / segment), F.lit(-(1 << 62))))
    own = Window.partitionBy("conv", "range").orderBy(
        F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), "text")
    sizes = keyed.groupBy("conv", "range").agg(F.count(F.lit(1)).alias("n"))
    first = sizes.select("conv", "range", (
        F.sum("n").over(Window.partitionBy("conv").orderBy("range")) - F.col("n")).alias("first"))
    at = keyed.withColumn("at", F.row_number().over(own) - 1).alias("k")
    f = first.alias("f")
    joined = at.join(f, F.col("k.conv").eqNullSafe(F.col("f.conv")) & (F.col("k.range") == F.col("f.range")))
    placed = joined.select("k.conv", (F.col("first") + F.col("at")).alias("place"), "role", "text")
    return placed.withColumn("segment", F.floor(F.col("place") / segment))


def _borders(matrices: list[np.ndarray]) -> tuple[list[int], float]:
    """The states before the first segment, between segments and after the last, and the whole cost."""
    costs = [np.where(np.arange(4) == START, 0.0, np.inf)]
    for m in matrices:
        costs.append((costs[-1][:, None] + m).min(0))
    final = [costs[-1][s] + INSERT * len(END[s]) for s in range(4)]
    at = int(np.argmin(final))
    states = [at]
    for m, before in zip(reversed(matrices), reversed(costs[:-1]), strict=True):
        at = int(np.argmin(before + m[:, at]))
        states.append(at)
    return states[::-1], float(min(final))


def _slices(table: pa.Table, keys: tuple[str, ...]) -> Iterator[tuple[int, int]]:
    """Runs of rows with equal keys in a sorted table."""
    rows = list(zip(*(table.column(c).to_pylist() for c in keys), strict=True))
    start = 0
    for i in range(1, len(rows) + 1):
        if i == len(rows) or rows[i] != rows[start]:
            yield start, i
            start = i


def formatted(turns: DataFrame, conv_col: str = "conv_id", segment: int = SEGMENT) -> DataFrame:
    """``(conv, place, role, action, inserted, rendered, cost)`` for every turn; ``cost`` is that of its conversation."""
    placed = written(numbered(turns, conv_col, segment), "turns")
    conv = placed.schema["conv"].dataType
    # Many conversations a call: about DEAL_ROWS turns are dealt to one.
    deals = max(1, placed.count() // DEAL_ROWS)
    deal = lambda *keys: F.pmod(F.xxhash64(*keys), F.lit(deals))

    def matrices(table: pa.Table) -> pa.Table:
        order = table.sort_by([("conv", "ascending"), ("segment", "ascending"), ("place", "ascending")])
        given = [_given(r) for r in order.column("role").to_pylist()]
        runs = list(_slices(order, ("conv", "segment")))
        first = pa.array([a for a, _ in runs], pa.int64())
        return pa.table({
            "conv": order.column("conv").take(first), "segment": order.column("segment").take(first),
            "m": pa.array([segment_matrix(given[a:b]).ravel().tolist() for a, b in runs], pa.list_(pa.float64()))},
            schema=made_schema)

    made = T.StructType([T.StructField("conv", conv), T.StructField("segment", T.LongType()),
                         T.StructField("m", T.ArrayType(T.DoubleType()))])
    made_schema = to_arrow_schema(made)
    each = placed.select("conv", "segment", "place", "role").groupBy(deal("conv", "segment")).applyInArrow(
        matrices, made)

    def chain(table: pa.Table) -> pa.Table:
        """Cheapest states at the borders of the segments of conversations."""
        order = table.sort_by([("conv", "ascending"), ("segment", "ascending")])
        every = [np.asarray(m).reshape(4, 4) for m in order.column("m").to_pylist()]
        starts, stops, lasts, totals = [], [], [], []
        for a, b in _slices(order, ("conv",)):
            states, cost = _borders(every[a:b])
            starts += states[:-1]
            stops += states[1:]
            lasts += [False] * (b - a - 1) + [True]
            totals += [cost] * (b - a)
        return pa.table({
            "conv": order.column("conv"), "segment": order.column("segment"), "start": pa.array(starts, pa.int32()),
            "stop": pa.array(stops, pa.int32()), "last": pa.array(lasts, pa.bool_()),
            "cost": pa.array(totals, pa.float64())}, schema=border_schema)

    border = T.StructType([
        T.StructField("conv", conv), T.StructField("segment", T.LongType()), T.StructField("start", T.IntegerType()),
        T.StructField("stop", T.IntegerType()), T.StructField("last", T.BooleanType()),
        T.StructField("cost", T.DoubleType())])
    border_schema = to_arrow_schema(border)
    borders = each.groupBy(deal("conv")).applyInArrow(chain, border).withColumnsRenamed(
        {"conv": "b_conv", "segment": "b_segment"})

    def write_out(table: pa.Table) -> pa.Table:
        order = table.sort_by([("conv", "ascending"), ("segment", "ascending"), ("place", "ascending")])
        column = {c: order.column(c).to_pylist() for c in ("role", "text", "start", "stop", "last")}
        roles, actions, inserts, pieces = [], [], [], []
        for a, b in _slices(order, ("conv", "segment")):
            given = [_given(r) for r in column["role"][a:b]]
            start, stop = column["start"][a], column["stop"][a]
            _, done = repair(given, start, stop)
            for i, (role, merged, inserted) in enumerate(done):
                tail = END[stop] if column["last"][a] and a + i == b - 1 else None
                actions.append(("merge" if merged else "keep") + ("" if given[i] == role else "+relabel"))
                roles.append(ROLES[role])
                inserts.append([ROLES[r] for r in (*inserted, *(tail or ()))])
                # A turn is closed by whoever comes next, so merged text continues it.
                opened = "\n" if merged else "".join(
                    [CLOSE if i or start != START else "", *(_header(r) + CLOSE for r in inserted), _header(role)])
                closed = "" if tail is None else "".join([CLOSE, *(_header(r) + CLOSE for r in tail)])
                pieces.append(opened + column["text"][a + i] + closed)
        return pa.table({
            "conv": order.column("conv"), "place": order.column("place"), "role": pa.array(roles, pa.string()),
            "action": pa.array(actions, pa.string()), "inserted": pa.array(inserts, pa.list_(pa.string())),
            "rendered": pa.array(pieces, pa.string()), "cost": order.column("cost")}, schema=out_schema)

    out = T.StructType([
        T.StructField("conv", conv), T.StructField("place", T.LongType()), T.StructField("role", T.StringType()),
        T.StructField("action", T.StringType()), T.StructField("inserted", T.ArrayType(T.StringType())),
        T.StructField("rendered", T.StringType()), T.StructField("cost", T.DoubleType())])
    out_schema = to_arrow_schema(out)
    joined = placed.join(borders, placed["conv"].eqNullSafe(F.col("b_conv")) & (F.col("segment") == F.col("b_segment")))
    return joined.select("conv", "segment", "place", "role", "text", "start", "stop", "last", "cost").groupBy(
        deal("conv", "segment")).applyInArrow(write_out, out)


def rendered(pieces: list[str]) -> str:
    """A whole conversation from its pieces in order."""
    return "".join(pieces)


def turns_of(text: str) -> Iterator[tuple[str, str]]:
    """``(role, text)`` of a rendered conversation whose texts hold no marks."""
    for part in text.split(CLOSE)[:-1]:
        head, _, body = part.partition("|>\n")
        yield head.removeprefix("<|"), body
