"""Repair of conversation structure by depth-first branch-and-bound.

A conversation is its rows in order of turn. Rows may be blank, repeat an earlier row or break off,
and roles may not alternate. The cheapest edits are wanted that leave the initials of the roles in
the form ``(s?(ua)+)?``: Keep costs 0, Rerole to user or assistant 3, Delete 4 (required for blank
and duplicate rows), Insert of an empty user or assistant row 3; a truncated row that stays costs 3
more. The audit is the edits' initials in order; of equally cheap audits the ASCII-least counts.

The search keeps an explicit stack of nodes (rows used, state of the form, cost, audit). A node goes
if its cost and the suffix lower bound of its place exceed the incumbent, or if they equal
it and its audit is no smaller, or if its place's dominance table holds a prefix that is no worse. A
worse prefix can be dropped, since equally costly prefixes of one place are never prefixes of
each other, so that what follows does not change their order. The search ends with an empty stack.

Rows are numbered by one global sort, never by a window over a conversation, and a conversation that
is long or stands on both sides of a boundary of the sort is searched in pieces of at most ``PIECE``
rows: each piece for every pair of states at its ends, then the pieces' results are joined in order,
with the same dominance by state. So no task holds more than a piece of rows at a time.

Null role or text counts as one space. Rows of one turn follow each other by role, then by the MD5 of
their text; null turns come first. A null conversation id is a conversation of its own. An initial
that is not s, u or a (case counts) never stands in the form. Other columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ledgerlens.session import written

#: Rows of one conversation that are searched at once; a power of two.
PIECE = 1024
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States of the form: nothing yet, after s, after u, after a. The initial that may follow, and
#: where it leads to; the form may end in ``ENDS``.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
TURN = ("u", "u", "a", "u")
ENDS = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
#: Faults of a row; the first that holds counts.
FINE, BLANK, DUPLICATE, CUT_OFF = "", "blank", "duplicate", "truncated"
_INFINITE = 1 << 60

Row = tuple[str, str]


def edits(row: Row, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of what may happen to a row in a state."""
    initial, fault = row
    made = [("D", DELETE, state)]
    if fault in (BLANK, DUPLICATE):
        return made
    more = TRUNCATED if fault == CUT_OFF else 0
    if initial in NEXT[state]:
        made.append(("K", more, NEXT[state][initial]))
    if initial != TURN[state]:
        made.append(("R", REROLE + more, NEXT[state][TURN[state]]))
    return made


def suffix_bounds(rows: tuple[Row, ...], goals: tuple[int, ...]) -> list[list[int]]:
    """For every number of used rows and state, no completion costs less."""
    after = [0 if s in goals else _INFINITE for s in range(4)]
    bounds = []
    for row in (None, *reversed(rows)):
        if row is not None:
            after = [min(c + bounds[-1][s] for _, c, s in edits(row, here)) for here in range(4)]
        # One insertion leads from u to a and from any other state to u; two are enough for all.
        for _ in range(2):
            after = [min(after[s], INSERT + after[NEXT[s][TURN[s]]]) for s in range(4)]
        bounds.append(after)
    return bounds[::-1]


def search(rows: tuple[Row, ...], entry: int, goals: tuple[int, ...]) -> tuple[int, str] | None:
    """(cost, audit) of the best edits from state ``entry`` to one of ``goals``; None: no way."""
    bounds = suffix_bounds(rows, goals)
    best = (_INFINITE, "")
    tables: list[dict[int, tuple[int, str]]] = [{} for _ in range(len(rows) + 1)]
    stack = [(0, entry, 0, "")]
    while stack:
        used, state, cost, audit = stack.pop()
        least = cost + bounds[used][state]
        if least > best[0] or (least == best[0] and audit > best[1][: len(audit)]):
            continue
        known = tables[used].get(state)
        if known is not None and known <= (cost, audit):
            continue
        tables[used][state] = (cost, audit)
        if used == len(rows) and state in goals:
            best = min(best, (cost, audit))
        nodes = [(used, NEXT[state][TURN[state]], cost + INSERT, audit + "I")]
        if used < len(rows):
            nodes += [(used + 1, s, cost + c, audit + k) for k, c, s in edits(rows[used], state)]
        # The most promising node is taken next, of equally good ones the least audit.
        nodes.sort(key=lambda n: (n[2] + bounds[n[0]][n[1]], n[3]), reverse=True)
        stack += nodes
    return best if best[0] < _INFINITE else None


@lru_cache(maxsize=1 << 16)
def _short(rows: tuple[Row, ...]) -> tuple[int, str]:
    return search(rows, 0, ENDS)


def repaired_whole(rows: tuple[Row, ...]) -> tuple[int, str]:
    """(cost, audit) of a whole conversation; short ones of the same shape are searched once."""
    return _short(rows) if len(rows) <= 16 else search(rows, 0, ENDS)


def layout(initials: str, entry: int, audit: str) -> list[list[str]]:
    """What each row becomes: roles of inserted rows, and "" for the row under its own role.

    A reroled row stands as "=" and its role. Insertions stand before the row they precede;
    those at the end stand behind the last row.
    """
    made: list[list[str]] = [[] for _ in initials]
    state, at, waiting = entry, 0, []
    for letter in audit:
        if letter == "I":
            waiting.append(ROLES[TURN[state]])
            state = NEXT[state][TURN[state]]
            continue
        if letter == "K":
            waiting.append("")
            state = NEXT[state][initials[at]]
        elif letter == "R":
            waiting.append("=" + ROLES[TURN[state]])
            state = NEXT[state][TURN[state]]
        made[at], waiting, at = waiting, [], at + 1
    if made:
        made[-1] += waiting
    return made


def _streamed(rows: DataFrame, schema: str, convert) -> DataFrame:
    """Rows of sorted partitions through ``convert``, which takes and gives tuples."""
    arrow_schema = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tuples() -> Iterator[tuple]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    yield from zip(*[c.to_pylist() for c in batch.slice(at, 256).columns])

        waiting = []
        for made in convert(tuples()):
            waiting.append(made)
            if len(waiting) == 256:
                yield _batch(waiting, arrow_schema)
                waiting = []
        if waiting:
            yield _batch(waiting, arrow_schema)

    return rows.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _initial(role: Column) -> Column:
    known = F.substring(role, 1, 1)
    return F.when(known.isin("s", "u", "a"), known).otherwise("?")


def numbered(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text, pos, digest, initial, blank, open): rows in order, as a table."""
    space = F.lit(" ")
    plain = rows.select(
        F.col(conv).alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), space).alias("role"),
        F.coalesce(F.col(text), space).alias("text"),
        F.monotonically_increasing_id().alias("tie"),
    )
    bare = F.rtrim(F.col("text"), F.lit(" \t\n\v\f\r"))
    marked = plain.select(
        "*",
        F.md5("text").alias("digest"),
        _initial(F.col("role")).alias("initial"),
        (bare == "").alias("blank"),
        (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("open"),
    )
    ordered = marked.orderBy("conv", "turn", "role", "digest", "tie").drop("tie")
    placed, _ = written(ordered.withColumn("pos", F.monotonically_increasing_id()), "placed")
    return placed


def _flagged(placed: DataFrame) -> DataFrame:
    """(conv, piece, pos, turn, initial, fault, cut), by piece and in order."""
    first = placed.groupBy("conv", "role", "digest").agg(F.min("pos").alias("pos"))
    piece = F.shiftright("pos", PIECE.bit_length() - 1).alias("piece")
    spans = placed.select("conv", piece).groupBy("conv")
    spans = spans.agg(F.min("piece").alias("low"), F.max("piece").alias("high"))
    cut, _ = written(spans.where("low < high").select(F.col("conv").alias("long")), "cut")
    narrow = placed.select("conv", piece, "pos", "turn", "initial", "blank", "open")
    known = narrow.join(first.select("pos", F.lit(True).alias("new")), "pos", "left")
    known = known.join(
        cut.withColumn("cut", F.lit(True)), F.col("conv").eqNullSafe(F.col("long")), "left"
    )
    fault = (
        F.when(F.col("blank"), BLANK)
        .when(F.col("new").isNull(), DUPLICATE)
        .when(F.col("open"), CUT_OFF)
        .otherwise(FINE)
    )
    columns = ("conv", "piece", "pos", "turn", "initial", fault.alias("fault"))
    flagged = known.select(*columns, F.coalesce("cut", F.lit(False)).alias("cut"))
    return flagged.repartition("conv", "piece").sortWithinPartitions("conv", "piece", "pos")


_COUNTS = "blank bigint, duplicate bigint, truncated bigint, illegal bigint"
_PIECES = (
    "conv {conv}, piece bigint, cut boolean, pos bigint, initials string, low bigint, high bigint,"
    f" turns bigint, {_COUNTS}, ways array<struct<entry:int,end:int,cost:bigint,audit:string>>"
)
_PLANS = (
    "conv {conv}, gaps bigint, " + _COUNTS + ", cost bigint, audit string,"
    " parts array<struct<pos:bigint,initials:string,entry:int,audit:string>>"
)


def _pieces(rows: Iterable[tuple]) -> Iterator[tuple]:
    """One row for every conversation's part of a piece, with the ways through it."""
    for (conv, piece), group in groupby(rows, itemgetter(0, 1)):
        members = list(group)
        cut = members[0][6]
        shape = tuple((m[4], m[5]) for m in members)
        initials = "".join(m[4] for m in members)
        turns = {m[3] for m in members if m[3] is not None}
        if cut:
            found = ((e, g, search(shape, e, (g,))) for e in range(4) for g in range(4))
            ways = [(e, g, *way) for e, g, way in found if way]
        else:
            ways = [(0, None, *repaired_whole(shape))]
        yield (
            conv, piece, cut, members[0][2], initials,
            min(turns, default=None), max(turns, default=None), len(turns),
            *(sum(fault == kind for _, fault in shape) for kind in (BLANK, DUPLICATE, CUT_OFF)),
            sum(initials[i : i + 2] not in LEGAL for i in range(len(initials) - 1)),
            [dict(zip(("entry", "end", "cost", "audit"), way)) for way in ways],
        )


def _joined(rows: Iterable[tuple]) -> Iterator[tuple]:
    """One plan for every conversation, from its pieces in order."""
    for conv, group in groupby(rows, itemgetter(0)):
        low = high = last = None
        turns, sums, best = 0, [0, 0, 0, 0], {0: (0, "", None)}
        for _, _, _, pos, initials, least, most, own, *counts, ways in group:
            if least is not None:
                turns += own - (least == high)
                low, high = (least if low is None else low), most
            sums = [a + b for a, b in zip(sums, counts)]
            sums[3] += last is not None and last + initials[0] not in LEGAL
            last = initials[-1]
            ahead: dict[int, tuple] = {}
            for way in ways:
                if (before := best.get(way["entry"])) is None:
                    continue
                # The parts are a chain, so that equal beginnings are held once.
                part = (before[2], (pos, initials, way["entry"], way["audit"]))
                made = (before[0] + way["cost"], before[1] + way["audit"], part)
                if way["end"] not in ahead or made[:2] < ahead[way["end"]][:2]:
                    ahead[way["end"]] = made
            best = ahead
        cost, audit, chain = min((best[s] for s in ENDS if s in best), key=itemgetter(0, 1))
        parts = []
        while chain:
            chain, part = chain
            parts.append(dict(zip(("pos", "initials", "entry", "audit"), part)))
        gaps = 0 if low is None else high - low + 1 - turns
        yield (conv, gaps, *sums, cost, audit, parts[::-1])


def plans(placed: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, parts), as a table.

    ``gaps`` are the turns missing between the first and the last, ``illegal`` the neighbours whose
    initials are not su, ua or au. ``parts`` tell for each piece which edits were chosen.
    """
    conv = placed.schema["conv"].dataType.simpleString()
    schema = _PIECES.format(conv=conv)
    pieces, _ = written(_streamed(_flagged(placed), schema, _pieces), "pieces")
    way = F.col("ways")[0]
    part = F.struct("pos", "initials", F.lit(0).alias("entry"), way["audit"].alias("audit"))
    whole = pieces.where(~F.col("cut")).select(
        "conv",
        F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps"),
        *("blank", "duplicate", "truncated", "illegal"),
        way["cost"].alias("cost"),
        way["audit"].alias("audit"),
        F.array(part).alias("parts"),
    )
    parts = pieces.where("cut").repartition("conv").sortWithinPartitions("conv", "piece")
    joined = _streamed(parts, _PLANS.format(conv=conv), _joined)
    return written(whole.union(joined), "plans")[0]


def repaired(placed: DataFrame, plan: DataFrame) -> DataFrame:
    """(conv, pos, k, role, text): the rows after repair, in order of ``pos`` and ``k``."""

    def expand(rows: Iterable[tuple]) -> Iterator[tuple]:
        for pos, initials, entry, audit in rows:
            for i, becomes in enumerate(layout(initials, entry, audit)):
                if becomes:
                    yield pos + i, becomes

    parts = plan.select(F.explode("parts").alias("p")).select("p.*")
    made = _streamed(parts, "pos bigint, becomes array<string>", expand)
    rows = placed.select("conv", "pos", "role", "text").join(made, "pos")
    rows = rows.select("*", F.posexplode("becomes").alias("k", "as"))
    own, rerole = F.col("as") == "", F.startswith("as", F.lit("="))
    role = F.when(own, F.col("role")).when(rerole, F.expr("substring(as, 2)")).otherwise(F.col("as"))
    text = F.when(own | rerole, F.col("text")).otherwise("")
    return rows.select("conv", "pos", "k", role.alias("role"), text.alias("text"))


def digests(rows: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of repaired rows as role:text, joined by newlines.

    Each conversation streams through one task a row at a time: a hash can't be taken in parts.
    """
    conv = rows.schema["conv"].dataType.simpleString()

    def hashed(lines: Iterable[tuple]) -> Iterator[tuple]:
        for key, group in groupby(lines, itemgetter(0)):
            made = hashlib.sha256()
            for i, (_, _, _, role, text) in enumerate(group):
                made.update(f"{chr(10) * (i > 0)}{role}:{text}".encode())
            yield key, made.hexdigest()

    ordered = rows.repartition("conv").sortWithinPartitions("conv", "pos", "k")
    return _streamed(ordered, f"conv {conv}, repaired_sha256 string", hashed)


def repair(
    rows: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """(plans, repaired rows) of conversations; an empty table has neither."""
    placed = numbered(rows, id_col, turn_col, role_col, text_col)
    plan = plans(placed)
    return plan, repaired(placed, plan)
