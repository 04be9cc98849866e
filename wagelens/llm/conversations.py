"""Cheapest repairs of conversations, as lightest derivations.

A repaired conversation's role initials read ``(s?(ua)+)?``: maybe a system turn, then user and
assistant in turn. An item ``(i, q)`` says that the first ``i`` rows are dealt with and the
roles kept so far lead to state ``q`` of that pattern. Edits are deductions from item to item;
each adds its cost and its initial, ``(cost, audit)``, which can only grow. So the agenda pops
items in the order of their values, an item's first pop is its lightest derivation (Knuth's
generalization of shortest paths to superior functions), and the first goal popped is the
cheapest repair, the ASCII-least audit among equals.

Rows are sorted by range partitioning over (conversation, turn, role, text), so a conversation
that holds a third of all rows is spread over many tasks. A task cuts it into segments of
bounded size and derives, for every pair of states, the lightest way through each; segments
are axioms of the same deduction system. They are joined by a stream that keeps the four
values of a border and, of their audits, only what differs. A conversation that lies inside
one task and one segment is finished there.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wagelens.session import staging_path

# Costs of the edits, and of a truncated row that stays.
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
# The most rows and characters of a segment.
SEGMENT_ROWS = 256
SEGMENT_CHARS = 4_000_000

# States: nothing yet, after a system turn, after a user, after an assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
ACCEPTED = (START, ASSISTANT)
LEGAL_PAIRS = ("su", "ua", "au")

_BLANK = " \t\n\x0b\x0c\r"
_BATCH = 1_000

Value = tuple[int, str]
# A row that may stay: role, text, whether it is truncated. A number: so many rows that must go.
Row = tuple[str, str, bool] | int
Arc = tuple[int, str, int, int]


def kept_state(state: int, initial: str) -> int | None:
    """Where a kept row of this role leads."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if initial == "a" and state == USER else None


def next_state(state: int) -> int:
    """Where a turn in the one role that fits leads: an assistant's after a user, else a user's."""
    return ASSISTANT if state == USER else USER


def lightest(starts: dict[int, Value], deduce: Callable[[int, int], Iterable[Arc]], n: int, goals: tuple[int, ...],
             first: bool = False) -> dict[int, tuple[Value, int]]:
    """The lightest derivation of each goal item ``(n, q)``, with the start it comes from.

    With ``first`` the agenda stops at the first goal that is finalised.
    """
    agenda = [(cost, audit, 0, q, q) for q, (cost, audit) in starts.items()]
    heapq.heapify(agenda)
    final: set[tuple[int, int]] = set()
    found: dict[int, tuple[Value, int]] = {}
    while agenda and len(found) < len(goals):
        cost, audit, i, q, origin = heapq.heappop(agenda)
        if (i, q) in final:
            continue
        final.add((i, q))
        if i == n and q in goals:
            found[q] = (cost, audit), origin
            if first:
                break
        for more, marks, j, r in deduce(i, q):
            if (j, r) not in final:
                heapq.heappush(agenda, (cost + more, audit + marks, j, r, origin))
    return found


def edits(rows: list[Row]) -> Callable[[int, int], Iterator[Arc]]:
    """The deductions that edits of these rows allow.

    Rows that must go are one deduction: an insertion between them costs the same behind them
    and sorts later in the audit.
    """

    def deduce(i: int, q: int) -> Iterator[Arc]:
        yield INSERT, "I", i, next_state(q)
        if i == len(rows):
            return
        row = rows[i]
        if isinstance(row, int):
            yield DELETE * row, "D" * row, i + 1, q
            return
        role, _, truncated = row
        stays = TRUNCATED if truncated else 0
        yield DELETE, "D", i + 1, q
        yield REROLE + stays, "R", i + 1, next_state(q)
        kept = kept_state(q, role[:1])
        if kept is not None:
            yield stays, "K", i + 1, kept

    return deduce


def cheapest(rows: list[Row]) -> Value:
    """The cheapest repair of a whole conversation: its cost and its audit."""
    found = lightest({START: (0, "")}, edits(rows), len(rows), ACCEPTED, first=True)
    ((value, _),) = found.values()
    return value


def segment_paths(rows: list[Row]) -> list[dict]:
    """The lightest way through a segment from every state to every other."""
    return [
        {"p": p, "q": q, "cost": cost, "audit": audit}
        for p in STATES
        for q, ((cost, audit), _) in lightest({p: (0, "")}, edits(rows), len(rows), STATES).items()
    ]


def applied(rows: list[Row], audit: str, state: int = START) -> list[tuple[str, str]]:
    """The role and text of every row that the edits leave or insert."""
    out, i, gone = [], 0, 0
    for edit in audit:
        if edit == "D":
            gone += 1
            if isinstance(rows[i], int) and gone < rows[i]:
                continue
            i, gone = i + 1, 0
            continue
        fitting = "assistant" if state == USER else "user"
        if edit == "I":
            out.append((fitting, ""))
            state = next_state(state)
            continue
        role, text, _ = rows[i]
        i += 1
        if edit == "K":
            out.append((role, text))
            state = kept_state(state, role[:1])
        else:
            out.append((fitting, text))
            state = next_state(state)
    return out


# ---- segments ------------------------------------------------------------------

_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_REPORT = ("gaps", *_COUNTS, "cost", "audit")
_TURN = pa.struct([("role", pa.string()), ("text", pa.string()), ("truncated", pa.bool_()), ("n", pa.int64())])
_PATH = pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
_TURN_SQL = "array<struct<role: string, text: string, truncated: boolean, n: bigint>>"
_KEY = [("conv_id", pa.int64()), ("part", pa.int32()), ("number", pa.int64())]
_BORDERS = [
    ("first_role", pa.string()), ("last_role", pa.string()),
    ("low", pa.int64()), ("high", pa.int64()), ("n_turns", pa.int64()),
]
_SEGMENT = pa.schema([
    *_KEY, ("whole", pa.bool_()), *[(c, pa.int64()) for c in _COUNTS], *_BORDERS,
    ("cost", pa.int64()), ("audit", pa.string()), ("paths", pa.list_(_PATH)), ("turns", pa.list_(_TURN)),
])
_SEGMENT_SQL = (
    "conv_id bigint, part int, number bigint, whole boolean, blank bigint, duplicate bigint, truncated bigint,"
    " illegal bigint, first_role string, last_role string, low bigint, high bigint, n_turns bigint, cost bigint,"
    f" audit string, paths array<struct<p: int, q: int, cost: bigint, audit: string>>, turns {_TURN_SQL}"
)


class _Segment:
    """Neighbouring rows of one conversation: their faults, and what their borders need."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.rows, self.chars = conv_id, [], 0
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.first_role = self.last_role = self.low = self.high = None
        self.n_turns = 0

    def add(self, turn: int | None, role: str, text: str, n: int, again: bool) -> None:
        """``n`` equal rows of one turn; ``again``: they stand in an earlier turn as well."""
        if not n:
            return
        if self.last_role is None:
            self.first_role = role[:1]
        elif self.last_role + role[:1] not in LEGAL_PAIRS:
            self.counts["illegal"] += 1
        self.counts["illegal"] += n - 1
        self.last_role = role[:1]
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.n_turns += turn != self.high
            self.high = turn
        stripped = text.rstrip(_BLANK)
        go = n
        if not stripped:
            self.counts["blank"] += n
        elif again:
            self.counts["duplicate"] += n
        else:
            truncated = stripped[-1] not in ".!?"
            self.counts["truncated"] += truncated
            self.counts["duplicate"] += n - 1
            self.rows.append((role, text, truncated))
            go = n - 1
        if go:
            self.rows.append(go)
        self.chars += len(text)

    def full(self) -> bool:
        return len(self.rows) >= SEGMENT_ROWS or self.chars >= SEGMENT_CHARS

    def row(self, part: int, number: int, whole: bool) -> dict:
        out = {
            "conv_id": self.conv_id, "part": part, "number": number, "whole": whole, **self.counts,
            "first_role": self.first_role, "last_role": self.last_role,
            "low": self.low, "high": self.high, "n_turns": self.n_turns,
        }
        if whole:
            out["cost"], out["audit"] = cheapest(self.rows)
            turns = [{"role": r, "text": t} for r, t in applied(self.rows, out["audit"])]
        else:
            out["paths"] = segment_paths(self.rows)
            turns = [
                {"n": r} if isinstance(r, int) else {"role": r[0], "text": r[1], "truncated": r[2]} for r in self.rows
            ]
        return out | {"turns": turns}


def _in_batches(rows: Iterable[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(t["text"] or "") if t.get("text") else 0 for t in row.get("turns") or ())
        if len(held) >= _BATCH or size >= SEGMENT_CHARS:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The segments of one sorted part. What touches a border of the part may go on beyond it."""
    part = TaskContext.get().partitionId()

    def rows() -> Iterator[dict]:
        segment, number, open_run = None, 0, True
        for batch in batches:
            for conv_id, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if segment is None:
                    segment = _Segment(conv_id)
                elif segment.conv_id != conv_id:
                    yield segment.row(part, number, not open_run)
                    segment, number, open_run = _Segment(conv_id), number + 1, False
                elif segment.full():
                    yield segment.row(part, number, False)
                    segment, number, open_run = _Segment(conv_id), number + 1, True
                segment.add(*row)
        if segment is not None:
            yield segment.row(part, number, False)

    yield from _in_batches(rows(), _SEGMENT)


# ---- from segments to conversations ---------------------------------------------

_JOINED = pa.schema([
    ("part", pa.int32()), ("number", pa.int64()), ("start", pa.int32()), ("edits", pa.string()),
    *[(c, pa.string() if c == "audit" else pa.int64()) for c in _REPORT],
])
_REPORT_SQL = ", ".join(f"{c} {'string' if c == 'audit' else 'bigint'}" for c in _REPORT)
_JOINED_SQL = f"part int, number bigint, start int, edits string, {_REPORT_SQL}"


def gaps(low: int | None, high: int | None, n_turns: int) -> int:
    return 0 if low is None else high - low + 1 - n_turns


class _Stream:
    """A conversation under way, segment by segment: four values, their audits without the
    part they share, and for every segment where each state came from."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.values: dict[int, Value] = {START: (0, "")}
        self.shared: list[str] = []
        self.steps: list[tuple[int, int, dict[int, tuple[int, int]]]] = []
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.last_role = self.low = self.high = None
        self.n_turns = 0

    def add(self, row: dict) -> None:
        for c in _COUNTS:
            self.counts[c] += row[c]
        if row["first_role"] is not None:
            if self.last_role is not None and self.last_role + row["first_role"] not in LEGAL_PAIRS:
                self.counts["illegal"] += 1
            self.last_role = row["last_role"]
        if row["low"] is not None:
            self.n_turns += row["n_turns"] - (row["low"] == self.high)
            self.low = row["low"] if self.low is None else self.low
            self.high = row["high"]
        through: dict[int, list[Arc]] = {}
        for path in row["paths"]:
            through.setdefault(path["p"], []).append((path["cost"], path["audit"], 1, path["q"]))
        found = lightest(self.values, lambda i, q: through.get(q, ()) if i == 0 else (), 1, STATES)
        sizes = {q: len(audit) for q, (_, audit) in self.values.items()}
        self.steps.append((
            row["part"], row["number"],
            {q: (origin, len(audit) - sizes[origin]) for q, ((_, audit), origin) in found.items()},
        ))
        common = len(os.path.commonprefix([audit for (_, audit), _ in found.values()]))
        self.shared.append(next(iter(found.values()))[0][1][:common])
        self.values = {q: (cost, audit[common:]) for q, ((cost, audit), _) in found.items()}

    def rows(self) -> Iterator[dict]:
        (cost, rest), state = min((self.values[q], q) for q in ACCEPTED if q in self.values)
        audit = "".join(self.shared) + rest
        ways, end = [], len(audit)
        for part, number, back in reversed(self.steps):
            start, size = back[state]
            ways.append({"part": part, "number": number, "start": start, "edits": audit[end - size : end]})
            state, end = start, end - size
        ways[0] |= {"gaps": gaps(self.low, self.high, self.n_turns), **self.counts, "cost": cost, "audit": audit}
        yield from reversed(ways)


def _join_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[dict]:
        stream = None
        for batch in batches:
            for i in range(batch.num_rows):
                (row,) = batch.slice(i, 1).to_pylist()
                if stream is None or stream.conv_id != row["conv_id"]:
                    if stream is not None:
                        yield from stream.rows()
                    stream = _Stream(row["conv_id"])
                stream.add(row)
        if stream is not None:
            yield from stream.rows()

    yield from _in_batches(rows(), _JOINED)


_PIECE = pa.schema([
    *_KEY, *[(c, pa.string() if c == "audit" else pa.int64()) for c in _REPORT], ("turns", pa.list_(_TURN)),
])
_PIECE_SQL = f"conv_id bigint, part int, number bigint, {_REPORT_SQL}, turns {_TURN_SQL}"


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[dict]:
        for batch in batches:
            for i in range(batch.num_rows):
                (row,) = batch.slice(i, 1).to_pylist()
                before = [t["n"] or (t["role"], t["text"], t["truncated"]) for t in row["turns"]]
                after = [{"role": r, "text": t} for r, t in applied(before, row["edits"], row["start"])]
                yield {name: row.get(name) for name in _PIECE.names} | {"turns": after}

    yield from _in_batches(rows(), _PIECE)


# ---- DataFrames ------------------------------------------------------------------


@dataclass(frozen=True)
class Repair:
    """Repaired conversations: ``whole`` in one row each, ``parts`` in several, ``part`` and ``number``
    telling their order and the last one having the report. ``turns`` are the role and text of
    what is left, in order."""

    whole: DataFrame
    parts: DataFrame

    def pieces(self) -> DataFrame:
        return self.whole.unionByName(self.parts)

    def turns(self) -> DataFrame:
        """``conv_id, part, number, place, role, text``, one turn a row."""
        return self.pieces().select("conv_id", "part", "number", F.posexplode("turns").alias("place", "turn")).select(
            "conv_id", "part", "number", "place", "turn.role", "turn.text"
        )

    def reports(self) -> DataFrame:
        """``conv_id``, gaps, faults, cost and audit of every conversation."""
        return self.pieces().where(F.col("cost").isNotNull()).select("conv_id", *_REPORT)

    def digests(self) -> DataFrame:
        """The reports with ``repaired_sha256``, the checksum of ``role:text`` lines. A checksum runs
        from a conversation's first row to its last, so its parts pass through it one by one."""
        lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
        whole = self.whole.select(
            "conv_id", *_REPORT, F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256")
        )
        in_order = self.parts.repartition("conv_id").sortWithinPartitions("conv_id", "part", "number")
        return whole.unionByName(in_order.mapInArrow(_digest_parts, _DIGEST_SQL))


def _spaced(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def counted_rows(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, n, again``: equal rows of a turn once, with their number, and
    whether the same role and text stand in an earlier turn.

    ``rows`` may have a column ``copies``; 0 keeps the conversation without the row. A null role
    or text counts as one space. Rows are counted and first turns found by aggregation, which
    combines before the shuffle, so no group of equal rows meets in one task.
    """
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    counted = (
        rows.select(
            F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), _spaced("role").alias("role"),
            _spaced("text").alias("text"), copies.cast("bigint").alias("copies"),
        )
        .groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("n"))
        # The length keeps role and text apart.
        .withColumn("said", F.unhex(F.md5(F.concat_ws(":", F.length("role"), F.concat("role", "text")))))
    )
    repeated = (
        counted.where("n > 0")
        .groupBy(F.col("conv_id").alias("conv_id__r"), F.col("said").alias("said__r"))
        .agg(
            F.min("turn").alias("first_turn"), F.bool_or(F.col("turn").isNull()).alias("without_turn"),
            F.count(F.lit(1)).alias("times"),
        )
        .where("times > 1")
    )
    later = F.when(F.col("without_turn"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("first_turn"))
    same = F.col("conv_id").eqNullSafe(F.col("conv_id__r")) & (F.col("said") == F.col("said__r"))
    return counted.join(repeated, same, "left").select(
        "conv_id", "turn", "role", "text", "n", F.coalesce(later, F.lit(False)).alias("again")
    )


def repaired(rows: DataFrame) -> Repair:
    """Every conversation's repair.

    Rows of a conversation stand by turn, nulls first; equal turns by role, then text. Rows
    without a conversation are one conversation. Faults, edits and costs are those of the
    module. The segments are staged.
    """
    spark = rows.sparkSession
    path = staging_path(spark, "segments")
    ordered = (
        counted_rows(rows)
        # The start of a text keeps the range keys small; it sorts as the whole text does.
        .repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64))
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )
    ordered.mapInArrow(_segments, _SEGMENT_SQL).write.option("compression", "zstd").parquet(path)
    segments = spark.read.schema(_SEGMENT_SQL).parquet(path)
    whole = segments.where("whole").select(
        "conv_id", F.lit(None).cast("int").alias("part"), F.lit(None).cast("bigint").alias("number"),
        F.when(F.col("low").isNull(), F.lit(0)).otherwise(F.col("high") - F.col("low") + 1 - F.col("n_turns"))
        .cast("bigint").alias("gaps"),
        *_COUNTS, "cost", "audit", "turns",
    )
    in_parts = segments.where("not whole")
    ways = (
        in_parts.drop("turns", "whole", "cost", "audit")
        .repartition("conv_id").sortWithinPartitions("conv_id", "part", "number")
        .mapInArrow(_join_segments, _JOINED_SQL)
    )
    pieces = in_parts.select("conv_id", "part", "number", "turns").join(ways, ["part", "number"])
    return Repair(whole, pieces.mapInArrow(_apply, _PIECE_SQL))


def _line(turn: dict) -> bytes:
    return f"{turn['role']}:{turn['text']}".encode()


_DIGEST_SQL = f"conv_id bigint, {_REPORT_SQL}, repaired_sha256 string"
_DIGEST = pa.schema([f for f in _PIECE if f.name not in ("part", "number", "turns")]).append(
    pa.field("repaired_sha256", pa.string())
)


def _digest_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A checksum over the parts of each conversation, which come in order; the last has the report."""

    def rows() -> Iterator[dict]:
        checksum, begun = hashlib.sha256(), False
        for batch in batches:
            for i in range(batch.num_rows):
                (row,) = batch.slice(i, 1).to_pylist()
                for turn in row["turns"]:
                    checksum.update(b"\n" * begun + _line(turn))
                    begun = True
                if row["cost"] is not None:
                    yield {name: row.get(name) for name in _DIGEST.names} | {"repaired_sha256": checksum.hexdigest()}
                    checksum, begun = hashlib.sha256(), False

    yield from _in_batches(rows(), _DIGEST)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with the damage that a checksum of their place names, as ``copies`` and changed values."""
    kind = F.crc32(F.concat(_spaced("conv_id"), F.lit(":"), _spaced("turn"))) % 20
    text, role = _spaced("text"), _spaced("role")
    return rows.select(
        "conv_id", "turn",
        F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, F.lit(0)).when(kind == 3, F.lit(2)).otherwise(F.lit(1)).alias("copies"),
    )


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` for every
    ``conv_id`` of ``conversations (conv_id, turn, role, text)``, damaged and repaired.

    Nulls count as one space where they are text. A conversation of which the damage leaves
    nothing has zeros, an empty audit and the checksum of an empty text; an empty table has no rows.
    """
    return repaired(damaged(conversations)).digests()
