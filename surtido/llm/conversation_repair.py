"""Conversation structure repair: faults of turns, and the cheapest edits that give sound roles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surtido.llm.columns import BLANKS, WORD, small_batches
from surtido.llm.turn_edits import (
    BLANK, DUPLICATE, SOUND, TRUNCATED, all_ends, apply_edits, cheapest_edits, join_pieces)
from surtido.session import materialize

PIECE = 1000           # turns of a long conversation that are searched together
HELD_TURNS = 5000      # turns, and
HELD_CHARS = 4 << 20   # characters of a conversation that a task holds before it counts as long
ENDS = ".!?"
LONG = 2**63 - 1

TURN, REPORT, OPEN = range(3)  # kinds of rows that the first pass gives

COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


class Repaired(NamedTuple):
    """``reports``: conv_id, the COUNTS, audit. ``turns``: conv_id, place, turn, role, text, edit."""

    reports: DataFrame
    turns: DataFrame


def damage(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of ``df`` with faults put in, by ``crc32(conv_id:turn) % 20``.

    0 drops the turn, 1 empties its text, 2 takes its ends of sentences, 3 says it twice, 4 makes it
    the user's. Nulls stand for one space, but a null conv_id or turn stays null in its column.
    """
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    harm = F.crc32(F.concat_ws(":", told("conv_id"), told("turn"))) % 20
    text = F.when(F.col("_harm") == 1, "").when(
        F.col("_harm") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    said = F.explode(F.array_repeat(F.lit(0), F.when(F.col("_harm") == 0, 0).when(F.col("_harm") == 3, 2).otherwise(1)))
    rows = df.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), harm.alias("_harm"))
    return rows.select("conv_id", "turn", F.when(F.col("_harm") == 4, "user").otherwise(F.col("role")).alias("role"),
                       text.alias("text"), said.alias("_said")).drop("_said")


def _fault(text: Column) -> Column:
    last = F.right(F.rtrim(text, F.lit(BLANKS)), F.lit(1))
    return F.when(~text.rlike(WORD), BLANK).when(~last.isin(list(ENDS)), TRUNCATED).otherwise(SOUND)


@dataclass
class _Tally:
    """Counts of one run of turns, in order."""

    turns: int = 0
    faults: list[int] = field(default_factory=lambda: [0] * 4)
    illegal: int = 0
    low: int | None = None
    high: int | None = None
    distinct: int = 0
    first: str = ""
    last: str = ""

    def add(self, other: _Tally) -> None:
        """``other`` comes next."""
        if self.turns and other.turns:
            self.illegal += self.last + other.first not in ("su", "ua", "au")
        if other.turns:
            self.first = self.first if self.turns else other.first
            self.last = other.last
        self.turns += other.turns
        self.faults = [a + b for a, b in zip(self.faults, other.faults)]
        self.illegal += other.illegal
        if other.low is not None:
            self.distinct += other.distinct - (other.low == self.high)
            self.low, self.high = other.low if self.low is None else self.low, other.high

    def report(self) -> dict[str, int]:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return {"gaps": min(gaps, LONG), "blank": self.faults[BLANK], "duplicate": self.faults[DUPLICATE],
                "truncated": self.faults[TRUNCATED], "illegal": self.illegal}


def _tally(turns: Iterable[tuple[int | None, str, int]]) -> _Tally:
    """Of (turn, role initial, fault) in order."""
    out = _Tally()
    for turn, initial, fault in turns:
        one = _Tally(1, [0] * 4, 0, turn, turn, int(turn is not None), initial, initial)
        one.faults[fault] = 1
        out.add(one)
    return out


class _Rows:
    """Rows of one schema, gathered into batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.chars = schema, [], 0

    def add(self, **row: Any) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.chars += len(row.get("text") or "")
        if len(self.rows) >= HELD_TURNS or self.chars >= HELD_CHARS:
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        rows, self.rows, self.chars = self.rows, [], 0
        return pa.RecordBatch.from_pylist(rows, self.schema)


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[Any, Iterator[dict]]]:
    """Rows that follow each other with one key; a run must be read to its end."""
    rows = (row for batch in batches for row in batch.to_pylist())
    row = next(rows, None)
    while row is not None:
        now = row[key]

        def run() -> Iterator[dict]:
            nonlocal row
            while row is not None and row[key] == now:
                yield row
                row = next(rows, None)

        yield now, run()


def _first_pass(schema: pa.Schema):
    """Conversations that lie wholly in one sorted partition are done there; others' turns go on as they are.

    Which these are a task cannot know of its first and its last conversation.
    """
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, part, opening = _Rows(schema), TaskContext.get().partitionId(), True
        before: tuple[Any, list[dict]] | None = None  # whole, if another conversation follows
        for conv, run in _runs(batches, "conv_id"):
            if before:
                for row in _solve(*before):
                    yield from out.add(**row)
            held, chars, is_open = [], 0, opening
            for seq, row in enumerate(run):
                held.append({**row, "part": part, "seq": seq})
                chars += len(row["text"])
                is_open = is_open or len(held) > HELD_TURNS or chars > HELD_CHARS
                if is_open:
                    for row in held:
                        yield from out.add(kind=OPEN, **row)
                    held = []
            before, opening = (None if is_open else (conv, held)), False
        for row in before[1] if before else []:
            yield from out.add(kind=OPEN, **row)
        if out.rows:
            yield out.flush()
    return each


def _solve(conv: Any, turns: list[dict]) -> Iterator[dict]:
    """The report and the repaired turns of a whole conversation."""
    seen: set[tuple[str, str]] = set()
    for row in turns:
        said = (row["role"], row["text"])
        if row["fault"] != BLANK and said in seen:
            row["fault"] = DUPLICATE
        seen.add(said)
    cost, audit = cheapest_edits((row["role"][:1], row["fault"]) for row in turns)
    tally = _tally((row["turn"], row["role"][:1], row["fault"]) for row in turns)
    yield {"kind": REPORT, "conv_id": conv, **tally.report(), "cost": cost, "audit": audit}
    edits = apply_edits(audit, (row["role"][:1] for row in turns))
    for place, (edit, at, role) in enumerate(edits):
        own = turns[at] if at is not None else {"turn": None, "role": None, "text": ""}
        yield {"kind": TURN, "conv_id": conv, "seq": place, "turn": own["turn"],
               "role": role or own["role"], "text": own["text"], "edit": edit}


def repair(df: DataFrame, piece: int = PIECE) -> Repaired:
    """Faults and the cheapest repair of every conversation of ``df`` (conv_id, turn, role, text).

    A conversation's rows are taken by turn (nulls first), rows of one turn by role and a
    hash of the text. A row is blank, else a duplicate (role and text seen before), else
    truncated (the last character but white space ends no sentence). Each row is
    kept (0), given the role user or assistant (3) or deleted (4, as blank rows and duplicates must
    be); rows of either role with empty text are put in (3); a truncated row that stays
    adds 3. Of the edits that leave nothing, or an optional system turn and pairs of user and
    assistant, the cheapest are taken, of equal ones those whose initials sort first.

    Rows are range partitioned by conversation and turn, so a conversation with a third of all
    rows is spread over a third of the partitions. Those inside one partition are repaired in
    a stream, by a Viterbi search that gives out edits once all survivors share them.
    The rest is numbered by prefix sums and cut into pieces of ``piece`` turns. Each piece is
    searched from every state before it; the pieces' costs and edits are then joined in
    order by the same search, which gets a few short texts a piece, and the chosen
    edits meet their turns by position.

    ``reports`` has a row a conversation: ``gaps`` (missing numbers between its turns; 0 if all
    are null; at most the largest long), counts of faults, ``illegal`` (neighbours whose role
    initials are not su, ua or au), ``cost`` and ``audit``. ``turns`` has the repaired rows: ``place`` from 0, ``turn``
    (null if put in), role, text, ``edit``. Null role or text: one space. Null conv_id: a
    conversation. Empty role: an initial that fits nothing. Repeated rows: duplicates. Very long
    texts or conversations pass through in bounded batches; an audit is one value. Empty table: both empty. Other columns
    are ignored. Runs jobs when called.
    """
    kind = df.schema["conv_id"].dataType.simpleString()
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    small_batches(df.sparkSession)
    rows = df.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text"),
                     F.monotonically_increasing_id().alias("_row"))
    rows = rows.withColumns({"fault": _fault(F.col("text")), "_text": F.xxhash64("text")})
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "_text", "_row")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_row", "_text")
    made = (f"kind int, conv_id {kind}, part int, seq long, turn long, role string, text string, fault int, "
            + "edit string, audit string, " + ", ".join(f"{c} long" for c in COUNTS))
    first = materialize(ranged.mapInArrow(_first_pass(_arrow(df, made)), made), "conversations")

    reports, turns = _repair_open(first.filter(F.col("kind") == OPEN), kind, piece)
    return Repaired(
        first.filter(F.col("kind") == REPORT).select("conv_id", *COUNTS, "audit").unionByName(reports),
        first.filter(F.col("kind") == TURN).select(
            "conv_id", F.col("seq").alias("place"), "turn", "role", "text", "edit").unionByName(turns))


def _arrow(df: DataFrame, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.sparkSession.createDataFrame([], ddl).schema)


def meet(a: DataFrame, b: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """Join on equal keys, where a null equals a null."""
    named = b.withColumnsRenamed({k: f"_{k}" for k in keys})
    match = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return a.join(named, match, how).drop(*(f"_{k}" for k in keys))


def _repair_open(rows: DataFrame, kind: str, size: int) -> tuple[DataFrame, DataFrame]:
    """Reports and repaired turns of conversations that lie in several partitions, by pieces."""
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("conv_id", "part").count().select(  # two rows a partition at most, but for long runs
        "conv_id", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    placed = materialize(meet(rows, parts, "conv_id", "part").select(
        "conv_id", (F.col("offset") + F.col("seq")).alias("pos"), "turn", "role", "text", "fault",
        F.md5("text").alias("said")), "open-turns")

    firsts = placed.groupBy("conv_id", "role", "said").agg(F.min("pos").alias("pos")).select("conv_id", "pos", F.lit(1).alias("new"))
    narrow = placed.select("conv_id", "pos", "turn", F.left("role", F.lit(1)).alias("initial"), "fault")
    judged = meet(narrow, firsts, "conv_id", "pos", how="left").select(
        "conv_id", "pos", F.floor(F.col("pos") / size).alias("piece"), "turn", "initial",
        F.when((F.col("fault") == BLANK) | F.col("new").isNotNull(), F.col("fault")).otherwise(DUPLICATE).alias("fault"))

    tally = "turns long, faults array<long>, illegal long, low long, high long, distinct long, first string, last string"
    cut = (f"conv_id {kind}, piece long, initials array<string>, {tally}, "
           "ends array<struct<start: int, end: int, cost: long, edits: string>>")
    cut_schema = _arrow(rows, cut)

    def search(table: pa.Table) -> pa.Table:
        turns = table.sort_by("pos").to_pylist()
        at = turns[0]["piece"]
        found = _tally((t["turn"], t["initial"], t["fault"]) for t in turns)
        ends = all_ends(((t["initial"], t["fault"]) for t in turns), opening=at == 0)
        return pa.Table.from_pylist([{
            "conv_id": turns[0]["conv_id"], "piece": at, "initials": [t["initial"] for t in turns], **vars(found),
            "ends": [dict(zip(("start", "end", "cost", "edits"), e)) for e in ends]}], cut_schema)

    pieces = judged.groupBy("conv_id", "piece").applyInArrow(search, cut)

    chosen = (f"conv_id {kind}, pos long, place long, role string, edit string, audit string, "
              + ", ".join(f"{c} long" for c in COUNTS))
    joined = materialize(
        pieces.repartition("conv_id").sortWithinPartitions("conv_id", "piece")
        .mapInArrow(_joiner(_arrow(rows, chosen), size), chosen), "chosen-edits")
    edits = joined.filter("edit IS NOT NULL").select("conv_id", "pos", "place", F.col("role").alias("given"), "edit")
    kept = edits.filter("pos IS NOT NULL")
    turns = meet(placed, kept, "conv_id", "pos").select(
        "conv_id", "place", "turn", F.coalesce("given", "role").alias("role"), "text", "edit")
    put_in = edits.filter("pos IS NULL").select(
        "conv_id", "place", F.lit(None).cast("long").alias("turn"), F.col("given").alias("role"),
        F.lit("").alias("text"), "edit")
    return joined.filter("audit IS NOT NULL").select("conv_id", *COUNTS, "audit"), turns.unionByName(put_in)


def _joiner(schema: pa.Schema, size: int):
    """Pieces of sorted conversations become edits by position, and a report at the end."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(schema)
        for conv, run in _runs(batches, "conv_id"):
            whole, audit, place, cost = _Tally(), [], 0, 0
            initials: list[list[str]] = []  # of pieces whose edits are not settled

            def ends() -> Iterator[list[tuple[int, int, int, str]]]:
                for row in run:
                    initials.append(row["initials"])
                    whole.add(_Tally(*(row[f] for f in _Tally.__dataclass_fields__)))
                    yield [(e["start"], e["end"], e["cost"], e["edits"]) for e in row["ends"]]

            for piece in join_pieces(ends()):
                if isinstance(piece, int):
                    cost = piece
                    continue
                state, edits = piece
                for edit, at, role in apply_edits(edits, initials.pop(0), state):
                    yield from out.add(conv_id=conv, pos=None if at is None else len(audit) * size + at,
                                       place=place, role=role, edit=edit)
                    place += 1
                audit.append(edits)
            yield from out.add(conv_id=conv, **whole.report(), cost=cost, audit="".join(audit))
        if out.rows:
            yield out.flush()
    return each


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): SHA-256 of each conversation's ``role:text``, joined by line feeds.

    Turns pass through in order of ``place`` and are never gathered; one digest is
    sequential by its nature, so a conversation's turns go to one task.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, found = [], []
        for conv, run in _runs(batches, "conv_id"):
            digest = hashlib.sha256()
            for i, row in enumerate(run):
                digest.update((("\n" if i else "") + f"{row['role']}:{row['text']}").encode())
            ids.append(conv)
            found.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(found, pa.string())],
                                         names=["conv_id", "repaired_sha256"])

    id_type = _arrow(turns, f"conv_id {kind}").field(0).type
    small_batches(turns.sparkSession)
    return (turns.select("conv_id", "place", "role", "text").repartition("conv_id")
            .sortWithinPartitions("conv_id", "place")
            .mapInArrow(each, f"conv_id {kind}, repaired_sha256 string"))
