"""Repair of conversation structure: the cheapest edits that make a conversation follow the turn grammar.

A conversation is well formed when it is empty or its role initials are an optional s and then ua, once or more. Rows are kept, given
another role or deleted, and empty rows may be inserted. Spark deals conversations to tasks by hash and sorts each task's rows; a task
takes them in batches, and in each batch one recursive DuckDB query advances all conversations by one row a step, keeping for every
grammar state the cheapest cost and, among equal costs, the least string of edit initials. Of two such strings of one cost, over the
same rows, neither is a prefix of the other, so the lesser stays the lesser whatever follows and a state needs only its best.

Memory is bounded by a batch: a conversation that does not end in it is walked from every state and goes on in the next one with, for
each state, its cost, audit and the running digest of what it has repaired so far. Only the audit itself, which is a result column,
grows with a conversation. A conversation is a sequence and its digest has to be taken in order, so one conversation is one task's work.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._runtime import ship_package

#: Rows of a batch, and characters of their texts, at which the recursion runs.
ROWS, CHARS = 8192, 16_000_000
#: Rows of one conversation that a recursion walks; longer ones go on behind.
PIECE = 256
WHITE = " \t\n\x0b\x0c\r"
STATES = "0sua"  # nothing yet, behind a system, user or assistant row
RESULT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"

#: The edits of one row, with what may be inserted in front of it: from state, to state, initials, role initial asked for, cost.
STEPS = """
with gap(src, mid, ins, cost) as (values ('0','0','',0), ('s','s','',0), ('u','u','',0), ('a','a','',0), ('0','u','I',2), ('0','a','II',4),
    ('s','u','I',2), ('s','a','II',4), ('u','a','I',2), ('a','u','I',2)),
  edit(mid, dst, letter, need, cost) as (values ('0','0','D',null,3), ('s','s','D',null,3), ('u','u','D',null,3), ('a','a','D',null,3),
    ('0','s','K','s',0), ('0','u','K','u',0), ('s','u','K','u',0), ('a','u','K','u',0), ('u','a','K','a',0),
    ('0','u','R',null,2), ('s','u','R',null,2), ('a','u','R',null,2), ('u','a','R',null,2))
select src, dst, ins || letter as edits, need, gap.cost + edit.cost as cost, letter = 'D' as gone from gap join edit using (mid)
"""
WALK = """
with recursive walk as (
  select seg, 0 as n, entry, entry as state, {'cost': 0, 'audit': ''} as best from entries
  union all
  select w.seg, w.n + 1, w.entry, t.dst, min({'cost': w.best.cost + t.cost + case when r.cut and not t.gone then 1 else 0 end, 'audit': w.best.audit || t.edits})
  from walk w join turns r on r.seg = w.seg and r.n = w.n join steps t on t.src = w.state and (t.need is null or t.need = r.initial) and (t.gone or not r.must)
  group by w.seg, w.n + 1, w.entry, t.dst)
select w.seg, entry, state, best.cost, best.audit from walk w join (select seg, count(*) as n from turns group by seg) using (seg, n)
"""
#: What has to follow a state at the end.
ENDING = {"0": (0, ""), "a": (0, ""), "u": (2, "I"), "s": (4, "II")}


def damage(rows: DataFrame) -> DataFrame:
    """The damage that the repair is tested on, of (conv_id, turn, role, text), nulls of role, text and in the key being one space: by crc32 of
    `conv_id:turn` modulo 20 a row is dropped (0), emptied (1), stripped of .!? (2), repeated (3) or given the role user (4).
    Dropped rows stay, with `gone`, so that their conversation is still known."""
    def name(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(name("text"), "[.!?]", "")).otherwise(name("text"))
    out = rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.when(kind == 4, "user").otherwise(name("role")).alias("role"),
        F.when(kind == 0, "").otherwise(text).alias("text"), (kind == 0).alias("gone"), F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return out.drop("copy")


class _Piece:
    """Rows of one conversation, in order, as many as one recursion walks; whether it goes on from rows walked before, and ends here."""

    def __init__(self, conv, goes_on: bool) -> None:
        self.conv, self.goes_on, self.rows, self.last = conv, goes_on, [], False


class _Paths:
    """The best path into every state of a conversation that is under way: cost, audit, digest of and number of repaired rows."""

    def __init__(self) -> None:
        self.at = {STATES[0]: (0, "", hashlib.sha256(), 0)}
        self.low, self.high, self.turns = None, None, 0
        self.counts, self.initial = [0, 0, 0, 0], None

    def count(self, rows: list[tuple]) -> None:
        for turn, initial, _, _, fault in rows:
            if turn is not None:
                self.low = turn if self.low is None else self.low
                self.turns += self.high != turn
                self.high = turn
            if fault:
                self.counts[fault - 1] += 1
            if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
                self.counts[3] += 1
            self.initial = initial

    def step(self, walked: list[tuple], rows: list[tuple]) -> None:
        """The best path into every state behind a piece, from the walks (entry, state, cost, audit) over it."""
        best = {}
        for entry, state, cost, audit in walked:
            if entry in self.at:
                before = self.at[entry]
                here = (before[0] + cost, before[1] + audit, entry, audit)
                best[state] = min(best.get(state, here), here)
        self.at = {s: (cost, whole, *_repaired(*self.at[entry][2:], audit, rows)) for s, (cost, whole, entry, audit) in best.items()}

    def result(self, conv) -> tuple:
        ends = [(cost + ENDING[s][0], audit + ENDING[s][1], s) for s, (cost, audit, _, _) in self.at.items()]
        cost, audit, s = min(ends)
        digest, _ = _repaired(*self.at[s][2:], ENDING[s][1], [])
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (conv, gaps, *self.counts, cost, audit, digest.hexdigest())


def _repaired(digest, n: int, audit: str, rows: list[tuple]):
    """The digest and the number of repaired rows behind more edits. A role that an edit sets is the one that the grammar asks for
    next; n is negative, less one, while a system row leads."""
    digest, turns = digest.copy(), iter(rows)
    for letter in audit:
        row = next(turns) if letter != "I" else None
        if letter == "D":
            continue
        system = letter == "K" and row[1] == "s"
        role = row[2] if letter == "K" else ("user", "assistant")[(n if n >= 0 else -n - 1) % 2]
        digest.update(f"{chr(10) if n else ''}{role}:{row[3] if row else ''}".encode())
        n = -1 if system else n + 1 if n >= 0 else n - 1
    return digest, n


class Repairer:
    """Takes rows (conv_id, turn, role, text, gone, fault) in order of conversation and place; gives result rows."""

    def __init__(self, piece: int = PIECE, limit: int = ROWS, chars: int = CHARS) -> None:
        self.con = duckdb.connect(config={"threads": 1})
        self.con.execute(f"create table steps as {STEPS}")
        self.piece, self.limit, self.chars = piece, limit, chars
        self.pieces: list[_Piece] = []
        self.under_way, self.held, self.size = None, 0, 0

    def add(self, conv, turn, role, text, gone, fault) -> Iterator[tuple]:
        last = self.pieces[-1] if self.pieces else None
        full = self.held >= self.limit or self.size >= self.chars
        if last is None or last.conv != conv or len(last.rows) >= self.piece or full:
            if last is not None:
                last.last = last.conv != conv
            if full:
                yield from self.flush()
            self.pieces.append(_Piece(conv, last is not None and last.conv == conv))
        if not gone:
            self.pieces[-1].rows.append((turn, role[:1], role, text, fault))
            self.held += 1
            self.size += len(text)

    def walked(self) -> dict[int, list[tuple]]:
        """For every piece held: (entry, state, cost, audit), from each state it may be entered in."""
        entries = [(k, s) for k, p in enumerate(self.pieces) if p.rows for s in (STATES if p.goes_on else STATES[:1])]
        turns = [(k, i, r[1], r[4] in (1, 2), r[4] == 3) for k, p in enumerate(self.pieces) for i, r in enumerate(p.rows)]
        found: dict[int, list[tuple]] = {}
        if not turns:
            return found
        for name, fields, rows in (("entries", ("seg", "entry"), entries), ("turns", ("seg", "n", "initial", "must", "cut"), turns)):
            self.con.register("given", pa.table(dict(zip(fields, map(list, zip(*rows, strict=True)), strict=True))))
            self.con.execute(f"create or replace temp table {name} as select * from given")
        for seg, *walk in self.con.execute(WALK).fetchall():
            found.setdefault(seg, []).append(walk)
        return found

    def flush(self) -> Iterator[tuple]:
        """Results of the conversations that end among the pieces held; one that does not stays under way."""
        walked = self.walked()
        for k, p in enumerate(self.pieces):
            paths = self.under_way if p.goes_on else _Paths()
            if p.rows:
                paths.count(p.rows)
                paths.step(walked[k], p.rows)
            if p.last:
                yield paths.result(p.conv)
            self.under_way = paths
        self.pieces, self.held, self.size = [], 0, 0

    def finish(self) -> Iterator[tuple]:
        if self.pieces:
            self.pieces[-1].last = True
            yield from self.flush()


def repair_conversations(rows: DataFrame, piece: int = PIECE, limit: int = ROWS) -> DataFrame:
    """One row per conv_id of rows (conv_id, turn, role, text and, if there, `gone` for rows that only name their conversation):
    faults, the cheapest repair's cost and audit, and the SHA-256 of the repaired `role:text` lines.

    Null role and text are one space; rows go by turn, nulls first, then role and text; a null conv_id is a conversation of its own;
    repeated rows are duplicates of the first; roles that begin with none of s, u, a can only be given another role or deleted; a
    conversation without rows has zeros, an empty audit and the digest of nothing; an empty table gives an empty one; other columns
    are not read.
    """
    ship_package(rows.sparkSession)
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in rows.columns else F.lit(False)
    given = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), gone.alias("gone"))
    # one shuffle by conversation serves the window as well; a row is a duplicate if an equal one comes before it
    dealt = given.repartition("conv_id")
    before = F.row_number().over(Window.partitionBy("conv_id", "role", "text", "gone").orderBy(F.asc_nulls_first("turn"))) - 1
    seen = F.rtrim("text", F.lit(WHITE))
    fault = F.when(seen == "", 1).when(before > 0, 2).when(~F.substring(seen, -1, 1).isin(".", "!", "?"), 3).otherwise(0)
    placed = dealt.withColumn("before", before).withColumn("fault", fault.cast("int")).sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text", "before").drop("before")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RESULT.split(", ")]

        def out(found: list[tuple]) -> pa.RecordBatch:
            types = [pa.int64()] * 7 + [pa.string()] * 2
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names)

        work = Repairer(piece, limit)
        for batch in batches:
            found = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone", "fault")), strict=True):
                found += work.add(*row)
            if found:
                yield out(found)
        if found := list(work.finish()):
            yield out(found)

    return placed.mapInArrow(run, RESULT)
