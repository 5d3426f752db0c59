"""Streams with state of their own: tasks with timers, and messages put together as their pieces come.

Both go by event time. The rows of a key are taken in time order, and every timer
that is due before a row goes off before it, so results don't depend on how rows
fall into batches, as long as none comes later than the watermark allows. State
is dropped when a key has ended, so it grows with what is open, not with what
has been. Sinks are keyed by epoch: a batch
that is retried overwrites itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siltstone.streaming.jobs import BACKOFF_SECONDS, LATE, TASK_RETRIES, TASK_SECONDS, TERMINAL_EVENTS

#: Rows that the state of open tasks, and of open turns, is dealt to.
TASK_GROUPS = TURN_GROUPS = 1024
#: Seconds after its last piece at which an unfinished message is let go.
OPEN_SECONDS = 3600
_SECOND = 1_000_000

_MOVES = "id long, status string, tries int, micros long"
_TASK = "ids array<long>, due array<long>, running array<boolean>, tries array<int>, max_retry array<int>, timeout array<long>"
_MESSAGES = "turn_id string, content string, outcome string"
_TURNS = "ids array<string>, seqs array<array<long>>, pieces array<array<string>>, last array<long>, end_seq array<long>, end_at array<long>, outcome array<string>"


@dataclass
class _Task:
    due: int  # when it starts, or, running, when its time is up
    running: bool
    tries: int
    max_retry: int
    timeout: int

    def failed(self, at: int) -> str:
        self.running, self.due = False, at + BACKOFF_SECONDS * self.tries**2 * _SECOND
        return "archived" if self.tries > self.max_retry else "retry"


def _wind(task: _Task | None, until: int, moves: list, late: bool) -> _Task | None:
    """The task after all its timers up to `until`; a run that ends just then is in time unless it would be late."""
    while task and (task.due < until or task.due == until and (late or not task.running)):
        at = task.due
        if not task.running:
            task.running, task.tries, task.due = True, task.tries + 1, at + task.timeout
            moves.append(("active", task.tries, at))
            continue
        status = task.failed(at)
        moves.append((status, task.tries, at))
        task = None if status == "archived" else task
    return task


def _rows(frames: Iterator[pd.DataFrame], *columns: str) -> list[tuple]:
    """These columns of all rows, sorted by the first three. Lists, as most keys have few rows, for which frames are slow."""
    return sorted((row for f in frames for row in zip(*(f[c].tolist() for c in columns), strict=True)), key=itemgetter(0, 1, 2))


def _keep(state: GroupState, value: tuple, due: int, mark: int) -> None:
    state.update(value)
    state.setTimeoutTimestamp(max(-(-due // 1000), mark // 1000 + 1))


def _task_step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    moves: list[tuple] = []
    tasks = {id_: _Task(*rest) for id_, *rest in zip(*state.get, strict=True)} if state.exists else {}
    mark = state.getCurrentWatermarkMs() * 1000
    for at, _, attempt, id_, kind, due, max_retry, timeout, ok in _rows(frames, "at", "rank", "attempt", "id", "kind", "due", "max_retry", "timeout", "ok"):
        mine: list[tuple] = []
        task = _wind(tasks.get(id_), at, mine, False)
        if kind == "task" and task is None:
            task = _wind(_Task(due, False, 0, max_retry, timeout * _SECOND), at, mine, False)
        elif kind == "result" and task and task.running and task.tries == attempt:
            status = "completed" if ok else task.failed(at)
            mine.append((status, task.tries, at))
            task = task if status == "retry" else None
        tasks[id_] = task
        moves += [(id_, *move) for move in mine]
    for id_, task in tasks.items():
        mine = []
        tasks[id_] = _wind(task, mark, mine, True)
        moves += [(id_, *move) for move in mine]
    left = [(id_, *astuple(task)) for id_, task in tasks.items() if task]
    if left:
        _keep(state, tuple(map(list, zip(*left, strict=True))), min(row[1] for row in left), mark)
    elif state.exists:
        state.remove()
    if moves:
        yield pd.DataFrame(moves, columns=["id", "status", "tries", "micros"])


def task_moves(rows: DataFrame, late: str = LATE, groups: int = TASK_GROUPS) -> DataFrame:
    """(id, status, tries, at) for each change of a task, from a stream of rows

    (id, kind, at, process_at, max_retry, timeout, attempt, ok): a `task` is put in at `at` to start at
    process_at (or at once), a `result` says at `at` how its try number `attempt` ended; other kinds only move the clock.
    A try starts as `active`. It is `completed` by a good result within timeout seconds; a bad one, or none in
    time, makes it `retry` after BACKOFF_SECONDS times the square of its tries, or `archived` - the dead letters -
    once it has been retried max_retry times. Results of other tries, and tasks of an id that is open, change nothing.
    Rows without id or time are left out. Every task has its own timer; the state of open tasks is kept in `groups` rows
    by a hash of the id, with the earliest timer as the row's, since a call of Python a task costs
    far more than the task: choose groups for some thousands of open tasks a row. `groups` belongs to the checkpoint and can't change over its life.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    known = rows.where(F.col("id").isNotNull() & F.col("at").isNotNull())
    marked = known.withColumn("_at", F.col("at").cast("timestamp")).withWatermark("_at", late)
    narrow = marked.select(
        F.pmod(F.xxhash64(F.col("id").cast("long")), F.lit(groups)).alias("slot"), F.col("id").cast("long").alias("id"), "_at", F.coalesce("kind", F.lit("")).alias("kind"), micros("at").alias("at"),
        F.coalesce(micros("process_at"), micros("at")).alias("due"),
        F.coalesce(F.col("max_retry"), F.lit(TASK_RETRIES)).cast("int").alias("max_retry"), F.coalesce(F.col("timeout"), F.lit(TASK_SECONDS)).cast("long").alias("timeout"),
        F.coalesce(F.col("attempt"), F.lit(0)).cast("int").alias("attempt"), F.coalesce(F.col("ok"), F.lit(False)).alias("ok"), F.when(F.col("kind") == "task", 0).otherwise(1).alias("rank"),
    )
    moves = narrow.groupBy("slot").applyInPandasWithState(_task_step, _MOVES, _TASK, "append", GroupStateTimeout.EventTimeTimeout)
    return moves.select("id", "status", "tries", F.timestamp_micros("micros").alias("at"))


@dataclass
class _Turn:
    seqs: list
    pieces: list
    last: int
    end_seq: int | None
    end_at: int | None
    outcome: str

    def due(self, limit: int) -> int:
        return self.last + limit if self.end_at is None else self.end_at


def _restored(state: tuple) -> dict[str | None, _Turn]:
    return {id_: _Turn(list(seqs), list(pieces), *rest) for id_, seqs, pieces, *rest in zip(*state, strict=True)}


def _message_step(limit: int):
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        turns = _restored(state.get) if state.exists else {}
        mark = state.getCurrentWatermarkMs() * 1000
        for frame in frames:
            for at, seq, kind, id_, content in zip(*(frame[c].tolist() for c in ("at", "seq", "type", "turn_id", "content")), strict=True):
                ends = kind in TERMINAL_EVENTS
                if not ends and kind != "message":
                    continue
                turn = turns.get(id_)
                if turn is None:
                    turn = turns[id_] = _Turn([], [], at, None, None, "open")
                elif at > turn.last:
                    turn.last = at
                if not ends:
                    turn.seqs.append(seq)
                    turn.pieces.append(content or "")
                elif turn.end_seq is None or seq >= turn.end_seq:
                    turn.end_seq, turn.end_at, turn.outcome = seq, at, kind
        over = [id_ for id_, turn in turns.items() if turn.due(limit) <= mark]
        out = []
        for id_ in over:
            turn = turns.pop(id_)
            out.append((id_, "".join(piece for _, piece in sorted(zip(turn.seqs, turn.pieces, strict=True))), turn.outcome))
        if turns:
            left = [(id_, t.seqs, t.pieces, t.last, t.end_seq, t.end_at, t.outcome) for id_, t in turns.items()]
            _keep(state, tuple(map(list, zip(*left, strict=True))), min(t.due(limit) for t in turns.values()), mark)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["turn_id", "content", "outcome"])

    return step


def assembled(deltas: DataFrame, late: str = LATE, open_seconds: int = OPEN_SECONDS, groups: int = TURN_GROUPS) -> DataFrame:
    """What `jobs.messages` gives, from a stream of deltas (turn_id, seq, type, content, at).

    A turn comes out, and its state goes, when it has ended and the watermark is past its end, so that no
    earlier piece can follow; or, `open`, when open_seconds have gone by since its last piece. Other types only move the clock;
    rows without a time are left out, and pieces without a number come first. Open turns are kept in `groups` rows of
    state by a hash of the turn, as tasks are in `task_moves`; a row should hold some hundred open turns.
    """
    marked = deltas.where(F.col("at").isNotNull()).withColumn("_at", F.col("at").cast("timestamp")).withWatermark("_at", late)
    narrow = marked.select(
        F.pmod(F.xxhash64("turn_id"), F.lit(groups)).alias("slot"), "turn_id", "_at", F.coalesce(F.col("seq").cast("long"), F.lit(-1)).alias("seq"),
        F.coalesce("type", F.lit("")).alias("type"), "content", F.unix_micros("_at").alias("at"),
    )
    return narrow.groupBy("slot").applyInPandasWithState(_message_step(open_seconds * _SECOND), _MESSAGES, _TURNS, "append", GroupStateTimeout.EventTimeTimeout)


def run_into(out: DataFrame, target: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append a stream's rows to a folder for each epoch; a retried epoch overwrites its own."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    return out.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
