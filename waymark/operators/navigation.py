"""Guidance along a planned path, one state for each session: positions alone, and the whole exchange of messages."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Points of a first path and the least of a new one.
STEPS, FEWEST = 40, 20
#: Distances: on the path, new path beyond, arrived, and beyond which the whole path is searched.
ON_PATH, REPLAN, ARRIVED, LOST = 3.0, 5.0, 1.5, 10.0
#: Points of the path looked at around the last one: before it, and from it on.
BEHIND, AHEAD = 5, 10

STATE = "ox double, oy double, oz double, gx double, gy double, gz double, steps int, replanned boolean, at int, done boolean"
ANSWER = "path_index int, n_remaining int, on_path boolean, deviation double, arrival boolean, replan boolean, status string"


@dataclass
class Route:
    """A straight path from an origin to a goal; after a new plan the origin stands twice at its head."""

    origin: np.ndarray
    goal: np.ndarray
    steps: int = STEPS
    replanned: bool = False
    at: int = 0
    done: bool = False

    def path(self) -> np.ndarray:
        share = np.arange(self.steps)[:, None] / (self.steps - 1)
        line = self.origin + (self.goal - self.origin) * share
        return np.vstack([self.origin, line]) if self.replanned else line

    def _away(self, p: np.ndarray, lo: int, hi: int) -> list[float]:
        """How far the path's points lo to hi are from ``p``; one that isn't known is as far as can be.  A look takes a few points,
        for which plain numbers are quicker than arrays."""
        (x, y, z), (ox, oy, oz), (gx, gy, gz), last, own = p.tolist(), self.origin.tolist(), self.goal.tolist(), self.steps - 1, int(self.replanned)
        out = []
        for i in range(lo, hi):
            share = (i - own) / last if i > own else 0.0
            a, b, c = ox + (gx - ox) * share - x, oy + (gy - oy) * share - y, oz + (gz - oz) * share - z
            d = math.sqrt(a * a + b * b + c * c)
            out.append(d if d == d else math.inf)
        return out

    def step(self, p: np.ndarray) -> tuple:
        """The answer to a position; a session that has arrived only says so."""
        if self.done:
            return None, None, None, None, None, None, "completed"
        n = self.steps + self.replanned
        lo = max(0, self.at - BEHIND)
        away = self._away(p, lo, min(n, self.at + AHEAD))
        off = min(away)
        best = lo + away.index(off)
        if off > LOST:
            away = self._away(p, 0, n)
            if (least := min(away)) < off:
                off, best = least, away.index(least)
        self.at = best
        self.done = bool(np.sqrt(((self.goal - p) ** 2).sum()) <= ARRIVED)
        again = off > REPLAN
        if again:
            self.origin, self.steps, self.replanned, self.at = p, max(FEWEST, n - best), True, 0
            n = self.steps + 1
        return self.at, n - self.at - 1, off <= ON_PATH, off, self.done, again, "completed" if self.done else "running"

    def packed(self) -> tuple:
        return (*map(float, self.origin), *map(float, self.goal), self.steps, self.replanned, self.at, self.done)

    @classmethod
    def unpacked(cls, s: tuple) -> Route:
        return cls(np.array(s[:3], dtype=float), np.array(s[3:6], dtype=float), *s[6:])


def _fold(frame: pd.DataFrame, session: str, order: str, route: Route | None) -> tuple[pd.DataFrame, Route]:
    frame = frame.sort_values(order, kind="stable")
    if route is None:
        first = frame.iloc[0]
        route = Route(first[["sx", "sy", "sz"]].to_numpy(dtype=float), first[["gx", "gy", "gz"]].to_numpy(dtype=float))
    answers = [route.step(p) for p in frame[["x", "y", "z"]].to_numpy(dtype=float)]
    names = [c.split()[0] for c in ANSWER.split(", ")]
    out = pd.DataFrame(answers, columns=names).astype({"path_index": "Int32", "n_remaining": "Int32", "on_path": "boolean", "deviation": "float64", "arrival": "boolean", "replan": "boolean"})
    out.insert(0, session, frame[session].to_numpy())
    out.insert(1, order, frame[order].to_numpy())
    return out, route


def _schema(frames: DataFrame, session: str, order: str) -> str:
    return f"`{session}` {frames.schema[session].dataType.simpleString()}, `{order}` {frames.schema[order].dataType.simpleString()}, {ANSWER}"


def _wanted(frames: DataFrame, session: str, order: str) -> DataFrame:
    places = ["x", "y", "z", "sx", "sy", "sz", "gx", "gy", "gz"]
    return frames.select(session, order, *[F.col(c).cast("double").alias(c) for c in places]).dropna(subset=places)


def navigate(frames: DataFrame, session: str, order: str) -> DataFrame:
    """An answer for each position of each session, in ``order``.

    ``frames`` has the position x, y, z and the session's start sx, sy, sz and goal gx, gy, gz (those of its first
    frame count).  Rows with a null place are no frames.  Sessions are sorted on the JVM and folded batch by batch; a task holds
    one route, so a session of any length fits.
    """
    names = [session, order, *(c.split()[0] for c in ANSWER.split(", "))]
    kinds = [pa.int32(), pa.int32(), pa.bool_(), pa.float64(), pa.bool_(), pa.bool_(), pa.string()]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, route = None, None
        for batch in batches:
            out, places = [], np.stack([batch.column(i).to_numpy() for i in range(2, 11)], axis=1)
            for key, p in zip(batch.column(0).to_pylist(), places):
                if route is None or key != at:
                    at, route = key, Route(p[3:6].copy(), p[6:9].copy())
                out.append(route.step(p[:3]))
            columns = zip(*out) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    rows = _wanted(frames, session, order).repartition(session).sortWithinPartitions(session, F.col(order).asc_nulls_last())
    return rows.mapInArrow(fold, _schema(frames, session, order))


def navigate_stream(frames: DataFrame, session: str, order: str, quiet_ms: int = 3_600_000) -> DataFrame:
    """The same over a stream: a session's route is its state, dropped after ``quiet_ms`` without a frame."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        # the rows of a trigger may come in several frames: all are needed before sorting
        out, route = _fold(pd.concat(list(batches)), session, order, Route.unpacked(state.get) if state.exists else None)
        state.update(route.packed())
        state.setTimeoutDuration(quiet_ms)
        yield out

    return _wanted(frames, session, order).groupBy(session).applyInPandasWithState(run, _schema(frames, session, order), STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


# ---------------------------------------------------------------- messages

#: What a session may send, and the fields that a start must have, in the order in which a missing one is told.
EVENTS = "session_id string, seq long, type string, user_id string, map_id string, start array<double>, goal array<double>, position array<double>"
REQUIRED = ("user_id", "map_id", "start", "goal")
#: What it is answered: a place among the answers to one message, and the fields of a position's answer.
REPLY = f"session_id string, seq long, nth int, type string, message string, {ANSWER}"
NAMES = [c.split()[0] for c in REPLY.split(", ")]


def replies(route: Route | None, event: dict) -> tuple[list[dict], Route | None]:
    """The answers to one message, and the session's route after it.

    A start with all fields begins a route (again); a position gives an update, and a replan and a completion beside it; an
    end forgets the route.  Whatever can't be done is answered by an error, and changes nothing.
    """
    kind, told = event["type"], lambda kind, message=None, **x: {"type": kind, "message": message, **x}
    if kind == "session_start":
        missing = next((k for k in REQUIRED if event[k] is None), None)
        if missing:
            return [told("error", f"Missing field {missing}")], route
        if any(len(event[k]) != 3 or any(x is None for x in event[k]) for k in ("start", "goal")):
            return [told("error", "start and goal must be three numbers")], route
        return [told("session_started", status="running", n_remaining=STEPS - 1)], Route(np.array(event["start"], dtype=float), np.array(event["goal"], dtype=float))
    if kind == "position_frame":
        p = event["position"]
        if not event["session_id"] or p is None or len(p) != 3 or any(x is None for x in p):
            return [told("error", "session_id and position required")], route
        if route is None:
            return [told("error", f"Session {event['session_id']} not found")], route
        answer = dict(zip((c.split()[0] for c in ANSWER.split(", ")), route.step(np.array(p, dtype=float))))
        out = [told("position_update", **answer)]
        if answer["replan"]:
            out.append(told("replan", "deviation", n_remaining=answer["n_remaining"]))
        if answer["arrival"]:
            out.append(told("session_completed", status="completed"))
        return out, route
    if kind == "session_end":
        if not event["session_id"]:
            return [told("error", "session_id required")], route
        return [told("session_ended")], None
    return [told("error", f"Unknown message type: {kind}")], route


def _answered(route: Route | None, events: list[dict]) -> tuple[list[dict], Route | None]:
    out = []
    for e in events:
        got, route = replies(route, e)
        out += [{"session_id": e["session_id"], "seq": e["seq"], "nth": k, **g} for k, g in enumerate(got)]
    return out, route


def _columns(rows: list[dict]) -> dict[str, list]:
    return {c: [r.get(c) for r in rows] for c in NAMES}


def exchange(events: DataFrame) -> DataFrame:
    """The answers (``REPLY``) to messages (``EVENTS``) of sessions, each session's in order of seq.

    Messages without a session are answered one by one, by errors mostly.  Sessions are sorted on the JVM and folded batch by
    batch; a task holds one route.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(REPLY))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, route = None, None
        for batch in batches:
            out: list[dict] = []
            for e in batch.to_pylist():
                if e["session_id"] is None or e["session_id"] != at:
                    at, route = e["session_id"], None
                got, route = _answered(route, [e])
                out += got
            yield pa.RecordBatch.from_pydict(_columns(out), schema=target)

    rows = events.select(*(c.split()[0] for c in EVENTS.split(", ")))
    return rows.repartition("session_id").sortWithinPartitions("session_id", "seq").mapInArrow(fold, REPLY)


class Exchange(StatefulProcessor):
    """The same over a stream: a session's state is its route and how many messages it has sent; a timer ends a session that
    falls quiet, and an end clears all of it."""

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.route = handle.getValueState("route", STATE)
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        # the rows of a trigger may come in several frames: all are needed before sorting
        frame = pd.concat(list(rows)).sort_values("seq", kind="stable")
        lists = ("start", "goal", "position")
        clean = lambda c, v: (None if v is None else list(v)) if c in lists else None if pd.isna(v) else v
        events = [{c: clean(c, v) for c, v in r.items()} for r in frame.to_dict("records")]
        route = Route.unpacked(self.route.get()) if self.route.exists() else None
        if key[0] is None:  # no session: nothing is kept from one message to the next
            out = [x for e in events for x in _answered(None, [e])[0]]
        else:
            out, route = _answered(route, events)
            self._keep(route, len(events), timers)
        yield self._frame(out)

    def _keep(self, route: Route | None, n: int, timers) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if route is None:
            self.route.clear()
            self.count.clear()
            return
        self.route.update(route.packed())
        self.count.update(((self.count.get()[0] if self.count.exists() else 0) + n,))
        self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.quiet_ms)

    def handleExpiredTimer(self, key, timers, expired) -> Iterator[pd.DataFrame]:
        n = self.count.get()[0] if self.count.exists() else 0
        self.route.clear()
        self.count.clear()
        yield self._frame([{"session_id": key[0], "seq": None, "nth": 0, "type": "session_expired", "message": f"quiet after {n} messages"}])

    def _frame(self, rows: list[dict]) -> pd.DataFrame:
        kinds = {"seq": "Int64", "nth": "Int32", "path_index": "Int32", "n_remaining": "Int32", "on_path": "boolean", "deviation": "float64", "arrival": "boolean", "replan": "boolean"}
        return pd.DataFrame(_columns(rows), columns=NAMES).astype(kinds)

    def close(self) -> None:
        pass


def exchange_stream(events: DataFrame, quiet_ms: int = 3_600_000) -> DataFrame:
    """``exchange`` over a stream, one answer row after the other; needs the RocksDB state store."""
    rows = events.select(*(c.split()[0] for c in EVENTS.split(", ")))
    return rows.groupBy("session_id").transformWithStateInPandas(Exchange(quiet_ms), REPLY, "Append", "ProcessingTime")
