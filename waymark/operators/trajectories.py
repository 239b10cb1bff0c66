"""Operators on ordered samples of sessions: lengths, nearest-in-time joins, strides, gates, folds."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import distance


def path_length(poses: DataFrame, session: str, order: str, x: str, y: str, z: str) -> DataFrame:
    """session, n_poses, length: summed distances between neighbours in ``order``."""
    w = Window.partitionBy(session).orderBy(order)
    step = distance(*[F.col(c) - F.lag(c).over(w) for c in (x, y, z)])
    return poses.withColumn("_step", step).groupBy(session).agg(F.count(F.lit(1)).alias("n_poses"), F.coalesce(F.sum("_step"), F.lit(0.0)).alias("length"))


def nearest_in_time(frames: DataFrame, samples: DataFrame, key: list[str], frame_id: str, time: str, sample_id: str, tolerance: int) -> DataFrame:
    """Each frame with its nearest sample of the same key within ``tolerance`` (same unit as the integer time).

    One sort of frames and samples together per key; of two equally near samples the earlier wins, of several
    at one time the least id.  Frames without a sample have nulls.
    """
    s = samples.groupBy(*key, time).agg(F.min(sample_id).alias("_sid"))
    both = frames.select(*key, time, F.col(frame_id).alias("_fid"), F.lit(None).cast("long").alias("_sid")).unionByName(s.select(*key, time, F.lit(None).cast("long").alias("_fid"), "_sid"))
    sample = F.when(F.col("_sid").isNotNull(), F.struct(F.col(time).alias("t"), F.col("_sid").alias("id")))
    # running frames from both ends: each row is added once.  A sample comes before the frames of its time either way.
    running = (Window.unboundedPreceding, Window.currentRow)
    samples_first = F.col("_sid").isNull()
    before = F.last(sample, ignorenulls=True).over(Window.partitionBy(*key).orderBy(time, samples_first).rowsBetween(*running))
    after = F.last(sample, ignorenulls=True).over(Window.partitionBy(*key).orderBy(F.desc(time), samples_first).rowsBetween(*running))
    rows = both.withColumn("_b", before).withColumn("_a", after).where("_fid is not null")
    db, da = F.col(time) - F.col("_b.t"), F.col("_a.t") - F.col(time)
    near = F.when(da.isNull() | (db <= da), F.col("_b")).otherwise(F.col("_a"))
    rows = rows.withColumn("_n", near).withColumn("_d", F.abs(F.col(time) - F.col("_n.t")))
    ok = F.col("_d") <= tolerance
    return rows.select(*key, F.col("_fid").alias(frame_id), F.when(ok, F.col("_n.id")).alias(sample_id), F.when(ok, F.col("_d")).alias("delta"))


def stride_sample(rows: DataFrame, group: str, order: list[str], most: int) -> DataFrame:
    """At most ``most`` rows of each group, evenly spread in ``order``: row int(k * (n / most)) for each k.

    Whether row i is picked is told by arithmetic: k is about i over the step, and it or a neighbour must come out at i.
    """
    n, i = F.col("_n"), F.col("_i")
    at = F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long") - 1
    sizes = rows.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
    numbered = rows.withColumn("_i", at).join(sizes, F.col(group).eqNullSafe(F.col("_g")))
    step = n / F.lit(float(most))
    k = F.floor(i / step)
    hit = lambda x: (x >= 0) & (x < most) & ((x * step).cast("long") == i)
    picked = hit(k - 1) | hit(k) | hit(k + 1)
    return numbered.where((n <= most) | picked).drop("_i", "_g", "_n")


def bounding_box(points: DataFrame, group: str, x: str, y: str, z: str) -> DataFrame:
    """Centre, height range and span of each group's points; the span is at least 2."""
    p = points.groupBy(group).agg(*[f(c).alias(f"{n}_{k}") for k, c in zip("xyz", (x, y, z)) for n, f in (("min", F.min), ("max", F.max))])
    mid = lambda k: ((F.col(f"min_{k}") + F.col(f"max_{k}")) / 2).alias(f"centre_{k}")
    return p.select(group, mid("x"), mid("y"), mid("z"), "min_y", "max_y", F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_z") - F.col("min_z"), F.lit(2.0)).alias("span"))


def bounding_box_of_all(points: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """The same over all points in one row; without a point centre and heights are 0 and the span 5."""
    one = bounding_box(points.withColumn("_one", F.lit(1)), "_one", x, y, z).drop("_one")
    counted = points.agg(F.count(F.lit(1)).alias("n_points"))
    return counted.join(one, F.lit(True), "left").select("n_points", *[F.coalesce(c, F.lit(5.0 if c == "span" else 0.0)).alias(c) for c in one.columns])


def status_fold(sessions: DataFrame, building: str, status: str) -> DataFrame:
    """One status for each building: all completed, any failed, any processing, else uploaded; null is none of them."""
    s = F.coalesce(F.col(status), F.lit(""))
    return sessions.groupBy(building).agg(
        F.when(F.bool_and(s == "COMPLETED"), "COMPLETED").when(F.bool_or(s == "FAILED"), "FAILED").when(F.bool_or(s == "PROCESSING"), "PROCESSING").otherwise("UPLOADED").alias("building_status"),
        F.count(F.lit(1)).alias("n_sessions"),
    )


def first_created(sessions: DataFrame, building: str, created: str) -> DataFrame:
    """building, created_at: the earliest time as text, empty where none is known."""
    return sessions.groupBy(building).agg(F.coalesce(F.date_format(F.min(created), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("")).alias("created_at"))


def latest(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """key, value: the last value in ``order`` that isn't null; null where there is none."""
    return rows.groupBy(key).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias(value))


def rates(samples: DataFrame, session: str, order: list[str], us: str) -> DataFrame:
    """``samples`` with rate, one over the seconds since the sample before; null for the first and without time between."""
    gap = F.col(us) - F.lag(us).over(Window.partitionBy(session).orderBy(*order))
    return samples.withColumn("rate", 1000000.0 / F.nullif(gap, F.lit(0)))


def renumbered(rows: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """Rows numbered from 1 within each group, in ``order``."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(order)))


def hues(points: DataFrame, group: str, height: str) -> DataFrame:
    """``points`` with hue, 0.66 for the lowest of a group to 0 for the highest.  Two numbers of each group are joined back, so a
    group is never gathered."""
    low, high = F.min(height).alias("_lo"), F.max(height).alias("_hi")
    ends = points.groupBy(F.col(group).alias("_g")).agg(low, high)
    span = F.coalesce(F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)), F.lit(1.0))
    out = points.join(ends, F.col(group).eqNullSafe(F.col("_g")))
    return out.withColumn("hue", 0.66 - 0.66 * (F.col(height) - F.col("_lo")) / span).drop("_g", "_lo", "_hi")


def confidence_band(percent: Column) -> Column:
    return F.when(percent >= 80, "high").when(percent >= 60, "medium").otherwise("low")


def quiet_sessions(frames: DataFrame, key: str, time: str, gap: str) -> DataFrame:
    """key, opened, n_frames of runs of frames with less than ``gap`` between neighbours."""
    return frames.groupBy(key, F.session_window(time, gap)).agg(F.min(time).alias("opened"), F.count(F.lit(1)).alias("n_frames")).drop("session_window")


def line(n: Column, start: list[Column], end: list[Column]) -> Column:
    """Array of n points from start to end, both exact; fewer than 2 give the two ends."""
    last = F.greatest(n, F.lit(2)) - 1
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.array(*[F.when(i == last, e).otherwise(s + (e - s) * i / last) for s, e in zip(start, end)]))


class Gate:
    """Keeps a sample that is ``least`` away from the last kept one, or turned by ``turn`` degrees, no faster than ``speed`` and
    no sooner than ``frames`` samples after it.  With rotations a sample is refused as near only if it is hardly turned too."""

    def __init__(self, least: float, speed: float = float("inf"), turn: float | None = None, frames: int = 0):
        self.least, self.speed, self.turn, self.frames = least, speed, turn, frames

    def reason(self, last: tuple | None, t: float, p: tuple) -> str | None:
        """Why a sample is refused, None if it is kept: "near" before "fast" before "soon".  ``last`` is the time and place of the
        last kept sample and how many came since; with ``turn``, places end in a unit quaternion."""
        if last is None:
            return None
        n = len(p) - 4 if self.turn is not None else len(p)
        d = sum((a - b) ** 2 for a, b in zip(p[:n], last[1][:n])) ** 0.5
        turned = self.turn is not None and degrees_between(p[n:], last[1][n:]) >= self.turn
        dt = t - last[0]
        if d < self.least and not turned:
            return "near"
        if dt > 0 and d / dt > self.speed:
            return "fast"
        return "soon" if len(last) > 2 and last[2] + 1 < self.frames else None

    def step(self, last: tuple | None, t: float, p: tuple) -> bool:
        return self.reason(last, t, p) is None

    def fold(self, last: tuple | None, samples: list[tuple]) -> tuple[list[str | None], tuple | None]:
        """The reasons for samples (t, place) in order, and the state after them."""
        out = []
        for t, *p in samples:
            why = self.reason(last, t, tuple(p))
            last = (t, tuple(p), 0) if why is None else (last[0], last[1], last[2] + 1)
            out.append(why)
        return out, last


def degrees_between(a: tuple, b: tuple) -> float:
    return math.degrees(2 * math.acos(min(1.0, abs(sum(x * y for x, y in zip(a, b))))))


def movement_status(blur: Column, speed: Column, moved: Column, turned: Column, sharp: float, fast: float, least: float, turn: float) -> Column:
    """blurry (a known measure below ``sharp``), tooFast, tooSlow (neither moved nor turned enough) or good, in this order."""
    return F.when(blur < sharp, "blurry").when(speed > fast, "tooFast").when((moved < least) & (turned < turn), "tooSlow").otherwise("good")


def keyframe_gate(poses: DataFrame, session: str, order: str, time: str, coords: list[str], gate: Gate) -> DataFrame:
    """``session``, ``order``, accepted and reason (null if accepted): each sample against the last accepted one, which lag()
    can't express.

    Sessions are dealt by key and sorted on the JVM; a task folds them batch by batch and holds one accepted sample, so a
    session of any length fits.
    """
    schema = f"{session} {poses.schema[session].dataType.simpleString()}, {order} {poses.schema[order].dataType.simpleString()}, accepted boolean, reason string"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = None, None
        for batch in batches:
            out: list[str | None] = []
            keys, samples = batch.column(0).to_pylist(), list(zip(*(batch.column(i).to_pylist() for i in range(2, batch.num_columns))))
            lo = 0
            while lo < len(keys):  # runs of one session
                if keys[lo] != at:
                    at, last = keys[lo], None
                hi = next((k for k in range(lo, len(keys)) if keys[k] != at), len(keys))
                why, last = gate.fold(last, samples[lo:hi])
                out += why
                lo = hi
            accepted = pa.array([w is None for w in out], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), accepted, pa.array(out, pa.string())], names=[session, order, "accepted", "reason"])

    rows = poses.select(session, order, time, *coords).repartition(session).sortWithinPartitions(session, order)
    return rows.mapInArrow(fold, schema)


def gate_stream(poses: DataFrame, session: str, order: str, time: str, coords: list[str], gate: Gate) -> DataFrame:
    """The same gate over a stream; the last accepted sample, and how many came since, are the state of a session."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = (lambda s: (s[0], tuple(s[2:]), s[1]))(state.get) if state.exists else None
        # the rows of a batch may come in several frames: all are needed before sorting
        frame = pd.concat(list(frames)).sort_values(order, kind="stable")
        out, last = gate.fold(last, list(frame[[time, *coords]].itertuples(index=False, name=None)))
        state.update((float(last[0]), int(last[2]), *map(float, last[1])))
        yield pd.DataFrame({session: frame[session], order: frame[order], "accepted": [w is None for w in out], "reason": out})

    out = f"{session} {poses.schema[session].dataType.simpleString()}, {order} {poses.schema[order].dataType.simpleString()}, accepted boolean, reason string"
    held = ", ".join(["t double", "since long", *(f"p{i} double" for i in range(len(coords)))])
    return poses.select(session, order, time, *coords).groupBy(session).applyInPandasWithState(fold, out, held, "append", GroupStateTimeout.NoTimeout)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of quaternions (x, y, z, w), row by row."""
    (x, y, z, w), e = a.T, b.T
    return np.stack([w * e[0] + x * e[3] + y * e[2] - z * e[1], w * e[1] - x * e[2] + y * e[3] + z * e[0], w * e[2] + x * e[1] - y * e[0] + z * e[3], w * e[3] - x * e[0] - y * e[1] - z * e[2]], axis=1)


def _turns(dt: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """Yaw (rate x), pitch (rate y) and roll (rate z) over ``dt`` as quaternions."""
    (a, b, c) = (rates * dt[:, None] / 2).T
    sa, sb, sc, ca, cb, cc = np.sin(a), np.sin(b), np.sin(c), np.cos(a), np.cos(b), np.cos(c)
    return np.stack([cc * sb * ca + sc * cb * sa, cc * cb * sa - sc * sb * ca, sc * cb * ca - cc * sb * sa, cc * cb * ca + sc * sb * sa], axis=1)


def _turned(turns: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of each run of ``size`` quaternions the product in order, as a unit: neighbours are multiplied until one is left."""
    while (size > 1).any():
        first = np.cumsum(size) - size
        i = np.arange(len(turns)) - np.repeat(first, size)
        lead = (i % 2 == 0) & (i + 1 < np.repeat(size, size))
        at = np.flatnonzero(lead)
        turns[at] = _times(turns[at], turns[at + 1])
        turns, size = turns[i % 2 == 0], (size + 1) // 2
    return turns / np.sqrt((turns * turns).sum(axis=1))[:, None]


def turned_by_gyro(samples: DataFrame, session: str, t: str, rates: list[str]) -> DataFrame:
    """session, q: the orientation (x, y, z, w) after a session's gyroscope samples, as ``geometry.turned_by_gyro`` has it for an
    array of them; null after a sample with a null rate.

    Samples are dealt by ranges of session and time, and a task multiplies its turns batch by batch; the products of a session's
    ranges are joined in order.  So a session of any length is turned by as many tasks as it has ranges, none of which holds it.
    """
    kind = samples.schema[session].dataType.simpleString()
    names = ["x", "y", "z"]
    rows = samples.select(F.col(session).alias("s"), F.col(t).cast("double").alias("t"), *[F.col(c).cast("double").alias(n) for c, n in zip(rates, names)])
    rows = rows.repartitionByRange("s", "t", *names).sortWithinPartitions("s", "t", *names)
    schema = f"s {kind}, n long, t double, x double, y double, z double, last double, q array<double>, known boolean"

    def heads(keys: pa.Array) -> np.ndarray:
        """Where runs of one session begin."""
        null, same = keys.is_null().to_numpy(zero_copy_only=False), pc.fill_null(pc.equal(keys[1:], keys[:-1]), False).to_numpy(zero_copy_only=False)
        return np.flatnonzero(np.append(True, ~(same | null[1:] & null[:-1])))

    def read(batch: pa.RecordBatch, c: str) -> np.ndarray:
        return batch.column(c).to_numpy(zero_copy_only=False).astype(float)  # null: NaN

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each run its first sample, whose turn needs the time before, and the turn by the others."""
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            first = heads(batch.column(0))
            size = np.diff(np.append(first, batch.num_rows))
            told = batch.column("t").is_valid().to_numpy(zero_copy_only=False)
            dt = np.append(0.0, np.where(told[1:] & told[:-1], np.diff(read(batch, "t")), 0.0))
            turns = _turns(dt, np.stack([read(batch, c) for c in names], axis=1))
            turns[first] = (0.0, 0.0, 0.0, 1.0)
            known = np.logical_and.reduce([batch.column(c).is_valid().to_numpy(zero_copy_only=False) for c in names])
            q = pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1, dtype=np.int32) * 4), pa.array(_turned(turns, size).ravel()))
            head, last = batch.take(pa.array(first)), batch.column("t").take(pa.array(first + size - 1))
            yield pa.RecordBatch.from_arrays([head.column(0), pa.array(np.arange(n, n + len(first))), *head.columns[1:], last, q, pa.array(np.logical_and.reduceat(known, first))], names=["s", "n", "t", "x", "y", "z", "last", "q", "known"])
            n += len(first)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []  # of the session under way: its id, last time, turn, and whether that is known

        def out(rows: list) -> pa.RecordBatch:
            q = pa.array([r[2].tolist() if r[3] else None for r in rows], pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], target), q], names=[session, "q"])

        for batch in batches:
            if not batch.num_rows:
                continue
            first = heads(batch.column(0))
            ids, last = batch.column(0).take(pa.array(first)).to_pylist(), batch.column("last").to_pylist()
            goes_on = bool(held) and held[0][0] == ids[0]
            at, before = read(batch, "t"), np.append(np.nan, read(batch, "last")[:-1])
            valid = batch.column("t").is_valid().to_numpy(zero_copy_only=False) & np.append(False, batch.column("last").is_valid().to_numpy(zero_copy_only=False)[:-1])
            valid[first] = False
            if goes_on:
                before[0] = np.nan if held[0][1] is None else held[0][1]
                valid[0] = held[0][1] is not None and batch.column("t")[0].is_valid
            turns = _times(_turns(np.where(valid, at - before, 0.0), np.stack([read(batch, c) for c in names], axis=1)), batch.column("q").flatten().to_numpy().reshape(-1, 4))
            q = _turned(turns, np.diff(np.append(first, batch.num_rows)))
            known = np.logical_and.reduceat(batch.column("known").to_numpy(zero_copy_only=False), first).tolist()
            ends = np.append(first[1:], batch.num_rows) - 1
            rows = [[i, last[e], x, k] for i, e, x, k in zip(ids, ends.tolist(), q, known)]
            if goes_on:
                rows[0] = [ids[0], rows[0][1], _turned(_times(held[0][2][None], q[:1]), np.array([1]))[0], held[0][3] and known[0]]
            elif held:
                rows.insert(0, held[0])
            held = [rows.pop()]
            if rows:
                yield out(rows)
        if held:
            yield out(held)

    from pyspark.sql.pandas.types import to_arrow_type

    target = to_arrow_type(samples.schema[session].dataType)
    parts = rows.mapInArrow(runs, schema).withColumn("p", F.spark_partition_id())
    return parts.repartition("s").sortWithinPartitions("s", "p", "n").mapInArrow(join, f"`{session}` {kind}, q array<double>")
