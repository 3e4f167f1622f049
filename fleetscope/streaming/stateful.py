"""Streaming operators with custom state: alarms, probe health, live claims, hot tail.

Each key keeps a small record. Rows that need their order wait in Spark's own aggregation
state until the watermark has passed their bucket of time; a processor gets the due rows of
a key at once, folds them in with numpy, and reads and writes its record once a micro-batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fleetscope import fixed_values as fv
from fleetscope.session import broadcast_if_small, ship_by_value

ship_by_value(__name__)

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

TRANSITION_COLUMNS = (
    "alarm string, series string, period_start timestamp, value double, state string, previous string, notify_ok boolean"
)
HEALTH_COLUMNS = "target string, ts timestamp, id long, ok boolean, state string"
CLAIM_COLUMNS = "resource_key string, machine_id string, change string, at timestamp"
TAIL_COLUMNS = "session_id string, first_seq long, last_seq long, bytes_kept long, tail binary"

#: Length of the buckets in which rows wait for the watermark.
BUCKET_S = 60


def _use_rocksdb(df: DataFrame) -> None:
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _stamp(micros) -> pd.Series:
    return pd.to_datetime(pd.Series(micros, dtype="int64"), unit="us")


def alarm_runs(breach: np.ndarray, at: np.ndarray, last: int, missing: bool, run: int, n: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Runs of breaching periods among the periods 1 to ``last``: (first, end, breaching periods at the end).

    ``at``: numbers of the published periods, rising; ``breach``: which of them breach. All others
    breach if ``missing``. ``run`` periods before the first breached. A run is listed from the period
    where it has ``n`` breaches to the one after its last; runs that don't get so far are left out.
    """
    if missing:
        calm = at[~breach]
        first, end = np.append(1, calm + 1), np.append(calm, last + 1)
    else:
        hit = at[breach]
        begins = np.flatnonzero(np.diff(hit, prepend=-1) != 1)
        first, end = hit[begins], hit[np.append(begins[1:], len(hit)) - 1] + 1 if len(hit) else hit
    before = np.where(first == 1, run, 0)
    tail = int((end[-1] - first[-1] + before[-1]) if len(end) and end[-1] == last + 1 else 0)
    alarm = first + np.maximum(n - before - 1, 0)
    some = alarm < end
    return alarm[some], end[some], tail


class AlarmProcessor(StatefulProcessor):
    """Folds period values of one (alarm, series) into OK / ALARM transitions.

    A period the watermark passed without a value is missing and follows the alarm's policy;
    an event-time timer sees to it when no row arrives at all. Declared series begin with the
    period before ``start_s``, so they are judged even if nothing is ever published. With
    ``retire_after``, a series is forgotten after so many missing periods in a row.
    """

    _NAMES = ("last_s", "run", "state", "period_s", "n", "op", "threshold", "missing", "notify_ok", "seen_s")

    def __init__(self, retire_after: int | None = None) -> None:
        self._retire_after = retire_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState(
            "alarm",
            "last_s long, run int, state string, period_s int, n int, op string, threshold double, "
            "missing string, notify_ok boolean, seen_s long",
        )

    def _begin(self, row, before_s: int) -> dict:
        return {
            "last_s": before_s, "run": 0, "state": "OK", "period_s": int(row.period_s), "n": int(row.n), "op": row.op,
            "threshold": float(row.threshold), "missing": row.missing, "notify_ok": bool(row.notify_ok), "seen_s": before_s,
        }

    def _fold(self, key, s: dict, starts: np.ndarray, values: np.ndarray, last_s: int) -> Iterator[pd.DataFrame]:
        """Judges every period after the last judged one up to ``last_s``."""
        last = (last_s - s["last_s"]) // s["period_s"]
        if last <= 0:
            return
        at, limit = (starts - s["last_s"]) // s["period_s"], s["threshold"]
        known = ~np.isnan(values)
        breach = {"<": values < limit, ">": values > limit}.get(s["op"], values >= limit)
        on, off, run = alarm_runs(breach[known], at[known], last, s["missing"] == "breaching", s["run"], s["n"])
        if s["state"] == "ALARM":  # it goes on, or ends with the first period that is calm
            on, off = (on[1:], off) if len(on) and on[0] == 1 else (on, np.append(1, off))
        off = off[off <= last]
        turns = np.concatenate([on, off])
        order = np.argsort(turns, kind="stable")
        states = np.array(["ALARM"] * len(on) + ["OK"] * len(off), object)[order]
        turns = turns[order]
        s["run"], s["last_s"] = run, s["last_s"] + last * s["period_s"]
        if len(turns):
            value = dict(zip(at[known].tolist(), values[known].tolist()))
            start_s = (s["last_s"] - (last - turns) * s["period_s"]) * 1_000_000
            yield pd.DataFrame(
                {
                    "alarm": key[0],
                    "series": key[1],
                    "period_start": _stamp(start_s),
                    "value": pd.Series([value.get(t) for t in turns.tolist()], dtype="float64"),
                    "state": states,
                    "previous": np.where(states == "OK", "ALARM", "OK"),
                    "notify_ok": s["notify_ok"],
                }
            )
            s["state"] = str(states[-1])

    def _save(self, s: dict) -> None:
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        silent = (s["last_s"] - s["seen_s"]) // s["period_s"]
        if self._retire_after is not None and silent >= self._retire_after:
            self._state.clear()
            return
        self._handle.registerTimer((s["last_s"] + 2 * s["period_s"]) * 1000)
        self._state.update(tuple(s[name] for name in self._NAMES))

    def _load(self) -> dict | None:
        return dict(zip(self._NAMES, self._state.get())) if self._state.exists() else None

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = next(initialState.itertuples())
        self._save(self._begin(row, int(row.start_s) - int(row.period_s)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = self._load()
        # one row per period: a key's share of a micro-batch is as long as its time span
        pdf = pd.concat(list(rows)).drop_duplicates("start_s").sort_values("start_s")
        if s is None:
            first = next(pdf.itertuples())
            s = self._begin(first, int(first.start_s) - int(first.period_s))
        pdf = pdf[pdf["start_s"] > s["last_s"]]  # others are repeated, or later than their turn
        if len(pdf):
            starts = pdf["start_s"].to_numpy(np.int64)
            s["seen_s"] = int(starts[-1])
            yield from self._fold(key, s, starts, pdf["value"].to_numpy(np.float64, na_value=np.nan), int(starts[-1]))
        self._save(s)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = self._load()
        if s is None:
            return
        passed = timerValues.getCurrentWatermarkInMs() // 1000 - s["last_s"]
        nothing = np.zeros(0, np.int64)
        yield from self._fold(key, s, nothing, nothing.astype(np.float64), s["last_s"] + (passed // s["period_s"] - 1) * s["period_s"])
        self._save(s)

    def close(self) -> None:
        pass


def alarm_stream(
    periods: DataFrame,
    specs: DataFrame,
    expected: DataFrame | None = None,
    since: Column | None = None,
    retire_after: int | None = None,
) -> DataFrame:
    """Alarm transitions of streaming period values.

    ``periods``: alarm, series, period_start, period_end (event time), value, as ``metric_windows``
    emits them; ``specs``: the alarm table. ``expected`` (alarm, series; not a stream) declares series
    that are judged from the period of ``since`` on, also if they never publish; all others begin with
    their first period. ``retire_after``: see the processor; without it a series is never forgotten.
    """
    _use_rocksdb(periods)
    rules = specs.select("alarm", "period_s", "n", "op", "threshold", "missing", "notify_ok")
    keyed = periods.join(broadcast_if_small(rules), "alarm").withColumn("start_s", F.unix_seconds("period_start"))
    declared = None
    if expected is not None:
        start = (F.floor(F.unix_seconds(since) / F.col("period_s")) * F.col("period_s")).cast("bigint")
        declared = expected.select("alarm", "series").distinct().join(rules, "alarm").withColumn("start_s", start)
        declared = declared.groupBy("alarm", "series")
    return keyed.groupBy("alarm", "series").transformWithStateInPandas(
        AlarmProcessor(retire_after), TRANSITION_COLUMNS, "append", "eventtime", declared
    )


def due_rows(rows: DataFrame, time: str, watermark: str, by: list[str], columns: list[str], bucket_s: int = BUCKET_S) -> DataFrame:
    """(by, us, columns, n) of a stream's rows once the watermark has passed their bucket of time; n equal rows are one.

    ``us`` is the time in microseconds. All rows of the buckets that a watermark passes come in one
    micro-batch, so what a key gets is later than all it got before, but not sorted.
    """
    bucket = F.window(time, f"{bucket_s} seconds").alias("bucket")
    waiting = rows.withWatermark(time, watermark).withColumn("us", F.unix_micros(time))
    return waiting.groupBy(*by, bucket, "us", *columns).agg(F.count(F.lit(1)).alias("n")).drop("bucket")


def held_states(ok: np.ndarray, good: int, bad: int, state: str, up: int, down: int) -> tuple[np.ndarray, int, int]:
    """(state after each probe, successes in a row at the end, failures in a row at the end)."""
    place = np.arange(len(ok))
    last_bad, last_good = (np.maximum.accumulate(np.where(x, place, -1)) for x in (~ok, ok))
    good_run = np.where(ok, place - last_bad + np.where(last_bad < 0, good, 0), 0)
    bad_run = np.where(~ok, place - last_good + np.where(last_good < 0, bad, 0), 0)
    switch = np.where(good_run >= up, 1, np.where(bad_run >= down, 2, 0))
    last = np.maximum.accumulate(np.where(switch > 0, place, -1))
    names = np.array([state, "healthy", "unhealthy"], object)
    return names[np.where(last < 0, 0, switch[last])], int(good_run[-1]), int(bad_run[-1])


class ProbeHealthProcessor(StatefulProcessor):
    """Run lengths and held state of one target."""

    def __init__(self, up: int, down: int) -> None:
        self._up, self._down = up, down

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._runs = handle.getValueState("runs", "good int, bad int, state string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        good, bad, state = self._runs.get() or (0, 0, "initial")
        due = pd.concat(list(rows))
        us, ids, ok = due["us"].to_numpy(), due["id"].to_numpy(), due["ok"].to_numpy(bool)
        order = np.lexsort((ok, ids, us))
        order = np.repeat(order, due["n"].to_numpy()[order])
        us, ids, ok = us[order], ids[order], ok[order]
        states, good, bad = held_states(ok, good, bad, state, self._up, self._down)
        self._runs.update((good, bad, str(states[-1])))
        yield pd.DataFrame({"target": key[0], "ts": us.astype("datetime64[us]"), "id": ids, "ok": ok, "state": states})

    def close(self) -> None:
        pass


def probe_health_stream(
    probes: DataFrame, watermark: str, up: int = fv.HEALTHY_AFTER, down: int = fv.UNHEALTHY_AFTER, bucket_s: int = BUCKET_S
) -> DataFrame:
    """Health after each probe, once the watermark has passed its bucket of time; ``probes``: target, ts, id, ok.

    A late probe still counts at its time. Probes of one time go by id.
    """
    _use_rocksdb(probes)
    due = due_rows(probes, "ts", watermark, ["target"], ["id", "ok"], bucket_s)
    return due.groupBy("target").transformWithStateInPandas(ProbeHealthProcessor(up, down), HEALTH_COLUMNS, "append", "none")


class LiveClaimsProcessor(StatefulProcessor):
    """The span in which one machine's claim on one resource is live; an observation extends it.

    A live span has one timer, for the end of the bucket in which it runs out.
    """

    def __init__(self, bucket_s: int = BUCKET_S) -> None:
        self._bucket_us = bucket_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._span = handle.getValueState("span", "end_us long")

    def _wake_ms(self, end_us: int) -> int:
        return -(-end_us // self._bucket_us) * self._bucket_us // 1000

    def _fold(self, key, held: int | None, begins: np.ndarray, ends: np.ndarray, timerValues) -> Iterator[pd.DataFrame]:
        """The changes of observations in the order of time, and of an end that no later one can move."""
        known_us = timerValues.getCurrentWatermarkInMs() * 1000 // self._bucket_us * self._bucket_us
        latest = np.maximum.accumulate(np.append(np.iinfo(np.int64).min if held is None else held, ends))
        new = np.flatnonzero(begins >= latest[:-1])  # nothing was live any more, or yet
        claimed, closed = begins[new], latest[new]
        if held is None:
            closed = closed[1:]
        if latest[-1] <= known_us and (held is not None or len(ends)):
            closed = np.append(closed, latest[-1])
            self._span.clear()
        elif len(ends):
            self._span.update((int(latest[-1]),))
            self._handle.registerTimer(self._wake_ms(int(latest[-1])))
        if len(claimed) + len(closed):
            changes = ["claimed"] * len(claimed) + ["expired"] * len(closed)
            at = _stamp(np.concatenate([claimed, closed]))
            yield pd.DataFrame({"resource_key": key[0], "machine_id": key[1], "change": changes, "at": at})

    def _held(self) -> int | None:
        return (self._span.get() or (None,))[0]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = pd.concat(list(rows)).sort_values(["us", "end_us"], kind="stable")
        seen, held = seen[seen["end_us"] > seen["us"]], self._held()
        if len(seen):
            if held is not None:
                self._handle.deleteTimer(self._wake_ms(held))
            yield from self._fold(key, held, seen["us"].to_numpy(np.int64), seen["end_us"].to_numpy(np.int64), timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        nothing = np.zeros(0, np.int64)
        yield from self._fold(key, self._held(), nothing, nothing, timerValues)

    def close(self) -> None:
        pass


def live_claims_stream(claims: DataFrame, watermark: str, bucket_s: int = BUCKET_S) -> DataFrame:
    """When a machine's claim on a resource begins and ends to be live: (resource_key, machine_id, change, at).

    ``claims``: resource_key, machine_id, observed_at, ttl_seconds. A claim lives from an observation
    until the latest of its observations has run out; it then expires by a timer, without a later row.
    Observations without a time to live are never live. Changes come out in event time, once the
    watermark has passed their bucket; a late observation still counts at its time.
    """
    _use_rocksdb(claims)
    # no filter here: it would be pushed below the watermark, which such observations move too
    lives = F.greatest(F.coalesce(F.col("ttl_seconds").cast("bigint"), F.lit(0)), F.lit(0)) * 1_000_000
    keyed, by = claims.withColumn("end_us", F.unix_micros("observed_at") + lives), ["resource_key", "machine_id"]
    return due_rows(keyed, "observed_at", watermark, by, ["end_us"], bucket_s).groupBy(*by).transformWithStateInPandas(
        LiveClaimsProcessor(bucket_s), CLAIM_COLUMNS, "append", "eventtime"
    )


def live_at(changes: DataFrame, as_of: Column) -> DataFrame:
    """(resource_key, machine_id) of what is live at a time, from the changes of ``live_claims_stream``."""
    last = F.max_by("change", F.struct("at", F.col("change") == "claimed"))
    held = changes.where(F.col("at") <= as_of).groupBy("resource_key", "machine_id").agg(last.alias("last"))
    return held.where("last = 'claimed'").drop("last")


class HotTailProcessor(StatefulProcessor):
    """The newest chunks of one open session that fit the cap, a state entry each.

    A new chunk is one write, and what no longer fits is removed from the old end, so an update
    does not rewrite the tail. ``floor`` is the newest chunk dropped so far: once one is dropped, no
    older chunk may come back, also when it arrives late.
    """

    def __init__(self, cap_bytes: int) -> None:
        self._cap = cap_bytes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._chunks = handle.getMapState("chunks", "seq long", "size long, body binary")
        self._ends = handle.getValueState("ends", "floor long, low long, high long, total long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        floor, low, high, total = self._ends.get() if self._ends.exists() else (-1, 0, -1, 0)
        closed = False
        for pdf in rows:
            closed = closed or bool(pdf["closed"].any())
            fresh = pdf[pdf["seq"] > floor]
            for seq, size, body in zip(fresh["seq"].tolist(), fresh["size"].tolist(), fresh["body"]):
                if seq <= floor or (low <= seq <= high and self._chunks.containsKey((seq,))):
                    continue  # older than what was dropped, or sent again
                self._chunks.updateValue((seq,), (size, bytes(body)))
                low, high, total = (seq, seq, size) if high < low else (min(low, seq), max(high, seq), total + size)
                while total > self._cap:
                    total -= self._chunks.getValue((low,))[0]
                    self._chunks.removeKey((low,))
                    floor = low
                    low = self._above(low, high)
                    if low > high:
                        low, high, total = 0, -1, 0
        if closed:
            self._chunks.clear()
            self._ends.clear()
            return
        self._ends.update((floor, low, high, total))
        if low <= high:
            held = sorted((seq, body) for (seq,), (_, body) in self._chunks.iterator())
            tail = b"".join(bytes(body) for _, body in held)
            yield pd.DataFrame({"session_id": [key[0]], "first_seq": [low], "last_seq": [high], "bytes_kept": [total], "tail": [tail]})

    def _above(self, low: int, high: int) -> int:
        """The oldest chunk after ``low``: mostly the next one; with a gap, all numbers are looked at."""
        if low >= high or self._chunks.containsKey((low + 1,)):
            return low + 1
        return min(seq for (seq,) in self._chunks.keys())

    def close(self) -> None:
        pass


def hot_tail(chunks: DataFrame, cap_bytes: int = fv.HOT_TAIL_BYTES) -> DataFrame:
    """Per micro-batch the tail each touched open session keeps, with its bytes; a closed session drops its state.

    ``chunks``: session_id, seq, size, body (the chunk's bytes), closed. A chunk sent again counts once.
    """
    _use_rocksdb(chunks)
    return chunks.groupBy("session_id").transformWithStateInPandas(
        HotTailProcessor(cap_bytes), TAIL_COLUMNS, "append", "none"
    )
