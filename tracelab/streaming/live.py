"""Live statistics by Structured Streaming.

stream_counters drops events that come later than its watermark; split_late tells late rows apart, so that they can have a sink of their own.
What follows the order of a key's rows (W2, W3) sorts those of one batch, whose size the source bounds (maxFilesPerTrigger); batches must come in order.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Stateful processors also start on the driver in a process of its own, which may not have this package on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def stream_counters(events: DataFrame, time: str, interval: str, delay: str, keys: Sequence[str] = (), kind: str = "event") -> DataFrame:
    """(keys, window start, kind, n, total of value): counts of each interval, final once the watermark passes it."""
    rows = events.withWatermark(time, delay)
    return rows.groupBy(F.window(time, interval).alias("w"), *keys, kind).agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), *keys, kind, "n", "value")


def running_totals(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cumulative counters from the sink of stream_counters, in batch."""
    w = Window.partitionBy(*keys).orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumns({"n": F.sum("n").over(w), "value": F.sum("value").over(w)})


class StatusChanges(StatefulProcessor):
    """Rows whose state differs from the key's one before; the last state is kept for a time."""

    def __init__(self, time: str, state: str, ttl_ms: int | None):
        self.time, self.state, self.ttl = time, state, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "state string", ttlDurationMs=self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        some = pd.concat(list(rows)).sort_values(self.time, kind="stable")
        before = self.last.get()[0] if self.last.exists() else None
        shifted = some[self.state].shift()
        shifted.iloc[0] = before
        self.last.update((some[self.state].iloc[-1],))
        changed = some[shifted != some[self.state]]
        if len(changed):
            yield changed

    def close(self) -> None:
        pass


def stream_status_changes(events: DataFrame, keys: Sequence[str], time: str, state: str, ttl_ms: int | None = None) -> DataFrame:
    return events.groupBy(*keys).transformWithStateInPandas(StatusChanges(time, state, ttl_ms), events.schema, "Append", "ProcessingTime" if ttl_ms else "None")


class Usage(StatefulProcessor):
    """Live use of a machine: own demand by tasks and a property's shared demand by mode (see operators.usage)."""

    def __init__(self, mode: str):
        self.mode = {"deactivated": "never"}.get(mode, mode)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.used = handle.getValueState("used", "reserved long, used long")
        self.running = handle.getMapState("running", "property string", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        reserved, used = self.used.get() if self.used.exists() else (0, 0)
        some = pd.concat(list(rows)).sort_values(["time", "seq"])
        step = (some["event"] == "claim").to_numpy() * 2 - 1
        # State is asked and told once a property, not once a row.
        at, names = pd.factorize(some["property"], use_na_sentinel=False)
        names = [None if pd.isna(x) else x for x in names]
        before = np.array([self.running.getValue((x,))[0] if self.running.containsKey((x,)) else 0 for x in names], np.int64)
        n = pd.Series(step).groupby(at).cumsum().to_numpy() + before[at]
        for x, k in zip(names, before + np.bincount(at, step, len(names)).astype(np.int64), strict=True):
            self.running.updateValue((x,), (int(k),))
        toggle = np.where(n == (step + 1) // 2, step, 0)  # to 1 by a claim, to 0 by an end
        demand = some["demand"].to_numpy()
        once = 0 if self.mode == "never" else toggle * demand
        own = step * (some["num_tasks"] * some["own"]).to_numpy()
        out = some[["seq", "time", "machine_id"]].reset_index(drop=True)
        out["reserved"] = reserved + (own + (step * some["num_tasks"].to_numpy() * demand if self.mode == "foreach" else once)).cumsum()
        out["used"] = used + (own + once).cumsum()
        self.used.update((int(out["reserved"].iloc[-1]), int(out["used"].iloc[-1])))
        yield out

    def close(self) -> None:
        pass


def stream_usage(events: DataFrame, mode: str) -> DataFrame:
    """(seq, time, machine_id, reserved, used) after each event. events: seq, time, event, machine_id, num_tasks, own, property, demand; longs but for event and property."""
    return events.groupBy("machine_id").transformWithStateInPandas(Usage(mode), "seq long, time long, machine_id long, reserved long, used long", "Append", "None")


class LastN(StatefulProcessor):
    """The n latest values of a key. Rows are cut to n as they come in; more are never held."""

    def __init__(self, key: str, value: str, order: str, n: int):
        self.key, self.value, self.order, self.n = key, value, order, n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "o long, v double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = list(self.kept.get()) if self.kept.exists() else []
        for some in rows:
            top = some.nlargest(self.n, self.order, keep="all") if len(some) > self.n else some
            held = sorted([*held, *((int(o), float(v)) for o, v in zip(top[self.order], top[self.value], strict=True))])[-self.n :]
        self.kept.put([(o, v) for o, v in held])
        values = sorted(v for _, v in held)
        yield pd.DataFrame({self.key: [key[0]], "n": [len(values)], "min": [values[0]], "mean": [sum(values) / len(values)], "median": [values[len(values) // 2]], "max": [values[-1]]})

    def close(self) -> None:
        pass


def stream_last_n(events: DataFrame, key: str, value: str, order: str, n: int) -> DataFrame:
    """(key, n, min, mean, upper median, max) of the n latest values, after each batch."""
    kind = dict(events.dtypes)[key]
    return events.groupBy(key).transformWithStateInPandas(LastN(key, value, order, n), f"`{key}` {kind}, n long, min double, mean double, median double, max double", "Update", "None")


class LateRows(StatefulProcessor):
    """Marks each row by when it came: late if it is over `delay` behind the latest of its key in earlier batches, beyond if after the end."""

    def __init__(self, time: str, delay: int, end: int | None):
        self.time, self.delay, self.end = time, delay, end

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "t long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.latest.get()[0] if self.latest.exists() else None
        now = before
        for some in rows:
            time = some[self.time]
            arrival = pd.Series("on time", some.index)
            if before is not None:
                arrival[time < before - self.delay] = "late"
            beyond = time > self.end if self.end is not None else pd.Series(False, some.index)
            arrival[beyond] = "beyond"
            told = time[~beyond]
            if len(told):
                now = int(told.max()) if now is None else max(now, int(told.max()))
            yield some.assign(arrival=arrival)
        if now is not None:
            self.latest.update((now,))

    def close(self) -> None:
        pass


def split_late(events: DataFrame, keys: Sequence[str], time: str, delay: int, end: int | None = None) -> DataFrame:
    """events with a column arrival: `on time`, `late` or `beyond`. time is a long that isn't null. Each key has its own watermark, `delay` behind the latest time that earlier batches told it.

    Written with partitionBy("arrival"), each kind has a folder of its own, late rows beside those that went on; none is dropped.
    """
    kept = ", ".join(f"`{c}` {t}" for c, t in events.dtypes)
    return events.groupBy(*keys).transformWithStateInPandas(LateRows(time, delay, end), f"{kept}, arrival string", "Append", "None")
