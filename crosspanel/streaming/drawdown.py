"""Drawdown controller: six breakers with cool-downs and a latch, as a fold over a table and as a stateful stream.

Input rows are (key, time, value, reset): a value of the key's portfolio, or, where reset is not null, a manual reset of the breaker of
that name (``all``: of every breaker, and the peak becomes the current value).  Rows of a key count in the order of time; at one time
values come before resets and smaller before larger.  Equal rows count once; rows without a time, or without value and reset, are left
out.  Output rows are one per input row, and one per breaker that its cool-down releases.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor


class Breaker(NamedTuple):
    """Fires at a drawdown of ``limit`` or more; goes after ``hours`` unless ``latched``, then only by a reset."""

    name: str
    limit: float
    action: str
    hours: int
    exposure: float | None
    latched: bool


#: Fixed values, mildest first.
BREAKERS = (
    Breaker("daily_loss_2pct", 0.02, "alert", 4, None, False),
    Breaker("daily_loss_3pct", 0.03, "halt_new_positions", 8, None, False),
    Breaker("daily_loss_5pct", 0.05, "reduce_exposure", 24, 0.50, False),
    Breaker("drawdown_10pct", 0.10, "reduce_exposure", 48, 0.75, False),
    Breaker("drawdown_15pct", 0.15, "close_losers", 72, None, False),
    Breaker("drawdown_20pct", 0.20, "full_deleverage", 168, 0.25, True),
)
#: Actions that halt trading, and the drawdown that still counts as the peak.
HALTS, AT_PEAK = ("halt_new_positions", "full_deleverage", "emergency_liquidate"), 0.001
#: The columns after key and time.
COLUMNS = "event string, breaker string, value double, peak double, drawdown double, fired string, active string, action string, exposure double, halted boolean, days_in_drawdown int, recovery double"
_HOUR, _DAY = 3_600_000_000, 86_400_000_000


class Book:
    """The state of one key: peak, value, number of values, last time at the peak, and when each active breaker fired (microseconds)."""

    def __init__(self, peak: float | None, breakers: tuple[Breaker, ...], value: float | None = None, n: int = 0, high: int | None = None, active: dict[str, int] | None = None) -> None:
        self.peak, self.breakers, self.value, self.n, self.high, self.active = peak, breakers, value, n, high, dict(active or {})

    def releases(self, until: int) -> Iterator[tuple]:
        """Frees what cooled down by ``until``: (time, row)."""
        due = sorted((self.active[b.name] + b.hours * _HOUR, i, b.name) for i, b in enumerate(self.breakers) if b.name in self.active and not b.latched)
        for end, _, name in due:
            if end <= until:
                del self.active[name]
                yield end, ("release", name, *[None] * 10)

    def take(self, time: int, value: float | None, reset: str | None) -> Iterator[tuple]:
        """The rows of one input row, releases that are due first."""
        yield from self.releases(time)
        fired: list[Breaker] = []
        if reset is not None:
            if reset == "all":
                self.active.clear()
                self.peak = self.value if self.value is not None else self.peak
            self.active.pop(reset, None)
        else:
            self.value, self.n = value, self.n + 1
            self.peak = value if self.peak is None else max(self.peak, value)
            drawdown = self.drawdown()
            if drawdown >= -AT_PEAK:
                self.high = time
            for b in self.breakers:
                cooling = b.name in self.active and time < self.active[b.name] + b.hours * _HOUR
                if not cooling and drawdown <= -b.limit:
                    self.active[b.name] = time
                    fired.append(b)
        held = [b for b in self.breakers if b.name in self.active]
        days = self.n if self.high is None else (time - self.high) // _DAY
        recovery = None if self.value is None else self.peak / self.value - 1 if self.value > 0 else 0.0
        yield time, (
            "value" if reset is None else "reset", reset, self.value, self.peak, self.drawdown(), ",".join(b.name for b in fired), ",".join(b.name for b in held),
            fired[-1].action if fired else "none", min([1.0, *(b.exposure for b in held if b.exposure is not None)]), any(b.action in HALTS for b in held), days, recovery,
        )

    def drawdown(self) -> float | None:
        return None if self.value is None else (self.value - self.peak) / self.peak if self.peak else 0.0


def _micros(time: pd.Timestamp) -> int:
    return (time.value if time.tzinfo is None else time.tz_convert("UTC").value) // 1_000


def _frame(keys: list[tuple], rows: list[tuple], by: list[str], time: str) -> pd.DataFrame:
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    out = pd.DataFrame([(*k, pd.Timestamp(at, unit="us"), *r) for k, (at, r) in zip(keys, rows, strict=True)], columns=[*by, time, *names])
    return out.astype({"days_in_drawdown": "Int32", "halted": "boolean"})


def _inputs(df: DataFrame, by: list[str], time: str, value: str, reset: str | Column | None) -> DataFrame:
    found = F.lit(None).cast("string") if reset is None else F.col(reset) if isinstance(reset, str) else reset
    rows = df.select(*by, F.col(time).cast("timestamp").alias(time), F.when(found.isNull(), F.col(value).cast("double")).alias("value"), found.alias("reset"))
    return rows.filter(F.col(time).isNotNull() & (F.col("value").isNotNull() | F.col("reset").isNotNull()))


def controlled(
    df: DataFrame, by: list[str], time: str, value: str, reset: str | Column | None = None, initial: float | None = None,
    until: dt.datetime | None = None, breakers: tuple[Breaker, ...] = BREAKERS,
) -> DataFrame:
    """The controller over a table.  The peak begins at ``initial``, or at the first value; releases after a key's last row are given up
    to ``until``.

    Each task folds its keys in order, row by row as they come from Spark's sort, and keeps the state of one key.  A key is one ordered
    series, so it is never split over tasks; its rows are never held together.
    """
    rows = _inputs(df, by, time, value, reset).distinct()
    rows = rows.repartition(*by).sortWithinPartitions(*by, time, F.col("reset").isNotNull(), "value", "reset")
    end = None if until is None else _micros(pd.Timestamp(until))

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, book = None, None
        for part in parts:
            keys, out = [], []
            for row in part.itertuples(index=False, name=None):
                own = tuple(None if pd.isna(k) else k for k in row[: len(by)])
                if own != key or book is None:
                    if book is not None and end is not None:
                        last = list(book.releases(end))
                        keys, out = keys + [key] * len(last), out + last
                    key, book = own, Book(initial, breakers)
                new = list(book.take(_micros(row[-3]), row[-2], row[-1] if isinstance(row[-1], str) else None))
                keys.extend([own] * len(new))
                out.extend(new)
            yield _frame(keys, out, by, time)
        if book is not None and end is not None:
            last = list(book.releases(end))
            yield _frame([key] * len(last), last, by, time)

    types = dict(rows.dtypes)
    return rows.mapInPandas(run, ", ".join([f"`{c}` {types[c]}" for c in by] + [f"`{time}` timestamp", COLUMNS]))


def drawdown_states(df: DataFrame, by: list[str], time: str, value: str, breakers: tuple[Breaker, ...] = BREAKERS) -> DataFrame:
    """Running peak, drawdown, and the severest breaker whose limit a row has passed, whatever fired before: one window, no state."""
    peak = F.max(value).over(Window.partitionBy(*by).orderBy(time).rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("peak", peak).withColumn("drawdown", F.try_divide(F.col(value), "peak") - 1)
    name = F.lit("none")
    for b in breakers:
        name = F.when(F.col("drawdown") <= -b.limit, b.name).otherwise(name)
    return df.withColumn("breaker", name)


class _Controller(StatefulProcessor):
    """One key's buffered rows, book and active breakers.  Rows wait until the watermark has passed them; then they are taken in order.
    Timers stand at the times of waiting rows and at the ends of cool-downs."""

    def __init__(self, by: list[str], time: str, initial: float | None, breakers: tuple[Breaker, ...]) -> None:
        self.by, self.time, self.initial, self.breakers = by, time, initial, breakers

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "time long, value double, reset string", "n int")
        self.book = handle.getValueState("book", "peak double, value double, n long, high long")
        self.active = handle.getMapState("active", "name string", "time long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for at, value, reset in part[[self.time, "value", "reset"]].itertuples(index=False, name=None):
                micros = _micros(at)
                self.waiting.updateValue((micros, None if pd.isna(value) else value, reset if isinstance(reset, str) else None), (1,))
                self.handle.registerTimer(-(-micros // 1_000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1_000  # all that is due, so that nothing waits for a further batch
        peak, value, n, high = self.book.get() if self.book.exists() else (self.initial, None, 0, None)
        before = {k[0]: v[0] for k, v in self.active.iterator()}
        book = Book(peak, self.breakers, value, n, high, before)
        due = sorted((tuple(k) for k in self.waiting.keys() if k[0] <= until), key=lambda k: (k[0], k[2] is not None, k[1] or 0.0, k[2] or ""))
        out = []
        for at, found, reset in due:
            out += book.take(at, found, reset)
            self.waiting.removeKey((at, found, reset))
        out += book.releases(until)
        if due:
            self.book.update((book.peak, book.value, book.n, book.high))
        for name in before.keys() - book.active.keys():
            self.active.removeKey((name,))
        for b in self.breakers:
            if b.name in book.active and book.active[b.name] != before.get(b.name):
                self.active.updateValue((b.name,), (book.active[b.name],))
                if not b.latched:
                    self.handle.registerTimer(-(-(book.active[b.name] + b.hours * _HOUR) // 1_000))
        if out:
            yield _frame([tuple(key)] * len(out), out, self.by, self.time)

    def close(self) -> None:
        pass


def controlled_stream(
    stream: DataFrame, by: list[str], time: str, value: str, late: str, reset: str | Column | None = None, initial: float | None = None,
    breakers: tuple[Breaker, ...] = BREAKERS,
) -> DataFrame:
    """The controller over a stream: the rows of ``controlled``, each once the watermark (``late`` behind the newest row) has passed it.

    Rows that come again while they wait count once; rows behind the watermark are dropped, replayed ones among them.  So a stream
    whose rows are at most ``late`` behind gives what the table gives.  The session needs Spark's RocksDB state store.
    """
    rows = _inputs(stream, by, time, value, reset).withWatermark(time, late)
    types = dict(rows.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in by] + [f"`{time}` timestamp", COLUMNS])
    return rows.groupBy(*by).transformWithStateInPandas(_Controller(by, time, initial, breakers), schema, "append", "eventTime")
