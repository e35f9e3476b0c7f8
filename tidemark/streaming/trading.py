"""Router and ledger over a stream of bars: state for each pair, event-time timers, the rules of the batch operators."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.ledger import Costs, Ledger
from tidemark.operators.router import START, Policy, best_of, follow

EVENTS = (
    "pair string, kind string, ts date, selected string, switched boolean, held int, rule string, signal double, sl_pct double, tp_pct double, "
    "entry_date date, direction int, entry_price double, exit_price double, size double, pnl_pct double, exit_reason string, phase string"
)
_COLUMNS = [c.strip().split(" ")[0] for c in EVENTS.split(",")]
_ROUTE = _COLUMNS[3:10]
_TRADE = ["entry_date", "ts", "direction", "entry_price", "exit_price", "size", "pnl_pct", "exit_reason", "phase"]
_DAY = 86_400_000


def _day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def _millis(day: dt.date) -> int:
    return (day - dt.date(1970, 1, 1)).days * _DAY


class Book:
    """One pair's router and ledger, bar by bar; what it knows goes to JSON and back between micro-batches."""

    def __init__(self, policy: Policy, costs: Costs, most_days: int | None, known: dict | None):
        self.policy, self.costs, self.most_days = policy, costs, most_days
        k = known or {"machine": list(START), "signal": 0.0, "sign": 0, "held": None, "last": None, "done": False}
        self.machine, self.signal, self.sign, self.last, self.done = tuple(k["machine"]), k["signal"], k["sign"], k["last"], k["done"]
        self.ledger = Ledger(costs=costs)
        self.ledger.held = k["held"] and {**k["held"], "entry_date": _day(k["held"]["entry_date"])}

    def known(self) -> dict:
        """What the next micro-batch starts from."""
        held = self.ledger.held and {**self.ledger.held, "entry_date": self.ledger.held["entry_date"].isoformat()}
        return {"machine": list(self.machine), "signal": self.signal, "sign": self.sign, "held": held, "last": self.last, "done": self.done}

    def deadline(self) -> dt.date | None:
        """The day by which the open trade ends, bars or none."""
        return self.ledger.held["entry_date"] + dt.timedelta(self.most_days) if self.ledger.held and self.most_days is not None else None

    def expire(self, day: dt.date) -> list[dict]:
        """The open trade closed at the last close, if its time was over before `day`; there is no other one until the signal's sign changes."""
        end = self.deadline()
        if end is None or end >= day:
            return []
        closed = self.ledger._closed(end, self.last[1], "max_hold")
        self.ledger.held, self.done = None, True
        return [self._trade(closed)]

    def _trade(self, closed: tuple) -> dict:
        return {"kind": "trade", **dict(zip(_TRADE, closed[: len(_TRADE)], strict=True))}

    def bar(self, r: dict) -> list[dict]:
        """The route of a bar, and the trades that it closes."""
        day = _day(r["ts"])
        out = self.expire(day)
        before, (self.machine, rule, signal, sl, tp) = self.machine, follow(self.policy, self.machine, r, best_of(r))
        out.append({"kind": "route", "ts": day, **dict(zip(_ROUTE, (self.machine[0], self.machine[0] != before[0], self.machine[1], rule, signal, sl, tp), strict=True))})
        executed, sign = self.signal, (self.signal > 0) - (self.signal < 0)
        bar = {**{c: r[c] for c in ("high", "low", "close", "phase")}, "ts": day, "executed": executed, "sl_pct": sl, "tp_pct": tp, "atr": 0.0, "stop_atr_mult": 0.0}
        closed = []
        if sign != self.sign:
            closed += self.ledger.step({**bar, "ends": True}) if self.ledger.held else []
            self.ledger.held, self.done = None, False
        if sign != 0 and not self.done:
            closed += self.ledger.step({**bar, "ends": False})
        self.signal, self.sign, self.last = signal, sign, [r["ts"], r["close"]]
        return out + [self._trade(t) for t in closed]


class Trader(StatefulProcessor):
    """Bars wait as state until the watermark has passed them, so that they are worked on in the order of their time, wherever
    micro-batches are cut. A timer wakes the pair for its next bar, or for the day that ends its open trade."""

    def __init__(self, policy: Policy, costs: Costs, most_days: int | None):
        self.policy, self.costs, self.most_days = policy, costs, most_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        """The pair's book, and bars that wait."""
        self.handle = handle
        self.book = handle.getValueState("book", "known string")
        self.waiting = handle.getListState("waiting", "bar string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        """New bars are put to those that wait."""
        new = []
        for part in rows:
            part = part.assign(ts=part["ts"].dt.strftime("%Y-%m-%d"))
            new += [json.dumps(r) for r in part.to_dict("records")]
        self.waiting.appendList([(b,) for b in new])
        yield from self._upto(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """The watermark has come to a bar or to the end of a trade."""
        yield from self._upto(key, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        """Nothing is held."""

    def _upto(self, key: Any, watermark: int) -> Iterator[pd.DataFrame]:
        bars = [json.loads(b) for (b,) in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((b for b in bars if _millis(_day(b["ts"])) <= watermark), key=lambda b: b["ts"])
        later = [b for b in bars if _millis(_day(b["ts"])) > watermark]
        known = self.book.get()[0] if self.book.exists() else None
        book = Book(self.policy, self.costs, self.most_days, json.loads(known) if known else None)
        out = [e for b in due for e in book.bar(b)]
        out += book.expire(dt.date(1970, 1, 1) + dt.timedelta(max(watermark, 0) // _DAY))
        if due or out:
            self.book.update((json.dumps(book.known()),))
        if due:
            self.waiting.put([(json.dumps(b),) for b in later]) if later else self.waiting.clear()
        wakes = [_millis(_day(b["ts"])) for b in later]
        if end := book.deadline():
            wakes.append(_millis(end) + _DAY)
        if wakes and (soon := min(wakes)) > watermark and soon not in set(self.handle.listTimers()):
            self.handle.registerTimer(soon)
        if out:
            events = pd.DataFrame([{"pair": key[0], **e} for e in out], columns=_COLUMNS, dtype=object)
            yield events.where(events.notna(), None)  # routes and trades each lack the other's columns


@contextmanager
def with_timers(spark: SparkSession) -> Iterator[None]:
    """The state store that keeps timers, for streams that are started inside."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def traded(bars: DataFrame, policy: Policy = Policy(), costs: Costs = Costs(), most_days: int | None = None, late: str = "3 days") -> DataFrame:
    """Routes and closed trades (`kind`) of a stream of daily bars: the columns that `router.route` and `ledger.ledger_trades` need, `ts` a timestamp.

    They equal those of the batch operators for bars that the watermark has passed; a bar later than `late` is dropped, and a trade that is
    open stays in the state. With `most_days` a trade also ends after so many days at the last close, by a timer if no bar
    comes. State is one book and the bars of the last days for each pair.
    """
    return bars.withWatermark("ts", late).groupBy("pair").transformWithStateInPandas(Trader(policy, costs, most_days), EVENTS, "Append", "EventTime")
