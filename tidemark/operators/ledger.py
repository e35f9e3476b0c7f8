"""Trades from signals: islands where no stop is set, an ordered fold where one is."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import blocks
from tidemark.operators.folding import fold_sorted
from tidemark.operators.windows import by_time, islands
from tidemark.storage import materialise


def executed(df: DataFrame) -> DataFrame:
    """`executed`: the signal of the bar before; flat on the first."""
    return df.withColumn("executed", F.coalesce(F.lag("signal").over(by_time()), F.lit(0)))


def island_trades(df: DataFrame) -> DataFrame:
    """Trades without stops: each stretch of one executed position, closed at the next stretch's first close."""
    stretch = islands(df, "executed").groupBy("pair", "island").agg(
        F.first("executed").alias("direction"), F.min("ts").alias("entry_date"), F.max("ts").alias("last_date"), F.count("*").alias("bars"),
        F.min_by("close", "ts").alias("entry_price"), F.max_by("close", "ts").alias("last_price"), F.min_by("phase", "ts").alias("phase"),
    )
    after = Window.partitionBy("pair").orderBy("island")
    closed = stretch.withColumn("exit_date", F.coalesce(F.lead("entry_date").over(after), "last_date")).withColumn("exit_price", F.coalesce(F.lead("entry_price").over(after), "last_price"))
    pnl = F.col("direction") * (F.col("exit_price") / F.col("entry_price") - 1)
    return closed.filter("direction <> 0").select("pair", "direction", "phase", "entry_date", "exit_date", "entry_price", "exit_price", pnl.alias("pnl_pct"), "bars")


@dataclass(frozen=True)
class Costs:
    """One way: half the spread, the slippage (both in pips of `pip`), and half the commission of a round trip."""

    spread_pips: float = 0.0
    slippage_pips: float = 0.0
    commission: float = 0.0
    pip: float = 0.0001

    def of(self, price: float, capital: float) -> float:
        """As a share of the price."""
        return (0.5 * self.spread_pips + self.slippage_pips) * self.pip / price + 0.5 * self.commission / capital


TRADE_SCHEMA = (
    "entry_date date, exit_date date, direction int, entry_price double, exit_price double, size double, pnl_pct double, exit_reason string, phase string, "
    "stop_distance double, entry_factor double, exit_factor double"
)


class Ledger:
    """The trades of one island: a stretch of bars whose executed signal has one sign, and the bar that ends it.

    Stops are looked at before targets, and both before the end of the island; whoever is stopped out enters again on the
    same bar. What capital was there is not needed: each trade multiplies it by `entry_factor`, then by `exit_factor`.
    """

    def __init__(self, capital: float = 10_000.0, costs: Costs = Costs(), risk: float | None = None):
        self.capital, self.costs, self.risk = capital, costs, risk
        self.held: dict | None = None
        self.last: dict | None = None

    def step(self, bar: dict) -> list[tuple]:
        """The trade that the bar closes, if it closes one; then an entry, unless the bar only ends the island."""
        self.last = bar
        trades = []
        if self.held and (out := self._exit(bar)):
            trades.append(self._closed(bar["ts"], *out))
            self.held = None
        if self.held is None and not bar["ends"]:
            close, side = bar["close"], 1 if bar["executed"] > 0 else -1
            level = lambda pct, sign: close * (1 + sign * side * pct) if pct > 0 else None
            self.held = {
                "direction": side, "size": abs(bar["executed"]), "entry_date": bar["ts"], "entry_price": close, "phase": bar["phase"], "stop": level(bar["sl_pct"], -1), "goal": level(bar["tp_pct"], 1),
                "distance": distance if (distance := bar["atr"] * bar["stop_atr_mult"]) > 0 else 0.0,  # none while the average is not there
            }
        return trades

    def finish(self) -> list[tuple]:
        """The trade that the last bar of all leaves open, closed there."""
        return [self._closed(self.last["ts"], self.last["close"], "end")] if self.held else []

    def _exit(self, bar: dict) -> tuple[float, str] | None:
        side, stop, goal = self.held["direction"], self.held["stop"], self.held["goal"]
        worst, best = (bar["low"], bar["high"]) if side > 0 else (bar["high"], bar["low"])
        if stop is not None and side * (worst - stop) <= 0:
            return stop, "stop_loss"
        if goal is not None and side * (best - goal) >= 0:
            return goal, "take_profit"
        return (bar["close"], "signal") if bar["ends"] else None

    def _closed(self, ts, price: float, reason: str) -> tuple:
        h = self.held
        cost, move, entry = self.costs.of(price, self.capital), h["direction"] * (price - h["entry_price"]), h["entry_price"]
        pct = move / entry - cost
        if self.risk is None:
            gain = pct * h["size"]
        else:  # a fixed share of the capital is at risk between entry and a stop of so many ATRs
            gain = self.risk / h["distance"] * (move - entry * cost) if h["distance"] > 0 else 0.0
        return h["entry_date"], ts, h["direction"], entry, price, float(h["size"]), pct, reason, h["phase"], float(h["distance"]), 1 - self.costs.of(entry, self.capital), 1 + gain


def in_islands(signals: DataFrame, keys: list[str], days: int = blocks.DAYS) -> DataFrame:
    """Bars with what is executed on them (the signal of the bar before) and `island`, the bar at which its sign began.

    A bar that begins an island or a flat stretch is there twice: it also `ends` the island before it. Flat bars are left
    out. After such a bar nothing depends on what was held before, so islands are worked on apart from each other. They
    are found by carries over blocks, so that no task sorts a whole key.
    """
    rows = blocks.in_blocks_of(materialise(signals), days=days).withColumn("signal", F.coalesce(F.col("signal").cast("double"), F.lit(0.0)))
    rows = blocks.lagged(rows, keys, "signal", "executed").withColumn("executed", F.coalesce("executed", F.lit(0.0))).withColumn("sign", F.signum("executed"))
    rows = blocks.lagged(rows, keys, "sign", "before").withColumn("begins", F.col("sign") != F.coalesce("before", F.lit(0.0)))
    rows = materialise(rows.withColumn("begun", F.when(F.col("begins"), F.col("ts"))))  # a carry reads its rows twice
    rows = blocks.last_value(rows, keys, "begun", "earlier", strict=True)
    own = F.struct(F.coalesce("begun", "earlier").alias("island"), F.lit(False).alias("ends"), (F.col("sign") != 0).alias("there"))
    other = F.struct(F.col("earlier").alias("island"), F.lit(True).alias("ends"), (F.col("begins") & (F.coalesce("before", F.lit(0.0)) != 0)).alias("there"))
    return rows.withColumn("of", F.explode(F.array(own, other))).filter("of.there").select(*signals.columns, "executed", "of.island", "of.ends")


def ledger_trades(signals: DataFrame, capital: float = 10_000.0, costs: Costs = Costs(), keys: list[str] | None = None, risk: float | None = None, days: int = blocks.DAYS) -> DataFrame:
    """Trades with stops, of rows `pair, strategy_id, ts, high, low, close, signal, sl_pct, tp_pct, phase`; `keys` may be more.

    With `risk` a trade's size follows from `atr` and `stop_atr_mult`, which the rows then have too; without, from the signal.
    `capital_before` is what there is after the entry's cost, `pnl` what the trade adds to it, `units` its size in units.
    Islands are folded in order, all in parallel. Capital is a product over the trades before.
    """
    keys = keys or ["pair", "strategy_id"]
    types = dict(signals.dtypes)
    if "atr" not in types:
        signals = signals.withColumns({"atr": F.lit(0.0), "stop_atr_mult": F.lit(0.0)})
    needed = ["ts", "high", "low", "close", "signal", "sl_pct", "tp_pct", "phase", "atr", "stop_atr_mult"]
    split = in_islands(signals.select(*keys, *needed), keys, days)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), f"island {dict(split.dtypes)['island']}", TRADE_SCHEMA])
    trades = fold_sorted(split, [*keys, "island"], ["ts", "ends"], lambda key: Ledger(capital, costs, risk), schema)
    w = Window.partitionBy(*keys).orderBy("entry_date")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    parts = trades.select("*", *blocks.factor_parts(F.col("entry_factor") * F.col("exit_factor"), "__"))
    product = blocks.product_of(*[F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)) for c in ("log", "negative", "zero")])
    there = parts.withColumn("capital_before", F.lit(capital) * product * F.col("entry_factor")).drop("__log", "__negative", "__zero")
    units = F.lit(capital) * F.col("size") if risk is None else F.when(F.col("stop_distance") > 0, F.col("capital_before") * risk / F.col("stop_distance")).otherwise(0.0)
    return there.withColumn("pnl", F.col("capital_before") * (F.col("exit_factor") - 1)).withColumn("units", units).drop("island")


def equity_curve(bars: DataFrame, trades: DataFrame, keys: list[str] | None = None, capital: float = 10_000.0, days: int = blocks.DAYS) -> DataFrame:
    """`keys, ts, equity`: the capital after each bar; the last has what was closed at the end."""
    keys = keys or ["pair", "strategy_id"]
    events = trades.select(*keys, F.col("entry_date").alias("ts"), F.col("entry_factor").alias("factor")).unionByName(trades.select(*keys, F.col("exit_date").alias("ts"), F.col("exit_factor").alias("factor")))
    names = ["log", "negative", "zero"]
    at = events.select(*keys, "ts", *blocks.factor_parts(F.col("factor"))).groupBy(*keys, "ts").agg(*[F.sum(c).alias(c) for c in names])
    rows = blocks.met(blocks.in_blocks_of(bars.select(*keys, "ts"), days=days), at, [*keys, "ts"], names).fillna(0, names)
    summed = blocks.running_sums(rows, keys, names)
    return summed.select(*keys, "ts", (F.lit(capital) * blocks.product_of(*map(F.col, names))).alias("equity"))
