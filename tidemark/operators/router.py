"""A router between trend, reversion and what the phase asks for, with hysteresis, holding times and a volatility override.

What a bar does depends on the type in force, how long it has been (up to a bound), and whether the bar before gave a
signal: a finite machine. So a block of bars is a map from the state before it to the state after it, whatever came
before. All blocks make their maps in parallel, the maps of a key are applied one after the other, a row for each block, and then
all blocks run in parallel from the state they start in.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import blocks
from tidemark.operators.folding import fold_sorted
from tidemark.storage import materialise

PHASE, TREND, REVERSION = "phase", "trend", "reversion"
TYPES = (PHASE, TREND, REVERSION)
#: Of equal probabilities the first by the class's full name: MeanReversion, PhaseAware, TrendFollowing.
_ORDER = {REVERSION: 0, PHASE: 1, TREND: 2}


@dataclass(frozen=True)
class Policy:
    """Thresholds of the router. `margin`, `min_hold` and `max_hold` None switch these rules off; `guard` says what a volatile
    bar does where USD is not the quote: `no_reversion`, `phase`, or None."""

    enter: float = 0.55
    leave: float = 0.50
    margin: float | None = 0.15
    min_hold: int | None = 5
    max_hold: int | None = 20
    hysteresis: bool = True
    guard: str | None = "no_reversion"

    @property
    def most(self) -> int:
        """Holding times beyond this are all alike."""
        return max(self.min_hold or 0, self.max_hold or 0)

    def states(self) -> list[tuple[str, int, bool]]:
        """Type, bars held, whether the bar before gave no signal."""
        return [(t, k, flat) for t in TYPES for k in range(self.most + 1) for flat in (True, False)]


START = (PHASE, 0, True)


def best_of(r: dict) -> tuple[str | None, float, float]:
    """The likeliest type, its probability and the runner-up's; nothing where a probability is missing."""
    p = {TREND: r["p_trend"], REVERSION: r["p_reversion"]}
    if any(v is None or math.isnan(v) for v in p.values()):
        return None, -1.0, -1.0
    if r.get("p_phase") is not None and not math.isnan(r["p_phase"]):
        p[PHASE] = r["p_phase"]
    ranked = sorted(p, key=lambda t: (-p[t], _ORDER[t]))
    return ranked[0], p[ranked[0]], p[ranked[1]]


def follow(policy: Policy, state: tuple[str, int, bool], r: dict, best: tuple) -> tuple[tuple[str, int, bool], str, float, float, float]:
    """The state after a bar, the rule that overruled the probabilities (or none), signal, stop and target."""
    now, held, flat = state
    kind, p, second = best
    sure = kind is not None and p >= policy.enter and (policy.margin is None or p - second >= policy.margin)
    if now == PHASE or not policy.hysteresis:
        wanted = kind if sure else PHASE
    elif kind is None or p < policy.leave:
        wanted = PHASE
    else:
        wanted = kind if sure else now
    rule = ""
    if policy.guard is not None and r["spike"]:
        asked = TREND if r["usd_quote"] else PHASE if policy.guard == "phase" or wanted == REVERSION else wanted
        rule, wanted = ("spike" if asked != wanted else ""), asked
    if policy.min_hold is not None and wanted not in (now, PHASE) and held < policy.min_hold:
        rule, wanted = "min_hold", now
    if policy.max_hold is not None and now != PHASE and held >= policy.max_hold and flat:
        rule, wanted = ("max_hold" if wanted != PHASE else rule), PHASE
    held = 0 if wanted != now else min(held + 1, policy.most)
    side = TREND if wanted == TREND or (wanted == PHASE and r["trending"]) else REVERSION
    signal = float(r[f"{side}_signal"] or 0)
    return (wanted, held, signal == 0), rule, signal, float(r[f"{side}_sl"] or 0), float(r[f"{side}_tp"] or 0)


class BlockMap:
    """Where each state leads over a block; states that have met go on together."""

    def __init__(self, policy: Policy):
        self.policy = policy
        self.now = policy.states()
        self.at = list(range(len(self.now)))

    def step(self, r: dict) -> list[tuple]:
        """Nothing until the block ends."""
        best, place = best_of(r), {}
        moved = [place.setdefault(follow(self.policy, s, r, best)[0], len(place)) for s in self.now]
        if len(place) < len(moved):
            self.at = [moved[k] for k in self.at]
        self.now = list(place)
        return []

    def finish(self) -> list[tuple]:
        """For each state the number of the one after the block."""
        number = {s: k for k, s in enumerate(self.policy.states())}
        return [([number[self.now[k]] for k in self.at],)]


class Compose:
    """The state before each block of a key."""

    def __init__(self, policy: Policy):
        self.state = policy.states().index(START)

    def step(self, r: dict) -> list[tuple]:
        """The block and its first state."""
        out = [(r["block"], self.state)]
        self.state = int(r["ends"][self.state])
        return out

    def finish(self) -> list[tuple]:
        """Nothing is left over."""
        return []


class Router:
    """A block from the state that its rows name as `start`."""

    def __init__(self, policy: Policy):
        self.policy, self.state = policy, None

    def step(self, r: dict) -> list[tuple]:
        """The bar's time, the type in force, whether it changed, bars held, the rule that overruled, signal, stop, target."""
        if self.state is None:
            self.state = self.policy.states()[int(r["start"])]
        before, (self.state, rule, signal, sl, tp) = self.state, follow(self.policy, self.state, r, best_of(r))
        return [(r["ts"], self.state[0], self.state[0] != before[0], self.state[1], rule, signal, sl, tp)]

    def finish(self) -> list[tuple]:
        """Nothing is left over."""
        return []


ROUTED = "ts date, selected string, switched boolean, held int, rule string, signal double, sl_pct double, tp_pct double"
#: What a row needs besides keys and `ts`, and what stands in for what it may lack.
_NEEDED = {
    "p_trend": None, "p_reversion": None, "p_phase": F.lit, "spike": None, "usd_quote": None, "trending": None, "trend_signal": None, "reversion_signal": None,
    "trend_sl": F.lit, "trend_tp": F.lit, "reversion_sl": F.lit, "reversion_tp": F.lit,
}


def route(rows: DataFrame, policies: dict[str, Policy], keys: list[str] | None = None, days: int = blocks.DAYS) -> DataFrame:
    """Each key (pair; pair and fold) under each policy: the policy is part of the key, so a sweep adds keys, not jobs.

    `held` counts the bars in the present state, up to the policy's longest holding time. Rows may lack `p_phase` (no such class),
    stops and targets (none).
    """
    keys = [*(keys or ["pair"]), "policy"]
    swept = rows.withColumn("policy", F.explode(F.array(*[F.lit(p) for p in policies])))
    lacking = {c: (F.lit(None).cast("double") if c == "p_phase" else F.lit(0.0)) for c in _NEEDED if c not in rows.columns}
    swept = materialise(blocks.in_blocks_of(swept.withColumns(lacking) if lacking else swept, days=days).select(*keys, "block", "ts", *_NEEDED))
    types = dict(swept.dtypes)
    named = ", ".join(f"{k} {types[k]}" for k in keys)
    of = lambda key: policies[key[len(keys) - 1]]
    maps = fold_sorted(swept, [*keys, "block"], ["ts"], lambda key: BlockMap(of(key)), f"{named}, block long, ends array<int>")
    starts = fold_sorted(maps, keys, ["block"], lambda key: Compose(of(key)), f"{named}, block long, start int")
    begun = blocks.met(swept, starts, [*keys, "block"], ["start"], "inner")
    return fold_sorted(begun, [*keys, "block"], ["ts"], lambda key: Router(of(key)), f"{named}, block long, {ROUTED}").drop("block")
