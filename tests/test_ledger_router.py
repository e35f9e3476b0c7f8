"""Ledger and router against loops written from their rules, over long keys cut into many blocks."""

import datetime as dt
import math
import random

import pytest

from tidemark.operators import ledger as L
from tidemark.operators import router as R

DAY = dt.date(2001, 1, 1)
KEYS = [("AB", "s"), ("AB", "t"), ("CD", "s"), ("EF", "one"), (None, "s")]


def walk(rng, n, calm=False):
    close, out, signal = 100.0, [], 0
    for k in range(n):
        close *= 1 + rng.uniform(-0.03, 0.03)
        signal = signal if calm and rng.random() < 0.99 else rng.choice([-1, 0, 1, 1, 0.5, -2])
        out.append({
            "ts": DAY + dt.timedelta(k + k // 300 * 40), "high": close * 1.02, "low": close * 0.98, "close": close, "signal": float(signal), "sl_pct": rng.choice([0.0, 0.03, 0.05]), "tp_pct": rng.choice([0.0, 0.04]),
            "phase": rng.choice("xy"), "atr": rng.choice([0.0, 1.0, 2.5]), "stop_atr_mult": 2.0,
        })
    return out


@pytest.fixture(scope="module")
def bars():
    rng = random.Random(4)
    return {key: walk(rng, 1 if key[1] == "one" else 900, calm=key[1] == "t") for key in KEYS}


def loop_ledger(rows, capital, costs, risk):
    """One bar after the other, with the capital as it is."""
    first, trades, equity, held, signal = capital, [], [], None, 0.0
    cost = lambda price: (0.5 * costs.spread_pips + costs.slippage_pips) * costs.pip / price + 0.5 * costs.commission / first

    def close(bar, price, reason):
        nonlocal capital, held
        move = (price - held["price"]) * held["side"]
        pct = move / held["price"] - cost(price)
        pnl = capital * pct * held["size"] if risk is None else held["units"] * (move - held["price"] * cost(price))
        capital += pnl
        trades.append((held["ts"], bar["ts"], held["side"], held["price"], price, held["size"], pct, reason, held["phase"], pnl, held["units"]))
        held = None

    for bar in rows:
        wanted, signal = signal, bar["signal"]
        stopped = False
        if held:
            long = held["side"] > 0
            if held["sl"] > 0 and (bar["low"] <= held["stop"] if long else bar["high"] >= held["stop"]):
                close(bar, held["stop"], "stop_loss")
                stopped = True
            elif held["tp"] > 0 and (bar["high"] >= held["goal"] if long else bar["low"] <= held["goal"]):
                close(bar, held["goal"], "take_profit")
                stopped = True
        if held and not stopped and (wanted == 0 or (wanted > 0) != (held["side"] > 0)):
            close(bar, bar["close"], "signal")
        if not held and wanted != 0:
            capital -= capital * cost(bar["close"])
            side, distance = (1 if wanted > 0 else -1), bar["atr"] * bar["stop_atr_mult"]
            units = first * abs(wanted) if risk is None else (capital * risk / distance if distance > 0 else 0.0)
            held = {"ts": bar["ts"], "side": side, "price": bar["close"], "size": abs(wanted), "phase": bar["phase"], "sl": bar["sl_pct"], "tp": bar["tp_pct"], "units": units,
                    "stop": bar["close"] * (1 - side * bar["sl_pct"]), "goal": bar["close"] * (1 + side * bar["tp_pct"])}
        equity.append(capital)
    if held:
        close(rows[-1], rows[-1]["close"], "end")
        equity[-1] = capital
    return trades, equity


@pytest.mark.parametrize(("costs", "risk", "days"), [(L.Costs(), None, 365), (L.Costs(2.0, 1.0, 3.0, 0.01), None, 30), (L.Costs(2.0, 1.0, 3.0, 0.01), 0.02, 100), (L.Costs(40.0, 90.0, 0.0, 1.0), 3.0, 7)])
def test_ledger_equals_the_loop(spark, bars, costs, risk, days):
    df = spark.createDataFrame([{"pair": p, "strategy_id": s, **r} for (p, s), made in bars.items() for r in made]).orderBy("close").cache()
    trades = L.ledger_trades(df, 10_000.0, costs, None, risk, days).cache()
    equity = {(r["pair"], r["strategy_id"], r["ts"]): r["equity"] for r in L.equity_curve(df, trades, None, 10_000.0, days).collect()}
    got = {}
    for r in trades.collect():
        got.setdefault((r["pair"], r["strategy_id"]), []).append(r)
    for key, rows in bars.items():
        want, curve = loop_ledger(rows, 10_000.0, costs, risk)
        mine = sorted(got.get(key, []), key=lambda r: r["entry_date"])
        assert [(r["entry_date"], r["exit_date"], r["direction"], r["entry_price"], r["exit_price"], r["size"], r["exit_reason"], r["phase"]) for r in mine] == [(*w[:6], w[7], w[8]) for w in want]
        assert [x for r in mine for x in (r["pnl_pct"], r["units"])] == pytest.approx([x for w in want for x in (w[6], w[10])], rel=1e-6, abs=1e-12)
        assert [r["pnl"] for r in mine] == pytest.approx([w[9] for w in want], rel=1e-6, abs=1e-9)
        assert [equity[(*key, r["ts"])] for r in rows] == pytest.approx(curve, rel=1e-6, abs=1e-9)
    assert len(got["AB", "s"]) > 200 and min(len(g) for g in got.values()) > 3


def loop_router(rows, enter, leave, margin, min_hold, max_hold, hysteresis, guard):
    """The survey's rules, with an unbounded counter and the position of the bar before."""
    kind, since, before, out = "phase", 0, None, []
    for r in rows:
        p = {"MeanReversion": r["p_reversion"], "TrendFollowing": r["p_trend"]}
        if r["p_phase"] is not None:
            p["PhaseAware"] = r["p_phase"]
        names = {"MeanReversion": "reversion", "TrendFollowing": "trend", "PhaseAware": "phase"}
        if r["p_trend"] is None:
            top, first, second = None, -1, -1
        else:
            ranked = sorted(p.items(), key=lambda kv: (-kv[1], kv[0]))
            top, first, second = names[ranked[0][0]], ranked[0][1], ranked[1][1]
        confident = top is not None and first >= enter and (margin is None or first - second >= margin)
        proposed = kind
        if not hysteresis:
            proposed = top if confident else "phase"
        elif kind == "phase":
            proposed = top if confident else kind
        elif top is None or first < leave:
            proposed = "phase"
        elif top != kind and confident:
            proposed = top
        if guard and r["spike"]:
            if r["usd_quote"]:
                proposed = "trend"
            elif guard == "phase" or proposed == "reversion":
                proposed = "phase"
        then = kind if min_hold is not None and proposed != kind and proposed != "phase" and since < min_hold else proposed
        flat = before is None or before == 0
        if max_hold is not None and kind != "phase" and since >= max_hold and flat:
            then = "phase"
        changed = then != kind
        kind, since = then, 0 if changed else since + 1
        side = "trend" if kind == "trend" or (kind == "phase" and r["trending"]) else "reversion"
        before = r[f"{side}_signal"]
        out.append((r["ts"], kind, changed, float(before), r[f"{side}_sl"], r[f"{side}_tp"]))
    return out


def test_router_equals_the_loop(spark):
    rng = random.Random(9)
    rows = {}
    for key in ("AB", "CD", "EF"):
        made, p = [], 0.5
        for k in range(700):
            p = min(max(p + rng.uniform(-0.3, 0.3), 0.0), 1.0)
            third = rng.choice([None, rng.random() * 0.6])
            made.append({
                "pair": key, "ts": DAY + dt.timedelta(k), "p_trend": None if rng.random() < 0.03 else round(p, 1), "p_reversion": float(round(1 - p, 1)), "p_phase": third, "spike": rng.random() < 0.1, "usd_quote": key == "AB", "trending": rng.random() < 0.5,
                "trend_signal": rng.choice([0, 0, 1, -1]), "reversion_signal": rng.choice([0, 0, 0, 1]), "trend_sl": 0.03, "trend_tp": 0.06, "reversion_sl": rng.random(), "reversion_tp": 0.0,
            })
        rows[key] = made
    names = ["enter", "leave", "margin", "min_hold", "max_hold", "hysteresis", "guard"]
    sets = {"a": (0.55, 0.5, 0.15, 5, 20, True, "no_reversion"), "b": (0.7, 0.6, None, None, 3, True, None), "c": (0.5, 0.4, 0.1, 2, None, False, "phase"), "d": (0.6, 0.3, 0.2, 9, 4, True, "phase"), "e": (0.5, 0.3, 0.0, None, None, True, "no_reversion")}
    policies = {k: R.Policy(**dict(zip(names, v, strict=True))) for k, v in sets.items()}
    schema = "pair string, ts date, p_trend double, p_reversion double, p_phase double, spike boolean, usd_quote boolean, trending boolean, trend_signal int, reversion_signal int, trend_sl double, trend_tp double, reversion_sl double, reversion_tp double"
    df = spark.createDataFrame([tuple(r.values()) for made in rows.values() for r in made], schema).repartition(5)
    for days in (30, 3, 5000):
        got = {}
        for r in R.route(df, policies, days=days).collect():
            got.setdefault((r["pair"], r["policy"]), []).append((r["ts"], r["selected"], r["switched"], r["signal"], r["sl_pct"], r["tp_pct"]))
        for key, made in rows.items():
            for name, v in sets.items():
                assert sorted(got[key, name]) == loop_router(made, *v), (key, name, days)
    assert {x[1] for g in got.values() for x in g} == {"phase", "trend", "reversion"}


def test_router_says_which_rule_overruled(spark):
    base = {"usd_quote": False, "trending": True, "trend_signal": 1, "reversion_signal": 0, "p_phase": None, "trend_sl": 0.0, "trend_tp": 0.0, "reversion_sl": 0.0, "reversion_tp": 0.0}
    policy, state, rules = R.Policy(min_hold=2, max_hold=4), R.START, []
    for trend, spike in ((0.9, False), (0.9, False), (0.1, False), (0.9, False), (0.1, False), (0.1, True), (0.1, False)):
        r = base | {"p_trend": trend, "p_reversion": 1 - trend, "spike": spike}
        state, rule, *_ = R.follow(policy, state, r, R.best_of(r))
        rules.append((state[0], rule))
    assert rules[:3] == [("phase", "min_hold"), ("phase", "min_hold"), ("reversion", "")] and ("phase", "spike") in rules
    assert math.isclose(R.Policy().margin, 0.15)
