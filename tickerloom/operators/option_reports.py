"""Strategy rows built from ranked option ideas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import rnd, rnd_stable

MOVE_POINTS = 50.0
PROFIT_CAP_PCT = 250.0
MIN_CONFIDENCE = 35.0
MAX_PRICE = 35.0
MIN_PROFIT_PCT = 10.0


def strategy_name(action: Column, label: Column) -> Column:
    """Structure named by the label, else by the action."""
    low = F.lower(F.coalesce(label, F.lit("")))

    def has(*parts: str) -> Column:
        out = F.lit(False)
        for p in parts:
            out = out | F.contains(low, F.lit(p))
        return out

    return (
        F.when(has("iron condor"), "Iron Condor (defined-risk range)")
        .when(has("bull put", "put credit"), "Bull Put Credit Spread")
        .when(has("bear call", "call credit"), "Bear Call Credit Spread")
        .when(has("bull call", "call debit"), "Bull Call Debit Spread")
        .when(has("bear put", "put debit"), "Bear Put Debit Spread")
        .when(action == "BUY CALL", "Long Call")
        .when(action == "BUY PUT", "Long Put")
        .otherwise("No directional edge")
    )


def option_exit(price: Column, delta: Column, current: Column, target: Column) -> Column:
    """Premium after the underlying's move, by delta; a quarter more when unknown."""
    known = (F.coalesce(delta, F.lit(0.0)) != 0) & current.isNotNull() & target.isNotNull()
    return F.when(known, price + F.abs(delta) * F.abs(target - current)).otherwise(price * 1.25)


def profit_potential(entry: Column, exit_: Column, multiplier: Column) -> tuple[Column, Column, Column]:
    """(points, percent, per contract) of a premium move; NULL without an entry."""
    gain = F.when(entry > 0, exit_ - entry)
    return gain, F.try_divide(gain, entry) * 100, gain * multiplier


def add_index_strategies(rows: DataFrame, max_price: float = MAX_PRICE, min_profit: float = MIN_PROFIT_PCT) -> DataFrame:
    """Score and gate of each index-option idea under the premium limit.

    Reads ticker, action, option_direction, strategy_label, premium, delta, volume,
    confidence, current_price, target_price, expected_points and momentum.
    """
    df = rows.where((F.col("premium") > 0) & (F.col("premium") < max_price))
    premium, current, target = F.col("premium"), F.col("current_price"), F.col("target_price")
    raw = option_exit(premium, F.col("delta"), current, target)
    df = df.withColumn("est_exit", F.least(raw, premium * (1.0 + PROFIT_CAP_PCT / 100.0)))
    points, pct, dollars = profit_potential(premium, F.col("est_exit"), F.lit(100))
    move = F.coalesce(F.col("expected_points"), target - current, F.lit(0.0))
    momentum = F.coalesce(F.nullif(F.col("momentum"), F.lit(0.0)), F.lit(50.0))
    d = F.col("option_direction")
    aligned = F.when(d == "up", momentum).when(d == "down", 100 - momentum).otherwise(50.0)
    conf, volume = F.coalesce(F.col("confidence"), F.lit(0.0)), F.coalesce(F.col("volume"), F.lit(0))
    idle = (F.col("action") == "NO TRADE") | (d == "neutral")
    df = df.withColumn("profit_exact", pct).withColumn("move_ok", F.abs(move) >= MOVE_POINTS)
    df = df.withColumn("profit_ok", F.col("profit_exact") >= min_profit)
    move_ok, profit_ok = F.col("move_ok"), F.col("profit_ok")
    both = move_ok & profit_ok
    df = df.withColumn("actionable", both & ~idle & (conf >= MIN_CONFIDENCE))
    status = (
        F.when(idle, "no_directional_edge")
        .when(F.col("actionable"), "actionable")
        .when(both, "low_confidence")
        .when(profit_ok, "needs_index_points")
        .when(move_ok, "low_option_profit")
        .otherwise("watch")
    )
    price_score = F.greatest(F.lit(0.0), (max_price - premium) / max_price) * 100.0
    volume_score = F.least(F.lit(100.0), volume / 1000.0 * 100.0)
    select = rnd_stable(0.34 * conf + 0.24 * price_score + 0.24 * volume_score + 0.18 * aligned, 1)
    return (
        df.withColumn("status", status)
        .withColumn("select_score", select)
        .withColumn("strategy", strategy_name(F.col("action"), F.col("strategy_label")))
        .withColumn("profit_pct", rnd_stable(F.col("profit_exact"), 1))
        .withColumn("profit_capped", F.col("profit_exact") >= PROFIT_CAP_PCT - 0.01)
        .withColumn("profit_per_contract", rnd_stable(dollars, 0))
        .withColumn("est_exit", rnd_stable(F.col("est_exit"), 2))
        .drop("profit_exact")
    )


def top_strategies(rows: DataFrame, per_index: int = 3) -> DataFrame:
    """Best rows per index, actionable ones first, then by score."""
    w = Window.partitionBy("ticker").orderBy(F.desc("actionable"), F.desc("select_score"), "contract")
    best = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_index)
    return best.orderBy(F.desc("actionable"), F.desc("select_score"), "ticker", "rank")


def gate_or_readiness() -> Column:
    return F.lower(F.coalesce(F.nullif(F.col("risk_gate"), F.lit("")), F.col("readiness"), F.lit("")))


def tradeable_expiries(rows: DataFrame, min_dte: int = 5, max_price: float = MAX_PRICE, n: int = 3) -> DataFrame:
    """Quoted, affordable, directional expiries of each index name, best first."""
    price = F.col("reference_price")
    kept = rows.where(
        F.col("is_index")
        & (F.coalesce(F.col("dte"), F.lit(0)) >= min_dte)
        & (F.coalesce(F.col("action"), F.lit("")) != "NO TRADE")
        & (price > 0)
        & (price <= max_price)
    )
    spread = F.coalesce(F.nullif(F.col("spread_pct"), F.lit(0.0)), F.lit(99.0))
    gate = gate_or_readiness()
    gate_bonus = F.when(gate == "high", 20).when(gate == "spread only", 10).when(gate == "watch", 4).when(gate == "paper only", -8).otherwise(0)
    spread_bonus = F.when(spread <= 8, 12).when(spread <= 12, 6).otherwise(-8)
    merit = F.coalesce(F.col("confidence"), F.lit(0.0)) + gate_bonus + spread_bonus + 10
    kept = kept.withColumn("merit", rnd(merit, 6))
    w = Window.partitionBy("ticker").orderBy(
        F.desc("merit"), F.desc(F.coalesce(F.col("option_quality"), F.lit(0.0))), spread, price, "contract"
    )
    return kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def signal_side(direction: Column, action: Column) -> Column:
    words = F.lower(F.concat_ws(" ", direction, action))
    short = F.lit(False)
    for w in ("bearish", "short", "put", "sell"):
        short = short | F.contains(words, F.lit(w))
    return F.when(short, "short").otherwise("long")


def strategy_sort_score() -> Column:
    """Soft rank of a call together with its best tradeable expiry.

    Reads confidence, opportunity_score, risk_score, direction, block_trade, contract
    (NULL without an expiry), risk_gate, readiness, action and spread_pct.
    """
    has = F.col("contract").isNotNull()
    d, gate = F.col("direction"), gate_or_readiness()
    action = F.lower(F.coalesce("action", "research_action", F.lit("")))
    sided = F.lit(False)
    for w in ("call", "put", "long", "short", "buy", "sell"):
        sided = sided | F.contains(action, F.lit(w))
    spread = F.when(has, F.coalesce(F.col("spread_pct"), F.lit(99.0))).otherwise(99.0)
    return (
        F.col("confidence") * 0.45
        + F.col("opportunity_score") * 0.25
        - F.col("risk_score") * 0.22
        + F.when(~d.isin("neutral", "avoid"), 10.0).otherwise(0.0)
        + F.when(has, 12.0).otherwise(0.0)
        + F.when(gate == "high", 22.0).when(gate == "spread only", 12.0).when(gate == "paper only", -8.0).otherwise(0.0)
        + F.when(sided, 8.0).otherwise(0.0)
        + F.when(F.col("block_trade") | (d == "avoid"), -40.0).otherwise(0.0)
        + F.when(spread <= 8, 5.0).when(spread > 20, -8.0).otherwise(0.0)
    )


def side_forecast(side: Column, ret: Column, prob_up: Column) -> tuple[Column, Column]:
    """(return, probability in percent) aligned with the side."""
    short = side == "short"
    aligned = F.when(short & (ret > 0), -ret).otherwise(ret)
    return aligned, F.when(short, (1 - prob_up) * 100).otherwise(prob_up * 100)


def daily_move_pct(expected_move: Column, realized_vol: Column) -> Column:
    """Typical one-day move from the five-day band, else from yearly volatility."""
    floor = F.lit(0.3)
    return F.when(expected_move > 0, F.greatest(floor, expected_move / (5**0.5))).when(
        F.coalesce(realized_vol, F.lit(0.0)) != 0, F.greatest(floor, realized_vol / (252**0.5))
    )


def target_days(dte: Column, ret: Column, daily: Column, forecast_days: Column) -> Column:
    """Days until the target: the contract's DTE, else the move at its daily pace."""
    pace = rnd(F.try_divide(F.abs(ret), daily), 0).cast("int")
    base = F.greatest(F.lit(1), forecast_days)
    by_pace = F.when((daily > 0) & (pace >= 1), F.least(F.lit(20), pace)).otherwise(base)
    return F.when(dte >= 1, F.least(dte, F.lit(45))).otherwise(by_pace)


def add_trade_plan(df: DataFrame, min_profit_pct: float = 5.0) -> DataFrame:
    """Action class, premium exit and stop of one call with its best expiry.

    Reads direction, research_action, block_trade, confidence, current_price,
    target_price, stop_price, p05, contract, action, reference_price, delta,
    risk_gate and readiness.
    """
    act = F.coalesce("action", "research_action", F.lit("watch_only"))
    df = df.withColumn("side", signal_side(F.col("direction"), act))
    side, current, target = F.col("side"), F.col("current_price"), F.col("target_price")
    downside = F.when(F.col("p05").isNotNull(), F.abs("p05") / 100 * 0.75).otherwise(0.045)
    band = F.least(F.greatest(downside, F.lit(0.035)), F.lit(0.095))
    stop = F.coalesce("stop_price", F.when(side == "short", current * (1 + band)).otherwise(current * (1 - band)))
    price = F.col("reference_price")
    known = F.col("delta").isNotNull() & current.isNotNull() & target.isNotNull()
    exit_ = F.when(known, price + F.abs("delta") * F.abs(target - current)).otherwise(price * 1.25)
    gate = F.coalesce(F.nullif(F.col("risk_gate"), F.lit("")), F.col("readiness"), F.lit("watch"))
    cls = (
        F.when(F.col("block_trade") | F.col("direction").isin("neutral", "avoid"), "wait")
        .when((gate == "high") & (F.col("confidence") >= 55), "tradeable research")
        .when(gate == "spread only", "defined-risk spread")
        .otherwise("paper/watch")
    )
    df = df.withColumn("plan_stop", stop).withColumn("option_exit", exit_).withColumn("option_stop", price * 0.65)
    points, pct, dollars = profit_potential(price, F.col("option_exit"), F.lit(100))
    low = F.col("contract").isNotNull() & ~F.coalesce(pct >= min_profit_pct, F.lit(False))
    demoted = F.when(low & cls.isin("tradeable research", "defined-risk spread"), "paper/watch").otherwise(cls)
    return (
        df.withColumn("strategy_action", demoted)
        .withColumn("stop_pct", F.coalesce(F.abs(F.try_divide(current - F.col("plan_stop"), current)), F.lit(0.05)))
        .withColumn("profit_points", points)
        .withColumn("profit_pct", pct)
        .withColumn("profit_per_contract", dollars)
    )


def option_verdict(action: Column, gate: Column) -> Column:
    g = F.lower(F.coalesce(gate, F.lit("")))
    return (
        F.when(action == "NO TRADE", "NO TRADE")
        .when(g == "high", "TRADEABLE")
        .when(g == "spread only", "TRADE AS A SPREAD")
        .when(g == "paper only", "PAPER ONLY")
        .otherwise("WATCH")
    )


def bull_bear_verdict(status: Column, label: Column) -> Column:
    strength = F.when(F.contains(label, F.lit("strong")), "strong").otherwise("moderate")
    side = F.when(F.contains(label, F.lit("bull")), "BULLISH").otherwise("BEARISH")
    return (
        F.when(status == "VALID_RESEARCH_CANDIDATE", F.concat(side, F.lit(" / "), strength))
        .when(status == "WATCHLIST", "WATCHLIST")
        .when(status == "REJECTED", "REJECTED")
        .otherwise("NO TRADE")
    )
