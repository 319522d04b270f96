"""Option-chain analytics: expiry metrics, volatility structure, risk and ranking.

A chain is one flat table of contracts.  Everything per expiry comes from a single
grouped aggregate; the at-the-money contract is a minimum over an ordered struct, so
it combines map-side and never gathers a chain in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import bearish, bullish, clamp, lines, norm_cdf, norm_pdf, rnd, rnd_stable

RATE = 0.045
MIN_DTE = 5
QUOTE = ("contract", "strike", "last", "bid", "ask", "volume", "oi", "iv")


# --------------------------------------------------------------------------- sources
def parse_occ(contract: Column) -> dict[str, Column]:
    """Expiry, right and strike from the last 15 characters of a contract symbol."""
    symbol = F.upper(F.trim(contract))
    tail = F.substring(symbol, -15, 15)
    long_enough = F.length(symbol) >= 15
    strike = F.substring(tail, 8, 8).try_cast("long") / 1000.0
    right = F.substring(tail, 7, 1)
    day = F.concat_ws("-", F.concat(F.lit("20"), F.substring(tail, 1, 2)), F.substring(tail, 3, 2), F.substring(tail, 5, 2))
    known = long_enough & strike.isNotNull()
    return {
        "option_expiration": F.when(known, day),
        "option_type": F.when(known, F.when(right == "C", "call").when(right == "P", "put").otherwise("")),
        "option_strike": F.when(known, strike),
    }


def contract_right(contract: Column, fallback: Column) -> Column:
    """call or put from the symbol, else the source's own word."""
    symbol = F.upper(F.trim(F.coalesce(contract, F.lit(""))))
    mark = F.when(F.length(symbol) >= 15, F.substring(symbol, -9, 1))
    return F.when(mark == "C", "call").when(mark == "P", "put").otherwise(F.lower(F.trim(F.coalesce(fallback, F.lit("")))))


def select_expiries(expiries: DataFrame, n: int = 5, min_days: int = MIN_DTE, max_days: int = 60) -> DataFrame:
    """Up to n expiries inside the window, else the next ones; never below the minimum."""
    by_dte = Window.partitionBy("ticker").orderBy("dte")
    fair = expiries.where(F.col("dte") >= min_days)
    inside = F.col("dte") <= max_days
    fair = fair.withColumn("_any", F.max(inside.cast("int")).over(Window.partitionBy("ticker")))
    kept = fair.where(inside | (F.col("_any") == 0))
    return kept.withColumn("rank", F.dense_rank().over(by_dte)).where(F.col("rank") <= n).drop("_any")


def chain_with_fallback(chain: DataFrame, priority: dict[str, int]) -> DataFrame:
    """Contracts of each ticker's first source that has any, by a choice on counts."""
    place = F.lit(None).cast("int")
    for name, p in priority.items():
        place = F.when(F.col("source") == name, p).otherwise(place)
    found = chain.groupBy("ticker", "source").agg(F.count(F.lit(1)).alias("_rows")).withColumn("_place", place)
    chosen = found.where(F.col("_place").isNotNull()).groupBy("ticker").agg(F.min_by("source", "_place").alias("source"))
    return chain.join(chosen, ["ticker", "source"], "left_semi")


def option_mark(bid: Column, ask: Column, last: Column) -> Column:
    """Middle of the quote when both sides exist, else the last trade."""
    both = (bid > 0) & (ask > 0)
    return F.when(both, rnd((bid + ask) / 2, 4)).when(last > 0, rnd(last, 4))


# --------------------------------------------------------------------------- expiry metrics
def expiry_metrics(chain: DataFrame, by: list[str]) -> DataFrame:
    """Totals, ratios and both at-the-money legs of every expiry."""
    call, put = F.col("right") == "C", F.col("right") == "P"
    zero = F.lit(0.0)

    def total(test: Column, column: str) -> Column:
        return F.coalesce(F.sum(F.when(test, F.coalesce(F.col(column), F.lit(0)))), F.lit(0))

    def nearest(test: Column) -> Column:
        quote = F.struct(F.abs(F.col("strike") - F.col("spot")).alias("gap"), "strike", "contract", "last", "bid", "ask", "volume", "oi", "iv")
        return F.min(F.when(test & (F.col("spot") != 0), quote))

    df = chain.groupBy(*by).agg(
        total(call, "volume").alias("call_volume"),
        total(put, "volume").alias("put_volume"),
        F.sum(F.coalesce("oi", F.lit(0))).alias("total_oi"),
        F.avg("iv").alias("_iv"),
        F.max("spot").alias("spot"),
        nearest(call).alias("_c"),
        nearest(put).alias("_p"),
    )
    both = F.col("_c").isNotNull() & F.col("_p").isNotNull()
    pcr = F.try_divide(F.col("put_volume"), F.col("call_volume"))
    df = df.withColumn("pcr_exact", pcr).withColumn("put_call_ratio", rnd_stable(pcr, 2))
    df = df.withColumn("avg_iv", rnd_stable(F.col("_iv") * 100, 1))
    df = df.withColumn("total_volume", F.col("call_volume") + F.col("put_volume"))
    df = df.withColumn("illiquid", F.col("total_oi") < 500)
    for side, leg in (("call", "_c"), ("put", "_p")):
        q = F.col(leg)
        df = (
            df.withColumn(f"atm_{side}", F.when(both, q["contract"].cast("string")))
            .withColumn(f"atm_{side}_last", F.when(both, rnd(F.coalesce(q["last"], zero), 4)))
            .withColumn(f"atm_{side}_bid", F.when(both, rnd(F.coalesce(q["bid"], zero), 4)))
            .withColumn(f"atm_{side}_ask", F.when(both, rnd(F.coalesce(q["ask"], zero), 4)))
            .withColumn(f"atm_{side}_volume", F.when(both, F.coalesce(q["volume"].cast("long"), F.lit(0))))
            .withColumn(f"atm_{side}_oi", F.when(both, F.coalesce(q["oi"].cast("long"), F.lit(0))))
            .withColumn(f"atm_{side}_iv", F.when(both, rnd_stable(F.coalesce(q["iv"], zero) * 100, 1)))
        )
    df = df.withColumn("atm_strike", F.when(both, F.nullif(rnd(F.col("_c")["strike"], 2), zero)))
    straddle = F.when(both, F.coalesce(F.col("_c")["last"], zero) + F.coalesce(F.col("_p")["last"], zero))
    move = F.when(straddle > 0, rnd_stable(F.try_divide(straddle, F.col("spot")) * 100, 1))
    return df.withColumn("expected_move_pct", move).drop("_iv", "_c", "_p")


def expected_move(straddle_pct: Column, history_pct: Column) -> tuple[Column, Column]:
    """(move, basis): the straddle when there is one, else historical volatility."""
    basis = F.when(straddle_pct.isNotNull(), "straddle").otherwise("history")
    return F.coalesce(straddle_pct, rnd_stable(history_pct, 1)), basis


def component_score() -> Column:
    """Positioning, volatility and liquidity of the nearest expiry."""
    pcr = F.col("pcr_exact")
    return clamp(
        50.0
        + F.when(pcr < 0.7, 8.0).when(pcr > 1.3, -8.0).otherwise(0.0)
        + F.when(F.col("avg_iv") > 80, -4.0).otherwise(0.0)
        + F.when(F.col("illiquid"), -6.0).otherwise(0.0)
    )


def add_term_structure(expiries: DataFrame, min_dte: int = MIN_DTE) -> DataFrame:
    """Volatility slope to the next expiry with a strictly larger DTE."""
    usable = (F.col("dte") >= min_dte) & F.col("avg_iv").isNotNull()
    later = Window.partitionBy("ticker").orderBy("dte").rangeBetween(1, Window.unboundedFollowing)
    point = F.when(usable, F.struct("avg_iv", "dte"))
    df = expiries.withColumn("_next", F.first(point, ignorenulls=True).over(later))
    df = df.withColumn("term_slope_pct", F.when(usable, rnd_stable(F.col("_next.avg_iv") - F.col("avg_iv"), 1)))
    slope = F.col("term_slope_pct")
    label = (
        F.when(~usable, "unknown")
        .when(slope.isNull(), "single_expiry")
        .when(slope >= 5, "contango_longer_expiry_richer")
        .when(slope <= -5, "backwardation_front_expiry_richer")
        .otherwise("flat")
    )
    return df.withColumn("term_label", label).withColumn("next_dte", F.when(usable, F.col("_next.dte"))).drop("_next")


def add_skew(df: DataFrame) -> DataFrame:
    skew = rnd_stable(F.col("atm_put_iv") - F.col("atm_call_iv"), 1)
    df = df.withColumn("atm_iv_skew_pct", skew)
    s = F.col("atm_iv_skew_pct")
    label = (
        F.when(s.isNull(), "unknown")
        .when(s >= 5, "puts_richer_bearish_hedging")
        .when(s <= -5, "calls_richer_bullish_demand")
        .otherwise("balanced_atm_iv")
    )
    return df.withColumn("skew_label", label)


def add_unusual_activity(df: DataFrame, volume: str, oi: str, previous_oi: str) -> DataFrame:
    """Volume against open interest, and its change since the last stored scan."""
    vol, open_, prev = F.coalesce(volume, F.lit(0)), F.coalesce(oi, F.lit(0)), F.col(previous_oi)
    ratio = F.when(open_ > 0, rnd_stable(F.try_divide(vol, open_), 2))
    chain_ratio = F.coalesce(F.try_divide(F.col("total_volume"), F.col("total_oi")), F.lit(0.0))
    df = df.withColumn("volume_oi_ratio", ratio).withColumn("oi_change", open_ - prev)
    df = df.withColumn("oi_change_pct", F.when(prev > 0, rnd_stable(F.try_divide(F.col("oi_change"), prev) * 100.0, 1)))
    pct = F.col("oi_change_pct")
    grown = F.least(F.lit(20.0), F.when(F.coalesce(pct, F.lit(0.0)) != 0, pct / 2.0).otherwise(5.0))
    score = (
        F.when(F.col("volume_oi_ratio").isNotNull(), F.least(F.lit(55.0), F.col("volume_oi_ratio") * 35.0)).otherwise(0.0)
        + F.least(F.lit(25.0), chain_ratio * 40.0)
        + F.when(F.col("oi_change") > 0, grown).otherwise(0.0)
    )
    df = df.withColumn("unusual_score", rnd_stable(F.least(F.lit(100.0), score), 1))
    u = F.col("unusual_score")
    label = (
        F.when(u >= 75, "very_unusual_chain_activity")
        .when(u >= 50, "unusual_chain_activity")
        .when(u >= 30, "elevated_chain_activity")
        .otherwise("normal")
    )
    return df.withColumn("unusual_label", label)


def dte_factor(dte: Column) -> Column:
    return (
        F.when(dte.between(7, 35), 1.0).when((dte >= 3) & (dte < 7), 0.85).when((dte > 35) & (dte <= 50), 0.85).when(dte < 3, 0.55).otherwise(0.7)
    )


def iv_factor(iv: Column) -> Column:
    return F.when(iv.isNull(), 0.65).when(iv <= 45, 0.95).when(iv <= 70, 0.85).when(iv <= 90, 0.65).otherwise(0.45)


def iv_risk(iv: Column) -> Column:
    return (
        F.when(iv.isNull(), "IV unavailable")
        .when(iv <= 45, "reasonable IV")
        .when(iv <= 70, "moderate IV")
        .when(iv <= 90, "elevated IV")
        .otherwise("very high IV")
    )


def spread_pct(bid: Column, ask: Column) -> Column:
    good = (bid > 0) & (ask > 0) & (ask >= bid)
    return F.when(good, rnd_stable(F.try_divide(ask - bid, (ask + bid) / 2.0) * 100.0, 1))


def spread_factor(pct: Column) -> Column:
    return F.when(pct.isNull(), 0.65).when(pct <= 8, 1.0).when(pct <= 15, 0.85).when(pct <= 25, 0.55).otherwise(0.30)


def flow_alignment(direction: Column, pcr: Column) -> tuple[Column, Column]:
    """(label, factor) of the put/call ratio against the side."""
    up, down = direction == "up", direction == "down"
    label = (
        F.when(pcr.isNull(), "unknown")
        .when(up & (pcr < 0.9), "supports_call")
        .when(up & (pcr > 1.3), "against_call")
        .when(down & (pcr > 1.1), "supports_put")
        .when(down & (pcr < 0.7), "against_put")
        .when(up | down, "mixed")
        .otherwise("neutral")
    )
    factor = (
        F.when(label == "unknown", 0.55)
        .when(label.isin("supports_call", "supports_put"), 1.0)
        .when(label.isin("against_call", "against_put"), 0.35)
        .when(label == "mixed", 0.65)
        .otherwise(0.45)
    )
    return label, factor


def add_greeks(df: DataFrame, spot: str, strike: str, premium: str, iv_pct: str, dte: str, right: str) -> DataFrame:
    """Delta, gamma, theta per day, vega per point and breakeven for every row."""
    s, k, sigma = F.col(spot), F.col(strike), F.col(iv_pct) / 100.0
    t = F.greatest(F.col(dte).cast("double"), F.lit(0.5)) / 365.0
    usable = (s > 0) & (k > 0) & (sigma > 0)
    root = sigma * F.sqrt(t)
    d1 = F.when(usable, F.try_divide(F.ln(F.try_divide(s, k)) + (RATE + 0.5 * sigma * sigma) * t, root))
    df = df.withColumn("_d1", d1).withColumn("_d2", F.col("_d1") - F.when(usable, root))
    one, two, put = F.col("_d1"), F.col("_d2"), F.col(right) == "put"
    pdf = norm_pdf(one)
    decay = -(s * pdf * sigma) / (2 * F.sqrt(t))
    carry = RATE * k * F.exp(-RATE * t)
    theta = F.when(put, decay + carry * norm_cdf(-two)).otherwise(decay - carry * norm_cdf(two)) / 365.0
    cost = F.coalesce(F.col(premium), F.lit(0.0))
    even = F.when(put, k - cost).otherwise(k + cost)
    known = one.isNotNull()
    return (
        df.withColumn("delta", F.when(known, rnd(F.when(put, norm_cdf(one) - 1.0).otherwise(norm_cdf(one)), 3)))
        .withColumn("gamma", rnd(F.try_divide(pdf, s * root), 5))
        .withColumn("theta_per_day", F.when(known, rnd(theta, 3)))
        .withColumn("vega_per_vol_point", F.when(known, rnd(s * pdf * F.sqrt(t) / 100.0, 3)))
        .withColumn("breakeven_price", F.when(known, rnd_stable(even, 2)))
        .withColumn("breakeven_pct", F.when(known, rnd_stable((F.try_divide(even, s) - 1.0) * 100.0, 2)))
        .drop("_d1", "_d2")
    )


# --------------------------------------------------------------------------- stored history
def latest_contracts(snapshots: DataFrame, tail: int | None = None) -> DataFrame:
    """Newest stored row per contract.

    `tail` first limits the log to its newest rows over all tickers, as a reader of
    a growing log file would; None reads the whole table.
    """
    df = snapshots
    if tail is not None:
        df = df.orderBy(F.desc("seq")).limit(tail)
    rest = [c for c in df.columns if c not in ("as_of", "seq")]
    df = df.where(F.coalesce("reference_contract", F.lit("")) != "").withColumn("contract", F.upper("reference_contract"))
    return df.groupBy("ticker", "contract").agg(F.max(F.struct("as_of", "seq", *[c for c in rest if c not in ("ticker", "contract")])).alias("_s")).select(
        "ticker", "contract", "_s.*"
    )


def join_previous_oi(expiries: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored open interest of both at-the-money legs, NULL when never seen."""
    prior = stored.select("ticker", F.col("contract").alias("_contract"), F.col("exact_oi").cast("long").alias("_oi"))
    df = expiries
    for side in ("call", "put"):
        leg = prior.withColumnsRenamed({"_contract": f"_{side}", "_oi": f"atm_{side}_prev_oi"})
        df = df.withColumn(f"_{side}", F.upper(f"atm_{side}")).join(leg, ["ticker", f"_{side}"], "left").drop(f"_{side}")
    return df


def iv_history(snapshots: DataFrame, n: int = 250) -> DataFrame:
    """Newest n volatility readings per ticker (the filter also runs before the shuffle)."""
    w = Window.partitionBy("ticker").orderBy(F.desc("as_of"), F.desc("seq"))
    known = snapshots.where(F.col("avg_iv").isNotNull())
    return known.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def iv_rank(current: DataFrame, history: DataFrame, min_samples: int = 20) -> DataFrame:
    """Rank and percentile of `current_iv` within the ticker's readings.

    `history` is the limited history (at most 250 readings a ticker), so each
    ticker's list has a fixed upper length and joins as one row.
    """
    lists = history.groupBy("ticker").agg(F.collect_list(F.struct("expiration", "avg_iv")).alias("_h"))
    df = current.join(lists, "ticker", "left").withColumn("_h", F.coalesce("_h", F.array().cast("array<struct<expiration:string,avg_iv:double>>")))
    exact = F.filter("_h", lambda e: e["expiration"] == F.col("expiration"))
    df = df.withColumn("_exact", exact)
    use_exact = F.size("_exact") >= min_samples
    df = df.withColumn("_s", F.transform(F.when(use_exact, F.col("_exact")).otherwise(F.col("_h")), lambda e: e["avg_iv"]))
    cur, n = F.col("current_iv"), F.size("_s")
    ok = (n >= min_samples) & cur.isNotNull()
    lo, hi = F.array_min("_s"), F.array_max("_s")
    rank = F.when(hi <= lo, 50.0).otherwise(F.try_divide(cur - lo, hi - lo) * 100.0)
    share = F.try_divide(F.size(F.filter("_s", lambda v: v <= cur)), n) * 100.0
    return (
        df.withColumn("iv_rank", F.when(ok, rnd_stable(clamp(rank), 1)))
        .withColumn("iv_percentile", F.when(ok, rnd_stable(share, 1)))
        .withColumn("iv_history_count", n)
        .withColumn("iv_history_scope", F.when(ok, F.when(use_exact, "exact_expiration").otherwise("ticker")))
        .drop("_h", "_exact", "_s")
    )


# --------------------------------------------------------------------------- decisions
# fixed values: gate labels from mild to strict
GATES = ("high", "medium", "watch", "spread only", "paper only", "no trade")


def add_risk_gate(df: DataFrame) -> DataFrame:
    """Caps confidence and names the strictest gate among the rules that hold.

    Reads confidence, action, dte, avg_iv, exact_volume, exact_oi, spread_pct,
    premium_pct_spot, iv_realized_ratio, iv_rank, theta_per_day, reference_price,
    earnings_in_window and days_to_earnings.
    """
    conf, dte, iv = F.col("confidence"), F.col("dte"), F.col("avg_iv")
    oi, vol, spread = F.col("exact_oi"), F.col("exact_volume"), F.col("spread_pct")
    ratio, rank, premium = F.col("iv_realized_ratio"), F.col("iv_rank"), F.col("premium_pct_spot")
    early = F.coalesce(F.col("earnings_in_window"), F.lit(False))
    soon = early & F.coalesce(F.col("days_to_earnings") <= 5, F.lit(False))
    bleed = F.when(
        F.coalesce(F.col("reference_price"), F.lit(0.0)) != 0,
        F.abs("theta_per_day") / F.nullif(F.col("reference_price"), F.lit(0.0)) * 100.0,
    )
    # condition, confidence cap, gate, reason; in reporting order
    rules = [
        (dte < 3, 35.0, 4, "dte_0_2"),
        ((dte >= 3) & (dte < 7), 60.0, 4, "dte_below_7"),
        (oi < 100, 45.0, 4, "contract_oi_thin"),
        (vol < 50, 50.0, 4, "contract_volume_low"),
        (spread > 25, 45.0, 4, "spread_very_wide"),
        ((spread > 15) & (spread <= 25), 65.0, 3, "spread_wide"),
        ((iv > 150) & (dte < 21), 65.0, 3, "iv_extreme_short_dte"),
        ((iv > 100) & ~((iv > 150) & (dte < 21)), 72.0, 3, "iv_very_high"),
        (premium > 8, 70.0, 3, "premium_expensive"),
        (ratio > 3.0, 58.0, 4, "iv_over_realized_3x"),
        ((ratio > 2.0) & (ratio <= 3.0), 68.0, 3, "iv_over_realized_2x"),
        (rank >= 85, 62.0, 3, "iv_rank_very_high"),
        ((rank >= 70) & (rank < 85), 72.0, 3, "iv_rank_high"),
        (soon, 58.0, 3, "earnings_within_5d"),
        (early & ~soon, 66.0, 3, "earnings_before_expiry"),
        (bleed > 4, 60.0, 4, "theta_bleed_4pct"),
        ((bleed > 2) & (bleed <= 4), 70.0, 3, "theta_bleed_2pct"),
    ]
    idle = F.col("action") == "NO TRADE"
    start = F.when(conf >= 80, 0).when(conf >= 65, 1).otherwise(2)
    gate = F.greatest(start, *[F.when(test, level) for test, _, level, _ in rules])
    cap = F.least(*[F.when(test, value) for test, value, _, _ in rules])
    capped = F.when(cap.isNotNull(), rnd_stable(F.least(conf, cap), 1)).otherwise(conf)
    df = df.withColumn("gate_reasons", F.when(~idle, lines(*[F.when(test, text) for test, _, _, text in rules])))
    df = df.withColumn("_gate", gate).withColumn("confidence", F.when(idle, F.least(conf, F.lit(25.0))).otherwise(capped))
    mild = (F.col("_gate") == 0) & (F.col("confidence") < 80)
    level = F.when(idle, 5).when(mild, F.when(F.col("confidence") >= 65, 1).otherwise(2)).otherwise(F.col("_gate"))
    names = F.array(*[F.lit(g) for g in GATES])
    return df.withColumn("risk_gate", F.element_at(names, level + 1)).drop("_gate")


def readiness(conf: Column, oi: Column, spread: Column, action: Column, gate: Column) -> Column:
    own = (
        F.when(action == "NO TRADE", "no trade")
        .when((oi < 100) | F.coalesce(spread > 25, F.lit(False)), "paper only")
        .when(conf >= 75, "high")
        .when(conf >= 55, "medium")
        .otherwise("low")
    )
    return F.when(gate.isin("high", "medium", "watch"), own).otherwise(gate)


def add_structures(df: DataFrame, multiplier: int = 100) -> DataFrame:
    """Defined-risk debit spread, and a premium-selling structure when IV is rich.

    Reads option_direction, atm_strike, expected_move_pct, reference_price, avg_iv,
    iv_rank and iv_realized_ratio.
    """
    k, em = F.col("atm_strike"), F.col("expected_move_pct")
    width = F.abs(em) / 100.0 * k
    usable = (F.coalesce(k, F.lit(0.0)) != 0) & (F.coalesce(em, F.lit(0.0)) != 0) & (width > 0)
    df = df.withColumn("_w", F.when(usable, width))
    w = F.col("_w")
    rich = (
        F.coalesce(F.col("iv_rank") >= 60, F.lit(False))
        | F.coalesce(F.col("avg_iv") >= 70, F.lit(False))
        | F.coalesce(F.col("iv_realized_ratio") >= 1.6, F.lit(False))
    )
    up, down = F.col("option_direction") == "up", F.col("option_direction") == "down"
    premium = F.nullif(F.col("reference_price"), F.lit(0.0))
    paid = F.when(premium.isNotNull(), F.least(premium, w * 0.9) * 0.55).otherwise(w * 0.45)
    sign = F.when(up, 1.0).when(down, -1.0)
    df = df.withColumn("_debit", rnd_stable(paid, 2)).withColumn("_long", rnd_stable(k, 2)).withColumn("_sign", sign)
    df = df.withColumn("_short", rnd_stable(k + F.col("_sign") * w, 2))
    debit, long_k, short_k = F.col("_debit"), F.col("_long"), F.col("_short")
    sided = usable & (up | down)
    reach = F.col("_sign") * (short_k - long_k)
    df = df.withColumn(
        "spread",
        F.when(
            sided,
            F.struct(
                F.when(up, "call_debit_spread").otherwise("put_debit_spread").alias("type"),
                long_k.alias("long_strike"),
                short_k.alias("short_strike"),
                debit.alias("est_net_debit"),
                rnd_stable(debit * multiplier, 2).alias("est_max_loss"),
                rnd_stable(F.greatest(F.lit(0.0), reach - debit) * multiplier, 2).alias("est_max_gain"),
                rnd_stable(long_k + F.col("_sign") * debit, 2).alias("breakeven"),
            ),
        ),
    )
    flat = usable & ~(up | down)
    df = df.withColumn("_credit", rnd_stable(w * F.when(up | down, 0.35).otherwise(0.6), 2))
    df = df.withColumn("_sell", rnd_stable(k - F.col("_sign") * w, 2)).withColumn("_buy", rnd_stable(k - F.col("_sign") * 2 * w, 2))
    credit, sell, buy = F.col("_credit"), F.col("_sell"), F.col("_buy")
    none = F.lit(None).cast("double")
    vertical = F.struct(
        F.when(up, "bull_put_credit_spread").otherwise("bear_call_credit_spread").alias("type"),
        sell.alias("short_strike"),
        buy.alias("long_strike"),
        none.alias("short_call"),
        none.alias("long_call"),
        credit.alias("est_net_credit"),
        rnd_stable(credit * multiplier, 2).alias("est_max_gain"),
        rnd_stable(F.greatest(F.lit(0.0), F.col("_sign") * (sell - buy) - credit) * multiplier, 2).alias("est_max_loss"),
        rnd_stable(sell - F.col("_sign") * credit, 2).alias("breakeven"),
    )
    condor = F.struct(
        F.lit("iron_condor").alias("type"),
        rnd_stable(k - w, 2).alias("short_strike"),
        rnd_stable(k - 2 * w, 2).alias("long_strike"),
        rnd_stable(k + w, 2).alias("short_call"),
        rnd_stable(k + 2 * w, 2).alias("long_call"),
        credit.alias("est_net_credit"),
        rnd_stable(credit * multiplier, 2).alias("est_max_gain"),
        rnd_stable(F.greatest(F.lit(0.0), w - credit) * multiplier, 2).alias("est_max_loss"),
        none.alias("breakeven"),
    )
    df = df.withColumn("alt_structure", F.when(sided & rich, vertical).when(flat & rich, condor))
    label = (
        F.when(~usable, F.lit(None))
        .when(up & rich, "bull put credit spread")
        .when(up, "long call or call debit spread")
        .when(down & rich, "bear call credit spread")
        .when(down, "long put or put debit spread")
        .when(rich, "iron condor")
        .otherwise("no clear options edge")
    )
    return df.withColumn("strategy_label", label).drop("_w", "_debit", "_long", "_short", "_sign", "_credit", "_sell", "_buy")


def trade_idea(df: DataFrame) -> DataFrame:
    """Bias, idea and reference contract from the nearest expiry."""
    d = F.col("direction")
    bias = F.when(d == "avoid", "avoid").when(bullish(d), "bullish").when(bearish(d), "bearish").otherwise("neutral")
    df = df.withColumn("bias", bias)
    b = F.col("bias")
    rich = F.coalesce(F.col("avg_iv") >= 70, F.lit(False))
    thin = F.col("illiquid") | (F.col("total_oi") < 500)
    idea = (
        F.when(thin, "avoid_or_paper_only_due_to_low_options_liquidity")
        .when((b == "bullish") & rich, "call_debit_spread")
        .when(b == "bullish", "long_call_or_call_debit_spread")
        .when((b == "bearish") & rich, "put_debit_spread")
        .when(b == "bearish", "long_put_or_put_debit_spread")
        .otherwise("no_short_term_options_edge")
    )
    notes = lines(F.when(rich, "high_iv_favors_spreads"), F.when(thin, "thin_liquidity"), F.when(F.col("dte") <= 2, "very_short_dte"))
    k, em = F.col("atm_strike"), F.col("expected_move_pct")
    width = F.abs(em) / 100.0 * k
    legs = F.struct(
        F.when(b == "bullish", "call_debit_spread").otherwise("put_debit_spread").alias("type"),
        rnd(k, 2).alias("long_strike"),
        rnd_stable(F.when(b == "bullish", k + width).otherwise(k - width), 2).alias("short_strike"),
    )
    return (
        df.withColumn("idea", idea)
        .withColumn("idea_contract", F.when(b == "bullish", F.col("atm_call")).when(b == "bearish", F.col("atm_put")))
        .withColumn("suggested_spread", F.when(b.isin("bullish", "bearish") & k.isNotNull() & em.isNotNull(), legs))
        .withColumn("idea_notes", notes)
    )


def _reference(df: DataFrame) -> DataFrame:
    """The leg an idea refers to: the side's own, else the cheaper, then the more liquid."""
    call_ok, put_ok = F.col("atm_call").isNotNull(), F.col("atm_put").isNotNull()

    def cost(side: str) -> Column:
        return F.coalesce(F.nullif(F.col(f"atm_{side}_last"), F.lit(0.0)), F.lit(1e9))

    def depth(side: str) -> Column:
        return F.coalesce(f"atm_{side}_volume", F.lit(0)) + F.coalesce(f"atm_{side}_oi", F.lit(0))

    cheaper = F.when(cost("call") != cost("put"), cost("call") < cost("put")).otherwise(depth("call") >= depth("put"))
    lean = F.col("_lean")
    use_call = (
        F.when((F.col("_side") == "up") | ((lean == "up") & call_ok), True)
        .when((F.col("_side") == "down") | ((lean == "down") & put_ok), False)
        .when(call_ok & ~put_ok, True)
        .when(put_ok & ~call_ok, False)
        .when(call_ok & put_ok, cheaper)
    )
    df = df.withColumn("_call", use_call)

    def pick(field: str) -> Column:
        return F.when(F.col("_call"), F.col(f"atm_call{field}")).when(~F.col("_call"), F.col(f"atm_put{field}"))

    return (
        df.withColumn("reference_contract", pick(""))
        .withColumn("reference_price", pick("_last"))
        .withColumn("reference_bid", pick("_bid"))
        .withColumn("reference_ask", pick("_ask"))
        .withColumn("exact_volume", pick("_volume"))
        .withColumn("exact_oi", pick("_oi"))
        .withColumn("reference_iv", F.coalesce(F.nullif(pick("_iv"), F.lit(0.0)), F.col("avg_iv")))
        .withColumn("previous_oi", pick("_prev_oi"))
        .withColumn("reference_type", F.when(F.col("_call"), "call").when(~F.col("_call"), "put"))
        .drop("_call")
    )


def add_expiry_ideas(expiries: DataFrame, min_dte: int = MIN_DTE) -> DataFrame:
    """Confidence, quality, gate and structures of every expiry.

    `expiries` are metric rows with term structure and skew, joined with the
    ticker's signal: signal_direction (up, down, neutral), conviction, data_quality,
    algo_confluence, ticker_risk, realized_vol, days_to_earnings, is_index,
    expected_points, min_index_points and iv_rank; `join_previous_oi` adds the open
    interest of the last stored scan.
    """
    zero, one = F.lit(0.0), F.lit(1.0)
    df = expiries.where(F.col("dte") >= min_dte)
    lean = F.when(F.col("signal_direction").isin("up", "down"), F.col("signal_direction")).otherwise("neutral")
    gap = F.coalesce(F.abs("expected_points"), F.lit(-1.0)) < F.col("min_index_points")
    blocked = F.col("is_index") & (F.col("min_index_points") > 0) & gap
    df = df.withColumn("_lean", lean).withColumn("_side", F.when(~F.coalesce(blocked, F.lit(False)), F.col("_lean")).otherwise("neutral"))
    side, pcr, iv, oi = F.col("_side"), F.col("put_call_ratio"), F.col("avg_iv"), F.col("total_oi")
    up, down = side == "up", side == "down"
    liquid = F.greatest(F.lit(0.2), F.least(one, oi / 2000.0))
    crush = F.when(iv > 90, 0.55).when(iv > 70, 0.75).otherwise(1.0)
    days = dte_factor(F.col("dte"))
    flow = (
        F.when(up & (pcr < 0.9), 6.0)
        .when(down & (pcr > 1.1), 6.0)
        .when((up & (pcr > 1.3)) | (down & (pcr < 0.7)), -6.0)
        .otherwise(0.0)
    )
    legacy = rnd_stable(clamp(F.col("conviction") * 100.0 * liquid * crush * days + flow), 1)
    idle = ~(up | down)
    df = df.withColumn("action", F.when(up, "BUY CALL").when(down, "BUY PUT").otherwise("NO TRADE"))
    df = df.withColumn("option_direction", F.col("_lean"))
    df = df.withColumn("confidence", F.when(idle, F.least(legacy, F.lit(25.0))).otherwise(legacy))
    df = _reference(df)
    df = add_unusual_activity(df, "exact_volume", "exact_oi", "previous_oi")
    df = df.withColumn("spread_pct", spread_pct(F.col("reference_bid"), F.col("reference_ask")))
    label, factor = flow_alignment(F.col("option_direction"), pcr)
    price, spot = F.nullif(F.col("reference_price"), zero), F.nullif(F.col("spot"), zero)
    df = df.withColumn("flow_alignment", label).withColumn("iv_risk", iv_risk(iv))
    df = df.withColumn("premium_pct_spot", rnd_stable(F.try_divide(price, spot) * 100.0, 2))
    df = df.withColumn(
        "iv_realized_ratio",
        F.when(F.col("realized_vol") > 0, rnd_stable(F.try_divide(F.col("reference_iv"), F.col("realized_vol")), 2)),
    )
    df = df.withColumn("_greek_iv", F.coalesce(F.nullif(F.col("reference_iv"), zero), iv)).withColumn(
        "_right", F.coalesce("reference_type", F.lit("call"))
    )
    df = add_greeks(df, "spot", "atm_strike", "reference_price", "_greek_iv", "dte", "_right")
    depth = F.greatest(
        F.lit(0.05),
        F.least(one, 0.65 * clamp(oi / 2500.0, 0.0, 1.0) + 0.35 * clamp(F.col("total_volume") / 1000.0, 0.0, 1.0)),
    )
    quality = rnd_stable(
        100.0 * (0.26 * depth + 0.20 * days + 0.18 * iv_factor(iv) + 0.20 * factor + 0.16 * spread_factor(F.col("spread_pct"))), 1
    )
    df = df.withColumn("liquidity_score", rnd_stable(depth * 100.0, 1)).withColumn("_q", quality)
    lifted = rnd_stable(F.least(F.lit(100.0), F.col("_q") + F.least(F.lit(6.0), F.col("unusual_score") * 0.06)), 1)
    df = df.withColumn("option_quality", F.when(idle, F.col("_q")).otherwise(lifted))
    blend = 100.0 * (
        0.46 * F.col("conviction")
        + 0.16 * clamp(F.col("data_quality") / 100.0, 0.0, 1.0)
        + 0.14 * clamp(F.col("algo_confluence") / 5.0, 0.0, 1.0)
        + 0.24 * (F.col("option_quality") / 100.0)
    )
    live = rnd_stable(F.greatest(F.col("confidence"), blend), 1)
    no_price = F.col("reference_contract").isNull() | price.isNull() | (price <= 0)
    live = F.least(
        live,
        F.when(F.col("ticker_risk") >= 80, 55.0).when(F.col("ticker_risk") >= 65, 70.0),
        F.when(oi < 100, 55.0),
        F.when(no_price, 50.0),
        F.when(F.col("spread_pct") > 25, 60.0),
    )
    df = df.withColumn("confidence", F.when(idle, F.col("confidence")).otherwise(live))
    df = df.withColumn("option_quality", F.when(idle, F.least(F.col("option_quality"), F.lit(45.0))).otherwise(F.col("option_quality")))
    df = df.withColumn("earnings_in_window", F.coalesce((F.col("days_to_earnings") >= 0) & (F.col("days_to_earnings") <= F.col("dte")), F.lit(False)))
    df = add_risk_gate(df)
    df = df.withColumn(
        "readiness",
        readiness(F.col("confidence"), F.coalesce(F.nullif(F.col("exact_oi"), F.lit(0)), oi), F.col("spread_pct"), F.col("action"), F.col("risk_gate")),
    )
    df = add_structures(df)
    prefers = F.col("alt_structure").isNotNull() & (F.col("earnings_in_window") | (F.col("risk_gate") == "spread only"))
    return df.withColumn("prefers_structure", prefers).drop("_lean", "_side", "_q", "_greek_iv", "_right")


def rank_expiries(ideas: DataFrame, n: int = 3) -> DataFrame:
    """The n most confident expiries per ticker, the nearer one first on a tie."""
    w = Window.partitionBy("ticker").orderBy(F.desc("confidence"), "dte")
    return ideas.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
