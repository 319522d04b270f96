"""Weighted blend, confidence, risk and the candidate gate.

Components are pivoted to one wide row per ticker: the names are a fixed list, so
the blend is plain column arithmetic after a single grouped aggregate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import bearish, bullish, clamp, lines, rnd, rnd_stable

COMPONENTS = (
    "technical_structure",
    "price_volume_momentum",
    "fundamentals",
    "options_intelligence",
    "macro_regime",
    "sentiment",
    "cross_market_correlation",
    "ensemble_forecast",
)
PENALTY = "risk_penalty_adjustment"
NEWS_KEY = "news_events"


def add_up(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def widen(components: DataFrame, by: list[str]) -> DataFrame:
    """One row per key: `c_<name>` is the score, NULL when unavailable or absent.

    `given` counts the components that were reported at all; the set behind it holds
    component names only, so it is short and needs no second shuffle.
    """
    known = [
        F.max(F.when((F.col("name") == n) & F.col("available"), F.col("score"))).alias(f"c_{n}") for n in COMPONENTS
    ]
    return components.groupBy(*by).agg(*known, F.size(F.collect_set("name")).alias("given"))


def widen_weights(weights: DataFrame) -> DataFrame:
    """One row per profile: `w_<name>`, news folded into sentiment, plus the penalty."""
    name = F.when(F.col("component") == NEWS_KEY, "sentiment").otherwise(F.col("component"))
    parts = [F.sum(F.when(name == n, F.col("weight")).otherwise(0.0)).alias(f"w_{n}") for n in (*COMPONENTS, PENALTY)]
    return weights.groupBy("profile").agg(*parts)


def blend(wide: DataFrame, profile_weights: DataFrame) -> DataFrame:
    """Opportunity, quality, conviction, alignment and confidence.

    The weight table has one row per profile (a configuration list), so it is
    broadcast; component rows stay where the pivot left them.
    """
    df = wide.join(profile_weights, "profile")
    have = {n: F.col(f"c_{n}").isNotNull() for n in COMPONENTS}
    given = {n: F.when(have[n], F.col(f"w_{n}")).otherwise(0.0) for n in COMPONENTS}
    total = add_up(list(given.values()))
    df = df.withColumn("_total", F.when(total == 0, F.lit(1.0)).otherwise(total))
    df = df.withColumns({f"u_{n}": given[n] / F.col("_total") for n in COMPONENTS})
    score = {n: F.coalesce(F.col(f"c_{n}"), F.lit(0.0)) for n in COMPONENTS}
    count = add_up([have[n].cast("int") for n in COMPONENTS])
    mean = F.try_divide(add_up([score[n] for n in COMPONENTS]), F.col("available_count"))
    df = df.withColumn("available_count", count)
    df = df.withColumn("_mean", mean)
    spread = add_up([F.when(have[n], F.pow(F.col(f"c_{n}") - F.col("_mean"), 2)).otherwise(0.0) for n in COMPONENTS])
    df = df.withColumn("dispersion", F.sqrt(F.try_divide(spread, F.col("available_count"))))
    df = df.withColumn(
        "opportunity_raw", rnd_stable(add_up([score[n] * F.col(f"u_{n}") for n in COMPONENTS]), 1)
    )
    none = F.col("available_count") == 0
    coverage = F.col("available_count") / F.greatest(F.lit(1), F.col("given"))
    agreement = F.greatest(F.lit(0.0), 1 - F.col("dispersion") / 35)
    df = df.withColumn("coverage", coverage)
    return df.withColumn(
        "data_quality", F.when(none, 20.0).otherwise(rnd_stable(100 * (0.55 * coverage + 0.45 * agreement), 1))
    ).drop("_total", "_mean")


def conviction(opportunity: Column) -> Column:
    return clamp((F.abs(opportunity - 50.0) - 4.0) / 18.0, 0.0, 1.0)


def alignment(opportunity: Column) -> Column:
    """Weighted share of the available evidence that does not oppose the side."""
    support, total = [], []
    for n in COMPONENTS:
        c, u = F.col(f"c_{n}"), F.col(f"u_{n}")
        weight = F.when(c.isNull(), 0.0).when(u > 0, u).otherwise(1.0)
        against = F.when(opportunity >= 50.0, 50.0 - c).otherwise(c - 50.0)
        opposed = F.coalesce(clamp(against / 25.0, 0.0, 1.0), F.lit(0.0))
        total.append(weight)
        support.append(weight * (1.0 - opposed))
    return F.coalesce(F.try_divide(add_up(support), add_up(total)), F.lit(0.5))


def confidence(opportunity: Column) -> Column:
    base = 100.0 * (0.45 * F.col("coverage") + 0.55 * alignment(opportunity))
    return rnd_stable(base * (0.20 + 0.80 * conviction(opportunity)), 1)


def to_direction(score: Column) -> Column:
    return (
        F.when(score >= 70, "bullish")
        .when(score >= 58, "neutral_to_bullish")
        .when(score > 42, "neutral")
        .when(score > 30, "neutral_to_bearish")
        .otherwise("bearish")
    )


def add_risk(df: DataFrame, min_volume: float = 1_000_000, min_oi: int = 100) -> DataFrame:
    """Risk score, level, block flag and reasons.

    Reads has_market_data, last_volume, is_option_setup, illiquid, total_oi, avg_iv
    and data_quality next to the wide components.
    """
    scores = [F.col(f"c_{n}") for n in COMPONENTS]
    conflict = F.greatest(*scores) - F.least(*scores) > 45
    no_data = ~F.col("has_market_data")
    thin = F.col("last_volume") < min_volume
    setup = F.col("is_option_setup") & F.col("total_oi").isNotNull()
    thin_oi = setup & (F.col("illiquid") | (F.col("total_oi") < min_oi))
    rich = setup & (F.col("avg_iv") > 90)
    weak = F.col("data_quality") < 40
    rules = [
        (no_data, 25.0, "market_data_unavailable"),
        (thin, 12.0, "thin_volume"),
        (thin_oi, 15.0, "thin_open_interest"),
        (rich, 10.0, "very_high_iv"),
        (conflict, 10.0, "conflicting_signals"),
        (weak, 12.0, "low_data_quality"),
    ]
    score = F.lit(30.0)
    for test, size, _ in rules:
        score = score + F.when(test, size).otherwise(0.0)
    df = df.withColumn("risk_score", clamp(score))
    r = F.col("risk_score")
    return (
        df.withColumn(
            "risk_level", F.when(r >= 80, "extreme").when(r >= 60, "high").when(r >= 40, "medium").otherwise("low")
        )
        .withColumn("block_trade", no_data | (r >= 80))
        .withColumn("risk_reasons", lines(*[F.when(test, text) for test, _, text in rules]))
    )


def add_opportunity(df: DataFrame) -> DataFrame:
    """Risk-adjusted opportunity and the direction bucket."""
    adjusted = F.col("opportunity_raw") * (1 - F.col(f"w_{PENALTY}") * F.col("risk_score") / 100.0)
    df = df.withColumn("opportunity_score", rnd_stable(adjusted, 1))
    direction = F.when(F.col("block_trade"), "avoid").otherwise(to_direction(F.col("opportunity_score")))
    return df.withColumn("direction", direction).withColumn("conviction", conviction(F.col("opportunity_score")))


def add_confidence(df: DataFrame) -> DataFrame:
    """Confidence with every cap and haircut, in order, rounded at each step.

    Reads high_impact_count, regime, regime_available, is_index and broad_direction.
    """
    from .regime import regime_multiplier

    d, conf = F.col("direction"), F.col("confidence")
    live = d != "avoid"
    df = df.withColumn("confidence", confidence(F.col("opportunity_score")))
    df = df.withColumn(
        "confidence",
        F.when(d == "avoid", F.least(conf, F.lit(30.0))).when(d == "neutral", F.least(conf, F.lit(40.0))).otherwise(conf),
    )
    eventful = (F.col("high_impact_count") > 0) & live
    df = df.withColumn("confidence", F.when(eventful, rnd_stable(conf * 0.85, 1)).otherwise(conf))
    mult = regime_multiplier(F.col("regime"), F.col("regime_available"), d)
    df = df.withColumn("regime_multiplier", mult)
    df = df.withColumn(
        "confidence",
        F.when((F.col("regime_multiplier") != 1.0) & live, rnd_stable(conf * F.col("regime_multiplier"), 1)).otherwise(conf),
    )
    tape_down = F.col("broad_direction").isin("risk_off", "cautious_risk_off")
    tape_up = F.col("broad_direction").isin("risk_on", "constructive")
    fights = (tape_down & bullish(d)) | (tape_up & bearish(d))
    helps = (tape_down & bearish(d)) | (tape_up & bullish(d))
    index_rule = (
        F.when(F.col("is_index") & fights, rnd_stable(conf * 0.9, 1))
        .when(F.col("is_index") & helps, rnd_stable(F.least(F.lit(100.0), conf * 1.03), 1))
        .otherwise(conf)
    )
    return df.withColumn("confidence", index_rule)


def apply_ceiling(df: DataFrame) -> DataFrame:
    over = ~F.col("direction").isin("avoid", "neutral") & (F.col("confidence") > F.col("confidence_ceiling"))
    return df.withColumn(
        "confidence", F.when(over, rnd(F.col("confidence_ceiling"), 1)).otherwise(F.col("confidence"))
    )


def severity(opportunity: Column, conf: Column, level: Column, blocked: Column, threshold: float = 65) -> Column:
    strong = ((opportunity >= 70) | (opportunity <= 30)) & (conf >= threshold)
    return (
        F.when(blocked, "P3")
        .when(strong & level.isin("low", "medium"), "P1")
        .when((opportunity >= 60) | (opportunity <= 40), "P2")
        .otherwise("P3")
    )


# fixed values: the 23 factor groups, in reporting order
FACTOR_GROUPS = (
    "company_fundamentals", "valuation", "macroeconomic", "government_policy", "geopolitical", "sector_industry",
    "sentiment_psychology", "technical", "options_market", "liquidity_structure", "institutional_flows",
    "bonds_yields_credit", "currency", "commodities", "global_correlation", "news_events", "earnings_calls",
    "seasonal_calendar", "volatility_risk", "alternative_data", "ai_technology", "index_factors", "black_swan",
)
# fixed values: groups no source feeds yet
UNFED_GROUPS = ("institutional_flows", "earnings_calls", "alternative_data", "black_swan")


def add_factor_coverage(df: DataFrame) -> DataFrame:
    """Which factor groups have data, and the confidence they can carry.

    Reads the wide components, news_items, policy_links, has_government,
    has_global, regime_available and event_count.
    """
    have = {n: F.col(f"c_{n}").isNotNull() for n in COMPONENTS}
    macro, options = have["macro_regime"], have["options_intelligence"]
    world = F.coalesce(F.col("has_global"), F.lit(False))
    tape = world | F.coalesce(F.col("regime_available"), F.lit(False))
    no = F.lit(False)
    covered = dict.fromkeys(FACTOR_GROUPS, no)
    covered.update(
        company_fundamentals=have["fundamentals"],
        valuation=have["fundamentals"],
        macroeconomic=macro,
        government_policy=(F.coalesce("policy_links", F.lit(0)) > 0) | F.coalesce("has_government", no),
        geopolitical=world,
        sentiment_psychology=have["sentiment"],
        technical=have["technical_structure"],
        options_market=options,
        liquidity_structure=options,
        bonds_yields_credit=macro,
        currency=macro,
        commodities=macro,
        global_correlation=tape,
        news_events=F.coalesce("news_items", F.lit(0)) > 0,
        seasonal_calendar=F.coalesce("event_count", F.lit(0)) > 0,
        volatility_risk=options | macro,
        index_factors=tape,
    )
    count = add_up([covered[g].cast("int") for g in FACTOR_GROUPS])
    df = df.withColumn("covered_count", count)
    df = df.withColumn("coverage_pct", rnd(100.0 * F.col("covered_count") / len(FACTOR_GROUPS), 0))
    df = df.withColumn("confidence_ceiling", rnd_stable(50.0 + 0.45 * F.col("coverage_pct"), 0))
    reads = {
        "technical": "technical_structure",
        "sentiment_psychology": "sentiment",
        "macroeconomic": "macro_regime",
        "options_market": "options_intelligence",
        "company_fundamentals": "fundamentals",
        "global_correlation": "cross_market_correlation",
    }
    lean = {g: F.when(covered[g], F.col(f"c_{c}")) for g, c in reads.items()}
    return (
        df.withColumn("missing_groups", lines(*[F.when(~covered[g], g) for g in FACTOR_GROUPS]))
        .withColumn("bullish_groups", lines(*[F.when(lean[g] >= 56, g) for g in reads]))
        .withColumn("bearish_groups", lines(*[F.when(lean[g] <= 44, g) for g in reads]))
        .withColumn("next_data_to_add", lines(*[F.when(~covered[g], g) for g in UNFED_GROUPS]))
    )


def add_candidate_gate(df: DataFrame, min_percent: float = 5.0, min_reward_risk: float = 2.0) -> DataFrame:
    """Expected move, reward/risk and the first rule that rejects the call.

    Reads direction, current_price, target_price, stop_price, opportunity_score,
    confidence, risk_score, has_catalyst and block_trade.
    """
    price, target, stop, d = (F.col(c) for c in ("current_price", "target_price", "stop_price", "direction"))
    up, down = bullish(d), bearish(d)
    blocked = F.col("block_trade") | (d == "avoid")
    unknown = price.isNull() | (price <= 0) | target.isNull()
    dead = blocked | unknown
    move = F.when(up, target - price).when(down, price - target).otherwise(F.abs(target - price))
    floor = F.when(price < 100, 5.0).otherwise(10.0)
    df = (
        df.withColumn("expected_points", F.when(~dead, move))
        .withColumn("min_required_points", F.when(~dead, floor))
        .withColumn("final_required_points", F.when(~dead, F.greatest(floor, price * (min_percent / 100.0))))
        .withColumn("risk_points", F.when(~dead, F.abs(price - stop)))
    )
    df = df.withColumn("expected_percent", F.try_divide(F.col("expected_points"), price) * 100.0).withColumn(
        "reward_risk_ratio", F.when(F.col("risk_points") > 0, F.try_divide(F.col("expected_points"), F.col("risk_points")))
    )
    move_ok = (F.col("expected_points") >= F.col("final_required_points")) & (F.col("expected_percent") >= min_percent)
    rr_ok = F.col("reward_risk_ratio") >= min_reward_risk
    df = df.withColumn("move_ok", F.coalesce(move_ok, F.lit(False))).withColumn("rr_ok", F.coalesce(rr_ok, F.lit(False)))
    opp, conf, risk = F.col("opportunity_score"), F.col("confidence"), F.col("risk_score")
    strong = (opp >= 70) & (conf >= 65) & (risk <= 45) & F.col("has_catalyst")
    valid = F.concat(
        F.when(strong, "strong_").otherwise(""), F.when(up, "bullish").otherwise("bearish"), F.lit("_research_candidate")
    )
    # rule, label, status, action; the first rule that holds decides
    ladder = [
        (blocked, "rejected_high_risk", "REJECTED", "wait_or_avoid", "blocked_by_risk"),
        (unknown, "no_trade", "NO_TRADE", "wait_or_avoid", "no_price_or_target"),
        (~(up | down), "no_trade", "NO_TRADE", "wait_or_avoid", "no_directional_edge"),
        (~F.col("move_ok"), "rejected_insufficient_expected_move", "REJECTED", "watch_only", "move_too_small"),
        (~F.col("rr_ok"), "rejected_low_reward", "REJECTED", "watch_only", "reward_risk_too_low"),
        (risk > 55, "rejected_high_risk", "REJECTED", "wait_or_avoid", "risk_score_too_high"),
        ((conf < 55) | (opp < 60), "watchlist_only", "WATCHLIST", "watch_only", "conviction_light"),
    ]

    def first(pick: int, otherwise: Column) -> Column:
        out = otherwise
        for rule in reversed(ladder):
            out = F.when(rule[0], rule[pick]).otherwise(out)
        return out

    action = F.when(up, "research_long_setup").otherwise("research_short_or_put_setup")
    return (
        df.withColumn("final_label", first(1, valid))
        .withColumn("validation_status", first(2, F.lit("VALID_RESEARCH_CANDIDATE")))
        .withColumn("research_action", first(3, action))
        .withColumn("rejected_reason", first(4, F.lit(None).cast("string")))
    )


def confluence(direction: Column, technical: Column, momentum: Column, opportunity: Column, prob_up: Column, pcr: Column) -> Column:
    """Number of independent signals (0-5) that agree with the direction."""
    up, down = bullish(direction), bearish(direction)
    votes = [
        (up & (technical >= 55)) | (down & (technical <= 45)),
        (up & (momentum >= 55)) | (down & (momentum <= 45)),
        (up & (opportunity >= 58)) | (down & (opportunity <= 42)),
        (up & (prob_up >= 0.55)) | (down & (prob_up <= 0.45)),
        (up & (pcr < 0.9)) | (down & (pcr > 1.1)),
    ]
    return add_up([F.coalesce(v, F.lit(False)).cast("int") for v in votes])


def confluence_label(votes: Column) -> Column:
    return F.when(votes >= 4, "strong").when(votes >= 2, "moderate").otherwise("weak")


def missing_data() -> Column:
    """Short names of the engines without data, in reporting order."""
    # fixed values: reported name of each audited component
    names = {
        "fundamentals": "fundamentals",
        "options_intelligence": "options",
        "macro_regime": "macro",
        "sentiment": "sentiment",
        "cross_market_correlation": "cross_market",
    }
    market = F.when(~F.col("has_market_data"), "live_market_data")
    return lines(*[F.when(F.col(f"c_{c}").isNull(), n) for c, n in names.items()], market)


def verdict_reasons(limit: int = 6) -> Column:
    """Ordered reasons behind the verdict, the gate's own first."""
    d, prob, radar = F.col("direction"), F.col("prob_up"), F.col("radar_verdict")
    pressured = (d == "neutral") & F.coalesce(
        (F.col("opportunity_score") <= 48) | F.coalesce(prob <= 0.45, F.lit(False)) | F.coalesce(radar == "bearish_exhaustion_watch", F.lit(False)),
        F.lit(False),
    )
    lean = (
        F.when(bullish(d), "score_leans_bullish")
        .when(bearish(d), "score_leans_bearish")
        .when(d == "avoid", "risk_manager_blocked")
        .otherwise("signals_mixed")
    )
    reasons = lines(
        F.when(F.col("rejected_reason").isNotNull(), F.concat(F.lit("["), F.col("validation_status"), F.lit("] "), F.col("rejected_reason"))),
        F.when(pressured, "bearish_pressure_watch"),
        lean,
        F.when(radar.isin("bullish_event_watch", "early_event_watch"), F.concat(F.lit("event_radar:"), radar)),
        F.when(radar == "bearish_exhaustion_watch", "exhaustion_risk"),
        F.when(prob >= 0.58, "forecast_up").when(prob <= 0.42, "forecast_down"),
        F.when(F.col("policy_links") > 0, "policy_clue"),
        F.when((F.col("high_impact_count") > 0) & (d != "avoid"), "scheduled_event_risk"),
        F.when(F.col("event_count") > 0, F.concat(F.lit("event_impact:"), F.col("event_level"))),
        F.when(F.col("regime_multiplier") != 1.0, F.concat(F.lit("regime:"), F.col("regime"))),
    )
    return F.slice(reasons, 1, limit)


def trend_summary() -> Column:
    """Short trend line from the parts that carry a signal."""
    change, tone = F.col("day_change_pct"), F.col("avg_polarity")
    mood = F.when(tone > 0.1, "bullish").when(tone < -0.1, "bearish").otherwise("mixed")
    items = F.coalesce("news_items", F.lit(0))
    return F.concat_ws(
        " | ",
        F.when(change.isNotNull(), F.format_string("price %+.2f%% today", change)),
        F.concat(items.cast("string"), F.lit(" news")),
        F.when(items > 0, F.concat(F.lit("tone "), mood)),
        F.when(F.col("policy_links") > 0, F.concat(F.col("policy_links").cast("string"), F.lit(" policy links"))),
        F.when(F.col("event_count") > 0, F.concat(F.lit("events "), F.col("event_level"))),
    )


def rank_by_opportunity(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Best opportunity first; the ticker breaks ties."""
    out = df.orderBy(F.desc("opportunity_score"), "ticker")
    return out if limit is None else out.limit(limit)
