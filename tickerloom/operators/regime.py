"""Market regime, macro, fundamentals and the broad-market read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import bearish, bullish, clamp, lines, pct_change, rnd, rnd_stable
from .series import add_rolling_means, blocks, full, ordered, own_rows

# fixed values: terms looked for in event texts
GEO_TERMS = (
    "war", "missile", "attack", "iran", "israel", "gaza", "russia", "ukraine", "china", "taiwan", "sanction",
    "ofac", "tariff", "export control", "shipping", "red sea", "strait", "hormuz", "defense",
)
OIL_TERMS = ("oil", "crude", "wti", "brent", "opec", "gasoline", "energy")
POLICY_TERMS = ("white house", "treasury", "federal reserve", "fed", "labor", "jobs", "cpi", "pce", "fomc")


def _sum(*parts: Column) -> Column:
    total = F.lit(0.0)
    for p in parts:
        total = total + p
    return total


def breadth_by_date(index_bars: DataFrame) -> DataFrame:
    """Share of indexes at or above their close five rows earlier, per date."""
    df = blocks(index_bars, 5)
    before = full(F.lag("close", 5).over(ordered("index_name")), 6)
    df = own_rows(df.withColumn("_before", before)).where(F.col("_before").isNotNull())
    share = 100.0 * F.avg((F.col("close") >= F.col("_before")).cast("double"))
    return df.groupBy("date").agg(rnd(share, 0).alias("breadth_pct"))


def add_benchmark_structure(df: DataFrame, key: str = "symbol") -> DataFrame:
    """Distances and moves of the benchmark (two decimals), known from 50 bars."""
    w, close = ordered(key), F.col("close")
    df = add_rolling_means(df, "close", 20, 50, key=key)
    return df.select(
        "*",
        full(rnd(pct_change(close, F.col("_mean_20")), 2), 50).alias("vs_20dma_pct"),
        full(rnd(pct_change(close, F.col("_mean_50")), 2), 50).alias("vs_50dma_pct"),
        full(rnd(pct_change(close, F.lag("close", 5).over(w)), 2), 50).alias("change_5d_pct"),
        full(rnd(pct_change(close, F.lag("close", 20).over(w)), 2), 50).alias("change_20d_pct"),
    ).drop("_mean_20", "_mean_50")


def add_regime(df: DataFrame) -> DataFrame:
    """Regime score, label and drivers per row.

    Reads vs_20dma_pct, vs_50dma_pct, change_5d_pct, vix, curve and breadth_pct;
    a missing input adds nothing.
    """
    v50, v20, c5, vix, curve, breadth = (
        F.col(c) for c in ("vs_50dma_pct", "vs_20dma_pct", "change_5d_pct", "vix", "curve", "breadth_pct")
    )
    score = _sum(
        F.lit(50.0),
        F.when(v50 >= 0, 12.0).when(v50 < 0, -12.0).otherwise(0.0),
        F.when(v20 >= 0, 6.0).when(v20 < 0, -6.0).otherwise(0.0),
        F.coalesce(clamp(c5 * 1.5, -10.0, 10.0), F.lit(0.0)),
        F.when(vix >= 30, -16.0).when(vix >= 22, -9.0).when(vix < 14, 8.0).otherwise(0.0),
        F.when(curve < 0, -5.0).otherwise(0.0),
        F.when(breadth <= 35, -6.0).when(breadth >= 70, 5.0).otherwise(0.0),
    )
    df = df.withColumn("regime_score", clamp(score))
    s = F.col("regime_score")
    label = (
        F.when(s >= 64, "risk_on")
        .when(s >= 56, "mildly_risk_on")
        .when(s > 44, "neutral")
        .when(s > 34, "risk_off")
        .otherwise("strong_risk_off")
    )
    drivers = lines(
        F.when(v50 >= 0, "above_50d_average").when(v50 < 0, "below_50d_average"),
        F.when(c5 <= -1.5, "broad_pullback_5d").when(c5 >= 1.5, "rise_5d"),
        F.when(vix >= 30, "vix_high_fear").when(vix >= 22, "vix_rising").when(vix < 14, "vix_calm").when(
            vix.isNotNull(), "vix_normal"
        ),
        F.when(curve < 0, "curve_inverted"),
        F.when(breadth <= 35, "breadth_weak").when(breadth >= 70, "breadth_firm"),
    )
    return (
        df.withColumn("regime", label)
        .withColumn("risk_on", F.col("regime") == "risk_on")
        .withColumn("risk_off", F.col("regime").isin("risk_off", "strong_risk_off"))
        .withColumn("regime_available", v50.isNotNull() | vix.isNotNull())
        .withColumn("drivers", drivers)
    )


def regime_multiplier(regime: Column, available: Column, direction: Column) -> Column:
    """How far the broad tape trims or supports confidence in a call."""
    off = regime.isin("risk_off", "strong_risk_off")
    on = regime == "risk_on"
    return (
        F.when(~F.coalesce(available, F.lit(False)), 1.0)
        .when(bullish(direction) & (regime == "strong_risk_off"), 0.85)
        .when(bullish(direction) & off, 0.92)
        .when(bearish(direction) & off, 1.05)
        .when(bullish(direction) & on, 1.04)
        .when(bearish(direction) & on, 0.93)
        .otherwise(1.0)
    )


def macro_score() -> Column:
    """Rules over one wide macro row; columns that are NULL add nothing."""
    curve = F.coalesce("yield_curve_10y_2y", "yield_curve_10y_5y")
    return clamp(
        _sum(
            F.lit(50.0),
            F.when(curve < 0, -10.0).when(curve >= 0, 5.0).otherwise(0.0),
            F.when(F.col("treasury_10y") > 4.5, -3.0).otherwise(0.0),
            F.when(F.col("vix") > 25, -8.0).when(F.col("vix") < 15, 6.0).otherwise(0.0),
            F.when(F.col("unemployment") > 5, -4.0).otherwise(0.0),
            F.when(F.col("fed_funds") > 5, -3.0).otherwise(0.0),
            F.when(F.col("treasury_avg_interest_rate") > 3.5, -2.0).otherwise(0.0),
        )
    )


def add_fundamental_score(facts: DataFrame) -> DataFrame:
    """Profitability, leverage and solvency of one wide facts row per company."""
    revenue, income, assets, debt, equity = (
        F.col(c) for c in ("revenue", "net_income", "assets", "liabilities", "stockholders_equity")
    )
    margin = F.try_divide(income, revenue) * 100
    leverage = F.try_divide(debt, equity)
    solvent = (assets != 0) & debt.isNotNull()
    score = _sum(
        F.lit(50.0),
        F.when(margin > 15, 12.0).when(margin > 0, 4.0).when(margin <= 0, -10.0).otherwise(0.0),
        F.when(leverage < 1, 8.0).when(leverage < 2, 2.0).when(leverage >= 2, -8.0).otherwise(0.0),
        F.when(solvent & (assets > debt), 4.0).when(solvent, -12.0).otherwise(0.0),
    )
    known = F.coalesce(revenue, income, assets, debt, equity, F.col("cash")).isNotNull()
    return (
        facts.withColumn("net_margin_pct", margin)
        .withColumn("debt_equity", leverage)
        .withColumn("fundamentals", F.when(known, clamp(score)).otherwise(50.0))
        .withColumn("fundamentals_available", known)
    )


def term_hits(events: DataFrame, by: list[str], **terms: tuple[str, ...]) -> DataFrame:
    """Number of distinct terms present in the events' text, per term list.

    One flag per term is combined map-side, so no event text is ever shuffled.
    """
    text = F.lower(F.concat_ws(" ", "title", "source", "kind"))
    flags = [
        F.max(F.contains(F.col("_text"), F.lit(t)).cast("int")).alias(f"_{name}_{i}")
        for name, words in terms.items()
        for i, t in enumerate(words)
    ]
    out = events.withColumn("_text", text).groupBy(*by).agg(*flags)
    for name, words in terms.items():
        total = sum((F.col(f"_{name}_{i}") for i in range(1, len(words))), F.col(f"_{name}_0"))
        out = out.withColumn(f"{name}_hits", F.coalesce(total, F.lit(0)))
    return out.select(*by, *[f"{name}_hits" for name in terms])


def add_broad_market(df: DataFrame) -> DataFrame:
    """Market-wide score, direction and action.

    Reads regime_score, vix, wti_oil, dollar_index, geo_hits, oil_hits,
    avg_abs_corr and event_level.
    """
    zero = F.lit(0.0)
    vix, oil, dollar = F.col("vix"), F.col("wti_oil"), F.col("dollar_index")
    geo, oil_hits = F.coalesce("geo_hits", F.lit(0)), F.coalesce("oil_hits", F.lit(0))
    start = F.when(F.col("regime_score").isNull() | (F.col("regime_score") == 0), 50.0).otherwise(F.col("regime_score"))
    df = df.withColumn(
        "_broad",
        _sum(
            start,
            F.when(vix >= 25, -9.0).when(vix <= 15, 4.0).otherwise(zero),
            F.when(oil >= 90, -5.0).when(oil <= 65, 2.0).otherwise(zero),
            F.when(dollar >= 108, -4.0).when(dollar <= 102, 2.0).otherwise(zero),
            -F.least(F.lit(12.0), 3.0 * geo),
            -F.least(F.lit(6.0), 2.0 * oil_hits),
        ),
    )
    linked = (F.col("avg_abs_corr") >= 0.65) & (F.col("_broad") < 50)
    level = F.col("event_level")
    total = (
        F.col("_broad")
        + F.when(linked, -4.0).otherwise(zero)
        + F.when(level == "high", -7.0).when(level == "extreme", -11.0).when(level == "medium", -3.0).otherwise(zero)
    )
    df = df.withColumn("broad_score", rnd_stable(clamp(total), 1)).withColumn("_exact", clamp(total))
    s = F.col("_exact")
    direction = (
        F.when(s >= 64, "risk_on")
        .when(s <= 36, "risk_off")
        .when(s <= 44, "cautious_risk_off")
        .when(s >= 56, "constructive")
        .otherwise("neutral")
    )
    # fixed values: action per market direction
    actions = {
        "risk_on": "bullish_index_bias",
        "risk_off": "bearish_index_bias",
        "cautious_risk_off": "prefer_defined_risk_or_put_research",
        "constructive": "selective_call_research",
        "neutral": "wait_for_cleaner_index_move",
    }
    df = df.withColumn("broad_direction", direction)
    action = F.lit(None).cast("string")
    for name, text in actions.items():
        action = F.when(F.col("broad_direction") == name, text).otherwise(action)
    return df.withColumn("broad_action", action).drop("_broad", "_exact")
