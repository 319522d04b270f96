"""The full scan: every engine on the latest bar, blended, gated and ranked.

One row per ticker comes out of each engine and all of them meet on the ticker, so
the plan has one exchange for the bar windows and joins of small aggregates after
it.  Tables that describe the whole market hold one row per market and are
broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import pct_change
from ..operators import calendar as cal
from ..operators import indicators as ind
from ..operators import options as opt
from ..operators import regime, scoring, series, signals
from ..operators import text as txt
from ..session import cut_lineage

LOOKBACK = max(ind.SCORE_LOOKBACK, signals.RADAR_LOOKBACK + 1, signals.FORECAST_LOOKBACK)


@dataclass
class ScanTables:
    """Input tables of a scan.

    bars, benchmark and index_bars carry `pos` and `n`; macro is one wide row; links
    are policy links (ticker per row); calendar is the market-event table; assets has
    ticker, profile and is_index.
    """

    bars: DataFrame
    benchmark: DataFrame
    index_bars: DataFrame
    chain: DataFrame
    macro: DataFrame
    headlines: DataFrame
    social: DataFrame | None
    facts: DataFrame
    links: DataFrame
    events: DataFrame
    calendar: DataFrame
    reports: DataFrame
    assets: DataFrame
    weights: DataFrame


def price_engines(bars: DataFrame, horizon_days: int) -> DataFrame:
    """Latest-bar columns of all price engines from one windowed pass."""
    df = series.tail(bars, LOOKBACK)
    df = signals.add_pattern_adjusted_score(signals.add_technical_score(df))
    df = signals.add_price_volume_score(df)
    df = signals.add_forecasts(df, {"h3": 3, "hx": horizon_days})
    df = ind.add_realized_vol(df)
    return series.latest(df).where(F.col("pos") >= 30)


def relative_strength(bars: DataFrame, benchmark: DataFrame) -> DataFrame:
    joint = series.with_positions(signals.join_benchmark(bars, benchmark))
    df = series.latest(signals.add_relative_strength(series.tail(joint, 21)))
    return df.select("ticker", F.when(F.col("cross_market_available"), F.col("cross_market_correlation")).alias("c_cross_market_correlation"))


def market_context(t: ScanTables) -> DataFrame:
    """One row: regime, macro values, breadth, event-term hits of the market."""
    bench = series.latest(regime.add_benchmark_structure(series.tail(t.benchmark, 50)))
    index = t.index_bars.where(F.col("pos") >= F.col("n") - 5)
    up = index.where(F.col("n") >= 6).groupBy("index_name").agg(
        (F.max_by("close", "date") >= F.min_by("close", "date")).cast("double").alias("up")
    )
    key = F.lit("all").alias("market")
    breadth = up.agg(F.rint(100.0 * F.avg("up")).alias("breadth_pct")).select(key, "breadth_pct")
    hits = regime.term_hits(t.events, [], geo=regime.GEO_TERMS, oil=regime.OIL_TERMS, policy=regime.POLICY_TERMS)
    macro = t.macro.withColumn("curve", F.coalesce("yield_curve_10y_2y", "yield_curve_10y_5y")).withColumn(
        "c_macro_regime", regime.macro_score()
    )
    bench = bench.select(key, F.col("date").alias("as_of"), "vs_20dma_pct", "vs_50dma_pct", "change_5d_pct", "change_20d_pct")
    one = bench.join(macro.select(key, "*"), "market", "left").join(breadth, "market", "left").join(hits.select(key, "*"), "market", "left")
    return regime.add_regime(one)


def scan(t: ScanTables, profile: str = "swing", horizon_days: int = 5) -> DataFrame:
    """Gated prediction of every ticker for one strategy profile."""
    price = price_engines(t.bars, horizon_days).select(
        "ticker",
        F.col("date").alias("bar_date"),
        F.col("close").alias("current_price"),
        "prev_close",
        F.col("volume").alias("last_volume"),
        "atr",
        "realized_vol",
        F.col("technical_structure").alias("c_technical_structure"),
        F.col("price_volume_momentum").alias("c_price_volume_momentum"),
        F.when(F.col("forecast_available"), F.col("hx_score")).alias("c_ensemble_forecast"),
        F.col("hx_prob_up").alias("prob_up"),
        F.col("hx_expected_return_pct").alias("expected_return_pct"),
        F.col("hx_p05_return_pct").alias("p05_return_pct"),
    )
    metrics = opt.expiry_metrics(t.chain, ["ticker", "dte"])
    nearest = opt.select_expiries(metrics, n=1).select(
        "ticker", opt.component_score().alias("c_options_intelligence"), "put_call_ratio", "avg_iv", "illiquid", "total_oi"
    )
    mood = txt.sentiment(t.headlines, t.social).select(
        "ticker", F.col("sentiment").alias("c_sentiment"), F.col("headline_count").alias("news_items"), "avg_polarity"
    )
    facts = regime.add_fundamental_score(t.facts).select(
        "ticker", F.when(F.col("fundamentals_available"), F.col("fundamentals")).alias("c_fundamentals")
    )
    links = t.links.groupBy("ticker").agg(F.count(F.lit(1)).alias("policy_links"))
    world = signals.correlation_map(signals.global_correlations(t.bars, t.index_bars)).select("ticker", "avg_abs_corr")
    market = market_context(t)

    df = price.join(t.assets.select("ticker", "is_index"), "ticker")
    for part in (relative_strength(t.bars, t.benchmark), nearest, mood, facts, links, world):
        df = df.join(part, "ticker", "left")
    # one row per ticker from here on: the engines' plan ends in the shared folder, so
    # that adaptive re-planning of the scoring steps does not carry it along
    df = cut_lineage(df)
    market = cut_lineage(market)
    df = df.withColumn("market", F.lit("all")).join(market, "market")
    df = df.withColumns(
        {
            "profile": F.lit(profile),
            "given": F.lit(len(scoring.COMPONENTS)),
            "has_market_data": F.lit(True),
            "is_option_setup": F.lit(profile).isin("options_buying", "options_selling"),
            "has_government": F.col("geo_hits").isNotNull(),
            "has_global": F.col("avg_abs_corr").isNotNull(),
            "day_change_pct": pct_change(F.col("current_price"), F.col("prev_close")),
        }
    )
    df = scoring.add_opportunity(scoring.add_risk(scoring.blend(df, scoring.widen_weights(t.weights))))

    reports = t.reports.select("ticker", "days_to_earnings")
    calls = df.join(reports, "ticker", "left").withColumn("horizon_days", F.lit(horizon_days))
    df = cal.add_event_risk(calls, cal.market_load(t.calendar, [horizon_days]))
    df = regime.add_broad_market(df)
    df = scoring.add_confidence(df)
    df = scoring.apply_ceiling(scoring.add_factor_coverage(df))
    target, stop = signals.target_and_stop(
        F.col("direction"), F.col("current_price"), F.col("expected_return_pct"), F.col("p05_return_pct"), F.col("atr")
    )
    df = df.withColumn("target_price", target).withColumn("stop_price", stop)
    df = df.withColumn("has_catalyst", F.coalesce(F.col("news_items"), F.lit(0)) > 0)
    df = scoring.add_candidate_gate(df)
    level = scoring.severity(F.col("opportunity_score"), F.col("confidence"), F.col("risk_level"), F.col("block_trade"))
    return df.withColumn("severity", level)


def expiry_ideas(predictions: DataFrame, chain: DataFrame, iv_history: DataFrame, stored: DataFrame, as_of: Column, min_index_points: float = 50.0) -> DataFrame:
    """Option ideas of every expiry under each ticker's prediction.

    The history knows expiries by date, so a chain's days to expiry are counted from ``as_of``.
    """
    metrics = opt.add_skew(opt.add_term_structure(opt.expiry_metrics(chain, ["ticker", "dte"])))
    metrics = opt.join_previous_oi(metrics, stored)
    expiry = F.date_add(as_of, F.col("dte").cast("int")).cast("string")
    current = metrics.select("ticker", "dte", expiry.alias("expiration"), F.col("avg_iv").alias("current_iv"))
    ranks = opt.iv_rank(current, iv_history).select("ticker", "dte", "iv_rank", "iv_percentile", "iv_history_scope")
    d = F.col("direction")
    votes = scoring.confluence(
        d, F.col("c_technical_structure"), F.col("c_price_volume_momentum"), F.col("opportunity_score"), F.col("prob_up"), F.col("put_call_ratio")
    )
    lean = F.when(d.isin("bullish", "neutral_to_bullish"), "up").when(d.isin("bearish", "neutral_to_bearish"), "down").otherwise("neutral")
    signal = predictions.select(
        "ticker",
        lean.alias("signal_direction"),
        "conviction",
        "data_quality",
        votes.alias("algo_confluence"),
        F.col("risk_score").alias("ticker_risk"),
        F.col("realized_vol"),
        "days_to_earnings",
        "is_index",
        F.abs(F.col("expected_return_pct") / 100.0 * F.col("current_price")).alias("expected_points"),
        F.lit(min_index_points).alias("min_index_points"),
    )
    return opt.add_expiry_ideas(metrics.join(signal, "ticker").join(ranks, ["ticker", "dte"], "left"))


def ranked(predictions: DataFrame, limit: int | None = None) -> DataFrame:
    return scoring.rank_by_opportunity(predictions, limit)
