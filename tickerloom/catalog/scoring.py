"""Blend, risk, confidence and gate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import datasets as data
from ..operators import scoring as sc
from ..sources import config
from .base import Catalogue
from .tables_sql import COMPONENTS, clip, r, rs, with_

CATALOGUE = Catalogue()
add = CATALOGUE.add
NAMES = sc.COMPONENTS
PROFILES = ("swing", "intraday", "long_term", "options_buying", "index_trend")
SEGMENT = "CASE c_mktsegment WHEN 'BUILDING' THEN 'swing' WHEN 'AUTOMOBILE' THEN 'intraday' WHEN 'HOUSEHOLD' THEN 'long_term' WHEN 'MACHINERY' THEN 'options_buying' ELSE 'index_trend' END"

_rows = ", ".join(f"('{p}', '{k}', {w})" for p, ws in config.PROFILE_WEIGHTS.items() for k, w in zip(config.WEIGHT_KEYS, ws))
WEIGHTS = f"""w0 AS (SELECT profile, CASE component WHEN 'news_events' THEN 'sentiment' ELSE component END AS component, w::DOUBLE / SUM(w) OVER (PARTITION BY profile) AS weight FROM (VALUES {_rows}) t(profile, component, w)),
weights AS (SELECT profile, {', '.join(f"SUM(CASE WHEN component = '{n}' THEN weight ELSE 0 END) AS w_{n}" for n in (*NAMES, sc.PENALTY))} FROM w0 GROUP BY profile)"""
_u = [f"CASE WHEN c_{n} IS NOT NULL THEN w_{n} ELSE 0 END" for n in NAMES]
_plus = " + ".join
BLEND_SOURCE = f"""wide AS (SELECT ticker, {', '.join(f"MAX(CASE WHEN name = '{n}' AND available THEN score END) AS c_{n}" for n in NAMES)}, COUNT(DISTINCT name) AS given FROM components GROUP BY ticker),
b0 AS (SELECT w.*, c.c_custkey AS k, {SEGMENT} AS profile FROM wide w JOIN customer c ON c.c_custkey = w.ticker)"""
BLEND_MATH = f"""b1 AS (SELECT b.*, g.* EXCLUDE (profile), {_plus(_u)} AS tot0, ({_plus(f"(c_{n} IS NOT NULL)::INT" for n in NAMES)}) AS avail FROM b0 b JOIN weights g ON g.profile = b.profile),
b2 AS (SELECT *, CASE WHEN tot0 = 0 THEN 1 ELSE tot0 END AS tot, ({_plus(f"COALESCE(c_{n}, 0)" for n in NAMES)}) / NULLIF(avail, 0) AS mean FROM b1),
b3 AS (SELECT *, {', '.join(f"({u}) / tot AS u_{n}" for u, n in zip(_u, NAMES))}, SQRT(({_plus(f"CASE WHEN c_{n} IS NOT NULL THEN POW(c_{n} - mean, 2) ELSE 0 END" for n in NAMES)}) / NULLIF(avail, 0)) AS disp, avail / GREATEST(1, given)::DOUBLE AS coverage FROM b2),
b4 AS (SELECT *, {rs(_plus(f"COALESCE(c_{n}, 0) * u_{n}" for n in NAMES), 1)} AS opportunity_raw, CASE WHEN avail = 0 THEN 20 ELSE {rs('100 * (0.55::DOUBLE * coverage + 0.45::DOUBLE * GREATEST(0, 1 - disp / 35))', 1)} END AS data_quality FROM b3)"""
PARTS = (COMPONENTS, WEIGHTS, BLEND_SOURCE, BLEND_MATH)


def context(spark, sf_dir):
    """Blended rows with the market facts the later steps read."""
    weights = sc.widen_weights(config.resolve_weights(
        config.profile_weights(spark).select("profile"), config.default_weights(spark), config.profile_weights(spark)))
    segment = F.col("c_mktsegment")
    profile = (
        F.when(segment == "BUILDING", "swing").when(segment == "AUTOMOBILE", "intraday").when(segment == "HOUSEHOLD", "long_term")
        .when(segment == "MACHINERY", "options_buying").otherwise("index_trend")
    )
    who = data.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ticker"), profile.alias("profile"))
    wide = sc.widen(data.components(spark, sf_dir), ["ticker"]).join(who, "ticker")
    df = sc.blend(wide, weights)
    k = F.col("ticker")
    levels = F.array(*[F.lit(x) for x in ("risk_on", "risk_off", "strong_risk_off", "neutral", "mildly_risk_on")])
    tapes = F.array(*[F.lit(x) for x in ("risk_on", "risk_off", "cautious_risk_off", "constructive", "neutral")])
    radar = F.array(*[F.lit(x) for x in ("bullish_event_watch", "bearish_exhaustion_watch", "early_event_watch", "no_major_event")])
    return df.withColumns(
        {
            "has_market_data": k % 53 != 0,
            "last_volume": (k * 7919 % 2000001).cast("double"),
            "is_option_setup": k % 3 == 0,
            "total_oi": k * 131 % 900,
            "illiquid": (k * 131 % 900) < 500,
            "avg_iv": (20 + k * 17 % 90).cast("double"),
            "high_impact_count": k % 4,
            "event_count": k % 5,
            "event_level": F.when(k % 5 == 0, "quiet").when(k % 2 == 0, "high").otherwise("low"),
            "regime": F.element_at(levels, (k % 5 + 1).cast("int")),
            "regime_available": k % 11 != 0,
            "is_index": k % 2 == 0,
            "broad_direction": F.element_at(tapes, (k / 5 % 5 + 1).cast("int")),
            "news_items": k % 6,
            "policy_links": k % 3,
            "has_government": k % 7 == 0,
            "has_global": k % 5 == 0,
            "current_price": (40 + k % 150).cast("double"),
            "has_catalyst": k % 2 == 1,
            "prob_up": (k % 101) / 100.0,
            "put_call_ratio": (k % 20) / 10.0,
            "radar_verdict": F.element_at(radar, (k % 4 + 1).cast("int")),
            "day_change_pct": (k % 17 - 8) / 4.0,
            "avg_polarity": (k % 9 - 4) / 10.0,
        }
    )


CTX = """x0 AS (SELECT *, k % 53 <> 0 AS has_market_data, (k * 7919 % 2000001)::DOUBLE AS last_volume, k % 3 = 0 AS setup, k * 131 % 900 AS total_oi, (20 + k * 17 % 90)::DOUBLE AS avg_iv, k % 4 AS high_impact_count, k % 5 AS event_count,
  CASE WHEN k % 5 = 0 THEN 'quiet' WHEN k % 2 = 0 THEN 'high' ELSE 'low' END AS event_level, ['risk_on', 'risk_off', 'strong_risk_off', 'neutral', 'mildly_risk_on'][k % 5 + 1] AS regime, k % 11 <> 0 AS regime_available, k % 2 = 0 AS is_index,
  ['risk_on', 'risk_off', 'cautious_risk_off', 'constructive', 'neutral'][k // 5 % 5 + 1] AS broad, k % 6 AS news_items, k % 3 AS policy_links, k % 7 = 0 AS has_government, k % 5 = 0 AS has_global, (40 + k % 150)::DOUBLE AS current_price, k % 2 = 1 AS has_catalyst,
  (k % 101) / 100.0 AS prob_up, (k % 20) / 10.0 AS pcr, ['bullish_event_watch', 'bearish_exhaustion_watch', 'early_event_watch', 'no_major_event'][k % 4 + 1] AS radar, (k % 17 - 8) / 4.0 AS day_change_pct, (k % 9 - 4) / 10.0 AS avg_polarity FROM b4)"""
_all = ", ".join(f"c_{n}" for n in NAMES)
RISK_RULES = (
    ("NOT has_market_data", 25, "market_data_unavailable"), ("last_volume < 1000000", 12, "thin_volume"), ("setup AND (total_oi < 500 OR total_oi < 100)", 15, "thin_open_interest"), ("setup AND avg_iv > 90", 10, "very_high_iv"),
    (f"GREATEST({_all}) - LEAST({_all}) > 45", 10, "conflicting_signals"), ("data_quality < 40", 12, "low_data_quality"),
)
DIRECTION = "CASE WHEN {s} >= 70 THEN 'bullish' WHEN {s} >= 58 THEN 'neutral_to_bullish' WHEN {s} > 42 THEN 'neutral' WHEN {s} > 30 THEN 'neutral_to_bearish' ELSE 'bearish' END"
RISK = f"""x1 AS (SELECT *, GREATEST(0, LEAST(100, 30::DOUBLE + {_plus(f"CASE WHEN {c} THEN {v} ELSE 0 END" for c, v, _ in RISK_RULES)})) AS risk_score, CONCAT_WS('; ', {', '.join(f"CASE WHEN {c} THEN '{t}' END" for c, _, t in RISK_RULES)}) AS risk_reasons FROM x0),
x2 AS (SELECT *, CASE WHEN risk_score >= 80 THEN 'extreme' WHEN risk_score >= 60 THEN 'high' WHEN risk_score >= 40 THEN 'medium' ELSE 'low' END AS risk_level, NOT has_market_data OR risk_score >= 80 AS block_trade FROM x1),
x3 AS (SELECT *, {rs(f'opportunity_raw * (1 - w_{sc.PENALTY} * risk_score / 100)', 1)} AS opp FROM x2),
x4 AS (SELECT *, CASE WHEN block_trade THEN 'avoid' ELSE {DIRECTION.format(s='opp')} END AS direction, {clip('(ABS(opp - 50) - 4) / 18', 0, 1)} AS conviction FROM x3)"""


def _opposed(n: str) -> str:
    return f"COALESCE({clip(f'(CASE WHEN opp >= 50 THEN 50 - c_{n} ELSE c_{n} - 50 END) / 25', 0, 1)}, 0)"


_w = {n: f"CASE WHEN c_{n} IS NULL THEN 0 WHEN u_{n} > 0 THEN u_{n} ELSE 1 END" for n in NAMES}
CONF = f"""x5 AS (SELECT *, COALESCE(({_plus(f"({_w[n]}) * (1 - {_opposed(n)})" for n in NAMES)}) / NULLIF({_plus(f"({_w[n]})" for n in NAMES)}, 0), 0.5) AS alignment FROM x4),
x6 AS (SELECT *, {rs('100 * (0.45::DOUBLE * coverage + 0.55::DOUBLE * alignment) * (0.20::DOUBLE + 0.80::DOUBLE * conviction)', 1)} AS cf0, direction IN ('bullish', 'neutral_to_bullish') AS up, direction IN ('bearish', 'neutral_to_bearish') AS dn FROM x5),
x7 AS (SELECT *, CASE direction WHEN 'avoid' THEN LEAST(cf0, 30) WHEN 'neutral' THEN LEAST(cf0, 40) ELSE cf0 END AS cf1 FROM x6),
x8 AS (SELECT *, CASE WHEN high_impact_count > 0 AND direction <> 'avoid' THEN {rs('cf1 * 0.85::DOUBLE', 1)} ELSE cf1 END AS cf2, (CASE WHEN NOT regime_available THEN 1.0 WHEN up AND regime = 'strong_risk_off' THEN 0.85 WHEN up AND regime = 'risk_off' THEN 0.92
   WHEN dn AND regime IN ('risk_off', 'strong_risk_off') THEN 1.05 WHEN up AND regime = 'risk_on' THEN 1.04 WHEN dn AND regime = 'risk_on' THEN 0.93 ELSE 1.0 END)::DOUBLE AS mult FROM x7),
x9 AS (SELECT *, CASE WHEN mult <> 1 AND direction <> 'avoid' THEN {rs('cf2 * mult', 1)} ELSE cf2 END AS cf3, broad IN ('risk_off', 'cautious_risk_off') AS td, broad IN ('risk_on', 'constructive') AS tu FROM x8),
x10 AS (SELECT *, CASE WHEN is_index AND ((td AND up) OR (tu AND dn)) THEN {rs('cf3 * 0.9::DOUBLE', 1)} WHEN is_index AND ((td AND dn) OR (tu AND up)) THEN {rs('LEAST(100, cf3 * 1.03::DOUBLE)', 1)} ELSE cf3 END AS cf4 FROM x9)"""
_cov = {g: "FALSE" for g in sc.FACTOR_GROUPS}
_have = {n: f"c_{n} IS NOT NULL" for n in NAMES}
_cov.update(
    company_fundamentals=_have["fundamentals"], valuation=_have["fundamentals"], macroeconomic=_have["macro_regime"], government_policy="(policy_links > 0 OR has_government)", geopolitical="has_global",
    sentiment_psychology=_have["sentiment"], technical=_have["technical_structure"], options_market=_have["options_intelligence"], liquidity_structure=_have["options_intelligence"], bonds_yields_credit=_have["macro_regime"],
    currency=_have["macro_regime"], commodities=_have["macro_regime"], global_correlation="(has_global OR regime_available)", news_events="news_items > 0", seasonal_calendar="event_count > 0",
    volatility_risk=f"({_have['options_intelligence']} OR {_have['macro_regime']})", index_factors="(has_global OR regime_available)",
)
_lean = {"technical": "technical_structure", "sentiment_psychology": "sentiment", "macroeconomic": "macro_regime", "options_market": "options_intelligence", "company_fundamentals": "fundamentals", "global_correlation": "cross_market_correlation"}
COVER = f"""x11 AS (SELECT *, ({_plus(f"({c})::INT" for c in _cov.values())}) AS covered_count, CONCAT_WS('; ', {', '.join(f"CASE WHEN NOT ({c}) THEN '{g}' END" for g, c in _cov.items())}) AS missing_groups,
   CONCAT_WS('; ', {', '.join(f"CASE WHEN ({_cov[g]}) AND c_{n} >= 56 THEN '{g}' END" for g, n in _lean.items())}) AS bullish_groups, CONCAT_WS('; ', {', '.join(f"CASE WHEN ({_cov[g]}) AND c_{n} <= 44 THEN '{g}' END" for g, n in _lean.items())}) AS bearish_groups FROM x10),
x12 AS (SELECT *, {r('100.0 * covered_count / 23', 0)} AS coverage_pct FROM x11),
x13 AS (SELECT *, {rs('50 + 0.45::DOUBLE * coverage_pct', 0)} AS confidence_ceiling FROM x12),
x14 AS (SELECT *, CASE WHEN direction NOT IN ('avoid', 'neutral') AND cf4 > confidence_ceiling THEN {r('confidence_ceiling', 1)} ELSE cf4 END AS conf FROM x13)"""
GATE_SOURCE = """g0 AS (SELECT *, CASE WHEN k % 13 <> 0 THEN current_price * (1 + CASE WHEN up THEN 1 WHEN dn THEN -1 ELSE 1 END * (k % 16) / 100.0) END AS target, CASE WHEN k % 6 <> 0 THEN current_price * (1 - CASE WHEN dn THEN -1 ELSE 1 END * (1 + k % 6) / 100.0) END AS stop FROM x14)"""
GATE_STEPS = """g1 AS (SELECT *, block_trade OR direction = 'avoid' AS blocked, target IS NULL AS unknown, CASE WHEN up THEN target - current_price WHEN dn THEN current_price - target ELSE ABS(target - current_price) END AS mv, (CASE WHEN current_price < 100 THEN 5 ELSE 10 END)::DOUBLE AS fl FROM g0),
g2 AS (SELECT *, CASE WHEN NOT blocked AND NOT unknown THEN mv END AS ep, CASE WHEN NOT blocked AND NOT unknown THEN GREATEST(fl, current_price * 0.05::DOUBLE) END AS req, CASE WHEN NOT blocked AND NOT unknown THEN ABS(current_price - stop) END AS rp FROM g1),
g3 AS (SELECT *, ep / current_price * 100 AS epct, CASE WHEN rp > 0 THEN ep / rp END AS rr FROM g2),
g4 AS (SELECT *, COALESCE(ep >= req AND epct >= 5, FALSE) AS move_ok, COALESCE(rr >= 2, FALSE) AS rr_ok FROM g3),
g5 AS (SELECT *, CASE WHEN blocked THEN 1 WHEN unknown THEN 2 WHEN NOT (up OR dn) THEN 3 WHEN NOT move_ok THEN 4 WHEN NOT rr_ok THEN 5 WHEN risk_score > 55 THEN 6 WHEN conf < 55 OR opp < 60 THEN 7 ELSE 8 END AS rung FROM g4),
gated AS (SELECT *, ['rejected_high_risk', 'no_trade', 'no_trade', 'rejected_insufficient_expected_move', 'rejected_low_reward', 'rejected_high_risk', 'watchlist_only',
    CASE WHEN opp >= 70 AND conf >= 65 AND risk_score <= 45 AND has_catalyst THEN 'strong_' ELSE '' END || CASE WHEN up THEN 'bullish' ELSE 'bearish' END || '_research_candidate'][rung] AS final_label,
  ['REJECTED', 'NO_TRADE', 'NO_TRADE', 'REJECTED', 'REJECTED', 'REJECTED', 'WATCHLIST', 'VALID_RESEARCH_CANDIDATE'][rung] AS validation_status,
  ['wait_or_avoid', 'wait_or_avoid', 'wait_or_avoid', 'watch_only', 'watch_only', 'wait_or_avoid', 'watch_only', CASE WHEN up THEN 'research_long_setup' ELSE 'research_short_or_put_setup' END][rung] AS research_action,
  ['blocked_by_risk', 'no_price_or_target', 'no_directional_edge', 'move_too_small', 'reward_risk_too_low', 'risk_score_too_high', 'conviction_light', NULL][rung] AS rejected_reason FROM g5)"""
GATE = GATE_SOURCE + ",\n" + GATE_STEPS


@add("weighted_opportunity", with_(*PARTS, select=f"""
SELECT ticker, profile, avail::BIGINT AS available_count, opportunity_raw, {DIRECTION.format(s='opportunity_raw')} AS direction, {r('coverage')} AS coverage, {r('disp')} AS dispersion, data_quality, {', '.join(r(f'u_{n}') + f' AS u_{n}' for n in NAMES)} FROM b4"""))
def weighted_opportunity(spark, sf_dir):
    """Redistributed weights, blended score and evidence quality."""
    return context(spark, sf_dir).select(
        "ticker", "profile", "available_count", "opportunity_raw", sc.to_direction(F.col("opportunity_raw")).alias("direction"),
        "coverage", "dispersion", "data_quality", *[f"u_{n}" for n in NAMES],
    )


@add("risk_decision", with_(*PARTS, CTX, RISK, select=f"""
SELECT ticker, {r('risk_score')} AS risk_score, risk_level, block_trade, risk_reasons, {r('opp')} AS opportunity_score, direction, {r('conviction')} AS conviction FROM x4"""))
def risk_decision(spark, sf_dir):
    df = sc.add_opportunity(sc.add_risk(context(spark, sf_dir)))
    return df.select("ticker", "risk_score", "risk_level", "block_trade", "risk_reasons", "opportunity_score", "direction", "conviction")


def scored(spark, sf_dir):
    df = sc.add_opportunity(sc.add_risk(context(spark, sf_dir)))
    df = df.withColumn("alignment", sc.alignment(F.col("opportunity_score")))
    return sc.add_confidence(df)


@add("confidence", with_(*PARTS, CTX, RISK, CONF, select=f"""
SELECT ticker, direction, {r('alignment')} AS alignment, {r('cf4')} AS confidence, {r('mult')} AS regime_multiplier,
  CASE WHEN block_trade THEN 'P3' WHEN (opp >= 70 OR opp <= 30) AND cf4 >= 65 AND risk_level IN ('low', 'medium') THEN 'P1' WHEN opp >= 60 OR opp <= 40 THEN 'P2' ELSE 'P3' END AS severity FROM x10"""))
def confidence(spark, sf_dir):
    """Confidence after every cap and haircut, and the severity it gives."""
    df = scored(spark, sf_dir)
    level = sc.severity(F.col("opportunity_score"), F.col("confidence"), F.col("risk_level"), F.col("block_trade"))
    return df.select("ticker", "direction", "alignment", "confidence", "regime_multiplier", level.alias("severity"))


def covered(spark, sf_dir):
    return sc.apply_ceiling(sc.add_factor_coverage(scored(spark, sf_dir)))


@add("factor_coverage", with_(*PARTS, CTX, RISK, CONF, COVER, select=f"""
SELECT ticker, covered_count::BIGINT AS covered_count, coverage_pct, confidence_ceiling, {r('conf')} AS confidence, missing_groups, bullish_groups, bearish_groups FROM x14"""))
def factor_coverage(spark, sf_dir):
    return covered(spark, sf_dir).select(
        "ticker", "covered_count", "coverage_pct", "confidence_ceiling", "confidence", "missing_groups", "bullish_groups", "bearish_groups"
    )


def gated(spark, sf_dir):
    from ..functions.numeric import bearish, bullish

    k, d, price = F.col("ticker"), F.col("direction"), F.col("current_price")
    sign = F.when(bullish(d), 1).when(bearish(d), -1).otherwise(1)
    away = F.when(bearish(d), -1).otherwise(1)
    df = covered(spark, sf_dir).withColumn("target_price", F.when(k % 13 != 0, price * (1 + sign * (k % 16) / 100.0)))
    df = df.withColumn("stop_price", F.when(k % 6 != 0, price * (1 - away * (1 + k % 6) / 100.0)))
    return sc.add_candidate_gate(df)


@add("candidate_gate", with_(*PARTS, CTX, RISK, CONF, COVER, GATE, select=f"""
SELECT ticker, {r('ep')} AS expected_points, {r('epct')} AS expected_percent, {r('req')} AS final_required_points, {r('rr')} AS reward_risk_ratio, move_ok, rr_ok, final_label, validation_status, research_action, rejected_reason FROM gated"""))
def candidate_gate(spark, sf_dir):
    return gated(spark, sf_dir).select(
        "ticker", "expected_points", "expected_percent", "final_required_points", "reward_risk_ratio", "move_ok", "rr_ok",
        "final_label", "validation_status", "research_action", "rejected_reason",
    )


@add("research_verdict", with_(*PARTS, CTX, RISK, CONF, COVER, GATE, select="""
SELECT ticker, CASE validation_status WHEN 'VALID_RESEARCH_CANDIDATE' THEN CASE WHEN CONTAINS(final_label, 'bull') THEN 'BULLISH' ELSE 'BEARISH' END || ' / ' || CASE WHEN CONTAINS(final_label, 'strong') THEN 'strong' ELSE 'moderate' END
  WHEN 'WATCHLIST' THEN 'WATCHLIST' WHEN 'REJECTED' THEN 'REJECTED' ELSE 'NO TRADE' END AS verdict FROM gated"""))
def research_verdict(spark, sf_dir):
    """The gate's verdict on every name."""
    from ..operators.option_reports import bull_bear_verdict

    verdict = bull_bear_verdict(F.col("validation_status"), F.col("final_label"))
    return gated(spark, sf_dir).select("ticker", verdict.alias("verdict"))


@add("verdict_reasons", with_(*PARTS, CTX, RISK, CONF, COVER, GATE, """vr AS (SELECT *, LIST_FILTER([
   CASE WHEN rejected_reason IS NOT NULL THEN '[' || validation_status || '] ' || rejected_reason END, CASE WHEN direction = 'neutral' AND (opp <= 48 OR prob_up <= 0.45 OR radar = 'bearish_exhaustion_watch') THEN 'bearish_pressure_watch' END,
   CASE WHEN up THEN 'score_leans_bullish' WHEN dn THEN 'score_leans_bearish' WHEN direction = 'avoid' THEN 'risk_manager_blocked' ELSE 'signals_mixed' END, CASE WHEN radar IN ('bullish_event_watch', 'early_event_watch') THEN 'event_radar:' || radar END,
   CASE WHEN radar = 'bearish_exhaustion_watch' THEN 'exhaustion_risk' END, CASE WHEN prob_up >= 0.58 THEN 'forecast_up' WHEN prob_up <= 0.42 THEN 'forecast_down' END, CASE WHEN policy_links > 0 THEN 'policy_clue' END,
   CASE WHEN high_impact_count > 0 AND direction <> 'avoid' THEN 'scheduled_event_risk' END, CASE WHEN event_count > 0 THEN 'event_impact:' || event_level END, CASE WHEN mult <> 1 THEN 'regime:' || regime END], lambda x: x IS NOT NULL) AS why FROM gated)""", select="""
SELECT ticker, ARRAY_TO_STRING(why[1:6], '; ') AS reasons,
  CONCAT_WS(' | ', printf('price %+.2f%% today', day_change_pct::DOUBLE), CAST(news_items AS VARCHAR) || ' news', CASE WHEN news_items > 0 THEN 'tone ' || CASE WHEN avg_polarity > 0.1 THEN 'bullish' WHEN avg_polarity < -0.1 THEN 'bearish' ELSE 'mixed' END END,
    CASE WHEN policy_links > 0 THEN CAST(policy_links AS VARCHAR) || ' policy links' END, CASE WHEN event_count > 0 THEN 'events ' || event_level END) AS trend,
  CONCAT_WS('; ', CASE WHEN c_fundamentals IS NULL THEN 'fundamentals' END, CASE WHEN c_options_intelligence IS NULL THEN 'options' END, CASE WHEN c_macro_regime IS NULL THEN 'macro' END, CASE WHEN c_sentiment IS NULL THEN 'sentiment' END,
    CASE WHEN c_cross_market_correlation IS NULL THEN 'cross_market' END, CASE WHEN NOT has_market_data THEN 'live_market_data' END) AS missing FROM vr"""))
def verdict_reasons(spark, sf_dir):
    df = gated(spark, sf_dir)
    return df.select("ticker", sc.verdict_reasons().alias("reasons"), sc.trend_summary().alias("trend"), sc.missing_data().alias("missing"))


@add("signal_confluence", with_(*PARTS, CTX, RISK, CONF, """cfl AS (SELECT ticker, direction, COALESCE((up AND c_technical_structure >= 55) OR (dn AND c_technical_structure <= 45), FALSE)::INT + COALESCE((up AND c_price_volume_momentum >= 55) OR (dn AND c_price_volume_momentum <= 45), FALSE)::INT
   + ((up AND opp >= 58) OR (dn AND opp <= 42))::INT + ((up AND prob_up >= 0.55) OR (dn AND prob_up <= 0.45))::INT + ((up AND pcr < 0.9) OR (dn AND pcr > 1.1))::INT AS votes FROM x10)""", select="""
SELECT ticker, direction, votes::BIGINT AS votes, CASE WHEN votes >= 4 THEN 'strong' WHEN votes >= 2 THEN 'moderate' ELSE 'weak' END AS label FROM cfl"""))
def signal_confluence(spark, sf_dir):
    df = scored(spark, sf_dir)
    votes = sc.confluence(
        F.col("direction"), F.col("c_technical_structure"), F.col("c_price_volume_momentum"), F.col("opportunity_score"),
        F.col("prob_up"), F.col("put_call_ratio"),
    )
    return df.select("ticker", "direction", votes.alias("votes")).withColumn("label", sc.confluence_label(F.col("votes")))


@add("ranked_signals", with_(*PARTS, CTX, RISK, CONF, COVER, GATE, select=f"""
SELECT ticker, {r('opp')} AS opportunity_score, {r('conf')} AS confidence, {r('risk_score')} AS risk_score, final_label, ROW_NUMBER() OVER (ORDER BY opp DESC, ticker) AS place FROM gated ORDER BY opp DESC, ticker LIMIT 50"""))
def ranked_signals(spark, sf_dir):
    """The fifty best names by risk-adjusted opportunity."""
    from pyspark.sql import Window

    top = sc.rank_by_opportunity(gated(spark, sf_dir), 50)
    # fifty rows are left, so one ordered window numbers them
    place = F.row_number().over(Window.orderBy(F.desc("opportunity_score"), "ticker"))
    return top.select("ticker", "opportunity_score", "confidence", "risk_score", "final_label", place.alias("place"))


WL = f"""wn AS (SELECT *, [{', '.join(f"'{k}'" for k in config.WEIGHT_KEYS)}][p_partkey % 10 + 1] AS component FROM part),
wd AS (SELECT component, COUNT(*)::DOUBLE AS weight FROM wn GROUP BY 1),
wo AS (SELECT p_type AS profile, component, COUNT(*)::DOUBLE AS weight FROM wn WHERE p_size % 3 = 0 GROUP BY 1, 2),
wf AS (SELECT p_type AS profile, component, SUM(p_size)::DOUBLE AS weight FROM wn WHERE p_type LIKE 'E%' AND p_partkey % 10 < 7 GROUP BY 1, 2),
wp AS (SELECT DISTINCT p_type AS profile FROM part),
wr AS (SELECT p.profile, d.component, COALESCE(o.weight, d.weight) AS weight FROM wp p CROSS JOIN wd d LEFT JOIN wo o ON o.profile = p.profile AND o.component = d.component WHERE p.profile NOT IN (SELECT profile FROM wf)
  UNION ALL SELECT * FROM wf)"""


@add("weight_profiles", with_(WL, select=f"SELECT profile, component, {r('weight / SUM(weight) OVER (PARTITION BY profile)')} AS weight FROM wr"))
def weight_profiles(spark, sf_dir):
    """Profiles resolved from defaults, own values and fitted values."""
    keys = F.array(*[F.lit(k) for k in config.WEIGHT_KEYS])
    part = data.table(spark, sf_dir, "part").withColumn("component", F.element_at(keys, (F.col("p_partkey") % 10 + 1).cast("int")))
    part = part.withColumn("profile", F.col("p_type"))
    count = F.count(F.lit(1)).cast("double").alias("weight")
    default = part.groupBy("component").agg(count)
    own = part.where(F.col("p_size") % 3 == 0).groupBy("profile", "component").agg(count)
    fitted = part.where(F.col("p_type").startswith("E") & (F.col("p_partkey") % 10 < 7))
    fitted = fitted.groupBy("profile", "component").agg(F.sum("p_size").cast("double").alias("weight"))
    return config.resolve_weights(part.select("profile"), default, own, fitted)
