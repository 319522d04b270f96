"""Whole-run queries: the full scan and its option ideas."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from .. import datasets as data
from ..operators import calendar as cal
from ..operators import options as opt
from ..operators import regime
from ..operators import text as txt
from ..plans import scan as plan
from ..session import cut_lineage
from ..sources import config, filings, macro
from . import chains, feeds, market
from .base import Catalogue
from .scoring import BLEND_MATH, CONF, COVER, GATE_STEPS, RISK, WEIGHTS
from .tables_sql import ASSETS, BENCH, CHAIN, GOV_EVENTS, INDEX_BARS, IV_SNAPSHOTS, MACRO, NEWS, clip, r, rs, with_
from .timeseries import GC, GCP, JOINT, LOGRET, PATTERNS, PV, SIGNED, STATS, TECH_PARTS, VOTES, band

CATALOGUE = Catalogue()
add = CATALOGUE.add

_terms = f"{market._hit_sql(regime.GEO_TERMS)} AS geo_hits, {market._hit_sql(regime.OIL_TERMS)} AS oil_hits, {market._hit_sql(regime.POLICY_TERMS)} AS policy_hits"
_forecast = rs("COALESCE(" + clip(f"0.5::DOUBLE * vote_score + 0.5::DOUBLE * (50 + ({band(5)['prob_up']} - 0.5::DOUBLE) * 60)") + ", vote_score)", 1)
_regime_rows = market.REGIME[: market.REGIME.index("rg2 AS (SELECT g.*")].rstrip().rstrip(",")
MARKET_SQL = f"""scm AS (SELECT {', '.join(f"MAX(CASE WHEN series = '{s}' THEN value END) AS {s}" for s in market.SNAP_SERIES)} FROM macro_latest),
sch AS (SELECT {_terms} FROM (SELECT LOWER(CONCAT_WS(' ', title, source, kind)) AS t FROM gov_events)),
scb AS (SELECT {r('100.0 * AVG(up)', 0)} AS breadth_pct FROM (SELECT CASE WHEN MAX_BY(close, date) >= MIN_BY(close, date) THEN 1.0 ELSE 0.0 END AS up FROM index_bars WHERE pos >= n - 5 AND n >= 6 GROUP BY index_name)),
mk0 AS (SELECT g.v20, g.v50, g.c5, g.date AS as_of, m.*, m.yield_curve_10y_2y AS curve, b.breadth_pct, h.* FROM rg g, scm m, scb b, sch h WHERE g.pos = (SELECT MAX(pos) FROM bench)),
mk1 AS (SELECT *, {market.REG_SCORE} AS regime_score, v50 IS NOT NULL OR vix IS NOT NULL AS regime_available, {clip(market.MACRO_SCORE)} AS c_macro_regime FROM mk0),
mk AS (SELECT *, {market.REG_LABEL} AS regime FROM mk1)"""
ENGINES = f"""sopt AS (SELECT ticker, {chains.OPTIONS_SCORE} AS c_options_intelligence, avg_iv, total_oi FROM metrics QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY dte) = 1),
s15 AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY published_at DESC NULLS LAST, priority, news_id) AS rn FROM pol) WHERE rn <= 15),
smood AS (SELECT ticker, {clip('50 + AVG(polarity) * 35')} AS c_sentiment, COUNT(*) AS news_items FROM s15 GROUP BY 1),
sfund AS (SELECT cik AS ticker, CASE WHEN COALESCE(revenue, net_income, assets, liabilities, stockholders_equity, cash) IS NOT NULL THEN {market.FUND} END AS c_fundamentals
  FROM (SELECT *, net_income / NULLIF(revenue, 0) * 100 AS m, liabilities / NULLIF(stockholders_equity, 0) AS de FROM facts)),
slink AS (SELECT SPLIT_PART(ticker, '.', 1) AS ticker, COUNT(*) AS policy_links FROM impacts GROUP BY 1),
sworld AS (SELECT ticker, AVG(ABS(corr)) AS avg_abs_corr FROM gc GROUP BY 1),
srs AS (SELECT ticker, CASE WHEN rs IS NOT NULL THEN {clip('50 + ' + clip('rs * 1.2::DOUBLE', -20, 20))} END AS c_cross_market_correlation FROM rstr WHERE pos = n),
sload AS (SELECT m.as_of, COUNT(c.kind) AS ev, COALESCE(SUM(CASE WHEN c.impact = 'high' THEN 1 ELSE 0 END), 0) AS hi, COALESCE(SUM({market.PTS.replace('p.as_of', 'm.as_of')}), 0) AS pts FROM mk m LEFT JOIN cal c ON c.date BETWEEN m.as_of AND m.as_of + 5 GROUP BY 1),
searn AS (SELECT ticker, date_diff('day', DATE '2001-11-30', d) AS dte FROM earn),
sc0 AS (SELECT t.ticker, t.close AS current_price, t.volume AS last_volume, t.atr, CAST(SUBSTRING(t.ticker, 7) AS BIGINT) % 5 = 0 AS is_index, GREATEST(0, LEAST(100, t.technical_score + p.bias * 6)) AS c_technical_structure, v.pv_score AS c_price_volume_momentum,
   {_forecast} AS c_ensemble_forecast, {r(band(5)['expected_return_pct'], 2)} AS ret, {r(band(5)['p05_return_pct'], 2)} AS p05
   FROM tech t JOIN pt3 p ON p.ticker = t.ticker AND p.pos = t.pos JOIN pvs v ON v.ticker = t.ticker AND v.pos = t.pos JOIN st s ON s.ticker = t.ticker AND s.pos = t.pos WHERE t.pos = t.n AND t.n >= 30),
sc1 AS (SELECT c.*, x.c_cross_market_correlation, o.c_options_intelligence, o.avg_iv, o.total_oi, m.c_sentiment, COALESCE(m.news_items, 0) AS news_items, f.c_fundamentals, COALESCE(l.policy_links, 0) AS policy_links, w.avg_abs_corr, k.* EXCLUDE (as_of), k.as_of AS mk_date,
   d.ev, d.hi, d.pts, e.dte, COALESCE(e.dte BETWEEN 0 AND 5, FALSE) AS own FROM sc0 c LEFT JOIN srs x ON x.ticker = c.ticker LEFT JOIN sopt o ON o.ticker = c.ticker LEFT JOIN smood m ON m.ticker = c.ticker LEFT JOIN sfund f ON f.ticker = c.ticker
   LEFT JOIN slink l ON l.ticker = c.ticker LEFT JOIN sworld w ON w.ticker = c.ticker LEFT JOIN searn e ON e.ticker = c.ticker, mk k, sload d),
sc2 AS (SELECT *, ev + own::INT AS event_count, hi + own::INT AS high_impact_count, LEAST(100, {rs(f'(pts + ({market.OWN})) * 0.75::DOUBLE + GREATEST(0, hi + own::INT - 1) * 8', 1)}) AS evs FROM sc1),
sc3 AS (SELECT *, CASE WHEN evs >= 75 THEN 'extreme' WHEN evs >= 55 THEN 'high' WHEN evs >= 30 THEN 'medium' WHEN evs > 0 THEN 'low' ELSE 'quiet' END AS lvl, {market.BROAD_BASE} AS base FROM sc2),
sc4 AS (SELECT *, lvl AS event_level, {market.BROAD_SCORE} AS s FROM sc3),
b0 AS (SELECT *, {market.BROAD_DIRECTION} AS broad, 'swing' AS profile, 8 AS given FROM sc4)"""
CONTEXT = "x0 AS (SELECT *, TRUE AS has_market_data, FALSE AS setup, TRUE AS has_government, avg_abs_corr IS NOT NULL AS has_global, news_items > 0 AS has_catalyst FROM b4)"
LEVELS = f"""g0 AS (SELECT *, {r('current_price * (1 + (CASE WHEN dn AND ret > 0 THEN -ret ELSE ret END) / 100)', 4)} AS target,
  CASE WHEN ret IS NOT NULL THEN {r('current_price + (CASE WHEN dn THEN 1 ELSE -1 END) * (CASE WHEN atr > 0 THEN LEAST(GREATEST(1.5 * atr, current_price * 0.025::DOUBLE), current_price * 0.10::DOUBLE) ELSE current_price * LEAST(GREATEST(COALESCE(ABS(p05) / 100 * 0.75::DOUBLE, 0.045), 0.035), 0.095) END)', 4)} END AS stop FROM x14)"""
SCAN_SQL = (
    *TECH_PARTS, PATTERNS, SIGNED, PV, LOGRET, VOTES, STATS, BENCH, JOINT, INDEX_BARS, GC, GCP, CHAIN, chains.METRICS, NEWS, feeds.NEWS_O,
    feeds.polarity_cte(feeds.tx.NEWS_POSITIVE, feeds.tx.NEWS_NEGATIVE), GOV_EVENTS, ASSETS, feeds.IMPACT, MACRO, market.LATEST, market.FACTS.replace("SELECT o_custkey AS cik", "SELECT 'Brand#' || CAST(1 + o_custkey % 25 AS VARCHAR) AS cik"), market.CURATED, market.RULES,
    market.EARN.replace("1998-06-15", "2001-11-30"), _regime_rows, MARKET_SQL, ENGINES, WEIGHTS, BLEND_MATH, CONTEXT, RISK, CONF, COVER, LEVELS, GATE_STEPS,
)
SCAN_SELECT = f"""ticker, direction, {r('opp')} AS opportunity_score, {r('conf')} AS confidence, {r('risk_score')} AS risk_score, risk_level,
  CASE WHEN block_trade THEN 'P3' WHEN (opp >= 70 OR opp <= 30) AND conf >= 65 AND risk_level IN ('low', 'medium') THEN 'P1' WHEN opp >= 60 OR opp <= 40 THEN 'P2' ELSE 'P3' END AS severity, data_quality, regime, broad AS broad_direction, event_level,
  coverage_pct, confidence_ceiling, {r('target')} AS target_price, {r('stop')} AS stop_price, {r('rr')} AS reward_risk_ratio, final_label, validation_status, research_action, rejected_reason FROM gated"""


def tables(spark, sf_dir) -> plan.ScanTables:
    """Scan inputs from the given tables."""
    # three engines read the bars; their lineage is cut once instead of run three times
    bars = cut_lineage(data.numbered_bars(spark, sf_dir))
    # a ticker is one company here, whose filings come under several numbers
    ticker = F.concat(F.lit("Brand#"), (1 + F.col("cik") % 25).cast("string"))
    facts = filings.latest_facts(market.fact_rows(spark, sf_dir).withColumn("cik", ticker))
    links = txt.map_impacts(data.assets(spark, sf_dir), data.gov_events(spark, sf_dir), feeds.TAGS)
    links = links.withColumn("ticker", F.substring_index("ticker", ".", 1))
    latest = macro.latest_observation(data.macro_observations(spark, sf_dir))
    both = latest.groupBy().pivot("series", list(macro.SERIES)).agg(F.max("value")).withColumn("yield_curve_10y_5y", F.lit(None).cast("double"))
    names = data.table(spark, sf_dir, "part").select(F.col("p_brand").alias("ticker")).distinct()
    number = F.substring("ticker", 7, 10).cast("long")
    own = config.profile_weights(spark)
    return plan.ScanTables(
        bars=bars,
        benchmark=cut_lineage(data.numbered_benchmark(spark, sf_dir)),
        index_bars=cut_lineage(data.numbered_index_bars(spark, sf_dir)),
        chain=chains.contracts(spark, sf_dir),
        macro=both,
        headlines=feeds.news(spark, sf_dir),
        social=None,
        facts=facts.withColumnRenamed("cik", "ticker"),
        links=links,
        events=data.gov_events(spark, sf_dir),
        calendar=market.calendar(spark, sf_dir),
        reports=cal.next_report_date(market.report_dates(spark, sf_dir), F.lit("2001-11-30").cast("date")),
        assets=names.withColumn("is_index", number % 5 == 0),
        weights=config.resolve_weights(own.select("profile"), config.default_weights(spark), own),
    )


def predictions(spark, sf_dir):
    return plan.scan(tables(spark, sf_dir), "swing", 5)


SCAN_COLUMNS = [
    "ticker", "direction", "opportunity_score", "confidence", "risk_score", "risk_level", "severity", "data_quality", "regime",
    "broad_direction", "event_level", "coverage_pct", "confidence_ceiling", "target_price", "stop_price", "reward_risk_ratio",
    "final_label", "validation_status", "research_action", "rejected_reason",
]


@add("full_scan", with_(*SCAN_SQL, select=f"SELECT {SCAN_SELECT}"))
def full_scan(spark, sf_dir):
    """Every ticker's gated prediction for the swing profile."""
    return predictions(spark, sf_dir).select(*SCAN_COLUMNS)


@add("full_scan_leaders", with_(*SCAN_SQL, select=f"SELECT {SCAN_SELECT} ORDER BY opp DESC, ticker LIMIT 10"))
def full_scan_leaders(spark, sf_dir):
    """The ten best names of the scan."""
    return plan.ranked(predictions(spark, sf_dir), 10).select(*SCAN_COLUMNS)


HISTORY = f"""ivm AS (SELECT 'Brand#' || CAST(1 + CAST(ticker AS BIGINT) % 25 AS VARCHAR) AS ticker, seq, as_of, expiration, avg_iv FROM iv_snapshots QUALIFY ROW_NUMBER() OVER (PARTITION BY 'Brand#' || CAST(1 + CAST(ticker AS BIGINT) % 25 AS VARCHAR) ORDER BY as_of DESC, seq DESC) <= 250),
ivz AS (SELECT ticker, COUNT(*) AS cnt, MIN(avg_iv) AS lo, MAX(avg_iv) AS hi FROM ivm GROUP BY 1),
ivx AS (SELECT ticker, expiration, MIN(avg_iv) AS lo, MAX(avg_iv) AS hi FROM ivm GROUP BY 1, 2 HAVING COUNT(*) >= 20)"""
_confluence = """COALESCE((up AND c_technical_structure >= 55) OR (dn AND c_technical_structure <= 45), FALSE)::INT + COALESCE((up AND c_price_volume_momentum >= 55) OR (dn AND c_price_volume_momentum <= 45), FALSE)::INT
   + ((up AND opp >= 58) OR (dn AND opp <= 42))::INT + COALESCE((up AND prob >= 0.55) OR (dn AND prob <= 0.45), FALSE)::INT + COALESCE((up AND near_pcr < 0.9) OR (dn AND near_pcr > 1.1), FALSE)::INT"""
SIGNAL_SQL = f"""gx0 AS (SELECT g.*, s.prob, s.rv, m.put_call_ratio AS near_pcr FROM gated g
    JOIN (SELECT ticker, {r(band(5)['prob_up'], 3)} AS prob, rv, pos, n FROM (SELECT st.*, STDDEV_SAMP(lr) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) * SQRT(252::DOUBLE) * 100 AS rv FROM st) WHERE pos = n) s ON s.ticker = g.ticker
    LEFT JOIN (SELECT * FROM metrics QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY dte) = 1) m ON m.ticker = g.ticker),
gx1 AS (SELECT ticker, CASE WHEN up THEN 'up' WHEN dn THEN 'down' ELSE 'neutral' END AS lean, conviction, data_quality, {_confluence} AS algo, risk_score AS ticker_risk, rv AS realized_vol, dte AS days_to_earnings, is_index, ABS(ret / 100 * current_price) AS expected_points FROM gx0),
sig2 AS (SELECT t.*, g.* EXCLUDE (ticker), CASE WHEN z.cnt >= 20 AND t.avg_iv IS NOT NULL THEN {rs(clip('CASE WHEN COALESCE(x.hi, z.hi) <= COALESCE(x.lo, z.lo) THEN 50 ELSE (t.avg_iv - COALESCE(x.lo, z.lo)) / (COALESCE(x.hi, z.hi) - COALESCE(x.lo, z.lo)) * 100 END'), 1)} END AS iv_rank,
    CASE WHEN z.cnt >= 20 AND t.avg_iv IS NOT NULL THEN CASE WHEN x.lo IS NOT NULL THEN 'exact_expiration' ELSE 'ticker' END END AS iv_history_scope
    FROM term t JOIN gx1 g ON g.ticker = t.ticker LEFT JOIN ivz z ON z.ticker = t.ticker LEFT JOIN ivx x ON x.ticker = t.ticker AND x.expiration = CAST(DATE '2024-02-02' + t.dte::INT AS VARCHAR))"""
_steps = chains.SIGNAL[chains.SIGNAL.index("s3 AS (SELECT") :].replace("CASE WHEN c.contract_id % 3 <> 0 THEN c.oi - 40 * (c.contract_id % 5 - 2) END AS prev", "c.oi - 40 AS prev")


def _materialised(sql: str) -> str:
    """Keep DuckDB from expanding these steps into one another."""
    for name in ("x4", "x10", "x14", "gated", "sig2", "s6", "s7b", "s8", "s12", "s13", "ideas", "metrics", "term", "sc1", "b4"):
        sql = re.sub(rf"(^|\n){name} AS \(", rf"\1{name} AS MATERIALIZED (", sql)
    return sql


@add("scan_expiry_ideas", _materialised(with_(*SCAN_SQL, IV_SNAPSHOTS, HISTORY, chains.TERM, SIGNAL_SQL, _steps, chains.IDEAS, select=f"""
SELECT * FROM (SELECT ticker, dte::BIGINT AS dte, action, {r('gconf')} AS confidence, {r('option_quality')} AS option_quality, risk_gate, {chains.READY} AS readiness, iv_rank, iv_history_scope, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY gconf DESC, dte) AS rank FROM ideas) WHERE rank <= 3""")))
def scan_expiry_ideas(spark, sf_dir):
    """The three best expiries of every scanned ticker."""
    stored = data.chain(spark, sf_dir).select(
        "ticker", F.col("contract_id").cast("string").alias("contract"), (F.col("oi") - 40).alias("exact_oi")
    )
    history = opt.iv_history(data.iv_snapshots(spark, sf_dir).withColumn("ticker", F.concat(F.lit("Brand#"), (1 + F.col("ticker").cast("long") % 25).cast("string"))))
    ideas = plan.expiry_ideas(cut_lineage(predictions(spark, sf_dir)), chains.contracts(spark, sf_dir), history, stored, F.lit("2024-02-02").cast("date"))
    return opt.rank_expiries(ideas).select("ticker", "dte", "action", "confidence", "option_quality", "risk_gate", "readiness", "iv_rank", "iv_history_scope", "rank")
