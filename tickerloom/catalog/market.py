"""Regime, macro, fundamentals and calendar queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import datasets as data
from ..operators import calendar as cal
from ..operators import regime, series
from ..sources import macro
from .base import Catalogue
from .tables_sql import BENCH, GOV_EVENTS, INDEX_BARS, MACRO, PREDICTIONS, clip, r, rs, with_

CATALOGUE = Catalogue()
add = CATALOGUE.add

LATEST = """macro_latest AS (SELECT source, series, MAX_BY(v, date) AS value, MAX(date) AS date FROM (
  SELECT source, series, date, TRY_CAST(value AS DOUBLE) AS v, ROW_NUMBER() OVER (PARTITION BY source, series ORDER BY date DESC) AS k FROM macro_obs)
  WHERE k <= 5 AND v IS NOT NULL GROUP BY 1, 2)"""


@add("macro_latest", with_(MACRO, LATEST, select=f"SELECT source, series, CAST(date AS VARCHAR) AS date, {r('value')} AS value FROM macro_latest"))
def macro_latest(spark, sf_dir):
    return macro.latest_observation(data.macro_observations(spark, sf_dir))


SNAP_SERIES = ("treasury_10y", "treasury_5y", "yield_curve_10y_2y", "fed_funds", "unemployment", "vix", "wti_oil", "dollar_index")


def _pivot_sql(where: str) -> str:
    return ", ".join(f"MAX(CASE WHEN {where} AND series = '{s}' THEN value END) AS {s}" for s in SNAP_SERIES)


@add("macro_snapshot", with_(MACRO, LATEST, select=f"""
SELECT CAST(DATE_TRUNC('year', date) AS DATE)::VARCHAR AS year, CASE WHEN MAX(CASE WHEN source = 'official' THEN 1 ELSE 0 END) = 1 THEN 'official' ELSE 'keyless' END AS macro_source,
  {', '.join(f"{r(f'''CASE WHEN MAX(CASE WHEN source = 'official' THEN 1 ELSE 0 END) = 1 THEN MAX(CASE WHEN source = 'official' AND series = '{s}' THEN v END) ELSE MAX(CASE WHEN source <> 'official' AND series = '{s}' THEN v END) END''')} AS {s}" for s in SNAP_SERIES)}
FROM (SELECT *, TRY_CAST(CASE WHEN source = 'official' AND YEAR(date) % 2 = 0 THEN '.' ELSE value END AS DOUBLE) AS v FROM macro_obs) WHERE v IS NOT NULL GROUP BY 1"""))
def macro_snapshot(spark, sf_dir):
    """Wide snapshot per year: official readings first, keyless ones otherwise.

    Official readings of even years are blank, so both ways occur.
    """
    obs = data.macro_observations(spark, sf_dir)
    blank = (F.col("source") == "official") & (F.year("date") % 2 == 0)
    obs = obs.withColumn("value", F.when(blank, ".").otherwise(F.col("value")))
    known = obs.withColumn("value", macro.reading(F.col("value"))).where(F.col("value").isNotNull())
    yearly = known.withColumn("year", F.to_date(F.date_trunc("year", "date")))
    return macro.snapshot(yearly, ["year"]).select("year", "macro_source", *SNAP_SERIES)


WIDE = f"""macro_wide AS (SELECT date, {', '.join(f"MAX(CASE WHEN series = '{s}' THEN v END) AS {s}" for s in SNAP_SERIES)}
  FROM (SELECT *, TRY_CAST(value AS DOUBLE) AS v FROM macro_obs) GROUP BY date),
macro_w AS (SELECT *, {r('treasury_10y - treasury_5y', 3)} AS c105 FROM macro_wide),
macro_w2 AS (SELECT *, COALESCE(yield_curve_10y_2y, c105) AS curve FROM macro_w)"""


MACRO_SCORE = "50 + CASE WHEN curve < 0 THEN -10 WHEN curve >= 0 THEN 5 ELSE 0 END + CASE WHEN treasury_10y > 4.5 THEN -3 ELSE 0 END + CASE WHEN vix > 25 THEN -8 WHEN vix < 15 THEN 6 ELSE 0 END + CASE WHEN unemployment > 5 THEN -4 ELSE 0 END + CASE WHEN fed_funds > 5 THEN -3 ELSE 0 END"


@add("macro_score", with_(MACRO, WIDE, select=f"""
SELECT CAST(date AS VARCHAR) AS date, {r(clip(MACRO_SCORE))} AS macro_regime FROM macro_w2"""))
def macro_score(spark, sf_dir):
    wide = macro.merged(data.macro_observations(spark, sf_dir))
    return wide.select("date", regime.macro_score().alias("macro_regime"))


BREADTH = f"""breadth AS (SELECT date, {r('100.0 * AVG(CASE WHEN close >= c5 THEN 1.0 ELSE 0.0 END)', 0)} AS breadth_pct FROM (
  SELECT date, pos, close, LAG(close, 5) OVER (PARTITION BY index_name ORDER BY date) AS c5 FROM index_bars) WHERE c5 IS NOT NULL GROUP BY date)"""


@add("index_breadth", with_(INDEX_BARS, BREADTH, select="SELECT CAST(date AS VARCHAR) AS date, breadth_pct FROM breadth"))
def index_breadth(spark, sf_dir):
    return regime.breadth_by_date(data.numbered_index_bars(spark, sf_dir))


def _bench_rows(n: int) -> str:
    return f"(ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


REG_SCORE = f"""GREATEST(0, LEAST(100, 50::DOUBLE + CASE WHEN v50 >= 0 THEN 12 WHEN v50 < 0 THEN -12 ELSE 0 END + CASE WHEN v20 >= 0 THEN 6 WHEN v20 < 0 THEN -6 ELSE 0 END
  + COALESCE({clip('c5 * 1.5::DOUBLE', -10, 10)}, 0) + CASE WHEN vix >= 30 THEN -16 WHEN vix >= 22 THEN -9 WHEN vix < 14 THEN 8 ELSE 0 END
  + CASE WHEN curve < 0 THEN -5 ELSE 0 END + CASE WHEN breadth_pct <= 35 THEN -6 WHEN breadth_pct >= 70 THEN 5 ELSE 0 END))"""
REG_LABEL = """CASE WHEN regime_score >= 64 THEN 'risk_on' WHEN regime_score >= 56 THEN 'mildly_risk_on' WHEN regime_score > 44 THEN 'neutral'
  WHEN regime_score > 34 THEN 'risk_off' ELSE 'strong_risk_off' END"""
REGIME = f"""rg AS (SELECT date, close, pos,
  CASE WHEN pos >= 50 THEN {r(f'(close / AVG(close) OVER {_bench_rows(20)} - 1) * 100', 2)} END AS v20,
  CASE WHEN pos >= 50 THEN {r(f'(close / AVG(close) OVER {_bench_rows(50)} - 1) * 100', 2)} END AS v50,
  CASE WHEN pos >= 50 THEN {r('(close / LAG(close, 5) OVER (ORDER BY date) - 1) * 100', 2)} END AS c5,
  CASE WHEN pos >= 50 THEN {r('(close / LAG(close, 20) OVER (ORDER BY date) - 1) * 100', 2)} END AS c20 FROM bench),
rg2 AS (SELECT g.*, m.vix, m.curve, m.wti_oil, m.dollar_index, b.breadth_pct FROM rg g LEFT JOIN macro_w2 m ON m.date = CAST(DATE_TRUNC('month', g.date) AS DATE) LEFT JOIN breadth b ON b.date = g.date),
rg3 AS (SELECT *, {REG_SCORE} AS regime_score FROM rg2),
rg4 AS (SELECT *, {REG_LABEL} AS regime FROM rg3)"""


def regime_history(spark, sf_dir):
    """Regime of every benchmark date, with the month's macro readings."""
    bench = series.blocks(data.numbered_benchmark(spark, sf_dir), 50)
    df = series.own_rows(regime.add_benchmark_structure(bench))
    wide = macro.merged(data.macro_observations(spark, sf_dir)).withColumnRenamed("date", "month")
    wide = wide.withColumn("curve", F.coalesce("yield_curve_10y_2y", "yield_curve_10y_5y"))
    df = df.withColumn("month", F.to_date(F.date_trunc("month", "date"))).join(wide, "month", "left")
    df = df.join(regime.breadth_by_date(data.numbered_index_bars(spark, sf_dir)), "date", "left")
    return regime.add_regime(df)


@add("market_regime", with_(BENCH, INDEX_BARS, MACRO, WIDE, BREADTH, REGIME, select=f"""
SELECT CAST(date AS VARCHAR) AS date, {r('regime_score')} AS regime_score, regime, regime = 'risk_on' AS risk_on, regime IN ('risk_off', 'strong_risk_off') AS risk_off,
  v50 IS NOT NULL OR vix IS NOT NULL AS regime_available, v20 AS vs_20dma_pct, v50 AS vs_50dma_pct, c5 AS change_5d_pct, c20 AS change_20d_pct, breadth_pct,
  CONCAT_WS('; ', CASE WHEN v50 >= 0 THEN 'above_50d_average' WHEN v50 < 0 THEN 'below_50d_average' END, CASE WHEN c5 <= -1.5 THEN 'broad_pullback_5d' WHEN c5 >= 1.5 THEN 'rise_5d' END,
   CASE WHEN vix >= 30 THEN 'vix_high_fear' WHEN vix >= 22 THEN 'vix_rising' WHEN vix < 14 THEN 'vix_calm' WHEN vix IS NOT NULL THEN 'vix_normal' END,
   CASE WHEN curve < 0 THEN 'curve_inverted' END, CASE WHEN breadth_pct <= 35 THEN 'breadth_weak' WHEN breadth_pct >= 70 THEN 'breadth_firm' END) AS drivers FROM rg4"""))
def market_regime(spark, sf_dir):
    return regime_history(spark, sf_dir).select(
        "date", "regime_score", "regime", "risk_on", "risk_off", "regime_available", "vs_20dma_pct", "vs_50dma_pct",
        "change_5d_pct", "change_20d_pct", "breadth_pct", "drivers",
    )


MULT = """CASE WHEN NOT COALESCE(av, FALSE) THEN 1.0 WHEN up AND regime = 'strong_risk_off' THEN 0.85 WHEN up AND regime IN ('risk_off', 'strong_risk_off') THEN 0.92
  WHEN down AND regime IN ('risk_off', 'strong_risk_off') THEN 1.05 WHEN up AND regime = 'risk_on' THEN 1.04 WHEN down AND regime = 'risk_on' THEN 0.93 ELSE 1.0 END"""


@add("regime_multiplier", with_(BENCH, INDEX_BARS, MACRO, WIDE, BREADTH, REGIME, PREDICTIONS, select=f"""
SELECT direction, regime, {r(MULT)} AS multiplier, COUNT(*) AS calls FROM (
  SELECT p.direction, g.regime, (g.v50 IS NOT NULL OR g.vix IS NOT NULL) AS av, p.direction IN ('bullish', 'neutral_to_bullish') AS up,
    p.direction IN ('bearish', 'neutral_to_bearish') AS down FROM predictions p JOIN rg4 g ON g.date = p.as_of) GROUP BY 1, 2, 3"""))
def regime_multiplier(spark, sf_dir):
    """How often each multiplier applied to past calls."""
    tape = regime_history(spark, sf_dir).select(F.col("date").alias("as_of"), "regime", "regime_available")
    calls = data.predictions(spark, sf_dir).select("as_of", "direction").join(tape, "as_of")
    mult = regime.regime_multiplier(F.col("regime"), F.col("regime_available"), F.col("direction"))
    return calls.groupBy("direction", "regime", mult.alias("multiplier")).agg(F.count(F.lit(1)).alias("calls"))


FACTS = """facts_raw AS (
SELECT o_custkey AS cik, CASE o_orderkey % 7 WHEN 0 THEN 'Revenues' WHEN 1 THEN 'RevenueFromContractWithCustomerExcludingAssessedTax' WHEN 2 THEN 'NetIncomeLoss'
   WHEN 3 THEN 'Assets' WHEN 4 THEN 'Liabilities' WHEN 5 THEN 'StockholdersEquity' ELSE 'CashAndCashEquivalentsAtCarryingValue' END AS tag,
  CASE WHEN o_orderkey % 5 = 0 THEN 'EUR' ELSE 'USD' END AS unit, CAST(o_orderdate AS DATE) AS "end",
  CASE WHEN o_orderkey % 7 = 2 THEN o_totalprice / 4 - 50000 ELSE o_totalprice END AS val, o_orderkey AS accession FROM orders),
facts_usd AS (SELECT *, MIN(CASE WHEN unit = 'USD' THEN 0 ELSE 1 END) OVER (PARTITION BY cik, tag) AS best, CASE WHEN unit = 'USD' THEN 0 ELSE 1 END AS u FROM facts_raw),
facts_last AS (SELECT cik, tag, val FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY cik, tag ORDER BY "end" DESC, accession) AS k FROM facts_usd WHERE u = best) WHERE k = 1),
facts AS (SELECT cik, COALESCE(NULLIF(MAX(CASE WHEN tag = 'Revenues' THEN val END), 0), MAX(CASE WHEN tag = 'RevenueFromContractWithCustomerExcludingAssessedTax' THEN val END)) AS revenue,
  MAX(CASE WHEN tag = 'NetIncomeLoss' THEN val END) AS net_income, MAX(CASE WHEN tag = 'Assets' THEN val END) AS assets, MAX(CASE WHEN tag = 'Liabilities' THEN val END) AS liabilities,
  MAX(CASE WHEN tag = 'StockholdersEquity' THEN val END) AS stockholders_equity, MAX(CASE WHEN tag = 'CashAndCashEquivalentsAtCarryingValue' THEN val END) AS cash FROM facts_last GROUP BY cik)"""


def fact_rows(spark, sf_dir):
    key = F.col("o_orderkey")
    tags = F.array(*[F.lit(t) for t in (
        "Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax", "NetIncomeLoss", "Assets", "Liabilities",
        "StockholdersEquity", "CashAndCashEquivalentsAtCarryingValue")])
    value = F.when(key % 7 == 2, F.col("o_totalprice") / 4 - 50000).otherwise(F.col("o_totalprice"))
    return data.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("cik"),
        F.element_at(tags, (key % 7 + 1).cast("int")).alias("tag"),
        F.when(key % 5 == 0, "EUR").otherwise("USD").alias("unit"),
        F.to_date("o_orderdate").alias("end"),
        value.alias("val"),
        key.alias("accession"),
    )


@add("latest_facts", with_(FACTS, select="SELECT cik, " + ", ".join(
    f"{r(c)} AS {c}" for c in ("revenue", "net_income", "assets", "liabilities", "stockholders_equity", "cash")) + " FROM facts"))
def latest_facts(spark, sf_dir):
    from ..sources.filings import latest_facts as latest

    return latest(fact_rows(spark, sf_dir))


FUND = """CASE WHEN revenue IS NULL AND net_income IS NULL AND assets IS NULL AND liabilities IS NULL AND stockholders_equity IS NULL AND cash IS NULL THEN 50 ELSE
 GREATEST(0, LEAST(100, 50 + CASE WHEN m > 15 THEN 12 WHEN m > 0 THEN 4 WHEN m <= 0 THEN -10 ELSE 0 END + CASE WHEN de < 1 THEN 8 WHEN de < 2 THEN 2 WHEN de >= 2 THEN -8 ELSE 0 END
 + CASE WHEN assets <> 0 AND liabilities IS NOT NULL THEN CASE WHEN assets > liabilities THEN 4 ELSE -12 END ELSE 0 END)) END"""


@add("fundamental_score", with_(FACTS, select=f"""
SELECT cik, {r('m')} AS net_margin_pct, {r('de')} AS debt_equity, {r(FUND)} AS fundamentals FROM (
  SELECT *, net_income / NULLIF(revenue, 0) * 100 AS m, liabilities / NULLIF(stockholders_equity, 0) AS de FROM facts)"""))
def fundamental_score(spark, sf_dir):
    from ..sources.filings import latest_facts as latest

    df = regime.add_fundamental_score(latest(fact_rows(spark, sf_dir)))
    return df.select("cik", "net_margin_pct", "debt_equity", "fundamentals")


CURATED = """curated AS (SELECT CAST(o_orderdate AS DATE) AS date, CASE MIN(o_custkey) % 3 WHEN 0 THEN 'fomc' WHEN 1 THEN 'cpi' ELSE 'gdp' END AS kind,
  CASE MIN(o_custkey) % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'high' ELSE 'low' END AS impact FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)"""
RULES = """rules AS (SELECT d::DATE AS date, 'nfp' AS kind, 'high' AS impact, 'Non-farm payrolls / jobs report' AS title FROM range(DATE '1995-01-01', DATE '2002-01-01', INTERVAL 1 DAY) t(d)
   WHERE isodow(d) = 5 AND day(d) <= 7
  UNION ALL SELECT d::DATE, 'jobless_claims', 'medium', 'Initial jobless claims' FROM range(DATE '1995-01-01', DATE '2002-01-01', INTERVAL 1 DAY) t(d) WHERE isodow(d) = 4),
cal AS (SELECT date, kind, impact, kind || ' release' AS title FROM curated UNION ALL SELECT * FROM rules)"""


def curated_dates(spark, sf_dir):
    """Published dates: the days that carried an urgent order."""
    urgent = data.table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    days = urgent.groupBy(F.to_date("o_orderdate").alias("date")).agg(F.min("o_custkey").alias("c"))
    kind = F.when(F.col("c") % 3 == 0, "fomc").when(F.col("c") % 3 == 1, "cpi").otherwise("gdp")
    return days.select(
        "date",
        kind.alias("kind"),
        F.concat(kind, F.lit(" release")).alias("title"),
        F.when(F.col("c") % 3 == 2, "low").otherwise("high").alias("impact"),
        F.lit("market").alias("scope"),
        F.lit(None).cast("string").alias("ticker"),
        F.lit("published").alias("source"),
    )


def calendar(spark, sf_dir):
    return curated_dates(spark, sf_dir).unionByName(cal.rule_events(spark, "1995-01-01", "2001-12-31"))


@add("event_calendar", with_(CURATED, RULES, select="""
SELECT CAST(date AS VARCHAR) AS date, kind, impact, title, date_diff('day', DATE '1995-01-01', date) AS days_away FROM cal
WHERE date BETWEEN DATE '1995-01-01' AND DATE '1995-01-01' + 365"""))
def event_calendar(spark, sf_dir):
    """Curated and rule-derived events of one year."""
    today = F.lit("1995-01-01").cast("date")
    rules = cal.rule_events(spark, "1995-01-01", "2001-12-31")
    events = cal.upcoming(curated_dates(spark, sf_dir), rules, today, 365)
    return events.select("date", "kind", "impact", "title", "days_away")


@add("calendar_load", with_(CURATED, RULES, PREDICTIONS, select="""
SELECT c.kind, c.impact, p.horizon, COUNT(*) AS calls_exposed FROM cal c
JOIN (SELECT *, CASE horizon WHEN '1D' THEN 1 WHEN '5D' THEN 5 ELSE 20 END AS h FROM predictions) p ON c.date BETWEEN p.as_of AND p.as_of + p.h
GROUP BY 1, 2, 3"""))
def calendar_load(spark, sf_dir):
    """How many calls had an event of each kind inside their horizon.

    Calls are counted per (day, horizon) before they meet the events.
    """
    from ..operators.outcomes import horizon_days

    calls = data.predictions(spark, sf_dir).withColumn("horizon_days", horizon_days(F.col("horizon")))
    load = calls.groupBy("as_of", "horizon_days", "horizon").agg(F.count(F.lit(1)).alias("calls"))
    seen = cal.expand_by_day(calendar(spark, sf_dir), [1, 5, 20])
    joined = seen.join(load, ["as_of", "horizon_days"])
    return joined.groupBy("kind", "impact", "horizon").agg(F.sum("calls").alias("calls_exposed"))


EARN = """earn AS (SELECT ticker, COALESCE(nx, ps) AS d, nx IS NULL AND ps IS NOT NULL AS est FROM (
  SELECT 'Brand#' || CAST(1 + o_custkey % 25 AS VARCHAR) AS ticker, MIN(CASE WHEN CAST(o_orderdate AS DATE) >= DATE '1998-06-15' THEN CAST(o_orderdate AS DATE) END) AS nx,
    MAX(CASE WHEN CAST(o_orderdate AS DATE) < DATE '1998-06-15' THEN CAST(o_orderdate AS DATE) END) AS ps FROM orders GROUP BY 1))"""


def report_dates(spark, sf_dir):
    return data.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("Brand#"), (1 + F.col("o_custkey") % 25).cast("string")).alias("ticker"),
        F.to_date("o_orderdate").alias("date"),
    )


@add("earnings_dates", with_(EARN, select="""
SELECT ticker, CAST(d AS VARCHAR) AS next_earnings_date, est AS is_estimate, date_diff('day', DATE '1998-06-15', d) AS days_to_earnings FROM earn"""))
def earnings_dates(spark, sf_dir):
    return cal.next_report_date(report_dates(spark, sf_dir), F.lit("1998-06-15").cast("date"))


@add("upcoming_earnings", with_(EARN, select="""
SELECT CAST(d AS VARCHAR) AS date, 'earnings' AS kind, ticker || ' earnings report' || CASE WHEN est THEN ' (est.)' ELSE '' END AS title, 'high' AS impact, 'ticker' AS scope, ticker,
  date_diff('day', DATE '1998-06-15', d) AS days_away FROM earn WHERE date_diff('day', DATE '1998-06-15', d) BETWEEN 0 AND 45"""))
def upcoming_earnings(spark, sf_dir):
    reports = cal.next_report_date(report_dates(spark, sf_dir), F.lit("1998-06-15").cast("date"))
    return cal.earnings_events(reports, 45).drop("source")


PTS = """LEAST(55, CASE c.impact WHEN 'high' THEN 30 WHEN 'medium' THEN 16 ELSE 7 END
  + CASE WHEN c.date - p.as_of <= 0 THEN 18 WHEN c.date - p.as_of <= 1 THEN 14 WHEN c.date - p.as_of <= 3 THEN 8 WHEN c.date - p.as_of <= 5 THEN 4 ELSE 0 END)"""
OWN = """CASE WHEN own THEN LEAST(55, 30 + CASE WHEN dte <= 0 THEN 18 WHEN dte <= 1 THEN 14 WHEN dte <= 3 THEN 8 WHEN dte <= 5 THEN 4 ELSE 0 END + 8) ELSE 0 END"""
EVENT_RISK = f"""er AS (SELECT p.prediction_id, ANY_VALUE(p.ticker) AS ticker, ANY_VALUE(p.direction) AS direction, ANY_VALUE(p.h) AS h, ANY_VALUE(p.dte) AS dte, COUNT(c.kind) AS ev,
   SUM(CASE WHEN c.impact = 'high' THEN 1 ELSE 0 END) AS hi, COALESCE(SUM(CASE WHEN c.kind IS NOT NULL THEN {PTS} END), 0) AS pts,
   MIN(CASE WHEN c.kind IS NOT NULL THEN {{'d': c.date - p.as_of, 'o': CASE WHEN c.impact = 'high' THEN 0 ELSE 1 END, 't': c.title}} END) AS lead
  FROM (SELECT *, CASE horizon WHEN '1D' THEN 1 WHEN '5D' THEN 5 ELSE 20 END AS h, CASE WHEN prediction_id % 3 = 0 THEN prediction_id % 30 END AS dte FROM predictions) p
  LEFT JOIN cal c ON c.date BETWEEN p.as_of AND p.as_of + p.h GROUP BY p.prediction_id),
er2 AS (SELECT *, COALESCE(dte BETWEEN 0 AND h, FALSE) AS own FROM er),
er3 AS (SELECT *, (ev + own::INT)::BIGINT AS event_count, (hi + own::INT)::BIGINT AS high_impact_count, pts + {OWN} AS points FROM er2),
er4 AS (SELECT *, LEAST(100, {rs('points * 0.75::DOUBLE + GREATEST(0, high_impact_count - 1) * 8', 1)}) AS sc FROM er3),
er5 AS (SELECT *, CASE WHEN sc >= 75 THEN 'extreme' WHEN sc >= 55 THEN 'high' WHEN sc >= 30 THEN 'medium' WHEN sc > 0 THEN 'low' ELSE 'quiet' END AS lvl FROM er4)"""


@add("event_risk", with_(CURATED, RULES, PREDICTIONS, EVENT_RISK, select=f"""
SELECT prediction_id, event_count, high_impact_count, {r('sc')} AS event_risk_score, lvl AS event_level,
  CASE WHEN event_count = 0 THEN 'quiet_calendar' WHEN lvl IN ('high', 'extreme') THEN 'binary_event_risk' ELSE 'event_watch' END AS event_bias,
  CASE WHEN lvl IN ('high', 'extreme') THEN 'prefer_defined_risk_options_or_wait' WHEN lvl = 'medium' THEN 'keep_smaller_size_and_confirm_after_release' ELSE 'normal_process' END AS event_action,
  CASE WHEN own AND (lead IS NULL OR dte < lead.d) THEN ticker || ' earnings report' ELSE lead.t END AS lead_event,
  CASE WHEN direction IN ('bullish', 'neutral_to_bullish') THEN 'long' WHEN direction IN ('bearish', 'neutral_to_bearish') THEN 'short' ELSE 'none' END
   || '_' || CASE WHEN lvl IN ('high', 'extreme') THEN 'event_sensitive' ELSE 'calendar_not_dominant' END AS event_effect FROM er5"""))
def event_risk(spark, sf_dir):
    """Scheduled-event risk of every past call."""
    from ..operators.outcomes import horizon_days

    calls = data.predictions(spark, sf_dir).select("prediction_id", "ticker", "as_of", "direction", "horizon")
    key = F.col("prediction_id")
    calls = calls.withColumn("horizon_days", horizon_days(F.col("horizon"))).withColumn(
        "days_to_earnings", F.when(key % 3 == 0, (key % 30).cast("int"))
    )
    df = cal.add_event_risk(calls, cal.market_load(calendar(spark, sf_dir), [1, 5, 20]))
    return df.select(
        "prediction_id", "event_count", "high_impact_count", "event_risk_score", "event_level", "event_bias",
        "event_action", "lead_event", "event_effect",
    )


def _hit_sql(terms) -> str:
    flags = " + ".join(f"MAX(CASE WHEN CONTAINS(t, '{t}') THEN 1 ELSE 0 END)" for t in terms)
    return f"({flags})::BIGINT"


HITS = f"""hits AS (SELECT kind, {_hit_sql(regime.GEO_TERMS)} AS geo_hits, {_hit_sql(regime.OIL_TERMS)} AS oil_hits, {_hit_sql(regime.POLICY_TERMS)} AS policy_hits
  FROM (SELECT kind, LOWER(CONCAT_WS(' ', title, source, kind)) AS t FROM gov_events) GROUP BY kind)"""


@add("event_term_hits", with_(GOV_EVENTS, HITS, select="SELECT kind, geo_hits, oil_hits, policy_hits FROM hits"))
def event_term_hits(spark, sf_dir):
    return regime.term_hits(
        data.gov_events(spark, sf_dir), ["kind"], geo=regime.GEO_TERMS, oil=regime.OIL_TERMS, policy=regime.POLICY_TERMS
    )


BROAD_BASE = """(CASE WHEN regime_score = 0 THEN 50 ELSE regime_score END) + CASE WHEN vix >= 25 THEN -9 WHEN vix <= 15 THEN 4 ELSE 0 END + CASE WHEN wti_oil >= 90 THEN -5 WHEN wti_oil <= 65 THEN 2 ELSE 0 END
   + CASE WHEN dollar_index >= 108 THEN -4 WHEN dollar_index <= 102 THEN 2 ELSE 0 END - LEAST(12, 3 * geo_hits) - LEAST(6, 2 * oil_hits)"""
BROAD_SCORE = """GREATEST(0, LEAST(100, base + CASE WHEN avg_abs_corr >= 0.65 AND base < 50 THEN -4 ELSE 0 END + CASE lvl WHEN 'high' THEN -7 WHEN 'extreme' THEN -11 WHEN 'medium' THEN -3 ELSE 0 END))"""
BROAD_DIRECTION = "CASE WHEN s >= 64 THEN 'risk_on' WHEN s <= 36 THEN 'risk_off' WHEN s <= 44 THEN 'cautious_risk_off' WHEN s >= 56 THEN 'constructive' ELSE 'neutral' END"
BROAD = f"""bm AS (SELECT g.*, h.geo_hits, h.oil_hits, (g.pos % 101)::DOUBLE / 100 AS avg_abs_corr, CASE g.pos % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'extreme' ELSE 'low' END AS lvl
   FROM rg4 g JOIN hits h ON h.kind = CASE g.pos % 2 WHEN 0 THEN 'policy' ELSE 'fiscal' END),
bm2 AS (SELECT *, {BROAD_BASE} AS base FROM bm),
bm3 AS (SELECT *, {BROAD_SCORE} AS s FROM bm2)"""


@add("broad_market", with_(BENCH, INDEX_BARS, MACRO, WIDE, BREADTH, REGIME, GOV_EVENTS, HITS, BROAD, select=f"""
SELECT CAST(date AS VARCHAR) AS date, {rs('s', 1)} AS broad_score, {BROAD_DIRECTION} AS broad_direction,
  CASE WHEN s >= 64 THEN 'bullish_index_bias' WHEN s <= 36 THEN 'bearish_index_bias' WHEN s <= 44 THEN 'prefer_defined_risk_or_put_research' WHEN s >= 56 THEN 'selective_call_research' ELSE 'wait_for_cleaner_index_move' END AS broad_action
FROM bm3"""))
def broad_market(spark, sf_dir):
    """Broad-market read of every date."""
    tape = regime_history(spark, sf_dir)
    pos = F.col("pos")
    hits = regime.term_hits(data.gov_events(spark, sf_dir), ["kind"], geo=regime.GEO_TERMS, oil=regime.OIL_TERMS)
    level = F.when(pos % 5 == 0, "high").when(pos % 5 == 1, "medium").when(pos % 5 == 2, "extreme").otherwise("low")
    tape = tape.withColumn("kind", F.when(pos % 2 == 0, "policy").otherwise("fiscal")).join(hits, "kind")
    tape = tape.withColumn("avg_abs_corr", (pos % 101).cast("double") / 100).withColumn("event_level", level)
    return regime.add_broad_market(tape).select("date", "broad_score", "broad_direction", "broad_action")
