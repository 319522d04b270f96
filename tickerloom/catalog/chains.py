"""Option-chain queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import datasets as data
from ..operators import option_reports as rep
from ..operators import options as opt
from .base import Catalogue
from ..operators.indicators import historical_move
from .tables_sql import BARS, CHAIN, IV_SNAPSHOTS, clip, norm_cdf, r, rs, with_
from .timeseries import DELTA, LOGRET

CATALOGUE = Catalogue()
add = CATALOGUE.add
KEYS = ["ticker", "dte"]


def contracts(spark, sf_dir):
    return data.chain(spark, sf_dir).withColumnRenamed("contract_id", "contract")


METRICS = f"""em0 AS (SELECT ticker, dte, SUM(CASE WHEN "right" = 'C' THEN volume ELSE 0 END) AS cv, SUM(CASE WHEN "right" = 'P' THEN volume ELSE 0 END) AS pv, SUM(oi)::BIGINT AS total_oi, AVG(iv) AS miv, MAX(spot) AS spot,
   MIN(CASE WHEN "right" = 'C' THEN {{'gap': ABS(strike - spot), 'strike': strike, 'contract': contract_id, 'last': last, 'bid': bid, 'ask': ask, 'volume': volume, 'oi': oi, 'iv': iv}} END) AS c,
   MIN(CASE WHEN "right" = 'P' THEN {{'gap': ABS(strike - spot), 'strike': strike, 'contract': contract_id, 'last': last, 'bid': bid, 'ask': ask, 'volume': volume, 'oi': oi, 'iv': iv}} END) AS p
  FROM chain GROUP BY ticker, dte),
em AS (SELECT *, c IS NOT NULL AND p IS NOT NULL AS both_legs, pv / NULLIF(cv, 0) AS pcr_exact, {rs('pv / NULLIF(cv, 0)', 2)} AS put_call_ratio, {rs('miv * 100', 1)} AS avg_iv, cv + pv AS total_volume FROM em0),
metrics AS (SELECT ticker, dte, cv AS call_volume, pv AS put_volume, total_volume, total_oi, spot, pcr_exact, put_call_ratio, avg_iv, total_oi < 500 AS illiquid,
   CASE WHEN both_legs THEN CAST(c.contract AS VARCHAR) END AS atm_call, CASE WHEN both_legs THEN CAST(p.contract AS VARCHAR) END AS atm_put, CASE WHEN both_legs THEN {r('c.strike', 2)} END AS atm_strike,
   {', '.join(f"CASE WHEN both_legs THEN {r(f'{k}.{f}', 4)} END AS atm_{s}_{f}" for s, k in (('call', 'c'), ('put', 'p')) for f in ('last', 'bid', 'ask'))},
   {', '.join(f"CASE WHEN both_legs THEN {k}.{f}::BIGINT END AS atm_{s}_{f}" for s, k in (('call', 'c'), ('put', 'p')) for f in ('volume', 'oi'))},
   {', '.join(f"CASE WHEN both_legs THEN {rs(f'{k}.iv * 100', 1)} END AS atm_{s}_iv" for s, k in (('call', 'c'), ('put', 'p')))},
   CASE WHEN both_legs AND c.last + p.last > 0 THEN {rs('(c.last + p.last) / spot * 100', 1)} END AS expected_move_pct FROM em)"""
METRIC_COLUMNS = (
    "ticker dte call_volume put_volume total_volume total_oi put_call_ratio avg_iv illiquid atm_call atm_put atm_strike "
    "atm_call_last atm_call_bid atm_call_ask atm_put_last atm_put_bid atm_put_ask atm_call_volume atm_call_oi "
    "atm_put_volume atm_put_oi atm_call_iv atm_put_iv expected_move_pct"
).split()


def metrics(spark, sf_dir):
    return opt.expiry_metrics(contracts(spark, sf_dir), KEYS)


@add("expiry_metrics", with_(CHAIN, METRICS, select="SELECT " + ", ".join(
    f"{c}::BIGINT AS {c}" if c == "dte" else r(c) + f" AS {c}" if c in ("call_volume", "put_volume", "total_volume") else c for c in METRIC_COLUMNS) + " FROM metrics"))
def expiry_metrics(spark, sf_dir):
    return metrics(spark, sf_dir).select(*METRIC_COLUMNS)


OPTIONS_SCORE = "GREATEST(0, LEAST(100, 50 + CASE WHEN pcr_exact < 0.7 THEN 8 WHEN pcr_exact > 1.3 THEN -8 ELSE 0 END + CASE WHEN avg_iv > 80 THEN -4 ELSE 0 END + CASE WHEN illiquid THEN -6 ELSE 0 END))"


@add("options_component_score", with_(CHAIN, METRICS, select=f"""
SELECT ticker, dte::BIGINT AS dte, put_call_ratio, avg_iv, illiquid, {r(OPTIONS_SCORE)} AS options_intelligence
FROM metrics QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY dte) = 1"""))
def options_component_score(spark, sf_dir):
    """Score of each ticker's nearest expiry."""
    near = opt.select_expiries(metrics(spark, sf_dir), n=1)
    return near.select("ticker", "dte", "put_call_ratio", "avg_iv", "illiquid", opt.component_score().alias("options_intelligence"))


TERM = f"""ts AS (SELECT m.*, nx.avg_iv AS next_iv, nx.dte AS next_dte, m.avg_iv IS NOT NULL AND m.dte >= 5 AS usable FROM metrics m LEFT JOIN metrics nx ON nx.ticker = m.ticker AND nx.avg_iv IS NOT NULL
   AND nx.dte = (SELECT MIN(x.dte) FROM metrics x WHERE x.ticker = m.ticker AND x.dte > m.dte AND x.avg_iv IS NOT NULL)),
term AS (SELECT *, {rs('next_iv - avg_iv', 1)} AS term_slope_pct, {rs('atm_put_iv - atm_call_iv', 1)} AS atm_iv_skew_pct FROM ts)"""


@add("term_structure_skew", with_(CHAIN, METRICS, TERM, select="""
SELECT ticker, dte::BIGINT AS dte, avg_iv, next_dte::BIGINT AS next_dte, term_slope_pct, CASE WHEN NOT usable THEN 'unknown' WHEN term_slope_pct IS NULL THEN 'single_expiry' WHEN term_slope_pct >= 5 THEN 'contango_longer_expiry_richer'
  WHEN term_slope_pct <= -5 THEN 'backwardation_front_expiry_richer' ELSE 'flat' END AS term_label, atm_iv_skew_pct,
  CASE WHEN atm_iv_skew_pct IS NULL THEN 'unknown' WHEN atm_iv_skew_pct >= 5 THEN 'puts_richer_bearish_hedging' WHEN atm_iv_skew_pct <= -5 THEN 'calls_richer_bullish_demand' ELSE 'balanced_atm_iv' END AS skew_label FROM term"""))
def term_structure_skew(spark, sf_dir):
    df = opt.add_skew(opt.add_term_structure(metrics(spark, sf_dir)))
    return df.select("ticker", "dte", "avg_iv", "next_dte", "term_slope_pct", "term_label", "atm_iv_skew_pct", "skew_label")


def unusual_sql(vol: str, oi: str, prev: str, tv: str, toi: str) -> dict[str, str]:
    ratio = f"CASE WHEN {oi} > 0 THEN {rs(f'{vol} / NULLIF({oi}, 0)::DOUBLE', 2)} END"
    pct = f"CASE WHEN {prev} > 0 THEN {rs(f'({oi} - {prev}) / NULLIF({prev}, 0)::DOUBLE * 100', 1)} END"
    score = f"""LEAST(100, CASE WHEN {oi} > 0 THEN LEAST(55, ({ratio}) * 35) ELSE 0 END + LEAST(25, COALESCE({tv} / NULLIF({toi}, 0)::DOUBLE, 0) * 40)
      + CASE WHEN {oi} - {prev} > 0 THEN LEAST(20, CASE WHEN COALESCE({pct}, 0) <> 0 THEN ({pct}) / 2 ELSE 5 END) ELSE 0 END)"""
    return {"ratio": ratio, "pct": pct, "score": rs(score, 1)}


_u = unusual_sql("volume", "oi", "prev", "volume", "oi")


@add("unusual_activity", with_(CHAIN, f"""un AS (SELECT *, CASE WHEN contract_id % 3 <> 0 THEN oi - 40 * (contract_id % 5 - 2) END AS prev FROM chain),
un2 AS (SELECT *, {_u['ratio']} AS ratio, {_u['pct']} AS pct, {_u['score']} AS sc FROM un)""", select="""
SELECT contract_id AS contract, ratio AS volume_oi_ratio, oi - prev AS oi_change, pct AS oi_change_pct, sc AS unusual_score, CASE WHEN sc >= 75 THEN 'very_unusual_chain_activity' WHEN sc >= 50 THEN 'unusual_chain_activity' WHEN sc >= 30 THEN 'elevated_chain_activity' ELSE 'normal' END AS unusual_label FROM un2"""))
def unusual_activity(spark, sf_dir):
    c = F.col("contract")
    df = contracts(spark, sf_dir).withColumn("prev", F.when(c % 3 != 0, F.col("oi") - 40 * (c % 5 - 2)))
    df = df.withColumn("total_volume", F.col("volume")).withColumn("total_oi", F.col("oi"))
    df = opt.add_unusual_activity(df, "volume", "oi", "prev")
    return df.select("contract", "volume_oi_ratio", "oi_change", "oi_change_pct", "unusual_score", "unusual_label")


DTEF = "CASE WHEN dte BETWEEN 7 AND 35 THEN 1.0 WHEN dte >= 3 AND dte < 7 THEN 0.85 WHEN dte > 35 AND dte <= 50 THEN 0.85 WHEN dte < 3 THEN 0.55 ELSE 0.7 END::DOUBLE"


def ivf(x):
    return f"CASE WHEN {x} IS NULL THEN 0.65 WHEN {x} <= 45 THEN 0.95 WHEN {x} <= 70 THEN 0.85 WHEN {x} <= 90 THEN 0.65 ELSE 0.45 END::DOUBLE"


def ivr(x):
    return f"CASE WHEN {x} IS NULL THEN 'IV unavailable' WHEN {x} <= 45 THEN 'reasonable IV' WHEN {x} <= 70 THEN 'moderate IV' WHEN {x} <= 90 THEN 'elevated IV' ELSE 'very high IV' END"


def spf(x):
    return f"CASE WHEN {x} IS NULL THEN 0.65 WHEN {x} <= 8 THEN 1.0 WHEN {x} <= 15 THEN 0.85 WHEN {x} <= 25 THEN 0.55 ELSE 0.30 END::DOUBLE"


def spp(bid, ask):
    return f"CASE WHEN {bid} > 0 AND {ask} > 0 AND {ask} >= {bid} THEN {rs(f'({ask} - {bid}) / (({ask} + {bid}) / 2) * 100', 1)} END"


def flow(d, pcr):
    return f"""CASE WHEN {pcr} IS NULL THEN 'unknown' WHEN {d} = 'up' AND {pcr} < 0.9 THEN 'supports_call' WHEN {d} = 'up' AND {pcr} > 1.3 THEN 'against_call' WHEN {d} = 'down' AND {pcr} > 1.1 THEN 'supports_put'
      WHEN {d} = 'down' AND {pcr} < 0.7 THEN 'against_put' WHEN {d} IN ('up', 'down') THEN 'mixed' ELSE 'neutral' END"""


def flowf(label):
    return f"CASE {label} WHEN 'unknown' THEN 0.55 WHEN 'supports_call' THEN 1.0 WHEN 'supports_put' THEN 1.0 WHEN 'against_call' THEN 0.35 WHEN 'against_put' THEN 0.35 WHEN 'mixed' THEN 0.65 ELSE 0.45 END::DOUBLE"


SIDE3 = "CASE contract_id % 3 WHEN 0 THEN 'up' WHEN 1 THEN 'down' ELSE 'neutral' END"
PCRX = "(CASE WHEN contract_id % 11 = 0 THEN NULL ELSE (contract_id % 21) / 10.0 END)"


def _side3():
    c = F.col("contract")
    return F.when(c % 3 == 0, "up").when(c % 3 == 1, "down").otherwise("neutral")


@add("contract_factors", with_(CHAIN, select=f"""
SELECT contract_id AS contract, {r(DTEF)} AS dte_factor, {r(ivf('(iv * 100)'))} AS iv_factor, {ivr('(iv * 100)')} AS iv_risk, {spp('bid', 'ask')} AS spread_pct, {r(spf('(' + spp('bid', 'ask') + ')'))} AS spread_factor,
  {flow(SIDE3, PCRX)} AS flow_alignment, {r(flowf('(' + flow(SIDE3, PCRX) + ')'))} AS flow_factor FROM chain"""))
def contract_factors(spark, sf_dir):
    c = F.col("contract")
    df = contracts(spark, sf_dir).withColumn("pcr", F.when(c % 11 != 0, (c % 21) / 10.0)).withColumn("side", _side3())
    spread = opt.spread_pct(F.col("bid"), F.col("ask"))
    label, factor = opt.flow_alignment(F.col("side"), F.col("pcr"))
    iv = F.col("iv") * 100
    return df.select(
        "contract",
        opt.dte_factor(F.col("dte")).alias("dte_factor"),
        opt.iv_factor(iv).alias("iv_factor"),
        opt.iv_risk(iv).alias("iv_risk"),
        spread.alias("spread_pct"),
        opt.spread_factor(spread).alias("spread_factor"),
        label.alias("flow_alignment"),
        factor.alias("flow_factor"),
    )


def greeks_cte(name: str, source: str, strike: str, premium: str, iv: str, right: str) -> str:
    """Intermediate columns of the Black-Scholes formulas."""
    put = f"{right} = 'put'"
    return f"""{name}0 AS (SELECT *, {strike} AS gk, {iv} / 100::DOUBLE AS sg, GREATEST(dte::DOUBLE, 0.5) / 365 AS t FROM {source}),
{name}1 AS (SELECT *, CASE WHEN spot > 0 AND gk > 0 AND sg > 0 THEN (LN(spot / gk) + (0.045::DOUBLE + 0.5::DOUBLE * sg * sg) * t) / (sg * SQRT(t)) END AS d1 FROM {name}0),
{name}2 AS (SELECT *, d1 - sg * SQRT(t) AS d2, EXP(-(d1 * d1) / 2) / SQRT(2 * PI()) AS pdf FROM {name}1),
{name}3 AS (SELECT *, {norm_cdf('d1')} AS n1, {norm_cdf('d2')} AS n2, {norm_cdf('-d2')} AS nm2 FROM {name}2),
{name} AS (SELECT *, CASE WHEN d1 IS NOT NULL THEN {r(f'CASE WHEN {put} THEN n1 - 1 ELSE n1 END', 3)} END AS delta, {r('pdf / (spot * (sg * SQRT(t)))', 5)} AS gamma,
  CASE WHEN d1 IS NOT NULL THEN {r(f'(CASE WHEN {put} THEN -(spot * pdf * sg) / (2 * SQRT(t)) + 0.045::DOUBLE * gk * EXP(-0.045::DOUBLE * t) * nm2 ELSE -(spot * pdf * sg) / (2 * SQRT(t)) - 0.045::DOUBLE * gk * EXP(-0.045::DOUBLE * t) * n2 END) / 365', 3)} END AS theta_per_day,
  CASE WHEN d1 IS NOT NULL THEN {r('spot * pdf * SQRT(t) / 100', 3)} END AS vega_per_vol_point, CASE WHEN d1 IS NOT NULL THEN {rs(f'CASE WHEN {put} THEN gk - COALESCE({premium}, 0) ELSE gk + COALESCE({premium}, 0) END', 2)} END AS breakeven_price,
  CASE WHEN d1 IS NOT NULL THEN {rs(f'((CASE WHEN {put} THEN gk - COALESCE({premium}, 0) ELSE gk + COALESCE({premium}, 0) END) / spot - 1) * 100', 2)} END AS breakeven_pct FROM {name}3)"""


@add("chain_greeks", with_(CHAIN, "ch2 AS (SELECT *, CASE WHEN \"right\" = 'P' THEN 'put' ELSE 'call' END AS side FROM chain)", greeks_cte("gx", "ch2", "strike", "last", "(iv * 100)", "side"), select="""
SELECT contract_id AS contract, delta, gamma, theta_per_day, vega_per_vol_point, breakeven_price, breakeven_pct FROM gx"""))
def chain_greeks(spark, sf_dir):
    df = contracts(spark, sf_dir).withColumn("side", F.when(F.col("right") == "P", "put").otherwise("call"))
    df = opt.add_greeks(df.withColumn("iv_pct", F.col("iv") * 100), "spot", "strike", "last", "iv_pct", "dte", "side")
    return df.select("contract", "delta", "gamma", "theta_per_day", "vega_per_vol_point", "breakeven_price", "breakeven_pct")


GATE_RULES = (
    ("dte < 3", 35, 4, "dte_0_2"), ("dte >= 3 AND dte < 7", 60, 4, "dte_below_7"), ("exact_oi < 100", 45, 4, "contract_oi_thin"), ("exact_volume < 50", 50, 4, "contract_volume_low"),
    ("spread_pct > 25", 45, 4, "spread_very_wide"), ("spread_pct > 15 AND spread_pct <= 25", 65, 3, "spread_wide"), ("avg_iv > 150 AND dte < 21", 65, 3, "iv_extreme_short_dte"),
    ("avg_iv > 100 AND NOT (avg_iv > 150 AND dte < 21)", 72, 3, "iv_very_high"), ("premium_pct_spot > 8", 70, 3, "premium_expensive"), ("iv_realized_ratio > 3", 58, 4, "iv_over_realized_3x"),
    ("iv_realized_ratio > 2 AND iv_realized_ratio <= 3", 68, 3, "iv_over_realized_2x"), ("iv_rank >= 85", 62, 3, "iv_rank_very_high"), ("iv_rank >= 70 AND iv_rank < 85", 72, 3, "iv_rank_high"),
    ("early AND COALESCE(days_to_earnings <= 5, FALSE)", 58, 3, "earnings_within_5d"), ("early AND NOT COALESCE(days_to_earnings <= 5, FALSE)", 66, 3, "earnings_before_expiry"),
    ("bleed > 4", 60, 4, "theta_bleed_4pct"), ("bleed > 2 AND bleed <= 4", 70, 3, "theta_bleed_2pct"),
)


def gate_cte(name: str, source: str) -> str:
    cap = "LEAST(" + ", ".join(f"CASE WHEN {c} THEN {v}::DOUBLE END" for c, v, _, _ in GATE_RULES) + ")"
    rank = "GREATEST(CASE WHEN confidence >= 80 THEN 0 WHEN confidence >= 65 THEN 1 ELSE 2 END, " + ", ".join(f"CASE WHEN {c} THEN {k} END" for c, _, k, _ in GATE_RULES) + ")"
    why = "CONCAT_WS('; ', " + ", ".join(f"CASE WHEN {c} THEN '{t}' END" for c, _, _, t in GATE_RULES) + ")"
    return f"""{name}0 AS (SELECT *, COALESCE(earnings_in_window, FALSE) AS early, CASE WHEN COALESCE(reference_price, 0) <> 0 THEN ABS(theta_per_day) / reference_price * 100 END AS bleed FROM {source}),
{name}1 AS (SELECT *, {cap} AS cap, {rank} AS grank, CASE WHEN action <> 'NO TRADE' THEN {why} END AS gate_reasons FROM {name}0),
{name}2 AS (SELECT *, CASE WHEN action = 'NO TRADE' THEN LEAST(confidence, 25) WHEN cap IS NOT NULL THEN {rs('LEAST(confidence, cap)', 1)} ELSE confidence END AS gconf FROM {name}1),
{name} AS (SELECT *, ['high', 'medium', 'watch', 'spread only', 'paper only', 'no trade'][1 + CASE WHEN action = 'NO TRADE' THEN 5 WHEN grank = 0 AND gconf < 80 THEN CASE WHEN gconf >= 65 THEN 1 ELSE 2 END ELSE grank END] AS risk_gate FROM {name}2)"""


READY = """CASE WHEN risk_gate NOT IN ('high', 'medium', 'watch') THEN risk_gate WHEN action = 'NO TRADE' THEN 'no trade' WHEN COALESCE(NULLIF(exact_oi, 0), total_oi) < 100 OR COALESCE(spread_pct > 25, FALSE) THEN 'paper only'
  WHEN gconf >= 75 THEN 'high' WHEN gconf >= 55 THEN 'medium' ELSE 'low' END"""
GATE_INPUT = f"""gi AS (SELECT contract_id, (contract_id % 40)::BIGINT AS dte, (contract_id * 7 % 101)::DOUBLE AS confidence, CASE WHEN contract_id % 6 = 0 THEN 'NO TRADE' ELSE 'BUY CALL' END AS action, iv * 250 AS avg_iv,
  oi::BIGINT AS exact_oi, oi::BIGINT AS total_oi, volume AS exact_volume, {spp('bid', 'ask')} AS spread_pct, CASE WHEN contract_id % 4 <> 0 THEN last * 2 END AS premium_pct_spot, CASE WHEN contract_id % 5 <> 0 THEN (contract_id % 41) / 10.0 END AS iv_realized_ratio,
  CASE WHEN contract_id % 7 <> 0 THEN (contract_id % 101)::DOUBLE END AS iv_rank, contract_id % 8 = 0 AS earnings_in_window, CASE WHEN contract_id % 16 = 0 THEN (contract_id % 12)::BIGINT END AS days_to_earnings, -(contract_id % 20) / 100.0 AS theta_per_day, last AS reference_price FROM chain)"""


@add("options_risk_gate", with_(CHAIN, GATE_INPUT, gate_cte("gg", "gi"), select=f"""
SELECT contract_id AS contract, {r('gconf')} AS confidence, risk_gate, {READY} AS readiness, gate_reasons FROM gg"""))
def options_risk_gate(spark, sf_dir):
    c = F.col("contract")
    df = contracts(spark, sf_dir).select(
        "contract",
        (c % 40).cast("int").alias("dte"),
        (c * 7 % 101).cast("double").alias("confidence"),
        F.when(c % 6 == 0, "NO TRADE").otherwise("BUY CALL").alias("action"),
        (F.col("iv") * 250).alias("avg_iv"),
        F.col("oi").alias("exact_oi"),
        F.col("volume").alias("exact_volume"),
        opt.spread_pct(F.col("bid"), F.col("ask")).alias("spread_pct"),
        F.when(c % 4 != 0, F.col("last") * 2).alias("premium_pct_spot"),
        F.when(c % 5 != 0, (c % 41) / 10.0).alias("iv_realized_ratio"),
        F.when(c % 7 != 0, (c % 101).cast("double")).alias("iv_rank"),
        (c % 8 == 0).alias("earnings_in_window"),
        F.when(c % 16 == 0, c % 12).alias("days_to_earnings"),
        (-(c % 20) / 100.0).alias("theta_per_day"),
        F.col("last").alias("reference_price"),
    )
    df = opt.add_risk_gate(df)
    ready = opt.readiness(F.col("confidence"), F.col("exact_oi"), F.col("spread_pct"), F.col("action"), F.col("risk_gate"))
    return df.select("contract", "confidence", "risk_gate", ready.alias("readiness"), "gate_reasons")


def structure_cte(name: str, source: str) -> str:
    up, dn = "option_direction = 'up'", "option_direction = 'down'"
    return f"""{name}0 AS (SELECT *, ABS(expected_move_pct) / 100 * atm_strike AS w0, COALESCE(iv_rank >= 60, FALSE) OR COALESCE(avg_iv >= 70, FALSE) OR COALESCE(iv_realized_ratio >= 1.6, FALSE) AS rich,
    CASE WHEN {up} THEN 1.0 WHEN {dn} THEN -1.0 END::DOUBLE AS sgn FROM {source}),
{name}1 AS (SELECT *, CASE WHEN COALESCE(atm_strike, 0) <> 0 AND COALESCE(expected_move_pct, 0) <> 0 AND w0 > 0 THEN w0 END AS w FROM {name}0),
{name}2 AS (SELECT *, {rs('CASE WHEN NULLIF(reference_price, 0) IS NOT NULL THEN LEAST(reference_price, w * 0.9::DOUBLE) * 0.55::DOUBLE ELSE w * 0.45::DOUBLE END', 2)} AS debit, {rs('atm_strike', 2)} AS long_k, {rs('atm_strike + sgn * w', 2)} AS short_k,
    {rs('w * CASE WHEN sgn IS NOT NULL THEN 0.35 ELSE 0.6 END::DOUBLE', 2)} AS credit, {rs('atm_strike - sgn * w', 2)} AS sell_k, {rs('atm_strike - sgn * 2 * w', 2)} AS buy_k FROM {name}1),
{name} AS (SELECT *, CASE WHEN w IS NOT NULL AND sgn IS NOT NULL THEN CASE WHEN {up} THEN 'call_debit_spread' ELSE 'put_debit_spread' END END AS spread_type, CASE WHEN w IS NOT NULL AND sgn IS NOT NULL THEN debit END AS est_net_debit,
    CASE WHEN w IS NOT NULL AND sgn IS NOT NULL THEN {rs('debit * 100', 2)} END AS spread_max_loss, CASE WHEN w IS NOT NULL AND sgn IS NOT NULL THEN {rs('GREATEST(0, sgn * (short_k - long_k) - debit) * 100', 2)} END AS spread_max_gain,
    CASE WHEN w IS NOT NULL AND sgn IS NOT NULL THEN {rs('long_k + sgn * debit', 2)} END AS spread_breakeven,
    CASE WHEN w IS NULL OR NOT rich THEN NULL WHEN {up} THEN 'bull_put_credit_spread' WHEN {dn} THEN 'bear_call_credit_spread' ELSE 'iron_condor' END AS alt_type,
    CASE WHEN w IS NOT NULL AND rich THEN {rs('credit * 100', 2)} END AS alt_max_gain, CASE WHEN w IS NOT NULL AND rich THEN {rs('GREATEST(0, CASE WHEN sgn IS NULL THEN w ELSE sgn * (sell_k - buy_k) END - credit) * 100', 2)} END AS alt_max_loss,
    CASE WHEN w IS NULL THEN NULL WHEN {up} AND rich THEN 'bull put credit spread' WHEN {up} THEN 'long call or call debit spread' WHEN {dn} AND rich THEN 'bear call credit spread' WHEN {dn} THEN 'long put or put debit spread'
      WHEN rich THEN 'iron condor' ELSE 'no clear options edge' END AS strategy_label FROM {name}2)"""


STRUCT_COLS = "spread_type, est_net_debit, spread_max_loss, spread_max_gain, spread_breakeven, alt_type, alt_max_gain, alt_max_loss, strategy_label"


def _flat_structures(df):
    s, a = "spread", "alt_structure"
    return [
        F.col(f"{s}.type").alias("spread_type"),
        F.col(f"{s}.est_net_debit").alias("est_net_debit"),
        F.col(f"{s}.est_max_loss").alias("spread_max_loss"),
        F.col(f"{s}.est_max_gain").alias("spread_max_gain"),
        F.col(f"{s}.breakeven").alias("spread_breakeven"),
        F.col(f"{a}.type").alias("alt_type"),
        F.col(f"{a}.est_max_gain").alias("alt_max_gain"),
        F.col(f"{a}.est_max_loss").alias("alt_max_loss"),
        "strategy_label",
    ]


@add("spread_structures", with_(CHAIN, f"""si AS (SELECT contract_id, {SIDE3} AS option_direction, strike AS atm_strike, CASE WHEN contract_id % 13 <> 0 THEN (contract_id % 120) / 10.0 END::DOUBLE AS expected_move_pct,
  CASE WHEN contract_id % 9 <> 0 THEN last END AS reference_price, iv * 100 AS avg_iv, CASE WHEN contract_id % 7 <> 0 THEN (contract_id % 80)::DOUBLE END AS iv_rank, (contract_id % 18) / 10.0 AS iv_realized_ratio FROM chain)""",
  structure_cte("sx", "si"), select=f"SELECT contract_id AS contract, {STRUCT_COLS} FROM sx"))
def spread_structures(spark, sf_dir):
    c = F.col("contract")
    df = contracts(spark, sf_dir).select(
        "contract",
        _side3().alias("option_direction"),
        F.col("strike").alias("atm_strike"),
        F.when(c % 13 != 0, (c % 120) / 10.0).alias("expected_move_pct"),
        F.when(c % 9 != 0, F.col("last")).alias("reference_price"),
        (F.col("iv") * 100).alias("avg_iv"),
        F.when(c % 7 != 0, (c % 80).cast("double")).alias("iv_rank"),
        ((c % 18) / 10.0).alias("iv_realized_ratio"),
    )
    df = opt.add_structures(df)
    return df.select("contract", *_flat_structures(df))


DIR5 = "CASE {k} % 6 WHEN 0 THEN 'bullish' WHEN 1 THEN 'neutral_to_bullish' WHEN 2 THEN 'neutral' WHEN 3 THEN 'neutral_to_bearish' WHEN 4 THEN 'bearish' ELSE 'avoid' END"


def dir5(k):
    names = F.array(*[F.lit(x) for x in ("bullish", "neutral_to_bullish", "neutral", "neutral_to_bearish", "bearish", "avoid")])
    return F.element_at(names, (k % 6 + 1).cast("int"))


BRAND = "CAST(SUBSTRING(ticker, 7) AS BIGINT)"


def brand():
    return F.substring("ticker", 7, 10).cast("long")


@add("option_trade_idea", with_(CHAIN, METRICS, f"""ti0 AS (SELECT *, {DIR5.format(k=f'({BRAND} + dte)')} AS direction FROM metrics),
ti1 AS (SELECT *, CASE WHEN direction = 'avoid' THEN 'avoid' WHEN direction IN ('bullish', 'neutral_to_bullish') THEN 'bullish' WHEN direction IN ('bearish', 'neutral_to_bearish') THEN 'bearish' ELSE 'neutral' END AS bias,
  COALESCE(avg_iv >= 70, FALSE) AS rich FROM ti0)""", select=f"""
SELECT ticker, dte::BIGINT AS dte, bias, CASE WHEN total_oi < 500 THEN 'avoid_or_paper_only_due_to_low_options_liquidity' WHEN bias = 'bullish' AND rich THEN 'call_debit_spread' WHEN bias = 'bullish' THEN 'long_call_or_call_debit_spread'
  WHEN bias = 'bearish' AND rich THEN 'put_debit_spread' WHEN bias = 'bearish' THEN 'long_put_or_put_debit_spread' ELSE 'no_short_term_options_edge' END AS idea,
  CASE bias WHEN 'bullish' THEN atm_call WHEN 'bearish' THEN atm_put END AS idea_contract,
  CASE WHEN bias IN ('bullish', 'bearish') AND expected_move_pct IS NOT NULL AND atm_strike IS NOT NULL THEN {rs("atm_strike + CASE bias WHEN 'bullish' THEN 1 ELSE -1 END * (ABS(expected_move_pct) / 100 * atm_strike)", 2)} END AS short_strike,
  CONCAT_WS('; ', CASE WHEN rich THEN 'high_iv_favors_spreads' END, CASE WHEN total_oi < 500 THEN 'thin_liquidity' END, CASE WHEN dte <= 2 THEN 'very_short_dte' END) AS idea_notes FROM ti1"""))
def option_trade_idea(spark, sf_dir):
    df = metrics(spark, sf_dir).withColumn("direction", dir5(brand() + F.col("dte")))
    df = opt.trade_idea(df)
    return df.select("ticker", "dte", "bias", "idea", "idea_contract", F.col("suggested_spread.short_strike").alias("short_strike"), "idea_notes")


SIGNAL = f"""sig AS (SELECT *, {BRAND} AS b FROM term),
sig2 AS (SELECT *, CASE b % 3 WHEN 0 THEN 'up' WHEN 1 THEN 'down' ELSE 'neutral' END AS lean, (b % 10) / 10.0 AS conviction, (40 + 2 * b)::DOUBLE AS data_quality, b % 6 AS algo, (30 + 2 * b)::DOUBLE AS ticker_risk,
   (20 + b)::DOUBLE AS realized_vol, CASE WHEN b % 4 <> 0 THEN b % 20 END AS days_to_earnings, b % 5 = 0 AS is_index, (b * 4)::DOUBLE AS expected_points, (b * 4 % 101)::DOUBLE AS iv_rank FROM sig),
s3 AS (SELECT *, CASE WHEN is_index AND expected_points < 50 THEN 'neutral' ELSE lean END AS side FROM sig2),
s4 AS (SELECT *, CASE side WHEN 'up' THEN 'BUY CALL' WHEN 'down' THEN 'BUY PUT' ELSE 'NO TRADE' END AS action, lean AS option_direction,
   {rs(clip("conviction * 100 * GREATEST(0.2, LEAST(1, total_oi / 2000::DOUBLE)) * CASE WHEN avg_iv > 90 THEN 0.55 WHEN avg_iv > 70 THEN 0.75 ELSE 1 END * (" + DTEF + ") + CASE WHEN side = 'up' AND put_call_ratio < 0.9 THEN 6 WHEN side = 'down' AND put_call_ratio > 1.1 THEN 6 WHEN (side = 'up' AND put_call_ratio > 1.3) OR (side = 'down' AND put_call_ratio < 0.7) THEN -6 ELSE 0 END"), 1)} AS legacy,
   CASE WHEN side = 'up' OR (lean = 'up' AND atm_call IS NOT NULL) THEN TRUE WHEN side = 'down' OR (lean = 'down' AND atm_put IS NOT NULL) THEN FALSE WHEN atm_call IS NOT NULL AND atm_put IS NOT NULL THEN
     CASE WHEN COALESCE(NULLIF(atm_call_last, 0), 1e9) <> COALESCE(NULLIF(atm_put_last, 0), 1e9) THEN COALESCE(NULLIF(atm_call_last, 0), 1e9) < COALESCE(NULLIF(atm_put_last, 0), 1e9)
          ELSE atm_call_volume + atm_call_oi >= atm_put_volume + atm_put_oi END END AS use_call FROM s3),
s5 AS (SELECT *, {', '.join(f"CASE WHEN use_call THEN atm_call{f} WHEN NOT use_call THEN atm_put{f} END AS {n}" for f, n in (('', 'reference_contract'), ('_last', 'reference_price'), ('_bid', 'rbid'), ('_ask', 'rask'), ('_volume', 'exact_volume'), ('_oi', 'exact_oi'), ('_iv', 'riv0')))},
   CASE WHEN use_call THEN 'call' WHEN NOT use_call THEN 'put' END AS rtype FROM s4),
s6 AS (SELECT s.*, COALESCE(NULLIF(riv0, 0), avg_iv) AS reference_iv, CASE WHEN c.contract_id % 3 <> 0 THEN c.oi - 40 * (c.contract_id % 5 - 2) END AS prev FROM s5 s LEFT JOIN chain c ON CAST(c.contract_id AS VARCHAR) = s.reference_contract),
s7 AS (SELECT *, {unusual_sql('exact_volume', 'exact_oi', 'prev', 'total_volume', 'total_oi')['score']} AS unusual_score0, {spp('rbid', 'rask')} AS spread_pct, {flow('option_direction', 'put_call_ratio')} AS flow_alignment,
   {rs('NULLIF(reference_price, 0) / spot * 100', 2)} AS premium_pct_spot, {rs('reference_iv / realized_vol', 2)} AS iv_realized_ratio, COALESCE(NULLIF(reference_iv, 0), avg_iv) AS giv, COALESCE(rtype, 'call') AS gright FROM s6),
s7b AS (SELECT *, CASE WHEN exact_oi IS NULL THEN {rs("LEAST(25, COALESCE(total_volume / NULLIF(total_oi, 0)::DOUBLE, 0) * 40)", 1)} ELSE unusual_score0 END AS unusual_score FROM s7)"""
IDEAS = f"""{greeks_cte('s8', 's7b', 'atm_strike', 'reference_price', 'giv', 'gright')},
s9 AS (SELECT *, GREATEST(0.05, LEAST(1, 0.65::DOUBLE * LEAST(1, total_oi / 2500::DOUBLE) + 0.35::DOUBLE * LEAST(1, total_volume / 1000::DOUBLE))) AS depth FROM s8),
s10 AS (SELECT *, {rs(f"100 * (0.26::DOUBLE * depth + 0.20::DOUBLE * ({DTEF}) + 0.18::DOUBLE * ({ivf('avg_iv')}) + 0.20::DOUBLE * ({flowf('flow_alignment')}) + 0.16::DOUBLE * ({spf('spread_pct')}))", 1)} AS q0 FROM s9),
s11 AS (SELECT *, CASE WHEN action = 'NO TRADE' THEN q0 ELSE {rs("LEAST(100, q0 + LEAST(6, unusual_score * 0.06::DOUBLE))", 1)} END AS q1 FROM s10),
s12 AS (SELECT *, CASE WHEN action = 'NO TRADE' THEN LEAST(legacy, 25) ELSE LEAST({rs("GREATEST(legacy, 100 * (0.46::DOUBLE * conviction + 0.16::DOUBLE * GREATEST(0, LEAST(1, data_quality / 100)) + 0.14::DOUBLE * (algo / 5::DOUBLE) + 0.24::DOUBLE * (q1 / 100)))", 1)},
    CASE WHEN ticker_risk >= 80 THEN 55 WHEN ticker_risk >= 65 THEN 70 END, CASE WHEN total_oi < 100 THEN 55 END, CASE WHEN reference_contract IS NULL OR COALESCE(reference_price, 0) <= 0 THEN 50 END, CASE WHEN spread_pct > 25 THEN 60 END) END AS confidence,
    CASE WHEN action = 'NO TRADE' THEN LEAST(q1, 45) ELSE q1 END AS option_quality, COALESCE(days_to_earnings BETWEEN 0 AND dte, FALSE) AS earnings_in_window FROM s11),
{gate_cte('s13', 's12')}, {structure_cte('s14', 's13')},
ideas AS (SELECT *, {READY} AS readiness FROM s14)"""


def ideas(spark, sf_dir):
    """Every expiry of every ticker with its decision columns."""
    df = opt.add_skew(opt.add_term_structure(metrics(spark, sf_dir)))
    c = F.col("contract_id")
    stored = data.chain(spark, sf_dir).where(c % 3 != 0).select(
        "ticker", c.cast("string").alias("contract"), (F.col("oi") - 40 * (c % 5 - 2)).alias("exact_oi")
    )
    b = brand()
    df = opt.join_previous_oi(df, stored).withColumns(
        {
            "signal_direction": F.when(b % 3 == 0, "up").when(b % 3 == 1, "down").otherwise("neutral"),
            "conviction": (b % 10) / 10.0,
            "data_quality": (40 + 2 * b).cast("double"),
            "algo_confluence": b % 6,
            "ticker_risk": (30 + 2 * b).cast("double"),
            "realized_vol": (20 + b).cast("double"),
            "days_to_earnings": F.when(b % 4 != 0, b % 20),
            "is_index": b % 5 == 0,
            "expected_points": (b * 4).cast("double"),
            "min_index_points": F.lit(50.0),
            "iv_rank": (b * 4 % 101).cast("double"),
        }
    )
    return opt.add_expiry_ideas(df)


@add("expiry_ideas", with_(CHAIN, METRICS, TERM, SIGNAL, IDEAS, select=f"""
SELECT ticker, dte::BIGINT AS dte, action, option_direction, reference_contract, {r('reference_price')} AS reference_price, {r('gconf')} AS confidence, {r('option_quality')} AS option_quality, unusual_score, spread_pct, flow_alignment, premium_pct_spot, iv_realized_ratio,
  delta, theta_per_day, breakeven_price, earnings_in_window, risk_gate, readiness, gate_reasons, {STRUCT_COLS} FROM ideas"""))
def expiry_ideas(spark, sf_dir):
    df = ideas(spark, sf_dir)
    return df.select(
        "ticker", "dte", "action", "option_direction", "reference_contract", "reference_price", "confidence", "option_quality",
        "unusual_score", "spread_pct", "flow_alignment", "premium_pct_spot", "iv_realized_ratio", "delta", "theta_per_day",
        "breakeven_price", "earnings_in_window", "risk_gate", "readiness", "gate_reasons", *_flat_structures(df),
    )


@add("top_expiries", with_(CHAIN, METRICS, TERM, SIGNAL, IDEAS, select=f"""
SELECT * FROM (SELECT ticker, dte::BIGINT AS dte, action, {r('gconf')} AS confidence, risk_gate, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY gconf DESC, dte) AS rank FROM ideas) WHERE rank <= 3"""))
def top_expiries(spark, sf_dir):
    return opt.rank_expiries(ideas(spark, sf_dir)).select("ticker", "dte", "action", "confidence", "risk_gate", "rank")


@add("latest_contract_snapshot", with_(IV_SNAPSHOTS, select=f"""
SELECT ticker, 'C' || ticker || expiration AS contract, strftime(as_of, '%Y-%m-%d %H:%M:%S') AS as_of, {r('avg_iv')} AS avg_iv FROM iv_snapshots
QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker, expiration ORDER BY as_of DESC, seq DESC) = 1"""))
def latest_contract_snapshot(spark, sf_dir):
    snaps = data.iv_snapshots(spark, sf_dir).withColumn("reference_contract", F.concat(F.lit("c"), "ticker", "expiration"))
    return opt.latest_contracts(snaps).select("ticker", "contract", "as_of", "avg_iv")


IVH = "ivh AS (SELECT * FROM iv_snapshots QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY as_of DESC, seq DESC) <= 250)"


@add("iv_history", with_(IV_SNAPSHOTS, select=f"""
SELECT ticker, seq, {r('avg_iv')} AS avg_iv, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY as_of DESC, seq DESC) AS rank FROM iv_snapshots) WHERE rank <= 250"""))
def iv_history(spark, sf_dir):
    return opt.iv_history(data.iv_snapshots(spark, sf_dir)).select("ticker", "seq", "avg_iv", "rank")


IVR = f"""cur AS (SELECT ticker, expiration, AVG(avg_iv) AS cur FROM iv_snapshots GROUP BY 1, 2),
ivx AS (SELECT c.ticker, c.expiration, c.cur, COUNT(CASE WHEN h.expiration = c.expiration THEN 1 END) AS ne, COUNT(*) AS na, MIN(CASE WHEN h.expiration = c.expiration THEN h.avg_iv END) AS le, MAX(CASE WHEN h.expiration = c.expiration THEN h.avg_iv END) AS he,
  MIN(h.avg_iv) AS la, MAX(h.avg_iv) AS ha, COUNT(CASE WHEN h.expiration = c.expiration AND h.avg_iv <= c.cur THEN 1 END) AS pe, COUNT(CASE WHEN h.avg_iv <= c.cur THEN 1 END) AS pa FROM cur c JOIN ivh h ON h.ticker = c.ticker GROUP BY 1, 2, 3),
ivy AS (SELECT *, ne >= 20 AS ex, CASE WHEN ne >= 20 THEN ne ELSE na END AS n, CASE WHEN ne >= 20 THEN le ELSE la END AS lo, CASE WHEN ne >= 20 THEN he ELSE ha END AS hi, CASE WHEN ne >= 20 THEN pe ELSE pa END AS p FROM ivx)"""


@add("iv_rank", with_(IV_SNAPSHOTS, IVH, IVR, select=f"""
SELECT ticker, expiration, CASE WHEN n >= 20 THEN {rs(clip('CASE WHEN hi <= lo THEN 50 ELSE (cur - lo) / (hi - lo) * 100 END'), 1)} END AS iv_rank, CASE WHEN n >= 20 THEN {rs('p / n::DOUBLE * 100', 1)} END AS iv_percentile,
  n AS iv_history_count, CASE WHEN n >= 20 THEN CASE WHEN ex THEN 'exact_expiration' ELSE 'ticker' END END AS iv_history_scope FROM ivy"""))
def iv_rank(spark, sf_dir):
    """Rank of each expiry's mean reading within the ticker's stored history."""
    snaps = data.iv_snapshots(spark, sf_dir)
    current = snaps.groupBy("ticker", "expiration").agg(F.avg("avg_iv").alias("current_iv"))
    return opt.iv_rank(current, opt.iv_history(snaps)).select(
        "ticker", "expiration", "iv_rank", "iv_percentile", "iv_history_count", "iv_history_scope"
    )


LABELS = ("iron condor", "bull put credit spread", "bear call credit spread", "bull call debit", "bear put debit", "")
STRAT = f"""st0 AS (SELECT ticker, contract_id AS contract, last * 4 AS premium, (contract_id % 9) / 10.0 AS delta, volume, (contract_id * 3 % 100)::DOUBLE AS confidence, CASE contract_id % 3 WHEN 0 THEN 'BUY CALL' WHEN 1 THEN 'BUY PUT' ELSE 'NO TRADE' END AS action,
   {SIDE3} AS option_direction, ['{"', '".join(LABELS)}'][contract_id % 6 + 1] AS strategy_label, 4000.0 AS current_price, 4000.0 + contract_id % 97 - 40 AS target_price, CASE WHEN contract_id % 2 = 0 THEN (contract_id % 97 - 40)::DOUBLE END AS expected_points, (contract_id % 101)::DOUBLE AS momentum FROM chain),
st1 AS (SELECT *, LEAST(CASE WHEN delta <> 0 THEN premium + ABS(delta) * ABS(target_price - current_price) ELSE premium * 1.25::DOUBLE END, premium * 3.5::DOUBLE) AS ex, COALESCE(expected_points, target_price - current_price) AS mv, COALESCE(NULLIF(momentum, 0), 50) AS mom FROM st0 WHERE premium > 0 AND premium < 35),
st2 AS (SELECT *, (ex - premium) / premium * 100 AS pct, ABS(mv) >= 50 AS move_ok, (ex - premium) / premium * 100 >= 10 AS profit_ok, action = 'NO TRADE' OR option_direction = 'neutral' AS idle FROM st1),
st3 AS (SELECT *, move_ok AND profit_ok AND NOT idle AND confidence >= 35 AS actionable, {rs("0.34::DOUBLE * confidence + 0.24::DOUBLE * (GREATEST(0, (35 - premium) / 35) * 100) + 0.24::DOUBLE * LEAST(100, volume / 1000 * 100) + 0.18::DOUBLE * CASE option_direction WHEN 'up' THEN mom WHEN 'down' THEN 100 - mom ELSE 50 END", 1)} AS select_score FROM st2)"""
STRAT_COLS = f"""ticker, contract, CASE WHEN idle THEN 'no_directional_edge' WHEN actionable THEN 'actionable' WHEN move_ok AND profit_ok THEN 'low_confidence' WHEN profit_ok THEN 'needs_index_points' WHEN move_ok THEN 'low_option_profit' ELSE 'watch' END AS status,
  CASE strategy_label WHEN 'iron condor' THEN 'Iron Condor (defined-risk range)' WHEN 'bull put credit spread' THEN 'Bull Put Credit Spread' WHEN 'bear call credit spread' THEN 'Bear Call Credit Spread' WHEN 'bull call debit' THEN 'Bull Call Debit Spread'
    WHEN 'bear put debit' THEN 'Bear Put Debit Spread' ELSE CASE action WHEN 'BUY CALL' THEN 'Long Call' WHEN 'BUY PUT' THEN 'Long Put' ELSE 'No directional edge' END END AS strategy,
  {rs('ex', 2)} AS est_exit, {rs('pct', 1)} AS profit_pct, {rs('(ex - premium) * 100', 0)} AS profit_per_contract, actionable, select_score"""


def strategy_rows(spark, sf_dir):
    c = F.col("contract")
    labels = F.array(*[F.lit(x) for x in LABELS])
    rows = contracts(spark, sf_dir).select(
        "ticker",
        "contract",
        (F.col("last") * 4).alias("premium"),
        ((c % 9) / 10.0).alias("delta"),
        "volume",
        (c * 3 % 100).cast("double").alias("confidence"),
        F.when(c % 3 == 0, "BUY CALL").when(c % 3 == 1, "BUY PUT").otherwise("NO TRADE").alias("action"),
        _side3().alias("option_direction"),
        F.element_at(labels, (c % 6 + 1).cast("int")).alias("strategy_label"),
        F.lit(4000.0).alias("current_price"),
        (4000.0 + c % 97 - 40).alias("target_price"),
        F.when(c % 2 == 0, (c % 97 - 40).cast("double")).alias("expected_points"),
        (c % 101).cast("double").alias("momentum"),
    )
    return rep.add_index_strategies(rows)


STRAT_NAMES = ["ticker", "contract", "status", "strategy", "est_exit", "profit_pct", "profit_per_contract", "actionable", "select_score"]


@add("index_strategies", with_(CHAIN, STRAT, select=f"SELECT {STRAT_COLS} FROM st3"))
def index_strategies(spark, sf_dir):
    return strategy_rows(spark, sf_dir).select(*STRAT_NAMES)


@add("top_index_strategies", with_(CHAIN, STRAT, select=f"""
SELECT * FROM (SELECT {STRAT_COLS}, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY actionable DESC, select_score DESC, contract) AS rank FROM st3) WHERE rank <= 3"""))
def top_index_strategies(spark, sf_dir):
    return rep.top_strategies(strategy_rows(spark, sf_dir)).select(*STRAT_NAMES, "rank")


PLAN = f"""pl0 AS (SELECT ticker, contract_id, CASE WHEN contract_id % 5 <> 0 THEN contract_id END AS contract, dte::BIGINT AS dte, last * 6 AS reference_price, {spp('bid', 'ask')} AS spread_pct, (contract_id * 7 % 100)::DOUBLE AS confidence, (contract_id * 11 % 100)::DOUBLE AS opportunity_score,
  (contract_id * 13 % 100)::DOUBLE AS risk_score, (contract_id % 90)::DOUBLE AS option_quality, ['high', 'spread only', 'watch', 'paper only'][contract_id % 4 + 1] AS risk_gate, {DIR5.format(k='contract_id')} AS direction, contract_id % 19 = 0 AS block_trade,
  CASE contract_id % 3 WHEN 0 THEN 'BUY CALL' WHEN 1 THEN 'BUY PUT' ELSE 'NO TRADE' END AS action, contract_id % 2 = 0 AS is_index, 100.0 AS current_price, 100.0 + contract_id % 23 - 11 AS target_price, CASE WHEN contract_id % 4 = 0 THEN 95.0 + contract_id % 9 END AS stop_price,
  CASE WHEN contract_id % 6 <> 0 THEN -(contract_id % 14)::DOUBLE END AS p05, CASE WHEN contract_id % 7 <> 0 THEN (contract_id % 9) / 10.0 END AS delta FROM chain)"""


def plan_rows(spark, sf_dir):
    c = F.col("contract_id")
    gates = F.array(*[F.lit(g) for g in ("high", "spread only", "watch", "paper only")])
    return data.chain(spark, sf_dir).select(
        "ticker",
        "contract_id",
        F.when(c % 5 != 0, c).alias("contract"),
        "dte",
        (F.col("last") * 6).alias("reference_price"),
        opt.spread_pct(F.col("bid"), F.col("ask")).alias("spread_pct"),
        (c * 7 % 100).cast("double").alias("confidence"),
        (c * 11 % 100).cast("double").alias("opportunity_score"),
        (c * 13 % 100).cast("double").alias("risk_score"),
        (c % 90).cast("double").alias("option_quality"),
        F.element_at(gates, (c % 4 + 1).cast("int")).alias("risk_gate"),
        F.lit(None).cast("string").alias("readiness"),
        F.lit(None).cast("string").alias("research_action"),
        dir5(c).alias("direction"),
        (c % 19 == 0).alias("block_trade"),
        F.when(c % 3 == 0, "BUY CALL").when(c % 3 == 1, "BUY PUT").otherwise("NO TRADE").alias("action"),
        (c % 2 == 0).alias("is_index"),
        F.lit(100.0).alias("current_price"),
        (100.0 + c % 23 - 11).alias("target_price"),
        F.when(c % 4 == 0, 95.0 + c % 9).alias("stop_price"),
        F.when(c % 6 != 0, -(c % 14).cast("double")).alias("p05"),
        F.when(c % 7 != 0, (c % 9) / 10.0).alias("delta"),
    )


@add("tradeable_expiries", with_(CHAIN, PLAN, f"""te AS (SELECT *, COALESCE(NULLIF(spread_pct, 0), 99) AS sp FROM pl0 WHERE is_index AND dte >= 5 AND action <> 'NO TRADE' AND reference_price > 0 AND reference_price <= 35),
te2 AS (SELECT *, {r("confidence + CASE risk_gate WHEN 'high' THEN 20 WHEN 'spread only' THEN 10 WHEN 'watch' THEN 4 ELSE -8 END + CASE WHEN sp <= 8 THEN 12 WHEN sp <= 12 THEN 6 ELSE -8 END + 10")} AS merit FROM te)""", select="""
SELECT * FROM (SELECT ticker, contract_id AS contract, merit, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY merit DESC, option_quality DESC, sp, reference_price, contract_id) AS rank FROM te2) WHERE rank <= 3"""))
def tradeable_expiries(spark, sf_dir):
    rows = plan_rows(spark, sf_dir).withColumn("contract", F.col("contract_id"))
    return rep.tradeable_expiries(rows).select("ticker", "contract", "merit", "rank")


@add("strategy_sort_score", with_(CHAIN, PLAN, select=f"""
SELECT contract_id, {r("confidence * 0.45::DOUBLE + opportunity_score * 0.25::DOUBLE - risk_score * 0.22::DOUBLE + CASE WHEN direction NOT IN ('neutral', 'avoid') THEN 10 ELSE 0 END + CASE WHEN contract IS NOT NULL THEN 12 ELSE 0 END + CASE risk_gate WHEN 'high' THEN 22 WHEN 'spread only' THEN 12 WHEN 'paper only' THEN -8 ELSE 0 END + CASE WHEN action <> 'NO TRADE' THEN 8 ELSE 0 END + CASE WHEN block_trade OR direction = 'avoid' THEN -40 ELSE 0 END + CASE WHEN contract IS NOT NULL AND spread_pct <= 8 THEN 5 WHEN contract IS NULL OR spread_pct IS NULL OR spread_pct > 20 THEN -8 ELSE 0 END")} AS sort_score FROM pl0"""))
def strategy_sort_score(spark, sf_dir):
    return plan_rows(spark, sf_dir).select("contract_id", rep.strategy_sort_score().alias("sort_score"))


@add("trade_plan", with_(CHAIN, PLAN, f"""pl1 AS (SELECT *, CASE WHEN direction LIKE '%bearish%' OR action = 'BUY PUT' THEN 'short' ELSE 'long' END AS side, LEAST(GREATEST(CASE WHEN p05 IS NOT NULL THEN ABS(p05) / 100 * 0.75 ELSE 0.045 END, 0.035), 0.095)::DOUBLE AS bnd FROM pl0),
pl2 AS (SELECT *, COALESCE(stop_price, CASE WHEN side = 'short' THEN current_price * (1 + bnd) ELSE current_price * (1 - bnd) END) AS plan_stop, CASE WHEN delta IS NOT NULL THEN reference_price + ABS(delta) * ABS(target_price - current_price) ELSE reference_price * 1.25::DOUBLE END AS ex,
  CASE WHEN block_trade OR direction IN ('neutral', 'avoid') THEN 'wait' WHEN risk_gate = 'high' AND confidence >= 55 THEN 'tradeable research' WHEN risk_gate = 'spread only' THEN 'defined-risk spread' ELSE 'paper/watch' END AS cls FROM pl1),
pl3 AS (SELECT *, (ex - reference_price) / reference_price * 100 AS pct FROM pl2)""", select=f"""
SELECT contract_id, side, {r('plan_stop')} AS plan_stop, {r('ABS(current_price - plan_stop) / current_price')} AS stop_pct, {r('ex')} AS option_exit, {r('reference_price * 0.65::DOUBLE')} AS option_stop, {r('ex - reference_price')} AS profit_points, {r('pct')} AS profit_pct, {r('(ex - reference_price) * 100')} AS profit_per_contract,
  CASE WHEN contract IS NOT NULL AND NOT pct >= 5 AND cls IN ('tradeable research', 'defined-risk spread') THEN 'paper/watch' ELSE cls END AS strategy_action,
  CASE WHEN action = 'NO TRADE' THEN 'NO TRADE' WHEN risk_gate = 'high' THEN 'TRADEABLE' WHEN risk_gate = 'spread only' THEN 'TRADE AS A SPREAD' WHEN risk_gate = 'paper only' THEN 'PAPER ONLY' ELSE 'WATCH' END AS tradeability FROM pl3"""))
def trade_plan(spark, sf_dir):
    df = rep.add_trade_plan(plan_rows(spark, sf_dir))
    return df.select(
        "contract_id", "side", "plan_stop", "stop_pct", "option_exit", "option_stop", "profit_points", "profit_pct",
        "profit_per_contract", "strategy_action", rep.option_verdict(F.col("action"), F.col("risk_gate")).alias("tradeability"),
    )


@add("target_day_estimate", with_(CHAIN, f"""td AS (SELECT contract_id, CASE contract_id % 2 WHEN 0 THEN 'short' ELSE 'long' END AS side, (contract_id % 31 - 12)::DOUBLE AS ret, (contract_id % 101) / 100.0 AS pu, CASE WHEN contract_id % 5 <> 0 THEN (contract_id % 70) / 10.0 END AS em,
  CASE WHEN contract_id % 7 <> 0 THEN (contract_id % 60)::DOUBLE END AS rv, CASE WHEN contract_id % 3 = 0 THEN dte END AS dte FROM chain),
td2 AS (SELECT *, CASE WHEN side = 'short' AND ret > 0 THEN -ret ELSE ret END AS aret, CASE WHEN side = 'short' THEN (1 - pu) * 100 ELSE pu * 100 END AS prob, CASE WHEN em > 0 THEN GREATEST(0.3, em / SQRT(5::DOUBLE)) WHEN COALESCE(rv, 0) <> 0 THEN GREATEST(0.3, rv / SQRT(252::DOUBLE)) END AS dm FROM td)""", select=f"""
SELECT contract_id, {r('aret')} AS aligned_return, {r('prob')} AS prob_side, {r('dm')} AS daily_move_pct, (CASE WHEN dte >= 1 THEN LEAST(dte, 45) WHEN dm > 0 AND round_even(ABS(aret) / dm, 0) >= 1 THEN LEAST(20, round_even(ABS(aret) / dm, 0)) ELSE 3 END)::BIGINT AS target_days FROM td2"""))
def target_day_estimate(spark, sf_dir):
    c = F.col("contract_id")
    df = data.chain(spark, sf_dir).select(
        "contract_id",
        F.when(c % 2 == 0, "short").otherwise("long").alias("side"),
        (c % 31 - 12).cast("double").alias("ret"),
        ((c % 101) / 100.0).alias("prob_up"),
        F.when(c % 5 != 0, (c % 70) / 10.0).alias("em"),
        F.when(c % 7 != 0, (c % 60).cast("double")).alias("rv"),
        F.when(c % 3 == 0, F.col("dte")).alias("dte"),
    )
    ret, prob = rep.side_forecast(F.col("side"), F.col("ret"), F.col("prob_up"))
    daily = rep.daily_move_pct(F.col("em"), F.col("rv"))
    return df.select(
        "contract_id",
        ret.alias("aligned_return"),
        prob.alias("prob_side"),
        daily.alias("daily_move_pct"),
        rep.target_days(F.col("dte"), ret, daily, F.lit(3)).alias("target_days"),
    )


OCC = """occ AS (SELECT contract_id, CASE WHEN contract_id % 10 = 0 THEN 'BAD' || contract_id ELSE UPPER(REPLACE(ticker, 'Brand#', 'br')) || strftime(DATE '2024-01-31' + dte::INT, '%y%m%d') || "right" || LPAD(CAST(CAST(strike * 1000 AS BIGINT) AS VARCHAR), 8, '0') END AS symbol, dte, "right", strike FROM chain)"""


@add("contract_fields", with_(CHAIN, OCC, select=f"""
SELECT contract_id, CASE WHEN LENGTH(symbol) >= 15 THEN CAST(DATE '2024-01-31' + dte::INT AS VARCHAR) END AS option_expiration, CASE WHEN LENGTH(symbol) >= 15 THEN CASE "right" WHEN 'C' THEN 'call' ELSE 'put' END END AS option_type,
  CASE WHEN LENGTH(symbol) >= 15 THEN {r('strike')} END AS option_strike, CASE WHEN LENGTH(symbol) >= 15 THEN CASE "right" WHEN 'C' THEN 'call' ELSE 'put' END ELSE 'call' END AS right_word FROM occ"""))
def contract_fields(spark, sf_dir):
    c = F.col("contract_id")
    day = F.date_format(F.date_add(F.lit("2024-01-31").cast("date"), F.col("dte").cast("int")), "yyMMdd")
    symbol = F.concat(
        F.replace(F.col("ticker"), F.lit("Brand#"), F.lit("br")), day, F.col("right"),
        F.lpad((F.col("strike") * 1000).cast("long").cast("string"), 8, "0"),
    )
    df = data.chain(spark, sf_dir).withColumn("symbol", F.when(c % 10 == 0, F.concat(F.lit("BAD"), c.cast("string"))).otherwise(symbol))
    parts = opt.parse_occ(F.col("symbol"))
    return df.select(
        "contract_id", *[v.alias(n) for n, v in parts.items()], opt.contract_right(F.col("symbol"), F.lit("Call")).alias("right_word")
    )


@add("expiry_selection", with_(CHAIN, METRICS, """es AS (SELECT ticker, dte + (LENGTH(ticker) % 2) * 50 AS dte, MAX(CASE WHEN dte + (LENGTH(ticker) % 2) * 50 BETWEEN 5 AND 60 THEN 1 ELSE 0 END) OVER (PARTITION BY ticker) AS anyin FROM metrics)""", select="""
SELECT * FROM (SELECT ticker, dte::BIGINT AS dte, DENSE_RANK() OVER (PARTITION BY ticker ORDER BY dte) AS rank FROM es WHERE dte >= 5 AND (dte <= 60 OR anyin = 0)) WHERE rank <= 5"""))
def expiry_selection(spark, sf_dir):
    """Near expiries of names, half of them with long-dated chains only."""
    far = (F.length("ticker") % 2) * 50
    expiries = contracts(spark, sf_dir).select("ticker", (F.col("dte") + far).alias("dte")).distinct()
    return opt.select_expiries(expiries).select("ticker", "dte", "rank")


@add("contract_quote", with_(CHAIN, select=f"""
SELECT o.o_orderkey AS trade_id, c.contract_id, CASE WHEN c.bid > 0 AND c.ask > 0 THEN {r('(c.bid + c.ask) / 2', 4)} WHEN c.last > 0 THEN {r('c.last', 4)} END AS mark FROM orders o LEFT JOIN chain c ON c.contract_id = o.o_orderkey % 2500"""))
def contract_quote(spark, sf_dir):
    """Mark of the contract each stored trade refers to."""
    trades = data.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trade_id"), (F.col("o_orderkey") % 2500).alias("contract_id"))
    df = trades.join(data.chain(spark, sf_dir), "contract_id", "left")
    mark = opt.option_mark(F.col("bid"), F.col("ask"), F.col("last"))
    return df.select("trade_id", F.when(F.col("ticker").isNotNull(), F.col("contract_id")).alias("contract_id"), mark.alias("mark"))


SOURCES = {"broker": 0, "delayed": 1}


@add("chain_fallback", with_(CHAIN, """cs AS (SELECT ticker, contract_id, CASE WHEN LENGTH(ticker) = 7 AND contract_id % 3 = 0 THEN 0 ELSE 1 END AS s FROM chain),
cw AS (SELECT ticker, MIN(s) AS s FROM cs GROUP BY 1)""", select="SELECT c.ticker, ['broker', 'delayed'][c.s + 1] AS source, COUNT(*) AS contracts FROM cs c JOIN cw w ON w.ticker = c.ticker AND w.s = c.s GROUP BY 1, 2"))
def chain_fallback(spark, sf_dir):
    """Contracts per ticker from the first source that has a chain."""
    broker = (F.length("ticker") == 7) & (F.col("contract") % 3 == 0)
    held = contracts(spark, sf_dir).withColumn("source", F.when(broker, "broker").otherwise("delayed"))
    kept = opt.chain_with_fallback(held, SOURCES)
    return kept.groupBy("ticker", "source").agg(F.count(F.lit(1)).alias("contracts"))


@add("expected_move", with_(BARS, CHAIN, METRICS, DELTA, LOGRET, f"hm AS (SELECT ticker, STDDEV_SAMP(lr) * SQRT(5::DOUBLE) * 100 AS mv FROM lr GROUP BY 1)", select=f"""
SELECT h.ticker, COALESCE(m.em, {rs('h.mv', 1)}) AS move_pct, CASE WHEN m.em IS NOT NULL THEN 'straddle' ELSE 'history' END AS basis FROM hm h
LEFT JOIN (SELECT *, CASE WHEN LENGTH(ticker) = 7 THEN expected_move_pct END AS em FROM metrics QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY dte) = 1) m ON m.ticker = h.ticker"""))
def expected_move(spark, sf_dir):
    """Straddle move of the one-digit names' nearest expiry, historical move otherwise."""
    history = historical_move(data.numbered_bars(spark, sf_dir), 5)
    near = opt.select_expiries(metrics(spark, sf_dir), n=1)
    straddle = F.when(F.length("ticker") == 7, F.col("expected_move_pct")).alias("expected_move_pct")
    df = history.join(near.select("ticker", straddle), "ticker", "left")
    move, basis = opt.expected_move(F.col("expected_move_pct"), F.col("move_pct"))
    return df.select("ticker", move.alias("move_pct"), basis.alias("basis"))
