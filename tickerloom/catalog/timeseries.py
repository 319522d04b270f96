"""Indicator and price-signal queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import datasets as data
from ..operators import indicators as ind
from ..operators import quantiles, series, signals
from .base import Catalogue
from .tables_sql import BARS, BENCH, INDEX_BARS, clip, norm_cdf, r, rs, with_

CATALOGUE = Catalogue()
add = CATALOGUE.add

W = "(PARTITION BY ticker ORDER BY date)"
DAY = "CAST(date AS VARCHAR) AS date"


def rows(n: int) -> str:
    return f"(PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _frame(spark, sf_dir, lookback):
    return series.blocks(data.numbered_bars(spark, sf_dir), lookback)


def _macd_frame(spark, sf_dir):
    return series.blocks(data.numbered_bars(spark, sf_dir), ind.MACD_LOOKBACK, size=ind.MACD_BLOCK)


def _latest_frame(spark, sf_dir, rows_needed):
    return series.tail(data.numbered_bars(spark, sf_dir), rows_needed)


def _avg(col: str, n: int, guard: int | None = None) -> str:
    return f"CASE WHEN pos >= {guard or n} THEN AVG({col}) OVER {rows(n)} END"


@add("moving_averages", with_(BARS, select=f"""
SELECT ticker, {DAY}, {r(_avg('close', 20), 8)} AS sma20, {r(_avg('close', 50), 8)} AS sma50, {r(_avg('close', 200), 8)} AS sma200 FROM bars"""), digits=8)
def moving_averages(spark, sf_dir):
    df = _frame(spark, sf_dir, 200)
    df = ind.add_sma(df, 20, 50, 200)
    return series.own_rows(df).select("ticker", "date", "sma20", "sma50", "sma200")


EMA = """ema AS (
  SELECT ticker, pos, close AS e12, close AS e26, 0::DOUBLE AS macd, 0::DOUBLE AS sig FROM bars WHERE pos = 1
  UNION ALL
  SELECT ticker, pos, e12, e26, e12 - e26, 0.2::DOUBLE * (e12 - e26) + 0.8::DOUBLE * sig FROM (
    SELECT b.ticker, b.pos, (2::DOUBLE/13) * b.close + (1 - 2::DOUBLE/13) * e.e12 AS e12,
           (2::DOUBLE/27) * b.close + (1 - 2::DOUBLE/27) * e.e26 AS e26, e.sig
    FROM ema e JOIN bars b ON b.ticker = e.ticker AND b.pos = e.pos + 1))"""
MBARS = BARS.replace("bars AS (\n  SELECT ticker, date, open", "bars AS MATERIALIZED (\n  SELECT ticker, date, open")


@add("macd_ema", with_(MBARS, EMA, select=f"""
SELECT b.ticker, CAST(b.date AS VARCHAR) AS date, {r('e.e12')} AS ema12, {r('e.e26')} AS ema26, {r('e.macd')} AS macd,
       {r('e.sig')} AS macd_signal, {r('e.macd - e.sig')} AS macd_hist
FROM bars b JOIN ema e ON b.ticker = e.ticker AND b.pos = e.pos"""))
def macd_ema(spark, sf_dir):
    df = _macd_frame(spark, sf_dir)
    df = series.add_emas(df, "close", {"ema12": 12, "ema26": 26})
    df = series.own_rows(ind.add_macd(df))
    return df.select("ticker", "date", "ema12", "ema26", "macd", "macd_signal", "macd_hist")


DELTA = f"""delta AS (SELECT *, LAG(close) OVER {W} AS pc FROM bars)"""
RSI = f"""rsi AS (SELECT *, COALESCE(100 - 100 / (1 + gain / NULLIF(loss, 0)), 50) AS rsi FROM (
  SELECT *, {_avg('GREATEST(close - pc, 0)', 14, 15)} AS gain, {_avg('GREATEST(pc - close, 0)', 14, 15)} AS loss FROM delta))"""


@add("rsi_14", with_(BARS, DELTA, RSI, select=f"SELECT ticker, {DAY}, {r('rsi')} AS rsi FROM rsi"))
def rsi_14(spark, sf_dir):
    return series.own_rows(ind.add_rsi(_frame(spark, sf_dir, 15))).select("ticker", "date", "rsi")


@add("bollinger_bands", with_(BARS, select=f"""
SELECT ticker, {DAY}, {r('m')} AS bb_mid, {r('m + 2 * s')} AS bb_upper, {r('m - 2 * s')} AS bb_lower FROM (
  SELECT ticker, date, {_avg('close', 20)} AS m, CASE WHEN pos >= 20 THEN STDDEV_SAMP(close) OVER {rows(20)} END AS s FROM bars)"""))
def bollinger_bands(spark, sf_dir):
    df = series.own_rows(ind.add_bollinger(_frame(spark, sf_dir, 20)))
    return df.select("ticker", "date", "bb_mid", "bb_upper", "bb_lower")


TR = """tr AS (SELECT *, GREATEST(high - low, ABS(high - pc), ABS(low - pc)) AS tr FROM delta)"""
ATR = f"""atr AS (SELECT *, {_avg('tr', 14)} AS atr FROM tr)"""


@add("true_range_atr", with_(BARS, DELTA, TR, ATR, select=f"SELECT ticker, {DAY}, {r('tr')} AS true_range, {r('atr')} AS atr FROM atr"))
def true_range_atr(spark, sf_dir):
    return series.own_rows(ind.add_atr(_frame(spark, sf_dir, 15))).select("ticker", "date", "true_range", "atr")


ADX = f"""dm AS (SELECT *, high - LAG(high) OVER {W} AS up, LAG(low) OVER {W} - low AS down FROM atr),
dm2 AS (SELECT *, CASE WHEN up > down AND up > 0 THEN up ELSE 0 END AS plus_dm, CASE WHEN down > up AND down > 0 THEN down ELSE 0 END AS minus_dm FROM dm),
di AS (SELECT *, 100 * ({_avg('plus_dm', 14)}) / NULLIF(atr, 0) AS pdi, 100 * ({_avg('minus_dm', 14)}) / NULLIF(atr, 0) AS mdi FROM dm2),
dx AS (SELECT *, 100 * ABS(pdi - mdi) / NULLIF(pdi + mdi, 0) AS dx FROM di),
adx AS (SELECT *, COALESCE(CASE WHEN COUNT(dx) OVER {rows(14)} = 14 THEN AVG(dx) OVER {rows(14)} END, 0) AS adx FROM dx)"""


@add("adx_14", with_(BARS, DELTA, TR, ATR, ADX, select=f"SELECT ticker, {DAY}, {r('adx')} AS adx FROM adx"))
def adx_14(spark, sf_dir):
    return series.own_rows(ind.add_adx(_frame(spark, sf_dir, 42))).select("ticker", "date", "adx")


SIGNED = "signed AS (SELECT *, COALESCE(SIGN(close - pc), 0) * volume AS sv FROM delta)"


@add("on_balance_volume", with_(BARS, DELTA, SIGNED, select=f"SELECT ticker, {DAY}, {r(f'SUM(sv) OVER {W}')} AS obv FROM signed"))
def on_balance_volume(spark, sf_dir):
    return ind.on_balance_volume(data.numbered_bars(spark, sf_dir)).select("ticker", "date", "obv")


RVOL = f"COALESCE(volume / NULLIF({_avg('volume', 20)}, 0), 1)"


@add("relative_volume", with_(BARS, select=f"SELECT ticker, {DAY}, {r(RVOL)} AS relative_volume FROM bars"))
def relative_volume(spark, sf_dir):
    df = series.own_rows(ind.add_relative_volume(_frame(spark, sf_dir, 20)))
    return df.select("ticker", "date", "relative_volume")


TECH = f"""ti AS (SELECT x.*, e.macd - e.sig AS hist,
   {_avg('x.close', 20).replace('ticker', 'x.ticker').replace('ORDER BY date', 'ORDER BY x.date').replace('pos', 'x.pos')} AS s20 FROM adx x JOIN ema e ON x.ticker = e.ticker AND x.pos = e.pos),
ti2 AS (SELECT *, {_avg('close', 50)} AS s50, {_avg('close', 200)} AS s200,
   CASE WHEN pos >= 20 THEN STDDEV_SAMP(close) OVER {rows(20)} END AS sd,
   {_avg('GREATEST(close - pc, 0)', 14, 15)} AS gain, {_avg('GREATEST(pc - close, 0)', 14, 15)} AS loss FROM ti),
ti3 AS (SELECT *, COALESCE(100 - 100 / (1 + gain / NULLIF(loss, 0)), 50) AS rsi FROM ti2),
tech AS (SELECT *, GREATEST(0, LEAST(100, 50::DOUBLE
  + CASE WHEN s50 IS NULL THEN 0 WHEN close > s50 THEN 8 ELSE -8 END
  + CASE WHEN s200 IS NULL THEN 0 WHEN close > s200 THEN 7 ELSE -7 END
  + CASE WHEN s20 IS NULL OR s50 IS NULL THEN 0 WHEN s20 > s50 THEN 5 ELSE -5 END
  + CASE WHEN hist > 0 THEN 6 ELSE -6 END
  + CASE WHEN rsi > 70 THEN -6 WHEN rsi < 30 THEN 6 ELSE 0 END
  + CASE WHEN adx > 25 THEN CASE WHEN hist > 0 THEN 3 ELSE -3 END ELSE 0 END
  + CASE WHEN close > s20 + 2 * sd THEN -3 WHEN close < s20 - 2 * sd THEN 3 ELSE 0 END)) AS technical_score FROM ti3)"""
TECH_PARTS = (MBARS, EMA, DELTA, TR, ATR, ADX, TECH)


@add("technical_score_history", with_(*TECH_PARTS, select=f"SELECT ticker, {DAY}, {r('technical_score')} AS technical_score FROM tech"))
def technical_score_history(spark, sf_dir):
    df = series.own_rows(signals.add_technical_score(_macd_frame(spark, sf_dir)))
    return df.select("ticker", "date", "technical_score")


PATTERNS = f"""pt AS (SELECT *, LAG(open) OVER {W} AS po, ABS(close - open) AS body,
   CASE WHEN high - low = 0 THEN 1e-9 ELSE high - low END AS reach, LEAST(open, close) - low AS lw, high - GREATEST(open, close) AS uw FROM delta),
pt2 AS (SELECT *, pos >= 3 AND body <= 0.1::DOUBLE * reach AS doji, pos >= 3 AND lw > 2 * body AND uw < body AS hammer,
   pos >= 3 AND uw > 2 * body AND lw < body AS star,
   pos >= 3 AND close > open AND NOT pc > po AND close >= po AND open <= pc AS bull,
   pos >= 3 AND NOT close > open AND pc > po AND open >= pc AND close <= po AS bear FROM pt),
pt3 AS (SELECT *, GREATEST(-1, LEAST(1, (CASE WHEN hammer THEN 1 ELSE 0 END - CASE WHEN star THEN 1 ELSE 0 END
   + CASE WHEN bull THEN 1 ELSE 0 END - CASE WHEN bear THEN 1 ELSE 0 END) / 2::DOUBLE)) AS bias FROM pt2)"""


@add("candle_patterns", with_(BARS, DELTA, PATTERNS, select=f"""
SELECT ticker, {DAY}, CONCAT_WS('; ', CASE WHEN doji THEN 'doji' END, CASE WHEN hammer THEN 'hammer' END, CASE WHEN star THEN 'shooting_star' END,
  CASE WHEN bull THEN 'bullish_engulfing' END, CASE WHEN bear THEN 'bearish_engulfing' END) AS patterns, {r('bias')} AS pattern_bias FROM pt3"""))
def candle_patterns(spark, sf_dir):
    df = series.own_rows(ind.add_patterns(_frame(spark, sf_dir, 2)))
    return df.select("ticker", "date", "patterns", "pattern_bias")


@add("technical_leaders", with_(*TECH_PARTS, PATTERNS, select=f"""
SELECT t.ticker, CAST(t.date AS VARCHAR) AS date, {r('t.close')} AS close, {r('t.technical_score')} AS technical_score,
  {r('GREATEST(0, LEAST(100, t.technical_score + p.bias * 6))')} AS technical_structure, {r('t.rsi')} AS rsi, {r('t.adx')} AS adx, {r('t.hist')} AS macd_hist
FROM tech t JOIN pt3 p ON t.ticker = p.ticker AND t.pos = p.pos WHERE t.pos = t.n
ORDER BY technical_structure DESC, ticker LIMIT 20"""))
def technical_leaders(spark, sf_dir):
    """Top 20 tickers by technical structure on their latest bar."""
    df = _latest_frame(spark, sf_dir, ind.SCORE_LOOKBACK)
    df = series.latest(signals.add_pattern_adjusted_score(signals.add_technical_score(df)))
    df = df.select("ticker", "date", "close", "technical_score", "technical_structure", "rsi", "adx", "macd_hist")
    return df.orderBy(F.desc("technical_structure"), "ticker").limit(20)


PV = f"""pv AS (SELECT *, COALESCE(CASE WHEN pos >= 7 THEN (close / LAG(close, 5) OVER {W} - 1) * 100 END, 0) AS r5,
  COALESCE(CASE WHEN pos >= 22 THEN (close / LAG(close, 20) OVER {W} - 1) * 100 END, 0) AS r20,
  {RVOL} AS rvol, SUM(sv) OVER {W} AS obv FROM signed),
pvs AS (SELECT *, GREATEST(0, LEAST(100, 50 + GREATEST(-15, LEAST(15, r5 * 1.5::DOUBLE)) + GREATEST(-12, LEAST(12, r20 * 0.7::DOUBLE))
  + CASE WHEN rvol > 1.5 THEN 6 WHEN rvol < 0.6 THEN -3 ELSE 0 END
  + CASE WHEN pos > 20 AND obv > obv20 THEN 4 ELSE -4 END)) AS pv_score
  FROM (SELECT *, LAG(obv, 19) OVER {W} AS obv20 FROM pv))"""


@add("price_volume_score", with_(BARS, DELTA, SIGNED, PV, select=f"""
SELECT ticker, {DAY}, {r('r5')} AS ret_5, {r('r20')} AS ret_20, {r('pv_score')} AS price_volume_momentum FROM pvs"""))
def price_volume_score(spark, sf_dir):
    df = series.own_rows(signals.add_price_volume_score(_frame(spark, sf_dir, 22)))
    return df.select("ticker", "date", "ret_5", "ret_20", "price_volume_momentum")


RADAR = f"""rd AS (SELECT *, CASE WHEN pos >= 6 THEN (close / LAG(close, 5) OVER {W} - 1) * 100 END AS r5,
  CASE WHEN pos >= 21 THEN (close / LAG(close, 20) OVER {W} - 1) * 100 END AS r20,
  CASE WHEN pos >= 61 THEN (close / LAG(close, 60) OVER {W} - 1) * 100 END AS r60,
  CASE WHEN pos >= 253 THEN (close / LAG(close, 252) OVER {W} - 1) * 100 END AS r252,
  (close / MAX(close) OVER {rows(252)} - 1) * 100 AS dd,
  (close / AVG(close) OVER {rows(20)} - 1) * 100 AS a20, (close / AVG(close) OVER {rows(50)} - 1) * 100 AS a50,
  CASE WHEN pos >= 21 THEN volume / NULLIF(AVG(volume) OVER {rows(20)}, 0) END AS vr FROM bars),
rd2 AS (SELECT *, CASE WHEN r5 > 0 THEN LEAST(20, r5 / 10 * 20) ELSE 0 END + CASE WHEN r20 > 0 THEN LEAST(20, r20 / 30 * 20) ELSE 0 END
   + CASE WHEN r60 > 0 THEN LEAST(20, r60 / 80 * 20) ELSE 0 END + CASE WHEN r252 > 0 THEN LEAST(20, r252 / 250 * 20) ELSE 0 END
   + CASE WHEN vr IS NOT NULL THEN LEAST(15, GREATEST(0, vr - 1) * 10) ELSE 0 END AS b,
   LEAST(25, GREATEST(0, -dd)) + LEAST(25, GREATEST(0, a20 - 15)) + LEAST(25, GREATEST(0, a50 - 30))
   + CASE WHEN r5 < 0 THEN LEAST(20, ABS(r5) * 2) ELSE 0 END + CASE WHEN vr < 0.8 AND r20 > 20 THEN 10 ELSE 0 END AS e FROM rd)"""


@add("event_radar", with_(BARS, RADAR, select=f"""
SELECT ticker, {DAY}, {r('dd')} AS drawdown, {r('vr')} AS volume_ratio,
  CASE WHEN pos < 30 THEN NULL WHEN b >= 55 AND e < 45 THEN 'bullish_event_watch' WHEN e >= 55 THEN 'bearish_exhaustion_watch'
       WHEN b >= 40 THEN 'early_event_watch' ELSE 'no_major_event' END AS radar_verdict,
  CASE WHEN pos >= 30 THEN {r('LEAST(100, b)', 1)} END AS breakout_score, CASE WHEN pos >= 30 THEN {r('LEAST(100, e)', 1)} END AS exhaustion_score,
  CASE WHEN pos >= 30 THEN CONCAT_WS('; ', CASE WHEN r20 >= 25 THEN 'acceleration_20d' END, CASE WHEN r60 >= 60 THEN 'momentum_60d' END,
    CASE WHEN r252 >= 150 THEN 'multi_month_winner' END, CASE WHEN vr >= 1.8 THEN 'volume_expansion' END) END AS bullish_clues,
  CASE WHEN pos >= 30 THEN CONCAT_WS('; ', CASE WHEN r5 <= -8 THEN 'short_term_breakdown' END, CASE WHEN dd <= -15 THEN 'below_recent_high' END,
    CASE WHEN a20 >= 25 AND (vr IS NULL OR vr < 1.2) THEN 'stretched_without_volume' END, CASE WHEN a50 >= 45 THEN 'extended_above_ma50' END) END AS bearish_clues
FROM rd2"""))
def event_radar(spark, sf_dir):
    df = series.own_rows(signals.add_event_radar(_frame(spark, sf_dir, 252)))
    return df.select(
        "ticker", "date", "drawdown", "volume_ratio", "radar_verdict", "breakout_score", "exhaustion_score",
        "bullish_clues", "bearish_clues",
    )


LOGRET = "lr AS (SELECT *, LN(close / pc) AS lr FROM delta)"


@add("realized_volatility", with_(BARS, DELTA, LOGRET, select=f"""
SELECT ticker, {DAY}, {r(f'STDDEV_SAMP(lr) OVER {rows(20)} * SQRT(252::DOUBLE) * 100')} AS realized_vol FROM lr"""))
def realized_volatility(spark, sf_dir):
    return series.own_rows(ind.add_realized_vol(_frame(spark, sf_dir, 21))).select("ticker", "date", "realized_vol")


@add("historical_move", with_(BARS, DELTA, LOGRET, select=f"""
SELECT ticker, {r('STDDEV_SAMP(lr) * SQRT(5::DOUBLE) * 100')} AS move_pct FROM lr GROUP BY ticker"""))
def historical_move(spark, sf_dir):
    return ind.historical_move(data.numbered_bars(spark, sf_dir), 5)


@add("return_percentiles", with_(BARS, DELTA, LOGRET, select=f"""
SELECT ticker, COUNT(lr) AS rows, {r('QUANTILE_CONT(lr, 0.05)')} AS p05, {r('QUANTILE_CONT(lr, 0.5)')} AS median, {r('QUANTILE_CONT(lr, 0.95)')} AS p95 FROM lr GROUP BY ticker"""))
def return_percentiles(spark, sf_dir):
    """Exact fifth, fiftieth and ninety-fifth percentiles of each ticker's daily log returns."""
    daily = series.own_rows(ind.add_returns(_frame(spark, sf_dir, 1))).select("ticker", "log_return")
    return quantiles.exact_percentiles(daily, "ticker", "log_return", {"p05": 0.05, "median": 0.5, "p95": 0.95})


@add("price_percentiles", """
WITH p AS (SELECT l_returnflag AS flag, l_extendedprice::DOUBLE AS v FROM lineitem)
SELECT flag, COUNT(*) AS rows, ROUND(QUANTILE_CONT(v, 0.01), 4) AS p01, ROUND(QUANTILE_CONT(v, 0.25), 4) AS p25, ROUND(QUANTILE_CONT(v, 0.5), 4) AS median, ROUND(QUANTILE_CONT(v, 0.999), 4) AS p999 FROM p GROUP BY flag""", digits=4)
def price_percentiles(spark, sf_dir):
    """Exact percentiles of the prices of each return flag: a few very large groups."""
    prices = data.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice")
    return quantiles.exact_percentiles(prices, "flag", "l_extendedprice", {"p01": 0.01, "p25": 0.25, "median": 0.5, "p999": 0.999})


PRIOR = "(PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
VOTES = f"""vi AS (SELECT *, CASE WHEN pos > 20 THEN MAX(close) OVER {PRIOR} END AS hi, CASE WHEN pos > 20 THEN MIN(close) OVER {PRIOR} END AS lo,
  {_avg('close', 20, 51)} AS fast, {_avg('close', 50, 51)} AS slow, CASE WHEN pos > 63 THEN close / LAG(close, 62) OVER {W} - 1 END AS mom FROM lr),
vt AS (SELECT *, CASE WHEN hi IS NULL THEN NULL WHEN close >= hi THEN 1 WHEN close <= lo THEN -1 ELSE 0 END AS turtle,
  CASE WHEN slow IS NULL THEN NULL WHEN fast > slow THEN 1 WHEN fast < slow THEN -1 ELSE 0 END AS ma_crossover,
  CASE WHEN mom IS NULL THEN NULL WHEN mom > 0.02 THEN 1 WHEN mom < -0.02 THEN -1 ELSE 0 END AS momentum FROM vi),
vs AS (SELECT *, GREATEST(0, LEAST(100, 50 + COALESCE((COALESCE(turtle, 0) + COALESCE(ma_crossover, 0) + COALESCE(momentum, 0))::DOUBLE
  / NULLIF((turtle IS NOT NULL)::INT + (ma_crossover IS NOT NULL)::INT + (momentum IS NOT NULL)::INT, 0), 0) * 30)) AS vote_score FROM vt)"""


@add("trend_votes", with_(BARS, DELTA, LOGRET, VOTES, select=f"""
SELECT ticker, {DAY}, turtle::BIGINT AS turtle, ma_crossover::BIGINT AS ma_crossover, momentum::BIGINT AS momentum, {r('vote_score')} AS vote_score FROM vs"""))
def trend_votes(spark, sf_dir):
    df = series.own_rows(ind.add_trend_votes(_frame(spark, sf_dir, 64)))
    return df.select("ticker", "date", "turtle", "ma_crossover", "momentum", "vote_score")


STATS = f"""st AS (SELECT *, CASE WHEN pos >= 31 THEN AVG(lr) OVER {rows(252)} END AS mu, CASE WHEN pos >= 31 THEN STDDEV_POP(lr) OVER {rows(252)} END AS sg FROM vs)"""


def band(h: int) -> dict[str, str]:
    return {
        "prob_up": norm_cdf(f"(mu * {h}) / (sg * SQRT({h}::DOUBLE))"),
        "expected_return_pct": f"(EXP(mu * {h}) - 1) * 100",
        "p05_return_pct": f"(EXP(mu * {h} - 1.6448536269514722::DOUBLE * (sg * SQRT({h}::DOUBLE))) - 1) * 100",
        "p95_return_pct": f"(EXP(mu * {h} + 1.6448536269514722::DOUBLE * (sg * SQRT({h}::DOUBLE))) - 1) * 100",
    }


@add("return_band", with_(BARS, DELTA, LOGRET, VOTES, STATS, select="SELECT ticker, " + DAY + ", " + ", ".join(
    f"{r(e)} AS {c}" for c, e in band(5).items()) + " FROM st"))
def return_band(spark, sf_dir):
    df = series.own_rows(signals.add_return_stats(_frame(spark, sf_dir, signals.FORECAST_LOOKBACK)))
    return df.select("ticker", "date", *[c.alias(n) for n, c in signals.return_band(F.lit(5)).items()])


HORIZONS = {"h2": 2, "h3": 3, "h5": 5}
_fc = ", ".join(
    f"{r(e, 3 if c == 'prob_up' else 2)} AS {n}_{c}" for n, h in HORIZONS.items() for c, e in band(h).items()
) + ", " + ", ".join(
    rs('COALESCE(' + clip(f"0.5::DOUBLE * vote_score + 0.5::DOUBLE * (50 + ({band(h)['prob_up']} - 0.5::DOUBLE) * 60)") + ', vote_score)', 1) + f" AS {n}_score"
    for n, h in HORIZONS.items()
)


@add("ensemble_forecast", with_(BARS, DELTA, LOGRET, VOTES, STATS, select=f"SELECT ticker, {DAY}, pos >= 30 AS forecast_available, {_fc} FROM st WHERE pos = n"))
def ensemble_forecast(spark, sf_dir):
    """Band and blended score for 2, 3 and 5 days on the latest bar."""
    df = _latest_frame(spark, sf_dir, signals.FORECAST_LOOKBACK)
    df = series.latest(signals.add_forecasts(df, HORIZONS))
    names = [f"{n}_{c}" for n in HORIZONS for c in (*signals.return_band(F.lit(1)), "score")]
    return df.select("ticker", "date", "forecast_available", *names)


JOINT = f"""joint AS (SELECT b.ticker, b.date, b.close, m.close AS bc, ROW_NUMBER() OVER (PARTITION BY b.ticker ORDER BY b.date) AS pos,
  COUNT(*) OVER (PARTITION BY b.ticker) AS n FROM bars b JOIN bench m ON b.date = m.date),
rstr AS (SELECT *, CASE WHEN pos >= 30 THEN ((close / LAG(close, 19) OVER {W} - 1) - (bc / LAG(bc, 19) OVER {W} - 1)) * 100 END AS rs FROM joint)"""


def _joint(spark, sf_dir):
    joint = signals.join_benchmark(data.numbered_bars(spark, sf_dir), data.numbered_benchmark(spark, sf_dir))
    return series.with_positions(joint)


@add("relative_strength", with_(BARS, BENCH, JOINT, select=f"""
SELECT ticker, {DAY}, {r('rs')} AS relative_strength, {r('COALESCE(' + clip('50 + ' + clip('rs * 1.2::DOUBLE', -20, 20)) + ', 50)')} AS cross_market_correlation FROM rstr"""))
def relative_strength(spark, sf_dir):
    df = series.own_rows(signals.add_relative_strength(series.blocks(_joint(spark, sf_dir), 20)))
    return df.select("ticker", "date", "relative_strength", "cross_market_correlation")


@add("benchmark_correlation", with_(BARS, BENCH, JOINT, select=f"""
SELECT ticker, {r('CASE WHEN COUNT(*) >= 30 THEN CORR(a, b) END')} AS corr, COUNT(*) AS joint_rows FROM (
  SELECT ticker, close / LAG(close) OVER {W} - 1 AS a, bc / LAG(bc) OVER {W} - 1 AS b FROM joint) GROUP BY ticker"""))
def benchmark_correlation(spark, sf_dir):
    return signals.benchmark_correlation(_joint(spark, sf_dir))


GC = """gr AS (SELECT b.ticker, i.index_name, b.ret AS a, i.ret AS b, ROW_NUMBER() OVER (PARTITION BY b.ticker, i.index_name ORDER BY b.date DESC) AS k
  FROM (SELECT ticker, date, close / LAG(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM bars) b
  JOIN (SELECT index_name, date, n, close / LAG(close) OVER (PARTITION BY index_name ORDER BY date) - 1 AS ret FROM index_bars) i ON b.date = i.date
  WHERE b.ret IS NOT NULL AND i.ret IS NOT NULL AND i.n >= 30)"""
GCP = f"gc AS (SELECT ticker, index_name, {rs('CORR(a, b)', 2)} AS corr FROM gr WHERE k <= 60 GROUP BY 1, 2 HAVING COUNT(*) >= 30)"


@add("global_correlation", with_(BARS, INDEX_BARS, GC, GCP, select=f"""
SELECT ticker, index_name, corr, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY ABS(corr) DESC, index_name) AS strength_rank FROM gc"""))
def global_correlation(spark, sf_dir):
    pairs = signals.global_correlations(data.numbered_bars(spark, sf_dir), data.numbered_index_bars(spark, sf_dir))
    # the map keeps its order of strength, so exploding it gives the rank
    ranked = signals.correlation_map(pairs).select(
        "ticker", F.posexplode(F.map_entries("global_correlations")).alias("place", "entry")
    )
    return ranked.select(
        "ticker", "entry.key", "entry.value", (F.col("place") + 1).cast("long").alias("strength_rank")
    ).toDF("ticker", "index_name", "corr", "strength_rank")


@add("global_breadth", with_(INDEX_BARS, select=f"""
SELECT indexes, advancers, decliners, {r('share')} AS breadth, CASE WHEN share > 0.6 THEN 'risk-on' WHEN share < 0.4 THEN 'risk-off' ELSE 'mixed' END AS tone FROM (
 SELECT *, COALESCE(advancers::DOUBLE / NULLIF(advancers + decliners, 0), 0.5) AS share FROM (
  SELECT COUNT(*) AS indexes, SUM(CASE WHEN chg > 0 THEN 1 ELSE 0 END)::BIGINT AS advancers, SUM(CASE WHEN chg < 0 THEN 1 ELSE 0 END)::BIGINT AS decliners FROM (
   SELECT index_name, pos, n, close / LAG(close) OVER (PARTITION BY index_name ORDER BY date) - 1 AS chg FROM index_bars) WHERE pos = n))"""))
def global_breadth(spark, sf_dir):
    return signals.global_breadth(signals.latest_change(data.numbered_index_bars(spark, sf_dir), "index_name"))


@add("quote_snapshot", with_(BARS, DELTA, select=f"""
SELECT ticker, {DAY}, {r('close')} AS current_price, {r('COALESCE(pc, close)')} AS previous_close, {r('volume')} AS last_volume,
  {r('(close / COALESCE(pc, close) - 1) * 100')} AS day_change_pct FROM delta WHERE pos = n"""))
def quote_snapshot(spark, sf_dir):
    return signals.latest_change(data.numbered_bars(spark, sf_dir), "ticker")


DIRECTION = """CASE WHEN {s} >= 70 THEN 'bullish' WHEN {s} >= 58 THEN 'neutral_to_bullish' WHEN {s} > 42 THEN 'neutral'
  WHEN {s} > 30 THEN 'neutral_to_bearish' ELSE 'bearish' END"""


@add("target_stop_levels", with_(*TECH_PARTS, LOGRET, VOTES, STATS, f"""
tl AS (SELECT s.*, t.atr, {DIRECTION.format(s='t.technical_score')} AS direction, {r(band(5)['expected_return_pct'], 2)} AS ret, {r(band(5)['p05_return_pct'], 2)} AS p05
  FROM st s JOIN tech t ON s.ticker = t.ticker AND s.pos = t.pos WHERE s.pos = s.n),
tl2 AS (SELECT *, direction IN ('bearish', 'neutral_to_bearish') AS sh, direction IN ('bullish', 'neutral_to_bullish') AS is_long FROM tl)""", select=f"""
SELECT ticker, direction, {r('close')} AS price, {r('CASE WHEN is_long THEN close - 1.5 * atr WHEN sh THEN close + 1.5 * atr END')} AS invalidation,
  {r('close * (1 + (CASE WHEN sh AND ret > 0 THEN -ret ELSE ret END) / 100)', 4)} AS target_price,
  CASE WHEN ret IS NOT NULL THEN {r('close + (CASE WHEN sh THEN 1 ELSE -1 END) * (CASE WHEN atr > 0 THEN LEAST(GREATEST(1.5 * atr, close * 0.025::DOUBLE), close * 0.10::DOUBLE) ELSE close * LEAST(GREATEST(COALESCE(ABS(p05) / 100 * 0.75::DOUBLE, 0.045), 0.035), 0.095) END)', 4)} END AS stop_price
FROM tl2"""))
def target_stop_levels(spark, sf_dir):
    """Invalidation level, target and stop of the latest bar."""
    from ..operators.scoring import to_direction

    df = _latest_frame(spark, sf_dir, ind.SCORE_LOOKBACK)
    df = series.latest(signals.add_forecasts(signals.add_technical_score(df), {"h5": 5}))
    df = df.withColumn("direction", to_direction(F.col("technical_score")))
    direction, price, atr = F.col("direction"), F.col("close"), F.col("atr")
    target, stop = signals.target_and_stop(
        direction, price, F.col("h5_expected_return_pct"), F.col("h5_p05_return_pct"), atr
    )
    return df.select(
        "ticker",
        "direction",
        price.alias("price"),
        signals.invalidation_level(direction, price, atr).alias("invalidation"),
        target.alias("target_price"),
        stop.alias("stop_price"),
    )
