"""Outcome, calibration and replay queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import datasets as data
from ..operators import outcomes, replay
from ..sources import config
from .base import Catalogue
from .tables_sql import BARS, BENCH, PREDICTIONS, clip, r, rs, with_
from .timeseries import ATR, DELTA, JOINT, LOGRET, PATTERNS, PV, SIGNED, TECH_PARTS, VOTES, STATS, W, band

CATALOGUE = Catalogue()
add = CATALOGUE.add

BUCKET = """CASE WHEN confidence_score < 50 THEN '00-49' WHEN confidence_score < 65 THEN '50-64' WHEN confidence_score < 75 THEN '65-74' WHEN confidence_score < 85 THEN '75-84' ELSE '85-100' END"""
OUTCOME = f"""oc AS (SELECT *, CASE horizon WHEN '1D' THEN 1 WHEN '5D' THEN 5 ELSE 20 END AS h,
  CASE WHEN direction IN ('bullish', 'neutral_to_bullish') THEN 'long' WHEN direction IN ('bearish', 'neutral_to_bearish') THEN 'short' ELSE 'neutral' END AS side,
  {BUCKET} AS bucket FROM predictions),
oc1 AS (SELECT o.*, b.date AS exit_date, b.close AS exit_price FROM (SELECT *, CAST(as_of + h AS DATE) AS target FROM oc) o ASOF LEFT JOIN bars b ON o.ticker = b.ticker AND b.date >= o.target),
oc2 AS (SELECT *, CASE WHEN side = 'neutral' THEN 'not_actionable' WHEN exit_date IS NULL THEN 'pending' ELSE 'scored' END AS status FROM oc1),
oc3 AS (SELECT *, CASE WHEN status = 'scored' THEN (exit_price / entry_price - 1) * 100 END AS ret FROM oc2),
oc4 AS (SELECT *, CASE WHEN side = 'long' THEN ret ELSE -ret END AS sret FROM oc3),
outcomes AS (SELECT prediction_id, ticker, side, status, h AS horizon_days, bucket, confidence_score, CASE WHEN status = 'scored' THEN exit_date END AS exit_date,
  CASE WHEN status = 'scored' THEN exit_price END AS exit_price, {rs('ret', 2)} AS return_pct, {rs('sret', 2)} AS side_return_pct, sret > 0 AS hit FROM oc4)"""
OUT = (BARS, PREDICTIONS, OUTCOME)


def measured(spark, sf_dir):
    return outcomes.forward_outcomes(data.predictions(spark, sf_dir), data.numbered_bars(spark, sf_dir))


@add("forward_outcome", with_(*OUT, select=f"""
SELECT prediction_id, ticker, side, status, horizon_days::BIGINT AS horizon_days, bucket AS confidence_bucket, CAST(exit_date AS VARCHAR) AS exit_date, {r('exit_price')} AS exit_price, return_pct, side_return_pct, hit FROM outcomes"""))
def forward_outcome(spark, sf_dir):
    return measured(spark, sf_dir).select(
        "prediction_id", "ticker", "side", "status", "horizon_days", "confidence_bucket", "exit_date", "exit_price",
        "return_pct", "side_return_pct", "hit",
    )


CARD = f"""COUNT(*) AS rows, SUM(CASE WHEN status = 'scored' THEN 1 ELSE 0 END)::BIGINT AS scored, SUM(CASE WHEN status = 'pending' THEN 1 ELSE 0 END)::BIGINT AS pending,
  SUM(CASE WHEN status = 'not_actionable' THEN 1 ELSE 0 END)::BIGINT AS not_actionable, {rs('AVG(CASE WHEN hit THEN 1.0 WHEN NOT hit THEN 0.0 END) * 100', 1)} AS hit_rate_pct, {rs('AVG(side_return_pct)', 2)} AS avg_side_return_pct"""


@add("reliability_scorecard", with_(*OUT, select=f"""
SELECT 'total' AS level, 'all' AS member, {CARD} FROM outcomes
UNION ALL SELECT 'side', side, {CARD} FROM outcomes WHERE status = 'scored' GROUP BY side
UNION ALL SELECT 'bucket', bucket, {CARD} FROM outcomes WHERE status = 'scored' GROUP BY bucket"""))
def reliability_scorecard(spark, sf_dir):
    return outcomes.scorecard(measured(spark, sf_dir))


PROFILE = f"""prof AS (SELECT b.bucket, COALESCE(c, 0) AS count, avg_confidence, hit_rate_pct, avg_side_return_pct, COALESCE(c, 0) >= 20 AS usable FROM
  (VALUES ('00-49'), ('50-64'), ('65-74'), ('75-84'), ('85-100')) b(bucket) LEFT JOIN (
  SELECT bucket, COUNT(*) AS c, {rs('AVG(confidence_score)', 1)} AS avg_confidence, {rs('AVG(CASE WHEN hit THEN 1.0 WHEN NOT hit THEN 0.0 END) * 100', 1)} AS hit_rate_pct, {rs('AVG(side_return_pct)', 2)} AS avg_side_return_pct
  FROM outcomes WHERE status = 'scored' GROUP BY bucket) x ON x.bucket = b.bucket)"""


@add("calibration_profile", with_(*OUT, PROFILE, select="SELECT bucket, count, avg_confidence, hit_rate_pct, avg_side_return_pct, usable FROM prof"))
def calibration_profile(spark, sf_dir):
    return outcomes.calibration_profile(measured(spark, sf_dir))


SHIFT = clip("(COALESCE(NULLIF(hit_rate_pct, 0), confidence_score) - COALESCE(NULLIF(avg_confidence, 0), confidence_score)) * LEAST(1, count / 60::DOUBLE)", -15, 8)
CAL_SQL = f"""cal AS (SELECT *, prediction_id % 101 AS opp, CASE prediction_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'extreme' END AS lvl, prediction_id % 17 = 0 AS blk,
   CASE WHEN usable THEN {rs(clip('confidence_score + ' + SHIFT), 1)} ELSE confidence_score END AS conf2, {SHIFT} AS shift
   FROM (SELECT *, {BUCKET} AS bkt FROM predictions) p JOIN prof f ON f.bucket = p.bkt)"""


@add("calibrated_confidence", with_(*OUT, PROFILE, CAL_SQL, select=f"""
SELECT prediction_id, {rs('confidence_score', 1)} AS raw_confidence_score, {r('conf2')} AS confidence_score, usable AS calibration_available, CASE WHEN usable THEN {rs('shift', 1)} ELSE 0 END AS calibration_adjustment, count AS sample_count,
  CASE WHEN blk THEN 'P3' WHEN (opp >= 70 OR opp <= 30) AND conf2 >= 65 AND lvl IN ('low', 'medium') THEN 'P1' WHEN opp >= 60 OR opp <= 40 THEN 'P2' ELSE 'P3' END AS severity FROM cal"""))
def calibrated_confidence(spark, sf_dir):
    key = F.col("prediction_id")
    levels = F.array(*[F.lit(x) for x in ("low", "medium", "high", "extreme")])
    calls = data.predictions(spark, sf_dir).select(
        "prediction_id",
        "confidence_score",
        (key % 101).cast("double").alias("opportunity_score"),
        F.element_at(levels, (key % 4 + 1).cast("int")).alias("risk_level"),
        (key % 17 == 0).alias("block_trade"),
    )
    out = outcomes.apply_calibration(calls, outcomes.calibration_profile(measured(spark, sf_dir)))
    return out.select(
        "prediction_id", "raw_confidence_score", "confidence_score", "calibration_available", "calibration_adjustment",
        "sample_count", "severity",
    )


@add("label_table", with_(*OUT, select=f"""
SELECT CAST(p.prediction_id AS VARCHAR) AS key, p.ticker, {r('p.confidence_score')} AS confidence_score, o.status, o.horizon_days::BIGINT AS horizon_days, o.hit AS label_hit, o.side_return_pct AS label_side_return_pct, o.return_pct AS label_return_pct
FROM predictions p JOIN outcomes o ON p.prediction_id = o.prediction_id WHERE o.status <> 'not_actionable'"""))
def label_table(spark, sf_dir):
    run = F.lit("run").alias("run_id")
    features = data.predictions(spark, sf_dir).select("prediction_id", run, "ticker", "confidence_score")
    out = outcomes.label_table(features, measured(spark, sf_dir).withColumn("run_id", F.lit("run")))
    return out.where(F.col("status") != "not_actionable").select(
        "key", "ticker", "confidence_score", "status", "horizon_days", "label_hit", "label_side_return_pct",
        "label_return_pct",
    )


OPT_SNAP = """snaps AS (SELECT 'Brand#' || CAST(1 + user_id % 25 AS VARCHAR) AS ticker, 'c' || CAST(user_id AS VARCHAR) AS reference_contract, ts AS as_of,
  CASE WHEN event_id % 5 = 0 THEN 'NO TRADE' WHEN event_id % 2 = 0 THEN 'BUY CALL' ELSE 'BUY PUT' END AS action,
  CASE WHEN event_id % 23 = 0 THEN NULL ELSE ROUND(1 + value / 10, 4) END AS price, 100 + value AS underlying_price,
  CASE event_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'watch' END AS risk_gate, event_id FROM events)"""
OPT_OUT = f"""po AS (SELECT a.event_id, a.ticker, a.risk_gate, a.action, a.price, ANY_VALUE(a.as_of) AS as_of,
   MIN(CASE WHEN CAST(b.as_of AS DATE) >= CAST(a.as_of AS DATE) + 3 THEN {{'t': b.as_of, 'p': b.price, 'u': b.underlying_price}} END) AS ex,
   MAX(CASE WHEN CAST(b.as_of AS DATE) < CAST(a.as_of AS DATE) + 3 THEN b.price END) AS hi, MIN(CASE WHEN CAST(b.as_of AS DATE) < CAST(a.as_of AS DATE) + 3 THEN b.price END) AS lo
  FROM snaps a LEFT JOIN snaps b ON a.reference_contract = b.reference_contract AND b.as_of > a.as_of AND b.price IS NOT NULL GROUP BY 1, 2, 3, 4, 5),
po2 AS (SELECT *, CASE WHEN COALESCE(price, 0) <= 0 OR action NOT LIKE '%BUY%' THEN 'not_actionable' WHEN ex IS NULL THEN 'pending' ELSE 'scored' END AS status FROM po),
po3 AS (SELECT *, CASE WHEN status = 'scored' THEN (ex.p / price - 1) * 100 END AS ret FROM po2)"""


def option_snapshots(spark, sf_dir):
    e, v = F.col("event_id"), F.col("value")
    gates = F.when(e % 4 == 0, "high").when(e % 4 == 1, "medium").when(e % 4 == 2, "watch")
    return data.table(spark, sf_dir, "events").select(
        F.concat(F.lit("Brand#"), (1 + F.col("user_id") % 25).cast("string")).alias("ticker"),
        F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("reference_contract"),
        F.col("ts").alias("as_of"),
        F.when(e % 5 == 0, "NO TRADE").when(e % 2 == 0, "BUY CALL").otherwise("BUY PUT").alias("action"),
        F.when(e % 23 != 0, F.round(1 + v / 10, 4)).alias("reference_option_price"),
        (100 + v).alias("underlying_price"),
        gates.alias("risk_gate"),
        "event_id",
    )


@add("option_premium_outcome", with_(OPT_SNAP, OPT_OUT, select=f"""
SELECT event_id, status, {r("CASE WHEN status = 'scored' THEN ex.p END")} AS exit_option_price, CASE WHEN status = 'scored' THEN strftime(ex.t, '%Y-%m-%d %H:%M:%S') END AS exit_as_of, {rs('ret', 2)} AS premium_return_pct, ret > 0 AS hit,
  {rs("CASE WHEN status = 'scored' THEN (GREATEST(ex.p, hi) / price - 1) * 100 END", 2)} AS max_mark_pct, {rs("CASE WHEN status = 'scored' THEN (LEAST(ex.p, lo) / price - 1) * 100 END", 2)} AS min_mark_pct FROM po3"""))
def option_premium_outcome(spark, sf_dir):
    return outcomes.option_outcomes(option_snapshots(spark, sf_dir), 3).select(
        "event_id", "status", "exit_option_price", "exit_as_of", "premium_return_pct", "hit", "max_mark_pct", "min_mark_pct"
    )


OCARD = CARD.replace("side_return_pct", "premium_return_pct")


@add("option_scorecard", with_(OPT_SNAP, OPT_OUT, f"po4 AS (SELECT *, {rs('ret', 2)} AS premium_return_pct, ret > 0 AS hit FROM po3)", select=f"""
SELECT 'all' AS gate, {OCARD} FROM po4 UNION ALL SELECT COALESCE(risk_gate, 'unknown'), {OCARD} FROM po4 WHERE status = 'scored' GROUP BY 1"""))
def option_scorecard(spark, sf_dir):
    return outcomes.option_scorecard(outcomes.option_outcomes(option_snapshots(spark, sf_dir), 3))


BT = f"""bt AS (SELECT ticker, pos, n, close, LAG(technical_score) OVER {W} AS sc, LEAD(close, 5) OVER {W} / close - 1 AS fwd FROM tech),
bt2 AS (SELECT *, CASE WHEN sc >= 58 THEN 1 WHEN sc <= 42 THEN -1 ELSE 0 END AS sg FROM bt WHERE n >= 215 AND pos > 200 AND pos <= n - 5),
bt3 AS (SELECT *, CASE WHEN sg <> 0 THEN sg * fwd - 0.0005::DOUBLE END AS tr, CASE WHEN sg <> 0 THEN CASE WHEN (sg > 0 AND fwd > 0) OR (sg < 0 AND fwd < 0) THEN 1.0 ELSE 0.0 END END AS ok FROM bt2)"""


@add("walk_forward_backtest", with_(*TECH_PARTS, BT, select=f"""
SELECT ticker, COUNT(tr) AS trades, {rs('AVG(ok)', 3)} AS directional_accuracy, {rs('AVG(CASE WHEN sg <> 0 THEN fwd END) * 100', 3)} AS avg_forward_return_pct,
  {rs('(EXP(SUM(LN(1 + tr))) - 1) * 100', 2)} AS strategy_cum_return_pct, CASE WHEN COUNT(tr) > 0 THEN {rs('COALESCE(AVG(tr) / NULLIF(STDDEV_POP(tr), 0) * SQRT(252 / 5::DOUBLE), 0)', 2)} END AS approx_sharpe FROM bt3 GROUP BY ticker"""))
def walk_forward_backtest(spark, sf_dir):
    return replay.backtest(data.numbered_bars(spark, sf_dir), 5)


_score = {h: rs('COALESCE(' + clip(f"0.5::DOUBLE * vote_score + 0.5::DOUBLE * (50 + ({band(h)['prob_up']} - 0.5::DOUBLE) * 60)") + ', vote_score)', 1) for h in (1, 5, 20)}
PV2 = PV
REPLAY = f"""rp AS (SELECT t.ticker, t.date, t.pos, t.n, t.close, GREATEST(0, LEAST(100, t.technical_score + p.bias * 6)) AS tech, v.pv_score AS pv,
   {', '.join(f'{_score[h]} AS fc{h}' for h in (1, 5, 20))}, COALESCE({clip('50 + ' + clip('x.rs * 1.2::DOUBLE', -20, 20))}, 50) AS xm
   FROM tech t JOIN pt3 p ON p.ticker = t.ticker AND p.pos = t.pos JOIN pvs v ON v.ticker = t.ticker AND v.pos = t.pos JOIN st s ON s.ticker = t.ticker AND s.pos = t.pos
   JOIN rstr x ON x.ticker = t.ticker AND x.date = t.date),
rp2 AS (SELECT *, LAG(tech) OVER {W} AS tech1, LAG(pv) OVER {W} AS pv1, LAG(xm) OVER {W} AS xm1, {', '.join(f'LAG(fc{h}) OVER {W} AS f{h}, LEAD(close, {h}) OVER {W} / close - 1 AS r{h}' for h in (1, 5, 20))} FROM rp),
replayed AS ({' UNION ALL '.join(f"SELECT ticker, date, {h} AS horizon_days, '{c}' AS component, {e} AS score, r{h} AS fwd FROM rp2 WHERE pos > 200 AND (pos - 201) % 5 = 0 AND n >= {210 + h} AND pos <= n - {h}" for h in (1, 5, 20) for c, e in (('technical_structure', 'tech1'), ('price_volume_momentum', 'pv1'), ('ensemble_forecast', f'f{h}'), ('cross_market_correlation', 'xm1')))})"""
RP_PARTS = (*TECH_PARTS, PATTERNS, SIGNED, PV2, LOGRET, VOTES, STATS, BENCH, JOINT, REPLAY)


def _replayed(spark, sf_dir):
    return replay.replay(data.numbered_bars(spark, sf_dir), data.numbered_benchmark(spark, sf_dir), [1, 5, 20], step=5)


@add("component_replay", with_(*RP_PARTS, select=f"""
SELECT ticker, CAST(date AS VARCHAR) AS date, horizon_days::BIGINT AS horizon_days, component, {r('score')} AS score, {r('fwd')} AS fwd FROM replayed"""))
def component_replay(spark, sf_dir):
    return _replayed(spark, sf_dir)


METRICS = f"""met AS (SELECT horizon_days, component, COUNT(*) AS samples, SUM(CASE WHEN score >= 58 OR score <= 42 THEN 1 ELSE 0 END)::BIGINT AS directional_bars,
  AVG(CASE WHEN score >= 58 THEN CASE WHEN fwd > 0 THEN 1.0 ELSE 0.0 END WHEN score <= 42 THEN CASE WHEN fwd < 0 THEN 1.0 ELSE 0.0 END END) AS acc,
  STDDEV_POP(score) AS sds, STDDEV_POP(fwd) AS sdf, CORR(score - 50, fwd) AS ic FROM replayed GROUP BY 1, 2),
metrics AS (SELECT horizon_days, component, samples, directional_bars, {rs('acc', 4)} AS accuracy, CASE WHEN samples >= 10 AND sds > 1e-9 AND sdf > 1e-9 THEN {rs('ic', 4)} END AS ic,
  {rs('CASE WHEN directional_bars >= 25 THEN COALESCE(GREATEST(0, acc - 0.5), 0) ELSE 0 END', 5)} AS skill FROM met)"""


@add("component_skill", with_(*RP_PARTS, METRICS, select="SELECT horizon_days::BIGINT AS horizon_days, component, samples, directional_bars, accuracy, ic, skill FROM metrics"))
def component_skill(spark, sf_dir):
    return replay.component_metrics(_replayed(spark, sf_dir))


_rows = ", ".join(f"('{p}', {config.PROFILE_HORIZON_DAYS[p]}, '{k}', {w})" for p, ws in config.PROFILE_WEIGHTS.items() for k, w in zip(config.WEIGHT_KEYS, ws))
FIT = f"""prior AS (SELECT profile, h, component, w::DOUBLE / SUM(w) OVER (PARTITION BY profile) AS weight, component IN ('technical_structure', 'price_volume_momentum', 'ensemble_forecast', 'cross_market_correlation') AS mine FROM (VALUES {_rows}) t(profile, h, component, w)),
f1 AS (SELECT p.*, m.skill, COALESCE(m.directional_bars, 0) AS db, SUM(CASE WHEN mine THEN weight END) OVER (PARTITION BY profile) AS mass, SUM(CASE WHEN mine THEN COALESCE(skill, 0) END) OVER (PARTITION BY profile) AS skills
   FROM prior p LEFT JOIN metrics m ON m.horizon_days = p.h AND m.component = p.component),
f2 AS (SELECT *, weight / mass AS pr, CASE WHEN skills > 0 THEN COALESCE(skill, 0) / skills ELSE weight / mass END AS ms FROM f1),
f3 AS (SELECT *, CASE WHEN mine THEN 0.4::DOUBLE * pr + 0.6::DOUBLE * CASE WHEN db >= 25 THEN ms ELSE pr END END AS rel FROM f2),
f4 AS (SELECT *, CASE WHEN mine THEN mass * rel / SUM(rel) OVER (PARTITION BY profile) ELSE weight END AS fitted FROM f3)"""


@add("fitted_weights", with_(*RP_PARTS, METRICS, FIT, select=f"""
SELECT profile, component, {rs('100 * fitted / tot', 3)} AS weight FROM (SELECT *, SUM(fitted) OVER (PARTITION BY profile) AS tot FROM f4)"""))
def fitted_weights(spark, sf_dir):
    """Weights of every profile, fitted at its own horizon."""
    own = config.profile_weights(spark)
    prior = config.resolve_weights(own.select("profile"), config.default_weights(spark), own)
    return replay.tune(data.numbered_bars(spark, sf_dir), data.numbered_benchmark(spark, sf_dir), prior)
