"""Walk-forward replay: backtest, component skill and weight fitting.

A score of bar i may only use the bars before it.  Every engine is a causal window,
so one pass scores all bars and `lag` gives what a loop over prefixes would see.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import rnd_stable
from ..sources.config import PROFILE_HORIZON_DAYS
from . import indicators as ind
from . import series, signals

REPLAYED = ("technical_structure", "price_volume_momentum", "ensemble_forecast", "cross_market_correlation")
MIN_HISTORY = 200
MIN_CALLS = 25
SHRINK = 0.6
BULL, BEAR = 58.0, 42.0


def _signal(score: Column) -> Column:
    return F.when(score >= BULL, 1).when(score <= BEAR, -1).otherwise(0)


def _frame(numbered: DataFrame, ahead: int) -> DataFrame:
    return series.blocks(numbered, ind.MACD_LOOKBACK + 1, ahead=ahead, size=ind.MACD_BLOCK)


def backtest(numbered: DataFrame, horizon_days: int = 5, cost_pct: float = 0.05, min_history: int = MIN_HISTORY) -> DataFrame:
    """Directional accuracy, mean return, Sharpe and compounded return per ticker."""
    df = signals.add_technical_score(_frame(numbered, horizon_days))
    w = series.ordered()
    df = df.withColumn("_signal", _signal(F.lag("technical_score").over(w))).withColumn(
        "_fwd", F.lead("close", horizon_days).over(w) / F.col("close") - 1
    )
    df = series.own_rows(df).where(
        (F.col("n") >= min_history + horizon_days + 10)
        & (F.col("pos") > min_history)
        & (F.col("pos") <= F.col("n") - horizon_days)
    )
    s, fwd = F.col("_signal"), F.col("_fwd")
    traded = F.when(s != 0, s * fwd - F.abs(s) * (cost_pct / 100))
    right = F.when(s != 0, ((s > 0) & (fwd > 0)) | ((s < 0) & (fwd < 0)))
    out = df.withColumn("_traded", traded).groupBy("ticker").agg(
        F.count("_traded").alias("trades"),
        F.avg(right.cast("double")).alias("_accuracy"),
        F.avg(F.when(s != 0, fwd)).alias("_mean_fwd"),
        F.avg("_traded").alias("_mean"),
        F.stddev_pop("_traded").alias("_sd"),
        F.sum(F.log1p("_traded")).alias("_log"),
    )
    sharpe = F.coalesce(F.try_divide(F.col("_mean"), F.col("_sd")) * math.sqrt(252 / horizon_days), F.lit(0.0))
    return out.select(
        "ticker",
        "trades",
        rnd_stable(F.col("_accuracy"), 3).alias("directional_accuracy"),
        rnd_stable(F.col("_mean_fwd") * 100, 3).alias("avg_forward_return_pct"),
        rnd_stable((F.exp("_log") - 1) * 100, 2).alias("strategy_cum_return_pct"),
        F.when(F.col("trades") > 0, rnd_stable(sharpe, 2)).alias("approx_sharpe"),
    )


def replay(
    numbered: DataFrame, benchmark: DataFrame, horizons: list[int], step: int = 5, min_history: int = MIN_HISTORY
) -> DataFrame:
    """(ticker, date, horizon_days, component, score, fwd) for every step-th bar.

    All horizons share one pass; only the forward return and the forecast differ.
    A bar without a benchmark close keeps the relative strength of the bar before.
    """
    horizons = sorted(set(horizons))
    joint = series.with_positions(signals.join_benchmark(numbered, benchmark))
    strength = series.own_rows(signals.add_relative_strength(series.blocks(joint, 20)))
    strength = strength.select("ticker", "date", F.col("cross_market_correlation").alias("_strength"))
    df = numbered.join(strength, ["ticker", "date"], "left")
    df = _frame(df, max(horizons))
    df = signals.add_pattern_adjusted_score(signals.add_technical_score(df))
    df = signals.add_price_volume_score(df)
    df = signals.add_forecasts(df, {f"h{h}": h for h in horizons})
    w = series.ordered()
    kept = F.last("_strength", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("cross_market_correlation", F.coalesce(kept, F.lit(50.0)))
    shared = [c for c in REPLAYED if c != "ensemble_forecast"]
    for c in shared:
        df = df.withColumn(f"_s_{c}", F.lag(c).over(w))
    for h in horizons:
        df = df.withColumn(f"_s_h{h}", F.lag(f"h{h}_score").over(w)).withColumn(
            f"_f{h}", F.lead("close", h).over(w) / F.col("close") - 1
        )
    df = series.own_rows(df).where((F.col("pos") > min_history) & ((F.col("pos") - 1 - min_history) % max(1, step) == 0))
    rows = []
    for h in horizons:
        fits = (F.col("n") >= min_history + h + 10) & (F.col("pos") <= F.col("n") - h)
        for c in REPLAYED:
            score = F.col(f"_s_h{h}") if c == "ensemble_forecast" else F.col(f"_s_{c}")
            row = F.struct(
                F.lit(h).alias("horizon_days"), F.lit(c).alias("component"), score.alias("score"), F.col(f"_f{h}").alias("fwd")
            )
            rows.append(F.when(fits, row))
    return df.select("ticker", "date", F.explode(F.array_compact(F.array(*rows))).alias("r")).select("ticker", "date", "r.*")


def component_metrics(replayed: DataFrame) -> DataFrame:
    """Accuracy, information coefficient and skill per horizon and component."""
    s, fwd = _signal(F.col("score")), F.col("fwd")
    right = F.when(s != 0, ((s > 0) & (fwd > 0)) | ((s < 0) & (fwd < 0)))
    out = replayed.groupBy("horizon_days", "component").agg(
        F.count(F.lit(1)).alias("samples"),
        F.sum((s != 0).cast("long")).alias("directional_bars"),
        F.avg(right.cast("double")).alias("_acc"),
        F.stddev_pop("score").alias("_sd_s"),
        F.stddev_pop("fwd").alias("_sd_f"),
        F.corr(F.col("score") - 50.0, fwd).alias("_ic"),
    )
    varied = (F.col("samples") >= 10) & (F.col("_sd_s") > 1e-9) & (F.col("_sd_f") > 1e-9)
    skill = F.when(F.col("directional_bars") >= MIN_CALLS, F.greatest(F.lit(0.0), F.col("_acc") - 0.5)).otherwise(0.0)
    return out.select(
        "horizon_days",
        "component",
        "samples",
        "directional_bars",
        rnd_stable(F.col("_acc"), 4).alias("accuracy"),
        F.when(varied, rnd_stable(F.col("_ic"), 4)).alias("ic"),
        rnd_stable(F.coalesce(skill, F.lit(0.0)), 5).alias("skill"),
    )


def fit_weights(prior: DataFrame, metrics: DataFrame) -> DataFrame:
    """Blend measured skill into the prior of each profile, in percent.

    `prior` is (profile, component, weight) summing to 1 and `metrics` carries
    (profile, component, skill, directional_bars).  Only the weight mass of the
    replayed components moves; both tables are configuration-sized.
    """
    df = prior.join(metrics.select("profile", "component", "skill", "directional_bars"), ["profile", "component"], "left")
    mine = F.col("component").isin(*REPLAYED)
    w = Window.partitionBy("profile")
    mass = F.sum(F.when(mine, F.col("weight")).otherwise(0.0)).over(w)
    skill = F.when(mine, F.coalesce("skill", F.lit(0.0)))
    df = df.withColumn("_mass", mass).withColumn("_skill", skill).withColumn("_skills", F.sum(skill).over(w))
    prior_rel = F.coalesce(F.try_divide(F.col("weight"), F.col("_mass")), F.lit(1.0 / len(REPLAYED)))
    measured = F.when(F.col("_skills") > 0, F.try_divide(F.col("_skill"), F.col("_skills"))).otherwise(prior_rel)
    enough = F.coalesce(F.col("directional_bars"), F.lit(0)) >= MIN_CALLS
    rel = (1 - SHRINK) * prior_rel + SHRINK * F.when(enough, measured).otherwise(prior_rel)
    df = df.withColumn("_rel", F.when(mine, rel))
    df = df.withColumn("_rels", F.sum("_rel").over(w))
    fitted = F.when(mine, F.col("_mass") * F.try_divide(F.col("_rel"), F.col("_rels"))).otherwise(F.col("weight"))
    df = df.withColumn("_fitted", fitted).withColumn("_all", F.sum(F.col("_fitted")).over(w))
    return df.select("profile", "component", rnd_stable(100.0 * F.try_divide(F.col("_fitted"), F.col("_all")), 3).alias("weight"))


def horizon_of(profile: Column, default: int = 5) -> Column:
    out = F.lit(default)
    for name, days in PROFILE_HORIZON_DAYS.items():
        out = F.when(profile == name, days).otherwise(out)
    return out


def tune(numbered: DataFrame, benchmark: DataFrame, prior: DataFrame, step: int = 5) -> DataFrame:
    """Fitted weights of every profile at its own forward horizon."""
    horizons = sorted(set(PROFILE_HORIZON_DAYS.values()))
    metrics = component_metrics(replay(numbered, benchmark, horizons, step))
    profiles = prior.select("profile").distinct().withColumn("horizon_days", horizon_of(F.col("profile")))
    return fit_weights(prior, profiles.join(metrics, "horizon_days"))


def write_fitted(fitted: DataFrame, path: str) -> None:
    """Fitted profiles as JSON rows the weight loader reads back."""
    fitted.coalesce(1).write.mode("overwrite").json(path)
