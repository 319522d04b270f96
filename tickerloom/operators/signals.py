"""Component scores (0-100) built from the indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import Z95, bearish, bullish, clamp, lines, norm_cdf, pct_change, rnd, rnd_stable
from ..session import cut_lineage
from . import indicators as ind
from . import series
from .series import blocks, full, last, ordered, own_rows

RADAR_LOOKBACK = 252
FORECAST_LOOKBACK = 253
MIN_BARS = 30


def _side(known: Column, test: Column, size: float) -> Column:
    """+size where the test holds, -size where it fails, 0 while unknown."""
    return F.when(known & test, F.lit(size)).when(known, F.lit(-size)).otherwise(F.lit(0.0))


def add_technical_score(df: DataFrame) -> DataFrame:
    """Trend and structure score of every bar, with its drivers."""
    df = ind.add_sma(df, 20, 50, 200)
    df = ind.add_bollinger(ind.add_adx(ind.add_rsi(ind.add_macd(df))))
    price, s20, s50, s200 = (F.col(c) for c in ("close", "sma20", "sma50", "sma200"))
    up = F.col("macd_hist") > 0
    score = (
        50.0
        + _side(s50.isNotNull(), price > s50, 8.0)
        + _side(s200.isNotNull(), price > s200, 7.0)
        + _side(s20.isNotNull() & s50.isNotNull(), s20 > s50, 5.0)
        + F.when(up, 6.0).otherwise(-6.0)
        + F.when(F.col("rsi") > 70, -6.0).when(F.col("rsi") < 30, 6.0).otherwise(0.0)
        + F.when(F.col("adx") > 25, F.when(up, 3.0).otherwise(-3.0)).otherwise(0.0)
        + F.when(price > F.col("bb_upper"), -3.0).when(price < F.col("bb_lower"), 3.0).otherwise(0.0)
    )
    return df.withColumn("technical_score", clamp(score))


def add_pattern_adjusted_score(df: DataFrame) -> DataFrame:
    df = ind.add_patterns(df)
    return df.withColumn("technical_structure", clamp(F.col("technical_score") + F.col("pattern_bias") * 6))


def add_price_volume_score(df: DataFrame) -> DataFrame:
    """Momentum, relative volume and accumulation.

    The volume trend compares the running signed volume with the one 19 rows
    earlier, which is the sum of the last 19 signed volumes.
    """
    df = ind.add_signed_volume(ind.add_relative_volume(df))
    df = df.withColumn("ret_5", F.coalesce(ind.change_over(5, 7), F.lit(0.0)))
    df = df.withColumn("ret_20", F.coalesce(ind.change_over(20, 22), F.lit(0.0)))
    df = df.withColumn("_flow", full(F.sum("signed_volume").over(last(19)), 21))
    rvol = F.col("relative_volume")
    score = (
        50.0
        + clamp(F.col("ret_5") * 1.5, -15.0, 15.0)
        + clamp(F.col("ret_20") * 0.7, -12.0, 12.0)
        + F.when(rvol > 1.5, 6.0).when(rvol < 0.6, -3.0).otherwise(0.0)
        + F.when(F.col("_flow") > 0, 4.0).otherwise(-4.0)
    )
    return df.withColumn("price_volume_momentum", clamp(score)).drop("_flow")


def add_event_radar(df: DataFrame, news_items: Column | None = None, policy_links: Column | None = None) -> DataFrame:
    """Breakout and exhaustion read; NULL scores below 30 bars."""
    news_items = F.lit(0) if news_items is None else F.coalesce(news_items, F.lit(0))
    policy_links = F.lit(0) if policy_links is None else F.coalesce(policy_links, F.lit(0))
    for n in (5, 20, 60, 252):
        df = df.withColumn(f"ret_{n}d", ind.change_over(n, n + 1))
    df = series.add_rolling_means(df, "close", 20, 50)
    df = series.add_sliding(df, "close", 252, {"max": "_high"})
    df = (
        df.withColumn("drawdown", pct_change(F.col("close"), F.col("_high")))
        .withColumn("above_ma20", pct_change(F.col("close"), F.col("_mean_20")))
        .withColumn("above_ma50", pct_change(F.col("close"), F.col("_mean_50")))
        .withColumn("volume_ratio", full(F.try_divide(F.col("volume"), F.avg("volume").over(last(20))), 21))
    )
    r5, r20, r60, r252 = (F.col(f"ret_{n}d") for n in (5, 20, 60, 252))
    draw, a20, a50, ratio = (F.col(c) for c in ("drawdown", "above_ma20", "above_ma50", "volume_ratio"))
    zero = F.lit(0.0)
    breakout = zero
    for value, scale in ((r5, 10), (r20, 30), (r60, 80), (r252, 250)):
        breakout = breakout + F.when(value > 0, F.least(F.lit(20.0), value / scale * 20)).otherwise(0.0)
    breakout = (
        breakout
        + F.coalesce(F.least(F.lit(15.0), F.greatest(zero, ratio - 1) * 10), zero)
        + F.least(F.lit(10), news_items * 2)
        + F.least(F.lit(10), policy_links * 3)
    )
    # greatest() skips NULL, so a missing input must not turn into the floor
    exhaustion = (
        F.when(draw.isNotNull(), F.least(F.lit(25.0), F.greatest(zero, -draw))).otherwise(0.0)
        + F.when(a20.isNotNull(), F.least(F.lit(25.0), F.greatest(zero, a20 - 15))).otherwise(0.0)
        + F.when(a50.isNotNull(), F.least(F.lit(25.0), F.greatest(zero, a50 - 30))).otherwise(0.0)
        + F.when(r5 < 0, F.least(F.lit(20.0), F.abs(r5) * 2)).otherwise(0.0)
        + F.when((ratio < 0.8) & (r20 > 20), 10.0).otherwise(0.0)
    )
    enough = F.col("pos") >= MIN_BARS
    df = df.withColumn("_breakout", breakout).withColumn("_exhaustion", exhaustion)
    b, e = F.col("_breakout"), F.col("_exhaustion")
    verdict = (
        F.when(~enough, F.lit(None))
        .when((b >= 55) & (e < 45), "bullish_event_watch")
        .when(e >= 55, "bearish_exhaustion_watch")
        .when(b >= 40, "early_event_watch")
        .otherwise("no_major_event")
    )
    bull = lines(
        F.when(r20 >= 25, "acceleration_20d"),
        F.when(r60 >= 60, "momentum_60d"),
        F.when(r252 >= 150, "multi_month_winner"),
        F.when(ratio >= 1.8, "volume_expansion"),
        F.when(news_items >= 3, "fresh_news"),
        F.when(policy_links > 0, "policy_link"),
    )
    bear = lines(
        F.when(r5 <= -8, "short_term_breakdown"),
        F.when(draw <= -15, "below_recent_high"),
        F.when((a20 >= 25) & (ratio.isNull() | (ratio < 1.2)), "stretched_without_volume"),
        F.when(a50 >= 45, "extended_above_ma50"),
    )
    return (
        df.withColumn("radar_verdict", verdict)
        .withColumn("breakout_score", F.when(enough, rnd(F.least(F.lit(100.0), b), 1)))
        .withColumn("exhaustion_score", F.when(enough, rnd(F.least(F.lit(100.0), e), 1)))
        .withColumn("bullish_clues", F.when(enough, bull))
        .withColumn("bearish_clues", F.when(enough, bear))
        .drop("_breakout", "_exhaustion", "_mean_20", "_mean_50", "_high")
    )


def add_return_stats(df: DataFrame) -> DataFrame:
    """Mean and population deviation of the last 252 log returns (30 needed)."""
    if "log_return" not in df.columns:
        df = ind.add_returns(df)
    enough = F.col("pos") >= MIN_BARS + 1
    df = series.add_sliding(df, "log_return", 252, {"mean": "_m1", "var": "_v"})
    df = df.withColumns({"_mu": F.when(enough, F.col("_m1")), "_sigma": F.when(enough, F.sqrt("_v"))})
    return df.drop("_m1", "_v")


def return_band(horizon: Column, mu: str = "_mu", sigma: str = "_sigma") -> dict[str, Column]:
    """Closed-form lognormal band of the horizon return."""
    h = horizon.cast("double")
    drift, spread = F.col(mu) * h, F.col(sigma) * F.sqrt(h)
    certain = F.when(drift > 0, 1.0).otherwise(0.0)
    return {
        "prob_up": F.when(F.col(sigma) > 0, norm_cdf(F.try_divide(drift, spread))).when(F.col(sigma) == 0, certain),
        "expected_return_pct": (F.exp(drift) - 1) * 100,
        "p05_return_pct": (F.exp(drift - Z95 * spread) - 1) * 100,
        "p95_return_pct": (F.exp(drift + Z95 * spread) - 1) * 100,
    }


def forecast_score(votes: Column, prob_up: Column) -> Column:
    blended = clamp(0.5 * votes + 0.5 * (50 + (prob_up - 0.5) * 60))
    return rnd_stable(F.coalesce(blended, votes), 1)


def add_forecasts(df: DataFrame, horizons: dict[str, int]) -> DataFrame:
    """Band and ensemble score per named horizon; unavailable below 30 bars."""
    df = add_return_stats(ind.add_trend_votes(df))
    enough = F.col("pos") >= MIN_BARS
    for name, days in horizons.items():
        for column, value in return_band(F.lit(days)).items():
            digits = 3 if column == "prob_up" else 2
            df = df.withColumn(f"{name}_{column}", rnd(value, digits))
        exact = return_band(F.lit(days))["prob_up"]
        df = df.withColumn(
            f"{name}_score", F.when(enough, forecast_score(F.col("vote_score"), exact)).otherwise(50.0)
        )
    return df.withColumn("forecast_available", enough).drop("_mu", "_sigma")


def add_relative_strength(df: DataFrame) -> DataFrame:
    """Score against the benchmark on joint dates; expects `bench_close`.

    Compares the moves over the last 20 joint rows (19 rows back), available from
    30 joint rows on.
    """
    w = ordered()
    asset = F.col("close") / F.lag("close", 19).over(w) - 1
    bench = F.col("bench_close") / F.lag("bench_close", 19).over(w) - 1
    df = df.withColumn("relative_strength", full((asset - bench) * 100, MIN_BARS))
    score = clamp(50 + clamp(F.col("relative_strength") * 1.2, -20.0, 20.0))
    return df.withColumn("cross_market_correlation", F.coalesce(score, F.lit(50.0))).withColumn(
        "cross_market_available", F.col("relative_strength").isNotNull()
    )


def join_benchmark(bars: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Bars on the dates the benchmark also has, with `bench_close`."""
    bench = benchmark.select("date", F.col("close").alias("bench_close"))
    return bars.drop("pos", "n").join(bench, "date")


def benchmark_correlation(numbered_joint: DataFrame) -> DataFrame:
    """Correlation of daily returns on joint dates; 30 joint rows needed."""
    df = blocks(numbered_joint, 1)
    w = ordered()
    df = df.withColumn("_a", F.col("close") / F.lag("close").over(w) - 1).withColumn(
        "_b", F.col("bench_close") / F.lag("bench_close").over(w) - 1
    )
    out = own_rows(df).groupBy("ticker").agg(F.corr("_a", "_b").alias("corr"), F.count(F.lit(1)).alias("joint_rows"))
    return out.select("ticker", F.when(F.col("joint_rows") >= MIN_BARS, F.col("corr")).alias("corr"), "joint_rows")


def daily_returns(numbered: DataFrame, key: str) -> DataFrame:
    """Simple return per bar on the series' own calendar."""
    df = blocks(numbered, 1)
    ret = F.col("close") / F.lag("close").over(ordered(key)) - 1
    return own_rows(df.withColumn("ret", ret)).where(F.col("ret").isNotNull()).select(key, "date", "ret", "n")


#: days of a block; each block of a series is one bitmap
BITS = 64


def day_bits(returns: DataFrame, key: str) -> DataFrame:
    """(key, block, bits): which days of each block have a return."""
    one = F.lit(1).cast("long")
    place = F.pmod(F.col("day"), F.lit(BITS)).cast("int")
    return returns.groupBy(key, "block").agg(F.bit_or(F.call_function("shiftleft", one, place)).alias("bits"))


def global_correlations(bars: DataFrame, index_bars: DataFrame, window: int = 60) -> DataFrame:
    """Correlation of each ticker with each index over their last joint returns.

    Blocks of 64 days meet as bitmaps, so that a pair's joint days are counted without a
    row for each.  From the newest block back, only the blocks before the count reaches
    `window` are read: a pair reads a bounded number of rows however long its history.
    """
    day = F.unix_date("date")
    block = F.floor(day / BITS)
    a = daily_returns(bars, "ticker").select("ticker", day.alias("day"), block.alias("block"), F.col("ret").alias("a"))
    b = daily_returns(index_bars, "index_name").where(F.col("n") >= MIN_BARS)
    b = b.select("index_name", day.alias("day"), block.alias("block"), F.col("ret").alias("b"))
    a, b = cut_lineage(a), cut_lineage(b)
    both = day_bits(a, "ticker").join(day_bits(b, "index_name").withColumnRenamed("bits", "other"), "block")
    shared = both.select("ticker", "index_name", "block", F.bit_count(F.col("bits").bitwiseAND(F.col("other"))).alias("n")).where(F.col("n") > 0)
    newer = Window.partitionBy("ticker", "index_name").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    needed = shared.withColumn("_newer", F.coalesce(F.sum("n").over(newer), F.lit(0))).where(F.col("_newer") < window)
    joint = needed.select("ticker", "index_name", "block").join(a, ["ticker", "block"]).join(b, ["index_name", "block", "day"])
    recent = Window.partitionBy("ticker", "index_name").orderBy(F.desc("day"))
    joint = joint.withColumn("_rank", F.row_number().over(recent)).where(F.col("_rank") <= window)
    out = joint.groupBy("ticker", "index_name").agg(F.corr("a", "b").alias("_corr"), F.count(F.lit(1)).alias("_rows"))
    out = out.where((F.col("_rows") >= MIN_BARS) & F.col("_corr").isNotNull() & ~F.isnan("_corr"))
    return out.select("ticker", "index_name", rnd_stable(F.col("_corr"), 2).alias("corr"))


def correlation_map(pairs: DataFrame) -> DataFrame:
    """Per ticker: map in order of strength, and the mean absolute value.

    A ticker has one entry per index, so the collected list is as long as the list
    of indexes.
    """
    entry = F.struct((-F.abs("corr")).alias("o"), "index_name", "corr")
    out = pairs.groupBy("ticker").agg(F.array_sort(F.collect_list(entry)).alias("_e"), F.avg(F.abs("corr")).alias("avg_abs_corr"))
    pairs_in_order = F.transform("_e", lambda e: F.struct(e["index_name"], e["corr"]))
    return out.select("ticker", F.map_from_entries(pairs_in_order).alias("global_correlations"), "avg_abs_corr")


def latest_change(numbered: DataFrame, key: str) -> DataFrame:
    """Last close, the one before, and the day change in percent."""
    newest = numbered.where(F.col("pos") >= F.col("n") - 1)
    out = newest.groupBy(key).agg(
        F.max_by("close", "date").alias("current_price"),
        F.min_by("close", "date").alias("previous_close"),
        F.max("date").alias("date"),
        F.max_by("volume", "date").alias("last_volume"),
    )
    return out.withColumn("day_change_pct", pct_change(F.col("current_price"), F.col("previous_close")))


def global_breadth(index_quotes: DataFrame) -> DataFrame:
    """Advancers, decliners and the tone of the world tape."""
    moves = F.when(F.col("index_name") != "VIX", F.col("day_change_pct"))
    out = index_quotes.groupBy().agg(
        F.count(F.lit(1)).alias("indexes"),
        F.sum(F.when(moves > 0, 1).otherwise(0)).alias("advancers"),
        F.sum(F.when(moves < 0, 1).otherwise(0)).alias("decliners"),
    )
    share = F.coalesce(F.try_divide(F.col("advancers"), F.col("advancers") + F.col("decliners")), F.lit(0.5))
    tone = F.when(share > 0.6, "risk-on").when(share < 0.4, "risk-off").otherwise("mixed")
    return out.withColumn("breadth", share).withColumn("tone", tone)


def invalidation_level(direction: Column, price: Column, atr: Column) -> Column:
    return F.when(bullish(direction), price - 1.5 * atr).when(bearish(direction), price + 1.5 * atr)


def target_and_stop(
    direction: Column, price: Column, ret: Column, p05: Column, atr: Column
) -> tuple[Column, Column]:
    """Target from the forecast median, stop from 1.5 ATR or the lower band."""
    short = bearish(direction)
    move = F.when(short & (ret > 0), -ret).otherwise(ret)
    target = price * (1 + move / 100.0)
    wide = F.least(F.greatest(1.5 * atr, price * 0.025), price * 0.10)
    downside = F.when(p05.isNotNull(), F.abs(p05) / 100 * 0.75).otherwise(0.045)
    narrow = price * F.least(F.greatest(downside, F.lit(0.035)), F.lit(0.095))
    distance = F.when(atr > 0, wide).otherwise(narrow)
    known = price.isNotNull() & ret.isNotNull()
    stop = F.when(short, price + distance).otherwise(price - distance)
    return F.when(known, rnd(target, 4)), F.when(known, rnd(stop, 4))
