"""Price and volume indicators as window columns.

Every function takes a frame from `series.blocks` or `series.tail` and adds
columns; all of them use the same (ticker, block) window, so a chain of indicators
costs one exchange and one sort.  A rolling value is NULL until its window is full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clamp, pct_change
from . import series
from .series import full, last, ordered

MACD_SPANS = (12, 26, 9)
MACD_LOOKBACK = series.ema_lookback(26) + series.ema_lookback(9)
MACD_BLOCK = series.ema_block(MACD_LOOKBACK, *MACD_SPANS)
SCORE_LOOKBACK = MACD_LOOKBACK


def add_sma(df: DataFrame, *lengths: int, source: str = "close") -> DataFrame:
    """Simple moving averages `sma<n>`, NULL until n rows exist."""
    df = series.add_rolling_means(df, source, *lengths, prefix="sma")
    return df.withColumns({f"sma{n}": full(F.col(f"sma{n}"), n) for n in lengths})


def add_returns(df: DataFrame) -> DataFrame:
    prev = F.lag("close").over(ordered())
    return df.withColumn("prev_close", prev).withColumn("log_return", F.ln(F.col("close") / F.col("prev_close")))


def add_rsi(df: DataFrame, n: int = 14) -> DataFrame:
    """Simple-mean RSI; a window without losses counts as neutral 50."""
    if "prev_close" not in df.columns:
        df = add_returns(df)
    change = F.col("close") - F.col("prev_close")
    df = df.withColumn("_gain", F.greatest(change, F.lit(0.0))).withColumn("_loss", F.greatest(-change, F.lit(0.0)))
    gain = full(F.avg("_gain").over(last(n)), n + 1)
    loss = full(F.avg("_loss").over(last(n)), n + 1)
    df = df.withColumn("_rs", F.try_divide(gain, loss))
    return df.withColumn("rsi", F.coalesce(100 - 100 / (1 + F.col("_rs")), F.lit(50.0))).drop("_gain", "_loss", "_rs")


def add_macd(df: DataFrame, spans: tuple[int, int, int] = MACD_SPANS) -> DataFrame:
    fast, slow, signal = spans
    df = series.add_emas(df, "close", {"_fast": fast, "_slow": slow})
    df = series.add_emas(df.withColumn("macd", F.col("_fast") - F.col("_slow")), "macd", {"macd_signal": signal})
    return df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop("_fast", "_slow")


def add_bollinger(df: DataFrame, n: int = 20, width: float = 2.0) -> DataFrame:
    mid = full(F.avg("close").over(last(n)), n)
    df = df.withColumn("bb_mid", mid).withColumn("_sd", full(F.stddev_samp("close").over(last(n)), n))
    return (
        df.withColumn("bb_upper", F.col("bb_mid") + width * F.col("_sd"))
        .withColumn("bb_lower", F.col("bb_mid") - width * F.col("_sd"))
        .drop("_sd")
    )


def add_true_range(df: DataFrame) -> DataFrame:
    """Largest of the three ranges; the first bar has only high - low."""
    if "prev_close" not in df.columns:
        df = add_returns(df)
    prev = F.col("prev_close")
    return df.withColumn(
        "true_range",
        F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)),
    )


def add_atr(df: DataFrame, n: int = 14) -> DataFrame:
    if "true_range" not in df.columns:
        df = add_true_range(df)
    return df.withColumn("atr", full(F.avg("true_range").over(last(n)), n))


def add_adx(df: DataFrame, n: int = 14) -> DataFrame:
    """Average directional index.

    The first directional movement is 0.  A zero range or a zero index sum leaves
    the windows that contain it unknown, and unknown reads as 0.
    """
    if "atr" not in df.columns:
        df = add_atr(df, n)
    up = F.col("high") - F.lag("high").over(ordered())
    down = F.lag("low").over(ordered()) - F.col("low")
    df = df.withColumn("_up", up).withColumn("_down", down)
    df = df.withColumn(
        "_plus", F.when((F.col("_up") > F.col("_down")) & (F.col("_up") > 0), F.col("_up")).otherwise(0.0)
    ).withColumn(
        "_minus", F.when((F.col("_down") > F.col("_up")) & (F.col("_down") > 0), F.col("_down")).otherwise(0.0)
    )
    plus = 100 * F.try_divide(full(F.avg("_plus").over(last(n)), n), F.col("atr"))
    minus = 100 * F.try_divide(full(F.avg("_minus").over(last(n)), n), F.col("atr"))
    df = df.withColumn("_pdi", plus).withColumn("_mdi", minus)
    df = df.withColumn(
        "_dx", 100 * F.try_divide(F.abs(F.col("_pdi") - F.col("_mdi")), F.col("_pdi") + F.col("_mdi"))
    )
    known = F.count("_dx").over(last(n)) == n
    df = df.withColumn("adx", F.coalesce(F.when(known, F.avg("_dx").over(last(n))), F.lit(0.0)))
    return df.drop("_up", "_down", "_plus", "_minus", "_pdi", "_mdi", "_dx")


def add_relative_volume(df: DataFrame, n: int = 20) -> DataFrame:
    mean = full(F.avg("volume").over(last(n)), n)
    return df.withColumn("relative_volume", F.coalesce(F.try_divide(F.col("volume"), mean), F.lit(1.0)))


def add_signed_volume(df: DataFrame) -> DataFrame:
    if "prev_close" not in df.columns:
        df = add_returns(df)
    sign = F.coalesce(F.signum(F.col("close") - F.col("prev_close")), F.lit(0.0))
    return df.withColumn("signed_volume", sign * F.col("volume"))


def on_balance_volume(numbered: DataFrame) -> DataFrame:
    """Cumulative signed volume of the whole series, in two bounded passes."""
    signed = series.own_rows(add_signed_volume(series.blocks(numbered, 1))).drop("pos", "n")
    return series.with_positions(signed, sums={"obv": F.col("signed_volume")})


# fixed values: pattern names and their lean, in reporting order
PATTERNS = {
    "doji": 0,
    "hammer": 1,
    "shooting_star": -1,
    "bullish_engulfing": 1,
    "bearish_engulfing": -1,
}


def add_patterns(df: DataFrame) -> DataFrame:
    """Candle patterns of the bar and its predecessor; needs three bars."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    df = df.withColumn("_po", F.lag("open").over(ordered())).withColumn("_pc", F.lag("close").over(ordered()))
    po, pc = F.col("_po"), F.col("_pc")
    body = F.abs(c - o)
    reach = F.when(h - l == 0, F.lit(1e-9)).otherwise(h - l)
    lower = F.least(o, c) - l
    upper = h - F.greatest(o, c)
    rises, rose = c > o, pc > po
    found = {
        "doji": body <= 0.1 * reach,
        "hammer": (lower > 2 * body) & (upper < body),
        "shooting_star": (upper > 2 * body) & (lower < body),
        "bullish_engulfing": rises & ~rose & (c >= po) & (o <= pc),
        "bearish_engulfing": ~rises & rose & (o >= pc) & (c <= po),
    }
    enough = F.col("pos") >= 3
    names = F.array_compact(F.array(*[F.when(enough & test, F.lit(name)) for name, test in found.items()]))
    net = sum((F.when(enough & found[name], lean).otherwise(0) for name, lean in PATTERNS.items()), F.lit(0))
    return (
        df.withColumn("patterns", names)
        .withColumn("pattern_bias", clamp(net / 2.0, -1.0, 1.0))
        .drop("_po", "_pc")
    )


def add_realized_vol(df: DataFrame, n: int = 20) -> DataFrame:
    """Sample deviation of the last n log returns (fewer at the start), annualised, in %."""
    if "log_return" not in df.columns:
        df = add_returns(df)
    spread = F.stddev_samp("log_return").over(last(n))
    return df.withColumn("realized_vol", spread * F.sqrt(F.lit(252.0)) * 100)


def historical_move(numbered: DataFrame, horizon_days: int = 5) -> DataFrame:
    """One-sigma move over the horizon from all log returns of a ticker."""
    df = series.own_rows(add_returns(series.blocks(numbered, 1)))
    move = F.stddev_samp("log_return") * F.sqrt(F.lit(float(horizon_days))) * 100
    return df.groupBy("ticker").agg(move.alias("move_pct"))


def add_vote_inputs(df: DataFrame) -> DataFrame:
    """Columns the three trend agents look at."""
    prior = ordered().rowsBetween(-20, -1)
    df = series.add_rolling_means(df, "close", 20, 50)
    return (
        df.withColumn("channel_high", full(F.max("close").over(prior), 21))
        .withColumn("channel_low", full(F.min("close").over(prior), 21))
        .withColumn("_fast", full(F.col("_mean_20"), 51))
        .withColumn("_slow", full(F.col("_mean_50"), 51))
        .withColumn("_mom", full(F.col("close") / F.lag("close", 62).over(ordered()) - 1, 64))
    )


def add_trend_votes(df: DataFrame) -> DataFrame:
    """+1 long, -1 short, 0 flat, NULL while an agent lacks rows."""
    df = add_vote_inputs(df)
    close, hi, lo = F.col("close"), F.col("channel_high"), F.col("channel_low")
    fast, slow, mom = F.col("_fast"), F.col("_slow"), F.col("_mom")
    df = (
        df.withColumn("turtle", F.when(hi.isNotNull(), F.when(close >= hi, 1).when(close <= lo, -1).otherwise(0)))
        .withColumn("ma_crossover", F.when(slow.isNotNull(), F.when(fast > slow, 1).when(fast < slow, -1).otherwise(0)))
        .withColumn("momentum", F.when(mom.isNotNull(), F.when(mom > 0.02, 1).when(mom < -0.02, -1).otherwise(0)))
    )
    votes = [F.col(v) for v in ("turtle", "ma_crossover", "momentum")]
    net = sum((F.coalesce(v, F.lit(0)) for v in votes), F.lit(0))
    cast = sum((v.isNotNull().cast("int") for v in votes), F.lit(0))
    score = clamp(50 + F.try_divide(net, cast) * 30)
    return (
        df.withColumn("vote_score", F.coalesce(score, F.lit(50.0)))
        .withColumn("vote_count", cast)
        .drop("channel_high", "channel_low", "_fast", "_slow", "_mom", "_mean_20", "_mean_50")
    )


def change_over(n: int, guard: int) -> Column:
    """Percent change over n rows, NULL before `guard` rows exist."""
    return full(pct_change(F.col("close"), F.lag("close", n).over(ordered())), guard)
