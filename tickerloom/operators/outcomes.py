"""Measuring past calls: forward outcome, scorecards, labels, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import bearish, bullish, clamp, rnd_stable
from .scoring import severity

BUCKETS = ("00-49", "50-64", "65-74", "75-84", "85-100")


def horizon_days(horizon: Column) -> Column:
    """'5D' -> 5, INTRADAY -> 1, anything else -> 5; at least 1."""
    text = F.upper(F.coalesce(horizon, F.lit("")))
    days = F.regexp_extract(text, r"^\s*([+-]?\d+)D$", 1).try_cast("int")
    return F.when(text == "INTRADAY", 1).when(days.isNull(), 5).otherwise(F.greatest(F.lit(1), days))


def side(direction: Column) -> Column:
    return F.when(bullish(direction), "long").when(bearish(direction), "short").otherwise("neutral")


def confidence_bucket(conf: Column) -> Column:
    return (
        F.when(conf.isNull(), "unknown")
        .when(conf < 50, "00-49")
        .when(conf < 65, "50-64")
        .when(conf < 75, "65-74")
        .when(conf < 85, "75-84")
        .otherwise("85-100")
    )


#: places of one bucket, and levels of buckets; on the last one all of a ticker's (at most 900 for the dates there are) share a bucket
BUCKET_PLACES, BUCKET_LEVELS = 64, 3


def next_marks(keys: DataFrame, marks: DataFrame, level: int = 0) -> DataFrame:
    """For each (ticker, place) of ``keys``: the value of the first mark at that place or later.

    A merge by buckets of places.  Keys and marks of a bucket are run through together,
    latest first; a key with no mark left in its bucket takes the first mark of the next
    bucket that has one, found in the same way among the buckets' first marks.  So a gap of
    any length costs no rows, and no window or join is keyed by the ticker alone.  Expects
    distinct keys and one mark for each ticker and place; the value is null where no mark follows.
    """
    last = level + 1 == BUCKET_LEVELS
    bucket = F.floor((F.col("place") + (1 << 20)) / (1 << 22) if last else F.col("place") / BUCKET_PLACES).alias("bucket")
    wanted = keys.select("ticker", "place", bucket, F.lit(True).alias("asks"), F.lit(None).cast(marks.schema["value"].dataType).alias("value"))
    given = marks.select("ticker", "place", bucket, F.lit(False).alias("asks"), "value")
    # on the lowest level a mark of the same place answers; above it, only later buckets do
    order = [F.desc("place"), F.asc("asks") if level == 0 else F.desc("asks")]
    seen = Window.partitionBy("ticker", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    answered = wanted.unionByName(given).withColumn("value", F.last("value", ignorenulls=True).over(seen)).where("asks").drop("asks")
    if not last:
        asking = answered.where(F.col("value").isNull()).select("ticker", F.col("bucket").alias("place")).distinct()
        firsts = given.groupBy("ticker", F.col("bucket").alias("place")).agg(F.min_by("value", "place").alias("value"))
        later = next_marks(asking, firsts.select("ticker", "place", "value"), level + 1)
        later = later.select("ticker", F.col("place").alias("bucket"), F.col("value").alias("_later"))
        answered = answered.join(later, ["ticker", "bucket"], "left").withColumn("value", F.coalesce("value", "_later"))
    return answered.select("ticker", "place", "value")


def next_bars(days: DataFrame, numbered: DataFrame) -> DataFrame:
    """(ticker, target_date, exit_date, exit_price): the first bar on or after each distinct (ticker, target_date).

    Of several bars on one day the first answers.
    """
    bar = F.min_by(F.struct("date", "close"), "pos").alias("value")
    marks = numbered.groupBy("ticker", F.unix_date("date").alias("place")).agg(bar)
    keys = days.where(F.col("ticker").isNotNull() & F.col("target_date").isNotNull()).select("ticker", F.unix_date("target_date").alias("place")).distinct()
    found = next_marks(keys, marks).where(F.col("value").isNotNull())
    return found.select("ticker", F.date_from_unix_date("place").alias("target_date"), F.col("value.date").alias("exit_date"), F.col("value.close").alias("exit_price"))


def forward_outcomes(calls: DataFrame, numbered: DataFrame) -> DataFrame:
    """Outcome of each call on the first bar on or after its target date.

    status: scored, pending (no such bar yet), not_actionable (neutral, no entry).
    A target before the series starts is answered by the first bar.
    """
    df = calls.withColumn("horizon_days", horizon_days(F.col("horizon"))).withColumn("side", side(F.col("direction")))
    df = df.withColumn("target_date", F.expr("date_add(as_of, horizon_days)"))
    actionable = (
        F.col("as_of").isNotNull() & (F.col("side") != "neutral") & (F.coalesce(F.col("entry_price"), F.lit(0.0)) != 0)
    )
    df = df.withColumn("_live", actionable)
    df = df.join(next_bars(df, numbered), ["ticker", "target_date"], "left")
    status = F.when(~F.col("_live"), "not_actionable").when(F.col("exit_date").isNull(), "pending").otherwise("scored")
    df = df.withColumn("status", status)
    scored = F.col("status") == "scored"
    ret = F.when(scored, (F.try_divide(F.col("exit_price"), F.col("entry_price")) - 1.0) * 100.0)
    signed = F.when(F.col("side") == "long", ret).otherwise(-ret)
    return (
        df.withColumn("return_pct", rnd_stable(ret, 2))
        .withColumn("side_return_pct", rnd_stable(signed, 2))
        .withColumn("hit", signed > 0)
        .withColumn("exit_price", F.when(scored, F.col("exit_price")))
        .withColumn("exit_date", F.when(scored, F.col("exit_date")))
        .withColumn("confidence_bucket", confidence_bucket(F.col("confidence_score")))
        .drop("_live")
    )


def _hit_rate() -> Column:
    return rnd_stable(F.avg(F.col("hit").cast("double")) * 100.0, 1)


def scorecard(outcomes: DataFrame) -> DataFrame:
    """Totals, per side and per confidence bucket in one grouped pass."""
    scored = F.col("status") == "scored"
    sets = outcomes.select(
        "status",
        "hit",
        "side_return_pct",
        F.when(scored, F.col("side")).alias("side"),
        F.when(scored, F.col("confidence_bucket")).alias("bucket"),
    )
    grouped = sets.groupingSets([[], ["side"], ["bucket"]], "side", "bucket").agg(
        F.grouping_id().alias("_g"),
        F.count(F.lit(1)).alias("rows"),
        F.sum((F.col("status") == "scored").cast("long")).alias("scored"),
        F.sum((F.col("status") == "pending").cast("long")).alias("pending"),
        F.sum((F.col("status") == "not_actionable").cast("long")).alias("not_actionable"),
        _hit_rate().alias("hit_rate_pct"),
        rnd_stable(F.avg("side_return_pct"), 2).alias("avg_side_return_pct"),
    )
    level = F.when(F.col("_g") == 3, "total").when(F.col("_g") == 1, "side").otherwise("bucket")
    member = F.when(F.col("_g") == 3, "all").otherwise(F.coalesce("side", "bucket"))
    return (
        grouped.select(level.alias("level"), member.alias("member"), "rows", "scored", "pending", "not_actionable", "hit_rate_pct", "avg_side_return_pct")
        .where(F.col("member").isNotNull())
    )


def option_outcomes(snapshots: DataFrame, target_days: int = 3) -> DataFrame:
    """Premium outcome of each stored option idea from later marks of its contract.

    Marks are first reduced to one row per (contract, day), so a contract's window is
    as long as its life in days.  The exit is the first mark of the first day at or
    after the target; the extremes cover the later marks of the entry day, the days
    in between, and the exit itself.
    """
    gap = max(1, target_days)
    micros = F.unix_micros(F.col("as_of").cast("timestamp"))
    price = F.col("reference_option_price")
    df = snapshots.withColumn("contract", F.upper(F.coalesce("reference_contract", F.lit("")))).withColumn(
        "day", F.to_date("as_of")
    )
    daily = df.where(price.isNotNull() & F.col("as_of").isNotNull() & (F.col("contract") != "")).groupBy("contract", "day")
    daily = daily.agg(
        F.min(F.struct("as_of", price.alias("price"), "underlying_price")).alias("first"),
        F.max(price).alias("day_max"),
        F.min(price).alias("day_min"),
    )
    # newest day first: the frame then grows row by row instead of being rebuilt
    newest = Window.partitionBy("contract").orderBy(-F.unix_date("day"))
    exit_mark = F.last("first").over(newest.rangeBetween(Window.unboundedPreceding, -gap))
    if gap > 1:
        between = newest.rangeBetween(-(gap - 1), -1)
        high, low = F.max("day_max").over(between), F.min("day_min").over(between)
    else:
        high = low = F.lit(None).cast("double")
    daily = daily.select("contract", "day", exit_mark.alias("exit"), high.alias("_high"), low.alias("_low"))
    rest_of_day = Window.partitionBy("contract", "day").orderBy(-micros).rangeBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_day_high", F.max(price).over(rest_of_day)).withColumn("_day_low", F.min(price).over(rest_of_day))
    df = df.join(daily, ["contract", "day"], "left")
    live = (
        (F.coalesce("ticker", F.lit("")) != "")
        & (F.col("contract") != "")
        & F.col("as_of").isNotNull()
        & (F.coalesce(price, F.lit(0.0)) > 0)
        & F.contains(F.upper(F.coalesce("action", F.lit(""))), F.lit("BUY"))
    )
    status = F.when(~live, "not_actionable").when(F.col("exit").isNull(), "pending").otherwise("scored")
    df = df.withColumn("status", status)
    scored = F.col("status") == "scored"
    exit_price = F.when(scored, F.col("exit.price"))
    best = F.greatest(exit_price, "_high", "_day_high")
    worst = F.least(exit_price, "_low", "_day_low")

    def pct(x: Column) -> Column:
        return F.when(scored, (F.try_divide(x, price) - 1.0) * 100.0)

    return (
        df.withColumn("exit_option_price", exit_price)
        .withColumn("exit_as_of", F.when(scored, F.col("exit.as_of")))
        .withColumn("exit_underlying", F.when(scored, F.col("exit.underlying_price")))
        .withColumn("premium_return_pct", rnd_stable(pct(exit_price), 2))
        .withColumn("hit", pct(exit_price) > 0)
        .withColumn("max_mark_pct", rnd_stable(pct(best), 2))
        .withColumn("min_mark_pct", rnd_stable(pct(worst), 2))
        .drop("exit", "_high", "_low", "_day_high", "_day_low", "day")
    )


def option_scorecard(outcomes: DataFrame) -> DataFrame:
    """Totals and results per risk gate."""
    gate = F.when(F.col("status") == "scored", F.coalesce("risk_gate", F.lit("unknown")))
    grouped = outcomes.select("status", "hit", "premium_return_pct", gate.alias("gate")).rollup("gate").agg(
        F.grouping("gate").alias("_g"),
        F.count(F.lit(1)).alias("rows"),
        F.sum((F.col("status") == "scored").cast("long")).alias("scored"),
        F.sum((F.col("status") == "pending").cast("long")).alias("pending"),
        F.sum((F.col("status") == "not_actionable").cast("long")).alias("not_actionable"),
        _hit_rate().alias("hit_rate_pct"),
        rnd_stable(F.avg("premium_return_pct"), 2).alias("avg_premium_return_pct"),
    )
    named = grouped.withColumn("gate", F.when(F.col("_g") == 1, "all").otherwise(F.col("gate"))).drop("_g")
    return named.where(F.col("gate").isNotNull())


def row_key() -> Column:
    return F.coalesce(F.col("prediction_id").cast("string"), F.concat_ws("|", "run_id", "ticker"))


def label_table(features: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Features of each call with its matured outcome; pending calls keep no label."""
    labels = outcomes.select(
        row_key().alias("key"),
        "status",
        "horizon_days",
        F.col("hit").alias("label_hit"),
        F.col("side_return_pct").alias("label_side_return_pct"),
        F.col("return_pct").alias("label_return_pct"),
    )
    return features.withColumn("key", row_key()).join(labels, "key")


def calibration_profile(outcomes: DataFrame, min_samples: int = 20) -> DataFrame:
    """Per confidence bucket: sample count, mean confidence, hit rate, usable flag."""
    scored = outcomes.where(F.col("status") == "scored")
    found = scored.groupBy(F.col("confidence_bucket").alias("bucket")).agg(
        F.count(F.lit(1)).alias("count"),
        rnd_stable(F.avg("confidence_score"), 1).alias("avg_confidence"),
        _hit_rate().alias("hit_rate_pct"),
        rnd_stable(F.avg("side_return_pct"), 2).alias("avg_side_return_pct"),
    )
    names = outcomes.sparkSession.range(1).select(F.explode(F.array(*[F.lit(b) for b in BUCKETS])).alias("bucket"))
    out = found.join(names, "bucket", "right").withColumn("count", F.coalesce("count", F.lit(0)))
    return out.withColumn("usable", F.col("count") >= min_samples)


def apply_calibration(calls: DataFrame, profile: DataFrame, strict_zero: bool = False, threshold: float = 65) -> DataFrame:
    """Bounded confidence adjustment from the profile, severity recomputed.

    The profile has one row per bucket (five), so it is broadcast.  A hit rate of
    exactly zero counts as missing unless `strict_zero` is set.
    """
    p = profile.select(
        F.col("bucket").alias("_bucket"),
        F.col("count").alias("_n"),
        F.col("avg_confidence").alias("_conf"),
        F.col("hit_rate_pct").alias("_hit"),
        F.col("usable").alias("_usable"),
    )
    raw = F.col("confidence_score")
    df = calls.withColumn("_bucket", confidence_bucket(raw)).join(p, "_bucket", "left")
    usable = F.coalesce(F.col("_usable"), F.lit(False))

    def known(x: Column) -> Column:
        return F.coalesce(x if strict_zero else F.nullif(x, F.lit(0.0)), raw)

    weight = F.least(F.lit(1.0), F.col("_n") / 60.0)
    shift = clamp((known(F.col("_hit")) - known(F.col("_conf"))) * weight, -15.0, 8.0)
    df = df.withColumn("calibration_available", usable).withColumn(
        "calibration_adjustment", F.when(usable, rnd_stable(shift, 1)).otherwise(0.0)
    )
    df = df.withColumn("raw_confidence_score", rnd_stable(raw, 1)).withColumn("sample_count", F.coalesce("_n", F.lit(0)))
    df = df.withColumn("confidence_score", F.when(usable, rnd_stable(clamp(raw + shift), 1)).otherwise(raw))
    if {"opportunity_score", "risk_level", "block_trade"} <= set(calls.columns):
        fresh = severity(
            F.col("opportunity_score"), F.col("confidence_score"), F.col("risk_level"), F.col("block_trade"), threshold
        )
        old = F.col("severity") if "severity" in calls.columns else fresh
        df = df.withColumn("severity", F.when(usable, fresh).otherwise(old))
    return df.drop("_bucket", "_n", "_conf", "_hit", "_usable")
