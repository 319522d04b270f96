"""Scheduled events: generation, horizon join and risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import bearish, bullish, lines, rnd_stable

EVENT_COLUMNS = ["date", "kind", "title", "impact", "scope", "ticker", "source"]


def rule_events(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Jobs report on each first Friday, jobless claims every Thursday."""
    days = spark.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date")
    )
    weekday = F.weekday("date")
    rules = F.array_compact(
        F.array(
            F.when(
                (weekday == 4) & (F.dayofmonth("date") <= 7),
                F.struct(
                    F.lit("nfp").alias("kind"),
                    F.lit("Non-farm payrolls / jobs report").alias("title"),
                    F.lit("high").alias("impact"),
                    F.lit("first Friday rule").alias("source"),
                ),
            ),
            F.when(
                weekday == 3,
                F.struct(
                    F.lit("jobless_claims").alias("kind"),
                    F.lit("Initial jobless claims").alias("title"),
                    F.lit("medium").alias("impact"),
                    F.lit("weekly Thursday rule").alias("source"),
                ),
            ),
        )
    )
    return (
        days.select("date", F.explode(rules).alias("e"))
        .select("date", "e.*")
        .withColumn("scope", F.lit("market"))
        .withColumn("ticker", F.lit(None).cast("string"))
        .select(*EVENT_COLUMNS)
    )


def upcoming(curated: DataFrame, rules: DataFrame, today: Column, days_ahead: int) -> DataFrame:
    """Curated and rule-derived market events in [today, today + days_ahead]."""
    events = curated.select(*EVENT_COLUMNS).unionByName(rules)
    away = F.datediff("date", today)
    return events.withColumn("days_away", away).where(F.col("days_away").between(0, days_ahead))


def next_report_date(dates: DataFrame, today: Column) -> DataFrame:
    """Soonest report date from today on, else the latest past one as an estimate."""
    future = F.min(F.when(F.col("date") >= today, F.col("date")))
    past = F.max(F.when(F.col("date") < today, F.col("date")))
    out = dates.groupBy("ticker").agg(future.alias("_next"), past.alias("_past"))
    return out.select(
        "ticker",
        F.coalesce("_next", "_past").alias("next_earnings_date"),
        (F.col("_next").isNull() & F.col("_past").isNotNull()).alias("is_estimate"),
        F.datediff(F.coalesce("_next", "_past"), today).alias("days_to_earnings"),
    )


def earnings_events(reports: DataFrame, days_ahead: int) -> DataFrame:
    suffix = F.when(F.col("is_estimate"), " (est.)").otherwise("")
    return reports.where(F.col("days_to_earnings").between(0, days_ahead)).select(
        F.col("next_earnings_date").alias("date"),
        F.lit("earnings").alias("kind"),
        F.concat("ticker", F.lit(" earnings report"), suffix).alias("title"),
        F.lit("high").alias("impact"),
        F.lit("ticker").alias("scope"),
        "ticker",
        F.lit("earnings dates").alias("source"),
        F.col("days_to_earnings").alias("days_away"),
    )


def event_points(impact: Column, days: Column, scope: Column) -> Column:
    days = F.coalesce(days, F.lit(99))
    base = F.when(F.lower(impact) == "high", 30).when(F.lower(impact) == "medium", 16).otherwise(7)
    near = F.when(days <= 0, 18).when(days <= 1, 14).when(days <= 3, 8).when(days <= 5, 4).otherwise(0)
    own = F.when(scope == "ticker", 8).otherwise(0)
    return F.least(base + near + own, F.lit(55))


def expand_by_day(events: DataFrame, horizons: list[int]) -> DataFrame:
    """Market events keyed by the day and horizon from which they are visible.

    Turns "0 <= days <= horizon" into an equality on (as_of, horizon_days): an event
    is repeated once per day of the horizon, a fixed number.  The per-day table is
    aggregated before any call is joined, so calls never meet events pairwise.
    """
    table = F.array(*[F.lit(h) for h in sorted(set(horizons))])
    df = events.withColumn("horizon_days", F.explode(table))
    return df.withColumn("days_away", F.explode(F.sequence(F.lit(0), F.col("horizon_days")))).withColumn(
        "as_of", F.date_sub("date", F.col("days_away"))
    )


def market_load(events: DataFrame, horizons: list[int]) -> DataFrame:
    """Per (as_of, horizon): points, counts and lead event of the market calendar."""
    seen = expand_by_day(events, horizons)
    lead = F.struct("days_away", F.when(F.col("impact") == "high", 0).otherwise(1).alias("o"), "title")
    return seen.groupBy("as_of", "horizon_days").agg(
        F.sum(event_points(F.col("impact"), F.col("days_away"), F.col("scope"))).alias("market_points"),
        F.count(F.lit(1)).alias("market_events"),
        F.sum((F.col("impact") == "high").cast("int")).alias("market_high"),
        F.min(lead).alias("lead"),
    )


def risk_level(score: Column) -> Column:
    return (
        F.when(score >= 75, "extreme")
        .when(score >= 55, "high")
        .when(score >= 30, "medium")
        .when(score > 0, "low")
        .otherwise("quiet")
    )


def add_event_risk(calls: DataFrame, load: DataFrame) -> DataFrame:
    """Scheduled-event risk of each call.

    Joins the per-day market load on (as_of, horizon_days) and adds the call's own
    earnings date when `days_to_earnings` lies inside the horizon.  The load has one
    row per calendar day and horizon (about 370 a year and horizon), so it is
    broadcast and the calls are not shuffled.
    """
    df = calls.join(load, ["as_of", "horizon_days"], "left")
    own = F.coalesce(F.col("days_to_earnings").between(0, F.col("horizon_days")), F.lit(False))
    own_points = F.when(own, event_points(F.lit("high"), F.col("days_to_earnings"), F.lit("ticker"))).otherwise(0)
    zero = F.lit(0)
    df = (
        df.withColumn("event_count", F.coalesce("market_events", zero) + own.cast("int"))
        .withColumn("high_impact_count", F.coalesce("market_high", zero) + own.cast("int"))
        .withColumn("_points", F.coalesce("market_points", zero) + own_points)
    )
    extra = F.greatest(zero, F.col("high_impact_count") - 1) * 8
    df = df.withColumn("event_risk_score", F.least(F.lit(100.0), rnd_stable(F.col("_points") * 0.75 + extra, 1)))
    df = df.withColumn("event_level", risk_level(F.col("event_risk_score")))
    level, quiet = F.col("event_level"), F.col("event_count") == 0
    big = level.isin("high", "extreme")
    lead_is_own = own & (F.col("lead").isNull() | (F.col("days_to_earnings") < F.col("lead.days_away")))
    return (
        df.withColumn(
            "event_bias",
            F.when(quiet, "quiet_calendar").when(big, "binary_event_risk").otherwise("event_watch"),
        )
        .withColumn(
            "event_action",
            F.when(big, "prefer_defined_risk_options_or_wait")
            .when(level == "medium", "keep_smaller_size_and_confirm_after_release")
            .otherwise("normal_process"),
        )
        .withColumn(
            "lead_event",
            F.when(lead_is_own, F.concat("ticker", F.lit(" earnings report"))).otherwise(F.col("lead.title")),
        )
        .withColumn("event_effect", direction_effect(F.col("direction"), big))
        .drop("_points", "lead", "market_points", "market_events", "market_high")
    )


def direction_effect(direction: Column, big: Column) -> Column:
    side = F.when(bullish(direction), "long").when(bearish(direction), "short").otherwise("none")
    return F.concat_ws("_", side, F.when(big, "event_sensitive").otherwise("calendar_not_dominant"))
