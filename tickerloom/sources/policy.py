"""Policy and government feeds brought to one event table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import event_kind

EVENT = ["title", "source", "kind", "url", "published_at", "provider"]


def recall_title(classification: Column, firm: Column, reason: Column) -> Column:
    """'<class> recall — <firm>: <reason>' with the reason cut to 120 characters."""
    text = F.concat(
        F.coalesce(classification, F.lit("")), F.lit(" recall — "), F.coalesce(firm, F.lit("")), F.lit(": "),
        F.substring(F.coalesce(reason, F.lit("")), 1, 120),
    )
    return F.regexp_replace(text, "^[ —:]+|[ —:]+$", "")


def recall_events(recalls: DataFrame) -> DataFrame:
    """Recall records; the report date is compact text (yyyyMMdd)."""
    day = F.when(F.length("report_date") == 8, F.try_to_timestamp("report_date", F.lit("yyyyMMdd")))
    return recalls.select(
        recall_title(F.col("classification"), F.col("firm"), F.col("reason")).alias("title"),
        F.concat(F.lit("FDA "), F.initcap("product"), F.lit(" Recall")).alias("source"),
        F.lit("fda").alias("kind"),
        F.lit("https://www.fda.gov/safety/recalls-market-withdrawals-safety-alerts").alias("url"),
        day.alias("published_at"),
        F.lit("openfda").alias("provider"),
    )


def agency_events(actions: DataFrame) -> DataFrame:
    """Agency actions, titled with the agency."""
    return actions.select(
        F.concat_ws(": ", "agency", "title").alias("title"),
        F.col("agency").alias("source"),
        F.lit("antitrust").alias("kind"),
        "url",
        F.col("published_at").cast("timestamp").alias("published_at"),
        F.lit("doj_ftc").alias("provider"),
    )


def titled_events(feed: DataFrame, provider: str, kind: str | None = None) -> DataFrame:
    """A plain title feed; without a fixed kind the title decides it."""
    return feed.select(
        "title",
        "source",
        (F.lit(kind) if kind else event_kind(F.col("title"))).alias("kind"),
        "url",
        F.col("published_at").cast("timestamp").alias("published_at"),
        F.lit(provider).alias("provider"),
    )


def union_events(*feeds: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [f.select(*EVENT) for f in feeds])


def feed_values(readings: DataFrame) -> DataFrame:
    """Value feeds as one map (one entry per series of the feeds)."""
    newest = readings.groupBy("series").agg(F.max_by("value", "date").alias("value"))
    entries = F.array_sort(F.collect_list(F.struct("series", "value")))
    return newest.agg(F.map_from_entries(entries).alias("values"), F.count(F.lit(1)).alias("value_count"))


def snapshot_providers(events: DataFrame, value_providers: DataFrame) -> DataFrame:
    """Providers that returned an event or a value, each once."""
    return events.select("provider").union(value_providers.select("provider")).distinct()
