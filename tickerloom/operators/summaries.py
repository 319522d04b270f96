"""Coverage summaries and report listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import bearish, bullish, rnd


def top_movers(quotes: DataFrame, n: int = 5) -> DataFrame:
    """Largest absolute day changes (rounded to two decimals)."""
    df = quotes.where(F.col("day_change_pct").isNotNull()).withColumn("day_change_pct", rnd(F.col("day_change_pct"), 2))
    return df.select("ticker", "day_change_pct").orderBy(F.desc(F.abs("day_change_pct")), "ticker").limit(n)


def feed_totals(items: DataFrame, by: str = "ticker") -> DataFrame:
    """Items, distinct keys, distinct providers and the newest timestamp of a feed."""
    return items.agg(
        F.count(F.lit(1)).alias("total_items"),
        F.count_distinct(by).alias("keys"),
        F.count_distinct("provider").alias("providers"),
        F.max("published_at").alias("latest_published"),
    )


def busiest(items: DataFrame, by: str = "ticker", n: int = 5) -> DataFrame:
    return items.groupBy(by).agg(F.count(F.lit(1)).alias("items")).orderBy(F.desc("items"), by).limit(n)


def by_source(items: DataFrame, source: str = "provider") -> DataFrame:
    return items.groupBy(source).agg(F.count(F.lit(1)).alias("items"), F.max("published_at").alias("latest_published"))


def strongest_mood(social: DataFrame, n: int = 10) -> DataFrame:
    return social.orderBy(F.desc(F.abs("net_sentiment")), "ticker").limit(n)


def filing_coverage(filings: DataFrame, n: int = 8) -> DataFrame:
    """Companies with the most kept filings."""
    out = filings.groupBy("cik").agg(F.count(F.lit(1)).alias("filing_count"), F.max("filed").alias("latest_filed"))
    return out.orderBy(F.desc("filing_count"), "cik").limit(n)


def chain_coverage(expiries: DataFrame) -> DataFrame:
    """Expiries and open interest available per ticker."""
    return expiries.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("expiration_count"), F.min("dte").alias("nearest_dte"), F.sum("total_oi").alias("total_oi")
    )


def registry_rows(registry: DataFrame) -> DataFrame:
    """Flat registry: one row per source of each group, best reliability first.

    `registry` is (group, sources map<name, struct<status, reliability_rank>>).
    """
    flat = registry.select("group", F.explode("sources").alias("source", "meta"))
    flat = flat.select("group", "source", F.coalesce("meta.status", F.lit("unknown")).alias("status"), "meta.reliability_rank")
    return flat.orderBy(F.desc(F.coalesce("reliability_rank", F.lit(0))), "group", "source")


def registry_status(flat: DataFrame) -> DataFrame:
    return flat.groupBy("status").agg(F.count(F.lit(1)).alias("sources"))


def top_ideas(signals: DataFrame, threshold: float = 65, n: int = 5) -> DataFrame:
    """Bullish, confident, low-risk names by opportunity."""
    ok = bullish(F.col("direction")) & (F.col("confidence") >= threshold) & F.col("risk_level").isin("low", "medium")
    return signals.where(ok).orderBy(F.desc("opportunity_score"), "ticker").limit(n)


def portfolio_review(holdings: DataFrame, signals: DataFrame, threshold: float = 65) -> DataFrame:
    """Stance on each holding from the latest signals."""
    live = signals.select("ticker", "direction", "confidence", "opportunity_score")
    df = holdings.withColumn("ticker", F.upper("ticker")).join(live, "ticker", "left")
    d = F.col("direction")
    stance = (
        F.when(d.isNull(), "no_current_signal")
        .when(bearish(d) | (d == "avoid"), "consider_trimming")
        .when(bullish(d) & (F.col("confidence") >= threshold), "supported")
        .otherwise("hold_or_watch")
    )
    return df.withColumn("stance", stance)


def index_listing(quotes: DataFrame, regions: DataFrame) -> DataFrame:
    """Levels and day changes per region, in name order.

    A region lists its indexes, so the collected list is as long as the index table's
    share of that region.
    """
    df = quotes.join(regions, "index_name").select(
        "region",
        F.struct(
            "index_name", rnd(F.col("current_price"), 2).alias("last"), rnd(F.col("day_change_pct"), 2).alias("day_change_pct")
        ).alias("entry"),
    )
    return df.groupBy("region").agg(F.array_sort(F.collect_list("entry")).alias("entries"), F.count(F.lit(1)).alias("indexes"))


def summary(signals: DataFrame, n: int = 5) -> DataFrame:
    return signals.orderBy(F.desc("opportunity_score"), "ticker").limit(n)

