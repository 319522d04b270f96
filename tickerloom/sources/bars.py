"""Daily bars: reading, cleaning, provider fallback, trimming, scaling."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OHLCV = ("open", "high", "low", "close", "volume")
MIN_BARS = 30

# fixed values: market symbol and price scale of each index-option ticker
INDEX_ALIASES = {
    "SPX": "^GSPC", "XSP": "^GSPC", "NDX": "^NDX", "XND": "^NDX", "RUT": "^RUT", "VIX": "^VIX", "DJX": "^DJI", "OEX": "^OEX",
}
INDEX_SCALE = {"XSP": 0.1, "XND": 0.01, "DJX": 0.01}


def normalise(raw: DataFrame) -> DataFrame:
    """Lower-case names, the five price columns as doubles, rows without gaps.

    Raises when a price column is missing.  NaN counts as missing.  Rows are not
    sorted: order belongs to the windows that need it.
    """
    df = raw.toDF(*[c.lower() for c in raw.columns])
    missing = [c for c in OHLCV if c not in df.columns]
    if missing:
        raise ValueError(f"missing OHLCV columns: {missing}")
    keys = [c for c in df.columns if c not in OHLCV]
    clean = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in OHLCV]
    return df.select(*keys, *clean).na.drop(subset=list(OHLCV))


def read_bars(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Bars from files.  CSV is read as text columns and cast while cleaning."""
    reader = spark.read.options(**({"header": "true", **options} if fmt == "csv" else options))
    df = normalise(reader.format(fmt).load(path))
    return df.withColumn("date", F.to_date("date"))


def unique_days(bars: DataFrame) -> DataFrame:
    """One bar per (ticker, date): the last one in `position` order wins."""
    rest = [c for c in bars.columns if c not in ("ticker", "date", "position")]
    return bars.groupBy("ticker", "date").agg(F.max(F.struct("position", *rest)).alias("_b")).select(
        "ticker", "date", *[f"_b.{c}" for c in rest]
    )


def provider_counts(bars: DataFrame, priority: dict[str, int]) -> DataFrame:
    """Bars per (ticker, provider) with the provider's place in the chain."""
    place = F.lit(None).cast("int")
    for name, p in priority.items():
        place = F.when(F.col("provider") == name, p).otherwise(place)
    counts = bars.groupBy("ticker", "provider").agg(F.count(F.lit(1)).alias("bar_count"))
    return counts.withColumn("priority", place).where(F.col("priority").isNotNull())


def choose_provider(counts: DataFrame, min_bars: int = MIN_BARS) -> DataFrame:
    """First provider in the chain with enough bars, per ticker."""
    good = counts.where(F.col("bar_count") >= min_bars)
    return good.groupBy("ticker").agg(F.min_by("provider", "priority").alias("provider"))


def with_fallback(bars: DataFrame, priority: dict[str, int], min_bars: int = MIN_BARS) -> DataFrame:
    """Bars of each ticker's first usable provider.

    The choice is made on counts, so the bars are filtered by a join on
    (ticker, provider) instead of a window over whole histories.
    """
    chosen = choose_provider(provider_counts(bars, priority), min_bars)
    return bars.join(chosen, ["ticker", "provider"], "left_semi")


def provider_status(tickers: DataFrame, bars: DataFrame, priority: dict[str, int], min_bars: int = MIN_BARS) -> DataFrame:
    """Status of each provider tried for a ticker, up to the one that won."""
    counts = provider_counts(bars, priority)
    tried = tickers.select("ticker").distinct().select(
        "ticker",
        F.explode(F.array(*[F.struct(F.lit(n).alias("provider"), F.lit(p).alias("priority")) for n, p in priority.items()])).alias("t"),
    )
    tried = tried.select("ticker", "t.provider", "t.priority")
    df = tried.join(counts.drop("priority"), ["ticker", "provider"], "left")
    rows = F.coalesce("bar_count", F.lit(0))
    status = F.when(rows >= min_bars, "ok").when(rows > 0, "insufficient_rows").otherwise("missing")
    won = F.min(F.when(rows >= min_bars, F.col("priority"))).over(Window.partitionBy("ticker"))
    df = df.withColumn("bar_count", rows).withColumn("status", status).withColumn("_won", won)
    return df.where(F.col("_won").isNull() | (F.col("priority") <= F.col("_won"))).drop("_won")


def period_days(period: str) -> int:
    """Days of a period in the day form: 365 a year, 31 a month."""
    found = re.fullmatch(r"(\d+)(y|mo|d)", period)
    if not found:
        return 365
    return int(found[1]) * {"y": 365, "mo": 31, "d": 1}[found[2]]


def trim(bars: DataFrame, period: str, today: Column, calendar: bool = True) -> DataFrame:
    """Bars since the period's start: calendar months and years, or the day form."""
    found = re.fullmatch(r"(\d+)(y|mo)", period)
    if calendar and found:
        start = F.add_months(today, -int(found[1]) * (12 if found[2] == "y" else 1))
    else:
        start = F.date_sub(today, period_days(period))
    return bars.where(F.col("date") >= start)


def scale_indexes(bars: DataFrame, aliases: DataFrame) -> DataFrame:
    """Parent-index bars quoted at the level of each ticker that follows them.

    `aliases` is (ticker, symbol, scale), one row per listed index product.
    """
    df = bars.join(aliases, "symbol")
    scaled = [(F.col(c) * F.col("scale")).alias(c) for c in ("open", "high", "low", "close")]
    return df.select("ticker", "symbol", "date", *scaled, "volume")


def alias_table(spark: SparkSession) -> DataFrame:
    rows = [(t, s, float(INDEX_SCALE.get(t, 1.0))) for t, s in INDEX_ALIASES.items()]
    return spark.createDataFrame(rows, "ticker string, symbol string, scale double")
