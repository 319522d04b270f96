"""Weight profiles, assets and theme baskets as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WEIGHT_KEYS = (
    "technical_structure", "price_volume_momentum", "fundamentals", "options_intelligence", "macro_regime",
    "news_events", "sentiment", "cross_market_correlation", "ensemble_forecast", "risk_penalty_adjustment",
)
# fixed values: component weights per strategy profile, in the order of WEIGHT_KEYS
DEFAULT_WEIGHTS = (14, 14, 14, 13, 10, 9, 9, 5, 8, 5)
PROFILE_WEIGHTS = {
    "intraday": (23, 27, 2, 16, 5, 9, 5, 3, 8, 2),
    "swing": (18, 16, 13, 13, 10, 9, 6, 4, 7, 4),
    "earnings": (9, 9, 21, 23, 6, 13, 6, 4, 5, 4),
    "long_term": (7, 6, 36, 5, 17, 10, 4, 6, 5, 4),
    "options_buying": (16, 16, 6, 28, 6, 9, 6, 3, 7, 3),
    "options_selling": (11, 9, 10, 32, 8, 8, 4, 4, 4, 10),
    "index_trend": (20, 18, 4, 9, 20, 8, 4, 8, 7, 2),
}
# fixed values: forward horizon in days per profile
PROFILE_HORIZON_DAYS = {
    "intraday": 1, "swing": 5, "options_buying": 5, "options_selling": 5, "earnings": 5, "index_trend": 20, "long_term": 20,
}
ASSET_TYPES = ("equity", "etf", "index", "option")


def default_weights(spark: SparkSession) -> DataFrame:
    rows = list(zip(WEIGHT_KEYS, map(float, DEFAULT_WEIGHTS)))
    return spark.createDataFrame(rows, "component string, weight double")


def profile_weights(spark: SparkSession) -> DataFrame:
    rows = [(p, k, float(w)) for p, ws in PROFILE_WEIGHTS.items() for k, w in zip(WEIGHT_KEYS, ws)]
    return spark.createDataFrame(rows, "profile string, component string, weight double")


def resolve_weights(profiles: DataFrame, default: DataFrame, own: DataFrame, fitted: DataFrame | None = None) -> DataFrame:
    """Weights per profile, normalised to sum to 1.

    A fitted profile replaces the hand-set one as a whole; otherwise the profile's
    own values overlay the defaults.  `profiles` lists the names to resolve.
    """
    names = profiles.select("profile").distinct()
    keys = F.array(*[F.lit(k) for k in WEIGHT_KEYS])
    filled = names.select("profile", F.explode(keys).alias("component")).join(
        default.select("component", F.col("weight").alias("w_default")), "component", "left"
    )
    mine = own.select("profile", "component", F.col("weight").alias("w_own")).join(names, "profile", "left_semi")
    hand = filled.join(mine, ["profile", "component"], "left").select(
        "profile", "component", F.coalesce("w_own", "w_default").alias("weight")
    )
    hand = hand.where(F.col("weight").isNotNull())
    if fitted is not None:
        has_fit = fitted.select("profile").distinct()
        fit = fitted.select("profile", "component", "weight").join(names, "profile", "left_semi")
        hand = hand.join(has_fit, "profile", "left_anti").unionByName(fit)
    total = F.sum("weight").over(Window.partitionBy("profile"))
    share = F.try_divide(F.col("weight"), F.when(total == 0, F.lit(1.0)).otherwise(total))
    return hand.withColumn("weight", share)


def load_assets(rows: DataFrame) -> DataFrame:
    """Clean asset list: trimmed upper-case tickers, first row of each, known types."""
    known = F.coalesce(F.col("asset_type").isin(*ASSET_TYPES), F.lit(False))
    clean = rows.withColumn("ticker", F.upper(F.trim("ticker"))).withColumn(
        "asset_type", F.when(known, F.col("asset_type")).otherwise("equity")
    )
    rest = [c for c in rows.columns if c not in ("ticker", "position")]
    clean = clean.where(F.coalesce(F.col("ticker"), F.lit("")) != "")
    return clean.groupBy("ticker").agg(F.min(F.struct("position", *rest)).alias("_a")).select("ticker", "_a.*")


def theme_rows(baskets: DataFrame, live: DataFrame) -> DataFrame:
    """Members of each theme basket with their live verdict, if they were scored."""
    members = baskets.select("theme", "bucket", F.explode("tickers").alias("ticker"))
    joined = members.withColumn("ticker", F.upper("ticker")).join(
        live.select("ticker", "final_label", "confidence"), "ticker", "left"
    )
    return joined.withColumn("status", F.coalesce("final_label", F.lit("not_scored")))
