"""Market tables derived from the given Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.series import with_positions

BARS_COLUMNS = ["ticker", "date", "open", "high", "low", "close", "volume"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _walk(moves: DataFrame, key: str) -> DataFrame:
    """Prices from integer micro-returns; sums are exact in any order."""
    priced = with_positions(moves, key=key, sums={"level": F.col("ret_micro")})

    def price(total: Column) -> Column:
        return F.round(100 * F.exp(total.cast("double") / F.lit(1000000.0)), 4)

    close = price(F.col("level"))
    open_ = price(F.col("level") - F.col("ret_micro"))
    return priced.select(
        key,
        "date",
        open_.alias("open"),
        (F.greatest(open_, close) * (1 + F.col("wick"))).alias("high"),
        (F.least(open_, close) * (1 - F.col("wick"))).alias("low"),
        close.alias("close"),
        "volume",
        "pos",
        "n",
    )


def _moves(lines: DataFrame, key: str) -> DataFrame:
    count = F.count(F.lit(1))
    discount = F.sum(F.round(F.col("l_discount") * 100).cast("long"))
    tax = F.sum(F.round(F.col("l_tax") * 100).cast("long"))
    return lines.groupBy(key, F.to_date("l_shipdate").alias("date")).agg(
        (F.floor((6000 * discount).cast("double") / count).cast("long") - 30000).alias("ret_micro"),
        (tax.cast("double") / (1000 * count).cast("double")).alias("wick"),
        (F.sum("l_quantity") * 100000).alias("volume"),
    )


def numbered_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per ticker with `pos` and `n`."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_shipdate", "l_discount", "l_tax", "l_quantity"
    )
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("ticker")
    )
    return _walk(_moves(lines.join(part, "l_partkey"), "ticker"), "ticker")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered_bars(spark, sf_dir).select(*BARS_COLUMNS)


def numbered_index_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars per region index (supplier's region), with `pos` and `n`."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_shipdate", "l_discount", "l_tax", "l_quantity"
    )
    places = (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("s_suppkey").alias("l_suppkey"), F.col("r_name").alias("index_name"))
    )
    return _walk(_moves(lines.join(places, "l_suppkey"), "index_name"), "index_name")


def numbered_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of the whole market, with `pos` and `n`."""
    lines = table(spark, sf_dir, "lineitem").select("l_shipdate", "l_discount", "l_tax", "l_quantity")
    return _walk(_moves(lines.withColumn("symbol", F.lit("MARKET")), "symbol"), "symbol")


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per option contract."""
    traded = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_partkey")
        .agg(F.sum("l_quantity").alias("volume"), (F.count(F.lit(1)) * 40).alias("oi"))
    )
    key = F.col("p_partkey")
    price = 1.5 + (key % 17) * 0.25
    return (
        table(spark, sf_dir, "part")
        .join(traded, key == F.col("l_partkey"))
        .select(
            F.col("p_brand").alias("ticker"),
            (7 * (1 + F.col("p_size") % 8)).alias("dte"),
            F.when(key % 2 == 0, "C").otherwise("P").alias("right"),
            key.alias("contract_id"),
            (80.0 + key % 41).alias("strike"),
            F.round(price, 2).alias("last"),
            F.round(price * 0.97, 4).alias("bid"),
            F.round(price * (1.01 + (key % 5) * 0.04), 4).alias("ask"),
            "volume",
            "oi",
            (0.15 + (key % 37) * 0.02).alias("iv"),
            F.lit(100.0).alias("spot"),
        )
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Past calls: one row per order."""
    order = F.col("o_orderkey")
    priority = F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").select(
        order.alias("prediction_id"),
        F.to_date("o_orderdate").alias("as_of"),
        F.concat(F.lit("Brand#"), (1 + F.col("o_custkey") % 25).cast("string")).alias("ticker"),
        F.when(priority == "1-URGENT", "bullish")
        .when(priority == "2-HIGH", "neutral_to_bullish")
        .when(priority == "3-MEDIUM", "neutral")
        .when(priority == "4-NOT SPECIFIED", "neutral_to_bearish")
        .otherwise("bearish")
        .alias("direction"),
        F.when(order % 3 == 0, "1D").when(order % 3 == 1, "5D").otherwise("20D").alias("horizon"),
        ((order * 37) % 101).cast("double").alias("confidence_score"),
        (60 + order % 81).cast("double").alias("entry_price"),
    )


def iv_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("ticker"),
        F.col("event_id").alias("seq"),
        F.col("ts").alias("as_of"),
        F.when(F.col("event_id") % 3 == 0, F.lit("2024-03-15")).otherwise(F.lit("2024-02-16")).alias("expiration"),
        F.round(20 + F.col("value") / 10, 4).alias("avg_iv"),
    )


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    stamp = F.lit("2024-01-31 00:00:00").cast("timestamp") - F.make_dt_interval(hours=(doc % 72).cast("int"))
    return table(spark, sf_dir, "documents").select(
        doc.alias("news_id"),
        F.col("text").alias("title"),
        F.col("source").alias("provider"),
        F.concat(F.lit("Brand#"), (1 + doc % 25).cast("string")).alias("ticker"),
        F.when(doc % 11 == 0, F.lit(None)).otherwise(stamp).alias("published_at"),
    )


# fixed values: component names with the multiplier their test scores come from
COMPONENT_MULTIPLIERS = {
    "technical_structure": 3,
    "price_volume_momentum": 5,
    "fundamentals": 11,
    "options_intelligence": 17,
    "macro_regime": 19,
    "sentiment": 23,
    "cross_market_correlation": 29,
    "ensemble_forecast": 31,
}


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component scores in long form, one ticker per customer."""
    key = F.col("c_custkey")
    rows = [
        F.struct(
            F.lit(name).alias("name"),
            ((key * m + 13) % 101).cast("double").alias("score"),
            ((key + m) % 7 != 0).alias("available"),
        )
        for name, m in COMPONENT_MULTIPLIERS.items()
    ]
    return table(spark, sf_dir, "customer").select(key.alias("ticker"), F.inline(F.array(*rows)))


def macro_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly readings per series as text; "." marks a missing value."""
    orders = table(spark, sf_dir, "orders").select("o_orderdate", "o_totalprice", "o_orderpriority", "o_orderstatus")
    by_priority = {
        "1-URGENT": ("vix", 10.0, 35.0),
        "2-HIGH": ("yield_curve_10y_2y", -1.0, 2.0),
        "3-MEDIUM": ("treasury_10y", 3.0, 6.0),
        "4-NOT SPECIFIED": ("unemployment", 3.0, 7.0),
        "5-LOW": ("fed_funds", 2.0, 7.0),
    }
    by_status = {"F": ("wti_oil", 55.0, 100.0), "O": ("dollar_index", 98.0, 112.0), "P": ("treasury_5y", 2.5, 5.5)}

    def readings(column: str, specs: dict, source: str) -> DataFrame:
        spec = F.lit(None).cast("struct<series:string,lo:double,hi:double>")
        for key, (name, lo, hi) in specs.items():
            row = F.struct(F.lit(name).alias("series"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
            spec = F.when(F.col("_key") == key, row).otherwise(spec)
        cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("long"))
        month = F.to_date(F.date_trunc("month", "o_orderdate"))
        out = orders.groupBy(F.col(column).alias("_key"), month.alias("date")).agg((cents % 10007).alias("_h"))
        out = out.withColumn("_s", spec)
        value = F.round(F.col("_s.lo") + (F.col("_s.hi") - F.col("_s.lo")) * F.col("_h") / 10007, 4)
        text = F.when(F.col("_h") % 13 == 0, ".").otherwise(value.cast("string"))
        return out.select(F.lit(source).alias("source"), "_s.series", "date", text.alias("value"))

    return readings("o_orderpriority", by_priority, "official").unionByName(
        readings("o_orderstatus", by_status, "keyless")
    )


EVENT_KINDS = ("policy", "trump_admin", "fda", "antitrust", "fiscal")
ASSET_TAGS = ("semiconductors", "ai", "cloud", "energy", "pharma")


def gov_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policy events: one per document, titled with its text."""
    doc = F.col("doc_id")
    kinds = F.array(*[F.lit(k) for k in EVENT_KINDS])
    return table(spark, sf_dir, "documents").select(
        F.col("text").alias("title"),
        "source",
        F.element_at(kinds, (doc % 5 + 1).cast("int")).alias("kind"),
        (F.lit("2024-01-31 00:00:00").cast("timestamp") - F.make_dt_interval(hours=(doc % 97).cast("int"))).alias(
            "published_at"
        ),
        doc.alias("position"),
    )


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies named after benchmark prose, tagged by item."""
    item = F.col("item_id")
    tags = F.array(*[F.lit(t) for t in ASSET_TAGS])
    return table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("Brand#"), (1 + item % 25).cast("string"), F.lit("."), item.cast("string")).alias("ticker"),
        F.col("text").alias("company_name"),
        F.array(
            F.element_at(tags, (item % 5 + 1).cast("int")), F.element_at(tags, ((item + 2) % 5 + 1).cast("int"))
        ).alias("strategy_tags"),
        F.lit(None).cast("string").alias("sector"),
        F.lit(None).cast("string").alias("industry"),
        item.alias("item_id"),
    )
