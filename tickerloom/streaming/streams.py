"""Structured Streaming forms of the stateful rules.

Transformations take and return streaming (or plain) DataFrames; `run_to_table`
drives one through all available input into a checkpointed Parquet table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import rnd_stable
from ..operators.ledger import NOTIONAL, PAPER_SCHEMA, alert_key, pnl_pct
from ..operators.outcomes import side
from ..operators.text import evidence_id, recent_strict


def read_files(spark: SparkSession, folder: str, schema, pattern: str, fmt: str = "parquet", per_trigger: int | None = None) -> DataFrame:
    """File stream over the files of a folder that match a pattern."""
    reader = spark.readStream.schema(schema).format(fmt).option("pathGlobFilter", pattern)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.load(folder)


def unique_alerts(signals: DataFrame, delay: str = "1 day") -> DataFrame:
    """Severe signals, one per day, ticker, direction and severity.

    The day is part of the key, so a key cannot recur after its day is over and the
    state of a key may be dropped once the watermark has passed it.
    """
    df = signals.where(F.col("severity").isin("P0", "P1") & ~F.coalesce(F.col("block_trade"), F.lit(False)))
    df = df.withColumn("alert_key", alert_key(F.col("ts")))
    return df.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["alert_key"])


def recent_news(items: DataFrame, ingested_at: Column, hours: int = 24) -> DataFrame:
    """Items with a timestamp no older than the limit when they arrive."""
    return items.where(recent_strict(F.col("published_at"), ingested_at, hours))


def unique_evidence(claims: DataFrame, delay: str = "7 days") -> DataFrame:
    """Evidence rows, the first of each content key; `ts` is the arrival time.

    The batch form keeps the last write; a stream cannot take back what it emitted.
    """
    key = evidence_id(F.col("entity"), F.col("source_name"), F.col("claim"), F.col("url"))
    return claims.withColumn("evidence_id", key).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["evidence_id"])


def latest_per_window(feed: DataFrame, length: str = "15 minutes", delay: str = "15 minutes") -> DataFrame:
    """Newest feed row per ticker and window (partial maxima combine map-side)."""
    rest = [c for c in feed.columns if c not in ("ticker", "ts")]
    newest = F.max(F.struct("ts", *rest)).alias("_m")
    df = feed.withWatermark("ts", delay).groupBy(F.window("ts", length), "ticker").agg(newest)
    return df.select(F.col("window.start").alias("window_start"), "ticker", "_m.*")


def with_day(df: DataFrame, stamp: str = "as_of") -> DataFrame:
    return df.withColumn("as_of_date", F.to_date(stamp))


def run_to_table(df: DataFrame, path: str, partition: str | None = None) -> DataFrame:
    """Append everything available to a Parquet table and return the table.

    The checkpoint sits next to the table, so a restarted job goes on where the
    committed batches end.
    """
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/_checkpoint")
    if partition:
        writer = writer.partitionBy(partition)
    query = writer.option("path", f"{path}/table").trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/table")


def fold_signals(batch: DataFrame) -> DataFrame:
    """One row per ticker: the first signal that may open, and the last price.

    Marks in between are overwritten anyway, so a ticker with many signals costs one
    row per task before the shuffle.
    """
    price = F.nullif(F.col("current_price"), F.lit(0.0))
    may_open = price.isNotNull() & (side(F.col("direction")) != "neutral") & ~F.coalesce(F.col("block_trade"), F.lit(False))
    row = F.struct("ts", price.alias("price"), "direction")
    return batch.groupBy("ticker").agg(
        F.min(F.when(may_open, row)).alias("first_open"), F.max(F.when(price.isNotNull(), row)).alias("last_mark")
    )


def apply_folded(ledger: DataFrame, folded: DataFrame, notional: float = NOTIONAL) -> DataFrame:
    """Ledger after the folded signals of one batch."""
    df = ledger.join(folded, "ticker", "full_outer")
    opens = F.col("entry_price").isNull() & F.col("first_open").isNotNull()
    first, mark = F.col("first_open"), F.col("last_mark")
    qty = rnd_stable(F.try_divide(F.lit(notional), first["price"]), 6)
    fresh = {
        "side": side(first["direction"]),
        "entry_price": first["price"],
        "quantity": qty,
        "notional": rnd_stable(qty * first["price"], 2),
        "opened_at": first["ts"],
        "entry_direction": first["direction"],
    }
    df = df.withColumn("_opens", opens)
    df = df.withColumns({c: F.when(F.col("_opens"), v).otherwise(F.col(c)) for c, v in fresh.items()})
    df = df.where(F.col("entry_price").isNotNull())
    marked = mark.isNotNull()
    pct = pnl_pct(F.col("entry_price"), mark["price"], F.col("side"))
    values = {
        "last_price": mark["price"],
        "last_marked_at": mark["ts"],
        "unrealized_pnl_pct": rnd_stable(pct, 2),
        "unrealized_pnl_dollars": rnd_stable(F.col("notional") * pct / 100, 2),
        "latest_direction": mark["direction"],
    }
    df = df.withColumns({c: F.when(marked, v).otherwise(F.col(c)) for c, v in values.items()})
    names = [part.split()[0] for part in PAPER_SCHEMA.split(", ")]
    return df.select(*names)


def run_paper_ledger(signals: DataFrame, path: str) -> DataFrame:
    """Keep the paper ledger over a stream of signals; returns the final ledger.

    Every batch writes a new version of the ledger from the version before it.  The
    version is the batch number, so a replayed batch overwrites its own version and
    never counts twice.
    """
    spark = signals.sparkSession

    def step(batch: DataFrame, epoch: int) -> None:
        session = batch.sparkSession
        if epoch == 0:
            before = session.createDataFrame([], PAPER_SCHEMA)
        else:
            before = session.read.schema(PAPER_SCHEMA).parquet(f"{path}/version={epoch - 1}")
        apply_folded(before, fold_signals(batch)).write.mode("overwrite").parquet(f"{path}/version={epoch}")

    query = (
        signals.writeStream.foreachBatch(step)
        .option("checkpointLocation", f"{path}/_checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    # the version is a partition value, so finding the newest reads no ledger rows
    versions = spark.read.option("basePath", path).schema(PAPER_SCHEMA + ", version long").parquet(f"{path}/version=*")
    newest = versions.agg(F.max("version")).first()[0]
    return spark.read.schema(PAPER_SCHEMA).parquet(f"{path}/version={newest}")
