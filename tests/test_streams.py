"""Streams over split input against the batch result."""

import pytest
from pyspark.sql import functions as F

from tickerloom.operators import ledger
from tickerloom.streaming import streams as st

SCHEMA = "ticker string, ts timestamp, direction string, severity string, block_trade boolean, current_price double"


def rows():
    out = []
    sides = ["neutral", "bullish", "bearish", "neutral_to_bearish"]
    for i in range(400):
        # one ticker carries a third of all rows
        ticker = "HOT" if i % 3 == 0 else f"T{i % 7}"
        day, hour = 1 + i // 100, (i // 5) % 20
        price = None if i % 11 == 0 else 50.0 + (i * 37) % 60
        out.append((ticker, f"2024-01-0{day} {hour:02d}:{i % 60:02d}:{i % 50:02d}", sides[(i + i // 9) % 4], f"P{i % 3}", i % 13 == 0, price))
    return out


@pytest.fixture(scope="module")
def signals(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("signals")
    data = sorted(rows(), key=lambda r: r[1])
    for part in range(4):
        df = spark.createDataFrame(data[part * 100 : part * 100 + 100], SCHEMA.replace("ts timestamp", "ts string"))
        df.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{folder}/p{part}")
    files = f"{folder}/p*"
    return files, spark.read.schema(SCHEMA).parquet(files)


def stream(spark, files):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(files)


def test_alerts_are_unique_over_batches(spark, signals, tmp_path):
    files, batch = signals
    got = st.run_to_table(st.unique_alerts(stream(spark, files)), str(tmp_path))
    keys = [r.alert_key for r in got.select("alert_key").collect()]
    severe = batch.where(F.col("severity").isin("P0", "P1") & ~F.col("block_trade"))
    want = {r.k for r in severe.select(ledger.alert_key(F.col("ts")).alias("k")).distinct().collect()}
    assert len(keys) == len(set(keys)) and set(keys) == want


def test_paper_ledger_over_batches_equals_one_pass(spark, signals, tmp_path):
    files, batch = signals
    got = st.run_paper_ledger(stream(spark, files), str(tmp_path / "many"))
    empty = spark.createDataFrame([], st.PAPER_SCHEMA)
    want = st.apply_folded(empty, st.fold_signals(batch))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert len(list((tmp_path / "many").glob("version=*"))) == 4


def test_restart_goes_on_from_the_checkpoint(spark, signals, tmp_path):
    files, batch = signals
    df = st.with_day(batch.select(F.col("ts").alias("as_of"), "ticker"))
    for _ in range(2):
        rows_ = stream(spark, files).select(F.col("ts").alias("as_of"), "ticker")
        out = st.run_to_table(st.with_day(rows_), str(tmp_path / "log"), "as_of_date")
    assert out.count() == df.count()


def test_ledger_update_opens_once(spark):
    now = F.lit("2024-02-01").cast("timestamp")
    signals_ = spark.createDataFrame([("T", 100.0, "bullish", False, 1.0, 1.0)], "ticker string, current_price double, direction string, block_trade boolean, opportunity_score double, confidence_score double")
    first = ledger.update_paper(spark.createDataFrame([], ledger.PAPER_SCHEMA), signals_, now)
    again = ledger.update_paper(first, signals_.withColumn("current_price", F.lit(110.0)).withColumn("direction", F.lit("bearish")), now)
    row = again.first()
    assert (row.side, row.entry_price, row.unrealized_pnl_pct, row.latest_direction) == ("long", 100.0, 10.0, "bearish")
