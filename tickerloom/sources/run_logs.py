"""The six snapshot logs of a run as one commit.

The rows of a run go to six tables.  They are staged below an attempt of their own, and
become visible together when the run's manifest is written: one small file, put in place
by one rename.  Readers take the logs through the manifests, so a crash between two logs
leaves rows that nobody sees, a repeated run adds nothing, and of two attempts at one run
the first to be committed counts.  Manifests hold one row for each run, so they are sent to
the rows: rows dealt by their run would be as many tasks as there are runs.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import logs

MANIFESTS = "_runs"
MANIFEST_SCHEMA = "run_id string, as_of timestamp, attempt string, committed_at timestamp, staged map<string,bigint>"


def run_tables(predictions: DataFrame, evidence: DataFrame) -> dict[str, DataFrame]:
    """The rows of all six logs; both inputs carry run_id and as_of, a prediction its nested parts."""
    keys = [c for c in ("run_id", "as_of", "ticker", "horizon", "strategy") if c in predictions.columns]
    expiries = logs.expiry_rows(predictions, keys)
    count = F.col("options_summary.available_expirations") if "options_summary" in predictions.columns else F.lit(None).cast("long")
    chain = predictions.withColumn("_n", count)
    chain = logs.expiry_rows(chain, [*keys, "_n"]).withColumnRenamed("_n", "available_expiration_count")
    iv = [c for c in ("expiration", "dte", "avg_iv", "reference_price", "iv_rank", "iv_realized_ratio") if c in expiries.columns]
    stored = logs.compact_predictions(predictions.drop("expiries"))
    features = logs.feature_rows(predictions)
    voids = [f.name for f in features.schema.fields if f.dataType.typeName() == "void"]
    return {
        "prediction_snapshots": stored,
        "feature_snapshots": features.withColumns({c: F.col(c).cast("string") for c in voids}),
        "options_expiry_snapshots": expiries,
        "options_chain_snapshots": chain.withColumn("snapshot_type", F.lit("selected_expiry_contract")),
        "iv_snapshots": logs.iv_rows(expiries).select(*keys[:3], *iv),
        "evidence_snapshots": evidence,
    }


def stage(tables: dict[str, DataFrame], base: str, attempt: str) -> None:
    """Write rows where no reader looks yet, partitioned by day within the attempt."""
    unknown = set(tables) - set(logs.LOGS)
    if unknown:
        raise ValueError(f"unknown logs: {sorted(unknown)}")
    for name, df in tables.items():
        df.withColumn("as_of_date", F.to_date("as_of")).write.partitionBy("as_of_date").parquet(f"{base}/{name}/attempt={attempt}")


def committed_runs(spark: SparkSession, base: str) -> DataFrame:
    """The manifest that counts for every run: the first, by time and attempt."""
    try:
        all_of_them = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{base}/{MANIFESTS}")
    except Exception as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        all_of_them = spark.createDataFrame([], MANIFEST_SCHEMA)
    rest = F.struct("committed_at", "attempt", "as_of", "staged")
    return all_of_them.groupBy("run_id").agg(F.min_by(rest, F.struct("committed_at", "attempt")).alias("_m")).select("run_id", "_m.*")


def commit_runs(tables: dict[str, DataFrame], base: str, attempt: str | None = None) -> str:
    """Append the rows of one or more runs to all logs, or to none; runs that are there already are left out."""
    spark = next(iter(tables.values())).sparkSession
    attempt = attempt or f"a{uuid.uuid4().hex}"
    known = committed_runs(spark, base).select("run_id")
    stage({name: df.join(F.broadcast(known), "run_id", "left_anti") for name, df in tables.items()}, base, attempt)
    counts = []
    for name, df in tables.items():
        staged = spark.read.schema(df.schema).parquet(f"{base}/{name}/attempt={attempt}")
        counts.append(staged.groupBy("run_id").agg(F.max("as_of").alias("as_of"), F.count(F.lit(1)).alias("n")).withColumn("log", F.lit(name)))
    by_run = reduce(lambda a, b: a.unionByName(b), counts).groupBy("run_id")
    # one entry for each log
    manifest = by_run.agg(F.max("as_of").cast("timestamp").alias("as_of"), F.map_from_entries(F.collect_list(F.struct("log", "n"))).alias("staged"))
    manifest = manifest.select("run_id", "as_of", F.lit(attempt).alias("attempt"), F.current_timestamp().alias("committed_at"), "staged")
    manifest.coalesce(1).write.mode("append").parquet(f"{base}/{MANIFESTS}")
    return attempt


def read_runs(spark: SparkSession, base: str, name: str, schema: str | None = None) -> DataFrame:
    """The rows of a log that belong to committed runs."""
    reader = spark.read.schema(schema) if schema else spark.read
    rows = reader.parquet(f"{base}/{name}")
    return rows.join(F.broadcast(committed_runs(spark, base).select("run_id", "attempt")), ["run_id", "attempt"]).drop("attempt")
