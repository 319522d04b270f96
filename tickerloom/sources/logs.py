"""Snapshot logs: tolerant reading, flattening, appending and status."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOGS = (
    "prediction_snapshots", "feature_snapshots", "options_expiry_snapshots", "options_chain_snapshots", "iv_snapshots",
    "evidence_snapshots",
)
MAX_EXPIRIES = 20


def read_log(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON-lines log; malformed lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def parse_lines(lines: DataFrame, schema: str) -> DataFrame:
    """The same tolerance for a column `value` of raw lines."""
    parsed = F.from_json(F.trim("value"), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    df = lines.where(F.trim("value") != "").withColumn("_row", parsed)
    keys = [c for c in lines.columns if c != "value"]
    return df.where(F.col("_row._bad").isNull()).select(*keys, "_row.*").drop("_bad")


def last_rows(log: DataFrame, n: int, order: str = "as_of", *ties: str) -> DataFrame:
    """The newest n rows of the whole log (a bounded top-n, never a full sort).

    Rows of one time are told apart by the columns in `ties`, or by all others.
    """
    rest = ties or [c for c in log.columns if c != order]
    return log.orderBy(F.desc(order), *[F.desc(c) for c in rest]).limit(n)


def compact_predictions(predictions: DataFrame) -> DataFrame:
    """Prediction rows for the log, long lists cut to what the log keeps."""
    cut = {"source_links": 10, "catalysts": 8, "policy_impacts": 8, "top_expiries": 3}
    return predictions.select(*[F.slice(c, 1, cut[c]).alias(c) if c in cut else F.col(c) for c in predictions.columns])


# fixed values: flat feature name -> path in the prediction row
FEATURE_PATHS = {
    "current_price": "market_snapshot.current_price",
    "day_change_pct": "market_snapshot.day_change_pct",
    "last_volume": "market_snapshot.last_volume",
    "market_source": "market_snapshot.source",
    "directional_conviction_pct": "confidence_trace.directional_conviction_pct",
    "data_quality_pct": "confidence_trace.data_quality_pct",
    "coverage_pct": "confidence_trace.coverage_pct",
    "agreement_pct": "confidence_trace.agreement_pct",
    "evidence_count": "confidence_trace.evidence_count",
    "news_items": "trend_impact.news_items",
    "avg_evidence_polarity": "trend_impact.avg_evidence_polarity",
    "policy_event_count": "trend_impact.policy_event_count",
    "social_net_sentiment": "trend_impact.social_net_sentiment",
    "forecast_prob_up": "forecast.prob_up",
    "forecast_expected_return_pct": "forecast.expected_return_pct",
    "forecast_p05_return_pct": "forecast.p05_return_pct",
    "forecast_p95_return_pct": "forecast.p95_return_pct",
    "forecast_2d_prob_up": "forecast_2d.prob_up",
    "forecast_2d_expected_return_pct": "forecast_2d.expected_return_pct",
    "forecast_3d_prob_up": "forecast_3d.prob_up",
    "forecast_3d_expected_return_pct": "forecast_3d.expected_return_pct",
    "event_radar_verdict": "event_radar.verdict",
    "event_radar_breakout_score": "event_radar.breakout_score",
    "event_radar_exhaustion_score": "event_radar.exhaustion_score",
    "options_bias": "options_summary.bias",
    "options_strategy": "options_summary.strategy",
    "options_data_source": "options_summary.data_source",
    "options_algo_confluence": "options_summary.algo_confluence",
    "options_available_expirations": "options_summary.available_expirations",
    "final_verdict_label": "final_verdict.label",
    "final_research_action": "final_verdict.research_action",
}
# fixed values: flat feature name -> field of the best expiry
EXPIRY_FEATURES = {
    "top_option_expiration": "expiration",
    "top_option_dte": "dte",
    "top_option_action": "action",
    "top_option_confidence": "confidence",
    "top_option_risk_gate": "risk_gate",
    "top_option_price": "reference_price",
    "top_option_spread_pct": "spread_pct",
    "top_option_avg_iv": "avg_iv",
    "top_option_iv_rank": "iv_rank",
    "top_option_iv_realized_ratio": "iv_realized_ratio",
    "top_option_delta": "delta",
    "top_option_theta_per_day": "theta_per_day",
    "top_option_volume": "exact_volume",
    "top_option_oi": "exact_oi",
    "top_option_uoa_score": "unusual_score",
    "top_option_oi_change_pct": "oi_change_pct",
}
FEATURE_KEYS = (
    "run_id", "as_of", "prediction_id", "ticker", "asset_type", "horizon", "strategy", "direction", "opportunity_score",
    "confidence_score", "risk_score", "risk_level", "severity", "component_scores", "component_weights",
)


def _path(schema: T.StructType, path: str) -> Column | None:
    """Column of a dotted path when the schema has it."""
    node = schema
    for part in path.split("."):
        if not isinstance(node, T.StructType) or part not in node.fieldNames():
            return None
        node = node[part].dataType
    return F.col(path)


def feature_rows(predictions: DataFrame) -> DataFrame:
    """Flat feature row of every nested prediction; absent parts become NULL."""
    schema = predictions.schema
    out = [F.col(c) for c in FEATURE_KEYS if c in predictions.columns]
    for name, path in FEATURE_PATHS.items():
        found = _path(schema, path)
        out.append((F.lit(None) if found is None else found).alias(name))
    raw = _path(schema, "confidence_trace.raw_confidence_score")
    score = F.col("confidence_score")
    out.append((score if raw is None else F.coalesce(raw, score)).alias("raw_confidence_score"))
    shift = _path(schema, "confidence_trace.calibration.adjustment")
    out.append((F.lit(None).cast("double") if shift is None else shift).alias("calibration_adjustment"))
    for name, column in (("missing_data_count", "missing_data"), ("source_link_count", "source_links")):
        size = F.coalesce(F.greatest(F.size(column), F.lit(0)), F.lit(0)) if column in predictions.columns else F.lit(0)
        out.append(size.alias(name))
    fields = schema["top_expiries"].dataType.elementType.fieldNames() if "top_expiries" in predictions.columns else []
    best = F.try_element_at("top_expiries", F.lit(1))
    for name, field in EXPIRY_FEATURES.items():
        out.append((best[field] if field in fields else F.lit(None)).alias(name))
    return predictions.select(*out)


def expiry_rows(predictions: DataFrame, keys: list[str], expiries: str = "expiries") -> DataFrame:
    """One row per stored expiry, at most twenty per prediction."""
    df = predictions.select(*keys, F.posexplode(F.slice(expiries, 1, MAX_EXPIRIES)).alias("place", "_e"))
    return df.select(*keys, "place", "_e.*")


def iv_rows(expiry: DataFrame) -> DataFrame:
    return expiry.where(F.col("avg_iv").isNotNull())


def append_snapshots(tables: dict[str, DataFrame], base: str, run_id: str, as_of: str, fmt: str = "parquet") -> None:
    """Append one run's rows to the logs, partitioned by day.

    Each log is written by its own job; rows already in the log are never read.
    """
    unknown = set(tables) - set(LOGS)
    if unknown:
        raise ValueError(f"unknown logs: {sorted(unknown)}")
    for name, df in tables.items():
        stamped = df.withColumn("run_id", F.lit(run_id)).withColumn("as_of", F.lit(as_of).cast("timestamp"))
        stamped = stamped.withColumn("as_of_date", F.to_date("as_of"))
        stamped.write.mode("append").partitionBy("as_of_date").format(fmt).save(f"{base}/{name}")


def snapshot_status(logs: dict[str, DataFrame]) -> DataFrame:
    """Rows, runs and newest run of every log."""
    parts = [
        df.groupBy().agg(
            F.lit(name).alias("log"),
            F.count(F.lit(1)).alias("rows"),
            F.count_distinct("run_id").alias("runs"),
            F.max("as_of").alias("latest"),
            F.max_by("run_id", "as_of").alias("latest_run"),
        )
        for name, df in logs.items()
    ]
    return reduce(lambda a, b: a.unionAll(b), parts)


SUMMARY_COLUMNS = (
    "ticker", "asset_type", "direction", "final_label", "validation_status", "current_price", "target_price",
    "expected_points", "expected_percent", "final_required_points", "stop_price", "reward_risk_ratio", "rejected_reason",
    "opportunity_score", "confidence", "risk_score", "risk_level", "event_level", "severity", "horizon", "strategy",
)


def write_summary_csv(signals: DataFrame, path: str) -> None:
    kept = [c for c in SUMMARY_COLUMNS if c in signals.columns]
    signals.select(*kept).write.mode("overwrite").option("header", True).csv(path)


def write_signals_json(signals: DataFrame, path: str) -> None:
    signals.write.mode("overwrite").json(path)


def write_evidence(evidence: DataFrame, path: str) -> None:
    evidence.write.mode("append").json(path)
