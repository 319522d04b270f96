"""The six logs of committed runs, written together and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import run_folder
from ..sources import logs, run_logs
from . import feeds
from .base import Catalogue
from .chains import CHAIN, METRICS, expiry_metrics
from .tables_sql import NEWS, r, with_

CATALOGUE = Catalogue()
add = CATALOGUE.add

RUNS = 3
# features and expiry fields that hold text; all others are numbers
TEXT = ("source", "verdict", "bias", "strategy", "data_source", "label", "research_action", "expiration", "action", "risk_gate")
PATHS = (*logs.FEATURE_PATHS.values(), "confidence_trace.raw_confidence_score", "confidence_trace.calibration.adjustment")
FIELDS = tuple(logs.EXPIRY_FEATURES.values())


def _is_text(path: str) -> bool:
    return path.split(".")[-1] in TEXT


def _value(path: str, place: int, number, as_text):
    """A number or a text made of the place of a field and a given number."""
    return as_text(path, place) if _is_text(path) else number(place)


def _nested(paths, make):
    """A struct for each first part of the dotted paths."""
    groups: dict[str, dict] = {}
    for place, path in enumerate(paths):
        node = groups
        *parts, last = path.split(".")
        for part in parts:
            node = node.setdefault(part, {})
        node[last] = make(path, place)

    def build(node):
        return F.struct(*[(build(v) if isinstance(v, dict) else v).alias(k) for k, v in node.items()])

    return {k: build(v) for k, v in groups.items()}


def nested_predictions(spark, sf_dir):
    """A prediction for each ticker and run, with every nested part that the logs read."""
    m = expiry_metrics(spark, sf_dir)
    dte = F.col("dte")

    def field(name, place):
        if name == "dte":
            return dte
        if name == "avg_iv":
            return F.when(dte != 14, F.col("avg_iv"))
        return _value(name, place, lambda k: (dte * (k + 3) % 97).cast("double"), lambda p, k: F.concat(F.lit(f"{p}-"), (dte * (k + 3) % 7).cast("string")))

    # a ticker lists a few expiries, so the nested list is short by nature
    entry = F.struct(dte.alias("_o"), *[field(n, k).alias(n) for k, n in enumerate(FIELDS)])
    df = m.groupBy("ticker").agg(F.array_sort(F.collect_list(entry)).alias("_e"), F.max("total_oi").cast("double").alias("price"))
    expiries = F.transform("_e", lambda e: F.struct(*[e[n].alias(n) for n in FIELDS]))
    price = F.col("price") + F.col("run")
    parts = _nested(PATHS, lambda p, k: _value(p, k, lambda j: price * (j + 1) % 101, lambda q, j: F.concat(F.lit(f"{q}-"), (price * (j + 1) % 7).cast("long").cast("string"))))
    df = df.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(RUNS - 1))))
    links = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.concat(F.lit("l"), i.cast("string")))
    return df.select(
        F.concat(F.lit("r"), F.col("run").cast("string")).alias("run_id"),
        F.date_add(F.lit("2024-02-01").cast("date"), F.col("run")).cast("timestamp").alias("as_of"),
        F.concat_ws("-", "ticker", "run").alias("prediction_id"),
        "ticker",
        F.lit("5D").alias("horizon"),
        F.lit("swing").alias("strategy"),
        (price % 100).alias("confidence_score"),
        *[v.alias(k) for k, v in parts.items()],
        links.alias("source_links"),
        F.array(F.lit("macro"), F.lit("social")).alias("missing_data"),
        expiries.alias("expiries"),
        expiries.alias("top_expiries"),
    )


def evidence_of_runs(spark, sf_dir):
    """Every evidence row, dealt to the runs by its place."""
    run = F.col("seq") % RUNS
    rows = feeds.evidence(spark, sf_dir)
    return rows.select(
        F.concat(F.lit("r"), run.cast("string")).alias("run_id"),
        F.date_add(F.lit("2024-02-01").cast("date"), run.cast("int")).cast("timestamp").alias("as_of"),
        "evidence_id", "entity", "source_name", "source_type", "url", "published_at", "claim", "polarity", "reliability_score", "freshness_score", "seq",
    )


def committed(spark, sf_dir, name: str):
    """The log after a run that was cut off, the commit of all runs, and a second commit of the same runs."""
    base = run_folder(spark, "runs")
    tables = run_logs.run_tables(nested_predictions(spark, sf_dir), evidence_of_runs(spark, sf_dir))
    # an attempt that ends between its logs: no manifest, so nobody sees it
    run_logs.stage({name: tables[name]}, base, "broken")
    run_logs.commit_runs(tables, base)
    run_logs.commit_runs({name: tables[name]}, base)
    return run_logs.read_runs(spark, base, name)


# --------------------------------------------------------------------------- the same rows in SQL
def _sql_value(path: str, place: int, x: str, shift: int, numbers: int) -> str:
    if _is_text(path):
        return f"'{path}-' || CAST(CAST({x} * {place + shift} % 7 AS BIGINT) AS VARCHAR)"
    return f"CAST({x} * {place + shift} % {numbers} AS DOUBLE)"


def _expiry(name: str, place: int) -> str:
    if name == "dte":
        return "dte::BIGINT"
    if name == "avg_iv":
        return "CASE WHEN dte <> 14 THEN avg_iv END"
    return _sql_value(name, place, "dte", 3, 97)


_fields = {n: _expiry(n, k) for k, n in enumerate(FIELDS)}
_paths = {p: _sql_value(p, k, "price", 1, 101) for k, p in enumerate(PATHS)}
EXPIRIES = f"""ex AS (SELECT ticker, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY dte) - 1 AS place, {', '.join(f'{e} AS {n}' for n, e in _fields.items())} FROM metrics)"""
RUN_SQL = """pr AS (SELECT ticker, MAX(total_oi)::DOUBLE AS base FROM metrics GROUP BY ticker),
runs AS (SELECT *, 'r' || CAST(run AS VARCHAR) AS run_id, CAST(DATE '2024-02-01' + run::INT AS VARCHAR) AS as_of_date, base + run AS price FROM pr CROSS JOIN (VALUES (0), (1), (2)) k(run))"""
KEYS = "run_id, as_of_date"
STORED = ", ".join(_fields)


def _shown(cols: str) -> str:
    """Doubles of the list rounded as the query publishes them."""
    return ", ".join(f"{r(c)} AS {c}" if c not in TEXT and c != "dte" else c for c in cols.split(", "))


@add("log_predictions", with_(CHAIN, METRICS, EXPIRIES, RUN_SQL, select=f"""
SELECT {KEYS}, runs.ticker || '-' || run AS prediction_id, runs.ticker, '5D' AS horizon, 'swing' AS strategy, {r('price % 100')} AS confidence_score,
  {', '.join((e if _is_text(p) else r(e)) + f' AS {p.replace(".", "_")}' for p, e in _paths.items())},
  ARRAY_TO_STRING(LIST_TRANSFORM(RANGE(1, 11), lambda i: 'l' || CAST(i AS VARCHAR)), '; ') AS source_links, 'macro; social' AS missing_data, dtes AS stored_dtes
FROM runs JOIN (SELECT ticker, STRING_AGG(CASE WHEN place < 3 THEN CAST(dte AS VARCHAR) END, '; ' ORDER BY place) AS dtes FROM ex GROUP BY ticker) d ON d.ticker = runs.ticker"""))
def log_predictions(spark, sf_dir):
    df = committed(spark, sf_dir, "prediction_snapshots")
    flat = [F.col(p).alias(p.replace(".", "_")) for p in PATHS]
    return df.select(
        "run_id", F.col("as_of_date").cast("string").alias("as_of_date"), "prediction_id", "ticker", "horizon", "strategy", "confidence_score", *flat,
        "source_links", "missing_data", F.transform("top_expiries", lambda e: e["dte"].cast("string")).alias("stored_dtes"),
    )


_first = {name: f"{_fields[f]}" for name, f in logs.EXPIRY_FEATURES.items()}


@add("log_features", with_(CHAIN, METRICS, EXPIRIES, RUN_SQL, select=f"""
SELECT {KEYS}, runs.ticker || '-' || run AS prediction_id, runs.ticker, '5D' AS horizon, 'swing' AS strategy, {r('price % 100')} AS confidence_score,
  {', '.join((_paths[p] if _is_text(p) else r(_paths[p])) + f' AS {n}' for n, p in logs.FEATURE_PATHS.items())},
  {r(_paths['confidence_trace.raw_confidence_score'])} AS raw_confidence_score, {r(_paths['confidence_trace.calibration.adjustment'])} AS calibration_adjustment,
  2::BIGINT AS missing_data_count, 12::BIGINT AS source_link_count,
  {', '.join((f'ex.{f}' if f in TEXT or f == 'dte' else r(f'ex.{f}')) + f' AS {n}' for n, f in logs.EXPIRY_FEATURES.items())}
FROM runs JOIN ex ON ex.ticker = runs.ticker AND ex.place = 0"""))
def log_features(spark, sf_dir):
    df = committed(spark, sf_dir, "feature_snapshots")
    return df.drop("as_of").withColumn("as_of_date", F.col("as_of_date").cast("string"))


@add("log_expiries", with_(CHAIN, METRICS, EXPIRIES, RUN_SQL, select=f"""
SELECT {KEYS}, runs.ticker, '5D' AS horizon, 'swing' AS strategy, place::BIGINT AS place, {_shown(STORED)} FROM runs JOIN ex ON ex.ticker = runs.ticker WHERE place < 20"""))
def log_expiries(spark, sf_dir):
    return committed(spark, sf_dir, "options_expiry_snapshots").drop("as_of")


@add("log_chains", with_(CHAIN, METRICS, EXPIRIES, RUN_SQL, select=f"""
SELECT {KEYS}, runs.ticker, '5D' AS horizon, 'swing' AS strategy, place::BIGINT AS place, {r(_paths['options_summary.available_expirations'])} AS available_expiration_count,
  'selected_expiry_contract' AS snapshot_type, {_shown(STORED)} FROM runs JOIN ex ON ex.ticker = runs.ticker WHERE place < 20"""))
def log_chains(spark, sf_dir):
    return committed(spark, sf_dir, "options_chain_snapshots").drop("as_of")


@add("log_iv", with_(CHAIN, METRICS, EXPIRIES, RUN_SQL, select=f"""
SELECT {KEYS}, runs.ticker, {_shown('expiration, dte, avg_iv, reference_price, iv_rank, iv_realized_ratio')} FROM runs JOIN ex ON ex.ticker = runs.ticker WHERE place < 20 AND avg_iv IS NOT NULL"""))
def log_iv(spark, sf_dir):
    return committed(spark, sf_dir, "iv_snapshots").drop("as_of")


@add("log_evidence", with_(NEWS, feeds.NEWS_O, feeds.EVID, select=f"""
SELECT 'r' || CAST(news_id % 3 AS VARCHAR) AS run_id, CAST(DATE '2024-02-01' + (news_id % 3)::INT AS VARCHAR) AS as_of_date, evidence_id, entity, source_name, COALESCE(source_type, 'unknown') AS source_type, url,
  strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at, claim, {r('GREATEST(-1, LEAST(1, pol))')} AS polarity, rel::BIGINT AS reliability_score, fresh AS freshness_score, news_id AS seq FROM ev1"""))
def log_evidence(spark, sf_dir):
    return committed(spark, sf_dir, "evidence_snapshots").drop("as_of")
