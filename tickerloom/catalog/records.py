"""Sources, snapshot logs, ledgers and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import datasets as data
from ..functions.text import event_kind
from ..operators import ledger, summaries
from ..operators import signals
from ..sources import bars as src
from ..sources import config, filings, logs, policy
from .base import Catalogue
from .tables_sql import BARS, CHAIN, GOV_EVENTS, INDEX_BARS, NEWS, PREDICTIONS, r, rs, with_
from .chains import METRICS
from .chains import metrics as expiry_metrics
from .feeds import KEY
from .market import FACTS
from .timeseries import DELTA

CATALOGUE = Catalogue()
add = CATALOGUE.add

PROVIDERS = {"primary": 0, "second": 1, "cache": 2}
PB = """pb AS (SELECT ticker, date, close, ['primary', 'second', 'cache'][p + 1] AS provider, p FROM (SELECT * EXCLUDE (k), CASE WHEN (k = 0 AND date < DATE '1995-02-15' AND LENGTH(ticker) = 8) OR (k = 1 AND LENGTH(ticker) = 8) OR (k = 2 AND ticker <> 'Brand#3') THEN k END AS p FROM (SELECT *, UNNEST([0, 1, 2]) AS k FROM bars)))"""


def provider_bars(spark, sf_dir):
    """Every bar from each of the three providers: short, full, cached; a bar that one of them does not hold has no provider's name."""
    early = F.col("date") < F.lit("1995-02-15").cast("date")
    full = F.length("ticker") == 8
    held = {"primary": early & full, "second": full, "cache": F.col("ticker") != "Brand#3"}
    names = F.array(*[F.when(held[name], name) for name in PROVIDERS])
    return data.bars(spark, sf_dir).withColumn("provider", F.explode(names))


@add("provider_fallback", with_(BARS, PB, "pc AS (SELECT ticker, provider, p, COUNT(*) AS c FROM pb GROUP BY 1, 2, 3), pw AS (SELECT ticker, MIN(p) AS p FROM pc WHERE c >= 30 GROUP BY 1)", select=f"""
SELECT b.ticker, b.provider, COUNT(*) AS bar_count, {r('SUM(b.close)', 3)} AS close_sum FROM pb b JOIN pw w ON w.ticker = b.ticker AND w.p = b.p GROUP BY 1, 2"""))
def provider_fallback(spark, sf_dir):
    """Bars of the first provider with enough rows, per ticker."""
    kept = src.with_fallback(provider_bars(spark, sf_dir), PROVIDERS)
    from ..functions.numeric import rnd

    return kept.groupBy("ticker", "provider").agg(F.count(F.lit(1)).alias("bar_count"), rnd(F.sum("close"), 3).alias("close_sum"))


@add("provider_status", with_(BARS, PB, """pt AS (SELECT ticker, p, ['primary', 'second', 'cache'][p + 1] AS provider FROM (SELECT DISTINCT ticker, UNNEST([0, 1, 2]) AS p FROM bars)),
ps AS (SELECT t.ticker, t.provider, t.p, COALESCE(c.c, 0) AS c FROM pt t LEFT JOIN (SELECT ticker, p, COUNT(*) AS c FROM pb GROUP BY 1, 2) c ON c.ticker = t.ticker AND c.p = t.p),
pw AS (SELECT *, MIN(CASE WHEN c >= 30 THEN p END) OVER (PARTITION BY ticker) AS won FROM ps)""", select="""
SELECT ticker, provider, p::BIGINT AS priority, c AS bar_count, CASE WHEN c >= 30 THEN 'ok' WHEN c > 0 THEN 'insufficient_rows' ELSE 'missing' END AS status FROM pw WHERE won IS NULL OR p <= won"""))
def provider_status(spark, sf_dir):
    return src.provider_status(data.bars(spark, sf_dir), provider_bars(spark, sf_dir), PROVIDERS)


@add("clean_bars", f"""
SELECT l_returnflag AS symbol, COUNT(*) AS bars, {r('SUM(l_quantity)', 3)} AS volume FROM lineitem WHERE l_linenumber % 5 <> 0 AND l_linenumber % 7 <> 0 GROUP BY 1""")
def clean_bars(spark, sf_dir):
    """Raw rows with upper-case names, gaps and NaN, after cleaning."""
    line = F.col("l_linenumber")
    price = F.col("l_extendedprice")
    raw = data.table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("Symbol"),
        F.when(line % 5 != 0, price).alias("Open"),
        price.alias("High"),
        F.when(line % 7 == 0, F.lit(float("nan"))).otherwise(price).alias("Low"),
        price.alias("Close"),
        F.col("l_quantity").alias("Volume"),
    )
    from ..functions.numeric import rnd

    return src.normalise(raw).groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), rnd(F.sum("volume"), 3).alias("volume"))


@add("period_trim", with_(BARS, select="""
SELECT ticker, SUM(CASE WHEN date >= DATE '2001-06-30' - INTERVAL 2 YEAR THEN 1 ELSE 0 END)::BIGINT AS rows_2y, SUM(CASE WHEN date >= DATE '2001-06-30' - INTERVAL 6 MONTH THEN 1 ELSE 0 END)::BIGINT AS rows_6mo, SUM(CASE WHEN date >= DATE '2001-06-30' - 186 THEN 1 ELSE 0 END)::BIGINT AS rows_6mo_days,
  SUM(CASE WHEN date >= DATE '2001-06-30' - 30 THEN 1 ELSE 0 END)::BIGINT AS rows_30d FROM bars WHERE date >= DATE '2001-06-30' - INTERVAL 2 YEAR GROUP BY ticker"""))
def period_trim(spark, sf_dir):
    """Bars left by each period form, counted per ticker."""
    today = F.lit("2001-06-30").cast("date")
    base = src.trim(data.bars(spark, sf_dir), "2y", today)
    flag = F.lit(1).alias("one")
    half = src.trim(base, "6mo", today).groupBy("ticker").agg(F.count(flag).alias("rows_6mo"))
    days = src.trim(base, "6mo", today, calendar=False).groupBy("ticker").agg(F.count(flag).alias("rows_6mo_days"))
    month = src.trim(base, "30d", today).groupBy("ticker").agg(F.count(flag).alias("rows_30d"))
    out = base.groupBy("ticker").agg(F.count(flag).alias("rows_2y"))
    for part in (half, days, month):
        out = out.join(part, "ticker", "left")
    return out.na.fill(0)


@add("index_alias_scale", with_(INDEX_BARS, "al AS (SELECT * FROM (VALUES ('SPX', 'AFRICA', 1.0), ('XSP', 'AFRICA', 0.1), ('NDX', 'ASIA', 1.0), ('XND', 'ASIA', 0.01), ('DJX', 'EUROPE', 0.01)) t(ticker, symbol, scale))", select=f"""
SELECT a.ticker, COUNT(*) AS bars, {r('MAX(b.close * a.scale)')} AS top_close, {r('SUM(b.volume)', 2)} AS volume FROM index_bars b JOIN al a ON a.symbol = b.index_name GROUP BY 1"""))
def index_alias_scale(spark, sf_dir):
    aliases = spark.createDataFrame(
        [("SPX", "AFRICA", 1.0), ("XSP", "AFRICA", 0.1), ("NDX", "ASIA", 1.0), ("XND", "ASIA", 0.01), ("DJX", "EUROPE", 0.01)],
        "ticker string, symbol string, scale double",
    )
    df = src.scale_indexes(data.numbered_index_bars(spark, sf_dir).withColumnRenamed("index_name", "symbol"), aliases)
    from ..functions.numeric import rnd

    return df.groupBy("ticker").agg(F.count(F.lit(1)).alias("bars"), F.max("close").alias("top_close"), rnd(F.sum("volume"), 2).alias("volume"))


@add("asset_list", """
SELECT UPPER(TRIM(p_brand)) AS ticker, CASE WHEN LOWER(p_type) IN ('equity', 'etf', 'index', 'option') THEN LOWER(p_type) ELSE 'equity' END AS asset_type, p_partkey AS position, p_name AS company_name FROM part QUALIFY ROW_NUMBER() OVER (PARTITION BY UPPER(TRIM(p_brand)) ORDER BY p_partkey) = 1""")
def asset_list(spark, sf_dir):
    part = data.table(spark, sf_dir, "part").select(
        F.concat(F.lit(" "), F.lower("p_brand")).alias("ticker"), F.col("p_partkey").alias("position"),
        F.lower("p_type").alias("asset_type"), F.col("p_name").alias("company_name"),
    )
    return config.load_assets(part).select("ticker", "asset_type", "position", "company_name")


@add("theme_baskets", """
WITH b AS (SELECT p_type AS theme, p_name AS bucket, UPPER(p_brand) AS ticker FROM part GROUP BY 1, 2, 3), l AS (SELECT 'BRAND#' || CAST(c_custkey AS VARCHAR) AS ticker, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS final_label, c_acctbal AS confidence FROM customer)
SELECT b.theme, b.bucket, b.ticker, l.final_label, """ + r("l.confidence") + """ AS confidence, COALESCE(l.final_label, 'not_scored') AS status FROM b LEFT JOIN l ON l.ticker = b.ticker""")
def theme_baskets(spark, sf_dir):
    part = data.table(spark, sf_dir, "part")
    baskets = part.groupBy(F.col("p_type").alias("theme"), F.col("p_name").alias("bucket")).agg(F.collect_set("p_brand").alias("tickers"))
    key = F.col("c_custkey")
    label = F.when(key % 3 == 0, F.col("c_mktsegment"))
    live = data.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("BRAND#"), key.cast("string")).alias("ticker"), label.alias("final_label"), F.col("c_acctbal").alias("confidence")
    )
    return config.theme_rows(baskets, live).select("theme", "bucket", "ticker", "final_label", "confidence", "status")


@add("tolerant_log", f"""
SELECT event_id, event_type, {r('value')} AS value FROM events WHERE event_id % 10 <> 3 ORDER BY ts DESC LIMIT 500""")
def tolerant_log(spark, sf_dir):
    """Newest 500 log rows; every tenth line is broken and skipped."""
    e = data.table(spark, sf_dir, "events")
    whole = F.to_json(F.struct("event_id", "event_type", "value"))
    lines = e.select("ts", F.when(F.col("event_id") % 10 == 3, F.concat(F.lit("{\"event_id\": "), F.col("event_type"))).otherwise(whole).alias("value"))
    parsed = logs.parse_lines(lines, "event_id long, event_type string, value double, _bad string")
    return logs.last_rows(parsed, 500, "ts").drop("ts")


EX = """exs AS (SELECT ticker, dte, avg_iv, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY dte) - 1 AS place FROM metrics)"""


def stored_predictions(spark, sf_dir):
    """Nested prediction rows: one per ticker, with its expiries and links."""
    m = expiry_metrics(spark, sf_dir)
    # a ticker lists a few expiries, so the nested list is short by nature
    entry = F.struct(F.col("dte"), F.when(F.col("dte") != 14, F.col("avg_iv")).alias("avg_iv"), F.lit("BUY CALL").alias("action"))
    df = m.groupBy("ticker").agg(F.array_sort(F.collect_list(entry)).alias("expiries"), F.max("total_oi").cast("double").alias("price"))
    links = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.concat(F.lit("l"), i.cast("string")))
    return df.select(
        F.lit("run1").alias("run_id"),
        F.lit("2024-01-31 00:00:00").cast("timestamp").alias("as_of"),
        "ticker",
        F.col("price").alias("confidence_score"),
        F.struct(F.col("price").alias("current_price"), F.lit("table").alias("source")).alias("market_snapshot"),
        F.struct((F.col("price") / 10).alias("prob_up")).alias("forecast"),
        links.alias("source_links"),
        F.array(F.lit("macro")).alias("missing_data"),
        "expiries",
        F.col("expiries").alias("top_expiries"),
    )


@add("compact_prediction_log", with_(CHAIN, METRICS, select="SELECT ticker, 10::BIGINT AS links, LEAST(3, COUNT(*))::BIGINT AS stored_expiries FROM metrics GROUP BY ticker"))
def compact_prediction_log(spark, sf_dir):
    df = logs.compact_predictions(stored_predictions(spark, sf_dir))
    return df.select("ticker", F.size("source_links").alias("links"), F.size("top_expiries").alias("stored_expiries"))


@add("feature_rows", with_(CHAIN, METRICS, EX, select=f"""
SELECT ticker, 'run1' AS run_id, {r('MAX(m.total_oi)')} AS current_price, {r('MAX(m.total_oi) / 10.0')} AS forecast_prob_up, {r('MAX(m.total_oi)')} AS raw_confidence_score, 1::BIGINT AS missing_data_count, 12::BIGINT AS source_link_count, MIN(m.dte)::BIGINT AS top_option_dte,
  {r('ARG_MIN_NULL(CASE WHEN m.dte <> 14 THEN m.avg_iv END, m.dte)')} AS top_option_avg_iv, 'BUY CALL' AS top_option_action, CAST(NULL AS DOUBLE) AS calibration_adjustment FROM metrics m GROUP BY ticker"""))
def feature_rows(spark, sf_dir):
    df = logs.feature_rows(stored_predictions(spark, sf_dir))
    return df.select(
        "ticker", "run_id", "current_price", "forecast_prob_up", "raw_confidence_score", "missing_data_count", "source_link_count",
        "top_option_dte", "top_option_avg_iv", "top_option_action", "calibration_adjustment",
    )


@add("iv_log_rows", with_(CHAIN, METRICS, EX, select="SELECT ticker, place::BIGINT AS place, dte::BIGINT AS dte, avg_iv FROM exs WHERE dte <> 14 AND avg_iv IS NOT NULL"))
def iv_log_rows(spark, sf_dir):
    rows = logs.iv_rows(logs.expiry_rows(stored_predictions(spark, sf_dir), ["ticker"]))
    return rows.select("ticker", "place", "dte", "avg_iv")


@add("snapshot_status", """
SELECT 'iv_snapshots' AS log, COUNT(*) AS rows, COUNT(DISTINCT CAST(ts AS DATE)) AS runs, strftime(MAX(ts), '%Y-%m-%d %H:%M:%S') AS latest FROM events
UNION ALL SELECT 'prediction_snapshots', COUNT(*), COUNT(DISTINCT CAST(o_orderdate AS DATE)), strftime(MAX(o_orderdate), '%Y-%m-%d %H:%M:%S') FROM orders""")
def snapshot_status(spark, sf_dir):
    iv = data.table(spark, sf_dir, "events").select(F.col("ts").alias("as_of"), F.to_date("ts").cast("string").alias("run_id"))
    calls = data.table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("as_of"), F.to_date("o_orderdate").cast("string").alias("run_id"))
    return logs.snapshot_status({"iv_snapshots": iv, "prediction_snapshots": calls}).select("log", "rows", "runs", "latest")


FORMS = "['10-K', '8-K', 'X-1', '4', 'S-3']"
FIL = f"""fil AS (SELECT LPAD(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, {FORMS}[o_orderkey % 5 + 1] AS form, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS filed, o_orderkey FROM orders),
fil2 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY cik ORDER BY o_orderkey) AS p FROM fil),
fil3 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY cik ORDER BY o_orderkey) AS rank FROM fil2 WHERE p <= 40 AND form IN ('10-K', '8-K', '4'))"""


def filing_rows(spark, sf_dir):
    k = F.col("o_orderkey")
    forms = F.array(*[F.lit(x) for x in ("10-K", "8-K", "X-1", "4", "S-3")])
    return data.table(spark, sf_dir, "orders").select(
        F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("cik"),
        F.element_at(forms, (k % 5 + 1).cast("int")).alias("form"),
        F.to_date("o_orderdate").cast("string").alias("filed"),
        F.concat_ws("-", F.lit("00"), k.cast("string")).alias("accession"),
        F.when(k % 4 != 0, "doc.htm").alias("document"),
        k.alias("position"),
    )


@add("material_filings", with_(FIL, select="""
SELECT cik, form, filed, form || ' filed ' || filed AS title, CASE WHEN o_orderkey % 4 <> 0 THEN 'https://www.sec.gov/Archives/edgar/data/' || CAST(CAST(cik AS BIGINT) AS VARCHAR) || '/00' || CAST(o_orderkey AS VARCHAR) || '/doc.htm' ELSE 'https://www.sec.gov/cgi-bin/browse-edgar?action=getcompany&CIK=' || cik END AS url, rank FROM fil3 WHERE rank <= 12"""))
def material_filings(spark, sf_dir):
    return filings.material_filings(filing_rows(spark, sf_dir))


@add("filing_coverage", with_(FIL, select="SELECT cik, COUNT(*) AS filing_count, MAX(filed) AS latest_filed FROM fil3 WHERE rank <= 12 GROUP BY 1 ORDER BY filing_count DESC, cik LIMIT 8"))
def filing_coverage(spark, sf_dir):
    return summaries.filing_coverage(filings.material_filings(filing_rows(spark, sf_dir)))


@add("company_numbers", "SELECT UPPER(s_name) AS ticker, CASE WHEN s_suppkey % 4 <> 0 THEN LPAD(CAST(s_suppkey AS VARCHAR), 10, '0') END AS cik FROM supplier")
def company_numbers(spark, sf_dir):
    supplier = data.table(spark, sf_dir, "supplier")
    lookup = supplier.where(F.col("s_suppkey") % 4 != 0).select(F.col("s_name").alias("ticker"), F.col("s_suppkey").alias("cik_number"))
    return filings.padded_cik(supplier.select(F.col("s_name").alias("ticker")), lookup)


POLICY = """pf AS (SELECT REGEXP_REPLACE('Class ' || (doc_id % 3 + 1) || ' recall — ' || source || ': ' || SUBSTRING(text, 1, 120), '^[ —:]+|[ —:]+$', '', 'g') AS title, CASE WHEN doc_id % 2 = 0 THEN 'FDA Drug Recall' ELSE 'FDA Device Recall' END AS source, 'fda' AS kind,
    CASE WHEN doc_id % 7 <> 0 THEN strftime(DATE '2024-01-01' + (doc_id % 28)::INT, '%Y-%m-%d %H:%M:%S') END AS published_at, 'openfda' AS provider, doc_id FROM documents WHERE lang = 'en'
  UNION ALL SELECT CASE WHEN doc_id % 2 = 0 THEN 'FTC: ' ELSE 'DOJ Antitrust: ' END || text, CASE WHEN doc_id % 2 = 0 THEN 'FTC' ELSE 'DOJ Antitrust' END, 'antitrust', '2024-01-05 00:00:00', 'doj_ftc', doc_id FROM documents WHERE lang = 'fr'
  UNION ALL SELECT text, 'White House', CASE WHEN CONTAINS(LOWER(text), 'trump') OR CONTAINS(LOWER(text), 'tariff') THEN 'trump_admin' ELSE 'policy' END, '2024-01-06 00:00:00', 'white_house', doc_id FROM documents WHERE lang NOT IN ('en', 'fr'))"""


def policy_union(spark, sf_dir):
    docs = data.table(spark, sf_dir, "documents")
    d = F.col("doc_id")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (d % 28).cast("int")), "yyyyMMdd")
    recalls = docs.where("lang = 'en'").select(
        F.concat(F.lit("Class "), (d % 3 + 1).cast("string")).alias("classification"), F.col("source").alias("firm"), F.col("text").alias("reason"),
        F.when(d % 2 == 0, "drug").otherwise("device").alias("product"), F.when(d % 7 == 0, F.lit("n/a")).otherwise(day).alias("report_date"),
    )
    agency = docs.where("lang = 'fr'").select(
        F.when(d % 2 == 0, "FTC").otherwise("DOJ Antitrust").alias("agency"), F.col("text").alias("title"),
        F.lit("u").alias("url"), F.lit("2024-01-05 00:00:00").alias("published_at"),
    )
    house = docs.where("lang not in ('en', 'fr')").select(
        F.col("text").alias("title"), F.lit("White House").alias("source"), F.lit("u").alias("url"), F.lit("2024-01-06 00:00:00").alias("published_at")
    )
    return policy.union_events(policy.recall_events(recalls), policy.agency_events(agency), policy.titled_events(house, "white_house"))


@add("policy_feed_union", with_(POLICY, select="SELECT title, source, kind, published_at, provider FROM pf"))
def policy_feed_union(spark, sf_dir):
    return policy_union(spark, sf_dir).select("title", "source", "kind", "published_at", "provider")


@add("policy_feed_summary", with_(POLICY, select="SELECT provider, kind, COUNT(*) AS events, MAX(published_at) AS latest_published FROM pf GROUP BY 1, 2"))
def policy_feed_summary(spark, sf_dir):
    return policy_union(spark, sf_dir).groupBy("provider", "kind").agg(F.count(F.lit(1)).alias("events"), F.max("published_at").alias("latest_published"))


@add("policy_feed_providers", with_(POLICY, select="SELECT provider FROM pf UNION SELECT series FROM (SELECT event_type AS series FROM events)"))
def policy_feed_providers(spark, sf_dir):
    values = data.table(spark, sf_dir, "events").select(F.col("event_type").alias("provider"))
    return policy.snapshot_providers(policy_union(spark, sf_dir), values)


@add("policy_feed_values", f"""
SELECT COUNT(*) AS value_count, STRING_AGG(event_type || '=' || printf('%.2f', v), '; ' ORDER BY event_type) AS readings FROM (SELECT event_type, MAX_BY(value, ts) AS v FROM events GROUP BY 1)""")
def policy_feed_values(spark, sf_dir):
    """Newest value of each feed as one map."""
    feed = data.table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), F.col("ts").alias("date"), "value")
    df = policy.feed_values(feed)
    text = F.transform(F.map_entries("values"), lambda e: F.format_string("%s=%.2f", e["key"], e["value"]))
    return df.select("value_count", text.alias("readings"))


@add("snapshot_append_log", f"""
SELECT run_id, CAST(as_of AS VARCHAR) AS as_of_date, COUNT(*) AS rows, {r('SUM(ROUND(20 + value / 10, 4))', 3)} AS iv_sum FROM (SELECT *, 'r' || CAST(event_id % 3 AS VARCHAR) AS run_id, DATE '2024-02-01' + (event_id % 3)::INT AS as_of FROM events) GROUP BY 1, 2""")
def snapshot_append_log(spark, sf_dir):
    """Three runs appended to one day-partitioned log, then read back."""
    from ..functions.numeric import rnd
    from ..session import run_folder

    base = run_folder(spark, "log")
    iv = data.iv_snapshots(spark, sf_dir).select("ticker", "seq", "expiration", "avg_iv")
    for run in range(3):
        logs.append_snapshots({"iv_snapshots": iv.where(F.col("seq") % 3 == run)}, base, f"r{run}", f"2024-02-0{run + 1} 00:00:00")
    back = spark.read.parquet(f"{base}/iv_snapshots")
    return back.groupBy("run_id", F.col("as_of_date").cast("string").alias("as_of_date")).agg(
        F.count(F.lit(1)).alias("rows"), rnd(F.sum("avg_iv"), 3).alias("iv_sum")
    )


@add("signal_sinks", """
SELECT 'csv' AS sink, COUNT(*) AS rows, COUNT(DISTINCT c_mktsegment) AS labels FROM customer UNION ALL SELECT 'json', COUNT(*), COUNT(DISTINCT c_mktsegment) FROM customer""")
def signal_sinks(spark, sf_dir):
    """Signals written as CSV and JSON and read back."""
    from ..session import run_folder

    base = run_folder(spark, "sinks")
    rows = data.table(spark, sf_dir, "customer").select(F.col("c_name").alias("ticker"), F.col("c_mktsegment").alias("direction"), F.col("c_acctbal").alias("confidence"))
    logs.write_summary_csv(rows, f"{base}/csv")
    logs.write_signals_json(rows, f"{base}/json")
    back = {
        "csv": spark.read.option("header", True).schema("ticker string, direction string, confidence double").csv(f"{base}/csv"),
        "json": spark.read.schema("ticker string, direction string, confidence double").json(f"{base}/json"),
    }
    one, two = [
        df.agg(F.lit(name).alias("sink"), F.count(F.lit(1)).alias("rows"), F.count_distinct("direction").alias("labels")) for name, df in back.items()
    ]
    return one.unionAll(two)


@add("event_kinds", with_(NEWS, select="""
SELECT CASE WHEN CONTAINS(LOWER(title), 'trump') OR CONTAINS(LOWER(title), 'tariff') OR CONTAINS(LOWER(title), 'executive order') OR CONTAINS(LOWER(title), 'presidential action') OR CONTAINS(LOWER(title), 'memorandum') THEN 'trump_admin' ELSE 'policy' END AS kind, COUNT(*) AS events FROM news GROUP BY 1"""))
def event_kinds(spark, sf_dir):
    return data.news(spark, sf_dir).groupBy(event_kind(F.col("title")).alias("kind")).agg(F.count(F.lit(1)).alias("events"))


# --------------------------------------------------------------------------- ledgers
def paper_inputs(spark, sf_dir):
    """A stored ledger (some customers) and this run's signals (others)."""
    c = data.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    sides = F.array(*[F.lit(x) for x in ("bullish", "neutral_to_bullish", "neutral", "neutral_to_bearish", "bearish", "avoid")])
    ticker = F.concat(F.lit("T"), k.cast("string"))
    then = F.lit("2024-01-01 00:00:00").cast("timestamp")
    book = c.where(k % 3 == 0).select(
        ticker.alias("ticker"), F.when(k % 2 == 0, "long").otherwise("short").alias("side"), (50 + k % 70).cast("double").alias("entry_price"),
        F.lit(10.0).alias("quantity"), ((50 + k % 70) * 10).cast("double").alias("notional"), then.alias("opened_at"),
        F.lit("bullish").alias("entry_direction"), (50 + k % 70).cast("double").alias("last_price"), then.alias("last_marked_at"),
        F.lit(0.0).alias("unrealized_pnl_pct"), F.lit(0.0).alias("unrealized_pnl_dollars"), F.lit("bullish").alias("latest_direction"),
    )
    run = c.where(k % 5 != 1).select(
        ticker.alias("ticker"), F.when(k % 11 != 0, (40 + k % 90).cast("double")).alias("current_price"),
        F.element_at(sides, (k % 6 + 1).cast("int")).alias("direction"), (k % 13 == 0).alias("block_trade"),
        F.lit(60.0).alias("opportunity_score"), F.lit(60.0).alias("confidence_score"),
    )
    return book, run


PAPER = f"""bk AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'long' ELSE 'short' END AS side, (50 + c_custkey % 70)::DOUBLE AS ep FROM customer WHERE c_custkey % 3 = 0),
sg AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 11 <> 0 THEN (40 + c_custkey % 90)::DOUBLE END AS px, ['bullish', 'neutral_to_bullish', 'neutral', 'neutral_to_bearish', 'bearish', 'avoid'][c_custkey % 6 + 1] AS dir, c_custkey % 13 = 0 AS blk FROM customer WHERE c_custkey % 5 <> 1),
pj AS (SELECT COALESCE(b.k, s.k) AS k, b.side, b.ep, s.px, s.dir, s.blk, b.ep IS NULL AND s.px IS NOT NULL AND s.dir IN ('bullish', 'neutral_to_bullish', 'neutral_to_bearish', 'bearish') AND NOT s.blk AS opens FROM bk b FULL JOIN sg s ON b.k = s.k),
pk AS (SELECT *, CASE WHEN opens THEN CASE WHEN dir IN ('bullish', 'neutral_to_bullish') THEN 'long' ELSE 'short' END ELSE side END AS sd, CASE WHEN opens THEN px ELSE ep END AS entry, CASE WHEN opens THEN {rs('1000 / px', 6)} ELSE 10 END AS qty FROM pj),
pl AS (SELECT *, CASE WHEN opens THEN {rs('qty * px', 2)} ELSE ep * 10 END AS notional, CASE WHEN sd = 'long' THEN 1 ELSE -1 END * (px / entry - 1) * 100 AS pct FROM pk WHERE entry IS NOT NULL)"""


@add("paper_ledger", with_(PAPER, select=f"""
SELECT 'T' || CAST(k AS VARCHAR) AS ticker, sd AS side, {r('entry')} AS entry_price, {r('qty')} AS quantity, {r('notional')} AS notional, CASE WHEN opens THEN '2024-02-01 00:00:00' ELSE '2024-01-01 00:00:00' END AS opened_at, {r('COALESCE(px, ep)')} AS last_price,
  CASE WHEN px IS NULL THEN 0 ELSE {rs('pct', 2)} END AS unrealized_pnl_pct, CASE WHEN px IS NULL THEN 0 ELSE {rs('notional * pct / 100', 2)} END AS unrealized_pnl_dollars, CASE WHEN px IS NULL THEN 'bullish' ELSE dir END AS latest_direction FROM pl"""))
def paper_ledger(spark, sf_dir):
    book, run = paper_inputs(spark, sf_dir)
    df = ledger.update_paper(book, run, F.lit("2024-02-01 00:00:00").cast("timestamp"))
    return df.select(
        "ticker", "side", "entry_price", "quantity", "notional", "opened_at", "last_price", "unrealized_pnl_pct", "unrealized_pnl_dollars", "latest_direction"
    )


def manual_trades(spark, sf_dir):
    k = F.col("o_orderkey")
    option = k % 4 == 0
    return data.table(spark, sf_dir, "orders").select(
        k.cast("string").alias("id"),
        F.concat(F.lit("Brand#"), (1 + F.col("o_custkey") % 25).cast("string")).alias("ticker"),
        F.when(option, "option").otherwise("equity").alias("instrument_type"),
        F.when(option, F.concat(F.lit("C"), (k % 2500).cast("string"))).alias("option_contract"),
        F.when(k % 2 == 0, "long").otherwise("short").alias("side"),
        (F.col("o_totalprice") / 1000).alias("entry_price"),
        (1 + k % 9).cast("double").alias("quantity"),
        F.when(option, 100.0).alias("contract_multiplier"),
    )


@add("manual_ledger_mark", with_(BARS, CHAIN, f"""mq AS (SELECT UPPER(ticker) AS symbol, close AS price FROM bars WHERE pos = n UNION ALL SELECT 'C' || CAST(contract_id AS VARCHAR), {r('(bid + ask) / 2', 4)} FROM chain),
mt AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 'C' || CAST(o_orderkey % 2500 AS VARCHAR) ELSE 'BRAND#' || CAST(1 + o_custkey % 25 AS VARCHAR) END AS symbol, o_totalprice / 1000 AS entry, (1 + o_orderkey % 9)::DOUBLE AS qty, CASE WHEN o_orderkey % 4 = 0 THEN 100 ELSE 1 END AS mult, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS sgn FROM orders)""", select=f"""
SELECT CAST(k AS VARCHAR) AS id, {rs('price', 4)} AS current_price, {rs('sgn * (price / entry - 1) * 100', 2)} AS unrealized_pnl_pct, {rs('entry * qty * mult * (sgn * (price / entry - 1) * 100) / 100', 2)} AS unrealized_pnl_dollars FROM mt LEFT JOIN mq ON mq.symbol = mt.symbol"""))
def manual_ledger_mark(spark, sf_dir):
    from ..operators.options import option_mark

    quotes = signals.latest_change(data.numbered_bars(spark, sf_dir), "ticker").select(F.col("ticker").alias("symbol"), F.col("current_price").alias("price"))
    chain = data.chain(spark, sf_dir)
    marks = chain.select(F.concat(F.lit("C"), F.col("contract_id").cast("string")).alias("symbol"), option_mark(F.col("bid"), F.col("ask"), F.col("last")).alias("price"))
    df = ledger.mark_manual(manual_trades(spark, sf_dir), quotes.unionByName(marks))
    return df.select("id", "current_price", "unrealized_pnl_pct", "unrealized_pnl_dollars")


def change_inputs(spark, sf_dir):
    """Open trades of even customers, and one change per customer."""
    c = data.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    occ = F.concat(F.lit("AB240216C"), F.lpad((1000 * (50 + k % 40)).cast("string"), 8, "0"))
    text, num = F.lit(None).cast("string"), F.lit(None).cast("double")
    book = c.where(k % 2 == 0).select(
        k.cast("string").alias("id"), F.lit("AB").alias("ticker"), F.lit("equity").alias("instrument_type"), F.lit("AB").alias("underlying"),
        F.lit("").alias("option_contract"), F.lit("").alias("option_expiration"), F.lit("").alias("option_type"), F.lit(0.0).alias("option_strike"),
        F.lit(1.0).alias("contract_multiplier"), F.lit("long").alias("side"), (10 + k % 50).cast("double").alias("entry_price"),
        F.lit(2.0).alias("quantity"), ((10 + k % 50) * 2).cast("double").alias("notional"), F.lit("").alias("note"),
    )
    add_ = k % 2 == 1
    changes = c.where(k % 5 != 4).select(
        F.when(add_, "add").when(k % 3 == 0, "delete").otherwise("edit").alias("op"),
        F.when(k % 7 == 0, F.concat(F.lit("x"), k.cast("string"))).otherwise(k.cast("string")).alias("id"),
        F.when(add_, F.lit(" ab ")).alias("ticker"),
        F.when(add_ & (k % 3 == 0), "OPTION").when(add_, "equity").alias("instrument_type"),
        text.alias("underlying"),
        F.when(add_ & (k % 3 == 0), F.lower(occ)).alias("option_contract"),
        text.alias("option_expiration"),
        text.alias("option_type"),
        num.alias("option_strike"),
        num.alias("contract_multiplier"),
        F.when(k % 13 == 0, "sideways").when(add_, "Short").alias("side"),
        F.when(k % 17 == 0, F.lit(-1.0)).when(add_ | (k % 4 == 0), (20 + k % 30).cast("double")).alias("entry_price"),
        F.when(add_, 3.0).alias("quantity"),
        F.when(k % 6 == 0, " note ").alias("note"),
    )
    return book, changes


CHANGES = """ch AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 1 THEN 'add' WHEN c_custkey % 3 = 0 THEN 'delete' ELSE 'edit' END AS op, CASE WHEN c_custkey % 7 = 0 THEN 'x' ELSE '' END || CAST(c_custkey AS VARCHAR) AS id, c_custkey % 2 = 1 AND c_custkey % 3 = 0 AS opt,
   CASE WHEN c_custkey % 13 = 0 THEN 'sideways' WHEN c_custkey % 2 = 1 THEN 'short' END AS side, CASE WHEN c_custkey % 17 = 0 THEN -1 WHEN c_custkey % 2 = 1 OR c_custkey % 4 = 0 THEN 20 + c_custkey % 30 END::DOUBLE AS ep FROM customer WHERE c_custkey % 5 <> 4),
cj AS (SELECT *, CASE WHEN op <> 'add' AND c.k % 7 = 0 THEN 'trade_not_found' WHEN op = 'delete' THEN NULL WHEN side = 'sideways' THEN 'bad_side' WHEN ep <= 0 THEN 'bad_entry_price' END AS reject FROM ch c)"""


@add("ledger_changes", with_(CHANGES, select=f"""
SELECT CAST(b.c_custkey AS VARCHAR) AS id, 'AB' AS ticker, 'equity' AS instrument_type, '' AS option_expiration, {r('0')} AS option_strike, 'long' AS side, {r('COALESCE(c.ep, 10 + b.c_custkey % 50)')} AS entry_price, {r('COALESCE(c.ep, 10 + b.c_custkey % 50) * 2')} AS notional, CASE WHEN c.k IS NOT NULL AND b.c_custkey % 6 = 0 THEN 'note' ELSE '' END AS note
FROM customer b LEFT JOIN cj c ON c.id = CAST(b.c_custkey AS VARCHAR) AND c.reject IS NULL WHERE b.c_custkey % 2 = 0 AND COALESCE(c.op, 'keep') <> 'delete'
UNION ALL SELECT id, 'AB', CASE WHEN opt THEN 'option' ELSE 'equity' END, CASE WHEN opt THEN '2024-02-16' ELSE '' END, CASE WHEN opt THEN (50 + k % 40)::DOUBLE ELSE 0 END, 'short', ep, ep * 3 * CASE WHEN opt THEN 100 ELSE 1 END, '' FROM cj WHERE op = 'add' AND reject IS NULL"""))
def ledger_changes(spark, sf_dir):
    """Open trades after a batch of additions, edits and deletions."""
    kept, _ = ledger.apply_changes(*change_inputs(spark, sf_dir))
    return kept.select("id", "ticker", "instrument_type", "option_expiration", "option_strike", "side", "entry_price", "notional", "note")


@add("ledger_rejects", with_(CHANGES, select="SELECT id, op, reject FROM cj WHERE reject IS NOT NULL"))
def ledger_rejects(spark, sf_dir):
    _, rejected = ledger.apply_changes(*change_inputs(spark, sf_dir))
    return rejected.select("id", "op", "reject")


ALERTS = """al AS (SELECT o_orderkey AS k, 'Brand#' || CAST(1 + o_custkey % 25 AS VARCHAR) AS ticker, CASE o_orderkey % 3 WHEN 0 THEN 'bullish' WHEN 1 THEN 'bearish' ELSE 'neutral' END AS direction, 'P' || CAST(o_orderkey % 4 AS VARCHAR) AS severity, o_orderkey % 10 = 0 AS blk FROM orders),
ak AS (SELECT DISTINCT ticker, direction, severity, SUBSTRING(SHA1('2024-01-31|' || ticker || '|' || direction || '|' || severity), 1, 16) AS alert_key FROM al WHERE severity IN ('P0', 'P1') AND NOT blk)"""


@add("alert_selection", with_(ALERTS, select="SELECT alert_key, ticker, direction, severity FROM ak WHERE alert_key > '4'"))
def alert_selection(spark, sf_dir):
    """Severe signals not sent before; keys up to '4' count as sent."""
    k = F.col("o_orderkey")
    rows = data.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("Brand#"), (1 + F.col("o_custkey") % 25).cast("string")).alias("ticker"),
        F.when(k % 3 == 0, "bullish").when(k % 3 == 1, "bearish").otherwise("neutral").alias("direction"),
        F.concat(F.lit("P"), (k % 4).cast("string")).alias("severity"),
        (k % 10 == 0).alias("block_trade"),
    )
    day = F.lit("2024-01-31").cast("date")
    sent = rows.select(ledger.alert_key(day).alias("alert_key")).distinct().where(F.col("alert_key") <= "4")
    return ledger.select_alerts(rows, sent, day).select("alert_key", "ticker", "direction", "severity")


# --------------------------------------------------------------------------- summaries
@add("market_movers", with_(BARS, DELTA, select=f"""
SELECT ticker, {r('(close / pc - 1) * 100', 2)} AS day_change_pct FROM delta WHERE pos = n ORDER BY ABS({r('(close / pc - 1) * 100', 2)}) DESC, ticker LIMIT 5"""))
def market_movers(spark, sf_dir):
    return summaries.top_movers(signals.latest_change(data.numbered_bars(spark, sf_dir), "ticker"))


@add("news_coverage", with_(NEWS, select="""
SELECT COUNT(*) AS total_items, COUNT(DISTINCT ticker) AS keys, COUNT(DISTINCT provider) AS providers, strftime(MAX(published_at), '%Y-%m-%d %H:%M:%S') AS latest_published FROM news"""))
def news_coverage(spark, sf_dir):
    return summaries.feed_totals(data.news(spark, sf_dir))


@add("busiest_tickers", with_(NEWS, select="SELECT ticker, COUNT(*) AS items FROM news GROUP BY 1 ORDER BY items DESC, ticker LIMIT 5"))
def busiest_tickers(spark, sf_dir):
    return summaries.busiest(data.news(spark, sf_dir))


@add("coverage_by_source", with_(NEWS, select="SELECT provider, COUNT(*) AS items, strftime(MAX(published_at), '%Y-%m-%d %H:%M:%S') AS latest_published FROM news GROUP BY 1"))
def coverage_by_source(spark, sf_dir):
    return summaries.by_source(data.news(spark, sf_dir))


@add("strongest_mood", """
WITH s AS (SELECT 'Brand#' || CAST(1 + user_id % 25 AS VARCHAR) AS ticker, """ + rs("AVG(CASE WHEN event_type = 'purchase' THEN 1.0 WHEN event_type = 'error' THEN -1.0 ELSE 0.0 END)", 3) + """ AS net_sentiment FROM events GROUP BY 1)
SELECT ticker, net_sentiment FROM s ORDER BY ABS(net_sentiment) DESC, ticker LIMIT 10""")
def strongest_mood(spark, sf_dir):
    from ..functions.numeric import rnd_stable

    lean = F.when(F.col("event_type") == "purchase", 1.0).when(F.col("event_type") == "error", -1.0).otherwise(0.0)
    ticker = F.concat(F.lit("Brand#"), (1 + F.col("user_id") % 25).cast("string")).alias("ticker")
    mood = data.table(spark, sf_dir, "events").groupBy(ticker).agg(rnd_stable(F.avg(lean), 3).alias("net_sentiment"))
    return summaries.strongest_mood(mood)


@add("chain_coverage", with_(CHAIN, METRICS, select="SELECT ticker, COUNT(*) AS expiration_count, MIN(dte)::BIGINT AS nearest_dte, SUM(total_oi)::BIGINT AS total_oi FROM metrics GROUP BY 1"))
def chain_coverage(spark, sf_dir):
    return summaries.chain_coverage(expiry_metrics(spark, sf_dir))


REG = """rgy AS (SELECT lang AS "group", source, ['active', 'keyed', 'planned'][CAST(REGEXP_EXTRACT(source, '(\\d+)', 1) AS INT) % 3 + 1] AS status, MAX(CAST(REGEXP_EXTRACT(source, '(\\d+)', 1) AS INT) * 5)::BIGINT AS reliability_rank FROM documents GROUP BY 1, 2, 3)"""


def registry(spark, sf_dir):
    """Sources per language as a nested registry (a language lists its sources)."""
    docs = data.table(spark, sf_dir, "documents").select("lang", "source").distinct()
    place = F.regexp_extract("source", r"(\d+)", 1).cast("int")
    states = F.array(*[F.lit(s) for s in ("active", "keyed", "planned")])
    meta = F.struct(F.element_at(states, place % 3 + 1).alias("status"), (place * 5).cast("long").alias("reliability_rank"))
    entries = F.collect_list(F.struct("source", meta.alias("meta")))
    return docs.groupBy(F.col("lang").alias("group")).agg(F.map_from_entries(entries).alias("sources"))


@add("source_registry", with_(REG, select='SELECT "group", source, status, reliability_rank FROM rgy'))
def source_registry(spark, sf_dir):
    return summaries.registry_rows(registry(spark, sf_dir))


@add("registry_status", with_(REG, select="SELECT status, COUNT(*) AS sources FROM rgy GROUP BY 1"))
def registry_status(spark, sf_dir):
    return summaries.registry_status(summaries.registry_rows(registry(spark, sf_dir)))


SIGS = """sgs AS (SELECT 'T' || CAST(c_custkey AS VARCHAR) AS ticker, ['bullish', 'neutral_to_bullish', 'neutral', 'neutral_to_bearish', 'bearish', 'avoid'][c_custkey % 6 + 1] AS direction, (c_custkey * 7 % 101)::DOUBLE AS confidence, (c_custkey * 11 % 101)::DOUBLE AS opportunity_score,
   ['low', 'medium', 'high', 'extreme'][c_custkey % 4 + 1] AS risk_level FROM customer)"""


def stored_signals(spark, sf_dir):
    k = F.col("c_custkey")
    sides = F.array(*[F.lit(x) for x in ("bullish", "neutral_to_bullish", "neutral", "neutral_to_bearish", "bearish", "avoid")])
    levels = F.array(*[F.lit(x) for x in ("low", "medium", "high", "extreme")])
    return data.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("T"), k.cast("string")).alias("ticker"), F.element_at(sides, (k % 6 + 1).cast("int")).alias("direction"),
        (k * 7 % 101).cast("double").alias("confidence"), (k * 11 % 101).cast("double").alias("opportunity_score"),
        F.element_at(levels, (k % 4 + 1).cast("int")).alias("risk_level"),
    )


@add("top_ideas", with_(SIGS, select=f"""
SELECT ticker, direction, {r('confidence')} AS confidence, {r('opportunity_score')} AS opportunity_score, risk_level FROM sgs WHERE direction IN ('bullish', 'neutral_to_bullish') AND confidence >= 65 AND risk_level IN ('low', 'medium') ORDER BY opportunity_score DESC, ticker LIMIT 5"""))
def top_ideas(spark, sf_dir):
    return summaries.top_ideas(stored_signals(spark, sf_dir))


@add("run_summary", with_(SIGS, select=f"SELECT ticker, direction, {r('confidence')} AS confidence, {r('opportunity_score')} AS opportunity_score, risk_level FROM sgs ORDER BY opportunity_score DESC, ticker LIMIT 5"))
def run_summary(spark, sf_dir):
    return summaries.summary(stored_signals(spark, sf_dir))


@add("portfolio_review", with_(SIGS, select=f"""
SELECT 'T' || CAST(o.o_custkey % 2000 AS VARCHAR) AS ticker, o.o_orderkey AS lot, CASE WHEN s.ticker IS NULL THEN 'no_current_signal' WHEN direction IN ('bearish', 'neutral_to_bearish', 'avoid') THEN 'consider_trimming' WHEN direction IN ('bullish', 'neutral_to_bullish') AND confidence >= 65 THEN 'supported' ELSE 'hold_or_watch' END AS stance
FROM (SELECT o_orderkey, o_custkey * 2 AS o_custkey FROM orders) o LEFT JOIN sgs s ON s.ticker = 'T' || CAST(o.o_custkey % 2000 AS VARCHAR)"""))
def portfolio_review(spark, sf_dir):
    held = data.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("t"), (F.col("o_custkey") * 2 % 2000).cast("string")).alias("ticker"), F.col("o_orderkey").alias("lot")
    )
    return summaries.portfolio_review(held, stored_signals(spark, sf_dir)).select("ticker", "lot", "stance")


@add("index_listing", with_(INDEX_BARS, f"""il AS (SELECT index_name, {r('close', 2)} AS last, {r('(close / LAG(close) OVER (PARTITION BY index_name ORDER BY date) - 1) * 100', 2)} AS chg, pos, n FROM index_bars)""", select="""
SELECT CASE WHEN LENGTH(index_name) > 6 THEN 'wide' ELSE 'narrow' END AS region, COUNT(*) AS indexes, STRING_AGG(index_name || '=' || printf('%.2f', last) || '/' || printf('%.2f', chg), '; ' ORDER BY index_name) AS entries FROM il WHERE pos = n GROUP BY 1"""))
def index_listing(spark, sf_dir):
    quotes = signals.latest_change(data.numbered_index_bars(spark, sf_dir), "index_name")
    name = F.col("r_name")
    regions = data.table(spark, sf_dir, "region").select(name.alias("index_name"), F.when(F.length(name) > 6, "wide").otherwise("narrow").alias("region"))
    df = summaries.index_listing(quotes, regions)
    text = F.transform("entries", lambda e: F.format_string("%s=%.2f/%.2f", e["index_name"], e["last"], e["day_change_pct"]))
    return df.select("region", "indexes", text.alias("entries"))
