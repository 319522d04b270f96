"""The derived tables as SQL text, for the side-by-side check in DuckDB."""

from __future__ import annotations


def r(expr: str, digits: int = 6) -> str:
    """Half-even rounding of the scaled double, as `numeric.rnd` does."""
    scale = f"1e{digits}"
    return f"(round_even(({expr})::DOUBLE * {scale}, 0) / {scale} + 0::DOUBLE)"


def rs(expr: str, digits: int) -> str:
    """Rounded twice, as `numeric.rnd_stable`."""
    return r(r(expr, 9), digits)


def clip(expr: str, lo: float = 0, hi: float = 100) -> str:
    return f"(CASE WHEN ({expr}) IS NOT NULL THEN GREATEST({lo}, LEAST({hi}, ({expr}))) END)"


def _walk(key: str, source: str) -> str:
    return f"""
  SELECT {key}, date, wick, volume, ret_micro,
         ROUND(100 * EXP(CAST(SUM(ret_micro) OVER (PARTITION BY {key} ORDER BY date
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) / 1000000::DOUBLE), 4) AS close
  FROM {source}"""


def _bars(name: str, key: str, key_expr: str, joins: str) -> str:
    return f"""{name}_d AS (
  SELECT {key_expr} AS {key}, CAST(l.l_shipdate AS DATE) AS date,
         CAST(FLOOR(CAST(6000 * SUM(CAST(ROUND(l.l_discount * 100) AS BIGINT)) AS DOUBLE) / COUNT(*)) AS BIGINT) - 30000 AS ret_micro,
         CAST(SUM(CAST(ROUND(l.l_tax * 100) AS BIGINT)) AS DOUBLE) / CAST(1000 * COUNT(*) AS DOUBLE) AS wick,
         SUM(l.l_quantity) * 100000 AS volume
  FROM lineitem l {joins} GROUP BY 1, 2),
{name}_c AS ({_walk(key, name + '_d')}),
{name}_o AS (SELECT *, COALESCE(LAG(close) OVER (PARTITION BY {key} ORDER BY date), 100::DOUBLE) AS open FROM {name}_c),
{name} AS (
  SELECT {key}, date, open, GREATEST(open, close) * (1 + wick) AS high,
         LEAST(open, close) * (1 - wick) AS low, close, volume,
         ROW_NUMBER() OVER (PARTITION BY {key} ORDER BY date) AS pos,
         COUNT(*) OVER (PARTITION BY {key}) AS n
  FROM {name}_o)"""


BARS = _bars("bars", "ticker", "p.p_brand", "JOIN part p ON l.l_partkey = p.p_partkey")
INDEX_BARS = _bars(
    "index_bars",
    "index_name",
    "r.r_name",
    "JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation na ON s.s_nationkey = na.n_nationkey "
    "JOIN region r ON na.n_regionkey = r.r_regionkey",
)
BENCH = _bars("bench", "symbol", "'MARKET'", "")

CHAIN = """chain AS (
SELECT p.p_brand AS ticker, 7 * (1 + p.p_size % 8) AS dte,
       CASE WHEN p.p_partkey % 2 = 0 THEN 'C' ELSE 'P' END AS "right",
       p.p_partkey AS contract_id, (80 + p.p_partkey % 41)::DOUBLE AS strike,
       ROUND((1.5 + (p.p_partkey % 17) * 0.25)::DOUBLE, 2) AS last,
       ROUND((1.5 + (p.p_partkey % 17) * 0.25)::DOUBLE * 0.97::DOUBLE, 4) AS bid,
       ROUND((1.5 + (p.p_partkey % 17) * 0.25)::DOUBLE * (1.01::DOUBLE + (p.p_partkey % 5) * 0.04::DOUBLE), 4) AS ask,
       SUM(l.l_quantity) AS volume, COUNT(*) * 40 AS oi,
       0.15::DOUBLE + (p.p_partkey % 37) * 0.02::DOUBLE AS iv, 100::DOUBLE AS spot
FROM part p JOIN lineitem l ON l.l_partkey = p.p_partkey GROUP BY p.p_brand, p.p_size, p.p_partkey)"""

PREDICTIONS = """predictions AS (
SELECT o_orderkey AS prediction_id, CAST(o_orderdate AS DATE) AS as_of,
       'Brand#' || CAST(1 + o_custkey % 25 AS VARCHAR) AS ticker,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'bullish' WHEN '2-HIGH' THEN 'neutral_to_bullish'
            WHEN '3-MEDIUM' THEN 'neutral' WHEN '4-NOT SPECIFIED' THEN 'neutral_to_bearish' ELSE 'bearish' END AS direction,
       CASE o_orderkey % 3 WHEN 0 THEN '1D' WHEN 1 THEN '5D' ELSE '20D' END AS horizon,
       CAST((o_orderkey * 37) % 101 AS DOUBLE) AS confidence_score,
       CAST(60 + o_orderkey % 81 AS DOUBLE) AS entry_price FROM orders)"""

IV_SNAPSHOTS = """iv_snapshots AS (
SELECT CAST(user_id AS VARCHAR) AS ticker, event_id AS seq, ts AS as_of,
       CASE WHEN event_id % 3 = 0 THEN '2024-03-15' ELSE '2024-02-16' END AS expiration,
       ROUND(20 + value / 10, 4) AS avg_iv FROM events)"""

NEWS = """news AS (
SELECT d.doc_id AS news_id, d.text AS title, d.source AS provider,
       'Brand#' || CAST(1 + d.doc_id % 25 AS VARCHAR) AS ticker,
       CASE WHEN d.doc_id % 11 = 0 THEN NULL ELSE TIMESTAMP '2024-01-31 00:00:00' - (d.doc_id % 72) * INTERVAL '1' HOUR END AS published_at
FROM documents d)"""

COMPONENTS = """components AS (
SELECT c_custkey AS ticker, k.name,
       CAST((c_custkey * k.m + 13) % 101 AS DOUBLE) AS score, (c_custkey + k.m) % 7 <> 0 AS available
FROM customer CROSS JOIN (VALUES ('technical_structure',3),('price_volume_momentum',5),('fundamentals',11),('options_intelligence',17),
     ('macro_regime',19),('sentiment',23),('cross_market_correlation',29),('ensemble_forecast',31)) AS k(name, m))"""

ERF_SQL = (
    "(1::DOUBLE / (1::DOUBLE + 0.3275911::DOUBLE * (abs({x}) / sqrt(2::DOUBLE))))"
)


def norm_cdf(x: str) -> str:
    """The same rational approximation as `numeric.norm_cdf`."""
    t = ERF_SQL.format(x=x)
    poly = (
        f"(((((1.061405429::DOUBLE * {t}) + -1.453152027::DOUBLE) * {t} + 1.421413741::DOUBLE) * {t}"
        f" + -0.284496736::DOUBLE) * {t} + 0.254829592::DOUBLE) * {t}"
    )
    tail = f"({poly} * exp(-(({x}) * ({x})) / 2::DOUBLE) / 2::DOUBLE)"
    return f"(CASE WHEN ({x}) >= 0 THEN 1 - {tail} ELSE {tail} END)"


def with_(*parts: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(p.strip() for p in parts) + "\n" + select.strip()

MACRO = """macro_obs AS (
SELECT 'official' AS source, CASE o_orderpriority WHEN '1-URGENT' THEN 'vix' WHEN '2-HIGH' THEN 'yield_curve_10y_2y' WHEN '3-MEDIUM' THEN 'treasury_10y'
   WHEN '4-NOT SPECIFIED' THEN 'unemployment' ELSE 'fed_funds' END AS series, date,
   CASE WHEN h % 13 = 0 THEN '.' ELSE CAST(ROUND(lo + (hi - lo) * h / 10007, 4) AS VARCHAR) END AS value FROM (
 SELECT o_orderpriority, CAST(DATE_TRUNC('month', o_orderdate) AS DATE) AS date, SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT))::BIGINT % 10007 AS h,
   (CASE o_orderpriority WHEN '1-URGENT' THEN 10 WHEN '2-HIGH' THEN -1 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 3 ELSE 2 END)::DOUBLE AS lo,
   (CASE o_orderpriority WHEN '1-URGENT' THEN 35 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 6 WHEN '4-NOT SPECIFIED' THEN 7 ELSE 7 END)::DOUBLE AS hi
 FROM orders GROUP BY 1, 2)
UNION ALL
SELECT 'keyless', CASE o_orderstatus WHEN 'F' THEN 'wti_oil' WHEN 'O' THEN 'dollar_index' ELSE 'treasury_5y' END, date,
   CASE WHEN h % 13 = 0 THEN '.' ELSE CAST(ROUND(lo + (hi - lo) * h / 10007, 4) AS VARCHAR) END FROM (
 SELECT o_orderstatus, CAST(DATE_TRUNC('month', o_orderdate) AS DATE) AS date, SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT))::BIGINT % 10007 AS h,
   (CASE o_orderstatus WHEN 'F' THEN 55 WHEN 'O' THEN 98 ELSE 2.5 END)::DOUBLE AS lo, (CASE o_orderstatus WHEN 'F' THEN 100 WHEN 'O' THEN 112 ELSE 5.5 END)::DOUBLE AS hi
 FROM orders GROUP BY 1, 2))"""

GOV_EVENTS = """gov_events AS (
SELECT text AS title, source,
  CASE doc_id % 5 WHEN 0 THEN 'policy' WHEN 1 THEN 'trump_admin' WHEN 2 THEN 'fda' WHEN 3 THEN 'antitrust' ELSE 'fiscal' END AS kind,
  TIMESTAMP '2024-01-31 00:00:00' - (doc_id % 97) * INTERVAL '1' HOUR AS published_at, doc_id AS position FROM documents)"""

ASSETS = """assets AS (
SELECT 'Brand#' || CAST(1 + item_id % 25 AS VARCHAR) || '.' || CAST(item_id AS VARCHAR) AS ticker, text AS company_name,
  [['semiconductors','ai','cloud','energy','pharma'][item_id % 5 + 1], ['semiconductors','ai','cloud','energy','pharma'][(item_id + 2) % 5 + 1]] AS strategy_tags,
  item_id FROM benchmark)"""
