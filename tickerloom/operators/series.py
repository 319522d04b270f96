"""Ordered series split into bounded blocks.

A series (one ticker's bars) can hold any share of the table, so no window here
is keyed by the ticker alone.  `with_positions` numbers the rows of a series from
per-month counts, `blocks` cuts the numbered series into fixed-size blocks and
copies the rows a look-back needs into the next block.  Every later window runs on
(ticker, block), so the largest task is the block size, never the series, and one
exchange serves all indicators.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

MIN_BLOCK = 1024
# weight below which an exponential tail no longer changes a double
TAIL_WEIGHT = 2.0**-60
# exp() argument kept inside the double range
EXP_RANGE = 650.0


def with_positions(
    df: DataFrame,
    key: str = "ticker",
    order: str = "date",
    sums: dict[str, Column] | None = None,
) -> DataFrame:
    """Add `pos` (1-based), `n` (series length) and running totals.

    Counts and totals per calendar month are aggregated map-side; only the month
    table is prefix-summed per key.  Rows are then numbered inside their month.
    """
    sums = sums or {}
    df = df.withColumn("_chunk", F.trunc(F.col(order).cast("date"), "MM"))
    chunk = df.groupBy(key, "_chunk").agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()]
    )
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(key)
    chunk = chunk.select(
        key,
        "_chunk",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        F.sum("_rows").over(whole).alias("n"),
        *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_base_{n}") for n in sums],
    )
    inside = Window.partitionBy(key, "_chunk").orderBy(order)
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    out = df.join(chunk, [key, "_chunk"])
    out = out.withColumn("pos", (F.col("_before") + F.row_number().over(inside)).cast("long"))
    for name, column in sums.items():
        out = out.withColumn(name, F.col(f"_base_{name}") + F.sum(column).over(running))
    return out.drop("_chunk", "_before", *[f"_base_{n}" for n in sums])


def blocks(df: DataFrame, lookback: int, ahead: int = 0, size: int | None = None) -> DataFrame:
    """Assign rows to blocks, repeating the rows that neighbours need.

    Adds `_block` (where the row is computed), `_own` (false for repeated rows) and
    `_k` (0-based place inside the block).
    """
    size = size or max(MIN_BLOCK, 4 * max(lookback, ahead))
    if lookback > size or ahead > size:
        raise ValueError("a block must be at least as long as its look-back")
    home = F.floor((F.col("pos") - 1) / F.lit(size)).cast("long")
    offset = (F.col("pos") - 1) % F.lit(size)
    last = F.floor((F.col("n") - 1) / F.lit(size)).cast("long")
    copies = [home]
    if lookback:
        copies.append(F.when((offset >= size - lookback) & (home < last), home + 1))
    if ahead:
        copies.append(F.when((offset < ahead) & (home > 0), home - 1))
    out = df.withColumn("_block", F.explode(F.array_compact(F.array(*copies))))
    start = F.greatest(F.lit(1), F.col("_block") * size + 1 - lookback)
    return out.withColumn("_own", home == F.col("_block")).withColumn("_k", F.col("pos") - start)


def tail(df: DataFrame, rows: int) -> DataFrame:
    """Only the newest `rows` of each series, as one block.

    For results on the latest bar: the filter runs before the window exchange, so
    a series contributes a fixed number of rows whatever its length.
    """
    start = F.greatest(F.lit(1), F.col("n") - rows + 1)
    return (
        df.where(F.col("pos") >= start)
        .withColumn("_block", F.lit(0).cast("long"))
        .withColumn("_own", F.lit(True))
        .withColumn("_k", F.col("pos") - start)
    )


def ordered(key: str = "ticker") -> WindowSpec:
    return Window.partitionBy(key, "_block").orderBy("pos")


def last(n: int, key: str = "ticker") -> WindowSpec:
    """Frame of the current row and the n-1 rows before it."""
    return ordered(key).rowsBetween(-(n - 1), 0)


def full(expr: Column, rows: int) -> Column:
    """NULL until the series holds `rows` rows."""
    return F.when(F.col("pos") >= rows, expr)


#: from so many rows on a window is put together from two parts instead of being run through for every row
LONG_WINDOW = 50


def add_sliding(df: DataFrame, source: str, n: int, names: dict[str, str], key: str = "ticker") -> DataFrame:
    """Statistics of the last n rows (fewer at the start of the series): mean, var, max or count, by the names given.

    The series is cut into segments of n rows.  A window of n rows is the end of one
    segment and the beginning of the next, so running statistics from both ends of every
    segment give each window by one merge of two parts (count, mean, squared deviations,
    maximum), whatever n is.  Both parts hold rows of the window only and are sums of
    differences from a row of theirs: values outside the window leave no rounding behind,
    and equal values have their own mean and no deviation.  Segments follow the positions,
    so that blocks and tails of a series give the same doubles.
    """
    df = df.withColumn("_segment", F.floor((F.col("pos") - 1) / F.lit(n)))
    part = Window.partitionBy(key, "_block", "_segment")
    moments = "mean" in names or "var" in names
    for side, order in (("head", F.asc("pos")), ("rest", F.desc("pos"))):
        running = part.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        found = {f"_{side}_max": F.max(source).over(running)} if "max" in names else {}
        if moments:
            df = df.withColumn(f"_{side}_ref", F.first(source, ignorenulls=True).over(running))
            found[f"_{side}_off"] = F.avg(F.col(source) - F.col(f"_{side}_ref")).over(running)
        if "var" in names:
            found[f"_{side}_var"] = F.var_pop(source).over(running)
        df = df.withColumns({**found, f"_{side}_count": F.count(source).over(running)})
        if moments:
            df = df.withColumn(f"_{side}_mean", F.col(f"_{side}_ref") + F.col(f"_{side}_off"))
    kept = ["count", *(["mean"] if moments else []), *(x for x in ("var", "max") if x in names)]
    # the end of the earlier segment from the window's first row on; a whole segment is a window of its own
    df = df.withColumns({f"_old_{x}": F.lag(f"_rest_{x}", n - 1).over(ordered(key)) for x in kept})
    split = ((F.col("pos") - 1) % n != n - 1) & (F.coalesce(F.col("_old_count"), F.lit(0)) > 0)
    alone = ~split
    n1, n2 = F.col("_old_count"), F.col("_head_count")
    total = n1 + n2
    out = {"count": F.when(alone, n2).otherwise(total)}
    if moments:
        apart = F.col("_head_mean") - F.col("_old_mean")
        out["mean"] = F.when(alone, F.col("_head_mean")).when(n2 == 0, F.col("_old_mean")).otherwise(F.col("_old_mean") + apart * n2 / total)
    if "var" in names:
        both = (F.col("_old_var") * n1 + F.col("_head_var") * n2 + apart * apart * n1 * n2 / total) / total
        out["var"] = F.when(alone, F.col("_head_var")).when(n2 == 0, F.col("_old_var")).otherwise(both)
    if "max" in names:
        out["max"] = F.when(alone, F.col("_head_max")).otherwise(F.greatest("_old_max", "_head_max"))
    helpers = [f"_{side}_{x}" for side in ("head", "rest", "old") for x in ("ref", "off", "mean", "var", "max", "count")]
    return df.withColumns({name: out[x] for x, name in names.items()}).drop("_segment", *helpers)


def add_rolling_means(df: DataFrame, source: str, *lengths: int, key: str = "ticker", prefix: str = "_mean_") -> DataFrame:
    """Means of the last n rows (fewer at the start of the series); equal values have their own mean, without rounding."""
    short = {}
    for n in lengths:
        if n >= LONG_WINDOW:
            df = add_sliding(df, source, n, {"mean": f"{prefix}{n}"}, key)
        else:
            w = last(n, key)
            flat = F.min(source).over(w) == F.max(source).over(w)
            short[f"{prefix}{n}"] = F.when(flat, F.col(source)).otherwise(F.avg(source).over(w))
    return df.withColumns(short)


def own_rows(df: DataFrame) -> DataFrame:
    return df.where("_own").drop("_own", "_block", "_k")


def latest(df: DataFrame) -> DataFrame:
    return own_rows(df.where(F.col("pos") == F.col("n")))


def ema_lookback(span: int) -> int:
    """Rows after which an older value no longer changes the average."""
    return math.ceil(math.log(TAIL_WEIGHT) / math.log(1 - 2 / (span + 1)))


def ema_block(lookback: int, *spans: int) -> int:
    """Largest block whose scaled weights stay inside the double range."""
    size = int(min(EXP_RANGE / -math.log(1 - 2 / (s + 1)) for s in spans)) - lookback
    if size < lookback:
        raise ValueError("spans differ too much for one pass; compute them apart")
    return size


def add_emas(df: DataFrame, source: str, spans: dict[str, int], key: str = "ticker") -> DataFrame:
    """Exponential averages by name, seeded with the first value of the block.

    A running sum of values scaled by q^-k, scaled back by q^k: one streaming window, no
    lambda and no list.  The warm-up rows of a block make the seed's weight vanish.
    Values enter as differences from the seed, so that a flat series stays exactly flat.
    """
    frame = ordered(key).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_seed", F.first(source).over(frame))
    out = {}
    for name, span in spans.items():
        alpha = 2 / (span + 1)
        rate = -math.log(1 - alpha)
        weight = F.when(F.col("_k") == 0, F.lit(1.0)).otherwise(F.lit(alpha))
        scaled = F.sum((F.col(source) - F.col("_seed")) * weight * F.exp(F.col("_k") * rate)).over(frame)
        out[name] = F.col("_seed") + scaled * F.exp(-F.col("_k") * rate)
    return df.withColumns(out).drop("_seed")
