"""Exact percentiles of groups of any size, by narrowing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: parts of a sketch's grid, and its accuracy (the rank error is far below one part)
PARTS, ACCURACY = 256, 10_000


def exact_percentiles(df: DataFrame, key: str, value: str, fractions: dict[str, float], small: int = 10_000) -> DataFrame:
    """key, rows and a column for each fraction: the linearly interpolated percentile of the known values.

    The two ranks around a percentile are looked for separately.  A mergeable sketch of
    the values in a rank's interval gives a grid of `PARTS` values; the rank lies between
    the grid points two parts away on either side, so the next interval holds about a
    fiftieth of the rows, counted exactly.  That repeats until an interval holds one
    value or no more than `small` rows, and only those are ranked.  A rank that falls on an
    end of its new interval is settled, so repeated values end the search as well.  No pass gathers a
    group, and each is a map-side combined aggregate.
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(key, F.col(value).cast("double").alias("_v"))
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    places = [(F.col("rows") - 1) * F.lit(f) for f in fractions.values()]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p), F.ceil(p)) for p in places])))
    state = sizes.select(key, F.explode(ranks).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("rows").alias("held"))
    state = cut_lineage(state)
    columns = [key, "rank", "lo", "hi", "below", "held"]
    while True:
        unsettled = (F.col("held") > small) & (F.col("lo") < F.col("hi"))
        wide = state.where(unsettled)
        if wide.isEmpty():
            break
        state = cut_lineage(state.where(~unsettled).select(*columns).unionByName(narrowed(rows, wide, key).select(*columns)))

    settled = state.where(F.col("lo") == F.col("hi")).select(key, "rank", F.col("lo").alias("at"))
    few = state.where(F.col("lo") < F.col("hi"))
    inside = rows.join(few, key).where(F.col("_v").between(F.col("lo"), F.col("hi")))
    order = Window.partitionBy(key, "rank").orderBy("_v")  # no more than `small` rows
    ranked = inside.withColumn("_place", F.row_number().over(order)).where(F.col("_place") == F.col("rank") - F.col("below") + 1)
    found = settled.unionByName(ranked.select(key, "rank", F.col("_v").alias("at")))

    out = sizes.select(key, "rows")
    for name, fraction in fractions.items():
        place = (F.col("rows") - 1) * F.lit(fraction)
        for side, rank in (("_low", F.floor(place)), ("_high", F.ceil(place))):
            at = found.select(key, F.col("rank").alias(f"{side}_rank"), F.col("at").alias(side))
            out = out.withColumn(f"{side}_rank", rank).join(at, [key, f"{side}_rank"])
        mixed = F.col("_low") + (F.col("_high") - F.col("_low")) * (place - F.floor(place))
        out = out.withColumn(name, mixed).drop("_low", "_high", "_low_rank", "_high_rank")
    return out


def narrowed(rows: DataFrame, wide: DataFrame, key: str) -> DataFrame:
    """Smaller intervals around the same ranks, with the rows below and inside them counted."""
    grid = [k / PARTS for k in range(PARTS + 1)]
    inside = rows.join(wide, key).where(F.col("_v").between(F.col("lo"), F.col("hi")))
    sketch = inside.groupBy(key, "rank").agg(F.percentile_approx("_v", grid, ACCURACY).alias("_grid"))
    part = F.floor((F.col("rank") - F.col("below")) * PARTS / F.col("held"))
    at = wide.join(sketch, [key, "rank"]).withColumns({"_from": F.greatest(F.lit(0), part - 2), "_to": F.least(F.lit(PARTS), part + 3)})
    # the ends of the grid are the ends of the interval
    lo = F.when(F.col("_from") == 0, F.col("lo")).otherwise(F.get("_grid", F.col("_from").cast("int")))
    hi = F.when(F.col("_to") == PARTS, F.col("hi")).otherwise(F.get("_grid", F.col("_to").cast("int")))
    ends = at.select(key, "rank", "below", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), lo.alias("lo"), hi.alias("hi"))
    here = F.col("_v")
    counted = rows.join(ends, key).where(here.between(F.col("_lo"), F.col("_hi"))).groupBy(key, "rank").agg(
        F.max("below").alias("_below"),
        F.max("lo").alias("_a"),
        F.max("hi").alias("_b"),
        F.count(F.when(here < F.col("lo"), 1)).alias("_less"),
        F.count(F.when(here == F.col("lo"), 1)).alias("_at"),
        F.count(F.when((here > F.col("lo")) & (here < F.col("hi")), 1)).alias("_mid"),
        F.min(F.when((here > F.col("lo")) & (here < F.col("hi")), here)).alias("_min"),
        F.max(F.when((here > F.col("lo")) & (here < F.col("hi")), here)).alias("_max"),
    )
    # the rank is at one end, which settles it, or strictly between: every pass loses the ends at least
    place = F.col("rank") - F.col("_below") - F.col("_less")
    low, mid = place < F.col("_at"), place < F.col("_at") + F.col("_mid")
    return counted.select(
        key,
        "rank",
        F.when(low, F.col("_a")).when(mid, F.col("_min")).otherwise(F.col("_b")).alias("lo"),
        F.when(low, F.col("_a")).when(mid, F.col("_max")).otherwise(F.col("_b")).alias("hi"),
        (F.col("_below") + F.col("_less") + F.when(~low & mid, F.col("_at")).otherwise(0)).alias("below"),
        F.when(~low & mid, F.col("_mid")).otherwise(F.col("_at")).alias("held"),
    )
