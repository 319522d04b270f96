"""Paper and manual ledgers, alert selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import rnd_stable
from .options import parse_occ
from .outcomes import side

NOTIONAL = 1000.0


def pnl_pct(entry: Column, price: Column, held: Column) -> Column:
    raw = F.coalesce((F.try_divide(price, entry) - 1) * 100, F.lit(0.0))
    return F.when(held == "long", raw).otherwise(-raw)


POSITION = ("side", "entry_price", "quantity", "notional", "opened_at", "entry_direction")


def update_paper(ledger: DataFrame, signals: DataFrame, now: Column, notional: float = NOTIONAL) -> DataFrame:
    """Ledger after one run: new positions opened once, every priced one marked.

    `ledger` and `signals` hold one row per ticker; their full-outer join is an
    equality on ticker, so no key carries more than two rows.
    """
    s = signals.select(
        "ticker",
        F.col("current_price").alias("_price"),
        F.col("direction").alias("_direction"),
        F.col("block_trade").alias("_blocked"),
        "opportunity_score",
        "confidence_score",
    )
    df = ledger.join(s, "ticker", "full_outer")
    price = F.nullif(F.col("_price"), F.lit(0.0))
    new_side = F.nullif(side(F.col("_direction")), F.lit("neutral"))
    opens = F.col("entry_price").isNull() & price.isNotNull() & new_side.isNotNull() & ~F.coalesce(F.col("_blocked"), F.lit(False))
    qty = rnd_stable(F.try_divide(F.lit(notional), price), 6)
    df = df.withColumn("_opens", opens).withColumn("_qty", qty)
    fresh = {
        "side": new_side,
        "entry_price": price,
        "quantity": F.col("_qty"),
        "notional": rnd_stable(F.col("_qty") * price, 2),
        "opened_at": now,
        "entry_direction": F.col("_direction"),
    }
    opened = {c: F.when(F.col("_opens"), fresh[c]).otherwise(F.col(c)) for c in POSITION}
    df = df.withColumns(opened).where(F.col("entry_price").isNotNull())
    marked = price.isNotNull()
    pct = pnl_pct(F.col("entry_price"), price, F.col("side"))
    return df.select(
        "ticker",
        *POSITION,
        F.when(marked, price).otherwise(F.col("last_price")).alias("last_price"),
        F.when(marked, now).otherwise(F.col("last_marked_at")).alias("last_marked_at"),
        F.when(marked, rnd_stable(pct, 2)).otherwise(F.col("unrealized_pnl_pct")).alias("unrealized_pnl_pct"),
        F.when(marked, rnd_stable(F.col("notional") * pct / 100, 2))
        .otherwise(F.col("unrealized_pnl_dollars"))
        .alias("unrealized_pnl_dollars"),
        F.when(marked, F.col("_direction")).otherwise(F.col("latest_direction")).alias("latest_direction"),
    )


PAPER_SCHEMA = (
    "ticker string, side string, entry_price double, quantity double, notional double, opened_at timestamp, "
    "entry_direction string, last_price double, last_marked_at timestamp, unrealized_pnl_pct double, "
    "unrealized_pnl_dollars double, latest_direction string"
)


def mark_manual(trades: DataFrame, quotes: DataFrame) -> DataFrame:
    """Manual trades with unrealised P/L; a trade without a quote keeps NULL.

    `quotes` is (symbol, price): the ticker of an equity or the contract of an option.
    """
    option = F.col("instrument_type") == "option"
    symbol = F.when(option, F.upper("option_contract")).otherwise(F.upper("ticker"))
    df = trades.withColumn("symbol", symbol).join(quotes.select(F.upper("symbol").alias("symbol"), F.nullif(F.col("price"), F.lit(0.0)).alias("_price")), "symbol", "left")
    pct = F.when(F.col("_price").isNotNull(), pnl_pct(F.col("entry_price"), F.col("_price"), F.col("side")))
    multiplier = F.coalesce(F.col("contract_multiplier"), F.when(option, 100.0).otherwise(1.0))
    dollars = F.col("entry_price") * F.col("quantity") * multiplier * pct / 100
    return (
        df.withColumn("current_price", rnd_stable(F.col("_price"), 4))
        .withColumn("unrealized_pnl_pct", rnd_stable(pct, 2))
        .withColumn("unrealized_pnl_dollars", rnd_stable(dollars, 2))
        .drop("_price", "symbol")
    )


LEDGER = (
    "id", "ticker", "instrument_type", "underlying", "option_contract", "option_expiration", "option_type",
    "option_strike", "contract_multiplier", "side", "entry_price", "quantity", "notional", "note",
)


def check_changes(changes: DataFrame, open_ids: DataFrame) -> DataFrame:
    """Changes with a `reject` reason, NULL for valid ones.

    `changes` has op (add, edit, delete), id and the trade fields; a NULL field of an
    edit leaves the value as it is.
    """
    known = open_ids.select("id", F.lit(True).alias("_known")).distinct()
    # one change for each trade: the first in the order of operation and fields; later ones are refused
    fields = [F.to_json(F.struct(*[c for c in changes.columns if c != "id"]))]
    nth = F.row_number().over(Window.partitionBy("id").orderBy("op", *fields))
    df = changes.withColumn("_nth", nth).join(known, "id", "left")
    add = F.col("op") == "add"
    given_side = F.lower(F.trim("side"))
    kind = F.lower(F.trim("instrument_type"))

    def wrong(column: str) -> Column:
        return F.when(add, ~F.coalesce(F.col(column) > 0, F.lit(False))).otherwise(F.coalesce(F.col(column) <= 0, F.lit(False)))

    reject = (
        F.when(F.col("_nth") > 1, "second_change")
        .when(~F.col("op").isin("add", "edit", "delete"), "unknown_operation")
        .when(~add & F.col("_known").isNull(), "trade_not_found")
        .when(add & F.col("_known").isNotNull(), "duplicate_id")
        .when(F.col("op") == "delete", F.lit(None))
        .when(F.when(add, ~F.coalesce(given_side.isin("long", "short"), F.lit(False))).otherwise(F.coalesce(~given_side.isin("long", "short"), F.lit(False))), "bad_side")
        .when(wrong("entry_price"), "bad_entry_price")
        .when(wrong("quantity"), "bad_quantity")
        .when(F.coalesce(~kind.isin("equity", "option"), F.lit(False)), "bad_instrument_type")
        .when(F.coalesce(F.col("contract_multiplier") <= 0, F.lit(False)), "bad_multiplier")
    )
    return df.withColumn("reject", reject).drop("_known", "_nth")


def apply_changes(ledger: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new open trades, rejected changes); at most one change per trade id."""
    checked = check_changes(changes, ledger)
    good = checked.where(F.col("reject").isNull())
    merged = ledger.select(*LEDGER[:-2], "note").join(
        good.select("id", F.col("op").alias("_op"), *[F.col(c).alias(f"_{c}") for c in LEDGER if c not in ("id", "notional")]),
        "id",
        "full_outer",
    )
    merged = merged.where(F.coalesce(F.col("_op"), F.lit("keep")) != "delete")

    def text(column: str, change: Column) -> Column:
        return F.coalesce(F.nullif(change, F.lit("")), F.col(column))

    kind = F.coalesce(F.lower(F.trim("_instrument_type")), F.col("instrument_type"), F.lit("equity"))
    df = merged.withColumn("instrument_type", kind)
    option = F.col("instrument_type") == "option"
    df = df.withColumn("ticker", text("ticker", F.upper(F.trim("_ticker"))))
    df = df.withColumn("underlying", F.coalesce(text("underlying", F.upper(F.trim("_underlying"))), F.col("ticker")))
    df = df.withColumn(
        "option_contract",
        F.when(option, F.upper(F.coalesce(F.nullif(text("option_contract", F.upper(F.trim("_option_contract"))), F.lit("")), F.col("ticker")))).otherwise(""),
    )
    parsed = parse_occ(F.col("option_contract"))
    empty, zero = F.lit(""), F.lit(0.0)
    df = df.withColumns(
        {
            "option_expiration": F.when(option, F.coalesce(text("option_expiration", F.trim("_option_expiration")), parsed["option_expiration"], empty)).otherwise(empty),
            "option_type": F.when(option, F.coalesce(text("option_type", F.lower(F.trim("_option_type"))), parsed["option_type"], empty)).otherwise(empty),
            "option_strike": F.when(option, F.coalesce("_option_strike", F.nullif(F.col("option_strike"), zero), parsed["option_strike"], zero)).otherwise(zero),
            "contract_multiplier": F.coalesce("_contract_multiplier", "contract_multiplier", F.when(option, 100.0).otherwise(1.0)),
            "side": F.coalesce(F.lower(F.trim("_side")), F.col("side")),
            "entry_price": F.coalesce("_entry_price", "entry_price"),
            "quantity": F.coalesce("_quantity", "quantity"),
            "note": F.coalesce(F.trim("_note"), F.col("note"), empty),
        }
    )
    df = df.withColumn("notional", rnd_stable(F.col("entry_price") * F.col("quantity") * F.col("contract_multiplier"), 2))
    return df.select(*LEDGER), checked.where(F.col("reject").isNotNull())


def alert_key(day: Column) -> Column:
    """One alert per day, ticker, direction and severity."""
    text = F.concat_ws("|", F.date_format(day, "yyyy-MM-dd"), "ticker", "direction", "severity")
    return F.substring(F.sha1(text), 1, 16)


def select_alerts(signals: DataFrame, sent: DataFrame | None, day: Column) -> DataFrame:
    """Severe, unblocked signals that were not sent yet, each key once."""
    df = signals.where(F.col("severity").isin("P0", "P1") & ~F.coalesce(F.col("block_trade"), F.lit(False)))
    df = df.withColumn("alert_key", alert_key(day))
    rest = [c for c in df.columns if c != "alert_key"]
    df = df.groupBy("alert_key").agg(F.min(F.struct(*rest)).alias("_a")).select("alert_key", "_a.*")
    return df if sent is None else df.join(sent.select("alert_key"), "alert_key", "left_anti")
