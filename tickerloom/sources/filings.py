"""Filings, company facts and identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# fixed values: material form types and the facts that are read
MATERIAL_FORMS = ("10-K", "10-Q", "8-K", "S-1", "DEF 14A", "13F-HR", "4")
FACT_TAGS = {
    "revenue": ("Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax"),
    "net_income": ("NetIncomeLoss",),
    "assets": ("Assets",),
    "liabilities": ("Liabilities",),
    "stockholders_equity": ("StockholdersEquity",),
    "cash": ("CashAndCashEquivalentsAtCarryingValue",),
}


def latest_facts(facts: DataFrame) -> DataFrame:
    """One wide row per company: newest value of each fact, USD before other units.

    The newest value per (company, tag) is a minimum over an ordered struct, so it
    combines map-side.
    """
    unit_rank = F.when(F.col("unit") == "USD", 0).otherwise(1)
    order = F.struct(unit_rank.alias("u"), (-F.unix_date("end")).alias("e"), "accession", "val")
    newest = facts.groupBy("cik", "tag").agg(F.min(order)["val"].alias("val"))
    tags = sorted({t for names in FACT_TAGS.values() for t in names})
    wide = newest.groupBy("cik").pivot("tag", tags).agg(F.first("val"))
    columns = []
    for name, names in FACT_TAGS.items():
        # a zero in the preferred tag counts as missing when another tag can serve
        parts = [F.nullif(F.col(t), F.lit(0.0)) if t != names[-1] else F.col(t) for t in names]
        columns.append(F.coalesce(*parts).alias(name))
    return wide.select("cik", *columns)


def padded_cik(tickers: DataFrame, lookup: DataFrame) -> DataFrame:
    """Ten-digit company number per ticker, NULL when unknown."""
    table = lookup.select(F.upper("ticker").alias("ticker"), F.lpad(F.col("cik_number").cast("string"), 10, "0").alias("cik"))
    return tickers.select(F.upper("ticker").alias("ticker")).join(table, "ticker", "left")


def material_filings(filings: DataFrame, look: int = 40, keep: int = 12) -> DataFrame:
    """Material forms among the first `look` filings of a company, at most `keep`."""
    by_place = Window.partitionBy("cik").orderBy("position")
    head = filings.withColumn("_p", F.row_number().over(by_place)).where(F.col("_p") <= look)
    kept = head.where(F.col("form").isin(*MATERIAL_FORMS)).withColumn("_k", F.row_number().over(by_place))
    kept = kept.where(F.col("_k") <= keep)
    path = F.concat(
        F.lit("https://www.sec.gov/Archives/edgar/data/"),
        F.col("cik").cast("long").cast("string"),
        F.lit("/"),
        F.replace(F.col("accession"), F.lit("-"), F.lit("")),
        F.lit("/"),
        F.col("document"),
    )
    listing = F.concat(F.lit("https://www.sec.gov/cgi-bin/browse-edgar?action=getcompany&CIK="), F.col("cik"))
    has_doc = F.coalesce(F.col("document"), F.lit("")) != ""
    return kept.select(
        "cik",
        "form",
        "filed",
        F.concat_ws(" filed ", "form", F.col("filed").cast("string")).alias("title"),
        F.when(has_doc, path).otherwise(listing).alias("url"),
        F.col("_k").alias("rank"),
    )
