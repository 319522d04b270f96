"""Whole inputs, and rows that stay spread over the tasks, on hand-made rows."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from tickerloom.catalog import feeds, records
from tickerloom.functions import text as tx
from tickerloom.operators import text
from tickerloom.session import run_folder
from tickerloom.sources import run_logs


@pytest.fixture
def bar_tables(spark, tmp_path):
    """Forty days of three brands: a short name, a full one and the one no cache holds; two days are early."""
    days = [dt.datetime(1995, 2, 13) + dt.timedelta(days=k) for k in range(40)]
    parts = [(1, "Brand#3"), (2, "Brand#44"), (3, "Brand#7")]
    lines = [(key, day, 0.05, 0.02, 1.0) for key, _ in parts for day in days]
    spark.createDataFrame(parts, "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    columns = "l_partkey long, l_shipdate timestamp, l_discount double, l_tax double, l_quantity double"
    spark.createDataFrame(lines, columns).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def test_fallback_chooses_among_the_bars_of_three_providers(spark, bar_tables):
    held = records.provider_bars(spark, bar_tables)
    assert held.count() == 3 * 3 * 40
    counts = {(r.ticker, r.provider): r["count"] for r in held.groupBy("ticker", "provider").count().collect()}
    assert counts == {
        ("Brand#3", None): 120, ("Brand#7", None): 80, ("Brand#7", "cache"): 40,
        ("Brand#44", None): 38, ("Brand#44", "primary"): 2, ("Brand#44", "second"): 40, ("Brand#44", "cache"): 40,
    }
    kept = {(r.ticker, r.provider, r.bar_count) for r in records.provider_fallback(spark, bar_tables).collect()}
    assert kept == {("Brand#44", "second", 40), ("Brand#7", "cache", 40)}


def test_status_tells_of_every_provider_up_to_the_one_that_won(spark, bar_tables):
    got = {(r.ticker, r.provider): (r.bar_count, r.status) for r in records.provider_status(spark, bar_tables).collect()}
    assert got == {
        ("Brand#44", "primary"): (2, "insufficient_rows"), ("Brand#44", "second"): (40, "ok"),
        ("Brand#7", "primary"): (0, "missing"), ("Brand#7", "second"): (0, "missing"), ("Brand#7", "cache"): (40, "ok"),
        ("Brand#3", "primary"): (0, "missing"), ("Brand#3", "second"): (0, "missing"), ("Brand#3", "cache"): (0, "missing"),
    }


@pytest.fixture
def documents(spark, tmp_path):
    """Titles with marks, capitals, foreign letters, copies, white space alone and nothing."""
    texts = ["Fed & Co: RATES up!", "fed  co rates up", "  --  ", None, "", "İstanbul Kelvin 4K", "日本 a\nb\tc", "x" * 200]
    rows = [(k, t, f"src-{k % 3}", "en") for k, t in enumerate([*texts, *texts])]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("query", [feeds.deduped_titles, feeds.merged_headlines, feeds.newest_headlines])
def test_titles_are_keyed_before_any_exchange(spark, documents, query):
    lines = plan_of(query(spark, documents)).splitlines()
    grouped = [x for x in lines if "Aggregate" in x]
    assert grouped and not any("text#" in x or " title#" in x or "[title#" in x for x in grouped)
    assert not any("regexp_replace" in x for x in lines)


def test_title_keys_as_python_makes_them(spark, documents):
    for r in feeds.news(spark, documents).select("title", tx.title_key(F.col("title")).alias("key")).collect():
        want = None if r.title is None else re.sub("[^a-z0-9 ]", "", r.title.lower()).strip(" ")[:90]
        assert r.key == want


def test_texts_are_cut_by_their_runs_and_words(spark, documents):
    items = feeds.news(spark, documents)
    cut = text.text_runs(items, F.col("title"), 4)
    assert "split(" not in plan_of(cut)
    want = set()
    for r in items.collect():
        want |= {(r.news_id, "n", w) for w in re.split("[^a-z0-9&]+", (r.title or "").lower()) if len(w) >= 4}
        want |= {(r.news_id, "s", w) for w in re.split("[^A-Z0-9]+", (r.title or "").upper()) if w}
    got = [tuple(r) for r in cut.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_texts_are_lowered_once_for_all_keywords(spark, documents):
    from tickerloom import datasets as data

    names = spark.createDataFrame([("A", "Acme", ["ai", "cloud"], None, None)], "ticker string, company_name string, strategy_tags array<string>, sector string, industry string")
    links = text.map_impacts(names, data.gov_events(spark, documents), {"ai": ("rates", "kelvin"), "cloud": ("up",)})
    assert sorted((r.position, r.match_kind) for r in links.collect()) == [(0, "thematic:rates"), (1, "thematic:rates"), (5, "thematic:kelvin")]
    exploded = [x for x in plan_of(links).splitlines() if "Generate explode" in x and "rates" in x]
    assert exploded and not any("lower(" in x for x in exploded)


def test_items_are_dealt_once_for_their_names(spark, tmp_path):
    titles = [(1, "Acme rallies, ACME acme", "u"), (2, "B.1 and B.12", "u"), (None, "acme", "u")]
    names = [("A", "Acme Inc"), ("A", "acmes & acme"), ("B.1", "zz"), (None, "acme")]
    spark.createDataFrame(titles, "news_id long, title string, url string").write.parquet(f"{tmp_path}/items")
    spark.createDataFrame(names, "ticker string, company_name string").write.parquet(f"{tmp_path}/assets")
    items, assets = spark.read.parquet(f"{tmp_path}/items"), spark.read.parquet(f"{tmp_path}/assets")
    found = text.attach_entities(items, assets)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == {(1, "A"), (1, None), (2, "B.1"), (None, "A"), (None, None)}
    assert not re.search(r"hashpartitioning\(news_id#\d+L?, (ticker|token)#", found._jdf.queryExecution().executedPlan().toString())


def test_rows_of_logs_are_not_dealt_by_run(spark, monkeypatch):
    """A first commit knows no run, and its empty manifest has no size that a planner could go by."""
    rows = spark.createDataFrame([("r0", k) for k in range(50)], "run_id string, value long")
    rows = rows.withColumn("as_of", F.lit("2024-02-01 10:00:00").cast("timestamp"))
    base, plans, write = run_folder(spark, "t"), [], run_logs.stage

    def watched(given, *rest):
        plans.extend(df._jdf.queryExecution().executedPlan().toString() for df in given.values())
        write(given, *rest)

    monkeypatch.setattr(run_logs, "stage", watched)
    for _ in range(2):
        run_logs.commit_runs({"evidence_snapshots": rows}, base)
    kept = run_logs.read_runs(spark, base, "evidence_snapshots")
    assert len(plans) == 2 and kept.count() == 50
    for text_of_plan in plans:
        assert "BroadcastHashJoin" in text_of_plan and "SortMergeJoin" not in text_of_plan
