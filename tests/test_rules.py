"""Scoring, gate, options, calendar and text rules on hand-made rows."""

import math

import pytest
from pyspark.sql import functions as F

from tickerloom.functions import text as tx
from tickerloom.functions.numeric import clamp, norm_cdf, rnd
from tickerloom.operators import calendar as cal
from tickerloom.operators import options as opt
from tickerloom.operators import outcomes, scoring, text
from tickerloom.operators import regime
from tickerloom.sources import config, logs, macro
from tickerloom.sources import bars as src


def one(spark, **values):
    return spark.createDataFrame([tuple(values.values())], list(values))


def test_norm_cdf(spark):
    xs = [-4.0, -1.3, -0.2, 0.0, 0.7, 2.5, 5.0]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", norm_cdf(F.col("x")).alias("p")).collect()
    for x, p in rows:
        assert abs(p - 0.5 * (1 + math.erf(x / math.sqrt(2)))) < 1e-6


def test_clamp_keeps_null_and_rnd_is_half_even(spark):
    df = spark.createDataFrame([(None, 0.5), (150.0, 2.5)], "x double, y double")
    rows = df.select(clamp(F.col("x")).alias("x"), rnd(F.col("y"), 0).alias("y")).collect()
    assert [tuple(r) for r in rows] == [(None, 0.0), (100.0, 2.0)]


GATE_CASES = [
    (dict(), "strong_bullish_research_candidate", "VALID_RESEARCH_CANDIDATE"),
    (dict(opportunity_score=65.0), "bullish_research_candidate", "VALID_RESEARCH_CANDIDATE"),
    (dict(has_catalyst=False), "bullish_research_candidate", "VALID_RESEARCH_CANDIDATE"),
    (dict(target_price=103.0), "rejected_insufficient_expected_move", "REJECTED"),
    (dict(stop_price=90.0), "rejected_low_reward", "REJECTED"),
    (dict(risk_score=60.0), "rejected_high_risk", "REJECTED"),
    (dict(confidence=50.0), "watchlist_only", "WATCHLIST"),
    (dict(direction="neutral"), "no_trade", "NO_TRADE"),
    (dict(block_trade=True), "rejected_high_risk", "REJECTED"),
    (dict(target_price=None), "no_trade", "NO_TRADE"),
    (dict(direction="bearish", target_price=80.0, stop_price=105.0, opportunity_score=30.0), "watchlist_only", "WATCHLIST"),
]


@pytest.mark.parametrize("change,label,status", GATE_CASES)
def test_candidate_gate(spark, change, label, status):
    base = dict(direction="bullish", current_price=100.0, target_price=115.0, stop_price=95.0, opportunity_score=75.0,
                confidence=70.0, risk_score=40.0, has_catalyst=True, block_trade=False)
    base.update(change)
    schema = ("direction string, current_price double, target_price double, stop_price double, opportunity_score double, "
              "confidence double, risk_score double, has_catalyst boolean, block_trade boolean")
    row = scoring.add_candidate_gate(spark.createDataFrame([tuple(base.values())], schema)).first()
    assert (row.final_label, row.validation_status) == (label, status)


def test_low_price_needs_five_points(spark):
    schema = ("direction string, current_price double, target_price double, stop_price double, opportunity_score double, "
              "confidence double, risk_score double, has_catalyst boolean, block_trade boolean")
    df = spark.createDataFrame([("bullish", 20.0, 22.0, 19.5, 75.0, 70.0, 40.0, True, False)], schema)
    row = scoring.add_candidate_gate(df).first()
    assert row.final_required_points == 5.0 and row.final_label == "rejected_insufficient_expected_move"


def test_missing_components_give_their_weight_away(spark):
    rows = [("T", "technical_structure", 80.0, True), ("T", "sentiment", 60.0, True), ("T", "fundamentals", 10.0, False)]
    wide = scoring.widen(spark.createDataFrame(rows, "ticker string, name string, score double, available boolean"), ["ticker"])
    own = config.profile_weights(spark)
    weights = scoring.widen_weights(config.resolve_weights(own.select("profile"), config.default_weights(spark), own))
    row = scoring.blend(wide.withColumn("profile", F.lit("swing")), weights).first()
    assert row.u_fundamentals == 0 and abs(row.u_technical_structure + row.u_sentiment - 1) < 1e-12
    assert row.opportunity_raw == round(80 * 18 / 33 + 60 * 15 / 33, 1)
    assert row.available_count == 2 and row.given == 3


@pytest.mark.parametrize("score,want", [(70, "bullish"), (58, "neutral_to_bullish"), (57.9, "neutral"), (42, "neutral_to_bearish"), (30, "bearish")])
def test_direction_buckets(spark, score, want):
    assert one(spark, s=float(score)).select(scoring.to_direction(F.col("s")).alias("d")).first().d == want


def test_greeks_against_erf(spark):
    df = one(spark, spot=100.0, strike=105.0, premium=2.5, iv=30.0, dte=30, right="call")
    row = opt.add_greeks(df, "spot", "strike", "premium", "iv", "dte", "right").first()
    t, sigma = 30 / 365, 0.3
    d1 = (math.log(100 / 105) + (0.045 + sigma**2 / 2) * t) / (sigma * math.sqrt(t))
    assert row.delta == round(0.5 * (1 + math.erf(d1 / math.sqrt(2))), 3)
    assert row.breakeven_price == 107.5


def test_risk_gate_takes_the_lowest_cap_and_strictest_label(spark):
    schema = ("confidence double, action string, dte int, avg_iv double, exact_volume int, exact_oi int, spread_pct double, "
              "premium_pct_spot double, iv_realized_ratio double, iv_rank double, theta_per_day double, reference_price double, "
              "earnings_in_window boolean, days_to_earnings int")
    rows = [
        (90.0, "BUY CALL", 20, 40.0, 500, 500, 5.0, 2.0, 1.2, 30.0, -0.01, 3.0, False, None),
        (90.0, "BUY CALL", 20, 120.0, 500, 50, 5.0, 2.0, 1.2, 30.0, -0.01, 3.0, False, None),
        (90.0, "BUY CALL", 20, 40.0, 500, 500, 5.0, 2.0, 1.2, 30.0, -0.01, 3.0, True, 3),
        (90.0, "NO TRADE", 20, 40.0, 10, 10, 40.0, 20.0, 5.0, 99.0, -1.0, 3.0, True, 3),
    ]
    got = opt.add_risk_gate(spark.createDataFrame(rows, schema)).select("confidence", "risk_gate").collect()
    assert [tuple(r) for r in got] == [(90.0, "high"), (45.0, "paper only"), (58.0, "spread only"), (25.0, "no trade")]


def test_iv_rank_needs_twenty_readings(spark):
    hist = spark.createDataFrame([("T", "e", i, 30.0 + i) for i in range(20)], "ticker string, expiration string, seq int, avg_iv double")
    cur = spark.createDataFrame([("T", "e", 49.0), ("T", "other", 30.0), ("U", "e", 10.0)], "ticker string, expiration string, current_iv double")
    got = {(r.ticker, r.expiration): r for r in opt.iv_rank(cur, hist).collect()}
    assert got["T", "e"].iv_rank == 100.0 and got["T", "e"].iv_history_scope == "exact_expiration"
    assert got["T", "other"].iv_percentile == 5.0 and got["T", "other"].iv_history_scope == "ticker"
    assert got["U", "e"].iv_rank is None and got["U", "e"].iv_history_count == 0


def test_first_friday_and_thursdays(spark):
    rows = cal.rule_events(spark, "2026-06-01", "2026-06-30").collect()
    assert [str(r.date) for r in rows if r.kind == "nfp"] == ["2026-06-05"]
    assert sorted(str(r.date) for r in rows if r.kind == "jobless_claims") == ["2026-06-04", "2026-06-11", "2026-06-18", "2026-06-25"]


def test_event_points_are_capped(spark):
    got = one(spark, i="high", d=0, s="ticker").select(cal.event_points(F.col("i"), F.col("d"), F.col("s")).alias("p")).first().p
    assert got == 55


def test_headline_polarity(spark):
    rows = ["Company beats, raises outlook!", "Fraud probe: shares plunge", "beat beat miss", "nothing here"]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    assert [r.p for r in df.select(tx.polarity(F.col("t")).alias("p")).collect()] == [1.0, -1.0, 0.0, 0.0]


def test_symbol_is_matched_between_boundaries(spark):
    df = spark.createDataFrame([("BRK.B up", "BRK.B"), ("XBRK.B", "BRK.B"), ("the AI trade", "AI"), ("said", "AI")], "t string, s string")
    assert [r.m for r in df.select(tx.mentions_symbol(F.col("t"), F.col("s")).alias("m")).collect()] == [True, False, True, False]


def test_policy_links_prefer_the_company_name(spark):
    assets = spark.createDataFrame(
        [("NV", "Nvidia Corporation", ["semiconductors"], None, None), ("MD", "The Medical Group Inc", ["healthcare"], None, None)],
        "ticker string, company_name string, strategy_tags array<string>, sector string, industry string",
    )
    events = spark.createDataFrame(
        [("Export control on Nvidia chips", "a", "policy", 1), ("New export control rules", "b", "policy", 2),
         ("Medical device recall", "c", "fda", 3), ("Nvidia antitrust case", "d", "antitrust", 4), ("chip recall", "e", "fda", 5)],
        "title string, source string, kind string, position int",
    )
    got = {(r.ticker, r.source): (r.match_kind, r.polarity) for r in text.map_impacts(assets, events).collect()}
    assert got == {("NV", "a"): ("direct", -0.1), ("NV", "b"): ("thematic:export control", 0.0), ("NV", "d"): ("direct", -0.3)}


def test_equal_titles_are_linked_once_by_the_first_event(spark):
    assets = spark.createDataFrame(
        [("NV", "Nvidia", ["ai"], None, None), ("XX", "Unknown", ["ai"], None, None), ("YY", "Other", None, "AI", None)],
        "ticker string, company_name string, strategy_tags array<string>, sector string, industry string",
    )
    rows = [("Nvidia and ai safety", "a", k, p) for p, k in ((7, "policy"), (3, "fda"), (5, "trump_admin"))] + [("ai safety", None, "policy", 9), (None, "a", "policy", 1)]
    events = spark.createDataFrame(rows * 40, "title string, source string, kind string, position int")
    got = sorted((r.ticker, r.source, r.position, r.kind, r.match_kind) for r in text.map_impacts(assets, events).collect() if r.source)
    assert got == [("NV", "a", 3, "fda", "direct"), ("XX", "a", 5, "trump_admin", "thematic:ai safety"), ("YY", "a", 5, "trump_admin", "thematic:ai safety")]
    touches, members = text.impact_links(assets, events)
    assert touches.count() == 3 and "title" not in touches.columns and members.count() == 6


def test_names_in_long_texts_take_linear_time(spark):
    import time

    assets = spark.createDataFrame([("ABC.D", "Metallic Dawn"), ("Q#1.2", "Zzz")], "ticker string, company_name string")

    def seconds(n: int) -> float:
        body = "some plain words and 12 numbers " * (n // 32)
        rows = [(1, body + " metallicity here", ""), (2, body + "(abc.d)", ""), (3, body + "xabc.d q#1.23", ""), (4, "x" * n, "")]
        news = spark.createDataFrame(rows, "news_id int, title string, url string")
        start = time.perf_counter()
        got = {(r.news_id, r.ticker) for r in text.attach_entities(news, assets).collect()}
        assert got == {(1, "ABC.D"), (2, "ABC.D")}
        return time.perf_counter() - start

    seconds(1000)
    short, long = seconds(100_000), seconds(1_000_000)
    assert long < 15 * max(short, 0.5)


def test_many_copies_of_a_title_keep_the_first(spark):
    rows = [("T", f"Same  Title!{'?' * (i % 3)}", 1 + i % 4, i, f"p{i}") for i in range(5000)]
    df = spark.createDataFrame(rows, "ticker string, title string, priority int, position int, provider string")
    got = text.dedupe_titles(df, ["ticker"], ["priority", "position"]).collect()
    assert len(got) == 1 and got[0].position == 0


def test_substring_join_equals_brute_force(spark):
    titles = ["metallic dawn", "apple pie", "pineapple", "meta", "ab app", "Apples of X1"]
    names = ["Apple Inc", "Meta Platforms", "Dawn & Co", "X1"]
    news = spark.createDataFrame([(i, t, "") for i, t in enumerate(titles)], "news_id int, title string, url string")
    assets = spark.createDataFrame([(f"X{i}", n) for i, n in enumerate(names)], "ticker string, company_name string")
    got = {(r.news_id, r.ticker) for r in text.attach_entities(news, assets).collect()}
    want = set()
    for i, t in enumerate(titles):
        for j, n in enumerate(names):
            toks = [w for w in n.lower().split() if len(w) >= 4 and w not in tx.COMPANY_STOPWORDS]
            symbol = f"X{j}" in t.upper().split()
            if symbol or any(w in t.lower() for w in toks):
                want.add((i, f"X{j}"))
    assert got == want


def test_zero_hit_rate_counts_as_missing_unless_strict(spark):
    profile = spark.createDataFrame([("65-74", 60, 70.0, 0.0, True)], "bucket string, count int, avg_confidence double, hit_rate_pct double, usable boolean")
    calls = spark.createDataFrame([(70.0,)], "confidence_score double")
    assert outcomes.apply_calibration(calls, profile).first().confidence_score == 70.0
    assert outcomes.apply_calibration(calls, profile, strict_zero=True).first().confidence_score == 55.0


def test_option_outcome_of_a_later_mark(spark):
    rows = [("T", "C1", "2024-01-01 10:00:00", 5.0, "BUY CALL"), ("T", "C1", "2024-01-01 12:00:00", 9.0, "BUY CALL"), ("T", "C1", "2024-01-04 10:00:00", 7.5, "BUY CALL")]
    df = spark.createDataFrame(rows, "ticker string, reference_contract string, t string, reference_option_price double, action string")
    df = df.withColumn("as_of", F.col("t").cast("timestamp")).withColumn("underlying_price", F.lit(1.0)).withColumn("risk_gate", F.lit("high"))
    got = outcomes.option_outcomes(df, 3).orderBy("as_of").collect()
    assert [r.status for r in got] == ["scored", "scored", "pending"]
    assert got[0].premium_return_pct == 50.0 and got[0].max_mark_pct == 80.0 and got[0].min_mark_pct == 50.0


def test_horizons(spark):
    df = spark.createDataFrame([("5D",), ("20d",), ("INTRADAY",), ("x",), (None,), ("0D",)], "h string")
    assert [r.d for r in df.select(outcomes.horizon_days(F.col("h")).alias("d")).collect()] == [5, 20, 1, 5, 5, 1]


def test_macro_score_without_readings_is_neutral(spark):
    wide = spark.createDataFrame([tuple([None] * (len(macro.SERIES) + 1))], ", ".join(f"{s} double" for s in (*macro.SERIES, "yield_curve_10y_5y")))
    assert wide.select(regime.macro_score().alias("s")).first().s == 50.0


def test_missing_price_column_is_an_error(spark):
    with pytest.raises(ValueError):
        src.normalise(spark.createDataFrame([(1.0,)], "Open double"))


def test_snapshot_logs_round_trip(spark, tmp_path):
    day = spark.createDataFrame([("T", 30.0), ("U", 31.0)], "ticker string, avg_iv double")
    for run in ("r1", "r2"):
        logs.append_snapshots({"iv_snapshots": day}, str(tmp_path), run, f"2024-01-0{run[1]} 00:00:00")
    back = spark.read.parquet(f"{tmp_path}/iv_snapshots")
    status = logs.snapshot_status({"iv_snapshots": back}).first()
    assert (status.rows, status.runs, status.latest_run) == (4, 2, "r2")
    with pytest.raises(ValueError):
        logs.append_snapshots({"other": day}, str(tmp_path), "r", "2024-01-01")


def test_log_reader_skips_broken_lines(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"ticker": "T", "avg_iv": 1.5}\nnot json\n\n{"ticker": "U", "avg_iv": 2.5}\n')
    rows = logs.read_log(spark, str(tmp_path / "log.jsonl"), "ticker string, avg_iv double").collect()
    assert sorted(r.ticker for r in rows) == ["T", "U"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("T", "bullish", 70.0)], "ticker string, direction string, confidence double")
    logs.write_summary_csv(df, str(tmp_path / "csv"))
    logs.write_signals_json(df, str(tmp_path / "json"))
    logs.write_evidence(df, str(tmp_path / "ev"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().ticker == "T"
    assert spark.read.json(str(tmp_path / "json")).count() == spark.read.json(str(tmp_path / "ev")).count() == 1


def test_a_pegged_price_has_exact_means(spark, random_bars):
    """Random bars, then a flat price: long means are the price itself, returns have no spread."""
    import pandas as pd

    from tickerloom.operators import indicators, series, signals

    moving = random_bars[0].head(300)
    flat = moving.tail(1).loc[moving.tail(1).index.repeat(600)].assign(open=37.13, high=37.13, low=37.13, close=37.13)
    flat["date"] = pd.bdate_range(pd.Timestamp(moving["date"].iloc[-1]) + pd.Timedelta(days=1), periods=600).date
    numbered = series.with_positions(spark.createDataFrame(pd.concat([moving, flat])))
    frame = series.blocks(numbered, 252)
    got = series.latest(signals.add_return_stats(indicators.add_sma(frame, 20, 50, 200))).first()
    assert (got["sma20"], got["sma50"], got["sma200"]) == (37.13, 37.13, 37.13)
    assert (got["_mu"], got["_sigma"]) == (0.0, 0.0)


def test_two_bars_of_a_day_give_one_answer(spark, random_bars):
    """A repeated day doesn't double the days that it answers."""
    import pandas as pd

    from tickerloom.operators import series
    from tickerloom.operators.outcomes import next_bars

    bars = random_bars[1].head(40)
    numbered = series.with_positions(spark.createDataFrame(pd.concat([bars, bars.iloc[10:12]])))
    days = next_bars(numbered.withColumnRenamed("date", "target_date"), numbered)
    assert days.count() == days.select("ticker", "target_date").distinct().count() == 40


def test_next_bar_across_long_gaps(spark):
    import bisect
    import datetime as dt
    import random
    import re

    from tickerloom.operators.outcomes import next_bars

    rng, start = random.Random(6), dt.date(1900, 1, 1)
    offsets = {"A": sorted(rng.sample(range(400), 90) + [700, 9_000, 50_000]), "B": [60_000], "C": list(range(0, 6_400, 64))}
    bars = [(t, start + dt.timedelta(d), float(d), i + 1) for t, days in offsets.items() for i, d in enumerate(days)]
    asked = [(t, d) for t in ("A", "B", "C", "D") for d in [*range(-700, 800, 9), 4_000, 8_999, 9_000, 9_001, 49_000, 50_000, 50_001, 60_000, 60_001, 6_336, 6_337]]
    numbered = spark.createDataFrame(bars, "ticker string, date date, close double, pos long")
    keys = spark.createDataFrame([(t, start + dt.timedelta(d)) for t, d in asked * 3 + [(None, 1)]], "ticker string, target_date date")
    found = next_bars(keys, numbered)
    exchanges = re.findall(r"hashpartitioning\(([^)]*)\)", found._jdf.queryExecution().toString())
    assert exchanges and not any(re.fullmatch(r"ticker#\d+, \d+", x) for x in exchanges)
    got = {(r.ticker, r.target_date): (r.exit_date, r.exit_price) for r in found.collect()}
    want = {}
    for t, d in asked:
        days = offsets.get(t, [])
        at = bisect.bisect_left(days, d)
        if at < len(days):
            want[t, start + dt.timedelta(d)] = (start + dt.timedelta(days[at]), float(days[at]))
    assert got == want
