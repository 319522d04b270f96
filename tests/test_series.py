"""Blocks, exponential averages and indicators against plain pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickerloom.operators import indicators as ind
from tickerloom.operators import series, signals


def collect(df, *columns):
    pdf = df.select("ticker", "pos", *columns).orderBy("ticker", "pos").toPandas()
    return {t: g.reset_index(drop=True) for t, g in pdf.groupby("ticker")}


def close_to(got, want):
    np.testing.assert_allclose(got.astype(float), want.astype(float), rtol=1e-9, atol=1e-9)


def test_positions(bars, random_bars):
    got = collect(bars, "n", "close")
    for f in random_bars:
        g = got[f.ticker[0]]
        assert list(g.pos) == list(range(1, len(f) + 1))
        assert set(g.n) == {len(f)}
        close_to(g.close, f.close)


@pytest.mark.parametrize("size", [300, 1000, 5000])
def test_results_do_not_depend_on_the_block_size(bars, size):
    df = signals.add_price_volume_score(series.blocks(bars, 252, size=size))
    df = signals.add_event_radar(signals.add_forecasts(df, {"h5": 5}))
    got = collect(series.own_rows(df), "price_volume_momentum", "breakout_score", "exhaustion_score", "h5_score", "h5_prob_up")
    base = signals.add_price_volume_score(series.blocks(bars, 252, size=2600))
    base = signals.add_event_radar(signals.add_forecasts(base, {"h5": 5}))
    want = collect(series.own_rows(base), "price_volume_momentum", "breakout_score", "exhaustion_score", "h5_score", "h5_prob_up")
    for t in want:
        pd.testing.assert_frame_equal(got[t], want[t], rtol=1e-9)


def test_no_block_exceeds_its_size(bars):
    df = series.blocks(bars, 100, ahead=20, size=300)
    largest = df.groupBy("ticker", "_block").count().agg(F.max("count")).first()[0]
    assert largest <= 300 + 100 + 20
    assert df.where("_own").count() == bars.count()


def jumping(spark):
    """A price that falls from a million to a hundredth, stays there, moves, and is flat at last."""
    rng = np.random.default_rng(11)
    close = np.r_[1e6 * np.exp(rng.normal(0, 0.01, 700)), np.full(300, 0.01), 0.01 * np.exp(rng.normal(0, 0.3, 900)), np.full(400, 0.07)]
    pdf = pd.DataFrame({"ticker": "J", "date": pd.bdate_range("2015-01-01", periods=len(close)).date, "open": close, "high": close, "low": close, "close": close, "volume": 1e6})
    return close, series.with_positions(spark.createDataFrame(pdf))


@pytest.mark.parametrize("size", [300, 1100])
def test_sliding_statistics_of_a_jumping_series(spark, size):
    close, numbered = jumping(spark)
    lengths = (20, 50, 200, 252)
    df = series.add_rolling_means(series.blocks(numbered, 253, size=size), "close", *lengths)
    df = series.add_sliding(df, "close", 252, {"var": "var", "max": "max", "count": "held", "mean": "mean"})
    got = collect(series.own_rows(signals.add_return_stats(df)), *[f"_mean_{n}" for n in lengths], "var", "max", "held", "mean", "_mu", "_sigma")["J"]
    exact = close.astype(np.longdouble)
    returns = np.log(close[1:] / close[:-1]).astype(np.longdouble)
    for i in range(len(close)):
        for n in lengths:
            want = exact[max(0, i - n + 1) : i + 1].mean()
            assert abs(got[f"_mean_{n}"][i] - want) <= 1e-12 * want
        window = exact[max(0, i - 251) : i + 1]
        assert (got["held"][i], got["max"][i]) == (len(window), window.max())
        assert abs(got["var"][i] - window.var()) <= 1e-12 * window.max() ** 2 * (len(set(window.tolist())) > 1)
        if i >= 30:
            held = returns[max(0, i - 252) : i]
            assert abs(got["_mu"][i] - held.mean()) <= 1e-12 * np.abs(held).max() and abs(got["_sigma"][i] - held.std()) <= 1e-12 * np.abs(held).max()
    assert got["_sigma"][len(close) - 1] == 0 and got["_mean_200"][len(close) - 1] == 0.07 and got["var"][960] == 0


def test_sliding_statistics_skip_unknown_values(spark):
    values = [None, 1.0, None, None, 4.0, 2.0, None, None, None, None, 8.0]
    df = spark.createDataFrame([("T", i + 1, len(values), v) for i, v in enumerate(values)], "ticker string, pos long, n long, v double")
    names = {"mean": "m", "var": "s", "max": "x", "count": "c"}
    got = collect(series.own_rows(series.add_sliding(series.blocks(df, 3, size=4), "v", 3, names)), *names.values())["T"]
    for i in range(len(values)):
        window = [v for v in values[max(0, i - 2) : i + 1] if v is not None]
        assert got.c[i] == len(window)
        if window:
            assert (got.m[i], got.x[i]) == (np.mean(window), max(window)) and got.s[i] == np.var(window)
        else:
            assert pd.isna(got.m[i]) and pd.isna(got.x[i]) and pd.isna(got.s[i])


def test_block_must_hold_the_lookback(bars):
    with pytest.raises(ValueError):
        series.blocks(bars, 500, size=300)


def test_indicators_match_pandas(bars, random_bars):
    df = series.blocks(bars, ind.MACD_LOOKBACK, size=ind.MACD_BLOCK)
    df = ind.add_macd(ind.add_sma(df, 20, 50, 200))
    df = ind.add_adx(ind.add_rsi(ind.add_bollinger(df)))
    df = ind.add_realized_vol(ind.add_relative_volume(df))
    names = ["sma20", "sma50", "sma200", "macd", "macd_signal", "rsi", "bb_upper", "bb_lower", "atr", "adx", "relative_volume", "realized_vol"]
    got = collect(series.own_rows(df), *names)
    for f in random_bars:
        f = f.reset_index(drop=True)
        g = got[f.ticker[0]]
        c = f.close
        for n in (20, 50, 200):
            close_to(g[f"sma{n}"], c.rolling(n).mean())
        line = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
        close_to(g.macd, line)
        close_to(g.macd_signal, line.ewm(span=9, adjust=False).mean())
        d = c.diff()
        up, down = d.clip(lower=0).rolling(14).mean(), (-d.clip(upper=0)).rolling(14).mean()
        close_to(g.rsi, (100 - 100 / (1 + up / down.replace(0, np.nan))).fillna(50))
        close_to(g.bb_upper, c.rolling(20).mean() + 2 * c.rolling(20).std())
        tr = pd.concat([f.high - f.low, (f.high - c.shift()).abs(), (f.low - c.shift()).abs()], axis=1).max(axis=1)
        close_to(g.atr, tr.rolling(14).mean())
        hi, lo = f.high.diff(), -f.low.diff()
        plus = pd.Series(np.where((hi > lo) & (hi > 0), hi, 0.0)).rolling(14).mean()
        minus = pd.Series(np.where((lo > hi) & (lo > 0), lo, 0.0)).rolling(14).mean()
        dx = 100 * (plus - minus).abs() / (plus + minus).replace(0, np.nan)
        close_to(g.adx, dx.rolling(14).mean().fillna(0))
        close_to(g.relative_volume, (f.volume / f.volume.rolling(20).mean()).fillna(1))
        vol = np.log(c / c.shift()).rolling(20).std() * np.sqrt(252) * 100
        close_to(g.realized_vol[21:], vol[21:])


def test_on_balance_volume(bars, random_bars):
    got = collect(ind.on_balance_volume(bars), "obv")
    for f in random_bars:
        want = (np.sign(f.close.diff().fillna(0)) * f.volume).cumsum().reset_index(drop=True)
        close_to(got[f.ticker[0]].obv, want)


def test_the_future_does_not_change_the_past(spark, bars, random_bars):
    cut = pd.concat([f.iloc[:-60] for f in random_bars])
    short = series.with_positions(spark.createDataFrame(cut))

    def scores(numbered):
        df = signals.add_technical_score(series.blocks(numbered, ind.MACD_LOOKBACK, size=ind.MACD_BLOCK))
        return collect(series.own_rows(df), "technical_score")

    whole, part = scores(bars), scores(short)
    for t, g in part.items():
        assert list(g.technical_score) == list(whole[t].technical_score[: len(g)])


def test_partition_count_does_not_matter(spark, bars):
    def run(parts):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            df = signals.add_price_volume_score(series.blocks(bars, 22))
            return collect(series.own_rows(df), "price_volume_momentum")
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")

    a, b = run("1"), run("17")
    for t in a:
        pd.testing.assert_frame_equal(a[t], b[t])


def trend(spark, first, last, rows=260):
    close = np.linspace(first, last, rows)
    pdf = pd.DataFrame({"ticker": "T", "date": pd.bdate_range("2024-01-01", periods=rows).date, "open": close * 0.999,
                        "high": close * 1.01, "low": close * 0.99, "close": close, "volume": 5e6})
    return series.with_positions(spark.createDataFrame(pdf))


def test_steady_rise_has_neutral_rsi_and_a_high_score(spark):
    df = series.tail(trend(spark, 100, 200), ind.SCORE_LOOKBACK)
    row = series.latest(signals.add_technical_score(df)).first()
    assert row.rsi == 50.0
    assert row.technical_score > 55


def test_steady_fall_scores_low(spark):
    df = series.tail(trend(spark, 200, 100), ind.SCORE_LOOKBACK)
    assert series.latest(signals.add_technical_score(df)).first().technical_score < 45


def test_correlation_of_the_last_joint_days(spark):
    """Sparse overlaps: the last 60 joint days may reach far back, and pairs with few of them have no value."""
    rng = np.random.default_rng(2)
    days = pd.date_range("1960-01-01", periods=3000).date
    wide = {}
    for name, share in (("A", 1.0), ("B", 0.08), ("C", 0.4), ("X", 0.9), ("Y", 0.1), ("Z", 0.012)):
        picked = np.sort(rng.choice(3000, int(3000 * share), replace=False))
        wide[name] = pd.Series(100 * np.exp(np.cumsum(rng.normal(0, 0.02, len(picked)))), index=[days[i] for i in picked])

    def frame(names, key):
        rows = [(n, d, float(c)) for n in names for d, c in wide[n].items()]
        return series.with_positions(spark.createDataFrame(rows, f"{key} string, date date, close double"), key=key)

    got = {(r.ticker, r.index_name): r["corr"] for r in signals.global_correlations(frame("ABC", "ticker"), frame("XYZ", "index_name")).collect()}
    want = {}
    for t in "ABC":
        for i in "XYZ":
            joint = pd.concat([wide[t].pct_change(), wide[i].pct_change()], axis=1, join="inner").dropna().tail(60)
            if len(joint) >= 30:
                want[t, i] = joint.corr().iloc[0, 1]
    assert set(got) == set(want) and len(want) >= 5
    for pair in want:
        assert abs(got[pair] - want[pair]) <= 0.00501


def test_two_bars_are_not_enough_for_a_forecast(spark):
    df = series.tail(trend(spark, 100, 101, rows=2), 253)
    row = series.latest(signals.add_forecasts(df, {"h5": 5})).first()
    assert not row.forecast_available and row.h5_score == 50.0 and row.h5_prob_up is None


def test_a_flat_price_has_no_histogram_sign(spark):
    df = series.tail(trend(spark, 100, 100), ind.SCORE_LOOKBACK)
    assert series.latest(ind.add_macd(df)).first().macd_hist == 0.0


def test_spans_that_differ_too_much_are_refused():
    with pytest.raises(ValueError):
        series.ema_block(series.ema_lookback(400), 400, 5)
