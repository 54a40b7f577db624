"""Window rules against pandas, and chunked series against whole ones."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.functions import rolling as R
from tickloom.functions.smoothing import weighted_means
from tickloom.operators.recipe import Level, Recipe, add_features
from tickloom.operators.sentiment import sentiment_features
from tickloom.operators.series import Series, plan_series
from tickloom.operators.technical import technical_features
from tickloom.plans import shapes

START = pd.Timestamp("2024-01-01")


def series_frame(spark, values, entity="a"):
    rows = [
        (entity, (START + pd.Timedelta(minutes=i)).to_pydatetime(), None if v is None or math.isnan(v) else float(v))
        for i, v in enumerate(values)
    ]
    return spark.createDataFrame(rows, "symbol string, bar_ts timestamp_ntz, x double")


def run(df, make, series=Series(("symbol",), "bar_ts")):
    return add_features(df, series, [make]).orderBy("symbol", "bar_ts").toPandas()


def close(found, expected, tolerance=1e-9):
    a, b = np.asarray(found, dtype=float), np.asarray(expected, dtype=float)
    assert (np.isnan(a) == np.isnan(b)).all()
    np.testing.assert_allclose(a[~np.isnan(a)], b[~np.isnan(b)], rtol=tolerance, atol=tolerance)


@pytest.fixture(scope="module")
def gappy():
    rng = np.random.default_rng(7)
    x = rng.normal(10, 3, 400)
    x[rng.random(400) < 0.1] = np.nan
    x[:4] = np.nan
    x[200:240] = 5.0
    return x


def test_rolling_statistics_match_pandas(spark, gappy):
    n = 7
    make = lambda f: Recipe(
        ["m", "s", "lo", "hi", "q", "mad"],
        [
            Level(
                add={
                    "m": R.mean(f, "x", n),
                    "s": R.deviation(f, "x", n),
                    "lo": R.lowest(f, "x", n),
                    "hi": R.highest(f, "x", n),
                    "q": R.quantile(f, "x", 0.25, n),
                    "mad": R.absolute_deviation(f, "x", n),
                }
            )
        ],
        back=n,
    )
    out = run(series_frame(spark, gappy), make)
    roll = pd.Series(gappy).rolling(n)
    for name, expected in {
        "m": roll.mean(),
        "s": roll.std(),
        "lo": roll.min(),
        "hi": roll.max(),
        "q": roll.quantile(0.25),
        "mad": roll.apply(lambda v: np.abs(v - v.mean()).mean()),
    }.items():
        close(out[name], expected, 1e-7)


def test_trend_correlation_is_missing_on_flat_windows(spark, gappy):
    make = lambda f: Recipe(
        ["t"], [Level(add={"t": R.trend_correlation(f, "x", "__pos", 10)})], back=10, number=True
    )
    out = run(series_frame(spark, gappy), make)["t"]
    x = pd.Series(gappy)
    expected = x.rolling(10).apply(
        lambda v: np.nan if v.max() == v.min() else np.corrcoef(v, range(10))[0, 1]
    )
    close(out, expected, 1e-7)


@pytest.mark.parametrize("density", [1.0, 0.9, 0.3, 0.01])
def test_weighted_means_match_pandas_at_any_density(spark, density):
    rng = np.random.default_rng(3)
    x = rng.normal(size=1500)
    x[rng.random(1500) >= density] = np.nan
    make = lambda f: (lambda made: Recipe(["e3", "e10"], made[0], made[1]))(
        weighted_means(f, {"e3": ("x", 3), "e10": ("x", 10)})
    )
    out = run(series_frame(spark, x), make)
    s = pd.Series(x)
    close(out["e3"], s.ewm(span=3).mean())
    close(out["e10"], s.ewm(span=10).mean())


def test_integer_totals_equal_direct_sums(spark):
    x = [float(i % 5) if i % 11 else None for i in range(300)]
    df = series_frame(spark, x).withColumn("x", F.col("x").cast("long"))
    make = lambda f: Recipe(
        ["a", "b"],
        [Level(add=R.running_counts(f, "x")), Level(add={"a": R.counted_total(f, "x", 4), "b": R.total(f, "x", 4)})],
        back=4,
    )
    out = run(df, make)
    close(out["a"], out["b"])


@pytest.fixture(scope="module")
def long_bars(spark):
    """One long and one short entity, with gaps and missing closes."""
    rng = np.random.default_rng(11)
    rows = []
    for name, n in (("hot", 900), ("cold", 60)):
        price, at = 100.0, START
        for i in range(n):
            at += pd.Timedelta(minutes=int(rng.choice([5, 5, 5, 90, 2000])))
            o, price = price, price * (1 + rng.normal(0, 0.01))
            c = None if rng.random() < 0.03 else price
            hi, lo = max(o, price) + rng.random(), min(o, price) - rng.random()
            rows.append((name, at.to_pydatetime(), o, hi, lo, c, float(rng.integers(0, 9))))
    schema = (
        "symbol string, bar_ts timestamp_ntz, open double, high double, low double, "
        "close double, volume double"
    )
    return spark.createDataFrame(rows, schema)


def same(left, right, keys=("symbol", "bar_ts")):
    a = left.orderBy(*keys).toPandas()
    b = right.orderBy(*keys).toPandas()[a.columns]
    assert len(a) == len(b)
    for c in a.columns:
        if a[c].dtype.kind in "fi":
            close(a[c], b[c], 1e-7)
        else:
            assert (a[c] == b[c]).all(), c


WHOLE = Series(("symbol",), "bar_ts")
CHUNKED = Series(("symbol",), "bar_ts", bucket="hour", chunk_rows=150)


def test_chunked_technical_features_equal_whole(long_bars):
    same(technical_features(long_bars, CHUNKED), technical_features(long_bars, WHOLE))


def test_chunked_sentiment_features_equal_whole(spark, long_bars):
    bars = long_bars.withColumns(
        {
            "headline_count": (F.hash("bar_ts") % 3 == 0).cast("long"),
            "bullish_cnt": (F.hash("bar_ts") % 6 == 0).cast("long"),
            "bearish_cnt": (F.hash("bar_ts") % 9 == 0).cast("long"),
            "sent_mean": F.when(F.hash("bar_ts") % 3 == 0, F.col("open") % 1),
            "sent_max_abs": F.when(F.hash("bar_ts") % 3 == 0, F.col("open") % 1),
        }
    ).select("symbol", "bar_ts", "headline_count", "bullish_cnt", "bearish_cnt", "sent_mean", "sent_max_abs")
    same(sentiment_features(bars, CHUNKED), sentiment_features(bars, WHOLE))


def test_only_long_entities_are_cut(long_bars):
    layout = plan_series(long_bars, CHUNKED)
    assert layout.table is not None
    assert {r.symbol for r in layout.table.select("symbol").distinct().collect()} == {"hot"}
    assert plan_series(long_bars, WHOLE).table is None


def test_one_hot_day_is_cut_by_its_rows(spark):
    """10,000 rows of one day, with ties in time, in chunks of 100."""
    ticks = spark.range(10_000).selectExpr(
        "'hot' AS symbol", "timestamp_ntz '2024-01-02 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id DIV 3) AS bar_ts",
        "id", "double(hash(id) % 100) AS value",
    )
    cut = Series(("symbol",), "bar_ts", ("id",), chunk_rows=100)
    layout = plan_series(ticks, cut)
    chunks = layout.table.groupBy("__chunk").agg(F.sum("__n").alias("n")).collect()
    assert 90 <= len(chunks) <= 110 and max(r.n for r in chunks) <= 150

    def make(series):
        frame = plan_series(ticks, series).open(ticks, back=20, ahead=5)
        frame = frame.add({"mean": F.avg("value").over(frame.frames.last(20)), "later": frame.frames.lead("value", 5)})
        return frame.number("place").cumulate({"running": F.col("id")}).close()

    same(make(cut), make(Series(("symbol",), "bar_ts", ("id",))), ("id",))


def test_rows_of_a_hot_day_meet_few_bounds(spark):
    """Of 2,999 bounds, a row is compared with those of its own blocks only; tied rows stay together."""
    from tickloom.operators import series as module

    ticks = spark.range(12_000).selectExpr(
        "'hot' AS symbol", "timestamp_ntz '2024-01-02 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, hash(id) % 40 + 50) AS bar_ts",
        "IF(id % 50 = 0, NULL, id DIV 2) AS place",
    ).unionByName(spark.sql("SELECT 'cold' AS symbol, timestamp_ntz '2024-01-02 00:00:00' AS bar_ts, 5L AS place"))
    layout = plan_series(ticks, Series(("symbol",), "bar_ts", ("place",), chunk_rows=16))
    cuts = layout.cuts.table
    assert cuts.agg(F.sum(F.size(module.CUTS))).first()[0] == 2_999
    assert cuts.agg(F.max(F.size(module.CUTS))).first()[0] == module.FAN - 1 and len(layout.cuts.blocks) == 4
    keys = [(r.bar_ts, r.place is not None, r.place) for r in ticks.where("symbol = 'hot'").collect()]
    keys.sort(key=lambda k: (k[0], k[1], k[2] or 0))
    last = {k: n // 4 for n, k in enumerate(keys)}  # of tied rows, the last tells the part
    found = module.bucketed(ticks, layout.series, layout.cuts).collect()
    assert len(found) == 12_001 and {r[module.BUCKET].part for r in found if r.symbol == "cold"} == {0}
    got = {(r.bar_ts, r.place is not None, r.place): r[module.BUCKET].part for r in found if r.symbol == "hot"}
    assert got == last


def test_chunked_positions_totals_and_fills(long_bars):
    def make(series):
        frame = plan_series(long_bars, series).open(long_bars, back=3, ahead=2)
        frame = frame.number("place").size("rows").scan(carry_back={"later": F.col("close")})
        return frame.totals({"mean": F.avg("close")}).close()

    same(make(CHUNKED), make(WHOLE))


def test_other_entities_and_future_rows_change_nothing(long_bars):
    groups = ["bands", "momentum", "volatility", "on_balance_volume", "rates_of_change"]
    both = technical_features(long_bars, WHOLE, groups=groups)
    alone = technical_features(long_bars.where("symbol = 'cold'"), WHOLE, groups=groups)
    same(both.where("symbol = 'cold'"), alone)
    times = sorted(r.bar_ts for r in long_bars.select("bar_ts").collect())
    cut = times[len(times) // 2]
    past = technical_features(long_bars.where(F.col("bar_ts") <= F.lit(cut)), WHOLE, groups=groups)
    same(both.where(F.col("bar_ts") <= F.lit(cut)), past)


def test_constant_prices_and_no_volume(spark):
    rows = [("a", (START + pd.Timedelta(hours=i)).to_pydatetime(), 5.0, 5.0, 5.0, 5.0, 0.0) for i in range(80)]
    bars = spark.createDataFrame(
        rows, "symbol string, bar_ts timestamp_ntz, open double, high double, low double, close double, volume double"
    )
    out = technical_features(bars, WHOLE).toPandas().iloc[-1]
    for name in ("bb_20_position", "cci", "vwma_10", "cmf_20", "volume_roc_5", "normalized_volatility"):
        assert pd.isna(out[name]), name
    assert out["bb_20_breakout_up"] == 0 and out["momentum_5"] == 0


def test_groups_share_one_shuffle(spark, folder):
    df = technical_features(shapes.hourly_bars(spark, folder), shapes.hourly_series(spark, folder))
    plan = df._jdf.queryExecution().executedPlan().toString()
    # one exchange for the bars and one for all windows together
    assert plan.count("Exchange hashpartitioning") == 2


def test_lookahead_features_refuse_streams(spark, folder):
    stream = spark.readStream.schema("symbol string, bar_ts timestamp").parquet(folder)
    with pytest.raises(ValueError):
        technical_features(stream, WHOLE)


def test_cut_series_write_no_rows(long_bars, monkeypatch):
    """Scans over chunks write one row per chunk and never the bars."""
    from tickloom.operators import series as module

    written = []
    cut = module.cut_lineage
    monkeypatch.setattr(module, "cut_lineage", lambda df: (written.append((df.columns, df.count())), cut(df))[1])
    monkeypatch.setattr(module, "materialise", lambda *a: pytest.fail("rows were written"))
    layout = plan_series(long_bars, CHUNKED)
    chunks = layout.table.select("symbol", "__chunk").distinct().count()
    del written[:]
    frame = layout.open(long_bars, back=4).add({"wide": F.avg("close").over(layout.frames.last(4))})
    frame = frame.scan(cumulate={"running": F.col("volume")}, carry={"last": F.col("wide")}).totals({"all": F.max("high")})
    frame.close().count()
    assert [set(c) for c, _ in written] == [{"symbol", "__chunk", "__c_running", "__c_last"}, {"symbol", "__chunk", "all"}]
    # one row per chunk, and one for each short entity
    entities = long_bars.select("symbol").distinct().count()
    assert all(chunks <= n <= chunks + entities for _, n in written)
