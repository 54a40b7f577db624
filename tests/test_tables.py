"""Statistics, preparation, signals, parsers, sinks and streams."""

import datetime as dt
import json
import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import metrics as M
from tickloom.operators import prepare as P
from tickloom.operators import signals as G
from tickloom.operators import statistics as S
from tickloom.operators.series import Series
from tickloom.plans.training_table import TrainingPlan, build_training_table
from tickloom.session import materialise
from tickloom.sources import landed as L
from tickloom.sources import merge
from tickloom.sources import tables as T
from tickloom.streaming import flows as R


@pytest.mark.parametrize("most_groups", [1, 1 << 20])
def test_exact_quantiles_match_numpy(spark, most_groups):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame(
        {
            "smooth": rng.normal(size=5000),
            "heavy": np.where(rng.random(5000) < 0.34, 1.0, rng.integers(0, 50, 5000)),
            "skewed": np.exp(rng.normal(0, 4, 5000)),
        }
    )
    pdf.loc[:20, "smooth"] = np.nan
    df = spark.createDataFrame(pdf).replace(float("nan"), None)
    qs = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)
    found = S.exact_quantiles(df, ["smooth", "heavy", "skewed"], qs, most_groups)
    for (c, q), v in found.items():
        assert v == pytest.approx(pdf[c].dropna().quantile(q), rel=1e-12), (c, q)


def test_quantiles_of_missing_columns(spark):
    df = spark.createDataFrame([(None, 2.0), (None, 2.0)], "a double, b double")
    assert S.exact_quantiles(df, ["a", "b"], (0.5,)) == {("a", 0.5): None, ("b", 0.5): 2.0}


def test_modes_take_the_smallest_on_ties(spark):
    df = spark.createDataFrame([(2.0, "b"), (1.0, "b"), (2.0, None), (1.0, "a")], "x double, s string")
    assert {r.feature: (r.mode, r.copies) for r in S.modes(df, ["x", "s"]).collect()} == {
        "x": ("1.0", 2),
        "s": ("b", 2),
    }


def test_scaler_keeps_flat_columns_and_ignores_outliers(spark):
    df = spark.createDataFrame([(float(i), 3.0) for i in range(5)] + [(1e9, 3.0)], "x double, flat double")
    scaler = P.fit_scaler(df, ["x", "flat"])
    assert scaler.stats["flat"] == (3.0, 1.0)
    assert scaler.stats["x"] == (2.5, 2.5)
    assert scaler.transform(df).select(F.max("flat")).first()[0] == 0.0


def test_unseen_and_missing_labels(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "s string")
    labels = P.fit_labels(df, ["s"])
    new = spark.createDataFrame([("a",), ("b",), ("zz",), (None,)], "s string")
    codes = [r.s for r in labels.transform(new).collect()]
    # sorted strings: Unknown, a, b; the unseen zz reads as Unknown
    assert sorted(codes) == [0, 0, 1, 2]
    spare = P.fit_labels(df.dropna(), ["s"]).transform(new)
    assert sorted(r.s for r in spare.collect()) == [0, 1, 2, 2]


def test_equal_scores_at_the_cut(spark):
    df = spark.createDataFrame(
        [("b", "r", 1.0), ("a", "r", 1.0), ("c", "r", 2.0)], "feature string, role string, importance_score double"
    )
    assert {r.feature for r in P.top_features(df, {"r": 2}).collect()} == {"c", "a"}


def test_cleaning_needs_enough_rows(spark):
    df = spark.createDataFrame([("a", 1, 1.0)], "symbol string, t int, target double")
    with pytest.raises(ValueError):
        P.clean_training_table(df, Series(("symbol",), "t", max_rows=1), min_rows=100)


def test_short_entities_give_no_sequences(spark):
    df = spark.createDataFrame(
        [("a", i, float(i)) for i in range(40)] + [("b", 0, 1.0)], "symbol string, t int, target double"
    )
    out = P.sequence_samples(df, Series(("symbol",), "t", max_rows=40), history=["target"]).toPandas()
    assert set(out.symbol) == {"a"}
    # rows 24..38 have 25 rows of history and at least one row ahead
    assert sorted(out.t) == list(range(24, 39))
    assert out[out.t == 30].decoder_length.item() == 9


def test_thresholds_of_the_classification(spark):
    changes = [0.0, 0.5, 0.51, -0.5, -0.51, 1.0, 1.01, 2.0, 2.01, None]
    df = spark.createDataFrame(
        [(i, 100.0, None if c is None else 100.0 + c) for i, c in enumerate(changes)],
        "step int, current_price double, predicted_price double",
    )
    # thresholds are judged on exact percentages
    df = df.withColumn("predicted_price", F.col("predicted_price").cast("double"))
    got = [(r.direction, r.direction_confident, r.magnitude) for r in G.classify(df).orderBy("step").collect()]
    assert got[0] == ("DOWN", "NEUTRAL", "MINIMAL")
    assert got[1] == ("UP", "NEUTRAL", "MINIMAL")
    assert got[2] == ("UP", "UP", "WEAK")
    assert got[3] == ("DOWN", "NEUTRAL", "MINIMAL")
    assert got[4] == ("DOWN", "DOWN", "WEAK")
    assert got[5][2] == "WEAK" and got[6][2] == "MODERATE"
    assert got[7][2] == "MODERATE" and got[8][2] == "STRONG"
    assert got[9] == (None, None, None)


def test_stored_prediction_arithmetic(spark):
    """Three published forecasts on a price of 150 and their results."""
    rows = [
        (1, 157.6973114013671875, 7.6973114013671875, 5.131540934244792),
        (6, 158.235122680664062, 8.235122680664062, 5.490081787109375),
        (12, 158.475845336914062, 8.475845336914062, 5.650563557942708),
    ]
    df = spark.createDataFrame([(s, p, 150.0) for s, p, _, _ in rows], "step int, predicted_price double, current_price double")
    made = G.classify(df)
    for r, (_, _, change, pct) in zip(made.orderBy("step").collect(), rows):
        assert (r.price_change, r.price_change_pct) == (pytest.approx(change), pytest.approx(pct))
        assert (r.classification, r.up_probability, r.down_probability) == ("UP_STRONG", 1.0, 0.0)
    summary = {r.metric: r.value for r in M.prediction_summary(made).collect()}
    assert summary["direction_up_count"] == 3 and summary["direction_up_percentage"] == 100
    assert "direction_down_count" not in summary and summary["avg_confidence"] == 1
    assert G.trading_signals(made).columns == ["step", "signal", "confidence", "strength", "price_target", "change_percent"]


def test_missing_current_price_is_an_error(spark):
    df = spark.createDataFrame([(1, None)], "step int, current_price double")
    with pytest.raises(ValueError):
        G.require_prices(df)


def test_metrics_leave_small_truths_out_of_mape(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0), (None, 5.0)], "y double, p double")
    r = M.regression_metrics(df, "y", "p").first()
    assert (r.mae, r.mse, r.mape, r.n) == (1.0, 1.0, 50.0, 2)


def test_landed_files(spark, tmp_path):
    good = {
        "Meta Data": {"2. Symbol": "AAA"},
        "Time Series (5min)": {
            "2024-01-08 04:00:00": {"1. open": "1.5", "2. high": "2", "3. low": "1", "5. volume": "7"},
            "2024-01-08 04:05:00": {"1. open": "1.5", "2. high": "2", "3. low": "1", "4. close": "x", "5. volume": "7"},
            "some day": {"1. open": "1.5"},
        },
    }
    (tmp_path / "AAA_2024-01.json").write_text(json.dumps(good, indent=1))
    (tmp_path / "BBB_2024-01.json").write_text(json.dumps({"Note": "slow down"}))
    (tmp_path / "CCC_2024-01.json").write_text("not json")
    docs = L.read_documents(spark, str(tmp_path), r"^([A-Z]+)_")
    rows, bad = L.parse_prices(docs)
    (r,) = rows.collect()
    assert (r.symbol, r.open, r.close, r.volume, r.bar_ts.hour) == ("AAA", 1.5, None, 7.0, 4)
    entries = {(b.symbol, json.loads(b.entry)["time"] if b.entry else None) for b in bad.collect()}
    assert entries == {("AAA", "2024-01-08 04:05:00"), ("AAA", "some day"), ("BBB", None), ("CCC", None)}


def test_news_documents(spark):
    doc = json.dumps({"feed": [{"title": "t", "time_published": "20240108T101112", "overall_sentiment_score": 0.25, "overall_sentiment_label": "Somewhat-Bullish", "topics": [{"topic": "x"}]}]})
    df = spark.createDataFrame([("AAA", doc), ("BBB", '{"Information": "none"}')], "symbol string, doc string")
    rows, bad = L.parse_news(df)
    (r,) = rows.collect()
    assert (str(r.time_published), r.overall_sentiment_score, r.topics[0].topic) == ("2024-01-08 10:11:12", 0.25, "x")
    assert [b.symbol for b in bad.collect()] == ["BBB"]


def test_validation_errors(spark):
    bars = spark.createDataFrame([(1, 1.0)], "bar_ts int, open double")
    with pytest.raises(ValueError, match="high"):
        T.validate_bars(bars)


def test_streaming_drops_late_ticks(spark, tmp_path):
    """The second file holds a tick older than the watermark of the first."""
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    schema = "symbol string, ts timestamp_ntz, value double"
    parts = [
        [("a", pd.Timestamp("2024-01-01 10:01"), 1.0), ("a", pd.Timestamp("2024-01-01 14:00"), 2.0)],
        [("a", pd.Timestamp("2024-01-01 10:02"), 9.0), ("a", pd.Timestamp("2024-01-01 18:00"), 3.0)],
    ]
    bars = R.streaming_bars(spark.readStream.schema(schema).parquet(str(source)), step="5 minutes")
    for part in parts:
        rows = [(s, t.to_pydatetime(), v) for s, t, v in part]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        query = (
            bars.writeStream.format("parquet")
            .option("path", out)
            .option("checkpointLocation", str(tmp_path / "state"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    got = {str(r.bar_ts): (r.high, r.volume) for r in spark.read.parquet(out).collect()}
    assert got == {"2024-01-01 10:00:00": (1.0, 1.0), "2024-01-01 14:00:00": (2.0, 1.0)}


def test_mutual_information_ranks_the_informative_feature(spark):
    rng = np.random.default_rng(2)
    y = rng.normal(size=3000)
    pdf = pd.DataFrame({"y": y, "near": y + rng.normal(0, 0.1, 3000), "noise": rng.normal(size=3000)})
    scores = {r.feature: r.importance_score for r in P.mutual_information(spark.createDataFrame(pdf), ["near", "noise"], "y").collect()}
    assert scores["near"] > 1 > 0.1 > scores["noise"] >= 0
    assert not math.isnan(scores["noise"])


def test_precise_mutual_information_tells_doubles_apart(spark):
    rows = [(1000.0 + k * 1e-10, float(k)) for k in range(500)]
    df = spark.createDataFrame(rows, "x double, y double")
    assert P.mutual_information(df, ["x"], "y", precise=True).first().importance_score == pytest.approx(math.log(10), abs=0.01)
    from tickloom.plans.prepare_queries import ORACLES

    assert "FLOAT" not in ORACLES["p10_feature_importance"].upper()


def test_feature_importance_is_the_whole_job(spark):
    """The SQL bins the columns as they are, and neither side cuts the score before it is shown."""
    from tickloom.plans.prepare_queries import ORACLES, RANKED

    known = ", ".join([*[f"coalesce({c}, 0) AS {c}" for c in RANKED], "target"])
    assert f"known AS (SELECT {known} FROM targets)" in ORACLES["p10_feature_importance"]
    df = spark.createDataFrame([(float(k % 3), float(k % 7 % 2)) for k in range(61)], "x double, y double")
    rows = [(r.x, r.y) for r in df.collect()]
    n = len(rows)

    def entropy(values):
        return -sum(values.count(v) / n * math.log(values.count(v) / n) for v in set(values))

    wanted = entropy([x for x, _ in rows]) + entropy([y for _, y in rows]) - entropy(rows)
    assert abs(wanted - round(wanted, P.SCORE_DIGITS)) > 1e-11
    found = P.mutual_information(df, ["x"], "y", bins=3, precise=True).first().importance_score
    assert found == pytest.approx(wanted, abs=1e-13)


def test_scratch_is_dropped(spark, tmp_path):
    from tickloom import session

    path = session.scratch_path(spark, "some")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    session.drop_scratch(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_fits_take_nan_and_infinity_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (float("nan"),), (float("inf"),), (None,)], "x double")
    assert S.exact_quantiles(df, ["x"], (0.0, 0.5, 1.0)) == {("x", 0.0): 1.0, ("x", 0.5): 2.0, ("x", 1.0): 3.0}
    assert P.fit_scaler(df, ["x"]).stats == {"x": (2.0, 1.0)}


def test_label_codes_of_a_common_beginning(spark):
    df = spark.range(3000).selectExpr("concat('Customer#', lpad(CAST(id AS STRING), 9, '0')) AS name", "IF(id % 3 = 0, 'a', 'b') AS kind")
    encoder = P.fit_labels(df, ["name", "kind"])
    rows = encoder.transform(df.withColumn("raw", F.col("name"))).collect()
    assert all(r.name == int(r.raw[-9:]) for r in rows) and {r.kind for r in rows} == {0, 1}
    unseen = spark.createDataFrame([("new", None)], "name string, kind string")
    assert [tuple(r) for r in encoder.transform(unseen).collect()] == [(3000, 2)]


def test_of_conflicting_repeats_one_is_fixed(spark):
    rows = [("a", 1, 5.0, 0), ("a", 1, 7.0, 1), ("a", 1, 6.0, 1), ("b", 1, None, 0)]
    df = spark.createDataFrame(rows, "symbol string, bar_ts int, close double, loaded int")
    for parts in (1, 3):
        kept = T.one_per_key(df.repartition(parts), ["symbol", "bar_ts"], F.col("loaded")).collect()
        assert sorted((r.symbol, r.close) for r in kept) == [("a", 7.0), ("b", None)]


def test_interactions_have_no_limit_and_no_part_words(spark):
    names = ["open", "high", "low", "close", "volume", "volume_ma", "sent_mean", "vix_level", "high_sentiment_volatility"]
    pairs = P.interaction_pairs(names)
    assert ("close", "volume_ma") in pairs and ("sent_mean", "vix_level") in pairs and len(pairs) == len(set(pairs))


@pytest.mark.parametrize("most_groups", [1, 1 << 20])
def test_quantiles_of_odd_values(spark, most_groups):
    """Signs, magnitudes from denormal to the largest, near neighbours, ties, one value."""
    some = np.random.default_rng(5)
    wide = np.exp(some.normal(0, 100, 700)) * some.choice([-1, 1], 700)
    columns = {
        "wide": np.where(np.isfinite(wide), wide, 1.0),
        "near": 100 + np.arange(700) * 1.5e-14,
        "tiny": some.integers(-3, 4, 700) * 5e-324,
        "large": some.choice([1.7e308, -1.7e308, 0.0], 700),
        "flat": np.full(700, 3.0),
        "one": np.array([7.5] + [np.nan] * 699),
    }
    df = spark.createDataFrame(pd.DataFrame(columns)).repartition(5)
    qs = [0.0, 0.001, 0.1, 1 / 3, 0.5, 0.9, 0.999, 1.0]
    found = S.exact_quantiles(df, list(columns), qs, most_groups)
    for c, values in columns.items():
        held = np.sort(values[np.isfinite(values)])
        for q in qs:
            low, high = held[math.floor(q * (len(held) - 1))], held[math.ceil(q * (len(held) - 1))]
            assert min(low, high) <= found[c, q] <= max(low, high)
            if low == high:
                assert found[c, q] == low


def _wide_table(spark, columns):
    return spark.range(400).select(*[(F.rand(i) * (i + 1)).alias(f"c{i}") for i in range(columns)])


def test_a_thousand_columns_are_one_block(spark, monkeypatch):
    """A pass holds one expression for all columns, and no more counters than allowed."""
    most, seen = 20_000, []
    counted = S._counted

    def watched(cells, of, bucket):
        found = counted(cells, of, bucket)
        seen.append((found.count(), found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate")))
        return found

    monkeypatch.setattr(S, "_counted", watched)
    monkeypatch.setattr(S, "LEAST_BINS", 4)
    df = materialise(_wide_table(spark, 1000), "wide")
    found = S.exact_quantiles(df, df.columns, (0.25, 0.5), most)
    assert len(found) == 2000 and len(seen) > 2
    assert all(groups <= max(most, 4 * 4000) and aggregates == 1 for groups, aggregates in seen)
    wanted = df.select("c0", "c7", "c999").toPandas().quantile([0.25, 0.5])
    for c in wanted:
        for q in (0.25, 0.5):
            assert found[c, q] == pytest.approx(wanted[c][q], rel=1e-12)


def test_written_once_looks_at_the_plan_not_its_text(spark, tmp_path):
    path = str(tmp_path / "Sort Map Join")
    spark.range(5).selectExpr("id AS `Window`", "id * 2 AS x").write.parquet(path)
    scan = spark.read.parquet(path).where("`Window` > 1").selectExpr("x", "`Window` + 1 AS `Aggregate`")
    assert S.written_once(scan) is scan
    assert S.written_once(scan.distinct()) is not scan


def test_candidates_are_scored_without_being_made(spark):
    """Lags and products score as if they were columns, with the bins of the lag's own column."""
    some = np.random.default_rng(6)
    n = 400
    pdf = pd.DataFrame({"symbol": ["a"] * 250 + ["b"] * 150, "bar_ts": range(n), "x": some.normal(size=n), "z": some.normal(size=n)})
    pdf["y"] = pdf.groupby("symbol").x.shift(2).fillna(0) * 3 + some.normal(size=n) / 10 + pdf.x * pdf.z
    pdf.loc[::7, "z"] = None
    df = spark.createDataFrame(pdf).replace(float("nan"), None).repartition(4)
    for rows in (10_000, 60):  # whole and cut series
        series = Series(("symbol",), "bar_ts", bucket="second", chunk_rows=rows)
        stamped = df.withColumn("bar_ts", F.timestamp_seconds("bar_ts"))
        wanted = P.Candidates(["x", "z"], [("x", "z")], ["x", "z"], (1, 2, 5))
        scores = {r.feature: r for r in P.score_candidates(stamped, wanted, "y", series).collect()}
        assert list(scores) == wanted.names() or set(scores) == set(wanted.names())
        made = {"x": pdf.x, "z": pdf.z, "x_x_z": pdf.x * pdf.z}
        cuts = {c: np.unique(np.quantile(v.astype(np.float32).astype(float).fillna(0), [i / 10 for i in range(1, 10)])) for c, v in {**made, "y": pdf.y}.items()}
        base = {c: c for c in made}
        for k in (1, 2, 5):
            for c in ("x", "z"):
                made[f"{c}_lag_{k}"], base[f"{c}_lag_{k}"] = pdf.groupby("symbol")[c].shift(k), c
        side = np.searchsorted(cuts["y"], pdf.y.astype(np.float32).astype(float))
        for c, v in made.items():
            mine = np.searchsorted(cuts[base[c]], v.astype(np.float32).astype(float).fillna(0))
            joint = pd.crosstab(mine, side).to_numpy() / n
            own = joint.sum(axis=1, keepdims=True) * joint.sum(axis=0, keepdims=True)
            score = (joint[joint > 0] * np.log(joint[joint > 0] / own[joint > 0])).sum()
            assert scores[c].importance_score == pytest.approx(score, abs=2e-9), c
            assert scores[c].present_share == pytest.approx(v.notna().mean())


def test_only_chosen_lags_and_products_are_made(spark):
    some = np.random.default_rng(7)
    n = 300
    close = 100 + some.normal(size=n).cumsum()
    pdf = pd.DataFrame({"symbol": "a", "bar_ts": pd.date_range("2024-01-01", periods=n, freq="h"), "open": close, "high": close + 1, "low": close - 1, "close": close, "volume": some.integers(1, 9, n).astype(float)})
    df = spark.createDataFrame(pdf).withColumn("bar_ts", F.col("bar_ts").cast("timestamp_ntz"))
    plan = TrainingPlan(include_technical=False, include_events=False, max_features={"unknown_future": 3, "known_future": 1, "static": 1})
    made = build_training_table(df, Series(("symbol",), "bar_ts"), plan)
    chosen = [c for cs in made.selected.values() for c in cs]
    assert len(chosen) <= 5 and {*chosen, "symbol", "bar_ts", "time_idx", "is_train", "target", "close"} == set(made.table.columns)
    assert len(made.roles.unknown_future) > 20 and made.importance.count() == len(chosen)
    assert P.remaining_gaps(made.table).first().missing == 0


def _news(spark, rows):
    made = [(k, dt.datetime(2024, m, 3) if m else None, load, text) for k, m, load, text in rows]
    return spark.createDataFrame(made, "article int, published timestamp_ntz, loaded int, text string")


def _table(spark, path):
    return sorted((r.article, r.text, str(r.month)) for r in spark.read.parquet(path).collect())


def test_a_merge_reads_its_months_only(spark, tmp_path, monkeypatch):
    path, read = str(tmp_path / "news"), []
    months_of = merge._months_of

    def watched(held, months):
        found = months_of(held, months)
        scan = found._jdf.queryExecution().executedPlan()
        # the filter on months chooses folders, so other files are not opened
        assert re.search(r"PartitionFilters: \[[^]]*month", scan.toString())
        files = {r[0] for r in found.select(F.input_file_name()).distinct().collect()}
        counted = scan.execute().getNumPartitions()
        read.append({f.split("month=")[1].split("/")[0] for f in files})
        assert counted <= len(files)
        return found

    monkeypatch.setattr(merge, "_months_of", watched)
    merge.merge_rows(_news(spark, [(k, m, 0, "old") for k, m in enumerate([1, 1, 2, 3, 4, None])]), path, ["article"], "published")
    merge.merge_rows(_news(spark, [(0, 1, 1, "new"), (9, 1, 0, "new"), (9, 1, 0, "new")]), path, ["article"], "published")
    assert read == [{"2024-01"}]
    old = [(0, "old", "2024-01"), (1, "old", "2024-01"), (2, "old", "2024-02"), (3, "old", "2024-03"), (4, "old", "2024-04"), (5, "old", "none")]
    assert _table(spark, path) == sorted([*old, (9, "new", "2024-01")])
    merge.merge_rows(_news(spark, [(0, 1, 1, "new"), (3, 3, -1, "older"), (5, None, 2, "new")]), path, ["article"], "published", prefer="loaded")
    assert read[1:] == [{"2024-01", "2024-03", "none"}]
    wanted = [(0, "new", "2024-01"), *old[1:5], (5, "new", "none"), (9, "new", "2024-01")]
    assert _table(spark, path) == sorted(wanted)
    merge.merge_rows(_news(spark, []), path, ["article"], "published")
    assert _table(spark, path) == sorted(wanted)


@pytest.mark.parametrize("prefer", [None, "loaded"])
@pytest.mark.parametrize("when", ["before the note", "first month", "second month"])
def test_a_killed_merge_leaves_the_table_whole(spark, tmp_path, monkeypatch, prefer, when):
    path = str(tmp_path / "news")
    merge.merge_rows(_news(spark, [(1, 1, 0, "old"), (2, 2, 0, "old"), (3, 3, 0, "old")]), path, ["article"], "published")
    before, calls = _table(spark, path), []
    swap, write = merge._swap_month, merge._Folder.write

    def killed(*arguments):
        calls.append(arguments)
        if when == "before the note" or (when == "first month" and len(calls) == 1) or len(calls) == 2:
            raise RuntimeError("killed")
        return swap(*arguments)

    monkeypatch.setattr(*((merge._Folder, "write") if when == "before the note" else (merge, "_swap_month")), killed)
    more = _news(spark, [(1, 1, 1, "new"), (4, 1, 0, "new"), (5, 2, 0, "new")])
    with pytest.raises(RuntimeError):
        merge.merge_rows(more, path, ["article"], "published", prefer)
    monkeypatch.setattr(merge._Folder, "write", write)
    monkeypatch.setattr(merge, "_swap_month", swap)
    if when == "before the note":
        assert _table(spark, path) == before
    merge.recover(spark, path)
    first = (1, "new" if prefer else "old", "2024-01")
    done = sorted([first, (2, "old", "2024-02"), (3, "old", "2024-03"), (4, "new", "2024-01"), (5, "new", "2024-02")])
    assert _table(spark, path) == (before if when == "before the note" else done)
    merge.merge_rows(more, path, ["article"], "published", prefer)
    assert _table(spark, path) == done and not (tmp_path / "news" / "_staged").exists()


def test_news_waits_for_bars_that_may_still_land(spark, tmp_path):
    """The bar of 10:10 lands before that of 10:05: news of 10:02 belongs to 10:05."""
    schema = "symbol string, time_published timestamp_ntz, article_id int"
    landing, held, out = (str(tmp_path / n) for n in ("news", "bars", "out"))
    day = lambda h, m: dt.datetime(2024, 1, 8, h, m)
    steps = [
        ([("a", day(10, 2), 1), ("b", day(10, 2), 2)], [("a", day(10, 10)), ("b", day(10, 5))]),
        ([("a", day(10, 8), 3)], [("a", day(10, 5)), ("b", day(12, 0))]),
        ([], [("a", day(11, 20))]),
    ]
    written = []
    for news, bars in steps:
        spark.createDataFrame(bars, "symbol string, bar_ts timestamp_ntz").write.mode("append").parquet(held)
        spark.createDataFrame(news, schema).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(schema).parquet(landing)
        R.map_each_batch(stream, lambda: spark.read.parquet(held), out, f"{out}-state", True, "1 hour").awaitTermination()
        written.append({r.article_id: r.bar_ts for r in spark.read.parquet(out).collect()})
    assert written[:2] == [{}, {2: day(10, 5)}]
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "out").glob("batch=*"))
    R.map_pending(spark.createDataFrame([], schema), spark.read.parquet(held), out, last)
    assert {r.article_id: r.bar_ts for r in spark.read.parquet(out).collect()} == {1: day(10, 5), 2: day(10, 5), 3: day(10, 10)}


def test_forty_features_and_twelve_steps_in_one_small_plan(spark, monkeypatch):
    from tickloom.operators import forecast

    some = np.random.default_rng(11)
    width, steps, n = 40, range(1, 13), 300
    x = some.normal(5, 2, (n, width))
    pdf = pd.DataFrame(x, columns=[f"f{i}" for i in range(width)])
    weights = some.normal(size=(width, len(steps)))
    for s, k in enumerate(steps):
        pdf[f"actual_{k}"] = x @ weights[:, s] + k + some.normal(0, 0.1, n)
        pdf.loc[n - 3 * k :, f"actual_{k}"] = np.nan
    pdf.loc[::29, "actual_5"] = np.nan
    df = spark.createDataFrame(pdf).replace(float("nan"), None)
    plans = []
    products = forecast._products

    def watched(held, *rest):
        before = type(held).groupBy
        monkeypatch.setattr(type(held), "groupBy", lambda self, *c: (plans.append(self), before(self, *c))[1])
        try:
            return products(held, *rest)
        finally:
            monkeypatch.setattr(type(held), "groupBy", before)

    monkeypatch.setattr(forecast, "_products", watched)
    models = forecast.fit_pooled_regression(df, [f"f{i}" for i in range(width)], list(steps))
    last = plans[-1]._jdf.queryExecution().optimizedPlan().toString()
    assert last.count("sum(") <= 100 and len(plans) == 2
    for k in steps:
        held = pdf.dropna(subset=[f"actual_{k}"])
        design = np.column_stack([np.ones(len(held)), held[[f"f{i}" for i in range(width)]]])
        wanted = np.linalg.lstsq(design, held[f"actual_{k}"], rcond=None)[0]
        assert np.allclose([models[k].intercept, *models[k].coefficients], wanted, atol=1e-8)


def test_all_daily_groups_in_one_pass(spark):
    """The context of all series equals the tables of the single groups, with few exchanges."""
    from tickloom.operators import cross_asset as X

    some = np.random.default_rng(12)
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(90)]
    rows = [(s, d, float(v) if some.random() > 0.1 else None) for s in ("VIX", "DXY", "FVX", "TNX", "XLA", "XLB") for d, v in zip(days, 20 + some.normal(0, 4, 90).cumsum()) if some.random() > 0.15]
    daily = spark.createDataFrame(rows, "series string, day date, close double").repartition(3)
    made = X.daily_context(daily, ["XLA", "XLB"])
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3
    tables = dict(zip(("volatility", "treasury", "dollar", "sectors"), X.cross_asset_tables(daily, ["XLA", "XLB"])))
    found = {r.day: r for r in made.collect()}
    for name, table in tables.items():
        wanted = {r.day: r.asDict() for r in table.collect()}
        got = {d: {"day": d, **r[name].asDict()} for d, r in found.items() if r[name] is not None}
        assert set(got) == set(wanted), name
        for d, row in wanted.items():
            assert set(row) == set(got[d])
            for c, v in row.items():
                assert got[d][c] == (pytest.approx(v, rel=1e-9, abs=1e-9) if isinstance(v, float) else v), (name, d, c)
