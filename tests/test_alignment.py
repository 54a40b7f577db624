"""As-of alignment, session rules and the calendar against plain loops."""

import bisect
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import asof as A
from tickloom.operators import calendar as C
from tickloom.operators.news import bars_with_news, map_to_bars, news_per_bar

T = dt.datetime


def bars_of(spark, times, symbol="AAA"):
    return spark.createDataFrame([(symbol, t) for t in times], "symbol string, bar_ts timestamp_ntz")


def session(days, skip_open=()):
    out = []
    for d in days:
        t = T.combine(d, dt.time(4))
        while t.time() < dt.time(20):
            if not (d in skip_open and t.time() == dt.time(4)):
                out.append(t)
            t += dt.timedelta(minutes=5)
    return out


MON, TUE, WED = dt.date(2024, 1, 8), dt.date(2024, 1, 9), dt.date(2024, 1, 10)
BARS = session([MON, TUE, WED], skip_open=[TUE])

CASES = {
    T(2024, 1, 8, 3, 59, 59): T(2024, 1, 8, 4),
    T(2024, 1, 8, 4): T(2024, 1, 8, 4, 5),
    T(2024, 1, 8, 4, 0, 0, 1): T(2024, 1, 8, 4, 5),
    T(2024, 1, 8, 10, 2): T(2024, 1, 8, 10, 5),
    T(2024, 1, 8, 10, 5): T(2024, 1, 8, 10, 5),
    T(2024, 1, 8, 19, 55): T(2024, 1, 8, 19, 55),
    T(2024, 1, 8, 19, 57): T(2024, 1, 9, 4, 5),  # next bar, which is not an open
    T(2024, 1, 8, 20): T(2024, 1, 10, 4),  # next open, so the day without one is skipped
    T(2024, 1, 6, 4): T(2024, 1, 8, 4),  # a Saturday
    T(2024, 1, 6, 12): T(2024, 1, 8, 4),
    T(2024, 1, 10, 19, 58): None,
    T(2024, 1, 10, 21): None,
}


@pytest.mark.parametrize("grid", [300, None])
@pytest.mark.parametrize("compat", [False, True])
def test_session_rules(spark, grid, compat):
    news = spark.createDataFrame([("AAA", t) for t in CASES], "symbol string, time_published timestamp_ntz")
    found = map_to_bars(news, bars_of(spark, BARS), grid_seconds=grid, compat=compat)
    expected = dict(CASES)
    if compat:
        expected[T(2024, 1, 10, 19, 58)] = T(2024, 1, 10, 4)
    assert {r.time_published: r.bar_ts for r in found.collect()} == expected


def test_news_without_some_labels_and_scores(spark):
    schema = (
        "symbol string, time_published timestamp_ntz, overall_sentiment_score double, "
        "overall_sentiment_label string"
    )
    at = T(2024, 1, 8, 10, 2)
    news = spark.createDataFrame([("AAA", at, 0.1, "Neutral"), ("AAA", at, None, "Neutral")], schema)
    bars = bars_of(spark, BARS)
    rows = {r.bar_ts: r for r in bars_with_news(bars, news_per_bar(news, bars)).collect()}
    hit, miss = rows[T(2024, 1, 8, 10, 5)], rows[T(2024, 1, 8, 11)]
    assert (hit.sent_mean, hit.headline_count, hit.bullish_cnt) == (0.1, 2, 0)
    assert (miss.sent_mean, miss.headline_count) == (None, 0)


@pytest.mark.parametrize("unit", ["day", "hour", "minute", "year"])
def test_asof_against_a_loop(spark, monkeypatch, unit):
    """Two entities, one with nearly all points; cells of every size."""
    monkeypatch.setattr(A, "CELL_ROWS", 20)
    rng = random.Random(5)
    start = T(2024, 1, 1)
    points, marks = [], {}
    for e, n in (("hot", 400), ("cold", 10)):
        marks[e] = sorted({start + dt.timedelta(minutes=rng.randrange(6000)) for _ in range(40)})
        points += [(e, i, start + dt.timedelta(minutes=rng.randrange(7000))) for i in range(n)]
    p = spark.createDataFrame(points, "e string, i int, at timestamp_ntz")
    m = spark.createDataFrame([(e, t) for e in marks for t in marks[e]], "e string, mark timestamp_ntz")
    kind = dict(entity=["e"], at="at", mark_time="mark", bucket=unit)
    ahead = {(r.e, r.i): r.mark for r in A.asof_forward(p, m, **kind).collect()}
    behind = {(r.e, r.i): r.mark for r in A.asof_backward(p, m, **kind).collect()}
    assert len(ahead) == len(behind) == len(points)
    for e, i, t in points:
        known = marks[e]
        j, k = bisect.bisect_left(known, t), bisect.bisect_right(known, t)
        assert ahead[e, i] == (known[j] if j < len(known) else None)
        assert behind[e, i] == (known[k - 1] if k else None)


@pytest.mark.parametrize("forward", [False, True])
def test_null_keys_match_nothing(spark, monkeypatch, forward):
    monkeypatch.setattr(A, "CELL_ROWS", 2)
    day = dt.datetime(2024, 1, 2)
    points = [("a", 1, day), ("a", 2, None), (None, 3, day), (None, 4, None), (None, 5, day + dt.timedelta(days=1)), ("b", 6, day)]
    marks = [("a", None, 9.0), (None, day, 7.0), (None, None, 8.0), ("a", day, 1.0), ("b", day, None)]
    p = spark.createDataFrame(points, "e string, i int, at timestamp_ntz")
    m = spark.createDataFrame(marks, "e string, mark timestamp_ntz, bid double")
    join = A.asof_forward if forward else A.asof_backward
    found = join(p, m, entity=["e"], at="at", mark_time="mark", payload={"bid": F.col("bid")})
    assert {r.i: r.bid for r in found.collect()} == {1: 1.0, 2: None, 3: None, 4: None, 5: None, 6: None}


@pytest.mark.parametrize("forward", [False, True])
def test_a_dense_second_and_instant_are_cut(spark, monkeypatch, forward):
    """Nearly all rows of one entity within a second, a third of them at one instant."""
    monkeypatch.setattr(A, "CELL_ROWS", 40)
    rng = random.Random(8)
    start = T(2024, 1, 2, 10)
    moments = [start + dt.timedelta(microseconds=rng.choice([500, *range(0, 1000, 50)])) for _ in range(900)]
    moments += [start + dt.timedelta(days=d) for d in (-1, 1)]
    points = [("x", i, t) for i, t in enumerate(moments)]
    marks = [(start + dt.timedelta(microseconds=rng.choice([500, 500, *range(0, 1000, 7)])), rng.randrange(5)) for _ in range(300)]
    p = spark.createDataFrame(points, "e string, i int, at timestamp_ntz").repartition(4)
    m = spark.createDataFrame([("x", t, v) for t, v in marks], "e string, mark timestamp_ntz, v int").repartition(4)
    rows = p.selectExpr("e", "at AS __at", "0 AS __kind", "i").withColumn(A.CELL, F.date_trunc("day", "__at"))
    parts = A._with_parts(rows, ["e"], F.col("e").isNotNull(), [F.col("__at")], F.xxhash64("i"))
    sizes = [r["count"] for r in parts.groupBy(A.CELL, A.PART).count().collect()]
    assert max(sizes) <= 40 and sum(sizes) == len(points)
    join = A.asof_forward if forward else A.asof_backward
    found = join(p, m, entity=["e"], at="at", mark_time="mark", payload={"mark": F.col("mark"), "v": F.col("v")})
    got = {r.i: (r.mark, r.v) for r in found.collect()}
    for _, i, t in points:
        side = [(s, v) for s, v in marks if (s >= t if forward else s <= t)]
        assert got[i] == ((min(side) if forward else max(side)) if side else (None, None))


def _first_weekday(year, month, weekday):
    d = dt.date(year, month, 1)
    return d + dt.timedelta(days=(weekday - d.weekday()) % 7)


def test_calendar_against_date_loops(spark):
    start, end = dt.date(1995, 2, 3), dt.date(2005, 11, 30)
    rows = {r.day: r for r in C.economic_calendar(spark, start, end).collect()}
    meetings = [
        _first_weekday(y, m, 2) + dt.timedelta(days=6)
        for y in range(1995, 2006)
        for m in (1, 3, 5, 6, 7, 9, 11, 12)
    ]
    meetings = [m for m in meetings if start <= m <= end]
    seasons = {
        dt.date(y, m, 15) + dt.timedelta(days=i) for y in range(1994, 2006) for m in (1, 4, 7, 10) for i in range(21)
    }
    assert len(rows) == (end - start).days + 1
    for d, r in rows.items():
        after = [m for m in meetings if m >= d]
        before = [m for m in meetings if m <= d]
        assert r.fed_meeting == int(d in meetings)
        assert r.days_to_fed_meeting == ((after[0] - d).days if after else None)
        assert r.days_since_fed_meeting == ((d - before[-1]).days if before else None)
        assert r.earnings_season == int(d in seasons)
        thanksgiving = _first_weekday(d.year, 11, 3) + dt.timedelta(days=21)
        assert r.market_holiday == int((d.month, d.day) in ((1, 1), (7, 4), (12, 25)) or d == thanksgiving)
        assert r.half_day_trading == int(d == thanksgiving + dt.timedelta(days=1) or (d.month, d.day) == (12, 24))
        assert r.employment_report == int(d == _first_weekday(d.year, d.month, 4))
        assert r.options_expiration == int(d == _first_weekday(d.year, d.month, 4) + dt.timedelta(days=14))


def test_explicit_meeting_dates(spark):
    days = [dt.date(2024, 1, 31), dt.date(2024, 3, 20)]
    made = C.economic_calendar(spark, dt.date(2024, 1, 30), dt.date(2024, 3, 21), days)
    rows = {r.day: r for r in made.collect()}
    assert rows[days[0]].fed_meeting == 1 and rows[dt.date(2024, 1, 30)].days_to_fed_meeting == 1
    assert rows[dt.date(2024, 3, 21)].days_to_fed_meeting is None


def test_nearest_day_goes_up_at_noon_and_stops_at_the_end(spark):
    times = [T(2024, 1, 3, 11, 59), T(2024, 1, 3, 12), T(2024, 1, 4, 14), T(2024, 1, 4)]
    df = spark.createDataFrame([(t,) for t in times], "ts timestamp_ntz")
    out = {r.ts: r.jobless_claims for r in C.with_calendar(df, "ts", nearest=True).collect()}
    # 4 January 2024 is a Thursday and the last day
    assert [out[t] for t in times] == [0, 1, 1, 1]


def test_asof_with_equal_names_both_ways(spark):
    trades = spark.createDataFrame(
        [("a", dt.datetime(2024, 1, 2, 10, 0, 7), 1.0)], "symbol string, ts timestamp_ntz, bid double"
    )
    quotes = spark.createDataFrame(
        [("a", dt.datetime(2024, 1, 2, 10, 0, s), float(s)) for s in (5, 9)], "symbol string, ts timestamp_ntz, bid double"
    )
    payload = {"ts": F.col("ts"), "bid": F.col("bid")}
    for join, second in ((A.asof_backward, 5), (A.asof_forward, 9)):
        (r,) = join(trades, quotes, entity=["symbol"], at="ts", mark_time="ts", payload=payload).collect()
        assert (r.ts.second, r.bid, r.ts_mark.second, r.bid_mark) == (7, 1.0, second, float(second))


def test_bars_off_the_grid(spark):
    bars = bars_of(spark, [T(2024, 1, 8, 10, 1), T(2024, 1, 8, 10, 6)])
    news = spark.createDataFrame([("AAA", dt.datetime(2024, 1, 8, 10, 0, 30))], "symbol string, time_published timestamp_ntz")
    (r,) = map_to_bars(news, bars).collect()
    assert r.bar_ts == dt.datetime(2024, 1, 8, 10, 1)
    with pytest.raises(ValueError, match="grid"):
        map_to_bars(news, bars, grid_seconds=300)
