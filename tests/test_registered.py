"""Registered queries against their SQL at the smallest scale.

A query of every area and a third of the others, by a hash of their names, run by default;
TICKLOOM_ALL=1 runs all of them. The queries of the training-data subpackage have tests of their own.
"""

import os
import zlib

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect
from tickloom.plans import catalog

QUERIES, SQL = entry.queries(), entry.oracle_sql()
CHOSEN = """
t02_band_squeeze t05_volume_price_trend t10_money_flow_index t15_rates_of_change t22_local_extrema
w02_percent_change w04_rolling_quantiles w07_weighted_means w12_fill_both_ways
j01_news_to_bar_compat j03_bars_with_news j04_asof_backward g01_news_per_bar n04_smoothed_momentum
n10_time_since_news c03_days_to_meeting x03_yield_curve x06_sector_dispersion j06_calendar_nearest
f08_time_split g05_quartiles_narrowed p02_roles p05_label_codes p09_gap_filling p12_last_sequence
d01_direction_classes d03_trend_direction d10_residual_bands g13_direction_backtest
a01_price_documents a06_append_sink a11_latest_run r03_streaming_bars
p14_default_plan g11_training_report
""".split()


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


def test_every_query_is_registered_once():
    assert set(SQL) <= set(QUERIES)
    assert set(CHOSEN) <= set(QUERIES)


OWN = [n for n in QUERIES if n in catalog.QUERIES]
SOME = [n for n in OWN if n in CHOSEN or zlib.crc32(n.encode()) % 3 == 0]


@pytest.mark.parametrize("name", OWN if os.environ.get("TICKLOOM_ALL") else SOME)
def test_query_equals_sql(spark, con, folder, name):
    assert compare(spark, con, folder, name, QUERIES[name], SQL.get(name)) is None


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["symbol", "bar_ts"] and df.limit(1).count() == 1
