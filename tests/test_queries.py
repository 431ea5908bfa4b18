"""Registered queries against their SQL twins in DuckDB, on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: A cross-section; the driver compares all of them.
NAMES = ["n01_names", "n16_tournament_names", "g02_player_summary", "g14_average_histogram", "g19_rating_breakdown", "r07_provisional_ranking", "c11_club_index", "l04_official_standings", "l11_slot_ranking", "k05_cup_player_ranking", "i10_enrich_by_signature", "i19_dedup_cross_source", "t02_link_games", "t06_opens_ranking_history", "t18_seed_allocation", "q04_diff_reclassified", "x02_latest_state", "s04_extract_links", "c09_group_players", "x01_stream_snapshots", "x02_stream_state", "x04_stream_refresh", "x07_stream_fresh"]


def plain(x):
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(map(plain, x))
    if x is None or x is pd.NaT or x is pd.NA:
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (int, float, np.integer, np.floating, decimal.Decimal)):
        return None if math.isnan(x) else round(float(x), 6) + 0.0
    if isinstance(x, (datetime.datetime, pd.Timestamp)):
        return str(x)[:10] if x.hour == x.minute == x.second == 0 else str(x)
    return str(x)


def rows(df, cols):
    return sorted((tuple(map(plain, r)) for r in df[cols].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, duck, sf, name):
    got = entry.queries()[name](spark, sf)
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got.toPandas(), sorted(got.columns)), rows(want.df(), sorted(got.columns))
    assert len(a) > 0 and a == b


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
