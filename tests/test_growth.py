"""What grows eightfold, the games of rankings, is neither shuffled nor written; the last ranking is chosen before places are given."""

import datetime
import re
import tempfile

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

from tallybook.operators import games as G, merge as M, rankings as R, ratings as X, reconcile as Q, repair as P
from tallybook.plans import q_league, registry
from tallybook.plans.adapter import tables, with_tables
from tallybook.sources import marts
from tallybook.streaming import keyed, live


@pytest.fixture(scope="module")
def domain(spark, sf):
    return tables(spark, sf, "sides", "links", "ranking_entries")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def above(text, node):
    """The lines of a plan above the first that has a node, which are those done after it."""
    lines = text.splitlines()
    return lines[:next(i for i, x in enumerate(lines) if node in x)]


def test_links_by_plain_loop(domain):
    """Every game counts in the eight quarterly rankings after it, where these exist, numbered from the newest, 15 at most."""
    sides, links, _ = domain
    month = lambda d: d.year * 12 + d.month
    games, seqs, groups = sides.select("discipline", "player_id", "game_id", "played_on").collect(), {}, {}
    for g in games:
        if g.played_on.month in (3, 6, 9, 12):
            seqs[g.discipline, month(g.played_on)] = (g.played_on.year - 1995) * 11 + g.played_on.month - (g.played_on.month >= 8)
        for k in range(1, 9):
            groups.setdefault((g.discipline, g.player_id, 3 * (month(g.played_on) // 3 + k)), []).append((g.played_on, g.game_id))
    want = {(d, seqs[d, m], p, i, n) for (d, p, m), x in groups.items() if (d, m) in seqs for n, (_, i) in enumerate(sorted(x, reverse=True)[:15], 1)}
    got = [tuple(r) for r in links.select("discipline", "seq", "player_id", "game_id", "rn").collect()]
    assert len(got) == len(set(got)) and set(got) == want and max(x[4] for x in want) == 15


def test_links_and_entries_are_not_shuffled(domain):
    _, links, entries = domain
    for df in (links, entries.drop("pos"), links.groupBy("discipline", "seq", "player_id").count()):
        assert not [x for x in above(plan(df), "Generate posexplode") if "Exchange" in x]


def test_last_ranking_is_chosen_before_places(domain):
    entries = domain[2]
    x = above(plan(R.latest(entries)), "Window [row_number()")
    assert not [y for y in x if "BroadcastHashJoin" in y]
    assert G.latest_games(domain[0], domain[1]).where("counts").count() > 0
    assert not re.search(r"max\(seq#\d+\) windowspecdefinition", plan(G.latest_games(domain[0], domain[1])))


def test_ratings_join_entries_where_they_lie(domain):
    """The averages meet the games by player and discipline; neither is shuffled by ranking."""
    text = plan(X.opponent_rating(*domain))
    assert not re.search(r"hashpartitioning\([^)]*seq#", text)


def test_copies_read_the_lines_once(spark, sf):
    text = plan(entry.queries()["i19_dedup_cross_source"](spark, sf))
    assert "lineitem.parquet" not in text


def test_official_standings_of_teams_named_by_their_club(spark):
    """Team 26 is official under 4026, of the club of 4025, which has no official row: the only one left of its club takes it, in the SQL too."""
    rows = [("s", 26, 4025, 0, 0, 2, 0, 5, 1), ("s", 5, 26, 0, 0, 1, 1, 3, 3), ("s", 4025, 5, 0, 0, 0, 2, 2, 4), ("s", 13, 4013, 0, 0, 2, 0, 6, 0)]
    cols = "season string, home long, away long, division_id int, group_id int, mp_home int, mp_away int, pp_home int, pp_away int"
    got = {tuple(r) for r in q_league.l04(spark.createDataFrame(rows, cols)).select("team_id", "points", "opos", "opoints", "penalty", "k").collect()}
    values = ", ".join(map(str, rows))
    ties = f"WITH league_ties AS (SELECT * FROM (VALUES {values}) t({', '.join(x.split()[0] for x in cols.split(', '))}))"
    sql = registry.ORACLES["l04_official_standings"].removeprefix(with_tables("league_ties"))
    want = set(duckdb.connect().sql(f"SELECT team_id, points, opos, opoints, penalty, k FROM ({ties} {sql}) x").fetchall())
    assert got == want and {x[0] for x in got if x[2] is not None} >= {5, 4025}


def test_repeated_names_are_scored_once_and_places_alone_are_carried(spark, monkeypatch):
    """Forty people under each of four like names: two names are scored once, and no round of the pairing writes more rows than there are people."""
    kept, durable = [], Q.durable
    monkeypatch.setattr(Q, "durable", lambda df: kept.append(durable(df)) or kept[-1])
    names = ["PUIG VILÀ, PERE", "PUIG VILA, PERA", "PUIG VILAR, PERE", "PUIG VILÀS, PERE"]
    people = spark.range(160).selectExpr("id", f"element_at(array({', '.join(map(repr, names))}), int(id % 4) + 1) AS name")
    pairs = people.selectExpr("id AS a", "name AS na").crossJoin(people.selectExpr("id AS b", "name AS nb"))
    scored = Q.name_score(pairs, "na", "nb")
    assert scored.count() == 160 * 160 and "ArrowEvalPython" not in plan(scored) and max(df.count() for df in kept) == 16
    kept.clear()
    got = {(r.pos, r.cid) for r in Q.fuzzy_pairs(people.selectExpr("id AS pos", "name"), people.where("id < 100").selectExpr("id AS cid", "name")).collect()}
    assert len(got) == 100 and {a for a, b in got if a == b} == set(range(100))
    assert max(df.count() for df in kept if "pos" in df.columns) <= 160


def test_last_rankings_are_made_alone(spark, sf, domain):
    """The tables of the last rankings hold what all rankings say of them, and queries of these make no others."""
    links, entries = tables(spark, sf, "last_links", "last_entries")
    for few, every in ((links, domain[1]), (entries, domain[2])):
        assert few.dtypes == every.dtypes
        got, want = (sorted(map(tuple, df.collect())) for df in (few, R.latest(every)))
        assert got == want and got
    for name in ("r01_latest_top", "c11_club_index", "g31_counting_games"):
        assert "posexplode" not in plan(entry.queries()[name](spark, sf))


def test_logs_of_both_players_of_a_game(spark, sf, monkeypatch):
    """A game stands in the logs of both its players under one id: each side gets one row, and no row is copied into bins of days on its way."""
    kept, durable = [], Q.durable
    monkeypatch.setattr(Q, "durable", lambda df: kept.append(df) or durable(df))
    one = "id long, player_id long, discipline int, car int, opp_car int, ent int, opp string, day date, run int"
    day = lambda n: datetime.date(2024, 1, n)
    fed = [(1, 7, 1, 20, 10, 9, "PUIG VILA, ANNA", day(1), 3), (1, 8, 1, 10, 20, 9, "ROIG SOLE, PERE", day(1), 2), (2, 8, 1, 5, 6, 9, "PUIG VILA, ANNA", None, 1)]
    own = [(9, 7, 1, 20, 10, 9, "Puig Vila, Anna", day(1), 3), (9, 8, 1, 11, 20, 9, "Roig Sole, Pere", day(2), 2), (10, 8, 1, 5, 6, 9, "Puig Vila, Anna", None, 1)]
    got = {tuple(r) for r in Q.reconcile_log(spark.createDataFrame(fed, one), spark.createDataFrame(own, one)).collect()}
    assert got == {(7, 1, 9, "same", ""), (8, 1, 9, "update", "car,day"), (8, 2, None, "insert", None)}
    text = plan(kept[0])
    assert not re.search(r"Generate explode\((array|sequence)", text) and "bin#" not in text
    sides = tables(spark, sf, "sides")[0].select("player_id", "game_id").collect()
    rows = entry.queries()["g30_reconcile_log"](spark, sf).select("player_id", "game_id").collect()
    assert sorted(rows) == sorted(sides)


def test_log_rows_are_shuffled_once_and_pages_are_dealt_out(spark, sf, monkeypatch):
    """Both uses of the log rows read one shuffle; pages made from one small file are parsed in more tasks than it has."""
    kept, durable = [], Q.durable
    monkeypatch.setattr(Q, "durable", lambda df: kept.append(df) or durable(df))
    rows = durable(spark.range(20).selectExpr("id", "id % 2 = 0 AS own", "id % 3 AS player_id", "1 AS discipline", "1 AS car", "2 AS opp_car", "3 AS ent", "'PUIG VILA, ANNA' AS opp", "date'2024-01-01' AS day", "4 AS run"))
    monkeypatch.setattr(Q, "name_tokens", lambda c: F.split(c, " "))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        Q.reconcile_rows(rows)
        assert plan(kept[0]).count("ReusedExchange") == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    boxes = entry.queries()["s03_key_values"](spark, sf)
    assert boxes.select(F.spark_partition_id()).distinct().count() > spark.read.parquet(f"{sf}/customer.parquet").rdd.getNumPartitions()


def test_averages_are_checked_where_they_lie(spark, sf):
    """The sums of linked games meet the entries by player and discipline; neither is shuffled by ranking. A ranking without links gives no row."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert not re.search(r"hashpartitioning\([^)]*seq#", plan(entry.queries()["i22_fix_ranking_averages"](spark, sf)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    entries = spark.createDataFrame([(1, 5, 7, 3.0, 8), (1, 6, 7, 3.0, 8), (1, None, 7, 3.0, 8), (1, 5, 8, 3.0, 8), (2, 5, 7, 3.0, 8)], "discipline int, seq int, player_id long, avg double, ent long")
    links = spark.createDataFrame([(1, 5, 7, 10, 10), (1, 5, 7, 5, 10), (1, None, 7, 9, 90), (1, 7, 7, 9, 90), (1, 5, 8, 30, 10), (1, 6, 9, 9, 90)], "discipline int, seq int, player_id long, car int, ent int")
    assert [tuple(r) for r in P.fix_ranking_averages(entries, links).collect()] == [(1, 5, 7, 3.0, 0.75)]


def test_followed_players_alone_are_met(spark):
    """Players who are not followed do not take part in the join: there they would outgrow a broadcast. An unknown player, one without a position and one followed or not by null are as before."""
    entries = spark.createDataFrame([(1, 5, p, pos) for p, pos in ((1, 1), (2, 2), (3, 3), (4, 4), (5, None), (6, None), (9, 5))], "discipline int, seq int, player_id long, pos int")
    players = spark.createDataFrame([(1, False), (2, True), (3, True), (4, None), (5, False), (9, False)], "player_id long, followed boolean")
    got = M.backfill_selection(entries, players, 1)
    assert sorted((r.player_id, r.k) for r in got.collect()) == [(1, 1), (2, 2), (3, 3), (5, 4), (6, 5)]
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Filter .*followed#\d+", text[text.index("Join"):])


def test_logs_are_shuffled_once_and_lone_pairs_stay(spark, monkeypatch):
    """Rows move once, by player and discipline; of pairs only those of keys with more than two rows move. Lone candidates too far apart, without a day or a score, and of one log only are no pairs; the second round finds them as before."""
    kept, durable = [], Q.durable
    monkeypatch.setattr(Q, "durable", lambda df: kept.append(df) or durable(df))
    one = "id long, player_id long, discipline int, car int, opp_car int, ent int, opp string, day date, run int"
    day, name = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(n), "PUIG VILA, ANNA"
    fed = [(1, 7, 1, 20, 10, 9, name, day(0), 3), (2, 7, 1, 21, 10, 9, name, day(0), 3), (3, 7, 1, 22, 10, 9, name, None, 3), (4, 7, 1, None, 10, 9, name, day(9), 3), (5, 7, 1, 23, 10, 9, name, day(20), 3), (6, 7, 1, 23, 10, 9, name, day(25), 3), (7, 7, 2, 20, 10, 9, name, day(61), 3)]
    own = [(1, 7, 1, 20, 10, 8, name, day(60), 3), (2, 7, 1, 21, 10, 9, name, day(61), 3), (3, 7, 1, 22, 10, 9, name, day(40), 3), (4, 7, 1, None, 10, 9, name, day(9), 3), (5, 7, 1, 23, 10, 9, "ROIG SOLE, PERE", day(25), 3), (6, 7, 1, 23, 10, 9, name, day(26), 4)]
    conf = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(conf)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = Q.reconcile_log(spark.createDataFrame(fed, one), spark.createDataFrame(own, one), near=1)
        assert "Exchange" not in plan(got) and spark.conf.get(conf) == before
        with Q._joined_where_they_lie(spark):
            text = plan(kept[0].select("*"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len([x for x in text.splitlines() if "Exchange hashpartitioning" in x and "Reused" not in x]) == 2 and not re.search(r"hashpartitioning\([^)]*car", text)
    # 4 has no score, so only the second round pairs it; 6 takes the entry of a matching name, 5 what is left
    assert {tuple(r) for r in got.collect()} == {(7, 1, 1, "update", "ent,day"), (7, 2, None, "insert", None), (7, 3, None, "insert", None), (7, 4, 4, "same", ""), (7, 5, 5, "update", "day"), (7, 6, 6, "update", "day,run"), (7, 7, None, "insert", None)}


def test_keys_of_pending_work_are_not_broadcast(spark):
    """Links and empty pages are as many as the entries but compress to next to nothing, so by size in files they would go through the driver. Rows that come twice and null keys are as before."""
    d = tempfile.mkdtemp(prefix="spark-")
    spark.range(300_000).selectExpr("int(id % 3) AS discipline", "int(id div 3 % 100) AS seq", "id div 300 AS player_id").sort("discipline", "player_id", "seq").write.parquet(f"{d}/keys")
    keys = spark.read.parquet(f"{d}/keys")
    got = M.pending_work(keys, keys.where("player_id % 3 <> 0"), keys.where("seq % 2 = 1"))
    assert got.count() == 3 * 50 * 334 and "Broadcast" not in plan(got)
    few = spark.createDataFrame([(1, 5, 7), (1, 5, 7), (1, None, 7), (1, 6, 7), (1, 7, 7)], "discipline int, seq int, player_id long")
    got = M.pending_work(few, few.where("seq = 6 or seq is null"), few.where("seq = 7 or seq is null"))
    assert sorted(map(tuple, got.collect()), key=repr) == [(1, 5, 7), (1, 5, 7), (1, None, 7)]


def test_fresh_rows_lie_by_time_not_by_match(spark):
    """Six thousand matches within a window take no more keys of state than it has slots and shares; a piece in which the watermark stands is parted, and a row without a time is not fresh."""
    d, start = tempfile.mkdtemp(prefix="spark-"), datetime.datetime(2024, 1, 1)
    one = spark.range(6000).selectExpr("1 AS open_id", "id AS match_id", f"timestamp'{start}' + make_interval(0, 0, 0, 0, 0, 0, id * 0.1) AS captured_at", "CAST(NULL AS STRING) AS phase", "id % 5 = 0 AS is_played", "CASE WHEN id % 3 > 0 THEN id END AS car_a")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for i, df in enumerate((one, one.limit(1).selectExpr("open_id", "-1L AS match_id", "captured_at + INTERVAL 965 SECONDS AS captured_at", "phase", "is_played", "7L AS car_a").union(one.limit(1).withColumn("captured_at", F.lit(None).cast("timestamp"))))):
            df.coalesce(1).write.mode("append").parquet(f"{d}/in")
            q = keyed.keep_fresh(spark.readStream.schema(one.schema).parquet(f"{d}/in"), f"{d}/out", f"{d}/check")
            q.awaitTermination()
            if i == 0:
                assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]) <= 2 * (keyed.SLOTS + 1) * keyed.SHARES
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    log = spark.read.parquet(f"{d}/out")
    # the newest row is 965 s after the first, so those of the first 245 s have gone
    got = {r.match_id: r.car_a for r in keyed.fresh_now(log).collect()}
    assert got == {-1: 7} | {n: n if n % 3 else None for n in range(2451, 6000)}
    assert log.where("change = 1").count() == 6001 and log.where("change = -1").count() == 2451


def test_refreshed_rows_are_made_once_and_few_buckets_are_written_by_many_tasks(spark, monkeypatch):
    """What a step makes is read back where it is used, thrice; rows of one season, one bucket, are written by more than one task."""
    d, put, upsert = tempfile.mkdtemp(prefix="spark-"), [], live.upsert
    monkeypatch.setattr(live, "upsert", lambda df, *a, **b: put.append(df) or upsert(df, *a, **b))
    rows = spark.range(400).selectExpr("id AS game_id", "1 AS season", "id % 200 AS day", "1 AS version")
    rows.write.parquet(f"{d}/in")
    day = live.Step(f"{d}/days", ["season", "day"], ["season"], lambda x: x.groupBy("season", "day").agg(F.count("*").alias("n")))
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        live.refresh(spark.readStream.schema(rows.schema).parquet(f"{d}/in"), live.Step(f"{d}/slots", ["game_id"], ["season", "day"]), [day], "version", f"{d}/check")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert len(put) == 2 and "Aggregate" not in plan(put[1])
    days = marts.read_mart(spark, f"{d}/days")
    assert len(marts.layout(spark, f"{d}/days")) == 1 and len(days.inputFiles()) > 1
    assert sorted((r.day, r.n) for r in days.collect()) == [(i, 2) for i in range(200)]
