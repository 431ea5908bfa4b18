"""Rankings over time: ``entries(discipline, seq, player_id, pos, avg, n_games, is_definitive)`` and the games each links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .games import top
from .scans import numbered


def latest(entries: DataFrame) -> DataFrame:
    """Each discipline's last ranking."""
    last = entries.groupBy("discipline").agg(F.max("seq").alias("seq"))
    return entries.join(F.broadcast(last), ["discipline", "seq"], "left_semi")


def latest_top(entries: DataFrame, n: int = 10) -> DataFrame:
    return latest(entries).where(F.col("pos") <= n)


def snapshots(entries: DataFrame) -> DataFrame:
    return entries.groupBy("discipline", "seq").agg(F.count("*").alias("n_players"), F.sum(F.col("is_definitive").cast("int")).alias("n_definitive"), F.max("avg").alias("best"))


def player_marks(entries: DataFrame, season_first: DataFrame) -> DataFrame:
    """Latest, best position and best average with their counterparts, and the position at the season's start."""
    key = ["discipline", "player_id"]
    x = entries.select(*key, "seq", "pos", "avg").repartition(*key).groupBy(*key).agg(F.max(F.struct("seq", "pos", "avg")).alias("l"), F.min(F.struct("pos", F.col("seq").alias("s"), "avg")).alias("p"), F.max(F.struct("avg", (-F.col("pos")).alias("np"))).alias("a"))
    start = entries.join(F.broadcast(season_first), ["discipline", "seq"], "left_semi").select(*key, F.col("pos").alias("start_pos"))
    return x.join(start, key, "left").select(*key, F.col("l.seq").alias("seq"), F.col("l.pos").alias("pos"), F.col("l.avg").alias("avg"), F.col("p.pos").alias("best_pos"), F.col("p.avg").alias("best_pos_avg"), F.col("a.avg").alias("best_avg"), (-F.col("a.np")).alias("best_avg_pos"), "start_pos")


def season_bounds(rankings: DataFrame) -> DataFrame:
    """First and last ranking of each season (August to July)."""
    sy = F.when(F.col("m") >= 8, F.col("y")).otherwise(F.col("y") - 1)
    return rankings.groupBy("discipline", sy.alias("sy")).agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def evolution(entries: DataFrame, members: DataFrame) -> DataFrame:
    """Averages of the members aligned to all rankings of the discipline: one array per player, a null where absent."""
    spine = entries.select("discipline", "seq").distinct()
    who = entries.join(members, "player_id", "left_semi").select("discipline", "player_id").distinct()
    x = who.join(spine, "discipline").join(entries.select("discipline", "seq", "player_id", "avg"), ["discipline", "seq", "player_id"], "left")
    return x.groupBy("discipline", "player_id").agg(F.array_sort(F.collect_list(F.struct("seq", "avg"))).alias("cells")).select("discipline", "player_id", F.transform("cells", lambda c: c["avg"]).alias("avgs"))


def internal_order(entries: DataFrame, links: DataFrame, sides: DataFrame) -> DataFrame:
    """Order inside each club per ranking, only while the player still plays for it: up to the last ranking whose linked games carry the club."""
    on = links.groupBy("discipline", "player_id", "game_id").agg(F.max("seq").alias("seq")).join(sides.select("game_id", "player_id", "club_id"), ["game_id", "player_id"])
    last = on.groupBy("discipline", "player_id", "club_id").agg(F.max("seq").alias("last_seq"))
    x = entries.join(last, ["discipline", "player_id"]).where(F.col("seq") <= F.col("last_seq"))
    return x.select("discipline", "seq", "club_id", "player_id", F.row_number().over(W.partitionBy("discipline", "seq", "club_id").orderBy(F.desc("avg"), "player_id")).alias("k"), F.count("*").over(W.partitionBy("discipline", "seq", "club_id")).alias("of"))


def provisional(entries: DataFrame, links: DataFrame, sides: DataFrame, rankings: DataFrame, pending: DataFrame, n: int = 15, least: int = 10) -> DataFrame:
    """The next ranking as it would be now.

    A player with pending games (``pending(discipline, player_id, game_id, car, ent,
    result, ord)``) gets up to ``n`` of them by order, then the most recent games of
    the 24 months before the next ranking month; without any the official average
    stays. A discipline without pendings gives no rows.
    """
    from ..functions.seasons import next_ranking_month

    last = latest(entries)
    month = rankings.join(rankings.groupBy("discipline").agg(F.max("seq").alias("seq")), ["discipline", "seq"]).select("discipline", next_ranking_month(F.make_date("y", "m", F.lit(1))).alias("month")).withColumn("cutoff", F.add_months("month", -24))
    key = ["discipline", "player_id"]
    p = top(pending, key, ["ord", "game_id"], n)
    count = p.groupBy(*key).agg(F.count("*").alias("n_pending"))
    recent = sides.join(pending.select("game_id", "player_id"), ["game_id", "player_id"], "left_anti").join(count, key).join(F.broadcast(month), "discipline").where(F.col("played_on") >= F.col("cutoff"))
    order = links.join(last.select("discipline", "seq", "player_id"), ["discipline", "seq", "player_id"]).select(*key, "game_id", F.col("rn").alias("page"))
    recent = recent.join(order, [*key, "game_id"], "left")
    recent = recent.withColumn("k", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("played_on"), F.desc(F.coalesce("page", F.lit(-1))), "game_id"))).where(F.col("k") <= n - F.col("n_pending"))
    both = recent.select(*key, "car", "ent", "result", F.lit(1).alias("old")).unionByName(p.select(*key, "car", "ent", "result", F.lit(0).alias("old")))
    new = both.groupBy(*key).agg(F.sum("old").alias("n_recent"), (F.sum("car").cast("double") / F.nullif(F.sum("ent"), F.lit(0))).alias("new_avg"), *(F.sum((F.col("result") == r).cast("int")).alias(x) for r, x in ((1, "won"), (0, "drawn"), (-1, "lost"))))
    active = pending.select("discipline").distinct()
    x = last.join(F.broadcast(active), "discipline", "left_semi").join(count, key, "left").join(new, key, "left")
    definitive = F.coalesce("is_definitive", F.lit(True)) | (F.coalesce(F.col("n_pending") + F.col("n_recent"), F.lit(0)) >= n)
    x = x.withColumn("definitive", definitive).withColumn("eff", F.coalesce("new_avg", "avg"))
    x = numbered(x, ["discipline"], [F.desc("definitive"), F.desc("eff"), F.coalesce("pos", F.lit(1_000_000)), "player_id"], "rank")
    rank = F.col("rank").cast("int")
    return x.select(*key, "pos", rank.alias("new_pos"), (F.col("pos") - rank).alias("movement"), F.coalesce("n_pending", F.lit(0)).alias("n_pending"), "n_recent", F.round("new_avg", 4).alias("new_avg"), "won", "drawn", "lost", "definitive")


def pending_games(sources: list[DataFrame], known: DataFrame) -> DataFrame:
    """Games not yet in the table: sources in order of priority, both sides, one row per player and signature, those already known dropped.

    Each source: sig, discipline, game_id, p1, p2, car1, car2, ent, ord.
    """
    x = None
    for i, s in enumerate(sources):
        s = s.withColumn("source", F.lit(i))
        x = s if x is None else x.unionByName(s)
    x = x.where("ent > 0 and p1 is not null and p2 is not null").join(known.select("sig"), "sig", "left_anti")
    side = lambda a, b: F.struct(F.col(f"p{a}").alias("player_id"), F.col(f"p{b}").alias("opp_id"), F.col(f"car{a}").alias("car"), F.col(f"car{b}").alias("opp_car"))
    x = x.select("sig", "discipline", "game_id", "ent", "ord", "source", F.explode(F.array(side(1, 2), side(2, 1))).alias("s")).select("sig", "discipline", "game_id", "ent", "ord", "source", "s.*")
    x = top(x, ["player_id", "sig"], ["source", "ord", "game_id"])
    return x.withColumn("result", F.when(F.col("car") > F.col("opp_car"), 1).when(F.col("car") < F.col("opp_car"), -1).otherwise(0)).drop("rn")


def club_rank(entries: DataFrame, players: DataFrame) -> DataFrame:
    """Position of each player among the ranked members of the club, in the last ranking."""
    x = latest(entries).join(players.select("player_id", "club_id"), "player_id")
    w = W.partitionBy("discipline", "club_id")
    return x.select("discipline", "club_id", "player_id", F.row_number().over(w.orderBy(F.desc("avg"), "player_id")).alias("k"), F.count("*").over(w).alias("of"))


def current_window(sides: DataFrame, month, n: int = 15) -> DataFrame:
    """Average of up to ``n`` games in the 24 months before a month, newest first, of one day the better first."""
    m = F.lit(month).cast("date")
    x = sides.where((F.col("played_on") >= F.add_months(m, -24)) & (F.col("played_on") < m)).withColumn("a", F.col("car").cast("double") / F.col("ent"))
    x = top(x, ["discipline", "player_id"], [F.desc("played_on"), F.desc("a"), "game_id"], n)
    return x.groupBy("discipline", "player_id").agg(F.count("*").alias("n"), (F.sum("car").cast("double") / F.sum("ent")).alias("avg"))


def prize_bands(entries: DataFrame, results: DataFrame) -> DataFrame:
    """Finishers of a tournament outside the first 60 of the ranking: band 61-180 and the rest, best of each first."""
    x = results.join(entries.select("player_id", "pos", F.col("avg").alias("rank_avg")).withColumnRenamed("pos", "rank_pos"), "player_id", "left").where("rank_pos is null or rank_pos > 60")
    x = x.withColumn("band", F.when(F.col("rank_pos") <= 180, "61-180").otherwise("181+"))
    return x.select("open_id", "band", "player_id", "pos", F.row_number().over(W.partitionBy("open_id", "band").orderBy(F.desc_nulls_last("rank_avg"), F.desc("pts"), "player_id")).alias("k"), (F.row_number().over(W.partitionBy("open_id", "band").orderBy("pos")) == 1).alias("best_of_band"))


def club_page(entries: DataFrame, players: DataFrame) -> DataFrame:
    """Members of each club with their latest place and average, ranked ones first."""
    x = players.join(latest(entries).groupBy("player_id").agg(F.min(F.struct("pos", "discipline", "avg")).alias("b")), "player_id", "left")
    return x.select("club_id", "player_id", F.col("b.pos").alias("pos"), F.col("b.avg").alias("avg"), F.row_number().over(W.partitionBy("club_id").orderBy(F.asc_nulls_last("b.pos"), "player_id")).alias("k"))


def changed_windows(provisional_windows: DataFrame, official_windows: DataFrame) -> DataFrame:
    """Players whose set of counting games differs. Both: discipline, player_id, game_id."""
    k = ["discipline", "player_id", "game_id"]
    a, b = provisional_windows.select(*k), official_windows.select(*k)
    return a.join(b, k, "left_anti").unionAll(b.join(a, k, "left_anti")).groupBy("discipline", "player_id").agg(F.count("*").alias("n_changed"))
