"""Clubs and groups of players."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..sources.shared import durable
from .games import top


def club_kpis(clubs: DataFrame, players: DataFrame, sides: DataFrame) -> DataFrame:
    """Players, teams and distinct games of each club."""
    p = players.groupBy("club_id").agg(F.count("*").alias("n_players"))
    g = sides.groupBy("club_id").agg(F.countDistinct("team_id").alias("n_teams"), F.countDistinct("game_id").alias("n_games"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return clubs.join(p, "club_id", "left").join(g, "club_id", "left").select("club_id", "club_name", zero("n_players"), zero("n_teams"), zero("n_games"))


def club_players(sides: DataFrame) -> DataFrame:
    """Who played for which club in which season, and how often."""
    return sides.groupBy("club_id", "season", "player_id").agg(F.count("*").alias("n"))


def club_groups(ties: DataFrame) -> DataFrame:
    """League groups where a club has a team."""
    t = ties.select("season", "division_id", "group_id", F.explode(F.array("home", "away")).alias("team_id"))
    return t.select("season", "division_id", "group_id", F.floor(F.col("team_id") / 4).alias("club_id")).distinct()


def club_members(players: DataFrame, sides: DataFrame, season: str) -> DataFrame:
    """Members: assigned, or played this season for the club, or last played for it."""
    now = sides.where(F.col("season") == season).select("club_id", "player_id")
    last = sides.groupBy("player_id").agg(F.max(F.struct("played_on", "game_id", "club_id")).alias("m")).select(F.col("m.club_id").alias("club_id"), "player_id")
    return players.select("club_id", "player_id").union(now).union(last).distinct()


def group_summary(games: DataFrame, members: DataFrame) -> DataFrame:
    """Games that touch a set of players: a game within the set counts once, and as won."""
    m = members.select("player_id").distinct()
    x = games.join(m.select(F.col("player_id").alias("p1"), F.lit(True).alias("in1")), "p1", "left").join(m.select(F.col("player_id").alias("p2"), F.lit(True).alias("in2")), "p2", "left").where("in1 or in2")
    inside = F.when(F.col("winner_id") == F.col("p1"), F.coalesce("in1", F.lit(False))).when(F.col("winner_id") == F.col("p2"), F.coalesce("in2", F.lit(False)))
    x = x.withColumn("inside", inside)
    return x.groupBy("discipline").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col("inside").cast("int"), F.lit(0))).alias("won"), F.sum(F.coalesce((~F.col("inside")).cast("int"), F.lit(0))).alias("lost"), F.sum(F.col("winner_id").isNull().cast("int")).alias("drawn"))


def group_players(games: DataFrame, players: DataFrame, clubs: DataFrame, members: DataFrame) -> DataFrame:
    """The players of a set with their club and the number of games they are in, those without any too."""
    m = members.select("player_id").distinct()
    n = games.select(F.explode(F.array_distinct(F.array("p1", "p2"))).alias("player_id")).join(m, "player_id", "left_semi").groupBy("player_id").agg(F.count("*").alias("n_games"))
    x = players.join(m, "player_id", "left_semi").join(clubs.select("club_id", "club_name"), "club_id", "left").join(n, "player_id", "left")
    return x.select("player_id", "name", "club_name", F.coalesce("n_games", F.lit(0)).alias("n_games"))


def group_games(games: DataFrame, members: DataFrame) -> DataFrame:
    """The set's games from its side; the first player's where both belong."""
    m = members.select("player_id").distinct()
    x = games.join(m.select(F.col("player_id").alias("p1"), F.lit(True).alias("in1")), "p1", "left").join(m.select(F.col("player_id").alias("p2"), F.lit(True).alias("in2")), "p2", "left").where("in1 or in2")
    own = F.coalesce("in1", F.lit(False))
    pick = lambda a, b: F.when(own, F.col(a)).otherwise(F.col(b))
    x = x.select("game_id", "discipline", "ent", pick("p1", "p2").alias("player_id"), pick("car1", "car2").alias("car"), pick("car2", "car1").alias("opp_car"))
    return x.withColumn("result", F.when(F.col("car") > F.col("opp_car"), 1).when(F.col("car") < F.col("opp_car"), -1).otherwise(0))


def player_levels(entries: DataFrame) -> DataFrame:
    """Level of each player by relative position, 100 for the first and 0 for the last; the best over disciplines."""
    x = entries.withColumn("n", F.count("*").over(W.partitionBy("discipline")))
    level = F.when(F.col("n") <= 1, F.lit(100.0)).otherwise(100 * (1 - (F.col("pos") - 1) / (F.col("n") - 1)))
    return x.withColumn("level", F.least(F.lit(100.0), F.greatest(F.lit(0.0), level))).groupBy("player_id").agg(F.max("level").alias("level"), F.min_by("discipline", F.struct((-F.col("level")).alias("l"), "discipline")).alias("discipline"))


def club_index(levels: DataFrame, k: int = 5, w: float = 0.6) -> DataFrame:
    """Per club: power (mean of the top ``k`` levels), depth (mass above 50, scaled to the deepest club) and their weighted index."""
    x = levels.withColumn("rn", F.row_number().over(W.partitionBy("club_id").orderBy(F.desc("level"), "player_id")))
    above = F.greatest(F.col("level") - 50, F.lit(0.0)) / 50
    x = x.groupBy("club_id").agg(F.round(F.avg(F.when(F.col("rn") <= k, F.col("level"))), 6).alias("power"), F.round(F.sum(above), 6).alias("mass"), F.sum((F.col("level") > 50).cast("int")).alias("deep"))
    most = x.agg(F.max("mass").alias("most"))
    x = x.crossJoin(F.broadcast(most)).withColumn("depth", F.when(F.col("most") > 0, 100 * F.col("mass") / F.col("most")).otherwise(0.0))
    return x.select("club_id", "power", "mass", "deep", F.round("depth", 4).alias("depth"), F.round(w * F.col("power") + (1 - w) * F.col("depth"), 4).alias("idx"))


def resolve_sources(players: DataFrame, manual: DataFrame, opens: DataFrame, league: DataFrame, current_from: int) -> DataFrame:
    """A club per player: manual, else of an open of this season, else of the league, else of an older open.

    ``manual(player_id, club)``, ``opens(player_id, open_id, club)``, ``league(player_id, played_on, club)``.
    """
    from ..functions.text import extract_club

    m = manual.groupBy("player_id").agg(F.max(extract_club(F.col("club"))).alias("c_manual"))
    o = opens.withColumn("club", extract_club(F.col("club"))).where("club is not null")
    pick = lambda cond: F.max(F.when(cond, F.struct("open_id", "club")))["club"]
    o = o.groupBy("player_id").agg(pick(F.col("open_id") >= current_from).alias("c_open"), pick(F.col("open_id") < current_from).alias("c_old"))
    lg = league.withColumn("club", extract_club(F.col("club"))).where("club is not null").groupBy("player_id").agg(F.max(F.struct("played_on", "club"))["club"].alias("c_league"))
    x = players.select("player_id").join(m, "player_id", "left").join(o, "player_id", "left").join(lg, "player_id", "left")
    src = F.when(F.col("c_manual").isNotNull(), "manual").when(F.col("c_open").isNotNull(), "open").when(F.col("c_league").isNotNull(), "league").when(F.col("c_old").isNotNull(), "old_open").otherwise("none")
    return x.select("player_id", F.coalesce("c_manual", "c_open", "c_league", "c_old").alias("club"), src.alias("source"))


def catalogue(mentions: DataFrame) -> DataFrame:
    """Clubs by canonical key from ``mentions(club, source)``: the usual spelling (most frequent, with spaces, first in order), sources and total."""
    from ..functions.text import canonical_club_key, extract_club

    x = mentions.withColumn("key", canonical_club_key(F.col("club"))).withColumn("display", extract_club(F.col("club"))).where("key is not null")
    n = x.groupBy("key", "display").agg(F.count("*").alias("n"))
    best = top(n, ["key"], [F.desc("n"), F.desc(F.col("display").contains(" ").cast("int")), "display"]).select("key", "display")
    return x.groupBy("key").agg(F.count("*").alias("total"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources")).join(best, "key")


def club_history(entries: DataFrame, league: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """A club per player and season: the most frequent of the tournament entries, else of the league rows.

    ``entries`` and ``league``: player_id, season, club; ``manual``: a, b, spellings and
    what to write instead, followed to the end. Of a club's spellings (one core) those
    with initials go before those without, then the most frequent; of spellings that
    differ in accents or zone only, a target of ``manual``, then one with initials,
    then the one with most accents. Rows without a club are dropped.
    """
    from ..functions.text import accents, clean_club, club_core, club_zone_core

    prefixed = lambda c: F.col(c).rlike(r"^[A-Z]\.")
    count = lambda df, src: df.where(F.trim("club") != "").groupBy("player_id", "season", "club").agg(F.count("*").alias("n")).withColumn("src", F.lit(src))
    rows = top(count(entries, 0).unionByName(count(league, 1)), ["player_id", "season"], ["src", F.desc("n"), "club"]).select("player_id", "season", clean_club(F.col("club")).alias("form"), club_core(F.col("club")).alias("core"), "src")
    forms = rows.where("form <> ''").groupBy("core", "form").agg(F.count("*").alias("n"))
    usual = top(forms, ["core"], [F.desc(prefixed("form")), F.desc("n"), "form"]).select("core", F.col("form").alias("name"))
    if manual is None:
        usual = usual.withColumn("to", F.col("name")).withColumn("target", F.lit(False))
    else:
        ends = close_mapping(manual)
        usual = usual.join(ends.select(F.col("a").alias("name"), "b"), "name", "left").withColumn("to", F.coalesce("b", "name")).drop("b")
        usual = usual.join(manual.select(F.col("b").alias("to"), F.lit(True).alias("target")).distinct(), "to", "left").withColumn("target", F.coalesce("target", F.lit(False)))
    usual = usual.withColumn("zone", club_zone_core(F.col("to")))
    best = top(usual, ["zone"], [F.desc("target"), F.desc(prefixed("to")), F.desc(accents(F.col("to"))), F.desc("to")]).select("zone", F.col("to").alias("club"))
    named = usual.join(best, "zone").select("core", "club")
    out = rows.join(named, "core", "left").select("player_id", "season", F.coalesce("club", "form").alias("club"), F.when(F.col("src") == 0, "entries").otherwise("league").alias("source"))
    return out.where(~F.upper(F.trim("club")).isin("", "CAP", "INDEPENDENT", "INDEPENDIENT"))


def close_mapping(mapping: DataFrame, rounds: int = 40) -> DataFrame:
    """``mapping(a, b)`` followed to its end: every round doubles the links followed, until none moves.

    Of several targets the least counts. Two that name each other stay as they are; a
    longer circle has no end and is an error.
    """
    m = durable(mapping.groupBy("a").agg(F.min("b").alias("b")).where("a <> b"))
    for _ in range(rounds):
        on = m.join(m.select(F.col("a").alias("b"), F.col("b").alias("c")), "b", "left")
        moved = F.col("c").isNotNull() & (F.col("c") != F.col("a"))
        step = durable(on.select("a", F.when(moved, F.col("c")).otherwise(F.col("b")).alias("b"), moved.alias("moved")))
        if step.where("moved").isEmpty():
            return m
        m = step.select("a", "b")
    raise ValueError("the mapping goes in a circle")


def paged(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """A page of a small sorted table."""
    return df.orderBy(*order).offset(offset).limit(limit)


def set_sizes(members: DataFrame, sides: DataFrame) -> DataFrame:
    """Members of each set of players with their games, and the set's size. ``members``: set_id, player_id."""
    n = sides.groupBy("player_id").agg(F.count("*").alias("n_games"))
    return members.join(n, "player_id", "left").select("set_id", "player_id", F.coalesce("n_games", F.lit(0)).alias("n_games"), F.count("*").over(W.partitionBy("set_id")).alias("size"))


def alias_list(aliases: DataFrame) -> DataFrame:
    """All aliases of a club in order, as one text."""
    return aliases.groupBy("club_id").agg(F.array_join(F.array_sort(F.collect_list("alias")), ", ").alias("aliases"))
