"""League and cup tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .games import top


def _both(df: DataFrame, keep: list[str], pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """One row per side: ``pairs`` maps a name to its columns on the two sides."""
    side = lambda i: F.struct(*(F.col(v[i]).alias(k) for k, v in pairs.items()))
    return df.select(*keep, F.explode(F.array(side(0), side(1))).alias("s")).select(*keep, "s.*")


def league_groups(ties: DataFrame) -> DataFrame:
    return ties.groupBy("season", "division_id", "group_id").agg(F.count("*").alias("n_ties"), F.min("tie_date").alias("since"), F.max("tie_date").alias("until"))


def standings(ties: DataFrame) -> DataFrame:
    """Per group and team: played, won, drawn, lost, match points for and against, 3-1-0 points, order."""
    t = _both(ties.where("mp_home is not null and mp_away is not null"), ["season", "division_id", "group_id"], {"team_id": ("home", "away"), "mp": ("mp_home", "mp_away"), "opp_mp": ("mp_away", "mp_home"), "pp": ("pp_home", "pp_away")})
    n = lambda c: F.sum(c.cast("int"))
    won, drawn = F.col("mp") > F.col("opp_mp"), F.col("mp") == F.col("opp_mp")
    x = t.groupBy("season", "division_id", "group_id", "team_id").agg(F.count("*").alias("played"), n(won).alias("won"), n(drawn).alias("drawn"), n(F.col("mp") < F.col("opp_mp")).alias("lost"), F.sum("mp").alias("mp_for"), F.sum("opp_mp").alias("mp_against"), F.sum("pp").alias("pp_for"), (3 * n(won) + n(drawn)).alias("points"))
    return x.withColumn("k", F.row_number().over(W.partitionBy("season", "division_id", "group_id").orderBy(F.desc("points"), F.desc(F.col("mp_for") - F.col("mp_against")), "team_id")))


def merge_official(computed: DataFrame, official: DataFrame) -> DataFrame:
    """Official position and points where a team matches, first by team, then as the only team of its club left; a penalty where fewer points are official."""
    g = ["season", "division_id", "group_id"]
    c = computed.withColumn("club_id", F.floor(F.col("team_id") / 4))
    o = official.select(*g, F.col("team_id"), F.floor(F.col("team_id") / 4).alias("club_id"), F.col("pos").alias("opos"), F.col("points").alias("opoints"))
    exact = c.join(o.drop("club_id"), [*g, "team_id"])
    free_c, free_o = c.join(o, [*g, "team_id"], "left_anti"), o.join(c, [*g, "team_id"], "left_anti")
    one = lambda d: d.withColumn("n", F.count("*").over(W.partitionBy(*g, "club_id"))).where("n = 1").drop("n")
    second = one(free_c).join(one(free_o).drop("team_id"), [*g, "club_id"])
    cols = [*g, "team_id", "points", "pp_for", "opos", "opoints"]
    rest = free_c.join(second, [*g, "team_id"], "left_anti").withColumns({"opos": F.lit(None).cast("int"), "opoints": F.lit(None).cast("long")})
    x = exact.select(cols).unionAll(second.select(cols)).unionAll(rest.select(cols))
    order = F.row_number().over(W.partitionBy(*g).orderBy(F.desc(F.col("opos").isNotNull()), "opos", F.desc("points"), F.desc("pp_for"), "team_id"))
    return x.withColumn("penalty", F.when(F.col("points") > F.col("opoints"), F.col("points") - F.col("opoints")).otherwise(0)).withColumn("k", order).select(*g, "team_id", "points", "opos", "opoints", "penalty", "k")


def matchdays(ties: DataFrame) -> DataFrame:
    """Match-days of a group: months in order of their first date."""
    x = ties.withColumn("md", F.year("tie_date") * 12 + F.month("tie_date")).groupBy("season", "division_id", "group_id", "md").agg(F.min("tie_date").alias("first"), F.count("*").alias("n_ties"), F.sum("n_games").alias("n_games"))
    return x.withColumn("k", F.row_number().over(W.partitionBy("season", "division_id", "group_id").orderBy("first", "md")))


def tie_game_order(slots: DataFrame) -> DataFrame:
    """Running number of the games inside each tie."""
    return slots.select("season", "team1", "team2", "game_id", F.row_number().over(W.partitionBy("season", "team1", "team2").orderBy("discipline", "game_id")).alias("k"))


def player_ranking(sides: DataFrame, keys: list[str]) -> DataFrame:
    """Players by points, then average, within ``keys``."""
    x = sides.groupBy(*keys, "player_id").agg(F.count("*").alias("played"), F.sum((F.col("result") == 1).cast("int")).alias("won"), F.sum("pts").alias("pts"), F.sum("car").alias("car"), F.sum("ent").alias("ent"), F.round(F.sum("car").cast("double") / F.nullif(F.sum("ent"), F.lit(0)), 4).alias("avg"))
    return x.withColumn("k", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("pts"), F.desc_nulls_last("avg"), "player_id")))


def slot_sides(slots: DataFrame) -> DataFrame:
    """Both sides of the played slots, a result letter each."""
    x = _both(slots, ["game_id", "season", "division_id", "group_id", "slot", "ent", "is_played", "played_on"], {"player_id": ("p1", "p2"), "team_id": ("team1", "team2"), "car": ("car1", "car2"), "opp_car": ("car2", "car1"), "run": ("run1", "run2"), "pts": ("pts1", "pts2"), "opp_pts": ("pts2", "pts1")})
    return x.withColumn("letter", F.when(~F.col("is_played"), "—").when(F.col("pts") > F.col("opp_pts"), "V").when(F.col("pts") < F.col("opp_pts"), "D").otherwise("E"))


def slot_ranking(slots: DataFrame, scope: list[str]) -> DataFrame:
    """Players of a scope by points, average, best run; games per slot and the usual team."""
    x = slot_sides(slots).where("is_played")
    team = top(x.groupBy(*scope, "player_id", "team_id").agg(F.count("*").alias("n")), [*scope, "player_id"], [F.desc("n"), "team_id"]).select(*scope, "player_id", "team_id")
    n = lambda c: F.sum(c.cast("int"))
    y = x.groupBy(*scope, "player_id").agg(F.count("*").alias("played"), *(n(F.col("letter") == v).alias(k) for v, k in (("V", "won"), ("E", "drawn"), ("D", "lost"))), F.sum("pts").alias("pts"), F.max("run").alias("best_run"), (F.sum("car").cast("double") / F.nullif(F.sum("ent"), F.lit(0))).alias("avg"), *(n(F.col("slot") == i).alias(f"s{i}") for i in (1, 2, 3, 4)))
    return y.join(team, [*scope, "player_id"]).withColumn("k", F.row_number().over(W.partitionBy(*scope).orderBy(F.desc("pts"), F.desc_nulls_last("avg"), F.desc("best_run"), "player_id")))


def scope_aggregate(slots: DataFrame) -> DataFrame:
    """Games, points and average per group, division and season, by one rollup."""
    x = slot_sides(slots).where("is_played").rollup("season", "division_id", "group_id").agg(F.countDistinct("game_id").alias("n_games"), F.sum("car").alias("car"), F.sum("ent").alias("ent"), F.countDistinct("player_id").alias("n_players"))
    return x.where("season is not null").withColumn("avg", F.col("car").cast("double") / F.col("ent"))


def slot_performance(slots: DataFrame) -> DataFrame:
    """Win rate and average of each player in each slot."""
    return slot_sides(slots).where("is_played").groupBy("player_id", "slot").agg(F.count("*").alias("n"), (F.sum((F.col("letter") == "V").cast("int")) / F.count("*")).alias("rate"), (F.sum("car").cast("double") / F.sum("ent")).alias("avg"))


def last_played_matchday(slots: DataFrame) -> DataFrame:
    """The last month with a played game, per group."""
    return slots.where("is_played").groupBy("season", "division_id", "group_id").agg(F.max(F.year("played_on") * 12 + F.month("played_on")).alias("md"))


def overview(slots: DataFrame) -> DataFrame:
    """Counters per group: teams, months, games, games played."""
    t = slots.select("season", "division_id", "group_id", F.explode(F.array("team1", "team2")).alias("t")).groupBy("season", "division_id", "group_id").agg(F.countDistinct("t").alias("n_teams"))
    x = slots.groupBy("season", "division_id", "group_id").agg(F.countDistinct(F.year("played_on") * 12 + F.month("played_on")).alias("n_months"), F.count("*").alias("n_games"), F.sum(F.col("is_played").cast("int")).alias("n_played"))
    return t.join(x, ["season", "division_id", "group_id"])


def historical(rows: DataFrame) -> DataFrame:
    """Historical standings under their usual division and group names; of equal keys the last row wins."""
    from ..functions.text import norm_division, norm_group

    x = rows.withColumn("division", norm_division(F.col("division"))).withColumn("grp", norm_group(F.col("grp")))
    return top(x, ["division", "grp", "pos"], [F.desc("ord")]).select("division", "grp", "pos", "team", "ord")


def cup_editions(cup: DataFrame) -> DataFrame:
    return cup.groupBy("edition_id").agg(F.min("season").alias("season"), F.countDistinct("matchday").alias("n_matchdays"), F.countDistinct("group_id").alias("n_groups"), F.count("*").alias("n_games"))


def cup_group_standings(cup: DataFrame) -> DataFrame:
    """Teams of each cup group by match points, then partial points."""
    ties = cup.groupBy("edition_id", "group_id", "matchday", "team1", "team2").agg(F.sum("pts1").alias("pp1"), F.sum("pts2").alias("pp2"))
    mp = lambda a, b: F.when(F.col(a) > F.col(b), 2).when(F.col(a) == F.col(b), 1).otherwise(0)
    x = _both(ties.withColumn("mp1", mp("pp1", "pp2")).withColumn("mp2", mp("pp2", "pp1")), ["edition_id", "group_id"], {"team_id": ("team1", "team2"), "mp": ("mp1", "mp2"), "pp": ("pp1", "pp2")})
    x = x.groupBy("edition_id", "group_id", "team_id").agg(F.count("*").alias("played"), F.sum("mp").alias("mp"), F.sum("pp").alias("pp"))
    return x.withColumn("k", F.row_number().over(W.partitionBy("edition_id", "group_id").orderBy(F.desc("mp"), F.desc("pp"), "team_id")))


def cup_player_ranking(cup: DataFrame, known: DataFrame | None = None, current_only: bool = False) -> DataFrame:
    """Cup players by points and average per edition; with ``known`` unknown players go before the rank is counted."""
    if current_only:
        last = cup.agg(F.max("edition_id").alias("edition_id"))
        cup = cup.join(F.broadcast(last), "edition_id")
    x = _both(cup.where("ent > 0"), ["edition_id", "ent"], {"player_id": ("p1", "p2"), "car": ("car1", "car2"), "opp_car": ("car2", "car1"), "pts": ("pts1", "pts2")})
    if known is not None:
        x = x.join(known.select("player_id"), "player_id", "left_semi")
    x = x.withColumn("result", F.when(F.col("car") > F.col("opp_car"), 1).otherwise(0))
    return player_ranking(x, ["edition_id"])


def league_tree(groups: DataFrame, names: DataFrame) -> DataFrame:
    """League, division and group as one nested row per season; names where known. ``names``: division_id, group_id, name."""
    x = groups.join(names, ["division_id", "group_id"], "left").withColumn("name", F.coalesce("name", F.concat(F.lit("Grup "), F.col("group_id").cast("string"))))
    d = x.groupBy("season", "division_id").agg(F.array_sort(F.collect_list(F.struct("group_id", "name", "n_ties"))).alias("groups"))
    return d.groupBy("season").agg(F.array_sort(F.collect_list(F.struct("division_id", "groups"))).alias("divisions"))


def tie_detail(slots: DataFrame, players: DataFrame) -> DataFrame:
    """The games of each tie in order, with names."""
    n = players.select("player_id", "name")
    x = slots.join(n.select(F.col("player_id").alias("p1"), F.col("name").alias("name1")), "p1", "left").join(n.select(F.col("player_id").alias("p2"), F.col("name").alias("name2")), "p2", "left")
    return x.select("season", "team1", "team2", "game_id", "slot", "name1", "car1", "name2", "car2", "ent", F.row_number().over(W.partitionBy("season", "team1", "team2").orderBy("slot", "game_id")).alias("k"))


def group_player_ranking(slots: DataFrame, known: DataFrame) -> DataFrame:
    """Players of each division and group by points and average, with the last team seen; unknown players keep their place in the count, then go."""
    x = slot_sides(slots).where("is_played").groupBy("season", "division_id", "group_id", "player_id").agg(F.sum("pts").alias("pts"), F.round(F.sum("car").cast("double") / F.nullif(F.sum("ent"), F.lit(0)), 4).alias("avg"), F.max(F.struct("played_on", "game_id", "team_id"))["team_id"].alias("team_id"))
    x = x.withColumn("k", F.row_number().over(W.partitionBy("season", "division_id", "group_id").orderBy(F.desc("pts"), F.desc_nulls_last("avg"), "player_id")))
    return x.join(known.select("player_id"), "player_id", "left_semi")


def team_detail(ranking: DataFrame) -> DataFrame:
    """Players of a group ranking anew within their team."""
    return ranking.withColumn("in_team", F.row_number().over(W.partitionBy("season", "division_id", "group_id", "team_id").orderBy("k")))


def find_names(ties: DataFrame, names: DataFrame) -> DataFrame:
    """A readable phase name for each tie: division and group."""
    g = names.where("group_id <> 0").select("division_id", "group_id", F.col("name").alias("gname"))
    d = names.where("group_id = 0").select("division_id", F.col("name").alias("dname"))
    return ties.join(d, "division_id", "left").join(g, ["division_id", "group_id"], "left").withColumn("phase_name", F.concat_ws(" · ", "dname", "gname")).drop("dname", "gname")
