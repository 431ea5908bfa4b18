"""Phases, groups and knock-out rounds of opens.

``matches``: open_id, phase (1 first), kind (group or ko), grp, game_id, a, b,
car_a, car_b, run_a, run_b, pts_a, pts_b, ent, is_played, ord.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.seasons import points_for_position
from ..sources.shared import durable
from .games import top

PH = ["open_id", "phase"]


def match_sides(matches: DataFrame) -> DataFrame:
    side = lambda i, j: F.struct(F.col(i).alias("player_id"), F.col(j).alias("opp_id"), F.col(f"car_{i}").alias("car"), F.col(f"run_{i}").alias("run"), F.col(f"pts_{i}").alias("pts"))
    return matches.select(*PH, "kind", "grp", "game_id", "ent", "is_played", F.explode(F.array(side("a", "b"), side("b", "a"))).alias("s")).select(*PH, "kind", "grp", "game_id", "ent", "is_played", "s.*")


def phase_stats(matches: DataFrame) -> DataFrame:
    """Points scored, innings, best run and average of each player in each phase."""
    x = match_sides(matches).where("is_played")
    return x.groupBy(*PH, "kind", "player_id").agg(F.count("*").alias("n"), F.sum("pts").alias("pts"), F.sum("car").alias("car"), F.sum("ent").alias("ent"), F.max("run").alias("run"), F.coalesce(F.sum("car").cast("double") / F.nullif(F.sum("ent"), F.lit(0)), F.lit(0.0)).alias("avg"))


def ko_winner(matches: DataFrame) -> DataFrame:
    """Winner of each played match: by points, else by points scored, else by the name that the remarks hold more of, else none."""
    w = F.when(F.col("pts_a") > F.col("pts_b"), F.col("a")).when(F.col("pts_b") > F.col("pts_a"), F.col("b")).when(F.col("car_a") > F.col("car_b"), F.col("a")).when(F.col("car_b") > F.col("car_a"), F.col("b"))
    if "remarks" in matches.columns:
        from ..functions.text import plain

        text = F.upper(plain(F.coalesce("remarks", F.lit(""))))
        hits = lambda n: F.size(F.filter(F.split(F.upper(plain(F.col(n))), r"\s+"), lambda t: (F.length(t) > 2) & text.contains(t)))
        w = F.coalesce(w, F.when(hits("name_a") > hits("name_b"), F.col("a")).when(hits("name_b") > hits("name_a"), F.col("b")))
    return matches.withColumn("winner", F.when(F.col("is_played"), w))


def dedupe_ko(matches: DataFrame) -> DataFrame:
    """One match per pair and phase: a played copy before others, then the first."""
    x = matches.withColumn("x", F.least("a", "b")).withColumn("y", F.greatest("a", "b"))
    return top(x, [*PH, "x", "y"], [F.desc("is_played"), "ord"]).drop("rn", "x", "y")


def group_closed(matches: DataFrame) -> DataFrame:
    """Whether a group is decided: all played, or two or more played and all of one pair (a no-show)."""
    x = matches.where("kind = 'group'")
    pair = F.when(F.col("is_played"), F.concat_ws("-", F.least("a", "b"), F.greatest("a", "b")))
    n = F.sum(F.col("is_played").cast("int"))
    return x.groupBy(*PH, "grp").agg((F.bool_and("is_played") | ((n >= 2) & (F.count_distinct(pair) == 1))).alias("closed"), n.alias("n_played"), F.count("*").alias("n"))


def group_standings(matches: DataFrame) -> DataFrame:
    x = match_sides(matches).where("kind = 'group' and is_played").groupBy(*PH, "grp", "player_id").agg(F.sum("pts").alias("pts"), (F.sum("car").cast("double") / F.nullif(F.sum("ent"), F.lit(0))).alias("avg"), F.max("run").alias("run"))
    return x.withColumn("k", F.row_number().over(W.partitionBy(*PH, "grp").orderBy(F.desc("pts"), F.desc_nulls_last("avg"), F.desc("run"), "player_id")))


def qualifiers(matches: DataFrame) -> DataFrame:
    """First of each group with a played game, and whoever is in the next phase already."""
    s = group_standings(matches)
    nxt = match_sides(matches).select("open_id", (F.col("phase") - 1).alias("phase"), "player_id", F.lit(True).alias("in_next")).distinct()
    return s.join(nxt, [*PH, "player_id"], "left").where("k = 1 or in_next").select(*PH, "grp", "player_id", "k")


def rank_winners(matches: DataFrame) -> DataFrame:
    """Winners of closed groups in order; the k-th one fills the k-th placeholder of the next phase."""
    w = group_standings(matches).where("k = 1").join(group_closed(matches).where("closed"), [*PH, "grp"], "left_semi")
    return w.select(*PH, "player_id", F.row_number().over(W.partitionBy(*PH).orderBy(F.desc("pts"), F.desc_nulls_last("avg"), F.desc("run"), "player_id")).alias("place"))


def pyramid_pairing(pool: DataFrame, key: list[str]) -> DataFrame:
    """First against last, second against last but one, ... after seeding by average, run, id; odd pools are not paired."""
    x = pool.withColumn("rn", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("avg"), F.desc("run"), "player_id"))).withColumn("n", F.count("*").over(W.partitionBy(*key))).where("n % 2 = 0")
    low = x.where("rn > n / 2").select(*key, (F.col("n") + 1 - F.col("rn")).alias("rn"), F.col("player_id").alias("b"))
    return x.where("rn <= n / 2").select(*key, "rn", F.col("player_id").alias("a")).join(low, [*key, "rn"])


def advancing(matches: DataFrame) -> DataFrame:
    """Winners of each knock-out round with their figures in it."""
    w = ko_winner(dedupe_ko(matches.where("kind = 'ko'"))).where("winner is not null").select(*PH, F.col("winner").alias("player_id")).distinct()
    return w.join(phase_stats(matches), [*PH, "player_id"]).select(*PH, "player_id", "avg", "run")


def first_ko_pool(reserved: DataFrame, matches: DataFrame) -> DataFrame:
    """Pool of the first knock-out round: reserved players by ranking, then qualifiers by place in the group, points and average."""
    last = matches.where("kind = 'group'").groupBy("open_id").agg(F.max("phase").alias("phase"))
    q = group_standings(matches).join(last, PH, "left_semi").where("k = 1").select("open_id", "player_id", F.lit(1).alias("part"), F.lit(None).cast("long").alias("seed"), F.col("k").alias("place"), "pts", "avg")
    r = reserved.select("open_id", "player_id", F.lit(0).alias("part"), F.col("seed").cast("long").alias("seed"), F.lit(0).alias("place"), F.lit(0).cast("long").alias("pts"), F.lit(0.0).alias("avg"))
    x = top(r.unionByName(q), ["open_id", "player_id"], ["part"]).drop("rn")
    return x.select("open_id", "player_id", "part", F.row_number().over(W.partitionBy("open_id").orderBy("part", F.asc_nulls_last("seed"), "place", F.desc("pts"), F.desc("avg"), "player_id")).alias("k"))


def seed_unplayed(groups: DataFrame, ranking: DataFrame, advanced: DataFrame) -> DataFrame:
    """Players of groups not begun in the order of the ranking, those who came from an earlier phase last; begun groups as they are."""
    x = groups.join(ranking.select("player_id", F.col("k").alias("r")), "player_id", "left").join(advanced.select("open_id", "player_id", F.lit(1).alias("adv")), ["open_id", "player_id"], "left")
    order = F.row_number().over(W.partitionBy("open_id", "grp").orderBy(F.coalesce("adv", F.lit(0)), F.coalesce("r", F.lit(10**9)), "ord", "player_id"))
    return x.select("open_id", "grp", "player_id", F.when(F.col("begun"), F.col("ord")).otherwise(order).alias("place"))


def classification(matches: DataFrame) -> DataFrame:
    """Classification of an open in progress.

    Knock-out losers stand below the places of the next round, by average, run and
    id. Group losers (in no later phase) stand below the knock-out bracket, deeper
    phases first. The champion is first. Who is still in the bracket fills the free
    places above, provisionally, by average.
    """
    m = durable(matches.where("kind = 'group'").unionByName(dedupe_ko(matches.where("kind = 'ko'"))))
    st = durable(phase_stats(m))
    here = match_sides(m).select(*PH, "kind", "player_id").distinct()
    last = here.groupBy("open_id", "player_id").agg(F.max("phase").alias("last"))
    cap = m.where("kind = 'ko'").groupBy(*PH).agg((2 * F.count("*")).alias("cap"))
    size = cap.groupBy("open_id").agg(F.min_by("cap", "phase").alias("ko_size"), F.max("phase").alias("final"))
    w = ko_winner(m.where("kind = 'ko'")).where("winner is not null")
    lost = w.select(*PH, F.when(F.col("winner") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("player_id")).distinct()
    above = cap.select("open_id", (F.col("phase") - 1).alias("phase"), F.col("cap").alias("n_above"))
    at_last = last.withColumnRenamed("last", "phase")
    ko = lost.join(at_last, ["open_id", "player_id", "phase"], "left_semi").join(st, [*PH, "player_id"]).join(above, PH, "left")
    by = lambda *k: F.row_number().over(W.partitionBy(*k).orderBy(F.desc("avg"), F.desc("run"), "player_id"))
    ko = ko.select("open_id", "player_id", "phase", (F.coalesce("n_above", F.lit(1)) + by("open_id", "phase")).alias("pos"), F.lit(False).alias("provisional"))
    closed = group_closed(m).groupBy(*PH).agg(F.bool_and("closed").alias("closed"))
    out = here.where("kind = 'group'").join(at_last, ["open_id", "player_id", "phase"], "left_semi").join(group_standings(m).where("k > 1").select(*PH, "player_id").distinct(), [*PH, "player_id"], "left_semi").join(st.drop("kind"), [*PH, "player_id"])
    band = out.groupBy(*PH).agg(F.count("*").alias("n")).join(size, "open_id", "left").withColumn("start", F.coalesce("ko_size", F.lit(1)) + F.sum("n").over(W.partitionBy("open_id").orderBy(F.desc("phase"))) - F.col("n")).select(*PH, "start")
    out = out.join(band, PH).join(closed, PH).select("open_id", "player_id", "phase", (F.col("start") + by("open_id", "phase")).alias("pos"), (~F.col("closed")).alias("provisional"))
    champion = w.join(size.select("open_id", F.col("final").alias("phase")), PH, "left_semi").groupBy("open_id").agg(F.min("winner").alias("player_id"), F.max("phase").alias("phase"), F.count("*").alias("n")).where("n = 1").select("open_id", "player_id", "phase", F.lit(1).alias("pos"), F.lit(False).alias("provisional"))
    placed = ko.unionByName(out.join(ko.select("open_id", "player_id"), ["open_id", "player_id"], "left_anti"))
    placed = champion.unionByName(placed.join(champion.select("open_id", "player_id"), ["open_id", "player_id"], "left_anti"))
    inside = here.where("kind = 'ko'").select("open_id", "player_id").distinct().join(placed.select("open_id", "player_id"), ["open_id", "player_id"], "left_anti")
    alive = top(inside.join(st, ["open_id", "player_id"]), ["open_id", "player_id"], [F.desc("phase")]).drop("rn")
    alive = alive.withColumn("j", by("open_id"))
    free = size.select("open_id", F.explode(F.sequence(F.lit(1), F.col("ko_size").cast("int"))).alias("pos")).join(placed.select("open_id", "pos"), ["open_id", "pos"], "left_anti").withColumn("j", F.row_number().over(W.partitionBy("open_id").orderBy("pos")))
    alive = alive.join(free, ["open_id", "j"]).select("open_id", "player_id", "phase", "pos", F.lit(True).alias("provisional"))
    return placed.unionByName(alive).withColumn("points", points_for_position(F.col("pos")))


def merge_phases(real: DataFrame, projected: DataFrame) -> DataFrame:
    """Phases of an open by code: real ones take the place of projected ones. Both: open_id, label."""
    from ..functions.text import phase_code

    code = lambda df, n: df.groupBy("open_id", phase_code(F.col("label")).alias("code")).agg(F.min("label").alias(n))
    return code(real, "real").join(code(projected, "projected"), ["open_id", "code"], "full").select("open_id", "code", F.coalesce("real", "projected").alias("label"), F.col("real").isNull().alias("is_projected"))


def superseded(projected: DataFrame, real: DataFrame) -> DataFrame:
    """Projections ``pid, name`` whose name holds all tokens of a real open's ``rid, name`` in the same discipline; women's opens take no part.

    A real name is looked up by the one of its tokens that the fewest projections hold.
    """
    from ..functions.text import discipline_of, open_match_key, plain

    tokens = F.array_distinct(F.filter(F.split(open_match_key(F.col("name")), " "), lambda t: t != ""))
    men = lambda df: df.where(~F.upper(plain(F.col("name"))).contains("FEMENI"))
    p = men(projected).select("pid", tokens.alias("pt"), discipline_of(F.col("name")).alias("d"))
    r = men(real).select("rid", tokens.alias("rt"), discipline_of(F.col("name")).alias("d")).where(F.size("rt") > 0)
    held = p.select("pid", "pt", "d", F.explode("pt").alias("t"))
    often = held.groupBy("d", "t").agg(F.count("*").alias("n"))
    rare = r.select("rid", "rt", "d", F.explode("rt").alias("t")).join(often, ["d", "t"]).groupBy("rid", "rt", "d").agg(F.min_by("t", F.struct("n", "t")).alias("t"))
    return held.join(rare, ["d", "t"]).where(F.size(F.array_except("rt", "pt")) == 0).groupBy("pid").agg(F.min("rid").alias("rid"))


def phase_status(matches: DataFrame) -> DataFrame:
    """done, active or pending, with the progress."""
    x = matches.groupBy(*PH).agg(F.count("*").alias("n"), F.sum(F.col("is_played").cast("int")).alias("played"))
    return x.withColumn("status", F.when(F.col("played") == F.col("n"), "done").when(F.col("played") > 0, "active").otherwise("pending"))
