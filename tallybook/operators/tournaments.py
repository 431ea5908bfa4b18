"""Individual tournaments, the open circuit, inscriptions and draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.seasons import points_for_position
from .games import ranked, top
from .scans import numbered


def tournament_list(opens: DataFrame, results: DataFrame) -> DataFrame:
    n = results.groupBy("open_id").agg(F.count("*").alias("n_players"), F.min_by("player_id", "pos").alias("champion"))
    return opens.join(n, "open_id", "left").select("open_id", "open_name", "season", F.coalesce("n_players", F.lit(0)).alias("n_players"), "champion")


def link_games(rows: DataFrame, games: DataFrame) -> DataFrame:
    """Tournament rows attributed to games of the same two players, discipline, points, and innings where both are known.

    Of several games the one with the same runs; of several rows for a game the
    first of the game's season, else the first. ``rows``: row_id, tournament,
    discipline, season, a, b, car_a, car_b, run_a, run_b, ent, ord.
    """
    lo = lambda x, y: F.least(x, y)
    r = rows.select("row_id", "tournament", F.col("discipline").alias("rd"), F.col("season").alias("rs"), F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), F.least("car_a", "car_b").alias("c1"), F.greatest("car_a", "car_b").alias("c2"), F.least("run_a", "run_b").alias("r1"), F.greatest("run_a", "run_b").alias("r2"), F.col("ent").alias("re"), F.col("ord").alias("ro"))
    g = games.select("game_id", "discipline", "season", F.least("p1", "p2").alias("x"), F.greatest("p1", "p2").alias("y"), F.least("car1", "car2").alias("c1"), F.greatest("car1", "car2").alias("c2"), lo("run1", "run2").alias("g1"), F.greatest("run1", "run2").alias("g2"), "ent")
    hit = r.join(g, ["x", "y", "c1", "c2"]).where("(rd is null or rd = discipline) and (re is null or ent is null or re = 0 or ent = 0 or re = ent)")
    same = F.coalesce(((F.col("r1") == F.col("g1")) & (F.col("r2") == F.col("g2"))).cast("int"), F.lit(0))
    hit = hit.withColumn("same", same).withColumn("best", F.max("same").over(W.partitionBy("row_id"))).where("same = best")
    pick = top(hit.withColumn("fits", (F.col("rs") == F.col("season")).cast("int")), ["game_id"], [F.desc("fits"), "ro", "row_id"])
    return pick.select("game_id", "row_id", "tournament")


def link_coverage(games: DataFrame, linked: DataFrame) -> DataFrame:
    x = games.join(linked.select("game_id", F.lit(1).alias("hit")), "game_id", "left").groupBy("season").agg(F.count("*").alias("total"), F.sum(F.coalesce("hit", F.lit(0))).alias("linked"))
    return x.withColumn("pct", F.round(100 * F.col("linked") / F.col("total"), 1))


def with_points(results: DataFrame, table: str = "open") -> DataFrame:
    """Final positions with the circuit's points."""
    return results.withColumn("points", points_for_position(F.col("pos"), table))


def ranking_history(results: DataFrame, opens: DataFrame, window: int = 5, table: str = "open") -> DataFrame:
    """One ranking per round: points in the last ``window`` opens up to it; ties by best result, average, id."""
    o = opens.select("open_id", "idx")
    r = o.select(F.col("idx").alias("round"))
    p = with_points(results, table).join(F.broadcast(o), "open_id").select("player_id", "idx", "points", "car", "ent")
    x = r.join(p, (F.col("idx") <= F.col("round")) & (F.col("idx") > F.col("round") - window))
    x = x.groupBy("round", "player_id").agg(F.sum("points").alias("total"), F.max("points").alias("best"), F.count("*").alias("played"), F.round(F.sum("car").cast("double") / F.sum("ent"), 6).alias("avg"))
    return numbered(x.where("total > 0"), ["round"], [F.desc("total"), F.desc("best"), F.desc("avg"), "player_id"]).withColumn("k", F.col("k").cast("int"))


def opens_ranking(results: DataFrame, opens: DataFrame, n: int = 5) -> DataFrame:
    """The ranking over the most recent ``n`` opens, with each open's points (0 where absent) as a comma-joined breakdown."""
    w = opens.orderBy(F.desc("open_id")).limit(n).select("open_id")
    p = with_points(results).join(F.broadcast(w), "open_id", "left_semi")
    who = p.select("player_id").distinct()
    spine = who.crossJoin(F.broadcast(w)).join(p.select("player_id", "open_id", "points"), ["player_id", "open_id"], "left")
    x = spine.groupBy("player_id").agg(F.sum(F.coalesce("points", F.lit(0))).alias("total"), F.max(F.coalesce("points", F.lit(0))).alias("best"), F.count("points").alias("played"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("open_id", F.coalesce("points", F.lit(0)).alias("p")))), lambda s: s["p"].cast("string")), ",").alias("breakdown"))
    return ranked(x.where("total > 0"), [F.desc("total"), F.desc("best"), "player_id"])


def apply_penalties(cells: DataFrame, penalties: DataFrame) -> DataFrame:
    """Cells ``player_id, open_id, points`` with negative official points in place of the computed ones; totals anew."""
    x = cells.join(penalties.where("penalty < 0").select("player_id", "open_id", "penalty"), ["player_id", "open_id"], "full").withColumn("p", F.coalesce("penalty", "points"))
    x = x.groupBy("player_id").agg(F.sum("p").alias("total"), F.max("p").alias("best"), F.sum((F.col("p") > 0).cast("int")).alias("played"), F.sum(F.col("penalty").isNotNull().cast("int")).alias("penalties"))
    return ranked(x, [F.desc("total"), F.desc("best"), "player_id"])


def official_override(cells: DataFrame, official: DataFrame) -> DataFrame:
    """Official points per open where the official set of opens is the window's own, else the computed ones, marked provisional."""
    a, b = (F.array_join(F.array_sort(F.collect_set(F.col("open_id").cast("string"))), ",") for _ in "ab")
    gate = cells.agg(a.alias("x")).crossJoin(F.broadcast(official.agg(b.alias("y")))).select((F.col("x") == F.col("y")).alias("same"))
    x = cells.join(official.select("player_id", "open_id", F.col("points").alias("opoints")), ["player_id", "open_id"], "left").crossJoin(F.broadcast(gate))
    return x.select("player_id", "open_id", F.when(F.col("same"), F.coalesce("opoints", "points")).otherwise(F.col("points")).alias("points"), (~F.col("same")).alias("provisional"))


def map_columns(official: DataFrame, window: DataFrame, sheet: list[str] | None = None) -> DataFrame:
    """Official columns ``col, name`` matched one to one to window opens ``open_id, name`` that share a venue, first free first.

    ``sheet`` names the columns that tell several rankings apart; each has a few columns
    and opens. Columns choose in order, opens in order of their id.
    """
    from ..functions.text import venue_keywords

    key = sheet or []
    a = official.withColumn("v", F.explode(venue_keywords(F.col("name")))).select(*key, "v", "col")
    b = window.withColumn("v", F.explode(venue_keywords(F.col("name")))).select(*key, "v", "open_id")
    pairs = a.join(b, [*key, "v"]).groupBy(*key).agg(F.array_sort(F.collect_set(F.struct("col", "open_id"))).alias("p"))
    free = lambda acc, x: ~F.exists(acc, lambda y: (y["col"] == x["col"]) | (y["open_id"] == x["open_id"]))
    got = F.aggregate("p", F.slice(F.col("p"), 1, 0), lambda acc, x: F.when(free(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    return pairs.select(*key, F.explode(got).alias("m")).select(*key, "m.col", "m.open_id")


def open_dates(results: DataFrame, games: DataFrame) -> DataFrame:
    """The last day of the games that match an open's rows by signature. Both have ``sig``."""
    return results.join(games.groupBy("sig").agg(F.max_by("played_on", "ord").alias("d")), "sig").groupBy("open_id").agg(F.max("d").alias("open_date"))


def standings_from_games(matches: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Standings of an open from its games, ranked before unknown players are dropped."""
    side = lambda i: F.struct(F.col(i).alias("player_id"), F.col(f"pts_{i}").alias("pts"), F.col(f"car_{i}").alias("car"), F.col(f"run_{i}").alias("run"))
    x = matches.where("is_played").select("open_id", "ent", F.explode(F.array(side("a"), side("b"))).alias("s")).select("open_id", "ent", "s.*")
    x = x.groupBy("open_id", "player_id").agg(F.sum("pts").alias("pts"), (F.sum("car").cast("double") / F.nullif(F.sum("ent"), F.lit(0))).alias("avg"))
    x = numbered(x, ["open_id"], [F.desc("pts"), F.desc_nulls_last("avg"), "player_id"], "pos").withColumn("pos", F.col("pos").cast("int"))
    return x if known is None else x.join(known.select("player_id"), "player_id", "left_semi")


def circuit(opens: DataFrame) -> DataFrame:
    """Opens of the three-cushion circuit by name."""
    from ..functions.text import plain

    u = F.upper(plain(F.col("open_name")))
    return opens.where(u.contains("OPEN") & u.rlike("TRES BANDES|3 BANDES") & ~u.rlike("FEMENI|QUADRE|LLIURE"))


def player_positions(history: DataFrame, results: DataFrame) -> DataFrame:
    """Each player's place in the latest round, best place ever, best result."""
    last = history.agg(F.max("round").alias("round"))
    now = history.join(F.broadcast(last), "round").select("player_id", F.col("k").alias("now"))
    best = history.groupBy("player_id").agg(F.min("k").alias("best_place"))
    return best.join(now, "player_id", "left").join(results.groupBy("player_id").agg(F.min("pos").alias("best_result")), "player_id", "left")


def inscription_order(ins: DataFrame, key: list[str]) -> DataFrame:
    """Order of inscriptions: points, definitive before provisional before unranked, position, average."""
    tier = F.when(F.col("rank_pos").isNull(), 2).when(F.col("is_definitive"), 0).otherwise(1)
    return ins.withColumn("seed", F.row_number().over(W.partitionBy(*key).orderBy(F.desc(F.coalesce("points", F.lit(0))), tier, F.asc_nulls_last("rank_pos"), F.desc_nulls_last("avg"), "player_id")))


def inscription_anomalies(ins: DataFrame, key: list[str]) -> DataFrame:
    """Points without a ranking and repeated players (errors), seeds against the points (warnings)."""
    w = W.partitionBy(*key).orderBy("seed")
    a = ins.where("points > 0 and rank_pos is null").select(*key, "player_id", F.lit("error").alias("level"), F.lit("points_without_ranking").alias("what"))
    b = ins.groupBy(*key, "player_id").agg(F.count("*").alias("n")).where("n > 1").select(*key, "player_id", F.lit("error").alias("level"), F.lit("repeated").alias("what"))
    c = ins.withColumn("before", F.lag("points").over(w)).where("points > before").select(*key, "player_id", F.lit("warning").alias("level"), F.lit("order").alias("what"))
    return a.unionAll(b).unionAll(c)


def serpentine(idx: Column, n: Column) -> Column:
    """Group (from 0) of the idx-th seed (from 0): the first row forward, all later rows backward."""
    return F.when(idx < n, idx).otherwise(n - 1 - idx % n)


def seed_allocation(tournaments: DataFrame) -> DataFrame:
    """Phase, group and slot of every seed, for tournaments ``open_id, n`` with an even n of 64 to 128; others give one row without a phase."""
    ok = (F.col("n") >= 64) & (F.col("n") <= 128) & (F.col("n") % 2 == 0)
    t = tournaments.withColumn("overflow", F.floor((F.col("n") - 64) / 2)).withColumn("g2", F.least(F.lit(16), F.col("overflow"))).withColumn("g3", F.greatest(F.lit(0), F.col("overflow") - 16))
    x = t.where(ok).withColumn("seed", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    p_end, g2, g3, s = 64 - F.col("g2"), F.col("g2"), F.col("g3"), F.col("seed")
    pp_end = p_end + 3 * g2 - g3
    phase = F.when(s <= 16, "KO").when(s <= p_end, "P").when(s <= pp_end, "PP").otherwise("PPP")
    idx = F.when(s <= 16, s - 1).when(s <= p_end, s - 17).when(s <= pp_end, s - p_end - 1).otherwise(s - pp_end - 1)
    groups = F.when(phase == "P", 16).when(phase == "PP", g2).when(phase == "PPP", g3).otherwise(16)
    x = x.withColumn("phase", phase).withColumn("i", idx.cast("int")).withColumn("ng", groups.cast("int"))
    x = x.select("open_id", "seed", "phase", F.when(F.col("phase") == "KO", 17 - F.col("seed")).otherwise(serpentine(F.col("i"), F.col("ng")) + 1).cast("int").alias("grp"), F.when(F.col("phase") == "KO", 1).otherwise(F.floor(F.col("i") / F.col("ng")) + 1).cast("int").alias("slot"))
    bad = t.where(~ok).select("open_id", F.lit(None).cast("int").alias("seed"), F.lit("unsupported").alias("phase"), F.lit(None).cast("int").alias("grp"), F.lit(None).cast("int").alias("slot"))
    return x.unionAll(bad)


def projection(ins: DataFrame, key: list[str]) -> DataFrame:
    """Inscriptions in order with the phase, group and slot that fall to them."""
    o = inscription_order(ins, key)
    n = o.groupBy("open_id").agg(F.count("*").alias("n")).withColumn("n", F.col("n") - F.col("n") % 2)
    return o.join(seed_allocation(n), ["open_id", "seed"], "left").select("open_id", "player_id", "seed", "phase", "grp", "slot")


def projection_vs_draw(projected: DataFrame, draw: DataFrame) -> DataFrame:
    """Projected against drawn group."""
    d = draw.select("open_id", "player_id", F.col("phase").alias("real_phase"), F.col("grp").alias("real_grp"))
    x = projected.join(d, ["open_id", "player_id"], "full")
    return x.select("open_id", "player_id", "phase", "real_phase", "grp", "real_grp", F.when(F.col("real_phase").isNull(), "not_drawn").when(F.col("phase").isNull(), "not_projected").when((F.col("phase") == F.col("real_phase")) & (F.col("grp") == F.col("real_grp")), "same").otherwise("moved").alias("state"))


def resolve_names(mentions: DataFrame, players: DataFrame, name: str = "name") -> DataFrame:
    """A player per name: exact, with the comma spaced, then without accents; ambiguous names stay open."""
    from ..functions.text import comma_space, norm_name
    from .merge import unique_names

    x = mentions
    for i, key in enumerate((lambda c: c, comma_space, norm_name)):
        x = x.withColumn("key", key(F.col(name))).join(unique_names(players, key(F.col("name"))).withColumnRenamed("player_id", f"_i{i}"), "key", "left").drop("key")
    return x.withColumn("player_id", F.coalesce("_i0", "_i1", "_i2")).drop("_i0", "_i1", "_i2")


def calculated_round(history: DataFrame, live: DataFrame, results: DataFrame, opens: DataFrame, window: int = 5) -> DataFrame:
    """The next round while an open is in progress: the last ``window - 1`` opens and the live open's points."""
    o = opens.orderBy(F.desc("idx")).limit(window - 1).select("open_id")
    old = with_points(results).join(F.broadcast(o), "open_id", "left_semi").groupBy("player_id").agg(F.sum("points").alias("old"), F.max("points").alias("old_best"))
    new = live.groupBy("player_id").agg(F.min("pos").alias("pos")).select("player_id", points_for_position(F.col("pos")).alias("new"))
    z = lambda c: F.coalesce(c, F.lit(0))
    x = old.join(new, "player_id", "full").select("player_id", (z("old") + z("new")).alias("total"), F.greatest(z("old_best"), z("new")).alias("best"), z("new").alias("live_points"))
    return ranked(x.where("total > 0"), [F.desc("total"), F.desc("best"), "player_id"])


def best_run_prize(matches: DataFrame, results: DataFrame, excluded: int = 8) -> DataFrame:
    """Best run of each open among players not placed in the first ``excluded``; all ties."""
    x = matches.where("is_played").select("open_id", F.explode(F.array(F.struct(F.col("a").alias("player_id"), F.col("run_a").alias("run")), F.struct(F.col("b").alias("player_id"), F.col("run_b").alias("run")))).alias("s")).select("open_id", "s.*")
    x = x.join(results.where(F.col("pos") <= excluded).select("open_id", "player_id"), ["open_id", "player_id"], "left_anti")
    x = x.groupBy("open_id", "player_id").agg(F.max("run").alias("run"))
    return x.withColumn("most", F.max("run").over(W.partitionBy("open_id"))).where("run = most").select("open_id", "player_id", "run")


def open_window(opens: DataFrame, n: int = 5) -> DataFrame:
    """For each open the ``n`` most recent ones up to it."""
    o = opens.select("open_id", "idx")
    r = o.select(F.col("open_id").alias("as_of"), F.col("idx").alias("i"))
    return r.join(F.broadcast(o), (F.col("idx") <= F.col("i")) & (F.col("idx") > F.col("i") - n)).select("as_of", "open_id")


def inscription_enrich(ins: DataFrame, entries: DataFrame, points: DataFrame) -> DataFrame:
    """Inscriptions by name with ranking and circuit points; values given stay, the unmatched are marked.

    ``ins``: open_id, name, points; ``entries``: name, rank_pos, avg; ``points``: name, points.
    """
    from ..functions.text import norm_name_upper

    key = lambda df: df.withColumn("key", norm_name_upper(F.col("name"))).drop("name")
    one = lambda df, *c: key(df).groupBy("key").agg(F.count("*").alias("n"), *(F.max(x).alias(x) for x in c)).where("n = 1").drop("n")
    x = ins.withColumn("key", norm_name_upper(F.col("name"))).join(one(entries, "rank_pos", "avg"), "key", "left").join(one(points.withColumnRenamed("points", "known"), "known"), "key", "left")
    return x.select("open_id", "name", F.coalesce("points", "known").alias("points"), "rank_pos", "avg", (F.col("rank_pos").isNull() & F.col("known").isNull()).alias("unmatched"))


def publish_opens(opens: DataFrame, results: DataFrame) -> DataFrame:
    """Open results under clean names with the kind; of several results of a player the best."""
    from ..functions.text import clean_tournament, tournament_kind

    r = top(results, ["open_id", "player_id"], ["pos"]).drop("rn")
    return r.join(F.broadcast(opens.select("open_id", clean_tournament(F.col("open_name")).alias("open_name"), tournament_kind(F.col("open_name")).alias("kind"))), "open_id").select("open_id", "open_name", "kind", "player_id", "pos")


def complete_reserved(live: DataFrame, projected: DataFrame) -> DataFrame:
    """Reserved players of an open: the live ones, and projected ones whose surname key is not among them. Both: open_id, name, club."""
    from ..functions.text import surname_key

    k = lambda df: df.withColumn("key", surname_key(F.col("name"), F.col("club")))
    a, b = k(live), k(projected)
    return a.withColumn("source", F.lit("live")).unionByName(b.join(a.select("open_id", "key"), ["open_id", "key"], "left_anti").withColumn("source", F.lit("projected"))).select("open_id", "name", "club", "source")


def attach_schedule(groups: DataFrame, schedule: DataFrame) -> DataFrame:
    """Start time per group by label, and by order where labels differ. ``groups``: open_id, label, ord; ``schedule``: open_id, label, starts, ord."""
    by = groups.join(schedule.select("open_id", "label", "starts"), ["open_id", "label"], "left")
    w = W.partitionBy("open_id").orderBy("ord", "label")
    rest = schedule.join(groups.select("open_id", "label"), ["open_id", "label"], "left_anti").withColumn("i", F.row_number().over(w)).select("open_id", "i", F.col("starts").alias("s2"))
    free = by.where("starts is null").withColumn("i", F.row_number().over(w)).join(rest, ["open_id", "i"], "left").select("open_id", "label", F.col("s2").alias("starts"))
    return by.where("starts is not null").select("open_id", "label", "starts").unionByName(free)
