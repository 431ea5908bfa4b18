"""Player and game analytics over whole tables.

``sides`` is one row per player and game (see :func:`player_games`): player_id,
opp_id, car, opp_car, run, pts, ent, result (1, 0, -1), discipline, competition,
played_on, season, game_id. All orders end in an id, so they are total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .scans import numbered


def ratio(a: str = "car", b: str = "ent") -> Column:
    """Sum over sum; null without innings."""
    return F.sum(a).cast("double") / F.nullif(F.sum(b), F.lit(0))


def ranked(df: DataFrame, order: list, name: str = "k") -> DataFrame:
    """``df`` with its place in the order of all rows."""
    return numbered(df, [], order, name)


def top(df: DataFrame, keys: list[str], order: list, n: int = 1, name: str = "rn") -> DataFrame:
    """The first ``n`` rows per key."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)


def player_games(games: DataFrame) -> DataFrame:
    """Both sides of each game, by one scan."""
    side = lambda a, b: F.struct(F.col(f"p{a}").alias("player_id"), F.col(f"p{b}").alias("opp_id"), F.col(f"car{a}").alias("car"), F.col(f"car{b}").alias("opp_car"), F.col(f"run{a}").alias("run"), F.col(f"pts{a}").alias("pts"), F.col(f"club{a}").alias("club_id"), F.col(f"team{a}").alias("team_id"))
    keep = ["game_id", "discipline", "played_on", "competition", "season", "sy", "ent", "ord"]
    x = games.select(*keep, F.explode(F.array(side(1, 2), side(2, 1))).alias("s")).select(*keep, "s.*")
    return x.withColumn("result", F.when(F.col("car") > F.col("opp_car"), 1).when(F.col("car") < F.col("opp_car"), -1).otherwise(0))


def player_summary(sides: DataFrame) -> DataFrame:
    """Totals per player and discipline, and over all disciplines (discipline 0), in one pass."""
    one = lambda r: F.sum((F.col("result") == r).cast("int"))
    return (
        sides.groupingSets([["player_id", "discipline"], ["player_id"]], "player_id", "discipline")
        .agg(F.count("*").alias("n"), one(1).alias("won"), one(-1).alias("lost"), one(0).alias("drawn"), F.sum("car").alias("car"), F.sum("opp_car").alias("opp_car"), F.sum("ent").alias("ent"), F.max("run").alias("best_run"))
        .withColumn("discipline", F.coalesce("discipline", F.lit(0)))
    )


def best_average_games(sides: DataFrame, eps: float = 1e-9) -> DataFrame:
    """Per player the games of the best average, all ties, and their number."""
    x = sides.where("ent > 0").withColumn("avg", F.col("car").cast("double") / F.col("ent"))
    x = x.withColumn("best", F.max("avg").over(W.partitionBy("player_id"))).where(F.abs(F.col("avg") - F.col("best")) < eps)
    return x.withColumn("n_ties", F.count("*").over(W.partitionBy("player_id"))).select("player_id", "game_id", "avg", "n_ties")


def best_worst_games(sides: DataFrame, n: int = 3, key: str = "player_id") -> DataFrame:
    """Four lists per key: best, worst, best won, worst lost."""
    x = sides.where("ent > 0").withColumn("avg", F.col("car").cast("double") / F.col("ent"))
    w = lambda *o: F.row_number().over(W.partitionBy(key).orderBy(*o))
    won = lambda r: W.partitionBy(key, F.col("result") == r)
    x = x.withColumns({
        "best": w(F.desc("avg"), F.desc("car"), "game_id"), "worst": w("avg", "car", "game_id"),
        "best_won": F.when(F.col("result") == 1, F.row_number().over(won(1).orderBy(F.desc("avg"), "game_id"))),
        "worst_lost": F.when(F.col("result") == -1, F.row_number().over(won(-1).orderBy("avg", "game_id"))),
    })
    return x.select(key, "game_id", "avg", F.expr("stack(4, 'best', best, 'worst', worst, 'best_won', best_won, 'worst_lost', worst_lost) as (list, rn)")).where(F.col("rn") <= n)


def latest_games(sides: DataFrame, links: DataFrame, n: int = 5) -> DataFrame:
    """Each player's latest games; ``counts``: the discipline's last ranking links the game for the player."""
    last = links.groupBy("discipline").agg(F.max("seq").alias("seq"))
    last = links.join(F.broadcast(last), ["discipline", "seq"], "left_semi").select("player_id", "game_id", F.lit(True).alias("hit"))
    x = top(sides, ["player_id"], [F.desc("played_on"), F.desc("game_id")], n)
    return x.join(last, ["player_id", "game_id"], "left").select("player_id", "game_id", "rn", F.coalesce("hit", F.lit(False)).alias("counts"))


def search_games(sides: DataFrame, players: DataFrame, text: str | None = None, discipline: int | None = None, competition: str | None = None, season: str | None = None, n: int = 50) -> DataFrame:
    """The newest games that fit the filters, one row per fitting side."""
    from ..functions.text import contains_plain

    p = players.where(contains_plain(F.col("name"), text)) if text else players
    for c, v in (("discipline", discipline), ("competition", competition), ("season", season)):
        if v is not None:
            sides = sides.where(F.col(c) == v)
    return sides.join(p.select("player_id", "name"), "player_id").orderBy(F.desc("played_on"), F.desc("game_id"), "player_id").limit(n).select("game_id", "player_id", "name", "played_on")


def search_players(sides: DataFrame, players: DataFrame, text: str, n: int = 50) -> DataFrame:
    """Players whose name holds the text, most games first."""
    from ..functions.text import contains_plain

    c = sides.groupBy("player_id").agg(F.count("*").alias("n_games"))
    return players.where(contains_plain(F.col("name"), text)).join(c, "player_id", "left").select("player_id", "name", F.coalesce("n_games", F.lit(0)).alias("n_games")).orderBy(F.desc("n_games"), "player_id").limit(n)


def period_kpis(sides: DataFrame, season: str, before: str) -> DataFrame:
    """Two seasons side by side."""
    at = lambda s, c: F.sum(F.when(F.col("season") == s, F.col(c)))
    won = lambda s: F.sum(F.when((F.col("season") == s) & (F.col("result") == 1), 1).otherwise(0))
    n = lambda s: F.sum(F.when(F.col("season") == s, 1).otherwise(0))
    return sides.where(F.col("season").isin(season, before)).groupBy("player_id").agg(n(season).alias("n"), n(before).alias("n_before"), won(season).alias("won"), won(before).alias("won_before"), (at(season, "car").cast("double") / at(season, "ent")).alias("avg"), (at(before, "car").cast("double") / at(before, "ent")).alias("avg_before"))


def effectiveness(sides: DataFrame) -> DataFrame:
    """Per player and competition, the share of the points to win: a win is 2 (3 in a cup), a draw 1; halves round up."""
    value = F.when(F.col("competition") == "COPA", 3).otherwise(2)
    got = F.sum(F.when(F.col("result") == 1, value).when(F.col("result") == 0, 1).otherwise(0))
    return sides.groupBy("player_id", "competition").agg(F.count("*").alias("n"), F.floor(100.0 * got / F.sum(value) + 0.5).alias("pct"))


def head_to_head(sides: DataFrame) -> DataFrame:
    """Per player the opponents at the top of each tally (all ties, two games or more)."""
    x = sides.groupBy("player_id", "opp_id").agg(F.count("*").alias("played"), F.sum((F.col("result") == 1).cast("int")).alias("won"), F.sum((F.col("result") == -1).cast("int")).alias("lost"))
    x = x.select("player_id", "opp_id", F.expr("stack(3, 'played', played, 'won', won, 'lost', lost) as (tally, n)"))
    return x.withColumn("most", F.max("n").over(W.partitionBy("player_id", "tally"))).where("n = most and n >= 2").select("player_id", "opp_id", "tally", "n")


def pairwise(games: DataFrame, members: DataFrame) -> DataFrame:
    """Wins of each of two players against the other, for all pairs within a set."""
    m = members.select("player_id").distinct()
    x = games.join(m.withColumnRenamed("player_id", "p1"), "p1", "left_semi").join(m.withColumnRenamed("player_id", "p2"), "p2", "left_semi")
    a, b = F.least("p1", "p2"), F.greatest("p1", "p2")
    return x.groupBy(a.alias("a"), b.alias("b")).agg(F.sum((F.col("winner_id") == a).cast("int")).alias("won_a"), F.sum((F.col("winner_id") == b).cast("int")).alias("won_b"), F.count("*").alias("n"))


def rolling_average(sides: DataFrame, n: int = 15) -> DataFrame:
    """Average over each full window of ``n`` games per player and discipline."""
    w = W.partitionBy("player_id", "discipline").orderBy("played_on", "game_id").rowsBetween(1 - n, 0)
    x = sides.select("player_id", "discipline", "game_id", F.count("*").over(w).alias("n"), (F.sum("car").over(w).cast("double") / F.nullif(F.sum("ent").over(w), F.lit(0))).alias("avg"), F.min("played_on").over(w).alias("since"), F.max("played_on").over(w).alias("until"))
    return x.where(F.col("n") == n).drop("n")


def average_histogram(sides: DataFrame, least: int = 5, bins: int = 12) -> DataFrame:
    """Per player and discipline a histogram of game averages with a round bin width, and the spread around the overall average."""
    from ..functions.text import nice_step

    key = ["player_id", "discipline"]
    x = sides.where("ent > 0").withColumn("a", F.col("car").cast("double") / F.col("ent"))
    s = x.groupBy(*key).agg(F.count("*").alias("n"), F.min("a").alias("lo"), F.max("a").alias("hi"), ratio().alias("center")).where((F.col("n") >= least) & (F.col("hi") > F.col("lo")))
    s = s.withColumn("step", nice_step((F.col("hi") - F.col("lo")) / bins)).withColumn("start", F.floor(F.col("lo") / F.col("step")) * F.col("step"))
    x = x.join(s, key).withColumn("bin", F.floor((F.col("a") - F.col("start")) / F.col("step") + 1e-9))
    sd = x.groupBy(*key).agg(F.sqrt(F.avg(F.pow(F.col("a") - F.col("center"), F.lit(2)))).alias("sd"))
    return x.groupBy(*key, "step", "bin").agg(F.count("*").alias("n")).join(sd, key).select(*key, "step", "bin", "n", F.round("sd", 6).alias("sd"))


def hardest_easiest(rated: DataFrame) -> DataFrame:
    """The opponents of the highest and the lowest rating per player and discipline."""
    up = F.struct("rating", (-F.col("game_id")).alias("g"), "opp_id")
    return rated.groupBy("player_id", "discipline").agg(F.max(up).alias("h"), F.min(F.struct("rating", "game_id", "opp_id")).alias("e")).select("player_id", "discipline", F.col("h.opp_id").alias("hardest"), F.col("h.rating").alias("hard_rating"), F.col("e.opp_id").alias("easiest"), F.col("e.rating").alias("easy_rating"))


def valid_record(car: Column, opp: Column, ent: Column, discipline: Column) -> Column:
    """Whether a game may hold a record: no impossible average nor a cut-off draw in the first discipline."""
    odd = (discipline == 1) & ((car.cast("double") / ent > 2.7) | (opp.cast("double") / ent > 2.7) | ((car == opp) & (car > 0) & (ent < 10)))
    return car.isNotNull() & opp.isNotNull() & (ent > 0) & ~odd


def records(sides: DataFrame, n: int = 5) -> DataFrame:
    """Per discipline the best game averages, runs and game counts, one per player."""
    v = sides.where(valid_record(F.col("car"), F.col("opp_car"), F.col("ent"), F.col("discipline"))).withColumn("avg", F.col("car").cast("double") / F.col("ent"))
    best = lambda c: v.groupBy("discipline", "player_id").agg(F.max(F.struct(F.col(c).cast("double").alias("value"), (-F.col("game_id")).alias("g"))).alias("b")).select("discipline", "player_id", F.lit(c).alias("record"), "b.value", (-F.col("b.g")).alias("game_id"))
    most = sides.groupBy("discipline", "player_id").agg(F.count("*").cast("double").alias("value")).select("discipline", "player_id", F.lit("games").alias("record"), "value", F.lit(None).cast("long").alias("game_id"))
    return top(best("avg").unionByName(best("run")).unionByName(most), ["discipline", "record"], [F.desc("value"), "player_id"], n)


def record_ranking_average(entries: DataFrame, least: int = 5, n: int = 5) -> DataFrame:
    """Best ranking average of each player with enough rankings; of equal ones the latest."""
    x = entries.groupBy("discipline", "player_id").agg(F.count("*").alias("k"), F.max(F.struct("avg", "seq")).alias("b")).where(F.col("k") >= least)
    return top(x.select("discipline", "player_id", F.col("b.avg").alias("avg"), F.col("b.seq").alias("seq")), ["discipline"], [F.desc("avg"), F.desc("seq"), "player_id"], n)


def record_titles(results: DataFrame, n: int = 5) -> DataFrame:
    """Most first places."""
    return results.where("pos = 1").groupBy("player_id").agg(F.count("*").alias("titles")).orderBy(F.desc("titles"), "player_id").limit(n)


def podiums(results: DataFrame, opens: DataFrame) -> DataFrame:
    """First to third places with the kind and discipline of the tournament."""
    from ..functions.text import discipline_of, tournament_kind

    n = F.col("open_name")
    return results.where("pos <= 3").join(F.broadcast(opens.select("open_id", "open_name", "season")), "open_id").select("player_id", "season", "pos", "open_id", tournament_kind(n).alias("kind"), discipline_of(n).alias("category"))


def stints(seasons: DataFrame) -> DataFrame:
    """Consecutive seasons (``sy``) of a player at the same club as one row."""
    w = W.partitionBy("player_id").orderBy("sy", "club_id")
    new = (F.lag("club_id").over(w) != F.col("club_id")) | (F.lag("sy").over(w) != F.col("sy") - 1)
    x = seasons.withColumn("new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("stint", F.sum("new").over(w))
    return x.groupBy("player_id", "stint").agg(F.min("club_id").alias("club_id"), F.min("sy").alias("since"), F.max("sy").alias("until"), F.count("*").alias("n_seasons"))


def enrich_labels(games: DataFrame, published: DataFrame, participation: DataFrame) -> DataFrame:
    """A tournament for each individual game: by exact id, else by signature, else one that both players entered in that season.

    ``published(game_id, sig, tournament)``, ``participation(player_id, tournament, season)``; of several the least.
    """
    by_id = published.where("game_id is not null").groupBy("game_id").agg(F.min("tournament").alias("t1"))
    by_sig = published.groupBy("sig").agg(F.min("tournament").alias("t2"))
    a, b = (participation.select(F.col("player_id").alias(p), "tournament", F.col("season").alias(f"s{p}")) for p in ("p1", "p2"))
    need = games.join(by_id, "game_id", "left_anti").join(by_sig, "sig", "left_anti")
    both = need.select("game_id", "p1", "p2", "season").join(a, "p1").join(b, ["p2", "tournament"])
    both = both.groupBy("game_id").agg(F.min(F.struct((F.col("sp1") != F.col("season")).alias("other"), "tournament")).alias("b")).select("game_id", F.col("b.tournament").alias("t3"))
    return games.join(by_id, "game_id", "left").join(by_sig, "sig", "left").join(both, "game_id", "left").select("game_id", F.coalesce("t1", "t2", "t3").alias("tournament"), F.when(F.col("t1").isNotNull(), "id").when(F.col("t2").isNotNull(), "signature").when(F.col("t3").isNotNull(), "entries").otherwise("none").alias("source"))
