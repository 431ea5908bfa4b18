"""Merging, entity resolution and ingest rules over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .games import top


def merge_coalesce(base: DataFrame, delta: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """Upsert in which a column takes the last non-null value: of the delta if it has one, else of the base."""
    cols = [c for c in base.columns if c not in keys]
    both = base.select(*keys, *cols, F.lit(0).alias("_p"), F.lit(0).cast("long").alias("_o")).unionByName(delta.select(*keys, *cols, F.lit(1).alias("_p"), F.col(order).cast("long").alias("_o")))
    pick = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("_p", "_o", F.col(c).alias("v"))))["v"].alias(c)
    return both.groupBy(*keys).agg(*map(pick, cols))


def replace_rows(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert of whole rows."""
    return base.join(delta.select(*keys), keys, "left_anti").unionByName(delta)


def insert_ignore(base: DataFrame, delta: DataFrame, keys: list[str], order: list | None = None) -> DataFrame:
    """Rows of the delta whose key is new; of several the first."""
    return base.unionByName(top(delta, keys, order or keys).drop("rn").join(base.select(*keys), keys, "left_anti"))


def update_entries(entries: DataFrame, incoming: DataFrame, links: DataFrame, keys: list[str]) -> DataFrame:
    """The incoming average only where it comes with another number of games than are linked; a null number changes nothing."""
    n = links.groupBy(*keys).agg(F.count("*").alias("n_links"))
    x = entries.join(incoming.select(*keys, F.col("avg").alias("new_avg"), F.col("n_games").alias("new_n")), keys, "left").join(n, keys, "left")
    change = F.col("new_n").isNotNull() & (F.coalesce("n_links", F.lit(0)) != F.col("new_n"))
    return x.select(*keys, F.when(change, F.col("new_avg")).otherwise(F.col("avg")).alias("avg"), F.coalesce(change, F.lit(False)).alias("changed"))


def select_last(sides: DataFrame, n: int = 15) -> DataFrame:
    """The first ``n`` games by date; if the next one is of the same day as the last and has a better average, it takes its place."""
    key = ["player_id", "discipline"]
    w = W.partitionBy(*key).orderBy(F.desc("played_on"), "game_id")
    x = sides.withColumn("a", F.col("car").cast("double") / F.nullif("ent", F.lit(0))).withColumn("rn", F.row_number().over(w))
    x = x.withColumns({"next_day": F.lead("played_on").over(w), "next_a": F.lead("a").over(w), "prev_day": F.lag("played_on").over(w), "prev_a": F.lag("a").over(w)})
    swap = (F.col("next_day") == F.col("played_on")) & (F.col("next_a") > F.col("a"))
    swapped = (F.col("prev_day") == F.col("played_on")) & (F.col("a") > F.col("prev_a"))
    keep = (F.col("rn") < n) | ((F.col("rn") == n) & ~F.coalesce(swap, F.lit(False))) | ((F.col("rn") == n + 1) & F.coalesce(swapped, F.lit(False)))
    return x.where(keep).select(*key, "game_id")


def unique_names(players: DataFrame, key: Column) -> DataFrame:
    """``key -> player_id`` for the keys that one player has alone."""
    return players.withColumn("key", key).groupBy("key").agg(F.min("player_id").alias("player_id"), F.count_distinct("player_id").alias("n")).where("n = 1").drop("n")


def build_games(raw: DataFrame, names: DataFrame, placeholders: bool = True) -> DataFrame:
    """Raw games by name with ids: unique names, else placeholders ``name:...`` or the row is dropped; the winner by points."""
    x = raw
    for i in (1, 2):
        x = x.join(names.select(F.col("key").alias(f"key{i}"), F.col("player_id").cast("string").alias(f"id{i}")), f"key{i}", "left")
    if placeholders:
        x = x.withColumns({f"id{i}": F.coalesce(f"id{i}", F.concat(F.lit("name:"), F.col(f"key{i}"))) for i in (1, 2)})
    x = x.where("id1 is not null and id2 is not null")
    return x.withColumn("winner", F.when(F.col("pts1") > F.col("pts2"), F.col("id1")).when(F.col("pts2") > F.col("pts1"), F.col("id2")))


def promote_placeholders(facts: DataFrame, names: DataFrame, cols: list[str]) -> DataFrame:
    """Placeholder ids replaced where a player with exactly that name is known by now."""
    m = names.select(F.concat(F.lit("name:"), F.col("key")).alias("old"), F.col("player_id").cast("string").alias("new"))
    for c in cols:
        facts = facts.join(m.withColumnRenamed("old", c), c, "left").withColumn(c, F.coalesce("new", c)).drop("new")
    return facts


def resolve_club(mentions: DataFrame, clubs: DataFrame, aliases: DataFrame, name: Column) -> DataFrame:
    """A club id per mention: by exact id, normal name, exact alias, normal alias; the first that hits."""
    from ..functions.text import club_norm

    by = lambda df, k: df.groupBy(k.alias("k")).agg(F.min("club_id").alias("id"))
    tables = [by(clubs, F.col("club_id").cast("string")), by(clubs, club_norm(F.col("club_name"))), by(aliases, F.col("alias")), by(aliases, club_norm(F.col("alias")))]
    x = mentions.withColumn("_n", name)
    for i, t in enumerate(tables):
        x = x.withColumn("k", club_norm(F.col("_n")) if i % 2 else F.col("_n")).join(t.withColumnRenamed("id", f"_c{i}"), "k", "left").drop("k")
    return x.withColumn("club_id", F.coalesce("_c0", "_c1", "_c2", "_c3")).drop("_n", "_c0", "_c1", "_c2", "_c3")


def merge_clubs(facts: DataFrame, mapping: DataFrame, col: str = "club_id") -> DataFrame:
    """Facts re-keyed by ``mapping(source, target)``, chains followed to their end."""
    from .clubs import close_mapping

    m = close_mapping(mapping.select(F.col("source").alias("a"), F.col("target").alias("b"))).select(F.col("a").alias(col), F.col("b").alias("_t"))
    return facts.join(m, col, "left").withColumn(col, F.coalesce("_t", col)).drop("_t")


def enrich_by_signature(games: DataFrame, rows: DataFrame) -> DataFrame:
    """Null fields of games filled from league rows of the same day, unordered players, points and innings; runs swapped where sides are reversed.

    ``rows``: played_on, p1, p2, car1, car2, ent, run1, run2, tie, ord.
    """
    pair = lambda: F.array_sort(F.array(F.struct(F.col("p1").alias("p"), F.col("car1").alias("c")), F.struct(F.col("p2").alias("p"), F.col("car2").alias("c"))))
    r = rows.withColumn("pair", pair()).select("played_on", "pair", "ent", F.col("p1").alias("rp1"), F.col("run1").alias("r1"), F.col("run2").alias("r2"), F.col("tie").alias("rtie"), "ord")
    r = top(r, ["played_on", "pair", "ent"], ["ord"]).drop("rn", "ord")
    x = games.withColumn("pair", pair()).join(r, ["played_on", "pair", "ent"], "left")
    same = F.col("rp1") == F.col("p1")
    return x.select("game_id", F.coalesce("run1", F.when(same, F.col("r1")).otherwise(F.col("r2"))).alias("run1"), F.coalesce("run2", F.when(same, F.col("r2")).otherwise(F.col("r1"))).alias("run2"), F.col("rtie").alias("tie"))


def league_rows(slots: DataFrame, dates: DataFrame) -> DataFrame:
    """League rows that are games: played, both players known; the date of the row or else of its tie."""
    x = slots.where("is_played and p1 is not null and p2 is not null and not (car1 = 0 and car2 = 0)")
    return x.join(dates, ["season", "team1", "team2"], "left").select("game_id", "p1", "p2", "car1", "car2", "ent", F.coalesce("played_on", "tie_date").alias("played_on"))


def impute_innings(rows: DataFrame, key: list[str]) -> DataFrame:
    """Missing innings: the limit (50 in the first discipline, else the most of the group) where nobody has reached the group's distance."""
    g = rows.groupBy(*key).agg(F.max(F.greatest("car1", "car2")).alias("distance"), F.max("ent").alias("most"))
    limit = F.when(F.col("discipline") == 1, 50).otherwise(F.col("most"))
    return rows.join(g, key).select("game_id", F.when((F.coalesce("ent", F.lit(0)) == 0) & (F.greatest("car1", "car2") < F.col("distance")), limit).otherwise(F.col("ent")).alias("ent"))


def reconcile_dates(rankings: DataFrame, history: DataFrame) -> DataFrame:
    """Rankings against a list of publication days: the month that follows, and what changes; days without a ranking are ``missing``."""
    from ..functions.seasons import ranking_month

    h = history.groupBy("seq").agg(F.max("pub_date").alias("pub_date")).withColumn("month", ranking_month(F.col("pub_date")))
    x = rankings.select("discipline", "seq", F.make_date("y", "m", F.lit(1)).alias("old")).join(h, "seq", "full")
    state = F.when(F.col("discipline").isNull(), "missing").when(F.col("month").isNull(), "undated").when(F.col("old") != F.col("month"), "changed").otherwise("same")
    return x.select("seq", "discipline", "pub_date", "month", state.alias("state"))


def new_rankings(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Rankings beyond the last stored one of their discipline."""
    return current.join(stored.groupBy("discipline").agg(F.max("seq").alias("last")), "discipline", "left").where("last is null or seq > last").select("discipline", "seq")


def pending_work(entries: DataFrame, links: DataFrame, empty: DataFrame) -> DataFrame:
    """Entries without linked games that are not known to have none."""
    k = ["discipline", "seq", "player_id"]
    # both are of the entries' order; written, such keys take under a byte a row, and by its files' size Spark would broadcast millions of rows
    return entries.select(*k).join(links.select(*k).hint("merge"), k, "left_anti").join(empty.select(*k).hint("merge"), k, "left_anti")


def backfill_selection(entries: DataFrame, players: DataFrame, n: int) -> DataFrame:
    """Of each ranking the top ``n`` and all followed players; without a position last, and kept."""
    # the followed alone are met: of all players they are few, so that the entries need not move to them
    x = entries.join(players.where("followed").select("player_id", "followed"), "player_id", "left")
    return x.where((F.col("pos") <= n) | F.col("pos").isNull() | F.col("followed")).select("discipline", "seq", "player_id", F.row_number().over(W.partitionBy("discipline", "seq").orderBy(F.asc_nulls_last("pos"), "player_id")).alias("k"))


def complete_matchdays(slots: DataFrame, key: list[str]) -> DataFrame:
    """Groups all of whose slots are played and whose ties all have real ids."""
    return slots.groupBy(*key).agg(((F.count("*") > 0) & (F.min("tie_id") >= 0) & F.bool_and("is_played")).alias("complete"))


def mode_copy(parents: DataFrame, children: DataFrame, parent_key: list[str], fk: str) -> tuple[DataFrame, DataFrame]:
    """A parent and child table with new surrogate ids, children re-keyed through the parents' natural key."""
    p = parents.withColumn("new_id", F.xxhash64(*parent_key))
    c = children.join(p.select(F.col(fk), "new_id"), fk).drop(fk)
    return p.drop(fk), c
