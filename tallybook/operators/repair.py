"""Repair rules: each returns the repaired rows or the changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def _key() -> list:
    side = lambda a: F.struct(F.col(f"p{a}").alias("p"), F.col(f"car{a}").alias("c"))
    return F.array_sort(F.array(side(1), side(2)))


def fix_winners(games: DataFrame) -> DataFrame:
    """Games whose winner contradicts the points, with the right one."""
    right = F.when(F.col("car1") > F.col("car2"), F.col("p1")).when(F.col("car2") > F.col("car1"), F.col("p2"))
    return games.withColumn("right", right).where(~F.col("winner_id").eqNullSafe(F.col("right"))).select("game_id", "winner_id", "right")


def dedup_cross_source(games: DataFrame, links: DataFrame) -> DataFrame:
    """Copies of one game from several sources: where those with links agree on their set of disciplines, the first linked one stays and takes over the competition.

    ``links(game_id, discipline)``. Returns keeper and dropped game per pair.
    """
    d = links.groupBy("game_id").agg(F.array_join(F.array_sort(F.collect_set(F.col("discipline").cast("string"))), ",").alias("sets"))
    x = games.withColumn("pair", _key()).join(d, "game_id", "left")
    # both uses of the rows lie by day, so that they are shuffled once
    x = x.repartition("played_on", "pair", "ent")
    g = x.groupBy("played_on", "pair", "ent").agg(F.count("*").alias("n"), F.count_distinct("sets").alias("k"), F.min(F.when(F.col("sets").isNotNull(), F.struct("ord", "game_id")))["game_id"].alias("keeper"), F.min(F.when(F.col("competition") != "INDIVIDUAL", F.col("competition"))).alias("takes"))
    g = g.where("n > 1 and k = 1 and keeper is not null")
    return x.join(g, ["played_on", "pair", "ent"]).where("game_id <> keeper").select("keeper", F.col("game_id").alias("dropped"), "takes")


def dedup_reversed(games: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Copies within one discipline: the most linked one stays, links move to it. Returns the mapping and the new links."""
    n = links.groupBy("game_id").agg(F.count("*").alias("n_links"))
    x = games.withColumn("pair", _key()).join(n, "game_id", "left")
    w = W.partitionBy("played_on", "pair", "ent", "discipline").orderBy(F.desc(F.coalesce("n_links", F.lit(0))), "ord")
    m = x.select("game_id", F.first("game_id").over(w).alias("keeper")).where("game_id <> keeper")
    moved = links.join(m, "game_id", "left").withColumn("game_id", F.coalesce("keeper", "game_id")).drop("keeper").distinct()
    return m, moved


def clean_games(games: DataFrame) -> DataFrame:
    """Impossible runs nulled, impossible games of the first discipline dropped, cut-off innings of draws restored."""
    one = F.col("discipline") == 1
    run = lambda i: F.when((F.col(f"run{i}") > F.col(f"car{i}")) | (one & (F.col(f"run{i}") > 20)), None).otherwise(F.col(f"run{i}")).alias(f"run{i}")
    bad = one & (F.col("ent") > 0) & (F.greatest("car1", "car2").cast("double") / F.col("ent") > 2.7)
    ent = F.when(one & (F.col("car1") == F.col("car2")) & (F.col("car1") > 0) & F.col("ent").between(1, 9), F.col("ent") * 10).otherwise(F.col("ent"))
    return games.where(~bad).select("game_id", run(1), run(2), ent.alias("ent"))


def fix_ranking_averages(entries: DataFrame, linked: DataFrame, digits: int | None = 5) -> DataFrame:
    """Published averages that the linked games contradict: enough innings, half more than published, and far off."""
    # a player's sums by ranking as one map: a join by discipline and player, by which both sides may lie already
    key = ["discipline", "player_id"]
    x = linked.where("seq is not null").groupBy(*key, "seq").agg(F.sum("car").alias("c"), F.sum("ent").alias("e"))
    x = x.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("seq", F.struct("c", "e").alias("s")))).alias("sums"))
    x = entries.join(x, key).withColumn("s", F.try_element_at("sums", F.col("seq"))).select(*entries.columns, "s.c", "s.e")
    x = x.withColumn("new", F.col("c").cast("double") / F.col("e"))
    return x.where("e >= 10 and e > 1.5 * ent and c > 0").where(F.abs(F.col("new") - F.col("avg")) > 0.5).select("discipline", "seq", "player_id", "avg", (F.col("new") if digits is None else F.round("new", digits)).alias("new"))


def backfill_clubs(players: DataFrame, results: DataFrame) -> DataFrame:
    """Players without a club take that of their latest open. ``results(player_id, open_id, club)``."""
    from ..functions.text import extract_club

    last = results.where(extract_club(F.col("club")).isNotNull()).groupBy("player_id").agg(F.max(F.struct("open_id", "club"))["club"].alias("new"))
    return players.join(last, "player_id", "left").select("player_id", F.coalesce(extract_club(F.col("club")), extract_club(F.col("new"))).alias("club"))


def renamed(rows: DataFrame, col: str, fn) -> DataFrame:
    """Rows whose text a cleaning function changes: old and new."""
    return rows.withColumn("new", fn(F.col(col))).where(~F.col("new").eqNullSafe(F.col(col)))


def repair_encoding(rows: DataFrame, col: str) -> DataFrame:
    """``rows`` with UTF-8 text that was read as Windows-1252 or Latin-1 read anew, up to twice; text that does not decode stays.

    Only rows with the tell-tale letters go through Python.
    """
    import pyarrow as pa

    def once(t: str) -> str:
        raw = b""
        for ch in t:
            try:
                raw += ch.encode("cp1252")
            except UnicodeEncodeError:
                if ord(ch) > 255:
                    return t
                raw += ch.encode("latin-1")
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return t

    def run(batches):
        for b in batches:
            fixed = [once(once(t)) for t in b.column(col).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(fixed, pa.string()) if n == col else b.column(n) for n in b.schema.names], b.schema.names)

    odd = F.col(col).rlike("[ÃÂâ]")
    return rows.where(odd).mapInArrow(run, rows.schema).unionByName(rows.where(~F.coalesce(odd, F.lit(False))))
