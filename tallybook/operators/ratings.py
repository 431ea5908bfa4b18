"""Ratings by the strength of opponents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

KEY = ["player_id", "discipline"]


def opponent_rating(sides: DataFrame, links: DataFrame, entries: DataFrame) -> DataFrame:
    """Each side's opponent rated by the opponent's average in the earliest ranking that links the game, else by the game itself; without either dropped. A player has one entry a ranking."""
    first = links.groupBy("game_id", "player_id", "discipline").agg(F.min("seq").alias("seq"))
    # a player's averages by ranking as one map: a join by player and discipline, by which both sides lie already
    avgs = entries.where("seq is not null").groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("seq", "avg"))).alias("avgs"))
    rated = first.join(avgs, KEY).select("game_id", F.col("player_id").alias("opp_id"), "discipline", F.try_element_at("avgs", F.col("seq")).alias("ranked")).where("ranked is not null")
    own = F.when(F.col("ent") > 0, F.col("opp_car").cast("double") / F.col("ent"))
    x = sides.join(rated, ["game_id", "opp_id", "discipline"], "left").withColumn("rating", F.coalesce("ranked", own))
    return x.where("rating is not null").select(*KEY, "game_id", "opp_id", "result", "rating")


def rating_buckets(rated: DataFrame, n: int = 8) -> DataFrame:
    """About equally large buckets by rating; equal ratings are never split.

    A rating opens a bucket where a cut, the half-even rounding of k*total/n, lies
    after the start of the rating before it and not after its own.
    """
    d = rated.groupBy(*KEY, "rating").agg(F.count("*").alias("c"), *(F.sum((F.col("result") == r).cast("int")).alias(x) for r, x in ((1, "won"), (-1, "lost"), (0, "drawn"))))
    w = W.partitionBy(*KEY).orderBy("rating")
    d = d.withColumn("s", F.sum("c").over(w) - F.col("c")).withColumn("tot", F.sum("c").over(W.partitionBy(*KEY))).withColumn("sp", F.coalesce(F.lag("s").over(w), F.lit(-1)))
    cuts = F.transform(F.sequence(F.lit(1), F.lit(n - 1)), lambda k: F.bround(k * F.col("tot") / F.lit(n)))
    opens = (F.col("s") > 0) & F.exists(cuts, lambda t: (F.col("sp") < t) & (t <= F.col("s")))
    d = d.withColumn("bucket", F.sum(opens.cast("int")).over(w))
    return d.groupBy(*KEY, "bucket").agg(F.round(F.min("rating"), 4).alias("lo"), F.round(F.max("rating"), 4).alias("hi"), F.sum("won").alias("won"), F.sum("lost").alias("lost"), F.sum("drawn").alias("drawn"))


def weighted_index(rated: DataFrame) -> DataFrame:
    """Share of the rating won among that of decisive games, in percent; null without any."""
    den = F.sum(F.when(F.col("result") != 0, F.col("rating")))
    num = F.sum(F.when(F.col("result") == 1, F.col("rating")).otherwise(0.0))
    return rated.groupBy(*KEY).agg(F.when(den > 0, F.round(100 * num / den, 1)).alias("idx"))


def crossover(buckets: DataFrame, digits: int | None = 3) -> DataFrame:
    """The rating where the win rate crosses one half: the last bucket's if never below, the first's if never above, else interpolated at the first fall."""
    b = buckets.where("won + lost > 0").withColumn("m", (F.col("lo") + F.col("hi")) / 2).withColumn("w", F.col("won") / (F.col("won") + F.col("lost")))
    o = W.partitionBy(*KEY).orderBy("bucket")
    b = b.withColumn("m1", F.lead("m").over(o)).withColumn("w1", F.lead("w").over(o))
    fall = (F.col("w") >= 0.5) & (F.col("w1") < 0.5)
    at = F.col("m") + (0.5 - F.col("w")) * (F.col("m1") - F.col("m")) / (F.col("w1") - F.col("w"))
    x = b.groupBy(*KEY).agg(F.min("w").alias("least"), F.max("w").alias("most"), F.min_by("m", "bucket").alias("first"), F.max_by("m", "bucket").alias("last"), F.min_by(F.when(fall, at), F.when(fall, F.col("bucket"))).alias("cross"))
    value = F.when(F.col("least") >= 0.5, F.col("last")).when(F.col("most") < 0.5, F.col("first")).otherwise(F.coalesce("cross", "last"))
    return x.select(*KEY, (value if digits is None else F.round(value, digits)).alias("crossover"))


def breakdown(sides: DataFrame, links: DataFrame, entries: DataFrame, n: int = 8, digits: int | None = 3) -> DataFrame:
    """Buckets of every player and discipline with the index and the crossover."""
    rated = opponent_rating(sides, links, entries).select(*KEY, "result", "rating").repartition(*KEY)
    b = rating_buckets(rated, n)
    return b.join(weighted_index(rated), KEY).join(crossover(b, digits), KEY, "left")
