"""Live results as streams, each with a batch twin that takes a plain DataFrame.

Snapshots are rows ``open_id, match_id, captured_at, payload`` whose payload is JSON.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.marts import read_mart, upsert
from ..sources.shared import durable

#: A snapshot of an open as its scoreboard hands it out.
SNAPSHOT = "open_id long, captured_at timestamp, phases array<struct<phase: string, matches: array<struct<match_id: long, a: long, b: long, car_a: int, car_b: int, is_played: boolean>>>>"
PAYLOAD = "phase string, a long, b long, car_a int, car_b int, is_played boolean"


def snapshot_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """The append-only log as a stream of exploded matches."""
    return exploded(spark.readStream.schema(schema).parquet(path))


def exploded(log: DataFrame) -> DataFrame:
    """Typed matches of a log; works on streams and tables alike."""
    return log.withColumn("m", F.from_json("payload", PAYLOAD)).select("open_id", "match_id", "captured_at", "m.*")


def latest_state(matches: DataFrame, at=None) -> DataFrame:
    """The newest row of each match (up to a time); finished matches leave."""
    x = matches if at is None else matches.where(F.col("captured_at") <= F.lit(at).cast("timestamp"))
    x = x.groupBy("open_id", "match_id").agg(F.max_by(F.struct("phase", "a", "b", "car_a", "car_b", "is_played"), "captured_at").alias("m"), F.max("captured_at").alias("captured_at"))
    return x.select("open_id", "match_id", "captured_at", "m.*").where("not is_played")


def replay(log: DataFrame, at) -> DataFrame:
    """The state of every open as it was at a time, finished matches included."""
    x = log.where(F.col("captured_at") <= F.lit(at).cast("timestamp"))
    return exploded(x.groupBy("open_id", "match_id").agg(F.max_by("payload", "captured_at").alias("payload"), F.max("captured_at").alias("captured_at")))


def parsed(lines: DataFrame) -> DataFrame:
    """Lines ``value`` of JSON snapshots as ``digest, bad, open_id, captured_at, phases``; ``bad`` holds a line that is no snapshot with an id and a time."""
    x = lines.withColumn("s", F.from_json("value", f"{SNAPSHOT}, broken string", {"columnNameOfCorruptRecord": "broken"}))
    bad = F.col("s").isNull() | F.col("s.broken").isNotNull() | F.col("s.open_id").isNull() | F.col("s.captured_at").isNull()
    return x.select(F.sha2("value", 256).alias("digest"), F.when(bad, F.coalesce("value", F.lit(""))).alias("bad"), "s.open_id", "s.captured_at", "s.phases")


def matches_of(snapshots: DataFrame) -> DataFrame:
    """One row per match of whole snapshots."""
    x = snapshots.select("open_id", "captured_at", F.explode("phases").alias("p"))
    return x.select("open_id", "captured_at", F.col("p.phase").alias("phase"), F.explode("p.matches").alias("m")).select("open_id", "captured_at", "phase", "m.*")


def log_snapshots(spark: SparkSession, path: str, out: str, late: str = "1 day", files: int | None = None) -> DataFrame:
    """Append the matches of new snapshot files under ``path`` to the log ``out/matches``; returns the log.

    Files hold one JSON snapshot a line. A snapshot that comes again within ``late`` is
    left out. Lines that are no snapshots go to ``out/bad`` as they are. Both logs take
    every line once, also after a restart.
    """
    def lines():
        source = spark.readStream.schema("value string")
        return parsed((source if files is None else source.option("maxFilesPerTrigger", files)).text(path))

    good = lines().where("bad is null").withWatermark("captured_at", late).dropDuplicatesWithinWatermark(["open_id", "captured_at", "digest"])
    log = matches_of(good)
    runs = [(log, "matches"), (lines().where("bad is not null").select("bad"), "bad")]
    for df, name in runs:
        df.writeStream.format("parquet").option("path", f"{out}/{name}").option("checkpointLocation", f"{out}/_checkpoint_{name}").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(log.schema).parquet(f"{out}/matches")


@dataclass(frozen=True)
class Step:
    """A mart of a refresh: its path, its keys, those of the columns they determine by which it is laid out, and how rows of the mart before make its rows.

    Where the layout is by some of the next step's keys, that step reads only the buckets it needs.
    """

    path: str
    keys: list[str]
    by: list[str]
    make: Callable[[DataFrame], DataFrame] | None = None


def refresh(stream: DataFrame, base: Step, steps: list[Step], newest: str, checkpoint: str, counts: str | None = None) -> None:
    """Carry the changed rows of a stream into the mart ``base`` and on through the aggregates ``steps``, each made of the one before.

    A step is made anew for those of its keys that the batch brings, from the buckets in
    which their rows lie; all else stays as it is. Rows that are older by
    ``newest`` than what is known change nothing. ``counts`` gets a row per batch and
    step: how many keys were made anew of how many. A batch that runs again gives the same.
    """

    def run(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        batch = durable(batch)
        if batch.isEmpty():
            return
        upsert(batch, base.path, base.keys, by=base.by, newest=newest, number=n + 1)
        above = base
        for i, step in enumerate(steps):
            keys = durable(batch.select(*step.keys).distinct())
            rows = read_mart(spark, above.path, of=batch.select(*above.by).distinct()) if set(above.by) <= set(step.keys) else read_mart(spark, above.path)
            same = [F.col(f"r.`{c}`").eqNullSafe(F.col(f"k.`{c}`")) for c in step.keys]
            made = durable(step.make(rows.alias("r").join(keys.alias("k"), same, "left_semi")))  # three uses, one making
            upsert(made, step.path, step.keys, by=step.by, number=n + 1)
            if counts:
                row = keys.agg(F.count("*").alias("made")).select(F.lit(n).alias("batch"), F.lit(i).alias("step"), "made").crossJoin(read_mart(spark, step.path).agg(F.count("*").alias("known")))
                row.write.mode("overwrite").parquet(f"{counts}/batch={n}/step={i}")
            above = step

    stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def pending(stream: DataFrame, known: DataFrame) -> DataFrame:
    """Games that the official table does not hold yet: a stream-static anti-join."""
    return stream.join(known.select("match_id"), "match_id", "left_anti")


def fresh_scores(matches: DataFrame, at, closed: DataFrame, played: DataFrame, minutes: int = 12) -> DataFrame:
    """Scoreboard rows of the last minutes, not finished, whose phase is not closed and whose pair has no official game."""
    t = F.lit(at).cast("timestamp")
    x = matches.where((F.col("captured_at") > t - F.expr(f"INTERVAL {minutes} MINUTES")) & (F.col("captured_at") <= t) & ~F.col("is_played"))
    return still_open(x, closed, played)


def still_open(rows: DataFrame, closed: DataFrame, played: DataFrame) -> DataFrame:
    """Scoreboard rows that are not finished, whose phase is not closed and whose pair has no official game."""
    x = rows.where(~F.col("is_played")).join(closed.select("open_id", "phase"), ["open_id", "phase"], "left_anti")
    pair = lambda df: df.withColumn("x", F.least("a", "b")).withColumn("y", F.greatest("a", "b"))
    return pair(x).join(pair(played).select("open_id", "x", "y"), ["open_id", "x", "y"], "left_anti").drop("x", "y")


def activity(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events per tumbling window and type; on a stream with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("since"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Each user's sessions, parted by gaps without events."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("since"), F.col("session_window.end").alias("until"), "n")
