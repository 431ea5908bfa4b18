"""Running values within groups of any size.

A window by group brings each group into one task. Here rows are dealt out in ranges of
(group, order), so that a large group lies in many ranges; a window runs within the part
of a group that one range holds, and what the group's earlier ranges come to is added.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..sources.shared import durable

#: How values are run together, and how two partial results are.
KINDS = {"sum": (F.sum, lambda a, b: a + b), "max": (F.max, F.greatest), "xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b))}


def running(df: DataFrame, keys: list[str], order: list, **values: tuple[str, Column]) -> DataFrame:
    """``df`` and for every name the running value of its column from the first row of its group up to the row itself.

    ``values``: name=(kind, column), of :data:`KINDS`. ``order`` should be total: rows that
    are equal in it stay in one range. Null keys are a group. A null value is passed over;
    before the first other value the result is null. The names must be new to ``df``.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fed = df.select("*", *(c.alias(f"_v_{k}") for k, (_, c) in values.items()))
    x = durable(fed.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()))
    w = W.partitionBy("_part", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    here = x.select(*df.columns, "_part", *(KINDS[kind][0](f"_v_{k}").over(w).alias(f"_r_{k}") for k, (kind, _) in values.items()))
    before = _before(x, keys, {k: kind for k, (kind, _) in values.items()})
    same = reduce(lambda a, b: a & b, (F.col(f"h.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in keys), F.col("h._part") == F.col("b._part"))

    def both(k: str, kind: str) -> Column:
        a, b = F.col(f"b._b_{k}"), F.col(f"h._r_{k}")
        return F.coalesce(KINDS[kind][1](a, b), a, b).alias(k)

    return here.alias("h").join(F.broadcast(before).alias("b"), same, "left").select(*(F.col(f"h.`{c}`") for c in df.columns), *(both(k, kind) for k, (kind, _) in values.items()))


def _before(x: DataFrame, keys: list[str], kinds: dict[str, str]) -> DataFrame:
    """What a group's earlier ranges come to, for each group and range; two rows a range at most.

    A group that lies in several ranges is the first or the last one of each.
    """
    group = F.struct(*(F.col(f"`{k}`") for k in keys)) if keys else F.struct(F.lit(0).alias("all"))
    edges = x.groupBy("_part").agg(F.min(group).alias("lo"), F.max(group).alias("hi")).select(F.explode(F.array("lo", "hi")).alias("edge"))
    spread = edges.groupBy("edge").agg(F.count("*").alias("n")).where("n > 1").select("edge")
    part = x.withColumn("_group", group).join(F.broadcast(spread), F.col("_group").eqNullSafe(F.col("edge")), "left_semi")
    part = part.groupBy("_group", "_part").agg(*(KINDS[kind][0](f"_v_{k}").alias(f"_t_{k}") for k, kind in kinds.items()))
    w = W.partitionBy("_group").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    return part.select("_part", *(F.col("_group").getField(k).alias(k) for k in keys), *(KINDS[kind][0](f"_t_{k}").over(w).alias(f"_b_{k}") for k, kind in kinds.items()))


def numbered(df: DataFrame, keys: list[str], order: list, name: str = "k") -> DataFrame:
    """``df`` with the place of each row in its group, from 1, as a window's ``row_number`` has it, for groups of any size."""
    return running(df, keys, order, **{name: ("sum", F.lit(1).cast("long"))})
