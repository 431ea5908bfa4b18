"""What the operators share: durable intermediates, row keys and component labels."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows and bytes of one Arrow batch; a longer text is a batch of its own.
ARROW_ROWS, ARROW_BYTES = 1000, 16 << 20
#: Least and most bits of a Bloom filter, whose size follows its keys: 2 to 32 MB. Beyond
#: some 30 million keys it lets more through to the exact join that follows.
BLOOM_BITS = 1 << 24, 1 << 28
#: Bytes of the parts in which a Bloom filter is built by tasks.
_BLOOM_PART = 1 << 16


def shared_dir(spark: SparkSession) -> str:
    """A new folder that the driver and all executors can reach.

    It lies in ``spark.checkpoint.dir``. Where that is unset, a temporary folder is made
    and set if all runs on one machine; elsewhere it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tallybook/{uuid.uuid4().hex}"


def durable(df: DataFrame, partition_hint: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage: a lost executor costs one reread, and no later job
    computes the plan again.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    (df if partition_hint is None else df.coalesce(partition_hint)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows and bytes, as one text may be very long; smaller settings of the session stay."""
    for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        now = re.fullmatch(r"([0-9]+)b?", str(spark.conf.get(f"spark.sql.execution.arrow.{name}")))
        if now is None or not 0 < int(now[1]) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def packed(df: DataFrame, *key: str) -> DataFrame:
    """``_k``, the :func:`row_key`, and ``_row``, all columns of ``df`` in a struct, so that no name can clash in a join."""
    return df.select(row_key(*key).alias("_k"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"))


def unpacked(rows: DataFrame, columns: list[str], replace: dict | None = None, **add) -> DataFrame:
    """The ``columns`` of ``_row``, those in ``replace`` with a new value, then the columns ``add``.

    A column of the input that has the name of an added one is replaced by it.
    """
    news, gone = replace or {}, {c.lower() for c in add}
    kept = [news.get(c, F.col("_row").getField(c)).alias(c) for c in columns if c.lower() not in gone]
    return rows.select(*kept, *(v.alias(k) for k, v in add.items()))


def row_key(*cols: str):
    """A key of 128 bits over the given columns, nulls included.

    Repeated rows share it, and so share their result.
    """
    parts = [F.coalesce(F.concat(F.lit("1"), F.col(c).cast("string")), F.lit("0")) for c in cols]
    return F.md5(F.concat_ws("\x1f", *parts).cast("binary"))


def bloom_of(hashes: DataFrame) -> np.ndarray:
    """A bit field over column ``h``, eight bits or more a key within ``BLOOM_BITS``; tasks build its parts."""
    keys = hashes.select("h")
    n = keys.count()
    bits = min(max(1 << (8 * n).bit_length(), BLOOM_BITS[0]), BLOOM_BITS[1])

    def build(batches):
        parts: dict[int, np.ndarray] = {}
        for b in batches:
            slot = b.column("slot").to_numpy()
            part = slot // (8 * _BLOOM_PART)
            for k in np.unique(part).tolist():
                at = slot[part == k] % (8 * _BLOOM_PART)
                np.bitwise_or.at(parts.setdefault(k, np.zeros(_BLOOM_PART, np.uint8)), at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_pydict({"part": pa.array(list(parts), pa.int64()), "field": pa.array([x.tobytes() for x in parts.values()], pa.binary())})

    slots = keys.select(F.expr(f"pmod(h, {bits}L)").alias("slot")).distinct().repartition(F.expr(f"slot div {8 * _BLOOM_PART}"))
    field = np.zeros(bits // 8, np.uint8)
    for r in slots.mapInArrow(build, "part long, field binary").collect():
        field[r.part * _BLOOM_PART : (r.part + 1) * _BLOOM_PART] |= np.frombuffer(r.field, np.uint8)
    return field


def passes(field: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = h & np.uint64(8 * len(field) - 1)
    return (field[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def split_join(big: DataFrame, small: DataFrame, keys: list[str], weight: str, parts: int = 4096) -> DataFrame:
    """Inner join with ``small``, one row per key, whose ``weight`` is at least the number of rows of ``big`` with that key.

    Keys with over 1 in ``parts`` of the weight, of which there are fewer than ``parts``,
    are broadcast, so none of them is gathered in one task; all others are shuffled.
    """
    edge = (small.agg(F.sum(weight)).first()[0] or 0) / parts
    rest = [c for c in small.columns if c != weight]
    hot = small.where(F.col(weight) > edge).select(*rest, F.lit(True).alias("_hot"))
    marked = big.join(F.broadcast(hot), keys, "left")
    cold = marked.where("_hot is null").select(*big.columns).join(small.where(F.col(weight) <= edge).select(rest), keys)
    return marked.where("_hot").drop("_hot").unionByName(cold)


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row ``(v, label)`` per vertex, the label its least member.

    Alternates large-star and small-star steps until the edges stand still. Each
    step is a grouped minimum and a join on the vertex; the hub of a large
    component is a skewed join key, which adaptive execution splits. Every round
    is written to the shared folder. Empty edges give an empty result.
    """
    e = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        e = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        e = durable(e.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        state = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("a").alias("v"), F.col("b").alias("label")).union(e.select(F.col("b").alias("v"), F.col("b").alias("label")).distinct())
