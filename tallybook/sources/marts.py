"""Keyed marts whose upserts rewrite only the buckets that they touch.

Rows lie in ``path/_bucket=<hash of the keys>/_v=<number of the upsert>``. An upsert
writes the buckets of its own keys anew under its number and then sets a marker for
that number; readers take for every bucket the newest version up to the last marker, so
they see the mart before an upsert or after it, and never a part of one. The version
before stays for readers that began earlier, older ones are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

BUCKETS = 64


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    hadoop, fs = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(hadoop)] if fs.exists(hadoop) else []


def commits(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """Numbers of the upserts that are complete, and the number of buckets of each."""
    return sorted(tuple(map(int, n.split("_"))) for n in _names(spark, f"{path}/_commits") if n[:1].isdigit())


def layout(spark: SparkSession, path: str, upto: int | None = None) -> dict[int, int]:
    """For every bucket the number of the upsert that wrote its rows as of upsert ``upto`` (the last)."""
    done = [n for n, _ in commits(spark, path) if upto is None or n <= upto]
    hadoop, fs = _fs(spark, f"{path}/_bucket=*/_v=*")
    found: dict[int, int] = {}
    for s in fs.globStatus(hadoop) or []:
        v = int(s.getPath().getName()[3:])
        if v in done:
            b = int(s.getPath().getParent().getName()[8:])
            found[b] = max(found.get(b, 0), v)
    return found


def _read(spark: SparkSession, path: str, at: dict[int, int]) -> DataFrame:
    schema = spark.read.parquet(f"{path}/_schema").schema
    files = [f"{path}/_bucket={b}/_v={v}" for b, v in sorted(at.items())]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def _bucket(by: list[str], n: int):
    return F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")


def touched(df: DataFrame, by: list[str], n: int) -> list[int]:
    """The buckets that the rows of ``df`` lie in, ``n`` at most."""
    return sorted(r.b for r in df.select(_bucket(by, n).alias("b")).distinct().collect())


def read_mart(spark: SparkSession, path: str, of: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """The mart; with ``of`` at least the rows whose ``by`` columns occur in it, from their buckets only."""
    at = layout(spark, path)
    if of is not None:
        keep = set(touched(of, by or of.columns, commits(spark, path)[-1][1]))
        at = {b: v for b, v in at.items() if b in keep}
    return _read(spark, path, at)


def upsert(df: DataFrame, path: str, keys: list[str], by: list[str] | None = None, newest: str | None = None, number: int | None = None, buckets: int = BUCKETS) -> list[int]:
    """Put the rows of ``df`` into the mart in place of those with equal ``keys``; returns the buckets written.

    ``by`` (some of the columns that a key determines) lays the rows out, the keys if not
    given. With ``newest``, of equal keys the row that is greatest in that column stays,
    old or new, so late rows change nothing; else keys of ``df`` must be distinct.
    ``number`` repeats an upsert: the same again gives the same. The first upsert fixes
    the number of buckets.
    """
    spark, by = df.sparkSession, by or keys
    done = commits(spark, path)
    number = number or max((n for n, _ in done), default=0) + 1
    buckets = done[-1][1] if done else buckets
    if not done:
        df.limit(0).write.mode("overwrite").parquet(f"{path}/_schema")
    hit = touched(df, by, buckets)
    before = layout(spark, path, number - 1)
    old = _read(spark, path, {b: before[b] for b in hit if b in before})
    new = df.select(*old.columns)
    if newest is None:
        rows = old.join(new.select(*keys), keys, "left_anti").select(*old.columns).unionByName(new)
    else:
        both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
        rows = both.groupBy(*keys).agg(F.max_by(F.struct(*old.columns), F.struct(newest, "_new")).alias("r")).select("r.*")
    # few buckets, as of a few values of ``by``, are dealt over as many tasks as there are; small parts are put together again
    spread = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // max(1, len(hit)))
    laid = rows.withColumns({"_bucket": _bucket(by, buckets), "_v": F.lit(number)}).repartition("_bucket", F.pmod(F.hash(*keys), F.lit(spread)))
    laid.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket", "_v").parquet(path)
    hadoop, fs = _fs(spark, f"{path}/_commits/{number}_{buckets}")
    fs.create(hadoop, True).close()
    _drop_old(spark, path, number)
    return hit


def _drop_old(spark: SparkSession, path: str, number: int) -> None:
    """Delete bucket versions that neither the last upsert nor the one before it reads."""
    last, before = layout(spark, path, number), layout(spark, path, number - 1)
    hadoop, fs = _fs(spark, f"{path}/_bucket=*/_v=*")
    for s in fs.globStatus(hadoop) or []:
        b, v = int(s.getPath().getParent().getName()[8:]), int(s.getPath().getName()[3:])
        if v < number and v not in (last.get(b), before.get(b)):
            fs.delete(s.getPath(), True)
