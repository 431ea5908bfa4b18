"""Reading and writing tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..operators.scans import numbered
from .marts import read_mart, upsert  # noqa: F401  read_mart is part of this module's interface
from .shared import durable

#: What the JSON column of a ranking entry holds.
EXTRAS = T.StructType([T.StructField(n, t) for n, t in (("opponents_avg", T.DoubleType()), ("rank", T.DoubleType()), ("car", T.IntegerType()), ("ent", T.IntegerType()), ("pts", T.IntegerType()), ("pts_total", T.IntegerType()), ("definitive", T.BooleanType()))])


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A parquet table; with a schema only its columns, in its types."""
    df = spark.read.parquet(path)
    return df if schema is None else df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))


def read_extras(df: DataFrame, col: str = "extras", schema: T.StructType = EXTRAS) -> DataFrame:
    """The JSON column as typed columns; a missing ``definitive`` is false."""
    x = df.withColumn("_x", F.from_json(col, schema)).select(*(c for c in df.columns if c != col), "_x.*")
    return x.withColumn("definitive", F.coalesce("definitive", F.lit(False))) if "definitive" in x.columns else x


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, (df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()))


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """Override files of lines ``left = right``; blank lines and ``#`` comments are skipped, of equal lefts the greatest right holds."""
    x = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)") & F.col("value").contains("="))
    return x.select(F.trim(F.regexp_extract("value", "^([^=]*)=", 1)).alias("left"), F.trim(F.regexp_extract("value", "^[^=]*=(.*)$", 1)).alias("right")).groupBy("left").agg(F.max("right").alias("right"))


def display_name(df: DataFrame, mapping: DataFrame, col: str = "name") -> DataFrame:
    """Names replaced where the mapping has them."""
    m = mapping.select(F.col("left").alias(col), "right")
    return df.join(m, col, "left").withColumn(col, F.coalesce("right", col)).drop("right")


def write_mart(df: DataFrame, path: str, mode: str = "replace", partition: str | None = None, keys: list[str] | None = None) -> None:
    """Publish a mart: ``replace`` all, ``partitions`` (only those in ``df``), or ``upsert`` on keys, see :mod:`.marts`."""
    if mode == "partitions":
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    elif mode == "replace":
        df.write.mode("overwrite").parquet(path)
    else:
        upsert(df, path, keys)


def copy_tree(parents: DataFrame, children: DataFrame, old_id: str, natural: list[str]) -> tuple[DataFrame, DataFrame]:
    """A parent and a child table with new ids 1, 2, ... in the order of the natural key, then the old id; children follow their parents."""
    p = durable(numbered(parents, [], [*natural, old_id], "new_id"))
    return p.drop(old_id), children.join(p.select(old_id, "new_id"), old_id).drop(old_id)


def links(html: Column, pattern: str) -> Column:
    """Distinct link targets of a page that fit a pattern, in order."""
    found = F.regexp_extract_all(html, F.lit(r'(?i)href="([^"]*)"'), F.lit(1))
    return F.array_distinct(F.filter(found, lambda u: u.rlike(pattern)))
