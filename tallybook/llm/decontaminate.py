"""Benchmark decontamination by a prefix-filtered containment join.

Every item is cut into windows of ``window`` words. A window is contained in a
document when all its shingles stand there in order, so containment 1 leaves a
prefix of one shingle: its rarest, with rarity counted over all documents. A
document sends only the positions whose shingle may be some window's prefix (a
Bloom filter decides), they meet the windows in a shuffled join on
the shingle, the window's offset bounds where it may begin and end, and the words
are compared one by one.

Null or wordless texts and items take part with no words. Repeated rows get the
same result; items of the same text are all named. Shingles that are equally rare: the
first in the window is the prefix. Extra columns, whatever their names, are ignored or kept as they are.
Texts of any length are read whole, about a megabyte at a time or one text if it is
longer. Empty tables give no hits.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._common import bloom_of, durable, packed, passes, row_key, small_batches, unpacked
from ._words import chunks, grams, words

WINDOW = 10
SHINGLE = 3


def _item_windows(items: DataFrame, window: int, shingle: int) -> DataFrame:
    """One row per window and shingle in it: item_id, wid, toks, h, off, k."""

    def cut(batches):
        for b in (c for batch in batches for c in chunks(batch)):
            out = {n: [] for n in ("item_id", "toks", "h", "off", "k")}
            ids = b.column("item_id").to_pylist()
            w = words(b.column("text"))
            h = w.hashes()
            for r, item in enumerate(ids):
                i, n = int(w.first[r]), int(w.n_words[r])
                size = min(window, n)
                for start in range(n - size + 1 if n else 0):
                    k = min(shingle, size)
                    g, _ = grams(h[i + start : i + start + size], np.zeros(size), k)
                    for off, x in enumerate(g.view(np.int64)):
                        for name, v in zip(out, (item, w.text(i + start, i + start + size).split(" "), int(x), off, k), strict=True):
                            out[name].append(v)
            yield pa.RecordBatch.from_pydict({"item_id": pa.array(out["item_id"], pa.string()), "toks": pa.array(out["toks"], pa.list_(pa.string())), "h": pa.array(out["h"], pa.int64()), "off": pa.array(out["off"], pa.int32()), "k": pa.array(out["k"], pa.int32())})

    src = items.select(F.col("item_id").cast("string").alias("item_id"), "text")
    return src.mapInArrow(cut, "item_id string, toks array<string>, h long, off int, k int")


def _shingle_counts(docs: DataFrame, bloom, ks: list[int]) -> DataFrame:
    """How often each item shingle (with few strangers) occurs in all documents."""

    def count(batches):
        total: dict[int, int] = {}

        def flush():
            h = np.fromiter(total, np.int64, len(total))
            n = np.fromiter(total.values(), np.int64, len(total))
            total.clear()
            return pa.RecordBatch.from_pydict({"h": h, "n": n})

        for b in batches:
            for c in chunks(b):
                w = words(c.column("text"))
                h = w.hashes()
                for k in ks:
                    g, _ = grams(h, w.row, k)
                    u, n = np.unique(g[passes(bloom.value, g)].view(np.int64), return_counts=True)
                    for x, m in zip(u.tolist(), n.tolist(), strict=True):
                        total[x] = total.get(x, 0) + m
                if len(total) > 200_000:
                    yield flush()
        yield flush()

    return docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _candidates(docs: DataFrame, bloom, ks: list[int], window: int) -> DataFrame:
    """Per document its word count and the positions that may begin a prefix shingle, each with the words around it."""

    def scan(batches):
        for b in batches:
            for c in chunks(b):
                w = words(c.column("text"))
                h = w.hashes()
                found: list[list] = [[] for _ in range(c.num_rows)]
                for k in ks:
                    g, at = grams(h, w.row, k)
                    ok = np.flatnonzero(passes(bloom.value, g))
                    for x, i in zip(g[ok].view(np.int64).tolist(), at[ok].tolist(), strict=True):
                        r = w.row[i]
                        first, n = int(w.first[r]), int(w.n_words[r])
                        lo, hi = max(first, i - window), min(first + n, i + window)
                        found[r].append({"h": x, "pos": i - first, "lo": lo - first, "near": w.text(lo, hi)})
                yield pa.RecordBatch.from_arrays([c.column("doc_id"), c.column("_k"), pa.array(w.n_words, pa.int64()), pa.array(found, pa.list_(pa.struct([("h", pa.int64()), ("pos", pa.int32()), ("lo", pa.int32()), ("near", pa.string())])))], ["doc_id", "_k", "n_words", "found"])

    src = docs.select("doc_id", "text", row_key("doc_id", "text").alias("_k"))
    key_type = docs.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(scan, f"doc_id {key_type}, _k string, n_words long, found array<struct<h:long,pos:int,lo:int,near:string>>")


def contained_windows(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """``(scanned, hits)``: every document with ``_k`` and ``n_words``, and every occurrence of an item window: ``_k, item_id, start, size`` in words."""
    spark = docs.sparkSession
    small_batches(spark)
    ks = list(range(1, min(shingle, window) + 1))
    parts = durable(_item_windows(items, window, shingle))
    wid = F.xxhash64("item_id", "toks").alias("wid")
    windows = parts.select("item_id", "toks", "h", "off", "k", wid)
    every = spark.sparkContext.broadcast(bloom_of(windows.select("h")))
    used = [k for k in ks if k == shingle or not windows.where(F.col("k") == k).isEmpty()]
    counts = _shingle_counts(docs, every, used)
    rare = windows.join(counts, "h", "left").groupBy("item_id", "wid").agg(F.min_by(F.struct("h", "off", "toks"), F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off")).alias("w"))
    prefix = durable(rare.select("item_id", "w.*").distinct())
    chosen = spark.sparkContext.broadcast(bloom_of(prefix.select("h")))
    scanned = durable(_candidates(docs, chosen, used, window))
    near = scanned.select("_k", "n_words", F.explode("found").alias("f")).select("_k", "n_words", "f.*").distinct()
    hit = (
        near.join(prefix, "h")
        .withColumn("start", F.col("pos") - F.col("off"))
        .withColumn("size", F.size("toks"))
        .where((F.col("start") >= 0) & (F.col("start") >= F.col("lo")) & (F.col("start") + F.col("size") <= F.col("n_words")))
        .where(F.expr("slice(split(near, ' ', -1), start - lo + 1, size) = toks"))
        .select("_k", "item_id", "start", "size")
    )
    return scanned.drop("found"), hit


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and ``_k`` (see :func:`row_key`)."""
    scanned, hit = contained_windows(docs, items, window)
    covered = hit.select("_k", F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("p")).distinct().groupBy("_k").agg(F.count("*").alias("n_hit"))
    names = hit.select("_k", "item_id").distinct().groupBy("_k").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item_id")), ",").alias("names"))
    both = covered.join(names, "_k")
    return scanned.join(both, "_k", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.sha2(F.coalesce("names", F.lit("")).cast("binary"), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), "_k",
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows that hold a window of an item."""
    bad = contamination(docs, items, window).where("contaminated").select("_k").distinct()
    return unpacked(packed(docs, "doc_id", "text").join(bad, "_k", "left_anti"), docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination(docs, items).drop("_k")


QUERIES: dict[str, Callable] = {"op3_decontaminate": query}
