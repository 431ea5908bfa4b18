"""Near copies by SimHash fingerprints, found by pigeonring filtering.

A text's fingerprint has a bit for each of the 64 of its shingles' hashes: 1 where more
than half of the hashes have it. Texts link where their fingerprints differ in at most
``max_bits`` bits.

The 64 bits are cut into ``segments`` on a ring. If two fingerprints differ in no more
than t bits, then some segment starts a chain of which every first l segments differ in
no more than l * t / segments bits together (the pigeonring principle; for one segment
it is the pigeonhole principle). The first segments of a chain, whose budget is below
one bit, must be equal: they are the key on which distinct fingerprints are shuffled,
once for each segment that a chain can start at. Within a key the longer chains are
checked before the whole distance is. A key with more than ``BLOCK`` fingerprints is
dealt into blocks, each two of which meet in a task of their own. A task returns a
forest of its links, not its pairs, and components of these name each document's group.
The answer is exact: no link within ``max_bits`` is lost, and a link found from several
segments does no harm.

A word is a run without ASCII white space, A-Z lower-cased. Hashes are XXH64 of the
shingle's words joined by one space, in UTF-8, seed 42; repeated shingles count each
time. A text of fewer words than a shingle has one shingle, all of them; one without
words, or a null text, has fingerprint 0 and links like any other. Repeated rows and
texts share a fingerprint and a component. Documents without an id link too; a component
is named by its least known id, one without any by null. Extra columns are ignored.
Texts of any length are read whole, shingles are hashed some ten thousand at a time. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._common import components, durable, row_key, small_batches, split_join

SHINGLE = 3
MAX_BITS = 2
#: Odd numbers make the longest keys: five segments make keys of 25 or 26 bits.
SEGMENTS = 5
BLOCK = 2048
SEED = 42
#: Shingles hashed at once.
_AT_ONCE = 1 << 14


def fingerprint(text: bytes | None, n: int = SHINGLE) -> int:
    """Of a text in UTF-8."""
    w = (text or b"").lower().split()
    if not w:
        return 0
    ones, total = np.zeros(64, np.int64), max(1, len(w) - n + 1)
    for i in range(0, total, _AT_ONCE):
        part = w[i : i + _AT_ONCE + n - 1]
        shingles = [b" ".join(s) for s in zip(*(part[j:] for j in range(n)), strict=False)] or [b" ".join(w)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """Per document: doc_id, fp (long) and ``_k`` (row key)."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), n) for t in b.column("text").cast(pa.binary())], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_k"), pa.array(fp.view(np.int64))], ["doc_id", "_k", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", row_key("doc_id", "text").alias("_k"), "text").mapInArrow(run, f"doc_id {kind}, _k string, fp long")


def rings(segments: int, max_bits: int) -> tuple[list[tuple[int, int]], int, list[int]]:
    """Bounds of the segments, how many of a chain must be equal, and the bits that its first 1, 2, ... segments may differ in."""
    if not 0 <= max_bits < segments <= 64:
        raise ValueError("at least one segment more than bits may differ, and no more than 64")
    cut = [64 * i // segments for i in range(segments + 1)]
    budget = [length * max_bits // segments for length in range(1, segments + 1)]
    return list(zip(cut[:-1], cut[1:], strict=True)), sum(b == 0 for b in budget), budget


def _bits(lo: int, hi: int) -> int:
    return ((1 << hi) - 1) ^ ((1 << lo) - 1)


def _long(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def keyed(distinct: DataFrame, segments: int, max_bits: int) -> DataFrame:
    """Every fingerprint once for each segment ``at`` that a chain may start at, with the bits of the chain's equal segments, ``key``."""
    bounds, equal, _ = rings(segments, max_bits)
    masks = [_long(sum(_bits(*bounds[(i + j) % segments]) for j in range(equal))) for i in range(segments)]
    keys = F.array(*(F.struct(F.lit(i).alias("at"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)))
    return distinct.select("fp", F.explode(keys).alias("s")).select("fp", "s.at", "s.key")


def chained(x: np.ndarray, at: int, segments: int, max_bits: int) -> np.ndarray:
    """Which of the differences ``x`` (a xor b) have a chain from segment ``at`` that stays in its budgets to the end.

    The last budget is the whole distance.
    """
    bounds, equal, budget = rings(segments, max_bits)
    left = np.ones(x.shape, bool)
    mask = 0
    for length in range(1, segments + 1):
        mask |= _bits(*bounds[(at + length - 1) % segments])
        if length > equal or length == segments:
            left[left] = np.bitwise_count(x[left] & np.uint64(mask)) <= budget[length - 1]
    return left


def _forest(pdf: pd.DataFrame, segments: int, max_bits: int) -> np.ndarray:
    """Links within one key's block, or between its two blocks, as a forest: each tied fingerprint and its tree's root."""
    at = int(pdf["at"].iloc[0])
    fp, blk = pdf.fp.to_numpy().view(np.uint64), pdf.blk.to_numpy()
    one = blk == blk.min()
    left, right = np.flatnonzero(one), np.flatnonzero(one if one.all() else ~one)
    root = np.arange(len(fp))

    def roots(v: np.ndarray) -> np.ndarray:
        r = root[v]
        while (root[r] != r).any():
            r = root[r]
        return r

    for i in range(0, len(left), 256):
        rows = left[i : i + 256]
        ok = chained(fp[rows, None] ^ fp[right], at, segments, max_bits)
        for row, near in zip(rows[ok.any(1)], ok[ok.any(1)], strict=True):
            r = roots(np.append(right[near], row))
            root[r] = r.min()
    r = roots(np.arange(len(fp)))
    tied = np.flatnonzero(r != np.arange(len(fp)))
    return np.stack([fp[tied], fp[r[tied]]], 1)


def links(distinct: DataFrame, max_bits: int = MAX_BITS, segments: int = SEGMENTS, block: int = BLOCK) -> DataFrame:
    """``a, b``: for every two fingerprints of ``distinct(fp)`` that differ in ``max_bits`` bits or less, a path between them."""
    flat = keyed(distinct, segments, max_bits)
    size = flat.groupBy("at", "key").agg(F.count("*").alias("c")).where("c > 1").withColumn("nb", F.ceil(F.col("c") / block).cast("int"))
    many = split_join(flat, size, ["at", "key"], "c").withColumn("blk", F.pmod(F.xxhash64("fp"), "nb").cast("int"))
    met = many.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).withColumns({"i": F.least("blk", "o"), "j": F.greatest("blk", "o")})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_forest(pdf, segments, max_bits).view(np.int64), columns=["a", "b"])

    return met.select("at", "key", "i", "j", "blk", "fp").groupBy("at", "key", "i", "j").applyInPandas(run, "a long, b long")


def near_copies(docs: DataFrame, n: int = SHINGLE, max_bits: int = MAX_BITS, segments: int = SEGMENTS) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id (the least doc_id of those reachable by links), and ``_k``."""
    rows = durable(fingerprints(docs, n))
    one = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    label = components(links(one.select("fp"), max_bits, segments))
    named = one.join(label.select(F.col("v").alias("fp"), "label"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    found = durable(named.join(least, "label").select("fp", "component_id", "n"))
    return split_join(rows, found, ["fp"], "n").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "_k")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("_k")


QUERIES: dict[str, Callable] = {"op13_simhash": query}
