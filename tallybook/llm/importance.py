"""Quality classifier by importance resampling.

Two generative models of hashed n-grams, one of target text (labelled good) and one
of raw text (all documents), give every document a log importance weight: the sum over
its words, word pairs and word starts of the log ratio of the two smoothed
frequencies. A ratio is drawn towards 0 by ``SHRINK`` standard errors, so rare n-grams
say nothing. Documents are sampled without replacement in proportion to their weights
by Gumbel top-k: the log weight over a temperature (1 samples by the weights
themselves) plus Gumbel noise, which a keyed hash of its row gives, must be among the
k largest.

By default ``k`` follows from labels: held-out labelled rows give a cut, in units of
the root of a text's number of n-grams, so that long texts do not differ from short
ones by chance alone; weights are taken against it, and as many documents are drawn as
weigh more than it.

Tokens are runs of word bytes (lower-cased ASCII, digits, all above 0x7F) and runs
of punctuation; a pair of equal tokens counts as one feature, repetition.

Raw text is counted over all rows. The target model and the cut read at most
``FIT_ROWS`` labelled rows, chosen by a hash of their id; the tables have ``BUCKETS``
entries whatever the input. The k-th largest key is found by counting keys in bins of
an ever smaller range, so no sort of documents meets in one task.

Null and empty texts have weight 0. Repeated rows get the same weight and, with the
same id, the same key; where the last place falls among them, the earlier rows in file
order are taken. Labels may be null (row not used). Without usable labels every
document is selected. Extra columns, whatever their names, are ignored or kept as they
are. Texts of any length are read whole, about a megabyte at a time or one text if it
is longer. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._common import durable, packed, row_key, small_batches, unpacked
from ._words import _power, chunks, mix

BUCKETS, PART = 1 << 20, 1 << 12
FIT_ROWS = 20_000
PRIOR = 0.5
SHRINK = 3.0
#: What the cut pays for a good document lost, against a bad one kept.
CLEAN_COST = 2
#: Bytes of word starts; longer words also count by theirs, so that inflected words share features.
STEMS = (4, 6, 8)
TEMPERATURE = 1.0
SEED = 11
#: Bins in which a range of keys is counted at once.
BINS = 4096
_CLASS = np.full(256, 2, np.uint8)
_CLASS[[0, 9, 10, 11, 12, 13, 32]] = 0
_CLASS[48:58] = _CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Bucket and row of every word, word pair and word start."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    off = off - off[0]
    n = len(buf)
    kind = np.zeros(n + 2, np.uint8)
    kind[1:-1] = _CLASS[buf]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    lo = np.flatnonzero((kind[1:-1] > 0) & ((kind[1:-1] != kind[:-2]) | cut[:-1]))
    hi = np.flatnonzero((kind[1:-1] > 0) & ((kind[1:-1] != kind[2:]) | cut[1:])) + 1
    up, down = _power(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER[buf].astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    h = mix((total[hi] - total[lo]) * down[lo] + (hi - lo).astype(np.uint64))
    row = np.searchsorted(off, lo, "right") - 1
    at = np.flatnonzero(row[1:] == row[:-1]) if len(row) else row
    pair = mix(h[at] * np.uint64(3) + h[at + 1])
    pair[h[at] == h[at + 1]] = 1
    found, rows = [h, pair], [row, row[at]]
    for k in STEMS:
        stem = np.flatnonzero((hi - lo > k) & (kind[1:-1][lo] == 1))
        ends = lo[stem] + k
        found.append(mix((total[ends] - total[lo[stem]]) * down[lo[stem]] + np.uint64(73 + k)))
        rows.append(row[stem])
    return (np.concatenate(found) & np.uint64(BUCKETS - 1)).astype(np.int64), np.concatenate(rows), len(off) - 1


def _counts(docs: DataFrame) -> np.ndarray:
    """Features of all texts by bucket; tasks add them up in parts of ``PART`` buckets, all of which are 8 MB in the driver."""

    def run(batches):
        count = np.zeros(BUCKETS)
        for b in batches:
            for c in chunks(b):
                count += np.bincount(features(c.column("text"))[0], minlength=BUCKETS)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"b": at, "count": count[at]})

    def build(batches):
        parts: dict[int, np.ndarray] = {}
        for b in batches:
            at, n = b.column("b").to_numpy(), b.column("count").to_numpy()
            for k in np.unique(at // PART).tolist():
                of = at // PART == k
                parts.setdefault(k, np.zeros(PART))
                parts[k] += np.bincount(at[of] - k * PART, n[of], PART)
        yield pa.RecordBatch.from_pydict({"part": pa.array(list(parts), pa.int64()), "counts": pa.array([x.tobytes() for x in parts.values()], pa.binary())})

    found = docs.select("text").mapInArrow(run, "b long, count double").repartition(F.expr(f"b div {PART}"))
    count = np.zeros(BUCKETS)
    for r in found.mapInArrow(build, "part long, counts binary").collect():
        count[r.part * PART : (r.part + 1) * PART] = np.frombuffer(r.counts)
    return count


def _weigh(docs: DataFrame, table, extra: list[str]) -> DataFrame:
    """The columns ``extra``, the sum of log ratios ``log_weight`` and the root of the number of features, ``root``."""

    def run(batches):
        for b in batches:
            for c in chunks(b):
                x, row, n = features(c.column("text"))
                yield pa.RecordBatch.from_arrays([*(c.column(k) for k in extra), pa.array(np.bincount(row, table.value[x], minlength=n).astype(np.float64)), pa.array(np.sqrt(np.bincount(row, minlength=n)))], [*extra, "log_weight", "root"])

    kinds = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in extra)
    return docs.select("text", *extra).mapInArrow(run, f"{kinds}, log_weight double, root double")


class Model:
    """Log ratios by bucket, and the cut (a weight per root of the number of features) that errs least on held-out rows."""

    def __init__(self, ratio: np.ndarray, cut: float):
        self.ratio, self.cut = ratio, cut


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, prior: float = PRIOR, shrink: float = SHRINK) -> Model | None:
    """Fit on all ``docs`` as raw text and at most ``fit_rows`` rows of ``labels(doc_id, good)``; a fifth of these sets the cut."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    chosen = labels.where("doc_id is not null and good is not null").groupBy("doc_id").agg(F.min("good").alias("good")).orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(fit_rows)
    sample = durable(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(5))))
    target = _counts(sample.where("fold > 0 and good <> 0"))
    if not target.sum():
        return None
    raw = _counts(docs)
    share = target.sum() / raw.sum()
    ratio = np.log((target + prior) / (raw * share + prior))
    ratio = np.sign(ratio) * np.maximum(np.abs(ratio) - shrink / np.sqrt(raw * share + prior), 0)
    held = _weigh(sample.where("fold = 0"), spark.sparkContext.broadcast(ratio), ["good"]).toPandas()
    cut = 0.0
    if len(held):
        held["log_weight"] /= held.root.clip(lower=1)
        held = held.sort_values("log_weight")
        w, good = held.log_weight.to_numpy(), held.good.to_numpy()
        errors = CLEAN_COST * np.r_[0, np.cumsum(good)] + np.r_[np.cumsum(1 - good[::-1])[::-1], 0]
        best = np.flatnonzero(errors == errors.min())
        i = int(best[len(best) // 2])
        ends = np.r_[w[0] - 1, w, w[-1] + 1]
        cut = float((ends[i] + ends[i + 1]) / 2)
    return Model(ratio, cut)


def gumbel(*cols: str):
    """Gumbel noise by a keyed hash: the same for the same row, whenever a task runs again."""
    u = (F.pmod(F.xxhash64(F.lit(SEED + 2), *cols), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    return -F.log(-F.log(u))


def _edge(df: DataFrame, column: str, need: int) -> tuple[float, int]:
    """The ``need``-th largest value of a column, and how many rows lie above it; ``BINS`` rows at most reach the driver at once."""
    lo, hi, above, v = *df.agg(F.min(column), F.max(column)).first(), 0, F.col(column)
    while lo < hi:
        step = F.least(F.floor((v - F.lit(lo)) / F.lit((hi - lo) / BINS)), F.lit(BINS - 1))
        for r in sorted(df.where(v.between(lo, hi)).groupBy(step.alias("bin")).agg(F.count("*").alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).collect(), key=lambda r: -r.bin):
            if above + r.n >= need:
                lo, hi = r.lo, r.hi
                break
            above += r.n
    return lo, above


def _top_k(keyed: DataFrame, k: int | None) -> DataFrame:
    """``keyed`` with ``selected`` for exactly the ``k`` largest ``key``; of equal keys the first in the table's order.

    ``k`` None: as many as have a positive ``log_weight``.
    """
    rows = durable(keyed.withColumn("place", F.monotonically_increasing_id()))
    total = rows.count()
    k = rows.where("log_weight > 0").count() if k is None else k
    if not 0 < k < total:
        return rows.withColumn("selected", F.lit(k > 0)).drop("place")
    least, above = _edge(rows, "key", k)
    at = F.col("key") == least
    last = -_edge(rows.where(at).select((-F.col("place")).alias("back")), "back", k - above)[0]
    return rows.withColumn("selected", (F.col("key") > least) | (at & (F.col("place") <= last))).drop("place")


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, temperature: float = TEMPERATURE, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Per document: doc_id, log_weight (against the cut), key, selected, and ``_k`` (row key). ``k`` None: as many as weigh more than the cut."""
    spark = docs.sparkSession
    model = fit(docs, labels, fit_rows)
    rows = docs.select("doc_id", "text", row_key("doc_id", "text").alias("_k"))
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("log_weight"), gumbel("_k").alias("key"), F.lit(True).alias("selected"), "_k")
    weighed = _weigh(rows, spark.sparkContext.broadcast(model.ratio.astype(np.float64)), ["doc_id", "_k"])
    weight = F.col("log_weight") - model.cut * F.col("root")
    return _top_k(weighed.select("doc_id", weight.alias("log_weight"), (weight / temperature + gumbel("_k")).alias("key"), "_k"), k)


def keep_selected(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that :func:`resample` selects; of repeated rows all or none."""
    chosen = resample(docs, labels, **how).where("selected").select("_k").distinct()
    return unpacked(packed(docs, "doc_id", "text").join(chosen, "_k", "left_semi"), docs.columns)


def good_labels(labels: DataFrame) -> DataFrame:
    """Good: quality 1 and not toxic."""
    return labels.where("quality is not null or toxic is not null").select("doc_id", ((F.coalesce("quality", F.lit(1)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int").alias("good"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return resample(docs, good_labels(labels)).drop("_k")


QUERIES: dict[str, Callable] = {"op8_importance": query}
