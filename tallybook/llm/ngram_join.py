"""Similarity join of documents on the Jaccard similarity of their word n-grams.

MinHash signatures are cut into bands; band and row counts follow from the
threshold and the wanted recall (:func:`choose_bands`). Documents with the same
set of n-grams are one vertex, so exact copies cost one signature and no pairs.
Vertices are shuffled on band hashes. A bucket of up to ``SMALL`` vertices gives
its pairs; a larger one is dealt into size classes and blocks, every two blocks whose
sizes allow the similarity meet in a task of their own and are compared there as
matrices, which returns sums and a spanning forest instead of pairs. A pair counts
only in the bucket of its least common band hash, so every pair is verified once, on
the full sets.

A text of fewer than n words has one n-gram, all its words; one without words, or a
null one, links to nothing. Repeated rows count as copies. Null ids are kept: such
documents link as others do, and a class takes its name from its least known id.
Extra columns, whatever their names, are ignored or kept as they are. Texts of any
length are read whole, about a megabyte at a time or one text if it is longer. An
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._common import bloom_of, components, durable, packed, passes, row_key, small_batches, unpacked
from ._words import chunks, grams, mix, words

N = 5
THRESHOLD = 0.8
RECALL = 0.999
SMALL = 16
BLOCK = 512
SEED = 20_240_517


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = 64) -> tuple[int, int]:
    """``(bands, rows)``: the most rows whose bands, enough for ``recall`` at ``threshold``, need at most ``most`` hashes."""
    best = None
    for rows in range(1, most + 1):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - hit))
        if bands * rows <= most:
            best = (bands, rows)
    if best is None:
        raise ValueError("no band count reaches the recall within the hashes allowed")
    return best


def _sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of all rows, and the bounds of each row's part."""
    w = words(texts)
    h = w.hashes()
    g, at = grams(h, w.row, n)
    parts, rows = [g], [w.row[at]]
    for k in range(1, n):
        if (w.n_words == k).any():
            x, at = grams(h, w.row, k)
            short = w.n_words[w.row[at]] == k
            parts.append(x[short])
            rows.append(w.row[at][short])
    g, row = np.concatenate(parts), np.concatenate(rows)
    order = np.lexsort((g, row))
    g, row = g[order], row[order]
    if len(g):
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
        g, row = g[new], row[new]
    return g, np.searchsorted(row, np.arange(w.n_rows + 1))


def _ids(g: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Two 64-bit sums over each row's set; they name the set."""
    full = np.flatnonzero(np.diff(cut))
    out = np.zeros((len(cut) - 1, 2), np.uint64)
    if len(full):
        out[full, 0] = np.add.reduceat(g, cut[:-1][full])
        out[full, 1] = np.add.reduceat(mix(g ^ np.uint64(0xA5A5A5A55A5A5A5A)), cut[:-1][full])
    return out


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """Per document: doc_id, _k, sid (names its n-gram set), n_grams, bands."""
    rng = np.random.default_rng(SEED)
    a = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def sign(batches):
        for batch in batches:
            for c in chunks(batch):
                g, cut = _sets(c.column("text"), n)
                sid = _ids(g, cut)
                size = np.diff(cut)
                full = np.flatnonzero(size)
                keys = np.zeros((len(full), bands), np.uint64)
                if len(full):
                    for i in range(bands):
                        key = np.full(len(full), i + 1, np.uint64)
                        for j in range(i * rows, (i + 1) * rows):
                            key = mix(key ^ np.minimum.reduceat(g * a[j] + b[j], cut[:-1][full]))
                        keys[:, i] = key
                off = np.zeros(len(size) + 1, np.int32)
                np.cumsum((size > 0) * bands, out=off[1:])
                lists = pa.ListArray.from_arrays(pa.array(off), pa.array(keys.view(np.int64).ravel()))
                ids = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(size), [None, pa.py_buffer(sid.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([c.column("doc_id"), c.column("_k"), ids, pa.array(size, pa.int64()), lists], ["doc_id", "_k", "sid", "n_grams", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", row_key("doc_id", "text").alias("_k")).mapInArrow(sign, f"doc_id {kind}, _k string, sid binary, n_grams long, bands array<long>")


def _gram_sets(docs: DataFrame, n: int, wanted) -> DataFrame:
    """``sid, grams`` for documents whose set may be wanted (a Bloom filter decides)."""

    def run(batches):
        for batch in batches:
            for c in chunks(batch):
                g, cut = _sets(c.column("text"), n)
                sid = _ids(g, cut)
                pick = np.flatnonzero(passes(wanted.value, sid[:, 0]) & (np.diff(cut) > 0))
                seen = {sid[i].tobytes(): g[cut[i] : cut[i + 1]].tobytes() for i in pick}
                yield pa.RecordBatch.from_pydict({"sid": pa.array(list(seen), pa.binary()), "grams": pa.array(list(seen.values()), pa.binary())})

    return docs.select("text").mapInArrow(run, "sid binary, grams binary")


def _verify(pairs: DataFrame, threshold: float) -> DataFrame:
    """The rows of ``pairs(a, b, na, nb, ga, gb)`` whose sets are similar enough."""

    def run(batches):
        for t in batches:
            keep = []
            for x, y in zip(t.column("ga").to_pylist(), t.column("gb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                if len(x) < threshold * len(y) - 1e-9:
                    keep.append(False)
                    continue
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum())
                keep.append(both >= threshold * (len(x) + len(y) - both) - 1e-9)
            yield t.filter(pa.array(keep, pa.bool_())).select(["a", "b", "na", "nb"])

    return pairs.select("a", "b", "na", "nb", "ga", "gb").mapInArrow(run, "a binary, b binary, na long, nb long")


def _block(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links between (or within) blocks of one bucket: per vertex the copies it links to, and its component's first vertex."""
    pdf = pdf.sort_values("sid", ignore_index=True)
    key, n = pdf.h.iloc[0], len(pdf)
    sets = [np.frombuffer(x, np.uint64) for x in pdf.grams]
    size = np.array(list(map(len, sets)))
    flat, row = np.concatenate(sets), np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    start = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    count = np.diff(np.r_[start, len(flat)])
    group = np.repeat(np.arange(len(start)), count)
    shared = count[group] > 1
    row, group = row[shared], np.unique(group[shared], return_inverse=True)[1]
    both = np.zeros((n, n), np.float32)
    edges = np.searchsorted(group, np.arange(0, (group[-1] + 1 if len(group) else 0) + 4096, 4096))
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        if j > i:
            m = np.zeros((n, 4096), np.float32)
            m[row[i:j], group[i:j] - group[i]] = 1
            both += m @ m.T
    link = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-6
    np.fill_diagonal(link, False)
    blk = pdf.blk.to_numpy()
    if blk.min() != blk.max():
        link &= blk[:, None] != blk[None, :]
    bands = np.stack(pdf.bands.to_numpy())
    low = np.full((n, n), np.iinfo(np.int64).max)
    for b in range(bands.shape[1]):
        x = bands[:, b]
        same = x[:, None] == x[None, :]
        low = np.where(same, np.minimum(low, x[:, None]), low)
    link &= low == key
    weight = link @ pdf.n_docs.to_numpy()
    label = np.arange(n)
    while True:
        near = np.where(link, label[None, :], n).min(1)
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            break
        label = new
    out = pd.DataFrame({"sid": pdf.sid, "root": pdf.sid.to_numpy()[label], "w": weight.astype(np.int64)})
    return out[out.w > 0]


def _dealt(many: DataFrame, threshold: float) -> DataFrame:
    """The vertices of large buckets, once for every two blocks ``i, j`` in which they are compared.

    Sets of a similarity of ``threshold`` differ in size by that factor at most, so a
    bucket falls into size classes of which only the same and the next one meet, and
    these into blocks of about ``BLOCK`` vertices.
    """
    step = -math.log(threshold - 1e-9)
    many = many.withColumn("cls", F.floor(F.log("n_grams") / step).cast("long"))
    n = many.groupBy("h", "cls").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("nb"))
    other = n.select("h", F.col("cls").alias("ocls"), F.col("nb").alias("onb"))
    near = n.join(other, "h").where("abs(cls - ocls) <= 1")
    base = F.lit(1 << 32)
    dealt = many.join(near, ["h", "cls"]).withColumn("blk", F.col("cls") * base + F.pmod(F.xxhash64("sid"), "nb"))
    dealt = dealt.select("sid", "h", "n_docs", "bands", "blk", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("onb") - 1), lambda k: F.col("ocls") * base + k)).alias("o"))
    return dealt.withColumns({"i": F.least("blk", "o"), "j": F.greatest("blk", "o")}).drop("o")


def link_documents(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, copy_id, n_grams, and ``_k``.

    ``n_links`` counts the other documents of at least ``threshold``; ``copy_id`` is
    the least doc_id of those with the same n-gram set, ``class_id`` the least
    doc_id of the connected group of links.
    """
    return _linked(docs, n, threshold, recall).drop("label")


def _linked(docs: DataFrame, n: int, threshold: float, recall: float) -> DataFrame:
    """:func:`link_documents` and ``label``, which names the connected group whatever its ids; null without words."""
    spark = docs.sparkSession
    small_batches(spark)
    bands, rows = choose_bands(threshold, recall)
    sig = durable(signatures(docs, n, bands, rows))
    one = durable(sig.where("n_grams > 0").groupBy("sid").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("copy_id"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands")))
    flat = one.select("sid", F.explode("bands").alias("h"))
    full = flat.groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
    members = durable(flat.join(full, "h").select("sid", "h", "c").join(one.select("sid", "n_docs", "n_grams", "bands"), "sid"))
    wanted = members.select("sid").distinct()
    # the tasks look up the first eight bytes of sid, which are little-endian
    turned = F.concat(*(F.substring(F.hex("sid"), i, 2) for i in range(15, 0, -2)))
    bloom = spark.sparkContext.broadcast(bloom_of(wanted.select(F.conv(turned, 16, -10).cast("long").alias("h"))))
    sets = durable(_gram_sets(docs, n, bloom).join(wanted, "sid", "left_semi").groupBy("sid").agg(F.first("grams").alias("grams")))
    few = members.where(F.col("c") <= SMALL)
    x, y = (few.select("h", F.col("sid").alias(s), F.col("n_docs").alias(f"n{s}"), F.col("bands").alias(f"bands_{s}")) for s in "ab")
    pairs = x.join(y, "h").where("a < b").where("array_min(array_intersect(bands_a, bands_b)) = h").select("a", "b", "na", "nb")
    pairs = pairs.join(sets.select(F.col("sid").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("sid").alias("b"), F.col("grams").alias("gb")), "b")
    links = durable(_verify(pairs, threshold))
    blocks = durable(_dealt(members.where(F.col("c") > SMALL), threshold).join(sets, "sid").groupBy("h", "i", "j").applyInPandas(lambda pdf: _block(pdf, threshold), "sid binary, root binary, w long"))
    count = links.select(F.col("a").alias("sid"), F.col("nb").alias("w")).unionAll(links.select(F.col("b").alias("sid"), F.col("na").alias("w"))).unionAll(blocks.select("sid", "w")).groupBy("sid").agg(F.sum("w").alias("w"))
    label = components(links.select("a", "b").unionAll(blocks.select(F.col("sid").alias("a"), F.col("root").alias("b"))))
    vertex = one.select("sid", "n_docs", "copy_id").join(label.withColumnRenamed("v", "sid"), "sid", "left").join(count, "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    vertex = durable(vertex)
    least = vertex.groupBy("label").agg(F.min("copy_id").alias("class_id"))
    named = vertex.join(least, "label").select("sid", "label", "class_id", "copy_id", (F.coalesce("w", F.lit(0)) + F.col("n_docs") - 1).alias("n_links"))
    return sig.select("doc_id", "_k", "sid", "n_grams").join(named, "sid", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("copy_id", "doc_id").alias("copy_id"), "n_grams", "_k", "label")


def drop_near_copies(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each class: the one of the least doc_id, and of equal ones the least text key.

    Of repeated rows (equal id and text) one stays. Documents without words all stay,
    repeated ones too.
    """
    found = _linked(docs, n, threshold, RECALL)
    lead = found.where("n_grams > 0").groupBy("label").agg(F.min_by("_k", F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)), "_k")).alias("_k")).select("_k", F.lit(True).alias("one"))
    stay = lead.unionAll(found.where("n_grams = 0").select("_k", F.lit(False).alias("one"))).distinct()
    rows = packed(docs, "doc_id", "text").join(stay, "_k").withColumn("place", F.when(F.col("one"), -1).otherwise(F.monotonically_increasing_id()))
    return unpacked(rows.dropDuplicates(["_k", "place"]), docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("_k")


QUERIES: dict[str, Callable] = {"op5_ngram_join": query}
