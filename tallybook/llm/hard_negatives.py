"""Hard negatives for anchors by angular triangle filtering.

For every anchor the rows of its label that score highest are its positives, and for
each of these the highest-scoring rows of other labels whose score lies in a window
relative to the positive's are its hard negatives. A score is the inner product of two
integer vectors, each component the floor of ``SCALE`` times the given one.

Every row stores its norm and its angles to ``REFERENCES`` directions. By the triangle
inequality on the sphere the angle of two rows is at least the difference of their
angles to any direction and at most their sum (and 2 pi less the sum), which gives an
interval for the cosine and, times the two norms, for the score. It is widened by more
than rounding can amount to, so a pair outside the wanted scores is proven to be. Rows
lie in packs of ``BLOCK`` ordered by label, nearest direction and angle to it; anchors
in packs of ``ANCHORS`` by the same order. Whole packs are compared by the ranges of
their angles and norms first, then single rows; only pairs whose interval overlaps a
wanted window get the integer product. Two passes: positives at or above what the rows
near an anchor promise, then negatives within the windows of the positives found.

The directions are chosen, each farthest from those before, from at most ``SAMPLE`` rows
by a hash of their id; they steer the work and do not change the result, which is exact.
Anchors times rows are compared in packs; where angles tell little, as with vectors in
no particular direction, nearly all of them get the integer product.

Rows without an id, a label or a vector, or with a null or non-finite component take no
part, nor do those whose integer vector is longer than ``LONGEST``, as hundredths of a
score would leave 64 bits. A vector shorter than others counts as if zeros followed. Of equal scores the
smaller id comes first, of equal ids the row earlier in the table. Repeated rows are rows
of their own: an anchor may have its own copy as a positive. Extra columns are ignored.
An empty table, and one without anchors, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..operators.scans import numbered
from ._common import durable, small_batches

SCALE = 256
REFERENCES, SAMPLE = 8, 2048
BLOCK, ANCHORS = 8192, 1024
POSITIVES, NEGATIVES = 5, 3
#: A negative's score in hundredths of the positive's.
WINDOW = 50, 95
LONGEST = 2.0**27
#: More than the rounding of an angle in 32 bits and of its arc cosine, twice.
SLACK = 1e-5
#: Rows of anchors compared at once.
_AT_ONCE = 128
_NONE = np.iinfo(np.int64).min


def usable(vectors: DataFrame) -> DataFrame:
    """``rid, vec_id, label, v``: the rows that take part, numbered in the table's order."""
    x = vectors.select("vec_id", F.col("label").cast("long").alias("label"), F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE).cast("double")).alias("v"), "embedding")
    sound = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    short = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)) < LONGEST
    return x.where("vec_id is not null and label is not null and embedding is not null").where(sound & short).select(F.monotonically_increasing_id().alias("rid"), "vec_id", "label", "v")


def _matrix(lists, dim: int) -> np.ndarray:
    """Rows of a list column, zeros after the end of shorter ones."""
    size = np.array([len(v) for v in lists], np.int64)
    out = np.zeros((len(lists), dim))
    if len(lists):
        out[np.arange(dim)[None, :] < size[:, None]] = np.concatenate([np.asarray(v, np.float64) for v in lists])
    return out


def directions(rows: DataFrame, dim: int, n: int = REFERENCES, sample: int = SAMPLE) -> np.ndarray:
    """Unit vectors, each of a bounded sample's rows the one farthest from those before."""
    seen = rows.select("rid", "v", F.xxhash64("vec_id", F.lit(12)).alias("h")).orderBy("h", "rid").limit(sample).toPandas()
    x = _matrix(seen.v.tolist(), dim)
    x = x[np.linalg.norm(x, axis=1) > 0]
    if not len(x):
        return np.eye(1, max(dim, 1))[:, :dim]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    chosen, near = [0], x @ x[0]
    while len(chosen) < min(n, len(x)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    return x[chosen]


def angles(q: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms, and angles to every direction; a zero vector is at right angles to all."""
    norm = np.sqrt((q * q).sum(1))
    return norm, np.arccos(np.clip(q @ refs.T / np.maximum(norm, 1e-300)[:, None], -1, 1)).astype(np.float32)


def _indexed(rows: DataFrame, dim: int, refs: np.ndarray) -> DataFrame:
    """``rows`` with q (32-bit integers), norm, theta (angles), cell (nearest direction) and angle."""

    def run(batches):
        for b in batches:
            q = _matrix(b.column("v").to_numpy(zero_copy_only=False), dim)
            norm, theta = angles(q, refs)
            cell = theta.argmin(1) if len(q) else np.zeros(0, np.int64)
            packed = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (q.astype(np.int32), theta)]
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("vec_id"), b.column("label"), packed[0], pa.array(norm), packed[1], pa.array(cell, pa.int32()), pa.array(theta[np.arange(len(q)), cell], pa.float32())], ["rid", "vec_id", "label", "q", "norm", "theta", "cell", "angle"])

    return rows.mapInArrow(run, "rid long, vec_id long, label long, q binary, norm double, theta binary, cell int, angle float")


PACK = "n int, rid binary, vec_id binary, label binary, q binary, norm binary, theta binary, seed binary, ring array<struct<lo: double, hi: double>>, least double, most double, low long, high long, floor double"


def _packs(rows: DataFrame, size: int, name: str, dim: int, n_refs: int, seeds: bool) -> DataFrame:
    """Rows in packs of ``size`` by label, nearest direction and angle: the columns of :data:`PACK` and the pack's number ``name``."""
    order = ["label", "cell", "angle", "rid"]
    thin = numbered(rows.select("rid", "label", "cell", "angle"), [], order)
    placed = rows.join(thin.select("rid", F.floor((F.col("k") - 1) / size).cast("long").alias(name)), "rid")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rid")
        label, norm = pdf.label.to_numpy(), pdf.norm.to_numpy()
        theta = np.frombuffer(b"".join(pdf.theta), np.float32).reshape(len(pdf), n_refs)
        q = np.frombuffer(b"".join(pdf.q), np.int32).reshape(len(pdf), dim)
        seed = _seeds(pdf.vec_id.to_numpy(), label, q) if seeds else pdf.seed.to_numpy()
        cols = {"rid": pdf.rid.to_numpy(), "vec_id": pdf.vec_id.to_numpy(), "label": label, "q": q, "norm": norm, "theta": theta, "seed": seed}
        ring = [{"lo": float(a), "hi": float(b)} for a, b in zip(theta.min(0), theta.max(0), strict=True)]
        out = {name: int(pdf[name].iloc[0]), "n": len(pdf)} | {k: np.ascontiguousarray(v).tobytes() for k, v in cols.items()}
        return pd.DataFrame([out | {"ring": ring, "least": norm.min(), "most": norm.max(), "low": label.min(), "high": label.max(), "floor": float(seed.min())}])

    return placed.groupBy(name).applyInPandas(pack, f"{name} long, {PACK}")


def _seeds(vec_id: np.ndarray, label: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For the anchors of a pack a score that ``POSITIVES`` other rows of their label reach; the least number where the pack has fewer."""
    seed = np.full(len(q), _NONE)
    for of in np.unique(label[vec_id % 50 == 0]):
        rows = np.flatnonzero(label == of)
        if len(rows) > POSITIVES:
            at = np.flatnonzero(vec_id[rows] % 50 == 0)
            for i in range(0, len(at), _AT_ONCE):
                s = products(q[rows[at[i : i + _AT_ONCE]]], q[rows])
                s[np.arange(len(s)), at[i : i + _AT_ONCE]] = _NONE
                seed[rows[at[i : i + _AT_ONCE]]] = np.partition(s, -POSITIVES, axis=1)[:, -POSITIVES]
    return seed


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of ``a`` with all of ``b``; in floating point where that is exact."""
    top = lambda x: float(np.abs(x).max(initial=0))
    if top(a.astype(np.float64)) * top(b.astype(np.float64)) * max(a.shape[1], 1) < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def score_bounds(ta: np.ndarray, na: np.ndarray, tb: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score that the angles and norms of each two rows allow, rounded outwards."""
    near, far = np.zeros((len(ta), len(tb)), np.float32), np.full((len(ta), len(tb)), np.pi, np.float32)
    for i in range(ta.shape[1]):
        x, y = ta[:, i, None], tb[None, :, i]
        np.maximum(near, np.abs(x - y), out=near)
        both = x + y
        np.minimum(far, np.minimum(both, np.float32(2 * np.pi) - both), out=far)
    nn = na[:, None] * nb[None, :]
    high = nn * np.cos(np.maximum(near.astype(np.float64) - SLACK, 0))
    low = nn * np.cos(np.minimum(far.astype(np.float64) + SLACK, np.pi))
    give = nn * 1e-9 + 1e-6
    return low - give, high + give


def _overlap(least, most):
    """Of two packs a and b: whether a score between ``least`` and ``most`` is possible, by the ranges of their angles and norms."""
    gap = F.array_max(F.zip_with("a_ring", "b_ring", lambda x, y: F.greatest(x["lo"] - y["hi"], y["lo"] - x["hi"], F.lit(0.0))))
    far = F.array_min(F.zip_with("a_ring", "b_ring", lambda x, y: F.least(x["hi"] + y["hi"], F.lit(2 * np.pi) - x["lo"] - y["lo"])))
    up, down = F.cos(F.greatest(gap - SLACK, F.lit(0.0))), F.cos(F.least(F.greatest(far + SLACK, F.lit(0.0)), F.lit(np.pi)))
    big, small = F.col("a_most") * F.col("b_most"), F.col("a_least") * F.col("b_least")
    give = big * 1e-9 + 1e-6
    return (up * F.when(up > 0, big).otherwise(small) + give >= least) & (down * F.when(down > 0, small).otherwise(big) - give <= most)


def _meet(anchors: DataFrame, packs: DataFrame, where, brief: list[str], body: list[str]) -> DataFrame:
    """Pairs of an anchor pack and a row pack for which ``where`` holds, with the columns of both, prefixed.

    Packs are paired by their summaries, with the columns ``brief`` of the anchors; what
    they hold, with ``body``, is joined to the pairs that are left.
    """
    named = lambda df, p, cols: df.select(*(F.col(c).alias(f"{p}_{c}") for c in cols))
    short = ["ring", "least", "most", "low", "high"]
    each = F.sequence(F.lit(0).cast("long"), F.lit(max(anchors.count() - 1, 0)).cast("long"))
    met = named(packs, "b", ["b", *short]).withColumn("a_a", F.explode(each)).join(named(anchors, "a", ["a", *short, *brief]), "a_a")
    met = durable(met.where(where).select("a_a", "b_b"))
    full = ["n", "rid", "vec_id", "label", "q", "norm", "theta"]
    return met.join(named(anchors, "a", ["a", *full, *body]), "a_a").join(named(packs, "b", ["b", *full]), "b_b")


class _Side:
    """What one pack of a row of :func:`_meet` holds."""

    def __init__(self, row: dict, p: str, dim: int):
        n = row[f"{p}_n"]
        self.n = n
        self.rid, self.vec_id, self.label = (np.frombuffer(row[f"{p}_{c}"], np.int64) for c in ("rid", "vec_id", "label"))
        self.q = np.frombuffer(row[f"{p}_q"], np.int32).reshape(n, dim)
        self.norm = np.frombuffer(row[f"{p}_norm"], np.float64)
        self.theta = np.frombuffer(row[f"{p}_theta"], np.float32).reshape(n, -1)

    def order(self, cols: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Places of ``cols`` by falling score, then id, then row."""
        return np.lexsort((self.rid[cols], self.vec_id[cols], -score))


def _wanted(a: _Side, rows: np.ndarray, b: _Side, cols: np.ndarray, least: np.ndarray, most: np.ndarray):
    """Scores of ``rows`` by ``cols`` and which of them lie in their row's bounds; products only where the angles leave a pair."""
    low, high = score_bounds(a.theta[rows], a.norm[rows], b.theta[cols], b.norm[cols])
    open_ = (high >= least[:, None]) & (low <= most[:, None])
    r, c = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
    score = products(a.q[rows[r]], b.q[cols[c]])
    return r, c, score, open_[np.ix_(r, c)] & (score >= least[r, None]) & (score <= most[r, None])


def _best(a: _Side, b: _Side, seed: np.ndarray):
    """``slot, row, score``: for each anchor the first ``POSITIVES`` rows of its label that score its seed or more."""
    for label in np.unique(a.label):
        cols = np.flatnonzero(b.label == label)
        rows = np.flatnonzero(a.label == label)
        for i in range(0, len(rows) if len(cols) else 0, _AT_ONCE):
            part = rows[i : i + _AT_ONCE]
            most = np.full(len(part), np.iinfo(np.int64).max)
            r, c, score, ok = _wanted(a, part, b, cols, seed[part], most)
            ok &= a.rid[part[r], None] != b.rid[cols[c]][None, :]
            for k in np.flatnonzero(ok.any(1)):
                at = np.flatnonzero(ok[k])
                first = b.order(cols[c[at]], score[k, at])[:POSITIVES]
                for j in at[first]:
                    yield int(part[r[k]]), int(cols[c[j]]), int(score[k, j])


def windows(positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score of a negative for each positive score; an empty range below a negative one."""
    return -(-positive * WINDOW[0] // 100), positive * WINDOW[1] // 100


def _hard(a: _Side, b: _Side, positive: dict[int, list[tuple[int, int]]]):
    """``slot, place of the positive, row, score``: the first ``NEGATIVES`` rows of other labels in each positive's window."""
    slots = np.array(sorted(positive), np.int64)
    every = np.arange(b.n)
    for i in range(0, len(slots), _AT_ONCE):
        part = slots[i : i + _AT_ONCE]
        ranges = [windows(np.array([s for _, s in positive[int(p)]])) for p in part]
        least, most = np.array([lo.min() for lo, _ in ranges]), np.array([hi.max() for _, hi in ranges])
        r, c, score, ok = _wanted(a, part, b, every, least, most)
        ok &= a.label[part[r], None] != b.label[c][None, :]
        for k in np.flatnonzero(ok.any(1)):
            at = np.flatnonzero(ok[k])
            at = at[b.order(c[at], score[k, at])]
            falling = -score[k, at]
            for (place, _), lo, hi in zip(positive[int(part[r[k]])], *ranges[r[k]], strict=True):
                start = int(np.searchsorted(falling, -hi))
                for j in at[start : start + NEGATIVES]:
                    if score[k, j] >= lo:
                        yield int(part[r[k]]), place, int(c[j]), int(score[k, j])


def _table(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], [n for n, _ in schema])


def mine(vectors: DataFrame, block: int = BLOCK, anchors_at: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = durable(usable(vectors))
    dim = rows.agg(F.max(F.size("v"))).first()[0] or 0
    refs = directions(rows, dim)
    n_refs = len(refs)
    index = durable(_indexed(rows, dim, refs))
    packs = durable(_packs(index, block, "b", dim, n_refs, seeds=True))

    def seeds(batches):
        for batch in batches:
            for p in batch.to_pylist():
                vec_id, rid, seed = (np.frombuffer(p[c], np.int64) for c in ("vec_id", "rid", "seed"))
                of = vec_id % 50 == 0
                yield pa.RecordBatch.from_pydict({"rid": rid[of], "seed": seed[of]})

    seeded = packs.select("vec_id", "rid", "seed").mapInArrow(seeds, "rid long, seed long")
    anchors = durable(_packs(index.where("vec_id % 50 = 0").join(seeded, "rid"), anchors_at, "a", dim, n_refs, seeds=False))
    long = pa.int64()

    def find(batches):
        out = [("a", long), ("slot", long), ("anchor_id", long), ("rid", long), ("positive_id", long), ("score", long)]
        for batch in batches:
            for p in batch.to_pylist():
                a, b = _Side(p, "a", dim), _Side(p, "b", dim)
                got = [(p["a_a"], s, int(a.vec_id[s]), int(b.rid[j]), int(b.vec_id[j]), x) for s, j, x in _best(a, b, np.frombuffer(p["a_seed"], np.int64))]
                yield _table(got, out)

    def harden(batches):
        out = [("a", long), ("slot", long), ("place", long), ("rid", long), ("negative_id", long), ("negative_score", long)]
        for batch in batches:
            for p in batch.to_pylist():
                a, b = _Side(p, "a", dim), _Side(p, "b", dim)
                positive: dict[int, list[tuple[int, int]]] = {}
                for x in sorted(p["a_positives"], key=lambda x: (x["slot"], x["place"])):
                    positive.setdefault(x["slot"], []).append((x["place"], x["score"]))
                yield _table([(p["a_a"], s, k, int(b.rid[j]), int(b.vec_id[j]), x) for s, k, j, x in _hard(a, b, positive)], out)

    same = (F.col("a_low") <= F.col("b_high")) & (F.col("b_low") <= F.col("a_high"))
    met = _meet(anchors, packs, same & _overlap(F.col("a_floor"), F.lit(float("inf"))), ["floor"], ["seed"])
    found = met.mapInArrow(find, "a long, slot long, anchor_id long, rid long, positive_id long, score long")
    place = F.row_number().over(W.partitionBy("a", "slot").orderBy(F.desc("score"), "positive_id", "rid"))
    best = durable(found.withColumn("place", place).where(F.col("place") <= POSITIVES))
    known = best.groupBy("a").agg(F.collect_list(F.struct("slot", "place", "score")).alias("positives"), (F.min("score") * (WINDOW[0] / 100) - 1).alias("from"), (F.max("score") * (WINDOW[1] / 100) + 1).alias("to"))
    other = (F.col("a_low") < F.col("a_high")) | (F.col("b_low") < F.col("b_high")) | (F.col("a_low") != F.col("b_low"))
    met = _meet(durable(anchors.join(known, "a")), packs, other & _overlap(F.col("a_from"), F.col("a_to")), ["from", "to"], ["positives"])
    hard = met.mapInArrow(harden, "a long, slot long, place long, rid long, negative_id long, negative_score long")
    rank = F.row_number().over(W.partitionBy("a", "slot", "place").orderBy(F.desc("negative_score"), "negative_id", "rid"))
    hard = hard.withColumn("rank", rank).where(F.col("rank") <= NEGATIVES).drop("rid")
    named = best.select("a", "slot", F.col("place").cast("long").alias("place"), "anchor_id", "positive_id", F.col("score").alias("positive_score"))
    return hard.join(named, ["a", "slot", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the given vectors, the labels of every seventh id moved on by one."""
    x = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(x.withColumn("label", moved))


QUERIES: dict[str, Callable] = {"op12_hard_negatives": query}
ORACLES: dict[str, str] = {
    "op12_hard_negatives": """
WITH q AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
 FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.rid AS arid, a.vec_id AS anchor_id, b.rid AS brid, b.vec_id AS bid, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM q a JOIN q b ON a.vec_id % 50 = 0 AND a.rid <> b.rid),
p AS (SELECT *, row_number() OVER (PARTITION BY arid ORDER BY score DESC, bid, brid) AS place FROM s WHERE same QUALIFY place <= 5),
n AS (SELECT p.anchor_id, p.bid AS positive_id, row_number() OVER (PARTITION BY p.arid, p.brid ORDER BY s.score DESC, s.bid, s.brid) AS rank, s.bid AS negative_id, p.score AS positive_score, s.score AS negative_score
 FROM p JOIN s ON s.arid = p.arid AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
}
