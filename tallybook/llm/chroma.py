"""Chroma fingerprints of audio and the alignment of recordings.

Mono PCM is cut into overlapping frames, their spectra are folded to twelve pitch
classes, normalised and smoothed over time. An integral image over these frames
gives every rectangle sum by four look-ups; sixteen filters compare rectangle sums,
each quantised to two bits, and so every position becomes one packed 32-bit print.

A search takes some recordings as queries against all. Recordings with the same
prints are one class. Every print gives two keys: its upper and its lower half, each
with the same half of the next print that differs, so a run of silence is one place
and not many. Queries ask with all their keys; recordings are found by landmarks, the
keys whose hash is least among ``WINDOW`` in a row. A Bloom filter over the keys of the
queries drops the others. A recording has one row per key with all the places that key has;
these meet in a shuffled join, the places of a pair of recordings give the histogram of its
offsets, a vote for every landmark that the query has at that offset, and every offset with
``MIN_VOTES`` or more is verified by the bit errors of the overlapping prints. A match overlaps in
``MIN_OVERLAP`` prints or more and differs in ``MAX_ERROR`` of the bits or less; its
offset is that of the least share of wrong bits, then the longest overlap, the smallest
shift and the earlier start.

Null and empty media have no prints and match nothing. Shorter media than a frame
are padded with silence; recordings of fewer than ``MIN_OVERLAP`` prints match only
those with the same prints. Repeated rows are copies: they share a class. Null ids are
kept, and a class takes its name from its least known id. Extra columns, whatever their
names, are ignored. Media of any length are read whole, about a megabyte at a time or one
recording if it is longer. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._common import bloom_of, durable, passes, small_batches
from ._words import mix

RATE = 8000
FRAME, HOP = 256, 128
#: Lowest and highest frequency that counts.
BAND = (100.0, 3600.0)
SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25], np.float32)
#: Filters as (kind, first pitch class, pitch classes, frames).
FILTERS = (
    (0, 0, 3, 6), (0, 6, 4, 6), (1, 0, 4, 4), (1, 4, 6, 6), (1, 6, 6, 2), (2, 0, 6, 6), (2, 3, 4, 4), (2, 8, 4, 2),
    (3, 0, 8, 6), (3, 4, 8, 4), (3, 2, 6, 2), (4, 0, 9, 4), (4, 3, 9, 6), (5, 0, 5, 6), (5, 5, 5, 6), (5, 2, 9, 3),
)
WIDTH = max(f[3] for f in FILTERS)
#: The quartiles of each filter's log ratio over a sample of documents read as PCM, as :func:`levels_of` gives them.
LEVELS = (
    (-1.111, -1.065, -1.017), (-0.677, -0.631, -0.567), (-0.245, -0.173, -0.096), (0.114, 0.164, 0.215),
    (0.019, 0.087, 0.15), (-0.033, -0.0, 0.031), (-0.028, 0.004, 0.041), (-0.01, 0.003, 0.018),
    (-0.029, 0.0, 0.029), (-0.025, -0.001, 0.022), (-0.015, -0.0, 0.015), (-0.896, -0.845, -0.795),
    (-0.66, -0.611, -0.554), (-0.648, -0.628, -0.605), (-0.649, -0.631, -0.61), (-0.633, -0.629, -0.624),
)
#: The widest window with which over 0.9 of what all offsets would match is found: 0.93 of edited documents, 0.98 of noisy tunes.
WINDOW = 3
MIN_VOTES, MIN_OVERLAP, MAX_ERROR = 1, 8, 0.125
#: Differences of places that a histogram takes up at once.
VOTES = 1 << 20
CHUNK = 1 << 20


def _pitch_map() -> np.ndarray:
    """Spectrum bins to pitch classes, A4 = 440 Hz."""
    freq = np.fft.rfftfreq(FRAME, 1 / RATE)
    m = np.zeros((len(freq), 12), np.float32)
    for i, f in enumerate(freq):
        if BAND[0] <= f <= BAND[1]:
            m[i, int(round(12 * np.log2(f / 440.0))) % 12] = 1
    return m


_PITCH = _pitch_map()
_HANN = np.hanning(FRAME).astype(np.float32)


def frames_of(samples: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chroma frames of all recordings that lie in ``samples`` between the offsets, and the first frame of each.

    A recording has enough frames for one print at least.
    """
    n = np.diff(off)
    count = np.where(n > 0, np.maximum(-(-(n - FRAME) // HOP) + 1, WIDTH), 0)
    first = np.r_[0, np.cumsum(count)]
    rec = np.repeat(np.arange(len(n)), count)
    start = (np.arange(first[-1]) - first[:-1][rec]) * HOP
    chroma = np.zeros((int(first[-1]), 12), np.float32)
    for i in range(0, len(rec), 8192):
        j = min(i + 8192, len(rec))
        at = start[i:j, None] + np.arange(FRAME)
        inside = at < n[rec[i:j], None]
        x = np.where(inside, samples[np.minimum(off[rec[i:j], None] + at, len(samples) - 1)], 0).astype(np.float32)
        chroma[i:j] = np.abs(np.fft.rfft(x * _HANN, axis=1)).astype(np.float32) @ _PITCH
    chroma /= np.sqrt((chroma**2).sum(1, keepdims=True)) + 1e-6
    smooth = np.zeros_like(chroma)
    half = len(SMOOTH) // 2
    for k, c in enumerate(SMOOTH):
        d = k - half
        src = np.arange(len(chroma)) + d
        ok = (src >= first[:-1][rec]) & (src < first[1:][rec])
        smooth[ok] += c * chroma[src[ok]]
    return smooth, first


def _ratios(chroma: np.ndarray, first: np.ndarray) -> tuple[Iterator[np.ndarray], np.ndarray]:
    """The log ratio of every filter in turn at all places of all recordings, and the first place of each."""
    area = np.zeros((len(chroma) + 1, 13), np.float64)
    np.cumsum(np.cumsum(chroma, 0, dtype=np.float64), 1, out=area[1:, 1:])
    count = np.maximum(np.diff(first) - WIDTH + 1, 0)
    cut = np.r_[0, np.cumsum(count)]
    rec = np.repeat(np.arange(len(count)), count)
    t = first[:-1][rec] + np.arange(cut[-1]) - cut[:-1][rec]

    def box(x: np.ndarray, y: int, w: int, h: int) -> np.ndarray:
        return area[x + w, y + h] - area[x, y + h] - area[x + w, y] + area[x, y]

    def ratio(kind: int, y: int, h: int, w: int) -> np.ndarray:
        h2, w2, h3, w3 = h // 2, w // 2, h // 3, w // 3
        y = min(y, 12 - h)
        if kind == 0:
            a, b = box(t, y, w, h), box(t, 0, w, 12) - box(t, y, w, h)
        elif kind == 1:
            a, b = box(t, y + h2, w, h - h2), box(t, y, w, h2)
        elif kind == 2:
            a, b = box(t + w2, y, w - w2, h), box(t, y, w2, h)
        elif kind == 3:
            a = box(t, y + h2, w2, h - h2) + box(t + w2, y, w - w2, h2)
            b = box(t, y, w2, h2) + box(t + w2, y + h2, w - w2, h - h2)
        elif kind == 4:
            a = box(t, y + h3, w, h3)
            b = box(t, y, w, h3) + box(t, y + 2 * h3, w, h - 2 * h3)
        else:
            a = box(t + w3, y, w3, h)
            b = box(t, y, w3, h) + box(t + 2 * w3, y, w - 2 * w3, h)
        return np.log((1 + np.maximum(a, 0)) / (1 + np.maximum(b, 0)))

    return (ratio(*f) for f in FILTERS), cut


def prints_of(chroma: np.ndarray, first: np.ndarray, levels=LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """Packed prints of all recordings, and the first print of each."""
    ratios, cut = _ratios(chroma, first)
    out = np.zeros(cut[-1], np.uint32)
    for v, (low, mid, high) in zip(ratios, levels, strict=True):
        level = (v > low).astype(np.uint32) + (v > mid) + (v > high)
        out = (out << np.uint32(2)) | (level ^ (level >> 1)).astype(np.uint32)
    return out, cut


def levels_of(media: list[bytes]) -> tuple:
    """Levels for :func:`fingerprints` from a sample of recordings: the quartiles of each filter's log ratio."""
    raw = np.frombuffer(b"".join(media), np.uint8)
    chroma, first = frames_of((raw.astype(np.float32) - 128) / 128, np.r_[0, np.cumsum([len(m) for m in media])])
    return tuple(tuple(np.percentile(v, (25, 50, 75)).round(3).tolist()) for v in _ratios(chroma, first)[0])


def _media_chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    size = pc.fill_null(pc.binary_length(batch.column("media")), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, s in enumerate(size):
        if i > start and total + s > CHUNK:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += s
    if batch.num_rows > start:
        yield batch.slice(start)


def fingerprints(media: DataFrame, levels=LEVELS) -> DataFrame:
    """``rec_id, prints, n_frames`` for ``media(rec_id, media)``: unsigned 8-bit mono PCM at ``RATE``."""
    small_batches(media.sparkSession)

    def run(batches):
        for b in batches:
            for c in _media_chunks(b):
                m = pc.fill_null(c.column("media").cast(pa.large_binary()), b"")
                off = np.frombuffer(m.buffers()[1], np.int64)[m.offset : m.offset + len(m) + 1]
                data = m.buffers()[2]
                raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
                samples = (raw.astype(np.float32) - 128) / 128 if len(raw) else np.zeros(1, np.float32)
                chroma, first = frames_of(samples, off - off[0])
                prints, cut = prints_of(chroma, first, levels)
                lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(prints.view(np.int32)))
                yield pa.RecordBatch.from_arrays([c.column("rec_id"), lists, pa.array(np.diff(first), pa.int64())], ["rec_id", "prints", "n_frames"])

    kind = media.schema["rec_id"].dataType.simpleString()
    return media.select("rec_id", "media").mapInArrow(run, f"rec_id {kind}, prints array<int>, n_frames long")


def places_and_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal prints of a recording begin, and the two keys of each, one after the other."""
    p = prints.view(np.uint32).astype(np.uint64)
    at = np.flatnonzero(np.r_[True, p[1:] != p[:-1]]) if len(p) else np.zeros(0, int)
    if len(at) > 1:
        here, after, at = p[at[:-1]], p[at[1:]], at[:-1]
    else:
        here, after = p[at], p[at]
    half = np.uint64(0xFFFF)
    keys = [mix(((here >> s & half) << np.uint64(16) | after >> s & half) + (s << np.uint64(32))) for s in (np.uint64(0), np.uint64(16))]
    return np.tile(at, 2), np.concatenate(keys).view(np.int64)


def landmarks(at: np.ndarray, key: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which of the places and keys of :func:`places_and_keys` are least among ``window`` keys of their half."""
    out = np.zeros(len(key), bool)
    for half, k in enumerate(np.split(mix(key.view(np.uint64)), 2)):
        if len(k):
            runs = np.lib.stride_tricks.sliding_window_view(k, min(window, len(k)))
            out[runs.argmin(1) + np.arange(len(runs)) + half * len(k)] = True
    return out


def _marks(rows: DataFrame, only=None) -> DataFrame:
    """``fid, key, at``: every key of a recording once, with all its places; with a Bloom filter ``only``, of the landmarks that it lets through."""

    def run(batches):
        for b in batches:
            fid, keys, places, sizes = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
            for f, p in zip(b.column("fid").to_pylist(), b.column("prints"), strict=True):
                at, k = places_and_keys(p.values.to_numpy(zero_copy_only=False))
                if only is not None:
                    ok = landmarks(at, k) & passes(only.value, k.view(np.uint64))
                    at, k = at[ok], k[ok]
                order = np.argsort(k, kind="stable")
                each, n = np.unique(k, return_counts=True)
                fid += [f] * len(each)
                keys.append(each)
                places.append(at[order])
                sizes.append(n)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)), pa.int32()), pa.array(np.concatenate(places), pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(fid, pa.binary()), pa.array(np.concatenate(keys), pa.int64()), lists], ["fid", "key", "at"])

    return rows.select("fid", "prints").mapInArrow(run, "fid binary, key long, at array<int>")


def offset_votes(hits: list[tuple[list[int], list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """The histogram of a pair: offsets, ascending, and how many pairs of places vote for each.

    ``hits`` are the places of each common key in the one and in the other recording.
    At most ``VOTES`` differences, or one place's, are held besides the histogram.
    """
    shifts, votes, wait, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
    blocks = ((np.array(x[i : i + step]), np.array(y)) for x, y in hits for step in [max(1, VOTES // max(len(y), 1))] for i in range(0, len(x), step))
    for x, y in blocks:
        wait.append(np.subtract.outer(x, y).ravel())
        size += len(wait[-1])
        if size >= VOTES:
            shifts, votes = _counted(shifts, votes, wait)
            wait, size = [], 0
    return _counted(shifts, votes, wait)


def _counted(shifts: np.ndarray, votes: np.ndarray, more: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every = np.concatenate([shifts, *more])
    out, which = np.unique(every, return_inverse=True)
    n = np.bincount(which, minlength=len(out))
    n[which[: len(shifts)]] += votes - 1
    return out, n


def bit_errors(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, int]:
    """``(overlap, errors)``: prints that overlap when b starts ``offset`` prints into a, and the bits in which they differ."""
    i, j = max(offset, 0), max(-offset, 0)
    n = min(len(a) - i, len(b) - j)
    if n <= 0:
        return 0, 0
    return n, int(np.bitwise_count((a[i : i + n] ^ b[j : j + n]).view(np.uint32)).sum())


def best_offset(a: np.ndarray, b: np.ndarray, offsets: list[int], min_overlap: int = MIN_OVERLAP) -> tuple[int, int, int] | None:
    """``(offset, overlap, errors)`` of the best of the offsets, if any overlaps enough."""
    found = [(*bit_errors(a, b, o), o) for o in offsets]
    found = [(e / n, -n, abs(o), o, e) for n, e, o in found if n >= min_overlap]
    if not found:
        return None
    _, n, _, o, e = min(found)
    return o, -n, e


_MATCH = pa.schema([("qf", pa.binary()), ("df", pa.binary()), ("shift", pa.int32()), ("votes", pa.int64()), ("overlap", pa.int64()), ("errors", pa.int64())])


def _verify(pairs: DataFrame, min_votes: int, max_error: float, min_overlap: int) -> DataFrame:
    """The best offset of every pair among those with enough votes; ``hits`` are the places of the common keys."""

    def run(batches):
        for b in batches:
            out = []
            for qf, df, hits, x, y in zip(b.column("qf").to_pylist(), b.column("df").to_pylist(), b.column("hits"), b.column("pa"), b.column("pb"), strict=True):
                shifts, n = offset_votes([(h["qp"], h["dp"]) for h in hits.as_py()])
                votes = dict(zip(shifts[n >= min_votes].tolist(), n[n >= min_votes].tolist(), strict=True))
                got = best_offset(*(v.values.to_numpy(zero_copy_only=False) for v in (x, y)), list(votes), min_overlap)
                if got and got[2] <= max_error * 32 * got[1]:
                    out.append((qf, df, got[0], votes[got[0]], got[1], got[2]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * len(_MATCH), _MATCH, strict=True)], schema=_MATCH)

    return pairs.select("qf", "df", "hits", "pa", "pb").mapInArrow(run, "qf binary, df binary, shift int, votes long, overlap long, errors long")


def align(prints: DataFrame, is_query, min_votes: int = MIN_VOTES, max_error: float = MAX_ERROR, min_overlap: int = MIN_OVERLAP) -> DataFrame:
    """Matches of the query recordings among all, between classes: query_class, match_class, n_copies, shift, votes, overlap, errors.

    A class is the recordings of equal prints, named by its least rec_id, ``n_copies``
    its size; a class with other members matches itself. :func:`classes` has the
    members. ``shift`` is the number of prints by which the match starts later within
    the query, ``votes`` the number of landmarks of the match that the query has there;
    offsets of fewer than ``min_votes`` are not looked at.
    """
    rows = durable(classes(prints))
    one = durable(rows.groupBy("fid").agg(F.first("class_id").alias("match_class"), F.count("*").alias("n_copies"), F.first("prints").alias("prints")))
    wanted = one.join(rows.where(is_query).select("fid").distinct(), "fid", "left_semi")
    q = durable(_marks(wanted.where(F.size("prints") >= min_overlap)))
    bloom = prints.sparkSession.sparkContext.broadcast(bloom_of(q.select(F.col("key").alias("h")).distinct()))
    d = _marks(one.where(F.size("prints") >= min_overlap), bloom)
    q = q.withColumnsRenamed({"fid": "qf", "at": "qp"})
    d = d.withColumnsRenamed({"fid": "df", "at": "dp"})
    hits = q.join(d, "key").where(F.col("qf") != F.col("df"))
    pairs = hits.groupBy("qf", "df").agg(F.collect_list(F.struct("qp", "dp")).alias("hits"))
    pairs = pairs.join(one.select(F.col("fid").alias("qf"), F.col("prints").alias("pa")), "qf").join(one.select(F.col("fid").alias("df"), F.col("prints").alias("pb")), "df")
    size = F.size("prints").cast("long")
    own = wanted.where("n_copies > 1").select(F.col("fid").alias("qf"), F.col("fid").alias("df"), F.lit(0).alias("shift"), size.alias("votes"), size.alias("overlap"), F.lit(0).cast("long").alias("errors"))
    named = one.select("fid", "match_class", "n_copies")
    return (
        _verify(pairs, min_votes, max_error, min_overlap).unionAll(own)
        .join(named.select(F.col("fid").alias("qf"), F.col("match_class").alias("query_class")), "qf")
        .join(named.withColumnRenamed("fid", "df"), "df")
        .select("query_class", "match_class", "n_copies", "shift", "votes", "overlap", "errors", F.col("qf").alias("fid"))
    )


def _print_key():
    """The 128-bit key of a recording's prints."""
    return F.unhex(F.md5(F.concat_ws(",", F.col("prints").cast("array<string>"))))


def classes(prints: DataFrame) -> DataFrame:
    """``rec_id, fid, class_id, prints``: the recordings that have prints, with the key of their prints and the least id that shares it."""
    rows = prints.where(F.size("prints") > 0).select("rec_id", "prints", _print_key().alias("fid"))
    least = rows.groupBy("fid").agg(F.min("rec_id").alias("class_id"))
    return rows.join(least, "fid").select("rec_id", "fid", "class_id", "prints")


def search(prints: DataFrame, is_query) -> DataFrame:
    """One row per query recording: query_id, n_frames, class_id, n_matches (classes), n_recordings (their members, itself among them), best_class with its shift, overlap and errors, and matches_xor.

    The best match has the least share of wrong bits, then the longest overlap, then the
    least id. ``matches_xor`` digests the links of :func:`align`, which are as many as
    there are and so not listed in a row.
    """
    prints = durable(prints)
    members = prints.where(is_query).withColumn("fid", _print_key()).select("rec_id", "n_frames", F.when(F.size("prints") > 0, F.col("fid")).alias("fid"))
    found = align(prints, is_query)
    order = F.struct((F.col("errors") / F.col("overlap")).alias("e"), (-F.col("overlap")).alias("o"), F.col("match_class").alias("m"))
    sums = found.groupBy("fid").agg(
        F.first("query_class").alias("class_id"), F.count("*").alias("n_matches"), F.sum("n_copies").alias("n_recordings"),
        F.min(F.struct(order.alias("order"), "shift", "overlap", "errors")).alias("best"), F.bit_xor(F.xxhash64("match_class", "shift", "overlap", "errors")).alias("matches_xor"),
    )
    x = members.join(sums, "fid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return x.select(F.col("rec_id").alias("query_id"), "n_frames", F.coalesce("class_id", "rec_id").alias("class_id"), zero("n_matches"), zero("n_recordings"), F.col("best.order.m").alias("best_class"), F.col("best.shift").alias("shift"), F.col("best.overlap").alias("overlap"), F.col("best.errors").alias("errors"), zero("matches_xor"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no audio: each document's bytes are read as 8-bit PCM, so copies are recordings of the same.

    One row per query recording; :func:`align` has the links.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    prints = fingerprints(docs.select(F.col("doc_id").alias("rec_id"), F.col("text").cast("binary").alias("media")))
    return search(prints, F.pmod("rec_id", F.lit(50)) == 0)


QUERIES: dict[str, Callable] = {"op1_chroma": query}
