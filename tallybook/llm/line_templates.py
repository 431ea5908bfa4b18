"""Line dedup by a log-template tree.

The tree has a fixed depth: a line's number of tokens, then its leading tokens;
tokens with digits stand for ``<*>`` from the start. In a leaf, lines whose tokens
agree in at least ``similarity`` of the positions share a template; where they
differ it has ``<*>``. A template found in at least ``min_docs`` distinct documents,
or ``LONG_DOCS`` where its lines have more than ``LONG`` tokens, recurs: its lines are
dropped from all documents but the first by doc_id.

Lines are reduced to hashes before anything is shuffled and to one row per distinct
line before they meet. Whatever the size of a leaf, a line joins the most frequent
line (of equal ones that of the least hash) it is like, itself included; the lines
that join the same one are a template. Candidates are the lines that share a key, by
exact runs of tokens. No task holds a leaf: groups of more than ``PART`` lines are
compared in cells, which does not change the result.

Lines of fewer than ``min_tokens`` tokens are kept: they recur by chance. Tokens are
compared by four bytes of their hashes, so unlike ones agree once in four billion; equal
lines by eight. A null text stays null and has no lines. Repeated rows (equal id and
text) are one document and get the same result. Ids are integers; documents without one
come last, and of documents with the same first id all keep their lines. A document whose
lines all go has an empty text. Extra columns, whatever their names, are kept. Texts of
any length are read whole, about a megabyte at a time or one text if it is longer. An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._common import bloom_of, durable, packed, passes, row_key, small_batches, split_join, unpacked
from ._words import _power, chunks, mix

LEADING = 3
MIN_TOKENS = 4
MIN_DOCS = 3
#: Lines of more tokens than this do not recur by chance: a second document is enough.
LONG, LONG_DOCS = 50, 2
SIMILARITY = 0.8
#: Lines on either side of what is compared in one step; the result does not depend on it.
PART = 256
#: Lines are compared by so much of each token's hash.
_TOKEN = np.dtype(np.uint32)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MASK = np.uint64(0x3C2A3E)


def _lines(texts: pa.Array, leading: int, min_tokens: int):
    """Per line of at least ``min_tokens`` tokens: row, line number, leaf, line hash, first and last token; and the hash of each token."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    off = off - off[0]
    n = len(buf)
    on = np.zeros(n + 2, bool)
    on[1:-1] = ~_BLANK[buf]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    lo = np.flatnonzero(on[1:-1] & (~on[:-2] | cut[:-1]))
    hi = np.flatnonzero(on[1:-1] & (~on[2:] | cut[1:])) + 1
    up, down = _power(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    h = mix((total[hi] - total[lo]) * down[lo] + (hi - lo).astype(np.uint64))
    digits = np.zeros(n + 1, np.int64)
    np.cumsum(_DIGIT[buf], out=digits[1:])
    h[digits[hi] > digits[lo]] = _MASK
    breaks = np.flatnonzero(buf == 10)
    row = np.searchsorted(off, lo, "right") - 1
    line = np.searchsorted(breaks, lo)
    line -= np.searchsorted(breaks, off[:-1])[row] if len(row) else 0
    new = np.ones(len(lo), bool)
    new[1:] = (row[1:] != row[:-1]) | (line[1:] != line[:-1])
    a = np.flatnonzero(new)
    b = np.r_[a[1:], len(lo)].astype(np.int64) if len(a) else a
    ok = b - a >= max(min_tokens, leading)
    a, b = a[ok], b[ok]
    up, down = _power(len(h) + 1)
    run = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=run[1:])
    whole = mix((run[b] - run[a]) * down[a] + (b - a).astype(np.uint64))
    leaf = mix((b - a).astype(np.uint64))
    for j in range(leading):
        leaf = mix(leaf ^ h[a + j])
    return row[a], line[a], leaf, whole, a, b, h


def _keys(h: np.ndarray, a: np.ndarray, b: np.ndarray, leading: int, similarity: float) -> pa.ListArray:
    """Keys of each line ``h[a:b]``, of which lines that are like share one at least.

    Like lines differ in ``d`` tokens at most, so of ``d + 1`` runs of the tokens behind
    the leading ones one is equal. Lines that may not differ at all have no key.
    """
    size = b - a
    d = size - np.ceil(similarity * size - 1e-9).astype(np.int64)
    count = np.where(d > 0, d + 1, 0)
    end = np.cumsum(count)
    at = np.repeat(np.arange(len(a)), count)
    k = np.arange(len(at)) - np.repeat(end - count, count)
    rest = size[at] - leading
    lo = a[at] + leading + k * rest // count[at]
    hi = a[at] + leading + (k + 1) * rest // count[at]
    up, down = _power(len(h) + 1)
    run = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=run[1:])
    # empty runs, of lines with fewer tokens than runs, are equal whatever their place
    place = np.where(hi > lo, k + 1, 0).astype(np.uint64)
    key = mix((run[hi] - run[lo]) * down[lo] + place * np.uint64(0xD6E8FEB86659FD93))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, end].astype(np.int32)), pa.array((key >> np.uint64(32)).astype(np.uint32).view(np.int32)))


def line_table(docs: DataFrame, leading: int = LEADING, min_tokens: int = MIN_TOKENS, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document and distinct line: doc_id, _k, leaf, line, size, keys, nos (its line numbers from 0)."""

    def run(batches):
        for batch in batches:
            for c in chunks(batch):
                row, no, leaf, whole, a, b, h = _lines(c.column("text"), leading, min_tokens)
                order = np.lexsort((no, whole, row))
                row, no, leaf, whole, a, b = (x[order] for x in (row, no, leaf, whole, a, b))
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (whole[1:] != whole[:-1])
                at = np.flatnonzero(new)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[at, len(row)].astype(np.int32)), pa.array(no.astype(np.int32)))
                keys = _keys(h, a[at], b[at], leading, similarity)
                pick = pa.array(row[at])
                yield pa.RecordBatch.from_arrays([c.column("doc_id").take(pick), c.column("_k").take(pick), pa.array(leaf[at].view(np.int64)), pa.array(whole[at].view(np.int64)), pa.array((b - a)[at].astype(np.int32)), keys, lists], ["doc_id", "_k", "leaf", "line", "size", "keys", "nos"])

    src = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("doc_id"), "text", row_key("doc_id", "text").alias("_k"))
    return src.mapInArrow(run, "doc_id long, _k string, leaf long, line long, size int, keys array<int>, nos array<int>")


def _tokens(docs: DataFrame, leading: int, min_tokens: int, only) -> DataFrame:
    """``leaf, line, toks`` (the token hashes) of the lines that the Bloom filter ``only`` lets through."""

    def run(batches):
        for batch in batches:
            for c in chunks(batch):
                _, _, leaf, whole, a, b, h = _lines(c.column("text"), leading, min_tokens)
                at = np.flatnonzero(passes(only.value, whole))
                at = at[np.unique(whole[at], return_index=True)[1]]
                short = (h >> np.uint64(64 - 8 * _TOKEN.itemsize)).astype(_TOKEN)
                toks = pa.array([short[i:j].tobytes() for i, j in zip(a[at].tolist(), b[at].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(leaf[at].view(np.int64)), pa.array(whole[at].view(np.int64)), toks], ["leaf", "line", "toks"])

    return docs.select("text").mapInArrow(run, "leaf long, line long, toks binary")


def _compared(rows: DataFrame, similarity: float) -> DataFrame:
    """``alike`` for rows ``leaf, line, best, n_best, ta, tb``: do the tokens agree in enough positions?"""

    def run(batches):
        for b in batches:
            a, o = (np.frombuffer(b"".join(b.column(c).to_pylist()), _TOKEN) for c in ("ta", "tb"))
            size = pc.binary_length(b.column("ta")).to_numpy(zero_copy_only=False).astype(np.int64) // _TOKEN.itemsize
            same = np.add.reduceat((a == o).astype(np.int64), np.r_[0, np.cumsum(size)[:-1]]) if len(size) else size
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("leaf", "line", "best", "n_best")), pa.array(same >= similarity * size - 1e-9)], ["leaf", "line", "best", "n_best", "alike"])

    return rows.select("leaf", "line", "best", "n_best", "ta", "tb").mapInArrow(run, "leaf long, line long, best long, n_best long, alike boolean")


def first_alike(seek: np.ndarray, among: np.ndarray, similarity: float) -> np.ndarray:
    """For each line of ``seek`` the first line of ``among`` it is like, else -1 (matrices, one row per line)."""
    out = np.full(len(seek), -1)
    left = np.arange(len(seek))
    for k in range(len(among)):
        if not len(left):
            break
        like = (seek[left] == among[k]).mean(1) >= similarity - 1e-9
        out[left[like]] = k
        left = left[~like]
    return out


def _sought(rows: DataFrame, similarity: float) -> DataFrame:
    """``leaf, line, best, n_best`` from rows ``leaf, key, i, j, seek, line, n, toks``: what each seeker of a cell finds among the cell's other rows."""
    keys = ("leaf", "key", "i", "j")

    def work(t: pa.Table):
        change = np.zeros(t.num_rows - 1, bool)
        for k in keys:
            v = t.column(k).to_numpy()
            change |= v[1:] != v[:-1]
        cut = np.flatnonzero(np.r_[True, change, True])
        leaf, line, n = (t.column(k).to_numpy() for k in ("leaf", "line", "n"))
        seek, toks = t.column("seek").to_numpy(), t.column("toks").to_pylist()
        found = []
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            m = np.frombuffer(b"".join(toks[i:j]), _TOKEN).reshape(j - i, -1)
            s, c = np.flatnonzero(seek[i:j]), np.flatnonzero(~seek[i:j])
            c = c[np.lexsort((line[i:j][c], -n[i:j][c]))]
            at = first_alike(m[s], m[c], similarity)
            found.append(np.stack([s[at >= 0] + i, c[at[at >= 0]] + i]))
        a, b = np.concatenate(found, 1)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (leaf[a], line[a], line[b], n[b])], ["leaf", "line", "best", "n_best"])

    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            other = np.zeros(t.num_rows, bool)
            for k in keys:
                v = t.column(k).to_numpy()
                other |= v != v[-1] if len(v) else other
            last = np.flatnonzero(other)
            done = int(last[-1]) + 1 if len(last) else 0
            if done:
                yield work(t.slice(0, done).combine_chunks())
            held = t.slice(done)
        if held is not None and held.num_rows:
            yield work(held.combine_chunks())

    cells = rows.select(*keys, "seek", "line", "n", "toks").repartition(*keys).sortWithinPartitions(*keys, "line")
    return cells.mapInArrow(run, "leaf long, line long, best long, n_best long")


def templates(docs: DataFrame, distinct: DataFrame, leading: int, min_tokens: int, similarity: float) -> DataFrame:
    """``leaf, line, tpl`` for the lines that join another: the most frequent line (then the least hash) they are like.

    Lines that are like share a key. In each group of a key all are held against its
    most frequent line; those unlike it seek among the others, at most ``PART`` by
    ``PART`` in a cell.
    """
    spark = docs.sparkSession
    several = distinct.groupBy("leaf").agg(F.count("*").alias("kinds")).where("kinds > 1").select("leaf")
    flat = distinct.where(F.size("keys") > 0).join(several, "leaf").select("leaf", "line", "n", F.explode("keys").alias("key"))
    groups = flat.groupBy("leaf", "key").agg(F.count("*").alias("c"), F.min(F.struct((-F.col("n")).alias("m"), F.col("line").alias("best"))).alias("b")).where("c > 1")
    groups = groups.select("leaf", "key", "c", "b.best", (-F.col("b.m")).alias("n_best"))
    members = durable(flat.join(groups, ["leaf", "key"]))
    bloom = spark.sparkContext.broadcast(bloom_of(members.select(F.col("line").alias("h")).distinct()))
    wanted = members.select("leaf", "line").distinct()
    toks = durable(_tokens(docs, leading, min_tokens, bloom).join(wanted, ["leaf", "line"], "left_semi").groupBy("leaf", "line").agg(F.first("toks").alias("toks")))
    pairs = members.where("line <> best").select("leaf", "line", "best", "n_best").distinct()
    pairs = pairs.join(toks.select("leaf", "line", F.col("toks").alias("ta")), ["leaf", "line"]).join(toks.select("leaf", F.col("line").alias("best"), F.col("toks").alias("tb")), ["leaf", "best"])
    held = durable(_compared(pairs, similarity))
    seek = durable(members.where("line <> best and c > 2").join(held.where("not alike").select("leaf", "line", "best"), ["leaf", "line", "best"]).select("leaf", "key", "line", "n", "c"))
    seekers = seek.groupBy("leaf", "key").agg(F.count("*").alias("s"))
    parts = lambda c: F.ceil(F.col(c) / PART).cast("int")
    among = members.join(seekers, ["leaf", "key"]).select("leaf", "key", F.pmod("line", parts("c")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), parts("s") - 1)).alias("j"), F.lit(False).alias("seek"), "line", "n")
    own = seek.join(seekers, ["leaf", "key"]).select("leaf", "key", F.explode(F.sequence(F.lit(0), parts("c") - 1)).alias("i"), F.pmod("line", parts("s")).cast("int").alias("j"), F.lit(True).alias("seek"), "line", "n")
    found = _sought(among.unionAll(own).join(toks, ["leaf", "line"]), similarity)
    picks = held.where("alike").select("leaf", "line", "best", "n_best").unionAll(found)
    picks = picks.groupBy("leaf", "line").agg(F.min(F.struct((-F.col("n_best")).alias("m"), F.col("best").alias("line"))).alias("p"))
    before = F.col("p") < F.struct((-F.col("n")).alias("m"), F.col("line").alias("line"))
    return distinct.select("leaf", "line", "n").join(picks, ["leaf", "line"]).where(before).select("leaf", "line", F.col("p.line").alias("tpl"))


def recurring_lines(docs: DataFrame, leading: int = LEADING, min_tokens: int = MIN_TOKENS, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY) -> DataFrame:
    """Per document (``_k``) the numbers of the lines to drop: ``_k, drop``."""
    small_batches(docs.sparkSession)
    table = durable(line_table(docs, leading, min_tokens, similarity))
    distinct = durable(table.groupBy("leaf", "line").agg(F.count("*").alias("n"), F.first("size").alias("size"), F.first("keys").alias("keys")))
    joined = durable(templates(docs, distinct, leading, min_tokens, similarity))
    named = durable(distinct.join(joined, ["leaf", "line"], "left").select("leaf", "line", F.coalesce("tpl", "line").alias("tpl"), "n", "size"))
    need = F.when(F.col("size") > LONG, F.least(F.lit(min_docs), F.lit(LONG_DOCS))).otherwise(F.lit(min_docs))
    # rows are at least as many as documents
    maybe = named.groupBy("leaf", "tpl").agg(F.sum("n").alias("total"), F.first(need).alias("need")).where("total >= need").select("leaf", "tpl", "need")
    wanted = durable(named.join(maybe, ["leaf", "tpl"]).select("leaf", "line", "tpl", "need", "n"))
    rows = durable(split_join(table.select("doc_id", "_k", "leaf", "line", "nos"), wanted, ["leaf", "line"], "n"))
    each = rows.groupBy("leaf", "tpl", "_k").agg(F.min("doc_id").alias("doc_id"), F.first("need").alias("need"), F.count("*").alias("c"))
    often = durable(each.groupBy("leaf", "tpl").agg(F.count("*").alias("n_docs"), F.sum("c").alias("c"), F.min("doc_id").alias("keeper"), F.first("need").alias("need")).where("n_docs >= need").select("leaf", "tpl", "keeper", "c"))
    hit = split_join(rows, often, ["leaf", "tpl"], "c").where("doc_id <> keeper")
    return hit.groupBy("_k").agg(F.array_distinct(F.flatten(F.collect_list("nos"))).alias("drop"))


def drop_recurring_lines(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with the recurring lines cut from ``text``; adds ``n_lines`` and ``n_dropped``, in place of columns so named."""
    drop = recurring_lines(docs, **how)
    rows = packed(docs, "doc_id", "text").join(drop, "_k", "left").withColumn("lines", F.split(F.col("_row.text"), "\n", -1))
    text, n, cut = F.col("_row.text"), F.size("lines"), F.col("drop").isNotNull()
    stay = F.array_except(F.sequence(F.lit(0), n - 1), "drop")
    return unpacked(
        rows, docs.columns, {"text": F.when(cut, F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")).otherwise(text)},
        n_lines=F.when(text.isNull(), 0).otherwise(n), n_dropped=F.when(cut, F.size("drop")).otherwise(0),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_recurring_lines(docs).select("doc_id", "n_lines", "n_dropped", F.length("text").alias("n_chars"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))


QUERIES: dict[str, Callable] = {"op2_line_templates": query}
