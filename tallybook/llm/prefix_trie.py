"""Prefix trie of conversations, screened by a count-min sketch.

A node is a distinct sequence of first turns (role, text); its members are the
conversations that start with it. Every prefix of every conversation gets a digest of
128 bits: the exclusive or of a keyed hash of each turn and its place, which running
scans over ranges of rows compute, so that one endless conversation spans many tasks.

Tasks count digests in a count-min sketch whose counters stop at two. An estimate is
never too low, so an estimate of one proves that a prefix belongs to one conversation
alone, and then so do all that continue it. These tails are emitted where they lie: a
chain of nodes with one member. Only prefixes that may be shared are shuffled and
grouped by digest, which counts them exactly; a false alarm costs a row and no error.

Sums over subtrees follow from paths. A node's values are given to the row that its
smallest member has at its depth; running sums along each conversation, from its end,
say what each of its rows has below, and these add up by node. No level-by-level rounds
are needed, and no tree is built in one place. Digests of the ids that end at a node are
taken from sorted runs of ids, packed in tasks and hashed in order as a stream.

Turns are ordered by ``turn``, null first, turns of one number by role and the first
``START`` characters of the text, then by a hash of both. Null roles and texts are empty. Rows without a conv_id take no part. Repeated rows are turns of
their own. Extra columns are ignored. Texts of any length are hashed by Spark and not
carried further. An empty table gives no nodes; otherwise the root is always one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.scans import numbered, running
from ._common import durable, small_batches, split_join
from ._words import mix

#: Rows of the sketch, and least and most counters of each, two bits a counter in tasks and one in the broadcast field (32 MB at most).
SKETCH_ROWS = 4
SKETCH_WIDTH = 1 << 16, 1 << 26
_PART = 1 << 16
#: Characters of a text that order turns of one number; whole texts are not shuffled.
START = 64
#: Ids packed into one row.
IDS_A_ROW = 4096
NODE = "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv_id, k, ha, hb, len``: each turn's place from 1, two hashes of its role and text, and its code points."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    x = conversations.where("conv_id is not null").select("conv_id", "turn", role.alias("role"), F.substring(text, 1, START).alias("start"), F.xxhash64(F.lit(1), role, text).alias("ha"), F.xxhash64(F.lit(2), text, role, F.length(role)).alias("hb"), F.length(text).cast("long").alias("len"), F.monotonically_increasing_id().alias("row"))
    return numbered(x, ["conv_id"], [F.asc_nulls_first("turn"), "role", "start", "ha", "hb", "row"]).select("conv_id", "k", "ha", "hb", "len")


def rebuilt(turns: DataFrame, block: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Each conversation's own first h turns replaced by those of the first conversation of its block.

    Returns the ids of all conversations, also of those left without a turn, and the
    turns with their order ``src, k``. h is the crc32 of the id's digits modulo ``most``;
    a block is ``block`` ids from a multiple on, so at most ``most - 1`` turns meet at
    most 2 * ``block`` ids.
    """
    head = F.col("conv_id") - F.col("conv_id") % block
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    ids = durable(turns.groupBy("conv_id").agg(F.count("*").alias("n")))
    take = ids.select("conv_id", head.alias("head"), h.alias("h")).where("conv_id <> head and h > 0")
    first = turns.where((F.col("conv_id") % block == 0) & (F.col("k") < most)).withColumnRenamed("conv_id", "head")
    lent = take.join(first, "head").where("k <= h").select("conv_id", F.lit(0).alias("src"), "k", "ha", "hb", "len")
    own = turns.where((F.col("k") > h) | (F.col("conv_id") == head)).select("conv_id", F.lit(1).alias("src"), "k", "ha", "hb", "len")
    return ids.select("conv_id"), lent.unionByName(own)


def prefixes(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """One row for every conversation and depth, the root included: conv_id, depth, len, digest da, db, the parent's pa, pb, and last."""
    x = turns.unionByName(ids.select("conv_id", F.lit(-1).alias("src"), F.lit(0).cast("long").alias("k"), *(F.lit(0).cast("long").alias(c) for c in ("ha", "hb", "len"))))
    x = numbered(x, ["conv_id"], ["src", "k"], "depth").select("conv_id", (F.col("depth") - 1).alias("depth"), "ha", "hb", "len")
    keyed = lambda i: F.when(F.col("depth") > 0, F.xxhash64(F.lit(i), "ha", "hb", "depth")).otherwise(0)
    x = x.withColumns({"ta": keyed(3), "tb": keyed(4)})
    x = running(x, ["conv_id"], ["depth"], da=("xor", F.col("ta")), db=("xor", F.col("tb")))
    x = x.select("conv_id", "depth", "len", "da", "db", F.col("da").bitwiseXOR(F.col("ta")).alias("pa"), F.col("db").bitwiseXOR(F.col("tb")).alias("pb"))
    ends = x.groupBy("conv_id").agg(F.max("depth").alias("depth")).withColumn("ends", F.lit(True))
    return x.join(ends, ["conv_id", "depth"], "left").withColumn("last", F.coalesce("ends", F.lit(False))).drop("ends")


def _slots(a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """The counter of each digest in every row of the sketch, rows one after the other."""
    a, b = a.view(np.uint64), mix(b.view(np.uint64))
    return np.stack([(mix(a + np.uint64(i) * b) & np.uint64(width - 1)).astype(np.int64) + i * width for i in range(SKETCH_ROWS)])


def sketch(rows: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """A bit for every counter of a count-min sketch of the digests: whether it counts two or more; and the sketch's width.

    Tasks keep two bits a counter, once and twice, and add them up in parts.
    """
    width = min(max(1 << (4 * n).bit_length(), SKETCH_WIDTH[0]), SKETCH_WIDTH[1])
    total = width * SKETCH_ROWS

    def fold(parts: dict, part: int, once: np.ndarray, twice: np.ndarray) -> None:
        seen = parts.setdefault(part, np.zeros((2, _PART // 8), np.uint8))
        seen[1] |= twice | (seen[0] & once)
        seen[0] |= once

    def field(slots: np.ndarray, part: int) -> np.ndarray:
        on = np.zeros(_PART, bool)
        on[slots[np.searchsorted(slots, part * _PART) : np.searchsorted(slots, (part + 1) * _PART)] - part * _PART] = True
        return np.packbits(on, bitorder="little")

    def fill(parts: dict, slots: list[np.ndarray]) -> None:
        slot = np.sort(np.concatenate(slots))
        again = slot[1:] == slot[:-1]
        many, slot = np.unique(slot[1:][again]), np.unique(slot)
        for part in np.unique(slot // _PART).tolist():
            fold(parts, part, field(slot, part), field(many, part))

    def emit(parts: dict):
        return pa.RecordBatch.from_pydict({"part": pa.array(list(parts), pa.int64()), "bits": pa.array([x.tobytes() for x in parts.values()], pa.binary())})

    def count(batches):
        parts: dict[int, np.ndarray] = {}
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(_slots(batch.column("da").to_numpy(), batch.column("db").to_numpy(), width).ravel())
            if sum(map(len, held)) >= 1 << 21:
                fill(parts, held)
                held = []
        if held:
            fill(parts, held)
        yield emit(parts)

    def add(batches):
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, bits in zip(batch.column("part").to_pylist(), batch.column("bits").to_pylist(), strict=True):
                fold(parts, part, *np.frombuffer(bits, np.uint8).reshape(2, -1))
        yield emit(parts)

    kind = "part long, bits binary"
    merged = rows.select("da", "db").mapInArrow(count, kind).repartition("part").mapInArrow(add, kind)
    twice = np.zeros(-(-total // _PART) * _PART // 8, np.uint8)
    for r in merged.select("part", F.expr(f"substring(bits, {_PART // 8 + 1}, {_PART // 8})").alias("bits")).collect():
        twice[r.part * _PART // 8 : (r.part + 1) * _PART // 8] = np.frombuffer(r.bits, np.uint8)
    return twice, width


def single(twice: np.ndarray, width: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the digest's estimate, the least of its counters, is one."""
    slot = _slots(a, b, width)
    return ((twice[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 0).any(0)


def screened(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` with ``alone`` (the prefix is proven to have one member) and ``tail`` (its parent is, too).

    A prefix is proven by its own estimate or by that of any shorter one.
    """
    field, width = sketch(rows, n)
    shared = rows.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        for b in batches:
            da, db, p, q, depth = (b.column(c).to_numpy() for c in ("da", "db", "pa", "pb", "depth"))
            here, above = ((depth > i) & single(shared.value, width, *d) for i, d in enumerate(((da, db), (p, q))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(here), pa.array(above)], [*b.schema.names, "here", "above"])

    told = rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", here boolean, above boolean")
    return running(told, ["conv_id"], ["depth"], alone=("max", F.col("here")), tail=("max", F.col("above"))).drop("here", "above")


def id_digests(ends: DataFrame) -> DataFrame:
    """``da, db, ends_sha256``: SHA-256 of the ids that end at each node, ascending, comma-joined.

    Sorted runs of ids are packed by the tasks of a range partition, so that a node with
    many ids is packed by many; one stream per node then hashes the packs in order.
    """
    rows = ends.repartitionByRange("da", "db", "conv_id").sortWithinPartitions("da", "db", "conv_id")

    def pack(batches):
        for b in batches:
            a, d, c = (b.column(k).to_numpy() for k in ("da", "db", "conv_id"))
            if len(a):
                cut = np.flatnonzero((a[1:] != a[:-1]) | (d[1:] != d[:-1])) + 1
                cut = np.unique(np.r_[0, cut, np.arange(0, len(a), IDS_A_ROW)])
                yield pa.RecordBatch.from_pydict({"da": a[cut], "db": d[cut], "first": c[cut], "ids": [",".join(map(str, x.tolist())) for x in np.split(c, cut[1:])]})

    packs = rows.mapInArrow(pack, "da long, db long, first long, ids string")

    def hashed(batches):
        key, state = None, None
        for b in batches:
            for a, d, ids in zip(*(b.column(k).to_pylist() for k in ("da", "db", "ids")), strict=True):
                if (a, d) == key:
                    state.update(b"," + ids.encode())
                    continue
                if key is not None:
                    yield _digest(key, state)
                key, state = (a, d), hashlib.sha256(ids.encode())
        if key is not None:
            yield _digest(key, state)

    def _digest(key, state):
        return pa.RecordBatch.from_pydict({"da": [key[0]], "db": [key[1]], "ends_sha256": [state.hexdigest()]})

    return packs.repartition("da", "db").sortWithinPartitions("da", "db", "first").mapInArrow(hashed, "da long, db long, ends_sha256 string")


def trie(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes, with the columns :data:`NODE`, of the conversations ``ids(conv_id)`` with ``turns(conv_id, src, k, ha, hb, len)``."""
    small_batches(ids.sparkSession)
    rows = durable(prefixes(ids, turns))
    rows = durable(screened(rows, rows.count()))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    key = ["da", "db"]
    up = [F.col("pa").alias("da"), F.col("pb").alias("db")]

    # Prefixes that may be shared, counted exactly.
    open_ = rows.where("not alone")
    nodes = durable(open_.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("depth").alias("depth"), F.first("len").alias("len"), F.first("pa").alias("pa"), F.first("pb").alias("pb")))
    heads = rows.where("alone and not tail")
    below = nodes.where("depth > 0").select(*up).unionAll(heads.select(*up)).groupBy(*key).agg(F.count("*").alias("n_children"))
    nodes = durable(nodes.join(below, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))

    # What each row has below on its own conversation's path, added up by node.
    zero = F.lit(0).cast("long")
    value = nodes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("len")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    path = open_.select("conv_id", "depth", *key).join(value, ["conv_id", "depth"], "left")
    path = path.unionByName(heads.select("conv_id", "depth", F.lit(None).cast("long").alias("da"), F.lit(None).cast("long").alias("db"), zero.alias("saved"), F.lit(1).cast("long").alias("leaf")))
    path = running(path, ["conv_id"], [F.desc("depth")], saved_tokens=("sum", F.coalesce("saved", zero)), n_leaves=("sum", F.coalesce("leaf", zero)))
    sums = path.where("da is not null").groupBy(*key).agg(F.sum("saved_tokens").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves"))

    ends = id_digests(open_.where("last").select("conv_id", *key))
    nodes = nodes.join(sums, key).join(ends, key, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", none))
    root = nodes.where("depth = 0").select("conv_id", "depth", F.lit(None).cast("long").alias("parent_conv_id"), *NODE[3:])

    # Tails lie in one conversation; only their first node needs its parent's name.
    own = F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)
    one = F.lit(1).cast("long")
    lone = rows.where("alone").select("conv_id", "depth", one.alias("n_convs"), (~F.col("last")).cast("long").alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"), F.when(F.col("last"), own).otherwise(none).alias("ends_sha256"), "tail", *up)
    tails = lone.where("tail").select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), *NODE[3:])
    named = nodes.select(*key, F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("weight"))
    children = nodes.where("depth > 0").select("conv_id", "depth", *NODE[3:], *up).unionByName(lone.where("not tail").select("conv_id", "depth", *NODE[3:], *key))
    return root.unionByName(split_join(durable(children), durable(named), key, "weight").select(*NODE)).unionByName(tails)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = durable(turns_of(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return trie(*rebuilt(turns))


QUERIES: dict[str, Callable] = {"op11_prefix_trie": query}
ORACLES: dict[str, str] = {
    "op11_prefix_trie": """
WITH byte AS (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, x: xor(c >> 1, (c & 1) * 3988292384)) AS t FROM range(256) r(i)),
tab AS (SELECT list(t ORDER BY i) AS t FROM byte),
o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS head FROM o),
h AS (SELECT conv_id, head, CASE WHEN conv_id = head THEN 0 ELSE xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 6 END AS h FROM c, tab),
b AS (SELECT h.conv_id, 0 AS src, k, role, text FROM h JOIN o ON o.conv_id = head AND k <= h UNION ALL SELECT o.conv_id, 1, k, role, text FROM o JOIN h ON h.conv_id = o.conv_id WHERE k > h),
d AS (SELECT conv_id, row_number() OVER w AS depth, length(text) AS len, list(concat(length(role), ':', role, ':', length(text), ':', text)) OVER w AS path, count(*) OVER (PARTITION BY conv_id) AS n FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY src, k)),
p AS (SELECT conv_id, depth, len, md5(CAST(path AS VARCHAR)) AS node, n FROM d UNION ALL SELECT conv_id, 0, 0, 'root', (SELECT count(*) FROM b WHERE b.conv_id = c.conv_id) FROM c),
u AS (SELECT p.*, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS up FROM p),
g AS (SELECT node, any_value(up) AS up, any_value(depth) AS depth, any_value(len) AS len, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256 FROM u GROUP BY node),
k AS (SELECT g.*, (SELECT count(*) FROM g x WHERE x.up = g.node) AS n_children FROM g),
s AS (SELECT u.node, sum((n_convs - 1) * k.len) AS saved_tokens, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves FROM k JOIN u ON u.conv_id = k.conv_id AND u.depth <= k.depth GROUP BY u.node)
SELECT k.conv_id, CAST(k.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, k.n_convs, k.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, k.ends_sha256
FROM k JOIN s ON s.node = k.node LEFT JOIN g q ON q.node = k.up""",
}
