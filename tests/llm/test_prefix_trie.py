"""The prefix trie against plain loops over all prefixes."""

import hashlib
import random
import zlib

import duckdb
import numpy as np

from tallybook.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        head = c - int(c / 100) * 100 if c < 0 else c % 100
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - head, [])[:h] + ts[h:]
    return out


def plain_trie(convs):
    members, children = {}, {}
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    saved, leaves = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0) + sum(saved[x] for x in below)
        leaves[node] = sum(leaves[x] for x in below) or 1
    out = []
    for node, ms in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in ms if len(convs[c]) == len(node)))
        out.append((min(ms), len(node), min(members[node[:-1]]) if node else None, len(ms), len(children.get(node, [])), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select(*P.NODE).collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as k", "1 as da", "'y' as head")


def build(spark, rows):
    return result(P.trie(*P.rebuilt(P.turns_of(frame(spark, rows)).persist())))


def talk(n, seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-150, 900), n):
        for t in range(rng.choice([1, 2, 3, 5, 8])):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["", "ja", "漢字 é", "no no", "x" * 50])))
    return rows


def test_as_plain_loops(spark):
    rows = talk(250, 2)
    rows += [(c, t, "user", "same again") for c in range(1000, 1060) for t in range(3)]  # copies
    rows += [(777, t, "user", f"turn {t % 7}") for t in range(600)] + [(778, t, "user", f"turn {t % 7}") for t in range(550)]  # long paths that share
    rows += [(None, 1, "user", "lost"), (5000, None, None, None), (5000, None, "a", "b"), (5001, 3, "user", None), (5001, 3, "user", None), (5001, 1, "r", "t")]
    random.Random(1).shuffle(rows)
    assert build(spark, rows) == plain_trie(plain_rebuilt(rows))


def test_few_rows(spark):
    assert build(spark, []) == []
    for rows in ([(3, 0, "u", "x")], [(200, 0, "u", "x")], [(201, 0, "u", "x")], [(None, 0, "u", "x")], [(1, 0, "u", "a"), (2, 0, "u", "a")]):
        assert build(spark, rows) == plain_trie(plain_rebuilt(rows)), rows


def test_false_alarms_change_nothing(spark, monkeypatch):
    """A sketch with far too few counters takes most prefixes for shared, and the nodes are the same."""
    rows = talk(150, 8)
    want = plain_trie(plain_rebuilt(rows))
    monkeypatch.setattr(P, "SKETCH_WIDTH", (64, 64))
    assert build(spark, rows) == want


def test_estimate_of_one_is_proof(spark):
    """Whatever the width, no digest that occurs twice is taken for single; with room nearly all others are."""
    rng = np.random.default_rng(3)
    once, twice = rng.integers(-(1 << 62), 1 << 62, (3000, 2)), rng.integers(-(1 << 62), 1 << 62, (500, 2))
    x = np.concatenate([once, twice, twice])
    rows = spark.createDataFrame([tuple(map(int, r)) for r in x], "da long, db long").repartition(5)
    for n in (len(x), 10):
        field, width = P.sketch(rows, n)
        assert not P.single(field, width, twice[:, 0], twice[:, 1]).any()
    field, width = P.sketch(rows, len(x))
    assert P.single(field, width, once[:, 0], once[:, 1]).mean() > 0.99


def test_query_against_sql_and_loops(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{sf}/conversations.parquet'")
    got = result(P.query(spark, sf))
    want = con.sql(f"select {', '.join(P.NODE)} from ({P.ORACLES['op11_prefix_trie']})").fetchall()
    assert got == sorted(want, key=repr)
    assert got == plain_trie(plain_rebuilt(con.sql("select conv_id, turn, role, text from conversations").fetchall()))
