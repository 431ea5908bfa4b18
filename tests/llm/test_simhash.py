"""Fingerprints, pigeonring chains and components against plain versions."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from helpers import docs, empty, lower
from tallybook.llm import simhash as S


def plain_fingerprint(text, n=3):
    import re

    w = re.findall("[^\x20\x09-\x0d]+", lower(text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows, max_bits=2):
    """doc_id, fingerprint and component of (doc_id, text) rows, all pairs compared."""
    fps = [plain_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= max_bits:
                group[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return sorted(((d, f"{fp:016x}", least.get(find(i))) for i, ((d, _), fp) in enumerate(zip(rows, fps, strict=True))), key=repr)


def corpus(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß漢") for _ in range(rng.randint(1, 6)))
    texts = []
    for _ in range(n):
        w = [word() for _ in range(rng.choice([0, 1, 2, 3, 4, 60, 300]))]
        texts.append(rng.choice([" ", "\n", "\t ", " "]).join(w))
        for _ in range(rng.choice([0, 0, 1, 6])):
            v = list(w)
            for _ in range(rng.randint(0, 2)):
                if v:
                    v[rng.randrange(len(v))] = word()
            texts.append(" ".join(v).upper() if rng.random() < 0.3 else " ".join(v))
    return [(i, t) for i, t in enumerate(texts)]


def result(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=repr)


def test_near_copies_as_all_pairs(spark):
    rows = corpus(120, 5)
    rows += [(None, None), (None, "x y z w"), (7, rows[3][1]), (7, rows[3][1]), (9001, " \n "), (9002, "\x85 a")]
    got = result(S.near_copies(docs(spark, rows)))
    assert got == plain_components(rows)
    assert len({r[2] for r in got}) < len(got) - 60
    assert result(S.near_copies(empty(spark))) == []


@pytest.mark.parametrize(("segments", "max_bits"), [(3, 2), (5, 2), (7, 2), (4, 3), (9, 3), (2, 1), (1, 0), (64, 5)])
def test_chains_lose_no_pair(segments, max_bits):
    """Of any two words within the distance one chain at least passes, and none beyond it."""
    rng = np.random.default_rng(segments)
    for bits in range(max_bits + 3):
        for _ in range(100):
            x = np.uint64(sum(1 << int(b) for b in rng.choice(64, bits, replace=False)))
            passed = []
            bounds, equal, budget = S.rings(segments, max_bits)
            for at in range(segments):
                key = sum(S._bits(*bounds[(at + j) % segments]) for j in range(equal))
                passed.append(not int(x) & key and bool(S.chained(np.array([x]), at, segments, max_bits)[0]))
            assert any(passed) == (bits <= max_bits)


def test_dense_groups_are_dealt_into_blocks(spark):
    """A ball of fingerprints that share keys, in blocks of seven, gives the components of all pairs."""
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(50)}
    fps = sorted(fps)
    frame = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    got = S.components(S.links(frame, block=7))
    label = {r.v % (1 << 64): r.label % (1 << 64) for r in got.collect()}
    group = {f: f for f in fps}

    def find(f):
        while group[f] != f:
            f = group[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2:
                group[find(a)] = find(b)
    want = {}
    for f in fps:
        want.setdefault(find(f), set()).add(f)
    have = {}
    for f in fps:
        have.setdefault(label.get(f, f), set()).add(f)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, have.values()))


def test_long_text_is_hashed_in_parts():
    text = " ".join(f"w{i % 977}" for i in range(50_000))
    assert S.fingerprint(text.encode()) == plain_fingerprint(text)


def test_query_reads_all_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert result(S.query(spark, sf).select("doc_id", "fingerprint", "component_id")) == plain_components(rows)
    assert S.query(spark, sf).where(F.col("component_id") != F.col("doc_id")).count() > 0
