"""Decontamination, line templates, similarity join and importance resampling."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import docs, empty, word_list
from pyspark.sql import functions as F

from tallybook.llm import decontaminate as D, importance as I, line_templates as L, ngram_join as N
from tallybook.llm._common import components
from tallybook.llm._words import words


def test_words_match_the_pattern():
    rnd = random.Random(0)
    alphabet = "abZ09 .,;\n\t'`{é日\x7f\u00a0-"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(300)] + ["", None]
    w = words(pa.array(texts, pa.string()))
    h = w.hashes()
    seen = {}
    for i, t in enumerate(texts):
        a, b = int(w.first[i]), int(w.first[i] + w.n_words[i])
        mine = [w.text(j, j + 1) for j in range(a, b)]
        assert mine == word_list(t)
        for x, y in zip(mine, h[a:b].tolist(), strict=True):
            assert seen.setdefault(x, y) == y
    assert len(set(seen.values())) == len(seen)


def brute_contamination(texts, items, size=10):
    table = {}
    for i, t in items:
        w = word_list(t)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            table.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = {}
    for i, t in texts:
        w, hit, got = word_list(t), set(), set()
        for n in {len(k) for k in table}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in table:
                    hit |= set(range(k, k + n))
                    got |= table[tuple(w[k : k + n])]
        out[i] = (len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit))
    return out


def test_contamination_against_brute_force(spark):
    rnd = random.Random(1)
    vocab = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([0, 1, 3, 9, 10, 14])))) for i in range(12)] + [(99, None), (98, items_twice := "Alpha beta, gamma! " * 5)]
    texts = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 60)))) for i in range(60)]
    texts += [(100, None), (101, ""), (102, "x " * 30 + items_twice + " y"), (103, "ALPHA beta gamma alpha BETA gamma alpha beta gamma alpha")]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in D.contamination(docs(spark, [*texts, texts[3]]), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute_contamination(texts, items)


def test_contamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in D.contamination(docs(spark, [(1, "a b")]), none).collect()] == [False]
    assert D.contamination(empty(spark), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0
    twice = docs(spark, [(None, "a b c"), (1, "a z"), (1, "a z")])
    assert sorted(r.text for r in D.drop_contaminated(twice, spark.createDataFrame([(1, "b c")], "item_id long, text string")).collect()) == ["a z", "a z"]


def test_line_templates(spark):
    line = "user {} logged in from host {}"
    rows = [(i, f"own text of document number {'abcdefghij'[i]} {'klmnopqrst'[i]} stays here\n{line.format(i, i * 7)}\nshort one") for i in range(6)]
    rows += [(20, None), (21, ""), (22, line.format(5, 5)), (22, line.format(5, 5))]
    got = {(r.doc_id, r.text): (r.n_lines, r.n_dropped) for r in L.drop_recurring_lines(docs(spark, rows)).collect()}
    assert got[0, rows[0][1]] == (3, 0)
    assert all((i, "\n".join(x for x in rows[i][1].split("\n") if "logged" not in x)) in got for i in range(1, 6))
    assert got[20, None] == (0, 0) and got[21, ""] == (1, 0) and got[22, ""] == (1, 1)
    assert L.drop_recurring_lines(empty(spark)).count() == 0


def test_line_templates_in_parts(spark, monkeypatch):
    """A leaf dealt into parts ends in one template where its lines are alike."""
    monkeypatch.setattr(L, "PART", 4)
    rows = [(i, "alpha beta gamma delta epsilon zeta eta theta iota " + "abcdefghijklmnopqrst"[i] * 3) for i in range(20)]
    got = {r.doc_id: r.text for r in L.drop_recurring_lines(docs(spark, rows)).collect()}
    assert got[0] == rows[0][1] and all(got[i] == "" for i in range(1, 20))


def plain_lines(texts, min_docs, similarity=0.8):
    """Numbers of the dropped lines of each text: every line joins the most frequent line it is like."""

    def tokens(line):
        return ["<*>" if any("0" <= c <= "9" for c in t) else t for t in line.split()]

    docs = {}
    for i, t in texts:
        for line in t.split("\n"):
            w = tuple(tokens(line))
            if len(w) >= 4:
                docs.setdefault(w, set()).add(i)
    order = sorted(docs, key=lambda w: -len(docs[w]))

    def like(x, y):
        return len(x) == len(y) and x[:3] == y[:3] and sum(a == b for a, b in zip(x, y, strict=True)) >= similarity * len(x) - 1e-9

    tpl = {w: next(o for o in order if o is w or like(w, o)) for w in order}
    seen = {}
    for w, t in tpl.items():
        seen.setdefault(t, set()).update(docs[w])
    return {i: [k for k, line in enumerate(t.split("\n")) if (w := tuple(tokens(line))) in tpl and len(seen[tpl[w]]) >= min_docs(len(w)) and i != min(seen[tpl[w]])] for i, t in texts}


@pytest.mark.parametrize("part", [2, 5, 256])
def test_line_templates_against_a_plain_version(spark, monkeypatch, part):
    """Leaves of 1 to 60 lines, whatever is compared in one step; each line in another number of documents."""
    monkeypatch.setattr(L, "PART", part)
    rnd = random.Random(6)
    lines = []
    for leaf, (n, size) in enumerate([(1, 6), (4, 5), (15, 9), (40, 12), (60, 17)]):
        made = set()
        while len(made) < n:
            made.add(" ".join([*("abc"[k] + "xyzuv"[leaf] for k in range(3)), *(rnd.choice("pqr") * (2 if rnd.random() < 0.9 else 3) if k > 1 else rnd.choice("stuvw") for k in range(size - 3))]))
        lines += sorted(made)
    rnd.shuffle(lines)
    texts = {i: [] for i in range(len(lines) + 1)}
    for k, line in enumerate(lines):
        for i in rnd.sample(range(len(lines) + 1), k + 1):
            texts[i].append(line)
    rows = [(i, "\n".join(t)) for i, t in texts.items()]
    want = plain_lines(rows, lambda size: 40)
    keys = {r._k: r.doc_id for r in docs(spark, rows).select("doc_id", L.row_key("doc_id", "text").alias("_k")).collect()}
    got = {keys[r._k]: sorted(r.drop) for r in L.recurring_lines(docs(spark, rows), min_docs=40).collect()}
    assert got == {i: d for i, d in want.items() if d}
    assert 0 < sum(map(len, want.values())) < sum(map(len, texts.values()))


def test_line_template_with_a_field_behind_the_leading_tokens(spark, monkeypatch):
    """A word field at position 4 is found however many variants there are."""
    if hasattr(L, "HOT_LEAF"):
        monkeypatch.setattr(L, "HOT_LEAF", 10)
    rows = [(i, "posted by user " + "".join("abcdefghij"[int(c)] for c in str(i + 100)) + " in this public forum today") for i in range(40)]
    got = {r.doc_id: r.text for r in L.drop_recurring_lines(docs(spark, rows)).collect()}
    assert got[0] == rows[0][1] and all(got[i] == "" for i in range(1, 40))


def test_line_templates_compare_whole_tokens(spark):
    """Unlike lines of one leaf stay, however many there are."""
    word = lambda k: "".join("abcdefghij"[int(c)] for c in str(k))
    rows = [(i, "\n".join(f"{i} 2 3 {word(1000 + 40 * i + k)} {word(5000 + 40 * i + k)}" for k in range(40))) for i in range(40)]
    assert sum(r.n_dropped for r in L.drop_recurring_lines(docs(spark, rows)).collect()) == 0


def test_line_templates_count_documents(spark):
    """Three lines of one document are not three documents; a long line recurs from two documents on."""
    item, text = "point {} of the list is open", " ".join(f"{a}{b}" for a in "abcdefgh" for b in "klmnopq")
    rows = [(1, "\n".join(item.format(i) for i in "xyz")), (2, item.format("w")), (3, text + " a"), (4, text + " b"), (5, " ".join(text.split()[5:55])), (6, " ".join(text.split()[5:55]))]
    got = {r.doc_id: r.n_dropped for r in L.drop_recurring_lines(docs(spark, [*rows, rows[1]])).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 1, 5: 0, 6: 0}


def brute_links(texts, n=5, t=0.8):
    sets = {}
    for i, x in texts:
        w = word_list(x)
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    ids = sorted(sets)
    links = [(a, b) for j, a in enumerate(ids) for b in ids[j + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: (find(i), sum(i in p for p in links)) for i in ids}


@pytest.mark.parametrize(("small", "block"), [(16, 512), (2, 8)])
def test_links_against_brute_force(spark, monkeypatch, small, block):
    """With small buckets as pairs, and with all larger ones dealt into blocks."""
    monkeypatch.setattr(N, "SMALL", small)
    monkeypatch.setattr(N, "BLOCK", block)
    rnd = random.Random(4)
    base = [f"t{i}" for i in range(80)]
    texts = []
    for i in range(40):
        w = list(base)
        for _ in range(rnd.randint(0, 2)):
            w[rnd.randrange(80)] = f"x{rnd.randrange(9999)}"
        texts.append((i, " ".join(w)))
    texts += [(100 + i, " ".join(f"u{rnd.randrange(500)}" for _ in range(30))) for i in range(10)] + [(200, None), (201, ""), (202, "a b"), (203, "A, b!"), (204, "..."), (205, "a b c d e")]
    got = {r.doc_id: (r.class_id, r.n_links) for r in N.link_documents(docs(spark, texts)).collect()}
    assert got == brute_links(texts)


def test_near_copies_keep_one(spark):
    rows = [(3, "a b c d e f"), (2, "A b c d e f"), (2, "A b c d e f"), (None, "a b c d e f!"), (7, None), (8, "q r s t u v")]
    assert sorted((r.doc_id, r.text) for r in N.drop_near_copies(docs(spark, rows)).collect() if r.text) == [(2, "A b c d e f"), (8, "q r s t u v")]
    assert N.link_documents(empty(spark)).count() == 0


def test_near_copies_of_unlike_texts_without_an_id_of_their_own(spark):
    rows = [(None, "a b c d e f"), (None, "q r s t u v"), (5, "g h i j k l"), (5, "m n o p w x"), (6, "m n o p w x")]
    assert sorted(r.text for r in N.drop_near_copies(docs(spark, rows)).collect()) == sorted({t for _, t in rows})


def test_bands_reach_the_recall():
    for t, r in ((0.8, 0.999), (0.6, 0.9), (0.9, 0.99)):
        b, k = N.choose_bands(t, r)
        assert 1 - (1 - t**k) ** b >= r and b * k <= 64


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (5, 5)]
    got = {r.v: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100}


def labelled(spark, n=600, seed=5):
    rnd = random.Random(seed)
    good, bad = [f"word{i}" for i in range(60)], [f"junk{i}" for i in range(10)]
    rows, labels = [], []
    for i in range(n):
        is_bad = i % 4 == 0
        w = [rnd.choice(good) for _ in range(60)]
        for k in range(8 if is_bad else 0):
            w[k * 5] = rnd.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, 0 if is_bad else 1))
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, good int"), {i for i, g in labels if not g}


def test_importance_on_held_out_rows(spark):
    d, labels, bad = labelled(spark)
    train = labels.where("doc_id % 2 = 0 or doc_id % 8 = 4")
    got = {r.doc_id: r.selected for r in I.resample(d, train).collect()}
    held = [i for i in got if i % 2]
    right = sum(got[i] == (i not in bad) for i in got) / len(got)
    assert right > 0.98 and all(got[i] for i in held)


def test_importance_counts_raw_text_of_all_rows(spark):
    """Words that stand only in rows without a label weigh against them."""
    d, labels, _ = labelled(spark)
    rnd = random.Random(6)
    rows = [(1000 + i, " ".join(rnd.choice([f"word{k}" for k in range(60)]) if k % 5 or i % 2 else f"spam{rnd.randrange(5)}" for k in range(60))) for i in range(200)]
    got = {r.doc_id: r.log_weight for r in I.resample(d.unionByName(docs(spark, rows)), labels).collect()}
    assert max(got[1000 + i] for i in range(0, 200, 2)) < min(got[1000 + i] for i in range(1, 200, 2))


def test_top_k_is_exact(spark):
    rnd = np.random.default_rng(0)
    for keys in (rnd.normal(size=400).tolist(), [1.0] * 50 + [2.0] * 50, (rnd.normal(size=100) * 1e4).tolist()):
        df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(keys)], "doc_id long, key double")
        for k in (0, 1, 37, len(keys), len(keys) + 5):
            got = {r.doc_id for r in I._top_k(df, k).collect() if r.selected}
            best = sorted(range(len(keys)), key=lambda i: (-keys[i], i))[:k]
            assert len(got) == min(k, len(keys)) and sorted(keys[i] for i in got) == sorted(keys[i] for i in best)


def test_importance_without_labels(spark):
    d = docs(spark, [(1, "a b"), (2, None), (None, ""), (2, None)])
    none = spark.createDataFrame([], "doc_id long, good int")
    assert [r.selected for r in I.resample(d, none).collect()] == [True] * 4
    dd, labels, _ = labelled(spark, 80)
    assert I.resample(empty(spark), labels).count() == 0
    assert I.resample(dd.unionByName(d), labels.union(spark.createDataFrame([(None, 1), (3, None)], "doc_id long, good int"))).count() == 84
    assert I.keep_selected(dd, labels).where(F.col("doc_id") % 4 != 0).count() >= 55


def test_importance_of_blank_texts(spark, tmp_path):
    """A file, an Arrow chunk and a table that hold nothing but null, empty and white-space texts."""
    dd, labels, _ = labelled(spark, 80)
    blank = docs(spark, [(1000 + i, (None, "", " \n\t")[i % 3]) for i in range(40)])
    both = dd.coalesce(1).unionByName(blank.coalesce(1))
    both.write.parquet(f"{tmp_path}/two.parquet")  # two files, one of blanks
    for table, n in ((spark.read.parquet(f"{tmp_path}/two.parquet"), 120), (both.coalesce(1), 120), (blank, 40)):
        for k in (None, 30):
            got = I.resample(table, labels, k=k).collect()
            assert len(got) == n and all(r.log_weight == 0 for r in got if r.doc_id >= 1000)
    assert sum(r.selected for r in I.resample(both, labels, k=30).collect()) == 30
    assert I.keep_selected(blank, labels).columns == blank.columns
    import corpus_pipeline

    for name, t in (("labels", labels.select("doc_id", F.col("good").alias("quality"), F.lit(0).alias("toxic"))),):
        t.write.parquet(f"{tmp_path}/{name}.parquet")
    kept = corpus_pipeline.quality(spark, spark.read.parquet(f"{tmp_path}/two.parquet"), str(tmp_path))
    assert kept.where("doc_id < 1000").count() >= 30
