"""What all operators of this package bear: columns of any name, nulls, empty tables, repeated rows, long texts."""

import random
import re

import public_tokenizers
import pytest
from helpers import word_list
from pyspark.sql import functions as F

from tallybook.llm import chroma, decontaminate, importance, line_templates, main_text, ngram_join, pieces, simhash, surrogates, token_files, url_filter
from tallybook.llm._common import bloom_of, packed, passes, shared_dir, split_join, unpacked

MODULES = (chroma, decontaminate, importance, line_templates, main_text, ngram_join, pieces, simhash, surrogates, token_files, url_filter)
PIECES, WORDS = (public_tokenizers.path(x) for x in ("piece_bpe_32k.model", "word_bpe_49k.json"))


def internal_names():
    """Every name that a module gives to a column, by its source."""
    import inspect

    from tallybook.llm import _common

    names = set()
    for m in (*MODULES, _common):
        text = inspect.getsource(m)
        names |= set(re.findall(r"""(?:alias|withColumn|withColumnRenamed|col)\(\s*"(\w+)\"""", text)) | set(re.findall(r"""withColumn(?:s|Renamed)?\([^)]*?"(\w+)\"""", text))
        for schema in re.findall(r"mapInArrow\(\w+, f?\"([^\"]*)\"", text):
            names |= set(re.findall(r"(?:^|, )(\w+) ", schema))
    return sorted(names - {"doc_id", "text", "page_id", "url", "html", "item_id", "rec_id", "media"}, key=str.lower)


TEXTS = [(1, "Mr John Smith wrote to a@b.com, that was all he did"), (2, None), (None, "alpha beta gamma delta epsilon zeta"), (3, ""), (4, "alpha beta gamma delta epsilon zeta"), (4, "alpha beta gamma delta epsilon zeta"), (5, "the line of one two three four\nthe line of one two three five")]


@pytest.fixture(scope="module")
def crowded(spark):
    """Documents with a column of every internal name, once each whatever the case."""
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    seen = {}
    for n in internal_names():
        seen.setdefault(n.lower(), n)
    assert len(seen) > 60 and {"_k", "news", "drop", "_row", "lines", "_hot", "place"} <= set(seen)
    return df.select("*", *(F.lit(f"x{i}").alias(n) for i, n in enumerate(seen.values())))


def labels(spark):
    return spark.createDataFrame([(1, 1), (3, 0), (4, 1), (5, None)], "doc_id long, good int")


def items(spark):
    return spark.createDataFrame([(7, "gamma delta epsilon", "z"), (8, None, "z")], "item_id long, text string, _k string")


KEEPERS = {
    "lines": (lambda s, d: line_templates.drop_recurring_lines(d), {"n_lines", "n_dropped"}),
    "copies": (lambda s, d: ngram_join.drop_near_copies(d), set()),
    "benchmark": (lambda s, d: decontaminate.drop_contaminated(d, items(s)), set()),
    "quality": (lambda s, d: importance.keep_selected(d, labels(s)), set()),
    "surrogates": (lambda s, d: surrogates.replace_entities(d, "k"), {"n_entities"}),
    "pieces": (lambda s, d: pieces.encode(d, PIECES), {"ids"}),
}
OTHERS = {
    "links": lambda s, d: ngram_join.link_documents(d), "near": lambda s, d: simhash.near_copies(d), "contamination": lambda s, d: decontaminate.contamination(d, items(s)), "resample": lambda s, d: importance.resample(d, labels(s)),
    "round_trip": lambda s, d: pieces.round_trip(d, PIECES), "token_files": lambda s, d: token_files.read_token_files(token_files.write_token_files(d, shared_dir(s), WORDS)),
    "main_text": lambda s, d: main_text.extract(d.withColumnsRenamed({"doc_id": "page_id", "text": "html"}).withColumn("url", F.lit("u"))),
    "urls": lambda s, d: url_filter.judge(d.withColumnsRenamed({"doc_id": "page_id", "text": "url"}), labels(s).withColumnRenamed("doc_id", "page_key")),
    "chroma": lambda s, d: chroma.search(chroma.fingerprints(d.withColumn("rec_id", F.col("doc_id")).withColumn("media", F.col("text").cast("binary"))), F.col("rec_id") > 0),
}


@pytest.mark.parametrize("name", KEEPERS)
def test_columns_of_any_name_stay(spark, crowded, name):
    run, new = KEEPERS[name]
    out = run(spark, crowded)
    assert set(map(str.lower, out.columns)) == set(map(str.lower, crowded.columns)) | new and len(set(map(str.lower, out.columns))) == len(out.columns)
    rows = out.collect()
    assert len(rows) == {"copies": 5, "benchmark": 4}.get(name, len(rows)) and {(r.doc_id, r.text) for r in rows if name not in ("lines", "surrogates")} <= set(TEXTS)
    mine = {n: crowded.first()[n] for n in crowded.columns if n not in ("doc_id", "text") and n.lower() not in new}
    assert rows and all(r[n] == v for r in rows for n, v in mine.items())


@pytest.mark.parametrize("name", OTHERS)
def test_columns_of_any_name_are_ignored(spark, crowded, name):
    skip = {"rec_id", "media", "page_id", "url", "html"}
    out = OTHERS[name](spark, crowded.drop(*skip))
    assert len(set(out.columns)) == len(out.columns) and out.count() == {"chroma": 6}.get(name, len(TEXTS))


@pytest.mark.parametrize("name", ["main_text", "round_trip", "quality"])
def test_empty_tables(spark, name):
    """The other operators' tests have their own empty tables."""
    none = spark.createDataFrame([], "doc_id long, text string")
    run = KEEPERS[name][0] if name in KEEPERS else OTHERS[name]
    assert run(spark, none).count() == 0


@pytest.mark.parametrize("name", ["lines", "copies", "benchmark", "surrogates", "round_trip", "token_files", "chroma", "near"])
def test_a_text_of_megabytes(spark, name):
    """One line, one word and many lines of 1 MB each, beside short texts."""
    rnd = random.Random(1)
    words = [f"w{rnd.randrange(5000)}" for _ in range(200_000)]
    rows = [(1, " ".join(words)), (2, "x" * 1_200_000), (3, "\n".join(" ".join(words[i : i + 8]) for i in range(0, len(words), 8))), (4, "gamma delta epsilon and more"), (5, "short one")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    out = (KEEPERS[name][0] if name in KEEPERS else OTHERS[name])(spark, d)
    assert out.count() == {"benchmark": 4, "copies": 4}.get(name, 5)


def test_rows_that_are_no_copies_stay(spark):
    """Repeated rows without words all stay, of others one."""
    rows = [(1, "a b c d e f")] * 3 + [(2, "...")] * 3 + [(3, None)] * 2 + [(None, "q r s t u v")] * 2
    got = sorted(map(repr, ((r.doc_id, r.text) for r in ngram_join.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect())))
    assert got == sorted(map(repr, [(1, "a b c d e f"), (None, "q r s t u v")] + [(2, "...")] * 3 + [(3, None)] * 2))


def test_packed_rows_come_back(spark):
    df = spark.createDataFrame([(1, "a", 2)], "doc_id int, text string, `odd.name` int")
    out = unpacked(packed(df, "doc_id", "text"), df.columns, {"text": F.lit("b")}, DOC_ID=F.lit(9))
    assert out.columns == ["text", "odd.name", "DOC_ID"] and tuple(out.first()) == ("b", 2, 9)


def test_split_join_is_a_join(spark):
    """Hot keys by the broadcast, the others by the shuffle, together all."""
    rnd = random.Random(2)
    big = spark.createDataFrame([(rnd.choice([1] * 60 + list(range(40))), i) for i in range(600)], "k int, v int")
    small = big.groupBy("k").agg(F.count("*").alias("n")).where("k % 3 <> 2").withColumn("w", F.col("k") * 10)
    want = sorted(map(tuple, big.join(small, "k").select("k", "v", "w").collect()))
    for parts in (2, 10, 4096):
        assert sorted(map(tuple, split_join(big, small, ["k"], "n", parts).select("k", "v", "w").collect())) == want


def test_bloom_filter_follows_its_keys(spark):
    for n in (0, 5, 400_000):
        keys = spark.range(n).select(F.xxhash64("id").alias("h"))
        field = bloom_of(keys)
        got = keys.toPandas().h.to_numpy().view("uint64") if n else []
        assert len(field) * 8 >= max(8 * n, 1 << 24) and (not n or passes(field, got).all())
        other = spark.range(10_000_000, 10_020_000).select(F.xxhash64("id").alias("h")).toPandas().h.to_numpy().view("uint64")
        assert passes(field, other).mean() < 0.15


def test_shared_folder_must_be_set_on_a_cluster(spark):
    class Conf:
        def get(self, *a):
            return None

    class Cluster:
        conf = Conf()
        sparkContext = type("C", (), {"master": "local-cluster[3,2,1000]"})()

    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(Cluster())


def plain_main_text(html):
    """Tree scoring with the standard parser and recursion, for pages whose markup is complete."""
    from html.parser import HTMLParser

    class Node:
        def __init__(self, tag, attrs=(), up=None):
            self.tag, self.up, self.kids, self.score = tag, up, [], 0.0
            named = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role"))
            self.bad = tag in main_text.BOILERPLATE or tag != "article" and bool(main_text.NEGATIVE.search(named))
            self.good = tag in ("article", "main") or bool(named) and not self.bad and bool(main_text.POSITIVE.search(named))

        def size(self):
            chars = links = commas = 0
            for k in self.kids:
                if isinstance(k, str):
                    t = " ".join(k.split())
                    chars, commas = chars + len(t), commas + t.count(",")
                elif not k.bad:
                    a, b, c = k.size()
                    chars, links, commas = chars + a, links + (a if k.tag == "a" else b), commas + c
            return chars, links, commas

        def text(self, out):
            for k in self.kids:
                if isinstance(k, str):
                    out[-1] += k
                elif k.tag == "br":
                    out[-1] += " "
                elif not k.bad:
                    block = k.tag in main_text.BLOCK
                    if block:
                        out.append("")
                    k.text(out)
                    if block:
                        out.append("")

    class Tree(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.root = self.cur = Node("html")

        def handle_starttag(self, tag, attrs):
            if tag in ("html", "body"):
                return
            if main_text._CLOSES.get(tag, ((),))[0] == {"p"} and self.cur.tag == "p":
                self.cur = self.cur.up
            n = Node(tag, attrs, self.cur)
            self.cur.kids.append(n)
            if tag not in main_text.VOID:
                self.cur = n

        def handle_endtag(self, tag):
            x = self.cur
            while x.up is not None and x.tag != tag:
                x = x.up
            self.cur = x.up or self.cur

        def handle_data(self, data):
            self.cur.kids.append(data)

    t = Tree()
    t.feed(html)
    t.close()
    every = []

    def walk(n):
        if n.bad:
            return
        every.append(n)
        own = n.tag in ("p", "pre", "h1", "h2", "h3", "blockquote", "li", "td", "dd")
        chars, links, commas = n.size() if own else (0, 0, 0)
        if not own and n.tag in main_text.CONTAINER:
            direct = [" ".join(k.split()) for k in n.kids if isinstance(k, str)]
            chars, commas = sum(map(len, direct)), sum(x.count(",") for x in direct)
        if chars:
            points, up, share = (1 + commas + min(chars / 100, 3)) * (1 - links / chars), n.up if own else n, 1.0
            while up is not None and share > 0.05:
                up.score, up, share = up.score + points * share, up.up, share / 2
        for k in n.kids:
            if not isinstance(k, str):
                walk(k)

    walk(t.root)
    value = lambda n: (lambda c, ls, _: n.score * (1 - ls / c if c else 0) * (1.25 if n.good else 1) + 5 * n.good)(*n.size())
    best = max((n for n in every if n.score > 0 and (n.tag in main_text.CONTAINER or n.tag in ("ul", "ol", "table", "span", "center"))), key=value, default=t.root)
    out = [""]
    best.text(out)
    return "\n\n".join(x for x in (" ".join(b.split()) for b in out) if x)


def test_main_text_of_all_pages(spark, sf):
    """All pages at the smallest size against a second version; siblings add nothing there, as nothing beside the article is long."""
    rows = spark.read.parquet(f"{sf}/pages.parquet")
    want = {r.page_id: plain_main_text(r.html) if r.html else "" for r in rows.collect()}
    got = {r.page_id: r.text for r in main_text.extract(rows).collect()}
    assert got == want and sum(map(bool, want.values())) > 0.9 * len(want)
    for r in rows.collect():
        if r.html and "<article>" in r.html:
            inside = word_list(re.sub("<[^>]*>", " ", r.html.split("<article>")[1].split("</article>")[0]))
            assert word_list(got[r.page_id]) == inside or set(word_list(got[r.page_id])) <= set(inside)


def test_main_text_of_deep_and_long_pages():
    deep = "<div><p>hello, world text here</p>" + "<span>" * 100_000
    assert main_text.main_text(deep) == "hello, world text here"
    long = "<nav>" + "<a href=x>menu</a>" * 1000 + "</nav><article>" + "<p>word, word and <b>bold</b></p>" * 300_000 + "</article><footer>f</footer>"
    assert len(long) > 9_000_000 and main_text.main_text(long).count("word, word and bold") == 300_000
    assert main_text.main_text("<p>" + "</b>" * 200_000 + "x</p>") == "x"
    assert main_text.main_text("<article><header><h1>Title here</h1></header><p>Body, of it.</p></article>") == "Title here\n\nBody, of it."


def plain_tree(paths, z):
    """Templates of ``{(host, segs): (n, good, bad)}``, node by node."""
    out = {}

    def grow(node, tpl, level):
        kids = {}
        for key, v in node.items():
            kids.setdefault(key[1][level], {})[key] = v
        total = [sum(v[i] for v in node.values()) for i in (1, 2)]
        nxt = {}
        for seg, k in kids.items():
            g, b = (sum(v[i] for v in k.values()) for i in (1, 2))
            m, rest = g + b, sum(total) - g - b
            p = total[1] / max(sum(total), 1)
            differs = m and rest and abs(b / m - (total[1] - b) / rest) > z * (p * (1 - p) * (1 / m + 1 / rest)) ** 0.5
            name = seg if seg == "" or seg[0] == "{" or len(kids) == 1 or differs else "*"
            for key, v in k.items():
                nxt.setdefault(f"{tpl}/{name}", {})[key] = v
        if len(node) == 1:
            (key,) = node
            out[key] = "/".join([tpl, *key[1][level:]])
            return
        for t, k in nxt.items():
            for key in k:
                if len(key[1]) <= level + 1:
                    out[key] = t
            deeper = {key: v for key, v in k.items() if len(key[1]) > level + 1}
            if deeper:
                grow(deeper, t, level + 1)

    by_host = {}
    for key, v in paths.items():
        by_host.setdefault(key[0], {})[key] = v
    for node in by_host.values():
        grow(node, "", 0)
    return out


def test_url_tree_by_recursion(spark):
    """Templates and verdicts against a tree grown node by node, with paths of up to twelve segments."""
    rnd = random.Random(3)
    pages, lab = [], []
    for i in range(900):
        host = rnd.choice(["a.net", "b.net", "c.org"])
        branch = rnd.choice(["news", "spam", "shop", "wiki", "old"])
        deep = [rnd.choice("pq") for _ in range(rnd.choice([0, 0, 1, 2, 10]))]
        pages.append((i, f"http://{host}/{branch}/{'/'.join([*deep, rnd.choice(['x', 'y', str(i)])])}"))
        lab.append((i, int(rnd.random() > (0.9 if branch == "spam" else 0.1))))
    from pyspark.sql import Row

    df = spark.createDataFrame([Row(page_id=i, url=u) for i, u in pages])
    host, path = url_filter.split_url("url")
    segs = {r.page_id: (r.h, tuple(r.s)) for r in df.select("page_id", host.alias("h"), url_filter.shape(path).alias("s")).collect()}
    good = dict(lab)
    agg = {}
    keyed = {i: (int(m[1]) if (m := re.search(r"([0-9]{1,18})[^0-9]*$", u.split("://")[1].partition("/")[2])) else None) for i, u in pages}
    for i, _ in pages:
        n, g, b = agg.get(segs[i], (0, 0, 0))
        k = good.get(keyed[i])
        agg[segs[i]] = (n + 1, g + (k == 1), b + (k == 0))
    want = plain_tree(agg, url_filter.Z)
    got = {r.page_id: r for r in url_filter.judge(df, spark.createDataFrame(lab, "page_key long, good int"), rules=()).collect()}
    assert {i: got[i].template for i in got} == {i: want[segs[i]] for i in segs}
    s, host_g, host_n, tpl_g, tpl_n = url_filter.SMOOTHING, {}, {}, {}, {}
    for (h, sg), (_, g, b) in agg.items():
        t = (h, want[h, sg])
        host_g[h], host_n[h], tpl_g[t], tpl_n[t] = host_g.get(h, 0) + g, host_n.get(h, 0) + g + b, tpl_g.get(t, 0) + g, tpl_n.get(t, 0) + g + b
    q0 = (sum(host_g.values()) + 1) / (sum(host_n.values()) + 2)
    for i, key in segs.items():
        qh = (host_g[key[0]] + s * q0) / (host_n[key[0]] + s)
        t = (key[0], want[key])
        purity = (tpl_g[t] + s * qh) / (tpl_n[t] + s)
        assert abs(got[i].purity - purity) < 2e-6 and got[i].verdict == ("block" if purity < url_filter.REJECT_BELOW else "allow")
    assert {r.verdict for r in got.values()} == {"block", "allow"} and any("*" in r.template for r in got.values())


def test_importance_weights_by_loop(spark):
    """Ratios and weights against counting words, pairs and starts one by one."""
    import numpy as np
    import pyarrow as pa

    texts = ["Good words, good words here!", "bad bad word!! here", None, "", "ümläut wörter here here"]
    x, row, n = importance.features(pa.array(texts, pa.string()))
    count = lambda t: len(re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+|[^0-9A-Za-z\x80-\U0010ffff\s]+", t or ""))
    starts = lambda t: sum(len(w.encode()) > k for k in importance.STEMS for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", t or ""))
    assert n == 5 and np.bincount(row, minlength=5).tolist() == [2 * count(t) - (count(t) > 0) + starts(t) for t in texts]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 30)], "doc_id long, text string")
    good = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(150)], "doc_id long, good int")
    model = importance.fit(docs, good)
    fold = {r.doc_id: r.f for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(importance.SEED + 1)), F.lit(5)).alias("f")).collect()}
    one = [np.bincount(x[row == i], minlength=importance.BUCKETS) for i in range(5)]
    target = sum(one[0] for i in range(0, 150, 5) if fold[i] > 0)
    raw = 30 * sum(one)
    expect = raw * (target.sum() / raw.sum())
    ratio = np.log((target + importance.PRIOR) / (expect + importance.PRIOR))
    ratio = np.sign(ratio) * np.maximum(np.abs(ratio) - importance.SHRINK / np.sqrt(expect + importance.PRIOR), 0)
    assert np.allclose(model.ratio, ratio)
    got = {r.doc_id: r.log_weight for r in importance.resample(docs, good).collect()}
    for i in range(5):
        assert abs(got[i] - (one[i] @ ratio - model.cut * one[i].sum() ** 0.5)) < 1e-6


def test_gumbel_top_k_samples_by_weight(spark):
    """Drawing one of three keeps to their weights: 0.6, 0.3, 0.1."""
    w = [0.6, 0.3, 0.1]
    df = spark.range(30_000).select(F.floor(F.col("id") / 3).alias("g"), (F.col("id") % 3).alias("i"), F.col("id").alias("doc_id"))
    import math

    log_w = F.array(*(F.lit(math.log(x)) for x in w))
    won = df.withColumn("key", F.get(log_w, F.col("i").cast("int")) + importance.gumbel("doc_id")).groupBy("g").agg(F.max_by("i", "key").alias("i")).groupBy("i").count().collect()
    assert all(abs(r["count"] / 10_000 - w[r.i]) < 0.02 for r in won)
