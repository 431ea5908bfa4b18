"""URL filter: a path-template tree per host, judged by labelled purity under explicit rules.

The tree is grown level by level on pre-aggregated paths. A segment of digits, hex
or mixed letters and digits is a variable from the start (``{n}`` and so on, with
its file extension). Below a node, literal children stay literals while they are
only ones or their labels differ from the node's, however many there are; children
whose share of bad labels does not differ from the node's (two-proportion z test)
merge into ``*``. A path alone below its node keeps its literals. A template's purity is
its share of good labels, smoothed towards the host's share, which is smoothed
towards the overall share; below ``reject_below`` the verdict is block.

Rules come first: the longest rule whose host is the url's or a parent domain and
whose path begins the url's path decides.

A null url or one without ``://`` has an empty host and path and is judged like
any other. Labels may be null or missing; of several of one page the worst counts.
Repeated pages each get their row, and count as often. Paths of any length and depth are
read whole. Of rules of equal length the one with the longer host decides, then the
least in order. Extra columns, whatever their names, are ignored. Empty tables give no
rows, or verdicts without labels: allow.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ._common import durable, split_join

#: (action, host suffix, path prefix)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
Z = 2.58
SMOOTHING = 4.0
REJECT_BELOW = 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: str) -> tuple[Column, Column]:
    """Host (ASCII lower case) and path of a url column; both empty without ``://``."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    tail = F.regexp_replace(rest, r"^[^/?#]*", "")
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(tail, r"^([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """A struct ``rule, action`` of the longest rule that fits, else null. Of equal length the longer host wins."""
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r))
    out = F.lit(None).cast("struct<rule:string,action:string>")
    for action, suffix, prefix in reversed(ranked):
        fits = ((host == suffix) | host.endswith("." + suffix)) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(suffix + prefix).alias("rule"), F.lit(action).alias("action"))).otherwise(out)
    return out


def shape(path: Column) -> Column:
    """The path's segments with variable ones generalised."""
    seg = F.split(F.regexp_replace(path, "^/", ""), "/", -1)

    def general(s: Column) -> Column:
        ext = F.regexp_extract(s, r"(\.[A-Za-z][A-Za-z0-9]{0,4})$", 1)
        stem = F.regexp_replace(s, r"\.[A-Za-z][A-Za-z0-9]{0,4}$", "")
        kind = (
            F.when(stem.rlike(r"^[0-9]+$"), F.lit("{n}"))
            .when(stem.rlike(r"^[0-9a-fA-F-]{8,}$") & stem.rlike("[0-9]"), F.lit("{hex}"))
            .when(stem.rlike(r"[0-9]"), F.lit("{mixed}"))
        )
        return F.coalesce(F.concat(kind, ext), s)

    return F.transform(seg, general)


def templates(paths: DataFrame, z: float = Z) -> DataFrame:
    """``host, segs -> template`` for ``paths(host, segs, n, good, bad)``, one row per host and shape.

    One round a level. A path that is alone below its node keeps the rest of its
    segments and leaves, so there are as many rounds as levels at which paths part.
    """
    cur, done, level = paths.select("host", "segs", "n", "good", "bad", F.lit("").alias("tpl")), [], 0
    while True:
        seg = F.get("segs", F.lit(level))
        kids = cur.groupBy("host", "tpl", seg.alias("seg")).agg(F.sum("good").alias("g"), F.sum("bad").alias("b"), F.count("*").alias("paths"))
        node = kids.groupBy("host", "tpl").agg(F.count("*").alias("kids"), F.sum("g").alias("gt"), F.sum("b").alias("bt"), F.sum("paths").alias("paths"))
        m, total = F.col("g") + F.col("b"), F.col("gt") + F.col("bt")
        p = F.col("bt") / F.greatest(total, F.lit(1))
        rest = total - m
        gap = F.abs(F.col("b") / F.greatest(m, F.lit(1)) - (F.col("bt") - F.col("b")) / F.greatest(rest, F.lit(1)))
        se = F.sqrt(p * (1 - p) * (1 / F.greatest(m, F.lit(1)) + 1 / F.greatest(rest, F.lit(1))))
        differs = (m > 0) & (rest > 0) & (gap > z * se)
        fixed = F.col("seg").startswith("{") | (F.col("seg") == "")
        name = F.when(fixed | (F.col("kids") == 1) | differs, F.col("seg")).otherwise(F.lit("*"))
        step = kids.drop("paths").join(node, ["host", "tpl"]).select("host", "tpl", "seg", F.concat("tpl", F.lit("/"), name).alias("next"), (F.col("paths") == 1).alias("alone"))
        here = F.col("segs")
        tail = F.concat("tpl", F.lit("/"), F.array_join(F.slice(here, F.lit(level + 1), F.size(here)), "/"))
        moved = durable(cur.withColumn("seg", seg).join(step, ["host", "tpl", "seg"]).select("host", "segs", "n", "good", "bad", F.when(F.col("alone"), tail).otherwise(F.col("next")).alias("tpl"), (F.col("alone") | (F.size("segs") <= level + 1)).alias("done")))
        done.append(moved.where("done").drop("done"))
        cur, level = moved.where("not done").drop("done"), level + 1
        if cur.isEmpty():
            return reduce(DataFrame.unionByName, done)


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, z: float = Z, smoothing: float = SMOOTHING, reject_below: float = REJECT_BELOW) -> DataFrame:
    """Per row of ``pages(page_id, url)``: page_id, host, path, rule, verdict, template, purity.

    ``labels(page_key, good)`` holds labels by the last number in a url's path
    (``page_key``), ``good`` 1 or 0.
    """
    host, path = split_url("url")
    p = pages.select("page_id", host.alias("host"), path.alias("path"))
    p = p.withColumn("segs", shape(F.col("path"))).withColumn("page_key", F.regexp_extract("path", r"([0-9]{1,18})[^0-9]*$", 1).try_cast("long"))
    flat = labels.where("page_key is not null and good is not null").groupBy("page_key").agg(F.min("good").alias("good"))
    seen = p.groupBy("host", "segs", "page_key").agg(F.count("*").alias("n"))
    agg = seen.join(flat, "page_key", "left").groupBy("host", "segs").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good") == 1, F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("good") == 0, F.col("n")).otherwise(0)).alias("bad"))
    tree = templates(durable(agg), z=z)
    s = F.lit(float(smoothing))
    overall = tree.agg(((F.sum("good") + 1) / (F.sum("good") + F.sum("bad") + 2)).alias("q0"))
    by_host = tree.groupBy("host").agg(F.sum("good").alias("hg"), F.sum("bad").alias("hb")).crossJoin(F.broadcast(overall)).select("host", ((F.col("hg") + s * F.coalesce("q0", F.lit(0.5))) / (F.col("hg") + F.col("hb") + s)).alias("qh"))
    by_tpl = tree.groupBy("host", "tpl").agg(F.sum("good").alias("tg"), F.sum("bad").alias("tb")).join(by_host, "host").select("host", "tpl", ((F.col("tg") + s * F.col("qh")) / (F.col("tg") + F.col("tb") + s)).alias("purity"))
    found = durable(tree.join(by_tpl, ["host", "tpl"]).select("host", "segs", F.col("tpl").alias("template"), "purity", "n"))
    r = rule_for(F.col("host"), F.col("path"), rules)
    return split_join(p, found, ["host", "segs"], "n").withColumn("r", r).select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"),
        F.coalesce(F.col("r.action"), F.when(F.col("purity") < reject_below, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "template", F.round("purity", 6).alias("purity"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = (F.coalesce("quality", F.lit(1)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), labels.select(F.col("doc_id").alias("page_key"), good.cast("int").alias("good")))


QUERIES: dict[str, Callable] = {"op10_url_filter": query}
