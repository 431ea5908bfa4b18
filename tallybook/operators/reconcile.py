"""Comparison of two sources: rankings, names and game logs.

The choice of :func:`pair_one_to_one` is greedy and so sequential within a key, which
holds one player's equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from ..functions.ratio import ratios
from ..functions.text import match_key, name_tokens, plain
from ..sources.shared import durable
from .games import ranked
from .scans import running

#: Fields of a game that a log may have otherwise.
_LOG_FIELDS = ("car", "opp_car", "ent", "day", "run")


def _ratio(a, b, least: float):
    """The sequence ratio of two keys, for whole Arrow batches at a time; below ``least`` perhaps 0."""

    @F.pandas_udf(T.DoubleType())
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        known = (x.notna() & y.notna()).to_numpy()
        out = pd.Series([None] * len(x), dtype="Float64")
        out[known] = ratios(x[known].tolist(), y[known].tolist(), least)
        return out

    return run(a, b)


def _parts(name) -> dict:
    """Of a name its key, the first two words of it, and the first with the given name's initial; the last two null if there are none."""
    key = match_key(name)
    words = F.split(key, " ")
    given = F.substring(F.trim(F.get(F.split(F.upper(plain(name)), ","), F.lit(1))), 1, 1)
    return {"key": key, "two": F.when(F.size(words) >= 2, F.array_join(F.slice(words, 1, 2), " ")), "one": F.when((words[0] != "") & (given != ""), F.concat_ws(" ", words[0], given))}


def name_score(pairs: DataFrame, a: str, b: str, least: float = 0.7) -> DataFrame:
    """``pairs`` with a score: 1 equal keys, 0.9 equal first two tokens, 0.8 equal first surname and initial, else a sequence ratio; below ``least`` dropped.

    Every two names are scored once, however often they meet. Only those that fall through
    the exact tiers reach Python, and of these only those whose letters allow the ratio
    are matched; see :mod:`..functions.ratio`.
    """
    x = pairs.select(a, b).distinct()
    for side, c in (("a", a), ("b", b)):  # a name is cleaned once, not in each pair
        x = x.join(durable(x.select(c).distinct().select(c, *(v.alias(f"_{k}{side}") for k, v in _parts(F.col(c)).items()))), c)
    x = durable(x)
    same = lambda k: F.col(f"_{k}a") == F.col(f"_{k}b")
    x = x.withColumn("_s", F.when(same("key") & (F.col("_keya") != ""), 1.0).when(same("two"), 0.9).when(same("one"), 0.8))
    tiers = x.where("_s is not null").withColumnRenamed("_s", "score")
    rest = x.where("_s is null").withColumn("score", _ratio(F.col("_keya"), F.col("_keyb"), least)).drop("_s")
    scored = durable(tiers.unionByName(rest).where(F.col("score") >= least).select(a, b, "score"))
    return pairs.join(scored, [a, b]).select(*pairs.columns, "score")


def _letters(keys: DataFrame) -> DataFrame:
    """``key, bag, first``: the letters of each key as numbers, the rarest first, the n-th of a kind a number of its own; and those of them of which a partner must share one."""
    each = F.filter(F.split("key", ""), lambda c: c != "")
    own = F.transform(each, lambda c, i: F.concat(c, F.size(F.filter(F.slice(each, F.lit(1), i + 1), lambda d: d == c)).cast("string")))
    flat = durable(keys.select("key", F.explode(own).alias("letter")))
    rare = ranked(flat.groupBy("letter").agg(F.count("*").alias("n")), ["n", "letter"], "rank")
    return flat.join(rare.select("letter", "rank"), "letter").groupBy("key").agg(F.array_sort(F.collect_list("rank")).alias("bag"))


def similar_keys(a: DataFrame, b: DataFrame, least: float = 0.7) -> DataFrame:
    """Pairs ``akey, bkey`` of ``a(key)`` and ``b(key)`` of which the letters allow a sequence ratio of ``least``; none with such a ratio is missing.

    Matching blocks hold no more letters than the keys share, so 2 * shared >= least *
    (size of a + size of b). That bounds the sizes, and of the letters in order of
    rarity a key need only be joined on so many that the rest cannot be enough.
    """
    bags = durable(_letters(a.select("key").union(b.select("key")).distinct()))
    size = F.size("bag")
    # a partner is no shorter than size * low, and then shares low * size letters or more
    low = least / (2 - least)
    bags = bags.withColumn("pre", F.slice("bag", F.lit(1), size - F.ceil(size * low - 1e-9).cast("int") + 1))
    side = lambda df, s: df.select("key").distinct().join(bags, "key").select(F.col("key").alias(f"{s}key"), F.col("bag").alias(f"{s}bag"), F.col("pre").alias(f"{s}pre"), F.explode("pre").alias("t"))
    na, nb = F.size("abag"), F.size("bbag")
    x = side(a, "a").join(side(b, "b"), "t").where(F.least(na, nb) >= F.greatest(na, nb) * low - 1e-9)
    x = x.where(F.array_min(F.array_intersect("apre", "bpre")) == F.col("t"))
    return x.where(2 * F.size(F.array_intersect("abag", "bbag")) >= least * (na + nb) - 1e-9).select("akey", "bkey")


def scored_names(official: DataFrame, computed: DataFrame, least: float = 0.7) -> DataFrame:
    """``oname, cname, score`` of all pairs of ``official(oname)`` and ``computed(cname)`` that score ``least`` or more, as :func:`name_score` has it.

    The exact tiers are joins on their keys; pairs for the ratio come from :func:`similar_keys`.
    """
    parts = lambda df, c: durable(df.select(c).distinct().select(c, *(v.alias(k) for k, v in _parts(F.col(c)).items())))
    o, k = parts(official, "oname"), parts(computed, "cname")
    pairs = None
    for on in ("key", "two", "one"):
        x = o.where(F.col(on).isNotNull()).join(k.select("cname", on), on).select("oname", "cname")
        pairs = x if pairs is None else pairs.union(x)
    like = similar_keys(o.where("key is not null"), k.where("key is not null"), least)
    near = like.join(o.select("oname", F.col("key").alias("akey")), "akey").join(k.select("cname", F.col("key").alias("bkey")), "bkey").select("oname", "cname")
    return name_score(pairs.union(near).distinct(), "oname", "cname", least)


def fuzzy_pairs(official: DataFrame, computed: DataFrame, least: float = 0.7) -> DataFrame:
    """Official names ``pos, name`` to computed ones ``cid, name``, one to one, in official order, the best score first.

    Each official name in turn takes the free computed one of the best score, of equal
    ones the first by name, then id. Distinct names are scored once, and no pair that
    scores ``least`` is missing.

    The order is kept without a sequential pass: every official name asks for its best
    remaining name, a name keeps as many of the earliest as it has ids, and later ones
    drop it, until none does. A name that is full is closed to all places behind its last
    one, which only comes forward; so the last places alone are carried from round to round.
    """
    scored = scored_names(official.select(F.col("name").alias("oname")), computed.select(F.col("name").alias("cname")), least)
    scored = durable(scored)
    named = durable(official.select("pos", F.col("name").alias("oname")))
    ids = durable(computed.select("cid", F.col("name").alias("cname"), F.row_number().over(W.partitionBy("name").orderBy("cid")).alias("k")))
    room = ids.groupBy("cname").agg(F.max("k").alias("room"))
    closed = None
    while True:
        open_to = scored.withColumn("last", F.lit(None).cast("long")) if closed is None else scored.join(closed, "cname", "left")
        likes = open_to.groupBy("oname").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "cname", "last"))).alias("likes"))
        best = F.get(F.filter("likes", lambda x: x["last"].isNull() | (F.col("pos") <= x["last"])), F.lit(0))
        asked = named.join(likes, "oname").select("pos", best.alias("b")).where("b is not null").select("pos", "b.cname", (-F.col("b.s")).alias("score"))
        asked = durable(asked.withColumn("k", F.row_number().over(W.partitionBy("cname").orderBy("pos"))).join(room, "cname"))
        if asked.where("k > room").isEmpty():
            return asked.join(ids, ["cname", "k"]).select("pos", "cid", "score")
        full = asked.where("k = room").select("cname", F.col("pos").cast("long").alias("last"))
        closed = durable(full)


def diff_rankings(official: DataFrame, computed: DataFrame) -> DataFrame:
    """Differences of two rankings ``player_id, pos, total, cells`` (an array of points per open).

    Kinds: missing_in_official, missing_in_computed, position_only, penalty_expected
    (the gap is the official negatives), total_points, per_open; equal rows are dropped.
    """
    o = official.select("player_id", F.col("pos").alias("opos"), F.col("total").alias("ototal"), F.col("cells").alias("ocells"))
    c = computed.select("player_id", F.col("pos").alias("cpos"), F.col("total").alias("ctotal"), F.col("cells").alias("ccells"))
    x = o.join(c, "player_id", "full")
    negative = F.aggregate(F.filter("ocells", lambda v: v < 0), F.lit(0).cast("long"), lambda a, v: a - v)
    kind = (
        F.when(F.col("ototal").isNull(), "missing_in_official").when(F.col("ctotal").isNull(), "missing_in_computed")
        .when((F.col("ototal") == F.col("ctotal")) & (F.col("opos") != F.col("cpos")), "position_only")
        .when((F.col("ototal") != F.col("ctotal")) & (negative > 0) & (F.abs(F.col("ototal") + negative - F.col("ctotal")) <= 1), "penalty_expected")
        .when(F.col("ototal") != F.col("ctotal"), "total_points")
        .when(~F.col("ocells").eqNullSafe(F.col("ccells")), "per_open")
    )
    return x.withColumn("kind", kind).where("kind is not null")


def reclassify(diffs: DataFrame, n_opens: int) -> DataFrame:
    """Finer kinds in this order: source_mismatch, penalty_cascade, position_cascade."""
    used = lambda cells: F.filter(F.transform(cells, lambda v, i: F.when(v > 0, i)), lambda v: v.isNotNull())
    kind = F.when(F.col("kind").isin("total_points", "per_open") & (used("ocells") != used("ccells")), "source_mismatch").otherwise(F.col("kind"))
    x = diffs.withColumn("kind", kind)
    gap = F.col("ototal") - F.col("ctotal")
    x = x.withColumn("kind", F.when((F.col("kind") == "total_points") & gap.between(-2 * n_opens, 0), "penalty_cascade").otherwise(F.col("kind")))
    moved = x.where(~F.col("kind").isin("position_only", "per_open") & F.col("cpos").isNotNull()).select(F.col("cpos").alias("c"), F.coalesce("opos", F.lit(2**31)).cast("long").alias("o"))
    p = x.where("kind = 'position_only'").select("player_id", F.col("cpos").alias("c"), F.col("opos").cast("long").alias("o"))
    net = _passed(p, moved)
    x = x.join(net, "player_id", "left")
    return x.withColumn("kind", F.when((F.col("kind") == "position_only") & (F.coalesce("net", F.lit(0)) == F.col("cpos") - F.col("opos")), "position_cascade").otherwise(F.col("kind"))).drop("net")


def _passed(rows: DataFrame, moved: DataFrame) -> DataFrame:
    """For ``rows(player_id, c, o)`` the ``moved(c, o)`` that stand before in ``c`` and behind in ``o``, less those behind in ``c`` and before in ``o``.

    That is the number before in ``c`` less the number before in ``o`` (equal places
    aside), so two counts of smaller values do, and no pair is formed.
    """
    before = lambda on: _count_below(rows.select("player_id", F.col(on).alias("v")), moved.select(F.col(on).alias("v")))
    equal = rows.join(moved.groupBy("c", F.col("o").alias("mo")).agg(F.count("*").alias("e")), "c").where("mo < o").groupBy("player_id").agg(F.sum("e").alias("on_c"))
    level = rows.join(moved.groupBy("o", F.col("c").alias("mc")).agg(F.count("*").alias("e")), "o").where("mc < c").groupBy("player_id").agg(F.sum("e").alias("on_o"))
    x = before("c").withColumnRenamed("n", "nc").join(before("o").withColumnRenamed("n", "no"), "player_id").join(equal, "player_id", "left").join(level, "player_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return x.select("player_id", (F.col("nc") - zero("on_o") - F.col("no") + zero("on_c")).alias("net"))


def _count_below(rows: DataFrame, values: DataFrame) -> DataFrame:
    """For ``rows(player_id, v)`` the number of ``values(v)`` below, by one running count over both in order."""
    both = values.select(F.lit(None).cast("long").alias("player_id"), "v", F.lit(1).alias("one")).unionByName(rows.select("player_id", "v", F.lit(0).alias("one")))
    return running(both, [], ["v", "one", "player_id"], n=("sum", F.col("one"))).where("one = 0").select("player_id", "n")


def report(diffs: DataFrame) -> DataFrame:
    """Counts by kind in report order."""
    order = ["missing_in_official", "missing_in_computed", "total_points", "per_open", "position_only", "penalty_expected", "source_mismatch", "penalty_cascade", "position_cascade"]
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("kind"))
    return diffs.groupBy("kind").agg(F.count("*").alias("n")).select("kind", "n", rank.alias("rank"))


def attach_decisions(diffs: DataFrame, decisions: DataFrame) -> DataFrame:
    """A human decision per difference: of the same player and kind, else the player's latest."""
    d = decisions.groupBy("player_id", "kind").agg(F.max_by("decision", "updated_at").alias("d1"))
    a = decisions.groupBy("player_id").agg(F.max_by("decision", "updated_at").alias("d2"))
    return diffs.join(d, ["player_id", "kind"], "left").join(a, "player_id", "left").select("player_id", "kind", F.coalesce("d1", "d2").alias("decision"))


def same_opens(mapping: DataFrame, official: DataFrame, window: DataFrame, sheet: list[str]) -> DataFrame:
    """For every sheet whether both lists are equally long and every open has found its own partner."""
    n = lambda df, c: df.groupBy(*sheet).agg(F.count("*").alias(c))
    x = n(official, "o").join(n(window, "w"), sheet, "full").join(n(mapping, "m"), sheet, "left")
    return x.select(*sheet, ((F.coalesce("o", F.lit(0)) == F.coalesce("w", F.lit(0))) & (F.coalesce("o", F.lit(0)) == F.coalesce("m", F.lit(0)))).alias("same"))


def _log_rows(federation: DataFrame, own: DataFrame, cols: list[str]) -> DataFrame:
    """Both logs as one table; ``own`` tells them apart."""
    return federation.select(F.lit(False).alias("own"), "id", *cols).unionByName(own.select(F.lit(True).alias("own"), "id", *cols))


def _with_near(rows: DataFrame, by: list[str], days: int, fields: list[str]) -> DataFrame:
    """``rows`` with the number of their ``day``, ``at``, and ``near``: the rows of the other log of equal ``by`` (not null) at most ``days`` apart."""
    x = rows.withColumn("at", F.datediff("day", F.lit("1970-01-01").cast("date")))
    known = reduce(Column.__and__, (F.col(c).isNotNull() for c in ("at", *by)))
    mate = F.struct("id", "at", *fields)
    w = W.partitionBy(*by).orderBy("at").rangeBetween(-days, days)
    lists = [F.collect_list(F.when(known & side, mate)).over(w) for side in (F.col("own"), ~F.col("own"))]
    # rows without a day or a key share their window with such only; a condition here would part the two uses of the shuffled rows
    return x.withColumns({"_o": lists[0], "_f": lists[1]}).withColumn("near", F.when(F.col("own"), F.col("_f")).otherwise(F.col("_o"))).drop("_o", "_f")


def _changed(x, y):
    """Names of the fields that differ, comma-joined."""
    return F.array_join(F.filter(F.array(*(F.when(~x[c].eqNullSafe(y[c]), F.lit(c)) for c in _LOG_FIELDS)), lambda v: v.isNotNull()), ",")


def _free(keys: list[str]):
    """Of candidates that come by key, the nearest first, whether both rows are still free: a pass over a task's batches."""

    @F.pandas_udf(T.BooleanType())
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        key, used_a, used_b = None, set(), set()  # what is used is forgotten when the key changes
        for a_s, b_s, *k_s in batches:
            taken = []
            for a, b, *k in zip(a_s, b_s, *k_s, strict=True):
                if k != key:
                    key, used_a, used_b = k, set(), set()
                taken.append(free := a not in used_a and b not in used_b)
                if free:
                    used_a.add(a), used_b.add(b)
            yield pd.Series(taken, dtype=bool)

    return run.asNondeterministic()("a", "b", *keys)  # it counts on the order, so no plan may move it


def _pairs(rows: DataFrame, keys: list[str], days: int, names: bool, changed: bool) -> DataFrame:
    """Pairs of :func:`pair_one_to_one` of the rows of both logs, with their keys, and on demand with what differs.

    Rows lie by ``keys`` or some of them; a window finds their candidates there, so no row is
    copied into bins. The greedy choice is one pass over the sorted candidates of many keys,
    and leaves them where they lie.
    """
    tokens = name_tokens(F.col("opp")) if names else F.lit(None).cast("array<string>")
    other = ~F.coalesce(F.size(F.array_intersect("tokens", "n.tokens")) >= 2, F.lit(False))
    what = _changed({c: F.col(c) for c in _LOG_FIELDS}, {c: F.col("n")[c] if c not in keys else F.col(c) for c in _LOG_FIELDS}) if changed else F.lit(None).cast("string")
    x = _with_near(rows.withColumn("tokens", tokens), keys, days, ["tokens", *(c for c in _LOG_FIELDS if changed and c not in keys)])
    cand = x.where(~F.col("own") & (F.size("near") > 0)).withColumn("n", F.explode("near"))
    cand = cand.select(*keys, F.col("id").alias("a"), F.col("n.id").alias("b"), F.abs(F.col("n.at") - F.col("at")).alias("gap"), other.cast("int").alias("other"), what.alias("changed"))
    return cand.sortWithinPartitions(*keys, "other", "gap", "a", "b").withColumn("taken", _free(keys)).where("taken").drop("other", "taken")


def pair_one_to_one(left: DataFrame, right: DataFrame, keys: list[str], days: int, names: bool = False) -> DataFrame:
    """Rows of two logs paired one to one: equal ``keys``, days at most ``days`` apart, nearest first.

    Both: id, day and the keys (not null); with ``names`` also opp, and pairs whose
    opponents' names match come before the others.
    """
    rows = _log_rows(left, right, [*keys, "day", *(["opp"] if names else [])])
    return _pairs(rows, keys, days, names, False).select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "gap")


@contextmanager
def _joined_where_they_lie(spark: SparkSession):
    """Rows that lie by some of a join's keys are not shuffled anew by all of them."""
    conf = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "false")
    try:
        yield
    finally:
        spark.conf.set(conf, before)


def reconcile_log(federation: DataFrame, own: DataFrame, days: int = 60, near: int = 2) -> DataFrame:
    """Federation games against players' own logs: ``update`` with the changed fields, ``same`` or ``insert``.

    Both: id, player_id, discipline, car, opp_car, ent, opp (the opponent's name), day,
    run; a player has an id once in each. First games of equal scores pair up, those of
    matching names first, then by the nearest day. Of the rest a game and an entry against
    the same opponent pair up within ``near`` days, if neither has another partner; what
    differs there is mistyped.
    """
    return reconcile_rows(_log_rows(federation, own, ["player_id", "discipline", "opp", *_LOG_FIELDS]), days, near)


def reconcile_rows(rows: DataFrame, days: int = 60, near: int = 2, tasks: int | None = None) -> DataFrame:
    """The same of both logs in one table, where ``own`` tells the players' from the federation's.

    Rows are shuffled once, by player and discipline, into ``tasks`` where given: both rounds find
    their pairs where they lie. Where a key has two rows these are each other's only candidates;
    the greedy choice is for keys of more, and its pairs alone move.
    """
    by, keys = ["player_id", "discipline"], ["player_id", "discipline", "car", "opp_car"]
    rows = rows.repartition(*([tasks] if tasks else []), *by).withColumn("at", F.datediff("day", F.lit("1970-01-01").cast("date")))
    mate, of_key = F.struct("id", "at", *(c for c in _LOG_FIELDS if c not in keys)), W.partitionBy(*keys)
    known = reduce(Column.__and__, (F.col(c).isNotNull() for c in ("at", *keys)))
    sides = {c: F.max(F.when(known & side, mate)).over(of_key) for c, side in (("_o", F.col("own")), ("_f", ~F.col("own")))}
    rows = rows.withColumns({"many": F.count("*").over(of_key) > 2} | sides)
    only = F.when(F.col("own"), F.col("_f")).otherwise(F.col("_o"))
    only = F.when(~F.col("many") & known & (F.abs(only["at"] - F.col("at")) <= days), only)
    pairs = _pairs(rows.where("many").drop("at", "many", *sides), keys, days, True, True).select(*(F.col(k).alias(f"_{k}") for k in keys), "a", "b", F.col("changed").alias("what"))
    # a row meets its pair where its key lies: the id is no key of the join
    mine = F.when(F.col("own"), F.col("b")).otherwise(F.col("a")) == F.col("id")
    x = rows.withColumn("only", only).join(pairs, reduce(Column.__and__, (F.col(k) == F.col(f"_{k}") for k in keys)) & mine, "left")
    rest = F.col("a").isNull() & F.col("only").isNull()
    what = F.when(F.col("only").isNotNull(), _changed({c: F.col(c) for c in _LOG_FIELDS}, {c: F.col("only")[c] if c not in keys else F.col(c) for c in _LOG_FIELDS}))
    # a row with a partner goes on without a day, so that none is near it
    y = x.where(~F.col("own") | rest).select("own", "id", *by, F.coalesce("b", "only.id").alias("b"), F.coalesce("what", what).alias("what"), *(F.when(rest, F.col(c)).alias(c) for c in ("opp", *_LOG_FIELDS)))
    match = lambda m: F.size(F.array_intersect(F.col("tokens"), m["tokens"])) >= 2
    y = y.withColumn("tokens", name_tokens(F.col("opp"))).drop("opp")
    y = _with_near(y, by, near, ["tokens"]).withColumn("n", F.coalesce(F.size(F.filter("near", match)), F.lit(0)))
    y = _with_near(y.drop("near", "at"), by, near, ["tokens", "n", *_LOG_FIELDS]).where("not own")
    y = y.withColumn("m", F.when(F.col("n") == 1, F.get(F.filter(F.filter("near", match), lambda m: m["n"] == 1), F.lit(0))))
    found = F.when(F.col("m").isNotNull(), _changed({c: F.col(c) for c in _LOG_FIELDS}, {c: F.col("m")[c] for c in _LOG_FIELDS}))
    done = y.select("player_id", F.col("id").alias("game_id"), F.coalesce("b", "m.id").alias("own_id"), F.coalesce("what", found).alias("changed"))
    action = F.when(F.col("own_id").isNull(), "insert").when(F.col("changed") == "", "same").otherwise("update")
    with _joined_where_they_lie(rows.sparkSession):
        return durable(done.select("player_id", "game_id", "own_id", action.alias("action"), "changed"))


def member_sets(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Union, intersection or difference of two sets of players."""
    a, b = a.select("player_id"), b.select("player_id")
    return {"union": lambda: a.union(b).distinct(), "intersect": lambda: a.intersect(b), "except": lambda: a.distinct().exceptAll(b.distinct())}[how]()


def player_sheet(summary: DataFrame, marks: DataFrame, podium: DataFrame) -> DataFrame:
    """One nested row per player: totals, ranking marks per discipline, podiums in order."""
    s = summary.groupBy("player_id").agg(F.sort_array(F.collect_list(F.struct("discipline", "n", "won", "car", "ent"))).alias("totals"))
    m = marks.groupBy("player_id").agg(F.sort_array(F.collect_list(F.struct("discipline", "pos", "avg", "best_pos", "best_avg"))).alias("rankings"))
    p = podium.groupBy("player_id").agg(F.sort_array(F.collect_list(F.struct("season", "pos", "open_id"))).alias("podiums"))
    return s.join(m, "player_id", "left").join(p, "player_id", "left")
