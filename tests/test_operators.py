"""Operators on literal rows, with values worked out by hand or by a plain loop."""

import datetime as dt
import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tallybook.functions import seasons as S, text as T
from tallybook.operators import brackets as B, clubs as C, games as G, merge as M, ratings as X, reconcile as Q, repair as P, tournaments as TT
from tallybook.plans.adapter import tables


def col(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in sorted(df.select("i", fn(F.col("v")).alias("o")).collect())]


def test_names(spark):
    assert col(spark, ["  Núria   PUIG ", None], T.norm_name) == ["nuria puig", None]
    assert col(spark, ["SR. DON HDEZ, ARMANDO", "SR", "Puig"], T.match_key) == ["HERNANDEZ ARMAND", "", "PUIG"]
    assert col(spark, ["DE LA VALL SERRA, PERE", "ROCA"], T.title_name) == ["Pere de la Vall Serra", "Roca"]
    assert col(spark, ['B.C. X "A"', "cap", "", "C.B. Y"], T.extract_club) == ["B.C. X", None, None, "C.B. Y"]
    assert col(spark, ["C.B. VILANOVA", 'SANTA ADRIÀ "D"', "CB"], T.canonical_club_key) == ["VILANOVA", "SANTADRIA", "CB"]
    assert [tuple(x) for x in col(spark, ["BANYOLES", "SANTS “B”", "01 X A"], T.split_team)] == [("BANYOLES", "UNICO"), ("SANTS", "B"), ("X", "A")]
    assert col(spark, ["4ª DIVISIÓ", "PROMOCIÓ A 3a", None], T.norm_division) == ["4a", "Promoció a 3a", None]
    assert col(spark, ["FINAL FOUR B", "GRUP Z", "UNIC"], T.norm_group) == ["Final Four B", "Z", "Únic"]
    assert col(spark, ["MEMORIAL X - ÚNICA", "TRES BANDES - 1A DIVISIÓ"], T.clean_tournament) == ["MEMORIAL X", "TRES BANDES - 1A DIVISIÓ"]


def test_dates_and_points(spark):
    d = [dt.date(2024, 7, 28), dt.date(2024, 12, 31), dt.date(2024, 3, 3), dt.date(2024, 8, 1)]
    assert col(spark, d, S.ranking_month, "date") == [dt.date(2024, 9, 1), dt.date(2025, 1, 1), dt.date(2024, 3, 1), dt.date(2024, 9, 1)]
    assert col(spark, d, S.season_of, "date") == ["2023-2024", "2024-2025", "2023-2024", "2024-2025"]
    assert col(spark, [0, 1, 3, 4, 80, 96, 97, 128, 500], S.points_for_position, "int") == [None, 180, 155, 155, 34, 25, 18, 15, 12]
    assert col(spark, [1, 12, 20], lambda c: S.points_for_position(c, "women_open"), "int") == [100, 14, 14]


def buckets_by_hand(games, n=8):
    """Each cut moves on to the first place where the rating changes; a game's bucket is the number of cuts before it."""
    games = sorted(games, key=lambda g: g[1])
    total = len(games)
    changes = [i for i in range(1, total) if games[i][1] != games[i - 1][1]]
    cuts = {min((i for i in changes if i >= round(k * total / n)), default=None) for k in range(1, n)} - {None}
    out = {}
    for i, (result, _) in enumerate(games):
        won, lost = out.setdefault(sum(c <= i for c in cuts), [0, 0])
        out[sum(c <= i for c in cuts)] = [won + (result == 1), lost + (result == -1)]
    return [(b, w, x) for b, (w, x) in sorted(out.items())]


def test_rating_buckets(spark):
    rnd, rows, want = random.Random(1), [], {}
    for p in range(60):
        g = [(rnd.choice([1, 0, -1]), rnd.choice([0.1, 0.2, 0.3, 0.5, 0.8, 1.1]) if p % 2 else rnd.random()) for _ in range(rnd.randint(1, 40))]
        rows += [(p, 1, a, b) for a, b in g]
        want[p] = buckets_by_hand(g)
    b = X.rating_buckets(spark.createDataFrame(rows, "player_id int, discipline int, result int, rating double")).collect()
    got = {}
    for x in sorted(b, key=lambda x: x.bucket):
        got.setdefault(x.player_id, []).append((x.bucket, x.won, x.lost))
    assert got == want


def test_index_and_crossover(spark):
    r = spark.createDataFrame([(1, 1, 1, 1.0), (1, 1, -1, 0.5), (2, 1, 0, 1.0)], "player_id int, discipline int, result int, rating double")
    assert {x.player_id: x.idx for x in X.weighted_index(r).collect()} == {1: 66.7, 2: None}
    b = spark.createDataFrame([(1, 1, 0, 0.4, 0.6, 3, 1), (1, 1, 1, 0.8, 1.0, 1, 3)], "player_id int, discipline int, bucket int, lo double, hi double, won int, lost int")
    assert X.crossover(b).first().crossover == 0.7


def test_select_last_by_hand(spark):
    rnd, rows = random.Random(2), []
    for p in range(40):
        rows += [(p, 1, i + 100 * p, dt.date(2024, 1, rnd.randint(1, 9)), rnd.randint(0, 40), 20) for i in range(rnd.randint(3, 22))]
    got = {}
    for x in M.select_last(spark.createDataFrame(rows, "player_id int, discipline int, game_id int, played_on date, car int, ent int")).collect():
        got.setdefault(x.player_id, set()).add(x.game_id)
    for p in range(40):
        g = sorted((x for x in rows if x[0] == p), key=lambda x: (-x[3].toordinal(), x[2]))
        keep = g[:15]
        if len(g) > 15 and g[14][3] == g[15][3] and g[15][4] > g[14][4]:
            keep = g[:14] + [g[15]]
        assert got[p] == {x[2] for x in keep}


def test_merge_is_idempotent(spark):
    base = spark.createDataFrame([(1, None, 5), (2, 7, None)], "k int, a int, b int")
    delta = spark.createDataFrame([(1, 3, None, 1), (3, 9, 9, 1), (1, 4, None, 2)], "k int, a int, b int, ord int")
    once = M.merge_coalesce(base, delta, ["k"])
    assert sorted(map(tuple, once.collect())) == [(1, 4, 5), (2, 7, None), (3, 9, 9)]
    assert sorted(map(tuple, M.merge_coalesce(once, delta, ["k"]).collect())) == sorted(map(tuple, once.collect()))


def test_stints_and_mapping(spark):
    s = spark.createDataFrame([(1, 2001, 5), (1, 2002, 5), (1, 2004, 5), (1, 2005, 6)], "player_id int, sy int, club_id int")
    assert sorted((x.club_id, x.since, x.until) for x in G.stints(s).collect()) == [(5, 2001, 2002), (5, 2004, 2004), (6, 2005, 2005)]
    m = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "a string, b string")
    assert {x.a: x.b for x in C.close_mapping(m).collect()} == {"a": "d", "b": "d", "c": "d"}


def test_seed_allocation_covers_all(spark):
    t = spark.createDataFrame([(n, n) for n in (64, 66, 96, 100, 126, 128, 63, 130)], "open_id int, n int")
    rows = TT.seed_allocation(t).collect()
    for n in (64, 66, 96, 100, 126, 128):
        mine = [r for r in rows if r.open_id == n]
        assert sorted(r.seed for r in mine) == list(range(1, n + 1))
        assert len({(r.phase, r.grp, r.slot) for r in mine}) == n
    assert {r.open_id for r in rows if r.phase == "unsupported"} == {63, 130}


def test_link_games_by_loop(spark):
    rnd = random.Random(3)
    games = [(i, rnd.choice([1, 2]), rnd.choice(["s1", "s2"]), *rnd.sample(range(3), 2), rnd.randint(0, 2), rnd.randint(0, 2), rnd.randint(0, 1), rnd.randint(0, 1), 10) for i in range(80)]
    rows = [(i, f"t{i % 4}", rnd.choice([None, 1, 2]), rnd.choice(["s1", "s2"]), *rnd.sample(range(3), 2), rnd.randint(0, 2), rnd.randint(0, 2), rnd.randint(0, 1), rnd.randint(0, 1), rnd.choice([None, 10]), i) for i in range(60)]
    want = {}
    hits = {}
    for r in rows:
        h = [g for g in games if {g[3], g[4]} == {r[4], r[5]} and (r[2] is None or r[2] == g[1]) and sorted(g[5:7]) == sorted(r[6:8])]
        same = [g for g in h if sorted(g[7:9]) == sorted(r[8:10])]
        for g in same or h:
            hits.setdefault(g[0], []).append((r[3] != g[2], r[11], r[0]))
    want = {g: min(h)[2] for g, h in hits.items()}
    gd = spark.createDataFrame(games, "game_id int, discipline int, season string, p1 int, p2 int, car1 int, car2 int, run1 int, run2 int, ent int")
    rd = spark.createDataFrame(rows, "row_id int, tournament string, discipline int, season string, a int, b int, car_a int, car_b int, run_a int, run_b int, ent int, ord int")
    assert {x.game_id: x.row_id for x in TT.link_games(rd, gd).collect()} == want


def test_classification_places(spark):
    m = [(1, 1, "group", 0, 1, 1, 2, 10, 5, 3, 2, 2, 0, 10, True), (1, 1, "group", 0, 2, 1, 3, 10, 6, 3, 2, 2, 0, 10, True), (1, 1, "group", 0, 3, 2, 3, 7, 8, 3, 2, 0, 2, 10, True),
         (1, 2, "ko", None, 4, 1, 4, 10, 9, 3, 2, 2, 0, 10, True), (1, 2, "ko", None, 5, 5, 6, 9, 10, 3, 2, 0, 2, 10, True), (1, 3, "ko", None, 6, 1, 6, 10, 9, 3, 2, 2, 0, 10, True)]
    df = spark.createDataFrame([(*x, x[4]) for x in m], "open_id int, phase int, kind string, grp int, game_id int, a int, b int, car_a int, car_b int, run_a int, run_b int, pts_a int, pts_b int, ent int, is_played boolean, ord int")
    got = {r.player_id: r.pos for r in B.classification(df).collect()}
    assert got == {1: 1, 6: 2, 5: 3, 4: 4, 3: 5, 2: 6}


def test_ko_remarks(spark):
    df = spark.createDataFrame([(1, 2, 1, 1, 5, 5, "GANA GIMÉNEZ POR 1-0", "GIMENEZ, ANA", "PUIG, PERE", True)], "a int, b int, pts_a int, pts_b int, car_a int, car_b int, remarks string, name_a string, name_b string, is_played boolean")
    assert B.ko_winner(df).first().winner == 1


def test_name_scores_and_pairs(spark):
    x = spark.createDataFrame([("PUIG VILA, ANNA", "Puig Vilà Anna"), ("PUIG VILA, ANNA", "PUIG SOLE, ALBA"), ("PUIG VILA, ANNA", "ROIG, TOM")], "a string, b string")
    assert sorted(round(r.score, 1) for r in Q.name_score(x, "a", "b").collect()) == [0.8, 1.0]
    left = spark.createDataFrame([(1, "k", dt.date(2024, 1, 1)), (2, "k", dt.date(2024, 1, 9))], "id long, k string, day date")
    right = spark.createDataFrame([(7, "k", dt.date(2024, 1, 8)), (8, "k", dt.date(2024, 5, 8))], "id long, k string, day date")
    assert [(r.a, r.b) for r in Q.pair_one_to_one(left, right, ["k"], 60).collect()] == [(2, 7)]


def plain_key(name):
    x = " ".join(re.sub("[^A-Z0-9]+", " ", name.upper().translate(str.maketrans(T.ACCENTED, T.PLAIN))).split())
    return x


def plain_score(a, b):
    ka, kb = plain_key(a), plain_key(b)
    given = lambda n: (n.split(",") + [""])[1].strip()[:1].upper()
    ta, tb = ka.split(), kb.split()
    if ka and ka == kb:
        return 1.0
    if len(ta) > 1 and len(tb) > 1 and ta[:2] == tb[:2]:
        return 0.9
    if ta and tb and ta[0] == tb[0] and given(a) and given(a) == given(b):
        return 0.8
    return SequenceMatcher(None, ka, kb).ratio()


def some_names(rnd, n):
    surnames, given = "MARTIN PUIG VILA FERRER ROIG SOLE GARCIA MONTERO CASALS".split(), "JOSEP ANNA MARIA PERE NURIA JOAN".split()
    return [f"{rnd.choice(surnames)} {rnd.choice(surnames)}, {rnd.choice(given)}" for _ in range(n)]


def mistyped(rnd, name):
    k = rnd.randrange(4)
    at = rnd.randrange(len(name))
    return name if k == 0 else name[:at] + rnd.choice("AEIX") + name[at:] if k == 1 else name[:at] + name[at + 1 :] if k == 2 else name.replace(",", "")


def test_name_scores_by_loop(spark):
    rnd = random.Random(8)
    a = some_names(rnd, 60)
    pairs = [(x, mistyped(rnd, y)) for x in a for y in rnd.sample(a, 12)]
    got = sorted((r.a, r.b, round(r.score, 9)) for r in Q.name_score(spark.createDataFrame(pairs, "a string, b string"), "a", "b").collect())
    assert got == sorted((x, y, round(plain_score(x, y), 9)) for x, y in pairs if plain_score(x, y) >= 0.7)


def test_fuzzy_pairs_by_loop(spark):
    """Against a pass over all official names in order, each with all computed ones."""
    rnd = random.Random(9)
    computed = list(enumerate(some_names(rnd, 70)))
    official = [(i, mistyped(rnd, n)) for i, (_, n) in enumerate(rnd.sample(computed, 60))]
    free, want = dict(computed), {}
    for pos, name in official:
        best = min(((-plain_score(name, n), n, cid) for cid, n in free.items() if plain_score(name, n) >= 0.7), default=None)
        if best:
            want[pos] = best[2]
            del free[best[2]]
    got = Q.fuzzy_pairs(spark.createDataFrame(official, "pos long, name string"), spark.createDataFrame(computed, "cid long, name string"))
    assert {r.pos: r.cid for r in got.collect()} == want and len(want) > 40


def plain_pairs(left, right, keys, days, names):
    cand = []
    for a in left:
        for b in right:
            gap = abs((a["day"] - b["day"]).days)
            if gap <= days and all(a[k] == b[k] for k in keys):
                words = lambda x: {w for w in re.split("[^a-z0-9]+", x["opp"].lower()) if len(w) > 1}
                cand.append((int(not (names and len(words(a) & words(b)) > 1)), gap, a["id"], b["id"]))
    used_a, used_b, out = set(), set(), {}
    for _, _, a, b in sorted(cand):
        if a not in used_a and b not in used_b:
            used_a.add(a), used_b.add(b)
            out[a] = b
    return out


def test_logs_by_loop(spark):
    """Pairs and actions against a loop over all pairs of two logs, with mistyped scores in a few."""
    rnd = random.Random(10)
    names = ["PUIG VILA, ANNA", "ROIG SOLE, PERE", "MARTIN PUIG, JOAN"]
    fields = "id long, player_id int, discipline int, car int, opp_car int, ent int, opp string, day date, run int"
    row = lambda i: dict(id=i, player_id=rnd.randrange(3), discipline=1, car=rnd.randrange(3), opp_car=rnd.randrange(2), ent=10, opp=rnd.choice(names), day=dt.date(2024, 1, 1) + dt.timedelta(rnd.randrange(300)), run=rnd.randrange(3))
    fed = [row(i) for i in range(120)]
    own = []
    for f in fed:
        if rnd.random() < 0.8:
            shift = rnd.choice([0, 0, 1, 30, 100])
            car = f["car"] + (9 if rnd.random() < 0.2 else 0)
            own.append({**f, "id": f["id"] + 1000, "day": f["day"] + dt.timedelta(1 if car > 8 else shift), "run": rnd.choice([f["run"], None]), "car": car})
    frames = [spark.createDataFrame([tuple(x.values()) for x in rows], fields) for rows in (fed, own)]
    keys = ["player_id", "discipline", "car", "opp_car"]
    assert {r.a: r.b for r in Q.pair_one_to_one(*frames, [*keys, "ent"], 60).collect()} == plain_pairs(fed, own, [*keys, "ent"], 60, False)
    m = plain_pairs(fed, own, keys, 60, True)
    rest_f, rest_o = [f for f in fed if f["id"] not in m], [o for o in own if o["id"] not in m.values()]
    near = [(f["id"], o["id"]) for f in rest_f for o in rest_o if f["player_id"] == o["player_id"] and f["opp"] == o["opp"] and abs((f["day"] - o["day"]).days) <= 2]
    m |= {a: b for a, b in near if sum(x == a for x, _ in near) == 1 and sum(y == b for _, y in near) == 1}
    by_id, want = {o["id"]: o for o in own}, {}
    for f in fed:
        o = by_id.get(m.get(f["id"]))
        changed = [k for k in ("car", "opp_car", "ent", "day", "run") if o and o[k] != f[k]]
        want[f["id"]] = (None, "insert", None) if o is None else (o["id"], "update" if changed else "same", ",".join(changed))
    got = {r.game_id: (r.own_id, r.action, r.changed) for r in Q.reconcile_log(*frames).collect()}
    assert got == want and {v[1] for v in want.values()} == {"insert", "update", "same"} and any("car" in (v[2] or "").split(",") for v in want.values())


def test_player_sheet_by_loop(spark, sf):
    import __spark_entry__ as entry

    q = entry.queries()
    sheet = {r.player_id: r for r in q["g29_player_sheet"](spark, sf).collect()}
    totals, podiums = {}, {}
    for r in q["g02_player_summary"](spark, sf).collect():
        totals.setdefault(r.player_id, []).append((r.discipline, r.n, r.won, r.car, r.ent))
    for r in q["g27_podiums"](spark, sf).collect():
        podiums.setdefault(r.player_id, []).append((r.season, r.pos, r.open_id))
    assert set(sheet) == set(totals) and podiums
    for p, r in sheet.items():
        assert list(map(tuple, r.totals)) == sorted(totals[p]) and list(map(tuple, r.podiums or [])) == sorted(podiums.get(p, []))
    ranked = {}
    for e in tables(spark, sf, "ranking_entries")[0].collect():
        ranked.setdefault((e.player_id, e.discipline), []).append(e)
    for p, r in sheet.items():
        for m in r.rankings or []:
            mine = ranked[p, m.discipline]
            last = max(mine, key=lambda e: e.seq)
            assert (m.pos, m.avg, m.best_pos, m.best_avg) == (last.pos, last.avg, min(e.pos for e in mine), max(e.avg for e in mine))
        assert len(r.rankings or []) == sum(k[0] == p for k in ranked)


def test_classification_by_loop(spark):
    """Knock-out rounds of random opens: losers of a round stand below the places of the next, by average, run and id; the last winner is first."""
    rnd = random.Random(11)
    rows, want = [], {}
    for o in range(6):
        size = rnd.choice([4, 8, 16])
        alive, phase, n = list(range(size)), 1, 0
        rounds = rnd.choice([size.bit_length() - 1, size.bit_length() - 1, 2])
        places = {}
        while len(alive) > 1 and phase <= rounds:
            rnd.shuffle(alive)
            losers, nxt = [], []
            for a, b in zip(alive[::2], alive[1::2], strict=True):
                n += 1
                ca, cb = rnd.sample(range(5, 30), 2)
                rows.append(dict(open_id=o, phase=phase, kind="ko", grp=None, game_id=100 * o + n, a=a, b=b, car_a=ca, car_b=cb, run_a=rnd.randrange(9), run_b=rnd.randrange(9), pts_a=2 * (ca > cb), pts_b=2 * (cb > ca), ent=10, is_played=True, ord=n))
                r = rows[-1]
                win, lose = ("a", "b") if ca > cb else ("b", "a")
                nxt.append(r[win])
                losers.append((-r[f"car_{lose}"] / 10, -r[f"run_{lose}"], r[lose]))
            above = len(alive) // 2 if len(alive) > 2 else 1
            above = above if phase < rounds or len(alive) == 2 else 1
            for k, x in enumerate(sorted(losers)):
                places[x[2]] = above + 1 + k
            alive, phase = nxt, phase + 1
        if len(alive) == 1:
            places[alive[0]] = 1
            want[o] = places
    fields = "open_id int, phase int, kind string, grp int, game_id int, a int, b int, car_a int, car_b int, run_a int, run_b int, pts_a int, pts_b int, ent int, is_played boolean, ord int"
    got = {}
    for r in B.classification(spark.createDataFrame([tuple(r.values()) for r in rows], fields)).collect():
        got.setdefault(r.open_id, {})[r.player_id] = r.pos
    assert len(want) >= 2 and all(got[o] == want[o] for o in want)
    assert all(len(set(p.values())) == len(p) for p in got.values())


def test_classification_of_all_opens(spark, sf):
    """On the derived opens, whose matches are no real brackets: every player once, with the points of the place."""
    got = {}
    for r in B.classification(tables(spark, sf, "open_matches")[0]).collect():
        got.setdefault(r.open_id, []).append(r)
    assert got and all(len({r.player_id for r in rows}) == len(rows) and min(r.pos for r in rows) >= 1 for rows in got.values())
    table = {1: 180, 2: 165, 3: 155, 4: 155}
    assert all(r.points == table.get(r.pos, r.points) for rows in got.values() for r in rows)


def test_reclassified_by_loop(spark):
    """Net moves past a player by comparing it with every moved row."""
    rnd = random.Random(12)
    kinds = ["position_only", "missing_in_official", "total_points", "penalty_expected"]
    rows = [(i, rnd.choice([None, rnd.randrange(1, 40)]) if (k := rnd.choice(kinds)) == "missing_in_official" else rnd.randrange(1, 40), rnd.randrange(1, 40), 100, 50, [1], [1], k) for i in range(200)]
    df = spark.createDataFrame(rows, "player_id long, opos int, cpos int, ototal long, ctotal long, ocells array<long>, ccells array<long>, kind string")
    moved = [(r[2], r[1]) for r in rows if r[7] != "position_only"]
    want = {}
    for r in rows:
        net = sum(c < r[2] and (o is None or o > r[1]) for c, o in moved) - sum(c > r[2] and o is not None and o < r[1] for c, o in moved) if r[7] == "position_only" else 0
        want[r[0]] = "position_cascade" if r[7] == "position_only" and net == r[2] - r[1] else r[7]
    assert {r.player_id: r.kind for r in Q.reclassify(df, 0).collect()} == want


def test_ranks_in_two_steps(spark):
    rnd = random.Random(13)
    rows = [(i, rnd.randrange(20)) for i in range(500)]
    got = {r.i: r.k for r in G.ranked(spark.createDataFrame(rows, "i int, v int"), [F.desc("v"), "i"]).collect()}
    assert got == {i: k for k, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}


def test_mapping_is_followed_to_its_end(spark):
    m = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(100)], "a string, b string")
    assert {r.b for r in C.close_mapping(m).collect()} == {"n100"}
    with pytest.raises(ValueError, match="circle"):
        C.close_mapping(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "a string, b string"))


def test_club_history(spark):
    e = [(1, "s1", 'C.B. SANTS "A"'), (1, "s1", 'C.B. SANTS "A"'), (1, "s1", "VIC"), (2, "s1", "SANTS"), (3, "s1", "Cap"), (4, "s1", "C.B.GRACIA"), (5, "s1", "C.B.GRÀCIA ZONA 2")]
    lg = [(1, "s1", "C.B. VIC A"), (1, "s2", "01 C.B. VIC B"), (6, "s2", "OLD NAME")]
    manual = spark.createDataFrame([("OLD NAME", "OTHER"), ("OTHER", "C.B.NEW")], "a string, b string")
    f = "player_id int, season string, club string"
    got = {(r.player_id, r.season): (r.club, r.source) for r in C.club_history(spark.createDataFrame(e, f), spark.createDataFrame(lg, f), manual).collect()}
    assert got == {(1, "s1"): ("C.B.SANTS", "entries"), (2, "s1"): ("C.B.SANTS", "entries"), (4, "s1"): (got[5, "s1"][0], "entries"), (5, "s1"): ("C.B.GRÀCIA ZONA 2", "entries"), (1, "s2"): ("C.B.VIC", "league"), (6, "s2"): ("C.B.NEW", "league")}


CASES = {
    "norm_division": {"1a DIVISIÓ": "1a", "2ª DIVISIÓ": "2a", "3 DIVISIÓ": "3a", "HONOR": "Honor", "DIVISIÓ D'HONOR": "Divisió d'honor", "PROMOCIÓ": "Promoció", "PROMOCIÓ A 2a": "Promoció a 2a", "ÚNICA": "Única", "L'AMISTAT": "L'Amistat", "Fase Final": "Fase final", None: None},
    "norm_group": {"FINAL": "Final", "FINAL FOUR": "Final Four", "FINAL FOUR A": "Final Four A", "GRUP B": "B", "a": "A", "SEMIFINAL C": "Semifinals C", "PROMOCIÓ 3": "Promoció 3", "PROMOCIÓ HONOR": "Promoció Honor", "GRUP ÚNIC": "Únic", "anada": "Anada", None: None},
    "clean_tournament": {"VI OPEN MATARÓ - OPEN MATARÓ": "VI OPEN MATARÓ", "LLIURE - ÚNICA": "LLIURE", "LLIURE - DIVISIÓ ÚNICA": "LLIURE", "TRES BANDES - HONOR": "TRES BANDES - HONOR", "OPEN VIC - 2A DIVISIÓ": "OPEN VIC - 2A DIVISIÓ", "A - B - unica": "A - B", "ÚNICA": "ÚNICA", "I OPEN CIUTAT DE VIC - OPEN DE VIC": "I OPEN CIUTAT DE VIC", "OPEN - 3 BANDES": "OPEN - 3 BANDES", None: None},
    "tournament_kind": {"OPEN VIC": "open", "MEMORIAL X": "open", "CAMPIONAT DE CATALUNYA OPEN": "championship", "TRES BANDES - HONOR": "championship", "TROFEU Y": "open"},
    "discipline_of": {"OPEN 3 BANDES": "Tres Bandes", "QUADRE 47/2 - HONOR": "Quadre 47/2", "QUADRE 71/2": "Quadre 71/2", "BANDA": "Banda", "LLIURE - 1A": "Lliure", "OPEN": ""},
    "extract_club": {"C.B. X": "C.B. X", ' C.B. X "B" ': "C.B. X", "cap": None, "CAP": None, "  ": None, None: None},
    "canonical_club_key": {"C.B. MATARÓ": "MATARO", "MATARÓ": "MATARO", "B.C. L'AMETLLA": "LAMETLLA", "Santa Adrià": "SANTADRIA"},
    "club_search_key": {"Club Billar de Sants": "sants", "C.B. Sant Adrià": "sant adria", "Billar Club": ""},
    "clean_club": {'01 C.B. BARCELONA "A"': "C.B.BARCELONA", "C.B. VIC B": "C.B.VIC", "SANTS Descansa la jornada": "SANTS", "BANYOLES (AMISTAT)": "BANYOLES", "02C.B. GRÀCIA “C”": "C.B.GRÀCIA", 'MATARÓ"C"': "MATARÓ", "Descansa": "Descansa", "SANTS E": "SANTS E", "S.B.F.  MOLINS": "S.B.F.MOLINS", "": "", None: None},
    "club_core": {"C.B. VIC B": "VIC", "S.B.F. MOLINS": "MOLINS", "Club Billar Sants": "CLUBBILLARSANTS", "C.B.": "", None: None},
    "club_zone_core": {"C.B. GRÀCIA ZONA 2": "GRACIA", "GRÀCIA Z3": "GRACIA", "C.B.ZONA FRANCA": "ZONAFRANCA", "ZONA12 VIC": "VIC", None: None},
    "short_division": {"TRES BANDES - 1ª DIVISIÓ": "TRES BANDES - 1a", 'LLIURE - 2A DIVISIÓ "B"': "LLIURE - 2a B", "QUADRE 47/2 - 3 DIVISIÒ c": "QUADRE 47/2 - 3a C", "2023 - 4 º DIVISIO": "2023 - 4a", "DIVISIÓ D'HONOR": "DIVISIÓ D'HONOR", "1A DIVISIÓ BANDA": "1a BANDA", "": "", None: None},
    "unify_discipline": {"CAMPIONAT DE CATALUNYA TRES BANDES": "Tres Bandes", "Campionat Catalunya Històric Lliure - Honor": "Lliure - Honor", "CAMPIONAT CATALUNYA": "CAMPIONAT CATALUNYA", "QUADRE 47 / 2 - 1a": "Quadre 47/2 - 1a", "OPEN  3  bandes (BANDA)": "OPEN Tres Bandes (Banda)", "VI OPEN DE CATALUNYA": "VI OPEN DE CATALUNYA", "BANDES": "BANDES", "": "", None: None},
    "phase_code": {"PRE-PRE-PRÈVIA": "PPP", "Pre-prèvies": "PP", "Prèvia": "P", "SETZENS": "FINAL", "Quarts de final": "FINAL", "": "?"},
    "title_name": {"PUIG I VILA, ANNA": "Anna Puig i Vila", "DE LA FUENTE, JOAN": "Joan de la Fuente", "ROCA": "Roca", "A" * 3000 + ", B": "B A" + "a" * 2999},
}


@pytest.mark.parametrize("name", CASES)
def test_text_cases(spark, name):
    assert col(spark, list(CASES[name]), getattr(T, name)) == list(CASES[name].values())


def test_ranking_dates(spark):
    """The last five days of a month belong to the next one; July ends in September, December in January."""
    cases = {dt.date(2024, 1, 1): (2024, 1), dt.date(2024, 1, 25): (2024, 1), dt.date(2024, 1, 31): (2024, 2), dt.date(2024, 2, 28): (2024, 3), dt.date(2024, 7, 31): (2024, 9), dt.date(2024, 12, 30): (2025, 1), dt.date(2024, 6, 15): (2024, 6)}
    assert [(d.year, d.month) for d in col(spark, list(cases), S.ranking_month, "date")] == list(cases.values())


def test_repair_encoding(spark):
    df = spark.createDataFrame([(1, "NÃºria"), (2, "Núria"), (3, None), (4, "Ã")], "i int, name string")
    assert {r.i: r.name for r in P.repair_encoding(df, "name").collect()} == {1: "Núria", 2: "Núria", 3: None, 4: "Ã"}


def test_running_values_of_large_groups(spark):
    """Windows over whole groups, and scans over ranges of them, agree; one group holds a third of the rows, one is null."""
    from pyspark.sql import Window

    from tallybook.operators.scans import numbered, running

    x = spark.range(4000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 11 == 0, None).otherwise(F.col("id") % 50).alias("g"), (F.xxhash64("id") % 100).alias("o"), "id", F.when(F.col("id") % 5 > 0, F.xxhash64(F.lit(3), "id")).alias("h"))
    w = Window.partitionBy("g").orderBy("o", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = x.select("*", F.count("*").over(w).alias("k"), F.bit_xor("h").over(w).alias("x"), F.max("h").over(w).alias("m"))
    got = running(x, ["g"], ["o", "id"], k=("sum", F.lit(1).cast("long")), x=("xor", F.col("h")), m=("max", F.col("h")))
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    for keys in ([], ["g"], ["g", "o"]):
        order = [F.desc("o"), "id"]
        want = x.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
        assert numbered(x, keys, order, "n").exceptAll(want).count() == 0
    assert numbered(x.limit(0), ["g"], ["o"]).count() == 0


def test_ranks_leave_no_window_by_group(spark, sf):
    """Ranks of a discipline, round or open are no window partitioned by it."""
    import __spark_entry__ as entry

    for name, key in (("r07_provisional_ranking", "discipline"), ("t06_opens_ranking_history", "round"), ("t11_standings_from_games", "open_id")):
        plan = entry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        for line in plan.splitlines():
            if "Window [" in line and "row_number" in line:
                assert not line.split("], [")[1].startswith(f"{key}#"), line


def _some_names(rnd, n):
    """Names of all lengths, short ones and near copies among them."""
    out = []
    while len(out) < n:
        word = lambda a, b: "".join(rnd.choice("ABCDEIOLMNRST") for _ in range(rnd.randint(a, b)))
        name = rnd.choice([word(1, 4), f"{word(2, 9)}, {word(1, 6)}", f"{word(3, 8)} {word(3, 8)}, {word(3, 7)}", f"{word(6, 12)} de la {word(3, 9)}, {word(3, 9)}"])
        out.append(name)
        if rnd.random() < 0.5:
            i = rnd.randrange(len(name))
            out.append(name[:i] + rnd.choice(["", "X", "É"]) + name[i + 1 :])
    return out[:n]


def test_ratios_as_one_by_one():
    """A hundred thousand pairs: equal, short, empty, long ones, letters beyond the basic plane."""
    from tallybook.functions.ratio import ratios

    rnd = random.Random(5)
    names = _some_names(rnd, 400) + ["", "A", "AA", "𝒜B𝒜", "B" * 250, "AB" * 150, "AAAAABAAAA", "ABABABABA"]
    pairs = [(rnd.choice(names), rnd.choice(names)) for _ in range(100_000)]
    got = ratios(*map(list, zip(*pairs, strict=True)))
    known = {}
    for (x, y), r in zip(pairs, got, strict=True):
        if (x, y) not in known:
            known[x, y] = SequenceMatcher(None, x, y).ratio()
        assert abs(r - known[x, y]) < 1e-12, (x, y)
    bounded = ratios(*map(list, zip(*pairs, strict=True)), least=0.7)
    assert all(b == r if r >= 0.7 else b < 0.7 for b, r in zip(bounded, got, strict=True))
    assert len(ratios([], [])) == 0


def test_similar_names_miss_none(spark):
    """All pairs of two lists that reach the least score, short names too, and few others are matched."""
    from tallybook.functions.ratio import ratios

    rnd = random.Random(11)
    a, b = _some_names(rnd, 700), _some_names(rnd, 300)
    b += a[:200]
    fa, fb = spark.createDataFrame([(x,) for x in a], "oname string"), spark.createDataFrame([(x,) for x in b], "cname string")
    got = {(r.oname, r.cname): r.score for r in Q.scored_names(fa, fb).collect()}
    keys = {r.n: r.k for r in spark.createDataFrame([(x,) for x in {*a, *b}], "n string").select("n", T.match_key(F.col("n")).alias("k")).collect()}
    xs, ys = sorted({*a}), sorted({*b})
    every = [(x, y) for x in xs for y in ys]
    plain = ratios([keys[x] for x, _ in every], [keys[y] for _, y in every])
    for (x, y), r in zip(every, plain, strict=True):
        s = _score(x, y, keys, r)
        assert (s >= 0.7) == ((x, y) in got), (x, y, s)
        assert s < 0.7 or abs(got[x, y] - s) < 1e-9
    k = lambda v: spark.createDataFrame([(keys[x],) for x in v], "key string").distinct()
    assert Q.similar_keys(k(a), k(b)).count() < 0.05 * len(every)


def _score(x, y, keys, ratio):
    ka, kb = keys[x], keys[y]
    ta, tb = ka.split(" "), kb.split(" ")
    given = lambda n: (n.upper().split(",") + [""])[1].strip()[:1]
    if ka == kb and ka:
        return 1.0
    if len(ta) >= 2 and len(tb) >= 2 and ta[:2] == tb[:2]:
        return 0.9
    return 0.8 if ta[0] == tb[0] and ta[0] and given(x) == given(y) and given(x) else ratio
