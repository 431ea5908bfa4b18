"""Queries over rankings and ratings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import games as G, ratings as X, rankings as R
from .registry import query

_RATED = """
, f AS (SELECT game_id, player_id, discipline, min(seq) AS seq FROM links GROUP BY 1, 2, 3),
rated AS (SELECT s.player_id, s.discipline, s.game_id, s.opp_id, s.result, coalesce(e.avg, CASE WHEN s.ent > 0 THEN CAST(s.opp_car AS DOUBLE) / s.ent END) AS rating
 FROM sides s LEFT JOIN f ON f.game_id = s.game_id AND f.player_id = s.opp_id AND f.discipline = s.discipline LEFT JOIN ranking_entries e ON e.player_id = f.player_id AND e.discipline = f.discipline AND e.seq = f.seq)
"""
_BUCKETS = """
, d AS (SELECT player_id, discipline, rating, count(*) AS c, count(*) FILTER (result = 1) AS won, count(*) FILTER (result = -1) AS lost, count(*) FILTER (result = 0) AS drawn FROM rated WHERE rating IS NOT NULL GROUP BY 1, 2, 3),
d1 AS (SELECT *, sum(c) OVER w - c AS s, sum(c) OVER (PARTITION BY player_id, discipline) AS tot FROM d WINDOW w AS (PARTITION BY player_id, discipline ORDER BY rating)),
d2 AS (SELECT *, coalesce(lag(s) OVER (PARTITION BY player_id, discipline ORDER BY rating), -1) AS sp FROM d1),
d3 AS (SELECT *, sum(CASE WHEN s > 0 AND EXISTS (SELECT 1 FROM range(1, 8) k(k) WHERE sp < round_even(CAST(k * tot AS DOUBLE) / 8, 0) AND round_even(CAST(k * tot AS DOUBLE) / 8, 0) <= s) THEN 1 ELSE 0 END) OVER (PARTITION BY player_id, discipline ORDER BY rating) AS bucket FROM d2),
b AS (SELECT player_id, discipline, bucket, round(min(rating), 4) AS lo, round(max(rating), 4) AS hi, sum(won) AS won, sum(lost) AS lost, sum(drawn) AS drawn FROM d3 GROUP BY 1, 2, 3)
"""


@query("g15_opponent_rating", ("sides", "links", "ranking_entries"), _RATED + "SELECT * FROM rated WHERE rating IS NOT NULL")
def g15(sides, links, entries):
    return X.opponent_rating(sides, links, entries)


@query("g16_rating_buckets", ("sides", "links", "ranking_entries"), _RATED + _BUCKETS + "SELECT * FROM b")
def g16(sides, links, entries):
    return X.rating_buckets(X.opponent_rating(sides, links, entries))


@query("g17_weighted_index", ("sides", "links", "ranking_entries"), _RATED + "SELECT player_id, discipline, round(100 * sum(CASE WHEN result = 1 THEN rating ELSE 0 END) / nullif(sum(CASE WHEN result <> 0 THEN rating END), 0), 1) AS idx FROM rated GROUP BY 1, 2")
def g17(sides, links, entries):
    return X.weighted_index(X.opponent_rating(sides, links, entries))


_CROSS = """
, c0 AS (SELECT player_id, discipline, bucket, (lo + hi) / 2 AS m, CAST(won AS DOUBLE) / (won + lost) AS w FROM b WHERE won + lost > 0),
c1 AS (SELECT *, lead(m) OVER o AS m1, lead(w) OVER o AS w1 FROM c0 WINDOW o AS (PARTITION BY player_id, discipline ORDER BY bucket)),
c2 AS (SELECT player_id, discipline, min(w) AS lw, max(w) AS hw, arg_min(m, bucket) AS f, arg_max(m, bucket) AS l, arg_min(m + (0.5 - w) * (m1 - m) / (w1 - w), bucket) FILTER (w >= 0.5 AND w1 < 0.5) AS x FROM c1 GROUP BY 1, 2),
x AS (SELECT player_id, discipline, CASE WHEN lw >= 0.5 THEN l WHEN hw < 0.5 THEN f ELSE coalesce(x, l) END AS crossover FROM c2)
"""


@query("g18_crossover", ("sides", "links", "ranking_entries"), _RATED + _BUCKETS + _CROSS + "SELECT * FROM x")
def g18(sides, links, entries):
    return X.crossover(X.rating_buckets(X.opponent_rating(sides, links, entries)), None)


@query("g19_rating_breakdown", ("sides", "links", "ranking_entries"), _RATED + _BUCKETS + _CROSS + """
SELECT b.*, i.idx, x.crossover FROM b LEFT JOIN x ON x.player_id = b.player_id AND x.discipline = b.discipline
JOIN (SELECT player_id, discipline, round(100 * sum(CASE WHEN result = 1 THEN rating ELSE 0 END) / nullif(sum(CASE WHEN result <> 0 THEN rating END), 0), 1) AS idx FROM rated GROUP BY 1, 2) i ON i.player_id = b.player_id AND i.discipline = b.discipline""")
def g19(sides, links, entries):
    return X.breakdown(sides, links, entries, digits=None)


@query("g20_hardest_easiest", ("sides", "links", "ranking_entries"), _RATED + """
SELECT player_id, discipline, first(opp_id ORDER BY rating DESC, game_id) AS hardest, max(rating) AS hard_rating, first(opp_id ORDER BY rating, game_id) AS easiest, min(rating) AS easy_rating FROM rated WHERE rating IS NOT NULL GROUP BY 1, 2""")
def g20(sides, links, entries):
    return G.hardest_easiest(X.opponent_rating(sides, links, entries))


_LAST = "seq = (SELECT max(seq) FROM ranking_entries m WHERE m.discipline = e.discipline)"


@query("r01_latest_top", ("ranking_entries",), f"SELECT discipline, seq, player_id, pos, avg FROM ranking_entries e WHERE {_LAST} AND pos <= 10", last=True)
def r01(entries):
    return R.latest_top(entries).select("discipline", "seq", "player_id", "pos", "avg")


@query("r02_snapshots", ("ranking_entries",), "SELECT discipline, seq, count(*) AS n_players, count(*) FILTER (is_definitive) AS n_definitive, max(avg) AS best FROM ranking_entries GROUP BY 1, 2")
def r02(entries):
    return R.snapshots(entries)


@query("r03_ranking_history", ("ranking_entries", "rankings"), "SELECT e.discipline, e.player_id, e.seq, y, m, pos, avg, pos - lag(pos) OVER (PARTITION BY e.discipline, e.player_id ORDER BY e.seq) AS moved FROM ranking_entries e JOIN rankings r ON r.discipline = e.discipline AND r.seq = e.seq")
def r03(entries, rankings):
    from pyspark.sql import Window as W

    x = entries.select("discipline", "player_id", "seq", "pos", "avg", (F.col("pos") - F.lag("pos").over(W.partitionBy("discipline", "player_id").orderBy("seq"))).alias("moved"))
    return x.join(F.broadcast(rankings), ["discipline", "seq"]).select("discipline", "player_id", "seq", "y", "m", "pos", "avg", "moved")


@query("r04_player_marks", ("ranking_entries", "rankings"), """
, sf AS (SELECT discipline, min(seq) AS seq FROM rankings WHERE CASE WHEN m >= 8 THEN y ELSE y - 1 END = (SELECT max(CASE WHEN m >= 8 THEN y ELSE y - 1 END) FROM rankings) GROUP BY 1)
SELECT e.discipline, e.player_id, max(e.seq) AS seq, arg_max(pos, e.seq) AS pos, arg_max(avg, e.seq) AS avg, min(pos) AS best_pos, first(avg ORDER BY pos, e.seq) AS best_pos_avg, max(avg) AS best_avg, first(pos ORDER BY avg DESC, pos) AS best_avg_pos, max(CASE WHEN e.seq = sf.seq THEN pos END) AS start_pos
FROM ranking_entries e LEFT JOIN sf ON sf.discipline = e.discipline GROUP BY 1, 2""")
def r04(entries, rankings):
    b = R.season_bounds(rankings)
    last = b.agg(F.max("sy").alias("sy"))
    return R.player_marks(entries, b.join(F.broadcast(last), "sy").select("discipline", F.col("first_seq").alias("seq")))


@query("r05_evolution", ("ranking_entries", "players"), """
, sp AS (SELECT DISTINCT discipline, seq FROM ranking_entries), w AS (SELECT DISTINCT discipline, player_id FROM ranking_entries WHERE player_id % 50 = 0),
g AS (SELECT w.discipline, w.player_id, sp.seq, e.avg FROM w JOIN sp ON sp.discipline = w.discipline LEFT JOIN ranking_entries e ON e.discipline = w.discipline AND e.seq = sp.seq AND e.player_id = w.player_id)
SELECT discipline, player_id, row_number() OVER (PARTITION BY discipline, player_id ORDER BY seq) - 1 AS i, avg FROM g""")
def r05(entries, players):
    return R.evolution(entries, players.where("followed")).select("discipline", "player_id", F.posexplode("avgs").alias("i", "avg"))


@query("r06_internal_order", ("ranking_entries", "links", "sides"), """
, l AS (SELECT k.discipline, k.player_id, s.club_id, max(k.seq) AS last_seq FROM links k JOIN sides s ON s.game_id = k.game_id AND s.player_id = k.player_id GROUP BY 1, 2, 3)
SELECT e.discipline, e.seq, l.club_id, e.player_id, row_number() OVER (PARTITION BY e.discipline, e.seq, l.club_id ORDER BY avg DESC, e.player_id) AS k, count(*) OVER (PARTITION BY e.discipline, e.seq, l.club_id) AS of FROM ranking_entries e JOIN l ON l.discipline = e.discipline AND l.player_id = e.player_id AND e.seq <= l.last_seq""")
def r06(entries, links, sides):
    return R.internal_order(entries, links, sides)


def _pending(games):
    c = F.col
    from ..functions.seasons import game_signature

    g = games.withColumn("sig", game_signature(c("p1"), c("car1"), c("p2"), c("car2"), c("ent")))
    new = g.where("game_id % 97 = 0").withColumn("sig", F.concat(F.lit("new"), "sig"))
    src = [new.where(cond).select("sig", "discipline", "game_id", "p1", "p2", "car1", "car2", "ent", "ord") for cond in ("competition = 'COPA'", "competition <> 'LLIGA'", "true")]
    return R.pending_games(src, g.select("sig"))


_PEND = """
, pend0 AS (SELECT concat('new', least(concat(p1, ':', car1), concat(p2, ':', car2)), '|', greatest(concat(p1, ':', car1), concat(p2, ':', car2)), '|', ent) AS sig, discipline, game_id, ent, ord, p1, p2, car1, car2,
 CASE WHEN competition = 'COPA' THEN 0 WHEN competition <> 'LLIGA' THEN 1 ELSE 2 END AS source FROM games WHERE game_id % 97 = 0 AND ent > 0),
pend1 AS (SELECT sig, discipline, game_id, ent, ord, source, p1 AS player_id, p2 AS opp_id, car1 AS car, car2 AS opp_car FROM pend0 UNION ALL SELECT sig, discipline, game_id, ent, ord, source, p2, p1, car2, car1 FROM pend0),
pending AS (SELECT *, CASE WHEN car > opp_car THEN 1 WHEN car < opp_car THEN -1 ELSE 0 END AS result FROM pend1 QUALIFY row_number() OVER (PARTITION BY player_id, sig ORDER BY source, ord, game_id) = 1)
"""


@query("r08_pending_games", ("games",), _PEND + "SELECT * FROM pending")
def r08(games):
    return _pending(games)


@query("r07_provisional_ranking", ("ranking_entries", "links", "sides", "rankings", "games"), _PEND + """
, last AS (SELECT * FROM ranking_entries e WHERE seq = (SELECT max(seq) FROM ranking_entries m WHERE m.discipline = e.discipline)),
mon AS (SELECT discipline, CASE WHEN month(d) = 8 THEN d + INTERVAL 1 MONTH ELSE d END - INTERVAL 24 MONTH AS cutoff FROM (SELECT discipline, make_date(CAST(y AS INT), CAST(m AS INT), 1) + INTERVAL 1 MONTH AS d FROM rankings r WHERE seq = (SELECT max(seq) FROM rankings q WHERE q.discipline = r.discipline)) z),
p AS (SELECT * FROM pending QUALIFY row_number() OVER (PARTITION BY discipline, player_id ORDER BY ord, game_id) <= 15),
np AS (SELECT discipline, player_id, count(*) AS n FROM p GROUP BY 1, 2),
lk AS (SELECT k.* FROM links k JOIN last USING (discipline, seq, player_id)),
rec AS (SELECT s.discipline, s.player_id, s.car, s.ent, s.result, np.n, row_number() OVER (PARTITION BY s.discipline, s.player_id ORDER BY s.played_on DESC, coalesce(lk.rn, -1) DESC, s.game_id) AS k
 FROM sides s JOIN np ON np.discipline = s.discipline AND np.player_id = s.player_id JOIN mon ON mon.discipline = s.discipline AND s.played_on >= mon.cutoff LEFT JOIN lk ON lk.discipline = s.discipline AND lk.player_id = s.player_id AND lk.game_id = s.game_id
 WHERE NOT EXISTS (SELECT 1 FROM pending q WHERE q.game_id = s.game_id AND q.player_id = s.player_id)),
al AS (SELECT discipline, player_id, car, ent, result, 1 AS old FROM rec WHERE k <= 15 - n UNION ALL SELECT discipline, player_id, car, ent, result, 0 FROM p),
nw AS (SELECT discipline, player_id, sum(old) AS n_recent, CAST(sum(car) AS DOUBLE) / nullif(sum(ent), 0) AS new_avg, count(*) FILTER (result = 1) AS won, count(*) FILTER (result = 0) AS drawn, count(*) FILTER (result = -1) AS lost FROM al GROUP BY 1, 2),
x AS (SELECT last.*, np.n AS n_pending, n_recent, new_avg, won, drawn, lost, is_definitive OR coalesce(np.n + n_recent, 0) >= 15 AS definitive FROM last LEFT JOIN np ON np.discipline = last.discipline AND np.player_id = last.player_id LEFT JOIN nw ON nw.discipline = last.discipline AND nw.player_id = last.player_id WHERE last.discipline IN (SELECT discipline FROM pending)),
y AS (SELECT *, row_number() OVER (PARTITION BY discipline ORDER BY definitive DESC, coalesce(new_avg, avg) DESC, pos, player_id) AS new_pos FROM x)
SELECT discipline, player_id, pos, new_pos, pos - new_pos AS movement, coalesce(n_pending, 0) AS n_pending, n_recent, round(new_avg, 4) AS new_avg, won, drawn, lost, definitive FROM y""", last=True)
def r07(entries, links, sides, rankings, games):
    return R.provisional(entries, links, sides, rankings, _pending(games))


@query("r09_club_rank", ("ranking_entries", "players"), f"""
SELECT discipline, club_id, e.player_id, row_number() OVER (PARTITION BY discipline, club_id ORDER BY avg DESC, e.player_id) AS k, count(*) OVER (PARTITION BY discipline, club_id) AS of FROM ranking_entries e JOIN players p ON p.player_id = e.player_id WHERE {_LAST}""", last=True)
def r09(entries, players):
    return R.club_rank(entries, players)


@query("r10_season_bounds", ("rankings",), "SELECT discipline, CASE WHEN m >= 8 THEN y ELSE y - 1 END AS sy, min(seq) AS first_seq, max(seq) AS last_seq FROM rankings GROUP BY 1, 2")
def r10(rankings):
    return R.season_bounds(rankings)


@query("r11_current_window", ("sides",), """
SELECT discipline, player_id, count(*) AS n, CAST(sum(car) AS DOUBLE) / sum(ent) AS avg FROM (SELECT *, row_number() OVER (PARTITION BY discipline, player_id ORDER BY played_on DESC, CAST(car AS DOUBLE) / ent DESC, game_id) AS k FROM sides WHERE played_on >= DATE '1998-06-01' AND played_on < DATE '2000-06-01') x WHERE k <= 15 GROUP BY 1, 2""")
def r11(sides):
    return R.current_window(sides, "2000-06-01")


@query("r15_prize_bands", ("ranking_entries", "open_results"), f"""
SELECT open_id, band, player_id, pos, row_number() OVER (PARTITION BY open_id, band ORDER BY rank_avg DESC NULLS LAST, pts DESC, player_id) AS k, row_number() OVER (PARTITION BY open_id, band ORDER BY pos) = 1 AS best_of_band
FROM (SELECT r.*, e.avg AS rank_avg, CASE WHEN e.pos <= 180 THEN '61-180' ELSE '181+' END AS band FROM open_results r LEFT JOIN (SELECT * FROM ranking_entries e WHERE {_LAST} AND discipline = 1) e ON e.player_id = r.player_id WHERE e.pos IS NULL OR e.pos > 60) x""", last=True)
def r15(entries, results):
    return R.prize_bands(R.latest(entries).where("discipline = 1"), results)


@query("r16_month_list", ("ranking_entries", "rankings"), "SELECT y, m, count(DISTINCT r.discipline) AS n_disciplines, count(player_id) AS n_entries FROM rankings r LEFT JOIN ranking_entries e ON e.discipline = r.discipline AND e.seq = r.seq GROUP BY 1, 2")
def r16(entries, rankings):
    n = entries.groupBy("discipline", "seq").agg(F.count("player_id").alias("n"))
    return rankings.join(n, ["discipline", "seq"], "left").groupBy("y", "m").agg(F.countDistinct("discipline").alias("n_disciplines"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_entries"))


@query("r17_followed_series", ("ranking_entries", "players"), "SELECT p.player_id, p.name, p.club_id, e.discipline, e.seq, e.avg, e.pos FROM players p JOIN ranking_entries e ON e.player_id = p.player_id WHERE followed")
def r17(entries, players):
    return entries.join(players.where("followed"), "player_id").select("player_id", "name", "club_id", "discipline", "seq", "avg", "pos")
