"""Queries over player and game analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.seasons import game_signature
from ..operators import games as G
from .registry import query


@query("g01_player_games", ("games",), """
SELECT game_id, p1 AS player_id, p2 AS opp_id, car1 AS car, car2 AS opp_car, run1 AS run, pts1 AS pts, CASE WHEN car1 > car2 THEN 1 WHEN car1 < car2 THEN -1 ELSE 0 END AS result FROM games
UNION ALL SELECT game_id, p2, p1, car2, car1, run2, pts2, CASE WHEN car2 > car1 THEN 1 WHEN car2 < car1 THEN -1 ELSE 0 END FROM games""")
def g01(games):
    return G.player_games(games).select("game_id", "player_id", "opp_id", "car", "opp_car", "run", "pts", "result")


@query("g02_player_summary", ("sides",), """
SELECT player_id, discipline, count(*) AS n, sum(CAST(result = 1 AS INT)) AS won, sum(CAST(result = -1 AS INT)) AS lost, sum(CAST(result = 0 AS INT)) AS drawn, sum(car) AS car, sum(opp_car) AS opp_car, sum(ent) AS ent, max(run) AS best_run FROM sides GROUP BY player_id, discipline
UNION ALL SELECT player_id, 0, count(*), sum(CAST(result = 1 AS INT)), sum(CAST(result = -1 AS INT)), sum(CAST(result = 0 AS INT)), sum(car), sum(opp_car), sum(ent), max(run) FROM sides GROUP BY player_id""")
def g02(sides):
    return G.player_summary(sides)


@query("g03_best_average_games", ("sides",), """
SELECT player_id, game_id, avg, count(*) OVER (PARTITION BY player_id) AS n_ties FROM (SELECT player_id, game_id, CAST(car AS DOUBLE) / ent AS avg, max(CAST(car AS DOUBLE) / ent) OVER (PARTITION BY player_id) AS best FROM sides WHERE ent > 0) x WHERE abs(avg - best) < 1e-9""")
def g03(sides):
    return G.best_average_games(sides)


_FOUR = """SELECT player_id, game_id, avg, '{0}' AS list, rn FROM (SELECT player_id, game_id, CAST(car AS DOUBLE) / ent AS avg, row_number() OVER (PARTITION BY player_id ORDER BY {1}, game_id) AS rn FROM sides WHERE ent > 0 {2}) x WHERE rn <= 3"""


@query("g04_best_worst_games", ("sides",), " UNION ALL ".join(_FOUR.format(*x) for x in (("best", "CAST(car AS DOUBLE) / ent DESC, car DESC", ""), ("worst", "CAST(car AS DOUBLE) / ent, car", ""), ("best_won", "CAST(car AS DOUBLE) / ent DESC", "AND result = 1"), ("worst_lost", "CAST(car AS DOUBLE) / ent", "AND result = -1"))))
def g04(sides):
    return G.best_worst_games(sides)


@query("g05_latest_games", ("sides", "links"), """
SELECT player_id, game_id, rn, EXISTS (SELECT 1 FROM links l WHERE l.player_id = x.player_id AND l.game_id = x.game_id AND l.seq = (SELECT max(seq) FROM links m WHERE m.discipline = x.discipline)) AS counts
FROM (SELECT player_id, game_id, discipline, row_number() OVER (PARTITION BY player_id ORDER BY played_on DESC, game_id DESC) AS rn FROM sides) x WHERE rn <= 5""", last=True)
def g05(sides, links):
    return G.latest_games(sides, links)


@query("g06_search_games", ("sides", "players"), """
SELECT s.game_id, s.player_id, p.name, s.played_on FROM sides s JOIN players p ON p.player_id = s.player_id WHERE strip_accents(lower(p.name)) LIKE '%puig%' AND discipline = 1 AND competition = 'LLIGA' ORDER BY played_on DESC, game_id DESC, s.player_id LIMIT 50""")
def g06(sides, players):
    return G.search_games(sides, players, "Puig", 1, "LLIGA")


@query("g07_search_players", ("sides", "players"), """
SELECT p.player_id, name, coalesce(n, 0) AS n_games FROM players p LEFT JOIN (SELECT player_id, count(*) AS n FROM sides GROUP BY 1) s ON s.player_id = p.player_id WHERE strip_accents(lower(name)) LIKE '%sole%' ORDER BY n_games DESC, p.player_id LIMIT 50""")
def g07(sides, players):
    return G.search_players(sides, players, "Solé")


@query("g08_period_kpis", ("sides",), """
SELECT player_id, count(*) FILTER (season = '1998-1999') AS n, count(*) FILTER (season = '1997-1998') AS n_before, count(*) FILTER (season = '1998-1999' AND result = 1) AS won, count(*) FILTER (season = '1997-1998' AND result = 1) AS won_before,
 CAST(sum(car) FILTER (season = '1998-1999') AS DOUBLE) / sum(ent) FILTER (season = '1998-1999') AS avg, CAST(sum(car) FILTER (season = '1997-1998') AS DOUBLE) / sum(ent) FILTER (season = '1997-1998') AS avg_before FROM sides WHERE season IN ('1998-1999', '1997-1998') GROUP BY player_id""")
def g08(sides):
    return G.period_kpis(sides, "1998-1999", "1997-1998")


@query("g09_effectiveness", ("sides",), """
SELECT player_id, competition, count(*) AS n, CAST(floor(100.0 * sum(CASE result WHEN 1 THEN v WHEN 0 THEN 1 ELSE 0 END) / sum(v) + 0.5) AS BIGINT) AS pct FROM (SELECT *, CASE WHEN competition = 'COPA' THEN 3 ELSE 2 END AS v FROM sides) x GROUP BY player_id, competition""")
def g09(sides):
    return G.effectiveness(sides)


@query("g10_head_to_head", ("sides",), """
SELECT player_id, opp_id, tally, n FROM (SELECT *, max(n) OVER (PARTITION BY player_id, tally) AS most FROM (
 SELECT player_id, opp_id, 'played' AS tally, count(*) AS n FROM sides GROUP BY 1, 2 UNION ALL SELECT player_id, opp_id, 'won', count(*) FILTER (result = 1) FROM sides GROUP BY 1, 2 UNION ALL SELECT player_id, opp_id, 'lost', count(*) FILTER (result = -1) FROM sides GROUP BY 1, 2) a) b WHERE n = most AND n >= 2""")
def g10(sides):
    return G.head_to_head(sides)


@query("g11_pairwise", ("games", "players"), """
SELECT least(p1, p2) AS a, greatest(p1, p2) AS b, count(*) FILTER (winner_id = least(p1, p2)) AS won_a, count(*) FILTER (winner_id = greatest(p1, p2)) AS won_b, count(*) AS n FROM games WHERE club1 < 9 AND club2 < 9 GROUP BY 1, 2""")
def g11(games, players):
    return G.pairwise(games, players.where("club_id < 9")).fillna(0)


@query("g12_compare_players", ("sides", "ranking_entries"), """
SELECT s.player_id, s.discipline, n, won, pos, r.avg FROM (SELECT player_id, discipline, count(*) AS n, count(*) FILTER (result = 1) AS won FROM sides GROUP BY 1, 2) s
LEFT JOIN (SELECT player_id, discipline, pos, avg FROM ranking_entries e WHERE seq = (SELECT max(seq) FROM ranking_entries m WHERE m.discipline = e.discipline)) r ON r.player_id = s.player_id AND r.discipline = s.discipline""", last=True)
def g12(sides, entries):
    from ..operators.rankings import latest

    return G.player_summary(sides).where("discipline > 0").select("player_id", "discipline", "n", "won").join(latest(entries).select("player_id", "discipline", "pos", "avg"), ["player_id", "discipline"], "left")


@query("g13_rolling_average", ("sides",), """
SELECT player_id, discipline, game_id, CAST(c AS DOUBLE) / e AS avg, since, until FROM (SELECT player_id, discipline, game_id, count(*) OVER w AS n, sum(car) OVER w AS c, nullif(sum(ent) OVER w, 0) AS e, min(played_on) OVER w AS since, max(played_on) OVER w AS until FROM sides
 WINDOW w AS (PARTITION BY player_id, discipline ORDER BY played_on, game_id ROWS BETWEEN 14 PRECEDING AND CURRENT ROW)) x WHERE n = 15""")
def g13(sides):
    return G.rolling_average(sides)


@query("g14_average_histogram", ("sides",), """
, b AS (SELECT player_id, discipline, CAST(car AS DOUBLE) / ent AS a, car, ent FROM sides WHERE ent > 0),
s0 AS (SELECT player_id, discipline, min(a) AS lo, max(a) AS hi, CAST(sum(car) AS DOUBLE) / sum(ent) AS center FROM b GROUP BY 1, 2 HAVING count(*) >= 5 AND max(a) > min(a)),
s1 AS (SELECT *, pow(10.0, floor(log10((hi - lo) / 12))) AS p FROM s0),
s AS (SELECT *, CASE WHEN (hi - lo) / 12 / p <= 1 THEN 1.0 WHEN (hi - lo) / 12 / p <= 2 THEN 2.0 WHEN (hi - lo) / 12 / p <= 2.5 THEN 2.5 WHEN (hi - lo) / 12 / p <= 5 THEN 5.0 ELSE 10.0 END * p AS step FROM s1),
x AS (SELECT b.*, s.step, center, floor((a - floor(lo / step) * step) / step + 1e-9) AS bin FROM b JOIN s ON s.player_id = b.player_id AND s.discipline = b.discipline)
SELECT x.player_id, x.discipline, step, bin, count(*) AS n, min(sd) AS sd FROM x JOIN (SELECT player_id, discipline, round(sqrt(avg(pow(a - center, 2))), 6) AS sd FROM x GROUP BY 1, 2) d ON d.player_id = x.player_id AND d.discipline = x.discipline GROUP BY 1, 2, 3, 4""")
def g14(sides):
    return G.average_histogram(sides)


@query("g21_records", ("sides",), """
, v AS (SELECT * FROM sides WHERE ent > 0 AND NOT (discipline = 1 AND (CAST(car AS DOUBLE) / ent > 2.7 OR CAST(opp_car AS DOUBLE) / ent > 2.7 OR (car = opp_car AND car > 0 AND ent < 10)))),
a AS (SELECT discipline, player_id, 'avg' AS record, CAST(car AS DOUBLE) / ent AS value, game_id, row_number() OVER (PARTITION BY discipline, player_id ORDER BY CAST(car AS DOUBLE) / ent DESC, game_id) AS k FROM v
 UNION ALL SELECT discipline, player_id, 'run', CAST(run AS DOUBLE), game_id, row_number() OVER (PARTITION BY discipline, player_id ORDER BY run DESC, game_id) FROM v
 UNION ALL SELECT discipline, player_id, 'games', CAST(count(*) AS DOUBLE), NULL, 1 FROM sides GROUP BY 1, 2)
SELECT discipline, player_id, record, value, game_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY discipline, record ORDER BY value DESC, player_id) AS rn FROM a WHERE k = 1) x WHERE rn <= 5""")
def g21(sides):
    return G.records(sides)


@query("g22_record_ranking_average", ("ranking_entries",), """
SELECT discipline, player_id, avg, seq, row_number() OVER (PARTITION BY discipline ORDER BY avg DESC, seq DESC, player_id) AS rn FROM (SELECT *, count(*) OVER (PARTITION BY discipline, player_id) AS k, row_number() OVER (PARTITION BY discipline, player_id ORDER BY avg DESC, seq DESC) AS r FROM ranking_entries) x WHERE k >= 5 AND r = 1 QUALIFY rn <= 5""")
def g22(entries):
    return G.record_ranking_average(entries)


@query("g23_record_titles", ("open_results",), "SELECT player_id, count(*) AS titles FROM open_results WHERE pos = 1 GROUP BY player_id ORDER BY titles DESC, player_id LIMIT 5")
def g23(results):
    return G.record_titles(results)


@query("g24_counts", ("sides",), """
SELECT 'competition' AS kind, competition AS name, count(DISTINCT game_id) AS n FROM sides GROUP BY 2 UNION ALL SELECT * FROM (SELECT 'club', CAST(club_id AS STRING), count(DISTINCT game_id) AS n FROM sides GROUP BY club_id ORDER BY n DESC, club_id LIMIT 15) t""")
def g24(sides):
    a = sides.groupBy("competition").agg(F.countDistinct("game_id").alias("n")).select(F.lit("competition").alias("kind"), F.col("competition").alias("name"), "n")
    b = sides.groupBy("club_id").agg(F.countDistinct("game_id").alias("n")).orderBy(F.desc("n"), "club_id").limit(15)
    return a.unionAll(b.select(F.lit("club"), F.col("club_id").cast("string"), "n"))


_SIG = "concat(least(concat(p1, ':', car1), concat(p2, ':', car2)), '|', greatest(concat(p1, ':', car1), concat(p2, ':', car2)), '|', ent)"


@query("g25_enrich_labels", ("games", "open_results", "opens"), f"""
, g AS (SELECT game_id, p1, p2, season, {_SIG} AS sig FROM games WHERE competition = 'INDIVIDUAL'),
pub AS (SELECT CASE WHEN game_id % 3 = 0 THEN game_id END AS game_id, sig, concat('T', season) AS t FROM g WHERE game_id % 7 < 3),
part AS (SELECT player_id, open_name AS t, season FROM open_results r JOIN opens o ON o.open_id = r.open_id),
i AS (SELECT game_id, min(t) AS t FROM pub WHERE game_id IS NOT NULL GROUP BY 1), s AS (SELECT sig, min(t) AS t FROM pub GROUP BY 1),
e AS (SELECT game_id, t FROM (SELECT g.game_id, a.t, row_number() OVER (PARTITION BY g.game_id ORDER BY a.season <> g.season, a.t) AS k FROM g JOIN part a ON a.player_id = g.p1 JOIN part b ON b.player_id = g.p2 AND b.t = a.t) x WHERE k = 1)
SELECT g.game_id, coalesce(i.t, s.t, e.t) AS tournament, CASE WHEN i.t IS NOT NULL THEN 'id' WHEN s.t IS NOT NULL THEN 'signature' WHEN e.t IS NOT NULL THEN 'entries' ELSE 'none' END AS source
FROM g LEFT JOIN i ON i.game_id = g.game_id LEFT JOIN s ON s.sig = g.sig LEFT JOIN e ON e.game_id = g.game_id""")
def g25(games, results, opens):
    c = F.col
    g = games.where("competition = 'INDIVIDUAL'").withColumn("sig", game_signature(c("p1"), c("car1"), c("p2"), c("car2"), c("ent")))
    pub = g.where("game_id % 7 < 3").select(F.when(c("game_id") % 3 == 0, c("game_id")).alias("game_id"), "sig", F.concat(F.lit("T"), "season").alias("tournament"))
    part = results.join(opens.select("open_id", F.col("open_name").alias("tournament"), "season"), "open_id").select("player_id", "tournament", "season")
    return G.enrich_labels(g, pub, part)


@query("g27_podiums", ("open_results", "opens"), """
SELECT player_id, season, pos, r.open_id, CASE WHEN open_name LIKE '%CAMPIONAT%' THEN 'championship' ELSE 'open' END AS kind, CASE WHEN open_name LIKE '%TRES%' THEN 'Tres Bandes' WHEN open_name LIKE '%LLIURE%' THEN 'Lliure' ELSE '' END AS category FROM open_results r JOIN opens o ON o.open_id = r.open_id WHERE pos <= 3""")
def g27(results, opens):
    return G.podiums(results, opens)


@query("g28_stints", ("sides",), """
, c AS (SELECT DISTINCT player_id, sy, (player_id + CAST(floor(sy / 3) AS BIGINT)) % 41 AS club_id FROM sides),
n AS (SELECT *, CASE WHEN lag(club_id) OVER w = club_id AND lag(sy) OVER w = sy - 1 THEN 0 ELSE 1 END AS new FROM c WINDOW w AS (PARTITION BY player_id ORDER BY sy, club_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY player_id ORDER BY sy, club_id) AS stint FROM n)
SELECT player_id, stint, min(club_id) AS club_id, min(sy) AS since, max(sy) AS until, count(*) AS n_seasons FROM s GROUP BY 1, 2""")
def g28(sides):
    c = sides.select("player_id", "sy").distinct().withColumn("club_id", (F.col("player_id") + F.floor(F.col("sy") / 3)) % 41)
    return G.stints(c)
