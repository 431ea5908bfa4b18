"""Queries over tournaments, the open circuit and brackets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.seasons import game_signature
from ..operators import brackets as B, tournaments as T
from .registry import query

c = F.col
_PTS = "CASE WHEN pos = 1 THEN 180 WHEN pos = 2 THEN 165 WHEN pos <= 4 THEN 155 WHEN pos <= 8 THEN 156 - 2 * pos WHEN pos <= 16 THEN 141 - pos WHEN pos <= 32 THEN 135 - pos WHEN pos <= 48 THEN 128 - pos WHEN pos <= 64 THEN 121 - pos WHEN pos <= 80 THEN 114 - pos WHEN pos <= 96 THEN 25 WHEN pos <= 112 THEN 18 WHEN pos <= 128 THEN 15 ELSE 12 END"


@query("t01_tournament_list", ("opens", "open_results"), "SELECT o.open_id, open_name, season, count(player_id) AS n_players, arg_min(player_id, pos) AS champion FROM opens o LEFT JOIN open_results r ON r.open_id = o.open_id GROUP BY 1, 2, 3")
def t01(opens, results):
    return T.tournament_list(opens, results)


def _rows(games):
    g = games.where("competition = 'INDIVIDUAL' and game_id % 5 <> 0")
    return g.select(c("game_id").alias("row_id"), F.concat(F.lit("T"), c("season")).alias("tournament"), F.when(c("game_id") % 4 != 0, c("discipline")).alias("discipline"), F.when(c("game_id") % 7 == 0, "1990-1991").otherwise(c("season")).alias("season"), c("p2").alias("a"), c("p1").alias("b"), c("car2").alias("car_a"), c("car1").alias("car_b"), c("run2").alias("run_a"), c("run1").alias("run_b"), F.when(c("game_id") % 3 != 0, c("ent")).alias("ent"), "ord")


_LINK = """
, r AS (SELECT game_id AS row_id, concat('T', season) AS tournament, CASE WHEN game_id % 4 <> 0 THEN discipline END AS rd, CASE WHEN game_id % 7 = 0 THEN '1990-1991' ELSE season END AS rs, least(p1, p2) AS x, greatest(p1, p2) AS y, least(car1, car2) AS c1, greatest(car1, car2) AS c2, least(run1, run2) AS r1, greatest(run1, run2) AS r2, CASE WHEN game_id % 3 <> 0 THEN ent END AS re, ord AS ro FROM games WHERE competition = 'INDIVIDUAL' AND game_id % 5 <> 0),
h AS (SELECT r.*, g.game_id, g.season, CAST(coalesce(r1 = least(run1, run2) AND r2 = greatest(run1, run2), false) AS INT) AS same FROM r JOIN games g ON g.competition = 'INDIVIDUAL' AND least(p1, p2) = x AND greatest(p1, p2) = y AND least(car1, car2) = c1 AND greatest(car1, car2) = c2 WHERE (rd IS NULL OR rd = discipline) AND (re IS NULL OR re = ent)),
h2 AS (SELECT * FROM h QUALIFY same = max(same) OVER (PARTITION BY row_id)),
l AS (SELECT game_id, row_id, tournament FROM h2 QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY rs = season DESC, ro, row_id) = 1)
"""


@query("t02_link_games", ("games",), _LINK + "SELECT * FROM l")
def t02(games):
    return T.link_games(_rows(games), games.where("competition = 'INDIVIDUAL'"))


@query("t03_link_coverage", ("games",), _LINK + "SELECT season, count(*) AS total, count(l.game_id) AS linked, round(100.0 * count(l.game_id) / count(*), 1) AS pct FROM games g LEFT JOIN l ON l.game_id = g.game_id WHERE competition = 'INDIVIDUAL' GROUP BY 1")
def t03(games):
    g = games.where("competition = 'INDIVIDUAL'")
    return T.link_coverage(g, T.link_games(_rows(games), g))


@query("t05_opens_ranking", ("open_results", "opens"), f"""
, w AS (SELECT open_id FROM opens ORDER BY open_id DESC LIMIT 5), p AS (SELECT player_id, open_id, {_PTS} AS pts FROM open_results WHERE open_id IN (SELECT open_id FROM w)),
s AS (SELECT q.player_id, w.open_id, coalesce(p.pts, 0) AS v, p.pts FROM (SELECT DISTINCT player_id FROM p) q CROSS JOIN w LEFT JOIN p ON p.player_id = q.player_id AND p.open_id = w.open_id),
t AS (SELECT player_id, sum(v) AS total, max(v) AS best, count(pts) AS played, string_agg(CAST(v AS STRING), ',' ORDER BY open_id) AS breakdown FROM s GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY total DESC, best DESC, player_id) AS k FROM t WHERE total > 0""")
def t05(results, opens):
    return T.opens_ranking(results, opens)


_HIST = f"""
, hist AS (SELECT *, row_number() OVER (PARTITION BY round ORDER BY total DESC, best DESC, avg DESC, player_id) AS k FROM (
 SELECT r.idx AS round, player_id, sum({_PTS}) AS total, max({_PTS}) AS best, count(*) AS played, round(CAST(sum(car) AS DOUBLE) / sum(ent), 6) AS avg FROM opens r JOIN opens o ON o.idx BETWEEN r.idx - 4 AND r.idx JOIN open_results x ON x.open_id = o.open_id GROUP BY 1, 2) y WHERE total > 0)
"""


@query("t06_opens_ranking_history", ("open_results", "opens"), _HIST + "SELECT * FROM hist")
def t06(results, opens):
    return T.ranking_history(results, opens)


@query("t07_apply_penalties", ("open_results",), f"""
, x AS (SELECT player_id, CASE WHEN player_id % 13 = 0 THEN -20 ELSE {_PTS} END AS p, player_id % 13 = 0 AS pen FROM open_results WHERE open_id % 2 = 0)
SELECT player_id, sum(p) AS total, max(p) AS best, count(*) FILTER (p > 0) AS played, count(*) FILTER (pen) AS penalties, row_number() OVER (ORDER BY sum(p) DESC, max(p) DESC, player_id) AS k FROM x GROUP BY 1""")
def t07(results):
    cells = T.with_points(results.where("open_id % 2 = 0")).select("player_id", "open_id", "points")
    return T.apply_penalties(cells, cells.where("player_id % 13 = 0").select("player_id", "open_id", F.lit(-20).alias("penalty")))


@query("t08_official_override", ("open_results",), f"SELECT player_id, open_id, CASE WHEN player_id % 3 = 0 THEN {_PTS} + 1 ELSE {_PTS} END AS points, false AS provisional FROM open_results")
def t08(results):
    cells = T.with_points(results).select("player_id", "open_id", "points")
    return T.official_override(cells, cells.select("player_id", "open_id", (c("points") + F.when(c("player_id") % 3 == 0, 1).otherwise(0)).alias("points")))


@query("t10_open_dates", ("open_matches", "games"), """
, s AS (SELECT concat(least(concat(p1, ':', car1), concat(p2, ':', car2)), '|', greatest(concat(p1, ':', car1), concat(p2, ':', car2)), '|', ent) AS sig, played_on, ord FROM games), d AS (SELECT sig, arg_max(played_on, ord) AS d FROM s GROUP BY 1)
SELECT open_id, max(d) AS open_date FROM open_matches JOIN d ON sig = concat(least(concat(a, ':', car_a), concat(b, ':', car_b)), '|', greatest(concat(a, ':', car_a), concat(b, ':', car_b)), '|', ent) GROUP BY 1""")
def t10(matches, games):
    r = matches.select("open_id", game_signature(c("a"), c("car_a"), c("b"), c("car_b"), c("ent")).alias("sig"))
    return T.open_dates(r, games.select(game_signature(c("p1"), c("car1"), c("p2"), c("car2"), c("ent")).alias("sig"), "played_on", "ord"))


@query("t11_standings_from_games", ("open_matches", "players"), """
, s AS (SELECT open_id, ent, a AS player_id, pts_a AS pts, car_a AS car FROM open_matches WHERE is_played UNION ALL SELECT open_id, ent, b, pts_b, car_b FROM open_matches WHERE is_played),
x AS (SELECT open_id, player_id, sum(pts) AS pts, CAST(sum(car) AS DOUBLE) / nullif(sum(ent), 0) AS avg, row_number() OVER (PARTITION BY open_id ORDER BY sum(pts) DESC, CAST(sum(car) AS DOUBLE) / nullif(sum(ent), 0) DESC NULLS LAST, player_id) AS pos FROM s GROUP BY 1, 2)
SELECT * FROM x WHERE player_id % 10 <> 0""")
def t11(matches, players):
    return T.standings_from_games(matches, players.where("player_id % 10 <> 0"))


@query("t12_womens_circuit", ("open_results", "opens"), _HIST.replace(_PTS, "list_extract([100, 80, 60, 60, 40, 38, 36, 34, 20, 18, 16, 14], least(pos, 12))").replace("open_results x", "(SELECT * FROM open_results WHERE player_id % 2 = 0) x") + "SELECT * FROM hist")
def t12(results, opens):
    return T.ranking_history(results.where("player_id % 2 = 0"), opens, table="women_open")


@query("t13_circuit", ("raw_texts",), "SELECT id, tournament AS open_name FROM raw_texts WHERE tournament LIKE '%OPEN%' AND tournament LIKE '%TRES BANDES%'")
def t13(raw):
    return T.circuit(raw.select("id", F.col("tournament").alias("open_name")))


@query("t14_player_positions", ("open_results", "opens"), _HIST + """
SELECT h.player_id, min(k) AS best_place, max(CASE WHEN round = (SELECT max(round) FROM hist) THEN k END) AS now, (SELECT min(pos) FROM open_results r WHERE r.player_id = h.player_id) AS best_result FROM hist h GROUP BY 1""")
def t14(results, opens):
    return T.player_positions(T.ranking_history(results, opens), results)


def _ins(results, entries):
    from ..operators.rankings import latest

    e = latest(entries).where("discipline = 1").select("player_id", c("pos").alias("rank_pos"), "avg", "is_definitive")
    return results.select("open_id", "player_id", F.when(c("player_id") % 3 != 0, c("pts")).alias("points")).join(e, "player_id", "left")


_INS = """
, e1 AS (SELECT player_id, pos AS rank_pos, avg, is_definitive FROM ranking_entries WHERE discipline = 1 AND seq = (SELECT max(seq) FROM ranking_entries WHERE discipline = 1)),
ins AS (SELECT open_id, r.player_id, CASE WHEN r.player_id % 3 <> 0 THEN pts END AS points, rank_pos, avg, is_definitive FROM open_results r LEFT JOIN e1 ON e1.player_id = r.player_id),
o AS (SELECT *, row_number() OVER (PARTITION BY open_id ORDER BY coalesce(points, 0) DESC, CASE WHEN rank_pos IS NULL THEN 2 WHEN is_definitive THEN 0 ELSE 1 END, rank_pos NULLS LAST, avg DESC NULLS LAST, player_id) AS seed FROM ins)
"""


@query("t15_inscription_order", ("open_results", "ranking_entries"), _INS + "SELECT open_id, player_id, seed FROM o", last=True)
def t15(results, entries):
    return T.inscription_order(_ins(results, entries), ["open_id"]).select("open_id", "player_id", "seed")


@query("t17_inscription_anomalies", ("open_results", "ranking_entries"), _INS + """
, z AS (SELECT *, points * (1 + player_id % 2) AS pp FROM o)
SELECT open_id, player_id, 'error' AS level, 'points_without_ranking' AS what FROM z WHERE pp > 0 AND rank_pos IS NULL
UNION ALL SELECT open_id, player_id, 'warning', 'order' FROM (SELECT *, lag(pp) OVER (PARTITION BY open_id ORDER BY seed) AS b FROM z) y WHERE pp > b""", last=True)
def t17(results, entries):
    o = T.inscription_order(_ins(results, entries), ["open_id"])
    return T.inscription_anomalies(o.withColumn("points", c("points") * (1 + c("player_id") % 2)), ["open_id"])


_ALLOC = """
, al AS (SELECT open_id, n, seed, g2, g3, CASE WHEN seed <= 16 THEN 'KO' WHEN seed <= 64 - g2 THEN 'P' WHEN seed <= 64 + 2 * g2 - g3 THEN 'PP' ELSE 'PPP' END AS phase FROM (SELECT *, unnest(range(1, n + 1)) AS seed FROM (SELECT *, least(16, (n - 64) // 2) AS g2, greatest(0, (n - 64) // 2 - 16) AS g3 FROM nn WHERE n BETWEEN 64 AND 128 AND n % 2 = 0) a) b),
al2 AS (SELECT *, seed - CASE phase WHEN 'KO' THEN 1 WHEN 'P' THEN 17 WHEN 'PP' THEN 65 - g2 ELSE 65 + 2 * g2 - g3 END AS i, CASE phase WHEN 'PP' THEN g2 WHEN 'PPP' THEN g3 ELSE 16 END AS ng FROM al),
alloc AS (SELECT open_id, seed, phase, CASE WHEN phase = 'KO' THEN 17 - seed WHEN i < ng THEN i + 1 ELSE ng - i % ng END AS grp, CASE WHEN phase = 'KO' THEN 1 ELSE i // ng + 1 END AS slot FROM al2)
"""


@query("t18_seed_allocation", ("opens",), ", nn AS (SELECT open_id, 60 + (open_id * 7) % 72 AS n FROM opens)" + _ALLOC + "SELECT * FROM alloc UNION ALL SELECT open_id, NULL, 'unsupported', NULL, NULL FROM nn WHERE NOT (n BETWEEN 64 AND 128 AND n % 2 = 0)")
def t18(opens):
    return T.seed_allocation(opens.select("open_id", (60 + (c("open_id") * 7) % 72).alias("n")))


@query("t21_projection", ("open_results", "ranking_entries"), _INS + ", nn AS (SELECT open_id, count(*) - count(*) % 2 AS n FROM o GROUP BY 1)" + _ALLOC + "SELECT o.open_id, player_id, o.seed, phase, grp, slot FROM o LEFT JOIN alloc ON alloc.open_id = o.open_id AND alloc.seed = o.seed", last=True)
def t21(results, entries):
    return T.projection(_ins(results, entries), ["open_id"])


@query("t22_projection_vs_draw", ("opens",), ", nn AS (SELECT open_id, CAST(100 AS BIGINT) AS n FROM opens)" + _ALLOC + """
SELECT open_id, seed AS player_id, phase, CASE WHEN seed % 9 <> 0 THEN phase END AS real_phase, grp, CASE WHEN seed % 9 <> 0 THEN CASE WHEN seed % 5 = 0 THEN grp + 1 ELSE grp END END AS real_grp, CASE WHEN seed % 9 = 0 THEN 'not_drawn' WHEN seed % 5 = 0 THEN 'moved' ELSE 'same' END AS state FROM alloc""")
def t22(opens):
    a = T.seed_allocation(opens.select("open_id", F.lit(100).alias("n"))).withColumnRenamed("seed", "player_id")
    return T.projection_vs_draw(a, a.where("player_id % 9 <> 0").withColumn("grp", c("grp") + F.when(c("player_id") % 5 == 0, 1).otherwise(0)))


_MS = """
, ms AS (SELECT open_id, phase, kind, grp, game_id, ent, is_played, a AS player_id, b AS opp_id, car_a AS car, run_a AS run, pts_a AS pts FROM open_matches UNION ALL SELECT open_id, phase, kind, grp, game_id, ent, is_played, b, a, car_b, run_b, pts_b FROM open_matches),
gs AS (SELECT open_id, phase, grp, player_id, sum(pts) AS pts, CAST(sum(car) AS DOUBLE) / sum(ent) AS avg, max(run) AS run, row_number() OVER (PARTITION BY open_id, phase, grp ORDER BY sum(pts) DESC, CAST(sum(car) AS DOUBLE) / sum(ent) DESC, max(run) DESC, player_id) AS k FROM ms WHERE kind = 'group' AND is_played GROUP BY 1, 2, 3, 4),
cl AS (SELECT open_id, phase, grp, bool_and(is_played) OR (count(*) FILTER (is_played) >= 2 AND count(DISTINCT CASE WHEN is_played THEN concat(least(a, b), '-', greatest(a, b)) END) = 1) AS closed, count(*) FILTER (is_played) AS n_played, count(*) AS n FROM open_matches WHERE kind = 'group' GROUP BY 1, 2, 3),
kd AS (SELECT * FROM open_matches WHERE kind = 'ko' QUALIFY row_number() OVER (PARTITION BY open_id, phase, least(a, b), greatest(a, b) ORDER BY is_played DESC, ord) = 1),
kw AS (SELECT *, CASE WHEN is_played THEN CASE WHEN pts_a > pts_b THEN a WHEN pts_b > pts_a THEN b WHEN car_a > car_b THEN a WHEN car_b > car_a THEN b END END AS winner FROM kd)
"""


@query("t23_phase_stats", ("open_matches",), _MS + "SELECT open_id, phase, kind, player_id, count(*) AS n, sum(pts) AS pts, sum(car) AS car, sum(ent) AS ent, max(run) AS run, CAST(sum(car) AS DOUBLE) / sum(ent) AS avg FROM ms WHERE is_played GROUP BY 1, 2, 3, 4")
def t23(m):
    return B.phase_stats(m)


@query("t24_ko_winner", ("open_matches",), _MS + "SELECT open_id, phase, game_id, winner FROM kw")
def t24(m):
    return B.ko_winner(B.dedupe_ko(m.where("kind = 'ko'"))).select("open_id", "phase", "game_id", "winner")


@query("t26_group_closed", ("open_matches",), _MS + "SELECT * FROM cl")
def t26(m):
    return B.group_closed(m)


@query("t27_qualifiers", ("open_matches",), _MS + "SELECT open_id, phase, grp, player_id, k FROM gs WHERE k = 1 OR EXISTS (SELECT 1 FROM ms WHERE ms.open_id = gs.open_id AND ms.phase = gs.phase + 1 AND ms.player_id = gs.player_id)")
def t27(m):
    return B.qualifiers(m)


@query("t28_rank_winners", ("open_matches",), _MS + "SELECT gs.open_id, gs.phase, player_id, row_number() OVER (PARTITION BY gs.open_id, gs.phase ORDER BY pts DESC, avg DESC, run DESC, player_id) AS place FROM gs JOIN cl ON cl.open_id = gs.open_id AND cl.phase = gs.phase AND cl.grp = gs.grp AND closed WHERE k = 1")
def t28(m):
    return B.rank_winners(m)


@query("t29_pyramid_pairing", ("open_matches",), _MS + """
, pl AS (SELECT open_id, player_id, avg, run, row_number() OVER (PARTITION BY open_id ORDER BY avg DESC, run DESC, player_id) AS rn, count(*) OVER (PARTITION BY open_id) AS n FROM gs WHERE phase = 1 AND grp = 0)
SELECT x.open_id, x.rn, x.player_id AS a, y.player_id AS b FROM pl x JOIN pl y ON y.open_id = x.open_id AND y.rn = x.n + 1 - x.rn WHERE x.rn * 2 <= x.n AND x.n % 2 = 0""")
def t29(m):
    return B.pyramid_pairing(B.group_standings(m).where("phase = 1 and grp = 0"), ["open_id"])


@query("t30_first_ko_pool", ("open_matches", "open_results"), _MS + """
, r AS (SELECT open_id, player_id, pos AS seed FROM open_results WHERE pos <= 4), lp AS (SELECT open_id, max(phase) AS phase FROM open_matches WHERE kind = 'group' GROUP BY 1),
u AS (SELECT open_id, player_id, 0 AS part, seed, 0 AS pts, 0.0::DOUBLE AS avg FROM r UNION ALL SELECT gs.open_id, player_id, 1, NULL, pts, avg FROM gs JOIN lp ON lp.open_id = gs.open_id AND lp.phase = gs.phase WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM r WHERE r.open_id = gs.open_id AND r.player_id = gs.player_id)),
d AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY open_id, player_id ORDER BY part, pts DESC, avg DESC) = 1)
SELECT open_id, player_id, part, row_number() OVER (PARTITION BY open_id ORDER BY part, seed NULLS LAST, pts DESC, avg DESC, player_id) AS k FROM d""")
def t30(m, results):
    return B.first_ko_pool(results.where("pos <= 4").select("open_id", "player_id", c("pos").alias("seed")), m)


@query("t31_advancing", ("open_matches",), _MS + "SELECT DISTINCT kw.open_id, kw.phase, winner AS player_id, s.avg, s.run FROM kw JOIN (SELECT open_id, phase, player_id, CAST(sum(car) AS DOUBLE) / sum(ent) AS avg, max(run) AS run FROM ms WHERE is_played GROUP BY 1, 2, 3) s ON s.open_id = kw.open_id AND s.phase = kw.phase AND s.player_id = winner")
def t31(m):
    return B.advancing(m)


@query("t32_classification", ("open_matches",))
def t32(m):
    return B.classification(m)


@query("t33_seed_unplayed", ("open_matches", "open_results"), _MS + """
, g AS (SELECT open_id, grp, player_id, min(game_id) AS ord, bool_or(is_played AND game_id % 2 = 0) AS pb FROM ms WHERE phase = 2 GROUP BY 1, 2, 3), b AS (SELECT *, grp % 2 = 0 AS begun FROM g), adv AS (SELECT DISTINCT open_id, player_id FROM ms WHERE phase = 1), rk AS (SELECT player_id, min(pos) AS k FROM open_results GROUP BY 1)
SELECT b.open_id, grp, b.player_id, CASE WHEN begun THEN ord ELSE row_number() OVER (PARTITION BY b.open_id, grp ORDER BY adv.player_id IS NOT NULL, coalesce(rk.k, 1000000000), ord, b.player_id) END AS place FROM b LEFT JOIN adv ON adv.open_id = b.open_id AND adv.player_id = b.player_id LEFT JOIN rk ON rk.player_id = b.player_id""")
def t33(m, results):
    s = B.match_sides(m)
    g = s.where("phase = 2").groupBy("open_id", "grp", "player_id").agg(F.min("game_id").alias("ord")).withColumn("begun", c("grp") % 2 == 0)
    return B.seed_unplayed(g, results.groupBy("player_id").agg(F.min("pos").alias("k")), s.where("phase = 1").select("open_id", "player_id").distinct())


@query("t34_merge_phases", ("raw_texts",), """
, p AS (SELECT id % 50 AS open_id, CASE phase WHEN 'PRE-PRE-PRÈVIA' THEN 'PPP' WHEN 'Pre-prèvies' THEN 'PP' WHEN 'Prèvia' THEN 'P' WHEN 'Grup A' THEN 'GRUPA' ELSE 'FINAL' END AS code, phase, id % 3 = 0 AS is_real FROM raw_texts)
SELECT open_id, code, coalesce(min(phase) FILTER (is_real), min(phase) FILTER (NOT is_real)) AS label, count(*) FILTER (is_real) = 0 AS is_projected FROM p GROUP BY 1, 2""")
def t34(raw):
    p = raw.select((c("id") % 50).alias("open_id"), c("phase").alias("label"), "id")
    return B.merge_phases(p.where("id % 3 = 0"), p.where("id % 3 <> 0"))


@query("t35_superseded", ("raw_texts",), """
, nm AS (SELECT DISTINCT id % 7 = 0 AS is_real, tournament, id % 1000 AS no, min(id) AS id FROM raw_texts GROUP BY 1, 2, 3),
k AS (SELECT *, list_distinct(list_filter(string_split_regex(regexp_replace(regexp_replace(string_split(upper(strip_accents(concat(CASE WHEN is_real THEN '' ELSE 'GRAN ' END, tournament, ' ', 900000 + no))), '"')[1], 'TRES BANDES|3 BANDES|QUADRE 47/2|QUADRE 71/2|BANDA|LLIURE|OPEN|MEMORIAL|UNICA', ' ', 'g'), '[^A-Z0-9 ]', ' ', 'g'), ' +'), lambda t: t <> '')) AS toks,
 CASE WHEN tournament LIKE '%TRES BANDES%' OR tournament LIKE '%3 BANDES%' THEN 1 WHEN tournament LIKE '%QUADRE 47/2%' THEN 2 WHEN tournament LIKE '%QUADRE 71/2%' THEN 3 WHEN tournament LIKE '%BANDA%' THEN 4 WHEN tournament LIKE '%LLIURE%' THEN 5 ELSE 0 END AS d FROM nm)
SELECT p.id AS pid, min(r.id) AS rid FROM k p JOIN k r ON r.d = p.d AND list_has_all(p.toks, r.toks) WHERE NOT p.is_real AND r.is_real AND len(r.toks) > 0 GROUP BY 1""")
def t35(raw):
    """Real opens (every seventh order's) against all projections, by name and number."""
    n = raw.groupBy((c("id") % 7 == 0).alias("is_real"), "tournament", (c("id") % 1000).alias("no")).agg(F.min("id").alias("id"))
    n = n.withColumn("name", F.concat("tournament", F.lit(" "), (c("no") + 900000).cast("string")))
    return B.superseded(n.where("not is_real").select(c("id").alias("pid"), F.concat(F.lit("GRAN "), "name").alias("name")), n.where("is_real").select(c("id").alias("rid"), "name"))


@query("t38_resolve_names", ("players",), """
SELECT player_id AS id, CASE WHEN count(*) OVER (PARTITION BY name) = 1 THEN player_id END AS player_id FROM players""")
def t38(players):
    n = players.select(c("player_id").alias("id"), F.when(c("player_id") % 2 == 0, F.regexp_replace("name", ", ", ",")).otherwise(F.lower("name")).alias("name"))
    return T.resolve_names(n, players).select("id", "player_id")


@query("t40_calculated_round", ("open_results", "opens"), f"""
, w AS (SELECT open_id FROM opens ORDER BY idx DESC LIMIT 4), a AS (SELECT player_id, sum({_PTS}) AS o, max({_PTS}) AS ob FROM open_results WHERE open_id IN (SELECT open_id FROM w) GROUP BY 1), l AS (SELECT player_id, min(pos) AS pos FROM open_results WHERE open_id % 4 = 1 GROUP BY 1), b AS (SELECT player_id, {_PTS} AS n FROM l),
x AS (SELECT coalesce(a.player_id, b.player_id) AS player_id, coalesce(o, 0) + coalesce(n, 0) AS total, greatest(coalesce(ob, 0), coalesce(n, 0)) AS best, coalesce(n, 0) AS live_points FROM a FULL JOIN b ON b.player_id = a.player_id)
SELECT *, row_number() OVER (ORDER BY total DESC, best DESC, player_id) AS k FROM x WHERE total > 0""")
def t40(results, opens):
    return T.calculated_round(None, results.where("open_id % 4 = 1"), results, opens)


@query("t41_best_run_prize", ("open_matches", "open_results"), _MS + """
SELECT open_id, player_id, run FROM (SELECT open_id, player_id, max(run) AS run FROM ms WHERE is_played AND NOT EXISTS (SELECT 1 FROM open_results r WHERE r.open_id = ms.open_id AND r.player_id = ms.player_id AND r.pos <= 8) GROUP BY 1, 2) x QUALIFY run = max(run) OVER (PARTITION BY open_id)""")
def t41(m, results):
    return T.best_run_prize(m, results)


@query("t42_phase_status", ("open_matches",), "SELECT open_id, phase, count(*) AS n, count(*) FILTER (is_played) AS played, CASE WHEN count(*) = count(*) FILTER (is_played) THEN 'done' WHEN count(*) FILTER (is_played) > 0 THEN 'active' ELSE 'pending' END AS status FROM open_matches GROUP BY 1, 2")
def t42(m):
    return B.phase_status(m)
