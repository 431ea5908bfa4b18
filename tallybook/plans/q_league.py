"""Queries over clubs, league and cup."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clubs as C, games as G, league as L, rankings as R
from .registry import query

_LAST = "seq = (SELECT max(seq) FROM ranking_entries m WHERE m.discipline = e.discipline)"


@query("c01_club_kpis", ("clubs", "players", "sides"), """
SELECT c.club_id, club_name, (SELECT count(*) FROM players p WHERE p.club_id = c.club_id) AS n_players, (SELECT count(DISTINCT team_id) FROM sides s WHERE s.club_id = c.club_id) AS n_teams, (SELECT count(DISTINCT game_id) FROM sides s WHERE s.club_id = c.club_id) AS n_games FROM clubs c""")
def c01(clubs, players, sides):
    return C.club_kpis(clubs, players, sides)


@query("c02_club_players", ("sides",), "SELECT club_id, season, player_id, count(*) AS n FROM sides GROUP BY 1, 2, 3")
def c02(sides):
    return C.club_players(sides)


@query("c03_club_groups", ("league_ties",), "SELECT DISTINCT season, division_id, group_id, t // 4 AS club_id FROM (SELECT season, division_id, group_id, home AS t FROM league_ties UNION ALL SELECT season, division_id, group_id, away FROM league_ties) x")
def c03(ties):
    return C.club_groups(ties)


@query("c04_club_members", ("players", "sides"), """
SELECT club_id, player_id FROM players UNION SELECT club_id, player_id FROM sides WHERE season = '1999-2000' UNION SELECT arg_max(club_id, (played_on, game_id)), player_id FROM sides GROUP BY player_id""")
def c04(players, sides):
    return C.club_members(players, sides, "1999-2000")


@query("c06_group_summary", ("games", "players"), """
SELECT discipline, count(*) AS n, count(*) FILTER ((CASE WHEN winner_id = p1 THEN club1 WHEN winner_id = p2 THEN club2 END) < 6) AS won, count(*) FILTER ((CASE WHEN winner_id = p1 THEN club1 WHEN winner_id = p2 THEN club2 END) >= 6) AS lost, count(*) FILTER (winner_id IS NULL) AS drawn FROM games WHERE club1 < 6 OR club2 < 6 GROUP BY 1""")
def c06(games, players):
    return C.group_summary(games, players.where("club_id < 6"))


@query("c07_group_games", ("games", "players"), """
SELECT game_id, discipline, ent, CASE WHEN club1 < 6 THEN p1 ELSE p2 END AS player_id, CASE WHEN club1 < 6 THEN car1 ELSE car2 END AS car, CASE WHEN club1 < 6 THEN car2 ELSE car1 END AS opp_car,
 CASE WHEN car1 = car2 THEN 0 WHEN (car1 > car2) = (club1 < 6) THEN 1 ELSE -1 END AS result FROM games WHERE club1 < 6 OR club2 < 6""")
def c07(games, players):
    return C.group_games(games, players.where("club_id < 6"))


@query("c09_group_players", ("games", "players", "clubs"), """
SELECT player_id, name, club_name, (SELECT count(*) FROM games g WHERE g.p1 = p.player_id OR g.p2 = p.player_id) AS n_games FROM players p JOIN clubs c ON c.club_id = p.club_id WHERE p.club_id < 6""")
def c09(games, players, clubs):
    return C.group_players(games, players, clubs, players.where("club_id < 6"))


@query("c08_group_best_worst", ("games", "players"), """
SELECT discipline, game_id, CAST(car AS DOUBLE) / ent AS avg, 'best' AS list, row_number() OVER (PARTITION BY discipline ORDER BY CAST(car AS DOUBLE) / ent DESC, car DESC, game_id) AS rn FROM (SELECT game_id, discipline, ent, CASE WHEN club1 < 6 THEN car1 ELSE car2 END AS car FROM games WHERE club1 < 6 OR club2 < 6) x WHERE ent > 0 QUALIFY rn <= 3""")
def c08(games, players):
    return G.best_worst_games(C.group_games(games, players.where("club_id < 6")), key="discipline").where("list = 'best'")


@query("c10_player_levels", ("ranking_entries",), f"""
SELECT player_id, max(level) AS level, first(discipline ORDER BY level DESC, discipline) AS discipline FROM (SELECT player_id, discipline, CASE WHEN n <= 1 THEN 100.0::DOUBLE ELSE 100 * (1 - CAST(pos - 1 AS DOUBLE) / (n - 1)) END AS level FROM (SELECT *, count(*) OVER (PARTITION BY discipline) AS n FROM ranking_entries e WHERE {_LAST}) a) b GROUP BY 1""", last=True)
def c10(entries):
    return C.player_levels(R.latest(entries))


@query("c11_club_index", ("ranking_entries", "players"), f"""
, lv AS (SELECT player_id, max(level) AS level FROM (SELECT player_id, discipline, CASE WHEN n <= 1 THEN 100.0::DOUBLE ELSE 100 * (1 - CAST(pos - 1 AS DOUBLE) / (n - 1)) END AS level FROM (SELECT *, count(*) OVER (PARTITION BY discipline) AS n FROM ranking_entries e WHERE {_LAST}) a) b GROUP BY 1),
x AS (SELECT club_id, level, row_number() OVER (PARTITION BY club_id ORDER BY level DESC, lv.player_id) AS rn FROM lv JOIN players p ON p.player_id = lv.player_id),
y AS (SELECT club_id, round(avg(level) FILTER (rn <= 5), 6) AS power, round(sum(greatest(level - 50, 0) / 50), 6) AS mass, count(*) FILTER (level > 50) AS deep FROM x GROUP BY 1)
SELECT club_id, power, mass, deep, round(100 * mass / (SELECT max(mass) FROM y), 4) AS depth, round(0.6 * power + 0.4 * 100 * mass / (SELECT max(mass) FROM y), 4) AS idx FROM y""", last=True)
def c11(entries, players):
    return C.club_index(C.player_levels(R.latest(entries)).join(players.select("player_id", "club_id"), "player_id"))


@query("c12_resolve_sources", ("players", "open_results", "clubs", "sides"), """
, m AS (SELECT player_id, 'Manual ' || club_id AS c FROM players WHERE player_id % 13 = 0), o AS (SELECT player_id, open_id, CASE WHEN player_id % 5 = 0 THEN 'cap' ELSE 'Open ' || player_id % 41 END AS c FROM open_results),
oc AS (SELECT player_id, arg_max(c, open_id) AS c FROM o WHERE c <> 'cap' AND open_id >= 60 GROUP BY 1), oo AS (SELECT player_id, arg_max(c, open_id) AS c FROM o WHERE c <> 'cap' AND open_id < 60 GROUP BY 1),
lg AS (SELECT player_id, 'Club ' || max(club_id) AS c FROM sides WHERE competition = 'LLIGA' GROUP BY 1)
SELECT p.player_id, coalesce(m.c, oc.c, lg.c, oo.c) AS club, CASE WHEN m.c IS NOT NULL THEN 'manual' WHEN oc.c IS NOT NULL THEN 'open' WHEN lg.c IS NOT NULL THEN 'league' WHEN oo.c IS NOT NULL THEN 'old_open' ELSE 'none' END AS source
FROM players p LEFT JOIN m ON m.player_id = p.player_id LEFT JOIN oc ON oc.player_id = p.player_id LEFT JOIN lg ON lg.player_id = p.player_id LEFT JOIN oo ON oo.player_id = p.player_id""")
def c12(players, results, clubs, sides):
    c = F.col
    manual = players.where("player_id % 13 = 0").select("player_id", F.concat(F.lit("Manual "), c("club_id").cast("string")).alias("club"))
    o = results.select("player_id", "open_id", F.when(c("player_id") % 5 == 0, "cap").otherwise(F.concat(F.lit("Open "), (c("player_id") % 41).cast("string"))).alias("club"))
    lg = sides.where("competition = 'LLIGA'").select("player_id", "played_on", F.concat(F.lit("Club "), c("club_id").cast("string")).alias("club"))
    return C.resolve_sources(players, manual, o, lg, 60)


@query("c13_club_catalogue", ("raw_texts",), """
, x AS (SELECT CASE team WHEN 'C.B. MATARÓ "A"' THEN 'MATARO' WHEN 'C.B. MATARÓ “B”' THEN 'MATARO“B”' WHEN '01 C.B. BARCELONA A' THEN '01CBBARCELONAA' WHEN 'SANT ADRIÀ A' THEN 'SANTADRIAA' WHEN 'C.B.SANTS' THEN 'SANTS' WHEN 'SANTA ADRIÀ "D"' THEN 'SANTADRIA' WHEN 'S.B.F. MOLINS' THEN 'SBFMOLINS' WHEN 'B.C. GRANOLLERS "A"' THEN 'GRANOLLERS' ELSE 'CLUBBILLARBANYOLES(AMISTAT)' END AS key,
 CASE team WHEN 'C.B. MATARÓ "A"' THEN 'C.B. MATARÓ' WHEN 'SANTA ADRIÀ "D"' THEN 'SANTA ADRIÀ' WHEN 'B.C. GRANOLLERS "A"' THEN 'B.C. GRANOLLERS' ELSE team END AS display, CASE WHEN id % 3 = 0 THEN 'league' ELSE 'opens' END AS source FROM raw_texts WHERE team <> 'Cap')
SELECT key, count(*) AS total, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, min(display) AS display FROM x GROUP BY 1""")
def c13(raw):
    return C.catalogue(raw.select(F.col("team").alias("club"), F.when(F.col("id") % 3 == 0, "league").otherwise("opens").alias("source")))


@query("c16_missing_club_players", ("players",), "SELECT player_id, name FROM players WHERE club_id = 0 ORDER BY player_id LIMIT 20 OFFSET 2")
def c16(players):
    return C.paged(players.where("club_id = 0").select("player_id", "name"), ["player_id"], 2, 20)


@query("l01_league_groups", ("league_ties",), "SELECT season, division_id, group_id, count(*) AS n_ties, min(tie_date) AS since, max(tie_date) AS until FROM league_ties GROUP BY 1, 2, 3")
def l01(ties):
    return L.league_groups(ties)


_STAND = """
, t AS (SELECT season, division_id, group_id, home AS team_id, mp_home AS mp, mp_away AS om, pp_home AS pp FROM league_ties UNION ALL SELECT season, division_id, group_id, away, mp_away, mp_home, pp_away FROM league_ties),
st AS (SELECT season, division_id, group_id, team_id, count(*) AS played, count(*) FILTER (mp > om) AS won, count(*) FILTER (mp = om) AS drawn, count(*) FILTER (mp < om) AS lost, sum(mp) AS mp_for, sum(om) AS mp_against, sum(pp) AS pp_for, 3 * count(*) FILTER (mp > om) + count(*) FILTER (mp = om) AS points FROM t GROUP BY 1, 2, 3, 4)
"""


@query("l02_standings", ("league_ties",), _STAND + "SELECT *, row_number() OVER (PARTITION BY season, division_id, group_id ORDER BY points DESC, mp_for - mp_against DESC, team_id) AS k FROM st")
def l02(ties):
    return L.standings(ties)


@query("l04_official_standings", ("league_ties",), _STAND + """
, off AS (SELECT season, division_id, group_id, CASE WHEN team_id % 13 = 0 THEN team_id + 1000 * 4 ELSE team_id END AS team_id, CAST(row_number() OVER (PARTITION BY season, division_id, group_id ORDER BY points - team_id % 3 DESC, team_id) AS INT) AS pos, points - team_id % 3 AS points FROM st WHERE team_id % 7 <> 0),
fc AS (SELECT *, team_id // 4 AS club_id FROM st WHERE NOT EXISTS (SELECT 1 FROM off WHERE off.season = st.season AND off.division_id = st.division_id AND off.group_id = st.group_id AND off.team_id = st.team_id)),
fo AS (SELECT *, team_id // 4 AS club_id FROM off WHERE NOT EXISTS (SELECT 1 FROM st WHERE off.season = st.season AND off.division_id = st.division_id AND off.group_id = st.group_id AND off.team_id = st.team_id)),
c1 AS (SELECT * FROM fc QUALIFY count(*) OVER (PARTITION BY season, division_id, group_id, club_id) = 1), o1 AS (SELECT * FROM fo QUALIFY count(*) OVER (PARTITION BY season, division_id, group_id, club_id) = 1),
by_club AS (SELECT c1.*, o1.pos, o1.points AS opoints FROM c1 JOIN o1 ON o1.season = c1.season AND o1.division_id = c1.division_id AND o1.group_id = c1.group_id AND o1.club_id = c1.club_id),
z AS (SELECT st.season, st.division_id, st.group_id, st.team_id, st.points, st.pp_for, off.pos, off.points AS opoints FROM st JOIN off ON off.season = st.season AND off.division_id = st.division_id AND off.group_id = st.group_id AND off.team_id = st.team_id
 UNION ALL SELECT fc.season, fc.division_id, fc.group_id, fc.team_id, fc.points, fc.pp_for, by_club.pos, by_club.opoints FROM fc LEFT JOIN by_club ON by_club.season = fc.season AND by_club.division_id = fc.division_id AND by_club.group_id = fc.group_id AND by_club.team_id = fc.team_id)
SELECT season, division_id, group_id, team_id, points, pos AS opos, opoints, CASE WHEN points > opoints THEN points - opoints ELSE 0 END AS penalty,
 row_number() OVER (PARTITION BY season, division_id, group_id ORDER BY pos IS NULL, pos, points DESC, pp_for DESC, team_id) AS k FROM z""")
def l04(ties):
    from pyspark.sql import Window as W

    st = L.standings(ties)
    t = F.col("team_id")
    off = st.where(t % 7 != 0).select("season", "division_id", "group_id", F.when(t % 13 == 0, t + 4000).otherwise(t).alias("team_id"), F.row_number().over(W.partitionBy("season", "division_id", "group_id").orderBy(F.desc(F.col("points") - t % 3), t)).alias("pos"), (F.col("points") - t % 3).alias("points"))
    return L.merge_official(st, off)


@query("l05_matchdays", ("league_ties",), "SELECT season, division_id, group_id, year(tie_date) * 12 + month(tie_date) AS md, min(tie_date) AS first, count(*) AS n_ties, sum(n_games) AS n_games, row_number() OVER (PARTITION BY season, division_id, group_id ORDER BY min(tie_date)) AS k FROM league_ties GROUP BY 1, 2, 3, 4")
def l05(ties):
    return L.matchdays(ties)


@query("l08_tie_game_order", ("league_slots",), "SELECT season, team1, team2, game_id, row_number() OVER (PARTITION BY season, team1, team2 ORDER BY discipline, game_id) AS k FROM league_slots")
def l08(slots):
    return L.tie_game_order(slots)


@query("l09_league_player_ranking", ("sides",), """
SELECT *, row_number() OVER (PARTITION BY season, discipline ORDER BY pts DESC, avg DESC NULLS LAST, player_id) AS k FROM (SELECT season, discipline, player_id, count(*) AS played, count(*) FILTER (result = 1) AS won, sum(pts) AS pts, sum(car) AS car, sum(ent) AS ent, round(CAST(sum(car) AS DOUBLE) / sum(ent), 4) AS avg FROM sides WHERE competition = 'LLIGA' GROUP BY 1, 2, 3) x""")
def l09(sides):
    return L.player_ranking(sides.where("competition = 'LLIGA'"), ["season", "discipline"])


_SLOT = """
, ss AS (SELECT game_id, season, division_id, group_id, slot, ent, p1 AS player_id, team1 AS team_id, car1 AS car, run1 AS run, pts1 AS pts, pts2 AS op FROM league_slots WHERE is_played UNION ALL SELECT game_id, season, division_id, group_id, slot, ent, p2, team2, car2, run2, pts2, pts1 FROM league_slots WHERE is_played)
"""


@query("l11_slot_ranking", ("league_slots",), _SLOT + """
, tm AS (SELECT season, division_id, group_id, player_id, team_id FROM (SELECT season, division_id, group_id, player_id, team_id, row_number() OVER (PARTITION BY season, division_id, group_id, player_id ORDER BY count(*) DESC, team_id) AS r FROM ss GROUP BY 1, 2, 3, 4, 5) a WHERE r = 1),
y AS (SELECT season, division_id, group_id, player_id, count(*) AS played, count(*) FILTER (pts > op) AS won, count(*) FILTER (pts = op) AS drawn, count(*) FILTER (pts < op) AS lost, sum(pts) AS pts, max(run) AS best_run, CAST(sum(car) AS DOUBLE) / sum(ent) AS avg, count(*) FILTER (slot = 1) AS s1, count(*) FILTER (slot = 2) AS s2, count(*) FILTER (slot = 3) AS s3, count(*) FILTER (slot = 4) AS s4 FROM ss GROUP BY 1, 2, 3, 4)
SELECT *, row_number() OVER (PARTITION BY season, division_id, group_id ORDER BY pts DESC, avg DESC, best_run DESC, player_id) AS k FROM y JOIN tm USING (season, division_id, group_id, player_id)""")
def l11(slots):
    return L.slot_ranking(slots, ["season", "division_id", "group_id"])


@query("l12_scope_aggregate", ("league_slots",), _SLOT + "SELECT season, division_id, group_id, count(DISTINCT game_id) AS n_games, sum(car) AS car, sum(ent) AS ent, count(DISTINCT player_id) AS n_players, CAST(sum(car) AS DOUBLE) / sum(ent) AS avg FROM ss GROUP BY GROUPING SETS ((season, division_id, group_id), (season, division_id), (season))")
def l12(slots):
    return L.scope_aggregate(slots)


@query("l13_slot_performance", ("league_slots",), _SLOT + "SELECT player_id, slot, count(*) AS n, CAST(count(*) FILTER (pts > op) AS DOUBLE) / count(*) AS rate, CAST(sum(car) AS DOUBLE) / sum(ent) AS avg FROM ss GROUP BY 1, 2")
def l13(slots):
    return L.slot_performance(slots)


@query("l14_player_league_games", ("league_slots",), """
SELECT game_id, p1 AS player_id, CASE WHEN NOT is_played THEN '—' WHEN pts1 > pts2 THEN 'V' WHEN pts1 < pts2 THEN 'D' ELSE 'E' END AS letter FROM league_slots UNION ALL SELECT game_id, p2, CASE WHEN NOT is_played THEN '—' WHEN pts2 > pts1 THEN 'V' WHEN pts2 < pts1 THEN 'D' ELSE 'E' END FROM league_slots""")
def l14(slots):
    return L.slot_sides(slots).select("game_id", "player_id", "letter")


@query("l16_last_played_matchday", ("league_slots",), "SELECT season, division_id, group_id, max(year(played_on) * 12 + month(played_on)) AS md FROM league_slots WHERE is_played GROUP BY 1, 2, 3")
def l16(slots):
    return L.last_played_matchday(slots)


@query("l17_overview", ("league_slots",), """
SELECT s.*, n_teams FROM (SELECT season, division_id, group_id, count(DISTINCT year(played_on) * 12 + month(played_on)) AS n_months, count(*) AS n_games, count(*) FILTER (is_played) AS n_played FROM league_slots GROUP BY 1, 2, 3) s
JOIN (SELECT season, division_id, group_id, count(DISTINCT t) AS n_teams FROM (SELECT season, division_id, group_id, team1 AS t FROM league_slots UNION ALL SELECT season, division_id, group_id, team2 FROM league_slots) x GROUP BY 1, 2, 3) t USING (season, division_id, group_id)""")
def l17(slots):
    return L.overview(slots)


@query("l19_historical_standings", ("raw_texts",), """
SELECT CASE division WHEN '4ª DIVISIÓ' THEN '4a' WHEN '1 DIVISIÓ' THEN '1a' WHEN 'HONOR' THEN 'Honor' WHEN 'L''AMISTAT' THEN 'L''Amistat' WHEN 'PROMOCIÓ A 2a' THEN 'Promoció a 2a' WHEN 'promoció' THEN 'Promoció' WHEN 'ÚNICA' THEN 'Única' ELSE 'Tercera fase' END AS division,
 CASE grp WHEN 'FINAL FOUR A' THEN 'Final Four A' WHEN 'FINAL FOUR' THEN 'Final Four' WHEN 'FINAL 4a DIVISIÓ' THEN 'Final' WHEN 'SEMIFINAL B' THEN 'Semifinals B' WHEN 'PROMOCIÓ 3' THEN 'Promoció 3' WHEN 'PROMOCIÓ HONOR' THEN 'Promoció Honor' WHEN 'GRUP ÚNIC' THEN 'Únic' WHEN 'GRUP C' THEN 'C' WHEN 'd' THEN 'D' ELSE 'Fase prèvia' END AS grp, position AS pos, team, id AS ord
FROM raw_texts QUALIFY row_number() OVER (PARTITION BY 1, 2, 3 ORDER BY id DESC) = 1""".replace("PARTITION BY 1, 2, 3", "PARTITION BY division, grp, position"))
def l19(raw):
    return L.historical(raw.select("division", "grp", F.col("position").alias("pos"), "team", F.col("id").alias("ord")))


@query("l20_seasons_with_league", ("league_ties",), "SELECT DISTINCT season FROM league_ties")
def l20(ties):
    return ties.select("season").distinct()


@query("k01_cup_editions", ("cup_games",), "SELECT edition_id, min(season) AS season, count(DISTINCT matchday) AS n_matchdays, count(DISTINCT group_id) AS n_groups, count(*) AS n_games FROM cup_games GROUP BY 1")
def k01(cup):
    return L.cup_editions(cup)


@query("k02_cup_matchdays", ("cup_games",), "SELECT edition_id, matchday, string_agg(DISTINCT CAST(group_id AS STRING), ',' ORDER BY CAST(group_id AS STRING)) AS groups FROM cup_games GROUP BY 1, 2")
def k02(cup):
    return cup.groupBy("edition_id", "matchday").agg(F.array_join(F.array_sort(F.collect_set(F.col("group_id").cast("string"))), ",").alias("groups"))


@query("k03_cup_group_standings", ("cup_games",), """
, t AS (SELECT edition_id, group_id, matchday, team1, team2, sum(pts1) AS a, sum(pts2) AS b FROM cup_games GROUP BY 1, 2, 3, 4, 5),
x AS (SELECT edition_id, group_id, team1 AS team_id, CASE WHEN a > b THEN 2 WHEN a = b THEN 1 ELSE 0 END AS mp, a AS pp FROM t UNION ALL SELECT edition_id, group_id, team2, CASE WHEN b > a THEN 2 WHEN a = b THEN 1 ELSE 0 END, b FROM t)
SELECT edition_id, group_id, team_id, count(*) AS played, sum(mp) AS mp, sum(pp) AS pp, row_number() OVER (PARTITION BY edition_id, group_id ORDER BY sum(mp) DESC, sum(pp) DESC, team_id) AS k FROM x GROUP BY 1, 2, 3""")
def k03(cup):
    return L.cup_group_standings(cup)


_CUP = "SELECT *, row_number() OVER (PARTITION BY edition_id ORDER BY pts DESC, avg DESC NULLS LAST, player_id) AS k FROM (SELECT edition_id, player_id, count(*) AS played, count(*) FILTER (car > oc) AS won, sum(pts) AS pts, sum(car) AS car, sum(ent) AS ent, round(CAST(sum(car) AS DOUBLE) / sum(ent), 4) AS avg FROM (SELECT edition_id, ent, p1 AS player_id, car1 AS car, car2 AS oc, pts1 AS pts FROM cup_games WHERE ent > 0 UNION ALL SELECT edition_id, ent, p2, car2, car1, pts2 FROM cup_games WHERE ent > 0) s WHERE {0} GROUP BY 1, 2) x"


@query("k05_cup_player_ranking", ("cup_games",), _CUP.format("true"))
def k05(cup):
    return L.cup_player_ranking(cup)


@query("k06_cup_published_ranking", ("cup_games", "players"), _CUP.format("edition_id = (SELECT max(edition_id) FROM cup_games) AND player_id % 9 <> 0"))
def k06(cup, players):
    return L.cup_player_ranking(cup, players.where("player_id % 9 <> 0"), current_only=True)
