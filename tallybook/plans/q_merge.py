"""Queries over merging, ingest and repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import merge as M, repair as P
from ..sources.shared import durable
from .registry import query, raw_query

c = F.col


@query("i01_merge_coalesce", ("games",), """
SELECT game_id, CASE WHEN game_id % 3 = 0 AND game_id % 7 <> 0 THEN run1 + 100 WHEN game_id % 5 = 0 THEN NULL ELSE run1 END AS run1, CASE WHEN game_id % 3 = 0 THEN ent + 1 ELSE ent END AS ent FROM games""")
def i01(games):
    base = games.select("game_id", F.when(c("game_id") % 5 == 0, None).otherwise(c("run1")).alias("run1"), "ent")
    delta = games.where("game_id % 3 = 0").select("game_id", F.when(c("game_id") % 7 == 0, None).otherwise(c("run1") + 100).alias("run1"), (c("ent") + 1).alias("ent"), "ord")
    return M.merge_coalesce(base, delta, ["game_id"])


@query("i02_insert_ignore", ("games",), "SELECT game_id, ent FROM games WHERE game_id % 2 = 0 UNION ALL SELECT game_id, 0 FROM games WHERE game_id % 2 = 1 AND game_id % 3 = 0")
def i02(games):
    return M.insert_ignore(games.where("game_id % 2 = 0").select("game_id", "ent"), games.where("game_id % 3 = 0").select("game_id", F.lit(0).alias("ent")), ["game_id"])


@raw_query("i03_dedup_games", """
SELECT l_orderkey, l_linenumber, count(*) AS copies, max(l_quantity) AS car, min(l_partkey) AS pk FROM lineitem GROUP BY 1, 2""")
def i03(spark, sf_dir):
    raw = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return raw.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("copies"), F.max("l_quantity").alias("car"), F.min("l_partkey").alias("pk"))


@query("i04_update_entries", ("ranking_entries", "links"), """
SELECT discipline, seq, player_id, CASE WHEN player_id % 11 <> 0 AND n_games <> n_games - player_id % 2 THEN avg + 1 ELSE avg END AS avg, player_id % 11 <> 0 AND player_id % 2 <> 0 AS changed FROM ranking_entries""")
def i04(entries, links):
    k = ["discipline", "seq", "player_id"]
    inc = entries.select(*k, (c("avg") + 1).alias("avg"), F.when(c("player_id") % 11 == 0, None).otherwise(c("n_games") - c("player_id") % 2).alias("n_games"))
    return M.update_entries(entries, inc, links, k)


@query("i05_select_last_15", ("sides",), """
, x AS (SELECT *, CAST(car AS DOUBLE) / ent AS a, row_number() OVER w AS rn, lead(played_on) OVER w AS nd, lead(CAST(car AS DOUBLE) / ent) OVER w AS na, lag(played_on) OVER w AS pd, lag(CAST(car AS DOUBLE) / ent) OVER w AS pa FROM sides WINDOW w AS (PARTITION BY player_id, discipline ORDER BY played_on DESC, game_id))
SELECT player_id, discipline, game_id FROM x WHERE rn < 15 OR (rn = 15 AND NOT coalesce(nd = played_on AND na > a, false)) OR (rn = 16 AND coalesce(pd = played_on AND a > pa, false))""")
def i05(sides):
    return M.select_last(sides)


@query("i06_build_games", ("games", "players"), """
, nm AS (SELECT lower(strip_accents(name)) AS k, min(player_id) AS id FROM players GROUP BY 1 HAVING count(*) = 1),
g AS (SELECT game_id, pts1, pts2, lower(strip_accents(a.name)) AS k1, lower(strip_accents(b.name)) AS k2 FROM games JOIN players a ON a.player_id = p1 JOIN players b ON b.player_id = p2),
x AS (SELECT g.*, coalesce(CAST(n1.id AS STRING), concat('name:', k1)) AS id1, coalesce(CAST(n2.id AS STRING), concat('name:', k2)) AS id2 FROM g LEFT JOIN nm n1 ON n1.k = k1 LEFT JOIN nm n2 ON n2.k = k2)
SELECT game_id, id1, id2, CASE WHEN pts1 > pts2 THEN id1 WHEN pts2 > pts1 THEN id2 END AS winner FROM x""")
def i06(games, players):
    n = players.select("player_id", T.norm_name(c("name")).alias("k"))
    raw = games.join(n.select(c("player_id").alias("p1"), c("k").alias("key1")), "p1").join(n.select(c("player_id").alias("p2"), c("k").alias("key2")), "p2")
    return M.build_games(raw, M.unique_names(players, T.norm_name(c("name")))).select("game_id", "id1", "id2", "winner")


@query("i07_promote_placeholders", ("players",), """
, nm AS (SELECT lower(strip_accents(name)) AS k, min(player_id) AS id FROM players WHERE player_id % 2 = 0 GROUP BY 1 HAVING count(*) = 1)
SELECT p.player_id AS row_id, coalesce(CAST(nm.id AS STRING), concat('name:', lower(strip_accents(p.name)))) AS who FROM players p LEFT JOIN nm ON nm.k = lower(strip_accents(p.name))""")
def i07(players):
    facts = players.select(c("player_id").alias("row_id"), F.concat(F.lit("name:"), T.norm_name(c("name"))).alias("who"))
    return M.promote_placeholders(facts, M.unique_names(players.where("player_id % 2 = 0"), T.norm_name(c("name"))), ["who"])


@query("i08_resolve_club", ("clubs", "players"), """
, men AS (SELECT player_id, CASE player_id % 5 WHEN 0 THEN CAST(p.club_id AS STRING) WHEN 1 THEN upper(club_name) WHEN 2 THEN concat('alias ', p.club_id) WHEN 3 THEN concat('A.L.I.A.S ', p.club_id) ELSE 'nobody' END AS n, p.club_id AS club FROM players p JOIN clubs c ON c.club_id = p.club_id)
SELECT player_id, CASE WHEN player_id % 5 = 4 THEN NULL ELSE club END AS club_id FROM men""")
def i08(clubs, players):
    m = players.join(clubs, "club_id")
    s = c("club_id").cast("string")
    k = c("player_id") % 5
    m = m.select("player_id", F.when(k == 0, s).when(k == 1, F.upper("club_name")).when(k == 2, F.concat(F.lit("alias "), s)).when(k == 3, F.concat(F.lit("A.L.I.A.S "), s)).otherwise("nobody").alias("n"))
    return M.resolve_club(m, clubs, clubs.select(F.concat(F.lit("alias "), s).alias("alias"), "club_id"), c("n")).select("player_id", "club_id")


@query("i09_merge_clubs", ("players",), "SELECT player_id, CASE WHEN club_id IN (1, 2, 3) THEN 4 ELSE club_id END AS club_id FROM players")
def i09(players):
    m = players.where("club_id in (1, 2, 3)").select(c("club_id").alias("source"), (c("club_id") + 1).alias("target")).distinct()
    return M.merge_clubs(players.select("player_id", "club_id"), m)


@query("i10_enrich_by_signature", ("games",), """
, g AS (SELECT *, row_number() OVER (PARTITION BY played_on, least(p1 * 100 + car1, p2 * 100 + car2), greatest(p1 * 100 + car1, p2 * 100 + car2), ent ORDER BY game_id) AS dup FROM games)
SELECT game_id, CASE WHEN game_id % 2 = 0 THEN run1 ELSE CASE WHEN game_id % 3 <> 0 THEN run1 END END AS run1, CASE WHEN game_id % 3 <> 0 THEN run2 END AS run2, CASE WHEN game_id % 3 <> 0 THEN game_id END AS tie FROM g""")
def i10(games):
    rows = games.where("game_id % 3 <> 0").select("played_on", c("p2").alias("p1"), c("p1").alias("p2"), c("car2").alias("car1"), c("car1").alias("car2"), "ent", c("run2").alias("run1"), c("run1").alias("run2"), c("game_id").alias("tie"), "ord")
    g = games.withColumn("run1", F.when(c("game_id") % 2 == 0, c("run1"))).withColumn("run2", F.lit(None).cast("int"))
    return M.enrich_by_signature(g, rows)


@query("i11_league_rows", ("league_slots", "league_ties"), """
SELECT game_id, p1, p2, car1, car2, ent, CASE WHEN game_id % 5 = 0 THEN tie_date ELSE played_on END AS played_on FROM league_slots s LEFT JOIN league_ties t ON t.season = s.season AND t.home = team1 AND t.away = team2 WHERE is_played AND NOT (car1 = 0 AND car2 = 0)""")
def i11(slots, ties):
    dates = ties.select("season", c("home").alias("team1"), c("away").alias("team2"), "tie_date")
    return M.league_rows(slots.withColumn("played_on", F.when(c("game_id") % 5 != 0, c("played_on"))), dates)


@query("i12_impute_innings", ("league_slots",), """
, s AS (SELECT *, CASE WHEN game_id % 4 = 0 THEN NULL ELSE ent END AS e FROM league_slots), g AS (SELECT season, group_id, discipline, max(greatest(car1, car2)) AS d, max(e) AS m FROM s GROUP BY 1, 2, 3)
SELECT game_id, CASE WHEN coalesce(e, 0) = 0 AND greatest(car1, car2) < d THEN CASE WHEN s.discipline = 1 THEN 50 ELSE m END ELSE e END AS ent FROM s JOIN g ON g.season = s.season AND g.group_id = s.group_id AND g.discipline = s.discipline""")
def i12(slots):
    return M.impute_innings(slots.withColumn("ent", F.when(c("game_id") % 4 != 0, c("ent"))), ["season", "group_id", "discipline"])


@query("i13_reconcile_dates", ("rankings",), """
, h AS (SELECT DISTINCT seq + CASE WHEN seq % 10 = 0 THEN 1000 ELSE 0 END AS seq, make_date(CAST(y AS INT), CAST(m AS INT), CASE WHEN seq % 4 = 0 THEN 28 ELSE 3 END) AS pub_date FROM rankings WHERE seq % 7 <> 0),
hm AS (SELECT seq, pub_date, (date_trunc('month', pub_date) + CASE WHEN date_diff('day', pub_date, last_day(pub_date)) <= 5 THEN INTERVAL 1 MONTH ELSE INTERVAL 0 MONTH END)::DATE AS month FROM h)
SELECT coalesce(r.seq, hm.seq) AS seq, discipline, pub_date, month, CASE WHEN discipline IS NULL THEN 'missing' WHEN month IS NULL THEN 'undated' WHEN month <> make_date(CAST(y AS INT), CAST(m AS INT), 1) THEN 'changed' ELSE 'same' END AS state FROM rankings r FULL JOIN hm ON hm.seq = r.seq""")
def i13(rankings):
    h = rankings.where("seq % 7 <> 0").select((c("seq") + F.when(c("seq") % 10 == 0, 1000).otherwise(0)).alias("seq"), F.make_date("y", "m", F.when(c("seq") % 4 == 0, 28).otherwise(3)).alias("pub_date"))
    return M.reconcile_dates(rankings, h)


@query("i14_new_rankings", ("rankings",), "SELECT discipline, seq FROM rankings r WHERE seq > (SELECT max(seq) FROM rankings q WHERE q.discipline = r.discipline AND y < 2000)")
def i14(rankings):
    return M.new_rankings(rankings, rankings.where("y < 2000"))


@query("i15_pending_work", ("ranking_entries",), "SELECT discipline, seq, player_id FROM ranking_entries WHERE player_id % 3 = 0 AND seq % 2 = 0")
def i15(entries):
    entries = durable(entries.select("discipline", "seq", "player_id"))  # three uses, one making
    return M.pending_work(entries, entries.where("player_id % 3 <> 0"), entries.where("seq % 2 = 1"))


@query("i16_backfill_selection", ("ranking_entries", "players"), """
SELECT discipline, seq, e.player_id, row_number() OVER (PARTITION BY discipline, seq ORDER BY CASE WHEN e.player_id % 20 = 3 THEN NULL ELSE pos END NULLS LAST, e.player_id) AS k FROM ranking_entries e LEFT JOIN players p ON p.player_id = e.player_id WHERE e.player_id % 20 = 3 OR pos <= 10 OR followed""")
def i16(entries, players):
    return M.backfill_selection(entries.withColumn("pos", F.when(c("player_id") % 20 != 3, c("pos"))), players, 10)


@query("i17_complete_matchdays", ("league_slots",), "SELECT season, team1, team2, min(CASE WHEN game_id % 19 = 0 THEN -1 ELSE game_id END) >= 0 AND bool_and(is_played) AS complete FROM league_slots GROUP BY 1, 2, 3")
def i17(slots):
    return M.complete_matchdays(slots.withColumn("tie_id", F.when(c("game_id") % 19 == 0, -1).otherwise(c("game_id"))), ["season", "team1", "team2"])


@query("i18_fix_winners", ("games",), """
SELECT * FROM (SELECT game_id, CASE WHEN game_id % 11 = 0 THEN p2 ELSE winner_id END AS winner_id, CASE WHEN car1 > car2 THEN p1 WHEN car2 > car1 THEN p2 END AS "right" FROM games) x WHERE winner_id IS DISTINCT FROM "right" """)
def i18(games):
    return P.fix_winners(games.withColumn("winner_id", F.when(c("game_id") % 11 == 0, c("p2")).otherwise(c("winner_id"))))


def _copies(games):
    games = durable(games.select("game_id", "p1", "p2", "car1", "car2", "ent", "played_on", "discipline", "competition", "ord"))
    rev = games.where("game_id % 6 = 0").select((c("game_id") + 1_000_000_000).alias("game_id"), c("p2").alias("p1"), c("p1").alias("p2"), c("car2").alias("car1"), c("car1").alias("car2"), "ent", "played_on", "discipline", "competition", (c("ord") + 1_000_000_000).alias("ord"))
    g = games.select("game_id", "p1", "p2", "car1", "car2", "ent", "played_on", "discipline", "competition", "ord").unionByName(rev)
    return g, g.where("game_id % 5 <> 0").select("game_id", "discipline")


_COPIES = """
, gg AS (SELECT game_id, p1, p2, car1, car2, ent, played_on, discipline, competition, ord FROM games UNION ALL SELECT game_id + 1000000000, p2, p1, car2, car1, ent, played_on, discipline, competition, ord + 1000000000 FROM games WHERE game_id % 6 = 0),
lk AS (SELECT game_id, discipline FROM gg WHERE game_id % 5 <> 0),
x AS (SELECT gg.*, lk.discipline AS ld, concat(least(p1 * 100 + car1, p2 * 100 + car2), '|', greatest(p1 * 100 + car1, p2 * 100 + car2), '|', ent, '|', played_on) AS k FROM gg LEFT JOIN lk USING (game_id))
"""


@query("i19_dedup_cross_source", ("games",), _COPIES + """
, g AS (SELECT k, arg_min(game_id, ord) FILTER (ld IS NOT NULL) AS keeper, min(competition) FILTER (competition <> 'INDIVIDUAL') AS takes FROM x GROUP BY 1 HAVING count(*) > 1 AND count(DISTINCT ld) = 1)
SELECT keeper, game_id AS dropped, takes FROM x JOIN g USING (k) WHERE game_id <> keeper""")
def i19(games):
    return P.dedup_cross_source(*_copies(games))


@query("i20_dedup_reversed", ("games",), _COPIES + """
SELECT game_id, keeper FROM (SELECT game_id, first(game_id) OVER (PARTITION BY k, discipline ORDER BY ld IS NULL, ord) AS keeper FROM x) y WHERE game_id <> keeper""")
def i20(games):
    return P.dedup_reversed(*_copies(games))[0]


@query("i21_clean_games", ("games",), """
SELECT game_id, CASE WHEN run1 > car1 OR (discipline = 1 AND run1 > 20) THEN NULL ELSE run1 END AS run1, CASE WHEN r2 > car2 OR (discipline = 1 AND r2 > 20) THEN NULL ELSE r2 END AS run2,
 CASE WHEN discipline = 1 AND car1 = car2 AND car1 > 0 AND e BETWEEN 1 AND 9 THEN e * 10 ELSE e END AS ent FROM (SELECT *, run2 * 3 AS r2, CASE WHEN game_id % 4 = 0 THEN ent % 10 ELSE ent END AS e FROM games) x WHERE NOT (discipline = 1 AND e > 0 AND CAST(greatest(car1, car2) AS DOUBLE) / e > 2.7)""")
def i21(games):
    return P.clean_games(games.withColumn("run2", c("run2") * 3).withColumn("ent", F.when(c("game_id") % 4 == 0, c("ent") % 10).otherwise(c("ent"))))


@query("i22_fix_ranking_averages", ("ranking_entries", "links"), """
SELECT e.discipline, e.seq, e.player_id, CASE WHEN e.player_id % 4 = 0 THEN avg + 1 ELSE avg END AS avg, CAST(l.c AS DOUBLE) / l.e AS new FROM ranking_entries e JOIN (SELECT discipline, seq, player_id, sum(car) AS c, sum(ent) AS e FROM links GROUP BY 1, 2, 3) l ON l.discipline = e.discipline AND l.seq = e.seq AND l.player_id = e.player_id
WHERE l.e >= 10 AND l.c > 0 AND e.player_id % 8 = 0""")
def i22(entries, links):
    e = entries.withColumn("avg", F.when(c("player_id") % 4 == 0, c("avg") + 1).otherwise(c("avg"))).withColumn("ent", F.when(c("player_id") % 8 == 0, F.floor(c("ent") / 2)).otherwise(c("ent")))
    return P.fix_ranking_averages(e, links, None)


@query("i23_backfill_clubs", ("players", "open_results"), """
SELECT p.player_id, CASE WHEN p.player_id % 3 <> 0 THEN concat('C', p.club_id) ELSE r.club END AS club FROM players p LEFT JOIN (SELECT player_id, concat('O', max(open_id)) AS club FROM open_results WHERE open_id % 4 <> 0 GROUP BY 1) r ON r.player_id = p.player_id""")
def i23(players, results):
    p = players.select("player_id", F.when(c("player_id") % 3 == 0, "Cap").otherwise(F.concat(F.lit("C"), c("club_id").cast("string"))).alias("club"))
    r = results.select("player_id", "open_id", F.when(c("open_id") % 4 == 0, " ").otherwise(F.concat(F.lit("O"), c("open_id").cast("string"))).alias("club"))
    return P.backfill_clubs(p, r)


@query("i25_clean_tournament_names", ("raw_texts",), """
SELECT id, tournament, CASE WHEN tournament LIKE 'VI OPEN%' THEN 'VI OPEN MATARÓ "LES SANTES"' WHEN tournament LIKE 'I OPEN%' THEN 'I OPEN CIUTAT DE VIC' WHEN tournament LIKE 'MEMORIAL%' THEN 'MEMORIAL PERE ROIG' ELSE 'QUADRE  71/2' END AS new FROM raw_texts WHERE tournament LIKE 'VI OPEN%' OR tournament LIKE 'I OPEN%' OR tournament LIKE 'MEMORIAL%' OR tournament LIKE 'QUADRE  71%'""")
def i25(raw):
    return P.renamed(raw.select("id", "tournament"), "tournament", T.clean_tournament)


@query("n34_repair_encoding", ("players",), "SELECT player_id, name FROM players")
def n34(players):
    bad = F.decode(F.encode("name", "UTF-8"), "ISO-8859-1")
    return P.repair_encoding(players.select("player_id", F.when(c("player_id") % 2 == 0, bad).otherwise(c("name")).alias("name")), "name")
