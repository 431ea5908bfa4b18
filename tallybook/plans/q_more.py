"""Queries over the remaining pages, marts and lists."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import brackets as B, clubs as C, league as L, rankings as R, tournaments as TT
from ..sources import tables as S
from ..sources.shared import shared_dir
from .registry import query, raw_query

c = F.col
_LAST = "seq = (SELECT max(seq) FROM ranking_entries m WHERE m.discipline = e.discipline)"


@query("g26_publish_games", ("games", "players"), """
SELECT g.game_id, g.played_on, g.discipline, a.name AS name1, b.name AS name2, car1, car2, ent, winner_id, CASE competition WHEN 'LLIGA' THEN CASE WHEN discipline = 1 THEN 'Lliga 3 Bandes' ELSE 'Lliga 4 Modalitats' END ELSE competition END AS label FROM games g JOIN players a ON a.player_id = p1 JOIN players b ON b.player_id = p2""")
def g26(games, players):
    n = players.select("player_id", "name")
    label = F.when(c("competition") == "LLIGA", F.when(c("discipline") == 1, "Lliga 3 Bandes").otherwise("Lliga 4 Modalitats")).otherwise(T.competition_label(c("competition"), c("discipline")))
    x = games.join(n.select(c("player_id").alias("p1"), c("name").alias("name1")), "p1").join(n.select(c("player_id").alias("p2"), c("name").alias("name2")), "p2")
    return x.select("game_id", "played_on", "discipline", "name1", "name2", "car1", "car2", "ent", "winner_id", label.alias("label"))


_NAMES = "(SELECT DISTINCT division_id, group_id, concat('Divisió ', division_id, ' grup ', group_id) AS name FROM league_ties WHERE group_id <> 3)"


def _names(ties):
    return ties.where("group_id <> 3").select("division_id", "group_id", F.concat(F.lit("Divisió "), c("division_id").cast("string"), F.lit(" grup "), c("group_id").cast("string")).alias("name")).distinct()


@query("l03_league_tree", ("league_ties",), f"""
SELECT season, t.division_id, t.group_id, coalesce(name, concat('Grup ', t.group_id)) AS name, count(*) AS n_ties FROM league_ties t LEFT JOIN {_NAMES} n ON n.division_id = t.division_id AND n.group_id = t.group_id GROUP BY 1, 2, 3, 4""")
def l03(ties):
    t = L.league_tree(L.league_groups(ties).select("season", "division_id", "group_id", "n_ties"), _names(ties))
    return t.select("season", F.explode("divisions").alias("d")).select("season", "d.division_id", F.explode("d.groups").alias("g")).select("season", "division_id", "g.group_id", "g.name", "g.n_ties")


@query("l06_tie_detail", ("league_slots", "players"), """
SELECT season, team1, team2, game_id, slot, a.name AS name1, car1, b.name AS name2, car2, ent, row_number() OVER (PARTITION BY season, team1, team2 ORDER BY slot, game_id) AS k FROM league_slots LEFT JOIN players a ON a.player_id = p1 LEFT JOIN players b ON b.player_id = p2""")
def l06(slots, players):
    return L.tie_detail(slots, players)


_GPR = """
, ss AS (SELECT season, division_id, group_id, played_on, game_id, ent, p1 AS player_id, team1 AS team_id, car1 AS car, pts1 AS pts FROM league_slots WHERE is_played UNION ALL SELECT season, division_id, group_id, played_on, game_id, ent, p2, team2, car2, pts2 FROM league_slots WHERE is_played),
y AS (SELECT season, division_id, group_id, player_id, sum(pts) AS pts, round(CAST(sum(car) AS DOUBLE) / sum(ent), 4) AS avg, arg_max(team_id, (played_on, game_id)) AS team_id FROM ss GROUP BY 1, 2, 3, 4),
z AS (SELECT *, row_number() OVER (PARTITION BY season, division_id, group_id ORDER BY pts DESC, avg DESC, player_id) AS k FROM y), gp AS (SELECT * FROM z WHERE player_id % 9 <> 0)
"""


@query("l10_group_player_ranking", ("league_slots", "players"), _GPR + "SELECT * FROM gp")
def l10(slots, players):
    return L.group_player_ranking(slots, players.where("player_id % 9 <> 0"))


@query("l15_team_detail", ("league_slots", "players"), _GPR + "SELECT *, row_number() OVER (PARTITION BY season, division_id, group_id, team_id ORDER BY k) AS in_team FROM gp")
def l15(slots, players):
    return L.team_detail(L.group_player_ranking(slots, players.where("player_id % 9 <> 0")))


@query("l18_division_ranking", ("league_slots",), """
, ss AS (SELECT season, division_id, ent, p1 AS player_id, car1 AS car, run1 AS run, pts1 AS pts FROM league_slots WHERE is_played UNION ALL SELECT season, division_id, ent, p2, car2, run2, pts2 FROM league_slots WHERE is_played)
SELECT season, division_id, player_id, sum(pts) AS pts, row_number() OVER (PARTITION BY season, division_id ORDER BY sum(pts) DESC, CAST(sum(car) AS DOUBLE) / sum(ent) DESC, max(run) DESC, player_id) AS k FROM ss GROUP BY 1, 2, 3""")
def l18(slots):
    return L.slot_ranking(slots, ["season", "division_id"]).select("season", "division_id", "player_id", "pts", "k")


@query("l21_find_names", ("league_ties",), f"SELECT tie_id, concat_ws(' · ', concat('D', t.division_id), n.name) AS phase_name FROM league_ties t LEFT JOIN {_NAMES} n ON n.division_id = t.division_id AND n.group_id = t.group_id AND n.group_id <> 0")
def l21(ties):
    d = ties.select("division_id").distinct().select("division_id", F.lit(0).cast("long").alias("group_id"), F.concat(F.lit("D"), c("division_id").cast("string")).alias("name"))
    return L.find_names(ties, _names(ties).where("group_id <> 0").unionByName(d)).select("tie_id", "phase_name")


@query("k04_cup_tie_detail", ("cup_games", "players"), """
SELECT edition_id, matchday, team1, team2, game_id, a.name AS name1, car1, b.name AS name2, car2, row_number() OVER (PARTITION BY edition_id, matchday, team1, team2 ORDER BY game_id) AS k FROM cup_games LEFT JOIN players a ON a.player_id = p1 LEFT JOIN players b ON b.player_id = p2""")
def k04(cup, players):
    x = L.tie_detail(cup.withColumn("season", F.concat_ws("|", c("edition_id").cast("string"), c("matchday").cast("string"))).withColumn("slot", F.lit(1)), players)
    p = F.split("season", r"\|")
    return x.select(p[0].cast("long").alias("edition_id"), p[1].cast("long").alias("matchday"), "team1", "team2", "game_id", "name1", "car1", "name2", "car2", "k")


@query("k07_publish_cup", ("cup_games",), "SELECT edition_id, group_id, count(DISTINCT matchday) AS n_matchdays, count(*) AS n_games FROM cup_games WHERE edition_id = (SELECT max(edition_id) FROM cup_games) AND team1 <> 0 AND team2 <> 0 GROUP BY 1, 2")
def k07(cup):
    last = cup.agg(F.max("edition_id").alias("edition_id"))
    return cup.join(F.broadcast(last), "edition_id").where("team1 <> 0 and team2 <> 0").groupBy("edition_id", "group_id").agg(F.countDistinct("matchday").alias("n_matchdays"), F.count("*").alias("n_games"))


@query("r12_changed_windows", ("links",), """
, l AS (SELECT * FROM links k WHERE seq = (SELECT max(seq) FROM links m WHERE m.discipline = k.discipline))
SELECT discipline, player_id, count(*) AS n_changed FROM l WHERE game_id % 7 = 0 OR game_id % 11 = 0 GROUP BY 1, 2""", last=True)
def r12(links):
    last = R.latest(links)
    return R.changed_windows(last.where("game_id % 7 <> 0 and game_id % 11 <> 0"), last)


@query("r13_club_page", ("ranking_entries", "players"), f"""
SELECT club_id, p.player_id, b.pos, b.avg, row_number() OVER (PARTITION BY club_id ORDER BY b.pos NULLS LAST, p.player_id) AS k FROM players p LEFT JOIN (SELECT * FROM ranking_entries e WHERE {_LAST} QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY pos, discipline) = 1) b ON b.player_id = p.player_id""", last=True)
def r13(entries, players):
    return R.club_page(entries, players)


@query("c05_set_sizes", ("players", "sides"), """
SELECT p.player_id % 5 AS set_id, p.player_id, coalesce(n, 0) AS n_games, count(*) OVER (PARTITION BY p.player_id % 5) AS size FROM players p LEFT JOIN (SELECT player_id, count(*) AS n FROM sides GROUP BY 1) s ON s.player_id = p.player_id""")
def c05(players, sides):
    return C.set_sizes(players.select((c("player_id") % 5).alias("set_id"), "player_id"), sides)


@query("c14_club_history", ("sides",), """
, e AS (SELECT player_id, season, concat(CASE WHEN player_id % 4 = 0 THEN 'C.B. CLUB' ELSE 'CLUB' END, CASE WHEN game_id % 3 = 0 THEN (club_id + 1) % 41 ELSE club_id END, CASE WHEN player_id % 4 = 0 THEN ' "A"' ELSE '' END) AS t FROM sides WHERE competition = 'INDIVIDUAL'),
l AS (SELECT player_id, season, concat('C.B. CLUB', club_id, ' A') AS t FROM sides WHERE competition = 'LLIGA'),
m AS (SELECT *, row_number() OVER (PARTITION BY player_id, season ORDER BY src, n DESC, t) AS r FROM (SELECT player_id, season, t, count(*) AS n, 'entries' AS src FROM e GROUP BY ALL UNION ALL SELECT player_id, season, t, count(*), 'league' FROM l GROUP BY ALL) u),
z AS (SELECT player_id, season, src, CAST(regexp_extract(t, 'CLUB([0-9]+)', 1) AS INT) AS k, t LIKE 'C.B.%' AS pre FROM m WHERE r = 1), f AS (SELECT k, bool_or(pre) AS pre FROM z GROUP BY 1)
SELECT player_id, season, src AS source, CASE WHEN pf AND z.k IN (1, 2) THEN 'C.B.CLUB3' WHEN pf THEN concat('C.B.CLUB', z.k) ELSE concat('CLUB', z.k) END AS club FROM z JOIN (SELECT k, pre AS pf FROM f) f ON f.k = z.k""")
def c14(sides):
    no = F.when(c("game_id") % 3 == 0, (c("club_id") + 1) % 41).otherwise(c("club_id")).cast("string")
    four = c("player_id") % 4 == 0
    entries = sides.where("competition = 'INDIVIDUAL'").select("player_id", "season", F.concat(F.when(four, "C.B. CLUB").otherwise("CLUB"), no, F.when(four, ' "A"').otherwise("")).alias("club"))
    league = sides.where("competition = 'LLIGA'").select("player_id", "season", F.concat(F.lit("C.B. CLUB"), c("club_id").cast("string"), F.lit(" A")).alias("club"))
    manual = sides.where("club_id in (1, 2)").select(F.concat(F.lit("C.B.CLUB"), c("club_id").cast("string")).alias("a"), F.concat(F.lit("C.B.CLUB"), (c("club_id") + 1).cast("string")).alias("b")).distinct()
    return C.club_history(entries, league, manual)


@query("c15_alias_list", ("players",), "SELECT club_id, string_agg(concat('a', player_id), ', ' ORDER BY concat('a', player_id)) AS aliases FROM players GROUP BY 1")
def c15(players):
    return C.alias_list(players.select("club_id", F.concat(F.lit("a"), c("player_id").cast("string")).alias("alias")))


@query("t04_open_window", ("opens",), "SELECT a.open_id AS as_of, b.open_id FROM opens a JOIN opens b ON b.idx BETWEEN a.idx - 4 AND a.idx")
def t04(opens):
    return TT.open_window(opens)


@query("t16_inscription_enrich", ("players", "open_results"), """
, e AS (SELECT concat(name, ' ', player_id) AS name, player_id AS rank_pos, player_id / 2 AS avg FROM players WHERE player_id % 3 <> 0), q AS (SELECT concat(name, ' ', player_id) AS name, player_id * 2 AS points FROM players WHERE player_id % 2 = 0)
SELECT r.open_id, lower(concat(p.name, ' ', p.player_id)) AS name, coalesce(CASE WHEN pos < 5 THEN 7 END, q.points) AS points, rank_pos, avg, rank_pos IS NULL AND q.points IS NULL AS unmatched FROM open_results r JOIN players p ON p.player_id = r.player_id LEFT JOIN e ON e.name = concat(p.name, ' ', p.player_id) LEFT JOIN q ON q.name = concat(p.name, ' ', p.player_id)""")
def t16(players, results):
    full = F.concat("name", F.lit(" "), c("player_id").cast("string"))
    ins = results.join(players, "player_id").select("open_id", F.lower(full).alias("name"), F.when(c("pos") < 5, 7).alias("points"))
    e = players.where("player_id % 3 <> 0").select(full.alias("name"), c("player_id").alias("rank_pos"), (c("player_id") / 2).alias("avg"))
    return TT.inscription_enrich(ins, e, players.where("player_id % 2 = 0").select(full.alias("name"), (c("player_id") * 2).alias("points")))


@query("t25_dedupe_ko", ("open_matches",), "SELECT open_id, phase, game_id FROM open_matches WHERE kind = 'ko' QUALIFY row_number() OVER (PARTITION BY open_id, phase, least(a, b), greatest(a, b) ORDER BY is_played DESC, ord) = 1")
def t25(m):
    return B.dedupe_ko(m.where("kind = 'ko'")).select("open_id", "phase", "game_id")


@query("t36_complete_reserved", ("players",), """
SELECT player_id % 7 AS open_id, concat(name, ' ') AS name, concat('Club', player_id) AS club, 'live' AS source FROM players WHERE player_id % 2 = 0 UNION ALL SELECT player_id % 7, name, concat('CLUB ', player_id), 'projected' FROM players WHERE player_id % 2 = 1""")
def t36(players):
    i = c("player_id").cast("string")
    live = players.where("player_id % 2 = 0").select((c("player_id") % 7).alias("open_id"), F.concat("name", F.lit(" ")).alias("name"), F.concat(F.lit("Club"), i).alias("club"))
    return TT.complete_reserved(live, players.select((c("player_id") % 7).alias("open_id"), "name", F.concat(F.lit("CLUB "), i).alias("club")))


@query("t37_attach_schedule", ("players",), "SELECT player_id % 7 AS open_id, concat('G', player_id) AS label, CAST(player_id * 10 AS BIGINT) AS starts FROM players")
def t37(players):
    g = players.select((c("player_id") % 7).alias("open_id"), F.concat(F.lit("G"), c("player_id").cast("string")).alias("label"), c("player_id").alias("ord"))
    s = g.select("open_id", F.when(c("ord") % 3 == 0, F.concat(F.lit("Grup "), "label")).otherwise(c("label")).alias("label"), (c("ord") * 10).alias("starts"), "ord")
    return TT.attach_schedule(g, s)


@query("t39_publish_opens", ("opens", "open_results"), "SELECT o.open_id, open_name, CASE WHEN open_name LIKE '%CAMPIONAT%' THEN 'championship' ELSE 'open' END AS kind, player_id, pos FROM opens o JOIN open_results r ON r.open_id = o.open_id")
def t39(opens, results):
    return TT.publish_opens(opens, results)


@query("i24_normalise_clubs", ("raw_texts",), """
SELECT id, CASE team WHEN 'C.B. MATARÓ "A"' THEN 'C.B. MATARÓ' WHEN 'SANTA ADRIÀ "D"' THEN 'SANTA ADRIÀ' WHEN 'B.C. GRANOLLERS "A"' THEN 'B.C. GRANOLLERS' WHEN 'Cap' THEN NULL ELSE team END AS club FROM raw_texts""")
def i24(raw):
    return raw.select("id", T.extract_club(c("team")).alias("club"))


@query("x04_incremental_refresh", ("league_slots", "rankings"), """
SELECT season, team1, team2 FROM (SELECT season, team1, team2, bool_and(is_played) AS done FROM league_slots GROUP BY 1, 2, 3) x WHERE NOT done""")
def x04(slots, rankings):
    from ..operators.merge import complete_matchdays

    k = ["season", "team1", "team2"]
    done = complete_matchdays(slots.withColumn("tie_id", c("game_id")), k).where("complete")
    return slots.select(*k).distinct().join(done.select(*k), k, "left_anti")


@raw_query("s01_read_table", "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_totalprice AS DOUBLE) AS o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders")
def s01(spark, sf_dir):
    from pyspark.sql import types as Y

    return S.read_table(spark, f"{sf_dir}/orders.parquet", Y.StructType([Y.StructField("o_orderkey", Y.LongType()), Y.StructField("o_totalprice", Y.DoubleType()), Y.StructField("o_orderdate", Y.DateType())]))


@raw_query("s05_write_mart", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def s05(spark, sf_dir):
    """An upsert into a mart in the shared folder, read back."""
    path = shared_dir(spark)
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus")
    S.write_mart(o, path, "upsert", keys=["o_orderkey"])
    S.write_mart(o.where("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("Z")), path, "upsert", keys=["o_orderkey"])
    return S.read_mart(spark, path)


@query("s06_display_names", ("players",), "SELECT player_id, CASE WHEN player_id % 10 = 0 THEN concat('Display ', player_id) ELSE concat(name, ' ', player_id) END AS name FROM players")
def s06(players):
    p = players.select("player_id", F.concat("name", F.lit(" "), c("player_id").cast("string")).alias("name"))
    m = p.where("player_id % 10 = 0").select(c("name").alias("left"), F.concat(F.lit("Display "), c("player_id").cast("string")).alias("right"))
    return S.display_name(p, m).select("player_id", "name")
