"""Queries over the function library: each applies a family of functions to a whole table of names or dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import seasons as S, text as T
from .registry import query

_ACC = "strip_accents({})"
_UP = "upper(strip_accents({}))"


@query("n01_names", ("players", "clubs"), """
SELECT player_id, lower(regexp_replace(trim(strip_accents(name)), '\\s+', ' ', 'g')) AS norm, upper(regexp_replace(trim(strip_accents(name)), '\\s+', ' ', 'g')) AS norm_upper,
       regexp_replace(name, ',\\s*', ', ', 'g') AS spaced, len(list_distinct(list_filter(string_split_regex(lower(strip_accents(name)), '[^a-z0-9]+'), lambda x: len(x) > 1))) AS n_tokens,
       concat_ws('|', regexp_replace(upper(strip_accents(club_name)), '[^A-Z0-9]', '', 'g'), regexp_replace(string_split(upper(strip_accents(name)), ' ')[1], '[^A-Z]', '', 'g'), substr(trim(string_split(upper(strip_accents(name)), ',')[2]), 1, 1)) AS skey,
       regexp_replace(lower(strip_accents(club_name)), '[\\s."'']+', '', 'g') AS club_norm, contains(lower(strip_accents(name)), 'marti') AS has_marti
FROM players p JOIN clubs c ON c.club_id = p.club_id""")
def names(players, clubs):
    x = players.join(clubs, "club_id")
    n, c = F.col("name"), F.col("club_name")
    return x.select("player_id", T.norm_name(n).alias("norm"), T.norm_name_upper(n).alias("norm_upper"), T.comma_space(n).alias("spaced"), F.size(T.name_tokens(n)).alias("n_tokens"), T.surname_key(n, c).alias("skey"), T.club_norm(c).alias("club_norm"), T.contains_plain(n, "Martí").alias("has_marti"))


@query("n03_person_keys", ("raw_texts",), """
SELECT id, regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(upper(strip_accents(person)), '[^A-Z0-9]+', ' ', 'g')), '^((SR|SRA|SENYOR|SENYORA|MR|MRS|DR|DRA|DON|DONA)( |$))+', ''), '\\bHDEZ\\b', 'HERNANDEZ', 'g'), '\\bARMANDO\\b', 'ARMAND', 'g') AS mkey,
       CASE person WHEN 'SR. HDEZ PUIG, ARMANDO' THEN 'Armando Sr. Hdez Puig' WHEN 'Puig Vilà,  Núria' THEN 'Núria Puig Vilà' WHEN 'DE LA FUENTE ROIG,JOAN' THEN 'Joan de la Fuente Roig' WHEN 'garcía  muñoz, òscar' THEN 'Òscar García Muñoz'
            WHEN 'DRA. SOLÉ COLOMÉ, ANNA' THEN 'Anna Dra. Solé Colomé' WHEN 'Ferrer' THEN 'Ferrer' WHEN 'VAN DEN BERG, PERE' THEN 'Pere van den Berg' ELSE 'Lluís Núñez i Roig' END AS title,
       len(list_intersect(string_split_regex(lower(strip_accents(person)), '[^a-z0-9]+'), ['puig', 'nuria', 'fuente', 'roig'])) >= 2 AS matches
FROM raw_texts""")
def person_keys(raw):
    p = F.col("person")
    return raw.select("id", T.match_key(p).alias("mkey"), T.title_name(p).alias("title"), T.name_match(p, F.lit("Fuente Roig, Núria Puig")).alias("matches"))


@query("n10_club_keys", ("raw_texts",), """
SELECT id, CASE team WHEN 'C.B. MATARÓ "A"' THEN 'C.B. MATARÓ' WHEN 'SANTA ADRIÀ "D"' THEN 'SANTA ADRIÀ' WHEN 'B.C. GRANOLLERS "A"' THEN 'B.C. GRANOLLERS' WHEN 'Cap' THEN NULL ELSE team END AS extracted,
       CASE team WHEN 'C.B. MATARÓ "A"' THEN 'MATARO' WHEN 'C.B. MATARÓ “B”' THEN 'MATARO“B”' WHEN '01 C.B. BARCELONA A' THEN '01CBBARCELONAA' WHEN 'SANT ADRIÀ A' THEN 'SANTADRIAA' WHEN 'C.B.SANTS' THEN 'SANTS' WHEN 'SANTA ADRIÀ "D"' THEN 'SANTADRIA' WHEN 'S.B.F. MOLINS' THEN 'SBFMOLINS' WHEN 'B.C. GRANOLLERS "A"' THEN 'GRANOLLERS' WHEN 'Club Billar Banyoles (AMISTAT)' THEN 'CLUBBILLARBANYOLES(AMISTAT)' END AS canonical,
       CASE WHEN team IN ('C.B. MATARÓ "A"', 'B.C. GRANOLLERS "A"', '01 C.B. BARCELONA A', 'SANT ADRIÀ A') THEN 'A' WHEN team LIKE '%“B”' THEN 'B' WHEN team LIKE '%"D"' THEN 'D' ELSE 'UNICO' END AS letter,
       CASE team WHEN 'C.B. MATARÓ "A"' THEN 'C.B. MATARÓ' WHEN 'C.B. MATARÓ “B”' THEN 'C.B. MATARÓ' WHEN '01 C.B. BARCELONA A' THEN 'C.B. BARCELONA' WHEN 'SANT ADRIÀ A' THEN 'SANT ADRIÀ' WHEN 'SANTA ADRIÀ "D"' THEN 'SANTA ADRIÀ' WHEN 'B.C. GRANOLLERS "A"' THEN 'B.C. GRANOLLERS' ELSE team END AS team_club,
       CASE team WHEN 'C.B. MATARÓ "A"' THEN 'mataro a' WHEN 'C.B. MATARÓ “B”' THEN 'mataro' WHEN '01 C.B. BARCELONA A' THEN '01 barcelona a' WHEN 'SANT ADRIÀ A' THEN 'sant adria a' WHEN 'C.B.SANTS' THEN 'sants' WHEN 'Cap' THEN 'cap' WHEN 'SANTA ADRIÀ "D"' THEN 'santa adria' WHEN 'S.B.F. MOLINS' THEN 's f molins' WHEN 'B.C. GRANOLLERS "A"' THEN 'granollers a' ELSE 'banyoles amistat' END AS search,
       CASE team WHEN 'C.B. MATARÓ "A"' THEN 'C.B.MATARÓ' WHEN 'C.B. MATARÓ “B”' THEN 'C.B.MATARÓ' WHEN '01 C.B. BARCELONA A' THEN 'C.B.BARCELONA' WHEN 'SANT ADRIÀ A' THEN 'SANT ADRIÀ' WHEN 'SANTA ADRIÀ "D"' THEN 'SANTA ADRIÀ' WHEN 'S.B.F. MOLINS' THEN 'S.B.F.MOLINS' WHEN 'B.C. GRANOLLERS "A"' THEN 'B.C.GRANOLLERS' WHEN 'Club Billar Banyoles (AMISTAT)' THEN 'Club Billar Banyoles' ELSE team END AS cleaned,
       CASE team WHEN 'C.B. MATARÓ "A"' THEN 'MATAR' WHEN 'C.B. MATARÓ “B”' THEN 'MATAR' WHEN '01 C.B. BARCELONA A' THEN 'BARCELONA' WHEN 'SANT ADRIÀ A' THEN 'SANTADRI' WHEN 'C.B.SANTS' THEN 'SANTS' WHEN 'Cap' THEN 'CAP' WHEN 'SANTA ADRIÀ "D"' THEN 'SANTAADRI' WHEN 'S.B.F. MOLINS' THEN 'MOLINS' WHEN 'B.C. GRANOLLERS "A"' THEN 'GRANOLLERS' ELSE 'CLUBBILLARBANYOLES' END AS core
FROM raw_texts""")
def club_keys(raw):
    t = F.col("team")
    s = T.split_team(t)
    return raw.select("id", T.extract_club(t).alias("extracted"), T.canonical_club_key(t).alias("canonical"), s["letter"].alias("letter"), s["club"].alias("team_club"), T.club_search_key(t).alias("search"), T.clean_club(t).alias("cleaned"), T.club_core(t).alias("core"))


@query("n15_divisions", ("raw_texts",), """
SELECT id, CASE division WHEN '4ª DIVISIÓ' THEN '4a' WHEN '1 DIVISIÓ' THEN '1a' WHEN 'HONOR' THEN 'Honor' WHEN 'L''AMISTAT' THEN 'L''Amistat' WHEN 'PROMOCIÓ A 2a' THEN 'Promoció a 2a' WHEN 'promoció' THEN 'Promoció' WHEN 'ÚNICA' THEN 'Única' ELSE 'Tercera fase' END AS division,
       CASE grp WHEN 'FINAL FOUR A' THEN 'Final Four A' WHEN 'FINAL FOUR' THEN 'Final Four' WHEN 'FINAL 4a DIVISIÓ' THEN 'Final' WHEN 'SEMIFINAL B' THEN 'Semifinals B' WHEN 'PROMOCIÓ 3' THEN 'Promoció 3' WHEN 'PROMOCIÓ HONOR' THEN 'Promoció Honor' WHEN 'GRUP ÚNIC' THEN 'Únic' WHEN 'GRUP C' THEN 'C' WHEN 'd' THEN 'D' ELSE 'Fase prèvia' END AS grp,
       CASE phase WHEN 'PRE-PRE-PRÈVIA' THEN 'PPP' WHEN 'Pre-prèvies' THEN 'PP' WHEN 'Prèvia' THEN 'P' WHEN 'Grup A' THEN 'GRUPA' ELSE 'FINAL' END AS phase FROM raw_texts""")
def divisions(raw):
    return raw.select("id", T.norm_division(F.col("division")).alias("division"), T.norm_group(F.col("grp")).alias("grp"), T.phase_code(F.col("phase")).alias("phase"))


@query("n16_tournament_names", ("raw_texts",), """
SELECT id, CASE WHEN tournament LIKE 'TRES%1A DIV%' THEN 'TRES BANDES - 1a' WHEN tournament LIKE 'LLIURE%' THEN 'LLIURE - 2a A' WHEN tournament LIKE 'QUADRE 47%' THEN 'QUADRE 47/2 - 3a' ELSE tournament END AS short,
       CASE WHEN tournament LIKE 'CAMPIONAT%' THEN 'Tres Bandes - HONOR' WHEN tournament LIKE 'TRES%' THEN 'Tres Bandes - 1A DIVISIÓ' WHEN tournament LIKE 'LLIURE%' THEN 'Lliure - 2A DIVISIÓ "A"' WHEN tournament LIKE 'QUADRE 47%' THEN 'Quadre 47/2 - 3A DIVISIÒ' WHEN tournament LIKE 'QUADRE  71%' THEN 'Quadre 71/2 - ÚNICA' WHEN tournament LIKE 'BANDA%' THEN 'Banda - HONOR' WHEN tournament LIKE 'OPEN TRES%' THEN 'OPEN Tres Bandes SANT ADRIÀ 2023' WHEN tournament LIKE 'COPA%' THEN 'COPA Tres Bandes' ELSE tournament END AS unified,
       CASE WHEN tournament LIKE 'VI OPEN%' THEN 'VI OPEN MATARÓ "LES SANTES"' WHEN tournament LIKE 'I OPEN%' THEN 'I OPEN CIUTAT DE VIC' WHEN tournament LIKE 'MEMORIAL%' THEN 'MEMORIAL PERE ROIG' WHEN tournament LIKE 'QUADRE  71%' THEN 'QUADRE  71/2' ELSE tournament END AS cleaned,
       CASE WHEN tournament LIKE 'CAMPIONAT%' THEN 'championship' WHEN regexp_matches(tournament, 'OPEN|MEMORIAL|TROFEU|CIUTAT') THEN 'open' ELSE 'championship' END AS kind,
       CASE WHEN tournament LIKE '%TRES BANDES%' OR tournament LIKE '%3 BANDES%' THEN 'Tres Bandes' WHEN tournament LIKE '%QUADRE 47/2%' THEN 'Quadre 47/2' WHEN tournament LIKE '%BANDA%' THEN 'Banda' WHEN tournament LIKE '%LLIURE%' THEN 'Lliure' ELSE '' END AS discipline,
       CASE WHEN tournament LIKE '%OPEN%' THEN 'Open' ELSE 'Campionat de Catalunya' END AS bucket,
       CASE WHEN tournament LIKE '%OPEN%' THEN 'Open' WHEN tournament LIKE '%COPA%' THEN 'Copa' WHEN tournament LIKE '%CAMPIONAT%' THEN 'Campionat de Catalunya' ELSE 'Individual' END AS from_text,
       CASE WHEN tournament LIKE '%OPEN%' OR tournament LIKE 'MEMORIAL%' OR tournament LIKE 'TROFEU%' THEN tournament WHEN tournament LIKE 'COPA%' THEN 'COPA TRES BANDES' ELSE 'Camp. Catalunya Tres Bandes' END AS label,
       CASE WHEN tournament LIKE 'VI OPEN%' THEN 'Vi  Mataró "les Santes" -  Mataró' WHEN tournament LIKE 'I OPEN%' THEN 'I  Ciutat De Vic -  Vic' WHEN tournament LIKE 'OPEN TRES%' THEN 'Sant Adrià' END AS location,
       CASE WHEN tournament LIKE 'VI OPEN%' THEN 'VI MATARO' WHEN tournament LIKE 'I OPEN%' THEN 'I CIUTAT DE VIC VIC' WHEN tournament LIKE 'OPEN TRES%' THEN 'SANT ADRIA 2023' WHEN tournament LIKE 'COPA%' THEN 'COPA' END AS okey,
       CASE WHEN tournament LIKE '%MATARÓ%' THEN 'MATARO' WHEN tournament LIKE '%VIC%' THEN 'VIC' WHEN tournament LIKE '%ADRIÀ%' THEN 'SANT ADRIA' WHEN tournament LIKE '%JOAQUIM%' THEN 'SANTS' ELSE '' END AS venues
FROM raw_texts""")
def tournament_names(raw):
    t = F.col("tournament")
    two = F.lit(2)
    keyed = t.rlike("^(VI OPEN|I OPEN|OPEN TRES|COPA)")
    return raw.select("id", T.short_division(t).alias("short"), T.unify_discipline(t).alias("unified"), T.clean_tournament(t).alias("cleaned"), T.tournament_kind(t).alias("kind"), T.discipline_of(t).alias("discipline"), T.competition_of(two, t).alias("bucket"), T.competition_from_text(t).alias("from_text"), T.competition_label(t, F.lit(1)).alias("label"), T.event_location(two, F.lit(None).cast("string"), t).alias("location"), F.when(keyed, T.open_match_key(t)).alias("okey"), F.array_join(T.venue_keywords(t), ",").alias("venues"))


@query("n25_seasons", ("raw_texts",), """
SELECT id, CASE WHEN month(d) >= 8 THEN concat(year(d), '-', year(d) + 1) ELSE concat(year(d) - 1, '-', year(d)) END AS season,
       make_date(CASE WHEN month(d) >= 9 THEN year(d) ELSE year(d) - 1 END, 9, 1) AS first, make_date(CASE WHEN month(d) >= 9 THEN year(d) + 1 ELSE year(d) END, 8, 31) AS last, make_date(CASE WHEN month(d) >= 8 THEN year(d) ELSE year(d) - 1 END, 8, 1) AS start,
       CASE WHEN month(rm) = 8 THEN rm + INTERVAL 1 MONTH ELSE rm END::DATE AS rmonth, CASE WHEN month(nm) = 8 THEN nm + INTERVAL 1 MONTH ELSE nm END::DATE AS next, year(d) * 11 + CASE WHEN month(d) < 8 THEN month(d) ELSE month(d) - 1 END AS idx,
       CASE WHEN month(d) = 8 THEN make_date(year(d), 7, 1) ELSE date_trunc('month', d)::DATE END AS back, abs(date_diff('day', DATE '1998-01-01', d)) AS dist, CAST(coalesce(NULL, 1000000) AS INT) AS far, 2018 + id % 10 AS edition_season
FROM (SELECT *, CASE WHEN date_diff('day', d, last_day(d)) <= 5 THEN date_trunc('month', d) + INTERVAL 1 MONTH ELSE date_trunc('month', d) END::DATE AS rm, (date_trunc('month', d) + INTERVAL 1 MONTH)::DATE AS nm FROM raw_texts) x""")
def seasons(raw):
    d = F.col("d")
    r, idx = S.season_range(d), S.month_index(F.year(d), F.month(d))
    return raw.select("id", S.season_of(d).alias("season"), r["first"].alias("first"), r["last"].alias("last"), S.season_start(d).alias("start"), S.ranking_month(d).alias("rmonth"), S.next_ranking_month(d).alias("next"), idx.alias("idx"), S.month_of_index(idx).alias("back"), S.date_distance(d, F.lit("1998-01-01").cast("date")).alias("dist"), S.date_distance(d, F.lit(None).cast("date")).alias("far"), (2018 + F.col("id") % 10).alias("edition_season"))


@query("n30_points", ("raw_texts",), """
SELECT id, CASE WHEN position = 1 THEN 180 WHEN position = 2 THEN 165 WHEN position <= 4 THEN 155 WHEN position <= 8 THEN 156 - 2 * position WHEN position <= 16 THEN 141 - position WHEN position <= 32 THEN 135 - position WHEN position <= 48 THEN 128 - position WHEN position <= 64 THEN 121 - position WHEN position <= 80 THEN 114 - position WHEN position <= 96 THEN 25 WHEN position <= 112 THEN 18 WHEN position <= 128 THEN 15 ELSE 12 END AS pts,
       list_extract([150, 120, 90, 90, 70, 68, 66, 64, 44, 42, 40, 38], least(position, 12)) AS women_c, list_extract([100, 80, 60, 60, 40, 38, 36, 34, 20, 18, 16, 14], least(position, 12)) AS women_o FROM raw_texts""")
def points(raw):
    p = F.col("position")
    return raw.select("id", S.points_for_position(p).alias("pts"), S.points_for_position(p, "women_championship").alias("women_c"), S.points_for_position(p, "women_open").alias("women_o"))


@query("n31_game_keys", ("games",), """
SELECT game_id, substr(sha1(concat(played_on, '|', competition, '|', discipline, '|', least(p1, p2), '|', greatest(p1, p2), '|', CASE WHEN p1 > p2 THEN car2 ELSE car1 END, '|', CASE WHEN p1 > p2 THEN car1 ELSE car2 END, '|', ent)), 1, 20) AS gkey,
       concat(least(concat(p1, ':', car1), concat(p2, ':', car2)), '|', greatest(concat(p1, ':', car1), concat(p2, ':', car2)), '|', ent) AS sig FROM games""")
def game_keys(games):
    c = F.col
    return games.select("game_id", S.game_key(c("played_on"), c("competition"), c("discipline"), c("p1"), c("p2"), c("car1"), c("car2"), c("ent")).alias("gkey"), S.game_signature(c("p1"), c("car1"), c("p2"), c("car2"), c("ent")).alias("sig"))


@query("n35_labels", ("ranking_entries",), """
SELECT discipline, seq, player_id, CASE WHEN n <= 1 THEN 1.0 WHEN n <= 2 THEN 2.0 WHEN n <= 2.5 THEN 2.5 WHEN n <= 5 THEN 5.0 ELSE 10.0 END * p AS step FROM (SELECT discipline, seq, player_id, CAST(car AS DOUBLE) / p AS n, p FROM (SELECT *, pow(10.0, floor(log10(CAST(car AS DOUBLE)))) AS p FROM ranking_entries WHERE car > 0) a) b""")
def labels(entries):
    return entries.where("car > 0").select("discipline", "seq", "player_id", T.nice_step(F.col("car").cast("double")).alias("step"))
