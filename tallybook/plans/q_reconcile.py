"""Queries over reconciliation, sources and the batch twins of the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import norm_name, title_name
from ..operators import games as G, merge as M, rankings as R, reconcile as Q, tournaments as T
from ..sources import pages as SP, tables as S
from ..sources.shared import durable, shared_dir
from ..streaming import keyed as K, live as L
from .registry import query, raw_query

c = F.col


@query("q01_unique_names", ("players",), "SELECT concat(lower(strip_accents(name)), '|', club_id) AS key, min(player_id) AS player_id FROM players GROUP BY 1 HAVING count(DISTINCT player_id) = 1")
def q01(players):
    return M.unique_names(players, F.concat_ws("|", norm_name(c("name")), c("club_id").cast("string")))


@query("q02_fuzzy_pairs", ("players",))
def q02(players):
    """All players under the names of one source against those of the other."""
    o = players.select(c("player_id").alias("pos"), F.regexp_replace("name", "SOLÉ", "SOLER").alias("name"))
    return Q.fuzzy_pairs(o, players.select(c("player_id").alias("cid"), "name"))


@query("n05_name_scores", ("players",))
def n05(players):
    """Every player against every member of the same club under the names of another source."""
    b = players.select("club_id", c("player_id").alias("b"), F.regexp_replace("name", "Í|À", "").alias("nb"))
    x = players.select("club_id", c("player_id").alias("a"), c("name").alias("na")).join(b, "club_id")
    return Q.name_score(x, "na", "nb").select("a", "b", F.round("score", 6).alias("score"))


def _two(results):
    p = T.with_points(results).groupBy("player_id").agg(F.sum("points").alias("total"), F.array_sort(F.collect_list(F.struct("open_id", "points"))).alias("z")).select("player_id", "total", F.transform("z", lambda s: s["points"].cast("long")).alias("cells"))
    k = lambda df: G.ranked(df, [F.desc("total"), "player_id"], "pos").withColumn("pos", c("pos").cast("int"))
    i = c("player_id")
    off = p.where(i % 11 != 0).withColumn("total", F.when(i % 7 == 0, c("total") - 20).when(i % 5 == 0, c("total") - 3).otherwise(c("total")))
    off = off.withColumn("cells", F.when(i % 7 == 0, F.concat(F.col("cells"), F.array(F.lit(-20).cast("long")))).when(i % 10 == 0, F.concat(F.array(F.lit(0).cast("long")), F.col("cells"))).otherwise(c("cells")))
    return k(off), k(p.where(i % 13 != 0))


_TWO = """
, p0 AS (SELECT player_id, CAST(sum(pts) AS BIGINT) AS total, list(pts ORDER BY open_id) AS cells FROM (SELECT player_id, open_id, CAST({0} AS BIGINT) AS pts FROM open_results) a GROUP BY 1),
off AS (SELECT *, row_number() OVER (ORDER BY total DESC, player_id) AS pos FROM (SELECT player_id, CASE WHEN player_id % 7 = 0 THEN total - 20 WHEN player_id % 5 = 0 THEN total - 3 ELSE total END AS total, CASE WHEN player_id % 7 = 0 THEN list_append(cells, -20) WHEN player_id % 10 = 0 THEN list_prepend(0, cells) ELSE cells END AS cells FROM p0 WHERE player_id % 11 <> 0) b),
comp AS (SELECT *, row_number() OVER (ORDER BY total DESC, player_id) AS pos FROM p0 WHERE player_id % 13 <> 0),
df AS (SELECT coalesce(o.player_id, k.player_id) AS player_id, o.pos AS opos, k.pos AS cpos, o.total AS ototal, k.total AS ctotal, o.cells AS oc, k.cells AS cc,
 CASE WHEN o.total IS NULL THEN 'missing_in_official' WHEN k.total IS NULL THEN 'missing_in_computed' WHEN o.total = k.total AND o.pos <> k.pos THEN 'position_only' WHEN o.total <> k.total AND o.player_id % 7 = 0 THEN 'penalty_expected' WHEN o.total <> k.total THEN 'total_points' WHEN o.cells <> k.cells THEN 'per_open' END AS kind
 FROM off o FULL JOIN comp k ON k.player_id = o.player_id),
d0 AS (SELECT * FROM df WHERE kind IS NOT NULL)
""".format("CASE WHEN pos = 1 THEN 180 WHEN pos = 2 THEN 165 WHEN pos <= 4 THEN 155 WHEN pos <= 8 THEN 156 - 2 * pos WHEN pos <= 16 THEN 141 - pos WHEN pos <= 32 THEN 135 - pos WHEN pos <= 48 THEN 128 - pos WHEN pos <= 64 THEN 121 - pos WHEN pos <= 80 THEN 114 - pos WHEN pos <= 96 THEN 25 WHEN pos <= 112 THEN 18 WHEN pos <= 128 THEN 15 ELSE 12 END")


@query("q03_diff_rankings", ("open_results",), _TWO + "SELECT player_id, opos, cpos, ototal, ctotal, kind FROM d0")
def q03(results):
    return Q.diff_rankings(*_two(results)).select("player_id", "opos", "cpos", "ototal", "ctotal", "kind")


_RE = """
, u AS (SELECT *, CASE WHEN kind IN ('total_points', 'per_open') AND list_filter(range(1, len(oc) + 1), lambda i: oc[i] > 0) <> list_filter(range(1, len(cc) + 1), lambda i: cc[i] > 0) THEN 'source_mismatch' ELSE kind END AS k1 FROM d0),
v AS (SELECT *, CASE WHEN k1 = 'total_points' AND ototal - ctotal BETWEEN -28 AND 0 THEN 'penalty_cascade' ELSE k1 END AS k2 FROM u),
mv AS (SELECT cpos AS c, opos AS o FROM v WHERE k2 NOT IN ('position_only', 'per_open') AND cpos IS NOT NULL),
w AS (SELECT *, (SELECT count(*) FROM mv WHERE c < cpos AND (o IS NULL OR o > opos)) - (SELECT count(*) FROM mv WHERE c > cpos AND o < opos) AS net FROM v),
re AS (SELECT player_id, CASE WHEN k2 = 'position_only' AND net = cpos - opos THEN 'position_cascade' ELSE k2 END AS kind FROM w)
"""


@query("q04_diff_reclassified", ("open_results",), _TWO + _RE + "SELECT * FROM re")
def q04(results):
    return Q.reclassify(Q.diff_rankings(*_two(results)), 14).select("player_id", "kind")


@query("q05_diff_report", ("open_results",), _TWO + _RE + """
SELECT kind, count(*) AS n, list_position(['missing_in_official', 'missing_in_computed', 'total_points', 'per_open', 'position_only', 'penalty_expected', 'source_mismatch', 'penalty_cascade', 'position_cascade'], kind) AS rank FROM re GROUP BY 1""")
def q05(results):
    return Q.report(Q.reclassify(Q.diff_rankings(*_two(results)), 14))


@query("q06_decisions", ("open_results",), _TWO + """
, dec AS (SELECT player_id, kind, CASE WHEN player_id % 2 = 0 THEN 'keep_computed' ELSE 'use_official' END AS d FROM d0 WHERE player_id % 3 = 0)
SELECT d0.player_id, d0.kind, dec.d AS decision FROM d0 LEFT JOIN dec ON dec.player_id = d0.player_id""")
def q06(results):
    d = Q.diff_rankings(*_two(results))
    dec = d.where("player_id % 3 = 0").select("player_id", F.when(c("player_id") % 6 < 3, c("kind")).otherwise("other").alias("kind"), F.when(c("player_id") % 2 == 0, "keep_computed").otherwise("use_official").alias("decision"), F.lit(1).alias("updated_at"))
    return Q.attach_decisions(d, dec)


#: Sheets of five official columns and five opens of the window each, named by the orders.
def _sheets(raw):
    o = raw.select(F.floor(c("id") / 5).alias("sheet"), c("id").alias("col"), c("tournament").alias("name"))
    w = raw.select(F.floor(c("id") / 5).alias("sheet"), c("id").alias("open_id"), F.when(c("id") % 3 == 0, F.concat(c("tournament"), F.lit(" (MANRESA)"))).otherwise(c("tournament")).alias("name"))
    return o, w


_SHEETS = """
, n AS (SELECT CAST(floor(id / 5) AS BIGINT) AS sheet, id, upper(strip_accents(tournament)) AS u, CASE WHEN id % 3 = 0 THEN concat(upper(strip_accents(tournament)), ' (MANRESA)') ELSE upper(strip_accents(tournament)) END AS w FROM raw_texts),
v AS (SELECT sheet, id, list_concat(list_filter(vs, lambda x: contains(u, x)), CASE WHEN contains(u, 'JOAQUI') THEN ['SANTS'] ELSE [] END) AS vu, list_concat(list_filter(vs, lambda x: contains(w, x)), CASE WHEN contains(w, 'JOAQUI') THEN ['SANTS'] ELSE [] END) AS vw
 FROM (SELECT *, ['MATARO', 'LLINARS', 'MANRESA', 'SANT ADRIA', 'COSTA DAURADA', 'MOLINS', 'VIC', 'TORREDEMBARRA', 'SANTS'] AS vs FROM n) z),
pr AS (SELECT a.sheet, list([{'col': a.id, 'open_id': b.id}] ORDER BY a.id, b.id) AS p FROM v a JOIN v b ON b.sheet = a.sheet AND list_has_any(a.vu, b.vw) GROUP BY 1),
mp AS (SELECT sheet, unnest(list_reduce(p, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.col = x[1].col OR y.open_id = x[1].open_id)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS m FROM pr)
"""


@query("t09_map_columns", ("raw_texts",), _SHEETS + "SELECT sheet, m.col AS col, m.open_id AS open_id FROM mp")
def t09(raw):
    return T.map_columns(*_sheets(raw), ["sheet"])


@query("q07_same_opens", ("raw_texts",), _SHEETS + "SELECT s.sheet, coalesce(k, 0) = n AS same FROM (SELECT sheet, count(*) AS n FROM n GROUP BY 1) s LEFT JOIN (SELECT sheet, count(*) AS k FROM mp GROUP BY 1) q ON q.sheet = s.sheet")
def q07(raw):
    o, w = _sheets(raw)
    return Q.same_opens(T.map_columns(o, w, ["sheet"]), o, w, ["sheet"])


#: Games of one task that pairs logs, so that what it sorts stays in memory for any input.
GAMES_A_TASK = 200_000


def _log_rows(sides, players, by=(), tasks=None):
    """All games of all players, and their own logs (``own``): a quarter is missing, days and runs are mistyped, some scores too. Where games are to lie ``by`` what no log has otherwise, they are shuffled once for both."""
    names = players.select(c("player_id").alias("opp_id"), c("name").alias("opp"), title_name(c("name")).alias("typed"))  # a name is written anew once a player, not once a game
    f = sides.join(names, "opp_id").select(c("game_id").alias("id"), "player_id", "discipline", "car", "opp_car", "ent", "opp", c("played_on").alias("day"), "run", "typed")
    i = c("id") + 1
    typed = {"id": i, "day": F.date_add("day", F.when(i % 7 == 0, 0).otherwise(i % 20).cast("int")), "run": F.when(i % 3 != 0, c("run")), "car": F.when(i % 7 == 0, c("car") + 1).otherwise(c("car")), "opp": c("typed")}
    cols = [n for n in f.columns if n not in (*by, "typed")]
    games = F.struct(F.lit(False).alias("own"), *cols)
    own = F.struct(F.lit(True).alias("own"), *(typed.get(n, c(n)).alias(n) for n in cols))
    return (f.repartition(tasks, *by) if by else f).select(*by, F.inline(F.filter(F.array(games, F.when(c("id") % 4 != 0, own)), lambda r: r.isNotNull())))


@query("g30_reconcile_log", ("sides", "players"))
def g30(sides, players):
    tasks = max(sides.sparkSession.sparkContext.defaultParallelism, sides.count() // GAMES_A_TASK)
    return Q.reconcile_rows(_log_rows(sides, players, ["player_id", "discipline"], tasks), tasks=tasks)


@query("g31_counting_games", ("sides", "links", "players"), last=True)
def g31(sides, links, players):
    rows = _log_rows(sides, players)
    f, own = rows.where("not own"), rows.where("own")
    last = R.latest(links).select("player_id", c("game_id").alias("id"))
    return Q.pair_one_to_one(f.join(last, ["player_id", "id"], "left_semi"), own, ["player_id", "discipline", "car", "opp_car", "ent"], 60)


@query("g29_player_sheet", ("sides", "ranking_entries", "rankings", "open_results", "opens"))
def g29(sides, entries, rankings, results, opens):
    marks = R.player_marks(entries, R.season_bounds(rankings).select("discipline", c("first_seq").alias("seq")))
    return Q.player_sheet(G.player_summary(sides), marks.dropDuplicates(["discipline", "player_id"]), G.podiums(results, opens))


for _how, _op in (("union", "UNION"), ("intersect", "INTERSECT"), ("except", "EXCEPT")):
    query(f"m_member_{_how}", ("sides",), f"SELECT player_id FROM sides WHERE competition = 'COPA' {_op} SELECT player_id FROM sides WHERE competition = 'LLIGA' AND discipline = 2")(lambda sides, how=_how: Q.member_sets(sides.where("competition = 'COPA'"), sides.where("competition = 'LLIGA' and discipline = 2"), how))


@query("s02_read_extras", ("ranking_entries",), "SELECT discipline, seq, player_id, car, ent, CASE WHEN player_id % 5 = 0 THEN false ELSE is_definitive END AS definitive FROM ranking_entries")
def s02(entries):
    d = F.when(c("player_id") % 5 != 0, c("is_definitive"))
    return S.read_extras(entries.select("discipline", "seq", "player_id", F.to_json(F.struct(c("car").cast("int").alias("car"), c("ent").cast("int").alias("ent"), d.alias("definitive"))).alias("extras"))).select("discipline", "seq", "player_id", "car", "ent", "definitive")


@raw_query("s03_extract_pages", """
SELECT concat('http://x/standings/', u) AS url, concat('GRUP ', CASE WHEN u % 2 = 0 THEN 'A' ELSE 'B' END) AS section, CAST(o_orderkey % 100000 AS INT) AS pos, concat('Team ', o_custkey) AS team, CAST(length(o_orderpriority) AS INT) AS mp, CAST(o_custkey % 7 AS INT) AS pp, CAST(o_custkey % 9 AS INT) AS played
FROM (SELECT *, CAST(floor(o_orderkey / 40) AS BIGINT) AS u FROM orders) o""")
def s03(spark, sf_dir):
    """Result pages made from the orders, forty to a page, parsed back: a table or boxes under a section row."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("u", F.floor(c("o_orderkey") / 40))
    row = lambda out, cell: F.concat(F.lit(f"<{out}>"), *(F.concat(F.lit(f"<{cell}>"), x.cast("string"), F.lit(f"</{cell}>")) for x in (c("o_orderkey") % 100000, F.concat(F.lit("Team "), c("o_custkey").cast("string")), F.length("o_orderpriority"), c("o_custkey") % 7, c("o_custkey") % 9)), F.lit(f"</{out.split()[0]}>"))
    r = F.when(c("u") % 2 == 0, row("tr", "td")).otherwise(row('div class="row box info"', "div"))
    p = o.groupBy("u").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", r.alias("r")))), lambda s: s["r"]), "").alias("rows"))
    html = F.when(c("u") % 2 == 0, F.concat(F.lit("<table><tr><td>GRUP A</td></tr>"), "rows", F.lit("</table>"))).otherwise(F.concat(F.lit('<section><div class="box"><b>GRUP B</b></div>'), "rows", F.lit("</section>")))
    return SP.extract(p.select(F.concat(F.lit("http://x/standings/"), c("u").cast("string")).alias("url"), html.alias("html")), "standings").drop("row")


@raw_query("s03_key_values", "SELECT concat('http://x/', c_custkey) AS url, key, value FROM (SELECT c_custkey, unnest([{'key': 'Name', 'value': c_name}, {'key': 'Segment', 'value': c_mktsegment}, {'key': 'Nation', 'value': CAST(c_nationkey AS STRING)}], recursive := true) FROM customer) x")
def s03_boxes(spark, sf_dir):
    """A page of key and value boxes for each customer, parsed back."""
    box = lambda k, v: F.concat(F.lit(f'<div class="row box"><div><b>{k}:</b></div><div>'), c(v).cast("string"), F.lit("</div></div>"))
    # the file of customers is small and gives one task or few, but parsing is most of the work: the rows are dealt out
    dealt = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey").repartition(4 * spark.sparkContext.defaultParallelism)
    p = dealt.select(F.concat(F.lit("http://x/"), c("c_custkey").cast("string")).alias("url"), F.concat(box("Name", "c_name"), box("Segment", "c_mktsegment"), box("Nation", "c_nationkey")).alias("html"))
    return SP.key_values(p).select("url", "key", "value")


@raw_query("s03_link_ids", "SELECT page_id, list_transform(list_filter(string_split(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', ''), '/'), lambda x: regexp_full_match(x, '[0-9]{1,18}')), lambda x: CAST(x AS BIGINT))[1] AS id FROM pages")
def s03_ids(spark, sf_dir):
    """The first number in the path of every page's url."""
    return SP.link_ids(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), "url").select("page_id", F.get("ids", F.lit(0)).alias("id"))


@raw_query("s04_extract_links", """
SELECT page_id, url AS page_url, u.pos, u.link FROM (SELECT page_id, url, unnest(list_transform(range(0, len(l)), lambda i: {'pos': i, 'link': l[i + 1]})) AS u FROM (SELECT page_id, url, list_filter(l0, lambda x, i: list_position(l0, x) = i) AS l FROM (SELECT page_id, url, list_filter(regexp_extract_all(html, '(?i)href="([^"]*)"', 1), lambda x: regexp_matches(x, '^/[A-Za-z]')) AS l0 FROM pages) a) b) c""")
def s04(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", c("url").alias("page_url"), F.posexplode(S.links(c("html"), "^/[A-Za-z]")).alias("pos", "link"))


@raw_query("s07_table_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in ("customer", "orders", "lineitem", "events")))
def s07(spark, sf_dir):
    return S.table_counts({t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "orders", "lineitem", "events")})


@query("s08_copy_tree", ("clubs", "players"), "SELECT club_name, player_id FROM players p JOIN clubs c ON c.club_id = p.club_id")
def s08(clubs, players):
    p, ch = S.copy_tree(clubs, players.select("player_id", "club_id"), "club_id", ["club_name"])
    return ch.join(p, "new_id").select("club_name", "player_id")


def _log(spark, sf_dir, stream=False):
    path = f"{sf_dir}/events.parquet"
    # a stream takes a folder or a pattern, and the table may be one file
    e = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[t]") if stream else spark.read.parquet(path)
    body = F.to_json(F.struct(F.concat(F.lit("P"), (c("user_id") % 3).cast("string")).alias("phase"), c("user_id").alias("a"), (c("user_id") + 7).alias("b"), F.floor("value").cast("int").alias("car_a"), (F.floor("value").cast("int") % 13).alias("car_b"), (c("event_id") % 11 == 0).alias("is_played")))
    return e.select((c("user_id") % 20).alias("open_id"), (c("user_id") * 10 + c("event_id") % 4).alias("match_id"), c("ts").alias("captured_at"), body.alias("payload"), "event_id")


_LOG = """WITH lg AS (SELECT user_id % 20 AS open_id, user_id * 10 + event_id % 4 AS match_id, ts AS captured_at, concat('P', user_id % 3) AS phase, user_id AS a, user_id + 7 AS b, CAST(floor(value) AS INT) AS car_a, CAST(floor(value) AS INT) % 13 AS car_b, event_id % 11 = 0 AS is_played FROM events)
"""


@raw_query("x01_snapshot_log", _LOG + "SELECT * FROM lg")
def x01(spark, sf_dir):
    return L.exploded(_log(spark, sf_dir))


@raw_query("x02_latest_state", _LOG + "SELECT * FROM (SELECT * FROM lg QUALIFY row_number() OVER (PARTITION BY open_id, match_id ORDER BY captured_at DESC) = 1) z WHERE NOT is_played")
def x02(spark, sf_dir):
    return L.latest_state(L.exploded(_log(spark, sf_dir))).select("open_id", "match_id", "captured_at", "phase", "a", "b", "car_a", "car_b", "is_played")


@raw_query("x02_stream_state", _LOG + "SELECT * FROM lg QUALIFY row_number() OVER (PARTITION BY open_id, match_id ORDER BY captured_at DESC) = 1")
def x02_stream(spark, sf_dir):
    """The same state kept by key in a stream over the log; the changes it writes add up to it."""
    out = shared_dir(spark)
    matches = L.exploded(_log(spark, sf_dir, stream=True))
    K.keep_latest(matches, f"{out}/changes", f"{out}/checkpoint").awaitTermination()
    changes = spark.read.parquet(f"{out}/changes").select(*matches.columns)
    return K.latest_of(changes).withColumn("captured_at", c("captured_at").cast(matches.schema["captured_at"].dataType))


@raw_query("x03_stream_pending", _LOG + "SELECT match_id, captured_at FROM lg WHERE match_id % 4 <> 1")
def x03_stream(spark, sf_dir):
    """Pending games found by a stream against the table of known ones."""
    out = shared_dir(spark)
    known = L.exploded(_log(spark, sf_dir)).where("match_id % 4 = 1")
    new = L.pending(L.exploded(_log(spark, sf_dir, stream=True)), known).select("match_id", "captured_at")
    new.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(new.schema).parquet(f"{out}/rows")


@raw_query("x03_pending", _LOG + "SELECT match_id, captured_at FROM lg WHERE match_id % 4 <> 1")
def x03(spark, sf_dir):
    x = L.exploded(_log(spark, sf_dir))
    return L.pending(x, x.where("match_id % 4 = 1")).select("match_id", "captured_at")


@raw_query("x05_replay", _LOG + "SELECT open_id, match_id, captured_at, car_a FROM lg WHERE captured_at <= (SELECT TIMESTAMP '2020-01-01' FROM lg LIMIT 1) OR captured_at <= TIMESTAMP '2024-01-15' QUALIFY row_number() OVER (PARTITION BY open_id, match_id ORDER BY captured_at DESC) = 1")
def x05(spark, sf_dir):
    return L.replay(_log(spark, sf_dir), "2024-01-15 00:00:00").select("open_id", "match_id", "captured_at", "car_a")


@raw_query("x06_activity", "SELECT date_trunc('day', ts) AS since, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def x06(spark, sf_dir):
    return L.activity(spark.read.parquet(f"{sf_dir}/events.parquet")).withColumn("total", F.round("total", 4))


@raw_query("x06_sessions", """
SELECT user_id, min(ts) AS since, max(ts) + INTERVAL 6 HOUR AS until, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events) a) b GROUP BY user_id, s""")
def x06s(spark, sf_dir):
    return L.sessions(spark.read.parquet(f"{sf_dir}/events.parquet"))


@raw_query("x07_fresh_scores", _LOG + """
, t AS (SELECT TIMESTAMP '2024-01-20 12:00:00' AS t) SELECT open_id, match_id, captured_at FROM lg, t WHERE captured_at > t - INTERVAL 5000 MINUTE AND captured_at <= t AND NOT is_played AND phase <> 'P2' AND a % 5 <> 0""")
def x07(spark, sf_dir):
    x = L.exploded(_log(spark, sf_dir))
    return L.fresh_scores(x, "2024-01-20 12:00:00", x.where("phase = 'P2'").select("open_id", "phase").distinct(), x.where("a % 5 = 0").select("open_id", "a", "b").distinct(), 5000).select("open_id", "match_id", "captured_at")


@raw_query("x07_stream_fresh", _LOG + """
, t AS (SELECT max(captured_at) AS t FROM lg) SELECT open_id, match_id, captured_at FROM lg, t WHERE captured_at > t - INTERVAL 5000 MINUTE AND NOT is_played AND phase <> 'P2' AND a % 5 <> 0""")
def x07_stream(spark, sf_dir):
    """Scoreboard rows that a stream holds as fresh at its end, less what is closed or played by now."""
    out = shared_dir(spark)
    matches = L.exploded(_log(spark, sf_dir, stream=True))
    K.keep_fresh(matches, f"{out}/changes", f"{out}/checkpoint", "5000 minutes").awaitTermination()
    now = K.fresh_now(spark.read.parquet(f"{out}/changes"))
    x = L.exploded(_log(spark, sf_dir))
    still = L.still_open(now, x.where("phase = 'P2'").select("open_id", "phase").distinct(), x.where("a % 5 = 0").select("open_id", "a", "b").distinct())
    return still.select("open_id", "match_id", c("captured_at").cast(matches.schema["captured_at"].dataType).alias("captured_at"))


@raw_query("x01_stream_snapshots", """
SELECT user_id % 20 AS open_id, date_trunc('hour', ts) AS captured_at, concat('P', event_id % 3) AS phase, event_id AS match_id, user_id AS a, user_id + 7 AS b, CAST(floor(value) AS INT) AS car_a, CAST(floor(value) AS INT) % 13 AS car_b, event_id % 11 = 0 AS is_played FROM events""")
def x01_stream(spark, sf_dir):
    """Nested snapshots made from the events, a user's hour each, as JSON files: all of them, a seventh again, and broken lines."""
    out = shared_dir(spark)
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    m = F.struct(c("event_id").alias("match_id"), c("user_id").alias("a"), (c("user_id") + 7).alias("b"), F.floor("value").cast("int").alias("car_a"), (F.floor("value").cast("int") % 13).alias("car_b"), (c("event_id") % 11 == 0).alias("is_played"))
    e = e.select("user_id", F.date_trunc("hour", "ts").alias("captured_at"), F.concat(F.lit("P"), (c("event_id") % 3).cast("string")).alias("phase"), m.alias("m"))
    p = e.groupBy("user_id", "captured_at", "phase").agg(F.array_sort(F.collect_list("m")).alias("matches"))
    p = p.groupBy("user_id", "captured_at").agg(F.array_sort(F.collect_list(F.struct("phase", "matches"))).alias("phases"))
    j = F.to_json(F.struct((c("user_id") % 20).alias("open_id"), "captured_at", "phases"))
    lines = p.select("user_id", j.alias("value"))
    for i, part in enumerate((lines, lines.where("user_id % 7 = 0"), lines.where("user_id % 11 = 0").withColumn("value", F.substring("value", 1, 40)))):
        part.select("value").write.text(f"{out}/in/{i}")
    log = L.log_snapshots(spark, f"{out}/in/*", out, late="3650 days")
    return log.withColumn("captured_at", c("captured_at").cast(e.schema["captured_at"].dataType))


@query("x04_stream_refresh", ("league_slots",), """
, d AS (SELECT season, team1, team2, count(*) AS n, bool_and(is_played) AS done FROM league_slots GROUP BY 1, 2, 3),
s AS (SELECT season, count(*) AS days, sum(CASE WHEN done THEN 1 ELSE 0 END) AS days_done FROM d GROUP BY 1)
SELECT d.season, team1, team2, n, done, days, CAST(days_done AS BIGINT) AS days_done FROM d JOIN s ON s.season = d.season""")
def x04_stream(slots):
    """Match-days and seasons kept by a stream of slots, of which many come first as not played and then as they are."""
    spark = slots.sparkSession
    out = shared_dir(spark)
    x = durable(slots.select("game_id", "season", "team1", "team2", "is_played", F.lit(2).alias("version")))  # three uses, one making
    early = x.where("game_id % 5 < 2").withColumns({"is_played": F.lit(False), "version": F.lit(1)})
    early.unionByName(x.where("game_id % 5 >= 2")).write.parquet(f"{out}/in/0")
    x.where("game_id % 5 < 2").write.parquet(f"{out}/in/1")
    k = ["season", "team1", "team2"]
    day = lambda rows: rows.groupBy(*k).agg(F.count("*").alias("n"), F.every("is_played").alias("done"))
    season = lambda rows: rows.groupBy("season").agg(F.count("*").alias("days"), F.sum(c("done").cast("long")).alias("days_done"))
    steps = [L.Step(f"{out}/days", k, ["season"], day), L.Step(f"{out}/seasons", ["season"], ["season"], season)]
    for part in ("[0]", "[01]"):  # the second run finds the first part done
        stream = spark.readStream.schema(x.schema).parquet(f"{out}/in/{part}")
        L.refresh(stream, L.Step(f"{out}/slots", ["game_id"], k), steps, "version", f"{out}/checkpoint")
    return S.read_mart(spark, f"{out}/days").join(S.read_mart(spark, f"{out}/seasons"), "season")
