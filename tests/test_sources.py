"""Sources, marts and streams."""

import datetime as dt
import tempfile

from pyspark.sql import functions as F

from tallybook.sources import marts, pages, tables
from tallybook.streaming import keyed, live


def test_extract_with_sections(spark):
    html = "<table><tr><td colspan=9>LLIGA</td></tr><tr><td>01/02/2024</td><td>A</td><td>2</td><td>30</td><td>B</td><td>0</td><td>20</td><td>25</td></tr><tr><td>bad</td><td>x</td></tr></table>"
    r = pages.extract(spark.createDataFrame([("u", html), ("v", None)], "url string, html string"), "player_games").collect()
    assert [(x.competition, x.day, x.name1, x.car1, x.ent) for x in r] == [("LLIGA", dt.date(2024, 2, 1), "A", 30, 25)]


def test_extract_boxes_and_tables_apart(spark):
    """A section does not pass from one table or page to the next, also under one url."""
    table = lambda head, team: f"<table>{head}<tr><td>1</td><td>{team}</td><td>2</td><td>3</td><td>4</td></tr></table>"
    boxes = '<section><div class="row box"><b>GRUP C</b></div><div class="row box info"><div>2</div><div>Team <i>C</i><br>x</div><div>5</div><div>6</div><div>7</div></div></section>'
    html = [table("<tr><td>GRUP A</td></tr>", "A") + table("", "B") + boxes, table("", "D")]
    r = pages.extract(spark.createDataFrame([("u", h) for h in html], "url string, html string"), "standings").collect()
    assert sorted((x.team, x.section, x.pos, x.played) for x in r) == [("A", "GRUP A", 1, 4), ("B", None, 1, 4), ("D", None, 1, 4), ("Team C x", "GRUP C", 2, 7)]


def test_key_values_and_ids(spark):
    html = '<dl><dt>Referee:</dt><dd>X</dd><dt>Hall</dt><dd></dd></dl><div class="row box"><div><b>Attendance:</b></div><div>30</div></div><table><tr><th>Date</th><td>1/2</td></tr></table>'
    r = pages.key_values(spark.createDataFrame([("u", html), ("v", None)], "url string, html string")).collect()
    assert sorted((x.key, x.value) for x in r) == [("Attendance", "30"), ("Date", "1/2"), ("Hall", None), ("Referee", "X")]
    u = spark.createDataFrame([(1, "http://h/ca/lligues/classificacio/3/14/7?x=9"), (2, "/ca/lligues/classificacio/a4/5"), (3, "/other/3"), (4, None)], "i int, u string")
    assert {x.i: x.ids for x in pages.link_ids(u, "u", "/lligues/classificacio").collect()} == {1: [3, 14, 7], 2: [5], 3: None, 4: None}


def test_mapping_and_extras(spark):
    d = tempfile.mkdtemp(prefix="spark-")
    with open(f"{d}/m.txt", "w") as f:
        f.write("# c\n\nA = B\n C=D E\n")
    m = tables.read_mapping(spark, f"{d}/m.txt")
    assert sorted(map(tuple, m.collect())) == [("A", "B"), ("C", "D E")]
    x = spark.createDataFrame([(1, '{"car": 5}'), (2, None), (3, "{bad")], "i int, extras string")
    assert {r.i: (r.car, r.definitive) for r in tables.read_extras(x).collect()} == {1: (5, False), 2: (None, False), 3: (None, False)}


def test_marts(spark):
    d = tempfile.mkdtemp(prefix="spark-") + "/m"
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    tables.write_mart(a, d, "upsert", keys=["k"])
    tables.write_mart(spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string"), d, "upsert", keys=["k"])
    assert sorted(map(tuple, tables.read_mart(spark, d).collect())) == [(1, "x"), (2, "z"), (3, "w")]
    tables.write_mart(a, f"{d}p", "partitions", partition="v")
    tables.write_mart(spark.createDataFrame([(9, "y")], "k int, v string"), f"{d}p", "partitions", partition="v")
    assert sorted((r.k, r.v) for r in spark.read.parquet(f"{d}p").collect()) == [(1, "x"), (9, "y")]


def test_upsert_rewrites_touched_buckets(spark):
    """An upsert of a few rows writes their buckets; a reader sees all of it or nothing; the same upsert again changes nothing."""
    d = tempfile.mkdtemp(prefix="spark-") + "/m"
    base = spark.range(5000).select(F.col("id").alias("k"), F.lit("a").alias("v"))
    assert len(marts.upsert(base, d, ["k"])) == marts.BUCKETS
    few = spark.range(5).select((F.col("id") * 1000).alias("k"), F.lit("b").alias("v"))
    before = marts.layout(spark, d)
    reader = marts.read_mart(spark, d)
    assert len(marts.upsert(few, d, ["k"])) <= 5
    after = marts.layout(spark, d)
    assert 0 < sum(after[b] != before[b] for b in after) <= 5
    assert reader.where("v = 'b'").count() == 0 and reader.count() == 5000  # began before, reads the old version
    assert marts.read_mart(spark, d).where("v = 'b'").count() == 5 and marts.read_mart(spark, d).count() == 5000
    marts.upsert(few, d, ["k"], number=2)
    assert marts.layout(spark, d) == after and marts.read_mart(spark, d).where("v = 'b'").count() == 5
    # an upsert without its marker is not seen
    half = marts.read_mart(spark, d).limit(9).select("k", F.lit("c").alias("v"), F.lit(0).alias("_bucket"), F.lit(9).alias("_v"))
    half.write.mode("append").partitionBy("_bucket", "_v").parquet(d)
    assert marts.read_mart(spark, d).where("v = 'c'").count() == 0
    assert marts.read_mart(spark, d, of=few.select("k")).where("v = 'b'").count() == 5
    marts.upsert(spark.createDataFrame([(0, "old", 1), (1, "x", 7)], "k long, v string, t int"), f"{d}n", ["k"], newest="t")
    marts.upsert(spark.createDataFrame([(0, "new", 2), (1, "late", 3), (2, None, 1)], "k long, v string, t int"), f"{d}n", ["k"], newest="t")
    assert sorted((r.k, r.v) for r in marts.read_mart(spark, f"{d}n").collect()) == [(0, "new"), (1, "x"), (2, None)]
    marts.upsert(base.limit(0), f"{d}e", ["k"])
    assert marts.read_mart(spark, f"{d}e").columns == ["k", "v"] and marts.read_mart(spark, f"{d}e").count() == 0


def _matches(rows):
    return [(1, m, t, f'{{"phase": "P", "a": 1, "b": 2, "car_a": {n}, "car_b": 0, "is_played": {str(done).lower()}}}') for m, t, n, done in rows]


LOG = "open_id int, match_id int, captured_at timestamp, payload string"


def test_stream_keeps_latest_state(spark):
    """Late rows, restarts, finished matches and batches that touch few of many matches."""
    d = tempfile.mkdtemp(prefix="spark-")
    t = dt.datetime(2024, 1, 1)
    at = lambda m: t + dt.timedelta(minutes=m)
    batches = [
        [(1, at(0), 1, False), (1, at(5), 7, False), (2, at(0), 3, False)] + [(m, at(0), m, False) for m in range(100, 300)],
        [],
        [(2, at(9), 8, False), (3, at(2), 4, False)],
        [(1, at(1), 9, False), (3, at(6), 5, True), (4, at(1), 1, True)],  # older than the state; finished
        [(3, at(3), 2, False), (5, at(200), 0, False)],  # after the end, but captured before
        [(6, at(201), 0, False)],
    ]
    def run(check, out):
        keyed.keep_latest(live.snapshot_stream(spark, f"{d}/in", log.schema), f"{d}/{out}", f"{d}/{check}", late="1 hour").awaitTermination()

    sizes = []
    for rows in batches:
        log = spark.createDataFrame(_matches(rows), LOG)
        if rows:
            log.coalesce(1).write.mode("append").parquet(f"{d}/in")
        run("check", "out")
        sizes.append(spark.read.parquet(f"{d}/out").count())
    matches = live.exploded(spark.read.parquet(f"{d}/in"))
    got = keyed.latest_of(spark.read.parquet(f"{d}/out"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, keyed.latest_of(matches).select(*got.columns).collect()))
    state = {r.match_id: r.car_a for r in got.where("not is_played").collect()}
    assert state == {r.match_id: r.car_a for r in live.latest_state(matches).collect()}
    assert state[1] == 7 and 3 not in state
    assert sizes == [202, 202, 204, 206, 207, 208]  # what is written follows the batch
    run("check2", "again")  # all batches at once, as after a lost checkpoint
    assert {r.match_id: r.car_a for r in keyed.latest_of(spark.read.parquet(f"{d}/again")).collect()} == {r.match_id: r.car_a for r in got.collect()}


def test_finished_matches_leave_the_store(spark):
    d = tempfile.mkdtemp(prefix="spark-")
    t, held = dt.datetime(2024, 1, 1), []
    for i, (minute, done) in enumerate(((0, True), (200, False), (400, False))):
        log = spark.createDataFrame(_matches([(m + (1000 * i), t + dt.timedelta(minutes=minute), 1, done) for m in range(20)]), LOG)
        log.coalesce(1).write.mode("append").parquet(f"{d}/in")
        q = keyed.keep_latest(live.snapshot_stream(spark, f"{d}/in", log.schema), f"{d}/out", f"{d}/check", late="1 hour")
        q.awaitTermination()
        total = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
        held.append(total[-1])
    # twenty finished matches, then those gone and twenty open ones, then forty
    assert spark.read.parquet(f"{d}/out").count() == 60
    assert held == [20, 20, 40]


def test_fresh_rows_expire(spark):
    """Rows of the last twelve minutes, late ones among them, as the batch twin has them."""
    d = tempfile.mkdtemp(prefix="spark-")
    t = dt.datetime(2024, 1, 1)
    at = lambda m: t + dt.timedelta(minutes=m)
    last = None
    for rows in ([(1, at(0), 1, False), (2, at(3), 1, False)], [(1, at(10), 2, False), (3, at(10), 2, True), (2, at(4), 5, False)], [(4, at(14), 1, False), (2, at(1), 9, False), (5, at(3), 6, False)]):
        log = spark.createDataFrame(_matches(rows), LOG)
        log.coalesce(1).write.mode("append").parquet(f"{d}/in")
        keyed.keep_fresh(live.snapshot_stream(spark, f"{d}/in", log.schema), f"{d}/out", f"{d}/check").awaitTermination()
        last = max([r[1] for r in rows] + [last] if last else [r[1] for r in rows])
        x = live.exploded(spark.read.parquet(f"{d}/in"))
        none = spark.createDataFrame([], "open_id int, phase string, a long, b long")
        now = live.still_open(keyed.fresh_now(spark.read.parquet(f"{d}/out")), none, none)
        want = live.fresh_scores(x, last, none, none)
        key = lambda df: sorted((r.match_id, r.captured_at, r.car_a) for r in df.collect())
        assert key(now) == key(want), last
    assert [k[0] for k in key(now)] == [1, 2, 2, 4, 5]


def test_snapshot_files(spark):
    """Several files, one with broken lines, one that comes twice; a restart adds only what is new."""
    import json
    import os

    d = tempfile.mkdtemp(prefix="spark-")
    os.mkdir(f"{d}/in")
    snap = lambda o, minute, *ms: json.dumps({"open_id": o, "captured_at": f"2024-01-01T00:{minute:02}:00", "phases": [{"phase": "P", "matches": [{"match_id": m, "a": 1, "b": 2, "car_a": m, "car_b": 0, "is_played": False} for m in ms]}]})

    def put(name, *lines):
        with open(f"{d}/in/{name}", "w") as f:
            f.write("\n".join(lines) + "\n")
        return live.log_snapshots(spark, f"{d}/in", f"{d}/out", files=1)

    log = put("a.json", snap(1, 0, 1, 2), snap(1, 5, 1))
    assert sorted((r.match_id, r.captured_at.minute) for r in log.collect()) == [(1, 0), (1, 5), (2, 0)]
    put("b.json", '{"open_id": 1, "captured', "not json", '{"phases": []}', snap(2, 6, 7))
    log = put("c.json", snap(1, 0, 1, 2), snap(1, 5, 1))
    assert sorted(r.match_id for r in log.collect()) == [1, 1, 2, 7]
    assert spark.read.parquet(f"{d}/out/bad").count() == 3


def test_refresh_of_changed_keys(spark):
    """Only match-days and seasons with changed rows are made anew, and the result is that of a whole run."""
    d = tempfile.mkdtemp(prefix="spark-")
    rows = [(g, g % 4, g % 40, g % 3 > 0, 1) for g in range(400)]
    schema = "game_id int, season int, day int, is_played boolean, version int"
    day = lambda x: x.groupBy("season", "day").agg(F.count("*").alias("n"), F.sum(F.col("is_played").cast("int")).alias("played"))
    season = lambda x: x.groupBy("season").agg(F.sum("n").alias("n"), F.sum("played").alias("played"))
    steps = [live.Step(f"{d}/days", ["season", "day"], ["season"], day), live.Step(f"{d}/seasons", ["season"], ["season"], season)]
    changes = [rows, [(3, 3, 3, True, 2), (43, 3, 3, True, 2), (4, 0, 4, False, 0)], [(900, 1, 77, True, 1)]]
    for part in changes:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{d}/in")
        live.refresh(spark.readStream.schema(schema).parquet(f"{d}/in"), live.Step(f"{d}/slots", ["game_id"], ["season", "day"]), steps, "version", f"{d}/check", f"{d}/counts")
    known = {}
    for part in changes:
        for r in part:
            if r[0] not in known or known[r[0]][4] <= r[4]:
                known[r[0]] = r
    whole = spark.createDataFrame(list(known.values()), schema)
    for step, made in zip(steps, (day(whole), season(day(whole))), strict=True):
        got = marts.read_mart(spark, step.path).select(*made.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, made.collect()))
    counts = sorted((r.batch, r.step, r.made, r.known) for r in spark.read.parquet(f"{d}/counts").collect())
    assert counts == [(0, 0, 40, 40), (0, 1, 4, 4), (1, 0, 2, 40), (1, 1, 2, 4), (2, 0, 1, 41), (2, 1, 1, 4)]


def test_watermark_drops_late_rows(spark):
    d = tempfile.mkdtemp(prefix="spark-")
    t = dt.datetime(2024, 1, 10)
    schema = "ts timestamp, user_id int, event_type string, value double"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{d}/in")
    out = live.activity(spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(_first(write, t, f"{d}/in")))
    for rows in ([], [(t + dt.timedelta(days=5), 1, "a", 1.0)], [(t, 1, "a", 5.0), (t + dt.timedelta(days=9), 1, "a", 1.0)]):
        if rows:
            write(rows)
        out.writeStream.format("parquet").option("path", f"{d}/o").option("checkpointLocation", f"{d}/c").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = {r.since.day: r.total for r in spark.read.parquet(f"{d}/o").collect()}
    assert got[10] == 1.0


def _first(write, t, path):
    write([(t, 1, "a", 1.0)])
    return path


def test_copy_tree(spark):
    """Ids are dense and distinct, also of parents that share a natural key, and every child keeps its own parent."""
    p = spark.createDataFrame([(i, f"n{i % 700}") for i in range(1000)], "id int, name string")
    c = spark.createDataFrame([(i % 1000, i) for i in range(3000)], "id int, v int")
    np, nc = tables.copy_tree(p, c, "id", ["name"])
    assert sorted(r.new_id for r in np.collect()) == list(range(1, 1001)) and nc.count() == 3000
    assert sorted((r.name, r.v) for r in nc.join(np, "new_id").collect()) == sorted((f"n{i % 1000 % 700}", i) for i in range(3000))
    assert [r.name for r in np.orderBy("new_id").collect()] == sorted(f"n{i % 700}" for i in range(1000))


def test_links(spark):
    df = spark.createDataFrame([('<a href="/x/1">a</a><a HREF="/x/1"><a href="/y">',)], "h string")
    assert df.select(tables.links(F.col("h"), "^/x").alias("l")).first().l == ["/x/1"]
