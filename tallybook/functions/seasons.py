"""Seasons, ranking months, points and keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Points of the open circuit by position up to 80, as (first position, points falling by one from there).
OPEN_RUNS = ((1, (180, 165, 155, 155, 146, 144, 142, 140)), (9, tuple(range(132, 124, -1))), (17, tuple(range(118, 102, -1))), (33, tuple(range(95, 79, -1))), (49, tuple(range(72, 56, -1))), (65, tuple(range(49, 33, -1))))
#: Fixed values: (last position, points) beyond, and the two tables of the women's circuit, which end in a floor.
OPEN_BANDS, OPEN_FLOOR = ((96, 25), (112, 18), (128, 15)), 12
WOMEN_CHAMPIONSHIP = (150, 120, 90, 90, 70, 68, 66, 64, 44, 42, 40, 38)
WOMEN_OPEN = (100, 80, 60, 60, 40, 38, 36, 34, 20, 18, 16, 14)


def season_of(d: Column) -> Column:
    """'YYYY-YYYY'; a season begins in August."""
    y = F.when(F.month(d) >= 8, F.year(d)).otherwise(F.year(d) - 1)
    return F.concat_ws("-", y.cast("string"), (y + 1).cast("string"))


def season_range(d: Column) -> Column:
    """First and last day of the season as games are counted: September to August."""
    y = F.when(F.month(d) >= 9, F.year(d)).otherwise(F.year(d) - 1)
    return F.struct(F.make_date(y, F.lit(9), F.lit(1)).alias("first"), F.make_date(y + 1, F.lit(8), F.lit(31)).alias("last"))


def season_start(d: Column) -> Column:
    """First of August on or before the day."""
    return F.make_date(F.when(F.month(d) >= 8, F.year(d)).otherwise(F.year(d) - 1), F.lit(8), F.lit(1))


def ranking_month(d: Column, margin: int = 5) -> Column:
    """First day of the month whose ranking a publication day belongs to: the next one near a month's end, never August."""
    m = F.trunc(F.when(F.datediff(F.last_day(d), d) <= margin, F.add_months(d, 1)).otherwise(d), "month")
    return F.when(F.month(m) == 8, F.add_months(m, 1)).otherwise(m)


def month_index(y: Column, m: Column) -> Column:
    """Rankings since year 0: eleven a year, none in August."""
    return (y * 11 + F.when(m < 8, m).otherwise(m - 1)).cast("int")


def month_of_index(i: Column) -> Column:
    """First day of the month with that ranking index."""
    k = F.pmod(i - 1, F.lit(11)) + 1
    return F.make_date(F.floor((i - 1) / 11).cast("int"), F.when(k < 8, k).otherwise(k + 1), F.lit(1))


def next_ranking_month(d: Column) -> Column:
    n = F.add_months(F.trunc(d, "month"), 1)
    return F.when(F.month(n) == 8, F.add_months(n, 1)).otherwise(n)


def date_distance(a: Column, b: Column) -> Column:
    return F.coalesce(F.abs(F.datediff(a, b)), F.lit(1_000_000))


def points_for_position(p: Column, table: str = "open") -> Column:
    """Points for a final position; null below 1."""
    if table != "open":
        pts = WOMEN_CHAMPIONSHIP if table == "women_championship" else WOMEN_OPEN
        return F.when(p >= 1, F.element_at(F.array(*map(F.lit, pts)), F.least(p.cast("int"), F.lit(len(pts)))))
    out = F.lit(OPEN_FLOOR)
    for last, pts in reversed(OPEN_BANDS):
        out = F.when(p <= last, pts).otherwise(out)
    for first, pts in reversed(OPEN_RUNS):
        out = F.when(p < first + len(pts), F.element_at(F.array(*map(F.lit, pts)), F.greatest(p.cast("int") - first + 1, F.lit(1)))).otherwise(out)
    return F.when(p >= 1, out)


def game_key(day, comp, disc, a, b, car_a, car_b, ent) -> Column:
    """20 hex digits that name a game whichever side reports it."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    swap = a > b
    parts = [day, comp, disc, F.least(a, b), F.greatest(a, b), F.when(swap, car_b).otherwise(car_a), F.when(swap, car_a).otherwise(car_b), ent]
    return F.substring(F.sha1(F.concat_ws("|", *map(text, parts)).cast("binary")), 1, 20)


def game_signature(name_a: Column, car_a: Column, name_b: Column, car_b: Column, ent: Column) -> Column:
    """Both sides' name and points in order, and the innings."""
    side = lambda n, c: F.concat_ws(":", n.cast("string"), c.cast("string"))
    return F.concat_ws("|", F.least(side(name_a, car_a), side(name_b, car_b)), F.greatest(side(name_a, car_a), side(name_b, car_b)), ent.cast("string"))
