"""Rooms, totals, composites and pairs on planted cases."""

import pytest
from pyspark.sql import functions as F

from reconlake.functions import scalars
from reconlake.operators import rooms


def sheet(spark, cells, scope=None):
    rows = [("s", c[2] if len(c) > 2 else scope, c[0], float(c[1])) for c in cells]
    return spark.createDataFrame(rows, "sheet string, scope string, number string, area double")


CASES = [
    (10.0, 10.0, 0.01, "NEGATIVE_VERIFIED", None),
    (10.0, 12.5, 0.01, "CANDIDATE", "+2.50"),
    (51.50, 51.60, 0.01, "NEGATIVE_VERIFIED", None),
    (8.7, 8.8, 0.01, "NEGATIVE_VERIFIED", None),
    (1.8, 1.6, 0.01, "CANDIDATE", "-0.20"),
    (13.70, 11.80, 0.01, "CANDIDATE", "-1.90"),
    (51.23, 51.33, 0.001, "CANDIDATE", "+0.10"),
]


@pytest.mark.parametrize("pd_area, rd_area, relative, status, delta", CASES)
def test_tolerance(spark, pd_area, rd_area, relative, status, delta):
    got = rooms.reconcile(sheet(spark, [("1", pd_area)]), sheet(spark, [("1", rd_area)]), relative).first()
    assert (got.status, got.delta) == (status, delta)


def test_added_room_needs_both_neighbours(spark):
    pd = sheet(spark, [("1.108", 5), ("1.110", 6)])
    got = {r.number: r for r in rooms.reconcile(pd, sheet(spark, [("1.108", 5), ("1.109", 18.2), ("1.110", 6)]), 0.01).collect()}
    assert (got["1.109"].status, got["1.109"].expected, got["1.109"].actual) == ("CANDIDATE", None, "18.20")
    alone = {r.number: r.status for r in rooms.reconcile(pd, sheet(spark, [("1.108", 5), ("2.109", 18.2)]), 0.01).collect()}
    assert alone["2.109"] is None and alone["1.110"] is None


def test_composites_by_natural_order(spark):
    def runs(pd, rd):
        found = rooms.islands(rooms.reconcile(sheet(spark, pd), sheet(spark, rd), 0.01)).collect()
        return sorted((r.scope or "", r.first_number, r.last_number, r.atoms, r.expected, r.actual, r.delta) for r in found)

    assert runs([(str(i), 10) for i in range(1, 5)], [("1", 10), ("2", 12), ("3", 12), ("4", 12)]) == [("", "2", "4", 3, "30.00", "36.00", "+6.00")]
    five = runs([(str(i), 10) for i in range(1, 6)], [("1", 12), ("2", 12), ("3", 10), ("4", 12), ("5", 12)])
    assert [(r[1], r[2]) for r in five] == [("1", "2"), ("4", "5")]
    scopes = runs([("9", 10, "a"), ("10", 10, "b")], [("9", 12, "a"), ("10", 12, "b")])
    assert [(r[0], r[3]) for r in scopes] == [("a", 1), ("b", 1)]
    assert runs([("1.9", 10), ("1.10", 10)], [("1.9", 12), ("1.10", 12)])[0][1:4] == ("1.9", "1.10", 2)


def test_neighbours_keep_width(spark):
    df = spark.createDataFrame([("1.109",), ("7",), ("09",), ("9",), ("A",), ("1.0",), ("99",)], "n string")
    got = {r.n: (r.a, r.b) for r in df.select("n", scalars.neighbour(F.col("n"), -1).alias("a"), scalars.neighbour(F.col("n"), 1).alias("b")).collect()}
    assert got == {"1.109": ("1.108", "1.110"), "7": ("6", "8"), "09": ("08", "10"), "9": ("8", "10"), "A": (None, None), "1.0": (None, None), "99": ("98", "100")}


def test_pairs_take_the_largest_share_and_a_minimum(spark):
    pd = spark.createDataFrame([(1, n) for n in range(10)] + [(2, n) for n in range(5, 9)] + [(3, 50)], "sheet long, number long")
    rd = spark.createDataFrame([(7, n) for n in range(5, 9)] + [(8, n) for n in (0, 90, 91, 92)], "sheet long, number long")
    assert [(r.rd_sheet, r.pd_sheet, r.shared) for r in rooms.pair_sheets(pd, rd).collect()] == [(7, 1, 4)]


def test_totals_need_one_on_each_side(spark):
    t = lambda *a: spark.createDataFrame([(s, float(x)) for s, x in a], "sheet string, area double")
    got = {r.sheet: r.status for r in rooms.totals(t(("a", 6234.10), ("b", 1), ("b", 2), ("c", 10)), t(("a", 6252.30), ("b", 1), ("c", 20)), 0.01).collect()}
    assert got == {"a": "NEGATIVE_VERIFIED", "c": "CANDIDATE"}


def test_dedupe(spark):
    rows = [("s", "1", 5.0, None), ("s", "1", 5.004, "x"), ("s", "2", 5.0, "a"), ("s", "2", 9.0, "b"), ("s", "3", 5.0, None), ("s", "3", 9.0, "b"), ("s", "4", 1.0, "a"), ("s", "4", 2.0, "a")]
    df = spark.createDataFrame(rows, "sheet string, number string, area double, scope string")
    got = sorted((r.number, r.scope, r.area, r.members) for r in rooms.dedupe(df).collect())
    assert got == [("1", "x", 5.0, 2), ("2", "a", 5.0, 1), ("2", "b", 9.0, 1)]


def test_room_names(spark):
    names = [("Тех.помещение", "техническое помещение"), ("Техническое  помещение", "техническое помещение"), ("С/У", "санузел"), ("с / у", "санузел"), ("ЛК", "лестничная клетка")]
    df = spark.createDataFrame(names, "name string, want string")
    assert df.where(scalars.room_name(F.col("name")) != F.col("want")).count() == 0


def test_neighbours_keep_their_width_and_prefix(spark):
    def rooms_of(*numbers):
        return spark.createDataFrame([(1, None, n, 10.0) for n in numbers], "sheet long, scope string, number string, area double")

    pd = rooms_of("1.08", "1.10", "2.9", "2.10", "9", "010", "10")
    rd = rooms_of("1.08", "1.09", "1.10", "2.8", "2.9", "2.10", "8", "9", "09", "10")
    got = {r.number: r.status for r in rooms.reconcile(pd, rd, 0.01).collect()}
    assert got["1.09"] == "CANDIDATE"  # between 1.08 and 1.10
    assert got["2.8"] is None and got["8"] is None  # without a lower neighbour
    assert got["09"] is None  # 08 and 10 are its neighbours, and 8 is none
    assert got["010"] is None and got["10"] == "NEGATIVE_VERIFIED"


def test_greedy_matching_of_misaligned_cells(spark):
    import random

    from reconlake.operators import geometry

    rng = random.Random(5)
    cells = []
    for page in range(12):
        for i in range(rng.randrange(3, 14)):
            y = rng.randrange(8) / 40 + rng.choice([0, 0.004, 0.009])
            kind = rng.choice(["number", "area", "area"])
            x = 0.1 if kind == "number" else rng.choice([0.05, 0.5, 0.7])
            cells.append((page, 100 * page + i, kind, x, y, x + 0.05, y + 0.012))
    df = spark.createDataFrame(cells, "page long, line long, kind string, x0 double, y0 double, x1 double, y1 double")
    for to_right in (False, True):  # rows of tables take any area of their row, totals only those to their right
        want = set()
        for page in range(12):
            own = [c for c in cells if c[0] == page]
            free = [c for c in own if c[2] == "area"]
            for n in sorted((c for c in own if c[2] == "number"), key=lambda c: (c[4], c[1])):
                fits = [a for a in free if a[4] <= n[6] + 0.008 and n[4] <= a[6] + 0.008 and (a[3] > n[3] or not to_right)]
                if fits:
                    best = min(fits, key=lambda a: (abs((a[4] + a[6]) / 2 - (n[4] + n[6]) / 2), a[1]))
                    free.remove(best)
                    want.add((page, n[1], best[1]))
        assert {tuple(r) for r in geometry.match_rows(df, to_right).collect()} == want and len(want) > 10
