"""Where findings, composites and check rows of rooms are seen."""

from reconlake.operators import rooms, rules

SIDE = "sheet long, scope string, number string, area double, evidence struct<file_id:long,page:long,x0:double,y0:double,x1:double,y1:double>, pd_evidence string, status string"


def side(spark, file_id, rows):
    """Rooms (number, area, place): a place is the box's left and upper corner; null: the room isn't boxed."""
    made = [(1, None, n, a, None if at is None else (file_id, 7, at, at, at + 1, at + 2), "x", "y") for n, a, at in rows]
    return spark.createDataFrame(made, SIDE)


def test_evidence_of_both_sides_absences_and_composites(spark):
    pd = side(spark, 1, [("1", 10.0, 1.0), ("2", 10.0, 2.0), ("3", 10.0, 3.0), ("5", 10.0, 5.0), ("7", 10.0, None), ("9", 10.0, 9.0)])
    rd = side(spark, 2, [("1", 10.0, 11.0), ("2", 20.0, 12.0), ("3", 20.0, 13.0), ("4", 20.0, 14.0), ("5", 10.0, 15.0), ("7", 20.0, 17.0), ("11", 5.0, 21.0)])
    found = rooms.reconcile(pd, rd, 0.01)
    seen = lambda e: None if e is None else (e.file_id, e.page, e.x0, e.y0, e.x1, e.y1)
    got = {r.number: (r.status, seen(r.pd_evidence), seen(r.rd_evidence)) for r in found.collect()}
    at = lambda f, x: (f, 7, x, x, x + 1, x + 2)
    assert got == {
        "1": ("NEGATIVE_VERIFIED", at(1, 1.0), at(2, 11.0)), "2": ("CANDIDATE", at(1, 2.0), at(2, 12.0)), "3": ("CANDIDATE", at(1, 3.0), at(2, 13.0)),
        "4": ("CANDIDATE", (1, 7, 3.0, 3.0, 6.0, 7.0), at(2, 14.0)), "5": ("NEGATIVE_VERIFIED", at(1, 5.0), at(2, 15.0)), "7": ("CANDIDATE", None, at(2, 17.0)),
        "9": (None, at(1, 9.0), None), "11": (None, None, at(2, 21.0)),
    }
    named = lambda df: df.selectExpr("*", "sheet as object_id", "'p' as pair")
    rows = {r.subject: r for r in rules.room_check_rows(named(found), named(rooms.islands(found))).collect()}
    said = lambda s: [(f.role, f.value, f.file_id, f.x0, f.y1) for f in rows[s].fragments]
    assert said("rooms 2..4") == [("expected", "20.00", 1, 2.0, 7.0), ("actual", "60.00", 2, 12.0, 16.0)]
    assert said("room 4") == [("expected", None, 1, 3.0, 7.0), ("actual", "20.00", 2, 14.0, 16.0)] and said("room 7") == [("actual", "20.00", 2, 17.0, 19.0)]
    assert rows["room 4"].parent_group_id == rows["rooms 2..4"].group_id and rows["room 7"].parent_group_id is None and "room 9" not in rows


def test_without_evidence_and_without_rooms(spark):
    pd = side(spark, 1, [("1", 10.0, 1.0)])
    assert rooms.reconcile(pd.limit(0), pd.limit(0), 0.01).count() == 0
    plain = rooms.reconcile(pd.drop("evidence"), pd.drop("evidence"), 0.01)
    assert "pd_evidence" not in plain.columns and plain.first().status == "NEGATIVE_VERIFIED"
    assert "fragments" not in rules.room_check_rows(plain.selectExpr("*", "sheet as object_id", "'p' as pair"), rooms.islands(plain).selectExpr("*", "sheet as object_id", "'p' as pair")).columns
