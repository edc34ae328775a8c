"""Plans that must not grow with the input beyond it: nothing large is broadcast, nothing is made in one task, no step runs twice."""

from pyspark.sql import functions as F

from reconlake.operators import decisions, matrix, rooms, rules, sheets, textlayer
from reconlake.plans import dealing
from reconlake.queries import reconciliation
from reconlake.queries import sheets as query_sheets

LINES = "page long, block int, line long, kind string, text string, x0 double, y0 double, x1 double, y1 double"


def plan_of(spark, df):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def page_of(cells):
    return [(1, 0, n, kind, text, x, y, x + 0.1, y + 0.01) for n, (kind, text, x, y) in enumerate(cells)]


def test_floor_totals_meet_their_areas_without_a_join(spark):
    lines = spark.createDataFrame(page_of([(None, "Итого:", 0.2, 0.3), (None, "ИТОГО", 0.2, 0.302), (None, "5,25", 0.4, 0.3), (None, "7,5", 0.4, 0.304), (None, "9,75", 0.1, 0.3)]), LINES)
    found = textlayer.floor_totals(lines)
    assert sorted(tuple(r)[1:4] for r in found.collect()) == [(0, 2, 5.25), (1, 3, 7.5)]
    assert "Join" not in plan_of(spark, found)


def test_names_meet_their_rows_without_a_join(spark):
    cells = page_of([("number", "1", 0.1, 0.1), ("number", "2", 0.1, 0.116), ("name", "upper", 0.2, 0.108), ("name", "b", 0.3, 0.101), ("name", "a", 0.2, 0.101), ("name", "far", 0.2, 0.4)])
    found = textlayer.names_of_rows(spark.createDataFrame(cells, LINES))
    assert [tuple(r) for r in found.collect()] == [(1, 0, "a b upper")]
    assert "Join" not in plan_of(spark, found)


def test_rows_are_dealt_by_their_number(spark, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    assert dealing.dealt(stored, "id", most=50).rdd.getNumPartitions() == 20
    assert dealing.parts(stored, 10_000) == spark.sparkContext.defaultParallelism


def test_labels_are_searched_once(spark):
    lines = spark.createDataFrame([(1, 1, "height: 5", 0.1, 0.1, 0.2, 0.11), (1, 2, "height", 0.1, 0.3, 0.2, 0.31), (1, 3, "7", 0.4, 0.3, 0.5, 0.31)], "page long, line long, text string, x0 double, y0 double, x1 double, y1 double")
    found = matrix.locate(lines, spark.createDataFrame([("height", "m")], "label string, unit string"))
    assert sorted((r.line, r.value) for r in found.collect()) == [(1, 5.0), (2, 7.0)]
    assert "EvalPython" not in plan_of(spark, found)  # what was found is stored


def test_sheets_and_their_checks_are_dealt_as_asked(spark):
    sides = [spark.createDataFrame([(1, None, str(n), float(n + add)) for n in range(1, 6)], "sheet long, scope string, number string, area double") for add in (0, 3)]
    found = rooms.reconcile(*sides, 0.01, 7)
    named = lambda df: df.withColumns({"object_id": F.col("sheet"), "pair": F.lit("p")})
    rows = rules.room_check_rows(named(found), named(rooms.islands(found)), parts=7)
    plan = plan_of(spark, rows)
    assert "Join" not in plan and "4)" not in [x[-2:] for x in plan.split(", ") if "hashpartitioning" in x]
    assert found.rdd.getNumPartitions() == 7
    got = {r.group_id: r.parent_group_id for r in rows.collect()}
    assert got["1:M-003:p:rooms 1..5"] is None and all(got[f"1:M-003:p:room {n}"] == "1:M-003:p:rooms 1..5" for n in range(1, 6)) and len(got) == 6


def test_readings_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setitem(dealing.dealt.__kwdefaults__, "most", 500)
    n = -(-spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count() // 500)
    for query in (reconciliation.cluster_by_area, reconciliation.dedupe_rooms):
        plan = plan_of(spark, query(spark, "/root/testdata/sf0.001"))
        dealt = [x for x in plan.splitlines() if "- Exchange hashpartitioning" in x]
        assert len(dealt) == 1 and f", {n})" in dealt[0], plan


def test_units_meet_their_decisions_once(spark):
    checks = spark.createDataFrame([(11, 1, None, "CANDIDATE"), (12, 1, 11, "CANDIDATE"), (13, 1, 11, "SUSPICION"), (21, 2, None, "CANDIDATE")], "check_id long, process_id long, parent_id long, status string")
    checks = checks.withColumns({"split_at": F.lit(None).cast("long"), "verified_by": F.lit(None).cast("long")})
    said = [(1, 5, 12, "verdict"), (2, 1, 11, "verdict"), (3, 4, 11, "split"), (4, 6, 13, "promote"), (5, 1, 99, "verdict"), (6, 1, 21, "verdict"), (7, 2, 21, "verdict")]
    events = spark.createDataFrame(said, "event_id long, at long, check_id long, kind string").withColumns({"decision": F.lit("CONFIRMED_VIOLATION"), "reason_code": F.lit("R"), "comment": F.lit("why"), "user_id": F.lit(1).cast("long")})
    protocols = spark.createDataFrame([(1, 1, "READY")], "process_id long, version long, status string")
    found = decisions.folded(checks, events, protocols)
    got = {r.event_id: (r.process_id, r.refused, r.before, r.after, r.comment) for r in found.collect()}
    assert got == {
        1: (1, None, 1, 0, "why"), 2: (1, "COMPOSITE_NOT_SPLIT", 1, 1, "why"), 3: (1, None, 1, 1, "why"), 4: (1, None, 0, 1, "why"), 5: (None, "FINDING_NOT_FOUND", None, None, "why"),
        6: (2, "PROTOCOL_NOT_FOUND", 1, 1, "why"), 7: (2, "PROTOCOL_NOT_FOUND", 1, 1, "why"),
    }
    # Checks meet protocols, events meet checks, a unit's rows meet: no event is dealt more than twice.
    assert plan_of(spark, found.select("*")).count("Join") == 2


def test_pages_are_dealt_as_asked(spark):
    lines = spark.createDataFrame(page_of([(None, "Итого:", 0.2, 0.3), (None, "5,25", 0.4, 0.3)]), LINES)
    found = sheets.find(lines.withColumn("block", F.col("block").cast("long")), 7)[1]
    assert [(r.label, r.area) for r in found.collect()] == [("Итого:", 5.25)]
    assert "hashpartitioning(page" in plan_of(spark, found.select("*")) and ", 7)" in plan_of(spark, found.select("*"))


def test_texts_are_read_and_pairs_matched_once(spark):
    """Pairs are matched in one place of the plan of rooms, and each pattern is sought once, before lines are dealt."""
    lines = spark.createDataFrame(page_of([(None, "1", 0.2, 0.3), (None, "5,25", 0.4, 0.3)]), LINES).withColumn("block", F.col("block").cast("long"))
    plan = plan_of(spark, sheets.find(lines, 2)[0])
    assert plan.count("aggregate(") == 1  # pairs
    below = plan[plan.index("Exchange hashpartitioning(page") :]
    texts = [x for x in plan.splitlines() if "RLIKE" in x]
    assert texts and all(x in below for x in texts) and plan.count("RLIKE") == 5, plan


def test_lines_of_pages_are_made_in_small_pieces(spark):
    """Of all lines that an order line may have, what is the same for all is one constant, which is spread; no array of lines is put together for each."""
    plan = plan_of(spark, query_sheets._lines(query_sheets._entries(spark, "/root/testdata/sf0.001")))
    assert "Generate inline([[" in plan and "size(" not in plan, plan
