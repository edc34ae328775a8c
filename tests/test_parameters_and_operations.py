"""Matrix rules, geometry, operations and the task stream on planted cases."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from reconlake.functions import scalars
from reconlake.operators import geometry, matrix, operations
from reconlake.streaming import tasks


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


@pytest.mark.parametrize(
    "text, unit, want",
    [("1 520,4 м2", "м²", 1520.4), ("0,70", "доли", 0.7), ("45 %", "доли", 0.45), ("0,5 доли", "%", 50.0), ("3 м³", "м²", None), ("м2", "м²", None), ("II", None, None)],
)
def test_values(spark, text, unit, want):
    got = one(spark, matrix.value_of(F.lit(text), F.lit(unit).cast("string"))["value"])[0]
    assert got == want or abs(got - want) < 1e-12


def test_confidence_bar(spark):
    c = lambda m, u, x, d: matrix.confidence(F.lit(m), F.lit(u), F.lit(x), F.lit(d))
    got = one(spark, c("same_line", True, 0, False), c("next_line", True, 0, False), c("next_line", False, 0, True), c("same_line", False, 3, False))
    assert [round(x, 9) for x in got] == [1.0, 0.7, 0.65, 0.8]


def test_rule_matrix_rows(spark):
    rows = [
        ("M-001", "delta_gt", 0.0, 1520.4, 1580.0, "CANDIDATE"), ("M-002", "relative_delta_gt", 0.01, 4521.3, 4521.4, "NEGATIVE_VERIFIED"), ("M-007", None, None, 9.0, 10.0, "CANDIDATE"),
        ("M-008", None, None, 27.3, None, "MISSING_EVIDENCE"), ("M-127", "delta_gt", 0.0, 0.7, 0.7, "NEGATIVE_VERIFIED"), ("zero", "relative_delta_gt", 0.1, 0.0, 1.0, "CANDIDATE"),
        ("none", "delta_gt", None, 1.0, 9.0, "NEGATIVE_VERIFIED"), ("both", None, None, None, None, "NOT_COMPARABLE"),
    ]
    df = spark.createDataFrame(rows, "code string, op string, t double, a double, b double, want string")
    a, b = F.col("a"), F.col("b")
    got = matrix.compare_pair(F.lit(1), F.lit(1), a, b, F.lit(True), matrix.violates(F.col("op"), a, b, F.col("t")))
    assert [r.code for r in df.where(got != F.col("want")).collect()] == []
    limits = one(spark, matrix.normative(F.lit(None).cast("double"), F.lit(1.1), F.lit(1.2), F.lit(None).cast("double")), matrix.normative(F.lit(1.5), F.lit(1.1), F.lit(1.2), F.lit(None).cast("double")))
    assert tuple(limits) == ("CANDIDATE", "NEGATIVE_VERIFIED")


def test_locate_by_line_row_and_column(spark):
    lines = [
        (1, 1, "Общая ПЛОЩАДЬ, здания: 12,5 м2", 0.1, 0.1, 0.3, 0.11), (1, 2, "Высота", 0.1, 0.2, 0.2, 0.21), (1, 3, "30 м", 0.5, 0.2, 0.6, 0.21), (1, 4, "99", 0.8, 0.2, 0.9, 0.21),
        (1, 5, "Высота", 0.1, 0.4, 0.2, 0.41), (1, 6, "31", 0.1, 0.42, 0.2, 0.43), (1, 7, "подплощадь 8", 0.1, 0.6, 0.2, 0.61),
    ]
    df = spark.createDataFrame(lines, "page long, line long, text string, x0 double, y0 double, x1 double, y1 double")
    labels = spark.createDataFrame([("общая площадь здания", "м²"), ("высота", "м"), ("площадь", "м²")], "label string, unit string")
    got = {(r.label, r.line): (r.method, r.value) for r in matrix.locate(df, labels).collect()}
    assert got[("общая площадь здания", 1)] == ("same_line", 12.5) and got[("высота", 2)] == ("same_row", 30.0) and got[("высота", 5)] == ("next_line", 31.0)
    assert ("площадь", 7) not in got


def test_sides_and_presence(spark):
    rows = [("a", 1.04, 0.7, 2), ("a", 0.96, 0.9, 1), ("b", 1.0, 1.0, 1), ("b", 2.0, 0.8, 2)]
    got = {r.code: (r.n_values, r.value, r.shown) for r in matrix.resolve_side(spark.createDataFrame(rows, "code string, value double, confidence double, ord long"), "code").collect()}
    assert got == {"a": (1, 0.96, "1.0"), "b": (2, None, "1.0; 2.0")}
    hay = F.array(F.lit("раздел пз.pdf"))
    assert tuple(one(spark, matrix.present(F.lit(" ПЗ;ар"), hay), matrix.present(F.lit("кр"), hay), matrix.present(F.lit(" ; "), hay))) == (True, False, None)


def test_boxes(spark):
    box = lambda *v: F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(v, ("x0", "y0", "x1", "y1"))])
    got = one(spark, scalars.iou(box(0, 0, 1, 1), box(0.5, 0, 1.5, 1)), scalars.iou(box(0, 0, 0, 0), box(0, 0, 0, 0)))
    assert abs(got[0] - 1 / 3) < 1e-12 and got[1] == 0
    n = scalars.box_normalized(*[F.lit(float(x)) for x in (90, -5, 10, 50, 100, 100)])
    assert tuple(one(spark, n)[0]) == (0.1, 0.0, 0.9, 0.5)


def test_greedy_rows_use_each_area_once(spark):
    rows = [(1, 1, "number", 0.1, 0.10, 0.2, 0.11), (1, 2, "number", 0.1, 0.115, 0.2, 0.125), (1, 3, "area", 0.7, 0.10, 0.8, 0.11), (1, 4, "area", 0.7, 0.115, 0.8, 0.125), (1, 5, "number", 0.1, 0.5, 0.2, 0.51)]
    df = spark.createDataFrame(rows, "page long, line long, kind string, x0 double, y0 double, x1 double, y1 double")
    assert sorted((r.number_line, r.area_line) for r in geometry.match_rows(df).collect()) == [(1, 3), (2, 4)]


def test_strips(spark):
    got = [(r.strip_no, r.top, r.bottom) for r in geometry.strips(spark.range(1), F.lit(600.0), 256.0).collect()]
    assert got == [(0, 0.0, 256.0), (1, 256.0, 512.0), (2, 512.0, 600.0)]


def test_retry_ladder(spark):
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    r = lambda n, c: operations.retry(F.lit(n), F.lit(c).cast("int"), now)
    got = one(spark, r(1, 500), r(2, None), r(3, 429), r(4, 503), r(1, 404))
    assert [x.status for x in got] == ["PENDING", "PENDING", "PENDING", "FAILED", "FAILED"]
    assert [x.next_at and (x.next_at - datetime.datetime(2026, 1, 1)).total_seconds() for x in got[:3]] == [60, 300, 900]


def test_counters_fall_back_to_zero(spark):
    ts = lambda m: datetime.datetime(2026, 1, 1, 0, m)
    df = spark.createDataFrame([("k", ts(0), 5.0), ("k", ts(1), 8.0), ("k", ts(2), 2.0), ("k", ts(59), 4.0)], "k string, ts timestamp, value double")
    assert operations.increases(df, "1 hour", "k").first().increase == 3 + 2 + 2


def test_accuracy(spark):
    a = lambda x, y: operations.character_accuracy(F.lit(x), F.lit(y))
    assert tuple(one(spark, a("abcd", "abxd"), a("", ""), a("", "x"), a("a", "zzzz"))) == (0.75, 1.0, 0.0, 0.0)


def test_task_stream_keeps_going_after_bad_messages(spark, tmp_path):
    (tmp_path / "in").mkdir()
    good = [json.dumps({"type": k, "process_id": i}) for i, k in enumerate([*tasks.KINDS, "process.start"])]
    (tmp_path / "in" / "a.json").write_text("\n".join([*good, "{broken", json.dumps({"type": "unknown"})]))
    seen = []
    handlers = {k: (lambda rows, batch_id, k=k: seen.extend((k, r.process_id) for r in rows.collect())) for k in tasks.KINDS}
    run = lambda: tasks.consume(tasks.messages(spark, str(tmp_path / "in")), handlers, str(tmp_path / "dead"), str(tmp_path / "cp")).awaitTermination()
    run()
    assert sorted(seen) == [("process.hypotheses", 2), ("process.start", 0), ("process.start", 3), ("process.update", 1)]
    assert spark.read.parquet(str(tmp_path / "dead")).count() == 2
    (tmp_path / "in" / "b.json").write_text(good[0])
    run()
    assert len(seen) == 5


def test_rates_of_a_stream(spark, tmp_path):
    schema = "ts timestamp, type string, value double"
    rows = [(datetime.datetime(2026, 1, 1, 0, m), "a", 1.5) for m in (1, 2, 20)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    out = tasks.rates(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.start.minute, r.n, r.total) for r in spark.table("rates").collect()) == [(0, 2, "3.00"), (15, 1, "1.50")]
