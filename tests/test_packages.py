"""Sources, registries, views, merges and metrics on planted cases."""

import datetime

from pyspark.sql import functions as F

from reconlake.operators import merging, metrics, registry, sources, views

FILE = "object_id long, file_id long, status string, approved_on date, predecessor_id long"
D = datetime.date


def test_source_selection(spark):
    rows = [
        (1, 10, "APPROVED", D(2026, 1, 1), None),  # the only one
        (2, 20, "CANCELLED", D(2026, 1, 1), None),  # nothing is left
        (3, 30, "APPROVED", D(2026, 1, 1), None), (3, 31, "APPROVED", D(2026, 2, 1), 30),  # 30 is replaced
        (4, 40, "APPROVED", D(2026, 1, 1), None), (4, 41, "CANCELLED", D(2026, 2, 1), 40),  # a cancelled file replaces nothing
        (5, 50, "DRAFT", None, None),
        (6, 60, "APPROVED", D(2026, 1, 1), None), (6, 61, "FOR_CONSTRUCTION", D(2026, 2, 1), None),  # the later date
        (7, 70, "APPROVED", D(2026, 1, 1), None), (7, 71, "APPROVED", D(2026, 1, 1), None),  # a tie
        (8, 80, "APPROVED", D(2026, 1, 1), None), (8, 81, "APPROVED", None, None),  # one without a date
        (None, 90, "APPROVED", None, None),  # a null key is a key
    ]
    got = {r.object_id: (r.outcome, r.file_id) for r in sources.select_source(spark.createDataFrame(rows, FILE), ["object_id"]).collect()}
    unclear = ("CLARIFICATION_REQUIRED", None)
    assert got == {
        1: ("COMPLETE", 10), 2: ("MISSING_EVIDENCE", None), 3: ("COMPLETE", 31), 4: ("COMPLETE", 40), 5: unclear, 6: ("COMPLETE", 61), 7: unclear, 8: unclear, None: ("COMPLETE", 90),
    }


def test_completeness_and_scenario(spark):
    counts = [(1, "PD", 2, 2), (1, "RD", 1, 1), (1, "ID", 1, 1), (2, "PD", 2, 1), (3, "RD", 1, 1), (4, "PD", 1, 0), (5, "PD", 1, 1), (5, "ID", 1, 1)]
    complete = sources.completeness(spark.createDataFrame(counts, "object_id long, stage string, expected long, uploaded long"))
    got = {(r.object_id, r.stage): r.completeness for r in complete.collect()}
    assert (got[1, "PD"], got[2, "PD"], got[3, "PD"], got[4, "PD"]) == ("UPLOADED", "PARTIAL", "NOT_APPLICABLE", "MISSING") and len(got) == 15
    scenarios = {r.object_id: r.scenario for r in sources.scenario(complete).collect()}
    assert scenarios == {1: "FULL", 2: "PARTIALLY_LOADED", 3: "SINGLE_RD", 4: None, 5: "PD_ID"}


def test_registry_rows(spark):
    rows = [
        (2, "o", "f.pdf", "pd", "approved", "5.1.2026"),
        (3, "", "f.pdf", "RD", None, None),
        (4, "o", "f.pdf", "XX", "", "2026-01-05"),
        (5, "o", "f.pdf", "ID", "maybe", ""),
        (6, "o", "f.pdf", "ID", "draft", "soon"),
    ]
    df = spark.createDataFrame(rows, "row_number long, object_id string, file_name string, doc_stage string, approval_status string, approval_date string")
    got = {r.row_number: (r.errors, r.kept, r.approval_status, r.approval_date) for r in registry.parse(df).collect()}
    assert got == {
        2: ([], True, "APPROVED", D(2026, 1, 5)), 3: (["EMPTY_OBJECT_ID"], False, "DRAFT", None), 4: (["UNKNOWN_STAGE"], False, "DRAFT", D(2026, 1, 5)),
        5: (["UNKNOWN_APPROVAL"], False, "MAYBE", None), 6: (["BAD_DATE"], True, "DRAFT", None),
    }


def test_registry_files(spark, tmp_path):
    (tmp_path / "r.csv").write_text("﻿Object ID;File-Name;Стадия\no;a.pdf;PD\no;b.pdf;RD\n", encoding="utf-8")
    rows = registry.with_aliases(registry.read_csv(spark, str(tmp_path / "r.csv")), {"стадия": "doc_stage", "object id": "object_id", "file name": "file_name"})
    assert rows.columns == ["object_id", "file_name", "doc_stage"] and rows.count() == 2 and registry.missing_columns(rows) == []
    (tmp_path / "r.json").write_text('{"files": [{"object_id": "o", "file_name": "a"}, {"object_id": "p", "doc_stage": "PD"}]}')
    found = registry.read_json(spark, str(tmp_path / "r.json"))
    assert found.columns == ["row_number", "object_id", "file_name", "doc_stage"]  # as first seen
    assert [tuple(r) for r in found.orderBy("row_number").collect()] == [(2, "o", "a", None), (3, "p", None, "PD")]


CHECK = "check_id long, object_id long, parent_id long, split_at date, status string, verified_by long"


def test_visibility_and_summary(spark):
    day = D(2026, 1, 1)
    rows = [
        (1, 1, None, None, "CANDIDATE", None), (2, 1, None, day, "CANDIDATE", None), (3, 1, 2, None, "NEGATIVE_VERIFIED", 5), (4, 1, 1, None, "CANDIDATE", None),
        (5, 1, 99, None, "CANDIDATE", None), (6, 1, None, None, "NEGATIVE_VERIFIED", None), (7, 1, None, None, None, None), (8, 1, None, None, "SUSPICION", None),
    ]
    df = spark.createDataFrame(rows, CHECK)
    shown = views.visible(df)
    assert sorted(r.check_id for r in shown.collect()) == [1, 3, 6, 7, 8]
    s = views.summary(shown, "object_id").first()
    assert (s.total, s.candidates, s.rejected, s.verified, s.suspicions, s.completeness, s.awaiting) == (5, 1, 1, 1, 1, 1, 1)
    assert [r.check_id for r in views.page(df, [F.col("check_id")], limit=2, offset=1).collect()] == [2, 3]
    back = views.from_snapshot(views.snapshot(df.select("object_id", "check_id", "status"), "object_id"), "object_id", "check_id bigint, status string")
    assert sorted(tuple(r) for r in back.collect()) == sorted((1, r[0], r[4]) for r in rows) or back.count() == len(rows)


def test_merge_table(spark):
    old = [("same", "a", False), ("same_decided", "a", True), ("new_text", "a", False), ("new_text_decided", "a", True), ("gone", "a", False), ("gone_decided", "a", True)]
    new = [("same", "a"), ("same_decided", "a"), ("new_text", "b"), ("new_text_decided", "b"), ("fresh", "a")]
    o, n = spark.createDataFrame(old, "id string, text string, decided boolean"), spark.createDataFrame(new, "id string, text string")
    got = {r.id: (r.action, r.decision_survived, r.noted) for r in merging.plan(o, n, ["id"], ["text"]).collect()}
    assert got == {
        "same": ("kept", False, False), "same_decided": ("kept", True, False), "new_text": ("changed", False, False), "new_text_decided": ("changed", False, True),
        "gone": ("removed", False, False), "gone_decided": ("kept_without_source", True, True), "fresh": ("added", False, False),
    }
    state = {r.id: (r.text, r.decided) for r in merging.next_state(o, n, ["id"], ["text"]).collect()}
    assert state == {"same": ("a", False), "same_decided": ("a", True), "new_text": ("b", False), "new_text_decided": ("b", False), "gone_decided": ("a", True), "fresh": ("a", False)}
    again = merging.counters(merging.plan(o, o.drop("decided"), ["id"], ["text"])).first()
    assert (again.kept, again.added, again.changed, again.removed, again.status) == (6, 0, 0, 0, "VERIFYING")


def test_metrics(spark):
    cells = [("POSITIVE", "CANDIDATE")] * 3 + [("NEGATIVE", "CANDIDATE")] + [("POSITIVE", None)] + [("NEGATIVE", "NEGATIVE_VERIFIED")] * 5
    labels = spark.createDataFrame([(*c, "m", "p") for c in cells], "label string, engine_status string, modality string, param string")
    r = metrics.rated(metrics.confusion(labels)).first()
    assert (r.precision, r.recall, r.f1, r.fpr, r.passes) == (0.75, 0.75, 0.75, 1 / 6, False)
    assert r.precision_lo < 0.75 < r.precision_hi <= 1
    empty = metrics.rated(metrics.confusion(labels.limit(0))).first()
    assert empty.precision is None and empty.passes is None
    levels = {(x.level, x.key): x.tp for x in metrics.grouped(labels, "modality", "param").collect()}
    assert levels == {("overall", None): 3, ("modality", "m"): 3, ("param", "p"): 3}
