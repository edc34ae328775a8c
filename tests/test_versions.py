"""Versions of tables that change together, and merges as changes of them."""

import pytest
from pyspark.sql import functions as F

from reconlake.operators import units
from reconlake.sources import versions


def ids(df):
    return sorted(r.id for r in df.collect())


def test_a_killed_write_leaves_the_old_version(spark, tmp_path):
    folder = str(tmp_path / "state")
    with pytest.raises(FileNotFoundError):
        versions.read(spark, folder, "checks")
    a, b = spark.range(3), spark.range(10, 12)
    assert versions.commit(spark, folder, {"checks": [a, b], "protocols": [b]}) == 1
    assert ids(versions.read(spark, folder, "checks")) == [0, 1, 2, 10, 11]
    broken = spark.range(4).select(F.when(F.col("id") > 2, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        versions.commit(spark, folder, {"checks": [a], "protocols": [broken]})
    assert versions.current(spark, folder) == 1 and ids(versions.read(spark, folder, "checks")) == [0, 1, 2, 10, 11] and ids(versions.read(spark, folder, "protocols")) == [10, 11]
    assert versions.commit(spark, folder, {"checks": [versions.read(spark, folder, "checks").where("id > 1")]}) == 2
    assert ids(versions.read(spark, folder, "checks")) == [2, 10, 11] and ids(versions.read(spark, folder, "protocols")) == [10, 11]
    assert ids(versions.read(spark, folder, "checks", 1)) == [0, 1, 2, 10, 11]


def test_the_second_of_two_writers_is_refused(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "state")
    versions.commit(spark, folder, {"checks": [spark.range(1)]})
    versions.commit(spark, folder, {"checks": [spark.range(2)]}, based_on=1)
    with pytest.raises(versions.Conflict):
        versions.commit(spark, folder, {"checks": [spark.range(3)]}, based_on=1)
    monkeypatch.setattr(versions, "current", lambda *_: 1)  # as if it had looked before the other committed
    with pytest.raises(versions.Conflict):
        versions.commit(spark, folder, {"checks": [spark.range(3)]}, based_on=1)
    monkeypatch.undo()
    assert ids(versions.read(spark, folder, "checks")) == [0, 1]
    versions.commit(spark, folder, {"checks": [spark.range(5)]})
    versions.prune(spark, folder, keep=1)
    assert versions.current(spark, folder) == 3 and ids(versions.read(spark, folder, "checks")) == [0, 1, 2, 3, 4] and len(list((tmp_path / "state").glob("checks-*"))) == 1
    with pytest.raises(Exception):
        versions.read(spark, folder, "checks", 1).count()


CHECKS = "check_id long, process_id long, group_id string, parent_id long, status string, engine_status string, expected string, actual string, delta string, completeness string, verified_by long, split_at long, fragments array<struct<file_id:long>>, rationale string"


def check(k, group, parent=None, by=None, split=None, expected="1", why=None, status="CANDIDATE"):
    return (k, 1, group, parent, status, None, expected, None, None, "COMPLETE", by, split, [(1,)], why)


def test_merged_checks_tell_what_became_of_decisions(spark):
    old = [check(1, "same", by=7, why="w"), check(2, "gone", why="w"), check(3, "lost", by=7, why="w"), check(4, "changed", why="w"), check(5, "redecided", by=8, status=None), check(10, "composite", split=3), check(11, "a", 10, by=7, status="CONFIRMED_VIOLATION"), check(12, "b", 10)]
    new = [check(101, "same"), check(104, "changed", expected="2", why="v"), check(105, "redecided", expected="2"), check(110, "composite", why="v"), check(111, "a", 110), check(113, "c", 110), check(120, "fresh")]
    a, b = spark.createDataFrame(old, CHECKS), spark.createDataFrame(new, CHECKS)
    planned = units.plan(units.units(a, True), units.units(b, False))
    after = units.after_merge(a, b, planned, spark.createDataFrame([(7, "Ada")], "user_id long, name string"))
    first, last = units.CHANGED_NOTE
    assert after.columns == a.columns
    assert {r.check_id: r.rationale for r in after.collect()} == {
        1: "w", 3: f"w\n\n{units.REMOVED_NOTE}", 104: "v", 105: f"{first}None, 8{last}", 110: f"v\n\n{first}CANDIDATE, {units.SOMEONE}; CONFIRMED_VIOLATION, Ada{last}", 111: None, 113: None, 120: None,
    }
    protocols = spark.createDataFrame([(1, 1, "SUPERSEDED"), (1, 2, "VERIFYING"), (2, 1, "READY")], "process_id long, version int, status string")
    assert sorted(map(tuple, units.reissued(protocols, planned).collect())) == [(1, 1, "SUPERSEDED"), (1, 2, "SUPERSEDED"), (1, 3, "VERIFYING"), (2, 1, "READY")]
    assert units.after_merge(a.limit(0), b.limit(0), planned.limit(0), spark.createDataFrame([], "user_id long, name string")).count() == 0
