"""Logs of decisions against taking their events one at a time; merging by unit on odd rows."""

import random

import pytest

from reconlake.operators import decisions, units

CHECKS = "check_id long, process_id long, parent_id long, status string, engine_status string, verified_by long, split_at long, unit string, events string"
EVENTS = "event_id long, at long, check_id long, kind string, decision string, reason_code string, comment string, user_id long"
STATES = ("CANDIDATE", "CLARIFICATION_REQUIRED", "SUSPICION", "NEGATIVE_VERIFIED", "CONFIRMED_VIOLATION", None)


def one_at_a_time(checks, events, protocols, processes):
    state = {c[0]: {"process": c[1], "parent": c[2], "status": c[3], "engine": c[4], "by": c[5], "split": c[6]} for c in checks}
    proto = {p: s for p, _, s in sorted(protocols)}
    work, log = dict(processes), []

    def seen(c):
        return c["split"] is None if c["parent"] is None else state.get(c["parent"], {}).get("split") is not None

    def refusal(e, c):
        if e["kind"] == "verdict" and e["decision"] == "NEGATIVE_VERIFIED" and not (e["reason_code"] and (e["comment"] or "").strip()):
            return "REJECTION_REQUIRES_REASON"
        if c is None:
            return "FINDING_NOT_FOUND"
        composite = any(x["parent"] == e["check_id"] for x in state.values())
        if e["kind"] == "split" and not composite:
            return "NOT_A_COMPOSITE"
        if e["kind"] == "split" and c["split"] is not None:
            return "ALREADY_SPLIT"
        if e["kind"] == "promote" and c["status"] != "SUSPICION":
            return "NOT_A_SUSPICION"
        if c["process"] not in proto:
            return "PROTOCOL_NOT_FOUND"
        if proto[c["process"]] == "PROTOCOL_FINALIZED":
            return "PROTOCOL_FINALIZED"
        if e["kind"] != "verdict":
            return None
        if composite and c["split"] is None:
            return "COMPOSITE_NOT_SPLIT"
        if c["parent"] is not None and not seen(c):
            return "NOT_A_CANDIDATE"
        return None if c["status"] in ("CANDIDATE", "CLARIFICATION_REQUIRED") or c["by"] is not None else "NOT_A_CANDIDATE"

    for row in sorted(events, key=lambda r: (r[1], r[0])):
        e = dict(zip([c.split()[0] for c in EVENTS.split(", ")], row))
        c = state.get(e["check_id"])
        why = refusal(e, c)
        if c is None:
            log.append((e["event_id"], why, None, None, None))
            continue
        p = c["process"]
        if why is None and e["kind"] == "split":
            c["split"] = e["at"]
        elif why is None:
            c["engine"] = c["engine"] or c["status"]
            c["status"], c["by"] = (e["decision"], e["user_id"]) if e["kind"] == "verdict" else ("CANDIDATE", c["by"])
        open_ = sum(x["process"] == p and x["status"] == "CANDIDATE" and seen(x) for x in state.values())
        if why is None and e["kind"] == "verdict":
            proto[p], work[p] = ("VERIFYING", "VERIFYING") if open_ else ("VERIFICATION_COMPLETED", "COMPLETED")
        elif why is None and e["kind"] == "promote":
            proto[p] = "VERIFYING" if proto[p] == "VERIFICATION_COMPLETED" else proto[p]
            work[p] = "VERIFYING" if work.get(p) == "COMPLETED" else work.get(p)
        log.append((e["event_id"], why, open_, proto.get(p), work.get(p)))
    return log, state


def planted(seed):
    rng = random.Random(seed)
    checks = []
    for p in range(12):
        for top in range(rng.randint(1, 3)):
            k = p * 100 + top * 10
            split = rng.choice([None, None, None, 0])
            atoms = rng.randint(0, 3)
            checks.append((k, p, None, rng.choice(STATES), rng.choice([None, None, "CANDIDATE"]), rng.choice([None, None, 4]), split if atoms else None, "x", "y"))
            checks += [(k + a + 1, p, k, rng.choice(STATES), None, rng.choice([None, None, None, 5]), None, "x", "y") for a in range(atoms)]
    checks.append((5000, 3, 4999, "CANDIDATE", None, None, None, "x", "y"))  # its composite is gone
    ids = [c[0] for c in checks] + [9999]
    events = []
    for i in range(260):
        kind = rng.choice(["verdict", "verdict", "verdict", "split", "promote"])
        events.append((i, rng.randint(0, 30), rng.choice(ids), kind, rng.choice(decisions.VERDICTS) if kind == "verdict" else None, rng.choice(["R1", "R1", None, ""]), rng.choice(["why", "why", " ", None]), rng.randint(1, 9)))
    protocols = [(p, v, rng.choice(["READY", "VERIFYING", "VERIFICATION_COMPLETED"]) if p % 5 else "PROTOCOL_FINALIZED") for p in range(11) for v in (1, 2)]
    return checks, events, protocols, [(p, rng.choice(["VERIFYING", "COMPLETED"])) for p in range(12)]


@pytest.mark.parametrize("seed", range(3))
def test_any_interleaving(spark, seed):
    checks, events, protocols, processes = planted(seed)
    log, state = one_at_a_time(checks, events, protocols, processes)
    c, e = spark.createDataFrame(checks, CHECKS).repartition(3), spark.createDataFrame(events, EVENTS).repartition(3)
    p, w = spark.createDataFrame(protocols, "process_id long, version int, status string"), spark.createDataFrame(processes, "process_id long, status string")
    folded = decisions.folded(c, e, p)
    assert sorted((r.event_id, r.refused) for r in folded.collect()) == sorted((x[0], x[1]) for x in log)
    got = {r.event_id: (r.refused, r.pending, r.protocol_status, r.process_status) for r in decisions.protocol_log(c, folded, p, w).collect()}
    assert got == {x[0]: x[1:] for x in log if x[2] is not None}
    after = decisions.applied(c, decisions.refusal(c, e, p).where("refused is null"))
    assert {r.check_id: (r.status, r.engine_status, r.verified_by, r.split_at) for r in after.collect()} == {k: (s["status"], s["engine"], s["by"], s["split"]) for k, s in state.items()}


def test_nothing_decided_and_nothing_there(spark):
    checks, events, protocols, _ = planted(0)
    c, e = spark.createDataFrame(checks, CHECKS), spark.createDataFrame(events, EVENTS)
    p = spark.createDataFrame(protocols, "process_id long, version int, status string")
    assert decisions.refusal(c, e.limit(0), p).count() == 0
    lost = decisions.refusal(c.limit(0), e, p.limit(0)).groupBy("refused").count().collect()
    assert {r.refused for r in lost} == {"FINDING_NOT_FOUND", "REJECTION_REQUIRES_REASON"}
    assert decisions.applied(c.limit(0), decisions.refusal(c, e, p)).count() == 0


FRAGMENT = "file_id long, page long, x0 string, y0 string, x1 string, y1 string"
UNITS = f"check_id long, process_id long, group_id string, parent_id long, status string, engine_status string, expected string, actual string, delta string, completeness string, verified_by long, split_at long, fragments array<struct<{FRAGMENT.replace(' ', ':').replace(',:', ',')}>>, content string"


def check(k, group, parent=None, status="CANDIDATE", by=None, expected="1", fragments=((1, 1),), process=1):
    return (k, process, group, parent, status, None, expected, None, None, "COMPLETE", by, None, None if fragments is None else [(f, p, "0.1", "0.2", "0.3", "0.4") for f, p in fragments], "z")


def test_units_merge_whole(spark):
    old = [
        check(1, "same", fragments=((1, 1), (2, 1))), check(2, "moved", fragments=((1, 1),)), check(3, "gone"), check(4, "gone but decided", by=7), check(5, "changed but decided", by=7),
        check(10, "composite"), check(11, "a", 10), check(12, "b", 10, by=7), check(20, "atom changed"), check(21, "a", 20), check(30, "no fragments", fragments=None), check(40, None), check(51, "lost atom", 50),
        check(60, "nulls swap", expected=None), check(70, "else", process=2),
    ]
    new = [
        check(101, "same", fragments=((2, 1), (1, 1), (1, 1))), check(102, "moved", fragments=((1, 2),)), check(105, "changed but decided", expected="2"), check(110, "composite"), check(112, "b", 110), check(111, "a", 110),
        check(120, "atom changed"), check(121, "a", 120, expected="2"), check(130, "no fragments", fragments=()), check(160, "nulls swap", expected="null"), check(180, "fresh"), check(170, "else", process=2),
    ]
    got = units.plan(units.units(spark.createDataFrame(old, UNITS), True), units.units(spark.createDataFrame(new, UNITS), False))
    assert {r.group_id: (r.action, r.decision_survived, r.noted, r.deleted) for r in got.collect()} == {
        "same": ("kept", False, False, []), "moved": ("changed", False, False, [2]), "gone": ("removed", False, False, [3]), "gone but decided": ("kept_without_source", True, True, []),
        "changed but decided": ("changed", False, True, [5]), "composite": ("kept", True, False, []), "atom changed": ("changed", False, False, [20, 21]), "no fragments": ("kept", False, False, []),
        "nulls swap": ("changed", False, False, [60]), "fresh": ("added", False, False, []), "else": ("kept", False, False, []),
    }
    empty = spark.createDataFrame([], UNITS)
    assert units.plan(units.units(empty, True), units.units(empty, False)).count() == 0
