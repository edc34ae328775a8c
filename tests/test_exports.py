"""Exports: escaping, null fields, order and empty tables."""

import hashlib
import json
import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from reconlake.sources import exports

SCHEMA = "process_id long, check_id long, status string, note string"
ROWS = [(1, 12, "open", 'a<b> & "c"'), (1, 11, "done", None), (1, 13, None, ""), (2, 21, "open", "'x'"), (None, 31, "done", "y")]


def test_xml_parses_back(spark):
    checks = spark.createDataFrame(ROWS, SCHEMA)
    got = {r.process_id: ET.fromstring(r.xml) for r in exports.protocols(checks, "process_id", F.col("status"), ("open", "done"), ("note",), ("note",)).collect()}
    assert set(got) == {1, 2, None}
    first = got[1].find("open/finding")
    assert first.attrib == {"id": "12", "note": 'a<b> & "c"'} and first.find("note").text == 'a<b> & "c"'
    assert got[1].find("done/finding").attrib == {"id": "11"} and got[1].find("done/finding/note").text is None
    assert "id" not in got[None].attrib and len(got[2].find("done")) == 0
    assert exports.protocols(checks.limit(0), "process_id", F.col("status"), ("open",), (), ()).count() == 0


def test_payload_holds_one_status_and_its_hash(spark):
    checks = spark.createDataFrame([*ROWS, (1, 10, "open", None)], SCHEMA)
    got = {r.process_id: r for r in exports.payloads(checks, "process_id", ("check_id", "note"), "open").collect()}
    assert set(got) == {1, 2}
    assert json.loads(got[1].payload)["findings"] == [{"check_id": 10, "note": None}, {"check_id": 12, "note": 'a<b> & "c"'}]
    assert got[1].payload_hash == hashlib.sha256(got[1].payload.encode()).hexdigest()


def test_lines_read_back(spark):
    got = {r.check_id: json.loads(r.line) for r in exports.lines(spark.createDataFrame(ROWS, SCHEMA), "check_id", ("check_id", "note")).collect()}
    assert got[11] == {"check_id": 11, "note": None} and got[12]["note"] == 'a<b> & "c"' and len(got) == len(ROWS)
