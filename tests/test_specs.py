"""Reading rule matrices and registries, and what they refuse."""

import json

import pytest
from pyspark.sql import functions as F

from reconlake.operators import matrix, registry, specs
from reconlake.sources import sinks

RULES = [
    {"code": "M-001", "parameter_name": "Площадь (ПЛ)", "unit": "м2", "data_type": "number", "modality": "scalar_text", "source_pd": "Том (АР)"},
    {"code": "M-002", "parameter_name": "Класс", "unit": "—", "data_type": "string", "modality": "drawing_entity"},
]


def test_matrix_files(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "m.json").write_text(json.dumps({"params": RULES}))
    (tmp_path / "m.yaml").write_text("params:\n- {code: M-001, modality: scalar_text, unit: м2, parameter_name: Площадь}\n")
    assert [r.code for r in specs.load(spark, str(tmp_path / "m.json"), 2).orderBy("code").collect()] == ["M-001", "M-002"]
    assert specs.load(spark, str(tmp_path / "m.yaml")).first().unit == "м2"
    for bad, n in (([RULES[0], RULES[0]], None), ([{"code": "x", "modality": "odd"}], None), (RULES, 3), ([{"modality": "scalar_text"}], None)):
        with pytest.raises(specs.BadMatrix):
            specs.from_rows(spark, bad, n)
    (tmp_path / "s.json").write_text(json.dumps({"M-001": ["S общая"]}))
    assert specs.load_synonyms(spark, str(tmp_path / "s.json")).first().synonyms == ["S общая"]
    assert specs.load_synonyms(spark, str(tmp_path / "none.yaml")).count() == 0


def test_labels_are_located_with_their_confidence(spark):
    synonyms = spark.createDataFrame([("M-001", ["S общая"])], "code string, synonyms array<string>")
    wanted = specs.labels(specs.from_rows(spark, RULES), synonyms).where("code = 'M-001'")
    lines = [
        (1, 0, "Площадь, м2: 1 520,4 м2", "АР", 0.1, 0.1), (1, 1, "S общая 12 м2 и еще много слов", "КР", 0.1, 0.2), (1, 2, "площадь", "КР", 0.1, 0.3), (1, 3, "77", "КР", 0.1, 0.315),
    ]
    df = spark.createDataFrame([(p, n, t, d, x, y, x + 0.2, y + 0.01) for p, n, t, d, x, y in lines], "page long, line long, text string, discipline string, x0 double, y0 double, x1 double, y1 double")
    got = {r.line: (r.method, r.value, round(r.confidence, 2)) for r in matrix.locate(df, wanted).collect()}
    assert got[0] == ("same_line", 1520.4, 1.0) and got[1] == ("same_line", 12.0, 0.9) and got[2] == ("next_line", 77.0, 0.6)


def test_registries_of_each_kind(spark, tmp_path):
    (tmp_path / "r.csv").write_text("Object;File Name;Stage\n1;a.pdf;PD\n", encoding="utf-8-sig")
    (tmp_path / "r.json").write_text(json.dumps({"files": [{"object_id": "1", "zeta": "z"}, {"file_name": "a", "alpha": "q", "object_id": "2"}]}))
    assert registry.with_aliases(registry.read(spark, str(tmp_path / "r.csv"))).columns == ["object_id", "file_name", "doc_stage"]
    assert registry.read(spark, str(tmp_path / "r.json")).columns == ["row_number", "object_id", "zeta", "file_name", "alpha"]
    with pytest.raises(ValueError, match="workbook"):
        registry.read(spark, str(tmp_path / "r.xlsx"))


def test_sinks_on_folders(spark, tmp_path):
    tasks = spark.createDataFrame([("process.start", 7)], "type string, process_id long")
    sinks.publish(tasks, str(tmp_path / "tasks"), "type", "process_id")
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "tasks")).collect()] == [{"type": "process.start", "process_id": 7}]
    entries = spark.createDataFrame([(1, "VERDICT", 5, "{}")], "user_id long, action string, object_id long, details string")
    for _ in range(2):
        sinks.audit(str(tmp_path / "audit"), entries)
    assert spark.read.parquet(str(tmp_path / "audit")).where(F.col("at").isNotNull()).count() == 2
    assert sinks.decoded(spark.createDataFrame([("aGk=",), ("?",)], "base64 string")).where("content is null").count() == 1
    blocks = spark.createDataFrame([(1, 0, 1, "b"), (1, 0, 0, "a")], "page_id long, block_no long, line_no long, text string")
    pages = spark.createDataFrame([(1, 9, 1)], "page_id long, file_id long, page_no long")
    assert [r.text for r in sinks.ordered_lines(pages, blocks).collect()] == ["a", "b"]
