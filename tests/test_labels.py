"""Labels in lines against looking for each by itself, and values that are texts."""

import functools
import random
import re

import pytest
from pyspark.sql import functions as F

from reconlake.operators import labels, matrix

WORDS = "площадь застройки объём этаж в1/т3 % № класс eI общая высота пола мм² а б-в площади подвал ёмкость".split()


@functools.cache
def compiled(label):
    body = r"[\s,;:()]*".join(re.escape(w).replace("е", "[её]") for w in label.split(" "))
    return re.compile(rf"\b{body}\b", re.IGNORECASE)


def brute(text, wanted):
    """By code: the first variant that stands in the text, and the rest behind it."""
    out = {}
    for code, _, label in sorted(wanted):
        m = compiled(label).search(text)
        if m and code not in out:
            out[code] = (label, text[m.end() :])
    return out


def norm(text):
    return " ".join(re.sub(r"[«»\"'.,:;()\[\]–—\-]+", " ", text.lower().replace("ё", "е")).split())


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(5)
    names = [norm(" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 3)))) for _ in range(3000)]
    wanted = sorted({(f"M-{rng.randint(0, 1200):04}", rng.randint(0, 3), n) for n in names if n})
    joints = [" ", ", ", ": ", "", "  (", "-", "/", "; "]
    lines = ["".join(rng.choice([w, w.upper(), w.title(), f"{w}{rng.randint(0, 9)}"]) + rng.choice(joints) for w in rng.choices(WORDS, k=rng.randint(1, 7))) for _ in range(400)]
    return wanted, [*lines, "", "12,5", None, "ПЛОЩАДЬ"]


@pytest.mark.parametrize("most", [100_000, 700])
def test_thousands_of_labels(spark, planted, most):
    wanted, lines = planted
    df = spark.createDataFrame(list(enumerate(lines)), "line long, text string").repartition(3)
    more = [(None, 0, "площадь"), ("M-x", 0, ""), ("M-y", 0, None)]
    found = labels.search(df, spark.createDataFrame([*wanted, *wanted[:50], *more], "code string, ord int, label string"), most=most)
    got = sorted((r.line, r.code, r.label, r.rest) for r in found.collect())
    first = {}
    for code, order, label in wanted:
        first[code, label] = min(order, first.get((code, label), 9))
    once = [(code, order, label) for (code, label), order in first.items()]
    want = sorted((i, code, *v) for i, text in enumerate(lines) if text for code, v in brute(text, once).items())
    assert got == want and len(want) > 1000


def test_no_labels_and_no_lines(spark):
    none = spark.createDataFrame([], "code string, ord int, label string")
    lines = spark.createDataFrame([(1, "a")], "line long, text string")
    assert labels.search(lines, none).count() == 0
    assert labels.search(lines.limit(0), spark.createDataFrame([("c", 0, "a")], none.schema)).count() == 0


def test_normalized_keeps_signs_that_name_things(spark):
    got = spark.range(1).select(*[labels.normalized(F.lit(t)).alias(f"c{i}") for i, t in enumerate(["Ёмкость «В1/Т3», № 5 — 100 %;", "S, м² (общ.)", " .,- "])]).first()
    assert tuple(got) == ("емкость в1/т3 № 5 100 %", "s м² общ", "")


def test_text_values_in_row_column_and_conflicts(spark):
    rows = [
        (1, 1, "Степень огнестойкости: II ", 0.1, 0.1), (1, 2, "Класс", 0.1, 0.3), (1, 3, " C0 ", 0.5, 0.305), (1, 4, "В3", 0.4, 0.5), (1, 5, "Высота", 0.1, 0.7), (1, 6, "нет числа", 0.4, 0.7), (1, 7, "12 м", 0.6, 0.7),
        (2, 1, "степень огнестойкости — ii", 0.1, 0.1), (2, 2, "Класс", 0.1, 0.3), (2, 3, "с1", 0.2, 0.32), (2, 4, "Класс", 0.1, 0.9), (2, 5, " ", 0.2, 0.9),
    ]
    lines = spark.createDataFrame([(*r, r[3] + 0.2, r[4] + 0.01) for r in rows], "page long, line long, text string, x0 double, y0 double, x1 double, y1 double")
    wanted = spark.createDataFrame([("f", "степень огнестойкости", None, "enum"), ("k", "класс", None, "string"), ("h", "высота", "м", "number")], "code string, label string, unit string, data_type string")
    found = matrix.locate(lines, wanted)
    got = {(r.page, r.code, r.line): (r.method, r.raw, r.value, r.text, r.value_line) for r in found.collect()}
    assert got == {
        (1, "f", 1): ("same_line", "II", None, "II", 1), (1, "k", 2): ("same_row", "C0", None, "C0", 3), (1, "h", 5): ("same_row", "12 м", 12.0, None, 7),
        (2, "f", 1): ("same_line", "ii", None, "ii", 1), (2, "k", 2): ("next_line", "с1", None, "с1", 3),
    }
    sides = matrix.resolve_side(found.withColumn("ord", F.col("page") * 10 + F.col("line")), "code")
    said = {r.code: (r.n_values, r.text, r.shown) for r in sides.collect()}
    assert said["f"] == (1, "II", "ii") and said["k"] == (2, None, "c0; с1") and said["h"] == (1, None, "12.0")
