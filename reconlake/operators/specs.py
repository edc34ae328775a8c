"""The rule matrix itself: reading it, label variants and hints, and what a row of a workbook says."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reconlake.operators import labels as label_search
from reconlake.operators import matrix

SPEC = (
    "code string, section string, parameter_name string, unit string, data_type string, modality string, review_priority string, active boolean, "
    "compare_op string, compare_threshold double, min_value double, max_value double, source_pd string, source_rd string, source_id string, "
    "sp_reference string, gost_reference string, trigger_logic string"
)
FIELDS = tuple(x.split()[0] for x in SPEC.split(", "))
#: Modalities, and words by which units and sources are told apart.
MODALITIES = ("scalar_text", "doc_presence", "drawing_entity", "drawing_measure")
ENUM_UNIT_WORDS = ("Класс", "Марка", "Буква", "Степень", "Кат.")
TABLE_WORDS = ("таблиц", "тэп", "ведомост", "спецификац", "экспликац", "общие данные", "общие указания", "текст", "расчет", "баланс")
DRAWING_UNITS = ("м", "мм", "мм²", "м²")
#: Fixed patterns of normative references.
SP, GOST, FZ = r"(?U)СП\s+\d+(?:\.\d+)+", r"(?U)ГОСТ(?:\s+Р)?\s+\d+(?:\.\d+)+(?:-\d+)?", r"(?U)\d+-ФЗ"
NONE = ("", "-", "—", "–", "нет")


class BadMatrix(ValueError):
    """What a rule matrix lacks."""


def from_rows(spark: SparkSession, rows: list[dict], expected: int | None = None) -> DataFrame:
    """A rule matrix (SPEC) of parsed rows, checked: every code once, known modalities, the stated number of rules."""
    codes = [r.get("code") for r in rows]
    if any(not c for c in codes) or len(set(codes)) < len(codes):
        raise BadMatrix("a code is missing or repeated")
    if unknown := {r.get("modality") for r in rows} - set(MODALITIES):
        raise BadMatrix(f"unknown modality {sorted(map(str, unknown))}")
    if expected is not None and len(rows) != expected:
        raise BadMatrix(f"{len(rows)} rules where {expected} are stated")
    of = {"double": float, "boolean": bool, "string": str}
    kinds = [of[x.split()[1]] for x in SPEC.split(", ")]
    values = [tuple(None if r.get(n) is None else k(r[n]) for n, k in zip(FIELDS, kinds)) for r in rows]
    return spark.createDataFrame(values, SPEC)


def load(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """A rule matrix from a YAML or JSON file: a list of rules, or a mapping whose `params` is one. A matrix has hundreds of rows at most."""
    return from_rows(spark, _parsed(spark, path, "params") or [], expected)


def load_synonyms(spark: SparkSession, path: str) -> DataFrame:
    """code, synonyms: a mapping of codes to lists; no rows if there is no such file."""
    try:
        found = _parsed(spark, path, "synonyms") or {}
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = {}
    return spark.createDataFrame([(str(k), [str(x) for x in v or []]) for k, v in found.items()], "code string, synonyms array<string>")


def _parsed(spark: SparkSession, path: str, key: str):
    text = spark.read.text(path, wholetext=True).first()[0]
    if path.endswith(".json"):
        whole = json.loads(text)
    else:
        import yaml  # only where a matrix is written in it

        whole = yaml.safe_load(text)
    return whole[key] if isinstance(whole, dict) and key in whole else whole


def data_type(unit: Column) -> Column:
    words = F.lit(False)
    for w in ENUM_UNIT_WORDS:
        words = words | F.contains(unit, F.lit(w))
    return F.when(unit == "Коорд.", "coordinate").when(unit.isin("—", "RAL / Артикул"), "string").when((unit == "Статус") | words, "enum").otherwise("number")


def modality(unit: Column, kind: Column, source_pd: Column, source_rd: Column) -> Column:
    sources = F.lower(F.concat_ws(" ", source_pd, source_rd))
    table = F.lit(False)
    for w in TABLE_WORDS:
        table = table | F.contains(sources, F.lit(w))
    return (
        F.when(unit == "Статус", "doc_presence").when(kind == "coordinate", "drawing_measure").when((kind == "string") & (unit == "—"), "drawing_entity")
        .when(table, "scalar_text").when(unit.isin(*DRAWING_UNITS), "drawing_measure").otherwise("scalar_text")
    )


def references(pattern: str, *texts: Column) -> Column:
    """The references in the texts, each once in its order, joined by `; `; null if there are none."""
    found = F.flatten(F.array(*[F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(pattern), F.lit(0)) for t in texts]))
    return F.nullif(F.array_join(F.array_distinct(found), "; "), F.lit(""))


def section_code(raw: Column) -> Column:
    """What follows `Раздел N.`, or the whole text."""
    trimmed = F.trim(raw)
    return F.coalesce(F.nullif(F.trim(F.regexp_extract(trimmed, r"^(?U)Раздел\s+\d+\.\s*(.+)$", 1)), F.lit("")), trimmed)


def cleaned(text: Column) -> Column:
    """Runs of white space as one space; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), F.lit(""))


def from_workbook(rows: DataFrame) -> DataFrame:
    """Rules (SPEC without priority) of a workbook's rows of strings: section, code, name, unit, source_pd, source_rd, source_id, logic, norms; rows without a code are skipped."""
    r = rows.select(*[cleaned(F.col(c)).alias(c) for c in ("section", "code", "name", "unit", "source_pd", "source_rd", "source_id", "logic", "norms")]).where("code is not null")
    kind = data_type(F.col("unit"))
    rule = matrix.derive_rule(F.coalesce("logic", F.lit("")), F.coalesce("unit", F.lit("")))
    return r.select(
        "code", section_code(F.col("section")).alias("section"), F.col("name").alias("parameter_name"), "unit", kind.alias("data_type"),
        modality(F.col("unit"), kind, F.col("source_pd"), F.col("source_rd")).alias("modality"), "source_pd", "source_rd", "source_id",
        references(SP, F.col("norms")).alias("sp_reference"), references(GOST, F.col("norms")).alias("gost_reference"),
        references(FZ, F.col("norms")).alias("fz_reference"), F.col("logic").alias("trigger_logic"), rule.alias("r"),
    ).select("*", F.col("r.op").alias("compare_op"), F.col("r.threshold").alias("compare_threshold"), "r.min_value", "r.max_value").drop("r")


#: Fixed patterns: alternatives between spaced slashes, abbreviations in brackets, and what a source says of disciplines.
SLASH, ACRONYM = r"(?U)(\S+)\s+/\s+(\S+)", r"\(([A-ZА-ЯЁ]{1,6})\)"
HINT = r"(?U)[（(]([A-ZА-ЯЁ0-9/]{2,8})[）)]|Раздел\s+([А-ЯЁ]{2,8})"


def slash_variants(name: Column) -> Column:
    """The name with each of two alternatives, or as it is."""
    at = F.regexp_instr(name, F.lit(SLASH))
    whole = F.regexp_extract(name, SLASH, 0)
    before, after = F.substr(name, F.lit(1), at - 1), F.substr(name, at + F.length(whole), F.length(name))
    either = [F.concat(before, F.regexp_extract(name, SLASH, i), after) for i in (1, 2)]
    return F.when(at > 0, F.array(*either)).otherwise(F.array(name))


def acronym_variants(name: Column) -> Column:
    """The name, and for each abbreviation in it the abbreviation and the name without it."""
    found = F.regexp_extract_all(name, F.lit(ACRONYM), F.lit(1))
    more = F.transform(found, lambda a: F.array(a, F.trim(F.replace(name, F.concat(F.lit("("), a, F.lit(")")), F.lit("")))))
    return F.concat(F.array(name), F.flatten(more))


def label_variants(name: Column, synonyms: Column) -> Column:
    """Every normalized phrase that is the parameter's label, each once, in order."""
    own = F.flatten(F.transform(slash_variants(name), acronym_variants))
    every = F.concat(own, F.coalesce(synonyms, F.array().cast("array<string>")))
    return F.array_distinct(F.filter(F.transform(every, label_search.normalized), lambda x: x != ""))


def discipline_hints(source: Column) -> Column:
    """Disciplines that a source's text names, in brackets or as a section."""
    text = F.coalesce(source, F.lit(""))
    in_brackets, as_section = (F.regexp_extract_all(text, F.lit(HINT), F.lit(i)) for i in (1, 2))
    found = F.zip_with(in_brackets, as_section, lambda a, b: F.split(F.when(a != "", a).otherwise(b), "/"))
    return F.array_distinct(F.flatten(found))


def labels(specs: DataFrame, synonyms: DataFrame) -> DataFrame:
    """code, label, unit, data_type, hints for matrix.locate: one row for each variant of each rule's label, `ord` in its order."""
    joined = specs.join(synonyms, "code", "left")
    hints = F.array_union(discipline_hints(F.col("source_pd")), discipline_hints(F.col("source_rd")))
    return joined.select("code", "unit", "data_type", hints.alias("hints"), F.posexplode(label_variants(F.col("parameter_name"), F.col("synonyms"))).alias("ord", "label"))
