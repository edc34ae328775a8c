"""File registries: fuzzy headers, row checks with collected errors, and the registry's own scans."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the registry format.
REQUIRED = ("object_id", "file_name", "doc_stage")
STAGES = ("PD", "RD", "ID")
APPROVALS = ("DRAFT", "APPROVED", "FOR_CONSTRUCTION", "SUPERSEDED", "CANCELLED")
DELIMITERS = (",", ";", "\t")


def canonical(header: Column) -> Column:
    """Lower case, no-break spaces and runs of separators as one underscore."""
    return F.regexp_replace(F.trim(F.translate(F.lower(header), "\u00a0\ufeff", " ")), r"[\s_-]+", "_")


def parsed_date(value: Column) -> Column:
    """Date in one of three notations; null if blank or unreadable."""
    return F.coalesce(*[F.try_to_date(F.trim(value), f) for f in ("yyyy-M-d", "d.M.yyyy", "d/M/yyyy")])


def blank(value: Column) -> Column:
    return F.coalesce(F.trim(value), F.lit("")) == ""


def with_aliases(rows: DataFrame, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """`rows` with known headers renamed; the first column of a name wins."""
    aliases = ALIASES if aliases is None else aliases
    found: dict[str, str] = {}
    for c in rows.columns:
        name = "_".join(c.replace("\u00a0", " ").replace("\ufeff", "").strip().lower().replace("-", " ").replace("_", " ").split())
        found.setdefault(aliases.get(name, name), c)
    return rows.select(*[F.col(f"`{c}`").alias(name) for name, c in found.items()])


def missing_columns(rows: DataFrame) -> list[str]:
    """Required columns that the header lacks; no row is read if there are any."""
    return [c for c in REQUIRED if c not in rows.columns]


def parse(rows: DataFrame) -> DataFrame:
    """row_number, object_id, file_name, doc_stage, approval_status, approval_date, errors (array of codes), kept.

    rows: row_number (from 2) and all-string columns. A bad date is an error of
    a row that is kept; any other error drops the row.
    """
    stage = F.upper(F.trim("doc_stage"))
    status = F.when(blank(F.col("approval_status")), "DRAFT").otherwise(F.upper(F.trim("approval_status")))
    day = parsed_date(F.col("approval_date"))
    fatal = [F.when(blank(F.col(c)), f"EMPTY_{c.upper()}") for c in REQUIRED]
    fatal.append(F.when(~blank(F.col("doc_stage")) & ~stage.isin(*STAGES), "UNKNOWN_STAGE"))
    fatal.append(F.when(~status.isin(*APPROVALS), "UNKNOWN_APPROVAL"))
    bad_date = F.when(~blank(F.col("approval_date")) & day.isNull(), "BAD_DATE")
    return rows.select(
        "row_number", F.trim("object_id").alias("object_id"), F.trim("file_name").alias("file_name"), stage.alias("doc_stage"),
        status.alias("approval_status"), day.alias("approval_date"), F.array_compact(F.array(*fatal, bad_date)).alias("errors"),
        (F.size(F.array_compact(F.array(*fatal))) == 0).alias("kept"),
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """A registry of any kind that is read, by its name; workbooks are refused, since no library reads them here."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind in ("xlsx", "xls"):
        raise ValueError(f"{path}: a workbook; save it as CSV or JSON")
    return read_json(spark, path) if kind == "json" else read_csv(spark, path)


#: Other headings of the registry's columns.
ALIASES = {
    "object": "object_id", "file": "file_name", "filename": "file_name", "name": "file_name", "stage": "doc_stage", "code": "document_code", "status": "approval_status", "date": "approval_date",
    "predecessor": "predecessor_id", "sha": "sha256", "hash": "sha256",
}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A registry as strings; the delimiter is the one that its first line holds most."""
    first = spark.read.text(path).limit(1).first()
    line = first[0] if first else ""
    delimiter = max(DELIMITERS, key=line.count)
    return spark.read.csv(path, header=True, sep=delimiter, inferSchema=False, encoding="UTF-8")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A registry of a JSON array of objects, or of an object whose `files` is one; keys may differ from row to row."""
    whole = spark.read.text(path, wholetext=True).select("value")
    kind = "array<map<string,string>>"
    rows = F.coalesce(F.from_json("value", kind), F.from_json(F.get_json_object("value", "$.files"), kind))
    entries = whole.select(F.posexplode(rows).alias("at", "entry"))
    # The header is the union of all rows' keys, in the order in which they are first seen.
    seen = entries.select("at", F.posexplode(F.map_keys("entry")).alias("place", "k")).groupBy("k").agg(F.min(F.struct("at", "place")).alias("first"))
    keys = [r["k"] for r in seen.orderBy("first").collect()]
    return entries.select((F.col("at") + 2).alias("row_number"), *[F.try_element_at("entry", F.lit(k)).alias(k) for k in keys])
