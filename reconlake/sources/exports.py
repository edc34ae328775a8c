"""What leaves the engine: XML protocols, transfer payloads with their hash, JSON lines of a release.

A protocol or payload is one row that holds the findings of one process, whose
number is bounded by one document package; processes are grouped in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that XML reserves, the ampersand first.
RESERVED = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))


def escaped(value: Column) -> Column:
    out = value.cast("string")
    for raw, reference in RESERVED:
        out = F.replace(out, F.lit(raw), F.lit(reference))
    return out


def element(name: str, value: Column) -> Column:
    """<name>value</name>; an empty element if the value is null."""
    return F.coalesce(F.concat(F.lit(f"<{name}>"), escaped(value), F.lit(f"</{name}>")), F.lit(f"<{name}/>"))


def attribute(name: str, value: Column) -> Column:
    """ name="value", or nothing if the value is null."""
    return F.coalesce(F.concat(F.lit(f' {name}="'), escaped(value), F.lit('"')), F.lit(""))


def _in_order(rows: Column, by: str) -> Column:
    return F.array_sort(F.collect_list(F.struct(F.col(by), rows.alias("row"))))


def protocols(checks: DataFrame, key: str, bucket: Column, buckets: tuple[str, ...], attributes: tuple[str, ...], elements: tuple[str, ...]) -> DataFrame:
    """key, xml: one document of each key, with a section for each of `buckets`, its findings in the order of check_id."""
    opening = F.concat(F.lit("<finding"), attribute("id", F.col("check_id")), *[attribute(a, F.col(a)) for a in attributes], F.lit(">"))
    finding = F.concat(opening, *[element(e, F.col(e)) for e in elements], F.lit("</finding>"))
    rows = checks.select(key, "check_id", bucket.alias("__bucket"), finding.alias("__xml"))
    found = rows.groupBy(key).agg(_in_order(F.struct("__bucket", "__xml"), "check_id").alias("__all"))

    def section(name: str) -> Column:
        own = F.transform(F.filter("__all", lambda x: x["row"]["__bucket"] == name), lambda x: x["row"]["__xml"])
        return F.concat(F.lit(f"<{name}>"), F.array_join(own, ""), F.lit(f"</{name}>"))

    whole = F.concat(F.lit("<protocol"), attribute("id", F.col(key)), F.lit(">"), *map(section, buckets), F.lit("</protocol>"))
    return found.select(key, whole.alias("xml"))


def payloads(checks: DataFrame, key: str, fields: tuple[str, ...], status: str = "CONFIRMED_VIOLATION") -> DataFrame:
    """key, payload, payload_hash: the findings of one status of each key as JSON, nulls included; keys without any have none."""
    found = checks.where(F.col("status") == status).groupBy(key).agg(_in_order(F.struct(*fields), "check_id").alias("__all"))
    body = F.struct(F.col(key), F.transform("__all", lambda x: x["row"]).alias("findings"))
    return found.select(key, F.to_json(body, {"ignoreNullFields": "false"}).alias("payload")).withColumn("payload_hash", F.sha2("payload", 256))


def lines(rows: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """key, line: each row as a JSON object, nulls included; `.select("line").write.text` makes JSON lines of it."""
    return rows.select(key, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("line"))
