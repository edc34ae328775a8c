"""The read side of protocols: findings as they are shown, their evidence, lists and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reconlake.functions import texts
from reconlake.operators import views
from reconlake.plans.guards import small


def finding_rows(checks: DataFrame, params: DataFrame, users: DataFrame) -> DataFrame:
    """check_id, title, unit, norm_reference, decided_by, atoms of checks (check_id, parent_id, code, subject, verified_by).

    params: code, parameter_name, unit, sp_reference, gost_reference; users: user_id, name.
    """
    atoms = checks.where("parent_id is not null").groupBy(F.col("parent_id").alias("check_id")).agg(F.array_sort(F.collect_list("check_id")).alias("atoms"))
    # Undecided checks have nobody to look up and never share a key.
    decided = checks.where("verified_by is not null").select("check_id", F.col("verified_by").alias("user_id")).join(users.select("user_id", "name"), "user_id")
    joined = checks.join(small(params), "code", "left").join(decided.select("check_id", F.col("name").alias("decided_by")), "check_id", "left").join(atoms, "check_id", "left")
    return joined.select(
        "check_id", texts.finding_title(F.col("parameter_name"), F.col("code"), F.col("subject")).alias("title"), "unit",
        texts.norm_reference(F.col("sp_reference"), F.col("gost_reference")).alias("norm_reference"), "decided_by", "atoms",
    )


def with_page_quality(fragments: DataFrame, pages: DataFrame) -> DataFrame:
    """`fragments` (file_id, page) with needs_ocr and quality of their pages; null for pages that aren't known."""
    return fragments.join(pages.select("file_id", "page", "needs_ocr", "quality"), ["file_id", "page"], "left")


def stages_of(fragments: DataFrame, key: str) -> DataFrame:
    """key, stages: the different stages behind each check's evidence, in the order of `ord`."""
    ordered = fragments.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "stage"))).alias("x"))
    return ordered.select(key, F.array_distinct(F.transform("x", lambda f: f["stage"])).alias("stages"))


def lacking_evidence(checks: DataFrame, fragments: DataFrame) -> DataFrame:
    """check_id, expected, actual (counts) of findings without evidence of one of both roles."""
    found = checks.where("status is not null").join(fragments.select("check_id", "role"), "check_id", "left")
    counts = found.groupBy("check_id").agg(F.count_if(F.col("role") == "expected").alias("expected"), F.count_if(F.col("role") == "actual").alias("actual"))
    return counts.where((F.col("expected") == 0) | (F.col("actual") == 0))


def suspicions(protocols: DataFrame, checks: DataFrame, limit: int = 200) -> DataFrame:
    """The newest suspicions of the latest protocol of each object (object_id, process_id, version); checks: check_id, process_id, status, created_at."""
    last = views.latest(protocols.select("object_id", "process_id", "version"), "object_id", "version", "process_id")
    found = checks.where("status = 'SUSPICION'").join(last.select("object_id", "process_id"), "process_id")
    return found.orderBy(F.desc("created_at"), F.desc("check_id")).limit(limit)


def newest(rows: DataFrame, at: str, key: str, limit: int = 50) -> DataFrame:
    return rows.orderBy(F.desc(at), F.desc(key)).limit(limit)


def unread(notifications: DataFrame, user_id: int, limit: int = 50) -> DataFrame:
    """The newest unread notifications of a user, each with the number of all unread ones."""
    mine = notifications.where((F.col("user_id") == user_id) & F.col("read_at").isNull())
    total = mine.agg(F.count(F.lit(1)).alias("n")).scalar()
    return newest(mine, "created_at", "notification_id", limit).withColumn("unread", total)


def by_status(checks: DataFrame, status: str | None = None) -> DataFrame:
    """Findings of one status, or all findings."""
    return checks.where(F.col("status").isNotNull() if status is None else F.col("status") == status)


def params(rows: DataFrame, section: str | None = None, priority: str | None = None, active: bool | None = None) -> DataFrame:
    """Parameters by optional conditions, in the order of their codes."""
    wanted = {"section": section, "priority": priority, "active": active}
    for c, v in wanted.items():
        rows = rows if v is None else rows.where(F.col(c) == v)
    return rows.orderBy("code")


def in_range(labels: DataFrame, at: str, first: Column | None = None, last: Column | None = None, **equal: str | None) -> DataFrame:
    """Labels created in a closed range, and with given values of other columns."""
    rows = labels if first is None else labels.where(F.col(at) >= first)
    rows = rows if last is None else rows.where(F.col(at) <= last)
    for c, v in equal.items():
        rows = rows if v is None else rows.where(F.col(c) == v)
    return rows


def tabs(checks: DataFrame, *keys: str, priority: str | None = None) -> DataFrame:
    """keys, tab, n: how many findings each tab of a protocol holds; suspicions, completeness rows and findings by status."""
    shown = checks if priority is None else checks.where(F.col("priority") == priority)
    tab = F.when(F.col("status").isNull(), "completeness").when(F.col("status") == "SUSPICION", "suspicions").otherwise(F.lower("status"))
    return shown.groupBy(*keys, tab.alias("tab")).agg(F.count(F.lit(1)).alias("n"))


def sizes(objects: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """key, files, pages, bytes, pd, rd, id: what each object holds; zeros for those without files (key, stage, pages, bytes)."""
    counts = files.groupBy(key).agg(
        F.count(F.lit(1)).alias("files"), F.sum("pages").alias("pages"), F.sum("bytes").alias("bytes"), *[F.count_if(F.col("stage") == s).alias(s.lower()) for s in ("PD", "RD", "ID")]
    )
    return objects.select(key).join(counts, key, "left").fillna(0)


def progress(files: DataFrame, key: str) -> DataFrame:
    """key and counts of files by kind and of pages by OCR state (files: key, mime, parsed, pages, ocr_done, ocr_failed, ocr_pending)."""
    pdf = F.col("mime") == "application/pdf"
    return files.groupBy(key).agg(
        F.count(F.lit(1)).alias("files_total"), F.count_if(pdf).alias("files_pdf"), F.count_if(pdf & F.col("parsed")).alias("files_parsed"), F.sum("pages").alias("pages_total"),
        F.sum("ocr_done").alias("ocr_done"), F.sum("ocr_failed").alias("ocr_failed"), F.sum("ocr_pending").alias("ocr_pending"),
        (F.sum("ocr_done") + F.sum("ocr_failed") + F.sum("ocr_pending")).alias("ocr_needed"),
    )


def verification(checks: DataFrame, *keys: str) -> DataFrame:
    """keys, confirmed, rejected: what people decided so far."""
    by_person = F.col("verified_by").isNotNull()
    return checks.groupBy(*keys).agg(
        F.count_if(by_person & (F.col("status") == "CONFIRMED_VIOLATION")).alias("confirmed"), F.count_if(by_person & (F.col("status") == "NEGATIVE_VERIFIED")).alias("rejected")
    )


def search(protocols: DataFrame, objects: DataFrame, text: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """One page of protocols (protocol_id, object_id, created_at) whose object's name (object_id, name) holds the text in any case, newest first, each with the number of all of them."""
    found = protocols.join(objects.where(F.contains(F.lower("name"), F.lit(text.lower()))).select("object_id", "name"), "object_id")
    total = found.agg(F.count(F.lit(1)).alias("n")).scalar()
    return views.page(found, [F.desc("created_at"), F.desc("protocol_id")], limit, offset).withColumn("total", total)


def with_names(rows: DataFrame, users: DataFrame, by: str = "verified_by") -> DataFrame:
    """`rows` with the name of the user in `by`; rows without one keep null and meet nobody."""
    named = rows.where(F.col(by).isNotNull()).join(users.select(F.col("user_id").alias(by), F.col("name").alias("user_name")), by, "left")
    return named.select(*rows.columns, "user_name").unionByName(rows.where(F.col(by).isNull()).withColumn("user_name", F.lit(None).cast("string")))
