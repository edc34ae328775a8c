"""Writing tables and taking files in: replaced partitions, absent rows only, decided rows kept, changes of fields, uploads, caches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Accepted types with the first bytes of their content (hex), and which of them are registries.
MAGIC = {"application/pdf": "25504446", "image/png": "89504E47", "image/tiff": "49492A00", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "504B0304"}
REGISTRIES = ("text/csv", "application/json", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet")


def replace_partitions(rows: DataFrame, path: str, key: str) -> None:
    """Writes rows so that what lay under their values of `key` before is gone, and all else stays: pages of a file, checks of a process."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def absent(incoming: DataFrame, stored: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows to append: of keys that the store lacks, the first of each by `order`."""
    fresh = incoming.join(stored.select(*keys).distinct(), list(keys), "left_anti")
    return fresh.groupBy(*keys).agg(F.min_by(F.struct(*fresh.columns), order).alias("r")).select("r.*")


def insert_absent(incoming: DataFrame, stored: DataFrame, path: str, keys: Sequence[str], order: str) -> None:
    absent(incoming, stored, keys, order).write.mode("append").parquet(path)


def upserted(old: DataFrame, new: DataFrame, finalized: DataFrame) -> DataFrame:
    """Hypotheses (process_id, group_id, status, verified_by) after a run: decided ones stay, others are replaced, added or gone; processes that are finalized keep all they have."""
    keys = ["process_id", "group_id"]
    closed = finalized.select("process_id").distinct()
    frozen = old.join(closed, "process_id", "left_semi")
    open_old, open_new = old.join(closed, "process_id", "left_anti"), new.join(closed, "process_id", "left_anti")
    decided = open_old.where("verified_by is not null")
    rest = open_new.join(decided.select(*keys), keys, "left_anti")
    columns = [*keys, "status", "verified_by"]
    return frozen.select(*columns).union(decided.select(*columns)).union(rest.select(*columns))


def changed(state: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """`state` after changes (key, order, fields; null: not touched): of each field the last value that was set."""
    fields = [c for c in changes.columns if c not in (key, order)]
    last = changes.groupBy(key).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(f"__{c}") for c in fields])
    joined = state.join(last, key, "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in fields else F.col(c) for c in state.columns])


def cached(files: DataFrame, cache: DataFrame, version: str, schema: str) -> DataFrame:
    """`files` (file_hash, …) with outcome (hit, miss, corrupt) and parsed: a file's entry of this parser version; one that can't be read counts as none."""
    own = cache.where(F.col("version") == version).select("file_hash", F.col("content").alias("__content"))
    parsed = F.from_json("__content", schema)
    first = schema.split()[0]
    good = F.col(f"__parsed.{first}").isNotNull()
    joined = files.join(own, "file_hash", "left").withColumn("__parsed", parsed)
    outcome = F.when(F.col("__content").isNull(), "miss").when(good, "hit").otherwise("corrupt")
    return joined.select(*files.columns, outcome.alias("outcome"), F.when(good, F.col("__parsed")).alias("parsed"))


def decoded(payloads: DataFrame, column: str = "base64") -> DataFrame:
    """`payloads` with content in place of its base64 text; null where that is none."""
    return payloads.withColumn("content", F.try_to_binary(F.col(column), F.lit("base64"))).drop(column)


def validated(uploads: DataFrame, most_bytes: int) -> DataFrame:
    """`uploads` (batch_id, arrival, mime, size, head: first bytes) with refused: null, or why a file isn't taken.

    Registries can't be told right from wrong by what they say, so only the
    first of a batch is considered; the others are refused whatever they are.
    """
    registry = F.col("mime").isin(*REGISTRIES)
    firsts = uploads.where(registry).groupBy("batch_id").agg(F.min("arrival").alias("__first"))
    magic = F.lit(None).cast("string")
    for mime, raw in MAGIC.items():
        magic = F.when(F.col("mime") == mime, raw).otherwise(magic)
    known = registry | F.col("mime").isin(*MAGIC)
    torn = (F.col("size") == 0) | F.coalesce(~F.hex("head").startswith(magic), F.lit(False))
    why = (
        F.when(~known, "UNSUPPORTED_FORMAT").when(registry & (F.col("arrival") > F.col("__first")), "MULTIPLE_MANIFESTS")
        .when(F.col("size") > most_bytes, "FILE_TOO_LARGE").when(torn, "CORRUPTED_FILE")
    )
    # One row for each batch that holds a registry.
    return uploads.join(firsts, "batch_id", "left").withColumn("refused", why).drop("__first")


def audit(path: str, rows: DataFrame) -> None:
    """Appends entries (user_id, action, object_id, details) with their time; entries are never changed."""
    rows.select("user_id", "action", "object_id", "details", F.current_timestamp().alias("at")).write.mode("append").parquet(path)


def publish(tasks: DataFrame, folder: str, *fields: str) -> None:
    """Lays tasks as JSON lines into the folder that the task stream reads."""
    tasks.select(F.to_json(F.struct(*fields)).alias("value")).write.mode("append").text(folder)


def ordered_lines(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """Lines (page_id, block_no, line_no, text, …) of pages (page_id, file_id, page_no) in reading order."""
    return pages.join(blocks, "page_id").orderBy("file_id", "page_no", "block_no", "line_no")


def registry_files(entries: DataFrame, files: DataFrame) -> DataFrame:
    """entries (entry_id, file_name, predecessor_name) with file_id and predecessor_id: the last file (arrival) of each name; names without a file give null."""
    last = files.groupBy("file_name").agg(F.max_by("file_id", "arrival").alias("file_id"))
    own = entries.join(last, "file_name", "left")
    before = last.select(F.col("file_name").alias("predecessor_name"), F.col("file_id").alias("predecessor_id"))
    # Most entries name no predecessor; they don't meet on a null.
    named = own.where("predecessor_name is not null").join(before, "predecessor_name", "left")
    rest = own.where("predecessor_name is null").withColumn("predecessor_id", F.lit(None).cast("bigint"))
    return named.select(*rest.columns).unionByName(rest)


def expected_counts(entries: DataFrame, stages: Sequence[str] = ("PD", "RD", "ID")) -> DataFrame:
    """object_id and the registry rows of each stage; objects whose registry has no row have none."""
    return entries.groupBy("object_id").agg(*[F.count_if(F.col("stage") == s).alias(s.lower()) for s in stages])


def is_registry_row(stage: Column, file_hash: Column, registry_hash: Column) -> Column:
    return stage.isNull() & F.coalesce(file_hash == registry_hash, F.lit(False))


def completeness_struct(pd: Column, rd: Column, id_: Column) -> Column:
    """struct<pd,rd,id> of a process's stages, unknown ones as not applicable."""
    return F.struct(*[F.coalesce(c, F.lit("NOT_APPLICABLE")).alias(n) for n, c in (("pd", pd), ("rd", rd), ("id", id_))])
