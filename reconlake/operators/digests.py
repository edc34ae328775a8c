"""One SHA-256 over a set's sorted ids, whatever the set's size.

Ids are sorted in ranges, all ranges at a time, and packed into chunks of a few
kilobytes; a set's chunks then pass through one hash in their order. That last
step can't be divided, since a SHA-256 depends on all that came before, but it
holds no more than a batch of chunks, and its sort is one of whole chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 4096  # bytes


def _packer(chunk: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sorted ids (k, id) as chunks: ids behind newlines."""
        at, key, rows = TaskContext.get().partitionId() << 33, None, []
        text = bytearray()

        def flush() -> None:
            nonlocal at, text
            if text:
                rows.append((key, at, bytes(text)))
                at, text = at + 1, bytearray()

        for batch in batches:
            for k, i in zip(batch["k"], batch["id"]):
                if k != key or len(text) >= chunk:
                    flush()
                    key = k
                text += b"\n" + i.encode()
            if rows:
                yield pd.DataFrame(rows, columns=["k", "at", "chunk"])
                rows = []
        flush()
        if rows:
            yield pd.DataFrame(rows, columns=["k", "at", "chunk"])

    return pack


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chunks in order, a key's together, as one hash of each key; the first newline isn't part of it."""
    key, state = None, None
    for batch in batches:
        out = []
        for k, chunk in zip(batch["k"], batch["chunk"]):
            if k != key:
                if state:
                    out.append((key, state.hexdigest()))
                key, state, chunk = k, hashlib.sha256(), chunk[1:]
            state.update(chunk)
        if out:
            yield pd.DataFrame(out, columns=["k", "digest"])
    if state:
        yield pd.DataFrame([(key, state.hexdigest())], columns=["k", "digest"])


def of_sets(rows: DataFrame, id_column: str, *keys: str, chunk: int = CHUNK) -> DataFrame:
    """keys, n (rows), digest: SHA-256 of each set's ids, sorted as strings and joined by newlines; null ids count as rows only. Without keys there is one set, empty or not."""
    k = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit("")
    own = rows.select(*keys, k.alias("k"), F.col(id_column).cast("string").alias("id"))
    sets = own.groupBy(*keys, "k").agg(F.count(F.lit(1)).alias("n")) if keys else own.agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.lit(""))
    ordered = own.where("id is not null").select("k", "id").repartitionByRange("k", "id").sortWithinPartitions("k", "id")
    chunks = ordered.mapInPandas(_packer(chunk), "k string, at bigint, chunk binary")
    digests = chunks.repartition("k").sortWithinPartitions("k", "at").mapInPandas(_hashed, "k string, digest string")
    return sets.join(digests, "k", "left").select(*keys, "n", F.coalesce("digest", F.sha2(F.lit("").cast("binary"), 256)).alias("digest"))
