"""Token ids in training order, as fixed-stride binary shards.

Texts become byte-level BPE ids, cut into sequences of at most `length` ids
with an end mark after each document. Sequences are numbered from 0 to N - 1 in
the order of (doc_id, text, part), whatever files or partitions the documents
come in, and a keyed Feistel network over the next power of four, walked until
it is back below N, sends each number to a slot of its own: a permutation that
needs no sort of the slots, no random state and no list of what has been drawn.
Slot s lies in shard s // `per_shard` at byte (s % `per_shard`) * stride, so a
reader that knows only the next slot goes on from there.

The texts are shuffled once, into ranges of ids, which numbers them, and their
tokens once, into ranges of shards. Both have as many partitions as
PARTITION_BYTES asks for, so a task is as large at any size of the input; a
repeated id is split by its texts and rows. What comes to the driver for the
numbering is one count for each partition. Slots are spread evenly whatever
the sources or copies are like. A shard is at most per_shard * length ids.

`write_files` lays the shards down as files of bare ids with a manifest in
Parquet, and `read_slots` reads any run of slots from the files by seeking.

Nulls and odd rows: a null or empty text has no sequence. A null id stays null
and comes first in the numbering; rows of one id follow the hash of their
texts. Repeated rows have sequences of their own, and which of them is which
makes no difference. An empty table gives no shards. Other columns of the input
are left out.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reconlake.llm.tokens import VOCABULARY, encoder, vocabulary
from reconlake.plans.lineage import written

LENGTH, PER_SHARD = 512, 256
ROUNDS = 6
PARTITION_BYTES = 16 << 20  # of text, and of token ids, that a task reads; 256 MB suit inputs of many terabytes
ROW_BITS = 33  # of monotonically_increasing_id that count the rows of a partition

SHARDS = (
    "shard long, first_slot long, n_sequences int, length int, id_bytes int, doc_ids array<bigint>, "
    "parts array<int>, lengths array<int>, content binary"
)


def id_type(n_ids: int) -> np.dtype:
    return np.dtype("<u2" if n_ids <= 1 << 16 else "<u4")


def permuted(index: np.ndarray, n: int, key: str, undo: bool = False) -> np.ndarray:
    """The keyed permutation of range(n), for each of `index`."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask, width = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [
        np.uint64(int.from_bytes(hashlib.sha256(f"{key}:{r}".encode()).digest()[:8], "big")) for r in range(ROUNDS)
    ]
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):  # under four steps on average, since the domain is below 4 * n
        left, right = out[todo] >> width, out[todo] & mask
        for k in reversed(keys) if undo else keys:
            x = (left if undo else right) + k  # fixed values: the finaliser of splitmix64
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x = (x ^ (x >> np.uint64(31))) & mask
            left, right = (right ^ x, left) if undo else (right, left ^ x)
        out[todo] = (left << width) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def _sequences(sent, length: int):
    def sequences(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(sent)
        kind = id_type(enc.size + 1)
        for texts in batches:
            out = []
            for t in texts:
                ids = np.append(enc.encode(t), enc.size).astype(kind) if t else np.empty(0, kind)
                out.append([ids[i : i + length].tobytes() for i in range(0, len(ids), length)])
            yield pd.Series(out)

    return F.pandas_udf(sequences, "array<binary>").asNondeterministic()  # so that no rewrite of the plan runs it twice


def _partitions(n_bytes: int) -> int:
    return max(1, -(-n_bytes // PARTITION_BYTES))


def tokenised(docs: DataFrame, length: int = LENGTH, text: str = "text", doc_id: str = "doc_id", vocab: str = VOCABULARY) -> DataFrame:
    """doc_id, part, ids (little-endian) and at of every sequence, written to the shared folder.

    at: number of the partition, shifted by ROW_BITS, and row in it; in the
    order of `at`, sequences are sorted by document.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    keyed = docs.where(F.octet_length(text) > 0).select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text)).alias("h"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text")
    )
    ordered = keyed.repartitionByRange(_partitions(size), "doc_id", "h", "row").sortWithinPartitions("doc_id", "h", "row")
    cut = _sequences(vocabulary(docs.sparkSession, vocab), length)(F.col("text"))
    each = ordered.select("doc_id", F.posexplode(cut).alias("part", "ids"))
    return written(each.withColumn("at", F.monotonically_increasing_id()), "tokens")


def _slots(sent, n: int, key: str):
    def slots(at: pd.Series) -> pd.Series:
        x = at.to_numpy()
        return pd.Series(permuted(sent.value[x >> ROW_BITS] + (x & ((1 << ROW_BITS) - 1)), n, key))

    return F.pandas_udf(slots, "bigint")


def slotted(sequences: DataFrame, key: str) -> tuple[DataFrame, int]:
    """`sequences` with the column slot in place of `at`, and their number."""
    counts = sequences.groupBy(F.shiftright("at", ROW_BITS).alias("p")).count().collect()  # one row for each partition
    before = np.zeros(max((r["p"] for r in counts), default=0) + 2, np.int64)
    for r in counts:
        before[r["p"] + 1] = r["count"]
    before = before.cumsum()
    sent = sequences.sparkSession.sparkContext.broadcast(before)
    n = int(before[-1])
    return sequences.withColumn("slot", _slots(sent, n, key)("at")).drop("at"), n


def _shard(length: int, per_shard: int, wide: int, pad: int):
    kind = np.dtype(f"<u{wide}")

    def shard(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("slot")
        content = np.full((len(rows), length), pad, kind)
        lengths = []
        for i, raw in enumerate(rows["ids"]):
            ids = np.frombuffer(raw, kind)
            content[i, : len(ids)] = ids
            lengths.append(len(ids))
        first = int(rows["slot"].iloc[0])
        ids = [None if pd.isna(x) else int(x) for x in rows["doc_id"]]
        fields = (first // per_shard, first, len(rows), length, wide, ids, rows["part"].tolist(), lengths, content.tobytes())
        return pd.DataFrame([fields], columns=[x.split()[0] for x in SHARDS.split(", ")])

    return shard


def shards(
    docs: DataFrame, key: str, length: int = LENGTH, per_shard: int = PER_SHARD, text: str = "text", doc_id: str = "doc_id", vocab: str = VOCABULARY
) -> DataFrame:
    """The shards (SHARDS) of the documents' tokens; ids behind a sequence's end are the end mark."""
    sent = vocabulary(docs.sparkSession, vocab)
    size = sum(1 for line in sent.value[1].splitlines() if line)
    wide = id_type(size + 1).itemsize
    slots, n_sequences = slotted(tokenised(docs, length, text, doc_id, vocab), key)
    n = min(_partitions(n_sequences * length * wide), max(1, -(-n_sequences // per_shard)))
    # Ids go through pandas as text, which keeps all 64 bits beside nulls.
    sharded = slots.select(F.floor(F.col("slot") / per_shard).alias("shard"), "slot", F.col("doc_id").cast("string"), "part", "ids")
    return sharded.repartitionByRange(n, "shard").groupBy("shard").applyInPandas(_shard(length, per_shard, wide, size), SHARDS)


MANIFEST = SHARDS.replace("content binary", "file string, stride int")


def _store(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The store and path of a folder, given as a path or as a URI."""
    return pyarrow.fs.FileSystem.from_uri(folder) if ":" in folder else (pyarrow.fs.LocalFileSystem(), folder)


def write_files(made: DataFrame, folder: str) -> DataFrame:
    """Writes shards as files of bare ids below `folder`, which all tasks must share, and returns their manifest (MANIFEST), written beside them.

    A file is written under a name of its own and then moved to its place, so
    a task that is repeated only replaces its files by equal ones.
    """
    columns = [x.split()[0] for x in MANIFEST.split(", ")]

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = _store(folder)
        store.create_dir(path, recursive=True)
        for b in batches:
            b["file"] = [f"shard-{s:012d}.bin" for s in b["shard"]]
            b["stride"] = b["length"] * b["id_bytes"]
            for name, content in zip(b["file"], b["content"]):
                draft = f"{path}/.{uuid.uuid4().hex}"
                with store.open_output_stream(draft) as out:
                    out.write(content)
                store.move(draft, f"{path}/{name}")
            yield b[columns]

    made.mapInPandas(write, MANIFEST).write.mode("overwrite").parquet(f"{folder}/_manifest")
    return read_manifest(made.sparkSession, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


def read_slots(folder: str, per_shard: int, stride: int, first_slot: int, n: int) -> Iterator[bytes]:
    """The `stride` bytes of each of n slots from first_slot on, up to the last: what a trainer that resumes at a slot reads, in order."""
    store, path = _store(folder)
    while n > 0:
        name = f"{path}/shard-{first_slot // per_shard:012d}.bin"
        if store.get_file_info(name).type == pyarrow.fs.FileType.NotFound:
            return
        with store.open_input_file(name) as f:
            f.seek(first_slot % per_shard * stride)
            raw = f.read(min(n, per_shard - first_slot % per_shard) * stride)
        yield from (raw[i : i + stride] for i in range(0, len(raw), stride))
        first_slot, n = first_slot // per_shard * per_shard + per_shard, n - per_shard + first_slot % per_shard


def read_from(written_shards: DataFrame, first_slot: int, n: int) -> DataFrame:
    """slot, doc_id, part and ids of n slots from first_slot on; only their shards are read."""
    s = F.col("slot")
    wide = F.col("id_bytes") * F.col("length")
    near = written_shards.where((F.col("first_slot") < first_slot + n) & (F.col("first_slot") + F.col("n_sequences") > first_slot))
    at = (s - F.col("first_slot")).cast("int")
    each = near.withColumn("slot", F.explode(F.sequence("first_slot", F.col("first_slot") + F.col("n_sequences") - 1)))
    return each.where(s.between(first_slot, first_slot + n - 1)).select(
        "slot", F.col("doc_ids")[at].alias("doc_id"), F.col("parts")[at].alias("part"),
        F.substring(F.col("content"), at * wide + 1, F.col("lengths")[at] * F.col("id_bytes")).alias("ids"),
    )
