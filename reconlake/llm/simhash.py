"""SimHash near-duplicates by tiled exact comparison.

A fingerprint's bit is set if it is set in over half of the hashes of a text's
shingles. Equal fingerprints are one node from the start. The distinct ones are
ordered by their population counts (or by the texts' sizes, if texts of very
different size shan't link) and cut into tiles of TILE fingerprints. A pair of
tiles is skipped if the population counts of their blocks of bits differ by
more than the radius, since no pair of fingerprints in it can then be within
the radius; within a pair of tiles, rows are held against the window of rows
whose population count is near enough. What is left is compared exactly, by
exclusive-or and bit counts of whole arrays.

A pair of tiles returns a spanning forest of the links that it finds, never the
links themselves: fewer links than it has rows, however large a group of
copies. The forests' components are the components of all links.

Only tiles (8 or 32 bytes a fingerprint) are shuffled, each to the pairs that
aren't skipped: a pair makes some 1,000 comparisons (256 for wide fingerprints)
for each byte that is shuffled. The work is a pair of tiles at a time, so memory is bounded by two
tiles; the number of comparisons grows with the square of the number of
distinct fingerprints, times the part that isn't skipped. What is broadcast is
the bounds of the tiles, 50 bytes for each TILE fingerprints (60 MB for 20
billion), never a fingerprint.

Where a ratio is given, a text is a set of shingles and links are confirmed.
Sets of a similarity of at least the ratio have sizes of at least that ratio,
so ordering tiles by size and skipping by it loses no link; population counts
within the wide radius of candidates would skip next to nothing.
The radius then only finds candidates: the shingles of the texts in a candidate
component meet (a component of over BATCH shingles in parts of about BATCH,
each pair of parts by itself), and of the pairs within the radius those that
would join two trees are linked if their exact Jaccard similarity is at least
the ratio. What is shuffled for one component grows with the square of its
parts; small components share a batch.

Nulls and odd rows: a null or wordless text has fingerprint zero and links like
any other; a text of fewer words than a shingle is one shingle. Rows of equal
text or equal id each get their row. A component's id is its least doc_id,
null if it has none. Other columns of the input are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from reconlake.llm.components import components
from reconlake.llm.text import utf8
from reconlake.plans.lineage import written

SEED = 42
TILE = 16384
BLOCKS = 4  # of bits, whose population counts bound the distance of two tiles
ROWS = 128  # compared at a time with a window of the other tile
FIRST = 3  # words of a fingerprint that are compared for all pairs; 192 bits of unrelated texts differ in 96, with a deviation of 7
PAIRS, MAX_TASKS = 4, 100_000  # pairs of tiles in a task, and tasks
CHUNK = 1 << 14  # hashes whose bits are counted at a time
RADIUS = 72  # of 256 bits, for candidates of a similarity of 0.8
BATCH = 1 << 21  # shingles of 8 bytes that are confirmed together

PRINT = StructType([StructField("fp", BinaryType()), StructField("size", IntegerType())])


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 of the space-joined runs of k words, repeats included."""
    if not words:
        return np.empty(0, np.uint64)
    k = min(k, len(words))
    buffer, n = b" ".join(words), len(words) - k + 1
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(buffer[a:z], SEED) for a, z in zip(starts[:n].tolist(), ends[k - 1 :].tolist())), np.uint64, n)


def spread(h: np.ndarray, words: int) -> np.ndarray:
    """`words` 64-bit numbers for each hash, the first the hash itself."""
    out = np.empty((len(h), words), np.uint64)
    out[:, 0] = h
    for j in range(1, words):  # fixed values: the finaliser of splitmix64
        x = h + np.uint64((0x9E3779B97F4A7C15 * j) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, j] = x ^ (x >> np.uint64(31))
    return out


def fingerprint(h: np.ndarray, bits: int) -> bytes:
    """Big-endian fingerprint of a text's shingle hashes."""
    counts = np.zeros(bits, np.int64)
    for i in range(0, len(h), CHUNK):
        x = spread(h[i : i + CHUNK], bits // 64).astype(">u8").view(np.uint8)
        counts += np.unpackbits(x.reshape(-1, bits // 8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * counts > len(h)).tobytes()


def _prints(k: int, bits: int, repeats: bool):
    def prints(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            h = shingle_hashes(utf8(t).lower().split(), k)
            h = h if repeats else np.unique(h)
            rows.append((fingerprint(h, bits), max(1, len(h))))
        return pd.DataFrame(rows, columns=PRINT.names)

    return F.pandas_udf(prints, PRINT).asNondeterministic()  # so that no rewrite of the plan runs it twice


def printed(text: Column, shingle: int, bits: int, repeats: bool) -> Column:
    """struct(fp binary, size int): fingerprint and number of shingles, each counted once unless `repeats`."""
    return _prints(shingle, bits, repeats)(text)


def _sets(k: int):
    """UDF: the different hashes of a text's shingles in ascending order, 8 bytes each."""

    def sets(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(utf8(t).lower().split(), k)).tobytes() for t in texts])

    return F.pandas_udf(sets, BinaryType()).asNondeterministic()


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Similarity of two ascending arrays without repeats; 1 if both are empty."""
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common) if len(both) else 1.0


def _block_counts(fp: Column, bits: int) -> list[Column]:
    """Population counts of the blocks of a fingerprint."""
    part = bits // 8 // BLOCKS

    def of(first: int) -> Column:
        pairs = [F.bit_count(F.conv(F.hex(F.substring(fp, i, 2)), 16, 10).cast("int")) for i in range(first, first + part, 2)]
        return reduce(lambda a, b: a + b, pairs)

    return [of(1 + j * part) for j in range(BLOCKS)]


def _as_words(raw: bytes, words: int) -> np.ndarray:
    return np.frombuffer(raw, ">u8").astype(np.uint64).reshape(-1, words)


def _tiler(tile: int, width: int):
    """Packs the ordered rows of a partition into tiles."""

    def rows_of(fps: list[bytes], sizes: list[int], number: int) -> pd.DataFrame:
        raw = b"".join(fps)
        blocks = np.bitwise_count(np.frombuffer(raw, np.uint8).reshape(len(fps), BLOCKS, -1)).sum(2, dtype=np.int32)
        low = [*blocks.min(0).tolist(), min(sizes)]
        high = [*blocks.max(0).tolist(), max(sizes)]
        packed = np.array(sizes, ">i4").tobytes()
        return pd.DataFrame({"tile": [number], "low": [low], "high": [high], "fps": [raw], "sizes": [packed]})

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 24
        fps: list[bytes] = []
        sizes: list[int] = []
        for b in batches:
            fps += b["fp"].tolist()
            sizes += b["size"].tolist()
            while len(fps) >= 2 * tile:
                yield rows_of(fps[:tile], sizes[:tile], number)
                fps, sizes, number = fps[tile:], sizes[tile:], number + 1
        if fps:
            yield rows_of(fps, sizes, number)

    return pack


def _partners(sent, radius: int, ratio: float):
    """UDF: the tiles that a tile must be compared with, itself included."""

    def partners(low: pd.Series, high: pd.Series) -> pd.Series:
        ids, lows, highs = sent.value
        out = []
        for lo, hi in zip(low, high):
            lo, hi = np.asarray(lo), np.asarray(hi)
            gaps = np.maximum(0, np.maximum(lows - hi, lo - highs))[:, :BLOCKS].sum(1)
            near = (gaps <= radius) & (lows[:, BLOCKS] * ratio <= hi[BLOCKS]) & (lo[BLOCKS] * ratio <= highs[:, BLOCKS])
            out.append(ids[near].tolist())
        return pd.Series(out)

    return F.pandas_udf(partners, "array<bigint>")


def forest(
    fps: np.ndarray, sizes: np.ndarray, n_first: int, radius: int, ratio: float, confirmed: Callable[[int, int], bool] | None = None
) -> list[tuple[int, int]]:
    """Indices of the links of a spanning forest of all links between the first n_first rows and the rest, or among all rows if there is no rest; only of those that are `confirmed`, if that is given."""
    alone = n_first == len(fps)
    key = sizes.astype(np.float64) if ratio else np.bitwise_count(fps).sum(1).astype(np.float64)
    first, second = np.argsort(key[:n_first], kind="stable"), n_first + np.argsort(key[n_first:], kind="stable")
    second = first if alone else second
    ordered = key[second]
    root = np.arange(len(fps))
    links: list[tuple[int, int]] = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    columns = [np.ascontiguousarray(fps[second, j]) for j in range(fps.shape[1])]
    for at in range(0, len(first), ROWS):
        rows = first[at : at + ROWS]
        least, most = key[rows[0]], key[rows[-1]]
        a = np.searchsorted(ordered, least * ratio if ratio else least - radius, "left")
        z = np.searchsorted(ordered, most / ratio if ratio else most + radius, "right")
        a = max(a, at) if alone else a
        if a >= z:
            continue
        distance = np.bitwise_count(fps[rows, 0][:, None] ^ columns[0][None, a:z])
        for c in range(1, min(FIRST, len(columns))):
            distance = distance + np.bitwise_count(fps[rows, c][:, None] ^ columns[c][None, a:z])
        i, j = np.nonzero(distance <= radius)
        if len(columns) > FIRST and len(i):  # the first words leave few pairs
            rest = sum(np.bitwise_count(fps[rows[i], c] ^ columns[c][a + j]).astype(np.int32) for c in range(FIRST, len(columns)))
            near = distance[i, j] + rest <= radius
            i, j = i[near], j[near]
        x, y = rows[i], second[a + j]
        if ratio and len(x):
            most = np.maximum(sizes[x], sizes[y])
            # Sets that differ have a similarity of 1 - 1 / most at best: very short texts of two fingerprints never link.
            near = (np.minimum(sizes[x], sizes[y]) >= ratio * most) & (most - 1 >= ratio * most)
            x, y = x[near], y[near]
        apart = root[x] != root[y]
        for p, q in zip(x[apart].tolist(), y[apart].tolist()):
            r, s = find(p), find(q)
            if r != s and (confirmed is None or confirmed(p, q)):
                root[max(r, s)] = min(r, s)
                links.append((p, q))
        while (root[root] != root).any():
            root = root[root]
    return links


def _comparer(words: int, radius: int, ratio: float):
    def compare(pair: pd.DataFrame) -> pd.DataFrame:
        raw, sizes = pair["fps"].tolist(), b"".join(pair["sizes"])
        fps = _as_words(b"".join(raw), words)
        links = forest(fps, np.frombuffer(sizes, ">i4").astype(np.int64), len(raw[0]) // (8 * words), radius, ratio)
        whole = b"".join(raw)
        cut = [whole[i : i + 8 * words] for i in range(0, len(whole), 8 * words)]
        return pd.DataFrame({"a": [cut[i] for i, _ in links], "b": [cut[j] for _, j in links]})

    return compare


def links(nodes: DataFrame, radius: int, bits: int, ratio: float = 0.0, tile: int = TILE) -> DataFrame:
    """Links (a, b) between the fingerprints of `nodes` (fp, size; fp unique) whose components are those of all pairs within `radius` bits and, if `ratio` is given, with sizes of at least that ratio."""
    spark, words = nodes.sparkSession, bits // 64
    n_tiles = -(-max(1, nodes.count()) // tile)
    order = (["size"] if ratio else [F.col(f"c{j}") for j in range(BLOCKS)]) + ["fp"]
    counted = nodes.select("fp", "size", *[c.alias(f"c{j}") for j, c in enumerate(_block_counts(F.col("fp"), bits))])
    ranged = counted.repartitionByRange(n_tiles, *order).sortWithinPartitions(*order).select("fp", "size")
    tiles = written(
        ranged.mapInPandas(_tiler(tile, 8 * words), "tile bigint, low array<int>, high array<int>, fps binary, sizes binary"), "tiles"
    )
    # Bounds of tiles, some 50 bytes for each TILE fingerprints; no fingerprint comes to the driver.
    bounds = tiles.select("tile", "low", "high").toPandas()
    if not len(bounds):
        return spark.createDataFrame([], "a binary, b binary")
    sent = spark.sparkContext.broadcast((bounds["tile"].to_numpy(), np.stack(bounds["low"]), np.stack(bounds["high"])))
    other = F.explode(_partners(sent, radius, ratio)("low", "high")).alias("other")
    # The pairs that aren't skipped, counted from the bounds alone: a task has about as many of them at any size.
    n_pairs = tiles.select(F.size(_partners(sent, radius, ratio)("low", "high")).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(1))).first()[0]
    dealt = (
        tiles.select("tile", other, "fps", "sizes")
        .select(F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "fps", "sizes")
        .repartition(min(MAX_TASKS, max(spark.sparkContext.defaultParallelism, n_pairs // PAIRS)), "i", "j")
    )
    return dealt.groupBy("i", "j").applyInPandas(_comparer(words, radius, ratio), "a binary, b binary")


def _confirmer(bits: int, radius: int, ratio: float):
    def confirm(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part", kind="stable")
        cut, sets = rows["fp"].tolist(), [np.frombuffer(h, np.uint64) for h in rows["hashes"]]
        part, sizes = rows["part"].to_numpy(), np.array([max(1, len(x)) for x in sets], np.int64)
        n_first = int((part == part[0]).sum())
        if part[0] == part[-1] and rows["i"].iloc[0] != rows["j"].iloc[0]:  # the other part has no texts
            return pd.DataFrame({"a": [], "b": []})
        same = lambda p, q: jaccard(sets[p], sets[q]) >= ratio
        found = forest(_as_words(b"".join(cut), bits // 64), sizes, n_first, radius, ratio, same)
        return pd.DataFrame({"a": [cut[p] for p, _ in found], "b": [cut[q] for _, q in found]})

    return confirm


def confirmed_links(candidates: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int, radius: int, bits: int, ratio: float, batch: int) -> DataFrame:
    """Links (a, b) whose components are those of all pairs within `radius` bits and with a Jaccard similarity of at least `ratio`.

    candidates: node and root of every fingerprint with a candidate but the
    roots. nodes: fp, size and at, the row of `texts` (at, text) that stands
    for it.
    """
    both = candidates.select(F.col("node").alias("fp"), "root").union(candidates.select(F.col("root").alias("fp"), "root").distinct())
    members = written(both.join(nodes.select("fp", "size", "at"), "fp"), "members")
    groups = members.groupBy("root").agg(F.sum(F.col("size").cast("bigint")).alias("n"))
    groups = groups.withColumn("parts", F.ceil(F.col("n") / batch).cast("int"))
    small = groups.where("parts = 1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_batches = max(-(-small // batch), 2 * members.sparkSession.sparkContext.defaultParallelism)
    alone = F.col("parts") > 1
    keyed = members.join(groups.drop("n"), "root").select(
        "at",
        "fp",
        "parts",
        F.when(alone, F.col("root")).alias("of"),
        F.when(alone, F.lit(-1)).otherwise(F.pmod(F.xxhash64("root"), F.lit(n_batches))).alias("batch"),
        F.pmod(F.xxhash64("fp"), "parts").cast("int").alias("part"),
    )
    sets = texts.join(keyed, "at").select("fp", "of", "batch", "part", "parts", _sets(shingle)("text").alias("hashes"))
    dealt = sets.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")).select(
        "fp", "of", "batch", "part", "hashes", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")
    )
    return dealt.groupBy("of", "batch", "i", "j").applyInPandas(_confirmer(bits, radius, ratio), "a binary, b binary")


def _linked(prints: DataFrame, shingle: int, radius: int, bits: int, ratio: float, tile: int, repeats: bool) -> DataFrame:
    """fp, least (the least id of its rows), n (how many rows have that id) and root (of its component) of every fingerprint of `prints` (doc_id, fp, size, and with a ratio at and text)."""
    if ratio and repeats:
        raise ValueError("a ratio is one of sets of shingles, without repeats")
    exact = ratio > 0
    at = F.min("at") if exact else F.lit(None).cast("bigint")
    ids = prints.groupBy("fp", "doc_id").agg(F.min("size").alias("size"), F.count(F.lit(1)).alias("n"), at.alias("at"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "n", "at"))  # null only if there is no other
    found = ids.groupBy("fp").agg(F.min("size").alias("size"), first.alias("f"))
    nodes = written(found.select("fp", "size", "f.doc_id", "f.n", "f.at"), "nodes")
    roots = components(links(nodes.select("fp", "size"), radius, bits, ratio, tile))
    if exact:
        roots = components(confirmed_links(roots, nodes, prints.select("at", "text"), shingle, radius, bits, ratio, BATCH))
    return nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", F.col("doc_id").alias("least"), "n", F.coalesce("root", "fp").alias("root")
    )


def near_duplicates(
    docs: DataFrame,
    shingle: int = 5,
    bits: int = 256,
    radius: int = RADIUS,
    ratio: float = 0.8,
    repeats: bool = False,
    text: str = "text",
    doc_id: str = "doc_id",
    tile: int = TILE,
) -> DataFrame:
    """doc_id, fp (binary) and component_id, the least doc_id that links lead to, of every row.

    The defaults link texts whose five-word shingles have a Jaccard similarity
    of 0.8 or more. The radius only finds candidates and is wide for it: a
    similarity s is a cosine of 2s / (1 + s) at equal sizes, an angle of 0.476
    at 0.8, and so 39 of 256 bits on average with a standard deviation of 6.
    Where even counts tie, in short texts, the mean is up to 48. At RADIUS a
    pair of the least similarity is no candidate with a probability of 1e-4 at
    four and five shingles and below 1e-6 from 12 shingles on. Unrelated texts
    differ in 128 bits, with a standard deviation of 8. Each different shingle
    counts once, as in the Jaccard similarity; with `repeats`, which goes with
    no ratio, as often as it occurs, and the radius decides.
    """
    found = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), printed(F.col(text), shingle, bits, repeats).alias("p"))
    more = [F.monotonically_increasing_id().alias("at"), "text"] if ratio else []
    prints = written(found.select("doc_id", "p.fp", "p.size", *more), "prints")
    linked = _linked(prints, shingle, radius, bits, ratio, tile, repeats)
    of_root = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = linked.select("fp", "root").join(of_root, "root").select("fp", "component_id")
    return prints.select("doc_id", "fp").join(ids, "fp").select("doc_id", "fp", "component_id")


def one_of_each(
    docs: DataFrame,
    shingle: int = 5,
    bits: int = 256,
    radius: int = RADIUS,
    ratio: float = 0.8,
    repeats: bool = False,
    text: str = "text",
    doc_id: str = "doc_id",
    tile: int = TILE,
) -> DataFrame:
    """The rows of `docs` without near-duplicates: of each component the row with the least id stays, and of rows that repeat that id with its fingerprint one."""
    rows = docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("at"), F.col(doc_id).alias("doc_id"), printed(F.col(text), shingle, bits, repeats).alias("p"))
    # Written with the texts, since the fingerprints are needed twice and a second pass would compute them again.
    kept_rows = written(rows.select("row", "at", "doc_id", "p.fp", "p.size"), "prints")
    linked = _linked(kept_rows.select("doc_id", "fp", "size", "at", F.col("row")[text].alias("text")), shingle, radius, bits, ratio, tile, repeats)
    best = F.min(F.struct(F.col("least").isNull(), "least", "fp", "n")).alias("best")
    chosen = written(linked.groupBy("root").agg(best).select(F.col("best.fp").alias("k"), F.col("best.least").alias("id"), "best.n"), "chosen")
    same = (F.col("fp") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("id"))
    out = kept_rows.join(chosen, same, "left_semi")
    if chosen.where("n > 1").limit(1).count():
        out = out.dropDuplicates(["fp"])
    return out.select("row.*")
