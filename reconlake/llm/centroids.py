"""Centroid clustering of whole-numbered vectors with Drake's adaptive bounds.

Each vector keeps an upper bound of the distance to its own centroid, lower
bounds of the distances to the `near` centroids that were nearest besides, and
one lower bound that holds for all the rest. When centroids move, bounds move
by as much. If the upper bound is below every lower bound, nothing is compared;
if it is below all bounds from the i-th on, only the centroids before that are,
by exact distances; if it can't be told from the remainder's bound, all are.
So the result is that of comparing every vector with every centroid in every
round. Distances are whole numbers (squared), bounds are rounded outwards, and
only a strictly smaller bound certifies, so a tie is always compared, and goes
to the smaller number. A block of vectors gives up bounds that no vector of it
needed in a round.

Vectors lie in blocks of BLOCK rows: their components and bounds are packed
arrays, and a block is updated as a whole in numpy. A round writes the blocks
anew to the shared folder, with the sums of their vectors by centroid; these
are added within each task, then over all tasks. What comes to the driver is
the centroids: k times the number of components, whatever the number of
vectors. Two rounds' blocks are kept at a time. Nothing is shuffled but sums.

Only vectors of the given number of components, none null or non-finite, take
part; other rows are left out. Rows that repeat an id or a vector each get
their row. Fewer vectors than k give as many centroids as there are vectors;
none give no rows. A null id is seeded as an empty one and is returned. Other
columns are left out. Components beyond 2^27 in magnitude, whose squared
distances may not fit 64 bits, are an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reconlake.plans.lineage import discard, new_folder, written, written_to

BLOCK = 4096
LARGEST = 1 << 27
LEAST_NEAR = 1  # bounds that a block keeps at least
STATE = "ids array<bigint>, vectors binary, cluster binary, upper binary, near binary, lower binary, width int, compared bigint, present array<int>, counts array<bigint>, sums array<bigint>"
KEPT = ("ids", "vectors", "cluster", "upper", "near", "lower", "width")


def valid(vector: Column, width: int) -> Column:
    """Has the vector `width` components, all of them finite numbers?"""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))  # a NaN is above infinity
    return F.coalesce((F.size(vector) == width) & finite, F.lit(False))


def whole(vector: Column, scale: float) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distance of each row of x from y, a row or as many rows."""
    gap = x - y
    return np.einsum("ij,ij->i", gap, gap)


def _above(d2: np.ndarray) -> np.ndarray:
    """A number that is no less than the distance; two steps cover the rounding of the conversion and of the root."""
    return np.nextafter(np.nextafter(np.sqrt(d2.astype(np.float64)), np.inf), np.inf)


def _below(d2: np.ndarray) -> np.ndarray:
    return np.nextafter(np.nextafter(np.sqrt(d2.astype(np.float64)), -np.inf), -np.inf)


class Bounds:
    """The state of the vectors of a block: cluster, upper bound, near centroids with their lower bounds and, last, that of the rest."""

    def __init__(self, cluster: np.ndarray, upper: np.ndarray, near: np.ndarray, lower: np.ndarray):
        self.cluster, self.upper, self.near, self.lower = cluster, upper, near, lower

    @classmethod
    def scanned(cls, x: np.ndarray, centroids: np.ndarray, width: int) -> Bounds:
        """Bounds of vectors that are compared with all centroids."""
        d2 = np.stack([squared(x, c) for c in centroids], axis=1)
        order = np.argsort(d2, axis=1, kind="stable")
        d2 = np.take_along_axis(d2, order, 1)
        width = min(width, len(centroids) - 1)
        rest = _below(d2[:, width + 1]) if width + 1 < len(centroids) else np.full(len(x), np.inf)
        return cls(order[:, 0].astype(np.int32), _above(d2[:, 0]), order[:, 1 : width + 1].astype(np.int32), np.column_stack((_below(d2[:, 1 : width + 1]), rest)))

    def moved(self, shift: np.ndarray) -> None:
        """Bounds after each centroid has moved by at most `shift`."""
        self.upper = np.nextafter(self.upper + shift[self.cluster], np.inf)
        self.lower[:, :-1] -= shift[self.near]
        self.lower[:, -1] -= shift.max()
        self.lower = np.nextafter(self.lower, -np.inf)

    def needed(self, rows: np.ndarray) -> np.ndarray:
        """How many near centroids must be compared; one more than there are if all centroids must."""
        from_here = np.minimum.accumulate(self.lower[rows, ::-1], axis=1)[:, ::-1]
        certain = self.upper[rows, None] < from_here
        return np.where(certain.any(1), certain.argmax(1), certain.shape[1])

    def update(self, x: np.ndarray, centroids: np.ndarray) -> int:
        """Assigns every vector anew; the number of exact distances."""
        width = self.near.shape[1]
        open_ = np.flatnonzero(self.needed(np.arange(len(x))))
        compared = len(open_)
        self.upper[open_] = _above(squared(x[open_], centroids[self.cluster[open_]]))
        n = self.needed(open_)
        most = int(n.max(initial=0))
        some = open_[(n > 0) & (n <= width)]
        if len(some):
            compared += self._reorder(some, n[(n > 0) & (n <= width)], x, centroids)
        every = open_[n > width]
        if len(every):
            compared += len(every) * len(centroids)
            found = Bounds.scanned(x[every], centroids, width)
            self.cluster[every], self.upper[every], self.near[every], self.lower[every] = found.cluster, found.upper, found.near, found.lower
        self._narrow(max(LEAST_NEAR, min(most, width)))
        return compared

    def _reorder(self, rows: np.ndarray, n: np.ndarray, x: np.ndarray, centroids: np.ndarray) -> int:
        """The own and the first n near centroids of each row in the order of their exact distances."""
        number = np.column_stack((self.cluster[rows], self.near[rows]))
        far = np.iinfo(np.int64).max
        d2 = np.full(number.shape, far)
        d2[:, 0] = squared(x[rows], centroids[number[:, 0]])
        lower = np.column_stack((np.zeros(len(rows)), self.lower[rows, :-1]))
        for i in range(1, int(n.max()) + 1):
            at = np.flatnonzero(n >= i)
            d2[at, i] = squared(x[rows[at]], centroids[number[at, i]])
        exact = d2 < far
        lower[exact] = _below(d2[exact])
        by_number = np.argsort(number, axis=1, kind="stable")
        order = np.take_along_axis(by_number, np.argsort(np.take_along_axis(d2, by_number, 1), axis=1, kind="stable"), 1)
        number, d2, lower = (np.take_along_axis(a, order, 1) for a in (number, d2, lower))
        self.cluster[rows], self.upper[rows], self.near[rows], self.lower[rows, :-1] = number[:, 0], _above(d2[:, 0]), number[:, 1:], lower[:, 1:]
        return int(n.sum())

    def _narrow(self, width: int) -> None:
        """Keeps the first `width` bounds; the others are covered by the remainder's."""
        if width < self.near.shape[1]:
            rest = self.lower[:, width:].min(1)
            self.near, self.lower = self.near[:, :width], np.column_stack((self.lower[:, :width], rest))


def _sums(x: np.ndarray, cluster: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """The centroids that vectors belong to, how many, and the vectors' sums."""
    order = np.argsort(cluster, kind="stable")
    present, first, counts = np.unique(cluster[order], return_index=True, return_counts=True)
    return present.tolist(), counts.tolist(), np.add.reduceat(x[order], first, axis=0).ravel().tolist()


def _row(ids, x: np.ndarray, b: Bounds, compared: int) -> dict:
    present, counts, sums = _sums(x, b.cluster)
    return {
        "ids": ids, "vectors": x.astype(np.int32).tobytes(), "cluster": b.cluster.tobytes(), "upper": b.upper.tobytes(), "near": np.ascontiguousarray(b.near).tobytes(),
        "lower": np.ascontiguousarray(b.lower).tobytes(), "width": b.near.shape[1], "compared": compared, "present": present, "counts": counts, "sums": sums,
    }


def _unpacked(row: dict, d: int) -> tuple[np.ndarray, Bounds]:
    x = np.frombuffer(row["vectors"], np.int32).reshape(-1, d).astype(np.int64)
    n, width = len(x), row["width"]
    near, lower = np.frombuffer(row["near"], np.int32).reshape(n, width), np.frombuffer(row["lower"]).reshape(n, width + 1)
    return x, Bounds(np.frombuffer(row["cluster"], np.int32).copy(), np.frombuffer(row["upper"]).copy(), near.copy(), lower.copy())


def _first(sent, near: int):
    """Rows (id, vector) into blocks that are compared with all centroids."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = sent.value
        d = centroids.shape[1]
        ids: list = []
        parts: list[np.ndarray] = []

        def block(n: int) -> pa.RecordBatch:
            nonlocal ids, parts
            all_ = np.concatenate(parts)
            x, own = all_[:n], ids[:n]
            ids, parts = ids[n:], [all_[n:]]
            return pa.RecordBatch.from_pylist([_row(own, x, Bounds.scanned(x, centroids, near), len(x) * len(centroids))], schema=ARROW_STATE)

        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            if len(x) and np.abs(x).max() > LARGEST:
                raise ValueError(f"a component is beyond {LARGEST} in magnitude: squared distances may not fit 64 bits")
            ids += batch.column(0).to_pylist()
            parts.append(x)
            while len(ids) >= BLOCK:
                yield block(BLOCK)
        if ids:
            yield block(len(ids))

    return blocks


ARROW_STATE = pa.schema([
    ("ids", pa.list_(pa.int64())), ("vectors", pa.binary()), ("cluster", pa.binary()), ("upper", pa.binary()), ("near", pa.binary()), ("lower", pa.binary()),
    ("width", pa.int32()), ("compared", pa.int64()), ("present", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())), ("sums", pa.list_(pa.int64())),
])


def _again(sent):
    """Blocks after a round in which the centroids moved."""

    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, shift = sent.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                x, b = _unpacked(row, centroids.shape[1])
                b.moved(shift)
                compared = b.update(x, centroids)
                yield pa.RecordBatch.from_pylist([_row(row["ids"], x, b, compared)], schema=ARROW_STATE)

    return update


def _added(k: int, d: int):
    """Sums and counts of a task's blocks, one row for each number."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, d + 1), np.int64)
        for batch in batches:
            for present, counts, sums in zip(batch["present"], batch["counts"], batch["sums"]):
                total[np.asarray(present), 0] += np.asarray(counts)
                total[np.asarray(present), 1:] += np.asarray(sums).reshape(-1, d)
        at = np.flatnonzero(total.any(1))
        yield pd.DataFrame({"j": np.repeat(at, d + 1), "at": np.tile(np.arange(d + 1), len(at)), "value": total[at].ravel()})

    return add


def _next(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids' new places: floors of exact means; those without vectors stay."""
    k, d = centroids.shape
    added = state.select("present", "counts", "sums").mapInPandas(_added(k, d), "j bigint, at bigint, value bigint")
    exact = F.sum(F.col("value").cast("decimal(20,0)")).cast("string").alias("value")
    total = {(r["j"], r["at"]): int(r["value"]) for r in added.groupBy("j", "at").agg(exact).collect()}
    out = centroids.copy()
    for j in range(k):
        if n := total.get((j, 0)):
            out[j] = [total[j, i] // n for i in range(1, d + 1)]
    return out


def _assigned(sent):
    """One row for each vector of the blocks: id, cluster, squared distance."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centroids = sent.value
        for batch in batches:
            for ids, vectors, cluster in zip(batch["ids"], batch["vectors"], batch["cluster"]):
                x, c = np.frombuffer(vectors, np.int32).reshape(-1, centroids.shape[1]).astype(np.int64), np.frombuffer(cluster, np.int32)
                yield pd.DataFrame({"vec_id": pd.array(list(ids), "Int64"), "cluster": c, "distance": squared(x, centroids[c])})

    return rows


def seeds(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors (vec_id, vector) whose ids have the smallest hashes, equal hashes in the order of their vectors; k rows come to the driver."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.select(mark.alias("h"), "vector").orderBy("h", "vector").limit(k).collect()
    x = np.array([r["vector"] for r in rows], np.int64)
    if len(x) and np.abs(x).max() > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST} in magnitude: squared distances may not fit 64 bits")
    return x


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(
    vectors: DataFrame, k: int, rounds: int, seed: int, width: int, scale: float = 1024.0, near: int = 3, vec_id: str = "vec_id", vector: str = "embedding"
) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster, distance (squared, to the centroid) of every vector that takes part, and the centroids.

    Components are floor(scale * x). Centroids start as seeds(); each round
    assigns and then moves them to the floors of their vectors' means; after
    the last, vectors are assigned once more.
    """
    spark: SparkSession = vectors.sparkSession
    kept = vectors.where(valid(F.col(vector), width)).select(F.col(vec_id).cast("bigint").alias("vec_id"), whole(F.col(vector), scale).alias("vector"))
    centroids = seeds(kept, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint"), centroids
    folder = new_folder(spark, "bounds")
    sent = spark.sparkContext.broadcast(centroids)
    state = written_to(kept.mapInArrow(_first(sent, near), STATE), folder)
    for _ in range(rounds):
        after = _next(state, centroids)
        if (after == centroids).all():
            break  # nothing would change any more
        sent = spark.sparkContext.broadcast((after, _above(squared(after, centroids))))
        now = new_folder(spark, "bounds")
        state = written_to(state.select(*KEPT).mapInArrow(_again(sent), STATE), now)
        discard(spark, folder)
        folder, centroids = now, after
    sent = spark.sparkContext.broadcast(centroids)
    rows = written(state.select("ids", "vectors", "cluster").mapInPandas(_assigned(sent), "vec_id bigint, cluster int, distance bigint"), "assigned")
    discard(spark, folder)
    return rows, centroids


def with_inertia(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """`rows` with cluster_inertia, inertia and centroid_sha256; one row for each centroid comes to the driver and is broadcast."""
    own = {r["cluster"]: int(r["n"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).cast("string").alias("n")).collect()}
    total = sum(own.values())
    told = [(j, n, total, digest(centroids[j])) for j, n in own.items()]
    by_cluster = rows.sparkSession.createDataFrame(told, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.join(F.broadcast(by_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
