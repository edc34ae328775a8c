"""Target-distribution importance resampling of documents.

Identical texts are collapsed by grouping the full text: the features of a text
(runs of up to `n` words, hashed into buckets) and its weight are computed once,
and its bucket counts are multiplied by its number of copies. A bucket's gain
is the logarithm of how much more frequent it is in the target than in all
documents; a text's weight is the mean gain of its features. Weights are joined
back to the documents before each gets noise of its own (Gumbel), so that
copies of a text are drawn apart from each other, and the highest scores are
drawn: a sample without replacement in proportion to exp(weight / 1000).

Texts are grouped once, with copies counted in each task before they are
shuffled; what is kept of a text is its bucket counts, 8 bytes for each
different one, so texts are read once. Counts are added within each task over
an array of the buckets, then over all tasks; the driver gets one row a bucket.
A text that very many documents share is joined back by a broadcast
(spread.py). Scores are whole numbers between a bucket's least and greatest
gain and noise, some 10^5 in all whatever the input: the driver counts
documents by score and finds the score at which the draw ends. Only documents
from there on are sorted, by range partitions, and numbered by the partitions'
sizes; no window holds all rows.

A null text has no words, as an empty one; a text without features has weight
0. A null id has the noise of an empty one and is ordered last among equals.
Rows that repeat an id each get their row, with equal noise. Without a target
all gains compare with nothing seen; an empty corpus gives no rows. Columns of
other names are left out.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from reconlake.llm.spread import back_to_rows
from reconlake.llm.text import alnum_words
from reconlake.plans.lineage import written

FEATURES = StructType([StructField("n_words", LongType()), StructField("n_features", LongType()), StructField("counts", BinaryType())])
PARTITION_ROWS = 1 << 20  # drawn documents that a range partition sorts


def features(words: list[bytes], n: int) -> list[bytes]:
    """All runs of 1 to n consecutive words, joined by one space."""
    return [b" ".join(words[i : i + size]) for size in range(1, n + 1) for i in range(len(words) - size + 1)]


def bucket_counts(words: list[bytes], n: int, buckets: int) -> np.ndarray:
    """Rows (bucket, count) of a text's features, by bucket."""
    hashed = np.fromiter((zlib.crc32(f) % buckets for f in (words if n == 1 else features(words, n))), np.uint32)
    at, counts = np.unique(hashed, return_counts=True)
    return np.column_stack((at, counts)).astype(np.uint32)


def _featured(n: int, buckets: int):
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            words = alnum_words(t)
            counts = bucket_counts(words, n, buckets)
            rows.append((len(words), int(counts[:, 1].sum()), counts.tobytes()))
        return pd.DataFrame(rows, columns=FEATURES.names)

    return F.pandas_udf(of, FEATURES).asNondeterministic()  # so that no rewrite of the plan runs it twice


def featured(docs: DataFrame, n: int, buckets: int, text: str = "text") -> DataFrame:
    """key (of the text), copies, n_words, n_features and counts of every different text that isn't null."""
    grouped = docs.where(F.col(text).isNotNull()).groupBy(F.col(text).alias("text")).agg(F.count(F.lit(1)).alias("copies"))
    return grouped.select(text_key("text").alias("key"), "copies", _featured(n, buckets)("text").alias("f")).select("key", "copies", "f.*")


def text_key(text: str):
    return F.unhex(F.sha2(F.col(text).cast("binary"), 256))


def _added(buckets: int):
    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for copies, raw in zip(batch["copies"], batch["counts"]):
                counts = np.frombuffer(raw, np.uint32).reshape(-1, 2).astype(np.int64)
                total[counts[:, 0]] += copies * counts[:, 1]
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    return add


def totals(texts: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs, copies included."""
    added = texts.select("copies", "counts").mapInPandas(_added(buckets), "bucket bigint, n bigint")
    out = np.zeros(buckets, object)
    for r in added.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed share in the target over that in the corpus."""
    k = len(corpus)
    s, t = int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float((b + 1) * (s + k)) / float((a + 1) * (t + k)))) for a, b in zip(corpus.tolist(), target.tolist())], np.int64)


def _weighed(sent):
    def weights(counts: pd.Series) -> pd.Series:
        gain, out = sent.value, []
        for raw in counts:
            c = np.frombuffer(raw, np.uint32).reshape(-1, 2).astype(np.int64)
            n = int(c[:, 1].sum())
            out.append(int((gain[c[:, 0]] * c[:, 1]).sum()) // n if n else 0)
        return pd.Series(out, dtype="int64")

    return F.pandas_udf(weights, "bigint")


def weighed(docs: DataFrame, target: DataFrame, n: int, buckets: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_features, weight of every document."""
    spark = docs.sparkSession
    texts = written(featured(docs, n, buckets, text), "features")
    gain = gains(totals(texts, buckets), totals(featured(target, n, buckets), buckets))
    per_text = written(texts.select("key", "copies", "n_words", "n_features", _weighed(spark.sparkContext.broadcast(gain))("counts").alias("weight")), "weights")
    rows = written(docs.select(F.col(doc_id).alias("doc_id"), text_key(text).alias("key")), "keys")
    known = back_to_rows(rows, per_text, "key", "copies", rows.count()).drop("key")
    zero = F.lit(0).cast("bigint")
    return known.union(rows.where("key is null").select("doc_id", zero, zero, zero))


def noisy(weighed: DataFrame, seed: int) -> DataFrame:
    """`weighed` with score: the weight and the document's own noise."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("bigint")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    return weighed.withColumn("score", F.col("weight") + noise)


def drawn(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """`scored` (a written table) with rank: 1, 2, … of the `percent` highest scores among documents of at least `least_words` words, null for the others; ties go to the smaller doc_id."""
    fits = F.col("n_words") >= least_words
    by_score = {r["score"]: r["n"] for r in scored.where(fits).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_drawn = percent * sum(by_score.values()) // 100
    last, so_far = None, 0
    for score in sorted(by_score, reverse=True):
        if so_far >= n_drawn:
            break
        last, so_far = score, so_far + by_score[score]
    none = F.lit(None).cast("bigint")
    if last is None:
        return scored.withColumn("rank", none)
    chosen = fits & (F.col("score") >= last)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "n_features"]
    ranged = scored.where(chosen).repartitionByRange(max(1, -(-so_far // PARTITION_ROWS)), *order).sortWithinPartitions(*order)
    placed = written(ranged.withColumn("__at", F.monotonically_increasing_id()), "ranked")
    # The upper bits are the range partition's number, the lower ones the row's within it.
    part = F.shiftright("__at", 33)
    sizes = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, starts = 0, []
    for number, n in sizes:
        starts.append((number, before))
        before += n
    first = F.broadcast(scored.sparkSession.createDataFrame(starts, "__part bigint, __before bigint"))
    rank = F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1
    ranked = placed.withColumn("__part", part).join(first, "__part").withColumn("rank", F.when(rank <= n_drawn, rank)).select(*scored.columns, "rank")
    return ranked.union(scored.where(~chosen | F.col("score").isNull()).withColumn("rank", none))


def resample(
    docs: DataFrame, target: DataFrame, percent: int, seed: int, n: int = 2, buckets: int = 10_000, least_words: int = 20, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every document: the `percent` of documents of at least `least_words` words that are drawn towards the texts of `target` (column text) have a rank."""
    scored = written(noisy(weighed(docs, target, n, buckets, text, doc_id), seed), "scored")
    return drawn(scored, percent, least_words)
