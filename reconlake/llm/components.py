"""Connected components of a table of links, by alternating large and small stars.

Every step is a partial aggregation and an equi-join on the links. A node with
very many links (over HOT, or one in MOST_HOT of all links, whichever is more)
would bring them all into one task of that join; such nodes, at most 2 *
MOST_HOT of them whatever the number of links, are broadcast to the links
instead. The links are written to the shared folder after each star, and only
their number and a checksum of them come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconlake.plans.lineage import written

MAX_ROUNDS = 60
HOT, MOST_HOT = 1000, 10_000


def _with_least(rows: DataFrame, n_links: int) -> DataFrame:
    """`rows` (a, b) with m, the least b of each a."""
    least = rows.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    hot = F.col("n") > max(HOT, n_links // MOST_HOT)
    # rows hold each link at most twice, so at most 2 * MOST_HOT nodes are hot.
    marked = rows.join(F.broadcast(least.where(hot).select("a", F.col("m").alias("hot"))), "a", "left")
    cold = marked.where("hot is null").select("a", "b").join(least.where(~hot).select("a", "m"), "a")
    return marked.where("hot is not null").select("a", "b", F.col("hot").alias("m")).union(cold.select("a", "b", "m"))


def _large_star(links: DataFrame, n_links: int) -> DataFrame:
    """Each node's larger neighbours are linked to the least of it and its neighbours."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both, n_links).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()


def _small_star(links: DataFrame, n_links: int) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of these."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    moved = F.when(F.col("b") > F.col("m"), F.col("b")).otherwise(F.col("a"))
    return _with_least(down, n_links).select(moved.alias("a"), F.col("m").alias("b")).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (the least node of its component) of every linked node but the roots themselves."""
    now = written(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b"), "links")
    mark = now.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("h"))
    before = mark.first()
    for _ in range(MAX_ROUNDS if before["n"] else 0):
        # Each star is written, or else every use of the first would repeat its plan within the second's.
        now = written(_large_star(now, before["n"]), "links")
        now = written(_small_star(now, before["n"]), "links")
        after = now.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("h")).first()
        if after == before:
            break
        before = after
    else:
        if before["n"]:
            raise RuntimeError(f"links still change after {MAX_ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
