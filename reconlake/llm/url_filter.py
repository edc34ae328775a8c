"""URL filter: host and path rules, then a Bloom filter cascade over listed hosts.

A cascade answers exactly for every key of the universe it was built over. Its
first level encodes the listed keys, the second those unlisted keys of the
universe that the first level wrongly holds, the third those listed keys that
the second wrongly holds, and so on until a level holds nothing wrongly. A key
is listed if the first level that does not hold it is an even one (counting
from one), or if it passes all of an odd number of levels.

Everything is DataFrame expressions: a level is one row with an array of
segments, each an array of 64-bit words, which a probe takes as a scalar
subquery, so judging a row needs no join, shuffle or Python at any number of
keys. A key's hash chooses its segment, and all its bits lie there; a segment
is built by itself, by the keys that fall to it, and has at most SEGMENT_BITS
bits in the mean. A level has BITS_PER_KEY bits for each key that it encodes:
1.5 bytes for each listed key. What bounds it is one row's 2 GB, over a
billion listed keys, and the memory of the executors, which each hold it; its
size is logged before it is built.

Nulls and odd rows: a null url, or one without `://`, has empty host and path
and follows the default (allow). Repeated urls are judged alike. Null keys are
never listed. Empty tables give empty results, an empty list gives a cascade
without levels. Other columns of the input are left out of `judge`'s result.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reconlake.llm.text import LOWER, UPPER
from reconlake.plans.lineage import cut

BITS_PER_KEY = 12
HASHES = 8
SEGMENT_BITS = 1 << 23
LOG = logging.getLogger(__name__)


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, "://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(rules: Sequence[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, both null if none does."""
    text = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), len(r.host), r.text)):  # the longest ends up outermost
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


class Level(NamedTuple):
    number: int
    n_segments: int
    bits: int  # of each segment
    words: DataFrame  # one row, one column: array<array<bigint>>


def _segment(key: Column, level: int, n_segments: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level), F.lit(-1)), F.lit(n_segments)).cast("int")


def _positions(key: Column, level: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(j)), F.lit(bits)) for j in range(HASHES)]


def _holds(key: Column, level: Level) -> Column:
    """True if the level's filter has all bits of the key."""
    held = F.lit(True)
    words = F.get(level.words.scalar(), _segment(key, level.number, level.n_segments))
    for p in _positions(key, level.number, level.bits):
        word = F.get(words, F.shiftright(p, 6).cast("int"))
        held = held & (F.getbit(word, p.bitwiseAND(F.lit(63)).cast("int")) == 1)
    return held


def _level(keys: DataFrame, number: int, n_keys: int, segment_bits: int) -> Level:
    n_segments = max(1, -(-n_keys * BITS_PER_KEY // segment_bits))
    n_words = max(1, -(-n_keys * BITS_PER_KEY // (64 * n_segments)))
    bits = n_words * 64
    LOG.info("level %d: %d keys, %d segments of %d bits", number, n_keys, n_segments, bits)
    one = F.lit(1).cast("bigint")
    p = F.col("p")
    at = _segment(F.col("key"), number, n_segments).cast("bigint") * n_words
    sparse = (
        keys.select(at.alias("at"), F.explode(F.array(*_positions(F.col("key"), number, bits))).alias("p"))
        .groupBy((F.col("at") + F.shiftright(p, 6)).alias("w"))
        .agg(F.bit_or(F.call_function("shiftleft", one, p.bitwiseAND(F.lit(63)).cast("int"))).alias("b"))
    )

    def in_order(by: str, value: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.struct(by, value))), lambda x: x[value])

    dense = keys.sparkSession.range(n_segments * n_words).join(sparse, F.col("id") == F.col("w"), "left")
    words = dense.select(F.expr(f"id div {n_words}").alias("s"), "id", F.coalesce("b", F.lit(0).cast("bigint")).alias("b"))
    row = words.groupBy("s").agg(in_order("id", "b").alias("x")).agg(in_order("s", "x").alias("words"))
    return Level(number, n_segments, bits, cut(row))


def build_cascade(universe: DataFrame, listed: DataFrame, segment_bits: int = SEGMENT_BITS) -> list[Level]:
    """Levels over the one-column tables `universe` and `listed` (column `key`, any order, repeats allowed)."""
    known = universe.select("key").where("key is not null").distinct()
    wanted = listed.select("key").where("key is not null").distinct().withColumn("is_listed", F.lit(True))
    # Listed keys that the corpus lacks are never asked for, so they cost no bits.
    marked = cut(known.join(wanted, "key", "left").select("key", F.coalesce("is_listed", F.lit(False)).alias("is_listed")))
    inside, outside = marked.where("is_listed").select("key"), marked.where("not is_listed").select("key")
    levels: list[Level] = []
    n = inside.count()
    while n:
        levels.append(_level(inside, len(levels) + 1, n, segment_bits))
        wrong = cut(outside.where(_holds(F.col("key"), levels[-1])))
        inside, outside = wrong, inside
        n = wrong.count()
    return levels


def in_cascade(key: Column, levels: Sequence[Level]) -> Column:
    """Exact membership for every key of the universe; null keys are not listed."""
    listed = F.lit(len(levels) % 2 == 1)
    for level in reversed(levels):
        listed = F.when(_holds(key, level), listed).otherwise(F.lit(level.number % 2 == 0))
    return F.coalesce(listed & key.isNotNull(), F.lit(False))


def membership(rows: DataFrame, key: str, listed: DataFrame, out: str, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """`rows` with the boolean `out`: is the column `key` among the keys of `listed`?"""
    levels = build_cascade(rows.select(F.col(key).alias("key")), listed.select("key"), segment_bits)
    return rows.withColumn(out, in_cascade(F.col(key), levels))


def judge(pages: DataFrame, rules: Sequence[Rule], listed: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    host, path = host_of(F.col(url)), path_of(F.col(url))
    text, verdict = longest_rule(rules, F.col("host"), F.col("path"))
    parts = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    ruled = parts.withColumns({"rule": text, "ruled": verdict})
    found = membership(ruled, "host", listed, "listed")
    return found.select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
    )
