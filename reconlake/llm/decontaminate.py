"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The test strings are windows of WINDOW consecutive benchmark words (a shorter
item is one window). Windows of one length share a search: a block is a run of
`block` words, the shift table says for each block how far the window's end can
move on without missing a test string that holds it, and every block in no
test string moves it by the largest shift. Where the shift is zero, the bucket
of that suffix block, split by prefix block, holds the few test strings to
compare word by word. With ten words and three-word blocks most of a clean
text is passed in steps of eight words.

The test strings go to every task in parts of at most `max_block_bytes` of
benchmark text, so what is sent has a bound that does not depend on the
benchmark's size. One part is searched as rows pass by, without a shuffle. More
parts are searched in passes of their own, one after the other, so that a task
never holds the tables of two: a pass writes what it finds by the text's SHA-256
to the shared folder, which is little, and in the end texts are counted and meet
their finds: by a broadcast of up to MAX_FOUND finds, by a join beyond. A hot
source or a group of copies is spread like any other rows, but for that join,
whose skew Spark's adaptive execution splits; a lost executor only repeats its
partitions.

Nulls and odd rows: a null or wordless text has no words, hits or items. Items
without words hold no test string. An item without an id marks words as hit
but cannot be listed; rows with one id are one item. An empty benchmark hits
nothing. Repeated documents are each judged. Other columns pass through `scan`;
columns named like its outputs are replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from reconlake.llm.text import alnum_words
from reconlake.plans.lineage import written

WINDOW = 10
MAX_BLOCK_BYTES = 8 << 20  # of four for each character; a part's tables take some 100 MB of each worker
MAX_FOUND = 100_000  # texts with finds that are broadcast

Words = tuple[bytes, ...]
HITS = StructType(
    [
        StructField("n_words", IntegerType()),
        StructField("spans", ArrayType(ArrayType(IntegerType()))),  # first hit word and the one after the last
        StructField("items", ArrayType(StringType())),
    ]
)


class Search:
    """Test strings of one length."""

    def __init__(self, length: int, patterns: dict[Words, set[str | None]]):
        self.length, self.patterns = length, patterns
        self.block = 3 if length >= 6 else 2 if length >= 3 else 1
        self.most = length - self.block + 1
        self.shift: dict[Words, int] = {}
        self.buckets: dict[Words, dict[Words, list[Words]]] = {}
        b = self.block
        for p in patterns:
            for end in range(b, length + 1):
                block, left = p[end - b : end], length - end
                if left < self.shift.get(block, self.most):
                    self.shift[block] = left
            self.buckets.setdefault(p[length - b :], {}).setdefault(p[:b], []).append(p)

    def occurrences(self, words: list[bytes]) -> Iterator[tuple[int, Words]]:
        """Start and test string of every occurrence."""
        b, m, most, shift, n = self.block, self.length, self.most, self.shift.get, len(words)
        end = m
        while end <= n:
            step = shift(tuple(words[end - b : end]), most)
            if step:
                end += step
                continue
            start = end - m
            for p in self.buckets.get(tuple(words[end - b : end]), {}).get(tuple(words[start : start + b]), ()):
                if tuple(words[start:end]) == p:
                    yield start, p
            end += 1


def searches(items: Iterable[tuple[str | None, str | None]], window: int = WINDOW) -> list[Search]:
    """One search for each length of the test strings of (id, text) items."""
    by_length: dict[int, dict[Words, set[str | None]]] = {}
    for item_id, text in items:
        words = alnum_words(text)
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            by_length.setdefault(n, {}).setdefault(tuple(words[i : i + n]), set()).add(item_id)
    return [Search(n, p) for n, p in sorted(by_length.items())]


def find(found: list[Search], text: str | None) -> tuple[int, list[list[int]], list[str]]:
    """Number of words, merged spans of hit words, and items of one text."""
    words = alnum_words(text)
    spans: list[tuple[int, int]] = []
    items: set[str | None] = set()
    for s in found:
        for start, p in s.occurrences(words):
            spans.append((start, start + s.length))
            items |= s.patterns[p]
    return len(words), merged(spans), sorted(x for x in items if x is not None)


def merged(spans: Iterable) -> list[list[int]]:
    out: list[list[int]] = []
    for a, z in sorted((int(a), int(z)) for a, z in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return out


def benchmark_parts(benchmark: DataFrame, item_id: str, text: str, max_block_bytes: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """The benchmark in parts of bounded size; the driver holds one part at a time."""
    part: list[tuple[str | None, str | None]] = []
    size = 0
    for row in benchmark.select(F.col(item_id).cast("string"), text).toLocalIterator():
        n = 4 * len(row[1] or "")
        if part and size + n > max_block_bytes:
            yield part
            part, size = [], 0
        part.append((row[0], row[1]))
        size += n
    if part:
        yield part


#: Tables of the part that this worker process searched last, by the part's name.
_built: dict[str, list[Search]] = {}


def _searcher(sent, window: int):
    """UDF that searches texts for one part of the benchmark, (name, items) in a broadcast."""

    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        name, items = sent.value
        if name not in _built:
            _built.clear()
            _built[name] = searches(items, window)
        for texts in batches:
            yield pd.DataFrame([find(_built[name], t) for t in texts], columns=HITS.names)

    return F.pandas_udf(search, HITS).asNondeterministic()  # so that no rewrite of the plan runs it twice


def _n_words(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: len(alnum_words(t)))


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    max_block_bytes: int = MAX_BLOCK_BYTES,
) -> DataFrame:
    """`docs` with n_words, hit_spans (array of [first, end)) and hit_items (sorted ids as strings)."""
    sc = docs.sparkSession.sparkContext
    parts = benchmark_parts(benchmark, item_id, item_text, max_block_bytes)
    searcher = lambda part: _searcher(sc.broadcast((uuid.uuid4().hex, part)), window)(F.col(text))
    none = F.array().cast("array<array<int>>"), F.array().cast("array<string>")
    count = F.pandas_udf(_n_words, IntegerType())(F.col(text))
    first, second = next(parts, None), next(parts, None)
    if first is None:
        return docs.withColumns({"n_words": count, "hit_spans": none[0], "hit_items": none[1]})
    if second is None:
        out = docs.withColumn("__hit", searcher(first))
        return out.withColumns({"n_words": F.col("__hit.n_words"), "hit_spans": F.col("__hit.spans"), "hit_items": F.col("__hit.items")}).drop("__hit")
    found = None
    for part in (p for some in ((first, second), parts) for p in some):
        hits = docs.select(F.sha2(text, 256).alias("__text_key"), searcher(part).alias("h")).where(F.size("h.spans") > 0)
        own = written(hits.select("__text_key", "h.spans", "h.items").dropDuplicates(["__text_key"]), "finds")
        found = own if found is None else found.union(own)
    # A text has at most one find of each part.
    spans, items = join_spans(F.flatten(F.collect_list("spans"))), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items"))))
    by_text = written(found.groupBy("__text_key").agg(spans.alias("__text_spans"), items.alias("__text_items")), "finds")
    by_text = F.broadcast(by_text) if by_text.limit(MAX_FOUND + 1).count() <= MAX_FOUND else by_text
    out = docs.withColumns({"n_words": count, "__text_key": F.sha2(text, 256)}).join(by_text, "__text_key", "left")
    return out.withColumns({"hit_spans": F.coalesce("__text_spans", none[0]), "hit_items": F.coalesce("__text_items", none[1])}).drop("__text_key", "__text_spans", "__text_items")


def join_spans(spans: Column) -> Column:
    """Overlapping and touching spans joined."""

    def add(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        touches = F.coalesce(s[0] <= last[1], F.lit(False))
        grown = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.array(last[0], F.greatest(last[1], s[1]))))
        return F.when(touches, grown).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast("array<array<int>>"), add)


def n_hit(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s[1] - s[0])


