"""Which of many labels stand in a line, by an automaton over their first words.

Every variant of every code is looked for at once: an Aho-Corasick automaton of
the variants' first words passes over each line, and what it finds is held
against the variant's own pattern. A code counts once in a line, by the first of
its variants that matches, whichever stands further to the left.

Lines are read where they lie, without a shuffle. Labels are sent to the tasks
in parts of at most MAX_LABELS; more labels take more passes over the lines,
one after the other. Null and empty lines hold no label; labels that are null
or empty are none. A code that is given twice is one code.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LABELS = 100_000
#: Fixed pattern: punctuation that labels may differ in.
PUNCTUATION = r"[«»\"'.,:;()\[\]–—\-]+"
#: Fixed pattern: what may stand between the words of a label in a line.
BETWEEN = r"[\s,;:()]*"
FOUND = "array<struct<code:string,label:string,rest:string>>"
Label = tuple[str, int, str]  # code, order of the variant, normalized variant


def normalized(text: Column) -> Column:
    """Label text: ё as е, lower case, light punctuation and runs of spaces as one space."""
    folded = F.translate(F.lower(text), "ё", "е")
    return F.trim(F.regexp_replace(F.regexp_replace(folded, PUNCTUATION, " "), r"(?U)\s+", " "))


def pattern(label: str) -> re.Pattern:
    """A normalized label in a line: its words joined by light punctuation or nothing, at the bounds of words, in any case."""
    words = [re.escape(w).replace("е", "[её]") for w in label.split(" ")]
    return re.compile(rf"\b{BETWEEN.join(words)}\b", re.IGNORECASE)


class Search:
    """All variants of some codes."""

    def __init__(self, labels: list[Label]):
        self.labels = sorted(labels)
        self.patterns: dict[str, re.Pattern] = {}
        by_word: dict[str, list[int]] = {}
        for i, (_, _, label) in enumerate(self.labels):
            by_word.setdefault(label.split(" ")[0], []).append(i)
        self.words = ahocorasick.Automaton()
        for word, at in by_word.items():
            self.words.add_word(word, at)
        self.words.make_automaton()

    def find(self, text: str | None) -> list[tuple[str, str, str]]:
        """code, variant and what follows it, by code."""
        if not text or not len(self.words):
            return []
        near = {i for _, at in self.words.iter(text.lower().replace("ё", "е")) for i in at}
        out: list[tuple[str, str, str]] = []
        for i in sorted(near):  # by code and the order of its variants
            code, _, label = self.labels[i]
            if out and out[-1][0] == code:
                continue
            if label not in self.patterns:
                self.patterns[label] = pattern(label)
            if m := self.patterns[label].search(text):
                out.append((code, label, text[m.end() :]))
        return out


#: The search that this worker process used last, by its name.
_built: dict[str, Search] = {}


def _finder(sent):
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        name, labels = sent.value
        if name not in _built:
            _built.clear()
            _built[name] = Search(labels)
        for texts in batches:
            yield pd.Series([_built[name].find(t) for t in texts])

    return F.pandas_udf(find, FOUND).asNondeterministic()  # so that no rewrite of the plan runs it twice


def parts(labels: DataFrame, most: int) -> Iterator[list[Label]]:
    """The labels in parts of about `most`, no code in two; the driver holds one part at a time."""
    rows = labels.where("code is not null and label <> ''").groupBy("code", "label").agg(F.min("ord").alias("ord")).select("code", "ord", "label").orderBy("code", "ord")
    part: list[Label] = []
    for row in rows.toLocalIterator():
        if len(part) >= most and row["code"] != part[-1][0]:
            yield part
            part = []
        part.append(tuple(row))
    if part:
        yield part


def search(lines: DataFrame, labels: DataFrame, text: str = "text", most: int = MAX_LABELS) -> DataFrame:
    """`lines` with code, label (the variant) and rest (what follows it), one row for each code that a line holds.

    labels: code, ord, label (normalized).
    """
    sc = lines.sparkSession.sparkContext
    passes = []
    for part in parts(labels, most):
        found = _finder(sc.broadcast((uuid.uuid4().hex, part)))(F.col(text))
        passes.append(lines.withColumn("__found", found).where(F.size("__found") > 0).select(*lines.columns, F.inline("__found")))
    none = [F.lit(None).cast("string").alias(c) for c in ("code", "label", "rest")]
    return reduce(DataFrame.unionByName, passes) if passes else lines.limit(0).select("*", *none)
