"""Quality rules from tokeniser fertility, after plain word rules.

A public vocabulary, trained on ordinary prose of many languages, is the
measuring rod: `chars_per_token` falls where a text is symbols, capitals or a
foreign script, `fallback_share` (tokens of a single byte beyond ASCII) rises
where characters are unknown to the vocabulary, and `token_entropy` (bits, of
the text's own token counts) falls where it repeats itself or is a table. Each
language has its band for the three; a text in another language is held to the
band of its script, found by the share of its characters beyond Latin. The
bands are those of long texts. A short text's measures scatter, so its bounds
are wider by what the sampling of n tokens explains: ERROR / sqrt(n) for
characters per token, SHARE_ERROR / sqrt(n) for the fallback share; and entropy
can't exceed log2(n), so its floor grows with that. `fit_bands` finds the bands
from texts that are known to be good; BANDS are its result on the labelled good
texts of the test tables, by language.

The plain rules reject texts of fewer than MIN_WORDS words and those of which
over MAX_REPEATED percent of the words lie in three-word windows that occur
twice or more. Texts are judged one by one: no shuffle, no corpus statistic,
nothing kept between rows.

Nulls and odd rows: a null text counts as an empty one, has no words or tokens
and fails the plain rules. A null or unknown language is judged by script.
Repeated rows are each judged. Other columns pass through `judge`; columns
named like its outputs are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from reconlake.llm.tokens import VOCABULARY, Encoder, encoder, vocabulary


class Slack(NamedTuple):
    """Of characters per token, fallback share and bits of entropy."""

    chars: float
    share: float
    bits: float


MIN_WORDS = 50
MAX_REPEATED = 50  # percent
ERROR, SHARE_ERROR = 4.0, 0.3  # of one token
SLOPE, MOST_SHARE, MOST_FLOOR = 0.2, 0.75, 6.5  # of the entropy's floor, see entropy_floor
QUANTILE = 0.002  # of good texts beyond a bound
SLACK = Slack(0.15, 0.015, 0.03)  # what is allowed beyond that


class Band(NamedTuple):
    """Accepted characters per token, the largest share of fallback tokens, and where the entropy's floor starts."""

    least: float
    most: float
    fallback: float
    entropy: float


#: Fitted values, see fit_bands; the largest characters per token is that of any prose.
MOST = 5.5
BANDS = {
    "en": Band(2.52, MOST, 0.015, 4.35),
    "de": Band(2.57, MOST, 0.016, 4.35),
    "fr": Band(2.28, MOST, 0.015, 4.15),
    "es": Band(2.31, MOST, 0.015, 4.24),
}
#: Looser by a tenth than the loosest of the languages; other scripts have fewer characters a token, which may be bytes.
LATIN, OTHER = Band(2.05, MOST, 0.06, 4.15), Band(0.5, 4.0, 0.6, 3.6)

SYMBOL = re.compile(r"[#*$%&|<>]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BEYOND_LATIN = re.compile(r"[^\x00-ɏḀ-⃏]")

SIGNALS = StructType(
    [StructField(n, LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens")]
    + [StructField(n, DoubleType()) for n in ("chars_per_token", "fallback_share", "token_entropy")]
    + [StructField(n, BooleanType()) for n in ("base_failed", "kept")]
)


def repeated_words(words: list[str], n: int = 3) -> int:
    """Number of words inside n-word windows that occur twice or more, the first occurrence included."""
    if len(words) <= n:
        return 0
    ids: dict[str, int] = {}
    numbered = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    _, windows = np.unique(numbered, return_inverse=True)
    for k in range(1, n):  # numbers of ever longer windows, so no product exceeds the square of the text's length
        _, windows = np.unique(windows[:-1] * len(ids) + numbered[k:], return_inverse=True)
    twice = np.flatnonzero(np.bincount(windows)[windows] > 1)
    inside = np.zeros(len(words), bool)
    for k in range(n):
        inside[twice + k] = True
    return int(inside.sum())


def duplicate_lines(text: str) -> int:
    """Lines that hold a word and equal an earlier line."""
    lines = Counter(x for x in text.split("\n") if WORD.search(x))
    return sum(lines.values()) - len(lines)


def entropy_floor(n_tokens: int, base: float) -> float:
    """In bits: MOST_SHARE of the possible for short texts, then `base` and SLOPE for each doubling, at most MOST_FLOOR."""
    bits = math.log2(n_tokens)
    return min(MOST_SHARE * bits, base + SLOPE * bits, MOST_FLOOR)


def inside(band: Band, n: int, per_token: float, fallback: float, entropy: float) -> bool:
    """Do the measures of n tokens lie in the band?"""
    error = 1 / math.sqrt(n)
    return (
        band.least - ERROR * error <= per_token <= band.most + ERROR * error
        and fallback <= band.fallback + SHARE_ERROR * error
        and entropy >= entropy_floor(n, band.entropy)
    )


def band_of(text: str, lang: str | None, bands: dict[str, Band]) -> Band:
    found = bands.get(lang) if isinstance(lang, str) else None
    return found or (OTHER if 2 * len(BEYOND_LATIN.findall(text)) > len(text) else LATIN)


def signals(text: str | None, lang: str | None, enc: Encoder, bands: dict[str, Band]) -> tuple:
    """The fields of SIGNALS of one text."""
    text = text or ""
    words = WORD.findall(text)
    repeated = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeated > MAX_REPEATED * len(words)
    ids = enc.encode(text)
    n = len(ids)
    counts = np.unique(ids, return_counts=True)[1] / max(n, 1)
    entropy = max(0.0, float(-(counts * np.log2(counts)).sum()))  # not -0.0
    per_token, fallback = (len(text) / n, float(enc.fallback[ids].mean())) if n else (0.0, 0.0)
    kept = not failed
    if kept and n >= 2:
        kept = inside(band_of(text, lang, bands), n, per_token, fallback, entropy)
    n_symbols = len(SYMBOL.findall(text))
    return len(words), sum(map(len, words)), n_symbols, duplicate_lines(text), repeated, n, per_token, fallback, entropy, failed, kept


def _judge(sent, bands: dict[str, Band]):
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        enc = encoder(sent)
        for texts, langs in batches:
            yield pd.DataFrame([signals(t, g, enc, bands) for t, g in zip(texts, langs)], columns=SIGNALS.names)

    return F.pandas_udf(judge, SIGNALS).asNondeterministic()  # so that no rewrite of the plan runs it twice


def measured(spark: SparkSession, text: Column, lang: Column, vocab: str = VOCABULARY, bands: dict[str, Band] = BANDS) -> Column:
    """Struct of SIGNALS."""
    return _judge(vocabulary(spark, vocab), bands)(text, lang.cast("string"))


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", vocab: str = VOCABULARY, bands: dict[str, Band] = BANDS) -> DataFrame:
    """`docs` with the columns of SIGNALS; `kept` is the verdict."""
    found = docs.withColumn("__signals", measured(docs.sparkSession, F.col(text), F.col(lang), vocab, bands))
    return found.withColumns({n: F.col("__signals")[n] for n in SIGNALS.names}).drop("__signals")


def fit_bands(good: DataFrame, lang: str = "lang") -> dict[str, Band]:
    """Bands of each language from judged texts (SIGNALS) that are known to be good and pass the plain rules; one small row for each language comes to the driver."""
    n = F.col("n_tokens")
    error, bits = 1 / F.sqrt(n), F.log2(n)
    rows = good.where(~F.col("base_failed") & (n >= 2) & F.col(lang).isNotNull()).groupBy(lang).agg(
        F.percentile(F.col("chars_per_token") + ERROR * error, QUANTILE).alias("least"),
        F.percentile(F.col("fallback_share") - SHARE_ERROR * error, 1 - QUANTILE).alias("fallback"),
        F.percentile(F.col("token_entropy") - SLOPE * bits, QUANTILE).alias("entropy"),
    )
    return {r[lang]: Band(r["least"] - SLACK.chars, MOST, max(0.0, r["fallback"]) + SLACK.share, r["entropy"] - SLACK.bits) for r in rows.collect()}
