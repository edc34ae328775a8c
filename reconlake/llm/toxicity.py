"""Toxicity by compression distance.

Two zstandard dictionaries are made from labelled texts: one from ordinary
text, one from toxic text. A text is cut into windows of each size of WINDOWS
in words; a window that compresses to fewer bytes with the toxic dictionary is
closer to toxic text. Wide windows overlap by half, so that no phrase is split
by all of them; single words show words that a wide window hides behind a
chance match. The savings of all windows of a text (their mean, the three
largest, how many reach each of CLEAR bytes) become a score between 0 and 1 by
a logistic curve calibrated on the same labelled texts, and 0.7 is the
threshold of the prediction.

Both dictionaries share a body of common ordinary words and differ in the part
behind it, so that an ordinary window costs the same with either. The toxic
part is made of the stretches of words that are significantly more frequent in
toxic texts than in others, the ordinary part of as many bytes of rarer
ordinary words. Near copies among the labelled texts count once, or else a
copied text's own words would look significant. Each window is preceded by a
fixed marker that both dictionaries hold, since zstandard leaves short input
that barely compresses as it is, which would hide small savings, and followed
by a fixed tail, since no match starts in the last eight bytes of an input.

Fitting takes at most `max_rows` labelled texts of at most `max_bytes` each
(ids in the order of a hash, so the sample is random and repeatable), on the
driver. The model is at most 2 * 80 KB and is broadcast. All texts are scored
whole, row by row, without a shuffle.

Nulls and odd rows: a null or wordless text scores as one without savings. Null
ids are never labelled. Labels of unknown documents are ignored; of rows with
the same id the least text and the greatest label are learned from. Without labels of both kinds the score is the
share of toxic labels (0 if there are none). Other columns of the documents are
left out of `score`'s result.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reconlake.llm.text import utf8

WINDOWS = (8, 1)  # words
CLEAR = (1, 2, 3, 4)  # bytes saved
MAX_ROWS, MAX_BYTES = 6000, 64 << 10
THRESHOLD = 0.7
LEAST_SHARE = 0.4  # of toxic texts among those with a gram of the toxic dictionary
GRAMS = (5, 6, 7, 8)  # bytes, of a word between two spaces
BODY_BYTES, PART_BYTES = 60_000, 16_000
HELD_WORDS, HELD_BYTES = 1 << 17, 48  # how many words, and of what length at most, a worker process remembers the savings of
EDGES = b".,;:!?\"'()"
MARKER = b"<=== every window starts with this line, so that it compresses ===>"
TAIL = b" " + b"\n" * 8


class Model(NamedTuple):
    name: str
    ordinary: bytes
    toxic: bytes
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the first is the intercept


def _words(text: str | None) -> list[bytes]:
    return utf8(text).lower().split()


def _once(rows: Iterable[tuple[str | None, int]]) -> list[tuple[list[bytes], int]]:
    """Words and label of texts, near copies left out."""
    seen: set[int] = set()
    out = []
    for text, label in rows:
        w = _words(text)
        marks = sorted({zlib.crc32(b" ".join(w[i : i + 5])) for i in range(max(1, len(w) - 4))})[:4]
        if seen.isdisjoint(marks):
            out.append((w, label))
        seen.update(marks)
    return out


def _grams(padded: bytes) -> set[bytes]:
    return {padded[i : i + k] for k in GRAMS for i in range(len(padded) - k + 1)}


def _evidence(toxic: int, other: int, share: float) -> float:
    """Log-likelihood ratio of the gram's share among toxic texts being as found rather than `share`; 0 unless LEAST_SHARE are toxic."""
    n = toxic + other
    q = toxic / n
    if q <= max(LEAST_SHARE, share):
        return 0.0
    return n * (q * math.log(q / share) + ((1 - q) * math.log((1 - q) / (1 - share)) if q < 1 else 0.0))


def _stretches(counts: Counter[bytes], evidence: dict[bytes, float]) -> Counter[bytes]:
    """Maximal stretches of words that are covered by their best grams."""
    out: Counter[bytes] = Counter()
    for word, n in counts.items():
        x = b" " + word + b" "
        found = [(i, k, evidence[x[i : i + k]]) for k in GRAMS for i in range(len(x) - k + 1) if x[i : i + k] in evidence]
        best = max((e for *_, e in found), default=0.0)
        covered = bytearray(len(x) + 1)
        for i, k, e in found:
            if e >= 0.4 * best:
                covered[i : i + k] = b"\1" * k
        at = covered.find(1)
        while at >= 0:
            end = covered.find(0, at)
            out[x[at:end]] += n
            at = covered.find(1, end)
    return out


def _joined(parts: Iterable[bytes], most: int) -> bytes:
    """The first parts, up to `most` bytes, the first last: nearer content costs less."""
    held, size = [], 0
    for p in parts:
        if size + len(p) > most:
            break
        held.append(p)
        size += len(p)
    return b"".join(reversed(held))


def dictionaries(rows: list[tuple[list[bytes], int]]) -> tuple[bytes, bytes]:
    """Content of the ordinary and the toxic dictionary."""
    share = sum(y for _, y in rows) / len(rows)
    toxic: Counter[bytes] = Counter()
    other: Counter[bytes] = Counter()
    for words, label in rows:
        (toxic if label else other).update({w.strip(EDGES) for w in words})
    in_toxic: Counter[bytes] = Counter()
    for w, n in toxic.items():
        for g in _grams(b" " + w + b" "):
            in_toxic[g] += n
    least = math.log(len(in_toxic) + 1) + 2  # so that hardly any of all grams passes by chance
    # What is too rare to pass even if no other text has it needs no further counts.
    in_toxic = Counter({g: n for g, n in in_toxic.items() if _evidence(n, 0, share) > least})
    in_other: Counter[bytes] = Counter()
    for w, n in other.items():
        for g in _grams(b" " + w + b" "):
            if g in in_toxic:
                in_other[g] += n
    found = {g: e for g, n in in_toxic.items() if (e := _evidence(n, in_other[g], share)) > least}
    stretches = sorted(_stretches(toxic, found).items(), key=lambda x: (-x[1], x[0]))
    marked = _joined((x for x, _ in stretches), PART_BYTES)
    # A stretch that ordinary texts hold too, but less often, must not be free with the ordinary dictionary.
    frequent = sorted(other.items(), key=lambda x: (-x[1], x[0]))
    ranked = [w + b" " for w, _ in frequent if found.keys().isdisjoint(_grams(b" " + w + b" "))]
    body = _joined(ranked, BODY_BYTES)
    rest = b"".join(sorted(ranked[3000:30_000], key=zlib.crc32)) or b" "
    filler = (rest * (len(marked) // len(rest) + 1))[: len(marked)]
    return body + filler + MARKER, body + marked + MARKER


class Scorer:
    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = self._compress(ordinary), self._compress(toxic)
        self.held: dict[bytes, int] = {}

    @staticmethod
    def _compress(content: bytes):
        p = zstandard.ZstdCompressionParameters(
            compression_level=3, strategy=zstandard.STRATEGY_FAST, min_match=5, window_log=17, hash_log=17, chain_log=17, search_log=6,
            write_checksum=False, write_content_size=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        )
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=p)
        return zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress

    def saved(self, windows: list[bytes]) -> list[int]:
        """Bytes that the toxic dictionary saves over the ordinary one, of each window."""
        a, b, lead = self.ordinary, self.toxic, MARKER + b" "
        return [len(a(w)) - len(b(w)) for w in [lead + w + TAIL for w in windows]]

    def saved_by_word(self, words: list[bytes]) -> list[int]:
        """As `saved`, of each single word; frequent words are compressed once."""
        held = self.held
        new = list({w for w in words if w not in held})
        found = dict(zip(new, self.saved(new)))
        out = [held[w] if w in held else found[w] for w in words]
        for w in new:
            if len(held) < HELD_WORDS and len(w) <= HELD_BYTES:
                held[w] = found[w]
        return out

    def features(self, words: list[bytes]) -> list[float]:
        """Logarithm of the number of words, and for each size of window the mean, the sum of the three largest, the sum, and how many reach each of CLEAR; the latter over the root of the number of windows."""
        out = [math.log1p(len(words))]
        for k in WINDOWS:
            saved = self.saved_by_word(words) if k == 1 else self.saved([b" ".join(words[i : i + k]) for i in range(0, len(words), k // 2)])
            x = np.array(saved or [0])
            root = math.sqrt(len(x))
            out += [float(x.mean()), float(np.sort(x)[-3:].sum()), float(x.sum()) / root, *(float((x >= c).sum()) / root for c in CLEAR)]
        return out


N_FEATURES = 1 + len(WINDOWS) * (3 + len(CLEAR))


def _curve(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def calibrated(features: np.ndarray, labels: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Center, scale and weights of a logistic regression, by Newton's method."""
    center, scale = features.mean(0), np.maximum(features.std(0), 1e-6)
    x = np.column_stack([np.ones(len(features)), (features - center) / scale])
    penalty = np.diag([0.0] + [ridge] * features.shape[1])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = _curve(x @ w)
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + penalty + 1e-9 * np.eye(len(w)), x.T @ (labels - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return center, scale, w


def fit(rows: Iterable[tuple[str | None, int]]) -> Model:
    """Model of labelled texts (text, 1 if toxic)."""
    known = _once(rows)
    labels = np.array([y for _, y in known], float)
    share = float(labels.mean()) if len(labels) else 0.0
    if not 0 < share < 1:
        flat = np.zeros(1 + N_FEATURES)
        flat[0] = 30.0 if share else -30.0
        return Model(uuid.uuid4().hex, MARKER, MARKER, np.zeros(N_FEATURES), np.ones(N_FEATURES), flat)
    ordinary, toxic = dictionaries(known)
    scorer = Scorer(ordinary, toxic)
    return Model(uuid.uuid4().hex, ordinary, toxic, *calibrated(np.array([scorer.features(w) for w, _ in known]), labels))


def labelled(docs: DataFrame, labels: DataFrame, label: str, may_learn: Column, max_rows: int, max_bytes: int) -> list[tuple[str, int]]:
    """At most max_rows texts with their label."""
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & may_learn).select("doc_id", F.col(label).cast("int").alias("__label"))
    ids = ids.groupBy("doc_id").agg(F.max("__label").alias("__label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.where(F.octet_length("text") <= max_bytes).select("doc_id", "text")
    # At most max_rows ids are broadcast.
    found = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("__label").alias("__label"))
    rows = found.orderBy(F.xxhash64("doc_id"), "doc_id").toPandas()
    return list(zip(rows["text"], rows["__label"].astype(int)))


#: The scorer of the model that this worker process used last.
_built: dict[str, Scorer] = {}


def _scores(sent):
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m: Model = sent.value
        if m.name not in _built:
            _built.clear()
            _built[m.name] = Scorer(m.ordinary, m.toxic)
        for texts in batches:
            x = np.array([_built[m.name].features(_words(t)) for t in texts]).reshape(-1, len(m.center))
            yield pd.Series(_curve(m.weights[0] + ((x - m.center) / m.scale) @ m.weights[1:]))

    return F.pandas_udf(scores, "double").asNondeterministic()  # so that no rewrite of the plan runs it twice


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, score and predicted of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col(doc_id).alias("doc_id"), _scores(sent)(F.col(text)).alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0)
    )
