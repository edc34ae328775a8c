"""Public tokenizers on workers.

The vocabulary file is read once on the driver, whose path is a parameter, and
sent to the tasks as bytes (below 2 MB, whatever the corpus); each worker
process builds its encoder once.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import tiktoken
from pyspark.sql import SparkSession

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

#: Fixed value: how byte-level BPE vocabularies of this family split text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """Byte-level BPE over whole texts; special tokens are ordinary text."""

    def __init__(self, ranks: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.size = max(self.ranks.values()) + 1
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        #: Tokens of one byte beyond ASCII: the vocabulary has no token for the character.
        self.fallback = np.zeros(self.size, bool)
        self.fallback[[i for b, i in self.ranks.items() if len(b) == 1 and b[0] > 127]] = True

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), np.uint32)


def vocabulary(spark: SparkSession, path: str = VOCABULARY):
    """Broadcast of (name, bytes) of the vocabulary file at `path` on the driver."""
    with open(path, "rb") as f:
        raw = f.read()
    return spark.sparkContext.broadcast((hashlib.sha256(raw).hexdigest(), raw))


def encoder(sent) -> Encoder:
    """The encoder of a broadcast vocabulary, built once in each worker process."""
    name, raw = sent.value
    if name not in _encoders:
        _encoders[name] = Encoder(raw)
    return _encoders[name]
