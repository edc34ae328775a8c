"""Digests of sets against hashing each as one text."""

import hashlib
import random

import pytest

from reconlake.operators import digests


def whole(ids):
    return hashlib.sha256("\n".join(sorted(i for i in ids if i is not None)).encode()).hexdigest()


@pytest.mark.parametrize("chunk", [1, 50, 4096])
def test_sets_of_any_size(spark, chunk):
    rng = random.Random(1)
    rows = [("a" if rng.random() < 0.7 else rng.choice(["b", None, ""]), rng.choice(["ä", "x", ""]) + str(rng.randint(0, 10**6))) for _ in range(3000)]
    rows += [("a", None), ("none", None), ("one", ""), ("two", "x"), ("two", "x")]
    df = spark.createDataFrame([(k, i, "x", "y") for k, i in rows], "lang string, id string, k string, digest string").repartition(7)
    sets = {}
    for k, i in rows:
        sets.setdefault(k, []).append(i)
    got = {r.lang: (r.n, r.digest) for r in digests.of_sets(df, "id", "lang", chunk=chunk).collect()}
    assert got == {k: (len(ids), whole(ids)) for k, ids in sets.items()}
    assert [tuple(r) for r in digests.of_sets(df, "id", chunk=chunk).collect()] == [(len(rows), whole([i for _, i in rows]))]
    assert [tuple(r) for r in digests.of_sets(df.limit(0), "id").collect()] == [(0, whole([]))] and digests.of_sets(df.limit(0), "id", "lang").count() == 0
