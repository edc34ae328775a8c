"""Clustering, resampling and near-duplicate vectors against brute force, on odd rows and empty tables."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from reconlake.llm import centroids, resampling, spread, vectors
from reconlake.llm.text import alnum_words

VECTORS = "vec_id long, embedding array<float>, cluster string, distance string, n_links string, node string, key string, bucket string"
INF, NAN = float("inf"), float("nan")


def row(i, v):
    return (i, None if v is None else [None if x is None else float(x) for x in v], "a", "b", "c", "d", "e", "f")


# Centroids


def brute_clusters(rows, k, rounds, seed, width, scale=1024.0):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    mark = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    places = [v for _, v in sorted(((mark(i), v) for i, v in kept))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(places))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        places = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(places)]
    out = [(i, nearest(v)) for i, v in kept]
    return sorted((str(i), j, d) for i, (d, j) in out), places


@pytest.fixture(scope="module")
def odd_vectors():
    rng = random.Random(3)
    middle = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.3) for x in rng.choice(middle)]) for i in range(300)]
    rows += [(i, [rng.randint(-2, 2) / 2 for _ in range(6)]) for i in range(300, 400)]  # many ties
    rows += [(500, rows[0][1]), (500, rows[0][1]), (0, rows[1][1]), (None, rows[2][1]), (None, None), (501, None), (502, [])]
    rows += [(503, [1.0] * 5), (504, [1.0] * 7), (505, [0.0] * 6), (506, [NAN] + [0.0] * 5), (507, [INF] + [0.0] * 5), (508, [None] + [0.0] * 5), (509, [-0.0] * 6)]
    return rows


@pytest.mark.parametrize("k, rounds, near", [(8, 10, 3), (5, 4, 1), (1, 2, 3), (20, 6, 19), (40, 3, 4), (3, 0, 2)])
def test_clusters_are_those_of_all_comparisons(spark, odd_vectors, k, rounds, near):
    df = spark.createDataFrame([row(*r) for r in odd_vectors], VECTORS).repartition(5)
    found, places = centroids.cluster(df, k, rounds, 3, 6, near=near)
    want, want_places = brute_clusters(odd_vectors, k, rounds, 3, 6)
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in found.collect()) == want
    assert places.tolist() == want_places


def test_small_blocks_and_inertia(spark, odd_vectors, monkeypatch):
    monkeypatch.setattr(centroids, "BLOCK", 7)
    df = spark.createDataFrame([row(*r) for r in odd_vectors], VECTORS).coalesce(1)
    found, places = centroids.cluster(df, 8, 10, 3, 6)
    want, _ = brute_clusters(odd_vectors, 8, 10, 3, 6)
    rows = centroids.with_inertia(found, places).collect()
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in rows) == want
    of = {}
    for _, j, d in want:
        of[j] = of.get(j, 0) + d
    assert {r.cluster: r.cluster_inertia for r in rows} == of and {r.inertia for r in rows} == {sum(of.values())}
    assert all(r.centroid_sha256 == hashlib.sha256(",".join(map(str, places[r.cluster])).encode()).hexdigest() for r in rows)


def test_bounds_spare_comparisons():
    rng = np.random.default_rng(0)
    middle = rng.integers(-3000, 3000, (12, 16))
    x = middle[rng.integers(0, 12, 2000)] + rng.integers(-300, 300, (2000, 16))
    places = middle + 40
    b = centroids.Bounds.scanned(x, places, 3)
    after = places - 35
    b.moved(centroids._above(centroids.squared(after, places)))
    compared = b.update(x, after)
    want = np.stack([centroids.squared(x, c) for c in after], axis=1).argmin(1)
    assert (b.cluster == want).all() and compared < 2000 * 12 // 4


def test_no_vectors_and_too_large_ones(spark):
    empty = spark.createDataFrame([], VECTORS)
    found, places = centroids.cluster(empty, 8, 10, 3, 6)
    assert found.count() == 0 and len(places) == 0 and centroids.with_inertia(found, places).count() == 0
    two = spark.createDataFrame([row(1, [1, 2]), row(2, [3, 4])], VECTORS)
    assert sorted((r.vec_id, r.distance) for r in centroids.cluster(two, 8, 10, 3, 2)[0].collect()) == [(1, 0), (2, 0)]
    with pytest.raises(Exception, match="magnitude"):
        centroids.cluster(spark.createDataFrame([row(1, [1e30, 0])], VECTORS), 8, 1, 3, 2)


# Resampling


def brute_resample(docs, target, percent, seed, n, buckets, least):
    def hashed(t):
        words = alnum_words(t)
        return len(words), [zlib.crc32(b" ".join(words[i : i + k])) % buckets for k in range(1, n + 1) for i in range(len(words) - k + 1)]

    s, t = [0] * buckets, [0] * buckets
    for _, text in docs:
        for b in hashed(text)[1]:
            s[b] += 1
    for text in target:
        for b in hashed(text)[1]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    rows = []
    for i, text in docs:
        words, found = hashed(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    drawn = fit[: percent * len(fit) // 100]
    rest = fit[len(drawn) :] + [r for r in rows if r[1] < least]
    return sorted(map(repr, [(*r, i + 1) for i, r in enumerate(drawn)] + [(*r, None) for r in rest]))


@pytest.mark.parametrize("n, percent, least, rows_each", [(1, 10, 20, 1 << 20), (2, 50, 0, 4), (1, 100, 1, 3), (1, 0, 0, 5)])
def test_resampling_is_that_of_single_documents(spark, odd_docs, odd_rows, monkeypatch, n, percent, least, rows_each):
    monkeypatch.setattr(resampling, "PARTITION_ROWS", rows_each)
    target = [odd_rows[3][1], None, "", "ünïcödé 漢字 station winter"]
    found = resampling.resample(odd_docs, spark.createDataFrame([(t,) for t in target], "text string"), percent, 2024, n, 97, least)
    got = sorted(repr((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"])) for r in found.collect())
    assert got == brute_resample([(r[0], r[1]) for r in odd_rows], target, percent, 2024, n, 97, least)


def test_frequent_texts_and_empty_tables(spark, no_docs, odd_rows, monkeypatch):
    monkeypatch.setattr(spread, "HOT", 3)
    monkeypatch.setattr(spread, "MOST_HOT", 50)
    docs = [(i, odd_rows[5][1] if i % 3 else odd_rows[i % 30][1]) for i in range(60)]
    none = spark.createDataFrame([], "text string")
    found = resampling.resample(spark.createDataFrame(docs, "doc_id long, text string"), none, 30, 1, 1, 97, 20)
    got = sorted(repr((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"])) for r in found.collect())
    assert got == brute_resample(docs, [], 30, 1, 1, 97, 20)
    assert resampling.resample(no_docs, none, 10, 1).count() == 0


# Near-duplicate vectors


def brute_links(rows, threshold):
    good = []
    for at, (i, v) in enumerate(rows):
        if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array([np.float32(a) for a in v], np.float64)
            good.append((at, i, x / np.sqrt(x @ x)))
    root, n = {at: at for at, *_ in good}, {at: 0 for at, *_ in good}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for p, (a, _, x) in enumerate(good):
        for b, _, y in good[p + 1 :]:
            if len(x) == len(y) and x @ y >= threshold:
                n[a] += 1
                n[b] += 1
                root[find(b)] = find(a)
    ids = {}
    for a, i, _ in good:
        ids.setdefault(find(a), []).append(i)
    least = {r: min((i for i in own if i is not None), default=None) for r, own in ids.items()}
    out = [(i, n.get(at, 0), least[find(at)] if at in root else i) for at, (i, _) in enumerate(rows)]
    return sorted(repr((i, k, c, i == c)) for i, k, c in out)


@pytest.fixture(scope="module")
def near_vectors():
    rng = np.random.default_rng(11)
    base = rng.normal(size=(40, 64))
    rows = [(i, v) for i, v in enumerate(base.tolist())]
    for i in range(200):  # near copies of a few, at cosines around the threshold
        v = base[i % 5]
        noise = rng.normal(size=64)
        noise *= np.linalg.norm(v) / np.linalg.norm(noise) * rng.uniform(0.05, 0.6)
        rows.append((1000 - i, (v + noise).tolist()))
    rows += [(2000 + i, base[7].tolist()) for i in range(50)] + [(5, base[9].tolist()), (5, base[9].tolist()), (None, base[9].tolist()), (None, base[11].tolist())]
    rows += [(3000, (base[7] * 3).tolist()), (3001, [0.0] * 64), (3002, [NAN] * 64), (3003, None), (3004, []), (3005, [1.0] * 3), (3006, [2.0] * 3), (3007, [None] * 64)]
    rows += [(3008, [5.0]), (3009, [-5.0]), (3010, [7.0]), (3011, [INF] + [0.0] * 63), (3012, [1e30] * 64), (3013, [1e-30] * 64)]
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


@pytest.mark.parametrize("part, batch", [(4096, 8192), (16, 20), (3, 1)])
def test_links_are_those_of_all_pairs(spark, near_vectors, part, batch):
    df = spark.createDataFrame([row(*r) for r in near_vectors], VECTORS).repartition(4)
    found = vectors.near_duplicates(df, part=part, batch=batch)
    got = sorted(repr((r.vec_id, r.n_links, r.component_id, bool(r.vec_id is not None and r.kept))) for r in found.collect())
    want = brute_links(near_vectors, 0.95)
    assert got == [w if not w.startswith("(None") else w.replace("True", "False") for w in want]


def test_large_buckets_are_joined_beyond_a_bound(spark, near_vectors, monkeypatch):
    monkeypatch.setattr(vectors, "MAX_LARGE", 0)
    monkeypatch.setattr(spread, "HOT", 5)
    monkeypatch.setattr(spread, "MOST_HOT", 100)
    df = spark.createDataFrame([row(*r) for r in near_vectors], VECTORS)
    n = {r.vec_id: r.n_links for r in vectors.near_duplicates(df, part=8, batch=30).collect() if r.vec_id is not None and 2000 <= r.vec_id < 3000}
    assert set(n.values()) == {51}


def test_recall_near_the_threshold():
    """Of random pairs just above 0.95, in several numbers of components."""
    rng = np.random.default_rng(5)
    for dims in (48, 64, 128):
        a, g = rng.normal(size=(2, 2000, dims))
        a = vectors.unit(a)
        g = vectors.unit(g - np.einsum("ij,ij->i", g, a)[:, None] * a)
        b = 0.951 * a + math.sqrt(1 - 0.951**2) * g
        assert (vectors._first_common(vectors.buckets(a), vectors.buckets(b)) < np.iinfo(np.int64).max).mean() > 0.995


def test_no_vectors(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0
    lone = vectors.near_duplicates(spark.createDataFrame([row(4, None), row(None, None)], VECTORS)).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in lone) == [("4", 0, "4", True), ("None", 0, "None", True)]
