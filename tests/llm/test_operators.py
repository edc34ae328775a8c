"""The text operators against brute force, round trips and held-out labels, on odd rows and on empty tables."""

import datetime
import hashlib
import os
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from reconlake.llm import decontaminate, html_text, mixing, pii, quality, simhash, token_shards, toxicity, url_filter, warc
from reconlake.llm.components import components
from reconlake.llm.queries import op4_toxicity
from reconlake.llm.tokens import VOCABULARY, Encoder

from .conftest import WORDS, prose

KEY = "k"


# --- 1: pseudonyms


def luhn(digits):
    total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(int(c) for c in reversed(digits)))
    return total % 10 == 0


def mod97(iban):
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


PII_ROWS = [
    (1, "Mail bosbt.42@mail8.example.com, card 4041 8949 7460 8795 or 4041894974608795."),
    (2, "Again bosbt.42@mail8.example.com and 4041894974608795; not a card: 4041894974608796"),
    (3, "Call +1 (724) 555-7058 from 42.144.35.254 but 300.1.1.1 is none"),
    (4, "IBAN DE89 3704 0044 0532 0130 00, wrong DE89 3704 0044 0532 0130 01"),
    (5, "SSN 123-45-6789, invalid 000-12-3456, born 1984-02-29 or 29.02.1984, never 1984-02-31"),
    (6, "+49 30 1234 5678 rings"),
    (7, "clean text without any"),
    (8, ""),
    (9, None),
    (None, "bosbt.42@mail8.example.com"),
]


def test_pii_formats_validity_links_and_undo(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in PII_ROWS], "doc_id long, text string, n_email string")
    out = pii.pseudonymise(docs, KEY)
    got = {r.doc_id: r for r in out.collect()}
    text = {k: r.text for k, r in got.items()}
    assert (text[7], text[8], text[9]) == ("clean text without any", "", None)
    mail = re.search(r"\S+@[\w.]+\w", text[1])[0]
    assert mail != "bosbt.42@mail8.example.com" and re.fullmatch(r"[a-z]{5}\.\d\d@mail8\.example\.com", mail)
    assert mail in text[2] and text[None] == mail and (got[1].n_email, got[1].n_card) == (1, 2)
    spaced, plain = re.search(r"\d{4} \d{4} \d{4} \d{4}", text[1])[0], re.search(r"\d{16}", text[1])[0]
    assert spaced.replace(" ", "") == plain != "4041894974608795" and luhn(plain) and plain in text[2] and "4041894974608796" in text[2]
    phone = re.search(r"\+1 \(([2-9]\d\d)\) [2-9]\d\d-\d{4}", text[3])[0]
    assert phone != "+1 (724) 555-7058" and "42.144.35.254" not in text[3] and "300.1.1.1" in text[3]
    assert all(int(x) < 256 for x in re.search(r"from (\S+) but", text[3])[1].split("."))
    iban = re.search(r"IBAN ([A-Z0-9 ]+),", text[4])[1]
    assert iban != "DE89 3704 0044 0532 0130 00" and mod97(iban) == 1 and "0130 01" in text[4]
    assert "123-45-6789" not in text[5] and "000-12-3456" in text[5] and "1984-02-31" in text[5]
    iso = datetime.date.fromisoformat(re.search(r"born (\S+)", text[5])[1])
    dotted = datetime.datetime.strptime(re.search(r"or (\d\d\.\d\d\.\d{4})", text[5])[1], "%d.%m.%Y").date()
    assert iso == dotted != datetime.date(1984, 2, 29)
    assert text[6].startswith("+49 3") and text[6] != "+49 30 1234 5678 rings"
    back = {r.doc_id: r.text for r in pii.pseudonymise(out, KEY, undo=True).collect()}
    assert back == dict(PII_ROWS)


def test_pii_day_first_dates_and_other_columns(spark):
    days = [datetime.date(1900, 1, 13) + datetime.timedelta(37 * i) for i in range(1900)]
    days = [d for d in days if d.day > 12 and d.year < 2100] + [datetime.date(2000, 2, 29), datetime.date(1999, 2, 28), datetime.date(1904, 2, 29)]
    rows = [(i, f"on {d:%d/%m/%Y}.", "mine") for i, d in enumerate(days)] + [(-1, "x " * 400_000 + "31/12/1999", "mine"), (-1, "x " * 400_000 + "31/12/1999", "mine")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __found string")
    out = pii.pseudonymise(docs, KEY)
    got = out.collect()
    assert all(r["__found"] == "mine" and r.n_date == 1 for r in got) and len({r.text for r in got if r.doc_id < 0}) == 1
    new = {r.doc_id: datetime.datetime.strptime(r.text[3:13], "%d/%m/%Y").date() for r in got if r.doc_id >= 0}
    assert all(1900 <= d.year < 2100 and d.day > 12 for d in new.values()) and len(set(new.values())) == len(set(days))
    assert sum(new[i] == d for i, d in enumerate(days)) < 20
    back = {r.doc_id: r.text for r in pii.pseudonymise(out, KEY, undo=True).collect() if r.doc_id >= 0}
    assert back == {i: t for i, t, _ in rows if i >= 0}


def brute_pair(a, b, size_a, size_b, key, tag):
    for r in range(pii.ROUNDS):
        f = int(hashlib.sha256(f"{key}:{tag}:{r}:{b if r % 2 == 0 else a}".encode()).hexdigest()[:12], 16)
        a, b = ((a + f) % size_a, b) if r % 2 == 0 else (a, (b + f) % size_b)
    return a, b


def brute_chars(s, key, tag):
    """Halves change places; each character of one is shifted among its like by the hash of the other."""
    left, right = s[: len(s) // 2], s[len(s) // 2 :]
    for r in range(pii.ROUNDS):
        stream, new = hashlib.sha512(f"{key}:{tag}:{r}:{right}".encode()).hexdigest(), ""
        for i, c in enumerate(left):
            run = next((x for x in pii.LETTERS if x[0] <= c <= x[1]), None)
            n = ord(run[1]) - ord(run[0]) + 1 if run else 0
            new += chr(ord(run[0]) + (ord(c) - ord(run[0]) + int(stream[4 * i : 4 * i + 4], 16)) % n) if run else c
        left, right = right, new
    return left + right


def brute_date(d, key):
    """The class of a date in order, by listing it, and the date that stands where its own place is moved to."""
    kind = lambda x: "leap" if (x.month, x.day) == (2, 29) else "low" if x.day < 10 else "middle" if x.day < 13 else "high"
    like = lambda x: (kind(x), x.month < 10)
    days = [datetime.date(1900, 1, 1) + datetime.timedelta(i) for i in range(73049)]
    by_year = {}
    for x in days:
        if like(x) == like(d):
            by_year.setdefault(x.year, []).append(x)
    years = sorted(by_year)
    tag = f"date {kind(d)} {'short' if d.month < 10 else 'long'}"
    a, b = brute_pair(years.index(d.year), by_year[d.year].index(d), len(years), len(by_year[d.year]), key, tag)
    return by_year[years[a]][b]


def test_pii_against_brute_force(spark):
    rng = random.Random(2)
    days = [datetime.date(1900, 1, 1) + datetime.timedelta(rng.randrange(73049)) for _ in range(60)]
    days += [datetime.date(*x) for x in ((1985, 7, 3), (1990, 1, 2), (2000, 2, 29), (1900, 1, 1), (2099, 12, 31), (1980, 12, 25), (1999, 10, 10), (2001, 11, 9), (1970, 3, 12), (1904, 2, 29))]
    forms = ["{0:%Y-%m-%d}", "{0:%d.%m.%Y}", "{0.day}.{0.month}.{0.year}", "{0:%m/%d/%Y}", "{0.month}/{0.day}/{0.year}"]
    rows = [(i, " and ".join(f.format(d) for f in forms) + (f" and {d:%d/%m/%Y} and {d.day}/{d.month}/{d.year}." if d.day > 12 else ".")) for i, d in enumerate(days)]
    names = ["jürgen", "Zoë.Ñandú_1999", "иван.Петров", "łukasz", "a", "x+y%z", "e\u0301mile"]
    rows += [(1000 + i, f"<{n}@müller.example.de>") for i, n in enumerate(names)]
    docs = spark.createDataFrame([*rows, (2000, "v3.7.1985.1, 32.1.1990, 30/2/1999, 13/13/1990, 0.1.1990, 1.0.1990, 1.1.1899, 29.2.1900")], "doc_id long, text string")
    out = pii.pseudonymise(docs, KEY)
    got = {r.doc_id: r for r in out.collect()}
    for i, d in enumerate(days):
        new = brute_date(d, KEY)
        assert [x for x in re.split(" and |[.]$", got[i].text) if x] == [f.format(new) for f in forms] + ([f"{new:%d/%m/%Y}", f"{new.day}/{new.month}/{new.year}"] if d.day > 12 else [])
        assert got[i].n_date == (7 if d.day > 12 else 5)
    for i, n in enumerate(names):
        assert got[1000 + i].text == f"<{brute_chars(n, KEY, 'email')}@müller.example.de>" and got[1000 + i].n_email == 1
    assert got[2000].text == docs.where("doc_id = 2000").first().text
    back = {r.doc_id: r.text for r in pii.pseudonymise(out, KEY, undo=True).collect() if r.doc_id < 2000}
    assert back == dict(rows)


def test_pii_pairs_are_permutations(spark):
    pairs = spark.range(17 * 43).select(F.floor(F.col("id") / 43).alias("a"), (F.col("id") % 43).alias("b"))
    p = pii.feistel_pair(F.col("a"), F.col("b"), 17, 43, KEY, "t")
    got = {tuple(r) for r in pairs.select(p.alias("p")).select("p.a", "p.b").collect()}
    assert got == {(a, b) for a in range(17) for b in range(43)}
    assert pii.pseudonymise(spark.createDataFrame([], "doc_id long, text string"), KEY).count() == 0


# --- 2: fingerprints and components


def brute_print(text, k, bits=64):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = min(k, len(words))
    counts = Counter()
    n = len(words) - k + 1
    for i in range(n):
        h = xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42)
        counts.update(b for b in range(bits) if h >> b & 1)
    return sum(1 << b for b, c in counts.items() if 2 * c > n)


def brute_groups(prints, radius):
    """Least id of each id's component."""
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = list(prints)
    for i in ids:
        for j in ids:
            if bin(prints[i] ^ prints[j]).count("1") <= radius and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(("tile", "radius"), [(4, 2), (4, 12), (16384, 2)])
def test_simhash_equals_brute_force(spark, odd_docs, odd_rows, tile, radius):
    rng = random.Random(11)
    long = prose(rng, 900).split()
    near = [(500 + i, " ".join(w if rng.random() > i / 60 else "changed" for w in long)) for i in range(30)]  # some within two bits
    odd_rows = [r[:2] for r in odd_rows] + near
    odd_docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(near, "doc_id long, text string"))
    got = simhash.near_duplicates(odd_docs, shingle=3, bits=64, radius=radius, ratio=0.0, repeats=True, tile=tile).collect()
    prints = {i: brute_print(r[1], 3) for i, r in enumerate(odd_rows)}
    groups = brute_groups(prints, radius)
    assert radius > 2 or 2 <= max(Counter(r for i, r in groups.items() if (odd_rows[i][0] or 0) >= 500).values()) < 30
    least = {}
    for i, root in groups.items():
        ids = [odd_rows[j][0] for j, r in groups.items() if r == root and odd_rows[j][0] is not None]
        least[i] = min(ids) if ids else None
    want = Counter((odd_rows[i][0], "%016x" % prints[i], least[i]) for i in prints)
    assert Counter((r.doc_id, r.fp.hex(), r.component_id) for r in got) == want


def test_forest_keeps_every_component():
    rng = np.random.default_rng(3)
    centers = rng.integers(0, 2**63, 20, dtype=np.uint64)
    fps = np.unique(np.concatenate([centers] + [centers ^ (np.uint64(1) << np.uint64(b)) for b in rng.integers(0, 64, 12).tolist()]))
    for first in (len(fps), len(fps) // 2):
        found = simhash.forest(fps.reshape(-1, 1), np.ones(len(fps), np.int64), first, 2, 0.0)
        assert len(found) < len(fps)
        want, got = list(range(len(fps))), list(range(len(fps)))

        def join(root, i, j):
            a, b = root[i], root[j]
            for k, r in enumerate(root):
                if r == max(a, b):
                    root[k] = min(a, b)

        for i in range(first):
            for j in range(i + 1, len(fps)) if first == len(fps) else range(first, len(fps)):
                if bin(int(fps[i] ^ fps[j])).count("1") <= 2:
                    join(want, i, j)
        for i, j in found:
            join(got, i, j)
        assert got == want


def test_one_of_each_keeps_one_row_and_all_columns(odd_docs, odd_rows, no_docs):
    got = simhash.one_of_each(odd_docs).collect()
    assert got[0].__fields__ == odd_docs.columns
    ids = Counter(r.doc_id for r in got)
    assert ids[100] == 1 and not {101, 102} & set(ids) and all(ids[i] == 1 for i in range(30)) and max(ids.values()) == 1
    assert simhash.one_of_each(no_docs).count() == 0
    nobody = odd_docs.where("doc_id is null and text is not null")
    assert simhash.one_of_each(nobody.union(nobody)).count() == 1


def exact_groups(texts, least=0.8, k=5):
    """Least index of each text's component under the exact Jaccard similarity of shingles."""
    sets = [set(zip(*(t.lower().split()[i:] for i in range(k)))) for t in texts]
    root = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j in range(i):
            if len(x & sets[j]) >= least * len(x | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


@pytest.mark.parametrize("batch", [1 << 21, 500])
def test_near_duplicates_are_exactly_those_at_the_ratio(spark, monkeypatch, batch):
    monkeypatch.setattr(simhash, "BATCH", batch)
    rng, texts = random.Random(11), []
    for n in range(60):  # pairs from 0.72 to 0.9, most of them near 0.8; a chain that links only from text to text
        words = prose(rng, 104).split()
        cut = [9, 10, 11, 11, 12, 13, 15][n % 7]
        texts += [" ".join(words), " ".join(words[:-cut] + prose(rng, cut).split())]
    chain = prose(rng, 200).split()
    texts += [" ".join(chain[i * 8 : i * 8 + 100]) for i in range(12)]
    texts += ["one two three four five six seven eight", "one two three four five six seven eight nine"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = exact_groups(texts)
    linked = sum(want[2 * n] == want[2 * n + 1] for n in range(60))
    assert 10 < linked < 50 and set(want[120:132]) == {120} and want[-2:] == [132, 132]
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()} == dict(enumerate(want))
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == sorted(set(want))


@pytest.mark.parametrize("hot", [3, 1000])
def test_components_of_chains_and_stars(spark, monkeypatch, hot):
    monkeypatch.setattr("reconlake.llm.components.HOT", hot)
    links = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(30)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {200 + i: 100 for i in range(30)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 3: decontamination


def brute_hits(items, text, window):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, ids = set(), set()
    for item_id, item in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), item or ""))
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == w[i : i + n]:
                    hit.update(range(j, j + n))
                    ids.add(item_id)
    return len(words), len(hit), sorted(str(x) for x in ids if x is not None)


@pytest.mark.parametrize("part_bytes", [700, 1 << 20])
def test_decontamination_equals_brute_force(spark, part_bytes):
    rng = random.Random(1)
    vocabulary = WORDS[:4]  # few words, so that occurrences overlap and nearly match
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 5, 8, 12])))) for i in range(3, 15)]
    items += [(1, "Élan vital"), (1, "Élan vital"), (None, "copper window"), (2, ""), (2, None), (2, "?!")]
    docs = [(i, " ".join(rng.choices(vocabulary + ["x"] * (i % 7), k=60))) for i in range(40)]
    docs += [(50, "an Élan-VITAL copper  window"), (51, None), (52, ""), (53, "?"), (None, items[0][1]), (50, "an Élan-VITAL copper  window")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for window in (4, 10):
        out = decontaminate.scan(
            spark.createDataFrame([(*d, "c") for d in docs], "doc_id long, text string, hit_spans string"), bench, window=window, max_block_bytes=part_bytes
        ).withColumn("n_hit", decontaminate.n_hit(F.col("hit_spans")))
        got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.hit_items)) for r in out.collect())
        assert got == Counter((i, n, h, tuple(ids)) for i, t in docs for n, h, ids in [brute_hits(items, t, window)])
    assert decontaminate.scan(spark.createDataFrame(docs, "doc_id long, text string"), bench.limit(0)).where(F.size("hit_spans") > 0).count() == 0


# --- 4: toxicity


def test_toxicity_on_held_out_texts(spark):
    rng = random.Random(2)
    bad = ["zorkish", "blaggard", "quimbert"]

    def text(toxic):
        words = prose(rng, rng.randint(20, 300)).split()
        for _ in range(rng.randint(2, 6) * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", "s", "en"]))
        return " ".join(words)

    rows = [(text(i % 5 == 0), int(i % 5 == 0)) for i in range(1200)]
    model = toxicity.fit(rows[:800])
    held = rows[800:] + [("", 0), (None, 0)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(held)], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(held) and all(0 <= r.score <= 1 for r in got.values())
    right = sum(got[i].predicted == y for i, (_, y) in enumerate(held))
    assert right >= 0.97 * len(held) and got[len(held) - 1].predicted == 0
    assert toxicity.score(docs, toxicity.fit([])).agg(F.max("score")).first()[0] < 0.01


def test_toxicity_finds_phrases_in_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("toxic = 1").select("doc_id")
    found = op4_toxicity(spark, folder).where("held_out").join(labels, "doc_id")
    assert found.agg(F.avg((F.col("score") >= 0.7).cast("int"))).first()[0] > 0.85


def test_toxicity_takes_a_bounded_sample(spark):
    docs = spark.createDataFrame([(i, "x" * i) for i in range(1, 60)] + [(None, "n"), (5, "again")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 80)] + [(None, 1), (6, None)], "doc_id long, toxic int")
    got = toxicity.labelled(docs, labels, "toxic", F.col("doc_id") % 3 != 1, 20, 40)
    assert 0 < len(got) <= 20 and all(len(t) <= 40 for t, _ in got)


def test_toxicity_on_odd_rows(spark, odd_docs, odd_rows, no_docs):
    rng = random.Random(4)
    rows = [(prose(rng, 80) + (" zorkish blaggard quimbert" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(200)]
    model = toxicity.fit(rows)
    got = toxicity.score(odd_docs, model)
    assert got.columns == ["doc_id", "score", "predicted"] and toxicity.score(no_docs, model).count() == 0
    assert Counter(r.doc_id for r in got.collect()) == Counter(r[0] for r in odd_rows)
    assert all(0 <= r.score <= 1 for r in got.collect())
    bad = ["zorkish", "blaggard", "quimbert", "zorkish"]
    long = prose(rng, 60_000).split()
    for i, w in enumerate(bad * 40):  # one passage in every 375 words of a very long text
        long.insert(375 * i, w)
    docs = spark.createDataFrame([(1, " ".join(long)), (1, " ".join(long))], "doc_id long, text string")
    assert [r.predicted for r in toxicity.score(docs, model).collect()] == [1, 1]


def test_toxicity_finds_a_word_at_the_end_of_a_window():
    scorer = toxicity.Scorer(b"plain words that are often used " + toxicity.MARKER, b"some other blurg words here " + toxicity.MARKER)
    assert scorer.saved([b"blurg"])[0] > 0 and scorer.saved([b"plain one two three four five six blurg"])[0] < scorer.saved([b"one two three four five six blurg"])[0]


# --- 5: quality


def brute_repeated(words):
    counts = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    return len({j for i in range(len(words) - 2) if counts[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)})


def test_quality_base_counts_equal_brute_force(odd_docs, odd_rows, no_docs):
    got = quality.judge(odd_docs).drop("text").collect()
    assert len(got) == len(odd_rows) and quality.judge(no_docs).count() == 0
    want = Counter()
    for i, t, *_ in odd_rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = brute_repeated(words)
        want[i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), r, len(words) < 50 or 100 * r > 50 * len(words)] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want


def test_quality_bands():
    enc = Encoder(open(VOCABULARY, "rb").read())
    verdict = lambda t, g="en": quality.signals(t, g, enc, quality.BANDS)[-1]
    good = (
        "Early in the morning the ferry left the northern harbour with two cars, a few parcels of letters and a doctor who had slept badly. "
        "Nobody on deck spoke about the storm of last week; instead they watched gulls circle above the breakwater while the engine found its rhythm. "
        "Beyond the lighthouse, fishing boats were already hauling their nets, and somebody waved a yellow coat at us until we were out of sight."
    )
    assert verdict(good) and verdict(good, None)
    assert not verdict(" ".join(w + "%%%" for w in good.split())) and not verdict(" | ".join(good.split()[:30]) * 3)
    assert not verdict("Same words again. " * 60) and not verdict("too short")


def brute_verdict(text, lang, enc):
    """The verdict by its definition, token by token."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if len(words) < 50 or 100 * brute_repeated(words) > 50 * len(words):
        return False
    ids = enc.encoding.encode_ordinary(text)
    raw = {i: b for b, i in enc.ranks.items()}
    n, counts = len(ids), Counter(ids)
    fallback = sum(len(raw[i]) == 1 and raw[i][0] > 127 for i in ids) / n
    entropy = -sum(k / n * np.log2(k / n) for k in counts.values())
    other = sum(c > "\u024f" and not "\u1e00" <= c <= "\u20cf" for c in text)
    band = quality.BANDS.get(lang) or (quality.OTHER if 2 * other > len(text) else quality.LATIN)
    wide = 1 / n**0.5
    floor = min(0.75 * np.log2(n), band.entropy + 0.2 * np.log2(n), 6.5)
    return bool(band.least - 4 * wide <= len(text) / n <= band.most + 4 * wide and fallback <= band.fallback + 0.3 * wide and entropy >= floor)


def test_quality_verdict_equals_brute_force(spark, odd_docs, odd_rows):
    enc, rng = Encoder(open(VOCABULARY, "rb").read()), random.Random(8)
    noisy = [(1000 + i, " ".join(w + rng.choice(["", "%%%", " |", "é", "漢"]) for w in prose(rng, 60 + i).split()), rng.choice(["en", "de", None, "xx"])) for i in range(60)]
    rows = [(i, t, g) for i, t, g, *_ in odd_rows] + noisy
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = Counter((r.doc_id, r.text, r.lang, r.kept) for r in quality.judge(docs).collect())
    want = Counter((i, t, g, brute_verdict(t, g, enc)) for i, t, g in rows)
    assert got == want and len({k[-1] for k in want if k[0] and k[0] >= 1000}) == 2


def test_quality_bands_are_those_of_the_labelled_texts(spark):
    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet").join(labels.where("quality = 1").select("doc_id"), "doc_id")
    found = quality.fit_bands(quality.judge(docs))
    assert {k: tuple(round(x, 3 if i == 2 else 2) for i, x in enumerate(b)) for k, b in found.items()} == quality.BANDS


def test_repeated_words_on_random_texts():
    rng = random.Random(4)
    for _ in range(200):
        words = rng.choices("abcde", k=rng.randint(0, 60))
        assert quality.repeated_words(words) == brute_repeated(words)


# --- 6: mixing


def test_raking_meets_the_targets(spark, odd_docs, no_docs):
    rng = random.Random(5)
    rows = [(i, rng.choice("ab"), rng.choice(["en", "de", None]), rng.choice("xyz"), rng.randint(1, 500)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, topic string, tokens long")
    shares = {"source": {"a": 0.3, "b": 0.7}, "lang": {"en": 0.5}, "topic": {"x": 0.2, "y": 0.2, "z": 0.6}}
    out = mixing.mix(docs, shares, budget=0.2).cache()
    total = out.agg(F.sum("tokens")).first()[0]
    for dim, want in (("source", {"a": 0.3, "b": 0.7}), ("topic", shares["topic"])):
        got = {r[0]: r[1] for r in out.groupBy(dim).agg(F.sum(F.col("tokens") * F.col("probability") * F.col("weight")) / (0.2 * total)).collect()}
        assert all(abs(got[k] - v) < 1e-6 for k, v in want.items())
    drawn = out.where("sampled").agg(F.sum("tokens")).first()[0]
    assert abs(drawn / total - 0.2) < 0.02
    off = mixing.mix(docs, shares, budget=0.2, rounds=0).groupBy("topic").agg(F.sum(F.col("tokens") * F.col("probability") * F.col("weight")) / (0.2 * total)).collect()
    assert any(abs(r[1] - shares["topic"][r[0]]) > 0.05 for r in off)  # not raked at all
    odd = mixing.mix(odd_docs, {"source": None, "lang": {"en": 1.0}, "topic": None}, budget=0.5)
    assert odd.count() == odd_docs.count() and odd.where("probability is null or probability > 1").count() == 0
    assert mixing.mix(no_docs, {"source": None}, budget=0.5).count() == 0


def test_filled_cells_pass_on_what_they_cannot_hold(spark):
    rows = [(i, "x " * 10, t, g) for i, (t, g) in enumerate([("a", "p")] * 50 + [("a", "q")] * 850 + [("b", "p")] * 700 + [("b", "q")] * 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    shares = {"source": {"a": 0.5, "b": 0.5}, "lang": {"p": 0.5, "q": 0.5}}
    cut = mixing.mix(docs, shares, 0.5).agg(F.max("weight"), F.sum(F.col("tokens") * F.col("probability"))).first()
    assert cut[0] > 1 and cut[1] < 9_900
    out = mixing.mix(docs, shares, 0.5, fill=True).withColumn("e", F.col("tokens") * F.col("probability")).cache()
    assert out.agg(F.max("weight")).first()[0] == 1 and abs(out.agg(F.sum("e")).first()[0] - 10_000) < 1
    for dim, of in shares.items():
        got = {r[0]: r[1] / 10_000 for r in out.groupBy(dim).agg(F.sum("e")).collect()}
        assert all(abs(got[v] - of[v]) < 1e-6 for v in of)
    rows = [("a", "p", 500), ("a", "q", 8500), ("b", "p", 7000), ("b", "q", 4000)]
    cells = spark.createDataFrame(rows, "source string, lang string, tokens long")
    targets = {d: spark.createDataFrame([(v, 0.5) for v in of], f"{d} string, target double") for d, of in shares.items()}
    table = mixing._filled_table(cells, targets, 0.5, rounds=2)  # beyond MAX_CELLS cells are raked so
    tokens, codes = np.array([r[2] for r in rows], float), [np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])]
    want = mixing.filled(tokens, codes, [np.array([5000.0, 5000.0])] * 2, rounds=2) / tokens
    got = {(r.source, r.lang): r.ratio for r in table.collect()}
    assert np.allclose([got[r[:2]] for r in rows], want) and want[0] == 1
    values = spark.createDataFrame([(50.0, 10.0), (30.0, 200.0), (20.0, 25.0)], "want double, have double")
    assert sorted(r.w for r in mixing._reachable_table(values).collect()) == pytest.approx([10, 25, 65])
    least = mixing.reachable(np.array([50.0, 30.0, 20.0]), np.array([10.0, 200.0, 25.0]))
    assert np.allclose(least, [10, 65, 25])
    assert mixing.mix(docs.limit(0), shares, 0.5, fill=True).count() == 0


# --- 7: token shards


def test_slots_are_a_permutation():
    for n in (1, 2, 3, 17, 4096, 5001):
        slots = token_shards.permuted(np.arange(n), n, "key")
        assert sorted(slots.tolist()) == list(range(n))
        assert (token_shards.permuted(slots, n, "key", undo=True) == np.arange(n)).all()
    assert (token_shards.permuted(np.arange(5001), 5001, "other") != slots).any()


def test_shards_hold_every_token_once(spark, odd_docs, odd_rows, no_docs):
    length, per = 32, 8
    rows = token_shards.shards(odd_docs, "key", length, per).collect()
    enc = Encoder(open(VOCABULARY, "rb").read())
    want = Counter()
    for i, t, *_ in odd_rows:
        ids = [*enc.encode(t).tolist(), enc.size] if t else []
        for part, at in enumerate(range(0, len(ids), length)):
            want[i, part, tuple(ids[at : at + length])] += 1
    got, slots = Counter(), []
    for r in rows:
        ids = np.frombuffer(r.content, token_shards.id_type(enc.size + 1)).reshape(r.n_sequences, length)
        assert r.first_slot == r.shard * per and len(r.content) == r.n_sequences * length * r.id_bytes
        for k in range(r.n_sequences):
            got[r.doc_ids[k], r.parts[k], tuple(ids[k, : r.lengths[k]].tolist())] += 1
            slots.append(r.first_slot + k)
    assert got == want and sorted(slots) == list(range(sum(want.values())))
    made = spark.createDataFrame(rows, token_shards.SHARDS)
    resumed = token_shards.read_from(made, 11, 9).orderBy("slot").collect()
    assert [r.slot for r in resumed] == list(range(11, 20))
    assert token_shards.shards(no_docs, "key").count() == 0


@pytest.mark.parametrize("split", [1, 2, 7])
def test_slots_do_not_depend_on_the_split(spark, monkeypatch, odd_docs, odd_rows, split):
    monkeypatch.setattr(token_shards, "PARTITION_BYTES", 1 << 16)  # several partitions of text and of shards
    length, per = 32, 8
    made = token_shards.shards(odd_docs.repartition(split), "key", length, per).collect()
    enc = Encoder(open(VOCABULARY, "rb").read())
    found = {r.first_slot + k: (r.doc_ids[k], r.parts[k], r.content[k * length * r.id_bytes :][: r.lengths[k] * r.id_bytes]) for r in made for k in range(r.n_sequences)}
    n = len(found)
    in_order = [found[s] for s in token_shards.permuted(np.arange(n), n, "key").tolist()]
    # Brute force: documents by id, nulls first; texts of one id in either order.
    want = []
    for i, t, *_ in sorted((r for r in odd_rows if r[1]), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.append(enc.encode(t), enc.size).astype(token_shards.id_type(enc.size + 1))
        want += [(i, part, ids[at : at + length].tobytes()) for part, at in enumerate(range(0, len(ids), length))]
    assert [x[0] for x in in_order] == [x[0] for x in want]
    single = [x for x in want if [r[0] for r in odd_rows].count(x[0]) == 1]
    assert [x for x in in_order if x in single] == single and Counter(in_order) == Counter(want)


def test_shard_files_are_read_by_seeking(spark, odd_docs, tmp_path):
    length, per, folder = 32, 8, str(tmp_path / "shards")
    made = token_shards.shards(odd_docs, "key", length, per)
    manifest = token_shards.write_files(made, folder).orderBy("shard").collect()
    whole = b"".join(r.content for r in made.orderBy("shard").collect())
    n, stride = sum(r.n_sequences for r in manifest), manifest[0].stride
    assert len(whole) == n * stride and b"".join(open(f"{folder}/{r.file}", "rb").read() for r in manifest) == whole
    for first, k in ((0, n), (11, 9), (7, 2), (n - 3, 50), (n, 4)):
        assert b"".join(token_shards.read_slots(folder, per, stride, first, k)) == whole[first * stride : (first + k) * stride]
    token_shards.write_files(made, f"file://{folder}")  # a repeated run leaves equal files
    assert len(list((tmp_path / "shards").glob("*.bin"))) == len(manifest)


# --- 8: main text

PAGE = (
    "<!DOCTYPE html><html><head><title>Not me</title><style>p{}</style><script>var t='</p>';</script></head><body><header>Site<nav><ul><li><a href=/>Home"
    "</a></li></ul></nav></header><div id='cookie-notice'>We use cookies</div><article><h1>The &amp; title</h1><p>First   <b>bo</b>ld\n line.<br><p>Unclosed"
    " second paragraph &lt;x&gt; here.<aside class='ad'>Buy now and more and more and more words of an advert</aside><p>Third one <a href='/y'>linked</a>."
    "<form><input><button>Send</button></form></article><section class=comments><p>I liked it very much indeed</p></section><footer>Imprint</footer></body>"
)


def test_main_text_of_pages(spark):
    pages = spark.createDataFrame(
        [(1, PAGE), (2, None), (3, ""), (4, "plain words only"), (5, "<p>cut off <b"), (6, "<nav>only a menu</nav>"), (7, "<!-- open")],
        "page_id long, html string",
    )
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(pages.withColumn("text", F.lit(0))).collect()}
    assert got[1][0] == "The & title First bold line. Unclosed second paragraph <x> here. Third one linked."
    assert [got[i][0] for i in range(2, 8)] == ["", "", "plain words only", "cut off", "", ""]
    assert all(n == len(t) for t, n in got.values())


ARTICLE = "<h1>The title of it all</h1><p>First paragraph with several words in it.</p><p>Second one with many more words than that.</p>"
WORDS_OF = "The title of it all First paragraph with several words in it. Second one with many more words than that."


@pytest.mark.parametrize(
    "page",
    [
        f"<body class='has-sidebar'><nav><ul><li><a>x</a></ul></nav><article>{ARTICLE}</article><footer>words of the foot</footer></body>",
        f"<body class='single tags login-enabled'><article>{ARTICLE}</article></body>",
        f"<div id='search-page'><article>{ARTICLE}</article></div>",
        f"<form action=x><div class=content>{ARTICLE}</div></form>",
        f"<article><header>{ARTICLE.replace('</h1>', '</h1></header>')}</article>",
        f"<div class=post-header>{ARTICLE.replace('</h1>', '</h1></div><div class=post>')}</div>",
        f"<div class='content no-sidebar'>{ARTICLE}</div><div class=left-sidebar>side words words words words words words</div>",
        f"<article class='post comments-open'>{ARTICLE}</article><section class=comments>{'<p>I liked it very much indeed and more so.</p>' * 9}</section>",
        f"<div><a href=1>One</a> <a href=2>Two</a></div><div>{ARTICLE}</div><div><a href=1>One</a><br><a href=2>Two</a></div>",
        f"<article>{ARTICLE.replace('<p>Second', '<div class=ad-slot>Buy this now, it is so very cheap and good</div><p>Second')}</article>",
        f"<body><div class='search-results-article'>{ARTICLE.replace('h1', 'h4')}</div><div class=footer>words of the foot</div></body>",
        f"<div class='legal-notice-text'>{ARTICLE.replace('h1', 'h4')}</div>",
        f"<article>{ARTICLE}<div class=barra-lateral>otros articulos del dia</div></article><section id='kommentare'><p>Das war sehr gut und noch mehr</p></section>",
        f"<article>{ARTICLE.replace('<p>Second', '<p hidden>secret words here</p><p style="color: red; display : none">more of them</p><p>Second')}</article>",
        f"<main>{ARTICLE.replace('<p>Second', '<p title="hidden" data-hidden=1>Second')}</main><div style='visibility:hidden'><h1>{'secret ' * 90}</h1></div>",
    ],
)
def test_main_text_of_layouts(page):
    assert html_text.main_text(page, html_text.learn()) == WORDS_OF


def brute_text(page, w):
    """The whole extraction the long way: all elements around each piece anew, all runs of pieces, all wrappers by counting."""
    steps = list(html_text.events(page))
    around, spans = [], {}  # the start tags that are open at each step, and what each spans
    stack = []

    def close(until):
        while stack and until(stack[-1]):
            spans[stack.pop()][1] = at

    for at, (kind, x, rest) in enumerate(steps):
        before = list(stack)
        if kind == "start":
            while stack and steps[stack[-1]][1] in html_text.CLOSES.get(x, ()):
                spans[stack.pop()][1] = at
            if x not in html_text.VOID:
                stack.append(at)
                spans[at] = [before, len(steps)]
                spans[at][0] = [steps[i][1] for i in stack[:-1]]
        elif kind == "end" and any(steps[i][1] == x for i in stack):
            while steps[stack[-1]][1] != x:
                spans[stack.pop()][1] = at
            spans[stack.pop()][1] = at
        around.append((before, list(stack)))

    def weight(i, by_parts=True):
        _, x, rest = steps[i]
        if x in html_text.OUTER:
            return 0.0
        if html_text.hidden(rest):
            return -html_text.LARGEST
        out = [0.0]
        if x not in html_text.INLINE and not (x == "header" and {"article", "main"} & set(spans[i][0])):
            out.append(w.names.get(f"<{x}>", 0.0))
        for token in html_text.names(rest):
            out += [w.names[token.lower()]] if token.lower() in w.names else [w.names[f] for f in html_text.parts(token) if by_parts and f in w.names]
        return min(out)

    words = [len(x.split()) if kind == "text" else 0 for kind, x, _ in steps]

    def wraps(headed):
        out = set()
        for i, (_, end) in spans.items():
            if weight(i) < html_text.AGAINST and not html_text.hidden(steps[i][2]) and 2 * sum(words[i:end]) >= sum(words):
                if any(kind == "start" and x in html_text.HOLDS for kind, x, _ in steps[i:end]) if headed else weight(i, False) >= html_text.AGAINST:
                    out.add(i)
        return out

    def region(outer):
        least = lambda open_: min([0.0] + [weight(i) for i in open_ if i not in outer])
        pieces, scores = [], []
        for (kind, x, _), (before, after) in zip(steps, around):
            a, b = least(before), least(after)
            if kind == "text":
                pieces.append("" if a < html_text.AGAINST else x)
                scores.append(0.0 if a < html_text.AGAINST else len(x.split()) * max(0.2, w.word + a))
            else:
                pieces.append("" if x in html_text.INLINE else "\0")
                scores.append(0.0 if kind == "gap" or min(a, b) < html_text.AGAINST else w.tags.get(x, w.tag))
        best, at = 0.0, (0, 0)  # of equal sums the first that ends, and of these the shortest
        for j in range(len(scores)):
            for i in range(j, -1, -1):
                total = sum(scores[i : j + 1])
                if total > best + 1e-9:
                    best, at = total, (i, j + 1)
        return " ".join(filter(None, (" ".join(html_text.references.unescape(b).split()) for b in "".join(pieces[at[0] : at[1]]).split("\0"))))

    first = region(wraps(True))
    told = any(kind == "start" and x in html_text.TOLD for kind, x, _ in steps)
    return region(wraps(False)) if (not first or len(first.split()) < html_text.FEW and not told) and wraps(False) != wraps(True) else first


def test_whole_extraction_against_brute_force():
    rng, w = random.Random(8), html_text.learn()
    tags = "div p section article main nav footer header span b li ul h1 h2 form aside body".split()
    said = ["", "", "", " class=content", " class='ad'", " id=sidebar", " class='legal-notice-text'", " class='has-sidebar x'", " hidden", " style='display:none'", " class=comments", " role=navigation"]
    n_texts = 0
    for _ in range(400):
        page = ""
        for _ in range(rng.randint(1, 14)):
            t = rng.choice(tags)
            page += rng.choice([f"<{t}{rng.choice(said)}>", f"<{t}{rng.choice(said)}>", f"</{t}>", "<br>", "<!-- x -->", "<script>y</script>", f"<{t}>"]) + " ".join(rng.choice(["word", "&amp;", "ünï", "more"]) for _ in range(rng.choice([0, 1, 4, 25])))
        got = html_text.main_text(page, w)
        assert got == brute_text(page, w), page
        n_texts += bool(got)
    assert n_texts > 200


def test_no_pages(spark):
    assert html_text.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_the_scan_finds_the_largest_sum():
    rng = random.Random(3)
    for _ in range(300):
        x = [rng.choice([-2.0, -1.0, -0.5, 0.0, 0.5, 1.0, 3.0]) for _ in range(rng.randrange(12))]
        a, z = html_text.best_run(x)
        assert sum(x[a:z]) == max([0.0] + [sum(x[i:j]) for i in range(len(x)) for j in range(i, len(x) + 1)])


def test_the_scan_leaves_out_unnamed_boilerplate():
    links = "".join(f"<div><a href=/{i}>Page {i}</a></div>" for i in range(9))
    page, w = f"<div>{links}</div><div>{ARTICLE}</div><div>{links}</div>", html_text.learn()
    assert html_text.main_text(page, w) == WORDS_OF
    assert "Page 3" in "".join(html_text.scored(list(html_text.events(page)), w, set())[0])  # without the scan it would stay


@pytest.mark.parametrize("step", ['<div class="a b">word ', "<iframe>word ", "<p>x<b>y", '<a "x> ', "</span><div>q ", "<!-- x ", "<script>", "<li class=ad>w "])
def test_main_text_of_unclosed_pages_is_linear(step):
    w = html_text.learn()
    began = time.process_time()
    html_text.main_text(step * 100_000, w)
    assert time.process_time() - began < 20


def test_equal_pages_have_equal_texts(spark):
    rows = spark.createDataFrame([(1, PAGE), (1, PAGE), (2, f"<article>{ARTICLE * 2000}</article>")], "page_id long, html string")
    got = html_text.extract(rows).orderBy("page_id", "text").collect()
    assert got[0] == got[1] and got[2].text == " ".join([WORDS_OF] * 2000)


# --- 9: archives


def test_warc_round_trip_and_kinds(spark):
    rows = [(1, "http://a/é\r\nX: y", "<p>same</p>"), (3, "http://b", "<p>same</p>"), (2, None, "<p>same</p>"), (3, "http://b", "<p>same</p>")]
    rows += [(4, "http://c", None), (5, "http://d", ""), (None, "http://e", "alone"), (6, "http://f", "ünï" * 5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.read(warc.write(pages, archive_bytes=2000)).collect()
    assert len(got) == len(rows)
    kinds = Counter((r.page_id, r.record_type, r.refers_to) for r in got)
    assert kinds == Counter(
        {(1, "revisit", 3): 1, (2, "revisit", 3): 1, (3, "response", None): 2, (4, "revisit", 5): 1, (5, "response", None): 1, (None, "response", None): 1, (6, "response", None): 1}
    )
    by = {r.page_id: r for r in got}
    assert by[1].url == rows[0][1] and by[2].url is None and by[1].payload_bytes == 11 and bytes(by[6].payload) == ("ünï" * 5000).encode()
    assert by[4].payload_digest == warc.digest(b"") and warc.read(warc.write(pages.limit(0))).count() == 0
    assert warc.read(warc.write(pages, min_bytes=12)).where("record_type = 'revisit'").count() == 0


def test_warc_reads_other_writers_archives(spark, tmp_path):
    def made(kind, block, **fields):
        return warc.headers("WARC/1.0", {"WARC-Type": kind, "WARC-Record-ID": "<urn:uuid:1>", "WARC-Date": "2026-01-01T00:00:00Z", **fields, "Content-Length": len(block)}) + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n<p>hello"  # neither a length nor a digest
    long = b"y" * 5_000_000
    records = [
        made("warcinfo", b"software: x\r\n", **{"Content-Type": "application/warc-fields"}), made("request", b"GET / HTTP/1.1\r\n\r\n"),
        made("response", http, **{"WARC-Target-URI": "http://a.org/", "Content-Type": "application/http;msgtype=response"}), made("metadata", b"a: b\r\n"),
        made("resource", long, **{"WARC-Target-URI": "http://b.org/", "Content-Type": "text/plain"}),
    ]
    (tmp_path / "a.warc.zst").write_bytes(warc.archive(records))
    got = {r.url: r for r in warc.read(warc.binary_files(spark, str(tmp_path))).collect()}
    assert set(got) == {"http://a.org/", "http://b.org/"} and bytes(got["http://b.org/"].payload) == long
    r = got["http://a.org/"]
    assert (bytes(r.payload), r.payload_bytes, r.payload_digest, r.record_type) == (b"<p>hello", 8, warc.digest(b"<p>hello"), "response")


def test_warc_reader_rejects_what_is_broken():
    good = [warc.record(i, "http://a", b"payload %d" % i, None, "2026-01-01T00:00:00Z") for i in range(5)]
    whole = warc.archive(good)
    assert list(warc.frames("a", whole)) == good
    for broken in (whole[:5], b"\0" + whole[1:], whole[:-3], whole + b"junk"):
        with pytest.raises(warc.BadArchive):
            list(warc.frames("a", broken))
    for record in (good[0][:-1], good[0].replace(b"WARC-Date", b"X-Date"), good[0].replace(b"WARC/1.1", b"WARC/9"), good[0].replace(b"payload", b"Payload")):
        with pytest.raises(warc.BadArchive):
            warc.parse(record, "a")


# --- 10: urls


@pytest.mark.parametrize("segment_bits", [256, 1 << 23])
def test_cascade_is_exact_on_its_universe(spark, segment_bits):
    keys = spark.range(4000).select(F.concat(F.lit("h"), "id").alias("key"))
    listed = keys.where("xxhash64(key) % 7 = 0").union(spark.createDataFrame([("elsewhere",), (None,)], "key string"))
    rows = keys.union(keys.limit(50)).union(spark.createDataFrame([(None,)], "key string"))
    levels = url_filter.build_cascade(rows, listed, segment_bits)
    assert len(levels) >= 2 and (levels[0].n_segments > 10) == (segment_bits < 1000)
    got = rows.withColumn("listed", url_filter.in_cascade(F.col("key"), levels))
    assert got.where(F.col("listed") != F.expr("key is not null and xxhash64(key) % 7 = 0")).count() == 0 and got.where("listed is null").count() == 0
    marked = url_filter.membership(rows, "key", listed, "listed", segment_bits)
    assert marked.where("listed").count() == got.where("listed").count() and marked.count() == rows.count()
    assert url_filter.build_cascade(rows, listed.limit(0)) == []


def test_url_parts_and_rules(spark):
    rules = [url_filter.Rule(*r) for r in (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "com", "/de/"))]
    urls = [
        ("http://A.Example.ORG/es/1?q", "a.example.org", "/es/1", "example.org/es/", "block"),
        ("http://example.org/en", "example.org", "/en", "org/", "allow"),
        ("http://x.org", "x.org", "", None, "allow"),
        ("https://badexample.com/de/?u=http://y.org/", "badexample.com", "/de/", "com/de/", "block"),
        ("http://spam.net?x", "spam.net", "", None, "block"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("http://tie.example.org/a" + "b" * 200_000, "tie.example.org", "/a" + "b" * 200_000, "tie.example.org/a", "block"),
        ("http://sub.tie.example.org/abc", "sub.tie.example.org", "/abc", "tie.example.org/a", "block"),
    ]
    rules += [url_filter.Rule("block", "tie.example.org", "/a"), url_filter.Rule("allow", "example.org", "/abcdefgh")]  # of equal length
    pages = spark.createDataFrame([(i, u[0], "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: tuple(r)[1:] for r in url_filter.judge(pages, rules, spark.createDataFrame([("spam.net",)], "key string")).collect()}
    assert got == {i: u[1:] for i, u in enumerate(urls)}
    assert url_filter.judge(pages.limit(0), rules, spark.createDataFrame([], "key string")).count() == 0
