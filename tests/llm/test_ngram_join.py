import collections
import itertools
import re

import numpy as np
import pytest

from tests.llm.fixtures import SCHEMA, edited, odd, prose, rows, table
from tidemark.llm import ngram_join as N


def shingles(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(data):
    sets = {r[0]: shingles(r[1]) for r in data}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_equals_brute_force(spark):
    data = rows()
    assert got(N.near_duplicates(table(spark))) == brute(data)


def test_a_large_group_of_near_copies_and_chains(spark):
    base = prose(9, 100)
    data = [(i, edited(base, i, i % 9), None, None, None) for i in range(60)]
    assert got(N.near_duplicates(spark.createDataFrame(data, SCHEMA))) == brute(data)


def test_odd_rows(spark):
    out = collections.Counter(tuple(r) for r in N.near_duplicates(odd(spark)).collect())
    assert out == {(None, 2, None): 1, (None, 0, None): 1, (7, 2, 7): 2, (8, 0, 8): 1}


def test_empty_table(spark):
    assert N.near_duplicates(table(spark, [])).collect() == []


@pytest.mark.parametrize("size", [1, 2, 3, 5, 20, 63, 64, 65, 90, 200, 250, 255, 256, 700, 1023, 1024, 3000, 5000])
def test_linked_sets_share_a_signature(size):
    rng = np.random.default_rng(size)
    counts = rng.integers(0, 50, 1 << N.SLOT_BITS).astype(np.uint32)
    for _ in range(40 if size < 2000 else 12):
        a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
        drop = int(rng.integers(0, size // 4 + 1))
        add = int(rng.integers(0, size // 3 + 1)) if rng.random() < 0.5 else max(0, (size - drop) * 4 // 3 - size)  # every second pair just links
        b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**64, add, dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= 75 * (len(a) + len(b) - both):
            assert np.intersect1d(N._signatures_of(a, counts), N._signatures_of(b, counts)).size
            x, y = (np.frombuffer(N._sketch(v), np.uint64) for v in (a, b))
            assert N._may_link(x, y, len(a), len(b))


def test_sets_share_as_many_signatures_as_the_bound_says():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 50, 4000).astype(np.uint32)
    salt, greatest = np.array([7], np.uint64), N._differ(1023, 1023)
    for d in (0, 1, 5, 60, 170, 171, 172, 200, 250, 280, greatest):
        for _ in range(5):
            both = np.unique(rng.integers(0, 2**64, 900, dtype=np.uint64))
            own = int(rng.integers(0, d + 1))
            a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**64, n, dtype=np.uint64)])) for n in (own, d - own))
            x, _, _, emitted = N._subsets(a, counts[: len(a)], salt, greatest, d)
            y, *_ = N._subsets(b, counts[: len(b)], salt, greatest, d)
            n = 3 * (int(N.PARTS * (greatest + 1)) + 1)
            assert len(np.intersect1d(x, y)) >= n - emitted + 1 - (n - min(len(x), len(y)))
            assert emitted <= n


def test_sketches_differ_in_no_more_places_than_sets_in_elements():
    rng = np.random.default_rng(6)
    for _ in range(200):
        n, m, k = rng.integers(1, 400, 3)
        both = rng.integers(0, 2**64, k, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**64, v, dtype=np.uint64)])) for v in (n, m))
        x, y = (np.frombuffer(N._sketch(v), np.uint64) for v in (a, b))
        words = min(len(x), len(y))
        assert np.bitwise_count(N._folded(x, words) ^ N._folded(y, words)).sum() <= len(np.setxor1d(a, b))
        assert len(x) * 64 >= 2 * len(a)


def test_bitmap_of_ids_keeps_all_that_are_asked_for(spark):
    docs = spark.range(-500, 20_000).selectExpr("id doc_id", "cast(id as string) text")
    asked = spark.range(-500, 20_000, 37).selectExpr("id doc_id")
    kept = {r.doc_id for r in N._maybe_asked(docs, asked).collect()}
    assert set(range(-500, 20_000, 37)) <= kept and len(kept) < 700
    assert N._maybe_asked(docs, asked.limit(0)).count() == 0
