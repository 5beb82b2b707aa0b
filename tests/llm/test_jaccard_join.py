"""The Jaccard join against all pairs."""

import random
import re

import numpy as np
import pytest

from ledgerloom.llm import jaccard_join
from ledgerloom.llm.queries import QUERIES


def plain(rows, percent=90):
    sets = []
    for _, text in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        runs = [tuple(words[k : k + 3]) for k in range(len(words) - 2)] or ([tuple(words)] if words else [])
        sets.append(frozenset(runs))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            low, high = sorted((len(sets[i]), len(sets[j])))
            if low and 100 * low >= percent * high:
                shared = len(sets[i] & sets[j])
                if 100 * shared >= percent * (low + high - shared):
                    parent[root(i)] = root(j)
    least = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(k)] = min(least.get(root(k), doc), doc)
    return sorted(((doc, len(sets[k]), least.get(root(k)) if sets[k] else doc) for k, (doc, _) in enumerate(rows)), key=str)


def joined(frame):
    return sorted((tuple(r) for r in jaccard_join.similar_sets(frame).collect()), key=str)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def texts(seed, per_size=12):
    rng = random.Random(seed)
    found = []
    for size in (3, 10, 11, 12, 13, 14, 20, 24, 40, 90, 200):
        for _ in range(2):
            base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
            for _ in range(per_size):
                cut = rng.randint(0, max(0, size // 8))
                found.append(edited(rng, base[: size - cut] if rng.random() < 0.5 else base, rng.choice([0, 0, 1, 1, 2, size // 30])))
    return found


def test_query_on_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    frame = QUERIES["op13_jaccard_join"](spark, sf)
    assert frame.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(r) for r in frame.collect()), key=str) == plain(rows)


@pytest.mark.parametrize("cell", [3, 1024])
def test_links_near_the_threshold(docs_of, monkeypatch, cell):
    found = texts(1)
    rows = list(enumerate(found))
    monkeypatch.setattr(jaccard_join, "CELL", cell)
    assert joined(docs_of(found).repartition(5)) == plain(rows)


def test_nulls_short_texts_repeats_and_other_columns(spark, docs_of):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (None, "one two"), (6, "one two"), (8, "é b c"), (None, "zz"),
            (9, "long " * 300_000), (10, "long " * 200_000)]
    assert joined(docs_of(rows)) == plain(rows)
    frame = spark.createDataFrame([(4, "a b c", 1, "x"), (3, "A b c", 2, "y")], "doc_id long, text string, node int, tiles string")
    assert joined(frame) == [(3, 1, 3), (4, 1, 3)]


def test_empty_table(docs_of):
    assert joined(docs_of([])) == []


def test_sets_within_the_threshold_share_a_tile():
    rng = np.random.default_rng(2)
    bands = jaccard_join.Bands(90)
    for size in (9, 10, 12, 19, 20, 37, 64, 150, 900, 5000):
        for _ in range(40):
            whole = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            most = int(size / 0.9) - size
            more = rng.integers(0, most + 1)
            other = np.concatenate([whole, rng.integers(0, 1 << 63, more, dtype=np.uint64)])
            a, b = (np.unique(x) for x in (whole, other))
            both = [{int(t) for k in bands.of(len(x)) for t in bands.tiles(x, k) if t} for x in (a, b)]
            assert both[0] & both[1]
