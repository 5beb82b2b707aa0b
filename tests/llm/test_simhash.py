import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import simhash


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(ids, prints, most=4):
    label = list(range(len(ids)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= most:
                label[root(a)] = root(b)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return {(ids[k], f"{prints[k]:016x}", least.get(root(k))) for k in range(len(ids))}


def rows_of(df):
    return {(r.doc_id, r.fingerprint, r.component_id) for r in df.collect()}


def test_whole_table_against_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = plain_components([r.doc_id for r in rows], [plain_fingerprint(r.text) for r in rows])
    assert rows_of(simhash.near_duplicates(docs)) == want


def test_odd_rows(docs_of):
    texts = [(5, None), (3, " \n"), (None, ""), (4, "A b"), (2, "a B"), (None, "only here"), (9, "w " * 50_000), (9, "w " * 50_000)]
    docs = docs_of(texts).withColumn("fp", F.lit("clash"))
    want = plain_components([i for i, _ in texts], [plain_fingerprint(t) for _, t in texts])
    assert rows_of(simhash.near_duplicates(docs)) == want
    assert simhash.near_duplicates(docs).count() == len(texts)
    assert simhash.near_duplicates(docs_of([])).count() == 0
    kept = simhash.one_of_each(docs_of(texts).withColumn("_copy", F.lit(1)))
    assert sorted((r.doc_id for r in kept.collect() if r.doc_id is not None)) == [2, 3, 9]
    assert kept.where("doc_id IS NULL").count() == 2 and "_copy" in kept.columns


def test_links_join_what_all_pairs_join(spark):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    codes = [int(s) for s in seeds]
    for s in seeds:  # chains of small steps, one of them long
        x = int(s)
        for _ in range(12 if s != seeds[0] else 300):
            for b in rng.choice(64, rng.integers(1, 7), replace=False):
                x ^= 1 << int(b)
            codes.append(x)
    codes = sorted(set(codes))
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    prints = spark.createDataFrame([(c,) for c in signed], "fp long")
    for group_rows, chunk_rows in ((256, 4096), (4, 8)):
        edges = simhash.links(prints, 4, group_rows, chunk_rows)
        got = {r.node: r.label for r in simhash.components(edges).collect()}
        pairs = [(r.a, r.b) for r in edges.collect()]
        assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 4 for a, b in pairs)
        classes = {}
        for s in signed:
            classes.setdefault(got.get(s, s), set()).add(s)
        want = {}
        for s, _, label in plain_components(signed, [c & (2**64 - 1) for c in signed]):
            want.setdefault(label, set()).add(s)
        assert sorted(map(sorted, classes.values())) == sorted(map(sorted, want.values()))


def test_gray_index_finds_all():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    codes = np.unique(np.concatenate([base ^ (np.uint64(1) << np.uint64(k)) for k in range(0, 64, 7)]))
    assert (np.diff(np.sort(simhash.gray_rank(codes))) > 0).all()
    index = simhash.GrayIndex(codes)
    got = {(int(q), int(index.codes[m])) for qs, ms in index.search(base, 3, block=64) for q, m in zip(qs, ms)}
    want = {(q, int(c)) for q in range(len(base)) for c in codes if int(base[q] ^ c).bit_count() <= 3}
    assert got == want
