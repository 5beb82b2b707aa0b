import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import near_copies
from ledgerloom.llm.simhash import GrayIndex, gray_order


def plain_set(text):
    words = (text or "").lower().split()
    return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def plain_kept(rows):
    """Smallest ids of the components of all pairs at 0.8 or more."""
    sets = [plain_set(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if sets[a] == sets[b] or shared >= 0.8 * (len(sets[a]) + len(sets[b]) - shared):
                label[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(i, least.get(root(k), i))
    return sorted(least.values())


def test_edited_copies_against_all_pairs(spark, docs_of):
    rng = random.Random(4)
    rows = []
    for _ in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(40, 400))]
        rows.append(" ".join(words))
        for _ in range(3):  # similarities on both sides of 0.8
            copy = list(words)
            for at in rng.sample(range(len(copy)), max(1, len(copy) * rng.randrange(1, 6) // 100)):
                copy[at] = f"x{rng.randrange(5000)}"
            rows.append(" ".join(copy))
    rng.shuffle(rows)
    rows += [None, "", "A b", "a  B", "only here"]
    docs = docs_of(rows)
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert kept == plain_kept(list(enumerate(rows)))


def test_chunks_of_a_large_group_all_meet(spark, docs_of):
    base = [f"w{k}" for k in range(200)]
    docs = docs_of([" ".join(base[:k] + ["odd"] + base[k + 1 :]) for k in range(0, 200, 4)])
    codes = near_copies._codes(docs).withColumn("label", F.col("key"))
    keys = [r.key for r in codes.collect()]
    got = {(r.a, r.b) for r in near_copies.candidates(codes, True, 4, 8).collect()}
    assert got == {(a, b) for a in keys for b in keys if a < b}


def test_null_ids_stay(docs_of):
    docs = docs_of([(3, "one two three"), (None, "one two three"), (None, "x"), (2, "One two three"), (2, "One two three")])
    assert sorted(str(r.doc_id) for r in near_copies.one_of_each(docs).collect()) == ["2", "None", "None"]


def test_dense_texts_below_the_similarity_make_few_pairs(docs_of):
    """Texts at about 0.7 of each other are compared, but not handed on as pairs."""
    rng = random.Random(6)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(80):
        words = list(base)
        for at in rng.sample(range(0, 150, 6), 6):
            words[at] = f"x{k}y{at}"
        rows.append(" ".join(words))
    docs = docs_of(rows)
    codes = near_copies._codes(docs)
    sets = near_copies._sets(docs, codes)
    named = codes.withColumn("label", F.col("key")).join(near_copies.sketches(sets), "key")
    handed = near_copies.candidates(named, True, 4, 16).collect()
    assert len(handed) < 0.05 * 80 * 79 / 2
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup(docs.sparkSession, docs, "").collect())
    assert kept == plain_kept(list(enumerate(rows)))


def test_empty_table_long_texts_repeats_and_clashing_columns(docs_of):
    assert near_copies.one_of_each(docs_of([])).count() == 0
    long = "".join(f"w{k} " for k in range(30_000))
    docs = docs_of([(1, "a b c d e f"), (1, "a b c d e f"), (5, long + "x"), (4, long + "y"), (7, None)])
    docs = docs.withColumn("key", F.lit("k")).withColumn("label", F.lit(2)).withColumn("code", F.lit(None).cast("int"))
    out = near_copies.one_of_each(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 4, 7]


def test_sketches_never_rule_out_similar_sets():
    import numpy as np

    from ledgerloom.llm.wordhash import bitmap

    rng = np.random.default_rng(1)
    for size in (1, 5, 40, 300, 5000):
        for part in (0.8, 0.85, 0.95, 1.0):
            shared = rng.integers(0, 1 << 63, max(1, int(np.ceil(part * size))), dtype=np.uint64)
            other = np.concatenate([shared, rng.integers(0, 1 << 63, size - len(shared), dtype=np.uint64)])
            made = [np.int64(len(x)).tobytes() + bitmap(x, near_copies._BITS) for x in (shared, other)]
            assert near_copies._within_reach(made, np.array([0]), np.array([1])).all()


def wide_codes(n, seed=3):
    """Half of the codes lie around one of them, the others anywhere."""
    rng = np.random.default_rng(seed)
    codes = rng.integers(0, 2**64, (n, 4), dtype=np.uint64)
    flips = np.packbits(rng.random((n // 2, 256)) < 0.12, axis=1).view(np.uint64)
    codes[: n // 2] = codes[0] ^ flips
    return codes


def test_wide_codes_are_found_through_the_gray_index():
    codes = wide_codes(301)
    apart = sum(np.bitwise_count(codes[:, None, w] ^ codes[None, :, w]).astype(int) for w in range(4))
    want = {(a, b) for a, b in zip(*np.nonzero(apart <= near_copies.MAX_BITS)) if a < b}
    for turn in (0, 5, 31):
        index = GrayIndex(near_copies.turned(codes, turn))
        got = [tuple(sorted(p)) for a, b in index.pairs(near_copies.MAX_BITS) for p in zip(a, b)]
        assert len(got) == len(set(got)) and set(got) == want
    # Neighbours in the order differ in one bit of the reflected code, and nodes hold what their members share.
    small = np.zeros((64, 2), np.uint64)
    small[:, 0], small[:, 1] = np.arange(64) // 8, (np.arange(64) % 8).astype(np.uint64) << np.uint64(61)
    steps = small[gray_order(small)]
    assert (np.bitwise_count(steps[1:] ^ steps[:-1]).sum(axis=1) == 1).all()
    shared, value = index.levels[0]
    for node, members in enumerate(np.split(index.codes, range(16, 301, 16))):
        assert ((members & shared[node]) == value[node] & shared[node]).all()


def test_groups_are_compared_through_the_index(monkeypatch):
    codes = wide_codes(40)
    asked = []

    class Counted(GrayIndex):
        def pairs(self, max_bits):
            asked.append((len(self.codes), max_bits))
            return super().pairs(max_bits)

    monkeypatch.setattr(near_copies, "GrayIndex", Counted)
    members = pa.array(
        [[{"key": k, "code": c.tobytes(), "label": k, "sketch": None} for k, c in enumerate(codes)]],
        pa.list_(pa.struct([("key", pa.int64()), ("code", pa.binary()), ("label", pa.int64()), ("sketch", pa.binary())])),
    )
    batch = pa.RecordBatch.from_arrays([members, pa.array([3])], names=["members", "turn"])
    found = [b.num_rows for b in near_copies._compare(False, 12)(iter([batch]))]
    assert asked == [(40, near_copies.MAX_BITS)] and sum(found) >= 15
