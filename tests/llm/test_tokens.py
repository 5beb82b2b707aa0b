import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import packing, token_counts
from ledgerloom.llm.pieces import BATCH_BYTES, TokenCounter, WordEncoder, balanced, parts

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ALPHABET = list("ab ZÉß'stlld  \n\t\r\x0b\x0c\x1c\x1f\x85\xa0 12!#.,ΣςİıéÅ中文字🙂́ 　_²½") + [
    "<|endoftext|>", "<|startoftext|>", "'ll", "'S", " it's", "", "some words here and there "
]


def random_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABET, k=rng.randint(0, 30))) for _ in range(n)]


def test_pieces_equal_the_library():
    texts = random_texts(3000)
    byte, word = Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)
    for size in (1 << 16, 8):
        assert TokenCounter(BYTES, size).count(texts) == [len(byte.encode(t, add_special_tokens=False)) for t in texts]
        assert [np.frombuffer(b, "<u4").tolist() for b in WordEncoder(WORDS, size).encode(texts)] == [
            word.encode(t, add_special_tokens=False).ids for t in texts
        ]


def test_parts_join_to_the_text():
    for text in random_texts(300, 2):
        assert "".join(parts(text, 5)) == text


def test_long_texts_of_other_scripts_are_cut_and_batches_are_of_equal_bytes():
    scripts = ["中文字。你好，世界！", "привет мир и все ", "שלום עולם טוב ", "สวัสดี ครับ ", "안녕 하세요 여러분 ", "नमस्ते दुनिया के लोग "]
    byte, word = Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)
    for text in [*(s * 2_000 for s in scripts), "".join(random.Random(5).choices(scripts, k=2_000))]:
        cut = list(parts(text, 1 << 12))
        assert "".join(cut) == text and max(map(len, cut)) < 5000
        assert TokenCounter(BYTES, 1 << 12).count([text]) == [len(byte.encode(text, add_special_tokens=False))]
        ids = np.frombuffer(WordEncoder(WORDS, 1 << 12).encode([text])[0], "<u4")
        assert ids.tolist() == word.encode(text, add_special_tokens=False).ids
    sizes = [sum(len(t.encode()) for t in batch) for batch in balanced(["字" * 1000] * 1000)]
    assert sum(sizes) == 3_000_000 and max(sizes) <= BATCH_BYTES + 3000


def test_token_counts(docs_of):
    texts = [None, "", "a b", "a b", "é <|endoftext|>", "word " * 40_000, " ".join(random_texts(500, 3))]
    docs = docs_of([*texts, (None, "x y")]).withColumn("n_tokens", F.lit("clash"))
    got = token_counts.token_counts(docs, BYTES).collect()
    library = Tokenizer.from_file(BYTES)
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted(
        (len(t.encode()), n := len(library.encode(t, add_special_tokens=False)), n > 1024)
        for t in [*(t or "" for t in texts), "x y"]
    )
    assert token_counts.token_counts(docs_of([]), BYTES).count() == 0


def check_packing(rows, texts, capacity):
    """Every id lies in one piece, pieces in order, sequences without gaps and not too long."""
    library = Tokenizer.from_file(WORDS)
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert set(by_doc) == set(texts)
    for doc, text in texts.items():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(sequences)


def test_pack_round_trip(spark, docs_of, sf):
    texts = dict(enumerate([None, "", "one", "long " * 9000, "same text", "same text", *random_texts(60, 4)]))
    docs = docs_of(list(texts.items())).withColumn("kind", F.lit(1)).withColumn("part", F.lit(2))
    check_packing(packing.pack(docs, WORDS).collect(), texts, 4096)
    real = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in real.collect()}
    rows = packing.pack(real, WORDS).collect()
    used = check_packing(rows, texts, 4096)
    assert used <= 1.03 * sum(r.length for r in rows) / 4096 + 1


def test_pack_repeated_rows_and_none(docs_of):
    rows = packing.pack(docs_of([(1, "a b c"), (1, "a b c"), (None, "a b c")]), WORDS).collect()
    assert [r.length for r in rows] == [4, 4, 4] and sorted(r.offset for r in rows) == [0, 4, 8]
    assert packing.pack(docs_of([]), WORDS).count() == 0


def test_knapsack_against_all_multisets():
    rng = np.random.default_rng(0)
    for _ in range(20):
        weights = np.unique(rng.integers(1, 8, 3))
        values = rng.random(len(weights))
        best = 0.0
        for a in np.ndindex(*[13 // w + 1 for w in weights]):
            if np.dot(a, weights) <= 13:
                best = max(best, float(np.dot(a, values)))
        value, copies = packing.knapsack(values, weights, 13)
        assert np.isclose(value, best) and copies @ weights <= 13 and np.isclose(copies @ values, value)


def test_patterns_cover_and_are_tight():
    rng = np.random.default_rng(1)
    kinds = np.clip(rng.lognormal(4, 1, 3000).astype(int), 1, 256)
    histogram = {int(k): int(n) for k, n in zip(*np.unique(kinds, return_counts=True))}
    found = packing.patterns(histogram, 256)
    total = {}
    for times, pattern in found:
        assert sum(k * n for k, n in pattern) <= 256
        for k, n in pattern:
            total[k] = total.get(k, 0) + times * n
    assert total == histogram
    assert sum(t for t, _ in found) <= 1.01 * kinds.sum() / 256 + 1
    assert packing.patterns({}, 256) == []
