import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import cross_entropy, language_id, toxicity


def held(doc_id, modulus, value):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % modulus == value


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def test_held_out_languages(docs):
    want = {r.doc_id: r for r in docs.collect()}
    # Languages of held-out rows say something else: no prediction may change.
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    changed = docs.withColumn("lang", F.when(rest == 2, F.lit("zz")).otherwise(F.col("lang")))
    got = language_id.held_out_predictions(changed).collect()
    assert len(got) == len(want)
    right = total = 0
    for r in got:
        row = want[r.doc_id]
        assert r.held_out == held(r.doc_id, 4, 2) and 0 <= r.score <= 1 and r.lang_pred != "zz"
        lettered = any(c.isalpha() for c in row.text or "")
        assert (r.lang_pred == "und") == (not lettered)
        if r.held_out and lettered and row.lang is not None:
            total += 1
            right += r.lang_pred == row.lang
    assert right >= 0.9 * total > 0
    again = language_id.held_out_predictions(docs.repartition(3)).collect()
    assert {(r.doc_id, r.lang_pred) for r in again} == {(r.doc_id, r.lang_pred) for r in got}


def test_languages_of_odd_rows(docs_of):
    texts = [None, "", "123 !?", "the cat and the dog " * 20_000, "the cat", "the cat", (None, "the dog")]
    rows = docs_of(texts).withColumn("lang_pred", F.lit("clash"))
    model = language_id.learn(rows)
    got = [tuple(r) for r in language_id.predict(rows, model).select("doc_id", "lang_pred").collect()]
    assert sorted(got, key=str) == sorted([(0, "und"), (1, "und"), (2, "und"), (3, "en"), (4, "en"), (5, "en"), (None, "en")], key=str)
    assert language_id.learn(docs_of([])) is None
    assert language_id.held_out_predictions(docs_of([])).count() == 0
    assert {r.lang_pred for r in language_id.predict(rows, None).collect()} == {"und"}


def test_codewords_keep_apart():
    for n in (2, 5, 9, 40):
        code = language_id.codewords(n)
        assert len({tuple(row) for row in code}) == n


def plain_losses(texts, target):
    """Bigram losses with dictionaries in place of hashed classes."""
    tokens = [(t or "").lower().split() for t in texts]
    pairs = [list(zip([None, *ws[:-1]], ws)) for ws in tokens]
    counts = []
    for chosen in (range(len(texts)), target):
        word, context, pair = Counter(), Counter(), Counter()
        for k in chosen:
            for b, w in pairs[k]:
                word[w] += 1
                context[b] += 1
                pair[b, w] += 1
        counts.append((word, context, pair))
    sizes = [sum(c[0].values()) for c in counts]
    factor = [sizes[1] / sizes[0], 1.0]
    vocabulary = len(counts[0][0])
    out = []
    for ws in pairs:
        row = []
        for (word, context, pair), f in zip(counts, factor):
            total = 0.0
            for b, w in ws:
                unigram = (f * word[w] + 0.5) / (sizes[1] + 0.5 * vocabulary)
                total -= math.log((f * pair[b, w] + 32 * unigram) / (f * context[b] + 32))
            row.append(total / max(1, len(ws)))
        out.append((len(ws), *row))
    return out


def test_cross_entropy_equals_plain_counts(docs_of):
    texts = ["red blue red blue green", "red blue", "Blue green blue green", "", None, "one two three two one", "red " * 3000]
    ids = list(range(len(texts)))
    rows = docs_of(texts).withColumn("target", F.lit("clash")).repartition(3)
    chosen = rows.where("doc_id IN (0, 1)").select("doc_id")
    got = {r.doc_id: r for r in cross_entropy.scores(rows, cross_entropy.learn(rows, chosen)).collect()}
    for k, (n, background, target) in zip(ids, plain_losses(texts, [0, 1])):
        assert got[k].n_tokens == n
        assert got[k].background_loss == pytest.approx(background, rel=1e-4)
        assert got[k].target_loss == pytest.approx(target, rel=1e-4)
        assert got[k].difference == pytest.approx(target - background, abs=1e-4)
    assert got[0].difference < got[5].difference


def test_cross_entropy_of_odd_tables(docs_of):
    rows = docs_of([None, "", "a b", "a b", (None, "a b")])
    none = cross_entropy.scores(rows, cross_entropy.learn(rows, rows.where("false").select("doc_id"))).collect()
    assert len(none) == 5 and all(r.difference == 0 for r in none)
    assert sum(r.n_tokens == 0 and r.target_loss == 0 for r in none) == 2
    empty = docs_of([])
    assert cross_entropy.scores(empty, cross_entropy.learn(empty, empty.select("doc_id"))).count() == 0


def test_cross_entropy_of_many_words(docs_of):
    # More distinct words and bigrams than 2 ** 18 classes could keep apart.
    texts = [" ".join(f"w{k}" for k in range(low, low + 20_000)) for low in range(0, 400_000, 20_000)] + ["w1 w2 new w9"]
    rows = docs_of(texts)
    chosen = rows.where("doc_id < 3").select("doc_id")
    models = cross_entropy.learn(rows.where("doc_id < 20"), chosen)
    assert models.pairs.count() == models.words.count() == 400_000
    got = {r.doc_id: r for r in cross_entropy.scores(rows, models).collect()}
    for k, (n, background, target) in enumerate(plain_losses(texts[:20], [0, 1, 2])):
        assert got[k].n_tokens == n
        assert got[k].background_loss == pytest.approx(background, rel=1e-6)
        assert got[k].target_loss == pytest.approx(target, rel=1e-6)
    assert got[20].n_tokens == 4 and got[20].target_loss > got[0].target_loss


def test_held_out_toxicity(docs, labels):
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    # Turned labels of held-out rows must not change a score.
    turned = labels.withColumn("toxic", F.when(rest == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    got = {r.doc_id: r for r in toxicity.held_out_scores(docs, labels).collect()}
    again = {r.doc_id: r for r in toxicity.held_out_scores(docs, turned).collect()}
    assert len(got) == docs.count()
    for k, r in got.items():
        assert r.held_out == held(k, 5, 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert again[k].score == pytest.approx(r.score, abs=1e-6)
    truth = {r.doc_id: r.toxic for r in labels.where("toxic IS NOT NULL").collect()}
    bad = [got[k].score for k, y in truth.items() if y == 1 and k in got and got[k].held_out]
    good = [got[k].score for k, y in truth.items() if y == 0 and k in got and got[k].held_out]
    assert bad and good
    above = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good))
    assert above >= 0.9


def test_toxicity_of_odd_tables(spark, docs_of):
    rows = docs_of([None, "", "a b c", "a b c", (None, "a b"), (9, "word " * 50_000)]).withColumn("score", F.lit("clash"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.held_out_scores(rows, none).collect()
    assert len(got) == 6 and all(r.score == 0 and r.predicted == 0 for r in got)
    some = spark.createDataFrame([(2, 0, 1), (2, 0, 0), (3, 1, 0), (None, 1, 1), (9, 1, None), (77, 0, 1)], none.schema)
    assert toxicity.held_out_scores(rows, some).count() == 6
    assert toxicity.held_out_scores(docs_of([]), some).count() == 0
