"""Language of a text by error-correcting output codes over character n-grams.

Every language gets a codeword. One linear n-gram classifier per bit tells the
languages with that bit set from the others; decoding sums the weighted logistic
losses of all bits against each codeword and takes the nearest. Texts whose two
nearest codewords are close together are flagged.

Counts are taken over all rows given for learning. What reaches the driver is
bounded by ``buckets`` times the number of languages.

Defined results: ``und`` with score 0 for a null text, a text without a letter,
or if there was nothing to learn from. Null ids, ties and repeated rows are
scored like any other row; of two equally near languages the first by name wins.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import quoted, slices

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_is_letter: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _is_letter
    if _is_letter is None:
        _is_letter = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _is_letter


def grams(texts: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each order the bucket and text number of every n-gram, and which texts have a letter.

    Texts are lower-cased; whatever is no letter counts as one space.
    """
    codes = [np.frombuffer((" " + t.lower()).encode("utf-32-le", "replace"), np.uint32) for t in texts]
    text = np.repeat(np.arange(len(texts)), [len(c) for c in codes])
    chars = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
    letter = _letters()[chars]
    chars = np.where(letter, chars, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    first = np.zeros(len(chars), bool)
    first[np.searchsorted(text, np.arange(len(texts)))] = True
    keep |= first
    has_letter = np.bincount(text[letter], minlength=len(texts)) > 0
    chars, text = chars[keep], text[keep]
    found = []
    for order in ORDERS:
        n = max(0, len(chars) - order + 1)
        value = np.full(n, order * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
        for k in range(order):
            value = (value ^ chars[k : k + n]) * _FACTORS[k]
            value ^= value >> np.uint32(15)
        inside = text[:n] == text[order - 1 : order - 1 + n]
        found.append(((value[inside] & np.uint32(BUCKETS - 1)).astype(np.int64), text[:n][inside]))
    return found, has_letter


@dataclass
class CodeModel:
    languages: list[str]
    #: One row per language, one column per bit; entries are 1 and -1.
    code: np.ndarray
    #: One row per bit, one column per bucket: log-odds of the bit.
    weights: np.ndarray
    #: How much the loss of each bit counts.
    trust: np.ndarray
    #: N-grams after which further ones add no more certainty.
    enough: int = 60
    #: Texts whose best two losses differ by less are ambiguous.
    margin: float = 0.5

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and ambiguity of each text."""
        found, has_letter = grams(texts)
        n = np.zeros(len(texts))
        sums = np.zeros((len(self.weights), len(texts)))
        for bucket, text in found:
            n += np.bincount(text, minlength=len(texts))
            for bit, weights in enumerate(self.weights):
                sums[bit] += np.bincount(text, weights[bucket], minlength=len(texts))
        certain = sums / np.maximum(n, 1) * np.minimum(n, self.enough)
        losses = np.logaddexp(0, -self.code[:, :, None] * certain[None]) * self.trust[None, :, None]
        losses = losses.sum(axis=1)
        best = losses.argmin(axis=0)
        odds = np.exp(losses.min(axis=0) - losses)
        score = np.where(has_letter, 1 / odds.sum(axis=0), 0.0)
        if len(self.languages) > 1:
            two = np.sort(losses, axis=0)[:2]
            ambiguous = ~has_letter | (two[1] - two[0] < self.margin)
        else:
            ambiguous = ~has_letter
        return [self.languages[b] if h else "und" for b, h in zip(best, has_letter, strict=True)], score, ambiguous


def codewords(languages: int, seed: int = 11) -> np.ndarray:
    """A row of 1 and -1 per language: all splits of up to five, else the best of random dense codes."""
    if languages <= 5:
        splits = [[1 if s >> k & 1 else -1 for k in range(languages)] for s in range(1, 1 << max(0, languages - 1))]
        return np.array(splits or [[1]], float).T
    rng = np.random.default_rng(seed)
    bits = max(15, int(np.ceil(10 * np.log2(languages))))
    best, widest = None, -1
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (languages, bits))
        code = code[:, np.abs(code.sum(axis=0)) < languages]
        distance = (code.shape[1] - code @ code.T) / 2
        least = distance[~np.eye(languages, dtype=bool)].min()
        if least > widest:
            best, widest = code, least
    return best


def learn(rows: DataFrame, label_column: str = "lang", text_column: str = "text") -> CodeModel | None:
    """The model from all rows with a label and a text; ``None`` without any."""
    labelled = rows.select(F.col(quoted(label_column)).alias("label"), F.col(quoted(text_column)).alias("text")).where(
        "label IS NOT NULL AND text IS NOT NULL"
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for label, counts in sums.items():
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([label] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])],
                    names=["label", "bucket", "n"],
                )
            sums.clear()

        for batch in slices(batches, 1 << 20):
            names, which = np.unique(np.array(batch.column(0).to_pylist(), object), return_inverse=True)
            if len(sums) > 64:
                yield from flush()
            for bucket, text in grams(batch.column(1).to_pylist())[0]:
                both = np.bincount(which[text] * BUCKETS + bucket, minlength=len(names) * BUCKETS)
                for k, name in enumerate(names):
                    part = both[k * BUCKETS : (k + 1) * BUCKETS]
                    sums[name] = sums[name] + part if name in sums else part.copy()
        yield from flush()

    counted = (
        labelled.mapInArrow(count, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    ).toPandas()
    if counted.empty:
        return None
    languages = sorted(counted["label"].unique())
    counts = np.zeros((len(languages), BUCKETS))
    row = counted["label"].map({name: k for k, name in enumerate(languages)}).to_numpy()
    counts[row, counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    share = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)
    code = codewords(len(languages))
    weights = np.zeros((code.shape[1], BUCKETS))
    for bit in range(code.shape[1]):
        ones, others = code[:, bit] > 0, code[:, bit] < 0
        if ones.any() and others.any():
            weights[bit] = np.log(share[ones].mean(axis=0)) - np.log(share[others].mean(axis=0))
    # A bit that tells its two sides apart more widely counts more.
    apart = np.maximum((code * (share @ weights.T)).mean(axis=0), 1e-3)
    return CodeModel(languages, code, weights.astype(np.float32), apart / apart.mean())


def predict(
    docs: DataFrame, model: CodeModel | None, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per document: id, ``lang_pred``, ``score``, ``ambiguous``."""
    ident = F.col(quoted(id_column))
    if model is None:
        return docs.select(
            ident, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous")
        )
    rows = docs.select(ident, F.coalesce(F.col(quoted(text_column)), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType(
        [
            rows.schema[0],
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("ambiguous", T.BooleanType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 20):
            languages, score, ambiguous = shared.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(languages, pa.string()), pa.array(score), pa.array(ambiguous)],
                names=[id_column, "lang_pred", "score", "ambiguous"],
            )

    return rows.mapInArrow(run, schema)


def held_out_predictions(docs: DataFrame, modulus: int = 4, held: int = 2) -> DataFrame:
    """Predictions for all documents by a model of those whose id isn't held out."""
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus))
    model = learn(docs.where(rest != held))
    return predict(docs, model).select(
        "doc_id", F.coalesce(rest == held, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous"
    )
