"""Cross-entropy difference of a target and a background language model.

Both models are bigram models with Dirichlet smoothing towards unigrams, over
one shared vocabulary: words without case and punctuation, each known by its
64-bit hash, as are bigrams and contexts. The target model counts the documents
marked as target, the background model all documents; background counts are
scaled to the target's size, so both are smoothed alike.

Counts are exact and grow with the corpus. Texts lie in a written table of
slices of some megabytes. Each slice asks once for each word, context and bigram
it holds; questions carry the slice's own counts and travel as packed, sorted
keys to the bucket of the hash space they fall in. A bucket sums them and answers
in the order asked, and each slice then finds the losses of its texts. A key
that all documents share is asked once by a slice, so no bucket is hot, and the
number of buckets follows the size of the texts. Nothing of the vocabulary's size
reaches the driver or a broadcast.

Defined results: a text without words has no tokens and all losses 0. Without a
target document both models are the background's and all differences are 0.
A word that the models have
not seen counts 0. Rows with a null id are background. Repeated rows count each time. An empty table
has no rows. A very long text is a slice of its own. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import quoted, slices, written
from ledgerloom.llm.wordhash import IS_PUNCTUATION, mix, text_bytes, words_of

#: Weight of the unigram model, in tokens.
SMOOTHING = 32.0
#: Bytes of text in a slice, and for each bucket.
SLICE_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20

_WORD = 1  # the kind of a key, in its lowest two bits: bigram, word or context


def _bigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word, the word before it (0 at a text's start), and its row."""
    data, offsets = text_bytes(column)
    words = words_of(data, offsets, drop=IS_PUNCTUATION)
    before = np.zeros(len(words), np.uint64)
    before[1:] = words.hash[:-1]
    first = np.ones(len(words), bool)
    first[1:] = words.text[1:] != words.text[:-1]
    before[first] = 0
    return words.hash, before, words.text


def _keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order; which of them are each word's bigram, word and context (three rows); each word's row."""
    word, before, text = _bigrams(column)
    both = mix(mix(before + np.uint64(1)) + word)
    made = [mix(h + np.uint64(k)) & ~np.uint64(3) | np.uint64(k) for k, h in enumerate((both, word, before))]
    keys, number = np.unique(np.concatenate(made), return_inverse=True)
    return keys, number.reshape(3, len(word)), text


def _packed(values: np.ndarray) -> bytes:
    """64-bit values byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=8 * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, size).T).view(np.uint64).reshape(size)


def _packed_batch(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked_batch(data: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(data) as reader:
        return reader.read_next_batch()


def _sliced(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Written slices of ``docs``: ``slice``, ``n_bytes``, ``ids`` and ``data``, which holds the texts."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("slice"),
        F.col(quoted(id_column)).alias("id"),
        F.coalesce(F.col(quoted(text_column)), F.lit("")).alias("text"),
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE_BYTES):
            ids, texts = batch.column(1), pa.RecordBatch.from_arrays([batch.column(2)], names=["text"])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(0, 1),
                    pa.array([batch.nbytes]),
                    pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                    pa.array([_packed_batch(texts)], pa.binary()),
                ],
                names=["slice", "n_bytes", "ids", "data"],
            )

    schema = T.StructType(
        [
            T.StructField("slice", T.LongType()),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("ids", T.ArrayType(rows.schema["id"].dataType)),
            T.StructField("data", T.BinaryType()),
        ]
    )
    return written(rows.mapInArrow(cut, schema), "slices")


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows one at a time: a batch may hold many slices."""
    for k in range(batch.num_rows):
        yield {name: batch.column(name)[k].as_py() for name in batch.schema.names}


@dataclass
class Models:
    """Counts over the written slices of the documents that ``learn`` was given."""

    slices: DataFrame
    #: Slices with ``target``, the positions of their target documents.
    marked: DataFrame
    source: tuple

    @property
    def pairs(self) -> DataFrame:
        """Counts ``background`` and ``target`` of each distinct bigram, as a table to look at."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in _rows(batch):
                    texts = _unpacked_batch(row["data"]).column(0)
                    word, before, text = _bigrams(texts)
                    target = np.isin(text, row["target"] or []).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(before.view(np.int64)), pa.array(word.view(np.int64)), pa.array(target)],
                        names=["before", "word", "target"],
                    )

        found = self.marked.select("data", "target").mapInArrow(count, "before long, word long, target long")
        return found.groupBy("before", "word").agg(F.count("*").alias("background"), F.sum("target").alias("target"))

    @property
    def words(self) -> DataFrame:
        return self.pairs.groupBy("word").agg(F.sum("background").alias("background"), F.sum("target").alias("target"))


def learn(docs: DataFrame, target_ids: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> Models:
    """Models of all of ``docs``; those with an id in ``target_ids`` count for the target, too."""
    chosen = target_ids.select(F.col(quoted(id_column)).alias("id"))
    sliced = _sliced(docs, id_column, text_column)
    # Only ids meet the target's; the positions found are a small table, broadcast if its files allow it.
    ids = sliced.select("slice", F.posexplode("ids").alias("position", "id")).where("id IS NOT NULL")
    marks = ids.join(chosen, "id", "left_semi").groupBy("slice").agg(F.collect_list("position").alias("target"))
    return Models(sliced, sliced.join(written(marks, "marks"), "slice", "left"), (docs, id_column, text_column))


def _questions(sliced: DataFrame, buckets: int) -> DataFrame:
    """Packed keys and counts of each slice by bucket; ``asks`` and ``counts`` say what a slice is there for."""
    kept = "slice long, bucket int, asks boolean, size int, keys binary, background binary, target binary"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                keys, number, text = _keys(_unpacked_batch(row["data"]).column(0))
                counts = np.zeros((2, len(keys)), np.int64)
                if row["counts"]:
                    counts[0] = np.bincount(number.ravel(), minlength=len(keys))
                    counts[1] = np.bincount(number[:, np.isin(text, row["target"] or [])].ravel(), minlength=len(keys))
                # Buckets are ranges of keys, so each is one stretch of the sorted ones.
                bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                names, starts = np.unique(bucket, return_index=True)
                ends = np.append(starts[1:], len(keys))
                parts = [
                    (int(b), hi - lo, _packed(np.diff(keys[lo:hi], prepend=np.uint64(0))), *(_packed(c[lo:hi]) for c in counts))
                    for b, lo, hi in zip(names, starts, ends)
                ]
                n = len(parts)
                columns = list(zip(*parts)) if parts else [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["slice"]] * n, pa.int64()),
                        pa.array(columns[0], pa.int32()),
                        pa.array([row["asks"]] * n, pa.bool_()),
                        pa.array([int(s) for s in columns[1]], pa.int32()),
                        *(pa.array(c, pa.binary()) for c in columns[2:]),
                    ],
                    names=["slice", "bucket", "asks", "size", "keys", "background", "target"],
                )

    return sliced.select("slice", "data", "target", "asks", "counts").mapInArrow(ask, kept)


_ANSWER = "slice long, bucket int, size int, background binary, target binary, vocabulary long, words long, target_words long"


def _answered(table: pa.Table) -> pa.Table:
    """Answers to one bucket's questions, and a row without a slice with the totals of its words."""
    rows = table.select(["slice", "bucket", "asks", "size"]).to_pylist()
    sizes = [r["size"] for r in rows]
    keys = [np.cumsum(_unpacked(k.as_py(), s), dtype=np.uint64) for k, s in zip(table["keys"], sizes)]
    known, number = np.unique(np.concatenate(keys), return_inverse=True)
    sums = []
    for name in ("background", "target"):
        counts = np.concatenate([_unpacked(c.as_py(), s) for c, s in zip(table[name], sizes)])
        sums.append(np.bincount(number, counts.astype(np.float64), len(known)).astype(np.int64))
    ends = np.cumsum(sizes)
    out = [
        (r["slice"], r["bucket"], r["size"], *(_packed(s[number[end - r["size"] : end]]) for s in sums), None, None, None)
        for r, end in zip(rows, ends)
        if r["asks"]
    ]
    is_word = (known & np.uint64(3)) == _WORD
    totals = [int(np.count_nonzero(sums[0][is_word])), *(int(s[is_word].sum()) for s in sums)]
    out.append((None, rows[0]["bucket"], None, None, None, *totals))
    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = [field.split()[0] for field in _ANSWER.split(", ")]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)


def scores(docs: DataFrame, models: Models, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id, ``n_tokens``, ``target_loss``, ``background_loss``, ``difference``.

    The lower the difference, the closer a document is to the target. Documents
    that the models were learnt from are not cut into slices again.
    """
    asked, learnt = models.slices, models.marked
    if models.source[0] is docs and models.source[1:] == (id_column, text_column):
        every = learnt.select("*", F.lit(True).alias("asks"), F.lit(True).alias("counts"))
    else:
        asked = _sliced(docs, id_column, text_column)
        every = learnt.select("*", F.lit(False).alias("asks"), F.lit(True).alias("counts")).unionByName(
            asked.select("*", F.lit(True).alias("asks"), F.lit(False).alias("counts")), allowMissingColumns=True
        )
    n_bytes = every.select("n_bytes").agg(F.sum("n_bytes")).collect()[0][0] or 0
    questions = _questions(every, 1 + n_bytes // BUCKET_BYTES)
    answers = written(questions.groupBy("bucket").applyInArrow(_answered, _ANSWER), "answers")
    total = answers.where("slice IS NULL").agg(*(F.sum(c) for c in ("vocabulary", "words", "target_words"))).collect()[0]
    vocabulary, background, target = (n or 0 for n in total)
    tokens = float(target or background)
    names = [id_column, "n_tokens", "target_loss", "background_loss", "difference"]

    def loss(counts: np.ndarray, number: np.ndarray, scale: float) -> np.ndarray:
        pair, word, context = (counts[k] * scale for k in number)
        unigram = (word + 0.5) / (tokens + 0.5 * max(1, vocabulary))
        return -np.log((pair + SMOOTHING * unigram) / (context + SMOOTHING))

    def score(own: pa.Table, found: pa.Table) -> pa.Table:
        ids = own["ids"].combine_chunks().flatten()
        keys, number, text = _keys(_unpacked_batch(own["data"][0].as_py()).column(0))
        parts = sorted(found.select(["bucket", "size", "background", "target"]).to_pylist(), key=lambda p: p["bucket"])
        counts = {
            name: np.concatenate([np.zeros(0), *(_unpacked(p[name], p["size"]) for p in parts)])
            for name in ("background", "target")
        }
        n = np.bincount(text, minlength=len(ids))
        mean = []
        for name in ("target" if target else "background", "background"):
            scale = tokens / background if name == "background" and background else 1.0
            each = loss(counts[name], number, scale)
            mean.append(np.bincount(text, each, len(ids)) / np.maximum(n, 1))
        columns = [ids, *(pa.array(c) for c in (n, *mean, mean[0] - mean[1]))]
        return pa.Table.from_arrays(columns, names=names)

    kinds = [docs.select(F.col(quoted(id_column))).schema[0].dataType, T.LongType(), *[T.DoubleType()] * 3]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)])
    return (
        asked.select("slice", "ids", "data")
        .groupBy("slice")
        .cogroup(answers.where("slice IS NOT NULL").groupBy("slice"))
        .applyInArrow(score, schema)
    )


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents with those of label ``quality`` 1 as the target."""
    return scores(docs, learn(docs, labels.where("quality = 1").select("doc_id")))
