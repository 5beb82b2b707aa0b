"""Near copies by five-word shingles: Jaccard similarity of 0.8 or more, checked exactly.

Candidates come from a long SimHash: ``4 * 64`` bits over the set of a text's
shingles. At similarity 0.8 about 39 of 256 bits differ (48 in very short
texts), so ``MAX_BITS`` leaves room. The code is read from ``TURNS`` starting
bits; in each reading, codes in Gray order form contiguous groups by their
leading bits, twelve at most. The members of a group are searched through the
hierarchical index of ``simhash``: sorted by Gray rank of the reading, under
nodes that hold the bits that all members below share, and nodes whose shared
bits differ in more than ``MAX_BITS`` places are pruned. A pair at
similarity 0.8 shares the leading bits of some reading with a chance of 0.99.

Similarity is checked on the whole sets. The first pass checks a spanning forest
of the candidates of each group, the second the candidates that the first has left
apart. There a size and a bitmap of hashed shingles stand for each set: bit counts
bound the overlap from above, and only pairs that may reach the similarity are
handed on, each from the first reading that it shares. Texts of a dense group
below the similarity are thus compared inside their tasks, and no candidate
that could join two components is dropped unchecked.

Defined results: words are separated by white space and compared without ASCII
case; a text of one to four words is one shingle; null and empty texts are
copies of each other. Rows with a null id link others and always stay. Of repeated
rows one stays, of different texts with one id the shortest. Very long texts
count whole. An empty table gives an empty table. Other columns, also those named like inner ones, stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import slices, written
from ledgerloom.llm.simhash import GrayIndex, _Forest, components, keep_first
from ledgerloom.llm.wordhash import bitmap, mix, text_bytes, windows, words_of

SHINGLE = 5
SIMILARITY = 0.8
#: Differing bits, of 256, up to which a pair is a candidate.
MAX_BITS = 64
TURNS = 32
_WORDS = 4
#: Bits of the bitmap that bounds overlaps.
_BITS = 2048
_SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def shingles(column: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct hashes of the runs of ``size`` words of each text; a shorter text is one run."""
    data, offsets = text_bytes(column)
    words = words_of(data, offsets)
    bounds = words.bounds(len(column))
    value, first = windows(words, size)
    at = np.searchsorted(first, bounds)
    found = []
    for k in range(len(column)):
        own = value[at[k] : at[k + 1]]
        low, high = bounds[k], bounds[k + 1]
        if low < high < low + size:
            own = np.zeros(1, np.uint64)
            for word in words.hash[low:high]:
                own = mix(own * _SALTS[0] + word)
        found.append(np.unique(own))
    return found


def code(hashes: np.ndarray) -> np.ndarray:
    """SimHash of 256 bits, as four words; zero without a shingle."""
    out = np.zeros(_WORDS, np.uint64)
    if not len(hashes):
        return out
    for w in range(_WORDS):
        total = np.zeros(64, np.int64)
        for low in range(0, len(hashes), 1 << 16):
            spread = mix(hashes[low : low + (1 << 16)] ^ _SALTS[w])
            bits = np.unpackbits(spread.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            total += bits.sum(axis=0, dtype=np.int32)
        out[w] = np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)[0]
    return out


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), F.coalesce("text", F.lit("")).alias("text"))


def _key(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), 42)


def _longs(values) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _codes(docs: DataFrame) -> DataFrame:
    """One row per distinct set of shingles: ``key``, ``code``, its smallest id and one of its rows."""
    rows = _texts(docs)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingles(batch.column(2))
            codes = pa.array([code(s).tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), _longs([_key(s) for s in sets]), codes],
                names=["doc_id", "row", "key", "code"],
            )

    schema = f"doc_id {rows.schema[0].dataType.simpleString()}, row long, key long, code binary"
    found = rows.mapInArrow(compute, schema)
    return found.groupBy("key").agg(F.min("code").alias("code"), F.min("doc_id").alias("least"), F.min("row").alias("row"))


def _sets(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """``key`` and ``set`` of the rows in ``chosen``."""
    rows = _texts(docs).join(chosen.select("row"), "row", "left_semi").select("text")

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingles(batch.column(0))
            values = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([_longs([_key(s) for s in sets]), values], names=["key", "set"])

    return rows.mapInArrow(compute, "key long, set array<long>").dropDuplicates(["key"])


def _turned_word(codes: np.ndarray, turn: int, w: int) -> np.ndarray:
    """Word ``w`` of each code read from the turn's starting bit."""
    at = turn * (64 * _WORDS // TURNS)
    word, shift = codes[:, (at // 64 + w) % _WORDS], np.uint64(at % 64)
    if shift:
        further = codes[:, (at // 64 + w + 1) % _WORDS]
        word = (word << shift) | (further >> (np.uint64(64) - shift))
    return word


def turned(codes: np.ndarray, turn: int) -> np.ndarray:
    """Whole codes as read from the turn's starting bit."""
    return np.stack([_turned_word(codes, turn, w) for w in range(_WORDS)], axis=1)


def _leading(codes: np.ndarray, turn: int, bits: int) -> np.ndarray:
    """The first ``bits`` of each code from the turn's starting bit."""
    return _turned_word(codes, turn, 0) >> np.uint64(64 - bits)


def sketches(sets: DataFrame) -> DataFrame:
    """``key`` and the size and bitmap of its set, as bytes."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for k in range(batch.num_rows):
                own = batch.column(1)[k].values.to_numpy().view(np.uint64)
                made.append(np.int64(len(own)).tobytes() + bitmap(own, _BITS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["key", "sketch"])

    return sets.select("key", "set").mapInArrow(compute, "key long, sketch binary")


def candidates(codes: DataFrame, every: bool, group_rows: int = 64, chunk_rows: int = 2048) -> DataFrame:
    """Pairs of keys ``(a, b)`` within ``MAX_BITS`` that share the leading bits of a reading.

    With ``every``, all pairs of different ``label`` whose ``sketch`` leaves the
    similarity possible (a null one always does); else a spanning forest of
    each group. A group over ``chunk_rows`` is dealt to cells that hold two of
    its chunks each, so every chunk meets every other.
    """
    total = codes.count()
    bits = int(np.clip(np.ceil(np.log2(max(2, total) / group_rows)), 1, 12))
    label = F.col("label") if every else F.col("key")
    sketch = F.col("sketch") if "sketch" in codes.columns else F.lit(None).cast("binary")

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(-1, _WORDS)
            groups = np.stack([_leading(flat, t, bits).astype(np.int64) * TURNS + t for t in range(TURNS)], axis=1)
            groups = pa.ListArray.from_arrays(np.arange(len(groups) + 1, dtype=np.int32) * TURNS, pa.array(groups.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, groups], names=["key", "code", "label", "sketch", "groups"])

    spread = (
        codes.select("key", "code", label.alias("label"), sketch.alias("sketch"))
        .mapInArrow(lead, "key long, code binary, label long, sketch binary, groups array<long>")
        .select("key", "code", "label", "sketch", F.explode("groups").alias("grp"))
    )
    sizes = spread.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1")
    sizes = sizes.select("grp", F.ceil(F.col("n") / chunk_rows).cast("int").alias("chunks"))
    cells = (
        spread.join(sizes, "grp")
        .withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .groupBy("grp", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"))
        .agg(F.collect_list(F.struct("key", "code", "label", "sketch")).alias("members"))
        .select("members", (F.col("grp") % TURNS).alias("turn"))
    )
    return cells.mapInArrow(_compare(every, bits), "a long, b long").distinct()


def _within_reach(sketch: list[bytes | None], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether size and bitmap leave the similarity possible, per pair."""
    width = 8 + _BITS // 8
    known = np.array([x is not None for x in sketch])
    flat = np.frombuffer(b"".join(x or bytes(width) for x in sketch), np.uint64).reshape(len(sketch), -1)
    size, bits = flat[:, 0].astype(np.int64), flat[:, 1:]
    set_bits = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    common = np.bitwise_count(bits[a] & bits[b]).sum(axis=1, dtype=np.int64)
    shared = np.minimum(size[a] - set_bits[a], size[b] - set_bits[b]) + common
    return ~(known[a] & known[b]) | (shared >= SIMILARITY * (size[a] + size[b] - shared) - 1e-6)


def _compare(every: bool, bits: int, block: int = 1 << 20):
    def left_apart(a, b, codes, labels, sketch, turn) -> np.ndarray:
        kept = np.flatnonzero(labels[a] != labels[b])
        for low in range(0, len(kept), block // 64):
            part = kept[low : low + block // 64]
            ok = _within_reach(sketch, a[part], b[part])
            part = part[ok]
            unlike = codes[a[part]] ^ codes[b[part]]
            first = np.ones(len(part), bool)
            for earlier in range(turn):
                first &= _leading(unlike, earlier, bits) != 0
            yield part[first]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                members, turn = batch.column(0)[k].values, batch.column(1)[k].as_py()
                keys = members.field("key").to_numpy()
                labels = members.field("label").to_numpy()
                sketch = members.field("sketch").to_pylist()
                codes = np.frombuffer(b"".join(members.field("code").to_pylist()), np.uint64).reshape(-1, _WORDS)
                forest = _Forest(len(keys))
                for a, b in GrayIndex(turned(codes, turn)).pairs(MAX_BITS):
                    for kept in left_apart(a, b, codes, labels, sketch, turn) if every else [forest.joining(a, b)]:
                        if len(kept):
                            x, y = keys[a[kept]], keys[b[kept]]
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"]
                            )

    return compare


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose whole sets reach ``SIMILARITY``."""
    left = sets.select(F.col("key").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("key").alias("b"), F.col("set").alias("set_b"))
    both = pairs.join(left, "a").join(right, "b").withColumn("shared", F.size(F.array_intersect("set_a", "set_b")))
    united = F.size("set_a") + F.size("set_b") - F.col("shared")
    return both.where(F.col("shared") >= F.lit(SIMILARITY) * united).select("a", "b")


def similar_pairs(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct sets of shingles, and checked pairs of their keys that join all components."""
    codes = written(_codes(docs), "codes")
    first = written(candidates(codes, every=False), "candidates")
    asked = first.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    near = written(codes.join(asked, "key", "left_semi"), "near")
    sets = written(_sets(docs, near), "sets")
    links = written(_similar(first, sets), "similar")
    labels = components(links).withColumnRenamed("node", "key")
    named = near.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    named = written(named.join(sketches(sets), "key", "left"), "named")
    rest = candidates(named, every=True).join(first, ["a", "b"], "left_anti")
    return codes, links.unionByName(written(_similar(rest, sets), "similar"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their component: its smallest id, once.

    Rows with a null id always stay.
    """
    codes, links = similar_pairs(docs)
    labels = components(links).withColumnRenamed("node", "key")
    joined = codes.select("key", "least").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    chosen = joined.groupBy("label").agg(F.min("least").alias("doc_id")).select("doc_id").distinct()
    return keep_first(docs, chosen)
