"""Packs documents into sequences of bounded length by cutting-stock column generation.

Documents longer than a sequence are cut into full sequences and a rest. The
lengths of all pieces, rounded up to ``grain`` tokens, form a histogram of at
most ``capacity / grain`` classes. A linear program over patterns (multisets of
classes that fit a sequence) covers the histogram; a knapsack dynamic program
prices new patterns. Patterns are rounded down, what is left is packed first-fit
by class, and the pieces of each class, ranked, take the slots of the patterns
in order. Only the histogram and the patterns visit the driver; their size
depends on ``capacity / grain`` alone.

Defined results: a null or empty text is one piece of one token (the end id).
Null ids and repeated rows are documents of their own. Other columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import quoted, slices, written
from ledgerloom.llm.pieces import WordEncoder


def pieces(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 4096,
    end_id: int = 2,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Full pieces of ``capacity`` tokens and the rest of each document, with checksums of their ids."""
    rows = docs.select(F.col(quoted(id_column)), F.coalesce(F.col(quoted(text_column)), F.lit("")).alias("text"))
    names = ["start", "length", "ids_crc32", "doc_tokens"]
    schema = T.StructType([rows.schema[0], *(T.StructField(n, T.LongType()) for n in names)])
    last = int(end_id).to_bytes(4, "little")
    width = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer_path)
        for batch in slices(batches):
            row, found = [], []
            for k, ids in enumerate(encoder.encode(batch.column(1).to_pylist())):
                ids += last
                for at in range(0, len(ids), width):
                    part = ids[at : at + width]
                    row.append(k)
                    found.append((at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4))
            columns = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), *columns], names=[id_column, *names]
            )

    return rows.mapInArrow(cut, schema)


def knapsack(values: np.ndarray, weights: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best multiset of classes within the capacity: its value and copies per class.

    ``weights`` ascend and do not repeat; the dynamic program runs over capacities.
    """
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    fitting = np.searchsorted(weights, np.arange(capacity + 1), side="right").tolist()
    top = 0.0
    for c in range(1, capacity + 1):
        n = fitting[c]
        if n:
            reached = best[c - weights[:n]] + values[:n]
            k = int(reached.argmax())
            if reached[k] > top + 1e-12:
                top, choice[c] = float(reached[k]), k
        best[c] = top
    copies = np.zeros(len(weights), np.int64)
    c = capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            copies[choice[c]] += 1
            c -= int(weights[choice[c]])
    return float(best[capacity]), copies


def patterns(
    histogram: dict[int, int], capacity: int, tolerance: float = 5e-4, max_columns: int = 4000
) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns that hold every piece of the histogram: ``(times, [(class, copies), ...])``.

    ``histogram`` maps a class (its length in grains, at most ``capacity``) to its
    number of pieces. Columns are generated until the linear program is within
    ``tolerance`` or half a sequence of its bound, or ``max_columns`` were added;
    either way every piece gets a slot.
    """
    weights = np.array(sorted(k for k, n in histogram.items() if n > 0), np.int64)
    if not len(weights):
        return []
    demand = np.array([histogram[int(k)] for k in weights], float)
    size = len(weights)
    columns = np.diag(capacity // weights).astype(float)
    inverse = np.diag(1.0 / np.diag(columns))
    # Slightly uneven demands keep the steps of the program from stalling.
    uneven = demand + np.random.default_rng(0).uniform(0, 1e-4, size)
    amounts = inverse @ uneven
    for step in range(max_columns):
        duals = inverse.sum(axis=0)
        value, copies = knapsack(np.maximum(duals, 0), weights, capacity)
        # amounts.sum() / value bounds every solution from below.
        if value <= 1 + tolerance or amounts.sum() * (1 - 1 / value) < 0.5:
            break
        column = copies.astype(float)
        direction = inverse @ column
        rising = direction > 1e-9
        ratios = np.full(size, np.inf)
        ratios[rising] = amounts[rising] / direction[rising]
        leaving = int(ratios.argmin())
        columns[:, leaving] = column
        pivot = inverse[leaving] / direction[leaving]
        inverse -= np.outer(direction, pivot)
        inverse[leaving] = pivot
        amounts = amounts - direction * ratios[leaving]
        amounts[leaving] = ratios[leaving]
        amounts = np.maximum(amounts, 0)
        if step % 200 == 199:  # against rounding errors
            inverse = np.linalg.inv(columns)
            amounts = np.maximum(inverse @ uneven, 0)
    found: Counter = Counter()
    left = demand.astype(np.int64)
    for k in np.argsort(-amounts):
        column = columns[:, k].astype(np.int64)
        used = column > 0
        times = min(int(np.floor(amounts[k])), int((left[used] // column[used]).min()))
        if times > 0:
            left -= times * column
            found[tuple((int(weights[i]), int(column[i])) for i in np.flatnonzero(used))] += times
    while left.any():
        room, taken = capacity, []
        for i in range(size - 1, -1, -1):
            if left[i] and weights[i] <= room:
                n = min(int(left[i]), int(room // weights[i]))
                taken.append((i, n))
                room -= n * int(weights[i])
        times = min(int(left[i]) // n for i, n in taken)
        for i, n in taken:
            left[i] -= times * n
        found[tuple((int(weights[i]), n) for i, n in reversed(taken))] += times
    return [(times, list(pattern)) for pattern, times in found.items()]


def slots(found: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """Ranges of ranks per class: ``(class, first rank, rank after, first sequence, times, first slot)``."""
    taken: Counter = Counter()
    rows, sequence = [], 0
    for times, pattern in found:
        slot = 0
        for kind, copies in sorted(pattern, reverse=True):
            rows.append((kind, taken[kind], taken[kind] + times * copies, sequence, times, slot))
            taken[kind] += times * copies
            slot += copies
        sequence += times
    return rows


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 4096,
    grain: int = 16,
    end_id: int = 2,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per piece with its sequence and offset.

    Returns id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id``, ``offset``.
    """
    if capacity % grain:
        raise ValueError("capacity must be a multiple of grain")
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer_path, capacity, end_id, id_column, text_column), "pieces")
    grains = capacity // grain
    ident = F.col(quoted(id_column))
    kind = F.ceil(F.col("length") / grain).cast("int").alias("kind")
    histogram = {r["kind"]: r["n"] for r in cut.groupBy(kind).agg(F.count("*").alias("n")).collect()}
    total = sum(histogram.values())
    # Classes are ranked in parts of about equal size, so none is one task's work.
    part_rows = max(500, int(total**0.5))
    split = spark.createDataFrame(
        [(k, -(-n // part_rows)) for k, n in histogram.items()], "kind int, parts int"
    )
    table = spark.createDataFrame(
        slots(patterns(histogram, grains)),
        "kind int, first long, after long, first_sequence long, times long, first_slot long",
    )
    parted = cut.withColumn("kind", kind).join(F.broadcast(split), "kind").withColumn(
        "part", F.pmod(F.xxhash64(ident, "start", "ids_crc32"), F.col("parts")).cast("int")
    ).drop("parts")
    counts = parted.groupBy("kind", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("kind", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ranks_before"))
    within = Window.partitionBy("kind", "part").orderBy(ident, "start", "ids_crc32")
    ranked = parted.withColumn("rank", F.row_number().over(within)).join(offsets, ["kind", "part"]).withColumn(
        "rank", F.col("rank") - 1 + F.col("ranks_before")
    )
    # At most one row per pattern and class: its size is bounded by the number of grains.
    placed = ranked.join(
        F.broadcast(table.withColumnRenamed("kind", "slot_kind")),
        (F.col("kind") == F.col("slot_kind")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("after")),
    )
    local = F.col("rank") - F.col("first")
    in_sequence = (
        Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        placed.withColumn("sequence_id", F.col("first_sequence") + local % F.col("times"))
        .withColumn("slot", F.col("first_slot") + F.floor(local / F.col("times")))
        .select(
            ident,
            "start",
            "length",
            "ids_crc32",
            "doc_tokens",
            "sequence_id",
            F.coalesce(F.sum("length").over(in_sequence), F.lit(0)).alias("offset"),
        )
    )
