"""Benchmark decontamination by windows of canonical templates.

Numbers, units behind them and names inside sentences become typed slots; all
other words are compared without case and punctuation. Windows of ``size`` words
of every benchmark item are hash-joined with those of every document. Matched
windows of one alignment count only if its slots are consistent in both
directions, that is if each value of the item stands for one value of the
document and the other way round. A document is contaminated by an item if it
holds ``share`` or more of the item's windows, or ``run`` words of it in one
unbroken alignment.

Before the join a bitmap of fixed size drops document windows that no item has;
it decides nothing on its own. The item side is broadcast only up to
``broadcast_rows`` windows, else both sides are shuffled.

Defined results: null and empty texts match nothing, nor do items with fewer
than ``size`` words or without a window that has two plain words. The search
leaves out documents and items with a null id; ``clean`` searches rows without
an id by a key made of their text. Rows of a repeated id are taken together.
Other columns are ignored. No documents or no items: no rows found, and
``clean`` keeps every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import quoted, slices, written
from ledgerloom.llm.wordhash import IS_PUNCTUATION, Words, text_bytes, windows, words_of

#: Bits of the bitmap before the join.
BITMAP_BITS = 1 << 22
UNITS = (
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms ton tons tonne "
    "tonnes oz ounce ounces lb lbs pound pounds ml l liter liters litre litres gallon gallons s sec second seconds min "
    "minute minutes h hr hour hours day days week weeks month months year years percent dollar dollars cent cents euro "
    "euros usd eur gbp yen degree degrees celsius fahrenheit hz khz mhz ghz w kw watt watts volt volts v a amp amps j "
    "joule joules kb mb gb tb byte bytes kmh mph"
).split()
_NUMBER, _UNIT, _NAME = (np.uint64(k) for k in (0xA1B2C3D4E5F60701, 0xB2C3D4E5F60712A1, 0xC3D4E5F60712A1B2))
_IS_DIGIT = np.zeros(256, bool)
_IS_DIGIT[48:58] = True
_IS_STOP = np.zeros(256, bool)
_IS_STOP[[ord(c) for c in "\n.!?:;"]] = True
_IS_CAPITAL = np.zeros(256, bool)
_IS_CAPITAL[65:91] = True
_IS_SMALL = np.zeros(256, bool)
_IS_SMALL[97:123] = True
_IS_SMALL[128:] = True
_unit_hashes: np.ndarray | None = None


def _units() -> np.ndarray:
    global _unit_hashes
    if _unit_hashes is None:
        data, offsets = text_bytes(pa.array(UNITS))
        _unit_hashes = np.sort(words_of(data, offsets).hash)
    return _unit_hashes


def templates(column: pa.Array) -> tuple[Words, np.ndarray]:
    """Words with the hashes of their template, and the value of each slot (0: no slot)."""
    data, offsets = text_bytes(column)
    words = words_of(data, offsets, drop=IS_PUNCTUATION)
    n = len(words)
    plain = words.hash
    if not n:
        return words, plain
    first = np.ones(n, bool)
    first[1:] = words.text[1:] != words.text[:-1]
    number = _IS_DIGIT[data[words.start]]
    after_number = np.zeros(n, bool)
    after_number[1:] = number[:-1]
    unit = after_number & ~first & ~number & np.isin(plain, _units())
    lead, second = data[words.start], data[np.minimum(words.start + 1, len(data) - 1)]
    longer = words.end - words.start > 1
    # Latin capitals beyond ASCII are two bytes.
    accented = (lead == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)
    capital = longer & ((_IS_CAPITAL[lead] & _IS_SMALL[second]) | accented)
    stops = np.concatenate([[0], np.cumsum(_IS_STOP[data])])
    opening = first.copy()
    opening[1:] |= stops[words.start[1:]] > stops[words.end[:-1]]
    name = capital & ~opening
    slot = number | unit | name
    template = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, plain)))
    words.hash = template
    return words, np.where(slot, plain, np.uint64(0))


def template_windows(
    rows: DataFrame, id_column: str, text_column: str, size: int, bitmap: np.ndarray | None = None
) -> DataFrame:
    """``(id, w, pos, slots)`` for each window with two plain words at least; ``bitmap`` drops windows it lacks."""
    ident = F.col(quoted(id_column))
    texts = rows.where(ident.isNotNull()).select(
        ident.alias("id"), F.coalesce(F.col(quoted(text_column)), F.lit("")).alias("text")
    )
    schema = T.StructType(
        [
            texts.schema["id"],
            T.StructField("w", T.LongType()),
            T.StructField("pos", T.LongType()),
            T.StructField("slots", T.ArrayType(T.LongType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words, values = templates(batch.column(1))
            w, at = windows(words, size)
            plain = np.concatenate([[0], np.cumsum(values == 0)])
            keep = plain[at + size] - plain[at] >= 2
            if bitmap is not None:
                low = w & np.uint64(BITMAP_BITS - 1)
                keep &= (bitmap[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1) == 1
            w, at = w[keep], at[keep]
            text = words.text[at]
            begins = words.bounds(batch.num_rows)
            slots = values[at[:, None] + np.arange(size)].ravel().view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(text)),
                    pa.array(w.view(np.int64)),
                    pa.array(at - begins[text]),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * size), pa.array(slots)),
                ],
                names=["id", "w", "pos", "slots"],
            )

    return texts.mapInArrow(run, schema)


def _unsure(pairs: DataFrame, alignment: list[str], of: str, to: str, consistency: float) -> DataFrame:
    """Alignments in which too few values ``of`` one side keep to their most frequent value ``to`` the other."""
    return (
        pairs.groupBy(*alignment, of, to)
        .agg(F.sum("n").alias("n"))
        .groupBy(*alignment, of)
        .agg(F.max("n").alias("most"), F.sum("n").alias("n"))
        .groupBy(*alignment)
        .agg(F.sum("most").alias("most"), F.sum("n").alias("n"))
        .where(F.col("most") < consistency * F.col("n"))
        .select(*alignment)
    )


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = 5,
    share: float = 0.8,
    run: int = 13,
    consistency: float = 0.8,
    broadcast_rows: int = 200_000,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """One row per document and item it holds.

    Ids, ``matched``, ``item_windows``, ``coverage``, ``reparameterised`` and
    ``run_words``, the words of the longest unbroken alignment.
    """
    items = written(template_windows(benchmark, item_column, item_text_column, size), "items").withColumnsRenamed(
        {"id": "item", "pos": "item_pos", "slots": "item_slots"}
    )
    low = F.col("w").bitwiseAND(F.lit(BITMAP_BITS - 1))
    marks = (
        items.select(F.shiftright(low, 6).alias("cell"), F.expr("shiftleft(1L, cast(w & 63 as int))").alias("bit"))
        .groupBy("cell")
        .agg(F.bit_or("bit").alias("bits"), F.count("*").alias("n"))
        .collect()
    )
    bitmap = np.zeros(BITMAP_BITS // 64, np.int64)
    for row in marks:
        bitmap[row["cell"]] = row["bits"]
    few = sum(row["n"] for row in marks) <= broadcast_rows
    windows_of_docs = template_windows(docs, id_column, text_column, size, bitmap.view(np.uint64))
    met = written(
        windows_of_docs.join(F.broadcast(items) if few else items, "w").select(
            "id", "item", "w", "item_pos", (F.col("pos") - F.col("item_pos")).alias("shift"), "slots", "item_slots"
        ),
        "met",
    )
    alignment = ["id", "item", "shift"]
    pairs = (
        met.select(
            *alignment,
            F.explode(F.filter(F.arrays_zip("item_slots", "slots"), lambda p: p["item_slots"] != 0)).alias("p"),
        )
        .groupBy(*alignment, F.col("p.item_slots").alias("item_value"), F.col("p.slots").alias("value"))
        .agg(F.count("*").alias("n"))
    )
    unsure = _unsure(pairs, alignment, "item_value", "value", consistency).unionByName(
        _unsure(pairs, alignment, "value", "item_value", consistency)
    )
    counts = items.groupBy("item").agg(F.countDistinct("w").alias("item_windows"))
    changed = F.exists(F.arrays_zip("item_slots", "slots"), lambda p: p["item_slots"] != p["slots"])
    sure = met.join(unsure, alignment, "left_anti")
    # Equal differences of position and rank are one unbroken stretch; repeated rows share their rank.
    rank = F.dense_rank().over(Window.partitionBy(*alignment).orderBy("item_pos"))
    stretch = Window.partitionBy(*alignment, "stretch")
    run_words = F.max("item_pos").over(stretch) - F.min("item_pos").over(stretch) + size
    return (
        sure.withColumn("stretch", F.col("item_pos") - rank)
        .withColumn("run_words", run_words)
        .groupBy("id", "item")
        .agg(
            F.countDistinct("w").alias("matched"),
            F.max("run_words").alias("run_words"),
            F.max(changed).alias("reparameterised"),
        )
        .join(counts, "item")
        .where((F.col("matched") >= share * F.col("item_windows")) | (F.col("run_words") >= run))
        .select(
            F.col("id").alias(id_column),
            F.col("item").alias(item_column),
            "matched",
            "item_windows",
            (F.col("matched") / F.col("item_windows")).alias("coverage"),
            "reparameterised",
            "run_words",
        )
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item."""
    key = "clean_key"
    while key in {c.lower() for c in docs.columns}:
        key += "_"
    of_text = F.concat(F.lit("text "), F.sha2(F.coalesce("text", F.lit("")), 256))
    keyed = docs.withColumn(key, F.coalesce(F.concat(F.lit("id "), F.col("doc_id").cast("string")), of_text))
    found = written(contaminated(keyed, benchmark, id_column=key).select(key).distinct(), "contaminated")
    return keyed.join(found, key, "left_anti").select(*[F.col(quoted(c)) for c in docs.columns])
