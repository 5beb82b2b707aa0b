"""Token counts of whole texts.

Arrow batches are encoded in parts balanced by bytes; long texts are split where
no token can cross, and only lengths come back.

Defined results: a null text counts as empty (0 bytes, 0 tokens). Null ids and
repeated rows keep one result row per input row. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import quoted, slices
from ledgerloom.llm.pieces import TokenCounter


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    limit: int = 1024,
    id_column: str = "doc_id",
    text_column: str = "text",
    part_chars: int = 1 << 16,
) -> DataFrame:
    """One row per document: id, ``n_bytes``, ``n_tokens``, ``over_limit``.

    ``tokenizer_path`` must be readable on every executor.
    """
    rows = docs.select(F.col(quoted(id_column)), F.coalesce(F.col(quoted(text_column)), F.lit("")).alias("text"))
    schema = T.StructType(
        [rows.schema[0], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(tokenizer_path, part_chars)
        for batch in slices(batches):
            texts = batch.column(1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.compute.binary_length(texts.cast(pa.large_binary())).cast(pa.int64()),
                    pa.array(counter.count(texts.to_pylist()), pa.int64()),
                ],
                names=[id_column, "n_bytes", "n_tokens"],
            )

    return rows.mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > limit)
