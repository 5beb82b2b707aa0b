"""Callers' own OCR engine and model, run on the executors.

A factory builds the engine once per task; the engine is then called row by
row. What an engine raises becomes data in the row's ``failure``.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

# Binary content and kind in, the texts of the pages out.
TextExtractor = Callable[[bytes, str], Iterable[str]]
# System prompt, text and country in, HTTP status and reply body out.
ModelCall = Callable[[str, str, str], tuple[int, str]]

#: What a task gathers of results before it hands them on.
_ROWS_AT_ONCE = 1000
_CHARS_AT_ONCE = 1 << 20
_PAGES = ["doc_key", "page_no", "layer", "text", "failure"]


def run_text_extractor(documents: DataFrame, factory: Callable[[], TextExtractor]) -> DataFrame:
    """OCR pages of ``(doc_key, kind, content)``.

    Pass only documents that need OCR: a condition inside the call would not
    keep the other rows from it. A task holds one small batch of documents and
    the pages of about a megabyte, or of one document if that has more.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extract = factory()
        for batch in batches:
            rows, chars = [], 0
            for key, kind, content in zip(batch.doc_key, batch.kind, batch.content):
                try:
                    texts = list(extract(bytes(content), kind))
                    rows += [(key, n, "ocr", t, None) for n, t in enumerate(texts, start=1)]
                    chars += sum(len(t) for t in texts if t is not None)
                except Exception as exc:
                    rows.append((key, 1, "ocr", "", str(exc) or type(exc).__name__))
                if chars > _CHARS_AT_ONCE or len(rows) >= _ROWS_AT_ONCE:
                    yield pd.DataFrame(rows, columns=_PAGES)
                    rows, chars = [], 0
            yield pd.DataFrame(rows, columns=_PAGES)

    return documents.select("doc_key", "kind", "content").mapInPandas(
        run, "doc_key string, page_no int, layer string, text string, failure string"
    )


def run_model(texts: DataFrame, factory: Callable[[], ModelCall], prompts: dict[str, str],
              calls_in_flight: int | None = None, keys: tuple[str, ...] = ("doc_key",),
              calls_per_task: int = 1, clock: Callable[[], float] = time.time) -> DataFrame:
    """Model replies for ``keys``, ``country`` and ``character_stored``.

    ``calls_in_flight`` spreads the rows over that many partitions, which
    bounds the calls running at once; ``calls_per_task`` lets each task have
    several calls under way, for models that may be called from threads.
    ``finished_at`` is the ``clock``'s reading when a call ended, and ``seq``
    orders calls that ended at the same reading: task first, then the order in
    which the task's calls ended.
    """
    rows = texts.select(*keys, "country", "character_stored")
    if calls_in_flight is not None:
        rows = rows.repartition(calls_in_flight)
    key_schema = rows.select(*keys).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = factory()
        lock = threading.Lock()
        ended = TaskContext.get().partitionId() << 33

        def reply(country: str, text: str) -> tuple:
            nonlocal ended
            try:
                answer = (*call(prompts.get(country, ""), text, country), None)
            except ConnectionError:
                answer = (None, None, "connect")
            except TimeoutError:
                answer = (None, None, "timeout")
            except Exception as exc:
                answer = (None, None, str(exc) or type(exc).__name__)
            with lock:
                ended += 1
                return (*answer, int(clock() * 1_000_000), ended)

        with ThreadPoolExecutor(calls_per_task) as pool:
            for batch in (b.iloc[low : low + _ROWS_AT_ONCE] for b in batches for low in range(0, len(b), _ROWS_AT_ONCE)):
                if calls_per_task == 1:
                    replies = [reply(c, t) for c, t in zip(batch.country, batch.character_stored)]
                else:
                    replies = list(pool.map(reply, batch.country, batch.character_stored))
                found = pd.DataFrame(replies, columns=["http_status", "body", "failure", "finished_at", "seq"])
                found["http_status"] = found["http_status"].astype("Int32")
                found["finished_at"] = pd.to_datetime(found["finished_at"].astype("int64"), unit="us", utc=True)
                found["seq"] = found["seq"].astype("int64")
                yield pd.concat(
                    [batch[[*keys, "country"]].reset_index(drop=True), found], axis=1
                )

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in key_schema)
    return rows.mapInPandas(
        run,
        f"{schema}, country string, http_status int, body string, failure string, "
        "finished_at timestamp, seq bigint",
    )
