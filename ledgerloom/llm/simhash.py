"""SimHash fingerprints and near-duplicate components by a Gray-order hierarchical index.

Distinct fingerprints are linked at ``max_bits`` or fewer differing bits. A pair
that close differs in at most half as many bits in one half of the fingerprint,
so each half leads one index. In an index, fingerprints in Gray order share
leading bits: groups are contiguous Gray ranges named by the leading bits that
their members share, and a group meets only the groups whose shared bits differ
in few enough places. Inside a task the members of a group are sorted by Gray
rank; upper nodes hold the bits that all members below share, and whole nodes
are pruned once the differences on shared bits exceed the limit.

A link needs no more than reachability: a task returns the links of a spanning
forest of what it has compared, so copies and dense groups never turn into all
pairs. Components are the fixed point of min-label propagation with star
contraction over written tables.

Defined results: null and empty texts have fingerprint zero and are linked like
any other. Rows with a null id never name a component; theirs is the smallest
id reachable, null if there is none. Repeated rows give repeated result rows.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import quoted, set_aside, slices, written

_SEED = 42
_SHIFTS = np.arange(64, dtype=np.uint64)


def fingerprint(text: bytes, size: int = 4) -> int:
    """Majority of the bits of the hashes of all runs of ``size`` words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= size:
        return xxhash.xxh64_intdigest(b" ".join(words), _SEED)
    joined = b" ".join(words)
    starts = [0]
    at = 0
    for word in words:
        at += len(word) + 1
        starts.append(at)
    digest = xxhash.xxh64_intdigest
    n = len(words) - size + 1
    set_bits = np.zeros(64, np.int64)
    for low in range(0, n, 1 << 16):
        high = min(n, low + (1 << 16))
        hashes = np.array(
            [digest(joined[a : b - 1], _SEED) for a, b in zip(starts[low:high], starts[low + size : high + size])],
            np.uint64,
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int64)
    return int(((2 * set_bits > n).astype(np.uint64) << _SHIFTS).sum(dtype=np.uint64))


def fingerprints(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 4
) -> DataFrame:
    """Id and ``fp``, the fingerprint's 64 bits as a signed long."""
    rows = docs.select(F.col(quoted(id_column)), F.coalesce(F.col(quoted(text_column)), F.lit("")).alias("text"))
    schema = T.StructType([rows.schema[0], T.StructField("fp", T.LongType())])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [fingerprint(t, size) for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], names=[id_column, "fp"]
            )

    return rows.mapInArrow(compute, schema)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each 64-bit code in the reflected binary order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def gray_order(codes: np.ndarray) -> np.ndarray:
    """Numbers of the codes in Gray order; a code may be a row of several words, the leading one first."""
    if codes.ndim == 1:
        return np.argsort(gray_rank(codes))
    ranks = []
    odd = np.zeros(len(codes), np.uint64)
    for word in codes.T:
        # A word behind an odd number of ones runs backwards.
        ranks.append(gray_rank(word) ^ (np.uint64(0) - odd))
        odd ^= np.bitwise_count(word).astype(np.uint64) & np.uint64(1)
    return np.lexsort(ranks[::-1])


def _ones(bits: np.ndarray, words: int) -> np.ndarray:
    count = np.bitwise_count(bits)
    return count if words == 1 else count.reshape(-1, words).sum(axis=1, dtype=np.uint16)


class GrayIndex:
    """Fingerprints in Gray order under nodes that hold the bits their members share.

    A fingerprint is one 64-bit word or a row of several.
    """

    def __init__(self, codes: np.ndarray, fan_out: int = 16):
        #: Number that each member had in ``codes``.
        self.order = gray_order(codes)
        self.codes = codes[self.order]
        self.words = 1 if codes.ndim == 1 else codes.shape[1]
        self.fan_out = fan_out
        #: From the leaves upwards: bits shared by all members, and their values.
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        ones, any_ = self.codes, self.codes
        while len(ones) > 1:
            at = np.arange(0, len(ones), fan_out)
            ones, any_ = np.bitwise_and.reduceat(ones, at, axis=0), np.bitwise_or.reduceat(any_, at, axis=0)
            self.levels.append((~(ones ^ any_), ones))

    def search(
        self, queries: np.ndarray, max_bits: int, block: int = 1 << 20, later: bool = False
    ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of (query number, member number) at ``max_bits`` or fewer differing bits, in blocks.

        With ``later``, query ``k`` meets only members behind number ``k``.
        """
        if not len(self.codes) or not len(queries):
            return
        top = len(self.levels[-1][0]) if self.levels else 1
        stack = []
        step = max(1, block // self.fan_out // self.words)
        for low in range(0, len(queries), step):
            q = np.arange(low, min(len(queries), low + step))
            stack.append((len(self.levels) - 1, np.repeat(q, top), np.tile(np.arange(top), len(q))))
        while stack:
            level, q, node = stack.pop()
            if level >= 0:
                shared, value = self.levels[level]
                near = _ones((queries[q] ^ value[node]) & shared[node], self.words) <= max_bits
                q, node = q[near], node[near]
                below = len(self.levels[level - 1][0]) if level else len(self.codes)
                for low in range(0, len(q), step):
                    part = slice(low, low + step)
                    child = (node[part, None] * self.fan_out + np.arange(self.fan_out)).ravel()
                    again = np.repeat(q[part], self.fan_out)
                    there = child < below
                    if later:
                        there &= (child + 1) * self.fan_out**level - 1 > again
                    stack.append((level - 1, again[there], child[there]))
            else:
                near = _ones(queries[q] ^ self.codes[node], self.words) <= max_bits
                if later:
                    near &= node > q
                if near.any():
                    yield q[near], node[near]

    def pairs(self, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of members at ``max_bits`` or fewer differing bits, once each, by their numbers in the codes given."""
        for a, b in self.search(self.codes, max_bits, later=True):
            yield self.order[a], self.order[b]


class _Forest:
    """Keeps the links that join what was apart."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def _root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def roots(self, x: np.ndarray) -> np.ndarray:
        found = self.parent[x]
        while True:
            further = self.parent[found]
            if np.array_equal(found, further):
                return found
            found = further

    def joining(self, a: np.ndarray, b: np.ndarray) -> list[int]:
        """Numbers of the links that belong to the forest."""
        ra, rb = self.roots(a), self.roots(b)
        kept = []
        for k in np.flatnonzero(ra != rb):
            x, y = self._root(a[k]), self._root(b[k])
            if x != y:
                self.parent[max(x, y)] = min(x, y)
                kept.append(int(k))
        return kept


def _flips(bits: int, most: int) -> list[int]:
    """All masks of ``bits`` bits with at most ``most`` set."""
    masks = [0]
    for _ in range(most):
        masks = sorted({m | (1 << k) for m in masks for k in range(bits)} | set(masks))
    return masks


def links(prints: DataFrame, max_bits: int = 4, group_rows: int = 256, chunk_rows: int = 4096) -> DataFrame:
    """Links ``(a, b)`` between distinct values of ``fp`` that join all within ``max_bits``.

    ``prints`` has one row per distinct ``fp``. Groups hold about ``group_rows``
    fingerprints; a larger one is split into chunks of about ``chunk_rows``, and
    every chunk still meets every other chunk and neighbour.
    """
    total = prints.count()
    per_half = max_bits // 2
    bits = max(1, min(24, int(np.ceil(np.log2(max(2, total) / group_rows)))))
    masks = F.array(*[F.lit(m) for m in _flips(bits, per_half)])
    found = None
    for half in (0, 1):
        # The leading half of the code; the other half follows.
        code = F.col("fp") if half == 0 else F.shiftleft("fp", 32).bitwiseOR(F.shiftrightunsigned("fp", 32))
        coded = prints.select(code.alias("code")).withColumn("grp", F.shiftrightunsigned("code", 64 - bits).cast("int"))
        sizes = coded.groupBy("grp").agg(F.count("*").alias("n"))
        sizes = sizes.select("grp", F.ceil(F.col("n") / chunk_rows).cast("int").alias("chunks"))
        chunked = coded.join(sizes, "grp").withColumn("chunk", F.pmod(F.xxhash64("code"), F.col("chunks")).cast("int"))
        # Each chunk is the query of its own group and of the neighbours above it.
        wide = sizes.select(
            F.col("grp").alias("other"), F.col("chunks").alias("other_chunks"), F.explode(masks).alias("mask")
        ).withColumn("grp", F.col("other").bitwiseXOR(F.col("mask")))
        pairs = (
            sizes.join(wide, "grp")
            .where("grp <= other")
            .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            .withColumn("other_chunk", F.explode(F.sequence(F.lit(0), F.col("other_chunks") - 1)))
            .where("grp < other OR chunk <= other_chunk")
            .select("grp", "chunk", "other", "other_chunk")
        )
        blobs = chunked.groupBy("grp", "chunk").agg(F.collect_list("code").alias("codes"))
        met = (
            pairs.join(blobs, ["grp", "chunk"])
            # Neighbours are dealt to tasks in bounded sets: a few groups, 16 chunks at most of each.
            .groupBy(
                F.col("other").alias("grp"),
                F.col("other_chunk").alias("chunk"),
                F.pmod("grp", F.lit(8)).alias("set"),
                F.floor(F.col("chunk") / 16).alias("run"),
            )
            .agg(F.collect_list("codes").alias("queries"))
            .join(blobs, ["grp", "chunk"])
            .select("codes", "queries")
        )
        part = met.mapInArrow(_compare(max_bits, half), "a long, b long")
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def _compare(max_bits: int, half: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for k in range(batch.num_rows):
                index = GrayIndex(np.array(batch.column(0)[k].values, np.int64).view(np.uint64))
                queries = np.array(batch.column(1)[k].values.flatten(), np.int64).view(np.uint64)
                values, numbers = np.unique(np.concatenate([index.codes, queries]), return_inverse=True)
                members, asked = numbers[: len(index.codes)], numbers[len(index.codes) :]
                forest = _Forest(len(values))
                for q, m in index.search(queries, max_bits):
                    for n in forest.joining(asked[q], members[m]):
                        a.append(values[asked[q[n]]])
                        b.append(values[members[m[n]]])
            ends = [np.array(x, np.uint64) for x in (a, b)]
            if half:
                ends = [(x << np.uint64(32)) | (x >> np.uint64(32)) for x in ends]
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in ends], names=["a", "b"])

    return compare


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, label)`` for every node of the links ``(a, b)``; the label is the smallest node reachable.

    Alternates two star contractions until the links no longer change. Each
    round is a written table, and a hot node is only ever the key of a minimum.
    """
    current = written(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    state = None
    for _ in range(max_rounds):
        # Large star: neighbours above a node go to the smallest neighbour.
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: neighbours below a node go to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u != v")
            .distinct()
        )
        current = written(small, "stars")
        now = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return current.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "node").unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )


def _classes(
    docs: DataFrame, max_bits: int, id_column: str, text_column: str, size: int, salts: int
) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of all rows, and one row per ``fp`` and ``salt`` in use with its ``component_id``.

    The salts part the rows of a fingerprint that many share; one of a single
    row has a single salt.
    """
    ident = F.col(quoted(id_column))
    prints = written(
        fingerprints(docs, id_column, text_column, size).withColumn("salt", F.pmod(F.xxhash64(ident), F.lit(salts)).cast("int")),
        "fingerprints",
    )
    salted = written(prints.groupBy("fp", "salt").agg(F.min(ident).alias("least")), "salted")
    distinct = written(salted.groupBy("fp").agg(F.min("least").alias("least")), "distinct")
    edges = written(links(distinct.select("fp"), max_bits), "links")
    labels = components(edges)
    joined = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "label", F.coalesce("label", "fp")
    )
    smallest = joined.groupBy("label").agg(F.min("least").alias("component_id"))
    by_print = joined.join(smallest, "label").select("fp", "component_id")
    return prints, salted.join(by_print, "fp").select("fp", "salt", "component_id")


def near_duplicates(
    docs: DataFrame,
    max_bits: int = 4,
    id_column: str = "doc_id",
    text_column: str = "text",
    size: int = 4,
    salts: int = 1024,
) -> DataFrame:
    """One row per document: id, ``fingerprint`` in hex, ``component_id``."""
    prints, classes = _classes(docs, max_bits, id_column, text_column, size, salts)
    return prints.join(classes, ["fp", "salt"]).select(
        F.col(quoted(id_column)), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, max_bits: int = 4) -> DataFrame:
    """The rows of ``docs`` that stand for their component: its smallest id, once.

    Rows with a null id always stay.
    """
    _, classes = _classes(docs, max_bits, "doc_id", "text", 4, 1024)
    return keep_first(docs, classes.select(F.col("component_id").alias("doc_id")).distinct())


def keep_first(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of ``docs`` with a ``doc_id`` in ``chosen``, once each, and those with a null id."""
    once = Window.partitionBy("doc_id").orderBy(F.length("text"), F.xxhash64("text"))
    apart, back = set_aside(docs, ["_copy"])
    kept = (
        apart.where("doc_id IS NOT NULL")
        .join(chosen, "doc_id", "left_semi")
        .withColumn("_copy", F.row_number().over(once))
        .where("_copy = 1")
        .select(*[F.col(quoted(c)) for c in apart.columns])
        .withColumnsRenamed(back)
    )
    return kept.unionByName(docs.where("doc_id IS NULL"))
