"""Components of texts whose sets of word shingles have a Jaccard similarity of 0.9 or more.

Only texts of like size can link, so sets lie in bands by size; a set near the
upper end of its band is a guest of the next one. A band's hash space is cut into
more parts than two linked sets of its sizes can differ in (see ``Bands``), so
linked sets agree in a whole part: (band, part, content) names a tile, and
all sets of a tile are compared there. A set of a pair that shares one of the
first ``HEADS`` parts is compared in that part's tile only.

In a tile, a bitmap of 1,024 hashed bits stands for each set: an element whose
bit the other set lacks is not shared, so bit counts bound the overlap from above. Pairs that
pass are checked exactly by intersecting their sorted sets.

Tiles of more than ``CELL`` sets are dealt to cells. The first round compares
each cell's own sets and checks all candidates where they are few; a tile of one such
cell is done. Of a dense cell it checks a spanning forest, nearest first, and
so does the second round for the tiles left, dealt anew; components found so far are
not compared inside. The last round meets all cells of the tiles that still hold several
components and checks every candidate between different ones, so dense groups don't turn into
all pairs and no link is lost. Sets of a tile's largest component meet only the others.

Defined results: words are separated by white space and compared without ASCII
case; a text of fewer words than a shingle is one shingle. Null and empty texts
have size 0 and link with nothing, not even each other. Repeated rows give
repeated result rows. A null id names no component; its row has the smallest id
reachable, null if there is none. An empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import slices, written
from ledgerloom.llm.near_copies import shingles
from ledgerloom.llm.simhash import _Forest, components
from ledgerloom.llm.wordhash import bitmap, mix

SHINGLE = 3
#: A link needs ``100 * shared >= PERCENT * united``.
PERCENT = 90
BITS = 1024
HEADS = 4
CELL = 1024
_PART = np.uint64(0x8EBC6AF09C88C6E3)
_KEY = np.uint64(0x589965CC75374CC3)


class Bands:
    """Bands of sizes and their numbers of parts.

    Sets of sizes ``a`` and ``b`` that link share at least ``p * (a + b) / (100 + p)``
    elements, so they differ in at most ``(a + b) * (100 - p) / (100 + p)`` places and as many parts.
    With ``spare`` parts more, linked sets agree in ``spare + 1`` parts. A set
    with up to ``spare`` empty parts leaves those out; one with more, a rare
    case, is also filed under its empty ones, where it meets others like it.
    """

    def __init__(self, percent: int, step: float = 1.25, most: int = 1 << 40):
        self.percent = percent
        # Smaller sets than the first band's link only if they are equal.
        self.least = -(-percent // (100 - percent))
        uppers = [int(self.least * step)]
        while uppers[-1] < most:
            uppers.append(int(uppers[-1] * step) + 1)
        self.upper = np.array(uppers)
        self.parts, self.spare = [], []
        for k, upper in enumerate(uppers):
            smallest = (uppers[k - 1] * percent // 100) if k else self.least
            differing = 2 * upper * (100 - percent) // (100 + percent)
            empty = (differing + 2) * np.exp(-smallest / (differing + 2))
            spare = 1 + int(np.ceil(empty + 3 * np.sqrt(empty))) if k else 1
            self.parts.append(differing + 1 + spare)
            self.spare.append(spare)

    def of(self, size: int) -> list[int]:
        """The set's own band and, if it may link into the next, that one."""
        if size < self.least:
            return []
        band = int(np.searchsorted(self.upper, size))
        return [band, band + 1] if 100 * size >= self.percent * (self.upper[band] + 1) else [band]

    def tiles(self, hashes: np.ndarray, band: int) -> np.ndarray:
        """The tile of each part, zero where the set isn't filed."""
        parts = self.parts[band]
        part = ((mix(hashes ^ _PART) >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        there, first = np.unique(part[order], return_index=True)
        content = np.zeros(parts, np.uint64)
        content[there] = np.add.reduceat(mix(hashes[order] ^ _KEY), first)
        numbers = np.arange(parts, dtype=np.uint64) + (np.uint64(band) << np.uint64(40))
        named = mix(content + mix(numbers + np.uint64(1))) | np.uint64(1)
        if parts - len(there) <= self.spare[band]:
            named[content == 0] = 0
        return named


@cache
def _bands(percent: int) -> Bands:
    return Bands(percent)


def _node(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), F.coalesce("text", F.lit("")).alias("text"))


def _filed(docs: DataFrame, percent: int, size: int) -> DataFrame:
    """Per row its set's name, size, bitmap, tiles (the first ``n_home`` of its own band) and first parts."""
    rows = _texts(docs)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = _bands(percent)
        for batch in slices(batches):
            nodes, sizes, maps, tiles, homes, heads = [], [], [], [], [], []
            for own in shingles(batch.column(2), size):
                nodes.append(_node(own))
                sizes.append(len(own))
                places = [bands.tiles(own, b) for b in bands.of(len(own))]
                maps.append(bitmap(own, BITS) if places else b"")
                first = np.zeros((2, HEADS), np.uint64)
                for k, place in enumerate(places):
                    first[k, : len(place)] = place[:HEADS]
                heads.append(first.tobytes() if places else b"")
                filed = [p[p != 0].view(np.int64) for p in places]
                homes.append(len(filed[0]) if filed else 0)
                tiles.append(np.concatenate(filed) if filed else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(maps, pa.binary()),
                 pa.array(heads, pa.binary()), pa.array(homes, pa.int32()), pa.array(tiles, pa.list_(pa.int64()))],
                names=["doc_id", "row", "node", "n", "bitmap", "heads", "n_home", "tiles"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, row long, node binary, n long, bitmap binary, heads binary, n_home int, tiles array<long>"
    return rows.mapInArrow(compute, schema)


def _members(filed: DataFrame) -> DataFrame:
    """The sets of all tiles that hold two or more."""
    placed = filed.select("node", "n_home", F.posexplode("tiles").alias("at", "tile")).select(
        "tile", "node", (F.col("at") < F.col("n_home")).alias("home")
    )
    short = F.xxhash64("node")
    shared = placed.groupBy("tile").agg(F.min(short).alias("low"), F.max(short).alias("high")).where("low <> high").select("tile")
    return placed.join(shared, "tile").distinct()


def _dealt(members: DataFrame, salt: int, every: bool) -> DataFrame:
    """Members of tiles with several labels and the cell or cells of each, ``low`` to ``high``; ``whole`` if it is the only one."""
    labels = members.groupBy("tile", "label").agg(F.count(F.lit(1)).alias("n"))
    tiles = labels.groupBy("tile").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_labels"), F.max_by("label", F.struct("n", "label")).alias("largest"))
    opened = tiles.where("n_labels > 1")
    spread = F.xxhash64(F.lit(salt), "node")
    if not every:
        opened = opened.select("tile", F.ceil(F.col("n") / CELL).cast("long").alias("chunks"))
        cell = F.pmod(spread, "chunks")
        return members.join(opened, "tile").select("*", cell.alias("low"), cell.alias("high"), (F.col("chunks") == 1).alias("whole"), cell.alias("chunk"))
    is_large = F.col("label") == F.col("largest")
    sizes = labels.join(opened.select("tile", "largest"), "tile").groupBy("tile", "largest").agg(
        F.sum(F.when(is_large, F.col("n"))).alias("inside"), F.sum(F.when(~is_large, F.col("n"))).alias("outside")
    )
    chunks = sizes.select("tile", "largest", *[F.ceil(F.col(c) / CELL).cast("long").alias(c) for c in ("inside", "outside")])
    # Chunks of the largest component come after the others' and meet only those.
    dealt = members.join(chunks, "tile").withColumn(
        "chunk", F.when(is_large, F.col("outside") + F.pmod(spread, "inside")).otherwise(F.pmod(spread, "outside"))
    )
    others = F.sequence(F.lit(0).cast("long"), F.col("outside") - 1)
    everyone = F.sequence(F.lit(0).cast("long"), F.col("outside") + F.col("inside") - 1)
    met = dealt.withColumn("other", F.explode(F.when(is_large, others).otherwise(everyone)))
    return met.withColumns({"low": F.least("chunk", "other"), "high": F.greatest("chunk", "other"), "whole": F.lit(True)})


def _cells(members: DataFrame, facts: DataFrame, salt: int, every: bool) -> DataFrame:
    """Members of the cells to compare, two lists each; the second is empty if the first meets itself.

    Sizes, bitmaps and heads join the narrow rows last.
    """
    dealt = _dealt(members, salt, every).select("tile", "node", "label", "home", "low", "high", "chunk", "whole").join(facts, "node")
    heads = F.substring("heads", F.when(F.col("home"), 1).otherwise(1 + 8 * HEADS), F.lit(8 * HEADS))
    member = F.struct("node", "label", "n", "home", "bitmap", heads.alias("heads"))
    return dealt.groupBy("tile", "low", "high", "whole").agg(
        F.collect_list(F.when(F.col("chunk") == F.col("low"), member)).alias("a"),
        F.collect_list(F.when(F.col("chunk") > F.col("low"), member)).alias("b"),
    ).select("tile", "a", "b", F.col("low") < F.col("high"), "whole")


class _Side:
    def __init__(self, members: pa.Array):
        field = members.field
        self.node = np.array(field("node").to_pylist(), dtype=object)
        self.label = np.frombuffer(b"".join(field("label").to_pylist()), np.uint64).reshape(-1, 2)
        self.n = field("n").to_numpy()
        self.home = np.array(field("home").to_pylist(), bool)
        self.bits = np.frombuffer(b"".join(field("bitmap").to_pylist()), np.uint64).reshape(-1, BITS // 64)
        self.set_bits = np.bitwise_count(self.bits).sum(axis=1, dtype=np.int64)
        self.heads = np.frombuffer(b"".join(field("heads").to_pylist()), np.uint64).reshape(-1, HEADS)


def _candidates(tile: int, x: _Side, y: _Side, percent: int, block: int = 1 << 20):
    """Numbers of the pairs that bit counts can't rule out, with a lower bound of their differing elements."""
    at = np.flatnonzero(x.heads[0] == np.int64(tile).view(np.uint64))
    earlier = int(at[0]) if len(at) else HEADS
    step = max(1, block // len(y.n))
    for low in range(0, len(x.n), step):
        rows = slice(low, low + step)
        total = x.n[rows, None] + y.n[None, :]
        need = -(-percent * total // (100 + percent))
        fits = (np.minimum(x.n[rows, None], y.n[None, :]) >= need) & (x.home[rows, None] | y.home[None, :])
        fits &= (x.label[rows, None] != y.label[None, :]).any(axis=2)
        if x is y:
            fits &= np.arange(low, low + len(fits))[:, None] < np.arange(len(y.n))[None, :]
        for h in range(earlier):
            fits &= (x.heads[rows, h, None] != y.heads[None, :, h]) | (x.heads[rows, h, None] == 0)
        i, j = np.nonzero(fits)
        for part in range(0, len(i), block // 16):
            a, b = i[part : part + block // 16] + low, j[part : part + block // 16]
            common = np.bitwise_count(x.bits[a] & y.bits[b]).sum(axis=1, dtype=np.int64)
            shared = np.minimum(x.n[a] - x.set_bits[a], y.n[b] - y.set_bits[b]) + common
            near = shared >= need[a - low, b]
            if near.any():
                a, b, shared = a[near], b[near], shared[near]
                yield a, b, x.n[a] + y.n[b] - 2 * shared


def _compare(every: bool, percent: int, dense: int = 4):
    """Pairs ``(a, b)`` to check, and the ``tile`` of each cell that is not done by them.

    All candidates, or a forest of them if a cell has more than ``dense`` a set.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                tile, _, _, two, whole = (c[k].as_py() if n not in (1, 2) else None for n, c in enumerate(batch.columns))
                x = _Side(batch.column(1)[k].values)
                y = _Side(batch.column(2)[k].values) if two else x
                found = list(_candidates(tile, x, y, percent)) if len(x.n) and len(y.n) else []
                a, b, apart = (np.concatenate(c) for c in zip(*found)) if found else [np.zeros(0, np.int64)] * 3
                if not every and len(a) > dense * len(x.n):
                    whole = False
                    _, component = np.unique(x.label, axis=0, return_inverse=True)
                    component = component.ravel()
                    order = np.argsort(apart, kind="stable")
                    a, b = a[order], b[order]
                    kept = _Forest(int(component.max()) + 1).joining(component[a], component[b])
                    a, b = a[kept], b[kept]
                rows = [(min(p, q), max(p, q), None) for p, q in zip(x.node[a], y.node[b])]
                if not whole:
                    rows.append((None, None, tile))
                if rows:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.binary(), pa.int64()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "tile"])

    return compare


def _sets(docs: DataFrame, chosen: DataFrame, size: int) -> DataFrame:
    """``node`` and its sorted ``set`` for the rows in ``chosen``."""
    rows = _texts(docs).join(chosen.select("row"), "row", "left_semi").select("text")

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingles(batch.column(0), size)
            values = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.binary()), values], names=["node", "set"])

    return rows.mapInArrow(compute, "node binary, set array<long>").dropDuplicates(["node"])


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets link."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for k in range(batch.num_rows):
                x, y = (batch.column(c)[k].values.to_numpy().view(np.uint64) for c in (2, 3))
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                shared = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                kept.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("set_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(check, "a binary, b binary")


def _links(filed: DataFrame, classes: DataFrame, docs: DataFrame, percent: int, size: int) -> DataFrame:
    """Checked links between distinct sets that join all components."""
    members = written(_members(filed), "members")
    known = written(classes.join(members.select("node").distinct(), "node", "left_semi"), "known")
    sets = written(_sets(docs, known, size), "sets")
    facts = filed.join(known.select("node", "row"), ["node", "row"], "left_semi").select("node", "n", "bitmap", "heads")
    facts = written(facts.dropDuplicates(["node"]), "facts")
    labelled = members.withColumn("label", F.col("node"))
    tested = found = None
    for round_, every in enumerate((False, False, True)):
        met = _cells(labelled, facts, round_, every).mapInArrow(_compare(every, percent), "a binary, b binary, tile long")
        met = written(met.distinct(), "met")
        pairs = met.where("a IS NOT NULL").select("a", "b")
        if tested is not None:
            pairs = written(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        new = written(_linked(pairs, sets, percent), "links")
        tested = pairs if tested is None else tested.unionByName(pairs)
        found = new if found is None else found.unionByName(new)
        if every:
            return found
        # Tiles that are not done, with the components found so far.
        rest = labelled.join(met.where("tile IS NOT NULL").select("tile"), "tile", "left_semi").drop("label")
        labels = components(found)
        labelled = written(rest.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")


def similar_sets(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, salts: int = 1024) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles`` and ``component_id``."""
    filed = written(_filed(docs, percent, size).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")), "filed")
    salted = written(filed.where("n > 0").groupBy("node", "salt").agg(F.min("doc_id").alias("least"), F.min("row").alias("row")), "salted")
    classes = written(salted.groupBy("node").agg(F.min("least").alias("least"), F.min("row").alias("row")), "classes")
    links = _links(filed, classes, docs, percent, size)
    joined = classes.join(components(links), "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = joined.groupBy("label").agg(F.min("least").alias("component_id"))
    by_node = joined.join(smallest, "label").select("node", "component_id")
    by_salt = salted.select("node", "salt").join(by_node, "node")
    named = filed.select("doc_id", "n", "node", "salt").join(by_salt, ["node", "salt"], "left")
    empty = F.col("n") == 0
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
