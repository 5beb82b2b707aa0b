"""The trie of conversation prefixes, with subtree sums from an Euler tour.

Every distinct sequence of first turns (role, text) is a node; its smallest
member and its depth name it. Each node has an arc that enters and one that
leaves it; the arcs in depth-first order are a list. The list is ranked by
contraction: in every round the elements whose coin shows heads and whose
predecessor's shows tails leave at once, about a quarter, until the rest is
one small task's work; they come back in reverse order with their positions.
Subtree values are differences of prefix sums at a node's two arcs.

Nodes are told apart by sums of 128 hash bits of (depth, turn), so a prefix's
key is a running sum and no task needs a whole conversation. Positions, sibling
numbers and prefix sums come from range partitions (``operators.scans``); lookups
of a node that many children share are salted. Digests of member lists read
their ids as a sorted stream, in constant memory.

Defined results: turns are ordered by ``turn`` (null first), then by a hash of
role and text; null role and text are empty. Rows with a null ``conv_id`` are
left out, other columns are ignored. Repeated rows are turns of their own. An
empty table gives no row, not even the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import written
from ledgerloom.operators.scans import numbered, running

_LOW = 0xFFFFFFFF
_LANES = ["_a", "_b", "_c", "_d"]
_WORD = r"[^\x20\x09-\x0D]+"


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``position`` from 1, two hashes and the number of words of each turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(
        "conv_id",
        "turn",
        F.xxhash64(F.lit(1), role, text).alias("h1"),
        F.xxhash64(F.lit(2), role, text).alias("h2"),
        F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words"),
    )
    return numbered(turns, ["conv_id"], ["turn", "h1", "h2"], purpose="turns").drop("turn")


def shared_starts(turns: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Conversations rebuilt on the start of their group's first one.

    Conversation ``c`` takes the first ``h = crc32(c) % most`` turns of
    ``c - c % group`` (a negative id's remainder is positive), then its own after its first ``h``. Returns ``conv_id``
    of all conversations and, but for those without turns, ``depth`` and the
    turns' columns.
    """
    sizes = turns.groupBy("conv_id").agg(F.max("position").alias("n"))
    asked = sizes.select(
        "conv_id",
        (F.col("conv_id") - F.pmod("conv_id", F.lit(group))).alias("base"),
        (F.crc32(F.col("conv_id").cast("string")) % most).alias("h"),
    )
    heads = turns.where(F.col("position") < most).withColumnRenamed("conv_id", "base")
    taken = asked.join(heads, "base").where("position <= h").withColumnRenamed("position", "depth")
    bases = sizes.select(F.col("conv_id").alias("base"), F.least("n", F.lit(most)).alias("n_base"))
    own = asked.join(bases, "base", "left").withColumn("given", F.least("h", F.coalesce("n_base", F.lit(0))))
    rest = turns.join(own, "conv_id").where("position > h").withColumn("depth", F.col("given") + F.col("position") - F.col("h"))
    columns = ["conv_id", F.col("depth").cast("long").alias("depth"), "h1", "h2", "words"]
    return taken.select(*columns).unionByName(rest.select(*columns))


def _prefixes(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per conversation and depth: the key ``(k1, k2)`` of the prefix and of the one above."""
    mixed = [F.xxhash64(F.lit(s), "depth", "h1", "h2") for s in (3, 4)]
    lanes = dict(zip(_LANES, [v for m in mixed for v in (m.bitwiseAND(_LOW), F.shiftrightunsigned(m, 32))]))
    summed = running(turns, ["conv_id"], ["depth"], lanes, purpose="prefixes")
    # What this turn itself has added, to get the sums of the prefix above.
    before = summed.withColumns({f"{n}0": F.col(n) - lanes[n] for n in _LANES})

    def key(depth: Column, suffix: str) -> list[Column]:
        sums = [F.col(n + suffix) for n in _LANES]
        return [F.xxhash64(F.lit(s), depth, *sums) for s in (5, 6)]

    here, above = key(F.col("depth"), ""), key(F.col("depth") - 1, "0")
    rows = before.select(
        "conv_id", "depth", here[0].alias("k1"), here[1].alias("k2"), above[0].alias("p1"), above[1].alias("p2"), "words"
    )
    nothing = {n: F.lit(0).cast("long") for n in ("depth", *_LANES)}
    root = key(F.lit(0).cast("long"), "")
    roots = conversations.select("conv_id", *[v.alias(n) for n, v in nothing.items()]).select(
        "conv_id", "depth", root[0].alias("k1"), root[1].alias("k2"),
        F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), F.lit(0).cast("long").alias("words"),
    )
    return rows.unionByName(roots)


def _digests(ends: DataFrame, chunk: int = 1 << 16) -> DataFrame:
    """SHA-256 of the ascending, comma-joined ``conv_id`` of each ``(k1, k2)``.

    Range partitions turn ids into pieces of text; a node's pieces then pass
    one running digest in order.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, parts, size = None, None, [], 0
        made = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
        rows = []
        for batch in batches:
            for k1, k2, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (k1, k2) or size >= chunk:
                    if parts:
                        rows.append((*key, first, ",".join(parts)))
                    key, first, parts, size = (k1, k2), conv, [], 0
                parts.append(str(conv))
                size += len(parts[-1]) + 1
            yield from _flushed(rows, made)
            rows = []
        if parts:
            rows.append((*key, first, ",".join(parts)))
        yield from _flushed(rows, made)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])
        key, state = None, None
        for batch in batches:
            rows = []
            for k1, k2, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (k1, k2):
                    if key:
                        rows.append((*key, state.hexdigest()))
                    key, state = (k1, k2), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield from _flushed(rows, made)
        if key:
            yield from _flushed([(*key, state.hexdigest())], made)

    listed = (
        ends.select("k1", "k2", "conv_id")
        .repartitionByRange("k1", "k2", "conv_id")
        .sortWithinPartitions("k1", "k2", "conv_id")
        .mapInArrow(pieces, "k1 long, k2 long, first long, ids string")
    )
    gathered = listed.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first")
    return gathered.mapInArrow(digest, "k1 long, k2 long, ends_sha256 string")


def _flushed(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), schema.types)]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def list_ranks(links: DataFrame, small: int = 1 << 14, max_rounds: int = 200) -> DataFrame:
    """Positions from 0 in one linked list, given as ``(x1, x2)`` and its next ``(n1, n2)``, null at the end.

    Lists of up to ``small`` elements are walked by one task; the rounds bring
    longer ones there.
    """
    current = written(links.select("x1", "x2", "n1", "n2", F.lit(1).cast("long").alias("w")), "list")
    gone = []
    for r in range(max_rounds):
        if current.count() <= small:
            break

        def coin(a: str, b: str) -> Column:
            return F.xxhash64(F.lit(r), a, b).bitwiseAND(1) == 1  # noqa: B023

        asking = F.col("n1").isNotNull() & coin("x1", "x2") & ~coin("n1", "n2")
        own = current.select(
            F.col("x1").alias("k1"), F.col("x2").alias("k2"), F.struct("n1", "n2", "w", asking.alias("asks")).alias("own"),
            F.lit(None).cast("struct<x1:bigint,x2:bigint,w:bigint>").alias("by"),
        )
        asked = current.where(asking).select(
            F.col("n1").alias("k1"), F.col("n2").alias("k2"), F.lit(None).cast(own.schema["own"].dataType).alias("own"),
            F.struct("x1", "x2", "w").alias("by"),
        )
        met = own.unionByName(asked).groupBy("k1", "k2").agg(F.max("own").alias("own"), F.max("by").alias("by"))
        met = written(met, "round")
        spliced = met.where("by IS NOT NULL").select(
            "by.x1", "by.x2", "own.n1", "own.n2", (F.col("by.w") + F.col("own.w")).alias("w")
        )
        left = met.where("by IS NULL AND NOT own.asks").select(F.col("k1").alias("x1"), F.col("k2").alias("x2"), "own.n1", "own.n2", "own.w")
        gone.append(met.where("by IS NOT NULL").select(F.col("k1").alias("x1"), F.col("k2").alias("x2"), F.col("by.x1").alias("n1"), F.col("by.x2").alias("n2"), F.col("by.w").alias("w")))
        current = spliced.unionByName(left)
    else:
        raise RuntimeError(f"the list did not shrink to {small} in {max_rounds} rounds")
    found = [written(current.repartition(1).mapInArrow(_walk, "x1 long, x2 long, position long"), "ranks")]
    for removed in reversed(gone):
        known = found[0]
        for part in found[1:]:
            known = known.unionByName(part)
        known = known.select(F.col("x1").alias("n1"), F.col("x2").alias("n2"), "position")
        back = removed.join(known, ["n1", "n2"]).select("x1", "x2", (F.col("position") + F.col("w")).alias("position"))
        found.append(written(back, "ranks"))
    ranks = found[0]
    for part in found[1:]:
        ranks = ranks.unionByName(part)
    return ranks


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    following, ends = {}, set()
    for batch in batches:
        x1, x2, n1, n2, w = (c.to_pylist() for c in batch.columns)
        for k in range(batch.num_rows):
            after = (n1[k], n2[k])
            following[(x1[k], x2[k])] = (after, w[k])
            ends.add(after)
    at = next((x for x in following if x not in ends), None)
    rows, position = [], 0
    while at in following:
        rows.append((*at, position))
        at, w = following[at]
        position += w
    yield from _flushed(rows, pa.schema([("x1", pa.int64()), ("x2", pa.int64()), ("position", pa.int64())]))


def _tour(nodes: DataFrame) -> DataFrame:
    """The arcs of the tour as a list: ``(conv_id, 2 * depth)`` enters a node, with 1 more it leaves it."""
    enter, leave = F.col("depth") * 2, F.col("depth") * 2 + 1
    siblings = numbered(nodes.select("parent", "depth", "conv_id", "first_child"), ["parent", "depth"], ["conv_id"], "at", "siblings")
    siblings = written(siblings, "siblings")
    following = siblings.select("parent", "depth", (F.col("at") - 1).alias("at"), F.col("conv_id").alias("sibling"))
    linked = siblings.join(following, ["parent", "depth", "at"], "left")
    arcs = F.array(
        F.struct(
            F.col("conv_id").alias("x1"), enter.alias("x2"), F.coalesce("first_child", "conv_id").alias("n1"),
            F.when(F.col("first_child").isNull(), leave).otherwise(enter + 2).alias("n2"),
        ),
        F.struct(
            F.col("conv_id").alias("x1"), leave.alias("x2"), F.coalesce("sibling", "parent").alias("n1"),
            F.when(F.col("sibling").isNotNull(), enter).when(F.col("parent").isNotNull(), leave - 2).alias("n2"),
        ),
    )
    return linked.select(F.explode(arcs).alias("arc")).select("arc.*")


def prefix_trie(turns: DataFrame, conversations: DataFrame, salts: int = 64) -> DataFrame:
    """One row per node of the trie.

    ``turns`` has ``conv_id``, ``depth`` from 1 without gaps, ``h1``, ``h2`` and
    ``words``; ``conversations`` the ``conv_id`` of all, also of those without turns.
    """
    prefixes = written(_prefixes(turns, conversations.select("conv_id").distinct()), "keys")
    nodes = prefixes.groupBy("k1", "k2").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("p1").alias("p1"), F.max("p2").alias("p2"),
        F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"),
    )
    nodes = written(nodes.withColumn("salt", F.pmod(F.xxhash64("k1", "k2"), F.lit(salts)).cast("int")), "nodes")
    # The name of the node above, looked up once per salt.
    asked = nodes.where("p1 IS NOT NULL").select("p1", "p2", "salt").distinct()
    named = asked.join(nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent")), ["p1", "p2"])
    nodes = nodes.join(named, ["p1", "p2", "salt"], "left").drop("p1", "p2", "salt")
    nodes = written(nodes, "named")
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(
        F.count(F.lit(1)).alias("n_children"), F.min(nodes["conv_id"]).alias("first_child")
    )
    nodes = written(nodes.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "family")

    ranks = list_ranks(_tour(nodes))
    entered = nodes.select(
        F.col("conv_id").alias("x1"), (F.col("depth") * 2).alias("x2"),
        F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
    )
    valued = ranks.join(entered, ["x1", "x2"], "left").na.fill(0, ["leaf", "saved"])
    summed = running(valued, [], ["position"], {"leaves": F.col("leaf"), "savings": F.col("saved")}, purpose="tour")
    is_enter = F.col("x2") % 2 == 0

    def inside(total: str, own: str) -> Column:
        return F.sum(F.when(is_enter, F.col(own) - F.col(total)).otherwise(F.col(total)))

    subtrees = summed.groupBy(F.col("x1").alias("conv_id"), F.floor(F.col("x2") / 2).alias("depth")).agg(
        inside("leaves", "leaf").alias("n_leaves"), inside("savings", "saved").alias("saved_tokens")
    )
    last = prefixes.groupBy("conv_id").agg(F.max("depth").alias("depth"))
    ends = prefixes.join(last, ["conv_id", "depth"], "left_semi")
    none = hashlib.sha256(b"").hexdigest()
    return (
        nodes.join(subtrees, ["conv_id", "depth"])
        .join(_digests(ends), ["k1", "k2"], "left")
        .select(
            "conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
        )
    )
