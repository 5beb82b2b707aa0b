"""Cheapest repair of conversations whose turns are missing, empty, doubled or out of turn.

A conversation is legal if its role initials match ``(s?(ua)+)?``. The parser of
that grammar runs over all edits at once: a row is kept, given another role,
or deleted, and turns may be inserted anywhere. Its stacks share their tops; equal
tops merge into the one with the smallest (cost, audit). A reduced stack is
told by its top alone, so at most four tops live at any row.

Long conversations are parsed in chunks of ``CHUNK`` rows, each from every top it
may start with; the chunks' tables are then joined like rows. Tops are compared
by rank, not by their audits' letters: two audits that cover the same rows and
end with a row's letter are never prefixes of each other, so the order that
they have stays.

Defined results: null ids, roles, texts and turns count as one space (a null
turn comes first, and rows with a null id are one conversation). Rows of equal
turn are ordered by a hash of role and text. Repeated rows are duplicates like
any other. A conversation without rows after damage has zeros and the hash of
nothing; an empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import written
from ledgerloom.operators.scans import numbered

CHUNK = 4096
_SPACE = r"[\x20\x09-\x0D]"
_INK = r"[^\x20\x09-\x0D]"

#: Stack tops of the role grammar: Turns -> s Pairs | Pairs, Pairs -> Pairs Pair | Pair, Pair -> u a.
START, SYSTEM, USER, PAIRS = range(4)
SHIFT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": PAIRS}, PAIRS: {"u": USER}}
ACCEPTING = (START, PAIRS)
#: Fewest inserted turns from one top to another.
INSERTED = {START: {START: 0, USER: 1, PAIRS: 2}, SYSTEM: {SYSTEM: 0, USER: 1, PAIRS: 2}, USER: {USER: 0, PAIRS: 1}, PAIRS: {PAIRS: 0, USER: 1}}
LEGAL_PAIRS = ("su", "ua", "au")
#: Costs of edits, and what a truncated row adds unless it is deleted.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3


def _edits(initial: str, must_go: bool, truncated: bool) -> list[list[tuple[int, str, int]]]:
    """For each top, the (cost, letters, next top) of all edits around one row."""
    found = []
    for top in SHIFT:
        edits = []
        for reached, n in INSERTED[top].items():
            lead, cost = "I" * n, INSERT * n
            edits.append((cost + DELETE, lead + "D", reached))
            if not must_go:
                stays = cost + (TRUNCATED if truncated else 0)
                if initial in SHIFT[reached]:
                    edits.append((stays, lead + "K", SHIFT[reached][initial]))
                edits += [(stays + REROLE, lead + "R", SHIFT[reached][r]) for r in "ua" if r in SHIFT[reached]]
        found.append(edits)
    return found


_EDITS = {(i, m, t): _edits(i, m, t) for i in ("s", "u", "a", "") for m in (False, True) for t in (False, True)}


def _ranked(candidates: dict[int, tuple[int, int, str, int]]) -> dict[int, tuple[int, int]]:
    """(cost, rank) of each top by its (cost, rank before, letters, top before)."""
    order = sorted(candidates, key=lambda top: candidates[top][1:3])
    return {top: (candidates[top][0], rank) for rank, top in enumerate(order)}


def _merged(tops: dict[int, tuple[int, int]], edits) -> dict[int, tuple[int, int, str, int]]:
    best: dict[int, tuple[int, int, str, int]] = {}
    for top, (cost, rank) in tops.items():
        for more, letters, reached in edits(top):
            this = (cost + more, rank, letters, top)
            if reached not in best or this < best[reached]:
                best[reached] = this
    return best


def parse(rows: list[tuple[str, bool, bool]], top: int) -> dict[int, tuple[int, str]]:
    """(cost, audit) of the best way through ``rows`` to each top."""
    tops, steps = {top: (0, 0)}, []
    for row in rows:
        table = _EDITS[row]
        best = _merged(tops, table.__getitem__)
        steps.append(best)
        tops = _ranked(best)
    found = {}
    for end, (cost, _) in tops.items():
        letters, at = [], end
        for best in reversed(steps):
            letters.append(best[at][2])
            at = best[at][3]
        found[end] = (cost, "".join(reversed(letters)))
    return found


def joined(chunks: Iterator[list[tuple[int | None, str | None]]]) -> tuple[int, str]:
    """Cost and audit of a conversation from its chunks' tables, entry top by exit top."""
    tops, steps = {START: (0, 0)}, []
    for table in chunks:

        def through(top: int, table=table):
            return [(*table[4 * top + end], end) for end in range(4) if table[4 * top + end][0] is not None]

        best = _merged(tops, through)
        steps.append(best)
        tops = _ranked(best)

    def finish(top: int):
        return [(INSERT * n, "I" * n, PAIRS) for reached, n in INSERTED[top].items() if reached in ACCEPTING]

    cost, _, letters, at = _merged(tops, finish)[PAIRS]
    parts = [letters]
    for best in reversed(steps):
        parts.append(best[at][2])
        at = best[at][3]
    return cost, "".join(reversed(parts))


def damaged(conversations: DataFrame) -> DataFrame:
    """``c`` (the id as text), ``turn``, ``role`` and ``text`` after the damage drawn from ``conv_id:turn``."""
    def plain(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    drawn = conversations.select(
        plain("conv_id").alias("c"), "turn", plain("role").alias("role"), plain("text").alias("text"),
        (F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn"))) % 20).alias("fault"),
    )
    fault = F.col("fault")
    return drawn.where("fault <> 0").select(
        "c",
        "turn",
        F.when(fault == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(fault == 1, F.lit("")).when(fault == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


def _keyed(rows: DataFrame) -> DataFrame:
    """Two hashes of role and text order the rows of a turn."""
    return rows.withColumns({"h1": F.xxhash64(F.lit(1), "role", "text"), "h2": F.xxhash64(F.lit(2), "role", "text")})


def faults(rows: DataFrame) -> DataFrame:
    """One narrow row per damaged row: position, role initial and its first fault."""
    blank = ~F.col("text").rlike(_INK)
    facts = _keyed(rows).select(
        "c", "turn", "h1", "h2", F.substring("role", 1, 1).alias("initial"), blank.alias("blank"),
        (~blank & ~F.col("text").rlike(rf"[.!?]{_SPACE}*\z")).alias("unended"),
    )
    facts = written(numbered(facts, ["c"], ["turn", "h1", "h2"], purpose="rows"), "facts")
    firsts = facts.groupBy("c", "h1", "h2").agg(F.min("position").alias("position")).select("c", "position", F.lit(True).alias("is_first"))
    seen = facts.join(firsts, ["c", "position"], "left").withColumn("duplicate", ~F.col("blank") & F.col("is_first").isNull())
    return seen.select("c", "turn", "position", "initial", "blank", "duplicate", (F.col("unended") & ~F.col("duplicate")).alias("truncated"))


_TABLE = "c string, chunk long, first string, last string, illegal long, cost array<int>, audit array<string>"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tables of the chunks of rows sorted by ``(c, chunk, position)``."""
    names = ["c", "chunk", "first", "last", "illegal", "cost", "audit"]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string())]

    def rows():
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    made = []
    for (c, chunk), own in groupby(rows(), key=lambda r: r[:2]):
        own = list(own)
        initials = [r[2] for r in own]
        coded = [(i if i in ("s", "u", "a") else "", gone, short) for _, _, i, gone, short in own]
        table = [(None, None)] * 16
        for top in SHIFT if chunk else (START,):
            for end, found in parse(coded, top).items():
                table[4 * top + end] = found
        illegal = sum(a + b not in LEGAL_PAIRS for a, b in zip(initials, initials[1:]))
        made.append((c, chunk, initials[0], initials[-1], illegal, [t[0] for t in table], [t[1] for t in table]))
        if len(made) >= 256:
            yield _batch(made, names, types)
            made = []
    if made:
        yield _batch(made, names, types)


def _batch(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def _join_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cost, audit and illegal pairs of conversations whose chunks come in order."""

    def rows():
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    made, size = [], 0
    for c, own in groupby(rows(), key=lambda r: r[0]):
        illegal, last, tables = 0, None, []
        for _, _, first, end, inside, costs, audits in own:
            illegal += inside + (last is not None and last + first not in LEGAL_PAIRS)
            last = end
            tables.append(list(zip(costs, audits)))
        cost, audit = joined(iter(tables))
        made.append((c, illegal, cost, audit))
        size += len(audit)
        if len(made) >= 4096 or size >= 1 << 20:
            yield _batch(made, ["c", "illegal", "cost", "audit"], [pa.string(), pa.int64(), pa.int64(), pa.string()])
            made, size = [], 0
    if made:
        yield _batch(made, ["c", "illegal", "cost", "audit"], [pa.string(), pa.int64(), pa.int64(), pa.string()])


def audits(seen: DataFrame) -> DataFrame:
    """``c``, ``illegal``, ``cost`` and ``audit`` of every conversation of ``faults``."""
    chunked = seen.select(
        "c", F.floor((F.col("position") - 1) / CHUNK).alias("chunk"), "initial", (F.col("blank") | F.col("duplicate")).alias("gone"),
        "truncated", "position",
    )
    dealt = chunked.repartition("c", "chunk").sortWithinPartitions("c", "chunk", "position").drop("position")
    tables = dealt.mapInArrow(_chunks, _TABLE).repartition("c").sortWithinPartitions("c", "chunk")
    return tables.mapInArrow(_join_chunks, "c string, illegal long, cost long, audit string")


def repaired(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """``c``, ``role`` and ``text`` of all repaired turns; a conversation's turns lie in order in one partition.

    A conversation streams through its task: only its audit is held.
    """
    kept = _keyed(rows).select("c", F.lit(1).alias("kind"), "turn", "h1", "h2", "role", "text")
    heads = audited.select("c", F.lit(0).alias("kind"), *[F.lit(None).cast(kept.schema[n].dataType).alias(n) for n in ("turn", "h1", "h2", "role")], F.col("audit").alias("text"))
    dealt = heads.unionByName(kept).repartition("c").sortWithinPartitions("c", "kind", "turn", "h1", "h2")
    return dealt.select("c", "kind", "role", "text").mapInArrow(_apply, "c string, role string, text string")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    audit, at, top, current = "", 0, START, None
    made = []

    def inserted():
        nonlocal at, top
        while at < len(audit) and audit[at] == "I":
            role = "assistant" if top == USER else "user"
            top = SHIFT[top][role[0]]
            at += 1
            made.append((current, role, ""))

    names, types = ["c", "role", "text"], [pa.string()] * 3
    for batch in batches:
        for c, kind, role, text in zip(*(x.to_pylist() for x in batch.columns)):
            if kind == 0:
                inserted()
                audit, at, top, current = text, 0, START, c
                continue
            inserted()
            edit = audit[at]
            at += 1
            if edit != "D":
                if edit == "R":
                    role = "assistant" if top == USER else "user"
                top = SHIFT[top][role[0]]
                made.append((c, role, text))
        if made:
            yield _batch(made, names, types)
            made.clear()
    inserted()
    if made:
        yield _batch(made, names, types)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's ``role:text`` lines."""
    current, state = None, None
    for batch in batches:
        made = []
        for c, role, text in zip(*(x.to_pylist() for x in batch.columns)):
            line = f"{role}:{text}".encode()
            if c == current:
                state.update(b"\n" + line)
            else:
                if state:
                    made.append((current, state.hexdigest()))
                current, state = c, hashlib.sha256(line)
        if made:
            yield _batch(made, ["c", "repaired_sha256"], [pa.string()] * 2)
    if state:
        yield _batch([(current, state.hexdigest())], ["c", "repaired_sha256"], [pa.string()] * 2)


def repairs(conversations: DataFrame) -> DataFrame:
    """One row per conversation: its faults after damage, and cost, audit and digest of its cheapest repair."""
    rows = damaged(conversations)
    seen = written(faults(rows), "faults")
    counts = seen.groupBy("c").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        *[F.count_if(n).alias(n) for n in ("blank", "duplicate", "truncated")],
    )
    audited = written(audits(seen), "audits")
    digests = repaired(rows, audited).mapInArrow(_digest, "c string, repaired_sha256 string")
    ids = conversations.select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("c")).distinct()
    zero = {n: F.coalesce(n, F.lit(0).cast("long")) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return (
        ids.join(counts, "c", "left").join(audited, "c", "left").join(digests, "c", "left")
        .select(
            "conv_id", *[v.alias(n) for n, v in zero.items()], F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
        )
    )
