"""Repairs against a plain search over whole audits."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from ledgerloom.llm import conversation_repair
from ledgerloom.llm.queries import QUERIES

ROWS = "conv_id long, turn long, role string, text string"
AFTER = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "p"}, "p": {"u": "u"}}


def search(rows):
    """The first legal result in order of (cost, audit)."""
    heap = [(0, "", 0, "", ())]
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if i == len(rows) and state in ("", "p"):
            return cost, audit, out
        if cost > 4 * len(rows):
            continue
        for role in ("user", "assistant"):
            if role[0] in AFTER[state]:
                heapq.heappush(heap, (cost + 3, audit + "I", i, AFTER[state][role[0]], (*out, (role, ""))))
        if i == len(rows):
            continue
        role, text, gone, short = rows[i]
        heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, out))
        if gone:
            continue
        cost += 3 if short else 0
        if role[:1] in AFTER[state]:
            heapq.heappush(heap, (cost, audit + "K", i + 1, AFTER[state][role[:1]], (*out, (role, text))))
        for other in ("user", "assistant"):
            if other[0] in AFTER[state]:
                heapq.heappush(heap, (cost + 3, audit + "R", i + 1, AFTER[state][other[0]], (*out, (other, text))))


def plain(rows):
    held = defaultdict(list)
    for conv, turn, *rest in rows:
        name = [" " if v is None else str(v) for v in (conv, turn, *rest)]
        role, text = name[2:]
        fault = zlib.crc32(f"{name[0]}:{name[1]}".encode()) % 20
        held[conv]
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        if fault:
            held[conv] += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    found = {}
    for conv, own in held.items():
        own = sorted(own, key=lambda r: (r[0] is not None, r[0] or 0))
        turns = [r[0] for r in own if r[0] is not None]
        seen, judged, counts = set(), [], [0, 0, 0]
        for _, role, text in own:
            ink = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = 0 if not ink else 1 if (role, text) in seen else 2 if ink[-1] not in ".!?" else None
            if fault is not None:
                counts[fault] += 1
            seen.add((role, text))
            judged.append((role, text, fault in (0, 1), fault == 2))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
        cost, audit, out = search(judged)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
        found[conv] = (gaps, *counts, illegal, cost, audit, digest)
    return found


def repairs(frame):
    rows = conversation_repair.repairs(frame).collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r[1:]) for r in rows}


def test_query_on_whole_table(spark, sf):
    frame = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    got = {r.conv_id: tuple(r[1:]) for r in QUERIES["op12_conversation_repair"](spark, sf).collect()}
    assert got == plain([tuple(r) for r in frame.collect()])


@pytest.mark.parametrize("chunk", [1, 3, 4096])
def test_all_kinds_of_rows(spark, monkeypatch, chunk):
    monkeypatch.setattr(conversation_repair, "CHUNK", chunk)
    rng = random.Random(3)
    roles, texts = ["system", "user", "assistant", "user", "assistant", "tool", "", None], ["a.", "b!", "c", " ", None, "d? \n", "e.f"]
    rows = [(c, t, rng.choice(roles), f"{rng.choice(texts)}" if rng.random() < 0.9 else None) for c in range(60) for t in range(rng.randint(1, 6))]
    assert repairs(spark.createDataFrame(rows, ROWS)) == plain(rows)


def test_nulls_ties_repeats_and_other_columns(spark):
    rows = [(None, None, None, None), (None, 3, "user", "x."), (5, None, "user", "a."), (5, None, "user", "a."), (5, 7, "assistant", "b."),
            (6, 1, None, None)]
    frame = spark.createDataFrame([(*r, "z", 1, "c") for r in rows], ROWS + ", c string, position int, fault string")
    assert repairs(frame) == plain(rows)


def test_nothing_left_and_empty_table(spark):
    assert repairs(spark.createDataFrame([], ROWS)) == {}
    dropped = [c for c in range(500) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:2]
    got = repairs(spark.createDataFrame([(c, 0, "user", "a.") for c in dropped], ROWS))
    assert got == {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in dropped}


def test_long_conversation_and_long_text(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"t{t}" + rng.choice([".", ""])) for t in range(3000)]
    rows.append((2, 0, "user", "w " * 200_000 + "."))
    frame = spark.createDataFrame(rows, ROWS).repartition(6)
    whole = repairs(frame)
    monkeypatch.setattr(conversation_repair, "CHUNK", 64)
    assert repairs(frame) == whole and set(whole) == {1, 2}
    assert whole[1][6].replace("I", "").count("K") > 1000
