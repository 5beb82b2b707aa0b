"""The prefix trie against nested dictionaries."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from ledgerloom.llm import prefix_trie
from ledgerloom.llm.queries import QUERIES

ROWS = "conv_id long, turn long, role string, text string"


def plain(rows):
    given = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            given[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in given.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for depth in range(len(turns) + 1):
            members[tuple(turns[:depth])].append(c)
    leaves, saved, children = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, own_members in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for depth in range(len(node) + 1):
            leaves[node[:depth]] += node not in children
            saved[node[:depth]] += (len(own_members) - 1) * words
    found = {}
    for node, own_members in members.items():
        ends = ",".join(str(c) for c in sorted(own_members) if len(built[c]) == len(node))
        above = min(members[node[:-1]]) if node else None
        found[(min(own_members), len(node))] = (
            above, len(own_members), children.get(node, 0), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest(),
        )
    return found


def trie(frame):
    turns = prefix_trie.ordered_turns(frame)
    rows = prefix_trie.prefix_trie(prefix_trie.shared_starts(turns), turns).collect()
    assert len({(r.conv_id, r.depth) for r in rows}) == len(rows)
    return {(r.conv_id, r.depth): tuple(r[2:]) for r in rows}


def test_query_on_whole_table(spark, sf):
    frame = spark.read.parquet(f"{sf}/conversations.parquet")
    got = {(r.conv_id, r.depth): tuple(r[2:]) for r in QUERIES["op11_prefix_trie"](spark, sf).collect()}
    assert got == plain([tuple(r) for r in frame.select("conv_id", "turn", "role", "text").collect()])


def test_shared_starts_of_few_texts(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice("ua"), rng.choice(["x", "x y", ""])) for c in rng.sample(range(200), 90) for t in range(rng.randint(1, 6))]
    assert trie(spark.createDataFrame(rows, ROWS)) == plain(rows)


def test_nulls_repeats_ids_and_other_columns(spark):
    rows = [
        (0, None, None, None), (0, 1, "user", "a b\x0bc"), (0, 1, "user", "a b\x0bc"), (21, 4, "user", "é ü"), (-5, 2, None, "x"),
        (None, 1, "user", "not in any"), (40, 9223372036854775807, "user", "late"), (40, -9223372036854775808, "user", "early"),
    ]
    frame = spark.createDataFrame([(*r, 7, "z", 1) for r in rows], ROWS + ", depth long, position string, h1 int")
    assert trie(frame) == plain(rows)


def test_empty_table_and_one_long_conversation(spark):
    assert trie(spark.createDataFrame([], ROWS)) == {}
    rows = [(3, k, "user", f"w{k} " * 3) for k in range(400)] + [(4, 0, "user", "long " * 50_000)]
    assert trie(spark.createDataFrame(rows, ROWS).repartition(5)) == plain(rows)


@pytest.mark.parametrize("n", [1, 2, 5000])
def test_list_positions(spark, n):
    ids = random.Random(n).sample(range(10 * n), n)
    links = [(x, 0, after, None if after is None else 0) for x, after in zip(ids, [*ids[1:], None])]
    frame = spark.createDataFrame(links, "x1 long, x2 long, n1 long, n2 long").repartition(4)
    got = prefix_trie.list_ranks(frame, small=300).collect()
    assert {r.x1: r.position for r in got} == {x: k for k, x in enumerate(ids)} and len(got) == n
