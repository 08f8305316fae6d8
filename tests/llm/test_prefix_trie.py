import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from quoteflow.llm import prefix_trie
from quoteflow.llm.prefix_trie import conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string, at long, depth int, hi string, band long, path string, n int"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, *[None] * 6) for r in rows], SCHEMA)


def plain(rows):
    """The nodes as {opening: row}, from whole conversations in memory."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            turns[conv].append((turn is not None, turn or 0, f"{role}\x01{text}"[:64], digest, role, text))
    turns = {c: [x[4:] for x in sorted(v)] for c, v in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        donor = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        path = tuple(turns.get(donor, [])[:h] + own[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    below = {}
    for node in sorted(members, key=len, reverse=True):
        saved = (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
        leaves = 0 if children[node] else 1
        for c in children[node]:
            leaves, saved = leaves + below[c][0], saved + below[c][1]
        below[node] = leaves, saved
    out = []
    for node, who in members.items():
        sha = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        parent = min(members[node[:-1]]) if node else None
        out.append((min(who), len(node), parent, len(who), len(children[node]), *below[node], sha))
    return out


def order(rows):
    return sorted(rows, key=repr)


def check(spark, rows, height, parts=3):
    got = conversation_trie(conversations(spark, rows).repartition(parts), height)
    assert got.columns[:4] == ["conv_id", "depth", "parent_conv_id", "n_convs"]
    assert order(tuple(r) for r in got.collect()) == order(plain(rows))


AWKWARD = [
    (0, 0, "user", "a"),
    (0, 1, "assistant", "b"),
    (0, None, "system", "first"),
    (1, 0, None, "a"),
    (1, 0, "", "a"),  # the same turn twice
    (1, 5, "user", None),
    (2, 1, "user", "x" * 70 + "1"),  # told apart behind what is sorted by
    (2, 1, "user", "x" * 70 + "2"),
    (3, 0, "ab", "c"),
    (4, 0, "a", "bc"),  # the same letters, divided elsewhere
    (5, 0, "user", "ü€😀"),
    (6, 0, "user", ""),
    (-3, 0, "user", "a"),
    (-7, 2, "user", "b"),
    (23, 0, "user", "no donor"),
    (None, 0, "user", "nobody"),
    (None, None, None, None),
]


def test_awkward_turns(spark):
    check(spark, AWKWARD, 32)


def test_no_rows_no_nodes(spark):
    assert conversation_trie(conversations(spark, [])).collect() == []
    assert conversation_trie(conversations(spark, [(None, 1, "a", "b")])).collect() == []


@pytest.mark.parametrize("height", [2, 3, 32])
def test_deep_and_shared_in_bands_of_any_height(spark, height):
    rng = random.Random(height)
    rows = [(10, i, "user", rng.choice("ab")) for i in range(75)]  # more rounds than one
    rows += [(15, i, "user", rows[i][3]) for i in range(60)]  # goes off or ends half way
    for c in range(20, 60):
        rows += [(c, i, "user", rng.choice("ab")) for i in range(rng.randrange(1, 9))]
    rng.shuffle(rows)
    check(spark, rows, height, 7)


def test_one_conversation_over_many_partitions(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(5, i, "user", str(i % 3)) for i in range(50)] + [(c, 0, "user", "0") for c in range(6, 12)]
        check(spark, rows, 8, 5)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_a_hot_ending_in_several_blocks_of_ids(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "_BLOCK", 4)
    monkeypatch.setattr(prefix_trie, "_HEAVY", 3)
    check(spark, [(c, 0, "user", "hello") for c in range(100, -31, -1)], 32)
    check(spark, [(c, 0, "user", str(c % 50)) for c in range(100)], 32)  # many children of one parent
