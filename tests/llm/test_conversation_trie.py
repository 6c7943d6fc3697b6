"""The trie against one that is grown turn by turn."""

import hashlib
import random
import zlib

import pytest

from veridect.llm import conversation_trie
from veridect.llm.conversation_trie import conversation_turns, prefix_trie, regenerate

SCHEMA = "conv_id long, turn long, role string, text string, depth string, t1 long, prior string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """All nodes by prefix."""
    conversations = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            conversations.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    conversations = {c: [t[2:] for t in sorted(turns)] for c, turns in conversations.items()}
    members, ends = {}, {}
    for c, turns in conversations.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt = tuple(conversations.get(c - c % 5, [])[:h] + turns[h:])
        for d in range(len(rebuilt) + 1):
            members.setdefault(rebuilt[:d], []).append(c)
        ends.setdefault(rebuilt, []).append(c)
    children, leaves, saved = {}, {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves.setdefault(node, 0 if children.get(node) else 1)
        saved[node] = saved.get(node, 0) + (len(node) and (len(members[node]) - 1) * len(node[-1][1].encode()))
        if node:
            up = node[:-1]
            children[up] = children.get(up, 0) + 1
            leaves[up] = leaves.get(up, 0) + leaves[node]
            saved[up] = saved.get(up, 0) + saved[node]
    return sorted(
        (
            min(members[n]),
            len(n),
            min(members[n[:-1]]) if n else -1,
            len(members[n]),
            children.get(n, 0),
            leaves[n],
            saved[n],
            hashlib.sha256(",".join(map(str, sorted(ends.get(n, [])))).encode()).hexdigest(),
        )
        for n in members
    )


def trie(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    nodes = prefix_trie(regenerate(conversation_turns(frame)))
    return sorted(tuple(-1 if v is None else v for v in r) for r in nodes.select(*COLUMNS).collect())


def conversation(conv, texts, start=0):
    return [(conv, start + i, "user" if i % 2 else "assistant", t, "d", 1, "p") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for conv in range(60):
        out += conversation(conv, [rng.choice(["a", "bé", "cc"]) for _ in range(rng.choice([1, 2, 7, 8, 9, 16, 17, 30]))])
    for conv in range(100, 400):  # a conversation that many have
        out += conversation(conv, ["same", "again", ""])
    for conv in range(400, 420):  # long common beginnings that part late
        out += conversation(conv, ["x"] * (30 + conv % 3) + [str(conv % 7)] * 9)
    out += conversation(1000, [f"{i}" for i in range(200)])
    out += [(2000, None, None, None, "d", 1, "p"), (2000, 3, "user", "z", "d", 1, "p"), (2000, 3, "user", "z", "d", 1, "p")]
    out += [(None, 1, "user", "nobody's", "d", 1, "p"), (-3, 0, "user", "below zero" * 30000, "d", 1, "p")]
    out += [(2003, 0, "user", "no first of the family", "d", 1, "p")]
    rng.shuffle(out)
    return out


def test_equals_plain_trie(spark, rows):
    want = plain([r for r in rows if r[0] != -3])
    assert trie(spark, [r for r in rows if r[0] != -3]) == want


def test_hot_parents_give_the_same(spark, rows, monkeypatch):
    some = [r for r in rows if r[0] is not None and 0 <= r[0] < 150]
    monkeypatch.setattr(conversation_trie, "HOT_CHILDREN", 2)
    monkeypatch.setattr(conversation_trie, "DIGEST_IDS", 4)
    assert trie(spark, some) == plain(some)


def test_negative_ids_and_long_texts(spark):
    got = trie(spark, conversation(-3, ["a" * 1_000_000, "b"]))
    assert got[-1][0] == -3 and sum(r[1] == 0 for r in got) == 1


def test_empty(spark):
    assert trie(spark, []) == []
