"""Prefix trie against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from peerspark.llm.trie import Forest, Node, Trie, common, conversation_trie, prefix_trie, rebuilt

TURNS = "extra string, conv_id long, turn long, role string, text string, depth long, part long"


def brute_rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    rem = lambda c: c - (abs(c) % 20) * (1 if c >= 0 else -1)
    return {c: own.get(rem(c), [])[:h] + t[h:] for c, t in own.items() for h in [zlib.crc32(str(c).encode()) % 4]}


def brute_trie(sequences):
    members = defaultdict(list)
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, cs in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(cs) - 1) * words
    ends = lambda p: ",".join(map(str, sorted(c for c in members[p] if len(sequences[c]) == len(p))))
    return sorted((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), children[p], leaves[p], saved[p],
                   hashlib.sha256(ends(p).encode()).hexdigest()) for p, cs in members.items())


def conversations(seed, n=160, hot=0):
    rnd = random.Random(seed)
    rows = []
    for c in [*rnd.sample(range(-60, 500), n), *range(1000, 1000 + hot)]:
        if c >= 1000:
            turns = [("system", "be brief"), ("user", "hello there"), ("assistant", "hi")]
        else:
            turns = [(rnd.choice(["user", "assistant", None]), rnd.choice(["a", "b c", "", None, "é\x1c x\x0by"])) for _ in range(rnd.randrange(1, 7))]
        rows += [(c, rnd.choice([None, k, k, k]), r, t) for k, (r, t) in enumerate(turns)]
    rows += [(3, 0, "user", "a"), (3, 0, "user", "a"), (None, 0, "user", "a"), (2001, 0, "user", "long " * 50_000)]
    rows += [(2020, k, "user", "again") for k in range(400)] + [(2021, k, "user", "again") for k in range(400)]
    return rows


@pytest.mark.parametrize("seed, hot, fan", [(1, 0, 64), (2, 300, 64), (3, 300, 2)])
def test_trie_equals_brute_force(spark, seed, hot, fan):
    rows = conversations(seed, hot=hot)
    frame = spark.createDataFrame([("x", *r, 1, 2) for r in rows], TURNS).repartition(4)
    want = brute_trie(brute_rebuilt(rows))
    assert sorted((tuple(r) for r in prefix_trie(rebuilt(frame), fan=fan).collect()), key=str) == sorted(want, key=str)
    if fan == 64:
        got = conversation_trie(frame)
        assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)


def test_turnless_and_no_conversations(spark):
    frame = spark.createDataFrame([("x", *r, 1, 2) for r in [(c, 0, "user", "a") for c in range(21, 29)]], TURNS)
    want = brute_trie(brute_rebuilt([tuple(r)[1:5] for r in frame.collect()]))
    assert any(w[1] == 0 and w[7] != hashlib.sha256(b"").hexdigest() for w in want)  # some are empty once rebuilt
    assert sorted((tuple(r) for r in conversation_trie(frame).collect()), key=str) == sorted(want, key=str)
    assert conversation_trie(frame.limit(0)).count() == 0


def test_forests_merge_in_any_grouping():
    """Contracted forests of any cut of the sorted sequences give the same nodes as all sequences at once."""
    rnd = random.Random(5)
    for _ in range(60):
        sequences = sorted({b"".join(bytes([rnd.randrange(2)]) * 16 for _ in range(rnd.randrange(6))) for _ in range(25)})

        def leaf(i, s):
            nodes = [Node(d, 1, i, d) for d in range(len(s) // 16 + 1)]
            return Forest(s, s, nodes, __import__("collections").deque(), __import__("collections").deque())

        def nodes(cuts):
            trie, parts = Trie(), []
            for a, b in zip(cuts, cuts[1:]):
                parts.append(trie.union([leaf(i, s) for i, s in enumerate(sequences[a:b], a)]))
            trie.close_all(trie.union(parts))
            return sorted((n.least, n.depth, n.n, n.children, n.leaves, n.saved) for n, _ in trie.complete)

        whole = nodes([0, len(sequences)])
        assert len(whole) == len({s[:d] for s in sequences for d in range(0, len(s) + 1, 16)})
        for _ in range(3):
            inner = sorted(rnd.sample(range(1, len(sequences)), min(4, len(sequences) - 1)))
            assert nodes([0, *inner, len(sequences)]) == whole


def test_common_prefix_length():
    a, b = b"x" * 16 * 5 + b"y" * 16, b"x" * 16 * 5 + b"z" * 32
    assert common(a, b) == 5 and common(a, a) == 6 and common(b"", a) == 0
