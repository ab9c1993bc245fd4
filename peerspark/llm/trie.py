"""Prefix trie of conversations: union-find over sorted neighbours' common prefixes, forests merged across partitions."""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .staging import dealt_width, staged

MARK = 16      # bytes of a turn's digest
FAN = 64       # neighbouring forests that one group merges
CHUNK = 4096   # ids in one piece of a node's end list
_NOTHING = hashlib.sha256(b"").hexdigest()
_WORDS = r"[\x20\x09-\x0D]+"
_NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
         "ends_sha256 string, ident binary, parent binary")
_FOREST = "first binary, last binary, shared array<long>, left_side array<long>, right_side array<long>"
_LEVEL = f"kind string, part long, {_NODE}, {_FOREST}, at long, ids string"
_TYPES = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
_ARROW = pa.schema([(name, _TYPES[kind]) for name, kind in (c.strip().split(" ") for c in _LEVEL.split(","))])


class Node:
    """A prefix. ``n`` members so far, ``least`` of their ids; ``children``, ``leaves`` and ``saved`` of the subtrees
    that are complete. ``merged`` leads to the node that took this one in."""
    __slots__ = ("depth", "n", "least", "children", "leaves", "saved", "words", "ends", "ident", "merged", "done")

    def __init__(self, depth: int, n: int, least: int, words: int, children: int = 0, leaves: int = 0, saved: int = 0):
        self.depth, self.n, self.least, self.words = depth, n, least, words
        self.children, self.leaves, self.saved = children, leaves, saved
        self.ends: list[int] = []
        self.ident: bytes | None = None
        self.merged: Node | None = None
        self.done = False

    def found(self) -> Node:
        """The node that stands for this one now; the path to it is halved."""
        node = self
        while node.merged is not None:
            if node.merged.merged is not None:
                node.merged = node.merged.merged
            node = node.merged
        return node


class Forest:
    """A run of sorted sequences, contracted: only the prefixes of its first and of its last sequence are open.
    ``shared`` holds those of both by depth, ``left`` and ``right`` the deeper ones of either, deepest first."""
    __slots__ = ("first", "last", "shared", "left", "right")

    def __init__(self, first: bytes, last: bytes, shared: list[Node], left: deque[Node], right: deque[Node]):
        self.first, self.last, self.shared, self.left, self.right = first, last, shared, left, right


def common(a: bytes, b: bytes) -> int:
    """Number of turns with which both sequences start."""
    low, high = 0, min(len(a), len(b)) // MARK
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid * MARK] == b[:mid * MARK]:
            low = mid
        else:
            high = mid - 1
    return low


class Trie:
    """Merges forests and collects the nodes that are complete, each with its parent."""

    def __init__(self) -> None:
        self.complete: list[tuple[Node, Node | None]] = []

    def close(self, node: Node, parent: Node | None) -> None:
        """No more members can come: the subtree's sums go to the parent."""
        node.leaves += not node.children
        node.saved += (node.n - 1) * node.words
        node.done = True
        if parent is not None:
            parent.children += 1
            parent.leaves += node.leaves
            parent.saved += node.saved
        self.complete.append((node, parent))

    def _close_side(self, side: deque[Node], shared: list[Node], depth: int) -> None:
        while side and side[0].depth > depth:
            node = side.popleft()
            self.close(node, side[0] if side else shared[-1])

    def merge(self, a: Forest, b: Forest, depth: int) -> Forest:
        """The forest of ``a`` and its right neighbour ``b``, whose facing sequences share ``depth`` turns."""
        in_a, in_b = len(a.shared) - 1, len(b.shared) - 1
        self._close_side(a.right, a.shared, depth)
        self._close_side(b.left, b.shared, depth)
        path = []
        for d in range(min(depth, in_a) + 1):
            path.append(a.shared[d])
        path.extend(reversed(a.right))
        other = b.shared[:depth + 1]
        other.extend(reversed(b.left))
        for mine, its in zip(path, other):
            mine.n += its.n
            mine.least = min(mine.least, its.least)
            mine.children += its.children
            mine.leaves += its.leaves
            mine.saved += its.saved
            mine.ends += its.ends
            its.merged = mine
        for d in range(depth, max(in_a, in_b), -1):  # on neither the first nor the last sequence any more
            self.close(path[d], path[d - 1])
        both = min(in_a, in_b, depth)
        left, right = a.left, b.right
        left.extend(reversed(a.shared[depth + 1:]))
        right.extend(reversed(b.shared[depth + 1:]))
        left.extend(reversed(path[both + 1:min(depth, in_a) + 1]))
        right.extend(reversed(path[both + 1:min(depth, in_b) + 1]))
        return Forest(a.first, b.last, path[:both + 1], left, right)

    def union(self, forests: list[Forest]) -> Forest:
        """Neighbouring forests joined along their edges in descending depth. Every join of components at a depth
        makes the prefix of that depth a branching node, or gives it another branch."""
        edges = [common(a.last, b.first) for a, b in zip(forests, forests[1:])]
        root = list(range(len(forests)))     # of a component: its leftmost forest

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for e in np.argsort(-np.array(edges, np.int64), kind="stable").tolist():
            i, j = find(e), find(e + 1)
            forests[i] = self.merge(forests[i], forests[j], edges[e])
            root[j] = i
        return forests[0]

    def close_all(self, forest: Forest) -> None:
        self._close_side(forest.left, forest.shared, 0)
        self._close_side(forest.right, forest.shared, 0)
        for d in range(len(forest.shared) - 1, -1, -1):
            self.close(forest.shared[d], forest.shared[d - 1] if d else None)


def _name(sequence: bytes, nodes: list[Node]) -> None:
    """Identities of the nodes of depth 0, 1, ... along a sequence: digests of their prefixes."""
    state = hashlib.sha256()
    for node in nodes:
        if node.depth:
            state.update(sequence[(node.depth - 1) * MARK:node.depth * MARK])
        node.ident = state.digest()


def _named(forest: Forest) -> Forest:
    _name(forest.first, [*forest.shared, *reversed(forest.left)])
    _name(forest.last, [*forest.shared, *reversed(forest.right)])
    return forest


def _rows(part: int, trie: Trie, forest: Forest | None) -> Iterator[dict]:
    """Complete nodes, the ends of open ones, and what remains open. A parent that is still open is told by identity."""
    for node, parent in trie.complete:
        parent = parent and parent.found()
        closed = parent is not None and parent.done
        yield {"kind": "node", "part": part, "conv_id": node.least, "depth": node.depth, "n_convs": node.n, "n_children": node.children,
               "n_leaves": node.leaves, "saved_tokens": node.saved, "ident": node.ident,
               "ends_sha256": None if node.ident else hashlib.sha256(",".join(map(str, node.ends)).encode()).hexdigest(),
               "parent_conv_id": parent.least if closed else None, "parent": None if closed or parent is None else parent.ident}
    if forest is None:
        return
    sides = {"shared": forest.shared, "left_side": list(forest.left), "right_side": list(forest.right)}
    for nodes in sides.values():
        for node in nodes:
            for at in range(0, len(node.ends), CHUNK):
                yield {"kind": "ends", "part": part, "ident": node.ident, "at": at, "ids": ",".join(map(str, node.ends[at:at + CHUNK]))}
    flat = {side: [v for x in nodes for v in (x.n, x.least, x.words, x.children, x.leaves, x.saved)] for side, nodes in sides.items()}
    yield {"kind": "forest", "part": part, "first": forest.first, "last": forest.last, **flat}


def _batches(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == 4096:
            yield pa.RecordBatch.from_pylist(held, _ARROW)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, _ARROW)


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forest of one sorted partition. Equal sequences are one forest from the start."""
    forests: list[Forest] = []
    for batch in batches:
        for sequence, conv, words in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if forests and forests[-1].last == sequence:
                for node in forests[-1].shared:
                    node.n += 1
                    node.least = min(node.least, conv)
                forests[-1].shared[-1].ends.append(conv)
                continue
            nodes = [Node(d, 1, conv, w) for d, w in enumerate([0, *words])]
            nodes[-1].ends.append(conv)
            forests.append(Forest(sequence, sequence, nodes, deque(), deque()))
    if not forests:
        return
    trie = Trie()
    forest = _named(trie.union(forests))
    yield from _batches(_rows(TaskContext.get().partitionId(), trie, forest))


def _restored(row: dict) -> Forest:
    """An open forest from its row."""
    read = {}
    shared_depth, sides = len(row["shared"]) // 6, ("shared", "left_side", "right_side")
    for side in sides:
        flat = row[side]
        count = len(flat) // 6
        depths = range(count) if side == "shared" else range(shared_depth + count - 1, shared_depth - 1, -1)
        read[side] = [Node(d, *flat[6 * i:6 * i + 6]) for i, d in enumerate(depths)]
    return _named(Forest(row["first"], row["last"], read["shared"], deque(read["left_side"]), deque(read["right_side"])))


def _merged(forests: DataFrame, fan: int, last: bool) -> DataFrame:
    """One level up: every ``fan`` neighbouring forests become one; the last level leaves nothing open."""
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        trie = Trie()
        forest: Forest | None = trie.union([_restored(r) for r in rows])
        if last:
            trie.close_all(forest)
            forest = None
        return pa.Table.from_batches(_batches(_rows(rows[0]["part"] // fan, trie, forest)), _ARROW)

    return (forests.select("part", *[c.strip().split(" ")[0] for c in _FOREST.split(", ")]).withColumn("_group", F.floor(F.col("part") / fan))
            .groupBy("_group").applyInArrow(run, _LEVEL))


def _end_digests(chunks: DataFrame) -> DataFrame:
    """Digest of every open node's end list (ident, ends): its pieces pass one by one, in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ident, state = None, None
        for batch in batches:
            done: list[tuple[bytes, str]] = []
            for own, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if own != ident:
                    if ident is not None:
                        done.append((ident, state.hexdigest()))
                    ident, state = own, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _ended(done)
        if ident is not None:
            yield _ended([(ident, state.hexdigest())])

    ordered = chunks.repartition("ident").sortWithinPartitions("ident", "part", "at").select("ident", "ids")
    return ordered.mapInArrow(run, "ident binary, ends string")


def _ended(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())],
                                      names=["ident", "ends"])


def turn_marks(turns: DataFrame) -> DataFrame:
    """conv_id with its turns in order: marks (16 bytes of SHA-256 over role and text) and words (numbers of words)."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    words = F.size(F.filter(F.split(text, _WORDS), lambda w: w != ""))
    mark = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, MARK)
    # equal turns go by role and text; only their places travel on
    rows = turns.filter("conv_id is not null").select("conv_id", "turn", role.alias("_role"), text.alias("_text"), mark.alias("m"), words.alias("w"))
    tied = W.partitionBy("conv_id", "turn").orderBy("_role", "_text")
    rows = rows.withColumn("_place", F.row_number().over(tied))
    one = F.struct(F.col("turn").isNotNull().alias("o"), F.col("turn").alias("t"), F.col("_place").alias("p"), "m", "w")
    listed = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("x"))
    return listed.select("conv_id", F.transform("x", lambda x: x["m"]).alias("marks"), F.transform("x", lambda x: x["w"]).alias("words"))


def rebuilt(turns: DataFrame, family: int = 20, heads: int = 4) -> DataFrame:
    """Conversations (conv_id, marks, words) that start with the first h turns of conversation c - c % family, where
    h = crc32(decimal c) % heads, and go on with their own turns after the first h."""
    own = turn_marks(turns)
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    base = own.filter(F.col("conv_id") % family == 0).select(
        F.col("conv_id").alias("_base"), F.slice("marks", 1, heads - 1).alias("_marks"), F.slice("words", 1, heads - 1).alias("_words"))
    rows = own.withColumn("_base", F.col("conv_id") - F.col("conv_id") % family).withColumn("_h", h).join(base, "_base", "left")

    def spliced(name: str, empty: Column) -> Column:
        head = F.slice(F.coalesce(F.col(f"_{name}"), empty), F.lit(1), F.col("_h"))
        return F.concat(head, F.slice(name, F.col("_h") + 1, F.greatest(F.size(name) - F.col("_h"), F.lit(0))))

    return rows.select("conv_id", spliced("marks", F.array().cast("array<binary>")).alias("marks"),
                       spliced("words", F.array().cast("array<int>")).alias("words"))


def prefix_trie(sequences: DataFrame, target: int = 4 << 20, fan: int = FAN) -> DataFrame:
    """All prefixes of ``sequences`` (conv_id long, distinct and not null; marks array<binary>; words array<int>): one row
    per node with conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Sequences are sorted by range over all partitions, equal ones by id, so that a sequence that a third of all
    conversations have is spread too. Each partition joins neighbours by union-find over the edges of their
    common prefixes, deepest first, and reports the nodes that lie within it. Only the prefixes of its first and
    last sequence stay open. These contracted forests are merged across partition boundaries, ``fan`` at a time,
    level by level. End lists of open nodes travel as pieces of decimal ids and pass a digest in order; a hot
    node's pieces are one row per CHUNK ids. Nothing else of a node grows with its members.

    A conversation's turn digests (16 bytes each) are one row, and a partition's nodes are held by its task;
    partitions follow from the total number of turns. Empty sequences end at the root. No sequences, no nodes.
    Turns are equal when 16 bytes of their SHA-256 are.
    """
    spark = sequences.sparkSession
    keyed = staged(sequences.select(F.array_join(F.transform("marks", lambda m: F.hex(m)), "").alias("key"), "conv_id", "words")
                   .withColumn("key", F.unhex("key")), "sequences")
    size = keyed.agg(F.sum(F.length("key") + 32)).first()[0]
    parts = dealt_width(spark, size or 0, target)
    ordered = keyed.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    level = staged(ordered.mapInArrow(_local, _LEVEL), "trie-0")
    width = (level.agg(F.max("part")).first()[0] or 0) + 1
    levels = [level]
    while len(levels) == 1 or width > 1:
        width = -(-width // fan)
        levels.append(staged(_merged(levels[-1].filter("kind = 'forest'"), fan, width == 1), f"trie-{len(levels)}"))

    ends = _end_digests(level.filter("kind = 'ends'"))
    nodes = [(one.filter("kind = 'node'").withColumn("_level", F.lit(i))) for i, one in enumerate(levels)]
    opened = nodes[1]
    for more in nodes[2:]:
        opened = opened.unionByName(more)
    opened = opened.join(ends, "ident", "left").withColumn("ends_sha256", F.coalesce("ends", F.lit(_NOTHING)))
    # what a forest leaves open is asked for by the nodes below it: one row per (level, partition, open prefix)
    ids = opened.select(F.col("ident").alias("parent"), F.col("conv_id").alias("_parent_conv"))
    every = nodes[0].unionByName(opened.select(*nodes[0].columns))
    wanted = every.filter("parent is not null").select("_level", "part", "parent").distinct().join(ids, "parent")
    told = every.join(wanted, ["_level", "part", "parent"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_parent_conv"))
    return told.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversation_trie(turns: DataFrame, family: int = 20, heads: int = 4) -> DataFrame:
    """``prefix_trie`` over the rebuilt conversations of ``turns`` (conv_id, turn, role, text).

    Turns go by turn, null first, then by role and text; null roles and texts are empty. Rows without conv_id
    take no part. Repeated rows are turns of their own. An empty table gives no nodes; other columns are ignored.
    """
    return prefix_trie(rebuilt(turns.select("conv_id", "turn", "role", "text"), family, heads))
