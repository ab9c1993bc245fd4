"""Substring deduplication by recompression of word sequences."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .staging import dealt_width, shuffle_width
from .wordhash import U64, mix, spans_hash, word_slices

FAR = 1 << 40
REPORTED = 1 << 21    # symbols that a task holds before it reports them
TASK_BYTES = 64 << 20  # text of a partition, which holds whole parts
_ANCHOR, _FIRST, _SECOND = 0xD1342543DE82EF95, 0xDA942042E4DD58B5, 0xAF251AF3B0F025B5


def compress(names: np.ndarray, rows: np.ndarray, lo: np.ndarray, hi: np.ndarray, level: int):
    """One round: runs of a symbol, then pairs of a left and a right symbol, get new names."""
    n = len(names)
    if not n:
        return names, rows, lo, hi
    # runs
    new_row = np.ones(n, bool)
    new_row[1:] = rows[1:] != rows[:-1]
    first = new_row.copy()
    first[1:] |= names[1:] != names[:-1]
    at = np.flatnonzero(first)
    length = np.diff(np.append(at, n))
    last = at + length - 1
    begins = new_row[at]
    ends = np.append(begins[1:], True)
    run_lo = np.where(begins, -FAR, lo[np.maximum(at - 1, 0)])
    run_hi = np.where(ends, FAR, hi[np.minimum(last + 1, n - 1)])
    name = names[at]
    name = np.where(length > 1, mix(name + length.astype(U64) * U64(0x9FB21C651E98DF25) + U64(2 * level + 1)), name)
    row, lo, hi = rows[at], run_lo, run_hi
    # pairs
    n = len(name)
    left = (mix(name + mix(np.full(1, level, U64))) & U64(1)) == 0
    pair = np.zeros(n, bool)
    pair[:-1] = left[:-1] & ~left[1:] & ~begins[1:]
    second = np.zeros(n, bool)
    second[1:] = pair[:-1]
    lone = ~pair & ~second
    after_hi = np.append(hi[1:], FAR)
    before_lo = np.append(-FAR, lo[:-1])
    merged = mix(name * U64(0x8CB92BA72F3D8DD7) + mix(np.append(name[1:], U64(0)) + U64(level)))
    name = np.where(pair, merged, name)
    hi2 = np.where(pair, after_hi, np.where(lone & left, np.where(ends, FAR, np.maximum(hi, after_hi)), hi))
    lo2 = np.where(lone & ~left, np.where(begins, -FAR, np.minimum(lo, before_lo)), lo)
    stay = ~second
    return name[stay], row[stay], lo2[stay], hi2[stay]


def anchors(names: np.ndarray, row_words: np.ndarray, rounds: int, width: int):
    """Interior symbols that every copy of their surroundings contains: fingerprint of the words that decide
    them, and the span [lo, hi) of those words.

    After ``rounds`` rounds a symbol whose name is least among its neighbours is taken, if the words that
    its forming depended on fit a window. Equal windows contain the same such symbols at the same places.
    """
    rows = np.repeat(np.arange(len(row_words) - 1), np.diff(row_words))
    at = np.arange(len(names))
    name, row, lo, hi = names, rows, at, at + 1
    for level in range(1, rounds + 1):
        name, row, lo, hi = compress(name, row, lo, hi, level)
    if len(name) < 3:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), row[:0]
    order = mix(name)
    least = (order[1:-1] < order[:-2]) & (order[1:-1] <= order[2:]) & (row[1:-1] == row[:-2]) & (row[1:-1] == row[2:])
    low, high = np.minimum(lo[1:-1], lo[:-2]), np.maximum(hi[1:-1], hi[2:])
    take = least & (high - low <= width)
    low, high = low[take], high[take]
    return mix(spans_hash(names, low, high, _ANCHOR) + (high - low).astype(U64)), low, high, row[1:-1][take]


def _member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _candidates(texts: pa.Array, shared: np.ndarray, width: int, rounds: int):
    """Per slice: words, starts of windows without an unshared anchor, their fingerprints (64 and 32 bits)."""
    for part in word_slices(texts):
        h = part.hashes()
        n = len(h)
        ok = np.zeros(n + 1, bool)
        rows = part.row_of_word()
        if n >= width:
            ok[:n - width + 1] = rows[:n - width + 1] == rows[width - 1:]
            key, low, high, row = anchors(h, part.row_words, rounds, width)
            lone = ~_member(key, shared)
            begin = np.maximum(high[lone] - width, part.row_words[row[lone]])
            held = np.bincount(begin, minlength=n + 2)[:n + 2] - np.bincount(low[lone] + 1, minlength=n + 2)[:n + 2]
            ok &= np.cumsum(held)[:n + 1] == 0
        starts = np.flatnonzero(ok)
        if len(starts):
            first = mix(spans_hash(h, starts, starts + width, _FIRST))
            second = (mix(spans_hash(mix(h + U64(1)), starts, starts + width, _SECOND)) >> U64(33)).astype(np.int32)
        else:
            first, second = np.zeros(0, U64), np.zeros(0, np.int32)
        yield part, starts, first, second


def _single(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name).combine_chunks()
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def _nullable(kind: pa.DataType) -> pa.DataType:
    """The type without promises that nothing is null, which declared results do not make."""
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, _nullable(f.type)) for f in kind])
    if pa.types.is_list(kind):
        return pa.list_(_nullable(kind.value_type))
    return kind


def _longs(table: pa.Table, name: str) -> np.ndarray:
    return _single(table, name).to_numpy(zero_copy_only=False).astype(np.int64).view(U64)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 35, rounds: int = 3,
                   carry: Sequence[str] = (), rejoin: bool = True, reported: int = REPORTED) -> DataFrame:
    """Take out every word covered by a window of ``width`` words whose sequence also starts anywhere else,
    same document included. One row per input row: ``id_col``, the ``carry`` columns, ``text_col`` (kept
    words joined by one space), n_words, n_removed. Without ``rejoin``, a text that loses nothing keeps its
    white space.

    Recompression names runs and pairs of symbols, round by round. A name is a fingerprint of what it
    stands for, so all tasks give equal content the same name and a round needs no exchange. Interior
    symbols of equal substrings agree. Documents are dealt to parts of bounded size. Each part reports its
    distinct interior symbols once, whatever their number in it (again after every ``reported`` symbols, which bounds a task); symbols that are found twice in the corpus
    return to the parts that have them. A window can repeat only if no interior symbol in it is unique. Such
    windows are counted by 95-bit fingerprints, again once per part, and those found once are sent back as
    refuted; all others are removed. A passage that a third of all documents share costs one row per part.

    Null and empty texts have no words. Rows with null or repeated ids are rows like others: two rows with
    equal texts of ``width`` words or more remove each other. Texts shorter than ``width`` words stay. An
    empty table gives no rows. Clashing names in ``carry`` are kept as they are; columns not named are dropped.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_col)).alias("b")).first()["b"]
    parts = dealt_width(spark, size, 4 << 20)
    keep = [id_col, *[c for c in carry if c not in (id_col, text_col)]]
    dealt = docs.select(F.struct(*[F.col(c).alias(f"c{k}") for k, c in enumerate(keep)]).alias("own"), F.coalesce(text_col, F.lit("")).alias("text"),
                        F.pmod(F.xxhash64(id_col, F.length(text_col)), F.lit(parts)).cast("int").alias("part"))
    # every pass below reads all of ``dealt``, so that Spark reuses this one exchange of the texts
    dealt = dealt.repartition(dealt_width(spark, size, TASK_BYTES), "part")

    def counted_keys(found: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for p, keys in found.items():
            key, n = np.unique(np.concatenate(keys), return_counts=True)
            for at in range(0, len(key), 1 << 16):
                k = key[at:at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(np.full(len(k), p, np.int32)),
                                                  pa.array(np.minimum(n[at:at + len(k)], 2).astype(np.int8))], names=["a", "part", "n"])

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[np.ndarray]] = {}
        held = 0
        for batch in batches:
            own = batch.column(2).to_numpy()
            for part in word_slices(batch.column(1)):
                key, _, _, row = anchors(part.hashes(), part.row_words, rounds, width)
                of = own[part.first:part.last][row]
                for p in np.unique(of):
                    found.setdefault(int(p), []).append(key[of == p])
                held += len(key)
                if held > reported:  # a part may report a symbol again: counts add up
                    yield from counted_keys(found)
                    found, held = {}, 0
        yield from counted_keys(found)

    symbols = dealt.mapInArrow(report, "a long, part int, n tinyint")
    shared = (symbols.withColumn("all", F.sum("n").over(W.partitionBy("a"))).filter("all > 1")
              .select("part", "a", F.lit(0).cast("int").alias("b"), F.lit(True).alias("symbol")))

    def windows(left: pa.Table, right: pa.Table) -> pa.Table:
        part = left.column("part")[0].as_py() if left.num_rows else 0
        known = np.sort(_longs(right, "a"))
        got = [(f, s) for _, _, f, s in _candidates(_single(left, "text"), known, width, rounds) if len(f)] if left.num_rows else []
        f = np.concatenate([x[0] for x in got]) if got else np.zeros(0, U64)
        s = np.concatenate([x[1] for x in got]) if got else np.zeros(0, np.int32)
        order = np.lexsort((s, f))
        f, s = f[order], s[order]
        new = np.ones(len(f), bool)
        new[1:] = (f[1:] != f[:-1]) | (s[1:] != s[:-1])
        at = np.flatnonzero(new)
        n = np.diff(np.append(at, len(f)))
        return pa.table({"a": pa.array(f[at].view(np.int64)), "b": pa.array(s[at]), "part": pa.array(np.full(len(at), part, np.int32)),
                         "n": pa.array(np.minimum(n, 2).astype(np.int8))})

    counted = (dealt.groupBy("part").cogroup(shared.groupBy("part"))
               .applyInArrow(windows, "a long, b int, part int, n tinyint"))
    refuted = (counted.withColumn("all", F.sum("n").over(W.partitionBy("a", "b"))).filter("all = 1")
               .select("part", "a", "b", F.lit(False).alias("symbol")))

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        symbol = _single(right, "symbol").to_numpy(zero_copy_only=False).astype(bool)
        a, b = _longs(right, "a"), _single(right, "b").to_numpy(zero_copy_only=False).astype(np.int32)
        known, wrong = np.sort(a[symbol]), np.sort(a[~symbol])
        pairs = set(zip(a[~symbol].tolist(), b[~symbol].tolist()))
        texts, total, gone = [], [], []
        for part, starts, f, s in (_candidates(_single(left, "text"), known, width, rounds) if left.num_rows else ()):
            doubt = np.flatnonzero(_member(f, wrong))
            held = np.ones(len(starts), bool)
            held[doubt] = [(x, y) not in pairs for x, y in zip(f[doubt].tolist(), s[doubt].tolist())]
            n = len(part.starts)
            edge = np.bincount(starts[held], minlength=n + 1) - np.bincount(starts[held] + width, minlength=n + 1)
            out = np.cumsum(edge)[:n] > 0
            raw = part.data.tobytes()
            for i, (x, y) in enumerate(zip(part.row_words, part.row_words[1:])):
                words = raw[part.bounds[i]:part.bounds[i + 1]].split()
                mask = out[x:y]
                n_out = int(mask.sum())
                if n_out:
                    words = [w for w, m in zip(words, mask.tolist()) if not m]
                texts.append((b" ".join(words) if rejoin or n_out else raw[part.bounds[i]:part.bounds[i + 1]]).decode())
                total.append(int(y - x))
                gone.append(n_out)
        own = _single(left, "own") if left.num_rows else pa.array([], left.schema.field("own").type)
        own = own.cast(_nullable(own.type))
        return pa.table({"own": own, "text": pa.array(texts, pa.string()), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(gone, pa.int64())})

    told = (dealt.groupBy("part").cogroup(shared.unionByName(refuted).groupBy("part"))
            .applyInArrow(cut, f"own {dealt.schema['own'].dataType.simpleString()}, text string, n_words long, n_removed long"))
    return told.select(*[F.col(f"own.c{k}").alias(c) for k, c in enumerate(keep)], F.col("text").alias(text_col), "n_words", "n_removed")
