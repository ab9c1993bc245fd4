"""Best-fit packing planned over the histogram of piece lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .staging import shuffle_width, staged
from .wordhash import column_bytes
from .wordids import encoder

CAPACITY = 2048
PART = 1 << 16    # pieces in a part of the ids, and so at most in a window
MOST_SLOTS = 1 << 17  # rows of a plan that are broadcast
_PIECES = "doc_id {}, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocab: str, capacity: int = CAPACITY, end_id: int = 0,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of whole documents: id, piece, start, length, ids_crc32. A document is its ids and
    ``end_id``; only one longer than ``capacity`` is cut, into full pieces and a rest. Null texts are
    empty and give the end id alone. Repeated rows give repeated pieces."""
    ending = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab)
        for batch in batches:
            raw, bounds = column_bytes(batch.column(1))
            ids = batch.column(0)
            row, rows = 0, len(bounds) - 1
            while row < rows:
                last = max(row + 1, int(np.searchsorted(bounds, bounds[row] + (1 << 20), "right")) - 1)
                data = raw[bounds[row]:bounds[last]].tobytes()
                own = (bounds[row:last + 1] - bounds[row]).tolist()
                out: list[list[int]] = [[], [], [], [], []]
                for i, coded in enumerate(enc.encode(data[a:b] for a, b in zip(own, own[1:])), row):
                    coded += ending
                    for k, at in enumerate(range(0, len(coded), 4 * capacity)):
                        part = coded[at:at + 4 * capacity]
                        for column, value in zip(out, (i, k, at // 4, len(part) // 4, zlib.crc32(part))):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), *[pa.array(c, pa.int64()) for c in out[2:]]],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])
                row = last

    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(cut, _PIECES.format(chosen.schema["doc_id"].dataType.simpleString()))


def plan_slots(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, first rank, past-last rank, first sequence, offset).

    Rank r of a length goes to sequence ``first sequence + r - first rank``. Sequences with the same room
    left are alike, so they are kept as number ranges per room; the work depends on the capacity and not
    on how many pieces there are. A sequence takes as many pieces of a length as fit before the next one
    is used, as best fit does when it sees them one by one.
    """
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    plan, opened = [], 0
    for length in sorted(counts, reverse=True):
        left, rank, at = int(counts[length]), 0, length
        while left:
            while at <= capacity and not room[at]:
                at += 1
            free = min(at, capacity)
            if at <= capacity:
                first, n = room[at].pop()
            else:
                first, n = opened, max(1, left // (capacity // length))
                opened += n
            layers = min(free // length, left)
            use = min(n, left // layers)
            for k in range(layers):
                plan.append((length, rank, rank + use, first, capacity - free + k * length))
                rank += use
            left -= use * layers
            room[free - layers * length].append((first, use))
            if use < n:
                room[free].append((first + use, n - use))
    return plan


def best_fit_packing(docs: DataFrame, vocab: str, capacity: int = CAPACITY, end_id: int = 0,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens: one row per piece with doc_id,
    piece, start, length, ids_crc32, sequence_id, offset.

    Only the histogram of lengths (at most ``capacity`` rows) reaches the driver. Pieces then take the
    planned slots by their rank within the length. Ranks are counted within (length, part of the ids)
    and raised by the totals of earlier parts, so a length that a third of all pieces have is spread
    over all parts. An empty table gives no rows; texts stay where they are read and are not shuffled.
    """
    spark = docs.sparkSession
    table = staged(pieces(docs, vocab, capacity, end_id, id_col, text_col), "pieces")
    parts = max(shuffle_width(spark), -(-table.count() // PART))
    table = table.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int"))
    totals = table.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    counts = {r["length"]: r["n"] for r in totals.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    slots = plan_slots(counts, capacity)
    plan = spark.createDataFrame(slots, "_length long, _from long, _to long, _first long, _offset long")
    before = totals.select("length", "_part", F.coalesce(
        F.sum("_n").over(W.partitionBy("length").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = W.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (table.withColumn("_rank", F.row_number().over(within) - 1).join(before, ["length", "_part"])
              .withColumn("_rank", F.col("_rank") + F.col("_before")))
    plan = F.broadcast(plan) if len(slots) <= MOST_SLOTS else plan
    return (ranked.join(plan, (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
            .select("doc_id", "piece", "start", "length", "ids_crc32",
                    (F.col("_first") + F.col("_rank") - F.col("_from")).alias("sequence_id"), F.col("_offset").alias("offset")))
