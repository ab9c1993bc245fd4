"""Nearest neighbours by inner product through an inverted multi-index: two vector halves quantised separately."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.vectors import dot
from .staging import shuffle_width, spread_join, staged

SAMPLE = 32_768      # rows to which centroids are fitted
PER_CELL = 64        # distinct vectors aimed at in a cell
MOST_CENTROIDS = 256  # of a half
FIRST = 8            # entries of the first look, in multiples of the neighbours wanted
MISS = 1e-4          # expected neighbours lost in a query's unread cells
ENTRY_BLOCK, QUERY_BLOCK, CHUNK = 8192, 2048, 256


@dataclass
class Index:
    """Centroids of both halves, the entries of every cell, and the spread around centroids along one direction."""
    centroids: tuple[np.ndarray, np.ndarray]
    counts: np.ndarray
    spread: tuple[float, float]

    @property
    def half(self) -> int:
        return self.centroids[0].shape[1]


def kmeans(points: np.ndarray, k: int, steps: int = 12, seed: int = 7) -> np.ndarray:
    """Centroids of a bounded sample; those that lose all points stay where they are."""
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(steps):
        own = nearest(points, centres)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(points), np.int64)
    for at in range(0, len(points), 8192):
        part = points[at:at + 8192]
        out[at:at + 8192] = np.argmin((centres ** 2).sum(axis=1) - 2 * part @ centres.T, axis=1)
    return out


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of a list column as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows id, vec, mark (a hash) that take part: an id, finite components, not all zero, of the commonest length."""
    v = F.col("vec")
    rows = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vec")).filter("id is not null and vec is not null")
    rows = rows.filter(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    size = rows.groupBy(F.size("vec").alias("s")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("s")).first()
    return rows.filter(F.size("vec") == (size["s"] if size else 0)).withColumn("mark", F.xxhash64("vec"))


def fit(classes: DataFrame, width: int, n: int, sample: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of both halves from at most ``sample`` vectors, the first by a hash of their ids."""
    rows = classes.orderBy(F.xxhash64("cls"), "cls").limit(sample).select("vec").toArrow()
    points, half = matrix(rows["vec"], width), max(1, width // 2)
    k = max(1, min(most, round(math.sqrt(n / PER_CELL))))
    return kmeans(points[:, :half], k), kmeans(points[:, half:], k)


def placed(classes: DataFrame, centroids: tuple[np.ndarray, np.ndarray], width: int) -> DataFrame:
    """Classes with their cell (i, j) and squared distances to both centroids."""
    half = centroids[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = matrix(batch.column(batch.schema.get_field_index("vec")), width)
            parts = points[:, :half], points[:, half:]
            own = [nearest(p, c) for p, c in zip(parts, centroids)]
            off = [((p - c[o]) ** 2).sum(axis=1) for p, c, o in zip(parts, centroids, own)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(o, pa.int32()) for o in own], *[pa.array(o) for o in off]],
                                             names=[*batch.schema.names, "i", "j", "off_i", "off_j"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)
    return classes.mapInArrow(run, f"{kinds}, i int, j int, off_i double, off_j double")


def traverse(index: Index, query: np.ndarray, first: int, floor: float | None, keep: float) -> Iterator[tuple[int, int, int]]:
    """Cells (i, j, look) of a query, best summed inner product first.

    Centroids of each half are sorted, and a heap holds the next pair of every row that was begun. Look 0 goes
    on until ``first`` entries are read. With a ``floor``, the query's score at the last wanted rank so far, look 1
    goes on until the entries left, were each spread around its centroid pair like the widest, would hold fewer
    than ``keep`` better ones.
    """
    halves = query[:index.half], query[index.half:]
    scores = [c @ q for c, q in zip(index.centroids, halves)]
    order = [np.argsort(-s, kind="stable") for s in scores]
    best = [s[o].tolist() for s, o in zip(scores, order)]
    names = [o.tolist() for o in order]
    sigma = math.sqrt(sum(float(q @ q) * v for q, v in zip(halves, index.spread))) or 1e-300
    left, counts = int(index.counts.sum()), index.counts
    heap = [(-best[0][0] - best[1][0], 0, 0)]
    read = 0
    while heap:
        total, a, b = heappop(heap)
        if read >= first:
            if floor is None or (-total < floor and left * 0.5 * math.erfc((floor + total) / sigma / math.sqrt(2)) <= keep):
                return
        if b + 1 < len(best[1]):
            heappush(heap, (-best[0][a] - best[1][b + 1], a, b + 1))
        if b == 0 and a + 1 < len(best[0]):
            heappush(heap, (-best[0][a + 1] - best[1][0], a + 1, 0))
        n = int(counts[names[0][a], names[1][b]])
        if n:
            yield names[0][a], names[1][b], int(read >= first)
            read += n
            left -= n


def _probes(queries: DataFrame, index: Index, width: int, first: int, look: int, keep: float) -> DataFrame:
    """Rows qcls, vec, floor, i, cells: a query's cells of one look, those of a first-half centroid as a bit set."""
    k = index.counts.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                points, floors = matrix(part.column(1), width), part.column(2).to_pylist()
                row, centroid, cells = [], [], []
                for r, query in enumerate(points):
                    rows: dict[int, np.ndarray] = {}
                    for i, j, when in traverse(index, query, first, floors[r] if look else None, keep):
                        if when == look:
                            rows.setdefault(i, np.zeros(k, bool))[j] = True
                    for i, js in rows.items():
                        row.append(r)
                        centroid.append(i)
                        cells.append(np.packbits(js).tobytes())
                own = [c.take(pa.array(row, pa.int64())) for c in part.columns]
                yield pa.RecordBatch.from_arrays([*own, pa.array(centroid, pa.int32()), pa.array(cells, pa.binary())],
                                                 names=["qcls", "vec", "floor", "i", "cells"])

    chosen = queries.select("qcls", "vec", "floor").repartition(shuffle_width(queries.sparkSession), "qcls")
    return chosen.mapInArrow(run, f"qcls long, vec {chosen.schema['vec'].dataType.simpleString()}, floor double, i int, cells binary")


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows summed component by component in double precision, the same in any batch."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


def _best_in_block(points: np.ndarray, own: np.ndarray, ids: np.ndarray, queries: np.ndarray, floors: np.ndarray,
                   cells: np.ndarray, want: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, entry, score) of each query's ``want`` best entries in its cells, not below its floor."""
    room = 1e-9 * (1 + np.sqrt((points ** 2).sum(axis=1).max(initial=0)))
    for at in range(0, len(queries), CHUNK):
        part = queries[at:at + CHUNK]
        rough = np.where(cells[at:at + CHUNK][:, own], part @ points.T, -np.inf)
        least = floors[at:at + CHUNK].copy()
        if rough.shape[1] > want:
            least = np.maximum(least, np.partition(rough, rough.shape[1] - want, axis=1)[:, -want])
        slack = room * (1 + np.sqrt((part ** 2).sum(axis=1)))
        q, e = np.nonzero((rough >= (least - slack)[:, None]) & (rough > -np.inf))
        score = inner_products(part[q], points[e])
        order = np.lexsort((ids[e], -score, q))
        q, e, score = q[order], e[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        good = (place < want) & (score >= floors[at:at + CHUNK][q])
        yield q[good] + at, e[good], score[good]


def _reranked(entries: DataFrame, probes: DataFrame, index: Index, width: int, want: int) -> DataFrame:
    """Rows qcls, score, ids of entries in the probed cells: the best of every block. Entries and probes of a first-half
    centroid are dealt into blocks of bounded rows, whose number follows from the counts; blocks meet pairwise."""
    spark = entries.sparkSession
    probes = staged(probes, "ann-probes")
    n_probes = {r["i"]: r["n"] for r in probes.groupBy("i").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = [(i, max(1, -(-int(index.counts[i].sum()) // ENTRY_BLOCK)), -(-n // QUERY_BLOCK)) for i, n in n_probes.items()]
    blocks = F.broadcast(spark.createDataFrame(sizes, "i int, e_parts int, q_parts int"))  # a row per centroid: MOST_CENTROIDS at most
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = (entries.select("cls", "ids", "vec", "i", "j").join(blocks, "i")
            .select("cls", "ids", "vec", "i", "j", own("cls", "e_parts").alias("e"), each("q_parts").alias("q")))
    right = probes.join(blocks, "i").select("qcls", "vec", "floor", "cells", "i", own("qcls", "q_parts").alias("q"), each("e_parts").alias("e"))
    k = index.counts.shape[1]

    def run(block: pa.Table, asked: pa.Table) -> pa.Table:
        asked, block = asked.combine_chunks(), block.combine_chunks()
        points, queries = matrix(block["vec"], width), matrix(asked["vec"], width)
        floors = asked["floor"].to_numpy(zero_copy_only=False).astype(np.float64)
        bits = np.frombuffer(b"".join(asked["cells"].to_pylist()), np.uint8).reshape(len(queries), -(-k // 8))
        cells = np.unpackbits(bits, axis=1, count=k).astype(bool)
        out = list(_best_in_block(points, block["j"].to_numpy(), block["cls"].to_numpy(), queries, np.where(np.isnan(floors), -np.inf, floors),
                                  cells, want))
        q, e, score = (np.concatenate(x) if out else np.zeros(0) for x in (zip(*out) if out else ((), (), ())))
        return pa.table({"qcls": asked["qcls"].take(pa.array(q.astype(np.int64))), "score": pa.array(score, pa.float64()),
                         "ids": block["ids"].take(pa.array(e.astype(np.int64)))})

    return left.groupBy("i", "e", "q").cogroup(right.groupBy("i", "e", "q")).applyInArrow(run, "qcls long, score double, ids array<long>")


def _leading(found: DataFrame, want: int) -> DataFrame:
    """qcls, best: the first ``want`` rows (score, id) of the entries found, equal scores by id."""
    ranked = W.partitionBy("qcls").orderBy(F.desc("score"), F.col("ids")[0])
    few = found.withColumn("r", F.row_number().over(ranked)).filter(F.col("r") <= want)
    each = few.select("qcls", "score", F.explode("ids").alias("id"))
    single = W.partitionBy("qcls").orderBy(F.desc("score"), "id")
    rows = each.withColumn("r", F.row_number().over(single)).filter(F.col("r") <= want)
    return rows.groupBy("qcls").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "score", "id"))),
                                                lambda x: F.struct(x["score"].alias("score"), x["id"].alias("id"))).alias("best"))


def nearest_neighbours(rows: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
                       sample: int = SAMPLE, most: int = MOST_CENTROIDS, first: int = FIRST, miss: float = MISS) -> DataFrame:
    """The ``k`` rows of largest inner product found for each row that ``is_query`` (a condition over the id column):
    query_id, rank (from 1), vec_id, score. Equal scores go by the smaller id; a row is no neighbour of itself.

    Equal vectors are one entry with its k + 1 smallest ids, and one query, so that copies cost nothing. Both
    halves are quantised with centroids fitted to at most ``sample`` vectors; every entry is in the cell of its
    two centroids. A query's cells are taken by summed inner product through a heap: first until
    ``first * (k + 1)`` entries are read and reranked, which gives a score that its neighbours must reach, then
    until the unread entries are expected to hold fewer than ``miss * k`` better ones. That expectation takes
    the products with what an entry differs from its centroids to be normal, as wide as the widest centroid's; it reads
    few cells where vectors cluster, and most where they do not. Cells are read in blocks of bounded size.

    Vectors that are null, zero, hold null or non-finite components, or are not as long as most (equally many: the
    longer), and rows without id take no part. Rows that repeat an id are rows of their own: each is a
    candidate, and each asks. Fewer candidates than ``k`` are all returned. An empty table gives no rows.
    """
    want = k + 1
    kind = rows.schema[id_col].dataType.simpleString()
    valid = staged(usable(rows, id_col, vector_col).withColumn("id", F.col("id").cast("long")), "ann-vectors")
    numbered = W.partitionBy("mark", "vec").orderBy("id")
    classes = staged(valid.withColumn("r", F.row_number().over(numbered)).filter(F.col("r") <= want).groupBy("mark", "vec")
                     .agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("cls"), "ids", "vec"), "ann-classes")
    head = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("width")).first()
    schema = f"query_id {kind}, rank int, {id_col} {kind}, score double"
    if not head["n"]:
        return rows.sparkSession.createDataFrame([], schema)
    width, n = head["width"], head["n"]

    centroids = fit(classes, width, n, sample, most)
    entries = staged(placed(classes, centroids, width), "ann-entries")
    counts = np.zeros((len(centroids[0]), len(centroids[1])), np.int64)
    for r in entries.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n")).collect():  # cells: MOST_CENTROIDS squared at most
        counts[r["i"], r["j"]] = r["n"]
    half = centroids[0].shape[1]
    spread = tuple((entries.groupBy(c).agg(F.avg(f"off_{c}").alias("m")).agg(F.max("m")).first()[0]) / max(1, size)
                   for c, size in (("i", half), ("j", width - half)))
    index = Index(centroids, counts, spread)

    members = valid.filter(is_query).select("id", "mark", "vec")
    asked = staged(members.select("mark", "vec").distinct().withColumn("qcls", F.monotonically_increasing_id()), "ann-queries")
    queries = asked.select("qcls", "vec", F.lit(None).cast("double").alias("floor"))
    found = staged(_reranked(entries, _probes(queries, index, width, first * want, 0, miss * k), index, width, want), "ann-first")
    floors = _leading(found, want).select("qcls", F.when(F.size("best") >= want, F.col("best")[want - 1]["score"])
                                          .otherwise(F.lit(float("-inf"))).alias("floor"))
    queries = staged(asked.select("qcls", "vec").join(floors, "qcls"), "ann-floors")
    more = _reranked(entries, _probes(queries, index, width, first * want, 1, miss * k), index, width, want)
    best = staged(_leading(found.unionByName(more), want), "ann-best")

    of_query = asked.join(best, "qcls").select("mark", F.col("vec").alias("_vec"), "best")
    lists = spread_join(members, of_query, "mark").filter(F.col("vec") == F.col("_vec"))
    own = F.struct(dot("vec", "vec").alias("score"), F.col("id"))
    at = F.array_position("best", own)  # its own row, where it is among them
    others = F.slice(F.filter("best", lambda x, i: i != at - 1), 1, k)
    return (lists.select(F.col("id").alias("query_id"), F.posexplode(others).alias("r", "x"))
            .select(F.col("query_id").cast(kind), (F.col("r") + 1).cast("int").alias("rank"), F.col("x.id").cast(kind).alias(id_col), F.col("x.score").alias("score")))
