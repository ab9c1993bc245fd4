"""MinHash near-duplicates with sequential Bayesian verification of banded candidates."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.graph import components
from .shingles import shingle_sets
from .staging import staged
from .wordhash import U64, mix

HASHES, ROWS = 128, 4  # 32 bands of 4: a pair at 0.75 shares no band with probability 5e-6
BATCH = 16
MISS = 1e-7
PERCENT = 75
WIDTH = 5
BLOCK = 2048  # members of a bucket that are compared in one piece, on either side
BLOCK_SHINGLES = 1 << 20  # shingles of a piece's members, all in all: their texts are held together when they are verified


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * HASHES + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
    return seeds[:HASHES] | U64(1), seeds[HASHES:]


def signature(shingles: np.ndarray) -> np.ndarray:
    """Least value of each of the hash functions over a set, as 32-bit numbers."""
    a, b = _coefficients()
    best = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(shingles), 512):
        block = ((shingles[at:at + 512, None] * a + b) >> U64(32)).astype(np.uint32)
        np.minimum(best, block.min(axis=0), out=best)
    return best


def least_matches(percent: int = PERCENT, miss: float = MISS, batch: int = BATCH, hashes: int = HASHES) -> dict[int, int]:
    """For each number n of compared values, the fewest matches m that keep a pair.

    With a uniform prior the similarity given m of n is Beta(m+1, n-m+1), so the probability that it is
    at least t is that of at most m successes in n+1 draws with chance t. Pairs below ``miss`` are pruned.
    """
    t = percent / 100
    need = {}
    for n in range(batch, hashes + 1, batch):
        tail = m = 0
        while True:
            tail += math.comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        need[n] = m
    return need


def _signed(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, digest, sig = [], [], []
            for s in shingle_sets(batch.column(1), width):
                size.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sig.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())],
                names=["id", "n", "digest", "sig"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n long, digest binary, sig binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), HASHES)


def _band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per row and band of the signature."""
    values = sig.astype(U64).reshape(len(sig), HASHES // ROWS, ROWS)
    key = np.broadcast_to(mix(np.arange(1, HASHES // ROWS + 1, dtype=U64)), values.shape[:2])
    for k in range(ROWS):
        key = mix(key * U64(0xD6E8FEB86659FD93) + values[:, :, k])
    return key


def _bands(classes: DataFrame) -> DataFrame:
    """(cls, band, bucket): one bucket per band of the signature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = _band_keys(_matrix(batch.column(1)))
            row, band = np.indices(key.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(band.astype(np.int8)),
                                              pa.array(key.reshape(-1).view(np.int64))], names=["cls", "band", "bucket"])

    rows = classes.select("cls", "sig")
    return rows.mapInArrow(run, f"cls {rows.schema['cls'].dataType.simpleString()}, band tinyint, bucket long")


def _sequential(left: np.ndarray, right: np.ndarray, x: np.ndarray, y: np.ndarray, need: dict[int, int]) -> np.ndarray:
    """Which pairs (left[x], right[y]) survive: signatures are compared batch by batch, and a pair is dropped as
    soon as its matches make the threshold too improbable."""
    alive, matches, seen = np.arange(len(x)), np.zeros(len(x), np.int16), 0
    for n, least in need.items():
        matches[alive] += (left[x[alive], seen:n] == right[y[alive], seen:n]).sum(axis=1, dtype=np.int16)
        alive, seen = alive[matches[alive] >= least], n
    return alive


def _plausible(pairs: DataFrame, classes: DataFrame, percent: int, miss: float) -> DataFrame:
    """Pairs (a, b) that their sizes allow and that no signature batch rules out."""
    need = least_matches(percent, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = np.arange(batch.num_rows)
            alive = _sequential(_matrix(batch.column(2)), _matrix(batch.column(3)), every, every, need)
            yield pa.RecordBatch.from_arrays([c.take(pa.array(alive)) for c in batch.columns[:2]], names=["a", "b"])

    side = lambda name: classes.select(F.col("cls").alias(name), F.col("n").alias(f"n_{name}"), F.col("sig").alias(f"sig_{name}"))
    both = (pairs.join(side("a"), "a").join(side("b"), "b")
            .filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).select("a", "b", "sig_a", "sig_b"))
    kind = both.schema["a"].dataType.simpleString()
    return both.mapInArrow(run, f"a {kind}, b {kind}")


def _exact(pairs: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= percent * union. Equal neighbours on side a share a set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str | None, np.ndarray] = (None, np.zeros(0, U64))
        for batch in batches:
            keep = []
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for i, (text, right) in enumerate(zip(part.column(2), shingle_sets(part.column(3), width)), at):
                    if last[0] != (text := text.as_py()):
                        last = (text, next(shingle_sets(pa.array([text], pa.string()), width)))
                    shared = len(np.intersect1d(last[1], right, assume_unique=True))
                    keep.append(100 * shared >= percent * (len(last[1]) + len(right) - shared))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    side = lambda name: texts.select(F.col("cls").alias(name), F.col("text").alias(f"text_{name}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b")
    kind = both.schema["a"].dataType.simpleString()
    return both.mapInArrow(run, f"a {kind}, b {kind}")


def _blocks(mixed: DataFrame, classes: DataFrame, percent: int, miss: float, block: int = BLOCK, shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Members of buckets with several components, in blocks, that have a plausible partner.

    ``mixed`` has (bucket, band, cls, comp, main): every member and the bucket's largest component. Members outside it
    are compared with all. Both sides are cut into pieces of about ``block`` members, or fewer where these have more than
    ``shingles`` shingles in all, and a block of two pieces is one group whatever the bucket's size; a text longer than
    that weighs alone what it weighs. A pair is looked at in the first band that it shares. Rows: block, cls, comp and,
    for members that look for partners, the partners that no signature batch ruled out.
    """
    need = least_matches(percent, miss)
    weighed = mixed.join(classes.select("cls", "n"), "cls")
    outside = lambda of: F.sum(F.when(F.col("comp") != F.col("main"), of))
    parts = lambda n, weight: F.greatest(F.ceil(n / block), F.ceil(weight / shingles)).cast("int")
    one = F.lit(1)
    cuts = weighed.groupBy("bucket").agg(parts(outside(one), outside(F.col("n"))).alias("p_x"), parts(F.sum(one), F.sum("n")).alias("p_y"))
    mixed = mixed.join(cuts, "bucket")
    own = lambda p: F.pmod(F.xxhash64("cls", "bucket"), F.col(p)).cast("int")
    each = lambda p: F.explode(F.sequence(F.lit(0), F.col(p) - 1))
    head = ["bucket", "band", "cls", "comp", "main"]
    sides = (mixed.filter("comp <> main").select(*head, F.lit(True).alias("asks"), own("p_x").alias("i"), each("p_y").alias("j"))
             .unionByName(mixed.select(*head, F.lit(False).alias("asks"), each("p_x").alias("i"), own("p_y").alias("j"))))
    rows = sides.join(classes.select("cls", "n", "sig"), "cls")
    kind = rows.schema["cls"].dataType.simpleString()

    def compare(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        cls, comp, size = (table.column(c).to_numpy() for c in ("cls", "comp", "n"))
        band, main = table.column("band")[0].as_py(), table.column("main")[0].as_py()
        sig = _matrix(table.column("sig").combine_chunks())
        keys = _band_keys(sig)
        out: dict[str, list] = {"cls": [], "comp": [], "partners": []}
        xs, ys = np.flatnonzero(asks), np.flatnonzero(~asks)
        wanted = np.zeros(len(cls), bool)
        for at in range(0, len(xs), 256):
            x = xs[at:at + 256]
            a, b = size[x][:, None] * 100, size[ys][None] * 100
            fit = (np.minimum(a, b) * 100 >= np.maximum(a, b) * percent) & (comp[x][:, None] != comp[ys][None])
            fit &= (comp[ys] == main)[None] | (cls[x][:, None] < cls[ys][None])
            for earlier in range(band):
                fit &= keys[x, earlier][:, None] != keys[ys, earlier][None]
            p, q = np.nonzero(fit)
            alive = _sequential(sig, sig, x[p], ys[q], need)
            p, q = p[alive], q[alive]
            wanted[ys[q]] = True
            for k in np.unique(p):
                out["cls"].append(cls[x[k]])
                out["comp"].append(comp[x[k]])
                out["partners"].append(cls[ys[q[p == k]]])
        for k in np.flatnonzero(wanted):
            out["cls"].append(cls[k])
            out["comp"].append(comp[k])
            out["partners"].append(None)
        n = len(out["cls"])
        same = {c: pa.array([table.column(c)[0].as_py()] * n, table.schema.field(c).type) for c in ("bucket", "i", "j")}
        return pa.table(same | {"cls": pa.array(out["cls"], table.schema.field("cls").type), "comp": pa.array(out["comp"], table.schema.field("comp").type),
                                "partners": pa.array(out["partners"], pa.list_(table.schema.field("cls").type))})

    return rows.groupBy("bucket", "i", "j").applyInArrow(
        compare, f"bucket long, i int, j int, cls {kind}, comp {kind}, partners array<{kind}>")


def _linked(blocks: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """Links (a, b) confirmed on full sets: for each asking member one partner of each component it links with."""
    rows = blocks.join(texts, "cls")
    kind = rows.schema["cls"].dataType.simpleString()

    def verify(table: pa.Table) -> pa.Table:
        cls, comp = table.column("cls").to_numpy(), table.column("comp").to_numpy()
        partners = table.column("partners").to_pylist()
        sets = list(shingle_sets(table.column("text"), width))
        size = np.array([len(x) for x in sets])
        words, code = np.unique(np.concatenate(sets), return_inverse=True)
        bounds = np.append(0, np.cumsum(size))
        mark = np.zeros(len(words), bool)
        left, right = [], []
        for k, found in enumerate(partners):
            if found is None:
                continue
            own = code[bounds[k]:bounds[k + 1]]
            mark[own] = True
            to = np.flatnonzero(np.isin(cls, found) & (size > 0))
            shared = np.array([mark[code[bounds[t]:bounds[t + 1]]].sum() for t in to])
            mark[own] = False
            near = to[100 * shared >= percent * (size[k] + size[to] - shared)]
            for t in near[np.unique(comp[near], return_index=True)[1]]:
                left.append(cls[k])
                right.append(cls[t])
        kinds = table.schema.field("cls").type
        return pa.table({"a": pa.array(left, kinds), "b": pa.array(right, kinds)})

    return rows.groupBy("bucket", "i", "j").applyInArrow(verify, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT,
                    width: int = WIDTH, miss: float = MISS) -> DataFrame:
    """One row per input row: ``id_col``, n_shingles, component_id, kept.

    Texts with the same shingle set form a class, named by its smallest id. Classes that share a band
    meet in a bucket. First every class is compared with one other, the smallest that any of its buckets
    has: one pair per class, however large the buckets. Verified links are contracted to components. Then
    the members of a bucket outside its largest component are compared with all its members, in blocks of
    bounded size. Nothing is capped: after the second pass every banded pair is verified or already
    connected. A pair is pruned when the probability that it reaches the threshold, given the matches in
    the signature batches compared so far, is below ``miss``; survivors are confirmed on the full sets.

    Null and empty texts, and texts without words, have no shingles and link with nothing. A class of null
    ids only links with nothing and has component_id null. Rows that share an id are one node. An empty table
    gives no rows; other columns are ignored. Sets are sets of 64-bit fingerprints.
    """
    rows = staged(_signed(docs, id_col, text_col, width), "signatures")
    classes = staged(rows.filter("n > 0").groupBy("digest").agg(
        F.min("id").alias("cls"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes")
    named = classes.filter("cls is not null")
    banded = _bands(named)
    heads = banded.groupBy("bucket").agg(F.min("cls").alias("head"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    members = staged(banded.join(heads.select("bucket", "head"), "bucket"), "bucket-members")
    active = staged(members.groupBy("cls").agg(F.min("head").alias("head")), "active")
    # the same join at every size: what moves grows with the input
    ids = active.select("cls").hint("merge")
    signed = staged(named.select("cls", "n", "sig").join(ids, "cls", "left_semi"), "active-signatures")
    found = docs.select(F.col(id_col).alias("cls"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = staged(found.join(ids, "cls", "left_semi"), "active-texts")

    stars = active.filter("cls <> head").select(F.col("head").alias("a"), F.col("cls").alias("b"))
    likely = staged(_plausible(stars, signed, percent, miss), "likely-stars")
    links = staged(_exact(likely, texts, percent, width), "star-links")
    comp = staged(components(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))), "star-components")

    placed = (members.join(comp.withColumnRenamed("node", "cls"), "cls", "left")
              .select("bucket", "band", "cls", F.coalesce("component", "cls").alias("comp")))
    mixed = (placed.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("k"))
             .groupBy("bucket").agg(F.max(F.struct("k", "comp")).alias("top"), F.sum("k").alias("n_y")).filter("n_y > top.k")
             .select("bucket", F.col("top.comp").alias("main")))
    blocks = staged(_blocks(placed.join(mixed, "bucket"), signed, percent, miss), "blocks")
    more = staged(_linked(blocks, texts, percent, width), "block-links")
    if not more.isEmpty():
        comp = staged(components(comp.select(F.col("node").alias("src"), F.col("component").alias("dst"))
                                 .unionByName(more.select(F.col("a").alias("src"), F.col("b").alias("dst")))), "components")
    of_class = (named.select("digest", "cls").join(comp.withColumnRenamed("node", "cls"), "cls", "left")
                .select("digest", F.coalesce("component", "cls").alias("component_id")))
    told = (rows.select("id", "n", "digest").join(of_class, "digest", "left")
            .withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))))
    return told.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
                       F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
