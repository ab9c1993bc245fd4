"""Quality rules: base measures of whole texts and a calibrated n-gram classifier with fixed thresholds."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .wordhash import SPACE, U64, Words, mix, spans_hash, word_slices

BITS = 17  # features are hashed to 2**17 weights
WORD_GRAMS, CHAR_GRAMS = (1, 2), (3, 5)
SAMPLE = 1000  # labelled rows of each class that the fit uses at most
LEAST_PROBABILITY = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WIDTH = 10, 20, 5
_LINE = 0xDA942042E4DD58B5
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _at_bounds(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.append(0, np.cumsum(flags))[bounds])


def base_measures(part: Words) -> dict[str, np.ndarray]:
    """Per row: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    rows, n = part.last - part.first, len(part.starts)
    data = part.data
    # lines
    breaks = np.flatnonzero(data == 10)
    begin = np.concatenate([part.bounds[:-1], breaks + 1])
    end = np.concatenate([part.bounds[1:], breaks])
    begin, end = np.sort(begin), np.sort(end)
    filled = np.searchsorted(part.starts, end) > np.searchsorted(part.starts, begin)
    begin, end = begin[filled], end[filled]
    of = np.searchsorted(part.bounds, begin, "right") - 1
    line = mix(spans_hash(mix(data.astype(U64) + U64(1)), begin, end, _LINE) + (end - begin).astype(U64))
    distinct = np.unique(mix(line + mix(of.astype(U64) + U64(7))), return_index=True)[1]
    dup = np.bincount(of, minlength=rows) - np.bincount(of[distinct], minlength=rows)
    # windows of words
    h, row = part.hashes(), part.row_of_word()
    covered = np.zeros(n, bool)
    if n >= REPEAT_WIDTH:
        m = n - REPEAT_WIDTH + 1
        gram = mix(row[:m].astype(U64) + U64(1))
        for k in range(REPEAT_WIDTH):
            gram = mix(gram * U64(0xD6E8FEB86659FD93) + h[k:k + m])
        at = np.flatnonzero(row[:m] == row[REPEAT_WIDTH - 1:])
        order = at[np.argsort(gram[at], kind="stable")]
        same = gram[order][1:] == gram[order][:-1]
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        starts = order[twice]
        covered = np.cumsum(np.bincount(starts, minlength=n + 1) - np.bincount(starts + REPEAT_WIDTH, minlength=n + 1))[:n] > 0
    return {"n_words": part.counts(), "word_chars": _at_bounds(~SPACE[data] & ((data & 0xC0) != 0x80), part.bounds),
            "n_symbols": _at_bounds(_SYMBOL[data], part.bounds), "n_dup_lines": dup,
            "n_repeat_words": _at_bounds(covered, part.row_words)}


def grams(part: Words) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hashed n-grams by kind: (feature of each place, first place of each row, past-last place of each row)."""
    h = part.hashes()
    for n in WORD_GRAMS:
        yield _windows(h, part.row_words, n, n)
    points = np.frombuffer(part.data.tobytes().decode().encode("utf-32-le"), np.uint32)
    bounds = np.append(0, np.cumsum((part.data & 0xC0) != 0x80))[part.bounds]
    for n in CHAR_GRAMS:
        yield _windows(points.astype(U64), bounds, n, 100 + n)


def _windows(values: np.ndarray, bounds: np.ndarray, n: int, kind: int):
    m = max(0, len(values) - n + 1)
    h = np.full(m, kind, U64)
    for k in range(n):
        h = (h + values[k:k + m] + U64(1)) * U64(0x9E3779B97F4A7C55)
        h ^= h >> U64(29)
    return (mix(h) >> U64(64 - BITS)).astype(np.int64), np.minimum(bounds[:-1], m), np.maximum(np.minimum(bounds[:-1], m), bounds[1:] - n + 1)


@dataclass
class Model:
    """Weights of the hashed n-grams, and the line that turns their sum into a calibrated log-odds."""
    weights: np.ndarray
    scale: float
    shift: float

    def probability(self, part: Words) -> np.ndarray:
        total = np.zeros(part.last - part.first)
        for feature, begin, end in grams(part):
            sums = np.append(0.0, np.cumsum(self.weights[feature]))
            total += (sums[end] - sums[begin]) / np.maximum(end - begin, 1)
        return 1 / (1 + np.exp(-np.clip(self.scale * total + self.shift, -50, 50)))


def _inner_products(row: np.ndarray, col: np.ndarray, val: np.ndarray, n: int, width: int = 4096) -> np.ndarray:
    """Inner products of all pairs of rows, over blocks of features."""
    used, col = np.unique(col, return_inverse=True)
    order = np.argsort(col, kind="stable")
    row, col, val = row[order], col[order], val[order]
    out = np.zeros((n, n))
    for first in range(0, len(used), width):
        a, b = np.searchsorted(col, [first, first + width])
        block = np.bincount(row[a:b] * width + col[a:b] - first, val[a:b], n * width).reshape(n, width)
        out += block @ block.T
    return out


def _settle(row: np.ndarray, col: np.ndarray, val: np.ndarray, y: np.ndarray, weight: np.ndarray, tolerance: float = 1e-4,
            ridge: float = 1e-6, most: int = 200) -> np.ndarray:
    """Logistic regression by Newton steps until the loss settles; fails if ``most`` steps do not settle it.

    The best weights are a sum of the rows that have a weight, so the steps are taken over one number a row and
    no row's length limits them. A step that raises the loss is halved.
    """
    learn = np.flatnonzero(weight > 0)
    place = np.full(len(y), -1)
    place[learn] = np.arange(len(learn))
    own = place[row] >= 0
    row, col, val = place[row[own]], col[own], val[own]
    y, weight = y[learn], weight[learn]
    n, size = len(y), 1 << BITS
    gram = _inner_products(row, col, val, n)

    def loss(part: np.ndarray, z: np.ndarray) -> float:
        return float((weight * np.logaddexp(0, -np.where(y > 0, z, -z))).sum()) + ridge * float(part @ z)

    part, z = np.zeros(n), np.zeros(n)  # z = gram @ part
    before = loss(part, z)
    for _ in range(most):
        p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        curve = np.sqrt(np.maximum(weight * p * (1 - p), 1e-300))
        # Newton's equations for part, made symmetric by the root of the curvature
        target = curve * z - weight * (p - y) / curve
        new = curve * np.linalg.solve(curve[:, None] * gram * curve + 2 * ridge * np.eye(n), target)
        step, ahead = new - part, gram @ new - z
        pace, after = 1.0, loss(new, z + ahead)
        while not after <= before and pace > 1e-10:
            pace /= 2
            after = loss(part + pace * step, z + pace * ahead)
        if not after <= before:
            break
        done = pace == 1.0 and before - after <= tolerance * before
        part, z, before = part + pace * step, z + pace * ahead, after
        if done:
            return np.bincount(col, part[row] * val, size)
    raise RuntimeError(f"the fit of the quality classifier did not settle: loss {before:.6g}, {most} steps at most")


def _calibrate(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Platt's line on rows that the weights were not fitted to, by Newton steps on smoothed targets."""
    ones, zeros = float(weight[y > 0].sum()), float(weight[y == 0].sum())
    target = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    x = np.column_stack([z, np.ones(len(z))])
    line = np.array([1.0, np.log((ones + 1) / (zeros + 1))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ line, -50, 50)))
        slope = x.T @ (weight * (p - target))
        change = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), slope)
        line -= np.clip(change, -5, 5)
        if np.abs(change).max() < 1e-8:
            break
    return float(line[0]), float(line[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        sample: int = SAMPLE) -> Model | None:
    """Model of P(label = 1) from at most ``sample`` labelled rows of each class, those with the least id hash.

    The features of the sample are made where the texts are; one task then fits the weights on three
    quarters of it and calibrates on the rest, each class weighted by its true number. Null labels are left
    out; an id labelled differently counts as 1 if most of its labels are 1. Without rows of both classes
    there is no model.
    """
    voted = (labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("key"))
             .agg((F.avg(label_col) >= 0.5).cast("int").alias("label")))
    many = {r["label"]: r["n"] for r in voted.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(many) < 2:
        return None
    pick = lambda k: voted.filter(F.col("label") == k).orderBy(F.xxhash64("key"), "key").limit(sample)
    chosen = F.broadcast(pick(0).unionByName(pick(1)))  # at most 2 * sample rows
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).join(chosen, "key").select("key", "label", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col, val = [], []
            for part in word_slices(batch.column(2)):
                own = [[] for _ in range(part.last - part.first)]
                for feature, begin, end in grams(part):
                    for i, (a, b) in enumerate(zip(begin, end)):
                        which, n = np.unique(feature[a:b], return_counts=True)
                        own[i].append((which, n / max(b - a, 1)))
                for pairs in own:
                    col.append(np.concatenate([x[0] for x in pairs]).astype(np.int32))
                    val.append(np.concatenate([x[1] for x in pairs]).astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(col, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.float32()))],
                                             names=["key", "label", "col", "val"])

    def train(table: pa.Table) -> pa.Table:
        order = np.argsort(mix(np.arange(table.num_rows, dtype=U64)))
        table = table.combine_chunks().sort_by("key")
        y = table.column("label").to_numpy().astype(float)
        lists = table.column("col").combine_chunks(), table.column("val").combine_chunks()
        size = pa.compute.list_value_length(table.column("col")).to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(y)), size)
        col, val = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
        test = np.zeros(len(y), bool)
        test[order[:len(y) // 4]] = True
        if len(set(y[test])) < 2 or len(set(y[~test])) < 2:
            test[:] = True
        learn = ~test if not test.all() else test
        share = np.where(y > 0, 0.5 / max((y[learn] > 0).sum(), 1), 0.5 / max((y[learn] == 0).sum(), 1)) * learn
        w = _settle(row, col, val.astype(float), y, share)
        z = np.bincount(row, w[col] * val, len(y))
        true = np.where(y > 0, many[1] / max((y > 0).sum(), 1), many[0] / max((y == 0).sum(), 1))
        true = true * len(y) / (many[0] + many[1])
        scale, shift = _calibrate(z[test], y[test], true[test])
        return pa.table({"weights": pa.array([w.astype(np.float32)], pa.list_(pa.float32())), "scale": [scale], "shift": [shift]})

    kind = rows.schema["key"].dataType.simpleString()
    fitted = (rows.mapInArrow(features, f"key {kind}, label int, col array<int>, val array<float>")
              .withColumn("whole", F.lit(0)).groupBy("whole").applyInArrow(train, "weights array<float>, scale double, shift double").first())
    return fitted and Model(np.array(fitted["weights"]), fitted["scale"], fitted["shift"])


def judge(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text",
          least: float = LEAST_PROBABILITY) -> DataFrame:
    """One row per input row: ``id_col``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, probability, kept.

    Kept are texts that pass the base rules and reach ``least``. Without a model (no labels of both
    classes) the probability is null and the base rules alone decide. Null texts are empty and fail. Rows
    are judged alone: null or repeated ids change nothing; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in word_slices(batch.column(1)):
                found = base_measures(part)
                p = pa.array(shared.value.probability(part)) if shared.value else pa.nulls(part.last - part.first, pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, part.last - part.first),
                                                  *[pa.array(found[n].astype(np.int64)) for n in names], p], names=["id", *names, "probability"])
                at = part.last

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    told = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {', '.join(f'{n} long' for n in names)}, probability double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return told.withColumnRenamed("id", id_col).select(
        id_col, *names, failed.alias("base_failed"), "probability",
        (~failed & (F.coalesce("probability", F.lit(1.0)) >= least)).alias("kept"))
