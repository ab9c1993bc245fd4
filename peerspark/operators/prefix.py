"""Skew-safe ordered aggregation.

A plain ``OVER (PARTITION BY key ORDER BY ...)`` puts a whole key in one task. Every
operator here splits a key into ordered buckets instead: bucket totals are combined map-side,
their running totals are a small window, and the exact value inside a bucket is a window
over (key, bucket). A key holding a third of all rows is spread over its buckets.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

US_PER_MS = 1_000
US_PER_HOUR = 3_600_000_000
US_PER_DAY = 24 * US_PER_HOUR
ACTIVE_WINDOW_US = 7 * US_PER_DAY

DEPTH_ROWS = 1 << 18   # rows of a key in a bucket that follows the data
SPLIT = 64             # parts of a bucket that is split
MOST_SPLITS = 10_000   # ranges split at a level
_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def time_bucket(us: Column | str, width: int = US_PER_DAY) -> Column:
    """Ordered bucket of an epoch-microsecond column."""
    return F.floor((F.col(us) if isinstance(us, str) else us) / F.lit(width)).cast("long")


def value_bucket(value: Column, resolution: int = 64) -> Column:
    """Monotone log-scale bucket of a number: finite bucket count whatever the data."""
    v = value.cast("double")
    return (F.signum(v) * F.floor(F.log2(F.lit(1.0) + F.abs(v)) * resolution)).cast("long")


def bucket_width(df: DataFrame, us: str, rows: int = 65_536) -> int:
    """Bucket width that gives about ``rows`` rows per bucket if times are spread evenly."""
    s = df.agg(F.count(us).alias("n"), F.min(us).alias("a"), F.max(us).alias("b")).first()
    return max(1, -(-(s["b"] - s["a"] + 1) * rows // s["n"])) if s["n"] else 1


@dataclass(frozen=True)
class Depth:
    """Buckets of a column of whole numbers that follow the data: ``width`` wide, and split on where a key has more than
    ``rows`` rows in one, level by level, down to single values."""
    value: Column
    width: int
    rows: int = DEPTH_ROWS

    def place(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        """``df`` with ``_bucket``, the first value of the row's bucket.

        A histogram per key tells the buckets to split; only their rows are counted again in ranges SPLIT times
        narrower. The split ranges of a level are a table that rows look up. It is broadcast: it holds at most
        MOST_SPLITS ranges, the largest; where there are more, all others are smaller than these.
        """
        own = lambda width: (self.value - F.pmod(self.value, F.lit(width))).cast("long")
        spark, names = df.sparkSession, list(keys)
        out, bucket, width, part = df, own(self.width), self.width, df
        while width > 1:
            counts = part.groupBy(*names, own(width).alias("_range")).agg(F.count(F.lit(1)).alias("_n"))
            heavy = counts.filter(F.col("_n") > self.rows).orderBy(F.desc("_n")).limit(MOST_SPLITS).drop("_n")
            found = heavy.collect()
            if not found:
                break
            kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
            table = F.broadcast(spark.createDataFrame(
                [(*r, True) for r in found], ", ".join(f"`_k{i}` {kinds[k]}" for i, k in enumerate(names)) + (", " if names else "") + "_range long, _split boolean"))
            at = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(names)] + [own(width) == F.col("_range")]
            same = reduce(lambda a, b: a & b, at)
            narrow = max(1, width // SPLIT)
            extra = [*[f"_k{i}" for i in range(len(names))], "_range", "_split"]
            part = part.join(table, same).drop(*extra)
            split = F.coalesce(F.col("_split"), F.lit(False))
            out = out.withColumn("_bucket", bucket).join(table, same, "left").withColumn(
                "_bucket", F.when(split, own(narrow)).otherwise(F.col("_bucket"))).drop(*extra)
            bucket, width = F.col("_bucket"), narrow
        return out.withColumn("_bucket", bucket)


def _combine(kind: str, carry: Column, inner: Column) -> Column:
    if kind == "sum":
        return F.coalesce(carry, F.lit(0)) + F.coalesce(inner, F.lit(0))
    return (F.greatest if kind == "max" else F.least)(carry, inner)


def prefix_aggregate(df: DataFrame, keys: Sequence[str], bucket: Column | Depth, order: Sequence[Column | str],
                     aggs: dict[str, tuple[str, Column]], frame: tuple[str, int] = ("rows", -1),
                     top_level: bool = True) -> DataFrame:
    """Running aggregate per key up to ``frame`` = ("rows"|"range", end offset).

    ``bucket`` must be non-decreasing along ``order``, or is a Depth over its first column. Adds one column per entry of ``aggs``.
    Without keys the bucket totals themselves are many, so their running totals are taken the same
    way over groups of 1024 buckets.
    """
    keys = list(keys)
    src = bucket.place(df, keys) if isinstance(bucket, Depth) else df.withColumn("_bucket", bucket)
    totals = src.groupBy(*keys, "_bucket").agg(
        *[_AGG[kind](expr).alias(f"_t_{name}") for name, (kind, expr) in aggs.items()])
    if keys or not top_level:
        over_buckets = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
        carry = totals.select(*keys, "_bucket", *[
            _AGG[kind](F.col(f"_t_{name}")).over(over_buckets).alias(f"_c_{name}")
            for name, (kind, _) in aggs.items()])
    else:
        coarse = totals.withColumnRenamed("_bucket", "_fine")
        carry = prefix_aggregate(coarse, [], F.floor(F.col("_fine") / 1024).cast("long"), ["_fine"], {
            f"_c_{name}": (kind, F.col(f"_t_{name}")) for name, (kind, _) in aggs.items()}, ("rows", -1), False).select(
            F.col("_fine").alias("_bucket"), *[f"_c_{name}" for name in aggs])
    inner = W.partitionBy(*keys, "_bucket").orderBy(*order)
    inner = (inner.rowsBetween if frame[0] == "rows" else inner.rangeBetween)(W.unboundedPreceding, frame[1])
    joined = src.join(carry, [*keys, "_bucket"])
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[_combine(kind, F.col(f"_c_{name}"), _AGG[kind](expr).over(inner)).alias(name)
          for name, (kind, expr) in aggs.items()])


def running_number(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column | str],
                   name: str = "rn") -> DataFrame:
    """1-based row number per key (or over everything when ``keys`` is empty)."""
    return prefix_aggregate(df, keys, bucket, order, {name: ("sum", F.lit(1).cast("long"))}, ("rows", 0))


def running_total(df: DataFrame, keys: Sequence[str], bucket: Column | Depth, order: Sequence[Column | str], value: str, name: str) -> DataFrame:
    """Sum of ``value`` over the rows of the key before each row."""
    return prefix_aggregate(df, keys, bucket, order, {name: ("sum", F.col(value))})


def content_bucket(key: Column, hex_digits: int = 3) -> Column:
    """Balanced ordered bucket for ordering by ``md5(key)``: 16**hex_digits buckets."""
    return F.conv(F.substring(F.md5(key), 1, hex_digits), 16, 10).cast("long")


def first_k_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int,
                    name: str = "rn") -> DataFrame:
    """First ``k`` rows per key. Spark keeps only k rows per key and map task before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def state_at(points: DataFrame, events: DataFrame, on: Sequence[str], measures: dict[str, tuple[str, Column]],
             point_us: str = "us", event_us: str = "us", bucket_us: int = US_PER_DAY,
             inclusive: bool = False, depth: int | None = None, ties: str = "time", seq: str = "event_id") -> DataFrame:
    """As-of aggregate: for each point, ``measures`` over events of the same key with a time
    before the point (or at it when ``inclusive``). One pass over the union, no range join.

    With ``depth`` buckets follow the data: one that holds more rows of a key is split. ``ties`` = "sequence"
    also counts events of the point's own time whose ``seq`` is smaller (or equal when ``inclusive``);
    both sides then have that column.
    """
    on = list(on)
    if ties not in ("time", "sequence"):
        raise ValueError(f"unknown ties {ties}")
    ranked = ties == "sequence"
    ev = events.select(*on, F.col(event_us).alias("_t"), *[F.col(seq).alias("_s")] * ranked,
                       *[expr.alias(f"_m_{n}") for n, (_, expr) in measures.items()])
    pt = points.select(*on, F.col(point_us).alias("_t"), *[F.col(seq).alias("_s")] * ranked, F.struct(*points.columns).alias("_p"))
    tagged = ev.unionByName(pt, allowMissingColumns=True)
    # of an event and a point with the same time and sequence the event comes first if it counts
    order = ["_t", "_s", F.col("_p").isNotNull() if inclusive else F.col("_p").isNull()] if ranked else ["_t"]
    frame = ("rows", -1) if ranked else ("range", 0 if inclusive else -1)
    run = prefix_aggregate(tagged, on, time_bucket("_t", bucket_us) if depth is None else Depth(F.col("_t"), bucket_us, depth), order,
                           {n: (kind, F.col(f"_m_{n}")) for n, (kind, _) in measures.items()}, frame)
    return run.filter(F.col("_p").isNotNull()).select("_p.*", *measures)


def window_state_at(points: DataFrame, events: DataFrame, on: Sequence[str], counts: dict[str, Column],
                    lasts: dict[str, Column] | None = None, totals: dict[str, tuple[str, Column]] | None = None,
                    window_us: int = ACTIVE_WINDOW_US, point_us: str = "us", event_us: str = "us",
                    bucket_us: int = US_PER_DAY, depth: int | None = None) -> DataFrame:
    """Rolling state in [t - window, t): ``counts`` are sums, ``lasts`` the latest value in the
    window (NULL if none), ``totals`` aggregates over everything before t. ``points`` rows must be
    distinct. A rolling sum is the difference of two running sums."""
    lasts, totals = lasts or {}, totals or {}
    cols = points.columns
    ends = points.withColumn("_side", F.explode(F.array(F.lit(0), F.lit(1)))) \
                 .withColumn("_at", F.col(point_us) - F.col("_side") * F.lit(window_us))
    measures = {**{n: ("sum", e) for n, e in counts.items()},
                **{n: ("max", e) for n, e in lasts.items()}, **totals}
    run = state_at(ends, events, on, measures, "_at", event_us, bucket_us, depth=depth)
    now = F.col("_side") == 0
    agg = run.groupBy(*cols).agg(
        *[F.sum(F.when(now, F.col(n)).otherwise(-F.col(n))).alias(n) for n in counts],
        *[F.max(F.when(now, F.col(n))).alias(n) for n in lasts],
        *[F.max(F.when(now, F.col(n))).alias(n) for n in totals])
    return agg.select(
        *cols, *counts,
        *[F.when(F.col(n) >= F.col(point_us) - F.lit(window_us), F.col(n)).alias(n) for n in lasts],
        *totals)


def grouped_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float],
                      resolution: int = 64) -> DataFrame:
    """Exact linear-interpolation quantiles per key without holding a group in one task.

    Counts per distinct value, a log-scale histogram locates the bucket of each wanted order
    statistic, and only those buckets are ordered.
    """
    keys = list(keys)
    gk = keys or ["_all"]
    base = df if keys else df.withColumn("_all", F.lit(0))
    counts = (base.select(*gk, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
              .groupBy(*gk, "_v").agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_b", value_bucket(F.col("_v"), resolution)))
    whole = W.partitionBy(*gk)
    hist = (counts.groupBy(*gk, "_b").agg(F.sum("_n").alias("_bn"))
            .withColumn("_total", F.sum("_bn").over(whole))
            .withColumn("_start", F.coalesce(
                F.sum("_bn").over(whole.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))))
    wanted = (hist.withColumn("_p", F.explode(F.array(*[F.lit(float(p)) for p in sorted(set(probs.values()))])))
              .withColumn("_pos", F.col("_p") * (F.col("_total") - 1))
              .withColumn("_lo", F.floor("_pos")).withColumn("_hi", F.ceil("_pos"))
              .filter((F.col("_lo") < F.col("_start") + F.col("_bn")) & (F.col("_hi") >= F.col("_start"))))
    ordered = counts.join(wanted.drop("_bn", "_total"), [*gk, "_b"]).withColumn(
        "_end", F.col("_start") + F.sum("_n").over(W.partitionBy(*gk, "_b", "_p").orderBy("_v")))
    inside = lambda r: (F.col(r) < F.col("_end")) & (F.col(r) >= F.col("_end") - F.col("_n"))
    at = ordered.groupBy(*gk, "_p").agg(
        F.max(F.when(inside("_lo"), F.col("_v"))).alias("_vlo"),
        F.max(F.when(inside("_hi"), F.col("_v"))).alias("_vhi"),
        F.max(F.col("_pos") - F.col("_lo")).alias("_f")
    ).withColumn("_q", F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("_f"))
    wide = at.groupBy(*gk).agg(*[
        F.max(F.when(F.col("_p") == float(p), F.col("_q"))).alias(n) for n, p in probs.items()])
    return wide if keys else wide.drop("_all")
