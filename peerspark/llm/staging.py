"""Intermediate tables in the shared folder, so that lost executors cost a reread and no recomputation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ensure_checkpoint_dir

HEAVY_KEYS = 10_000


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the checkpoint folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt_width(spark: SparkSession, total_bytes: int, target: int = 16 << 20) -> int:
    """Partitions for ``total_bytes`` of text: as many as shuffles have, more where a part would pass ``target``."""
    return max(shuffle_width(spark), -(-int(total_bytes or 0) // target))


def spread_join(rows: DataFrame, facts: DataFrame, key: str, least: int = 1 << 16, counts: DataFrame | None = None) -> DataFrame:
    """Inner join of ``rows`` with ``facts``, which has few rows per key, on a key that may hold a third of all rows.

    Keys of more than ``least`` rows, and more than a HEAVY_KEYS-th of all, are dealt over salts in number with
    their rows; their facts are repeated for each salt. There are fewer than HEAVY_KEYS such keys, so that they
    can be broadcast. ``counts`` (key, _n), where they are known, save counting ``rows``, which otherwise should be
    a written table.
    """
    spark = rows.sparkSession
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")) if counts is None else counts
    limit = max(least, -(-(counts.agg(F.sum("_n")).first()[0] or 0) // HEAVY_KEYS))
    heavy = (counts.filter(F.col("_n") > limit)
             .select(key, F.ceil(F.col("_n") / limit).cast("int").alias("_salts")).collect())
    if not heavy:
        return rows.join(facts, key)
    kind = rows.schema[key].dataType.simpleString()
    salts = F.broadcast(spark.createDataFrame([tuple(r) for r in heavy], f"{key} {kind}, _salts int"))
    dealt = (rows.join(salts, key, "left")
             .withColumn("_salt", F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("_salts")).cast("int"), F.lit(0))).drop("_salts"))
    copied = (facts.join(salts, key, "left")
              .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))).drop("_salts"))
    return dealt.join(copied, [key, "_salt"]).drop("_salt")
