"""Exact deduplication: local combining, salted digest groups, then salt winners, always on full content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .staging import spread_join, staged

BLANKS = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Each run of space and U+0009..U+000D becomes one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32,
                digest=lambda norm: F.sha2(norm, 256)) -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, text_sha256.

    Every task first combines its own equal texts, so that a text copied into a third of all rows
    leaves a task once. Its partial groups then meet under (digest, salt, text), where the salt is the
    task's number modulo ``salts``, and the at most ``salts`` winners of a text meet under (digest,
    text). The text itself is part of each grouping key: rows whose digests collide stay apart.
    Rows learn their verdict over the narrow digest, those of a very frequent text over several salts; digests shared by different texts, if there are
    any, are resolved by joining on the text too.

    A null text is empty; empty texts equal each other. Null ids never win over other ids; a group of
    null ids only has keep_id null and keeps its rows. Rows that repeat id and text share a verdict.
    An empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_norm"))
    rows = rows.select("_id", "_norm", digest(F.col("_norm")).alias("_digest"), F.sha2("_norm", 256).alias("_sha"))
    local = (rows.withColumn("_salt", F.spark_partition_id() % salts).groupBy("_digest", "_salt", "_norm")
             .agg(F.min("_id").alias("_keep"), F.count(F.lit(1)).alias("_n")))
    groups = local.groupBy("_digest", "_norm").agg(F.min("_keep").alias("keep_id"), F.sum("_n").alias("group_size"))
    verdicts = staged(groups.select("_digest", "keep_id", "group_size"), "exact-groups")
    shared = verdicts.groupBy("_digest").agg(F.count(F.lit(1)).alias("_texts")).filter("_texts > 1").select("_digest")
    if shared.isEmpty():
        sizes = verdicts.select("_digest", F.col("group_size").alias("_n"))
        told = spread_join(rows.select("_id", "_digest", "_sha"), verdicts, "_digest", counts=sizes)
    else:
        told = (rows.join(shared, "_digest", "left_anti").join(verdicts, "_digest").select("_id", "_sha", "keep_id", "group_size")
                .unionByName(rows.join(shared, "_digest", "left_semi").join(groups, ["_digest", "_norm"])
                             .select("_id", "_sha", "keep_id", "group_size")))
    return told.select(F.col("_id").alias(id_col), "keep_id", F.col("group_size").cast("long"),
                       F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("_sha").alias("text_sha256"))


def kept_documents(docs: DataFrame, verdicts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose verdict is kept; rows with a null id stay."""
    ids = verdicts.filter("kept").select(F.col(id_col).alias("_kept_id")).filter("_kept_id is not null").distinct()
    have = docs.filter(F.col(id_col).isNotNull()).join(ids, F.col(id_col) == F.col("_kept_id"), "left_semi")
    return have.unionByName(docs.filter(F.col(id_col).isNull()))
