"""Nested rows to flat rows and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F



def explode_batches(batches: DataFrame) -> DataFrame:
    """One row per recommended site with its ``rank``; renamed title keys are coalesced."""
    return batches.select("participant_id", "batch_id", "sent_us",
                          F.posexplode("sse_site_list").alias("rank", "s")).select(
        "participant_id", "batch_id", "sent_us", F.col("rank").cast("long").alias("rank"),
        F.col("s.site_id").alias("site_id"),
        F.coalesce("s.cleaned_journal_title", "s.journal_title").alias("title"))


def duplicate_recommendations(recs: DataFrame) -> DataFrame:
    """Sites recommended more than once to a participant; must be empty."""
    return (recs.groupBy("participant_id", "site_id").agg(F.count(F.lit(1)).alias("n_times"))
            .filter(F.col("n_times") > 1))


def explode_amps(parents: DataFrame, parent_type: str) -> DataFrame:
    """Embedded reaction lists to interaction rows; the id is ``parent|user``."""
    return parents.select("parent_oid", "site_id", "us", F.explode("amps").alias("user_id")).select(
        "user_id", "site_id", F.lit("amp").alias("interaction_type"), F.lit(parent_type).alias("parent_type"),
        F.concat_ws("|", F.col("parent_oid").cast("string"), F.col("user_id").cast("string")).alias("interaction_oid"), "us")


def membership(pairs: DataFrame) -> DataFrame:
    """site -> users and user -> sites as distinct pairs with both set sizes (a relation, so a
    site with any number of users never becomes one value)."""
    p = pairs.select("user_id", "site_id").distinct()
    u = p.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sites"))
    s = p.groupBy("site_id").agg(F.count(F.lit(1)).alias("n_users"))
    return p.join(u, "user_id").join(s, "site_id")


def nested_number(col: str) -> Column:
    """Number that may be wrapped as {"$numberLong": "..."}; NULL when neither."""
    wrapped = F.get_json_object(col, "$.$numberLong")
    return F.coalesce(wrapped, F.col(col)).try_cast("long")


def flatten_guestbook(raw: DataFrame) -> DataFrame:
    """Guestbook rows: missing text -> '', missing dates -> 0, photo and reaction counts."""
    size = lambda c: F.coalesce(F.size(F.when(F.col(c).isNotNull(), F.col(c))), F.lit(0)).cast("long")
    return raw.select(
        "guestbook_oid", "user_id", "site_id", F.coalesce("body", F.lit("")).alias("body"),
        F.coalesce("signature", F.lit("")).alias("signature"),
        F.coalesce(nested_number("created_json"), F.lit(0)).alias("created_us"),
        F.coalesce(nested_number("updated_json"), F.lit(0)).alias("updated_us"),
        F.when(F.col("photos").isNull(), 0).otherwise(size("photos")).cast("long").alias("n_photos"),
        F.when(F.col("amps").isNull(), 0).otherwise(size("amps")).cast("long").alias("n_amps"))


def wide_counts(rows: DataFrame, key: str, kind: str, kinds: list[str], counters: dict[str, Column]) -> DataFrame:
    """One row per key with a count per (kind, counter) and row totals; absent means 0."""
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("long")
    aggs = [n((F.col(kind) == k) & c).alias(f"{k}_{name}") for k in kinds for name, c in counters.items()]
    totals = [n(c).alias(f"total_{name}") for name, c in counters.items()]
    return rows.groupBy(key).agg(*aggs, *totals)
