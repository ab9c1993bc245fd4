"""Cleaning, validity and timestamp repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.draws import draw
from .prefix import (DEPTH_ROWS, US_PER_DAY, US_PER_HOUR, first_k_per_key, grouped_quantiles, running_number, state_at, time_bucket)


def published_updates(journals: DataFrame, lo_us: int, hi_us: int) -> DataFrame:
    """Non-trivial updates published in the closed range; unpublished ones drop out."""
    return journals.filter(F.col("is_nontrivial") & F.col("published_us").between(lo_us, hi_us))


def trim_interactions(ints: DataFrame, lo_us: int, hi_us: int) -> DataFrame:
    """Interactions in the closed range, every amp variant as ``amp``."""
    return ints.filter(F.col("us").between(lo_us, hi_us)).withColumn(
        "itype", F.when(F.col("itype").startswith("amp"), "amp").otherwise(F.col("itype")))


def validity_flags(ints: DataFrame, users: DataFrame, sites: DataFrame) -> DataFrame:
    u = users.select("user_id", F.lit(True).alias("user_ok")).distinct()
    s = sites.select("site_id", F.lit(True).alias("site_ok")).distinct()
    return ints.join(u, "user_id", "left").join(s, "site_id", "left").fillna(False, ["user_ok", "site_ok"])


def validity_counts(flagged: DataFrame, by: str) -> DataFrame:
    n = lambda c: F.sum(c.cast("long"))
    u, s = F.col("user_ok"), F.col("site_ok")
    return flagged.groupBy(by).agg(n(u & s).alias("n_both"), n(u & ~s).alias("n_user_only"), n(~u & s).alias("n_site_only"),
                                   n(~u & ~s).alias("n_neither"))


def keep_valid(ints: DataFrame, users: DataFrame, sites: DataFrame, both: bool = True) -> DataFrame:
    """Rows whose user and site (or, with ``both=False``, user or site) are valid."""
    f = validity_flags(ints, users, sites)
    return f.filter(F.col("user_ok") & F.col("site_ok") if both else F.col("user_ok") | F.col("site_ok")).drop("user_ok", "site_ok")


def updates_by(journals: DataFrame, authors: DataFrame) -> DataFrame:
    return journals.join(authors.select("user_id").distinct(), "user_id", "left_semi")


def valid_pairs(journals: DataFrame, sites: DataFrame, blocked_users: DataFrame) -> DataFrame:
    """Valid (user, site) pairs with their update counts. An author who ever posted on a spam site
    is invalid everywhere; a deactivated site drops only its own pairs."""
    j = journals.filter(F.col("is_nontrivial") & ~F.col("is_deleted"))
    spam = sites.filter("is_spam = 1").select("site_id")
    spammers = journals.join(spam, "site_id", "left_semi").select("user_id").distinct()
    gone = sites.filter("is_deleted = '1'").select("site_id")
    return (j.join(spammers, "user_id", "left_anti").join(blocked_users, "user_id", "left_anti").join(gone, "site_id", "left_anti")
            .groupBy("user_id", "site_id").agg(F.count("*").alias("update_count")))


def legacy_usp_table(journals: DataFrame, k: int = 3) -> DataFrame:
    """Pairs with at least k updates, user and site milestones, and how many valid partners each has."""
    pairs = journals.groupBy("user_id", "site_id").agg(F.count("*").alias("n_updates")).filter(F.col("n_updates") >= k)
    head = first_k_per_key(journals.select("user_id", "us", "event_id"), ["user_id"], ["us", "event_id"], k)
    user = head.groupBy("user_id").agg(F.min("us").alias("user_first_us"), F.max(F.when(F.col("rn") == k, F.col("us"))).alias("user_kth_us"))
    site = journals.groupBy("site_id").agg(F.min("us").alias("site_first_us"))
    total = journals.groupBy("user_id").agg(F.count("*").alias("total_updates"))
    ns = pairs.groupBy("user_id").agg(F.count("*").alias("n_valid_sites"))
    nu = pairs.groupBy("site_id").agg(F.count("*").alias("n_valid_users"))
    return pairs.join(user, "user_id").join(total, "user_id").join(ns, "user_id").join(site, "site_id").join(nu, "site_id")


def dedup_first(df: DataFrame, key: str, order: list) -> DataFrame:
    return first_k_per_key(df, [key], order, 1).drop("rn")


def is_deactivated() -> Column:
    return ((F.col("is_deleted") == "1") | (F.col("is_spam") == 1)).cast("long")


def recommendable_sites(sites: DataFrame, journals: DataFrame, now_us: int, days: int = 12) -> DataFrame:
    """Active, public, searchable sites with a recent update."""
    recent = journals.filter(F.col("us") >= now_us - days * US_PER_DAY).select("site_id").distinct()
    ok = (is_deactivated() == 0) & (F.col("privacy") == "low") & (F.col("is_googleable") == "1") & (F.col("is_searchable") == "1")
    return sites.filter(ok).join(recent, "site_id", "left_semi")


def object_id_seconds(oid: str) -> Column:
    """Epoch seconds in the first eight hex digits of an object id."""
    return F.conv(F.substring(oid, 1, 8), 16, 10).cast("long")


def timestamp_audit_class(created_ms: Column, generated_ms: Column) -> Column:
    """Kind of difference between stored and generated time: equal within a second, a whole
    five- or six-hour offset (also one second more), or other."""
    d = created_ms - generated_ms
    return (F.when(d.between(-1000, 1000), "match")
            .when(d.isin(-18_000_000, -21_600_000, -17_999_000, -21_599_000), "utc_offset").otherwise("other"))


def shift_until(us: str, cond: Column, cut_us: int, hours: int = 5) -> Column:
    """Add an offset to rows up to the cut-over."""
    return F.when(cond & (F.col(us) <= cut_us), F.col(us) + hours * US_PER_HOUR).otherwise(F.col(us))


def local_to_us(text: str, zone: str = "America/Chicago") -> tuple[Column, Column]:
    """Local wall-clock text to epoch microseconds, honouring daylight saving, and a tag;
    text that is no date gives NULL and ``invalid``."""
    t = F.when(~F.col(text).startswith("-"), F.unix_micros(
        F.to_utc_timestamp(F.try_to_timestamp(F.col(text), F.lit("yyyy-MM-dd HH:mm:ss")), zone)))
    return t, F.when(F.col(text).isNull(), "missing").when(t.isNull(), "invalid").otherwise("ok")


def reaction_delays(reactions: DataFrame, journals: DataFrame) -> DataFrame:
    """Delay from the site's latest update to each reaction, never negative."""
    seen = state_at(reactions, journals, ["site_id"], {"_last": ("max", F.col("us"))}, depth=DEPTH_ROWS)
    return seen.filter(F.col("_last").isNotNull()).withColumn("delay_us", F.greatest(F.col("us") - F.col("_last"), F.lit(0))).drop("_last")


def keep_below_quantile(df: DataFrame, value: str, p: float = 0.9) -> DataFrame:
    q = grouped_quantiles(df, [], value, {"_q": p})
    return df.join(F.broadcast(q), F.lit(True)).filter(F.col(value) <= F.col("_q")).drop("_q")


def jitter(rows: DataFrame, delays: DataFrame, seed: int = 19) -> DataFrame:
    """Add an empirical delay to each row: delays are numbered and a row draws one by a seeded hash
    of its id, so any run gives the same times."""
    d = delays.select("event_id", "delay_us")
    numbered = running_number(d, [], F.floor(F.col("event_id") / 1024).cast("long"), ["event_id"], "_i").select("_i", "delay_us")
    n = d.agg(F.count("*").alias("_n"))
    picked = rows.join(F.broadcast(n), F.lit(True)).withColumn("_i", draw(seed, "event_id") % F.col("_n") + 1)
    return picked.join(numbered, "_i").withColumn("jittered_us", F.col("us") + F.col("delay_us")).drop("_i", "_n", "delay_us")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, dates: list[str]) -> DataFrame:
    """Per date column: rows only in one version, equal, or different, and the size of the change."""
    o = old.select(key, *[F.col(c).alias(f"_o_{c}") for c in dates], F.lit(1).alias("_o"))
    n = new.select(key, *[F.col(c).alias(f"_n_{c}") for c in dates], F.lit(1).alias("_n"))
    j = o.join(n, key, "full_outer")
    state = lambda c: (F.when(F.col("_n").isNull(), "only_old").when(F.col("_o").isNull(), "only_new")
                       .when(F.col(f"_o_{c}").eqNullSafe(F.col(f"_n_{c}")), "equal").otherwise("different"))
    long = j.select(F.explode(F.array(*[F.struct(
        F.lit(c).alias("column"), state(c).alias("state"),
        F.coalesce(F.col(f"_n_{c}") - F.col(f"_o_{c}"), F.lit(0)).alias("delta_us")) for c in dates])).alias("x")).select("x.*")
    return long.groupBy("column", "state", "delta_us").agg(F.count("*").alias("n"))


def densify(journals: DataFrame, before_us: int) -> DataFrame:
    """One synthetic update per pair just before the data starts, so that everyone is an author."""
    extra = journals.select("user_id", "site_id").distinct().select(
        F.lit(-1).cast("long").alias("event_id"), "user_id", "site_id", F.lit(before_us - 1).cast("long").alias("us"))
    return journals.select("event_id", "user_id", "site_id", "us").unionByName(extra)


def join_validated(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", contract: str = "many_to_one") -> DataFrame:
    """Join that raises while running when a side that must be unique on ``on`` is not.

    The check is part of the plan: the unique side is grouped by its key and a group with more
    than one row raises, so no second pass and no driver round trip is needed.
    """
    def unique(df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c not in on]
        g = df.groupBy(*on).agg(F.count("*").alias("_n"), *[F.any_value(c).alias(c) for c in rest])
        ok = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit(f"{contract} violated on {on}: "), F.col("_n").cast("string")))
                    .cast("long")).otherwise(F.col("_n"))
        return g.withColumn("_n", ok).filter(F.col("_n") == 1).drop("_n")
    if contract not in ("many_to_one", "one_to_one"):
        raise ValueError(contract)
    return (unique(left) if contract == "one_to_one" else left).join(unique(right), on, how)
