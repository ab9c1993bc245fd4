"""Early interactions, survival, group comparison and descriptive rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .prefix import US_PER_DAY, grouped_quantiles, prefix_aggregate, value_bucket

_N = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")


def early_interactions(interactions: DataFrame, journals: DataFrame, days: int = 30, blocked_sites: DataFrame | None = None) -> DataFrame:
    """Per site, interactions in the first days after its first update: by peers, by peers who had
    already posted anywhere, by its own authors, and by type."""
    site = journals.groupBy("site_id").agg(F.min("us").alias("first_us"))
    if blocked_sites is not None:
        site = site.join(blocked_sites, "site_id", "left_anti")
    author = journals.groupBy("user_id").agg(F.min("us").alias("_author_us"))
    own = journals.select("user_id", "site_id", F.lit(1).alias("_own")).distinct()
    early = (interactions.join(site, "site_id").filter((F.col("us") - F.col("first_us")).between(0, days * US_PER_DAY))
             .join(own, ["user_id", "site_id"], "left").join(author, "user_id", "left"))
    peer = F.col("_own").isNull()
    n = early.groupBy("site_id").agg(_N(peer).alias("n_peer"), _N(peer & (F.col("_author_us") <= F.col("us"))).alias("n_peer_author"),
                                     _N(~peer).alias("n_self"), *[_N(peer & (F.col("itype") == t)).alias(f"n_{t}") for t in ("amp", "comment", "guestbook")])
    return site.join(n, "site_id", "left").fillna(0)


def site_activity(journals: DataFrame, end_us: int, early_days: int, censor_days: int) -> DataFrame:
    """First and last update, early and later counts, tenure in days, and right-censoring."""
    first = journals.groupBy("site_id").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    early = F.col("us") <= F.col("first_us") + early_days * US_PER_DAY
    n = journals.join(first.select("site_id", "first_us"), "site_id").groupBy("site_id").agg(_N(early).alias("n_early"), _N(~early).alias("n_later"))
    return first.join(n, "site_id").select(
        "*", ((F.col("last_us") - F.col("first_us")) / float(US_PER_DAY)).alias("tenure_days"),
        (F.col("last_us") > end_us - censor_days * US_PER_DAY).cast("long").alias("is_censored"))


def survival_category(days_after: Column, edges: tuple[float, ...] = (38, 167, 708)) -> Column:
    """Category of survival beyond the early period: none, up to each edge, longer."""
    out = F.when(days_after <= 0, "0")
    for e in edges:
        out = out.when(days_after <= e, f"<={e:g}")
    return out.otherwise(f">{edges[-1]:g}")


def kaplan_meier(rows: DataFrame, groups: list[str], time: str, event: str) -> DataFrame:
    """Survival curve per group: at risk, events, and the product of (1 - d / n) up to each time."""
    per = rows.groupBy(*groups, F.col(time).cast("double").alias("t")).agg(F.sum(event).cast("long").alias("d"), F.count("*").alias("_n"))
    total = per.groupBy(*groups).agg(F.sum("_n").alias("_total"))
    gone = prefix_aggregate(per, groups, value_bucket(F.col("t")), ["t"], {"_gone": ("sum", F.col("_n"))})
    risk = gone.join(total, groups).withColumn("n_at_risk", F.col("_total") - F.col("_gone"))
    end = F.col("d") == F.col("n_at_risk")
    run = prefix_aggregate(risk, groups, value_bucket(F.col("t")), ["t"], {
        "_log": ("sum", F.when(end, 0.0).otherwise(F.log(1 - F.col("d") / F.when(~end, F.col("n_at_risk"))))),
        "_dead": ("sum", end.cast("long"))}, ("rows", 0))
    return run.select(*groups, "t", "d", "n_at_risk", F.when(F.col("_dead") > 0, 0.0).otherwise(F.exp("_log")).alias("survival"))


def median_survival(curve: DataFrame, groups: list[str]) -> DataFrame:
    return curve.groupBy(*groups).agg(F.min(F.when(F.col("survival") <= 0.5, F.col("t"))).alias("median"), F.max("n_at_risk").alias("n"))


def compare_groups(rows: DataFrame, value: str, group: str) -> DataFrame:
    """Means, SDs, Welch t, medians, Mann-Whitney U and common-language effect of group 1 over 0.
    Mid-ranks come from counts per distinct value and a running sum."""
    g1 = F.col(group) == 1
    v = F.col(value).cast("double")
    m = rows.agg(_N(g1).alias("n1"), _N(~g1).alias("n0"), F.avg(F.when(g1, v)).alias("mean1"), F.avg(F.when(~g1, v)).alias("mean0"),
                 F.stddev(F.when(g1, v)).alias("sd1"), F.stddev(F.when(~g1, v)).alias("sd0"))
    per = rows.groupBy(v.alias("_v")).agg(_N(g1).alias("_c1"), _N(~g1).alias("_c0"))
    below = prefix_aggregate(per, [], value_bucket(F.col("_v")), ["_v"], {"_less": ("sum", F.col("_c0"))})
    u = below.agg(F.sum(F.col("_c1") * (F.col("_less") + F.col("_c0") / 2.0)).alias("u1"))
    q = grouped_quantiles(rows.select(group, v.alias("_v")), [group], "_v", {"q": 0.5}).agg(
        F.max(F.when(F.col(group) == 1, F.col("q"))).alias("median1"), F.max(F.when(F.col(group) == 0, F.col("q"))).alias("median0"))
    se = F.sqrt(F.col("sd1") * F.col("sd1") / F.col("n1") + F.col("sd0") * F.col("sd0") / F.col("n0"))
    return m.join(u, F.lit(True)).join(q, F.lit(True)).select(
        "*", ((F.col("mean1") - F.col("mean0")) / se).alias("welch_t"), (F.col("u1") / (F.col("n1") * F.col("n0"))).alias("cles"))


def pooled_effect(rows: DataFrame, keys: list[str], diff: str, arm: str) -> DataFrame:
    """Difference of mean changes between arms in pooled standard deviations."""
    a, d = F.col(arm) == 1, F.col(diff)
    s = rows.groupBy(*keys).agg(_N(a).alias("n1"), _N(~a).alias("n0"), F.avg(F.when(a, d)).alias("mean1"), F.avg(F.when(~a, d)).alias("mean0"),
                                F.variance(F.when(a, d)).alias("var1"), F.variance(F.when(~a, d)).alias("var0"))
    pooled = F.sqrt(((F.col("n0") - 1) * F.col("var0") + (F.col("n1") - 1) * F.col("var1")) / (F.col("n1") + F.col("n0") - 2))
    return s.withColumn("effect", (F.col("mean0") - F.col("mean1")) / F.when(pooled > 0, pooled))


def log_bucket(hours: Column) -> Column:
    """Power-of-two bucket of a non-negative duration."""
    return F.floor(F.log2(hours + 1)).cast("long")


def update_milestones(journals: DataFrame, sites: DataFrame) -> DataFrame:
    """Hours from site creation to first update, first to second, first to last."""
    from .prefix import first_k_per_key
    head = first_k_per_key(journals.select("site_id", "us", "event_id"), ["site_id"], ["us", "event_id"], 2)
    h = head.groupBy("site_id").agg(F.min("us").alias("_1"), F.max(F.when(F.col("rn") == 2, F.col("us"))).alias("_2"))
    last = journals.groupBy("site_id").agg(F.max("us").alias("_l"), F.count("*").alias("n_updates"))
    hrs = lambda a, b: (F.col(a) - F.col(b)) / 3.6e9
    return sites.select("site_id", "created_us").join(h, "site_id").join(last, "site_id").select(
        "site_id", "n_updates", hrs("_1", "created_us").alias("create_to_first"), hrs("_2", "_1").alias("first_to_second"), hrs("_l", "_1").alias("first_to_last"))


def share_within(df: DataFrame, keys: list[str], within: list[str], n: str = "n") -> DataFrame:
    """Counts with their share inside a coarser key (joined totals, not a window over raw rows)."""
    total = df.groupBy(*within).agg(F.sum(n).alias("_t"))
    return df.join(total, within).withColumn("share", F.col(n) / F.col("_t")).drop("_t")
