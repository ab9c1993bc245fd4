"""Ranking quality, coverage and model comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .blocks import SiteRanks
from .prefix import US_PER_DAY, content_bucket, first_k_per_key, grouped_quantiles

WEEK_US = 7 * US_PER_DAY


def _hit(k: int) -> Column:
    return F.avg(F.when(F.col("target_rank") <= k, 100.0).otherwise(0.0))


def correlation(x: str, y: str) -> Column:
    """Pearson correlation, 0 when either side is constant."""
    sd = F.stddev_pop(x) * F.stddev_pop(y)
    return F.coalesce(F.covar_pop(x, y) / F.when(sd > 0, sd), F.lit(0.0))


def ranking_metrics(targets: DataFrame, keys: list[str], ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    """MRR, HR@k in percent and n per key, from one target rank per context."""
    return targets.groupBy(*keys).agg(F.avg(1.0 / F.col("target_rank")).alias("mrr"),
                                      *[_hit(k).alias(f"hr{k}") for k in ks], F.count(F.lit(1)).alias("n"))


def ndcg(rank: str, k: int) -> Column:
    """NDCG@k with a single relevant item."""
    return F.when(F.col(rank) <= k, 1.0 / F.log2(F.col(rank) + 1.0)).otherwise(0.0)


def weekly_trend(targets: DataFrame, start_us: int) -> tuple[DataFrame, DataFrame]:
    weekly = (targets.withColumn("week", F.floor((F.col("us") - start_us) / WEEK_US).cast("long"))
              .groupBy("model", "week").agg(F.avg(1.0 / F.col("target_rank")).alias("mrr"), F.count(F.lit(1)).alias("n")))
    trend = weekly.groupBy("model").agg(F.coalesce(F.regr_slope("mrr", "week"), F.lit(0.0)).alias("slope"), correlation("mrr", "week").alias("r"))
    return weekly, trend


def segment_metrics(targets: DataFrame, segments: list[str]) -> DataFrame:
    """Metrics for every combination of the segment flags and their margins (-1 = all)."""
    cube = targets.cube(*segments).agg(F.avg(1.0 / F.col("target_rank")).alias("mrr"), _hit(5).alias("hr5"),
                                       F.count(F.lit(1)).alias("n"))
    return cube.select(*[F.coalesce(F.col(s).cast("long"), F.lit(-1)).alias(s) for s in segments], "mrr", "hr5", "n")


def zero_degree_metrics(ranks: DataFrame, targets: DataFrame) -> DataFrame:
    """Metrics per model of contexts with and without a target author whom nobody (in), or who nobody else (out), had
    turned to: the least degrees of a context's target authors (metadata_id, indegree, outdegree) tell its segment."""
    least = targets.groupBy("metadata_id").agg(*[(F.min(f"{side}degree") == 0).cast("long").alias(f"zero_{side}degree") for side in ("in", "out")])
    return ranks.join(least, "metadata_id").groupBy("zero_indegree", "zero_outdegree", "model").agg(
        F.count(F.lit(1)).alias("n"), F.avg(1.0 / F.col("target_rank")).alias("mrr"), _hit(5).alias("hr5"))


def leaderboard(metrics: DataFrame, higher: list[str], lower: list[str], key: str = "model") -> DataFrame:
    """Average-tie integer rank of each model per metric and the mean of those ranks. One row per
    model goes in, so the windows are as small as the model list."""
    out, names = metrics, []
    for m in [*higher, *lower]:
        order = F.col(m).desc() if m in higher else F.col(m).asc()
        ties = F.count(F.lit(1)).over(W.partitionBy(m))
        out = out.withColumn(f"{m}_ranking", (F.rank().over(W.orderBy(order)) + (ties - 1) / 2.0).cast("long"))
        names.append(f"{m}_ranking")
    return out.withColumn("mean_ranking", sum(F.col(n) for n in names) / float(len(names)))


def replicate_summary(runs: DataFrame, key: str, metric: str) -> DataFrame:
    """Min, median and max of a metric over the runs of each hyperparameter key."""
    ends = runs.groupBy(key).agg(F.min(metric).alias("min"), F.max(metric).alias("max"), F.count(F.lit(1)).alias("n_runs"))
    return ends.join(grouped_quantiles(runs, [key], metric, {"median": 0.5}), key)


def site_rank_stats(ranks: DataFrame, models: list[str], stats: Callable[[Column], list[Column]]) -> DataFrame:
    """Statistics of the rank columns (``scoring.model_ranks``) per (model, site): all models in one mergeable
    aggregation by site, a row for each model only after it."""
    each = [F.struct(F.lit(m).alias("model"), *stats(F.col(f"rank_{m}"))).alias(m) for m in models]
    wide = ranks.groupBy("site_id").agg(*each)
    return wide.select("site_id", F.inline(F.array(*models)))


def site_coverage(ranks: DataFrame | SiteRanks, models: list[str], tops: tuple[int, ...] = (5, 100, 1000), sample: bool = False) -> DataFrame:
    """Rank statistics per (model, site)."""
    if isinstance(ranks, SiteRanks):
        whole = lambda c: F.col(c).cast("decimal(19,0)")
        spread = (whole("n") * whole("squares") - whole("total") * whole("total")).cast("double") / F.col("n")
        return ranks.totals(models, tops).select(
            "site_id", "model", "n", (F.col("total") / F.col("n")).alias("mean"),
            (F.coalesce(spread / F.nullif(F.col("n") - 1, F.lit(0)), F.lit(0.0)) if sample else spread / F.col("n")).alias("var"),
            "best", "worst", *[F.col(f"top{t}").alias(f"n_top_{t}") for t in tops])
    return site_rank_stats(ranks, models, lambda r: [
        F.count(F.lit(1)).alias("n"), F.avg(r).alias("mean"),
        (F.coalesce(F.var_samp(r), F.lit(0.0)) if sample else F.var_pop(r)).alias("var"),
        F.min(r).alias("best"), F.max(r).alias("worst"),
        *[F.sum((r <= t).cast("long")).alias(f"n_top_{t}") for t in tops]])


def coverage_curve(coverage: DataFrame, tops: tuple[int, ...] = (5, 100, 1000)) -> DataFrame:
    return coverage.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_sites"),
        *[F.sum((F.col(f"n_top_{t}") > 0).cast("long")).alias(f"sites_top_{t}") for t in tops])


def tie_key(*cols: str) -> Column:
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in cols]))


def top_n(scored: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    """Best n sites per key; ties are broken by a content hash, so any run gives the same batch."""
    return first_k_per_key(scored, keys, [F.col("score").desc(), tie_key(*keys, "site_id"), F.col("site_id")], n, "pos")


def coverage_metrics(recs: DataFrame, eligible_sites: DataFrame, inited_sites: DataFrame, first_update: DataFrame,
                     at_us: int, n_picks: int = 5) -> DataFrame:
    """Per model: how much of the catalogue is recommended, and to whom it was already known."""
    sites = recs.select("model", "site_id").distinct()
    flags = (eligible_sites.select("site_id").distinct()
             .join(inited_sites.select("site_id", F.lit(1).alias("has_int")).distinct(), "site_id", "left").fillna(0, ["has_int"]))
    total = flags.agg(F.count(F.lit(1)).alias("n_eligible"), F.sum("has_int").alias("n_eligible_int"))
    per = (sites.join(flags, "site_id").groupBy("model").agg(
        F.count(F.lit(1)).alias("n_recced"), F.sum("has_int").alias("n_recced_int")))
    n_ctx = recs.groupBy("model").agg(F.countDistinct("metadata_id").alias("n_contexts"))
    age = recs.join(first_update, "site_id").withColumn("age", (F.lit(at_us) - F.col("first_us")) / float(WEEK_US))
    # a batch holds n_picks sites at most: its median is over a bounded array
    batch = age.groupBy("model", "metadata_id").agg(F.min("age").alias("lo"), F.median("age").alias("mid"))
    ages = batch.groupBy("model").agg(F.avg("lo").alias("mean_min_age"), F.avg("mid").alias("mean_median_age"))
    j = per.join(n_ctx, "model").join(ages, "model").join(F.broadcast(total), F.lit(True))
    rec_int = F.col("n_recced_int") / F.col("n_recced")
    rest = F.col("n_eligible") - F.col("n_recced")
    non_int = (F.col("n_eligible_int") - F.col("n_recced_int")) / F.when(rest > 0, rest)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return j.select(
        "model", F.col("n_recced").alias("n_recced_sites"), rest.alias("n_nonrecced_sites"),
        (F.col("n_recced") / F.col("n_eligible")).alias("pct_eligible_recced"),
        (F.col("n_recced") / (F.col("n_contexts") * n_picks)).alias("pct_unique_recs"),
        rec_int.alias("pct_recced_with_int"), zero(non_int).alias("pct_nonrecced_with_int"),
        zero(rec_int / F.when(non_int > 0, non_int)).alias("ratio_int"),
        zero((1 - rec_int) / F.when(non_int < 1, 1 - non_int)).alias("ratio_noint"),
        "mean_min_age", "mean_median_age")


def sites_with_prior_initiation(inits: DataFrame, journals: DataFrame, at_us: int) -> DataFrame:
    """Sites a non-author had initiated with before ``at_us``."""
    authored = journals.select("user_id", "site_id").distinct()
    return inits.filter(F.col("us") < at_us).join(authored, ["user_id", "site_id"], "left_anti").select("site_id").distinct()


def first_site_update(journals: DataFrame) -> DataFrame:
    return journals.groupBy("site_id").agg(F.min("us").alias("first_us"))


def exposure_by_prior_initiation(recs: DataFrame, initiators: DataFrame, user: str = "metadata_id") -> DataFrame:
    """Recommendations and distinct sites split by whether the recipient had initiated before,
    with how often the most recommended site was repeated."""
    flag = initiators.select(F.col("user_id").alias(user), F.lit(1).alias("has_initiated")).distinct()
    per_site = (recs.join(flag, user, "left").fillna(0, ["has_initiated"])
                .groupBy("model", "has_initiated", "site_id").agg(F.count(F.lit(1)).alias("n_times")))
    return per_site.groupBy("model", "has_initiated").agg(
        F.sum("n_times").alias("n_recs"), F.count(F.lit(1)).alias("n_sites"), F.max("n_times").alias("max_times"),
        F.sum((F.col("n_times") == 1).cast("long")).alias("n_sites_once"))


def appearance_table(ranks: DataFrame | SiteRanks, models: list[str], sites: DataFrame) -> DataFrame:
    """Top-1/5/10 appearances and mean rank per site with its visits."""
    tops = (1, 5, 10)
    if isinstance(ranks, SiteRanks):
        per = ranks.totals(models, tops).select("site_id", "model", *[f"top{t}" for t in tops], (F.col("total") / F.col("n")).alias("mean_rank"))
    else:
        per = site_rank_stats(ranks, models, lambda r: [
            *[F.sum((r <= t).cast("long")).alias(f"top{t}") for t in tops], F.avg(r).alias("mean_rank")])
    return per.join(sites.select("site_id", "name", "visits"), "site_id")
