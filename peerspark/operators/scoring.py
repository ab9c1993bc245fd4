"""Scores of candidates: baselines, reductions, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import vectors as V
from ..functions.draws import draw
from .features import USER_FEATURES, _hours, vector
from .prefix import ACTIVE_WINDOW_US, US_PER_HOUR, first_k_per_key, prefix_aggregate, value_bucket, window_state_at

SITE_STATE = ["n_site_inits", "last_site_init_us", "n_site_journals", "last_site_journal_us"]
BASELINES = ["MostInitiatedWith", "MostInitiatedWithRecently", "MostRecentlyInitiatedWith", "MostJournalsRecently",
             "MostRecentJournal", "NewestAuthor", "MostInteractiveAuthorRecently", "ClosestToStart"]


def site_state(points: DataFrame, inits: DataFrame, journals: DataFrame, window_us: int = ACTIVE_WINDOW_US) -> DataFrame:
    """Recent initiations and updates of each distinct (site_id, us)."""
    ev = (inits.select("site_id", "us", F.lit(1).alias("i"), F.lit(0).alias("j"))
          .unionByName(journals.select("site_id", "us", F.lit(0).alias("i"), F.lit(1).alias("j"))))
    return window_state_at(points, ev, ["site_id"],
                           {"n_site_inits": F.col("i").cast("long"), "n_site_journals": F.col("j").cast("long")},
                           {"last_site_init_us": F.when(F.col("i") == 1, F.col("us")),
                            "last_site_journal_us": F.when(F.col("j") == 1, F.col("us"))}, window_us=window_us)


def _recency(last: str) -> Column:
    """Minus hours since the latest event; minus the whole epoch when there is none."""
    return -F.coalesce(F.col("us") - F.col(last), F.col("us")) / F.lit(float(US_PER_HOUR))


def with_state(cands: DataFrame, users: DataFrame, sites: DataFrame) -> DataFrame:
    """Candidate rows with the state of their user and site and the first updates of candidate (_cf) and source (_sf)."""
    c = users.select(F.col("user_id").alias("cand_user"), "us", "indegree", "n_amp", "n_comment", "n_guestbook",
                     F.col("first_update_us").alias("_cf"))
    s = users.select(F.col("user_id").alias("source"), "us", F.col("first_update_us").alias("_sf"))
    return (cands.join(c, ["cand_user", "us"]).join(s, ["source", "us"])
            .join(sites.withColumnRenamed("site_id", "cand_site"), ["cand_site", "us"]))


def scores_of_state(rows: DataFrame, cols: list[str], models: list[str] = BASELINES) -> DataFrame:
    """``cols`` and one column per baseline, of rows with the state that the baselines need."""
    d = lambda x: x.cast("double")
    score = {
        "MostInitiatedWith": lambda: d(F.col("indegree")),
        "MostInitiatedWithRecently": lambda: d(F.col("n_site_inits")),
        "MostRecentlyInitiatedWith": lambda: _recency("last_site_init_us"),
        "MostJournalsRecently": lambda: d(F.col("n_site_journals")),
        "MostRecentJournal": lambda: _recency("last_site_journal_us"),
        "NewestAuthor": lambda: -_hours(F.col("_cf")),
        "MostInteractiveAuthorRecently": lambda: d(F.col("n_amp") + F.col("n_comment") + F.col("n_guestbook")),
        "ClosestToStart": lambda: -F.coalesce(F.abs(F.col("_cf") - F.col("_sf")) / F.lit(float(US_PER_HOUR)), F.lit(3.4028235e38)),
    }
    return rows.select(*cols, *[score[m]().alias(m) for m in models])


def baseline_scores(cands: DataFrame, users: DataFrame, sites: DataFrame, models: list[str] = BASELINES) -> DataFrame:
    """One column per baseline for each candidate row."""
    return scores_of_state(with_state(cands, users, sites), cands.columns, models)


def random_score(seed: int, *keys: str) -> Column:
    """Seeded uniform score in [0, 1)."""
    return draw(seed, *keys).cast("double") / F.lit(float(1 << 52))


def cosine_scores(cands: DataFrame, users: DataFrame, cols: list[str] = USER_FEATURES) -> DataFrame:
    """Cosine of source and candidate user vectors."""
    v = users.select("user_id", "us", vector(cols).alias("_v"))
    s = v.select(F.col("user_id").alias("source"), "us", F.col("_v").alias("_s"))
    c = v.select(F.col("user_id").alias("cand_user"), "us", F.col("_v").alias("_c"))
    return cands.join(s, ["source", "us"]).join(c, ["cand_user", "us"]).select(
        *cands.columns, V.cosine("_s", "_c").alias("score"))


def reduce_to_sites(scored: DataFrame, models: list[str], extra: list[str] | None = None) -> DataFrame:
    """Best score over source pairs and authors per (context, site): one column per model, all in
    one aggregation whose rows are combined before the shuffle."""
    return scored.groupBy("metadata_id", F.col("cand_site").alias("site_id")).agg(
        *[F.max(m).alias(m) for m in models], *[F.max(c).alias(c) for c in extra or []])


def by_model(sites: DataFrame, models: list[str]) -> DataFrame:
    """One row per model from one column per model."""
    items = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("score")) for m in models])
    return sites.select(*[c for c in sites.columns if c not in models], F.inline(items))


def target_ranks(sites: DataFrame, models: list[str], keys: list[str]) -> DataFrame:
    """Rank and score of each context's best target for every model, without ranking the rest: the
    worst-tie rank is the number of sites scoring at least as high. One aggregation, no sort."""
    hit = F.col("is_target") == 1
    tgt = sites.filter(hit).groupBy(*keys).agg(*[F.max(m).alias(f"_t_{m}") for m in models])
    n = sites.join(tgt, keys).groupBy(*keys).agg(
        *[F.sum((F.col(m) >= F.col(f"_t_{m}")).cast("long")).alias(f"_n_{m}") for m in models],
        *[F.max(f"_t_{m}").alias(f"_t_{m}") for m in models])
    return n.select(*keys, F.inline(F.array(*[F.struct(
        F.lit(m).alias("model"), F.col(f"_n_{m}").alias("target_rank"), F.col(f"_t_{m}").alias("target_score")) for m in models])))


def rank_worst_ties(scored: DataFrame, keys: list[str], score: str = "score", name: str = "rnk") -> DataFrame:
    """Rank, best = 1; tied rows all get the worst rank of the tie: the number of rows of the
    group with a score at least as high."""
    return prefix_aggregate(scored, keys, value_bucket(-F.col(score)), [F.col(score).desc()],
                            {name: ("sum", F.lit(1).cast("long"))}, ("range", 0))


def model_ranks(sites: DataFrame, models: list[str], keys: list[str], heavy: int = 1 << 20) -> DataFrame:
    """One column rank_<model> per model beside its score, ranked as by ``rank_worst_ties``, for all models at once.

    Rows meet once by key and are ordered there for each model. Keys of more than ``heavy`` rows (few: each
    holds that many) are ranked over score buckets instead, one model after the other.
    """
    hot = sites.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > heavy).drop("_n")
    names = {m: f"rank_{m}" for m in models}

    def ranked(rows: DataFrame) -> DataFrame:
        window = W.partitionBy(*keys)
        return rows.select("*", *[F.count(F.lit(1)).over(window.orderBy(F.col(m).desc()).rangeBetween(W.unboundedPreceding, 0)).alias(n)
                                  for m, n in names.items()])

    if hot.isEmpty():
        return ranked(sites)
    rest = sites.join(hot, keys, "left_semi")
    for m, n in names.items():
        rest = rank_worst_ties(rest, keys, m, n)
    return ranked(sites.join(hot, keys, "left_anti")).unionByName(rest)


def by_model_ranked(ranks: DataFrame, models: list[str]) -> DataFrame:
    """One row per model with its score and rank."""
    gone = [*models, *[f"rank_{m}" for m in models]]
    items = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("score"), F.col(f"rank_{m}").alias("rnk")) for m in models])
    return ranks.select(*[c for c in ranks.columns if c not in gone], F.inline(items))


def target_metrics(ranked: DataFrame, keys: list[str]) -> DataFrame:
    hit = F.col("is_target") == 1
    return ranked.groupBy(*keys).agg(F.min(F.when(hit, F.col("rnk"))).alias("target_rank"),
                                     F.max(F.when(hit, F.col("score"))).alias("target_score"))


def context_summary(scored: DataFrame, keys: list[str], k: int = 3) -> DataFrame:
    """Number of sites and the k lowest / highest scoring ones, flattened to columns."""
    n = scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_sites"))
    out = n
    for side, order in (("low", [F.col("score").asc(), "site_id"]), ("high", [F.col("score").desc(), "site_id"])):
        top = first_k_per_key(scored.select(*keys, "site_id", "score"), keys, order, k)
        at = lambda i, c: F.max(F.when(F.col("rn") == i, F.col(c)))
        out = out.join(top.groupBy(*keys).agg(
            *[at(i, "site_id").alias(f"{side}{i}_site") for i in range(1, k + 1)],
            *[at(i, "score").alias(f"{side}{i}_score") for i in range(1, k + 1)]), keys)
    return out


def threshold_accuracy(rows: DataFrame, keys: list[str], prob: str, label: str, at: float = 0.5) -> DataFrame:
    ok = (F.col(prob) >= at) == (F.col(label) == 1)
    return rows.groupBy(*keys).agg(F.avg(ok.cast("double")).alias("accuracy"))


def similarity(rows: DataFrame, a: str, b: str, kind: str = "cosine", name: str = "score", norms: tuple[str, str] | None = None) -> DataFrame:
    """Similarity of two vector columns: cosine, or minus the L2 distance. With ``norms``, columns of the vectors' norms, the
    vectors are arrays of doubles and only their product is worked out."""
    if norms is None:
        return rows.withColumn(name, V.cosine(a, b) if kind == "cosine" else -V.l2_distance(a, b))
    return rows.withColumn(name, V.cosine_of(a, b, *norms) if kind == "cosine" else -V.distance_of(a, b))
