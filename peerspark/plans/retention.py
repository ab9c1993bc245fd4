"""Queries over early interactions, survival and descriptive rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contexts as C, survival as V
from ..operators.prefix import US_PER_DAY, grouped_quantiles, state_at
from ..session import cut_lineage
from . import fixtures as X
from .ranking import _FEAT, Ranking
from .registry import query

DAY, END, EARLY, CENSOR = US_PER_DAY, X.DAY0_US + 30 * US_PER_DAY, 7, 4
_r = lambda c, n=6: f"round({c}, {n})"
_SUM = lambda c: f"CAST(sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS BIGINT)"
_PEER = "NOT EXISTS (SELECT 1 FROM usp_state u WHERE u.user_id = i.user_id AND u.site_id = i.site_id)"
_Q1 = f"""q1s AS (SELECT site_id, min(us) AS first_us FROM journals WHERE site_id % 31 <> 4 GROUP BY 1),
q1e AS (SELECT i.*, s.first_us, {_PEER} AS peer, (SELECT min(us) FROM journals j WHERE j.user_id = i.user_id) AS a FROM ints i JOIN q1s s USING (site_id) WHERE i.us BETWEEN s.first_us AND s.first_us + {EARLY * DAY}),
q1 AS (SELECT s.site_id, s.first_us, {", ".join(f"coalesce({_SUM(c)}, 0) AS {n}" for n, c in (("n_peer", "peer"), ("n_peer_author", "peer AND a <= us"), ("n_self", "NOT peer"), ("n_amp", "peer AND itype = 'amp'"), ("n_comment", "peer AND itype = 'comment'"), ("n_guestbook", "peer AND itype = 'guestbook'")))}
 FROM q1s s LEFT JOIN q1e e USING (site_id) GROUP BY 1, 2)"""
_ACT = lambda censor=CENSOR: f"""q2f AS (SELECT *, min(us) OVER (PARTITION BY site_id) AS f FROM journals), q2 AS (SELECT site_id, min(us) AS first_us, max(us) AS last_us, {_SUM(f"us <= f + {EARLY * DAY}")} AS n_early, {_SUM(f"us > f + {EARLY * DAY}")} AS n_later,
 (max(us) - min(us)) / {float(DAY)} AS tenure_days, CASE WHEN max(us) > {END} - {censor} * {DAY} THEN 1 ELSE 0 END AS is_censored FROM q2f GROUP BY 1)"""


def early(spark, d):
    blocked = X.events(spark, d).filter(F.col("site_id") % 31 == 4).select("site_id").distinct()
    return V.early_interactions(X.interactions(spark, d), X.journals(spark, d), EARLY, blocked)


def activity(spark, d, censor=CENSOR):
    return V.site_activity(X.journals(spark, d), END, EARLY, censor)


def survival_rows(spark, d):
    e = early(spark, d).select("site_id", (F.col("n_peer") > 0).cast("int").alias("has_early"))
    return cut_lineage(activity(spark, d).join(e, "site_id").withColumn("t", F.floor("tenure_days").cast("double")).withColumn(
        "event", 1 - F.col("is_censored")))


@query("q1_early_interactions", f"WITH {_Q1} SELECT * FROM q1")
def _(spark, d):
    return early(spark, d)


@query("q2_site_activity", f"WITH {_ACT()} SELECT site_id, first_us, last_us, n_early, n_later, {_r('tenure_days')} AS tenure_days, is_censored FROM q2")
def _(spark, d):
    return activity(spark, d).withColumn("tenure_days", F.round("tenure_days", 6))


@query("q3_survival_category", f"""WITH {_ACT()} SELECT CASE WHEN tenure_days - {EARLY} <= 0 THEN '0' WHEN tenure_days - {EARLY} <= 3 THEN '<=3' WHEN tenure_days - {EARLY} <= 7 THEN '<=7' WHEN tenure_days - {EARLY} <= 14 THEN '<=14' ELSE '>14' END AS category,
 count(*) AS n, round(avg(greatest(tenure_days - {EARLY}, 0) / 30.4375), 6) AS mean_months FROM q2 GROUP BY 1""")
def _(spark, d):
    after = F.col("tenure_days") - EARLY
    return activity(spark, d).groupBy(V.survival_category(after, (3, 7, 14)).alias("category")).agg(
        F.count("*").alias("n"), F.round(F.avg(F.greatest(after, F.lit(0)) / 30.4375), 6).alias("mean_months"))


_KM = f"""sr AS (SELECT has_early, floor(tenure_days) AS t, 1 - is_censored AS event FROM q2 JOIN (SELECT site_id, CASE WHEN n_peer > 0 THEN 1 ELSE 0 END AS has_early FROM q1) USING (site_id)),
pt AS (SELECT has_early, t, sum(event) AS d, count(*) AS n FROM sr GROUP BY 1, 2),
rk AS (SELECT has_early, t, CAST(d AS BIGINT) AS d, CAST(sum(n) OVER (PARTITION BY has_early ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS n_at_risk FROM pt),
km AS (SELECT has_early, t, d, n_at_risk, product(1 - d / n_at_risk) OVER (PARTITION BY has_early ORDER BY t) AS survival FROM rk)"""


@query("q4_kaplan_meier", f"WITH {_Q1}, {_ACT()}, {_KM} SELECT has_early, t, d, n_at_risk, {_r('survival')} AS survival FROM km")
def _(spark, d):
    return V.kaplan_meier(survival_rows(spark, d), ["has_early"], "t", "event").withColumn("survival", F.round("survival", 6))


@query("q5_censor_sweep", "WITH thr AS (SELECT unnest([2, 4, 7]) AS c), " + _ACT().replace(f"{END} - {CENSOR} * {DAY}", f"{END} - c * {DAY}").replace("AS is_censored FROM q2f GROUP BY 1)", "AS is_censored, c FROM q2f, thr GROUP BY site_id, c)") + """,
pt AS (SELECT c, floor(tenure_days) AS t, sum(1 - is_censored) AS d, count(*) AS n FROM q2 GROUP BY 1, 2), rk AS (SELECT c, t, d, sum(n) OVER (PARTITION BY c ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r FROM pt),
km AS (SELECT c, t, r, product(1 - d / r) OVER (PARTITION BY c ORDER BY t) AS s FROM rk) SELECT c AS censor_days, coalesce(min(CASE WHEN s <= 0.5 THEN t END), -1) AS median, CAST(max(r) AS BIGINT) AS n FROM km GROUP BY 1""")
def _(spark, d):
    a = activity(spark, d).withColumn("censor_days", F.explode(F.array(F.lit(2), F.lit(4), F.lit(7))))
    rows = cut_lineage(a.select("censor_days", F.floor("tenure_days").alias("t"), (F.col("last_us") <= END - F.col("censor_days") * F.lit(DAY)).cast("long").alias("event")))
    return V.median_survival(V.kaplan_meier(rows, ["censor_days"], "t", "event"), ["censor_days"]).withColumn("median", F.coalesce("median", F.lit(-1.0)))


@query("q6_group_comparison", f"""WITH {_Q1}, {_ACT()}, x AS (SELECT tenure_days AS v, CASE WHEN n_peer > 0 THEN 1 ELSE 0 END AS g FROM q2 JOIN q1 USING (site_id)),
r AS (SELECT *, (rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0) AS mr FROM x),
m AS (SELECT count(*) FILTER (g = 1) AS n1, count(*) FILTER (g = 0) AS n0, avg(v) FILTER (g = 1) AS mean1, avg(v) FILTER (g = 0) AS mean0, stddev(v) FILTER (g = 1) AS sd1, stddev(v) FILTER (g = 0) AS sd0, sum(mr) FILTER (g = 1) AS sr,
 quantile_cont(v, 0.5) FILTER (g = 1) AS median1, quantile_cont(v, 0.5) FILTER (g = 0) AS median0 FROM r), u AS (SELECT *, sr - n1 * (n1 + 1) / 2.0 AS u1 FROM m)
SELECT n1, n0, {", ".join(f"{_r(c)} AS {c}" for c in ("mean1", "mean0", "sd1", "sd0", "median1", "median0", "u1"))}, {_r("(mean1 - mean0) / sqrt(sd1 * sd1 / n1 + sd0 * sd0 / n0)")} AS welch_t, {_r("u1 / (n1 * n0)")} AS cles FROM u""")
def _(spark, d):
    rows = survival_rows(spark, d)
    out = V.compare_groups(rows, "tenure_days", "has_early")
    return out.select("n1", "n0", *[F.round(c, 6).alias(c) for c in ("mean1", "mean0", "sd1", "sd0", "median1", "median0", "u1", "welch_t", "cles")])


@query("q13_pooled_effect", f"""WITH x AS (SELECT user_id, user_id % 2 AS arm, sum(CASE WHEN us < {X.GEN_START_US} THEN 1 ELSE 0 END) - sum(CASE WHEN us >= {X.GEN_START_US} AND us < {X.TEST_START_US} THEN 1 ELSE 0 END) AS diff FROM journals GROUP BY 1),
s AS (SELECT count(*) FILTER (arm = 1) AS n1, count(*) FILTER (arm = 0) AS n0, avg(diff) FILTER (arm = 1) AS mean1, avg(diff) FILTER (arm = 0) AS mean0, var_samp(diff) FILTER (arm = 1) AS var1, var_samp(diff) FILTER (arm = 0) AS var0 FROM x)
SELECT 'all' AS k, n1, n0, {", ".join(f"{_r(c)} AS {c}" for c in ("mean1", "mean0", "var1", "var0"))}, {_r("(mean0 - mean1) / sqrt(((n0 - 1) * var0 + (n1 - 1) * var1) / (n1 + n0 - 2))")} AS effect FROM s""")
def _(spark, d):
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    us = F.col("us")
    x = X.journals(spark, d).groupBy("user_id").agg((n(us < X.GEN_START_US) - n((us >= X.GEN_START_US) & (us < X.TEST_START_US))).alias("diff")).select(
        F.lit("all").alias("k"), (F.col("user_id") % 2).alias("arm"), "diff")
    return V.pooled_effect(x, ["k"], "diff", "arm").select("k", "n1", "n0", *[F.round(c, 6).alias(c) for c in ("mean1", "mean0", "var1", "var0", "effect")])


_MS = """ms AS (SELECT s.site_id, (min(j.us) - s.created_us) / 3.6e9 AS create_to_first, (max(CASE WHEN rn = 2 THEN j.us END) - min(j.us)) / 3.6e9 AS first_to_second, (max(j.us) - min(j.us)) / 3.6e9 AS first_to_last
 FROM sites s JOIN (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY us) AS rn FROM journals) j USING (site_id) GROUP BY s.site_id, s.created_us),
ml AS (UNPIVOT (SELECT create_to_first, first_to_second, first_to_last FROM ms) ON create_to_first, first_to_second, first_to_last INTO NAME gap VALUE hours)"""


@query("q15_update_milestones", f"WITH {_MS} SELECT gap, CAST(floor(log2(hours + 1)) AS BIGINT) AS bucket, count(*) AS n, m.median FROM ml JOIN (SELECT gap, {_r('quantile_cont(hours, 0.5)')} AS median FROM ml GROUP BY 1) m USING (gap) GROUP BY ALL")
def _(spark, d):
    m = V.update_milestones(X.journals(spark, d), X.sites(spark, d))
    gaps = ("create_to_first", "first_to_second", "first_to_last")
    long = cut_lineage(m.select(F.inline(F.array(*[F.struct(F.lit(g).alias("gap"), F.col(g).alias("hours")) for g in gaps]))).filter("hours IS NOT NULL"))
    med = grouped_quantiles(long, ["gap"], "hours", {"median": 0.5}).withColumn("median", F.round("median", 6))
    return long.groupBy("gap", V.log_bucket(F.col("hours")).alias("bucket")).agg(F.count("*").alias("n")).join(med, "gap")


_MIX = """am AS (SELECT e.event_id, e.us, e.k % 3 > 0 AS is_new, (SELECT max(us) FROM journals j WHERE j.site_id = e.site_id AND j.us < e.us) AS upd, e.site_id FROM ev e WHERE event_type = 'click'),
mx AS (SELECT site_id, upd, sum(CASE WHEN is_new THEN 1 ELSE 0 END) AS n_new, count(*) AS n FROM am WHERE upd IS NOT NULL GROUP BY 1, 2)"""


@query("q16_reaction_mix", f"""WITH {_MIX}, md AS (SELECT us // {DAY} AS day, count(*) AS n FROM am GROUP BY 1)
SELECT CASE WHEN n_new = 0 THEN 'all_old' WHEN n_new = n THEN 'all_new' ELSE 'both' END AS mix, count(*) AS n_updates, CAST(sum(n) AS BIGINT) AS n_reactions,
 (SELECT {_r(f"quantile_cont(n, 0.5) FILTER (day < {X.TEST_START_US // DAY})")} FROM md) AS median_daily_pre, (SELECT {_r(f"quantile_cont(n, 0.5) FILTER (day >= {X.TEST_START_US // DAY})")} FROM md) AS median_daily_post FROM mx GROUP BY 1""")
def _(spark, d):
    amps = X.events(spark, d).filter("event_type = 'click'").select("event_id", "site_id", "us", (F.col("k") % 3 > 0).cast("int").alias("is_new"))
    seen = state_at(amps, X.journals(spark, d), ["site_id"], {"upd": ("max", F.col("us"))}).filter("upd IS NOT NULL")
    per = seen.groupBy("site_id", "upd").agg(F.sum("is_new").alias("n_new"), F.count("*").alias("n"))
    mix = F.when(F.col("n_new") == 0, "all_old").when(F.col("n_new") == F.col("n"), "all_new").otherwise("both")
    daily = amps.groupBy(F.floor(F.col("us") / DAY).alias("day")).agg(F.count("*").alias("n")).withColumn("post", F.col("day") >= X.TEST_START_US // DAY)
    q = grouped_quantiles(daily, ["post"], "n", {"m": 0.5}).agg(F.round(F.max(F.when(~F.col("post"), F.col("m"))), 6).alias("median_daily_pre"),
                                                               F.round(F.max(F.when(F.col("post"), F.col("m"))), 6).alias("median_daily_post"))
    return per.groupBy(mix.alias("mix")).agg(F.count("*").alias("n_updates"), F.sum("n").alias("n_reactions")).join(F.broadcast(q), F.lit(True))


@query("q16_adoption_by_day", f"WITH {_MIX} SELECT us // {DAY} AS day, count(*) AS n, {_r('avg(CASE WHEN is_new THEN 1.0 ELSE 0 END)')} AS share_new FROM am GROUP BY 1")
def _(spark, d):
    return X.events(spark, d).filter("event_type = 'click'").groupBy(F.floor(F.col("us") / DAY).cast("long").alias("day")).agg(
        F.count("*").alias("n"), F.round(F.avg((F.col("k") % 3 > 0).cast("double")), 6).alias("share_new"))


@query("q17_daily_counts", f"SELECT us // {DAY} AS day, atype, count(*) AS n FROM act GROUP BY 1, 2")
def _(spark, d):
    return X.activity(spark, d).groupBy(F.floor(F.col("us") / DAY).cast("long").alias("day"), "atype").agg(F.count("*").alias("n"))


@query("q17_site_update_shares", f"""WITH w AS (SELECT us // {7 * DAY} AS week, site_id, count(*) AS n FROM journals GROUP BY 1, 2), t AS (SELECT count(DISTINCT site_id) AS t FROM journals)
SELECT week, {", ".join(f"{_r(f'100.0 * sum(CASE WHEN n >= {k} THEN 1 ELSE 0 END) / max(t)')} AS pct_{k}" for k in (1, 2, 5))} FROM w, t GROUP BY 1""")
def _(spark, d):
    j = X.journals(spark, d)
    w = j.groupBy(F.floor(F.col("us") / (7 * DAY)).cast("long").alias("week"), "site_id").agg(F.count("*").alias("n"))
    t = j.agg(F.countDistinct("site_id").alias("t"))
    return w.groupBy("week").agg(*[F.sum((F.col("n") >= k).cast("long")).alias(f"c{k}") for k in (1, 2, 5)]).join(F.broadcast(t), F.lit(True)).select(
        "week", *[F.round(100.0 * F.col(f"c{k}") / F.col("t"), 6).alias(f"pct_{k}") for k in (1, 2, 5)])


@query("q18_hour_profile", f"SELECT atype, us // 3600000000 % 24 AS hour, count(*) AS n, {_r('count(*) / sum(count(*)) OVER (PARTITION BY atype)')} AS share FROM act GROUP BY 1, 2")
def _(spark, d):
    h = X.activity(spark, d).groupBy("atype", F.pmod(F.floor(F.col("us") / 3_600_000_000), F.lit(24)).cast("long").alias("hour")).agg(F.count("*").alias("n"))
    return V.share_within(h, ["atype", "hour"], ["atype"]).withColumn("share", F.round("share", 6))


_QS = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}


@query("q19_quantiles", f"SELECT o_orderpriority, {', '.join(f'{_r(f'quantile_cont(o_totalprice, {p})', 4)} AS {n}' for n, p in _QS.items())} FROM orders GROUP BY 1")
def _(spark, d):
    return grouped_quantiles(X.table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", _QS).select(
        "o_orderpriority", *[F.round(n, 4).alias(n) for n in _QS])


@query("q19_correlation", f"SELECT l_returnflag, {_r('corr(l_quantity, l_extendedprice)')} AS r, count(*) AS n FROM lineitem GROUP BY 1")
def _(spark, d):
    return X.table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"), F.count("*").alias("n"))


@query("q20_customised_crosstab", f"""WITH x AS (SELECT site_id % 3 > 0 AS c, num_journals FROM sites) SELECT CAST(c AS BIGINT) AS customised, CAST(num_journals > 2 AS BIGINT) AS has_updates, count(*) AS n, {_r('count(*) / sum(count(*)) OVER (PARTITION BY c)')} AS share, m.median
FROM x JOIN (SELECT c, {_r('quantile_cont(num_journals, 0.5)')} AS median FROM x GROUP BY 1) m USING (c) GROUP BY c, num_journals > 2, m.median""")
def _(spark, d):
    s = X.sites(spark, d).select((F.col("site_id") % 3 > 0).cast("long").alias("customised"), (F.col("num_journals") > 2).cast("long").alias("has_updates"), "num_journals")
    med = grouped_quantiles(s, ["customised"], "num_journals", {"median": 0.5}).withColumn("median", F.round("median", 6))
    c = V.share_within(s.groupBy("customised", "has_updates").agg(F.count("*").alias("n")), ["customised", "has_updates"], ["customised"])
    return c.join(med, "customised").withColumn("share", F.round("share", 6))


_LAG = "CASE WHEN k % 9 = 0 THEN NULL WHEN k % 5 = 0 THEN 0 ELSE round(value * 100) / 100.0 * (k % 7) END"


@query("q21_publish_lag", f"""WITH x AS (SELECT event_type, {_LAG} AS h FROM ev WHERE event_type IN ('signup', 'purchase'))
SELECT event_type, {_r("100 * avg(CASE WHEN h IS NULL THEN 1.0 ELSE 0 END)")} AS pct_unpublished, {_r("100 * avg(CASE WHEN h >= 168 THEN 1.0 WHEN h IS NOT NULL THEN 0 END)")} AS pct_week,
 {_r("100 * avg(CASE WHEN h <= 1 THEN 1.0 WHEN h IS NOT NULL THEN 0 END)")} AS pct_hour, {_r("100 * avg(CASE WHEN h = 0 THEN 1.0 WHEN h IS NOT NULL THEN 0 END)")} AS pct_zero, {_r("quantile_cont(h, 0.5)")} AS median_hours FROM x GROUP BY 1""")
def _(spark, d):
    k = F.col("k")
    h = F.when(k % 9 == 0, None).when(k % 5 == 0, 0.0).otherwise(F.round(F.col("value") * 100) / 100.0 * (k % 7))
    x = X.events(spark, d).filter(F.col("event_type").isin("signup", "purchase")).select("event_type", h.alias("h"))
    pct = lambda c: F.round(100 * F.avg(c.cast("double")), 6)
    out = x.groupBy("event_type").agg(pct(F.col("h").isNull()).alias("pct_unpublished"), pct(F.col("h") >= 168).alias("pct_week"),
                                      pct(F.col("h") <= 1).alias("pct_hour"), pct(F.col("h") == 0).alias("pct_zero"))
    return out.join(grouped_quantiles(x, ["event_type"], "h", {"median_hours": 0.5}), "event_type").withColumn("median_hours", F.round("median_hours", 6))


@query("q22_degree_conditioned_labels", f"""WITH {_FEAT}, x AS (SELECT is_target AS label, CASE WHEN indegree > 0 THEN 1 ELSE 0 END AS received, CASE WHEN outdegree > 0 THEN 1 ELSE 0 END AS made FROM cand c JOIN feat f ON f.user_id = c.cand_user AND f.us = c.us)
SELECT label, received, made, count(*) AS n, {_r("count(*) / sum(count(*)) OVER (PARTITION BY label)")} AS share FROM x GROUP BY 1, 2, 3""")
def _(spark, d):
    w = Ranking.of(spark, d)
    c = C.label_counts(w.eligible, w.usps, w.targets, w.activity, w.edges)
    return V.share_within(c, ["label", "received", "made"], ["label"]).withColumn("share", F.round("share", 6))
