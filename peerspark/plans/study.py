"""Queries over clicks, visits and study outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.draws import draw_sql
from ..operators import clicks as K, outcomes as O
from ..operators.prefix import US_PER_DAY, grouped_quantiles
from ..session import cut_lineage
from . import fixtures as X
from .registry import query
from .state import HOUR, WEEK, World

END = X.DAY0_US + 30 * US_PER_DAY

# clicks follow a recommendation mail; visits are page views of sites the user does not author
_VIS = "vis AS (SELECT * FROM ev v WHERE event_type IN ('view', 'error') AND NOT EXISTS (SELECT 1 FROM journals j WHERE j.user_id = v.user_id AND j.site_id = v.site_id))"
_CLK = "clk AS (SELECT user_id, site_id, us FROM ev WHERE event_type = 'click')"
_ATT = f"""{_CLK}, {_VIS}, att0 AS (SELECT r.*, (SELECT min(us) FROM clk c WHERE c.user_id = r.participant_id AND c.site_id = r.site_id AND c.us >= r.sent_us) AS c,
 (SELECT min(us) FROM vis c WHERE c.user_id = r.participant_id AND c.site_id = r.site_id AND c.us >= r.sent_us) AS v FROM recs r),
att AS (SELECT participant_id, batch_id, sent_us, rank, site_id, coalesce(c, v, -1) AS first_click_us, CASE WHEN coalesce(c, v) IS NULL THEN 0 ELSE 1 END AS was_clicked FROM att0)"""
_COLL = f"""{_ATT}, coll AS (SELECT site_id, min(batch_id) AS batch_id, coalesce(min(CASE WHEN was_clicked = 1 THEN first_click_us END), -1) AS first_click_us, max(was_clicked) AS was_clicked FROM att GROUP BY 1),
ct AS (SELECT batch_id, first_click_us AS t, row_number() OVER (PARTITION BY batch_id ORDER BY first_click_us) AS i, count(*) OVER (PARTITION BY batch_id) AS n FROM (SELECT DISTINCT batch_id, first_click_us FROM att WHERE was_clicked = 1)),
imp AS (SELECT c.site_id, c.batch_id, CASE WHEN was_clicked = 1 THEN first_click_us ELSE coalesce(t, -1) END AS first_click_us, was_clicked,
 CASE WHEN was_clicked = 1 THEN 'clicked' WHEN t IS NULL THEN 'unfilled' ELSE 'filled' END AS status FROM coll c LEFT JOIN ct ON ct.batch_id = c.batch_id AND ct.i = {draw_sql(23, "c.site_id")} % ct.n + 1)"""
_PROF = """prof AS (SELECT user_id, site_id, min(us) AS created_us, max(us) AS updated_us, CASE WHEN (user_id + site_id) % 9 = 0 THEN 'Organizer' ELSE 'Visitor' END AS role,
 CASE WHEN (user_id * 3 + site_id) % 13 = 0 THEN '1' END AS is_creator, CASE WHEN (user_id + site_id * 5) % 17 = 0 THEN '1' ELSE '0' END AS is_primary, max(k) % 3 AS nset FROM ev GROUP BY 1, 2)"""


class Study:
    def __init__(self, spark, d):
        self.w = World.of(spark, d)
        self.ev, self.journals, self.ints = X.events(spark, d), self.w.journals, X.interactions(spark, d)
        self.recs = X.recommendations(spark, d).drop("title")
        self.clicks = self.ev.filter("event_type = 'click'").select("user_id", "site_id", "us")
        self.authors = self.w.usps.select("user_id", "site_id")
        self.visits = self.ev.filter(F.col("event_type").isin("view", "error")).select("user_id", "site_id", "us").join(
            self.authors, ["user_id", "site_id"], "left_anti")

    def attributed(self):
        return K.attribute_clicks(self.recs, self.clicks, self.visits)

    def collapsed(self):
        return K.impute_click_times(K.collapse_sites(a := cut_lineage(self.attributed())), a)

    def profiles(self):
        s = F.col("user_id") + F.col("site_id")
        return self.ev.groupBy("user_id", "site_id").agg(
            F.min("us").alias("created_us"), F.max("us").alias("updated_us"), (F.max("k") % 3).alias("nset")).select(
            "user_id", "site_id", "created_us", "updated_us", F.when(s % 9 == 0, "Organizer").otherwise("Visitor").alias("role"),
            F.when((F.col("user_id") * 3 + F.col("site_id")) % 13 == 0, "1").alias("is_creator"),
            F.when((F.col("user_id") + F.col("site_id") * 5) % 17 == 0, "1").otherwise("0").alias("is_primary"),
            F.when(F.col("nset") == 0, F.create_map().cast("map<string,string>")).otherwise(
                F.create_map(F.lit("email"), F.col("nset").cast("string"))).alias("n"))

    def diffs(self):
        v = K.prefix_aggregate(self.visits, ["user_id", "site_id"], F.floor(F.col("us") / US_PER_DAY).cast("long"), ["us"],
                               {"old_us": ("max", F.col("us"))})
        return v.filter("old_us IS NOT NULL").select("user_id", "site_id", "old_us", F.col("us").alias("new_us"))


@query("k1_click_log", f"""
SELECT event_id, us // 1000000 * 1000000 AS us, CASE WHEN k % 4 = 0 THEN 0 ELSE k % 4 END AS batch_id, 'mail' || (user_id % 5) AS utm_source, 'site' || site_id AS site_name
FROM ev WHERE event_type <> 'error'""")
def _(spark, d):
    at = F.timestamp_micros("us")
    campaign = F.when(F.col("k") % 4 == 0, F.lit("SSE+email")).otherwise(F.concat(F.lit("SSE+email+"), (F.col("k") % 4).cast("string")))
    log = X.events(spark, d).select(
        "event_id", F.date_format(at, "yyyy-MM-dd").alias("date"), F.date_format(at, "HH:mm:ss").alias("time"),
        F.when(F.col("event_type") == "error", "HEAD").otherwise("GET").alias("method"),
        F.concat(F.lit("/visit/site"), F.col("site_id").cast("string"), F.lit("/journal")).alias("uri"),
        F.concat(F.lit("utm_source=mail"), (F.col("user_id") % 5).cast("string"), F.lit("&utm_campaign="), campaign).alias("query_string"))
    return K.parse_click_log(log)


@query("k1_page_urls", r"""
SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '[?&]utm_source=([^&#]*)', 1) AS utm_source,
 regexp_extract(url, '[?&]page=([^&#]*)', 1) AS page, regexp_extract(url, '[?&]ref=([^&#]*)', 1) AS ref FROM pages""")
def _(spark, d):
    return K.parse_urls(X.table(spark, d, "pages"), ["utm_source", "page", "ref"])


@query("j9_reconciliation", f"""
WITH {_CLK}, {_VIS}, c AS (SELECT user_id, site_id, min(us) AS click_us FROM clk GROUP BY 1, 2), v AS (SELECT user_id, site_id, min(us) AS visit_us FROM vis GROUP BY 1, 2),
j AS (SELECT sent_us, click_us, visit_us FROM recs r FULL JOIN c ON c.user_id = r.participant_id AND c.site_id = r.site_id FULL JOIN v ON v.user_id = coalesce(r.participant_id, c.user_id) AND v.site_id = coalesce(r.site_id, c.site_id))
SELECT CASE WHEN sent_us IS NULL AND click_us IS NOT NULL THEN 'unrelated_click' WHEN sent_us IS NULL THEN 'unrelated_visit' WHEN visit_us < sent_us THEN 'pre_rec_visit'
 WHEN click_us IS NOT NULL AND visit_us IS NOT NULL THEN 'both' WHEN click_us IS NOT NULL THEN 'click_only' WHEN visit_us IS NOT NULL THEN 'visit_only' ELSE 'neither' END AS category, count(*) AS n FROM j GROUP BY 1""")
def _(spark, d):
    s = Study(spark, d)
    return K.reconcile(s.recs, s.clicks, s.visits).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("j10_first_click", f"WITH {_ATT} SELECT participant_id, batch_id, rank, site_id, first_click_us, was_clicked FROM att")
def _(spark, d):
    return Study(spark, d).attributed().drop("sent_us")


_PP = f"(SELECT count(*) FROM ints i WHERE i.user_id = r.participant_id AND i.us BETWEEN r.sent_us - {WEEK} AND r.sent_us) AS n_pre, (SELECT count(*) FROM ints i WHERE i.user_id = r.participant_id AND i.us BETWEEN r.sent_us AND r.sent_us + {WEEK}) AS n_post"


@query("j11_pre_post_windows", f"SELECT participant_id, sent_us, {_PP} FROM (SELECT DISTINCT participant_id, sent_us FROM recs) r")
def _(spark, d):
    s = Study(spark, d)
    pts = s.recs.select(F.col("participant_id").alias("user_id"), F.col("sent_us").alias("us")).distinct()
    return K.pre_post(pts, s.ints, "user_id", WEEK, WEEK).withColumnsRenamed({"user_id": "participant_id", "us": "sent_us"})


@query("j12_churn", """
WITH m AS (SELECT o_custkey AS u, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1, 2),
mm AS (SELECT DISTINCT month, lead(month) OVER (ORDER BY month) AS nxt FROM (SELECT DISTINCT month FROM m)),
d AS (SELECT a.month, coalesce(b.n, 0) - a.n AS d, CASE WHEN b.n IS NULL THEN 1 ELSE 0 END AS lost FROM m a JOIN mm USING (month) LEFT JOIN m b ON b.u = a.u AND b.month = mm.nxt WHERE mm.nxt IS NOT NULL)
SELECT month, count(*) AS n_users, CAST(sum(lost) AS BIGINT) AS n_lost, round(avg(d), 6) AS mean_diff, round(stddev(d), 6) AS sd_diff FROM d GROUP BY 1""")
def _(spark, d):
    m = X.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("user_id"), F.trunc("o_orderdate", "month").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    nxt = m.select("user_id", F.add_months("m", -1).alias("m"), F.col("n").alias("_b"))
    last = m.agg(F.max("m").alias("_last"))
    x = (m.join(F.broadcast(last), F.col("m") < F.col("_last")).join(nxt, ["user_id", "m"], "left")
         .select(F.date_format("m", "yyyy-MM").alias("month"), (F.coalesce("_b", F.lit(0)) - F.col("n")).alias("d"), F.col("_b").isNull().cast("long").alias("lost")))
    return x.groupBy("month").agg(F.count(F.lit(1)).alias("n_users"), F.sum("lost").alias("n_lost"),
                                  F.round(F.avg("d"), 6).alias("mean_diff"), F.round(F.stddev("d"), 6).alias("sd_diff"))


@query("k2_time_to_click", f"WITH {_CLK} SELECT user_id, site_id, us, us - {X.DAY0_US} AS delay_us FROM clk WHERE us > {X.DAY0_US}")
def _(spark, d):
    s = Study(spark, d)
    return K.time_to_click(s.clicks, s.recs).drop("first_sent_us")


@query("k3_click_rates", f"""WITH {_ATT} SELECT 'overall' AS level, -1 AS key, count(*) AS n_recs, CAST(sum(was_clicked) AS BIGINT) AS n_clicked, round(avg(was_clicked), 6) AS ctr FROM att
UNION ALL SELECT 'batch', batch_id, count(*), CAST(sum(was_clicked) AS BIGINT), round(avg(was_clicked), 6) FROM att GROUP BY batch_id
UNION ALL SELECT 'participant', participant_id, count(*), CAST(sum(was_clicked) AS BIGINT), round(avg(was_clicked), 6) FROM att GROUP BY participant_id""")
def _(spark, d):
    return K.click_rates(Study(spark, d).attributed()).withColumn("ctr", F.round("ctr", 6))


@query("k3_clicks_per_batch", f"""WITH {_ATT}, b AS (SELECT participant_id, batch_id, sum(was_clicked) AS n FROM att GROUP BY 1, 2) SELECT CAST(n AS BIGINT) AS n_clicks, count(*) AS n_batches, count(DISTINCT participant_id) AS n_participants FROM b GROUP BY 1""")
def _(spark, d):
    return K.clicks_per_batch(Study(spark, d).attributed())


@query("k4_clicks_per_hour", f"WITH {_ATT} SELECT (first_click_us - sent_us) // {HOUR} AS hour, count(*) AS n_clicks FROM att WHERE was_clicked = 1 GROUP BY 1")
def _(spark, d):
    return K.clicks_per_hour(Study(spark, d).attributed())


@query("k5_conditions", f"""WITH {_ATT}, b AS (SELECT participant_id, batch_id, sum(was_clicked) AS n FROM att GROUP BY 1, 2),
x AS (SELECT 'all' AS condition, * FROM att UNION ALL SELECT 'clicking_participants', * FROM att WHERE participant_id IN (SELECT participant_id FROM b WHERE n > 0)
 UNION ALL SELECT 'clicked_batches', att.* FROM att JOIN b USING (participant_id, batch_id) WHERE n BETWEEN 1 AND 4)
SELECT condition, count(*) AS n, count(DISTINCT participant_id) AS n_participants, CAST(sum(was_clicked) AS BIGINT) AS n_clicked FROM x GROUP BY 1""")
def _(spark, d):
    return K.analysis_conditions(Study(spark, d).attributed()).groupBy("condition").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("participant_id").alias("n_participants"), F.sum("was_clicked").alias("n_clicked"))


_RV = f"""{_CLK}, {_VIS}, {_PROF}, allv AS (SELECT user_id, site_id, us FROM vis UNION SELECT user_id, site_id, us FROM clk UNION SELECT user_id, site_id, created_us FROM prof)"""


@query("k6_visit_reconstruction", f"WITH {_RV} SELECT user_id, site_id, count(*) AS n_visits, min(us) AS first_us, max(us) AS last_us FROM allv GROUP BY 1, 2")
def _(spark, d):
    s = Study(spark, d)
    v = K.reconstruct_visits(s.diffs(), s.profiles(), s.visits.unionByName(s.clicks))
    return v.groupBy("user_id", "site_id").agg(F.count(F.lit(1)).alias("n_visits"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


@query("k7_return_visits", f"""WITH {_VIS}, f AS (SELECT *, min(us) OVER (PARTITION BY user_id, site_id) AS f FROM vis)
SELECT user_id, site_id, count(*) AS n_visits, {", ".join(f"CAST(sum(CASE WHEN us > f + {h * HOUR} THEN 1 ELSE 0 END) AS BIGINT) AS n_return_{h}h" for h in (6, 7, 24))} FROM f GROUP BY 1, 2""")
def _(spark, d):
    return K.return_visits(Study(spark, d).visits, [6, 7, 24])


@query("k8_days_visited", f"WITH {_VIS} SELECT site_id, count(DISTINCT us // {US_PER_DAY}) AS n_days FROM vis GROUP BY 1")
def _(spark, d):
    return K.days_visited(Study(spark, d).visits, "site_id")


@query("k8_daily_visitors", f"WITH {_VIS} SELECT us // {US_PER_DAY} AS day, count(DISTINCT user_id * 1000000 + site_id) AS n_usps, count(DISTINCT user_id) AS n_users FROM vis GROUP BY 1")
def _(spark, d):
    return K.daily_visitors(Study(spark, d).visits)


@query("k9_self_author", f"""WITH {_PROF} SELECT user_id, site_id, CASE WHEN is_creator = '1' OR is_primary = '1' OR role = 'Organizer' OR EXISTS (SELECT 1 FROM journals j WHERE j.user_id = p.user_id AND j.site_id = p.site_id) THEN 1 ELSE 0 END AS is_self_author FROM prof p""")
def _(spark, d):
    s = Study(spark, d)
    return K.self_author_flag(s.profiles(), s.journals)


@query("k10_follow_actions", f"WITH {_PROF} SELECT user_id, site_id FROM prof WHERE nset > 0")
def _(spark, d):
    return K.follow_actions(Study(spark, d).profiles())


_STG = "\nUNION ALL ".join(f"SELECT '{n}' AS stage, participant_id, site_id FROM att a WHERE {c}" for n, c in (
    ("recommended", "true"), ("clicked", "was_clicked = 1"),
    ("repeat", f"EXISTS (SELECT 1 FROM vis v JOIN (SELECT user_id, site_id, min(us) AS f FROM vis GROUP BY 1, 2) f USING (user_id, site_id) WHERE v.user_id = a.participant_id AND v.site_id = a.site_id AND v.us > f.f + {7 * HOUR})"),
    ("followed", "EXISTS (SELECT 1 FROM prof p WHERE p.user_id = a.participant_id AND p.site_id = a.site_id AND nset > 0)"),
    ("initiated", "EXISTS (SELECT 1 FROM inits p WHERE p.user_id = a.participant_id AND p.site_id = a.site_id AND p.us >= a.sent_us)"),
    ("text", "EXISTS (SELECT 1 FROM ints p WHERE p.user_id = a.participant_id AND p.site_id = a.site_id AND p.itype <> 'amp')")))


@query("k11_funnel", f"""WITH {_ATT}, {_PROF}, st AS ({_STG})
SELECT stage, count(*) AS n_recs, count(DISTINCT participant_id) AS n_participants, count(DISTINCT site_id) AS n_sites, round(100.0 * count(*) / (SELECT count(*) FROM att), 6) AS pct_recs FROM st GROUP BY 1""")
def _(spark, d):
    s = Study(spark, d)
    after = s.w.inits.join(s.recs.select(F.col("participant_id").alias("user_id"), "site_id", "sent_us"), ["user_id", "site_id"]).filter("us >= sent_us")
    stages = {"clicked": s.attributed().filter("was_clicked = 1").withColumnRenamed("participant_id", "user_id"),
              "repeat": K.return_visits(s.visits, [7]).filter("n_return_7h > 0"), "followed": K.follow_actions(s.profiles()),
              "initiated": after, "text": s.ints.filter("itype <> 'amp'")}
    return K.funnel(s.recs, stages).withColumn("pct_recs", F.round("pct_recs", 6))


@query("k12_initiation_share", f"""SELECT CASE WHEN i.us >= r.sent_us THEN 1 ELSE 0 END AS is_study, count(*) AS n_initiations, count(DISTINCT i.user_id) AS n_users
FROM inits i LEFT JOIN recs r ON r.participant_id = i.user_id AND r.site_id = i.site_id WHERE i.us BETWEEN {X.DAY0_US + WEEK} AND {END} GROUP BY 1""")
def _(spark, d):
    s = Study(spark, d)
    return K.initiation_share(s.w.inits, s.recs, X.DAY0_US + WEEK, END)


@query("k13_pre_post_share", f"""WITH p AS (SELECT batch_id, {_PP} FROM (SELECT DISTINCT participant_id, batch_id, sent_us FROM recs) r)
SELECT batch_id, count(*) AS n, round(avg(n_post - n_pre), 6) AS mean_change, round(avg(CASE WHEN n_post > n_pre THEN 1.0 ELSE 0 END), 6) AS share_up, round(avg(CASE WHEN n_post < n_pre THEN 1.0 ELSE 0 END), 6) AS share_down FROM p GROUP BY 1""")
def _(spark, d):
    s = Study(spark, d)
    pts = s.recs.select(F.col("participant_id").alias("user_id"), "batch_id", F.col("sent_us").alias("us")).distinct()
    diff = F.col("n_post") - F.col("n_pre")
    return K.pre_post(pts, s.ints, "user_id", WEEK, WEEK).groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(diff), 6).alias("mean_change"),
        F.round(F.avg((diff > 0).cast("double")), 6).alias("share_up"), F.round(F.avg((diff < 0).cast("double")), 6).alias("share_down"))


_DY = """com AS (SELECT event_id, user_id, site_id FROM ints WHERE itype = 'comment'), ra AS (SELECT DISTINCT r.participant_id, u.user_id AS author, r.site_id FROM recs r JOIN usp_state u USING (site_id) WHERE u.user_id <> r.participant_id),
dy AS (SELECT DISTINCT ra.participant_id AS source, ra.author AS target, 'to_author' AS direction, c.event_id FROM ra JOIN com c ON c.user_id = ra.participant_id AND c.site_id = ra.site_id
 UNION ALL SELECT DISTINCT ra.author, ra.participant_id, 'to_participant', c.event_id FROM ra JOIN com c ON c.user_id = ra.author JOIN usp_state o ON o.user_id = ra.participant_id AND o.site_id = c.site_id)"""


def _dyads(s):
    return K.directed_dyads(s.ints.filter("itype = 'comment'"), s.recs, s.authors)


@query("k14_directed_dyads", f"WITH {_DY} SELECT source, target, direction, count(*) AS n FROM dy GROUP BY 1, 2, 3")
def _(spark, d):
    return _dyads(Study(spark, d)).groupBy("source", "target", "direction").agg(F.count(F.lit(1)).alias("n"))


@query("k15_undirected_dyads", f"""WITH {_DY} SELECT least(source, target) AS user_a, greatest(source, target) AS user_b, CAST(sum(CASE WHEN direction = 'to_author' THEN 1 ELSE 0 END) AS BIGINT) AS n_to_author,
 CAST(sum(CASE WHEN direction = 'to_participant' THEN 1 ELSE 0 END) AS BIGINT) AS n_to_participant, count(*) AS n_comments, row_number() OVER (ORDER BY least(source, target), greatest(source, target)) AS dyad_id FROM dy GROUP BY 1, 2""")
def _(spark, d):
    return K.undirected_dyads(_dyads(Study(spark, d)))


@query("k16_roles", """SELECT event_id, CASE WHEN EXISTS (SELECT 1 FROM journals j WHERE j.user_id = i.user_id AND j.site_id = i.site_id) THEN 'Author' ELSE 'Visitor' END AS user_role,
 CASE WHEN user_id IN (SELECT participant_id FROM recs) THEN 'Participant' ELSE 'Other' END AS user_group, CASE WHEN site_id IN (SELECT site_id FROM recs) THEN 'Recommended' ELSE 'Other' END AS site_group FROM ints i WHERE itype = 'comment'""")
def _(spark, d):
    s = Study(spark, d)
    return K.role_labels(s.ints.filter("itype = 'comment'"), s.authors, s.recs.select(F.col("participant_id").alias("user_id")), s.recs).select(
        "event_id", "user_role", "user_group", "site_group")


@query("k17_thread_order", """WITH p AS (SELECT conv_id, turn, role, coalesce(max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn), -1) AS parent_turn, CASE WHEN role = 'user' THEN 0 ELSE 1 END AS is_reply FROM conversations)
SELECT conv_id, turn, role, parent_turn, is_reply, row_number() OVER (PARTITION BY conv_id ORDER BY parent_turn, is_reply, turn) AS position FROM p""")
def _(spark, d):
    return K.thread_order(X.table(spark, d, "conversations"))


_W0, _W1 = X.DAY0_US + 5 * US_PER_DAY, X.DAY0_US + 8 * US_PER_DAY


@query("k18_exposed_nonparticipants", f"""WITH {_CLK}, {_VIS}, e AS (SELECT user_id, 'visited' AS kind FROM vis WHERE us BETWEEN {_W0} AND {_W1} UNION ALL SELECT user_id, 'clicked' FROM clk WHERE us BETWEEN {_W0} AND {_W1} UNION ALL SELECT user_id, 'updated' FROM journals WHERE us BETWEEN {_W0} AND {_W1})
SELECT user_id, max(CASE WHEN kind = 'visited' THEN 1 ELSE 0 END) AS visited, max(CASE WHEN kind = 'clicked' THEN 1 ELSE 0 END) AS clicked, max(CASE WHEN kind = 'updated' THEN 1 ELSE 0 END) AS updated
FROM e WHERE user_id NOT IN (SELECT user_id FROM ev WHERE event_type = 'purchase' AND us < {_W0}) GROUP BY 1""")
def _(spark, d):
    s = Study(spark, d)
    win = F.col("us").between(_W0, _W1)
    people = s.ev.filter((F.col("event_type") == "purchase") & (F.col("us") < _W0))
    return K.exposed_nonparticipants({"visited": s.visits.filter(win), "clicked": s.clicks.filter(win), "updated": s.journals.filter(win)}, people)


@query("k19_site_collapse", f"WITH {_COLL} SELECT site_id, batch_id, first_click_us, was_clicked FROM coll")
def _(spark, d):
    return K.collapse_sites(Study(spark, d).attributed())


@query("k20_imputed_click_times", f"WITH {_COLL} SELECT site_id, batch_id, first_click_us, was_clicked, status FROM imp")
def _(spark, d):
    return Study(spark, d).collapsed()


def _k21(days, back=None):
    w = ", ".join(f"({x})" for x in days)
    inw = lambda us: f"(({us} - t0 BETWEEN -{back or "w"} * {US_PER_DAY} AND 0) AND side = 'pre' OR ({us} - t0 BETWEEN 0 AND w * {US_PER_DAY}) AND side = 'post')"
    x = lambda c: f"NOT EXISTS (SELECT 1 FROM recs r WHERE r.participant_id = {c}.user_id AND r.site_id = {c}.site_id)"
    cols = ["n_updates", "n_authors", "n_interactions", "n_users_interactedwith", "n_sitewide_interactions", "n_sitewide_sites", "n_sitewide_self", "n_first_visits", "n_days_visited", "n_users_repeat_visited"]
    return f"""WITH {_COLL}, win(w) AS (VALUES {w}), sd(side) AS (VALUES ('pre'), ('post')), g AS (SELECT site_id, first_click_us AS t0, w, side FROM imp, win, sd WHERE status <> 'unfilled'),
u AS (SELECT g.site_id, w, side, count(*) AS n_updates, count(DISTINCT j.user_id) AS n_authors FROM g JOIN journals j USING (site_id) WHERE {inw('j.us')} GROUP BY 1, 2, 3),
iw AS (SELECT g.site_id, w, side, i.user_id, count(*) AS n FROM g JOIN ints i USING (site_id) WHERE {inw('i.us')} AND {x('i')} GROUP BY 1, 2, 3, 4),
p AS (SELECT site_id, w, side, CAST(sum(n) AS BIGINT) AS n_interactions, count(*) AS n_users_interactedwith FROM iw WHERE NOT EXISTS (SELECT 1 FROM usp_state a WHERE a.user_id = iw.user_id AND a.site_id = iw.site_id) GROUP BY 1, 2, 3),
sw AS (SELECT a.site_id, w, side, CAST(sum(CASE WHEN a.site_id <> iw.site_id THEN n ELSE 0 END) AS BIGINT) AS n_sitewide_interactions, CAST(sum(CASE WHEN a.site_id <> iw.site_id THEN 1 ELSE 0 END) AS BIGINT) AS n_sitewide_sites,
 CAST(sum(CASE WHEN a.site_id = iw.site_id THEN n ELSE 0 END) AS BIGINT) AS n_sitewide_self FROM iw JOIN usp_state a ON a.user_id = iw.user_id GROUP BY 1, 2, 3),
vx AS (SELECT user_id, site_id, us FROM vis v WHERE {x('v')}),
fv AS (SELECT g.site_id, w, side, count(*) AS n_first_visits FROM g JOIN (SELECT user_id, site_id, min(us) AS us FROM vx GROUP BY 1, 2) f USING (site_id) WHERE {inw('f.us')} GROUP BY 1, 2, 3),
vw AS (SELECT g.site_id, w, side, v.user_id, v.us FROM g JOIN vx v USING (site_id) WHERE {inw('v.us')}),
dv AS (SELECT site_id, w, side, count(DISTINCT us // {US_PER_DAY}) AS n_days_visited FROM vw GROUP BY 1, 2, 3),
rv AS (SELECT site_id, w, side, count(*) AS n_users_repeat_visited FROM (SELECT site_id, w, side, user_id FROM vw GROUP BY 1, 2, 3, 4 HAVING count(*) > 1) GROUP BY 1, 2, 3),
al AS (SELECT g.site_id, g.t0, g.w, g.side, {", ".join(f"coalesce({c}, 0) AS {c}" for c in cols)} FROM g LEFT JOIN u USING (site_id, w, side) LEFT JOIN p USING (site_id, w, side) LEFT JOIN sw USING (site_id, w, side)
 LEFT JOIN fv USING (site_id, w, side) LEFT JOIN dv USING (site_id, w, side) LEFT JOIN rv USING (site_id, w, side))
SELECT CAST(w AS BIGINT) AS window_days, al.site_id, imp.was_clicked, round(coalesce((al.t0 - (SELECT min(us) FROM journals j WHERE j.site_id = al.site_id)) / {float(US_PER_DAY)}, 0), 6) AS days_since_first_update,
 {", ".join(f"CAST(max(CASE WHEN side = '{s}' THEN {c} END) AS BIGINT) AS {c}_{s}" for c in cols for s in ("pre", "post"))} FROM al JOIN imp USING (site_id) GROUP BY al.w, al.site_id, imp.was_clicked, al.t0"""


def site_outcomes(spark, d, days, back=None):
    s = Study(spark, d)
    targets = cut_lineage(s.collapsed().filter("status <> 'unfilled'").select("site_id", F.col("first_click_us").alias("t0"), "was_clicked"))
    return outcomes_of(s, targets, days, back)


def outcomes_of(s, targets, days, back=None):
    pairs = s.recs.select(F.col("participant_id").alias("user_id"), "site_id")
    return O.site_outcomes(targets, s.journals, s.ints, s.visits, days, pairs, back)


BACK, FRONTS = 35, list(range(7, 92, 7))  # days before, and days after in the sweep
for _key, _days, _back in (("k21_site_outcomes", [7], None), ("k23_site_outcome_sweep", FRONTS, BACK)):
    @query(_key, _k21(_days, _back))
    def _(spark, d, _days=_days, _back=_back):
        return site_outcomes(spark, d, _days, _back).drop("t0").withColumn("days_since_first_update", F.round("days_since_first_update", 6))


_UM = {"n_updates": "(SELECT count(*) FROM journals j WHERE j.user_id = g.user_id AND j.us BETWEEN lo AND hi)"}
for _n, _a, _c in (("n_sites_interactedwith", "count(DISTINCT site_id)", "NOT own"), ("n_self_sites", "count(DISTINCT site_id)", "own"), ("n_sites_text", "count(DISTINCT site_id)", "NOT own AND itype <> 'amp'"),
                   ("n_interactions", "count(*)", "NOT own"), ("n_self_interactions", "count(*)", "own"), ("n_text_interactions", "count(*)", "NOT own AND itype <> 'amp'")):
    _UM[_n] = f"(SELECT {_a} FROM io i WHERE i.user_id = g.user_id AND i.us BETWEEN lo AND hi AND {_c})"
_UM["n_first_visits"] = "(SELECT count(*) FROM fvx i WHERE i.user_id = g.user_id AND i.us BETWEEN lo AND hi)"
_UM["n_days_visited"] = f"(SELECT count(DISTINCT us // {US_PER_DAY}) FROM vx i WHERE i.user_id = g.user_id AND i.us BETWEEN lo AND hi)"
_UM["n_sites_repeat_visited"] = "(SELECT count(DISTINCT a.site_id) FROM vx a JOIN vx b ON a.user_id = b.user_id AND a.site_id = b.site_id AND b.us > a.us WHERE a.user_id = g.user_id AND a.us BETWEEN lo AND hi AND b.us BETWEEN lo AND hi)"
_T0 = X.DAY0_US + 2 * WEEK


_K22 = f"""WITH {_VIS}, nr AS (SELECT participant_id, site_id FROM recs),
io AS (SELECT i.*, EXISTS (SELECT 1 FROM usp_state a WHERE a.user_id = i.user_id AND a.site_id = i.site_id) AS own FROM ints i WHERE NOT EXISTS (SELECT 1 FROM nr WHERE nr.participant_id = i.user_id AND nr.site_id = i.site_id)),
vx AS (SELECT user_id, site_id, us FROM vis v WHERE NOT EXISTS (SELECT 1 FROM nr WHERE nr.participant_id = v.user_id AND nr.site_id = v.site_id)), fvx AS (SELECT user_id, site_id, min(us) AS us FROM vx GROUP BY 1, 2),
g AS (SELECT DISTINCT user_id, side, lo, hi FROM ev, (SELECT 'pre' AS side, {_T0 - WEEK} AS lo, {_T0} AS hi UNION ALL SELECT 'post', {_T0}, {_T0 + WEEK})),
m AS (SELECT user_id, side, {", ".join(f"{v} AS {k}" for k, v in _UM.items())} FROM g)"""
_K22_ROWS = f"""SELECT 7 AS window_days, user_id, round(coalesce(({_T0} - (SELECT min(us) FROM journals j WHERE j.user_id = m.user_id)) / {float(US_PER_DAY)}, 0), 6) AS days_since_first_update,
 {", ".join(f"CAST(max(CASE WHEN side = '{s}' THEN {c} END) AS BIGINT) AS {c}_{s}" for c in _UM for s in ("pre", "post"))} FROM m GROUP BY user_id"""


def user_outcomes(spark, d):
    s = Study(spark, d)
    targets = s.ev.select("user_id").distinct().withColumn("t0", F.lit(_T0))
    pairs = s.recs.select(F.col("participant_id").alias("user_id"), "site_id")
    return O.user_outcomes(targets, s.journals, s.ints, s.visits, [7], pairs).drop("t0")


@query("k22_user_outcomes", f"{_K22} {_K22_ROWS}")
def _(spark, d):
    return user_outcomes(spark, d).withColumn("days_since_first_update", F.round("days_since_first_update", 6))


@query("k24_weekly_rates", f"""WITH {_VIS}, v AS (SELECT vis.user_id, vis.site_id, count(*) AS n FROM vis JOIN recs r ON r.participant_id = vis.user_id AND r.site_id = vis.site_id WHERE us >= sent_us GROUP BY 1, 2),
c AS (SELECT p.user_id, (SELECT count(*) FROM v WHERE v.user_id = p.user_id AND n > 1) AS n_second_visits, (SELECT count(*) FROM ints i JOIN recs r ON r.participant_id = i.user_id AND r.site_id = i.site_id WHERE i.user_id = p.user_id AND i.us >= r.sent_us) AS n_interactions
FROM (SELECT DISTINCT user_id FROM ev) p)
SELECT user_id, n_second_visits, n_interactions, round(n_second_visits / (30 / 7.0), 6) AS second_visits_per_week, round(n_interactions / (30 / 7.0), 6) AS interactions_per_week FROM c""")
def _(spark, d):
    s = Study(spark, d)
    r = K.weekly_rates(s.visits, s.ints, s.recs, END)
    return r.withColumns({c: F.round(c, 6) for c in ("second_visits_per_week", "interactions_per_week")})


@query("k25_profile_summary", f"""WITH {_PROF}, t AS (SELECT user_id, site_id, n_updates, row_number() OVER (PARTITION BY user_id ORDER BY n_updates DESC, site_id) AS rn FROM usp_state)
SELECT p.user_id, count(*) AS n_sites, CAST(sum(CASE WHEN role = 'Organizer' THEN 1 ELSE 0 END) AS BIGINT) AS n_organizer, CAST(sum(CASE WHEN role = 'Visitor' THEN 1 ELSE 0 END) AS BIGINT) AS n_visitor,
 coalesce(max(t.site_id), -1) AS top_site, coalesce(max(t.n_updates), 0) AS top_updates FROM prof p LEFT JOIN t ON t.user_id = p.user_id AND t.rn = 1 GROUP BY 1""")
def _(spark, d):
    s = Study(spark, d)
    n = s.journals.groupBy("user_id", "site_id").agg(F.count(F.lit(1)).alias("n_updates"))
    return K.profile_summary(s.profiles(), n)


@query("k25_tenure_quantiles", f"""WITH {_PROF} SELECT role, {", ".join(f"round(quantile_cont((updated_us - created_us) / {float(US_PER_DAY)}, {p}), 6) AS p{int(100 * p)}" for p in (0.1, 0.25, 0.5, 0.75, 0.9))} FROM prof GROUP BY 1""")
def _(spark, d):
    p = Study(spark, d).profiles().withColumn("days", (F.col("updated_us") - F.col("created_us")) / float(US_PER_DAY))
    names = {f"p{int(100 * q)}": q for q in (0.1, 0.25, 0.5, 0.75, 0.9)}
    return grouped_quantiles(p, ["role"], "days", names).select("role", *[F.round(n, 6).alias(n) for n in names])


@query("k26_click_segments", f"""WITH {_ATT}, n AS (SELECT participant_id, count(*) AS n FROM att WHERE was_clicked = 1 GROUP BY 1)
SELECT CASE WHEN n >= 3 THEN '3+' ELSE CAST(n AS VARCHAR) END AS segment, count(*) AS n_participants FROM n GROUP BY 1""")
def _(spark, d):
    return K.click_segments(Study(spark, d).attributed()).groupBy("segment").agg(F.count(F.lit(1)).alias("n_participants"))


@query("k26_feedback_sites", f"""WITH {_ATT}, c AS (SELECT participant_id, site_id, first_click_us, row_number() OVER (PARTITION BY participant_id ORDER BY first_click_us DESC, site_id DESC) AS r FROM att WHERE was_clicked = 1),
o AS (SELECT *, CASE WHEN r = 1 THEN 1 ELSE 0 END AS is_latest, row_number() OVER (PARTITION BY participant_id ORDER BY CASE WHEN r = 1 THEN 0 ELSE 1 END, md5(participant_id || '|' || site_id)) AS pick FROM c)
SELECT participant_id, site_id, first_click_us, is_latest, pick FROM o WHERE pick <= 3""")
def _(spark, d):
    return K.feedback_sites(Study(spark, d).attributed()).withColumn("pick", F.col("pick").cast("long"))


_CODES = {"code_a": 2, "code_b": 3, "code_c": 5}


@query("k27_batch_content", f"""WITH {_ATT}, c AS (SELECT *, {", ".join(f"CASE WHEN site_id % {m} = 0 THEN 1 ELSE 0 END AS {n}" for n, m in _CODES.items())} FROM att)
SELECT participant_id, batch_id, {", ".join(f"CAST(sum({n}) AS BIGINT) AS sum_{n}, max({n}) AS max_{n}" for n in _CODES)}, max(greatest(code_a, code_b, code_c)) AS any_code, count(DISTINCT code_a * 4 + code_b * 2 + code_c) AS n_combinations, max(was_clicked) AS any_click FROM c GROUP BY 1, 2""")
def _(spark, d):
    a = Study(spark, d).attributed().withColumns({n: F.when(F.col("site_id") % m == 0, 1).otherwise(0) for n, m in _CODES.items()})
    return K.batch_content(a, list(_CODES))


@query("k28_peer_interactions", f"""WITH p AS (SELECT i.*, CASE WHEN r.site_id IS NULL THEN 0 ELSE 1 END AS is_rec FROM ints i LEFT JOIN recs r ON r.participant_id = i.user_id AND r.site_id = i.site_id
 WHERE i.us >= {X.DAY0_US} AND NOT EXISTS (SELECT 1 FROM usp_state a WHERE a.user_id = i.user_id AND a.site_id = i.site_id)),
s AS (SELECT 'interacting_participants' AS segment, * FROM p WHERE user_id IN (SELECT user_id FROM p WHERE is_rec = 1) UNION ALL SELECT 'participants', * FROM p UNION ALL SELECT 'authors', * FROM p WHERE user_id IN (SELECT user_id FROM usp_state))
SELECT segment, is_rec AS is_recommended, count(*) AS n_interactions, count(DISTINCT user_id) AS n_users, count(DISTINCT site_id) AS n_sites, round(avg(CASE WHEN itype = 'amp' THEN 1.0 ELSE 0 END), 6) AS reaction_share FROM s GROUP BY 1, 2""")
def _(spark, d):
    s = Study(spark, d)
    return K.peer_interactions(s.ints, s.recs, s.authors).withColumn("reaction_share", F.round("reaction_share", 6))
