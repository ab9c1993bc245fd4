"""Queries over point-in-time state, the graph, contexts and candidates."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from ..functions.draws import draw_sql
from ..operators import contexts as C, features as FE, graph as G, state as S
from ..operators.prefix import US_PER_DAY
from ..session import cut_lineage
from . import fixtures as X
from .registry import query

WEEK = 7 * US_PER_DAY
HOUR = 3_600_000_000


class World:
    """State tables derived from the events. Each is written once (checkpointed) and read by every
    later step and query of the session: they are small next to the events, and plans on top of
    them stay short."""

    _shared: dict = {}

    @classmethod
    def of(cls, spark, d):
        """The tables of this session and input folder; ``forget`` starts afresh."""
        key = (cls, spark.sparkContext.applicationId, d)
        if key not in World._shared:
            World._shared[key] = cls(spark, d)
        return World._shared[key]

    @staticmethod
    def forget():
        World._shared.clear()

    def __init__(self, spark, d):
        self.spark, self.d = spark, d
        self.journals, self.activity = X.journals(spark, d), X.activity(spark, d)

    @cached_property
    def usps(self):
        return cut_lineage(S.usp_state(self.journals, X.ELIGIBLE_K))

    @cached_property
    def inits(self):
        return cut_lineage(S.initiations(X.interactions(self.spark, self.d)))

    @cached_property
    def edges(self):
        return cut_lineage(G.edges(self.inits, self.usps))

    @cached_property
    def contexts(self):
        return C.contexts_from(self.inits, X.GEN_START_US)

    @cached_property
    def eligible(self):
        return cut_lineage(C.eligible_contexts(self.contexts, self.usps))

    @cached_property
    def targets(self):
        return cut_lineage(C.adjusted_targets(self.eligible, self.usps, self.journals, self.activity, X.TEST_START_US))

    def candidate_rows(self, ctx):
        """Candidates and targets of contexts, not kept: there are far more of them than events."""
        return C.context_candidates(ctx, self.usps, self.targets, self.activity, self.edges)

    @cached_property
    def candidates(self):
        return cut_lineage(self.candidate_rows(self.eligible))

    def flagged_pairs(self, *flags):
        """The pairs with flags, not kept."""
        return FE.candidate_flags(self.eligible, self.targets, self.usps, self.activity, self.edges, list(flags)).drop("us")

    @cached_property
    def pairs(self):
        return self.candidates.select("metadata_id", "us", "source", "cand_user").distinct()

    @cached_property
    def triples(self):
        return C.triples(self.eligible, self.usps, self.targets, self.activity, self.edges)


@query("p1_usp_state", "SELECT user_id, site_id, exist_us, coalesce(elig_us, -1) AS elig_us FROM usp_state")
def _(spark, d):
    w = World.of(spark, d)
    return w.usps.withColumn("elig_us", F.coalesce("elig_us", F.lit(-1).cast("long")))


@query("p2_initiations", """
SELECT i.event_id, i.user_id, i.site_id, i.itype, CASE WHEN i.event_id = f.event_id THEN 0 ELSE 1 END AS already
FROM ints i JOIN inits f USING (user_id, site_id)""")
def _(spark, d):
    return S.flag_initiations(X.interactions(spark, d)).select(
        "event_id", "user_id", "site_id", "itype", F.col("has_already_initiated").cast("int").alias("already"))


_ROLL = ", ".join(
    f"(SELECT count(*) FROM act a WHERE a.user_id = p.user_id AND a.atype = '{t}' AND a.us >= p.us - {WEEK} AND a.us < p.us) AS n_{t}, "
    f"coalesce((SELECT max(a.us) FROM act a WHERE a.user_id = p.user_id AND a.atype = '{t}' AND a.us >= p.us - {WEEK} AND a.us < p.us), -1) AS last_{t}_us"
    for t in S.ACTIVITY_TYPES)


@query("p3_p4_rolling_activity", f"SELECT p.event_id, p.user_id, p.us, {_ROLL} FROM act p")
def _(spark, d):
    a = X.activity(spark, d)
    out = S.rolling_activity(a.select("event_id", "user_id", "us"), a, ["user_id"])
    return out.fillna(-1, [f"last_{t}_us" for t in S.ACTIVITY_TYPES])


@query("p3_site_counters_365d", f"""
SELECT p.event_id, p.site_id, (SELECT count(*) FROM ints a WHERE a.site_id = p.site_id AND a.us >= p.us - {365 * US_PER_DAY} AND a.us < p.us) AS n_before
FROM ints p""")
def _(spark, d):
    from ..operators.prefix import window_state_at
    i = X.interactions(spark, d)
    return window_state_at(i.select("event_id", "site_id", "us"), i, ["site_id"],
                           {"n_before": F.lit(1).cast("long")}, window_us=365 * US_PER_DAY).select(
        "event_id", "site_id", "n_before")


@query("p5_active_users", f"""
SELECT user_id, count(*) AS n_activity, max(us) AS last_us FROM ev
WHERE us >= {X.TEST_START_US - WEEK} AND us < {X.TEST_START_US} GROUP BY 1""")
def _(spark, d):
    return S.active_ids(X.activity(spark, d), X.TEST_START_US)


for _by in ("last_us", "n_activity"):
    @query(f"p6_leaderboard_by_{_by}", f"""
    SELECT site_id, count(*) AS n_activity, max(us) AS last_us FROM ev
    WHERE us >= {X.TEST_START_US - WEEK} AND us < {X.TEST_START_US} GROUP BY 1 ORDER BY {_by} DESC, site_id LIMIT 25""")
    def _(spark, d, _by=_by):
        return S.leaderboard(S.active_ids(X.activity(spark, d), X.TEST_START_US, "site_id"), _by, "site_id", 25)


@query("p7_first_update", "SELECT user_id, min(us) AS first_update_us FROM journals GROUP BY 1")
def _(spark, d):
    return S.first_update(X.journals(spark, d))


@query("p8_degrees_at_initiation", """
SELECT i.event_id, i.user_id, (SELECT count(*) FROM edges e WHERE e.dst = i.user_id AND e.edge_us < i.us) AS indegree,
(SELECT count(*) FROM edges e WHERE e.src = i.user_id AND e.edge_us < i.us) AS outdegree FROM inits i""")
def _(spark, d):
    w = World.of(spark, d)
    return G.degrees_at(w.inits.select("event_id", "user_id", "us"), w.edges).drop("us")


@query("j3_edges", "SELECT src, dst, edge_us FROM edges")
def _(spark, d):
    w = World.of(spark, d)
    return w.edges


@query("j3_edges_without_self", "SELECT src, dst, edge_us FROM edges WHERE src <> dst")
def _(spark, d):
    w = World.of(spark, d)
    return G.edges(w.inits, w.usps, drop_self_edges=True)




def _component_sql(at):
    # label propagation written as a fixed number of relaxations would not be exact, so the twin
    # takes the reachability closure over community-level edges of the snapshot
    return f"""
WITH u AS (SELECT src AS a, dst AS b FROM edges WHERE edge_us < {at} UNION SELECT dst, src FROM edges WHERE edge_us < {at}),
reach(node, other) AS (SELECT a, a FROM u UNION SELECT r.node, u.b FROM reach r JOIN u ON u.a = r.other),
lab AS (SELECT node, min(other) AS component, count(*) AS component_size FROM reach GROUP BY 1)
SELECT node, component, component_size FROM lab"""


@query("p9_components_snapshot", _component_sql(X.DAY0_US + 2 * US_PER_DAY))
def _(spark, d):
    w = World.of(spark, d)
    return G.components_at(w.edges, X.DAY0_US + 2 * US_PER_DAY)


@query("p9_components_at_daily_cutoffs", f"""
WITH cuts AS (SELECT range * {US_PER_DAY} + {X.DAY0_US} AS us FROM range(1, 31)),
u AS (SELECT c.us, src AS a, dst AS b FROM edges, cuts c WHERE edge_us < c.us UNION SELECT c.us, dst, src FROM edges, cuts c WHERE edge_us < c.us),
reach(us, node, other) AS (SELECT us, a, a FROM u UNION SELECT r.us, r.node, u.b FROM reach r JOIN u ON u.a = r.other AND u.us = r.us),
people AS (SELECT DISTINCT user_id FROM ev)
SELECT p.user_id AS node, c.us, coalesce(min(r.other), p.user_id) AS component, greatest(count(r.other), 1) AS component_size
FROM people p CROSS JOIN cuts c LEFT JOIN reach r ON r.node = p.user_id AND r.us = c.us GROUP BY 1, 2""")
def _(spark, d):
    w = World.of(spark, d)
    days = F.sequence(F.lit(1), F.lit(30))
    wanted = X.events(spark, d).select(F.col("user_id").alias("node")).distinct().select(
        "node", F.explode(days).alias("day")).select("node", (F.lit(X.DAY0_US) + F.col("day") * F.lit(US_PER_DAY)).alias("us"))
    return G.components_at_times(w.edges, wanted)


_PAIRS = "pairs AS (SELECT DISTINCT metadata_id, us, source, cand_user FROM cand)"


@query("p10_same_component", f"""
WITH {_PAIRS}, ts AS (SELECT DISTINCT us FROM pairs),
u AS (SELECT c.us, src AS a, dst AS b FROM edges, ts c WHERE edge_us < c.us UNION SELECT c.us, dst, src FROM edges, ts c WHERE edge_us < c.us),
reach(us, node, other) AS (SELECT DISTINCT p.us, p.source, p.source FROM pairs p UNION SELECT r.us, r.node, u.b FROM reach r JOIN u ON u.a = r.other AND u.us = r.us)
SELECT p.metadata_id, p.source, p.cand_user, CASE WHEN r.other IS NULL THEN 0 ELSE 1 END AS is_weakly_connected
FROM pairs p LEFT JOIN reach r ON r.us = p.us AND r.node = p.source AND r.other = p.cand_user""")
def _(spark, d):
    w = World.of(spark, d)
    return w.flagged_pairs("is_weakly_connected")


_HOPS = """hop AS (SELECT src, dst, edge_us AS t FROM edges UNION ALL
  SELECT a.src, b.dst, greatest(a.edge_us, b.edge_us) FROM edges a JOIN edges b ON a.dst = b.src),
hops AS (SELECT src, dst, min(t) AS t FROM hop GROUP BY 1, 2)"""


@query("p11_mutual_fof", f"""
WITH {_PAIRS}, {_HOPS}
SELECT p.metadata_id, p.source, p.cand_user, CASE WHEN f.t < p.us AND b.t < p.us THEN 1 ELSE 0 END AS is_mutual_fof
FROM pairs p LEFT JOIN hops f ON f.src = p.source AND f.dst = p.cand_user
LEFT JOIN hops b ON b.src = p.cand_user AND b.dst = p.source""")
def _(spark, d):
    w = World.of(spark, d)
    return w.flagged_pairs("is_mutual_fof")


@query("p12_reciprocal", f"""
WITH {_PAIRS} SELECT p.metadata_id, p.source, p.cand_user, CASE WHEN e.edge_us < p.us THEN 1 ELSE 0 END AS is_reciprocal
FROM pairs p LEFT JOIN edges e ON e.src = p.cand_user AND e.dst = p.source""")
def _(spark, d):
    w = World.of(spark, d)
    return w.flagged_pairs("is_reciprocal")


@query("p15_context_eligibility", """
WITH n AS (SELECT c.metadata_id, c.source, c.target_site, c.us,
 (SELECT count(*) FROM usp_state u WHERE u.user_id = c.source AND u.exist_us < c.us) AS n_source_existing,
 (SELECT count(*) FROM usp_state u WHERE u.user_id = c.source AND u.elig_us < c.us) AS n_source_sites,
 (SELECT count(*) FROM usp_state u WHERE u.site_id = c.target_site AND u.exist_us < c.us) AS n_existing_users_on_target_site,
 (SELECT count(*) FROM usp_state u WHERE u.site_id = c.target_site AND u.elig_us < c.us) AS n_target_users,
 (SELECT count(*) FROM usp_state u WHERE u.site_id = c.target_site AND u.user_id = c.source AND u.elig_us < c.us) AS is_self_initiation
 FROM ctx_all c)
SELECT *, CASE WHEN n_source_existing > 0 THEN 1 ELSE 0 END AS source_user_is_existing,
 CASE WHEN n_source_sites > 0 THEN 1 ELSE 0 END AS source_user_is_eligible,
 CASE WHEN n_target_users > 0 THEN 1 ELSE 0 END AS target_site_has_eligible_user,
 CASE WHEN metadata_id IN (SELECT metadata_id FROM ctx) THEN 1 ELSE 0 END AS is_initiation_eligible
FROM n""")
def _(spark, d):
    w = World.of(spark, d)
    return C.context_eligibility(w.contexts, w.usps)


@query("p16_candidate_counts", f"""
WITH co AS (SELECT DISTINCT c.metadata_id, o.user_id FROM ctx c JOIN usp_state s ON s.user_id = c.source AND s.elig_us < c.us
  JOIN usp_state o ON o.site_id = s.site_id AND o.elig_us < c.us AND o.user_id <> c.source),
el AS (SELECT c.metadata_id, c.us, a.user_id FROM ctx c JOIN (SELECT user_id, min(elig_us) AS e FROM usp_state GROUP BY 1) a ON a.e < c.us AND a.user_id <> c.source
  WHERE NOT EXISTS (SELECT 1 FROM ctx_targets t WHERE t.metadata_id = c.metadata_id AND t.target_user = a.user_id)),
el2 AS (SELECT * FROM el WHERE NOT EXISTS (SELECT 1 FROM co WHERE co.metadata_id = el.metadata_id AND co.user_id = el.user_id))
SELECT c.metadata_id, c.source, c.target_site, c.us,
 (SELECT count(*) FROM edges e WHERE e.src = c.source AND e.edge_us < c.us) AS n_existing_initiations,
 (SELECT count(*) FROM el JOIN co USING (metadata_id, user_id) WHERE el.metadata_id = c.metadata_id) AS n_eligible_coauthors,
 (SELECT count(*) FROM el2 WHERE el2.metadata_id = c.metadata_id) AS n_eligible_users,
 (SELECT count(*) FROM el2 WHERE el2.metadata_id = c.metadata_id AND NOT EXISTS (SELECT 1 FROM ev e WHERE e.user_id = el2.user_id AND e.us >= el2.us - {WEEK} AND e.us < el2.us)) AS n_eligible_inactive_users,
 (SELECT count(*) FROM cand_users q WHERE q.metadata_id = c.metadata_id) AS n_candidate_users,
 (SELECT count(*) FROM cand q WHERE q.metadata_id = c.metadata_id AND q.is_target = 0) AS n_candidate_usps
FROM ctx c""")
def _(spark, d):
    w = World.of(spark, d)
    return C.candidate_counts(w.eligible, w.usps, X.activity(spark, d), w.edges)


@query("p17_target_adjustment", "SELECT metadata_id, target_site, target_user, adjustment FROM tgt_usps")
def _(spark, d):
    w = World.of(spark, d)
    return w.targets.select("metadata_id", "target_site", "target_user", "adjustment")


@query("p18_periods_and_seen_in_train", f"""
WITH p AS (SELECT *, CASE WHEN us < {X.GEN_START_US} THEN 'burn_in' WHEN us < {X.TEST_START_US} THEN 'train' WHEN us <= {X.SPLIT_US} THEN 'validation' ELSE 'test' END AS period FROM inits)
SELECT event_id, user_id, site_id, period,
 CASE WHEN user_id IN (SELECT user_id FROM p WHERE period = 'train') THEN 1 ELSE 0 END AS user_in_train,
 CASE WHEN site_id IN (SELECT site_id FROM p WHERE period = 'train') THEN 1 ELSE 0 END AS site_in_train FROM p""")
def _(spark, d):
    w = World.of(spark, d)
    return S.seen_in_train(w.inits, X.GEN_START_US, X.TEST_START_US, X.SPLIT_US).select(
        "event_id", "user_id", "site_id", "period", "user_in_train", "site_in_train")


_TRIPLES = f"""prs AS (SELECT c.metadata_id, c.source, c.us, s.site_id AS source_site, t.target_user, t.target_site FROM ctx c JOIN usp_state s ON s.user_id = c.source AND s.elig_us < c.us JOIN tgt_usps t USING (metadata_id)),
alt AS (SELECT metadata_id, cand_user AS alt_user, cand_site AS alt_site, row_number() OVER (PARTITION BY metadata_id ORDER BY cand_user, cand_site) AS i, count(*) OVER (PARTITION BY metadata_id) AS n FROM cand WHERE is_target = 0),
trip AS (SELECT p.metadata_id, p.source, p.target_site, p.us, p.source_site, p.target_user, a.alt_user, a.alt_site FROM prs p JOIN alt a ON a.metadata_id = p.metadata_id
 AND a.i = {draw_sql(7, "p.metadata_id", "p.source_site", "p.target_user", "p.target_site")} % a.n + 1)"""


@query("p19_negative_sampling", f"WITH {_TRIPLES} SELECT * FROM trip")
def _(spark, d):
    w = World.of(spark, d)
    return w.triples


@query("p20_triples_from_test_contexts", f"WITH {_TRIPLES} SELECT * FROM trip t WHERE us >= {X.TEST_START_US}" + "".join(
    f" AND (SELECT count(*) FROM journals j WHERE j.user_id = t.{u} AND j.site_id = t.{s} AND j.us <= t.us) >= 3"
    for u, s in (("source", "source_site"), ("target_user", "target_site"), ("alt_user", "alt_site"))))
def _(spark, d):
    """Triples of the test period whose three pairs each have three updates before the context."""
    w = World.of(spark, d)
    t = w.triples.filter(F.col("us") >= X.TEST_START_US)
    j = X.journals(spark, d)
    for u, s in (("source", "source_site"), ("target_user", "target_site"), ("alt_user", "alt_site")):
        seen = j.select(F.col("user_id").alias(u), F.col("site_id").alias(s), F.col("us"))
        t = S.state_at(t, seen, [u, s], {"_n": ("sum", F.lit(1).cast("long"))}, inclusive=True).filter("_n >= 3").drop("_n")
    return t


@query("p21_pointwise_rows", f"""WITH {_TRIPLES} SELECT metadata_id, source, source_site, us, target_user AS user_id, target_site AS site_id, CAST(1 AS BIGINT) AS label FROM trip
UNION ALL SELECT metadata_id, source, source_site, us, alt_user, alt_site, 0 FROM trip""")
def _(spark, d):
    return C.pointwise(World.of(spark, d).triples)


@query("p22_recent_update_ids", f"""
WITH pts AS (SELECT c.metadata_id, 'source' AS side, c.source AS user_id, s.site_id, c.us FROM ctx c JOIN usp_state s ON s.user_id = c.source AND s.elig_us < c.us
  UNION ALL SELECT metadata_id, 'target', target_user, target_site, us FROM tgt_usps)
SELECT metadata_id, side, user_id, site_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY rn) AS recent_oids FROM (
 SELECT p.*, j.event_id, row_number() OVER (PARTITION BY p.metadata_id, p.side, p.user_id, p.site_id ORDER BY j.us DESC) AS rn
 FROM pts p JOIN journals j ON j.user_id = p.user_id AND j.site_id = p.site_id AND j.us < p.us) WHERE rn <= 3 GROUP BY 1, 2, 3, 4""")
def _(spark, d):
    w = World.of(spark, d)
    ctx = w.eligible
    src = C.source_usps(ctx, w.usps).select(
        "metadata_id", F.lit("source").alias("side"), F.col("source").alias("user_id"), F.col("source_site").alias("site_id"), "us")
    tgt = w.targets.select("metadata_id", F.lit("target").alias("side"), F.col("target_user").alias("user_id"),
                                   F.col("target_site").alias("site_id"), "us")
    last = S.last_k_updates(src.unionByName(tgt), X.journals(spark, d), 3, inclusive=False)
    at = lambda i: F.max(F.when(F.col("pos") == i, F.col("journal_oid").cast("string")))
    return last.groupBy("metadata_id", "side", "user_id", "site_id").agg(
        F.concat_ws(",", at(3), at(2), at(1)).alias("recent_oids"))


@query("p23_coverage_users", f"""
WITH cu AS (SELECT DISTINCT user_id FROM usp_state u WHERE elig_us < {X.TEST_START_US} AND EXISTS (SELECT 1 FROM ev e WHERE e.user_id = u.user_id AND e.us >= {X.TEST_START_US - WEEK} AND e.us < {X.TEST_START_US})),
cc AS (SELECT user_id AS source, {X.TEST_START_US + 12 * HOUR} AS us FROM cu ORDER BY {draw_sql(11, "user_id")}, user_id LIMIT 1000),
el AS (SELECT user_id, min(elig_us) AS e FROM usp_state GROUP BY 1),
pact AS (SELECT DISTINCT user_id FROM ev WHERE us >= {X.TEST_START_US + 12 * HOUR - WEEK} AND us < {X.TEST_START_US + 12 * HOUR}),
co AS (SELECT DISTINCT c.source, o.user_id FROM cc c JOIN usp_state s ON s.user_id = c.source AND s.elig_us < c.us JOIN usp_state o ON o.site_id = s.site_id AND o.elig_us < c.us AND o.user_id <> c.source),
cg AS (SELECT c.source, e.dst AS user_id FROM cc c JOIN edges e ON e.src = c.source AND e.edge_us < c.us),
ok AS (SELECT c.source, c.us, el.user_id FROM cc c JOIN el ON el.e < c.us AND el.user_id <> c.source ANTI JOIN co ON co.source = c.source AND co.user_id = el.user_id),
n1 AS (SELECT source, count(*) AS n_eligible_users, count(*) FILTER (user_id NOT IN (SELECT user_id FROM pact)) AS n_eligible_inactive_users FROM ok GROUP BY 1),
cd AS (SELECT ok.* FROM ok SEMI JOIN pact USING (user_id) ANTI JOIN cg ON cg.source = ok.source AND cg.user_id = ok.user_id),
n2 AS (SELECT source, count(*) AS n_candidate_users FROM cd GROUP BY 1),
n3 AS (SELECT cd.source, count(*) AS n_candidate_usps FROM cd JOIN usp_state u ON u.user_id = cd.user_id AND u.elig_us < cd.us GROUP BY 1),
n4 AS (SELECT co.source, count(*) AS n_eligible_coauthors FROM co GROUP BY 1),
n5 AS (SELECT source, count(*) AS n_existing_initiations FROM cg GROUP BY 1)
SELECT source AS metadata_id, source, -1 AS target_site, us, coalesce(n_existing_initiations, 0) AS n_existing_initiations, coalesce(n_eligible_coauthors, 0) AS n_eligible_coauthors,
 coalesce(n_eligible_users, 0) AS n_eligible_users, coalesce(n_eligible_inactive_users, 0) AS n_eligible_inactive_users, coalesce(n_candidate_users, 0) AS n_candidate_users, coalesce(n_candidate_usps, 0) AS n_candidate_usps
FROM cc LEFT JOIN n1 USING (source) LEFT JOIN n2 USING (source) LEFT JOIN n3 USING (source) LEFT JOIN n4 USING (source) LEFT JOIN n5 USING (source)""")
def _(spark, d):
    w = World.of(spark, d)
    u, a = w.usps, X.activity(spark, d)
    users = C.coverage_users(u, a, X.TEST_START_US)
    ctx = C.targetless_contexts(users, X.TEST_START_US + 12 * HOUR)
    return C.candidate_counts(ctx, u, a, w.edges)


@query("p24_prediction_contexts", f"""
WITH m AS (SELECT max(us) + {6 * HOUR} AS at FROM ev), wanted AS (SELECT DISTINCT user_id FROM ev UNION SELECT user_id + 1000000000 FROM ev)
SELECT w.user_id, CASE WHEN max(CASE WHEN u.elig_us < m.at THEN 1 ELSE 0 END) = 1 THEN 'ok' WHEN max(CASE WHEN u.exist_us < m.at THEN 1 ELSE 0 END) = 1 THEN 'not_eligible' ELSE 'unknown_user' END AS status,
 CAST(coalesce(sum(CASE WHEN u.elig_us < m.at THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_source_sites
FROM wanted w CROSS JOIN m LEFT JOIN usp_state u USING (user_id) GROUP BY 1""")
def _(spark, d):
    w = World.of(spark, d)
    e = X.events(spark, d)
    users = e.select("user_id").distinct()
    asked = users.unionByName(users.select((F.col("user_id") + 1_000_000_000).alias("user_id")))
    at = e.agg((F.max("us") + F.lit(6 * HOUR)).alias("at_us"))
    return C.prediction_contexts(asked, w.usps, at)


@query("p25_restart_segments", f"""
WITH log AS (SELECT *, event_id AS seq, CASE WHEN event_id >= 400 THEN us - 20000000000 * ((event_id + 600) // 1000) ELSE us END AS wus FROM ev),
l AS (SELECT *, lag(wus) OVER (ORDER BY seq) AS p FROM log),
s AS (SELECT *, sum(CASE WHEN wus < p THEN 1 ELSE 0 END) OVER (ORDER BY seq) AS segment FROM l),
z AS (SELECT segment, count(*) AS segment_rows FROM s GROUP BY 1)
SELECT seq, wus AS us, CAST(segment AS BIGINT) AS segment, segment_rows FROM s JOIN z USING (segment)
WHERE segment_rows >= 1000 OR segment = (SELECT max(segment) FROM z)""")
def _(spark, d):
    e = X.events(spark, d)
    log = e.select(F.col("event_id").alias("seq"), F.when(
        F.col("event_id") >= 400, F.col("us") - F.lit(20_000_000_000) * F.floor((F.col("event_id") + 600) / 1000))
        .otherwise(F.col("us")).alias("us"))
    return S.drop_restart_segments(log, 1000)


@query("j1_last3_updates", """
SELECT event_id, user_id, site_id, us, 
 max(CASE WHEN rn = 1 THEN oid ELSE -1 END) AS newest, max(CASE WHEN rn = 2 THEN oid ELSE -1 END) AS second, max(CASE WHEN rn = 3 THEN oid ELSE -1 END) AS third
FROM (SELECT i.*, j.event_id AS oid, row_number() OVER (PARTITION BY i.event_id ORDER BY j.us DESC) AS rn
  FROM ev i JOIN journals j ON j.user_id = i.user_id AND j.site_id = i.site_id AND j.us <= i.us) WHERE rn <= 3 GROUP BY 1, 2, 3, 4""")
def _(spark, d):
    pts = X.events(spark, d).select("event_id", "user_id", "site_id", "us")
    last = S.last_k_updates(pts, X.journals(spark, d))
    at = lambda i: F.max(F.when(F.col("from_newest") == i, F.col("journal_oid")).otherwise(-1))
    return last.withColumn("from_newest", F.least("n_seen", F.lit(3)) - F.col("pos") + 1).groupBy(
        "event_id", "user_id", "site_id", "us").agg(at(1).alias("newest"), at(2).alias("second"), at(3).alias("third"))


@query("j2_visible_updates", """
SELECT i.event_id, count(j.us) AS n_updates_before, coalesce(max(j.us), -1) AS last_update_us
FROM ints i LEFT JOIN journals j ON j.site_id = i.site_id AND j.us < i.us GROUP BY 1""")
def _(spark, d):
    return S.merge_visible(X.interactions(spark, d).select("event_id", "site_id", "us"),
                           X.journals(spark, d), ["site_id"]).select(
        "event_id", "n_updates_before", F.coalesce("last_update_us", F.lit(-1)).alias("last_update_us"))


@query("j2_visible_updates_by_sequence", f"""
WITH a AS (SELECT event_id, site_id, us // {6 * HOUR} AS t, 1 AS point FROM ints UNION ALL SELECT event_id, site_id, us // {6 * HOUR}, 0 FROM journals)
SELECT i.event_id, count(j.t) AS n_updates_before FROM a i LEFT JOIN a j ON j.site_id = i.site_id AND j.point = 0 AND (j.t < i.t OR (j.t = i.t AND j.event_id < i.event_id))
WHERE i.point = 1 GROUP BY 1""")
def _(spark, d):
    """Times known to six hours only: what came before within them is told by the event number."""
    coarse = lambda df: df.select("event_id", "site_id", F.floor(F.col("us") / (6 * HOUR)).cast("long").alias("us"))
    return S.merge_visible(coarse(X.interactions(spark, d)), coarse(X.journals(spark, d)), ["site_id"], ties="sequence").select("event_id", "n_updates_before")


@query("j4_candidates", "SELECT metadata_id, source, target_site, us, cand_user, cand_site, is_target FROM cand")
def _(spark, d):
    w = World.of(spark, d)
    return w.candidate_rows(w.eligible)


@query("j5_pair_frame", """
SELECT c.metadata_id, s.site_id AS source_site, c.cand_user, c.cand_site, CAST(c.is_target AS BIGINT) AS is_target
FROM cand c JOIN usp_state s ON s.user_id = c.source AND s.elig_us < c.us""")
def _(spark, d):
    w = World.of(spark, d)
    return C.context_pairs(w.candidate_rows, w.eligible, w.usps).select("metadata_id", "source_site", "cand_user", "cand_site", "is_target")


@query("j7_required_texts", """
WITH pts AS (SELECT DISTINCT us, cand_user AS user_id, cand_site AS site_id FROM cand UNION SELECT c.us, c.source, s.site_id FROM ctx c JOIN usp_state s ON s.user_id = c.source AND s.elig_us < c.us),
l AS (SELECT p.*, j.event_id AS oid, row_number() OVER (PARTITION BY p.us, p.user_id, p.site_id ORDER BY j.us DESC) AS rn FROM pts p JOIN journals j ON j.user_id = p.user_id AND j.site_id = p.site_id AND j.us <= p.us)
SELECT oid AS journal_oid, count(*) AS n_uses FROM l WHERE rn <= 3 GROUP BY 1""")
def _(spark, d):
    w = World.of(spark, d)
    return C.uses_of_updates(w.eligible, w.usps, w.targets, w.activity, w.edges, w.journals)
