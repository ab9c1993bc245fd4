"""Queries over sources, sinks, cleaning and reshaping."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.draws import draw_sql
from ..operators import prep as P, reshape as R
from ..operators.prefix import US_PER_DAY, running_number
from ..session import cut_lineage, ensure_checkpoint_dir
from ..sources import sinks, tables
from . import fixtures as X
from .registry import query
from .state import World

DAY, H = US_PER_DAY, 3_600_000_000
LO, HI = X.DAY0_US + DAY, X.DAY0_US + 27 * DAY
_RAWJ = "rj AS (SELECT event_id, user_id, site_id, us, CASE WHEN k % 50 = 7 THEN NULL ELSE us END AS published_us, value >= 5 AS is_nontrivial, k % 31 = 3 AS is_deleted FROM ev WHERE event_type IN ('signup', 'purchase'))"
_RAWI = "ri AS (SELECT event_id, user_id, site_id, us, CASE event_type WHEN 'click' THEN 'amp_' || (k % 3) WHEN 'view' THEN 'comment' ELSE 'guestbook' END AS itype FROM ev WHERE event_type IN ('click', 'view', 'error'))"
_OKU = "(SELECT DISTINCT user_id FROM usp_state WHERE elig_us IS NOT NULL)"
_OKS = "(SELECT site_id FROM sites WHERE is_spam = 0)"


def raw_journals(spark, d):
    e = X.events(spark, d).filter(F.col("event_type").isin("signup", "purchase"))
    return e.select("event_id", "user_id", "site_id", "us", F.when(F.col("k") % 50 != 7, F.col("us")).alias("published_us"),
                    (F.col("value") >= 5).alias("is_nontrivial"), (F.col("k") % 31 == 3).alias("is_deleted"))


def raw_interactions(spark, d):
    e = X.events(spark, d).filter(F.col("event_type").isin("click", "view", "error"))
    return e.select("event_id", "user_id", "site_id", "us", F.when(F.col("event_type") == "click", F.concat(
        F.lit("amp_"), (F.col("k") % 3).cast("string"))).when(F.col("event_type") == "view", "comment").otherwise("guestbook").alias("itype"))


def valid_ids(spark, d):
    users = World.of(spark, d).usps.filter("elig_us IS NOT NULL").select("user_id").distinct()
    return users, X.sites(spark, d).filter("is_spam = 0").select("site_id")


# ---- sources and sinks

@query("io1_load_tables", "SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 2) AS c_acctbal, c_mktsegment FROM customer")
def _(spark, d):
    """The customer table through a positional tab-separated copy and back."""
    src = tables.load_table(spark, f"{d}/customer.parquet")
    path = _scratch(spark, "io1")
    src.write.mode("overwrite").csv(path, sep="\t")
    return tables.load_table(spark, path, "tsv", src.schema, header=False).withColumn("c_acctbal", F.round("c_acctbal", 2))


def _scratch(spark, prefix):
    """Fresh path for an intermediate table in the shared folder that holds the checkpoints."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{prefix}-{uuid.uuid4().hex}"


@query("io2_json_lines", """
SELECT 'good' AS kind, count(*) AS n FROM ev WHERE k % 17 <> 0 AND k % 19 <> 0 UNION ALL SELECT 'lines', count(*) FROM ev
UNION ALL SELECT 'malformed', count(*) FROM ev WHERE k % 17 = 0 UNION ALL SELECT 'without_id', count(*) FROM ev WHERE k % 17 <> 0 AND k % 19 = 0""")
def _(spark, d):
    e = X.events(spark, d)
    line = F.to_json(F.struct(F.when(F.col("k") % 19 != 0, F.col("event_id")).alias("id"), "user_id", "event_type"))
    lines = e.select(F.when(F.col("k") % 17 == 0, F.concat(F.lit("{broken "), line)).otherwise(line).alias("value"))
    good, report = tables.split_json_lines(lines, "id long, user_id long, event_type string", "id")
    r = report.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("n")) for k, c in (
        ("lines", "n_lines"), ("malformed", "n_malformed"), ("without_id", "n_without_id"))])))
    return r.unionByName(good.agg(F.count("*").alias("n")).select(F.lit("good").alias("kind"), "n"))


@query("io3_context_types", f"""WITH f AS (SELECT event_id, CASE WHEN us >= {X.TEST_START_US} THEN 1 ELSE 0 END AS t, CASE WHEN k % 3 > 0 THEN 1 ELSE 0 END AS e, CASE WHEN k % 4 > 0 THEN 1 ELSE 0 END AS h FROM ev)
SELECT event_id, CASE WHEN t = 1 AND e = 1 AND h = 1 THEN 'test' WHEN t = 1 AND e = 1 AND h = 0 THEN 'predict' WHEN t = 0 AND e = 1 AND h = 1 THEN 'train' WHEN e = 0 THEN 'ineligible' ELSE 'other' END AS type FROM f""")
def _(spark, d):
    e = X.events(spark, d).select("event_id", (F.col("us") >= X.TEST_START_US).cast("int").alias("is_test_period"),
                                  (F.col("k") % 3 > 0).cast("int").alias("is_initiation_eligible"), (F.col("k") % 4 > 0).cast("int").alias("has_target"))
    return e.select("event_id", tables.context_type().alias("type"))


_NV = "(SELECT count(*) FROM embeddings)"


def vectors(spark, d):
    e = X.table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("feature_id"), F.col("embedding").alias("vec"))


def with_vec_count(df, vec):
    return df.join(F.broadcast(vec.agg(F.count("*").alias("_nv"))), F.lit(True))


@query("io4_triples_with_vectors", f"""WITH t AS (SELECT event_id, event_id % {_NV} AS a, (event_id * 3 + 1) % {_NV} AS b, (event_id * 7 + 2) % ({_NV} + 1) AS c FROM ev)
SELECT event_id, round(CAST(x.embedding[1] AS DOUBLE), 6) AS a0, round(CAST(y.embedding[2] AS DOUBLE), 6) AS b1, round(CAST(coalesce(z.embedding[3], -9) AS DOUBLE), 6) AS c2 FROM t LEFT JOIN embeddings x ON x.vec_id = a LEFT JOIN embeddings y ON y.vec_id = b LEFT JOIN embeddings z ON z.vec_id = c""")
def _(spark, d):
    v = vectors(spark, d)
    e = with_vec_count(X.events(spark, d).select("event_id"), v)
    t = e.select("event_id", F.pmod("event_id", "_nv").alias("a"), F.pmod(F.col("event_id") * 3 + 1, F.col("_nv")).alias("b"),
                 F.pmod(F.col("event_id") * 7 + 2, F.col("_nv") + 1).alias("c"))
    place = lambda i: F.get("vec", F.lit(i))
    j = tables.attach_vectors(t, v, {"a": "av", "b": "bv", "c": "cv"}, {"a": place(0), "b": place(1), "c": place(2)})
    at = lambda c: F.round(F.coalesce(c, F.lit(-9)).cast("double"), 6)
    return j.select("event_id", at("av").alias("a0"), at("bv").alias("b1"), at("cv").alias("c2"))


@query("io5_context_matrices", f"""WITH c AS (SELECT event_id % {_NV} AS vid, count(*) AS n FROM journals GROUP BY 1), m AS (SELECT vec_id, n, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM c JOIN embeddings ON vec_id = vid)
SELECT vec_id, CAST(n AS BIGINT) AS n, CAST(i // 16 AS BIGINT) AS matrix_row, round(sum(CAST(x AS DOUBLE)), 5) AS row_sum FROM m GROUP BY 1, 2, 3""")
def _(spark, d):
    v = vectors(spark, d)
    j = with_vec_count(X.journals(spark, d), v).groupBy(F.pmod("event_id", "_nv").alias("a")).agg(F.count("*").alias("n"))
    m = tables.check_vectors(tables.attach_vectors(j, v, {"a": "vec"}), {"vec": 64})
    return m.select(F.col("a").alias("vec_id"), "n", F.posexplode("vec").alias("i", "x")).groupBy(
        "vec_id", "n", F.floor(F.col("i") / 16).cast("long").alias("matrix_row")).agg(F.round(F.sum(F.col("x").cast("double")), 5).alias("row_sum"))


@query("io5_point_lookup", "SELECT vec_id, label, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings, (SELECT max(vec_id) AS m FROM embeddings) WHERE vec_id IN (m, m // 2, 0)")
def _(spark, d):
    """Three vectors by id, out of a table bucketed by it."""
    v = X.table(spark, d, "embeddings")
    name = f"vectors_{uuid.uuid4().hex[:12]}"
    sinks.write_lookup(v, name, _scratch(spark, "lookup"), "vec_id", 32)
    most = spark.table(name).agg(F.max("vec_id")).first()[0]
    return tables.lookup(spark, name, "vec_id", sorted({most, most // 2, 0})).select(
        "vec_id", "label", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@query("io6_append_with_ids", "SELECT row_number() OVER (ORDER BY CASE event_type WHEN 'view' THEN 0 ELSE 1 END, event_id) - 1 AS metadata_id, event_id FROM ev WHERE event_type IN ('view', 'error')")
def _(spark, d):
    path = _scratch(spark, "io6")
    e = X.events(spark, d).select("event_id", "event_type")
    for i, kind in enumerate(("view", "error")):
        sinks.append_batch(e.filter(F.col("event_type") == kind), path, "event_id", "metadata_id", i)
    return spark.read.parquet(path).select("metadata_id", "event_id")


@query("io7_vector_dedup", """WITH v AS (SELECT vec_id, list_transform(embedding[1:3], lambda x: CAST(floor(x * 4) AS INTEGER)) AS q FROM embeddings), g AS (SELECT q, min(vec_id) AS f, count(*) AS n FROM v GROUP BY 1),
r AS (SELECT q, n, row_number() OVER (ORDER BY f) - 1 AS feature_id FROM g) SELECT vec_id, feature_id, n AS n_uses FROM v JOIN r USING (q)""")
def _(spark, d):
    q = F.transform(F.slice("embedding", 1, 3), lambda x: F.floor(x * 4).cast("int"))
    v = X.table(spark, d, "embeddings").select("vec_id", q.alias("q"))
    dic, m = sinks.dedup_vectors(v, "vec_id", "q")
    return m.join(dic.select("feature_id", "n_uses"), "feature_id")


@query("io8_orphan_cleanup", f"""WITH c AS (SELECT user_id % {_NV} AS a, event_type FROM ev) SELECT vec_id AS feature_id FROM embeddings WHERE vec_id IN (SELECT a FROM c WHERE event_type <> 'click')""")
def _(spark, d):
    v = vectors(spark, d)
    c = with_vec_count(X.events(spark, d), v).select(F.pmod("user_id", "_nv").alias("a"), F.col("event_type").alias("type"))
    return sinks.drop_orphans(c, v, ["a"], "click")[1].select("feature_id")


@query("io8_overwrite_in_place", "SELECT event_type, event_id, CASE WHEN event_type = 'view' THEN value + 1 ELSE value END AS value FROM ev WHERE event_type <> 'error'")
def _(spark, d):
    """A table by event type: written, then one part recomputed from itself and one removed."""
    e = X.events(spark, d).select("event_type", "event_id", "value")
    kept = sinks.PartTable(spark, _scratch(spark, "parts"), "event_type")
    kept.overwrite(e)
    kept.overwrite(kept.read(e.schema).filter("event_type = 'view'").withColumn("value", F.col("value") + 1), drop=["error"])
    return kept.read(e.schema)


@query("io9_latest_wins", """WITH f AS (SELECT CASE WHEN k % 23 = 0 THEN NULL ELSE user_id * 100 + k END AS metadata_id, CASE WHEN event_type IN ('view', 'click') THEN 0 ELSE 1 END AS file_seq, event_id, value FROM ev)
SELECT metadata_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY metadata_id ORDER BY file_seq DESC, event_id DESC) AS rn FROM f WHERE metadata_id IS NOT NULL) WHERE rn = 1""")
def _(spark, d):
    f = X.events(spark, d).select(F.when(F.col("k") % 23 != 0, F.col("user_id") * 100 + F.col("k")).alias("metadata_id"),
                                  F.when(F.col("event_type").isin("view", "click"), 0).otherwise(1).alias("file_seq"),
                                  F.col("event_id").alias("line_no"), "event_id", "value")
    return tables.latest_wins(f)


# ---- cleaning

@query("f1_published_updates", f"WITH {_RAWJ} SELECT event_id, published_us FROM rj WHERE is_nontrivial AND published_us BETWEEN {LO} AND {HI}")
def _(spark, d):
    return P.published_updates(raw_journals(spark, d), LO, HI).select("event_id", "published_us")


@query("f2_trimmed_interactions", f"WITH {_RAWI} SELECT event_id, us, CASE WHEN itype LIKE 'amp%' THEN 'amp' ELSE itype END AS itype FROM ri WHERE us BETWEEN {LO} AND {HI} ORDER BY us")
def _(spark, d):
    return P.trim_interactions(raw_interactions(spark, d), LO, HI).select("event_id", "us", "itype").sort("us")


@query("f3_validity_counts", f"""WITH {_RAWI}, f AS (SELECT itype, user_id IN {_OKU} AS u, site_id IN {_OKS} AS s FROM ri)
SELECT itype, CAST(sum(CASE WHEN u AND s THEN 1 ELSE 0 END) AS BIGINT) AS n_both, CAST(sum(CASE WHEN u AND NOT s THEN 1 ELSE 0 END) AS BIGINT) AS n_user_only, CAST(sum(CASE WHEN NOT u AND s THEN 1 ELSE 0 END) AS BIGINT) AS n_site_only, CAST(sum(CASE WHEN NOT u AND NOT s THEN 1 ELSE 0 END) AS BIGINT) AS n_neither FROM f GROUP BY 1""")
def _(spark, d):
    return P.validity_counts(P.validity_flags(raw_interactions(spark, d), *valid_ids(spark, d)), "itype")


@query("f4_user_or_site_valid", f"WITH {_RAWI} SELECT event_id FROM ri WHERE user_id IN {_OKU} OR site_id IN {_OKS}")
def _(spark, d):
    return P.keep_valid(raw_interactions(spark, d), *valid_ids(spark, d), both=False).select("event_id")


@query("f5_valid_author_updates", f"SELECT event_id FROM journals WHERE user_id IN {_OKU}")
def _(spark, d):
    return P.updates_by(X.journals(spark, d), valid_ids(spark, d)[0]).select("event_id")


@query("f6_valid_pairs", f"""WITH {_RAWJ} SELECT user_id, site_id, count(*) AS update_count FROM rj WHERE is_nontrivial AND NOT is_deleted AND user_id % 29 <> 5
 AND user_id NOT IN (SELECT user_id FROM rj WHERE site_id IN (SELECT site_id FROM sites WHERE is_spam = 1)) AND site_id NOT IN (SELECT site_id FROM sites WHERE is_deleted = '1') GROUP BY 1, 2""")
def _(spark, d):
    blocked = X.events(spark, d).filter(F.col("user_id") % 29 == 5).select("user_id").distinct()
    return P.valid_pairs(raw_journals(spark, d), X.sites(spark, d), blocked)


@query("f7_legacy_usps", """WITH p AS (SELECT user_id, site_id, count(*) AS n_updates FROM journals GROUP BY 1, 2 HAVING count(*) >= 3),
u AS (SELECT user_id, min(us) AS user_first_us, max(CASE WHEN rn = 3 THEN us END) AS user_kth_us, count(*) AS total_updates FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS rn FROM journals) GROUP BY 1)
SELECT p.*, user_first_us, user_kth_us, total_updates, (SELECT min(us) FROM journals j WHERE j.site_id = p.site_id) AS site_first_us, count(*) OVER (PARTITION BY p.user_id) AS n_valid_sites, count(*) OVER (PARTITION BY p.site_id) AS n_valid_users FROM p JOIN u USING (user_id)""")
def _(spark, d):
    return P.legacy_usp_table(X.journals(spark, d))


@query("f8_site_dedup", "SELECT name, site_id, created_us FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY created_us DESC, site_id) AS rn FROM sites) WHERE rn = 1")
def _(spark, d):
    by_id = P.dedup_first(X.sites(spark, d), "site_id", ["created_us"])
    return P.dedup_first(by_id, "name", [F.col("created_us").desc(), F.col("site_id")]).select("name", "site_id", "created_us")


@query("f9_deactivated", "SELECT site_id, CASE WHEN is_deleted = '1' OR is_spam = 1 THEN 1 ELSE 0 END AS is_deactivated FROM sites")
def _(spark, d):
    return X.sites(spark, d).select("site_id", P.is_deactivated().alias("is_deactivated"))


@query("f10_recommendable_sites", f"SELECT site_id FROM sites WHERE is_deleted <> '1' AND is_spam <> 1 AND privacy = 'low' AND is_googleable = '1' AND is_searchable = '1' AND last_update_us >= {X.DAY0_US + 30 * DAY - 12 * DAY}")
def _(spark, d):
    return P.recommendable_sites(X.sites(spark, d), X.journals(spark, d), X.DAY0_US + 30 * DAY).select("site_id")


@query("f11_object_id_time", "SELECT event_id, us // 1000000 AS generated_s FROM ev")
def _(spark, d):
    oid = F.concat(F.lower(F.lpad(F.hex(F.floor(F.col("us") / 1_000_000)), 8, "0")), F.lpad(F.lower(F.hex("event_id")), 16, "0"))
    return X.events(spark, d).withColumn("oid", oid).select("event_id", P.object_id_seconds("oid").alias("generated_s"))


_OFF = [0, 500, -18_000_000, -21_600_000, -17_999_000, 3_600_000, -2000]


@query("f12_timestamp_audit", f"""WITH t AS (SELECT us // 1000 AS g, us, (us // 1000) + CASE k % 7 {" ".join(f"WHEN {i} THEN {o}" for i, o in enumerate(_OFF))} END - us // 1000 AS d FROM ev)
SELECT us // {7 * DAY} AS week, CASE WHEN d BETWEEN -1000 AND 1000 THEN 'match' WHEN d IN (-18000000, -21600000, -17999000, -21599000) THEN 'utc_offset' ELSE 'other' END AS class, count(*) AS n FROM t GROUP BY 1, 2""")
def _(spark, d):
    ms = F.floor(F.col("us") / 1000)
    off = F.element_at(F.array(*[F.lit(o) for o in _OFF]), (F.col("k") % 7 + 1).cast("int"))
    return X.events(spark, d).groupBy(F.floor(F.col("us") / (7 * DAY)).cast("long").alias("week"),
                                      P.timestamp_audit_class(ms + off, ms).alias("class")).agg(F.count("*").alias("n"))


@query("f13_timezone_shift", f"SELECT event_id, CASE WHEN itype = 'comment' AND us <= {X.TEST_START_US} THEN us + {5 * H} ELSE us END AS fixed_us FROM ints")
def _(spark, d):
    return X.interactions(spark, d).select("event_id", P.shift_until("us", F.col("itype") == "comment", X.TEST_START_US).alias("fixed_us"))


@query("f14_local_dates", f"SELECT event_id, CASE WHEN k % 13 = 0 THEN -1 ELSE us // 1000000 * 1000000 + {6 * H} END AS utc_us, CASE WHEN k % 13 = 0 THEN 'invalid' ELSE 'ok' END AS tag FROM ev")
def _(spark, d):
    text = F.when(F.col("k") % 13 == 0, "-0001-11-30 00:00:00").otherwise(F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd HH:mm:ss"))
    us, tag = P.local_to_us("text")
    return X.events(spark, d).withColumn("text", text).select("event_id", F.coalesce(us, F.lit(-1)).alias("utc_us"), tag.alias("tag"))


_DEL = "dl AS (SELECT * FROM (SELECT i.event_id, i.site_id, i.us, i.us - (SELECT max(us) FROM journals j WHERE j.site_id = i.site_id AND j.us < i.us) AS delay_us FROM ints i WHERE itype = 'amp') WHERE delay_us IS NOT NULL), dq AS (SELECT * FROM dl WHERE delay_us <= (SELECT quantile_cont(delay_us, 0.9) FROM dl))"


def delays(spark, d):
    amps = X.interactions(spark, d).filter("itype = 'amp'").select("event_id", "site_id", "us")
    return P.keep_below_quantile(P.reaction_delays(amps, X.journals(spark, d)), "delay_us")


@query("f15_reaction_delays", f"WITH {_DEL} SELECT event_id, delay_us FROM dq")
def _(spark, d):
    return delays(spark, d).select("event_id", "delay_us")


@query("f16_jitter", f"""WITH {_DEL}, n AS (SELECT delay_us, row_number() OVER (ORDER BY event_id) AS i, count(*) OVER () AS c FROM dq)
SELECT g.event_id, g.us + n.delay_us AS jittered_us FROM ints g JOIN n ON n.i = {draw_sql(19, 'g.event_id')} % n.c + 1 WHERE g.itype = 'guestbook'""")
def _(spark, d):
    rows = X.interactions(spark, d).filter("itype = 'guestbook'").select("event_id", "us")
    return P.jitter(rows, cut_lineage(delays(spark, d))).select("event_id", "jittered_us")


@query("f17_snapshot_diff", f"""WITH o AS (SELECT event_id, us AS created_us, us + 1000000 * (k % 3) AS updated_us FROM ev WHERE k % 10 <> 1), n AS (SELECT event_id, us AS created_us, us + 1000000 * (k % 4) AS updated_us FROM ev WHERE k % 10 <> 2),
j AS (SELECT o.event_id AS oe, n.event_id AS ne, o.created_us AS oc, n.created_us AS nc, o.updated_us AS ou, n.updated_us AS nu FROM o FULL JOIN n USING (event_id)),
l AS (SELECT 'created_us' AS "column", oe, ne, oc AS a, nc AS b FROM j UNION ALL SELECT 'updated_us', oe, ne, ou, nu FROM j)
SELECT "column", CASE WHEN ne IS NULL THEN 'only_old' WHEN oe IS NULL THEN 'only_new' WHEN a = b THEN 'equal' ELSE 'different' END AS state, coalesce(b - a, 0) AS delta_us, count(*) AS n FROM l GROUP BY 1, 2, 3""")
def _(spark, d):
    e = X.events(spark, d)
    ver = lambda keep, m: e.filter(keep).select("event_id", F.col("us").alias("created_us"), (F.col("us") + F.lit(1_000_000) * (F.col("k") % m)).alias("updated_us"))
    return P.snapshot_diff(ver(F.col("k") % 10 != 1, 3), ver(F.col("k") % 10 != 2, 4), "event_id", ["created_us", "updated_us"])


@query("f18_densify", f"SELECT event_id, user_id, site_id, us FROM journals UNION ALL SELECT DISTINCT -1, user_id, site_id, {X.DAY0_US - 1} FROM journals")
def _(spark, d):
    return P.densify(X.journals(spark, d), X.DAY0_US)


# ---- reshaping and validated joins

@query("r1_explode_amps", """WITH p AS (SELECT event_id, site_id, us, k, CASE event_type WHEN 'view' THEN 'comment' WHEN 'error' THEN 'guestbook' WHEN 'signup' THEN 'journal' ELSE 'photo' END AS t FROM ev WHERE event_type <> 'click')
SELECT (k * 7 + i) % 1000 AS user_id, site_id, 'amp' AS interaction_type, t AS parent_type, event_id || '|' || ((k * 7 + i) % 1000) AS interaction_oid, us FROM p, (SELECT range AS i FROM range(3)) WHERE i < k % 4""")
def _(spark, d):
    e = X.events(spark, d)
    amps = F.when(F.col("k") % 4 == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), (F.col("k") % 4 - 1).cast("int")), lambda i: (F.col("k") * 7 + i) % 1000))
    out = None
    for etype, kind in (("view", "comment"), ("error", "guestbook"), ("signup", "journal"), ("purchase", "photo")):
        part = R.explode_amps(e.filter(F.col("event_type") == etype).select(F.col("event_id").alias("parent_oid"), "site_id", "us", amps.alias("amps")), kind)
        out = part if out is None else out.unionByName(part)
    return out


@query("r2_explode_batches", "SELECT participant_id, batch_id, sent_us, rank, site_id, 't' || site_id AS title FROM recs")
def _(spark, d):
    return X.recommendations(spark, d)


@query("r3_duplicate_recommendations", """SELECT user_id AS participant_id, site_id, count(*) AS n_times FROM ev GROUP BY 1, 2 HAVING count(*) > 1""")
def _(spark, d):
    """The duplicate check over every user's site events; over the batches it must be empty (tests)."""
    return R.duplicate_recommendations(X.events(spark, d).select(F.col("user_id").alias("participant_id"), "site_id"))


@query("r4_membership", "SELECT user_id, site_id, count(*) OVER (PARTITION BY user_id) AS n_sites, count(*) OVER (PARTITION BY site_id) AS n_users FROM (SELECT DISTINCT user_id, site_id FROM journals)")
def _(spark, d):
    return R.membership(X.journals(spark, d))


@query("r5_nested_numbers", "SELECT event_id, CASE WHEN k % 5 = 0 THEN -1 ELSE us END AS n FROM ev")
def _(spark, d):
    raw = F.when(F.col("k") % 5 == 0, F.lit(None)).when(F.col("k") % 2 == 0, F.to_json(F.create_map(F.lit("$numberLong"), F.col("us").cast("string")))).otherwise(F.col("us").cast("string"))
    return X.events(spark, d).withColumn("raw", raw).select("event_id", F.coalesce(R.nested_number("raw"), F.lit(-1)).alias("n"))


@query("r6_flatten_guestbook", """SELECT event_id AS guestbook_oid, user_id, site_id, CASE WHEN k % 6 = 0 THEN '' ELSE 'body' || k END AS body, CASE WHEN k % 9 = 0 THEN '' ELSE 'sig' END AS signature, CASE WHEN k % 11 = 0 THEN 0 ELSE us END AS created_us, 0 AS updated_us,
 CASE WHEN k % 4 = 0 THEN 0 ELSE k % 3 END AS n_photos, k % 2 AS n_amps FROM ev WHERE event_type = 'error'""")
def _(spark, d):
    k = F.col("k")
    rep = lambda n, v: F.array_repeat(F.lit(v), n.cast("int"))
    raw = X.events(spark, d).filter("event_type = 'error'").select(
        F.col("event_id").alias("guestbook_oid"), "user_id", "site_id", F.when(k % 6 != 0, F.concat(F.lit("body"), k.cast("string"))).alias("body"),
        F.when(k % 9 != 0, "sig").alias("signature"), F.when(k % 11 != 0, F.to_json(F.create_map(F.lit("$numberLong"), F.col("us").cast("string")))).alias("created_json"),
        F.lit(None).cast("string").alias("updated_json"), F.when(k % 4 != 0, rep(k % 3, "p")).alias("photos"), rep(k % 2, "a").alias("amps"))
    return R.flatten_guestbook(raw)


_R7 = {"all": "true", "early": f"us < {X.GEN_START_US}", "large": "k >= 50"}


@query("r7_wide_counts", "SELECT site_id, " + ", ".join(
    f"CAST(sum(CASE WHEN itype = '{t}' AND {c} THEN 1 ELSE 0 END) AS BIGINT) AS {t}_{n}" for t in ("amp", "comment", "guestbook") for n, c in _R7.items()) + ", " + ", ".join(
    f"CAST(sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS BIGINT) AS total_{n}" for n, c in _R7.items()) + " FROM (SELECT i.*, e.k FROM ints i JOIN ev e USING (event_id)) GROUP BY 1")
def _(spark, d):
    kind = F.when(F.col("event_type") == "click", "amp").when(F.col("event_type") == "view", "comment").otherwise("guestbook")
    rows = X.events(spark, d).filter(F.col("event_type").isin("click", "view", "error")).withColumn("itype", kind)
    return R.wide_counts(rows, "site_id", "itype", ["amp", "comment", "guestbook"],
                         {"all": F.lit(True), "early": F.col("us") < X.GEN_START_US, "large": F.col("k") >= 50})


@query("j6_validated_join", "SELECT event_id, coalesce(c_name, 'none') AS c_name, coalesce(c_mktsegment, 'none') AS c_mktsegment FROM ev LEFT JOIN customer ON c_custkey = user_id * 7")
def _(spark, d):
    c = X.table(spark, d, "customer").select(F.col("c_custkey").alias("key"), "c_name", "c_mktsegment")
    e = X.events(spark, d).select("event_id", (F.col("user_id") * 7).alias("key"))
    return P.join_validated(e, c, ["key"]).select("event_id", *[F.coalesce(x, F.lit("none")).alias(x) for x in ("c_name", "c_mktsegment")])


@query("j8_missing_embeddings", "SELECT event_id FROM journals WHERE event_id % 3000 NOT IN (SELECT vec_id FROM embeddings)")
def _(spark, d):
    v = X.table(spark, d, "embeddings").select("vec_id")
    return X.journals(spark, d).withColumn("vec_id", F.col("event_id") % 3000).join(v, "vec_id", "left_anti").select("event_id")
