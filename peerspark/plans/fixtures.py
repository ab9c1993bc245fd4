"""Driver tables mapped to the logical tables of a peer-support community.

Communities of ten users share twenty sites; users of even communities also reach the next
community's sites (``k >= 80``), so the user graph has many components at every scale.
``signup``/``purchase`` events are updates, ``click``/``view``/``error`` are
amps/comments/guestbook entries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.prefix import US_PER_DAY

DAY0_US = 1_704_067_200_000_000            # 2024-01-01 UTC
GEN_START_US = DAY0_US + 10 * US_PER_DAY   # contexts start after the burn-in
TEST_START_US = DAY0_US + 20 * US_PER_DAY  # validation and test
SPLIT_US = DAY0_US + 25 * US_PER_DAY       # validation < split <= test
ELIGIBLE_K = 3


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{d}/{name}.parquet")


def micros(c) -> F.Column:
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def events(spark: SparkSession, d: str) -> DataFrame:
    k = F.regexp_extract("props", r"(\d+)", 1).cast("long")
    community = F.floor(F.col("user_id") / 10)
    hop = F.when((k >= 80) & (community % 2 == 0), 1).otherwise(0)
    return table(spark, d, "events").select(
        "event_id", "user_id", "event_type", "value", k.alias("k"),
        ((community + hop) * 20 + k % 20).cast("long").alias("site_id"),
        micros("ts").alias("us"))


def journals(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).filter(F.col("event_type").isin("signup", "purchase")).select(
        "event_id", "user_id", "site_id", "us")


def interactions(spark: SparkSession, d: str) -> DataFrame:
    kind = (F.when(F.col("event_type") == "click", "amp")
            .when(F.col("event_type") == "view", "comment").otherwise("guestbook"))
    return events(spark, d).filter(F.col("event_type").isin("click", "view", "error")).select(
        "event_id", "user_id", "site_id", "us", kind.alias("itype"))


def activity(spark: SparkSession, d: str) -> DataFrame:
    """All events with one activity type each: journal, amp, comment, guestbook."""
    kind = (F.when(F.col("event_type").isin("signup", "purchase"), "journal")
            .when(F.col("event_type") == "click", "amp")
            .when(F.col("event_type") == "view", "comment").otherwise("guestbook"))
    return events(spark, d).select("event_id", "user_id", "site_id", "us", kind.alias("atype"))


def sites(spark: SparkSession, d: str) -> DataFrame:
    """Site table derived from events; attributes follow from the site id."""
    s = F.col("site_id")
    return events(spark, d).groupBy("site_id").agg(
        F.count(F.lit(1)).alias("visits"),
        F.sum(F.when(F.col("event_type").isin("signup", "purchase"), 1).otherwise(0)).alias("num_journals"),
        F.min("us").alias("created_us"),
        F.max(F.when(F.col("event_type").isin("signup", "purchase"), F.col("us"))).alias("last_update_us"),
    ).select(
        "*", F.concat(F.lit("name"), (s % 150).cast("string")).alias("name"),
        F.when(s % 41 == 0, 1).otherwise(0).alias("is_spam"),
        F.when(s % 13 == 0, "1").otherwise("0").alias("is_deleted"),
        F.when(s % 7 == 0, "high").otherwise("low").alias("privacy"),
        F.when(s % 17 == 0, "0").otherwise("1").alias("is_searchable"),
        F.when(s % 19 == 0, "0").otherwise("1").alias("is_googleable"))


def rec_batches(spark: SparkSession, d: str) -> DataFrame:
    """Four weekly batches of five sites per user, as nested rows; no site repeats for a user."""
    home = F.floor(F.col("user_id") / 10) * 20
    site = lambda i: (home + (F.col("user_id") * 3 + F.col("batch_id") * 5 + i) % 20).cast("long")
    return (events(spark, d).select("user_id").distinct()
            .withColumn("batch_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
            .select(F.col("user_id").alias("participant_id"), "batch_id",
                    (F.lit(DAY0_US) + F.col("batch_id") * F.lit(7 * US_PER_DAY)).alias("sent_us"),
                    F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.struct(
                        site(i).alias("site_id"),
                        F.when(F.col("batch_id") < 2, F.concat(F.lit("t"), site(i).cast("string")))
                        .alias("journal_title"),
                        F.when(F.col("batch_id") >= 2, F.concat(F.lit("t"), site(i).cast("string")))
                        .alias("cleaned_journal_title"))).alias("sse_site_list")))


def recommendations(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.reshape import explode_batches
    return explode_batches(rec_batches(spark, d))


# The same mapping in SQL, kept as plain as possible: joins and windows over whole keys.
PRELUDE = f"""WITH ev AS (
  SELECT event_id, user_id, event_type, value, k, us,
         CAST((user_id // 10 + CASE WHEN k >= 80 AND (user_id // 10) % 2 = 0 THEN 1 ELSE 0 END) * 20 + k % 20 AS BIGINT) AS site_id
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, epoch_us(ts) AS us FROM events)),
journals AS (SELECT event_id, user_id, site_id, us FROM ev WHERE event_type IN ('signup','purchase')),
ints AS (SELECT event_id, user_id, site_id, us,
         CASE event_type WHEN 'click' THEN 'amp' WHEN 'view' THEN 'comment' ELSE 'guestbook' END AS itype
         FROM ev WHERE event_type IN ('click','view','error')),
act AS (SELECT event_id, user_id, site_id, us,
        CASE WHEN event_type IN ('signup','purchase') THEN 'journal' WHEN event_type = 'click' THEN 'amp'
             WHEN event_type = 'view' THEN 'comment' ELSE 'guestbook' END AS atype FROM ev),
sites AS (SELECT site_id, count(*) AS visits,
          CAST(sum(CASE WHEN event_type IN ('signup','purchase') THEN 1 ELSE 0 END) AS BIGINT) AS num_journals,
          min(us) AS created_us, max(CASE WHEN event_type IN ('signup','purchase') THEN us END) AS last_update_us,
          'name' || CAST(site_id % 150 AS VARCHAR) AS name,
          CASE WHEN site_id % 41 = 0 THEN 1 ELSE 0 END AS is_spam,
          CASE WHEN site_id % 13 = 0 THEN '1' ELSE '0' END AS is_deleted,
          CASE WHEN site_id % 7 = 0 THEN 'high' ELSE 'low' END AS privacy,
          CASE WHEN site_id % 17 = 0 THEN '0' ELSE '1' END AS is_searchable,
          CASE WHEN site_id % 19 = 0 THEN '0' ELSE '1' END AS is_googleable
          FROM ev GROUP BY site_id),
recs AS (SELECT user_id AS participant_id, batch_id, {DAY0_US} + batch_id * {7 * US_PER_DAY} AS sent_us, pos AS rank,
         CAST(user_id // 10 * 20 + (user_id * 3 + batch_id * 5 + pos) % 20 AS BIGINT) AS site_id
         FROM (SELECT DISTINCT user_id FROM ev), (SELECT range AS batch_id FROM range(4)), (SELECT range AS pos FROM range(5))),
usp_state AS (
  SELECT user_id, site_id, min(us) AS exist_us, min(CASE WHEN rn = {ELIGIBLE_K} THEN us END) AS elig_us, count(*) AS n_updates
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id, site_id ORDER BY us, event_id) AS rn FROM journals)
  GROUP BY user_id, site_id),
inits AS (SELECT user_id, site_id, us, event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, site_id ORDER BY us, event_id) AS rn FROM ints) WHERE rn = 1),
edges AS (SELECT i.user_id AS src, j.user_id AS dst, min(greatest(i.us, j.exist_us)) AS edge_us
          FROM inits i JOIN usp_state j USING (site_id) GROUP BY 1, 2),
ctx_all AS (SELECT event_id AS metadata_id, user_id AS source, site_id AS target_site, us FROM inits WHERE us >= {GEN_START_US}),
ctx_targets AS (SELECT c.metadata_id, c.us, c.target_site, u.user_id AS target_user FROM ctx_all c JOIN usp_state u
                ON u.site_id = c.target_site AND u.elig_us < c.us),
ctx AS (SELECT * FROM ctx_all c
        WHERE EXISTS (SELECT 1 FROM usp_state u WHERE u.user_id = c.source AND u.elig_us < c.us)
          AND EXISTS (SELECT 1 FROM ctx_targets t WHERE t.metadata_id = c.metadata_id)
          AND NOT EXISTS (SELECT 1 FROM ctx_targets t WHERE t.metadata_id = c.metadata_id AND t.target_user = c.source)),
cand_users AS (SELECT c.metadata_id, c.us, c.source, c.target_site, a.user_id AS cand_user
   FROM ctx c JOIN (SELECT user_id, min(elig_us) AS elig_us FROM usp_state GROUP BY user_id) a ON a.elig_us < c.us AND a.user_id <> c.source
   WHERE EXISTS (SELECT 1 FROM ev e WHERE e.user_id = a.user_id AND e.us >= c.us - {7 * US_PER_DAY} AND e.us < c.us)
     AND NOT EXISTS (SELECT 1 FROM ctx_targets t WHERE t.metadata_id = c.metadata_id AND t.target_user = a.user_id)
     AND NOT EXISTS (SELECT 1 FROM usp_state s JOIN usp_state o USING (site_id) WHERE s.user_id = c.source AND s.elig_us < c.us
                     AND o.user_id = a.user_id AND o.elig_us < c.us)
     AND NOT EXISTS (SELECT 1 FROM edges g WHERE g.src = c.source AND g.dst = a.user_id AND g.edge_us < c.us)),
tgt_active AS (SELECT t.*, EXISTS (SELECT 1 FROM ev e WHERE e.user_id = t.target_user AND e.us >= t.us - {7 * US_PER_DAY} AND e.us < t.us) AS is_active,
               (SELECT min(us) FROM journals j WHERE j.user_id = t.target_user) AS first_us
               FROM ctx_targets t WHERE metadata_id IN (SELECT metadata_id FROM ctx)),
tgt_usps AS (SELECT metadata_id, us, target_site, target_user, adjustment FROM (
   SELECT *, CASE WHEN us < {TEST_START_US} THEN 'train' WHEN n_act > 0 THEN 'none' WHEN n = 1 THEN 'forced_only_user' ELSE 'forced_most_recent_user' END AS adjustment,
          row_number() OVER (PARTITION BY metadata_id ORDER BY first_us DESC, target_user) AS rn
   FROM (SELECT *, sum(CASE WHEN is_active THEN 1 ELSE 0 END) OVER (PARTITION BY metadata_id) AS n_act, count(*) OVER (PARTITION BY metadata_id) AS n FROM tgt_active))
   WHERE us < {TEST_START_US} OR (n_act > 0 AND is_active) OR (n_act = 0 AND rn = 1)),
cand AS (SELECT c.metadata_id, c.us, c.source, c.target_site, c.cand_user, u.site_id AS cand_site, 0 AS is_target
         FROM cand_users c JOIN usp_state u ON u.user_id = c.cand_user AND u.elig_us < c.us
         UNION ALL
         SELECT c.metadata_id, c.us, c.source, c.target_site, t.target_user, t.target_site, 1
         FROM ctx c JOIN tgt_usps t USING (metadata_id))
"""
