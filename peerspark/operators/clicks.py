"""Click, visit and study analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.draws import draw
from ..session import cut_lineage
from .prefix import (DEPTH_ROWS, Depth, US_PER_DAY, US_PER_HOUR, content_bucket, first_k_per_key, prefix_aggregate,
                     running_number, running_total, state_at, time_bucket)

_N = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("long")
_ONE = "*"


def parse_click_log(log: DataFrame) -> DataFrame:
    """CDN rows to clicks: time, query parameters, batch from the campaign suffix, site from the path."""
    q = F.str_to_map(F.col("query_string"), F.lit("&"), F.lit("="))
    campaign = F.element_at(q, F.lit("utm_campaign"))
    parts = F.split(campaign, r"\+")
    return log.filter(F.col("method") == "GET").select(
        "event_id", F.unix_micros(F.to_timestamp(F.concat_ws(" ", "date", "time"))).alias("us"),
        F.coalesce(F.try_element_at(parts, F.lit(3)).try_cast("long"), F.lit(0)).alias("batch_id"),
        F.element_at(q, F.lit("utm_source")).alias("utm_source"),
        F.when(F.col("uri").startswith("/visit/"), F.try_element_at(F.split("uri", "/"), F.lit(3))).alias("site_name"))


def parse_urls(pages: DataFrame, names: list[str]) -> DataFrame:
    """Host, path depth and named query parameters of page addresses."""
    q = F.regexp_extract("url", r"\?([^#]*)", 1)
    m = F.str_to_map(F.when(q != "", q), F.lit("&"), F.lit("="))
    return pages.select("page_id", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"),
                        *[F.coalesce(F.try_element_at(m, F.lit(n)), F.lit("")).alias(n) for n in names])


def reconcile(recs: DataFrame, clicks: DataFrame, visits: DataFrame) -> DataFrame:
    """Class of every recommended, clicked or visited (participant, site)."""
    c = clicks.groupBy(F.col("user_id").alias("participant_id"), "site_id").agg(F.min("us").alias("click_us"))
    v = visits.groupBy(F.col("user_id").alias("participant_id"), "site_id").agg(F.min("us").alias("visit_us"))
    j = recs.join(c, ["participant_id", "site_id"], "full_outer").join(v, ["participant_id", "site_id"], "full_outer")
    has = lambda x: F.col(x).isNotNull()
    return j.withColumn("category", F.when(~has("sent_us") & has("click_us"), "unrelated_click")
                        .when(~has("sent_us"), "unrelated_visit")
                        .when(has("visit_us") & (F.col("visit_us") < F.col("sent_us")), "pre_rec_visit")
                        .when(has("click_us") & has("visit_us"), "both").when(has("click_us"), "click_only")
                        .when(has("visit_us"), "visit_only").otherwise("neither"))


def attribute_clicks(recs: DataFrame, clicks: DataFrame, visits: DataFrame) -> DataFrame:
    """Earliest click after the send, else earliest visit after it, else -1."""
    keyed = recs.select("participant_id", "site_id", "sent_us")
    def first(events: DataFrame, name: str) -> DataFrame:
        e = events.select(F.col("user_id").alias("participant_id"), "site_id", "us")
        return (e.join(keyed, ["participant_id", "site_id"]).filter(F.col("us") >= F.col("sent_us"))
                .groupBy("participant_id", "site_id").agg(F.min("us").alias(name)))
    j = (recs.join(first(clicks, "_c"), ["participant_id", "site_id"], "left")
         .join(first(visits, "_v"), ["participant_id", "site_id"], "left"))
    return j.withColumn("first_click_us", F.coalesce("_c", "_v", F.lit(-1))).withColumn(
        "was_clicked", (F.col("first_click_us") >= 0).cast("long")).drop("_c", "_v")


def time_to_click(clicks: DataFrame, recs: DataFrame) -> DataFrame:
    """Delay from the participant's first send to each click; not positive ones are dropped."""
    sent = recs.groupBy(F.col("participant_id").alias("user_id")).agg(F.min("sent_us").alias("first_sent_us"))
    return clicks.join(sent, "user_id").withColumn("delay_us", F.col("us") - F.col("first_sent_us")).filter(F.col("delay_us") > 0)


def click_rates(attributed: DataFrame) -> DataFrame:
    """Click-through by batch, by participant and overall in one pass over grouping sets."""
    level = F.grouping_id()
    return attributed.cube("batch_id", "participant_id").agg(
        level.alias("gid"), F.count(_ONE).alias("n_recs"), F.sum("was_clicked").alias("n_clicked")
    ).filter(F.col("gid") > 0).select(
        F.when(F.col("gid") == 3, "overall").when(F.col("gid") == 1, "batch").otherwise("participant").alias("level"),
        F.coalesce("batch_id", "participant_id", F.lit(-1)).alias("key"), "n_recs", "n_clicked",
        (F.col("n_clicked") / F.col("n_recs")).alias("ctr"))


def clicks_per_batch(attributed: DataFrame) -> DataFrame:
    """How many participant batches had 0, 1, ... clicks."""
    return (attributed.groupBy("participant_id", "batch_id").agg(F.sum("was_clicked").alias("n_clicks"))
            .groupBy("n_clicks").agg(F.count(_ONE).alias("n_batches"), F.countDistinct("participant_id").alias("n_participants")))


def clicks_per_hour(attributed: DataFrame) -> DataFrame:
    hours = F.floor((F.col("first_click_us") - F.col("sent_us")) / US_PER_HOUR).cast("long")
    return attributed.filter("was_clicked = 1").groupBy(hours.alias("hour")).agg(F.count(_ONE).alias("n_clicks"))


def analysis_conditions(attributed: DataFrame, batch_size: int = 5) -> DataFrame:
    """Recommendations of three analysis conditions: all; of participants who ever clicked; in
    batches with some but not all sites clicked."""
    per_batch = attributed.groupBy("participant_id", "batch_id").agg(F.sum("was_clicked").alias("_n"))
    some = per_batch.filter((F.col("_n") >= 1) & (F.col("_n") < batch_size)).select("participant_id", "batch_id")
    ever = per_batch.filter("_n > 0").select("participant_id").distinct()
    tag = lambda df, c: df.withColumn("condition", F.lit(c))
    return (tag(attributed, "all").unionByName(tag(attributed.join(ever, "participant_id", "left_semi"), "clicking_participants"))
            .unionByName(tag(attributed.join(some, ["participant_id", "batch_id"], "left_semi"), "clicked_batches")))


def reconstruct_visits(diffs: DataFrame, profiles: DataFrame, clicks: DataFrame) -> DataFrame:
    """Distinct visit times per pair: profile creation, both sides of every diff, and clicks."""
    t = lambda df, c: df.select("user_id", "site_id", F.col(c).alias("us")).filter(F.col("us") > 0)
    return (t(profiles, "created_us").unionByName(t(diffs, "old_us")).unionByName(t(diffs, "new_us"))
            .unionByName(t(clicks, "us")).distinct())


def return_visits(visits: DataFrame, hours: list[int]) -> DataFrame:
    """Visits later than the first visit plus h hours, per pair and h."""
    first = visits.groupBy("user_id", "site_id").agg(F.min("us").alias("_first"))
    j = visits.join(first, ["user_id", "site_id"])
    return j.groupBy("user_id", "site_id").agg(
        F.count(_ONE).alias("n_visits"), *[_N(F.col("us") > F.col("_first") + h * US_PER_HOUR).alias(f"n_return_{h}h") for h in hours])


def days_visited(visits: DataFrame, key: str) -> DataFrame:
    return visits.groupBy(key).agg(F.countDistinct(time_bucket("us")).alias("n_days"))


def daily_visitors(visits: DataFrame) -> DataFrame:
    return visits.groupBy(time_bucket("us").alias("day")).agg(
        F.countDistinct("user_id", "site_id").alias("n_usps"), F.countDistinct("user_id").alias("n_users"))


def self_author_flag(profiles: DataFrame, journals: DataFrame) -> DataFrame:
    """Pairs that author their site: creator, primary, organiser, or wrote an update."""
    p = profiles.select("user_id", "site_id", ((F.col("is_creator") == "1") | (F.col("is_primary") == "1")
                                               | (F.col("role") == "Organizer")).cast("long").alias("f"))
    j = journals.select("user_id", "site_id", F.lit(1).cast("long").alias("f"))
    return p.unionByName(j).groupBy("user_id", "site_id").agg(F.max(F.coalesce("f", F.lit(0))).alias("is_self_author"))


def follow_actions(profiles: DataFrame) -> DataFrame:
    """Pairs with at least one notification setting."""
    return profiles.filter(F.size("n") > 0).select("user_id", "site_id").distinct()


def funnel(recs: DataFrame, stages: dict[str, DataFrame]) -> DataFrame:
    """Per stage (pairs that reached it): recommendations, participants and sites, with shares."""
    flagged = recs.select("participant_id", "site_id")
    for name, pairs in stages.items():
        p = pairs.select(F.col("user_id").alias("participant_id"), "site_id", F.lit(1).alias(name)).distinct()
        flagged = flagged.join(p, ["participant_id", "site_id"], "left")
    names = ["recommended", *stages]
    long = flagged.withColumn("recommended", F.lit(1)).select("participant_id", "site_id", F.explode(F.filter(
        F.array(*[F.when(F.col(n) == 1, F.lit(n)) for n in names]), lambda x: x.isNotNull())).alias("stage"))
    out = long.groupBy("stage").agg(F.count(_ONE).alias("n_recs"), F.countDistinct("participant_id").alias("n_participants"),
                                    F.countDistinct("site_id").alias("n_sites"))
    total = out.filter("stage = 'recommended'").select(F.col("n_recs").alias("_t"))
    return out.join(F.broadcast(total), F.lit(True)).withColumn("pct_recs", 100.0 * F.col("n_recs") / F.col("_t")).drop("_t")


def initiation_share(inits: DataFrame, recs: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """Initiations in a window split into study (recommended before) and background, per period."""
    r = recs.select(F.col("participant_id").alias("user_id"), "site_id", "sent_us")
    people = recs.select(F.col("participant_id").alias("user_id")).distinct()
    j = (inits.filter(F.col("us").between(start_us, end_us)).join(people, "user_id", "left_semi")
         .join(r, ["user_id", "site_id"], "left"))
    return j.groupBy(F.coalesce((F.col("us") >= F.col("sent_us")).cast("long"), F.lit(0)).alias("is_study")).agg(
        F.count(_ONE).alias("n_initiations"), F.countDistinct("user_id").alias("n_users"))


def pre_post(points: DataFrame, events: DataFrame, on: str, back_us: int, front_us: int) -> DataFrame:
    """Events in [t - back, t] and [t, t + front] per point, both closed; 0 when none. Points must be distinct.

    Each end of a window is asked for the number of events before it; a window's count is a difference of two."""
    t = F.col("us")
    ends = F.array(*[F.struct(at.cast("long").alias("_at"), F.lit(pre).alias("_pre"), F.lit(post).alias("_post"))
                     for at, pre, post in ((t + 1, 1, 0), (t - back_us, -1, 0), (t + front_us + 1, 0, 1), (t, 0, -1))])
    run = state_at(points.select("*", F.inline(ends)), events, [on], {"_n": ("sum", F.lit(1).cast("long"))}, "_at", depth=DEPTH_ROWS)
    return run.groupBy(*points.columns).agg(F.sum(F.col("_n") * F.col("_pre")).alias("n_pre"), F.sum(F.col("_n") * F.col("_post")).alias("n_post"))


def directed_dyads(comments: DataFrame, recs: DataFrame, authors: DataFrame) -> DataFrame:
    """Comments of participants on recommended sites, and of recommended authors on the
    participant's sites, as (source, target, direction)."""
    c = comments.select("event_id", "user_id", "site_id", "us")
    r = recs.select("participant_id", F.col("site_id").alias("rec_site")).distinct()
    au = authors.select("user_id", "site_id").distinct()
    rec_author = r.join(au.select(F.col("site_id").alias("rec_site"), F.col("user_id").alias("author")), "rec_site").filter(
        F.col("author") != F.col("participant_id")).select("participant_id", "author", "rec_site")
    out = (rec_author.join(c, (c.user_id == F.col("participant_id")) & (c.site_id == F.col("rec_site")))
           .select(F.col("participant_id").alias("source"), F.col("author").alias("target"), F.lit("to_author").alias("direction"), "event_id"))
    own = au.select(F.col("user_id").alias("participant_id"), F.col("site_id").alias("own_site"))
    pairs = rec_author.select("participant_id", "author").distinct()
    back = (pairs.join(c.withColumnsRenamed({"user_id": "author"}), "author")
            .join(own, (own.participant_id == pairs.participant_id) & (own.own_site == F.col("site_id")), "left_semi")
            .select(F.col("author").alias("source"), F.col("participant_id").alias("target"), F.lit("to_participant").alias("direction"), "event_id"))
    return out.unionByName(back).distinct()


def undirected_dyads(dyads: DataFrame) -> DataFrame:
    """Dyad number per unordered user pair and comments by direction. Pairs are counted once; numbering reads them several times."""
    lo, hi = F.least("source", "target"), F.greatest("source", "target")
    per = cut_lineage(dyads.groupBy(lo.alias("user_a"), hi.alias("user_b")).agg(
        _N(F.col("direction") == "to_author").alias("n_to_author"),
        _N(F.col("direction") == "to_participant").alias("n_to_participant"), F.count(_ONE).alias("n_comments")))
    # a user's number of pairs is known before they are ordered, so that one of many pairs is no task of its own
    users = running_total(per.groupBy("user_a").agg(F.count(_ONE).alias("_n")), [], Depth(F.col("user_a"), 64), ["user_a"], "_n", "_before")
    own = running_number(per, ["user_a"], Depth(F.col("user_b"), 64), ["user_b"], "_rn")
    return own.join(users.select("user_a", "_before"), "user_a").withColumn("dyad_id", F.coalesce("_before", F.lit(0)) + F.col("_rn")).drop("_before", "_rn")


def role_labels(comments: DataFrame, authors: DataFrame, participants: DataFrame, rec_sites: DataFrame) -> DataFrame:
    """Author/Visitor of the site, and Participant/Recommended/Other by who comments where."""
    au = authors.select("user_id", "site_id", F.lit(1).alias("_a")).distinct()
    p = participants.select("user_id", F.lit(1).alias("_p")).distinct()
    r = rec_sites.select("site_id", F.lit(1).alias("_r")).distinct()
    j = comments.join(au, ["user_id", "site_id"], "left").join(p, "user_id", "left").join(r, "site_id", "left")
    return j.select(*comments.columns, F.when(F.col("_a") == 1, "Author").otherwise("Visitor").alias("user_role"),
                    F.when(F.col("_p") == 1, "Participant").otherwise("Other").alias("user_group"),
                    F.when(F.col("_r") == 1, "Recommended").otherwise("Other").alias("site_group"))


def thread_order(turns: DataFrame) -> DataFrame:
    """Top-level messages in order, each followed by its replies: position within the thread."""
    bucket = F.floor(F.col("turn") / 1024).cast("long")
    parent = prefix_aggregate(turns, ["conv_id"], bucket, ["turn"],
                              {"_last": ("max", F.when(F.col("role") == "user", F.col("turn")))}, ("rows", 0))
    p = parent.select("conv_id", "turn", "role", F.coalesce("_last", F.lit(-1)).alias("parent_turn"),
                      (F.col("role") != "user").cast("int").alias("is_reply"))
    return running_number(p, ["conv_id"], F.floor(F.greatest("parent_turn", F.lit(0)) / 1024).cast("long"),
                          ["parent_turn", "is_reply", "turn"], "position")


def exposed_nonparticipants(evidence: dict[str, DataFrame], participants: DataFrame) -> DataFrame:
    """Users with any evidence of exposure who are not participants, with the overlap pattern."""
    tagged = None
    for name, df in evidence.items():
        part = df.select("user_id", F.lit(name).alias("kind"))
        tagged = part if tagged is None else tagged.unionByName(part)
    return (tagged.groupBy("user_id").agg(*[F.max((F.col("kind") == n).cast("long")).alias(n) for n in evidence])
            .join(participants.select("user_id").distinct(), "user_id", "left_anti"))


def collapse_sites(attributed: DataFrame) -> DataFrame:
    """Per site: first batch, first real click (-1 if none), any click."""
    return attributed.groupBy("site_id").agg(
        F.min("batch_id").alias("batch_id"),
        F.coalesce(F.min(F.when(F.col("was_clicked") == 1, F.col("first_click_us"))), F.lit(-1)).alias("first_click_us"),
        F.max("was_clicked").alias("was_clicked"))


def impute_click_times(sites: DataFrame, attributed: DataFrame, seed: int = 23) -> DataFrame:
    """A site without a click gets a clicked time of its batch, drawn by a seeded hash. ``status`` is
    clicked (own time), filled, or unfilled where nobody clicked in the batch (time -1); no site is lost."""
    times = attributed.filter("was_clicked = 1").select("batch_id", "first_click_us").distinct()
    n = times.groupBy("batch_id").agg(F.count(_ONE).alias("_n"))
    numbered = running_number(times, ["batch_id"], time_bucket("first_click_us", US_PER_HOUR), ["first_click_us"], "_i")
    need = sites.join(n, "batch_id", "left").withColumn("_i", draw(seed, "site_id") % F.col("_n") + 1)
    drawn = need.join(numbered.withColumnRenamed("first_click_us", "_t"), ["batch_id", "_i"], "left")
    own = F.col("was_clicked") == 1
    return drawn.select("site_id", "batch_id", F.when(own, F.col("first_click_us")).otherwise(F.coalesce("_t", F.lit(-1))).alias("first_click_us"),
                        "was_clicked", F.when(own, "clicked").when(F.col("_t").isNull(), "unfilled").otherwise("filled").alias("status"))


def weekly_rates(visits: DataFrame, interactions: DataFrame, recs: DataFrame, end_us: int) -> DataFrame:
    """Second visits to and interactions with recommended sites per week in the study."""
    r = recs.select(F.col("participant_id").alias("user_id"), "site_id", "sent_us")
    start = recs.groupBy(F.col("participant_id").alias("user_id")).agg(F.min("sent_us").alias("start_us"))
    after = lambda df: df.join(r, ["user_id", "site_id"]).filter(F.col("us") >= F.col("sent_us"))
    v = (after(visits).groupBy("user_id", "site_id").agg(F.count(_ONE).alias("_n")).groupBy("user_id").agg(_N(F.col("_n") > 1).alias("n_second_visits")))
    i = after(interactions).groupBy("user_id").agg(F.count(_ONE).alias("n_interactions"))
    j = start.join(v, "user_id", "left").join(i, "user_id", "left").fillna(0)
    weeks = (F.lit(end_us) - F.col("start_us")) / float(7 * US_PER_DAY)
    return j.select("user_id", "n_second_visits", "n_interactions", (F.col("n_second_visits") / weeks).alias("second_visits_per_week"),
                    (F.col("n_interactions") / weeks).alias("interactions_per_week"))


def profile_summary(profiles: DataFrame, usps: DataFrame) -> DataFrame:
    """Sites per role and the most-authored site of each user."""
    roles = profiles.groupBy("user_id").agg(F.count(_ONE).alias("n_sites"), *[
        _N(F.col("role") == r).alias(f"n_{r.lower()}") for r in ("Organizer", "Visitor")])
    top = usps.groupBy("user_id").agg(F.max(F.struct("n_updates", -F.col("site_id"))).alias("_t"))
    return roles.join(top, "user_id", "left").select(
        *roles.columns, F.coalesce(-F.col("_t.col2"), F.lit(-1)).alias("top_site"), F.coalesce("_t.n_updates", F.lit(0)).alias("top_updates"))


def click_segments(attributed: DataFrame) -> DataFrame:
    """Participants by number of clicked sites: 1, 2, 3+."""
    n = attributed.filter("was_clicked = 1").groupBy("participant_id").agg(F.count(_ONE).alias("n_clicked"))
    return n.withColumn("segment", F.when(F.col("n_clicked") >= 3, "3+").otherwise(F.col("n_clicked").cast("string")))


def feedback_sites(attributed: DataFrame, k: int = 3) -> DataFrame:
    """The latest clicked site of a participant plus k - 1 others by content hash."""
    c = attributed.filter("was_clicked = 1").select("participant_id", "site_id", "first_click_us")
    latest = c.groupBy("participant_id").agg(F.max(F.struct("first_click_us", "site_id")).alias("_l"))
    j = c.join(latest, "participant_id").withColumn("is_latest", (F.col("site_id") == F.col("_l.site_id")).cast("long"))
    h = F.md5(F.concat_ws("|", F.col("participant_id").cast("string"), F.col("site_id").cast("string")))
    return first_k_per_key(j.drop("_l"), ["participant_id"], [F.col("is_latest").desc(), h], k, "pick")


def batch_content(attributed: DataFrame, codes: list[str]) -> DataFrame:
    """Per batch: sum and max per content code, any code, distinct code combinations, any click."""
    combo = F.concat_ws("", *[F.col(c).cast("string") for c in codes])
    return attributed.groupBy("participant_id", "batch_id").agg(
        *[F.sum(c).alias(f"sum_{c}") for c in codes], *[F.max(c).alias(f"max_{c}") for c in codes],
        F.max(F.greatest(*[F.col(c) for c in codes])).alias("any_code"), F.countDistinct(combo).alias("n_combinations"),
        F.max("was_clicked").alias("any_click"))


def peer_interactions(interactions: DataFrame, recs: DataFrame, authors: DataFrame) -> DataFrame:
    """Peer interactions after the first send, recommended or other, for three user segments."""
    first = recs.agg(F.min("sent_us").alias("_start"))
    r = recs.select(F.col("participant_id").alias("user_id"), "site_id", F.lit(1).alias("_r"))
    people = recs.select(F.col("participant_id").alias("user_id"), F.lit(1).alias("_p")).distinct()
    authored = authors.select("user_id", "site_id").distinct()
    peer = (interactions.join(authored, ["user_id", "site_id"], "left_anti").join(F.broadcast(first), F.lit(True))
            .filter(F.col("us") >= F.col("_start")).join(r, ["user_id", "site_id"], "left").join(people, "user_id", "left")
            .fillna(0, ["_r", "_p"]))
    active = peer.filter("_r = 1").select("user_id", F.lit(1).alias("_x")).distinct()
    au = authors.select("user_id", F.lit(1).alias("_u")).distinct()
    j = peer.join(active, "user_id", "left").join(au, "user_id", "left")
    seg = F.explode(F.filter(F.array(F.when(F.col("_x") == 1, "interacting_participants"), F.when(F.col("_p") == 1, "participants"),
                                     F.when(F.col("_u") == 1, "authors")), lambda x: x.isNotNull()))
    return j.withColumn("segment", seg).groupBy("segment", F.col("_r").cast("long").alias("is_recommended")).agg(
        F.count(_ONE).alias("n_interactions"), F.countDistinct("user_id").alias("n_users"), F.countDistinct("site_id").alias("n_sites"),
        F.avg((F.col("itype") == "amp").cast("double")).alias("reaction_share"))


def churn(active: DataFrame, month: str, nxt: str, period: str = "month", key: str = "user_id", n: str = "n") -> DataFrame:
    """Users active in one period against the next, zero-filled: mean and sd of the difference."""
    a = active.filter(F.col(period) == month).select(key, F.col(n).alias("_a"))
    b = active.filter(F.col(period) == nxt).select(key, F.col(n).alias("_b"))
    d = a.join(b, key, "left").select((F.coalesce("_b", F.lit(0)) - F.col("_a")).alias("d"), F.col("_b").isNull().cast("long").alias("lost"))
    return d.agg(F.count(_ONE).alias("n_users"), F.sum("lost").alias("n_lost"), F.avg("d").alias("mean_diff"), F.stddev("d").alias("sd_diff"))
