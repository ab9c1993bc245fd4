"""Point-in-time author, initiation and activity state.

Every state change is a validity timestamp; "the state at t" is a comparison with it
(strictly before t). Times are epoch microseconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .prefix import (ACTIVE_WINDOW_US, DEPTH_ROWS, US_PER_DAY, US_PER_HOUR, first_k_per_key, prefix_aggregate, running_number,
                     state_at, time_bucket, window_state_at)

ACTIVITY_TYPES = ("journal", "amp", "comment", "guestbook")


def usp_state(journals: DataFrame, k: int = 3) -> DataFrame:
    """Time a (user, site) pair became existing (1st update) and eligible (k-th update)."""
    head = first_k_per_key(journals, ["user_id", "site_id"], ["us", "event_id"], k)
    return head.groupBy("user_id", "site_id").agg(
        F.min("us").alias("exist_us"), F.min(F.when(F.col("rn") == k, F.col("us"))).alias("elig_us"))


def initiations(interactions: DataFrame) -> DataFrame:
    """First interaction of a user with a site, of any type."""
    return first_k_per_key(interactions, ["user_id", "site_id"], ["us", "event_id"], 1).drop("rn")


def flag_initiations(interactions: DataFrame) -> DataFrame:
    """Every interaction with whether the pair had initiated before it."""
    first = initiations(interactions).select("user_id", "site_id", F.col("event_id").alias("_first"))
    return interactions.join(first, ["user_id", "site_id"]).withColumn(
        "has_already_initiated", F.col("event_id") != F.col("_first")).drop("_first")


def rolling_activity(points: DataFrame, activity: DataFrame, on: list[str],
                     window_us: int = ACTIVE_WINDOW_US) -> DataFrame:
    """Per point: count and latest time of each activity type in [t - window, t)."""
    is_ = lambda a: F.col("atype") == a
    return window_state_at(
        points, activity, on,
        {f"n_{a}": F.when(is_(a), 1).otherwise(0).cast("long") for a in ACTIVITY_TYPES},
        {f"last_{a}_us": F.when(is_(a), F.col("us")) for a in ACTIVITY_TYPES}, window_us=window_us, depth=DEPTH_ROWS)


def active_ids(activity: DataFrame, at_us: int, key: str = "user_id", window_us: int = ACTIVE_WINDOW_US) -> DataFrame:
    """Ids with any activity in [t - window, t): count and most recent time."""
    return (activity.filter((F.col("us") >= at_us - window_us) & (F.col("us") < at_us))
            .groupBy(key).agg(F.count(F.lit(1)).alias("n_activity"), F.max("us").alias("last_us")))


def leaderboard(active: DataFrame, by: str, key: str = "user_id", k: int | None = None) -> DataFrame:
    """Ids ordered by recency or count, descending; a top-k when ``k`` is given."""
    out = active.orderBy(F.col(by).desc(), F.col(key))
    return out.limit(k) if k else out


def activity_days(activity: DataFrame, window_us: int = ACTIVE_WINDOW_US) -> DataFrame:
    """One row per (user, day x) on which the user can be active at some time of x.

    With a window of w whole days, a user is active at t in day x iff ``full_cover`` (an event
    in days x-w+1..x-1), or the first event of day x is before t, or the last event of day x-w
    is not before t - window. At most w+1 rows per user and active day.
    """
    days = window_us // US_PER_DAY
    if days * US_PER_DAY != window_us:
        raise ValueError("the activity window must be whole days")
    daily = activity.groupBy("user_id", time_bucket("us").alias("d")).agg(
        F.min("us").alias("lo"), F.max("us").alias("hi"))
    return (daily.withColumn("off", F.explode(F.sequence(F.lit(0), F.lit(days))))
            .groupBy("user_id", (F.col("d") + F.col("off")).alias("day")).agg(
                F.max(F.col("off").between(1, days - 1).cast("int")).alias("full_cover"),
                F.min(F.when(F.col("off") == 0, F.col("lo"))).alias("first_today"),
                F.max(F.when(F.col("off") == days, F.col("hi"))).alias("last_edge")))


def active_predicate(at: F.Column, window_us: int = ACTIVE_WINDOW_US) -> F.Column:
    return ((F.col("full_cover") == 1) | F.coalesce(F.col("first_today") < at, F.lit(False))
            | F.coalesce(F.col("last_edge") >= at - F.lit(window_us), F.lit(False)))


def first_update(journals: DataFrame) -> DataFrame:
    return journals.groupBy("user_id").agg(F.min("us").alias("first_update_us"))


def numbered_updates(journals: DataFrame) -> DataFrame:
    """Sequence number of each update within its (user, site) pair."""
    return running_number(journals, ["user_id", "site_id"], time_bucket("us"), ["us", "event_id"], "seq")


def last_k_updates(points: DataFrame, journals: DataFrame, k: int = 3, inclusive: bool = True) -> DataFrame:
    """The k most recent updates of the point's (user, site) pair at its time.

    Updates are numbered, a point learns how many precede it, and the wanted numbers are an
    equi-join: no range join and no per-pair list. ``pos`` runs 1 (oldest) .. <=k (newest).
    """
    on = ["user_id", "site_id"]
    seen = state_at(points, journals, on, {"n_seen": ("sum", F.lit(1).cast("long"))}, inclusive=inclusive)
    wanted = seen.filter(F.col("n_seen") > 0).withColumn(
        "seq", F.explode(F.sequence(F.greatest(F.col("n_seen") - (k - 1), F.lit(1)), F.col("n_seen"))))
    upd = numbered_updates(journals).select(*on, "seq", F.col("event_id").alias("journal_oid"),
                                            F.col("us").alias("journal_us"))
    return wanted.join(upd, [*on, "seq"]).withColumn(
        "pos", F.col("seq") - F.greatest(F.col("n_seen") - k, F.lit(0))).drop("seq")


def merge_visible(interactions: DataFrame, journals: DataFrame, on: list[str], ties: str = "time") -> DataFrame:
    """For each interaction, the updates strictly before it: how many and the latest. With ``ties`` = "sequence",
    of updates at its own time those with a smaller event_id are before it."""
    return state_at(interactions, journals, on, {
        "n_updates_before": ("sum", F.lit(1).cast("long")), "last_update_us": ("max", F.col("us"))}, depth=DEPTH_ROWS, ties=ties)


def assign_period(df: DataFrame, start_us: int, test_us: int, split_us: int) -> DataFrame:
    return df.withColumn("period", F.when(F.col("us") < start_us, "burn_in").when(F.col("us") < test_us, "train")
                         .when(F.col("us") <= split_us, "validation").otherwise("test"))


def seen_in_train(inits: DataFrame, start_us: int, test_us: int, split_us: int) -> DataFrame:
    """Period of each initiation, and whether its user / site initiated in the train period."""
    p = assign_period(inits, start_us, test_us, split_us)
    train = p.filter(F.col("period") == "train")
    u = train.select("user_id", F.lit(1).alias("user_in_train")).distinct()
    s = train.select("site_id", F.lit(1).alias("site_in_train")).distinct()
    return p.join(u, "user_id", "left").join(s, "site_id", "left").fillna(0, ["user_in_train", "site_in_train"])


def previous_time(df: DataFrame, keys: list[str], us: str = "us", name: str = "prev_us") -> DataFrame:
    """Time of the preceding row of the key (a lag that does not need the key in one task)."""
    return prefix_aggregate(df, keys, time_bucket(us), [us], {name: ("max", F.col(us))})


def drop_restart_segments(log: DataFrame, max_rows: int = 1000) -> DataFrame:
    """A log whose time goes backwards starts a new segment; rows of short superseded segments
    (fewer than ``max_rows``, not the last) are dropped. ``seq`` is the write position."""
    bucket = F.floor(F.col("seq") / 4096).cast("long")
    lagged = prefix_aggregate(log, [], bucket, ["seq"], {"_prev": ("max", F.struct("seq", "us"))})
    seg = prefix_aggregate(lagged, [], bucket, ["seq"], {"segment": (
        "sum", F.coalesce((F.col("us") < F.col("_prev.us")).cast("long"), F.lit(0)))}, ("rows", 0))
    size = seg.groupBy("segment").agg(F.count(F.lit(1)).alias("segment_rows"))
    newest = size.agg(F.max("segment").alias("_newest"))
    keep = size.join(F.broadcast(newest), F.lit(True)).filter(
        (F.col("segment") == F.col("_newest")) | (F.col("segment_rows") >= max_rows)).drop("_newest")
    return seg.drop("_prev").join(keep, "segment")


def hours_since(us: F.Column, at: F.Column) -> F.Column:
    return (at - us) / F.lit(float(US_PER_HOUR))
