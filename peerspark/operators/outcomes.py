"""Outcome tables around an index time, for many window lengths in one pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .prefix import DEPTH_ROWS, US_PER_DAY, Depth, time_bucket

SITE_MEASURES = ["n_updates", "n_authors", "n_interactions", "n_users_interactedwith", "n_sitewide_interactions",
                 "n_sitewide_sites", "n_sitewide_self", "n_first_visits", "n_days_visited", "n_users_repeat_visited"]
USER_MEASURES = ["n_updates", "n_sites_interactedwith", "n_self_sites", "n_sites_text", "n_interactions",
                 "n_self_interactions", "n_text_interactions", "n_first_visits", "n_days_visited", "n_sites_repeat_visited"]


def around(targets: DataFrame, events: DataFrame, on: str, reach_back: int, reach_front: int, depth: int = DEPTH_ROWS) -> DataFrame:
    """Events from ``reach_back`` microseconds before to ``reach_front`` after their target's time ``t0``, with it.

    Events meet targets on (key, bucket), never on the key alone: buckets follow the data, so that none holds more than
    about ``depth`` events of a key, and a target is joined to those of its key's buckets that it reaches."""
    placed = Depth(F.col("us"), US_PER_DAY, depth).place(events, [on])
    held = placed.groupBy(on, "_bucket").agg(F.min("us").alias("_a"), F.max("us").alias("_b"))
    reached = (held.join(targets.select(on, "t0"), on)
               .filter((F.col("_b") >= F.col("t0") - reach_back) & (F.col("_a") <= F.col("t0") + reach_front)).select(on, "_bucket", "t0"))
    return (placed.join(reached, [on, "_bucket"]).drop("_bucket")
            .filter((F.col("us") - F.col("t0")).between(-reach_back, reach_front)))


def least_windows(targets: DataFrame, events: DataFrame, on: str, days: list[int], back: int | None = None,
                  depth: int = DEPTH_ROWS) -> DataFrame:
    """How often things occur around each target's time ``t0``, told by the smallest window that holds an event.

    ``events`` has the key, ``us`` and ``seen``, an array of (kind, who). Windows of a side are nested, so an event is counted
    once, at the smallest that holds it, and totals run over the windows. Rows: key, kind, who, side, bin (place in ``days``
    of that window), n and, 0 or 1, first and second: whether the first or the second event of (kind, who) falls there, which
    makes distinct counts sums as well. The pre side reaches ``back`` days for every window, or as far as the post side
    if it is not given."""
    days = sorted(days)
    gap = F.col("us") - F.col("t0")

    def least(distance: Column, reach: list[int]) -> Column:
        return reduce(lambda wider, i: F.when(distance <= reach[i] * US_PER_DAY, F.lit(i)).otherwise(wider), range(len(reach) - 1, -1, -1), F.lit(None).cast("int"))

    sides = F.array(*[F.when(cond, F.struct(F.lit(s).alias("side"), at.alias("bin"))) for s, cond, at in (
        ("pre", gap <= 0, least(-gap, [back] if back else days)), ("post", gap >= 0, least(gap, days)))])
    near = around(targets, events, on, (back or days[-1]) * US_PER_DAY, days[-1] * US_PER_DAY, depth)
    told = (near.select(on, "seen", F.explode(F.filter(sides, lambda x: x.isNotNull())).alias("_w"))
            .select(on, "_w.*", F.inline("seen")).filter("bin is not null"))
    per = told.groupBy(on, "kind", "who", "side", "bin").agg(F.count(F.lit(1)).alias("n"))
    run = F.sum("n").over(W.partitionBy(on, "kind", "who", "side").orderBy("bin"))  # at most one row a window length
    return (per.withColumn("_run", run).withColumn("first", (F.col("_run") == F.col("n")).cast("long"))
            .withColumn("second", ((F.col("_run") > 1) & (F.col("_run") - F.col("n") < 2)).cast("long")).drop("_run"))


def _seen(*kinds: tuple[str, Column, Column | None]) -> Column:
    """The ``seen`` array of an event: (kind, who) for each kind whose condition holds."""
    one = lambda kind, who: F.struct(F.lit(kind).alias("kind"), who.cast("long").alias("who"))
    return F.filter(F.array(*[one(k, who) if cond is None else F.when(cond, one(k, who)) for k, who, cond in kinds]), lambda x: x.isNotNull())


def _assemble(targets: DataFrame, days: list[int], key: str, found: DataFrame, names: list[str]) -> DataFrame:
    """Rows (key, side, bin) of measures, several or none for each, to <name>_pre / <name>_post per target and window:
    running totals over the window lengths."""
    days = sorted(days)
    lengths = F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(d).cast("long").alias("_days")) for i, d in enumerate(days)])
    base = targets.select(key, F.struct(*targets.columns).alias("_t"), F.inline(lengths))
    sides = [(f"{n}_{s}", F.sum(F.when(F.col("side") == s, F.col(n)))) for n in names for s in ("pre", "post")]
    per = (base.unionByName(found, allowMissingColumns=True).groupBy(key, "bin")
           .agg(F.first("_t", True).alias("_t"), F.first("_days", True).alias("window_days"), *[e.alias(n) for n, e in sides])
           .filter("_t is not null"))  # the other keys are no targets
    run = W.partitionBy(key).orderBy("bin")
    return per.select("window_days", F.col(key), *[F.col(f"_t.`{c}`").alias(c) for c in targets.columns if c != key],
                      *[F.coalesce(F.sum(n).over(run), F.lit(0)).cast("long").alias(n) for n, _ in sides])


def _since_first(targets: DataFrame, journals: DataFrame, key: str) -> DataFrame:
    t = targets.join(journals.groupBy(key).agg(F.min("us").alias("_f")), key, "left")
    return t.withColumn("days_since_first_update", F.coalesce((F.col("t0") - F.col("_f")) / float(US_PER_DAY), F.lit(0.0))).drop("_f")


def _events(key: str, who: str, journals: DataFrame, interactions: DataFrame, visits: DataFrame, exclude_pairs: DataFrame | None,
            text: Column | None = None) -> DataFrame:
    """All events that outcomes count, in one table: (key, us, seen)."""
    if exclude_pairs is not None:
        ex = exclude_pairs.select("user_id", "site_id").distinct()
        interactions, visits = (df.join(ex, ["user_id", "site_id"], "left_anti") for df in (interactions, visits))
    first = visits.groupBy("user_id", "site_id").agg(F.min("us").alias("us"))
    w = F.col(who)
    more = [] if text is None else [("text", w, text)]
    return reduce(DataFrame.unionByName, [df.select(key, "us", _seen(*kinds).alias("seen")) for df, kinds in (
        (journals, [("update", w, None)]), (interactions, [("interaction", w, None), *more]),
        (first, [("first visit", w, None)]), (visits, [("visit", w, None), ("day", time_bucket("us"), None)]))])


def _total(column: str, *conditions: Column) -> Column:
    return F.sum(F.when(reduce(lambda a, b: a & b, conditions), F.col(column)))


def site_outcomes(targets: DataFrame, journals: DataFrame, interactions: DataFrame, visits: DataFrame, days: list[int],
                  exclude_pairs: DataFrame | None = None, back: int | None = None, depth: int = DEPTH_ROWS) -> DataFrame:
    """21 pre/post outcomes of each target site (site_id, t0; one row a site): updates, authors, peer interactions
    and their users, site-wide activity of its authors, visits, and days since the first update.

    Recommended pairs given in ``exclude_pairs`` do not count as interactions or visits. What a site's authors do on other
    sites is all they do less what they do on it, so users are not multiplied by the sites that they write.
    """
    authored = journals.select("user_id", "site_id").distinct()
    per = (least_windows(targets, _events("site_id", "user_id", journals, interactions, visits, exclude_pairs), "site_id", days, back, depth)
           .join(authored.select(F.col("user_id").alias("who"), "site_id", F.lit(True).alias("_own")), ["who", "site_id"], "left"))
    is_a = lambda kind: F.col("kind") == kind
    act, own = is_a("interaction"), F.col("_own").isNotNull()
    direct = per.groupBy("site_id", "side", "bin").agg(
        _total("n", is_a("update")).alias("n_updates"), _total("first", is_a("update")).alias("n_authors"),
        _total("n", act, ~own).alias("n_interactions"), _total("first", act, ~own).alias("n_users_interactedwith"),
        (-_total("n", act, own)).alias("n_sitewide_interactions"), (-_total("first", act, own)).alias("n_sitewide_sites"),
        _total("n", act, own).alias("n_sitewide_self"), _total("n", is_a("first visit")).alias("n_first_visits"),
        _total("first", is_a("day")).alias("n_days_visited"), _total("second", is_a("visit")).alias("n_users_repeat_visited"))
    everywhere = (per.filter(act).groupBy(F.col("who").alias("user_id"), "side", "bin").agg(F.sum("n").alias("n"), F.sum("first").alias("first"))
                  .join(authored, "user_id").groupBy("site_id", "side", "bin")
                  .agg(F.sum("n").alias("n_sitewide_interactions"), F.sum("first").alias("n_sitewide_sites")))
    return _assemble(_since_first(targets, journals, "site_id"), days, "site_id",
                     direct.unionByName(everywhere, allowMissingColumns=True), SITE_MEASURES)


def user_outcomes(targets: DataFrame, journals: DataFrame, interactions: DataFrame, visits: DataFrame, days: list[int],
                  exclude_pairs: DataFrame | None = None, back: int | None = None, depth: int = DEPTH_ROWS) -> DataFrame:
    """11 outcomes of each target user (user_id, t0; one row a user): updates, peer / self / text interactions and
    their sites, visits, and days since the first update."""
    authored = journals.select("user_id", F.col("site_id").alias("who"), F.lit(True).alias("_own")).distinct()
    events = _events("user_id", "site_id", journals, interactions, visits, exclude_pairs, F.col("itype") != "amp")
    per = least_windows(targets, events, "user_id", days, back, depth).join(authored, ["user_id", "who"], "left")
    is_a = lambda kind: F.col("kind") == kind
    act, text, own = is_a("interaction"), is_a("text"), F.col("_own").isNotNull()
    found = per.groupBy("user_id", "side", "bin").agg(
        _total("n", is_a("update")).alias("n_updates"),
        _total("first", act, ~own).alias("n_sites_interactedwith"), _total("first", act, own).alias("n_self_sites"),
        _total("first", text, ~own).alias("n_sites_text"), _total("n", act, ~own).alias("n_interactions"),
        _total("n", act, own).alias("n_self_interactions"), _total("n", text, ~own).alias("n_text_interactions"),
        _total("n", is_a("first visit")).alias("n_first_visits"), _total("first", is_a("day")).alias("n_days_visited"),
        _total("second", is_a("visit")).alias("n_sites_repeat_visited"))
    return _assemble(_since_first(targets, journals, "user_id"), days, "user_id", found, USER_MEASURES)


def arm_contrast(wide: DataFrame, arm: str, measures: list[str]) -> DataFrame:
    """For each window and measure: users in both arms (``arm`` is 1 or 0), the difference of the arms' means after the index
    time, before it, and the difference of the two; null where an arm has no users."""
    rows = wide.select("window_days", arm, F.inline(F.array(*[
        F.struct(F.lit(m).alias("outcome"), F.col(f"{m}_pre").alias("pre"), F.col(f"{m}_post").alias("post")) for m in measures])))
    mean = lambda c, side: F.avg(F.when(F.col(arm) == side, F.col(c)))
    diff = lambda c: mean(c, 1) - mean(c, 0)
    return rows.groupBy("window_days", "outcome").agg(
        F.count_if(F.col(arm) == 1).alias("n_arm"), F.count_if(F.col(arm) == 0).alias("n_other"),
        diff("post").alias("diff_post"), diff("pre").alias("diff_pre")).withColumn("diff_in_diff", F.col("diff_post") - F.col("diff_pre"))
