"""State between its changes, met by candidates without exchanging them.

A state that changes at events is a row for each time it keeps a value: from after ``from_us`` up to ``to_us``. Contexts meet the
rows of a day in blocks, so a candidate gets its state where it is made.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .contexts import (BLOCK_SIDE, _barred_spans, _changes, _in_blocks, active_spans, points_of_candidates, ruled_out, target_rows)
from .features import USER_FEATURES, _hours, user_features
from .graph import component_history
from .prefix import ACTIVE_WINDOW_US, prefix_aggregate, state_at, time_bucket
from .state import ACTIVITY_TYPES, first_update

FOREVER = 1 << 62
_AGG = {"sum": F.sum, "max": F.max}


def steps(changes: DataFrame, keys: list[str], measures: dict[str, str]) -> DataFrame:
    """Running ``measures`` (name: "sum" or "max") of each key from after a change (from_us) up to the next (to_us)."""
    at = changes.groupBy(*keys, "us").agg(*[_AGG[kind](m).alias(m) for m, kind in measures.items()])
    run = prefix_aggregate(at, keys, time_bucket("us"), ["us"], {f"_r_{m}": (kind, F.col(m)) for m, kind in measures.items()}, ("rows", 0))
    ends = prefix_aggregate(run, keys, -time_bucket("us"), [F.desc("us")], {"to_us": ("min", F.col("us"))})
    return ends.select(*keys, F.col("us").alias("from_us"), F.coalesce("to_us", F.lit(FOREVER)).alias("to_us"),
                       *[F.col(f"_r_{m}").alias(m) for m in measures])


def passing(events: DataFrame, counts: list[str], window_us: int = ACTIVE_WINDOW_US) -> DataFrame:
    """``events`` as changes of ``counts``, and their ends a window later, which take the counts off and change nothing else."""
    others = [c for c in events.columns if c != "us" and c not in counts]
    kept = [c for c in others if not c.startswith("last_")]
    ends = events.select(*kept, (F.col("us") + window_us).alias("us"), *[(-F.col(c)).alias(c) for c in counts])
    return events.unionByName(ends, allowMissingColumns=True)


def _together(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def user_changes(activity: DataFrame, edges: DataFrame | None, types: tuple[str, ...] = (), last: bool = False) -> tuple[DataFrame, dict[str, str]]:
    """Changes of a user's activity: ``n_on`` events in the window, with ``types`` also n_<type> (and last_<type>_us), with
    ``edges`` also in- and outdegree. Gives the changes and their measures."""
    names = ["n_on", *[f"n_{a}" for a in types]]
    is_ = lambda a: F.col("atype") == a
    act = activity.select("user_id", "us", F.lit(1).cast("long").alias("n_on"), *[is_(a).cast("long").alias(f"n_{a}") for a in types],
                          *[F.when(is_(a), F.col("us")).alias(f"last_{a}_us") for a in types if last])
    parts, measures = [passing(act, names)], {**{n: "sum" for n in names}, **{f"last_{a}_us": "max" for a in types if last}}
    if edges is not None:
        one = F.lit(1).cast("long")
        parts += [edges.select(F.col("dst").alias("user_id"), F.col("edge_us").alias("us"), one.alias("indegree")),
                  edges.select(F.col("src").alias("user_id"), F.col("edge_us").alias("us"), one.alias("outdegree"))]
        measures |= {"indegree": "sum", "outdegree": "sum"}
    return _together(parts), measures


def active_steps(changes: DataFrame, measures: dict[str, str]) -> DataFrame:
    """Steps of users while they are active."""
    return steps(changes, ["user_id"], measures).filter("n_on > 0").drop("n_on")


def of_pairs(user_steps: DataFrame, usps: DataFrame) -> DataFrame:
    """Steps of users as steps of their pairs, from when these are eligible."""
    el = usps.filter(F.col("elig_us").isNotNull()).select("user_id", F.col("site_id").alias("cand_site"), "elig_us")
    return (user_steps.join(el, "user_id").withColumn("from_us", F.greatest("from_us", "elig_us"))
            .filter(F.col("from_us") < F.col("to_us")).drop("elig_us"))


def of_sites(changes: DataFrame, measures: dict[str, str], usps: DataFrame, activity: DataFrame) -> DataFrame:
    """Steps of sites as steps of their eligible pairs while the user is active."""
    el = usps.filter(F.col("elig_us").isNotNull())
    on = active_steps(*user_changes(activity, None))
    here = of_pairs(on, el).withColumnRenamed("cand_site", "site_id")
    side = lambda at, n: here.select("user_id", "site_id", F.col(at).alias("us"), F.lit(n).cast("long").alias("n_on"))
    site = changes.join(el.select("user_id", "site_id"), "site_id")
    every = _together([side("from_us", 1), side("to_us", -1), site])
    return steps(every, ["user_id", "site_id"], {"n_on": "sum", **measures}).filter("n_on > 0").drop("n_on").withColumnRenamed("site_id", "cand_site")


def candidates_in_steps(ctx: DataFrame, held: DataFrame, barred: DataFrame, side: int = BLOCK_SIDE) -> DataFrame:
    """Contexts times the steps (user_id, from_us, to_us) that hold at their time, but for users ``barred`` (metadata_id, us,
    cand_user). ``held`` must end with its user's activity. Rows pass no exchange."""
    span = ctx.agg(F.min("us").alias("_a"), F.max("us").alias("_b"))
    days = (held.join(F.broadcast(span), (F.col("from_us") < F.col("_b")) & (F.col("to_us") >= F.col("_a")))
            .withColumn("day", F.explode(F.sequence(time_bucket(F.greatest("from_us", "_a")), time_bucket(F.least("to_us", "_b"))))).drop("_a", "_b"))
    met = _in_blocks(ctx, days, side, barred, (F.col("from_us") < F.col("us")) & (F.col("us") <= F.col("to_us")))
    return met.drop("day", "from_us", "to_us").withColumnRenamed("user_id", "cand_user")


# what a baseline's score is made of: states of the user, or else of the site
USER_STATE = {"MostInitiatedWith": ["indegree"], "NewestAuthor": [], "ClosestToStart": [], "MostInteractiveAuthorRecently": ["n_amp", "n_comment", "n_guestbook"]}
SITE_EVENTS = {"MostInitiatedWithRecently": "init", "MostRecentlyInitiatedWith": "init", "MostJournalsRecently": "journal", "MostRecentJournal": "journal"}


def baseline_states(ctx: DataFrame, model: str, usps: DataFrame, activity: DataFrame, journals: DataFrame, inits: DataFrame,
                    edge: DataFrame, side: int = BLOCK_SIDE, window_us: int = ACTIVE_WINDOW_US) -> DataFrame:
    """Candidates of contexts with the state that a baseline scores, as ``scoring.with_state`` gives it. What a user or
    site is in a step is worked out once, not for every candidate."""
    first = first_update(journals)
    if model in SITE_EVENTS:
        kind = SITE_EVENTS[model]
        count, last = f"n_site_{kind}s", f"last_site_{kind}_us"
        events = (inits if kind == "init" else journals).select("site_id", "us", F.lit(1).cast("long").alias(count), F.col("us").alias(last))
        held = of_sites(passing(events, [count], window_us), {count: "sum", last: "max"}, usps, activity)
    else:
        state = USER_STATE[model]
        types = tuple(s.removeprefix("n_") for s in state if s.startswith("n_"))
        changes, measures = user_changes(activity, edge if "indegree" in state else None, types)
        held = of_pairs(active_steps(changes, measures), usps).join(
            first.select("user_id", F.col("first_update_us").alias("_cf")), "user_id", "left")
        last = None
    own = ctx.join(first.select(F.col("user_id").alias("source"), F.col("first_update_us").alias("_sf")), "source", "left")
    met = candidates_in_steps(own, held, ruled_out(ctx, usps, edge), side)
    return met if last is None else met.withColumn(last, F.when(F.col(last) >= F.col("us") - window_us, F.col(last)))


def feature_steps(names: list[str], usps: DataFrame, activity: DataFrame, journals: DataFrame, edge: DataFrame,
                  sizes: DataFrame | None = None) -> DataFrame:
    """Steps of what the user features ``names`` are made of, while users are active and eligible. ``sizes`` are the changes
    of component sizes (node, us, component_size), for that feature."""
    types = tuple(a for a in ACTIVITY_TYPES if f"n_{a}" in names or f"hours_{a}" in names)
    degrees = {"indegree", "outdegree"} & set(names)
    changes, measures = user_changes(activity, edge if degrees else None, types, last=True)
    if "component_size" in names:
        changes = _together([changes, sizes.withColumnRenamed("node", "user_id")])
        measures |= {"component_size": "max"}
    el = usps.filter(F.col("elig_us").isNotNull()).groupBy("user_id").agg(F.min("elig_us").alias("elig_us"))
    return (active_steps(changes, measures).join(el, "user_id").withColumn("from_us", F.greatest("from_us", "elig_us"))
            .filter(F.col("from_us") < F.col("to_us")).drop("elig_us").join(first_update(journals), "user_id", "left"))


def features_in_steps(names: list[str], window_us: int = ACTIVE_WINDOW_US) -> dict[str, Column]:
    """The user features ``names`` of rows at ``us`` in ``feature_steps``."""
    def one(name):
        if name == "component_size":
            return F.coalesce(F.col(name), F.lit(1).cast("long"))
        if name == "hours_first_update":
            return _hours(F.col("first_update_us"))
        if name.startswith("hours_"):
            last = F.col(f"last_{name.removeprefix('hours_')}_us")
            return _hours(F.when(last >= F.col("us") - window_us, last))
        return F.col(name)
    return {n: one(n) for n in names}


def features_at_candidates(ctx: DataFrame, targets: DataFrame, usps: DataFrame, activity: DataFrame, journals: DataFrame, edge: DataFrame,
                           names: list[str] = USER_FEATURES) -> DataFrame:
    """``user_features`` of each distinct (user_id, us) of the candidates, targets and sources of contexts, which are not made.

    The contexts of a time are one: it has the users that are active and eligible, but for those ruled out for all of them.
    Sources and targets who are not among these are looked up as points.
    """
    times, barred = points_of_candidates(ctx, usps, edge)
    times, barred = cut_lineage(times), cut_lineage(barred)
    known = ctx.select(F.col("source").alias("user_id"), "us").unionByName(
        target_rows(ctx, targets).select(F.col("cand_user").alias("user_id"), "us")).distinct()
    spans = active_spans(usps, activity).filter("first = 1").select("user_id", "start_us", "end_us")
    there = (known.join(spans, "user_id").filter((F.col("start_us") < F.col("us")) & (F.col("us") <= F.col("end_us")))
             .join(barred, ["us", "user_id"], "left_anti").select("user_id", "us"))
    rest = cut_lineage(known.join(there, ["user_id", "us"], "left_anti"))
    sized = "component_size" in names
    history = component_history(edge, known.withColumnRenamed("user_id", "node")) if sized else None
    held = feature_steps(names, usps, activity, journals, edge, history.sizes() if sized else None)
    met = candidates_in_steps(times.withColumn("metadata_id", F.col("us")), held, barred.select(
        F.col("us").alias("metadata_id"), "us", F.col("user_id").alias("cand_user")))
    found = met.select(F.col("cand_user").alias("user_id"), "us", *[e.alias(n) for n, e in features_in_steps(names).items()])
    other = user_features(rest, activity, journals, edge, False)
    if sized:
        other = other.join(history.at.select(F.col("node").alias("user_id"), "us", "component_size"), ["user_id", "us"])
    return found.unionByName(other.select("user_id", "us", *names))


def candidate_sites(ctx: DataFrame, usps: DataFrame, activity: DataFrame, edge: DataFrame, side: int = BLOCK_SIDE) -> DataFrame:
    """Contexts times the distinct sites of their candidates (cand_site), made without the candidates: a site is one while
    it has active eligible authors, unless as many of them are ruled out for the context."""
    spans = cut_lineage(active_spans(usps, activity))
    change = _changes(spans, ["site_id"]).select("site_id", "us", F.col("usps").alias("_n"))
    off = _barred_spans(ctx, usps, edge, spans).groupBy("metadata_id", "us", "site_id").agg(F.count(F.lit(1)).alias("_off"))
    gone = state_at(off, change, ["site_id"], {"_n": ("sum", F.col("_n"))}).filter(F.col("_n") == F.col("_off"))
    held = steps(change, ["site_id"], {"_n": "sum"}).filter("_n > 0").drop("_n").withColumnRenamed("site_id", "user_id")
    met = candidates_in_steps(ctx, held, gone.select("metadata_id", "us", F.col("site_id").alias("cand_user")), side)
    return met.withColumnRenamed("cand_user", "cand_site")
