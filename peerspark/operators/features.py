"""User, pair and model-row features at a point in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from . import contexts, graph
from .prefix import US_PER_HOUR
from .state import ACTIVITY_TYPES, first_update, rolling_activity

USER_FEATURES = ["indegree", "outdegree", "component_size",
                 *[c for a in ACTIVITY_TYPES for c in (f"n_{a}", f"hours_{a}")], "hours_first_update"]
PAIR_FEATURES = ["is_weakly_connected", "is_mutual_fof", "is_reciprocal"]


def _hours(us: Column) -> Column:
    """Hours from an earlier time to the row's time; 0 when there is none."""
    return F.coalesce(F.greatest(F.col("us") - us, F.lit(0)) / F.lit(float(US_PER_HOUR)), F.lit(0.0))


def user_features(points: DataFrame, activity: DataFrame, journals: DataFrame, edge: DataFrame,
                  with_components: bool = True) -> DataFrame:
    """Network, recent-activity and tenure columns for each distinct (user_id, us); component_size is left
    out without ``with_components``."""
    pts = cut_lineage(points.select("user_id", "us").distinct())
    rolled = rolling_activity(pts, activity, ["user_id"])
    deg = graph.degrees_at(pts, edge)
    out = rolled.join(deg, ["user_id", "us"]).join(first_update(journals), "user_id", "left")
    if with_components:
        comp = graph.components_at_times(edge, pts.withColumnRenamed("user_id", "node"))
        out = out.join(comp.withColumnRenamed("node", "user_id"), ["user_id", "us"])
    return out.select(
        "user_id", "us", "indegree", "outdegree", *["component_size"] * with_components,
        *[c for a in ACTIVITY_TYPES for c in (F.col(f"n_{a}"), _hours(F.col(f"last_{a}_us")).alias(f"hours_{a}"))],
        _hours(F.col("first_update_us")).alias("hours_first_update"), "first_update_us")


def pair_features(pairs: DataFrame, edge: DataFrame) -> DataFrame:
    """The three network flags of each (source, cand_user, us)."""
    flagged = graph.reciprocal(graph.mutual_fof(pairs, edge), edge)
    return graph.weakly_connected(cut_lineage(flagged), edge)


def candidate_flags(ctx: DataFrame, targets: DataFrame, usps: DataFrame, activity: DataFrame, edge: DataFrame,
                    flags: list[str] = PAIR_FEATURES) -> DataFrame:
    """``flags`` of PAIR_FEATURES for all candidates and targets of contexts: (metadata_id, source, cand_user, us, flags), as
    ``pair_features`` of their rows. A context brings the users who have a flag, and the range of its source's
    component among the users' places, so pairs pass no exchange and are not kept.
    """
    own = contexts.target_rows(ctx, targets).select("metadata_id", "source", "cand_user", "us")
    marks, of_user = {}, None
    at = ctx.select("metadata_id", "source", "us")
    if "is_reciprocal" in flags:
        back = edge.select(F.col("dst").alias("source"), F.col("src").alias("cand_user"), "edge_us")
        marks["is_reciprocal"] = at.join(back, "source").filter(F.col("edge_us") < F.col("us")).select("metadata_id", "us", "cand_user")
        own = graph.reciprocal(own, edge)
    if "is_mutual_fof" in flags:
        both = graph.mutual_fof_times(ctx, edge).withColumnRenamed("us", "_m")
        marks["is_mutual_fof"] = at.join(both, "source").filter(F.col("_m") < F.col("us")).select("metadata_id", "us", "cand_user")
        own = graph.mutual_fof(own, edge)
    if "is_weakly_connected" in flags:
        history = graph.component_history(edge, at.select(F.col("source").alias("node"), "us"))
        of_user = history.places.select(F.col("node").alias("user_id"), F.col("root").alias("_root"), F.col("place").alias("_place"))
        range_ = history.at.select(F.col("node").alias("source"), "us", F.col("root").alias("_of"), "low", "high")
        ctx = ctx.join(range_, ["source", "us"])
        own = own.join(range_, ["source", "us"]).join(of_user.withColumnRenamed("user_id", "cand_user"), "cand_user", "left")
    found = contexts.candidate_users(ctx, usps, activity, edge, marks={k: marks[k] for k in marks}, of_user=of_user)
    same = (F.col("_root") == F.col("_of")) & (F.col("_place") >= F.col("low")) & (F.col("_place") < F.col("high")) & (F.col("source") != F.col("cand_user"))
    value = lambda f: (F.coalesce(same, F.lit(False)).cast("long") if f == "is_weakly_connected" else F.col(f)).alias(f)
    cols = ["metadata_id", "source", "cand_user", "us"]
    return found.select(*cols, *[value(f) for f in flags]).unionByName(own.select(*cols, *[value(f) for f in flags]))


def vector(cols: list[str]) -> Column:
    return F.array(*[F.col(c).cast("float") for c in cols])


def model_rows(cands: DataFrame, users: DataFrame, pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Source user ++ candidate user ++ pair ++ source text ++ candidate text, one array per row.

    ``texts`` has (user_id, site_id, us, text_vec). Candidates without text are dropped; a target
    without text raises when the row is evaluated.
    """
    vec = users.select("user_id", "us", vector(USER_FEATURES).alias("v"))
    src = vec.select(F.col("user_id").alias("source"), "us", F.col("v").alias("source_vec"))
    cnd = vec.select(F.col("user_id").alias("cand_user"), "us", F.col("v").alias("cand_vec"))
    pr = pairs.select("metadata_id", "cand_user", vector(PAIR_FEATURES).alias("pair_vec"))
    st = texts.select(F.col("user_id").alias("source"), F.col("site_id").alias("source_site"), "us",
                      F.col("text_vec").alias("source_text"))
    ct = texts.select(F.col("user_id").alias("cand_user"), F.col("site_id").alias("cand_site"), "us",
                      F.col("text_vec").alias("cand_text"))
    j = (cands.join(src, ["source", "us"]).join(cnd, ["cand_user", "us"]).join(pr, ["metadata_id", "cand_user"])
         .join(st, ["source", "source_site", "us"]).join(ct, ["cand_user", "cand_site", "us"], "left"))
    checked = F.when(F.col("cand_text").isNull() & (F.col("is_target") == 1),
                     F.raise_error(F.lit("target without text")).cast("array<float>")).otherwise(F.col("cand_text"))
    return (j.withColumn("cand_text", checked).filter(F.col("cand_text").isNotNull())
            .select("metadata_id", "source_site", "cand_user", "cand_site", "is_target",
                    F.concat("source_vec", "cand_vec", "pair_vec", "source_text", "cand_text").alias("features")))
