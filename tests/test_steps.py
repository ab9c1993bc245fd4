"""Candidates met by steps of state: equal to joins of a row for each candidate."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from peerspark.functions import vectors as VE
from peerspark.operators import contexts as C, features as FE, graph as G, likeness as LI, scoring as SC, state as S, steps as ST
from peerspark.plans.ranking import Ranking

DATA = "/root/testdata/sf0.001"
QUADRATIC = {"candidates", "users", "full_users", "pair_flags", "sites", "site_scores", "ranks"}


@pytest.fixture(scope="module")
def world(spark):
    return Ranking.of(spark, DATA)


def rows(df):
    return sorted(tuple(r) for r in df.select(*sorted(df.columns)).collect())


def test_steps_are_states_between_changes(spark):
    day = 86_400_000_000
    changes = spark.createDataFrame([(1, 5, 1, 5), (1, 5, 1, 5), (1, 3 * day, -1, None), (2, 7, 1, 7)], "k long, us long, n long, t long")
    got = ST.steps(changes, ["k"], {"n": "sum", "t": "max"})
    assert rows(got.select(F.col("from_us").alias("a"), F.col("to_us").alias("b"), F.col("k").alias("c"), F.col("n").alias("d"), F.col("t").alias("e"))) == [
        (5, 3 * day, 1, 2, 5), (7, ST.FOREVER, 2, 1, 7), (3 * day, ST.FOREVER, 1, 1, 5)]


@pytest.mark.parametrize("model", SC.BASELINES)
def test_baselines_in_steps_equal_those_of_candidate_rows(spark, world, model):
    fresh = Ranking(spark, DATA)
    got = fresh.model_scores(model)
    want = world.wide.select("metadata_id", "cand_user", "cand_site", "is_target", model)
    assert rows(got) == rows(want) and want.count() > 50
    assert not QUADRATIC & set(fresh.__dict__)


def test_label_counts_and_uses_of_updates_need_no_candidates(spark, world):
    fresh = Ranking(spark, DATA)
    got = C.label_counts(fresh.eligible, fresh.usps, fresh.targets, fresh.activity, fresh.edges)
    u = world.users.select(F.col("user_id").alias("cand_user"), "us", (F.col("indegree") > 0).cast("int").alias("received"), (F.col("outdegree") > 0).cast("int").alias("made"))
    want = world.candidates.join(u, ["cand_user", "us"]).groupBy(F.col("is_target").alias("label"), "received", "made").agg(F.count("*").alias("n"))
    assert rows(got) == rows(want) and got.count() > 1
    uses = C.uses_of_updates(fresh.eligible, fresh.usps, fresh.targets, fresh.activity, fresh.edges, fresh.journals)
    pts = world.candidates.select("us", F.col("cand_user").alias("user_id"), F.col("cand_site").alias("site_id")).unionByName(
        C.source_usps(world.eligible, world.usps).select("us", F.col("source").alias("user_id"), F.col("source_site").alias("site_id"))).distinct()
    every = S.last_k_updates(pts, world.journals).groupBy("journal_oid").agg(F.count(F.lit(1)).alias("n_uses"))
    assert rows(uses) == rows(every) and every.count() > 10
    assert not QUADRATIC & set(fresh.__dict__)


def test_flags_of_candidates_equal_those_of_pairs(spark, world):
    fresh = Ranking(spark, DATA)
    flags = ["is_reciprocal", "is_mutual_fof"]
    want = G.reciprocal(G.mutual_fof(world.pairs, world.edges), world.edges).drop("us")
    assert rows(fresh.flagged_pairs(*flags)) == rows(want) and want.count() > 30
    assert not QUADRATIC & set(fresh.__dict__)


def test_components_are_ranges_of_places_at_any_time(spark):
    edges = [(5, 9, 1), (7, 8, 1), (8, 9, 3), (2, 3, 3), (1, 3, 5), (4, 4, 2), (3, 7, 9), (6, 1, 9), (20, 21, 4), (30, 31, 50)]
    edge = spark.createDataFrame(edges, "src long, dst long, edge_us long")
    times, people = (1, 2, 4, 6, 10), sorted({n for e in edges for n in e[:2]} | {99})
    wanted = spark.createDataFrame([(n, t) for n in people for t in times], "node long, us long")
    h = G.component_history(edge, wanted)
    place = {r.node: (r.root, r.place) for r in h.places.collect()}
    at = h.at.collect()
    assert rows(h.at.select("node", "us", "component", "component_size")) == rows(G.components_at_times(edge, wanted)) and len(at) == len(people) * len(times)
    label = {(r.node, r.us): r.component for r in at}
    for r in at:
        inside = {n for n in people if place.get(n, (n, 0))[0] == r.root and r.low <= place.get(n, (n, 0))[1] < r.high}
        assert inside == {n for n in people if label[n, r.us] == r.component}
    size = {(r.node, r.us): r.component_size for r in at}
    grown = h.sizes().collect()
    for n in people:
        for t in times:
            assert max([g.component_size for g in grown if g.node == n and g.us < t], default=1) == size[n, t]


def test_user_features_at_candidates_equal_those_of_points(spark, world):
    fresh = Ranking(spark, DATA)
    names = [f for f in FE.USER_FEATURES if f != "component_size"]
    got = ST.features_at_candidates(fresh.eligible, fresh.targets, fresh.usps, fresh.activity, fresh.journals, fresh.edges, names)
    assert rows(got) == rows(world.users.select("user_id", "us", *names)) and got.count() > 30
    cols = [F.col("user_id").alias("cand_user"), "us", *names]
    pairs = world.pairs.join(world.users.select(*cols), ["cand_user", "us"])
    assert rows(fresh.candidate_features(names)) == rows(pairs)
    assert not QUADRATIC & set(fresh.__dict__)


def test_site_scores_ranks_and_sites_come_from_blocks(spark, world):
    fresh = Ranking(spark, DATA)
    assert rows(fresh.block_scores) == rows(world.site_scores)
    small = replace(fresh.site_ranks, side=(20, 7), cells=900, at_once=6)
    want = rows(SC.by_model_ranked(world.ranks, SC.BASELINES).select("model", "metadata_id", "site_id", "rnk"))
    assert rows(fresh.site_ranks.ranks(SC.BASELINES)) == rows(small.ranks(SC.BASELINES)) == want
    sites = ST.candidate_sites(fresh.eligible, fresh.usps, fresh.activity, fresh.edges).select("metadata_id", "cand_site")
    assert rows(sites) == rows(world.candidates.filter("is_target = 0").select("metadata_id", "cand_site").distinct())
    assert not QUADRATIC & set(fresh.__dict__)


@pytest.mark.parametrize("kind", ["cosine", "l2"])
def test_similarity_in_blocks_equals_that_of_rows(spark, world, kind):
    digits = lambda c: F.transform(F.split(c.cast("string"), ""), lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0)))
    vector = lambda c: F.slice(F.concat(digits(c), F.array_repeat(F.lit(0.0), 4)), 1, 4)
    ctx = world.eligible.withColumn("_va", vector(F.col("source"))).withColumn("_la", VE.norm("_va"))
    of_pair = world.usps.select("user_id", "site_id", vector(F.col("user_id") + F.col("site_id")).alias("_vb")).withColumn("_lb", VE.norm("_vb"))
    cand = world.candidates.filter("is_target = 0").join(ctx.select("metadata_id", "_va"), "metadata_id").join(
        of_pair.select(F.col("user_id").alias("cand_user"), F.col("site_id").alias("cand_site"), "_vb"), ["cand_user", "cand_site"])
    want = rows(SC.similarity(cand, "_va", "_vb", kind).select("metadata_id", "cand_user", "cand_site", "score"))
    for side, at_once in ((1024, 128), (7, 3)):
        got = LI.candidate_similarity(ctx, of_pair, world.usps, world.activity, world.edges, kind, side, at_once)
        assert rows(got) == want and len(want) > 20
