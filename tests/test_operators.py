"""Small golden cases and invariants."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from peerspark.functions.draws import draw
from peerspark.functions import text as TX
from peerspark.operators import (batches as B, clicks as K, contexts as C, effects as E, evaluate as EV, graph as G, prep as P, preprocess as M,
                                 reshape as R, scoring as SC, state as S, survival as V, text as T)
from peerspark.operators.prefix import (US_PER_DAY, US_PER_HOUR, grouped_quantiles, prefix_aggregate, running_number, state_at, time_bucket,
                                        value_bucket, window_state_at)


def test_ties_get_the_worst_rank(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 0.5), (1, "c", 0.5), (1, "d", 0.0)], "k long, s string, score double")
    assert {x.s: x.rnk for x in SC.rank_worst_ties(df, ["k"]).collect()} == {"a": 1, "b": 3, "c": 3, "d": 4}


def test_target_ranks_agree_with_full_ranking(spark):
    rnd = random.Random(2)
    rows = [(c, s, int(s in (3, 7)), float(rnd.randrange(6)), rnd.random() - 0.5) for c in range(5) for s in range(20)]
    df = spark.createDataFrame(rows, "metadata_id long, site_id long, is_target long, A double, B double")
    fast = {(x.metadata_id, x.model): (x.target_rank, x.target_score) for x in SC.target_ranks(df, ["A", "B"], ["metadata_id"]).collect()}
    full = SC.target_metrics(SC.rank_worst_ties(SC.by_model(df, ["A", "B"]), ["model", "metadata_id"]), ["model", "metadata_id"])
    assert fast == {(x.metadata_id, x.model): (x.target_rank, x.target_score) for x in full.collect()}


def test_coverage_of_one_ranking(spark):
    df = spark.range(2000).select(F.col("id").alias("site_id"), (F.col("id") + 1).alias("rank_m"))
    for x in EV.site_coverage(df, ["m"]).filter("site_id in (0, 4, 5, 1999)").collect():
        assert (x.n, x.mean, x.best, x.worst, x.var) == (1, x.site_id + 1, x.site_id + 1, x.site_id + 1, 0)
        assert x.n_top_5 == int(x.site_id < 5) and x.n_top_1000 == int(x.site_id < 1000)


def test_window_lower_bound_is_closed_upper_open(spark):
    w, t = 7 * US_PER_DAY, 100 * US_PER_DAY
    ev = spark.createDataFrame([(1, t - w), (1, t - w - 1), (1, t - 1), (1, t)], "k long, us long")
    out = window_state_at(spark.createDataFrame([(1, t)], "k long, us long"), ev, ["k"], {"n": F.lit(1).cast("long")}).first()
    assert out.n == 2


def test_hot_key_prefix_equals_brute_force(spark):
    rnd = random.Random(0)
    rows = [(0 if rnd.random() < 0.6 else rnd.randrange(5), rnd.randrange(40 * 24) * US_PER_HOUR, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, us long, i long")
    got = {x.i: (x.n, x.m) for x in state_at(df, df, ["k"], {"n": ("sum", F.lit(1).cast("long")), "m": ("max", F.col("us"))}).collect()}
    for k, us, i in rows[::37]:
        before = [u for kk, u, _ in rows if kk == k and u < us]
        assert got[i] == (len(before), max(before, default=None))
    num = running_number(df, [], time_bucket("us"), ["us", "i"]).orderBy("us", "i").collect()
    assert [x.rn for x in num] == list(range(1, 3001))


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(1)
    vals = [(int(g), float(v)) for g in range(3) for v in np.concatenate([rng.normal(0, 10 ** g, 501), np.repeat(0.0, 200), [1e12, -1e9]])]
    df = spark.createDataFrame(vals, "g long, v double")
    for x in grouped_quantiles(df, ["g"], "v", {"a": 0.025, "b": 0.5, "c": 0.9, "d": 1.0}).collect():
        mine = [v for g, v in vals if g == x.g]
        assert np.allclose([x.a, x.b, x.c, x.d], np.quantile(mine, [0.025, 0.5, 0.9, 1.0]))


def test_last_three_updates_include_the_instant(spark):
    j = spark.createDataFrame([(i, 1, 1, i * 10) for i in range(1, 6)], "event_id long, user_id long, site_id long, us long")
    pts = spark.createDataFrame([(1, 1, 40), (1, 1, 5), (1, 1, 20)], "user_id long, site_id long, us long")
    got = sorted((x.us, x.pos, x.journal_oid) for x in S.last_k_updates(pts, j).collect())
    assert got == [(20, 1, 1), (20, 2, 2), (40, 1, 2), (40, 2, 3), (40, 3, 4)]


def test_forced_most_recent_target(spark):
    d = US_PER_DAY
    rows = [(i, u, 9, (u * 5 + i) * d) for u in (1, 2) for i in range(3)]
    j = spark.createDataFrame([(n, *r[1:]) for n, r in enumerate(rows)], "event_id long, user_id long, site_id long, us long")
    ctx = spark.createDataFrame([(77, 5, 9, 90 * d)], "metadata_id long, source long, target_site long, us long")
    out = C.adjusted_targets(ctx, S.usp_state(j), j, j.withColumn("atype", F.lit("journal")), 50 * d).collect()
    assert [(x.target_user, x.adjustment) for x in out] == [(2, "forced_most_recent_user")]


def test_components_on_a_long_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(200)]
    hub = [(1000, 1001 + i) for i in range(300)]
    comp = G.component_sizes(G.components(spark.createDataFrame(path + hub, "src long, dst long"))).collect()
    assert {x.component for x in comp if x.node <= 200} == {0} and {x.component_size for x in comp if x.node >= 1000} == {301}


def test_negative_samples_are_candidates_and_reproducible(spark):
    cands = spark.createDataFrame([(m, u, u * 10, 0) for m in range(3) for u in range(20)] + [(m, 99, 5, 1) for m in range(3)],
                                  "metadata_id long, cand_user long, cand_site long, is_target long")
    pairs = spark.createDataFrame([(m, s, 99, 5) for m in range(3) for s in range(4)], "metadata_id long, source_site long, target_user long, target_site long")
    a, b = (sorted(map(tuple, C.sample_alternatives(p, c).collect())) for p, c in ((pairs, cands), (pairs.repartition(3), cands.repartition(5))))
    assert a == b and len(a) == 12 and all(x[5] == x[4] * 10 and x[4] != 99 for x in a)
    assert len({x[4] for x in a}) > 3


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_draft_equals_serial_picking(spark, seed):
    rnd = random.Random(seed)
    people, sites = 14, 9
    prefs = [(p, s, float(rnd.randrange(12))) for p in range(people) for s in range(sites) if rnd.random() < 0.8]
    df = spark.createDataFrame(prefs, "participant_id long, site_id long, score double")
    got = B.draft(df, capacity=3, picks=2, seed=seed, turn_block=1 + 4 * seed).collect()
    order = {}
    for r in (1, 2):
        h = spark.range(people).select("id", draw(f"{seed}-{r}", "id").alias("h")).collect()
        order[r] = [x.id for x in sorted(h, key=lambda x: (x.h, x.id))]
    room, mine, want = {s: 3 for s in range(sites)}, {p: set() for p in range(people)}, set()
    for r in (1, 2):
        for p in order[r]:
            free = sorted([(-sc, s) for q, s, sc in prefs if q == p and s not in mine[p]])
            ok = [x for x in free if room[x[1]] > 0]
            if ok:
                sc, s = ok[0]
                room[s] -= 1
                mine[p].add(s)
                want.add((p, r, s, round(sc - free[0][0], 9)))
    assert {(x.participant_id, x["round"], x.site_id, round(x.incurred_loss, 9)) for x in got} == want


def test_draft_of_equal_preferences_ends_after_its_blocks(spark):
    """20 000 participants who all rank the sites alike: the first take the best site, and so on."""
    n, sites, room = 20_000, 25, 900
    df = spark.range(n).select(F.col("id").alias("participant_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sites - 1).cast("long"))).alias("site_id"))
    limits = spark.createDataFrame([(s, room) for s in range(sites - 1)] + [(3, None)], "site_id long, capacity int").filter("site_id <> 3 or capacity is null")
    got = B.draft(df.withColumn("score", -F.col("site_id").cast("double")), capacity=limits, picks=1, turn_block=8000).groupBy("site_id").count().collect()
    assert {r["site_id"]: r["count"] for r in got} == {0: room, 1: room, 2: room, 3: n - 3 * room}


def test_right_closed_bins_and_unknown_ids(spark):
    df = spark.createDataFrame([(1.0,), (1.5,), (24.0,), (30.0,)], "x double")
    out = [tuple(r) for r in M.one_hot(df, "x", [1, 24]).collect()]
    assert out == [(1, 0, 0), (0, 1, 0), (0, 1, 0), (0, 0, 1)]
    ids = spark.createDataFrame([(1,), (1,), (2,), (3,), (3,)], "i long")
    got = {x.i: x.i_index for x in M.index_ids(ids, "i", 1).collect()}
    assert got[2] == 0 and {got[1], got[3]} == {1, 2}


def test_feature_selectors():
    names = M.feature_names(2)
    assert len(names) == 12 * 2 + 3 + 4
    assert M.select_features(names, ["candidate", "network"]) == ["candidate_indegree", "candidate_outdegree", "candidate_component_size"]
    assert M.select_features(names, ["pair", "*"]) == ["pair_is_weakly_connected", "pair_is_mutual_fof", "pair_is_reciprocal"]
    assert all(not n.startswith("source") for n in M.select_features(names, ["~source", "*"]))
    assert len(M.select_features(names, ["source", "activity"])) == 9
    with pytest.raises(ValueError):
        M.select_features(names, "nothing")


def test_return_visits_count_from_the_first(spark):
    v = spark.createDataFrame([(1, 1, h * US_PER_HOUR) for h in (0, 6, 8)], "user_id long, site_id long, us long")
    assert K.return_visits(v, [7]).first().n_return_7h == 1


def test_batch_from_campaign(spark):
    cols = ["event_id", "date", "time", "method", "uri", "query_string"]
    rows = [(1, "2024-01-02", "03:04:05", "GET", "/visit/some", "utm_campaign=SSE+email+3"), (2, "2024-01-02", "03:04:05", "GET", "/visit/x/y", "utm_campaign=SSE+email"),
            (3, "2024-01-02", "03:04:05", "HEAD", "/visit/x", "a=b")]
    got = {x.event_id: (x.batch_id, x.site_name) for x in K.parse_click_log(spark.createDataFrame(rows, cols)).collect()}
    assert got == {1: (3, "some"), 2: (0, "x")}


def test_author_types(spark):
    rows = [(u, 1, "p" if i < n else "cg") for u, n, m in ((1, 8, 10), (2, 2, 10), (3, 19, 100)) for i in range(m)]
    got = {x.user_id: x.author_type for x in T.author_types(spark.createDataFrame(rows, "user_id long, site_id long, role string")).collect()}
    assert got == {1: "p", 2: "shared", 3: "cg"}


def test_kaplan_meier_by_hand(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 0), ("a", 3, 1), ("a", 3, 1)], "g string, t int, e int")
    got = [(x.t, x.n_at_risk, round(x.survival, 6)) for x in V.kaplan_meier(df, ["g"], "t", "e").orderBy("t").collect()]
    assert got == [(1.0, 4, 0.75), (2.0, 3, 0.75), (3.0, 2, 0.0)]


def test_local_time_honours_daylight_saving(spark):
    us, tag = P.local_to_us("s")
    df = spark.createDataFrame([("2016-07-01 12:00:00",), ("2016-01-01 12:00:00",), ("-0001-11-30 00:00:00",), (None,)], "s string").select(
        F.timestamp_micros(us).cast("string").alias("t"), tag.alias("tag"))
    assert [tuple(x) for x in df.collect()] == [("2016-07-01 17:00:00", "ok"), ("2016-01-01 18:00:00", "ok"), (None, "invalid"), (None, "missing")]


def test_join_contract_is_enforced(spark):
    left, right = spark.createDataFrame([(1, "a")], "k long, v string"), spark.createDataFrame([(1, 2), (1, 3)], "k long, w long")
    with pytest.raises(Exception, match="many_to_one violated"):
        P.join_validated(left, right, ["k"]).collect()
    assert P.join_validated(left, right.limit(1), ["k"]).count() == 1


def test_batches_hold_no_duplicate_recommendation(spark):
    from peerspark.plans import fixtures as X
    recs = X.recommendations(spark, "/root/testdata/sf0.001")
    assert R.duplicate_recommendations(recs).count() == 0 and recs.count() > 0


def test_html_and_preview(spark):
    df = spark.createDataFrame([("<p>a &amp; b<br>c</p><b>d</b>", "see http://x.y/z now\tand ok.go " + "w" * 200)], "h string, t string")
    x = df.select(TX.strip_html("h").alias("h"), TX.preview("t").alias("p")).withColumn("s", TX.suspicious_link("p")).first()
    assert x.h == "a & b\ncd" and x.p.startswith("see [link] now and ok.go w") and x.p.endswith(" ...") and x.s


def test_effects_equal_numpy_and_recover_the_truth(spark):
    rng = np.random.default_rng(7)
    n = 4000
    x = rng.normal(size=n)
    a = (rng.random(n) < 1 / (1 + np.exp(-0.8 * x))).astype(int)
    y = 2.0 * a + 1.5 * x + rng.normal(size=n)
    df = spark.createDataFrame([("g", i, float(x[i]), int(a[i]), float(y[i])) for i in range(n)], "g string, id long, x double, a int, y double")
    e = E.effect_estimates(df, ["g"], "y", "a", ["x"]).first()
    X = np.column_stack([np.ones(n), a, x])
    assert e.ols == pytest.approx(np.linalg.lstsq(X, y, rcond=None)[0][1], abs=1e-8)
    assert e.raw == pytest.approx(y[a == 1].mean() - y[a == 0].mean(), abs=1e-9)
    assert abs(e.raw - 2) > 0.5 and abs(e.ols - 2) < 0.1 and abs(e.ipw - 2) < 0.2 and abs(e.dr - 2) < 0.15 and e.status == "ok"
    b = E.bootstrap_effects(df, ["g"], ["id"], "y", "a", ["x"], replicates=20).first()
    assert b.n_bootstraps == 20 and b.ols_lower < e.ols < b.ols_upper


def test_replicates_equal_estimates_of_weighted_rows(spark):
    """Each replicate is what the estimator gives on rows with that replicate's weights, in one batch or several."""
    rng = np.random.default_rng(9)
    rows = [(g, i, *(float(v) for v in rng.normal(size=2)), int(rng.random() < (0.4, 0.06)[g]), float(rng.normal())) for g in range(2) for i in range(60)]
    df = spark.createDataFrame(rows, "g int, id long, x double, z double, a int, y double")
    keys = {(0,): 0, (1,): 1}
    base = df.select("g", F.col("g").alias("_group"), draw(5, "id", "g").alias("_seed"), F.col("a").cast("double").alias("_a"), F.col("y").alias("_y"),
                     F.col("x").alias("_x0"), F.col("z").alias("_x1")).repartition(3).cache()
    got = {(r.g, r.replicate): r for first, last in ((1, 2), (3, 6)) for r in E._replicate_effects(base, ["g"], ["x", "z"], keys, first, last).collect()}
    seeds = {(r.g, r.id): r.s for r in df.select("g", "id", draw(5, "id", "g").alias("s")).collect()}
    w = E.replicate_weights(np.array([seeds[r[:2]] for r in rows]), 1, 6)
    weighted = spark.createDataFrame([(*r, k + 1, float(w[i, k])) for i, r in enumerate(rows) for k in range(6) if w[i, k]],
                                     "g int, id long, x double, z double, a int, y double, replicate int, w double")
    want = E.effect_estimates(weighted, ["g", "replicate"], "y", "a", ["x", "z"], "w").collect()
    assert len(want) == len(got) == 12
    for e in want:
        r = got[e.g, e.replicate]
        assert r.status == e.status
        for m in ("raw", "ols", "ipw", "dr"):
            if e.status == "ok":
                assert r[m] == pytest.approx(e[m], rel=1e-6, abs=1e-9)
    big = E.replicate_weights(np.arange(500, dtype=np.int64) * 7919, 1, 1000)
    assert abs(big.mean() - 1) < 0.01 and abs(big.var() - 1) < 0.01 and abs(np.corrcoef(big[:, :40].T)[np.triu_indices(40, 1)]).max() < 0.25


def test_replicate_weights_by_table_are_the_drawn_ones_and_only_those_asked_for():
    seeds = np.arange(3000, dtype=np.int64) * 104729
    z = seeds.astype(np.uint64)[:, None] + np.arange(1, 201, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    want = np.searchsorted(E._POISSON, ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0 ** -53, "right")
    assert (E.replicate_weights(seeds, 1, 200) == want).all()
    on = np.arange(200) % 3 == 1
    assert (E.replicate_weights(seeds, 1, 200, on) == want[:, on]).all() and (E.replicate_weights(seeds, 0, 2)[:, 0] == 1).all()


def test_effect_table_has_every_outcome_covariate_and_replicate(spark, monkeypatch):
    from peerspark.plans import causal
    asked = {}
    monkeypatch.setattr(causal, "outcome_rows", lambda spark, d, fronts: fronts)
    monkeypatch.setattr(causal, "long_rows", lambda wide, outcomes: (wide, outcomes))
    monkeypatch.setattr(causal.E, "bootstrap_effects", lambda rows, groups, row_id, y, arm, covariates, replicates: asked.update({len(asked): (rows, covariates, replicates)}))
    for name in ("q11_bootstrap_intervals", "q12_effect_table"):
        causal.query.__globals__["QUERIES"][name](spark, "/root/testdata/sf0.001")  # windows follow from its events
    for (fronts, outcomes), covariates, replicates in asked.values():
        assert outcomes == causal.OUTCOMES and covariates == causal.COVARIATES and replicates == 1000
    assert asked[0][0][0] == [7] and asked[1][0][0] == [7, 14, 21, 28, 35]


def test_poisson_fit_and_separated_data(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=3000)
    y = rng.poisson(np.exp(0.3 + 0.5 * x))
    df = spark.createDataFrame([("g", float(p), int(q)) for p, q in zip(x, y)], "g string, x double, y int")
    fit = {r.term: r for r in E.poisson_rates(df, ["g"], "y", ["x"]).collect()}
    assert fit["x"].coef == pytest.approx(0.5, abs=0.05) and 0 < fit["x"].se < 0.05
    sep = spark.createDataFrame([("g", float(i), int(i >= 5), float(i)) for i in range(10)], "g string, x double, a int, y double")
    assert E.effect_estimates(sep, ["g"], "y", "a", ["x"]).first().status == "failed"
    assert E.fit_glm(df, ["g"], "y", ["x"], "poisson", steps=1).first()["_fit"] == "not_converged"


def test_rare_arm_is_fitted_and_only_separated_data_fails(spark):
    rare = spark.range(100000).select(F.lit("g").alias("g"), (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 25000 == 3).cast("int").alias("a"),
                                      (F.col("id") % 11).cast("double").alias("y"))
    e = E.effect_estimates(rare, ["g"], "y", "a", ["x"]).first()
    assert e.status == "ok" and e.ipw is not None and e.dr is not None
    fit = E.fit_glm(rare, ["g"], "a", ["x"], "logit").first()
    x, a = (np.array(c) for c in zip(*[(r.x, r.a) for r in rare.select("x", "a").collect()]))
    design = np.column_stack([np.ones(len(x)), x])
    assert fit["_fit"] == "ok" and np.abs(design.T @ (a - 1 / (1 + np.exp(-design @ np.array(fit["_beta"]))))).max() < 1e-6
    # folds without a fit stay as rows
    sep = spark.createDataFrame([(i, float(i), int(i >= 30)) for i in range(60)], "id long, x double, a int")
    folds = E.kfold_auc(sep, ["id"], "a", ["x"]).collect()
    assert {r.fold for r in folds} == set(range(5)) and sum(r.n for r in folds) == 60
    assert all(r.auc is None and r.status == "failed" for r in folds)


def test_skewed_poisson_fit_runs_until_it_converges(spark):
    rng = np.random.default_rng(5)
    x = np.append(rng.normal(size=200), [40.0, 60.0])
    y = np.append(rng.poisson(0.3, size=200), [400, 90_000])
    fit = E.fit_glm(spark.createDataFrame([("g", float(p), int(q)) for p, q in zip(x, y)], "g string, x double, y int"), ["g"], "y", ["x"], "poisson").first()
    design = np.column_stack([np.ones(len(x)), x])
    score = design.T @ (y - np.exp(design @ np.array(fit["_beta"])))
    assert fit["_fit"] == "ok" and np.abs(score).max() < 1e-3 * y.sum()


def test_sites_of_batches_without_clicks_stay(spark):
    att = spark.createDataFrame([(1, 1, 10, 0, 5, 100, 1), (1, 1, 11, 0, 5, -1, 0), (2, 2, 12, 0, 5, -1, 0), (3, 2, 13, 0, 5, -1, 0), (3, 3, 13, 0, 5, 300, 1)],
                                "participant_id long, batch_id long, site_id long, rank long, sent_us long, first_click_us long, was_clicked int")
    got = {r["site_id"]: (r["batch_id"], r["first_click_us"], r["status"]) for r in K.impute_click_times(K.collapse_sites(att), att).collect()}
    assert got == {10: (1, 100, "clicked"), 11: (1, 100, "filled"), 12: (2, -1, "unfilled"), 13: (2, 300, "clicked")}


def test_poisson_weights_have_mean_and_variance_one(spark):
    s = spark.range(200000).select(E.poisson_one("id").alias("w")).agg(F.avg("w"), F.variance("w")).first()
    assert abs(s[0] - 1) < 0.02 and abs(s[1] - 1) < 0.03


def test_value_bucket_is_monotone(spark):
    vals = sorted([-1e12, -5.0, -0.1, 0.0, 1e-9, 0.3, 1.0, 1.0001, 77.0, 1e15])
    got = [x.b for x in spark.createDataFrame([(v,) for v in vals], "v double").select("v", value_bucket(F.col("v")).alias("b")).orderBy("v").collect()]
    assert got == sorted(got)
