"""Hot keys, heavy nodes and wide rankings: same results however rows are dealt."""

import random

import pytest
from pyspark.sql import functions as F

from peerspark.operators import clicks as K, contexts as C, effects as E, graph as G, outcomes as O, scoring as SC
from peerspark.operators.prefix import US_PER_DAY, Depth, prefix_aggregate, state_at

MINUTE = 60_000_000


def hot_rows(n=20_000):
    """90 % of key 0 within one minute."""
    rnd = random.Random(1)
    return [(0, 10**15 + rnd.randrange(MINUTE), i) if rnd.random() < 0.9 else (rnd.randrange(4), 10**15 + rnd.randrange(40 * US_PER_DAY), i) for i in range(n)]


def test_buckets_follow_the_data(spark):
    df = spark.createDataFrame(hot_rows(), "k long, us long, i long")
    placed = Depth(F.col("us"), US_PER_DAY, 500).place(df, ["k"])
    largest = placed.groupBy("k", "_bucket").count().agg(F.max("count")).first()[0]
    assert placed.count() == 20_000 and largest <= 2 * 500
    assert Depth(F.col("us"), US_PER_DAY, 10**6).place(df, ["k"]).groupBy("k", "_bucket").count().agg(F.max("count")).first()[0] > 15_000
    back = placed.filter((F.col("_bucket") > F.col("us")) | (F.col("us") - F.col("_bucket") >= US_PER_DAY))
    assert back.isEmpty()


@pytest.mark.parametrize("keys", [["k"], []])
def test_depth_keeps_running_results(spark, keys):
    df = spark.createDataFrame(hot_rows(6000) + [(None, 5, -1), (None, 7, -2)], "k long, us long, i long").dropDuplicates(["us"])
    rows = df.collect() if not keys else df.filter("k is not null").collect()
    src = df if not keys else df.filter("k is not null")
    got = prefix_aggregate(src, keys, Depth(F.col("us"), US_PER_DAY, 100), ["us"], {"n": ("sum", F.lit(1).cast("long")), "last": ("max", F.col("us"))}).collect()
    rows.sort(key=lambda r: r["us"])
    want, seen = {}, {}
    for r in rows:
        key = r["k"] if keys else 0
        n, last = seen.get(key, (0, None))
        want[r["i"]] = (n, last)
        seen[key] = (n + 1, r["us"])
    assert {r["i"]: (r["n"], r["last"]) for r in got} == want


@pytest.mark.parametrize("inclusive", [False, True])
def test_equal_times_by_sequence(spark, inclusive):
    rnd = random.Random(2)
    ev = [(rnd.randrange(3), rnd.randrange(30), i) for i in range(400)]
    pts = [(rnd.randrange(3), rnd.randrange(30), rnd.randrange(400)) for _ in range(200)] + ev[:20]
    frame = lambda rows: spark.createDataFrame(rows, "k long, us long, event_id long")
    got = state_at(frame(sorted(set(pts))), frame(ev), ["k"], {"n": ("sum", F.lit(1).cast("long"))}, bucket_us=7, inclusive=inclusive,
                   depth=10, ties="sequence").collect()
    for r in got:
        mine = (r["us"], r["event_id"])
        assert r["n"] == sum(k == r["k"] and ((t, s) < mine or inclusive and (t, s) == mine) for k, t, s in ev)
    with pytest.raises(ValueError):
        state_at(frame(pts), frame(ev), ["k"], {}, ties="other")


def test_pre_post_counts(spark):
    rnd = random.Random(3)
    ev, pts = [(rnd.randrange(3), rnd.randrange(100)) for _ in range(300)], [(k, t) for k in range(4) for t in range(0, 100, 7)]
    got = K.pre_post(spark.createDataFrame(pts, "u long, us long"), spark.createDataFrame(ev, "u long, us long"), "u", 10, 5).collect()
    assert len(got) == len(pts)
    for r in got:
        assert (r["n_pre"], r["n_post"]) == tuple(sum(u == r["u"] and a <= t <= b for u, t in ev)
                                                 for a, b in ((r["us"] - 10, r["us"]), (r["us"], r["us"] + 5)))


def test_day_blocks_meet_every_pair_once_and_stay_small(spark):
    ctx = spark.createDataFrame([(m, m % 7, 1, 20 * US_PER_DAY + m) for m in range(300)], "metadata_id long, source long, target_site long, us long")
    days = spark.createDataFrame([(u, 20, 1, None, None) for u in range(100, 350)], "user_id long, day long, full_cover int, first_today long, last_edge long")
    whole, parts = (C._in_blocks(ctx, days, side).select("metadata_id", "user_id") for side in (10**6, 32))
    assert parts.count() == 300 * 250 and parts.exceptAll(whole).isEmpty()


def test_two_hops_through_heavy_nodes(spark):
    rnd = random.Random(4)
    edges = {(0, i): i for i in range(1, 120)} | {(i, 500): 300 - i for i in range(1, 120)} | {
        (rnd.randrange(60), rnd.randrange(60)): rnd.randrange(400) for _ in range(300)}
    edge = spark.createDataFrame([(a, b, t) for (a, b), t in edges.items()], "src long, dst long, edge_us long")
    pairs = [(0, 500), (0, 3), (500, 0), (77, 78)] + [(rnd.randrange(60), rnd.randrange(60)) for _ in range(150)]
    want = {}
    for a, b in set(pairs):
        ways = [edges[a, b]] if (a, b) in edges else []
        ways += [max(t, edges[m, b]) for (s, m), t in edges.items() if s == a and (m, b) in edges]
        if ways:
            want[a, b] = min(ways)
    frame = spark.createDataFrame(pairs, "src long, dst long")
    for part in (4096, 5):
        assert {(r["src"], r["dst"]): r["path_us"] for r in G.two_hop_times(frame, edge, part=part).collect()} == want


def test_ranks_of_many_models_at_once(spark):
    rnd = random.Random(5)
    rows = [(c, s, float(rnd.randrange(5)), rnd.random()) for c in range(4) for s in range(60 if c else 400)]
    df = spark.createDataFrame(rows, "metadata_id long, site_id long, A double, B double")
    one = SC.rank_worst_ties(SC.by_model(df, ["A", "B"]), ["model", "metadata_id"]).select("model", "metadata_id", "site_id", "rnk")
    for heavy in (1 << 20, 100):
        many = SC.by_model_ranked(SC.model_ranks(df, ["A", "B"], ["metadata_id"], heavy), ["A", "B"]).select(*one.columns)
        assert many.count() == 2 * len(rows) and many.exceptAll(one).isEmpty()


def test_dyads_of_a_hub_are_numbered_in_order(spark):
    rnd = random.Random(6)
    rows = [(0, i, "to_author", i) for i in range(1, 200)] + [(rnd.randrange(50), rnd.randrange(50, 99), "to_participant", 0) for _ in range(100)]
    got = K.undirected_dyads(spark.createDataFrame(rows, "source long, target long, direction string, event_id long")).collect()
    assert [r["dyad_id"] for r in sorted(got, key=lambda r: (r["user_a"], r["user_b"]))] == list(range(1, len(got) + 1))


def test_dyads_are_counted_once(spark):
    """Numbering reads counted pairs: the comments behind them are not derived again for each of its passes."""
    read = spark.sparkContext.accumulator(0)
    rows = spark.range(300).rdd.map(lambda r: read.add(1) or (r[0] % 30, 30 + r[0] % 7, "to_author", r[0]))
    got = K.undirected_dyads(spark.createDataFrame(rows, "source long, target long, direction string, event_id long"))
    assert got.agg(F.sum("n_comments")).first()[0] == 300 and read.value == 300


def test_point_effects_equal_the_stepwise_ones(spark):
    rnd = random.Random(7)
    rows = [(g, i, rnd.gauss(0, 1), rnd.gauss(0, 1), int(rnd.random() < 0.4)) for g in ("a", "b") for i in range(200)]
    df = spark.createDataFrame([(*r, r[4] * 2 + r[2] + rnd.random()) for r in rows], "g string, i long, u double, v double, arm int, y double")
    a = E.effect_estimates(df, ["g"], "y", "arm", ["u", "v"]).orderBy("g").collect()
    b = E.point_effects(df, ["g"], ["i"], "y", "arm", ["u", "v"]).orderBy("g").collect()
    for x, y in zip(a, b, strict=True):
        assert x["status"] == y["status"] == "ok" and [y[c] for c in ("n", "raw", "ols", "standardised", "ipw", "dr")] == pytest.approx(
            [x[c] for c in ("n", "raw", "ols", "standardised", "ipw", "dr")], rel=1e-6)


def _plain_site_outcomes(targets, journals, ints, visits, ex, days, back):
    """Outcomes by looking at every event of every window."""
    authors = {(u, s) for u, s, _ in journals}
    ints, visits = ([r for r in rows if (r[0], r[1]) not in ex] for rows in (ints, visits))
    firsts = {}
    for u, s, t in visits:
        firsts[u, s] = min(t, firsts.get((u, s), t))
    t0 = dict(targets)
    out = {}
    for d in days:
        for side in ("pre", "post"):
            reach = (lambda t: -(back or d) * US_PER_DAY <= t <= 0) if side == "pre" else (lambda t: 0 <= t <= d * US_PER_DAY)
            held = lambda rows: [r for r in rows if t0.get(r[1]) and reach(r[2] - t0[r[1]])]
            act, up, vis = held(ints), held(journals), held(visits)
            per = {}
            for u, s, _ in act:
                per[u, s] = per.get((u, s), 0) + 1
            for site in t0:
                peers = {k: n for k, n in per.items() if k[1] == site and k not in authors}
                mine = [u for u, s in authors if s == site]
                wide = [n for (u, s), n in per.items() if u in mine and s != site]
                twice = [u for u, s, _ in vis if s == site]
                out[d, site, side] = [
                    sum(s == site for _, s, _ in up), len({u for u, s, _ in up if s == site}), sum(peers.values()), len(peers), sum(wide), len(wide),
                    sum(n for (u, s), n in per.items() if u in mine and s == site),
                    sum(reach(t - t0[site]) for (_, s), t in firsts.items() if s == site and t0[site]),
                    len({t // US_PER_DAY for _, s, t in vis if s == site}), len({u for u in twice if twice.count(u) > 1})]
    return out


@pytest.mark.parametrize("back", [None, 5])
def test_outcomes_of_a_hot_site_without_a_key_join(spark, back):
    """90 % of the events on one site in one minute: no part holds more than twice the wanted rows, and all counts hold."""
    rnd = random.Random(5)
    start = 200 * US_PER_DAY
    when = lambda hot: start + (rnd.randrange(MINUTE) if hot else rnd.randrange(-9 * US_PER_DAY, 9 * US_PER_DAY))
    def rows(n):  # noqa: E306
        return [(rnd.randrange(12), 0 if (hot := rnd.random() < 0.9) else rnd.randrange(6), when(hot)) for _ in range(n)]
    journals, ints, visits = rows(60), rows(900), rows(900)
    journals = [(u % 4, s, t) for u, s, t in journals]
    targets = [(0, start + MINUTE // 2), (1, start), (2, ints[0][2]), (4, None), (9, start)]
    ints += [(3, 2, ints[0][2]), (3, 1, start), (3, 1, start + 7 * US_PER_DAY), (3, 1, start - 3 * US_PER_DAY)]  # edges count
    ex = {(5, 0), (6, 1)}
    frame = lambda r: spark.createDataFrame(r, "user_id long, site_id long, us long")
    at = spark.createDataFrame(targets, "site_id long, t0 long")
    pairs = spark.createDataFrame(sorted(ex), "user_id long, site_id long")
    got = O.site_outcomes(at, frame(journals), frame(ints), frame(visits), [3, 7, 1], pairs, back, depth=50).collect()
    want = _plain_site_outcomes(targets, journals, ints, visits, ex, [1, 3, 7], back)
    assert len(got) == 15 and sorted({r["window_days"] for r in got}) == [1, 3, 7]
    for r in got:
        for side in ("pre", "post"):
            assert [r[f"{m}_{side}"] for m in O.SITE_MEASURES] == want[r["window_days"], r["site_id"], side], r
    near = O.around(at, frame(ints), "site_id", 9 * US_PER_DAY, 9 * US_PER_DAY, 50)
    assert near.filter("site_id = 0").count() == sum(s == 0 and abs(t - targets[0][1]) <= 9 * US_PER_DAY for _, s, t in ints)
    placed = Depth(F.col("us"), US_PER_DAY, 50).place(frame(ints), ["site_id"])
    assert placed.groupBy("site_id", "_bucket").count().agg(F.max("count")).first()[0] <= 2 * 50
    empty = O.site_outcomes(at.limit(0), frame(journals), frame([]), frame([]), [7])
    assert empty.collect() == []
    alone = O.site_outcomes(at, frame([]), frame([]), frame([]), [7]).collect()
    assert len(alone) == 5 and all(r["n_updates_pre"] == r["n_days_visited_post"] == 0 for r in alone)
