"""Event-by-event replay in plain Python against the set-based Spark results."""

import random
from collections import defaultdict

import pytest

from peerspark.operators import contexts as C, graph as G, state as S
from peerspark.operators.prefix import US_PER_DAY

WEEK = 7 * US_PER_DAY


def make_events(seed, n=260):
    rnd = random.Random(seed)
    # coarse times, so that many events share an instant
    return [(i, rnd.randrange(9), rnd.randrange(6), rnd.randrange(0, 30 * 24) * 3_600_000_000,
             rnd.choice(["journal", "journal", "amp", "comment", "guestbook"])) for i in range(n)]


class Replay:
    """State strictly before a time, from scratch for each question."""

    def __init__(self, events):
        self.ev = sorted(events, key=lambda e: (e[3], e[0]))

    def usps(self):
        t = defaultdict(list)
        for _, u, s, us, a in self.ev:
            if a == "journal":
                t[u, s].append(us)
        return {k: (v[0], v[2] if len(v) > 2 else None) for k, v in t.items()}

    def inits(self):
        first = {}
        for i, u, s, us, a in self.ev:
            if a != "journal":
                first.setdefault((u, s), (us, i))
        return first

    def edges_before(self, t):
        usps, out = self.usps(), set()
        for (u, s), (us, _) in self.inits().items():
            for (v, s2), (x, _) in usps.items():
                if s2 == s and us < t and x < t:
                    out.add((u, v))
        return out

    def active(self, t):
        return {u for _, u, _, us, _ in self.ev if t - WEEK <= us < t}

    def component(self, node, t):
        adj = defaultdict(set)
        for a, b in self.edges_before(t):
            adj[a].add(b), adj[b].add(a)
        seen, todo = {node}, [node]
        while todo:
            for x in adj[todo.pop()] - seen:
                seen.add(x), todo.append(x)
        return min(seen), len(seen)

    def candidates(self, source, site, t):
        usps = self.usps()
        elig = {k for k, (_, g) in usps.items() if g is not None and g < t}
        mine = {s for u, s in elig if u == source}
        targets = {u for u, s in elig if s == site}
        if not mine or not targets or source in targets:
            return None
        co = {u for u, s in elig if s in mine and u != source}
        linked = {b for a, b in self.edges_before(t) if a == source}
        users = ({u for u, _ in elig} & self.active(t)) - {source} - targets - co - linked
        return {(u, s) for u, s in elig if u in users}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_state_equals_replay(spark, seed):
    events = make_events(seed)
    r = Replay(events)
    act = spark.createDataFrame(events, "event_id long, user_id long, site_id long, us long, atype string")
    journals = act.filter("atype = 'journal'").drop("atype")
    ints = act.filter("atype <> 'journal'").withColumnRenamed("atype", "itype")
    usps, inits = S.usp_state(journals), S.initiations(ints)
    assert {(x.user_id, x.site_id): (x.exist_us, x.elig_us) for x in usps.collect()} == r.usps()
    assert {(x.user_id, x.site_id): (x.us, x.event_id) for x in inits.collect()} == r.inits()
    edge = G.edges(inits, usps)
    for t in (5 * US_PER_DAY, 12 * US_PER_DAY, 40 * US_PER_DAY):
        assert {(e.src, e.dst) for e in edge.filter(edge.edge_us < t).collect()} == r.edges_before(t)
    rolled = S.rolling_activity(act.select("event_id", "user_id", "us"), act, ["user_id"])
    for x in rolled.collect():
        for a in S.ACTIVITY_TYPES:
            times = [us for _, u, _, us, b in events if u == x.user_id and b == a and x.us - WEEK <= us < x.us]
            assert x[f"n_{a}"] == len(times) and x[f"last_{a}_us"] == max(times, default=None)


@pytest.mark.parametrize("seed", [4, 5])
def test_components_and_candidates_equal_replay(spark, seed):
    events = make_events(seed, 200)
    r = Replay(events)
    act = spark.createDataFrame(events, "event_id long, user_id long, site_id long, us long, atype string")
    journals = act.filter("atype = 'journal'").drop("atype")
    ints = act.filter("atype <> 'journal'").withColumnRenamed("atype", "itype")
    usps, inits = S.usp_state(journals), S.initiations(ints)
    edge = G.edges(inits, usps)
    times = [d * US_PER_DAY // 2 for d in (0, 1, 3, 4, 9, 17, 41, 80)]
    wanted = spark.createDataFrame([(n, t) for n in range(10) for t in times], "node long, us long")
    got = {(x.node, x.us): (x.component, x.component_size) for x in G.components_at_times(edge, wanted).collect()}
    assert got == {(n, t): r.component(n, t) for n in range(10) for t in times}
    ctx = C.contexts_from(inits, 8 * US_PER_DAY)
    el = C.eligible_contexts(ctx, usps)
    cand = C.expand_usps(C.candidate_users(el, usps, act, edge), usps)
    found = defaultdict(set)
    for x in cand.collect():
        found[x.metadata_id].add((x.cand_user, x.cand_site))
    ok = {x.metadata_id for x in el.collect()}
    for c in ctx.collect():
        want = r.candidates(c.source, c.target_site, c.us)
        assert (want is not None) == (c.metadata_id in ok)
        if want is not None:
            assert found[c.metadata_id] == want
