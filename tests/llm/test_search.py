"""Nearest neighbours and ranked search against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from peerspark.llm.lexical import item_terms, no_random_access, ranked_search
from peerspark.llm.multiindex import Index, inner_products, nearest_neighbours, traverse
from peerspark.llm.staging import spread_join

DOCS = "doc_id long, text string, score double, rank string, n int"
ITEMS = "item_id long, text string, doc string"


def brute_search(docs, items, k):
    """Rows (item, rank, doc, score) from the definition."""
    found = lambda t: re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    terms = [(i, Counter(found(t))) for i, t in docs if found(t)]
    n_all, l_all = len(terms), sum(sum(c.values()) for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    wanted: dict = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(found(t))
    rows = []
    for item, ts in wanted.items():
        scored = []
        for i, c in terms:
            m = 10 + 90 * sum(c.values()) * n_all // l_all
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in ts if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        rows += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(rows, key=str)


def search_rows():
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["É", "ß", "日本", "X1", "\x1c", "a-b"]
    docs = [(i, " ".join(rnd.choice(words[:1 + int(rnd.random() ** 2 * len(words))]) for _ in range(rnd.randrange(1, 30)))) for i in range(300)]
    docs += [(i, "w3 w5 w3") for i in range(300, 420)]                       # ties over a large group
    docs += [(7, docs[7][1]), (None, "w3 w39"), (None, "w39"), (500, None), (501, ""), (502, "- - ."), (503, "w1 " * 30_000)]
    items = [(0, "w3 w39 W3"), (1, "w1 É 日本 x1 nowhere"), (2, None), (3, "..."), (4, "nowhere"), (0, "w7"), (None, "w38 ß"), (5, "w5 a-b")]
    return docs, items


@pytest.mark.parametrize("k, block", [(10, 1 << 18), (1, 3), (1000, 1 << 18)])
def test_ranked_search_equals_brute_force(spark, k, block):
    docs, items = search_rows()
    frame = spark.createDataFrame([(i, t, 1.0, "x", 2) for i, t in docs], DOCS).repartition(5)
    got = ranked_search(frame, spark.createDataFrame([(i, t, "y") for i, t in items], ITEMS), k, block_terms=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_search(docs, items, k)


def test_ranked_search_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a", 1.0, "x", 2)], DOCS), spark.createDataFrame([(1, "a", "")], ITEMS)
    assert ranked_search(docs.limit(0), items).count() == 0 and ranked_search(docs, items.limit(0)).count() == 0
    assert item_terms(items, "item_id", "text").count() == 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 39), st.integers(0, 12)), max_size=6), st.integers(1, 8), st.integers(0, 99))
def test_no_random_access_finds_the_best(lists, k, seed):
    tie = np.random.default_rng(seed).permutation(40)
    total, sides = np.zeros(40, np.int64), []
    for entries in lists:
        ranked = sorted(entries.items(), key=lambda e: -e[1])
        sides.append((np.array([e[0] for e in ranked], np.int64), np.array([e[1] for e in ranked], np.int64)))
        for doc, impact in ranked:
            total[doc] += impact
    want = sorted((-total[d], tie[d], d) for d in range(40) if total[d] > 0)[:k]
    best, score = no_random_access(sides, 40, k, tie)
    assert best.tolist() == [w[2] for w in want] and score.tolist() == [-w[0] for w in want]


def test_no_random_access_stops_early():
    """One clear winner: the second half of long lists is never read."""
    docs = np.arange(100_000)
    impact = np.concatenate([[10**9], np.zeros(99_999, np.int64) + 1])
    calls = []

    class Watched(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, slice) and at.stop:
                calls.append(at.stop)
            return super().__getitem__(at)

    best, _ = no_random_access([(docs, impact.view(Watched))], 100_000, 1, docs)
    assert best.tolist() == [0] and max(calls) <= 512


def brute_neighbours(rows, k, every):
    size = Counter(len(v) for i, v in rows if good(i, v))
    if not size:
        return []
    width = max(size, key=lambda s: (size[s], s))
    have = [(i, np.array(v, np.float64)) for i, v in rows if good(i, v) and len(v) == width]
    out = []
    for a, (i, q) in enumerate(have):
        if i % every == 0:
            others = sorted((-inner_products(q[None], v[None])[0], j) for b, (j, v) in enumerate(have) if b != a)[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(others, 1)]
    return sorted(out)


def good(i, v):
    return i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)


def vectors(n, seed, centres=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 9))
    if centres:
        x = rng.normal(size=(centres, 9))[rng.integers(0, centres, n)] * 4 + x * 0.05
    return [(int(i), [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]


def frame(spark, rows):
    return spark.createDataFrame([(v, i, 1, 0.5, "q") for i, v in rows], "embedding array<float>, vec_id long, rank int, score double, query_id string")


def test_neighbours_of_odd_vectors(spark):
    rows = vectors(300, 1)
    same = rows[40][1]
    rows += [(i, same) for i in range(1000, 1090)]                # copies, more than are asked for
    rows += [(20, rows[20][1]), (60, rows[3][1]), (2000, None), (2020, [0.0] * 9), (2040, [float("nan")] + [1.0] * 8), (2060, [1.0] * 8),
             (2080, [float("inf")] + [1.0] * 8), (2100, [None] + [1.0] * 8), (None, [1.0] * 9), (2120, []), (2140, [-x for x in same])]
    got = nearest_neighbours(frame(spark, rows), F.col("id") % 20 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute_neighbours(rows, 20, 20)


@pytest.mark.parametrize("n", [0, 1, 2, 15])
def test_neighbours_of_few_vectors(spark, n):
    rows = [(20 * i, v) for i, v in vectors(n, 2)]
    got = nearest_neighbours(frame(spark, rows), F.col("id") % 20 == 0)
    assert sorted(tuple(r) for r in got.collect()) == brute_neighbours(rows, 20, 20)


@pytest.mark.parametrize("width", [1, 2])
def test_neighbours_of_short_vectors(spark, width):
    rows = [(i, v[:width]) for i, v in vectors(200, 3)]
    got = nearest_neighbours(frame(spark, rows), F.col("id") % 20 == 0)
    assert sorted(tuple(r) for r in got.collect()) == brute_neighbours(rows, 20, 20)


def test_recall_against_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    got = {(r[0], r[2]) for r in nearest_neighbours(table, F.col("id") % 20 == 0).collect()}
    x = np.array([v for _, v in rows], np.float64)
    ids = np.array([i for i, _ in rows])
    hits = wanted = 0
    for a in np.flatnonzero(ids % 20 == 0):
        s = x @ x[a]
        s[a] = -np.inf
        near = ids[np.lexsort((ids, -s))[:20]]
        hits += sum((int(ids[a]), int(b)) in got for b in near)
        wanted += len(near)
    assert hits >= 0.9 * wanted


def test_clustered_vectors_need_few_cells(spark):
    rows = vectors(3000, 5, centres=40)
    got = nearest_neighbours(frame(spark, rows), F.col("id") % 20 == 0)
    want = brute_neighbours(rows, 20, 20)
    assert len({r[:3] for r in want} & {tuple(r)[:3] for r in got.collect()}) >= 0.98 * len(want)


def test_traversal_goes_by_summed_products_and_ends():
    rng = np.random.default_rng(0)
    centroids = rng.normal(size=(6, 3)), rng.normal(size=(5, 4))
    counts = rng.integers(0, 4, (6, 5))
    index, q = Index(centroids, counts, (1e-6, 1e-6)), rng.normal(size=7)
    every = [(i, j) for i, j, _ in traverse(index, q, 10**9, None, 0)]
    total = [(centroids[0][i] @ q[:3]) + (centroids[1][j] @ q[3:]) for i, j in every]
    assert sorted(every) == sorted(zip(*map(list, np.nonzero(counts)))) and total == sorted(total, reverse=True)
    looked = list(traverse(index, q, 5, total[8] - 0.001, 1e-4))
    assert [c[:2] for c in looked] == every[:9] and {c[2] for c in looked} == {0, 1}


def test_spread_join_deals_hot_keys(spark):
    rows = spark.createDataFrame([(1, i) for i in range(500)] + [(2, i) for i in range(5)], "k int, v int")
    facts = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d")], "k int, f string")
    got = sorted(map(tuple, spread_join(rows, facts, "k", least=50).select("k", "v", "f").collect()))
    assert got == sorted(map(tuple, rows.join(facts, "k").select("k", "v", "f").collect()))
