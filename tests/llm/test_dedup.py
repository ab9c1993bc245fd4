"""Exact, near and substring deduplication against plain Python."""

import hashlib
import random
import re
from collections import Counter

import brute
import pytest
from samples import odd_rows, prose
from pyspark.sql import functions as F

from peerspark.llm import minhash
from peerspark.llm.exact import exact_dedup, kept_documents
from peerspark.llm.minhash import near_duplicates
from peerspark.llm.recompression import remove_repeats

SF = "/root/testdata/sf0.001"


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def exact_expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for i, t in rows:
        g = groups[norm(t)]
        keep = min((x for x in g if x is not None), default=None)
        out.append((i, keep, len(g), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("salts", [1, 7])
def test_exact_dedup_on_odd_rows(odd, salts):
    got = Counter(tuple(r) for r in exact_dedup(odd, salts=salts).collect())
    assert got == exact_expected([(r[0], r[1]) for r in odd_rows()])


def test_exact_dedup_compares_content_when_digests_collide(odd):
    got = Counter(tuple(r) for r in exact_dedup(odd, digest=lambda c: (F.length(c) % 3).cast("string")).collect())
    assert got == exact_expected([(r[0], r[1]) for r in odd_rows()])


def test_exact_dedup_hot_group(spark):
    rows = [(i, "hot text" if i % 3 else f"own {i}") for i in range(3000)]
    got = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(16))
    assert got.filter("kept").count() == 1001 and got.agg(F.max("group_size")).first()[0] == 2000


def test_kept_documents_leaves_other_columns(odd):
    kept = kept_documents(odd, exact_dedup(odd))
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None and r["doc_id"] < 10) == [1, 3, 4, 5, 7, 8, 9]


def test_near_duplicates_on_odd_rows(odd):
    texts = {r[0]: r[1] for r in odd_rows() if r[0] is not None}
    want = {i: (n, c, i == c) for i, (n, c) in brute.near_components(texts).items()}
    rows = near_duplicates(odd).collect()
    assert len(rows) == len(odd_rows())
    assert {r[0]: tuple(r)[1:] for r in rows if r[0] is not None} == want
    assert {(r[1], r[2], r[3]) for r in rows if r[0] is None} == {(116, 1, False), (0, None, True)}


def test_near_duplicates_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute.near_components({r["doc_id"]: r["text"] for r in docs.collect()})
    assert {r[0]: (r[1], r[2]) for r in near_duplicates(docs).collect()} == want


def test_near_duplicates_of_a_large_group_and_a_chain(spark):
    rnd = random.Random(9)
    base = prose(20, 300, 3000).split()
    docs = {}
    for i in range(250):  # star: copies of one text, each with its own changes
        w = list(base)
        for _ in range(3):
            w[rnd.randrange(300)] = f"new{i}_{rnd.random()}"
        docs[i] = " ".join(w)
    chain = prose(21, 100, 3000).split()
    for k in range(40):  # chain: each links with the next only
        docs[1000 + k] = " ".join([*chain[10 * k % 100:], *prose(22 + k, 5, 9000).split()]) if k == 0 else " ".join(
            [*docs[1000 + k - 1].split()[8:], *prose(50 + k, 8, 9000).split()])
    got = {r[0]: (r[1], r[2]) for r in near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(8)).collect()}
    assert got == brute.near_components(docs)


def test_members_compared_after_the_first_pass_are_linked(spark):
    """Members share buckets with a head that does not link with them."""
    a, b = prose(60, 60, 900).split(), prose(61, 60, 900).split()
    docs = {1: " ".join(a[:40] + b[:40]), 2: " ".join(b), 3: " ".join([*b[:-1], "end"]), 4: " ".join([*b[:-1], "stop"]), 5: " ".join(a)}
    got = {r[0]: (r[1], r[2]) for r in near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert got == brute.near_components(docs)


def test_blocks_are_bounded_by_members_and_by_shingles(spark):
    """A bucket of one component and many others: pieces follow whichever bound is reached first, and no pair of sides is lost."""
    rnd = random.Random(8)
    sets = {i: [rnd.randrange(1 << 62) for _ in range(20 if i % 10 else 400)] for i in range(300)}
    same = minhash.signature(minhash.np.array(sets[0], minhash.U64)).tobytes()
    classes = spark.createDataFrame([(i, len(s), bytearray(same)) for i, s in sets.items()], "cls long, n long, sig binary")
    mixed = spark.createDataFrame([(7, 0, i, i if i < 200 else 999, 999) for i in sets], "bucket long, band int, cls long, comp long, main long")
    for block, shingles, least in ((10**6, 10**9, 1), (50, 10**9, 24), (10**6, 4000, 15)):
        rows = minhash._blocks(mixed, classes, 75, 1e-7, block, shingles).collect()
        assert len({(r["i"], r["j"]) for r in rows}) >= least
        found = {(r["cls"], p) for r in rows for p in r["partners"] or []}
        fits = lambda a, b: 100 * min(len(sets[a]), len(sets[b])) >= 75 * max(len(sets[a]), len(sets[b]))
        assert found == {(a, b) for a in range(200) for b in sets if (b >= 200 or a < b) and fits(a, b)}


def test_bayesian_bounds():
    need = minhash.least_matches(75, 1e-7)
    assert list(need) == list(range(16, 129, 16))
    assert all(a < b for a, b in zip(need.values(), list(need.values())[1:])) and need[128] < 96


@pytest.mark.parametrize("rejoin", [True, False])
def test_repeats_on_odd_rows(odd, rejoin):
    rows = odd_rows()
    cut = brute.repeated_windows([r[1] for r in rows])
    want = Counter((r[0], len(w), len(w) - len(k), " ".join(k) if rejoin or len(w) > len(k) else r[1] or "") for r, (w, k) in zip(rows, cut))
    got = remove_repeats(odd, carry=odd.columns, rejoin=rejoin)
    assert got.columns == [*(c for c in odd.columns if c != "text"), "text", "n_words", "n_removed"]
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in got.collect()) == want
    assert sum(len(w) > len(k) for w, k in cut) >= 6


def test_repeats_of_random_texts(spark):
    rnd = random.Random(4)
    pool = [prose(100 + k, rnd.randrange(30, 80), 40) for k in range(6)]
    rows = [(i, " ".join(rnd.choice([rnd.choice(pool), prose(rnd.random(), rnd.randrange(1, 90), 3), "z " * rnd.randrange(1, 90), prose(rnd.random(), 20)])
                         for _ in range(rnd.randrange(1, 6)))) for i in range(150)]
    cut = brute.repeated_windows([t for _, t in rows])
    for width, rounds in ((35, 3), (12, 2), (35, 5)):
        cut = brute.repeated_windows([t for _, t in rows], width)
        got = {r[0]: (r["n_words"], r["n_removed"], r["text"]) for r in
               remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), width=width, rounds=rounds).collect()}
        assert got == {i: (len(w), len(w) - len(k), " ".join(k)) for (i, _), (w, k) in zip(rows, cut)}


def test_repeats_with_symbols_reported_bit_by_bit(spark):
    rnd = random.Random(14)
    pool = [prose(300 + k, 60, 200) for k in range(4)]
    rows = [(i, " ".join([prose(400 + i, 30, 500), rnd.choice(pool), prose(500 + i, 30, 500)])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bit, whole = ({tuple(r) for r in remove_repeats(docs, reported=n).collect()} for n in (5, 1 << 21))
    want = {(i, " ".join(k), len(w), len(w) - len(k)) for (i, _), (w, k) in zip(rows, brute.repeated_windows([t for _, t in rows]))}
    assert bit == whole == want


def test_empty_tables(none):
    assert exact_dedup(none).count() == near_duplicates(none).count() == remove_repeats(none).count() == 0
