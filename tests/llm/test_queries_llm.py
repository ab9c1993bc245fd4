"""Registered queries against SQL or plain Python, and the pipeline."""

import array
import hashlib
import zlib

import brute
import public_tokenizers
import pytest
from compare import compare, connect
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline

SF = "/root/testdata/sf0.001"


def documents(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_one_query_for_each_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op") and n[2].isdigit())
    assert numbers == list(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", ["op2_exact_dedup", "op4_warc_revisits", "op9_preference_format",
                                  "op11_nearest_neighbours", "op12_prefix_trie", "op13_ranked_search"])
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(SF), entry.queries()[name], entry.oracle_sql()[name], SF) == ""


def test_bpe_query(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for i, t in documents(spark).items():
        ids = library.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    assert {r[0]: tuple(r)[1:] for r in entry.queries()["op1_bpe_round_trip"](spark, SF).collect()} == want


def test_substring_query(spark):
    docs = documents(spark)
    cut = brute.repeated_windows(docs.values())
    want = {i: (len(w), len(w) - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest()) for i, (w, k) in zip(docs, cut)}
    assert {r[0]: tuple(r)[1:] for r in entry.queries()["op6_substring_dedup"](spark, SF).collect()} == want


def test_quality_query(spark):
    rows = entry.queries()["op5_quality_rules"](spark, SF).collect()
    assert {r["doc_id"]: tuple(r)[1:6] for r in rows} == {i: brute.base_measures(t) for i, t in documents(spark).items()}
    good = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    judged = [(r["kept"], good[r["doc_id"]]) for r in rows if r["doc_id"] in good and not r["base_failed"]]
    assert sum(bool(a) == bool(b) for a, b in judged) >= 0.95 * len(judged)


def test_pipeline_against_plain_python(spark):
    """Every document has letters and a clear language here, so the first stage keeps all; the others are recomputed."""
    docs = documents(spark)
    seen, kept = {}, {}
    for i in sorted(docs):
        key = brute.re.sub(r"[\x20\x09-\x0D]+", " ", docs[i])
        if key not in seen:
            seen[key] = i
            kept[i] = docs[i]
    parts = brute.near_components(kept)
    kept = {i: t for i, t in kept.items() if parts[i][1] == i}
    cut = dict(zip(kept, brute.repeated_windows(kept.values())))
    kept = {i: t if len(cut[i][0]) == len(cut[i][1]) else " ".join(cut[i][1]) for i, t in kept.items() if cut[i][1] or not cut[i][0]}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, t in kept.items():
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        want += [(i, k, a, len(ids[a:a + 2048]), zlib.crc32(array.array("I", ids[a:a + 2048]).tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    rows = entry.queries()["pipeline"](spark, SF).collect()
    assert sorted(tuple(r)[:5] for r in rows) == sorted(want)
    assert corpus_pipeline.run is entry.queries()["pipeline"]


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]])
def test_stages_with_names_of_their_own_results(spark, stage):
    """Columns named like anything that a stage works out come through."""
    names = ["lang_pred", "score", "per_byte", "n_words", "n_removed", "doc", "kept", "keep_id", "group_size", "text_sha256",
             "component_id", "n_shingles", "own", "part", "_size", "a.b"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    wide = docs.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    got = stage(spark, wide, SF)
    assert got.columns == wide.columns and got.count() > 0
    assert tuple(got.first())[5:] == tuple(range(len(names)))


def test_stages_keep_the_columns_of_documents(odd, spark):
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == odd.columns and dict(docs.dtypes) == dict(odd.dtypes)
    assert docs.count() > 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), SF).count() == 0
