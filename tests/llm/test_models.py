"""Language identification and quality rules."""

import math
import random
from fractions import Fraction

import brute
import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from samples import odd_rows, prose
from pyspark.sql import functions as F

from peerspark.llm import langid, quality
from peerspark.llm.wordhash import word_slices

VOCAB = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.01"


def all_segmentations(word, ids, probs):
    """Logarithm of the sum over all segmentations, by plain recursion with exact numbers of any size."""
    text = b" " + word
    alpha = [Fraction(1)] + [Fraction(0)] * len(text)
    for i in range(len(text)):
        for j in range(i + 1, min(len(text), i + 32) + 1):
            if text[i:j] in ids:
                alpha[j] += alpha[i] * Fraction(probs[ids[text[i:j]]])
    return math.log(alpha[-1].numerator) - math.log(alpha[-1].denominator)


@pytest.mark.parametrize("word", ["x" * 75, "日本語の文章" * 8, "q\x00" * 40, "straße" * 9])
def test_long_words_are_summed_whole(word):
    """No cut, and no sum that vanishes, also after 1e12 counts of other pieces."""
    pieces = langid.vocabulary(VOCAB)
    raw = word.encode()
    text = np.frombuffer(b" " + raw, np.uint8)[None]
    for unseen in (1e-6, 1e-13):
        probs = np.full((pieces.size + 1, 1), unseen)
        got = langid.log_probability(pieces, text, np.array([text.shape[1]]), probs)[0, 0]
        assert got == pytest.approx(all_segmentations(raw, pieces.ids, probs[:, 0]), rel=1e-9)
        assert langid.log_probability(pieces, text, np.array([text.shape[1]]), probs, langid.plain_width(probs))[0, 0] == pytest.approx(got, rel=1e-9)
        shares = sum(float(s[:, 0].sum()) for _, ids, s in langid.expected(pieces, text, np.array([text.shape[1]]), probs) if len(ids))
        assert 1 <= shares <= text.shape[1] + 1e-6
    covered = np.zeros(text.shape[1])
    probs = np.full((pieces.size + 1, 1), 1 / pieces.size)
    back = {i: len(t) for t, i in pieces.ids.items()}
    mass = sum(float((s[:, 0] * [back[i] for i in ids]).sum()) for _, ids, s in langid.expected(pieces, text, np.array([text.shape[1]]), probs))
    assert mass == pytest.approx(len(covered))  # every byte is in exactly one piece of each segmentation


def test_implausible_texts_are_rejected(spark):
    """Noise and a language that was not learnt, against held-out documents of learnt ones."""
    rnd = random.Random(2)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    noise = " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(150))
    foreign = "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。" * 12
    planted = spark.createDataFrame([(10**9, noise, None), (10**9 + 1, foreign, None)], docs.schema)
    langs, probs = langid.learn(docs.filter(~langid.held_out()), VOCAB)
    told = langid.identify(docs.unionByName(planted), VOCAB, langs, probs, carry=("text", "lang"))
    kept = {r["doc_id"] for r in langid.plausible(told, ~langid.held_out() & F.col("lang").isNotNull(), F.col("text")).collect()}
    ids = {r["doc_id"] for r in docs.collect()}
    assert not kept & {10**9, 10**9 + 1} and len(ids - kept) <= 0.005 * len(ids)


def test_forward_sums_all_segmentations(spark):
    pieces = langid.vocabulary(VOCAB)
    rnd = np.random.default_rng(1)
    probs = np.vstack([rnd.dirichlet(np.ones(pieces.size), 2).T + 1e-9, np.zeros((1, 2))])
    texts = ["the quick höher", "x" * 60 + " 中文 ßtraße", "one", "", None, "!!! 12 \x00 " + "é" * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.identify(docs, VOCAB, ["a", "b"], probs).collect()}
    for i, text in enumerate(texts):
        sums = [sum(all_segmentations(w.encode(), pieces.ids, probs[:, k]) for w in brute.WORD.findall(text or "")) for k in range(2)]
        if text and any(c.isalpha() for c in text):
            assert got[i]["lang_pred"] == "ab"[int(np.argmax(sums))]
            assert got[i]["score"] == pytest.approx(1 / (1 + math.exp(-abs(sums[0] - sums[1]))))
        else:
            assert tuple(got[i])[1:] == ("und", 0.0, None)


def test_learning_counts_every_segmentation(spark):
    """Expected counts of one word from equally likely pieces, by listing its segmentations."""
    pieces = langid.vocabulary(VOCAB)
    found = {}

    def walk(rest, used):
        if not rest:
            for p in used:
                found.setdefault(p, []).append(used)
            walk.weights[tuple(used)] = (1 / pieces.size) ** len(used)
        for j in range(1, len(rest) + 1):
            if rest[:j] in pieces.ids:
                walk(rest[j:], [*used, rest[:j]])
    walk.weights = {}
    walk(b" hold", [])
    total = sum(walk.weights.values())
    want = {}
    for used, weight in walk.weights.items():
        for p in used:
            want[p] = want.get(p, 0) + 3 * weight / total
    langs, probs = langid.learn(spark.createDataFrame([("hold hold", "en"), ("hold", "en"), (None, "en"), ("hold", None)], "text string, lang string"), VOCAB, smoothing=0.0)
    assert langs == ["en"]
    scale = sum(want.values())
    for p, n in want.items():
        assert probs[pieces.ids[p], 0] == pytest.approx(n / scale, abs=1e-4)


def test_more_rounds_and_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for rounds in (1, 2):
        langs, probs = langid.learn(docs.filter(~langid.held_out()).limit(300), VOCAB, rounds=rounds)
        told = langid.identify(docs, VOCAB, langs, probs, carry=("lang",)).filter(langid.held_out())
        right = told.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
        assert right >= 0.98


def test_language_of_odd_rows(odd, none):
    langs, probs = langid.learn(odd, VOCAB)
    assert langs == ["en"]
    rows = langid.identify(odd, VOCAB, langs, probs, carry=("keep_id", "doc_id")).collect()
    assert len(rows) == len(odd_rows()) and {r["keep_id"] for r in rows} == {"clash"}
    assert all((r["lang_pred"] == "und") == (r["score"] == 0) for r in rows)
    assert sorted(r["doc_id"] or 0 for r in rows if r["lang_pred"] == "und") == [0, 5, 6, 7, 16]
    assert langid.learn(none, VOCAB)[0] == [] and langid.identify(none, VOCAB, langs, probs).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, VOCAB, [], probs).collect()} == {"und"}


def test_base_measures_of_random_texts():
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(["a ", "b ", "ab", "\n", " ", "#", "é", "|", "\r", "x y z v w ", "\n\n", " "]) for _ in range(rnd.randrange(90))) for _ in range(400)]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = []
    for part in word_slices(pa.array([*texts, None, ""]), 200):
        found = quality.base_measures(part)
        got += list(zip(*[found[n].tolist() for n in names]))
    assert got == [brute.base_measures(t) for t in [*texts, None, ""]]


def labelled(spark, n=240):
    rows = [(i, prose(i, 60) if i % 3 else " ".join(w + "$$$" for w in prose(i, 60).split()), int(i % 3 > 0)) for i in range(n)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, q) for i, _, q in rows if i % 2 == 0] + [(5, None), (None, 1)], "doc_id long, quality int")


def test_quality_verdicts_and_calibration(spark):
    docs, labels = labelled(spark)
    rows = {r["doc_id"]: r for r in quality.judge(docs, quality.fit(docs, labels)).collect()}
    assert all(rows[i]["kept"] == (i % 3 > 0) for i in range(240))
    # labels that say nothing: probabilities are near the share of ones
    coin = labels.withColumn("quality", (F.crc32(F.col("doc_id").cast("string")) % 4 > 0).cast("int"))
    model = quality.fit(docs, coin)
    share = coin.agg(F.avg("quality")).first()[0]
    assert abs(quality.judge(docs, model).agg(F.avg("probability")).first()[0] - share) < 0.2


def test_fit_settles_whatever_the_length_of_rows():
    """One very short text among long ones: its row is many times longer, and the fit still ends at the least loss."""
    rng = np.random.default_rng(4)
    n, each = 300, 200
    y = (np.arange(n) % 2).astype(float)
    row = np.append(np.repeat(np.arange(n), each), [n, n])
    col = np.append(rng.integers(0, 3000, n * each) + 1500 * np.repeat(y, each).astype(int), [5, 9])
    val = np.append(np.full(n * each, 0.01), [1.0, 1.0])
    y, weight = np.append(y, 1.0), np.append(np.full(n, 1 / n), 1 / n)
    w = quality._settle(row, col, val, y, weight, tolerance=1e-10)

    def at(w):
        z = np.bincount(row, w[col] * val, n + 1)
        p = 1 / (1 + np.exp(-z))
        slope = np.bincount(col, (weight * (p - y))[row] * val, len(w)) + 2e-6 * w
        return (weight * np.logaddexp(0, -np.where(y > 0, z, -z))).sum() + 1e-6 * (w @ w), slope
    best, slope = at(w)
    assert np.abs(slope).max() < 1e-6
    assert at(quality._settle(row, col, val, y, weight))[0] < best * 1.001
    with pytest.raises(RuntimeError, match="did not settle"):
        quality._settle(row, col, val, y, weight, most=1)


def test_quality_of_odd_rows(odd, none, spark):
    _, labels = labelled(spark)
    assert quality.fit(odd, labels.filter("quality = 1")) is None and quality.fit(odd, none.withColumn("quality", F.lit(1))) is None
    rows = quality.judge(odd, None).collect()
    want = sorted((str(r[0]), *brute.base_measures(r[1])) for r in odd_rows())
    assert sorted((str(r["doc_id"]), *tuple(r)[1:6]) for r in rows) == want
    assert all(r["probability"] is None and r["kept"] == (not r["base_failed"]) for r in rows)
    assert all(r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) for r in rows)
    assert quality.judge(none, None).count() == 0
