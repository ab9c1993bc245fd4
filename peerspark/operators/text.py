"""Text embeddings, classification, annotation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC
from pyspark.ml.feature import IDF, HashingTF, NGram
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as TX
from .state import last_k_updates


def encode_missing(texts: DataFrame, known: DataFrame, encoder: Callable[[pd.Series], object]) -> DataFrame:
    """Embeddings of the texts that have none yet; (text_id, body) in, (text_id, embedding) out."""
    todo = texts.join(known.select("text_id"), "text_id", "left_anti").select("text_id", "body")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"text_id": b["text_id"], "embedding": list(encoder(b["body"]))})
    return todo.mapInPandas(run, "text_id long, embedding array<float>")


def pool_recent(points: DataFrame, journals: DataFrame, embeddings: DataFrame, mode: str = "mean", strict: bool = True,
                k: int = 3) -> DataFrame:
    """Pool the embeddings of each point's last k updates: ``mean``, ``concat`` (oldest first) or
    ``max``. Strict keeps only points with all k; otherwise one is enough (not for concat)."""
    last = last_k_updates(points, journals, k).join(
        embeddings.select(F.col("text_id").alias("journal_oid"), F.col("embedding").alias("_e")), "journal_oid")
    slot = last.groupBy(*points.columns).agg(
        F.count("*").alias("n_texts"), *[F.any_value(F.when(F.col("pos") == i, F.col("_e")), True).alias(f"_e{i}") for i in range(1, k + 1)])
    slot = slot.filter(F.col("n_texts") >= (k if strict or mode == "concat" else 1))
    es = [F.col(f"_e{i}") for i in range(1, k + 1)]
    if mode == "concat":
        vec = F.concat(*es)
    else:
        have = F.filter(F.array(*es), lambda e: e.isNotNull())
        op = (lambda a, b: F.greatest(a, b)) if mode == "max" else (lambda a, b: a + b)
        dbl = F.transform(have, lambda e: F.transform(e, lambda x: x.cast("double")))
        folded = F.aggregate(F.slice(dbl, F.lit(2), F.greatest(F.size(dbl) - 1, F.lit(0))), F.get(dbl, F.lit(0)),
                             lambda acc, e: F.zip_with(acc, e, op))
        vec = folded if mode == "max" else F.transform(folded, lambda x: x / F.size(F.filter(F.array(*es), lambda e: e.isNotNull())))
    return slot.select(*points.columns, "n_texts", vec.alias("text_vec"))


def describe(desc: Column, default: str, first_person: str) -> Column:
    """Category of a site description relative to the default text."""
    plain = lambda c: F.trim(F.regexp_replace(F.replace(c, F.lit("&nbsp;"), F.lit(" ")), r"[^\p{L}\p{N}_]+", " "))
    import re
    strip = lambda s: re.sub(r"\W+", " ", s).strip()
    base, d = strip(default), plain(desc)
    dist = TX.word_distance(F.split(d, " "), base.split())
    starts = d.startswith(base)
    return (F.when(desc.isNull(), "undefined").when(desc == default, "default").when(d == "", "empty").when(d == base, "default_strip")
            .when(d == strip(first_person), "1st_person_default_strip").when(~d.rlike("[A-Za-z]"), "non_english")
            .when((dist <= 1) & starts, "default_add_1word").when(dist <= 1, "default_edited_1word")
            .when((dist <= 5) & starts, "default_add_5word").when(dist <= 5, "default_edited_5word")
            .when(starts, "added_to_default").otherwise("uncategorized"))


def fit_role_classifier(labelled: DataFrame, min_df: int = 3, buckets: int = 1 << 16) -> PipelineModel:
    """Linear hinge classifier on 1- and 2-gram TF-IDF; input has ``body`` and 0/1 ``label``.

    Grams are hashed, so there is no vocabulary to gather or cut; those that share a bucket share a
    weight. Buckets in fewer than ``min_df`` documents weigh nothing."""
    from pyspark.ml.feature import SQLTransformer
    stages = [SQLTransformer(statement="SELECT *, filter(split(lower(body), '\\\\s+'), w -> w <> '') AS _tok FROM __THIS__"),
              NGram(n=2, inputCol="_tok", outputCol="_bi"),
              SQLTransformer(statement="SELECT *, concat(_tok, _bi) AS _grams FROM __THIS__"),
              HashingTF(numFeatures=buckets, inputCol="_grams", outputCol="_tf"),
              IDF(inputCol="_tf", outputCol="features", minDocFreq=min_df), LinearSVC(maxIter=100, regParam=0.01)]
    return Pipeline(stages=stages).fit(labelled)


def label_new(docs: DataFrame, labels: DataFrame, model: PipelineModel) -> DataFrame:
    """Predict only the documents without a label."""
    todo = docs.join(labels.select("doc_id"), "doc_id", "left_anti")
    return model.transform(todo).select("doc_id", F.col("prediction").cast("long").alias("label"))


def author_types(labelled: DataFrame) -> DataFrame:
    """Patient / shared / caregiver from the share of patient-written updates per site, then per user."""
    site = labelled.groupBy("user_id", "site_id").agg(F.avg((F.col("role") == "p").cast("double")).alias("p"))
    u = site.groupBy("user_id").agg(
        F.count("*").alias("n_sites"), F.max("p").alias("p1"), F.max(((F.col("p") < 0.8) & (F.col("p") > 0.2)).cast("int")).alias("mixed"),
        F.avg((F.col("p") >= 0.8).cast("double")).alias("share_p"))
    single = F.when(F.col("p1") >= 0.8, "p").when(F.col("p1") >= 0.2, "shared").otherwise("cg")
    multi = F.when(F.col("mixed") == 1, "shared").when(F.col("share_p") >= 0.5, "p").otherwise("cg")
    return u.select("user_id", "n_sites", F.when(F.col("n_sites") == 1, single).otherwise(multi).alias("author_type"))


def resolve_annotations(annotations: DataFrame, preferred: str) -> DataFrame:
    """One label per document: unanimous; else skipped when both p and cg occur; else the preferred
    annotator's; else the smallest label."""
    g = annotations.groupBy("doc_id").agg(
        F.min("label").alias("_lo"), F.max("label").alias("_hi"), F.max((F.col("label") == "p").cast("int")).alias("_p"),
        F.max((F.col("label") == "cg").cast("int")).alias("_cg"), F.min(F.when(F.col("annotator") == preferred, F.col("label"))).alias("_pref"))
    return g.select("doc_id", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).when((F.col("_p") == 1) & (F.col("_cg") == 1), F.lit("skip"))
                    .otherwise(F.coalesce("_pref", "_lo")).alias("label")).filter("label <> 'skip'")


def kappa(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Cohen's kappa and raw agreement per key, from the contingency table."""
    cell = pairs.groupBy(*keys, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count("*").alias("_n"))
    n = cell.groupBy(*keys).agg(F.sum("_n").alias("n"), F.sum(F.when(F.col("_a") == F.col("_b"), F.col("_n")).otherwise(0)).alias("_o"))
    ra = cell.groupBy(*keys, F.col("_a").alias("_v")).agg(F.sum("_n").alias("_ra"))
    rb = cell.groupBy(*keys, F.col("_b").alias("_v")).agg(F.sum("_n").alias("_rb"))
    exp = ra.join(rb, [*keys, "_v"]).groupBy(*keys).agg(F.sum(F.col("_ra").cast("double") * F.col("_rb")).alias("_e"))
    po, pe = F.col("_o") / F.col("n"), F.coalesce(F.col("_e"), F.lit(0.0)) / (F.col("n").cast("double") * F.col("n"))
    return n.join(exp, keys, "left").select(*keys, "n", po.alias("agreement"), ((po - pe) / F.when(pe < 1, 1 - pe)).alias("kappa"))


def annotation_sample(recs: DataFrame, annotated: DataFrame) -> DataFrame:
    """Recommended texts not annotated yet, one row per recipient with the number of recipients."""
    todo = recs.join(annotated.select("text_id"), "text_id", "left_anti").select("text_id", "participant_id").distinct()
    return todo.join(todo.groupBy("text_id").agg(F.count("*").alias("n_recipients")), "text_id")


def explode_codes(df: DataFrame, codes: str) -> DataFrame:
    """One row per ``;``-separated code, trimmed, blanks dropped."""
    return df.withColumn("code", F.explode(F.split(codes, ";"))).withColumn("code", F.trim("code")).filter("code <> ''").drop(codes)


def news_category(health: str = "health_news", pos: str = "pos_news", neg: str = "neg_news") -> Column:
    h, p, n = (F.col(c) == 1 for c in (health, pos, neg))
    return F.when(~h, "none").when(p & n, "both").when(p, "pos").when(n, "neg").otherwise("neut")


def style_flags(body: str) -> list[Column]:
    """Link, please and pronoun flags of a text."""
    b = F.lower(body)
    we, i = b.contains("we "), b.contains("i ")
    return [(b.contains("http") | b.contains("[link]")).cast("long").alias("has_link"), b.contains("please").cast("long").alias("has_please"),
            F.when(we & i, "both").when(we, "we_only").when(i, "i_only").otherwise("neither").alias("pronouns")]
