"""Corpus pipeline over documents. Stages take (spark, docs, sf_dir); each is written and read before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from peerspark.llm.exact import exact_dedup, kept_documents
from peerspark.llm.langid import UNKNOWN, held_out, identify, learn, plausible
from peerspark.llm.minhash import near_duplicates
from peerspark.llm.packing import best_fit_packing
from peerspark.llm.recompression import remove_repeats
from peerspark.llm.registry import table, vocabulary
from peerspark.llm.staging import staged

LEAST_LANGUAGE_SCORE = 0.5


def renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The columns under names that no operator gives to its results, and these names."""
    name = {c: f"column_{k}" for k, c in enumerate(docs.columns)}
    return docs.select(*[docs[f"`{c}`"].alias(n) for c, n in name.items()]), name


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told with a score of at least LEAST_LANGUAGE_SCORE, and that are about as
    probable in it as the texts it was learnt from. Texts without a letter and null texts go. Without any labelled
    language nothing can be told and nothing is rejected for it."""
    vocab = vocabulary("piece_bpe_32k.model")
    langs, probs = learn(docs.filter(~held_out()), vocab)
    if not langs:
        return docs
    rows, name = renamed(docs)
    told = staged(identify(rows, vocab, langs, probs, name["doc_id"], name["text"], tuple(name.values())), "told")
    likely = plausible(told, ~held_out(name["doc_id"]) & F.col(name["lang"]).isNotNull(), F.col(name["text"]))
    kept = likely.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return kept.select(*[F.col(name[c]).alias(c) for c in docs.columns])


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of equal texts."""
    return kept_documents(docs, exact_dedup(docs))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each component of near-duplicates."""
    return kept_documents(docs, near_duplicates(docs))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated windows out of the texts. Untouched texts stay as they are; documents of which nothing is left go."""
    rows, name = renamed(docs)
    cut = remove_repeats(rows, id_col=name["doc_id"], text_col=name["text"], carry=list(name.values()), rejoin=False)
    left = cut.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    chars = F.when(F.col("n_removed") > 0, F.length(name["text"])).otherwise(F.col(name["n_chars"])).cast(docs.schema["n_chars"].dataType)
    return left.select(*[(chars if c == "n_chars" else F.col(name[c])).alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in 2048-token sequences."""
    return best_fit_packing(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("language", language_stage), ("exact dedup", exact_stage), ("near dedup", near_stage),
          ("substring dedup", substring_stage), ("packing", packing_stage)]

ORACLE_SQL = None  # models, signatures and token ids have no SQL; tests hold run() against plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
