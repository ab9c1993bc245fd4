"""Ranked lexical search: no-random-access reads of impact-sorted posting lists."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .staging import staged
from .wordhash import U64, Words, word_slices

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK_TERMS = 1 << 18   # query terms that one pass over the documents looks for
SHARD_POSTINGS = 1 << 20  # postings of one shard's lists
FIRST_READ = 256

#: bytes that separate terms: ASCII other than letters and digits
_BETWEEN = np.ones(256, bool)
_BETWEEN[128:] = False
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
    _BETWEEN[_a:_b] = False


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (item, term). Rows that share an id are one item; null texts have no terms."""
    lowered = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    found = F.array_distinct(F.regexp_extract_all(lowered, F.lit(f"({TERM})"), F.lit(1)))
    return items.select(F.col(id_col).alias("item"), F.explode(found).alias("term")).distinct()


def _found(words: Words, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, numbers and occurrences of the wanted terms (sorted fingerprints) in a slice."""
    marks = words.hashes(lower=True)
    at = np.minimum(np.searchsorted(wanted, marks), max(len(wanted) - 1, 0))
    hit = np.flatnonzero(wanted[at] == marks) if len(wanted) else np.zeros(0, np.int64)
    key, times = np.unique(words.row_of_word()[hit] * len(wanted) + at[hit], return_counts=True)
    return key // max(len(wanted), 1), key % max(len(wanted), 1), times


def fingerprints(terms: list[str]) -> np.ndarray:
    """Fingerprints of lower-cased terms, in their order."""
    column = pa.array(terms, pa.large_string())
    marks = [w.hashes(lower=True) for w in word_slices(column, between=_BETWEEN)]
    return np.concatenate(marks) if marks else np.zeros(0, U64)


def postings(docs: DataFrame, wanted: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """Per document with a term: doc, n (all terms with repeats), terms (numbers of wanted ones), tfs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in word_slices(batch.column(1), between=_BETWEEN):
                row, term, times = _found(words, wanted)
                bounds = pa.array(np.searchsorted(row, np.arange(words.last - words.first + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x, kind)) for x, kind in ((term, pa.int32()), (times, pa.int64()))]
                n = words.counts()
                ids = batch.column(0).slice(words.first, words.last - words.first)
                part = pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), *lists], names=["doc", "n", "terms", "tfs"])
                yield part.filter(pa.array(n > 0))

    chosen = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, f"doc {chosen.schema['doc'].dataType.simpleString()}, n long, terms array<int>, tfs array<long>")


def no_random_access(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, k: int, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best of documents 0..n_docs-1 and their scores, from (documents, impacts) lists in falling impact.

    All lists are read to the same depth, which doubles from round to round. A document's score lies between
    the impacts met so far and these plus the last impact read of every list in which it was not met. Reading
    goes on until every document that can still reach the k-th lower bound, or tie with it, is known exactly.
    """
    lower = np.zeros(n_docs, np.int64)
    depth, done = FIRST_READ, 0
    while True:
        unmet, frontier = np.zeros(n_docs, np.int64), 0
        for found, impact in lists:
            lower[found[done:depth]] += impact[done:depth]
            if depth < len(found):
                last = int(impact[depth - 1])
                frontier += last
                unmet[found[:depth]] -= last
        upper = lower + unmet + frontier
        least = max(int(np.partition(lower, n_docs - k)[n_docs - k]) if k < n_docs else 0, 1)
        if not ((upper > lower) & (upper >= least)).any():
            best = np.flatnonzero(lower >= least)
            best = best[np.lexsort((tie[best], -lower[best]))][:k]
            return best, lower[best]
        done, depth = depth, 2 * depth


class Shard:
    """Impact-sorted lists of some documents; every item is ranked over them."""

    def __init__(self, weights: np.ndarray, items: list[np.ndarray], n_all: int, l_all: int, k: int):
        self.weights, self.items, self.n_all, self.l_all, self.k = weights, items, n_all, l_all, k
        self.parts: list[pa.Table] = []
        self.size = 0

    def add(self, batch: pa.RecordBatch) -> None:
        self.parts.append(pa.Table.from_batches([batch]))
        self.size += len(batch.column(2).flatten()) + batch.num_rows

    def _lists(self, table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents and impacts by term in falling impact, and where each term's list starts."""
        lengths, inverse = np.unique(table["n"].to_numpy(), return_inverse=True)
        m = np.array([10 + 90 * int(n) * self.n_all // self.l_all for n in lengths], np.int64)[inverse]
        column = table["terms"].combine_chunks()
        term = column.flatten().to_numpy(zero_copy_only=False)
        tf = table["tfs"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(table.num_rows), column.value_lengths().to_numpy(zero_copy_only=False))
        impact = self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        order = np.lexsort((-impact, term))
        return doc[order], impact[order], np.searchsorted(term[order], np.arange(len(self.weights) + 1))

    def ranked(self) -> pa.RecordBatch:
        """Rows item (its number), doc, score of the shard's best; starts afresh."""
        table = pa.concat_tables(self.parts).combine_chunks()
        self.parts, self.size = [], 0
        doc, impact, bounds = self._lists(table)
        tie = np.empty(table.num_rows, np.int64)
        tie[pa.compute.sort_indices(table["doc"]).to_numpy()] = np.arange(table.num_rows)  # nulls last
        out: list[list[np.ndarray]] = [[], [], []]
        for item, terms in enumerate(self.items):
            # a list whose impacts are all zero adds nothing to any score
            lists = [(doc[a:b], impact[a:b]) for a, b in zip(bounds[terms], bounds[terms + 1]) if a < b and impact[a] > 0]
            if lists:
                best, score = no_random_access(lists, table.num_rows, self.k, tie)
                for column, x in zip(out, (np.full(len(best), item), best, score)):
                    column.append(x)
        item, best, score = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
        return pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), table["doc"].combine_chunks().take(pa.array(best, pa.int64())),
                                           pa.array(score, pa.int64())], names=["number", "doc", "score"])


def _block_ranked(docs: DataFrame, terms: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame | None:
    """Rows item, doc, score: the best of every shard for a block of items that fits one worker."""
    spark = docs.sparkSession
    by_item: dict = {}
    for r in terms.collect():
        by_item.setdefault(r["item"], []).append(r["term"])
    if not by_item:
        return None
    vocabulary = sorted(set().union(*by_item.values()))
    marks = fingerprints(vocabulary)
    order = np.argsort(marks)
    wanted, number = marks[order], {vocabulary[v]: i for i, v in enumerate(order.tolist())}
    items = [np.sort(np.array([number[t] for t in ts], np.int64)) for ts in by_item.values()]

    found = staged(postings(docs, wanted, id_col, text_col), "postings")
    whole = found.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
    n_all, l_all = whole["n"], whole["l"] or 1
    weights = np.zeros(len(wanted), np.int64)
    for r in found.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect():
        weights[r["t"]] = math.floor(1000 * math.log((2 * n_all + 2) / (2 * r["df"] + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(weights, items, n_all, l_all, k)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                shard.add(batch.slice(at, 2048))
                if shard.size >= SHARD_POSTINGS:
                    yield shard.ranked()
        if shard.size:
            yield shard.ranked()

    best = found.mapInArrow(run, f"number int, doc {found.schema['doc'].dataType.simpleString()}, score long")
    names = spark.createDataFrame(list(enumerate(by_item)), f"number int, item {terms.schema['item'].dataType.simpleString()}")
    return best.join(F.broadcast(names), "number").select("item", "doc", "score")  # as many rows as the block has items


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """Each item's ``k`` highest-scoring documents: item_id, rank (from 1), doc_id, score.

    Documents stay where they are read. One pass keeps, of every document, its number of terms and the
    occurrences of terms that some item has. Corpus counts follow from that table. A second pass reads it in
    shards of bounded postings, sorts each shard's lists by impact and ranks every item over them with
    ``no_random_access``; shards return at most ``k`` rows an item, and the best of all shards are the answer.
    Items are dealt into blocks of about ``block_terms`` terms, one such pass each; a block is what the driver
    and a worker hold of the items. A term is told by a 64-bit fingerprint.

    Null and empty texts have no terms, score nothing and count for nothing. Repeated documents are documents
    of their own; equal scores go by doc_id, null last, and a repeated id takes as many ranks as it has rows.
    Item rows that share an id are one item, null ids too. An item without terms, and an empty table on either
    side, gives no rows. Other columns are ignored.
    """
    terms = staged(item_terms(items, item_col, item_text_col), "item-terms")
    blocks = max(1, -(-terms.count() // block_terms))
    best: DataFrame | None = None
    for b in range(blocks):
        own = terms.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        part = _block_ranked(docs, own, k, id_col, text_col)
        if part is not None:
            best = part if best is None else best.unionByName(part)
    if best is None:
        best = docs.sparkSession.createDataFrame([], f"item {terms.schema['item'].dataType.simpleString()}, "
                                                     f"doc {docs.schema[id_col].dataType.simpleString()}, score long")
    order: list[Column] = [F.col("score").desc(), F.col("doc").asc_nulls_last()]
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")
