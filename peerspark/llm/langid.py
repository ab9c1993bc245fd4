"""Language identification: unigram piece models over a fixed vocabulary, summed over all segmentations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .wordhash import U64, mix, word_slices

UNKNOWN = "und"
LONGEST = 32       # bytes of the longest piece
CELLS = 4096 * 32  # of a byte matrix of words
TINY = 1e-40       # sums below it are scaled up, their logarithm kept
_STEP = U64(0x9E3779B97F4A7C55)
_TURN = [U64(x) for x in (1, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


class Pieces:
    """The vocabulary as byte strings, a word's leading mark written as a space. A byte that is no piece of its
    own has its byte piece, so every text has a segmentation."""

    def __init__(self, path: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids: dict[bytes, int] = {}
        spare: dict[bytes, int] = {}
        for i in range(model.get_piece_size()):
            text = model.id_to_piece(i)
            if model.is_byte(i):
                spare[bytes([int(text[3:5], 16)])] = i
            elif not (model.is_control(i) or model.is_unknown(i)):
                written = text.replace("▁", " ").encode()
                if b" " not in written[1:] and len(written) <= LONGEST:
                    ids[written] = i
        for b, i in spare.items():
            ids.setdefault(b, i)
        self.size = model.get_piece_size()
        self.ids = ids
        known = dict(ids)
        for text in ids:
            for k in range(1, len(text)):
                known.setdefault(text[:k], self.size)  # a prefix only: probability 0
        prints = []
        for text in known:
            h = 0
            for b in text:
                h = (h + b + 1) * int(_STEP) & (1 << 64) - 1
            prints.append(h)
        keys, values = np.array(prints, U64), np.array(list(known.values()), np.int32)
        self.bits = 17
        while not self._fill(keys, values):
            self.bits += 1

    def _fill(self, keys: np.ndarray, values: np.ndarray) -> bool:
        """Three open tables; a key sits in the first one where its slot is free."""
        self.keys, self.values = np.zeros((3, 1 << self.bits), U64), np.full((3, 1 << self.bits), -1, np.int32)
        for t in range(3):
            slot = (mix(keys * _TURN[t]) >> U64(64 - self.bits)).astype(np.int64)
            _, first = np.unique(slot, return_index=True)
            self.keys[t, slot[first]], self.values[t, slot[first]] = keys[first], values[first]
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, values = keys[left], values[left]
        return not len(keys)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece ids by fingerprint: ``size`` for mere prefixes, -1 where no piece begins so."""
        out = np.full(len(h), -1, np.int32)
        open_ = np.arange(len(h))
        for t in range(3):
            slot = (mix(h[open_] * _TURN[t]) >> U64(64 - self.bits)).astype(np.int64)
            value = self.values[t, slot]
            hit = (self.keys[t, slot] == h[open_]) & (value >= 0)
            out[open_[hit]] = value[hit]
            open_ = open_[~hit & (value >= 0)]
        return out

    def arcs(self, text: np.ndarray, sizes: np.ndarray, first: int = 0, last: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Pieces in the rows of a byte matrix that start at positions first..last-1: (start, end, rows, ids), by start."""
        width = text.shape[1]
        for i in range(first, width if last is None else min(last, width)):
            rows = np.flatnonzero(sizes > i)
            h = np.zeros(len(rows), U64)
            for j in range(i + 1, min(i + LONGEST, width) + 1):
                fits = sizes[rows] >= j
                rows, h = rows[fits], h[fits]
                if not len(rows):
                    break
                h = (h + text[rows, j - 1].astype(U64) + U64(1)) * _STEP
                ids = self.find(h)
                going = ids >= 0
                rows, h, ids = rows[going], h[going], ids[going]
                piece = ids < self.size
                if piece.any():
                    yield i, j, rows[piece], ids[piece]


def _scaled(window: np.ndarray, offset: np.ndarray, rows: np.ndarray) -> None:
    """Scale the open sums of words that have become tiny; ``offset`` keeps the logarithm of what was taken out."""
    top = window.max(axis=0)
    small = (top < TINY) & (top > 0) & rows[:, None]
    if small.any():
        factor = np.where(small, top, 1)
        window /= factor
        offset += np.log(factor)


def plain_width(probs: np.ndarray) -> int:
    """Bytes up to which no sum of a word can vanish, however improbable its pieces: every byte is one at least."""
    return int(290 / max(1.0, -np.log10(probs[:-1].min()))) if probs[:-1].min() > 0 else 0


def forward(pieces: Pieces, text: np.ndarray, sizes: np.ndarray, probs: np.ndarray, plain: int = 0, arcs: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """alpha[position, row, model]: probability of the first bytes, summed over all segmentations, divided by the
    exponential of offset[position, row, model]. A word of any length is summed as a whole."""
    n, width = text.shape
    alpha, offset = np.zeros((width + 1, n, probs.shape[1])), np.zeros((width + 1 if width > plain else 1, n, probs.shape[1]))
    alpha[0] = 1
    done = 0
    for i, j, rows, ids in arcs or pieces.arcs(text, sizes):
        if i >= done + 8:  # every 8 positions: no piece is that improbable that sums vanish in between
            done = i
            if width > plain:
                _scaled(alpha[i:i + LONGEST + 1], moved := np.zeros(offset.shape[1:]), sizes >= i)
                if moved.any():
                    offset[i:] += moved
        alpha[j, rows] += alpha[i, rows] * probs[ids]
    return alpha, offset


def log_probability(pieces: Pieces, text: np.ndarray, sizes: np.ndarray, probs: np.ndarray, plain: int = 0) -> np.ndarray:
    """Of every word under every model, summed over all segmentations."""
    alpha, offset = forward(pieces, text, sizes, probs, plain)
    own = np.arange(len(sizes))
    return np.log(alpha[sizes, own]) + offset[sizes if len(offset) > 1 else 0, own]


def expected(pieces: Pieces, text: np.ndarray, sizes: np.ndarray, probs: np.ndarray, plain: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, ids, shares[arc, model]): how probable each piece of each word is, over all segmentations. Goes backwards in
    blocks of positions, so that a long word's pieces are never held all at once."""
    n, width = text.shape
    arcs = list(pieces.arcs(text, sizes)) if width <= plain else None
    alpha, before = forward(pieces, text, sizes, probs, plain, arcs)
    own = np.arange(n)
    whole, out = alpha[sizes, own], before[sizes if len(before) > 1 else 0, own]
    beta, offset = np.zeros_like(alpha), np.zeros((n, probs.shape[1]))
    beta[sizes, own] = 1
    if arcs is not None:
        for i, j, rows, ids in reversed(arcs):
            beta[i, rows] += beta[j, rows] * probs[ids]
            yield rows, ids, alpha[i, rows] * probs[ids] * beta[j, rows] / whole[rows]
        return
    for first in range((width - 1) // 8 * 8, -1, -8):
        block = list(pieces.arcs(text, sizes, first, first + 8))
        for i, j, rows, ids in reversed(block):
            beta[i, rows] += beta[j, rows] * probs[ids]
        for i, j, rows, ids in block:
            with np.errstate(divide="ignore"):  # the logarithm of no probability
                share = np.log(alpha[i, rows]) + np.log(probs[ids]) + np.log(beta[j, rows]) - np.log(whole[rows])
            yield rows, ids, np.exp(share + before[i, rows] + offset[rows] - out[rows])
        _scaled(beta[first:first + LONGEST + 1], offset, sizes >= first)


def _gathered(arcs: Iterator[tuple[np.ndarray, ...]], most: int = 1 << 18) -> Iterator[list[np.ndarray]]:
    """Arcs put together, up to about ``most`` at a time."""
    held, n = [], 0
    for arc in arcs:
        held.append(arc)
        n += len(arc[0])
        if n >= most:
            yield [np.concatenate(x) for x in zip(*held)]
            held, n = [], 0
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def _matrices(part, first_of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Distinct words, a mark before each, as byte matrices of similar length: (word numbers, matrix, sizes)."""
    begin, size = part.starts[first_of], part.ends[first_of] - part.starts[first_of] + 1
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        chosen = order[at:at + 4096]
        chosen = chosen[:max(1, int(np.searchsorted(size[chosen] * np.arange(1, len(chosen) + 1), CELLS, "right")))]
        width = int(size[chosen].max())
        place = begin[chosen, None] - 1 + np.arange(width)  # one byte early: the word's mark
        matrix = part.data[np.clip(place, 0, len(part.data) - 1)]
        matrix[:, 0] = 32
        yield chosen, matrix, size[chosen]
        at += len(chosen)


_PIECES: dict[str, Pieces] = {}


def vocabulary(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def held_out(id_col: str = "doc_id") -> Column:
    """One fifth of the ids by checksum; rows without an id too."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def learn(docs: DataFrame, vocab: str, lang_col: str = "lang", text_col: str = "text",
          rounds: int = 1, smoothing: float = 0.1) -> tuple[list[str], np.ndarray]:
    """Languages and piece probabilities (piece, language) from all rows with a language and a text.

    Expectation maximisation from equally likely pieces: each task sums the expected counts of the pieces
    over all segmentations of its distinct words, per language. What reaches the driver is one number per
    piece and language, whatever the size of the corpus. Counts are fixed-point, so their sums have no order.
    """
    spark = docs.sparkSession
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    size = vocabulary(vocab).size
    probs = np.full((size + 1, 1), 1 / size)
    if not langs:
        return [], probs
    for _ in range(rounds):
        model = spark.sparkContext.broadcast(probs)

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces, total = vocabulary(vocab), np.zeros((len(langs), size + 1))
            place, p = pa.array(langs), model.value
            plain = plain_width(p)
            for batch in batches:
                lang = pa.compute.index_in(batch.column(0), place).to_numpy(zero_copy_only=False)
                for part in word_slices(batch.column(1)):
                    if not len(part.starts):
                        continue
                    _, first, nth = np.unique(part.hashes(), return_index=True, return_inverse=True)
                    spoken = lang[part.first:part.last][part.row_of_word()]
                    times = np.bincount(nth * len(langs) + spoken, minlength=len(first) * len(langs)).reshape(-1, len(langs))
                    for word, matrix, sizes in _matrices(part, first):
                        for who, which, share in _gathered(expected(pieces, matrix, sizes, p, plain)):
                            for k in range(len(langs)):
                                total[k] += np.bincount(which, share[:, k if p.shape[1] > 1 else 0] * times[word[who], k], size + 1)
            for k, row in enumerate(total):
                some = np.flatnonzero(row)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int32)), pa.array(some.astype(np.int32)),
                                                  pa.array(np.rint(row[some] * 65536).astype(np.int64))], names=["lang", "piece", "n"])

        found = rows.mapInArrow(expect, "lang int, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros((size, len(langs)))
        counts[found["piece"], found["lang"]] = found["n"] / 65536
        counts += smoothing
        probs = np.vstack([counts / counts.sum(axis=0), np.zeros((1, len(langs)))])
    return langs, probs


def identify(docs: DataFrame, vocab: str, langs: list[str], probs: np.ndarray, id_col: str = "doc_id",
             text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: ``id_col``, the ``carry`` columns, lang_pred, score, per_byte.

    A text's probability under a language is the product over its words of the sum over all segmentations
    into pieces. The score is the best language's share when all are equally likely beforehand; per_byte is the
    logarithm of the probability under it, by bytes of words and their marks, whatever the length of the text.
    A text that is null or has no letter is ``und`` with score 0 and per_byte null, and so is every text if no
    language was learnt. Rows are judged alone, so repeated rows and null ids change nothing; an empty table
    gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(probs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, p = vocabulary(vocab), model.value
        plain = plain_width(p)
        for batch in batches:
            best, score, per_byte = [], [], []
            for part in word_slices(batch.column(1)):
                sums = np.zeros((part.last - part.first, p.shape[1]))
                if len(part.starts) and langs:
                    _, first, nth = np.unique(part.hashes(), return_index=True, return_inverse=True)
                    each = np.zeros((len(first), p.shape[1]))
                    for word, matrix, sizes in _matrices(part, first):
                        each[word] = log_probability(pieces, matrix, sizes, p, plain)
                    row = part.row_of_word()
                    for k in range(p.shape[1]):
                        sums[:, k] = np.bincount(row, each[nth, k], part.last - part.first)
                top = sums.max(axis=1, keepdims=True)
                share = 1 / np.exp(sums - top).sum(axis=1)
                long = np.bincount(part.row_of_word(), part.ends - part.starts + 1, part.last - part.first)
                mean = top[:, 0] / np.maximum(long, 1)
                lower = part.data | 32
                letters = np.append(0, np.cumsum((lower >= 97) & (lower <= 122)))[part.bounds]
                for i, k in enumerate(sums.argmax(axis=1)):
                    lettered = letters[i + 1] > letters[i] or any(
                        c.isalpha() for c in part.data[part.bounds[i]:part.bounds[i + 1]].tobytes().decode())
                    best.append(langs[k] if lettered and langs else UNKNOWN)
                    score.append(float(share[i]) if lettered and langs else 0.0)
                    per_byte.append(float(mean[i]) if lettered and langs else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string()), pa.array(score, pa.float64()),
                                              pa.array(per_byte, pa.float64())], names=["own", "lang_pred", "score", "per_byte"])

    keep = [id_col, *[c for c in carry if c != id_col]]
    rows = docs.select(F.struct(*[F.col(c).alias(f"c{k}") for k, c in enumerate(keep)]).alias("own"), F.col(text_col).alias("text"))
    told = rows.mapInArrow(run, f"own {rows.schema['own'].dataType.simpleString()}, lang_pred string, score double, per_byte double")
    return told.select(*[F.col(f"own.c{k}").alias(c) for k, c in enumerate(keep)], "lang_pred", "score", "per_byte")


def plausible(told: DataFrame, learnt: Column, text: Column, margin: float = 0.5) -> DataFrame:
    """Rows of ``identify`` that are not less probable by byte than every text that was learnt from, of at least half
    their length, less ``margin``. Short texts vary more than long ones, so the bound follows from the length: one
    number for each power of two. Without such a text the longest ones bound it; without any, all rows stay."""
    size = F.floor(F.log2(F.coalesce(F.octet_length(text), F.lit(0)) + 1)).cast("int")
    sized = told.withColumn("_size", size)
    least = {r["_size"]: r["m"] for r in sized.filter(learnt & F.col("per_byte").isNotNull()).groupBy("_size").agg(F.min("per_byte").alias("m")).collect()}
    if not least:
        return told
    floors = [min([m for s, m in least.items() if s >= min(k - 1, max(least))]) - margin for k in range(64)]
    floor = F.element_at(F.array(*[F.lit(float(f)) for f in floors]), F.col("_size") + 1)
    return sized.filter(F.col("per_byte").isNull() | (F.col("per_byte") >= floor)).drop("_size")
