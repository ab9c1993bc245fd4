"""Byte-level BPE: encoding by a priority queue of merge ranks over a doubly linked symbol list, decoding by
concatenating vocabulary strings."""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .wordhash import column_bytes

# fixed value: the pre-tokenisation pattern of this vocabulary, white space spelled as the property it means
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
           r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
_BLANK = regex.compile(r"\p{White_Space}")
_KEEP = 400_000


def byte_names() -> dict[str, int]:
    """Characters by which a byte-level vocabulary writes bytes: printable Latin-1 stands for itself, the
    other bytes take the characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names = {chr(b): b for b in plain}
    names.update({chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))})
    return names


def latin_classes(limit: int = 0x250) -> tuple[str, str, str]:
    """Letters, numbers and white space below ``limit``, spelled for a character class."""
    chars = [chr(c) for c in range(limit)]
    spelled = lambda keep: "".join(re.escape(c) for c in chars if keep(c))
    letters, numbers = (spelled(lambda c: unicodedata.category(c)[0] == kind) for kind in "LN")
    return letters, numbers, spelled(lambda c: bool(_BLANK.match(c)))


def _latin_pattern() -> re.Pattern:
    """PATTERN for texts below U+0250, its classes spelled as the characters that they hold there."""
    letters, numbers, spaces = latin_classes()
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{spaces}{letters}{numbers}]+"
                      rf"|[{spaces}]+(?![^{spaces}])|[{spaces}]+")


class Recent(dict):
    """Ids of pieces; a piece not seen lately is encoded when it is asked for."""

    def __init__(self, find):
        super().__init__()
        self.find = find

    def __missing__(self, piece: str) -> bytes:
        have = self.find(piece)
        if len(piece) <= 64:
            self[piece] = have
        return have


class Bpe:
    """Encoder and decoder of one vocabulary file. The ids of recent pieces are kept, a bounded number."""

    def __init__(self, path: str, keep: int = _KEEP):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, names = spec["model"]["vocab"], byte_names()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        strings = [b""] * (1 + max([*vocab.values(), *special.values()]))
        for token, i in vocab.items():
            strings[i] = (bytes(names[c] for c in token) if all(c in names for c in token) else token.encode())
        for token, i in special.items():
            strings[i] = token.encode()
        self.table = np.frombuffer(b"".join(strings), np.uint8)  # all vocabulary strings, one after the other
        self.length = np.array([len(x) for x in strings], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.special = special
        self.in_angles = all("<" in t for t in special)
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.of_byte = [0] * 256
        for c, b in names.items():
            self.of_byte[b] = vocab[c]
        self.ranks: list[dict[int, int]] = [{} for _ in strings]  # by left id, right id: rank
        self.merged: list[int] = []                               # by rank: id
        for r, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]):
            self.ranks[vocab[a]].setdefault(vocab[b], r)
            self.merged.append(vocab[a + b])
        self.pieces, self.latin = regex.compile(PATTERN), _latin_pattern()
        self.keep = keep
        self.young, self.old = Recent(self._known), Recent(self._known)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece. Merges are taken by (rank, place); an entry whose pair has changed since it was
        queued is stale and skipped."""
        ranks, merged = self.ranks, self.merged
        symbol = [*map(self.of_byte.__getitem__, piece)]
        n = len(symbol)
        if n == 1:
            return symbol
        bits = 12 if n < 4096 else 40
        mask = (1 << bits) - 1
        pair = [ranks[a].get(b, -1) for a, b in zip(symbol, symbol[1:])]
        pair.append(-1)
        queue = [r << bits | i for i, r in enumerate(pair) if r >= 0]
        heapify(queue)
        after, before = [*range(1, n + 2)], [*range(-1, n)]
        while queue:
            entry = heappop(queue)
            i, r = entry & mask, entry >> bits
            if pair[i] != r:
                continue
            new = merged[r]
            j = after[i]
            k = after[i] = after[j]
            symbol[i] = new
            symbol[j] = pair[j] = -1
            if k < n:
                before[k] = i
                r = pair[i] = ranks[new].get(symbol[k], -1)
                if r >= 0:
                    heappush(queue, r << bits | i)
            else:
                pair[i] = -1
            h = before[i]
            if h >= 0:
                r = pair[h] = ranks[symbol[h]].get(new, -1)
                if r >= 0:
                    heappush(queue, r << bits | h)
        return [s for s in symbol if s >= 0]

    def may_be_special(self, text: str) -> bool:
        return "<" in text and any(t in text for t in self.special) if self.in_angles else any(t in text for t in self.special)

    def _known(self, piece: str) -> bytes:
        have = self.old.get(piece)
        return array("i", self.merge(piece.encode())).tobytes() if have is None else have

    def _coded(self, text: str) -> bytes:
        latin = text.isascii() or max(text) < "\u0250"
        return b"".join(map(self.young.__getitem__, (self.latin if latin else self.pieces).findall(text)))

    def encode(self, texts: Iterable[bytes]) -> list[bytes]:
        """Ids of whole texts as little-endian 32-bit bytes."""
        out = []
        for raw in texts:
            if len(self.young) > self.keep:
                self.old, self.young = self.young, Recent(self._known)
            text = raw.decode()
            if self.may_be_special(text):
                out.append(b"".join(array("i", [self.special[part]]).tobytes() if k % 2 else self._coded(part)
                                    for k, part in enumerate(self.cut_special.split(text))))
            else:
                out.append(self._coded(text))
        return out

    def decode_all(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """Texts of many rows, whose ids lie between ``bounds``: vocabulary strings put together. Bytes that are not
        UTF-8 become U+FFFD."""
        length = self.length[ids]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        data = self.table[np.repeat(self.start[ids] - (ends - length), length) + np.arange(total)]
        cuts = np.append(0, ends)[bounds]
        whole = data.tobytes()
        try:
            whole.decode()
            clean = not ((data[cuts[:-1][cuts[:-1] < total]] & 0xC0) == 0x80).any()  # no row starts inside a character
        except UnicodeDecodeError:
            clean = False
        if clean and total < 1 << 31:
            return pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(whole))
        return pa.array([whole[a:b].decode("utf-8", "replace") for a, b in zip(cuts.tolist(), cuts[1:].tolist())], pa.string())

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(np.array(ids, np.int64), np.array([0, len(ids)]))[0].as_py()


_CODERS: dict[str, Bpe] = {}


def coder(path: str) -> Bpe:
    """The worker's coder for this file, kept between tasks."""
    if path not in _CODERS:
        _CODERS[path] = Bpe(path)
    return _CODERS[path]


def _encoded(bpe: Bpe, batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Slices of a batch (ids column, text column): its rows' ids column, token ids, and their bounds."""
    raw, bounds = column_bytes(batch.column(1))
    row, rows = 0, len(bounds) - 1
    while row < rows:
        last = max(row + 1, int(np.searchsorted(bounds, bounds[row] + (1 << 20), "right")) - 1)
        data, own = raw[bounds[row]:bounds[last]].tobytes(), (bounds[row:last + 1] - bounds[row]).tolist()
        coded = bpe.encode(data[a:b] for a, b in zip(own, own[1:]))
        ends = np.cumsum([0, *[len(c) // 4 for c in coded]]).astype(np.int32)
        yield batch.column(0).slice(row, last - row), np.frombuffer(b"".join(coded), np.int32), ends
        row = last


def bpe_encode(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, ids array<int>), one per input row, of whole texts; special tokens written in a text count
    as such. A null or empty text has no ids. Ids that are null or repeated are passed through; other
    columns are ignored; an empty table gives no rows. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(vocab)
        for batch in batches:
            for own, ids, ends in _encoded(bpe, batch):
                yield pa.RecordBatch.from_arrays([own, pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], names=["id", "ids"])

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, f"id {chosen.schema['id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)


def bpe_round_trip(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, ids, text) as ``bpe_decode`` gives them for ``bpe_encode``, in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(vocab)
        for batch in batches:
            for own, ids, ends in _encoded(bpe, batch):
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))
                yield pa.RecordBatch.from_arrays([own, lists, bpe.decode_all(ids, ends)], names=["id", "ids", "text"])

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return (chosen.mapInArrow(run, f"id {chosen.schema['id'].dataType.simpleString()}, ids array<int>, text string")
            .withColumnRenamed("id", id_col))


def bpe_decode(encoded: DataFrame, vocab: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows (id, ids, text), special tokens included, one per input row. Null or empty ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(vocab)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sizes = part.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                texts = bpe.decode_all(part.column(1).flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(sizes)))
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=["id", "ids", "text"])

    chosen = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return (chosen.mapInArrow(run, f"id {chosen.schema['id'].dataType.simpleString()}, ids array<int>, text string")
            .withColumnRenamed("id", id_col))
