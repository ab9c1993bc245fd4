"""Token counts per section: whole documents encoded once, token spans joined to section spans."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

RULES = ("start", "end", "most", "share")


class Spans:
    """Encoder that tells how many bytes each token has."""

    def __init__(self, path: str, pattern: str):
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("spans", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.length[i] = len(token)

    def ends(self, text: str) -> np.ndarray:
        """Byte places at which the tokens of a text end."""
        return np.cumsum(self.length[self.encoding.encode_to_numpy(text)]) if text else np.zeros(0, np.int64)


def attribute(ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section and tokens that cross its end. ``bounds`` are the section edges from 0 to the
    length; both arrays are ordered, so the join is a merge by binary search.

    A token inside one section counts there. One that crosses an edge counts where it starts (start), where it
    ends (end), where most of its bytes are, the earlier section if they are equal (most), or in each section
    by its part of the bytes (share).
    """
    n = len(bounds) - 1
    starts = np.append(0, ends[:-1]) if len(ends) else ends
    first = np.searchsorted(bounds[1:], starts, "right")
    last = np.searchsorted(bounds[1:], ends, "left")
    crossing = np.flatnonzero(first < last)
    inner = np.bincount(np.delete(first, crossing), minlength=n).astype(float)
    over = np.zeros(n)
    for t in crossing:
        a, b = int(first[t]), int(last[t])
        edges = np.clip(bounds[a:b + 2], starts[t], ends[t])
        held = np.diff(edges)
        over[a:b] += 1
        if rule == "share":
            inner[a:b + 1] += held / held.sum()
        else:
            inner[{"start": a, "end": b, "most": a + int(held.argmax())}[rule]] += 1
    return inner, over


_SPANS: dict[tuple[str, str], Spans] = {}


def encoder(path: str, pattern: str) -> Spans:
    if (path, pattern) not in _SPANS:
        _SPANS[path, pattern] = Spans(path, pattern)
    return _SPANS[path, pattern]


def token_counts(docs: DataFrame, vocab: str, pattern: str, fields: tuple[str, ...] = ("source", "lang", "text"), body: str = "text",
                 rule: str = "most", joiner: str = " ", id_col: str = "doc_id") -> DataFrame:
    """Rows (id, section, chars, n_tokens, n_crossing): one per input row and section, in the order written.

    A document is its ``fields`` in order with ``joiner`` between them. The field ``body`` has two sections: its
    first line with the line feed, and the rest; the others are a section each. A joiner belongs to the section
    before it, so the token of a field's first word, which begins with the space, crosses an edge. The document is encoded once, as a whole. Sections meet at character edges, so byte spans decide
    as character spans would. The tokens of a document's sections add up to its tokens. n_crossing counts tokens
    that cross the section's end; see ``attribute`` for ``rule``.

    Null fields are empty sections; a section without characters has no tokens. Rows are counted alone:
    null or repeated ids change nothing; an empty table gives no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    names = [s for f in fields for s in ([f"{f}_first_line", f"{f}_rest"] if f == body else [f])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = encoder(vocab, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                chars, tokens, over = [], [], []
                for values in zip(*[rows.column(1 + k).to_pylist() for k in range(len(fields))]):
                    written = []
                    for k, (f, value) in enumerate(zip(fields, values)):
                        value = (value or "") + (joiner if k + 1 < len(fields) else "")
                        if f == body:
                            line = value.find("\n") + 1 or len(value)
                            written += [value[:line], value[line:]]
                        else:
                            written.append(value)
                    bounds = np.cumsum([0, *[len(x.encode()) for x in written]])
                    inner, cross = attribute(spans.ends("".join(written)), bounds, rule)
                    chars += map(len, written)
                    tokens.append(inner)
                    over.append(cross)
                ids = pa.array(np.repeat(np.arange(rows.num_rows), len(names)))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(ids), pa.array(names * rows.num_rows), pa.array(chars, pa.int64()),
                     pa.array(np.concatenate(tokens)), pa.array(np.concatenate(over).astype(np.int64))],
                    names=["id", "section", "chars", "n_tokens", "n_crossing"])

    chosen = docs.select(F.col(id_col).alias("id"), *[F.col(f).cast("string").alias(f"f{k}") for k, f in enumerate(fields)])
    told = chosen.mapInArrow(run, f"id {chosen.schema['id'].dataType.simpleString()}, section string, chars long, n_tokens double, n_crossing long")
    return told.select(F.col("id").alias(id_col), "section", "chars", "n_tokens" if rule == "share" else F.col("n_tokens").cast("long"), "n_crossing")
