"""Text helpers: JVM expressions, and small per-value functions for pandas UDFs."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

# whitespace as Python's str.split sees it
SPACE = "[\\t-\\r\\x1c-\\x20\\x85\\p{Z}]+"


AT_ONCE = 64  # texts of a batch that are Python strings at a time


def _each(f: Callable[..., str], *columns: pa.Array) -> pa.Array:
    """``f`` of each row, null where a value is null. A batch stays Arrow but for a few rows at a time."""
    parts = [pa.array([None if None in row else f(*row) for row in zip(*[c.slice(a, AT_ONCE).to_pylist() for c in columns])], pa.string())
             for a in range(0, len(columns[0]), AT_ONCE)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


class _TextOnly(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []

    def handle_data(self, data: str) -> None:
        self.out.append(data)

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag == "br":
            self.out.append("\n")


def html_to_text(html: str) -> str:
    """Text of an HTML fragment; ``<br>`` becomes a newline, entities are unescaped."""
    parser = _TextOnly()
    parser.feed(html)
    parser.close()
    return "".join(parser.out)


@F.arrow_udf(StringType())
def strip_html(html: pa.Array) -> pa.Array:
    return _each(html_to_text, html)


# what a byte from 0x80 on is read as under the wrong code page; the five that the page leaves out stay control characters
_READ_AS = {b: bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0x100)}
_BYTE_OF = {c: b for b, c in _READ_AS.items()} | {chr(b): b for b in range(0x80, 0xA0)}
_some = lambda a, b: "[" + "".join(sorted({re.escape(c) for c, x in _BYTE_OF.items() if a <= x <= b})) + "]"
_LATER = _some(0x80, 0xBF)
_DAMAGED = re.compile(f"(?:{_some(0xC2, 0xDF)}{_LATER}|{_some(0xE0, 0xEF)}{_LATER}{{2}}|{_some(0xF0, 0xF4)}{_LATER}{{3}})+")


def _undone(run: re.Match) -> str:
    """The run as it was before its UTF-8 bytes were read under the wrong code page, if that is more plausible."""
    try:
        was = bytes(_BYTE_OF[c] for c in run[0]).decode()
    except UnicodeDecodeError:
        return run[0]
    # one character of two bytes may be an accent before a dash or a quote: believed only where it is a common one
    plausible = len(was) > 1 or len(run[0]) > 2 or "\xa0" <= was < "\u0180"
    return was if plausible and not any(unicodedata.category(c) in ("Cn", "Co", "Cs") or "\x80" <= c < "\xa0" and c not in _BYTE_OF for c in was) else run[0]


def repair_encoding(text: str) -> str:
    """Text whose UTF-8 bytes were read as a Western code page, once or several times, in whole or in parts. Each step
    undoes one reading and makes damaged runs shorter; it ends when no run is left that gets more plausible."""
    while True:
        before, text = text, _DAMAGED.sub(_undone, text)
        if text == before:
            return text


def cleaned(text: str) -> str:
    return unicodedata.normalize("NFKC", repair_encoding(html_to_text(text)))


@F.arrow_udf(StringType())
def clean_text(text: pa.Array) -> pa.Array:
    """Tags removed, damaged encoding repaired, compatibility characters normalised (NFKC)."""
    return _each(cleaned, text)


@F.arrow_udf(StringType())
def _clean_pair(title: pa.Array, body: pa.Array) -> pa.Array:
    return _each(lambda t, b: f"{cleaned(t)}\n{cleaned(b)}", title, body)


def merge_title_body(title: Column, body: Column, dummy_prefix: str) -> Column:
    """Cleaned title and body in one text; an auto-generated body counts as empty."""
    return _clean_pair(title, F.when(body.startswith(dummy_prefix), F.lit("")).otherwise(body))


def tokens(text: Column | str) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(t, SPACE), lambda w: w != "")


def normalised(text: Column | str, lowercase: bool = True) -> Column:
    """Whitespace-joined lower-case tokens with ``:`` and ``|`` spelled out."""
    joined = F.array_join(tokens(text), " ")
    return F.replace(F.replace(F.lower(joined) if lowercase else joined, F.lit(":"), F.lit("COLON")), F.lit("|"), F.lit("PIPE"))


def preview(text: Column | str, limit: int = 175) -> Column:
    """One-line preview, cut at ``limit`` characters, links replaced."""
    t = F.translate(F.col(text) if isinstance(text, str) else text, "\n\t\r", "   ")
    cut = F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit(" ..."))).otherwise(t)
    return F.regexp_replace(cut, r"https?://\S*\s", "[link] ")


def suspicious_link(text: Column | str) -> Column:
    """Something a mail client may take for a link: one to three characters, a dot, more text."""
    return F.col(text).rlike(r"(^|\s|/)[^.\s]{1,3}\.[^.\s]\S*") if isinstance(text, str) else text.rlike(r"(^|\s|/)[^.\s]{1,3}\.[^.\s]\S*")


def word_distance(words: Column, default_words: list[str]) -> Column:
    """Word-level edit distance to a fixed text. Each of its words gets one letter and any other
    word a common one, so the built-in character distance counts words."""
    letters = {w: chr(0x4E00 + i) for i, w in enumerate(dict.fromkeys(default_words))}
    table = F.create_map(*[F.lit(x) for kv in letters.items() for x in kv])
    coded = F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), F.lit("#"))), "")
    return F.levenshtein(coded, F.lit("".join(letters[w] for w in default_words)))


def hashing_encoder(dim: int = 64):
    """Test encoder: mean of hashed token vectors. Any function text batch -> matrix fits here."""
    import zlib

    def encode(texts: pd.Series) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for i, t in enumerate(texts):
            words = (t or "").split()
            idx = np.fromiter((zlib.crc32(w.encode()) for w in words), dtype=np.int64, count=len(words))
            np.add.at(out[i], idx % dim, np.where(idx // dim % 2 == 0, 1.0, -1.0))
            if words:
                out[i] /= len(words)
        return out
    return encode
