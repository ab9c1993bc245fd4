"""Token ids of texts by the tokenizers library, asked once per distinct word.

The word-end tokenizer drops white space and never merges across it, so a text's ids are those of its
pieces in order. Pieces of texts below U+0180 are told here and go straight to the tokenizer's merges; other
texts are asked word by word. Each worker keeps the ids of recent pieces; the kept set is bounded.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator

from .bpe import Recent, latin_classes

_TAIL = b".,;:!?$%&*#"
_KEEP = 200_000


class WordIds:
    """Ids as little-endian 32-bit bytes. ``young`` and ``old`` hold at most ``keep`` words each
    besides those of one call."""

    def __init__(self, path: str, keep: int = _KEEP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.keep = keep
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.model = self.tokenizer.model
        # U+0100 on: how byte-level vocabularies write the bytes that are no printable Latin-1
        plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        self.written = {b: 0x100 + k for k, b in enumerate(b for b in range(256) if b not in plain)}
        letters, numbers, spaces = latin_classes(0x180)
        # the tokenizer's own pre-tokenisation pattern; white space between its pieces is dropped
        self.latin = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{spaces}{letters}{numbers}]+")
        self.recent, self.before = Recent(self._known), Recent(self._known)
        self.direct = all(self._letters(p.encode()) == array("I", self.tokenizer.encode(p, add_special_tokens=False).ids).tobytes()
                          for p in ("word", "Wörter", "élan", "straße", "niño"))

    def _letters(self, stem: bytes) -> bytes | None:
        """Ids of a stem of Latin letters below U+0240 straight from the merges: such a stem is one piece for
        the tokenizer, and its normal form is its lower case. None for other stems."""
        if max(stem) >= 0xC9:
            return None
        text = stem.decode().lower()
        if not text.isalpha():
            return None
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(self.written)
        return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()

    def _known(self, piece: str) -> bytes:
        have = self.before.get(piece)
        if have is None:
            written = piece if piece.isascii() and piece.isalnum() else piece.encode().decode("latin-1").translate(self.written)
            have = array("I", [t.id for t in self.model.tokenize(written)]).tobytes()
        return have

    def _parts(self, word: bytes) -> tuple[bytes, bytes]:
        """The word as a stem and a run of punctuation, each encoded alone: no token spans a change
        from an ASCII letter or digit to such a run. ASCII stems are lower-cased as the tokenizer does."""
        stem = word.rstrip(_TAIL)
        if not stem or stem[-1] > 127 or not stem[-1:].isalnum():
            stem = word
        tail = word[len(stem):]
        return (stem.lower() if stem.isascii() and b"<|" not in stem else stem), tail

    def learn(self, words: set[bytes]) -> None:
        young, old = self.young, self.old
        if len(young) > self.keep:
            self.old = old = young
            self.young = young = {}
        missing = []
        for w in words.difference(young):
            have = old.get(w)
            if have is None:
                missing.append(w)
            else:
                young[w] = have
        parts = {w: self._parts(w) for w in missing}
        fresh = set()
        for p in parts.values():
            for x in p:
                if x and x not in young:
                    have = old.get(x)
                    if have is None:
                        fresh.add(x)
                    else:
                        young[x] = have
        ask = []
        for x in fresh:
            have = self._letters(x) if self.direct else None
            if have is None:
                ask.append(x)
            else:
                young[x] = have
        for x, e in zip(ask, self.tokenizer.encode_batch_fast([x.decode() for x in ask], add_special_tokens=False)):
            young[x] = array("I", e.ids).tobytes()
        for w, (stem, tail) in parts.items():
            if w not in young:
                young[w] = young[stem] + (young[tail] if tail else b"")

    def _plain(self, text: str) -> bool:
        """Whether the text's normal form is its lower case, character by character, and it holds no special token."""
        return self.direct and "<|" not in text and (text.isascii() or (max(text) < "\u0180" and "\u0130" not in text))

    def encode(self, texts: Iterable[bytes]) -> list[bytes]:
        out = []
        for raw in texts:
            parts = []
            for block in _blocks(raw):
                text = block.decode()
                if self._plain(text):
                    if len(self.recent) > self.keep:
                        self.before, self.recent = self.recent, Recent(self._known)
                    parts.append(b"".join(map(self.recent.__getitem__, self.latin.findall(text.lower()))))
                else:
                    words = block.split()
                    self.learn(set(words))
                    parts.append(b"".join(map(self.young.__getitem__, words)))
            out.append(b"".join(parts))
        return out


def _blocks(raw: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """A text in parts that end at a space, so that a very long one is not held as pieces all at once."""
    at = 0
    while len(raw) - at > size:
        end = raw.find(b" ", at + size)
        if end < 0:
            break
        yield raw[at:end]
        at = end
    yield raw[at:]


_ENCODERS: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    """The worker's encoder for this file, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordIds(path)
    return _ENCODERS[path]
