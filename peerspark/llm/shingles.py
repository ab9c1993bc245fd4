"""Sets of word shingles as sorted 64-bit fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .wordhash import U64, mix, word_slices

_FACTORS = [U64(x) for x in (0x8CB92BA72F3D8DD7, 0xABC98388FB8FAC03, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xE7037ED1A0B428DB)]


def shingle_sets(texts: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """Per text the sorted distinct fingerprints of its shingles of ``width`` lower-cased words. A text with
    fewer words has its whole sequence as one shingle; one without words has none."""
    factors = (_FACTORS * -(-width // len(_FACTORS)))[:width]
    for part in word_slices(texts):
        h = part.hashes(lower=True)
        full = np.zeros(max(0, len(h) - width + 1), U64)
        for k, f in enumerate(factors):
            full += mix(h[k:len(h) - width + 1 + k] * f + U64(k)) if len(full) else full
        full = mix(full)
        for a, b in zip(part.row_words, part.row_words[1:]):
            if b - a >= width:
                yield np.unique(full[a:b - width + 1])
            elif b > a:
                n = int(b - a)
                one = mix(h[a:b] * np.array(factors[:n], U64) + np.arange(n, dtype=U64))
                yield mix(one.sum(keepdims=True) + U64(n))
            else:
                yield np.zeros(0, U64)
