"""BPE, packing and token attribution."""

import array
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from samples import odd_rows
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from peerspark.llm.bpe import bpe_decode, bpe_encode, bpe_round_trip, coder
from peerspark.llm.packing import best_fit_packing, plan_slots
from peerspark.llm.tokencount import attribute, token_counts
from peerspark.llm.wordids import WordIds

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXT = st.lists(st.sampled_from(list("aB é'st.,!1 \n\t\x1c\x85　ßİΣ😀<|") + ["<|endoftext|>", "the", " the"]), max_size=40).map("".join)


BYTE_LIBRARY, WORD_LIBRARY, OURS = Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS), WordIds(WORDS, keep=5)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_bpe_equals_the_library(text):
    library = BYTE_LIBRARY
    want = library.encode(text, add_special_tokens=False).ids
    got = array.array("i", coder(BYTES).encode([text.encode()])[0]).tolist()
    assert got == want and coder(BYTES).decode(got) == library.decode(want, skip_special_tokens=False)


def test_bpe_decodes_any_ids():
    rnd = random.Random(1)
    for _ in range(300):
        ids = [rnd.randrange(50257) for _ in range(5)]
        assert coder(BYTES).decode(ids) == BYTE_LIBRARY.decode(ids, skip_special_tokens=False)


def test_rows_decode_apart():
    """Ids that end or start inside a character belong to their own rows."""
    one = BYTE_LIBRARY.encode("é日", add_special_tokens=False).ids
    rows = [one[:1], one[1:], [], one, one[2:]]
    bounds = np.cumsum([0, *map(len, rows)])
    got = coder(BYTES).decode_all(np.array(sum(rows, []), np.int64), bounds).to_pylist()
    assert got == [BYTE_LIBRARY.decode(r, skip_special_tokens=False) for r in rows]


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=0x2AF, exclude_categories=["Cs"]), max_size=60))
def test_latin_pieces_equal_the_library(text):
    assert array.array("i", coder(BYTES).encode([text.encode()])[0]).tolist() == BYTE_LIBRARY.encode(text, add_special_tokens=False).ids


def test_bpe_on_odd_rows(spark, odd, none):
    both = bpe_decode(bpe_encode(odd, BYTES), BYTES)
    got = sorted((str(r["doc_id"]), tuple(r["ids"]), r["text"]) for r in both.collect())
    assert got == sorted((str(r[0]), tuple(BYTE_LIBRARY.encode(r[1] or "", add_special_tokens=False).ids), r[1] or "") for r in odd_rows())
    assert sorted((str(r["doc_id"]), tuple(r["ids"]), r["text"]) for r in bpe_round_trip(odd, BYTES).collect()) == got
    assert bpe_encode(none, BYTES).count() == 0 and bpe_round_trip(none, BYTES).count() == 0
    assert bpe_decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), BYTES).first()["text"] == ""


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_word_ids_equal_the_library(text):
    library = WORD_LIBRARY
    assert array.array("I", OURS.encode([text.encode()])[0]).tolist() == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(st.characters(max_codepoint=0x1FF, exclude_categories=["Cs"]), max_size=60))
def test_latin_word_ids_equal_the_library(text):
    assert array.array("I", OURS.encode([text.encode()])[0]).tolist() == WORD_LIBRARY.encode(text, add_special_tokens=False).ids


def test_long_texts_are_encoded_in_parts():
    text = "Ein Wort, zwei. " * 90_000 + "日本 " * 400_000
    want = WORD_LIBRARY.encode(text, add_special_tokens=False).ids
    assert array.array("I", OURS.encode([text.encode()])[0]).tolist() == want


def filled(plan, counts, capacity):
    bins = {}
    for length, a, b, first, offset in plan:
        for r in range(a, b):
            bins.setdefault(first + r - a, []).append((offset, length))
            counts[length] -= 1
    assert not any(counts.values())
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 40), min_size=1))
def test_plan_is_best_fit(counts):
    """As many sequences as best fit decreasing opens when it takes the pieces one by one."""
    room = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fit = min((r for r in room if r >= length), default=None)
            if fit is None:
                fit = 20
            else:
                room.remove(fit)
            room.append(fit - length)
    assert filled(plan_slots(counts, 20), dict(counts), 20) == len(room)


def test_plan_does_not_grow_with_the_corpus():
    small, large = ({k: n * (k % 7 + 1) for k in range(1, 2049)} for n in (10, 10**8))
    assert len(plan_slots(large)) < 3 * len(plan_slots(small)) < 40_000


@pytest.mark.parametrize("capacity", [2048, 50])
def test_packing_on_odd_rows(odd, none, capacity):
    rows = best_fit_packing(odd, WORDS, capacity).collect()
    want = []
    for r in odd_rows():
        ids = [*WORD_LIBRARY.encode(r[1] or "", add_special_tokens=False).ids, 0]
        for k, a in enumerate(range(0, len(ids), capacity)):
            part = ids[a:a + capacity]
            want.append((str(r[0]), k, a, len(part), zlib.crc32(array.array("I", part).tobytes())))
    assert sorted((str(r[0]), *r[1:5]) for r in rows) == sorted(want)
    used = {}
    for r in rows:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for content in used.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= capacity
    assert best_fit_packing(none, WORDS).count() == 0


def test_token_attribution_rules():
    ends, bounds = np.array([2, 5, 9, 10]), np.array([0, 4, 4, 6, 10])
    got = {rule: attribute(ends, bounds, rule)[0].tolist() for rule in ("start", "end", "most", "share")}
    assert got["start"] == [2, 0, 1, 1] and got["end"] == [1, 0, 1, 2] and got["most"] == [2, 0, 0, 2]
    assert got["share"] == pytest.approx([1 + 2 / 3, 0, 1 / 3 + 1 / 4, 1 + 3 / 4])
    assert attribute(ends, bounds, "start")[1].tolist() == [1, 1, 1, 0]


@pytest.mark.parametrize("rule", ["start", "end", "most", "share"])
def test_token_counts_add_up(odd, none, rule):
    vocab = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = token_counts(odd, vocab, public_tokenizers.PATTERN, rule=rule).collect()
    assert len(rows) == 4 * len(odd_rows())
    library = Tokenizer.from_file(BYTES)
    library.encode_special_tokens = True
    total = sum(len(library.encode(f"{r[3] or ''} {r[2] or ''} {r[1] or ''}", add_special_tokens=False).ids) for r in odd_rows())
    assert sum(r["n_tokens"] for r in rows) == pytest.approx(total)
    assert sum(r["chars"] for r in rows) == sum(len(f"{r[3] or ''} {r[2] or ''} {r[1] or ''}") for r in odd_rows())
    assert token_counts(none, vocab, public_tokenizers.PATTERN, rule=rule).count() == 0
