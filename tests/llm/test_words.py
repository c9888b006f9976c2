import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from sievra.llm import words as W
from tests.llm.helpers import LOWER, shingles

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB c\n\té.xyz", max_size=40)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.sampled_from([1, 2, 5, 64]), st.sampled_from([1, 2, 5]))
def test_words_and_shingles_as_by_hand(texts, piece, k):
    raw, offsets = W.text_buffers(pa.array(texts, pa.string()))
    hashes, starts = W.word_hashes(raw, offsets, piece=piece)
    plain = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").translate(LOWER).encode()) for t in texts]
    assert np.diff(starts).tolist() == [len(w) for w in plain]
    flat = [w for row in plain for w in row]
    assert len(set(zip(flat, hashes.tolist()))) == len(set(flat)) == len(set(hashes.tolist()))
    items, places = W.distinct_by_row(*W.shingle_hashes(hashes, starts, k))
    assert np.diff(places).tolist() == [len(shingles(t, k)) for t in texts]


def test_slices_and_large_words():
    column = pa.array(["skip", "b" * 5000 + " c", None, "b" * 5000])
    raw, offsets = W.text_buffers(column.slice(1))
    hashes, starts = W.word_hashes(raw, offsets, piece=100)
    assert starts.tolist() == [0, 2, 2, 3] and hashes[0] == hashes[2]


def test_pieces_cover_all_rows():
    assert W.pieces_of(np.array([0, 5, 5, 100, 101]), 10) == [(0, 2), (2, 3), (3, 4)]


@pytest.mark.parametrize("k", [1, 2, 5])
def test_short_sequences_are_one_shingle_of_their_own(k):
    raw, offsets = W.text_buffers(pa.array(["a", "a a", "a a a"]))
    found, places = W.shingle_hashes(*W.word_hashes(raw, offsets), k)
    first = [found[p] for p in places[:-1]]
    assert len(set(first)) == min(k, 3)
