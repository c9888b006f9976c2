import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sievra.llm import packing as P
from sievra.session import settle
from tests.llm.helpers import messy, sentence

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("text", ["a\x0bb c\x0cd", "a\x1cb", "É ÀB <|startoftext|>x <|STARTOFTEXT|>", "İ É", "a\xa0b", "ΑΣ ΑΣ b", "don't DON'T x́ ́y", "", " \n"])
def test_ids_as_the_library_gives_them(library, text):
    assert np.frombuffer(P.WordIds(PATH).ids(text.encode()), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_ids_of_words_as_the_library_gives_them(library):
    rng = np.random.default_rng(2)
    signs = list("abcdefghij" * 4 + "éèüßøœſŉǆȿʼˇªºµÿ" + "ÉŽǅΣя中" + "0159²½" + "'" * 6 + "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~" + "\u0301\u00ad\u200b\x1c\xa0…–")
    words = P.WordIds(PATH)
    texts = ["".join(rng.choice(signs, rng.integers(1, 12))) for _ in range(20_000)]
    texts += ["don't.", "it's,%%%", "abc'&&&", "l'été***", "'s", "x's's.", "...", "naïve...", "abc.def.", "<|", "a<|b", "ŉ.", "İ", "abc\u0301.", "_a_"]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for text, ids in zip(texts, want):
        assert np.frombuffer(words.ids(text.encode()), "<u4").tolist() == ids, text


def pieces_by_hand(library, docs, capacity):
    out = []
    for doc, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at : at + capacity], "<u4")
            out.append((doc, piece, at, len(part), zlib.crc32(part.tobytes())))
    return sorted(out, key=repr)


def check(found, want, capacity):
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found), key=repr) == want
    bins = {}
    for r in found:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for rows in bins.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_messy_rows(spark, library):
    df = messy(spark)
    plain = [(r.doc_id, r.text) for r in df.collect()]
    for capacity in (2048, 100):
        found = P.pack(df, PATH, capacity=capacity).collect()
        check(found, pieces_by_hand(library, plain, capacity), capacity)
    assert P.pack(df.limit(0), PATH).count() == 0


def test_groups_are_packed_together_in_the_end(spark):
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 700, 3000)
    df = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "id BIGINT, length BIGINT")
    found = P.assign(settle(df, "lengths"), 2048, group_rows=200).collect()
    fills = {}
    for r in found:
        fills[r.sequence_id] = fills.get(r.sequence_id, 0) + r.length
    least = -(-int(lengths.sum()) // 2048)
    assert len(found) == 3000 and max(fills.values()) <= 2048 and least <= len(fills) <= least * 1.01 + 1


def test_the_search_empties_bins_and_never_overfills():
    rng = np.random.default_rng(1)
    saved = 0
    for low, high in ((600, 760), (300, 1100), (1, 2049)):
        lengths = rng.integers(low, high, 3000)
        start = P.best_fit(lengths, 2048)
        search = P.LocalSearch(lengths, start.copy(), 2048)
        before = int((search.fill.astype(float) ** 2).sum())
        bins = search.run()
        fill = np.bincount(bins, lengths)
        assert fill.max() <= 2048 and (fill[fill > 0] == search.fill[search.fill > 0]).all()
        assert (fill**2).sum() >= before
        saved += len(set(start.tolist())) - len(set(bins.tolist()))
    assert saved > 0


def exact_threes(n, seed):
    first, second = np.random.default_rng(seed).integers(300, 1000, (2, n))
    return np.concatenate([first, second, 2048 - first - second])


@pytest.mark.parametrize("n, most", [(200, 202), (1000, 1014)])
def test_lengths_that_fit_only_in_exact_threes(n, most):
    lengths = exact_threes(n, 3)
    bins = P.LocalSearch(lengths, P.best_fit(lengths, 2048), 2048).run()
    assert np.bincount(bins, lengths).max() <= 2048 and n <= len(set(bins.tolist())) <= most


def exchange_left(lengths, bins, capacity):
    """True if handing over one or two pieces for none, one or two for one raises the sum of squared fills."""
    held = {b: lengths[bins == b].tolist() for b in set(bins.tolist())}
    some = {b: [(x,) for x in rows] + list(itertools.combinations(rows, 2)) for b, rows in held.items()}
    for a, b in itertools.permutations(held, 2):
        x, y = sum(held[a]), sum(held[b])
        if x == capacity or y == capacity or x > y:
            continue
        for out in some[a]:
            for back in [(), *some[b]]:
                more = sum(out) - sum(back)
                if len(out) + len(back) < 4 and 0 < more <= capacity - y:
                    return True
    return False


@pytest.mark.parametrize("low, high", [(20, 60), (34, 50), (1, 101), (5, 30), (26, 34)])
def test_no_exchange_is_left_when_the_search_ends(low, high):
    for seed in range(8):
        lengths = np.random.default_rng(seed).integers(low, high, 40)
        search = P.LocalSearch(lengths, P.best_fit(lengths, 100), 100)
        bins = search.run()
        fill = np.bincount(bins, lengths)
        assert fill.max() <= 100 and (fill[fill > 0] == search.fill[search.fill > 0]).all()
        assert len(set(bins.tolist())) == -(-int(lengths.sum()) // 100) or not exchange_left(lengths, bins, 100)


def test_amounts_of_bins_follow_the_moves():
    lengths = exact_threes(60, 5)
    search = P.LocalSearch(lengths, P.best_fit(lengths, 2048), 2048)
    search.run()
    ones, twos = search.ones, search.twos
    search._amounts()
    assert search.moves and (ones == search.ones).all() and (twos == search.twos).all()


def test_opened_sequences_are_the_emptiest_and_at_most_half_of_the_pieces():
    fill, pieces = np.array([2048, 2000, 100, 2047, 1500]), np.array([5, 5, 1, 5, 2])
    assert P._to_open(fill, pieces, 2048).tolist() == [False, False, True, False, True]
    assert P._to_open(np.array([1000, 1000]), np.array([9, 1]), 2048).sum() <= 1
    assert not P._to_open(np.array([2048, 2047]), np.array([1, 1]), 2048).any()


def test_levels_end_and_lose_little(spark):
    lengths = exact_threes(1000, 7)
    df = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "id BIGINT, length BIGINT")
    found = P.assign(settle(df, "threes"), 2048, group_rows=250).collect()
    fills = {}
    for r in found:
        fills[r.sequence_id] = fills.get(r.sequence_id, 0) + r.length
    assert sorted(r.id for r in found) == list(range(3000))
    assert max(fills.values()) <= 2048 and len(fills) <= 1040


def test_best_fit_takes_the_fullest_bin_that_has_room():
    bins = P.best_fit(np.array([7, 6, 3, 4, 5]), 10)
    assert bins[0] == bins[2] and bins[1] == bins[3] and bins[4] not in (bins[0], bins[1])


def test_sequences_hold_the_ids(spark, library):
    docs = [(i, sentence(5 + 37 * i % 300, i)) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id BIGINT, text STRING")
    packed = settle(P.pack(df, PATH, capacity=128), "packed")
    made = {r.sequence_id: np.frombuffer(r.ids, "<u4").tolist() for r in P.sequences(df, packed, PATH, capacity=128).collect()}
    ids = {d: library.encode(t, add_special_tokens=False).ids + [0] for d, t in docs}
    rows = packed.collect()
    assert sum(map(len, made.values())) == sum(map(len, ids.values()))
    for r in rows:
        assert made[r.sequence_id][r.offset : r.offset + r.length] == ids[r.doc_id][r.start : r.start + r.length]
