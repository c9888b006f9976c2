import numpy as np
import pyarrow as pa

from sievra.llm import language_id as L
from sievra.llm.words import text_buffers
from tests.llm.helpers import messy

GERMAN = "der Hund und die Katze sind heute nicht im Garten gewesen weil es schneit und kalt ist".split()
ENGLISH = "the dog and the cat were not in the garden today because it is snowing and cold".split()


def say(words, n, at):
    return " ".join(words[(at * 7 + i * (1 + at % 5)) % len(words)] for i in range(n))


def plain_bits(training: list[bytes], text: bytes, order: int, min_count: int, kept: set[bytes]):
    """Code length byte by byte, from counts kept in dictionaries."""
    counts: dict[bytes, dict[int, int]] = {}
    for t in training:
        for i, b in enumerate(t):
            for d in range(min(order, i) + 1):
                seen = counts.setdefault(t[i - d : i], {})
                seen[b] = seen.get(b, 0) + 1
    bits = 0.0
    for i, b in enumerate(text):
        depth = 0
        while depth < min(order, i) and text[i - depth - 1 : i] in kept:
            depth += 1
        out: set[int] = set()
        p = 1.0
        while True:
            seen = {s: n for s, n in counts.get(text[i - depth : i], {}).items() if s not in out}
            total, kinds = sum(seen.values()), len(seen)
            if b in seen:
                p *= seen[b] / (total + kinds)
                break
            if total:
                p *= kinds / (total + kinds)
            out |= set(seen)
            if depth == 0:
                p /= 256 - len(out)
                break
            depth -= 1
        bits -= np.log2(p)
    return bits


def test_code_lengths_as_by_hand(spark):
    texts = {"de": [say(GERMAN, 30, i) for i in range(4)], "en": [say(ENGLISH, 30, i) for i in range(4)]}
    rows = [(lang, t) for lang, ts in texts.items() for t in ts]
    table = L.gram_counts(spark.createDataFrame(rows, "lang STRING, text STRING"), 3).toArrow().to_pydict()
    counts = {}
    for lang in texts:
        picked = [(g, n) for x, g, n in zip(*table.values()) if x == lang]
        counts[lang] = tuple(np.array(c) for c in zip(*picked))
    tree = L.grow(counts, order=3, min_count=2)
    contexts = {}
    for ts in texts.values():
        for t in (x.encode() for x in ts):
            for i in range(len(t)):
                for d in range(1, min(3, i) + 1):
                    contexts[t[i - d : i]] = contexts.get(t[i - d : i], 0) + 1
    kept = {c for c, n in contexts.items() if n >= 2}
    asked = ["der kalte Hund", "the cold dog", "", "Zürich 42 ☃", say(ENGLISH, 40, 9)]
    found = tree.score(*text_buffers(pa.array(asked)))
    for i, text in enumerate(asked):
        for j, lang in enumerate(tree.languages):
            want = plain_bits([t.encode() for t in texts[lang]], text.encode(), 3, 2, kept)
            assert abs(found[i, j] - want) < 1e-3 * max(1, want)


def test_pieces_do_not_change_code_lengths(monkeypatch):
    symbols = np.frombuffer(" ".join(say(GERMAN, 200, i) for i in range(3)).encode(), np.uint8)
    grams, n = np.unique(symbols.astype(np.int64) + (1 << 8), return_counts=True)
    tree = L.grow({"de": (grams, n)}, order=1)
    raw, offsets = text_buffers(pa.array(["abc " * 50, None, "", "x" * 300, "der Hund"]))
    whole = tree.score(raw, offsets)
    monkeypatch.setattr(L, "_PIECE", 7)
    assert np.allclose(tree.score(raw, offsets), whole)


def test_held_out_texts(spark):
    rows = [(i, say(GERMAN if i % 2 else ENGLISH, 5 + i % 40, i), "de" if i % 2 else "en") for i in range(300)]
    found = L.predict_languages(spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING")).collect()
    held = [r for r in found if r.held_out]
    assert 40 < len(held) < 120 and len(found) == 300
    assert sum(r.lang_pred == ("de" if r.doc_id % 2 else "en") for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in found)


def test_messy_rows(spark):
    found = {r.doc_id: r for r in L.predict_languages(messy(spark)).collect()}
    assert all((found[i].lang_pred, found[i].score) == ("und", 0.0) for i in (3, 4, 5))
    assert found[7].lang_pred == "en" and found[8].lang_pred == "de"
    assert L.predict_languages(messy(spark).limit(0)).count() == 0
    unknown = messy(spark).selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")
    assert {r.lang_pred for r in L.predict_languages(unknown).collect()} == {"und"}
    df = messy(spark)
    kept = L.keep_identified(df)
    assert kept.schema == df.schema
    # 7 begins with 300,000 times a byte that no language has: longer in code than as it is.
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 2, 6, 6, 8]
    assert {r.score for r in kept.collect()} == {"s"}


def test_every_context_stays_however_many_languages_there_are():
    """40 languages over 200 byte values: under a bound on contexts x classes x languages, hardly any context of 4 bytes stays."""
    rng = np.random.default_rng(2)
    counts, kept = {}, set()
    for lang in range(40):
        words = [bytes(rng.integers(50, 250, 6).astype(np.uint8)) for _ in range(30)]
        grams: dict[int, int] = {}
        for w in words:
            for i in range(4, 6):
                gram = int.from_bytes(w[i - 4 : i + 1], "big") + (1 << 40)
                grams[gram] = grams.get(gram, 0) + 3
                kept.add(w[i - 4 : i])
        counts[f"l{lang:02d}"] = tuple(np.array(c, np.int64) for c in (list(grams), list(grams.values())))
    tree = L.grow(counts)
    nodes = np.zeros(len(kept), np.int64)
    symbols = tree.classes[np.array([list(c) for c in sorted(kept)])]
    for back in range(1, 5):
        nodes = tree.edges.find(nodes * tree.width + symbols[:, -back]) + 1
        assert (nodes > 0).all()
    assert len(set(nodes.tolist())) == len(kept) > 2000
