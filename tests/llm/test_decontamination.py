import random

from sievra.llm import decontamination as D
from tests.llm.helpers import messy, rows, sentence, shingles

WORD = r"(?:[0-9a-z]|[^\x00-\x7F])+"


def by_hand(docs, items, k=5, percent=80):
    out = []
    for d, text in docs:
        held = shingles((text or "").lower(), k, WORD)
        for i, item in items:
            wanted = shingles((item or "").lower(), k, WORD)
            shared = len(wanted & held)
            if wanted and 100 * shared >= percent * len(wanted):
                out.append((d, i, shared, len(wanted), shared / len(wanted)))
    return sorted(out, key=repr)


def test_all_contained_items_are_found(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for i in range(80)]
    docs = []
    for d in range(120):
        body = [rng.choice(words) for _ in range(rng.choice([3, 50, 2000]))]
        for _ in range(3):
            part = items[rng.randrange(80)][1].split()
            for _ in range(rng.randint(0, 3)):  # some copies are edited, some cut
                part[rng.randrange(len(part))] = rng.choice(words)
            at = rng.randrange(len(body))
            body[at:at] = part[: rng.randint(len(part) * 2 // 3, len(part))]
        docs.append((d, " ".join(w.upper() + ", " if rng.random() < 0.1 else w for w in body)))
    docs.append((900, items[0][1]))
    left = spark.createDataFrame(docs, "doc_id BIGINT, text STRING").repartition(4)
    right = spark.createDataFrame(items, "item_id BIGINT, text STRING")
    want = by_hand(docs, items)
    assert len(want) > 30
    assert rows(D.contained_items(left, right)) == want
    assert rows(D.contained_items(left, right, block_bytes=3000)) == want  # many passes


def test_messy_rows(spark):
    items = [(1, sentence(20)), (2, None), (3, ""), (None, "ONE"), (4, sentence(20)), (4, sentence(20))]
    docs = messy(spark)
    right = spark.createDataFrame([(i, t, "x", 0) for i, t in items], "item_id BIGINT, text STRING, item STRING, doc_id INT")
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows(D.contained_items(docs, right)) == by_hand(plain, items)
    assert D.contained_items(docs.limit(0), right).count() == D.contained_items(docs, right.limit(0)).count() == 0


def test_leaks_go_and_clean_documents_stay(spark):
    docs = messy(spark, [(20, "Before. " + sentence(25).upper() + "! After.", "en")])
    items = spark.createDataFrame([(1, sentence(25)), (2, "nothing of this occurs anywhere at all here")], "item_id BIGINT, text STRING")
    kept = D.without_leaks(docs, items)
    assert kept.schema == docs.schema
    gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()}
    # One of the two rows without id holds the item, and goes like any other.
    assert gone == {1, 2, 20} and kept.where("doc_id IS NULL").count() == 1


def test_a_sketch_is_longer_than_what_may_be_lacking():
    assert [D.may_lack(n, 80) for n in (1, 4, 5, 9, 10, 55)] == [0, 0, 1, 1, 2, 11]
    block = D.ItemBlock([1], [sentence(21) + " " + sentence(40, 5, 7)], 5, 80)
    assert block.need[0] >= 1 and len(block.keys) > D.may_lack(len(shingles(block.texts[0], 5)), 80)
