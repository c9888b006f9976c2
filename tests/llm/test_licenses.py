import re
import textwrap

from sievra.llm import licenses as S
from tests.llm.helpers import messy, rows, sentence


def pairs(text):
    words = re.findall(r"(?:[0-9a-z]|[^\x00-\x7F])+", text.lower())
    return set(zip(words, words[1:])) if len(words) > 1 else {tuple(words)} if words else set()


def by_hand(docs, templates=S.TEMPLATES):
    out = []
    for doc, text in docs:
        text = text or ""
        lines = [line for line in text.split("\n")]
        parts = [line for line in lines if line.strip(" \t\n\r\x0b\x0c")]
        blocks, run = [], []
        for line in [*lines, ""]:
            if line.strip(" \t\n\r\x0b\x0c"):
                run.append(line)
            elif run:
                blocks.append(run)
                run = []
        parts += ["\n".join(b) for b in blocks if len(b) > 1] + ([text] if len(blocks) > 1 else [])
        best = {}
        for i, part in enumerate(parts):
            own, alike = pairs(part), []
            for name, body in templates:
                other = pairs(body)
                if own and 200 * len(own & other) >= 80 * (len(own) + len(other)):
                    alike.append((2 * len(own & other) / (len(own) + len(other)), name))
            for dice, name in alike:
                if dice == max(alike)[0]:
                    best.setdefault(name, {}).setdefault(i, []).append(dice)
        out += [(doc, name, len(hit), max(max(v) for v in hit.values())) for name, hit in best.items()]
    return sorted(out, key=repr)


MIT = S.TEMPLATES[4][1]


def documents():
    wrapped = "\n".join(" # " + MIT[i : i + 70] for i in range(0, len(MIT), 70))
    return [
        (1, "Released under the MIT License.\n" + sentence(50)), (2, sentence(30) + "\nLICENSED under the Apache License Version 2.0!\n\nrest"),
        (3, wrapped), (4, wrapped + "\n\n" + sentence(60)), (5, "This work is licensed under the GNU General Public License, version 3."),
        (6, "This work is licensed under the GNU General Public License, version 2 or so"), (7, sentence(400)),
        (8, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.\n\nLicensed under CC BY 4.0."), (9, "\n\n \n"), (10, "license " * 3000),
        (11, "Redistribution and use in source and binary forms\n\nwith or without modification, are permitted provided that the following conditions are met"),
    ]


def test_parts_against_templates_as_by_hand(spark):
    docs = documents()
    want = by_hand(docs)
    assert {r[0] for r in want} == {1, 2, 3, 4, 5, 6, 8, 11}
    found = rows(S.scan(spark.createDataFrame(docs, "doc_id BIGINT, text STRING").repartition(3)))
    assert found == want


def wrapped_text(text, mark="", width=68):
    return "\n\n".join("\n".join(mark + line for line in textwrap.wrap(part, width)) for part in text.split("\n\n"))


def test_every_template_is_found_as_itself(spark):
    docs = [(i, wrapped_text(text, mark)) for i, (_, text) in enumerate(S.TEMPLATES) for mark in ("", "# ")]
    docs += [(1000 + i, "Copyright (c) 2021 Some One\n\n" + wrapped_text(text)) for i, (_, text) in enumerate(S.TEMPLATES) if len(text) > 900]
    found = {}
    for r in S.scan(spark.createDataFrame(docs, "doc_id BIGINT, text STRING")).collect():
        found.setdefault(r.doc_id, {})[r.license] = r.dice
    for i, (name, _) in enumerate(S.TEMPLATES):
        assert found[i].get(name) == 1.0, name
    assert all(S.TEMPLATES[i - 1000][0] in found[i] for i in found if i >= 1000) and max(found) >= 1000
    assert [tuple(found[i]) for i, (name, _) in enumerate(S.TEMPLATES) if name.endswith("-or-later")] == [
        (name,) for name, _ in S.TEMPLATES if name.endswith("-or-later")
    ]


def test_headers_of_one_family_are_told_apart(spark):
    forms = {name: S._gnu_header(*form) for name, *form in S._GNU}
    docs = [(i, text.replace("This program", "This file").replace("this program", "this file")) for i, text in enumerate(t for pair in forms.values() for t in pair)]
    want = [name for name in forms for _ in range(2)]
    found = {}
    for r in S.scan(spark.createDataFrame(docs, "doc_id BIGINT, text STRING")).collect():
        found.setdefault(r.doc_id, set()).add(r.license)
    assert found == {i: {name} for i, name in enumerate(want)}


def test_parts_equally_like_several_licences_name_them_all(spark):
    df = spark.createDataFrame([(1, "a b c d e f")], "doc_id BIGINT, text STRING")
    found = rows(S.scan(df, (("one", "a b c d e f g"), ("two", "z a b c d e f"), ("far", "a b c d e f g h"))))
    assert [r[1] for r in found] == ["one", "two"]


def test_messy_rows(spark):
    df = messy(spark, [(i, t, "en") for i, t in documents()])
    plain = [(r.doc_id, r.text) for r in df.collect()]
    assert rows(S.scan(df)) == by_hand(plain)
    assert S.scan(df.limit(0)).count() == 0 and S.scan(df, templates=()).count() == 0


def test_size_bounds_are_those_of_the_coefficient():
    known = S.Templates((("x", sentence(21)),), 80)
    assert known.dice((sentence(21)).encode(), 0) == 1.0
    assert known.dice((sentence(21) + " and nothing more").encode(), 0) is not None
    assert known.dice((sentence(21) + "".join(f" z{i}" for i in range(30))).encode(), 0) is None
