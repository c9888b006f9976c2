import random
import re

import numpy as np
import pytest

from sievra.llm import pii
from tests.llm.helpers import messy, sentence

PATTERNS = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0


def plain_base(text):
    out = []
    for k, pattern in enumerate(PATTERNS):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            if k == 1 and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if k == 2 and not (14 <= len(digits) <= 19 and luhn(digits)) or k == 3 and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return [(pii.KINDS[k], a, b) for a, k, b in sorted(out)]


@pytest.fixture(scope="module")
def field():
    return pii.train(pii.labelled_examples())


def test_base_spans_as_by_plain_patterns():
    rng = random.Random(6)
    parts = ["a", "@", ".", "-", "+", "1", "25", "192", " ", "%", "4111111111111111", "é", "(", ")", "x.com", "@b", "00012", "\n", "_"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert plain_base(text) == pii.base_spans(text), text


def test_long_runs_of_digits_and_signs_take_linear_time():
    for text in ("1" * 300_000, "a@" * 100_000, "+" * 200_000 + "1 " * 100_000, "1." * 150_000, "a" * 300_000 + "@"):
        pii.base_spans(text)


def test_the_field_finds_what_the_patterns_leave_on_unseen_rows(field):
    found = wanted = right = 0
    rows = pii.labelled_examples(seed=77, rows=500)
    for (text, spans), got in zip(rows, pii.field_spans([t for t, _ in rows], field)):
        gold = {(k, *pii._trimmed(text, a, b, k)) for k, a, b in spans}
        found, wanted, right = found + len(got), wanted + len(gold), right + len(gold & set(got))
    assert right >= 0.95 * wanted and right >= 0.95 * found


def small_likelihood(rows=12):
    short = [e for e in pii.labelled_examples(seed=3, rows=rows) if max(map(len, pii._runs_of(e[0])[1]), default=0) <= 4]
    return pii._Likelihood(*pii._table(short), 1e-2)


def test_value_as_by_all_paths_and_slope_as_by_differences():
    import itertools

    likelihood = small_likelihood()
    rng = np.random.default_rng(1)
    theta = rng.normal(0, 0.3, likelihood.size)
    emit, between = likelihood.parts(theta)
    between[~np.isfinite(pii._allowed())] = 0
    value, slope = likelihood(theta)
    move, at, plain = between + pii._allowed(), 0, 0.0
    for n in likelihood.lengths.tolist():
        words = emit[likelihood.column[at : at + n]].sum(axis=1)
        score = lambda path: sum(move[a, b] for a, b in zip((0, *path), (*path, 0))) + sum(words[i, b] for i, b in enumerate(path))  # noqa: E731, B023
        every = np.array([score(p) for p in itertools.product(range(len(pii.LABELS)), repeat=n)])
        plain += np.log(np.exp(every[np.isfinite(every)]).sum()) - score(likelihood.labels[at : at + n].tolist())
        at += n
    assert value == pytest.approx(plain / len(likelihood.lengths) + likelihood.ridge / 2 * theta @ theta)
    for i in rng.integers(0, likelihood.size, 40).tolist():
        step = np.zeros_like(theta)
        step[i] = 1e-5
        assert slope[i] == pytest.approx((likelihood(theta + step)[0] - likelihood(theta - step)[0]) / 2e-5, abs=1e-6)


def test_training_ends_at_the_one_maximum():
    likelihood = small_likelihood(40)
    zero = pii._minimum(likelihood, np.zeros(likelihood.size), 1e-6)
    other = pii._minimum(likelihood, np.random.default_rng(4).normal(0, 0.1, likelihood.size), 1e-6)
    assert np.abs(likelihood(zero)[1]).max() <= 1e-6
    assert likelihood(zero)[0] == pytest.approx(likelihood(other)[0], abs=1e-7) and np.abs(zero - other).max() < 1e-3


def test_no_examples_give_no_field():
    assert pii.train([]) is None and pii.train([("no digits here", [])]) is None


def test_shapes_are_of_whole_words():
    assert pii.shape("Ab1é" * 50) == "Xxdx" * 50 and pii.shape("aaB22--", short=True) == "xXd-"
    assert pii.shape("1" * 1_000_000, short=True) == "d"


def test_viterbi_as_by_all_paths(field):
    import itertools

    import numpy as np

    rng = np.random.default_rng(2)
    move = field.move + pii._allowed()
    lengths = np.array([1, 4, 2, 3, 1])
    emissions = rng.normal(size=(11, len(pii.LABELS)))
    got, at = pii.viterbi(field, emissions, lengths), 0
    for n in lengths:
        part = emissions[at : at + n]
        score = lambda p: sum(move[a, b] for a, b in zip((0, *p), (*p, 0))) + sum(part[i, b] for i, b in enumerate(p))
        best = max(itertools.product(range(len(pii.LABELS)), repeat=int(n)), key=score) if n < 4 else None
        if best:
            assert tuple(got[at : at + n]) == best
        at += n


def test_gradient_training_raises_the_likelihood():
    rows = [("call 555-1234 now", [("phone", 5, 13)]), ("in 1999 we", [])] * 5
    few, many = pii.train(rows, steps=2), pii.train(rows, steps=80)
    assert pii.field_spans([rows[0][0], rows[1][0]], many) == [[("phone", 5, 13)], []]
    assert few is not None and pii.train([]) is None


def test_base_spans_stay_and_added_ones_do_not_touch_them(field):
    texts = ["+1 (269) 555-3296 4524132264652876 x", "mail a.b@c.example.com, or call (555) 234-1234.", sentence(50), "4111 1111 1111 1111"]
    for text, spans in zip(texts, pii.all_spans(texts, field)):
        base = [s[:3] for s in spans if s[3]]
        assert base == plain_base(text)
        assert all(not (s[1] < b and a < s[2]) for s in spans if not s[3] for _, a, b in base)
    assert ("phone", 32, 46, False) in pii.all_spans(texts, field)[1]


def test_messy_rows(spark):
    df = messy(spark, [(40, "é a@b.example.com 10.1.2.3 +1 (462) 555-4285 4111111111111111", "en")])
    found = {r.doc_id: r for r in pii.personal_data(df).collect()}
    assert pii.personal_data(df).count() == 12
    r = found[40]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 0, 0)  # digits of phone and card run together, and failing matches are not tried again
    text = "é a@b.example.com 10.1.2.3 +1 (462) 555-4285 4111111111111111"
    import hashlib

    base = ",".join(f"{k}:{a}:{b}" for k, a, b in plain_base(text))
    assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and set(base.split(",")) <= set(r.spans.split(","))
    assert found[3].spans == "" and found[3].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.personal_data(df.limit(0)).count() == 0
    clean = pii.without_personal_data(df)
    assert clean.schema == df.schema and clean.count() == 12
    row = clean.where("doc_id = 40").first()
    assert row.text.startswith("é <EMAIL> <IP> ") and "4111" not in row.text and row.n_chars == len(row.text)
    assert clean.where("doc_id = 1").first().text == sentence(60) and clean.where("doc_id = 3").first().text is None


def test_redaction_of_spans_that_overlap():
    assert pii.redact("ab 123 cd", [("card", 3, 5, True), ("phone", 4, 6, True)]) == "ab <CARD> cd"
