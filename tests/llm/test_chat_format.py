import hashlib
import random
import re

from pyspark.sql import functions as F

from sievra.llm import chat_format as C

PARTS = ["</s>", "<s>", "[INST]", "[/INST]", "[~INST]", "[NEXT]", "[OUT]", "[TEXT]", "~", "[", "<", "/s>", "INST]", "x", "é", "\n", "\\", "$1", "[ROLE]", "[SYS]"]


def conversations(n=150):
    rng = random.Random(12)
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "system", "assistant", "user", "tool", "[INST]", "", None])
            text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 7)))
            rows.append((conv, turn, role, None if rng.random() < 0.1 else text))
    return rows


def by_hand(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1], r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    return out


def escaped(text):
    return re.sub(r"([\[<])(~*(?:/?SYS\]|/?INST\]|OUT\]|NEXT\]|/?ROLE\]|TEXT\]|/?s>))", r"\1~\2", text)


def formatted(turns):
    out, last = "<s>", None
    close = {"system": "[/SYS]", "user": "[/INST]", "assistant": "</s>"}
    opening = {"system": "[SYS]", "user": "[INST]", "assistant": "[OUT]"}
    for i, (role, text) in enumerate(turns):
        same = i and turns[i - 1][0] == role
        out += "[NEXT]" if same else opening.get(role, f"[ROLE]{escaped(role)}[TEXT]")
        out += escaped(text)
        if i + 1 == len(turns) or turns[i + 1][0] != role:
            out += close.get(role, "[/ROLE]")
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def check(df, rows):
    want = by_hand(rows)
    made = C.format_conversations(df)
    texts = {r.conv_id: r for r in made.collect()}
    assert {i: r.formatted for i, r in texts.items()} == {i: formatted(t) for i, t in want.items()}
    for r in texts.values():
        at, masked = 0, []
        for part in r.loss_mask:
            if part.loss:
                masked.append(r.formatted[at : at + part.n_chars])
            at += part.n_chars
        assert at == len(r.formatted)
        assert masked == [escaped(t) for role, t in want[r.conv_id] if role == "assistant"]
    for r in C.digests(made).collect():
        turns = want[r.conv_id]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.turns_sha256 == sha("".join(f"{a}\n{b}\n" for a, b in turns))
        assert r.loss_chars == len(loss) and r.loss_sha256 == sha(loss) and r.formatted_chars == len(formatted(turns))


def test_turns_come_back_whatever_they_say(spark):
    rows = conversations()
    check(spark.createDataFrame(rows, "conv_id BIGINT, turn BIGINT, role STRING, text STRING").repartition(5), rows)


def test_messy_rows(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "assistant", "z"), (1, None, "user", "first"), (1, 0, "user", "a"),
            (None, 1, None, None), (None, 0, "user", "x"), (2, 0, "assistant", ""), (2, 1, "assistant", None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id BIGINT, turn BIGINT, role STRING, text STRING, pieces STRING, turns INT")
    check(df, rows)
    assert C.digests(C.format_conversations(df.limit(0))).count() == 0


def test_a_long_conversation_takes_linear_time(spark):
    n = 20_000
    df = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.lit("some words [INST]").alias("text"))
    r = C.digests(C.format_conversations(df)).first()
    assert r.n_turns == n and r.loss_chars == 17 * sum(i % 3 > 0 for i in range(n))


def test_main_path_is_native(spark):
    df = spark.createDataFrame(conversations(3), "conv_id BIGINT, turn BIGINT, role STRING, text STRING")
    plan = C.digests(C.format_conversations(C.with_marked_conversation(df)))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|InArrow", plan)


def test_marked_conversation(spark):
    df = spark.createDataFrame([], "conv_id BIGINT, turn BIGINT, role STRING, text STRING")
    r = C.digests(C.format_conversations(C.with_marked_conversation(df))).first()
    said = "</s>[INST] ok [/INST]"
    assert (r.conv_id, r.n_turns, r.loss_chars, r.loss_sha256) == (-7, 2, len(said), sha(said))
