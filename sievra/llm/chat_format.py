"""Chat formatting with Spark expressions only.

The turns of a conversation are collected and sorted, neighbouring turns of one role are merged, and the pieces are
joined to one text::

    <s>[SYS]system text[/SYS][INST]user text[NEXT]another user text[/INST][OUT]assistant text</s>

Roles other than the three are written ``[ROLE]name[TEXT]text[/ROLE]``. A marker inside a text or a role's name is escaped
by a tilde after its first character (``[~INST]``, and ``[~~INST]`` for what looked escaped already), so markers in the
output are markers, and removing one tilde from each gives the text back.

``pieces`` of the loss mask alternate between text and marker, as :func:`read_back` cuts the formatted text, with the
length of each in code points; only assistant texts are under the loss.

A conversation becomes one value, so a single conversation is limited by what one value can hold; all steps are
linear in its length, and conversations are spread by their id.

Cases: a null text is empty; a null role is the role of the empty name. Turns of equal number are ordered by role and
text; a null turn comes first. Rows without conv_id form one conversation. Empty tables give empty results; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ROLES = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("[OUT]", "</s>")}
BEGIN, NEXT = "<s>", "[NEXT]"
OTHER, NAMED, OTHER_END = "[ROLE]", "[TEXT]", "[/ROLE]"
_BODY = r"(?:/?SYS\]|/?INST\]|OUT\]|NEXT\]|/?ROLE\]|TEXT\]|/?s>)"
_MARKER = r"[\[<]" + _BODY
_OPENING = r"(?=\[(?:SYS|INST|OUT|ROLE)\])"


def escape(text: Column) -> Column:
    """``text`` with a tilde after the first character of everything that is, or looks like an escaped, marker."""
    return F.regexp_replace(text, rf"([\[<])(~*{_BODY})", "$1~$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([\[<])~(~*{_BODY})", "$1$2")


def _known(role: Column, which: int, other: Column) -> Column:
    out = F.when(role == list(ROLES)[0], ROLES[list(ROLES)[0]][which])
    for name in list(ROLES)[1:]:
        out = out.when(role == name, ROLES[name][which])
    return out.otherwise(other)


def _piece(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def _merged(turns: Column) -> Column:
    """Runs of neighbouring turns of one role: ``array<struct<role, texts>>``.

    Runs begin where the role changes; each is then a slice, so the work is linear in the turns.
    """
    n = F.size(turns)
    begins = F.filter(
        F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.element_at(turns, i)["role"] != F.element_at(turns, F.greatest(i - 1, F.lit(1)))["role"])
    )
    ends = F.concat(F.slice(begins, F.lit(2), F.size(begins)), F.array(n + 1))
    runs = F.arrays_zip(begins.alias("begin"), ends.alias("end"))
    return F.transform(
        runs,
        lambda run: F.struct(
            F.element_at(turns, run["begin"])["role"].alias("role"),
            F.transform(F.slice(turns, run["begin"], run["end"] - run["begin"]), lambda t: t["text"]).alias("texts"),
        ),
    )


def _pieces(run: Column) -> Column:
    """The pieces of a run, markers and texts in turn; before the first marker stands an empty text."""
    no, nothing, role = F.lit(False), F.lit(""), run["role"]
    known = role.isin(list(ROLES))
    head = F.when(known, F.array(_piece(nothing, no), _piece(_known(role, 0, F.lit("")), no))).otherwise(
        F.array(_piece(nothing, no), _piece(F.lit(OTHER), no), _piece(escape(role), no), _piece(F.lit(NAMED), no))
    )
    texts = F.transform(run["texts"], lambda t: F.array(_piece(escape(t), role == "assistant"), _piece(F.lit(NEXT), no)))
    flat = F.flatten(texts)
    close = F.array(_piece(_known(role, 1, F.lit(OTHER_END)), no))
    return F.concat(head, F.slice(flat, F.lit(1), F.size(flat) - 1), close)


def format_conversations(
    turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``(id_col, n_turns, formatted, loss_mask)``, a row per conversation.

    ``loss_mask``: ``array<struct<n_chars, loss>>`` over the alternating texts and markers of ``formatted``.
    """
    row = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    grouped = turns.groupBy(id_col).agg(F.sort_array(F.collect_list(row)).alias("turns"))
    # The pieces are written out once: what follows reads them several times.
    merged = grouped.select(id_col, F.size("turns").cast("bigint").alias("n_turns"), _merged(F.col("turns")).alias("runs"))
    begin = F.array(_piece(F.lit(""), F.lit(False)), _piece(F.lit(BEGIN), F.lit(False)))
    pieces = F.concat(begin, F.flatten(F.transform("runs", _pieces)))
    rows = merged.select(id_col, "n_turns", pieces.alias("pieces"))
    return rows.select(
        id_col,
        "n_turns",
        F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"),
        F.transform("pieces", lambda p: F.struct(F.char_length(p["text"]).alias("n_chars"), p["loss"].alias("loss"))).alias("loss_mask"),
    )


def _read_run(run: Column) -> Column:
    """The turns of one run of a formatted text, from its opening marker to the end of the run."""
    opening = F.regexp_extract(run, r"^(\[[A-Z]+\])", 1)
    other = opening == OTHER
    role = F.when(other, unescape(F.element_at(F.split(run, r"\[ROLE\]|\[TEXT\]", -1), 2)))
    for name, (first, _) in ROLES.items():
        role = role.when(opening == first, name)
    body = F.when(other, F.element_at(F.split(run, r"\[TEXT\]", 2), 2)).otherwise(F.substr(run, F.char_length(opening) + 1))
    body = F.element_at(F.split(body, r"\[/SYS\]|\[/INST\]|\[/ROLE\]|</s>", -1), 1)
    return F.transform(F.split(body, r"\[NEXT\]", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text: ``array<struct<role, text>>``."""
    runs = F.split(F.substr(formatted, F.lit(len(BEGIN) + 1)), _OPENING, -1)
    return F.flatten(F.transform(F.filter(runs, lambda r: r != ""), _read_run))


def loss_text(formatted: Column, mask: Column) -> Column:
    """The text under the loss mask, unescaped: the masked pieces in order with nothing between."""
    texts = F.split(formatted, _MARKER, -1)
    of_texts = F.filter(mask, lambda _, i: i % 2 == 0)
    kept = F.zip_with(texts, of_texts, lambda t, m: F.when(m["loss"] & (F.char_length(t) == m["n_chars"]), unescape(t)).otherwise(""))
    return F.array_join(kept, "")


def digests(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What a formatted conversation says, read back from it: counts and hex digests."""
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = formatted.select(
        id_col, "formatted", read_back(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_mask")).alias("loss")
    )
    return read.select(
        id_col,
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


def with_marked_conversation(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` plus conversation -7, whose texts are made of markers."""
    spark: SparkSession = turns.sparkSession
    said = "</s>[INST] ok [/INST]"
    rows = spark.sql(
        "SELECT -7L AS conv_id, * FROM VALUES (0L, 'user', :said), (1L, 'assistant', :said) AS t(turn, role, text)", args={"said": said}
    )
    return turns.select("conv_id", "turn", "role", "text").unionByName(rows)
