"""Chat formatting with Spark expressions only.

A conversation becomes one text.  Its turns are collected as structs and sorted
by turn, adjacent turns of one role are merged into a block, and blocks are
joined::

    <|im_start|>ROLE
    TEXT<|im_next|>TEXT<|im_end|>

``<|im_next|>`` stands between merged turns, so the turns can be read back.
Control strings inside texts and roles are escaped reversibly: a backslash is
doubled and ``<|`` becomes ``<\\|``, so no control string can start inside a
text; a line feed in a role becomes ``<\\n>``.

The loss mask is kept as the segments the text is joined from, each with a flag:
the flagged ones hold assistant texts and nothing else.  Every step is linear in
the length of a conversation.  A conversation is one output value, so its length
is bounded by what one row may hold; other conversations are not affected by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the template.
START, NEXT, END = "<|im_start|>", "<|im_next|>", "<|im_end|>\n"
ASSISTANT = "assistant"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("<\\n>"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("<\\n>"), F.lit("\n")))


def _blocks(turns: Column) -> Column:
    """Maximal runs of one role: structs of role and texts, cut out of the sorted turns.

    Inside the functions only single elements of ``turns`` are touched; taking
    a field or a slice of the whole array there would cost its length each time.
    """
    place = F.sequence(F.lit(0), F.size(turns) - 1)
    begins = F.filter(place, lambda i: (i == 0) | (turns[i]["role"] != F.get(turns, i - 1)["role"]))
    ends = F.concat(F.slice(begins, 2, F.size(begins)), F.array(F.size(turns)))
    return F.transform(
        F.arrays_zip(begins.alias("begin"), ends.alias("end")),
        lambda run: F.struct(
            turns[run["begin"]]["role"].alias("role"),
            F.transform(F.sequence(run["begin"], run["end"] - 1), lambda i: turns[i]["text"]).alias("texts"),
        ),
    )


def _segments(block: Column, loss_role: str) -> Column:
    """Header, each text followed by its mark, with the texts of the loss role flagged."""
    head = F.concat(F.lit(START), escaped_role(block["role"]), F.lit("\n"))
    flagged = block["role"] == loss_role
    last = F.size(block["texts"]) - 1
    plain = lambda text: F.struct(text.alias("text"), F.lit(False).alias("loss"))
    bodies = F.transform(
        block["texts"],
        lambda text, i: F.array(
            F.struct(escaped(text).alias("text"), flagged.alias("loss")),
            plain(F.when(i == last, F.lit(END)).otherwise(F.lit(NEXT))),
        ),
    )
    return F.concat(F.array(plain(head)), F.flatten(bodies))


def format_chats(
    turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role",
    text: str = "text", loss_role: str = ASSISTANT,
) -> DataFrame:
    """One row per conversation: ``key``, ``formatted``, ``segments``, ``n_blocks``.

    NULL texts and roles are empty.  Turns are ordered by turn (NULL first); ties
    by role, then text, so repeated rows stay and the result does not depend on
    row order.  Rows with a NULL key form one conversation.  Other columns are not
    read.  An empty table gives an empty table.
    """
    struct = F.struct(
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    return (
        turns.groupBy(F.col(key).alias(key))
        .agg(F.sort_array(F.collect_list(struct)).alias("_turns"))
        .select(key, _blocks(F.col("_turns")).alias("_blocks"))
        .select(
            key,
            F.size("_blocks").cast("long").alias("n_blocks"),
            F.flatten(F.transform("_blocks", lambda b: _segments(b, loss_role))).alias("segments"),
        )
        .withColumn("formatted", F.array_join(F.col("segments")["text"], ""))
    )


def turns_of(formatted: Column) -> Column:
    """The turns of a formatted text again: an array of role and text."""
    blocks = F.filter(F.split(formatted, r"\Q" + END + r"\E"), lambda b: b != "")
    bodies = F.transform(
        blocks,
        lambda b: F.struct(
            unescaped_role(F.substring_index(F.substr(b, F.lit(len(START) + 1)), "\n", 1)).alias("role"),
            F.split(F.substr(b, F.locate("\n", b) + 1), r"\Q" + NEXT + r"\E").alias("texts"),
        ),
    )
    return F.flatten(F.transform(bodies, lambda b: F.transform(
        b["texts"], lambda t: F.struct(b["role"].alias("role"), unescaped(t).alias("text")))))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    flagged = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(flagged, lambda s: unescaped(s["text"])), "")
