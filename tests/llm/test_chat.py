import hashlib

from pyspark.sql import functions as F

from driftline.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


def turns(session, rows):
    return session.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def read_back(formatted):
    return {
        r.conv_id: ([(t.role, t.text) for t in r.turns], r.loss, r.n_blocks)
        for r in formatted.select("conv_id", "n_blocks", chat.turns_of(F.col("formatted")).alias("turns"),
                                  chat.loss_text(F.col("segments")).alias("loss")).collect()
    }


def test_round_trip_of_odd_turns(session):
    odd = ["", "<|im_end|>\n", "<\\|im_next|>", "\\\\<|", "a\n\nb", "<", "|im_start|>user", "\\", "é🙂", "<\\n>", "x" * 100_000]
    rows = [(1, i, ["user", "assistant", "assistant", "sys\ntem", "<|im_start|>"][i % 5], t) for i, t in enumerate(odd)]
    rows += [(2, None, None, None), (2, 1, "assistant", "b"), (2, 1, "assistant", "a"), (2, 1, "assistant", "a")]
    rows += [(None, 0, "user", "no key")]
    got = read_back(chat.format_chats(turns(session, rows)))
    assert got[1][0] == [(r[2], r[3]) for r in rows[:11]]
    assert got[1][1] == "".join(r[3] for r in rows[:11] if r[2] == "assistant")
    assert got[2] == ([("", ""), ("assistant", "a"), ("assistant", "a"), ("assistant", "b")], "aab", 2)
    assert got[None][0] == [("user", "no key")]


def test_long_conversation_is_linear_and_right(session):
    n = 20_000
    long = session.range(n).select(
        F.lit(5).alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") % 7 < 3, "assistant").otherwise("user").alias("role"),
        F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    (_, loss, blocks), = read_back(chat.format_chats(long)).values()
    assert loss == "".join(f"t{i}" for i in range(n) if i % 7 < 3)
    assert blocks == len(range(0, n, 7)) + len(range(3, n, 7))


def test_formatted_text_and_mask(session):
    row, = chat.format_chats(turns(session, [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "assistant", "b")])).collect()
    assert row.formatted == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\na<|im_next|>b<|im_end|>\n"
    assert "".join(s.text for s in row.segments) == row.formatted
    assert [s.text for s in row.segments if s.loss] == ["a", "b"]


def test_no_python_in_the_plan(session, data):
    from driftline.llm.queries import QUERIES

    plan = QUERIES["op5_chat_formatting"](session, data)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table(session):
    assert chat.format_chats(turns(session, [])).collect() == []
    assert hashlib.sha256(b"").hexdigest()
