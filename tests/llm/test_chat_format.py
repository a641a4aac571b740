import hashlib

from pyspark.sql import functions as F

from tidegrid.llm import chat_format as chat

SCHEMA = "conv_id long, turn long, role string, text string, block int, formatted string"


def plain(turns):
    out = {}
    for c in {t[0] for t in turns}:
        rows = sorted(((-(2**63) if t[1] is None else t[1]), t[2] or "", t[3] or "") for t in turns if t[0] == c)
        listed = "".join(f"{r}\n{x}\n" for _, r, x in rows)
        replies = "".join(x for _, r, x in rows if r == "assistant")
        out[c] = (len(rows), hashlib.sha256(listed.encode()).hexdigest(), len(replies),
                  hashlib.sha256(replies.encode()).hexdigest())
    return out


def read(spark, turns, block=4):
    out = chat.format_chat(spark.createDataFrame([(*t, None, "x") for t in turns], SCHEMA), block=block)
    return out, {r.conv_id: tuple(r)[1:5] for r in chat.read_back(out).collect()}


def test_round_trip_with_control_strings_nulls_and_ties(spark):
    hard = ["", None, "\\", "\\\\", "#", "###", " ###\n", "</turn>\n", "<\\/turn>", "</", "<", "é🙂\x00", "a\n### b ###\n",
            r"\### Assistant: </turn> ok", "x" * 50_000]
    turns = [(1, k, "user" if k % 2 else "assistant", t) for k, t in enumerate(hard)]
    turns += [(2, None, None, "first"), (2, 0, "assistant", "b"), (2, 0, "assistant", "a"), (2, 0, "assistant", "a")]
    turns += [(None, 0, "assistant", "no id"), (None, 7, "a ###\nb", "odd role"), (3, 5, "system", None)]
    _, got = read(spark, turns)
    assert got == plain(turns)


def test_examples_are_prefixes_with_one_trainable_reply(spark):
    turns = [(1, k, ["user", "assistant"][k % 2], f"text {k} </turn>") for k in range(11)]
    out, _ = read(spark, turns)
    rows = {r.turn_no: r for r in chat.examples_as_text(out).collect()}
    assert sorted(rows) == [1, 3, 5, 7, 9]
    whole = "".join(r.formatted for r in out.conversations.orderBy("block").collect())
    for k, r in rows.items():
        assert whole.startswith(r.context) and r.context.count("</turn>\n") == k
        assert r.target == f"text {k} <\\/turn>"


def test_empty_table_and_plan(spark):
    out, got = read(spark, [])
    assert got == {}
    plan = chat.read_back(out)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan


def test_tables(spark):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:5] for r in chat.read_back(chat.format_chat(turns)).collect()}
    assert got == plain([tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()])
    assert turns.agg(F.countDistinct("conv_id")).first()[0] == len(got)


def test_read_back_refuses_a_wrong_context(spark):
    import pytest

    turns = [(1, k, ["user", "assistant"][k % 2], f"text {k}") for k in range(11)]
    out, got = read(spark, turns)
    assert got == plain(turns)
    for wrong in (-1, 1, -19):
        moved = out.examples.withColumn(
            "context_chars", F.col("context_chars") + F.when(F.col("turn_no") == 5, wrong).otherwise(0))
        with pytest.raises(Exception, match="own turn"):
            chat.read_back(chat.Formatted(out.conversations, moved)).collect()
