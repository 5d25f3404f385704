import pytest
from pyspark.sql import functions as F

from millrace.functions.chat_stats import CHAT_COLUMNS, MESSAGES_TYPE, chat_stats_of_messages, chat_stats_of_turns, messages_of


def message(role, content, think=None, payload=None, call=None, context=None):
    return {"role": role, "content": content, "think": think, "functioncall": {"payload": payload, "response": None, "call": call}, "context": context}


CHATS = {
    1: [message("system", "be {nice}"), message("user", "how? \n"), message("assistant", "use `code` and\n```py\nx\n```", think="a\nb\n"), message("user", "run ```a``` `b` now")],
    2: [message("USER", "Is this one"), message("Assistant", '{"a": [1]} **bold** |a|b| $x$ <b>t</b> </i> < no>', payload="p"), message("tool", "{}")],
    3: [message("user", None, context="ctx"), message("assistant", "ok \\[ x", call="c")],
    4: [],
}


@pytest.fixture(scope="module")
def stats(spark):
    df = spark.createDataFrame([(k, "en", v) for k, v in CHATS.items()], f"id int, _lang string, messages {MESSAGES_TYPE.simpleString()}")
    return {r.id: r.asDict() for r in chat_stats_of_messages(df).collect()}


def test_roles_words_and_lengths(stats):
    one = stats[1]
    assert one["_message_count"] == 4 and one["_user_message_count"] == 2 and one["_has_system"] == 1
    assert one["_user_char_count"] == len("how? \n") + len("run ```a``` `b` now")
    assert one["_user_word_count"] == 1 + 4
    assert one["_last_interaction_ratio"] == pytest.approx(len("run ```a``` `b` now") / len("use `code` and\n```py\nx\n```"))


def test_code_and_questions(stats):
    assert stats[1]["_user_code_count"] == 2 and stats[1]["_assistant_has_code"] == 1
    assert stats[1]["_user_ends_with_question"] == 1 and stats[2]["_user_ends_with_question"] == 0


def test_think_calls_and_context(stats):
    assert (stats[1]["_has_think"], stats[1]["_think_message_count"], stats[1]["_think_char_total"], stats[1]["_think_steps_total"]) == (1, 1, 4, 2)
    assert stats[2]["_functioncall_message_count"] == 1 and stats[3]["_has_functioncall"] == 1
    assert stats[3]["_context_count"] == 1 and stats[3]["_context_token_count"] == 1


def test_assistant_markers(stats):
    two = stats[2]
    assert [two[f"_assistant_has_{k}"] for k in ("json", "markdown", "table", "math", "code")] == [1, 1, 1, 1, 0]
    assert two["_html_tag_count"] == 4 and two["_xml_tag_count"] == 3 and two["_curly_brackets_count"] == 4
    assert stats[3]["_assistant_has_math"] == 1 and stats[3]["_assistant_has_json"] == 0


def test_no_messages_give_zeros(stats):
    assert all(stats[4][c] == 0 for c in CHAT_COLUMNS)


def test_token_counts_truncate(stats):
    assert stats[1]["_user_token_count"] == int(5 * 1.384)


def test_both_shapes_agree(spark, stats):
    turns = [
        (k, i, m["role"], m["content"], m["think"], m["functioncall"]["payload"] or m["functioncall"]["call"], m["context"])
        for k, v in CHATS.items() for i, m in enumerate(v)
    ]
    df = spark.createDataFrame(turns, "id int, turn int, role string, content string, think string, payload string, ctx string")
    grouped = chat_stats_of_turns(df, "id", "turn", "role", "content", F.lit("en"), "think", "payload", "ctx")
    for row in grouped.collect():
        assert row.asDict() == stats[row.id]


def test_messages_from_json_text(spark):
    df = spark.createDataFrame([(1, ' {"messages": [{"role": "user", "content": "hi"}]}'), (2, "plain"), (3, "[1]")], "id int, text string")
    found = {r.id: r.n for r in df.select("id", F.size(messages_of(df)).alias("n")).collect()}
    assert found[1] == 1 and found[2] in (-1, None) and found[3] in (-1, None)


def test_markers_need_their_literal_and_more(spark):
    """A search for a literal comes before each pattern; counts are those of the patterns alone."""
    import re

    from millrace.functions import chat_stats as S

    contents = ["", "plain", "a { b } {", "<b>x</b> < y", "< >", "`x` and ``", "```a\n```", "|a|b|", "|a", "$x$", "\\[", "cost $5", "**b**", "**", "a # b", "~~s~~", "__", "why? ", "why?x", "é?"]
    rows = [(i, [{"role": "Assistant", "content": c}, {"role": "User", "content": c}]) for i, c in enumerate(contents)]
    got = {r.id: r for r in S.chat_stats_of_messages(spark.createDataFrame([(i, m, "en") for i, m in rows], f"id int, messages {S.MESSAGES_TYPE.simpleString()}, _lang string")).collect()}
    for i, c in enumerate(contents):
        assert got[i]._curly_brackets_count == 2 * (c.count("{") + c.count("}"))
        assert got[i]._html_tag_count == len(re.findall(S.HTML_TAG, c))
        assert got[i]._user_code_count == len(re.findall(S.CODE_SPAN, c))
        for name, pattern in (("code", S.CODE_SPAN), ("markdown", S.MARKDOWN), ("table", S.TABLE), ("math", S.MATH)):
            assert got[i][f"_assistant_has_{name}"] == int(re.search(pattern.replace("\\[[\\]", "\\[\\[\\]"), c) is not None), (name, c)
        assert got[i]._user_ends_with_question == int(re.search(r"\?\s*\Z", c) is not None)
