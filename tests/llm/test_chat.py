"""Chat formatting by round trip, and templates that rewrite history."""

from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from gustframe.llm import chat

PIECES = st.lists(st.sampled_from([*chat.CONTROLS, "\\", "\n", "<", "|", "end|>\n", "<|end|>\n", "a", "é😀", " "]), max_size=12).map("".join)


@given(st.lists(st.tuples(PIECES, PIECES), max_size=6))
@settings(max_examples=300, deadline=None)
def test_output_is_read_back(messages):
    escaped = [(r, chat.escape(t)) for r, t in messages]
    whole, spans, rewritten = chat.spans(escaped)
    assert not rewritten and chat.parse(whole) == messages
    assert [chat.unescape(whole[a:b]) for _, _, a, b in spans] == [t for _, t in messages]
    assert "".join(whole[a:b] for a, b, _, _ in spans) == whole


def test_escaped_texts_hold_no_control_string():
    assert not any(c in chat.escape("".join(chat.CONTROLS)) for c in chat.CONTROLS)


def test_templates_that_rewrite_history_are_detected():
    def last_only(messages):
        return "".join(f"[{r}]{t if i == len(messages) - 1 else '...'}" for i, (r, t) in enumerate(messages))

    assert chat.spans([("a", "one"), ("b", "two"), ("a", "three")], last_only)[2]


def test_a_prefix_that_is_changed_and_changed_back_is_detected():
    def marked(messages):
        return "".join(f"<{r}>{t};" for r, t in messages) + ("<END>" if len(messages) == 3 else "")

    assert chat.spans([("a", str(i)) for i in range(5)], marked) == ("".join(f"<a>{i};" for i in range(5)), [(-1, -1, -1, -1)] * 5, True)
    assert not chat.spans([("a", str(i)) for i in range(3)], marked)[2]


def test_blocks_of_a_local_template_give_what_all_prefixes_give():
    def linked(messages):
        return "^" + "".join(f"<{r}{'=' if i and messages[i - 1][0] == r else ''}>{t};" for i, (r, t) in enumerate(messages))

    messages = [("ab"[i % 3 % 2], f"text é{i}" * (i % 4)) for i in range(3 * chat.BLOCK + 5)]
    slow = chat.spans(messages, linked)
    assert chat.spans(messages, chat.local(linked)) == slow and not slow[2]
    assert chat.spans(messages) == chat.spans(messages, lambda m: chat.turn_template(m))


def test_a_wrong_declaration_is_noticed():
    @chat.local
    def numbered(messages):
        return "".join(f"<{i}:{r}>{t};" for i, (r, t) in enumerate(messages))

    messages = [("a", str(i)) for i in range(2 * chat.BLOCK)]
    whole, spans, rewritten = chat.spans(messages, numbered)
    assert not rewritten and [whole[a:b] for _, _, a, b in spans] == [t for _, t in messages]


def test_templates_that_count_turns_need_all_prefixes():
    def numbered(messages):
        return "".join(f"<{i}:{r}>{t};" for i, (r, t) in enumerate(messages))

    whole, spans, rewritten = chat.spans([("a", "x"), ("b", "y"), ("a", "z")], numbered)
    assert not rewritten and [whole[a:b] for _, _, a, b in spans] == ["x", "y", "z"]


def test_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "b"), (1, 1, "assistant", ""), (None, 0, "assistant", "c"), (2, None, "assistant", "d"), (2, None, "assistant", "d")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as formatted")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("user", ""), ("", "b"), ("assistant", "")]
    assert got[2]["loss_text"] == "dd" and got[None]["loss_text"] == "c"
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0
