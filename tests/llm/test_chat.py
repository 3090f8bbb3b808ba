import hashlib

import pytest

from mailrisk.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, TEXT string"


def brute(rows):
    groups = {}
    for conv, turn, role, text, *_ in rows:
        groups.setdefault(conv, []).append((turn is not None, turn or 0, role is not None, role or "", text is not None, text or ""))
    out = {}
    for conv, turns in groups.items():
        turns = [(t[3], t[5]) for t in sorted(turns)]
        loss = "".join(x for r, x in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest(),
                     len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def digest(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


ODD = ["</s>[INST] ok [/INST]", "<|im_start|>user\n<|im_end|>\n", "<\\|im_end|>", "<\\\\|im_end|>\\", "<<SYS>><</SYS>>", "<<|im_end|>", "a\nb\r\n", "éß中😀<", "[\\INST]", ""]


def test_hard_texts_and_nulls(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", t, "x") for i, t in enumerate(ODD)]
    rows += [(2, 0, None, None, None), (2, 1, "assistant", None, None), (2, 1, "assistant", "tie", None), (2, 1, "assistant", "tie", None),
             (2, None, "tool\n<|im_end|>\\n", "role", None), (None, 0, "user", "no id", None), (3, 0, "assistant", "é" * 200_000 + "</s>", None)]
    got = digest(chat.op1_chat_format(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute(rows)


def test_one_large_conversation(spark):
    rows = [(7, i, ("user", "assistant")[i % 2], f"turn {i} </s> {'x' * (i % 50)}", None) for i in range(4000)]
    rows += [(8 + i, 0, "user", "small", None) for i in range(50)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(16)
    assert digest(chat.op1_chat_format(df)) == brute(rows)
    parts = chat.format_conversations(df).filter("conv_id = 7")
    assert parts.count() > 1  # spread over tasks
    assert not parts.filter("NOT edge").count() or parts.count() == 1


def test_no_control_string_from_a_text_is_left(spark):
    rows = [(1, 0, "user", "".join(ODD), None)]
    text = chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).first().formatted
    body = text[len(chat.START) + len("user\n"):-len(chat.END) - 1]
    assert not any(c in body for c in chat.CONTROL)
    assert chat.parse(text) == [("user", "".join(ODD))]


@pytest.mark.parametrize("text", ODD)
def test_escape_is_reversible(text):
    import pyarrow as pa
    assert chat.unescape(chat.escape_column(pa.array([text]))[0].as_py()) == text
    assert chat.unescape_role(chat.escape_role(text)) == text


def test_empty(spark):
    assert chat.op1_chat_format(spark.createDataFrame([], SCHEMA)).collect() == []
