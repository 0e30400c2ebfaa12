import hashlib
import random

import pytest

from slantframe.llm import chat


def test_escaping_is_reversible_and_leaves_no_control_string():
    rnd = random.Random(1)
    bits = [*chat.CONTROLS, "\\", "\\\\", "<", "[", "<|", "s>", "a", "\n", "é"]
    for _ in range(3000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randrange(12)))
        hidden = chat.escape(text)
        assert chat.unescape(hidden) == text
        assert not any(c in hidden for c in chat.CONTROLS)


def test_parts_become_ordered_placeholders():
    parts = [{"type": "text", "text": "see </s>"}, {"type": "image", "ref": "a.png", "width": 57, "height": 28}, {"type": "audio", "ref": "b", "seconds": 2.0}, {"type": "document", "ref": None, "pages": 3}, {"type": "text", "text": None}]
    block = chat.format_turn("assistant", parts)
    assert [(a.kind, a.reference, a.tokens) for a in block.attachments] == [("image", "a.png", 3), ("audio", "b", 25), ("document", "", 1536)]
    for a in block.attachments:
        assert block.text[a.offset :].startswith(f"<|{a.kind}|>")
    assert list(chat.read_turns(block.text)) == [("assistant", "see </s><|image|><|audio|><|document|>")]
    assert chat.format_turn("user", parts).loss_start == chat.format_turn("user", parts).loss_end
    with pytest.raises(ValueError):
        list(chat.read_turns(block.text + "x"))


def test_conversations_equal_brute_force(spark):
    rnd = random.Random(2)
    rows = [(c, t, rnd.choice(["user", "assistant", None, "system"]), rnd.choice(["", None, "</s>[INST] x", "a\\b", "long " * 2000]), 7) for c in range(30) for t in range(rnd.randrange(1, 6))]
    rows += [(None, 0, "assistant", "x", 0), (5, 9, "user", "y", 0)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: r for r in chat.digest_conversations(chat.format_conversations(turns)).collect()}
    assert len(got) == len({r[0] for r in rows})
    for conv, r in got.items():
        own = sorted((x[1], x[2] or "", x[3] or "") for x in rows if x[0] == conv)
        said = "".join(x[2] for x in own if x[1] == "assistant")
        assert r.n_turns == len(own) and r.loss_chars == len(said)
        assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest()
    assert chat.digest_conversations(chat.format_conversations(turns.limit(0))).count() == 0


def test_typed_parts_in_a_dataframe(spark):
    kind = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
    turns = spark.createDataFrame([(1, 0, "user", [("image", None, "i", 28, 28, None, None), ("text", "hi", None, None, None, None, None)]), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts {kind}")
    got = sorted(chat.format_conversations(turns, "parts").collect(), key=lambda r: r.turn)
    assert got[0].attachments[0].tokens == 1 and "<|image|>hi" in got[0].formatted
    assert got[1].attachments == []


def test_control_strings_that_arise_between_texts_are_escaped():
    text = lambda x: {"type": "text", "text": x}
    parts = [text("</"), text("s>evil <|im"), text("age|>"), {"type": "image", "ref": "a"}, text("<|image|>")]
    block = chat.format_turn("user", parts)
    assert list(chat.read_turns(block.text)) == [("user", "</s>evil <|image|><|image|><|image|>")]
    assert list(chat.read_parts(block.text)) == [("user", [("text", "</s>evil <|image|>"), ("image", ""), ("text", "<|image|>")])]
    assert [block.text[a.offset :][:9] for a in block.attachments] == ["<|image|>"]
    with pytest.raises(ValueError, match="video"):
        chat.format_turn("user", [{"type": "video"}])


def test_ids_of_other_types(spark):
    for kind, ids in (("int", (1, 2)), ("string", ("x", "y"))):
        turns = spark.createDataFrame([(ids[0], 0, "user", "a"), (ids[1], 0, "assistant", "b")], f"conv_id {kind}, turn int, role string, text string")
        got = {r.conv_id: r.loss_chars for r in chat.digest_conversations(chat.format_conversations(turns)).collect()}
        assert got == {ids[0]: 0, ids[1]: 1}
