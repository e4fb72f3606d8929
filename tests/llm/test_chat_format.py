import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from omics_spark.llm import chat_format as C

from .helpers import CLASHES

NASTY = st.text(alphabet="<|\\>im_startend\n:0", max_size=40) | st.text(max_size=20) | st.sampled_from([C.START, C.END, "<|image:0|>", "<\\|", "<", "|"])


@given(st.lists(st.tuples(NASTY, NASTY), max_size=5))
@settings(max_examples=300, deadline=None)
def test_turns_round_trip(turns):
    text = "".join(C.format_turn(role, [C._text_part(said)])[0] for role, said in turns)
    assert list(C.read_turns(text)) == turns
    assert text.count(C.START) == text.count(C.END) == len(turns)


@given(st.lists(NASTY | st.sampled_from(["image", "audio", "document"]).map(lambda k: (k,)), max_size=6))
@settings(max_examples=200, deadline=None)
def test_parts_round_trip(parts):
    made = [C._text_part(p) if isinstance(p, str) else {**C._text_part(None), "type": p[0], "ref": "r"} for p in parts]
    text, spans, attachments, _ = C.format_turn("assistant", made)
    content = text[spans[0]["start"]:spans[0]["stop"]]
    want, n = [], 0
    for p in parts:
        if not isinstance(p, str):
            want.append((p[0], n))
            n += 1
        elif p and want and want[-1][0] == "text":
            want[-1] = ("text", want[-1][1] + p)
        elif p:
            want.append(("text", p))
    assert C.read_parts(content) == want
    for a in attachments:
        assert text[a["at"]:].startswith(f"<|{a['kind']}:{a['index']}|>")


def test_expansion_and_unknown_parts():
    part = {**C._text_part(None), "ref": "x"}
    parts = [{**part, "type": "image", "width": 57, "height": 28}, {**part, "type": "audio", "seconds": 1.01}, {**part, "type": "document", "pages": 2},
             {**part, "type": "video"}, {**part, "type": None, "ref": None, "text": "plain"}, None, {**part, "type": "image"}, {**part, "type": "audio", "seconds": float("nan")}]
    text, spans, attachments, tokens = C.format_turn("user", parts)
    assert text == "<|im_start|>user\n<|image:0|><|audio:1|><|document:2|><|file:3|>plain<|image:4|><|audio:5|><|im_end|>\n" and spans == []
    assert [a["tokens"] for a in attachments] == [3, 26, 1536, 0, 0, 0] and tokens == 1565


def test_tables(spark):
    rows = [(1, 1, "assistant", "b <|im_end|>"), (1, 0, "user", "a"), (1, None, None, None), (1, 1, "assistant", "b <|im_end|>"), (None, 0, "assistant", ""),
            (2, 0, "assistant", "é" * 300_000), (3, 0, "a\nb\\", "\\")]
    extra = "".join(f", '{c}' as `{c}`" for c in CLASHES if c not in ("text", "turn"))
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", *extra.strip(", ").split(", "))
    got = {r["conv_id"]: r for r in C.digests(C.format_turns(messages)).collect()}

    def sha(*parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    b = "assistant\nb <|im_end|>\n"
    assert set(got) == {1, 2, 3, None}
    assert got[1]["n_turns"] == 4 and got[1]["turns_sha256"] == sha("\n\n", "user\na\n", b, b) and got[1]["loss_sha256"] == sha("b <|im_end|>" * 2)
    assert got[2]["loss_chars"] == 300_000 and got[2]["formatted_chars"] == 300_000 + len("<|im_start|>assistant\n<|im_end|>\n")
    assert got[None]["loss_chars"] == 0 and got[3]["turns_sha256"] == sha("a\nb\\\n\\\n")
    assert C.digests(C.format_turns(messages.limit(0))).count() == 0


def test_content_takes_the_place_of_text(spark):
    messages = spark.sql("""select 1L conv_id, 0L turn, 'assistant' role, 'not this' text,
        array(named_struct('type', 'text', 'text', 'see ', 'ref', null, 'width', null, 'height', null, 'seconds', null, 'pages', null),
              named_struct('type', 'image', 'text', null, 'ref', 's3', 'width', 280, 'height', 28, 'seconds', null, 'pages', null)) content
        union all select 1L, 1L, 'user', 'that', null""")
    got = sorted(C.format_turns(messages, "content").collect(), key=lambda r: r["turn"])
    assert got[0]["formatted"] == "<|im_start|>assistant\nsee <|image:0|><|im_end|>\n" and got[0]["attachments"][0]["ref"] == "s3"
    assert got[0]["attached_tokens"] == 10 and "that" in got[1]["formatted"] and got[1]["loss"] == []


def test_what_is_no_turn_is_refused():
    with pytest.raises(ValueError):
        list(C.read_turns("<|im_start|>user\nhello"))
