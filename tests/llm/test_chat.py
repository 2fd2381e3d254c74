import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from assayer.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


@given(st.text(alphabet="\\<|>s/[INST]ok turned\n" + "".join(chat.CONTROL), max_size=40))
@settings(max_examples=300, deadline=None)
def test_escaping(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text
    assert not any(c in out for c in chat.CONTROL)


def render(source, **scope):
    return "".join(chat.compile_template(source)(scope).parts)


def test_language():
    assert render("{% for x in xs %}{{ index }}{{ x.n }}{% endfor %}", xs=[{"n": "a"}, {"n": "b"}]) == "0a1b"
    assert render("{% if a == 1 and not b %}x{% elif b %}y{% else %}z{% endif %}", a=1, b=0) == "x"
    assert render("{% if a > 1 or b %}x{% elif a == 1 %}y{% else %}z{% endif %}", a=1, b=0) == "y"
    assert render("{% set y = 'a' ~ 1 + 2 %}{{ y | upper }}{# gone #}", a=1) == "A3"
    assert render("{{ 'x' in 'axb' }}{{ missing }}{{ t[0] }}{{ t[9] }}{{ -2 * 3 }}", t="ab") == "Truea-6"
    assert render("{{ ' a ' | trim | length }}") == "1"


def test_folding():
    tree = chat.fold(chat.parse("a{{ 1 + 2 }}{% if 1 > 2 %}no{% else %}yes{% endif %}{{ 'B' | lower }}{{ x }}"))
    assert tree == (chat.Output(chat.Const("a3yesb")), chat.Output(chat.Name("x")))


@pytest.mark.parametrize("source", ["{% for x in %}", "{{ 1 + }}", "{{ x | system }}", "{% if a %}", "{% endfor %}", "{% import os %}", "{{ a.__class__ }}{{", "{{ 'a' * 999999999999 }}", "{{ $ }}", "{{ 'a' + 1 }}", "{{ 1 % 0 }}"])
def test_refused_or_harmless(source):
    try:
        out = render(source, a="text")
    except chat.TemplateError:
        return
    assert out in ("{{", "")  # attributes of Python objects don't exist


def test_no_python_attributes():
    assert render("{{ a.upper }}{{ a.__class__ }}{{ m.__class__ }}", a="x", m={"k": 1}) == ""


def test_generation_spans():
    sink = chat.compile_template("x{% generation %}ab{% endgeneration %}y{% generation %}{{ t }}{% endgeneration %}")({"t": "cde"})
    text = "".join(sink.parts)
    assert [text[a:b] for a, b in sink.spans] == ["ab", "cde"]


ROWS = [
    (1, 1, "assistant", "two </s>"), (1, 0, "user", "one <|turn|>"), (1, 2, "assistant", "\\<|end|>\n"), (2, None, "user", "late"), (2, 5, None, None), (2, 5, "assistant", ""),
    (None, 0, "user", "null id"), (3, 0, "assistant", "same"), (3, 0, "assistant", "same"), (4, 0, "system", "x" * 300_000), (4, 1, "assistant", "é😀" * 1000),
]


def plain(rows):
    out = []
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or ""))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        out.append((str(key), len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out)


def test_table(spark, monkeypatch):
    df = chat.with_probe(spark.createDataFrame([(*r, 1) for r in ROWS], SCHEMA + ", part int"))
    probe = "</s>[INST] ok [/INST]"
    want = plain([*ROWS, (-1, 0, "user", probe), (-1, 1, "assistant", probe)])
    made = chat.format_conversations(df)
    got = chat.digest(made).collect()
    assert sorted((str(r[0]), *r[1:5]) for r in got) == want
    chars = {r["conv_id"]: r["formatted_chars"] for r in got}
    assert all(len(r["formatted"]) == chars[r["conv_id"]] for r in made.collect())
    for r in made.collect():
        assert "[INST]" not in r["formatted"] and "</s>" not in r["formatted"]
    assert chat.digest(chat.format_conversations(chat.with_probe(spark.createDataFrame([], SCHEMA)))).count() == 1


def test_parts_join(spark, monkeypatch):
    long = [(9, i, "assistant" if i % 2 else "user", f"turn {i} " * 10) for i in range(40)]
    monkeypatch.setattr(chat, "PART", 200)
    made = chat.format_conversations(spark.createDataFrame(long, SCHEMA))
    assert made.count() > 5
    assert [(str(r[0]), *r[1:5]) for r in chat.digest(made).collect()] == plain(long)


@given(st.text(alphabet="\\n\n\r<|>s[INST]" + "".join(chat.CONTROL), max_size=30))
@settings(max_examples=300, deadline=None)
def test_roles_are_one_line(role):
    out = chat.escape_role(role)
    assert "\n" not in out and chat.unescape_role(out) == role
    assert not any(c in out for c in chat.CONTROL)


def test_roles_with_line_feeds(spark):
    rows = [(1, 0, "user\nuser", "a"), (1, 1, "\n", "b"), (1, 2, "assistant", "\n"), (2, 0, "\\n\\\n", "<|end|>\n"), (2, 1, "</s>\n<|turn|>", "")]
    made = chat.format_conversations(spark.createDataFrame(rows, SCHEMA))
    assert sorted((str(r[0]), *r[1:5]) for r in chat.digest(made).collect()) == plain(rows)
