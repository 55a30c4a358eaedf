"""Templates: parsing, folding, closures, and exact round trips."""

import random

import pytest

from tidewake.llm import chat


def test_language():
    render = chat.compile_template(
        "{% set x = 'a' ~ 1 + 2 %}{% for turn in turns %}{{ loop.index }}{% if loop.first and not loop.last %}<{{ x }}{% elif turn.role == \"u\" or false %}U"
        "{% else %}-{% endif %}{% generation %}{{ turn.text | trim | upper }}{% endgeneration %};{% endfor %}")
    page, spans = render([{"role": "s", "text": " hi "}, {"role": "u", "text": "b"}, {"role": "v", "text": ""}])
    assert page == "1<a12HI;2Ub".replace("b", "B") + ";3-;" and [page[a:b] for a, b in spans] == ["HI", "B", ""]


def test_folding():
    tree = chat.fold(chat.parse("a{{ 'b' | upper ~ 1 }}{% if 1 == 2 %}no{% else %}c{% endif %}{% if true %}d{% endif %}{{ turn }}"))
    assert [n.kind for n in tree.children] == ["constant", "output"] and tree.children[0].value == "aB1cd"


@pytest.mark.parametrize("template", ["{{ turn.__class__ }}", "{{ x() }}", "{% for a in b %}{% endfor %}", "{% if 1 %}", "{{ 1 | eval }}", "{% endfor %}",
                                      "{{ 'a }}", "{{ }}", "{% set turns = 1 %}", "{% import os %}", "{{ (1 }}", "{{ 1 2 }}", "{{ turns.x }}"])
def test_sandbox(template):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(template)


def test_round_trip():
    rng = random.Random(3)
    parts = ["\\", "###", "</turn>", "</turn", ">", "#", ": ", ":", " ", "\n", "a", "é🚢", "<", "\\###"]
    render = chat.compile_template(chat.TEMPLATE)
    for _ in range(3000):
        turns = [{"role": rng.choice(["user", "assistant", ":", "a: b\\", ""]), "text": "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))}
                 for _ in range(rng.randint(0, 4))]
        page, spans = render(turns)
        assert chat.parse_formatted(page) == [(t["role"], t["text"]) for t in turns]
        assert [chat.unescape(page[a:b]) for a, b in spans] == [t["text"] for t in turns if t["role"] == "assistant"]


def test_operator(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, None, None, None), (None, 0, "user", "x" * 100_000), (3, 0, "user", "")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, FORMATTED int")
    got = {r.conv_id: r for r in chat.read_formatted(spark.read.parquet(chat.write_formatted(df))).collect()}
    assert [tuple(t) for t in got[1].turns] == [("user", "a"), ("assistant", "b"), ("assistant", "b")] and got[1].generated_text == "bb"
    assert [tuple(t) for t in got[2].turns] == [("", "")] and len(got) == 4 and len(got[None].turns[0].text) == 100_000
    assert spark.read.parquet(chat.write_formatted(df.limit(0))).count() == 0
