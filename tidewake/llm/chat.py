"""Chat formatting by compiled templates.

The project keeps no conversations, so the operators are general: turns are rows of a conversation id, an order, a role and
a text.

A template is parsed into a syntax tree, constants are folded, and the tree becomes nested Python closures. The language is
closed: there are no calls but the named filters, no attributes but those of a turn and a loop, and no way to Python.

    {{ expression }}   {% for turn in turns %} .. {% endfor %}   {% if a %} .. {% elif b %} .. {% else %} .. {% endif %}
    {% set name = expression %}   {% generation %} .. {% endgeneration %}

Expressions: strings, integers, true, false, names, turn.role, loop.index, loop.first, loop.last, == != < > <= >=, + ~,
and or not, parentheses, and filters: escape, label, trim, upper, lower.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewake.operators.sizing import _shared_folder

TURN_START, LABEL_END, TURN_END = "### ", ": ", "</turn>"
TEMPLATE = ("{% for turn in turns %}" + TURN_START + "{{ turn.role | label }}" + LABEL_END
            + "{% if turn.role == 'assistant' %}{% generation %}{{ turn.text | escape }}{% endgeneration %}"
            + "{% else %}{{ turn.text | escape }}{% endif %}" + TURN_END + "\n{% endfor %}")

_CONTROL = re.compile(r"\\|###|</turn>")
_LABEL_CONTROL = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """Put a backslash before each backslash and control string."""
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


FILTERS: dict[str, Callable[[str], str]] = {
    "escape": escape, "label": lambda s: _LABEL_CONTROL.sub(lambda m: "\\" + m[0], s), "trim": str.strip, "upper": str.upper, "lower": str.lower}
FIELDS = {"turn": ("role", "text"), "loop": ("index", "first", "last")}


class TemplateError(ValueError):
    """A template that the language does not allow."""


@dataclass(frozen=True)
class Node:
    """Syntax tree: a kind, a value, and children."""

    kind: str
    value: object = None
    children: tuple = ()


_PARTS = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_WORDS = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([0-9]+)|([A-Za-z_]+)|(==|!=|<=|>=|[<>+~|().=]))")
_UNQUOTE = {"n": "\n", "t": "\t"}


def _lex(code: str) -> list[tuple[str, object]]:
    out, at = [], 0
    code = code.rstrip()
    while at < len(code):
        m = _WORDS.match(code, at)
        if not m:
            raise TemplateError(f"cannot read {code[at:at + 20]!r}")
        text, number, name, sign = m.groups()
        if text:
            out.append(("text", re.sub(r"\\(.)", lambda e: _UNQUOTE.get(e[1], e[1]), text[1:-1], flags=re.S)))
        elif number:
            out.append(("number", int(number)))
        else:
            out.append(("name", name) if name else ("sign", sign))
        at = m.end()
    return out


class _Expression:
    """Recursive descent over the words of one expression."""

    LEVELS = [("or",), ("and",), ("==", "!=", "<", ">", "<=", ">="), ("+", "~")]

    def __init__(self, code: str):
        self.words, self.at = _lex(code), 0

    def peek(self) -> object:
        return self.words[self.at][1] if self.at < len(self.words) and self.words[self.at][0] in ("name", "sign") else None

    def next(self) -> tuple[str, object]:
        if self.at == len(self.words):
            raise TemplateError("an expression ends early")
        self.at += 1
        return self.words[self.at - 1]

    def parse(self) -> Node:
        node = self.level(0)
        if self.at < len(self.words):
            raise TemplateError(f"cannot use {self.words[self.at][1]!r} here")
        return node

    def level(self, k: int) -> Node:
        if k == len(self.LEVELS):
            return self.filtered()
        if k == 2 and self.peek() == "not":
            self.next()
            return Node("not", None, (self.level(2),))
        node = self.level(k + 1)
        while self.peek() in self.LEVELS[k]:
            sign = self.next()[1]
            node = Node("operation", sign, (node, self.level(k + 1)))
        return node

    def filtered(self) -> Node:
        node = self.atom()
        while self.peek() == "|":
            self.next()
            kind, name = self.next()
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            node = Node("filter", name, (node,))
        return node

    def atom(self) -> Node:
        kind, value = self.next()
        if kind in ("text", "number"):
            return Node("constant", value)
        if value == "(":
            node = self.level(0)
            if self.next()[1] != ")":
                raise TemplateError("a parenthesis is not closed")
            return node
        if kind != "name":
            raise TemplateError(f"cannot use {value!r} here")
        if value in ("true", "false"):
            return Node("constant", value == "true")
        if self.peek() == ".":
            self.next()
            field = self.next()[1]
            if field not in FIELDS.get(value, ()):
                raise TemplateError(f"{value}.{field} cannot be read")
            return Node("field", (value, field))
        return Node("name", value)


def parse(template: str) -> Node:
    """Syntax tree of a template."""
    stack: list[tuple[str, list, list]] = [("template", [], [])]         # kind, children so far, finished branches
    at = 0
    for m in [*_PARTS.finditer(template), None]:
        plain = template[at:m.start() if m else len(template)]
        if plain:
            stack[-1][1].append(Node("constant", plain))
        if m is None:
            break
        at = m.end()
        if m[1] is not None:
            stack[-1][1].append(Node("output", None, (_Expression(m[1]).parse(),)))
            continue
        word, _, rest = m[2].strip().partition(" ")
        kind, body, done = stack[-1]
        if word == "for":
            if rest.split() != ["turn", "in", "turns"]:
                raise TemplateError("a loop goes over the turns only")
            stack.append(("for", [], []))
        elif word == "if":
            stack.append(("if", [], [_Expression(rest).parse()]))
        elif word in ("elif", "else") and kind == "if":
            done.append(Node("block", None, tuple(body)))
            body.clear()
            done.append(_Expression(rest).parse() if word == "elif" else Node("constant", True))
        elif word == "generation":
            stack.append(("generation", [], []))
        elif word == "set":
            name, sign, value = rest.partition("=")
            if not sign or not name.strip().isidentifier() or name.strip() in (*FIELDS, "turns"):
                raise TemplateError("cannot set " + rest)
            body.append(Node("set", name.strip(), (_Expression(value).parse(),)))
        elif word == f"end{kind}" and len(stack) > 1:
            stack.pop()
            children = tuple([*done, Node("block", None, tuple(body))])
            stack[-1][1].append(Node(kind, None, children))
        else:
            raise TemplateError(f"cannot use {word!r} here")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not closed")
    return Node("block", None, tuple(stack[0][1]))


def _text(value: object) -> str:
    return "" if value is None else str(value).lower() if isinstance(value, bool) else str(value)


_OPERATIONS: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b, "~": lambda a, b: _text(a) + _text(b), "or": lambda a, b: a or b, "and": lambda a, b: a and b,
    "+": lambda a, b: a + b if isinstance(a, int) and isinstance(b, int) else _text(a) + _text(b)}


def fold(node: Node) -> Node:
    """The same tree with what is constant computed: operations, filters, outputs, tests, and neighbouring texts."""
    children = tuple(fold(c) for c in node.children)
    node = Node(node.kind, node.value, children)
    constant = all(c.kind == "constant" for c in children)
    if node.kind == "operation" and constant:
        return Node("constant", _OPERATIONS[node.value](*(c.value for c in children)))
    if node.kind == "not" and constant:
        return Node("constant", not children[0].value)
    if node.kind == "filter" and constant:
        return Node("constant", FILTERS[node.value](_text(children[0].value)))
    if node.kind == "output" and constant:
        return Node("constant", _text(children[0].value))
    if node.kind == "if":
        kept = []
        for test, branch in zip(children[::2], children[1::2]):
            if test.kind == "constant" and not test.value:
                continue
            kept += [test, branch]
            if test.kind == "constant":
                break
        if not kept:
            return Node("block")
        return kept[1] if kept[0].kind == "constant" else Node("if", None, tuple(kept))
    if node.kind == "block":
        flat: list[Node] = []
        for c in children:
            for x in c.children if c.kind == "block" else (c,):
                if x.kind == "constant" and flat and flat[-1].kind == "constant":
                    flat[-1] = Node("constant", flat[-1].value + x.value)
                else:
                    flat.append(x)
        return Node("block", None, tuple(flat))
    return node


class _Page:
    """What a rendering writes: text parts and generation spans, in code points."""

    def __init__(self):
        self.parts, self.size, self.spans = [], 0, []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)


def _value(node: Node) -> Callable[[dict], object]:
    if node.kind == "constant":
        return lambda scope, v=node.value: v
    if node.kind == "name":
        return lambda scope, n=node.value: scope.get(n)
    if node.kind == "field":
        owner, field = node.value
        return lambda scope: (scope.get(owner) or {}).get(field)
    inner = [_value(c) for c in node.children]
    if node.kind == "not":
        return lambda scope: not inner[0](scope)
    if node.kind == "filter":
        return lambda scope, f=FILTERS[node.value]: f(_text(inner[0](scope)))
    if node.value == "or":
        return lambda scope: inner[0](scope) or inner[1](scope)
    if node.value == "and":
        return lambda scope: inner[0](scope) and inner[1](scope)
    return lambda scope, f=_OPERATIONS[node.value]: f(inner[0](scope), inner[1](scope))


def _writer(node: Node) -> Callable[[dict, _Page], None]:
    if node.kind == "constant":
        return lambda scope, page, v=node.value: page.write(v)
    if node.kind == "output":
        value = _value(node.children[0])
        return lambda scope, page: page.write(_text(value(scope)))
    if node.kind == "set":
        value = _value(node.children[0])
        return lambda scope, page, n=node.value: scope.__setitem__(n, value(scope))
    if node.kind == "if":
        branches = [(_value(t), _writer(b)) for t, b in zip(node.children[::2], node.children[1::2])]

        def choose(scope: dict, page: _Page) -> None:
            for test, write in branches:
                if test(scope):
                    return write(scope, page)
        return choose
    writers = [_writer(c) for c in node.children]
    if node.kind == "for":
        def loop(scope: dict, page: _Page) -> None:
            turns = scope["turns"]
            for i, turn in enumerate(turns):
                inner = scope | {"turn": turn, "loop": {"index": i + 1, "first": i == 0, "last": i == len(turns) - 1}}
                for write in writers:
                    write(inner, page)
        return loop
    if node.kind == "generation":
        def marked(scope: dict, page: _Page) -> None:
            start = page.size
            for write in writers:
                write(scope, page)
            page.spans.append((start, page.size))
        return marked

    def block(scope: dict, page: _Page) -> None:
        for write in writers:
            write(scope, page)
    return block


def compile_template(template: str) -> Callable[[list[dict]], tuple[str, list[tuple[int, int]]]]:
    """A function from turns (dicts of role and text) to formatted text and its generation spans."""
    write = _writer(fold(parse(template)))

    def render(turns: list[dict]) -> tuple[str, list[tuple[int, int]]]:
        page = _Page()
        write({"turns": turns}, page)
        return "".join(page.parts), page.spans
    return render


_MARK = re.compile(r"\\.|</turn>\n|: ", re.S)


def parse_formatted(text: str) -> list[tuple[str, str]]:
    """Roles and texts of what TEMPLATE wrote."""
    turns, at = [], 0
    while at < len(text):
        if not text.startswith(TURN_START, at):
            raise ValueError(f"no turn starts at {at}")
        label_end = next(m for m in _MARK.finditer(text, at + len(TURN_START)) if m[0] == LABEL_END)
        turn_end = next(m for m in _MARK.finditer(text, label_end.end()) if m[0] == TURN_END + "\n")
        turns.append((unescape(text[at + len(TURN_START):label_end.start()]), unescape(text[label_end.end():turn_end.start()])))
        at = turn_end.end()
    return turns


def write_formatted(turns: DataFrame, template: str = TEMPLATE, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                    text: str = "text", folder: str | None = None) -> str:
    """Format all conversations, write them as Parquet (conv_id, formatted, generation spans), and return the folder.

    Turns follow their order column, equal ones by role, then text; a null order comes first. A null role or text is an
    empty one. Repeated rows are turns of their own. Rows with a null conversation id are one conversation. Other columns
    are not read; an empty table gives an empty output. A conversation is one formatted value, so its turns meet in one
    row; different conversations never do.
    """
    compile_template(template)                   # a faulty template fails here, not in a task
    spark = turns.sparkSession
    folder = folder or f"{_shared_folder(spark)}/chat-{uuid.uuid4().hex}"
    row = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                   F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    grouped = turns.select(F.col(conv_id).alias("conv_id"), row.alias("r")).groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_list("r")), lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("turns"))

    @F.arrow_udf("struct<formatted:string,generated:array<struct<first:int,end:int>>>")
    def formatted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        render = compile_template(template)
        kind = pa.struct([("formatted", pa.string()), ("generated", pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])))])
        for batch in batches:
            done = (render(conversation.as_py()) for conversation in batch)
            yield pa.array([{"formatted": page, "generated": [{"first": a, "end": b} for a, b in spans]} for page, spans in done], kind)

    grouped.select("conv_id", formatted("turns").alias("page")).select("conv_id", "page.*").write.parquet(folder)
    return folder


def read_formatted(pages: DataFrame) -> DataFrame:
    """Append turns (array of role and text, unescaped) and generated_text (all text under the generation spans, unescaped,
    in order) to formatted conversations that TEMPLATE wrote."""
    @F.arrow_udf("struct<turns:array<struct<role:string,text:string>>,generated_text:string>")
    def parsed(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.struct([("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))), ("generated_text", pa.string())])
        for texts, spans in batches:
            rows = []
            for page, own in zip(texts, spans):
                page = page.as_py()
                rows.append({"turns": [{"role": r, "text": t} for r, t in parse_formatted(page)],
                             "generated_text": "".join(unescape(page[s["first"]:s["end"]]) for s in own.as_py())})
            yield pa.array(rows, kind)

    return pages.withColumn("__parsed", parsed("formatted", "generated")).select(*pages.columns, "__parsed.*")
