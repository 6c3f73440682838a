"""Compiler of a small sandboxed template language.

    {{ expression }}                      prints a value
    {% set name = expression %}
    {% if e %} ... {% elif e %} ... {% else %} ... {% endif %}
    {% for name in e %} ... {% endfor %}  with loop.index0, loop.first, loop.last
    {% generation %} ... {% endgeneration %}
    {# comment #}

Expressions: strings, integers, true, false, none, names, ``a.b`` and ``a["b"]``
of mappings and lists, ``+ ~ == != < > <= >= in not and or``, parentheses and
filters ``x|trim``.  There are no calls, no attributes of Python objects and no
loops but over lists, so a template ends and reaches nothing but its input.

A template is parsed into a syntax tree, constants are folded, dead branches
dropped and neighbouring texts joined; what is left becomes closures.  Rendering
gives the text and the ranges, in code points, printed inside generation marks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from typing import Any, NamedTuple


class TemplateError(ValueError):
    pass


class Node(NamedTuple):
    kind: str
    args: tuple


_TAGS = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}|\{#.*?#\}", re.S)
_TOKENS = re.compile(r"""\s*(?:(?P<num>\d+)|(?P<str>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+~<>()\[\].|,]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_LITERALS = {"true": True, "false": False, "none": None}
_COMPARE: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b,
}


def _show(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)


FILTERS: dict[str, Callable[[Any], Any]] = {
    "trim": lambda x: _show(x).strip(), "upper": lambda x: _show(x).upper(), "lower": lambda x: _show(x).lower(),
    "length": lambda x: len(x or ()), "string": _show,
}


class _Expression:
    """Precedence climbing over the tokens of one tag."""

    def __init__(self, source: str, filters: Mapping[str, Callable]):
        self.tokens, self.at, self.filters = [], 0, filters
        at, source = 0, source.strip()
        while at < len(source):
            if not (m := _TOKENS.match(source, at)):
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()

    def peek(self) -> str | None:
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        return None if kind == "str" else text

    def take(self, *wanted: str) -> bool:
        if self.peek() in wanted and self.peek() is not None:
            self.at += 1
            return True
        return False

    def need(self, kind: str) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != kind:
            raise TemplateError(f"{kind} expected")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self) -> Node:
        node = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def either(self) -> Node:
        node = self.both()
        while self.take("or"):
            node = Node("or", (node, self.both()))
        return node

    def both(self) -> Node:
        node = self.negation()
        while self.take("and"):
            node = Node("and", (node, self.negation()))
        return node

    def negation(self) -> Node:
        return Node("not", (self.negation(),)) if self.take("not") else self.comparison()

    def comparison(self) -> Node:
        node = self.sum()
        while (op := self.peek()) in _COMPARE:
            self.at += 1
            node = Node("compare", (op, node, self.sum()))
        return node

    def sum(self) -> Node:
        node = self.filtered()
        while (op := self.peek()) in ("+", "~"):
            self.at += 1
            node = Node("add" if op == "+" else "join", (node, self.filtered()))
        return node

    def filtered(self) -> Node:
        node = self.member()
        while self.take("|"):
            name = self.need("name")
            if name not in self.filters:
                raise TemplateError(f"no filter {name!r}")
            node = Node("filter", (name, node))
        return node

    def member(self) -> Node:
        node = self.atom()
        while True:
            if self.take("."):
                node = Node("item", (node, Node("const", (self.need("name"),))))
            elif self.take("["):
                node = Node("item", (node, self.either()))
                if not self.take("]"):
                    raise TemplateError("] expected")
            else:
                return node

    def atom(self) -> Node:
        if self.take("("):
            node = self.either()
            if not self.take(")"):
                raise TemplateError(") expected")
            return node
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends early")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "num":
            return Node("const", (int(text),))
        if kind == "str":
            return Node("const", (re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S),))
        if kind == "name" and text not in ("and", "or", "not", "in"):
            return Node("const", (_LITERALS[text],)) if text in _LITERALS else Node("name", (text,))
        raise TemplateError(f"unexpected {text!r}")


def parse(source: str, filters: Mapping[str, Callable] = FILTERS) -> Node:
    """The syntax tree: block nodes of text, print, set, if, for and generation."""
    stack: list[tuple[str, list]] = [("block", [])]
    heads: list[Any] = []
    at = 0

    def expression(text: str) -> Node:
        return _Expression(text, filters).whole()

    def close(*kinds: str) -> Node:
        kind, body = stack.pop()
        if kind not in kinds or not stack:
            raise TemplateError(f"an end without its start, or a {kind} without its end")
        return Node("block", tuple(body))

    for m in _TAGS.finditer(source):
        stack[-1][1].append(Node("text", (source[at : m.start()],)))
        at = m.end()
        if m[1] is not None:
            stack[-1][1].append(Node("print", (expression(m[1]),)))
        elif m[2] is not None:
            word, _, rest = m[2].strip().partition(" ")
            if word == "set":
                name, eq, value = rest.partition("=")
                if not eq or not name.strip().isidentifier():
                    raise TemplateError("set needs a name and a value")
                stack[-1][1].append(Node("set", (name.strip(), expression(value))))
            elif word == "if":
                heads.append([[expression(rest), None]])
                stack.append(("if", []))
            elif word in ("elif", "else"):
                heads[-1:] or close()
                heads[-1][-1][1] = close("if")
                heads[-1].append([expression(rest) if word == "elif" else Node("const", (True,)), None])
                stack.append(("if", []))
            elif word == "endif":
                heads[-1:] or close()
                heads[-1][-1][1] = close("if")
                stack[-1][1].append(Node("if", tuple(tuple(b) for b in heads.pop())))
            elif word == "for":
                name, _, value = rest.partition(" in ")
                if not name.strip().isidentifier():
                    raise TemplateError("for needs a name and a list")
                heads.append((name.strip(), expression(value)))
                stack.append(("for", []))
            elif word == "endfor":
                body = close("for")
                stack[-1][1].append(Node("for", (*heads.pop(), body)))
            elif word == "generation":
                stack.append(("generation", []))
            elif word == "endgeneration":
                body = close("generation")
                stack[-1][1].append(Node("generation", (body,)))
            else:
                raise TemplateError(f"unknown tag {word!r}")
    stack[-1][1].append(Node("text", (source[at:],)))
    if len(stack) > 1:
        raise TemplateError(f"a {stack[-1][0]} without its end")
    return Node("block", tuple(stack[0][1]))


def fold(node: Node, filters: Mapping[str, Callable] = FILTERS) -> Node:
    """The tree with constant expressions computed, dead branches left out and texts joined."""
    kind, args = node
    if kind == "block":
        out: list[Node] = []
        for part in (fold(p, filters) for p in args):
            for one in part.args if part.kind == "block" else (part,):
                if one.kind == "print" and one.args[0].kind == "const":
                    one = Node("text", (_show(one.args[0].args[0]),))
                if one.kind == "text" and out and out[-1].kind == "text":
                    out[-1] = Node("text", (out[-1].args[0] + one.args[0],))
                elif one != Node("text", ("",)):
                    out.append(one)
        return Node("block", tuple(out))
    if kind == "if":
        live = []
        for test, body in args:
            test = fold(test, filters)
            if test.kind == "const" and not test.args[0]:
                continue
            live.append((test, fold(body, filters)))
            if test.kind == "const":
                break
        if live and live[0][0].kind == "const":
            return live[0][1]
        return Node("if", tuple(live)) if live else Node("block", ())
    new = Node(kind, tuple(fold(a, filters) if isinstance(a, Node) else a for a in args))
    if kind in ("add", "join", "compare", "filter", "not", "and", "or") and all(a.kind == "const" for a in new.args if isinstance(a, Node)):
        try:
            return Node("const", (_value(new, filters)({}),))
        except TypeError:  # it is reported where it is rendered, if it is
            return new
    return new


def _value(node: Node, filters: Mapping[str, Callable]) -> Callable[[dict], Any]:
    kind, args = node
    if kind == "const":
        constant = args[0]
        return lambda env: constant
    if kind == "name":
        name = args[0]
        return lambda env: env.get(name)
    if kind == "filter":
        run, inner = filters[args[0]], _value(args[1], filters)
        return lambda env: run(inner(env))
    if kind == "compare":
        op, a, b = _COMPARE[args[0]], _value(args[1], filters), _value(args[2], filters)
        return lambda env: op(a(env), b(env))
    if kind == "not":
        a = _value(args[0], filters)
        return lambda env: not a(env)
    a, b = (_value(x, filters) for x in args)
    if kind == "and":
        return lambda env: a(env) and b(env)
    if kind == "or":
        return lambda env: a(env) or b(env)
    if kind == "add":
        return lambda env: a(env) + b(env)
    if kind == "join":
        return lambda env: _show(a(env)) + _show(b(env))

    def item(env: dict) -> Any:
        held, key = a(env), b(env)
        if isinstance(held, Mapping):
            return held.get(key)
        return held[key] if isinstance(held, (list, tuple)) and isinstance(key, int) and 0 <= key < len(held) else None

    return item


class _Out:
    def __init__(self):
        self.parts: list[str] = []
        self.size = 0
        self.spans: list[tuple[int, int]] = []

    def add(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)


def _code(node: Node, filters: Mapping[str, Callable]) -> Callable[[dict, _Out], None]:
    kind, args = node
    if kind == "text":
        text = args[0]
        return lambda env, out: out.add(text)
    if kind == "print":
        value = _value(args[0], filters)
        return lambda env, out: out.add(_show(value(env)))
    if kind == "set":
        name, value = args[0], _value(args[1], filters)

        def put(env: dict, out: _Out) -> None:
            env[name] = value(env)

        return put
    if kind == "block":
        steps = [_code(a, filters) for a in args]

        def block(env: dict, out: _Out) -> None:
            for step in steps:
                step(env, out)

        return block
    if kind == "if":
        branches = [(_value(test, filters), _code(body, filters)) for test, body in args]

        def choose(env: dict, out: _Out) -> None:
            for test, body in branches:
                if test(env):
                    return body(env, out)

        return choose
    if kind == "generation":
        inner = _code(args[0], filters)

        def mark(env: dict, out: _Out) -> None:
            start = out.size
            inner(env, out)
            out.spans.append((start, out.size))

        return mark
    name, value, body = args[0], _value(args[1], filters), _code(args[2], filters)

    def loop(env: dict, out: _Out) -> None:
        items = value(env) or ()
        if not isinstance(items, (list, tuple)):
            raise TemplateError("for runs over lists only")
        for i, one in enumerate(items):
            body(env | {name: one, "loop": {"index0": i, "first": i == 0, "last": i == len(items) - 1}}, out)

    return loop


class Template:
    def __init__(self, source: str, filters: Mapping[str, Callable] | None = None):
        known = {**FILTERS, **(filters or {})}
        self.tree = fold(parse(source, known), known)
        self._run = _code(self.tree, known)

    def render(self, **values: Any) -> tuple[str, list[tuple[int, int]]]:
        """The text and its generation ranges. Unknown names are none, and none prints nothing."""
        out = _Out()
        self._run(dict(values), out)
        return "".join(out.parts), out.spans
