"""A small sandboxed template language, compiled to Python closures.

Text with ``{{ expression }}`` and ``{% for x in list %}``, ``{% if %}``/``{% elif %}``/``{% else %}``,
``{% set name = expression %}`` and ``{% generation %}`` ... ``{% endgeneration %}``. Expressions have
literals, names, ``a.b`` and ``a['b']`` on mappings only, ``+``, comparisons, ``in``, ``and``, ``or``,
``not`` and registered filters. There are no calls, no attributes of Python objects and no other
statements. Templates are parsed into a syntax tree, constants are folded, and every node becomes a
closure; nothing is evaluated as Python source.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

#: A piece of output and whether it is inside a generation block.
Chunk = tuple[str, bool]
Env = dict
_TAGS = re.compile(r"\{\{(.*?)\}\}|\{%-?(.*?)-?%\}", re.S)
_WORDS = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+<>|.()\[\]]))")
_ESCAPES = {"n": "\n", "t": "\t"}


class TemplateError(ValueError):
    """The template is malformed, or asks for something the sandbox lacks."""


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: object
    key: object


@dataclass(frozen=True)
class Filter:
    name: str
    of: object


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


@dataclass(frozen=True)
class Out:
    value: object


@dataclass(frozen=True)
class For:
    name: str
    of: object
    body: tuple


@dataclass(frozen=True)
class If:
    arms: tuple  # of (condition, body)


@dataclass(frozen=True)
class Set:
    name: str
    value: object


@dataclass(frozen=True)
class Generation:
    body: tuple


_BINARY: dict[str, Callable] = {
    "+": lambda a, b: a + b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b,
    ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b,
}


class _Expression:
    """Recursive descent over one expression's words."""

    def __init__(self, source: str, filters: Mapping[str, Callable]):
        self.words, self.at, self.filters = [], 0, filters
        i, source = 0, source.strip()
        while i < len(source):
            m = _WORDS.match(source, i)
            if not m:
                raise TemplateError(f"can't read {source[i:]!r}")
            text, number, name, sign = m.groups()
            if text is not None:
                self.words.append(("const", re.sub(r"\\(.)", lambda x: _ESCAPES.get(x[1], x[1]), text[1:-1])))
            else:
                self.words.append(("const", int(number)) if number else ("name", name) if name else ("sign", sign))
            i = m.end()

    def take(self, *wanted: str) -> str | None:
        if self.at < len(self.words) and self.words[self.at][0] != "const" and self.words[self.at][1] in wanted:
            self.at += 1
            return self.words[self.at - 1][1]
        return None

    def whole(self):
        out = self.either()
        if self.at < len(self.words):
            raise TemplateError(f"unexpected {self.words[self.at][1]!r}")
        return out

    def either(self):
        out = self.both()
        while self.take("or"):
            out = Op("or", (out, self.both()))
        return out

    def both(self):
        out = self.negated()
        while self.take("and"):
            out = Op("and", (out, self.negated()))
        return out

    def negated(self):
        return Op("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self):
        out = self.summed()
        while op := self.take("==", "!=", "<", ">", "<=", ">=", "in"):
            out = Op(op, (out, self.summed()))
        return out

    def summed(self):
        out = self.filtered()
        while self.take("+"):
            out = Op("+", (out, self.filtered()))
        return out

    def filtered(self):
        out = self.atom()
        while self.take("|"):
            name = self.name()
            if name not in self.filters:
                raise TemplateError(f"no filter {name!r}")
            out = Filter(name, out)
        return out

    def name(self) -> str:
        if self.at >= len(self.words) or self.words[self.at][0] != "name":
            raise TemplateError("a name is missing")
        self.at += 1
        return self.words[self.at - 1][1]

    def atom(self):
        if self.take("("):
            out = self.either()
            if not self.take(")"):
                raise TemplateError("a ) is missing")
        elif self.at < len(self.words) and self.words[self.at][0] == "const":
            out = Const(self.words[self.at][1])
            self.at += 1
        else:
            name = self.name()
            out = Const({"true": True, "false": False, "none": None}[name]) if name in ("true", "false", "none") else Name(name)
        while sign := self.take(".", "["):
            if sign == ".":
                out = Item(out, Const(self.name()))
            else:
                out = Item(out, self.either())
                if not self.take("]"):
                    raise TemplateError("a ] is missing")
        return out


def _parse(source: str, filters: Mapping[str, Callable]) -> tuple:
    """Syntax tree: a tuple of nodes."""
    parts, at = [], 0
    for m in _TAGS.finditer(source):
        if m.start() > at:
            parts.append(("text", source[at : m.start()]))
        parts.append(("out", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    if at < len(source):
        parts.append(("text", source[at:]))
    i = 0

    def expr(text: str):
        return _Expression(text, filters).whole()

    def body(*ends: str) -> tuple[tuple, str, str]:
        nonlocal i
        out = []
        while i < len(parts):
            kind, text = parts[i]
            i += 1
            if kind == "text":
                out.append(Out(Const(text)))
            elif kind == "out":
                out.append(Out(expr(text)))
            else:
                word, _, rest = text.partition(" ")
                if word in ends:
                    return tuple(out), word, rest
                out.append(tag(word, rest))
        if ends:
            raise TemplateError(f"{ends[0]} is missing")
        return tuple(out), "", ""

    def tag(word: str, rest: str):
        if word == "for" and (m := re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)):
            return For(m[1], expr(m[2]), body("endfor")[0])
        if word == "generation":
            return Generation(body("endgeneration")[0])
        if word == "set" and (m := re.fullmatch(r"\s*([A-Za-z_]\w*)\s*=(?!=)(.+)", rest, re.S)):
            return Set(m[1], expr(m[2]))
        if word == "if":
            arms, condition = [], expr(rest)
            while True:
                inner, end, rest = body("endif", "elif", "else")
                arms.append((condition, inner))
                if end == "endif":
                    return If(tuple(arms))
                condition = Const(True) if end == "else" else expr(rest)
        raise TemplateError(f"can't read the tag {word!r}")

    return body()[0]


def _fold_value(node, filters: Mapping[str, Callable]):
    if isinstance(node, Item):
        return Item(_fold_value(node.of, filters), _fold_value(node.key, filters))
    if isinstance(node, Filter):
        of = _fold_value(node.of, filters)
        return Const(filters[node.name](of.value)) if isinstance(of, Const) else Filter(node.name, of)
    if isinstance(node, Op):
        args = tuple(_fold_value(a, filters) for a in node.args)
        if all(isinstance(a, Const) for a in args):
            return Const(_value(Op(node.op, args), filters)({}))
        if node.op in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (node.op == "and") else args[0]
        return Op(node.op, args)
    return node


def _fold(nodes: tuple, filters: Mapping[str, Callable]) -> tuple:
    """Constant expressions are computed, decided branches replaced, neighbouring constant texts joined."""
    out: list = []

    def put(node) -> None:
        if isinstance(node, Out) and isinstance(node.value, Const):
            text = "" if node.value.value is None else str(node.value.value)
            if out and isinstance(out[-1], Out) and isinstance(out[-1].value, Const):
                text = out.pop().value.value + text
            node = Out(Const(text))
            if not text:
                return
        out.append(node)

    for node in nodes:
        if isinstance(node, Out):
            put(Out(_fold_value(node.value, filters)))
        elif isinstance(node, Set):
            put(Set(node.name, _fold_value(node.value, filters)))
        elif isinstance(node, For):
            put(For(node.name, _fold_value(node.of, filters), _fold(node.body, filters)))
        elif isinstance(node, Generation):
            put(Generation(_fold(node.body, filters)))
        else:
            arms = []
            for condition, inner in node.arms:
                condition = _fold_value(condition, filters)
                if isinstance(condition, Const) and not condition.value:
                    continue
                arms.append((condition, _fold(inner, filters)))
                if isinstance(condition, Const):
                    break
            if arms and isinstance(arms[0][0], Const):
                for inner in arms[0][1]:
                    put(inner)
            elif arms:
                put(If(tuple(arms)))
    return tuple(out)


def _value(node, filters: Mapping[str, Callable]) -> Callable[[Env], object]:
    if isinstance(node, Const):
        return lambda env, v=node.value: v
    if isinstance(node, Name):
        return lambda env, n=node.name: env.get(n)
    if isinstance(node, Filter):
        run, of = filters[node.name], _value(node.of, filters)
        return lambda env: run(of(env))
    if isinstance(node, Item):
        of, key = _value(node.of, filters), _value(node.key, filters)

        def item(env: Env):
            value = of(env)
            return value.get(key(env)) if isinstance(value, Mapping) else None

        return item
    args = [_value(a, filters) for a in node.args]
    if node.op == "not":
        return lambda env: not args[0](env)
    if node.op == "and":
        return lambda env: args[0](env) and args[1](env)
    if node.op == "or":
        return lambda env: args[0](env) or args[1](env)
    run = _BINARY[node.op]
    return lambda env: run(args[0](env), args[1](env))


def _body(nodes: tuple, filters: Mapping[str, Callable]) -> Callable[[Env, bool], Iterator[Chunk]]:
    steps = [_node(n, filters) for n in nodes]

    def run(env: Env, masked: bool) -> Iterator[Chunk]:
        for step in steps:
            yield from step(env, masked)

    return run


def _node(node, filters: Mapping[str, Callable]) -> Callable[[Env, bool], Iterator[Chunk]]:
    if isinstance(node, Out):
        value = _value(node.value, filters)

        def out(env: Env, masked: bool) -> Iterator[Chunk]:
            v = value(env)
            if v is not None:
                yield str(v), masked

        return out
    if isinstance(node, Set):
        value = _value(node.value, filters)

        def assign(env: Env, masked: bool) -> Iterator[Chunk]:
            env[node.name] = value(env)
            return iter(())

        return assign
    if isinstance(node, Generation):
        inner = _body(node.body, filters)
        return lambda env, masked: inner(env, True)
    if isinstance(node, For):
        of, inner = _value(node.of, filters), _body(node.body, filters)

        def loop(env: Env, masked: bool) -> Iterator[Chunk]:
            own = dict(env)
            for i, own[node.name] in enumerate(of(env) or ()):
                own["loop"] = {"index0": i, "index": i + 1, "first": i == 0}
                yield from inner(own, masked)

        return loop
    arms = [(_value(c, filters), _body(b, filters)) for c, b in node.arms]

    def choose(env: Env, masked: bool) -> Iterator[Chunk]:
        for condition, inner in arms:
            if condition(env):
                yield from inner(env, masked)
                return

    return choose


class Template:
    """A compiled template. ``chunks(**names)`` yields output as it is made; lists may be lazy iterators."""

    def __init__(self, source: str, filters: Mapping[str, Callable[[object], object]] | None = None):
        self.filters = dict(filters or {})
        self.tree = _fold(_parse(source, self.filters), self.filters)
        self._run = _body(self.tree, self.filters)

    def chunks(self, **names) -> Iterator[Chunk]:
        return self._run(dict(names), False)

    def render(self, **names) -> tuple[str, list[tuple[int, int]]]:
        """(output, generation spans as code point offsets); neighbouring spans of one block are joined."""
        out, spans, at, was = [], [], 0, False
        for text, masked in self.chunks(**names):
            if masked and text:
                if was:
                    spans[-1] = (spans[-1][0], at + len(text))
                else:
                    spans.append((at, at + len(text)))
            was = masked if text else was
            at += len(text)
            out.append(text)
        return "".join(out), spans
