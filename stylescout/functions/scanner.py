"""A lexical reader of JavaScript, TypeScript and JSX that states, in flat rows, what class and style expressions are made of.

It reads just the expression forms that matter (strings, templates, arrays, objects, ternaries, logical operators, calls,
identifiers, JSX) and steps over everything else with balanced brackets. Unbalanced sources raise ``ScanError``. It decides nothing: what
an identifier stands for, which rows count for an index or for an edit, their order, tokens and normal forms are Spark's work
(``sources/corpus.py``).
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

#: Functions whose arguments are class lists (fixed values).
HELPER_NAMES = frozenset({"cn", "clsx", "classnames", "classNames", "twMerge", "cx"})
#: White space as JavaScript sees it (fixed values).
BLANKS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
_SPACE = re.compile(r"(?:\s|﻿|//[^\n]*|/\*.*?\*/)*", re.S)
_NAME = re.compile(r"[A-Za-z_$#\u00aa-\uffff][\w$\u00aa-\uffff]*")
_NUMBER = re.compile(r"0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?")
_OPERATOR = re.compile(r"=>|\.\.\.|\?\?=|\?\?|\?\.(?!\d)|&&=|\|\|=|&&|\|\||===|!==|==|!=|<=|>=|\+\+|--|\*\*|[-+*/%&|^=<>!~?:.,;@]")
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_ESCAPE = re.compile(r"\\(?:u\{([0-9a-fA-F]+)\}|u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|(\r\n|[\s\S]))")
_TAG = re.compile(r"<\s*(?:>|[A-Za-z_$])")
_GENERIC = re.compile(r"<\s*[\w$]+\s*(?:,|extends\b)")
#: Type arguments of a call: a name's ``<...>`` before a parenthesis.
_TYPES = re.compile(r"<(?:[\w$.,\s\[\]'\"]|[|&](?![|&])|<[\w$.,\s\[\]'\"|]*>)*>(?=\s*\()")
_ENTITY = re.compile(r"&(?:#\d+|#[xX][\da-fA-F]+|[A-Za-z]\w*);")
_HASHBANG = re.compile(r"#![^\n]*")
_JSX_NAME = re.compile(r"[A-Za-z_$][\w$.:-]*")
_BEFORE_VALUE = frozenset("return typeof case in of do else void delete throw new await yield default extends instanceof".split())
#: Words whose parentheses are followed by a statement.
_BEFORE_STATEMENT = frozenset("if while for with".split())
_DECLARE = frozenset(("const", "let", "var"))
_LETTERS = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": "", "\r\n": "", "\r": ""}


class ScanError(ValueError):
    pass


@dataclass
class Node:
    """A piece of source. parts: children in source order; text: a string's value, a name, an operator."""

    kind: str
    start: int
    end: int
    text: str = ""
    parts: list = field(default_factory=list)
    more: object = None


def _decode(raw: str) -> str:
    def one(m: re.Match) -> str:
        code = m[1] or m[2] or m[3]
        if code and int(code, 16) > 0x10FFFF:
            raise ScanError(f"no character {m[0]}")
        return chr(int(code, 16)) if code else _LETTERS.get(m[4], m[4])

    return _ESCAPE.sub(one, raw) if "\\" in raw else raw


class Reader:
    def __init__(self, source: str) -> None:
        self.s, self.i, self.inits = source, 0, []
        if m := _HASHBANG.match(source):
            self.i = m.end()

    def fail(self, what: str) -> None:
        raise ScanError(f"{what} at offset {self.i}")

    def space(self) -> str:
        self.i = _SPACE.match(self.s, self.i).end()
        return self.s[self.i : self.i + 1]

    def program(self) -> Node:
        out = Node("other", 0, len(self.s), parts=self.sequence("", statements=True))
        if self.i < len(self.s):
            self.fail(f"unexpected {self.s[self.i]!r}")
        return out

    # -- items ---------------------------------------------------------------------------------------------------

    def sequence(self, close: str, statements: bool = False) -> list[Node]:
        """Expressions and statements up to a closing bracket, which is not consumed."""
        out = []
        while True:
            c = self.space()
            if c == close or not c:
                if close and not c:
                    self.fail(f"missing {close!r}")
                return out
            if c in ",;":
                self.i += 1
                continue
            out.append(self.expression(close + ",;", statement=statements))

    def expression(self, stop: str, statement: bool = False) -> Node:
        """One expression (or the rest of a statement) up to a character of ``stop`` outside all brackets."""
        items: list[Node] = []
        start = self.i
        while True:
            c = self.space()
            if not c or c in stop or c in ")]}":
                break
            value = self.expects_value(items, statement)
            if c in "\"'":
                items.append(self.string())
            elif c == "`":
                items.append(self.template())
            elif c == "(":
                items.append(self.bracketed("paren", ")", items, value))
            elif c == "[":
                items.append(self.bracketed("array" if value else "index", "]", items, value))
            elif c == "{":
                if not self.is_block(items, statement):
                    items.append(self.object())
                else:
                    items.append(self.block())
                    if statement and not self.goes_on():
                        break
            elif c == "<" and items and items[-1].kind == "name" and (m := _TYPES.match(self.s, self.i)):
                self.i = m.end()
            elif c == "<" and value and _TAG.match(self.s, self.i) and not _GENERIC.match(self.s, self.i):
                items.append(self.jsx())
            elif c == "/" and value and (m := _REGEX.match(self.s, self.i)):
                items.append(Node("other", m.start(), m.end()))
                self.i = m.end()
            elif m := _NAME.match(self.s, self.i):
                self.i = m.end()
                if m[0] in _DECLARE and value:
                    items.append(Node("op", m.start(), m.end(), m[0]))
                    self.declaration(items, stop)
                else:
                    items.append(Node("op" if m[0] in _BEFORE_VALUE else "name", m.start(), m.end(), m[0]))
            elif (c.isdigit() or c == ".") and (m := _NUMBER.match(self.s, self.i)):
                self.i = m.end()
                items.append(Node("number", m.start(), m.end(), m[0]))
            elif m := _OPERATOR.match(self.s, self.i):
                items.append(Node("op", m.start(), m.end(), m[0]))
                self.i = m.end()
            else:
                self.i += 1
        if self.i == start:
            self.fail(f"unexpected {self.s[self.i : self.i + 1]!r}")
        return self.shape(items, start)

    @staticmethod
    def expects_value(items: list[Node], statement: bool) -> bool:
        if not items:
            return True
        last = items[-1]
        if last.kind == "paren" and len(items) > 1 and items[-2].kind == "name" and items[-2].text in _BEFORE_STATEMENT:
            return len(items) < 3 or items[-3].text not in (".", "?.")
        return last.kind == "op" and last.text not in ("++", "--") or last.kind == "block"

    @staticmethod
    def is_block(items: list[Node], statement: bool) -> bool:
        """Whether a brace here opens a block: at a statement's start, after parentheses, an arrow, a name or a word like else."""
        if not items:
            return statement
        last = items[-1]
        if last.kind in ("paren", "name", "block", "index"):
            return True
        return last.kind == "op" and last.text in ("=>", "else", "do", ";", ">")

    def goes_on(self) -> bool:
        """Whether a statement may go on after a block."""
        c = self.space()
        return bool(c) and (c in ".?,)" or bool(re.compile(r"(?:else|catch|finally|while)\b").match(self.s, self.i)))

    def bracketed(self, kind: str, close: str, items: list[Node], value: bool) -> Node:
        start = self.i
        self.i += 1
        parts = self.sequence(close)
        self.i += 1
        return Node(kind, start, self.i, parts=parts, more=value)

    def block(self) -> Node:
        start = self.i
        self.i += 1
        parts = self.sequence("}", statements=True)
        self.i += 1
        return Node("block", start, self.i, parts=parts)

    def declaration(self, items: list[Node], stop: str) -> None:
        """Declarators after const, let or var: names with their initializers are noted, patterns are stepped over."""
        while True:
            c = self.space()
            name = None
            if c and c in "[{":
                self.i += 1
                parts = self.sequence("]" if c == "[" else "}")
                self.i += 1
                items.append(Node("block", self.i, self.i, parts=[] if c == "[" else parts))
            elif m := _NAME.match(self.s, self.i):
                name, self.i = m[0], m.end()
            else:
                return
            if self.space() == ":":  # a type
                self.i += 1
                while (c := self.space()) and c not in "=,;)" and not re.compile(r"(?:of|in)\b").match(self.s, self.i):
                    if c in "([{":
                        self.i += 1
                        self.sequence({"(": ")", "[": "]", "{": "}"}[c])
                        self.i += 1
                    elif c in "\"'":
                        self.string()
                    elif self.s.startswith("=>", self.i):
                        self.i += 2
                    elif m := _NAME.match(self.s, self.i):
                        self.i = m.end()
                    else:
                        self.i += 1
            if self.space() == "=" and self.s[self.i : self.i + 2] != "=>":
                self.i += 1
                init = self.expression(stop + ",;")
                items.append(init)
                if name:
                    self.inits.append((name, init))
            if self.space() != ",":
                return
            self.i += 1

    # -- leaves --------------------------------------------------------------------------------------------------

    def string(self) -> Node:
        start, quote = self.i, self.s[self.i]
        m = re.compile(rf"{quote}((?:[^{quote}\\]|\\[\s\S])*){quote}").match(self.s, start)
        if not m or re.search(r"(?<!\\)(?:\\\\)*\n", m[1].replace("\r\n", "\n")) and "\\\n" not in m[1]:
            self.fail("unterminated string")
        self.i = m.end()
        return Node("string", start, self.i, _decode(m[1]))

    def template(self) -> Node:
        start = self.i
        self.i += 1
        pieces, inner, begin = [], [], self.i
        while True:
            c = self.s[self.i : self.i + 1]
            if not c:
                self.fail("unterminated template")
            if c == "\\":
                self.i += 2
            elif c == "`":
                pieces.append(Node("quasi", begin, self.i, self.s[begin : self.i]))
                self.i += 1
                return Node("template", start, self.i, parts=inner, more=pieces)
            elif c == "$" and self.s[self.i + 1 : self.i + 2] == "{":
                pieces.append(Node("quasi", begin, self.i, self.s[begin : self.i]))
                self.i += 2
                self.space()
                inner.append(self.expression(""))
                if self.space() != "}":
                    self.fail("missing '}'")
                self.i += 1
                begin = self.i
            else:
                self.i += 1

    def object(self) -> Node:
        """more: (key node or None, computed, value node or None) of each property."""
        start = self.i
        self.i += 1
        props, parts = [], []
        while (c := self.space()) != "}":
            if not c:
                self.fail("missing '}'")
            if c in ",;":
                self.i += 1
                continue
            begin, key, computed = self.i, None, False
            if self.s.startswith("...", self.i):
                self.i += 3
                self.space()
                parts.append(self.expression(",;"))
                props.append((None, False, None))
                continue
            if c in "\"'":
                key = self.string()
            elif c == "[":
                self.i += 1
                computed = True
                parts += self.sequence("]")
                self.i += 1
            elif m := _NAME.match(self.s, self.i):
                self.i = m.end()
                key = Node("name", m.start(), m.end(), m[0])
            elif m := _NUMBER.match(self.s, self.i):
                self.i = m.end()
            else:
                self.i += 1
                continue
            if self.space() == "?" and self.s[self.i : self.i + 2] != "?.":
                self.i += 1
                self.space()
            if self.s[self.i : self.i + 1] == ":":
                self.i += 1
                self.space()
                value = self.expression(",;")
                parts.append(value)
                props.append((key, computed, value, begin))
            elif self.s[self.i : self.i + 1] in (",", "}", ";"):
                props.append((key, computed, key if key and key.kind == "name" else None, begin))
            else:  # a method, an accessor, a default of a pattern
                parts.append(self.expression(",;", statement=True))
        self.i += 1
        return Node("object", start, self.i, parts=parts, more=props)

    def jsx(self) -> Node:
        start = self.i
        self.i += 1
        self.space()
        m = _JSX_NAME.match(self.s, self.i)
        name = m[0] if m else ""
        self.i = m.end() if m else self.i
        attributes: list[tuple[str, Node | None]] = []
        if self.space() == "<":  # type arguments
            depth = 0
            while self.i < len(self.s):
                depth += {"<": 1, ">": -1}.get(self.s[self.i], 0)
                self.i += 1
                if not depth:
                    break
        while True:
            c = self.space()
            if not c:
                self.fail("unterminated tag")
            if self.s.startswith("/>", self.i):
                self.i += 2
                return Node("jsx", start, self.i, name, more=attributes)
            if c == ">":
                self.i += 1
                break
            if c == "{":
                self.i += 1
                attributes += [("", p) for p in self.sequence("}")]
                self.i += 1
            elif m := _JSX_NAME.match(self.s, self.i):
                self.i = m.end()
                value = None
                if self.space() == "=":
                    self.i += 1
                    value = self.jsx_value()
                attributes.append((m[0], value))
            else:
                self.fail(f"unexpected {c!r} in a tag")
        return Node("jsx", start, self.i, name, parts=self.children(), more=attributes)

    def jsx_value(self) -> Node:
        c = self.space()
        if c and c in "\"'":
            start, end = self.i, self.s.find(c, self.i + 1)
            if end < 0:
                self.fail("unterminated attribute")
            self.i = end + 1
            return Node("string", start, self.i, _ENTITY.sub(lambda m: unescape(m[0]), self.s[start + 1 : end]))
        if c == "{":
            return self.container()
        if c == "<":
            return self.jsx()
        self.fail("no attribute value")

    def container(self) -> Node:
        start = self.i
        self.i += 1
        parts = self.sequence("}")
        self.i += 1
        return Node("paren", start, self.i, parts=parts, more=True)

    def children(self) -> list[Node]:
        out = []
        while True:
            at = min((p for p in (self.s.find("<", self.i), self.s.find("{", self.i)) if p >= 0), default=-1)
            if at < 0:
                self.i = len(self.s)
                self.fail("unterminated element")
            self.i = at
            if self.s[at] == "{":
                out.append(self.container())
            elif m := re.compile(r"<\s*/\s*[\w$.:-]*\s*>").match(self.s, at):
                self.i = m.end()
                return out
            else:
                out.append(self.jsx())

    # -- shapes --------------------------------------------------------------------------------------------------

    def shape(self, items: list[Node], start: int) -> Node:
        """The form of an expression given as operands and operators."""
        other = Node("other", start, self.i, parts=self.calls(items))
        texts = [n.text if n.kind == "op" else None for n in items]
        if any(t in ("=>", "=", "const", "let", "var", "return", ",") for t in texts):
            if texts and texts[0] == "return" and len(items) > 1 and not any(t in ("=>", "=") for t in texts):
                return Node("other", start, self.i, parts=[self.shape(items[1:], items[1].start)])
            return other
        if "?" in texts:
            q = texts.index("?")
            depth = 0
            for k in range(q + 1, len(items)):
                if texts[k] == "?":
                    depth += 1
                elif texts[k] == ":":
                    if not depth:
                        arms = [items[q + 1 : k], items[k + 1 :]]
                        if not all(arms):
                            return other
                        test = Node("other", start, items[q].start, parts=self.calls(items[:q]))
                        return Node("choice", start, self.i, parts=[test, *(self.shape(a, a[0].start) for a in arms)])
                    depth -= 1
            return other
        if any(t in ("&&", "||", "??") for t in texts):
            sides: list[list[Node]] = [[]]
            for n, t in zip(items, texts, strict=True):
                if t in ("&&", "||", "??"):
                    sides.append([])
                else:
                    sides[-1].append(n)
            return Node("logic", start, self.i, parts=[self.shape(x, x[0].start) for x in sides if x])
        if len(items) > 1 and texts[0] == "...":
            return Node("spread", start, self.i, parts=[self.shape(items[1:], items[1].start)])
        done = self.calls(items)
        if len(done) == 1:
            return done[0]
        return Node("other", start, self.i, parts=done)

    @staticmethod
    def calls(items: list[Node]) -> list[Node]:
        """Names and members followed by parentheses become calls; members and indexes become what they are of."""
        out: list[Node] = []
        k = 0
        while k < len(items):
            n = items[k]
            if n.kind == "name" and (not out or out[-1].text != "function"):
                # what is made with new is no helper call
                name, inner, j = "" if out and out[-1].kind == "op" and out[-1].text == "new" else n.text, [], k + 1
                plain = True
                while j < len(items):
                    if items[j].text in (".", "?.") and j + 1 < len(items) and items[j + 1].kind == "name":
                        name, plain, j = items[j + 1].text, False, j + 2
                    elif items[j].kind == "op" and items[j].text == "?." and j + 1 < len(items):
                        j += 1
                    elif items[j].kind == "index":
                        inner += items[j].parts
                        name, plain, j = "", False, j + 1
                    elif items[j].kind == "paren" and not items[j].more:
                        inner = [Node("call", n.start, items[j].end, name, parts=items[j].parts, more=inner)]
                        name, plain, j = "", False, j + 1
                    else:
                        break
                if plain:
                    out.append(n)
                elif len(inner) == 1 and inner[0].kind == "call" and items[j - 1].kind == "paren":
                    out.append(inner[0])
                else:
                    out.append(Node("other", n.start, items[j - 1].end, parts=inner))
                k = j
            else:
                out.append(n)
                k += 1
        return out


@dataclass
class Leaf:
    """One row: a string, quasi, key (an identifier), style or use (of an identifier) in the root-th expression, in source order.

    owner: the variable that the expression initialises, if any; a row of kind ``declared`` stands for the declaration itself. nested: the
    expression lies in another one. in_value: the leaf is a value of an object, not a key. raw: the literal as it is written.
    """

    root: int
    role: str
    owner: str | None
    nested: bool
    kind: str
    value: str
    start: int
    end: int
    in_value: bool = False
    key: str | None = None


def _number(text: str) -> str:
    plain = text.rstrip("n").replace("_", "")
    try:
        value = float(int(plain, 0)) if re.match(r"0[xXbBoO]", text) else float(plain)
    except OverflowError:
        value = math.inf
    if value == math.inf:
        return "Infinity"
    return str(int(value)) if value == int(value) else repr(value)


def class_parts(n: Node | None, in_value: bool = False) -> Iterator[tuple[str, Node, bool]]:
    """(kind, node, in_value) of the class strings, keys and identifiers of an expression."""
    if n is None:
        return
    below: list = []
    if n.kind == "string":
        yield "string", n, in_value
    elif n.kind == "template":
        yield from (("quasi", q, in_value) for q in n.more)
        below = n.parts
    elif n.kind == "paren":
        below = n.parts if len(n.parts) == 1 and n.more else []
    elif n.kind == "choice":
        below = n.parts[1:]
    elif n.kind in ("logic", "array", "spread") or n.kind == "call" and n.text in HELPER_NAMES:
        below = n.parts
    elif n.kind == "object":
        for key, computed, value, *_ in n.more:
            if key is not None and not computed:
                yield ("string" if key.kind == "string" else "key"), key, in_value
            yield from class_parts(value, True)
    elif n.kind == "name":
        yield "use", n, in_value
    for x in below:
        yield from class_parts(x, in_value)


def style_parts(n: Node | None) -> Iterator[tuple[str, Node, str | None, str, int]]:
    """(kind, node, key, value, start) of the properties of a style object, or the identifier that stands for it."""
    if n is None:
        return
    if n.kind == "paren" and len(n.parts) == 1:
        yield from style_parts(n.parts[0])
    elif n.kind == "name":
        yield "use", n, None, n.text, n.start
    elif n.kind in ("object", "block"):
        for key, computed, value, *at in n.more or []:
            if key is not None and not computed and value is not None and value.kind in ("string", "number"):
                yield "style", value, key.text, value.text if value.kind == "string" else _number(value.text), at[0]


class Collector:
    """Walks a source in source order and notes the leaves of every class and style expression, and of what variables are initialised with."""

    def __init__(self, source: str) -> None:
        self.out: list[Leaf] = []
        self.roots = 0
        reader = Reader(source)
        self.visit(reader.program(), False)
        for name, init in reader.inits:
            self.out.append(Leaf(self.roots, "class", name, False, "declared", "", init.start, init.end))
            self.note("style", init, name, False)
            self.roots -= 1
            self.note("class", init, name, False)

    def note(self, role: str, n: Node | None, owner: str | None, nested: bool) -> None:
        if role == "style":
            self.out += [Leaf(self.roots, role, owner, nested, kind, value, start, x.end, False, key) for kind, x, key, value, start in style_parts(n)]
        else:
            self.out += [Leaf(self.roots, role, owner, nested, kind, x.text, x.start, x.end, v) for kind, x, v in class_parts(n)]
        self.roots += 1

    def visit(self, n: Node | None, nested: bool) -> None:
        if n is None:
            return
        below = nested
        if n.kind == "jsx":
            for name, value in n.more:
                if name == "className":
                    self.note("class", value, None, nested)
                if name == "style":
                    self.note("style", value, None, nested)
                self.visit(value, nested or name in ("className", "style"))
        elif n.kind == "call":
            for x in n.more:
                self.visit(x, nested)
            if n.text in HELPER_NAMES:
                below = True
                for x in n.parts:
                    self.note("class", x, None, nested)
        elif n.kind == "array":
            below = True
            self.note("class", n, None, nested)
        for x in n.parts:
            self.visit(x, below)


def scan(source: str) -> list[Leaf]:
    """The leaves of a source's class and style expressions in the order they are met."""
    try:
        return Collector(source).out
    except RecursionError as e:
        raise ScanError("nested too deeply") from e


def places(source: str, leaves: list[Leaf], limit: int = 140) -> list[tuple[int, int, str]]:
    """(line, column, first ``limit`` characters of the trimmed line) of each leaf's start, 0-based."""
    starts = [0, *(m.end() for m in re.finditer("\n", source))]
    shown: dict[int, str] = {}
    out = []
    for x in leaves:
        line = bisect_right(starts, x.start) - 1
        if line not in shown:
            end = source.find("\n", starts[line])
            shown[line] = source[starts[line] : end if end >= 0 else len(source)].strip(BLANKS)[:limit]
        out.append((line, x.start - starts[line], shown[line]))
    return out
