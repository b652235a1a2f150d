"""Facts of Rust functions from tokens.

Every function with a body counts, wherever it is, but for those inside macro calls. Nesting counts blocks and the expressions
that own them, each for itself, so that an `if` inside a function is at 1 and what its block holds at 3. Boolean operators add nothing to complexity.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # id, num, str, life, comment, op
    text: str
    line: int


_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<comment>//[^\n]*)|(?P<block>/\*)|(?P<raw>b?c?r(?P<h>\#*)".*?"(?P=h))|(?P<str>[bc]?"(?:\\.|[^"\\])*"?)|(?P<life>'[^\W\d]\w*(?!'))|(?P<char>b?'(?:\\.[^']*|[^'\\])'?)"""
    r"""|(?P<num>\d(?:[eE][+-]|\w|\.(?=\d))*)|(?P<id>(?:r\#)?[^\W\d]\w*)|(?P<op>=>|->|::|\.\.=|\.\.\.|\.\.|&&|\|\||==|!=|<=|>=|<<=|>>=|[-+*/%&|^]=|.)""",
    re.S | re.X,
)
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, frozenset(")]}")
_ITEMS = frozenset("enum extern impl mod struct trait union".split())
#: Words after which a brace opens a block, not a literal.
_LEADS = frozenset("async const else gen in loop move return try unsafe".split())


def tokens(source: str) -> list[Token]:
    out, at, line = [], 0, 1
    while at < len(source):
        m = _TOKEN.match(source, at)
        kind, text = m.lastgroup, m.group()
        if kind == "h" or m.group("raw") is not None:
            kind = "str"
        if kind == "block":  # comments nest
            depth, end = 0, at
            for n in re.finditer(r"/\*|\*/", source[at:]):
                depth += 1 if n.group() == "/*" else -1
                end = at + n.end()
                if not depth:
                    break
            end = end if not depth else len(source)
            kind, text = "comment", source[at:end]
        if kind != "space":
            out.append(Token({"char": "str"}.get(kind, kind), text, line))
        line += text.count("\n")
        at += len(text)
    return out


def close(t: list[Token], i: int) -> int:
    depth = 0
    for j in range(i, len(t)):
        if t[j].kind == "op":
            if t[j].text in _OPEN:
                depth += 1
            elif t[j].text in _CLOSE:
                depth -= 1
                if not depth:
                    return j
    return len(t) - 1


def _macro_end(t: list[Token], i: int) -> int:
    """Last token of the macro call that begins at i, or -1."""
    if t[i].kind != "id" or i + 2 >= len(t) or t[i + 1].text != "!" or t[i + 1].kind != "op":
        return -1
    at = i + 2
    if t[i].text == "macro_rules" and t[at].kind == "id":
        at += 1
    return close(t, at) if at < len(t) and t[at].kind == "op" and t[at].text in _OPEN else -1


class _Body:
    """Complexity and nesting of a block."""

    def __init__(self, t: list[Token], start: int, end: int) -> None:
        self.t, self.complexity, self.most = t, 1, 0
        self.inner(start + 1, end, 1)

    def mark(self, depth: int) -> None:
        self.most = max(self.most, depth)

    def inner(self, i: int, end: int, depth: int) -> None:
        while i < end:
            i = self.step(i, end, depth)

    def block(self, i: int, depth: int) -> int:
        """The block at depth whose brace is at i; the index after it."""
        last = close(self.t, i)
        self.mark(depth)
        self.inner(i + 1, last, depth + 1)
        return last + 1

    def header(self, i: int, end: int, depth: int) -> int:
        """A condition or iterator; the index of the brace that follows it."""
        t = self.t
        while i < end and not (t[i].kind == "op" and t[i].text == "{"):
            if t[i].text == "let":  # a pattern may hold braces
                while i < end and not (t[i].kind == "op" and t[i].text == "="):
                    i = close(t, i) + 1 if t[i].kind == "op" and t[i].text in _OPEN else i + 1
                self.mark(depth)
                continue
            if t[i].kind == "id" and t[i].text in ("async", "unsafe", "move") and t[i + 1].text == "{":
                i = self.block(i + 1, depth)
                continue
            i = self.step(i, end, depth)
        return i

    def step(self, i: int, end: int, depth: int) -> int:
        t = self.t
        x = t[i]
        if x.kind == "op":
            if x.text in ("(", "["):
                self.mark(depth)
                last = close(t, i)
                self.inner(i + 1, last, depth)
                return last + 1
            if x.text == "#" and i + 1 < end and t[i + 1].text in ("[", "!"):
                self.mark(depth)
                return close(t, i + 1 + (t[i + 1].text == "!")) + 1
            if x.text == "{":
                before = t[i - 1]
                if before.kind == "id" and before.text not in _LEADS or before.text == ">" and before.kind == "op":  # a literal
                    last = close(t, i)
                    self.inner(i + 1, last, depth)
                    return last + 1
                return self.block(i, depth)
            return i + 1
        self.mark(depth)
        if x.kind != "id":
            return i + 1
        if (last := _macro_end(t, i)) >= 0:
            return last + 1
        if x.text == "if":
            return self.branch(i, end, depth)
        if x.text == "match":
            return self.match(i, end, depth)
        if x.text == "while" or x.text == "loop" or x.text == "for" and t[i + 1].text != "<":
            self.complexity += 1
            if x.text == "for":
                i = self.pattern(i + 1, end)
            at = self.header(i + 1, end, depth + 1)
            return self.block(at, depth + 1) if at < end else end
        if x.text == "fn" and i + 1 < end and t[i + 1].kind == "id":
            at = i + 2
            while at < end and not (t[at].kind == "op" and t[at].text in ("{", ";")):
                at = close(t, at) + 1 if t[at].kind == "op" and t[at].text in ("(", "[") else at + 1
            return self.block(at, depth) if at < end and t[at].text == "{" else at + 1
        if x.text in _ITEMS and t[i + 1].kind in ("id", "op") and t[i - 1].text in (";", "{", "}", "pub", "unsafe", "]", ")"):
            at = i + 1
            while at < end and not (t[at].kind == "op" and t[at].text in ("{", ";")):
                at += 1
            if at < end and t[at].text == "{":
                last = close(t, at)
                self.inner(at + 1, last, depth)
                return last + 1
            return at + 1
        return i + 1

    def pattern(self, i: int, end: int) -> int:
        while i < end and t_word(self.t[i]) != "in":
            i = close(self.t, i) + 1 if self.t[i].kind == "op" and self.t[i].text in _OPEN else i + 1
        return i

    def branch(self, i: int, end: int, depth: int) -> int:
        t = self.t
        self.complexity += 1
        self.mark(depth)
        at = self.header(i + 1, end, depth + 1)
        if at >= end:
            return end
        i = self.block(at, depth + 1)
        if i < end and t_word(t[i]) == "else":
            self.mark(depth + 1)
            if i + 1 < end and t_word(t[i + 1]) == "if":
                return self.branch(i + 1, end, depth + 1)
            if i + 1 < end and t[i + 1].text == "{":
                return self.block(i + 1, depth + 1)
        return i

    def match(self, i: int, end: int, depth: int) -> int:
        t = self.t
        at = self.header(i + 1, end, depth + 1)
        if at >= end:
            return end
        last = close(t, at)
        self.mark(depth + 1)
        i = at + 1
        while i < last:
            if t[i].kind == "comment":
                i += 1
                continue
            while i < last and not (t[i].kind == "op" and t[i].text == "=>"):  # pattern and guard
                i = close(t, i) + 1 if t[i].kind == "op" and t[i].text in _OPEN else i + 1
            if i >= last:
                break
            self.complexity += 1
            i += 1
            if i < last and t[i].kind == "op" and t[i].text == "{":
                i = self.block(i, depth + 1)
                if i < last and (t[i].text == "," or t[i].kind == "id" or t[i].text in ("_", "|", "(", "[", "#", "&") or t[i].kind in ("str", "num", "comment")):
                    i += t[i].text == ","
                    continue
            while i < last and not (t[i].kind == "op" and t[i].text == ","):
                i = self.step(i, last, depth + 1)
            i += 1
        return last + 1


def t_word(x: Token) -> str:
    return x.text if x.kind == "id" else ""


def _params(t: list[Token]) -> int:
    n, depth, angle, some = 0, 0, 0, False
    for k, x in enumerate(t):
        if x.kind == "comment":
            continue
        if x.kind == "op":
            depth += (x.text in _OPEN) - (x.text in _CLOSE)
            angle += (x.text == "<") - (x.text == ">" and t[k - 1].text != "-")
            if x.text == "," and not depth and angle <= 0:
                n += some
                some = False
                continue
        some = True
    return n + some


def _receivers(t: list[Token]) -> dict[str, str]:
    """Function name -> the first type named in its impl header; the last impl wins."""
    out = {}
    for i, x in enumerate(t):
        if t_word(x) != "impl" or i and (t[i - 1].kind == "op" and t[i - 1].text not in (";", "}", "{", "]") or t_word(t[i - 1]) in ("as",)):
            continue
        j, name = i + 1, ""
        if t[j].text == "<":
            depth = 0
            while j < len(t):
                depth += (t[j].text == "<") - (t[j].text == ">" and t[j - 1].text != "-")
                j += 1
                if not depth:
                    break
        while j < len(t) and t[j].text != "{":
            if not name and t[j].kind == "id" and t[j].text not in ("for", "dyn", "mut", "const", "where"):
                path = j
                while path + 2 < len(t) and t[path + 1].text == "::":
                    path += 2
                if path == j:
                    name = t[j].text
                else:  # a qualified name is none of the types looked for
                    j = path
                    if j + 1 < len(t) and t[j + 1].text == "<":
                        depth = 0
                        while j + 1 < len(t):
                            j += 1
                            depth += (t[j].text == "<") - (t[j].text == ">")
                            if not depth:
                                break
            j += 1
        if j >= len(t):
            break
        last, k = close(t, j), j + 1
        while k < last:
            if t_word(t[k]) == "fn" and t[k + 1].kind == "id":
                out[t[k + 1].text] = name
            k = close(t, k) + 1 if t[k].kind == "op" and t[k].text in _OPEN else k + 1
    return out


def parse(source: str) -> list[dict]:
    t = tokens(source)
    t += [Token("end", "", t[-1].line if t else 1)] * 4  # so that looking ahead is safe
    code = [x for x in t if x.kind != "comment"]
    owners = _receivers(code)
    out, i = [], 0
    while i < len(t):
        if (last := _macro_end(t, i)) >= 0:
            i = last + 1
            continue
        if t_word(t[i]) != "fn" or i + 1 >= len(t) or t[i + 1].kind != "id":
            i += 1
            continue
        first, flags = i, set()
        while first and (t_word(t[first - 1]) in ("async", "const", "default", "extern", "pub", "unsafe") or t[first - 1].kind == "str" and t_word(t[first - 2]) == "extern" or t[first - 1].text == ")" and _visible(t, first - 1)):
            first = _visible(t, first - 1) or first - 1
            flags.add(t_word(t[first]))
        name, at, depth = t[i + 1].text, i + 2, 0
        while at < len(t) and (t[at].text != "(" or depth) and not (t[at].kind == "op" and t[at].text in ("{", ";")):
            depth += (t[at].text == "<") - (t[at].text == ">" and t[at - 1].text != "-")
            at += 1
        if at >= len(t) or t[at].text != "(":
            i += 1
            continue
        last = close(t, at)
        n = _params(t[at + 1 : last])
        at = last + 1
        while at < len(t) and not (t[at].kind == "op" and t[at].text in ("{", ";")):
            at = close(t, at) + 1 if t[at].kind == "op" and t[at].text in ("(", "[") else at + 1
        if at < len(t) and t[at].text == "{":
            last = close(t, at)
            b = _Body(t, at, last)
            out.append(
                {
                    "name": name,
                    "receiver": owners.get(name, ""),
                    "line": t[first].line,
                    "end_line": t[last].line,
                    "lines": t[last].line - t[first].line + 1,
                    "complexity": b.complexity,
                    "nesting": b.most,
                    "params": n,
                    "ignored_errors": 0,
                    "typed": True,
                    "is_pub": "pub" in flags,
                    "is_async": "async" in flags,
                    "is_unsafe": "unsafe" in flags,
                }
            )
            i = at + 1  # functions inside it follow
        else:
            i = at
    return out


def _visible(t: list[Token], i: int) -> int:
    """Index of `pub` if the bracket that closes at i restricts it, else 0."""
    if t[i].text != ")":
        return 0
    while i and t[i].text != "(":
        i -= 1
    return i - 1 if i and t_word(t[i - 1]) == "pub" else 0
