"""Facts of TypeScript and JavaScript modules from tokens: imports, components, hooks, state, elements, handlers, props.

One scanner follows code, templates, tags and their text, so that braces and names in strings, comments and JSX text do not count. A `<`
begins a tag where an operand is expected, in files that may hold JSX. A component is a capitalised function declaration, or a
constant whose value is an arrow function with a block, a function expression, or one of these in memo or forwardRef.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # id, num, str, tmpl, regex, op, tag (opened and closed), self (closed at once)
    text: str
    line: int
    start: int
    end: int


_WORD = re.compile(r"[\w$#@]+")
_NUMBER = re.compile(r"\.?\d[\w.]*")
_STRING = re.compile(r"\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?", re.S)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_OP = re.compile(r"=>|\?\.(?!\d)|\?\?=?|\.\.\.|===?|!==?|&&=?|\|\|=?|\*\*|\+\+|--|[-+*/%&|^]=|.", re.S)
_TAG = re.compile(r"<([A-Za-z_$][\w$.:-]*)?")
_GENERIC = re.compile(r"<\s*(?:const\s+)?[\w$]+\s*(?:,|\bextends\b|=[^>=])")
#: Words after which an operand follows.
_BEFORE = frozenset("return case default typeof instanceof in of new delete void await yield throw else do extends".split())
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, frozenset(")]}")


def tokens(source: str, jsx: bool = True) -> list[Token]:
    out: list[Token] = []
    stack: list[list] = [["code", 0]]  # code: braces open; template; tag: index of its token; text
    i, line, n = 0, 1, len(source)

    def add(kind: str, end: int) -> None:
        nonlocal i, line
        out.append(Token(kind, source[i:end], line, i, end))
        line += source.count("\n", i, end)
        i = end

    def skip(end: int) -> None:
        nonlocal i, line
        line += source.count("\n", i, end)
        i = end

    def operand() -> bool:
        """Whether an operand is expected here."""
        if not out:
            return True
        x = out[-1]
        if x.kind == "op":
            return x.text not in (")", "]", "}") or x.text == "}"
        return x.kind == "id" and x.text in _BEFORE

    while i < n:
        mode, c = stack[-1], source[i]
        if mode[0] == "template":
            end = i
            while end < n and source[end] != "`" and not source.startswith("${", end):
                end += 2 if source[end] == "\\" else 1
            end = min(end, n)
            if end > i:
                add("tmpl", end)
            elif c == "`":
                add("tmpl", i + 1)
                stack.pop()
            else:
                add("op", i + 2)
                stack.append(["code", 0])
            continue
        if mode[0] == "text":
            if c == "{":
                add("op", i + 1)
                stack.append(["code", 0])
            elif source.startswith("</", i):
                end = source.find(">", i)
                skip(n if end < 0 else end + 1)
                stack.pop()
            elif c == "<":
                m = _TAG.match(source, i)
                out.append(Token("tag", m.group(1) or "", line, i, m.end()))
                stack.append(["tag", len(out) - 1])
                skip(m.end())
            else:
                m = re.compile(r"[^<{]+").match(source, i)
                skip(m.end())
            continue
        if c.isspace():
            skip(i + 1)
            continue
        if source.startswith("//", i) and mode[0] == "code":
            end = source.find("\n", i)
            skip(n if end < 0 else end)
            continue
        if source.startswith("/*", i):
            end = source.find("*/", i + 2)
            skip(n if end < 0 else end + 2)
            continue
        if mode[0] == "tag":
            if source.startswith("/>", i):
                t = out[mode[1]]
                out[mode[1]] = t._replace(kind="self")
                stack.pop()
                skip(i + 2)
                out.append(Token("num", "", line, i, i))  # the element is an operand
            elif c == ">":
                stack[-1] = ["text"]
                skip(i + 1)
            elif c == "{":
                add("op", i + 1)
                stack.append(["code", 0])
            elif c in "\"'":
                end = source.find(c, i + 1)
                skip(n if end < 0 else end + 1)
            elif c == "<":  # type arguments
                depth, end = 0, i
                while end < n:
                    depth += (source[end] == "<") - (source[end] == ">")
                    end += 1
                    if not depth:
                        break
                skip(end)
            else:
                m = re.compile(r"[^\s\"'{}<>/]+|.", re.S).match(source, i)
                skip(m.end())
            continue
        if c in "\"'":
            add("str", _STRING.match(source, i).end())
        elif c == "`":
            add("tmpl", i + 1)
            stack.append(["template"])
        elif c == "<" and jsx and operand() and i + 1 < n and (source[i + 1].isalpha() or source[i + 1] in "_$>") and not _GENERIC.match(source, i):
            m = _TAG.match(source, i)
            out.append(Token("tag", m.group(1) or "", line, i, m.end()))
            stack.append(["tag", len(out) - 1])
            skip(m.end())
        elif c == "/" and operand() and (m := _REGEX.match(source, i)):
            add("regex", m.end())
        elif c.isdigit() or c == "." and i + 1 < n and source[i + 1].isdigit():
            add("num", _NUMBER.match(source, i).end())
        elif m := _WORD.match(source, i):
            add("id", m.end())
        elif c == "{":
            mode[1] += 1
            add("op", i + 1)
        elif c == "}":
            add("op", i + 1)
            if mode[1]:
                mode[1] -= 1
            elif len(stack) > 1:
                stack.pop()
        else:
            add("op", _OP.match(source, i).end())
    return out


def close(t: list[Token], i: int) -> int:
    depth = 0
    for j in range(i, len(t)):
        if t[j].kind == "op":
            if t[j].text in _OPEN or t[j].text == "${":
                depth += 1
            elif t[j].text in _CLOSE:
                depth -= 1
                if not depth:
                    return j
    return len(t) - 1


def _angles(t: list[Token], i: int) -> int:
    """Index after the type arguments that begin at i, or i if these are none."""
    depth, j = 0, i
    while j < len(t):
        x = t[j]
        if x.kind == "op":
            if x.text == "<":
                depth += 1
            elif x.text == ">":
                depth -= 1
                if not depth:
                    return j + 1
            elif x.text in _OPEN:
                j = close(t, j)
            elif x.text in (";", ")", "}", "&&", "||"):
                return i
        j += 1
    return i


def _op(t: list[Token], i: int, *texts: str) -> bool:
    return 0 <= i < len(t) and t[i].kind == "op" and t[i].text in texts


def _id(t: list[Token], i: int, *texts: str) -> bool:
    return 0 <= i < len(t) and t[i].kind == "id" and (not texts or t[i].text in texts)


def _call(t: list[Token], i: int) -> int:
    """Index of the bracket of the arguments if the name at i is called, else -1."""
    if _op(t, i + 1, "("):
        return i + 1
    if _op(t, i + 1, "<") and _op(t, j := _angles(t, i + 1), "(") and j > i + 1:
        return j
    return -1


def _after_params(t: list[Token], i: int) -> int:
    """Index of what follows an optional type after parameters: a brace or an arrow."""
    if not _op(t, i, ":"):
        return i
    i += 1
    while i < len(t):
        if _op(t, i, "=>", ";"):
            return i
        if _op(t, i, "{"):
            if not (_op(t, i - 1, ":", "|", "&", "<", ",") or _id(t, i - 1, "is", "keyof")):
                return i
            i = close(t, i)
        elif _op(t, i, "(", "["):
            i = close(t, i)
            if _op(t, i + 1, "=>") and _op(t, i + 2, "{") is False and not _id(t, i + 2):
                return i + 1
        i += 1
    return i


class Match(NamedTuple):
    name: str
    params: int
    body: int
    kind: str


def _function(t: list[Token], i: int) -> tuple[int, int] | None:
    """(bracket of the parameters, brace of the body) of the function expression or arrow function at i."""
    if _id(t, i, "async"):
        i += 1
    if _id(t, i, "function"):
        i += 1
        if _op(t, i, "*"):
            return None
        i += _id(t, i)
    if _op(t, i, "<"):
        i = _angles(t, i)
    if not _op(t, i, "("):
        return None
    at = _after_params(t, close(t, i) + 1)
    at += _op(t, at, "=>")
    return (i, at) if _op(t, at, "{") else None


def components(t: list[Token]) -> list[Match]:
    """In the order: declarations, arrow functions, function expressions, wrapped ones."""
    by_kind: list[list[Match]] = [[], [], [], []]
    for i, x in enumerate(t):
        if x.kind != "id":
            continue
        if x.text == "function" and _id(t, i + 1) and t[i + 1].text[0].isascii() and t[i + 1].text[0].isupper():
            before = i - 1 - _id(t, i - 1, "async")
            if before >= 0 and (t[before].kind == "op" and t[before].text not in (";", "}", "{", ")") or _id(t, before, "return", "new", "typeof", "await")):
                continue
            if found := _function(t, i):
                by_kind[0].append(Match(t[i + 1].text, *found, "function"))
        elif x.text in ("const", "let") and _id(t, i + 1) and t[i + 1].text[0].isascii() and t[i + 1].text[0].isupper():
            at = i + 2
            if _op(t, at, ":"):
                at += 1
                while at < len(t) and not _op(t, at, "=", ";"):
                    at = _angles(t, at) if _op(t, at, "<") and _angles(t, at) > at else close(t, at) + 1 if t[at].kind == "op" and t[at].text in _OPEN else at + 1
            if not _op(t, at, "="):
                continue
            at += 1
            first = at + _id(t, at, "async")
            if _id(t, first, "function"):
                if found := _function(t, at):
                    by_kind[2].append(Match(t[i + 1].text, *found, "function"))
            elif _op(t, first, "(", "<"):
                if (found := _function(t, at)) and _op(t, found[1] - 1, "=>"):
                    by_kind[1].append(Match(t[i + 1].text, *found, "arrow"))
            else:
                called = at + 2 if _id(t, at, "React") and _op(t, at + 1, ".") else at
                if _id(t, called, "memo", "forwardRef") and (bracket := _call(t, called)) > 0:
                    j, last = bracket + 1, close(t, bracket)
                    while j < last:
                        if found := _function(t, j):
                            kind = "function" if _id(t, j, "function") or _id(t, j + 1, "function") else "arrow"
                            if kind == "function" or _op(t, found[1] - 1, "=>"):
                                by_kind[3].append(Match(t[i + 1].text, *found, kind))
                                break
                        while j < last and not _op(t, j, ","):
                            j = close(t, j) + 1 if t[j].kind == "op" and t[j].text in _OPEN else j + 1
                        j += 1
    return [m for own in by_kind for m in own]


def hooks(t: list[Token], source: str, start: int = 0, end: int | None = None) -> list[dict]:
    out = []
    for i in range(start, len(t) if end is None else end):
        if t[i].kind == "id" and t[i].text.startswith("use") and not _op(t, i - 1, ".", "?.") and not _id(t, i - 1, "function", "new") and (b := _call(t, i)) > 0:
            last = close(t, b)
            if _op(t, last + 1, "{") and not _op(t, i - 1, "=", "(", ",", "=>", "!", "&&", "||", "?", ":", "{", "}", ";", ")", "]"):
                continue  # a method's head
            args = source[t[b].end : t[last].start].strip()
            out.append({"name": t[i].text, "line": t[i].line, "args": [args] if last > b + 1 and args else []})
    return out


def props(t: list[Token], i: int) -> list[dict]:
    """The names that the first level of destructured parameters binds; types inside the pattern do not exist in this language."""
    out, last, j = [], close(t, i), i + 1
    while j < last:
        if _op(t, j, "{"):
            stop = close(t, j)
            optional = _op(t, stop + 1, "?")
            k = j + 1
            while k < stop:
                item = k
                while k < stop and not _op(t, k, ","):
                    k = close(t, k) + 1 if t[k].kind == "op" and t[k].text in _OPEN else k + 1
                if _id(t, item):
                    if item + 1 == k:
                        out.append({"name": t[item].text, "type": "", "required": not optional, "line": t[item].line})
                    elif _op(t, item + 1, ":") and _id(t, item + 2) and item + 3 == k:
                        out.append({"name": t[item + 2].text, "type": "", "required": not optional, "line": t[item].line})
                k += 1
            j = stop + 1
        while j < last and not _op(t, j, ","):
            j = _angles(t, j) if _op(t, j, "<") and _angles(t, j) > j else close(t, j) + 1 if t[j].kind == "op" and t[j].text in _OPEN else j + 1
        j += 1
    return out


def _between(t: list[Token], source: str, m: Match, typed: bool) -> dict:
    a, b = m.body, close(t, m.body)
    part = range(a + 1, b)
    states, handlers, conditionals, loops = [], [], 0, 0
    for i in part:
        x = t[i]
        if x.kind == "op":
            if x.text == "?" and not _op(t, i + 1, ":", ")", ",", ";", "=", "]", "}"):
                conditionals += 1
            continue
        if x.kind != "id":
            continue
        member = _op(t, i - 1, ".", "?.")
        if not member and not _op(t, i + 1, ":"):
            conditionals += x.text == "if"
            loops += x.text in ("for", "while")
        if x.text in ("filter", "forEach", "map", "reduce") and not _id(t, i - 1, "function") and _call(t, i) > 0:
            loops += 1
        if x.text in ("const", "let", "var"):
            if _op(t, i + 1, "[") and _id(t, i + 2) and _op(t, i + 3, ",") and _id(t, i + 4):
                e = close(t, i + 1)
                if _op(t, e + 1, "=") and _id(t, e + 2, "useState") and (c := _call(t, e + 2)) > 0 and close(t, c) >= c:
                    states.append({"name": t[i + 2].text, "line": t[i + 2].line, "has_updater": True})
            elif _id(t, i + 1) and re.match(r"handle|on", t[i + 1].text) or _id(t, i + 1) and t[i + 1].text.endswith("Handler"):
                handlers.append({"name": t[i + 1].text, "line": t[i + 1].line})
    named = [x for x in (t[i] for i in part) if x.kind in ("tag", "self") and re.fullmatch(r"[^a-z.:-][^.:-]*", x.text)]
    elements = [{"element": x.text, "line": x.line} for kind in ("tag", "self") for x in named if x.kind == kind]
    own = hooks(t, source, a + 1, b)
    low = source[t[a].start : t[b].end].lower()
    return {
        "name": m.name,
        "kind": m.kind,
        "start_line": t[a].line,
        "end_line": t[b].line,
        "lines": t[b].line - t[a].line + 1,
        "hooks": own,
        "jsx": elements,
        "props": props(t, m.params) if typed else [],
        "states": states,
        "effects": [{"name": h["name"], "line": h["line"]} for h in own if h["name"] == "useEffect"],
        "handlers": handlers,
        "conditionals": conditionals,
        "loops": loops,
        "has_keydown": re.search("onkeydown|usekeydown|keyboard|keydown", low) is not None,
        "has_analytics": re.search("amplitude|analytics|gtag|mixpanel|posthog|track", low) is not None,
    }


def imports(t: list[Token]) -> list[dict]:
    """One entry a source: those with names first, then those with a default, then whole modules."""
    named, default, whole = [], [], []
    i = 0
    while i < len(t):
        if not _id(t, i, "import") or _op(t, i - 1, ".") or _op(t, i + 1, "(", ".") or (i + 1 < len(t) and t[i + 1].kind == "str"):
            i += 1
            continue
        j = i + 1
        while j < len(t) and not _id(t, j, "from") and not _op(t, j, ";"):
            j = close(t, j) + 1 if _op(t, j, "{") else j + 1
        i += 1
        if not _id(t, j, "from") or j + 1 >= len(t) or t[j + 1].kind != "str":
            continue
        source = t[j + 1].text[1:-1]
        k = i + (_id(t, i, "type") and not _id(t, i + 1, "from") and not _op(t, i + 1, ","))
        if _id(t, k):
            default.append((source, t[k].text))
        for b in range(k, j):
            if _op(t, b, "*"):
                whole.append((source, ""))
            if _op(t, b, "{"):
                c = b + 1
                while c < close(t, b):
                    c += _id(t, c, "type") and _id(t, c + 1) and not _id(t, c + 1, "as")
                    if _id(t, c):
                        named.append((source, t[c].text))
                    while c < close(t, b) and not _op(t, c, ","):
                        c += 1
                    c += 1
        i = j
    out: dict[str, dict] = {}
    for own, key in ((named, "names"), (default, "default"), (whole, "")):
        for source, name in own:
            if not source:
                continue
            x = out.setdefault(source, {"source": source, "default": "", "names": []})
            if key == "names" and name not in x["names"]:
                x["names"].append(name)
            elif key == "default" and not x["default"]:
                x["default"] = name
    return list(out.values())


def exported(t: list[Token]) -> dict[str, bool]:
    """Name of each exported declaration that bears one -> whether it is the default."""
    out: dict[str, bool] = {}
    for i in range(len(t)):
        if not _id(t, i, "export") or _op(t, i - 1, "."):
            continue
        j = i + 1
        default = _id(t, j, "default")
        j += default
        while _id(t, j, "abstract", "async", "declare"):
            j += 1
        if _id(t, j, "class", "enum", "function", "interface", "namespace", "type"):
            j += 1 + _op(t, j + 1, "*")
            if _id(t, j):
                out[t[j].text] = out.get(t[j].text, False) or default
    return out


def parse(source: str, extension: str = ".tsx") -> dict:
    """imports, components and the hooks that are called outside any component."""
    t = tokens(source, extension != ".ts")
    shown = exported(t)
    found = []
    for m in components(t):
        c = _between(t, source, m, extension in (".ts", ".tsx"))
        found.append(c | {"exported": m.name in shown, "default_export": shown.get(m.name, False)})
    inside = {k for c in found for k in range(c["start_line"], c["end_line"] + 1)}
    top, seen = [], set()
    for h in hooks(t, source):
        if h["line"] not in inside and (h["name"], h["line"]) not in seen:
            seen.add((h["name"], h["line"]))
            top.append(h)
    return {"imports": imports(t), "components": found, "hooks": top}
