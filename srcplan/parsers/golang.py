"""Facts of Go functions from tokens.

Complexity follows from keywords alone. Nesting needs statements, of which only blocks and the control statements matter: what lies in
case clauses, closures and labelled statements adds nothing. A call's result is known from signatures of the same
file and a table of the standard library as long as every name of the file can be accounted for; else from a list of telling names.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # id, key, num, str, op
    text: str
    line: int


KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_TOKEN = re.compile(
    r"""(?P<space>[ \t\r]+)|(?P<line>\n)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<str>"(?:\\.|[^"\\\n])*"?|`[^`]*`?|'(?:\\.[^']*|[^'\\])'?)"""
    r"""|(?P<num>\.?\d(?:[eEpP][+-]|[\w.])*)|(?P<id>[^\W\d]\w*)|(?P<op><<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|[-+*/%&|^]=|<<|>>|&\^|.)""",
    re.S | re.X,
)
_ENDS = frozenset("break continue fallthrough return ++ -- ) ] }".split())
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, frozenset(")]}")
CONTROL = frozenset(("for", "select", "switch"))

#: Names by which a call is taken to return an error, or not, where types are unknown.
LIKELY = frozenset("Accept Atoi Chdir Chmod Chown Create Dial Exec Listen Mkdir MkdirAll Open Parse Read Remove RemoveAll Rename Stat Write".split())
#: Functions of the standard library whose last result is an error.
STANDARD = frozenset(
    "bufio.ScanLines errors.Join errors.New errors.Unwrap exec.LookPath filepath.Abs filepath.EvalSymlinks filepath.Glob filepath.Match filepath.Rel filepath.Walk filepath.WalkDir fmt.Errorf fmt.Fprint fmt.Fprintf fmt.Fprintln fmt.Print fmt.Printf "
    "fmt.Println fmt.Fscan fmt.Fscanf fmt.Fscanln fmt.Scan fmt.Scanf fmt.Scanln fmt.Sscan fmt.Sscanf fmt.Sscanln http.Get http.Head http.ListenAndServe http.ListenAndServeTLS http.NewRequest http.NewRequestWithContext http.Post http.PostForm http.Serve "
    "io.Copy io.CopyBuffer io.CopyN io.ReadAll io.ReadAtLeast io.ReadFull io.WriteString ioutil.ReadAll ioutil.ReadDir ioutil.ReadFile ioutil.TempDir ioutil.TempFile ioutil.WriteFile json.Compact json.Indent json.Marshal json.MarshalIndent json.Unmarshal "
    "net.Dial net.DialTimeout net.Listen net.LookupHost net.ParseCIDR net.ResolveTCPAddr os.Chdir os.Chmod os.Chown os.Chtimes os.Create os.CreateTemp os.Executable os.Getwd os.Hostname os.Link os.Lstat os.Mkdir os.MkdirAll os.MkdirTemp os.Open "
    "os.OpenFile os.Pipe os.ReadDir os.ReadFile os.Readlink os.Remove os.RemoveAll os.Rename os.Setenv os.Stat os.Symlink os.Truncate os.Unsetenv os.UserCacheDir os.UserConfigDir os.UserHomeDir os.WriteFile regexp.Compile regexp.MatchString sql.Open "
    "strconv.Atoi strconv.ParseBool strconv.ParseFloat strconv.ParseInt strconv.ParseUint strconv.Unquote template.ParseFiles template.ParseGlob time.LoadLocation time.Parse time.ParseDuration time.ParseInLocation url.Parse url.ParseQuery "
    "url.ParseRequestURI url.PathUnescape url.QueryUnescape user.Current user.Lookup xml.Marshal xml.Unmarshal".split()
)
#: Methods of the standard library's types whose last result is an error.
METHODS = frozenset("Close CloseWithError Commit Decode Encode Err Exec Execute ExecuteTemplate Flush Ping Prepare Query Read ReadAt ReadByte ReadFrom ReadLine ReadRune ReadString Rollback Run Scan Seek Shutdown Start Stat Sync Truncate Unwrap Wait Write WriteAt WriteByte WriteRune WriteString WriteTo".split())
BUILTINS = frozenset(
    "any append bool byte cap clear close complex complex64 complex128 comparable copy delete error false float32 float64 imag int int8 int16 int32 int64 iota len make max min new nil panic print println real recover rune string true uint uint8 uint16 uint32 uint64 uintptr _".split()
)


def tokens(source: str) -> list[Token]:
    """Tokens with the semicolons that line ends stand for."""
    out: list[Token] = []
    line = 1

    def end_line() -> None:
        if out and (out[-1].kind in ("id", "num", "str") or out[-1].text in _ENDS):
            out.append(Token("op", ";", line))

    for m in _TOKEN.finditer(source):
        kind, text = m.lastgroup, m.group()
        if kind == "line":
            end_line()
            line += 1
        elif kind == "comment":
            if "\n" in text:
                end_line()
            line += text.count("\n")
        elif kind != "space":
            out.append(Token("key" if kind == "id" and text in KEYWORDS else kind, text, line))
            line += text.count("\n") if kind == "str" else 0
    end_line()
    return out


def close(t: list[Token], i: int) -> int:
    """Index of the bracket that closes the one at i, or the last index."""
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


def body(t: list[Token], i: int, end: int) -> int:
    """Index of the brace that opens the block of a header which begins at i; braces of literals and types in it are passed over."""
    kind = False
    while i < end:
        x = t[i]
        if x.text == "{" and x.kind == "op":
            if not kind:
                return i
            kind = t[i - 1].text in ("struct", "interface")
            i = close(t, i)
        elif x.kind == "op" and x.text in ("(", "["):
            if x.text == "[" and not (t[i - 1].kind in ("id", "str") or t[i - 1].text in (")", "]", "}")):
                kind = True
            i = close(t, i)
        elif x.kind == "key" and x.text in ("map", "struct", "interface", "chan", "func"):
            kind = True
        elif x.kind == "op" and x.text not in (".", "*", "<-"):
            kind = False
        i += 1
    return end


def nesting(t: list[Token], start: int, end: int) -> int:
    """Greatest depth of the block between its braces at start and end."""
    most = 0

    def block(i: int, stop: int, depth: int) -> None:
        nonlocal most
        most = max(most, depth)
        i += 1
        while i < stop:
            i = statement(i, stop, depth)

    def control(i: int, stop: int, depth: int) -> int:
        """A control statement at depth; the index after it."""
        nonlocal most
        most = max(most, depth)
        word = t[i].text
        at = body(t, i + 1, stop)
        if at >= stop:
            return stop
        last = close(t, at)
        if word == "for" or word == "if":
            block(at, last, depth + 1)
        else:  # what clauses hold doesn't count
            most = max(most, depth + 1)
        i = last + 1
        if word == "if" and i < stop and t[i].text == "else":
            if t[i + 1].text == "if":
                return control(i + 1, stop, depth + 1)
            if t[i + 1].text == "{":
                last = close(t, i + 1)
                block(i + 1, last, depth + 1)
                return last + 1
        return i

    def statement(i: int, stop: int, depth: int) -> int:
        x = t[i]
        if x.kind == "key" and (x.text == "if" or x.text in CONTROL):
            return control(i, stop, depth)
        if x.text == "{" and x.kind == "op":
            last = close(t, i)
            block(i, last, depth)
            return last + 1
        while i < stop and not (t[i].kind == "op" and t[i].text == ";"):
            i = close(t, i) + 1 if t[i].kind == "op" and t[i].text in _OPEN else i + 1
        return i + 1

    block(start, end, 0)
    return most


def complexity(t: list[Token]) -> int:
    return 1 + sum((x.kind == "key" and x.text in ("if", "for", "case", "default")) or (x.kind == "op" and x.text in ("&&", "||")) for x in t)


def split(t: list[Token], mark: str = ",") -> list[list[Token]]:
    """Parts of t between marks that lie in no bracket."""
    out, depth = [[]], 0
    for x in t:
        if x.kind == "op":
            depth += (x.text in _OPEN) - (x.text in _CLOSE)
            if x.text == mark and not depth:
                out.append([])
                continue
        out[-1].append(x)
    return [p for p in out if p]


def _named(part: list[Token]) -> bool:
    """Whether a parameter is a name with a type."""
    if len(part) < 2 or part[0].kind != "id" or part[1].text == ".":
        return False
    return part[1].text != "[" or part[2].text == "]" or part[2].kind == "num"


def field_groups(t: list[Token]) -> int:
    """Parameters as they are written: names that share a type are one."""
    parts = split([x for x in t if x.text != ";"])
    return sum(map(_named, parts)) if any(map(_named, parts)) else len(parts)


def type_text(t: list[Token]) -> str:
    if not t:
        return ""
    head, rest = t[0].text, t[1:]
    if head == "*":
        return "*" + type_text(rest)
    if head == "[":
        return "[]" + type_text(t[close(t, 0) + 1 :])
    if head == "map":
        e = close(t, 1)
        return f"map[{type_text(t[2:e])}]{type_text(t[e + 1 :])}"
    if head in ("interface", "func"):
        return "interface{}" if head == "interface" else "func"
    if any(x.text == "[" for x in rest):
        return "*ast.IndexListExpr" if sum(x.text == "," for x in rest) else "*ast.IndexExpr"
    return "".join(x.text for x in t)


def receiver(t: list[Token]) -> str:
    if not t:
        return ""
    named = len(t) > 1 and t[0].kind == "id" and t[1].text not in (".", "[")
    return f"({t[0].text} {type_text(t[1:])})" if named else f"({type_text(t)})"


class Function(NamedTuple):
    name: str
    receiver: str
    line: int
    end_line: int
    params: int
    errs: bool
    start: int  # token that opens the body, or -1
    end: int


def functions(t: list[Token]) -> list[Function]:
    """The functions and methods at the top of a file."""
    out, i = [], 0
    while i < len(t):
        x = t[i]
        if x.kind == "op" and x.text in _OPEN:
            i = close(t, i) + 1
            continue
        if not (x.kind == "key" and x.text == "func" and (i == 0 or t[i - 1].text in (";", "}"))):
            i += 1
            continue
        at, owner = i + 1, ""
        if at < len(t) and t[at].text == "(":
            e = close(t, at)
            owner, at = receiver([y for y in t[at + 1 : e] if y.text != ";"]), e + 1
        if at >= len(t) or t[at].kind != "id":
            i += 1
            continue
        name, at = t[at].text, at + 1
        if at < len(t) and t[at].text == "[":
            at = close(t, at) + 1
        if at >= len(t) or t[at].text != "(":
            i += 1
            continue
        e = close(t, at)
        groups, at = field_groups(t[at + 1 : e]), e + 1
        # results: up to the brace of the body or the end of the declaration
        j = at
        while j < len(t) and not (t[j].kind == "op" and (t[j].text == ";" or t[j].text == "{" and t[j - 1].text not in ("struct", "interface"))):
            j = close(t, j) + 1 if t[j].kind == "op" and t[j].text in _OPEN else j + 1
        results = t[at:j]
        if results and results[0].text == "(":
            results = split([y for y in results[1:-1] if y.text != ";"])
            results = results[-1] if results else []
        errs = bool(results) and results[-1].text == "error" and (len(results) < 2 or results[-2].kind == "id")
        if j < len(t) and t[j].text == "{":
            last = close(t, j)
            out.append(Function(name, owner, x.line, t[last].line, groups, errs, j, last))
            i = last + 1
        else:
            out.append(Function(name, owner, x.line, t[min(j, len(t)) - 1].line, groups, errs, -1, -1))
            i = j
    return out


def imports(t: list[Token]) -> dict[str, str]:
    """Local name -> path."""
    out = {}
    for i, x in enumerate(t):
        if x.kind == "key" and x.text == "import":
            part = t[i + 2 : close(t, i + 1)] if t[i + 1].text == "(" else t[i + 1 : i + 4]
            for j, y in enumerate(part):
                if y.kind == "str" and (j == 0 or part[j - 1].text == ";" or part[j - 1].kind == "id" or part[j - 1].text == "."):
                    path = y.text.strip('"`')
                    name = re.sub(r"^v\d+$", "", path.split("/")[-1]) or path.split("/")[-2]
                    out[part[j - 1].text if j and part[j - 1].kind == "id" else name] = path
    return out


def accounted(t: list[Token], known: dict[str, str], own: set[str]) -> bool:
    """Whether the file stands for itself: only standard packages, and every function it calls by a bare name is its own."""
    if any("." in path.split("/")[0] for path in known.values()):
        return False
    bound = {x.text for i, x in enumerate(t) if x.kind == "id" and i + 1 < len(t) and (t[i + 1].text in (":=", ",", "=") or t[i - 1].text in ("var", "const", "type", ",", "(", ";") and t[i + 1].text != "(")}
    return all(x.text in own or x.text in BUILTINS or x.text in bound for i, x in enumerate(t) if x.kind == "id" and i + 1 < len(t) and t[i + 1].text == "(" and (i == 0 or t[i - 1].text not in (".", "func", ")")))


def _call(e: list[Token]) -> tuple[str, str] | None:
    """(what precedes the name, name) of an expression that is a call; None for another."""
    if not e or e[-1].text != ")" or e[-1].kind != "op":
        return None
    i, last = 0, -1
    while i < len(e):
        x = e[i]
        if x.kind == "op" and x.text in _OPEN:
            last, i = i, close(e, i) + 1
            continue
        if x.kind == "op" and x.text != "." and not (x.text == "*" and i and e[0].text in ("[", "map", "func")):
            return None
        i += 1
    if last <= 0 or e[last].text != "(":
        return None
    if e[last - 1].kind != "id":
        return "?", ""
    before = e[last - 3].text if last >= 3 and e[last - 2].text == "." and e[last - 3].kind == "id" and last == 3 else "?" if last >= 2 and e[last - 2].text == "." else ""
    return before, e[last - 1].text


def ignored(t: list[Token], start: int, end: int, typed: bool, packages: dict[str, str], errs: dict[str, bool], methods: dict[str, bool]) -> int:
    """Blank names on the left of assignments times calls on the right that return an error."""

    def returns(e: list[Token]) -> bool:
        found = _call(e)
        if found is None:
            return False
        before, name = found
        if not typed:
            return name in LIKELY
        if not before:
            return errs.get(name, name == "error")
        if before in packages:
            return f"{packages[before].split('/')[-1]}.{name}" in STANDARD
        return methods.get(name, name in METHODS)

    n = 0
    for i in range(start + 1, end):
        if t[i].kind != "op" or t[i].text not in ("=", ":=") or t[i + 1].text == "range":
            continue
        j, depth = i - 1, 0
        while j > start:
            x = t[j]
            if x.kind == "op" and x.text in _CLOSE:
                depth += 1
            elif x.kind == "op" and x.text in _OPEN:
                if not depth:
                    break
                depth -= 1
            elif not depth and (x.kind == "key" or x.kind == "op" and x.text in (";", ":")):
                break
            j -= 1
        if t[j].text in ("var", "const", "type") or t[j].text == "(" and t[j - 1].text in ("var", "const"):
            continue
        blanks = sum(len(p) == 1 and p[0].text == "_" for p in split(t[j + 1 : i]))
        if not blanks:
            continue
        k, right = i + 1, i + 1
        while k < end and not (t[k].kind == "op" and t[k].text in (";", ":", "}")):
            if t[k].text == "{" and t[k].kind == "op":
                if t[j].text in ("if", "switch", "for") and body(t, right, end) == k:
                    break
            k = close(t, k) + 1 if t[k].kind == "op" and t[k].text in _OPEN else k + 1
        n += blanks * sum(map(returns, split(t[right:k])))
    return n


def parse(source: str) -> list[dict]:
    """A row for each function: name, receiver, line, end_line, lines, complexity, nesting, params, ignored_errors, typed."""
    t = tokens(source)
    t += [Token("end", "", t[-1].line if t else 1)] * 4  # so that looking ahead is safe
    found, packages = functions(t), imports(t)
    errs, methods = {f.name: f.errs for f in found if not f.receiver}, {f.name: f.errs for f in found if f.receiver}
    typed = accounted(t, packages, set(errs) | {t[i + 1].text for i, x in enumerate(t[:-1]) if x.text == "type"})
    out = []
    for f in found:
        own = t[f.start : f.end + 1] if f.start >= 0 else []
        n = ignored(t, f.start, f.end, typed, packages, errs, methods) if own else 0
        out.append(
            {
                "name": f.name,
                "receiver": f.receiver,
                "line": f.line,
                "end_line": f.end_line,
                "lines": f.end_line - f.line + 1,
                "complexity": complexity(own),
                "nesting": nesting(t, f.start, f.end) if own else 0,
                "params": f.params,
                "ignored_errors": n,
                "typed": typed or not n,
            }
        )
    return out
