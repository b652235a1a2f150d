from __future__ import annotations

from srcplan.catalog import samples
from srcplan.parsers import golang, rust, tsx


def _go(body: str, head: str = "") -> dict:
    return golang.parse(f"package p\n{head}\nfunc f() {{\n{body}\n}}\n")[-1]


def test_go_complexity_counts_branches_and_operators():
    assert _go("")["complexity"] == 1
    assert _go("if a && b || c { x() }")["complexity"] == 4
    assert _go("switch x {\ncase 1:\ncase 2, 3:\ndefault:\n}")["complexity"] == 4
    assert _go("select {\ncase <-a:\ndefault:\n}\nfor range y {\n}")["complexity"] == 4
    assert _go("g := func() { if a { b() } }\ng()")["complexity"] == 2
    assert _go('s := "if a && b" // if\n/* for */\nr := \'"\'\n_ = s\n_ = `for {`')["complexity"] == 1


def test_go_nesting():
    assert _go("x()")["nesting"] == 0
    assert _go("if a { x() }")["nesting"] == 1
    assert _go("for { for { if a { x() } } }")["nesting"] == 3
    assert _go("if a {\n} else if b {\n} else if c {\n} else {\n}")["nesting"] == 3  # each link of a chain is a level
    assert _go("switch x {\ncase 1:\nif a { if b { } }\n}")["nesting"] == 1  # what clauses hold doesn't count
    assert _go("f(func() { if a { } })")["nesting"] == 0
    assert _go("{ { if a { } } }")["nesting"] == 1
    assert _go("for _, x := range []struct{ n string }{{n: \"a\"}} {\nif x.n == \"\" { }\n}")["nesting"] == 2
    assert _go("if x := (T{1}); x.ok { for i := range map[string]int{\"a\": 1} { _ = i } }")["nesting"] == 2


def test_go_parameters_and_receivers():
    src = "package p\nfunc a(x, y int, z string) {}\nfunc (c *T) b(int, string) {}\nfunc (T) c() error { return nil }\nfunc d(f func(a, b int) error, m map[string]int, v ...any) {}\nfunc e()\nfunc (s Set[K]) g() {}\n"
    f = {x["name"]: x for x in golang.parse(src)}
    assert [f[n]["params"] for n in "abcdeg"] == [2, 2, 0, 3, 0, 0]
    assert [f[n]["receiver"] for n in "abc"] == ["", "(c *T)", "(T)"]
    assert (f["a"]["line"], f["a"]["end_line"], f["a"]["lines"], f["e"]["complexity"]) == (2, 2, 1, 1)


def test_go_ignored_errors():
    head = 'import (\n"fmt"\n"os"\n)\nfunc g() (int, error) { return 0, nil }\nfunc h() int { return 1 }'
    assert _go('_ = fmt.Errorf("x")', head)["ignored_errors"] == 1
    assert _go("_, _ = g()\n_ = h()", head)["ignored_errors"] == 2
    assert _go("_, err := g()\nif err != nil { return }", head)["ignored_errors"] == 1  # the value is blank, the error is bound
    assert _go("for _, x := range g() { _ = x }\n_ = err", head)["ignored_errors"] == 0
    assert _go("if _, err := os.Open(a); err != nil { }", head)["ignored_errors"] == 1
    far = _go("_ = x.Open()\n_ = x.Other()", 'import "example.com/x"')
    assert (far["ignored_errors"], far["typed"]) == (1, False)


def test_go_survives_broken_source():
    for s in ("", "func", "func (", "package p\nfunc f( {", "package p\nfunc f() { if {", '"', "`", "/*", "func f() { switch { case"):
        golang.parse(s)


def _rs(body: str) -> dict:
    return rust.parse(f"fn f() {{\n{body}\n}}\n")[0]


def test_rust_complexity():
    assert _rs("let x = 1;")["complexity"] == 1
    assert _rs("if a && b { c(); }")["complexity"] == 2  # operators add nothing
    assert _rs("match x { 1 => a(), 2 | 3 if y => { b() } _ => {} }")["complexity"] == 4  # a guard is no branch
    assert _rs("while a {} for x in y {} loop { break; }")["complexity"] == 4
    assert _rs("if let Some(Foo { a, b }) = x { y() } else if z {}")["complexity"] == 3
    assert _rs('println!("if {}", if a { 1 } else { 2 }); let s = r#"if"#; // if')["complexity"] == 1


def test_rust_nesting():
    assert _rs("")["nesting"] == 0
    assert _rs("a();")["nesting"] == 1
    assert _rs("if a { b(); }")["nesting"] == 3
    assert _rs("if a { if b { c(); } }")["nesting"] == 5
    assert _rs("let x = Foo { a: 1 };")["nesting"] == 1
    assert _rs("if a { b(); } else if c { d(); }")["nesting"] == 4


def test_rust_functions():
    src = """struct Counter { n: u32 }
impl Counter {
    pub fn new(n: u32) -> Self { Counter { n } }
    pub(crate) async fn add(&mut self, by: HashMap<u8, u8>, f: impl Fn(u8, u8) -> u8) -> u32 { self.n }
}
impl std::fmt::Display for Counter {
    fn fmt(&self, f: &mut std::fmt::Formatter<'_>) -> std::fmt::Result { Ok(()) }
}
impl Default for Counter { fn default() -> Self { Counter { n: 0 } } }
trait T { fn only(&self); fn given(&self) {} }
unsafe extern "C" fn raw(a: *const u8) {}
macro_rules! m { () => { fn hidden() {} } }
fn outer() { fn inner() {} }
"""
    f = {x["name"]: x for x in rust.parse(src)}
    assert list(f) == ["new", "add", "fmt", "default", "given", "raw", "outer", "inner"]
    assert [f[n]["receiver"] for n in ("new", "fmt", "default", "given")] == ["Counter", "Counter", "Default", ""]
    assert [f[n]["params"] for n in f] == [1, 3, 2, 0, 1, 1, 0, 0]
    assert f["add"]["is_pub"] and f["add"]["is_async"] and f["raw"]["is_unsafe"] and not f["outer"]["is_pub"]


def test_rust_survives_broken_source():
    for s in ("", "fn", "fn f(", "fn f() {", "fn f() { match x {", 'fn f() { "', "/* /*", "fn f() { if", "impl", "impl<T", "'", "fn f() { match x { a =>"):
        rust.parse(s)


def test_tsx_sample():
    m = tsx.parse(samples.TSX.replace("@N", "3"))
    panel, small = m["components"]
    assert (panel["name"], panel["kind"], panel["start_line"], panel["end_line"], panel["default_export"]) == ("Panel", "function", 4, 15, True)
    assert [h["name"] for h in panel["hooks"]] == ["useState", "useState", "useEffect"]
    assert [s["name"] for s in panel["states"]] == ["open", "n"] and len(panel["effects"]) == 1
    assert [x["element"] for x in panel["jsx"]] == ["Card", "Empty", "Row", "Row"]
    assert [p["name"] for p in panel["props"]] == ["title", "rows"] and all(p["type"] == "" for p in panel["props"])
    assert (panel["conditionals"], panel["loops"], panel["has_keydown"], panel["has_analytics"]) == (3, 1, True, False)
    assert (small["name"], small["kind"], small["has_analytics"], small["exported"]) == ("Small", "arrow", True, False)
    assert [h["name"] for h in m["hooks"]] == ["useReady"]
    assert m["imports"] == [{"source": "react", "default": "React", "names": ["useState", "useEffect"]}, {"source": "./log3", "default": "", "names": []}]


def test_tsx_components():
    names = lambda s, e=".tsx": [(c["name"], c["kind"]) for c in tsx.parse(s, e)["components"]]
    assert names("function A() { return <div/>; }") == [("A", "function")]
    assert names("const A = () => { return 1; }") == [("A", "arrow")]
    assert names("const A = () => <div/>;") == []  # no block
    assert names("const A = function () { return 1; };") == [("A", "function")]
    assert names("const A = memo(function B() { return 1; });") == [("A", "function")]
    assert names("const A = React.forwardRef<X, Y>((props, ref) => { return <a/>; });") == [("A", "arrow")]
    assert names("function lower() {} const x = function Upper() {}; class C {}") == []
    assert names("const A: React.FC<{ a: string }> = ({ a }) => { return <b>{a}</b>; };") == [("A", "arrow")]
    assert names("function Outer() { function Inner() { return 1; } return <Inner/>; }") == [("Outer", "function"), ("Inner", "function")]
    assert names("function A(): JSX.Element { return <X y={<Z/>}>a } b</X>; } function B() {}") == [("A", "function"), ("B", "function")]
    assert names("function A<T>(x: T): x is string { return a < b && c > d; }", ".ts") == [("A", "function")]


def test_tsx_survives_broken_source():
    for s in ("", "<", "function A(", "function A() {", "const A = ", "`${", "<A", "<A b={", "import", "import {", "/", "'", "export", "const [a, b] = useState("):
        tsx.parse(s)


def test_samples_parse():
    go = {f["name"]: f for f in golang.parse(samples.GO.replace("@N", "4"))}
    assert (go["Find"]["complexity"], go["Find"]["nesting"], go["Find"]["params"], go["drop4"]["ignored_errors"]) == (8, 3, 2, 3)
    rs = {f["name"]: f for f in rust.parse(samples.RUST.replace("@N", "4"))}
    assert (rs["find"]["complexity"], rs["find"]["nesting"], rs["find"]["receiver"], rs["raw4"]["params"]) == (6, 5, "Store", 2)
