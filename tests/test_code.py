from __future__ import annotations

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from srcplan.catalog import samples
from srcplan.functions import paths, text
from srcplan.operators import graph, pack, parse, readiness, rules, sarif, summary
from srcplan.sinks import render
from srcplan.sources import files as S


def _col(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_text_functions(spark):
    assert _col(spark, ["", "ab", "abc", "äöü", None], text.estimate_tokens) == [0, 0, 1, 2, None]
    assert _col(spark, ["Hello World", "a--b__c  d", "***", "x" * 50, "Trail- "], text.slug) == ["hello-world", "a-b-c-d", "target", "x" * 40, "trail"]
    assert _col(spark, ["/a/b/c.go", "/c.go", "a/b.go"], paths.redact_path) == ["<redacted>/b/c.go", "<redacted>/c.go", "a/b.go"]
    assert _col(spark, ["private/my-secret.go", "a/b"], paths.public_path) == ["synthetic/my-synthetic.go", "a/b"]
    assert _col(spark, ["/a", "C:\\x", "\\\\h\\s", "a/b", "c:d"], paths.is_absolute) == [True, True, True, False, False]
    secret = "k" * 24
    got = _col(spark, [f"sk-{secret}", f"sk-ant-{secret}", f"Bearer {secret}", f"api_key={secret}", "Password: hunter2hunter2", "mail a.b@c.org now"], text.redact)
    assert got == ["sk-<redacted>", "sk-ant-<redacted>", "Bearer <redacted>", "API_KEY=<redacted>", "Password=<redacted>", "mail <email-redacted> now"]


def _sample(spark, lang, path, body):
    return spark.createDataFrame([(lang, path, body.replace("@N", "4"))], "lang string, path string, content string")


def test_rules_over_samples(spark):
    f = parse.functions(_sample(spark, "go", "src/f4.go", samples.GO).unionByName(_sample(spark, "rust", "src/f4.rs", samples.RUST)))
    low = {"long-function": 5, "high-complexity": 3, "deep-nesting": 1, "too-many-params": 1}
    got = {(r["code"], r["symbol"]): (r["severity"], r["message"]) for r in rules.function_findings(f, low).collect()}
    assert got["go.high-complexity", "(s *Store).Find"] == ("high", "Function (s *Store).Find has cyclomatic complexity 8 (limit: 3)")
    assert got["go.ignored-error", "drop4"][1] == "Function drop4 ignores 3 error(s) with _"
    assert got["rust.deep-nesting", "Store::find"][0] == "high" and ("rust.ignored-error", "raw4") not in got
    c = parse.components(parse.modules(_sample(spark, "ts", "src/f4.tsx", samples.TSX)))
    got = {r["code"] for r in rules.component_findings(c, {"too-many-hooks": 2, "repeated-jsx": 2}).collect()}
    assert got == {"react.too-many-hooks", "react.repeated-jsx", "react.missing-prop-types"}
    assert rules.function_findings(f, ignored_errors="off").filter("code like '%ignored%'").count() == 0


@pytest.mark.parametrize("v, level", [(11, "low"), (15, "low"), (16, "medium"), (20, "medium"), (21, "high")])
def test_escalation(spark, v, level):
    assert spark.range(1).select(rules.by_size(F.lit(v), F.lit(10))).first()[0] == level


def test_scores(spark):
    for counts, want in (((0, 0, 0), (100, "Excellent")), ((1, 1, 1), (88, "Good")), ((3, 12, 26), (14, "High risk")), ((20, 20, 20), (0, "High risk"))):
        s = summary.score(*map(F.lit, counts))
        assert tuple(spark.range(1).select(s, summary.label(s)).first()) == want


def test_budget_equals_a_loop(spark):
    rng = random.Random(1)
    rows = [(k, i, rng.randrange(0, 40)) for k in range(60) for i in range(rng.randrange(1, 12))]
    got = {(r["k"], r["i"]): r["taken"] for r in pack.select(spark.createDataFrame(rows, "k int, i int, tokens int"), 50, ("k",), ("i",)).collect()}
    want = {}
    for k in range(60):
        left = 50
        for _, i, n in (r for r in rows if r[0] == k):
            if left <= 0:
                break
            want[k, i] = min(n, left)
            left -= min(n, left)
    assert got == want


def test_graph(spark):
    m = parse.modules(_sample(spark, "ts", "src/f4.tsx", samples.TSX))
    v = graph.vertices(m).orderBy("seq").collect()
    assert [r["node_id"] for r in v][:5] == ["root_1", "import_2", "import_3", "comp_4", "hook_5"]
    assert [r["kind"] for r in v if r["parent_id"] == "comp_4"] == ["hook", "state", "hook", "state", "hook", "effect", "jsx", "jsx", "jsx", "jsx", "event", "prop", "prop", "export"]
    assert v[-1]["kind"] == "hook" and v[-1]["parent_id"] == "root_1" and v[0]["parent_id"] is None
    edges = graph.vertices(m).select("node_id", "parent_id", F.col("seq").alias("ord"))
    w = graph.walk(edges).orderBy("path").collect()
    assert [r["node_id"] for r in w] == [r["node_id"] for r in v] and w[4]["depth"] == 2
    n = {r["node_id"]: r["children"] for r in graph.child_counts(edges).collect()}
    assert n["root_1"] == 5 and n["comp_4"] == 14 and n["hook_5"] == 0
    assert graph.references(graph.vertices(m)).count() == 0
    assert [r["node_id"] for r in graph.by_kind(graph.vertices(m), "component").collect()] == ["comp_19", "comp_4"]  # as text
    lost = spark.createDataFrame([("a", None, 1), ("b", "x", 2)], "node_id string, parent_id string, ord long")
    assert [(r["node_id"], r["path"][0]) for r in graph.walk(lost).orderBy("path").collect()] == [("a", "0"), ("b", "1")]


def test_imports_and_crates(spark):
    r = spark.createDataFrame([("f", "s", 1, None, "a"), ("f", "s", 2, "D", "b"), ("f", "s", 3, "E", "a"), ("f", "t", 4, None, None)], "file string, source string, ord int, default string, name string")
    assert sorted(map(tuple, parse.merged_imports(r).collect())) == [("f", "s", "D", ["a", "b"]), ("f", "t", None, [])]
    files = spark.createDataFrame([("a/src/x.rs",), ("a/b/src/y.rs",), ("z.rs",)], "path string")
    toml = spark.createDataFrame([("a/Cargo.toml", '[package]\nname = "top"\n'), ("a/b/Cargo.toml", 'name = "deep"')], "path string, content string")
    assert sorted(map(tuple, parse.crates(files, toml).collect())) == [("a/b/src/y.rs", "deep"), ("a/src/x.rs", "top"), ("z.rs", "")]


def test_sarif(spark):
    rows = [(2, "b", "high", "Two. More.", "f", 3, "s"), (1, "a", "low", "One", "g", 4, None), (3, "a", "medium", "Three.", "g", 5, "t")]
    f = spark.createDataFrame(rows, "diag_idx int, code string, severity string, message string, file string, line int, symbol string")
    assert [(r["rule_index"], r["id"], r["name"], r["short"], r["level"]) for r in sarif.rules(f).orderBy("rule_index").collect()] == [(0, "a", "a", "One.", "note"), (1, "b", "s", "Two.", "error")]
    d = json.loads(sarif.document(f, "tool", "1").first()[0])
    run = d["runs"][0]
    assert d["version"] == "2.1.0" and [x["ruleId"] for x in run["results"]] == ["a", "b", "a"] and [x["ruleIndex"] for x in run["results"]] == [0, 1, 0]
    assert run["properties"] == {"diagnosticCount": 3, "errorCount": 1, "warningCount": 1, "noteCount": 1}
    assert json.loads(sarif.document(f.limit(0)).first()[0])["runs"][0]["results"] == []


FACT = "repo string, rel_path string, is_dir boolean, content string"


def test_sarif_in_parts(spark):
    """No row has more than a piece of the results, and the parts give the document."""
    n = 2 * sarif.PIECE + 5
    f = spark.range(n).selectExpr("id * 5 % " + str(n) + " as diag_idx", "concat('c', id % 3) as code", "if(id % 2 = 0, 'high', 'low') as severity", "concat('m \"', id, '\", ü') as message", "'f.go' as file", "cast(id % 40 as int) as line", "'s' as symbol")
    p = sarif.parts(f).orderBy("part").collect()
    assert max(r["json"].count("ruleIndex") for r in p) <= sarif.PIECE
    d = json.loads("".join(r["json"] for r in p))
    assert len(d["runs"][0]["results"]) == n == d["runs"][0]["properties"]["diagnosticCount"] and d == json.loads(sarif.document(f).first()[0])
    order = {r["message"]: r["diag_idx"] for r in f.collect()}
    assert [order[x["message"]["text"]] for x in d["runs"][0]["results"]] == list(range(n))
    assert sorted(r["n"] for r in sarif.pieces(f).collect())[-1] <= sarif.PIECE and sarif.pieces(f.limit(0)).count() == 0


def test_files_are_parsed_in_slices():
    """Of a batch of thousands, no more than FILES are Python objects at once; all are parsed."""
    n, kept = 2 * parse.FILES + 3, []

    class Frame:
        def mapInArrow(self, run, schema):
            kept.append(run)

    parse._arrow(Frame(), "path string", lambda r: [{"path": r["path"]}])
    out = list(kept[0](iter([pa.RecordBatch.from_pydict({"path": [str(i) for i in range(n)]})])))
    assert max(b.num_rows for b in out) <= parse.FILES and [x for b in out for x in b.column(0).to_pylist()] == [str(i) for i in range(n)]


def test_readiness(spark):
    rows = [
        ("go", "go.mod", False, "module x"), ("go", "README.md", False, ""), ("go", "Makefile", False, "test:\n\tx"), ("go", "healthz.go", False, None),
        ("js", "package.json", False, '{"scripts":{"lint":"a","build":"b","other":"c"}}'), ("js", "yarn.lock", False, None), ("js", ".github/workflows/ci.yml", False, None),
        ("web", ".agent", True, None), ("web", "convex", True, None), ("web", ".agent/launchkit.yaml", False, "gates:"), ("web", "manifest.json", False, "{bad"), ("none", "x.txt", False, None),
    ]
    f = spark.createDataFrame(rows, FACT)
    v = {r["repo"]: r for r in readiness.verification(f).collect()}
    assert [v[k]["manager"] for k in ("go", "js", "web", "none")] == ["go", "yarn", "unknown", "unknown"]
    assert [c["command"] for c in v["go"]["commands"]] == [*(f"go {w} ./..." for w in ("build", "vet", "test")), "make test"]
    assert [c["command"] for c in v["js"]["commands"]] == ["yarn lint", "yarn build"] and v["js"]["has_ci"]
    c = {(r["repo"], r["name"]): (r["status"], r["message"], r["profile"]) for r in readiness.preflight(f).collect()}
    assert c["go", "README"][0] == "pass" and c["none", "License"][0] == "warn" and c["go", "README"][2] == "generic"
    assert c["web", "Agent Directory"][:2] == ("warn", ".agent/ exists but missing: tenancy.yaml")
    assert c["web", "Manifest"][0] == "fail" and c["web", "Launch Kit"][0] == "pass" and c["web", "Tenancy"][0] == "fail"
    p = readiness.prove(f)
    assert {(r["repo"], r["status"]) for r in readiness.rollup(p, by_need=True).collect()} == {("go", "warn"), ("js", "warn"), ("web", "fail"), ("none", "fail")}
    strict = readiness.rollup(readiness.prove(f, docker=True), by_need=True)
    assert {r["status"] for r in strict.collect()} == {"fail"}
    assert {(r["repo"], r["lang"]) for r in S.language(f).collect()} == {("go", "go"), ("js", "ts"), ("web", "ts"), ("none", "ts")}
    assert readiness.preflight(f.limit(0)).count() == 0


def test_launch_kits(spark):
    good = 'version: "0.1"\ngates:\n  preflight: { required: true, command: "srcplan preflight" }\n  Review: { required: true, command: "srcplan review" }\n  review: { required: false, command: "x" }\nreceipt:\n  enabled: yes\n  format: "xml"\n'
    rows = [("a", "launchkit.yaml", False, good), ("a", ".agent/launchkit.json", False, "{broken"), ("b", "launchkit.json", False, json.dumps({"launch_kit": {"version": "1", "gates": {"prove_app": {"command": "make", "required": True}}}})), ("c", "launchkit.yml", False, "nothing")]
    k = readiness.kits(spark.createDataFrame(rows, FACT))
    g = readiness.gate_results(k)
    got = {}
    for r in g.orderBy("repo", "ord").collect():
        got.setdefault(r["repo"], []).append((r["name"], r["status"]))
    assert got["a"] == [("receipt", "warn"), ("review", "warn"), ("Review", "warn"), ("preflight", "pass"), ("review", "warn"), ("launchkit_validate", "fail"), ("prove_app", "fail")]
    assert got["b"] == [("version", "fail"), ("preflight", "fail"), ("review", "fail"), ("launchkit_validate", "fail"), ("prove_app", "warn")] and "c" not in got
    assert [r["name"] for r in readiness.gate_results(k, fail_fast=True).filter("repo = 'b'").collect()] == ["version"]
    assert {r["name"] for r in readiness.gate_results(k, only=("review",)).filter("repo = 'b'").collect()} == {"version", "review"}


def test_sources(spark, tmp_path):
    for p, c in {"a/x.go": "package a\nfunc F() {}\n", "a/x_test.go": "package a", "vendor/v.go": "package v", ".hid/h.go": "package h", "web/A.tsx": "function A() { return 1; }", "out/B.ts": "let a;", "src/l.rs": "fn f() {}", "target/t.rs": ""}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(c)
    paths_of = lambda kind, **o: sorted(r["path"] for r in S.tree(spark, str(tmp_path), kind, **o).collect())
    assert paths_of("go") == ["a/x.go"] and paths_of("rust") == ["src/l.rs"]
    assert paths_of("ts") == ["out/B.ts", "web/A.tsx"] and paths_of("ts", exclude=("out",)) == ["web/A.tsx"]
    assert [r["name"] for r in parse.functions(S.tree(spark, str(tmp_path), "go")).collect()] == ["F"]
    assert [(r["line"], r["text"]) for r in S.lines(S.tree(spark, str(tmp_path), "rust")).collect()] == [(1, "fn f() {}")]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "1.diff").write_text("diff --git a/x b/x\n@@ -1 +1 @@\n+a\n")
    (tmp_path / "d" / "1.json").write_text('{"specversion":"0.1",\n"id":"grp_1"}')
    assert S.diffs(spark, str(tmp_path / "d" / "1.diff")).first()["text"].startswith("diff")
    assert S.plans(spark, str(tmp_path / "d" / "1.json")).first()["id"] == "grp_1"


def test_renderers(spark, tmp_path):
    f = [{"severity": "high", "code": "c", "file": "f", "line": None, "message": "a|b"}]
    assert "a\\|b" in render.findings(f, True) and "f:0" in render.findings(f) and render.findings([]) == "No findings."
    df = spark.createDataFrame([(1, float("inf")), (2, 0.5)], "k int, r double")
    assert sorted(r[0] for r in render.json_rows(df).collect()) == ['{"k":1,"r_infinite":true}', '{"k":2,"r":0.5}']
    render.write_json(df, str(tmp_path / "out"), single=True)
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    with pytest.raises(ValueError):
        render.rows(df, 1)
    assert "Good" in render.proof({"findings": 1, "files": 1, "high": 0, "medium": 0, "low": 1}, 88, "Good", [], [])
    t = [{"task_id": "t", "goal": "g", "depends_on": ["s"], "allowed_files": ["a"], "max_lines": 200, "verification": ["v"]}]
    assert "after s" in render.tasks(t) and "[pass] n: m" == render.checks([{"name": "n", "status": "pass", "message": "m"}])
    assert render.review({"status": "pass", "reason": "r", "changed": 1, "files": 1, "recommendation": "review"}, []).startswith("PASS: r")
    assert "step" in render.plan({"goal": "g", "plan_id": "p", "risk": "low"}, [{"verify": ["v"], "step_id": "step_1", "risk": "low", "action": "a"}], True)
