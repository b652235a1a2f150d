from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from srcplan import catalog
from srcplan.operators import decompose, diff, handoff, review, structural

FILE = "diff_id long, file_idx int, path string, added int, deleted int"


def _parse(spark, *texts):
    rows = diff.parse(spark.createDataFrame(list(enumerate(texts)), "diff_id long, text string")).collect()
    return sorted((r.asDict() for r in rows), key=lambda r: (r["diff_id"], r["file_idx"]))


HEAD = "diff --git a/{0} b/{0}\nindex 1..2 100644\n--- a/{0}\n+++ b/{0}\n"


def test_diff_vectors(spark):
    one = HEAD.format("main.go") + "@@ -1,3 +1,5 @@\n ctx\n+a\n+b\n-x\n+c"
    two = HEAD.format("a.go") + "@@ -1 +1 @@\n+a\n" + HEAD.format("b.go") + "@@ -1 +1 @@\n+a\n+b\n\\ No newline at end of file"
    binary = "diff --git a/i.png b/i.png\nindex 1..2\nBinary files a/i.png and b/i.png differ\n@@ -1 +1 @@\n+x"
    rename = "diff --git a/old.go b/new.go\nsimilarity index 100%\nrename from old.go\nrename to new.go"
    new = "diff --git a/n.go b/n.go\nnew file mode 100644\nindex 0..1\n--- /dev/null\n+++ b/n.go\n@@ -0,0 +1,3 @@\n+1\n+2\n+3"
    hunks = HEAD.format("h.go") + "@@ -1 +1 @@\n+a\n-b\n@@ -9 +9 @@ func x\n+c\n+d\n+e\n-f"
    header_like = HEAD.format("s.sql") + "@@ -1 +1 @@\n-a\n--- b\n+c\n@@ -5 +5 @@\n+d"
    space = "diff --git a/x b/y z b/x b/y z\n--- a/q\n+++ b/q\n@@ -1 +1 @@\n+a\r"
    no_header = "diff --git a/k b/k\n@@ -1 +1 @@\n+a\n"
    got = _parse(spark, one, two, binary, "", rename, new, hunks, header_like, space, no_header, "+stray\n@@ -1 +1 @@\n+a", None)
    by = {}
    for r in got:
        by.setdefault(r["diff_id"], []).append((r["path"], r["added"], r["deleted"], r["is_binary"], r["is_rename"]))
    assert by[0] == [("main.go", 3, 1, False, False)]
    assert by[1] == [("a.go", 1, 0, False, False), ("b.go", 2, 0, False, False)]
    assert by[2] == [("i.png", 0, 0, True, False)]  # what follows a binary mark counts nowhere
    assert 3 not in by and 10 not in by and 11 not in by
    assert by[4] == [("new.go", 0, 0, False, True)]
    assert by[5] == [("n.go", 3, 0, False, False)] and by[6] == [("h.go", 4, 2, False, False)]
    assert by[7] == [("s.sql", 1, 1, False, False)]  # a deleted line that looks like a header ends its hunk
    assert by[8] == [("x", 1, 0, False, False)] and by[9] == [("k", 1, 0, False, False)]


def _machine(lines: list[str]) -> list[tuple[str, int, int, bool, bool]]:
    """The grammar as a state machine, to hold the window form against."""
    out, state = [], "start"
    for text in lines:
        tok = next((n for n, e in diff.LEXER if re.search(e, text)), None)
        if tok is None:
            continue
        if tok == "DIFF":
            out.append([re.search(r"^diff --git a/(.*?) b/|$", text).group(1) or "", 0, 0, False, False])
            state = "meta"
        elif state in ("start", "closed"):
            continue
        elif tok == "HUNK":
            state = "hunk"
        elif state == "meta":
            if tok == "BINARY":
                out[-1][3], state = True, "closed"
            elif tok in ("RENAME_FROM", "RENAME_TO"):
                out[-1][4] = True
                if tok == "RENAME_TO":
                    out[-1][0] = text[len("rename to ") :]
            elif tok in ("OLD", "NEWHDR"):
                state = "body"
            elif tok in ("ADD", "DEL", "CTX", "NOEOL"):
                state = "closed"
        elif state == "body":
            if tok not in ("OLD", "NEWHDR"):
                state = "closed"
        elif state == "hunk":
            if tok == "ADD":
                out[-1][1] += 1
            elif tok == "DEL":
                out[-1][2] += 1
            elif tok not in ("CTX", "NOEOL"):
                state = "broken"
    return [tuple(x) for x in out]


def test_diff_windows_equal_a_state_machine(spark):
    rng = random.Random(5)
    kinds = ["@@ -1 +1 @@", "diff --git a/f{} b/f{}", "Binary files differ", "new file mode 1", "rename from a{}", "rename to b{}", "similarity index 1%", "index 1..2", "--- a/x", "+++ b/x", "\\ No newline", "+add", "+more", "-del", " ctx", "junk", ""]
    weights = [4, 3, 1, 1, 1, 1, 1, 1, 3, 3, 1, 6, 6, 6, 3, 1, 1]
    cases = [[k.replace("{}", str(rng.randrange(9))) for k in rng.choices(kinds, weights, k=rng.randrange(1, 25))] for _ in range(400)]
    got = {}
    for r in _parse(spark, *["\n".join(c) for c in cases]):
        got.setdefault(r["diff_id"], []).append((r["path"], r["added"], r["deleted"], r["is_binary"], r["is_rename"]))
    for i, c in enumerate(cases):
        assert got.get(i, []) == _machine(c), c


def test_render_gives_counts_back(spark):
    rows = [(1, 1, "a.go", 3, 0), (1, 2, "b c.md", 0, 2), (2, 1, "z", 1, 1)]
    back = diff.parse(diff.render(spark.createDataFrame(rows, FILE))).select("diff_id", "file_idx", "path", "added", "deleted")
    assert sorted(map(tuple, back.collect())) == rows


def test_diffs_are_parsed_where_they_lie(spark):
    """No shuffle and no sort of lines, whose number is many times that of files; rows that share an id, or have none, are diffs of their own."""
    text = HEAD.format("a.go") + "@@ -1 +1 @@\n+a\nindex 1..2\n+lost\n@@ -9 +9 @@\n-b\r\n" + HEAD.format("b.go") + "@@ -1 +1 @@\n+a"
    d = diff.parse(spark.createDataFrame([(1, text), (1, text), (None, text)], "diff_id long, text string"))
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan
    assert sorted((r["diff_id"] or 0, r["file_idx"], r["path"], r["added"], r["deleted"]) for r in d.collect()) == sorted([(i, 1, "a.go", 1, 1) for i in (1, 1, 0)] + [(i, 2, "b.go", 1, 0) for i in (1, 1, 0)])


def test_ratios_of_large_changes_are_rounded_as_sql_does(spark, tmp_path):
    """169 / 5120 has ten places, the last a 5: a change of 5,120 lines of logic and 169 of tests."""
    lines = [(9.0, 2)] * 568 + [(8.0, 2)] + [(9.0, 3)] * 18 + [(7.0, 3)]
    values = spark.createDataFrame([(k, i, q) for i, (q, k) in enumerate(lines)], "p long, i int, q double")
    values.selectExpr("1L l_orderkey", "p l_partkey", "1L l_suppkey", "i l_linenumber", "q l_quantity", "1D l_extendedprice", "0D l_discount", "0D l_tax", "'A' l_returnflag", "'O' l_linestatus", "timestamp'2024-01-01' l_shipdate").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert catalog.queries()["structural_ratios"](spark, str(tmp_path)).first()["test_to_logic"] == 0.033007812
    x = spark.createDataFrame([(169 / 5120,), (float("inf"),), (1 / 3,), (-2.5e-9,), (None,)], "x double").select(structural.rounded(F.col("x")))
    assert [r[0] for r in x.collect()] == [0.033007812, float("inf"), 0.333333333, -3e-9, None]


def test_facts(spark):
    names = {"main.go": "go", "internal/server/handler.go": "library", "internal/x.go": "go", "pkg/api/types.go": "library", "App.tsx": "typescript", "src/index.js": "typescript", "style.css": "style", "config.yaml": "config", "README.md": "documentation", "test/integration_test.go": "go", "test/x.sh": "test", "somefile.rs": "other"}
    f = diff.facts(spark.createDataFrame([(1, i, n, 1, 0) for i, n in enumerate(names)], FILE))
    assert {r["path"]: r["category"] for r in f.collect()} == names
    g = diff.facts(spark.createDataFrame([(1, i, n, 1, 0) for i, n in enumerate(["go.sum", "distribution/x.go", "src/dist/x.go", "composer.lock", "a.go"])], FILE)).orderBy("file_idx").collect()
    assert [(r["is_generated"], r["is_lockfile"]) for r in g] == [(True, True), (True, False), (False, False), (True, False), (False, False)]


def _files(spark, *files):
    return diff.facts(spark.createDataFrame([(1, i + 1, p, a, 0) for i, (p, a) in enumerate(files)], FILE))


def _structure(spark, *files):
    f = _files(spark, *files)
    b = structural.buckets(f)
    return b.collect()[0].asDict() | structural.ratios(b).collect()[0].asDict() | structural.cohesion(f).collect()[0].asDict(), f


def test_structure(spark):
    s, _ = _structure(spark, ("internal/server/handler.go", 100))
    assert (s["logic"], s["ephemeral"], s["overhead"], s["variance"]) == (90, 10, pytest.approx(0.1), 0)
    s, _ = _structure(spark, ("internal/server/handler.go", 100), ("internal/server/handler_test.go", 50))
    assert (s["logic"], s["test"], s["ephemeral"], s["test_to_logic"]) == (90, 45, 15, 0.5)
    assert s["overhead"] == pytest.approx(15 / 105) and s["variance"] == pytest.approx(0.4)
    s, f = _structure(spark, ("internal/server/handler.go", 50), ("internal/server/middleware.go", 30), ("frontend/pages/home.tsx", 20))
    assert (s["logic"], s["ephemeral"]) == (91, 9) and s["variance"] == pytest.approx(0.8)
    assert sorted((r["cluster"], r["path"]) for r in structural.clusters(f).collect()) == [(1, "internal/server/handler.go"), (1, "internal/server/middleware.go")]
    s, _ = _structure(spark, ("tsconfig.json", 10), (".eslintrc.json", 5), ("styles.css", 20))
    assert (s["config_data"], s["config_structural"], s["overhead"], s["test_to_logic"]) == (20, 15, 1.0, 0)
    s, _ = _structure(spark, ("go.sum", 20), ("node_modules/a/b.js", 50), ("cmd/app/main.go", 30))
    assert (s["logic"], s["ephemeral"], s["generated"], s["variance"]) == (27, 3, 70, 0)
    s, _ = _structure(spark, ("a_test.go", 10))
    assert s["test_to_logic"] == float("inf")


@pytest.mark.parametrize("in_row", [400, 2])
def test_similarity_equals_all_pairs(spark, in_row):
    rng = random.Random(3)
    words = ["a", "b", "c", "d", "e"]
    files = [(d, i, "/".join(rng.choices(words, k=rng.randrange(1, 4))) + f".{rng.choice(words)}", 1, 0) for d in range(40) for i in range(rng.randrange(1, 6))]
    f = diff.facts(spark.createDataFrame(files, FILE))
    got = {r["diff_id"]: r["variance"] for r in structural.cohesion(f, in_row).collect()}
    assert sorted(map(tuple, structural.clusters(f, in_row).collect())) == sorted(map(tuple, structural.clusters(f).collect()))
    for d in range(40):
        sets = [set(filter(None, re.split("[/.]", p))) for x, _, p, _, _ in files if x == d]
        pairs = [1 - len(a & b) / len(a | b) for i, a in enumerate(sets) for b in sets[i + 1 :]]
        assert got[d] == pytest.approx(sum(pairs) / len(pairs) if pairs else 0, abs=1e-9)


@pytest.mark.parametrize(
    "changed, files, categories, generated, status, codes",
    [
        (60, 3, 1, False, "pass", []), (2500, 5, 1, False, "fail", ["diff-too-large"]), (2500, 20, 1, False, "fail", ["diff-too-large", "too-many-files-touched"]), (120, 5, 3, False, "warn", ["mixed-boundaries"]), (1600, 3, 1, False, "warn", ["diff-too-large"]),
        (2500, 20, 3, False, "fail", ["diff-too-large", "too-many-files-touched", "mixed-boundaries"]), (1500, 12, 1, False, "pass", []), (1501, 3, 1, False, "warn", ["diff-too-large"]), (120, 2, 1, True, "warn", []), (2500, 10, 1, True, "fail", ["diff-too-large"]),
    ],
)
def test_review(spark, changed, files, categories, generated, status, codes):
    t = spark.createDataFrame([(1, files, changed, generated, False, [f"c{i}" for i in range(categories)])], "diff_id long, files long, changed long, has_generated boolean, has_lockfile boolean, categories array<string>")
    v = review.verdict(t)
    r = v.collect()[0]
    assert r["status"] == status and r["recommendation"] == ("decompose" if status == "fail" else "review")
    kinds = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.0, 0, 0)], "diff_id long, overhead double, test_to_logic double, productive double, variance double, ephemeral long, reusable long")
    got = [x["code"].removeprefix("agent.") for x in review.diagnostics(v, kinds).orderBy("ord").collect()]
    assert got == codes + (["unreviewable-plan", "parallelization-opportunity"] if status == "fail" else [])


def test_decomposition(spark):
    t = decompose.by_category(_files(spark, ("README.md", 5), ("db/a.sql", 10), ("x.go", 20), ("y.go", 480), ("web/A.tsx", 30), ("x_test.go", 5))).orderBy("task_no").collect()
    assert [r["category"] for r in t] == ["schema", "go", "typescript", "documentation", "test"]
    assert [r["task_id"] for r in t][:2] == ["task_001_schema", "task_002_go"]
    assert t[1]["allowed_files"] == ["x.go", "y.go"] and t[1]["max_lines"] == 750 and t[0]["max_lines"] == 200
    assert [r["parallelizable"] for r in t] == [True] + [False] * 4
    assert t[2]["depends_on"] == ["task_001_schema", "task_002_go"]


def test_cluster_decomposition(spark):
    f = _files(spark, ("internal/server/handler.go", 50), ("internal/server/middleware.go", 30), ("frontend/pages/home.tsx", 20), ("frontend/pages/about.tsx", 5), ("LICENSE", 1))
    t = decompose.by_cluster(structural.clusters(f), f).orderBy("task_no").collect()
    assert [r["task_id"] for r in t] == ["task_001_cluster_server", "task_002_cluster_pages", "task_003_remainder"]
    assert [r["depends_on"] for r in t] == [[], ["task_001_cluster_server"], ["task_001_cluster_server"]]
    assert t[2]["allowed_files"] == ["LICENSE"] and t[2]["max_lines"] == 400 and t[0]["max_lines"] == 200


def test_receipts_and_work_orders(spark):
    f = _files(spark, ("a.go", 3), ("b.go", 4))
    texts = spark.createDataFrame([(1, "diff"), (2, "")], "diff_id long, text string")
    r = {x["diff_id"]: x for x in handoff.receipts(f, texts, spark.createDataFrame([(1, "grp_1")], "diff_id long, plan_id string")).collect()}
    assert (r[1]["files"], r[1]["added"], r[1]["plan_ref"], len(r[1]["content_hash"])) == (2, 7, "grp_1", 64)
    assert (r[2]["files"], r[2]["manifest"], r[2]["content_hash"]) == (0, [], "")
    tasks = spark.createDataFrame([(1, "task_1", ["a.go"]), (1, "task_2", []), (1, "task_3", ["z.go"])], "diff_id long, task_id string, allowed_files array<string>")
    steps = spark.createDataFrame([(1, 1, "b.go"), (1, 2, "a.go")], "diff_id long, step_no int, file string")
    none = spark.createDataFrame([], "diff_id long, plan_id string, risk string")
    w = {x["task_id"]: x for x in handoff.work_orders(tasks, none, steps).collect()}
    assert [[s["step_no"] for s in w[k]["steps"]] for k in ("task_1", "task_2", "task_3")] == [[2], [1, 2], []]
    assert w["task_1"]["work_risk"] == "MEDIUM" and w["task_1"]["source_plan_id"] is None


def test_empty_tables(spark):
    e = spark.createDataFrame([], FILE)
    f = diff.facts(e)
    for df in (diff.totals(f), structural.buckets(f), structural.cohesion(f), structural.clusters(f), decompose.by_category(f), decompose.by_cluster(structural.clusters(f), f), diff.parse(spark.createDataFrame([], "diff_id long, text string"))):
        assert df.filter(F.lit(True)).collect() == []
