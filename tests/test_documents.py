"""Plan documents, packs for tasks, merged graphs, walks, envelopes and readers."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from srcplan.functions import lineage
from srcplan.operators import diff, graph, handoff, pack, readiness, review, rules, structural
from srcplan.plans import document, validate
from srcplan.sources import files as S


def _doc(plan: str, **more) -> dict:
    d = lambda i, sev, line, name: {"id": i, "code": "go.x", "severity": sev, "confidence": "high", "message": "m", "file": "a.go", "line": line, "symbol": {"kind": "", "name": name}}
    step = {"id": "old", "recipe": "r", "title": "t", "action": "a", "target": {"file": "dir/My_File.test.go", "symbol": None, "kind": None}, "risk": "low", "requires": ["b", "a", "gone"], "verify": []}
    base = {"plan": plan, "specversion": "0.1", "id": "grp_1", "type": "t", "source": "s", "subject": "x", "language": "go", "goal": "g", "risk": "low", "diagnostics": [d("a", "low", 3, "Low"), d("b", "high", 0, ""), d("c", "high", 9, "High")], "steps": [step], "verification": [], "reviewability": None}
    return base | {"decomposition": {"strategy": "category", "tasks": [{"id": "task_2", "goal": "g", "allowedFiles": ["b", "a"], "maxDiffLines": 3, "dependsOn": ["task_1"]}, {"id": "task_1", "goal": "g", "allowedFiles": None, "maxDiffLines": 3, "dependsOn": []}]}} | more


def _frame(spark, *docs):
    return spark.createDataFrame(list(docs), f"plan string, {validate.PLAN}")


def test_normal_form(spark):
    out = document.normalized(_frame(spark, _doc("p"), _doc("q", diagnostics=None, steps=None, decomposition=None), _doc("r", diagnostics=[], decomposition=None)))
    by = {r["plan"]: r for r in out.collect()}
    p = by["p"]
    assert [(d["id"], d["line"]) for d in p["diagnostics"]] == [("diag_001", 9), ("diag_002", 0), ("diag_003", 3)]  # line 0 last
    assert [(s["id"], s["requires"]) for s in p["steps"]] == [("step_001_go.x_low", ["diag_002", "diag_003", "gone"])]  # the first symbol that is named
    assert [(t["id"], t["allowedFiles"]) for t in p["decomposition"]["tasks"]] == [("task_1", None), ("task_2", ["a", "b"])]
    assert by["q"]["decomposition"] is None and not by["q"]["diagnostics"] and not by["q"]["steps"]
    assert by["r"]["steps"][0]["id"] == "step_001_r_my-filetest" and out.columns == ["plan", *_doc("p")][1:]
    again = document.normalized(document.normalized(_frame(spark, _doc("p"))))
    assert [s["id"] for s in again.first()["steps"]] == ["step_001_go.x_low"] and document.normalized(_frame(spark, _doc("p")).limit(0)).count() == 0


def test_documents_are_written_and_read(spark, tmp_path):
    docs = document.normalized(_frame(spark, _doc("p"), _doc("q", goal='say "hi"\nand <go>')))
    document.write(docs, str(tmp_path / "plans"))
    back = S.plans(spark, str(tmp_path / "plans" / "*"))
    assert sorted(r["goal"] for r in back.collect()) == ["g", 'say "hi"\nand <go>']
    one = back.filter("goal = 'g'").drop("plan").first().asDict(True)
    assert one == docs.filter("plan = 'p'").drop("plan").first().asDict(True)
    assert validate.errors(back.withColumn("id", F.lit("grp_x"))).count() == validate.errors(docs.withColumn("id", F.lit("grp_x"))).count()


def test_scope_of_a_task(spark):
    f = spark.createDataFrame([("d", "a.go"), ("d", "dir/a.go"), ("e", "a.go")], "diff_id string, path string")
    t = spark.createDataFrame([("d", "t1", "own goal", ["a.go", "a.go", "none"]), ("d", "t2", "", [])], "diff_id string, task_id string, goal string, allowed_files array<string>")
    p = spark.createDataFrame([("d", "whole"), ("e", "whole")], "diff_id string, goal string")
    files, plans = pack.for_task(f, p, t)
    assert sorted(map(tuple, files.select("task_id", "path").collect())) == [("t1", "a.go")]  # whole paths only, once
    assert sorted(map(tuple, plans.select("task_id", "goal").collect())) == [("t1", "own goal"), ("t2", "whole")]


def test_privacy(spark):
    df = spark.createDataFrame([("/home/me/src/a.go", "mail me@x.org")], "p string, c string")
    assert tuple(pack.private(df, "private", "p", "c").first()) == ("/home/me/src/a.go", "mail me@x.org")
    assert tuple(pack.private(df, "redacted", "p", "c").first()) == ("<redacted>/src/a.go", "mail <email-redacted>")
    assert pack.private(df, "public", "p", "c").first()["c"] == "mail me@x.org"


def test_walk_has_no_depth_limit(spark):
    n = 3000
    rows = [(f"n{i}", f"n{i - 1}" if i else None, i) for i in range(n)] + [("x", "y", 1), ("y", "x", 2), ("z", "y", 3), ("o", "nowhere", 4), ("s", "s", 5)]
    got = {r["node_id"]: r for r in graph.walk(spark.createDataFrame(rows, "node_id string, parent_id string, ord int")).collect()}
    assert len(got) == len(rows) and all(got[f"n{i}"]["depth"] == i for i in (0, 1, 2, 31, 32, 33, n - 1))
    assert got["n2"]["path"] == "0/0000000000/0000000001/0000000002"
    assert {k: (got[k]["depth"], got[k]["path"]) for k in "xyzos"} == {k: (0, f"1/000000000{i}") for i, k in enumerate("xyzos", 1)}
    assert graph.walk(spark.createDataFrame([], "node_id string, parent_id string, ord int")).count() == 0


def test_walk_keeps_pieces_of_paths_only(spark, monkeypatch):
    """What is kept between rounds has no path that is longer than a piece, but for one node in a piece's levels."""
    kept = []
    cut = lineage.cut
    monkeypatch.setattr(graph.lineage, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    monkeypatch.setattr(graph, "LEVELS", 16)
    n = 700
    got = {r["node_id"]: r for r in graph.walk(spark.createDataFrame([(f"n{i}", f"n{i - 2}" if i > 1 else None, i) for i in range(n)], "node_id string, parent_id string, ord int")).collect()}
    assert all(r["path"] == "/".join(["0", *(f"{k:010d}" for k in range(i % 2, i + 1, 2))]) and r["depth"] == i // 2 for i, r in ((i, got[f"n{i}"]) for i in range(n))) and len(got) == n
    chars = max(df.agg(F.sum(F.length("text"))).first()[0] for df in kept)
    assert chars * 8 < sum(len(r["path"]) for r in got.values())


def test_merged_graphs(spark):
    v = lambda *r: spark.createDataFrame(list(r), "node_id string, name string")
    assert sorted(map(tuple, graph.merge(v(("a", "left"), ("b", "left")), v(("b", "right"), ("c", "right"))).collect())) == [("a", "left"), ("b", "right"), ("c", "right")]
    assert sorted(map(tuple, graph.merge_symbols(v(("1", "A")), v(("2", "A"), ("3", "B"))).collect())) == [("A", "1"), ("B", "3")]
    e = lambda *r: spark.createDataFrame(list(r), "parent_id string, node_id string, ord int")
    got = graph.merge_children(e(("p", "a", 2), ("p", "b", 5)), e(("p", "a", 1), ("q", "c", 1))).orderBy("parent_id", "ord").collect()
    assert [tuple(r) for r in got] == [("p", "a", 1), ("p", "b", 2), ("p", "a", 3), ("q", "c", 1)]


def _changes(spark):
    rows = [("big", i, f"internal/{'ab'[i % 2]}/x{i}.go", 900, 0) for i in range(4)] + [("big", 9, "web/ui/c.tsx", 5, 5), ("small", 1, "docs/a.md", 3, 1), ("tests", 1, "a_test.go", 50, 0)]
    return diff.facts(spark.createDataFrame(rows, "diff_id string, file_idx int, path string, added int, deleted int"))


def test_clusters_of_named_diffs(spark):
    c = structural.clusters(_changes(spark))
    assert dict(c.dtypes)["diff_id"] == "string" and {r["diff_id"] for r in c.collect()} <= {"big"}


def test_review_envelope(spark):
    f = _changes(spark)
    kinds = structural.ratios(structural.buckets(f), "ephemeral", "reusable").join(structural.cohesion(f), "diff_id")
    named = kinds.join(structural.suggested(structural.clusters(f)), "diff_id", "left")
    judged = review.verdict(diff.totals(f))
    got = {r["diff_id"]: json.loads(r["json"]) for r in review.envelopes(judged, kinds, review.diagnostics(judged, named)).collect()}
    assert set(got["big"]) == {"version", "spec", "review", "structural", "diagnostics"} and got["big"]["review"]["status"] == "fail" and got["big"]["review"]["observed"]["changed"] == 3610
    assert [d["code"] for d in got["big"]["diagnostics"]][:2] == ["agent.diff-too-large", "agent.unreviewable-plan"]
    assert "diagnostics" not in got["small"] and "test_to_logic" not in got["tests"]["structural"]  # an infinite ratio is left out
    assert json.loads(review.envelopes(judged, kinds, review.diagnostics(judged, kinds), "s", "v").first()["json"])["v"] == "0.1"


def test_clusters_are_named_in_the_message(spark):
    k = spark.createDataFrame([("d", 0.625, 0.0, 0.0, 0.7, 1, 0, "[a...b], [c...d]"), ("e", 0.1, 3.25, 0.0, 0.7, 1, 0, None)], "diff_id string, overhead double, test_to_logic double, productive double, variance double, ephemeral int, reusable int, suggested string")
    t = diff.totals(diff.facts(spark.createDataFrame([("d", 1, "a.go", 1, 1), ("e", 1, "a.go", 1, 1)], "diff_id string, file_idx int, path string, added int, deleted int")))
    got = {(r["diff_id"], r["code"]): r["message"] for r in review.diagnostics(review.verdict(t), k).collect()}
    assert got["d", "agent.low-cohesion"] == "Cohesion variance is 0.70 (threshold: 0.60) (suggested clusters: [a...b], [c...d])" and got["e", "agent.low-cohesion"] == "Cohesion variance is 0.70 (threshold: 0.60)"
    assert got["d", "agent.high-overhead"] == "Structural overhead ratio is 0.62 (threshold: 0.50)" and got["e", "agent.test-to-code-imbalance"].startswith("Test-to-logic ratio is 3.2 ")  # halves to even


def test_order_of_findings(spark):
    f = spark.createDataFrame([(1, "low", "a", "m", "f", 1, "s"), (2, "high", "b", "z", "f", 2, "s"), (3, "high", "b", "a", "g", 1, "s"), (4, "high", "b", "a", "f", 9, "s")], "i int, severity string, code string, message string, file string, line int, symbol string").withColumn("p", F.lit(1))
    place = lambda lang: [r["i"] for r in rules.ordered(f, lang, ("p",), "i").orderBy("place").collect()]
    assert place("ts") == [3, 4, 2, 1] and place("go") == place("rust") == [2, 4, 3, 1]


def test_repositories_are_read(spark, tmp_path):
    for name, body in {"one/go.mod": "module x", "one/cmd/main.go": "package main", "one/.github/workflows/ci.yml": "on: push", "one/Makefile": "test:\n\tgo test", "one/node_modules/x/package.json": "{}", "two/package.json": '{"scripts":{"test":"t"}}', "two/pnpm-lock.yaml": "x", "stray.txt": "x"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    facts = S.repo_facts(spark, str(tmp_path))
    assert {(r["repo"], r["rel_path"]) for r in facts.collect()} == {("one", "go.mod"), ("one", "cmd/main.go"), ("one", ".github/workflows/ci.yml"), ("one", "Makefile"), ("two", "package.json"), ("two", "pnpm-lock.yaml")}
    assert {r["rel_path"]: r["content"] for r in facts.filter("repo = 'one'").collect()}["cmd/main.go"] is None
    v = {r["repo"]: r for r in readiness.verification(facts).collect()}
    assert (v["one"]["manager"], v["two"]["manager"], v["one"]["has_ci"], v["one"]["has_makefile"]) == ("go", "pnpm", True, True)
    assert "make test" in [c["command"] for c in v["one"]["commands"]] and {r["repo"]: r["lang"] for r in S.language(facts).collect()} == {"one": "go", "two": "ts"}


def test_decompositions_and_results_are_read(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "v").mkdir()
    (tmp_path / "d" / "a.json").write_text(json.dumps({"strategy": "category", "tasks": [{"id": "t1", "goal": "g", "allowedFiles": ["x.go"], "maxDiffLines": 9, "parallelizable": True}, {"id": "t2"}]}, indent=1))
    (tmp_path / "v" / "a.json").write_text('{"status": "pass"}')
    (tmp_path / "v" / "b.json").write_text("{}")
    got = S.decompositions(spark, str(tmp_path / "d")).orderBy("task_no").collect()
    assert [(r["task_no"], r["task_id"], r["allowed_files"], r["parallelizable"]) for r in got] == [(1, "t1", ["x.go"], True), (2, "t2", [], False)]
    assert sorted(r["verification"] for r in S.verifications(spark, str(tmp_path / "v")).collect()) == ["pass", "unknown"]
    verified = S.verifications(spark, str(tmp_path / "v" / "a.json")).select(F.lit("d").alias("diff_id"), "verification")
    f = diff.facts(spark.createDataFrame([("d", 1, "x.go", 2, 1)], "diff_id string, file_idx int, path string, added int, deleted int"))
    r = handoff.receipts(f, spark.createDataFrame([("d", "text")], "diff_id string, text string"), None, verified).first()
    assert (r["verification"], r["changed"], r["plan_ref"]) == ("pass", 3, None)
