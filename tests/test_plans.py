from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from srcplan.plans import plan, registry, validate

FINDING = "diag_idx int, plan string, code string, severity string, file string, line int, symbol string, message string"
ROWS = [
    (0, "p", "react.repeated-jsx", "low", "b.tsx", 0, "App", "m1"),
    (1, "p", "react.large-component", "medium", "b.tsx", 3, "App", "m2"),
    (2, "p", "react.complex-conditionals", "low", "a.tsx", 9, "App", "m3"),
    (3, "p", "go.ignored-error", "medium", "a.go", 7, None, "m4"),
    (4, "p", "go.long-function", "high", "z.go", 1, "Do It", "m5"),
]


def _plan(spark, rows=ROWS):
    f = spark.createDataFrame(rows, FINDING)
    o = plan.order_findings(f)
    return f, o, plan.steps(o)


def test_order_steps_and_risk(spark):
    _, o, s = _plan(spark)
    assert [r["diag_idx"] for r in o.orderBy("diag_no").collect()] == [4, 3, 1, 2, 0]
    got = s.orderBy("step_no").collect()
    assert [r["step_id"] for r in got] == ["step_001_go.long-function_do-it", "step_002_go.ignored-error_a", "step_003_react.large-component_app", "step_004_react.repeated-jsx_app"]  # no recipe, no step
    assert got[2]["action"] == "Split App (b.tsx) into smaller focused components" and got[1]["action"] == "Handle ignored errors in a.go"
    assert [r["risk"] for r in got] == ["high", "medium", "medium", "low"] and got[0]["requires"] == ["diag_001"]
    r = plan.risk(s).first()
    assert r["risk"] == "high" and r["tokens"] == sum(len(x["action"]) // 3 for x in got)


def test_plan_id_is_a_hash_of_all_parts(spark):
    f, o, s = _plan(spark)
    head = spark.createDataFrame([("p", "src", "sub", "go", "goal"), ("empty", "src", "sub", "go", "goal")], "plan string, source string, subject string, language string, goal string")
    got = {r["plan"]: r["plan_id"] for r in plan.plan_ids(head, o, s).collect()}
    d = "".join(f"{r['code']}{r['file']}{r['line']}{r['symbol'] or ''}" for r in o.orderBy("diag_no").collect())
    t = "".join(f"{r['recipe']}{r['action']}{r['file']}" for r in s.orderBy("step_no").collect())
    for name, tail in (("p", d + t), ("empty", "")):
        assert got[name] == "grp_" + hashlib.sha256(f"0.1srcsubgogoal{tail}".encode()).hexdigest()[:8]
    again = _plan(spark, ROWS[::-1])
    assert plan.plan_ids(head, again[1], again[2]).filter("plan = 'p'").first()["plan_id"] == got["p"]


def test_goals(spark):
    rows = [(0, "a", "go.large-file", "low", "f", 1, "", ""), (1, "a", "go.ignored-error", "low", "f", 1, "", ""), (2, "b", "react.large-component", "low", "f", 1, "", ""), (3, "b", "react.too-many-hooks", "low", "f", 1, "", ""), (4, "c", "other", "low", "f", 1, "", "")]
    got = {r["plan"]: r["goal"] for r in plan.goal(spark.createDataFrame(rows, FINDING), F.lit("x")).collect()}
    assert got == {"a": "Refactor x: split large files and handle ignored errors", "b": "Refactor x: reduce component size and extract custom hooks", "c": "Refactor x: improve code structure"}


def test_registry(spark):
    assert len(registry.entries()) == 41 and len({e[0] for e in registry.entries()}) == 41
    more = [("own.code", "own.recipe", "low", ["x"], "Do %s"), ("go.large-file", "late", "low", [], "no")]
    r = {x["code"]: x["recipe"] for x in registry.registry(spark, more).collect()}
    assert r["own.code"] == "own.recipe" and r["go.large-file"] == "go.split-file"
    assert plan.fallback_step("r", "f")["action"] == "Apply recipe r to f"


def _doc(**over):
    d = {
        "plan": "p", "specversion": "0.1", "id": "grp_1", "type": "t", "source": "s", "subject": "sub", "language": "go", "risk": "low", "goal": "g",
        "diagnostics": [{"id": "diag_1", "code": "c", "severity": "low", "confidence": "", "message": "m", "file": "f", "line": 1, "symbol": None}],
        "steps": [{"id": "step_1", "recipe": "r", "title": "t", "action": "a", "target": {"file": "f", "symbol": None, "kind": None}, "requires": ["diag_1"], "risk": "low", "verify": []}],
        "verification": [], "reviewability": None, "decomposition": None,
    }
    return d | over


def _errors(spark, **over):
    df = spark.createDataFrame([_doc(**over)], "plan string, " + validate.PLAN)
    return sorted({r["field"] for r in validate.errors(df).collect()})


def test_validation(spark):
    d, s = _doc()["diagnostics"][0], _doc()["steps"][0]
    task = {"id": "task_1", "goal": "g", "allowedFiles": [], "maxDiffLines": 1, "dependsOn": []}
    assert _errors(spark) == []
    assert _errors(spark, specversion="", id="", type="") == ["id", "specversion", "type"]
    assert _errors(spark, specversion="9.9") == ["specversion"] and _errors(spark, id="x_1") == ["id"] and _errors(spark, risk="critical") == ["risk"] and _errors(spark, risk="") == []
    assert _errors(spark, subject="/abs") == ["subject"]
    assert _errors(spark, diagnostics=[d, d]) == ["diagnostics[1].id"] and _errors(spark, diagnostics=[d | {"file": "C:\\x"}]) == ["diagnostics[0].file"]
    assert _errors(spark, diagnostics=[]) == ["steps[0].requires"] and _errors(spark, steps=[s | {"requires": ["diag_999"]}]) == ["steps[0].requires"]
    assert _errors(spark, steps=[s | {"id": "bad", "verify": [{"command": "", "required": True, "source": "", "confidence": "odd", "type": ""}]}]) == ["steps[0].id", "steps[0].verify[0].command", "steps[0].verify[0].confidence"]
    dec = lambda *t: {"strategy": "x", "tasks": list(t)}
    assert _errors(spark, decomposition=dec()) == ["decomposition.tasks"] and _errors(spark, decomposition=dec(task)) == []
    later = dec(task | {"dependsOn": ["task_2"]}, task | {"id": "task_2", "dependsOn": ["task_2", "task_1"], "maxDiffLines": -1})
    assert _errors(spark, decomposition=later) == ["decomposition.tasks[0].dependsOn", "decomposition.tasks[1].maxDiffLines"]
    bad = {"status": "odd", "recommendation": "odd", "budget": {"maxDiffLines": -1, "maxTouchedFiles": 1}, "observed": {"addedLines": 0, "deletedLines": 0, "changedFiles": -2}}
    assert _errors(spark, reviewability=bad) == ["reviewability.budget.maxDiffLines", "reviewability.observed.changedFiles", "reviewability.recommendation", "reviewability.status"]


def test_verdicts(spark):
    df = spark.createDataFrame([_doc(), _doc(plan="q", risk="x", goal="")], "plan string, " + validate.PLAN)
    assert sorted(map(tuple, validate.verdicts(df).collect())) == [("p", True, 0), ("q", False, 2)]
