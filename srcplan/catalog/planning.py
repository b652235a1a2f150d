"""Queries over plans: steps, normal form, identity, validation, SARIF, readiness, work orders and receipts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcplan.functions import text
from srcplan.operators import decompose, diff, handoff, readiness, sarif
from srcplan.plans import plan, registry, validate
from srcplan.sources import files as S
from srcplan.sources import tables as T


def _ordered(spark: SparkSession, d: str) -> DataFrame:
    return plan.order_findings(T.findings(spark, d))


def plan_normalized(spark: SparkSession, d: str) -> DataFrame:
    return _ordered(spark, d).select("plan", "diag_id", "diag_idx", "code", "severity", "file", "line")


def plan_steps(spark: SparkSession, d: str) -> DataFrame:
    s = plan.steps(_ordered(spark, d))
    return s.select("plan", "step_id", "recipe", "action", "file", "risk", F.array_join("verify", ";").alias("verify"), F.element_at("requires", 1).alias("requires"))


def plan_risk(spark: SparkSession, d: str) -> DataFrame:
    return plan.risk(plan.steps(_ordered(spark, d)))


def plan_goal(spark: SparkSession, d: str) -> DataFrame:
    return plan.goal(T.findings(spark, d), F.concat(F.lit("plan "), F.col("plan")))


def plan_id(spark: SparkSession, d: str) -> DataFrame:
    o = _ordered(spark, d)
    heads = o.select("plan").distinct().select("plan", F.lit("tables").alias("source"), F.concat(F.lit("src/"), "plan").alias("subject"), F.lit("go").alias("language"), F.lit("Improve code quality").alias("goal"))
    return plan.plan_ids(heads, o, plan.steps(o))


def recipe_registry(spark: SparkSession, d: str) -> DataFrame:
    """How many recipes answer each code of findings."""
    r = registry.registry(spark).select("code", "recipe")
    return T.findings(spark, d).select("code").distinct().join(F.broadcast(r), "code", "left")


def validate_duplicates(spark: SparkSession, d: str) -> DataFrame:
    docs = T.table(spark, d, "documents").select(F.col("source").alias("plan"), F.concat(F.lit("diag_"), F.col("n_chars") % 50).alias("id"), F.col("doc_id").alias("i"))
    return validate.duplicates(docs, ("plan",), "id", "i")


def validate_references(spark: SparkSession, d: str) -> DataFrame:
    """Documents that no label knows."""
    refs = T.table(spark, d, "documents").select("doc_id", "source")
    return validate.unknown(refs, T.table(spark, d, "labels"), ["doc_id"])


def _plans(spark: SparkSession, d: str) -> DataFrame:
    """Orders as plan documents, some of them with faults."""
    o = T.table(spark, d, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    null = lambda t: F.lit(None).cast(t)
    verify = F.array().cast(validate._VERIFY)
    symbol = null("struct<kind:string,name:string>")

    def finding(n: int) -> F.Column:
        return F.struct(
            F.when((n == 2) & (k % 5 == 0), "diag_1").otherwise(f"diag_{n}").alias("id"), F.lit("go.long-function").alias("code"), F.when(k % 13 == 0, "urgent").otherwise("low").alias("severity"), null("string").alias("confidence"), F.lit("long").alias("message"),
            F.when(k % 17 == 0, "/abs/f.go").otherwise("f.go").alias("file"), F.lit(1).alias("line"), symbol.alias("symbol"),
        )

    step = F.struct(
        F.lit("step_1").alias("id"), F.lit("r").alias("recipe"), F.when(k % 19 == 0, "").otherwise("t").alias("title"), F.lit("a").alias("action"), F.struct(F.lit("f.go").alias("file"), null("string").alias("symbol"), null("string").alias("kind")).alias("target"), F.lit("low").alias("risk"),
        F.array(F.when(k % 23 == 0, "diag_9").otherwise("diag_1")).alias("requires"), verify.alias("verify"),
    )
    return o.select(
        k.alias("plan"),
        F.when(F.col("o_orderstatus") == "P", "9.9").otherwise("0.1").alias("specversion"),
        F.when(c % 7 == 0, F.concat(F.lit("x_"), k)).otherwise(F.concat(F.lit("grp_"), k)).alias("id"),
        F.lit("plan").alias("type"),
        F.when(c % 11 == 0, "").otherwise("orders").alias("source"),
        F.lit("src").alias("subject"),
        F.lit("go").alias("language"),
        F.lit("goal").alias("goal"),
        F.when(F.col("o_orderpriority").startswith("1"), "critical").otherwise("low").alias("risk"),
        F.array(finding(1), finding(2)).alias("diagnostics"),
        F.array(step).alias("steps"),
        verify.alias("verification"),
        null("struct<status:string,recommendation:string,budget:struct<maxDiffLines:int,maxTouchedFiles:int>,observed:struct<addedLines:int,deletedLines:int,changedFiles:int>>").alias("reviewability"),
        null(f"struct<strategy:string,tasks:array<{validate._TASK}>>").alias("decomposition"),
    )


def validate_enums(spark: SparkSession, d: str) -> DataFrame:
    e = validate.errors(_plans(spark, d))
    return e.filter(F.col("message") == validate.LEVEL).select("plan", "field")


def validate_plans(spark: SparkSession, d: str) -> DataFrame:
    return validate.errors(_plans(spark, d)).groupBy("field", "severity").agg(F.count("*").alias("n"), F.count_distinct("plan").alias("plans"))


def plan_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return validate.verdicts(_plans(spark, d))


def _described(spark: SparkSession, d: str) -> DataFrame:
    message = F.when(F.col("diag_idx") % 2 == 0, F.concat("message", F.lit(" is odd. Look"))).otherwise(F.col("message"))
    return T.findings(spark, d).withColumn("message", message)


def sarif_rules(spark: SparkSession, d: str) -> DataFrame:
    return sarif.rules(_described(spark, d))


def sarif_results(spark: SparkSession, d: str) -> DataFrame:
    return sarif.results(_described(spark, d))


def sarif_counts(spark: SparkSession, d: str) -> DataFrame:
    return sarif.counts(T.findings(spark, d))


_PATHS = ["go.mod", "package.json", "README.md", ".gitignore", "LICENSE", "Makefile", "Dockerfile", "pnpm-lock.yaml", "yarn.lock", "tsconfig.json", ".github/workflows/ci.yml", "next.config.js", "convex/schema.ts", ".agent/tenancy.yaml", ".agent/launchkit.yaml", "healthz.go", ".env", "src/app.ts", "Cargo.toml", ".golangci.yml"]
_PACKAGE = '{"name":"x","scripts":{"build":"b","test":"t","lint":"l"}}'


def _facts(spark: SparkSession, d: str) -> DataFrame:
    """A document is a file of one of many repositories."""
    names = F.array(*map(F.lit, _PATHS))
    path = F.element_at(names, (F.floor(F.col("doc_id") / 83) % len(_PATHS) + 1).cast("int"))
    body = F.when(path == "package.json", F.lit(_PACKAGE)).when(path == "Makefile", F.lit("test:\n\tgo test")).otherwise(F.concat(F.lit("environment: sandbox "), F.col("source")))
    return T.table(spark, d, "documents").select(F.concat(F.lit("repo_"), F.col("doc_id") % 83).alias("repo"), path.alias("rel_path"), F.lit(False).alias("is_dir"), body.alias("content"))


def package_manager(spark: SparkSession, d: str) -> DataFrame:
    return readiness.verification(_facts(spark, d)).select("repo", "manager", "has_ci", "has_convex", F.array_join(F.transform("commands", lambda c: c["command"]), ";").alias("commands"))


def readiness_checks(spark: SparkSession, d: str) -> DataFrame:
    return readiness.preflight(_facts(spark, d), "generic").select("repo", "name", "status", "message")


def readiness_rollup(spark: SparkSession, d: str) -> DataFrame:
    return readiness.rollup(readiness.preflight(_facts(spark, d), "generic"))


def readiness_agent(spark: SparkSession, d: str) -> DataFrame:
    return readiness.rollup(readiness.preflight(_facts(spark, d)))


def prove_checks(spark: SparkSession, d: str) -> DataFrame:
    return readiness.prove(_facts(spark, d)).select("repo", "name", "status", "message")


def prove_rollup(spark: SparkSession, d: str) -> DataFrame:
    return readiness.rollup(readiness.prove(_facts(spark, d)), by_need=True)


def gate_results(spark: SparkSession, d: str) -> DataFrame:
    """Launch kits as many as there are orders, in YAML."""
    o = T.table(spark, d, "orders")
    k = F.col("o_orderkey")
    body = F.concat(
        F.when(k % 5 == 0, F.lit("version: one\n")).otherwise(F.lit('version: "0.1"\n')),
        F.lit('gates:\n  preflight: { required: true, command: "srcplan preflight" }\n  review: { required: '),
        F.when(k % 3 == 0, F.lit("false")).otherwise(F.lit("true")),
        F.lit(', command: "srcplan review" }\n  prove_app: { required: true, command: "'),
        F.when(k % 7 == 0, F.lit("make prove")).otherwise(F.lit("srcplan prove-app")),
        F.lit('" }\n'),
        F.when(k % 2 == 0, F.lit('  launchkit_validate: { required: true, command: "srcplan launchkit validate" }\n')).otherwise(F.lit("")),
    )
    facts = o.select(k.cast("string").alias("repo"), F.lit("launchkit.yaml").alias("rel_path"), F.lit(False).alias("is_dir"), body.alias("content")).distinct()
    return readiness.gate_results(readiness.kits(facts)).select("repo", "name", "status").groupBy("name", "status").agg(F.count("*").alias("n"))


def repo_language(spark: SparkSession, d: str) -> DataFrame:
    return S.language(_facts(spark, d))


def _changes(spark: SparkSession, d: str) -> DataFrame:
    return diff.facts(T.changed_files(spark, d))


def work_orders(spark: SparkSession, d: str) -> DataFrame:
    """Tasks of each change, with steps for its files of 40 added lines or more; orders that are done have a plan."""
    f = _changes(spark, d)
    steps = f.filter("added >= 40").select("diff_id", F.col("file_idx").alias("step_no"), F.col("path").alias("file"))
    o = T.table(spark, d, "orders")
    plans = o.filter("o_orderstatus = 'F'").groupBy(F.col("o_orderkey").alias("diff_id")).agg(F.concat(F.lit("grp_"), F.first("o_orderkey")).alias("plan_id"), F.lit("high").alias("risk"))
    w = handoff.work_orders(decompose.by_category(f), plans, steps)
    return w.select("diff_id", "task_id", "source_plan_id", F.col("work_risk").alias("risk"), F.size("steps").alias("steps"))


def receipt_manifest(spark: SparkSession, d: str) -> DataFrame:
    f = _changes(spark, d)
    texts = f.groupBy("diff_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file_idx", "path"))), lambda x: x["path"]), "\n").alias("text"))
    r = handoff.receipts(f, texts)
    manifest = F.array_join(F.transform("manifest", lambda x: F.concat(x["path"], F.lit(" +"), x["added"].cast("string"), F.lit(" -"), x["deleted"].cast("string"))), ";")
    return r.select("diff_id", "changed", "added", "deleted", "files", manifest.alias("manifest"), "content_hash")


QUERIES = {
    f.__name__: f
    for f in (
        plan_normalized, plan_steps, plan_risk, plan_goal, plan_id, recipe_registry, validate_duplicates, validate_references, validate_enums, validate_plans, plan_verdicts, sarif_rules, sarif_results, sarif_counts, package_manager, readiness_checks, readiness_rollup, readiness_agent, prove_checks, prove_rollup,
        gate_results, repo_language, work_orders, receipt_manifest,
    )
}

_D = f"WITH {T.FINDINGS_SQL}"
_RANK = lambda c: f"CASE {c} WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END"
_REG = ", ".join(f"('{c}', '{r}', '{k}', '{';'.join(v)}', '{a}')" for c, r, k, v, a in registry.entries())
_STEPS = f"""{_D}, od AS (SELECT *, row_number() OVER (PARTITION BY plan ORDER BY {_RANK('severity')}, file, coalesce(nullif(line, 0), 2147483647), code, symbol, message, diag_idx) AS diag_no FROM fd),
reg(rcode, recipe, rr, verify, template) AS (VALUES {_REG}),
st0 AS (SELECT od.*, recipe, verify, CASE rr WHEN '=' THEN severity ELSE rr END AS risk, replace(template, '%s', symbol) AS action FROM od JOIN reg ON rcode = code),
st AS (SELECT *, row_number() OVER (PARTITION BY plan ORDER BY {_RANK('risk')}, file, recipe, action, diag_no) AS step_no FROM st0)"""
_LAYOUT = f"""f0 AS (SELECT 'repo_' || (doc_id % 83) AS repo, ([{", ".join(f"'{p}'" for p in _PATHS)}])[(doc_id // 83) % {len(_PATHS)} + 1] AS p, source FROM documents),
ls AS (SELECT repo, list(DISTINCT p) AS ps FROM f0 GROUP BY 1)"""
_HAS = lambda *n: "(" + " OR ".join(f"list_contains(ps, '{x}')" for x in n) + ")"
_MANAGER = "CASE " + " ".join(f"WHEN {_HAS(n)} THEN '{m}'" for n, m in readiness.MANAGERS) + " ELSE 'unknown' END"
_RUN = "CASE m WHEN 'bun' THEN 'bun run' WHEN 'pnpm' THEN 'pnpm' WHEN 'yarn' THEN 'yarn' ELSE 'npm run' END"
_IN = lambda cond, value: f"CASE WHEN {cond} THEN {value} END"
_LIST = lambda items: f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"
_PKG = _HAS("package.json")
_COMMANDS = _LIST(
    [_IN(_PKG, f"{_RUN} || ' {s}'") for s in ("lint", "test", "build")] + [_IN("m = 'go'", f"'go {w} ./...'") for w in ("build", "vet", "test")] + [_IN("m = 'cargo'", f"'cargo {w}'") for w in ("build", "clippy", "test")] + [_IN(_HAS("Makefile"), "'make test'"), _IN(_HAS(".golangci.yml"), "'golangci-lint run'")]
)
_REPO = f"WITH {_LAYOUT}, mg AS (SELECT *, {_MANAGER} AS m FROM ls)"
_GENERIC = f"""gc AS (SELECT repo, 'Package Manager' AS name, CASE WHEN {_HAS('go.mod', 'package.json', 'Cargo.toml')} THEN 'pass' ELSE 'warn' END AS status,
CASE WHEN {_HAS('go.mod')} THEN 'Go module detected (go.mod)' WHEN {_PKG} THEN 'Node.js project detected (package.json)' WHEN {_HAS('Cargo.toml')} THEN 'Rust project detected (Cargo.toml)' ELSE 'No recognized package manager manifest found' END AS message FROM mg
UNION ALL SELECT repo, n, CASE WHEN list_contains(ps, p) THEN 'pass' ELSE 'warn' END, p || CASE WHEN list_contains(ps, p) THEN ' exists' ELSE ' not found' END FROM mg, (VALUES ('README', 'README.md'), ('.gitignore', '.gitignore'), ('License', 'LICENSE')) v(n, p))"""
_ROLL = lambda src: f"SELECT repo, count(*) AS total, count(*) FILTER (status = 'pass') AS passed, count(*) FILTER (status = 'warn') AS warned, count(*) FILTER (status = 'fail') AS failed"
_FITS = f"({_HAS('.agent/tenancy.yaml', '.agent/launchkit.yaml')} AND {_HAS('next.config.js', 'convex/schema.ts')})"
_INT = lambda *n: f"{_HAS(*n)}::INT"
_PASSED = f"({_HAS('.agent/tenancy.yaml')} AND {_HAS('.agent/launchkit.yaml')})::INT + " + " + ".join(_INT(n) for n in (".agent/tenancy.yaml", "next.config.js", "convex/schema.ts", "package.json", ".env"))
_AGENT = f"""ag AS (SELECT repo, CASE WHEN {_FITS} THEN 13 ELSE 4 END AS total, CASE WHEN {_FITS} THEN {_PASSED} ELSE {_INT('go.mod', 'package.json', 'Cargo.toml')} + {_INT('README.md')} + {_INT('.gitignore')} + {_INT('LICENSE')} END AS passed,
CASE WHEN {_FITS} THEN (NOT {_HAS('.agent/launchkit.yaml')})::INT + (NOT {_HAS('.agent/tenancy.yaml')})::INT ELSE 0 END AS failed FROM mg)"""
_SRC = {
    "Build": [_IN(_PKG, "'package.json'"), _IN("m = 'go'", "'go.mod'"), _IN("m = 'cargo'", "'Cargo.toml'")],
    "Test": [_IN(_PKG, "'package.json'"), _IN("m = 'go'", "'go.mod'"), _IN("m = 'cargo'", "'Cargo.toml'"), _IN(_HAS("Makefile"), "'Makefile'")],
    "Type Check": [_IN(_HAS("tsconfig.json"), "'tsconfig.json'"), _IN("m = 'go'", "'go.mod'")],
    "Lint": [_IN(_HAS(".golangci.yml"), "'.golangci.yml'"), _IN(_PKG, "'package.json'"), _IN("m = 'go'", "'go.mod'"), _IN("m = 'cargo'", "'Cargo.toml'"), _IN(_HAS(".golangci.yml"), "'config-file'")],
}
_OR = {"Build": _IN(_HAS("go.mod"), "'go.mod'"), "Test": _IN(_HAS("go.mod"), "'go.mod'"), "Type Check": _IN(_HAS("go.mod"), "'go.mod'"), "Lint": "NULL"}
_WHAT = {"Build": ("Build", "fail", "No build configuration found", True), "Test": ("Tests", "warn", "No test configuration found", True), "Type Check": ("Type checking", "warn", "No type checking configuration found", True), "Lint": ("Linting", "warn", "No lint configuration found", False)}
_PROVE = f"""pr AS (SELECT repo, 'Config' AS name, true AS required, {_LIST([_IN(_HAS(n), f"'{n}'") for n in ('go.mod', 'package.json', 'tsconfig.json', 'Makefile')])} AS s, 'Essential config files present' AS lead, 'fail' AS bad, 'No essential config files found ({', '.join(readiness.ESSENTIAL)})' AS none FROM mg
{" ".join(f"UNION ALL SELECT repo, '{n}', {str(q).lower()}, CASE WHEN len({_LIST(_SRC[n])}) > 0 THEN {_LIST(_SRC[n])} ELSE {_LIST([_OR[n]])} END, '{w} configured', '{b}', '{x}' FROM mg" for n, (w, b, x, q) in _WHAT.items())}
UNION ALL SELECT repo, 'Docker', false, {_LIST([_IN(_HAS('Dockerfile'), "'Dockerfile found'")])}, '', 'warn', 'No Dockerfile found' FROM mg
UNION ALL SELECT repo, 'CI', false, {_LIST([_IN(_HAS('.github/workflows/ci.yml'), "'CI workflow found'")])}, '', 'warn', 'No CI workflow found' FROM mg
UNION ALL SELECT repo, 'Health', false, {_LIST([_IN(_HAS('healthz.go'), "'healthz.go'")])}, 'Health check indicators found', 'warn', 'No health check endpoints or probes found' FROM mg),
pc AS (SELECT repo, name, required, CASE WHEN len(s) > 0 THEN 'pass' ELSE bad END AS status, CASE WHEN len(s) = 0 THEN none WHEN lead = '' THEN s[1] ELSE lead || ' (' || array_to_string(list_filter(s, lambda x, i: list_position(s, x) = i), ', ') || ')' END AS message FROM pr)"""
_FAULTS = """k AS (SELECT o_orderkey AS plan, o_custkey AS c, o_orderstatus AS s, o_orderpriority AS p FROM orders),
er AS (SELECT plan, 'specversion' AS field, 'x' AS message FROM k WHERE s = 'P' UNION ALL SELECT plan, 'id', 'x' FROM k WHERE c % 7 = 0 UNION ALL SELECT plan, 'source', 'x' FROM k WHERE c % 11 = 0
UNION ALL SELECT plan, 'risk', 'level' FROM k WHERE p LIKE '1%' UNION ALL SELECT plan, 'diagnostics[' || i || '].severity', 'level' FROM k, range(2) r(i) WHERE plan % 13 = 0
UNION ALL SELECT plan, 'diagnostics[' || i || '].file', 'x' FROM k, range(2) r(i) WHERE plan % 17 = 0 UNION ALL SELECT plan, 'diagnostics[1].id', 'x' FROM k WHERE plan % 5 = 0
UNION ALL SELECT plan, 'steps[0].title', 'x' FROM k WHERE plan % 19 = 0 UNION ALL SELECT plan, 'steps[0].requires', 'x' FROM k WHERE plan % 23 = 0)"""
_MSG = "fm AS (SELECT * REPLACE (CASE WHEN diag_idx % 2 = 0 THEN message || ' is odd. Look' ELSE message END AS message) FROM fd)"
_LEVEL = "CASE severity WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END"
SQL = {
    "plan_normalized": f"{_STEPS} SELECT plan, printf('diag_%03d', diag_no) AS diag_id, diag_idx, code, severity, file, line FROM od",
    "plan_steps": f"{_STEPS} SELECT plan, printf('step_%03d', step_no) || '_' || code || '_' || replace(lower(symbol), '_', '-') AS step_id, recipe, action, file, risk, verify, printf('diag_%03d', diag_no) AS requires FROM st",
    "plan_risk": f"{_STEPS} SELECT plan, CASE min({_RANK('risk')}) WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS risk, CAST(sum(strlen(action) // 3) AS BIGINT) AS tokens FROM st GROUP BY 1",
    "plan_goal": f"""{_D} SELECT plan, 'Refactor plan ' || plan || ': ' || CASE WHEN bool_or(code IN ('go.long-function', 'go.high-complexity')) THEN 'simplify complex functions' WHEN bool_or(code LIKE '%component%') AND bool_or(code LIKE '%hook%') THEN 'reduce component size and extract custom hooks'
WHEN bool_or(code LIKE '%component%') THEN 'reduce component size' WHEN bool_or(code LIKE '%hook%') THEN 'extract custom hooks' ELSE 'improve code structure' END AS goal FROM fd GROUP BY 1""",
    "plan_id": f"""{_STEPS}, a AS (SELECT plan, string_agg(code || file || line || symbol, '' ORDER BY diag_no) AS x FROM od GROUP BY 1), b AS (SELECT plan, string_agg(recipe || action || file, '' ORDER BY step_no) AS y FROM st GROUP BY 1)
SELECT plan, 'grp_' || left(sha256('0.1' || 'tables' || 'src/' || plan || 'go' || 'Improve code quality' || x || coalesce(y, '')), 8) AS plan_id FROM a LEFT JOIN b USING (plan)""",
    "recipe_registry": f"{_STEPS} SELECT DISTINCT code, recipe FROM od LEFT JOIN reg ON rcode = code",
    "validate_duplicates": "SELECT plan, id, i FROM (SELECT source AS plan, 'diag_' || (n_chars % 50) AS id, doc_id AS i, row_number() OVER (PARTITION BY source, n_chars % 50 ORDER BY doc_id) AS n FROM documents) WHERE n > 1",
    "validate_references": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "validate_enums": f"WITH {_FAULTS} SELECT plan, field FROM er WHERE message = 'level'",
    "validate_plans": f"WITH {_FAULTS} SELECT field, 'error' AS severity, count(*) AS n, count(DISTINCT plan) AS plans FROM er GROUP BY 1",
    "plan_verdicts": f"WITH {_FAULTS}, n AS (SELECT plan, count(*) AS n FROM er GROUP BY 1) SELECT k.plan, n IS NULL AS valid, coalesce(n, 0) AS n_errors FROM k LEFT JOIN n ON n.plan = k.plan",
    "sarif_rules": f"""{_D}, {_MSG}, r AS (SELECT * FROM fm QUALIFY row_number() OVER (PARTITION BY code ORDER BY diag_idx) = 1)
SELECT CAST(row_number() OVER (ORDER BY diag_idx) - 1 AS INTEGER) AS rule_index, code AS id, symbol AS name, CASE WHEN position('. ' IN message) > 0 THEN left(message, position('. ' IN message)) ELSE message || '.' END AS short, message AS "full", {_LEVEL} AS level, severity FROM r""",
    "sarif_results": f"""{_D}, {_MSG}, r AS (SELECT code, min(diag_idx) AS d FROM fm GROUP BY 1), x AS (SELECT code, CAST(row_number() OVER (ORDER BY d) - 1 AS INTEGER) AS rule_index FROM r)
SELECT diag_idx, code AS rule_id, rule_index, message, {_LEVEL} AS level, file AS uri, line AS start_line, line AS end_line FROM fm JOIN x USING (code)""",
    "sarif_counts": f"""{_D} SELECT count(*) AS "diagnosticCount", count(*) FILTER (severity = 'high') AS "errorCount", count(*) FILTER (severity = 'medium') AS "warningCount", count(*) FILTER (severity = 'low') AS "noteCount" FROM fd""",
    "package_manager": f"{_REPO} SELECT repo, m AS manager, {_HAS('.github/workflows/ci.yml')} AS has_ci, {_HAS('convex/schema.ts')} AS has_convex, array_to_string({_COMMANDS}, ';') AS commands FROM mg",
    "readiness_checks": f"{_REPO}, {_GENERIC} SELECT * FROM gc",
    "readiness_rollup": f"{_REPO}, {_GENERIC} {_ROLL('gc')}, CASE WHEN bool_or(status = 'fail') THEN 'fail' WHEN bool_or(status = 'warn') THEN 'warn' ELSE 'pass' END AS status FROM gc GROUP BY repo",
    "readiness_agent": f"{_REPO}, {_AGENT} SELECT repo, CAST(total AS BIGINT) AS total, CAST(passed AS BIGINT) AS passed, CAST(total - passed - failed AS BIGINT) AS warned, CAST(failed AS BIGINT) AS failed, CASE WHEN failed > 0 THEN 'fail' WHEN passed < total THEN 'warn' ELSE 'pass' END AS status FROM ag",
    "prove_checks": f"{_REPO}, {_PROVE} SELECT repo, name, status, message FROM pc",
    "prove_rollup": f"{_REPO}, {_PROVE} {_ROLL('pc')}, CASE WHEN bool_or(status = 'fail' AND required) THEN 'fail' WHEN bool_or(status = 'warn' AND NOT required) THEN 'warn' ELSE 'pass' END AS status FROM pc GROUP BY repo",
    "gate_results": """WITH k AS (SELECT DISTINCT o_orderkey AS k FROM orders), r AS (SELECT 'version' AS name, 'fail' AS status FROM k WHERE k % 5 = 0 UNION ALL SELECT 'preflight', 'pass' FROM k UNION ALL SELECT 'review', CASE WHEN k % 3 = 0 THEN 'warn' ELSE 'pass' END FROM k
UNION ALL SELECT 'launchkit_validate', CASE WHEN k % 2 = 0 THEN 'pass' ELSE 'fail' END FROM k UNION ALL SELECT 'prove_app', CASE WHEN k % 7 = 0 THEN 'warn' ELSE 'pass' END FROM k) SELECT name, status, count(*) AS n FROM r GROUP BY ALL""",
    "repo_language": f"{_REPO} SELECT repo, CASE WHEN {_HAS('Cargo.toml')} THEN 'rust' WHEN {_HAS('go.mod')} THEN 'go' WHEN {_HAS('healthz.go')} AND NOT {_HAS('src/app.ts', 'convex/schema.ts', 'next.config.js')} THEN 'go' ELSE 'ts' END AS lang FROM mg",
    "receipt_manifest": f"""WITH {T.FILES_SQL} SELECT diff_id, CAST(sum(changed) AS BIGINT) AS changed, CAST(sum(added) AS BIGINT) AS added, CAST(sum(deleted) AS BIGINT) AS deleted, count(*) AS files,
string_agg(path || ' +' || added || ' -' || deleted, ';' ORDER BY file_idx) AS manifest, sha256(string_agg(path, chr(10) ORDER BY file_idx)) AS content_hash FROM fs GROUP BY diff_id""",
    "work_orders": None,
}


def _work_orders_sql() -> str:
    from srcplan.catalog import diffs

    return f"""{diffs._W}, {diffs._CHAIN}, pl2 AS (SELECT o_orderkey AS diff_id, 'grp_' || o_orderkey AS plan_id FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
n AS (SELECT tc.diff_id, tc.category, count(*) FILTER (fs.added >= 40) AS steps FROM (SELECT diff_id, category, path FROM tc GROUP BY ALL) tc JOIN fs ON fs.diff_id = tc.diff_id AND fs.path = tc.path GROUP BY ALL)
SELECT ti.diff_id, ti.task_id, plan_id AS source_plan_id, CASE WHEN plan_id IS NULL THEN 'MEDIUM' ELSE 'HIGH' END AS risk, CAST(n.steps AS INTEGER) AS steps FROM ti LEFT JOIN pl2 ON pl2.diff_id = ti.diff_id JOIN n ON n.diff_id = ti.diff_id AND n.category = ti.category"""


SQL["work_orders"] = _work_orders_sql()
