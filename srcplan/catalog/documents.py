"""Queries over plan documents, packs for tasks, merged graphs, and what leaves the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from srcplan.catalog import code, diffs, planning, samples
from srcplan.operators import decompose, diff, graph, pack, parse, readiness, review, rules, sarif, structural
from srcplan.plans import document, plan
from srcplan.sinks import render
from srcplan.sources import files as S
from srcplan.sources import tables as T


def _tasks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    f = diff.facts(T.changed_files(spark, d))
    t = decompose.by_category(f).select("diff_id", "task_id", F.when(F.col("task_no") % 2 == 0, "").otherwise(F.col("goal")).alias("goal"), "allowed_files")
    return f, t


def task_files(spark: SparkSession, d: str) -> DataFrame:
    """The files of a pack for each task."""
    f, t = _tasks(spark, d)
    plans = f.select("diff_id").distinct().withColumn("goal", F.lit("whole"))
    return pack.for_task(f.select("diff_id", "path"), plans, t)[0].select("diff_id", "task_id", "path")


def task_goals(spark: SparkSession, d: str) -> DataFrame:
    f, t = _tasks(spark, d)
    plans = f.select("diff_id").distinct().withColumn("goal", F.concat(F.lit("plan of "), "diff_id"))
    return pack.for_task(f.select("diff_id", "path"), plans, t)[1].select("diff_id", "task_id", "goal")


def review_envelopes(spark: SparkSession, d: str) -> DataFrame:
    """What the JSON of each review says."""
    f = diff.facts(T.changed_files(spark, d))
    judged, kinds = review.verdict(diff.totals(f), diffs.LINES, diffs.FILES), diffs._kinds(f)
    e = review.envelopes(judged, kinds, review.diagnostics(judged, kinds, diffs.LINES, diffs.FILES))
    codes = F.transform(F.from_json("json", "struct<diagnostics:array<struct<code:string>>>")["diagnostics"], lambda x: x["code"])
    at = lambda p: F.get_json_object("json", p)
    return e.select("diff_id", "status", at("$.spec").alias("spec"), at("$.review.recommendation").alias("recommendation"), at("$.review.observed.changed").cast("long").alias("changed"), at("$.structural.test_to_logic").isNull().alias("unbounded"), F.coalesce(F.array_join(codes, ","), F.lit("")).alias("codes"))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """Each plan's findings and steps as a document; every third plan names no language, every fifth finding has its confidence."""
    o = plan.order_findings(T.findings(spark, d)).withColumn("n", F.col("diag_idx"))
    s = plan.steps(o).withColumn("diag_idx", F.substring(F.element_at("requires", 1), 6, 9).cast("int") - 1)
    found = o.select("plan", (F.col("diag_no") - 1).alias("diag_idx"), "code", "severity", F.when(F.col("n") % 5 == 0, "low").otherwise("").alias("confidence"), "message", "file", "line", F.when(F.col("n") % 3 == 0, "").otherwise(F.col("symbol")).alias("symbol"), F.when(F.col("n") % 6 == 0, "Comp").alias("component"))
    heads = o.select("plan").distinct().select("plan", F.format_string("grp_%08d", "plan").alias("plan_id"), F.lit("src").alias("target"), F.when(F.col("plan") % 3 == 0, "").otherwise("go").alias("language"), F.lit("goal").alias("goal"), F.lit("low").alias("risk"), F.array(F.lit("tests")).alias("verify"))
    return document.public(heads, found, s)


def public_plans(spark: SparkSession, d: str) -> DataFrame:
    p = _documents(spark, d)
    v = F.col("verification")[0]
    return p.select("plan", "specversion", "id", "type", "language", F.size("diagnostics").alias("findings"), F.size("steps").alias("steps"), v["command"].alias("command"), v["required"].alias("required"), v["source"].alias("source"), v["confidence"].alias("confidence"))


def public_findings(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("plan", F.explode("diagnostics").alias("x")).select("plan", "x.id", "x.code", "x.severity", "x.confidence", "x.file", "x.line", F.col("x.symbol.name").alias("symbol"))


def public_steps(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("plan", F.explode("steps").alias("x")).select("plan", "x.id", "x.title", "x.target.file", "x.risk", F.element_at("x.requires", 1).alias("requires"), F.size("x.verify").alias("checks"))


def public_packs(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as packs."""
    c = T.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("files"), F.count("*").cast("int").alias("token_estimate"))
    none = F.array().cast("array<string>")
    packs = c.select("conv_id", F.lit("goal").alias("goal"), F.lit(diffs.LINES).alias("token_budget"), "token_estimate", "files", none.alias("snippets"), none.alias("diagnostics"), none.alias("steps"), F.array(F.lit("tests")).alias("verification"), F.concat(F.lit("grp_"), "conv_id").alias("plan_id"))
    return document.public_pack(packs).select("conv_id", "specversion", "type", "planId", F.col("budget.maxTokens").alias("most"), F.col("budget.estimatedTokens").alias("estimate"), F.array_join("files", ",").alias("files"))


def _read(spark: SparkSession, d: str) -> DataFrame:
    """Orders as plan documents that are not in normal form."""
    o = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    k = F.col("k")
    level = lambda n: F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), (n % 3 + 1).cast("int"))

    def finding(n: int) -> F.Column:
        name = F.lit("") if n == 2 else F.format_string(f"Sym_%d_{n}", k % 5)
        return F.struct(F.lit(f"d{n}").alias("id"), F.lit(f"c{n}").alias("code"), level(k + n).alias("severity"), F.lit("high").alias("confidence"), F.lit(f"m{n}").alias("message"), F.format_string("f%d.go", k * n % 4).alias("file"), ((k + n) % 3).cast("int").alias("line"), F.struct(F.lit("k").alias("kind"), name.alias("name")).alias("symbol"))

    none = F.lit(None).cast("string")
    verify = F.array().cast("array<struct<command:string,required:boolean,source:string,confidence:string,type:string>>")

    def step(recipe: F.Column, file: str, risk: F.Column, *requires: str) -> F.Column:
        return F.struct(F.lit("old").alias("id"), recipe.alias("recipe"), F.lit("t").alias("title"), F.lit("a").alias("action"), F.struct(F.lit(file).alias("file"), none.alias("symbol"), none.alias("kind")).alias("target"), risk.alias("risk"), F.array(*map(F.lit, requires)).cast("array<string>").alias("requires"), verify.alias("verify"))

    task = lambda n, *files: F.struct(F.lit(n).alias("id"), F.lit("g").alias("goal"), F.array(*files).alias("allowedFiles"), F.lit(1).alias("maxDiffLines"), F.array(F.lit("t3"), F.lit("t1")).alias("dependsOn"))
    return o.select(
        k.alias("plan"),
        F.array(*[finding(n) for n in (1, 2, 3)]).alias("diagnostics"),
        F.array(step(F.lit("r1"), "f.go", F.lit("low"), "d2", "d1"), step(F.when(k % 3 == 0, "").otherwise("r2"), "a/b.d.tsx", level(k), "zz"), step(F.lit("r3"), "?.go", F.lit("odd"))).alias("steps"),
        F.struct(F.lit("s").alias("strategy"), F.array(task("t2", F.lit("b"), F.format_string("a%d", k % 7), F.lit("a")), task("t1", F.lit("z"))).alias("tasks")).alias("decomposition"),
    )


def normalized_findings(spark: SparkSession, d: str) -> DataFrame:
    return document.normalized(_read(spark, d)).select("plan", F.explode("diagnostics").alias("x")).select("plan", "x.id", "x.code", "x.severity", "x.file", "x.line")


def normalized_steps(spark: SparkSession, d: str) -> DataFrame:
    return document.normalized(_read(spark, d)).select("plan", F.explode("steps").alias("x")).select("plan", "x.id", "x.recipe", "x.risk", F.array_join("x.requires", ",").alias("requires"))


def normalized_tasks(spark: SparkSession, d: str) -> DataFrame:
    t = document.normalized(_read(spark, d)).select("plan", F.posexplode("decomposition.tasks").alias("place", "x"))
    return t.select("plan", "place", "x.id", F.array_join("x.allowedFiles", ",").alias("files"), F.array_join("x.dependsOn", ",").alias("after"))


def analysis_order(spark: SparkSession, d: str) -> DataFrame:
    f = T.findings(spark, d)
    a = rules.ordered(f, "ts", ("plan",), "diag_idx").withColumnRenamed("place", "ts_place")
    return rules.ordered(a, "go", ("plan",), "diag_idx").select("diag_idx", "plan", "ts_place", F.col("place").alias("go_place"))


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = T.table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("node_id"), F.col("p_name").alias("name"), F.col("p_partkey").alias("k"))
    return p.filter("k % 3 < 2"), p.filter("k % 3 > 0").withColumn("name", F.upper("name"))


def merged_nodes(spark: SparkSession, d: str) -> DataFrame:
    left, right = _sides(spark, d)
    return graph.merge(left, right).select("node_id", "name")


def merged_symbols(spark: SparkSession, d: str) -> DataFrame:
    left, right = (x.groupBy(F.substring("name", 1, 6).alias("name")).agg(F.min("node_id").alias("node_id")) for x in _sides(spark, d))
    return graph.merge_symbols(left, right.withColumn("name", F.lower("name")))


def merged_children(spark: SparkSession, d: str) -> DataFrame:
    n = T.table(spark, d, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.concat(F.lit("n"), "n_nationkey").alias("node_id"), F.col("n_nationkey").cast("long").alias("ord"))
    s = T.table(spark, d, "supplier").select(F.concat(F.lit("r"), F.col("s_nationkey") % 7).alias("parent_id"), F.concat(F.lit("s"), "s_suppkey").alias("node_id"), (-F.col("s_suppkey")).cast("long").alias("ord"))
    return graph.merge_children(n, s)


def deep_walk(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as chains of up to 25 levels and more, with a cycle: each hangs below the one four numbers before, those under 5 below each other."""
    k = F.col("s_suppkey")
    e = T.table(spark, d, "supplier").select(F.concat(F.lit("s"), k).alias("node_id"), F.when(k > 8, F.concat(F.lit("s"), k - 4)).when(k < 5, F.concat(F.lit("s"), k % 4 + 1)).alias("parent_id"), k.cast("long").alias("ord"))
    return graph.walk(e).select("node_id", "depth", "path")


def nodes_by_kind(spark: SparkSession, d: str) -> DataFrame:
    v = graph.vertices(parse.modules(samples.files(T.table(spark, d, "documents"), "tsx")))
    return graph.by_kind(v, kind="hook", suffix="Effect").select("file", "node_id", "name")


def crate_names(spark: SparkSession, d: str) -> DataFrame:
    """Parts as Rust files below crates of several depths."""
    p = T.table(spark, d, "part")
    files = p.select(F.concat(F.lit("a"), F.col("p_partkey") % 5, F.lit("/b"), F.col("p_partkey") % 3, F.lit("/src/f"), "p_partkey", F.lit(".rs")).alias("path"))
    named = [("Cargo.toml", "[workspace]"), ("a0/Cargo.toml", '[package]\nname = "zero"'), ("a1/b1/Cargo.toml", 'x = 1\n  name="deep"\nname = "second"'), ("a1/Cargo.toml", 'name = "one"'), ("a2/b/Cargo.toml", 'name = "aside"')]
    return parse.crates(files, spark.createDataFrame(named, "path string, content string"))


def diff_render(spark: SparkSession, d: str) -> DataFrame:
    """Changes written as diffs and read back."""
    return diff.parse(diff.render(T.changed_files(spark, d))).select("diff_id", "file_idx", "path", "added", "deleted")


def json_ratios(spark: SparkSession, d: str) -> DataFrame:
    """What the JSON of the ratios says where one is infinite."""
    j = render.json_rows(structural.ratios(structural.buckets(diff.facts(T.changed_files(spark, d)))))
    at = lambda c: F.get_json_object("json", f"$.{c}")
    return j.select(at("diff_id").cast("long").alias("diff_id"), at("test_to_logic").isNull().alias("missing"), F.coalesce(at("test_to_logic_infinite"), F.lit("false")).alias("infinite"), structural.rounded(at("overhead").cast("double")).alias("overhead"))


def gate_names(spark: SparkSession, d: str) -> DataFrame:
    """Nations as repositories with gates, all checks of the schema and those of one gate."""
    k = F.col("n_nationkey")
    gate = lambda name, required=True, command="srcplan preflight": F.struct(F.lit(name).alias("gate"), F.lit(required).alias("required"), F.lit(command).alias("command"))
    kits = T.table(spark, d, "nation").select(
        F.col("n_name").alias("repo"), F.lit("launchkit.json").alias("path"), F.when(k % 4 == 0, "v1").otherwise("1.0").alias("version"), (k % 5 == 0).alias("receipt_enabled"), F.when(k % 2 == 0, "xml").otherwise("json").alias("receipt_format"),
        F.when(k % 3 == 0, F.array(gate("preflight"), gate("PreFlight"), gate("own"))).when(k % 3 == 1, F.array(gate("preflight", False))).otherwise(F.array(gate("review"))).alias("gates"),
    )
    return readiness.gate_results(kits, only=("preflight",), fail_fast=True).select("repo", "name", "status", "message")


def source_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines of documents as files; an empty one has none."""
    f = T.source_files(spark, d).withColumn("content", F.when(F.col("file_id") % 9 == 0, "").otherwise(F.col("content")))
    return S.lines(f).groupBy("path").agg(F.count("*").alias("n"), F.max("line").alias("last"), F.max_by("text", "line").alias("text"))


def sarif_document(spark: SparkSession, d: str) -> DataFrame:
    """What the SARIF document of all findings says, read piece by piece; what is known of the pieces, one row for each and each rule, gives the places in the whole."""
    f = planning._described(spark, d)
    run = "struct<tool:struct<driver:struct<rules:array<struct<id:string>>>>,properties:struct<errorCount:int,warningCount:int,noteCount:int>>"
    r = sarif.frame(f).select(F.from_json(F.concat("head", "tail"), f"struct<version:string,runs:array<{run}>>").alias("j")).select("j.version", F.col("j.runs")[0].alias("r"))
    r = r.select("version", F.size("r.tool.driver.rules").alias("rules"), "r.properties.*")
    result = "struct<ruleId:string,ruleIndex:int,level:string,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int,endLine:int>>>>>"
    x = sarif.pieces(f).select("part", F.posexplode(F.from_json("json", f"array<{result}>")).alias("place", "x"))
    x = x.groupBy("part", F.col("x.ruleId").alias("rule")).agg(F.count("*").alias("n"), F.min("place").alias("first"), F.sum(F.col("x.locations")[0]["physicalLocation"]["region"]["startLine"]).alias("lines"), F.min(F.col("x.ruleIndex")).alias("rule_index"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = x.withColumn("first", (before + F.col("first")).cast("int")).groupBy("rule").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.sum("lines").alias("lines"), F.min("rule_index").alias("rule_index"))
    return x.crossJoin(F.broadcast(r)).select("version", "rules", "errorCount", "warningCount", "noteCount", "rule", "n", "first", "lines", "rule_index")


def scaffold_findings(spark: SparkSession, d: str) -> DataFrame:
    """Reviews of changes that add support which is used again, as far as it is said of them: orders with made-up ratios."""
    o = T.table(spark, d, "orders")
    t = o.select(F.col("o_orderkey").alias("diff_id"), F.lit(1).cast("long").alias("changed"), F.lit(1).cast("long").alias("files"), F.array(F.lit("go")).alias("categories"), F.lit(False).alias("has_generated"), F.lit(False).alias("has_lockfile"))
    k = o.select(F.col("o_orderkey").alias("diff_id"), F.lit(0.0).alias("overhead"), (F.col("o_custkey") % 9).cast("double").alias("test_to_logic"), (F.col("o_custkey") % 16 / 16).alias("productive"), F.lit(0.0).alias("variance"), F.lit(30).alias("ephemeral"), (F.col("o_orderkey") % 40).cast("int").alias("reusable"))
    return review.diagnostics(review.verdict(t), k).select("diff_id", "code", "severity", "message")


QUERIES = {
    f.__name__: f
    for f in (
        task_files, task_goals, review_envelopes, public_plans, public_findings, public_steps, public_packs, normalized_findings, normalized_steps, normalized_tasks, analysis_order, merged_nodes, merged_symbols, merged_children, deep_walk, nodes_by_kind, crate_names, diff_render, json_ratios, gate_names, source_lines, sarif_document, scaffold_findings,
    )
}

_W, _CHAIN = diffs._W, diffs._CHAIN
_S = planning._STEPS
_READ = """k AS (SELECT o_orderkey AS plan FROM orders), lv(n, s) AS (VALUES (0, 'high'), (1, 'medium'), (2, 'low')),
dx AS (SELECT plan, n, 'd' || n AS old, 'c' || n AS code, (['high', 'medium', 'low'])[(plan + n) % 3 + 1] AS severity, 'f' || (plan * n % 4) || '.go' AS file, CAST((plan + n) % 3 AS INTEGER) AS line, CASE WHEN n = 2 THEN '' ELSE 'Sym_' || (plan % 5) || '_' || n END AS symbol FROM k, (VALUES (1), (2), (3)) v(n)),
dn AS (SELECT *, row_number() OVER (PARTITION BY plan ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, file, CASE WHEN line = 0 THEN 2147483647 ELSE line END, code, symbol) AS no FROM dx),
s0 AS (SELECT plan, 1 AS i, 'r1' AS recipe, 'f.go' AS file, 'low' AS risk FROM k UNION ALL SELECT plan, 2, CASE WHEN plan % 3 = 0 THEN '' ELSE 'r2' END, 'a/b.d.tsx', (['high', 'medium', 'low'])[plan % 3 + 1] FROM k UNION ALL SELECT plan, 3, 'r3', '?.go', 'odd' FROM k),
sn AS (SELECT *, row_number() OVER (PARTITION BY plan ORDER BY CASE risk WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 0 END, file, recipe) AS no FROM s0)"""
SQL = {
    "source_lines": f"""WITH {T.SOURCES_SQL}, l AS (SELECT path, string_split(content, chr(10)) AS l FROM src WHERE file_id % 9 <> 0 AND content <> '') SELECT path, len(l) AS n, CAST(len(l) AS INTEGER) AS last, l[-1] AS text FROM l""",
    "sarif_document": f"""WITH {T.FINDINGS_SQL}, c AS (SELECT count(*) FILTER (severity = 'high') AS e, count(*) FILTER (severity = 'medium') AS w, count(*) FILTER (severity = 'low') AS n, count(DISTINCT code) AS r FROM fd),
o AS (SELECT *, row_number() OVER (ORDER BY diag_idx) - 1 AS place FROM fd), g AS (SELECT code, count(*) AS n, min(place) AS first, sum(line) AS lines FROM o GROUP BY 1)
SELECT '2.1.0' AS version, CAST(c.r AS INTEGER) AS rules, CAST(c.e AS INTEGER) AS "errorCount", CAST(c.w AS INTEGER) AS "warningCount", CAST(c.n AS INTEGER) AS "noteCount", code AS rule, g.n AS n, CAST(first AS INTEGER) AS first, CAST(lines AS BIGINT) AS lines, CAST(row_number() OVER (ORDER BY first) - 1 AS INTEGER) AS rule_index FROM g, c""",
    "scaffold_findings": """WITH k AS (SELECT o_orderkey AS diff_id, o_custkey % 9 AS t, (o_custkey % 16) / 16.0 AS p, o_orderkey % 40 AS r FROM orders)
SELECT diff_id, 'agent.test-to-code-imbalance' AS code, 'medium' AS severity, 'Test-to-logic ratio is ' || t || '.0 (threshold: 3.0) with no reusable scaffold' AS message FROM k WHERE t > 3 AND 30 > r
UNION ALL SELECT diff_id, 'agent.productive-scaffold', 'low', 'Productive scaffold ratio is ' || printf('%.2f', CAST(p AS DOUBLE)) || ' with ' || r || ' reusable lines' FROM k WHERE p > 0.5 AND r >= 20""",
    "task_files": f"{_W}, {_CHAIN} SELECT fs.diff_id, ti.task_id, fs.path FROM fs JOIN ti ON fs.diff_id = ti.diff_id AND ti.category = {diffs._CAT.replace('path', 'fs.path')}",
    "task_goals": f"{_W}, {_CHAIN} SELECT diff_id, task_id, CASE WHEN task_no % 2 = 0 THEN 'plan of ' || diff_id ELSE goal END AS goal FROM ti",
    "review_envelopes": f"""{_W}, {diffs._VERDICT}, {diffs._FOUND}, cd AS (SELECT diff_id, string_agg(code, ',' ORDER BY ord) AS codes FROM found GROUP BY 1)
SELECT vr.diff_id, status, 'agent-safety' AS spec, CASE status WHEN 'fail' THEN 'decompose' ELSE 'review' END AS recommendation, changed, isinf(test_to_logic) AS unbounded, coalesce(codes, '') AS codes FROM vr JOIN rt USING (diff_id) LEFT JOIN cd USING (diff_id)""",
    "public_plans": f"""{_S}, c AS (SELECT plan, count(*) AS findings FROM od GROUP BY 1), s AS (SELECT plan, count(*) AS steps FROM st GROUP BY 1)
SELECT plan, '0.1' AS specversion, printf('grp_%08d', plan) AS id, 'dev.refactor.plan' AS type, CASE WHEN plan % 3 = 0 THEN 'auto' ELSE 'go' END AS language, CAST(findings AS INTEGER) AS findings, CAST(coalesce(steps, 0) AS INTEGER) AS steps, 'tests' AS command, true AS required, 'binding-default' AS source, 'medium' AS confidence
FROM c LEFT JOIN s USING (plan)""",
    "public_findings": f"""{_S} SELECT plan, 'diag_' || (diag_no - 1) AS id, code, severity, CASE WHEN diag_idx % 5 = 0 THEN 'low' ELSE 'high' END AS confidence, file, line, CASE WHEN diag_idx % 3 <> 0 THEN symbol WHEN diag_idx % 6 = 0 THEN 'Comp' END AS symbol FROM od""",
    "public_steps": f"""{_S} SELECT plan, printf('step_%03d', step_no) || '_' || code || '_' || replace(lower(symbol), '_', '-') AS id, recipe AS title, file, risk, 'diag_' || (diag_no - 1) AS requires, CAST(len(string_split(verify, ';')) AS INTEGER) AS checks FROM st""",
    "public_packs": f"""SELECT conv_id, '0.1' AS specversion, 'dev.refactor.context' AS type, 'grp_' || conv_id AS "planId", {diffs.LINES} AS most, CAST(count(*) AS INTEGER) AS estimate, array_to_string(list_sort(list(DISTINCT role)), ',') AS files FROM conversations GROUP BY conv_id""",
    "normalized_findings": f"WITH {_READ} SELECT plan, printf('diag_%03d', no) AS id, code, severity, file, line FROM dn",
    "normalized_steps": f"""WITH {_READ}, a AS (SELECT plan, max(no) FILTER (n = 1) AS one, max(no) FILTER (n = 2) AS two, max(symbol) FILTER (n = 1) AS name FROM dn GROUP BY 1)
SELECT plan, printf('step_%03d', no) || '_' || CASE i WHEN 1 THEN 'c2_' || replace(lower(name), '_', '-') WHEN 2 THEN CASE WHEN recipe = '' THEN 'unknown' ELSE recipe END || '_bd' ELSE 'r3_target' END AS id, recipe, risk,
CASE i WHEN 1 THEN printf('diag_%03d,diag_%03d', two, one) WHEN 2 THEN 'zz' ELSE '' END AS requires FROM sn JOIN a USING (plan)""",
    "normalized_tasks": """SELECT o_orderkey AS plan, place, id, CASE id WHEN 't1' THEN 'z' ELSE 'a,a' || (o_orderkey % 7) || ',b' END AS files, 't1,t3' AS after FROM orders, (VALUES (0, 't1'), (1, 't2')) v(place, id)""",
    "analysis_order": f"""WITH {T.FINDINGS_SQL} SELECT diag_idx, plan, CAST(row_number() OVER (PARTITION BY plan ORDER BY {planning._RANK('severity')}, code, message, diag_idx) AS INTEGER) AS ts_place,
CAST(row_number() OVER (PARTITION BY plan ORDER BY {planning._RANK('severity')}, code, file, line, symbol, message, diag_idx) AS INTEGER) AS go_place FROM fd""",
    "merged_nodes": "SELECT 'p' || p_partkey AS node_id, CASE WHEN p_partkey % 3 > 0 THEN upper(p_name) ELSE p_name END AS name FROM part",
    "merged_symbols": """WITH l AS (SELECT left(p_name, 6) AS name, min('p' || p_partkey) AS node_id FROM part WHERE p_partkey % 3 < 2 GROUP BY 1), r AS (SELECT lower(left(upper(p_name), 6)) AS name, min('p' || p_partkey) AS node_id FROM part WHERE p_partkey % 3 > 0 GROUP BY 1)
SELECT * FROM l UNION ALL SELECT * FROM r WHERE name NOT IN (SELECT name FROM l)""",
    "merged_children": """WITH e AS (SELECT 'r' || n_regionkey AS parent_id, 'n' || n_nationkey AS node_id, 0 AS side, n_nationkey AS ord FROM nation UNION ALL SELECT 'r' || (s_nationkey % 7), 's' || s_suppkey, 1, -s_suppkey FROM supplier)
SELECT parent_id, node_id, CAST(row_number() OVER (PARTITION BY parent_id ORDER BY side, ord) AS INTEGER) AS ord FROM e""",
    "deep_walk": """WITH RECURSIVE e AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey > 8 THEN s_suppkey - 4 END AS up FROM supplier WHERE s_suppkey > 4),
w AS (SELECT k, 0 AS depth, '0/' || printf('%010d', k) AS path FROM e WHERE up IS NULL UNION ALL SELECT e.k, w.depth + 1, w.path || '/' || printf('%010d', e.k) FROM w JOIN e ON e.up = w.k)
SELECT 's' || k AS node_id, CAST(depth AS INTEGER) AS depth, path FROM w UNION ALL SELECT 's' || s_suppkey, 0, '1/' || printf('%010d', s_suppkey) FROM supplier WHERE s_suppkey < 5""",
    "nodes_by_kind": f"SELECT file, node_id, name FROM ({code.SQL['node_graph']}) WHERE kind = 'hook' AND name LIKE '%Effect'",
    "crate_names": """SELECT 'a' || (p_partkey % 5) || '/b' || (p_partkey % 3) || '/src/f' || p_partkey || '.rs' AS path, CASE WHEN p_partkey % 5 = 0 THEN 'zero' WHEN p_partkey % 5 = 1 AND p_partkey % 3 = 1 THEN 'deep' WHEN p_partkey % 5 = 1 THEN 'one' ELSE '' END AS crate FROM part""",
    "diff_render": f"{_W} SELECT diff_id, file_idx, path, added, deleted FROM fs",
    "json_ratios": f"{_W} SELECT diff_id, isinf(test_to_logic) AS missing, CASE WHEN isinf(test_to_logic) THEN 'true' ELSE 'false' END AS infinite, round(overhead, 9) AS overhead FROM rt",
    "gate_names": """WITH k AS (SELECT n_nationkey AS k, n_name AS repo FROM nation), r AS (
SELECT repo, 1 AS ord, 'version' AS name, 'fail' AS status, 'version "v1" is not MAJOR.MINOR' AS message FROM k WHERE k % 4 = 0
UNION ALL SELECT repo, 2, 'receipt', 'warn', 'receipt format "xml" is neither json nor yaml' FROM k WHERE k % 5 = 0 AND k % 2 = 0
UNION ALL SELECT repo, 3, 'PreFlight', 'warn', 'gate "PreFlight" differs only in case from "preflight"' FROM k WHERE k % 3 = 0
UNION ALL SELECT repo, 4, n, 'warn', 'unknown gate "' || n || '"' FROM k, (VALUES ('PreFlight'), ('own')) v(n) WHERE k % 3 = 0
UNION ALL SELECT repo, 5, 'preflight', (['pass', 'warn', 'fail'])[k % 3 + 1], (['preflight gate configured correctly', 'preflight gate exists but is not marked required', 'preflight gate not configured'])[k % 3 + 1] FROM k)
SELECT repo, name, status, message FROM r JOIN k USING (repo) WHERE k % 4 > 0 OR ord = 1""",
}
