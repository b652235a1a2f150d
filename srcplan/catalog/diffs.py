"""Queries over changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcplan.operators import decompose, diff, review, structural
from srcplan.sources import tables as T

#: Budgets under which the tables hold all three verdicts.
LINES, FILES = 100, 5


def _files(spark: SparkSession, d: str) -> DataFrame:
    return diff.facts(T.changed_files(spark, d))


def diff_totals(spark: SparkSession, d: str) -> DataFrame:
    return diff.totals(_files(spark, d)).withColumn("categories", F.array_join("categories", ","))


def review_verdict(spark: SparkSession, d: str) -> DataFrame:
    return review.verdict(diff.totals(_files(spark, d)), LINES, FILES).select("diff_id", "changed", "files", "status", "recommendation", "reason")


def _kinds(files: DataFrame) -> DataFrame:
    return structural.ratios(structural.buckets(files), "ephemeral", "reusable").join(structural.cohesion(files), "diff_id")


def review_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return review.profiled(_files(spark, d), LINES, FILES)[1].select("diff_id", "code", "severity", "confidence", "message")


def structural_buckets(spark: SparkSession, d: str) -> DataFrame:
    return structural.buckets(_files(spark, d))


def structural_ratios(spark: SparkSession, d: str) -> DataFrame:
    return structural.ratios(structural.buckets(_files(spark, d))).select("diff_id", *[structural.rounded(F.col(c)).alias(c) for c in ("overhead", "test_to_logic", "productive")])


def cohesion_variance(spark: SparkSession, d: str) -> DataFrame:
    return structural.cohesion(_files(spark, d)).select("diff_id", structural.rounded(F.col("variance")).alias("variance"))


def cohesion_clusters(spark: SparkSession, d: str) -> DataFrame:
    return structural.clusters(_files(spark, d))


def decompose_tasks(spark: SparkSession, d: str) -> DataFrame:
    t = decompose.by_category(_files(spark, d))
    return t.select("diff_id", "task_no", "task_id", "category", "goal", F.array_join("allowed_files", ",").alias("allowed_files"), "max_lines", "parallelizable", F.array_join("verification", ";").alias("verification"))


def decompose_dependencies(spark: SparkSession, d: str) -> DataFrame:
    return decompose.by_category(_files(spark, d)).select("diff_id", "task_id", F.explode("depends_on").alias("depends_on"))


def decompose_clusters(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d)
    t = decompose.by_cluster(structural.clusters(f), f)
    return t.select("diff_id", "task_no", "task_id", "goal", F.array_join("allowed_files", ",").alias("allowed_files"), "max_lines", "parallelizable", F.array_join("depends_on", ",").alias("depends_on"), F.array_join("verification", ";").alias("verification"))


def workorder_steps(spark: SparkSession, d: str) -> DataFrame:
    """Each task with the steps that touch one of its files: a step for each changed file with 40 added lines or more."""
    f = _files(spark, d)
    steps = f.filter("added >= 40").select(F.col("diff_id"), F.concat(F.lit("step_"), "file_idx").alias("step_id"), F.col("path").alias("file"))
    tasks = decompose.by_category(f).select("diff_id", "task_id", F.explode(F.array_distinct("allowed_files")).alias("file"))
    return tasks.join(steps, ["diff_id", "file"]).select("diff_id", "task_id", "step_id", "file")


def _rendered(spark: SparkSession, d: str) -> DataFrame:
    """A diff text for each document, of five files: its lines by turns as context, added and deleted lines of one hunk; two hunks of a new file; a rename; a binary file; and a file whose hunk ends where a deleted line reads like a header."""
    t = T.table(spark, d, "documents").select(F.col("doc_id").alias("diff_id"), F.split("text", "\n", -1).alias("l"), F.col("doc_id").cast("string").alias("k"), (F.col("doc_id") % 5).cast("int").alias("m"))
    body = F.transform("l", lambda x, i: F.concat(F.element_at(F.array(F.lit(" "), F.lit("+"), F.lit("-")), (i % 3 + 1).cast("int")), x))

    def head(path: str, *more: str) -> F.Column:
        p = F.concat(*[F.col("k") if x == "@" else F.lit(x) for x in path.replace("@", "\0@\0").split("\0") if x])
        return F.concat(F.lit("diff --git a/"), p, F.lit(" b/"), p, *[p if x == "@" else F.lit(x) for x in more])

    edits = ("\nindex 1..2\n--- a/", "@", "\n+++ b/", "@", "\n")
    text = F.concat(
        head("docs/d@.md", *edits), F.lit("@@ -1 +1 @@\n"), F.array_join(body, "\n"), F.lit("\n"),
        head("src/n@.go", "\nnew file mode 100644", *edits), F.lit("@@ -0,0 +1 @@ f\n+one\n"), F.repeat(F.lit("+more\n"), F.col("m")), F.lit("@@ -9 +9 @@\n-old\n \n+new\n\\ No newline at end of file\n"),
        head("old/@.ts"), F.lit("\nsimilarity index 90%\nrename from old/x.ts\nrename to web/"), "k", F.lit(".ts\n"),
        head("img/@.png"), F.lit("\nindex 1..2 100644\nBinary files a/x and b/x differ\n@@ -1 +1 @@\n+lost\n"),
        head("q@.sql", *edits), F.lit("@@ -1 +1 @@\n+a\n"), F.repeat(F.lit("-b\n"), F.col("m")), F.lit("--- comment gone\n+not counted\n-not counted\n@@ -5 +5 @@\n+again"),
    )
    return t.select("diff_id", text.alias("text"))


def diff_parse(spark: SparkSession, d: str) -> DataFrame:
    return diff.facts(diff.parse(_rendered(spark, d))).select("diff_id", "file_idx", "path", "old_path", "added", "deleted", "is_binary", "is_rename", "category")


def diff_tokens(spark: SparkSession, d: str) -> DataFrame:
    return diff.tokens(_rendered(spark, d)).groupBy("token").count().withColumnRenamed("count", "n")


QUERIES = {
    f.__name__: f
    for f in (diff_totals, review_verdict, review_diagnostics, structural_buckets, structural_ratios, cohesion_variance, cohesion_clusters, decompose_tasks, decompose_dependencies, decompose_clusters, workorder_steps, diff_parse, diff_tokens)
}

_W = f"WITH RECURSIVE {T.FILES_SQL}"
_VERDICT = f"""
vd AS (SELECT *, list_filter([CASE WHEN changed > {LINES} THEN 'Diff is ' || changed || ' lines (budget: {LINES})' END, CASE WHEN files > {FILES} THEN 'Diff touches ' || files || ' files (budget: {FILES})' END,
   CASE WHEN has_generated THEN 'Diff includes generated or lockfile changes' END], lambda x: x IS NOT NULL) AS reasons, (changed > {LINES})::INT + (files > {FILES})::INT + (len(categories) > 2)::INT AS n FROM tot),
vs AS (SELECT *, CASE WHEN len(reasons) = 0 AND n = 0 THEN 'pass' WHEN n <= 1 AND changed <= {LINES + review.SLACK} THEN 'warn' ELSE 'fail' END AS status FROM vd),
vr AS (SELECT *, CASE status WHEN 'pass' THEN 'Diff is within reviewability budget' WHEN 'warn' THEN 'Diff approaches budget limits: ' || array_to_string(reasons, '; ') ELSE 'Diff exceeds reviewability budget: ' || array_to_string(reasons, '; ') END AS reason FROM vs)
"""
_FOUND = f"""k AS (SELECT * FROM vr JOIN rt USING (diff_id) JOIN coh USING (diff_id) JOIN (SELECT diff_id, ephemeral, reusable FROM bs) USING (diff_id)),
found AS (SELECT diff_id, 0 AS ord, 'agent.diff-too-large' AS code, 'high' AS severity, 'high' AS confidence, 'Diff is ' || changed || ' lines, exceeds reviewability budget of {LINES}' AS message FROM k WHERE changed > {LINES}
UNION ALL SELECT diff_id, 1, 'agent.too-many-files-touched', 'high', 'high', 'Diff touches ' || files || ' files, exceeds reviewability budget of {FILES}' FROM k WHERE files > {FILES}
UNION ALL SELECT diff_id, 2, 'agent.mixed-boundaries', 'medium', 'medium', 'Diff spans ' || len(categories) || ' categories ([' || array_to_string(categories, ' ') || ']), suggests mixed concerns' FROM k WHERE len(categories) > 2
UNION ALL SELECT diff_id, 3, 'agent.unreviewable-plan', 'high', 'high', reason FROM k WHERE status = 'fail'
UNION ALL SELECT diff_id, 4, 'agent.parallelization-opportunity', 'low', 'medium', 'Diff touches ' || files || ' files which could be parallelized across tasks' FROM k WHERE status = 'fail' AND files > 1
UNION ALL SELECT diff_id, 5, 'agent.high-overhead', 'medium', 'high', 'Structural overhead ratio is ' || printf('%.2f', overhead) || ' (threshold: 0.50)' FROM k WHERE overhead > 0.5
UNION ALL SELECT diff_id, 6, 'agent.low-cohesion', 'medium', 'high', 'Cohesion variance is ' || printf('%.2f', variance) || ' (threshold: 0.60)' FROM k WHERE variance > 0.6
UNION ALL SELECT diff_id, 7, 'agent.test-to-code-imbalance', 'medium', 'medium', 'Test-to-logic ratio is ' || CASE WHEN isinf(test_to_logic) THEN '+Inf' ELSE printf('%.1f', test_to_logic) END || ' (threshold: 3.0) with no reusable scaffold' FROM k WHERE test_to_logic > 3 AND ephemeral > reusable
UNION ALL SELECT diff_id, 8, 'agent.ceremonial-noise', 'high', 'high', 'Diff has high structural overhead and low cohesion — high ceremonial noise' FROM k WHERE overhead > 0.5 AND variance > 0.6)"""
_CAT = "CASE " + " ".join(f"WHEN path LIKE '{p}' ESCAPE '#' THEN '{c}'" for p, c in (("%#_test.go", "test"), ("%.go", "go"), ("%.tsx", "typescript"), ("%.css", "style"), ("%.md", "documentation"), ("%.y%ml", "config"), ("%.sql", "schema"))) + " ELSE 'other' END"
_CHAIN = f"""
pl(cat, place, goal, verification) AS (VALUES {", ".join(f"('{c}', {p}, '{g}', '{';'.join(decompose.CHECKS[x] for x in v)}')" for c, (p, g, v) in decompose.CATEGORIES.items())}),
tc AS (SELECT diff_id, {_CAT} AS category, path, changed FROM fs),
tg AS (SELECT diff_id, category, array_to_string(list_sort(list(path)), ',') AS allowed_files, CAST(sum(changed) AS BIGINT) AS total FROM tc GROUP BY ALL),
tk AS (SELECT tg.*, pl.goal, pl.verification, CAST(row_number() OVER (PARTITION BY diff_id ORDER BY place, category) AS INTEGER) AS task_no FROM tg JOIN pl ON pl.cat = category),
ti AS (SELECT *, 'task_' || lpad(CAST(task_no AS VARCHAR), 3, '0') || '_' || category AS task_id FROM tk)
"""
_GROUPS = f"""
ed AS (SELECT diff_id, a, b FROM sim JOIN coh USING (diff_id) WHERE variance > {structural.LOW_COHESION} AND jaccard >= {structural.SIMILAR}),
both_ways AS (SELECT diff_id, a, b FROM ed UNION SELECT diff_id, b, a FROM ed),
reach AS (SELECT diff_id, a AS id, a AS seen FROM both_ways UNION SELECT r.diff_id, r.id, e.b FROM reach r JOIN both_ways e ON e.diff_id = r.diff_id AND e.a = r.seen),
roots AS (SELECT diff_id, id, min(seen) AS root FROM reach GROUP BY ALL),
cl AS (SELECT diff_id, CAST(dense_rank() OVER (PARTITION BY diff_id ORDER BY root) AS INTEGER) AS cluster, id AS file_idx, path FROM roots JOIN fs ON fs.diff_id = roots.diff_id AND fs.file_idx = roots.id)
""".replace("SELECT diff_id, CAST(dense_rank", "SELECT roots.diff_id, CAST(dense_rank").replace("(PARTITION BY diff_id ORDER BY root)", "(PARTITION BY roots.diff_id ORDER BY root)")
#: The last part that all paths of a list share from the front, else the first part of the first.
_LABEL = "(string_split(fl[1], '/'))[greatest(1, len(list_filter(range(1, len(string_split(fl[1], '/')) + 1), lambda n: len(list_filter(fl, lambda p: (string_split(p, '/'))[1:n] = (string_split(fl[1], '/'))[1:n])) = len(fl))))]"
#: A binary marker closes its file, so a hunk after it counts nothing.
_LOST = "0"
_DOCLINES = "dl AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)"
SQL = {
    "diff_totals": f"{_W} SELECT * REPLACE (array_to_string(categories, ',') AS categories) FROM tot",
    "review_verdict": f"{_W}, {_VERDICT} SELECT diff_id, changed, files, status, CASE status WHEN 'fail' THEN 'decompose' ELSE 'review' END AS recommendation, reason FROM vr",
    "review_diagnostics": f"""{_W}, {_VERDICT}, {_FOUND}, {_GROUPS}, en AS (SELECT diff_id, cluster, '[' || arg_min(path, file_idx) || '...' || arg_max(path, file_idx) || ']' AS e FROM cl GROUP BY ALL), sg AS (SELECT diff_id, ' (suggested clusters: ' || string_agg(e, ', ' ORDER BY cluster) || ')' AS s FROM en GROUP BY 1)
SELECT diff_id, code, severity, confidence, CASE WHEN code = 'agent.low-cohesion' THEN message || coalesce(s, '') ELSE message END AS message FROM found LEFT JOIN sg USING (diff_id)""",
    "structural_buckets": f"{_W} SELECT * FROM bs",
    "structural_ratios": f"{_W} SELECT diff_id, round(overhead, 9) AS overhead, round(test_to_logic, 9) AS test_to_logic, productive FROM rt",
    "cohesion_variance": f"{_W} SELECT diff_id, round(variance, 9) AS variance FROM coh",
    "cohesion_clusters": f"{_W}, {_GROUPS} SELECT diff_id, cluster, file_idx, path FROM cl",
    "decompose_tasks": f"{_W}, {_CHAIN} SELECT diff_id, task_no, task_id, category, goal, allowed_files, greatest(200, total + total // 2) AS max_lines, task_no = 1 AS parallelizable, verification FROM ti",
    "decompose_dependencies": f"{_W}, {_CHAIN} SELECT a.diff_id, a.task_id, b.task_id AS depends_on FROM ti a JOIN ti b ON a.diff_id = b.diff_id AND b.task_no < a.task_no",
    "workorder_steps": f"{_W}, {_CHAIN} SELECT DISTINCT fs.diff_id, ti.task_id, 'step_' || fs.file_idx AS step_id, fs.path AS file FROM fs JOIN ti ON fs.diff_id = ti.diff_id AND ti.category = {_CAT.replace('path', 'fs.path')} WHERE fs.added >= 40",
    "diff_parse": f"""WITH {_DOCLINES}, n AS (SELECT doc_id, count(*) FILTER (i % 3 = 1) AS a, count(*) FILTER (i % 3 = 2) AS d, doc_id % 5 AS m FROM dl GROUP BY doc_id)
SELECT doc_id AS diff_id, CAST(1 AS BIGINT) AS file_idx, 'docs/d' || doc_id || '.md' AS path, '' AS old_path, a AS added, d AS deleted, false AS is_binary, false AS is_rename, 'documentation' AS category FROM n
UNION ALL SELECT doc_id, 2, 'src/n' || doc_id || '.go', '', 2 + m, 1, false, false, 'go' FROM n
UNION ALL SELECT doc_id, 3, 'web/' || doc_id || '.ts', 'old/x.ts', 0, 0, false, true, 'typescript' FROM n
UNION ALL SELECT doc_id, 4, 'img/' || doc_id || '.png', '', {_LOST}, 0, true, false, 'other' FROM n
UNION ALL SELECT doc_id, 5, 'q' || doc_id || '.sql', '', 2, m, false, false, 'other' FROM n""",
    "diff_tokens": f"""WITH {_DOCLINES}, x AS (SELECT CASE i % 3 WHEN 0 THEN 'CTX' WHEN 1 THEN 'ADD' ELSE 'DEL' END AS token, count(*) AS n FROM dl GROUP BY 1
UNION ALL SELECT t, k * count(*) FROM documents, (VALUES ('DIFF', 5), ('INDEX', 4), ('OLD', 4), ('NEWHDR', 3), ('HUNK', 6), ('NEW_FILE', 1), ('SIMILARITY', 1), ('RENAME_FROM', 1), ('RENAME_TO', 1), ('BINARY', 1), ('NOEOL', 1), ('CTX', 1), ('ADD', 6), ('DEL', 2)) v(t, k) GROUP BY t, k
UNION ALL SELECT t, sum(doc_id % 5) FROM documents, (VALUES ('ADD'), ('DEL')) v(t) GROUP BY t) SELECT token, CAST(sum(n) AS BIGINT) AS n FROM x GROUP BY 1""",
    "decompose_clusters": f"""{_W}, {_GROUPS}, sz AS (SELECT diff_id, cluster, list(path ORDER BY file_idx) AS fl FROM cl GROUP BY ALL), nm AS (SELECT *, {_LABEL} AS label FROM sz),
ct AS (SELECT diff_id, cluster AS task_no, printf('task_%03d_cluster_', cluster) || label AS task_id, 'Implement ' || label || ' layer changes' AS goal, fl, CAST(greatest(200, len(fl) * 15) AS BIGINT) AS max_lines,
 array_to_string(list_filter([CASE WHEN len(list_filter(fl, lambda p: p LIKE '%.go')) > 0 THEN 'go build ./...;go vet ./...;go test ./...' END, CASE WHEN len(list_filter(fl, lambda p: p LIKE '%.ts' OR p LIKE '%.tsx')) > 0 THEN 'tsc --noEmit' END,
  CASE WHEN len(list_filter(fl, lambda p: p LIKE '%.sql')) > 0 THEN 'go build ./...' END], lambda x: x IS NOT NULL), ';') AS v FROM nm),
mx AS (SELECT diff_id, max(cluster) + 1 AS n FROM cl GROUP BY 1),
rm AS (SELECT fs.diff_id, n AS task_no, printf('task_%03d_remainder', n) AS task_id, 'Implement remaining changes' AS goal, list(fs.path ORDER BY fs.file_idx) AS fl, CAST(400 AS BIGINT) AS max_lines, '' AS v FROM fs JOIN mx USING (diff_id)
 WHERE NOT EXISTS (SELECT 1 FROM cl WHERE cl.diff_id = fs.diff_id AND cl.path = fs.path) GROUP BY fs.diff_id, n),
bt AS (SELECT * FROM ct UNION ALL SELECT * FROM rm)
SELECT diff_id, CAST(task_no AS INTEGER) AS task_no, task_id, goal, array_to_string(fl, ',') AS allowed_files, max_lines, task_no = 1 AS parallelizable, CASE WHEN task_no = 1 THEN '' ELSE first_value(task_id) OVER (PARTITION BY diff_id ORDER BY task_no) END AS depends_on,
CASE WHEN v = '' THEN 'go build ./...;go test ./...' ELSE v END AS verification FROM bt""",
}
