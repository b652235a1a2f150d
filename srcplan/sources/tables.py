"""Relations of the engine made from general tables, so that every operator can run over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Paths by l_partkey % 10; P and S stand for the part and the supplier.
TEMPLATES = ["internal/s{S%7}/p{P}.go", "internal/s{S%7}/p{P}_test.go", "web/ui/c{P}.tsx", "web/ui/c{P}.test.tsx", "db/migrations/m{P}.sql", "config/app{S}.yaml", "go.sum", "docs/d{P}.md", ".github/workflows/w{S}.yml", "styles/s{P}.css"]
_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
SEVERITY = "CASE WHEN value >= 75 THEN 'high' WHEN value >= 25 THEN 'medium' ELSE 'low' END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _path_sql(cat) -> str:
    """A CASE over the templates; cat joins the SQL of the parts."""
    arms = []
    for k, t in enumerate(TEMPLATES):
        parts = t.replace("{S%7}", "\0l_suppkey % 7\0").replace("{S}", "\0l_suppkey\0").replace("{P}", "\0l_partkey\0").split("\0")
        arms.append(f"WHEN {k} THEN " + cat([f"'{p}'" if i % 2 == 0 else f"CAST({p} AS VARCHAR(20))" for i, p in enumerate(parts) if p]))
    return "CASE l_partkey % 10 " + " ".join(arms) + " END"


def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(diff_id, file_idx, path, added, deleted): an order is a diff, a line item a changed file."""
    w = Window.partitionBy("l_orderkey").orderBy(*_ORDER)
    path = _path_sql(lambda p: f"concat({', '.join(p)})").replace("VARCHAR(20)", "STRING")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("diff_id"), F.row_number().over(w).alias("file_idx"), F.expr(path).alias("path"), F.floor("l_quantity").cast("int").alias("added"), F.round(F.col("l_discount") * 100).cast("int").alias("deleted")
    )


FILES_SQL = f"""
raw AS (SELECT l_orderkey AS diff_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(_ORDER)}) AS INTEGER) AS file_idx,
  {_path_sql(" || ".join)} AS path, CAST(floor(l_quantity) AS INTEGER) AS added, CAST(round(l_discount * 100) AS INTEGER) AS deleted FROM lineitem),
fs AS (SELECT *, added + deleted AS changed, path = 'go.sum' AS is_generated, path = 'go.sum' AS is_lockfile,
  CASE WHEN path LIKE 'internal/%' THEN 'library' WHEN path LIKE '%.tsx' THEN 'typescript' WHEN path LIKE '%.css' THEN 'style' WHEN path LIKE '%.y%ml' THEN 'config'
       WHEN path LIKE '%.md' THEN 'documentation' ELSE 'other' END AS category FROM raw),
tot AS (SELECT diff_id, count(*) AS files, CAST(sum(added) AS BIGINT) AS added, CAST(sum(deleted) AS BIGINT) AS deleted, CAST(sum(changed) AS BIGINT) AS changed, max(changed) AS largest_delta,
  bool_or(is_generated) AS has_generated, bool_or(is_lockfile) AS has_lockfile, false AS has_binary, false AS has_rename, list_sort(list(DISTINCT category)) AS categories FROM fs GROUP BY diff_id),
bk AS (SELECT *, CASE WHEN is_generated THEN 'generated' WHEN path LIKE '%\\_test.go' ESCAPE '\\' OR path LIKE '%.test.%' THEN 'test' WHEN path LIKE '%.github/%' THEN 'config_structural'
  WHEN path LIKE '%.css' THEN 'config_data' ELSE 'logic' END AS bucket FROM fs WHERE added > 0),
eph AS (SELECT *, CASE WHEN bucket IN ('logic', 'test') THEN least(added, CAST(round(added * (CASE WHEN path LIKE '%.go' THEN 0.10 ELSE 0.05 END)::DOUBLE) AS INTEGER)) ELSE 0 END AS passing FROM bk),
bs AS (SELECT d.diff_id, CAST(coalesce(sum(e.added - passing) FILTER (bucket = 'logic'), 0) AS BIGINT) AS logic, CAST(coalesce(sum(e.added - passing) FILTER (bucket = 'test'), 0) AS BIGINT) AS test,
  CAST(coalesce(sum(passing), 0) AS BIGINT) AS ephemeral, CAST(0 AS BIGINT) AS reusable, CAST(coalesce(sum(e.added) FILTER (bucket = 'config_data'), 0) AS BIGINT) AS config_data,
  CAST(coalesce(sum(e.added) FILTER (bucket = 'config_structural'), 0) AS BIGINT) AS config_structural, CAST(coalesce(sum(e.added) FILTER (bucket = 'generated'), 0) AS BIGINT) AS generated
  FROM tot d LEFT JOIN eph e USING (diff_id) GROUP BY d.diff_id),
rt AS (SELECT diff_id, CASE WHEN logic + ephemeral + config_structural = 0 THEN 0.0 ELSE (ephemeral + config_structural) / (logic + ephemeral + config_structural)::DOUBLE END AS overhead,
  CASE WHEN logic > 0 THEN test / logic::DOUBLE WHEN test > 0 THEN CAST('inf' AS DOUBLE) ELSE 0.0 END AS test_to_logic, CAST(0 AS DOUBLE) AS productive FROM bs),
pw AS (SELECT diff_id, file_idx, path, list_distinct(list_filter(string_split_regex(path, '[/.]'), lambda x: x <> '')) AS words FROM fs WHERE NOT is_generated),
sim AS (SELECT x.diff_id, x.file_idx AS a, y.file_idx AS b, len(list_intersect(x.words, y.words)) / (len(x.words) + len(y.words) - len(list_intersect(x.words, y.words)))::DOUBLE AS jaccard
  FROM pw x JOIN pw y ON x.diff_id = y.diff_id AND x.file_idx < y.file_idx),
coh AS (SELECT t.diff_id, round(coalesce(1 - avg(s.jaccard), 0.0), 12) AS variance FROM tot t LEFT JOIN sim s USING (diff_id) GROUP BY t.diff_id)
"""


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, path, content, lines): a document is a file."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("file_id"), F.concat_ws("/", "source", "lang", F.concat(F.lit("doc_"), "doc_id", F.lit(".md"))).alias("path"), F.col("text").alias("content"), F.size(F.split("text", "\n", -1)).alias("lines"))


SOURCES_SQL = "src AS (SELECT doc_id AS file_id, source || '/' || lang || '/doc_' || doc_id || '.md' AS path, text AS content, CAST(len(string_split(text, chr(10))) AS INTEGER) AS lines FROM documents)"

#: Codes of findings that stand for event types.
CODES = {"click": "go.long-function", "error": "go.high-complexity", "purchase": "react.too-many-hooks", "signup": "agent.low-cohesion", "view": "react.complex-conditionals"}


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(diag_idx, plan, code, severity, file, line, symbol, message): an event is a finding; plan is its user's id modulo 97."""
    e = table(spark, sf_dir, "events")
    code = F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv])[F.col("event_type")]
    return e.select(
        F.col("event_id").alias("diag_idx"),
        (F.col("user_id") % 97).alias("plan"),
        code.alias("code"),
        F.expr(SEVERITY).alias("severity"),
        F.concat(F.lit("src/u"), F.col("user_id") % 53, F.lit(".go")).alias("file"),
        (F.col("event_id") % 40).cast("int").alias("line"),
        F.concat(F.lit("Fn_"), F.col("user_id")).alias("symbol"),
        F.concat(F.lit("event "), F.col("event_id")).alias("message"),
    )


FINDINGS_SQL = (
    "fd AS (SELECT event_id AS diag_idx, user_id % 97 AS plan, CASE event_type "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CODES.items())
    + f" END AS code, {SEVERITY} AS severity, 'src/u' || (user_id % 53) || '.go' AS file, CAST(event_id % 40 AS INTEGER) AS line, 'Fn_' || user_id AS symbol, 'event ' || event_id AS message FROM events)"
)
