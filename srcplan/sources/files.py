"""Source trees, diffs and JSON documents as DataFrames, and which language a tree is in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from srcplan.plans.validate import PLAN

#: Folders that a scan passes over, by kind of scan. `.*` stands for every folder that begins with a dot.
SKIPPED = {
    "go": (".*", "build", "coverage", "dist", "node_modules", "out", "vendor"),
    "ts": (".*", "build", "coverage", "dist", "node_modules"),
    "graph": (".git", ".next", "build", "coverage", "dist", "node_modules"),
    "rust": (".*", "build", "dist", "node_modules", "target"),
}
GLOBS = {"go": "*.go", "ts": "*.{ts,tsx,js,jsx}", "graph": "*.{ts,tsx,js,jsx}", "rust": "*.rs"}
ALIASES = {"go": "go", "golang": "go", "js": "ts", "javascript": "ts", "jsx": "ts", "react": "ts", "rs": "rust", "rust": "rust", "ts": "ts", "tsx": "ts", "typescript": "ts"}


def skipped(relative: Column, kind: str, exclude: tuple[str, ...] = ()) -> Column:
    """Whether a folder on the way to a file is one to pass over."""
    names = {*SKIPPED[kind], *exclude}
    folders = F.slice(F.split(relative, "/"), F.lit(1), F.greatest(F.size(F.split(relative, "/")) - 1, F.lit(0)))
    dotted = ".*" in names
    return F.exists(folders, lambda x: x.isin(*(names - {".*"})) | (F.lit(dotted) & x.startswith(".")))


def tree(spark: SparkSession, root: str, kind: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(lang, path, content) of the source files under root, path relative to it. Go leaves out tests, as the analysis does; Spark reads no empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", GLOBS[kind]).load(root)
    base = root.rstrip("/").removeprefix("file://").removeprefix("file:")
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/+", "/"), "^/*" + _literal(base.lstrip("/")) + "/", "")
    out = files.select(path.alias("path"), F.decode("content", "UTF-8").alias("content")).filter(~skipped(F.col("path"), kind, exclude))
    if kind == "go":
        out = out.filter(~F.col("path").endswith("_test.go"))
    return out.select(F.lit({"graph": "ts"}.get(kind, kind)).alias("lang"), "path", "content")


def _literal(s: str) -> str:
    return "".join(c if c.isalnum() or c in "/_-" else "\\" + c for c in s)


def diffs(spark: SparkSession, path: str) -> DataFrame:
    """(diff_id, text): a file is a diff, known by its path."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("diff_id"), F.col("value").alias("text"))


def plans(spark: SparkSession, path: str) -> DataFrame:
    """Plan documents, one a file, in the shape that validate.errors takes; plan is the file's path."""
    return spark.read.schema(PLAN).option("multiLine", True).json(path).select(F.col("_metadata.file_path").alias("plan"), "*")


DECOMPOSITION = "strategy string, parentPlan string, tasks array<struct<id:string,goal:string,allowedFiles:array<string>,forbiddenFiles:array<string>,maxDiffLines:int,parallelizable:boolean,dependsOn:array<string>,verification:array<string>>>"
RESULT = "status string, commands array<struct<name:string,command:string,status:string,exitCode:int,required:boolean>>"


def decompositions(spark: SparkSession, path: str) -> DataFrame:
    """(file, task_no, task_id, goal, allowed_files, ...) of decomposition documents, one a file: what pack.for_task and handoff.work_orders take."""
    d = spark.read.schema(DECOMPOSITION).option("multiLine", True).json(path).select(F.col("_metadata.file_path").alias("file"), F.posexplode("tasks").alias("n", "t"))
    none = F.array().cast("array<string>")
    listed = lambda c: F.coalesce(F.col(f"t.{c}"), none)
    return d.select(
        "file", (F.col("n") + 1).alias("task_no"), F.col("t.id").alias("task_id"), F.col("t.goal").alias("goal"), listed("allowedFiles").alias("allowed_files"), listed("forbiddenFiles").alias("forbidden_files"), F.col("t.maxDiffLines").alias("max_lines"),
        F.coalesce("t.parallelizable", F.lit(False)).alias("parallelizable"), listed("dependsOn").alias("depends_on"), listed("verification").alias("verification"),
    )


def verifications(spark: SparkSession, path: str) -> DataFrame:
    """(file, verification): the status of verification results, one a file, as handoff.receipts takes it; `unknown` where none is said."""
    r = spark.read.schema(RESULT).option("multiLine", True).json(path)
    return r.select(F.col("_metadata.file_path").alias("file"), F.coalesce(F.nullif("status", F.lit("")), F.lit("unknown")).alias("verification"))


#: Files whose content readiness looks at; of others it is enough that they are there.
TOLD = r"(^|/)(package\.json|Makefile|README\.md|AGENTS\.md|\.gitignore|Cargo\.toml|go\.mod|requirements\.txt|pyproject\.toml|tsconfig\.json|Dockerfile|vercel\.json|convex\.json|middleware\.ts|next\.config\.[jt]s|\.env[.a-z]*|[^/]*\.ya?ml|(launchkit|preflight|manifest)\.json)$"


#: Names that begin with a dot and matter to readiness. Spark lists none unless it is told of them.
DOTTED = "{.github,.agent,.opencode,.grp,.env*,.gitignore,.golangci.y*ml,.eslintrc*}"


def repo_facts(spark: SparkSession, root: str) -> DataFrame:
    """(repo, rel_path, is_dir, content) of the repositories that are the folders right below root: what readiness takes. Files of .git, node_modules and the like are left out; folders follow from their files."""
    base = _literal(root.rstrip("/").removeprefix("file://").removeprefix("file:").lstrip("/"))
    dotted = f"{root.rstrip('/')}/*/{DOTTED}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(dotted)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load([root, *([dotted] if there else [])])
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/+", "/"), "^/*" + base + "/", "")
    out = files.select(F.substring_index(path, "/", 1).alias("repo"), F.regexp_replace(path, "^[^/]*/", "").alias("rel_path"), path.contains("/").alias("inside"), "content").filter("inside")
    out = out.filter(~F.exists(F.split("rel_path", "/"), lambda x: x.isin(".git", "node_modules", "target", "dist", "build")))
    return out.select("repo", "rel_path", F.lit(False).alias("is_dir"), F.when(F.col("rel_path").rlike(TOLD), F.decode("content", "UTF-8")).alias("content"))


def lines(files: DataFrame) -> DataFrame:
    """(path, line, text). An empty file has no line here, though it counts as one."""
    return files.filter(F.length("content") > 0).select("path", F.posexplode(F.split("content", "\n", -1)).alias("n", "text")).select("path", (F.col("n") + 1).alias("line"), "text")


def language(facts: DataFrame, said: str = "auto") -> DataFrame:
    """(repo, lang) of facts (repo, rel_path): what was said, else by Cargo.toml, by go.mod, by the files there are; ts if nothing tells."""
    if said != "auto":
        return facts.select("repo").distinct().withColumn("lang", F.lit(ALIASES.get(said.lower(), said)))
    p = F.col("rel_path")
    has = lambda c: F.bool_or(c)
    seen = facts.groupBy("repo").agg(has(p == "Cargo.toml").alias("cargo"), has(p == "go.mod").alias("mod"), has(p.endswith(".go") & ~skipped(p, "go")).alias("go"), has(p.rlike(r"\.[jt]sx?$") & ~skipped(p, "go")).alias("ts"))
    return seen.select("repo", F.when(F.col("cargo"), "rust").when(F.col("mod") | (F.col("go") & ~F.col("ts")), "go").otherwise("ts").alias("lang"))
