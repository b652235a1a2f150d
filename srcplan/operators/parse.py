"""From source files to functions, components and modules. Files are parsed where they lie; a file is parsed whole by one task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from srcplan.functions import text
from srcplan.parsers import golang, rust, tsx

FUNCTIONS = "lang string, file string, name string, receiver string, line int, end_line int, lines int, complexity int, nesting int, params int, ignored_errors int, typed boolean, is_pub boolean, is_async boolean, is_unsafe boolean"
_SPOT = "array<struct<name:string,line:int>>"
_HOOKS = "array<struct<name:string,line:int,args:array<string>>>"
_COMPONENT = (
    f"struct<name:string,kind:string,start_line:int,end_line:int,lines:int,hooks:{_HOOKS},jsx:array<struct<element:string,line:int>>,props:array<struct<name:string,type:string,required:boolean,line:int>>,"
    f"states:array<struct<name:string,line:int,has_updater:boolean>>,effects:{_SPOT},handlers:{_SPOT},conditionals:int,loops:int,has_keydown:boolean,has_analytics:boolean,exported:boolean,default_export:boolean>"
)
MODULES = f"file string, lang string, lines int, imports array<struct<source:string,default:string,names:array<string>>>, components array<{_COMPONENT}>, hooks {_HOOKS}"
#: Files whose functions, components and modules a worker holds as Python objects at once.
FILES = 256
_PARSERS = {"go": golang.parse, "rust": rust.parse}
TAGS = {".tsx": "typescriptreact", ".ts": "typescript", ".jsx": "javascriptreact", ".js": "javascript"}


def _arrow(df: DataFrame, ddl: str, rows_of) -> DataFrame:
    schema = T._parse_datatype_string(ddl)
    shape = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, FILES):
                batch = whole.slice(at, FILES)
                cols = {n: batch.column(n).to_pylist() for n in batch.schema.names}
                rows = [r for i in range(batch.num_rows) for r in rows_of({n: c[i] for n, c in cols.items()})]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=shape)

    return df.mapInArrow(run, schema)


def functions(files: DataFrame) -> DataFrame:
    """A row for each function of Go and Rust files (lang, path, content); other files and null contents give none."""

    def rows(f: dict) -> list[dict]:
        found = _PARSERS[f["lang"]](f["content"] or "")
        return [{"lang": f["lang"], "file": f["path"], "is_pub": None, "is_async": None, "is_unsafe": None} | x for x in found]

    return _arrow(files.filter(F.col("lang").isin(*_PARSERS)).select("lang", "path", "content"), FUNCTIONS, rows)


def modules(files: DataFrame) -> DataFrame:
    """A row for each TypeScript or JavaScript file (path, content): its imports, components and the hooks outside of components."""

    def rows(f: dict) -> list[dict]:
        content, ext = f["content"] or "", f["ext"]
        return [{"file": f["path"], "lang": TAGS[ext], "lines": content.count("\n") + 1} | tsx.parse(content, ext)]

    ext = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    return _arrow(files.select("path", "content", ext.alias("ext")).filter(F.col("ext").isin(*TAGS)), MODULES, rows)


def components(modules: DataFrame) -> DataFrame:
    """A row for each component of modules(), in the shape of rules.component_findings."""
    c = modules.select("file", F.posexplode("components").alias("n", "c"))
    names = lambda col, field: F.transform(F.col(f"c.{col}"), lambda x: x[field])
    return c.select(
        F.concat_ws("#", "file", "n").alias("component_id"),
        "file",
        F.col("c.name"),
        F.col("c.kind"),
        F.col("c.start_line"),
        F.col("c.end_line"),
        F.col("c.lines"),
        names("hooks", "name").alias("hooks"),
        names("jsx", "element").alias("jsx"),
        F.col("c.props"),
        F.size("c.states").alias("states"),
        F.size("c.effects").alias("effects"),
        F.col("c.conditionals"),
        F.col("c.loops"),
        F.col("c.has_keydown"),
        F.col("c.has_analytics"),
        F.col("c.exported"),
        F.col("c.default_export"),
    )


def file_sizes(files: DataFrame) -> DataFrame:
    """(path, lang, lines)."""
    return files.select("path", "lang", text.line_count(F.coalesce("content", F.lit(""))).alias("lines"))


def outside(points: DataFrame, spans: DataFrame) -> DataFrame:
    """The points (file, name, line) that no span (file, start_line, end_line) of their file covers, once for each name and line."""
    s = spans.select(F.col("file").alias("_file"), "start_line", "end_line")
    inside = (points["file"] == s["_file"]) & points["line"].between(s["start_line"], s["end_line"])
    return points.join(s, inside, "left_anti").dropDuplicates(["file", "name", "line"])


def merged_imports(rows: DataFrame) -> DataFrame:
    """(file, source, default, names) of import clauses (file, source, ord, default, name): the first default wins, names keep their first place."""
    w = Window.partitionBy("file", "source", "name").orderBy("ord")
    first = rows.withColumn("again", F.row_number().over(w) > 1)
    return first.groupBy("file", "source").agg(
        F.min_by("default", F.when(F.coalesce("default", F.lit("")) != "", F.col("ord"))).alias("default"),
        F.transform(F.array_sort(F.collect_list(F.when(~F.col("again") & (F.coalesce("name", F.lit("")) != ""), F.struct("ord", "name")))), lambda x: x["name"]).alias("names"),
    )


def crates(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """(path, crate) of each file: the name in the nearest Cargo.toml (path, content) at or above its folder, '' without one."""
    name = F.regexp_extract("content", r'(?m)^[ \t]*name[ \t]*=[ \t]*"([^"\n]*)"', 1)
    m = manifests.select(F.regexp_replace("path", r"/?Cargo\.toml$", "").alias("dir"), name.alias("crate"))
    parts = F.split(F.regexp_replace("path", r"/?[^/]*$", ""), "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    near = files.select("path", F.explode(F.array_distinct(up)).alias("dir")).join(m, "dir").groupBy("path").agg(F.max_by("crate", F.length("dir")).alias("crate"))
    return files.select("path").distinct().join(near, "path", "left").select("path", F.coalesce("crate", F.lit("")).alias("crate"))
