"""Queries over source files, findings, snippets and trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from srcplan.catalog import samples
from srcplan.functions import paths, text
from srcplan.operators import graph, handoff, pack, parse, rules, summary
from srcplan.sources import tables as T

#: Limits under which documents, which are shorter than source files, give findings.
MAX_LINES, BUDGET, SMALL_BUDGET = 20, 120, 4000


def rule_large_file(spark: SparkSession, d: str) -> DataFrame:
    f = T.source_files(spark, d).withColumn("lang", F.when(F.col("file_id") % 3 == 0, "rust").otherwise("go"))
    return rules.file_findings(f, {"large-file": MAX_LINES}).select("file_id", "code", "severity", "message", "file", "line")


def _tags(spark: SparkSession, d: str) -> DataFrame:
    p = T.table(spark, d, "pages")
    return p.select("page_id", F.regexp_extract_all("html", F.lit(r"<([a-z][a-z0-9]*)"), F.lit(1)).alias("tags"))


def rule_repeated_elements(spark: SparkSession, d: str) -> DataFrame:
    return rules.repeated_elements(_tags(spark, d), "tags", ("page_id",))


def rule_flags(spark: SparkSession, d: str) -> DataFrame:
    keys, tracks = rules.flags(F.col("html"))
    return T.table(spark, d, "pages").select("page_id", keys.alias("has_keydown"), tracks.alias("has_analytics"))


def _prop(name: str, kind: str) -> F.Column:
    return F.struct(F.lit(name).alias("name"), F.lit(kind).alias("type"))


def _components(spark: SparkSession, d: str) -> DataFrame:
    """A page as a component: tags stand for elements, list items for hooks, links for state, headings for effects."""
    keys, tracks = rules.flags(F.col("html"))
    n = lambda tag: F.size(F.filter("tags", lambda x: x == tag))
    p = T.table(spark, d, "pages").join(_tags(spark, d), "page_id")
    return p.select(
        F.col("page_id").cast("string").alias("component_id"),
        F.col("url").alias("file"),
        F.concat(F.lit("Page"), "page_id").alias("name"),
        F.lit(1).alias("start_line"),
        text.line_count(F.col("html")).alias("end_line"),
        text.line_count(F.col("html")).alias("lines"),
        F.filter("tags", lambda x: x == "li").alias("hooks"),
        F.col("tags").alias("jsx"),
        F.when(F.col("page_id") % 3 == 0, F.array(_prop("a", ""), _prop("b", ""))).when(F.col("page_id") % 3 == 1, F.array(_prop("a", ""), _prop("b", "string"))).otherwise(F.array().cast("array<struct<name:string,type:string>>")).alias("props"),
        n("a").alias("states"),
        n("h2").alias("effects"),
        n("p").alias("conditionals"),
        n("div").alias("loops"),
        keys.alias("has_keydown"),
        tracks.alias("has_analytics"),
    )


def rule_mixed_responsibilities(spark: SparkSession, d: str) -> DataFrame:
    f = rules.component_findings(_components(spark, d)).filter("code = 'react.mixed-responsibilities'")
    return f.select(F.col("component_id").cast("long").alias("page_id"), "severity", "message")


def component_findings(spark: SparkSession, d: str) -> DataFrame:
    limits = {"large-component": 3, "too-many-hooks": 4, "too-many-state-vars": 5, "complex-conditionals": 4, "too-many-effects": 1}
    return rules.component_findings(_components(spark, d), limits).select(F.col("component_id").cast("long").alias("page_id"), "code", "severity", "message", "file", "line", "end_line", "component")


def component_labels(spark: SparkSession, d: str) -> DataFrame:
    return rules.responsibilities(_components(spark, d)).select(F.col("component_id").cast("long").alias("page_id"), F.array_join("labels", ",").alias("labels"))


def recipe_matches(spark: SparkSession, d: str) -> DataFrame:
    return rules.recipe_matches(_components(spark, d)).select(F.col("component_id").cast("long").alias("page_id"), "recipe", F.round("confidence", 6).alias("confidence"))


def function_findings(spark: SparkSession, d: str) -> DataFrame:
    """Rules over functions, with line items as functions."""
    li = T.table(spark, d, "lineitem")
    f = li.select(
        F.when(F.col("l_suppkey") % 2 == 0, "go").otherwise("rust").alias("lang"),
        F.concat(F.lit("src/f"), "l_partkey").alias("file"),
        F.concat(F.lit("fn"), "l_orderkey").alias("name"),
        F.when(F.col("l_linenumber") % 3 == 0, F.when(F.col("l_suppkey") % 2 == 0, "(s *S)").otherwise("S")).otherwise("").alias("receiver"),
        F.col("l_linenumber").alias("line"),
        (F.col("l_linenumber") + 9).alias("end_line"),
        (F.floor("l_quantity") * 5).cast("int").alias("lines"),
        F.floor("l_quantity").cast("int").alias("complexity"),
        F.round(F.col("l_discount") * 100).cast("int").alias("nesting"),
        F.round(F.col("l_tax") * 200).cast("int").alias("params"),
        (F.col("l_partkey") % 3).cast("int").alias("ignored_errors"),
        (F.col("l_partkey") % 2 == 0).alias("typed"),
    )
    return rules.function_findings(f).select("code", "severity", "message", "file", "line", "end_line", "symbol", F.col("metadata")["confidence"].alias("confidence"))


def summary_severity(spark: SparkSession, d: str) -> DataFrame:
    return summary.severities(T.findings(spark, d))


def summary_codes(spark: SparkSession, d: str) -> DataFrame:
    return summary.codes(T.findings(spark, d))


def summary_worst_files(spark: SparkSession, d: str) -> DataFrame:
    return summary.worst_files(T.findings(spark, d))


def summary_counts(spark: SparkSession, d: str) -> DataFrame:
    return summary.all_counts(T.findings(spark, d))


def health_score(spark: SparkSession, d: str) -> DataFrame:
    s = summary.severities(T.findings(spark, d), "plan")
    score = summary.score(F.col("high"), F.col("medium"), F.col("low"))
    return s.select("plan", score.alias("score"), summary.label(score).alias("label"))


def pack_top_codes(spark: SparkSession, d: str) -> DataFrame:
    return summary.top_codes(T.findings(spark, d), 3)


def _snippets(spark: SparkSession, d: str) -> DataFrame:
    c = T.table(spark, d, "conversations")
    kind = F.when(F.col("role") == "assistant", "component").otherwise("diagnostic")
    return c.select("conv_id", "turn", "role", "text", kind.alias("kind"), text.estimate_tokens(F.col("text")).alias("tokens"))


def pack_budget(spark: SparkSession, d: str) -> DataFrame:
    s = _snippets(spark, d).withColumn("phase", pack.phase("kind", SMALL_BUDGET))
    return pack.select(s, BUDGET, ("conv_id",), ("phase", "turn", "role", "text")).select("conv_id", "turn", "role", "kind", "before", "taken", "truncated")


def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


def file_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Documents as modules, with findings for those whose line count is over the limit."""
    f = T.source_files(spark, d).withColumn("lang", F.lit("go"))
    found = rules.file_findings(f, {"large-file": MAX_LINES})
    names = F.when(F.col("file_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("C"), "file_id")))
    m = f.select("path", "lines", (F.col("file_id") % 4).cast("int").alias("hooks"), (F.col("file_id") % 5).cast("int").alias("imports"), names.alias("components"))
    return pack.summaries(m, found)


def redact_content(spark: SparkSession, d: str) -> DataFrame:
    """Documents with one secret of each kind at their end, some of them too short to be one."""
    k = (F.col("doc_id") % 4).cast("int")
    keys = F.concat(F.lit(" sk-"), F.repeat(F.lit("a1"), 8 + k), F.lit(" sk-ant-"), F.repeat(F.lit("B"), 18 + k), F.lit(" Bearer "), F.repeat(F.lit("c."), 9 + k), F.lit(" API-Key: '"), F.repeat(F.lit("0d"), 7 + k), F.lit("' Password="), F.repeat(F.lit("e"), 6 + k), F.lit(" end"))
    return T.table(spark, d, "documents").select("doc_id", text.redact(F.concat("text", keys)).alias("text"))


def redact_path(spark: SparkSession, d: str) -> DataFrame:
    p = F.regexp_replace("url", "^[a-z]+://[^/]*", "")
    return T.table(spark, d, "pages").select("page_id", paths.redact_path(p).alias("path"))


def sanitize_path(spark: SparkSession, d: str) -> DataFrame:
    p = F.concat(F.lit("private/"), F.col("source"), F.lit("/my-secret-"), F.col("doc_id"))
    return T.table(spark, d, "documents").select("doc_id", paths.public_path(p).alias("path"))


def content_hash(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("text")
    return T.table(spark, d, "documents").select("doc_id", handoff.content_hash(c).alias("content_hash"), handoff.snippet_hash(c).alias("snippet_hash"))


def slugs(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "part").select("p_partkey", text.slug(F.when(F.col("p_partkey") % 10 == 0, "?! -").otherwise(F.concat("p_name", F.lit(" "), "p_type"))).alias("slug"))


def range_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents as hook calls; spans of lines as components."""
    f = T.source_files(spark, d)
    points = f.select(F.col("path").alias("file"), F.explode(F.sequence(F.lit(1), "lines")).alias("line")).withColumn("name", F.lit("useLine"))
    spans = f.filter("file_id % 2 = 0").select(F.col("path").alias("file"), F.explode(F.array(F.struct(F.lit(2).alias("a"), F.lit(4).alias("b")), F.struct(F.lit(10).alias("a"), F.lit(15).alias("b")))).alias("s"))
    return parse.outside(points, spans.select("file", F.col("s.a").alias("start_line"), F.col("s.b").alias("end_line"))).select("file", "line")


def symbol_first_wins(spark: SparkSession, d: str) -> DataFrame:
    p = T.table(spark, d, "part")
    table = graph.symbols(p.select(F.col("p_type").alias("name"), F.col("p_partkey").alias("seq"), F.concat(F.lit("n_"), "p_partkey").alias("node_id")))
    refs = p.select(F.when(F.col("p_partkey") % 10 == 0, F.lit("none")).otherwise(F.col("p_type")).alias("name"), F.concat(F.lit("r_"), "p_partkey").alias("ref_id"))
    return graph.resolve(refs, table)


def _tree(spark: SparkSession, d: str) -> DataFrame:
    """Regions, their nations, their customers."""
    at = lambda p, k: F.concat(F.lit(p), F.col(k))
    r = T.table(spark, d, "region").select(at("r", "r_regionkey").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_regionkey").cast("long").alias("ord"))
    n = T.table(spark, d, "nation").select(at("n", "n_nationkey").alias("node_id"), at("r", "n_regionkey").alias("parent_id"), F.col("n_nationkey").cast("long").alias("ord"))
    c = T.table(spark, d, "customer").select(at("c", "c_custkey").alias("node_id"), at("n", "c_nationkey").alias("parent_id"), F.col("c_custkey").alias("ord"))
    return r.unionByName(n).unionByName(c)


def node_children(spark: SparkSession, d: str) -> DataFrame:
    return graph.child_counts(_tree(spark, d))


def graph_walk(spark: SparkSession, d: str) -> DataFrame:
    return graph.walk(_tree(spark, d))


def parse_go(spark: SparkSession, d: str) -> DataFrame:
    """The functions of Go sources, one file for each document, made from its numbers as the tables hold no code."""
    return parse.functions(samples.files(T.table(spark, d, "documents"), "go")).select("file", "name", "receiver", "line", "end_line", "complexity", "nesting", "params", "ignored_errors", "typed")


def parse_rust(spark: SparkSession, d: str) -> DataFrame:
    return parse.functions(samples.files(T.table(spark, d, "documents"), "rust")).select("file", "name", "receiver", "line", "end_line", "complexity", "nesting", "params", "is_pub", "is_async", "is_unsafe")


def parse_tsx(spark: SparkSession, d: str) -> DataFrame:
    m = parse.modules(samples.files(T.table(spark, d, "documents"), "tsx"))
    return parse.components(m).select("file", "name", "kind", "start_line", "end_line", F.array_join("hooks", ",").alias("hooks"), F.array_join("jsx", ",").alias("jsx"), "states", "effects", "conditionals", "loops", "has_keydown", "has_analytics", "exported", "default_export")


def node_graph(spark: SparkSession, d: str) -> DataFrame:
    m = parse.modules(samples.files(T.table(spark, d, "documents"), "tsx"))
    return graph.vertices(m).select("file", "seq", "node_id", "kind", "name", "parent_id")


def import_merge(spark: SparkSession, d: str) -> DataFrame:
    """Line items as import clauses: suppliers are sources, parts are names."""
    li = T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), (F.col("l_suppkey") % 3).cast("string").alias("source"), (F.col("l_partkey") % 5).cast("string").alias("name"), F.when(F.col("l_returnflag") == "R", F.col("l_linestatus")).alias("default"), *T._ORDER)
    rows = li.withColumn("ord", F.row_number().over(Window.partitionBy("file").orderBy(*T._ORDER)))
    return parse.merged_imports(rows).withColumn("names", F.array_join("names", ",")).select("file", "source", F.coalesce("default", F.lit("")).alias("default"), "names")


QUERIES = {
    f.__name__: f
    for f in (
        rule_large_file, rule_repeated_elements, rule_flags, rule_mixed_responsibilities, component_findings, component_labels, recipe_matches, function_findings, summary_severity, summary_codes, summary_worst_files, summary_counts, health_score, pack_top_codes, pack_budget, token_estimate,
        file_summaries, redact_content, redact_path, sanitize_path, content_hash, slugs, range_anti_join, symbol_first_wins, node_children, graph_walk, parse_go, parse_rust, parse_tsx, node_graph, import_merge,
    )
}

_F = f"WITH {T.SOURCES_SQL}"
_D = f"WITH {T.FINDINGS_SQL}"
_LARGE = f"lg AS (SELECT *, 'File \"' || path || '\" is ' || lines || ' lines (limit: {MAX_LINES})' AS message, CASE WHEN lines > {2 * MAX_LINES} THEN 'high' WHEN lines > {3 * MAX_LINES // 2} THEN 'medium' ELSE 'low' END AS severity FROM src WHERE lines > {MAX_LINES})"
_TAGS = "tg AS (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS element FROM pages)"
_COMP = f"""{_TAGS}, n AS (SELECT page_id, count(*) FILTER (element = 'li') AS hooks, count(*) FILTER (element = 'a') AS states, count(*) FILTER (element = 'h2') AS effects, count(*) FILTER (element = 'p') AS conditionals, count(*) FILTER (element = 'div') AS loops FROM tg GROUP BY 1),
cp AS (SELECT p.page_id, coalesce(hooks, 0) AS hooks, coalesce(states, 0) AS states, coalesce(effects, 0) AS effects, coalesce(conditionals, 0) AS conditionals, coalesce(loops, 0) AS loops, len(string_split(html, chr(10))) AS lines,
  regexp_matches(lower(html), '{rules.KEYBOARD}') AS kd, regexp_matches(lower(html), '{rules.ANALYTICS}') AS an FROM pages p LEFT JOIN n USING (page_id)),
roles AS (SELECT *, (states > 2)::INT + (effects > 1)::INT + kd::INT + an::INT + (hooks > 3)::INT AS r FROM cp),
el AS (SELECT page_id, element, count(*) AS n FROM tg GROUP BY ALL HAVING count(*) >= 3)"""
_TREE = "tr(node_id, parent_id, ord) AS (SELECT 'r' || r_regionkey, NULL, r_regionkey FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_custkey FROM customer)"
_RED = "(text || ' sk-' || repeat('a1', 8 + doc_id % 4) || ' sk-ant-' || repeat('B', 18 + doc_id % 4) || ' Bearer ' || repeat('c.', 9 + doc_id % 4) || ' API-Key: ' || chr(39) || repeat('0d', 7 + doc_id % 4) || chr(39) || ' Password=' || repeat('e', 6 + doc_id % 4) || ' end')"
for _e, _r in text.REDACTIONS:
    _RED = f"regexp_replace({_RED}, '{_e.replace(chr(39), chr(39) * 2)}', '{_r.replace('$1', chr(92) + '1')}', 'g')"
_PARTS = f"WITH {samples.PARTS_SQL}"
# the order of building: root, imports, the component with hooks and their states, effects, elements, handlers, props, export, the other component, hooks outside
_X = lambda prefix, name, owner, kind="": f"{{'prefix': '{prefix}', 'kind': '{kind or prefix}', 'name': {name}, 'owner': '{owner}'}}"
_TIMES = lambda n, *x: f"flatten(list_transform(range({n}), lambda i: [{', '.join(x)}]))"
_NODES = ", ".join(
    (
        f"[{_X('root', repr(''), '')}, {_X('import', repr('react'), 'r')}, {_X('import', repr('./log') + ' || doc_id', 'r')}, {_X('comp', repr('Panel') + ' || doc_id', 'r', 'component')}]",
        _TIMES("a", _X("hook", "'useState'", "1"), _X("state", "'state:useState'", "1")),
        _TIMES("b", _X("hook", "'useEffect'", "1")),
        _TIMES("b", _X("effect", "''", "1")),
        f"[{_X('jsx', repr('Card'), '1')}, {_X('jsx', repr('Empty'), '1')}]",
        _TIMES("p", _X("jsx", "'Row'", "1")),
        _TIMES("(c > 1)::INT", _X("event", "'handleIt'", "1")),
        f"[{_X('prop', repr('title'), '1')}]",
        _TIMES("p", _X("prop", "'p' || i", "1")),
        _TIMES("(d > 0)::INT", _X("export", "'Panel' || doc_id", "1")),
        f"[{_X('comp', repr('Small'), 'r', 'component')}, {_X('jsx', repr('Row'), '2')}, {_X('prop', repr('id'), '2')}, {_X('hook', repr('useReady'), 'r')}]",
    )
)
SQL = {
    "parse_go": f"""{_PARTS}, f AS (SELECT *, 9 + 3 * a + 2 * b + CASE WHEN c > 0 THEN c + 1 ELSE 0 END + CASE WHEN d > 0 THEN 3 * d + 3 ELSE 0 END AS stop FROM pt)
SELECT 'src/f' || doc_id || '.go' AS file, 'Find' || doc_id AS name, '(s *Store)' AS receiver, 7 AS line, stop AS end_line, 1 + 2 * a + b + c + CASE WHEN d > 0 THEN 2 * d + 1 ELSE 0 END AS complexity, greatest((a > 0)::INT, b, c, (d > 0)::INT) AS nesting, 1 + p AS params, 0 AS ignored_errors, true AS typed FROM f
UNION ALL SELECT 'src/f' || doc_id || '.go', 'drop' || doc_id, '', stop + 2, stop + 3 + e + p + CASE WHEN c > 1 THEN 4 ELSE 0 END, CASE WHEN c > 1 THEN 2 ELSE 1 END, 0, 1, e + 2 * p, true FROM f""",
    "parse_rust": f"""{_PARTS}, f AS (SELECT *, 8 + 3 * a + 2 * b + CASE WHEN c > 0 THEN c + 2 ELSE 0 END + 3 * d AS stop FROM pt)
SELECT 'src/f' || doc_id || '.rs' AS file, 'find' || doc_id AS name, 'Store' AS receiver, 5 AS line, stop AS end_line, 1 + a + b + c + d AS complexity, greatest(1, CASE WHEN a > 0 OR d > 0 THEN 3 END, 1 + 2 * b, CASE WHEN c > 0 THEN 2 END) AS nesting, 1 + p AS params, d % 2 = 1 AS is_pub, e > 0 AS is_async, false AS is_unsafe FROM f
UNION ALL SELECT 'src/f' || doc_id || '.rs', 'raw' || doc_id, '', stop + 3, stop + 3, 1, 0, 2, false, false, true FROM f""",
    "parse_tsx": f"""{_PARTS}, f AS (SELECT *, 10 + a + b + c + d + e + (c > 1)::INT + (e > 0)::INT + p AS stop FROM pt)
SELECT 'src/f' || doc_id || '.tsx' AS file, 'Panel' || doc_id AS name, 'function' AS kind, 4 AS start_line, stop AS end_line, array_to_string(list_concat(list_transform(range(a), lambda i: 'useState'), list_transform(range(b), lambda i: 'useEffect')), ',') AS hooks, 'Card,Empty' || repeat(',Row', p) AS jsx,
a AS states, b AS effects, c + d AS conditionals, e AS loops, d > 1 AS has_keydown, e > 0 AS has_analytics, d > 0 AS exported, d % 2 = 1 AS default_export FROM f
UNION ALL SELECT 'src/f' || doc_id || '.tsx', 'Small', 'arrow', stop + 2, stop + 2, '', 'Row', 0, 0, 0, 0, false, false, false, false FROM f""",
    "node_graph": f"""{_PARTS}, n AS (SELECT doc_id, 11 + 2 * a + 2 * b + 2 * p + (c > 1)::INT + (d > 0)::INT - 3 AS small, flatten([{_NODES}]) AS x FROM pt), u AS (SELECT doc_id, small, unnest(x) AS x, generate_subscripts(x, 1) AS seq FROM n)
SELECT 'src/f' || doc_id || '.tsx' AS file, CAST(seq AS INTEGER) AS seq, x.prefix || '_' || seq AS node_id, x.kind AS kind, x.name AS name, CASE x.owner WHEN 'r' THEN 'root_1' WHEN '1' THEN 'comp_4' WHEN '2' THEN 'comp_' || small END AS parent_id FROM u""",
    "rule_large_file": f"{_F}, {_LARGE} SELECT file_id, CASE WHEN file_id % 3 = 0 THEN 'rust' ELSE 'go' END || '.large-file' AS code, severity, message, path AS file, 1 AS line FROM lg",
    "rule_repeated_elements": f"WITH {_COMP} SELECT * FROM el",
    "rule_flags": f"WITH {_COMP} SELECT page_id, kd AS has_keydown, an AS has_analytics FROM cp",
    "rule_mixed_responsibilities": f"""WITH {_COMP} SELECT page_id, 'medium' AS severity, 'Component "Page' || page_id || '" has ~' || r || ' detected responsibilities' AS message FROM roles WHERE r >= 3""",
    "component_findings": f"""WITH {_COMP}, c AS (SELECT *, 'Component "Page' || page_id || '"' AS who FROM roles), f AS (SELECT page_id, 'react.large-component' AS code, CASE WHEN lines > 6 THEN 'high' WHEN lines > 4 THEN 'medium' ELSE 'low' END AS severity, who || ' is ' || lines || ' lines (limit: 3)' AS message, 1 AS line, lines AS end_line FROM c WHERE lines > 3
UNION ALL SELECT page_id, 'react.too-many-hooks', 'low', who || ' has ' || hooks || ' hooks (limit: 4)', NULL, NULL FROM c WHERE hooks > 4 UNION ALL SELECT page_id, 'react.too-many-state-vars', 'medium', who || ' has ' || states || ' state variables (limit: 5)', NULL, NULL FROM c WHERE states > 5
UNION ALL SELECT page_id, 'react.too-many-effects', 'medium', who || ' has ' || effects || ' useEffect calls (limit: 1)', NULL, NULL FROM c WHERE effects > 1 UNION ALL SELECT page_id, 'react.complex-conditionals', 'low', who || ' has ' || conditionals || ' conditional expressions (limit: 4)', NULL, NULL FROM c WHERE conditionals > 4
UNION ALL SELECT page_id, 'react.mixed-responsibilities', 'medium', who || ' has ~' || r || ' detected responsibilities', NULL, NULL FROM c WHERE r >= 3 UNION ALL SELECT page_id, 'react.missing-prop-types', 'low', who || ' has 2 props but no TypeScript types found', NULL, NULL FROM c WHERE page_id % 3 = 0 AND page_id IN (SELECT page_id FROM tg)
UNION ALL SELECT page_id, 'react.repeated-jsx', 'low', 'JSX element <' || element || '> repeated ' || n || ' times in component "Page' || page_id || '"', NULL, NULL FROM el)
SELECT f.*, url AS file, 'Page' || page_id AS component FROM f JOIN (SELECT page_id, url FROM pages) USING (page_id)""",
    "component_labels": f"""WITH {_COMP} SELECT page_id, array_to_string(list_filter([CASE WHEN states > 3 THEN 'local-state-management' END, CASE WHEN effects > 2 THEN 'side-effects' END, CASE WHEN kd THEN 'keyboard-events' END, CASE WHEN an THEN 'analytics' END,
CASE WHEN conditionals > 5 THEN 'complex-rendering-logic' END, CASE WHEN loops > 3 THEN 'list-rendering' END], lambda x: x IS NOT NULL), ',') AS labels FROM cp""",
    "recipe_matches": f"""WITH {_COMP}, m AS (SELECT page_id, 'react.split-large-component' AS recipe, lines / 500.0 AS confidence FROM cp WHERE lines >= 200
UNION ALL SELECT DISTINCT page_id, 'react.extract-repeated-jsx', 0.9 FROM el
UNION ALL SELECT page_id, 'react.extract-custom-hook', CASE WHEN hooks > 5 OR (effects > 1 AND states > 2) THEN 0.75 ELSE 0.85 END FROM cp WHERE hooks > 5 OR (effects > 1 AND states > 2) OR (kd AND states > 0)
UNION ALL SELECT page_id, 'react.reduce-state-vars', 0.7 FROM cp WHERE states > 4 UNION ALL SELECT page_id, 'react.consolidate-effects', 0.6 FROM cp WHERE effects > 2 UNION ALL SELECT page_id, 'react.add-prop-types', 0.6 FROM cp WHERE page_id % 3 = 0 AND lines > 30)
SELECT page_id, recipe, round(CAST(confidence AS DOUBLE), 6) AS confidence FROM m""",
    "function_findings": """WITH f AS (SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'go' ELSE 'rust' END AS lang, 'src/f' || l_partkey AS file, CASE WHEN l_linenumber % 3 <> 0 THEN '' WHEN l_suppkey % 2 = 0 THEN '(s *S).' ELSE 'S::' END || 'fn' || l_orderkey AS symbol, l_linenumber AS line, CAST(floor(l_quantity) AS INT) * 5 AS lines, CAST(floor(l_quantity) AS INT) AS cc,
CAST(round(l_discount * 100) AS INT) AS nest, CAST(round(l_tax * 200) AS INT) AS params, l_partkey % 3 AS ign, CASE WHEN l_partkey % 2 = 0 THEN 'high' ELSE 'medium' END AS sure FROM lineitem),
x AS (SELECT lang || '.long-function' AS code, CASE WHEN lines > 160 THEN 'high' WHEN lines > 120 THEN 'medium' ELSE 'low' END AS severity, 'Function ' || symbol || ' in "' || file || '" is ' || lines || ' lines (limit: 80)' AS message, file, line, line + 9 AS end_line, symbol, NULL AS confidence FROM f WHERE lines > 80
UNION ALL SELECT lang || '.high-complexity', CASE WHEN cc > 20 THEN 'high' WHEN cc > 15 THEN 'medium' ELSE 'low' END, 'Function ' || symbol || ' has cyclomatic complexity ' || cc || ' (limit: 10)', file, line, NULL, symbol, NULL FROM f WHERE cc > 10
UNION ALL SELECT lang || '.deep-nesting', CASE WHEN nest > 7 THEN 'high' WHEN nest > 5 THEN 'medium' ELSE 'low' END, 'Function ' || symbol || ' has nesting depth ' || nest || ' (limit: 4)', file, line, NULL, symbol, NULL FROM f WHERE nest > 4
UNION ALL SELECT lang || '.too-many-params', CASE WHEN lang = 'rust' AND params > 10 THEN 'medium' ELSE 'low' END, 'Function ' || symbol || ' has ' || params || ' parameters (limit: 5)', file, line, NULL, symbol, NULL FROM f WHERE params > 5
UNION ALL SELECT lang || '.ignored-error', 'medium', 'Function ' || symbol || ' ignores ' || ign || ' error(s) with _', file, line, NULL, symbol, sure FROM f WHERE lang = 'go' AND ign > 0)
SELECT code, severity, message, file, CAST(line AS INTEGER) AS line, CAST(end_line AS INTEGER) AS end_line, symbol, confidence FROM x""",
    "summary_severity": f"{_D} SELECT count(DISTINCT file) AS files, count(*) AS findings, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM fd",
    "summary_codes": f"{_D} SELECT code, count(*) AS n FROM fd GROUP BY 1",
    "summary_worst_files": f"{_D} SELECT file, count(*) AS n FROM fd GROUP BY 1 ORDER BY n DESC, file LIMIT 10",
    "summary_counts": f"{_D} SELECT code, file, count(*) AS n FROM fd GROUP BY GROUPING SETS ((code), (file), ())",
    "health_score": f"""{_D}, s AS (SELECT plan, CAST(greatest(0, 100 - sum(CASE severity WHEN 'high' THEN 8 WHEN 'medium' THEN 3 ELSE 1 END)) AS INTEGER) AS score FROM fd GROUP BY 1)
SELECT *, CASE WHEN score >= 90 THEN 'Excellent' WHEN score >= 75 THEN 'Good' WHEN score >= 50 THEN 'Needs attention' ELSE 'High risk' END AS label FROM s""",
    "pack_top_codes": f"{_D} SELECT code, count(*) AS n FROM fd GROUP BY 1 ORDER BY n DESC, code LIMIT 3",
    "pack_budget": f"""WITH s AS (SELECT *, CASE WHEN role = 'assistant' THEN 'component' ELSE 'diagnostic' END AS kind, CAST(strlen(text) // 3 AS INTEGER) AS tokens FROM conversations),
b AS (SELECT *, CAST(coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY kind = 'component', turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM s)
SELECT conv_id, turn, role, kind, before, least(tokens, {BUDGET} - before) AS taken, tokens > {BUDGET} - before AS truncated FROM b WHERE before < {BUDGET}""",
    "token_estimate": "SELECT doc_id, CAST(strlen(text) // 3 AS INTEGER) AS tokens FROM documents",
    "file_summaries": f"""{_F}, {_LARGE}, x AS (SELECT s.*, CASE WHEN lg.path IS NULL THEN 0 ELSE 1 END AS findings FROM src s LEFT JOIN lg USING (path)),
y AS (SELECT *, CASE WHEN findings > 0 THEN lines || ' lines, ' || findings || ' diagnostics' ELSE lines || ' lines' END AS base FROM x)
SELECT path, lines, CAST(findings AS BIGINT) AS findings, CASE WHEN file_id % 3 = 0 THEN 'Module with ' || base || ', ' || (file_id % 4) || ' hooks, ' || (file_id % 5) || ' imports' ELSE 'Exports C' || file_id || ' (' || base || ', 1 components, ' || (file_id % 4) || ' hooks)' END AS summary FROM y""",
    "redact_content": f"SELECT doc_id, {_RED} AS text FROM documents",
    "redact_path": """WITH p AS (SELECT page_id, string_split(regexp_replace(url, '^[a-z]+://[^/]*', ''), '/') AS x FROM pages)
SELECT page_id, CASE WHEN len(x) > 2 THEN '<redacted>/' || CASE WHEN x[-2] = '' THEN '' ELSE x[-2] || '/' END || x[-1] WHEN len(x) = 2 THEN '<redacted>/' || x[-1] ELSE x[1] END AS path FROM p""",
    "sanitize_path": "SELECT doc_id, 'synthetic/' || replace(replace(source, 'private', 'synthetic'), 'secret', 'synthetic') || '/my-synthetic-' || doc_id AS path FROM documents",
    "content_hash": "SELECT doc_id, CASE WHEN text = '' THEN '' ELSE sha256(text) END AS content_hash, left(sha256(text), 16) AS snippet_hash FROM documents",
    "slugs": "SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'target' ELSE left(regexp_replace(regexp_replace(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9 _-]', '', 'g'), '[ _-]+', '-', 'g'), '-+$', ''), 40) END AS slug FROM part",
    "range_anti_join": f"{_F}, p AS (SELECT path AS file, file_id, unnest(range(1, lines + 1)) AS line FROM src) SELECT file, CAST(line AS INTEGER) AS line FROM p WHERE NOT (file_id % 2 = 0 AND (line BETWEEN 2 AND 4 OR line BETWEEN 10 AND 15))",
    "symbol_first_wins": """WITH t AS (SELECT p_type AS name, 'n_' || min(p_partkey) AS target FROM part GROUP BY 1), r AS (SELECT CASE WHEN p_partkey % 10 = 0 THEN 'none' ELSE p_type END AS name, 'r_' || p_partkey AS ref_id FROM part)
SELECT ref_id, name, target FROM r LEFT JOIN t USING (name)""",
    "node_children": f"WITH {_TREE} SELECT a.node_id, count(b.node_id) AS children FROM tr a LEFT JOIN tr b ON b.parent_id = a.node_id GROUP BY 1",
    "graph_walk": f"""WITH RECURSIVE {_TREE}, w(node_id, depth, path) AS (SELECT node_id, CAST(0 AS INTEGER), '0/' || printf('%010d', ord) FROM tr WHERE parent_id IS NULL
UNION ALL SELECT t.node_id, CAST(w.depth + 1 AS INTEGER), w.path || '/' || printf('%010d', t.ord) FROM w JOIN tr t ON t.parent_id = w.node_id)
SELECT * FROM w UNION ALL SELECT node_id, 0, '1/' || printf('%010d', ord) FROM tr WHERE node_id NOT IN (SELECT node_id FROM w)""",
    "import_merge": f"""WITH r AS (SELECT l_orderkey AS file, CAST(l_suppkey % 3 AS VARCHAR) AS source, CAST(l_partkey % 5 AS VARCHAR) AS name, CASE WHEN l_returnflag = 'R' THEN l_linestatus END AS def, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(T._ORDER)}) AS ord FROM lineitem),
f AS (SELECT file, source, name, min(ord) AS ord FROM r GROUP BY ALL), n AS (SELECT file, source, string_agg(name, ',' ORDER BY ord) AS names FROM f GROUP BY ALL), g AS (SELECT file, source, arg_min(def, ord) FILTER (def IS NOT NULL) AS def FROM r GROUP BY ALL)
SELECT file, source, coalesce(def, '') AS "default", names FROM n JOIN g USING (file, source)""",
}
