"""Findings from code facts. Rules are data: each row of facts is laid out once as an array of candidates and filtered.

Functions: lang, file, name, receiver, line, end_line, lines, complexity, nesting, params, ignored_errors, typed.
Files: lang, path, lines. Components: file, name, start_line, end_line, lines, hooks, jsx (arrays of names), states, effects,
conditionals, loops, has_keydown, has_analytics, props (array of name and type).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcplan.functions import text

LIMITS = {"large-file": 500, "long-function": 80, "high-complexity": 10, "deep-nesting": 4, "too-many-params": 5}
COMPONENT_LIMITS = {"large-component": 200, "repeated-jsx": 3, "too-many-hooks": 5, "too-many-state-vars": 4, "too-many-effects": 2, "complex-conditionals": 5}
FINDING = "code string, severity string, message string, file string, line int, end_line int, symbol string, component string, suggestion string, metadata map<string,string>"


def by_size(value: Column, limit: Column) -> Column:
    """high beyond twice the limit, medium beyond one and a half, else low."""
    return F.when(value > 2 * limit, "high").when(value > F.floor(3 * limit / 2), "medium").otherwise("low")


def by_depth(value: Column, limit: Column) -> Column:
    return F.when(value > limit + 3, "high").when(value > limit + 1, "medium").otherwise("low")


def _finding(**v: Column) -> Column:
    parts = []
    for f in FINDING.split(", "):
        name, kind = f.split(" ")
        c = v.get(name)
        parts.append((F.lit(None) if c is None else c).cast(kind).alias(name))
    return F.struct(*parts)


def _found(df: DataFrame, candidates: list[tuple[Column, Column]], keep: tuple[str, ...] = ()) -> DataFrame:
    each = F.array_compact(F.array(*[F.when(test, finding) for test, finding in candidates]))
    return df.select(*keep, F.posexplode(each).alias("rule_no", "f")).select(*keep, "rule_no", "f.*")


def ordered(findings: DataFrame, lang: str, keys: tuple[str, ...], *tie: str) -> DataFrame:
    """Adds place, from 1 on within keys, in the order in which the analysis of a language gives findings.

    Components (lang ts): severity, code, message, then tie, which stands for the order they were found in. Functions (go, rust): severity and code, then file, line, symbol, message and tie.
    """
    rest = ("code", "message") if lang == "ts" else ("code", "file", "line", "symbol", "message")
    w = Window.partitionBy(*keys).orderBy(text.severity_rank(F.col("severity")), *rest, *tie)
    return findings.withColumn("place", F.row_number().over(w))


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def file_findings(files: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    limit = F.lit(({**LIMITS, **(limits or {})})["large-file"])
    message = F.format_string('File "%s" is %d lines (limit: %d)', "path", "lines", limit)
    return _found(
        files, [(F.col("lines") > limit, _finding(code=F.concat("lang", F.lit(".large-file")), severity=by_size(F.col("lines"), limit), message=message, file=F.col("path"), line=F.lit(1), suggestion=F.lit("Split the file by responsibility.")))], tuple(c for c in ("file_id",) if c in files.columns)
    )


def qualified(lang: Column, receiver: Column, name: Column) -> Column:
    return F.when(F.coalesce(receiver, F.lit("")) == "", name).otherwise(F.concat(receiver, F.when(lang == "rust", "::").otherwise("."), name))


def function_findings(functions: DataFrame, limits: dict[str, int] | None = None, ignored_errors: str = "auto") -> DataFrame:
    """ignored_errors: `off`, `auto`, or `always`, which reports full confidence."""
    lim = {k: F.lit(v) for k, v in {**LIMITS, **(limits or {})}.items()}
    c, who = F.col, qualified(F.col("lang"), F.col("receiver"), F.col("name"))
    code = lambda rule: F.concat("lang", F.lit(f".{rule}"))
    common = {"file": c("file"), "line": c("line"), "symbol": who}
    params = F.when((c("lang") == "rust") & (c("params") > 2 * lim["too-many-params"]), "medium").otherwise("low")
    sure = F.lit("high") if ignored_errors == "always" else F.when(c("typed"), "high").otherwise("medium")
    return _found(
        functions,
        [
            (
                c("lines") > lim["long-function"],
                _finding(code=code("long-function"), severity=by_size(c("lines"), lim["long-function"]), message=F.format_string('Function %s in "%s" is %d lines (limit: %d)', who, "file", "lines", lim["long-function"]), end_line=c("end_line"), suggestion=F.lit("Move parts of it to helpers."), **common),
            ),
            (
                c("complexity") > lim["high-complexity"],
                _finding(code=code("high-complexity"), severity=by_size(c("complexity"), lim["high-complexity"]), message=F.format_string("Function %s has cyclomatic complexity %d (limit: %d)", who, "complexity", lim["high-complexity"]), suggestion=F.lit("Use guard clauses and smaller functions."), **common),
            ),
            (
                c("nesting") > lim["deep-nesting"],
                _finding(code=code("deep-nesting"), severity=by_depth(c("nesting"), lim["deep-nesting"]), message=F.format_string("Function %s has nesting depth %d (limit: %d)", who, "nesting", lim["deep-nesting"]), suggestion=F.lit("Return early or move inner logic out."), **common),
            ),
            (
                c("params") > lim["too-many-params"],
                _finding(code=code("too-many-params"), severity=params, message=F.format_string("Function %s has %d parameters (limit: %d)", who, "params", lim["too-many-params"]), suggestion=F.lit("Group parameters in one type."), **common),
            ),
            (
                F.lit(ignored_errors != "off") & (c("lang") == "go") & (c("ignored_errors") > 0),
                _finding(code=code("ignored-error"), severity=F.lit("medium"), message=F.format_string("Function %s ignores %d error(s) with _", who, "ignored_errors"), suggestion=F.lit("Handle or return the error."), metadata=F.create_map(F.lit("confidence"), sure, F.lit("reason"), F.lit("error return value ignored with _")), **common),
            ),
        ],
    )


def component_findings(components: DataFrame, limits: dict[str, int] | None = None, strict: bool = True) -> DataFrame:
    """strict keeps to the rules that can fire; hardcoded data never does (its pattern sees no source)."""
    del strict
    lim = {k: F.lit(v) for k, v in {**COMPONENT_LIMITS, **(limits or {})}.items()}
    c, name = F.col, _quoted(F.col("name"))
    common = {"file": c("file"), "component": c("name"), "symbol": c("name")}
    roles = sum((F.coalesce(x, F.lit(False)).cast("int") for x in (c("states") > 2, c("effects") > 1, c("has_keydown"), c("has_analytics"), F.size("hooks") > 3)), F.lit(0))
    count = lambda what, value, rule: F.format_string(f"Component %s has %d {what} (limit: %d)", name, value, lim[rule])
    untyped = (F.size("props") > 0) & (F.size("jsx") > 0) & ~F.exists("props", lambda p: F.coalesce(p["type"], F.lit("")) != "")
    single = _found(
        components,
        [
            (
                c("lines") > lim["large-component"],
                _finding(
                    code=F.lit("react.large-component"), severity=by_size(c("lines"), lim["large-component"]), message=F.format_string("Component %s is %d lines (limit: %d)", name, "lines", lim["large-component"]), line=c("start_line"), end_line=c("end_line"), suggestion=F.lit("Split it into focused components."), **common
                ),
            ),
            (F.size("hooks") > lim["too-many-hooks"], _finding(code=F.lit("react.too-many-hooks"), severity=F.lit("low"), message=count("hooks", F.size("hooks"), "too-many-hooks"), suggestion=F.lit("Move related hooks to a custom hook."), **common)),
            (c("states") > lim["too-many-state-vars"], _finding(code=F.lit("react.too-many-state-vars"), severity=F.lit("medium"), message=count("state variables", c("states"), "too-many-state-vars"), suggestion=F.lit("Use a reducer."), **common)),
            (c("effects") > lim["too-many-effects"], _finding(code=F.lit("react.too-many-effects"), severity=F.lit("medium"), message=count("useEffect calls", c("effects"), "too-many-effects"), suggestion=F.lit("Join effects."), **common)),
            (c("conditionals") > lim["complex-conditionals"], _finding(code=F.lit("react.complex-conditionals"), severity=F.lit("low"), message=count("conditional expressions", c("conditionals"), "complex-conditionals"), suggestion=F.lit("Return early."), **common)),
            (roles >= 3, _finding(code=F.lit("react.mixed-responsibilities"), severity=F.lit("medium"), message=F.format_string("Component %s has ~%d detected responsibilities", name, roles), suggestion=F.lit("Separate its concerns."), **common)),
            (untyped, _finding(code=F.lit("react.missing-prop-types"), severity=F.lit("low"), message=F.format_string("Component %s has %d props but no TypeScript types found", name, F.size("props")), suggestion=F.lit("Declare an interface for the props."), **common)),
        ],
        ("component_id",),
    )
    elems = repeated_elements(components.select("component_id", "file", "name", "jsx"), "jsx", ("component_id", "file", "name"), limits)
    message = F.format_string("JSX element <%s> repeated %d times in component %s", "element", "n", _quoted(c("name")))
    again = elems.select("component_id", F.lit(100).alias("rule_no"), _finding(code=F.lit("react.repeated-jsx"), severity=F.lit("low"), message=message, suggestion=F.lit("Extract the repeated element."), **common).alias("f")).select("component_id", "rule_no", "f.*")
    return single.unionByName(again)


def repeated_elements(df: DataFrame, elements: str, keys: tuple[str, ...], limits: dict[str, int] | None = None) -> DataFrame:
    """(keys..., element, n) of the elements that occur often enough in one row."""
    least = {**COMPONENT_LIMITS, **(limits or {})}["repeated-jsx"]
    return df.select(*keys, F.explode(elements).alias("element")).groupBy(*keys, "element").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


KEYBOARD, ANALYTICS = "onkeydown|usekeydown|keyboard|keydown", "amplitude|analytics|gtag|mixpanel|posthog|track"


def flags(body: Column) -> tuple[Column, Column]:
    """Whether a component's source hints at keyboard handling, and at analytics."""
    return F.lower(body).rlike(KEYBOARD), F.lower(body).rlike(ANALYTICS)


def responsibilities(components: DataFrame) -> DataFrame:
    """(component_id, labels)."""
    c = F.col
    any_of = lambda *names: F.arrays_overlap(F.col("hooks"), F.array(*map(F.lit, names)))
    tests = [
        (any_of("useForm", "useController", "useFieldArray"), "form-logic"),
        (any_of("useQuery", "useMutation"), "data-fetching"),
        (c("states") > 3, "local-state-management"),
        (c("effects") > 2, "side-effects"),
        (c("has_keydown"), "keyboard-events"),
        (c("has_analytics"), "analytics"),
        (c("conditionals") > 5, "complex-rendering-logic"),
        (c("loops") > 3, "list-rendering"),
    ]
    return components.select("component_id", F.array_compact(F.array(*[F.when(t, F.lit(name)) for t, name in tests])).alias("labels"))


def recipe_matches(components: DataFrame) -> DataFrame:
    """(component_id, recipe, confidence) of the recipes that suit a component; unlike the findings, sizes match from the limit on."""
    c = F.col
    most = F.array_max(F.transform(F.array_distinct("jsx"), lambda e: F.size(F.filter("jsx", lambda x: x == e))))
    many = (F.size("hooks") > 5) | ((c("effects") > 1) & (c("states") > 2))
    bare = (F.size("props") > 0) & (c("lines") > 30) & ~F.exists("props", lambda p: F.coalesce(p["type"], F.lit("")) != "")
    tests = [
        (c("lines") >= 200, "react.split-large-component", c("lines") / 500.0),
        (F.coalesce(most, F.lit(0)) >= 3, "react.extract-repeated-jsx", F.lit(0.9)),
        (many | (c("has_keydown") & (c("states") > 0)), "react.extract-custom-hook", F.when(many, 0.75).otherwise(0.85)),
        (c("states") > 4, "react.reduce-state-vars", F.lit(0.7)),
        (c("effects") > 2, "react.consolidate-effects", F.lit(0.6)),
        (bare, "react.add-prop-types", F.lit(0.6)),
    ]
    each = F.array_compact(F.array(*[F.when(t, F.struct(F.lit(r).alias("recipe"), s.cast("double").alias("confidence"))) for t, r, s in tests]))
    return components.select("component_id", F.explode(each).alias("m")).select("component_id", "m.*")
