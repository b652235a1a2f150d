"""Checks of plan documents: each rule yields rows (plan, field, message); a plan without rows is valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcplan.functions.paths import is_absolute

LEVELS = ("low", "medium", "high")
_VERIFY = "array<struct<command:string,required:boolean,source:string,confidence:string,type:string>>"
_TASK = "struct<id:string,goal:string,allowedFiles:array<string>,maxDiffLines:int,dependsOn:array<string>>"
PLAN = (
    "specversion string, id string, type string, source string, subject string, language string, goal string, risk string, "
    "diagnostics array<struct<id:string,code:string,severity:string,confidence:string,message:string,file:string,line:int,symbol:struct<kind:string,name:string>>>, "
    f"steps array<struct<id:string,recipe:string,title:string,action:string,target:struct<file:string,symbol:string,kind:string>,risk:string,requires:array<string>,verify:{_VERIFY}>>, verification {_VERIFY}, "
    "reviewability struct<status:string,recommendation:string,budget:struct<maxDiffLines:int,maxTouchedFiles:int>,observed:struct<addedLines:int,deletedLines:int,changedFiles:int>>, "
    f"decomposition struct<strategy:string,tasks:array<{_TASK}>>"
)


def _empty(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def _outside(c: Column, values: tuple[str, ...] = LEVELS) -> Column:
    """An empty value passes."""
    return ~_empty(c) & ~c.isin(*values)


NONE, ABSOLUTE, LEVEL, NEGATIVE = "must not be empty", "must not be an absolute path", 'must be one of "low", "medium", "high"', "must be non-negative"


def _rows(df: DataFrame, prefix: Column, tests: list[tuple[Column, str, Column | str]]) -> DataFrame:
    dot = lambda field: F.concat(prefix, F.lit(field))
    each = F.array_compact(F.array(*[F.when(t, F.struct(dot(field).alias("field"), (F.lit(m) if isinstance(m, str) else m).alias("message"))) for t, field, m in tests]))
    return df.select("plan", F.explode(each).alias("e")).select("plan", "e.field", "e.message")


def duplicates(items: DataFrame, keys: tuple[str, ...], name: str, order: str) -> DataFrame:
    """The rows of items whose name occurred before within keys, in order."""
    w = Window.partitionBy(*keys, name).orderBy(order)
    return items.filter(~_empty(F.col(name))).withColumn("seen", F.row_number().over(w)).filter("seen > 1").drop("seen")


def unknown(refs: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """References that no known row answers."""
    return refs.join(known.select(*on).distinct(), on, "left_anti")


def errors(plans: DataFrame) -> DataFrame:
    """(plan, field, message) of every violation. plans: plan (a key) and the columns of PLAN."""
    c = F.col
    at = lambda what: F.concat(F.lit(f"{what}["), c("i").cast("string"), F.lit("]"))
    start = lambda col, p: ~_empty(col) & ~col.startswith(p)
    must = lambda p: f'must start with "{p}"'
    r = "reviewability"
    top = [
        (F.coalesce(c("specversion"), F.lit("")) != "0.1", "specversion", F.concat(F.lit('invalid value "'), F.coalesce("specversion", F.lit("")), F.lit('"'))),
        (_empty(c("id")), "id", NONE),
        (start(c("id"), "grp_"), "id", must("grp_")),
        *[(_empty(c(f)), f, NONE) for f in ("type", "source", "subject", "language", "goal")],
        (is_absolute(c("subject")), "subject", ABSOLUTE),
        (_outside(c("risk")), "risk", LEVEL),
        (_outside(c(f"{r}.status"), ("pass", "warn", "fail", "unknown")), f"{r}.status", LEVEL),
        (_outside(c(f"{r}.recommendation"), ("review", "decompose", "reject", "unknown")), f"{r}.recommendation", LEVEL),
        *[(c(f"{r}.{f}") < 0, f"{r}.{f}", NEGATIVE) for f in ("budget.maxDiffLines", "budget.maxTouchedFiles", "observed.addedLines", "observed.deletedLines", "observed.changedFiles")],
        (c("decomposition").isNotNull() & _empty(c("decomposition.strategy")), "decomposition.strategy", NONE),
        (c("decomposition").isNotNull() & (F.coalesce(F.size("decomposition.tasks"), F.lit(0)) <= 0), "decomposition.tasks", NONE),
    ]
    out = [_rows(plans, F.lit(""), top)]
    d = plans.select("plan", F.posexplode("diagnostics").alias("i", "x")).select("plan", "i", "x.*")
    d_at = at("diagnostics")
    out.append(
        _rows(
            d, d_at, [(_empty(c("id")), ".id", NONE), (start(c("id"), "diag_"), ".id", must("diag_")), (_empty(c("code")), ".code", NONE), (_outside(c("severity")), ".severity", LEVEL), (_outside(c("confidence")), ".confidence", LEVEL), (_empty(c("message")), ".message", NONE), (_empty(c("file")), ".file", NONE), (is_absolute(c("file")), ".file", ABSOLUTE)]
        )
    )
    s = plans.select("plan", F.posexplode("steps").alias("i", "x")).select("plan", "i", "x.*")
    s_at = at("steps")
    file = c("target.file")
    out.append(_rows(s, s_at, [(_empty(c("id")), ".id", NONE), (start(c("id"), "step_"), ".id", must("step_")), (_empty(c("title")), ".title", NONE), (_empty(c("action")), ".action", NONE), (_empty(file), ".target.file", NONE), (is_absolute(file), ".target.file", ABSOLUTE), (_outside(c("risk")), ".risk", LEVEL)]))
    sv = s.select("plan", s_at.alias("at"), F.posexplode("verify").alias("i", "v")).select("plan", F.concat("at", F.lit(".verify["), c("i").cast("string"), F.lit("]")).alias("at"), "v.*")
    out.append(_rows(sv, c("at"), [(_empty(c("command")), ".command", NONE), (_outside(c("confidence")), ".confidence", LEVEL)]))
    v = plans.select("plan", F.posexplode("verification").alias("i", "x")).select("plan", "i", "x.*")
    out.append(_rows(v, at("verification"), [(_empty(c("command")), ".command", NONE), (_empty(c("source")), ".source", NONE), (_outside(c("confidence")), ".confidence", LEVEL)]))
    t = plans.filter("decomposition is not null").select("plan", F.posexplode("decomposition.tasks").alias("i", "x")).select("plan", "i", "x.*")
    t_at = at("decomposition.tasks")
    out.append(_rows(t, t_at, [(_empty(c("id")), ".id", NONE), (start(c("id"), "task_"), ".id", must("task_")), (_empty(c("goal")), ".goal", NONE), (c("maxDiffLines") < 0, ".maxDiffLines", NEGATIVE)]))
    for df, place, what in ((d, d_at, "diagnostic"), (s, s_at, "step"), (t, t_at, "task")):
        out.append(duplicates(df.select("plan", "i", "id"), ("plan",), "id", "i").select("plan", F.concat(place, F.lit(".id")).alias("field"), F.concat(F.lit(f'duplicate {what} ID "'), "id", F.lit('"')).alias("message")))
    refs = s.select("plan", F.concat(s_at, F.lit(".requires")).alias("field"), F.explode("requires").alias("id"))
    out.append(unknown(refs, d, ["plan", "id"]).select("plan", "field", F.concat(F.lit('references unknown diagnostic ID "'), "id", F.lit('"')).alias("message")))
    deps = t.filter(~_empty(c("id"))).select("plan", "i", F.col("id").alias("own"), F.explode("dependsOn").alias("dep")).filter("dep != own")
    earlier = t.groupBy(F.col("plan").alias("p2"), F.col("id").alias("known")).agg(F.min("i").alias("j"))
    lost = deps.join(earlier, (deps["plan"] == earlier["p2"]) & (deps["dep"] == earlier["known"]) & (earlier["j"] < deps["i"]), "left_anti")
    out.append(lost.select("plan", F.concat(t_at, F.lit(".dependsOn")).alias("field"), F.concat(F.lit('references unknown task ID "'), "dep", F.lit('"')).alias("message")))
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    return rows.withColumn("severity", F.lit("error"))


def verdicts(plans: DataFrame) -> DataFrame:
    """(plan, valid, n_errors) of every plan."""
    n = errors(plans).groupBy("plan").agg(F.count("*").alias("n_errors"))
    return plans.select("plan").join(n, "plan", "left").select("plan", F.col("n_errors").isNull().alias("valid"), F.coalesce("n_errors", F.lit(0)).alias("n_errors"))
