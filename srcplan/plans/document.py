"""Plan documents: made from relations, brought to normal form after reading, and written. A document is one row; what is nested in it is ordered in place, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcplan.functions import text
from srcplan.plans.plan import VERSION

TYPE, PACK_TYPE = "dev.refactor.plan", "dev.refactor.context"


def verification(commands: Column) -> Column:
    """Commands as a document has them: all required, by default of the binding, of medium confidence."""
    return F.transform(commands, lambda c: F.struct(c.alias("command"), F.lit(True).alias("required"), F.lit("binding-default").alias("source"), F.lit("medium").alias("confidence"), F.lit(None).cast("string").alias("type")))


def _given(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def public(heads: DataFrame, findings: DataFrame, steps: DataFrame, source: str = "srcplan") -> DataFrame:
    """One document for each head, in the shape of validate.PLAN as far as it is known.

    heads: plan, plan_id, target, language, goal, risk, verify (array of commands). findings: plan, diag_idx (its place in the plan), code, severity, confidence, message, file, line, symbol, component, kind;
    missing columns are empty. steps: plan, step_no, step_id, recipe, action, file, risk, verify, diag_idx of the finding it answers, counted from 0 as findings are; a place that the plan has not gives no requirement.
    """
    has = lambda c: _given(F.col(c)) if c in findings.columns else F.lit(None).cast("string")
    name, kind = F.coalesce(has("symbol"), has("component")), has("kind")
    symbol = F.when(name.isNotNull() | kind.isNotNull(), F.struct(F.coalesce(kind, F.lit("")).alias("kind"), F.coalesce(name, F.lit("")).alias("name")))
    d = findings.select("plan", F.struct("diag_idx", "code", "severity", F.coalesce(has("confidence"), F.lit("high")).alias("confidence"), "message", "file", "line", symbol.alias("symbol")).alias("d"))
    d = d.groupBy("plan").agg(F.array_sort(F.collect_list("d")).alias("d"))
    s = steps.select("plan", F.struct("step_no", "step_id", "recipe", "action", "file", "risk", "verify", "diag_idx").alias("s")).groupBy("plan").agg(F.array_sort(F.collect_list("s")).alias("s"))
    j = heads.join(d, "plan", "left").join(s, "plan", "left")
    found, asked = F.coalesce("d", F.array()), F.coalesce("s", F.array())
    diagnostics = F.transform(found, lambda x, i: F.struct(F.concat(F.lit("diag_"), i.cast("string")).alias("id"), *(x[c].alias(c) for c in ("code", "severity", "confidence", "message", "file", "line", "symbol"))))
    requires = lambda x: F.when((x["diag_idx"] >= 0) & (x["diag_idx"] < F.size(found)), F.array(F.concat(F.lit("diag_"), x["diag_idx"].cast("string"))))
    none = F.lit(None).cast("string")
    made = F.transform(
        asked,
        lambda x: F.struct(
            x["step_id"].alias("id"), x["recipe"].alias("recipe"), F.coalesce(_given(x["recipe"]), x["action"]).alias("title"), x["action"].alias("action"), F.struct(x["file"].alias("file"), none.alias("symbol"), none.alias("kind")).alias("target"),
            x["risk"].alias("risk"), requires(x).alias("requires"), verification(x["verify"]).alias("verify"),
        ),
    )
    return j.select(
        "plan", F.lit(VERSION).alias("specversion"), F.col("plan_id").alias("id"), F.lit(TYPE).alias("type"), F.lit(source).alias("source"), F.col("target").alias("subject"), F.coalesce(_given(F.col("language")), F.lit("auto")).alias("language"), "goal", "risk",
        diagnostics.alias("diagnostics"), made.alias("steps"), verification(F.col("verify")).alias("verification"),
    )


def _rank(c: Column) -> Column:
    """Unknown severities go with the highest."""
    return F.when(c == "medium", 1).when(c == "low", 2).otherwise(0)


def _sorted(items: Column, *key) -> Column:
    """Items in the order of their keys; equal ones keep theirs."""
    keyed = F.transform(items, lambda x, i: F.struct(*[k(x).alias(f"k{n}") for n, k in enumerate(key)], i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda e: e["x"])


def normalized(plans: DataFrame) -> DataFrame:
    """Documents as validate.PLAN has them in normal form: findings and steps sorted and numbered anew, requirements follow their findings, tasks and what they list sorted.

    A requirement that no finding answers stays as it is; of findings that share an id the last in order answers. Columns other than diagnostics, steps and decomposition stay.
    """
    text_of = lambda c: F.coalesce(c, F.lit(""))
    line = lambda d: F.when(F.coalesce(d["line"], F.lit(0)) == 0, 2**31 - 1).otherwise(d["line"])
    old = _sorted(F.col("diagnostics"), lambda d: _rank(d["severity"]), lambda d: text_of(d["file"]), line, lambda d: text_of(d["code"]), lambda d: text_of(d["symbol"]["name"]), lambda d: text_of(d["message"]))
    out = plans.withColumn("_old", F.coalesce(old, F.array()))
    names = [f.name for f in plans.schema["diagnostics"].dataType.elementType.fields]
    number = lambda prefix, i: F.format_string(prefix + "_%03d", i + 1)
    out = out.withColumn("diagnostics", F.transform("_old", lambda d, i: F.struct(*[(number("diag", i) if c == "id" else d[c]).alias(c) for c in names])))

    def answer(r: Column) -> Column:
        """The number of the finding that a requirement means, 0 for none."""
        return F.coalesce(F.array_max(F.transform(F.col("_old"), lambda d, i: F.when(d["id"] == r, i + 1))), F.lit(0))

    steps = _sorted(F.col("steps"), lambda s: _rank(s["risk"]), lambda s: text_of(s["target"]["file"]), lambda s: text_of(s["recipe"]), lambda s: text_of(s["action"]))
    wanted = [f.name for f in plans.schema["steps"].dataType.elementType.fields]
    # requirements as numbers first, from which code and symbol follow
    out = out.withColumn("_steps", F.transform(steps, lambda s: F.struct(s.alias("s"), F.transform(F.coalesce(s["requires"], F.array()), answer).alias("n"))))
    at = lambda n: F.try_element_at("diagnostics", F.nullif(n, F.lit(0)))
    code = lambda e: F.coalesce(at(F.try_element_at(e["n"], F.lit(1)))["code"], _given(e["s"]["recipe"]), F.lit("unknown"))
    symbol = lambda e: F.try_element_at(F.filter(F.transform(e["n"], lambda n: at(n)["symbol"]["name"]), lambda x: text_of(x) != ""), F.lit(1))
    slug = lambda e: F.coalesce(text.slug(symbol(e)), text.slug(text.stem(text_of(e["s"]["target"]["file"]))))
    step_id = lambda e, i: F.format_string("step_%03d_%s_%s", i + 1, code(e), slug(e))
    again = lambda e: F.zip_with(F.coalesce(e["s"]["requires"], F.array()), e["n"], lambda r, n: F.when(n > 0, number("diag", n - 1)).otherwise(r))
    out = out.withColumn("steps", F.transform("_steps", lambda e, i: F.struct(*[{"id": step_id(e, i), "requires": again(e)}.get(c, e["s"][c]).alias(c) for c in wanted])))
    if "decomposition" in plans.columns:
        kinds = {f.name: f.dataType for f in plans.schema["decomposition"].dataType["tasks"].dataType.elementType.fields}
        tidy = lambda t: F.struct(*[(F.array_sort(t[c]) if k.typeName() == "array" else t[c]).alias(c) for c, k in kinds.items()])
        rest = [f.name for f in plans.schema["decomposition"].dataType.fields if f.name != "tasks"]
        tasks = F.transform(_sorted(F.col("decomposition.tasks"), lambda t: text_of(t["id"])), tidy)
        out = out.withColumn("decomposition", F.when(F.col("decomposition").isNotNull(), F.struct(*[F.col(f"decomposition.{c}").alias(c) for c in rest], tasks.alias("tasks"))))
    return out.select(*plans.columns)


def public_pack(packs: DataFrame) -> DataFrame:
    """Packs (goal, token_budget, token_estimate, files, snippets, diagnostics, steps, verification, plan_id and keys) as they are handed out."""
    named = {"token_budget", "token_estimate", "plan_id", "goal", "files", "snippets", "diagnostics", "steps", "verification"}
    keys = [c for c in packs.columns if c not in named]
    budget = F.struct(F.col("token_budget").alias("maxTokens"), F.col("token_estimate").alias("estimatedTokens"))
    return packs.select(*keys, F.lit(VERSION).alias("specversion"), F.lit(PACK_TYPE).alias("type"), F.col("plan_id").alias("planId"), budget.alias("budget"), "goal", "diagnostics", "steps", "files", "snippets", "verification")


def write(plans: DataFrame, path: str) -> None:
    """Writes each document as a JSON file of its own in a folder plan=<key>, from where sources.files.plans reads it."""
    body = F.to_json(F.struct(*[c for c in plans.columns if c != "plan"]))
    plans.select("plan", body.alias("value")).repartition("plan").write.partitionBy("plan").mode("overwrite").text(path)
