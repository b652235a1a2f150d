"""Text and markdown of small results, and JSON files. All take rows as plain dicts, as row.asDict(recursive=True) gives them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rows(df: DataFrame, limit: int = 10_000) -> list[dict]:
    """The rows of a report; more than limit is an error, since reports are for people."""
    found = df.limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"a report has at most {limit} rows")
    return [r.asDict(recursive=True) for r in found]


def table(items: list[dict], columns: list[str] | None = None) -> str:
    """A markdown table."""
    columns = columns or (list(items[0]) if items else [])
    cell = lambda v: "" if v is None else ", ".join(map(str, v)) if isinstance(v, list) else str(v).replace("|", "\\|").replace("\n", " ")
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *("| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in items)])


def findings(items: list[dict], markdown: bool = False) -> str:
    if not items:
        return "No findings."
    if markdown:
        return "# Findings\n\n" + table(items, ["severity", "code", "file", "line", "message"])
    return "\n".join(f"{r['severity']:<7}{r['code']}  {r['file']}:{r['line'] or 0}  {r['message']}" for r in items)


def plan(head: dict, steps: list[dict], markdown: bool = False) -> str:
    lines = [f"# {head['goal']}" if markdown else head["goal"], f"plan {head['plan_id']}, risk {head['risk']}, {len(steps)} steps", ""]
    for s in steps:
        lines.append(f"{'- [ ] ' if markdown else ''}{s['step_id']}: {s['action']} ({s['risk']}; {', '.join(s['verify'])})")
    return "\n".join(lines)


def review(v: dict, found: list[dict], markdown: bool = False) -> str:
    head = f"{'## ' if markdown else ''}{v['status'].upper()}: {v['reason']}"
    lines = [head, f"{v['changed']} changed lines in {v['files']} files; {v['recommendation']}"]
    return "\n".join(lines + [f"- {d['code']} ({d['severity']}): {d['message']}" for d in found])


def tasks(items: list[dict], markdown: bool = False) -> str:
    out = []
    for t in items:
        after = f" after {', '.join(t['depends_on'])}" if t["depends_on"] else ""
        out += [f"{'## ' if markdown else ''}{t['task_id']}: {t['goal']}{after}", *(f"- {f}" for f in t["allowed_files"]), f"at most {t['max_lines']} lines; check with {'; '.join(t['verification'])}", ""]
    return "\n".join(out)


def checks(items: list[dict], markdown: bool = False) -> str:
    if markdown:
        return table(items, ["name", "status", "message"])
    return "\n".join(f"[{r['status']}] {r['name']}: {r['message']}" for r in items)


#: What a better score takes, for reports.
IMPROVEMENTS = ("Deal with findings of high severity first.", "Start with the files that have most findings.", "Follow the plan step by step and verify each.", "Run the analysis again and compare scores.")


def proof(counts: dict, score: int, label: str, codes: list[dict], worst: list[dict], markdown: bool = False) -> str:
    h = "## " if markdown else ""
    lines = [f"{'# ' if markdown else ''}Health {score}/100 ({label})", f"{counts['findings']} findings in {counts['files']} files: {counts['high']} high, {counts['medium']} medium, {counts['low']} low", "", f"{h}Codes"]
    lines += [f"- {c['code']}: {c['n']}" for c in codes] + ["", f"{h}Files"] + [f"- {w['file']}: {w['n']}" for w in worst]
    return "\n".join(lines + ["", f"{h}Next", *(f"- {x}" for x in IMPROVEMENTS)])


def write_json(df: DataFrame, path: str, single: bool = False) -> None:
    """JSON lines; single makes one file of a report."""
    (df.coalesce(1) if single else df).write.mode("overwrite").json(path)


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as JSON. An infinite ratio becomes null with a flag beside it, as JSON has no such number."""
    out = df
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float"):
            infinite = F.abs(F.col(f.name)) == float("inf")
            out = out.withColumn(f"{f.name}_infinite", F.when(infinite, True)).withColumn(f.name, F.when(~infinite, F.col(f.name)))
    return out.select(F.to_json(F.struct("*")).alias("json"))
