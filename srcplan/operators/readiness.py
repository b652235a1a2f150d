"""Readiness of repositories, from facts about their files: commands that verify them, checks, gates, and the verdict on all.

Facts: repo, rel_path, is_dir, content (null where it is not needed). One aggregation makes a row for each repository, with the contents of the
few files that checks look at; everything after it is a projection. A folder is there if a fact says so or a file lies in it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

MANAGERS = [("bun.lock", "bun"), ("bun.lockb", "bun"), ("pnpm-lock.yaml", "pnpm"), ("yarn.lock", "yarn"), ("package-lock.json", "npm"), ("go.mod", "go"), ("Cargo.toml", "cargo"), ("package.json", "npm")]
LINT_FILES = (".eslintrc", ".eslintrc.js", ".eslintrc.json", ".eslintrc.yaml", ".eslintrc.yml")
GOLANGCI = (".golangci.yaml", ".golangci.yml")
ENV_FILES = (".env", ".env.local", ".env.production", ".env.development")
SCRIPTS = ("typecheck", "lint", "test", "build", "format")
VERIFYING = ("lint", "test", "typecheck", "build", "check")
ESSENTIAL = ("go.mod", "package.json", "tsconfig.json", "Makefile")
HEALTH = ("health", "livez", "probes", "readiness", "readyz")
_FILES = ["go.mod", "package.json", "Cargo.toml", "requirements.txt", "pyproject.toml", "README.md", ".gitignore", "LICENSE", "next.config.js", "next.config.ts", "convex.json", "middleware.ts", "src/middleware.ts", "vercel.json", "AGENTS.md", "tsconfig.json", "Makefile", "Dockerfile", "manifest.json"]
_FILES += [*LINT_FILES, *GOLANGCI, *ENV_FILES, *(n for n, _ in MANAGERS)]
_DIRS = ["convex", ".opencode/agents", ".grp", ".github/workflows"]
CHECK = "struct<name:string,status:string,message:string,required:boolean>"
COMMAND = "struct<name:string,command:string,required:boolean,source:string,type:string>"


class Repo:
    """Columns that tell of one repository's files."""

    def __init__(self, config: str = ".agent") -> None:
        self.config = config
        self.files = list(dict.fromkeys([*_FILES, *(f"{config}/{n}" for n in ("launchkit.yaml", "preflight.json", "preflight.yaml", "manifest.json", "tenancy.yaml"))]))
        self.dirs = [*_DIRS, config]

    def gather(self, facts: DataFrame) -> DataFrame:
        p, is_dir, body = F.col("rel_path"), F.coalesce("is_dir", F.lit(False)), F.coalesce("content", F.lit(""))
        near = ~is_dir & ~p.contains("/") & F.lower(p).rlike("|".join(HEALTH))
        return facts.groupBy("repo").agg(
            *[F.max(F.when(~is_dir & (p == f), body)).alias(f"f{i}") for i, f in enumerate(self.files)],
            *[F.bool_or((is_dir & (p == d)) | p.startswith(d + "/")).alias(f"d{i}") for i, d in enumerate(self.dirs)],
            F.array_sort(F.collect_set(F.when(near, p))).alias("health"),
        )

    def text(self, path: str) -> Column:
        return F.col(f"f{self.files.index(path)}")

    def file(self, *paths: str) -> Column:
        out = F.lit(False)
        for p in paths:
            out = out | self.text(p).isNotNull()
        return out

    def folder(self, path: str) -> Column:
        return F.coalesce(F.col(f"d{self.dirs.index(path)}"), F.lit(False))

    def scripts(self) -> Column:
        """The names of the scripts in package.json; null if there are none to read."""
        return F.map_keys(F.from_json(F.get_json_object(self.text("package.json"), "$.scripts"), "map<string,string>"))


def package_manager(r: Repo) -> Column:
    return F.coalesce(*[F.when(r.file(name), manager) for name, manager in MANAGERS], F.lit("unknown"))


def _command(name, command, required: bool, source: str, kind: str) -> Column:
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(col(name).alias("name"), col(command).alias("command"), F.lit(required).alias("required"), F.lit(source).alias("source"), F.lit(kind).alias("type"))


def commands(r: Repo) -> Column:
    """What verifies the repository, in order."""
    m = package_manager(r)
    runner = F.when(m == "bun", "bun run").when(m.isin("pnpm", "yarn"), m).otherwise("npm run")
    out = [F.when(F.array_contains(r.scripts(), s), _command(s, F.concat(runner, F.lit(f" {s}")), s in ("build", "typecheck"), "package.json", "script")) for s in SCRIPTS]
    out += [F.when((m == "go") & r.file("go.mod"), _command(f"Go {w}", f"go {w} ./...", True, "go.mod", k)) for w, k in (("build", "build"), ("vet", "lint"), ("test", "test"))]
    out += [F.when((m == "cargo") & r.file("Cargo.toml"), _command(f"Cargo {w}", f"cargo {w}", w != "clippy", "Cargo.toml", k)) for w, k in (("build", "build"), ("clippy", "lint"), ("test", "test"))]
    out.append(F.when(r.text("Makefile").contains("test:"), _command("make test", "make test", False, "Makefile", "test")))
    out.append(F.when(r.file(*GOLANGCI), _command("golangci-lint", "golangci-lint run", False, "config-file", "lint")))
    return F.array_compact(F.array(*out))


def verification(facts: DataFrame) -> DataFrame:
    """(repo, manager, has_config, has_convex, has_docker, has_ci, has_golangci, has_makefile, commands)."""
    r = Repo()
    flags = {"has_config": r.file("tsconfig.json"), "has_convex": r.folder("convex"), "has_docker": r.file("Dockerfile"), "has_ci": r.folder(".github/workflows"), "has_golangci": r.file(*GOLANGCI), "has_makefile": r.file("Makefile")}
    return r.gather(facts).select("repo", package_manager(r).alias("manager"), *[c.alias(n) for n, c in flags.items()], commands(r).alias("commands"))


def _check(name: str, cases: list[tuple[Column, str, Column | str]], last: tuple[str, Column | str], required: bool = False) -> Column:
    """The first case (test, status, message) that holds, else last."""
    made = lambda status, message: F.struct(F.lit(name).alias("name"), (status if isinstance(status, Column) else F.lit(status)).alias("status"), (message if isinstance(message, Column) else F.lit(message)).alias("message"), F.lit(required).alias("required"))
    out = None
    for test, status, message in cases:
        out = F.when(test, made(status, message)) if out is None else out.when(test, made(status, message))
    return out.otherwise(made(*last))


def _there(name: str, r: Repo, path: str) -> Column:
    return _check(name, [(r.file(path), "pass", f"{path} exists")], ("warn", f"{path} not found"))


def _listed(*items: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(t, F.lit(n)) for t, n in items]))


def _valid_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def generic_checks(r: Repo) -> list[Column]:
    manifest = [
        (r.file("go.mod"), "pass", "Go module detected (go.mod)"),
        (r.file("package.json"), "pass", "Node.js project detected (package.json)"),
        (r.file("Cargo.toml"), "pass", "Rust project detected (Cargo.toml)"),
        (r.file("requirements.txt", "pyproject.toml"), "pass", "Python project detected"),
    ]
    return [_check("Package Manager", manifest, ("warn", "No recognized package manager manifest found")), _there("README", r, "README.md"), _there(".gitignore", r, ".gitignore"), _there("License", r, "LICENSE")]


def agent_checks(r: Repo) -> list[Column]:
    """Checks of web applications that agents change; their configuration lies in the folder r.config."""
    c = r.config
    own = lambda name: r.text(f"{c}/{name}")
    lost = _listed((own("tenancy.yaml").isNull(), "tenancy.yaml"), (own("launchkit.yaml").isNull(), "launchkit.yaml"))
    manifest, root_manifest = own("manifest.json"), r.text("manifest.json")
    environment = own("tenancy.yaml").contains("environment:") | own("tenancy.yaml").contains("env:")
    isolation = own("tenancy.yaml").rlike("isolation|sandbox|tenant")
    middleware = F.coalesce(r.text("middleware.ts"), r.text("src/middleware.ts"))
    scripts = F.filter(F.array(*map(F.lit, VERIFYING)), lambda s: F.array_contains(r.scripts(), s))
    env = _listed(*((r.file(n), n) for n in ENV_FILES))
    return [
        _check("Agent Directory", [(~r.folder(c), "fail", f"{c}/ directory not found"), (F.size(lost) == 0, "pass", f"{c}/ exists with tenancy.yaml and launchkit.yaml")], ("warn", F.concat(F.lit(f"{c}/ exists but missing: "), F.array_join(lost, ", ")))),
        _check(
            "Manifest",
            [
                (manifest.isNotNull() & _valid_json(manifest), "pass", f"{c}/manifest.json exists and is valid JSON"),
                (root_manifest.isNotNull() & _valid_json(root_manifest), "pass", "manifest.json exists and is valid JSON"),
                (manifest.isNotNull() | root_manifest.isNotNull(), "fail", "manifest found but contains invalid JSON"),
            ],
            ("warn", f"no manifest.json found in {c}/ or project root"),
        ),
        _check("Preflight Config", [(own(n).isNotNull(), "pass", f"{c}/{n} exists") for n in ("preflight.yaml", "preflight.json")], ("warn", f"no preflight config found in {c}/")),
        _check("Launch Kit", [(own("launchkit.yaml").isNull(), "fail", f"{c}/launchkit.yaml not found"), (own("launchkit.yaml").rlike("gates?:"), "pass", f"{c}/launchkit.yaml exists with gates defined")], ("warn", f"{c}/launchkit.yaml exists but no gates defined")),
        _check(
            "Tenancy",
            [(own("tenancy.yaml").isNull(), "fail", f"{c}/tenancy.yaml not found"), (environment & isolation, "pass", f"{c}/tenancy.yaml exists with environment and isolation settings")],
            ("warn", F.concat(F.lit(f"{c}/tenancy.yaml exists but missing: "), F.array_join(_listed((~environment, "environment setting"), (~isolation, "isolation setting")), ", "))),
        ),
        _check("Next.js Config", [(r.file(n), "pass", f"{n} exists") for n in ("next.config.js", "next.config.ts")], ("warn", "Next.js config not found")),
        _check("Convex Config", [(r.file("convex.json"), "pass", "convex.json exists"), (r.folder("convex"), "pass", "convex/ directory exists")], ("warn", "No convex.json or convex/ directory found")),
        _check("Clerk Config", [(middleware.isNull(), "warn", "middleware.ts not found"), (middleware.rlike("clerkMiddleware|@clerk/nextjs"), "pass", "middleware.ts has Clerk references")], ("warn", "middleware.ts found but no Clerk references detected")),
        _there("Vercel Config", r, "vercel.json"),
        _check("AGENTS.md", [(r.file("AGENTS.md"), "pass", "AGENTS.md exists"), (r.folder(".opencode/agents"), "pass", ".opencode/agents/ directory exists")], ("warn", "No AGENTS.md or .opencode/agents/ found")),
        _check(".grp Directory", [(r.folder(".grp"), "pass", ".grp/ directory exists")], ("warn", ".grp/ directory not found")),
        _check(
            "Verification Scripts",
            [(~r.file("package.json"), "warn", "package.json not found, cannot verify scripts"), (r.scripts().isNull(), "warn", "package.json has no scripts section"), (F.size(scripts) > 0, "pass", F.concat(F.lit("Found verification scripts: "), F.array_join(scripts, ", ")))],
            ("warn", f"No standard verification scripts ({', '.join(VERIFYING)}) found"),
        ),
        _check("Secret Files", [(F.size(env) > 0, "pass", F.concat(F.lit("Found secret files: "), F.array_join(env, ", ")))], ("warn", "No .env files found (might be expected for some projects)")),
    ]


def preflight(facts: DataFrame, profile: str = "auto", config: str = ".agent") -> DataFrame:
    """(repo, profile, ord, name, status, message, required): profile generic, agent-next-convex, or auto, which looks for the folder config and a Next.js or Convex configuration."""
    r = Repo(config)
    fits = r.folder(config) & (r.file("next.config.js", "next.config.ts", "convex.json") | r.folder("convex"))
    agent = fits if profile == "auto" else F.lit(profile == "agent-next-convex")
    g = r.gather(facts).select("repo", F.when(agent, "agent-next-convex").otherwise("generic").alias("profile"), F.when(agent, F.array(*agent_checks(r))).otherwise(F.array(*generic_checks(r))).alias("c"))
    return g.select("repo", "profile", F.posexplode("c").alias("ord", "c")).select("repo", "profile", "ord", "c.*")


def prove(facts: DataFrame, build: bool = True, test: bool = True, docker: bool = False, ci: bool = False) -> DataFrame:
    """(repo, ord, name, status, message, required): whether an application is ready to deploy. docker, ci: whether they are required."""
    r = Repo()
    g = r.gather(facts).withColumn("commands", commands(r))
    sources = lambda test: F.transform(F.filter("commands", test), lambda x: x["source"])
    named = lambda x, w: (F.lower(x["name"]) == w) | (x["type"] == w)
    manifest = _listed((r.file("go.mod"), "go.mod"), (r.file("package.json") & ~r.file("go.mod"), "package.json"))

    def configured(name: str, found: Column, what: str, last: tuple[str, str], required: bool) -> Column:
        some = F.array_distinct(found)
        return _check(name, [(F.size(some) > 0, "pass", F.concat(F.lit(f"{what} configured ("), F.array_join(some, ", "), F.lit(")")))], last, required)

    or_manifest = lambda found: F.when(F.size(found) > 0, found).otherwise(manifest)
    config = _listed(*((r.file(n), n) for n in ESSENTIAL))
    builds = sources(lambda x: named(x, "build") | x["command"].contains("build"))
    tests = sources(lambda x: named(x, "test") | x["command"].contains("test"))
    types = F.concat(_listed((r.file("tsconfig.json"), "tsconfig.json")), sources(lambda x: (F.lower(x["name"]) == "typecheck") | x["command"].rlike("go vet|typecheck|tsc")))
    types = F.when(F.size(types) > 0, types).otherwise(_listed((r.file("go.mod"), "go.mod")))
    lints = F.concat(_listed((r.file(*GOLANGCI), ".golangci.yml")), sources(lambda x: named(x, "lint") | x["command"].rlike("golangci-lint|eslint")))
    lints = F.when(F.size(lints) > 0, lints).otherwise(_listed((r.file(*LINT_FILES), "config-file")))
    health = F.concat("health", _listed((F.lower(r.text("package.json")).rlike("health|readinessprobe"), "package.json"), (F.lower(r.text("go.mod")).contains("health"), "go.mod")))
    checks = [
        _check("Config", [(F.size(config) > 0, "pass", F.concat(F.lit("Essential config files present ("), F.array_join(config, ", "), F.lit(")")))], ("fail", f"No essential config files found ({', '.join(ESSENTIAL)})"), True),
        configured("Build", or_manifest(builds), "Build", ("fail", "No build configuration found"), True) if build else None,
        configured("Test", or_manifest(tests), "Tests", ("warn", "No test configuration found"), True) if test else None,
        configured("Type Check", types, "Type checking", ("warn", "No type checking configuration found"), True),
        configured("Lint", lints, "Linting", ("warn", "No lint configuration found"), False),
        _check("Docker", [(r.file("Dockerfile"), "pass", "Dockerfile found")], ("fail" if docker else "warn", "No Dockerfile found"), docker),
        _check("CI", [(r.folder(".github/workflows"), "pass", "CI workflow found")], ("fail" if ci else "warn", "No CI workflow found"), ci),
        _check("Health", [(F.size(health) > 0, "pass", F.concat(F.lit("Health check indicators found ("), F.array_join(health, ", "), F.lit(")")))], ("warn", "No health check endpoints or probes found")),
    ]
    g = g.select("repo", F.posexplode(F.array(*[c for c in checks if c is not None])).alias("ord", "c"))
    return g.select("repo", "ord", "c.*")


def rollup(checks: DataFrame, by_need: bool = False) -> DataFrame:
    """(repo, total, passed, warned, failed, status). by_need: only required checks fail a repository and only optional ones warn."""
    n = lambda s: F.count_if(F.col("status") == s)
    bad, odd = F.col("status") == "fail", F.col("status") == "warn"
    if by_need:
        bad, odd = bad & F.col("required"), odd & ~F.col("required")
    overall = F.when(F.bool_or(bad), "fail").when(F.bool_or(odd), "warn").otherwise("pass")
    return checks.groupBy("repo").agg(F.count("*").alias("total"), n("pass").alias("passed"), n("warn").alias("warned"), n("fail").alias("failed"), overall.alias("status"))


# ---- launch kits

KIT = "repo string, path string, version string, receipt_enabled boolean, receipt_format string, gates array<struct<gate:string,required:boolean,command:string>>"


def parse_kit(content: str, path: str) -> dict | None:
    """A launch kit from JSON, or from YAML of the flat kind in which each gate is an inline map; None if it is neither."""
    if path.endswith(".json"):
        try:
            raw = json.loads(content)
            raw = raw.get("launch_kit", raw)
            gates = [{"gate": k, "required": bool(g.get("required", False)), "command": str(g.get("command", ""))} for k, g in (raw.get("gates") or {}).items()]
            receipt = raw.get("receipt") or {}
            return {"version": str(raw.get("version", "")), "receipt_enabled": bool(receipt.get("enabled", False)), "receipt_format": str(receipt.get("format", "")), "gates": gates}
        except (ValueError, AttributeError):
            return None
    out, gates, part = {"version": "", "receipt_enabled": False, "receipt_format": ""}, {}, ""
    for line in map(str.strip, content.split("\n")):
        if line in ("gates:", "receipt:"):
            part = line
            continue
        if not line or line[0] == "#" or line == "launch_kit:" or ":" not in line:
            continue
        key, rest = (x.strip() for x in line.split(":", 1))
        if part == "gates:":
            if m := re.fullmatch(r"\{(.*)\}", rest):
                items = dict(tuple(x.strip() for x in p.split(":", 1)) for p in m.group(1).split(",") if ":" in p)
                gates[key] = {"gate": key, "required": items.get("required") == "true", "command": items.get("command", "").strip('"')}
        elif part == "receipt:":
            if key == "enabled":
                out["receipt_enabled"] = rest in ("true", "yes")
            elif key == "format":
                out["receipt_format"] = rest.strip('"')
        elif key == "version":
            out["version"] = rest.strip('"')
    return out | {"gates": list(gates.values())} if out["version"] or gates else None


def kits(facts: DataFrame, config: str = ".agent") -> DataFrame:
    """The launch kit of each repository that has one: the first of six places that can be read."""
    places = [f"{d}launchkit.{e}" for d in (f"{config}/", "") for e in ("json", "yaml", "yml")]
    at = F.array_position(F.array(*map(F.lit, places)), F.col("rel_path"))
    found = facts.filter(F.col("rel_path").isin(*places) & F.col("content").isNotNull()).select("repo", "rel_path", "content", at.cast("int").alias("at"))

    schema = T._parse_datatype_string(f"at int, kit struct<{', '.join(f'{a}:{b}' for a, b in (x.split(' ', 1) for x in KIT.split(', ')))}>")
    shape = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{"at": n, "kit": {"repo": r, "path": p} | k} for r, p, c, n in zip(*(x.to_pylist() for x in b.columns)) if (k := parse_kit(c, p)) is not None]
            yield pa.RecordBatch.from_pylist(rows, schema=shape)

    return found.mapInArrow(run, schema).groupBy(F.col("kit.repo").alias("repo")).agg(F.min_by("kit", "at").alias("kit")).select("kit.*")


def _named(name: str) -> Column:
    return F.filter("gates", lambda g: g["gate"] == name)


GATES = ("preflight", "review", "launchkit_validate", "prove_app")


def gate_results(kits: DataFrame, only: tuple[str, ...] = (), fail_fast: bool = False, program: str = "srcplan") -> DataFrame:
    """(repo, ord, name, status, message, command): checks of the schema, then of each gate; only limits the gates, fail_fast ends a repository's rows at the first failure."""
    item = lambda name, status, message, command=F.lit(""): F.struct(name.alias("name"), status.alias("status"), message.alias("message"), command.alias("command"))
    lit, q = F.lit, lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    names = F.transform("gates", lambda g: g["gate"])
    lower = F.transform(names, lambda x: F.lower(x))
    schema = F.array_compact(
        F.array(
            F.when((F.col("version") != "") & ~F.col("version").rlike(r"^\d+\.\d+$"), item(lit("version"), lit("fail"), F.concat(lit("version "), q(F.col("version")), lit(" is not MAJOR.MINOR")))),
            F.when(F.col("receipt_enabled") & ~F.col("receipt_format").isin("", "json", "yaml"), item(lit("receipt"), lit("warn"), F.concat(lit("receipt format "), q(F.col("receipt_format")), lit(" is neither json nor yaml")))),
        )
    )
    twice = F.array_compact(F.transform(names, lambda x, i: F.when(F.array_position(lower, F.lower(x)) <= i, item(x, lit("warn"), F.concat(lit("gate "), q(x), lit(" differs only in case from "), q(F.element_at(names, F.array_position(lower, F.lower(x)).cast("int"))))))))
    unknown = F.array_compact(F.transform(names, lambda x: F.when(~x.isin(*GATES), item(x, lit("warn"), F.concat(lit("unknown gate "), q(x))))))
    gates = []
    for name in GATES:
        if only and name not in only:
            continue
        g = F.try_element_at(_named(name), F.lit(1))
        command = F.coalesce(g["command"], F.lit(""))
        cases = [
            (g.isNull(), "fail", lit(f"{name} gate not configured")),
            (~g["required"], "warn", lit(f"{name} gate exists but is not marked required")),
            (command == "", "warn", lit(f"{name} gate has no command")),
            (~command.startswith(f"{program} "), "warn", F.concat(lit(f"{name} command "), q(command), lit(f' does not start with "{program} "'))),
        ]
        if name == "preflight":
            cases.append((~command.contains("preflight"), "warn", F.concat(lit("preflight command "), q(command), lit(" does not reference preflight"))))
        if name == "launchkit_validate":
            cases.append((F.col("version") == "", "fail", lit("launch kit has no version")))
        done = lit("launch kit self-validation passed" if name == "launchkit_validate" else f"{name} gate configured correctly")
        out = None
        for test, status, message in cases:
            x = item(lit(name), lit(status), message, command)
            out = F.when(test, x) if out is None else out.when(test, x)
        gates.append(out.otherwise(item(lit(name), lit("pass"), done, command)))
    every = kits.select("repo", F.posexplode(F.concat(schema, twice, unknown, F.array(*gates))).alias("ord", "x")).select("repo", "ord", "x.*")
    if fail_fast:
        w = Window.partitionBy("repo").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
        every = every.withColumn("before", F.coalesce(F.bool_or(F.col("status") == "fail").over(w), F.lit(False))).filter("not before").drop("before")
    return every
