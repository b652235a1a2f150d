"""What a file's path tells: parts of it, and the categories that changes are sorted into. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCKFILES = ("bun.lock", "Cargo.lock", "Gemfile.lock", "go.sum", "package-lock.json", "pnpm-lock.yaml", "yarn.lock")
GENERATED_NAMES = (*LOCKFILES, "composer.lock", "poetry.lock")
#: Prefixes, so that `distribution/x` counts too.
GENERATED_DIRS = (".cache", ".next", "build", "dist", "node_modules")


def base(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """From the last dot of the name on, '' without one."""
    return F.regexp_extract(base(path), r"(\.[^.]*)$", 1)


def directory(path: Column) -> Column:
    """What precedes the last slash, '.' without one."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(F.lit("."))


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def ends(c: Column, *suffixes: str) -> Column:
    return _any([c.endswith(s) for s in suffixes])


def starts(c: Column, *prefixes: str) -> Column:
    return _any([c.startswith(s) for s in prefixes])


def holds(c: Column, *parts: str) -> Column:
    return _any([c.contains(s) for s in parts])


def is_lockfile(path: Column) -> Column:
    return base(path).isin(*LOCKFILES)


def is_generated(path: Column) -> Column:
    return base(path).isin(*GENERATED_NAMES) | starts(directory(path), *GENERATED_DIRS)


def diff_category(path: Column) -> Column:
    """The category of a changed file in a review; the first rule that holds decides."""
    ext, where = extension(path), directory(path)
    return (
        F.when(starts(where, "internal/", "pkg/"), "library")
        .when(ext == ".go", "go")
        .when(ext.isin(".js", ".jsx", ".ts", ".tsx"), "typescript")
        .when(ext.isin(".css", ".less", ".scss"), "style")
        .when(ext.isin(".json", ".toml", ".yaml", ".yml"), "config")
        .when(ext.isin(".md", ".txt"), "documentation")
        .when(path.startswith("test") | ends(path, "_test.go", ".test.ts"), "test")
        .otherwise("other")
    )


def task_category(path: Column) -> Column:
    """The category of a changed file in a decomposition."""
    ext, name, where = F.lower(extension(path)), F.lower(base(path)), directory(path)
    return (
        F.when(ext == ".go", F.when(name.endswith("_test.go"), "test").otherwise("go"))
        .when(ext.isin(".ts", ".tsx"), "typescript")
        .when(ext.isin(".js", ".jsx"), "javascript")
        .when(ext.isin(".css", ".less", ".sass", ".scss"), "style")
        .when(ext == ".md", "documentation")
        .when(ext.isin(".json", ".toml", ".yaml", ".yml"), "config")
        .when((ext == ".sql") | holds(where, "migrate", "migrations"), "schema")
        .when(ext == ".proto", "proto")
        .when(ext == ".py", "python")
        .when(ext == ".rs", "rust")
        .otherwise("other")
    )


def bucket(path: Column, generated: Column, lockfile: Column) -> Column:
    """What kind of work added lines of a file are."""
    name = base(path)
    test = ends(name, "_test.go", "_test.ts", "_test.tsx") | holds(name, ".spec.", ".test.") | holds(path, "/test/", "/__tests__/") | starts(path, "test/", "__tests__/")
    structural = (
        starts(name, ".babelrc", ".eslintrc", ".prettierrc", "tsconfig")
        | path.contains(".github/")
        | name.isin(".browserslistrc", ".gitlab-ci.yml", "Cargo.toml", "Dockerfile", "Gemfile", "Gemfile.lock", "Makefile", "Package.resolved", "go.mod", "go.sum")
    )
    made = starts(path, "gen/", "node_modules/", "vendor/") | ends(name, ".pb.go", ".pb.swift", ".pb.ts") | name.isin("Cargo.lock", "package-lock.json", "yarn.lock")
    return (
        F.when(generated | lockfile, "generated")
        .when(test, "test")
        .when(structural, "config_structural")
        .when(ends(path, ".css", ".less", ".scss", ".json"), "config_data")
        .when(made, "generated")
        .otherwise("logic")
    )


def tokens(path: Column) -> Column:
    """The distinct words of a path, cut at slashes and dots."""
    return F.array_distinct(F.filter(F.split(path, "[/.]"), lambda x: x != ""))


def is_absolute(path: Column) -> Column:
    return path.rlike(r"^/|^\\\\.|^[A-Za-z]:[\\/]")


def redact_path(path: Column) -> Column:
    """An absolute path keeps its last two parts."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    return F.when(path.startswith("/"), F.when(F.size(parts) > 2, F.concat_ws("/", F.lit("<redacted>"), F.nullif(F.element_at(parts, -2), F.lit("")), last)).otherwise(F.concat_ws("/", F.lit("<redacted>"), last))).otherwise(path)


def public_path(path: Column) -> Column:
    """Words that hint at private places give way to `synthetic`."""
    return F.regexp_replace(path, "private|secret", "synthetic")
