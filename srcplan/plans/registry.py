"""Which recipe answers which finding. %s is the finding's target; a second %s is its file; {tool} names the calling program."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CHECKS = {
    "t": "typecheck", "T": "tests", "l": "lint", "B": "go build ./...", "V": "go vet ./...", "G": "go test ./...", "c": "cargo build", "C": "cargo test", "y": "cargo clippy", "k": "cargo check",
    "m": "mvn rewrite:run", "g": "gradle rewriteRun", "r": "rtk version", "i": "grit check", "a": "grit apply",
}

#: prefix of the codes -> lines of: code | recipe | risk (= copies the finding's severity) | checks by letter | action
_TABLE = {
    "react": """
large-component | split-large-component | = | tT | Split %s (%s) into smaller focused components
repeated-jsx | extract-repeated-jsx | low | tl | Extract repeated JSX in %s into a reusable component
too-many-hooks | extract-custom-hook | low | tT | Extract hooks from %s into custom hooks
too-many-state-vars | reduce-state-vars | medium | tT | Consolidate state variables in %s using useReducer
mixed-responsibilities | split-large-component | medium | tT | Separate concerns in %s by extracting non-UI logic
too-many-effects | consolidate-effects | medium | tT | Consolidate useEffect calls in %s
hardcoded-data | extract-constants | low | t | Move hardcoded data from %s to external constants file
missing-prop-types | add-prop-types | low | t | Add TypeScript props interface to %s""",
    "go": """
long-function | extract-function | = | BVG | Extract smaller functions from %s
high-complexity | simplify-branches | = | BVG | Simplify branching logic in %s with guard clauses and early returns
deep-nesting | flatten-nesting | = | BVG | Reduce nesting depth in %s by extracting helper functions
large-file | split-file | = | BG | Split %s into multiple files by responsibility
ignored-error | handle-error | medium | VB | Handle ignored errors in %s
too-many-params | extract-options-struct | low | BG | Group parameters in %s into an options struct""",
    "rust": """
long-function | extract-function | = | cC | Extract helper functions from %s to reduce function length
high-complexity | simplify-branches | = | yC | Reduce branching in %s with guard clauses or simpler match arms
deep-nesting | flatten-nesting | = | yC | Flatten deep nesting in %s with early returns or extracted helpers
large-file | split-file | = | cC | Split %s into smaller modules by responsibility
too-many-params | extract-options-struct | = | cC | Group parameters in %s into a builder or options struct""",
    "agent": """
diff-too-large | decompose-large-diff | high | BG | Decompose large diff in %s into smaller reviewable tasks
too-many-files-touched | decompose-large-diff | high | BG | Split multi-file change in %s into smaller focused tasks
mixed-boundaries | split-mixed-boundary | medium | BV | Separate concerns in %s: isolate schema, API, and UI changes
unreviewable-plan | extract-reviewable-task | high | BGV | Break unreviewable plan in %s into bounded reviewable tasks
parallelization-opportunity | generate-parallel-task-packs | low | BG | Create parallel task packs for independent changes in %s
high-overhead | extract-reusable-scaffold | medium | BG | Refactor ephemeral scaffold in %s into reusable builders
low-cohesion | flatten-cohesion-variance | medium | BV | Consolidate %s changes into fewer concern boundaries
test-to-code-imbalance | extract-reusable-scaffold | medium | GV | Extract test helpers from %s to reduce test-to-code ratio
ceremonial-noise | split-mixed-boundary | high | BGV | Reduce ceremonial noise in %s by splitting concerns and consolidating scaffold
productive-scaffold | extract-reusable-scaffold | low | BG | Continue extracting reusable scaffold from %s""",
    "openrewrite": """
refactor-opportunity | export-yaml-recipe | = | mg | Export diagnostics from %s as OpenRewrite YAML recipe
export-yaml | export-yaml-recipe | low | mg | Export {tool} diagnostics as OpenRewrite YAML recipe for %s""",
    "rtk": """
optimize-commands | pipe-through-proxy | low | r | Pipe {tool} commands through RTK for token-efficient output: rtk {tool} analyze/plan/pack %s
hook-configure | pipe-through-proxy | low | r | Configure RTK pre-tool hook for transparent command rewriting in %s""",
    "gritql": """
pattern-available | generate-pattern | = | i | Generate GritQL pattern from %s diagnostic for automated rewriting
generate-pattern | generate-pattern | low | i | Generate GritQL transformation pattern for %s
apply-transform | generate-pattern | medium | ai | Apply GritQL transformation to %s: grit apply generated-pattern.grit""",
    "rust-lsp": """
long-function | export-diagnostics | = | k | Export long function %s as LSP diagnostic for rust-analyzer
high-complexity | export-diagnostics | = | ky | Export high complexity in %s as LSP diagnostic
deep-nesting | export-diagnostics | = | k | Export deep nesting in %s as LSP diagnostic
large-file | export-diagnostics | = | k | Export large file %s as LSP diagnostic
export-diagnostics | export-diagnostics | low | k | Export {tool} diagnostics for %s in LSP format""",
}


def entries(tool: str = "srcplan") -> list[tuple[str, str, str, list[str], str]]:
    """(code, recipe, risk or '=', checks, action)."""
    out = []
    for prefix, lines in _TABLE.items():
        for line in lines.strip().split("\n"):
            code, recipe, risk, checks, action = line.split(" | ")
            out.append((f"{prefix}.{code}", f"{prefix}.{recipe}", risk, [CHECKS[c] for c in checks], action.replace("{tool}", tool)))
    return out


def registry(spark: SparkSession, more: list[tuple[str, str, str, list[str], str]] = (), tool: str = "srcplan") -> DataFrame:
    """The registry with entries of the caller's own; the first entry of a code wins."""
    first = {e[0]: e for e in reversed([*entries(tool), *more])}
    return spark.createDataFrame(list(first.values()), "code string, recipe string, recipe_risk string, verify array<string>, template string")
