"""Highlights, actions and result-log rules as tables of conditions over a change set's findings.

Conditions and texts are SQL expressions that Spark and other engines read alike. All are
evaluated on one aggregate row per change set (counts and short lists), so a change set
is never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Which findings of a change set are counted, by name.
COUNTS = {
    "n": "true", "impact": "type = 'impact-analysis'", "impact_high": "type = 'impact-analysis' and risk = 'high'", "impact_medium": "type = 'impact-analysis' and risk = 'medium'",
    "ts": "type = 'typescript-config'", "ts_b": "type = 'typescript-config' and risk = 'breaking'", "tailwind": "type = 'tailwind-config'", "tailwind_b": "type = 'tailwind-config' and risk = 'breaking'",
    "graphql": "type = 'graphql-change'", "graphql_b": "type = 'graphql-change' and risk = 'breaking'", "exports": "type = 'package-exports'", "exports_b": "type = 'package-exports' and risk = 'breaking'",
    "flag_high": "type = 'risk-flag' and risk = 'high'", "sql_d": "type = 'sql-risk' and risk = 'destructive'", "mig": "type = 'db-migration'", "mig_high": "type = 'db-migration' and risk = 'high'",
    "ci": "type = 'ci-workflow'", "ci_sec": "type = 'ci-workflow' and risk in ('permissions_broadened', 'pull_request_target')", "sec": "type = 'security-file'",
    "lock_m": "type = 'lockfile-mismatch' and name = 'true' and detail = 'false'", "lock_l": "type = 'lockfile-mismatch' and name = 'false' and detail = 'true'",
    "infra": "type = 'infra-change'", "dep_major": "type = 'dependency-change' and change = 'major'", "dep_new": "type = 'dependency-change' and change = 'new'",
    "next": "type = 'next-config-change'", "next_x": "type = 'next-config-change' and concat(',', detail, ',') like '%,experimental,%'",
    "next_r": "type = 'next-config-change' and (concat(',', detail, ',') like '%,rewrites,%' or concat(',', detail, ',') like '%,redirects,%')",
    "route": "type = 'route-change'", "route_p": "type = 'route-change' and detail = 'page'", "route_e": "type = 'route-change' and detail = 'endpoint'", "route_l": "type = 'route-change' and detail = 'layout'",
    "api": "type = 'api-contract-change'", "cloud": "type = 'cloudflare-change'", "angular": "type = 'angular-component-change'", "angular_io": "type = 'angular-component-change' and detail in ('input', 'output')",
    "stencil": "type like 'stencil-%'", "mono": "type = 'monorepo-config'", "prisma": "type = 'prisma-schema'", "prisma_b": "type = 'prisma-schema' and risk = 'breaking'", "docker": "type = 'docker-change'", "docker_b": "type = 'docker-change' and risk = 'breaking'",
    "turbo": "type = 'turborepo-config'", "turbo_b": "type = 'turborepo-config' and risk = 'breaking'", "lint": "type = 'linter-config'", "lint_b": "type = 'linter-config' and risk = 'breaking'", "jest": "type = 'jest-config'", "jest_b": "type = 'jest-config' and risk = 'breaking'",
    "play": "type = 'playwright-config'", "play_b": "type = 'playwright-config' and risk = 'breaking'", "env": "type = 'env-var'", "test": "type = 'test-change'", "rule": "type = 'convention-violation'",
}
# Short lists of a change set: column, condition, separator.
LISTS = {
    "infra_kinds": ("name", "type = 'infra-change'", ", "), "cloud_areas": ("name", "type = 'cloudflare-change'", "/"), "angular_kinds": ("detail", "type = 'angular-component-change'", "/"), "mono_tools": ("name", "type = 'monorepo-config'", ", "),
    "docker_kinds": ("name", "type = 'docker-change'", "/"), "lint_tools": ("name", "type = 'linter-config'", "/"), "env_names": ("name", "type = 'env-var'", ", "), "mig_reasons": ("detail", "type = 'db-migration' and detail <> ''", "; "),
    "cloud_files": ("detail", "type = 'cloudflare-change'", ", "), "major_names": ("name", "type = 'dependency-change' and change = 'major'", ", "),
}


def _entries(part: int) -> str:
    """How many entries one of the three lists of a test finding has."""
    x = f"split_part(name, ';', {part})"
    return f"case when {x} = '' then 0 else length({x}) - length(replace({x}, ',', '')) + 1 end"


# Sums of a change set: expression and condition.
SUMS = {
    "rule_files": ("n_files", "type = 'convention-violation'"), "dependents": ("n_files", "type = 'impact-analysis'"), "test_files": ("n_files", "type = 'test-change'"), "mig_files": ("n_files", "type = 'db-migration'"),
    "test_a": (_entries(1), "type = 'test-change'"), "test_m": (_entries(2), "type = 'test-change'"), "test_d": (_entries(3), "type = 'test-change'"),
}


def _s(n: str) -> str:
    return f"cast({n} as string)"


def _either(breaking: str, plain: str, n: str) -> str:
    return f"case when {n} > 0 then '{breaking}' else '{plain}' end"


def _part(n: str, word: str) -> str:
    return f"case when {n} > 0 then concat({_s(n)}, ' {word}') end"


# Sentences of the highlights in their order: condition, text, priority.
HIGHLIGHTS = [
    ("impact_high > 0", f"concat({_s('impact_high')}, ' file(s) with high blast radius')", "100"),
    ("impact_medium > 0", f"concat({_s('impact_medium')}, ' file(s) with medium blast radius')", "95"),
    ("ts > 0", _either("TypeScript config changed (breaking)", "TypeScript config modified", "ts_b"), "case when ts_b > 0 then 90 else 60 end"),
    ("tailwind > 0", _either("Tailwind config changed (breaking)", "Tailwind config modified", "tailwind_b"), "case when tailwind_b > 0 then 90 else 60 end"),
    ("graphql > 0", _either("GraphQL schema changed (breaking)", "GraphQL schema modified", "graphql_b"), "case when graphql_b > 0 then 90 else 60 end"),
    ("exports_b > 0", "'Package exports changed (breaking)'", "90"),
    ("flag_high > 0", f"concat({_s('flag_high')}, ' high-risk condition(s) detected')", "85"),
    ("sql_d > 0", f"concat('Destructive SQL detected in ', {_s('sql_d')}, ' file(s)')", "85"),
    ("mig > 0", _either("Database migrations (HIGH RISK)", "Database migrations", "mig_high"), "case when mig_high > 0 then 85 else 55 end"),
    ("ci > 0", f"case when ci_sec > 0 then 'CI workflow security changes detected' else concat({_s('ci')}, ' CI workflow(s) modified') end", "case when ci_sec > 0 then 85 else 55 end"),
    ("sec > 0", "'Security-sensitive files changed'", "85"),
    ("lock_m > 0", "'Lockfile mismatch: package.json changed but lockfile not updated'", "80"),
    ("lock_l > 0", "'Lockfile mismatch: lockfile changed but package.json not updated'", "80"),
    ("infra > 0", "concat('Infrastructure changes: ', infra_kinds)", "70"),
    ("dep_major > 0", f"concat({_s('dep_major')}, ' major dependency update(s)')", "70"),
    ("next > 0", "case when next_x > 0 then 'Next.js config changed (experimental features)' when next_r > 0 then 'Next.js config changed (routing rules)' else 'Next.js config modified' end", "case when next_x > 0 then 90 when next_r > 0 then 70 else 60 end"),
    ("route > 0", f"concat({_s('route')}, ' route(s) changed: ', concat_ws(', ', {_part('route_p', 'page(s)')}, {_part('route_e', 'endpoint(s)')}, {_part('route_l', 'layout(s)')}, {_part('(route - route_p - route_e - route_l)', 'other')}))", "70"),
    ("api > 0", f"concat({_s('api')}, ' API contract(s) modified')", "70"),
    ("cloud > 0", "concat('Cloudflare ', cloud_areas, ' configuration changed')", "70"),
    ("angular > 0", f"concat({_s('angular')}, ' Angular ', angular_kinds, ' change(s)', case when angular_io > 0 then ' with @Input/@Output modifications' else '' end)", "60"),
    ("stencil > 0", f"concat({_s('stencil_tags')}, ' Stencil component(s) with API changes')", "60"),
    ("mono > 0", "concat('Monorepo config changed: ', mono_tools)", "60"),
    ("prisma > 0", _either("Prisma schema changed (breaking)", "Prisma schema modified", "prisma_b"), "case when prisma_b > 0 then 90 else 55 end"),
    ("docker > 0", "concat('Docker ', docker_kinds, case when docker_b > 0 then ' changed (breaking)' else ' modified' end)", "case when docker_b > 0 then 90 else 60 end"),
    ("turbo > 0", _either("Turborepo config changed (breaking)", "Turborepo config modified", "turbo_b"), "case when turbo_b > 0 then 90 else 60 end"),
    ("lint > 0", "concat(lint_tools, case when lint_b > 0 then ' config changed (breaking)' else ' config modified' end)", "case when lint_b > 0 then 90 else 60 end"),
    ("jest > 0", _either("Jest config changed (breaking)", "Jest config modified", "jest_b"), "case when jest_b > 0 then 90 else 50 end"),
    ("play > 0", _either("Playwright config changed (breaking)", "Playwright config modified", "play_b"), "case when play_b > 0 then 90 else 50 end"),
    ("env > 0", f"concat({_s('env')}, ' new environment variable(s)')", "60"),
    ("dep_new > 0", f"concat({_s('dep_new')}, ' new dependency(ies) added')", "60"),
    ("test > 0", f"case when test_a + test_m + test_d > 0 then concat('Test files: ', concat_ws(', ', {_part('test_a', 'added')}, {_part('test_m', 'modified')}, {_part('test_d', 'deleted')})) else concat({_s('test_files')}, ' test file(s) changed') end", "50"),
    ("rule > 0", f"concat({_s('rule_files')}, ' source file(s) missing corresponding tests')", "50"),
]
_NOTHING = "not (" + " or ".join(c for c, *_ in HIGHLIGHTS) + ")"
HIGHLIGHTS.append((_NOTHING, f"case when impact > 0 then concat({_s('impact')}, ' file(s) analyzed, ', {_s('dependents')}, ' dependent file(s)') else concat({_s('n')}, ' finding(s) detected') end", "10"))

# Recommended actions: id, category, condition, blocking, reason, triggers.
ACTIONS = [
    ("sveltekit-check", "types", "profile = 'sveltekit'", "true", "'Run SvelteKit type checker to verify no type errors were introduced'", "case when route > 0 then 'Route files changed' else 'Source files changed' end"),
    ("run-tests", "tests", "n > 0", "true", "'Run test suite to verify functionality and catch regressions'", f"case when test > 0 then concat({_s('test_files')}, ' test file(s) changed') else 'Source files changed without corresponding test changes' end"),
    ("apply-migrations", "database", "mig > 0", "mig_high > 0",
     "case when mig_high > 0 then 'Apply database migrations in a safe environment and verify data integrity before production' else 'Apply and test database migrations in development environment' end",
     f"concat_ws('; ', concat({_s('mig_files')}, ' migration file(s) changed'), nullif(mig_reasons, ''), case when mig_high > 0 then 'DANGEROUS SQL DETECTED (DROP, TRUNCATE, or destructive operations)' end)"),
    ("backup-db", "database", "mig_high > 0", "true", "'Create database backup before applying destructive migrations'", "'High-risk SQL operations detected in migrations'"),
    ("verify-cloudflare-config", "cloudflare", "cloud > 0", "false", "'Verify Cloudflare configuration and bindings match across environments'", "concat('Cloudflare ', replace(cloud_areas, '/', ', '), ' configuration changed; Files: ', replace(cloud_files, ',', ', '))"),
    ("update-env-docs", "environment", "env > 0", "false", "'Update environment documentation and configure new variables'", "concat('New environment variable(s): ', env_names)"),
    ("review-dependencies", "dependencies", "dep_major > 0", "false", "'Review major dependency updates for breaking changes'", "concat('Major update(s): ', major_names)"),
]

#: Dependencies whose major updates are results of the log. Fixed values.
CRITICAL_DEPENDENCIES = ["@sveltejs/kit", "svelte", "vite", "react", "react-dom", "next", "@stencil/core"]
# Rules of the result log: id, name, short text, level, category, which findings.
LOG_RULES = [
    ("CS001", "DangerousSqlInMigration", "Dangerous SQL detected in migration", "error", "database", "type = 'db-migration' and risk = 'high'"),
    ("CS002", "MigrationChanged", "Migration changed (non-destructive)", "warning", "database", "type = 'db-migration' and risk <> 'high'"),
    ("CS003", "MajorDependencyBump", "Major bump in critical dependencies", "warning", "dependencies", "type = 'dependency-change' and change = 'major' and name in (" + ", ".join(f"'{d}'" for d in CRITICAL_DEPENDENCIES) + ")"),
    ("CS004", "NewEnvVarReference", "New environment variable reference detected", "warning", "config_env", "type = 'env-var'"),
    ("CS005", "CloudflareConfigChanged", "Cloudflare configuration changed", "note", "infra", "type = 'cloudflare-change'"),
    ("CS006", "EndpointChanged", "API endpoint changed", "note", "api", "type = 'route-change' and detail = 'endpoint'"),
    ("CS007", "CIWorkflowPermissionsBroadened", "CI workflow permissions broadened", "error", "security", "type = 'ci-workflow' and risk = 'permissions_broadened'"),
    ("CS008", "CIWorkflowPullRequestTarget", "CI workflow uses pull_request_target", "error", "security", "type = 'ci-workflow' and risk = 'pull_request_target'"),
    ("CS009", "SecurityFileChanged", "Security-sensitive file changed", "warning", "security", "type = 'security-file'"),
    ("CS010", "GraphQLBreakingChange", "Breaking change in GraphQL schema", "error", "api", "type = 'graphql-change' and risk = 'breaking'"),
    ("CS011", "PackageExportsBreakingChange", "Breaking change in package exports", "error", "api", "type = 'package-exports' and risk = 'breaking'"),
    ("CS012", "StencilAPIBreakingChange", "Breaking change in Stencil component API", "warning", "api", "type like 'stencil-%' and change = 'removed'"),
    ("CS013", "TypeScriptConfigBreaking", "Breaking TypeScript configuration change", "warning", "config_env", "type = 'typescript-config' and risk = 'breaking'"),
    ("CS014", "DestructiveSQL", "Destructive SQL operation detected", "error", "database", "type = 'sql-risk' and risk = 'destructive'"),
    ("CS015", "InfrastructureChanged", "Infrastructure configuration changed", "warning", "infra", "type = 'infra-change'"),
    ("CS017", "LargeDiff", "Large diff detected", "note", "quality", "type = 'large-diff'"),
]


def told(found: DataFrame) -> DataFrame:
    """One row per change set with everything that conditions and texts are made of."""
    spark_list = lambda c, where, sep: f"array_join(array_sort(collect_set(case when {where} then {c} end)), '{sep}')"
    return found.groupBy("changeset_id").agg(
        *[F.expr(f"count(*) filter (where {where})").alias(k) for k, where in COUNTS.items()],
        *[F.expr(spark_list(*v)).alias(k) for k, v in LISTS.items()],
        *[F.expr(f"coalesce(sum({e}) filter (where {where}), 0)").alias(k) for k, (e, where) in SUMS.items()],
        F.expr("count(distinct split_part(name, '.', 1)) filter (where type like 'stencil-%')").alias("stencil_tags"),
    )


def highlights(found: DataFrame) -> DataFrame:
    """changeset_id, place, highlight, priority: one sentence per kind of finding, by priority."""
    rows = ", ".join(f"case when {c} then named_struct('highlight', {text}, 'priority', {p}, 'ord', {i}) end" for i, (c, text, p) in enumerate(HIGHLIGHTS))
    each = told(found).selectExpr("changeset_id", f"inline(array_compact(array({rows})))")
    return each.withColumn("place", F.row_number().over(Window.partitionBy("changeset_id").orderBy(F.desc("priority"), "ord"))).drop("ord")


def actions(found: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """changeset_id, action, category, blocking, reason, triggers, place: blocking first, then by id.

    profiles: changeset_id, profile; without it no action of one framework is made.
    """
    rows = told(found)
    rows = rows.join(profiles.select("changeset_id", "profile"), "changeset_id", "left") if profiles is not None else rows.withColumn("profile", F.lit(None).cast("string"))
    made = ", ".join(f"case when {c} then named_struct('action', '{i}', 'category', '{cat}', 'blocking', {b}, 'reason', {reason}, 'triggers', {t}) end" for i, cat, c, b, reason, t in ACTIONS)
    each = rows.selectExpr("changeset_id", f"inline(array_compact(array({made})))")
    return each.withColumn("place", F.row_number().over(Window.partitionBy("changeset_id").orderBy(F.desc("blocking"), "action")))


def log_results(found: DataFrame) -> DataFrame:
    """changeset_id, rule_id, level, uri, finding_id: findings as results of a result log, distinct."""
    rules = ", ".join(f"case when {where} then named_struct('rule_id', '{i}', 'level', '{level}') end" for i, _, _, level, _, where in LOG_RULES)
    return found.selectExpr("changeset_id", "finding_id", "coalesce(file, split_part(coalesce(detail, ''), ',', 1)) as uri", f"inline(array_compact(array({rules})))").select("changeset_id", "rule_id", "level", "uri", "finding_id").distinct()


def result_logs(results: DataFrame) -> DataFrame:
    """changeset_id, json: one result log per change set, with the rules it uses in order and its results.

    A log is one document and so one row; results.result_lines gives very large ones line by line.
    """
    location = F.expr("array(named_struct('physicalLocation', named_struct('artifactLocation', named_struct('uri', uri, 'uriBaseId', 'SRCROOT'))))")
    result = F.struct(F.col("rule_id").alias("ruleId"), "level", location.alias("locations"), F.struct(F.col("finding_id").alias("findingId")).alias("partialFingerprints"))
    grouped = results.groupBy("changeset_id").agg(F.array_sort(F.collect_list(result)).alias("results"), F.array_sort(F.collect_set("rule_id")).alias("used"))
    table = "array(" + ", ".join(f"named_struct('id', '{i}', 'name', '{name}', 'shortDescription', named_struct('text', '{text}'), 'defaultConfiguration', named_struct('level', '{level}'), 'properties', named_struct('category', '{cat}'))" for i, name, text, level, cat, _ in LOG_RULES) + ")"
    body = f"""named_struct('version', '2.1.0', 'runs', array(named_struct('tool', named_struct('driver', named_struct('name', 'diffloom', 'rules', filter({table}, r -> array_contains(used, r.id)))), 'results', results)))"""
    return grouped.select("changeset_id", F.to_json(F.expr(body)).alias("json"))
