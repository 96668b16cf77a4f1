"""Findings of all analyzers as one relation, the two scores, and the reports built on them.

A finding row: changeset_id, type, category, file, name, detail, change, risk, n_files,
fingerprint, finding_id. Everything below is grouped by change set with partial
aggregation; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diffloom.operators import analyzers as A
from diffloom.operators import paths as P
from diffloom.operators.config_rules import config_findings
from diffloom.operators.labels import Changes
from diffloom.operators.identity import finding_id, flag_id
from diffloom.operators.paths import SECURITY_LABELS

FINDING_COLUMNS = ["changeset_id", "type", "category", "file", "name", "detail", "change", "risk", "n_files", "fingerprint"]
# Expressions that Spark and other SQL engines read alike.
_PATH = "replace(path, chr(92), '/')"
_N_FILES = "length(files) - length(replace(files, ',', '')) + 1"
_BREAKING = "cast(is_breaking as string)"
_COMMAS = "replace(sections, '; ', ',')"
_LABELS = "reasons"
for _reason, _text in SECURITY_LABELS.items():
    _LABELS = f"replace({_LABELS}, '{_reason}', '{_text}')"
_SECURITY_TEXT = f"concat('Security-sensitive files changed (', replace({_LABELS}, ',', ', '), '): ', cast(n_files as string), ' file(s)')"
_BUMP = "concat('Major version bump: ', name, ' ', from_version, ' → ', to_version)"
_NEW_RISKY = "concat('New ', case risk_category when 'auth' then 'Authentication/Security' when 'database' then 'Database/ORM' when 'native' then 'Native Module' else 'Payment Processing' end, ' package: ', name)"
_DEPENDENCY = "concat_ws(':', 'dependency-change', name, coalesce(nullif(from_version, ''), 'null'), coalesce(nullif(to_version, ''), 'null'), section)"
_DEP_COLUMNS = {"file": "path", "name": "name", "detail": "risk_category", "change": "impact", "risk": "section"}
_STEM = "regexp_replace(regexp_extract(path, '([^/]*)$', 1), '[.][^.]+$', '')"
_LOCALE = "regexp_extract(path, '(?i)(?:^|/)(?:locales?|i18n|lang|translations?|messages)/([^/.]+)', 1)"
_STYLE = "case when path like '%.module.%' then 'css-module' when regexp_extract(path, '(?i)(theme|tokens|variables)[^/]*$', 1) <> '' then 'theme' else 'global' end"
_SURFACE_TYPE = "case surface when 'trpc' then 'trpc-router' when 'runes' then 'svelte5-runes' when 'websocket' then 'websocket-change' when 'i18n' then 'i18n-change' when 'css' then 'css-change' when 'query' then 'tanstack-query' else 'next-config-change' end"
_BREAKS = "cast(breaks as string)"
_SURFACE_PRINT = f"""case surface when 'trpc' then concat_ws(':', 'trpc-router', path, {_STEM}, {_BREAKS}, told) when 'websocket' then concat_ws(':', 'websocket-change', path, 'unknown', {_BREAKS}, told)
    when 'i18n' then concat_ws(':', 'i18n-change', path, {_LOCALE}, {_BREAKS}, told) when 'css' then concat_ws(':', 'css-change', path, {_STYLE}, {_BREAKS}, told)
    when 'next-config' then concat_ws(':', 'next-config-change', path, status, names) else concat_ws(':', {_SURFACE_TYPE}, path, told) end"""
_SCHEMA_TYPE = "case kind when 'graphql' then 'graphql-change' when 'prisma' then 'prisma-schema' when 'drizzle' then 'drizzle-schema' else 'typescript-config' end"
_SCHEMA_PRINT = f"""case kind when 'graphql' then concat_ws(':', 'graphql-change', path, {_BREAKING}, removed, added) when 'tsconfig' then concat_ws(':', 'typescript-config', path, {_BREAKING}, concat('a=', added), concat('r=', removed), concat('m=', modified))
    else concat_ws(':', {_SCHEMA_TYPE}, path, {_BREAKING}, added, removed) end"""
_SCHEMA_TOLD = "concat_ws('; ', case when added <> '' then concat('added ', added) end, case when removed <> '' then concat('removed ', removed) end, case when modified <> '' then concat('modified ', modified) end, nullif(reasons, ''))"
_CONFIG_PRINT = f"""case type when 'tailwind-config' then concat_ws(':', type, file, tool, {_BREAKING}, {_COMMAS}) when 'monorepo-config' then concat_ws(':', type, file, tool, {_COMMAS}) when 'vite-config' then concat_ws(':', type, file, {_BREAKING}, {_COMMAS}, replace(plugins, '; ', ','))
    when 'linter-config' then concat_ws(':', type, file, tool, {_BREAKING}, {_COMMAS}) when 'docker-change' then concat_ws(':', type, file, tool, {_BREAKING}, images) else concat_ws(':', type, file, {_BREAKING}, {_COMMAS}) end"""
_RSC_BREAKING = "case when reasons <> '' then 'true' else 'false' end"
_TOLD_BREAKING = "case when is_breaking then 'breaking' end"
#: Parts of the findings relation: query of diffloom.queries, type, category, fingerprint, further columns, and which rows.
PARTS: list[tuple[str, str, str, str, dict[str, str], str]] = [
    ("sql_risks", "'sql-risk'", "'database'", f"concat_ws(':', 'sql-risk', {_PATH}, risk)", {"file": "path", "risk": "risk"}, "true"),
    ("ci_workflows", "'ci-workflow'", "'ci'", f"concat_ws(':', 'ci-workflow', {_PATH}, risk)", {"file": "path", "risk": "risk"}, "true"),
    ("infra", "'infra-change'", "'infra'", "concat_ws(':', 'infra-change', infra_type, files)", {"name": "infra_type", "detail": "files", "n_files": _N_FILES}, "true"),
    ("api_contracts", "'api-contract-change'", "'api'", "concat_ws(':', 'api-contract-change', files)", {"detail": "files", "n_files": _N_FILES}, "true"),
    ("large_diff", "'large-diff'", "'unknown'", "concat_ws(':', 'large-diff', cast(files_changed as string), cast(lines_changed as string))", {"detail": "lines_changed", "n_files": "files_changed"}, "true"),
    ("lockfile_mismatch", "'lockfile-mismatch'", "'dependencies'", "concat_ws(':', 'lockfile-mismatch', cast(manifest_changed as string), cast(lockfile_changed as string))", {"name": "manifest_changed", "detail": "lockfile_changed"}, "true"),
    ("env_vars", "'env-var'", "'config_env'", "concat_ws(':', 'env-var', name, files)", {"name": "name", "detail": "files", "change": "'added'", "n_files": _N_FILES}, "true"),
    ("security_files", "'security-file'", "'infra'", "concat_ws(':', 'security-file', files, reasons)", {"detail": "files", "name": "reasons", "n_files": "n_files"}, "true"),
    ("security_files", "'risk-flag'", "'infra'", f"concat_ws(':', 'risk-flag', 'medium', {_SECURITY_TEXT})", {"name": _SECURITY_TEXT, "detail": "files", "risk": "'medium'", "n_files": "n_files"}, "true"),
    ("cloudflare", "'cloudflare-change'", "'cloudflare'", "concat_ws(':', 'cloudflare-change', area, files)", {"name": "area", "detail": "files", "n_files": _N_FILES}, "true"),
    ("test_changes", "'test-change'", "'tests'", "concat_ws(':', 'test-change', 'vitest', files)", {"name": "concat_ws(';', added, modified, deleted)", "detail": "files", "n_files": _N_FILES}, "true"),
    ("supabase_migrations", "'db-migration'", "'database'", "concat_ws(':', 'db-migration', tool, files)", {"name": "tool", "detail": "reasons", "risk": "risk", "n_files": "n_files"}, "true"),
    ("supabase_migrations", "'risk-flag'", "'database'", "concat('risk-flag:high:Destructive SQL detected: ', replace(reasons, ',', ', '))", {"name": "concat('Destructive SQL detected: ', replace(reasons, ',', ', '))", "detail": "files", "risk": "'high'", "n_files": "n_files"}, "risk = 'high'"),
    ("python_migrations", "'python-migration'", "'database'", "concat_ws(':', 'python-migration', tool, risk, files)", {"name": "tool", "detail": "reasons", "risk": "risk", "n_files": "n_files"}, "true"),
    ("python_migrations", "'risk-flag'", "'database'", "concat('risk-flag:high:Destructive migration detected: ', replace(reasons, ',', ', '))", {"name": "concat('Destructive migration detected: ', replace(reasons, ',', ', '))", "detail": "files", "risk": "'high'", "n_files": "n_files"}, "risk = 'high'"),
    ("node_dependencies", "'dependency-change'", "'dependencies'", _DEPENDENCY, _DEP_COLUMNS, "true"),
    ("python_dependencies", "'dependency-change'", "'dependencies'", _DEPENDENCY, _DEP_COLUMNS, "true"),
    ("node_dependencies", "'risk-flag'", "'dependencies'", f"concat('risk-flag:high:', {_BUMP})", {"name": _BUMP, "detail": "path", "risk": "'high'"}, "name in ('@sveltejs/kit', 'svelte', 'vite') and impact = 'major'"),
    ("node_dependencies", "'risk-flag'", "'dependencies'", f"concat('risk-flag:medium:', {_NEW_RISKY})", {"name": _NEW_RISKY, "detail": "path", "risk": "'medium'"}, "risk_category is not null and impact = 'new'"),
    ("file_routes", "'route-change'", "'routes'", "concat_ws(':', 'route-change', route_id, change, route_type)", {"file": "path", "name": "route_id", "detail": "route_type", "change": "change"}, "true"),
    ("python_routes", "'route-change'", "'routes'", "concat_ws(':', 'route-change', route_id, change, 'endpoint')", {"file": "path", "name": "route_id", "detail": "'endpoint'", "change": "change"}, "true"),
    ("impact_radius", "'impact-analysis'", "'impact'", f"concat_ws(':', 'impact-analysis', {_PATH}, users)", {"file": "path", "detail": "users", "risk": "blast_radius", "n_files": "dependents"}, "true"),
    ("config_files", "type", "category", _CONFIG_PRINT, {"file": "file", "name": "tool", "detail": "reasons", "change": "status", "risk": _TOLD_BREAKING}, "true"),
    ("python_configs", "'python-config'", "'config_env'", f"concat_ws(':', 'python-config', path, config_type, {_BREAKING}, sections)", {"file": "path", "name": "config_type", "detail": "reasons", "change": "status", "risk": _TOLD_BREAKING}, "true"),
    ("rsc_boundary", "'rsc-boundary'", "'routes'", f"concat_ws(':', 'rsc-boundary', path, boundary, coalesce(nullif(from_directive, ''), 'none'), coalesce(nullif(to_directive, ''), 'none'), {_RSC_BREAKING})", {"file": "path", "name": "boundary", "detail": "reasons", "risk": "case when reasons <> '' then 'breaking' end"}, "from_directive <> to_directive or reasons <> ''"),
    ("schema_changes", _SCHEMA_TYPE, "case kind when 'graphql' then 'api' when 'tsconfig' then 'config_env' else 'database' end", _SCHEMA_PRINT, {"file": "path", "name": "kind", "detail": _SCHEMA_TOLD, "risk": _TOLD_BREAKING}, "true"),
    ("surface_findings", _SURFACE_TYPE, "case when surface in ('css', 'next-config') then 'config_env' else 'api' end", _SURFACE_PRINT, {"file": "path", "name": "surface", "detail": "case surface when 'next-config' then names else told end", "change": "status", "risk": "case when breaks then 'breaking' end"}, "surface <> 'docker'"),
]


def part_columns(part: tuple[str, str, str, str, dict[str, str], str]) -> list[str]:
    """The select list of one part."""
    _, type_, category, fingerprint, more, _ = part
    text = [f"cast({more.get(c, 'null')} as string) as {c}" for c in ("file", "name", "detail", "change", "risk")]
    return ["changeset_id", f"{type_} as type", f"{category} as category", *text, f"cast({more.get('n_files', '1')} as bigint) as n_files", f"{fingerprint} as fingerprint"]


def config_files(changes: Changes) -> DataFrame:
    """config_findings with images: the base images that changed, of container files."""
    images = A.surface_changes(changes).where("surface = 'docker'").groupBy("changeset_id", F.col("path").alias("file")).agg(A.listed("name").alias("images"))
    return config_findings(changes).join(images, ["changeset_id", "file"], "left").withColumn("images", F.coalesce("images", F.lit("")))


def surface_findings(changes: Changes) -> DataFrame:
    """surface_files with the status of the file."""
    listed = changes.files.select("changeset_id", "path", "status")
    return A.surface_files(changes).join(listed, ["changeset_id", "path"], "left").withColumn("status", F.coalesce("status", F.lit("modified")))


def source_findings(sources: DataFrame) -> DataFrame:
    """Findings of source_changes: routes, decorated classes and their members, exports and translation keys."""
    told = "case change when 'removed' then 'deleted' when 'changed' then 'modified' else change end"
    angular = "relation = 'member' and (path rlike '[.](component|directive|service|module|pipe)[.]ts$' or kind in ('directive', 'injectable', 'ngmodule', 'pipe', 'input', 'output'))"
    part = "kind in ('prop', 'event', 'method', 'slot', 'state')"
    stencil = f"concat('stencil-', case when {part} then kind else 'component' end, '-change')"
    owner, own = "substring_index(name, '.', 1)", "substring(name, instr(name, '.') + 1)"
    pick = lambda route, ng, st: f"case when relation = 'route' then {route} when {angular} then {ng} else {st} end"
    single = ("", pick("'route-change'", "'angular-component-change'", stencil), pick("'routes'", "'api'", "'api'"), pick(f"concat('route-change:', name, ':', {told}, ':page')", f"concat_ws(':', 'angular-component-change', path, {told}, kind, name)", f"concat_ws(':', {stencil}, {owner}, case when {part} then {own} end, change, path)"),
              {"file": "path", "name": "name", "detail": pick("'page'", "kind", "kind"), "change": pick(told, told, "change")}, "true")
    one = sources.where("relation in ('route', 'member')").selectExpr(*part_columns(single))
    removed = F.col("change") == "removed"
    line = F.concat_ws(":", "name", "change", removed.cast("string"))
    per_file = sources.where("relation in ('key', 'export')").groupBy("changeset_id", "path", "relation").agg(A.listed(line).alias("told"), A.listed("name", F.col("change") == "added").alias("added"), A.listed("name", removed).alias("removed"), F.bool_or(removed).alias("breaks"))
    key = lambda x, y: f"case when relation = 'key' then {x} else {y} end"
    many = ("", key("'i18n-change'", "'package-exports'"), "'api'", key(f"concat_ws(':', 'i18n-change', path, {_LOCALE}, {_BREAKS}, told)", f"concat_ws(':', 'package-exports', {_BREAKS}, concat('a=', added), concat('r=', removed))"),
            {"file": "path", "name": key("'i18n'", "null"), "detail": "told", "risk": "case when breaks then 'breaking' end"}, "true")
    return one.union(per_file.selectExpr(*part_columns(many)))


def findings(files: DataFrame, changes: Changes, sources: DataFrame | None = None) -> DataFrame:
    """Findings of all analyzers with their ids; sources: what source_changes read, if source texts are at hand."""
    over = {
        "sql_risks": A.sql_risks(changes), "ci_workflows": A.ci_workflows(changes), "infra": A.infra_changes(files), "api_contracts": A.api_contracts(files), "large_diff": A.large_diffs(files, changes), "lockfile_mismatch": A.lockfile_mismatches(files, changes),
        "env_vars": A.env_vars(changes), "security_files": A.security_files(files), "cloudflare": A.cloudflare_changes(files, changes), "test_changes": A.test_changes(files), "supabase_migrations": A.supabase_migrations(files, changes),
        "python_migrations": A.python_migrations(files, changes), "node_dependencies": A.node_dependencies(changes), "python_dependencies": A.python_dependencies(changes), "file_routes": A.file_routes(files, changes), "python_routes": A.python_routes(changes),
        "impact_radius": A.impact_radius(files, changes), "config_files": config_files(changes), "python_configs": A.python_configs(files, changes), "rsc_boundary": A.rsc_boundaries(changes), "schema_changes": A.schema_changes(changes), "surface_findings": surface_findings(changes),
    }
    parts = [over[p[0]].where(p[5]).selectExpr(*part_columns(p)) for p in PARTS]
    if sources is not None:
        parts.append(source_findings(sources))
    while len(parts) > 1:
        parts = [a.union(b) for a, b in zip(parts[::2], parts[1::2])] + parts[len(parts) // 2 * 2 :]
    return parts[0].withColumn("finding_id", finding_id(F.col("type"), F.col("fingerprint")))


_DETAILS = "concat(',', detail, ',')"
# Weight of a finding in the additive score; place is the category of its file.
WEIGHT = f"""case type when 'risk-flag' then case risk when 'high' then 40 when 'medium' then 20 else 5 end
    when 'db-migration' then case risk when 'high' then 30 when 'medium' then 15 else 0 end
    when 'route-change' then case change when 'added' then 5 when 'deleted' then 10 else 0 end
    when 'dependency-change' then case change when 'major' then 15 when 'minor' then 5 else 0 end + case when detail is not null and change = 'new' then 10 else 0 end
    when 'env-var' then 5 when 'security-file' then 15
    when 'convention-violation' then case when n_files > 5 then 10 else 0 end
    when 'large-diff' then case when cast(detail as bigint) > 1000 then 15 when cast(detail as bigint) > 500 then 10 else 5 end
    when 'next-config-change' then case when {_DETAILS} like '%,experimental,%' then 15 when {_DETAILS} like '%,output,%' then 10 else 5 end
    when 'impact-analysis' then case when place in ('docs', 'tests', 'config') then 0 when risk = 'high' then 20 when risk = 'medium' then 10 else 0 end
    else 0 end"""
KIND = """case type when 'risk-flag' then concat('risk-', risk) when 'route-change' then concat('route-', change) when 'dependency-change' then concat('dependency-', change)
    when 'env-var' then 'env-var-added' when 'convention-violation' then 'test-coverage-gap' when 'impact-analysis' then concat(risk, '-blast-radius') else type end"""


def risk_factors(found: DataFrame, files: DataFrame) -> DataFrame:
    """changeset_id, kind, weight, category, finding_id of the additive score's factors."""
    c = F.col
    placed = found.withColumn("place", P.category(F.coalesce("file", F.lit(""))))
    scored = placed.selectExpr("changeset_id", f"{KIND} as kind", f"{WEIGHT} as weight", "category", "finding_id").where("weight <> 0")
    group = P.category(c("path"))
    kinds = files.groupBy("changeset_id").agg(*[F.bool_or(group == k).alias(k) for k in ("docs", "tests", "config", "product", "infra", "ci", "dependencies")], F.bool_or((c("status") == "modified") & c("path").rlike(r"/types\.ts$|/core/.*\.ts$|/index\.ts$")).alias("core"))
    only = F.when(c("product") | c("infra") | c("ci") | c("dependencies"), 0).when(c("docs") & ~c("tests") & ~c("config"), -15).when(c("tests") & ~c("docs") & ~c("config"), -10).when(c("config") & ~c("docs") & ~c("tests"), -5).when(c("docs") | c("tests") | c("config"), -10).otherwise(0)
    none = F.lit(None).cast("string").alias("finding_id")
    low = kinds.select("changeset_id", F.lit("low-risk-category").alias("kind"), only.alias("weight"), F.lit("unknown").alias("category"), none).where("weight <> 0")
    core = kinds.where("core").select("changeset_id", F.lit("core-module-change").alias("kind"), F.lit(10).alias("weight"), F.lit("unknown").alias("category"), none)
    return scored.unionByName(low).unionByName(core)


def risk_scores(factors: DataFrame, files: DataFrame) -> DataFrame:
    """changeset_id, score (0..100), level, factors of every change set."""
    total = factors.groupBy("changeset_id").agg(F.sum("weight").alias("total"), F.count("*").alias("factors"))
    score = F.least(F.lit(100), F.greatest(F.lit(0), F.coalesce("total", F.lit(0))))
    joined = files.select("changeset_id").distinct().join(total, "changeset_id", "left")
    return joined.select("changeset_id", score.cast("int").alias("score"), F.when(score >= 50, "high").when(score >= 20, "medium").otherwise("low").alias("level"), F.coalesce("factors", F.lit(0)).cast("int").alias("factors"))


# Rule key, category, score, confidence, grain (row: one flag per finding, all: one per change set) and filter.
FLAG_RULES = [
    ("security.workflow_permissions_broadened", "security", 35, 0.9, "row", "type = 'ci-workflow' and risk = 'permissions_broadened'"),
    ("security.workflow_uses_pull_request_target", "security", 40, 0.9, "row", "type = 'ci-workflow' and risk = 'pull_request_target'"),
    ("security.workflow_downloads_remote_script", "security", 45, 0.85, "row", "type = 'ci-workflow' and risk = 'remote_script_download'"),
    ("ci.pipeline_changed", "ci", 10, 0.7, "row", "type = 'ci-workflow' and risk = 'pipeline_changed'"),
    ("db.destructive_sql", "db", 45, 0.9, "row", "type = 'sql-risk' and risk = 'destructive'"),
    ("db.schema_change_risky", "db", 30, 0.85, "row", "type = 'sql-risk' and risk = 'schema_change'"),
    ("db.unscoped_data_modification", "db", 35, 0.75, "row", "type = 'sql-risk' and risk = 'unscoped_modification'"),
    ("stencil.tag_changed", "api", 45, 0.95, "row", "type = 'stencil-component-change' and change = 'tag-changed'"),
    ("stencil.shadow_changed", "api", 25, 0.9, "row", "type = 'stencil-component-change' and change = 'shadow-changed'"),
    ("stencil.prop_removed", "api", 40, 0.95, "row", "type = 'stencil-prop-change' and change = 'removed'"),
    ("stencil.prop_changed", "api", 35, 0.9, "row", "type = 'stencil-prop-change' and change = 'changed'"),
    ("stencil.event_removed", "api", 40, 0.95, "row", "type = 'stencil-event-change' and change = 'removed'"),
    ("stencil.event_changed", "api", 35, 0.9, "row", "type = 'stencil-event-change' and change = 'changed'"),
    ("stencil.method_removed", "api", 40, 0.95, "row", "type = 'stencil-method-change' and change = 'removed'"),
    ("stencil.slot_removed", "api", 35, 0.9, "row", "type = 'stencil-slot-change' and change = 'removed'"),
    ("infra.dockerfile_changed", "infra", 20, 0.8, "row", "type = 'infra-change' and name = 'dockerfile'"),
    ("infra.terraform_changed", "infra", 20, 0.8, "row", "type = 'infra-change' and name = 'terraform'"),
    ("infra.k8s_changed", "infra", 20, 0.8, "row", "type = 'infra-change' and name = 'k8s'"),
    ("api.contract_changed", "api", 25, 0.85, "all", "type = 'api-contract-change'"),
    ("churn.large_diff", "churn", 15, 0.9, "all", "type = 'large-diff'"),
    ("deps.lockfile_without_manifest", "deps", 20, 0.9, "row", "type = 'lockfile-mismatch' and name = 'false' and detail = 'true'"),
    ("deps.new_prod_dependency", "deps", 15, 0.85, "all", "type = 'dependency-change' and change = 'new' and risk = 'dependencies'"),
    ("deps.major_version_bump", "deps", 25, 0.9, "all", "type = 'dependency-change' and change = 'major'"),
    ("db.migrations_changed", "db", 12, 0.8, "all", "type = 'db-migration'"),
    ("tests.changed", "tests", 5, 0.8, "all", "type = 'test-change'"),
]
FLAG_CATEGORIES = ["security", "ci", "deps", "db", "infra", "api", "tests", "churn"]


def risk_flags(found: DataFrame) -> DataFrame:
    """changeset_id, rule_key, flag_category, score, effective_score, findings, flag_id."""
    rules = F.array(*[
        F.when(F.expr(where), F.struct(F.lit(key).alias("rule_key"), F.lit(cat).alias("flag_category"), F.lit(score).alias("score"), F.lit(conf).alias("confidence"), F.lit(grain).alias("grain")))
        for key, cat, score, conf, grain, where in FLAG_RULES
    ])
    hits = found.select("changeset_id", "finding_id", "fingerprint", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("r")).select("changeset_id", "finding_id", "fingerprint", "r.*")
    one = F.when(F.col("grain") == "row", F.col("finding_id")).otherwise("")
    grouped = hits.groupBy("changeset_id", "rule_key", "flag_category", "score", "confidence", one.alias("of")).agg(F.collect_set("finding_id").alias("ids"))
    return grouped.select("changeset_id", "rule_key", "flag_category", "score", F.round(F.col("score") * F.col("confidence")).cast("int").alias("effective_score"), F.size("ids").alias("findings"), flag_id(F.col("rule_key"), F.col("ids")).alias("flag_id"))


def filter_flags(flags: DataFrame, only: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Flags of the categories named by only (all, if none are), then without those named by exclude."""
    kept = flags.where(F.col("flag_category").isin(*only)) if only else flags
    return kept.where(~F.col("flag_category").isin(*exclude)) if exclude else kept


def category_scores(flags: DataFrame) -> DataFrame:
    """changeset_id, flag_category, category_score: effective scores, at most 100, for every category."""
    each = flags.groupBy("changeset_id").agg(*[F.least(F.lit(100), F.coalesce(F.sum(F.when(F.col("flag_category") == k, F.col("effective_score"))), F.lit(0))).alias(k) for k in FLAG_CATEGORIES])
    pairs = F.array(*[F.struct(F.lit(k).alias("flag_category"), F.col(k).cast("int").alias("category_score")) for k in FLAG_CATEGORIES])
    return each.select("changeset_id", F.explode(pairs).alias("p")).select("changeset_id", "p.*")


def risk_report(flags: DataFrame) -> DataFrame:
    """changeset_id, overall, level, flags: 0.6 of the greatest category score and 0.4 of the mean of the top three."""
    top = category_scores(flags).groupBy("changeset_id").agg(F.slice(F.reverse(F.array_sort(F.collect_list("category_score"))), 1, 3).alias("top"))
    mean = F.aggregate("top", F.lit(0), lambda a, x: a + x) / F.lit(3.0)
    overall = F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(0.6) * F.get("top", F.lit(0)) + F.lit(0.4) * mean))).cast("int")
    level = F.when(overall >= 81, "critical").when(overall >= 61, "high").when(overall >= 41, "elevated").when(overall >= 21, "moderate").otherwise("low")
    n = flags.groupBy("changeset_id").agg(F.count("*").alias("flags"))
    return top.join(n, "changeset_id").select("changeset_id", overall.alias("overall"), level.alias("level"), "flags")


def category_aggregates(found: DataFrame, factors: DataFrame) -> DataFrame:
    """changeset_id, category, findings, risk_weight, place: categories by weight, count and name."""
    counted = found.groupBy("changeset_id", "category").agg(F.count("*").alias("findings"))
    weighed = factors.groupBy("changeset_id", "category").agg(F.sum("weight").alias("risk_weight"))
    joined = counted.join(weighed, ["changeset_id", "category"], "left").withColumn("risk_weight", F.coalesce("risk_weight", F.lit(0)))
    order = Window.partitionBy("changeset_id").orderBy(F.desc("risk_weight"), F.desc("findings"), "category")
    return joined.withColumn("place", F.row_number().over(order))


# Finding types by how much they tell a reader, most first.
TOP_TYPES = ["risk-flag", "db-migration", "sql-risk", "ci-workflow", "route-change", "dependency-change", "env-var", "security-file", "infra-change", "cloudflare-change", "test-change", "large-diff"]


def top_findings(found: DataFrame, k: int = 5) -> DataFrame:
    """changeset_id, place, type, findings, examples, rest: the k first types of a change set with up to five examples, and how many more there are."""
    order = F.expr("case type " + " ".join(f"when '{t}' then {i}" for i, t in enumerate(TOP_TYPES)) + " end")
    of = F.collect_set(F.coalesce("file", "name", "detail", F.lit("")))
    grouped = found.withColumn("o", order).where("o is not null").groupBy("changeset_id", "type", "o").agg(F.count("*").alias("findings"), F.array_join(F.slice(F.array_sort(of), 1, 5), ",").alias("examples"), F.greatest(F.lit(0), F.size(of) - 5).alias("rest"))
    return grouped.withColumn("place", F.row_number().over(Window.partitionBy("changeset_id").orderBy("o"))).where(F.col("place") <= k).drop("o")


def findings_by_type(found: DataFrame) -> DataFrame:
    """changeset_id, type, findings."""
    return found.groupBy("changeset_id", "type").agg(F.count("*").alias("findings"))


def dependency_overview(found: DataFrame) -> DataFrame:
    """changeset_id, section, impact, packages, names (first five by name), risky."""
    deps = found.where("type = 'dependency-change'")
    return deps.groupBy("changeset_id", F.col("risk").alias("section"), F.col("change").alias("impact")).agg(F.count_distinct("name").alias("packages"), F.array_join(F.slice(F.array_sort(F.collect_set("name")), 1, 5), ",").alias("names"), F.count("detail").alias("risky"))


#: Finding types that describe a change set and stand outside its findings.
META_TYPES = ["file-summary", "file-category", "large-diff", "lockfile-mismatch"]


def domain_findings(found: DataFrame) -> DataFrame:
    """Findings without those that only describe the change set."""
    return found.where(~F.col("type").isin(*META_TYPES))


def limit_findings(found: DataFrame, k: int) -> DataFrame:
    """The first k findings of every change set by type, file (none first) and id, as the reader asked for."""
    order = Window.partitionBy("changeset_id").orderBy("type", F.lower(F.coalesce("file", F.lit(""))), "finding_id", "fingerprint")
    return found.withColumn("_p", F.row_number().over(order)).where(F.col("_p") <= k).drop("_p")


def summary_by_area(found: DataFrame) -> DataFrame:
    """changeset_id, areas: a map from category to its number of findings."""
    counted = found.groupBy("changeset_id", "category").agg(F.count("*").alias("n"))
    return counted.groupBy("changeset_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("areas"))
