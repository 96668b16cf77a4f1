"""Rule-table analyzers of configuration files.

All configuration analyzers share one shape: a path gate, sections whose names are
looked for in the changed lines, and reasons that need one or more patterns in the added,
deleted or all changed lines. The rules are data; one scan of the hunks evaluates all of
them, each behind its gate, and only the few labels that matched are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffloom.operators.analyzers import RULES as LABEL_RULES
from diffloom.operators.labels import Changes, Rule, any_path, label, lit

Need = tuple[str, str]  # scope (add, del or all) and pattern


@dataclass(frozen=True)
class ConfigRule:
    """One kind of configuration file: finding type, category, tool, path gate, sections, reasons.

    sections: label -> pattern over all changed lines. reasons: label -> alternatives,
    each a list of needs that must all be met. quiet: no finding without a section or
    reason. graded: confidence is low where nothing matched. required: a need without
    which the file is none of this kind. plugins: name -> pattern over all changed lines.
    """

    analyzer: str
    type: str
    category: str
    tool: str
    gate: tuple[str, ...]
    sections: dict[str, str]
    reasons: dict[str, list[list[Need]]]
    quiet: bool = False
    graded: bool = False
    required: Need | None = None
    plugins: dict[str, str] | None = None


def _quoted(names: Iterable[str], after: str = r"[:{\[]") -> dict[str, str]:
    return {n: rf"(?i)[\"']?{n}[\"']?\s*{after}" for n in names}


def _bare(names: Iterable[str], prefix: str = "") -> dict[str, str]:
    return {prefix + n: rf"(?i)\b{n}\s*[:{{]" for n in names}


def _one(scope: str, rules: dict[str, str]) -> dict[str, list[list[Need]]]:
    return {label: [[(scope, p)]] for label, p in rules.items()}


_SOME = r"(?s)."

# The rules of each kind of configuration file.
RULES = [
    ConfigRule(
        "jest", "jest-config", "tests", "jest",
        (r"^jest\.config(\.[a-z0-9]+)?\.(ts|js|mjs|cjs|json)$", r"^jest\.setup(\.[a-z0-9]+)?\.(ts|js|mjs|cjs)$"),
        _quoted(["transform", "moduleNameMapper", "testEnvironment", "setupFiles", "setupFilesAfterFramework", "globals", "preset", "testMatch", "testPathIgnorePatterns", "moduleFileExtensions", "collectCoverageFrom", "coverageThreshold"]),
        _one("all", {"Test environment changed": "testEnvironment", "Transform configuration changed": r"transform\b", "Module name mappings changed": "moduleNameMapper", "Jest preset changed": "preset", "Global configuration changed": r"globals\b", "Test match patterns changed": "testMatch"}),
    ),
    ConfigRule(
        "playwright", "playwright-config", "tests", "playwright",
        (r"^playwright\.config\.(ts|js|mjs|cjs)$", r"^playwright\.ct\.config\.(ts|js)$"),
        _quoted(["projects", "use", "webServer", "testDir", "testMatch", "timeout", "retries", "workers", "reporter", "expect", "fullyParallel", "baseURL", "globalSetup", "globalTeardown"], r"[:{\[=]"),
        _one("del", {"Test projects configuration changed": r"projects\s*[:=\[]", "Web server configuration changed": r"webServer\s*[:={]", "Test directory changed": r"testDir\s*[:=]", "Base URL changed": r"baseURL\s*[:=]", "Global setup changed": r"globalSetup\s*[:=]", "Global teardown changed": r"globalTeardown\s*[:=]"}),
    ),
    ConfigRule(
        "linter-config", "linter-config", "quality", "eslint",
        (r"^\.eslintrc(\.(js|cjs|mjs|json|yml|yaml))?$", r"^eslint\.config\.(js|mjs|cjs|ts|mts|cts)$", r"^\.eslintignore$"),
        _quoted(["rules", "extends", "plugins", "parser", "parserOptions", "overrides", "ignorePatterns"]),
        _one("del", {"Parser changed": r"[\"']?parser[\"']?\s*[:=]", "Extends configuration changed": r"[\"']?extends[\"']?\s*[:=\[]", "Plugin configuration changed": r"[\"']?plugins[\"']?\s*[:=\[]", "Rule severity changed": r"\"error\"|\"warn\"|\"off\"|[012]"}),
    ),
    ConfigRule(
        "linter-config", "linter-config", "quality", "biome", (r"^biome\.(json|jsonc)$",),
        _quoted(["linter", "formatter", "organizeImports", "javascript", "typescript"]),
        _one("del", {"Linter configuration changed": r"[\"']?linter[\"']?\s*[:={]", "Formatter configuration changed": r"[\"']?formatter[\"']?\s*[:={]"}),
    ),
    ConfigRule(
        "linter-config", "linter-config", "quality", "prettier",
        (r"^\.prettierrc(\.(js|cjs|mjs|json|yml|yaml|toml))?$", r"^prettier\.config\.(js|mjs|cjs|ts)$", r"^\.prettierignore$"),
        _quoted(["tabWidth", "singleQuote", "trailingComma", "semi", "printWidth", "plugins"]),
        _one("del", {"Tab width changed": r"[\"']?tabWidth[\"']?\s*[:=]", "Quote style changed": r"[\"']?singleQuote[\"']?\s*[:=]", "Semicolon preference changed": r"[\"']?semi[\"']?\s*[:=]", "Prettier plugins changed": r"[\"']?plugins[\"']?\s*[:=\[]"}),
    ),
    ConfigRule(
        "linter-config", "linter-config", "quality", "stylelint",
        (r"^\.stylelintrc(\.(js|cjs|mjs|json|yml|yaml))?$", r"^stylelint\.config\.(js|mjs|cjs|ts)$"),
        _quoted(["rules", "extends", "plugins", "overrides"]), _one("del", {"Stylelint rules changed": r"[\"']?rules[\"']?\s*[:={]"}),
    ),
    ConfigRule(
        "linter-config", "linter-config", "quality", "oxlint", (r"^\.oxlintrc\.json$", r"^oxlint\.json$"),
        _quoted(["rules", "plugins", "settings"]), _one("del", {"Lint rules changed": r"[\"']?rules[\"']?\s*[:={]"}),
    ),
    *(
        ConfigRule(
            "tailwind", "tailwind-config", "config_env", tool, gate,
            _bare(["theme", "content", "plugins", "presets", "prefix", "important", "darkMode", "safelist"])
            | _bare(["colors", "spacing", "screens", "fontFamily", "fontSize", "fontWeight", "extend", "borderRadius", "boxShadow", "animation", "keyframes"], "theme."),
            {
                "Content paths modified (may affect CSS purging)": [[("all", r"\bcontent\s*[:{]"), ("del", _SOME)]],
                "Class prefix changed (requires updating all class names)": [[("del", r"\bprefix\s*[:{]"), ("add", r"\bprefix\s*[:{]")]],
                "Theme colors modified (may break existing color classes)": [[("del", r"colors\s*[:{]")]],
                "Screen breakpoints modified (may affect responsive design)": [[("del", r"screens\s*[:{]")]],
                "Plugins removed (may remove utility classes)": [[("del", r"plugins\s*[:{]"), ("del", r"require\(")]],
                "Dark mode configuration changed": [[("all", r"darkMode\s*[:{]")]],
            },
            graded=True,
        )
        for tool, gate in (("tailwind", (r"(^|/)tailwind\.config\.(js|cjs|mjs|ts)$",)), ("postcss", (r"(^|/)postcss\.config\.(js|cjs|mjs)$",)))
    ),
    ConfigRule(
        "vite-config", "vite-config", "config_env", "vite", (r"^vite\.config\.(js|cjs|mjs|ts|mts)$",),
        _bare(["build", "server", "preview", "resolve", "plugins", "define", "base", "publicDir", "envPrefix", "optimizeDeps", "esbuild", "ssr"])
        | _bare(["target", "outDir", "assetsDir", "assetsInlineLimit", "cssCodeSplit", "sourcemap", "minify", "rollupOptions", "lib", "manifest", "cssMinify", "modulePreload", "chunkSizeWarningLimit"], "build.")
        | _bare(["host", "port", "proxy", "cors", "https", "hmr", "watch", "middlewareMode"], "server."),
        {
            "Base path changed (affects all asset URLs)": [[("all", r"\bbase\s*[:{]"), ("del", _SOME), ("add", _SOME)]],
            "Output directory changed (may affect deployment)": [[("all", r"\boutDir\s*[:{]")]],
            "Build target changed (affects browser compatibility)": [[("all", r"\btarget\s*[:{]")]],
            "Plugins modified (may affect build behavior)": [[("del", r"plugins\s*[:{]"), ("del", r"import\(|require\(")]],
            "Path aliases modified (may break imports)": [[("del", r"resolve\s*[:{]"), ("del", r"alias\s*[:{]")]],
            "Environment prefix changed (affects env variable exposure)": [[("all", r"\benvPrefix\s*[:{]")]],
            "Build-time constants modified": [[("del", r"\bdefine\s*[:{]")]],
            "Sourcemap configuration changed": [[("all", r"\bsourcemap\s*[:{]")]],
            "SSR configuration changed (affects server rendering)": [[("all", r"\bssr\s*[:{]")]],
        },
        graded=True,
        plugins={
            "React": r"@vitejs/plugin-react", "Vue": r"@vitejs/plugin-vue", "Vue JSX": r"@vitejs/plugin-vue-jsx", "Legacy Browser Support": r"@vitejs/plugin-legacy", "Svelte": r"@sveltejs/vite-plugin-svelte", "PWA": "vite-plugin-pwa",
            "TypeScript Paths": "vite-tsconfig-paths", "Vitest": "vitest", "Angular": "@angular/build", "Solid": "vite-plugin-solid", "Qwik": "vite-plugin-qwik",
        },
    ),
    ConfigRule(
        "docker", "docker-change", "infra", "dockerfile", (r"(?i)Dockerfile(\.[a-z0-9-]+)?$",), {},
        {"Base image changed": [[("del", r"(?im)^\s*FROM\s+"), ("add", r"(?im)^\s*FROM\s+")]], "Default command changed": [[("del", r"CMD\s+"), ("add", r"CMD\s+")]]}
        | _one("del", {"Exposed ports changed": r"EXPOSE\s+\d+", "Entrypoint changed": r"ENTRYPOINT\s+"}),
    ),
    ConfigRule(
        "docker", "docker-change", "infra", "compose", (r"^docker-compose(\.[a-z0-9-]+)?\.(yml|yaml)$", r"^compose(\.[a-z0-9-]+)?\.(yml|yaml)$"), {},
        _one("del", {"Service definition changed": r"(?m)^\s{2}\w+:\s*$", "Port mappings changed": r"(?i)ports:", "Volume mappings changed": r"(?i)volumes:", "Network configuration changed": r"(?i)networks:"}),
    ),
    ConfigRule("docker", "docker-change", "infra", "dockerignore", (r"^\.dockerignore$",), {}, {}),
    ConfigRule(
        "cypress", "cypress-config", "tests", "cypress", (r"(^|/)cypress\.config\.(ts|js|mjs|cjs)$",),
        {n: rf"\b{n}\s*:" for n in ("baseUrl", "env", "viewportWidth", "viewportHeight", "defaultCommandTimeout", "pageLoadTimeout", "requestTimeout", "responseTimeout", "retries", "video", "screenshot", "chromeWebSecurity", "watchForFileChanges")},
        {
            "baseUrl changed (tests may target wrong environment)": [[("del", r"\bbaseUrl\s*:"), ("add", r"\bbaseUrl\s*:")]],
            "Environment variables removed from config": [[("del", r"env\s*:\s*\{([^}]+)\}"), ("del", r"\b\w+\s*:")]],
            "Viewport dimensions changed (may affect visual tests)": [[("del", r"viewportWidth\s*:|viewportHeight\s*:"), ("add", r"viewportWidth\s*:|viewportHeight\s*:")]],
        },
        graded=True,
    ),
    ConfigRule(
        "turborepo", "turborepo-config", "config_env", "turborepo", (r"^turbo\.jsonc?$",),
        _quoted(["tasks", "pipeline", "globalDependencies", "globalEnv", "globalPassThroughEnv", "remoteCache", "experimentalUI", "daemon", "envMode", "cacheDir"]),
        _one("del", {"Task definitions changed": r"[\"']?tasks[\"']?\s*[:={]", "Pipeline definitions changed (legacy)": r"[\"']?pipeline[\"']?\s*[:={]", "Global dependencies changed (affects cache invalidation)": r"[\"']?globalDependencies[\"']?\s*[:=\[]", "Global env changed (affects all tasks)": r"[\"']?globalEnv[\"']?\s*[:=\[]", "Task outputs changed (affects caching)": r"[\"']?outputs[\"']?\s*[:=\[]", "Remote cache configuration changed": r"[\"']?remoteCache[\"']?\s*[:={]"})
        | {"Caching disabled for task(s)": [[("del", r"[\"']?cache[\"']?\s*[:=].*false")], [("add", r"[\"']?cache[\"']?\s*[:=]\s*false")]]},
        quiet=True,
    ),
    *(
        ConfigRule("monorepo", "monorepo-config", "config_env", tool, gate, _quoted(fields), reasons, quiet=True, required=required)
        for tool, gate, fields, reasons, required in (
            ("turborepo", (r"^turbo\.json$",), ["pipeline", "globalDependencies", "globalEnv", "tasks"], {"Build pipeline configuration changed": [[("del", "pipeline|tasks")]], "Caching disabled for tasks": [[("add", r"cache\s*[:=]\s*false")]], "Global dependencies changed (affects cache invalidation)": [[("all", "globalDependencies")]]}, None),
            ("pnpm", (r"^pnpm-workspace\.ya?ml$",), ["packages"], {"Workspace packages configuration changed": [[("del", "packages")]]}, None),
            ("lerna", (r"^lerna\.json$",), ["packages", "version", "npmClient", "useWorkspaces"], {"Switching to independent versioning": [[("add", "version"), ("add", "independent")]], "npm client configuration changed": [[("all", "npmClient")]]}, None),
            ("nx", (r"^nx\.json$", r"^project\.json$"), ["targetDefaults", "namedInputs", "plugins", "defaultProject"], {"Default target configuration changed": [[("del", "targetDefaults")]], "Nx plugins configuration changed": [[("all", "plugins")]]}, None),
            ("yarn", (r"^\.yarnrc\.yml$", r"^\.yarnrc$"), ["nodeLinker", "enableGlobalCache", "nmMode"], {"Node linker strategy changed (affects dependency resolution)": [[("all", "nodeLinker")]]}, None),
            ("npm", (r"^package\.json$",), ["workspaces"], {"Workspace packages configuration changed": [[("del", "workspaces")]]}, ("all", r"[\"']workspaces[\"']")),
            ("changesets", (r"^\.changeset/config\.json$",), ["baseBranch", "access", "changelog"], {"Base branch for changesets modified": [[("all", "baseBranch")]], "Package publish access level changed": [[("add", "access")]]}, None),
        )
    ),
]


def _flat(rule: ConfigRule) -> list[tuple[str, str, int, int, int, Need]]:
    """(role, label, alternative, number of needs, need number, need) of every pattern of a rule."""
    out = [("section", label, 0, 1, 0, ("all", p)) for label, p in rule.sections.items()]
    for label, alternatives in rule.reasons.items():
        out += [("reason", label, a, len(needs), i, need) for a, needs in enumerate(alternatives) for i, need in enumerate(needs)]
    out += [("plugin", label, 0, 1, 0, ("all", p)) for label, p in (rule.plugins or {}).items()]
    if rule.required:
        out.append(("required", "required", 0, 1, 0, rule.required))
    return out


#: What every pattern of every rule stands for: number, rule, role, label, alternative, number of needs, need.
_MEANINGS: list[tuple[int, int, str, str, int, int, int]] = []


def _label_rule() -> Rule:
    """Labels named after the numbers of the patterns that match."""
    hits = []
    for k, rule in enumerate(RULES):
        checks = []
        for role, text, alt, needs, need, (scope, pattern) in [("file", "", 0, 1, 0, ("any", "")), *_flat(rule)]:
            number = len(_MEANINGS)
            _MEANINGS.append((number, k, role, text, alt, needs, need))
            made = label("config", name=f"'{number}'")
            checks.append(made if scope == "any" else f"case when {scope}_text rlike {lit(pattern)} then {made} end")
        hits.append(f"case when {any_path(list(rule.gate))} then array({', '.join(checks)}) end")
    return Rule([g for r in RULES for g in r.gate], f"array_compact(flatten(array_compact(array({', '.join(hits)}))))")


LABEL_RULES["config"] = _label_rule()


def config_findings(changes: Changes, rules: list[ConfigRule] = RULES) -> DataFrame:
    """changeset_id, file, status, analyzer, type, category, tool, sections, reasons, plugins, is_breaking, confidence.

    Sections and reasons are sorted and joined by '; '. Patterns are looked for within
    each hunk; what a reason needs may come from several hunks of a file. One label per
    pattern comes from the hunks; what it stands for is joined from a table of fixed rows.
    """
    spark = changes.files.sparkSession
    wanted = [k for k, r in enumerate(RULES) if r in rules]
    table = spark.createDataFrame([m for m in _MEANINGS if m[1] in wanted], "hit int, rule int, role string, label string, alt int, needs int, need int")
    matched = changes.rows("config").select("changeset_id", "path", F.col("name").cast("int").alias("hit")).distinct()
    met = (
        matched.join(F.broadcast(table), "hit")
        .groupBy("changeset_id", F.col("path").alias("file"), "rule", "role", "label", "alt", "needs")
        .agg(F.count_distinct("need").alias("found"))
        .where("found = needs")
    )
    joined = lambda role: F.array_join(F.array_sort(F.collect_set(F.when(F.col("role") == role, F.col("label")))), "; ")
    named = spark.createDataFrame([(k, r.analyzer, r.type, r.category, r.tool, r.quiet, r.graded, r.required is not None) for k, r in enumerate(RULES) if k in wanted], "rule int, analyzer string, type string, category string, tool string, quiet boolean, graded boolean, needs_more boolean")
    found = met.groupBy("changeset_id", "file", "rule").agg(
        joined("section").alias("sections"), joined("reason").alias("reasons"), joined("plugin").alias("plugins"), F.max((F.col("role") == "required").cast("int")).alias("has_required")
    )
    listed = changes.files.select("changeset_id", F.col("path").alias("file"), "status")
    labelled = found.join(F.broadcast(named), "rule").join(listed, ["changeset_id", "file"], "left").withColumn("status", F.coalesce("status", F.lit("modified")))
    kept = labelled.where("(not needs_more or has_required = 1) and (not quiet or sections <> '' or reasons <> '')")
    breaking = F.col("reasons") != ""
    confidence = F.when(breaking, "high").when(F.col("graded") & (F.col("sections") == ""), "low").otherwise("medium")
    return kept.select("changeset_id", "file", "status", "analyzer", "type", "category", "tool", "sections", "reasons", "plugins", breaking.alias("is_breaking"), confidence.alias("confidence"))


def config_sql(rules: list[ConfigRule] = RULES) -> str:
    """The same from the view chg, by joining a table of the patterns."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    rows = []
    for k, r in enumerate(rules):
        gate = "|".join(f"(?:{g})" for g in r.gate)
        for role, label, alt, needs, need, (scope, pattern) in [("file", "", 0, 1, 0, ("any", "")), *_flat(r)]:
            rows.append(f"({k}, {q(gate)}, {q(role)}, {q(label)}, {alt}, {needs}, {need}, {q(scope)}, {q(pattern)})")
    names = ", ".join(f"({k}, {q(r.analyzer)}, {q(r.type)}, {q(r.category)}, {q(r.tool)}, {str(r.quiet).lower()}, {str(r.graded).lower()}, {str(r.required is not None).lower()})" for k, r in enumerate(rules))
    return f"""
        , rule_rows(rule, gate, role, label, alt, needs, need, scope, pattern) as (values {', '.join(rows)}),
        rule_names(rule, analyzer, type, category, tool, quiet, graded, needs_more) as (values {names}),
        gates as (select distinct rule, gate from rule_rows),
        gated as (select c.*, g.rule from chg c join gates g on regexp_matches(c.path, g.gate)),
        hit as (select distinct g.changeset_id, g.path as file, g.status, g.rule, r.role, r.label, r.alt, r.needs, r.need
            from gated g join rule_rows r on g.rule = r.rule
            where r.scope = 'any' or regexp_matches(case r.scope when 'add' then g.add_text when 'del' then g.del_text else g.all_text end, r.pattern)),
        met as (select changeset_id, file, rule, role, label, alt, max(status) as status from hit group by changeset_id, file, rule, role, label, alt, needs having count(distinct need) = needs),
        per_file as (select changeset_id, file, rule, max(status) as status,
            coalesce(string_agg(distinct label, '; ' order by label) filter (where role = 'section'), '') as sections,
            coalesce(string_agg(distinct label, '; ' order by label) filter (where role = 'reason'), '') as reasons,
            coalesce(string_agg(distinct label, '; ' order by label) filter (where role = 'plugin'), '') as plugins,
            bool_or(role = 'required') as has_required from met group by changeset_id, file, rule)
        select p.changeset_id, p.file, p.status, n.analyzer, n.type, n.category, n.tool, p.sections, p.reasons, p.plugins, p.reasons <> '' as is_breaking,
            case when p.reasons <> '' then 'high' when n.graded and p.sections = '' then 'low' else 'medium' end as confidence
        from per_file p join rule_names n on p.rule = n.rule
        where (not n.needs_more or p.has_required) and (not n.quiet or p.sections <> '' or p.reasons <> '')"""
