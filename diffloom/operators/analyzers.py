"""Rule operators over change sets: each turns files or hunks into typed rows.

``files`` has changeset_id, path, status. ``changes`` (labels.Changes) gives what rules
find in the lines of hunks; patterns are looked for within a hunk, so no file is gathered
in one place, and what concerns a whole file or change set is aggregated from labels.
Lists are sorted and joined by ','. Null paths are ignored; empty inputs give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffloom.operators import paths as P
from diffloom.operators.labels import TEXTS, Changes, Rule, any_path, both_sides, label, listed_files, lit, marks, names
from diffloom.runtime import semi_join

RULES: dict[str, Rule] = {"lines": Rule([""], f"array({label('lines', 'cast(size(additions) as string)', 'cast(size(deletions) as string)')})")}


_TRIM = lit("^[\\s\u00a0\u2003]+|[\\s\u00a0\u2003]+$")
_SHOWN = "transform(if(size(additions) > 0, additions, deletions), x -> regexp_replace(x, " + _TRIM + ", ''))"
_PLAIN = "filter(shown, x -> x <> '' and not startswith(x, '//') and not startswith(x, '/*') and not startswith(x, '*') and not startswith(x, '#'))"
_EXCERPT = f"transform(array({_SHOWN}), shown -> coalesce(get({_PLAIN}, 0), get(shown, 0), ''))[0]"
RULES["excerpt"] = Rule([""], f"array({label('excerpt', 'cast(new_start as string)', _EXCERPT)})")


def changes_of(files: DataFrame, hunks: DataFrame) -> Changes:
    """The hunks of delivered files under the rules of all analyzers."""
    return Changes(listed_files(files), hunks, RULES)


def listed(column: str | Column, when: Column | None = None) -> Column:
    """Distinct values, sorted, joined by ','."""
    c = F.col(column) if isinstance(column, str) else column
    return F.array_join(F.array_sort(F.collect_set(c if when is None else F.when(when, c))), ",")


# --- core and supply chain --------------------------------------------------------


def file_summary(files: DataFrame) -> DataFrame:
    """Per change set the added, modified, deleted and renamed paths that are not build output."""
    kept = files.where(~P.is_excluded(F.col("path")))
    return kept.groupBy("changeset_id").agg(*[listed("path", F.col("status") == s).alias(s) for s in ("added", "modified", "deleted", "renamed")])


def file_categories(files: DataFrame) -> DataFrame:
    """changeset_id, category, files: number of paths of each category."""
    return files.groupBy("changeset_id", P.category(F.col("path")).alias("category")).agg(F.count("*").alias("files"))


def large_diffs(files: DataFrame, changes: Changes, max_files: int = 30, max_lines: int = 1000) -> DataFrame:
    """Change sets with more files or changed lines than the limits."""
    n_files = files.groupBy("changeset_id").agg(F.count("*").alias("files_changed"))
    n_lines = changes.counts().groupBy("changeset_id").agg(F.sum(F.col("additions") + F.col("deletions")).alias("lines_changed"))
    both = n_files.join(n_lines, "changeset_id", "left").select("changeset_id", "files_changed", F.coalesce("lines_changed", F.lit(0)).alias("lines_changed"))
    return both.where((F.col("files_changed") > max_files) | (F.col("lines_changed") > max_lines))


LOCKFILE = r"^(package-lock\.json|yarn\.lock|pnpm-lock\.yaml|bun\.lockb?)$"
# Manifest fields whose string values are no dependency versions.
NO_DEPENDENCY = ["name", "version", "description", "main", "module", "types", "typings", "exports", "bin", "scripts", "repository", "keywords", "author", "license", "bugs", "homepage", "funding", "files", "engines", "os", "cpu", "private", "publishConfig", "workspaces", "packageManager", "type", "sideEffects", "browser", "unpkg", "jsdelivr"]
DEPENDENCY_FIELD = r"\"(dependencies|devDependencies|peerDependencies|optionalDependencies|bundledDependencies|bundleDependencies)\""
VERSION_VALUE = r"\"\s*[\^~>=<]?\d+\.\d+|\"\s*[*x]\s*\"|\"\s*\d+\.x|\"\s*npm:|\"\s*git(\+https?|\+ssh)?:|\"\s*github:|\"\s*(file|link):|\"\s*workspace:|\"\s*https?://"
FIELD_NAME = r"^\s*\"([^\"]+)\"\s*:\s*\""


_IS_DEPENDENCY = f"x rlike {lit(DEPENDENCY_FIELD)} or (x rlike {lit(FIELD_NAME)} and not array_contains(array({', '.join(map(lit, NO_DEPENDENCY))}), regexp_extract(x, {lit(FIELD_NAME)}, 1)) and x rlike {lit(VERSION_VALUE)})"
RULES["dependency-line"] = Rule([r"^package\.json$"], f"array({label('dependency-line', f'cast(exists(concat(additions, deletions), x -> {_IS_DEPENDENCY}) as string)')})")


def lockfile_mismatches(files: DataFrame, changes: Changes) -> DataFrame:
    """Change sets whose manifest changes dependencies without a lock file, or a lock file without the manifest."""
    manifest = F.col("path") == "package.json"
    touched = files.groupBy("changeset_id").agg(F.bool_or(manifest).alias("manifest_changed"), F.bool_or(F.col("path").rlike(LOCKFILE)).alias("lockfile_changed"), F.bool_or(manifest & (F.col("status") == "added")).alias("manifest_added"))
    lines = changes.rows("dependency-line").groupBy("changeset_id").agg(F.bool_or(F.col("kind") == "true").alias("dependency_lines"))
    both = touched.join(lines, "changeset_id", "left").withColumn("dependencies_changed", F.col("manifest_changed") & F.coalesce("dependency_lines", "manifest_added"))
    return both.where("(dependencies_changed and not lockfile_changed) or (not manifest_changed and lockfile_changed)").select("changeset_id", "manifest_changed", "lockfile_changed")


CODE_PATH = r"\.(ts|tsx|js|jsx|mjs|cjs|svelte|vue|astro)$"
ENV_CONFIG = [r"\.env(\..+)?$", r"(vite|svelte|next|nuxt|astro)\.config\.(ts|js|mjs)$"]
ENV_NO_SCAN = [r"\.md$", r"^docs/", r"/tests/", r"/__tests__/", r"\.test\.", r"\.spec\.", r"^tests/", r"/fixtures/", r"/__fixtures__/"]
ENV_READ = r"process\.env\.([A-Z_][A-Z0-9_]*)"
ENV_VITE = r"import\.meta\.env\.(VITE_[A-Z0-9_]+)"
ENV_PUBLIC = r"\b(PUBLIC_[A-Z0-9_]+)"
ENV_IMPORT = r"import\s*\{([^}]+)\}\s*from\s*[\"']\$env/(?:static|dynamic)/(?:public|private)[\"']"


_IMPORTED = f"transform(flatten(transform(regexp_extract_all(add_text, {lit(ENV_IMPORT)}, 1), x -> split(x, ','))), v -> regexp_replace(trim(regexp_replace(v, {lit(r'\s+as\s+.*$')}, '')), {lit(r'\s+')}, ''))"
_ENV_NAMES = ", ".join(f"regexp_extract_all(add_text, {lit(p)}, 1)" for p in (ENV_READ, ENV_VITE, ENV_PUBLIC))
RULES["env"] = Rule(
    [*ENV_CONFIG, CODE_PATH],
    f"case when not {any_path(P.EXCLUDED + ENV_NO_SCAN)} then transform(array_distinct(filter(concat({_ENV_NAMES}, {_IMPORTED}), v -> v <> '')), n -> {label('env', name='n')}) end",
)


def env_vars(changes: Changes) -> DataFrame:
    """changeset_id, name, files: environment variables that added code reads or imports."""
    return changes.rows("env").groupBy("changeset_id", "name").agg(listed("path").alias("files"))


def security_files(files: DataFrame) -> DataFrame:
    """Per change set the security-sensitive paths and why they are."""
    found = files.withColumn("reason", P.security_reason(F.col("path"))).where("reason is not null")
    return found.groupBy("changeset_id").agg(F.count("*").alias("n_files"), listed("path").alias("files"), listed("reason").alias("reasons"))


DESTRUCTIVE_SQL = r"(?i)\b(DROP\s+TABLE|DROP\s+COLUMN|TRUNCATE)\b"
SCHEMA_SQL = r"(?i)ALTER\s+TABLE[^;]+\b(ALTER\s+COLUMN|TYPE)\b"
UNSCOPED_SQL = r"(?i)(UPDATE|DELETE)\s+(?![^;\n]*\bWHERE\b)"


RULES["sql-risk"] = Rule(
    P.MIGRATION_FILE,
    "array_compact(array(" + "case " + " ".join(f"when add_text rlike {lit(p)} then {label('sql-risk', lit(k))}" for k, p in (("destructive", DESTRUCTIVE_SQL), ("schema_change", SCHEMA_SQL), ("unscoped_modification", UNSCOPED_SQL))) + " end))",
)


def sql_risks(changes: Changes) -> DataFrame:
    """changeset_id, path, hunk_ord, risk of migration hunks: destructive, schema_change or unscoped_modification."""
    return changes.rows("sql-risk").select("changeset_id", "path", "hunk_ord", F.col("kind").alias("risk"))


# Patterns of risky workflow lines.
WORKFLOW_RISKS = {
    "permissions_broadened": r"(?i)permissions:[\s\S]{0,500}?\b(contents|id-token|actions|packages|deployments|security-events)\b\s*:\s*write",
    "pull_request_target": r"(?i)pull_request_target",
    "remote_script_download": r"(?i)(curl|wget)\s+[^\s]+\s*\|\s*(sh|bash)",
}


RULES["ci"] = Rule(P.CI_FILE, marks("ci", {**WORKFLOW_RISKS, "pipeline_changed": ""}, 1))


def ci_workflows(changes: Changes) -> DataFrame:
    """changeset_id, path, risk, first_hunk: risks of each pipeline file, and pipeline_changed for every one."""
    return changes.rows("ci").groupBy("changeset_id", "path", F.col("name").alias("risk")).agg(F.min("hunk_ord").alias("first_hunk"))


def infra_changes(files: DataFrame) -> DataFrame:
    """changeset_id, infra_type, files."""
    return files.withColumn("infra_type", P.first_of(F.col("path"), P.INFRA)).where("infra_type is not null").groupBy("changeset_id", "infra_type").agg(listed("path").alias("files"))


def api_contracts(files: DataFrame) -> DataFrame:
    """changeset_id, files of change sets that touch API contracts."""
    return files.where(P.any_of(F.col("path"), P.API_CONTRACT)).groupBy("changeset_id").agg(listed("path").alias("files"))


CLOUDFLARE_WORDS = r"(?i)\b(wrangler|cloudflare|workers|pages)\b"


RULES["cloudflare"] = Rule([r"^\.github/workflows/.*\.(yml|yaml)$"], marks("cloudflare", {"ci": CLOUDFLARE_WORDS}, 1))


def cloudflare_changes(files: DataFrame, changes: Changes) -> DataFrame:
    """changeset_id, area (wrangler or ci), files."""
    wrangler = files.where(F.col("path").rlike(r"^wrangler\.(toml|json)$")).select("changeset_id", F.lit("wrangler").alias("area"), "path")
    ci = changes.rows("cloudflare").select("changeset_id", F.lit("ci").alias("area"), "path")
    return wrangler.unionByName(ci).groupBy("changeset_id", "area").agg(listed("path").alias("files"))


def test_changes(files: DataFrame) -> DataFrame:
    """Per change set the test and test configuration files by status."""
    path = F.col("path")
    found = files.where(P.any_of(path, P.TEST_FILE) | P.any_of(path, P.TEST_CONFIG))
    return found.groupBy("changeset_id").agg(listed("path").alias("files"), *[listed("path", F.col("status") == s).alias(s) for s in ("added", "modified", "deleted")])


# --- databases and dependencies -----------------------------------------------------

# Destructive statements of migrations.
SUPABASE_DESTRUCTIVE = {
    "DROP TABLE": r"(?i)DROP\s+TABLE",
    "DROP COLUMN": r"(?i)DROP\s+COLUMN",
    "TRUNCATE": r"(?i)TRUNCATE",
    "ALTER COLUMN": r"(?i)ALTER\s+COLUMN",
    "ALTER TYPE": r"(?i)ALTER\s+TABLE\s+\w+\s+.*\s+TYPE",
    "DELETE without WHERE": r"(?i)DELETE\s+FROM\s+\w+\s*(?:;|\z)",
}
PYTHON_DESTRUCTIVE = {
    "drop_table": r"(?i)op\.drop_table\s*\(",
    "drop_column": r"(?i)op\.drop_column\s*\(",
    "drop_index": r"(?i)op\.drop_index\s*\(",
    "drop_constraint": r"(?i)op\.drop_constraint\s*\(",
    "raw DROP SQL": r"(?i)op\.execute\s*\(\s*[\"'].*DROP",
    "raw TRUNCATE SQL": r"(?i)op\.execute\s*\(\s*[\"'].*TRUNCATE",
    "raw DELETE without WHERE": r"(?i)op\.execute\s*\(\s*[\"'].*DELETE\s+FROM\s+\w+\s*[\"']\s*\)",
    "Django DeleteModel": r"(?i)DeleteModel\s*\(",
    "Django RemoveField": r"(?i)RemoveField\s*\(",
    "Django make field non-nullable": r"(?i)AlterField.*null\s*=\s*False",
    "Django raw DROP SQL": r"(?i)migrations\.RunSQL\s*\(.*DROP",
    "Django raw TRUNCATE SQL": r"(?i)migrations\.RunSQL\s*\(.*TRUNCATE",
}
PYTHON_SCHEMA = r"(?i)(op\.(alter_column|create_table|add_column|create_index|create_foreign_key|create_unique_constraint)|CreateModel|AddField|AlterField|RenameField|RenameModel|AddIndex|AddConstraint)\s*\("
PYTHON_MIGRATION = [("alembic", [r"alembic/versions/.*\.py$", r"/versions/.*\.py$"]), ("django", [r"/migrations/\d{4}_.*\.py$"])]


RULES["supabase"] = Rule(["^supabase/"], marks("supabase", SUPABASE_DESTRUCTIVE, 1))
_PYTHON_MIGRATIONS = [g for _, gates in PYTHON_MIGRATION for g in gates]
RULES["python-migration"] = Rule(_PYTHON_MIGRATIONS, marks("python-migration", PYTHON_DESTRUCTIVE, 1))
RULES["python-schema"] = Rule(_PYTHON_MIGRATIONS, marks("python-schema", {"schema": PYTHON_SCHEMA}, 1))


def _risk(files: DataFrame, destructive: DataFrame, schema: DataFrame | None, low: Column) -> DataFrame:
    """changeset_id, tool, n_files, files, risk, reasons of migration files (path, tool) of each change set."""
    found = destructive.select("changeset_id", "path", F.col("name").alias("label"), F.lit(False).alias("is_schema"))
    if schema is not None:
        found = found.unionByName(schema.select("changeset_id", "path", F.lit(None).cast("string").alias("label"), F.lit(True).alias("is_schema")))
    grouped = files.join(found, ["changeset_id", "path"], "left").groupBy("changeset_id", "tool").agg(
        F.count_distinct("path").alias("n_files"), listed("path").alias("files"), listed("label").alias("reasons"), F.coalesce(F.bool_or("is_schema"), F.lit(False)).alias("is_schema"), F.bool_and(low).alias("is_low")
    )
    risk = F.when(F.col("reasons") != "", "high").when(F.col("is_low"), "low").when(F.col("is_schema") | F.lit(schema is None), "medium").otherwise("low")
    return grouped.select("changeset_id", "tool", "n_files", "files", risk.alias("risk"), "reasons")


def supabase_migrations(files: DataFrame, changes: Changes) -> DataFrame:
    """Migration risk of change sets that touch supabase/: of its migrations, else of its other files."""
    own = files.where(F.col("path").startswith("supabase/")).withColumn("migration", F.col("path").rlike(r"^supabase/migrations/.*\.sql$"))
    has = own.groupBy("changeset_id").agg(F.bool_or("migration").alias("any_migration"))
    chosen = own.join(has, "changeset_id").where("migration or not any_migration").select("changeset_id", "path", F.lit("supabase").alias("tool"))
    return _risk(chosen, changes.rows("supabase"), None, F.col("path").rlike(r"^supabase/(seed|config)"))


def python_migrations(files: DataFrame, changes: Changes) -> DataFrame:
    """Migration risk per change set and tool (alembic, django)."""
    chosen = files.withColumn("tool", P.first_of(F.col("path"), PYTHON_MIGRATION)).where("tool is not null").select("changeset_id", "path", "tool")
    return _risk(chosen, changes.rows("python-migration"), changes.rows("python-schema"), F.lit(False))


# Elements of schema files by kind: path gate, element -> pattern with its name.
SCHEMA_ELEMENTS = {
    "graphql": (r"\.graphql$|\.gql$|schema\.graphqls$|schema\.sdl$", {"type": r"type\s+(\w+)\s*[{@]", "enum": r"enum\s+(\w+)\s*\{", "interface": r"interface\s+(\w+)\s*[{@]", "input": r"input\s+(\w+)\s*\{"}),
    "prisma": (r"\.prisma$", {"model": r"model\s+(\w+)\s*\{", "enum": r"enum\s+(\w+)\s*\{"}),
    "drizzle": (r"\.schema\.ts$|\.schema\.js$|/schema/.+\.(ts|js)$|/schema\.ts$", {"table": r"export\s+const\s+\w+\s*=\s*(?:pg|mysql|sqlite)Table\s*\(\s*[\"']([^\"']+)[\"']"}),
    "tsconfig": (r"(^|/)tsconfig(\.\w+)?\.json$", {"option": r"\"(\w+)\":\s*"}),
}


def _by_gate(rule: str, groups: dict[str, tuple[str, dict[str, str]]]) -> Rule:
    """Labels (kind: group, more: kind of thing, name) of both sides, each group behind its gate."""
    each = []
    for group, (gate, kinds) in groups.items():
        found = [f"transform(array_distinct(regexp_extract_all({TEXTS[side]}, {lit(p)}, 1)), n -> {label(rule, lit(group), 'n', lit(kind), side)})" for kind, p in kinds.items() for side in (1, 2)]
        each.append(f"case when path rlike {lit(gate)} then concat({', '.join(found)}) end")
    return Rule([g for g, _ in groups.values()], f"flatten(array_compact(array({', '.join(each)})))")


def _two_sides(rows: DataFrame, group: str, element: str, removed: str = "removed") -> DataFrame:
    """changeset_id, path, group, element, name, change: what is on both sides of a file is modified."""
    found = rows.groupBy("changeset_id", "path", F.col("kind").alias(group), F.col("more").alias(element), "name").agg(F.bit_or("side").alias("sides"))
    return found.withColumn("change", F.when(F.col("sides") == 1, "added").when(F.col("sides") == 2, removed).otherwise("modified")).drop("sides")


RULES["schema"] = _by_gate("schema", SCHEMA_ELEMENTS)


def schema_elements(changes: Changes) -> DataFrame:
    """changeset_id, path, kind, element, name, change: elements added, removed or modified in schema files.

    An element both in added and deleted lines of a file is modified.
    """
    return _two_sides(changes.rows("schema"), "kind", "element")


# Reasons that make a schema change breaking, by kind, looked for in deleted lines.
SCHEMA_BREAKS = {
    "prisma": {"Unique constraint removed": r"@unique\b|@@unique", "Index removed": r"@@index"},
    "drizzle": {
        "Columns removed or modified": r"(\w+):\s*(?:serial|varchar|text|integer|bigint|boolean|timestamp|json|jsonb|uuid|real|doublePrecision|decimal)\s*\(",
        "Index removed": r"\$onIndex\s*\(",
        "Unique constraint removed": r"\.unique\s*\(|unique\s*:\s*true",
        "Foreign key relation removed": r"\.references\s*\(",
        "Not-null constraint removed (may allow nulls)": r"\.notNull\s*\(|notNull\s*:\s*true",
    },
}
# Compiler options whose change can break a build.
CRITICAL_OPTIONS = ["strict", "strictNullChecks", "strictFunctionTypes", "strictBindCallApply", "strictPropertyInitialization", "noImplicitAny", "noImplicitThis", "noImplicitReturns", "noUncheckedIndexedAccess", "target", "module", "moduleResolution", "lib", "jsx", "esModuleInterop", "allowSyntheticDefaultImports", "skipLibCheck", "isolatedModules", "verbatimModuleSyntax", "baseUrl", "paths", "outDir", "rootDir", "declaration", "declarationMap", "sourceMap", "composite", "incremental", "emitDecoratorMetadata", "experimentalDecorators"]


RULES["schema-break"] = Rule(
    [SCHEMA_ELEMENTS[k][0] for k in SCHEMA_BREAKS],
    "flatten(array_compact(array(" + ", ".join(f"case when path rlike {lit(SCHEMA_ELEMENTS[k][0])} then {marks('schema-break', rules, 2, k)} end" for k, rules in SCHEMA_BREAKS.items()) + ")))",
)


# Compiler options that make type checks stricter.
STRICTNESS_OPTIONS = [
    "strict", "strictNullChecks", "strictFunctionTypes", "strictBindCallApply", "strictPropertyInitialization", "noImplicitAny", "noImplicitThis", "noImplicitReturns", "noUncheckedIndexedAccess",
    "noUnusedLocals", "noUnusedParameters", "exactOptionalPropertyTypes",
]


def strictness_changes(changes: Changes) -> DataFrame:
    """changeset_id, path, name, change of the compiler options that concern strictness."""
    return schema_elements(changes).where("kind = 'tsconfig'").where(F.expr(f"name in ({', '.join(map(lit, STRICTNESS_OPTIONS))})")).select("changeset_id", "path", "name", "change")


def schema_changes(changes: Changes) -> DataFrame:
    """Per schema file: added, removed and modified elements, reasons, is_breaking."""
    elements = schema_elements(changes)
    label = F.concat_ws(":", "element", "name")
    per_file = elements.groupBy("changeset_id", "path", "kind").agg(
        *[listed(label, F.col("change") == c).alias(c) for c in ("added", "removed", "modified")], F.bool_or(F.when(F.col("kind") == "tsconfig", F.expr(f"name in ({', '.join(map(lit, CRITICAL_OPTIONS))})")).otherwise(F.col("change") != "added")).alias("breaks")
    )
    why = changes.rows("schema-break").groupBy("changeset_id", "path", "kind").agg(listed("name").alias("reasons"))
    both = per_file.join(why, ["changeset_id", "path", "kind"], "full")
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return both.select("changeset_id", "path", "kind", text("added"), text("removed"), text("modified"), text("reasons"), (F.coalesce("breaks", F.lit(False)) | F.col("reasons").isNotNull()).alias("is_breaking"))


# Packages whose change needs care.
RISKY_PYTHON = {
    "auth": ["django-allauth", "python-social-auth", "authlib", "oauthlib", "python-jose", "pyjwt", "passlib", "argon2-cffi", "bcrypt"],
    "database": ["django", "sqlalchemy", "alembic", "psycopg2", "psycopg2-binary", "asyncpg", "pymysql", "mysqlclient", "pymongo", "motor", "redis", "aioredis", "tortoise-orm", "peewee", "sqlmodel", "databases", "prisma"],
    "native": ["numpy", "pandas", "scipy", "pillow", "opencv-python", "tensorflow", "torch", "cryptography", "pycryptodome", "pynacl"],
    "payment": ["stripe", "braintree", "paypalrestsdk"],
}
RISKY_NODE = {
    "auth": ["passport", "jsonwebtoken", "bcrypt", "bcryptjs", "oauth", "auth0", "@auth0/auth0-spa-js", "clerk", "@clerk/clerk-sdk-node", "@clerk/nextjs", "next-auth", "@auth/core", "@auth/sveltekit", "lucia", "lucia-auth", "arctic", "oslo", "express-session", "cookie-session", "passport-local", "passport-jwt", "passport-oauth2", "jose", "jwks-rsa", "supertokens-node", "@supabase/auth-helpers-sveltekit", "@supabase/ssr"],
    "database": ["prisma", "@prisma/client", "drizzle-orm", "typeorm", "sequelize", "knex", "mongoose", "pg", "mysql", "mysql2", "sqlite3", "better-sqlite3", "mongodb", "redis", "ioredis", "@neondatabase/serverless", "@planetscale/database", "@libsql/client", "kysely"],
    "native": ["sharp", "canvas", "node-gyp", "node-pre-gyp", "node-addon-api", "nan", "ffi-napi", "ref-napi", "argon2", "libsodium-wrappers", "sodium-native", "cpu-features", "usb", "serialport"],
    "payment": ["stripe", "@stripe/stripe-js", "paypal-rest-sdk", "@paypal/checkout-server-sdk", "braintree", "square", "@square/web-sdk", "adyen-api-library", "razorpay", "mollie-api-node", "lemon-squeezy", "@polar-sh/sdk", "polar-sdk"],
}
REQUIREMENT = r"^\s*([a-zA-Z0-9_-]+)(?:\[[^\]]+\])?(?:[><=~!]+(.+))?"
REQUIREMENTS_FILE = r"(^|/)requirements[^/]*\.txt$"
MANIFEST_LINE = r"^\s*\"([^\"]+)\"\s*:\s*\"([\^~>=<]*\d[^\"]*)\""


def _version_rule(rule: str, gate: str, pattern: str, skip: str) -> Rule:
    side = lambda column, mark: f"transform(filter({column}, x -> x rlike {lit(pattern)} and not x rlike {lit(skip)}), x -> {label(rule, f'trim(regexp_extract(x, {lit(pattern)}, 2))', f'lower(regexp_extract(x, {lit(pattern)}, 1))', lit('dependencies'), mark)})"
    return Rule([gate], f"concat({side('additions', 1)}, {side('deletions', 2)})")


#: An object opened in a manifest; the lines below belong to it until the next one.
MANIFEST_SECTION = r"^\s*\"([^\"]+)\"\s*:\s*\{"
#: Manifest sections that are compared.
SECTIONS = ["dependencies", "devDependencies"]


def _manifest_rule(rule: str, gate: str, pattern: str, skip: str) -> Rule:
    """Dependency lines with the section above them on the same side of the hunk, else dependencies."""
    entry = "struct<section:string,line:string>"
    start = f"named_struct('now', 'dependencies', 'out', cast(array() as array<{entry}>))"
    now = f"if(x rlike {lit(MANIFEST_SECTION)}, regexp_extract(x, {lit(MANIFEST_SECTION)}, 1), a.now)"
    wanted = f"x rlike {lit(pattern)} and not x rlike {lit(skip)} and a.now in ({', '.join(map(lit, SECTIONS))})"
    step = f"named_struct('now', {now}, 'out', if({wanted}, concat(a.out, array(named_struct('section', a.now, 'line', x))), a.out))"
    lines = lambda column: f"aggregate({column}, {start}, (a, x) -> {step}, a -> a.out)"
    side = lambda column, mark: f"transform({lines(column)}, e -> {label(rule, f'trim(regexp_extract(e.line, {lit(pattern)}, 2))', f'lower(regexp_extract(e.line, {lit(pattern)}, 1))', 'e.section', mark)})"
    return Rule([gate], f"concat({side('additions', 1)}, {side('deletions', 2)})")


def _versions(rows: DataFrame) -> DataFrame:
    """changeset_id, path, name, section, from_version, to_version of dependency lines; the greatest version of a side counts."""
    return rows.groupBy("changeset_id", "path", "name", F.col("more").alias("section")).agg(F.max(F.when(F.col("side") == 2, F.col("kind"))).alias("from_version"), F.max(F.when(F.col("side") == 1, F.col("kind"))).alias("to_version"))


RULES["requirement"] = _version_rule("requirement", REQUIREMENTS_FILE, REQUIREMENT, r"^\s*(#|-|$)")
RULES["manifest-line"] = _manifest_rule("manifest-line", r"(^|/)package\.json$", MANIFEST_LINE, FIELD_NAME.replace(r"([^\"]+)", "(" + "|".join(NO_DEPENDENCY) + ")"))


def _risky(table: dict[str, list[str]]) -> Column:
    return F.expr("case " + " ".join(f"when name in ({', '.join(map(lit, names_))}) then {lit(kind)}" for kind, names_ in table.items()) + " end")


def python_dependencies(changes: Changes) -> DataFrame:
    """changeset_id, path, name, section, from_version, to_version, impact, risk_category of requirement lines."""
    major = lambda c: F.coalesce(F.nullif(F.regexp_extract(c, r"(\d+)", 1), F.lit("")).cast("int"), F.lit(0))
    a, b = F.col("from_version"), F.col("to_version")
    impact = F.when(b.isNull(), "removed").when(a.isNull(), "new").when((a == "") | (b == ""), "unknown").when(major(b) > major(a), "major").otherwise("minor")
    return _versions(changes.rows("requirement")).withColumn("impact", impact).withColumn("risk_category", _risky(RISKY_PYTHON))


def semver_impact(old: Column, new: Column) -> Column:
    """major, minor or patch by the parts that grew, each compared on its own; else unknown."""
    clean = lambda c: F.trim(F.regexp_replace(c, r"^[\^~>=<]+", ""))
    pattern = r"^v?(\d{1,9})\.(\d{1,9})\.(\d{1,9})(?:[-+][0-9A-Za-z.+-]+)?$"
    part = lambda c, i: F.nullif(F.regexp_extract(clean(c), pattern, i), F.lit("")).cast("int")
    return F.when(part(new, 1) > part(old, 1), "major").when(part(new, 2) > part(old, 2), "minor").when(part(new, 3) > part(old, 3), "patch").otherwise("unknown")


def node_dependencies(changes: Changes) -> DataFrame:
    """changeset_id, path, name, section, from_version, to_version, impact, risk_category of manifest lines."""
    a, b = F.col("from_version"), F.col("to_version")
    impact = F.when(b.isNull(), "removed").when(a.isNull(), "new").otherwise(semver_impact(a, b))
    lines = _versions(changes.rows("manifest-line"))
    return lines.where("from_version is null or to_version is null or from_version <> to_version").withColumn("impact", impact).withColumn("risk_category", _risky(RISKY_NODE))


# --- routes ---------------------------------------------------------------------------

# Route files by framework: path gate.
ROUTE_GATES = [
    ("kit", [r"^src/routes/(.*/)?\+(page|layout|server|error)[^/]*\.(svelte|ts)$"]),
    ("next", [r"^(src/)?app/(.*/)?(page|layout|template|default|loading|error|global-error|not-found|route)\.(ts|tsx|js|jsx)$", r"^(src/)?app/(.*/)?(opengraph-image|twitter-image|icon|apple-icon|sitemap|robots|manifest)\.(ts|tsx|js|jsx)$", r"^(src/)?app/(.*/)?(opengraph-image|twitter-image|icon|apple-icon)\.(png|jpg|jpeg|svg|gif|ico)$"]),
    ("next-root", [r"^(src/)?middleware\.(ts|tsx|js|jsx)$", r"^(src/)?instrumentation\.(ts|js)$"]),
    ("astro", [r"^src/pages/.+\.(astro|md|mdx|html|ts|js)$", r"^src/layouts/.+\.astro$", r"^src/content/.+\.(md|mdx|json|yaml|yml)$"]),
    ("nuxt", [r"^(app/)?pages/.+\.vue$", r"^server/(api|routes)/.+\.(ts|js|mjs)$"]),
]
ROUTE_TYPES = {
    "kit": [("page", [r"\+page\.(svelte|ts|server\.ts)$"]), ("layout", [r"\+layout\.(svelte|ts|server\.ts)$"]), ("endpoint", [r"\+server\.ts$"]), ("error", [r"\+error\.svelte$"])],
    "next": [("endpoint", [r"/route\.[a-z]+$"]), ("error", [r"/(error|global-error|not-found)\.[a-z]+$"]), ("page", [r"/page\.[a-z]+$"]), ("layout", [r"/layout\.[a-z]+$"]), ("template", [r"/template\.[a-z]+$"]), ("default", [r"/default\.[a-z]+$"]), ("loading", [r"/loading\.[a-z]+$"]), ("metadata", [r"/(opengraph-image|twitter-image|icon|apple-icon|sitemap|robots|manifest)\.[a-z]+$"])],
    "next-root": [("middleware", [r"middleware\."]), ("instrumentation", [r"instrumentation\."])],
    "astro": [("layout", [r"^src/layouts/"]), ("endpoint", [r"^src/pages/.*\.(ts|js)$"]), ("error", [r"404\.", r"500\."]), ("page", [r"."])],
    "nuxt": [("endpoint", [r"^server/"]), ("page", [r"."])],
}
METHOD_EXPORT = r"export\s+(?:async\s+)?(?:const|function)\s+(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\b"
# Rewriting steps from file paths to route ids, in order.
ROUTE_STEPS = {
    "kit": [(r"^src/routes", ""), (r"/[^/]*$", ""), (r"^$", "/")],
    "next": [(r"^(src/)?app", ""), (r"/[^/]*$", ""), (r"/\([^.)][^)]*\)", ""), (r"/@[^/]+", ""), (r"^$", "/")],
    "next-root": [(r"^(src/)?middleware\..*$", "/"), (r"^(src/)?instrumentation\..*$", "/instrumentation")],
    "astro": [(r"^src/content/", "/content/"), (r"^(src/layouts/.*)$", "$1"), (r"^src/pages(/.*)\.(astro|md|mdx|html|ts|js)$", "$1"), (r"/index$", ""), (r"\[\.\.\.(\w+)\]", ":$1*"), (r"\[(\w+)\]", ":$1"), (r"^$", "/")],
    "nuxt": [(r"^(?:app/)?pages", ""), (r"^server/api", "/api"), (r"^server/routes", ""), (r"\.(vue|ts|js|mjs)$", ""), (r"\.(get|post|put|patch|delete|head|options)$", ""), (r"/index$", ""), (r"\[\.\.\.(\w+)\]", ":$1*"), (r"\[\[?(\w+)\]?\]", ":$1"), (r"^$", "/")],
}


def route_id(path: Column, framework: str) -> Column:
    for pattern, to in ROUTE_STEPS[framework]:
        path = F.regexp_replace(path, pattern, to)
    return path


RULES["method"] = Rule([g for _, gates in ROUTE_GATES for g in gates], names("method", METHOD_EXPORT, 1))


def file_routes(files: DataFrame, changes: Changes) -> DataFrame:
    """changeset_id, path, framework, route_id, route_type, change, methods of file-based routes."""
    path = F.col("path")
    routed = files.withColumn("framework", P.first_of(path, ROUTE_GATES)).where("framework is not null")
    pick = lambda of: F.coalesce(*[F.when(F.col("framework") == k, of(k)) for k in ROUTE_STEPS])
    methods = changes.rows("method").groupBy("changeset_id", "path").agg(listed("name").alias("methods"))
    named = routed.select("changeset_id", "path", "framework", pick(lambda k: route_id(path, k)).alias("route_id"), pick(lambda k: P.first_of(path, ROUTE_TYPES[k], "unknown")).alias("route_type"), F.col("status").alias("change"))
    return named.join(methods, ["changeset_id", "path"], "left").withColumn("methods", F.when(F.col("route_type") == "endpoint", F.coalesce("methods", F.lit(""))).otherwise(""))


PYTHON_ROUTE_FILE = r"(^|/)[^/]*(routers?|endpoints?|api|main|app|routes?|urls|views?|__init__)\.py$"
FASTAPI_ROUTE = r"(?i)@\w+\.(get|post|put|patch|delete|head|options|api_route)\s*\(\s*[\"']([^\"']+)[\"']"
DJANGO_ROUTE = r"(?i)(?:path|re_path|url)\s*\(\s*(?:r)?[\"']([^\"']+)[\"']"
FLASK_ROUTE = r"(?i)@\w+\.route\s*\(\s*[\"']([^\"']+)[\"']"


# How the framework of a Python file is told, first match first: by its name or its lines.
PYTHON_FRAMEWORK = [
    ("path", r"urls\.py$", "django"),
    ("all_text", "from fastapi|import fastapi|APIRouter", "fastapi"),
    ("all_text", "from django|urlpatterns", "django"),
    ("all_text", r"from flask|Flask\(|Blueprint\(", "flask"),
    ("path", r"views\.py$", "django"),
    ("path", r"(routers?|endpoints?|api|main|app|routes?)\.py$", "fastapi"),
]
_FRAMEWORK_OF = "case " + " ".join(f"when {c} rlike {lit(p)} then '{k}'" for c, p, k in PYTHON_FRAMEWORK) + " else 'flask' end"
_ROUTES = {"fastapi": (FASTAPI_ROUTE, 2), "django": (DJANGO_ROUTE, 1), "flask": (FLASK_ROUTE, 1)}
RULES["python-route"] = Rule(
    [PYTHON_ROUTE_FILE],
    f"case {_FRAMEWORK_OF} " + " ".join(f"when '{k}' then concat({names('python-route', p, 1, k, g)}, {names('python-route', p, 2, k, g)})" for k, (p, g) in _ROUTES.items()) + " end",
)


def python_routes(changes: Changes) -> DataFrame:
    """changeset_id, path, framework, route_id, change: routes in added and deleted lines of Python files.

    The framework is read from each hunk; a route on both sides of a file is modified.
    """
    rows = changes.rows("python-route").select("changeset_id", "path", F.col("kind").alias("framework"), F.col("name").alias("route"), "side")
    django = F.regexp_replace(F.regexp_replace(F.regexp_replace("route", r"^\^", ""), r"\$$", ""), r"\(\?P<(\w+)>[^)]+\)", ":{$1}")
    plain = F.when(F.col("framework") == "django", django).otherwise(F.col("route"))
    rooted = F.when(plain.startswith("/"), plain).otherwise(F.concat(F.lit("/"), plain))
    id_ = F.when(rooted == "/", rooted).otherwise(F.regexp_replace(rooted, r"/$", ""))
    found = rows.withColumn("route_id", id_).groupBy("changeset_id", "path", "framework", "route_id").agg(F.bit_or("side").alias("sides"))
    return found.withColumn("change", F.when(F.col("sides") == 1, "added").when(F.col("sides") == 2, "deleted").otherwise("modified")).drop("sides")


# --- surfaces -----------------------------------------------------------------------------

# Named things found in added and deleted lines: gate, kind -> pattern with the name.
SURFACES = {
    "docker": (r"(?i)Dockerfile(\.[a-z0-9-]+)?$", {"base image": r"(?im)^\s*FROM\s+(\S+)"}),
    "trpc": (r"/routers/.+\.(ts|js)$|/trpc/.+\.(ts|js)$|_app\.(ts|js)$", {"query": r"(\w+)\s*:\s*\w*Procedure.*?\.query\s*\(", "mutation": r"(\w+)\s*:\s*\w*Procedure.*?\.mutation\s*\(", "subscription": r"(\w+)\s*:\s*\w*Procedure.*?\.subscription\s*\("}),
    "runes": (r"\.svelte$|\.svelte\.(ts|js)$", {"rune": r"(\$(?:state|derived|effect|props|bindable|inspect|host))\b"}),
    "websocket": (r"(?i)(socket|websocket|ws|realtime)[^/]*\.(ts|js|tsx|jsx)$", {"on": r"\.on\s*\(\s*[\"']([^\"']+)[\"']", "emit": r"\.emit\s*\(\s*[\"']([^\"']+)[\"']", "room": r"\.(?:join|leave|to|in)\s*\(\s*[\"']([^\"']+)[\"']"}),
    "i18n": (r"(?i)(^|/)(locales?|i18n|lang|translations?|messages)/.*\.(json|ya?ml)$", {"key": r"(?m)^\s*\"([^\"]+)\"\s*:\s*\""}),
    "css": (r"\.module\.(css|scss|sass|less)$|(?i)(theme|tokens|variables)[^/]*\.(css|scss|ts|js)$|(?i)(globals?|app|main|index|styles?)\.(css|scss|less)$", {"class": r"\.([a-zA-Z_-][\w-]*)\s*\{", "token": r"(--[\w-]+)\s*:"}),
    "query": (r"\.(ts|tsx|js|jsx|svelte|vue)$", {"hook": r"\b((?:use|create)(?:Query|InfiniteQuery|SuspenseQuery|Mutation|Queries))\s*\("}),
    "next-config": (r"^next\.config\.(js|mjs|cjs|ts)$", {"feature": r"\b(rewrites|redirects|headers|images|i18n|webpack|turbopack|experimental|output|basePath|env|serverActions|appDir|ppr|dynamicIO|serverExternalPackages|transpilePackages)\b"}),
}


RULES["surface"] = _by_gate("surface", SURFACES)


def surface_changes(changes: Changes) -> DataFrame:
    """changeset_id, path, surface, kind, name, change: named API surfaces added, removed or modified per file."""
    return _two_sides(changes.rows("surface"), "surface", "kind")


def surface_files(changes: Changes) -> DataFrame:
    """changeset_id, path, surface, names, told (name:kind:change:breaking), breaks: one row per file and surface.

    Removed names are breaking, for runes only state and props, for configuration features none.
    """
    breaks = F.expr("change = 'removed' and surface <> 'next-config' and (surface <> 'runes' or name in ('$state', '$props'))")
    told = F.concat_ws(":", "name", "kind", "change", breaks.cast("string"))
    return surface_changes(changes).groupBy("changeset_id", "path", "surface").agg(listed("name").alias("names"), listed(told).alias("told"), F.bool_or(breaks).alias("breaks"))


# Configuration files of Python projects by kind and category: names of files, first match.
PYTHON_CONFIGS = [
    ("pyproject:build", [r"(^|/)pyproject\.toml$"]), ("setup:build", [r"(^|/)setup\.cfg$", r"(^|/)setup\.py$"]), ("manifest:build", [r"(^|/)MANIFEST\.in$"]), ("tox:testing", [r"(^|/)tox\.ini$"]), ("pytest:testing", [r"(^|/)pytest\.ini$", r"(^|/)conftest\.py$"]),
    ("coverage:testing", [r"(^|/)\.coveragerc$"]), ("nox:testing", [r"(^|/)\.noxfile\.py$"]), ("mypy:typing", [r"(^|/)\.?mypy\.ini$"]), ("pyright:typing", [r"(^|/)pyrightconfig\.json$"]), ("flake8:linting", [r"(^|/)\.flake8$"]), ("pylint:linting", [r"(^|/)\.pylintrc$"]),
    ("ruff:linting", [r"(^|/)\.ruff\.toml$", r"(^|/)ruff\.toml$"]), ("isort:linting", [r"(^|/)\.isort\.cfg$"]), ("bandit:security", [r"(^|/)\.bandit$"]), ("black:formatting", [r"(^|/)\.?black$"]), ("editorconfig:formatting", [r"(^|/)\.editorconfig$"]),
    ("pre-commit:hooks", [r"(^|/)\.pre-commit-config\.yaml$"]), ("python-version:environment", [r"(^|/)\.python-version$"]), ("runtime:environment", [r"(^|/)runtime\.txt$"]),
]
# Reasons that make a change of pyproject breaking, looked for in added lines.
PYPROJECT_BREAKS = {
    "Python version constraint changed": r"(?i)python\s*=\s*[\"'][<>=!~]+\s*3\.",
    "requires-python changed": r"(?i)requires-python\s*=\s*[\"'][<>=!~]+",
    "Poetry dependencies section changed": r"(?i)\[tool\.poetry\.dependencies\]",
    "Project dependencies section changed": r"(?i)\[project\.dependencies\]",
    "Build system configuration changed": r"(?i)\[build-system\]",
    "CLI scripts changed": r"(?i)\[project\.scripts\]",
    "Entry points changed": r"(?i)\[project\.entry-points\]",
    "[project] section modified": r"\[project\]",
    "[tool.poetry] section modified": r"\[tool\.poetry\]",
    "[build-system] section modified": r"\[build-system\]",
    "[project.scripts] section modified": r"\[project\.scripts\]",
    "[project.entry-points] section modified": r"\[project\.entry-points\]",
    "[project.optional-dependencies] section modified": r"\[project\.optional-dependencies\]",
}
_PYTHON_CONFIG_GATES = [g for _, gates in PYTHON_CONFIGS for g in gates]
CONFIG_SECTION = r"(?m)^\s*\[([^\]\n]+)\]"
RULES["python-section"] = Rule(_PYTHON_CONFIG_GATES, names("python-section", CONFIG_SECTION, 1))
RULES["python-break"] = Rule([r"(^|/)pyproject\.toml$"], marks("python-break", PYPROJECT_BREAKS, 1))


def python_configs(files: DataFrame, changes: Changes) -> DataFrame:
    """changeset_id, path, status, config_type, config_category, sections, reasons, is_breaking of Python configuration files."""
    kinds = files.withColumn("kind", P.first_of(F.col("path"), PYTHON_CONFIGS)).where("kind is not null")
    found = changes.rows("python-section", "python-break").groupBy("changeset_id", "path").agg(listed(F.trim("name"), F.col("rule") == "python-section").alias("sections"), listed("name", F.col("rule") == "python-break").alias("reasons"))
    text = lambda c: F.coalesce(c, F.lit(""))
    return kinds.join(found, ["changeset_id", "path"], "left").select(
        "changeset_id", "path", "status", F.substring_index("kind", ":", 1).alias("config_type"), F.substring_index("kind", ":", -1).alias("config_category"), text("sections").alias("sections"), text("reasons").alias("reasons"), (text("reasons") != "").alias("is_breaking")
    )


RSC_PATH = r"(?:^|/)app/.*\.(ts|tsx|js|jsx)$|\.(server|client)\.(ts|tsx|js|jsx)$"
RSC_MARKS = {"use_server": "[\"']use server[\"']", "use_client": "[\"']use client[\"']", "server_only": "(?:import\\s+|from\\s+)[\"']server-only[\"']", "client_only": "(?:import\\s+|from\\s+)[\"']client-only[\"']"}


RULES["rsc"] = Rule([RSC_PATH], f"concat({marks('rsc', RSC_MARKS, 1)}, {marks('rsc', RSC_MARKS, 2)})")


def rsc_boundaries(changes: Changes) -> DataFrame:
    """changeset_id, path, from_directive, to_directive, boundary, reasons of files whose directives or imports change."""
    seen = changes.rows("rsc").groupBy("changeset_id", "path").agg(*[F.bool_or((F.col("side") == i) & (F.col("name") == m)).alias(f"{s}_{m}") for i, s in ((1, "add"), (2, "del")) for m in RSC_MARKS])
    c = F.col
    directive = lambda s: F.when(c(f"{s}_use_server"), "use server").when(c(f"{s}_use_client"), "use client").otherwise("")
    bound = lambda s: F.when(c(f"{s}_use_server") | c(f"{s}_server_only"), "server").when(c(f"{s}_use_client") | c(f"{s}_client_only"), "client")
    reasons = F.array_join(F.filter(F.array(
        F.when(~c("add_use_client") & c("del_use_client"), "Removed client directive"), F.when(~c("add_use_server") & c("del_use_server"), "Removed server directive"),
        F.when(c("add_server_only") & ~c("del_server_only"), "Added server-only import"), F.when(~c("add_client_only") & c("del_client_only"), "Removed client-only import"),
    ), lambda x: x.isNotNull()), "; ")
    some = bound("add").isNotNull() | bound("del").isNotNull()
    return seen.where(some).select("changeset_id", "path", directive("del").alias("from_directive"), directive("add").alias("to_directive"), F.coalesce(bound("add"), bound("del")).alias("boundary"), reasons.alias("reasons"))


CODE_FILE = r"\.(ts|tsx|js|jsx|mjs|cjs|svelte|vue|astro|py)$"


QUOTED_MODULE = r"[\"'](?:[^\"'\s]*/)?([\w.@-]+?)(?:\.(?:ts|tsx|js|jsx|mjs|cjs|svelte|vue|astro))?[\"']"
RULES["uses"] = Rule([CODE_FILE], names("uses", QUOTED_MODULE, 3))


def impact_radius(files: DataFrame, changes: Changes) -> DataFrame:
    """changeset_id, path, dependents, users (their paths), blast_radius of modified and renamed code files.

    A dependent is another file of the change set with a changed line that imports the
    file's base name (the last part of a quoted module path), found by an equi-join on
    that name. Radius: more than 10 high, more than 3 medium, else low.
    """
    base = lambda p: F.regexp_replace(P.file_name(p), r"\.[^.]*$", "")
    sources = files.where(F.col("status").isin("modified", "renamed") & F.col("path").rlike(CODE_FILE)).select("changeset_id", "path", base(F.col("path")).alias("name"))
    uses = changes.rows("uses").select("changeset_id", F.col("path").alias("user"), "name").distinct()
    counted = sources.join(uses, ["changeset_id", "name"]).where("user <> path").groupBy("changeset_id", "path").agg(F.count_distinct("user").alias("dependents"), listed("user").alias("users"))
    return counted.withColumn("blast_radius", F.when(F.col("dependents") > 10, "high").when(F.col("dependents") > 3, "medium").otherwise("low"))


# What the lines of a file hold that nested source text is read for, and path gates.
SOURCE_FILE = [r"\.(tsx|ts|jsx|js|mjs)$", r"(^|/)package\.json$", r"(?i)(^|/)(locales?|i18n|lang|translations?|messages)/.*\.json$"]
SOURCE_MARK = r"<Route\b|createBrowserRouter|createHashRouter|createMemoryRouter|useRoutes|:\s*Routes\b|@(?:Component|Directive|Injectable|NgModule|Pipe|Prop|Event|Method|State|Input|Output)\s*\(|\"exports\"\s*:|^\s*\{?\s*\""
RULES["source"] = Rule(SOURCE_FILE, marks("source", {"marked": SOURCE_MARK}, 3))


def source_sides(changes: Changes) -> DataFrame:
    """changeset_id, path, side, content: deleted (base) and added (head) lines of files with routes, decorators, exports or keys.

    Only files with such a mark are gathered, each by itself.
    """
    marked = changes.rows("source").select("changeset_id", "path").distinct()
    texts = semi_join(changes.texts().where(P.any_of(F.col("path"), SOURCE_FILE)), marked, ["changeset_id", "path"])
    each = texts.groupBy("changeset_id", "path").agg(F.array_sort(F.collect_set(F.struct("hunk_ord", "del_text", "add_text"))).alias("hunks"))
    joined = lambda c: F.array_join(F.filter(F.transform("hunks", lambda h: h[c]), lambda t: t != ""), "\n")
    sides = F.array(F.struct(F.lit("base").alias("side"), joined("del_text").alias("content")), F.struct(F.lit("head").alias("side"), joined("add_text").alias("content")))
    return each.select("changeset_id", "path", F.explode(sides).alias("s")).select("changeset_id", "path", "s.*")
