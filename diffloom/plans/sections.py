"""Sections of the Markdown description: one per kind of finding, in a fixed order, with bounded lists and what is left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Sections in their order: title, finding types, what a line says (an expression over a finding's columns).
SECTIONS = [
    ("Risk", ["risk-flag"], "concat('**', risk, '**: ', name)"), ("Database migrations", ["db-migration", "python-migration"], "concat_ws(' ', name, '(' || risk || ')', nullif(detail, ''))"), ("SQL risks", ["sql-risk"], "concat('`', file, '`: ', risk)"),
    ("CI workflows", ["ci-workflow"], "concat('`', file, '`: ', risk)"), ("Routes / API", ["route-change"], "concat('`', name, '` ', detail, ' ', change)"), ("API contracts", ["api-contract-change"], "replace(detail, ',', ', ')"), ("GraphQL", ["graphql-change"], "concat_ws(' ', concat('`', file, '`:'), detail)"),
    ("Config / Env", ["env-var"], "concat('`', name, '` in ', replace(detail, ',', ', '))"), ("Cloudflare", ["cloudflare-change"], "concat(name, ': ', replace(detail, ',', ', '))"), ("Dependencies", ["dependency-change"], "concat_ws(' ', concat('`', name, '`'), change, '(' || detail || ')')"),
    ("Lockfile", ["lockfile-mismatch"], "case when name = 'true' then 'Manifest changed but lockfile not updated' else 'Lockfile changed but manifest not updated' end"), ("Security-sensitive files", ["security-file"], "replace(detail, ',', ', ')"), ("Infrastructure", ["infra-change"], "concat(name, ': ', replace(detail, ',', ', '))"),
    ("Docker", ["docker-change"], "concat_ws(' ', concat('`', file, '`'), risk, nullif(detail, ''))"), ("Impact", ["impact-analysis"], "concat('`', file, '`: ', cast(n_files as string), ' dependent file(s), ', risk, ' blast radius')"), ("Tests", ["test-change"], "concat(cast(n_files as string), ' test file(s): ', replace(detail, ',', ', '))"),
    ("Missing tests", ["convention-violation"], "concat(cast(n_files as string), ' file(s)')"), ("TypeScript config", ["typescript-config"], "concat_ws(' ', concat('`', file, '`:'), detail)"), ("Tailwind config", ["tailwind-config"], "concat_ws(' ', concat('`', file, '`'), risk, nullif(detail, ''))"),
    ("Vite config", ["vite-config"], "concat_ws(' ', concat('`', file, '`'), risk, nullif(detail, ''))"), ("Monorepo", ["monorepo-config"], "concat_ws(' ', name, nullif(detail, ''))"), ("Turborepo", ["turborepo-config"], "concat_ws(' ', concat('`', file, '`'), risk, nullif(detail, ''))"), ("Next.js config", ["next-config-change"], "concat('`', file, '`: ', replace(detail, ',', ', '))"),
    ("Python config", ["python-config"], "concat_ws(' ', concat('`', file, '`'), concat('(', name, ')'), nullif(detail, ''))"), ("Linters", ["linter-config"], "concat_ws(' ', name, risk, nullif(detail, ''))"), ("Jest", ["jest-config"], "concat_ws(' ', concat('`', file, '`'), risk, nullif(detail, ''))"),
    ("Playwright", ["playwright-config"], "concat_ws(' ', concat('`', file, '`'), risk, nullif(detail, ''))"), ("Cypress", ["cypress-config"], "concat_ws(' ', concat('`', file, '`'), risk, nullif(detail, ''))"), ("Prisma schema", ["prisma-schema"], "concat_ws(' ', concat('`', file, '`:'), detail)"), ("Drizzle schema", ["drizzle-schema"], "concat_ws(' ', concat('`', file, '`:'), detail)"),
    ("Package exports", ["package-exports"], "concat_ws(' ', concat('`', file, '`:'), detail)"), ("Stencil components", ["stencil-component-change", "stencil-prop-change", "stencil-event-change", "stencil-method-change", "stencil-slot-change"], "concat('`', name, '` ', change)"), ("Angular components", ["angular-component-change"], "concat('`', name, '` ', detail, ' ', change)"),
    ("tRPC routers", ["trpc-router"], "concat_ws(' ', concat('`', file, '`:'), detail)"), ("Queries", ["tanstack-query"], "concat_ws(' ', concat('`', file, '`:'), detail)"), ("Svelte runes", ["svelte5-runes"], "concat_ws(' ', concat('`', file, '`:'), detail)"), ("Server and client boundaries", ["rsc-boundary"], "concat_ws(' ', concat('`', file, '`'), name, nullif(detail, ''))"),
    ("Websockets", ["websocket-change"], "concat_ws(' ', concat('`', file, '`:'), detail)"), ("Translations", ["i18n-change"], "concat_ws(' ', concat('`', file, '`:'), detail)"), ("Styles", ["css-change"], "concat_ws(' ', concat('`', file, '`:'), detail)"), ("Large diff", ["large-diff"], "concat(cast(n_files as string), ' files, ', detail, ' lines')"),
]
SECTION_OF = "case " + " ".join(f"when type in ({', '.join(repr(t) for t in types)}) then {i}" for i, (_, types, _) in enumerate(SECTIONS)) + " end"
LINE_OF = f"case {SECTION_OF} " + " ".join(f"when {i} then {line}" for i, (*_, line) in enumerate(SECTIONS)) + " end"
TITLE_OF = "case section " + " ".join(f"when {i} then '{title}'" for i, (title, *_) in enumerate(SECTIONS)) + " end"


def section_lines(found: DataFrame, k: int = 10) -> DataFrame:
    """changeset_id, section, title, place, line: the first k lines of every section, and how many more there are as line k + 1."""
    rows = found.selectExpr("changeset_id", "finding_id", f"{SECTION_OF} as section", f"coalesce({LINE_OF}, '') as line").where("section is not null").distinct()
    place = F.row_number().over(Window.partitionBy("changeset_id", "section").orderBy("line", "finding_id"))
    n = F.count("*").over(Window.partitionBy("changeset_id", "section"))
    numbered = rows.withColumn("place", place).withColumn("n", n).where(F.col("place") <= k + 1)
    more = F.concat(F.lit("(+"), (F.col("n") - k).cast("string"), F.lit(" more)"))
    told = numbered.withColumn("line", F.when(F.col("place") > k, more).otherwise(F.col("line")))
    return told.selectExpr("changeset_id", "section", f"{TITLE_OF} as title", "place", "line")


def section_texts(lines: DataFrame) -> DataFrame:
    """changeset_id, text: all sections of a change set as Markdown; at most some hundred lines are gathered."""
    body = lines.groupBy("changeset_id", "section", "title").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("l"))
    text = F.concat(F.lit("## "), "title", F.lit("\n\n- "), F.array_join(F.transform("l", lambda x: x["line"]), "\n- "))
    return body.groupBy("changeset_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", text.alias("t")))), lambda x: x["t"]), "\n\n").alias("text"))
