"""Profiles: which analyzers a project of a kind is looked at with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAIL = ["large-diff", "lockfiles", "sql-risks", "ci-workflows", "infra", "api-contracts"]
# Analyzers of each profile in their order.
PROFILE_ANALYZERS = {
    "angular": ["file-summary", "file-category", "angular-routes", "angular-components", "env-var", "cloudflare", "vitest", "dependencies", "security-files", "impact", "tailwind", "typescript-config", "graphql", *_TAIL],
    "astro": ["file-summary", "file-category", "astro-routes", "env-var", "cloudflare", "vitest", "dependencies", "security-files", "impact", "tailwind", "typescript-config", *_TAIL, "drizzle"],
    "auto": ["file-summary", "file-category", "env-var", "cloudflare", "vitest", "dependencies", "security-files", "impact", "graphql", *_TAIL, "prisma", "jest", "linter-config", "playwright", "docker", "turborepo", "drizzle"],
    "library": ["file-summary", "file-category", "package-exports", "typescript-config", "dependencies", "vitest", "impact", "monorepo", "large-diff", "lockfiles", "ci-workflows", "api-contracts", "drizzle"],
    "next": ["file-summary", "file-category", "next-routes", "env-var", "cloudflare", "vitest", "dependencies", "security-files", "impact", "tailwind", *_TAIL, "drizzle", "tanstack-query", "trpc-router", "rsc-boundary"],
    "python": ["file-summary", "file-category", "python-dependencies", "python-routes", "python-migrations", "python-config", "env-var", "security-files", "impact", *_TAIL],
    "react": ["file-summary", "file-category", "react-router-routes", "env-var", "cloudflare", "vitest", "dependencies", "security-files", "impact", "tailwind", "typescript-config", *_TAIL, "drizzle", "tanstack-query", "trpc-router"],
    "stencil": ["file-summary", "file-category", "stencil", "env-var", "cloudflare", "vitest", "dependencies", "security-files", "impact", "typescript-config", *_TAIL],
    "sveltekit": ["file-summary", "file-category", "route-detector", "supabase", "env-var", "cloudflare", "vitest", "dependencies", "security-files", "impact", "tailwind", *_TAIL, "drizzle", "svelte5-runes", "trpc-router"],
    "vite": ["file-summary", "file-category", "env-var", "cloudflare", "vitest", "dependencies", "security-files", "impact", "vite-config", "tailwind", "typescript-config", *_TAIL, "drizzle"],
    "vue": ["file-summary", "file-category", "vue-routes", "env-var", "cloudflare", "vitest", "dependencies", "security-files", "impact", "tailwind", "typescript-config", *_TAIL, "drizzle", "trpc-router"],
}
# Finding types of each analyzer that has other ones than its own name.
ANALYZER_TYPES = {
    "cloudflare": ["cloudflare-change"], "vitest": ["test-change"], "dependencies": ["dependency-change"], "python-dependencies": ["dependency-change"], "security-files": ["security-file"], "impact": ["impact-analysis"], "lockfiles": ["lockfile-mismatch"],
    "sql-risks": ["sql-risk"], "ci-workflows": ["ci-workflow"], "infra": ["infra-change"], "api-contracts": ["api-contract-change"], "supabase": ["db-migration"], "graphql": ["graphql-change"], "prisma": ["prisma-schema"], "drizzle": ["drizzle-schema"],
    "jest": ["jest-config"], "playwright": ["playwright-config"], "docker": ["docker-change"], "turborepo": ["turborepo-config"], "tailwind": ["tailwind-config"], "monorepo": ["monorepo-config"], "python-migrations": ["python-migration"],
    "angular-routes": ["route-change"], "astro-routes": ["route-change"], "next-routes": ["route-change", "next-config-change"], "python-routes": ["route-change"], "react-router-routes": ["route-change"], "route-detector": ["route-change"], "vue-routes": ["route-change"],
    "angular-components": ["angular-component-change"], "stencil": ["stencil-component-change", "stencil-prop-change", "stencil-event-change", "stencil-method-change", "stencil-slot-change"],
}
#: Analyzers that raise risk flags, with the category of these.
FLAG_CATEGORIES = {"security-files": "infra", "dependencies": "dependencies", "supabase": "database", "python-migrations": "database"}


def registry() -> list[tuple[str, int, str, str, str | None]]:
    """(profile, place, analyzer, finding type, category of the type where only that one counts)."""
    rows = []
    for profile, analyzers in PROFILE_ANALYZERS.items():
        for place, analyzer in enumerate(analyzers):
            rows += [(profile, place, analyzer, t, None) for t in ANALYZER_TYPES.get(analyzer, [analyzer])]
            if analyzer in FLAG_CATEGORIES:
                rows.append((profile, place, analyzer, "risk-flag", FLAG_CATEGORIES[analyzer]))
    return rows


def profile_findings(found: DataFrame, profiles: DataFrame) -> DataFrame:
    """Findings that the analyzers of their change set's profile make, with profile and place of the first such analyzer.

    profiles: changeset_id, profile. The registry is a table of some two hundred fixed rows.
    """
    table = found.sparkSession.createDataFrame(registry(), "profile string, place int, analyzer string, type string, only string")
    joined = found.join(profiles.select("changeset_id", "profile"), "changeset_id").join(F.broadcast(table), ["profile", "type"]).where("only is null or only = category")
    return joined.groupBy(*found.columns, "profile").agg(F.min("place").alias("place"))
