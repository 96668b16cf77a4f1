"""What a path says: category, security reason, exclusion, file kind; all as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordered rules (first match holds) from path patterns to categories.
CATEGORIES = [
    ("tests", [r"(?i)^tests?/", r"(?i)^__tests__/", r"(?i)/tests?/", r"(?i)/__tests__/", r"(?i)\.test\.[jt]sx?$", r"(?i)\.spec\.[jt]sx?$", r"(?i)\.e2e\.[jt]sx?$", r"(?i)vitest\.config", r"(?i)jest\.config", r"(?i)cypress/", r"(?i)playwright/"]),
    ("ci", [r"^\.github/workflows/", r"^\.github/actions/", r"^\.gitlab-ci\.yml$", r"^\.circleci/", r"^Jenkinsfile$", r"^\.travis\.yml$", r"^azure-pipelines\.yml$", r"^bitbucket-pipelines\.yml$"]),
    ("infra", [r"(?i)^Dockerfile", r"(?i)^docker-compose", r"^\.dockerignore$", r"(?i)^helm/", r"(?i)^charts?/", r"(?i)^terraform/", r"^\.tf$", r"(?i)^k8s/", r"(?i)^kubernetes/", r"(?i)^pulumi/", r"(?i)^ansible/", r"^Vagrantfile$"]),
    ("database", [r"^supabase/migrations/", r"^supabase/seed", r"^prisma/migrations/", r"^prisma/schema\.prisma$", r"^drizzle/migrations/", r"^drizzle\.config", r"(?i)^migrations?/", r"(?i)/migrations?/", r"(?i)\.sql$"]),
    ("docs", [r"(?i)^docs?/", r"(?i)^documentation/", r"(?i)\.md$", r"(?i)\.mdx$", r"(?i)^README", r"(?i)^CHANGELOG", r"(?i)^CONTRIBUTING", r"(?i)^LICENSE", r"^\.all-contributorsrc$"]),
    ("dependencies", [r"^package\.json$", r"^package-lock\.json$", r"^yarn\.lock$", r"^pnpm-lock\.yaml$", r"^bun\.lock$", r"^bun\.lockb$", r"^requirements\.txt$", r"^Pipfile(\.lock)?$", r"^poetry\.lock$", r"^pyproject\.toml$", r"^Cargo\.(toml|lock)$", r"^go\.(mod|sum)$", r"^Gemfile(\.lock)?$", r"^composer\.(json|lock)$"]),
    ("config", [r"(?i)^\.[a-z]+rc(\.json|\.js|\.cjs|\.mjs|\.yaml|\.yml)?$", r"(?i)\.config\.[jt]s$", r"(?i)\.config\.[a-z]+\.[jt]s$", r"(?i)^\.env", r"(?i)^wrangler\.(toml|json)$", r"(?i)^tsconfig.*\.json$", r"(?i)^\.eslintrc", r"(?i)^\.prettierrc", r"^\.editorconfig$", r"^\.gitignore$", r"^\.nvmrc$", r"^\.node-version$"]),
    ("artifacts", [r"(?i)\.(tgz|tar\.gz|zip|whl|jar|war|gem|nupkg|deb|rpm|dmg|exe|dll|so|dylib|a|o|wasm)$"]),
    ("product", [r"^src/", r"^lib/", r"^app/", r"^pages/", r"^components/", r"^hooks/", r"^utils/", r"^services/", r"^api/", r"^server/", r"^client/", r"\.[jt]sx?$", r"\.svelte$", r"\.vue$", r"\.astro$"]),
]
# Ordered reasons why a path is sensitive.
SECURITY = [
    ("auth-path", [r"(?i)\bauth\b", r"(?i)\blogin\b", r"(?i)\blogout\b", r"(?i)\bsignin\b", r"(?i)\bsignout\b", r"(?i)\bsignup\b", r"(?i)\bregister\b"]),
    ("session-path", [r"(?i)\bsession\b", r"(?i)\bjwt\b", r"(?i)\btoken\b", r"(?i)\bcookie\b", r"(?i)\boauth\b"]),
    ("permission-path", [r"(?i)\bpermission\b", r"(?i)\brbac\b", r"(?i)\bacl\b", r"(?i)\brole\b", r"(?i)\bauthoriz"]),
    ("middleware", [r"(?i)middleware\.[jt]sx?$", r"/middleware/"]),
    ("guard", [r"(?i)guard\.[jt]sx?$", r"/guards?/"]),
    ("policy", [r"(?i)policy\.[jt]sx?$", r"/policies/"]),
]
# What a reader is told of each reason.
SECURITY_LABELS = {"auth-path": "Authentication", "session-path": "Session/Token", "permission-path": "Permissions/RBAC", "middleware": "Middleware", "guard": "Route Guard", "policy": "Policy"}
# Paths of build output.
EXCLUDED = [r"^dist/", r"^build/", r"^\.next/", r"^\.svelte-kit/", r"^\.nuxt/", r"^out/", r"^node_modules/", r"^vendor/", r"\.map$", r"\.d\.ts$", r"\.min\.(js|css)$", r"^\.cache/", r"^\.parcel-cache/"]
# Reasons to skip a path.
SKIP = [
    ("lockfile", [r"^(pnpm-lock\.yaml|package-lock\.json|yarn\.lock|bun\.lockb)$"]),
    ("generated file", [r"\.d\.ts$"]),
    ("log file", [r"\.log$"]),
    ("build artifact", [r"dist/", r"build/", r"coverage/", r"\.turbo/", r"\.next/", r"out/", r"\.cache/"]),
]
# Globs left out unless asked for.
DEFAULT_GLOBS = ["**/pnpm-lock.yaml", "**/package-lock.json", "**/yarn.lock", "**/bun.lock", "**/bun.lockb", "**/*.d.ts", "**/*.log", "**/*.logs", "**/dist/**", "**/build/**", "**/.svelte-kit/**", "**/.next/**", "**/.turbo/**", "**/coverage/**", "**/.cache/**", "**/*.min.*", "**/*.map"]
# Extensions of binary files.
BINARY = ["png", "jpg", "jpeg", "gif", "webp", "ico", "svg", "woff", "woff2", "ttf", "eot", "otf", "zip", "tar", "gz", "tgz", "rar", "pdf", "doc", "docx", "xls", "xlsx", "exe", "dll", "so", "dylib", "mp3", "mp4", "wav", "avi", "mov", "lockb"]
# Kinds of infrastructure files, first match.
INFRA = [("dockerfile", [r"(?i)dockerfile"]), ("terraform", [r"\.tf$", r"\.tfvars$"]), ("k8s", [r"kubernetes/", r"k8s/", r"(?:deployment|service|ingress).*\.yaml$"])]
# Paths of API contracts.
API_CONTRACT = [r"openapi", r"swagger", r"\.proto$", r"/api/.*\.(?:yaml|yml|json)$"]
# Test files.
TEST_FILE = [r"\.test\.ts$", r"\.spec\.ts$", r"\.test\.js$", r"\.spec\.js$", r"^tests?/"]
# Test configuration.
TEST_CONFIG = [r"^vitest\.config(\.[a-z0-9]+)?\.(ts|js|mts|mjs)$", r"^vite\.config(\.[a-z0-9]+)?\.(ts|js|mts|mjs)$"]
# Files with migrations.
MIGRATION_FILE = [r"/migrations/", r"/migrate/", r"\.sql$"]
# Pipeline files.
CI_FILE = [r"\.github/workflows/.*\.ya?ml$", r"^\.gitlab-ci\.yml$", r"^Jenkinsfile$", r"^azure-pipelines\.yml$"]


def one_pattern(patterns: list[str]) -> str:
    """One pattern that matches where any of several does."""
    return "|".join(f"(?:{p})" for p in patterns)


def any_of(text: Column, patterns: list[str]) -> Column:
    return text.rlike(one_pattern(patterns)) if patterns else F.lit(False)


def first_of(text: Column, rules: list[tuple[str, list[str]]], otherwise: str | None = None) -> Column:
    """The name of the first rule with a matching pattern."""
    out = F.when(any_of(text, rules[0][1]), rules[0][0])
    for name, patterns in rules[1:]:
        out = out.when(any_of(text, patterns), name)
    return out.otherwise(F.lit(otherwise))


def category(path: Column) -> Column:
    return first_of(path, CATEGORIES, "other")


def security_reason(path: Column) -> Column:
    return first_of(path, SECURITY)


def is_excluded(path: Column) -> Column:
    return any_of(path, EXCLUDED)


def skip_reason(path: Column) -> Column:
    return first_of(path, SKIP)


def is_binary_path(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1)).isin(*BINARY)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def glob_regex(glob: str) -> str:
    """A path glob (**, *, ?, [..], {a,b}; dot files match) as an anchored regular expression."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in glob[i + 1 :]:
            end = glob.index("]", i + 1)
            inner = glob[i + 1 : end]
            out += "[" + ("^" + inner[1:] if inner[:1] in ("!", "^") else inner) + "]"
            i = end
        elif c == "{" and "}" in glob[i:]:
            end = glob.index("}", i)
            out += "(?:" + "|".join(glob_regex(g)[1:-1] for g in glob[i + 1 : end].split(",")) + ")"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def path_decision(path: Column, include: list[str] | None = None, exclude: list[str] | None = None, default_exclude: list[str] = DEFAULT_GLOBS) -> Column:
    """keep, or why a path is left out: excluded-by-glob, not-included or excluded-by-default.

    A match of include keeps a path whatever the defaults say; exclude is stronger.
    """
    globs = lambda gs: any_of(path, [glob_regex(g) for g in gs])
    out = F.when(globs(exclude or []), "excluded-by-glob")
    if include:
        return out.when(globs(include), "keep").otherwise("not-included")
    return out.when(globs(default_exclude), "excluded-by-default").otherwise("keep")


# Globs that a findings run reports as left out by default.
FACTS_GLOBS = [
    "**/*.d.ts", "**/*.map", "**/*.min.js", "**/*.min.css", "**/node_modules/**", "**/dist/**", "**/build/**", "**/.next/**", "**/.svelte-kit/**", "**/.nuxt/**", "**/out/**", "**/.cache/**", "**/.parcel-cache/**", "**/vendor/**", "**/*.log",
    "**/package-lock.json", "**/yarn.lock", "**/pnpm-lock.yaml", "**/bun.lock", "**/*.tgz", "**/*.tar.gz", "**/*.zip",
]
