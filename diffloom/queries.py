"""Registered queries of the core operators, and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from diffloom.functions import text as T
from diffloom.functions.code_reader import source_changes
from diffloom.operators import analyzers as A
from diffloom.operators import deltas as DL
from diffloom.operators import evidence as E
from diffloom.operators import identity as I
from diffloom.operators import paths as P
from diffloom.operators import scoring as S
from diffloom.operators.chunks import chunk_by_budget
from diffloom.operators.config_rules import RULES, config_findings, config_sql
from diffloom.operators.nested_tables import flat_children, linked_results, node_table, typed_tables
from diffloom.operators.snapshot_delta import relative_path, snapshot_changes
from diffloom.oracle import any_sql, first_sql, prelude, q
from diffloom.plans import documents as D
from diffloom.plans import dumpdiff as DD
from diffloom.plans import profiles as PR
from diffloom.plans import sections as SE
from diffloom.plans import reports as R
from diffloom import report_sql as RS
from diffloom.operators.labels import Changes, listed_files
from diffloom.runtime import cut_lineage, table
from diffloom.sources import changesets as C

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
RuleQuery = Callable[[Changes], DataFrame]
#: Queries over change sets with their SQL over the views allf and chg.
RULE_QUERIES: dict[str, tuple[RuleQuery, str | None]] = {}


def _register(name: str, sql: str | None = None, with_prelude: bool = True):
    def add(query: Query) -> Query:
        _QUERIES[name] = query
        if sql is not None:
            _SQL[name] = (prelude() + "\n" if with_prelude else "") + sql
        return query

    return add


def _rule(name: str, sql: str | None = None):
    """A query over the files and hunks of change sets; the checks subpackage runs the same over made-up hunks."""

    def add(query: RuleQuery) -> RuleQuery:
        RULE_QUERIES[name] = (query, sql)
        _QUERIES[name] = lambda s, d: query(A.changes_of(table(s, d, "files"), table(s, d, "hunks")))
        if sql is not None:
            _SQL[name] = prelude() + "\n" + sql
        return query

    return add


def _findings(changes: Changes) -> DataFrame:
    """Findings of all analyzers from one pass over the hunks; they are few and are written as a table for what reads them."""
    kept = changes.keep()
    return cut_lineage(S.findings(kept.files, kept, source_changes(A.source_sides(changes)) if changes.with_sources else None))


def _hunks(s: SparkSession, d: str) -> DataFrame:
    return C.change_hunks(table(s, d, "hunks"))


# --- problems 2 and 4 ----------------------------------------------------------------


@_register("p2_found")
def p2_found(s: SparkSession, d: str) -> DataFrame:
    return snapshot_changes(table(s, d, "facts_runs"), table(s, d, "facts_findings")).select("facts_path", "finding_id", "change_kind").distinct()


@_register("p4_found")
def p4_found(s: SparkSession, d: str) -> DataFrame:
    return flat_children(table(s, d, "sarif_logs"))


@_register("p4_nodes")
def p4_nodes(s: SparkSession, d: str) -> DataFrame:
    return linked_results(node_table(table(s, d, "sarif_logs"), ("run", "result", "location", "fingerprint"))).drop("fields")


def _typed(kind: str):
    return lambda s, d: typed_tables(table(s, d, "sarif_logs"))[kind]


for _kind in ("run", "result", "location", "fingerprint"):
    _register(f"p4_{_kind}s")(_typed(_kind))


# --- sources ----------------------------------------------------------------------------


@_register("change_files", "select changeset_id, path, ord, status, old_path from files_c")
def change_files(s: SparkSession, d: str) -> DataFrame:
    return C.change_files(table(s, d, "files"))


@_register(
    "parse_name_status",
    """select changeset_id, status, path, old_path from (select changeset_id, coalesce(status, 'modified') as status, path, case when status = 'renamed' then coalesce(old_path, path) end as old_path from files_c)""",
)
def parse_name_status(s: SparkSession, d: str) -> DataFrame:
    f = C.change_files(table(s, d, "files"))
    code = F.upper(F.substring(F.coalesce("status", F.lit("m")), 1, 1))
    text = F.when(code == "R", F.concat_ws("\t", F.lit("R087"), F.coalesce("old_path", "path"), "path")).otherwise(F.concat_ws("\t", code, "path"))
    return C.parse_name_status(f.select("changeset_id", F.col("ord").alias("line_no"), text.alias("text"))).drop("line_no")


@_register(
    "parse_num_stat",
    f"""select changeset_id, path, case when bin then 0 else n_add end as added, case when bin then 0 else n_del end as removed, bin as is_binary from (
        select changeset_id, path, list_contains({[*P.BINARY]!r}, lower(regexp_extract(path, '\\.([^./]*)$', 1))) as bin, sum(len(additions))::int as n_add, sum(len(deletions))::int as n_del
        from hunks_c group by changeset_id, path)""",
)
def parse_num_stat(s: SparkSession, d: str) -> DataFrame:
    stats = C.change_stats(_hunks(s, d))
    count = lambda c: F.when(P.is_binary_path(F.col("path")), "-").otherwise(F.col(c).cast("string"))
    return C.parse_num_stat(stats.select("changeset_id", F.concat_ws("\t", count("additions"), count("deletions"), "path").alias("text")))


_HEADER = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def _header_sql(text: str) -> str:
    names = ("old_start", "old_lines", "new_start", "new_lines")
    part = lambda i, n: f"case when regexp_matches({text}, {q(_HEADER)}) then coalesce(nullif(regexp_extract({text}, {q(_HEADER)}, {i}), ''), '1') end::int as {n}"
    return ", ".join(part(i + 1, n) for i, n in enumerate(names))


@_register("parse_hunk_header", f"select hunk_id, {_header_sql('h')} from (select hunk_id, split_part(content, chr(10), 1) as h from hunks_c where content is not null)")
def parse_hunk_header(s: SparkSession, d: str) -> DataFrame:
    return _hunks(s, d).where("content is not null").select("hunk_id", *C.hunk_header(F.element_at(F.split("content", "\n", 2), 1)))


@_register(
    "parse_hunk_body",
    f"""select changeset_id, path, hunk_ord, (row_number() over w - 1)::int as line_ord, kind,
        case when kind <> 'add' then old_start + coalesce(sum((kind in ('del', 'ctx'))::int) over b, 0) end::int as old_no,
        case when kind <> 'del' then new_start + coalesce(sum((kind in ('add', 'ctx'))::int) over b, 0) end::int as new_no, substr(raw, 2) as text
        from (select *, case when left(raw, 1) = '+' then 'add' when left(raw, 1) = '-' then 'del' when left(raw, 1) in (' ', '') then 'ctx' end as kind from (
            select changeset_id, path, hunk_ord, {_header_sql('ls[1]')}, unnest(ls) as raw, unnest(range(len(ls))) as pos
            from (select changeset_id, path, hunk_ord, string_split(content, chr(10)) as ls from hunks_c where contains(content, chr(10)))) where pos > 0)
        where kind is not null
        window w as (partition by changeset_id, path, hunk_ord order by pos), b as (partition by changeset_id, path, hunk_ord order by pos rows between unbounded preceding and 1 preceding)""",
)
def parse_hunk_body(s: SparkSession, d: str) -> DataFrame:
    return C.hunk_body(_hunks(s, d))


@_register("untracked_hunks", "select 'doc-' || doc_id as changeset_id, 'file.txt' as path, 0 as hunk_ord, len(string_split(text, chr(10)))::int as new_lines, len(string_split(text, chr(10)))::int as n_additions from documents where text is not null", False)
def untracked_hunks(s: SparkSession, d: str) -> DataFrame:
    """Every document read as a new file."""
    texts = table(s, d, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("changeset_id"), F.lit("file.txt").alias("path"), F.col("text").alias("content"))
    return C.untracked_hunks(texts).select("changeset_id", "path", "hunk_ord", "new_lines", F.size("additions").alias("n_additions"))


@_register(
    "status_overlay",
    """select h.changeset_id, h.path, h.hunk_ord, coalesce(f.status, case when h.old_lines = 0 then 'added' when h.new_lines = 0 then 'deleted' else 'modified' end) as status
        from hunks_c h left join files_c f on h.changeset_id = f.changeset_id and h.path = f.path""",
)
def status_overlay(s: SparkSession, d: str) -> DataFrame:
    return C.with_status(_hunks(s, d), C.change_files(table(s, d, "files"))).select("changeset_id", "path", "hunk_ord", "status")


@_register("change_stats", "select changeset_id, path, count(*) as hunks, sum(len(additions))::bigint as additions, sum(len(deletions))::bigint as deletions from hunks_c group by changeset_id, path")
def change_stats(s: SparkSession, d: str) -> DataFrame:
    return C.change_stats(_hunks(s, d))


_LINES = "(select distinct changeset_id, path, hunk_ord, line_ord, kind, old_no, new_no, coalesce(text, '') as text from diff_lines)"


def _lines(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "diff_lines").dropDuplicates(["changeset_id", "path", "hunk_ord", "line_ord"]).withColumn("text", F.coalesce("text", F.lit("")))


@_register("diff_stats", f"select changeset_id, count(distinct path) as files, count(*) filter (where kind = 'add') as additions, count(*) filter (where kind = 'del') as deletions from {_LINES} group by changeset_id")
def diff_stats(s: SparkSession, d: str) -> DataFrame:
    return _lines(s, d).groupBy("changeset_id").agg(F.count_distinct("path").alias("files"), F.count_if(F.col("kind") == "add").alias("additions"), F.count_if(F.col("kind") == "del").alias("deletions"))


@_register("additions_with_line_no", f"select changeset_id, path, new_no as line, text from {_LINES} where kind = 'add'")
def additions_with_line_no(s: SparkSession, d: str) -> DataFrame:
    return _lines(s, d).where("kind = 'add'").select("changeset_id", "path", F.col("new_no").alias("line"), "text")


@_register("match_with_line_no", f"select changeset_id, path, new_no as line, unnest(regexp_extract_all(text, '[A-Z][A-Z0-9]+_[A-Z0-9_]+')) as match from {_LINES} where kind = 'add'")
def match_with_line_no(s: SparkSession, d: str) -> DataFrame:
    return _lines(s, d).where("kind = 'add'").select("changeset_id", "path", F.col("new_no").alias("line"), F.explode(F.regexp_extract_all("text", F.lit("[A-Z][A-Z0-9]+_[A-Z0-9_]+"), F.lit(0))).alias("match"))


# --- paths -----------------------------------------------------------------------------

_GLOBS = [P.glob_regex(g) for g in P.DEFAULT_GLOBS]
_USER_EXCLUDE = ["docs/**", "**/*.svelte"]


@_rule(
    "glob_filter",
    f"select changeset_id, path, case when {any_sql('path', [P.glob_regex(g) for g in _USER_EXCLUDE])} then 'excluded-by-glob' when {any_sql('path', _GLOBS)} then 'excluded-by-default' else 'keep' end as decision from allf",
)
def glob_filter(changes: Changes) -> DataFrame:
    return changes.files.select("changeset_id", "path", P.path_decision(F.col("path"), exclude=_USER_EXCLUDE).alias("decision"))


@_rule("exclude_filter", f"select changeset_id, path from allf where not {any_sql('path', P.EXCLUDED)}")
def exclude_filter(changes: Changes) -> DataFrame:
    return changes.files.where(~P.is_excluded(F.col("path"))).select("changeset_id", "path")


@_rule("skip_reasons", f"select changeset_id, path, {first_sql('path', P.SKIP)} as reason from allf where {first_sql('path', P.SKIP)} is not null")
def skip_reasons(changes: Changes) -> DataFrame:
    return changes.files.select("changeset_id", "path", P.skip_reason(F.col("path")).alias("reason")).where("reason is not null")


@_rule("binary_files", f"select changeset_id, path from allf where list_contains({[*P.BINARY]!r}, lower(regexp_extract(path, '\\.([^./]*)$', 1)))")
def binary_files(changes: Changes) -> DataFrame:
    return changes.files.where(P.is_binary_path(F.col("path"))).select("changeset_id", "path")


@_rule("file_category", f"select changeset_id, path, {first_sql('path', P.CATEGORIES, 'other')} as category from allf")
def file_category(changes: Changes) -> DataFrame:
    return changes.files.select("changeset_id", "path", P.category(F.col("path")).alias("category"))


@_rule("category_counts", f"select changeset_id, {first_sql('path', P.CATEGORIES, 'other')} as category, count(*) as files from allf group by 1, 2")
def category_counts(changes: Changes) -> DataFrame:
    return A.file_categories(changes.files)


# --- text ---------------------------------------------------------------------------------


def _redact_line_sql(text: str) -> str:
    out = f"regexp_replace({text}, '(ghp_[a-zA-Z0-9]{{36}}|github_pat_[a-zA-Z0-9_]+)', '<redacted-github-token>', 'g')"
    for key in T.SECRET_KEYS:
        for pattern, to in ((rf"(?i)({key})\s*=\s*['\"]?([^'\"\s}}<]+)['\"]?", r"\1=<redacted>"), (rf"(?i)({key})\s*:\s*['\"]?([^'\"\s,}}<]+)['\"]?", r"\1: <redacted>")):
            out = f"regexp_replace({out}, {q(pattern)}, {q(to)}, 'g')"
    return out


@_register("redact_line", f"""select changeset_id, path, hunk_ord, line_ord, case when contains(t, '<redacted') or contains(t, 'hash') or contains(t, 'checksum') then t else regexp_replace(t, '\\b[a-zA-Z0-9+/=]{{32,}}\\b', '<redacted-value>', 'g') end as text
    from (select changeset_id, path, hunk_ord, line_ord, {_redact_line_sql('text')} as t from {_LINES})""")
def redact_line(s: SparkSession, d: str) -> DataFrame:
    return _lines(s, d).select("changeset_id", "path", "hunk_ord", "line_ord", T.redact_line(F.col("text")).alias("text"))


@_register("redact_secrets")
def redact_secrets(s: SparkSession, d: str) -> DataFrame:
    items = table(s, d, "facts_findings").select("row_id", F.posexplode("evidence").alias("item", "e"))
    return items.select("row_id", "item", T.redact_secrets(F.col("e.excerpt")).alias("excerpt"))


_TRIMMED = "list_transform(additions, lambda x: regexp_replace(x, '^[\\s\\x{00A0}\\x{2003}]+|[\\s\\x{00A0}\\x{2003}]+$', '', 'g'))"


@_register(
    "representative_excerpt",
    f"""select hunk_id, case when length(e) <= 200 then e else left(e, 197) || '...' end as excerpt from (select hunk_id, case when len(t) = 0 then '' else
        coalesce(list_filter(t, lambda x: x <> '' and not starts_with(x, '//') and not starts_with(x, '/*') and not starts_with(x, '*') and not starts_with(x, '#'))[1], t[1]) end as e
        from (select hunk_id, {_TRIMMED} as t from hunks_c))""",
)
def representative_excerpt(s: SparkSession, d: str) -> DataFrame:
    return _hunks(s, d).select("hunk_id", T.representative_excerpt(F.col("additions")).alias("excerpt"))


# --- analyzers ---------------------------------------------------------------------------------


def _agg(expr: str, where: str = "") -> str:
    return f"coalesce(string_agg(distinct {expr}, ',' order by {expr}){' filter (where ' + where + ')' if where else ''}, '')"


@_rule("file_summary", "select changeset_id, " + ", ".join(f"{_agg('path', f'status = {q(x)}')} as {x}" for x in ("added", "modified", "deleted", "renamed")) + f" from allf where not {any_sql('path', P.EXCLUDED)} group by changeset_id")
def file_summary(changes: Changes) -> DataFrame:
    return A.file_summary(changes.files)


_LARGE = """(select f.changeset_id, f.files_changed, coalesce(c.lines_changed, 0)::bigint as lines_changed from (select changeset_id, count(*) as files_changed from allf group by 1) f
    left join (select changeset_id, sum(len(additions) + len(deletions)) as lines_changed from chg group by 1) c on f.changeset_id = c.changeset_id)"""


@_rule("large_diff", f"select * from {_LARGE} where files_changed > 30 or lines_changed > 1000")
def large_diff(changes: Changes) -> DataFrame:
    return A.large_diffs(changes.files, changes)


_DEP_LINE = f"(regexp_matches(x, {q(A.DEPENDENCY_FIELD)}) or (regexp_matches(x, {q(A.FIELD_NAME)}) and not list_contains({A.NO_DEPENDENCY!r}, regexp_extract(x, {q(A.FIELD_NAME)}, 1)) and regexp_matches(x, {q(A.VERSION_VALUE)})))"


@_rule(
    "lockfile_mismatch",
    f"""select t.changeset_id, manifest_changed, lockfile_changed from (select changeset_id, bool_or(path = 'package.json') as manifest_changed, bool_or(regexp_matches(path, {q(A.LOCKFILE)})) as lockfile_changed,
            bool_or(path = 'package.json' and status = 'added') as manifest_added from allf group by 1) t
        left join (select changeset_id, bool_or(len(list_filter(list_concat(additions, deletions), lambda x: {_DEP_LINE})) > 0) as dep from chg where path = 'package.json' group by 1) l on t.changeset_id = l.changeset_id
        where (manifest_changed and coalesce(dep, manifest_added) and not lockfile_changed) or (not manifest_changed and lockfile_changed)""",
)
def lockfile_mismatch(changes: Changes) -> DataFrame:
    return A.lockfile_mismatches(changes.files, changes)


@_rule(
    "env_vars",
    f"""select changeset_id, name, {_agg('path')} as files from (
        select changeset_id, path, unnest(list_concat(regexp_extract_all(add_text, {q(A.ENV_READ)}, 1), regexp_extract_all(add_text, {q(A.ENV_VITE)}, 1), regexp_extract_all(add_text, {q(A.ENV_PUBLIC)}, 1),
            list_transform(flatten(list_transform(regexp_extract_all(add_text, {q(A.ENV_IMPORT)}, 1), lambda x: string_split(x, ','))), lambda v: regexp_replace(regexp_replace(trim(v), '\\s+as\\s+.*$', ''), '\\s+', '', 'g')))) as name
        from chg where not {any_sql('path', P.EXCLUDED)} and not {any_sql('path', A.ENV_NO_SCAN)} and ({any_sql('path', A.ENV_CONFIG)} or regexp_matches(path, {q(A.CODE_PATH)})))
        where name <> '' group by changeset_id, name""",
)
def env_vars(changes: Changes) -> DataFrame:
    return A.env_vars(changes)


@_rule("security_files", f"select changeset_id, count(*) as n_files, {_agg('path')} as files, {_agg('reason')} as reasons from (select *, {first_sql('path', P.SECURITY)} as reason from allf) where reason is not null group by changeset_id")
def security_files(changes: Changes) -> DataFrame:
    return A.security_files(changes.files)


_SQL_RISK = f"""case when regexp_matches(add_text, {q(A.DESTRUCTIVE_SQL)}) then 'destructive' when regexp_matches(add_text, {q(A.SCHEMA_SQL)}) then 'schema_change'
    when len(list_filter(regexp_extract_all(add_text, '(?i)(?:UPDATE|DELETE)\\s+[^;\\n]*'), lambda x: not regexp_matches(x, '(?i)\\bWHERE\\b'))) > 0 then 'unscoped_modification' end"""


@_rule("sql_risks", f"select changeset_id, path, hunk_ord, risk from (select changeset_id, path, hunk_ord, {_SQL_RISK} as risk from chg where {any_sql('path', P.MIGRATION_FILE)}) where risk is not null")
def sql_risks(changes: Changes) -> DataFrame:
    return A.sql_risks(changes)


@_rule(
    "ci_workflows",
    " union all ".join(f"select changeset_id, path, {q(k)} as risk, min(hunk_ord) as first_hunk from chg where {any_sql('path', P.CI_FILE)} and regexp_matches(add_text, {q(p)}) group by 1, 2" for k, p in {**A.WORKFLOW_RISKS, "pipeline_changed": ""}.items()),
)
def ci_workflows(changes: Changes) -> DataFrame:
    return A.ci_workflows(changes)


@_rule("infra", f"select changeset_id, infra_type, {_agg('path')} as files from (select *, {first_sql('path', P.INFRA)} as infra_type from allf) where infra_type is not null group by 1, 2")
def infra(changes: Changes) -> DataFrame:
    return A.infra_changes(changes.files)


@_rule("api_contracts", f"select changeset_id, {_agg('path')} as files from allf where {any_sql('path', P.API_CONTRACT)} group by 1")
def api_contracts(changes: Changes) -> DataFrame:
    return A.api_contracts(changes.files)


@_rule(
    "cloudflare",
    f"""select changeset_id, area, {_agg('path')} as files from (select changeset_id, 'wrangler' as area, path from allf where regexp_matches(path, '^wrangler\\.(toml|json)$')
        union all select changeset_id, 'ci', path from chg where regexp_matches(path, '^\\.github/workflows/.*\\.(yml|yaml)$') and regexp_matches(add_text, {q(A.CLOUDFLARE_WORDS)})) group by 1, 2""",
)
def cloudflare(changes: Changes) -> DataFrame:
    return A.cloudflare_changes(changes.files, changes)


@_rule("test_changes", f"select changeset_id, {_agg('path')} as files, " + ", ".join(f"{_agg('path', f'status = {q(x)}')} as {x}" for x in ("added", "modified", "deleted")) + f" from allf where {any_sql('path', P.TEST_FILE + P.TEST_CONFIG)} group by 1")
def test_changes(changes: Changes) -> DataFrame:
    return A.test_changes(changes.files)


def _labels_sql(rules: dict[str, str]) -> str:
    return "list_filter([" + ", ".join(f"case when regexp_matches(add_text, {q(p)}) then {q(n)} end" for n, p in rules.items()) + "], lambda x: x is not null)"


def _risk_sql(chosen: str, rules: dict[str, str], schema: str, risk: str) -> str:
    return f"""select changeset_id, tool, count(distinct path) as n_files, {_agg('path')} as files, case when {_agg('label')} <> '' then 'high' {risk} end as risk, {_agg('label')} as reasons from (
        select changeset_id, path, tool, is_schema, unnest(case when len(found) > 0 then found else [null] end) as label from (
            select f.changeset_id, f.path, f.tool, {schema} as is_schema, coalesce({_labels_sql(rules)}, []) as found
            from ({chosen}) f left join chg c on f.changeset_id = c.changeset_id and f.path = c.path)) group by changeset_id, tool"""


@_rule(
    "supabase_migrations",
    _risk_sql(
        "select s.changeset_id, s.path, 'supabase' as tool from allf s join (select changeset_id, bool_or(regexp_matches(path, '^supabase/migrations/.*\\.sql$')) as m from allf where starts_with(path, 'supabase/') group by 1) a on s.changeset_id = a.changeset_id where starts_with(s.path, 'supabase/') and (not a.m or regexp_matches(s.path, '^supabase/migrations/.*\\.sql$'))",
        A.SUPABASE_DESTRUCTIVE, "true", "when bool_and(regexp_matches(path, '^supabase/(seed|config)')) then 'low' else 'medium'",
    ),
)
def supabase_migrations(changes: Changes) -> DataFrame:
    return A.supabase_migrations(changes.files, changes)


@_rule("python_migrations", _risk_sql(f"select * from (select changeset_id, path, {first_sql('path', A.PYTHON_MIGRATION)} as tool from allf) where tool is not null", A.PYTHON_DESTRUCTIVE, f"regexp_matches(add_text, {q(A.PYTHON_SCHEMA)})", "when coalesce(bool_or(is_schema), false) then 'medium' else 'low'"))
def python_migrations(changes: Changes) -> DataFrame:
    return A.python_migrations(changes.files, changes)


@_rule("config_findings", config_sql())
def config_all(changes: Changes) -> DataFrame:
    return config_findings(changes)


def _config(name: str) -> None:
    rules = [r for r in RULES if r.analyzer == name]
    _rule("config_" + name.replace("-", "_"), config_sql(rules))(lambda changes: config_findings(changes, rules))


for _name in dict.fromkeys(r.analyzer for r in RULES):
    _config(_name)


def _sides_sql(groups: dict[str, tuple[str, dict[str, str]]], group: str, element: str, removed: str = "removed") -> str:
    rows = []
    for kind, (gate, elements) in groups.items():
        for el, pattern in elements.items():
            for text, mark in (("add_text", 1), ("del_text", 2)):
                rows.append(f"select changeset_id, path, {q(kind)} as {group}, {q(el)} as {element}, unnest(regexp_extract_all({text}, {q(pattern)}, 1)) as name, {mark} as side from chg where regexp_matches(path, {q(gate)})")
    return f"select changeset_id, path, {group}, {element}, name, case bit_or(side) when 1 then 'added' when 2 then {q(removed)} else 'modified' end as change from ({' union all '.join(rows)}) group by 1, 2, 3, 4, 5"


@_rule("schema_elements", _sides_sql(A.SCHEMA_ELEMENTS, "kind", "element"))
def schema_elements(changes: Changes) -> DataFrame:
    return A.schema_elements(changes)


_BREAKS = " union all ".join(f"select changeset_id, path, {q(k)} as kind, {q(label)} as reason from chg where regexp_matches(path, {q(A.SCHEMA_ELEMENTS[k][0])}) and regexp_matches(del_text, {q(p)})" for k, rules in A.SCHEMA_BREAKS.items() for label, p in rules.items())


@_rule(
    "schema_changes",
    f""", el as ({_sides_sql(A.SCHEMA_ELEMENTS, "kind", "element")}),
        per as (select changeset_id, path, kind, """
    + ", ".join(f"{_agg(chr(40) + 'element || ' + q(':') + ' || name' + chr(41), f'change = {q(x)}')} as {x}" for x in ("added", "removed", "modified"))
    + f""", bool_or(case when kind = 'tsconfig' then list_contains({A.CRITICAL_OPTIONS!r}, name) else change <> 'added' end) as breaks from el group by 1, 2, 3),
        why as (select changeset_id, path, kind, {_agg('reason')} as reasons from ({_BREAKS}) group by 1, 2, 3)
        select coalesce(p.changeset_id, w.changeset_id) as changeset_id, coalesce(p.path, w.path) as path, coalesce(p.kind, w.kind) as kind, coalesce(added, '') as added, coalesce(removed, '') as removed,
            coalesce(modified, '') as modified, coalesce(reasons, '') as reasons, coalesce(breaks, false) or reasons is not null as is_breaking
        from per p full join why w on p.changeset_id = w.changeset_id and p.path = w.path and p.kind = w.kind""",
)
def schema_changes(changes: Changes) -> DataFrame:
    return A.schema_changes(changes)


@_rule("surface_changes", _sides_sql(A.SURFACES, "surface", "kind"))
def surface_changes(changes: Changes) -> DataFrame:
    return A.surface_changes(changes)


def _risky_sql(table_: dict[str, list[str]]) -> str:
    return "case " + " ".join(f"when list_contains({names!r}, name) then {q(k)}" for k, names in table_.items()) + " end"


def _versions_sql(gate: str, pattern: str, skip: str, sections: bool = False) -> str:
    rows = " union all ".join(f"select changeset_id, path, {q(mark)} as side, row_number() over () as list, {column} as lines from chg where regexp_matches(path, {q(gate)})" for column, mark in (("additions", "to"), ("deletions", "from")))
    above = f"coalesce(last_value(case when regexp_matches(line, {q(A.MANIFEST_SECTION)}) then regexp_extract(line, {q(A.MANIFEST_SECTION)}, 1) end ignore nulls) over (partition by side, list order by pos rows between unbounded preceding and 1 preceding), 'dependencies')" if sections else "'dependencies'"
    return f"""select changeset_id, path, name, section, max(version) filter (where side = 'from') as from_version, max(version) filter (where side = 'to') as to_version from (
        select changeset_id, path, side, section, lower(regexp_extract(line, {q(pattern)}, 1)) as name, trim(regexp_extract(line, {q(pattern)}, 2)) as version from (
            select *, {above} as section from (select changeset_id, path, side, list, unnest(lines) as line, unnest(range(len(lines))) as pos from ({rows})))
        where regexp_matches(line, {q(pattern)}) and not regexp_matches(line, {q(skip)}) and section in ('dependencies', 'devDependencies')) group by 1, 2, 3, 4"""


@_rule(
    "python_dependencies",
    f"""select changeset_id, path, name, section, from_version, to_version, case when to_version is null then 'removed' when from_version is null then 'new' when from_version = '' or to_version = '' then 'unknown'
        when coalesce(nullif(regexp_extract(to_version, '(\\d+)', 1), '')::int, 0) > coalesce(nullif(regexp_extract(from_version, '(\\d+)', 1), '')::int, 0) then 'major' else 'minor' end as impact,
        {_risky_sql(A.RISKY_PYTHON)} as risk_category from ({_versions_sql(A.REQUIREMENTS_FILE, A.REQUIREMENT, '^[ ]*(#|-|$)')})""",
)
def python_dependencies(changes: Changes) -> DataFrame:
    return A.python_dependencies(changes)


_SEMVER = r"^v?(\d{1,9})\.(\d{1,9})\.(\d{1,9})(?:[-+][0-9A-Za-z.+-]+)?$"


def _semver_sql(a: str, b: str) -> str:
    part = lambda c, i: f"nullif(regexp_extract(trim(regexp_replace({c}, '^[\\^~>=<]+', '')), {q(_SEMVER)}, {i}), '')::int"
    return " ".join(f"when {part(b, i)} > {part(a, i)} then {q(n)}" for i, n in ((1, "major"), (2, "minor"), (3, "patch")))


@_rule(
    "node_dependencies",
    f"""select changeset_id, path, name, section, from_version, to_version, case when to_version is null then 'removed' when from_version is null then 'new' {_semver_sql('from_version', 'to_version')} else 'unknown' end as impact,
        {_risky_sql(A.RISKY_NODE)} as risk_category from ({_versions_sql('(^|/)package[.]json$', A.MANIFEST_LINE, A.FIELD_NAME.replace('([^' + chr(92) + '"]+)', '(' + '|'.join(A.NO_DEPENDENCY) + ')'))})
        where from_version is null or to_version is null or from_version <> to_version""",
)
def node_dependencies(changes: Changes) -> DataFrame:
    return A.node_dependencies(changes)


def _steps_sql(framework: str) -> str:
    out = "path"
    for pattern, to in A.ROUTE_STEPS[framework]:
        out = f"regexp_replace({out}, {q(pattern)}, {q(to.replace('$', chr(92)))}, 'g')"
    return out


@_rule(
    "file_routes",
    f"""select r.changeset_id, r.path, framework, route_id, route_type, change, case when route_type = 'endpoint' then coalesce(methods, '') else '' end as methods from (
        select changeset_id, path, status as change, framework, case framework {' '.join(f'when {q(k)} then {_steps_sql(k)}' for k in A.ROUTE_STEPS)} end as route_id,
            case framework {' '.join(f'when {q(k)} then {first_sql("path", v, "unknown")}' for k, v in A.ROUTE_TYPES.items())} end as route_type
        from (select *, {first_sql('path', A.ROUTE_GATES)} as framework from allf) where framework is not null) r
        left join (select changeset_id, path, {_agg('m')} as methods from (select changeset_id, path, unnest(regexp_extract_all(add_text, {q(A.METHOD_EXPORT)}, 1)) as m from chg) group by 1, 2) m on r.changeset_id = m.changeset_id and r.path = m.path""",
)
def file_routes(changes: Changes) -> DataFrame:
    return A.file_routes(changes.files, changes)


_FRAMEWORK = """case when regexp_matches(path, 'urls\\.py$') then 'django' when regexp_matches(all_text, 'from fastapi|import fastapi|APIRouter') then 'fastapi' when regexp_matches(all_text, 'from django|urlpatterns') then 'django'
    when regexp_matches(all_text, 'from flask|Flask\\(|Blueprint\\(') then 'flask' when regexp_matches(path, 'views\\.py$') then 'django' when regexp_matches(path, '(routers?|endpoints?|api|main|app|routes?)\\.py$') then 'fastapi' else 'flask' end"""
_ROUTES_OF = lambda text: f"case framework when 'fastapi' then regexp_extract_all({text}, {q(A.FASTAPI_ROUTE)}, 2) when 'django' then regexp_extract_all({text}, {q(A.DJANGO_ROUTE)}, 1) else regexp_extract_all({text}, {q(A.FLASK_ROUTE)}, 1) end"


@_rule(
    "python_routes",
    f""", g as (select *, {_FRAMEWORK} as framework from chg where regexp_matches(path, {q(A.PYTHON_ROUTE_FILE)})),
        r as (select changeset_id, path, framework, unnest({_ROUTES_OF('add_text')}) as route, 1 as side from g union all select changeset_id, path, framework, unnest({_ROUTES_OF('del_text')}), 2 from g),
        p as (select changeset_id, path, framework, side, case when framework = 'django' then regexp_replace(regexp_replace(regexp_replace(route, '^\\^', ''), '\\$$', ''), '\\(\\?P<(\\w+)>[^)]+\\)', ':{{\\1}}', 'g') else route end as plain from r),
        t as (select changeset_id, path, framework, side, case when starts_with(plain, '/') then plain else '/' || plain end as rooted from p)
        select changeset_id, path, framework, case when rooted = '/' then rooted else regexp_replace(rooted, '/$', '') end as route_id, case bit_or(side) when 1 then 'added' when 2 then 'deleted' else 'modified' end as change from t group by 1, 2, 3, 4""",
)
def python_routes(changes: Changes) -> DataFrame:
    return A.python_routes(changes)


@_rule(
    "rsc_boundary",
    ", f as (select changeset_id, path, "
    + ", ".join(f"bool_or(regexp_matches({x}_text, {q(p)})) as {x}_{m}" for x in ("add", "del") for m, p in A.RSC_MARKS.items())
    + f""" from chg where regexp_matches(path, {q(A.RSC_PATH)}) group by 1, 2),
        b as (select *, case when add_use_server or add_server_only then 'server' when add_use_client or add_client_only then 'client' end as head, case when del_use_server or del_server_only then 'server' when del_use_client or del_client_only then 'client' end as base from f)
        select changeset_id, path, case when del_use_server then 'use server' when del_use_client then 'use client' else '' end as from_directive, case when add_use_server then 'use server' when add_use_client then 'use client' else '' end as to_directive,
            coalesce(head, base) as boundary, concat_ws('; ', case when not add_use_client and del_use_client then 'Removed client directive' end, case when not add_use_server and del_use_server then 'Removed server directive' end,
            case when add_server_only and not del_server_only then 'Added server-only import' end, case when not add_client_only and del_client_only then 'Removed client-only import' end) as reasons
        from b where head is not null or base is not null""",
)
def rsc_boundary(changes: Changes) -> DataFrame:
    return A.rsc_boundaries(changes)


@_rule(
    "impact_radius",
    f"""select s.changeset_id, s.path, count(distinct u.path) as dependents, string_agg(distinct u.path, ',' order by u.path) as users, case when count(distinct u.path) > 10 then 'high' when count(distinct u.path) > 3 then 'medium' else 'low' end as blast_radius
        from (select changeset_id, path, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '') as name from allf where status in ('modified', 'renamed') and regexp_matches(path, {q(A.CODE_FILE)})) s
        join (select changeset_id, path, unnest(regexp_extract_all(all_text, '["''](?:[^"''\\s]*/)?([\\w.@-]+?)(?:\\.(?:ts|tsx|js|jsx|mjs|cjs|svelte|vue|astro))?["'']', 1)) as name from chg where regexp_matches(path, {q(A.CODE_FILE)})) u
        on s.changeset_id = u.changeset_id and s.name = u.name and s.path <> u.path group by s.changeset_id, s.path""",
)
def impact_radius(changes: Changes) -> DataFrame:
    return A.impact_radius(changes.files, changes)


# --- identity, order, comparison ---------------------------------------------------------------------


@_register("stable_hash", "select hunk_id, substr(sha256(replace(path, '\\', '/') || ':' || hunk_ord), 1, 12) as id from hunks_c", True)
def stable_hash(s: SparkSession, d: str) -> DataFrame:
    return _hunks(s, d).select("hunk_id", I.stable_hash(F.concat(I.posix(F.col("path")), F.lit(":"), F.col("hunk_ord").cast("string"))).alias("id"))


_DEDUP = "(select * from facts_findings where facts_path is not null and finding_id is not null and finding_id <> '' qualify row_number() over (partition by facts_path, finding_id order by loaded_at desc nulls last, row_id desc) = 1)"


def _dedup(s: SparkSession, d: str) -> DataFrame:
    return I.last_wins(table(s, d, "facts_findings").where("finding_id <> ''"), ["facts_path", "finding_id"], ["loaded_at", "row_id"])


@_register("dedup_last_wins", f"select facts_path, finding_id, row_id from {_DEDUP}", False)
def dedup_last_wins(s: SparkSession, d: str) -> DataFrame:
    return _dedup(s, d).select("facts_path", "finding_id", "row_id")


@_register(
    "sort_findings",
    f"select row_id, row_number() over (partition by facts_path order by finding_type nulls first, coalesce(lower(replace(evidence[1].file, '\\', '/')), ''), coalesce(evidence[1].line, 0), row_id) as sort_rank from {_DEDUP}",
    False,
)
def sort_findings(s: SparkSession, d: str) -> DataFrame:
    return I.sort_rank(_dedup(s, d)).select("row_id", "sort_rank")


_PAIRS = "(select distinct r.facts_path as newer, o.facts_path as older from facts_runs r join facts_runs o on regexp_replace(r.since_path, '^(\\./)+', '') = o.facts_path where r.facts_path <> o.facts_path)"


def _pairs(s: SparkSession, d: str) -> DataFrame:
    runs = table(s, d, "facts_runs")
    old = runs.select(F.col("facts_path").alias("older"), relative_path(F.col("facts_path")).alias("at")).distinct()
    return runs.select(F.col("facts_path").alias("newer"), relative_path(F.col("since_path")).alias("at")).distinct().join(old, "at").where("newer <> older").select("newer", "older")


@_register(
    "delta_confidence",
    f""", x as (select facts_path, finding_id, confidence from {_DEDUP}), a as (select p.newer, x.finding_id, x.confidence from {_PAIRS} p join x on p.newer = x.facts_path), b as (select p.newer, x.finding_id, x.confidence from {_PAIRS} p join x on p.older = x.facts_path)
        select newer, finding_id, change from (select coalesce(a.newer, b.newer) as newer, coalesce(a.finding_id, b.finding_id) as finding_id,
            case when b.newer is null then 'added' when a.newer is null then 'removed' when a.confidence is distinct from b.confidence then 'changed' end as change
            from a full join b on a.newer = b.newer and a.finding_id = b.finding_id) where change is not null""",
)
def delta_confidence(s: SparkSession, d: str) -> DataFrame:
    """Findings added, removed or of another confidence between runs, by a plain full join."""
    rows = _dedup(s, d).select("facts_path", "finding_id", "confidence")
    pairs = _pairs(s, d)
    side = lambda c: pairs.join(rows.withColumnRenamed("facts_path", c), c).select("newer", "finding_id", "confidence")
    return I.delta_by_id(side("older"), side("newer"), ["newer", "finding_id"], "confidence")


_SCOPE = ["repo_name", "profile"]


@_register(
    "scope_warnings",
    f""", one as (select facts_path, repo_name, profile from facts_runs qualify row_number() over (partition by facts_path order by loaded_at desc nulls last) = 1)
        select facts_path, field, before, after from (select p.newer as facts_path, unnest(['repo_name', 'profile']) as field, unnest([o.repo_name, o.profile]) as before, unnest([n.repo_name, n.profile]) as after
            from {_PAIRS} p join one n on p.newer = n.facts_path join one o on p.older = o.facts_path) where before is distinct from after""",
)
def scope_warnings(s: SparkSession, d: str) -> DataFrame:
    return I.scope_warnings(table(s, d, "facts_runs"), _pairs(s, d), _SCOPE)


# --- scores and reports ------------------------------------------------------------------------------------


_STATUS = "coalesce((select status from allf f where f.changeset_id = x.changeset_id and f.path = x.path), 'modified')"


@_rule("surface_files", f"""select changeset_id, path, surface, {_agg('name')} as names, {_agg('told')} as told, bool_or(breaks) as breaks from (
        select *, concat_ws(':', name, kind, change, cast(breaks as string)) as told from (select *, change = 'removed' and surface <> 'next-config' and (surface <> 'runes' or name in ('$state', '$props')) as breaks
            from ({_sides_sql(A.SURFACES, "surface", "kind")}))) group by 1, 2, 3""")
def surface_files(changes: Changes) -> DataFrame:
    return A.surface_files(changes)


@_rule("surface_findings", f"select x.*, {_STATUS} as status from {RS.subquery(RULE_QUERIES['surface_files'][1])} x")
def surface_findings(changes: Changes) -> DataFrame:
    return S.surface_findings(changes)


@_rule("config_files", f"""select x.*, coalesce((select string_agg(distinct name, ',' order by name) from ({_sides_sql(A.SURFACES, "surface", "kind")}) i where i.surface = 'docker' and i.changeset_id = x.changeset_id and i.path = x.file), '') as images from {RS.subquery(config_sql())} x""")
def config_files(changes: Changes) -> DataFrame:
    return S.config_files(changes)


_PY_BREAKS = "list_filter([" + ", ".join(f"case when regexp_matches(add_text, {q(p)}) then {q(n)} end" for n, p in A.PYPROJECT_BREAKS.items()) + "], lambda x: x is not null)"


@_rule("python_configs", f""", g as (select changeset_id, path, status, {first_sql('path', A.PYTHON_CONFIGS)} as kind from allf where {any_sql('path', [g for _, gs in A.PYTHON_CONFIGS for g in gs])}),
        sec as (select changeset_id, path, {_agg('trim(s)')} as sections from (select changeset_id, path, unnest(regexp_extract_all(add_text, {q(A.CONFIG_SECTION)}, 1)) as s from chg) group by 1, 2),
        brk as (select changeset_id, path, {_agg('s')} as reasons from (select changeset_id, path, unnest({_PY_BREAKS}) as s from chg where regexp_matches(path, '(^|/)pyproject[.]toml$')) group by 1, 2)
        select g.changeset_id, g.path, status, split_part(kind, ':', 1) as config_type, split_part(kind, ':', 2) as config_category, coalesce(sections, '') as sections, coalesce(reasons, '') as reasons, coalesce(reasons, '') <> '' as is_breaking
        from g left join sec on g.changeset_id = sec.changeset_id and g.path = sec.path left join brk on g.changeset_id = brk.changeset_id and g.path = brk.path""")
def python_configs(changes: Changes) -> DataFrame:
    return A.python_configs(changes.files, changes)


@_rule("strictness_changes", f"select changeset_id, path, name, change from ({_sides_sql(A.SCHEMA_ELEMENTS, 'kind', 'element')}) where kind = 'tsconfig' and list_contains({A.STRICTNESS_OPTIONS!r}, name)")
def strictness_changes(changes: Changes) -> DataFrame:
    return A.strictness_changes(changes)


_FND = RS.findings_ctes({name: sql for name, (_, sql) in RULE_QUERIES.items() if sql})
_FACTORS, _FLAGS = _FND + RS.factors_cte(), _FND + RS.flags_cte()


@_rule("findings", f"{_FND} select * from fnd")
def findings(changes: Changes) -> DataFrame:
    return _findings(changes)


@_rule("findings_by_type", f"{_FND} {RS.BY_TYPE}")
def findings_by_type(changes: Changes) -> DataFrame:
    return S.findings_by_type(_findings(changes))


@_rule("risk_factors", f"{_FACTORS} select * from factors")
def risk_factors(changes: Changes) -> DataFrame:
    return S.risk_factors(_findings(changes), changes.files)


@_rule("risk_score", f"{_FACTORS} {RS.SCORES}")
def risk_score(changes: Changes) -> DataFrame:
    return S.risk_scores(S.risk_factors(_findings(changes), changes.files), changes.files)


@_rule("risk_flags", f"{_FLAGS} select * from flags")
def risk_flags(changes: Changes) -> DataFrame:
    return S.risk_flags(_findings(changes))


@_rule("category_scores", f"{_FLAGS} select * from cats")
def category_scores(changes: Changes) -> DataFrame:
    return S.category_scores(S.risk_flags(_findings(changes)))


def _sql_score() -> str:
    """The flagship in SQL: sql risks to flags, category score and overall score."""
    return f""", r as (select changeset_id, path, risk, substr(sha256('sql-risk:' || path || ':' || risk), 1, 12) as id from (select changeset_id, path, {_SQL_RISK} as risk from chg where {any_sql('path', P.MIGRATION_FILE)}) where risk is not null),
        f as (select distinct changeset_id, id, case risk when 'destructive' then 41 when 'schema_change' then 26 else 26 end as eff from r),
        c as (select changeset_id, least(100, sum(eff)) as db, count(*) as flags from f group by 1)
        select changeset_id, floor(0.6 * db + 0.4 * db / 3.0 + 0.5)::int as overall, case when floor(0.6 * db + 0.4 * db / 3.0 + 0.5) >= 81 then 'critical' when floor(0.6 * db + 0.4 * db / 3.0 + 0.5) >= 61 then 'high'
            when floor(0.6 * db + 0.4 * db / 3.0 + 0.5) >= 41 then 'elevated' when floor(0.6 * db + 0.4 * db / 3.0 + 0.5) >= 21 then 'moderate' else 'low' end as level, flags from c"""


@_rule("sql_risk_report", _sql_score())
def sql_risk_report(changes: Changes) -> DataFrame:
    """Flagship: hunks to SQL risks, identities, flags, category scores and the overall score."""
    risks = A.sql_risks(changes).selectExpr(*S.part_columns(S.PARTS[0]))
    return S.risk_report(S.risk_flags(risks.withColumn("finding_id", I.finding_id(F.col("type"), F.col("fingerprint")))))


@_rule("risk_report", f"{_FLAGS} {RS.REPORT}")
def risk_report(changes: Changes) -> DataFrame:
    return S.risk_report(S.risk_flags(_findings(changes)))


@_rule("category_aggregates", f"{_FACTORS} {RS.AGGREGATES}")
def category_aggregates(changes: Changes) -> DataFrame:
    found = _findings(changes)
    return S.category_aggregates(found, S.risk_factors(found, changes.files))


@_rule("top_findings", f"{_FND} {RS.TOP}")
def top_findings(changes: Changes) -> DataFrame:
    return S.top_findings(_findings(changes))


@_rule("dependency_overview", f"{_FND} {RS.DEPENDENCIES}")
def dependency_overview(changes: Changes) -> DataFrame:
    return S.dependency_overview(_findings(changes))


@_rule("log_results", f"{_FND} {RS.results_sql()}")
def log_results(changes: Changes) -> DataFrame:
    return R.log_results(_findings(changes))


@_rule("result_logs")
def result_logs(changes: Changes) -> DataFrame:
    return R.result_logs(R.log_results(_findings(changes)))


@_rule("source_changes")
def source_change_rows(changes: Changes) -> DataFrame:
    """Routes, component members, exports and translation keys read from both sides of source files."""
    return source_changes(A.source_sides(changes))


@_rule(
    "profile_detect",
    "select changeset_id, coalesce(" + ", ".join(f"case when bool_or({any_sql('path', m)}) then {q(n)} end" for n, m, _ in D.PROFILES) + ", 'auto') as profile, coalesce(" + ", ".join(f"case when bool_or({any_sql('path', m)}) then {q(c)} end" for _, m, c in D.PROFILES) + ", 'low') as confidence from allf group by changeset_id",
)
def profile_detect(changes: Changes) -> DataFrame:
    return D.profiles(changes.files)


@_rule("actions", _FND + RS.actions_sql(RULE_QUERIES["profile_detect"][1]))
def actions(changes: Changes) -> DataFrame:
    return R.actions(_findings(changes), D.profiles(changes.files))


@_rule("highlights", _FND + RS.highlights_sql())
def highlights(changes: Changes) -> DataFrame:
    return R.highlights(_findings(changes))


@_rule("finding_lines", f"{_FND} select changeset_id, finding_id, type, category, file, name, detail, change, risk from fnd")
def finding_lines(changes: Changes) -> DataFrame:
    """The JSON line of every finding, read back."""
    shape = "findingId string, type string, category string, file string, name string, detail string, change string, risk string"
    read = D.finding_lines(_findings(changes)).select("changeset_id", F.from_json("json", shape).alias("j")).select("changeset_id", "j.*")
    return read.withColumnRenamed("findingId", "finding_id")


@_rule("facts_documents")
def facts_documents(changes: Changes) -> DataFrame:
    found, files = _findings(changes), changes.files
    factors = S.risk_factors(found, files)
    return D.facts_documents(files, found, S.risk_scores(factors, files), S.category_aggregates(found, factors))


@_rule("risk_documents")
def risk_documents(changes: Changes) -> DataFrame:
    flags = S.risk_flags(_findings(changes))
    return D.risk_documents(S.risk_report(flags), flags)


@_rule("markdown")
def markdown(changes: Changes) -> DataFrame:
    found, files = _findings(changes), changes.files
    return D.markdown(files, found, S.risk_scores(S.risk_factors(found, files), files))


@_rule("result_lines", f"{_FND} select changeset_id, rule_id, level, uri, finding_id from ({RS.results_sql()})")
def result_lines(changes: Changes) -> DataFrame:
    """The JSON line of every result, read back."""
    shape = "ruleId string, level string, locations array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>>>>, partialFingerprints struct<findingId:string>"
    read = D.result_lines(R.log_results(_findings(changes))).select("changeset_id", F.from_json("json", shape).alias("j"))
    return read.selectExpr("changeset_id", "j.ruleId as rule_id", "j.level as level", "j.locations[0].physicalLocation.artifactLocation.uri as uri", "j.partialFingerprints.findingId as finding_id")


BUDGET = 20_000


@_register(
    "chunk_by_budget",
    f""", recursive_items as (select changeset_id, path, size, row_number() over (partition by changeset_id order by path) as k from (select changeset_id, path, sum(length(text) + 2)::bigint as size from {_LINES} group by 1, 2)),
        walk as (select changeset_id, path, size, k, 0 as chunk, size as used, size > {BUDGET} as solo from recursive_items where k = 1
            union all select i.changeset_id, i.path, i.size, i.k, w.chunk + (w.solo or w.used + i.size > {BUDGET})::int, case when w.solo or w.used + i.size > {BUDGET} then i.size else w.used + i.size end, i.size > {BUDGET}
            from walk w join recursive_items i on i.changeset_id = w.changeset_id and i.k = w.k + 1)
        select changeset_id, path, size, chunk from walk""",
)
def chunk_budget(s: SparkSession, d: str) -> DataFrame:
    sizes = _lines(s, d).groupBy("changeset_id", "path").agg(F.sum(F.length("text") + 2).alias("size"))
    return chunk_by_budget(sizes, BUDGET)




# --- dumping patches ---------------------------------------------------------------------------------------

_ENTRIES = f"""sized as (select changeset_id, path, count(*) filter (where kind = 'add') as additions, count(*) filter (where kind = 'del') as deletions, sum(length(text) + 2)::bigint as size from {_LINES} group by 1, 2),
    entries as (select f.changeset_id, f.path, f.old_path, coalesce(f.status, 'modified') as status, case when {any_sql('f.path', _GLOBS)} then 'excluded-by-default' when list_contains({[*P.BINARY]!r}, lower(regexp_extract(f.path, '\\.([^./]*)$', 1))) then 'binary'
        when s.size is null then 'diff-empty' else 'keep' end as decision, coalesce(additions, 0) as additions, coalesce(deletions, 0) as deletions, coalesce(size, 0)::bigint as size
        from files_c f left join sized s on f.changeset_id = s.changeset_id and f.path = s.path)"""


def _entries(s: SparkSession, d: str) -> DataFrame:
    return DD.dump_entries(table(s, d, "files"), table(s, d, "diff_lines"))


@_register("dump_entries", f", {_ENTRIES} select * from entries")
def dump_entries(s: SparkSession, d: str) -> DataFrame:
    return _entries(s, d)


@_register("name_only", f""", {_ENTRIES} select changeset_id, row_number() over (partition by changeset_id, decision in ('keep', 'diff-empty') order by path)::int as place, path, decision in ('keep', 'diff-empty') as kept, case when decision not in ('keep', 'diff-empty') then decision end as reason from entries""")
def name_only(s: SparkSession, d: str) -> DataFrame:
    return DD.name_only(_entries(s, d))


@_register("dump_stat", f", {_ENTRIES} select changeset_id, path, additions, deletions, path || ' | +' || additions || ' -' || deletions as text from entries where decision in ('keep', 'diff-empty')")
def dump_stat(s: SparkSession, d: str) -> DataFrame:
    return DD.stat(_entries(s, d))


_PATCH = f""", {_ENTRIES}, kept as (select changeset_id, path, status, coalesce(old_path, path) as before from entries where decision = 'keep'),
    body as (select l.* from {_LINES} l join kept k on l.changeset_id = k.changeset_id and l.path = k.path),
    patch as (select changeset_id, path, -1 as hunk_ord, unnest([0, 1, 2])::int as line_ord, unnest(['diff --git a/' || before || ' b/' || path, '--- ' || case when status = 'added' then '/dev/null' else 'a/' || before end, '+++ ' || case when status = 'deleted' then '/dev/null' else 'b/' || path end]) as text from kept
        union all select changeset_id, path, hunk_ord, -1, '@@ -' || coalesce(min(old_no), 0) || ',' || count(*) filter (where kind <> 'add') || ' +' || coalesce(min(new_no), 0) || ',' || count(*) filter (where kind <> 'del') || ' @@' from body group by 1, 2, 3
        union all select changeset_id, path, hunk_ord, line_ord, case kind when 'add' then '+' when 'del' then '-' else ' ' end || text from body)"""


@_register("patch_lines", f"{_PATCH} select * from patch")
def patch_lines(s: SparkSession, d: str) -> DataFrame:
    return DD.patch_lines(_entries(s, d), table(s, d, "diff_lines"))


@_register("patch_json", f"""{_PATCH} select changeset_id, path, hunk_ord, count(*)::int as n_lines, string_agg(text, chr(10) order by line_ord) as texts from body group by 1, 2, 3""")
def patch_json(s: SparkSession, d: str) -> DataFrame:
    """The JSON form of every hunk, read back."""
    shape = "path string, hunk int, lines array<struct<kind:string,oldLine:int,newLine:int,text:string>>"
    read = DD.json_hunks(_entries(s, d), table(s, d, "diff_lines")).withColumn("j", F.from_json("json", shape))
    return read.select("changeset_id", "path", "hunk_ord", F.size("j.lines").alias("n_lines"), F.array_join(F.transform("j.lines", lambda x: x["text"]), "\n").alias("texts"))


@_register("patch_markdown_heads", f""", {_ENTRIES} select changeset_id, 7 + row_number() over (partition by changeset_id order by path)::int as line_no, '- `' || path || '` (' || status || ')' as text from entries where decision = 'keep'
    union all select changeset_id, unnest([0, 1, 2, 3, 4, 5, 6, 7])::int as line_no, unnest(['# Git Diff: main..HEAD', '', '**Mode:** branch', '**Unified context:** 3 lines', '**Files included:** ' || n, '', '## Files', '']) as text from (select changeset_id, count(*) as n from entries where decision = 'keep' group by 1)""")
def patch_markdown_heads(s: SparkSession, d: str) -> DataFrame:
    return DD.markdown_heads(_entries(s, d))


@_register("patch_targets", """, fs as (select changeset_id, path, regexp_replace(path, '/+$', '') as name from files_c union select changeset_id, path, regexp_replace(old_path, '/+$', '') from files_c where old_path is not null),
    w as (select distinct changeset_id, regexp_extract(path, '^([^/]*)', 1) as wanted from files_c union select distinct changeset_id, path from files_c where ord % 5 = 0 union select distinct changeset_id, './src/' from files_c),
    s as (select changeset_id, wanted, regexp_replace(regexp_replace(wanted, '^\\./+', ''), '/+$', '') as at, ends_with(wanted, '/') as folder from w),
    h as (select s.changeset_id, s.wanted, f.path, bool_or(f.name = s.at and not folder) as exact from s join fs f on s.changeset_id = f.changeset_id and (f.name = s.at or starts_with(f.name, s.at || '/')) group by 1, 2, 3)
    select changeset_id, wanted, path, case when exact then 'file' else 'directory' end as target_kind from (select *, bool_or(exact) over (partition by changeset_id, wanted) as any_exact from h) where exact or not any_exact""")
def patch_targets(s: SparkSession, d: str) -> DataFrame:
    """Selectors made of the first folder of every path, of every fifth path, and of one folder."""
    f = C.change_files(table(s, d, "files"))
    wanted = f.select("changeset_id", F.regexp_extract("path", "^([^/]*)", 1).alias("wanted")).union(f.where("ord % 5 = 0").select("changeset_id", "path")).union(f.select("changeset_id", F.lit("./src/")))
    return DD.patch_targets(table(s, d, "files"), wanted)


@_register("chunk_files", f""", {_ENTRIES}, items as (select changeset_id, path, size, row_number() over (partition by changeset_id order by path) as k from entries where decision = 'keep'),
        walk as (select changeset_id, path, size, k, 0 as chunk, size as used, size > {BUDGET} as solo from items where k = 1
            union all select i.changeset_id, i.path, i.size, i.k, w.chunk + (w.solo or w.used + i.size > {BUDGET})::int, case when w.solo or w.used + i.size > {BUDGET} then i.size else w.used + i.size end, i.size > {BUDGET}
            from walk w join items i on i.changeset_id = w.changeset_id and i.k = w.k + 1)
        select changeset_id, path, size, chunk, 'patch-' || lpad((chunk + 1)::varchar, 3, '0') || '.diff' as file_name from walk""")
def chunk_files(s: SparkSession, d: str) -> DataFrame:
    return DD.chunk_files(_entries(s, d), BUDGET)


@_register("parse_patch", f"""{_PATCH}, b as (select *, row_number() over (partition by changeset_id, path, hunk_ord order by line_ord) - 1 as nth, dense_rank() over (partition by changeset_id, path order by hunk_ord) - 1 as h,
        coalesce(min(old_no) over (partition by changeset_id, path, hunk_ord), 0) as o, coalesce(min(new_no) over (partition by changeset_id, path, hunk_ord), 0) as n,
        coalesce(sum((kind <> 'add')::int) over before_, 0) as so, coalesce(sum((kind <> 'del')::int) over before_, 0) as sn from body
        window before_ as (partition by changeset_id, path, hunk_ord order by line_ord rows between unbounded preceding and 1 preceding))
    select b.changeset_id, case when k.status = 'deleted' then k.before else b.path end as path, case when k.status not in ('added', 'deleted') and k.before <> b.path then k.before end as old_path,
        case when k.status in ('added', 'deleted') then k.status when k.before <> b.path then 'renamed' else 'modified' end as status, h::int as hunk_ord, nth::int as line_ord, kind,
        case when kind <> 'add' then o + so end::int as old_no, case when kind <> 'del' then n + sn end::int as new_no, text
    from b join kept k on b.changeset_id = k.changeset_id and b.path = k.path""")
def parse_patch(s: SparkSession, d: str) -> DataFrame:
    """Patches written out line by line and parsed again; line ends inside a text part no line here."""
    lines = DD.patch_lines(_entries(s, d), table(s, d, "diff_lines"))
    order = Window.partitionBy("changeset_id").orderBy("path", "hunk_ord", "line_ord")
    return C.parse_patch(lines.select("changeset_id", (F.row_number().over(order) - 1).alias("line_no"), "text"))


@_register("deletions_with_line_no", f"select changeset_id, path, old_no as line, text from {_LINES} where kind = 'del'")
def deletions_with_line_no(s: SparkSession, d: str) -> DataFrame:
    return C.deletions_of(_lines(s, d))


# --- evidence, deltas, profiles, sections ---------------------------------------------------------------------


_SORTED = "list_sort(list_transform(list_filter(evidence, lambda e: e is not null), lambda e: {'k': lower(replace(e.file, chr(92), '/')), 'l': coalesce(e.line, 0), 'file': e.file, 'excerpt': e.excerpt, 'line': e.line}), 'ASC', 'NULLS FIRST')"


@_register("sort_evidence", f"select row_id, to_json(list_transform({_SORTED}, lambda e: [e.file, e.excerpt, e.line::varchar]))::varchar as ordered from facts_findings where evidence is not null", False)
def sort_evidence(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "facts_findings").where("evidence is not null").withColumn("evidence", F.filter("evidence", lambda e: e.isNotNull()))
    ordered = rows.withColumn("e", E.sort_evidence("evidence"))
    return ordered.select("row_id", F.to_json(F.transform("e", lambda e: F.array(e["file"], e["excerpt"], e["line"].cast("string")))).alias("ordered"))


_CAP = "case finding_type " + " ".join(f"when '{t}' then {n}" for t, n in E.CAPS.items()) + " else len(evidence) end"


@_register("evidence_caps", f"select row_id, len(evidence[1:{_CAP}])::int as kept from facts_findings where evidence is not null", False)
def evidence_caps(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "facts_findings").where("evidence is not null")
    return rows.select("row_id", F.size(E.capped("evidence", "finding_type")).alias("kept"))


_POINTS = " + ".join(f"case when regexp_matches(lower(coalesce(excerpt, '')), '{p}') then {n} else 0 end" for p, n in E.SCORES)


@_register("top_evidence", f"""select facts_path, category, place, file, excerpt from (select *, row_number() over (partition by facts_path, category order by s, file)::int as place from (
        select facts_path, category, file, min(s) as s, arg_min(excerpt, (s, excerpt)) as excerpt from (select facts_path, category, file, coalesce(excerpt, '') as excerpt, -({_POINTS}) as s from (
            select facts_path, category, unnest(evidence).file as file, unnest(evidence).excerpt as excerpt from facts_findings) where file is not null) group by 1, 2, 3)) where place <= 3""", False)
def top_evidence(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "facts_findings").select("facts_path", "category", F.explode("evidence").alias("e")).select("facts_path", "category", "e.file", "e.excerpt")
    return E.top_evidence(rows)


@_rule("finding_evidence")
def finding_evidence(changes: Changes) -> DataFrame:
    return E.finding_evidence(_findings(changes), changes)


_CONSECUTIVE = "select changeset_id as newer, lag(changeset_id) over (order by changeset_id) as older from (select distinct changeset_id from files_c) qualify older is not null"


@_register("files_delta", f""", pairs as ({_CONSECUTIVE}), n as (select newer, older, path, coalesce(status, 'modified') as token from pairs join files_c on changeset_id = newer), o as (select newer, older, path, coalesce(status, 'modified') as token from pairs join files_c on changeset_id = older)
    select newer, older, path, change from (select coalesce(n.newer, o.newer) as newer, coalesce(n.older, o.older) as older, coalesce(n.path, o.path) as path, case when o.newer is null then 'added' when n.newer is null then 'removed' when n.token <> o.token then 'changed' end as change
        from n full join o on n.newer = o.newer and n.path = o.path) where change is not null""")
def files_delta(s: SparkSession, d: str) -> DataFrame:
    f = listed_files(table(s, d, "files"))
    return DL.files_delta(f.withColumnRenamed("status", "token"), DL.consecutive(f))


@_rule("risk_delta", f"""{_FLAGS}, rep as ({RS.REPORT}), pairs as (select changeset_id as newer, lag(changeset_id) over (order by changeset_id) as older from (select distinct changeset_id from allf) qualify older is not null),
    d as (select coalesce(n.newer, o.newer) as newer, case when o.newer is null then 'added' when n.newer is null then 'removed' when n.effective_score <> o.effective_score then 'changed' end as change from
        (select p.newer, g.flag_id, g.effective_score from pairs p join flags g on g.changeset_id = p.newer) n full join (select p.newer, g.flag_id, g.effective_score from pairs p join flags g on g.changeset_id = p.older) o on n.newer = o.newer and n.flag_id = o.flag_id),
    c as (select newer, count(*) filter (where change = 'added') as added, count(*) filter (where change = 'removed') as removed, count(*) filter (where change = 'changed') as changed from d group by 1)
    select p.newer, p.older, coalesce(o.overall, 0) as score_from, coalesce(n.overall, 0) as score_to, coalesce(n.overall, 0) - coalesce(o.overall, 0) as score_delta, coalesce(added, 0) as added, coalesce(removed, 0) as removed, coalesce(changed, 0) as changed
    from pairs p left join rep o on o.changeset_id = p.older left join rep n on n.changeset_id = p.newer left join c on c.newer = p.newer""")
def risk_delta(changes: Changes) -> DataFrame:
    flags = cut_lineage(S.risk_flags(_findings(changes)))
    return DL.risk_delta(flags, S.risk_report(flags), DL.consecutive(changes.files))


@_register("delta_counts", _SQL["delta_confidence"].replace("select newer, finding_id, change from", "select newer, count(*) filter (where change = 'added') as added, count(*) filter (where change = 'removed') as removed, count(*) filter (where change = 'changed') as changed from") + " group by newer", False)
def delta_counts(s: SparkSession, d: str) -> DataFrame:
    return DL.delta_counts(delta_confidence(s, d), "newer")


_REGISTRY = ", ".join("(" + ", ".join("null" if v is None else str(v) if isinstance(v, int) else f"'{v}'" for v in row) + ")" for row in PR.registry())


@_rule("profile_findings", f"""{_FND}, reg(profile, place, analyzer, type, only_) as (values {_REGISTRY})
    select f.*, p.profile, min(r.place)::int as place from fnd f join {RS.subquery(RULE_QUERIES['profile_detect'][1])} p on f.changeset_id = p.changeset_id join reg r on r.profile = p.profile and r.type = f.type and (r.only_ is null or r.only_ = f.category)
    group by all""")
def profile_findings(changes: Changes) -> DataFrame:
    return PR.profile_findings(_findings(changes), D.profiles(changes.files))


@_rule("section_lines", f"""{_FND}, l as (select distinct changeset_id, finding_id, {SE.SECTION_OF} as section, coalesce({SE.LINE_OF}, '') as line from fnd),
    n as (select *, row_number() over (partition by changeset_id, section order by line, finding_id)::int as place, count(*) over (partition by changeset_id, section) as n from l where section is not null)
    select changeset_id, section, {SE.TITLE_OF} as title, place, case when place > 10 then '(+' || (n - 10) || ' more)' else line end as line from n where place <= 11""")
def section_lines(changes: Changes) -> DataFrame:
    return SE.section_lines(_findings(changes))


@_rule("domain_findings", f"{_FND} select changeset_id, type, finding_id from fnd where type not in ('large-diff', 'lockfile-mismatch', 'file-summary', 'file-category')")
def domain_findings(changes: Changes) -> DataFrame:
    return S.domain_findings(_findings(changes)).select("changeset_id", "type", "finding_id")


@_rule("first_findings", f"{_FND} select changeset_id, finding_id from fnd qualify row_number() over (partition by changeset_id order by type, lower(coalesce(file, '')), finding_id, fingerprint) <= 3")
def first_findings(changes: Changes) -> DataFrame:
    """The limit is the feature: three findings of a change set in their order."""
    return S.limit_findings(_findings(changes), 3).select("changeset_id", "finding_id")


@_rule("flags_filtered", f"{_FLAGS} select changeset_id, flag_id from flags where flag_category in ('security', 'ci', 'db', 'deps') and flag_category not in ('ci')")
def flags_filtered(changes: Changes) -> DataFrame:
    return S.filter_flags(S.risk_flags(_findings(changes)), ["security", "ci", "db", "deps"], ["ci"]).select("changeset_id", "flag_id")


@_rule("summary_by_area", f"{_FND} select changeset_id, string_agg(category || '=' || n, ',' order by category) as areas from (select changeset_id, category, count(*) as n from fnd group by 1, 2) group by 1")
def summary_by_area(changes: Changes) -> DataFrame:
    areas = F.array_join(F.transform(F.map_entries("areas"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return S.summary_by_area(_findings(changes)).select("changeset_id", areas.alias("areas"))


@_rule("facts_globs", f"select changeset_id, path, {any_sql('path', [P.glob_regex(g) for g in P.FACTS_GLOBS])} as excluded from allf")
def facts_globs(changes: Changes) -> DataFrame:
    return changes.files.select("changeset_id", "path", P.any_of(F.col("path"), [P.glob_regex(g) for g in P.FACTS_GLOBS]).alias("excluded"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    walks = ("chunk_by_budget", "chunk_files")
    return {name: sql.replace("with files_c", "with recursive files_c", 1) if name in walks else sql for name, sql in _SQL.items()}
