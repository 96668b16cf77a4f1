"""Pieces of the SQL that queries are checked against: the normalised tables, and rule lists as CASE."""

from __future__ import annotations


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def any_sql(text: str, patterns: list[str]) -> str:
    return "(" + " or ".join(f"regexp_matches({text}, {q(p)})" for p in patterns) + ")"


def first_sql(text: str, rules: list[tuple[str, list[str]]], otherwise: str | None = None) -> str:
    whens = " ".join(f"when {any_sql(text, ps)} then {q(name)}" for name, ps in rules)
    return f"case {whens} else {q(otherwise) if otherwise else 'null'} end"


def prelude(made_up: str | None = None) -> str:
    """files_c, hunks_c: normalised tables. allf, chg: files and hunks of change sets, or of made-up hunks
    (SQL with changeset_id, path, status, hunk_ord, additions, deletions) in their place."""
    if made_up:
        both = f"""tmpl as ({made_up}),
    allf as (select changeset_id, path, min_by(status, hunk_ord) as status from tmpl group by changeset_id, path),
    rows_all as (select changeset_id, path, hunk_ord, additions, deletions from tmpl)"""
    else:
        both = """allf as (select changeset_id, path, coalesce(status, 'modified') as status from files_c),
    rows_all as (select changeset_id, path, hunk_ord, additions, deletions from hunks_c)"""
    return f"""with files_c as (select distinct changeset_id, path, ord, case lower(left(trim(status), 1)) when 'a' then 'added' when 'm' then 'modified' when 'd' then 'deleted' when 'r' then 'renamed' end as status, old_path from files),
    hunks_c as (select distinct hunk_id, changeset_id, path, hunk_ord, old_start, old_lines, new_start, new_lines, content,
        list_filter(coalesce(additions, []), lambda x: x is not null) as additions, list_filter(coalesce(deletions, []), lambda x: x is not null) as deletions from hunks),
    {both},
    chg as (select r.changeset_id, r.path, coalesce(f.status, 'modified') as status, r.hunk_ord, r.additions, r.deletions,
        array_to_string(r.additions, chr(10)) as add_text, array_to_string(r.deletions, chr(10)) as del_text,
        array_to_string(list_concat(r.additions, r.deletions), chr(10)) as all_text
        from rows_all r left join allf f on r.changeset_id = f.changeset_id and r.path = f.path)"""
