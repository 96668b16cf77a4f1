"""The SQL that findings, scores and reports are checked against, over the views allf and chg."""

from __future__ import annotations

from diffloom.operators import paths as P
from diffloom.operators import scoring as S
from diffloom.oracle import first_sql
from diffloom.plans import reports as R


def subquery(body: str) -> str:
    """A query body, which may begin with further common tables, as a subquery."""
    body = body.strip()
    return "(" + ("with " + body[1:] if body.startswith(",") else body) + ")"


def findings_ctes(bodies: dict[str, str]) -> str:
    """, parts..., fnd: the findings relation, from the SQL of the queries it is made of."""
    ctes = [f"part_{i} as (select {', '.join(S.part_columns(p))} from {subquery(bodies[p[0]])} x where {p[5]})" for i, p in enumerate(S.PARTS)]
    union = " union all ".join(f"select * from part_{i}" for i in range(len(S.PARTS)))
    return ", " + ",\n".join(ctes) + f",\nfnd as (select *, 'finding.' || type || '#' || substr(sha256(fingerprint), 1, 12) as finding_id from ({union}))"


def factors_cte() -> str:
    group = first_sql("path", P.CATEGORIES, "other")
    return f""", kinds as (select changeset_id, {', '.join(f"bool_or({group} = '{k}') as {k}" for k in ('docs', 'tests', 'config', 'product', 'infra', 'ci', 'dependencies'))},
        bool_or(status = 'modified' and regexp_matches(path, '/types\\.ts$|/core/.*\\.ts$|/index\\.ts$')) as core from allf group by 1),
    fac as (select * from (select changeset_id, {S.KIND} as kind, {S.WEIGHT} as weight, category, finding_id from (select *, {first_sql("coalesce(file, '')", P.CATEGORIES, 'other')} as place from fnd))
        union all select changeset_id, 'low-risk-category', case when product or infra or ci or dependencies then 0 when docs and not tests and not config then -15 when tests and not docs and not config then -10
            when config and not docs and not tests then -5 when docs or tests or config then -10 else 0 end, 'unknown', null from kinds
        union all select changeset_id, 'core-module-change', case when core then 10 else 0 end, 'unknown', null from kinds),
    factors as (select * from fac where weight <> 0)"""


SCORES = """select f.changeset_id, least(100, greatest(0, coalesce(total, 0)))::int as score, case when least(100, coalesce(total, 0)) >= 50 then 'high' when coalesce(total, 0) >= 20 then 'medium' else 'low' end as level, coalesce(n, 0)::int as factors
    from (select distinct changeset_id from allf) f left join (select changeset_id, sum(weight) as total, count(*) as n from factors group by 1) t on f.changeset_id = t.changeset_id"""


def flags_cte() -> str:
    hits = " union all ".join(f"select changeset_id, finding_id, '{key}' as rule_key, '{cat}' as flag_category, {score} as score, round({score} * {conf}::double)::int as effective_score, case when '{grain}' = 'row' then finding_id else '' end as of_ from fnd where {where}" for key, cat, score, conf, grain, where in S.FLAG_RULES)
    return f""", flags as (select changeset_id, rule_key, flag_category, score, effective_score, len(ids)::int as findings, 'flag.' || rule_key || '#' || substr(sha256(rule_key || ':' || array_to_string(ids, ',')), 1, 12) as flag_id
        from (select changeset_id, rule_key, flag_category, score, effective_score, list_sort(list(distinct finding_id)) as ids from ({hits}) group by changeset_id, rule_key, flag_category, score, effective_score, of_)),
    cats as (select s.changeset_id, c.flag_category, least(100, coalesce((select sum(effective_score) from flags g where g.changeset_id = s.changeset_id and g.flag_category = c.flag_category), 0))::int as category_score
        from (select distinct changeset_id from flags) s, (select unnest({S.FLAG_CATEGORIES!r}) as flag_category) c)"""


REPORT = """select r.changeset_id, overall, case when overall >= 81 then 'critical' when overall >= 61 then 'high' when overall >= 41 then 'elevated' when overall >= 21 then 'moderate' else 'low' end as level, flags from (
    select changeset_id, floor(0.6 * top[1] + 0.4 * (top[1] + top[2] + top[3]) / 3.0 + 0.5)::int as overall from (select changeset_id, list_sort(list(category_score), 'DESC') as top from cats group by 1)) r
    join (select changeset_id, count(*) as flags from flags group by 1) n on r.changeset_id = n.changeset_id"""
AGGREGATES = """select changeset_id, category, findings, risk_weight, row_number() over (partition by changeset_id order by risk_weight desc, findings desc, category)::int as place from (
    select c.changeset_id, c.category, findings, coalesce(w, 0)::bigint as risk_weight from (select changeset_id, category, count(*) as findings from fnd group by 1, 2) c
    left join (select changeset_id, category, sum(weight) as w from factors group by 1, 2) f on c.changeset_id = f.changeset_id and c.category = f.category)"""
_ORDER = "case type " + " ".join(f"when '{t}' then {i}" for i, t in enumerate(S.TOP_TYPES)) + " end"
TOP = f"""select changeset_id, type, findings, examples, rest, place from (select *, row_number() over (partition by changeset_id order by o)::int as place from (
    select changeset_id, type, {_ORDER} as o, count(*) as findings, array_to_string(list_sort(list(distinct coalesce(file, name, detail, '')))[1:5], ',') as examples, greatest(0, count(distinct coalesce(file, name, detail, '')) - 5)::int as rest
    from fnd where {_ORDER} is not null group by 1, 2, 3)) where place <= 5"""
DEPENDENCIES = """select changeset_id, section, impact, count(distinct name) as packages, array_to_string(list_sort(list(distinct name))[1:5], ',') as names, count(detail) as risky
    from (select changeset_id, risk as section, change as impact, name, detail from fnd where type = 'dependency-change') group by 1, 2, 3"""
BY_TYPE = "select changeset_id, type, count(*) as findings from fnd group by 1, 2"


def told_cte() -> str:
    lists = lambda c, where, sep: f"coalesce(string_agg(distinct {c}, '{sep}' order by {c}) filter (where {where}), '')"
    columns = [f"count(*) filter (where {w}) as {k}" for k, w in R.COUNTS.items()] + [f"{lists(*v)} as {k}" for k, v in R.LISTS.items()] + [f"coalesce(sum({e}) filter (where {w}), 0)::bigint as {k}" for k, (e, w) in R.SUMS.items()]
    return ", told as (select changeset_id, " + ", ".join(columns) + ", count(distinct split_part(name, '.', 1)) filter (where type like 'stencil-%') as stencil_tags from fnd group by 1)"


def highlights_sql() -> str:
    rows = " union all ".join(f"select changeset_id, {text} as highlight, {p} as priority, {i} as ord from told where {c}" for i, (c, text, p) in enumerate(R.HIGHLIGHTS))
    return f"{told_cte()} select changeset_id, highlight, priority, row_number() over (partition by changeset_id order by priority desc, ord)::int as place from ({rows})"


def actions_sql(profiles: str) -> str:
    rows = " union all ".join(f"select changeset_id, '{i}' as action, '{cat}' as category, {b} as blocking, {reason} as reason, {t} as triggers from both_ where {c}" for i, cat, c, b, reason, t in R.ACTIONS)
    return f"{told_cte()}, both_ as (select t.*, p.profile from told t left join {subquery(profiles)} p on t.changeset_id = p.changeset_id) select *, row_number() over (partition by changeset_id order by blocking desc, action)::int as place from ({rows})"


def results_sql() -> str:
    return " union ".join(f"select changeset_id, '{i}' as rule_id, '{level}' as level, coalesce(file, split_part(coalesce(detail, ''), ',', 1)) as uri, finding_id from fnd where {where}" for i, _, _, level, _, where in R.LOG_RULES)
