"""Queries of nested-record shredding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import shred
from ..session import table


def _bridge(spark: SparkSession, d: str, between: bool = True) -> DataFrame:
    return shred.shred(table(spark, d, "demo_case"), table(spark, d, "demo_scenario"), between)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _bridge(spark, d, False).select("tab", "parent_id", "node", "key1", "key2")


def p3_links(spark: SparkSession, d: str) -> DataFrame:
    return shred.links(_bridge(spark, d))


def p3_objects(spark: SparkSession, d: str) -> DataFrame:
    return shred.objects(_bridge(spark, d))


def p3_sharing(spark: SparkSession, d: str) -> DataFrame:
    return shred.sharing(_bridge(spark, d))


QUERIES = {f.__name__: f for f in (p3_found, p3_links, p3_objects, p3_sharing)}

_PLACED = "select '{tab}' as tab, id as parent_id, '{node}' as node, (i - 1)::varchar as key1, '' as key2 from (select id, unnest(v) as x, generate_subscripts(v, 1) as i from (select distinct {key} as id, {path} as v from {tab})) where x is not null"
_MAPPED = "select '{tab}' as tab, id as parent_id, '{node}' as node, e.key as key1, '' as key2 from (select id, unnest(map_entries(v)) as e from (select distinct {key} as id, {path} as v from {tab})) where e.value is not null"


def _sql(template: str, tab: str, key: str, node: str, path: str) -> str:
    return template.format(tab=tab, key=key, node=node, path=path)


_O = "osce_examination"
ORACLE = {
    "p3_found": " union all ".join(
        [
            _sql(_PLACED, "demo_case", "case_id", "roles", "agent_structure.roles"),
            _sql(_PLACED, "demo_case", "case_id", "tools_called", "tools_called"),
            _sql(_MAPPED, "demo_case", "case_id", "example_reasoning", "example_reasoning"),
            _sql(_PLACED, "demo_scenario", "scenario_id", "secondary_symptoms", f"{_O}.patient_actor.symptoms.secondary_symptoms"),
            _sql(_MAPPED, "demo_scenario", "scenario_id", "physical_examination_findings", f"{_O}.physical_examination_findings"),
            _sql(_MAPPED, "demo_scenario", "scenario_id", "chexpert_labels", f"{_O}.chexpert_labels"),
            f"select 'demo_scenario' as tab, id as parent_id, 'test_results' as node, k as key1, e.key as key2 from (select id, k, unnest(map_entries(m)) as e from (select id, o.key as k, o.value as m from (select id, unnest(map_entries(v)) as o from (select distinct scenario_id as id, {_O}.test_results as v from demo_scenario)))) where e.value is not null",
            f"""select * from (with h as (select distinct scenario_id as id, {_O}.patient_actor.history as t from demo_scenario where trim({_O}.patient_actor.history, ' ' || chr(9) || chr(10) || chr(13)) != ''),
 j as (select id, t, case when regexp_matches(t, '^\\s*[\\[{{]') and json_valid(t) then t::json end as v from h),
 a as (select id, case when json_type(v) = 'ARRAY' then v else v -> 'episodes' end as v from j where v is not null),
 items as (select id, unnest(from_json(v, '["json"]')) as x, generate_subscripts(from_json(v, '["json"]'), 1) - 1 as i from a where json_type(v) = 'ARRAY'),
 f as (select id, i, unnest(from_json(x -> 'findings', '["json"]')) as y, generate_subscripts(from_json(x -> 'findings', '["json"]'), 1) - 1 as k from items where json_type(x) = 'OBJECT' and json_type(x -> 'findings') = 'ARRAY')
 select 'demo_scenario' as tab, id as parent_id, 'history' as node, '0' as key1, '' as key2 from j where v is null
 union all select 'demo_scenario', id, 'history', i::varchar, '' from items where x is not null and json_type(x) != 'NULL'
 union all select 'demo_scenario', id, 'history.findings', i::varchar, k::varchar from f where y is not null and json_type(y) != 'NULL')""",
        ]
    ),
}

# Every child with its value, from which the distinct subtrees of each level are counted without hashes.
_ARRAY = "select '{tab}' as tab, id, '{node}' as node, (i - 1)::varchar as k1, '' as k2, x::varchar as v from (select id, unnest(v) as x, generate_subscripts(v, 1) as i from (select distinct {key} as id, {path} as v from {tab})) where x is not null"
_MAP = "select '{tab}' as tab, id, '{node}' as node, e.key as k1, '' as k2, e.value as v from (select id, unnest(map_entries(v)) as e from (select distinct {key} as id, {path} as v from {tab})) where e.value is not null"
_CHILDREN = " union all ".join(
    [
        _sql(_ARRAY, "demo_case", "case_id", "roles", "agent_structure.roles"),
        _sql(_ARRAY, "demo_case", "case_id", "tools_called", "tools_called"),
        _sql(_MAP, "demo_case", "case_id", "example_reasoning", "example_reasoning"),
        _sql(_ARRAY, "demo_scenario", "scenario_id", "secondary_symptoms", f"{_O}.patient_actor.symptoms.secondary_symptoms"),
        _sql(_MAP, "demo_scenario", "scenario_id", "physical_examination_findings", f"{_O}.physical_examination_findings"),
        _sql(_MAP, "demo_scenario", "scenario_id", "chexpert_labels", f"{_O}.chexpert_labels"),
        f"select 'demo_scenario', id, 'test_results', k, e.key, e.value from (select id, k, unnest(map_entries(m)) as e from (select id, o.key as k, o.value as m from (select id, unnest(map_entries(v)) as o from (select distinct scenario_id as id, {_O}.test_results as v from demo_scenario)))) where e.value is not null",
        "select 'demo_scenario', id, 'history', '0', '', t from j where v is null",
        "select 'demo_scenario', id, 'history', i::varchar, '', case json_type(x) when 'VARCHAR' then x ->> '$' else x::varchar end from items where x is not null and json_type(x) != 'NULL'",
        "select 'demo_scenario', id, 'history.findings', i::varchar, k::varchar, case json_type(y) when 'VARCHAR' then y ->> '$' else y::varchar end from f where y is not null and json_type(y) != 'NULL'",
    ]
)
_JOINED = "string_agg(k1 || chr(31) || k2 || chr(31) || v, chr(30) order by k1, k2)"
ORACLE["p3_sharing"] = f"""
with h as (select distinct scenario_id as id, {_O}.patient_actor.history as t from demo_scenario where trim({_O}.patient_actor.history, ' ' || chr(9) || chr(10) || chr(13)) != ''),
j as (select id, t, case when regexp_matches(t, '^\\s*[\\[{{]') and json_valid(t) then t::json end as v from h),
a as (select id, case when json_type(v) = 'ARRAY' then v else v -> 'episodes' end as v from j where v is not null),
items as (select id, unnest(from_json(v, '["json"]')) as x, generate_subscripts(from_json(v, '["json"]'), 1) - 1 as i from a where json_type(v) = 'ARRAY'),
f as (select id, i, unnest(from_json(x -> 'findings', '["json"]')) as y, generate_subscripts(from_json(x -> 'findings', '["json"]'), 1) - 1 as k from items where json_type(x) = 'OBJECT' and json_type(x -> 'findings') = 'ARRAY'),
child as ({_CHILDREN}),
coll as (select tab, id, node, {_JOINED} as v from child where node != 'history.findings' group by all),
mid as (select tab, id, node, k1, {_JOINED} as v from child where node in ('test_results', 'history.findings') group by all),
ids as (select distinct 'demo_case' as tab, case_id as id from demo_case union all select distinct 'demo_scenario', scenario_id from demo_scenario),
rec as (select tab, id, coalesce(string_agg(node || chr(29) || v, chr(28) order by node), '') as v from ids left join coll using (tab, id) group by tab, id),
everything as (select tab, 'child' as level, node, v from child union all select tab, 'collection', node, v from coll union all select tab, 'inner', node, regexp_replace(v, '(^|\\x1e)[^\\x1f]*\\x1f', '\\1', 'g') from mid union all select tab, 'record', '', v from rec)
select tab, level, node, count(*) as occurrences, count(distinct v) as objects from everything group by tab, level, node"""
