"""A company register read from the star-schema tables, by SELECTs that mean the same in Spark SQL and ANSI SQL.

links: a parent company holds a role in a child company. offices: active head offices. companies: what the trade register knows.
persons: directors by opaque key, never part of a result. legal_units: names and state. doc_lines: a published list of group
companies. batch_*: one delivery of changes. Rows are closed by a date, never deleted.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages")

_SIREN = "lpad(cast({} as string), 9, '0')"

VIEWS = {
    "links": f"""
        select {_SIREN.format('parent')} as parent, {_SIREN.format('child')} as child, role, opened, closed from (
            select o_custkey as parent,
                cast(floor(o_custkey / 40) as bigint) * 40 + case when pos < 40 then pos else 79 - pos end as child,
                case o_orderpriority when '1-URGENT' then '73' when '2-HIGH' then '30' when '3-MEDIUM' then '65' when '4-NOT SPECIFIED' then '11' else '71' end as role,
                cast(o_orderdate as date) as opened,
                case when o_orderstatus = 'F' then cast(o_orderdate as date) end as closed
            from (select *, o_custkey % 40 + 1 + o_orderkey % 13 as pos from orders) o) l
        where child in (select c_custkey from customer)""",
    "offices": f"""
        select {_SIREN.format('c_custkey')} as siren,
            concat({_SIREN.format('c_custkey')}, '00012') as siret,
            case when c_custkey % 17 = 0 then '[ND]' else concat(cast(c_custkey % 5 + 1 as string), ' RUE ', upper(n_name), ' ', cast(cast(floor(c_custkey / 40) as bigint) % 7 as string)) end as address_key,
            concat(case c_custkey % 6 when 0 then 'SARL ' when 1 then 'Sté ' when 2 then '' when 3 then 'Les ' when 4 then 'S.A. ' else '' end, p_name,
                case c_custkey % 5 when 0 then ' & Cie' when 1 then ' SAS' when 2 then ' Électricité' when 3 then '' else concat(' ', cast(c_custkey % 11 as string)) end) as name,
            cast(case c_custkey % 11 when 0 then 6540 when 1 then 6220 when 2 then 9220 when 3 then 3120 when 4 then null when 5 then 5560 else 5710 end as bigint) as cj,
            case c_mktsegment when 'AUTOMOBILE' then '64.20Z' when 'BUILDING' then '68.20B' when 'FURNITURE' then '47.11F' when 'HOUSEHOLD' then '70.22Z' else '25.62B' end as naf,
            case when c_acctbal < 0 then null when c_acctbal < 1000 then '00' when c_acctbal < 2000 then 'NN' when c_acctbal < 4000 then '02' when c_acctbal < 6000 then '11' when c_acctbal < 8000 then '21' else '42' end as band,
            upper(n_name) as town, concat(lpad(cast(c_custkey % 96 as string), 2, '0'), '100') as postcode
        from customer join nation on n_nationkey = c_nationkey join part on p_partkey = c_custkey
        where c_custkey % 29 <> 7""",
    "companies": f"""
        select {_SIREN.format('c_custkey')} as siren, concat('Société ', p_name) as denomination,
            case c_custkey % 4 when 0 then true when 1 then false end as commercial,
            case when c_custkey % 10 = 3 then true when c_custkey % 10 < 8 then false end as hidden,
            cast(case when c_acctbal < 0 then null else floor(c_acctbal / 500) end as bigint) as staff,
            cast('2020-01-01' as date) as opened, case when c_custkey % 23 = 5 then cast('2024-06-30' as date) end as closed,
            case when c_custkey % 19 = 4 then 'C' else 'A' end as state
        from customer join part on p_partkey = c_custkey""",
    "persons": f"""
        select {_SIREN.format('o_custkey')} as siren, concat('P', cast(l_suppkey as string)) as person,
            case l_linenumber % 5 when 0 then '73' when 1 then '30' when 2 then '65' when 3 then '53' else '11' end as role,
            case when l_linestatus = 'F' then cast(l_shipdate as date) end as closed
        from lineitem join orders on o_orderkey = l_orderkey""",
    "legal_units": f"""
        select {_SIREN.format('c_custkey')} as siren,
            case when c_custkey % 31 = 2 then null else concat(p_name, case when c_custkey % 3 = 0 then concat(' ', c_mktsegment) when c_custkey % 3 = 1 then concat(' ZONE ', cast(n_regionkey as string), ' SAS') else concat(' ZONE ', cast(n_regionkey as string), ' ', cast(c_custkey % 37 as string)) end) end as denomination,
            case when c_custkey % 7 = 1 then upper(concat(substr(p_name, 1, 1), substr(n_name, 1, 1), cast(c_custkey % 13 as string))) end as acronym,
            case when c_custkey % 6 = 4 then concat(p_brand, ' ', n_name) end as usual_name,
            cast(case when c_custkey % 41 = 11 then 1000 + c_custkey % 900 when c_custkey % 13 = 6 then null else 5499 + c_custkey % 300 end as bigint) as cj,
            case when c_acctbal < 0 then null when c_acctbal < 3000 then '00' when c_acctbal < 6000 then '11' else '32' end as band,
            case when c_custkey % 15 = 9 then 'C' else 'A' end as state, case when c_custkey % 43 = 20 then cast('2023-03-31' as date) end as closed
        from customer join nation on n_nationkey = c_nationkey join part on p_partkey = c_custkey""",
    "doc_lines": f"""
        select {_SIREN.format('s_suppkey % 5')} as doc, s_suppkey as line, concat(p_name, ' Zone ', cast(n_regionkey as string), case when s_suppkey % 3 = 1 then concat(' ', cast(s_suppkey % 37 as string)) else '' end) as name,
            upper(n_name) as town, case s_suppkey % 4 when 0 then 'IG' when 1 then 'MEE' when 2 then 'NC' else 'inconnue' end as method,
            cast(40 + s_suppkey % 60 as double) as rate, s_suppkey % 9 = 0 as needs_town, s_suppkey % 10 = 1 as fallback
        from supplier join nation on n_nationkey = s_nationkey join part on p_partkey = s_suppkey * 3""",
    "batch_companies": f"""
        select {_SIREN.format('user_id')} as siren, max(case when value < 20 then null else concat('Société ', event_type) end) as denomination,
            max(event_id) % 3 = 0 as commercial, cast(case when max(event_id) % 5 = 0 then null else max(event_id) % 400 end as bigint) as staff, max(event_id) % 17 = 0 as struck
        from events group by user_id""",
    "batch_links": f"""
        select distinct {_SIREN.format('o_custkey')} as parent, {_SIREN.format('cast(floor(o_custkey / 40) as bigint) * 40 + (o_custkey + o_orderkey) % 40')} as child,
            case o_orderpriority when '1-URGENT' then '73' when '2-HIGH' then '30' when '3-MEDIUM' then '65' when '4-NOT SPECIFIED' then '11' end as role
        from orders where o_orderstatus <> 'F'""",
    "records": f"""
        select {_SIREN.format('user_id')} as siren, concat('Nom ', event_type, ' ', cast(event_id % 100 as string)) as denomination, event_id % 2 = 0 as commercial, cast(floor(value) as bigint) as staff, ts as updated
        from events""",
    "decisions": f"""
        select {_SIREN.format('user_id')} as siren, case event_type when 'click' then 'retenir' when 'view' then 'ecarter' when 'purchase' then 'retenir' else 'autre' end as decision, ts as taken, event_id as number
        from events""",
    "batch_units": f"""
        select {_SIREN.format('user_id')} as siren, event_id as place, case when value < 20 then null else concat('Unité ', event_type) end as denomination,
            case when event_id % 4 = 1 then upper(substr(event_type, 1, 3)) end as acronym, case when event_id % 6 = 1 then event_type end as usual_name,
            cast(case event_id % 7 when 0 then null when 1 then 1000 else 5710 end as bigint) as cj, case event_id % 3 when 0 then '11' when 1 then '21' end as band,
            case event_id % 5 when 0 then 'C' when 4 then null else 'A' end as state, case when event_id % 2 = 0 then cast('2019-05-05' as date) end as stated, event_id % 9 = 2 as hidden
        from events""",
    "batch_offices": f"""
        select {_SIREN.format('user_id')} as siren, event_id as place, concat({_SIREN.format('user_id')}, '00099') as siret, '9 RUE NEUVE' as address_key, concat('Siège ', event_type) as name,
            cast(5710 as bigint) as cj, '70.22Z' as naf, case when event_id % 2 = 0 then '12' end as band, 'LILLE' as town, '59000' as postcode, event_id % 3 > 0 as active
        from events""",
    "journal": """
        select event_id as id, case event_id % 3 when 0 then 'arbre' else 'liens' end as source, case when event_id % 11 = 0 then 'en_cours' when event_id % 13 = 0 then 'echec' else 'succes' end as status,
            cast(case when event_id % 4 = 0 then null else floor(value) end as bigint) as added, cast(event_id % 3 as bigint) as closed
        from events""",
    "brands": """
        select distinct p_name as brand, p_brand, case when p_size % 2 = 0 then 'sure' else 'ambigue' end as kind from (select p_name, min(p_brand) as p_brand, min(p_size) as p_size from part group by p_name) p""",
}


def load(spark: SparkSession, sf_dir: str, names: tuple[str, ...] | None = None) -> dict[str, DataFrame]:
    """The register's tables, lazily; names of views of VIEWS."""
    names = names or tuple(VIEWS)
    text = " ".join(VIEWS[name] for name in names)
    for t in TABLES:
        if re.search(rf"\b{t}\b", text):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return {name: spark.sql(VIEWS[name]) for name in names}


def with_clause(*names: str, recursive: bool = False) -> str:
    """The same tables as common table expressions, for SQL beside the DataFrame operators."""
    return "WITH " + ("RECURSIVE " if recursive else "") + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
