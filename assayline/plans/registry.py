"""Registry of queries. Each is a function of (spark, folder of the tables), with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The input views as DuckDB SQL; fixtures.py has the same ones as DataFrames.
VIEWS = {
    "v_records": "select o_orderkey as record_id, concat(o_custkey, '|', o_orderpriority) as key, (o_orderstatus = 'F')::int as label, o_orderpriority as domain, o_custkey::varchar as grp, concat('e', o_orderkey % 3) as endpoint, o_totalprice as price from orders",
    "v_docs": "select d.doc_id as record_id, d.text, l.quality as label, d.lang as domain, d.source as grp from documents d left join (select doc_id, max(quality) as quality from labels group by doc_id) l using (doc_id)",
    "v_pred": "select (l_returnflag = 'R')::int as label, round(l_discount * 10, 1) as proba, l_linestatus as experiment, l_suppkey::varchar as grp, l_quantity / 50 as proba_b from lineitem",
    "v_events": "select event_id as record_id, (event_type = 'purchase')::int as label, least(value / 500, 1.0) as proba, concat('u', user_id % 10) as experiment, ('0x' || substr(md5(event_id::varchar), 1, 8))::bigint / 4294967296.0::double as proba_b from events",
    "v_vec": "select vec_id as record_id, embedding::double[] as v, (label >= 5)::int as label, case when vec_id % 5 <> 0 then 'train' else 'test' end as split from embeddings",
}


def draw_sql(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::bigint"


def query(name: str, sql: str | None = None, *views: str):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = f"with {', '.join(f'{v} as ({VIEWS[v]})' for v in views)} {', ' if sql.lstrip().startswith('+') else ''}{sql.lstrip().removeprefix('+')}" if views else sql
        return f

    return add
