"""Registered queries: each is a statement of the dialect, with the same question in DuckDB's SQL."""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..operators import as_of, in_column, lateral_json, top_k
from ..sources import read_table, write_table
from ..streaming import joined_within, session_counts, windowed_counts, without_repeats

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: name: (statement, DuckDB SQL, or None where the statement itself is right).
STATEMENTS: dict[str, tuple[str, str | None]] = {
    "scan_project": ("select n_nationkey, n_name from nation", None),
    "star": ("select * from nation", None),
    "qualified_star": ("select n.* from nation as n, region as r where n.n_regionkey = r.r_regionkey", None),
    "no_from": ("select 1 as a, 'x' as b, 2.5 as c, null is null as d", None),
    "filter_cmp": ("select l_orderkey, l_linenumber from lineitem where l_quantity >= 30 and l_discount < 0.05 and l_returnflag <> 'N'", None),
    "filter_bool": ("select p_partkey from part where not (p_size > 10 or p_retailprice < 950.5) and p_brand is not null", None),
    "filter_like": ("select p_partkey, p_name from part where p_name like '%a%'", None),
    "filter_not_like": ("select c_custkey from customer where c_mktsegment not like 'B%' and c_name like 'C_stomer%'", None),
    "filter_in": ("select p_partkey from part where p_size in (1, 5, 9)", None),
    "filter_not_in": ("select c_custkey from customer where c_mktsegment not in ('BUILDING', 'MACHINERY')", None),
    "filter_between": ("select o_orderkey from orders where o_totalprice between 1000 and 50000", None),
    "filter_is_null": ("select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey where o_orderkey is null", None),
    "filter_regex": ("select p_partkey from part where p_name ~ '^[a-m]' and p_type !~* 'zzz'", "select p_partkey from part where regexp_matches(p_name, '^[a-m]') and not regexp_matches(p_type, '(?i)zzz')"),
    "arith": ("select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) + l_tax / 2 - 3, 4) as v, 10 - 3 - 2 as w, 8 / 4 / 2 as x from lineitem", "select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) + l_tax / 2 - 3, 4) as v, 10 - 3 - 2 as w, 8 / 4 / 2 as x from lineitem"),
    "bitops": ("select n_nationkey, (n_nationkey & 6) | 1 as a, n_nationkey << 2 as b, n_nationkey >> 1 as c, ~n_nationkey as d from nation", None),
    "power_op": ("select n_nationkey, n_nationkey ^ 2 as p, 2 ^ 3 ^ 2 as q from nation", "select n_nationkey, power(n_nationkey, 2) as p, power(power(2, 3), 2) as q from nation"),
    "xor_op": ("select n_nationkey, n_nationkey # 5 as x from nation", "select n_nationkey, xor(n_nationkey, 5) as x from nation"),
    "modulo": ("select o_orderkey, (o_orderkey - 500) % 7 as m from orders", None),
    "concat_op": ("select n_name || '-' || n_name as s from nation", None),
    "precedence": ("select n_nationkey, 1 + 2 * 3 - 4 as a, -2 + 5 as b, n_nationkey = 3 or n_nationkey > 5 and n_nationkey < 9 as c, not n_nationkey = 4 as d from nation", None),
    "case_searched": ("select p_partkey, case when p_size < 10 then 'small' when p_size < 30 then 'mid' else 'big' end as c from part", None),
    "case_simple": ("select o_orderkey, case o_orderstatus when 'F' then 1 when 'O' then 2 end as c from orders", None),
    "cast_varchar": ("select cast(n_nationkey as VARCHAR(5)) as s, n_nationkey::text || 'x' as t, '12'::int4 + 1 as u, cast('1.5' as double precision) as v from nation", None),
    "str_funcs": ("select lower(n_name) as l, upper(n_name) as u, length(n_name) as n, substring(n_name, 2, 3) as s, replace(n_name, 'A', 'b') as r, strpos(n_name, 'A') as p from nation", None),
    "math_funcs": ("select s_suppkey, round(abs(s_acctbal), 2) as a, floor(s_acctbal)::bigint as f, ceil(s_acctbal)::bigint as c, sign(s_acctbal) as s, round(log(1000), 6) as l, |/ 16.0 as q, @ (-3) as z from supplier", "select s_suppkey, round(abs(s_acctbal), 2) as a, floor(s_acctbal)::bigint as f, ceil(s_acctbal)::bigint as c, sign(s_acctbal)::double as s, round(log10(1000), 6) as l, sqrt(16.0::double) as q, 3 as z from supplier"),
    "trim_func": ("select trim(both 'A' from n_name) as a, trim(leading 'A' from n_name) as b, trim(trailing 'A' from n_name) as c, trim('  x ') as d from nation", "select trim(n_name, 'A') as a, ltrim(n_name, 'A') as b, rtrim(n_name, 'A') as c, 'x' as d from nation"),
    "position_func": ("select position('A' in n_name) as p from nation", None),
    "concat_nulls": ("select concat(n_name, null, '-', n_nationkey) as c, n_name || null as d from nation", "select concat(n_name, null, '-', n_nationkey) as c, null::varchar as d from nation"),
    "conditional": ("select n_nationkey, coalesce(null, n_name) as a, nullif(n_nationkey, 3) as b, greatest(n_nationkey, 4) as c, least(n_nationkey, 4) as d from nation", None),
    "dates": ("select o_orderkey, extract(year from o_orderdate) as y, date_trunc('month', o_orderdate)::date as m from orders where o_orderdate >= date '1995-01-01'", None),
    "system_funcs": ("select current_schema() as s, version() as v", "select 'public' as s, 'PostgreSQL 9.6.0' as v"),
    "join_inner": ("select c_name, n_name from customer inner join nation on c_nationkey = n_nationkey", None),
    "join_left": ("select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey and o_totalprice > 100000", None),
    "join_right": ("select c_custkey, o_orderkey from orders right outer join customer on c_custkey = o_custkey", None),
    "join_full": ("select s_suppkey, c_custkey from supplier full outer join customer on s_suppkey = c_custkey and s_nationkey = c_nationkey", None),
    "join_theta": ("select r_name, n_name from region join nation on r_regionkey <= n_nationkey", None),
    "join_theta_left": ("select r_name, n_name from region left join nation on r_regionkey > n_nationkey + 2", None),
    "join_expr_key": ("select n.n_name as a, r.r_name as b from nation n join region r on (n.n_nationkey + 1) % 5 = r.r_regionkey", None),
    "join_multi_key": ("select l1.l_orderkey as k, l1.l_linenumber as n, l2.l_quantity as q from lineitem l1 join lineitem l2 on l1.l_orderkey = l2.l_orderkey and l1.l_linenumber = l2.l_linenumber", None),
    "join_on_filter_left": ("select n_name, r_name from nation left join region on n_regionkey = r_regionkey and n_nationkey > 10 and r_name <> 'ASIA'", None),
    "join_comma": ("select n_name, r_name from nation, region where n_regionkey = r_regionkey and r_name like 'A%'", None),
    "join_comma3": ("select c_custkey, n_name, r_name from customer, nation, region where c_nationkey = n_nationkey and n_regionkey = r_regionkey", None),
    "join_cross": ("select a.r_name as x, b.r_name as y from region a cross join region b", None),
    "join_self": ("select a.n_name as x, b.n_name as y from nation as a, nation as b where a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey", None),
    "join_using": ("select n_nationkey, a.n_name as x from nation a join nation b using (n_nationkey)", None),
    "join_semi": ("select c_custkey from customer left semi join orders on c_custkey = o_custkey", "select c_custkey from customer where c_custkey in (select o_custkey from orders)"),
    "join_anti": ("select c_custkey from customer left anti join orders on c_custkey = o_custkey", "select c_custkey from customer where c_custkey not in (select o_custkey from orders)"),
    "agg_group": ("select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as s, round(avg(l_extendedprice), 4) as a, min(l_tax) as lo, max(l_tax) as hi from lineitem group by l_returnflag, l_linestatus", None),
    "agg_alias": ("select p_size % 5 as g, count(*) as n from part group by g", None),
    "agg_ordinal": ("select p_brand, max(p_size) as m from part group by 1", None),
    "agg_expr_key": ("select p_size + 1 as k, count(*) as n from part group by p_size + 1", None),
    "agg_constant_key": ("select count(*) as n from part group by 1 = 1", "select count(*) as n from part"),
    "agg_global": ("select count(*) as n, round(sum(o_totalprice), 2) as s from orders", None),
    "agg_empty_global": ("select count(*) as n, sum(o_totalprice) as s from orders where o_totalprice < -1", None),
    "agg_expr_over_agg": ("select p_brand, round(sum(p_retailprice) / count(*) + 1, 4) as v, 7 as k from part group by p_brand", None),
    "agg_having": ("select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 12", None),
    "agg_distinct": ("select count(distinct l_partkey) as p, count(distinct l_suppkey) as s from lineitem", None),
    "agg_group_only": ("select p_brand from part group by p_brand", None),
    "agg_stats": ("select p_brand, round(stddev_samp(p_retailprice), 4) as a, round(stddev_pop(p_retailprice), 4) as b, round(var_samp(p_size), 4) as c, round(var_pop(p_size), 4) as d from part group by p_brand", None),
    "agg_bool": ("select p_brand, every(p_size > 0) as a, some(p_size > 49) as b, any(p_size > 50) as c from part group by p_brand", "select p_brand, bool_and(p_size > 0) as a, bool_or(p_size > 49) as b, bool_or(p_size > 50) as c from part group by p_brand"),
    "agg_filter": ("select count(*) filter (where p_size > 25) as n, sum(p_size) filter (where p_brand <> 'x')::bigint as s from part", None),
    "agg_collect": ("select n_regionkey, array_join(sort_array(collect(n_name)), ',') as c from nation group by n_regionkey", "select n_regionkey, string_agg(n_name, ',' order by n_name) as c from nation group by n_regionkey"),
    "agg_rollup": ("select l_returnflag, l_linestatus, count(*) as n from lineitem group by rollup (l_returnflag, l_linestatus)", None),
    "agg_cube": ("select l_returnflag, l_linestatus, count(*) as n from lineitem group by cube (l_returnflag, l_linestatus)", None),
    "agg_grouping_sets": ("select l_returnflag, l_linestatus, count(*) as n from lineitem group by grouping sets ((l_returnflag), (l_linestatus), ())", None),
    "sort_limit": ("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey asc limit 10", None),
    "sort_offset": ("select o_orderkey from orders order by o_orderkey asc limit 10 offset 20", None),
    "sort_ordinal": ("select o_custkey, o_orderkey from orders order by 1 asc, 2 desc", None),
    "sort_expr": ("select c_custkey from customer order by 0 - c_acctbal asc, c_custkey asc", None),
    "fetch_first": ("select c_custkey from customer order by c_custkey asc fetch first 5 rows only", None),
    "distinct_rows": ("select distinct p_brand, p_size from part", None),
    "distinct_on": ("select distinct on (o_custkey) o_custkey, o_orderkey from orders order by o_custkey asc, o_totalprice desc, o_orderkey asc", None),
    "topk_per_group": ("select o_custkey, o_orderkey, r from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey asc) as r from orders) t where r <= 3", None),
    "union_all": ("select n_name as x from nation union all select r_name from region", None),
    "union_distinct": ("select p_brand as x from part union select p_type from part", None),
    "intersect": ("select c_nationkey as k from customer intersect select s_nationkey from supplier", None),
    "except": ("select n_nationkey as k from nation except select s_nationkey from supplier where s_suppkey < 6", None),
    "cte_chain": ("with a as (select p_brand as b, p_size as s from part), c as (select b, sum(s)::bigint as t from a group by b) select b, t from c where t > 0", None),
    "subquery_from": ("select b, n from (select p_brand as b, count(*) as n from part group by p_brand) as t where n > 3", None),
    "subquery_scalar": ("select o_orderkey from orders where o_totalprice > (select avg(o_totalprice) * 1.5 from orders)", None),
    "subquery_exists": ("select c_custkey from customer c where exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_totalprice > 200000)", None),
    "subquery_in": ("select n_name from nation where n_nationkey in (select s_nationkey from supplier)", None),
    "subquery_correlated": ("select p_partkey from part p where p_retailprice > (select avg(q.p_retailprice) from part q where q.p_brand = p.p_brand)", None),
    "window_rank": ("select o_orderkey, rank() over (partition by o_orderstatus order by o_totalprice desc) as r, dense_rank() over (partition by o_orderpriority order by o_custkey asc) as d from orders", None),
    "window_running_sum": ("select o_orderkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderkey asc), 2) as s from orders", None),
    "window_lag": ("select o_orderkey, lag(o_orderkey) over (partition by o_custkey order by o_orderkey asc) as p, lead(o_orderkey, 1) over (partition by o_custkey order by o_orderkey asc) as n from orders", None),
    "window_frame": ("select o_orderkey, count(*) over (partition by o_custkey order by o_orderkey asc rows between 2 preceding and current row) as n from orders", None),
    "json_each_events": ("select e.event_id, j.key as k, cast(j.value as bigint) as v from events e, lateral json_each(e.props::json) j", "select e.event_id, j.key as k, cast(j.value as bigint) as v from events e, json_each(e.props) j"),
    "json_array_lateral": ("select b.key as k, b.value::text as v from json_array_elements('[{\"foo\": \"bar\"}, {\"a\": \"b\"}]'::json) as x, lateral json_each(x.value) as b", "select 'foo' as k, 'bar' as v union all select 'a', 'b'"),
    "json_arrow": ("select event_id, (props::json ->> 'k')::bigint as v from events", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as v from events"),
    "generate_series": ("select generate_series as v from generate_series(1, 20, 3)", None),
    "values_list": ("select a, b from (values (1, 'x'), (2, 'y')) as t(a, b)", None),
    "json_dotted": ("select event_id, ('{\"a.b\":1,\"a\":{\"b\":2}}'::json ->> 'a.b')::bigint as v from events", "select event_id, 1::bigint as v from events"),
    "trunc_func": ("select l_orderkey, l_linenumber, trunc(0 - l_extendedprice / 7) as a, trunc(l_tax * 10) as b from lineitem", None),
    "agg_ordered": ("select n_regionkey, string_agg(n_name, ',' order by n_nationkey desc) as c from nation group by n_regionkey", None),
    "case_null": ("select n_nationkey, case when null then 1 else 2 end as v from nation", None),
    "unreserved_names": ("select range + 1 as v, rows from (select n_nationkey as range, n_name as rows from nation) t", "select n_nationkey + 1 as v, n_name as rows from nation"),
    "cast_round": ("select l_orderkey, l_linenumber, cast(l_extendedprice / 7 as bigint) as a, cast(1.5 as int) as b, cast(-2.5 as int) as c, l_tax::int as d from lineitem", None),
    "distinct_on_hidden": ("select distinct on (o_custkey) o_orderkey, o_totalprice from orders order by o_custkey asc, o_totalprice desc, o_orderkey asc", None),
    "distinct_on_alias": ("select distinct on (g) p_size % 5 as g, p_partkey from part order by g asc, p_partkey desc", None),
    "distinct_sort_limit": ("select distinct p_brand, p_size from part order by p_size desc, p_brand asc limit 7", None),
    "subquery_any": ("select s_suppkey from supplier where s_nationkey = any (select n_nationkey from nation where n_regionkey = 1) or s_acctbal <= some (select c_acctbal from customer where c_nationkey = 3)", None),
    "subquery_all": ("select p_partkey from part where p_size >= all (select q.p_size from part q) or p_size <> all (select o_custkey from orders) or p_size > all (select o_custkey from orders where o_custkey < 0)", None),
    "cte_recursive": ("with recursive t(v) as (select 1 as v union all select v + 1 from t where v < 20) select v, n_name from t join nation on n_nationkey = v", None),
    "substring_from": ("select n_nationkey, substring(n_name from 2 for 3) as a, substring(n_name from 3) as b, substring(n_name for 2) as c, substring(n_name, 2, 2) as d from nation", "select n_nationkey, substring(n_name, 2, 3) as a, substring(n_name, 3) as b, substring(n_name, 1, 2) as c, substring(n_name, 2, 2) as d from nation"),
    "overlay_func": ("select n_nationkey, overlay(n_name placing '--' from 2 for 3) as a, overlay(n_name placing '++' from 2) as b from nation", "select n_nationkey, substring(n_name, 1, 1) || '--' || substring(n_name, 5) as a, substring(n_name, 1, 1) || '++' || substring(n_name, 4) as b from nation"),
    "json_path": ("select event_id, ('{\"a\": [10, {\"b c\": 20}]}'::json #>> '{a,1,b c}')::bigint as v, (props::json #>> '{k}')::bigint as k from events", "select event_id, 20::bigint as v, cast(json_extract_string(props, '$.k') as bigint) as k from events"),
    "agg_within_group": ("select o_orderstatus, round(percentile_cont(0.5) within group (order by o_totalprice), 4) as m, percentile_disc(0.25) within group (order by o_totalprice desc) as q from orders group by o_orderstatus", "select o_orderstatus, round(quantile_cont(o_totalprice, 0.5), 4) as m, percentile_disc(0.25) within group (order by o_totalprice desc) as q from orders group by o_orderstatus"),
    "position_args": ("select n_nationkey, position('A', n_name) as a, position('A' in n_name) as b from nation", "select n_nationkey, instr(n_name, 'A') as a, instr(n_name, 'A') as b from nation"),
    "array_funcs": ("select n_nationkey, size(split(n_name, 'A')) as n, array_contains(array(n_regionkey, 1), 1) as c, element_at(array(n_name, 'x'), 2) as e from nation", "select n_nationkey, len(string_split(n_name, 'A')) as n, true as c, 'x' as e from nation"),
    "map_funcs": ("select n_nationkey, element_at(map('a', n_name, 'b', 'y'), 'a') as m, size(map_keys(map('a', 1, 'b', 2))) as k from nation", "select n_nationkey, n_name as m, 2 as k from nation"),
    "null_logic": ("select n_nationkey, (null and n_nationkey > 3) as a, (null or n_nationkey > 3) as o, not (n_nationkey > null) as c from nation", "select n_nationkey, (null and n_nationkey > 3) as a, (null or n_nationkey > 3) as o, cast(null as boolean) as c from nation"),
    "window_range": ("select o_orderkey, count(*) over (partition by o_orderstatus order by o_custkey asc range between 5 preceding and current row) as n, count(*) filter (where o_totalprice > 100000) over (partition by o_orderstatus) as f from orders", None),
    "hint_broadcast": ("select /*+ broadcast(r) */ n_name, r_name from nation n join region r on n_regionkey = r_regionkey", "select n_name, r_name from nation join region on n_regionkey = r_regionkey"),
    "subquery_unaliased": ("select b, n from (select p_brand as b, count(*) as n from part group by p_brand)", None),
    "pg_namespace_owners": ("select nspname, nspowner from pg_namespace", "select unnest(['public', 'pg_catalog', 'information_schema']) as nspname, 0 as nspowner"),
    "pg_namespace": ("select nspname from pg_namespace order by nspname asc", "select unnest(['public', 'pg_catalog', 'information_schema']) as nspname"),
    "quoted_names": ("select \"n_name\" as \"the name\" from nation as \"t\" where \"t\".\"n_nationkey\" > 3", None),
    "filter_not_greater": ("select p_partkey from part where p_size !> 10 and p_size !< 3", "select p_partkey from part where p_size <= 10 and p_size >= 3"),
    "filter_constant": ("select r_name from region where 1 = 1", None),
    "filter_escape": ("select c_custkey from customer where c_name not like '%!_%' escape '!' and c_mktsegment ilike 'b%'", None),
    "filter_similar": ("select p_partkey from part where p_name similar to '[a-m]%' and p_brand not similar to 'x.%'", "select p_partkey from part where regexp_full_match(p_name, '[a-m].*') and not regexp_full_match(p_brand, 'x[.].*')"),
    "filter_is_true": ("select n_nationkey, (n_nationkey > 3) is true as t, n_nationkey is distinct from null as d from nation", None),
    "join_theta_right": ("select r_name, n_name from region right join nation on r_regionkey > n_nationkey", None),
    "join_natural": ("select n_nationkey, n_name from nation a natural join (select n_nationkey from nation where n_regionkey = 1) b", None),
    "join_comma_one_sided": ("select n_name, r_name from nation, region where n_nationkey > 20", None),
    "join_equi_theta": ("select a.n_name as x, b.n_name as y from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey", None),
    "join_on_functions": ("select n_name, r_name from nation join region on substring(n_name, 1, 1) = substring(r_name, 1, 1) and case when n_nationkey > 5 then 1 else 0 end = 1", None),
    "agg_all_quantifier": ("select count(all p_size) as n, COUNT(p_brand) as m, SUM(p_size)::bigint as s from part", None),
    "agg_first_value": ("select n_regionkey, first_value(n_name order by n_nationkey asc) as f from nation group by n_regionkey", "select n_regionkey, arg_min(n_name, n_nationkey) as f from nation group by n_regionkey"),
    "agg_fusion": ("select n_regionkey, array_join(sort_array(fusion(array(n_name, 'x'))), ',') as f, array_join(intersection(array('x', n_name)), ',') as i from nation group by n_regionkey", "select n_regionkey, list_aggregate(list_sort(flatten(list([n_name, 'x']))), 'string_agg', ',') as f, 'x' as i from nation group by n_regionkey"),
    "agg_of_join": ("select r_name, count(*) as n, count(distinct c_mktsegment) as m from customer, nation, region where c_nationkey = n_nationkey and n_regionkey = r_regionkey group by r_name having count(*) > 1 order by n desc, r_name asc", None),
    "window_named": ("select o_orderkey, row_number() over w as r, count(*) over w as n from orders window w as (partition by o_custkey order by o_orderkey asc)", None),
    "window_distribution": ("select o_orderkey, ntile(4) over (order by o_orderkey asc) as q, round(percent_rank() over (partition by o_orderstatus order by o_orderkey asc), 6) as p, round(cume_dist() over (partition by o_orderstatus order by o_orderkey asc), 6) as c from orders", None),
    "window_over_aggregate": ("select o_custkey, sum(o_totalprice) > 0 as p, rank() over (order by count(*) desc) as r from orders group by o_custkey", None),
    "window_values": ("select o_orderkey, first_value(o_orderkey) over (partition by o_custkey order by o_orderkey asc) as f, nth_value(o_orderkey, 2) over (partition by o_custkey order by o_orderkey asc) as s from orders", None),
    "limit_all": ("select r_name from region order by r_name asc limit all", None),
    "offset_only": ("select n_nationkey from nation order by n_nationkey asc offset 20", None),
    "sort_nulls_first": ("select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey and o_totalprice > 200000 order by o_orderkey asc nulls first, c_custkey asc", None),
    "cte_nested": ("with a as (with b as (select p_brand as x from part) select x from b) select x, count(*) as n from a group by x", None),
    "subquery_lateral": ("select r_name, t.n from region, lateral (select count(*) as n from nation where n_regionkey = r_regionkey) t", None),
    "except_all": ("select n_regionkey as k from nation except all select r_regionkey from region", None),
    "intersect_all": ("select n_regionkey as k from nation intersect all select s_nationkey from supplier", None),
    "set_precedence": ("select r_regionkey as k from region union select n_nationkey from nation intersect select s_nationkey from supplier", None),
    "comments": ("select r_name -- the name\n, r_regionkey /* and\n the key */ from region -- end", None),
    "q1_like": ("select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as price, round(avg(l_discount), 6) as disc, count(*) as n from lineitem where l_shipdate <= date '1998-09-02' group by l_returnflag, l_linestatus order by l_returnflag asc, l_linestatus asc", None),
    "q3_like": ("select l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, o_orderdate from customer, orders, lineitem where c_mktsegment = 'BUILDING' and c_custkey = o_custkey and l_orderkey = o_orderkey group by l_orderkey, o_orderdate order by revenue desc, l_orderkey asc limit 10", None),
    "q5_like": ("select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from customer, orders, lineitem, supplier, nation, region where c_custkey = o_custkey and l_orderkey = o_orderkey and l_suppkey = s_suppkey and c_nationkey = n_nationkey and n_regionkey = r_regionkey group by n_name order by revenue desc", None),
    "q6_like": ("select round(sum(l_extendedprice * l_discount), 2) as revenue from lineitem where l_discount between 0.03 and 0.07 and l_quantity < 24", None),
}


def engine(spark: SparkSession, sf_dir: str, statement: str = "") -> Engine:
    """A session with the tables of ``sf_dir`` that the statement names."""
    words = set(re.findall(r"\w+", statement.lower()))
    return Engine(spark, {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if t in words})


def _statement(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: engine(spark, sf_dir, sql).execute(sql)


def _placed(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """All rows of a sorted statement, and the place of each in that order."""
    sql = STATEMENTS[name][0]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = engine(spark, sf_dir, sql).execute(sql)
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        return spark.createDataFrame(rows.rdd.zipWithIndex().map(lambda x: (*x[0], x[1] + 1)), f"{kinds}, place long")

    return run


def _show(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).execute("show transaction isolation level")


def _udf_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "nation")
    e.add_function("twice", F.pandas_udf(lambda x: x * 2, "long"))
    return e.execute("select n_nationkey, twice(n_nationkey) as t from nation")


def _udf_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "nation")
    e.add_function("joined", lambda name, key: name.str.lower() + "-" + key.astype(str))
    return e.execute("select joined(n_name, n_nationkey) as j from nation")


def _udf_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "part")
    e.add_aggregate("spread", lambda x: float(x.max() - x.min()))
    return e.execute("select p_brand, spread(p_size) as s from part group by p_brand")


def _lateral_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lateral_json(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "props"), "props").select("event_id", "j_key", "j_value")


def _copy_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, folder = engine(spark, sf_dir, "nation"), _shared(spark)
    e.execute(f"copy nation to '{folder}' with format 'csv', delimiter ';'")
    return e.execute(f"select n_regionkey, count(*) as n from copy_from('{folder}', 'delimiter', ';') group by n_regionkey")


def _case_sensitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark, {"t": spark.read.parquet(f"{sf_dir}/nation.parquet")}, case_sensitive=True)
    return e.execute('select "N" as x, n as y from (select n_name as "N", n_nationkey as n from t) u')


def _letters(word: str):
    for at, letter in enumerate(word):
        yield at, letter


def _udtf_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "nation")
    e.add_lateral_function("letters", _letters, "place int, letter string")
    return e.execute("select n_nationkey, l.place, l.letter from nation, lateral letters(n_name) as l")


def _table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.add_table_function("upto", lambda k: spark.range(k))
    return e.execute("select id * 2 as v from upto(10)")


def _shared(spark: SparkSession) -> str:
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="quern-")
    return os.path.join(base, uuid.uuid4().hex)


def _copy_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, folder = engine(spark, sf_dir, "nation"), _shared(spark)
    e.execute(f"copy nation to '{folder}/nation' with format 'csv', delimiter ';'")
    e.execute(f"copy again from '{folder}/nation' with format 'csv', delimiter ';'")
    return e.execute("select n_nationkey, n_name, n_regionkey from again")


def _copy_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _shared(spark)
    write_table(spark.read.parquet(f"{sf_dir}/part.parquet"), folder, {"format": "parquet"})
    return read_table(spark, folder, {"format": "parquet"}).select("p_partkey", "p_brand")


def _ctas(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "orders")
    e.execute("create table big as select o_custkey, o_totalprice from orders where o_totalprice > 100000")
    result = e.execute("select o_custkey, count(*) as n from big group by o_custkey")
    e.execute("drop table big")
    return result


def _in_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, supplier = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "supplier"))
    return in_column(nation, "n_nationkey", supplier, "s_nationkey").select("n_name")


def _top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/orders.parquet"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 2).select("o_custkey", "o_orderkey")


def _as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts")
    earlier = events.groupBy("user_id", (F.col("ts") + F.expr("interval 1 hour")).alias("at")).agg(F.max("event_id").alias("last_id"))
    return as_of(events, earlier, ["user_id"], "ts", "at", ["last_id"]).select("event_id", "last_id")


def _event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return windowed_counts(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", "event_type", "1 hour").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def _utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = session_counts(_utc(spark, sf_dir), "ts", "user_id", "2 hours")
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "user_id", "n")


def _event_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(_utc(spark, sf_dir), ["user_id", "event_type"], "ts", "1 hour").select("user_id", "event_type")


def _event_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _utc(spark, sf_dir).select("user_id", "ts", "event_id")
    later = events.select("user_id", F.col("ts").alias("then"), F.col("event_id").alias("next_id"))
    return joined_within(events, later, "user_id", "ts", "then", "6 hours").filter("event_id <> next_id").select("event_id", "next_id")


CALLS = {
    "show_option": (_show, "select 'read only' as value"),
    "udf_scalar": (_udf_scalar, "select n_nationkey, n_nationkey::bigint * 2 as t from nation"),
    "udf_plain": (_udf_plain, "select lower(n_name) || '-' || n_nationkey as j from nation"),
    "udf_aggregate": (_udf_aggregate, "select p_brand, (max(p_size) - min(p_size))::double as s from part group by p_brand"),
    "op_lateral_json": (_lateral_json, "select event_id, j.key as j_key, json_extract_string(props, '$.' || j.key) as j_value from events, json_each(props) j"),
    "copy_from_scan": (_copy_scan, "select n_regionkey, count(*) as n from nation group by n_regionkey"),
    "case_sensitive": (_case_sensitive, "select n_name as x, n_nationkey as y from nation"),
    "udtf_lateral": (_udtf_lateral, "select n_nationkey, (i - 1)::integer as place, substring(n_name, i::integer, 1) as letter from (select n_nationkey, n_name, unnest(range(1, length(n_name) + 1)) as i from nation)"),
    "table_function": (_table_function, "select range * 2 as v from range(10)"),
    "copy_roundtrip": (_copy_roundtrip, "select n_nationkey, n_name, n_regionkey from nation"),
    "copy_parquet": (_copy_parquet, "select p_partkey, p_brand from part"),
    "ctas_then_query": (_ctas, "select o_custkey, count(*) as n from orders where o_totalprice > 100000 group by o_custkey"),
    "in_column": (_in_column, "select n_name from nation where n_nationkey in (select s_nationkey from supplier)"),
    "op_top_k": (_top_k, "select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) <= 2"),
    "op_as_of": (_as_of, "with o as (select user_id, ts + interval 1 hour as at, max(event_id) as last_id from events group by all) select event_id, last_id from events asof left join o on events.user_id = o.user_id and events.ts >= o.at"),
    "sort_ordinal_all": (_placed("sort_ordinal"), "select o_custkey, o_orderkey, row_number() over (order by o_custkey asc, o_orderkey desc) as place from orders"),
    "sort_expr_all": (_placed("sort_expr"), "select c_custkey, row_number() over (order by 0 - c_acctbal asc nulls last, c_custkey asc) as place from customer"),
    "sort_nulls_first_all": (_placed("sort_nulls_first"), "select c_custkey, o_orderkey, row_number() over (order by o_orderkey asc nulls first, c_custkey asc) as place from customer left join orders on c_custkey = o_custkey and o_totalprice > 200000"),
    "event_sessions": (_event_sessions, "with a as (select user_id, ts, coalesce(ts - lag(ts) over (partition by user_id order by ts) >= interval 2 hours, true) as cut from events), b as (select *, sum(cut::int) over (partition by user_id order by ts rows unbounded preceding) as s from a) select min(ts)::timestamp as start, user_id, count(*) as n from b group by user_id, s"),
    "event_keys": (_event_keys, "select distinct user_id, event_type from events"),
    "event_pairs": (_event_pairs, "select a.event_id, b.event_id as next_id from events a join events b on a.user_id = b.user_id and a.event_id <> b.event_id and b.ts between a.ts and a.ts + interval 6 hours"),
    "event_windows": (_event_windows, "select date_trunc('hour', ts)::timestamp as start, event_type, count(*) as n from events group by 1, 2"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _statement(sql) for name, (sql, _) in STATEMENTS.items()} | {name: f for name, (f, _) in CALLS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: other or sql for name, (sql, other) in STATEMENTS.items()} | {name: sql for name, (_, sql) in CALLS.items()}
