"""Views that give the driver's tables the shape of call graphs and pushes, in SQL that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from annalist.sources.tables import register_views

_NAME = "concat(case when p_partkey % 3 = 0 then 'ns::' else '' end, replace(p_name, ' ', '_'), '_', p_partkey % 7)"
VIEWS = {
    "push_files": """select concat('p', l_orderkey) as push_id,
  concat('src/m', l_partkey, case l_suppkey % 6 when 0 then '.py' when 1 then '.js' when 2 then '.PY' when 3 then '.tsx' when 4 then '.hpp' else '.md' end) as file_path,
  case l_returnflag when 'A' then 'added' when 'N' then 'modified' else 'removed' end as status from lineitem""",
    "functions_current": f"select p_brand as file_path, {_NAME} as name, p_partkey as pos, p_partkey % 41 = 0 as has_error from part where p_partkey % 4 <> 0",
    "functions_live": f"select file_path, name from (select p_brand as file_path, {_NAME} as name, min(p_partkey % 9) = 0 as is_deleted from part where p_partkey % 5 <> 0 group by 1, 2) r where not is_deleted",
    "call_sites": """select distinct f.file_path, f.name, concat(replace(p.p_name, ' ', '_'), '_', p.p_partkey % 7) as raw_callee
  from lineitem l join functions_current f on l.l_partkey = f.pos, (select count(*) as n from part) c, part p
  where l.l_linenumber = 1 and not f.has_error and p.p_partkey = (l.l_suppkey * 17 + l.l_partkey) % c.n""",
    "dep_edges": "select distinct cast(c_nationkey as bigint) as n, cast((c_custkey * 7 + 3) % 25 as bigint) as dep from customer where c_nationkey <> (c_custkey * 7 + 3) % 25",
    "sparse_edges": "select distinct cast(c_nationkey as bigint) as n, cast((c_custkey * 7 + 3) % 25 as bigint) as dep from customer where c_custkey < 40 and c_nationkey <> (c_custkey * 7 + 3) % 25",
    "replies": "select event_id, concat(case when event_id % 3 = 0 then 'Sure! ' else '' end, props, case when event_id % 4 = 0 then ' Done.' else '' end) as reply from events",
    "commit_files": """select concat('c', l_orderkey) as sha, concat('src/m', l_partkey, case l_suppkey % 3 when 0 then '.py' when 1 then '.js' else '.md' end) as file_path,
  case when l_linenumber = 4 then 'renamed' when l_returnflag = 'A' then 'added' when l_returnflag = 'N' then 'modified' else 'removed' end as status from lineitem""",
    "push_sources": """select p_partkey % 3 as repository_id, concat('src/p', p_partkey, '.py') as file_path, p_partkey as k, case when p_partkey % 5 = 0 then 'removed' when p_partkey % 5 < 3 then 'added' else 'modified' end as status,
  case when p_partkey % 5 = 0 then null when p_partkey % 17 = 0 then '' else concat('def f_', p_partkey, '(x):', case when p_partkey % 13 = 0 then '  # fails' else '' end, chr(10), '    return f_',
    case when floor(p_partkey / 3) % 4 <> 0 then p_partkey - 3 when p_partkey % 7 = 0 then p_partkey + 9 else p_partkey end, case when p_partkey % 23 = 0 then '(' else '(x)' end) end as content from part""",
    "push_registry": """select repository_id, file_path, concat('f_', k) as function_name, case when k % 3 = 0 then 'old' else coalesce(CONTENT_HASH, '') end as content_hash, k % 11 = 0 as is_deleted from push_sources where k % 2 = 0 or k % 5 = 3
  union all select repository_id, file_path, concat('g_', k), 'gone', false from push_sources where k % 4 = 3""",
    "push_log": "select k as id, repository_id, concat('f_', k) as function_name, file_path, case when k % 6 = 0 then '' else concat('doc ', k) end as content, cast('c0' as string) as commit_sha, 7 as score, false as is_deleted from push_sources where k % 2 = 0",
    "language_files": """select concat('src/p', p_partkey, case p_partkey % 7 when 0 then '.py' when 1 then '.js' when 2 then '.ts' when 3 then '.go' when 4 then '.java' when 5 then '.cpp' else '.hpp' end) as file_path, p_partkey % 7 as lang,
  case p_partkey % 7 when 3 then concat('package a', chr(10), chr(10)) when 4 then concat('class A {', chr(10), '  ') when 2 then concat('// f()', chr(10), 'export ') else '' end as before,
  case p_partkey % 7 when 0 then concat('def f_', p_partkey, '(x):', chr(10), '    return o.', replace(p_name, ' ', '_'), '(x, "g(y)")')
    when 1 then concat('const f_', p_partkey, ' = (x) => {', chr(10), '  return o.', replace(p_name, ' ', '_'), '(x, "g(y)");', chr(10), '}')
    when 2 then concat('function f_', p_partkey, '(x: number): number {', chr(10), '  return o.', replace(p_name, ' ', '_'), '(x, "g(y)");', chr(10), '}')
    when 3 then concat('func (a *T) f_', p_partkey, '(x int) int {', chr(10), '  return o.', replace(p_name, ' ', '_'), '(x, "g(y)")', chr(10), '}')
    when 4 then concat('public static int f_', p_partkey, '(int x) {', chr(10), '    return o.', replace(p_name, ' ', '_'), '(x, "g(y)");', chr(10), '  }')
    else concat('int A::f_', p_partkey, '(int x) {', chr(10), '  return o.', replace(p_name, ' ', '_'), '(x, "g(y)");', chr(10), '}') end as body,
  case p_partkey % 7 when 1 then concat(';', chr(10)) when 4 then concat(chr(10), '}', chr(10)) else chr(10) end as after, replace(p_name, ' ', '_') as callee, p_partkey as k from part""",
    "source_files": "select concat('src/p', p_partkey, '.py') as file_path, concat('def f_', p_partkey, '(x):', chr(10), '    return ', replace(p_name, ' ', '_'), '(x)') as content from part",
}


#: Hexadecimal SHA-256 of a text in Spark's and in DuckDB's words.
_SHA = {"spark": "sha2({}, 256)", "duckdb": "sha256({})"}


def cte(*names: str, engine: str = "duckdb") -> str:
    """The views as common table expressions, in the order of VIEWS."""
    return "with " + ",\n".join(f"{n} as ({VIEWS[n].replace('CONTENT_HASH', _SHA[engine].format('content'))})" for n in VIEWS if n in names)


def view(spark: SparkSession, sf_dir: str, name: str, needs: tuple[str, ...] = ()) -> DataFrame:
    register_views(spark, sf_dir, ("lineitem", "part", "customer", "events"))
    return spark.sql(f"{cte(*needs, name, engine='spark')} select * from {name}")
