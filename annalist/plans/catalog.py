"""Queries of the reference's operators over the domain tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.functions.joins import null_safe_join
from annalist.functions.scalar import graph_width, lane_x, language, owner, repaired_json, row_y, supported_path
from annalist.operators import calls, commits, docloop, extract, graph, hierarchy, logs, registry, repos, snapshots
from annalist.operators.scan import numbered, row_numbers, running_sum
from annalist.plans.fixtures import cte, view
from annalist.session import Scratch
from annalist.sources.tables import spread, table
from annalist.streaming import push

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_DOC = "repository_id, function_name, id, file_path, content, commit_sha, score"
_D = "with d as (select distinct id, repository_id, function_name, file_path, content, commit_sha, score, is_deleted from documentations where id is not null)"
_DOCS = ("id", "repository_id", "function_name", "file_path", "content", "commit_sha", "score", "is_deleted")


def _log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documentations").select(*_DOCS)


@query(f"{_D}, l as (select *, row_number() over (partition by repository_id, function_name order by id desc) as r from d) select {_DOC} from l where r = 1 and is_deleted = false")
def latest_docs(spark: SparkSession, d: str) -> DataFrame:
    return logs.latest_docs(_log(spark, d)).select(*_DOC.split(", "))


@query(f"{_D}, l as (select *, row_number() over (partition by repository_id, file_path, function_name order by id desc) as r from d) select {_DOC} from l where r = 1 and is_deleted = false")
def latest_docs_by_file(spark: SparkSession, d: str) -> DataFrame:
    return logs.latest_docs(_log(spark, d), logs.BY_FILE).select(*_DOC.split(", "))


@query(f"{_D} select repository_id, function_name, id, file_path, commit_sha, score, is_deleted, row_number() over (partition by repository_id, function_name order by id desc) as age from d")
def function_history(spark: SparkSession, d: str) -> DataFrame:
    return logs.history(_log(spark, d)).select("repository_id", "function_name", "id", "file_path", "commit_sha", "score", "is_deleted", "age")


_CHANGES = f"""{_D}, c as (select *, lag(coalesce(is_deleted, false)) over (partition by repository_id, file_path, function_name order by id) as b from d),
k as (select id, repository_id, commit_sha, function_name, file_path, case when coalesce(is_deleted, false) then 'deleted' when coalesce(b, true) then 'added' else 'changed' end as change from c)"""


@query(_CHANGES + " select * from k")
def commit_changes(spark: SparkSession, d: str) -> DataFrame:
    return logs.changes(_log(spark, d)).select("id", "repository_id", "commit_sha", "function_name", "file_path", "change")


@query(_CHANGES + " select repository_id, commit_sha, count(*) filter (where change = 'added') as added, count(*) filter (where change = 'changed') as changed, count(*) filter (where change = 'deleted') as deleted from k group by 1, 2")
def commit_change_counts(spark: SparkSession, d: str) -> DataFrame:
    return logs.change_counts(_log(spark, d))


@query(f"{_D}, l as (select *, row_number() over (partition by repository_id, file_path, function_name order by id desc) as r from d where is_deleted = false) select {_DOC} from l where r = 1")
def last_live_doc(spark: SparkSession, d: str) -> DataFrame:
    return logs.last_live_docs(_log(spark, d)).select(*_DOC.split(", "))


# registry ------------------------------------------------------------------------------------------------------------

_REG = """reg as (select repository_id, file_path, function_name, arg_max(content_hash, id) as content_hash, arg_max(coalesce(cast(is_deleted as varchar), 'null'), id) as del
  from function_registry group by 1, 2, 3)"""
_REMOVED = "removed as (select distinct repository_id, file_path, commit_sha from documentations where function_name is null and is_deleted)"
_CUR = """cur as (select repository_id, file_path, function_name, h as content_hash from (
  select *, lower(content_hash) as h, coalesce(is_deleted, false) as gone, row_number() over (partition by repository_id, file_path, function_name
    order by loaded_at desc nulls last, registry_id desc nulls last, coalesce(is_deleted, false) desc, lower(content_hash) desc nulls last) as rn
  from registry_snapshots where snapshot_no = (select max(snapshot_no) from registry_snapshots)) where rn = 1 and not gone)"""


def _registry(spark: SparkSession, d: str) -> DataFrame:
    return registry.current(table(spark, d, "function_registry").select("id", *registry.KEY, "content_hash", "is_deleted")).withColumn("content_hash", F.col("content_hash"))


def _delivered(spark: SparkSession, d: str) -> DataFrame:
    """The functions of the last delivery stand for those now in the files."""
    s = table(spark, d, "registry_snapshots")
    last = s.agg(F.max("snapshot_no")).first()[0]
    return snapshots.present_functions(s.filter(F.col("snapshot_no") == last)).drop("snapshot_no")


def _removed(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark, d).filter(F.col("function_name").isNull() & F.col("is_deleted")).select("repository_id", "file_path", "commit_sha").distinct()


@query(f"""with {_REG}, {_REMOVED} select r.repository_id, r.file_path, r.function_name, m.commit_sha, true as is_deleted from reg r join removed m
on r.repository_id is not distinct from m.repository_id and r.file_path is not distinct from m.file_path where r.del = 'false'""")
def next_tombstones(spark: SparkSession, d: str) -> DataFrame:
    gone = registry.of_removed_files(_registry(spark, d), _removed(spark, d))
    return registry.tombstones(gone).select("repository_id", "file_path", "function_name", "commit_sha", "is_deleted")


@query(f"""with {_REG}, {_REMOVED} select r.repository_id, r.file_path, r.function_name, case when r.del = 'false' and exists (select 1 from removed m
where r.repository_id is not distinct from m.repository_id and r.file_path is not distinct from m.file_path) then 'true' else r.del end as is_deleted from reg r""")
def mark_files_deleted(spark: SparkSession, d: str) -> DataFrame:
    reg = _registry(spark, d)
    out = registry.soft_delete(reg, registry.of_removed_files(reg, _removed(spark, d)))
    return out.select(*registry.KEY, F.coalesce(F.col("is_deleted").cast("string"), F.lit("null")).alias("is_deleted"))


@query(f"""with {_REG}, {_CUR}, live as (select repository_id, file_path, function_name, lower(content_hash) as h from reg r where del = 'false'
  and exists (select 1 from cur c where c.repository_id is not distinct from r.repository_id and c.file_path is not distinct from r.file_path))
select coalesce(c.repository_id, l.repository_id) as repository_id, coalesce(c.file_path, l.file_path) as file_path, coalesce(c.function_name, l.function_name) as function_name,
  case when l.function_name is null then 'new' when c.function_name is null then 'deleted' when l.h is not distinct from c.content_hash then 'unchanged' else 'changed' end as kind
from cur c full join live l on c.repository_id = l.repository_id and c.file_path = l.file_path and c.function_name = l.function_name""")
def registry_diff(spark: SparkSession, d: str) -> DataFrame:
    reg = _registry(spark, d).withColumn("content_hash", F.lower("content_hash"))
    return registry.diff(_delivered(spark, d), reg).select(*registry.KEY, "kind")


@query(f"""with {_REG}, {_CUR} select repository_id, file_path, function_name, content_hash, 'false' as is_deleted from cur union all
select repository_id, file_path, function_name, content_hash, del from reg r where not exists (select 1 from cur c
where c.repository_id is not distinct from r.repository_id and c.file_path is not distinct from r.file_path and c.function_name is not distinct from r.function_name)""")
def registry_upsert(spark: SparkSession, d: str) -> DataFrame:
    out = registry.upsert(_registry(spark, d), _delivered(spark, d))
    return out.select(*registry.KEY, "content_hash", F.coalesce(F.col("is_deleted").cast("string"), F.lit("null")).alias("is_deleted"))


@query(f"""with {_REG}, {_CUR} select repository_id, file_path, function_name from reg r where del = 'false' and not exists (select 1 from cur c
where c.repository_id is not distinct from r.repository_id and c.file_path is not distinct from r.file_path and c.function_name is not distinct from r.function_name)""")
def registry_outside_changeset(spark: SparkSession, d: str) -> DataFrame:
    return registry.outside_changeset(_registry(spark, d), _delivered(spark, d)).select(*registry.KEY)


@query(f"""{_D}, {_CUR}, l as (select repository_id, file_path, function_name, arg_max(coalesce(content, chr(0)), id) as c from d where is_deleted = false group by 1, 2, 3)
select cur.repository_id, cur.file_path, cur.function_name, coalesce(nullif(l.c, chr(0)), '') as existing_documentation from cur left join l
on cur.repository_id is not distinct from l.repository_id and cur.file_path is not distinct from l.file_path and cur.function_name is not distinct from l.function_name""")
def existing_documentation(spark: SparkSession, d: str) -> DataFrame:
    return logs.existing_docs(_delivered(spark, d), _log(spark, d)).select(*registry.KEY, "existing_documentation")


@query("""select coalesce(d.repository_id, r.repository_id) as repository_id, coalesce(d.n, 0) as docs, coalesce(r.n, 0) as functions
from (select repository_id, count(*) as n from documentations group by 1) d full join (select repository_id, count(*) as n from function_registry group by 1) r on d.repository_id = r.repository_id""")
def delete_repo_counts(spark: SparkSession, d: str) -> DataFrame:
    return registry.delete_counts(table(spark, d, "documentations").select("repository_id"), table(spark, d, "function_registry").select("repository_id"))


@query("select d.* from (select id, repository_id, file_path, function_name from documentations) d left join repositories r on r.id = d.repository_id where coalesce(r.is_active, false)")
def docs_of_active_repos(spark: SparkSession, d: str) -> DataFrame:
    """The log after the data of all inactive repositories is deleted."""
    off = table(spark, d, "repositories").filter(~F.coalesce("is_active", F.lit(False))).select(F.col("id").alias("repository_id"))
    return registry.without_repositories(table(spark, d, "documentations").select("id", "repository_id", "file_path", "function_name"), off)


@query(f"""with {_REG}, {_REMOVED}, t as (select distinct r.repository_id, r.file_path, r.function_name, m.commit_sha from reg r join removed m
on r.repository_id is not distinct from m.repository_id and r.file_path is not distinct from m.file_path where r.del = 'false')
select (select max(id) from documentations) + row_number() over (order by repository_id, file_path, function_name, commit_sha) as id, * from t""")
def appended_tombstones(spark: SparkSession, d: str) -> DataFrame:
    """SNK1 and SNK2: the tombstones of removed files as new events, with the ids that follow."""
    gone = registry.of_removed_files(_registry(spark, d), _removed(spark, d)).distinct()
    rows = registry.tombstones(gone).withColumn("seq", F.struct("repository_id", "file_path", "function_name", "commit_sha"))
    return logs.append(_log(spark, d), rows, Scratch(spark, "append")).select("id", "repository_id", "file_path", "function_name", "commit_sha")


# repositories --------------------------------------------------------------------------------------------------------


@query("select full_name, coalesce(is_active, false) as is_active from repositories")
def repo_listing(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "repositories")
    return repos.listing(r.select("full_name"), r)


@query("select r.id, r.full_name, split_part(r.full_name, '/', 1) as owner, u.access_token is not null as has_token from repositories r left join users u on u.username = split_part(r.full_name, '/', 1)")
def repo_owner_lookup(spark: SparkSession, d: str) -> DataFrame:
    return repos.with_owner_token(table(spark, d, "repositories"), table(spark, d, "users")).drop("access_token")


@query("select id, full_name, case when coalesce(is_active, false) then true else false end as is_active, case when coalesce(is_active, false) then webhook_id end as webhook_id from repositories")
def deactivate_repo(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "repositories")
    off = r.filter(~F.coalesce("is_active", F.lit(False)))
    return repos.deactivate(r, off).select("id", "full_name", "is_active", "webhook_id")


@query("""select full_name, user_id, 9000 + id as webhook_id, true as is_active from repositories union all
select concat(username, '/new'), id, 1, true from users""")
def upsert_repository(spark: SparkSession, d: str) -> DataFrame:
    r, u = table(spark, d, "repositories"), table(spark, d, "users")
    known = r.join(u.select(F.col("id").alias("user_id"), "username"), "user_id").select("username", "full_name", (F.lit(9000) + F.col("id")).alias("webhook_id"))
    new = u.select("username", F.concat("username", F.lit("/new")).alias("full_name"), F.lit(1).cast("long").alias("webhook_id"))
    return repos.upsert_repository(r, u, known.unionByName(new))


@query("""with o as (select distinct split_part(full_name, '/', 1) as username from repositories)
select coalesce(u.username, o.username) as username, case when o.username is not null then 'enc:new' else u.access_token end as access_token, u.id is null as is_new from users u full join o on u.username = o.username""")
def upsert_user(spark: SparkSession, d: str) -> DataFrame:
    logins = table(spark, d, "repositories").select(owner(F.col("full_name")).alias("username"), F.lit("enc:new").alias("access_token"))
    return repos.upsert_user(table(spark, d, "users"), logins)


# commits -------------------------------------------------------------------------------------------------------------

_LIST = """c as (select repository_id, sha, arg_min(coalesce(message, chr(0)), pos) as message, arg_min(coalesce(author, ''), pos) as author, arg_min(coalesce(commit_date, chr(0)), pos) as commit_date,
  arg_min(coalesce(parents, []), pos) as parents, min(pos) as pos from commits where sha is not null group by 1, 2),
l as (select repository_id, sha, substring(sha, 1, 7) as short_sha, nullif(split_part(message, chr(10), 1), chr(0)) as message, coalesce(nullif(author, ''), 'unknown') as author, nullif(commit_date, chr(0)) as commit_date, parents,
  len(parents) > 1 as is_merge, pos, row_number() over (partition by repository_id order by coalesce(nullif(commit_date, chr(0)), '') desc, pos) - 1 as row from c)"""
_EDGES = f"with recursive {_LIST}, e as (select l.repository_id, l.sha, p.sha as parent_sha, u.i - 1 as parent_no from l, unnest(l.parents) with ordinality as u(x, i), l p where p.repository_id = l.repository_id and lower(p.sha) = lower(u.x))"
_UP = f"""{_EDGES}, h as (select l.repository_id, coalesce(max(case when r.documented_head_sha = l.sha then l.sha end), max(case when l.row = 0 then l.sha end)) as sha from l join repositories r on r.id = l.repository_id group by 1),
up(repository_id, head_sha, sha) as (
  select repository_id, sha, sha from h
  union select up.repository_id, up.head_sha, e.parent_sha from up join e on e.repository_id = up.repository_id and e.sha = up.sha)"""


def _listing(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark, "listing")
    return scratch.cut(commits.listing(scratch, table(spark, d, "commits")))


@query(f"with {_LIST} select repository_id, sha, short_sha, message, author, commit_date, is_merge, len(parents) as n_parents, row from l")
def commit_listing(spark: SparkSession, d: str) -> DataFrame:
    return _listing(spark, d).select("repository_id", "sha", "short_sha", "message", "author", "commit_date", "is_merge", F.size("parents").alias("n_parents"), "row")


@query(_EDGES + " select * from e")
def commit_parent_edges(spark: SparkSession, d: str) -> DataFrame:
    return commits.parent_edges(commits.normalised(table(spark, d, "commits")))


def _ancestors(spark: SparkSession, d: str) -> DataFrame:
    """Of each repository's documented head, or of its newest commit where the head is none of its commits."""
    scratch, c = Scratch(spark, "ancestors"), table(spark, d, "commits")
    forest = hierarchy.peel(spark, hierarchy.commit_nodes(c), scratch)
    listed = _listing(spark, d)
    marked = table(spark, d, "repositories").select(F.col("id").alias("repository_id"), "documented_head_sha")
    pick = lambda c: F.max(F.when(c, F.col("sha")))
    heads = listed.join(marked, "repository_id").groupBy("repository_id").agg(F.coalesce(pick(F.col("sha") == F.col("documented_head_sha")), pick(F.col("row") == 0)).alias("head_sha"))
    return commits.ancestors(scratch, forest, commits.parent_edges(listed), heads)


@query(_UP + " select * from up")
def commit_ancestors(spark: SparkSession, d: str) -> DataFrame:
    return _ancestors(spark, d)


@query(_UP + " select l.repository_id, count(*) as commits, count(up.sha) as documented from l left join up on up.repository_id = l.repository_id and up.sha = l.sha group by 1")
def documented_commits(spark: SparkSession, d: str) -> DataFrame:
    up = _ancestors(spark, d).select("repository_id", "sha", F.lit(True).alias("known"))
    return commits.normalised(table(spark, d, "commits")).join(up, ["repository_id", "sha"], "left").groupBy("repository_id").agg(F.count(F.lit(1)).alias("commits"), F.count("known").alias("documented"))


_SNAP = f"""{_UP}, s as (select d.*, row_number() over (partition by d.repository_id, function_name order by id desc) as r from (select distinct id, repository_id, function_name, file_path, content, commit_sha, score, is_deleted from documentations) d
  where exists (select 1 from up where up.repository_id = d.repository_id and up.sha = d.commit_sha)), t as (select * from s where r = 1 and is_deleted = false)"""


@query(_SNAP + f" select {_DOC} from t")
def snapshot_at_commit(spark: SparkSession, d: str) -> DataFrame:
    return logs.snapshot(_log(spark, d), _ancestors(spark, d)).select(*_DOC.split(", "))


@query(_SNAP + " select repository_id, file_path, count(*) as docs, coalesce(string_agg(function_name, ',' order by function_name), '') as names from t group by 1, 2")
def snapshot_files(spark: SparkSession, d: str) -> DataFrame:
    return logs.by_file(logs.snapshot(_log(spark, d), _ancestors(spark, d)))


@query(f"""with {_LIST}, b as (select id as repository_id, 'documented' as name, documented_head_sha as head_sha from repositories union all select repository_id, 'newest', sha from l where row = 0)
select l.repository_id, l.sha, string_agg(distinct b.name, ',' order by b.name) as names from l join b on b.repository_id = l.repository_id and b.head_sha = l.sha group by 1, 2""")
def branch_heads(spark: SparkSession, d: str) -> DataFrame:
    listed = _listing(spark, d)
    marked = table(spark, d, "repositories").select(F.col("id").alias("repository_id"), F.lit("documented").alias("name"), F.col("documented_head_sha").alias("head_sha"))
    newest = listed.filter(F.col("row") == 0).select("repository_id", F.lit("newest").alias("name"), F.col("sha").alias("head_sha"))
    return commits.branch_heads(marked.unionByName(newest), listed)


@query(f"""with {_LIST}, m as (select l.repository_id, l.row as mark from l join repositories r on r.id = l.repository_id and r.documented_head_sha = l.sha)
select l.repository_id, l.sha, coalesce(m.mark - 1, x.last) - l.row as step from l left join m on m.repository_id = l.repository_id join (select repository_id, max(row) as last from l group by 1) x on x.repository_id = l.repository_id
where m.mark is null or l.row < m.mark""")
def backfill_gap(spark: SparkSession, d: str) -> DataFrame:
    return commits.gap(_listing(spark, d), table(spark, d, "repositories"))


@query(f"with {_LIST} select r.id, coalesce(l.sha, r.documented_head_sha) as documented_head_sha from repositories r left join l on l.repository_id = r.id and l.row = 0")
def advance_head(spark: SparkSession, d: str) -> DataFrame:
    newest = _listing(spark, d).filter(F.col("row") == 0).select(F.col("repository_id").alias("id"), "sha")
    return repos.advance_head(table(spark, d, "repositories"), newest).select("id", "documented_head_sha")


@query()
def commit_lanes(spark: SparkSession, d: str) -> DataFrame:
    return commits.lanes(Scratch(spark, "lanes"), _listing(spark, d)).withColumn("x", lane_x(F.col("lane"))).withColumn("y", row_y(F.col("row")))


@query()
def graph_widths(spark: SparkSession, d: str) -> DataFrame:
    return commits.lanes(Scratch(spark, "lanes"), _listing(spark, d)).groupBy("repository_id").agg(graph_width(F.max("lane")).alias("width"))


# pushes, calls, components -------------------------------------------------------------------------------------------


@query(f"{cte('push_files')} select distinct push_id, status, file_path from push_files where regexp_matches(file_path, '\\.(py|js|ts|go|java|cpp|cc|cxx|h|hpp)$')")
def push_changed_files(spark: SparkSession, d: str) -> DataFrame:
    """Through the payload: files of a push as JSON, parsed again, exploded and united."""
    files = view(spark, d, "push_files")
    of = lambda s: F.collect_list(F.when(F.col("status") == s, F.col("file_path"))).alias(s)
    lists = files.groupBy("push_id").agg(*[of(s) for s in push.STATUSES])
    body = F.struct(F.struct(F.lit("o/r").alias("full_name")).alias("repository"), F.lit("refs/heads/main").alias("ref"), F.array(F.struct(*push.STATUSES)).alias("commits"))
    return push.changed_files(push.parse(lists.select("push_id", F.to_json(body).alias("value"))), ["push_id"])


_LANG = "{'.py': 'python', '.js': 'javascript', '.ts': 'typescript', '.go': 'go', '.java': 'java', '.cpp': 'cpp', '.cc': 'cpp', '.cxx': 'cpp', '.h': 'cpp', '.hpp': 'cpp'}"


@query(f"""select task_id, coalesce(map {_LANG}[lower(regexp_extract(file_path, '(\\.[^./]*)$', 1))], '') as language,
regexp_matches(file_path, '\\.(py|js|ts|go|java|cpp|cc|cxx|h|hpp)$') as supported from function_tasks""")
def file_languages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "function_tasks").select("task_id", F.coalesce(language("file_path"), F.lit("")).alias("language"), supported_path("file_path").alias("supported"))


def _resolved(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = F.lit(0).alias("tree")
    every = view(spark, d, "functions_current").select(t, "file_path", "name", "has_error")
    live = view(spark, d, "functions_live").select(t, "file_path", "name")
    outside = live.join(every, ["tree", "file_path", "name"], "left_anti")
    sound = every.filter(~F.col("has_error")).drop("has_error")
    sites = view(spark, d, "call_sites", ("functions_current",)).select(t, "file_path", "name", "raw_callee")
    return calls.resolve(sites, sound, outside), sound


def _simple(c: str) -> str:
    return f"split_part({c}, '::', -1)"


_CALLS = f"""{cte('functions_current', 'functions_live', 'call_sites')},
good as (select file_path, name, {_simple('name')} as simple from functions_current where not has_error),
outside as (select file_path, name, {_simple('name')} as simple from functions_live l where not exists (select 1 from functions_current c where c.file_path = l.file_path and c.name = l.name)),
x as (select s.*, (select count(*) from good g where g.simple = s.raw_callee) as n, (select count(*) from good g where g.simple = s.raw_callee and g.file_path = s.file_path) as sn,
  (select count(*) from outside g where g.simple = s.raw_callee) as xn, (select count(*) from outside g where g.simple = s.raw_callee and g.file_path = s.file_path) as xsn from call_sites s),
t as (select x.*, case when n > 0 then case when sn = 1 then (select min(struct_pack(f := g.file_path, n := g.name)) from good g where g.simple = x.raw_callee and g.file_path = x.file_path)
    when sn = 0 and n = 1 then (select min(struct_pack(f := g.file_path, n := g.name)) from good g where g.simple = x.raw_callee) end
  when xn > 0 then case when xsn = 1 then (select min(struct_pack(f := g.file_path, n := g.name)) from outside g where g.simple = x.raw_callee and g.file_path = x.file_path)
    when xsn = 0 and xn = 1 then (select min(struct_pack(f := g.file_path, n := g.name)) from outside g where g.simple = x.raw_callee) end end as g from x),
r as (select file_path, name, raw_callee, case when n > 0 and g is null then 'ambiguous' when n > 0 and g.f = file_path and g.n = name then 'self' when n > 0 then 'internal'
  when xn > 0 and g is null then 'ambiguous_external' when xn > 0 then 'external' else 'unknown' end as kind, g.f as target_file, g.n as target_name from t),
e as (select distinct file_path, name, target_file as dep_file, target_name as dep_name from r where kind = 'internal')"""


@query(_CALLS + " select * from r")
def resolve_calls(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d)[0].drop("tree")


@query(_CALLS + " select file_path, name, raw_callee, kind from r where kind in ('ambiguous', 'ambiguous_external', 'unknown')")
def unresolved_calls(spark: SparkSession, d: str) -> DataFrame:
    return calls.unresolved(_resolved(spark, d)[0]).drop("tree")


@query(_CALLS + " select distinct file_path, name from good g where not exists (select 1 from e where e.file_path = g.file_path and e.name = g.name)")
def call_roots(spark: SparkSession, d: str) -> DataFrame:
    r, nodes = _resolved(spark, d)
    return calls.roots(nodes, calls.edges(r)).drop("tree")


@query(_CALLS + " select g.file_path, g.name, count(e.dep_name) as deps from (select distinct file_path, name from good) g left join e on e.file_path = g.file_path and e.name = g.name group by 1, 2")
def call_in_degree(spark: SparkSession, d: str) -> DataFrame:
    r, nodes = _resolved(spark, d)
    return calls.in_degrees(nodes, calls.edges(r)).drop("tree")


@query(_CALLS + " select dep_file as file_path, dep_name as name, file_path as dependent_file, name as dependent_name from e")
def dependents(spark: SparkSession, d: str) -> DataFrame:
    return calls.dependents(calls.edges(_resolved(spark, d)[0])).drop("tree")


def _components(spark: SparkSession, d: str) -> tuple[Scratch, DataFrame, DataFrame]:
    scratch = Scratch(spark, "graph")
    nodes = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n"))
    edges = view(spark, d, "sparse_edges")
    return scratch, scratch.cut(graph.components(scratch, nodes, edges)), edges


_SCC = f"""{cte('sparse_edges').replace('with ', 'with recursive ', 1)}, nodes as (select cast(n_nationkey as bigint) as n from nation),
reach(a, b) as (select n, n from nodes union select r.a, e.dep from reach r join sparse_edges e on e.n = r.b),
scc as (select x.a as n, min(x.b) as comp from reach x join reach y on x.a = y.b and x.b = y.a group by 1),
ce as (select distinct a.comp, b.comp as dep_comp from sparse_edges e join scc a on a.n = e.n join scc b on b.n = e.dep where a.comp <> b.comp)"""


@query(_SCC + " select n, comp from scc")
def scc_components(spark: SparkSession, d: str) -> DataFrame:
    return _components(spark, d)[1]


@query(_SCC + " select comp, count(*) as size, count(*) > 1 as is_cycle from scc group by 1")
def component_sizes(spark: SparkSession, d: str) -> DataFrame:
    return graph.component_sizes(_components(spark, d)[1])


@query(_SCC + " select comp, dep_comp from ce")
def component_edges(spark: SparkSession, d: str) -> DataFrame:
    _, comps, edges = _components(spark, d)
    return graph.component_edges(comps, edges)


_PATHS = ", lv(comp, level) as (select distinct comp, {first} from scc union select {to}, lv.level + 1 from lv join ce on ce.{at} = lv.comp) select comp, max(level) as level from lv group by 1"


@query(_SCC + _PATHS.format(first=0, to="ce.comp", at="dep_comp"))
def topo_levels(spark: SparkSession, d: str) -> DataFrame:
    scratch, comps, edges = _components(spark, d)
    return graph.levels(scratch, comps, graph.component_edges(comps, edges))


@query(_SCC + _PATHS.format(first=1, to="ce.dep_comp", at="comp"))
def bottom_levels(spark: SparkSession, d: str) -> DataFrame:
    scratch, comps, edges = _components(spark, d)
    return graph.bottom_levels(scratch, comps, graph.component_edges(comps, edges))


@query()
def schedule(spark: SparkSession, d: str) -> DataFrame:
    """What a scheduler of four slots starts first on each level."""
    scratch, comps, edges = _components(spark, d)
    ce = graph.component_edges(comps, edges)
    return graph.ready(graph.levels(scratch, comps, ce), graph.bottom_levels(scratch, comps, ce), 4)


@query()
def topo_order(spark: SparkSession, d: str) -> DataFrame:
    scratch, comps, edges = _components(spark, d)
    return graph.topological_order(graph.levels(scratch, comps, graph.component_edges(comps, edges)), scratch)


# extraction and the loop ---------------------------------------------------------------------------------------------


@query(f"""{cte('source_files')} select file_path, split_part(split_part(content, '(', 1), ' ', 2) as name, split_part(split_part(content, 'return ', 2), '(', 1) as callees,
sha256(content) as content_hash, false as has_error, 'python' as language from source_files""")
def extract_functions(spark: SparkSession, d: str) -> DataFrame:
    rows = extract.extract(view(spark, d, "source_files"), source="content")
    return rows.select("file_path", "name", F.array_join("callees", ",").alias("callees"), "content_hash", "has_error", "language")


def _task_functions(spark: SparkSession, d: str) -> DataFrame:
    return extract.extract(spread(table(spark, d, "function_tasks").select("task_id", "repository_id", "file_path", "source")))


@query()
def task_functions(spark: SparkSession, d: str) -> DataFrame:
    """The functions of every queued file."""
    return _task_functions(spark, d).select("task_id", "file_path", "name", "language", F.array_join("callees", ",").alias("callees"), "has_error", "pos", "content_hash")


def _task_calls(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The resolved calls of all queued files and their functions (tree, file_path, name)."""
    f = Scratch(spark, "calls").cut(_task_functions(spark, d).filter(~F.col("has_error")).select(F.col("repository_id").alias("tree"), "file_path", "name", "callees"))
    defs = f.select("tree", "file_path", "name")
    live = _registry(spark, d).filter(~F.col("is_deleted")).select(F.col("repository_id").alias("tree"), "file_path", F.col("function_name").alias("name"))
    outside = live.join(defs.distinct(), ["tree", "file_path", "name"], "left_anti")
    sites = f.select("tree", "file_path", "name", F.explode("callees").alias("raw_callee"))
    return calls.resolve(sites, defs, outside), defs


@query()
def task_calls(spark: SparkSession, d: str) -> DataFrame:
    """The calls between the functions of all queued files, by repository; broken functions take no part."""
    return _task_calls(spark, d)[0].withColumnRenamed("tree", "repository_id")


def _task_graph(spark: SparkSession, d: str) -> tuple[Scratch, DataFrame, DataFrame, DataFrame]:
    """(scratch, functions with their number n, components, edges) of the internal calls of all queued files; numbers run by repository, file and name."""
    scratch = Scratch(spark, "task_graph")
    resolved, defs = _task_calls(spark, d)
    nodes = scratch.cut(row_numbers(scratch, defs.distinct(), list(calls.CALLER), "n"))
    dep = nodes.select("tree", F.col("file_path").alias("dep_file"), F.col("name").alias("dep_name"), F.col("n").alias("dep"))
    pairs = null_safe_join(null_safe_join(calls.edges(resolved), nodes, calls.CALLER, "inner"), dep, ("tree", "dep_file", "dep_name"), "inner")
    edges = scratch.cut(pairs.select("n", "dep"))
    return scratch, nodes, scratch.cut(graph.components(scratch, nodes.select("n"), edges)), edges


def _of_repository(nodes: DataFrame, comps: DataFrame) -> DataFrame:
    """A component is named by one of its functions, which tells the repository."""
    return comps.join(nodes.select(F.col("n").alias("comp"), F.col("tree").alias("repository_id")), "comp")


@query()
def task_components(spark: SparkSession, d: str) -> DataFrame:
    """The strongly connected component of every function of the queued files."""
    _, nodes, comps, _ = _task_graph(spark, d)
    return nodes.join(comps, "n").select(F.col("tree").alias("repository_id"), "file_path", "name", "n", "comp")


@query()
def task_component_sizes(spark: SparkSession, d: str) -> DataFrame:
    _, nodes, comps, _ = _task_graph(spark, d)
    return _of_repository(nodes, graph.component_sizes(comps))


@query()
def task_component_edges(spark: SparkSession, d: str) -> DataFrame:
    _, nodes, comps, edges = _task_graph(spark, d)
    return _of_repository(nodes, graph.component_edges(comps, edges))


@query()
def task_levels(spark: SparkSession, d: str) -> DataFrame:
    scratch, nodes, comps, edges = _task_graph(spark, d)
    return _of_repository(nodes, graph.levels(scratch, comps, graph.component_edges(comps, edges)))


@query()
def task_bottom_levels(spark: SparkSession, d: str) -> DataFrame:
    scratch, nodes, comps, edges = _task_graph(spark, d)
    return _of_repository(nodes, graph.bottom_levels(scratch, comps, graph.component_edges(comps, edges)))


@query()
def task_schedule(spark: SparkSession, d: str) -> DataFrame:
    """What a scheduler of four slots starts first on each level of each repository."""
    scratch, nodes, comps, edges = _task_graph(spark, d)
    ce = scratch.cut(graph.component_edges(comps, edges))
    lv = _of_repository(nodes, graph.levels(scratch, comps, ce))
    return graph.ready(lv, graph.bottom_levels(scratch, comps, ce), 4, ("repository_id",))


@query()
def task_order(spark: SparkSession, d: str) -> DataFrame:
    """Components numbered within their repository so that dependencies come first."""
    scratch, nodes, comps, edges = _task_graph(spark, d)
    lv = _of_repository(nodes, graph.levels(scratch, comps, graph.component_edges(comps, edges)))
    return running_sum(scratch, lv.withColumn("one", F.lit(1).cast("long")), ["repository_id"], ["level", "comp"], "one", "seq").drop("one")


@query("""select task_id, case when mode = 'modified' and length(existing_documentation) > 0 then 'gate' else 'generator' end as route,
case when mode = 'modified' and length(existing_documentation) > 0 and length(existing_documentation) % 2 = 0 then 'keep' else 'generate' end as outcome from function_tasks""")
def gate_routing(spark: SparkSession, d: str) -> DataFrame:
    t = docloop.routes(table(spark, d, "function_tasks").select("task_id", "mode", "existing_documentation"))
    t = t.withColumn("decision", F.when(F.length("existing_documentation") % 2 == 0, "keep"))
    return docloop.gate_outcome(t, "decision").select("task_id", "route", "outcome")


@query(f"""{_D}, t as (select repository_id, file_path, function_name, score, row_number() over (partition by repository_id, file_path, function_name order by id) as i from d where score is not null),
e as (select repository_id, file_path, function_name, min(case when score >= 8 or i = 3 then i end) as iteration from t where i <= 3 group by 1, 2, 3)
select e.*, t.score, case when e.iteration is null then 'open' when t.score >= 8 then 'approved' else 'limit' end as state from e left join t on t.i = e.iteration
and t.repository_id is not distinct from e.repository_id and t.file_path is not distinct from e.file_path and t.function_name is not distinct from e.function_name""")
def refine_outcome(spark: SparkSession, d: str) -> DataFrame:
    turns = logs.once(_log(spark, d).filter(F.col("score").isNotNull()))
    turns = numbered(turns, logs.BY_FILE, "id", "iteration").withColumn("approved", F.col("score") >= docloop.APPROVED_FROM)
    return docloop.outcomes(turns, list(logs.BY_FILE))


@query(f"{cte('replies')} select event_id, cast(json_extract_string(regexp_extract(reply, '\\{{.*\\}}', 0), '$.k') as int) as k from replies")
def parse_reply(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "replies").select("event_id", repaired_json(F.col("reply"), "k int")["k"].alias("k"))


@query(f"""{cte('dep_edges')}, t as (select repository_id - 1 as dep, arg_max(content, id) as text from documentations where is_deleted = false and content <> '' group by 1)
select n, string_agg(concat('# ', n_name, ' (documentation):', chr(10), text), chr(10) || chr(10) order by e.dep) as context from dep_edges e join t on t.dep = e.dep join nation on n_nationkey = e.dep group by 1""")
def dependency_context(spark: SparkSession, d: str) -> DataFrame:
    docs = _log(spark, d).filter(~F.col("is_deleted") & (F.col("content") != "")).groupBy((F.col("repository_id") - 1).alias("dep")).agg(F.max_by("content", "id").alias("text"))
    names = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("dep"), F.col("n_name").alias("name"))
    texts = docs.join(names, "dep").withColumn("kind", F.lit("documentation"))
    return docloop.render_context(view(spark, d, "dep_edges").withColumn("part", F.lit(0)), texts, ["n"])


@query(f"""with {_LIST} select repository_id, sha, substring(commit_date, 1, 10) as day, case when author = '' then '?' else upper(substring(author, 1, 1)) end as initial from l""")
def commit_display(spark: SparkSession, d: str) -> DataFrame:
    c = commits.normalised(table(spark, d, "commits"))
    return c.select("repository_id", "sha", F.substring("commit_date", 1, 10).alias("day"), F.coalesce(F.nullif(F.upper(F.substring("author", 1, 1)), F.lit("")), F.lit("?")).alias("initial"))
