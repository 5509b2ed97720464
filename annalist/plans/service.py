"""Queries of the service around the log: host pages, responses, changesets, streams and the scheduler, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.functions.scalar import backoff
from annalist.operators import changeset, docloop, extract, graph, logs, registry, responses
from annalist.plans import catalog
from annalist.plans.catalog import _CALLS, _CHANGES, _D, _LANG, _LIST, _PATHS, _SCC, _UP, _listing, _log
from annalist.plans.fixtures import cte, view
from annalist.session import Scratch
from annalist.sources import host
from annalist.sources.tables import table
from annalist.streaming import push

QUERIES: dict[str, catalog.Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: catalog.Query) -> catalog.Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# pages of the host ---------------------------------------------------------------------------------------------------


def _page(full_name, kind: str, ref, page, status, body) -> list:
    return [full_name.alias("full_name"), F.lit(kind).alias("kind"), ref.alias("ref"), page.cast("long").alias("page"), status.cast("int").alias("status"), body.alias("body")]


def _named(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "repositories").select(F.col("id").alias("repository_id"), "full_name")


@query(f"""with {_LIST}, b as (select id as repository_id, 'documented' as name, documented_head_sha as head_sha from repositories union all select repository_id, 'newest', sha from l where row = 0)
select r.full_name, b.name, b.head_sha from b join repositories r on r.id = b.repository_id where r.id % 7 <> 0""")
def host_branches(spark: SparkSession, d: str) -> DataFrame:
    """SRC3: the branches as the host would answer; every seventh repository isn't answered."""
    newest = _listing(spark, d).filter(F.col("row") == 0).select("repository_id", F.lit("newest").alias("name"), F.col("sha").alias("head"))
    marked = table(spark, d, "repositories").select(F.col("id").alias("repository_id"), F.lit("documented").alias("name"), F.col("documented_head_sha").alias("head"))
    item = F.struct("name", F.struct(F.col("head").alias("sha")).alias("commit"))
    rows = marked.unionByName(newest).groupBy("repository_id").agg(F.to_json(F.collect_list(item)).alias("items")).join(_named(spark, d), "repository_id")
    status = F.when(F.col("repository_id") % 7 == 0, 404).otherwise(200)
    return host.branches(rows.select(*_page(F.col("full_name"), "branches", F.lit(None).cast("string"), F.lit(0), status, F.col("items"))))


@query("select full_name, case when id % 5 <> 0 then case when id % 2 = 0 then 'main' else 'master' end end as default_branch from repositories")
def host_default_branches(spark: SparkSession, d: str) -> DataFrame:
    """SRC6."""
    body = F.to_json(F.struct(F.when(F.col("id") % 2 == 0, "main").otherwise("master").alias("default_branch")))
    status = F.when(F.col("id") % 5 == 0, 403).otherwise(200)
    rows = table(spark, d, "repositories").select(*_page(F.col("full_name"), "repository", F.lit(None).cast("string"), F.lit(0), status, body))
    return host.default_branches(rows)


@query("select full_name from repositories where user_id % 3 <> 0")
def host_repositories(spark: SparkSession, d: str) -> DataFrame:
    """SRC8."""
    lists = table(spark, d, "repositories").groupBy("user_id").agg(F.to_json(F.collect_list(F.struct("full_name"))).alias("items"))
    status = F.when(F.col("user_id") % 3 == 0, 401).otherwise(200)
    return host.repositories(lists.select(*_page(F.lit(None).cast("string"), "repositories", F.lit(None).cast("string"), F.lit(0), status, F.col("items"))))


_SHORT = 10
_PAGED = f"p as (select l.*, row // {_SHORT} as page, count(*) over (partition by repository_id) as total from l), q as (select *, case when page % 5 = 4 and repository_id % 2 = 0 then 500 else 200 end as status from p)"


@query(f"""with {_LIST}, {_PAGED} select r.full_name, q.row as place, q.sha, coalesce(q.message, '') as message, q.author, q.commit_date, array_to_string(q.parents, ',') as parents from q join repositories r on r.id = q.repository_id
where not exists (select 1 from q b where b.repository_id = q.repository_id and b.status <> 200 and b.page <= q.page)""")
def host_commits(spark: SparkSession, d: str) -> DataFrame:
    """SRC4: the commits of a ref, read page by page up to the first that fails; pages of ten."""
    listed = _listing(spark, d).withColumn("page", F.floor(F.col("row") / _SHORT))
    author = F.struct(F.when(F.col("row") % 2 == 0, F.col("author")).alias("login"))
    inner = F.struct(F.coalesce("message", F.lit("")).alias("message"), F.struct(F.when(F.col("row") % 2 == 1, F.col("author")).alias("name"), F.col("commit_date").alias("date")).alias("author"))
    item = F.struct("row", "sha", inner.alias("commit"), author.alias("author"), F.transform("parents", lambda p: F.struct(p.alias("sha"))).alias("parents"))
    lists = listed.groupBy("repository_id", "page").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("items")).join(_named(spark, d), "repository_id")
    status = F.when((F.col("page") % 5 == 4) & (F.col("repository_id") % 2 == 0), 500).otherwise(200)
    got = host.commits(lists.select(*_page(F.col("full_name"), "commits", F.lit("main"), F.col("page"), status, F.col("items"))), _SHORT)
    return got.select("full_name", "place", "sha", "message", "author", "commit_date", F.array_join("parents", ",").alias("parents"))


@query(f"{cte('commit_files')} select distinct sha, status, file_path from commit_files where status in ('added', 'modified', 'removed') and regexp_matches(file_path, '\\.(py|js|ts|go|java|cpp|cc|cxx|h|hpp)$')")
def commit_file_statuses(spark: SparkSession, d: str) -> DataFrame:
    """SRC5, FLT2: files of commits as the host lists them; renamed ones and other extensions fall out."""
    lists = view(spark, d, "commit_files").groupBy("sha").agg(F.collect_list(F.struct(F.col("file_path").alias("filename"), "status")).alias("files"))
    rows = lists.select(*_page(F.lit("o/r"), "commit", F.col("sha"), F.lit(0), F.lit(200), F.to_json(F.struct("files"))))
    return push.statuses(host.commit_files(rows), ["sha"])


@query(_UP + ", a as (select up.repository_id, up.head_sha, up.sha, l.row from up join l on l.repository_id = up.repository_id and l.sha = up.sha) select repository_id, head_sha, sha, row_number() over (partition by repository_id order by row) - 1 as place from a")
def ref_listing(spark: SparkSession, d: str) -> DataFrame:
    """SRC4, GRA9: what a ref reaches, newest first."""
    up = catalog._ancestors(spark, d)
    listed = _listing(spark, d).select("repository_id", "sha", "row")
    return catalog.running_sum(Scratch(spark, "ref"), up.join(listed, ["repository_id", "sha"]).withColumn("one", F.lit(1).cast("long")), ["repository_id"], ["row"], "one", "place").select("repository_id", "head_sha", "sha", "place")


# responses -----------------------------------------------------------------------------------------------------------

_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S')"
_DT = _D.replace("is_deleted from", "is_deleted, created_at from")


def _dated(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documentations").select(*catalog._DOCS, "created_at")


@query(f"""{_DT}, l as (select *, row_number() over (partition by repository_id, function_name order by id desc) as r from d), k as (select * from l where r = 1 and is_deleted = false)
select repository_id, id, file_path, function_name, content, score, commit_sha, {_ISO.format('created_at')} as created_at,
row_number() over (partition by repository_id order by file_path nulls first, function_name nulls first, id) - 1 as place from k""")
def docs_response(spark: SparkSession, d: str) -> DataFrame:
    return responses.docs(Scratch(spark, "docs"), logs.latest_docs(_dated(spark, d)))


@query(f"{_DT} select repository_id, function_name, row_number() over (partition by repository_id, function_name order by id desc) - 1 as place, id, content, score, commit_sha, is_deleted, {_ISO.format('created_at')} as created_at from d")
def history_response(spark: SparkSession, d: str) -> DataFrame:
    return responses.history(_dated(spark, d))


@query(f"{_D} select id, content, score, is_deleted from d where repository_id = (select min(repository_id) from documentations) and function_name is not distinct from (select min(function_name) from documentations where repository_id = (select min(repository_id) from documentations))")
def history_of_function(spark: SparkSession, d: str) -> DataFrame:
    """FLT3: the events of one function by name, here the first of the first repository."""
    log = _log(spark, d)
    repo = log.agg(F.min("repository_id")).first()[0]
    name = log.filter(F.col("repository_id") == repo).agg(F.min("function_name")).first()[0]
    return logs.function_history(log, repo, name).select("id", "content", "score", "is_deleted")


@query(f"{_D} select repository_id, count(*) as events, max(id) as last from d where function_name is null group by 1")
def whole_file_events(spark: SparkSession, d: str) -> DataFrame:
    """FLT3 with a null name: equal to null names only."""
    rows = logs.once(_log(spark, d).filter(F.col("function_name").eqNullSafe(F.lit(None))))
    return rows.groupBy("repository_id").agg(F.count(F.lit(1)).alias("events"), F.max("id").alias("last"))


@query(_CHANGES + """ select k.repository_id, k.commit_sha, row_number() over (partition by k.repository_id, k.commit_sha order by k.id) - 1 as place, k.change, k.id, k.function_name, k.file_path,
case when k.change <> 'deleted' then d.content end as content, case when k.change <> 'deleted' then d.score end as score from k join d on d.id = k.id""")
def changes_response(spark: SparkSession, d: str) -> DataFrame:
    return responses.changes(_log(spark, d))


@query(f"with {_LIST} select repository_id, sha, max(row) over (partition by repository_id) - row as place from l")
def commits_oldest_first(spark: SparkSession, d: str) -> DataFrame:
    return responses.oldest_first(_listing(spark, d))


@query("""with q as (select full_name from repositories union select concat(username, '/none') from users)
select q.full_name, r.id, case when r.id is null then 'repo_not_found' else 'found' end as status from q left join repositories r on r.full_name = q.full_name""")
def repo_lookup(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "repositories")
    asked = r.select("full_name").unionByName(table(spark, d, "users").select(F.concat("username", F.lit("/none")).alias("full_name")))
    return responses.lookup(asked, r)


@query(f"{cte('functions_current')} select 0 as repository_id, file_path, name as function_name, arg_max(has_error, pos) as has_error, min(pos) as pos from functions_current group by 1, 2, 3")
def functions_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """AGG4."""
    rows = view(spark, d, "functions_current").select(F.lit(0).alias("repository_id"), "file_path", F.col("name").alias("function_name"), "has_error", "pos")
    return registry.last_wins(rows)


@query("select repository_id, file_path, function_name, min(id) as id, arg_min(coalesce(content_hash, ''), id) as content_hash from function_registry group by 1, 2, 3")
def registry_first_rows(spark: SparkSession, d: str) -> DataFrame:
    """LIM1."""
    rows = table(spark, d, "function_registry").select(*registry.KEY, "id", F.coalesce("content_hash", F.lit("")).alias("content_hash"))
    return registry.first_rows(rows)


# lanes, order, growing graphs ----------------------------------------------------------------------------------------

_LANES = f"""with recursive {_LIST}, s as (select repository_id, sha, row, [coalesce(x, '') for x in parents] as p from l),
w(repository_id, sha, row, lane, lanes) as (
  select repository_id, sha, row, cast(0 as bigint), case when len(p) = 0 then [''] else p end from s where row = 0
  union all
  select repository_id, sha, row, mine - 1, list_reduce(list_prepend(own, [[x] for x in p[2:] if x <> '']), lambda a, x: case when list_contains(a, x[1]) then a when list_contains(a, '') then
    [case when j = list_position(a, '') then x[1] else y end for y, j in a] else list_append(a, x[1]) end) from (
    select *, [case when i = mine then case when len(p) = 0 then '' else p[1] end when x = sha then '' else x end for x, i in case when mine > len(lanes) then list_append(lanes, '') else lanes end] as own from (
      select s.*, w.lanes, coalesce(nullif(list_position(w.lanes, s.sha), 0), nullif(list_position(w.lanes, ''), 0), len(w.lanes) + 1) as mine from w join s on s.repository_id = w.repository_id and s.row = w.row + 1)))"""
_LANES_X = ", x as (select repository_id, row, sha, lane, 18 + 22 * lane as x, 44 * row + 22 as y from w)"


def _component_graph(spark: SparkSession, d: str) -> tuple[Scratch, DataFrame, DataFrame]:
    scratch, comps, edges = catalog._components(spark, d)
    return scratch, comps, scratch.cut(graph.component_edges(comps, edges))


_TOPO = _SCC + ", lv(comp, level) as (select distinct comp, 0 from scc union select ce.comp, lv.level + 1 from lv join ce on ce.dep_comp = lv.comp), t as (select comp, max(level) as level from lv group by 1)"
_BOTTOM = ", bv(comp, level) as (select distinct comp, 1 from scc union select ce.dep_comp, bv.level + 1 from bv join ce on ce.comp = bv.comp), b as (select comp, max(level) as bottom from bv group by 1)"
_QUEUE_DEPTH = 26  # more levels than the graph has nodes
_QUEUE = ", q0 as (select comp, row_number() over (order by comp) - 1 as seq from t where level = 0)" + "".join(
    f""", q{i} as (select * from q{i - 1} union all select comp, (select count(*) from q{i - 1}) + row_number() over (order by last, comp) - 1 from
  (select t.comp, max(q.seq) as last from t join ce on ce.comp = t.comp join q{i - 1} q on q.comp = ce.dep_comp where t.level = {i} group by 1))"""
    for i in range(1, _QUEUE_DEPTH)
)
catalog.ORACLES["topo_order"] = _TOPO + " select comp, level, row_number() over (order by level, comp) - 1 as seq from t"
catalog.ORACLES["schedule"] = _TOPO + _BOTTOM + ", s as (select t.comp, t.level, b.bottom, row_number() over (partition by t.level order by b.bottom desc, t.comp) as place from t join b on b.comp = t.comp) select * from s where place <= 4"
catalog.ORACLES["commit_lanes"] = _LANES + _LANES_X + " select * from x"
catalog.ORACLES["graph_widths"] = _LANES + " select repository_id, greatest(36 + 22 * max(lane), 56) as width from w group by 1"


@query(_TOPO + _QUEUE + f" select q.comp, t.level, q.seq from q{_QUEUE_DEPTH - 1} q join t on t.comp = q.comp")
def topo_queue(spark: SparkSession, d: str) -> DataFrame:
    """GRA7 in the exact order of the queue."""
    scratch, comps, ce = _component_graph(spark, d)
    return graph.queue_order(scratch, scratch.cut(graph.levels(scratch, comps, ce)), ce)


@query(_SCC + ", p as (select n_nationkey as n, max(n_nationkey * 7 % 25) as pos from nation group by 1), f as (select comp, min(pos) as pos from scc join p on p.n = scc.n group by 1) select comp, row_number() over (order by pos) - 1 as comp_id from f")
def component_ids(spark: SparkSession, d: str) -> DataFrame:
    """GRA4: numbers by the earliest member in a list of the nodes."""
    scratch, comps, _ = catalog._components(spark, d)
    places = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n"), (F.col("n_nationkey") * 7 % 25).alias("pos"))
    return graph.component_ids(scratch, comps, places)


def _call_graph(spark: SparkSession, d: str) -> tuple[Scratch, DataFrame, DataFrame, DataFrame]:
    """Components of the internal calls of all current functions, by the rounds that graphs of any size take."""
    scratch = Scratch(spark, "calls")
    resolved, defs = catalog._resolved(spark, d)
    nodes = scratch.cut(catalog.row_numbers(scratch, defs.select("file_path", "name").distinct(), ["file_path", "name"], "n"))
    dep = nodes.select(F.col("file_path").alias("dep_file"), F.col("name").alias("dep_name"), F.col("n").alias("dep"))
    pairs = catalog.calls.edges(resolved).join(nodes, ["file_path", "name"]).join(dep, ["dep_file", "dep_name"])
    edges = scratch.cut(pairs.select("n", "dep"))
    return scratch, nodes, scratch.cut(graph.components(scratch, nodes.select("n"), edges, small=0)), edges


_CALL_SCC = _CALLS.replace("with ", "with recursive ", 1) + """, nodes as (select file_path, name, row_number() over (order by file_path, name) - 1 as n from (select distinct file_path, name from good)),
ne as (select distinct a.n, b.n as dep from e join nodes a on a.file_path = e.file_path and a.name = e.name join nodes b on b.file_path = e.dep_file and b.name = e.dep_name),
reach(a, b) as (select n, n from nodes union select r.a, ne.dep from reach r join ne on ne.n = r.b),
scc as (select x.a as n, min(x.b) as comp from reach x join reach y on x.a = y.b and x.b = y.a group by 1),
ce as (select distinct a.comp, b.comp as dep_comp from ne join scc a on a.n = ne.n join scc b on b.n = ne.dep where a.comp <> b.comp)"""


@query(_CALL_SCC + " select nodes.file_path, nodes.name, scc.comp from scc join nodes on nodes.n = scc.n")
def call_components(spark: SparkSession, d: str) -> DataFrame:
    _, nodes, comps, _ = _call_graph(spark, d)
    return nodes.join(comps, "n").select("file_path", "name", "comp")


@query(_CALL_SCC + _PATHS.format(first=0, to="ce.comp", at="dep_comp"))
def call_levels(spark: SparkSession, d: str) -> DataFrame:
    scratch, _, comps, edges = _call_graph(spark, d)
    return graph.levels(scratch, comps, graph.component_edges(comps, edges), small=0)


@query(_CALL_SCC + _PATHS.format(first=1, to="ce.dep_comp", at="comp"))
def call_bottom_levels(spark: SparkSession, d: str) -> DataFrame:
    scratch, _, comps, edges = _call_graph(spark, d)
    return graph.bottom_levels(scratch, comps, graph.component_edges(comps, edges), small=0)


# extraction ----------------------------------------------------------------------------------------------------------


@query(f"""{cte('language_files')} select file_path, concat(case when lang >= 5 then 'A::' else '' end, 'f_', k) as name, callee as callees, sha256(case when lang = 1 then substr(body, length(concat('const f_', k, ' = ')) + 1) else body end) as content_hash,
false as has_error, map {_LANG}[regexp_extract(file_path, '(\\.[^./]*)$', 1)] as language from language_files""")
def language_functions(spark: SparkSession, d: str) -> DataFrame:
    """EXT1-5, EXT7: one function in each file of seven kinds, with its one call; calls in texts and comments are none."""
    files = view(spark, d, "language_files").select("file_path", F.concat("before", "body", "after").alias("content"))
    rows = extract.extract(files, source="content")
    return rows.select("file_path", "name", F.array_join("callees", ",").alias("callees"), "content_hash", "has_error", "language")


@query(f"""{cte('push_sources')} select file_path, concat('f_', k) as name, k % 23 = 0 as has_error from push_sources where content <> ''""")
def broken_functions(spark: SparkSession, d: str) -> DataFrame:
    """EXT8, FLT7: functions that don't parse are marked, files without text have none."""
    return extract.extract(view(spark, d, "push_sources").select("file_path", "content"), source="content").select("file_path", "name", "has_error")


# changesets and the loop ---------------------------------------------------------------------------------------------


def _count_parts(code: str, context: str, issues: list[str]) -> str:
    if "# fails" in code:
        raise RuntimeError("no answer")
    return f"doc of {len(code)} with {context.count('# ')} parts"


def _model() -> docloop.Model:
    """A model without judgement: what it writes tells the code's length and the parts of its context."""
    return docloop.Model(_count_parts, lambda code, text: '{"approved": true, "score": 9}', sleep=lambda s: None)


def _push(spark: SparkSession, d: str) -> changeset.Outcome:
    files = view(spark, d, "push_sources").select("repository_id", "file_path", "status", "content")
    known = view(spark, d, "push_registry", ("push_sources",)).select(*registry.KEY, "content_hash", "is_deleted")
    log = view(spark, d, "push_log", ("push_sources",)).withColumn("created_at", F.lit(None).cast("timestamp_ntz"))
    return changeset.process(Scratch(spark, "push"), _model(), files, known, log, "c1")


_PUSH = cte("push_sources", "push_registry", "push_log").replace("with ", "with recursive ", 1) + """,
text as (select * from push_sources where content <> ''),
fn as (select repository_id, file_path, concat('f_', k) as function_name, k, status, content, sha256(content) as h, k % 23 = 0 as broken, regexp_extract(content, 'return f_([0-9-]+)', 1) as callee from text),
live as (select * from push_registry where not is_deleted),
kind as (select f.*, case when f.status = 'added' or r.function_name is null then 'new' when r.content_hash <> f.h then 'changed' else 'unchanged' end as kind
  from fn f left join live r on r.repository_id = f.repository_id and r.file_path = f.file_path and r.function_name = f.function_name),
chg as (select * from kind where kind <> 'unchanged'),
gone as (select r.repository_id, r.file_path, r.function_name from live r join push_sources s on s.repository_id = r.repository_id and s.file_path = r.file_path
  where s.status = 'removed' or (s.status = 'modified' and s.content <> '' and r.function_name <> concat('f_', s.k))),
task as (select * from chg where not broken),
link as (select a.k, b.k as dep from task a join task b on a.repository_id = b.repository_id and concat('f_', a.callee) = b.function_name and a.k <> b.k),
reach(a, b) as (select k, k from task union select r.a, l.dep from reach r join link l on l.k = r.b),
comp as (select x.a as k, min(x.b) as comp from reach x join reach y on x.a = y.b and x.b = y.a group by 1),
failed as (select distinct c.comp from comp c join task t on t.k = c.k where t.k % 13 = 0),
part as (select t.k, coalesce(max(case when l.dep is not null and (d.comp = c.comp or d.comp not in (select comp from failed)) then 1 end),
    max(case when l.dep is null and o.function_name is not null and length(g.content) > 0 then 1 end), 0) as parts
  from task t join comp c on c.k = t.k left join link l on l.k = t.k left join comp d on d.k = l.dep
  left join live o on o.repository_id = t.repository_id and o.function_name = concat('f_', t.callee) and not exists (select 1 from chg x where x.repository_id = o.repository_id and x.file_path = o.file_path and x.function_name = o.function_name)
    and not exists (select 1 from task x where x.repository_id = t.repository_id and x.function_name = concat('f_', t.callee))
  left join push_log g on g.repository_id = o.repository_id and g.file_path = o.file_path and g.function_name = o.function_name group by 1),
res as (select t.*, c.comp in (select comp from failed) as bad, concat('doc of ', length(t.content), ' with ', p.parts, ' parts') as doc from task t join comp c on c.k = t.k join part p on p.k = t.k)"""


@query(_PUSH + """, n as (select 0 as turn, *, cast(null as varchar) as content from gone union all select 1, repository_id, file_path, function_name, doc from res where not bad)
select (select max(id) from push_log) + row_number() over (order by turn, repository_id, file_path, function_name) as id, repository_id, file_path, function_name, content, 'c1' as commit_sha, case when turn = 1 then 9 end as score, turn = 0 as is_deleted from n""")
def push_appended(spark: SparkSession, d: str) -> DataFrame:
    """SCH5, LLM7, SNK1, SNK2: what a push appends to the log."""
    return _push(spark, d).appended.drop("created_at")


@query(_PUSH + """ select repository_id, file_path, function_name, h as content_hash, false as is_deleted from chg union all
select r.repository_id, r.file_path, r.function_name, r.content_hash, r.is_deleted or g.function_name is not null from push_registry r left join gone g on g.repository_id = r.repository_id and g.file_path = r.file_path and g.function_name = r.function_name
where not exists (select 1 from chg c where c.repository_id = r.repository_id and c.file_path = r.file_path and c.function_name = r.function_name)""")
def push_registry_next(spark: SparkSession, d: str) -> DataFrame:
    """SCH5: the registry after a push; functions that don't parse are registered too."""
    return _push(spark, d).registry


@query(_PUSH + " select repository_id, file_path, function_name from chg where broken")
def push_broken(spark: SparkSession, d: str) -> DataFrame:
    """FLT6: functions of a push that are not documented."""
    return _push(spark, d).broken


@query(_PUSH + " select repository_id, file_path, function_name, case when kind = 'new' then 'added' else 'modified' end as mode, case when not bad then doc end as documentation, bad as failed, case when bad then 3 else 1 end as attempts from res")
def push_results(spark: SparkSession, d: str) -> DataFrame:
    """SCH1-3, LLM3, LLM6, LLM8, LLM9, JOI4: every task's outcome; a failed component's dependents go on without it."""
    r = _push(spark, d).results
    return r.select(*registry.KEY, "mode", "documentation", F.col("error").isNotNull().alias("failed"), "attempts")


@query(_PUSH + " select r.repository_id, r.file_path, r.function_name, a as attempt, 0.5 * power(2, a) as seconds from res r, (select unnest([0, 1]) as a) where bad")
def push_retries(spark: SparkSession, d: str) -> DataFrame:
    """SCH2: how long a failed task's component waited behind each attempt."""
    r = _push(spark, d).results.select(*registry.KEY, F.posexplode(F.sequence(F.lit(0), F.col("attempts") - 1)).alias("attempt", "x"), "attempts")
    return r.filter(F.col("attempt") < F.col("attempts") - 1).select(*registry.KEY, "attempt", backoff(F.col("attempt")).alias("seconds"))


@query(_PUSH + " select count(*) filter (where not bad) as documented, count(*) filter (where bad) as failed from res")
def push_tallies(spark: SparkSession, d: str) -> DataFrame:
    """AGG9."""
    return docloop.tallies(_push(spark, d).results)


@query(_PUSH + """, hit as (select repository_id, file_path from chg union select repository_id, file_path from gone)
select s.repository_id, s.file_path, s.status, case when s.status = 'removed' then 'removed' when coalesce(s.content, '') = '' then 'empty' when h.file_path is not null or s.status = 'added' then 'processed' else 'skipped' end as outcome
from push_sources s left join hit h on h.repository_id = s.repository_id and h.file_path = s.file_path""")
def push_files_outcome(spark: SparkSession, d: str) -> DataFrame:
    """FLT7, QRY8: what became of every file of a push."""
    return _push(spark, d).files


@query(ORACLES["push_registry_next"])
def backfilled_registry(spark: SparkSession, d: str) -> DataFrame:
    """STR4: the same files as two commits, one after the other, on what each leaves."""
    files = view(spark, d, "push_sources").select(F.concat(F.lit("c"), F.floor(F.col("k") / 3) % 2).alias("sha"), "repository_id", "file_path", "status", "content")
    known = view(spark, d, "push_registry", ("push_sources",)).select(*registry.KEY, "content_hash", "is_deleted")
    log = view(spark, d, "push_log", ("push_sources",)).withColumn("created_at", F.lit(None).cast("timestamp_ntz"))
    steps = spark.createDataFrame([("c0", 0), ("c1", 1)], "sha string, step int")
    return changeset.backfill(Scratch(spark, "backfill"), _model(), steps, files, known, log)[0]


@query("with t as (select * from function_tasks where mode = 'modified' and length(existing_documentation) > 0 and length(existing_documentation) % 2 = 0) select (select count(*) from function_tasks) - count(*) as written, count(*) as kept from t")
def written_after_gate(spark: SparkSession, d: str) -> DataFrame:
    """LLM2, LLM7: what is kept writes nothing."""
    routed = catalog.gate_routing(spark, d)
    kept = F.count(F.when(F.col("outcome") == "keep", 1))
    return routed.agg((F.count(F.lit(1)) - kept).alias("written"), kept.alias("kept"))


# streams -------------------------------------------------------------------------------------------------------------


def _streamed(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The pushes of `push_changed_files` as payload files, read as a stream in several batches, one of which runs twice."""
    scratch = Scratch(spark, "stream")
    files = view(spark, d, "push_files")
    of = lambda s: F.collect_list(F.when(F.col("status") == s, F.col("file_path"))).alias(s)
    lists = files.groupBy("push_id").agg(*[of(s) for s in push.STATUSES])
    body = F.struct(F.struct(F.concat(F.lit("o/"), "push_id").alias("full_name")).alias("repository"), F.lit("refs/heads/main").alias("ref"), F.array(F.struct(*push.STATUSES)).alias("commits"))
    landing, out = scratch.path("landing"), scratch.path("out")
    lists.select(F.to_json(body).alias("value")).write.text(landing)
    stream = spark.readStream.option("maxFilesPerTrigger", 2).text(landing)
    process = lambda p: {"files": push.changed_files(p, ["full_name"])}
    done = push.start(stream, out, scratch.path("checkpoint"), process, once=True)
    done.awaitTermination()
    push.start(stream, out, scratch.path("checkpoint"), process, once=True).awaitTermination()  # the same batches again
    return spark.read.parquet(f"{out}/{name}").drop("batch")


@query(f"{cte('push_files')} select distinct concat('o/', push_id) as full_name, status, file_path from push_files where regexp_matches(file_path, '\\.(py|js|ts|go|java|cpp|cc|cxx|h|hpp)$')")
def streamed_push_files(spark: SparkSession, d: str) -> DataFrame:
    """SRC9, STR1, STR5: a stream's batches, run again too, leave what one batch would."""
    return _streamed(spark, d, "files")


@query(f"{cte('push_files')} select distinct concat('o/', push_id) as full_name, concat('{{\"type\":\"push\",\"full_name\":\"o/', push_id, '\",\"branch\":\"main\",\"after\":\"\"}}') as message from push_files")
def streamed_notifications(spark: SparkSession, d: str) -> DataFrame:
    """STR2, SNK12: what the subscribers of each repository are told."""
    return _streamed(spark, d, "notifications")
