"""Queries of the general problems (1, 2, 6, 7) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.operators import changefeed, hierarchy, history, snapshots
from annalist.session import Scratch
from annalist.sources.bucket_store import default_buckets
from annalist.sources.tables import table


def _forest(spark: SparkSession, d: str) -> hierarchy.Forest:
    return hierarchy.peel(spark, hierarchy.commit_nodes(table(spark, d, "commits")), Scratch(spark, "p1"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    rows = _forest(spark, d).depths()
    return rows.select(F.col("tree").alias("repository_id"), F.col("label").alias("sha"), F.col("root").alias("root_sha"), "depth")


def p1_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    h = hierarchy.hierarchy(_forest(spark, d))
    steps = F.aggregate("path", F.lit(0).cast("long"), lambda a, s: a + s["n"])
    return h.select(F.col("tree").alias("repository_id"), F.col("label").alias("sha"), F.col("root").alias("root_sha"), "depth", "n_below", "ancestry", steps.alias("path_nodes"))


def p1_full_paths(spark: SparkSession, d: str) -> DataFrame:
    """Every commit with its path written out, root first and a slash between; null where the ancestry never ends."""
    forest = _forest(spark, d)
    rows = forest.names.select("tree", "label").join(hierarchy.full_paths(forest), ["tree", "label"], "left")
    return rows.select(F.col("tree").alias("repository_id"), F.col("label").alias("sha"), F.array_join("path", "/").alias("path"))


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of a commit and one below it, but for never-ending ancestries."""
    rows = hierarchy.descendants(_forest(spark, d))
    return rows.select(F.col("tree").alias("repository_id"), F.col("label").alias("sha"), F.col("below").alias("below_sha"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    c = snapshots.snapshot_changes(table(spark, d, "registry_snapshots"))
    return c.select("snapshot_no", "repository_id", "file_path", "function_name", "change_kind")


def p2_change_counts(spark: SparkSession, d: str) -> DataFrame:
    c = p2_found(spark, d)
    n = lambda k: F.count(F.when(F.col("change_kind") == k, 1)).alias(k)
    return c.groupBy("snapshot_no", "repository_id").agg(n("added"), n("removed"), n("changed"))


#: The share of a log, by id, that p6 and p7 load at first; the rest arrives as a second batch and is applied to it.
FIRST_LOAD = 0.99


def _cut_id(log: DataFrame) -> int:
    lo, hi = log.agg(F.min("id"), F.max("id")).first()
    return 0 if lo is None else int(lo + (hi - lo) * FIRST_LOAD)


def _history(spark: SparkSession, d: str) -> history.HistoryStore:
    registry, docs = table(spark, d, "function_registry"), table(spark, d, "documentations")
    scratch = Scratch(spark, "p6")
    a, b = _cut_id(registry), _cut_id(docs)

    def changes(r: DataFrame, c: DataFrame) -> DataFrame:
        return history.to_changes(r, "function_registry", "updated_at", F.lower("content_hash")).unionByName(history.to_changes(c, "documentations", "created_at", F.col("commit_sha")))

    first = changes(registry.filter(F.col("id") <= a), docs.filter(F.col("id") <= b))
    store = history.HistoryStore(scratch, scratch.path("history"), default_buckets(spark, first))
    store.load(first)
    store.apply(changes(registry.filter(F.col("id") > a), docs.filter(F.col("id") > b)))
    return store


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return history.as_text(_history(spark, d).versions())


def _feed(spark: SparkSession, d: str) -> changefeed.FeedTable:
    docs = table(spark, d, "documentations").select("id", *changefeed.KEY, "commit_sha", "is_deleted")
    feed = changefeed.FeedTable(spark, Scratch(spark, "p7").path("feed"), default_buckets(spark, docs))
    cut = _cut_id(docs)
    feed.apply(docs.filter(F.col("id") <= cut))
    feed.apply(docs.filter(F.col("id") > cut))
    return feed


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _feed(spark, d).current_ids().select("id")


def p7_current(spark: SparkSession, d: str) -> DataFrame:
    """The rows in force themselves."""
    docs = table(spark, d, "documentations").select("id", *changefeed.KEY, "content", "commit_sha", "score")
    return changefeed.current_rows(docs, _feed(spark, d).current_ids())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found, "p1_hierarchy": p1_hierarchy, "p1_full_paths": p1_full_paths, "p1_descendants": p1_descendants, "p2_found": p2_found, "p2_change_counts": p2_change_counts, "p6_found": p6_found, "p7_found": p7_found, "p7_current": p7_current,
}

_P1_NODES = """
nodes as materialized (
  select repository_id, lower(sha) as k, arg_min(sha, pos) as sha, arg_min(case when len(parents) > 0 then coalesce(lower(parents[1]), '') else '' end, pos) as parent
  from commits where sha is not null and repository_id is not null group by 1, 2),
"""
_P1 = f"""
with recursive {_P1_NODES}
walk(repository_id, k, root_sha, depth) as (
  select n.repository_id, n.k, n.sha, cast(0 as bigint) from nodes n
  where not exists (select 1 from nodes p where p.repository_id = n.repository_id and p.k = n.parent)
  union all
  select c.repository_id, c.k, w.root_sha, w.depth + 1 from walk w join nodes c on c.repository_id = w.repository_id and c.parent = w.k)
select n.repository_id, n.sha, coalesce(w.root_sha, '') as root_sha, coalesce(w.depth, -1) as depth
from nodes n left join walk w on w.repository_id = n.repository_id and w.k = n.k
"""
_P1_WALK = f"""
with recursive {_P1_NODES}
walk(repository_id, k, sha, root_sha, depth, path) as (
  select n.repository_id, n.k, n.sha, n.sha, cast(0 as bigint), n.sha from nodes n where not exists (select 1 from nodes p where p.repository_id = n.repository_id and p.k = n.parent)
  union all
  select c.repository_id, c.k, c.sha, w.root_sha, w.depth + 1, concat(w.path, '/', c.sha) from walk w join nodes c on c.repository_id = w.repository_id and c.parent = w.k),
below(repository_id, k, sha, up) as (
  select w.repository_id, w.k, w.sha, n.parent from walk w join nodes n on n.repository_id = w.repository_id and n.k = w.k
  union all
  select b.repository_id, b.k, b.sha, n.parent from below b join nodes n on n.repository_id = b.repository_id and n.k = b.up),
pairs as (select b.repository_id, n.sha, b.sha as below_sha from below b join nodes n on n.repository_id = b.repository_id and n.k = b.up),
lost as (select n.* from nodes n where not exists (select 1 from walk w where w.repository_id = n.repository_id and w.k = n.k)),
around(repository_id, k, next) as (
  select repository_id, k, parent from lost union select a.repository_id, a.k, l.parent from around a join lost l on l.repository_id = a.repository_id and l.k = a.next),
circle as (select distinct repository_id, k from around where next = k)
"""
_P2 = """
with last as (
  select snapshot_no, repository_id, file_path, function_name, lower(content_hash) as h, coalesce(is_deleted, false) as gone,
    row_number() over (partition by snapshot_no, repository_id, file_path, function_name
      order by loaded_at desc nulls last, registry_id desc nulls last, coalesce(is_deleted, false) desc, lower(content_hash) desc nulls last) as rn
  from registry_snapshots where snapshot_no is not null),
live as (select snapshot_no, repository_id, file_path, function_name, h from last where rn = 1 and not gone),
pairs as (select repository_id, snapshot_no, lead(snapshot_no) over (partition by repository_id order by snapshot_no) as later
  from (select distinct repository_id, snapshot_no from registry_snapshots where snapshot_no is not null)),
old as (select p.later as at, l.* from live l join pairs p on l.repository_id is not distinct from p.repository_id and l.snapshot_no = p.snapshot_no where p.later is not null),
new as (select l.snapshot_no as at, l.* from live l join (select repository_id, later from pairs where later is not null) p
  on l.repository_id is not distinct from p.repository_id and l.snapshot_no = p.later)
select coalesce(n.at, o.at) as snapshot_no, case when n.at is null then o.repository_id else n.repository_id end as repository_id,
  case when n.at is null then o.file_path else n.file_path end as file_path, case when n.at is null then o.function_name else n.function_name end as function_name,
  case when o.at is null then 'added' when n.at is null then 'removed' else 'changed' end as change_kind
from old o full join new n on o.at = n.at and o.repository_id is not distinct from n.repository_id and o.file_path is not distinct from n.file_path
  and o.function_name is not distinct from n.function_name
where o.at is null or n.at is null or o.h is distinct from n.h
"""
_P6 = """
with events as (
  select 'function_registry' as origin, repository_id, file_path, coalesce(function_name, '') as function_name, updated_at as t, id,
    coalesce(lower(content_hash), '') as v, coalesce(is_deleted, false) as gone from function_registry where updated_at is not null and id is not null
  union all
  select 'documentations', repository_id, file_path, coalesce(function_name, ''), created_at, id, coalesce(commit_sha, ''), coalesce(is_deleted, false)
  from documentations where created_at is not null and id is not null),
one as (select * from (select *, row_number() over (partition by origin, repository_id, file_path, function_name, t order by id desc) as rn from events) where rn = 1),
seen as (select *, lag(gone) over w as pg, lag(v) over w as pv from one window w as (partition by origin, repository_id, file_path, function_name order by t)),
points as (select * from seen where (gone and not coalesce(pg, true)) or (not gone and (coalesce(pg, true) or v <> pv))),
ends as (select *, lead(t) over (partition by origin, repository_id, file_path, function_name order by t) as e from points)
select origin, repository_id, file_path, function_name, v as attr_value, strftime(t, '%Y-%m-%d %H:%M:%S') as valid_from, coalesce(strftime(e, '%Y-%m-%d %H:%M:%S'), '') as valid_to
from ends where not gone
"""
_P7_IDS = """
with d as (select distinct id, repository_id, file_path, function_name, commit_sha, coalesce(is_deleted, false) as gone from documentations where id is not null),
v as (select *, row_number() over (partition by repository_id, file_path, function_name, commit_sha, gone order by id) as n from d),
l as (select *, row_number() over (partition by repository_id, file_path, function_name order by id desc) as r from v where n = 1 or commit_sha is null)
"""
ORACLES: dict[str, str] = {
    "p1_found": _P1,
    "p1_full_paths": _P1_WALK + "select n.repository_id, n.sha, w.path from nodes n left join walk w on w.repository_id = n.repository_id and w.k = n.k",
    "p1_descendants": _P1_WALK + "select * from pairs",
    "p1_hierarchy": _P1_WALK + """, size as (select repository_id, sha, count(*) as n from pairs group by 1, 2)
select n.repository_id, n.sha, coalesce(w.root_sha, '') as root_sha, coalesce(w.depth, -1) as depth, case when w.k is not null then coalesce(s.n, 0) end as n_below,
case when w.k is not null then 'rooted' when c.k is not null then 'cycle' else 'below_cycle' end as ancestry, w.depth + 1 as path_nodes
from nodes n left join walk w on w.repository_id = n.repository_id and w.k = n.k left join size s on s.repository_id = n.repository_id and s.sha = n.sha left join circle c on c.repository_id = n.repository_id and c.k = n.k""",
    "p2_found": _P2,
    "p2_change_counts": f"select snapshot_no, repository_id, count(*) filter (where change_kind = 'added') as added, count(*) filter (where change_kind = 'removed') as removed, count(*) filter (where change_kind = 'changed') as changed from ({_P2}) group by 1, 2",
    "p6_found": _P6,
    "p7_found": _P7_IDS + "select id from l where r = 1 and not gone",
    "p7_current": _P7_IDS + "select distinct s.id, s.repository_id, s.file_path, s.function_name, s.content, s.commit_sha, s.score from documentations s join l on s.id = l.id where l.r = 1 and not l.gone",
}
