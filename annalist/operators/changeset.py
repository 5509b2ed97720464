"""The changeset of a push from end to end (SCH5, STR1, QRY8, FLT6, FLT7, JOI4, LLM7, LLM8).

Changed files become functions once, these are held against the registry, what is new or changed is resolved into a call
graph, condensed and documented level by level, and the outcome is what to append to the log and the registry's next
state. Every step is a frame; nothing is written here, so a step that runs again has no effect twice.

Cases: files without text (null or empty) are skipped, and what the registry has of them stays; a modified file without a
difference is skipped; broken functions are registered but neither documented nor found by calls; of functions that share
a key the last one counts; removed files go first.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.functions.joins import null_safe_join
from annalist.operators import calls, docloop, extract, graph, logs, registry
from annalist.operators.scan import row_numbers
from annalist.session import Scratch


@dataclass
class Outcome:
    appended: DataFrame  # new events of the log, with their ids
    registry: DataFrame  # KEY, content_hash, is_deleted: the next state
    results: DataFrame  # KEY, mode, documentation, score, iteration, approved, written, error, attempts of every task
    broken: DataFrame  # KEY of functions that aren't documented because they don't parse
    files: DataFrame  # repository_id, file_path, status, outcome: removed, processed, skipped or empty


def process(scratch: Scratch, model: docloop.Model, files: DataFrame, known: DataFrame, log: DataFrame, commit_sha: str, concurrency: int = docloop.CONCURRENCY) -> Outcome:
    """files: (repository_id, file_path, status, content) of the changed files; known: the registry's current states; log: documentations."""
    cut, file, key = scratch.cut, list(registry.FILE), list(registry.KEY)
    at = F.lit(commit_sha).alias("commit_sha")
    removed = files.filter(F.col("status") == "removed").select(*file, at)
    texts = files.filter(F.col("status").isin("added", "modified") & (F.length("content") > 0))
    found = extract.extract(texts.select(*file, "status", F.col("content").alias("source"))).withColumnRenamed("name", "function_name")
    functions = cut(registry.last_wins(found.select(*key, "status", "source", "content_hash", "callees", "has_error", "pos")), "functions")

    modified = functions.filter(F.col("status") == "modified")
    of = texts.filter(F.col("status") == "modified").select(*file)
    kinds = cut(registry.diff(modified.select(*key, "content_hash"), known, of), "kinds")
    kind = F.when(F.col("status") == "added", "new").otherwise(F.col("kind")).alias("kind")
    changed = null_safe_join(functions, kinds.select(*key, "kind"), key, "left").select(*functions.columns, kind).filter(F.col("kind").isin("new", "changed"))
    changed = cut(changed, "changed")
    gone = kinds.filter(F.col("kind") == "deleted").select(*key, at).unionByName(registry.of_removed_files(known, removed))
    gone = cut(gone.distinct(), "gone")

    sound = changed.filter(~F.col("has_error"))
    old = logs.existing_docs(sound.select(*key, F.when(F.col("kind") == "new", "added").otherwise("modified").alias("mode")), log)
    old = old.withColumn("existing_documentation", F.when(F.col("mode") == "modified", F.col("existing_documentation")).otherwise(""))
    tasks = null_safe_join(sound.select(*key, "source", "callees"), old, key, "inner")
    tasks = cut(row_numbers(scratch, tasks, key, "n"), "tasks")
    results = cut(_document(scratch, model, tasks, changed, known, log, concurrency), "results")

    docs = results.filter(F.col("error").isNull() & F.col("written"))
    docs = docs.select(*key, F.col("documentation").alias("content"), at, "score", F.lit(False).alias("is_deleted"), F.lit(1).alias("turn"))
    dead = registry.tombstones(gone).withColumn("turn", F.lit(0))
    rows = dead.unionByName(docs).withColumn("created_at", F.current_timestamp().cast("timestamp_ntz")).withColumn("seq", F.struct("turn", *key))
    appended = cut(logs.append(log, rows, scratch), "appended")
    state = registry.upsert(registry.soft_delete(known, gone), changed)

    touched = changed.select(*file).unionByName(gone.select(*file)).distinct().withColumn("hit", F.lit(True))
    seen = null_safe_join(files, touched, file, "left")
    outcome = F.when(F.col("status") == "removed", "removed").when(F.coalesce(F.length("content"), F.lit(0)) == 0, "empty").when(F.col("hit") | (F.col("status") == "added"), "processed").otherwise("skipped")
    return Outcome(appended, state, results, changed.filter("has_error").select(*key), seen.select(*file, "status", outcome.alias("outcome")))


def backfill(scratch: Scratch, model: docloop.Model, steps: DataFrame, files: DataFrame, known: DataFrame, log: DataFrame, advance: Callable[[str], None] = lambda sha: None) -> tuple[DataFrame, DataFrame, int]:
    """STR4, QRY8: one repository's commits behind the mark, oldest first, each a changeset against what the one before left; the mark follows the work.

    steps: (sha, step) as of `commits.gap`; files: (sha, repository_id, file_path, status, content). For a full replay the
    repository's data goes first (`registry.without_repositories`) and the mark is none. Returns the registry, the log's
    new events, and how many commits were applied.
    """
    state, fresh, done = known.select(*registry.KEY, "content_hash", "is_deleted"), None, 0
    while True:
        part = [r["sha"] for r in steps.filter((F.col("step") >= done) & (F.col("step") < done + 100)).orderBy("step").collect()]  # a hundred at a time
        for sha in part:
            own = files.filter((F.col("sha") == sha) & F.col("status").isin("added", "modified", "removed")).drop("sha")
            out = process(scratch, model, own, state, log if fresh is None else log.unionByName(fresh), sha)
            state = scratch.cut(out.registry, "registry")
            fresh = out.appended if fresh is None else fresh.unionByName(out.appended)
            advance(sha)
        done += len(part)
        if len(part) < 100:
            return state, fresh if fresh is not None else log.limit(0), done


def external_documentation(resolved: DataFrame, tasks: DataFrame, log: DataFrame) -> DataFrame:
    """JOI4: (n, name, text): the last live documentation of the functions outside that each task calls; empty and missing ones fall out."""
    ext = resolved.filter(F.col("kind") == "external").select("tree", "file_path", "name", "target_file", "target_name").distinct()
    own = tasks.select("n", F.col("repository_id").alias("tree"), "file_path", F.col("function_name").alias("name"))
    ext = null_safe_join(ext, own, calls.CALLER, "inner").select("n", F.col("tree").alias("repository_id"), F.col("target_file").alias("file_path"), F.col("target_name").alias("function_name"))
    docs = logs.last_live_docs(log).select(*registry.KEY, F.col("content").alias("text"))
    return null_safe_join(ext, docs, registry.KEY, "inner").filter(F.length("text") > 0).select("n", F.col("function_name").alias("name"), "text")


def _document(scratch: Scratch, model: docloop.Model, tasks: DataFrame, changed: DataFrame, known: DataFrame, log: DataFrame, concurrency: int) -> DataFrame:
    named = [F.col("repository_id").alias("tree"), "file_path", F.col("function_name").alias("name")]
    defs = tasks.select(*named)
    outside = registry.outside_changeset(known, changed).select(*named)
    sites = tasks.select(*named, F.explode("callees").alias("raw_callee"))
    resolved = scratch.cut(calls.resolve(sites, defs, outside), "resolved")
    nodes = tasks.select("n", *named)
    dep = nodes.select("tree", F.col("file_path").alias("dep_file"), F.col("name").alias("dep_name"), F.col("n").alias("dep"))
    pairs = null_safe_join(null_safe_join(calls.edges(resolved), nodes, calls.CALLER, "inner"), dep, ("tree", "dep_file", "dep_name"), "inner")
    edges = scratch.cut(pairs.select("n", "dep"), "edges")
    comps = scratch.cut(graph.components(scratch, nodes.select("n"), edges), "comps")
    levels = scratch.cut(graph.levels(scratch, comps, graph.component_edges(comps, edges)), "levels")
    rows = tasks.select("n", F.col("function_name").alias("name"), "source", "mode", "existing_documentation").join(comps, "n")
    got = docloop.run_levels(scratch, model, rows, edges, levels, external_documentation(resolved, tasks, log), concurrency)
    return got.join(tasks.select("n", *registry.KEY, "mode"), "n").select(*registry.KEY, "mode", "documentation", "score", "iteration", "approved", "written", "error", "attempts")
