"""Queries of the append-only documentation log; its id is the clock (QRY1-4, JOI2-4, JOI6, AGG1, AGG5, AGG6, WIN1-3).

Rows delivered again count once. Choices per key are maxima by id, aggregated partially before the shuffle; neighbours and
numbers are found in slices of ids, so a key with most of the rows is no burden. Cases: a null function name is a key of its own; a null is_deleted isn't equal to
false and hides a row where the reference filters for live rows, and counts as not deleted where it asks for truth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.functions.joins import null_safe_join
from annalist.operators.scan import numbered, previous

BY_NAME = ("repository_id", "function_name")
BY_FILE = ("repository_id", "file_path", "function_name")


def once(log: DataFrame) -> DataFrame:
    """Each event once, although the log is delivered in part again."""
    return log.dropDuplicates(["id"])


def latest_events(log: DataFrame, key: tuple[str, ...] = BY_NAME) -> DataFrame:
    rest = [c for c in log.columns if c not in (*key, "id")]
    last = F.max_by(F.struct("id", *rest), "id").alias("e")
    return log.filter(F.col("id").isNotNull()).groupBy(*key).agg(last).select(*key, "e.*")


def latest_docs(log: DataFrame, key: tuple[str, ...] = BY_NAME) -> DataFrame:
    """QRY1: the latest event of each name, and then no tombstones. key: BY_NAME as the reference has it, or BY_FILE."""
    return latest_events(log, key).filter(~F.col("is_deleted"))


def last_live_docs(log: DataFrame) -> DataFrame:
    """JOI3: the latest live event of each function; an older one resurfaces behind a tombstone."""
    return latest_events(log.filter(~F.col("is_deleted")), BY_FILE)


def history(log: DataFrame) -> DataFrame:
    """QRY2 for all names: events of a name, tombstones and all files among them, numbered from the newest."""
    return numbered(once(log), BY_NAME, "id", "age", newest_first=True)


def function_history(log: DataFrame, repository_id: int, name: str | None) -> DataFrame:
    """QRY2 for one name; the filters reach the scan."""
    rows = log.filter((F.col("repository_id") == repository_id) & F.col("function_name").eqNullSafe(F.lit(name)))
    return once(rows).orderBy(F.col("id").desc())


def changes(log: DataFrame) -> DataFrame:
    """QRY3 for all commits: deleted, added (no earlier event of the function, or a tombstone) or changed."""
    gone = F.coalesce("is_deleted", F.lit(False))
    rows = previous(once(log), BY_FILE, "id", gone, "__before")
    kind = F.when(gone, "deleted").when(F.coalesce("__before", F.lit(True)), "added").otherwise("changed")
    return rows.withColumn("change", kind).drop("__before")


def change_counts(log: DataFrame) -> DataFrame:
    n = lambda k: F.count(F.when(F.col("change") == k, 1)).alias(k)
    return changes(log).groupBy("repository_id", "commit_sha").agg(n("added"), n("changed"), n("deleted"))


def snapshot(log: DataFrame, ancestors: DataFrame, key: tuple[str, ...] = BY_NAME) -> DataFrame:
    """QRY4: QRY1 over the events of some commits; ancestors: (repository_id, sha). Events without commit never match."""
    within = log.join(ancestors.select("repository_id", F.col("sha").alias("commit_sha")), ["repository_id", "commit_sha"], "left_semi")
    return latest_docs(within, key)


def by_file(docs: DataFrame) -> DataFrame:
    """AGG6: documents per file and their names in order. A file's functions are few; the list is as long as the file has functions."""
    return docs.groupBy("repository_id", "file_path").agg(F.count(F.lit(1)).alias("docs"), F.array_join(F.array_sort(F.collect_list("function_name")), ",").alias("names"))


def existing_docs(functions: DataFrame, log: DataFrame) -> DataFrame:
    """JOI3 as used: each function with the content of its last live doc, '' if there is none."""
    docs = last_live_docs(log).select(*BY_FILE, F.col("content").alias("existing_documentation"))
    out = null_safe_join(functions, docs, BY_FILE, "left")
    return out.withColumn("existing_documentation", F.coalesce("existing_documentation", F.lit("")))


def append(log: DataFrame, rows: DataFrame, scratch=None) -> DataFrame:
    """SNK1: rows as new events with the ids that follow; rows: without id, with `seq`, their order. Returns the new events."""
    from annalist.operators.scan import row_numbers
    from annalist.session import Scratch

    scratch = scratch or Scratch(log.sparkSession, "append")
    top = log.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    out = row_numbers(scratch, rows, ["seq"], "n").crossJoin(F.broadcast(top))  # one row
    out = out.withColumn("id", F.col("top") + F.col("n") + 1).withColumn("is_deleted", F.coalesce("is_deleted", F.lit(False)))
    return out.select(*log.columns)
