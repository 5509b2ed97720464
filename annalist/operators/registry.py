"""The registry of functions: current state, three-way diff, upsert, tombstones and cascades (JOI1, JOI7, AGG4, SNK2-6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.functions.joins import null_safe_join

FILE = ("repository_id", "file_path")
KEY = (*FILE, "function_name")


def current(states: DataFrame) -> DataFrame:
    """The last stored state of each key, by id."""
    rest = [c for c in states.columns if c not in KEY]
    return states.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "id").alias("s")).select(*KEY, "s.*")


def first_rows(rows: DataFrame) -> DataFrame:
    """LIM1: of rows that share a key, which should be unique, the one with the least id."""
    rest = [c for c in rows.columns if c not in KEY]
    return rows.groupBy(*KEY).agg(F.min_by(F.struct(*rest), "id").alias("s")).select(*KEY, "s.*")


def last_wins(functions: DataFrame, pos: str = "pos") -> DataFrame:
    """AGG4: one row per function, the last one, at the place where the name was first seen."""
    rest = [c for c in functions.columns if c not in (*KEY, pos)]
    return functions.groupBy(*KEY).agg(F.max_by(F.struct(*rest), pos).alias("s"), F.min(pos).alias(pos)).select(*KEY, "s.*", pos)


def diff(functions: DataFrame, registry: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """JOI1: per function of the files at hand new, changed, unchanged or deleted. functions: KEY, content_hash; registry: current states.

    files: (FILE) of the files compared; if None, those that have functions now.
    """
    files = (functions if files is None else files).select(*FILE).distinct()
    live = null_safe_join(registry.filter(~F.col("is_deleted")), files, FILE, "left_semi").select(*[F.col(k).alias(f"r_{k}") for k in KEY], F.col("content_hash").alias("old_hash"))
    cur = functions.select(*KEY, F.col("content_hash").alias("new_hash"), F.lit(True).alias("here"))
    on = None
    for k in KEY:
        eq = F.col(k).eqNullSafe(F.col(f"r_{k}"))
        on = eq if on is None else on & eq
    both = cur.join(live.withColumn("there", F.lit(True)), on, "full_outer")
    kind = F.when(F.col("there").isNull(), "new").when(F.col("here").isNull(), "deleted").when(F.col("old_hash").eqNullSafe(F.col("new_hash")), "unchanged").otherwise("changed")
    keys = [F.when(F.col("here").isNull(), F.col(f"r_{k}")).otherwise(F.col(k)).alias(k) for k in KEY]
    return both.select(*keys, "old_hash", "new_hash", kind.alias("kind"))


def upsert(registry: DataFrame, functions: DataFrame) -> DataFrame:
    """SNK3: known functions get their hash and are live again, others are added; rows of other keys stay. (KEY, content_hash, is_deleted)."""
    old = registry.select(*KEY, "content_hash", "is_deleted")
    new = functions.select(*KEY, "content_hash").withColumn("is_deleted", F.lit(False))
    return null_safe_join(old, new, KEY, "left_anti").unionByName(new)


def tombstones(deleted: DataFrame) -> DataFrame:
    """SNK2: the log's rows for deleted functions (KEY, commit_sha), whether or not the registry knows them."""
    none = lambda t: F.lit(None).cast(t)
    return deleted.select("repository_id", "function_name", "file_path", none("string").alias("content"), "commit_sha", none("int").alias("score"), F.lit(True).alias("is_deleted"))


def soft_delete(registry: DataFrame, deleted: DataFrame) -> DataFrame:
    """SNK4: the registry with the deleted functions marked."""
    keys = deleted.select(*KEY).distinct().withColumn("__gone", F.lit(True))
    out = null_safe_join(registry, keys, KEY, "left")
    return out.withColumn("is_deleted", F.coalesce("__gone", "is_deleted")).drop("__gone")


def of_removed_files(registry: DataFrame, removed: DataFrame) -> DataFrame:
    """SNK5: all live functions of removed files (FILE, commit_sha), as input of `tombstones` and `soft_delete`."""
    return null_safe_join(registry.filter(~F.col("is_deleted")).select(*KEY), removed.select(*FILE, "commit_sha").distinct(), FILE).select(*KEY, "commit_sha")


def outside_changeset(registry: DataFrame, changeset: DataFrame) -> DataFrame:
    """JOI7: live functions that the changeset doesn't hold."""
    return null_safe_join(registry.filter(~F.col("is_deleted")), changeset.select(*KEY).distinct(), KEY, "left_anti")


def delete_counts(docs: DataFrame, registry: DataFrame) -> DataFrame:
    """SNK6/AGG8: the rows that deleting a repository's data would remove; the delete itself is a filter on repository_id."""
    d = docs.groupBy("repository_id").agg(F.count(F.lit(1)).alias("docs"))
    r = registry.groupBy("repository_id").agg(F.count(F.lit(1)).alias("functions"))
    return d.join(r, "repository_id", "full_outer").select("repository_id", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("functions", F.lit(0)).alias("functions"))


def without_repositories(rows: DataFrame, repositories: DataFrame) -> DataFrame:
    """SNK6: what is left of a relation after the data of `repositories` (repository_id) is deleted for good; written as a new version."""
    return rows.join(repositories.select("repository_id").distinct(), "repository_id", "left_anti")
