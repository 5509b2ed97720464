"""What the interface answers: rows in its shape and order (PRJ4, SRT2-5, JOI9).

Order is a column, `place` from 0, so a result can be written by any number of tasks. Times are ISO texts, null if null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.functions.scalar import iso
from annalist.operators import logs
from annalist.operators.scan import numbered, running_sum
from annalist.session import Scratch

_DOC = ("id", "file_path", "function_name", "content", "score", "commit_sha")


def _placed(scratch: Scratch, rows: DataFrame, order: list) -> DataFrame:
    return running_sum(scratch, rows.withColumn("__one", F.lit(1).cast("long")), ["repository_id"], order, "__one", "place").drop("__one")


def docs(scratch: Scratch, latest: DataFrame) -> DataFrame:
    """SRT2: documents in force of each repository by file and name, missing names first."""
    rows = latest.select("repository_id", *_DOC, iso("created_at").alias("created_at"))
    return _placed(scratch, rows, [F.col("file_path").asc_nulls_first(), F.col("function_name").asc_nulls_first(), "id"])


def history(log: DataFrame) -> DataFrame:
    """SRT3: the events of every name, newest first."""
    rows = logs.history(log)
    return rows.select("repository_id", "function_name", (F.col("age") - 1).alias("place"), "id", "content", "score", "commit_sha", "is_deleted", iso("created_at").alias("created_at"))


def changes(log: DataFrame) -> DataFrame:
    """SRT4: the changes of every commit in order of id; content and score not of deletions."""
    rows = numbered(logs.changes(log), ["repository_id", "commit_sha"], "id", "n")
    kept = lambda c: F.when(F.col("change") != "deleted", F.col(c)).alias(c)
    return rows.select("repository_id", "commit_sha", (F.col("n") - 1).alias("place"), "change", "id", "function_name", "file_path", kept("content"), kept("score"))


def oldest_first(listed: DataFrame) -> DataFrame:
    """SRT5: the list turned round for display."""
    last = listed.groupBy("repository_id").agg(F.max("row").alias("last"))
    return listed.join(last, "repository_id").select("repository_id", "sha", (F.col("last") - F.col("row")).alias("place"))


def lookup(requests: DataFrame, repositories: DataFrame) -> DataFrame:
    """JOI9: (full_name, id, status) of every request; unknown names are repo_not_found."""
    known = repositories.select("full_name", "id")
    rows = requests.select("full_name").distinct().join(known, "full_name", "left")
    return rows.select("full_name", "id", F.when(F.col("id").isNull(), "repo_not_found").otherwise("found").alias("status"))
