"""Push events as a stream, notifications, and replay (SRC2, SRC9, STR1, STR2, STR4, STR5, SNK7, SNK12).

A micro-batch of pushes is reduced to changed files, these to new, changed and deleted functions; what results is
written under the batch's number, so a batch that runs again replaces its own rows and nothing else: at least once in
work, once in effect. The checkpoint is the position in the stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from annalist.functions.scalar import branch_of, supported_path
from annalist.schemas import PUSH

STATUSES = ("added", "modified", "removed")


def parse(payloads: DataFrame, column: str = "value") -> DataFrame:
    """SRC2: push payloads as columns; missing keys are empty; payloads without a repository's name go to `unreadable`."""
    p = payloads.withColumn("p", F.from_json(column, PUSH))
    empty = lambda c: F.coalesce(c, F.lit(""))
    return p.select(
        *[c for c in payloads.columns if c != column], empty(F.col("p.repository.full_name")).alias("full_name"), empty(F.col("p.pusher.name")).alias("pusher"),
        branch_of(empty(F.col("p.ref"))).alias("branch"), empty(F.col("p.after")).alias("after"), F.coalesce("p.commits", F.array().cast(PUSH["commits"].dataType)).alias("commits"),
    ).filter(F.col("full_name") != "")


def unreadable(payloads: DataFrame, column: str = "value") -> DataFrame:
    """The payloads that `parse` drops, as they came."""
    name = F.from_json(column, PUSH)["repository"]["full_name"]
    return payloads.filter(F.coalesce(name, F.lit("")) == "")


def changed_files(pushes: DataFrame, key: list[str]) -> DataFrame:
    """AGG2, FLT1, SET1: (key, status, file_path): the union of a push's commits, supported files only, each once per status."""
    c = pushes.select(*key, F.explode("commits").alias("c"))
    lists = F.array(*[F.struct(F.lit(s).alias("status"), F.coalesce(F.col(f"c.{s}"), F.array().cast("array<string>")).alias("files")) for s in STATUSES])
    rows = c.select(*key, F.explode(lists).alias("l")).select(*key, "l.status", F.explode("l.files").alias("file_path"))
    return rows.filter(supported_path("file_path")).distinct()


def statuses(files: DataFrame, key: list[str]) -> DataFrame:
    """FLT2: other statuses, renames among them, fall out."""
    return files.filter(F.col("status").isin(*STATUSES)).filter(supported_path("file_path")).select(*key, "status", "file_path").distinct()


def push_stream(spark: SparkSession, landing: str, per_trigger: int = 1000) -> DataFrame:
    """SRC9: payload files as a stream of (value)."""
    return spark.readStream.option("maxFilesPerTrigger", per_trigger).option("wholetext", True).text(landing)


def notifications(pushes: DataFrame) -> DataFrame:
    """STR2: what subscribers of a repository are told."""
    return pushes.select("full_name", F.to_json(F.struct(F.lit("push").alias("type"), "full_name", "branch", "after")).alias("message"))


def start(pushes: DataFrame, out: str, checkpoint: str, process: Callable[[DataFrame], dict[str, DataFrame]], once: bool = False) -> StreamingQuery:
    """STR1: runs `process` on the parsed pushes of each batch and writes its tables, after the notifications, under the batch's number.

    once: ends when what is there has been read. Payloads that can't be read are kept as the table `unreadable`.
    """

    def each(batch: DataFrame, number: int) -> None:
        pushes_ = parse(batch)
        tables = {"notifications": notifications(pushes_), "unreadable": unreadable(batch)} | process(pushes_)
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")

    query = pushes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if once else query).start()


def replay(spark: SparkSession, steps: DataFrame, apply: Callable[[str, DataFrame], None], advance: Callable[[str], None], files: DataFrame) -> int:
    """STR4: commits after the mark, oldest first, one by one, because each diff reads what the last one left; the mark follows the work.

    steps: (sha, step) of one repository (`commits.gap`); files: (sha, status, file_path). Commits come in portions, so a
    long gap isn't held at once. Returns how many were applied.
    """
    done = 0
    while True:
        part = [r["sha"] for r in steps.filter((F.col("step") >= done) & (F.col("step") < done + 100)).orderBy("step").collect()]
        for sha in part:
            apply(sha, statuses(files.filter(F.col("sha") == sha), ["sha"]))
            advance(sha)
        done += len(part)
        if len(part) < 100:
            return done
