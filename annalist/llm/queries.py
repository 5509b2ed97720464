"""Queries of the problems tagged llm and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annalist.llm import generated, mixing, packing, secrets, sentences, syntax
from annalist.session import Scratch
from annalist.sources.tables import spread, table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    flagged = syntax.flag_syntax(spread(table(spark, d, "function_tasks").select("task_id", "file_path", "source")))
    return flagged.filter(F.col("syntax_problem").isNotNull()).select("task_id")


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.syntax_rates(syntax.flag_syntax(spread(table(spark, d, "function_tasks").select("repository_id", "file_path", "source"))))


def _owners(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "repositories").select(F.col("id").alias("tree"), F.substring_index("full_name", "/", 1).alias("owner"))


def _p4(spark: SparkSession, d: str) -> DataFrame:
    tasks = spread(table(spark, d, "function_tasks").select("task_id", "repository_id", "file_path", "source"))
    return generated.not_hand_written(tasks, table(spark, d, "library_files"), Scratch(spark, "p4"), _owners(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _p4(spark, d).filter(F.col("reason").isNotNull()).select("task_id")


def p4_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Files per repository and reason; hand_written for the rest."""
    return _p4(spark, d).groupBy("repository_id", F.coalesce("reason", F.lit("hand_written")).alias("reason")).agg(F.count(F.lit(1)).alias("files"))


def p4_shared_subtrees(spark: SparkSession, d: str) -> DataFrame:
    """Directories that repositories of different owners have in common, file by file."""
    scratch = Scratch(spark, "p4")
    leaves = generated.describe(table(spark, d, "function_tasks"), ["repository_id"], "file_path", "source")
    dirs = generated.merkle_directories(leaves.select(F.col("repository_id").alias("tree"), F.col("file_path").alias("path"), "content"), scratch)
    return generated.shared_subtrees(dirs, _owners(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    tasks = secrets.find_secrets(spread(table(spark, d, "function_tasks").select("task_id", "file_path", "source")), "function_tasks", "task_id", "source", "file_path")
    docs = secrets.find_secrets(spread(table(spark, d, "documentations").select("id", "content").filter(secrets.may_hold("content"))), "documentations", "id", "content").distinct()
    return tasks.unionByName(docs)


def p5_redacted_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Every file with its credentials masked."""
    return secrets.redact(table(spark, d, "function_tasks").select("task_id", "file_path", "source"), "source", "file_path")


def p5_redacted_documentations(spark: SparkSession, d: str) -> DataFrame:
    """Every row of the log, repeated ones too, with its text's credentials masked."""
    return secrets.redact(spread(table(spark, d, "documentations").select("id", "content")), "content")


def _capacities(spark: SparkSession, d: str) -> list[tuple[int, int]]:
    return [tuple(r) for r in table(spark, d, "pack_capacities").select("capacity_id", "capacity_tokens").collect()]  # a fixed table


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    """Container, place and size of every text, for each capacity."""
    return packing.pack_documents(spread(table(spark, d, "documents").select("doc_id", "text")), _capacities(spark, d))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are in each of their limits."""
    return packing.fill_rates(p8_packed(spark, d), _capacities(spark, d))


def p8_violations(spark: SparkSession, d: str) -> DataFrame:
    """What breaks a limit, is lost or placed twice: nothing."""
    packed = Scratch(spark, "p8").cut(p8_packed(spark, d))
    return packing.violations(packed, table(spark, d, "documents").select("doc_id", "text"), _capacities(spark, d))


def _p9(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    targets = [tuple(r) for r in table(spark, d, "mix_targets").select("source", "target_share", "max_repeats").collect()]  # a fixed table
    return mixing.mix(Scratch(spark, "p9"), spread(table(spark, d, "documents").select("doc_id", "source", "text")), targets)


def p9_mixed(spark: SparkSession, d: str) -> DataFrame:
    """The chosen records and how often each is used."""
    return _p9(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _p9(spark, d)[1]


def p9_violations(spark: SparkSession, d: str) -> DataFrame:
    """Chosen records that are used too often, twice in the list, empty or of no target: none."""
    targets = table(spark, d, "mix_targets").select(F.lower(F.trim("source")).alias("source"), "max_repeats")
    chosen = _p9(spark, d)[0]
    twice = chosen.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id", F.lit("twice").alias("what"))
    j = chosen.join(targets, "source", "left")
    wrong = j.filter(~F.coalesce((F.col("repeats") <= F.col("max_repeats")) & (F.col("repeats") > 0) & (F.col("tokens") > 0), F.lit(False)))
    return twice.unionByName(wrong.select("doc_id", F.lit("limit").alias("what")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split_sentences(spread(table(spark, d, "documents").select("doc_id", "text")), with_text=False).select("doc_id", "sent_start", "sent_end")


def p10_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The sentences themselves."""
    return sentences.split_sentences(spread(table(spark, d, "documents").select("doc_id", "text"))).select("doc_id", "sent_no", "sentence")


def p10_violations(spark: SparkSession, d: str) -> DataFrame:
    """Texts of which sentences overlap, begin or end with white space, or leave anything else out: none."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    got = sentences.split_sentences(spread(docs))
    plain = lambda c: F.length(F.regexp_replace(c, r"[\s\p{Z}\x1c-\x1f\x85]", ""))
    after = F.lead("sent_start").over(Window.partitionBy("doc_id").orderBy("sent_no"))  # a text's sentences, within one task anyway
    rows = got.withColumn("after", after).withColumn("bad", (F.col("after") < F.col("sent_end")) | (F.trim("sentence") != F.col("sentence")) | (F.length("sentence") != F.col("sent_end") - F.col("sent_start")))
    per = rows.groupBy("doc_id").agg(F.max("bad").alias("bad"), F.sum(plain(F.col("sentence"))).alias("kept"))
    return docs.join(per, "doc_id", "left").filter(F.coalesce("bad", F.lit(False)) | (F.coalesce("kept", F.lit(0)) != F.coalesce(plain(F.col("text")), F.lit(0)))).select("doc_id")


def p5_violations(spark: SparkSession, d: str) -> DataFrame:
    """Files whose masked text still holds a credential found in it, or differs in length or elsewhere than in letters of credentials: none."""
    tasks = table(spark, d, "function_tasks").select("task_id", "file_path", "source")
    new = secrets.redact(tasks, "source", "file_path").select("task_id", F.col("source").alias("new"))
    found = secrets.find_secrets(tasks, "function_tasks", "task_id", "source", "file_path").groupBy(F.col("row_id").alias("task_id")).agg(F.collect_set("secret").alias("secrets"))
    j = tasks.join(new, "task_id").join(found, "task_id", "left")
    kept = F.exists("secrets", lambda x: F.contains(F.col("new"), x))
    changed = F.col("secrets").isNull() & (F.col("new") != F.col("source"))
    return j.filter(F.coalesce(kept, F.lit(False)) | (F.length("new") != F.length("source")) | F.coalesce(changed, F.lit(False))).select("task_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p3_found": p3_found, "p3_rates": p3_rates, "p4_found": p4_found, "p4_reasons": p4_reasons, "p4_shared_subtrees": p4_shared_subtrees, "p5_found": p5_found, "p5_redacted_tasks": p5_redacted_tasks, "p5_redacted_documentations": p5_redacted_documentations, "p8_packed": p8_packed, "p8_fill": p8_fill, "p8_violations": p8_violations, "p5_violations": p5_violations, "p9_mixed": p9_mixed, "p9_violations": p9_violations, "p10_violations": p10_violations, "p9_shares": p9_shares, "p10_found": p10_found, "p10_sentences": p10_sentences,
}
ORACLES: dict[str, str] = {
    "p8_violations": "select cast(0 as int) as capacity_id, cast(0 as bigint) as id, '' as what where false",
    "p5_violations": "select task_id from function_tasks where false",
    "p9_violations": "select doc_id, '' as what from documents where false",
    "p10_violations": "select doc_id from documents where false",
}
