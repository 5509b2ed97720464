"""Answers of the code host's interface as relations (SRC3-8).

Pages are rows (full_name, kind, ref, page, status, body): one per request, body the JSON as it came. Whatever was not
answered with 200 has no rows; of a paged listing everything behind the first failed, empty or short page is left out,
as a client stops there. Null and unreadable bodies are empty. Pages lie in files of JSON lines (`pages`) or any frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.operators.scan import numbered

PAGES = "full_name string, kind string, ref string, page bigint, status int, body string"
_COMMIT = "sha string, commit struct<message string, author struct<name string, date string>>, author struct<login string>, parents array<struct<sha string>>"
#: Items of a full page.
PER_PAGE = 100


def pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGES).json(path)


def _items(rows: DataFrame, kind: str, item: str) -> DataFrame:
    """The pages of a kind that were answered, with `items`."""
    some = rows.filter((F.col("kind") == kind) & (F.col("status") == 200))
    return some.withColumn("items", F.from_json("body", f"array<{item}>")).filter(F.col("items").isNotNull())


def branches(rows: DataFrame) -> DataFrame:
    """SRC3: (full_name, name, head_sha)."""
    got = _items(rows, "branches", "struct<name string, commit struct<sha string>>")
    return got.select("full_name", F.explode("items").alias("b")).select("full_name", "b.name", F.col("b.commit.sha").alias("head_sha"))


def default_branches(rows: DataFrame) -> DataFrame:
    """SRC6: (full_name, default_branch); null where the host didn't answer."""
    one = F.when(F.col("status") == 200, F.from_json("body", "default_branch string")["default_branch"])
    return rows.filter(F.col("kind") == "repository").select("full_name", one.alias("default_branch"))


def repositories(rows: DataFrame) -> DataFrame:
    """SRC8: (full_name) of a user's repositories."""
    return _items(rows, "repositories", "struct<full_name string>").select(F.explode("items").alias("r")).select("r.full_name")


def commit_files(rows: DataFrame) -> DataFrame:
    """SRC5: (full_name, sha, status, file_path); ref is the commit."""
    one = F.from_json("body", "files array<struct<filename string, status string>>")["files"]
    got = rows.filter((F.col("kind") == "commit") & (F.col("status") == 200)).select("full_name", F.col("ref").alias("sha"), F.explode(one).alias("f"))
    return got.select("full_name", "sha", "f.status", F.col("f.filename").alias("file_path"))


def file_texts(rows: DataFrame) -> DataFrame:
    """SRC7: (full_name, ref, file_path, content); '' where the host didn't answer. The path is in `kind` behind `file:`."""
    some = rows.filter(F.col("kind").startswith("file:"))
    return some.select("full_name", "ref", F.expr("substring(kind, 6)").alias("file_path"), F.when(F.col("status") == 200, F.coalesce("body", F.lit(""))).otherwise("").alias("content"))


def commits(rows: DataFrame, per_page: int = PER_PAGE) -> DataFrame:
    """SRC4, PRJ1, PRJ2: (full_name, ref, place, sha, message, author, commit_date, parents) of every ref, newest first.

    The author is the login, or the name where that is null or empty, or unknown where the name is missing too.
    """
    got = rows.filter(F.col("kind") == "commits").withColumn("items", F.from_json("body", f"array<struct<{_COMMIT}>>"))
    n = F.coalesce(F.size("items"), F.lit(0))
    full = (F.col("status") == 200) & (n == per_page)
    # a page counts if all pages before it are full and present
    whole = numbered(got.filter(full), ["full_name", "ref"], "page", "nth").filter(F.col("nth") == F.col("page") + 1)
    last = whole.groupBy("full_name", "ref").agg((F.max("page") + 1).alias("upto"))
    read = got.filter(F.col("status") == 200).join(last, ["full_name", "ref"], "left").filter(F.col("page") <= F.coalesce("upto", F.lit(0)))
    out = read.select("full_name", "ref", "page", F.posexplode("items").alias("i", "c"))
    author = F.coalesce(F.nullif(F.col("c.author.login"), F.lit("")), F.col("c.commit.author.name"), F.lit("unknown"))
    return out.select(
        "full_name", "ref", (F.col("page") * per_page + F.col("i")).alias("place"), "c.sha", F.substring_index("c.commit.message", "\n", 1).alias("message"), author.alias("author"),
        F.col("c.commit.author.date").alias("commit_date"), F.transform("c.parents", lambda p: p["sha"]).alias("parents"),
    )
