"""Repositories and users (PRJ3, QRY6, JOI8, JOI9, SNK7-10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.functions.scalar import owner


def listing(host_repos: DataFrame, repositories: DataFrame) -> DataFrame:
    """QRY6: the host's repositories (full_name), each with whether it is active here; a null flag is not."""
    active = repositories.filter(F.col("is_active")).select("full_name", F.lit(True).alias("a")).distinct()
    return host_repos.join(active, "full_name", "left").select("full_name", F.col("a").isNotNull().alias("is_active"))


def with_owner_token(repositories: DataFrame, users: DataFrame) -> DataFrame:
    """JOI8: each repository with the token of the user named by its owner part."""
    tokens = users.select(F.col("username").alias("owner"), "access_token")
    return repositories.withColumn("owner", owner(F.col("full_name"))).join(tokens, "owner", "left").select("id", "full_name", "owner", F.col("access_token").isNotNull().alias("has_token"), "access_token")


def find(repositories: DataFrame, full_name: str) -> DataFrame:
    """JOI9: one repository; empty if it isn't known."""
    return repositories.filter(F.col("full_name") == full_name)


def upsert_user(users: DataFrame, logins: DataFrame) -> DataFrame:
    """SNK8: (username, access_token) of logins replace tokens or are added."""
    new = logins.groupBy("username").agg(F.max("access_token").alias("new_token"))
    both = users.join(new, "username", "full_outer")
    return both.select("username", F.coalesce("new_token", "access_token").alias("access_token"), F.col("id").isNull().alias("is_new"))


def upsert_repository(repositories: DataFrame, users: DataFrame, saved: DataFrame) -> DataFrame:
    """SNK9: saved (username, full_name, webhook_id) are activated or added; of unknown users nothing is. (full_name, user_id, webhook_id, is_active)."""
    known = saved.join(users.select("username", F.col("id").alias("uid")), "username").select("full_name", "uid", F.col("webhook_id").alias("hook"))
    both = repositories.join(known, "full_name", "full_outer")
    hit = F.col("uid").isNotNull()
    return both.select(
        "full_name", F.coalesce("user_id", "uid").alias("user_id"), F.when(hit, F.col("hook")).otherwise(F.col("webhook_id")).alias("webhook_id"),
        F.when(hit, F.lit(True)).otherwise(F.col("is_active")).alias("is_active"),
    )


def deactivate(repositories: DataFrame, names: DataFrame) -> DataFrame:
    """SNK10: named repositories inactive and without webhook, their data kept."""
    hit = names.select("full_name").distinct().withColumn("__off", F.lit(True))
    out = repositories.join(hit, "full_name", "left")
    off = F.col("__off").isNotNull()
    return out.withColumn("is_active", F.when(off, F.lit(False)).otherwise(F.col("is_active"))).withColumn("webhook_id", F.when(~off, F.col("webhook_id"))).drop("__off")


def advance_head(repositories: DataFrame, heads: DataFrame) -> DataFrame:
    """SNK7: heads (id, sha) become the documented heads; after the work, so a failure repeats and never skips."""
    new = heads.select("id", F.col("sha").alias("__sha"))
    out = repositories.join(new, "id", "left")
    return out.withColumn("documented_head_sha", F.coalesce("__sha", "documented_head_sha")).drop("__sha")
