"""Problem 2: what changed between full snapshots.

Per repository each delivery is compared with the next one that has any row of the repository. EXCEPT ALL both ways
between the two sides of a comparison removes all identical rows; the residues are full-joined by key and labelled.

Cases: of several rows of a function in one delivery the one loaded last counts (then the largest registry_id, then the
row's own order, so ties are settled alike in every run); rows without snapshot_no belong to no delivery and are
ignored; a null repository, path or name is a key part of its own; content_hash ignores case, null equals only null; an
is_deleted that is not true leaves the function present. The first delivery of a repository has nothing to compare with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from annalist.functions.joins import null_safe_join

KEY = ("repository_id", "file_path", "function_name")


def present_functions(snapshots: DataFrame) -> DataFrame:
    """One row per function present in a delivery. The last load is a maximum, pre-aggregated before the shuffle."""
    deleted = F.coalesce("is_deleted", F.lit(False))
    last = F.max(F.struct(F.col("loaded_at").isNotNull(), F.col("loaded_at"), "registry_id", deleted.alias("gone"), F.lower("content_hash").alias("content_hash"))).alias("r")
    return (
        snapshots.filter(F.col("snapshot_no").isNotNull())
        .groupBy("snapshot_no", *KEY).agg(last).filter(~F.col("r.gone"))
        .select("snapshot_no", *KEY, F.col("r.content_hash").alias("content_hash"))
    )


def delivery_pairs(snapshots: DataFrame) -> DataFrame:
    """(repository_id, snapshot_no, later): each delivery of a repository and the next. As many rows as deliveries."""
    of = snapshots.filter(F.col("snapshot_no").isNotNull()).select("repository_id", "snapshot_no").distinct()
    return of.withColumn("later", F.lead("snapshot_no").over(W.partitionBy("repository_id").orderBy("snapshot_no")))


def snapshot_changes(snapshots: DataFrame) -> DataFrame:
    """(snapshot_no, repository_id, file_path, function_name, change_kind, old_hash, new_hash); snapshot_no is the later delivery."""
    rows, pairs = present_functions(snapshots), delivery_pairs(snapshots)
    of = ["at", *KEY, "content_hash"]
    later = pairs.filter(F.col("later").isNotNull())
    old = null_safe_join(rows, later, ("repository_id", "snapshot_no")).withColumn("at", F.col("later")).select(*of)
    into = later.select("repository_id", F.col("later").alias("snapshot_no"))
    new = null_safe_join(rows, into, ("repository_id", "snapshot_no"), "left_semi").withColumn("at", F.col("snapshot_no")).select(*of)
    gone = old.exceptAll(new).select(*[F.col(c).alias(f"o_{c}") for c in of])
    come = new.exceptAll(old).select(*[F.col(c).alias(f"n_{c}") for c in of])
    on = None
    for k in ("at", *KEY):
        eq = F.col(f"o_{k}").eqNullSafe(F.col(f"n_{k}"))
        on = eq if on is None else on & eq
    kind = F.when(F.col("o_at").isNull(), "added").when(F.col("n_at").isNull(), "removed").otherwise("changed")
    key = [F.when(F.col("n_at").isNull(), F.col(f"o_{k}")).otherwise(F.col(f"n_{k}")).alias(k) for k in KEY]
    return gone.join(come, on, "full_outer").select(
        F.coalesce("n_at", "o_at").alias("snapshot_no"), *key, kind.alias("change_kind"),
        F.col("o_content_hash").alias("old_hash"), F.col("n_content_hash").alias("new_hash"),
    )
