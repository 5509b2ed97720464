"""Problem 7: a feed of inserts, updates and deletions applied to a bucketed table by copy-on-write.

The state holds one row per (key, commit, deletion flag): the smallest id that a commit gave a key (repeats of it are
void), or the largest id where the commit is null (such events are never void). Both are idempotent and independent of
order, so events delivered again, late or out of order change nothing that they should not. The row in force of a key
is the state row with the largest id, unless it is a deletion.

The base lies hashed into bucketed files. A batch is reduced to one row per key, commit and flag, with partial aggregation
before its shuffle, so copies gather nowhere; it is routed to the buckets and staged beside them. The touched buckets of
base and batch are then sorted and merged where they lie, without a shuffle of the base, and what comes out replaces them
with a new manifest. Buckets follow key, commit and flag, so a hot key spreads over all of them; its events without a
commit are kept in SALTS parts, which spread too. The last row of a key is a maximum, aggregated before its shuffle.

Cases: a null function_name, file path or repository is a key part of its own; a null is_deleted counts as false; rows
without id have no place in the order and are ignored; repeated rows and empty feeds leave the state as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annalist.sources.bucket_store import BucketStore, in_place

KEY = ("repository_id", "file_path", "function_name")
STATE = T.StructType([
    T.StructField("repository_id", T.LongType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("function_name", T.StringType()),
    T.StructField("commit_sha", T.StringType()),
    T.StructField("deleted", T.BooleanType()),
    T.StructField("event_id", T.LongType()),
])


#: Parts in which a key's events without a commit are kept.
SALTS = 16


def _merge_key() -> Column:
    """Key, commit, flag and part as one text without ambiguity: each value with its length before it."""
    part = F.when(F.col("commit_sha").isNull(), F.pmod(F.col("event_id"), F.lit(SALTS)))
    cols = [*(F.col(k) for k in (*KEY, "commit_sha", "deleted")), part]
    return F.concat(*[F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in cols])


class FeedTable:
    """State of a feed in a `BucketStore`; `apply` takes any batch of events."""

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None):
        self.store = BucketStore(spark, root, {"state": STATE}, buckets)

    def route(self, events: DataFrame) -> DataFrame:
        rows = events.filter(F.col("id").isNotNull()).select(*KEY, "commit_sha", F.coalesce("is_deleted", F.lit(False)).alias("deleted"), F.col("id").cast("long").alias("event_id"))
        rows = rows.withColumn("bucket", self.store.bucket(_merge_key()))
        n = F.when(F.col("commit_sha").isNull(), F.max("event_id")).otherwise(F.min("event_id"))
        part = F.when(F.col("commit_sha").isNull(), F.pmod(F.col("event_id"), F.lit(SALTS))).alias("part")
        return rows.groupBy("bucket", *KEY, "commit_sha", "deleted", part).agg(n.alias("event_id")).drop("part").repartition(self.store.buckets, "bucket")

    def apply(self, events: DataFrame) -> list[int]:
        """Merges a batch into the buckets it touches and commits; returns those buckets."""
        store, before = self.store, self.store.manifest()
        staged = store.write("state", self.route(events), list(KEY), shuffle=False)
        touched = staged[1]
        if any(str(b) in before["tables"]["state"] for b in touched):
            base = store.read("state", touched, before).withColumn("k", _merge_key())
            new = store.written("state", staged).withColumn("k", _merge_key())
            base, new = base.alias("a"), new.alias("b")
            either = lambda c: F.coalesce(f"a.{c}", f"b.{c}").alias(c)
            a, b = F.col("a.event_id"), F.col("b.event_id")
            last = F.when(F.coalesce("a.commit_sha", "b.commit_sha").isNull(), F.greatest(a, b)).otherwise(F.least(a, b))
            with in_place(store.spark):
                merged = base.join(new.hint("merge"), (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.k") == F.col("b.k")), "full_outer")
                merged = merged.select(*[either(c) for c in (*KEY, "commit_sha", "deleted", "bucket")], last.alias("event_id"))
                staged = store.write("state", merged, list(KEY), shuffle=False)
        store.commit(before, {"state": ([staged], touched)})
        return touched

    def current_ids(self) -> DataFrame:
        """Per key the id of the row in force."""
        last = F.max(F.struct("event_id", "deleted")).alias("last")
        return self.store.read("state").groupBy(*KEY).agg(last).filter(~F.col("last.deleted")).select(*KEY, F.col("last.event_id").alias("id"))


def current_rows(events: DataFrame, ids: DataFrame) -> DataFrame:
    """The events' own rows behind `FeedTable.current_ids`, each once although the feed delivers rows again."""
    rows = events.join(ids.select("id"), "id", "left_semi")
    rest = [c for c in events.columns if c != "id"]
    return rows.groupBy("id").agg(F.first(F.struct(*rest)).alias("r")).select("id", "r.*")
