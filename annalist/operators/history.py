"""Problem 6: the history of changing attributes, each version with its period of validity.

`HistoryStore` keeps the raw changes and the versions of every entity in buckets under one manifest. A batch of changes,
late and corrected ones included, is applied by rebuilding affected chains: the batch joins the raw changes, those of the
touched entities are retrieved from the buckets they lie in, all their versions are built anew, and one commit puts these
in the place of the old chains, together with the batch's raw changes. What a touched bucket holds of other entities is
copied within the scan's tasks. Only what arrives is shuffled: raw changes lie by bucket, so chains are built in place.

An entity may hold a third of all rows, so entities of more than HOT changes are found first. Their raw changes lie in
buckets by entity and day, as the manifest tells, and their chains are built in slices of a day: at one time only one event of an entity counts,
so a slice holds no more events than a day has clock ticks in use. Neighbours across slices come from summaries, one row
per hot entity and slice. What an entity had before it became hot stays where it is;
when such an entity is touched, all buckets are read.

Cases: events without time or id are ignored; rows with one id are one event; at one time the greatest id counts; a null
name is ''; a null value is ''; a null is_deleted is false; deletions of what is not valid change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from annalist.functions.joins import null_safe_join
from annalist.session import Scratch
from annalist.sources.bucket_store import BucketStore

KEY = ("origin", "repository_id", "file_path", "function_name")
VERSIONS = T.StructType([
    T.StructField("origin", T.StringType()),
    T.StructField("repository_id", T.LongType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("function_name", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("valid_from", T.LongType()),
    T.StructField("valid_to", T.LongType()),
])
RAW = T.StructType([
    *VERSIONS.fields[:4],
    T.StructField("at", T.LongType()),
    T.StructField("id", T.LongType()),
    T.StructField("value", T.StringType()),
    T.StructField("gone", T.BooleanType()),
])
DAY = 86_400 * 1_000_000
#: Changes of one entity from which its chain is built in slices.
HOT = 1_000_000
#: Keys that a join may broadcast; they are counted first. At a few hundred bytes each this is far below an executor's memory.
BROADCAST_KEYS = 100_000


def to_changes(events: DataFrame, origin: str, at: str, value: Column) -> DataFrame:
    """Raw changes from a relation with id, key columns and is_deleted; times as microseconds."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    return events.filter(F.col(at).isNotNull() & F.col("id").isNotNull()).select(
        F.lit(origin).alias("origin"), "repository_id", "file_path", F.coalesce("function_name", F.lit("")).alias("function_name"),
        micros.alias("at"), F.col("id").cast("long").alias("id"), F.coalesce(value, F.lit("")).alias("value"), F.coalesce("is_deleted", F.lit(False)).alias("gone"),
    )


def _key_hash() -> Column:
    return F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in KEY])


def hot_keys(changes: DataFrame, hot: int = HOT) -> list[int]:
    """Hashes of the entities of more than `hot` changes: at most the rows divided by `hot`, so few that a filter can list them."""
    return [r[0] for r in changes.groupBy(_key_hash().alias("k")).count().filter(F.col("count") > hot).select("k").collect()]


def _beside(rows: DataFrame, what: Column, name: str, back: bool, hot: bool) -> DataFrame:
    """Adds the struct of the row before (or after) of the same entity in order of `at`."""
    parts = ("bucket", *KEY, "slice")
    near = (F.lag(what) if back else F.lead(what)).over(W.partitionBy(*parts).orderBy("at"))
    rows = rows.withColumn(name, near)
    if not hot:
        return rows
    edge = (F.max_by if back else F.min_by)(what, F.col("at")).alias("edge")
    ends = rows.filter(F.col("slice") >= 0).groupBy(*parts).agg(edge)
    outer = W.partitionBy("bucket", *KEY).orderBy("slice")
    carry = ends.select(*parts, (F.lag("edge") if back else F.lead("edge")).over(outer).alias("carry")).filter(F.col("carry").isNotNull())
    return null_safe_join(rows, carry, parts, "left").withColumn(name, F.coalesce(name, "carry")).drop("carry")


def _day(at: str) -> Column:
    return F.greatest(F.floor(F.col(at) / F.lit(DAY)).cast("long"), F.lit(0))


def build_versions(changes: DataFrame, hot: list[int] | None = None) -> DataFrame:
    """Versions of all entities in `changes`, which lie by column bucket; those of hot entities come out by their days."""
    rows = changes.withColumn("slice", F.lit(-1).cast("long"))
    one = F.max(F.struct("id", "gone", "value")).alias("e")
    parts = ("bucket", *KEY, "slice", "at")
    chains = None
    for is_hot in (False, True) if hot else (False,):
        own = rows
        if hot:
            own = rows.filter(_key_hash().isin(hot) if is_hot else ~_key_hash().isin(hot))
        if is_hot:
            own = own.withColumn("slice", _day("at")).withColumn("bucket", F.lit(-1))
        own = own.groupBy(*parts).agg(one).select(*parts, "e.gone", "e.value")
        own = _beside(own, F.struct("gone", "value"), "prev", True, is_hot)
        live_before = F.coalesce(~F.col("prev.gone"), F.lit(False))
        starts = ~F.col("gone") & (~live_before | (F.col("value") != F.col("prev.value")))
        points = own.filter(starts | (F.col("gone") & live_before)).drop("prev")
        points = _beside(points, F.col("at"), "valid_to", False, is_hot)
        own = points.filter(~F.col("gone")).select(*KEY, "value", F.col("at").alias("valid_from"), "valid_to", "bucket")
        chains = own if chains is None else chains.unionByName(own)
    return chains


class HistoryStore:
    """`hot`: changes of an entity from which it is worked on by days."""

    def __init__(self, scratch: Scratch, root: str, buckets: int | None = None, hot: int = HOT):
        self.scratch, self.hot = scratch, hot
        self.store = BucketStore(scratch.spark, root, {"raw": RAW, "versions": VERSIONS}, buckets)

    def _place(self, rows: DataFrame, at: str, hot: list[int]) -> DataFrame:
        """Adds the bucket: by entity, of hot ones by entity and day."""
        day = F.when(_key_hash().isin(hot), _day(at)) if hot else F.lit(None).cast("long")
        return rows.withColumn("bucket", self.store.bucket(*KEY, day))

    def _stage(self, changes: DataFrame, hot: list[int]) -> tuple[str, list[int]]:
        """Writes raw changes; of hot entities the one that counts at each time, found with partial aggregation, so copies gather nowhere."""
        if hot:
            is_hot = _key_hash().isin(hot)
            once = changes.filter(is_hot).groupBy(*KEY, "at").agg(F.max(F.struct("id", "gone", "value")).alias("e"))
            changes = changes.filter(~is_hot).unionByName(once.select(*KEY, "at", "e.id", "e.value", "e.gone"))
        return self.store.write("raw", self._place(changes, "at", hot))

    def _versions_of(self, raw: DataFrame, hot: list[int]) -> tuple[str, list[int]]:
        fresh = build_versions(raw, hot)
        if not hot:
            return self.store.write("versions", fresh, shuffle=False)
        return self.store.write("versions", self._place(fresh, "valid_from", hot))

    def load(self, log: DataFrame) -> None:
        """Stores a log and builds all its chains in an empty store."""
        store, before = self.store, self.store.manifest()
        hot = hot_keys(log, self.hot)
        raw = self._stage(log, hot)
        fresh = self._versions_of(store.written("raw", raw), hot)
        store.commit(before, {"raw": ([raw], store.values), "versions": ([fresh], store.values)}, by_day=hot)

    def apply(self, batch: DataFrame) -> list[int]:
        """Adds a batch of changes and rebuilds the chains of its entities; returns the touched buckets."""
        store, before = self.store, self.store.manifest()
        by_day = sorted({*before.get("by_day", []), *hot_keys(batch, self.hot)})
        staged = self._stage(batch, by_day)
        new = store.written("raw", staged)
        keys = self.scratch.cut(new.select(*KEY).distinct(), "touched")
        few = keys.count() <= BROADCAST_KEYS
        near = F.broadcast(keys) if few else keys
        spread = [r[0] for r in keys.select(_key_hash().alias("k")).filter(F.col("k").isin(by_day)).distinct().collect()] if by_day else []  # at most as many as entities by day
        touched = store.values if spread else staged[1]
        raw = null_safe_join(store.read("raw", touched, before), near, KEY, "left_semi").unionByName(new)
        hot = sorted({*spread, *hot_keys(raw, self.hot)})
        raw = raw if few else raw.repartition(store.buckets, "bucket")
        fresh = self._versions_of(raw, hot)
        kept = null_safe_join(store.read("versions", touched, before), near, KEY, "left_anti")
        kept = store.write("versions", kept, shuffle=not few)
        store.commit(before, {"raw": ([staged], []), "versions": ([kept, fresh], touched)}, by_day=sorted({*by_day, *hot}))
        return touched

    def versions(self) -> DataFrame:
        return self.store.read("versions").drop("bucket")


def as_text(versions: DataFrame) -> DataFrame:
    """Times as `yyyy-MM-dd HH:mm:ss`, an open end as ''."""
    text = lambda c: F.date_format(F.timestamp_micros(c), "yyyy-MM-dd HH:mm:ss")
    return versions.select(*KEY, F.col("value").alias("attr_value"), text("valid_from").alias("valid_from"), F.coalesce(text("valid_to"), F.lit("")).alias("valid_to"))
