"""Parquet scans of the relations (SRC1). Every query reads through `table`, so pruning and pushdown reach the files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "users", "repositories", "commits", "documentations", "function_registry", "registry_snapshots", "function_tasks",
    "documents", "library_files", "mix_targets", "pack_capacities",
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise KeyError(name)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_views(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> None:
    """All tables as temporary views, for `spark.sql`."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def jdbc_table(spark: SparkSession, url: str, name: str, key: str = "id", low: int = 0, high: int = 1, parts: int = 8, **options: str) -> DataFrame:
    """The same relation from a database, read in `parts` ranges of `key`."""
    return spark.read.jdbc(url, name, column=key, lowerBound=low, upperBound=high, numPartitions=parts, properties=options)


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer splits than there are cores, spread over them before work that costs more than moving its rows.

    A small file is one split, and its texts would all be read by one core. Scans of any size have splits enough and stay
    as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
