"""Call names resolved into a dependency graph (GRA1, GRA2, JOI5, JOI7, JOI12, AGG7).

Names like `get` occur everywhere, so candidates are counted per simple name before any join: a call meets one row of
its name, and one of its name in its own file, however often the name is defined. Definitions are counted as raw rows:
two definitions of one key make a name ambiguous. A name that the changeset defines never falls through to the registry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions.scalar import simple_name

CALLER = ("tree", "file_path", "name")


def _candidates(defs: DataFrame, mark: str) -> tuple[DataFrame, DataFrame]:
    """Per (tree, simple) and per (tree, simple, file): how many definitions, and the one if it is one. defs: (tree, file_path, name)."""
    rows = defs.withColumn("simple", simple_name(F.col("name")))
    one = F.min(F.struct("file_path", "name"))
    every = rows.groupBy("tree", "simple").agg(F.count(F.lit(1)).alias(f"{mark}_n"), one.alias(f"{mark}_one"))
    same = rows.groupBy("tree", "simple", "file_path").agg(F.count(F.lit(1)).alias(f"{mark}_same_n"), one.alias(f"{mark}_same"))
    return every, same


def _target(mark: str) -> Column:
    """GRA1: exactly one in the same file, else exactly one at all, else none."""
    same_n, n = F.coalesce(F.col(f"{mark}_same_n"), F.lit(0)), F.col(f"{mark}_n")
    return F.when(same_n == 1, F.col(f"{mark}_same")).when((same_n == 0) & (n == 1), F.col(f"{mark}_one"))


def resolve(calls: DataFrame, changeset: DataFrame, registry: DataFrame) -> DataFrame:
    """(CALLER, raw_callee, kind, target_file, target_name); calls: (CALLER, raw_callee); the others: (tree, file_path, name).

    kind: internal, self, external, ambiguous (in the changeset), ambiguous_external, unknown. registry: live functions outside the changeset.
    """
    out = calls.select(*CALLER, "raw_callee").distinct().withColumn("simple", simple_name(F.col("raw_callee")))
    for defs, mark in ((changeset, "in"), (registry, "out")):
        every, same = _candidates(defs, mark)
        out = out.join(every, ["tree", "simple"], "left").join(same, ["tree", "simple", "file_path"], "left")
    inner, outer = _target("in"), _target("out")
    own = (inner["file_path"] == F.col("file_path")) & (inner["name"] == F.col("name"))
    known = F.col("in_n").isNotNull()
    kind = (
        F.when(known & inner.isNull(), "ambiguous").when(known & own, "self").when(known, "internal")
        .when(F.col("out_n").isNotNull() & outer.isNull(), "ambiguous_external").when(F.col("out_n").isNotNull(), "external").otherwise("unknown")
    )
    target = F.when(known, inner).otherwise(outer)
    return out.select(*CALLER, "raw_callee", kind.alias("kind"), target["file_path"].alias("target_file"), target["name"].alias("target_name"))


def edges(resolved: DataFrame) -> DataFrame:
    """(CALLER, dep_file, dep_name): what must be documented before a function."""
    return resolved.filter(F.col("kind") == "internal").select(*CALLER, F.col("target_file").alias("dep_file"), F.col("target_name").alias("dep_name")).distinct()


def unresolved(resolved: DataFrame) -> DataFrame:
    return resolved.filter(F.col("kind").isin("ambiguous", "ambiguous_external", "unknown")).select(*CALLER, "raw_callee", "kind")


def in_degrees(nodes: DataFrame, deps: DataFrame) -> DataFrame:
    """AGG7: (CALLER, deps) of every node, 0 among them."""
    n = deps.groupBy(*CALLER).agg(F.count(F.lit(1)).alias("deps"))
    return nodes.select(*CALLER).distinct().join(n, list(CALLER), "left").select(*CALLER, F.coalesce("deps", F.lit(0)).alias("deps"))


def roots(nodes: DataFrame, deps: DataFrame) -> DataFrame:
    """GRA2: nodes without dependency."""
    return nodes.select(*CALLER).distinct().join(deps, list(CALLER), "left_anti")


def dependents(deps: DataFrame) -> DataFrame:
    """JOI12: the same edges the other way round."""
    return deps.select("tree", F.col("dep_file").alias("file_path"), F.col("dep_name").alias("name"), F.col("file_path").alias("dependent_file"), F.col("name").alias("dependent_name"))
