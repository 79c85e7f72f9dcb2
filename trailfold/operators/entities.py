"""Distinct entities per experiment (AG-07), exact.

A Python ``set`` counts ``None`` as one member, and so does ``distinct``: one
distinct over (experiment, rule family, name), partially aggregated before its
shuffle, then a count per family.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailfold.operators.folds import by_process

FAMILY_NAMES = ["unique_files_created", "unique_images_loaded", "unique_registry_keys",
                "unique_network_connections"]


def families() -> dict[str, Column]:
    """Rule-family predicates (registry = any ``reg_`` rule)."""
    r = F.col("RuleName")
    return dict(zip(FAMILY_NAMES, [r == "file_create", r == "image_load", r.startswith("reg_"),
                                   r == "net_connect"]))


def process_set(trace: DataFrame) -> DataFrame:
    """SO-04: ``experiment, guid`` — non-null parents ∪ non-null created children."""
    parents = by_process(trace).select("experiment", F.col("parent_guid").alias("guid"))
    children = (trace.where(F.col("RuleName") == "process_create")
                .select("experiment", F.col("child_guid").alias("guid")))
    return parents.unionByName(children).where(F.col("guid").isNotNull()).distinct()


def process_counts(trace: DataFrame) -> DataFrame:
    return process_set(trace).groupBy("experiment").agg(F.count(F.lit(1)).alias("processes"))


def entity_counts(trace: DataFrame) -> DataFrame:
    """``experiment, processes, unique_files_created, unique_images_loaded,
    unique_registry_keys, unique_network_connections``."""
    kind = F.coalesce(*[F.when(c, F.lit(n)) for n, c in families().items()], F.lit(""))
    # one distinct of the names in each family (null is a name); events of no family leave one row each
    names = (trace.select("experiment", kind.alias("family"), F.when(kind != "", F.col("child_name")).alias("name"))
             .distinct())
    fam = names.groupBy("experiment").agg(
        *[F.count_if(F.col("family") == n).cast("long").alias(n) for n in FAMILY_NAMES])
    procs = process_counts(trace)
    return (fam.join(procs, "experiment", "left")
            .select("experiment", F.coalesce("processes", F.lit(0)).cast("long").alias("processes"),
                    *FAMILY_NAMES))
