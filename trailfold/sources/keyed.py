"""Tables with one row per key (SNK-06, PB-09, JN-06): upserts rewrite what changed, probes leave the table where it lies.

A table is Parquet, partitioned by ``key_group`` (a hash of the key) and
bucketed by the key.  So

* an upsert reads and rewrites only the groups that hold changed keys, and
  joins the old rows where they lie: only the updates are shuffled;
* a probe by key shuffles the asked rows only, never the table;
* rows are unique per key when written, so no reader looks for the latest.

Size ``groups`` so that a group is what one upsert may rewrite, and ``buckets``
so that a bucket (of all groups) fits a task: there are up to ``groups *
buckets`` files.  Writers of one table take turns.  A failed task is retried
without trace; if the driver is lost while groups are put in place, run the same
upsert again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

GROUPS, BUCKETS = 16, 16
GROUP = "key_group"


def create(spark: SparkSession, name: str, path: str, schema: StructType, key: str, groups: int = GROUPS,
           buckets: int = BUCKETS) -> None:
    """Register the table ``name`` at ``path``; one that lies there already, made with the same figures, keeps its rows."""
    columns = StructType([*schema.fields, StructField(GROUP, IntegerType())]).toDDL()
    spark.sql(f"""CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet
        OPTIONS (partitionOverwriteMode 'dynamic')
        PARTITIONED BY ({GROUP}) CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'
        TBLPROPERTIES ('keyed.key' '{key}', 'keyed.groups' '{groups}')""")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)   # does nothing where it is there
    spark.catalog.recoverPartitions(name)


def _made_with(spark: SparkSession, name: str) -> tuple[str, int]:
    made = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
    return made["keyed.key"], int(made["keyed.groups"])


def group_of(key: str, groups: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(groups)).cast("int")


def latest(updates: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row a key, the last by ``order`` (then by all columns); rows whose key is null are no rows of a keyed table."""
    rest = [c for c in updates.columns if c not in order]
    best = F.max(F.struct(*order, *[c for c in rest if c != key])).alias("_best")
    return (updates.where(F.col(key).isNotNull()).groupBy(key).agg(best)
            .select(*[F.col(key) if c == key else F.col(f"_best.`{c}`").alias(c) for c in updates.columns]))


def upsert(spark: SparkSession, name: str, updates: DataFrame, order: list[str]) -> list[int]:
    """Put ``updates`` into the table; of the rows of a key the last by ``order`` stays, of equal ones the new.

    Returns the groups that were rewritten.  The same updates twice change
    nothing.  ``updates`` is read twice (its groups, its rows): hand in a table
    or something checkpointed where it is dear.
    """
    key, groups = _made_with(spark, name)
    changed = sorted(r[0] for r in updates.where(F.col(key).isNotNull()).select(group_of(key, groups)).distinct().collect())
    if not changed:
        return []
    merged(spark, name, updates, order, changed).write.mode("overwrite").insertInto(name)
    spark.catalog.refreshTable(name)
    return changed


def merged(spark: SparkSession, name: str, updates: DataFrame, order: list[str], changed: list[int]) -> DataFrame:
    """The rows that the ``changed`` groups hold after the update."""
    table = spark.table(name)
    key, groups = _made_with(spark, name)
    columns = [c for c in table.columns if c != GROUP]
    new = latest(updates.select(*columns), key, order).select(F.col(key).alias("_key"), F.struct(*columns).alias("_new"))
    old = table.where(F.col(GROUP).isin(changed)).select(key, F.struct(*columns).alias("_old"))
    both = old.join(new, F.col(key) == F.col("_key"), "full_outer")
    at = lambda side: F.struct(*[F.col(f"{side}.`{c}`") for c in order])
    stays = F.col("_new").isNull() | (F.col("_old").isNotNull() & (at("_old") > at("_new")))
    row = both.select(F.when(stays, F.col("_old")).otherwise(F.col("_new")).alias("r")).select("r.*")
    return row.select(*columns, group_of(key, groups).alias(GROUP))


def rows(spark: SparkSession, name: str) -> DataFrame:
    """The table's rows, one a key."""
    return spark.table(name).drop(GROUP)


def missing(spark: SparkSession, name: str, asked: DataFrame, usable: Column | None = None) -> DataFrame:
    """JN-06: rows of ``asked`` (which has the key's column) whose key the table does not have (in a row where ``usable`` holds)."""
    t, key = spark.table(name), _made_with(spark, name)[0]
    t = t if usable is None else t.where(usable)
    return asked.join(t.select(key), key, "left_anti")
