"""Exact k-nearest-neighbour retrieval by cosine distance (KNN-01..05).

A pool of one tile (``tile_rows`` rows) is met by blocks of targets.  A larger
one is pruned by angles (``operators.angular``), and stays exact:

* the pool is cut into rings around centres, a ring of more than ``tile_rows``
  rows into hashed parts: every tile is bounded whatever the skew;
* a target first visits one part of its nearest tile: its k-th distance there,
  or that by the tile table alone, bounds the angle of its k-th neighbour;
* it then visits the tiles that the triangle inequality leaves.  Targets of
  neighbouring homes share a block, and a pool row is shuffled to the blocks
  that visit its tile, not to all;
* the sides are ``cogroup``-ed on (block, tile, part): a task holds at most
  ``tile_rows`` targets and ``tile_rows`` pool rows; numpy computes distances in
  blocks of ``CHUNK_ROWS`` targets and keeps exactly k pool rows per target
  (ties by id), never all pairs;
* a final ``row_number() <= k`` per target merges the candidates (planned as a
  window group limit).

No join without keys; what is broadcast is the tile table, at most
``CENTRES * RINGS`` rows.  The target's own id is never returned (leak guard),
and ties are broken by the neighbour id.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailfold.operators import angular
from trailfold.schemas import FEATURES
from trailfold.session import checkpoint_dir, materialize

TILE_ROWS = 8192


def feature_vector(cols: list[str] = FEATURES) -> Column:
    """KNN-01: ``log1p`` of the (clipped ≥ 0) counts, nulls as 0 — no scaling."""
    return F.array(*[F.log1p(F.greatest(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)))
                     for c in cols])


CHUNK_ROWS = 1024   # target rows per distance block inside a task (block = CHUNK_ROWS x tile pool rows)


def _tile_topk(k: int, chunk: int = CHUNK_ROWS):
    """Tile kernel: exactly ``k`` candidates per target, ordered by (distance rounded to 12 digits, id)."""
    def fn(t: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"tid": t["tid"].iloc[:0], "pid": p["pid"].iloc[:0],
                              "dist": pd.Series([], dtype="float64"), "r": pd.Series([], dtype="float64")})
        if t.empty or p.empty:
            return empty
        p = p.sort_values("pid", kind="stable")        # stable sort below then breaks ties by id
        bn = angular.unit(p["vec"])
        pid = p["pid"].to_numpy()
        kk = min(k, len(pid))
        outs = []
        for lo in range(0, len(t), chunk):           # bounded memory: chunk x pool-tile distances at a time
            tc = t.iloc[lo:lo + chunk]
            an = angular.unit(tc["vec"])
            d = 1.0 - an @ bn.T
            tid = tc["tid"].to_numpy()
            d[tid[:, None] == pid[None, :]] = np.inf     # never retrieve the target itself
            r = np.round(d, 12)
            best = np.argsort(r, axis=1, kind="stable")[:, :kk]
            rows = np.repeat(np.arange(len(tid)), kk)
            cols = best.ravel()
            dist, rr = d[rows, cols], r[rows, cols]
            keep = np.isfinite(dist)
            outs.append(pd.DataFrame({"tid": tid[rows[keep]], "pid": pid[cols[keep]], "dist": dist[keep],
                                      "r": rr[keep]}))
        return pd.concat(outs, ignore_index=True) if outs else empty
    return fn


def knn_topk(targets: DataFrame, pool: DataFrame, k: int = 3, id_col: str = "id", vec_col: str = "vec",
             tile_rows: int = TILE_ROWS) -> DataFrame:
    """KNN-02: ``target_id, rank, neighbor_id, distance`` for the k nearest pool rows.

    ``id_col`` keeps its type (text, numbers); both inputs have the same.
    Distances are cosine distances (``1 - cos``; a zero vector is at distance 1
    from everything; one with a NaN or an infinity has no neighbours and is none).
    """
    kind = targets.schema[id_col].dataType.simpleString()
    cand = _candidates(targets, pool, k, id_col, vec_col, tile_rows)[0]
    w = Window.partitionBy("tid").orderBy("r", "pid")
    top = cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.select(F.col("tid").cast(kind).alias("target_id"), F.col("rank").cast("int").alias("rank"),
                      F.col("pid").alias("neighbor_id"), F.round("dist", 5).alias("distance"))


def pairs_visited(targets: DataFrame, pool: DataFrame, k: int = 3, id_col: str = "id", vec_col: str = "vec",
                  tile_rows: int = TILE_ROWS) -> DataFrame:
    """What ``knn_topk`` compares: one row ``n_targets, n_pool, n_visited`` (pairs of a target and a pool row)."""
    _, visits, located = _candidates(targets, pool, k, id_col, vec_col, tile_rows)
    rows = located.groupBy("tile", "part").agg(F.count(F.lit(1)).alias("n"))
    n = visits.groupBy("tile", "part").agg(F.count(F.lit(1)).alias("m")).join(rows, ["tile", "part"])
    return n.agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0)).alias("n_visited")).select(
        F.lit(targets.count()).cast("long").alias("n_targets"), F.lit(pool.count()).cast("long").alias("n_pool"), "n_visited")


def _candidates(targets: DataFrame, pool: DataFrame, k: int, id_col: str, vec_col: str,
                tile_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Up to k candidates per target and tile, the visits (``tid, tile, part``), and the pool with its tiles."""
    spark = targets.sparkSession
    checkpoint_dir(spark)
    kind = targets.schema[id_col].dataType.simpleString()
    t = materialize(targets.select(F.col(id_col).alias("tid"), F.col(vec_col).alias("vec")))
    p = materialize(pool.select(F.col(id_col).alias("pid"), F.col(vec_col).alias("vec")))
    n_p = p.count()
    if n_p <= tile_rows:
        blocks = max(1, math.ceil(t.count() / tile_rows))
        one = [F.lit(0).alias("tile"), F.lit(0).alias("part")]
        t = t.select("*", F.pmod(F.xxhash64("tid"), F.lit(blocks)).cast("int").alias("block"), *one)
        p = p.select("*", *one)
        # one tile: each block visits it, so the pool goes to all of them (a join would have constants for keys)
        sent = p.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return _tops(t, sent, k, kind), t, p
    centres = angular.choose_centres(p, min(angular.CENTRES, math.ceil(2 * n_p / tile_rows)))
    located = materialize(angular.locate(p, centres, kind))
    tiles, frame = angular.tile_table(located, centres, tile_rows)
    if not len(tiles.rows):
        none = t.limit(0).select("tid", F.lit(0).alias("tile"), F.lit(0).alias("part"))
        none_p = p.limit(0).select("*", F.lit(0).alias("tile"), F.lit(0).alias("part"))
        return _meet(t.limit(0).select("*", F.lit(0).alias("block"), F.lit(0).alias("tile"), F.lit(0).alias("part")),
                     none_p, k, kind), none, none_p
    # at most CENTRES * RINGS rows
    located = (located.join(F.broadcast(frame), ["cell", "ring"])
               .select("pid", "vec", "tile", F.pmod(F.xxhash64("pid"), "parts").cast("int").alias("part")))
    at_home = materialize(angular.homes(t, tiles, k, kind))
    homes = {r["home"]: r["n"] for r in at_home.groupBy("home").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = spark.createDataFrame(
        [(h, first, own, int(tiles.parts[h])) for h, first, own in angular.blocks_of_homes(homes, tile_rows)],
        "home int, first int, blocks int, parts int")
    at_home = at_home.join(F.broadcast(blocks), "home").select(
        "tid", "vec", "bound", "home", (F.col("first") + F.pmod(F.xxhash64("tid"), "blocks")).cast("int").alias("block"),
        F.pmod(F.xxhash64("tid"), "parts").cast("int").alias("home_part"))
    first = at_home.select("tid", "vec", "block", F.col("home").alias("tile"), F.col("home_part").alias("part"))
    seen = materialize(_meet(first, located, k, kind))
    # the k-th distance of the first visit, as an angle
    kth = (seen.groupBy("tid").agg(F.max("dist").alias("far"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
           .select("tid", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - F.col("far")))).alias("kth")))
    bounded = at_home.join(kth, "tid", "left").withColumn("bound", F.least("bound", "kth")).drop("kth")
    parts = frame.select("tile", "parts").distinct()
    rest = materialize(
        angular.tiles_to_visit(bounded, tiles, k).withColumn("tile", F.explode("tiles")).join(F.broadcast(parts), "tile")
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .where((F.col("tile") != F.col("home")) | (F.col("part") != F.col("home_part")))
        .select("tid", "vec", "block", "tile", "part"))
    visits = first.select("tid", "tile", "part").unionByName(rest.select("tid", "tile", "part"))
    return seen.unionByName(_meet(rest, located, k, kind)), visits, located


def _meet(visits: DataFrame, pool: DataFrame, k: int, kind: str) -> DataFrame:
    """Each block of targets with each (tile, part) that one of them visits: k candidates per target."""
    keys = ["block", "tile", "part"]
    asked = visits.select(*keys).distinct().toDF("b", "t", "p")
    sent = (pool.join(asked, (F.col("tile") == F.col("t")) & (F.col("part") == F.col("p")))
            .select("pid", "vec", F.col("b").alias("block"), F.col("t").alias("tile"), F.col("p").alias("part")))
    return _tops(visits, sent, k, kind)


def _tops(visits: DataFrame, sent: DataFrame, k: int, kind: str) -> DataFrame:
    keys = ["block", "tile", "part"]
    return (visits.select("tid", "vec", *keys).groupBy(*keys)
            .cogroup(sent.groupBy(*keys))
            .applyInPandas(_tile_topk(k), f"tid {kind}, pid {kind}, dist double, r double"))


def temporal_targets_pool(vectors: DataFrame, eval_year: int = 2024) -> tuple[DataFrame, DataFrame]:
    """KNN-04: targets = the eval-year cohort, pool = rows strictly before it (null year excluded)."""
    targets = vectors.where(F.col("year") == eval_year)
    pool = vectors.where(F.coalesce(F.col("year") < eval_year, F.lit(False)))
    return targets, pool


def knn_vote(neighbors: DataFrame, pool_labels: DataFrame, label: str = "label") -> DataFrame:
    """KNN-05: majority label among the neighbours; ties → the label of the best-ranked neighbour."""
    j = neighbors.join(pool_labels.select(F.col("id").alias("neighbor_id"), F.col(label).alias("nlabel")),
                       "neighbor_id")
    v = j.groupBy("target_id", "nlabel").agg(F.count(F.lit(1)).alias("votes"), F.min("rank").alias("best"))
    w = Window.partitionBy("target_id").orderBy(F.desc("votes"), F.asc("best"))
    return (v.withColumn("r", F.row_number().over(w)).where("r = 1")
            .select("target_id", F.col("nlabel").alias("predicted_label"), F.col("votes").cast("long").alias("votes")))


def leak_audit(neighbors: DataFrame, pool_years: DataFrame, eval_year: int = 2024) -> DataFrame:
    """KNN-04 / DQ-09 / JN-10: neighbours unknown to the pool table or not strictly before the cohort."""
    j = neighbors.join(pool_years.select(F.col("id").alias("neighbor_id"), "year"), "neighbor_id", "left")
    bad = F.col("year").isNull() | (F.col("year") >= eval_year)
    return j.agg(F.count_if(bad).cast("long").alias("n_violations")).select(
        F.lit("leak_audit").alias("check"), "n_violations")


def retrieved_ids(neighbors: DataFrame) -> DataFrame:
    """SC-08: ``target_id, retrieved_ids`` — neighbour ids comma-joined in rank order."""
    return neighbors.groupBy("target_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "neighbor_id"))),
                                 lambda s: s["neighbor_id"].cast("string")), ",").alias("retrieved_ids"))


def explode_ids(df: DataFrame, col: str = "retrieved_ids") -> DataFrame:
    """JN-10 input: one row per retrieved id (``split`` + ``explode``), blanks dropped."""
    return (df.withColumn("rid", F.explode(F.split(F.col(col), ",")))
            .withColumn("rid", F.trim("rid")).where(F.col("rid") != ""))


def _json_counts(m: Column) -> Column:
    # json.dumps layout (", " and ": " separators) of a string→int map with plain keys
    return F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(
        F.lit('"'), e["key"], F.lit('": '), e["value"].cast("string"))), ", "), F.lit("}"))


def _json_struct(s: Column, fields: list[str]) -> Column:
    return F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{f}": '), s[f].cast("string"))
                                                    for f in fields]), F.lit("}"))


def demo_blocks(neighbors: DataFrame, summaries: DataFrame, pool_labels: DataFrame) -> DataFrame:
    """KNN-03: ``target_id, reference_block`` — one demonstration per neighbour with its verified label.

    ``summaries`` is the summary table keyed by ``experiment_id``, of the type of the neighbours' ids;
    neighbours without a summary are skipped, as the reference does.
    """
    from trailfold.operators.summary import ENTITY_FIELDS
    s = summaries.select(F.col("experiment_id").alias("neighbor_id"), "total_events",
                         "duration_seconds", "rule_counts", "process_tree", "entity_counts")
    lab = pool_labels.select(F.col("id").alias("neighbor_id"), F.col("label").alias("nlabel"))
    j = neighbors.join(s, "neighbor_id").join(lab, "neighbor_id", "left")
    txt = F.concat(
        F.lit("Reference Sample (Historical ID: "), F.col("neighbor_id").cast("string"), F.lit("):\n"),
        F.lit("  - Total Events: "), F.col("total_events").cast("string"),
        F.lit(", Duration: "), F.col("duration_seconds").cast("string"), F.lit("s\n"),
        F.lit("  - Event Rules: "), _json_counts(F.col("rule_counts")), F.lit("\n"),
        F.lit("  - Process Tree Depth: "), F.col("process_tree.max_tree_depth").cast("string"),
        F.lit(", Branching: "), F.col("process_tree.max_branching_factor").cast("string"), F.lit("\n"),
        F.lit("  - Entity Diversity: "), _json_struct(F.col("entity_counts"), ENTITY_FIELDS), F.lit("\n"),
        F.lit("  Verified Classification: "), F.coalesce(F.col("nlabel").cast("string"), F.lit("None")),
        F.lit("\n"))
    return j.groupBy("target_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", txt.alias("t")))),
                                 lambda x: x["t"]), "\n").alias("reference_block"))
