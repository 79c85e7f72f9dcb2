"""Model training and inference with MLlib (ML-01..10).

Learning is MLlib's distributed tree/linear training.  Large forests grow tree by tree in
tasks (``forests``) if their rows, one byte a feature, fit one; else in parts of
few trees, as the driver holds what MLlib grows.
Probabilities are read by class *name* (``StringIndexer`` with alphabetical
order: benign = 0, malicious = 1), never by position assumptions.
Forest parity with other libraries is behavioural, not bitwise (binning,
depth cap of 30, RNG).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from trailfold.operators import forests, splits
from trailfold.schemas import FEATURES
from trailfold.session import checkpoint_dir, materialize

# --- fixed values: forest configuration of the baseline ---
RF_TREES, RF_SEED, RF_MAX_DEPTH = 200, 1, 30   # unlimited depth in the reference; MLlib caps at 30
GBT_ITER, GBT_STEP, GBT_MIN_LEAF, GBT_SEED, GBT_MAX_DEPTH = 300, 0.08, 20, 42, 6
CV_FOLDS = 10
# --- end fixed values ---
FITS_AT_ONCE = 8   # fits at a time: the driver holds as many growing models
ROW_TREES = 1_200_000   # rows times trees of all forests that grow at a time: a tree has about as many nodes as rows at worst
PARTS_AT_ONCE = 6   # a forest beyond its share of that grows in parts, so many at a time
ROWS_A_TASK = 20_000   # a forest is one job a level: a task of few rows costs more to start than to run


def label_indexer(label: str = "label") -> StringIndexer:
    """ML-10: benign → 0, malicious → 1 (alphabetical, checked in tests)."""
    return StringIndexer(inputCol=label, outputCol="y", stringOrderType="alphabetAsc", handleInvalid="error")


def forest(features: list[str] = FEATURES, trees: int = RF_TREES, seed: int = RF_SEED,
           max_depth: int = RF_MAX_DEPTH) -> Pipeline:
    """ML-01: assembler + indexer + random forest (gini, sqrt features)."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"),
        label_indexer(),
        RandomForestClassifier(featuresCol="features", labelCol="y", numTrees=trees, impurity="gini",
                               featureSubsetStrategy="sqrt", maxDepth=max_depth, seed=seed, maxBins=64,
                               maxMemoryInMB=1024, cacheNodeIds=True),
    ])


def boosted(features: list[str], iters: int = GBT_ITER, step: float = GBT_STEP,
            min_leaf: int = GBT_MIN_LEAF, seed: int = GBT_SEED) -> Pipeline:
    """ML-05: gradient-boosted trees (no leaf cap or L2 in MLlib)."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"),
        label_indexer(),
        GBTClassifier(featuresCol="features", labelCol="y", maxIter=iters, stepSize=step,
                      minInstancesPerNode=min_leaf, seed=seed, maxDepth=GBT_MAX_DEPTH),
    ])


def threshold_decision(p: Column, at: float = 0.5) -> Column:
    """PRJ-05: malicious from ``at`` on."""
    return F.when(p >= at, "malicious").otherwise("benign")


def predictions(model, df: DataFrame, keep: list[str], rule: str = "argmax") -> DataFrame:
    """ML-03 + PRJ-05/06: ``keep…, prediction, malware_probability``.

    ``rule='argmax'``: MLlib's class argmax (a 0.5 tie goes to the first
    class, benign).  ``rule='threshold'``: ``p >= 0.5`` → malicious.
    """
    out = model.transform(df)
    p = vector_to_array("probability")[1]
    if rule == "argmax":
        pred = F.when(F.col("prediction") == 1.0, "malicious").otherwise("benign")
    else:
        pred = threshold_decision(p)
    return out.select(*keep, pred.alias("prediction"), p.alias("malware_probability"))


def prediction_check(pred: DataFrame, by: list[str], rule: str = "argmax") -> DataFrame:
    """What any right set of predictions shows, per group: ``by…, n, benign, malicious, again, outside, against``.

    Rows and their true classes, rows beyond the first of an experiment,
    probabilities that are missing or outside 0..1, and decisions that do not
    follow the rule (``argmax``: malicious above one half; ``threshold``: from
    one half on).
    """
    p = F.col("malware_probability")
    says = F.when(p >= 0.5 if rule == "threshold" else p > 0.5, "malicious").otherwise("benign")
    return pred.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == "benign").alias("benign"),
        F.count_if(F.col("label") == "malicious").alias("malicious"),
        (F.count(F.lit(1)) - F.count_distinct("experiment")).alias("again"),
        F.count_if(~F.coalesce(p.between(0.0, 1.0), F.lit(False))).alias("outside"),
        F.count_if(F.col("prediction") != says).alias("against"))


def fit_predict(train: DataFrame, test: DataFrame, pipeline: Pipeline, keep: list[str],
                rule: str = "argmax") -> DataFrame:
    return fit_predict_all([(pipeline, train, test)], train.count(), keep, rule)[0]


def forest_parts(pipeline: Pipeline, rows: int) -> list[tuple[Pipeline, int]]:
    """``pipeline`` in parts of few trees, each with its number of trees: their mean by trees is the forest.

    The nodes of a tree grow with the rows it learns from, and the driver holds
    a model while it grows.  A forest of up to ``ROW_TREES / PARTS_AT_ONCE`` is
    one part, so that several can grow at a time; the parts of a larger one have
    seeds of their own.  Other models are one part.
    """
    *first, last = pipeline.getStages()
    if not isinstance(last, RandomForestClassifier):
        return [(pipeline, 1)]
    trees, seed = last.getNumTrees(), last.getSeed()
    share = ROW_TREES // PARTS_AT_ONCE
    if trees * rows <= share:
        return [(pipeline, trees)]
    size = max(1, share // rows)
    sizes = [min(size, trees - at) for at in range(0, trees, size)]
    return [(Pipeline(stages=[*first, last.copy({last.numTrees: n, last.seed: seed + part})]), n)
            for part, n in enumerate(sizes)]


def fit_predict_all(fits: list[tuple[Pipeline, DataFrame, DataFrame]], rows: int, keep: list[str],
                    rule: str = "argmax", at_once: int = FITS_AT_ONCE) -> list[DataFrame]:
    """``predictions`` of each (pipeline, train, test), ``rows`` being the most rows that one learns from.

    Large forests grow in tasks if they can (``grown_in_tasks``).  Any other model
    scores its rows as soon as it is fit and is dropped: the scores are
    written, and the driver holds no more than the models that grow, together
    of at most ``ROW_TREES``.  The scores of a forest's parts are added up by row.
    """
    parts = [forest_parts(pipeline, rows) for pipeline, _, _ in fits]
    grown = None
    if all(len(of_fit) > 1 for of_fit in parts):
        frames = {id(x): x for _, *both in fits for x in both}
        numbers = {x: i for i, x in enumerate(frames)}
        used = {*keep, "label", *(c for p, _, _ in fits for c in p.getStages()[0].getInputCols())}
        table = reduce(partial(DataFrame.unionByName, allowMissingColumns=True),
                       [x.select(*[c for c in x.columns if c in used], F.lit(i).alias("_group")) for i, x in enumerate(frames.values())])
        grown = grown_in_tasks(table, [(p, [numbers[id(train)]], [numbers[id(test)]]) for p, train, test in fits])
    if grown:
        numbered, scores = grown
        return [_decided(numbered.join(scores.where(F.col("_fit") == i), "_row"), keep, rule) for i in range(len(fits))]
    trees = max(n for of_fit in parts for _, n in of_fit)
    at_once = min(at_once, max(1, ROW_TREES // max(1, trees * rows)))
    tasks = rows // ROWS_A_TASK + 1
    jobs, out = [], []
    for (_, train, test), of_fit in zip(fits, parts):
        spark = test.sparkSession
        table = f"{checkpoint_dir(spark).rstrip('/')}/scored-{uuid.uuid4().hex}"
        if len(of_fit) == 1:
            jobs.append(partial(_fit_and_score, of_fit[0][0], train, test, keep, rule, table))
            out.append(partial(spark.read.parquet, table))
            continue
        few = materialize(train).coalesce(tasks)   # read by every part
        numbered = materialize(test.withColumn("_row", F.monotonically_increasing_id()))
        tables = [f"{table}/part={part}" for part in range(len(of_fit))]
        jobs += [partial(_fit_and_score, pipeline, few, numbered, [*keep, "_row"], rule, at)
                 for (pipeline, _), at in zip(of_fit, tables)]
        out.append(partial(_mean_of_parts, spark, table, [n for _, n in of_fit], keep, rule))
    fit_all(jobs, at_once)
    return [read() for read in out]


def _fit_and_score(pipeline: Pipeline, train: DataFrame, test: DataFrame, keep: list[str], rule: str, table: str) -> None:
    predictions(pipeline.fit(train), test, keep, rule).write.parquet(table)


def _mean_of_parts(spark: SparkSession, table: str, trees: list[int], keep: list[str], rule: str) -> DataFrame:
    scores = spark.read.parquet(table)
    weight = F.element_at(F.array(*[F.lit(float(n)) for n in trees]), F.col("part") + 1)
    # added in the order of the parts, so that a row's sum is the same in each run
    each = F.array_sort(F.collect_list(F.struct("part", (F.col("malware_probability") * weight).alias("p"))))
    votes = F.aggregate(each, F.lit(0.0), lambda total, e: total + e["p"])
    p = F.least(F.lit(1.0), votes / sum(trees))
    return _decided(scores.groupBy("_row", *keep).agg(p.alias("_p")), keep, rule)


def _decided(scores: DataFrame, keep: list[str], rule: str) -> DataFrame:
    p = F.col("_p")
    pred = F.when(p > 0.5, "malicious").otherwise("benign") if rule == "argmax" else threshold_decision(p)
    return scores.select(*keep, pred.alias("prediction"), p.alias("malware_probability"))


def grown_in_tasks(table: DataFrame, fits: list[tuple[Pipeline, list[int], list[int]]]) -> tuple[DataFrame, DataFrame] | None:
    """``table`` with a number a row (``_row``), and ``forests.probabilities``: of each forest, the groups it learns from and scores.

    None, for MLlib to do it or refuse it, if the rows are too many for a task, if their labels are not two that each
    forest learns, or if a learning row has a feature that is missing or infinite.
    """
    numbered = materialize(table.withColumn("_row", F.monotonically_increasing_id()))
    groups = {g["_group"]: g for g in numbered.groupBy("_group").agg(
        F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).collect()}
    last = [pipeline.getStages()[-1] for pipeline, _, _ in fits]
    grow = [forests.Forest(tuple(p.getStages()[0].getInputCols()), f.getNumTrees(), f.getSeed(), f.getMaxDepth(), f.getMaxBins(),
                           frozenset(learns), frozenset(scores)) for f, (p, learns, scores) in zip(last, fits)]
    both = {x for f in grow for g in f.learns | f.scores if g in groups for x in (groups[g]["low"], groups[g]["high"])}
    learned = [{x for g in f.learns if g in groups for x in (groups[g]["low"], groups[g]["high"])} for f in grow]
    odd = F.col("label").isNull() | ~F.col("label").isin(*both)
    finite = reduce(Column.__and__, [F.coalesce(F.abs(F.col(c).cast("double")) < float("inf"), F.lit(False))
                                     for c in sorted({c for f in grow for c in f.features})])
    odd = odd | F.col("_group").isin(sorted({g for f in grow for g in f.learns})) & ~finite
    if (len(both) != 2 or None in both or any(x != both for x in learned)
            or forests.table_bytes(sum(g["n"] for g in groups.values()), grow) > forests.TABLE_BYTES
            or not numbered.where(odd).isEmpty()):
        return None
    rows = numbered.withColumns({"_y": (F.col("label") == max(both)).cast("int"), "_order": F.xxhash64(*table.columns)})
    scores = forests.probabilities(rows, grow, [sum(groups[g]["n"] for g in f.learns if g in groups) for f in grow])
    return numbered, scores


def fit_all(fits: list[Callable], at_once: int = FITS_AT_ONCE) -> list:
    """What the ``fits`` return, in order, with up to ``at_once`` of them running as concurrent Spark jobs.

    Each takes the job settings of the caller into its thread.  A forest grows in
    many short jobs, which leave most of a cluster idle one after the other.
    """
    spark = SparkSession.getActiveSession()
    with ThreadPoolExecutor(max(1, min(at_once, len(fits)))) as pool:
        return list(pool.map(lambda fit: fit(), [inheritable_thread_target(spark)(fit) for fit in fits]))


def out_of_fold(df: DataFrame, pipeline: Pipeline, keep: list[str], k: int = CV_FOLDS,
                seed: int = RF_SEED, at_once: int = FITS_AT_ONCE) -> DataFrame:
    """ML-02: stratified k folds; each fold predicted by a model fit on the others; ``p >= 0.5`` rule.

    The folds are written once, as a table partitioned by fold: a fit reads the
    folds that it learns from, and scoring reads each fold once.
    """
    spark = df.sparkSession
    table = f"{checkpoint_dir(spark).rstrip('/')}/folds-{uuid.uuid4().hex}"
    splits.stratified_folds(df, k, seed=seed).write.partitionBy("fold").parquet(table)
    folded = spark.read.parquet(table)
    rows = folded.count()
    tasks = rows // ROWS_A_TASK + 1
    if len(forest_parts(pipeline, rows)) > 1:
        folds = range(k)
        grown = grown_in_tasks(folded.withColumn("_group", F.col("fold")), [(pipeline, [g for g in folds if g != f], [f]) for f in folds])
        if grown:
            return _decided(grown[0].join(grown[1], "_row"), keep + ["fold"], "threshold")
    fits = [(pipeline, folded.where(F.col("fold") != f).coalesce(tasks), folded.where(F.col("fold") == f)) for f in range(k)]
    return reduce(DataFrame.unionByName, fit_predict_all(fits, rows, keep + ["fold"], "threshold", at_once))


def temporal_retrain(fm: DataFrame, pipeline: Pipeline, keep: list[str], eval_year: int = 2024) -> DataFrame:
    """ML-04: fit on non-test rows before/other than the eval year; predict all eval-year rows."""
    sp = splits.temporal_split(fm, eval_year)
    return fit_predict(sp.where(F.col("split") == "train"), sp.where(F.col("split") == "eval"), pipeline, keep)


def ablation(df: DataFrame, families: dict[str, list[str]], base: list[str] = FEATURES,
             trees: int = RF_TREES) -> list[tuple[str, DataFrame]]:
    """ML-06: (name, predictions) for the base set, base + each family, and everything.

    Official split (fit on ``test = false``, score ``test = true``).
    """
    train, test = df.where(~F.col("test")), df.where(F.col("test"))
    sets = [("baseline", base)] + [(f"+{n}", base + [c for c in cols if c not in base])
                                   for n, cols in families.items()]
    everything = list(dict.fromkeys(base + [c for cols in families.values() for c in cols]))
    sets.append(("full", everything))
    rows = train.count()
    few = train.coalesce(rows // ROWS_A_TASK + 1)
    scored = fit_predict_all([(forest(cols, trees=trees), few, test) for _, cols in sets], rows, ["experiment", "label"])
    return [(name, pred) for (name, _), pred in zip(sets, scored)]


def _as_vectors(df: DataFrame, entries: str, size: int) -> DataFrame:
    """``df`` with sparse ``features`` of ``size`` from ``entries``, an array of (index, value) by rising index.

    There is no function from columns to a sparse vector.  A table of the
    vector's own fields, read again with the vector's type, is one: it has one
    entry for each that is there, and no array of the vocabulary's length.
    """
    spark = df.sparkSession
    rest = [c for c in df.columns if c != entries]
    e = F.coalesce(F.col(entries), F.expr("cast(array() AS array<struct<idx: int, w: double>>)"))
    table = f"{checkpoint_dir(spark).rstrip('/')}/vectors-{uuid.uuid4().hex}"
    (df.select(*rest, F.struct(F.lit(0).cast("byte").alias("type"), F.lit(size).alias("size"),
                               F.transform(e, lambda s: s["idx"]).alias("indices"),
                               F.transform(e, lambda s: s["w"]).alias("values")).alias("features"))
     .write.parquet(table))
    schema = StructType([df.schema[c] for c in rest] + [StructField("features", VectorUDT())])
    return spark.read.schema(schema).parquet(table)


def sequence_model(gram_counts: DataFrame, labels: DataFrame, train_filter, min_df: int = 1) -> DataFrame:
    """ML-07: n-gram counts → sub-linear TF (log1p) · IDF → logistic regression.

    ``gram_counts``: ``experiment, gram, cnt`` (run-length n-grams, already
    aggregated — a hot experiment is pre-combined, never listed event by
    event).  The vocabulary (grams seen in ≥ ``min_df`` training
    experiments, IDF = ln((m + 1) / (df + 1)) as MLlib's ``IDF``) is bounded
    by the fixed rule alphabet (10 rules → at most 10² + 10³ + 10⁴ grams of
    length 2–4); an experiment's sparse row holds an entry for each gram of its own.  ``labels``: ``experiment, label, test``.
    """
    from trailfold.functions.ranking import position_within
    train_ids = labels.where(train_filter).select("experiment")
    m = train_ids.count()
    dfreq = (gram_counts.join(train_ids, "experiment", "left_semi").groupBy("gram")
             .agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df))
    vocab = position_within(dfreq.withColumn("_g", F.lit(0)), ["_g"], [F.col("gram")], out="pos")
    vocab = vocab.select("gram", (F.col("pos") - 1).cast("int").alias("idx"),
                         F.log((F.lit(m) + 1) / (F.col("df") + 1)).alias("idf"))
    v = max(1, vocab.count())
    ent = (gram_counts.join(vocab, "gram")
           .select("experiment", F.struct("idx", (F.log1p("cnt") * F.col("idf")).alias("w")).alias("e"))
           .groupBy("experiment").agg(F.array_sort(F.collect_list("e")).alias("e")))
    rows = labels.select("experiment", "label", "test").join(ent, "experiment", "left")
    x = _as_vectors(rows, "e", v)   # read by the indexer fit and every LR pass
    idx = label_indexer().fit(x.where(train_filter))
    x = idx.transform(x)
    lr = LogisticRegression(featuresCol="features", labelCol="y", maxIter=100, regParam=0.01)
    model = lr.fit(x.where(train_filter))
    return predictions(model, x.where(~train_filter), ["experiment", "label"])
