"""Lenses: turn the driver's generic tables into the trace-analytics inputs.

The mappings are fixed (they are what the DuckDB oracle reproduces in SQL,
see ``trailfold.plans.oracle``).  Each lens is a declarative DataFrame plan,
so Catalyst prunes the scan down to the columns used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailfold.schemas import FEATURES, ROOT_RULE

N_SHARDS = 8          # the trace arrives as 8 shards
TIME_SHRINK = 10000   # 30 days of driver events -> < 260 s of trace time


def _k(props: Column) -> Column:
    return F.regexp_extract(props, r"[0-9]+", 0).cast("long")


def trace_events(events: DataFrame) -> DataFrame:
    """``events`` -> the landed event table (``trailfold.schemas.LANDED``: EVENTS + ``prev_rule``).

    This is the *landing* step: ``ingest_seq`` is the dense chronological
    position every order-sensitive operator uses afterwards.  Nothing here
    sorts a whole experiment in one task, and no event is joined on its
    experiment alone: positions, the running process counter, the first event
    and the start time come from ``running_within`` (global range sort + a
    small table per range partition and experiment).
    """
    from trailfold.functions.ranking import running_within
    rule_list = F.array(*[F.lit(r) for r in FEATURES])
    e = (events.select("user_id", "event_id", "ts", "props")
         .withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
         .withColumn("k", _k(F.col("props"))))
    pc = (F.col("k") % 9 == 0).cast("long")                     # index 0 = process_create
    e = running_within(e, ["user_id"], [F.col("ts"), F.col("event_id")], {"m": pc}, pos="rn",
                       lags={"prev_k": F.col("k")},
                       least={"min_us": F.col("us"), "first": F.struct("ts", "event_id", pc.alias("pc"))})
    # the first event is the root's, whatever its rule: it is not counted
    e = e.withColumn("m", F.col("m") - F.col("first.pc"))
    e = e.withColumn("RuleName", F.when(F.col("rn") == 1, F.lit(ROOT_RULE))
                     .otherwise(F.element_at(rule_list, (F.col("k") % 9 + 1).cast("int"))))
    # the predecessor's rule, stored at landing so sequence operators need no self-join
    prev_rule = (F.when(F.col("rn") == 1, F.lit(None).cast("string"))
                 .when(F.col("rn") == 2, F.lit(ROOT_RULE))
                 .otherwise(F.element_at(rule_list, (F.col("prev_k") % 9 + 1).cast("int"))))
    parent = (F.when(F.col("RuleName") == ROOT_RULE, F.lit(None).cast("long"))
              .when(F.col("RuleName") == "process_create", F.floor((F.col("m") - 1) / 2))
              .otherwise(F.col("k") % (F.col("m") + 1)))
    child = (F.when(F.col("RuleName") == ROOT_RULE, F.lit(0).cast("long"))
             .when(F.col("RuleName") == "process_create", F.col("m"))
             .otherwise(F.lit(None).cast("long")))
    elapsed = F.floor((F.col("us") - F.col("min_us")) / TIME_SHRINK)
    return e.select(
        F.col("user_id").cast("string").alias("experiment"),
        F.timestamp_micros(F.col("min_us") + elapsed).alias("timestamp"),
        F.col("RuleName"),
        parent.cast("string").alias("parent_guid"),
        child.cast("string").alias("child_guid"),
        F.lit(None).cast("string").alias("parent_name"),
        F.concat(F.col("RuleName"), F.lit("_"), (F.col("k") % 7).cast("string")).alias("child_name"),
        (F.col("user_id") % N_SHARDS).cast("int").alias("shard_id"),
        F.col("rn").cast("long").alias("ingest_seq"),
        prev_rule.alias("prev_rule"),
        elapsed.cast("long").alias("offset_us"),
    )


def labels(events: DataFrame) -> DataFrame:
    """Label lens: one row per experiment (``experiment, label, year, test``)."""
    u = events.select("user_id").distinct()
    return u.select(
        F.col("user_id").cast("string").alias("experiment"),
        F.when(F.col("user_id") % 7 < 2, "malicious").otherwise("benign").alias("label"),
        F.when(F.col("user_id") % 97 == 0, F.lit(None))
         .otherwise(F.col("user_id") % 10 + 2015).cast("int").alias("year"),
        (F.col("user_id") % 3 == 0).alias("test"),
    )


def scores(labels_tbl: DataFrame, documents: DataFrame) -> DataFrame:
    """Score lens: ``doc_id, y, score, prediction`` (scores have ties)."""
    d = documents.select("doc_id", "n_chars")
    j = labels_tbl.select("doc_id", "quality").join(d, "doc_id")
    score = (F.col("n_chars") % 200) / F.lit(200.0)
    return j.select(
        F.col("doc_id"),
        F.col("quality").cast("int").alias("y"),
        score.cast("double").alias("score"),
        F.when(score >= 0.5, "malicious").otherwise("benign").alias("prediction"),
        F.when(F.col("quality") == 1, "malicious").otherwise("benign").alias("label"),
    )


# --- fixed values: the three synthetic model scorers of the model lens ---
MODEL_MULTIPLIERS = {"rf": 7919, "zs": 104729, "ra": 1299709}
FAILED_EVERY = 11
# --- end fixed values ---


def model_predictions(labels_tbl: DataFrame, model: str) -> DataFrame:
    """Per-model prediction table ``experiment, label, prediction, malware_probability, status``.

    A row with ``doc_id % 11 == 0`` is a failed reply (null score, status
    ``validation_error``), which exercises the valid-prediction mask.
    """
    mult = MODEL_MULTIPLIERS[model]
    failed = F.col("doc_id") % FAILED_EVERY == 0
    p = (F.col("doc_id") * mult % 1000) / F.lit(1000.0)
    prob = F.when(failed, F.lit(None).cast("double")).otherwise(p.cast("double"))
    return labels_tbl.select(
        F.col("doc_id").cast("string").alias("experiment"),
        F.when(F.col("quality") == 1, "malicious").otherwise("benign").alias("label"),
        F.when(failed, F.lit(None).cast("string"))
         .when(p >= 0.5, "malicious").otherwise("benign").alias("prediction"),
        prob.alias("malware_probability"),
        F.when(failed, "validation_error: Empty response").otherwise("success").alias("status"),
        (F.col("doc_id") % 10 + 2015).cast("int").alias("year"),
    )


def label_predictions(labels_tbl: DataFrame) -> DataFrame:
    """Predictions over the label lens: ``experiment, year, label, prediction, malware_probability``.

    The score is an arithmetic function of the experiment id, so odd years
    (one class only, by construction of the label lens) exercise the
    undefined-metric policies.
    """
    uid = F.col("experiment").cast("long")
    p = (uid * 7919 % 1000) / F.lit(1000.0)
    return labels_tbl.select(
        "experiment", "year", "label", "test",
        F.when(p >= 0.5, "malicious").otherwise("benign").alias("prediction"),
        p.cast("double").alias("malware_probability"))


def knn_vectors(embeddings: DataFrame) -> DataFrame:
    """k-NN lens: ``id, year, label, vec`` with the temporal year rule."""
    return embeddings.select(
        F.col("vec_id").alias("id"),
        (F.col("vec_id") % 10 + 2015).cast("int").alias("year"),
        F.col("label").cast("int").alias("label"),
        F.transform("embedding", lambda x: x.cast("double")).alias("vec"),
    )


# --- fixed values: model replies of the replies lens (the 11 malformed cases, one valid, one fenced) ---
REPLIES = [
    "",
    "Not JSON at all",
    '{"prediction": "benign"',
    '{"prediction": "unknown", "malware_probability": 0.5, "confidence": 0.5, "evidence": []}',
    '{"malware_probability": 0.5, "confidence": 0.5, "evidence": []}',
    '{"prediction": "benign", "confidence": 0.5, "evidence": []}',
    '{"prediction": "benign", "malware_probability": 1.5, "confidence": 0.5, "evidence": []}',
    '{"prediction": "benign", "malware_probability": -0.2, "confidence": 0.5, "evidence": []}',
    '{"prediction": "benign", "malware_probability": "low", "confidence": 0.5, "evidence": []}',
    '{"prediction": "benign", "malware_probability": 0.2, "confidence": 0.8, "evidence": "not a list"}',
    '{"prediction": "malicious", "malware_probability": 0.9, "confidence": 2.0, "evidence": []}',
    '{"prediction": "malicious", "malware_probability": 0.85, "confidence": 0.9, '
    '"evidence": ["high process creation", "network burst"]}',
    '```json\n{"prediction": "benign", "malware_probability": 0.1, "confidence": 0.7, "evidence": ["quiet"]}\n```',
    '{"prediction": "benign", "malware_probability": 0.1, "confidence": 0.7, "evidence": []}, "note": "x"',
    '1, "prediction": "benign"',
    '{"prediction": "malicious", "malware_probability": 0.7, "confidence": 0.7, "evidence": []}],1]',
]
# --- end fixed values ---
# what a model may put around its reply, and a reply whose evidence is the document's own text
BEFORE = ["", "\n", " \t", "\r\n\n", "\u00a0\u2003", "```\n", "\x1c"]
AFTER = ["", "\n\n", "\t ", "\u3000", "\n```"]
QUOTED = ('{"prediction": "malicious", "malware_probability": 0.6, "confidence": 0.4, "evidence": ', "}")


def replies(documents: DataFrame) -> DataFrame:
    """Replies lens: ``doc_id, raw`` — a reply by ``doc_id % 17``, the last one quoting the text, with white
    space or a fence around it by ``doc_id % 7`` and ``doc_id % 5``."""
    quoted = F.concat(F.lit(QUOTED[0]), F.to_json(F.array("text")), F.lit(QUOTED[1]))
    pick = lambda items, n: F.element_at(F.array(*items), (F.col("doc_id") % n + 1).cast("int"))
    return documents.select("doc_id", F.concat(
        pick([F.lit(x) for x in BEFORE], len(BEFORE)), pick([*[F.lit(r) for r in REPLIES], quoted], len(REPLIES) + 1),
        pick([F.lit(x) for x in AFTER], len(AFTER))).alias("raw"))


# ends of free texts: accents, other scripts, beyond 16 bits, control characters, separators
TEXT_ENDS = ["", "\u00e9", "\u65e5\u672c", "\U0001f600", "\x01\x7f", "\u2028", "\\u0041"]


def free_texts(documents: DataFrame) -> DataFrame:
    """Free-text lens: ``experiment_id, text_repr`` — each document's text with an end by ``doc_id % 7``."""
    end = F.element_at(F.array(*[F.lit(e) for e in TEXT_ENDS]), (F.col("doc_id") % len(TEXT_ENDS) + 1).cast("int"))
    return documents.select(F.col("doc_id").cast("string").alias("experiment_id"),
                            F.concat(F.coalesce("text", F.lit("")), end).alias("text_repr"))


def cache_rows(events: DataFrame) -> DataFrame:
    """Upsert/cache lens: every event is an appended cache write keyed by ``user_id``."""
    return events.select(
        F.col("user_id").cast("string").alias("cache_key"),
        F.col("user_id").cast("string").alias("experiment_id"),
        F.col("props").alias("raw_response"),
        F.when(F.col("event_type") == "error", "validation_error: JSONDecodeError")
         .otherwise("success").alias("status"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("event_id"))
