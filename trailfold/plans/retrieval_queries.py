"""Registered retrieval, prompt and scoring queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailfold.operators import counts, retrieval, scoring, splits, summary
from trailfold.plans import oracle as O
from trailfold.plans.catalog import register
from trailfold.plans.inputs import Inputs
from trailfold.schemas import FEATURES
from trailfold.sources import keyed, lens
from trailfold.session import checkpoint_dir, materialize


def _sql_lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ----------------------------------------------------------------- k-NN
@register("knn_vectors", O.q(
    "SELECT fc.experiment, " + ", ".join(
        f"round(ln(1 + greatest(CAST(coalesce({f}, 0) AS DOUBLE), 0.0)), 9) AS v_{f}" for f in FEATURES)
    + " FROM fc", O.FEATURE_COUNTS))
def _knn_vectors(i: Inputs):
    """KNN-01: log1p count vectors (one column per component here, for the oracle)."""
    fc = counts.feature_counts(i.trace)
    v = fc.select("experiment", retrieval.feature_vector().alias("vec"))
    return v.select("experiment", *[F.round(F.col("vec")[j], 9).alias(f"v_{f}") for j, f in enumerate(FEATURES)])


def _cos_sql(targets: str, pool: str) -> str:
    return f"""dist AS (
  SELECT t.id AS target_id, p.id AS neighbor_id,
         CASE WHEN sqrt(list_dot_product(t.vec, t.vec)) = 0 OR sqrt(list_dot_product(p.vec, p.vec)) = 0 THEN 1.0
              ELSE 1.0 - list_dot_product(t.vec, p.vec)
                         / (sqrt(list_dot_product(t.vec, t.vec)) * sqrt(list_dot_product(p.vec, p.vec))) END AS d
  FROM {targets} t, {pool} p WHERE t.id <> p.id),
nn AS (SELECT target_id, CAST(row_number() OVER (PARTITION BY target_id ORDER BY round(d, 12), neighbor_id)
                              AS INTEGER) AS rank,
              neighbor_id, round(d, 5) AS distance FROM dist QUALIFY rank <= 3)"""


_KNN_EMB = O.q("SELECT * FROM nn", """kt AS (SELECT id, vec FROM vec_l WHERE year = 2024),
kp AS (SELECT id, vec FROM vec_l WHERE year < 2024)""", _cos_sql("kt", "kp"))


def _emb_neighbors(i: Inputs) -> DataFrame:
    t, p = retrieval.temporal_targets_pool(i.vectors)
    return retrieval.knn_topk(t, p, k=3)


@register("knn_topk", _KNN_EMB)
def _knn_topk(i: Inputs):
    """KNN-02/04: 3 nearest earlier-year embeddings for every 2024 embedding."""
    return _emb_neighbors(i)


@register("knn_pruned", _KNN_EMB)
def _knn_pruned(i: Inputs):
    """KNN-02/JN-09 by angular rings, in tiles of 1,024 rows (a pool of fewer is one tile)."""
    t, p = retrieval.temporal_targets_pool(i.vectors)
    return retrieval.knn_topk(t, p, k=3, tile_rows=1024)


@register("knn_vote", O.q("""
SELECT target_id, predicted_label, votes FROM (
  SELECT target_id, nlabel AS predicted_label, CAST(count(*) AS BIGINT) AS votes,
         row_number() OVER (PARTITION BY target_id ORDER BY count(*) DESC, min(rank)) AS r
  FROM (SELECT nn.*, v.label AS nlabel FROM nn JOIN vec_l v ON v.id = nn.neighbor_id)
  GROUP BY target_id, nlabel) WHERE r = 1""", """kt AS (SELECT id, vec FROM vec_l WHERE year = 2024),
kp AS (SELECT id, vec FROM vec_l WHERE year < 2024)""", _cos_sql("kt", "kp")))
def _knn_vote(i: Inputs):
    """KNN-05: majority label of the neighbours."""
    return retrieval.knn_vote(_emb_neighbors(i), i.vectors)


_FEAT_TP = """fv AS (SELECT fc.experiment AS id, l.year, l.test, l.label,
    [""" + ", ".join(f"ln(1 + greatest(CAST({f} AS DOUBLE), 0.0))" for f in FEATURES) + """] AS vec
  FROM fc JOIN labels_l l ON l.experiment = fc.experiment),
ft AS (SELECT id, vec FROM fv WHERE year = 2024),
fp AS (SELECT id, vec FROM fv WHERE NOT test AND coalesce(year < 2024, false))"""


def _feature_vectors(i: Inputs) -> DataFrame:
    fm = counts.feature_matrix(i.trace, i.labels)
    return fm.select(F.col("experiment").alias("id"), "year", "test", "label",
                     retrieval.feature_vector().alias("vec"))


def _feature_neighbors(i: Inputs) -> DataFrame:
    fv = _feature_vectors(i)
    targets = fv.where(F.col("year") == 2024)
    pool = splits.history_pool(fv)
    return retrieval.knn_topk(targets, pool, k=3)


@register("knn_features", O.q("SELECT * FROM nn", O.FEATURE_COUNTS, _FEAT_TP, _cos_sql("ft", "fp")))
def _knn_features(i: Inputs):
    """KNN-01..04 on trace count vectors: 2024 targets, pool = non-test and year < 2024."""
    return _feature_neighbors(i)


@register("leak_audit", O.q("""
SELECT 'leak_audit' AS "check",
       CAST(count_if(l.year IS NULL OR l.year >= 2024) AS BIGINT) AS n_violations
FROM nn LEFT JOIN labels_l l ON l.experiment = nn.neighbor_id""",
    O.FEATURE_COUNTS, _FEAT_TP, _cos_sql("ft", "fp")))
def _leak_audit(i: Inputs):
    """DQ-09/JN-10: retrieved ids unknown or not strictly before 2024 (0 expected)."""
    nb = _feature_neighbors(i)
    ids = retrieval.explode_ids(retrieval.retrieved_ids(nb))
    years = i.labels.select(F.col("experiment").alias("id"), "year")
    return retrieval.leak_audit(ids.select(F.col("rid").alias("neighbor_id")), years)


@register("leak_semi", O.q("""
SELECT nn.target_id, nn.neighbor_id FROM nn
WHERE nn.neighbor_id IN (SELECT experiment FROM labels_l WHERE year = 2024)""",
    O.FEATURE_COUNTS, _FEAT_TP, _cos_sql("ft", "fp")))
def _leak_semi(i: Inputs):
    """JN-11: retrieved ids that are in the evaluation set (0 rows expected)."""
    nb = _feature_neighbors(i)
    ev = i.labels.where(F.col("year") == 2024).select(F.col("experiment").alias("neighbor_id"))
    return nb.join(ev, "neighbor_id", "left_semi").select("target_id", "neighbor_id")


def _summaries(i: Inputs) -> DataFrame:
    return summary.summary_store(i.trace)


@register("demo_block", None)
def _demo_block(i: Inputs):
    """KNN-03: demonstration block (3 neighbours with verified labels) per 2024 target."""
    fv = _feature_vectors(i)
    return retrieval.demo_blocks(_feature_neighbors(i), _summaries(i), fv)


# ----------------------------------------------------------------- prompts / scoring
def _eval_2024(i: Inputs) -> DataFrame:
    return splits.eval_subset(i.labels, "2024")


@register("prompts", None)
def _prompts(i: Inputs):
    """PB-02: rendered zero-shot prompts for the 2024 cohort."""
    return scoring.build_prompts(_eval_2024(i), _summaries(i), "zero_shot", "mock")


def _prompt_keys_sql() -> str:
    from trailfold.functions.prompts import SYSTEM_PROMPT, ZERO_SHOT_USER
    from trailfold.plans.feature_queries import summary_text_parts
    select, ctes = summary_text_parts()
    return O.q(f"""
SELECT experiment_id, h AS prompt_hash, experiment_id || '_zero_shot_mock_' || left(h, 16) AS cache_key FROM (
  SELECT s.experiment_id,
         sha256('[{{"content": ' || to_json({_sql_lit(SYSTEM_PROMPT)}::VARCHAR) || ', "role": "system"}}, {{"content": '
                || to_json(replace({_sql_lit(ZERO_SHOT_USER)}, '{{trace_text}}', s.text_repr))
                || ', "role": "user"}}]') AS h
  FROM stx s JOIN labels_l l ON l.experiment = s.experiment_id WHERE coalesce(l.year = 2024, false))""",
               *ctes, "stx AS (" + select.strip() + ")")


def _prompt_rows_sql(select: str) -> str:
    """Zero-shot prompts of the 2024 cohort in SQL (CTE ``pr``: experiment_id, sys, usr, h)."""
    from trailfold.functions.prompts import SYSTEM_PROMPT, ZERO_SHOT_USER
    from trailfold.plans.feature_queries import summary_text_parts
    st_select, ctes = summary_text_parts()
    return O.q(select, *ctes, "stx AS (" + st_select.strip() + ")", f"""pr0 AS (
  SELECT s.experiment_id, {_sql_lit(SYSTEM_PROMPT)}::VARCHAR AS sys,
         replace({_sql_lit(ZERO_SHOT_USER)}, '{{trace_text}}', s.text_repr) AS usr
  FROM stx s JOIN labels_l l ON l.experiment = s.experiment_id WHERE coalesce(l.year = 2024, false)),
pr AS (
  SELECT *, sha256('[{{"content": ' || to_json(sys) || ', "role": "system"}}, {{"content": ' || to_json(usr)
                   || ', "role": "user"}}]') AS h FROM pr0)""")


def _repr_len_sql(x: str) -> str:
    # length of Python repr() of an ASCII string: quotes, escaped \n \r \t and backslash,
    # and escaped single quotes when the text also holds a double quote
    esc = " + ".join(f"(length({x}) - length(replace({x}, chr({c}), '')))" for c in (10, 13, 9, 92))
    return (f"(length({x}) + 2 + {esc} + CASE WHEN contains({x}, chr(34)) "
            f"THEN length({x}) - length(replace({x}, chr(39), '')) ELSE 0 END)")


def _json_sql(x: str) -> str:
    """The JSON string of ``x`` in ASCII, as Python writes it."""
    for char, escape in ((92, "\\\\"), (34, '\\"'), (10, "\\n"), (13, "\\r"), (9, "\\t"), (8, "\\b"), (12, "\\f")):
        x = f"replace({x}, chr({char}), '{escape}')"
    return f"""'"' || array_to_string(list_transform(string_split({x}, ''), lambda c: CASE
      WHEN c BETWEEN ' ' AND '~' THEN c WHEN unicode(c) < 65536 THEN printf('\\u%04x', unicode(c))
      ELSE printf('\\u%04x\\u%04x', 55296 + (unicode(c) - 65536) // 1024, 56320 + (unicode(c) - 65536) % 1024) END), '') || '"'"""


def _text_keys_sql() -> str:
    from trailfold.functions.prompts import SYSTEM_PROMPT, ZERO_SHOT_USER
    ends = ", ".join(f"'{e}'" if e.isprintable() else " || ".join(f"chr({ord(c)})" for c in e) for e in lens.TEXT_ENDS)
    user = _json_sql(f"replace({_sql_lit(ZERO_SHOT_USER)}, '{{trace_text}}', text_repr)")
    return f"""
SELECT experiment_id, h AS prompt_hash, experiment_id || '_zero_shot_mock_' || left(h, 16) AS cache_key FROM (
  SELECT experiment_id, sha256('[{{"content": ' || {_json_sql(_sql_lit(SYSTEM_PROMPT))}
         || ', "role": "system"}}, {{"content": ' || {user} || ', "role": "user"}}]') AS h
  FROM (SELECT CAST(doc_id AS VARCHAR) AS experiment_id,
               coalesce(text, '') || list_extract([{ends}], CAST(doc_id % {len(lens.TEXT_ENDS)} + 1 AS INTEGER)) AS text_repr
        FROM documents))"""


@register("prompt_keys_text", _text_keys_sql())
def _prompt_keys_text(i: Inputs):
    """PB-03/SC-05: prompt hash and cache key of free texts in any script, one per document."""
    texts = lens.free_texts(i.table("documents"))
    p = scoring.build_prompts(texts.select(F.col("experiment_id").alias("experiment")), texts, "zero_shot", "mock")
    return p.select("experiment_id", "prompt_hash", "cache_key")


@register("prompt_keys", _prompt_keys_sql())
def _prompt_keys(i: Inputs):
    """PB-03: prompt hash and cache key per eval row."""
    p = scoring.build_prompts(_eval_2024(i), _summaries(i), "zero_shot", "mock")
    return p.select("experiment_id", "prompt_hash", "cache_key")


@register("mock_scores", O.q("""
SELECT ent.experiment AS experiment_id,
       CASE WHEN (fc.process_create > 0 AND ent.unique_network_connections <> 0)
              OR ((fc.reg_write > 0 OR fc.reg_create_key > 0) AND fc.process_create > 0)
            THEN 'malicious' ELSE 'benign' END AS prediction,
       CASE WHEN (fc.process_create > 0 AND ent.unique_network_connections <> 0)
              OR ((fc.reg_write > 0 OR fc.reg_create_key > 0) AND fc.process_create > 0)
            THEN CAST(0.85 AS DOUBLE) ELSE CAST(0.15 AS DOUBLE) END AS malware_probability
FROM ent JOIN fc ON fc.experiment = ent.experiment""", O.ENTITIES, O.FEATURE_COUNTS))
def _mock_scores(i: Inputs):
    """PB-04: the deterministic mock on every experiment's zero-shot prompt, reply parsed."""
    s = _summaries(i)
    p = scoring.build_prompts(i.labels, s, "zero_shot", "mock")
    m = scoring.mock_scores(p.where("has_summary"))
    m, v = scoring.validate_frame(m, "content", "v"), F.col("v")
    return m.select("experiment_id", v["prediction"].alias("prediction"),
                    F.round(v["malware_probability"], 2).cast("decimal(3,2)").cast("double")
                    .alias("malware_probability"))


def _pick(items: list[str]) -> str:
    return f"CASE doc_id % {len(items)} " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(items)) + " END"


_REPLIES_SQL = ("rp AS (SELECT doc_id, " + " || ".join([
    _pick([_sql_lit(x) for x in lens.BEFORE]),
    _pick([*[_sql_lit(r) for r in lens.REPLIES],
           f"{_sql_lit(lens.QUOTED[0])} || CAST(to_json([text]) AS VARCHAR) || {_sql_lit(lens.QUOTED[1])}"]),
    _pick([_sql_lit(x) for x in lens.AFTER])]) + " AS raw FROM documents)")
_WHITE = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_WHITE}', ''), '{_WHITE}$', '')"


_FENCE = "```(?:json)?\\s*(.*?)\\s*```"
_VALIDATE_SQL = _REPLIES_SQL + f""",
v0 AS (SELECT doc_id, raw, {_strip('raw')} AS t0 FROM rp),
v1 AS (SELECT doc_id, raw, t0,
  CASE WHEN regexp_matches(t0, '{_FENCE}', 's') THEN {_strip(f"regexp_extract(t0, '{_FENCE}', 1, 's')")} ELSE t0 END AS txt
  FROM v0),
v2 AS (SELECT *, json_valid(txt) AS okj FROM v1),
v3 AS (SELECT *, CASE WHEN okj THEN json_type(txt) END AS jt,
    CASE WHEN okj THEN json_extract_string(txt, '$.prediction') END AS pred,
    CASE WHEN okj THEN json_type(txt, '$.malware_probability') END AS pt,
    CASE WHEN okj THEN json_extract_string(txt, '$.malware_probability') END AS ps,
    CASE WHEN okj THEN json_type(txt, '$.confidence') END AS ct,
    CASE WHEN okj THEN json_extract_string(txt, '$.confidence') END AS cs,
    CASE WHEN okj THEN json_type(txt, '$.evidence') END AS et FROM v2),
v4 AS (SELECT *,
    CASE WHEN pt IN ('DOUBLE', 'BIGINT', 'UBIGINT') THEN CAST(ps AS DOUBLE)
         WHEN pt = 'VARCHAR' THEN TRY_CAST(ps AS DOUBLE)
         WHEN pt = 'BOOLEAN' THEN CASE WHEN ps = 'true' THEN 1.0 ELSE 0.0 END END AS prob,
    CASE WHEN ct IN ('DOUBLE', 'BIGINT', 'UBIGINT') THEN CAST(cs AS DOUBLE)
         WHEN ct = 'VARCHAR' THEN TRY_CAST(cs AS DOUBLE)
         WHEN ct = 'BOOLEAN' THEN CASE WHEN cs = 'true' THEN 1.0 ELSE 0.0 END END AS conf FROM v3),
v5 AS (SELECT *, CASE
    WHEN raw IS NULL OR t0 = '' THEN 'Empty response'
    WHEN NOT okj THEN 'JSONDecodeError'
    WHEN jt <> 'OBJECT' THEN 'Output is not a JSON dictionary'
    WHEN pred IS NULL OR pred NOT IN ('benign', 'malicious')
      THEN 'Invalid prediction value: ' || coalesce(pred, 'None') || '. Must be ''benign'' or ''malicious'''
    WHEN prob IS NULL THEN 'Invalid malware_probability: ' || coalesce(ps, 'None')
    WHEN NOT (prob >= 0.0 AND prob <= 1.0)
      THEN 'malware_probability ' || CAST(prob AS VARCHAR) || ' out of bounds [0, 1]'
    WHEN conf IS NULL THEN 'Invalid confidence: ' || coalesce(cs, 'None')
    WHEN NOT (conf >= 0.0 AND conf <= 1.0) THEN 'confidence ' || CAST(conf AS VARCHAR) || ' out of bounds [0, 1]'
    WHEN et IS NULL OR et <> 'ARRAY' THEN 'evidence must be a list of strings' END AS err FROM v4)"""


@register("reply_validation", O.q("""
SELECT doc_id,
       CASE WHEN err IS NULL THEN 'success' ELSE 'validation_error: ' || left(err, 50) END AS status,
       CASE WHEN err IS NULL THEN pred END AS prediction,
       CASE WHEN err IS NULL THEN prob END AS malware_probability,
       CASE WHEN err IS NULL THEN conf END AS confidence,
       CAST(CASE WHEN err IS NULL THEN json_array_length(txt, '$.evidence') ELSE 0 END AS BIGINT) AS evidence_count
FROM v5""", _VALIDATE_SQL))
def _reply_validation(i: Inputs):
    """PB-05: strict validation of every reply of the replies lens."""
    r = scoring.validate_frame(i.replies, "raw", "v")
    return r.select("doc_id", scoring.reply_status(F.col("v")).alias("status"),
                    F.col("v.prediction").alias("prediction"),
                    F.col("v.malware_probability").alias("malware_probability"),
                    F.col("v.confidence").alias("confidence"), F.col("v.evidence_count").alias("evidence_count"))


@register("reply_failures", O.q("""
SELECT count(*) AS n, count_if(err IS NULL) AS valid_predictions, count_if(err IS NOT NULL) AS failures,
       count_if(err IS NULL AND pred = 'benign') AS benign, count_if(err IS NULL AND pred = 'malicious') AS malicious
FROM v5""", _VALIDATE_SQL))
def _reply_failures(i: Inputs):
    """AG-17 on replies: failures counted explicitly, never as benign."""
    r = scoring.validate_frame(i.replies, "raw", "v").select("v")
    ok = F.col("v.error").isNull()
    return r.agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("valid_predictions"),
                 F.count_if(~ok).alias("failures"),
                 F.count_if(ok & (F.col("v.prediction") == "benign")).alias("benign"),
                 F.count_if(ok & (F.col("v.prediction") == "malicious")).alias("malicious"))


def _scored(i: Inputs, config: str, scorer=None):
    s = _summaries(i)
    blocks = None
    if config == "retrieval_assisted":
        fv = _feature_vectors(i)
        nb = _feature_neighbors(i)
        blocks = retrieval.demo_blocks(nb, s, fv).join(retrieval.retrieved_ids(nb), "target_id", "left")
    p = scoring.build_prompts(_eval_2024(i), s, config, "mock", blocks)
    audit, cache = scoring.score_rows(p, config, "mock", scorer=scorer)
    # the audit log is a stored table (SNK-04); checks and means read it back
    return materialize(audit), cache


@register("scored_rows", None)
def _scored_rows(i: Inputs):
    """PB-06: audit rows of the zero-shot mock run over the 2024 cohort."""
    return _scored(i, "zero_shot")[0]


@register("scored_by_hook", None)
def _scored_by_hook(i: Inputs):
    """PB-08/PB-07: the same rows by way of the scorer hook, many prompts a call."""
    return _scored(i, "zero_shot", scoring.mock_scorer)[0]


@register("audit_log", None)
def _audit_log(i: Inputs):
    """SNK-04: audit rows of both configs stacked."""
    return _scored(i, "zero_shot")[0].unionByName(_scored(i, "retrieval_assisted")[0])


@register("usage_means", _prompt_rows_sql(f"""
SELECT round(avg(CAST(0.05 AS DOUBLE)), 3) AS avg_latency_sec,
       round(avg(CAST(floor(({scoring._MSG_OVERHEAD} + {_repr_len_sql('sys')} + {_repr_len_sql('usr')}) / 4) AS DOUBLE)), 1)
         AS avg_prompt_tokens,
       round(avg(CAST(80 AS DOUBLE)), 1) AS avg_completion_tokens
FROM pr"""))
def _usage_means(i: Inputs):
    """AG-18 over the audit rows."""
    from trailfold.operators.metrics import usage_means
    return usage_means(_scored(i, "zero_shot")[0])


@register("hash_format_check", _prompt_rows_sql("""
SELECT 'hash_format' AS "check", CAST(count_if(NOT regexp_full_match(h, '[0-9a-f]{64}')) AS BIGINT) AS n_violations
FROM pr"""))
def _hash_format(i: Inputs):
    """DQ-08 over the audit rows of prompted samples."""
    from trailfold.operators.checks import hash_format_check
    a = _scored(i, "zero_shot")[0]
    return hash_format_check(a.where(F.col("status") != "missing_trace_summary"))


@register("summary_lookup", O.q("""
SELECT rf.experiment, CASE WHEN t.experiment IS NULL THEN 'missing_trace_summary' ELSE 'found' END AS status
FROM rf LEFT JOIN (SELECT DISTINCT experiment FROM trace) t ON t.experiment = rf.experiment""",
    O.model_cte("rf", 7919)))
def _summary_lookup(i: Inputs):
    """JN-05: keyed lookup; a missing summary yields a status row, not a dropped row."""
    present = summary.trace_summary(i.trace).select(F.col("experiment_id").alias("experiment"),
                                                    F.lit(True).alias("_p"))
    j = i.model("rf").select("experiment").join(present, "experiment", "left")
    return j.select("experiment", F.when(F.col("_p").isNull(), "missing_trace_summary").otherwise("found")
                    .alias("status"))


# ----------------------------------------------------------------- cache / upsert
_LATEST = """SELECT cache_key, experiment_id, raw_response, status, "timestamp", event_id FROM (
  SELECT CAST(user_id AS VARCHAR) AS cache_key, CAST(user_id AS VARCHAR) AS experiment_id, props AS raw_response,
         CASE WHEN event_type = 'error' THEN 'validation_error: JSONDecodeError' ELSE 'success' END AS status,
         ts AS "timestamp", event_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM events) WHERE rn = 1"""


def _latest(df: DataFrame, key: str) -> DataFrame:
    from trailfold.functions.ranking import latest_per_key
    return latest_per_key(df, key, ["timestamp", "event_id"])


@register("cache_latest", O.q(_LATEST))
def _cache_latest(i: Inputs):
    """SNK-08: latest cache row per key (appended writes, last write wins)."""
    return _latest(i.cache_rows, "cache_key")


@register("upsert_latest", O.q("""
SELECT CAST(user_id AS VARCHAR) AS experiment_id, event_id, ts AS "timestamp", event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn = 1"""))
def _upsert_latest(i: Inputs):
    """SNK-06: upsert by key = union of versions + latest-wins."""
    e = i.table("events").select(F.col("user_id").cast("string").alias("experiment_id"), "event_id",
                                 F.col("ts").cast("timestamp").alias("timestamp"), "event_type", "value")
    return _latest(e, "experiment_id")


@register("cache_pending", O.q("""
SELECT l.experiment FROM labels_l l WHERE NOT EXISTS (
  SELECT 1 FROM (""" + _LATEST + """) c WHERE c.cache_key = l.experiment AND c.status IN ('success', 'cached'))"""))
def _cache_pending(i: Inputs):
    """JN-06: experiments whose cache entry is not reusable → must be scored."""
    live = i.labels.select("experiment", F.col("experiment").alias("cache_key"))
    return scoring.pending_rows(live, i.cache_rows).select("experiment")


def _keyed_events(i: Inputs) -> str:
    """A keyed cache that the events were put into in two halves, the later half first."""
    name = f"keyed_{uuid.uuid4().hex}"
    rows = materialize(i.cache_rows)
    keyed.create(i.spark, name, f"{checkpoint_dir(i.spark).rstrip('/')}/{name}", rows.schema, "cache_key")
    late = F.col("event_id") % 2 == 0
    for half in (rows.where(late), rows.where(~late)):
        keyed.upsert(i.spark, name, half, ["timestamp", "event_id"])
    return name


@register("keyed_upsert", O.q(_LATEST))
def _keyed_upsert(i: Inputs):
    """SNK-06/PB-09: two upserts into a keyed table; what it holds then is the latest row of each key."""
    return keyed.rows(i.spark, _keyed_events(i))


@register("keyed_probe", O.q("""
SELECT l.experiment FROM labels_l l WHERE NOT EXISTS (
  SELECT 1 FROM (""" + _LATEST + """) c WHERE c.cache_key = l.experiment AND c.status IN ('success', 'cached'))"""))
def _keyed_probe(i: Inputs):
    """JN-06: experiments without a reusable row in the keyed table; only the asked rows are shuffled."""
    live = i.labels.select("experiment", F.col("experiment").alias("cache_key"))
    return keyed.missing(i.spark, _keyed_events(i), live, F.col("status").isin(*scoring.OK_STATUS)).select("experiment")


@register("every_nth_sample", O.q("""
SELECT experiment FROM (SELECT experiment, row_number() OVER (ORDER BY experiment) AS rn FROM labels_l)
WHERE rn <= 50 OR (rn - 1) % 500 = 0"""))
def _every_nth(i: Inputs):
    """SNK-07: sample of the store for inspection — first 50 and every 500th (the sample is the feature)."""
    from trailfold.sources.sinks import sample_rows
    return sample_rows(i.labels.select("experiment"), "experiment")


@register("every_nth_lines", """
SELECT l_orderkey, l_linenumber FROM (
  SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || '_'
                                                     || CAST(l_linenumber AS VARCHAR)) AS rn FROM lineitem)
WHERE rn <= 50 OR (rn - 1) % 500 = 0""")
def _every_nth_lines(i: Inputs):
    """SNK-07 over a table of many rows: positions from 0 that divide by 500 (the sample is the feature)."""
    from trailfold.sources.sinks import sample_rows
    key = F.concat_ws("_", F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), F.col("l_linenumber").cast("string"))
    return (sample_rows(i.table("lineitem").select("l_orderkey", "l_linenumber", key.alias("key")), "key")
            .select("l_orderkey", "l_linenumber"))


_DEMO_SELECT = """
SELECT nb.target_id,
       string_agg('Reference Sample (Historical ID: ' || CAST(nb.neighbor_id AS VARCHAR) || '):' || chr(10)
         || '  - Total Events: ' || CAST(r.total_events AS VARCHAR) || ', Duration: '
         || CAST(r.duration_seconds AS VARCHAR) || 's' || chr(10)
         || '  - Event Rules: ' || rj.rules || chr(10)
         || '  - Process Tree Depth: ' || CAST(coalesce(depth.max_tree_depth, 1) AS VARCHAR)
         || ', Branching: ' || CAST(tf.max_branching_factor AS VARCHAR) || chr(10)
         || '  - Entity Diversity: {"processes": ' || CAST(ent.processes AS VARCHAR)
         || ', "unique_files_created": ' || CAST(ent.unique_files_created AS VARCHAR)
         || ', "unique_images_loaded": ' || CAST(ent.unique_images_loaded AS VARCHAR)
         || ', "unique_registry_keys": ' || CAST(ent.unique_registry_keys AS VARCHAR)
         || ', "unique_network_connections": ' || CAST(ent.unique_network_connections AS VARCHAR) || '}' || chr(10)
         || '  Verified Classification: ' || coalesce(fv.label, 'None') || chr(10),
         chr(10) ORDER BY nb.rank) AS reference_block
FROM nn nb
JOIN rates r ON r.experiment = nb.neighbor_id
JOIN rj ON rj.experiment = r.experiment
JOIN tf ON tf.experiment = r.experiment LEFT JOIN depth ON depth.experiment = r.experiment
JOIN ent ON ent.experiment = r.experiment
LEFT JOIN fv ON fv.id = nb.neighbor_id
GROUP BY nb.target_id"""
_RJ = """rj AS (
  SELECT experiment, '{' || string_agg('"' || rule || '": ' || CAST(n AS VARCHAR), ', ' ORDER BY fs) || '}' AS rules
  FROM (SELECT experiment, RuleName AS rule, count(*) AS n, min(ingest_seq) AS fs FROM trace
        GROUP BY experiment, RuleName) GROUP BY experiment)"""
_DEMO_SQL = O.q(_DEMO_SELECT, O.FEATURE_COUNTS, _FEAT_TP, _cos_sql("ft", "fp"), O.BOUNDS, O.ENTITIES, O.TREE,
                _RJ)


def _audit_sql() -> str:
    from trailfold.functions.prompts import RETRIEVAL_USER, SYSTEM_PROMPT, ZERO_SHOT_USER
    from trailfold.plans.feature_queries import summary_text_parts
    st_select, ctes = summary_text_parts()
    cols = lambda cfg: f"""experiment_id, '{cfg}' AS config, 'mock' AS model, h AS prompt_hash, rids AS retrieved_ids,
       'success' AS status, CASE WHEN {_MOCK_MAL} THEN 'malicious' ELSE 'benign' END AS prediction,
       CASE WHEN {_MOCK_MAL} THEN CAST(0.85 AS DOUBLE) ELSE CAST(0.15 AS DOUBLE) END AS malware_probability,
       CAST(0.88 AS DOUBLE) AS confidence, CAST(0.05 AS DOUBLE) AS latency_sec,
       CAST(floor(({scoring._MSG_OVERHEAD} + {_repr_len_sql('sys')} + {_repr_len_sql('usr')}) / 4) AS BIGINT)
         AS prompt_tokens,
       CAST(80 AS BIGINT) AS completion_tokens, CAST(2 AS BIGINT) AS evidence_count"""  # noqa: E731
    hashed = ("""sha256('[{"content": ' || to_json(sys) || ', "role": "system"}, {"content": ' || to_json(usr)
                   || ', "role": "user"}]')""")
    return O.q(f"""
SELECT {cols('zero_shot')} FROM (SELECT *, {hashed} AS h FROM pz)
UNION ALL
SELECT {cols('retrieval_assisted')} FROM (SELECT *, {hashed} AS h FROM pra)""",
               *ctes, O.FEATURE_COUNTS, _FEAT_TP, _cos_sql("ft", "fp"), _RJ,
               "demo AS (" + _DEMO_SELECT.strip() + ")",
               "rid AS (SELECT target_id, string_agg(CAST(neighbor_id AS VARCHAR), ',' ORDER BY rank) AS ids "
               "FROM nn GROUP BY target_id)",
               "stx AS (" + st_select.strip() + ")", f"""ev AS (
  SELECT s.experiment_id, s.text_repr FROM stx s JOIN labels_l l ON l.experiment = s.experiment_id
  WHERE coalesce(l.year = 2024, false)),
pz AS (SELECT experiment_id, {_sql_lit(SYSTEM_PROMPT)}::VARCHAR AS sys,
         replace({_sql_lit(ZERO_SHOT_USER)}, '{{trace_text}}', text_repr) AS usr, '' AS rids FROM ev),
pra AS (SELECT ev.experiment_id, {_sql_lit(SYSTEM_PROMPT)}::VARCHAR AS sys,
         replace(replace({_sql_lit(RETRIEVAL_USER)}, '{{reference_examples}}', coalesce(demo.reference_block, '')),
                 '{{target_trace}}', ev.text_repr) AS usr,
         coalesce(rid.ids, '') AS rids
  FROM ev LEFT JOIN demo ON CAST(demo.target_id AS VARCHAR) = ev.experiment_id
  LEFT JOIN rid ON CAST(rid.target_id AS VARCHAR) = ev.experiment_id)""")


@register("run_report", None)
def _run_report(i: Inputs):
    """The last step of a scoring run: one row of figures per configuration."""
    from trailfold.operators.compare import run_report
    return run_report(_audit_log(i), i.labels)


# Oracles that need the prompt SQL above (registered after their builders).
_MOCK_MAL = ("((contains(usr, 'process_create') AND contains(usr, 'unique_network_connections') "
             "AND NOT contains(usr, 'unique_network_connections: 0')) "
             "OR ((contains(usr, 'reg_write') OR contains(usr, 'reg_create_key')) AND contains(usr, 'process_create')))")
_CATALOG_SQL = {
    "demo_block": _DEMO_SQL,
    "audit_log": None,
    "prompts": _prompt_rows_sql("""
SELECT experiment_id, true AS has_summary, sys AS system, usr AS "user", h AS prompt_hash,
       experiment_id || '_zero_shot_mock_' || left(h, 16) AS cache_key, '' AS retrieved_ids FROM pr"""),
    "scored_rows": _prompt_rows_sql(f"""
SELECT experiment_id, 'zero_shot' AS config, 'mock' AS model, h AS prompt_hash, '' AS retrieved_ids,
       'success' AS status, CASE WHEN {_MOCK_MAL} THEN 'malicious' ELSE 'benign' END AS prediction,
       CASE WHEN {_MOCK_MAL} THEN CAST(0.85 AS DOUBLE) ELSE CAST(0.15 AS DOUBLE) END AS malware_probability,
       CAST(0.88 AS DOUBLE) AS confidence, CAST(0.05 AS DOUBLE) AS latency_sec,
       CAST(floor(({scoring._MSG_OVERHEAD} + {_repr_len_sql('sys')} + {_repr_len_sql('usr')}) / 4) AS BIGINT)
         AS prompt_tokens,
       CAST(80 AS BIGINT) AS completion_tokens, CAST(2 AS BIGINT) AS evidence_count
FROM pr"""),
}
from trailfold.plans.catalog import REGISTRY as _REG  # noqa: E402

_CATALOG_SQL["audit_log"] = _audit_sql()
_CATALOG_SQL["scored_by_hook"] = _CATALOG_SQL["scored_rows"]
_MET = "n, benign, malicious, tn, fp, fn, tp, accuracy, malware_recall, malware_precision, malware_f1, benign_fpr, " \
       "balanced_accuracy, roc_auc, partial_auc_max_fpr_0_1"
_CATALOG_SQL["run_report"] = O.q(f"""
SELECT t.config, t.model, t.expected, t.valid_predictions, t.expected - t.valid_predictions AS failures,
       round(t.valid_predictions / t.expected, 4) AS coverage, {_MET}, t.avg_latency_sec, t.avg_prompt_tokens,
       t.avg_completion_tokens
FROM tot t JOIN met ON met.grp = t.config || '/' || t.model""",
    f"au AS ({_CATALOG_SQL['audit_log']})",
    """ar AS (SELECT au.*, l.label FROM au JOIN labels_l l ON l.experiment = au.experiment_id),
tot AS (SELECT config, model, count(*) AS expected,
    CAST(count_if(prediction IN ('benign', 'malicious') AND malware_probability IS NOT NULL
                  AND status IN ('success', 'cached')) AS BIGINT) AS valid_predictions,
    round(avg(coalesce(latency_sec, 0.0)), 3) AS avg_latency_sec, round(avg(CAST(prompt_tokens AS DOUBLE)), 1) AS avg_prompt_tokens,
    round(avg(CAST(completion_tokens AS DOUBLE)), 1) AS avg_completion_tokens FROM ar GROUP BY config, model),
rr AS (SELECT config || '/' || model AS year, label, prediction, malware_probability FROM ar
       WHERE prediction IN ('benign', 'malicious') AND malware_probability IS NOT NULL AND status IN ('success', 'cached'))""",
    O.metrics_sql("rr", True, undefined="zero")[0])
for _name, _sql in _CATALOG_SQL.items():
    _REG[_name] = (_REG[_name][0], _sql)
