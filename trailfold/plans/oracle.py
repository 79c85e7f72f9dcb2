"""DuckDB-runnable SQL for every S-oracle query.

The lenses of ``trailfold.sources.lens`` are restated here in plain SQL as
common table expressions; each query is ``LENS_CTES`` + its own CTEs +
a final SELECT.  Column names equal the Spark query's names.
"""

from __future__ import annotations

from trailfold.schemas import FEATURES

_RULE_LIST = "[" + ", ".join(f"'{r}'" for r in FEATURES) + "]"

LENS_CTES = f"""
WITH RECURSIVE ev0 AS (
  SELECT user_id, event_id, ts,
         CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k,
         epoch_us(ts) AS us,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn,
         min(epoch_us(ts)) OVER (PARTITION BY user_id) AS min_us
  FROM events),
ev1 AS (
  SELECT *, CASE WHEN rn = 1 THEN 'detonation' ELSE ({_RULE_LIST})[k % 9 + 1] END AS RuleName
  FROM ev0),
ev2 AS (
  SELECT *, CAST(sum(CASE WHEN RuleName = 'process_create' THEN 1 ELSE 0 END)
           OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS m
  FROM ev1),
trace AS (
  SELECT CAST(user_id AS VARCHAR) AS experiment,
         make_timestamp(min_us + CAST(floor((us - min_us) / 10000) AS BIGINT)) AS "timestamp",
         min_us + CAST(floor((us - min_us) / 10000) AS BIGINT) AS t_us,
         RuleName,
         CAST(CASE WHEN RuleName = 'detonation' THEN NULL
                   WHEN RuleName = 'process_create' THEN CAST(floor((m - 1) / 2) AS BIGINT)
                   ELSE k % (m + 1) END AS VARCHAR) AS parent_guid,
         CAST(CASE WHEN RuleName = 'detonation' THEN 0
                   WHEN RuleName = 'process_create' THEN m
                   ELSE NULL END AS VARCHAR) AS child_guid,
         CAST(NULL AS VARCHAR) AS parent_name,
         RuleName || '_' || CAST(k % 7 AS VARCHAR) AS child_name,
         CAST(user_id % 8 AS INTEGER) AS shard_id,
         CAST(rn AS BIGINT) AS ingest_seq
  FROM ev2),
labels_l AS (
  SELECT CAST(user_id AS VARCHAR) AS experiment,
         CASE WHEN user_id % 7 < 2 THEN 'malicious' ELSE 'benign' END AS label,
         CAST(CASE WHEN user_id % 97 = 0 THEN NULL ELSE 2015 + user_id % 10 END AS INTEGER) AS year,
         (user_id % 3 = 0) AS test
  FROM (SELECT DISTINCT user_id FROM events)),
scores_l AS (
  SELECT l.doc_id, CAST(l.quality AS INTEGER) AS y,
         CAST((d.n_chars % 200) / 200.0 AS DOUBLE) AS score,
         CASE WHEN (d.n_chars % 200) / 200.0 >= 0.5 THEN 'malicious' ELSE 'benign' END AS prediction,
         CASE WHEN l.quality = 1 THEN 'malicious' ELSE 'benign' END AS label
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
lp_l AS (
  SELECT experiment, year, label, test,
         CASE WHEN (CAST(experiment AS BIGINT) * 7919 % 1000) / 1000.0 >= 0.5 THEN 'malicious' ELSE 'benign' END
           AS prediction,
         CAST((CAST(experiment AS BIGINT) * 7919 % 1000) / 1000.0 AS DOUBLE) AS malware_probability
  FROM labels_l),
vec_l AS (
  SELECT vec_id AS id, CAST(vec_id % 10 + 2015 AS INTEGER) AS year, CAST(label AS INTEGER) AS label,
         CAST(embedding AS DOUBLE[]) AS vec
  FROM embeddings)"""


def model_cte(name: str, mult: int) -> str:
    return f"""{name} AS (
  SELECT CAST(doc_id AS VARCHAR) AS experiment,
         CASE WHEN quality = 1 THEN 'malicious' ELSE 'benign' END AS label,
         CASE WHEN doc_id % 11 = 0 THEN NULL
              WHEN (doc_id * {mult} % 1000) / 1000.0 >= 0.5 THEN 'malicious' ELSE 'benign' END AS prediction,
         CASE WHEN doc_id % 11 = 0 THEN NULL ELSE CAST((doc_id * {mult} % 1000) / 1000.0 AS DOUBLE) END
           AS malware_probability,
         CASE WHEN doc_id % 11 = 0 THEN 'validation_error: Empty response' ELSE 'success' END AS status,
         CAST(doc_id % 10 + 2015 AS INTEGER) AS year
  FROM labels)"""


def q(select: str, *ctes: str) -> str:
    """Full query: lens CTEs, then the given CTEs, then ``select``."""
    parts = [LENS_CTES]
    for c in ctes:
        parts.append(",\n" + c.strip())
    parts.append("\n" + select.strip())
    return bigint_counts("".join(parts))


def bigint_counts(sql: str) -> str:
    """DuckDB's ``count_if`` is HUGEINT; Spark's is BIGINT — cast every call."""
    out, i, key = [], 0, "count_if("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 0, j + len(key) - 1
        while True:
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        out.append(sql[i:j])
        out.append("CAST(" + sql[j:k + 1] + " AS BIGINT)")
        i = k + 1


FEATURE_COUNTS = "fc AS (SELECT experiment, " + ", ".join(
    f"count_if(RuleName = '{f}') AS {f}" for f in FEATURES) + " FROM trace GROUP BY experiment)"


# Shared CTE fragments over the trace lens -------------------------------
ROOT = """ld AS (SELECT experiment, max(ingest_seq) AS s FROM trace WHERE RuleName = 'detonation' GROUP BY experiment),
fe AS (SELECT experiment, min(ingest_seq) AS s FROM trace GROUP BY experiment),
root AS (
  SELECT fe.experiment,
         CASE WHEN t1.child_guid IS NOT NULL AND t1.child_guid <> '' THEN t1.child_guid ELSE t2.parent_guid END
           AS root_guid
  FROM fe LEFT JOIN ld ON ld.experiment = fe.experiment
  LEFT JOIN trace t1 ON t1.experiment = ld.experiment AND t1.ingest_seq = ld.s
  JOIN trace t2 ON t2.experiment = fe.experiment AND t2.ingest_seq = fe.s)"""

EDGES = """edges AS (SELECT experiment, parent_guid, child_guid FROM trace
  WHERE RuleName = 'process_create' AND parent_guid IS NOT NULL AND child_guid IS NOT NULL)"""

FANOUT = """fo AS (SELECT experiment, parent_guid, count(*) AS children FROM edges GROUP BY experiment, parent_guid)"""

PROCS = """procs AS (
  SELECT experiment, count(*) AS processes FROM (
    SELECT experiment, parent_guid AS g FROM trace
    UNION SELECT experiment, child_guid AS g FROM trace WHERE RuleName = 'process_create')
  WHERE g IS NOT NULL GROUP BY experiment)"""

DEPTH = """de AS (SELECT DISTINCT experiment, parent_guid AS node, child_guid AS child FROM edges),
dbound AS (SELECT experiment, count(*) + 1 AS bound FROM de GROUP BY experiment),
walk(experiment, node, depth) AS (
  SELECT experiment, root_guid, 1 FROM root
  UNION
  SELECT w.experiment, de.child, w.depth + 1
  FROM walk w JOIN de ON w.experiment = de.experiment AND w.node = de.node
  JOIN dbound ON dbound.experiment = w.experiment
  WHERE w.depth <= dbound.bound),
depth AS (
  SELECT experiment, CAST(max(d) AS BIGINT) AS max_tree_depth
  FROM (SELECT experiment, node, min(depth) AS d FROM walk GROUP BY experiment, node)
  GROUP BY experiment)"""

STARTS = """st AS (
  SELECT c.experiment, c.ingest_seq, c.RuleName AS rule
  FROM trace c LEFT JOIN trace p ON p.experiment = c.experiment AND p.ingest_seq = c.ingest_seq - 1
  WHERE p.RuleName IS NULL OR p.RuleName <> c.RuleName),
ls AS (SELECT experiment, max(ingest_seq) AS last_seq FROM trace GROUP BY experiment),
runs AS (
  SELECT st.experiment,
         CAST(row_number() OVER (PARTITION BY st.experiment ORDER BY st.ingest_seq) AS BIGINT) AS run_no,
         rule,
         CAST(coalesce(lead(st.ingest_seq) OVER (PARTITION BY st.experiment ORDER BY st.ingest_seq),
                       ls.last_seq + 1) - st.ingest_seq AS BIGINT) AS run_len
  FROM st JOIN ls ON ls.experiment = st.experiment)"""

BIGRAMS = """bg AS (SELECT a.experiment, a.RuleName AS a, b.RuleName AS b
  FROM trace a JOIN trace b ON a.experiment = b.experiment AND b.ingest_seq = a.ingest_seq + 1),
bgc AS (SELECT experiment, a, b, count(*) AS n FROM bg GROUP BY experiment, a, b)"""

BOUNDS = """b AS (SELECT experiment, count(*) AS n, min(t_us) AS f,
    greatest(0.0, (max(t_us) - min(t_us)) / 1e6) AS dur FROM trace GROUP BY experiment),
bins AS (SELECT t.experiment, floor((t.t_us - b.f) / 1e6) AS sec, count(*) AS c
    FROM trace t JOIN b ON b.experiment = t.experiment GROUP BY t.experiment, sec),
pk AS (SELECT experiment, max(c) AS peak FROM bins GROUP BY experiment),
rates AS (
  SELECT b.experiment, b.n AS total_events, round_even(b.dur, 3) AS duration_seconds,
         CASE WHEN b.dur > 0 THEN round_even(b.n / greatest(1.0, b.dur), 2) ELSE CAST(b.n AS DOUBLE) END
           AS avg_events_per_sec,
         CAST(CASE WHEN b.dur > 0 THEN pk.peak ELSE b.n END AS BIGINT) AS peak_events_per_sec
  FROM b JOIN pk ON pk.experiment = b.experiment)"""


def _fam(rule_pred: str, name: str) -> str:
    return (f"CAST(count(DISTINCT CASE WHEN {rule_pred} THEN child_name END) + "
            f"max(CASE WHEN {rule_pred} AND child_name IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS {name}")


ENTITIES = ("fam AS (SELECT experiment, "
            + ", ".join([_fam("RuleName = 'file_create'", "unique_files_created"),
                         _fam("RuleName = 'image_load'", "unique_images_loaded"),
                         _fam("starts_with(RuleName, 'reg_')", "unique_registry_keys"),
                         _fam("RuleName = 'net_connect'", "unique_network_connections")])
            + " FROM trace GROUP BY experiment),\n" + PROCS + """,
ent AS (SELECT fam.experiment, CAST(coalesce(procs.processes, 0) AS BIGINT) AS processes,
  unique_files_created, unique_images_loaded, unique_registry_keys, unique_network_connections
  FROM fam LEFT JOIN procs ON procs.experiment = fam.experiment)""")

TREE = ROOT + ",\n" + EDGES + ",\n" + FANOUT + ",\n" + DEPTH + """,
tf AS (SELECT root.experiment, CAST(coalesce(max(fo.children), 0) AS BIGINT) AS max_branching_factor,
  CAST(coalesce(max(CASE WHEN fo.parent_guid = root.root_guid THEN fo.children END), 0) AS BIGINT)
    AS root_spawned_children
  FROM root LEFT JOIN fo ON fo.experiment = root.experiment GROUP BY root.experiment)"""


def metrics_sql(src: str, grouped: bool, undefined: str = "null", label: str = "label",
                prediction: str = "prediction", score: str = "malware_probability") -> tuple[str, str]:
    """CTEs ``cm`` (confusion), ``auc`` and ``met`` for the rows of CTE ``src``.

    ``grouped``: groups are ``'all'`` plus ``year`` (``'unknown'`` for null),
    as GROUPING SETS ((year), ()).  Returns (ctes, final column list).
    """
    if grouped:
        gsel = ("CASE WHEN grouping(year) = 1 THEN 'all' ELSE coalesce(CAST(year AS VARCHAR), 'unknown') END AS grp")
        gby = "GROUP BY GROUPING SETS ((year), ())"
        gby_s = f"GROUP BY GROUPING SETS ((year, {score}), ({score}))"
    else:
        gsel, gby, gby_s = "'all' AS grp", "", f"GROUP BY {score}"
    y = f"{label} = 'malicious'"
    p = f"{prediction} = 'malicious'"
    z = "0.0" if undefined == "zero" else "NULL"
    if undefined == "zero":
        f1 = f"CASE WHEN tp > 0 THEN round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / ((tp / (tp + fp)) + (tp / (tp + fn))), 9) ELSE {z} END"
    else:
        f1 = f"CASE WHEN tp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), 9) ELSE {z} END"
    ctes = f"""cm AS (SELECT {gsel}, count(*) AS n, count_if(NOT ({y})) AS benign, count_if({y}) AS malicious,
    count_if(NOT ({y}) AND NOT ({p})) AS tn, count_if(NOT ({y}) AND {p}) AS fp,
    count_if({y} AND NOT ({p})) AS fn, count_if({y} AND {p}) AS tp
  FROM {src} {gby}),
sc AS (SELECT {gsel.replace('grouping(year)', f'grouping(year)')}, {score} AS s,
    count_if({y}) AS pos, count_if(NOT ({y})) AS neg FROM {src} {gby_s}),
cum AS (SELECT grp, s, pos, neg,
    sum(pos) OVER (PARTITION BY grp ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cp,
    sum(neg) OVER (PARTITION BY grp ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cn,
    sum(pos) OVER (PARTITION BY grp) AS P, sum(neg) OVER (PARTITION BY grp) AS N FROM sc),
seg AS (SELECT grp, P, N, (cn - neg) / N AS x0, cn / N AS x1, (cp - pos) / P AS y0, cp / P AS y1 FROM cum),
auc AS (SELECT grp,
    CASE WHEN max(P) > 0 AND max(N) > 0 THEN round(sum((x1 - x0) * (y0 + y1) / 2), 9) END AS roc_auc,
    CASE WHEN max(P) > 0 AND max(N) > 0 THEN round(0.5 * (1 + (sum(CASE WHEN x1 <= 0.1 THEN (x1 - x0) * (y0 + y1) / 2
                 WHEN x0 < 0.1 THEN (0.1 - x0) * (y0 + (y0 + (y1 - y0) * (0.1 - x0) / (x1 - x0))) / 2
                 ELSE 0 END) - 0.005) / (0.1 - 0.005)), 9) END AS partial_auc_max_fpr_0_1
  FROM seg GROUP BY grp),
met AS (SELECT cm.grp, n, benign, malicious, tn, fp, fn, tp,
    CASE WHEN n > 0 THEN round((tp + tn) / n, 9) ELSE {z} END AS accuracy,
    CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 9) ELSE {z} END AS malware_recall,
    CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 9) ELSE {z} END AS malware_precision,
    {f1} AS malware_f1,
    CASE WHEN tn + fp > 0 THEN round(fp / (tn + fp), 9) ELSE {z} END AS benign_fpr,
    CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN round((tp / (tp + fn) + tn / (tn + fp)) / 2, 9) ELSE {z} END
      AS balanced_accuracy,
    auc.roc_auc, auc.partial_auc_max_fpr_0_1
  FROM cm LEFT JOIN auc ON auc.grp = cm.grp)"""
    cols = ("n, benign, malicious, tn, fp, fn, tp, accuracy, malware_recall, malware_precision, malware_f1, "
            "benign_fpr, balanced_accuracy, roc_auc, partial_auc_max_fpr_0_1")
    return ctes, cols
