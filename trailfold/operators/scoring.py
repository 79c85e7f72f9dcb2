"""Distributed prompt scoring: render, key, probe the cache, score, validate, audit (PB-01..09).

The reference loops over rows with a thread pool and a SQLite cache.  Here
the same steps are relational:

* prompts are string expressions over the summary table (joined, never
  collected);
* the cache is a table; reuse is a join, pending work is a ``left_anti``;
* the scorer is a user hook run with ``mapInPandas`` on the pending rows
  only (Arrow batches, per-row failure isolation); the deterministic mock
  ships both as that hook and as a pure expression;
* reply validation is built-in JSON/variant functions, producing a status
  — malformed replies become failures, never benign predictions.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailfold.functions.prompts import RETRIEVAL_USER, SYSTEM_PROMPT, ZERO_SHOT_USER
from trailfold.session import checkpoint_dir, materialize

OK_STATUS = ("success", "cached")
# --- fixed values: number literals beyond JSON, and strings that read as them ---
LITERALS = [("-Infinity", "-inf"), ("Infinity", "inf"), ("NaN", "nan")]
# --- end fixed values ---
FENCE = r"(?s)```(?:json)?\s*(.*?)\s*```"
# white space as in Unicode, and the four separators U+001C..U+001F
STRIPPED = r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"


# ----------------------------------------------------------------- prompts
def render_user(config: str, trace_text: Column, reference_block: Column | None = None) -> Column:
    """PB-02: literal placeholder substitution (reference block first, then the trace)."""
    if config == "retrieval_assisted":
        ref = reference_block if reference_block is not None else F.lit("")
        return F.replace(F.replace(F.lit(RETRIEVAL_USER), F.lit("{reference_examples}"), ref),
                         F.lit("{target_trace}"), trace_text)
    if config in ("zero_shot", "tool_agent"):
        return F.replace(F.lit(ZERO_SHOT_USER), F.lit("{trace_text}"), trace_text)
    raise ValueError(f"unknown config {config!r}")


# --- fixed values: short escapes of JSON strings, the backslash first ---
SHORT_ESCAPES = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")]
# --- end fixed values ---


def _json_str(c: Column) -> Column:
    """JSON string literal in ASCII: what is not printable ASCII as its UTF-16 units, ``\\uXXXX``.

    Only texts with such characters are split, into runs of the one kind and the other.
    """
    s = c
    for char, escape in SHORT_ESCAPES:
        s = F.replace(s, F.lit(char), F.lit(escape))
    units = lambda run: F.regexp_replace(F.lower(F.hex(F.encode(run, "UTF-16BE"))), "(.{4})", r"\\u$1")
    runs = F.split(s, "(?<=[ -~])(?=[^ -~])|(?<=[^ -~])(?=[ -~])")
    escaped = F.array_join(F.transform(runs, lambda run: F.when(run.rlike("[^ -~]"), units(run)).otherwise(run)), "")
    return F.concat(F.lit('"'), F.when(s.rlike("[^ -~]"), escaped).otherwise(s), F.lit('"'))


def prompt_hash(system: Column, user: Column) -> Column:
    """PB-03/SC-05: SHA-256 of ``json.dumps(messages, sort_keys=True)``.

    Python's layout (``", "``/``": "`` separators, sorted keys) and its ASCII escapes, for any text.
    """
    canon = F.concat(F.lit('[{"content": '), _json_str(system), F.lit(', "role": "system"}, {"content": '),
                     _json_str(user), F.lit(', "role": "user"}]'))
    return F.sha2(canon, 256)


def cache_key(experiment_id: Column, config: str, model: str, phash: Column) -> Column:
    """PB-03: ``{id}_{config}_{model}_{hash[:16]}``."""
    return F.concat_ws("_", experiment_id, F.lit(config), F.lit(model), F.substring(phash, 1, 16))


def _repr_len(c: Column) -> Column:
    """Length of Python ``repr`` of an ASCII string (quotes + escapes)."""
    n = F.length(c)
    esc = sum((F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))) for ch in ("\n", "\r", "\t", "\\"))
    quotes = F.when(F.instr(c, '"') > 0, F.length(c) - F.length(F.replace(c, F.lit("'"), F.lit("")))) \
        .otherwise(F.lit(0))
    return n + 2 + esc + quotes


_MSG_OVERHEAD = len(str([{"role": "system", "content": ""}, {"role": "user", "content": ""}])) - 4


def token_estimate(system: Column, user: Column) -> Column:
    """SC-12: ``len(str(messages)) // 4`` (the mock's prompt-token count)."""
    return F.floor((F.lit(_MSG_OVERHEAD) + _repr_len(system) + _repr_len(user)) / 4).cast("long")


# ----------------------------------------------------------------- mock scorer
# --- fixed values: the deterministic mock reply ---
MOCK_MAL_P, MOCK_BEN_P, MOCK_CONF = 0.85, 0.15, 0.88
MOCK_COMPLETION_TOKENS, MOCK_LATENCY = 80, 0.05
MOCK_EVIDENCE_1 = "Mock observation: observed process activity and entity distribution."
MOCK_EVIDENCE_MAL = "Mock observation: detected multi-process network pattern."
MOCK_EVIDENCE_BEN = "Mock observation: low activity profile."
# --- end fixed values ---


def mock_is_malicious(user: Column) -> Column:
    """PB-04 decision on the user message text."""
    pc = F.instr(user, "process_create") > 0
    net = (F.instr(user, "unique_network_connections") > 0) & ~(F.instr(user, "unique_network_connections: 0") > 0)
    reg = (F.instr(user, "reg_write") > 0) | (F.instr(user, "reg_create_key") > 0)
    return (pc & net) | (reg & pc)


def _mock_reply(malicious: bool) -> str:
    return json.dumps({"prediction": "malicious" if malicious else "benign",
                       "malware_probability": MOCK_MAL_P if malicious else MOCK_BEN_P, "confidence": MOCK_CONF,
                       "evidence": [MOCK_EVIDENCE_1, MOCK_EVIDENCE_MAL if malicious else MOCK_EVIDENCE_BEN],
                       "uncertainty_reason": None})


def _mock_content(is_mal: Column) -> Column:
    return F.when(is_mal, F.lit(_mock_reply(True))).otherwise(F.lit(_mock_reply(False)))


def mock_scores(prompts: DataFrame) -> DataFrame:
    """PB-04 as expressions: adds ``content, prompt_tokens, completion_tokens, latency, error``."""
    mal = mock_is_malicious(F.col("user"))
    return prompts.select(
        "*", _mock_content(mal).alias("content"),
        token_estimate(F.col("system"), F.col("user")).alias("prompt_tokens"),
        F.lit(MOCK_COMPLETION_TOKENS).cast("long").alias("completion_tokens"),
        F.lit(MOCK_LATENCY).alias("latency"), F.lit(None).cast("string").alias("error"))


BATCH_ROWS = 64   # prompts that a scorer is handed at once
REPLY = ["content", "prompt_tokens", "completion_tokens", "latency", "error"]


def score_with(prompts: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame | Iterator[pd.DataFrame]],
               batch_rows: int = BATCH_ROWS) -> DataFrame:
    """PB-08/PB-07: ``prompts`` with the reply columns of a user scorer.

    ``scorer`` is handed up to ``batch_rows`` prompts as a pandas frame ``system,
    user`` and answers with a frame ``content, prompt_tokens, completion_tokens,
    latency, error`` whose index names the rows answered, or yields several such
    frames; ``error`` is a row's own.  Answers before an exception count.  Rows
    left without one are asked again one by one (no row a third time, no answered
    row again); what fails then is that row's error.  All columns of ``prompts``
    ride along, so nothing is joined back.
    """
    added = "content string, prompt_tokens long, completion_tokens long, latency double, error string"
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields]

    def ask(asked: pd.DataFrame, answers: dict[int, tuple]) -> str:
        """Adds the answers to ``asked``; returns the exception that ended them, if any."""
        try:
            got = scorer(asked)
            for frame in [got] if isinstance(got, pd.DataFrame) else got:
                for at, row in zip(frame.index, frame[REPLY].itertuples(index=False, name=None)):
                    if at in asked.index:
                        answers.setdefault(at, row)
        except Exception as exc:  # noqa: BLE001 - the rows' own failure
            return str(exc)
        return "no answer"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.reset_index(drop=True)
            answers: dict[int, tuple] = {}
            for lo in range(0, len(b), batch_rows):
                asked = b.loc[lo:lo + batch_rows - 1, ["system", "user"]].reset_index(drop=True)
                here: dict[int, tuple] = {}
                why = ask(asked, here)
                for at in asked.index.difference(list(here)):
                    single: dict[int, tuple] = {}
                    if len(asked) > 1:
                        why = ask(asked.loc[[at]].reset_index(drop=True), single)
                    here[at] = single.get(0, (None, 0, 0, 0.0, f"exception: {why[:50]}"))
                answers.update({lo + at: row for at, row in here.items()})
            yield pd.concat([b, pd.DataFrame([answers[i] for i in range(len(b))], columns=REPLY)], axis=1)
    return prompts.mapInPandas(run, ", ".join([*fields, added]))


def mock_scorer(batch: pd.DataFrame) -> pd.DataFrame:
    """PB-04 as a scorer for ``score_with``: the rule and the reply of ``mock_scores``, many rows a call."""
    has = lambda words: batch["user"].str.contains(words, regex=False)
    network = has("unique_network_connections") & ~has("unique_network_connections: 0")
    bad = has("process_create") & (network | has("reg_write") | has("reg_create_key"))
    asked = [len(str([{"role": "system", "content": s}, {"role": "user", "content": u}])) // 4
             for s, u in zip(batch["system"], batch["user"])]
    return pd.DataFrame({"content": bad.map({True: _mock_reply(True), False: _mock_reply(False)}), "prompt_tokens": asked,
                         "completion_tokens": MOCK_COMPLETION_TOKENS, "latency": MOCK_LATENCY, "error": None}, index=batch.index)


# ----------------------------------------------------------------- validation
def validate_reply(raw: Column) -> Column:
    """PB-05: ``struct(error, prediction, malware_probability, confidence, evidence_count)``.

    ``error`` is NULL for a valid reply, else the first failing rule in the
    fixed order: empty → JSON → object → prediction → probability (type,
    range) → confidence (type, range) → evidence list.
    """
    t0 = strip(raw)
    text = _unfence(t0)
    return _validated(raw, t0, text, _parsed(text))


def _seal(text: Column) -> Column:
    """What no reply can hold: the hash of its own text."""
    return F.sha2(text, 256)


def _parsed(text: Column) -> Column:
    """The reply as the first of two elements, its seal the second: one whole JSON text, or it is something else.

    Whatever follows the reply's own value breaks the array, ends it early or
    adds an element.  A repeated key keeps its last value (a session setting).
    ``NaN`` and the infinities, which strict JSON lacks and a lenient reader
    takes, become the strings that read as those numbers.
    """
    return F.try_parse_json(F.concat(F.lit("["), _literals(text), F.lit(',"'), _seal(text), F.lit('"]')))


def _literals(text: Column) -> Column:
    out = text
    for literal, string in LITERALS:
        # from the last match on: whole strings and anything that does not begin the literal; a key it cannot be
        head, tail = literal[0], literal[1:]
        outside = rf"""(?:[^"{head}]++|"(?:[^"\\]++|\\.)*+"|{head}(?!{tail}))*+"""
        out = F.regexp_replace(out, rf"(?s)\G({outside}){literal}(?!\s*:)", f'$1"{string}"')
    return F.when(text.contains("NaN") | text.contains("Infinity"), out).otherwise(text)


def python_float(x: Column) -> Column:
    """A double written as Python's ``str`` writes it."""
    text = x.cast("string")
    plain = F.regexp_replace(F.regexp_replace(x.cast("decimal(38,20)").cast("string"), "0+$", ""), r"\.$", ".0")
    power = F.regexp_replace(F.regexp_replace(text, r"\.0E", "E"), r"E(\d)", "e+$1")
    power = F.regexp_replace(F.regexp_replace(power, "E-", "e-"), r"e([+-])(\d)$", "e$10$2")
    size = F.abs(x)
    return (F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
            .when(size == 0, text).when((size >= 1e16) | (size < 1e-4), power).otherwise(plain))


def strip(text: Column) -> Column:
    """SC-04: without white space of any kind at both ends (``trim`` takes blanks only)."""
    return F.regexp_replace(text, STRIPPED, "")


def _unfence(t0: Column) -> Column:
    return F.when(t0.rlike(FENCE), strip(F.regexp_extract(t0, FENCE, 1))).otherwise(t0)


def validate_frame(df: DataFrame, raw: str, out: str = "_v") -> DataFrame:
    """``validate_reply`` staged as separate projections (trim/unfence → parse → checks).

    The parsed variant is computed once per row and referenced by the checks,
    which keeps the generated code small.
    """
    d = (df.withColumn("_t0", strip(F.col(raw)))
         .withColumn("_txt", _unfence(F.col("_t0")))
         .withColumn("_var", _parsed(F.col("_txt"))))
    return (d.withColumn(out, _validated(F.col(raw), F.col("_t0"), F.col("_txt"), F.col("_var")))
            .drop("_t0", "_txt", "_var"))


def _validated(raw: Column, t0: Column, text: Column, parsed: Column) -> Column:
    whole = F.coalesce((F.size(F.try_variant_get(parsed, "$", "array<variant>")) == 2)
                       & (F.try_variant_get(parsed, "$[1]", "string") == _seal(text)), F.lit(False))
    v = F.try_variant_get(parsed, "$[0]", "variant")
    is_obj = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    pred = F.try_variant_get(v, "$.prediction", "string")
    prob_s = F.try_variant_get(v, "$.malware_probability", "string")
    prob = F.try_variant_get(v, "$.malware_probability", "double")
    conf_s = F.try_variant_get(v, "$.confidence", "string")
    conf = F.try_variant_get(v, "$.confidence", "double")
    ev = F.try_variant_get(v, "$.evidence", "variant")
    ev_is_list = F.coalesce(F.schema_of_variant(ev).startswith("ARRAY"), F.lit(False))

    err = (F.when(raw.isNull() | (t0 == ""), F.lit("Empty response"))
           .when(~whole, F.lit("JSONDecodeError"))
           .when(~is_obj, F.lit("Output is not a JSON dictionary"))
           .when(~F.coalesce(pred.isin("benign", "malicious"), F.lit(False)),
                 F.concat(F.lit("Invalid prediction value: "), F.coalesce(pred, F.lit("None")),
                          F.lit(". Must be 'benign' or 'malicious'")))
           .when(prob.isNull(), F.concat(F.lit("Invalid malware_probability: "), F.coalesce(prob_s, F.lit("None"))))
           .when(~((prob >= 0.0) & (prob <= 1.0)),
                 F.concat(F.lit("malware_probability "), python_float(prob), F.lit(" out of bounds [0, 1]")))
           .when(conf.isNull(), F.concat(F.lit("Invalid confidence: "), F.coalesce(conf_s, F.lit("None"))))
           .when(~((conf >= 0.0) & (conf <= 1.0)),
                 F.concat(F.lit("confidence "), python_float(conf), F.lit(" out of bounds [0, 1]")))
           .when(~ev_is_list, F.lit("evidence must be a list of strings")))
    ok = err.isNull()
    ev_n = F.coalesce(F.size(F.try_variant_get(v, "$.evidence", "array<variant>")), F.lit(0))
    return F.struct(
        err.alias("error"),
        F.when(ok, pred).alias("prediction"),
        F.when(ok, prob).alias("malware_probability"),
        F.when(ok, conf).alias("confidence"),
        F.when(ok, ev_n).otherwise(F.lit(0)).cast("long").alias("evidence_count"))


def reply_status(validated: Column) -> Column:
    return F.when(validated["error"].isNull(), F.lit("success")) \
        .otherwise(F.concat(F.lit("validation_error: "), F.substring(validated["error"], 1, 50)))


# ----------------------------------------------------------------- the batch
def build_prompts(eval_set: DataFrame, summaries: DataFrame, config: str, model: str,
                  reference_blocks: DataFrame | None = None) -> DataFrame:
    """Eval rows (``experiment``) ⋈ summary text (left) → ``experiment_id, status?, system, user, prompt_hash, cache_key``.

    Rows without a summary keep ``has_summary = false`` (JN-05) and get no prompt.
    """
    s = summaries.select(F.col("experiment_id"), F.col("text_repr"), F.lit(True).alias("has_summary"))
    e = eval_set.select(F.col("experiment").alias("experiment_id")).join(s, "experiment_id", "left")
    if config == "retrieval_assisted" and reference_blocks is not None:
        e = e.join(reference_blocks.select(F.col("target_id").cast("string").alias("experiment_id"),
                                           "reference_block", "retrieved_ids"), "experiment_id", "left")
        ref, rids = F.coalesce("reference_block", F.lit("")), F.coalesce("retrieved_ids", F.lit(""))
    else:
        ref, rids = None, F.lit("")
    user = render_user(config, F.col("text_repr"), ref)
    system = F.lit(SYSTEM_PROMPT)
    ph = prompt_hash(system, user)
    ok = F.coalesce(F.col("has_summary"), F.lit(False))
    return e.select(
        "experiment_id", ok.alias("has_summary"),
        F.when(ok, system).alias("system"), F.when(ok, user).alias("user"),
        F.when(ok, ph).otherwise(F.lit("")).alias("prompt_hash"),
        F.when(ok, cache_key(F.col("experiment_id"), config, model, ph)).alias("cache_key"),
        F.when(ok, rids).otherwise(F.lit("")).alias("retrieved_ids"))


def latest_cache(cache: DataFrame) -> DataFrame:
    """SNK-08: the cache as a table of appended rows; the latest row per key wins."""
    from trailfold.functions.ranking import latest_per_key
    return latest_per_key(cache, "cache_key", ["timestamp"]).select(*cache.columns)


def reusable(cache: DataFrame) -> DataFrame:
    """JN-06: the latest cache row of each key, where it may be reused."""
    return latest_cache(cache).where(F.col("status").isin(*OK_STATUS))


def pending_rows(live: DataFrame, cache: DataFrame) -> DataFrame:
    """JN-06: rows of ``live`` without a reusable cache row for their ``cache_key``."""
    return live.join(reusable(cache).select("cache_key"), "cache_key", "left_anti")


def score_rows(prompts: DataFrame, config: str, model: str, cache: DataFrame | None = None,
               scorer: Callable[[pd.DataFrame], pd.DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """PB-06/PB-09/JN-06: assemble one audit row per eval row, and the new cache rows.

    Returns ``(audit, cache_append)``.  Reused: cache rows with status
    success/cached (status ``cached``); pending: everything else goes to
    the scorer.  Transport errors are not cached; validation failures are
    cached but never reused.
    """
    checkpoint_dir(prompts.sparkSession)
    live = prompts.where("has_summary")
    if cache is not None:
        reused = live.join(reusable(cache).select("cache_key", F.col("raw_response").alias("content"), "prompt_tokens",
                                       "completion_tokens", F.col("latency")), "cache_key", "inner")
        reused = reused.withColumn("error", F.lit(None).cast("string")).withColumn("_cached", F.lit(True))
        pending = pending_rows(live, cache)
    else:
        reused, pending = None, live
    fresh = mock_scores(pending) if scorer is None else score_with(pending, scorer)
    fresh = fresh.withColumn("_cached", F.lit(False))
    cols = ["experiment_id", "prompt_hash", "cache_key", "retrieved_ids", "content", "prompt_tokens",
            "completion_tokens", "latency", "error", "_cached"]
    rows = fresh.select(*cols) if reused is None else fresh.select(*cols).unionByName(reused.select(*cols))
    # written once: audit and cache are two views of the same replies, and the scorer is not asked again
    rows = validate_frame(materialize(rows), "content", "_v")
    status = (F.when(F.col("_cached"), F.lit("cached"))
              .when(F.col("error").startswith("exception: "), F.col("error"))
              .when(F.col("error").isNotNull(), F.concat(F.lit("api_error: "), F.substring("error", 1, 50)))
              .otherwise(reply_status(F.col("_v"))))
    scored = rows.select(
        "experiment_id", F.lit(config).alias("config"), F.lit(model).alias("model"),
        F.when(F.col("error").startswith("exception: "), F.lit("")).otherwise(F.col("prompt_hash")).alias("prompt_hash"),
        "retrieved_ids", status.alias("status"),
        F.col("_v.prediction").alias("prediction"), F.col("_v.malware_probability").alias("malware_probability"),
        F.col("_v.confidence").alias("confidence"), F.round(F.col("latency").cast("double"), 3).alias("latency_sec"),
        F.col("prompt_tokens").cast("long").alias("prompt_tokens"),
        F.col("completion_tokens").cast("long").alias("completion_tokens"),
        F.col("_v.evidence_count").alias("evidence_count"),
        "cache_key", "content", F.col("_cached"), F.col("error"))
    missing = prompts.where(~F.col("has_summary")).select(
        "experiment_id", F.lit(config).alias("config"), F.lit(model).alias("model"),
        F.lit("").alias("prompt_hash"), F.lit("").alias("retrieved_ids"),
        F.lit("missing_trace_summary").alias("status"),
        F.lit(None).cast("string").alias("prediction"), F.lit(None).cast("double").alias("malware_probability"),
        F.lit(None).cast("double").alias("confidence"), F.lit(0.0).alias("latency_sec"),
        F.lit(0).cast("long").alias("prompt_tokens"), F.lit(0).cast("long").alias("completion_tokens"),
        F.lit(0).cast("long").alias("evidence_count"))
    from trailfold.schemas import AUDIT_COLUMNS
    audit = scored.select(*AUDIT_COLUMNS).unionByName(missing.select(*AUDIT_COLUMNS))
    # PB-09: store fresh replies (valid or not), never transport errors / exceptions
    cache_append = scored.where(~F.col("_cached") & F.col("error").isNull()).select(
        "cache_key", "experiment_id", F.lit(config).alias("config_name"), F.lit(model).alias("model_name"),
        "prompt_hash", F.col("content").alias("raw_response"),
        F.when(F.col("status") == "success", F.col("content")).alias("parsed_json"), "status",
        F.col("latency_sec").alias("latency"), "prompt_tokens", "completion_tokens",
        F.current_timestamp().alias("timestamp"))
    return audit, cache_append
