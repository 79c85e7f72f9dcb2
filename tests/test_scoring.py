"""Reply validation, prompt keys, mock scorer and the scored batch."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from trailfold.functions.prompts import SYSTEM_PROMPT, ZERO_SHOT_USER
from trailfold.operators import scoring
from trailfold.sources.lens import REPLIES

MALFORMED = REPLIES[:11]


def _validate(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "raw string")
    return [r.v for r in df.select(scoring.validate_reply(F.col("raw")).alias("v")).collect()]


def test_malformed_replies_rejected(spark):
    out = _validate(spark, MALFORMED)
    assert all(v.error is not None and v.prediction is None for v in out)


def test_valid_and_fenced_replies(spark):
    v = _validate(spark, REPLIES[11:13])
    assert v[0].error is None and v[0].prediction == "malicious" and v[0].malware_probability == 0.85
    assert v[0].evidence_count == 2
    assert v[1].error is None and v[1].prediction == "benign"


@pytest.mark.parametrize("text,ok", [
    ('{"prediction": "benign", "malware_probability": "0.5", "confidence": 0.5, "evidence": []}', True),
    ('{"prediction": "benign", "malware_probability": true, "confidence": 0.5, "evidence": []}', True),
    ('{"prediction": "benign", "malware_probability": 0.5, "confidence": 0.5, "evidence": []} junk', False),
    ("[1, 2]", False),
])
def test_extra_cases(spark, text, ok):
    assert (_validate(spark, [text])[0].error is None) == ok


def test_prompt_hash_of_any_text_matches_python(spark):
    texts = ["", "plain \"quoted\" \\ back\n\r\t\b\f", "caf\u00e9", "\u65e5\u672c", "a\U0001f600b\U0010ffff", "\x00\x01\x1f\x7f\x80",
             "\u2028\u2029\ufeff\ufffd", "\\u00e9", "\\n\n", "e\u0301 $1 \\1", "\u00e9" * 3000 + "x" * 3000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r.id: r.h for r in df.select("id", scoring.prompt_hash(F.lit("s\u00ff"), F.col("text")).alias("h")).collect()}
    for i, t in enumerate(texts):
        msgs = [{"role": "system", "content": "s\u00ff"}, {"role": "user", "content": t}]
        assert got[i] == hashlib.sha256(json.dumps(msgs, sort_keys=True).encode()).hexdigest(), repr(t[:40])


def test_prompt_hash_and_tokens_match_python(spark):
    user = ZERO_SHOT_USER.replace("{trace_text}", "=== Trace ===\n  - process_create: 3")
    msgs = [{"role": "system", "content": SYSTEM_PROMPT}, {"role": "user", "content": user}]
    r = spark.range(1).select(scoring.prompt_hash(F.lit(SYSTEM_PROMPT), F.lit(user)).alias("h"),
                              scoring.token_estimate(F.lit(SYSTEM_PROMPT), F.lit(user)).alias("t")).first()
    assert r.h == hashlib.sha256(json.dumps(msgs, sort_keys=True).encode()).hexdigest()
    assert r.t == len(str(msgs)) // 4


def make_scorer():
    def own_scorer(batch):
        """A scorer of the test's own: the mock's rule over sets of words, one reply for each row."""
        import pandas as pd
        out = []
        for system, user in zip(batch["system"], batch["user"]):
            has = {w for w in ("process_create", "unique_network_connections", "unique_network_connections: 0", "reg_write",
                               "reg_create_key") if w in user}
            network = "unique_network_connections" in has and "unique_network_connections: 0" not in has
            bad = "process_create" in has and (network or bool(has & {"reg_write", "reg_create_key"}))
            reply = {"prediction": "malicious" if bad else "benign",
                     "malware_probability": scoring.MOCK_MAL_P if bad else scoring.MOCK_BEN_P, "confidence": scoring.MOCK_CONF,
                     "evidence": [scoring.MOCK_EVIDENCE_1, scoring.MOCK_EVIDENCE_MAL if bad else scoring.MOCK_EVIDENCE_BEN],
                     "uncertainty_reason": None}
            asked = [{"role": "system", "content": system}, {"role": "user", "content": user}]
            out.append((json.dumps(reply), len(str(asked)) // 4, scoring.MOCK_COMPLETION_TOKENS, scoring.MOCK_LATENCY, None))
        return pd.DataFrame(out, columns=["content", "prompt_tokens", "completion_tokens", "latency", "error"])
    return own_scorer


def test_mock_expression_equals_hook(spark):
    users = ["process_create x unique_network_connections: 2", "process_create unique_network_connections: 0",
             "reg_write process_create", "nothing"]
    df = spark.createDataFrame([(str(i), SYSTEM_PROMPT, u) for i, u in enumerate(users)],
                               "cache_key string, system string, user string")
    a = {r.cache_key: (r.content, r.prompt_tokens) for r in scoring.mock_scores(df).collect()}
    b = {r.cache_key: (r.content, r.prompt_tokens) for r in scoring.score_with(df, make_scorer()).collect()}
    assert a == b


def test_score_rows_cache_and_missing(spark):
    ev = spark.createDataFrame([("1",), ("2",), ("3",)], "experiment string")
    summ = spark.createDataFrame([("1", "process_create unique_network_connections: 1"), ("2", "quiet")],
                                 "experiment_id string, text_repr string")
    p = scoring.build_prompts(ev, summ, "zero_shot", "m")
    audit, new_cache = scoring.score_rows(p, "zero_shot", "m")
    st = {r.experiment_id: r for r in audit.collect()}
    assert st["3"].status == "missing_trace_summary" and st["3"].prediction is None
    assert st["1"].status == "success" and st["1"].prediction == "malicious"
    assert st["2"].prediction == "benign"
    cache = new_cache.checkpoint()
    audit2, new2 = scoring.score_rows(p, "zero_shot", "m", cache=cache)
    st2 = {r.experiment_id: r.status for r in audit2.collect()}
    assert st2 == {"1": "cached", "2": "cached", "3": "missing_trace_summary"}
    assert new2.count() == 0
    from trailfold.schemas import AUDIT_COLUMNS
    assert audit.columns == AUDIT_COLUMNS                      # DQ-07: required columns, in order
    assert not {"label", "ground_truth", "true_label"} & set(audit.columns)


def test_scorer_exception_isolated(spark):
    own_scorer = make_scorer()

    def bad(batch):
        if any("boom" in u for u in batch["user"]):
            raise RuntimeError("boom")
        return own_scorer(batch)
    df = spark.createDataFrame([("a", "s", "fine"), ("b", "s", "boom")], "cache_key string, system string, user string")
    r = {x.cache_key: x for x in scoring.score_with(df, bad).collect()}
    assert r["a"].error is None and r["b"].error.startswith("exception: ")


def test_batches_are_answered_in_parts(spark, tmp_path):
    """Answers before a failure stay; the rest is asked once more, singly; no answered row again."""
    calls, own_scorer = str(tmp_path), make_scorer()

    def in_parts(batch):
        import uuid
        with open(f"{calls}/{uuid.uuid4().hex}", "w") as f:
            f.write("|".join(batch["user"]))
        for at in batch.index:
            user = batch.loc[at, "user"]
            if "down" in user or ("busy" in user and len(batch) > 1):
                raise RuntimeError(f"failed at {user}")
            if "silent" in user:
                continue
            row = own_scorer(batch.loc[[at]]).set_index(batch.index[[batch.index.get_loc(at)]])
            if "limit" in user:
                row["content"], row["error"] = None, "rate limit"
            yield row
    users = ["u0", "limit 1", "silent 2", "u3", "busy 4", "u5", "u6", "down 7", "u8"]
    df = spark.createDataFrame([(u, "s", u) for u in users], "cache_key string, system string, user string").coalesce(1)
    got = {r.cache_key: r for r in scoring.score_with(df, in_parts, batch_rows=6).collect()}
    asked = [open(os.path.join(calls, f)).read().split("|") for f in os.listdir(calls)]
    assert sorted(map(len, asked)) == [1] * 5 + [3, 6]
    assert sorted(a[0] for a in asked if len(a) == 1) == ["busy 4", "down 7", "silent 2", "u5", "u8"]
    assert {u for u in users if got[u].error is None} == {"u0", "u3", "busy 4", "u5", "u6", "u8"}
    assert got["limit 1"].error == "rate limit" and got["silent 2"].error == "exception: no answer"
    assert got["down 7"].error == "exception: failed at down 7" and len(got) == 9


def test_mock_scorer_equals_the_expression(spark):
    users = ["process_create x unique_network_connections: 2", "process_create unique_network_connections: 0", "it's é",
             "reg_write process_create", "reg_create_key", "process_create reg_create_key", ""]
    df = spark.createDataFrame([(SYSTEM_PROMPT, u) for u in users], "system string, user string")
    key = lambda d: sorted(tuple(r) for r in d.collect())
    assert key(scoring.mock_scores(df)) == key(scoring.score_with(df, scoring.mock_scorer, batch_rows=3))


def test_white_space_around_replies(spark):
    good = '{"prediction": "benign", "malware_probability": 0.2, "confidence": 0.9, "evidence": []}'
    cases = {"\n" + good: None, "\t" + good + "\n\n": None, "\r\n ```json\n" + good + "\n``` \t": None, "\u00a0\u2003" + good: None,
             "\x1c" + good + "\x1f": None, " \n\t ": "Empty response", "\u3000": "Empty response", "": "Empty response",
             "\n[1]\n": "Output is not a JSON dictionary", "null": "Output is not a JSON dictionary",
             good + "\n```": "JSONDecodeError", good + "}": "JSONDecodeError", good + "],[" + good: "JSONDecodeError",
             good + "," + good: "JSONDecodeError", "x" + good: "JSONDecodeError"}
    df = spark.createDataFrame([(k,) for k in cases], "raw string")
    got = {r.raw: r.v.error for r in scoring.validate_frame(df, "raw", "v").collect()}
    assert got == cases
    assert {r.raw: r.v.error for r in df.select("raw", scoring.validate_reply(F.col("raw")).alias("v")).collect()} == cases


def test_one_call_for_each_pending_row(spark, tmp_path):
    calls, own_scorer = str(tmp_path), make_scorer()

    def counted(batch):
        import uuid
        for user in batch["user"]:
            with open(f"{calls}/{uuid.uuid4().hex}", "w") as f:
                f.write(user)
        if "boom" in batch["user"].iloc[0]:
            raise RuntimeError("boom")
        return own_scorer(batch)

    ev = spark.createDataFrame([("a",), ("b",), ("c",), ("c",), ("d",)], "experiment string")
    summ = spark.createDataFrame([("a", "quiet"), ("b", "boom"), ("c", "process_create reg_write")], "experiment_id string, text_repr string")
    p = scoring.build_prompts(ev, summ, "zero_shot", "m")
    audit, cache = scoring.score_rows(p, "zero_shot", "m", scorer=counted)
    rows, cached = audit.collect(), cache.collect()
    assert len(list(tmp_path.iterdir())) == 4                  # a, b and twice c; d has no summary
    assert sorted((r.experiment_id, r.status.split(":")[0]) for r in rows) == [
        ("a", "success"), ("b", "exception"), ("c", "success"), ("c", "success"), ("d", "missing_trace_summary")]
    assert {r.prompt_hash for r in rows if r.experiment_id in "bd"} == {""}
    assert sorted(r.experiment_id for r in cached) == ["a", "c", "c"]


# --- fixed values: replies that the reader of Python's standard library sorts into valid and malformed ---
GOOD = '{"prediction": "benign", "malware_probability": %s, "confidence": 0.5, "evidence": %s}'
STRICT = [
    GOOD % ("0.1", "[]") + ', "note": "x"', GOOD % ("0.1", "[]") + ",1", GOOD % ("0.1", "[]") + "],[1", GOOD % ("0.1", "[]") + "],1]",
    GOOD % ("0.1", "[]") + "}", GOOD % ("0.1", "[]") + " trailing", '1, "prediction": "benign"', "[" + GOOD % ("0.1", "[]") + "]",
    '{"prediction": "malicious", ' + (GOOD % ("0.2", "[]"))[1:], GOOD[:-1] % ("0.3", "[1]") + ', "prediction": "malicious"}',
    GOOD % ("0.4", "[NaN, -Infinity, \"NaN\", Infinity]"), GOOD % ("NaN", "[]"), GOOD % ("Infinity", "[]"), GOOD % ("-Infinity", "[]"),
    GOOD % ("0.1", "{NaN: 1}"), GOOD % ("0.1", "[1NaN]"), GOOD % ("0.1", "[NaN1]"), GOOD % ("0.1", "[nan]"),
    GOOD % ("0.1", r'["a \" NaN \\", NaN, "Infinity]"]'), "NaN", GOOD % ("true", "[]"), GOOD % ('"0.25"', "[]"), GOOD % ("12345678.5", "[]"),
    GOOD % ("-0.00001", "[]"), GOOD % ("1e22", "[]"), GOOD % ("2.5e-7", "[]"), GOOD % ("-1.5e300", "[]"), GOOD % ("123456789012345", "[]"),
    GOOD % ("0.1", "[1,]"), GOOD % ("01", "[]"), GOOD % ("0.1", "[]") + GOOD % ("0.1", "[]"), GOOD % ("null", "[]"), "[]", "{}", '"benign"',
]
# --- end fixed values ---


def _by_the_standard_library(raw):
    """(reason up to its details, prediction, probability, evidence items) by ``json.loads`` and ``float``."""
    try:
        data = json.loads(raw)
    except json.JSONDecodeError:
        return "JSONDecodeError", None, None, 0
    if not isinstance(data, dict):
        return "Output is not a JSON dictionary", None, None, 0
    if data.get("prediction") not in ("benign", "malicious"):
        return f"Invalid prediction value: {data.get('prediction')}. Must be 'benign' or 'malicious'", None, None, 0
    for key in ("malware_probability", "confidence"):
        try:
            data[key] = float(data.get(key))
        except (TypeError, ValueError):
            return f"Invalid {key}: {data.get(key)}", None, None, 0
        if not 0 <= data[key] <= 1:
            return f"{key} {data[key]} out of bounds [0, 1]", None, None, 0
    if not isinstance(data.get("evidence"), list):
        return "evidence must be a list of strings", None, None, 0
    return None, data["prediction"], data["malware_probability"], len(data["evidence"])


def test_replies_are_sorted_as_by_the_standard_library(spark):
    df = spark.createDataFrame([(r,) for r in STRICT], "raw string")
    staged = scoring.validate_frame(df, "raw", "v").collect()
    for rows in (df.select("raw", scoring.validate_reply(F.col("raw")).alias("v")).collect(), staged):
        got = {r.raw: (r.v.error, r.v.prediction, r.v.malware_probability, r.v.evidence_count) for r in rows}
        for raw in STRICT:
            assert got[raw] == _by_the_standard_library(raw), raw
    # a long reply of many strings and literals is no depth of recursion
    long = GOOD % ("0.5", "[" + ", ".join(['"NaN \\" Infinity"', "NaN", "-Infinity"] * 20_000) + "]")
    v = spark.createDataFrame([(long,)], "raw string").select(scoring.validate_reply(F.col("raw")).alias("v")).first().v
    assert v.error is None and v.evidence_count == 60_000
