"""The pipeline's stages: what goes, what stays, and the packed rows."""

import os
import re
import subprocess
import sys

import llm_cases as cases
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_llm_joins import brute, shingles
from test_llm_text import spans
from test_llm_tokens import check_packing

import corpus_pipeline
from trailfold.llm import queries
from trailfold.llm.common import fresh, saved

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_registry():
    names = list(queries.queries())
    assert [re.match(r"op\d+_|pipeline", n)[0] for n in names] == [*[f"op{i}_" for i in range(1, 14)], "pipeline"]
    assert set(queries.oracle_sql()) <= set(names) and os.path.exists(public_tokenizers.path(queries.PIECES))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "language_id", "ngram_jaccard_join", "secret_scans",
                                                      "best_fit_packing"]
    assert fresh("score", ["Score", "score_"]) == "score__"


def test_the_rest_stands_without_the_subpackage(tmp_path):
    """A copy without the subpackage and the pipeline still imports and registers its queries."""
    os.makedirs(tmp_path / "trailfold")
    for name in os.listdir(os.path.join(ROOT, "trailfold")):
        if name != "llm":
            os.symlink(os.path.join(ROOT, "trailfold", name), tmp_path / "trailfold" / name)
    with open(os.path.join(ROOT, "__spark_entry__.py")) as f:
        source = f.read().replace("os.path.dirname(os.path.abspath(__file__))", repr(str(tmp_path)))
    done = subprocess.run([sys.executable, "-B", "-c", source + "\nprint(len(queries()), 'pipeline' in queries())"], cwd=tmp_path,
                          capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""}, timeout=120)
    assert done.stdout.split()[1] == "False" and int(done.stdout.split()[0]) > 100, done.stderr[-500:]


def test_the_rest_stands_without_a_library_of_the_subpackage():
    code = ("import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; "
            "print(len(e.queries()), 'pipeline' in e.queries(), len(e.oracle_sql()))")
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.stdout.split()[1] == "False" and int(done.stdout.split()[0]) > 100, done.stderr[-500:]


@pytest.mark.skipif(not cases.HAVE_SF, reason="driver test data not present")
def test_a_stage_removes_what_the_one_before_left(spark):
    from trailfold.session import checkpoint_dir
    folder = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    docs = cases.texts(spark)
    for _, stage in corpus_pipeline.STAGES[2:4]:
        docs = saved(stage(spark, docs, cases.SF))
    # what is left: both outputs and what the last stage needs
    assert len({n for n in set(os.listdir(folder)) - before if n.startswith("saved-")}) <= 4
    assert docs.count() > 0


@pytest.mark.skipif(not cases.HAVE_SF, reason="driver test data not present")
def test_stages(spark):
    """Each stage judged on its own input, by brute force where there is one."""
    docs = cases.texts(spark)
    columns = docs.columns
    inputs, kept = {}, {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = {r["doc_id"]: r for r in docs.collect()}
        docs = saved(stage(spark, docs, cases.SF))
        kept[name] = docs.collect()
        if name != "best_fit_packing":
            assert docs.columns == columns
    quality = {r["doc_id"]: r["quality"] for r in cases.texts(spark, "labels").collect()}
    stay = {r["doc_id"] for r in kept["quality_classifier"]}
    judged = [(i in stay) == (q == 1) for i, q in quality.items()]
    assert sum(judged) >= 0.95 * len(judged)
    assert [r for r in kept["language_id"] if not re.search(r"[^\W\d_]", r["text"])] == []
    rows = [(i, r["text"]) for i, r in inputs["ngram_jaccard_join"].items()]
    want = {i for i, (_, c) in brute(rows, 5, 80, 100).items() if i == c}
    assert {r["doc_id"] for r in kept["ngram_jaccard_join"]} == want and len(want) < len(rows)
    assert all(shingles(t, 5) for _, t in rows if t)
    clean = {r["doc_id"]: r for r in kept["secret_scans"]}
    assert clean.keys() == inputs["secret_scans"].keys()
    for i, r in inputs["secret_scans"].items():
        assert bool(spans(r["text"])) == ("[SECRET]" in clean[i]["text"]) and clean[i]["n_chars"] == len(clean[i]["text"])
        assert not spans(clean[i]["text"]) or clean[i]["text"].count("[SECRET]") >= 1
    check_packing(kept["best_fit_packing"], [(i, r["text"]) for i, r in inputs["best_fit_packing"].items()], 2048)


def test_awkward_documents_pass_all_stages(spark, tmp_path):
    docs = cases.awkward(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (5, 0, 0), (6, 1, 0), (7, 0, 0), (8, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(r["length"] >= 1 for r in rows)
    none = tmp_path / "none"
    cases.empty(spark).write.parquet(str(none / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(none / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(none)).count() == 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, cases.empty(spark), str(none)).columns == docs.columns
    assert docs.filter(F.col("doc_id") == 5).count() == 1
