"""Registered queries of this subpackage: thin calls of its operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailfold.llm import fingerprints, html_text, jaccard_join, language_id, nearest, packing, quality, secrets, sentencepiece_bpe, spelling, suffix_dedup, token_counts, whitening
from trailfold.llm.common import table

PIECES, WORDS = "piece_bpe_32k.model", "word_bpe_49k.json"


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 3-word shingles are alike by 90 of 100."""
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.fit(docs, ~language_id.held_out(docs["doc_id"])))
    return found.select("doc_id", language_id.held_out(found["doc_id"]).alias("held_out"), "lang_pred", "score")


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text by a trigram index."""
    return secrets.report(table(spark, sf_dir, "documents"))


#: The private-key rule in a form for RE2, which knows no possessive repeats and no lookahead: between the lines no five
#: hyphens follow each other; a token never begins with what the separators before it take; a short last line ends its line.
PRIVATE_KEY_SQL = (
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
    r"(?:[^-]*(?:-{1,4}[^-]+)*-----END [A-Z ]{0,40}PRIVATE KEY-----"
    r"""|(?:(?:[\s\x0B"'+,>]|\\[rn])*(?:[A-Za-z0-9/][A-Za-z0-9+/]{23,}={0,2}|(?:Proc-Type|DEK-Info):[^\r\n\\]*"""
    r"""|[A-Za-z0-9/][A-Za-z0-9+/]*={1,2})|\r?\n[ \t]*[A-Za-z0-9+/]+(?m:$))*)""")


def _secrets_sql() -> str:
    """The expressions alone, over every text: what lies between matches gives their places."""
    parts = []
    for order, rule in enumerate(secrets.RULES):
        pattern = (PRIVATE_KEY_SQL if rule.kind == "private_key" else rule.pattern).replace("'", "''")
        parts.append(f"""SELECT doc_id, n, {order} AS o, '{rule.kind}' AS kind, i.i AS i,
            list_sum(list_transform(between[1:i.i], lambda x: length(x))) +
            coalesce(list_sum(list_transform(whole[1:i.i - 1], lambda x: length(x))), 0) AS s, length(whole[i.i]) AS size,
            length(checked[i.i]) AS checked
          FROM (SELECT doc_id, n, string_split_regex(t, '{pattern}') AS between, regexp_extract_all(t, '{pattern}') AS whole,
                       regexp_extract_all(t, '{pattern}', {rule.group}) AS checked FROM d) AS p,
               LATERAL (SELECT unnest(range(1, len(p.whole) + 1)) AS i) AS i
          WHERE length(checked[i.i]) >= {rule.least}""")
    base = [i for i, r in enumerate(secrets.RULES) if r.base]
    text = "kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + size AS BIGINT), ',' ORDER BY s, o"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS n FROM documents),
        f AS ({' UNION ALL '.join(parts)}),
        g AS (SELECT n, {', '.join(f"count(*) FILTER (WHERE o = {i}) AS n_{secrets.RULES[i].kind}" for i in base)},
                     string_agg({text}) FILTER (WHERE o IN ({', '.join(map(str, base))})) AS b, string_agg({text}) AS a
              FROM f GROUP BY n)
        SELECT doc_id, {', '.join(f"coalesce(n_{secrets.RULES[i].kind}, 0) AS n_{secrets.RULES[i].kind}" for i in base)},
               sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans
        FROM d LEFT JOIN g USING (n)"""


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts packed into sequences of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORDS))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every text, and the text that they decode to."""
    return sentencepiece_bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every text."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.fit(pages))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows found for every row whose id divides by 20."""
    return nearest.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probability of good quality of every document, from both views and from each."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, with_views=True)
    return scored.select("doc_id", "score", "text_view", "meta_view", (scored["score"] >= quality.KEEP).alias("keep"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold-scaled sketches of every text and its edited text."""
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without its repeated passages of 200 bytes."""
    left = suffix_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the corpus and the frequent word that each is a variant of."""
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents")))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of every vector, one row per component."""
    return whitening.components_of(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over all documents."""
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_language_id": op2_language_id,
    "op3_secret_scans": op3_secret_scans,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_token_counts": op6_token_counts,
    "op7_html_extraction": op7_html_extraction,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_fingerprints": op10_fingerprints,
    "op11_suffix_array_dedup": op11_suffix_array_dedup,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_embedding_whitening": op13_embedding_whitening,
    "pipeline": pipeline,
}
ORACLES: dict[str, str] = {
    "op3_secret_scans": _secrets_sql(),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
