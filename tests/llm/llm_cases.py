"""Awkward tables that every operator has to take."""

import os

SF = "/root/testdata/sf0.001"
HAVE_SF = os.path.isdir(SF)
# the second line holds names that operators use themselves
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "id string, score string, spans string, rows int, kept int, n_tokens string, lang_pred int, text_view int, bucket int")
LONG = ("a very long text with some words, over and over. " * 7000) + "x" * 90_000


def document(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, None if text is None else len(text), "i", "s", "p", 1, 2, "t", 3, 4, 5)


def awkward(spark):
    rows = [document(1, "one two three four five six seven"), document(1, "one two three four five six seven"),
            document(2, None), document(3, ""), document(4, " \n\t "), document(5, LONG, None, None),
            document(None, "one two three four five six seven"), document(6, "  Éé 日本 😀 ▁ <s> token = hunter22secret\n", None),
            document(7, "12 34 %%%", "fr"), document(8, "ab")]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(spark, name="documents"):
    from trailfold.llm.common import table
    return table(spark, SF, name)
