"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so
its size follows the text and sketches of very unequal texts stay comparable:
the hashes of a union, or of a part, below the threshold are those that the
sketches have.  Texts of at most ``COMPLETE`` distinct shingles keep all their
hashes (scale 1); two sketches are compared below the smaller threshold of both.

DataFrame functions only.  The next document in descending order of id is
found by a window in buckets of ids (cut at approximate quantiles, one per
shuffle partition); each bucket also gets a copy of the next bucket's first row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailfold.llm.common import shuffle_width

WORDS = 5
#: Beyond ``COMPLETE`` distinct shingles one hash in ``SCALE`` is kept.
SCALE, COMPLETE = 8, 128
SPACES = " \t\n\v\f\r"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shingle_hashes(text: Column, k: int = WORDS) -> Column:
    """Hashes of all runs of ``k`` lower-cased words; fewer words are one shingle, none gives an empty array."""
    none = F.array().cast("array<bigint>")

    def of(words: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(words) - k),
                           lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))
        return F.when(F.size(words) >= k, runs).otherwise(F.array(F.xxhash64(words)))

    return let(F.btrim(F.lower(text), F.lit(SPACES)),
               lambda t: F.when(F.length(t) == 0, none).otherwise(let(F.split(t, "[ \\t-\\r]+"), of)))


def sketch(text: Column, k: int = WORDS, scale: int = SCALE, complete: int = COMPLETE) -> Column:
    """Struct of ``scale`` and the sorted distinct ``hashes`` below its threshold."""
    def of(found: Column) -> Column:
        whole = F.size(found) <= complete
        kept = F.when(whole, found).otherwise(below(found, scale))
        return F.struct(F.when(whole, 1).otherwise(scale).alias("scale"),
                        F.sort_array(kept).alias("hashes"))

    return let(F.array_distinct(shingle_hashes(text, k)), of)


def below(hashes: Column, scale: int) -> Column:
    """The hashes in the lowest ``1 / scale`` of the range, zero upwards."""
    limit = (1 << 64) // scale
    return F.filter(hashes, lambda h: (h >= 0) & (h < F.lit(limit)))


def likeness(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Estimated Jaccard similarity of two sketches' texts; 1 for equal sketches, empty ones only of texts without words."""
    return _compared(a, b, scale, lambda x, y, both: both / (F.size(x) + F.size(y) - both))


def containment(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Estimated share of the first text's shingles that the second has."""
    return _compared(a, b, scale, lambda x, y, both: both / F.size(x))


def _compared(a: Column, b: Column, scale: int, ratio: Callable[[Column, Column, Column], Column]) -> Column:
    def at_one_scale(x: Column, other: Column) -> Column:
        return F.when((x["scale"] == 1) & (other["scale"] != 1), below(x["hashes"], scale)).otherwise(x["hashes"])

    def of(pair: Column) -> Column:
        both = F.size(F.array_intersect(pair["x"], pair["y"]))
        empty = (F.size(pair["x"]) == 0) | (F.size(pair["y"]) == 0)
        return F.when(empty, 0.0).otherwise(ratio(pair["x"], pair["y"], both).cast("double"))

    pair = F.struct(at_one_scale(a, b).alias("x"), at_one_scale(b, a).alias("y"))
    # an empty sketch at a larger scale tells nothing about its text
    known = (F.size(a["hashes"]) > 0) | (a["scale"] == 1)
    return F.when((a == b) & known, 1.0).otherwise(let(pair, of))


def written(s: Column) -> Column:
    """A sketch as text: scale, then the hashes in hexadecimal."""
    return F.concat(s["scale"].cast("string"), F.lit(":"),
                    F.concat_ws(",", F.transform(s["hashes"], lambda h: F.lower(F.hex(h)))))


def with_next(docs: DataFrame, id_col: str, text_col: str, carried: dict[str, Column] | None = None) -> DataFrame:
    """``id``, ``text`` (null: empty), the ``carried`` expressions of them, and each of the next row as ``next_*``.

    The order is descending by id, then by a hash of the text, null ids last;
    after the last row comes the first.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    width = shuffle_width(spark)
    cuts = rows.select("id").agg(F.percentile_approx("id", [i / width for i in range(1, width)] or [0.5], 10_000)
                                 .alias("cuts")).first()["cuts"]
    cuts = sorted(set(cuts or []))
    bucket = F.lit(0)
    if cuts:
        bucket = F.when(F.col("id").isNull(), -1).otherwise(
            F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("id"))))
    else:
        bucket = F.when(F.col("id").isNull(), -1).otherwise(0)
    rows = rows.withColumn("bucket", bucket)
    # the first row of every bucket: one id and hash per shuffle partition
    firsts = sorted((r["bucket"], *r["first"]) for r in rows.groupBy("bucket").agg(
        F.max(F.struct("id", "tie")).alias("first")).collect())
    carried = carried or {}
    names = ["text", *carried]
    if not firsts:
        none = rows.withColumns(carried)
        return none.select("id", *names, *[F.col(c).alias(f"next_{c}") for c in names])
    follows = [(firsts[i][1], firsts[i][2], firsts[(i + 1) % len(firsts)][0]) for i in range(len(firsts))]
    kind = rows.schema["id"].dataType
    at = F.col("i").cast("int")
    heads = spark.range(len(follows)).withColumnRenamed("id", "i").select(
        *[F.get(F.array(*[F.lit(f[j]).cast(t) for f in follows]), at).alias(n)
          for j, (n, t) in enumerate((("first_id", kind), ("first_tie", "bigint"), ("before", "int")))])
    copies = (rows.join(F.broadcast(heads), rows["id"].eqNullSafe(heads["first_id"]) & (rows["tie"] == heads["first_tie"]))
              .dropDuplicates(["before"]).select("id", "text", "tie", F.col("before").alias("bucket"), F.lit(1).alias("copy")))
    both = rows.select("id", "text", "tie", "bucket", F.lit(0).alias("copy")).unionByName(copies)
    both = both.withColumns(carried).withColumn("place", F.when(F.col("copy") == 0, F.col("id")))
    order = Window.partitionBy("bucket").orderBy(F.desc_nulls_last("place"), "copy", F.desc("tie"), F.desc("text"))
    led = both.withColumns({f"next_{c}": F.lead(c).over(order) for c in names})
    return led.filter(F.col("copy") == 0).select("id", *names, *[f"next_{c}" for c in names])


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last half replaced by as much of the beginning of ``following``."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - half), F.substr(following, F.lit(1), half))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and its edited text, and likeness to the edited and the next text.

    Every row gives one, repeated rows too; a null text is an empty one, whose
    sketch is empty: it is like another empty one (1) and like nothing else
    (0).  Null ids come last in the order.  An empty table gives no rows;
    a single row is its own next.  Other columns are not read.
    """
    led = with_next(docs, id_col, text_col, {"print": sketch(F.col("text"))})
    changed = led.withColumn("changed", edited(F.col("text"), F.col("next_text")))
    done = changed.withColumn("changed_print", sketch(F.col("changed")))
    return done.select(
        F.col("id").alias(id_col), F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("changed").cast("binary"), 256).alias("edited_sha256"),
        written(F.col("print")).alias("fingerprint"), written(F.col("changed_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("changed_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
        containment(F.col("print"), F.col("changed_print")).alias("kept_in_edited"),
        containment(F.col("print"), F.col("next_print")).alias("contained_in_next"))
