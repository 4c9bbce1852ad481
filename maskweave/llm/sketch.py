"""Document fingerprints: threshold-scaled sketches of word shingles, in DataFrame functions only.

A sketch keeps every distinct 5-word-shingle hash below a fixed fraction of the hash
range, so its size follows the document's and sketches of very unequal documents can
be compared: the share of one sketch that lies in the other estimates containment.
Where no hash lies below the threshold the smallest one is kept.  Sketches merge
exactly: unite them, keep what is below the threshold, or else the smallest
(``merged``), which gives the sketch of the united shingle sets.

Words are what stands between blanks, in lower case; a text with fewer than five words
is one shingle; a text without words has the empty sketch.  Two empty sketches are
alike (1), an empty and another one are not (0).

Defined results: null texts count as empty; ids are put in descending order with null
as the last; rows that share an id have as next document the one of the next id whose
text has the smallest hash; an only document is its own next one; an empty table gives
an empty result; further columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskweave.llm.common import BLANK, cut, whole_text
from maskweave.operators.joins import two_level_rank

SHINGLE = 5
#: one in so many hashes lies below the threshold
SCALE = 8
LOWEST = -(2**63)


def threshold(scale: int = SCALE) -> int:
    return LOWEST + 2**64 // scale


def with_sketch(df: DataFrame, text: Column, out: str, scale: int = SCALE) -> DataFrame:
    """``df`` with the sorted array of kept hashes of ``text`` in column ``out``."""
    words = F.filter(F.split(F.lower(text), f"{BLANK}+"), lambda w: w != "")
    df = df.withColumn("_words", F.transform(words, lambda w: F.xxhash64(w)))
    word = lambda i, j: F.get("_words", i + F.lit(j))
    runs = F.transform(
        F.sequence(F.lit(0), F.size("_words") - F.lit(SHINGLE)), lambda i: F.xxhash64(*[word(i, j) for j in range(SHINGLE)])
    )
    hashes = F.when(F.size("_words") >= SHINGLE, runs).when(F.size("_words") > 0, F.array(F.xxhash64("_words")))
    df = df.withColumn("_hashes", F.coalesce(hashes, F.array().cast("array<bigint>"))).drop("_words")
    df = df.withColumn("_low", F.filter("_hashes", lambda h: h < F.lit(threshold(scale)))).withColumn("_min", F.array_min("_hashes"))
    kept = F.when(F.size("_low") > 0, F.array_sort(F.array_distinct("_low"))).otherwise(F.array_compact(F.array("_min")))
    return df.withColumn(out, kept).drop("_hashes", "_low", "_min")


def merged(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of the union of two shingle sets, from their sketches."""
    both = F.array_sort(F.array_union(a, b))
    low = F.filter(both, lambda h: h < F.lit(threshold(scale)))
    return F.when(F.size(low) > 0, low).otherwise(F.slice(both, 1, 1))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets, 0 to 1."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either).cast("double")


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1 (1 for an empty a)."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a)).cast("double")


def as_string(sketch: Column) -> Column:
    return F.concat_ws(",", F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")))


def neighbours(ids: DataFrame) -> DataFrame:
    """(k, n, id) of distinct ids → (k, prev_k, prev_n): the one before it in descending order of id, in a ring."""
    # ~id falls as id rises and never overflows
    ranked = two_level_rank(
        ids.filter("id IS NOT NULL").select("k", "n", F.lit(0).alias("all"), F.bitwise_not("id").alias("order")), ["all"], "order", "r"
    ).select("k", "n", "r")
    count = ranked.count()
    ranked = cut(ranked.union(ids.filter("id IS NULL").select("k", "n", F.lit(count + 1).cast("long"))), "sketch-ranks")
    count = ranked.count()
    back = ranked.select(F.col("k").alias("prev_k"), F.col("n").alias("prev_n"), (F.col("r") % F.lit(max(count, 1)) + 1).alias("r"))
    return ranked.join(back, "r").select("k", "prev_k", "prev_n")


def fingerprint_documents(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """The fingerprint of every text and of its edited text, with their likeness (see the module).

    The edited text replaces the last floor(n/2) code points by the first as many of the
    next document.
    """
    k = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    texts = docs.select(k.alias("k"), whole_text().alias("text"))
    ids = texts.groupBy("k").agg(F.max(F.length("text")).alias("n"), F.min(F.xxhash64("text")).alias("pick"))
    ids = cut(ids.withColumn("id", F.when(F.col("k") != "", F.col("k").cast("long"))), "sketch-ids")
    ring = cut(neighbours(ids).join(ids.select("k", "pick"), "k"), "sketch-links")
    # both joins read the same two columns by the same key, so texts move once; sketches are made after the move
    # (an equality here would become a second join key and part the two moves; so the row's hash is compared by xor)
    chosen = F.xxhash64("text").bitwiseXOR(F.col("pick")) == 0
    sent = texts.join(ring.select("k", "prev_k", "prev_n", "pick"), "k").filter(chosen)
    heads = (
        with_sketch(sent, F.col("text"), "next_kept", scale)
        .select(F.col("prev_k").alias("k"), F.expr("substring(text, 1, cast(prev_n DIV 2 as int))").alias("head"), "next_kept")
        .groupBy("k").agg(F.first("head").alias("head"), F.first("next_kept").alias("next_kept"))
    )
    edited = (
        with_sketch(texts.join(heads, "k"), F.col("text"), "kept", scale)
        .withColumn("n", F.length("text")).withColumn("half", F.expr("n DIV 2"))
        .withColumn("edited", F.expr("concat(substring(text, 1, cast(n - half as int)), substring(head, 1, cast(half as int)))"))
        .select("k", F.col("n").cast("long").alias("n_chars"), "kept", "next_kept", "edited")
    )
    edited = with_sketch(edited, F.col("edited"), "edited_kept", scale)
    return edited.select(
        F.when(F.col("k") != "", F.col("k").cast("long")).alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        as_string(F.col("kept")).alias("fingerprint"), as_string(F.col("edited_kept")).alias("edited_fingerprint"),
        likeness(F.col("kept"), F.col("edited_kept")).alias("near_edited"), likeness(F.col("kept"), F.col("next_kept")).alias("near_next"),
        containment(F.col("edited_kept"), F.col("kept")).alias("edited_contained"),
    )
