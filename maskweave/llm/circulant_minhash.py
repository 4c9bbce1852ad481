"""Near-duplicate detection by circulant MinHash, banding and exact verification.

A document is its set of distinct 5-word shingles.  The first permutation scatters the
shingles over ``UNIVERSE`` places; the second one, shifted by k places, gives the k-th
coordinate of the signature as its minimum over the set.  All coordinates of one
shingle are a run of the second permutation, so they are read at once.

Texts with equal sets are one class, a node of the link graph with a number of its own,
so rows that share a doc_id but not a set are different nodes.  Classes that share
a band of ``ROWS`` coordinates are candidates; with 64 bands of 6 a pair of similarity
0.75 or more is missed less than once in 250,000.  Candidates are verified on the full
sets in three rounds: every class against the partner it shares most bands with among
the smallest ids of its buckets; then against all those smallest ids; then all pairs
of a bucket that are still in different components.  So every candidate pair is either
decided or already connected by verified links, and near copies of one text need about
one test each, not all their pairs.  Components of the verified links give the result: a
component is named by its smallest doc_id, and one row with that doc_id is kept.

A pair is not verified where its parity bits rule it out: every shingle flips one of
``PARITY`` bits of its set, so two sets differ in at least as many shingles as bits, and
a pair whose bits differ too much cannot be similar enough.  That bound is exact.

Defined results: texts without words are linked with nothing, but rows without words that
share a doc_id count as one document; other rows that share a doc_id stay apart unless
their texts are near copies; a null doc_id counts as the largest one, and as equal to no
other; an empty table gives an empty result; further columns are left out (``keep_one``
keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskweave.llm.common import cut, flat_bytes, frugal, mix64, shingle_hashes, steps, word_hashes
from maskweave.llm.components import components

BANDS = 64
ROWS = 6
UNIVERSE = 1 << 22
SEED = 20
CHUNK = 4096  # shingles whose coordinates are held at once
PARITY = 1024
NO_ID = 2**63 - 1
KEY = ["id", "h1", "h2"]


def second_permutation(length: int, universe: int = UNIVERSE, seed: int = SEED) -> np.ndarray:
    """The second permutation, continued at its end by its first ``length`` places."""
    p = np.random.default_rng(seed).permutation(universe).astype(np.int32)
    return np.concatenate([p, p[:length]])


def signatures(shingles: np.ndarray, before: np.ndarray, permuted: np.ndarray, length: int) -> np.ndarray:
    """texts × length: minimum of the shifted second permutation over each text's shingles (none: the universe)."""
    universe = len(permuted) - length
    at = (shingles % np.uint64(universe)).astype(np.int64)
    runs = np.lib.stride_tricks.sliding_window_view(permuted, length)
    out = np.full((len(before) - 1, length), universe, np.int32)
    text = np.repeat(np.arange(len(before) - 1), np.diff(before))
    for i in range(0, len(at), CHUNK):
        who = text[i : i + CHUNK]
        first = np.flatnonzero(np.diff(who, prepend=-1))
        out[who[first]] = np.minimum(out[who[first]], np.minimum.reduceat(runs[at[i : i + CHUNK]], first, axis=0))
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """texts × bands: one 64-bit key per band, different from band to band."""
    parts = signature.reshape(len(signature), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2])
    for r in range(rows):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key.view(np.int64)


def parity_bits(shingles: np.ndarray, before: np.ndarray, bits: int = PARITY) -> np.ndarray:
    """texts × (bits / 64): one bit per residue of the hashes, set where an odd number of shingles has it."""
    texts = len(before) - 1
    place = np.repeat(np.arange(texts), np.diff(before)) * bits + ((shingles >> np.uint64(40)) % np.uint64(bits)).astype(np.int64)
    odd = (np.bincount(place, minlength=texts * bits) & 1).astype(np.uint8).reshape(texts, bits)
    return np.packbits(odd, axis=1).view(np.int64)


def may_be_similar(percent: int) -> str:
    """SQL over sizes na, nb and parity words pa0, pb0 ...: the two sets may have the similarity.

    A similarity of p percent leaves at most (100 - p) / (100 + p) of na + nb apart.
    """
    apart = " + ".join(f"bit_count(pa{i} ^ pb{i})" for i in range(PARITY // 64))
    sizes = f"100 * least(na, nb) >= {percent} * greatest(na, nb)"
    return f"{sizes} AND {100 + percent} * ({apart}) <= {100 - percent} * (na + nb)"


def measure(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per document: id, h1 and h2 (hashes of the text), n (shingles), d1 and d2 (digest of the set), bits (parity), bands."""
    length = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        permuted = second_permutation(length)
        for b in steps(batches, limit=500_000):
            s, before = shingle_hashes(*word_hashes(*flat_bytes(b.column("text"))))
            sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix64(s + np.uint64(k)), dtype=np.uint64)]) for k in (1, 2)]
            digest = [(x[before[1:]] - x[before[:-1]]).view(np.int64) for x in sums]
            keys = band_keys(signatures(s, before, permuted, length), bands, rows)
            keys = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, bands, dtype=np.int32), pa.array(keys.ravel()))
            parity = parity_bits(s, before)
            parity = pa.ListArray.from_arrays(np.arange(0, parity.size + 1, PARITY // 64, dtype=np.int32), pa.array(parity.ravel()))
            columns = [*map(b.column, KEY), pa.array(np.diff(before).astype(np.int64)), *map(pa.array, digest), parity, keys]
            yield pa.RecordBatch.from_arrays(columns, [*KEY, "n", "d1", "d2", "bits", "bands"])

    return docs.select(*key_of("doc_id", "text"), "text").mapInArrow(frugal(run), "id long, h1 long, h2 long, n long, d1 long, d2 long, bits array<long>, bands array<long>")


def key_of(doc_id: str, text: str) -> list[Column]:
    """``KEY``: the doc_id and two hashes of the text, by which rows with the same doc_id and text meet again."""
    return [F.coalesce(doc_id, F.lit(NO_ID)).cast("long").alias("id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def verify(pairs: DataFrame, texts: DataFrame, percent: int = 75) -> DataFrame:
    """The (a, b) whose full shingle sets have 100 * intersection >= percent * union; texts: (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in steps([batch], "ta", 500_000):
                sets = []
                for c in ("ta", "tb"):
                    s, before = shingle_hashes(*word_hashes(*flat_bytes(b.column(c))))
                    sets.append((s, np.repeat(np.arange(b.num_rows), np.diff(before)), np.diff(before)))
                value = np.concatenate([sets[0][0], sets[1][0]])
                row = np.concatenate([sets[0][1], sets[1][1]])
                order = np.lexsort((value, row))
                value, row = value[order], row[order]
                same = np.flatnonzero((value[1:] == value[:-1]) & (row[1:] == row[:-1]))
                both = np.bincount(row[same], minlength=b.num_rows)
                either = sets[0][2] + sets[1][2] - both
                ok = pa.array((100 * both >= percent * either) & (either > 0))
                yield b.select(["a", "b"]).filter(ok)

    first = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    full = first.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    return full.select("a", "b", "ta", "tb").mapInArrow(frugal(run), "a long, b long").distinct()


def resolve(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, percent: int = 75) -> DataFrame:
    """Per document: KEY, n, component (its smallest id), kept, several (rows may share the KEY of a kept one)."""
    measured = cut(measure(docs, bands, rows).withColumn("row", F.monotonically_increasing_id()), "dup-bands")
    # the bands of one class are equal, so any of its rows has them
    classes = measured.filter("n > 0").groupBy("d1", "d2", "n").agg(F.min("id").alias("rep"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()), "dup-classes")
    # of the rows with a class's smallest id, one is its head
    first = measured.filter("n > 0").join(classes, ["d1", "d2", "n"]).filter("id = rep")
    heads = cut(
        first.groupBy("node").agg(
            (F.count(F.lit(1)) > 1).alias("several"), *[F.first(c).alias(c) for c in (*KEY, "row", "n", "bits", "bands")]
        ).withColumnsRenamed({"id": "rep", "node": "id"}),
        "dup-heads",
    )
    members = cut(heads.select("id", F.explode("bands").alias("band")), "dup-members")
    buckets = members.groupBy("band").agg(F.min("id").alias("hub"), F.max("id").alias("last")).filter("hub <> last").drop("last")
    # only classes in a bucket with others go on
    shared = cut(members.join(buckets, "band"), "dup-shared")
    parts = range(PARITY // 64)
    traits = heads.join(shared.select("id").distinct(), "id").select("id", "n", *[F.col("bits")[i].alias(f"p{i}") for i in parts])
    traits = cut(traits, "dup-traits")
    named = lambda x: [F.col("id").alias(x), F.col("n").alias(f"n{x}"), *[F.col(f"p{i}").alias(f"p{x}{i}") for i in parts]]
    of = lambda x: traits.select(*named(x))
    similar = F.expr(may_be_similar(percent))
    stars = shared.filter("id <> hub").groupBy(F.col("hub").alias("a"), F.col("id").alias("b")).agg(F.count(F.lit(1)).alias("together"))
    stars = cut(stars.join(of("b"), "b").join(of("a"), "a").filter(similar).select("a", "b", "together").distinct(), "dup-stars")
    wanted = shared.select("id").distinct()
    wanted = heads.join(wanted, "id", "left_semi").select(F.col("id").alias("node"), F.col("rep").alias("id"), "h1", "h2", "several")
    own = docs.filter("text IS NOT NULL").select(*key_of("doc_id", "text"), "text").join(wanted, KEY).select(F.col("node").alias("id"), "text", "several")
    own = cut(own, "dup-texts")
    texts = own.filter("NOT several").select("id", "text").unionByName(cut(own.filter("several").groupBy("id").agg(F.first("text").alias("text")), "dup-texts"))

    best = stars.groupBy("b").agg(F.max_by("a", F.struct("together", -F.col("a"))).alias("a")).select("a", "b")
    tested = cut(best, "dup-tested")
    links = cut(verify(tested, texts, percent), "dup-links")

    def root_of(roots: DataFrame, df: DataFrame, column: str, out: str) -> DataFrame:
        named = roots.select(F.col("id").alias(column), F.col("root").alias("_root"))
        return df.join(named, column, "left").withColumn(out, F.coalesce("_root", column)).drop("_root")

    for ends in ("hubs", "all"):
        roots = cut(components(links), "dup-roots")
        if ends == "hubs":
            pairs = root_of(roots, root_of(roots, stars, "a", "ra"), "b", "rb").filter("ra <> rb").select("a", "b")
        else:
            rooted = root_of(roots, shared.select("band", "id"), "id", "root")
            mixed = rooted.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("band")
            rooted = cut(rooted.join(mixed, "band").join(traits, "id"), "dup-mixed")
            side = lambda x: rooted.select("band", F.col("root").alias(f"r{x}"), *named(x))
            pairs = side("a").join(side("b"), "band").filter((F.col("ra") < F.col("rb")) & similar).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = cut(pairs.distinct().join(tested, ["a", "b"], "left_anti"), "dup-pairs")
        links = cut(links.unionByName(verify(pairs, texts, percent)), "dup-links")
        tested = tested.unionByName(pairs)
    roots = cut(components(links), "dup-roots")
    by_class = root_of(roots, heads.select("id", "rep", "row", "several"), "id", "root")
    kept = by_class.groupBy("root").agg(F.min("rep").alias("component"), F.min_by(F.struct("row", "several"), F.struct("rep", "id")).alias("best"))
    kept = by_class.select(F.col("id").alias("node"), "root").join(kept, "root").select("node", "component", "best.*").withColumnRenamed("row", "best")
    kept = cut(classes.join(kept, "node").drop("node", "rep"), "dup-kept")
    linked = measured.filter("n > 0").join(kept, ["d1", "d2", "n"]).select(*KEY, "n", "component", (F.col("row") == F.col("best")).alias("kept"), "several")
    bare = measured.filter("n = 0").select(*KEY, "row", "n")
    once = bare.filter(F.col("id") != NO_ID).groupBy("id").agg(F.min("row").alias("best"), (F.count(F.lit(1)) > 1).alias("several"))
    known = bare.filter(F.col("id") != NO_ID).join(once, "id").select(*KEY, "n", F.col("id").alias("component"), (F.col("row") == F.col("best")).alias("kept"), "several")
    unknown = bare.filter(F.col("id") == NO_ID).select(*KEY, "n", F.col("id").alias("component"), F.lit(True).alias("kept"), F.lit(False).alias("several"))
    return linked.unionByName(known).unionByName(unknown)


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept (see the module)."""
    plain = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return resolve(docs, **options).select(plain("id").alias("doc_id"), F.col("n").alias("n_shingles"), plain("component").alias("component_id"), "kept")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows, with all their columns, of one document of each component; of rows that share its doc_id and text, one."""
    found = cut(resolve(docs, **options).filter("kept"), "dup-found")
    keys = found.groupBy(*KEY).agg(F.max("several").alias("several"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.select("row", *key_of("row.doc_id", "row.text")).join(keys, KEY)
    once = rows.filter("several").groupBy(*KEY).agg(F.min_by("row", F.xxhash64("row.text")).alias("row"))
    return rows.filter("NOT several").select("row").unionByName(once.select("row")).select("row.*")
