"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is a line of words: its documents in the order of a seeded hash, cut
into blocks of about ``BLOCK_DOCS`` documents.  A target of ``t`` words takes the
first ``t`` words of that line, going round a second time where ``t`` is above the
source's size.  The number of blocks that this takes is the source's exact block
quota.  The output shards are split in halves again and again; at every node the
blocks of each source that go to the left half are one multivariate hypergeometric
draw from those at the node.  A shard then has a quota of blocks of each source, and
draws disjoint ranges of the source's permuted blocks; its rows are shuffled locally.

No group is large: a block has about ``BLOCK_DOCS`` documents, running sums go over
blocks and over stretches of ``COARSE`` blocks, and one draw of the tree sees at most
``CHUNK`` sources.

Defined results: null texts have no words and are never taken; a null source is a
source of its own, the last one; repeated rows are documents of their own; an empty
table gives an empty mix; further columns of the input stay as they are.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskweave.llm.common import BLANK, WORD, cut
from maskweave.operators.joins import two_level_rank

WEIGHTS = (5.0, 2.0, 1.0)
BLOCK_DOCS = 512
COARSE = 1024
CHUNK = 4096
SHARD_WORDS = 5_000_000


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, size) rows → per source: source_key, sid, source_size, docs, target.

    Targets are ``share`` of all words by weight, at most ``cap`` times the source's
    size; what is above is shared again by weight among the others.  Each round is one
    aggregate over the sources; the driver only sees its three sums.
    """
    key = F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"), F.coalesce(F.col("source"), F.lit("")))
    per = (
        sizes.groupBy(key.alias("source_key"))
        .agg(F.sum("size").cast("long").alias("source_size"), F.count(F.lit(1)).alias("docs"))
        .withColumn("all", F.lit(0))
    )
    ranked = two_level_rank(per, ["all"], "source_key", "sid").drop("all")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("limit", F.lit(float(cap)) * F.col("source_size"))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while total:
        over = F.col("limit") <= F.lit(level) * F.col("weight")
        n, used, left = ranked.agg(F.count_if(over), F.sum(F.when(over, F.col("limit"))), F.sum(F.when(~over, F.col("weight")))).first()
        if n == full or not left:
            break
        full, level = n, max(0.0, share * total - (used or 0.0)) / left
    return cut(ranked.withColumn("target", F.least("limit", F.lit(level) * F.col("weight"))), "mix-targets")


def split_tree(counts: np.ndarray, shards: int, seed: list[int]) -> list[tuple[int, int, int]]:
    """(source index, shard, blocks) of one random split of ``counts`` blocks over equal shards."""
    total = int(counts.sum())
    slots = lambda s: total * s // shards
    out, todo = [], [(0, shards, np.flatnonzero(counts), counts[counts > 0])]
    while todo:
        lo, hi, who, have = todo.pop()
        if hi - lo == 1:
            out += [(int(i), lo, int(n)) for i, n in zip(who, have)]
            continue
        mid = (lo + hi) // 2
        rng = np.random.default_rng([*seed, lo, hi])
        left = rng.multivariate_hypergeometric(have, slots(mid) - slots(lo), method="marginals")
        for a, b, part in ((lo, mid, left), (mid, hi, have - left)):
            if part.any():
                todo.append((a, b, who[part > 0], part[part > 0]))
    return out


def shard_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(sid, quota) → (sid, slot, shard): which shard draws a source's slot-th permuted block."""

    def draw(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sid")
        got = split_tree(pdf["quota"].to_numpy(np.int64), shards, [seed, int(key[0])])
        out = pd.DataFrame(got, columns=["i", "shard", "n"], dtype=np.int64).sort_values(["i", "shard"])
        end = out.groupby("i")["n"].cumsum()
        return pd.DataFrame({"sid": pdf["sid"].to_numpy()[out["i"]], "shard": out["shard"], "lo": end - out["n"], "hi": end})

    chunk = F.floor((F.col("sid") - 1) / F.lit(CHUNK)).cast("long")
    ranges = (
        quotas.filter("quota > 0").select("sid", "quota", chunk.alias("chunk"))
        .groupBy("chunk").applyInPandas(draw, "sid long, shard long, lo long, hi long")
    )
    return ranges.select("sid", "shard", F.explode(F.expr("sequence(lo, hi - 1)")).alias("slot"))


def plan_mix(
    docs: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0, shard_words: int = SHARD_WORDS, seed: int = 17,
    keep_rows: bool = False,
) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, and taken0, taken1, shard0, shard1.

    ``taken0`` and ``taken1`` are the words that the first and the second round take,
    ``shard0`` and ``shard1`` where they go (null: nowhere).  With ``keep_rows`` the
    whole input row comes along in the struct ``row``.
    """
    kept = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep_rows else []
    base = docs.select(
        "doc_id", "source", *kept, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"),
    )
    slim = cut(base.drop("row"), "mix-sizes")
    targets = source_targets(slim, weights, share, cap)
    key = F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"), F.coalesce(F.col("source"), F.lit("")))
    blocks = F.ceil(F.col("docs") / F.lit(BLOCK_DOCS)).cast("long")
    of_source = targets.select("source_key", "sid", blocks.alias("blocks"))
    place = lambda rows: (
        rows.withColumn("source_key", key).join(of_source, "source_key")
        .withColumn("block", F.pmod(F.shiftright("h", 8), F.col("blocks"))).drop("source_key", "blocks")
    )
    sums = place(slim).groupBy("sid", "block").agg(F.sum("size").alias("words")).withColumn("stretch", F.floor(F.col("block") / F.lit(COARSE)))
    sums = cut(sums, "mix-blocks")
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    stretches = sums.groupBy("sid", "stretch").agg(F.sum("words").alias("words"))
    stretches = stretches.select("sid", "stretch", F.coalesce(F.sum("words").over(before("sid", "stretch")), F.lit(0)).alias("from"))
    line = (
        sums.withColumn("inside", F.coalesce(F.sum("words").over(before("sid", "stretch", "block")), F.lit(0)))
        .join(stretches, ["sid", "stretch"])
        .join(targets.select("sid", "source_size", "target", F.floor("target").cast("long").alias("words_taken")), "sid")
        .select("sid", "block", "source_size", "target", "words_taken", (F.col("from") + F.col("inside")).alias("start"))
    )
    line = cut(line, "mix-line")
    first, second = F.col("start") < F.col("words_taken"), F.col("start") + F.col("source_size") < F.col("words_taken")
    ends = line.groupBy("sid").agg(
        F.coalesce(F.max(F.when(first, F.col("block") + 1)), F.lit(0)).alias("round0"),
        F.coalesce(F.max(F.when(second, F.col("block") + 1)), F.lit(0)).alias("round1"),
    )
    quotas = cut(ends.withColumn("quota", F.col("round0") + F.col("round1")), "mix-quotas")
    taken = targets.agg(F.sum("target")).first()[0] or 0.0
    slots = shard_quotas(quotas.select("sid", "quota"), max(1, math.ceil(taken / shard_words)), seed)

    @F.pandas_udf("long")
    def permuted(at: pd.Series, quota: pd.Series) -> pd.Series:
        step = {k: next(s for s in range(max(1, int(k * 0.618)), k + 2) if math.gcd(s, k) == 1) for k in set(quota) if k}
        return pd.Series([(a * step[k] + seed) % k for a, k in zip(at, quota)], dtype="int64")

    copies = line.join(quotas, "sid").select(
        "sid", "block", "quota",
        F.explode(F.filter(F.array(
            F.when(first, F.struct(F.lit(0).alias("round"), F.col("block").alias("at"))),
            F.when(second, F.struct(F.lit(1).alias("round"), (F.col("round0") + F.col("block")).alias("at"))),
        ), lambda x: x.isNotNull())).alias("c"),
    )
    copies = copies.select("sid", "block", "c.round", permuted(F.col("c.at"), F.col("quota")).alias("slot")).join(slots, ["sid", "slot"])
    shards = copies.groupBy("sid", "block").agg(
        F.max(F.when(F.col("round") == 0, F.col("shard"))).alias("shard0"), F.max(F.when(F.col("round") == 1, F.col("shard"))).alias("shard1")
    )
    line = cut(line.join(shards, ["sid", "block"], "left"), "mix-plan")
    inside = Window.partitionBy("sid", "block").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    got = lambda end: F.greatest(F.lit(0), F.least(F.col("size"), F.col("words_taken") - end))
    out = (
        place(base if keep_rows else slim).withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(line, ["sid", "block"]).withColumn("pos", F.col("start") + F.col("inside"))
        .withColumn("taken0", got(F.col("pos"))).withColumn("taken1", got(F.col("pos") + F.col("source_size")))
    )
    return out.select(
        "doc_id", "size", "source_size", "target", (F.col("taken0") + F.col("taken1")).alias("taken"), "taken0", "taken1",
        F.when(F.col("taken0") > 0, F.col("shard0")).alias("shard0"), F.when(F.col("taken1") > 0, F.col("shard1")).alias("shard1"),
        *(["row", "h"] if keep_rows else []),
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed rows with the columns of ``docs``, shard by shard, in a shuffled order inside each.

    The one copy of a source that its target cuts ends after the last word taken.
    """
    plan = plan_mix(docs, keep_rows=True, **options)
    rounds = F.array(
        F.struct(F.lit(0).alias("round"), F.col("taken0").alias("taken"), F.col("shard0").alias("shard")),
        F.struct(F.lit(1).alias("round"), F.col("taken1").alias("taken"), F.col("shard1").alias("shard")),
    )
    copies = plan.select("row", "size", "h", F.explode(F.filter(rounds, lambda c: c["taken"] > 0)).alias("c"))
    begin = F.concat(F.lit(rf"^(?:{BLANK}*+{WORD}+){{"), F.col("c.taken").cast("string"), F.lit("}+"))
    text = F.when(F.col("c.taken") < F.col("size"), F.call_function("regexp_extract", F.col("row.text"), begin, F.lit(0))).otherwise(F.col("row.text"))
    rows = copies.withColumn("text", text).repartition("c.shard").sortWithinPartitions("c.shard", F.xxhash64("h", "c.round"))
    return rows.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
