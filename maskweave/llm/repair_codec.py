"""Token-id output as files of grammar-compressed blocks (Re-Pair), with random access.

Documents are put in ascending order of doc_id over the shards; a shard's ids (each
document's ids and the end id) are cut at documents into blocks of about ``BLOCK_IDS`` ids.
In a block, frequent pairs of neighbouring symbols are replaced by nonterminals again and
again: a round counts all pairs, takes those that occur ``MIN_COUNT`` times or more, and
replaces them from the left, never overlapping; it ends when there are none.  A pair that
is replaced becomes a rule.  (So a grammar is a block's, not a whole shard's, a round takes all
frequent pairs and not only the most frequent one, and rarer pairs stay.)
A row of the files is a block: its shard and number, its documents and their numbers of
ids, the rules, the expansion length of every rule, and the sequence of symbols, little
endian.  A range of ids is decoded without the rest: running expansion lengths say where
it lies, and only the symbols there are expanded.

Files are Parquet with binary columns, written to the shared folder by Spark, so a lost
executor's blocks are written again and readers need no other format.

Defined results: null texts count as empty, one end id; a null doc_id comes first; rows
that share a doc_id stay in the order of their texts' hashes; an empty table gives an empty
result; further columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskweave.llm.common import cut, frugal, steps
from maskweave.llm.encoding import STEP, encoder, ragged, vocabulary
from maskweave.session import checkpoint_dir

TOKENIZER = "word_bpe_49k.json"
END = 1
TERMINALS = 1 << 16  # symbols from here on are nonterminals
BLOCK_IDS = 1_000_000
MIN_COUNT = 16
BUCKETS = 1 << 18
BLOCK = "shard int, block int, doc_ids array<long>, sizes array<int>, rules binary, lengths binary, symbols binary"


def grouped(keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, places) by key, then place; ``places`` are ascending."""
    low = int(places[-1]).bit_length()
    if int(keys.max()).bit_length() + low <= 64:  # both in one word, which sorts faster than an order does
        both = (keys << np.uint64(low)) | places.astype(np.uint64)
        both.sort()
        return both >> np.uint64(low), (both & np.uint64((1 << low) - 1)).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    return keys[order], places[order]


def compress(ids: np.ndarray, min_count: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules as pairs of symbols, expansion length of each rule, symbols) of a block of ids."""
    symbols, rules = ids.astype(np.uint32), []
    if len(symbols) and int(symbols.max()) >= TERMINALS:
        raise ValueError(f"token ids of {TERMINALS} and more are not coded")
    known = np.zeros(0, np.int64)
    while len(symbols) > 1:
        width = np.uint64(int(symbols.max()).bit_length())
        pair = (symbols[:-1].astype(np.uint64) << width) | symbols[1:]
        bucket = ((pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 18)).astype(np.int64)
        often = np.bincount(bucket, minlength=BUCKETS) >= min_count  # no pair outside can be frequent
        places = np.flatnonzero(often[bucket])
        if not len(places):
            break
        key, places = grouped(pair[places], places)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.append(first, len(key)))
        value = key[first][count >= min_count]
        if not len(value):
            break
        frequent = np.repeat(count >= min_count, count)
        which = np.repeat(np.arange(len(value)), count[count >= min_count])
        there = np.full(len(symbols), -1, np.int32)  # by place, the frequent pair that begins there
        there[places[frequent]] = which
        places = np.flatnonzero(there >= 0)
        which = there[places]
        # of overlapping places, every second one of a run is taken
        new = np.ones(len(places), bool)
        new[1:] = np.diff(places) > 1
        start = np.maximum.accumulate(np.where(new, np.arange(len(places)), 0))
        taken = (np.arange(len(places)) - start) % 2 == 0
        places, which = places[taken], which[taken]
        used = np.flatnonzero(np.bincount(which, minlength=len(value)))
        number = np.zeros(len(value), np.int64)
        number[used] = TERMINALS + len(known) + np.arange(len(used))
        halves = np.column_stack([value[used] >> width, value[used] & ((np.uint64(1) << width) - np.uint64(1))]).astype(np.int64)
        size = np.where(halves < TERMINALS, 1, 0)
        inner = halves >= TERMINALS
        size[inner] = known[halves[inner] - TERMINALS]
        known = np.concatenate([known, size.sum(axis=1)])
        rules.append(halves)
        symbols[places] = number[which]
        keep = np.ones(len(symbols), bool)
        keep[places + 1] = False
        symbols = symbols[keep]
    return (np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)).astype("<u4"), known.astype("<u4"), symbols.astype("<u4")


def expand(rules: np.ndarray, lengths: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """The ids that the symbols stand for; only the rules that the symbols use are expanded, each once."""
    used = np.unique(symbols[symbols >= TERMINALS]).astype(np.int64) - TERMINALS
    flat = (used + TERMINALS).astype(np.uint32)
    while (inner := flat >= TERMINALS).any():  # level by level
        out = np.repeat(flat, np.where(inner, 2, 1))
        at = np.flatnonzero(inner) + np.arange(int(inner.sum()))
        halves = rules[flat[inner].astype(np.int64) - TERMINALS]
        out[at], out[at + 1] = halves[:, 0], halves[:, 1]
        flat = out
    sizes = lengths[used].astype(np.int64)
    begins = np.zeros(len(lengths), np.int64)
    begins[used] = np.cumsum(sizes) - sizes
    inner = symbols >= TERMINALS
    rule = symbols[inner].astype(np.int64) - TERMINALS
    starts, sizes = symbols.astype(np.int64), np.ones(len(symbols), np.int64)
    starts[inner], sizes[inner] = TERMINALS + begins[rule], lengths[rule]
    return np.concatenate([np.arange(TERMINALS, dtype=np.uint32), flat])[ragged(starts, sizes)]


def read_range(rules: np.ndarray, lengths: np.ndarray, symbols: np.ndarray, start: int, stop: int) -> np.ndarray:
    """The block's ids from ``start`` to before ``stop``, expanding only the symbols there."""
    sizes = np.ones(len(symbols), np.int64)
    inner = symbols >= TERMINALS
    sizes[inner] = lengths[symbols[inner].astype(np.int64) - TERMINALS]
    ends = np.cumsum(sizes)
    lo, hi = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left") + 1
    skip = start - int(ends[lo - 1] if lo else 0)
    return expand(rules, lengths, symbols[lo:hi])[skip : skip + stop - start]


def write_blocks(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end: int = END, block_ids: int = BLOCK_IDS) -> None:
    """Write the documents' ids to files of blocks at ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        words = encoder(vocabulary(tokenizer), False)
        held, names, sizes, number = [], [], [], 0

        def block() -> pa.RecordBatch:
            rules, lengths, symbols = compress(np.concatenate(held))
            row = {"shard": shard, "block": number, "doc_ids": names, "sizes": sizes, "rules": rules.tobytes(), "lengths": lengths.tobytes(), "symbols": symbols.tobytes()}
            types = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), *[pa.binary()] * 3]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types)], list(row))

        for b in steps(batches, limit=STEP):
            ids, before = words.encode(b.column("text"))
            counts = np.diff(before) + 1
            every = np.full(len(ids) + b.num_rows, end, np.uint32)
            starts = np.concatenate([[0], np.cumsum(counts)])
            every[ragged(starts[:-1], counts - 1)] = ids
            held.append(every)
            names += b.column("doc_id").to_pylist()
            sizes += counts.tolist()
            if sum(map(len, held)) >= block_ids:
                yield block()
                held, names, sizes, number = [], [], [], number + 1
        if held:
            yield block()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tie = F.xxhash64("text")
    rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie).mapInArrow(frugal(run), BLOCK).write.parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files at ``path``: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                rules, lengths, symbols = (np.frombuffer(r[c], "<u4") for c in ("rules", "lengths", "symbols"))
                ids = expand(rules.reshape(-1, 2), lengths, symbols).astype("<u4")
                ends = np.cumsum(r["sizes"], dtype=np.int64)
                starts = ends - r["sizes"]
                data = memoryview(ids.tobytes())
                crc = [zlib.crc32(data[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist())]
                n = len(ends)
                columns = [pa.array([r["shard"]] * n, pa.int32()), pa.array([r["block"]] * n, pa.int32()), pa.array(r["doc_ids"], pa.int64()), pa.array(starts), pa.array(r["sizes"], pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "block", "doc_id", "inside", "n_tokens", "ids_crc32"])

    blocks = spark.read.schema(BLOCK).parquet(path)
    # two sums: over a shard's blocks, and over the shards, of which there are as many as tasks wrote
    totals = blocks.select("shard", "block", F.expr("aggregate(sizes, 0L, (a, s) -> a + s)").alias("n"))
    totals = cut(totals, "ids-blocks")
    earlier = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    shards = totals.groupBy("shard").agg(F.sum("n").alias("n")).withColumn("all", F.lit(0))
    shards = shards.select("shard", F.coalesce(F.sum("n").over(earlier("all", "shard")), F.lit(0)).alias("shard_start"))
    totals = totals.select("shard", "block", F.coalesce(F.sum("n").over(earlier("shard", "block")), F.lit(0)).alias("block_start"))
    starts = cut(totals.join(shards, "shard"), "ids-starts")
    found = blocks.mapInArrow(frugal(run), "shard int, block int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    placed = found.join(starts, ["shard", "block"])
    return placed.select("doc_id", (F.col("shard_start") + F.col("block_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def encode_and_read(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write the documents' blocks (below the shared checkpoint folder if no path is given) and read them back."""
    import uuid

    spark = docs.sparkSession
    path = path or f"{checkpoint_dir(spark).rstrip('/')}/llm-token-blocks-{uuid.uuid4().hex}"
    write_blocks(docs, path)
    return read_documents(spark, path)
